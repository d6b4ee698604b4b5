"""Shared plumbing: session settings, table access, lineage cuts, skew helpers."""
