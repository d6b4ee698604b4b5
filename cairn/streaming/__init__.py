"""Structured Streaming maintenance."""
