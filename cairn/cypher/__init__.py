"""A read-only Cypher subset: parser and compiler to DataFrame plans."""

from cairn.cypher.compiler import CypherEngine
from cairn.cypher.parser import CypherError, is_write_query, parse

__all__ = ["CypherEngine", "CypherError", "is_write_query", "parse"]
