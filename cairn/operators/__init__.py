"""Graph, search, history and quality operators."""
