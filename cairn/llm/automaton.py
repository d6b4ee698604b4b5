"""A multi-pattern automaton built once a Python worker and shared by the text operators."""

from __future__ import annotations

from functools import lru_cache

import ahocorasick


@lru_cache(maxsize=16)
def automaton(words: tuple[str, ...]) -> ahocorasick.Automaton:
    """Aho-Corasick automaton whose values are the indexes of the words."""
    a = ahocorasick.Automaton()
    for i, w in enumerate(words):
        a.add_word(w, i)
    a.make_automaton()
    return a
