"""Problem 8: token ids of whole texts by a public byte-level BPE tokenizer."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.plans.runtime import spread

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Fixed value: the pattern that splits text before the merges of these rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Texts are encoded in parts of at least this many characters; it bounds one call's memory and changes no id.
PART_CHARS = 16_384

# A match of the pattern never runs from a non-space into white space, and none looks back: such a place is a token
# boundary whatever stands on either side.
_SAFE = re.compile(r"(?<=\S)(?=\s)")


@lru_cache(maxsize=4)
def encoder(ranks_path: str = DEFAULT_RANKS):
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, size: int = PART_CHARS):
    """Cut a long text at safe boundaries; a stretch without any stays whole."""
    start = 0
    while len(text) - start > size:
        m = _SAFE.search(text, start + size)
        if not m:
            break
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


def encode(text: str | None, ranks_path: str = DEFAULT_RANKS) -> list[int]:
    """Ids of a text without special tokens, whose names in a text are ordinary text; [] for null and for empty."""
    if not text:
        return []
    enc = encoder(ranks_path)
    if len(text) <= PART_CHARS:
        return enc.encode_ordinary(text)
    return [i for p in parts(text) for i in enc.encode_ordinary(p)]


def decode(ids: list[int], ranks_path: str = DEFAULT_RANKS) -> str:
    """The text of ids; bytes are joined before they are read as UTF-8, since one character may span several ids."""
    return encoder(ranks_path).decode_bytes(ids).decode("utf-8")


def _mapper(fn, out_type: pa.DataType, name: str):
    def run(batches):
        for batch in batches:
            values = pa.array([fn(t) for t in batch.column(1).to_pylist()], out_type)
            yield pa.RecordBatch.from_arrays([batch.column(0), values], names=[batch.schema.names[0], name])

    return run


def encode_column(docs: DataFrame, key: str = "doc_id", text: str = "text", ranks_path: str = DEFAULT_RANKS) -> DataFrame:
    """(key, ids array<int>), one row a row of ``docs``: no shuffle, whole texts, null and empty give an empty list."""
    return spread(docs.select(F.col(key), F.col(text).cast("string").alias("t")), key).mapInArrow(_mapper(lambda t: encode(t, ranks_path), pa.list_(pa.int32()), "ids"), f"{key} {docs.schema[key].dataType.simpleString()}, ids array<int>")


def count_column(docs: DataFrame, key: str = "doc_id", text: str = "text", ranks_path: str = DEFAULT_RANKS) -> DataFrame:
    """(key, tokens int): only the number of ids, so that texts need not leave the worker."""
    return spread(docs.select(F.col(key), F.col(text).cast("string").alias("t")), key).mapInArrow(_mapper(lambda t: len(encode(t, ranks_path)), pa.int32(), "tokens"), f"{key} {docs.schema[key].dataType.simpleString()}, tokens int")
