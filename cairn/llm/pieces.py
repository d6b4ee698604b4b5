"""Problem 7: oversized items cut into overlapping pieces at natural boundaries, by dynamic programming."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cut penalties, from a blank line before an unindented line to the middle of a word. A piece that is half empty costs 0.25.
BLANK, TOP, LINE, SPACE, INSIDE = 0.0, 0.05, 0.2, 1.0, 3.0


def boundaries(data: bytes, max_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted byte positions at which data may be cut, each between whole characters, and their penalties.

    Line starts always count. In a line of more than max_bytes / 16 every white space does too, and where that is further
    apart, any character start about that far on; so the number of positions is in proportion to the length.
    """
    n, gap = len(data), max(4, max_bytes // 16)
    raw = np.frombuffer(data, np.uint8)
    lines = np.flatnonzero(raw[:-1] == 10) + 1 if n > 1 else np.empty(0, np.int64)
    first = raw[lines] if len(lines) else np.empty(0, np.uint8)
    indented = (first == 32) | (first == 9)
    # a line start after an empty line (\n\n or \n\r\n)
    before = np.zeros(len(lines), bool)
    if len(lines):
        two, three = raw[np.maximum(lines - 2, 0)], raw[np.maximum(lines - 3, 0)]
        before = ((lines >= 2) & (two == 10)) | ((lines >= 3) & (two == 13) & (three == 10))
    pen = np.where(before & ~indented, BLANK, np.where(~indented, TOP, LINE))
    pos, pen = [lines], [pen]
    edges = np.concatenate([[0], lines, [n]])
    for a, b in zip(edges[:-1][np.diff(edges) > gap], edges[1:][np.diff(edges) > gap]):
        line = raw[a : b - 1]
        spaces = np.flatnonzero((line == 32) | (line == 9)) + a + 1
        pos.append(spaces)
        pen.append(np.full(len(spaces), SPACE))
        stops = np.concatenate([[a], spaces, [b]])
        for at, end in zip(stops[:-1][np.diff(stops) > gap].tolist(), stops[1:][np.diff(stops) > gap].tolist()):
            extra = []
            while end - at > gap:
                at += gap
                while at > 0 and raw[at] & 0xC0 == 0x80:
                    at -= 1
                extra.append(at)
            pos.append(np.array(extra, np.int64))
            pen.append(np.full(len(extra), INSIDE))
    pos, pen = np.concatenate(pos), np.concatenate(pen)
    order = np.argsort(pos, kind="stable")
    pos, pen = pos[order], pen[order]
    ok = (pos > 0) & (pos < n)
    return pos[ok], pen[ok]


def split(data: bytes, max_bytes: int, overlap: int) -> list[tuple[int, int]]:
    """Half-open byte ranges of the pieces: each at most max_bytes, together the whole, each starting ``overlap`` bytes
    before the end of the one before, or at the line start within a quarter of it, or else at the next whole character.

    Dynamic programming over the boundaries: the cost of a plan is the sum of its cut penalties and of the squared shares
    by which its pieces fall short of max_bytes; the cheapest plan is taken, of equal ones that with the earliest last cut.
    """
    if max_bytes < 8 or not 0 <= overlap <= max_bytes // 2:
        raise ValueError("need max_bytes >= 8 and 0 <= overlap <= max_bytes / 2")
    n = len(data)
    if n <= max_bytes:
        return [(0, n)]
    pos, pen = boundaries(data, max_bytes)
    raw = np.frombuffer(data, np.uint8)
    # where the next piece starts if one ends at pos
    want = pos - overlap
    start = np.maximum(want, 0)
    if overlap:
        lines = np.flatnonzero(raw[:-1] == 10) + 1
        if len(lines):
            i = np.clip(np.searchsorted(lines, want), 0, len(lines) - 1)
            for near in (lines[i], lines[np.maximum(i - 1, 0)]):
                start = np.where((np.abs(near - want) <= overlap // 4) & (np.abs(near - want) < np.where(start == want, overlap, np.abs(start - want))), near, start)
        for _ in range(3):
            start = np.where((start > 0) & (raw[start] & 0xC0 == 0x80), start + 1, start)
    starts, ends, costs = np.maximum.accumulate(start), np.append(pos, n), np.append(pen, 0.0)
    m = len(pos)
    best = np.full(m + 1, np.inf)
    come = np.full(m + 1, -1)
    lows = np.searchsorted(starts, ends - max_bytes)
    for j in range(m + 1):
        if ends[j] <= max_bytes:
            best[j] = costs[j] + (1 - ends[j] / max_bytes) ** 2
        a, b = lows[j], min(j, m)
        if a < b:
            c = best[a:b] + (1 - (ends[j] - starts[a:b]) / max_bytes) ** 2
            k = int(np.argmin(c))
            if c[k] + costs[j] < best[j]:
                best[j], come[j] = c[k] + costs[j], a + k
    cuts, j = [], m
    while j >= 0:
        cuts.append(j)
        j = come[j]
    cuts.reverse()
    return [(0 if i == 0 else int(starts[cuts[i - 1]]), int(ends[j])) for i, j in enumerate(cuts)]


def split_column(items: DataFrame, max_bytes: int, overlap: int, *, key: str = "file_id", content: str = "content", text: bool = True) -> DataFrame:
    """(key, piece_no, n_pieces, start_byte, end_byte[, piece]): the pieces of every item; no shuffle, whole contents.

    A content of at most max_bytes stays one piece, an empty one too; a null one has none. With text=False the pieces'
    text is left out, and contents that stay whole do not leave the JVM.
    """
    length = F.octet_length(content)
    base = items.select(F.col(key).alias("k"), length.cast("int").alias("n"), (F.col(content) if text else F.when(length > max_bytes, F.col(content))).alias("c")).where("n is not null")
    fields = [("k", None), ("piece_no", pa.int32()), ("n_pieces", pa.int32()), ("start_byte", pa.int32()), ("end_byte", pa.int32())] + [("piece", pa.large_string())] * text

    def run(batches):
        for batch in batches:
            ks, no, of, a, b, t = [], [], [], [], [], []
            held = 0
            for k, n, c in zip(*(batch.column(i).to_pylist() for i in range(3))):
                data = c.encode() if c is not None and (n > max_bytes or text) else b""
                ranges = split(data, max_bytes, overlap) if n > max_bytes else [(0, n)]
                for i, (s, e) in enumerate(ranges):
                    ks.append(k), no.append(i), of.append(len(ranges)), a.append(s), b.append(e)
                    if text:
                        t.append(data[s:e].decode())
                held += len(data)
                if held > 8_000_000:
                    yield batch_of(batch, ks, no, of, a, b, t)
                    ks, no, of, a, b, t, held = [], [], [], [], [], [], 0
            if ks:
                yield batch_of(batch, ks, no, of, a, b, t)

    def batch_of(batch, ks, no, of, a, b, t):
        arrays = [pa.array(ks, batch.schema.field(0).type), *(pa.array(x, pa.int32()) for x in (no, of, a, b))] + ([pa.array(t, pa.string())] if text else [])
        return pa.RecordBatch.from_arrays(arrays, names=[f[0] for f in fields])

    schema = f"k {items.schema[key].dataType.simpleString()}, piece_no int, n_pieces int, start_byte int, end_byte int" + ", piece string" * text
    return base.mapInArrow(run, schema).withColumnRenamed("k", key)


def chunk_limits(options: DataFrame, name: str = "content") -> tuple[int, int]:
    """(max_bytes, overlap_bytes) of the named row of chunk_options, a table of fixed size."""
    rows = options.where(F.col("option_name") == name).select("max_bytes", "overlap_bytes").limit(1).collect()
    if not rows or rows[0][0] is None:
        raise ValueError(f"chunk_options has no row {name}")
    return int(rows[0][0]), int(rows[0][1] or 0)
