"""Problem 1: long exact spans shared between records, by level-wise doubling of repeated windows.

Level 0 looks at half of ``min_tokens`` and at one window in about twelve: of the windows of half the length inside each
stretch of ``min_tokens``, the one of the least print. Equal stretches choose equal windows, so a stretch whose choice is
not repeated is not repeated either. Each further level doubles the length and looks only where the level before found
repeats. Between levels there is one row a record, the intervals of window starts still alive.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.plans.runtime import cut, is_empty, spread

#: Primes below 2^31 and one base for each; a print is the value of the window as a polynomial modulo all four.
_PRIMES = tuple(np.uint64(p) for p in (2147483647, 2147483629, 2147483587, 2147483579))
_BASES = (1103515245, 1812433253, 1664525013, 1566083941)

_IVS = "array<struct<lo:int,hi:int>>"


def _powers(base: int, prime: np.uint64, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo prime, doubled up."""
    out = np.ones(max(n, 1), np.uint64)
    have, step = 1, base % int(prime)
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(step) % prime
        have += more
        step = step * step % int(prime)
    return out


class Prints:
    """Prints of windows of a flat run of tokens; equal windows have equal prints wherever they stand."""

    def __init__(self, tokens: pa.Array, primes: int):
        values = tokens.dictionary_encode()
        marks = [b"\x00" if t is None else b"\x01" + t.encode("utf-8", "surrogatepass") for t in values.dictionary.to_pylist()] + [b"\x00"]
        known = [xxhash.xxh3_128_intdigest(m) for m in marks]
        at = values.indices.fill_null(len(marks) - 1).to_numpy(zero_copy_only=False)
        n = len(at)
        self.sums, self.down = [], []
        for i in range(primes):
            p, b = _PRIMES[i], _BASES[i]
            codes = np.array([(k >> (64 * (i // 2))) % (1 << 64) % int(p) for k in known], np.uint64)[at]
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(codes * _powers(b, p, n) % p)]))
            self.down.append(_powers(pow(b, -1, int(p)), p, n))

    def of(self, starts: np.ndarray, length: int) -> list[np.ndarray]:
        """One 62-bit integer for each two primes."""
        parts = [(s[starts + length] - s[starts]) % p * d[starts] % p for s, d, p in zip(self.sums, self.down, _PRIMES)]
        return [(a << np.uint64(31) | b).view(np.int64) for a, b in zip(parts[::2], parts[1::2])]


def window_prints(tokens: list[str | None], length: int) -> tuple[np.ndarray, np.ndarray]:
    """The two prints of each window of ``length`` tokens; a null token is a token of its own."""
    a, b = Prints(pa.array(tokens, pa.string()), 4).of(np.arange(max(0, len(tokens) - length + 1)), length)
    return a, b


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """First position and length of each row's tokens, and all tokens in one run."""
    tokens = batch.column(batch.schema.get_field_index("tokens"))
    ends = tokens.offsets.to_numpy()
    return ends[:-1] - ends[0], np.diff(ends), tokens.flatten()


def _batch_parts(batch: pa.RecordBatch, most: int = 200_000):
    """Slices of a batch of about ``most`` tokens; a longer row is a slice of its own."""
    start, length, _ = _flat(batch)
    ends, at = start + length, 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, start[at] + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def _seeds(length: int, min_tokens: int):
    """For each stretch of ``min_tokens``, the leftmost window of ``length`` of least print in it: one row for the
    stretches, next to each other, that choose the same window."""
    width = min_tokens - length + 1
    names = ["run", "h", "member", "lo", "hi"]

    def run(batches):
        for whole in batches:
            for batch in _batch_parts(whole):
                first, count, flat = _flat(batch)
                n = len(flat)
                h = Prints(flat, 2).of(np.arange(n - length + 1), length)[0]
                order = h.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)  # so that no token is preferred
                chosen = np.arange(n - min_tokens + 1)
                if width > 1:
                    chosen = chosen + np.lib.stride_tricks.sliding_window_view(order, width).argmin(axis=1)
                row = np.repeat(np.arange(len(first)), count - min_tokens + 1)
                starts = np.arange(len(row)) - np.repeat(np.cumsum(count - min_tokens + 1) - (count - min_tokens + 1), count - min_tokens + 1)
                pick = chosen[first[row] + starts]
                fresh = np.flatnonzero(np.r_[True, (pick[1:] != pick[:-1]) | (row[1:] != row[:-1])])
                last = np.r_[fresh[1:], len(row)] - 1
                rows = pa.array(row[fresh])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array(h[pick[fresh]]), batch.column(1).take(rows), pa.array(starts[fresh].astype(np.int32)), pa.array(starts[last].astype(np.int32))], names=names)

    return run


def _windows(length: int):
    """A row (run, g1, g2, member, pos) for each window of ``length`` that starts in one of its row's intervals."""
    names = ["run", "g1", "g2", "member", "pos"]

    def run(batches):
        for whole in batches:
            for batch in _batch_parts(whole):
                first, count, flat = _flat(batch)
                ivs = batch.column(batch.schema.get_field_index("ivs"))
                held = np.repeat(np.arange(batch.num_rows), np.diff(ivs.offsets.to_numpy()))
                lo, hi = (ivs.flatten().field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("lo", "hi"))
                edge = np.zeros(len(flat) + 1, np.int32)  # starts inside an interval, each once
                hi = np.minimum(hi, count[held] - length)
                ok = hi >= lo
                np.add.at(edge, first[held[ok]] + lo[ok], 1)
                np.add.at(edge, first[held[ok]] + hi[ok] + 1, -1)
                at = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
                if not len(at):
                    continue
                row = np.searchsorted(first, at, "right") - 1
                g1, g2 = Prints(flat, 4).of(at, length)
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array(g1), pa.array(g2), batch.column(1).take(rows), pa.array((at - first[row]).astype(np.int32))], names=names)

    return run


def _merge(reach: int):
    """(run, member, at) to (run, member, ivs): sorted positions, joined where the next is at most ``reach`` further on."""

    def run(batches):
        for batch in batches:
            out = []
            for at in batch.column(2):
                p = np.unique(at.values.to_numpy())
                breaks = np.flatnonzero(np.diff(p) > reach)
                out.append([{"lo": a, "hi": b} for a, b in zip(p[np.r_[0, breaks + 1]].tolist(), p[np.r_[breaks, len(p) - 1]].tolist())])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))], names=["run", "member", "ivs"])

    return run


def _repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key occurs in two members of a run.

    The keys are aggregated map-side to (least, greatest member), so a window held by a third of all rows moves once a
    task; the way back is a semi join whose right side has one row a key, which AQE may split on the left.
    """
    held = rows.groupBy(*keys).agg(F.min("member").alias("least"), F.max("member").alias("greatest")).where("least < greatest").select(*keys)
    return rows.join(held, keys, "left_semi")


def _alive(windows: DataFrame) -> DataFrame:
    """(run, member, ivs) of windows: the runs of consecutive starts; as many as a record's own length at most."""
    return windows.groupBy("run", "member").agg(F.collect_list("pos").alias("at")).mapInArrow(_merge(1), f"run long, member long, ivs {_IVS}")


def _rows(members: DataFrame, min_tokens: int, run: str, member: str, tokens: str) -> DataFrame:
    rows = members.select(F.col(run).cast("long").alias("run"), F.col(member).cast("long").alias("member"), F.col(tokens).alias("tokens"))
    return spread(rows.where(F.col("run").isNotNull() & F.col("member").isNotNull() & (F.size("tokens") >= min_tokens)), "member")


def levels(members: DataFrame, min_tokens: int, *, run: str = "run_id", member: str = "member_id", tokens: str = "tokens", longest: bool = True):
    """Yields (length, alive) a level from ``min_tokens`` on: alive is (run, member, ivs), the intervals of starts whose
    windows of that length occur verbatim in another member of the run; the last level is the last with any.
    ``longest=False`` ends once the length has reached ``min_tokens``, which fixes the shared positions.

    Equality is that of polynomials modulo four primes near 2^31 over 128-bit token hashes: two different windows of n
    tokens agree with a chance of about (n / 2^31)^4, 10^-28 at 200 tokens. Null or short ``tokens``, a null run or a
    null member give no window; a null token equals only a null token; repeated rows of one member count as that member.
    """
    if min_tokens < 1:
        raise ValueError("min_tokens must be positive")
    rows = _rows(members, min_tokens, run, member, tokens)
    half = max(1, min_tokens // 2)
    seeds = rows.mapInArrow(_seeds(half, min_tokens), "run long, h long, member long, lo int, hi int")
    alive = _repeated(seeds, ["run", "h"]).groupBy("run", "member").agg(F.collect_list(F.struct("lo", "hi")).alias("ivs"))
    length = min_tokens
    while True:
        windows = rows.join(cut(alive), ["run", "member"]).select("run", "member", "tokens", "ivs").mapInArrow(_windows(length), "run long, g1 long, g2 long, member long, pos int")
        alive = _alive(_repeated(windows, ["run", "g1", "g2"]))
        if not longest:
            yield length, alive
            return
        alive = cut(alive)
        if length > min_tokens and is_empty(alive):
            return
        yield length, alive
        # a window of twice the length is alive where both its halves were
        shorter = F.transform("ivs", lambda x: F.struct(x["lo"].alias("lo"), (x["hi"] - F.lit(length)).alias("hi")))
        alive = alive.select("run", "member", F.filter(shorter, lambda x: x["hi"] >= x["lo"]).alias("ivs")).where(F.size("ivs") > 0)
        length *= 2


def repeated_windows(members: DataFrame, min_tokens: int, **names) -> DataFrame:
    """(run, member, pos, length): each window of ``min_tokens * 2^k`` tokens that occurs verbatim in another member."""
    result = None
    for length, alive in levels(members, min_tokens, **names):
        one = alive.select("run", "member", F.explode("ivs").alias("x")).select("run", "member", F.explode(F.sequence("x.lo", "x.hi")).alias("pos"), F.lit(length).alias("length"))
        result = one if result is None else result.unionByName(one)
    return result


def _spans(alive: DataFrame, min_tokens: int) -> DataFrame:
    """(member, span_start, span_end) of the intervals of window starts; a window reaches min_tokens further."""
    each = alive.select("member", F.explode("ivs").alias("x")).groupBy("member").agg(F.sort_array(F.collect_list("x")).alias("ivs"))
    # in order of their starts, an interval goes on with the one before it unless a gap lies between
    gap = lambda x, i: (i == 0) | (x["lo"] > F.element_at(F.col("ivs"), F.greatest(i, F.lit(1)).cast("int"))["hi"] + F.lit(min_tokens))
    firsts = F.filter(F.transform("ivs", lambda x, i: F.when(gap(x, i), i)), lambda i: i.isNotNull())
    last = lambda f, j: F.coalesce(F.try_element_at(F.col("firsts"), (j + 2).cast("int")), F.size("ivs")).cast("int")
    span = F.transform("firsts", lambda f, j: F.struct(F.element_at(F.col("ivs"), (f + 1).cast("int"))["lo"].alias("a"), (F.element_at(F.col("ivs"), last(f, j))["hi"] + F.lit(min_tokens)).alias("b")))
    return each.withColumn("firsts", firsts).select("member", F.explode(span).alias("s")).select("member", F.col("s.a").alias("span_start"), F.col("s.b").alias("span_end"))


def shared_spans(members: DataFrame, min_tokens: int, **names) -> DataFrame:
    """(member_id, span_start, span_end): maximal runs of shared positions, span_end after the last.

    A position is shared if and only if a window of ``min_tokens`` over it is, so the levels end at that length.
    """
    [(_, alive)] = levels(members, min_tokens, longest=False, **names)
    return _spans(alive, min_tokens).select(F.col("member").alias("member_id"), F.col("span_start").cast("int"), F.col("span_end").cast("int"))


def shared_report(members: DataFrame, min_tokens: int) -> DataFrame:
    """(member_id, n_tokens, shared_tokens, shared_ratio, longest_level): how much of each member occurs elsewhere in its run.

    longest_level is the longest doubled window length that is shared, 0 where none is. Null tokens count as none.
    """
    longest, covered = None, None
    for length, alive in levels(members, min_tokens):
        if covered is None:
            covered = _spans(alive, min_tokens).groupBy("member").agg(F.sum(F.col("span_end") - F.col("span_start")).cast("long").alias("shared_tokens"))
        one = alive.select("member", F.lit(length).alias("longest_level"))
        longest = one if longest is None else longest.unionByName(one)
    longest = longest.groupBy("member").agg(F.max("longest_level").alias("longest_level"))
    base = members.select(F.col("member_id").cast("long").alias("member"), F.coalesce(F.size("tokens"), F.lit(0)).alias("n_tokens")).where("member is not null").groupBy("member").agg(F.max(F.greatest("n_tokens", F.lit(0))).cast("long").alias("n_tokens"))
    out = base.join(covered, "member", "left").join(longest, "member", "left")
    shared = F.coalesce("shared_tokens", F.lit(0))
    ratio = F.when(F.col("n_tokens") > 0, F.round(shared / F.col("n_tokens"), 6)).otherwise(0.0)
    return out.select(F.col("member").alias("member_id"), "n_tokens", shared.alias("shared_tokens"), ratio.alias("shared_ratio"), F.coalesce("longest_level", F.lit(0)).alias("longest_level"))


def strict_min_tokens(options: DataFrame) -> int:
    """min_tokens of the row ``strict``; the options table is fixed in size."""
    rows = options.where("option_name = 'strict'").select("min_tokens").limit(1).collect()
    if not rows or rows[0][0] is None:
        raise ValueError("clone_options has no row strict")
    return int(rows[0][0])
