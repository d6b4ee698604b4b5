"""Problem 2: percentiles of very large numeric columns by merging centroid digests, with certified rank error."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.plans.runtime import cut

#: Points a task may hold before it compresses them; bounds its memory, not the result.
BUFFER_POINTS = 400_000


def cluster(group: np.ndarray, mean: np.ndarray, weight: np.ndarray, lo: np.ndarray, hi: np.ndarray, delta: float):
    """Cluster points sorted by (group, mean): one cluster per unit of k(q) = delta/(2 pi) asin(2q - 1), of all groups at once."""
    n = len(group)
    fresh = np.empty(n, bool)
    fresh[0] = True
    fresh[1:] = group[1:] != group[:-1]
    first = np.flatnonzero(fresh)
    total = np.add.reduceat(weight, first)
    size = np.diff(np.append(first, n))
    before = np.cumsum(weight) - weight
    before -= np.repeat(before[first], size)
    q = np.clip((before + weight / 2) / np.repeat(total, size), 0, 1)
    k = np.floor(delta / (2 * np.pi) * (np.arcsin(2 * q - 1) + np.pi / 2))
    cut_at = fresh.copy()
    cut_at[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(cut_at)
    w = np.add.reduceat(weight, at)
    return at, np.add.reduceat(mean * weight, at) / w, w, np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)


def _compress(pdf: pd.DataFrame, keys: list[str], delta: float) -> pd.DataFrame:
    pdf = pdf.sort_values([*keys, "mean"], kind="stable", na_position="first", ignore_index=True)
    group = pdf.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
    at, mean, weight, lo, hi = cluster(group, *(pdf[c].to_numpy(float) for c in ("mean", "weight", "lo", "hi")), delta)
    return pdf.iloc[at][keys].assign(mean=mean, weight=weight, lo=lo, hi=hi)


def _partial(keys: list[str], delta: float):
    def run(batches):
        held, n = [], 0
        for pdf in batches:
            held.append(pdf)
            n += len(pdf)
            if n >= BUFFER_POINTS:
                held = [_compress(pd.concat(held, ignore_index=True), keys, delta)]
                n = len(held[0])
                if n > BUFFER_POINTS // 2:  # more groups than fit: hand them on
                    yield held[0]
                    held, n = [], 0
        if n:
            yield _compress(pd.concat(held, ignore_index=True), keys, delta)

    return run


def _whole(keys: list[str], delta: float):
    """Re-cluster rows sorted by group; the last group of a batch waits for the next batch."""

    def run(batches):
        rest = None
        for pdf in batches:
            if rest is not None:
                pdf = pd.concat([rest, pdf], ignore_index=True)
            if not len(pdf):
                continue
            last = pdf[keys].iloc[-1]
            same = np.ones(len(pdf), bool)
            for c in keys:
                same &= (pdf[c].isna() if pd.isna(last[c]) else (pdf[c] == last[c])).to_numpy(bool)
            rest, done = pdf[same], pdf[~same]
            if len(rest) > BUFFER_POINTS:
                rest = _compress(rest, keys, delta)
            if len(done):
                yield _compress(done, keys, delta)
        if rest is not None and len(rest):
            yield _compress(rest, keys, delta)

    return run


def _schema(df: DataFrame, keys: list[str]) -> T.StructType:
    return T.StructType([df.schema[k] for k in keys] + [T.StructField(c, T.DoubleType()) for c in ("mean", "weight", "lo", "hi")])


def merge(digests: DataFrame, keys: list[str], delta: float = 400.0) -> DataFrame:
    """One digest per group of ``keys`` from centroid rows (keys, mean, weight, lo, hi) of any number of partial digests.

    Works alike on digests of days, partitions or loads. Each task first re-clusters what it holds, so the group that
    has a third of all rows reaches the final task as at most ``delta`` centroids from each task.
    """
    rows = digests.select(*keys, "mean", "weight", "lo", "hi")
    schema = _schema(rows, keys)
    part = rows.mapInPandas(_partial(keys, delta), schema)
    return part.repartition(*keys).sortWithinPartitions(*keys, "mean").mapInPandas(_whole(keys, delta), schema)


def value_counts(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, weight) without null or not-a-number values; a hot group is spread over its values."""
    v = F.col(value).cast("double")
    return rows.where(v.isNotNull() & ~F.isnan(v)).groupBy(*keys, v.alias("value")).agg(F.count(F.lit(1)).cast("double").alias("weight"))


def digest(counts: DataFrame, keys: list[str], delta: float = 400.0) -> DataFrame:
    """Digest of each group of value_counts(); see merge()."""
    return merge(counts.select(*keys, F.col("value").alias("mean"), "weight", F.col("value").alias("lo"), F.col("value").alias("hi")), keys, delta)


def quantiles(digests: DataFrame, keys: list[str], qs: list[float]) -> DataFrame:
    """(keys, n, q, estimate) by interpolation between centroid centres, kept within the centroids' own ranges."""
    schema = T.StructType([digests.schema[k] for k in keys] + [T.StructField(c, T.DoubleType()) for c in ("n", "q", "estimate")])

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        group = pdf.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        head = pdf.iloc[first][keys].reset_index(drop=True)
        mean, weight, lo, hi = (pdf[c].to_numpy(float) for c in ("mean", "weight", "lo", "hi"))
        ends = np.append(first[1:], len(pdf))
        size = ends - first
        run = np.cumsum(weight)
        before = run - weight
        base = np.repeat(before[first], size)
        right = run - base  # weight up to and with each centroid
        total = right[ends - 1]
        for q in qs:
            want = np.repeat(q * total, size)
            hit = np.flatnonzero(right >= want - 1e-9)
            # the first hit of each group
            g = np.repeat(np.arange(len(first)), size)[hit]
            at = hit[np.flatnonzero(np.append(True, g[1:] != g[:-1]))]
            inside = np.clip((want[at] - (right[at] - weight[at])) / weight[at], 0, 1)
            # two straight parts: lo to mean over the first half of the weight, mean to hi over the second
            est = np.where(inside <= 0.5, lo[at] + (mean[at] - lo[at]) * inside * 2, mean[at] + (hi[at] - mean[at]) * (inside - 0.5) * 2)
            out.append(head.assign(n=total, q=q, estimate=est))
        return pd.concat(out, ignore_index=True)

    def run(batches):
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if not len(pdf):
                continue
            group = pdf.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
            rest, done = pdf[group == group[-1]], pdf[group != group[-1]]
            if len(done):
                yield answer(done)
        if rest is not None and len(rest):
            yield answer(rest)

    return digests.mapInPandas(run, schema)  # merge() leaves each group whole and sorted in one partition


def certify(estimates: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """Second counting pass: adds n_counted, below, at_most and rank_error = distance of q*n from [below, at_most], over n.

    The counts are already reduced to distinct values; their join with the estimates is by group, and AQE may split the
    counts' side of a hot group, since the sums are taken over (group, q).
    """
    pairs = estimates.alias("e").join(counts.select(*[F.col(k).alias(f"c_{k}") for k in keys], "value", "weight").alias("c"), [F.col(f"e.{k}").eqNullSafe(F.col(f"c_{k}")) for k in keys])
    sums = pairs.groupBy(*[F.col(f"e.{k}").alias(k) for k in keys], "e.q").agg(F.first("e.estimate").alias("estimate"), F.sum("weight").alias("n_counted"), F.sum(F.when(F.col("value") < F.col("estimate"), F.col("weight")).otherwise(0.0)).alias("below"), F.sum(F.when(F.col("value") <= F.col("estimate"), F.col("weight")).otherwise(0.0)).alias("at_most"))
    want = F.col("q") * F.col("n_counted")
    return sums.withColumn("rank_error", F.greatest(F.lit(0.0), F.col("below") - want, want - F.col("at_most")) / F.col("n_counted"))


def error_bound(q: float, delta: float = 400.0, merges: int = 3) -> float:
    """The stated rank error: the greatest share of weight a centroid at q can hold, once for each round of clustering."""
    return merges * 2 * np.pi / delta * max(np.sqrt(q * (1 - q)), np.pi / delta)


def module_of(path):
    """The first path segment and, where it has no dot, the second; ``(root)`` for an empty path, null for null."""
    parts = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda p: p != "")
    second = F.try_element_at(parts, F.lit(2))
    module = F.when(second.isNotNull() & ~F.contains(second, F.lit(".")), F.concat_ws("/", parts[0], second)).otherwise(F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit("(root)")))
    return F.when(path.isNotNull(), module)


def symbol_percentiles(symbols: DataFrame, qs: list[float] | None = None, delta: float = 400.0) -> DataFrame:
    """(level, repo_id, module, day, q, n, avg, estimate, rank_error) of complexity per day, per module and per repository.

    Day digests are built once; those of modules and of repositories are merged from them, none is built from rows again.
    A repeated delivery (same run, repository, symbol, time, path and value) counts once; null and non-positive values do
    not count. Null repo_id, path or time form groups of their own (the null group). An empty table gives no row.
    """
    qs = qs or [0.5, 0.9, 0.99]
    keys = ["repo_id", "module", "day"]
    clean = symbols.where(F.col("complexity") >= 1).select("run_id", "repo_id", "node_id", "file_path", "measured_at", "complexity").distinct()
    counts = cut(value_counts(clean.select("repo_id", module_of(F.col("file_path")).alias("module"), F.to_date("measured_at").alias("day"), "complexity"), keys, "complexity"))
    days = cut(digest(counts, keys, delta))
    parts = []
    for level, own in (("day", keys), ("module", keys[:2]), ("repo", keys[:1])):
        merged = merge(days, own, delta)  # for the days themselves a no-op but for the order
        found = quantiles(merged, own, qs)
        own_counts = counts if level == "day" else counts.groupBy(*own, "value").agg(F.sum("weight").alias("weight"))
        sure = certify(found, own_counts, own)
        avg = own_counts.groupBy(*[F.col(k).alias(f"a_{k}") for k in own]).agg((F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).alias("avg"))
        joined = sure.join(avg, [sure[k].eqNullSafe(avg[f"a_{k}"]) for k in own])
        parts.append(joined.select(F.lit(level).alias("level"), "repo_id", (F.col("module") if "module" in own else F.lit(None).cast("string")).alias("module"), (F.col("day") if "day" in own else F.lit(None).cast("date")).alias("day"), "q", F.col("n_counted").cast("long").alias("n"), F.round("avg", 6).alias("avg"), "estimate", "rank_error"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
