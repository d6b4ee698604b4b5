"""Problem 9: sources mixed to target shares of tokens by entropy balancing."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.encoding import DEFAULT_RANKS, count_column
from cairn.plans.runtime import cut

#: Documents a rounding task takes; larger sources are rounded in several tasks.
ROUNDING_ROWS = 200_000


def _clean(source):
    return F.lower(F.trim(source))


def targets(weights: DataFrame) -> dict[str, tuple[float, int]]:
    """{source: (share, max_repeats)} of source_weights, a table with one row a named source; repeated names add up their
    shares and keep the least cap; null or non-positive shares and null names do not count; a null cap is 1."""
    out: dict[str, tuple[float, int]] = {}
    rows = weights.select(_clean(F.col("source")).alias("s"), "target_share", "max_repeats").where("s is not null and target_share > 0").collect()
    for s, share, cap in rows:
        old = out.get(s, (0.0, 10**9))
        out[s] = (old[0] + share, min(old[1], 1 if cap is None else max(0, cap)))
    return out


def solve(sizes: DataFrame, goal: dict[str, float], caps: dict[str, int], *, tol: float = 1e-7, max_iter: int = 60) -> dict[str, float]:
    """The dual variables: rate(d) = min(cap, exp(lambda_s * x_d)) with x = tokens / mean tokens of the source.

    Minimises sum of rate * log rate - rate over all documents (base rate 1: each once) under sum(rate * tokens) = goal_s
    and rate <= cap_s. The dual is convex and separable by source; each damped Newton step is one aggregation over
    ``sizes`` (s, tokens, docs, mean), of which only one row a named source comes to the driver. Fails if a source has
    not come within ``tol`` of its goal after ``max_iter`` steps.
    """
    lam = {s: 0.0 for s in goal}
    low, high = {s: -math.inf for s in goal}, {s: math.inf for s in goal}
    open_ = {s for s in goal if goal[s] > 0}
    for _ in range(max_iter):
        if not open_:
            break
        lam_of = F.create_map(*[x for s in sorted(open_) for x in (F.lit(s), F.lit(lam[s]))])
        cap_of = F.create_map(*[x for s in sorted(open_) for x in (F.lit(s), F.lit(float(caps[s])))])
        x = F.col("tokens") / F.col("mean")
        free = F.exp(F.least(F.lit(60.0), lam_of[F.col("s")] * x))
        tilted = sizes.where(F.col("s").isin(sorted(open_))).select("s", "docs", "tokens", x.alias("x"), free.alias("f"), cap_of[F.col("s")].alias("cap"))
        sums = tilted.groupBy("s").agg(F.sum(F.col("docs") * F.least("f", "cap") * F.col("tokens")).alias("v"), F.sum(F.when(F.col("f") < F.col("cap"), F.col("docs") * F.col("f") * F.col("x") * F.col("tokens")).otherwise(0.0)).alias("h")).collect()
        for s, v, h in sums:
            miss = v - goal[s]
            if abs(miss) <= tol * goal[s]:
                open_.discard(s)
                continue
            if miss > 0:
                high[s] = lam[s]
            else:
                low[s] = lam[s]
            step = lam[s] - miss / h if h > 0 else math.inf if miss < 0 else -math.inf
            if not low[s] < step < high[s]:  # outside what is known: halve, or double where there is no bound yet
                if math.isfinite(low[s]) and math.isfinite(high[s]):
                    step = (low[s] + high[s]) / 2
                else:
                    step = lam[s] + math.copysign(max(1.0, abs(lam[s])), -miss)
            lam[s] = step
    if open_:
        raise ArithmeticError(f"no solution within {max_iter} steps for {sorted(open_)}")
    return lam


def _round(cap_of: dict[str, int]):
    """Copies whose running token total follows that of the rates: each rounds so as to leave the least debt."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "doc_id"], na_position="first", ignore_index=True)
        tokens, rate = pdf["tokens"].to_numpy(float), pdf["rate"].to_numpy(float)
        cap = cap_of[pdf["source"].iloc[0]]
        copies, debt = np.zeros(len(pdf), np.int32), 0.0
        for i in range(len(pdf)):
            if tokens[i] > 0:
                debt += rate[i] * tokens[i]
                base = math.floor(rate[i])
                c = min(cap, max(base, min(base + 1, math.floor(debt / tokens[i] + 0.5))))
                copies[i] = c
                debt -= c * tokens[i]
        return pdf[["doc_id", "source", "tokens", "rate"]].assign(copies=copies)[["doc_id", "source", "tokens", "rate", "copies"]]

    return run


def mix(documents: DataFrame, weights: DataFrame, *, ranks_path: str = DEFAULT_RANKS) -> DataFrame:
    """(doc_id, source, tokens, rate, copies): how often each document of a named source enters the mix.

    Sources are compared trimmed and in lower case. The total is the largest at which every named source that has tokens
    can hold its share (shares taken relative to those sources) without using a document more than its max_repeats
    times; a named source without tokens stays at none and shares() reports it. Null, empty and unnamed documents get no
    row with copies: null text has 0 tokens and 0 copies; documents of unnamed or null sources give no row. Repeated rows
    are documents of their own. A hot source is rounded in parts of ROUNDING_ROWS by a hash of doc_id.
    """
    spark = documents.sparkSession
    goal_of = targets(weights)
    named = documents.where(_clean(F.col("source")).isin(sorted(goal_of))) if goal_of else documents.limit(0)
    slim = named.select(F.struct(F.col("doc_id"), _clean(F.col("source")).alias("source")).alias("key"), "text")
    tokens = cut(count_column(slim, "key").select(F.col("key.doc_id").alias("doc_id"), F.col("key.source").alias("source"), "tokens"))
    used = tokens.where("tokens > 0").groupBy(F.col("source").alias("s"), "tokens").agg(F.count(F.lit(1)).alias("docs"))
    totals = {r["s"]: r for r in used.groupBy("s").agg(F.sum(F.col("docs") * F.col("tokens")).alias("tokens"), F.sum("docs").alias("docs")).collect()}
    able = {s for s, (share, cap) in goal_of.items() if s in totals and cap > 0}
    out = "doc_id " + documents.schema["doc_id"].dataType.simpleString() + ", source string, tokens int, rate double, copies int"
    if not able:
        return tokens.select("doc_id", "source", "tokens", F.lit(0.0).alias("rate"), F.lit(0).alias("copies"))
    whole = sum(goal_of[s][0] for s in able)
    total = min(goal_of[s][1] * totals[s]["tokens"] / (goal_of[s][0] / whole) for s in able)
    goal = {s: total * goal_of[s][0] / whole for s in able}
    mean = F.create_map(*[x for s in sorted(able) for x in (F.lit(s), F.lit(totals[s]["tokens"] / totals[s]["docs"]))])
    caps = {s: goal_of[s][1] for s in goal_of}
    full = {s for s in able if goal[s] >= caps[s] * totals[s]["tokens"] * (1 - 1e-12)}
    sizes = cut(used.where(F.col("s").isin(sorted(able))).withColumn("mean", mean[F.col("s")]))
    lam = solve(sizes, {s: goal[s] for s in able - full}, caps)
    lam_of = F.create_map(*[x for s in sorted(able) for x in (F.lit(s), F.lit(lam.get(s, 60.0)))])
    cap_of = F.create_map(*[x for s in sorted(caps) for x in (F.lit(s), F.lit(float(caps[s])))])
    src = F.col("source")
    tilted = F.least(cap_of[src], F.exp(F.least(F.lit(60.0), lam_of[src] * F.col("tokens") / mean[src])))
    rate = F.when(src.isin(sorted(full)), cap_of[src]).when(src.isin(sorted(able)) & (F.col("tokens") > 0), tilted).otherwise(0.0)
    rated = tokens.withColumn("rate", F.when(F.col("tokens") > 0, rate).otherwise(0.0)).withColumn("h", F.xxhash64("doc_id"))
    parts = F.create_map(*[x for s in sorted(goal_of) for x in (F.lit(s), F.lit(max(1, math.ceil(totals[s]["docs"] / ROUNDING_ROWS)) if s in totals else 1))])
    return rated.withColumn("part", F.pmod(F.col("h"), parts[src])).groupBy("source", "part").applyInPandas(_round(caps), out)


def shares(mixed: DataFrame, weights: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, docs_used, copies, max_copies, tokens): a row a named source, also those without documents."""
    got = mixed.groupBy("source").agg(F.sum(F.col("copies") * F.col("tokens")).cast("long").alias("tokens"), F.sum((F.col("copies") > 0).cast("long")).alias("docs_used"), F.sum("copies").cast("long").alias("copies"), F.max("copies").alias("max_copies"))
    goal = weights.select(_clean(F.col("source")).alias("source"), "target_share").where("source is not null and target_share > 0").groupBy("source").agg(F.sum("target_share").alias("target_share"))
    total = got.agg(F.sum("tokens").alias("total"))
    joined = goal.join(got, "source", "left").join(F.broadcast(total))  # one row by construction
    return joined.select("source", "target_share", F.when(F.col("total") > 0, F.coalesce("tokens", F.lit(0)) / F.col("total")).otherwise(0.0).alias("actual_share"), F.coalesce("docs_used", F.lit(0)).alias("docs_used"), F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("max_copies", F.lit(0)).alias("max_copies"), F.coalesce("tokens", F.lit(0)).alias("tokens"))
