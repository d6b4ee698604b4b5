"""Problem 10: subject areas of documents by weighted terms of a multi-pattern automaton."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from functools import lru_cache
from importlib import resources

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.automaton import automaton
from cairn.plans.runtime import cut, spread

#: A subject is assigned from this share of a text's weighted mentions on where there are no ratings to calibrate on.
THRESHOLD = 0.2
#: Thresholds that agree with the ratings this nearly as well as the best count as equally good; the middle one is taken.
PLATEAU = 0.01
#: A second subject also needs this many mentions, unless it has as many as the first.
LEAST_MENTIONS = 2
#: The subject of a text in which neither a term nor a word of a subject's description occurs: what is written about
#: programs as such has the fewest terms of its own.
FALLBACK = "software"

_CODE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|`[^`\n]*`|https?://\S+|\w*[a-z0-9]_\w+|\b\w+[./]\w[\w./]*\(", re.S)
#: Names of a screen, a group or a part of a program, not subjects: "the harvest team", "module invoice".
_NAMES = re.compile(r"\bthe [\w]+ (?:team|page|service|module|screen|store)s?\b|\b(?:modul|module|équipe|team|dienst|service) [\w]+")
_ENDINGS = re.compile(r"(?:es|s|en|n|e|x)?(?!\w)")


@lru_cache(maxsize=1)
def terms() -> tuple[tuple[str, ...], tuple[str, ...], tuple[float, ...]]:
    """The curated terms, their subjects and weights."""
    words: dict[str, tuple[str, float]] = {}
    text = resources.files("cairn.llm").joinpath("subject_terms.txt").read_text(encoding="utf-8")
    for line in text.splitlines():
        if line and not line.startswith("#"):
            subject, _, listed = line.split("\t")
            for w in listed.split("; "):
                words.setdefault(fold(w.lstrip("*")), (subject, 0.5 if w.startswith("*") else 1.0))
    return tuple(words), tuple(s for s, _ in words.values()), tuple(w for _, w in words.values())


def fold(text: str) -> str:
    """Lower case, composed, hyphens and any white space as one space."""
    return " ".join(unicodedata.normalize("NFKC", text).lower().replace("’", "'").replace("-", " ").replace("­", "").split())


def _found(t: str, words: tuple[str, ...]) -> Counter:
    found = []
    for end, i in automaton(words).iter(t):
        start = end - len(words[i]) + 1
        if start and (t[start - 1].isalnum() or t[start - 1] == "_"):
            continue
        if _ENDINGS.match(t, end + 1):
            found.append((start, -len(words[i]), i))
    found.sort()
    out: Counter = Counter()
    at = 0
    for start, neg, i in found:
        if start >= at:
            out[i] += 1
            at = start - neg
    return out


def mentions(text: str, described: tuple[str, ...] = ()) -> Counter:
    """Term index -> number of mentions outside code and names; of overlapping terms the leftmost longest counts. A text
    without a term is searched for the words ``described``, whose indexes follow those of the terms."""
    t = _NAMES.sub(" ", fold(_CODE.sub(" ", text)))
    words = terms()[0]
    out = _found(t, words)
    if out or not described:
        return out
    return Counter({len(words) + i: n for i, n in _found(t, described).items()})


def described_words(described: DataFrame | None) -> tuple[tuple[str, str], ...]:
    """(word, subject) of the descriptions in the table of subjects (fixed in size): words of four letters and more that
    describe one subject only and are no term."""
    rows = described.select(F.lower(F.trim("subject")).alias("subject"), "description").where("subject is not null and description is not null").collect() if described is not None else []
    of: dict[str, set[str]] = {}
    for r in rows:
        for w in re.findall(r"\w{4,}", fold(r["description"])):
            of.setdefault(re.sub(r"(?<=\w{3})s$", "", w), set()).add(r["subject"])
    known = set(terms()[0]) | {"themselves"}
    return tuple((w, min(s)) for w, s in sorted(of.items()) if len(s) == 1 and w not in known)


def term_counts(documents: DataFrame, key: str = "doc_id", text: str = "text", described: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, hits array<struct<term int, n int>>) of every text that is not null or blank; no shuffle."""
    slim = documents.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).where(F.col("t").rlike(r"[^\s\p{Z}\p{C}]"))
    hit = pa.list_(pa.struct([("term", pa.int32()), ("n", pa.int32())]))

    def run(batches):
        for batch in batches:
            hits = [[{"term": i, "n": n} for i, n in mentions(t, described).items()] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hits, hit)], names=["k", "hits"])

    return spread(slim, "k").mapInArrow(run, f"k {documents.schema[key].dataType.simpleString()}, hits array<struct<term:int,n:int>>").withColumnRenamed("k", key)


def scores(documents: DataFrame, key: str = "doc_id", text: str = "text", described: DataFrame | None = None) -> DataFrame:
    """(doc_id, subject, n, weight, share, best, top): the weighted mentions of each subject in a text and their share of
    all, with the most mentions and the greatest share a subject has in the text.

    A mention weighs its curated weight times the term's rarity, ln(documents / documents with it), relative to the mean
    rarity of its subject's terms: rare terms say more, but a subject frequent in the corpus is not held back. The
    document frequencies are counted over all documents, one number a term; with these a text is scored in place, without a
    shuffle. The share normalises for length. A text without any term counts the words of the subjects' descriptions at half the weight, and
    one without these gets the fallback subject with a share of 1 and no mention.
    """
    words, subjects, weights = terms()
    more = described_words(described)
    counted = cut(term_counts(documents, key, text, tuple(w for w, _ in more)))
    subjects, weights = (*subjects, *(s for _, s in more)), (*weights, *(0.5 for _ in more))
    total = counted.count()
    held = {r["term"]: r["df"] for r in counted.select(F.explode("hits.term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}  # one row a term
    idf = [max(0.1, math.log((total + 1) / (held.get(i, 0) + 1))) for i in range(len(subjects))]
    all_, sums = Counter(), Counter()
    for i, s in enumerate(subjects):
        all_[s] += held.get(i, 0)
        sums[s] += idf[i] * held.get(i, 0)
    mean = {s: sums[s] / all_[s] for s in all_ if all_[s]}
    w = [c * (min(1.5, max(0.67, idf[i] / mean[s])) if s in mean else 1.0) for i, (s, c) in enumerate(zip(subjects, weights))]
    names = ["k", "subject", "n", "weight", "share", "best", "top"]

    def run(batches):
        for batch in batches:
            rows = []
            for k, hits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n, weight = Counter(), Counter()
                for h in hits:
                    n[subjects[h["term"]]] += h["n"]
                    weight[subjects[h["term"]]] += h["n"] * w[h["term"]]
                if not n:
                    rows.append((k, FALLBACK, 0, 0.0, 1.0, 0, 1.0))
                    continue
                whole, best, top = sum(weight.values()), max(n.values()), max(weight.values())
                rows += [(k, s, n[s], weight[s], weight[s] / whole, best, top / whole) for s in n]
            cols = list(zip(*rows)) if rows else [[] for _ in names]
            types = [batch.schema.field(0).type, pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    kind = documents.schema[key].dataType.simpleString()
    return counted.select(key, "hits").mapInArrow(run, f"k {kind}, subject string, n long, weight double, share double, best long, top double").withColumnRenamed("k", key)


def assign(scored: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id") -> DataFrame:
    """(doc_id, subject): every subject at or over the threshold with enough mentions, and always those with the greatest
    share of their text (all ties), so that a text of many subjects keeps at least one."""
    enough = (F.col("n") >= LEAST_MENTIONS) | (F.col("n") == F.col("best"))
    leads = F.col("share") >= F.col("top") - 1e-9  # sums of equal weights may differ in the last place
    return scored.where(leads | ((F.col("share") >= threshold) & enough)).select(key, "subject")


def found(documents: DataFrame, labels: DataFrame | None = None, described: DataFrame | None = None) -> DataFrame:
    """(doc_id, subject), at least one row for each text that is not null or blank; equal rows come once.
    The threshold is calibrated on ``labels`` (subject_labels); without them it is THRESHOLD."""
    scored = scores(documents, described=described)
    if labels is None:
        return assign(scored).distinct()
    scored = cut(scored)  # read twice
    return assign(scored, calibrate(scored, labels)).distinct()


def calibrate(scored: DataFrame, labels: DataFrame, key: str = "doc_id") -> float:
    """The threshold that agrees best (F1 of what assign() gives) with rated documents, in steps of 0.01: the middle of
    those within PLATEAU of the best, THRESHOLD without ratings. Labels are taken as the union of the raters' subjects; all
    of them count. They grow with the documents, so neither side of the joins is broadcast."""
    rated = labels.where(F.col(key).isNotNull() & F.col("subject").isNotNull()).select(key, F.lower(F.trim("subject")).alias("subject")).distinct()
    leads = F.col("share") >= F.col("top") - 1e-9
    enough = (F.col("n") >= LEAST_MENTIONS) | (F.col("n") == F.col("best"))
    least = F.when(leads, 1.0).when(enough, F.floor(F.col("share") * 100) / 100).otherwise(0.0).alias("upto")  # kept up to this threshold
    of_rated = scored.join(rated.select(key).hint("merge"), key, "left_semi")
    joined = of_rated.join(rated.withColumn("yes", F.lit(1)).hint("merge"), [key, "subject"], "left")
    both = joined.groupBy(least).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("yes", F.lit(0))).alias("yes")).collect()
    whole, f1 = rated.count(), {}
    for step in range(5, 51):
        picked = sum(r["n"] for r in both if r["upto"] >= step / 100)
        right = sum(r["yes"] for r in both if r["upto"] >= step / 100)
        f1[step] = 2 * right / (picked + whole) if picked + whole else 0.0
    top = max(f1.values())
    if not top:
        return THRESHOLD
    good = [step for step, f in f1.items() if f >= top - PLATEAU]
    return (min(good) + max(good)) / 200
