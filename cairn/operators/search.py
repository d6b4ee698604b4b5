"""Full-text, vector and fused retrieval."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.text import cosine, label_weight, path_weight, terms
from cairn.graph import PropertyGraph
from cairn.plans.runtime import salt
from cairn.schema import FTS_LABELS

K1, B, RRF_K = 1.2, 0.75, 60


@dataclass(frozen=True)
class Index:
    """postings (term, id, tf) and docs (id, len)."""

    postings: DataFrame
    docs: DataFrame


def index(docs: DataFrame, key: str, text: str) -> Index:
    """Inverted index of a text column; null texts are empty documents."""
    words = docs.select(F.col(key).alias("id"), terms(F.coalesce(F.col(text), F.lit(""))).alias("words"))
    return Index(words.select("id", F.explode("words").alias("term")).groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf")), words.select("id", F.size("words").alias("len")))


def bm25(ix: Index, query: str) -> DataFrame:
    """(id, score) of the documents with a query term; a repeated query term adds repeatedly, idf is never negative.

    Only the postings of the query's terms are read; document frequencies and the mean length are exact. The query's
    terms are few; scores need one join of the hits with the document lengths.
    """
    import re

    counts = Counter(t for t in re.split(r"[^\w]+|_", query.lower()) if t)
    if not counts:
        return ix.docs.limit(0).select("id", F.lit(0.0).alias("score"))
    spark = ix.docs.sparkSession
    q = spark.createDataFrame(sorted(counts.items()), "term string, times int")
    hits = ix.postings.where(F.col("term").isin(sorted(counts)))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    stats = ix.docs.agg(F.count(F.lit(1)).alias("n"), F.greatest(F.lit(1.0), F.avg("len")).alias("avg_len"))
    rare = q.join(df, "term").join(F.broadcast(stats)).withColumn("idf", F.greatest(F.lit(0.0), F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)))  # a row a query term
    scored = hits.join(F.broadcast(rare), "term").join(ix.docs, "id")
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return scored.groupBy("id").agg(F.sum(part).alias("score"))


def top(scored: DataFrame, limit: int, key: str = "id") -> DataFrame:
    """The best hits with their rank from 1; ties by key."""
    best = scored.orderBy(F.desc("score"), key).limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))


def node_text(nodes: DataFrame) -> DataFrame:
    extra = [F.coalesce("description", F.lit(""))] if "description" in nodes.columns else []
    return nodes.where(F.col("label").isin(*FTS_LABELS)).select("*", F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("file_path", F.lit("")), *extra).alias("_text"))


def bm25_nodes(graph: PropertyGraph, query: str, *, label: str | None = None, limit: int = 100) -> DataFrame:
    """(nodeId, score, name, filePath, label): weighted hits among the searchable labels; frequencies over all of them."""
    docs = node_text(graph.nodes)
    hits = bm25(index(docs, "id", "_text"), query).join(docs.select("id", "name", "file_path", "label"), "id")
    if label:
        hits = hits.where(F.col("label") == label)
    hits = hits.withColumn("score", F.col("score") * path_weight(F.col("file_path")) * label_weight(F.col("label")))
    return top(hits, limit).select(F.col("id").alias("nodeId"), "score", "name", F.col("file_path").alias("filePath"), "label")


def best_per_file(hits: DataFrame, limit: int) -> DataFrame:
    """The best hit of each file."""
    w = Window.partitionBy("filePath").orderBy(F.desc("score"), "nodeId")
    return hits.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").orderBy(F.desc("score"), "nodeId").limit(limit)


def knn(vectors: DataFrame, query: list[float], limit: int, *, key: str = "node_id", vector: str = "vector") -> DataFrame:
    """(id, score, rank): exact cosine search in one pass, the best kept by a bounded heap in each task."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return top(vectors.select(F.col(key).alias("id"), cosine(F.col(vector), q).alias("score")), limit)


def nearest(queries: DataFrame, rows: DataFrame, *, key: str = "vec_id", vector: str = "embedding", parts: int = 64) -> DataFrame:
    """(key, best): the greatest cosine of each query to any row of another key, exact.

    Rows are dealt to ``parts`` blocks by a hash of their key and the queries go to each block, so no group follows the
    data; the greatest of a block is taken before blocks meet. A null key does not count; a query alone gives no row.
    """
    q = queries.select(F.col(key).alias("q"), F.col(vector).alias("qv"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")).repartition(parts, "part")
    x = rows.select(F.col(key).alias("x"), F.col(vector).alias("xv"), salt(parts, key).alias("part")).repartition(parts, "part")  # by number: small blocks are not merged into one task
    return q.join(x, "part").where("q <> x").groupBy(F.col("q").alias(key)).agg(F.max(cosine(F.col("qv"), F.col("xv"))).alias("best"))


def rrf(lists: dict[str, DataFrame], limit: int) -> DataFrame:
    """(id, score, sources, rank): sum of 1 / (60 + rank) over ranked lists, ties by id."""
    all_ = None
    for name, df in lists.items():
        x = df.select("id", "rank", F.lit(name).alias("source"))
        all_ = x if all_ is None else all_.unionByName(x)
    return top(all_.groupBy("id").agg(F.sum(1.0 / (RRF_K + F.col("rank"))).alias("score"), F.array_sort(F.collect_set("source")).alias("sources")), limit)


def hybrid(text_hits: DataFrame, vector_hits: DataFrame | None, limit: int) -> DataFrame:
    """Fused list; the text list alone where there are no vectors or fewer than two text hits."""
    if vector_hits is None or len(text_hits.take(2)) < 2:
        return text_hits.select("id", "score", F.array(F.lit("bm25")).alias("sources"), "rank").limit(limit)
    return rrf({"bm25": text_hits, "semantic": vector_hits}, limit)


def with_name_fallback(hits: DataFrame, nodes: DataFrame, text: str, limit: int) -> DataFrame:
    """Hits first, then nodes whose name contains the text, each id once."""
    named = nodes.where(F.lower("name").contains(text.lower())).select("id", F.lit(0.0).alias("score"), F.lit(1).alias("tier"))
    both = hits.select("id", "score", F.lit(0).alias("tier")).unionByName(named)
    w = Window.partitionBy("id").orderBy("tier", F.desc("score"))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").orderBy("tier", F.desc("score"), "id").limit(limit).select("id", "score", "tier")


def resolve_target(nodes: DataFrame, text: str) -> DataFrame:
    """The node meant by a text: exact id, then name in any case, then part of a name; then by label priority and id."""
    low = F.lower("name")
    tier = F.when(F.col("id") == text, 0).when(low == text.lower(), 1).when(low.contains(text.lower()), 2)
    rank = F.when(F.col("label") == "Controller", 0).when(F.col("label") == "Class", 1).when(F.col("label") == "Service", 2).when(F.col("label") == "Method", 5).when(F.col("label") == "File", 8).otherwise(10)
    return nodes.withColumn("_t", tier).where("_t is not null").orderBy("_t", rank, "id").limit(1).drop("_t")


def keywords(text: str) -> list[str]:
    """Words of more than two letters without English and French stop words, in order, each once."""
    stop = set("the and for with that this from are was not what how does where which les des une est dans pour que qui sur avec pas comment quel quelle".split())
    import re

    return list(dict.fromkeys(w for w in re.split(r"\W+", text.lower()) if len(w) > 2 and w not in stop))


def rerank(hits: DataFrame, score, limit: int = 30) -> DataFrame:
    """The first ``limit`` hits in the order of ``score`` (a Column over their columns), the others behind them as they were;
    none is dropped, hits without a score come last of the first. The default of the engine is no reranking."""
    head = F.col("rank") <= limit
    order = [F.when(head, 0).otherwise(1), F.when(head, score).desc_nulls_last(), F.col("rank")]
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
