"""Graphs and vectors to and from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.graph import PropertyGraph


def save(graph: PropertyGraph, path: str, version: str) -> None:
    """A versioned snapshot: parquet, nodes by label and edges by type, so that scans of one label read only its files.
    The pointer is written last; a reader sees the whole old or the whole new version."""
    graph.nodes.write.mode("overwrite").partitionBy("label").parquet(f"{path}/{version}/nodes")
    graph.edges.write.mode("overwrite").partitionBy("type").parquet(f"{path}/{version}/edges")
    spark = graph.nodes.sparkSession
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").json(f"{path}/current")


def load(spark: SparkSession, path: str, version: str | None = None) -> PropertyGraph:
    if version is None:
        version = spark.read.json(f"{path}/current").first()[0]
    return PropertyGraph(spark.read.parquet(f"{path}/{version}/nodes"), spark.read.parquet(f"{path}/{version}/edges"))


def write_csv(graph: PropertyGraph, path: str) -> None:
    """CSV with a header, a folder a label, and one of relations with confidence to four places; control characters go."""
    clean = lambda c: F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    graph.nodes.select("id", clean("name").alias("name"), clean("file_path").alias("file_path"), "label").write.mode("overwrite").partitionBy("label").option("header", True).csv(f"{path}/nodes")
    graph.edges.select(F.col("source_id").alias("from"), F.col("target_id").alias("to"), "type", F.round("confidence", 4).alias("confidence"), "reason", "step").write.mode("overwrite").option("header", True).csv(f"{path}/CodeRelation")


def read_csv(spark: SparkSession, path: str) -> PropertyGraph:
    nodes = spark.read.option("header", True).schema("id string, name string, file_path string, label string").csv(f"{path}/nodes")
    e = spark.read.option("header", True).schema("`from` string, `to` string, type string, confidence double, reason string, step int").csv(f"{path}/CodeRelation")
    return PropertyGraph(nodes.select("id", "label", "name", "file_path"), e.select(F.concat_ws("|", "type", "from", "to", F.monotonically_increasing_id().cast("string")).alias("id"), F.col("from").alias("source_id"), F.col("to").alias("target_id"), "type", "confidence", "reason", "step"))


def dot_lines(graph: PropertyGraph) -> DataFrame:
    """(line): the statements of a digraph text."""
    quote = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, '"', '\\\\"'), F.lit('"'))
    return graph.nodes.select(F.concat(quote(F.col("id")), F.lit(" [label="), quote(F.coalesce("name", "id")), F.lit("];")).alias("line")).unionByName(graph.edges.select(F.concat(quote(F.col("source_id")), F.lit(" -> "), quote(F.col("target_id")), F.lit(" [label="), quote(F.col("type")), F.lit("];")).alias("line")))


def walk(spark: SparkSession, root: str, max_bytes: int = 2 * 1024 * 1024, skip: tuple[str, ...] = ("obj", "bin", "node_modules", "packages", ".nuget")) -> DataFrame:
    """(path, size, content) of the text files under a folder, without skipped folders and files over max_bytes."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    folders = F.array(*[F.lit(s) for s in skip])
    return raw.where((F.col("length") <= max_bytes) & ~F.arrays_overlap(F.split("path", "/"), folders)).select("path", F.col("length").alias("size"), F.decode("content", "UTF-8").alias("content"))


def check_vectors(vectors: DataFrame, dim: int, vector: str = "vector") -> DataFrame:
    """The rows, failing on one of another length than ``dim``."""
    return vectors.where(F.assert_true(F.size(vector) == dim, f"a vector is not of length {dim}").isNull())
