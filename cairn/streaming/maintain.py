"""Incremental maintenance of a graph by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.graph import PropertyGraph
from cairn.sources import snapshot


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): added, modified (another hash) and removed files."""
    a, b = old.select("path", F.col("hash").alias("h0")), new.select("path", F.col("hash").alias("h1"))
    kind = F.when(F.col("h0").isNull(), "added").when(F.col("h1").isNull(), "removed").when(F.col("h0") != F.col("h1"), "modified")
    return a.join(b, "path", "full_outer").select("path", kind.alias("change")).where("change is not null")


def apply_changes(graph: PropertyGraph, files: DataFrame, extract: Callable[[DataFrame], PropertyGraph]) -> PropertyGraph:
    """Drop what came from the files (path, content; null content: removed) and add what they hold now; the last row of a path counts."""
    order = [F.desc("seq")] if "seq" in files.columns else [F.desc_nulls_last("content")]
    last = files.withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy(*order))).where("_n = 1").drop("_n")
    kept = graph.without_files(last.select(F.col("path").alias("file_path")))
    fresh = extract(last.where("content is not null"))
    return kept.upsert(fresh.nodes, fresh.edges)


def watch(spark: SparkSession, source: DataFrame, path: str, extract: Callable[[DataFrame], PropertyGraph], checkpoint: str, **trigger):
    """Start a query that folds each micro-batch of changed files into the snapshot at ``path``.

    A batch writes version ``v<batch>`` from its predecessor and moves the pointer last; a repeated batch writes the same
    version again, so a restart neither loses nor doubles a change.
    """

    def fold(batch: DataFrame, n: int) -> None:
        s = batch.sparkSession
        try:
            current = s.read.json(f"{path}/current").first()[0]
        except Exception:  # no snapshot yet
            current = None
        base = f"v{n - 1}" if current == f"v{n}" and n else current
        if base is None:
            graph = extract(batch.where("content is not null"))
        else:
            graph = apply_changes(snapshot.load(s, path, base), batch, extract)
        snapshot.save(graph, path, f"v{n}")

    return source.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "500 milliseconds"})).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) of a stream or a table in tumbling windows, late rows up to ``late``."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark("ts", late)
    return e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
