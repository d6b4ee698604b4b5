"""Analytics of change history: hotspots, coupling, ownership, changed symbols, health."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.text import clean_path


def changes(commit_files: DataFrame) -> DataFrame:
    """One row a repository, commit and cleaned path: repeated deliveries and spellings once, with the greatest counts."""
    rows = commit_files.where("repo_id is not null and commit is not null and file is not null").withColumn("path", clean_path(F.col("file"))).where("path <> ''")
    return rows.groupBy("repo_id", "commit", "path").agg(F.max("author").alias("author"), F.lower(F.max("email")).alias("email"), F.max("ts").alias("ts"), F.max(F.coalesce("added", F.lit(0))).cast("long").alias("added"), F.max(F.coalesce("removed", F.lit(0))).cast("long").alias("removed"))


def hotspots(commit_files: DataFrame, since=None) -> DataFrame:
    """(repo_id, path, commits, added, removed, churn, authors, last_ts, score), score = commits * churn over its greatest in the repository."""
    c = changes(commit_files)
    if since is not None:
        c = c.where(F.col("ts") >= F.lit(since))
    g = c.groupBy("repo_id", "path").agg(F.count(F.lit(1)).alias("commits"), F.sum("added").alias("added"), F.sum("removed").alias("removed"), F.count_distinct("email").alias("authors"), F.max("ts").alias("last_ts"))
    g = g.withColumn("churn", F.col("added") + F.col("removed"))
    most = g.groupBy("repo_id").agg(F.max(F.col("commits") * F.col("churn")).alias("most"))
    return g.join(most, "repo_id").withColumn("score", F.when(F.col("most") > 0, F.col("commits") * F.col("churn") / F.col("most")).otherwise(0.0)).drop("most")


def coupling(commit_files: DataFrame, min_shared: int = 3, max_files: int = 50) -> DataFrame:
    """(repo_id, file_a, file_b, shared, strength): strength = shared / greatest commits of either; commits of more than
    max_files files count neither above nor below the line."""
    c = changes(commit_files).select("repo_id", "commit", "path")
    fits = c.groupBy("repo_id", "commit").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= max_files).select("repo_id", "commit")
    # counted first, so that no larger commit is gathered; a basket is bounded by max_files and its pairs are made in place
    small = c.join(fits, ["repo_id", "commit"], "left_semi").groupBy("repo_id", "commit").agg(F.collect_list("path").alias("paths"))
    sorted_ = small.select("repo_id", F.array_sort("paths").alias("p"))
    per = sorted_.select("repo_id", F.explode("p").alias("f")).groupBy("repo_id", "f").agg(F.count(F.lit(1)).alias("n"))
    pairs = sorted_.select("repo_id", F.posexplode("p").alias("i", "file_a"), "p").select("repo_id", "file_a", F.explode(F.expr("slice(p, i + 2, size(p))")).alias("file_b"))
    shared = pairs.groupBy("repo_id", "file_a", "file_b").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= min_shared)
    a = per.select("repo_id", F.col("f").alias("file_a"), F.col("n").alias("na"))
    b = per.select("repo_id", F.col("f").alias("file_b"), F.col("n").alias("nb"))
    return shared.join(a, ["repo_id", "file_a"]).join(b, ["repo_id", "file_b"]).select("repo_id", "file_a", "file_b", "shared", (F.col("shared") / F.greatest("na", "nb")).alias("strength"))


def ownership(commit_files: DataFrame) -> DataFrame:
    """(repo_id, path, email, commits, pct, authors): the author of most commits of each file; ties by email."""
    c = changes(commit_files).where("email is not null").groupBy("repo_id", "path", "email").agg(F.count(F.lit(1)).alias("commits"))
    w = Window.partitionBy("repo_id", "path")
    ranked = c.withColumn("all", F.sum("commits").over(w)).withColumn("authors", F.count(F.lit(1)).over(w)).withColumn("_n", F.row_number().over(w.orderBy(F.desc("commits"), "email")))
    return ranked.where("_n = 1").select("repo_id", "path", "email", "commits", (F.col("commits") * 100.0 / F.col("all")).alias("pct"), "authors")


def changed_symbols(hunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbols whose lines meet a hunk of their file: an equi-join on the file with the overlap as residual; a null start
    is the first line, a null end the last. hunks: file, start, end; symbols: id, file_path, start_line, end_line."""
    h, s = hunks.alias("h"), symbols.alias("s")
    on = (F.col("h.file") == F.col("s.file_path")) & (F.coalesce("s.start_line", F.lit(0)) <= F.col("h.end")) & (F.col("h.start") <= F.coalesce("s.end_line", F.lit(2147483647)))
    return s.join(h, on, "left_semi")


def risk(direct, transitive, processes):
    """Column: none, low, medium or high."""
    return F.when((processes >= 2) | (transitive >= 20), "high").when((processes >= 1) | (transitive >= 5) | (direct >= 3), "medium").when(direct > 0, "low").otherwise("none")


def health(commit_files: DataFrame) -> DataFrame:
    """(repo_id, score, grade): 100 less 3 a hot file, 2 a strongly coupled pair and half a point a file without an owner."""
    hot = hotspots(commit_files).groupBy("repo_id").agg(F.sum((F.col("score") > 0.7).cast("int")).alias("hot"))
    strong = coupling(commit_files).groupBy("repo_id").agg(F.sum((F.col("strength") > 0.7).cast("int")).alias("strong"))
    loose = ownership(commit_files).groupBy("repo_id").agg(F.sum((F.col("pct") < 50).cast("int")).alias("loose"))
    zero = F.lit(0)
    j = hot.join(strong, "repo_id", "left").join(loose, "repo_id", "left")
    raw = 100.0 - 3 * F.coalesce("hot", zero) - 2 * F.coalesce("strong", zero) - 0.5 * F.coalesce("loose", zero)
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)), 1)
    whole = F.floor(score)
    return j.select("repo_id", score.alias("score"), F.when(whole >= 90, "A").when(whole >= 75, "B").when(whole >= 60, "C").when(whole >= 40, "D").otherwise("E").alias("grade"))
