"""Problem 3: items that appear together, by large-basket blocking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.plans.runtime import cut


def clean_path(path):
    """A repository-relative path with ``/``, without empty or ``.`` segments."""
    return F.array_join(F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda p: (p != "") & (p != ".")), "/")


def cooccurrence(rows: DataFrame, group: str, basket: str, item: str, *, max_items: int | None = None, min_shared: int = 1, chunk: int = 32) -> DataFrame:
    """(group, item_a, item_b, baskets, count_a, count_b, shared, lift): how often two items share a basket of their group.

    item_a < item_b by code point; an item counts once a basket; lift = shared * baskets / (count_a * count_b). Baskets of
    more than ``max_items`` items are left out everywhere if that is set; with None every basket counts whole.

    Baskets are split into chunks of about ``chunk`` items by a hash of the item. A basket of one chunk gives its pairs in
    place; of a larger one, each chunk goes to its chunk pairs and each pair of chunks becomes one product in a task of
    its own, so no basket is ever gathered whole. Pair counts are combined map-side over 8-byte item numbers. Items in
    fewer than ``min_shared`` baskets cannot be in a result and are left out of the products, not out of the counts.

    Null group, basket or item: the row does not count. Empty tables give no row. Extra columns are dropped.
    """
    base = rows.select(F.col(group).alias("g"), F.col(basket).alias("b"), F.col(item).alias("i")).where("g is not null and b is not null and i is not null").distinct()
    sizes = base.groupBy("g", "b").agg(F.count(F.lit(1)).alias("size"))
    if max_items is not None:
        sizes = sizes.where(F.col("size") <= max_items)
    # rows of a basket and its size meet by (g, b): the hash partitioning of the count is reused
    kept = cut(base.join(sizes, ["g", "b"]))
    items = cut(kept.groupBy("g", "i").agg(F.count(F.lit(1)).alias("n")).withColumn("id", F.monotonically_increasing_id()))
    baskets = kept.select("g", "b").distinct().groupBy("g").agg(F.count(F.lit(1)).alias("baskets"))
    frequent = items.where(F.col("n") >= min_shared).select("g", "i", "id")
    rows2 = kept.join(frequent, ["g", "i"]).select("g", "b", "id", "size", F.greatest(F.lit(1), F.ceil(F.col("size") / chunk)).cast("int").alias("k"))
    chunks = rows2.groupBy("g", "b", "k", F.pmod(F.xxhash64("id"), F.col("k")).cast("int").alias("c")).agg(F.sort_array(F.collect_list("id")).alias("ids"))
    # within a chunk
    inner = chunks.where(F.size("ids") > 1).select("g", F.posexplode("ids").alias("p", "x"), "ids").select("g", "x", F.explode(F.expr("slice(ids, p + 2, size(ids))")).alias("y"))
    # between two chunks of one large basket
    large = chunks.where("k > 1").select("g", "b", "c", "ids", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("o")).where("o <> c")
    sides = large.select("g", "b", F.least("c", "o").alias("lo"), F.greatest("c", "o").alias("hi"), (F.col("c") < F.col("o")).alias("left"), "ids")
    pairs = sides.groupBy("g", "b", "lo", "hi").agg(F.max(F.when(F.col("left"), F.col("ids"))).alias("xs"), F.max(F.when(~F.col("left"), F.col("ids"))).alias("ys"))
    outer = pairs.where("xs is not null and ys is not null").select("g", F.explode("xs").alias("v"), "ys").select("g", "v", F.explode("ys").alias("w")).select("g", F.least("v", "w").alias("x"), F.greatest("v", "w").alias("y"))
    shared = inner.unionByName(outer).groupBy("x", "y").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= min_shared)
    left = items.select(F.col("id").alias("x"), "g", F.col("i").alias("ix"), F.col("n").alias("nx"))
    right = items.select(F.col("id").alias("y"), F.col("i").alias("iy"), F.col("n").alias("ny"))
    named = shared.join(left, "x").join(right, "y").join(baskets, "g")
    swap = F.col("ix") < F.col("iy")
    out = named.select("g", F.least("ix", "iy").alias("item_a"), F.greatest("ix", "iy").alias("item_b"), "baskets", F.when(swap, F.col("nx")).otherwise(F.col("ny")).alias("count_a"), F.when(swap, F.col("ny")).otherwise(F.col("nx")).alias("count_b"), "shared")
    return out.withColumn("lift", F.col("shared") * F.col("baskets") / (F.col("count_a") * F.col("count_b"))).withColumnRenamed("g", group)


def coupled_files(commit_files: DataFrame, *, max_files: int | None = 50, min_shared: int = 5) -> DataFrame:
    """cooccurrence() of cleaned paths in the commits of a repository; a path without segments does not count."""
    rows = commit_files.select("repo_id", "commit", clean_path(F.col("file")).alias("file")).where("file <> ''")
    return cooccurrence(rows, "repo_id", "commit", "file", max_items=max_files, min_shared=min_shared)


def found(commit_files: DataFrame) -> DataFrame:
    """(repo_id, file_a, file_b) with at least five shared commits and four times those of chance."""
    pairs = coupled_files(commit_files)
    return pairs.where(F.col("shared") * F.col("baskets") >= 4 * F.col("count_a") * F.col("count_b")).select("repo_id", F.col("item_a").alias("file_a"), F.col("item_b").alias("file_b"))
