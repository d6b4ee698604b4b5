"""PropertyGraph: typed nodes and typed, weighted edges as two DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.plans.runtime import table

NODE_BASE = "id string, label string, name string, file_path string"
EDGE_BASE = "id string, source_id string, target_id string, type string, confidence double, reason string, step int"


@dataclass(frozen=True)
class PropertyGraph:
    """``nodes`` has id, label, name, file_path and any further property columns; ``edges`` the columns of EDGE_BASE."""

    nodes: DataFrame
    edges: DataFrame

    def upsert(self, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> PropertyGraph:
        """Rows of the arguments replace those of the same id; of several given rows of one id the greatest row stays."""
        return PropertyGraph(_upsert(self.nodes, nodes), _upsert(self.edges, edges))

    def without_nodes(self, ids: DataFrame) -> PropertyGraph:
        """Remove the nodes of ``ids`` (id) and every edge at either of their ends."""
        gone = ids.select("id").distinct()
        edges = self.edges.join(gone, self.edges.source_id == gone.id, "left_anti")
        return PropertyGraph(self.nodes.join(gone, "id", "left_anti"), edges.join(gone, edges.target_id == gone.id, "left_anti"))

    def without_files(self, paths: DataFrame) -> PropertyGraph:
        """Remove the nodes of the files ``paths`` (file_path), with their edges."""
        return self.without_nodes(self.nodes.join(paths.select("file_path").distinct(), "file_path", "left_semi"))

    def without_label(self, label: str) -> PropertyGraph:
        return self.without_nodes(self.nodes.where(F.col("label") == label))

    def typed(self, *types: str) -> DataFrame:
        return self.edges.where(F.col("type").isin(*types)) if types else self.edges

    def both_ways(self, *types: str) -> DataFrame:
        """Each edge from both of its ends (a bag: a loop comes twice)."""
        e = self.typed(*types)
        back = e.select(*[F.col({"source_id": "target_id", "target_id": "source_id"}.get(c, c)).alias(c) for c in e.columns])
        return e.unionByName(back)

    def degrees(self) -> DataFrame:
        """(id, out_degree, in_degree) of every node; dangling ends count for no one."""
        out = self.edges.groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("out_degree"))
        into = self.edges.groupBy(F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))
        zero = F.lit(0).cast("long")
        return self.nodes.select("id").join(out, "id", "left").join(into, "id", "left").select("id", F.coalesce("out_degree", zero).alias("out_degree"), F.coalesce("in_degree", zero).alias("in_degree"))

    def names(self) -> DataFrame:
        """(name, id, same): the name index, a row a node, with the number of nodes of its name; a name that a third of all
        nodes bear is never gathered."""
        n = self.nodes.groupBy(F.col("name").alias("_of")).agg(F.count(F.lit(1)).alias("same"))
        return self.nodes.select("name", "id").join(n, F.col("name").eqNullSafe(F.col("_of"))).select("name", "id", "same")

    def dangling(self) -> DataFrame:
        """Edges of which an end is missing."""
        ids = self.nodes.select("id")
        a = self.edges.join(ids, self.edges.source_id == ids.id, "left_anti")
        b = self.edges.join(ids, self.edges.target_id == ids.id, "left_anti")
        return a.unionByName(b).dropDuplicates(["id"])


def _upsert(old: DataFrame, new: DataFrame | None) -> DataFrame:
    if new is None:
        return old
    latest = new.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(*[F.col(c).desc_nulls_last() for c in new.columns if c != "id"]))).where("_n = 1").drop("_n")
    return old.join(latest, "id", "left_anti").unionByName(latest, allowMissingColumns=True)


def from_star_schema(spark: SparkSession, d: str) -> PropertyGraph:
    """Regions, nations, customers, suppliers, parts and orders as nodes; their keys and the lines of orders as edges."""
    t = {n: table(spark, d, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}

    def nodes(name, label, key, title, amount=None, kind=None, path=None):
        null = F.lit(None)
        return t[name].select(F.concat(F.lit(label + ":"), F.col(key).cast("string")).alias("id"), F.lit(label).alias("label"), F.col(title).cast("string").alias("name"), F.concat(F.lit(label.lower() + "/"), F.col(path or title).cast("string")).alias("file_path"), F.col(key).cast("long").alias("key"), (F.col(amount) if amount else null).cast("double").alias("amount"), (F.col(kind) if kind else null).cast("string").alias("kind"))

    parts = [nodes("region", "Region", "r_regionkey", "r_name"), nodes("nation", "Nation", "n_nationkey", "n_name"), nodes("customer", "Customer", "c_custkey", "c_name", "c_acctbal", "c_mktsegment", "c_mktsegment"), nodes("supplier", "Supplier", "s_suppkey", "s_name", "s_acctbal"), nodes("part", "Part", "p_partkey", "p_name", "p_retailprice", "p_brand", "p_brand"), nodes("orders", "Order", "o_orderkey", "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")]
    all_nodes = parts[0]
    for p in parts[1:]:
        all_nodes = all_nodes.unionByName(p)

    def edges(df, kind, a, ka, b, kb, confidence=1.0):
        return df.select(F.concat(F.lit(a + ":"), F.col(ka).cast("string")).alias("source_id"), F.concat(F.lit(b + ":"), F.col(kb).cast("string")).alias("target_id"), F.lit(kind).alias("type"), (confidence if not isinstance(confidence, float) else F.lit(confidence)).alias("confidence"))

    conf = 1 - F.col("l_discount")
    links = edges(t["nation"], "IN_REGION", "Nation", "n_nationkey", "Region", "n_regionkey")
    for x in (edges(t["customer"], "IN_NATION", "Customer", "c_custkey", "Nation", "c_nationkey"), edges(t["supplier"], "IN_NATION", "Supplier", "s_suppkey", "Nation", "s_nationkey"), edges(t["orders"], "PLACED", "Customer", "o_custkey", "Order", "o_orderkey"), edges(t["lineitem"], "CONTAINS_PART", "Order", "l_orderkey", "Part", "l_partkey", conf), edges(t["lineitem"], "SUPPLIES", "Supplier", "l_suppkey", "Part", "l_partkey", conf)):
        links = links.unionByName(x)
    # a multi-edge's rows are told apart by place only; no operator depends on which row has which id
    ids = F.concat_ws("|", "type", "source_id", "target_id", F.monotonically_increasing_id().cast("string"))
    return PropertyGraph(all_nodes, links.select(ids.alias("id"), "source_id", "target_id", "type", "confidence", F.lit("key").alias("reason"), F.lit(None).cast("int").alias("step")))


def call_graph(spark: SparkSession, d: str) -> PropertyGraph:
    """Suppliers as functions; one calls the next if their lines follow each other in an order (with loops and multi-edges)."""
    line, sup = table(spark, d, "lineitem"), table(spark, d, "supplier")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    pairs = line.select("l_suppkey", F.lead("l_suppkey").over(w).alias("nxt")).where("nxt is not null")
    edges = pairs.select(F.concat(F.lit("Function:"), F.col("l_suppkey").cast("string")).alias("source_id"), F.concat(F.lit("Function:"), F.col("nxt").cast("string")).alias("target_id"))
    edges = edges.groupBy("source_id", "target_id").agg(F.count(F.lit(1)).alias("calls")).select(F.concat_ws("->", "source_id", "target_id").alias("id"), "source_id", "target_id", F.lit("CALLS").alias("type"), F.lit(1.0).alias("confidence"), F.concat(F.lit("n="), F.col("calls").cast("string")).alias("reason"), F.lit(None).cast("int").alias("step"))
    nodes = sup.select(F.concat(F.lit("Function:"), F.col("s_suppkey").cast("string")).alias("id"), F.lit("Function").alias("label"), F.col("s_name").alias("name"), F.concat(F.lit("src/n"), F.col("s_nationkey").cast("string"), F.lit("/f.py")).alias("file_path"), F.col("s_suppkey").alias("key"), (F.col("s_suppkey") % 7 == 0).alias("is_exported"), (F.col("s_suppkey") % 3 == 0).alias("is_traced"), (F.col("s_suppkey") % 11).cast("int").alias("complexity"))
    return PropertyGraph(nodes, edges)
