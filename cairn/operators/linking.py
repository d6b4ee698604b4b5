"""Edges from references that a parser found: call targets, heritage, and the repair of edges without a source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.graph import PropertyGraph
from cairn.operators.extract import resolve_names

# Kinds of heritage that make an IMPLEMENTS edge.
IMPLEMENTING = ("implements", "heritage.implements", "trait", "heritage.trait", "uses")


def call_targets(calls: DataFrame, candidates: DataFrame) -> DataFrame:
    """(call_id, id): of a call's candidates in their order the first whose parameters take its arguments, else the first.

    calls: call_id, argc (null where unknown); candidates: call_id, id, pos, required, params (null counts as 0). A call
    without candidates has no row; ties of pos go by id.
    """
    j = calls.select("call_id", "argc").distinct().join(candidates, "call_id")
    takes = F.col("argc").between(F.coalesce("required", F.lit(0)), F.coalesce("params", F.lit(0)))
    best = F.min_by("id", F.struct(F.when(takes, 0).otherwise(1).alias("misses"), "pos", F.col("id").alias("tie")))
    return j.groupBy("call_id").agg(best.alias("id"))


def heritage(refs: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """Edges (id, source_id, target_id, type, confidence, reason) from classes to their parents.

    refs: file, class_name, parent_name, kind, iface (whether the language's interface names fit the parent, null for no).
    Both names are resolved by the tiers of resolve_names; a reference of which one is unknown gives no edge, a repeated
    edge is kept once, of the least reason.
    """
    names = refs.select("file", F.explode(F.array("class_name", "parent_name")).alias("name")).where("name is not null").distinct()
    known = resolve_names(names, symbols, imports).select("file", "name", "id")
    own = known.select("file", F.col("name").alias("class_name"), F.col("id").alias("source_id"))
    up = known.select("file", F.col("name").alias("parent_name"), F.col("id").alias("target_id"))
    kind = F.when(F.col("kind").isin(*IMPLEMENTING) | F.coalesce("iface", F.lit(False)), "IMPLEMENTS").otherwise("EXTENDS")
    j = refs.join(own, ["file", "class_name"]).join(up, ["file", "parent_name"])
    one = j.groupBy("source_id", "target_id").agg(F.min(F.struct("kind", kind.alias("type"))).alias("k"))
    return one.select(F.concat_ws("_", F.lit("heritage"), "source_id", "target_id").alias("id"), "source_id", "target_id", F.col("k.type").alias("type"), F.lit(0.9).alias("confidence"), F.col("k.kind").alias("reason"))


def repaired_sources(graph: PropertyGraph) -> DataFrame:
    """CALLS edges (id, source_id, target_id, type, confidence, reason): an edge whose source is no node starts at the
    source's file instead, or goes if that is none either; equal results are kept once.

    A node id is ``Label:file:name``, a file's is ``File:file``.
    """
    ids = graph.nodes.select("id").distinct()
    calls = graph.typed("CALLS").select("id", "source_id", "target_id", "type", "confidence", "reason")
    known = ids.select(F.col("id").alias("source_id"))
    fine = calls.join(known, "source_id", "left_semi").select("id", "source_id", "target_id", "type", "confidence", "reason")
    lost = calls.join(known, "source_id", "left_anti")
    file = F.concat(F.lit("File:"), F.regexp_extract("source_id", r"^[^:]+:(.+?)(?::[^:/]*)?$", 1))
    moved = lost.select(file.alias("source_id"), "target_id").distinct().join(known, "source_id", "left_semi")
    return fine.unionByName(moved.select(F.concat_ws("_", F.lit("calls"), "source_id", "target_id").alias("id"), "source_id", "target_id", F.lit("CALLS").alias("type"), F.lit(1.0).alias("confidence"), F.lit("repointed_orphan_source").alias("reason")))


def community_labels(nodes: DataFrame, member: DataFrame) -> DataFrame:
    """(community, label): the folder that most members lie in, by its own name; ties to the least, ``unnamed`` without any."""
    folder = F.regexp_extract("file_path", r"([^/]+)/[^/]*$", 1)
    j = member.join(nodes.select("id", folder.alias("folder")), "id", "left").where("folder <> ''")
    n = j.groupBy("community", "folder").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("community").agg(F.min_by("folder", F.struct(-F.col("n"), "folder")).alias("label"))
    return member.select("community").distinct().join(best, "community", "left").select("community", F.coalesce("label", F.lit("unnamed")).alias("label"))


def process_kinds(steps: DataFrame, member: DataFrame) -> DataFrame:
    """(process, kind): intra_community where the steps (process, id) lie in one community or none, else cross_community."""
    n = steps.join(member.select("id", "community"), "id", "left").groupBy("process").agg(F.count_distinct("community").alias("n"))
    return n.select("process", F.when(F.col("n") <= 1, "intra_community").otherwise("cross_community").alias("kind"))


def features(communities: DataFrame, member: DataFrame, limit: int = 50) -> DataFrame:
    """(id, name, members): the largest communities (id, name, symbol_count), their own count before that of the members."""
    n = member.groupBy(F.col("community").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    j = communities.join(n, "id", "left").select("id", "name", F.coalesce("symbol_count", "n", F.lit(0)).cast("long").alias("members"))
    return j.orderBy(F.desc("members"), "id").limit(limit)


def detect_changes(changed: DataFrame, graph: PropertyGraph, steps: DataFrame, depth: int = 3) -> DataFrame:
    """One row (direct, transitive, processes, risk) for changed symbols (id): those themselves, what reaches them against
    the edges within ``depth``, and the processes (process, id) that hold any of them."""
    from cairn.operators.history import risk
    from cairn.operators.traverse import bfs
    from cairn.plans.runtime import cut
    from cairn.schema import CHANGE_EDGES

    e = graph.typed(*CHANGE_EDGES).select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"))
    seen = cut(bfs(e, changed.select("id"), depth))
    n = seen.agg(F.sum((F.col("depth") == 0).cast("long")).alias("direct"), F.sum((F.col("depth") > 0).cast("long")).alias("transitive"))
    p = steps.join(seen.select("id"), "id", "left_semi").agg(F.count_distinct("process").alias("processes"))
    zero = F.lit(0).cast("long")
    j = n.crossJoin(p).select(F.coalesce("direct", zero).alias("direct"), F.coalesce("transitive", zero).alias("transitive"), "processes")  # one row each
    return j.withColumn("risk", risk(F.col("direct"), F.col("transitive"), F.col("processes")))


# What each zoom level shows.
ZOOM = {
    "package": (("Folder", "Package", "Project"), ("CONTAINS",)),
    "module": (("File", "Module", "Folder"), ("CONTAINS", "IMPORTS")),
    "symbol": (
        ("Function", "Class", "Method", "Interface", "Struct", "Trait", "Enum", "Variable", "Type", "Const", "Constructor", "Property", "Namespace", "Route", "Tool", "Controller", "ControllerAction", "Service", "Repository", "View", "DbEntity", "DbContext"),
        ("CALLS", "USES", "IMPORTS", "INHERITS", "IMPLEMENTS", "EXTENDS", "HAS_METHOD", "HAS_ACTION", "CALLS_SERVICE", "CALLS_ACTION", "RENDERS_VIEW", "MAPS_TO_ENTITY"),
    ),
}


def zoom(graph: PropertyGraph, level: str) -> PropertyGraph:
    """The nodes and edges of a level (package, module or symbol), edges with both ends among the nodes."""
    labels, types = ZOOM[level]
    nodes = graph.nodes.where(F.col("label").isin(*labels))
    ids = nodes.select("id")
    e = graph.typed(*types)
    e = e.join(ids, e.source_id == ids.id, "left_semi")
    return PropertyGraph(nodes, e.join(ids, e.target_id == ids.id, "left_semi"))


def edge_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(source_id, target_id, type, change): edges of one side only, as sets."""
    cols = ["source_id", "target_id", "type"]
    a, b = old.select(*cols).distinct().withColumn("o", F.lit(1)), new.select(*cols).distinct().withColumn("n", F.lit(1))
    kind = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed")
    return a.join(b, cols, "full_outer").select(*cols, kind.alias("change")).where("change is not null")


def table_inventory(tables: DataFrame, columns: DataFrame, references: DataFrame) -> DataFrame:
    """(table_name, columns, foreign_keys) of every table; columns and references have one row each, with table_name."""
    c = columns.groupBy("table_name").agg(F.count(F.lit(1)).alias("columns"))
    r = references.groupBy("table_name").agg(F.count(F.lit(1)).alias("foreign_keys"))
    zero = F.lit(0).cast("long")
    return tables.select("table_name").distinct().join(c, "table_name", "left").join(r, "table_name", "left").select("table_name", F.coalesce("columns", zero).alias("columns"), F.coalesce("foreign_keys", zero).alias("foreign_keys"))


def sorted_todos(todos: DataFrame, limit: int) -> DataFrame:
    """Markers by urgency (FIXME, HACK, TODO, XXX), then file and line: the order of a report."""
    rank = F.array_position(F.array(*[F.lit(k) for k in ("FIXME", "HACK", "TODO", "XXX")]), F.col("kind"))
    return todos.orderBy(F.when(rank > 0, rank).otherwise(9), "file_id", "line_no").limit(limit)


def clamp(given: int | None, default: int, most: int) -> int:
    """A limit a caller asked for, within 1 and ``most``."""
    return max(1, min(most, default if given is None else given))
