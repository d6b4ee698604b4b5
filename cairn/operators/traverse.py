"""Breadth-first operators: frontier loops of joins, each round cut from its lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.graph import PropertyGraph
from cairn.operators import local
from cairn.plans.runtime import counted_cut, cut, is_empty, laid_out
from cairn.schema import IMPACT_SKIPPED


def reach(links: DataFrame, seeds: DataFrame, max_depth: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, id, depth) reached from ``seeds`` (keys, id) over ``links`` (keys, source_id, target_id), least depths,
    seeds at 0; searches of different keys do not meet, so one loop serves them all.

    Each round is one job: it joins the frontier with the links, which stay hashed by their source, leaves out what was
    seen, writes the next frontier and tells whether it is empty. A hub's links are split by AQE. Null ids are left out.
    """
    laid = laid_out(links.where("source_id is not null and target_id is not null").select(*keys, "source_id", "target_id").distinct(), *keys, "source_id")
    frontier = cut(seeds.select(*keys, "id").where("id is not null").distinct().withColumn("depth", F.lit(0)))
    seen = frontier
    for depth in range(1, max_depth + 1):
        here = frontier.select(*keys, F.col("id").alias("source_id"))
        step = laid.join(here, [*keys, "source_id"]).select(*keys, F.col("target_id").alias("id")).distinct()
        frontier, n = counted_cut(step.join(seen.select(*keys, "id"), [*keys, "id"], "left_anti").withColumn("depth", F.lit(depth)), rows=F.lit(1))
        if not n["rows"]:
            break
        seen = seen.unionByName(frontier)
        if depth % 8 == 0:
            seen = cut(seen)
    laid.unpersist()
    return seen


def _small_reach(edges: DataFrame, seeds: DataFrame, max_depth: int, *ways: str) -> DataFrame | None:
    """reach() in one task where the links are few enough, else None."""
    links = cut(edges.select("source_id", "target_id"))
    if not local.fits(links):
        return None
    rows = links.unionByName(cut(seeds.select(F.col("id").alias("source_id"), F.lit(None).cast("string").alias("target_id"))))
    return local.one_task(rows, local.reached(max_depth, ways), "direction string, id string, depth int")


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """(id, depth) reached from ``seeds`` (id) over (source_id, target_id), least depths, seeds at 0."""
    small = _small_reach(edges, seeds, max_depth, "downstream")
    return reach(edges, seeds, max_depth) if small is None else small.select("id", "depth")


def both_directions(edges: DataFrame) -> DataFrame:
    """(direction, source_id, target_id): downstream along the edges, upstream against them."""
    e = edges.select("source_id", "target_id")
    return e.select(F.lit("downstream").alias("direction"), "source_id", "target_id").unionByName(e.select(F.lit("upstream").alias("direction"), F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id")))


def impact(graph: PropertyGraph, target: str, max_depth: int = 5, *, skip: tuple[str, ...] = IMPACT_SKIPPED, only: tuple[str, ...] = ()) -> DataFrame:
    """(direction, id, depth): what a node's change reaches against and along the edges; class members are seeds too."""
    edges = graph.edges.where(F.col("type").isin(*only)) if only else graph.edges.where(~F.col("type").isin(*skip))
    owner = graph.edges.where(F.col("type").isin("HAS_METHOD", "HAS_ACTION") & (F.col("source_id") == target)).select(F.col("target_id").alias("id"))
    seeds = graph.nodes.where(F.col("id") == target).select("id").unionByName(owner)
    small = _small_reach(edges, seeds, max_depth, "downstream", "upstream")
    ways = seeds.withColumn("direction", F.explode(F.array(F.lit("downstream"), F.lit("upstream"))))
    keep = graph.nodes.where((F.col("label") != "Community") & ~F.coalesce(F.col("file_path"), F.lit("")).contains("/obj/")).select("id")
    got = reach(both_directions(edges), ways, max_depth, ("direction",)) if small is None else small
    return got.where("depth > 0").join(keep, "id", "left_semi").select("direction", "id", "depth")


def impact_paths(graph: PropertyGraph, target: str, max_depth: int = 5, *, skip: tuple[str, ...] = IMPACT_SKIPPED) -> DataFrame:
    """(direction, id, depth, path array<string>): impact with one least path to each reached node, of equal ones that
    least in order. The frontier keeps one path a node and direction, so its size is that of the nodes reached."""
    links = laid_out(both_directions(graph.edges.where(~F.col("type").isin(*skip))).where("source_id is not null and target_id is not null").distinct(), "direction", "source_id")
    start = graph.nodes.where(F.col("id") == target).select(F.explode(F.array(F.lit("downstream"), F.lit("upstream"))).alias("direction"), "id", F.array("id").alias("path"))
    frontier = seen = cut(start)
    for _ in range(max_depth):
        here = frontier.select("direction", F.col("id").alias("source_id"), "path")
        step = links.join(here, ["direction", "source_id"]).select("direction", F.col("target_id").alias("id"), F.concat("path", F.array("target_id")).alias("path"))
        frontier, n = counted_cut(step.groupBy("direction", "id").agg(F.min("path").alias("path")).join(seen.select("direction", "id"), ["direction", "id"], "left_anti"), rows=F.lit(1))
        if not n["rows"]:
            break
        seen = seen.unionByName(frontier)
    links.unpersist()
    return seen.select("direction", "id", (F.size("path") - 1).alias("depth"), "path").where("depth > 0")


def affected_files(graph: PropertyGraph, reached: DataFrame) -> DataFrame:
    """(file_path, symbols, depth): the files of reached nodes with their number and least depth."""
    return reached.join(graph.nodes.select("id", "file_path"), "id").groupBy("file_path").agg(F.count_distinct("id").alias("symbols"), F.min("depth").alias("depth"))


def shortest_path(graph: PropertyGraph, a: str, b: str, *, types: tuple[str, ...] = (), max_depth: int = 10, directed: bool = True) -> DataFrame:
    """(depth, path array<string>): one least path, of equal ones that least in order; no row if there is none.

    The frontier keeps one path a node, so its size is that of the nodes reached.
    """
    base = graph.typed(*types) if directed else graph.both_ways(*types)
    links = cut(base.select("source_id", "target_id").distinct())
    start = graph.nodes.where(F.col("id") == a).select("id", F.array("id").alias("path"))
    frontier = seen = cut(start)
    for _ in range(max_depth):
        hit = frontier.where(F.col("id") == b)
        if not is_empty(hit):
            return hit.select((F.size("path") - 1).alias("depth"), "path")
        step = frontier.join(links, frontier.id == links.source_id).select(F.col("target_id").alias("id"), F.concat("path", F.array("target_id")).alias("path"))
        frontier = cut(step.groupBy("id").agg(F.min("path").alias("path")).join(seen, "id", "left_anti"))
        if is_empty(frontier):
            break
        seen = cut(seen.select("id").unionByName(frontier.select("id")))
    return frontier.where(F.col("id") == b).select((F.size("path") - 1).alias("depth"), "path")


def neighbourhood(graph: PropertyGraph, center: str, depth: int = 2, limit: int = 500) -> PropertyGraph:
    """Nodes within ``depth`` in either direction, the nearest ``limit`` of them (ties by id), with the edges among them."""
    seeds = graph.nodes.where(F.col("id") == center).select("id")
    small = _small_reach(graph.edges, seeds, depth, "either")
    near = reach(graph.both_ways(), seeds, depth) if small is None else small.select("id", "depth")
    picked = cut(near.join(graph.nodes.select("id"), "id", "left_semi").orderBy("depth", "id").limit(limit))
    return induced(graph, picked)


def induced(graph: PropertyGraph, ids: DataFrame) -> PropertyGraph:
    """The nodes ``ids`` (id) and the edges both of whose ends are among them."""
    i = ids.select("id").distinct()
    edges = graph.edges.join(i, graph.edges.source_id == i.id, "left_semi")
    return PropertyGraph(graph.nodes.join(i, "id", "left_semi"), edges.join(i, edges.target_id == i.id, "left_semi"))


def importance(graph: PropertyGraph) -> DataFrame:
    """(id, score): 2 a degree, 10 times the entry score, 5 if exported, 3 if traced, and a bonus by label."""
    cols = graph.nodes.columns
    n = graph.nodes.join(graph.degrees(), "id")
    flag = lambda c, w: F.when(F.coalesce(F.col(c), F.lit(False)), float(w)).otherwise(0.0) if c in cols else F.lit(0.0)
    entry = F.coalesce(F.col("entry_point_score"), F.lit(0.0)) * 10 if "entry_point_score" in cols else F.lit(0.0)
    bonus = F.when(F.col("label").isin("Controller", "Service"), 20.0).when(F.col("label").isin("Class", "Interface"), 10.0).when(F.col("label").isin("Module", "Package"), 15.0).otherwise(0.0)
    return n.select("id", ((F.col("in_degree") + F.col("out_degree")) * 2.0 + entry + flag("is_exported", 5) + flag("is_traced", 3) + bonus).alias("score"))


def top_view(graph: PropertyGraph, n: int) -> PropertyGraph:
    """The n most important nodes and the edges among them."""
    return induced(graph, cut(importance(graph).orderBy(F.desc("score"), "id").limit(n)))


def neighbours(graph: PropertyGraph, ids: DataFrame, types: tuple[str, ...], k: int) -> DataFrame:
    """(id, direction, type, other): up to k neighbours of each id and direction, ties by type and id."""
    i = ids.select("id").distinct()
    e = graph.typed(*types).select("source_id", "target_id", "type")
    out = e.join(i, e.source_id == i.id).select("id", F.lit("out").alias("direction"), "type", F.col("target_id").alias("other"))
    into = e.join(i, e.target_id == i.id).select("id", F.lit("in").alias("direction"), "type", F.col("source_id").alias("other"))
    both = out.unionByName(into).distinct()
    w = Window.partitionBy("id", "direction").orderBy("type", "other")
    return both.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def context(graph: PropertyGraph, node: str) -> DataFrame:
    """(direction, type, others): the neighbours of one node by direction and type, each list sorted; of a hub the first
    1,000 a direction by type and id, the feature's own limit."""
    return neighbours(graph, graph.nodes.where(F.col("id") == node), (), 1000).groupBy("direction", "type").agg(F.array_sort(F.collect_set("other")).alias("others"))
