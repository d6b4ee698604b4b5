"""Counts, dependencies and cross references over a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.graph import PropertyGraph
from cairn.operators import search
from cairn.schema import CALLABLE


def stats(graph: PropertyGraph) -> DataFrame:
    """(kind, name, n): counts by label and by relationship type."""
    a = graph.nodes.groupBy(F.lit("label").alias("kind"), F.col("label").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return a.unionByName(graph.edges.groupBy(F.lit("type").alias("kind"), F.col("type").alias("name")).agg(F.count(F.lit(1)).alias("n")))


def connected_files(graph: PropertyGraph) -> DataFrame:
    """(file_path, degree): edge ends summed by file."""
    ends = graph.edges.select(F.col("source_id").alias("id")).unionByName(graph.edges.select(F.col("target_id").alias("id")))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("d")).join(graph.nodes.select("id", "file_path"), "id").groupBy("file_path").agg(F.sum("d").alias("degree"))


def symbols_per_file(graph: PropertyGraph) -> DataFrame:
    """(file_path, symbols) without the files' own nodes."""
    return graph.nodes.where(~F.col("label").isin("File", "Folder") & F.col("file_path").isNotNull()).groupBy("file_path").agg(F.count(F.lit(1)).alias("symbols"))


def module_dependencies(graph: PropertyGraph, member: DataFrame, types: tuple[str, ...] = ()) -> DataFrame:
    """(source, target, n): edges between different modules; member: id, module."""
    e = graph.typed(*types).select("source_id", "target_id")
    a, b = member.select(F.col("id").alias("source_id"), F.col("module").alias("source")), member.select(F.col("id").alias("target_id"), F.col("module").alias("target"))
    return e.join(a, "source_id").join(b, "target_id").where("source <> target").groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


def module_stats(graph: PropertyGraph, member: DataFrame) -> DataFrame:
    """(module, members, files, calls_in, calls_out): size and traffic of each module."""
    size = member.join(graph.nodes.select("id", "file_path"), "id").groupBy("module").agg(F.count_distinct("id").alias("members"), F.count_distinct("file_path").alias("files"))
    dep = module_dependencies(graph, member)
    out = dep.groupBy(F.col("source").alias("module")).agg(F.sum("n").alias("calls_out"))
    into = dep.groupBy(F.col("target").alias("module")).agg(F.sum("n").alias("calls_in"))
    zero = F.lit(0).cast("long")
    return size.join(into, "module", "left").join(out, "module", "left").select("module", "members", "files", F.coalesce("calls_in", zero).alias("calls_in"), F.coalesce("calls_out", zero).alias("calls_out"))


def hub(graph: PropertyGraph) -> DataFrame:
    """The most called callable whose name is its alone and longer than four characters; ties by id."""
    own = graph.nodes.where(F.col("label").isin(*CALLABLE) & (F.length("name") > 4)).withColumn("same", F.count(F.lit(1)).over(Window.partitionBy("name"))).where("same = 1")
    calls = graph.typed("CALLS").groupBy(F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("calls"))
    return own.join(calls, "id").select("id", "name", "calls").orderBy(F.desc("calls"), "id").limit(1)


def token_account(files: DataFrame) -> DataFrame:
    """(files, bytes, tokens): distinct paths, their bytes and a token for four bytes."""
    one = files.where("path is not null").groupBy("repo_id", "path").agg(F.max(F.coalesce(F.octet_length("content").cast("long"), F.col("size"), F.lit(0))).alias("bytes"))
    return one.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.floor(F.sum("bytes") / 4), F.lit(0)).alias("tokens"))


def overview(files: DataFrame) -> DataFrame:
    """(repo_id, language, files, bytes): language breakdown of each repository; null language as ``other``."""
    return files.groupBy("repo_id", F.coalesce("language", F.lit("other")).alias("language")).agg(F.count(F.lit(1)).alias("files"), F.sum(F.coalesce(F.octet_length("content").cast("long"), F.col("size"), F.lit(0))).alias("bytes"))


def endpoint_handlers(endpoints: DataFrame, graph: PropertyGraph) -> DataFrame:
    """(id, handler_id, callers, callees): the HANDLED_BY edge's target, else the handler_id column, with its call counts."""
    e = graph.typed("HANDLED_BY").groupBy(F.col("source_id").alias("id")).agg(F.min("target_id").alias("edge_handler"))
    h = endpoints.select("id", "handler_id").join(e, "id", "left").select("id", F.coalesce("edge_handler", "handler_id").alias("handler_id"))
    calls = graph.typed("CALLS").select("source_id", "target_id").distinct()
    up = calls.groupBy(F.col("target_id").alias("handler_id")).agg(F.count(F.lit(1)).alias("callers"))
    down = calls.groupBy(F.col("source_id").alias("handler_id")).agg(F.count(F.lit(1)).alias("callees"))
    zero = F.lit(0).cast("long")
    return h.join(up, "handler_id", "left").join(down, "handler_id", "left").select("id", "handler_id", F.coalesce("callers", zero).alias("callers"), F.coalesce("callees", zero).alias("callees"))


def snapshot_summary(old: PropertyGraph, new: PropertyGraph) -> DataFrame:
    """(label, before, after, added, removed): node counts of two snapshots by label."""
    a, b = old.nodes.select("id", "label"), new.nodes.select("id", "label")
    j = a.withColumnRenamed("label", "la").join(b.withColumnRenamed("label", "lb"), "id", "full_outer")
    return j.groupBy(F.coalesce("lb", "la").alias("label")).agg(F.count("la").alias("before"), F.count("lb").alias("after"), F.sum(F.col("la").isNull().cast("long")).alias("added"), F.sum(F.col("lb").isNull().cast("long")).alias("removed"))


def hits_by_process(hits: DataFrame, steps: DataFrame) -> DataFrame:
    """(process, hits, best): search hits (id, score) grouped by the processes they are steps of (process, id); hits of no
    process under a null process."""
    return hits.join(steps.select("process", "id").distinct(), "id", "left").groupBy("process").agg(F.array_sort(F.collect_set("id")).alias("hits"), F.max("score").alias("best"))


def search_processes(processes: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Processes whose name or description holds a text, longest first; processes: id, name, description, step_count."""
    hit = F.lower("name").contains(text.lower()) | F.lower(F.coalesce("description", F.lit(""))).contains(text.lower())
    return processes.where(hit).orderBy(F.desc("step_count"), "id").limit(limit)


def renumber(steps: DataFrame) -> DataFrame:
    """(process, id, step): steps numbered from 1 without gaps."""
    return steps.select("process", "id", F.row_number().over(Window.partitionBy("process").orderBy("step", "id")).alias("step"))


def cross_references(pages: DataFrame, names: DataFrame) -> DataFrame:
    """(page, name, target): one link a name and page, names of five characters or more as words; of names that differ in
    case only the longest, then least. pages: page, text; names: name, target. Both sides meet on the word."""
    words = pages.where("text is not null").select("page", F.explode(F.array_distinct(F.split("text", r"[^\w]+"))).alias("name")).where(F.length("name") >= 5)
    one = names.where(F.length("name") >= 5).groupBy("name").agg(F.min("target").alias("target"))
    return words.join(one, "name").where(F.col("page") != F.col("target")).select("page", "name", "target")


def backlinks(links: DataFrame) -> DataFrame:
    return links.groupBy("target").agg(F.array_sort(F.collect_set("page")).alias("pages"))


def reading_guide(signals: DataFrame) -> DataFrame:
    """(module, score): .40 rank, .25 members, .15 in, .12 out, .08 files, each over its greatest (of rank at least 1)."""
    parts = [("rank", 0.40), ("members", 0.25), ("calls_in", 0.15), ("calls_out", 0.12), ("files", 0.08)]
    top = signals.agg(*[F.max(c).alias(f"m_{c}") for c, _ in parts])
    j = signals.crossJoin(F.broadcast(top))  # one row
    score = sum((F.lit(w) * F.coalesce(F.col(c) / F.when(F.greatest(F.col(f"m_{c}"), F.lit(1.0 if c == "rank" else 0.0)) > 0, F.greatest(F.col(f"m_{c}"), F.lit(1.0 if c == "rank" else 0.0))), F.lit(0.0)) for c, w in parts), F.lit(0.0))
    return j.select("module", score.alias("score"))


def enrichment_priority(signals: DataFrame, limit: int = 100) -> DataFrame:
    """(id, priority): .35 hotspot + .25 coupling + .20 size + .10 untested + .10 dead, under .05 left out; inputs from 0 to 1."""
    p = 0.35 * F.coalesce("hotspot", F.lit(0.0)) + 0.25 * F.coalesce("coupling", F.lit(0.0)) + 0.20 * F.coalesce("size", F.lit(0.0)) + 0.10 * F.coalesce("untested", F.lit(0.0)) + 0.10 * F.coalesce("dead", F.lit(0.0))
    return signals.select("id", p.alias("priority")).where("priority >= 0.05").orderBy(F.desc("priority"), "id").limit(limit)


def rename_preview(files: DataFrame, old: str, known: DataFrame) -> DataFrame:
    """(path, line_no, confirmed): lines that hold a name as a word, confirmed where the graph has a reference (path, line_no)."""
    import re

    lines = files.where(F.col("content").contains(old)).select("path", F.posexplode(F.split("content", "\n")).alias("i", "line")).where(F.col("line").rlike(rf"(?<!\w){re.escape(old)}(?!\w)"))
    k = known.select("path", "line_no").distinct().withColumn("confirmed", F.lit(True))
    return lines.select("path", (F.col("i") + 1).alias("line_no")).join(k, ["path", "line_no"], "left").select("path", "line_no", F.coalesce("confirmed", F.lit(False)).alias("confirmed"))


def context_filter(nodes: DataFrame, *, files: tuple[str, ...] = (), labels: tuple[str, ...] = (), names: tuple[str, ...] = (), modules: DataFrame | None = None) -> DataFrame:
    """Nodes under the folders or files, of the labels, of the names and of the modules (id), each only if given."""
    out = nodes
    if files:
        hit = F.lit(False)
        for f in files:
            hit = hit | (F.col("file_path") == f) | F.col("file_path").startswith(f.rstrip("/") + "/")
        out = out.where(hit)
    if labels:
        out = out.where(F.col("label").isin(*labels))
    if names:
        out = out.where(F.col("name").isin(*names))
    return out if modules is None else out.join(modules.select("id").distinct(), "id", "left_semi")


def find_symbols(nodes: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Nodes by name: exact first, then those that contain the text, shortest first."""
    low = F.lower("name")
    return nodes.where(low.contains(text.lower())).orderBy((low != text.lower()).cast("int"), F.length("name"), "id").limit(limit)


def search_code(graph: PropertyGraph, text: str, limit: int = 10, *, vectors: DataFrame | None = None, query: list[float] | None = None, score=None) -> DataFrame:
    """(id, name, label, file_path, score, tier): the best hits, one a file, topped up by nodes whose name holds the text.

    A pool of at least 20 text hits (or twice the limit with vectors) is fused with the nearest vectors (node_id, vector)
    where a query vector is given, reordered by ``score`` (a Column over the hits) where one is given, and cut to the best
    hit of each file; tier 0 are hits, tier 1 names. A node without a file is a file of its own.
    """
    pool = 2 * limit if vectors is not None else max(limit, 20)
    hits = search.bm25_nodes(graph, text, limit=pool).select(F.col("nodeId").alias("id"), "score")
    ranked = search.top(hits, pool)
    if vectors is not None and query is not None:
        ranked = search.hybrid(ranked, search.knn(vectors, query, pool), pool).select("id", "score", "rank")
    if score is not None:
        ranked = search.rerank(ranked.join(graph.nodes, "id"), score).select("id", "score", "rank")
    own = graph.nodes.select("id", "name", "label", "file_path")
    hit = ranked.join(own, "id").select("*", F.lit(0).alias("tier"))
    named = own.where(F.lower("name").contains(text.lower())).join(ranked.select("id"), "id", "left_anti").select("id", F.lit(0.0).alias("score"), F.lit(0).alias("rank"), "name", "label", "file_path", F.lit(1).alias("tier"))
    one = Window.partitionBy(F.coalesce("file_path", "id")).orderBy("tier", "rank", "id")
    both = hit.unionByName(named.select(*hit.columns)).withColumn("_n", F.row_number().over(one)).where("_n = 1")
    return both.orderBy("tier", "rank", "id").limit(limit).select("id", "name", "label", "file_path", "score", "tier")
