"""Code quality and graph analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.text import module_of
from cairn.graph import PropertyGraph
from cairn.operators import local
from cairn.plans.runtime import counted_cut, cut, is_empty, laid_out, release
from cairn.schema import CALLABLE, COMMUNITY_EDGES, COMMUNITY_LABELS


def severity(c):
    return F.when(c <= 5, "low").when(c <= 10, "medium").when(c <= 20, "high").otherwise("critical")


def complexity_report(symbols: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, total, measured, avg, max, p50, p90, p99, low, medium, high, critical) with nearest-rank percentiles.

    The rank of q is round((n - 1) * q) from 0, half up. Counts by value are taken first, so a hot group is reduced
    map-side and the window runs over its distinct values. Null complexities count in total only.
    """
    g = symbols.groupBy(*keys, "complexity").agg(F.count(F.lit(1)).alias("w"))
    w = Window.partitionBy(*keys).orderBy("complexity")
    vals = g.where("complexity is not null").withColumn("run", F.sum("w").over(w)).withColumn("n", F.sum("w").over(Window.partitionBy(*keys)))
    pick = lambda q: F.min(F.when(F.col("run") > F.floor((F.col("n") - 1) * q + 0.5), F.col("complexity")))
    buckets = [F.sum(F.when(severity(F.col("complexity")) == s, F.col("w")).otherwise(0)).alias(s) for s in ("low", "medium", "high", "critical")]
    stats = vals.groupBy(*keys).agg(F.sum("w").alias("measured"), (F.sum(F.col("complexity") * F.col("w")) / F.sum("w")).alias("avg"), F.max("complexity").alias("max"), pick(0.5).alias("p50"), pick(0.9).alias("p90"), pick(0.99).alias("p99"), *buckets)
    total = g.groupBy(*[F.col(k).alias(f"t_{k}") for k in keys]).agg(F.sum("w").alias("total"))
    j = total.join(stats, [total[f"t_{k}"].eqNullSafe(stats[k]) for k in keys], "left")
    zero = F.lit(0).cast("long")
    return j.select(*[F.col(f"t_{k}").alias(k) for k in keys], "total", F.coalesce("measured", zero).alias("measured"), "avg", "max", "p50", "p90", "p99", *[F.coalesce(s, zero).alias(s) for s in ("low", "medium", "high", "critical")])


def latest_symbols(symbols: DataFrame) -> DataFrame:
    """The newest measurement of each symbol, without repeated deliveries; ties by complexity."""
    w = Window.partitionBy("repo_id", "node_id").orderBy(F.desc("measured_at"), F.desc_nulls_last("complexity"))
    return symbols.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def by_module(symbols: DataFrame) -> DataFrame:
    return complexity_report(symbols.withColumn("module", module_of(F.col("file_path"))), ["repo_id", "module"])


def coverage(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, total, traced, pct) of callables."""
    c = nodes.where(F.col("label").isin(*CALLABLE)).groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.sum(F.coalesce(F.col("is_traced"), F.lit(False)).cast("long")).alias("traced"))
    return c.withColumn("pct", F.round(F.col("traced") * 100.0 / F.col("total"), 0))


# Names that a framework calls.
ENTRY_NAMES = "Main main Dispose Application_Start Application_End Application_Error Application_BeginRequest Application_EndRequest Application_AuthenticateRequest Session_Start Session_End Configuration ConfigureServices Configure RegisterRoutes RegisterBundles RegisterGlobalFilters RegisterAreas OnAuthorization OnActionExecuting OnActionExecuted OnResultExecuting OnResultExecuted OnException".split()
_TEST_PATH = r"(?i)[/\\.]tests?[/\\]|[._](?:test|spec)\.|[/\\]test\.(?:cs|js|ts)$"


def dead_code(graph: PropertyGraph) -> DataFrame:
    """(id): methods and functions that nothing calls, but for entry names, test files and the methods of interfaces."""
    called = graph.typed("CALLS", "CALLS_ACTION", "CALLS_SERVICE").select(F.col("target_id").alias("id")).distinct()
    faces = graph.nodes.where("label = 'Interface'").select(F.col("id").alias("source_id"))
    declared = graph.typed("HAS_METHOD").join(faces, "source_id", "left_semi").select(F.col("target_id").alias("id"))
    own = graph.nodes.where(F.col("label").isin("Method", "Function") & ~F.col("name").isin(*ENTRY_NAMES) & ~F.coalesce(F.col("file_path"), F.lit("")).rlike(_TEST_PATH))
    return own.join(called, "id", "left_anti").join(declared, "id", "left_anti").select("id")


# The layers by label, then by parts of the path in lower case, first match first.
LAYER_LABELS = (
    ("Presentation", ("Controller", "ControllerAction", "ApiEndpoint", "View")),
    ("Business", ("Service",)),
    ("Data", ("Repository", "DbContext", "DbEntity")),
)
LAYER_PATHS = (
    ("Presentation", ("controller", "/views/")),
    ("Business", ("service", "/bal/", "/bll/")),
    ("Data", ("repository", "/dal/", "entities", "dbcontext")),
)


def layer(label, path):
    """Column: the layer of a node by its label, else by its path; null for none."""
    tests = [(name, label.isin(*labels)) for name, labels in LAYER_LABELS]
    for name, parts in LAYER_PATHS:
        hit = F.lit(False)
        for part in parts:
            hit = hit | F.lower(path).contains(part)
        tests.append((name, hit))
    return F.coalesce(*[F.when(hit, name) for name, hit in tests])


def layer_violations(graph: PropertyGraph) -> DataFrame:
    """(source_id, target_id): calls from Presentation to Data."""
    n = graph.nodes.select("id", layer(F.col("label"), F.col("file_path")).alias("layer"))
    up, down = n.where("layer = 'Presentation'"), n.where("layer = 'Data'")
    calls = graph.typed("CALLS", "CALLS_SERVICE").select("source_id", "target_id").distinct()
    return calls.join(up, calls.source_id == up.id, "left_semi").join(down, calls.target_id == down.id, "left_semi")


def diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change, fields): added, removed and changed rows, with the names of the fields that differ; null equals null."""
    fields = [c for c in old.columns if c != key and c in new.columns]
    a, b = old.alias("a"), new.alias("b")
    j = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    changed = F.filter(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in sorted(fields)]), lambda x: x.isNotNull())
    kind = F.when(F.col(f"a.{key}").isNull(), "added").when(F.col(f"b.{key}").isNull(), "removed").when(F.size(changed) > 0, "changed")
    return j.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), kind.alias("change"), F.when(kind == "changed", changed).otherwise(F.array().cast("array<string>")).alias("fields")).where("change is not null")


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, component): weakly connected components by least id, with the pointer jumps of min-label propagation."""
    ends = cut(edges.select("source_id", "target_id").where("source_id <> target_id"))
    if dict(nodes.dtypes)["id"] == "string" and local.fits(ends):
        lone = nodes.select(F.col("id").alias("source_id"), F.lit(None).cast("string").alias("target_id"))
        return local.one_task(ends.unionByName(lone), local.components, "id string, component string")
    pairs = ends.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    links = laid_out(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "b")
    lab = cut(nodes.select("id", F.col("id").alias("component")))
    while True:
        best = links.join(lab.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("m"))
        step = lab.join(best, "id", "left").select("id", F.col("component").alias("was"), F.least("component", F.coalesce("m", "component")).alias("component"))
        up = lab.select(F.col("id").alias("component"), F.col("component").alias("root"))  # where the new label points by now
        jump = step.join(up, "component", "left").select("id", "was", F.least("component", F.coalesce("root", "component")).alias("component"))
        nxt, moved = counted_cut(jump, moved=F.col("component") < F.col("was"))
        release(lab)
        lab = nxt
        if not moved["moved"]:
            links.unpersist()
            return lab.select("id", "component")


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component): nodes on a directed cycle with the least id of their strongly connected component.

    Each round spreads two colours inside the present classes until they settle, the least rank of all that reach a node
    and the least of all it reaches. Where both agree they are the rank of one node of the class, which reaches and is
    reached by every node of those colours: a component in full. An edge between different pairs of colours lies on no
    cycle and goes; what is left are smaller classes for the next round, until no edge is. Ranks are hashes that change
    with the round, so no order of ids makes the rounds many. Loops make a component of one.
    """
    loops = edges.where("source_id = target_id").select(F.col("source_id").alias("id")).distinct()
    left, some = counted_cut(edges.where("source_id <> target_id and source_id is not null and target_id is not null").select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).distinct(), rows=F.lit(1))
    lone = loops.withColumn("component", F.col("id"))
    if some["rows"] and local.fits(left):
        few = cut(local.one_task(left, local.strong_components, "id string, component string"))
        return few.unionByName(lone.join(few.select("id"), "id", "left_anti"))
    found, turn = None, 0
    while some["rows"]:
        along = laid_out(left, "a")
        against = laid_out(left, "b")
        ids = left.select(F.col("a").alias("id")).unionByName(left.select(F.col("b").alias("id"))).distinct()
        rank = F.struct(F.xxhash64("id", F.lit(turn)).alias("h"), F.col("id").alias("n"))
        lab = cut(ids.select("id", rank.alias("f"), rank.alias("g")))
        while True:
            ahead = along.join(lab.select(F.col("id").alias("a"), "f"), "a").groupBy(F.col("b").alias("id")).agg(F.min("f").alias("nf"))
            back = against.join(lab.select(F.col("id").alias("b"), "g"), "b").groupBy(F.col("a").alias("id")).agg(F.min("g").alias("ng"))
            step = lab.join(ahead, "id", "left").join(back, "id", "left").select("id", F.least("f", F.coalesce("nf", "f")).alias("f"), F.least("g", F.coalesce("ng", "g")).alias("g"), ((F.coalesce("nf", "f") < F.col("f")) | (F.coalesce("ng", "g") < F.col("g"))).alias("moved"))
            nxt, moved = counted_cut(step, moved=F.col("moved"))
            release(lab)
            lab = nxt.select("id", "f", "g")
            lab._cairn_cut = nxt._cairn_cut
            if not moved["moved"]:
                break
        whole = lab.where("f = g").select("id", "f")
        real = whole.join(whole.groupBy("f").agg(F.min("id").alias("component"), F.count(F.lit(1)).alias("n")).where("n > 1"), "f").select("id", "component")
        found = real if found is None else found.unionByName(real)
        x, y = lab.select(F.col("id").alias("a"), F.col("f").alias("fa"), F.col("g").alias("ga")), lab.select(F.col("id").alias("b"), F.col("f").alias("fb"), F.col("g").alias("gb"))
        rest = along.join(x, "a").join(y, "b").where("fa = fb and ga = gb and fa <> ga").select("a", "b")
        nxt, some = counted_cut(rest, rows=F.lit(1))
        along.unpersist(), against.unpersist()
        release(left)
        left, turn = nxt, turn + 1
    if found is None:
        return lone
    return found.unionByName(lone.join(found.select("id"), "id", "left_anti"))


def cycle_members(edges: DataFrame) -> DataFrame:
    """(component, id, length, severity): one row a node on a cycle; up to 3 nodes low, up to 6 medium, else high."""
    c = strong_components(edges)
    size = c.groupBy("component").agg(F.count(F.lit(1)).alias("length"))
    return c.join(size, "component").select("component", "id", "length", F.when(F.col("length") <= 3, "low").when(F.col("length") <= 6, "medium").otherwise("high").alias("severity"))


def cycles(edges: DataFrame) -> DataFrame:
    """(component, length, severity, members): one row a cycle group, members sorted, for reports; cycle_members() has the
    same by node, for components that no row could hold."""
    return cycle_members(edges).groupBy("component", "length", "severity").agg(F.array_sort(F.collect_list("id")).alias("members"))


def communities(graph: PropertyGraph, rounds: int = 10, resolution: float = 1.0) -> DataFrame:
    """(id, community): synchronous local moves of one Louvain level over eligible nodes; singletons are left out.

    A node moves to the neighbouring community of the greatest gain in modularity if that beats its own, ties to the
    least; odd rounds let only even hashes move, even rounds odd ones, which keeps pairs from swapping for ever. Ends
    when nothing moves in two rounds, or after ``rounds``, the feature's own limit.
    """
    ok = graph.nodes.where(F.col("label").isin(*COMMUNITY_LABELS)).select("id")
    e = graph.typed(*COMMUNITY_EDGES).select("source_id", "target_id").where("source_id <> target_id")
    e = e.select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).distinct()
    e = e.join(ok, e.a == ok.id, "left_semi").join(ok, e.b == ok.id, "left_semi")
    ends = cut(e)
    both = ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if local.fits(ends):
        return local.one_task(both, local.communities(rounds, resolution), "id string, community string")
    links = laid_out(both, "b")
    m2 = links.count()
    lab = cut(links.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("k")).withColumn("c", F.col("id")))
    still = 0
    for r in range(rounds if m2 else 0):
        tot = lab.groupBy("c").agg(F.sum("k").alias("t"))
        near = links.join(lab.select(F.col("id").alias("b"), "c"), "b").groupBy(F.col("a").alias("id"), "c").agg(F.count(F.lit(1)).cast("double").alias("w"))
        mine = F.col("c") == F.col("old")
        opts = near.join(lab.select("id", "k", F.col("c").alias("old")), "id").join(tot, "c").withColumn("gain", F.col("w") - resolution * F.col("k") * (F.col("t") - F.when(mine, F.col("k")).otherwise(0.0)) / m2)
        pick = opts.groupBy("id").agg(F.min(F.struct((-F.col("gain")).alias("loss"), "c")).alias("top"), F.max(F.when(mine, F.col("gain"))).alias("now"))
        move = F.col("top").isNotNull() & (-F.col("top.loss") > F.coalesce("now", F.lit(0.0)) + 1e-12) & (F.pmod(F.xxhash64("id"), F.lit(2)) == r % 2)
        step = lab.join(pick, "id", "left").select("id", "k", F.when(move, F.col("top.c")).otherwise(F.col("c")).alias("c"), F.coalesce(move, F.lit(False)).alias("moved"))
        nxt, moved = counted_cut(step, moved=F.col("moved"))
        release(lab)
        lab = nxt.select("id", "k", "c")
        lab._cairn_cut = nxt._cairn_cut
        still = 0 if moved["moved"] else still + 1
        if still == 2:
            break
    links.unpersist()
    big = lab.groupBy("c").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("c")
    return lab.join(big, "c", "left_semi").select("id", F.col("c").alias("community"))


def modularity(edges: DataFrame, member: DataFrame) -> float:
    """Modularity of communities (id, community) over undirected distinct edges."""
    e = edges.where("source_id <> target_id").select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).distinct()
    x, y = member.select(F.col("id").alias("a"), F.col("community").alias("ca")), member.select(F.col("id").alias("b"), F.col("community").alias("cb"))
    both = cut(e.join(x, "a").join(y, "b"))
    m = both.count()
    if not m:
        return 0.0
    inside = both.where("ca = cb").count()
    deg = both.select(F.col("ca").alias("c")).unionByName(both.select(F.col("cb").alias("c"))).groupBy("c").agg(F.count(F.lit(1)).alias("d"))
    return inside / m - deg.agg(F.sum((F.col("d") / (2 * m)) ** 2)).first()[0]


def cohesion(edges: DataFrame, member: DataFrame) -> DataFrame:
    """(community, cohesion): inner edges over all edges at its members, each edge seen from both ends; 0 without edges."""
    x, y = member.select(F.col("id").alias("source_id"), F.col("community").alias("ca")), member.select(F.col("id").alias("target_id"), F.col("community").alias("cb"))
    e = edges.select("source_id", "target_id").join(x, "source_id", "left").join(y, "target_id", "left")
    ends = e.select(F.col("ca").alias("community"), (F.col("ca") == F.col("cb")).alias("inner")).unionByName(e.select(F.col("cb").alias("community"), (F.col("ca") == F.col("cb")).alias("inner"))).where("community is not null")
    got = ends.groupBy("community").agg((F.sum(F.coalesce(F.col("inner"), F.lit(False)).cast("int")) / F.count(F.lit(1))).alias("cohesion"))
    return member.select("community").distinct().join(got, "community", "left").select("community", F.coalesce("cohesion", F.lit(0.0)).alias("cohesion"))


def pagerank(edges: DataFrame, nodes: DataFrame, iterations: int = 24, damping: float = 0.85) -> DataFrame:
    """(id, rank) by weighted edges (source_id, target_id[, weight]); the mass of dead ends is spread evenly. Ranks sum to 1.

    The rank after t rounds is a sum of the vectors v_k = (damping * P)^k 1 with one factor each, and the factors follow
    from the sums of the v_k alone: what the dead ends hold of v_k is sum(v_k) - sum(v_k+1) / damping. So a round is one
    join with the links, which stay in place, and one sum, with no global step; three rounds make a job, and the vectors
    are added up once at the end.
    """
    e = edges.select("source_id", "target_id", F.col("weight").cast("double").alias("w") if "weight" in edges.columns else F.lit(1.0).alias("w")).groupBy("source_id", "target_id").agg(F.sum("w").alias("w"))
    ids = nodes.select("id").where("id is not null").distinct()
    e = cut(e.where("source_id is not null and target_id is not null"))
    if local.fits(e):
        rows = e.unionByName(cut(ids.select(F.col("id").alias("source_id"), F.lit(None).cast("string").alias("target_id"), F.lit(0.0).alias("w"))))
        return local.one_task(rows, local.pagerank(iterations, damping), "id string, rank double")
    n = ids.count()
    if not n:
        return ids.select("id", F.lit(0.0).alias("rank"))
    out = e.groupBy("source_id").agg(F.sum("w").alias("total"))
    links = laid_out(cut(e.join(out, "source_id").join(ids.select(F.col("id").alias("target_id")), "target_id", "left_semi").select("source_id", "target_id", (damping * F.col("w") / F.col("total")).alias("p"))), "source_id")
    vectors = [ids.select(F.lit(0).alias("k"), "id", F.lit(1.0).alias("v"))]
    last = vectors[0].select("id", "v")
    for first in range(1, iterations + 2, 3):
        some, rounds = last, []
        for k in range(first, min(first + 3, iterations + 2)):
            some = links.join(some.select(F.col("id").alias("source_id"), "v"), "source_id").groupBy(F.col("target_id").alias("id")).agg(F.sum(F.col("p") * F.col("v")).alias("v"))
            rounds.append(some.select(F.lit(k).alias("k"), "id", "v"))
        job = rounds[0]
        for x in rounds[1:]:
            job = job.unionByName(x)
        vectors.append(cut(job))
        last = vectors[-1].where(F.col("k") == first + len(rounds) - 1).select("id", "v")
    links.unpersist()
    whole = vectors[0]
    for x in vectors[1:]:
        whole = whole.unionByName(x)
    sums = {r["k"]: r["s"] for r in whole.groupBy("k").agg(F.sum("v").alias("s")).collect()}  # one row a round
    held = [sums.get(k, 0.0) - sums.get(k + 1, 0.0) / damping for k in range(iterations + 1)]  # of v_k, by the dead ends
    factors = [1.0 / n]  # of v_0, v_1, ... in the rank so far
    for _ in range(iterations):
        lost = sum(f * h for f, h in zip(factors, held))
        factors = [(1 - damping) / n + damping * lost / n, *factors]
    weigh = F.element_at(F.array(*[F.lit(f) for f in factors]), F.col("k") + 1)
    rank = whole.where(F.col("k") <= iterations).groupBy("id").agg(F.sum(F.col("v") * weigh).alias("rank"))
    return ids.join(rank, "id", "left").select("id", F.coalesce("rank", F.lit(0.0)).alias("rank"))


def topo_levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, level): a node's level is one more than the greatest of what points at it; null for nodes on or behind a cycle.

    A level is one job; each passes on only the nodes that still wait, with the edges among them in place.
    """
    e = laid_out(edges.select("source_id", "target_id").where("source_id is not null and target_id is not null").distinct(), "source_id")
    rest = cut(nodes.select("id").distinct())
    out, level = None, 0
    while True:
        held = e.join(rest.select(F.col("id").alias("source_id")), "source_id", "left_semi").select(F.col("target_id").alias("id")).distinct()
        split, n = counted_cut(rest.join(held.withColumn("waits", F.lit(True)), "id", "left").select("id", F.coalesce("waits", F.lit(False)).alias("waits")), free=(~F.coalesce("waits", F.lit(False))))
        if not n["free"]:
            break
        free = split.where("not waits").select("id", F.lit(level).alias("level"))
        out = free if out is None else out.unionByName(free)
        rest = split.where("waits").select("id")
        level += 1
    e.unpersist()
    tail = rest.withColumn("level", F.lit(None).cast("int"))
    return tail if out is None else out.unionByName(tail)


def processes(graph: PropertyGraph, *, depth: int = 10, fan: int = 4, least: int = 3, entries: int = 200, keep: int = 75) -> DataFrame:
    """(entry, terminal, steps array<string>, length): longest call paths from the best entry points.

    Entries are scored by export, callers and callees; paths go on to a node's first ``fan`` callees in order and never
    return to a node of theirs; of each (entry, terminal) the longest stays, then the ``keep`` longest: the feature's own
    limits, as parameters.
    """
    ok = graph.nodes.where(F.col("label").isin(*CALLABLE))
    e = graph.typed("CALLS").select("source_id", "target_id").where("source_id <> target_id").distinct()
    first = cut(e.withColumn("_n", F.row_number().over(Window.partitionBy("source_id").orderBy("target_id"))).where(F.col("_n") <= fan).select("source_id", "target_id"))
    out = e.groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("o"))
    into = e.groupBy(F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("i"))
    exported = F.when(F.coalesce(F.col("is_exported"), F.lit(False)), 3.0).otherwise(0.0) if "is_exported" in ok.columns else F.lit(0.0)
    score = exported + F.when(F.coalesce("i", F.lit(0)) == 0, 5.0).otherwise(2.0 / F.col("i")) + F.least(F.col("o"), F.lit(5)) + F.when(F.lower("name").rlike("main|handle|run|start|init|execute|process"), 2.0).otherwise(0.0)
    heads = ok.join(out, "id").join(into, "id", "left").select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(entries)
    live = cut(heads.select(F.array("id").alias("steps"), F.col("id").alias("at")))
    ended = None
    for _ in range(depth - 1):
        step = live.join(first, live["at"] == first.source_id, "left").withColumn("more", F.col("target_id").isNotNull() & ~F.array_contains("steps", F.coalesce("target_id", F.lit(""))))
        done = live.join(step.where("more").select("steps").distinct(), "steps", "left_anti")
        ended = done if ended is None else ended.unionByName(done)
        live = cut(step.where("more").select(F.concat("steps", F.array("target_id")).alias("steps"), F.col("target_id").alias("at")))
        if is_empty(live):
            break
    paths = ended.unionByName(live).select(F.get("steps", F.lit(0)).alias("entry"), F.col("at").alias("terminal"), "steps", F.size("steps").alias("length")).where(F.col("length") >= least)
    w = Window.partitionBy("entry", "terminal").orderBy(F.desc("length"), "steps")
    return paths.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").orderBy(F.desc("length"), "entry", "terminal").limit(keep)


def clone_members(members: DataFrame, *, min_tokens: int = 30, threshold: float = 0.9, width: int = 30, block: int = 64) -> DataFrame:
    """(run_id, cluster, member_id, size, similarity, mean_similarity): clusters of functions whose token sets agree at the
    threshold (Jaccard), one row a member, named by their least member.

    Members with equal token lists stand as one class. Every two classes of a run that share an exact shingle of ``width``
    tokens are candidates, but for those whose set sizes alone rule the threshold out; each candidate is verified once.
    Verified links make the components; similarity is the least of them and mean_similarity their mean (1 within one class).
    Recall is that of all pairs that share a shingle: the SQL of clone_clusters, which compares each, gives the same rows.

    A shingle's class list is split into blocks of about ``block`` classes by a hash; each pair of blocks is a product in a
    group of its own, so a hot list is compared in full but never gathered whole.
    """
    own = members.where((F.size("tokens") >= min_tokens) & F.col("run_id").isNotNull()).select("run_id", "member_id", "tokens")
    cls = F.concat_ws(":", F.col("run_id").cast("string"), F.sha2(F.concat_ws("\u0001", "tokens"), 256))
    classes = cut(own.withColumn("cls", cls).groupBy("cls", "run_id").agg(F.first("tokens").alias("tokens")).withColumn("id", F.monotonically_increasing_id()))
    shingles = classes.select("run_id", "id", F.size(F.array_distinct("tokens")).alias("size"), F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("tokens") - width), lambda i: F.xxhash64(F.concat_ws("\u0001", F.slice(F.col("tokens"), i + 1, width)))))).alias("h"))
    held = shingles.withColumn("held", F.count(F.lit(1)).over(Window.partitionBy("run_id", "h"))).where("held > 1")
    k = F.ceil(F.col("held") / block).cast("int")
    placed = held.withColumn("k", k).withColumn("c", F.pmod(F.xxhash64("id"), F.col("k")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    sides = placed.select("run_id", "h", F.least("c", "o").alias("lo"), F.greatest("c", "o").alias("hi"), F.struct("id", "size", "c").alias("x")).repartition("run_id", "h", "lo", "hi")
    lists = sides.groupBy("run_id", "h", "lo", "hi").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    paired = lists.select("lo", "hi", F.posexplode("xs").alias("p", "x"), "xs").select("lo", "hi", "x", F.explode(F.expr("slice(xs, p + 2, size(xs))")).alias("y"))
    fits = F.least("x.size", "y.size") / F.greatest("x.size", "y.size") >= threshold
    links = paired.where(((F.col("lo") == F.col("hi")) | (F.col("x.c") != F.col("y.c"))) & fits).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    s = lambda n: classes.select(F.col("id").alias(n), F.array_distinct("tokens").alias(f"t{n}"))
    both = links.join(s("a"), "a").join(s("b"), "b")
    sim = F.size(F.array_intersect("ta", "tb")) / F.size(F.array_union("ta", "tb"))
    good = cut(both.select(F.col("a").alias("source_id"), F.col("b").alias("target_id"), sim.alias("sim")).where(F.col("sim") >= threshold))
    comp = components(good, classes.select("id"))
    links_of = good.join(comp, good.source_id == comp.id).groupBy("component").agg(F.min("sim").alias("similarity"), F.avg("sim").alias("mean_similarity"))
    placed = own.withColumn("cls", cls).join(classes.select("cls", "id").join(comp, "id"), "cls").select("run_id", "component", "member_id").distinct()
    sized = placed.groupBy("component").agg(F.min("member_id").alias("cluster"), F.count(F.lit(1)).alias("size")).where("size > 1")
    one = lambda c: F.round(F.coalesce(c, F.lit(1.0)), 6).alias(c)
    return placed.join(sized, "component").join(links_of, "component", "left").select("run_id", "cluster", "member_id", "size", one("similarity"), one("mean_similarity"))


def clones(members: DataFrame, **options) -> DataFrame:
    """(run_id, cluster, members, similarity): clone_members() with a cluster in a row, for reports."""
    rows = clone_members(members, **options)
    return rows.groupBy("run_id", "cluster", "similarity").agg(F.array_sort(F.collect_list("member_id")).alias("members")).select("run_id", "cluster", "members", "similarity")


def file_cycles(graph: PropertyGraph, longest: int = 6) -> DataFrame:
    """(nodes array<string>): simple cycles of IMPORTS and DEPENDS_ON up to ``longest`` files, each once, from its least file.

    Only edges inside strongly connected components can be in a cycle; paths start at their least node and never pass a
    lesser one, so no cycle is found twice.
    """
    e = graph.typed("IMPORTS", "DEPENDS_ON").select("source_id", "target_id").distinct()
    c = cut(strong_components(e))
    a, b = c.select(F.col("id").alias("source_id"), F.col("component").alias("ca")), c.select(F.col("id").alias("target_id"), F.col("component").alias("cb"))
    inside = cut(e.join(a, "source_id").join(b, "target_id").where("ca = cb").select("source_id", "target_id"))
    live = inside.where("source_id <= target_id").select(F.col("source_id").alias("head"), F.col("target_id").alias("at"), F.array("source_id", "target_id").alias("path"))
    out = live.where("head = at").select(F.array("head").alias("nodes"))
    live = live.where("head <> at")
    for _ in range(longest - 1):
        live = cut(live)
        step = live.join(inside, live["at"] == inside.source_id).where("target_id >= head")
        out = out.unionByName(step.where("target_id = head").select(F.col("path").alias("nodes")))
        live = step.where("target_id <> head").where(~F.array_contains("path", F.col("target_id"))).select("head", F.col("target_id").alias("at"), F.concat("path", F.array("target_id")).alias("path"))
    return out.distinct()


def health_score(hotspot, cohesion_, tracing, owned):
    """(Column) 0 to 100: .30 calm files + .25 cohesion + .20 tracing + .25 ownership, each from 0 to 1."""
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * (0.30 * hotspot + 0.25 * cohesion_ + 0.20 * tracing + 0.25 * owned))), 1)


def grade(score):
    whole = F.floor(score)
    return F.when(whole >= 90, "A").when(whole >= 75, "B").when(whole >= 60, "C").when(whole >= 40, "D").otherwise("E")


def activity(history: DataFrame, summary: DataFrame, keep: int = 200) -> DataFrame:
    """The history with a further summary row, the last ``keep`` rows by time."""
    return history.unionByName(summary).orderBy(F.desc("ts")).limit(keep)
