import itertools
import random

from cairn.graph import PropertyGraph, from_star_schema
from cairn.operators import quality, traverse

E = "id string, source_id string, target_id string, type string, confidence double, reason string, step int"
N = "id string, label string, name string, file_path string"


def make(spark, pairs, kind="CALLS", label="Function", ids=None):
    ids = sorted(set(itertools.chain(*pairs)) | set(ids or ()))
    return PropertyGraph(spark.createDataFrame([(i, label, i, f"src/{i}.py") for i in ids], N), spark.createDataFrame([(f"e{k}", a, b, kind, 1.0, "t", None) for k, (a, b) in enumerate(pairs)], E))


def test_cycles(spark):
    got = lambda pairs: sorted((r["length"], r["severity"], r["members"]) for r in quality.cycles(make(spark, pairs).edges).collect())
    assert got([("a", "b")]) == []
    assert got([("a", "b"), ("b", "a")]) == [(2, "low", ["a", "b"])]
    assert got([("a", "b"), ("a", "c"), ("b", "c"), ("c", "a")]) == [(3, "low", ["a", "b", "c"])]
    assert got([("a", "a"), ("b", "c")]) == [(1, "low", ["a"])]


def test_strong_components_against_brute_force(spark):
    rng = random.Random(4)
    pairs = [(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for _ in range(22)]
    reach = {}
    for a in {x for p in pairs for x in p}:
        seen, todo = set(), [a]
        while todo:
            x = todo.pop()
            for s, t in pairs:
                if s == x and t not in seen:
                    seen.add(t)
                    todo.append(t)
        reach[a] = seen
    want = {a: min(b for b in reach if a in reach[b] and b in reach[a]) for a in reach if a in reach[a]}
    assert {r["id"]: r["component"] for r in quality.strong_components(make(spark, pairs).edges).collect()} == want


def test_impact_through_members(spark):
    g = make(spark, [("start", "Agent"), ("executePlan", "Planner")])
    extra = spark.createDataFrame([("m1", "Agent", "executePlan", "HAS_METHOD", 1.0, "t", None), ("m2", "Planner", "createPlan", "HAS_METHOD", 1.0, "t", None)], E)
    g = PropertyGraph(g.nodes.unionByName(spark.createDataFrame([("createPlan", "Function", "c", "p")], N)), g.edges.unionByName(extra))
    got = {(r["direction"], r["id"]) for r in traverse.impact(g, "executePlan", 5).collect()}
    assert got == {("upstream", "Agent"), ("upstream", "start"), ("downstream", "Planner"), ("downstream", "createPlan")}


def test_paths_and_views(spark):
    g = make(spark, [("a", "b"), ("b", "c"), ("a", "d"), ("d", "c"), ("c", "e")], ids=["z"])
    r = traverse.shortest_path(g, "a", "e").first()
    assert (r["depth"], r["path"]) == (3, ["a", "b", "c", "e"])
    assert traverse.shortest_path(g, "e", "a").count() == 0
    assert traverse.shortest_path(g, "e", "a", directed=False).first()["depth"] == 3
    near = traverse.neighbourhood(g, "b", 1)
    assert {r["id"] for r in near.nodes.collect()} == {"a", "b", "c"} and near.edges.count() == 2
    assert traverse.top_view(g, 2).nodes.count() == 2


def test_levels_components_rank(spark):
    g = make(spark, [("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("y", "w")], ids=["z"])
    assert {r["id"]: r["level"] for r in quality.topo_levels(g.edges, g.nodes).collect()} == {"a": 0, "z": 0, "b": 1, "c": 2, "x": None, "y": None, "w": None}
    assert {r["id"]: r["component"] for r in quality.components(g.edges, g.nodes).collect()} == {"a": "a", "b": "a", "c": "a", "w": "w", "x": "w", "y": "w", "z": "z"}
    ranks = {r["id"]: r["rank"] for r in quality.pagerank(g.edges, g.nodes).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-9 and ranks["c"] > ranks["b"] > ranks["a"]


def test_communities_and_cohesion(spark):
    g = make(spark, [("a1", "a2"), ("a2", "a3"), ("a3", "a1"), ("b1", "b2"), ("b2", "b3"), ("b3", "b1")])
    m = quality.communities(g)
    by = {r["id"]: r["community"] for r in m.collect()}
    assert len({by[f"a{i}"] for i in (1, 2, 3)}) == 1 and len({by[f"b{i}"] for i in (1, 2, 3)}) == 1 and by["a1"] != by["b1"]
    assert abs(quality.modularity(g.edges, m) - 0.5) < 1e-9
    assert {r["cohesion"] for r in quality.cohesion(g.edges, m).collect()} == {1.0}


def test_processes(spark):
    g = make(spark, [("f1", "f2"), ("f2", "f3"), ("f3", "f4")])
    got = quality.processes(g).collect()
    assert ["f1", "f2", "f3", "f4"] in [r["steps"] for r in got]
    assert quality.processes(make(spark, [("a", "b")])).count() == 0
    assert all(len(set(r["steps"])) == len(r["steps"]) for r in quality.processes(make(spark, [("a", "b"), ("b", "c"), ("c", "a")])).collect())


def test_clones_match_tails_too(spark):
    tail = [f"t{i}" for i in range(40)]
    rows = [(1, 1, ["x", *tail]), (1, 2, ["y", *tail]), (1, 3, list(reversed(tail))), (2, 4, ["x", *tail]), (1, 5, None), (1, 6, ["x", *tail])]
    got = quality.clones(spark.createDataFrame(rows, "run_id long, member_id long, tokens array<string>")).collect()
    assert [(r["run_id"], r["members"]) for r in got] == [(1, [1, 2, 6])]


def test_edits_of_the_graph(spark):
    g = make(spark, [("a", "b"), ("b", "c")])
    assert {r["id"] for r in g.without_nodes(spark.createDataFrame([("b",)], "id string")).nodes.collect()} == {"a", "c"}
    assert g.without_nodes(spark.createDataFrame([("b",)], "id string")).edges.count() == 0
    assert g.without_files(spark.createDataFrame([("src/a.py",)], "file_path string")).edges.count() == 1
    up = g.upsert(nodes=spark.createDataFrame([("a", "Class", "new", "p"), ("d", "Class", "d", "p")], N))
    assert {r["id"]: r["label"] for r in up.nodes.collect()} == {"a": "Class", "b": "Function", "c": "Function", "d": "Class"}
    assert g.upsert(edges=spark.createDataFrame([("e9", "a", "nope", "CALLS", 1.0, "t", None)], E)).dangling().count() == 1


def test_dead_code_and_layers(spark):
    g = make(spark, [("a", "b")], ids=["main", "lonely"])
    assert {r["id"] for r in quality.dead_code(g).collect()} == {"a", "lonely"}
    n = spark.createDataFrame([("c", "Controller", "c", "x"), ("r", "Repository", "r", "y"), ("s", "Service", "s", "z")], N)
    v = PropertyGraph(n, spark.createDataFrame([("1", "c", "r", "CALLS", 1.0, "", None), ("2", "c", "s", "CALLS", 1.0, "", None), ("3", "s", "r", "CALLS", 1.0, "", None)], E))
    assert [(r[0], r[1]) for r in quality.layer_violations(v).collect()] == [("c", "r")]


def test_empty_graph(spark):
    g = make(spark, [("a", "b")])
    none = PropertyGraph(g.nodes.limit(0), g.edges.limit(0))
    assert quality.cycles(none.edges).count() == 0 and quality.pagerank(none.edges, none.nodes).count() == 0
    assert quality.communities(none).count() == 0 and quality.processes(none).count() == 0
    assert traverse.impact(none, "x").count() == 0 and quality.topo_levels(none.edges, none.nodes).count() == 0


def test_star_schema(spark, sf):
    g = from_star_schema(spark, sf)
    assert g.dangling().count() == 0 and g.nodes.count() == g.nodes.select("id").distinct().count()


def test_clones_compare_every_pair_of_a_hot_list(spark):
    rng = random.Random(7)
    boiler = [f"b{i}" for i in range(30)]
    rows = []
    for i in range(24):  # two families in turn that share only the boilerplate
        tail = [f"{'xy'[i % 2]}{j}" for j in range(20)]
        rng.shuffle(tail)
        rows.append((1, i, [*boiler, *tail, f"own{i}"]))
    df = spark.createDataFrame(rows, "run_id long, member_id long, tokens array<string>")
    want = [(1, list(range(0, 24, 2)), round(50 / 52, 6)), (1, list(range(1, 24, 2)), round(50 / 52, 6))]
    for block in (64, 5, 1):
        assert sorted((r["run_id"], r["members"], r["similarity"]) for r in quality.clones(df, block=block).collect()) == want
