"""Graph loops: the one-task form and the form of joins give the same rows."""

import random

import pytest

from cairn.graph import PropertyGraph
from cairn.operators import quality, traverse

N = "id string, label string, name string, file_path string"
E = "id string, source_id string, target_id string, type string, confidence double, reason string, step int"


def graph(spark, seed, n=14, m=24):
    rng = random.Random(seed)
    ids = [f"n{i}" for i in range(n)]
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(m)] + [("n0", "n0")]
    nodes = spark.createDataFrame([(i, "Function", i, "src/a.py") for i in [*ids, "alone"]], N)
    return PropertyGraph(nodes, spark.createDataFrame([(f"e{k}", a, b, "CALLS", 1.0, "", None) for k, (a, b) in enumerate(pairs)], E))


def rows(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


LOOPS = {
    "bfs": lambda g: traverse.bfs(g.edges, g.nodes.where("id = 'n1'").select("id"), 4),
    "impact": lambda g: traverse.impact(g, "n1", 4),
    "neighbourhood": lambda g: traverse.neighbourhood(g, "n1", 2).nodes.select("id"),
    "components": lambda g: quality.components(g.edges, g.nodes),
    "strong": lambda g: quality.strong_components(g.edges),
    "communities": lambda g: quality.communities(g),
    "pagerank": lambda g: quality.pagerank(g.edges, g.nodes),
}


@pytest.mark.parametrize("name", sorted(LOOPS))
def test_both_forms_agree(spark, name):
    for seed in (1,):
        g = graph(spark, seed)
        small = rows(LOOPS[name](g))
        spark.conf.set("cairn.local.links", "0")
        try:
            assert rows(LOOPS[name](g)) == small and small
        finally:
            spark.conf.unset("cairn.local.links")


def test_chains_of_cycles_are_all_found(spark):
    pairs = []
    for k in range(6):  # cycles of two in ascending order, each with a link to the next
        pairs += [(f"c{k:02d}a", f"c{k:02d}b"), (f"c{k:02d}b", f"c{k:02d}a"), (f"c{k:02d}b", f"c{k + 1:02d}a")]
    e = spark.createDataFrame(pairs, "source_id string, target_id string")
    want = sorted((f"c{k:02d}{x}", f"c{k:02d}a") for k in range(6) for x in "ab")
    assert rows(quality.strong_components(e)) == want
    spark.conf.set("cairn.local.links", "0")
    try:
        assert rows(quality.strong_components(e)) == want
    finally:
        spark.conf.unset("cairn.local.links")


def test_impact_paths(spark):
    nodes = spark.createDataFrame([(i, "Function", i, "p") for i in "abcd"], N)
    e = spark.createDataFrame([("1", "a", "b", "CALLS", 1.0, "", None), ("2", "b", "c", "CALLS", 1.0, "", None), ("3", "a", "c", "CALLS", 1.0, "", None), ("4", "d", "a", "CALLS", 1.0, "", None), ("5", "c", "a", "CONTAINS", 1.0, "", None)], E)
    got = {(r["direction"], r["id"]): (r["depth"], r["path"]) for r in traverse.impact_paths(PropertyGraph(nodes, e), "a").collect()}
    assert got == {("downstream", "b"): (1, ["a", "b"]), ("downstream", "c"): (1, ["a", "c"]), ("upstream", "d"): (1, ["a", "d"])}
