import pytest

from cairn.cypher import CypherEngine, CypherError, is_write_query, parse
from cairn.graph import PropertyGraph


@pytest.fixture(scope="module")
def graph(spark):
    nodes = spark.createDataFrame(
        [("F:a", "Function", "handleLogin", "src/auth.ts", 10, 30, True), ("F:b", "Function", "validateToken", "src/auth.ts", 35, 50, False), ("C:u", "Class", "UserService", "src/user.ts", 1, 100, None), ("F:g", "Function", "getUser", "src/user.ts", 50, 70, True)],
        "id string, label string, name string, file_path string, start_line int, end_line int, is_exported boolean",
    )
    edges = spark.createDataFrame([("r1", "F:a", "F:b", "CALLS", 1.0, "exact", None), ("r2", "F:a", "F:g", "CALLS", 0.9, "fuzzy", None), ("r3", "C:u", "F:g", "HAS_METHOD", 1.0, "ast", None)], "id string, source_id string, target_id string, type string, confidence double, reason string, step int")
    return PropertyGraph(nodes, edges)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(
    "text, want",
    [
        ("MATCH (n:Function) RETURN n.name", [("getUser",), ("handleLogin",), ("validateToken",)]),
        ("MATCH (n:Function) WHERE n.name = 'handleLogin' RETURN n", [("F:a",)]),
        ("MATCH (n:Function) WHERE n.name CONTAINS 'handle' RETURN n.name", [("handleLogin",)]),
        ("MATCH (n)-[:CALLS]->(m) WHERE n.name='handleLogin' RETURN m.name", [("getUser",), ("validateToken",)]),
        ("MATCH (m)<-[:CALLS]-(n) RETURN m.name", [("getUser",), ("validateToken",)]),
        ("MATCH (n:Function) RETURN count(n) AS total", [(3,)]),
        ("MATCH (n:Function) WHERE n.isExported = true AND NOT n.name STARTS WITH 'get' RETURN n.name", [("handleLogin",)]),
        ("MATCH (n) WHERE n.name = 'x' OR n.label = 'Class' AND n.start_line < 5 RETURN n.name", [("UserService",)]),
        ("MATCH (n {name: 'getUser'}) RETURN n.startLine + 1 AS s", [(51.0,)]),
        ("MATCH (n) WHERE n.name =~ '^(get|val)' RETURN n.name", [("getUser",), ("validateToken",)]),
        ("MATCH (n) WHERE n.start_line IN [1, 10] RETURN n.name", [("UserService",), ("handleLogin",)]),
        ("MATCH (c:Class)-[:HAS_METHOD]->(f), (g)-[:CALLS]->(f) RETURN g.name, f.name", [("handleLogin", "getUser")]),
        ("MATCH (n)-[*1..2]->(m) RETURN DISTINCT n.name, m.name", [("UserService", "getUser"), ("handleLogin", "getUser"), ("handleLogin", "validateToken")]),
        ("MATCH (n:Nothing) RETURN n.name", []),
        ("MATCH (n)-[:NOTHING]->(m) RETURN n.name", []),
        ("MATCH (n)-[]->() RETURN n.name", [("UserService",), ("handleLogin",), ("handleLogin",)]),
        ("MATCH (n) WHERE n.nope = 1 RETURN n.name", []),
    ],
)
def test_statements(graph, text, want):
    assert rows(CypherEngine(graph).run(text)) == sorted(want)


def test_order_limit_and_names(graph):
    df = CypherEngine(graph).run("MATCH (n:Function) RETURN n.name ORDER BY n.start_line DESC LIMIT 2")
    assert df.columns == ["n.name"] and [r[0] for r in df.collect()] == ["getUser", "validateToken"]


def test_null_semantics(graph):
    text = "MATCH (n) WHERE n.is_exported <> true RETURN n.name"
    assert rows(CypherEngine(graph).run(text)) == [("validateToken",)]
    assert rows(CypherEngine(graph, "B").run(text)) == [("UserService",), ("validateToken",)]
    assert rows(CypherEngine(graph, "B").run("MATCH (n) RETURN count(n.is_exported) AS c")) == [(4,)]
    assert rows(CypherEngine(graph).run("MATCH (n) RETURN count(n.is_exported) AS c")) == [(3,)]
    assert rows(CypherEngine(graph).run("MATCH (n) WHERE NOT n.is_exported = true RETURN n.name")) == [("UserService",), ("validateToken",)]


def test_multi_edges_are_a_bag_and_distinct_in_b(spark, graph):
    twice = PropertyGraph(graph.nodes, graph.edges.unionByName(graph.edges.selectExpr("concat(id, 'x') as id", "source_id", "target_id", "type", "confidence", "reason", "step")))
    text = "MATCH (a)-[:CALLS]->(b) RETURN b.name"
    assert len(rows(CypherEngine(twice).run(text))) == 4
    assert len(rows(CypherEngine(twice, "B").run(text))) == 2


def test_call_finds_by_text(graph):
    assert CypherEngine(graph).run("CALL QUERY_FTS_INDEX('fts_Function', 'handleLogin')").first()["name"] == "handleLogin"
    assert rows(CypherEngine(graph, "B").run("CALL QUERY_FTS_INDEX('x', 'user')").select("name")) == [("UserService",), ("getUser",)]


@pytest.mark.parametrize("bad", ["MATCH (n) DELETE n", "CREATE (n)", "MATCH (n) RETURN n LIMIT x", "MATCH (n RETURN n", "MATCH (n) RETURN n extra", "RETURN 1", "MATCH (n) RETURN nope(n)"])
def test_rejected(graph, bad):
    with pytest.raises(CypherError):
        CypherEngine(graph).run(bad)


def test_guard_reads_literals_and_comments():
    assert not is_write_query("MATCH (n) WHERE n.name = 'DELETE x' RETURN n // CREATE (")
    assert is_write_query("match (n) set n.x = 1 return n")
    assert parse("MATCH (n) WHERE n.a = 'it\\'s' RETURN n").where[2] == ("lit", "it's")


def test_paths_types_and_patterns(spark):
    n = spark.createDataFrame([(i, "Function", i, "p") for i in "abc"], "id string, label string, name string, file_path string")
    e = spark.createDataFrame([("1", "a", "b", "CALLS", 1.0, "", None), ("2", "b", "a", "CALLS", 1.0, "", None), ("3", "b", "c", "USES", 1.0, "", None)], "id string, source_id string, target_id string, type string, confidence double, reason string, step int")
    g = PropertyGraph(n, e)
    run = lambda q, d="std": sorted(tuple(r) for r in CypherEngine(g, d).run(q).collect())
    # one row a path without a repeated edge: a>b, a>b>a, a>b>c
    assert run("MATCH (x:Function)-[*1..3]->(y:Function) WHERE x.name = 'a' RETURN y.name") == [("a",), ("b",), ("c",)]
    assert run("MATCH (x:Function)-[:NO_SUCH]->(y:Function) RETURN y.name") == []
    assert len(run("MATCH (x:Function)-[:NO_SUCH]->(y:Function) RETURN y.name", "A")) == 3
    assert run("MATCH (x:Function) WHERE x.name =~ '[' RETURN x.name") == []
