from cairn.graph import PropertyGraph
from cairn.operators import inventory

E = "id string, source_id string, target_id string, type string, confidence double, reason string, step int"


def test_handlers_and_references(spark):
    nodes = spark.createDataFrame([("h", "Method", "handle"), ("c", "Method", "caller"), ("d", "Method", "dd")], "id string, label string, name string")
    edges = spark.createDataFrame([("1", "ep1", "h", "HANDLED_BY", 1.0, "", None), ("2", "c", "h", "CALLS", 1.0, "", None), ("3", "h", "d", "CALLS", 1.0, "", None)], E)
    eps = spark.createDataFrame([("ep1", None), ("ep2", "d"), ("ep3", None)], "id string, handler_id string")
    got = {r["id"]: (r["handler_id"], r["callers"], r["callees"]) for r in inventory.endpoint_handlers(eps, PropertyGraph(nodes, edges)).collect()}
    assert got == {"ep1": ("h", 1, 1), "ep2": ("d", 1, 0), "ep3": (None, 0, 0)}
    pages = spark.createDataFrame([("p1", "see InvoiceService and run"), ("p2", "InvoiceService InvoiceService"), ("p3", None)], "page string, text string")
    links = inventory.cross_references(pages, spark.createDataFrame([("InvoiceService", "p2"), ("run", "p1")], "name string, target string"))
    assert [tuple(r) for r in links.collect()] == [("p1", "InvoiceService", "p2")]
    assert inventory.backlinks(links).first()["pages"] == ["p1"]


def test_rename_and_processes(spark):
    files = spark.createDataFrame([("a", "x foo\nfoobar\nfoo(foo)"), ("b", None)], "path string, content string")
    got = sorted(tuple(r) for r in inventory.rename_preview(files, "foo", spark.createDataFrame([("a", 3)], "path string, line_no int")).collect())
    assert got == [("a", 1, False), ("a", 3, True)]
    ps = spark.createDataFrame([("p", "Login flow", None, 4), ("q", "x", "does login", 9), ("r", "z", "", 1)], "id string, name string, description string, step_count int")
    assert [r["id"] for r in inventory.search_processes(ps, "LOGIN").collect()] == ["q", "p"]
    pri = inventory.enrichment_priority(spark.createDataFrame([("a", 1.0, None, 0.5, 0.0, 0.0), ("b", 0.1, 0.0, 0.0, 0.0, 0.0)], "id string, hotspot double, coupling double, size double, untested double, dead double")).collect()
    assert [(r["id"], round(r["priority"], 3)) for r in pri] == [("a", 0.45)]


def test_traces(spark):
    from cairn.sources import traces

    lines = ["noise", "[Shop.Cart.Add] START", "Variable 'id' (Type: int) = 7", "Variable 'id' (Type: int) = 8", "[y] RESULT | ok", "z ===== EF INSERT ===== INSERT INTO t", "Variable 'lost' (Type: int) = 1", "10:00 [Shop.Pay] START "]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line_no int, line string")
    steps = traces.log_steps(df)
    got = [(r["step"], r["method"], r["params"]) for r in steps.orderBy("step").collect()]
    assert got == [(1, "Shop.Cart.Add", {"id": "8", "return_value": "ok"}), (2, "Database.Insert", None), (3, "Shop.Pay", {})]
    nodes = spark.createDataFrame([("1", "Add", "src/Other.cs"), ("2", "Add", "src/Cart.cs")], "id string, name string, file_path string")
    assert {r["step"]: r["id"] for r in traces.resolve_steps(steps, nodes).collect()} == {1: "2", 2: None, 3: None}


def test_names_ranks_and_cycles(spark):
    from pyspark.sql import functions as F

    from cairn.functions.text import entry_score
    from cairn.operators import quality, search

    names = spark.createDataFrame([("main",), ("handleClick",), ("on_load",), ("once",), ("getUser",), ("other",), (None,)], "n string")
    assert [r[0] for r in names.select(entry_score(F.col("n"))).collect()] == [1.0, 0.7, 0.5, None, 0.15, None, None]
    hits = spark.createDataFrame([("a", 1, 0.1), ("b", 2, 0.9), ("c", 3, 9.0)], "id string, rank int, s double")
    assert [r["id"] for r in search.rerank(hits, F.col("s"), 2).orderBy("rank").collect()] == ["b", "a", "c"]
    edges = spark.createDataFrame([(f"{a}{b}", a, b, "IMPORTS", 1.0, "", None) for a, b in ("ab", "ba", "bc", "ca", "dd", "ef")], E)
    g = PropertyGraph(spark.createDataFrame([("a",)], "id string"), edges)
    assert sorted(r["nodes"] for r in quality.file_cycles(g).collect()) == [["a", "b"], ["a", "b", "c"], ["d"]]


def test_search_code_keeps_one_row_a_file(spark):
    rows = [("a", "Function", "parse token", "src/x.py"), ("b", "Function", "token", "src/x.py"), ("c", "Function", "emit token now", "src/y.py"), ("d", "Class", "Tokenizer", "src/z.py"), ("e", "Function", "other", "src/w.py"), ("f", "Function", "token", None)]
    n = spark.createDataFrame(rows, "id string, label string, name string, file_path string")
    g = PropertyGraph(n, spark.createDataFrame([], "id string, source_id string, target_id string, type string, confidence double, reason string, step int"))
    got = [(r["id"], r["tier"]) for r in inventory.search_code(g, "token", 10).collect()]
    assert [t for _, t in got] == sorted(t for _, t in got) and {i for i, _ in got} >= {"c", "d", "f"} and len({i for i, _ in got} & {"a", "b"}) == 1 and ("d", 1) in got
    v = spark.createDataFrame([("c", [1.0, 0.0]), ("e", [0.9, 0.1])], "node_id string, vector array<double>")
    both = {r["id"] for r in inventory.search_code(g, "token", 10, vectors=v, query=[1.0, 0.0]).collect()}
    assert {"c", "e"} <= both
