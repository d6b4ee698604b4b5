import datetime as dt

import pytest

from cairn.functions.text import cosine, module_of, path_weight, source_lines
from cairn.operators import extract, history, quality, search
from cairn.sources import snapshot
from cairn.streaming import maintain
from pyspark.sql import functions as F


def one(spark, c, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'array<double>' if isinstance(v, list) else 'string'}" for n, v in values.items())).select(c(*[F.col(n) for n in names])).first()[0]


@pytest.mark.parametrize("path, want", [("a/Scripts/jquery-1.7.1.min.js", 0.1), ("packages/x/jquery.js", 0.1), ("node_modules/react/index.js", 0.1), ("x/BAL/FactureService.cs", 1.0), ("mypackages/a.rs", 1.0), ("src/main.rs", 1.0)])
def test_path_weight(spark, path, want):
    assert one(spark, path_weight, p=path) == want


@pytest.mark.parametrize("a, b, want", [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([1.0], [-1.0], -1.0), ([], [], 0.0), ([1.0], [1.0, 2.0], 0.0), ([0.0], [0.0], 0.0)])
def test_cosine(spark, a, b, want):
    assert abs(one(spark, cosine, a=a, b=b) - want) < 1e-12


def test_text_columns(spark):
    assert [one(spark, module_of, p=p) for p in ("a/b/c.py", "a/c.py", "c.py", "", None)] == ["a/b", "a", "c.py", "(root)", None]
    assert one(spark, lambda c: source_lines(c, 2, 3), t="a\nb\nc\nd") == "b\nc" and one(spark, lambda c: source_lines(c, 3, 2), t="a") is None


def test_search(spark):
    docs = spark.createDataFrame([(1, "garbage collector"), (2, "collector collector of stamps"), (3, None), (4, "nothing here")], "doc_id long, text string")
    ix = search.index(docs, "doc_id", "text")
    top = search.top(search.bm25(ix, "garbage collector"), 5).collect()
    assert [r["id"] for r in top] == [1, 2] and [r["rank"] for r in top] == [1, 2]
    one_, two = (search.bm25(ix, q).where("id = 1").first()["score"] for q in ("garbage", "garbage garbage"))
    assert abs(two - 2 * one_) < 1e-12
    assert search.bm25(ix, "!!").count() == 0
    knn = search.knn(spark.createDataFrame([("a", [0.0, 1.0, 0.0]), ("b", [1.0, 0.0, 0.0]), ("c", [0.5, 0.5, 0.0])], "node_id string, vector array<float>"), [1, 0, 0], 3)
    assert [r["id"] for r in knn.collect()] == ["b", "c", "a"]


def test_rrf(spark):
    bm = spark.createDataFrame([("a", 1), ("b", 2)], "id string, rank int")
    sem = spark.createDataFrame([("b", 1), ("c", 2)], "id string, rank int")
    got = {r["id"]: (r["score"], r["sources"], r["rank"]) for r in search.rrf({"bm25": bm, "semantic": sem}, 5).collect()}
    assert got["b"] == (pytest.approx(1 / 62 + 1 / 61), ["bm25", "semantic"], 1) and got["a"][0] == pytest.approx(1 / 61)
    assert search.rrf({"x": spark.createDataFrame([(str(i), i) for i in range(1, 21)], "id string, rank int")}, 5).count() == 5


COMMITS = "repo_id long, commit string, author string, email string, ts timestamp, file string, added int, removed int"


def test_history(spark):
    t = dt.datetime(2030, 1, 1)
    rows = [(1, f"c{i}", "x", e, t, f, 2, 1) for i, e in enumerate(["A@x", "a@x", "b@x"]) for f in ("src/a.py", "./src//b.py")] + [(1, "c0", "x", "a@x", t, "src\\a.py", 2, 1), (1, "big", "x", "a@x", None, "src/a.py", None, None), (None, "n", "x", "e", t, "f", 1, 1)]
    df = spark.createDataFrame(rows, COMMITS)
    hot = {r["path"]: r for r in history.hotspots(df).collect()}
    assert hot["src/a.py"]["commits"] == 4 and hot["src/a.py"]["churn"] == 9 and hot["src/a.py"]["authors"] == 2 and hot["src/a.py"]["score"] == 1.0
    assert [(r["file_a"], r["file_b"], r["shared"], r["strength"]) for r in history.coupling(df).collect()] == [("src/a.py", "src/b.py", 3, 0.75)]
    own = {r["path"]: (r["email"], r["pct"]) for r in history.ownership(df).collect()}
    assert own["src/a.py"] == ("a@x", 75.0)
    assert history.health(df).first()["grade"] == "A"
    assert history.hotspots(df.limit(0)).count() == 0
    wide = spark.createDataFrame([(1, f"k{i}", "x", "e", t, f"f{j}", 1, 1) for i in range(3) for j in range(4)], COMMITS)
    assert history.coupling(wide, max_files=3).count() == 0 and history.coupling(wide, max_files=4).count() == 6


def test_changes_and_risk(spark):
    hunks = extract.parse_hunks(spark.createDataFrame([("--- a/f.py\n+++ b/f.py\n@@ -10,3 +10,5 @@\n+x\n@@ -40,0 +42,1 @@\n@@ -5,2 +5,0 @@\n--- a/g\n+++ /dev/null\n@@ -1 +1 @@",)], "diff string"))
    assert sorted((r["file"], r["start"], r["end"]) for r in hunks.collect()) == [("f.py", 10, 14), ("f.py", 42, 42)]
    syms = spark.createDataFrame([("in", "f.py", 14, 20), ("out", "f.py", 15, 41), ("open", "f.py", None, None), ("other", "g.py", 1, 99)], "id string, file_path string, start_line int, end_line int")
    assert {r["id"] for r in history.changed_symbols(hunks, syms).collect()} == {"in", "open"}
    cases = [(0, 0, 0, "none"), (1, 0, 0, "low"), (3, 0, 0, "medium"), (1, 6, 0, "medium"), (0, 0, 1, "medium"), (0, 0, 2, "high"), (0, 20, 0, "high")]
    got = spark.createDataFrame(cases, "d int, t int, p int, w string").select("w", history.risk(F.col("d"), F.col("t"), F.col("p")).alias("r")).collect()
    assert all(r["w"] == r["r"] for r in got)


def test_complexity(spark):
    df = spark.createDataFrame([(1, 3), (1, 7), (1, 25), (1, None)], "k int, complexity int")
    r = quality.complexity_report(df, ["k"]).first()
    assert (r["total"], r["measured"], r["max"], r["p50"], r["p90"], r["p99"], r["low"], r["medium"], r["high"], r["critical"]) == (4, 3, 25, 7, 25, 25, 1, 1, 0, 1)


def test_diffs(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", "n"), (3, "z", None)], "id int, p string, q string")
    b = spark.createDataFrame([(1, "x", None), (2, "y2", None), (4, "w", None)], "id int, p string, q string")
    assert sorted((r["id"], r["change"], r["fields"]) for r in quality.diff(a, b, "id").collect()) == [(2, "changed", ["p", "q"]), (3, "removed", []), (4, "added", [])]
    m = lambda rows: spark.createDataFrame(rows, "path string, hash string")
    assert sorted(tuple(r) for r in maintain.manifest_diff(m([("a", "1"), ("b", "1")]), m([("b", "2"), ("c", "1")])).collect()) == [("a", "removed"), ("b", "modified"), ("c", "added")]


def test_extraction(spark):
    files = spark.createDataFrame([(1, 1, "a.js", "javascript", "// TODO: fix it\nx = 'TODO no'\n/* HACK here */\napp.get('/users', f)\nprocess.env.API_URL"), (2, 1, ".env", None, "export API_URL=x\nUNUSED=1"), (3, 1, "s.sql", "sql", "CREATE TABLE t (id INT PRIMARY KEY, u INT REFERENCES users(id), PRIMARY KEY (id))"), (4, 1, "n", "x", None), (5, 2, "e", "x", "")], "file_id int, repo_id int, path string, language string, content string")
    assert [(r["line_no"], r["kind"], r["text"]) for r in extract.todos(files).orderBy("line_no").collect()] == [(1, "TODO", "fix it"), (3, "HACK", "here")]
    assert [tuple(r) for r in extract.endpoints(files).collect()] == [(1, "GET", "/users")]
    env = {r["name"]: (r["declared"], r["uses"]) for r in extract.env_inventory(files).collect()}
    assert env == {"API_URL": (True, 1), "UNUSED": (True, 0)}
    cols = {r["column_name"]: (r["column_type"], r["references"]) for r in extract.tables(files).collect()}
    assert cols == {"id": ("INT", None), "u": ("INT", "users")}
    tree = extract.file_tree(spark.createDataFrame([("a/b/c.py",), ("a/d.py",), ("a/d.py",), (None,)], "path string"))
    assert {r["id"] for r in tree.nodes.collect()} == {"Folder:a", "Folder:a/b", "File:a/b/c.py", "File:a/d.py"} and tree.edges.count() == 3


def test_names_and_imports(spark):
    paths = spark.createDataFrame([("src/a.py",), ("src/pkg/util.py",), ("lib/pkg/util.py",)], "path string")
    imp = extract.resolve_imports(spark.createDataFrame([("src/a.py", "pkg.util")], "file string, module string"), paths)
    assert imp.first()["target"] == "lib/pkg/util.py"
    refs = spark.createDataFrame([("src/a.py", "f"), ("src/a.py", "g"), ("src/a.py", "h")], "file string, name string")
    syms = spark.createDataFrame([("1", "f", "src/a.py"), ("2", "f", "src/b.py"), ("3", "g", "lib/pkg/util.py"), ("4", "h", "x/y.py")], "id string, name string, file_path string")
    got = {r["name"]: (r["id"], r["confidence"]) for r in extract.resolve_names(refs, syms, imp).collect()}
    assert got == {"f": ("1", 1.0), "g": ("3", 0.95), "h": ("4", 0.7)}


def test_markdown(spark):
    docs = spark.createDataFrame([(1, "intro\n\n# A\n\np1\n\np2\n\n# B\nx"), (2, None), (3, "")], "doc_id int, text string")
    got = [(r["chunk_no"], r["title"], r["content"]) for r in extract.markdown_chunks(docs, limit=4).orderBy("chunk_no").collect()]
    assert got == [(0, "", "intro"), (1, "A (part 1/2)", "p1"), (2, "A (part 2/2)", "p2"), (3, "B", "x")]
    assert extract.lint(docs).count() == 2


def test_snapshots(spark, sf, tmp_path):
    from cairn.graph import from_star_schema

    g = from_star_schema(spark, sf)
    snapshot.save(g, str(tmp_path / "s"), "v1")
    back = snapshot.load(spark, str(tmp_path / "s"))
    assert back.nodes.count() == g.nodes.count() and back.edges.count() == g.edges.count()
    snapshot.write_csv(g, str(tmp_path / "c"))
    assert snapshot.read_csv(spark, str(tmp_path / "c")).edges.count() == g.edges.count()
    assert snapshot.dot_lines(g).count() == g.nodes.count() + g.edges.count()


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    schema = "path string, content string, seq int"
    ext = lambda df: extract.file_tree(df)
    first = [("a/x.py", "1", 1), ("b/y.py", "1", 1)]
    second = [("a/x.py", None, 2), ("c/z.py", "1", 2)]
    spark.createDataFrame(first, schema).coalesce(1).write.mode("append").json(str(src))
    run = lambda: maintain.watch(spark, spark.readStream.schema(schema).json(str(src)), str(tmp_path / "g"), ext, str(tmp_path / "cp"), availableNow=True).awaitTermination()
    run()
    spark.createDataFrame(second, schema).coalesce(1).write.mode("append").json(str(src))
    run()
    got = {r["id"] for r in snapshot.load(spark, str(tmp_path / "g")).nodes.where("label = 'File'").collect()}
    assert got == {"File:b/y.py", "File:c/z.py"}


def test_entry_without_the_subpackage(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_nearest_vector_of_any_label(spark, tmp_path):
    from cairn.queries import QUERIES

    rows = [(0, [1.0, 0.0], 0), (1, [1.0, 0.0], 1), (2, [0.0, 1.0], 0), (20, [0.6, 0.8], 7), (21, [0.0, -1.0], 2)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert {r["vec_id"]: r["best"] for r in QUERIES["embedding_pairs"](spark, str(tmp_path)).collect()} == {0: 1.0, 20: 0.8}


def test_dead_code_and_hits_read_whole_tables(spark, tmp_path):
    from cairn.queries import QUERIES

    d = str(tmp_path)
    spark.createDataFrame([(i, f"s{i}", 0) for i in range(1, 6)], "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{d}/supplier.parquet")
    lines = [(o, n, 1, s, 1.0, 1.0, 0.0, 0.0, "d") for o, keys in ((1, [2, 3, 4]), (2, [3, 5])) for n, s in enumerate(keys)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_shipdate string").write.parquet(f"{d}/lineitem.parquet")
    assert {r["id"] for r in QUERIES["dead_code"](spark, d).collect()} == {"Function:1", "Function:2"}
    spark.createDataFrame([(1, 1, 0.5), (2, 2, 0.25), (3, 1, 0.75), (50, 2, 0.125)], "event_id long, user_id long, value double").write.parquet(f"{d}/events.parquet")
    assert sorted(tuple(r) for r in QUERIES["hits_by_process"](spark, d).collect()) == [("1", 2, 0.75), ("2", 2, 0.25)]
