"""Further queries with their SQL: round trips, links, extraction from made texts, and whole-graph analytics."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from cairn.cypher import CypherEngine
from cairn.graph import PropertyGraph, call_graph, from_star_schema
from cairn.operators import extract, history, inventory, linking, quality, search, traverse
from cairn.plans.runtime import shared_dir, table
from cairn.queries import CALLS, EDGES, NODES, _add, _cypher
from cairn.sources import snapshot, traces


def _file(s) -> str:
    """A fresh folder next to the cuts of a session."""
    return f"{shared_dir(s)}/made-{uuid.uuid4().hex}"


# ---- pattern language


def _roads(s, d):
    """Suppliers, nations and regions with their edges."""
    g = from_star_schema(s, d)
    e = g.typed("IN_REGION", "IN_NATION").where("source_id like 'Nation%' or source_id like 'Supplier%'")
    return PropertyGraph(g.nodes.where("label in ('Supplier', 'Nation', 'Region')"), e)



_cypher("agg_avg", "MATCH (n:Customer) RETURN n.kind, count(n.amount) AS c, avg(n.amount) AS a", ["kind", "c", "a"], "SELECT kind, count(amount) AS c, avg(amount) AS a FROM nodes WHERE label = 'Customer' GROUP BY 1")
QUERY = "MATCH (n:Customer) WHERE (n.kind = 'BUILDING' OR n.kind = 'MACHINERY') AND NOT (n.amount < 0 OR n.amount > 5000) RETURN n.id AS i"
_cypher("filter_parentheses", QUERY, ["id"], "SELECT id FROM nodes WHERE label = 'Customer' AND (kind = 'BUILDING' OR kind = 'MACHINERY') AND NOT (amount < 0 OR amount > 5000)")
_cypher("var_length_paths", "MATCH (a:Supplier)-[:IN_NATION*1..2]->(b) RETURN b.id, count(*) AS n", ["id", "n"], "SELECT t AS id, count(*) AS n FROM edges WHERE type = 'IN_NATION' AND starts_with(s, 'Supplier') GROUP BY 1")
_WALKS = "WITH {n}, {e}, k AS (SELECT row_number() OVER () AS id, s, t FROM edges WHERE type IN ('IN_REGION', 'IN_NATION') AND (starts_with(s, 'Nation') OR starts_with(s, 'Supplier'))), u AS (SELECT * FROM k UNION ALL SELECT id, t, s FROM k)"
_add("path_counts", lambda s, d: CypherEngine(_roads(s, d)).run("MATCH (a:Nation)-[*2..2]-(b:Nation) RETURN a.id, b.id, count(*) AS n").toDF("a", "b", "n"), _WALKS.format(n=NODES, e=EDGES) + " SELECT x.s AS a, y.t AS b, count(*) AS n FROM u x JOIN u y ON x.t = y.s AND x.id <> y.id WHERE starts_with(x.s, 'Nation') AND starts_with(y.t, 'Nation') GROUP BY 1, 2")
_cypher("filter_bad_regex", "MATCH (n:Region) WHERE n.name =~ '[' OR n.name = 'ASIA' RETURN n.id AS i", ["id"], "SELECT id FROM nodes WHERE label = 'Region' AND name = 'ASIA'")


def columns_named(s, d):
    df = CypherEngine(from_star_schema(s, d)).run("MATCH (n:Region) RETURN n.name, n.key AS k")
    return s.createDataFrame([(i, c) for i, c in enumerate(df.columns)], "pos int, name string")


_add("columns_named", columns_named, "SELECT * FROM (VALUES (0, 'n.name'), (1, 'k')) t(pos, name)")

# ---- sources and sinks


def _saved(s, d, csv: bool):
    g, path = from_star_schema(s, d), _file(s)
    if csv:
        snapshot.write_csv(g, path)
        return snapshot.read_csv(s, path)
    snapshot.save(g, path, "v1")
    return snapshot.load(s, path)


_BY_LABEL = f"WITH {NODES}, {EDGES} SELECT 'node' AS kind, label AS name, count(*) AS n, count(DISTINCT name) AS names FROM nodes GROUP BY 2 UNION ALL SELECT 'edge', type, count(*), count(DISTINCT s) FROM edges GROUP BY 2"


def _by_label(g):
    n = g.nodes.groupBy(F.lit("node").alias("kind"), F.col("label").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("name").alias("names"))
    return n.unionByName(g.edges.groupBy(F.lit("edge").alias("kind"), F.col("type").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source_id").alias("names")))


_add("snapshot_round_trip", lambda s, d: _by_label(_saved(s, d, False)), _BY_LABEL)
_add("csv_round_trip", lambda s, d: _by_label(_saved(s, d, True)), _BY_LABEL)
_add("dot_export", lambda s, d: snapshot.dot_lines(from_star_schema(s, d)).groupBy((F.col("line").contains(" -> ")).alias("edge")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("line")).alias("chars")), f"WITH {NODES}, {EDGES} SELECT false AS edge, count(*) AS n, sum(length(id) + length(name) + 14)::BIGINT AS chars FROM nodes UNION ALL SELECT true, count(*), sum(length(s) + length(t) + length(type) + 20)::BIGINT FROM edges")
_add("name_index", lambda s, d: from_star_schema(s, d).names(), f"WITH {NODES} SELECT name, id, count(*) OVER (PARTITION BY name) AS same FROM nodes")
_add("file_lookup", lambda s, d: from_star_schema(s, d).nodes.where("file_path = 'customer/BUILDING'").select("id", "name"), f"WITH {NODES} SELECT id, name FROM nodes WHERE file_path = 'customer/BUILDING'")


def diff_hunks(s, d):
    m = table(s, d, "clone_members").where("start_line is not null and end_line is not null")
    n = (F.col("end_line") - F.col("start_line")).cast("string")
    text = F.concat(F.lit("--- a/x\n+++ b/"), F.concat_ws("/", "repo_id", "member_id", "file_path"), F.lit("\n@@ -1,3 +"), F.col("start_line").cast("string"), F.lit(","), n, F.lit(" @@ f\n-a\n+b\n"))
    return extract.parse_hunks(m.select(text.alias("diff")))


_add("diff_hunks", diff_hunks, "SELECT repo_id || '/' || member_id || '/' || file_path AS file, start_line AS start, end_line - 1 AS \"end\" FROM clone_members WHERE start_line IS NOT NULL AND end_line IS NOT NULL AND end_line > start_line")


def trace_steps(s, d):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    o = table(s, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("file"), F.row_number().over(order).alias("n"), "l_partkey", "l_suppkey")
    one = o.select("file", F.posexplode(F.array(F.concat(F.lit("10:00 [Shop.Part"), F.col("l_partkey").cast("string"), F.lit(".Take] START x")), F.concat(F.lit("Variable 'supp' (Type: int) = "), F.col("l_suppkey").cast("string")))).alias("k", "line"), (F.col("n") * 2).alias("n"))
    lines = one.select("file", (F.col("n") + F.col("k")).alias("line_no"), "line")
    return traces.log_steps(lines).select("file", F.col("step").cast("int").alias("step"), "method", F.element_at("params", "supp").alias("supp"))


_add("trace_steps", trace_steps, "SELECT l_orderkey::VARCHAR AS file, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)::INT AS step, 'Shop.Part' || l_partkey || '.Take' AS method, l_suppkey::VARCHAR AS supp FROM lineitem")

# ---- extraction from made texts, as the tables' own files hold no routes, tables or shared names


def _route_files(s, d):
    p = table(s, d, "part")
    shape = F.element_at(F.array(*[F.lit(x) for x in ("app.get('/p%s', f)", "@app.post('/p%s')", '@DeleteMapping("/p%s")', "Route::put('/p%s', x)", '@bp.route("/p%s")')]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return p.select(F.col("p_partkey").alias("file_id"), F.concat(F.lit("x = 1\n"), F.format_string("%s", F.replace(shape, F.lit("%s"), F.col("p_partkey").cast("string"))), F.lit("\ny()\n")).alias("content"))


_add("endpoint_routes", lambda s, d: extract.endpoints(_route_files(s, d)), "SELECT p_partkey AS file_id, ['GET', 'POST', 'DELETE', 'PUT', 'ANY'][(p_partkey % 5 + 1)::INT] AS method, '/p' || p_partkey AS route FROM part")


def _schema_files(s, d):
    c = table(s, d, "supplier")
    k = F.col("s_suppkey").cast("string")
    return c.select(F.col("s_suppkey").alias("file_id"), F.concat(F.lit("-- made\nCREATE TABLE IF NOT EXISTS t"), k, F.lit(" (\n  id INT PRIMARY KEY,\n  price DECIMAL(10,2),\n  nation INT REFERENCES n"), F.col("s_nationkey").cast("string"), F.lit("(id),\n  PRIMARY KEY (id)\n);\n")).alias("content"))


_add("table_columns", lambda s, d: extract.tables(_schema_files(s, d)), "SELECT s_suppkey AS file_id, 't' || s_suppkey AS table_name, c AS column_name, CASE c WHEN 'price' THEN 'DECIMAL(10,2)' ELSE 'INT' END AS column_type, CASE c WHEN 'nation' THEN 'n' || s_nationkey END AS \"references\" FROM supplier, (VALUES ('id'), ('price'), ('nation')) t(c)")


def table_inventory(s, d):
    cols = extract.tables(_schema_files(s, d))
    return linking.table_inventory(cols.select("table_name"), cols, cols.where("references is not null"))


_add("table_inventory", table_inventory, "SELECT 't' || s_suppkey AS table_name, 3 AS columns, 1 AS foreign_keys FROM supplier")
_TITLES = r"(SELECT DISTINCT unnest(regexp_split_to_array(title, '[^A-Za-z0-9_]+')) AS name FROM documents WHERE title IS NOT NULL)"


def title_mentions(s, d):
    docs = table(s, d, "documents")
    names = docs.where("title is not null").select(F.explode(F.split("title", r"[^A-Za-z0-9_]+")).alias("name")).distinct()
    return extract.mentions(docs, names)


_add("title_mentions", title_mentions, rf"WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(text, '[^A-Za-z0-9_]+')) AS name FROM documents WHERE text IS NOT NULL) SELECT doc_id, name FROM w WHERE length(name) >= 5 AND name IN (SELECT name FROM {_TITLES})")


def page_links(s, d):
    docs = table(s, d, "documents").where("doc_id is not null")
    word = F.regexp_extract("title", r"([A-Za-z0-9_]{5,})", 1)
    names = docs.where("title is not null").select(word.alias("name"), F.col("doc_id").cast("string").alias("target")).where("name <> ''")
    return inventory.cross_references(docs.select(F.col("doc_id").cast("string").alias("page"), "text"), names)


_add("page_links", page_links, r"WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(text, '[^A-Za-z0-9_]+')) AS name FROM documents WHERE text IS NOT NULL), n AS (SELECT regexp_extract(title, '([A-Za-z0-9_]{5,})', 1) AS name, min(doc_id::VARCHAR) AS target FROM documents WHERE title IS NOT NULL GROUP BY 1) SELECT doc_id::VARCHAR AS page, name, target FROM w JOIN n USING (name) WHERE length(name) >= 5 AND doc_id::VARCHAR <> target")
_add("import_targets", lambda s, d: (lambda f: extract.resolve_imports(f.select(F.lit("main.py").alias("file"), F.regexp_replace(F.regexp_replace("path", r"\.\w+$", ""), "/", ".").alias("module")).distinct(), f.select("path")).groupBy("module").agg(F.count(F.lit(1)).alias("n")))(table(s, d, "files").where("language = 'python'").select("path").where(~F.col("path").rlike(r"(index|mod|__init__)\.\w+$|[^/]\.[^/]*\.")).distinct()), r"SELECT DISTINCT replace(regexp_replace(path, '\.\w+$', ''), '/', '.') AS module, 1 AS n FROM files WHERE language = 'python' AND NOT regexp_matches(path, '(index|mod|__init__)\.\w+$|[^/]\.[^/]*\.')")
_add("todo_report", lambda s, d: linking.sorted_todos(extract.todos(table(s, d, "files")).select("file_id", "line_no", "kind"), 100), r"WITH l AS (SELECT file_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM files WHERE content IS NOT NULL), m AS (SELECT file_id, line_no::INT AS line_no, regexp_extract(line, '(?://|#|--|/\*|<!--|^\s*\*).*?\b(TODO|FIXME|HACK|XXX)\b', 1) AS kind FROM l) SELECT * FROM m WHERE kind <> '' ORDER BY list_position(['FIXME', 'HACK', 'TODO', 'XXX'], kind), file_id, line_no LIMIT 100")

# ---- links


def call_targets(s, d):
    line = table(s, d, "lineitem")
    calls = line.select("l_orderkey", "l_quantity").groupBy(F.col("l_orderkey").alias("call_id")).agg((F.min("l_quantity").cast("int") % 7).alias("argc"))
    cand = line.select(F.col("l_orderkey").alias("call_id"), F.concat_ws(":", "l_linenumber", "l_partkey").alias("id"), F.col("l_linenumber").alias("pos"), (F.col("l_suppkey") % 3).cast("int").alias("required"), (F.col("l_suppkey") % 3 + F.col("l_partkey") % 4).cast("int").alias("params"))
    return linking.call_targets(calls, cand)


_add("call_targets", call_targets, "WITH c AS (SELECT l_orderkey AS call_id, trunc(min(l_quantity))::INT % 7 AS argc FROM lineitem GROUP BY 1), j AS (SELECT call_id, concat_ws(':', l_linenumber, l_partkey) AS id, l_linenumber AS pos, CASE WHEN argc BETWEEN l_suppkey % 3 AND l_suppkey % 3 + l_partkey % 4 THEN 0 ELSE 1 END AS misses FROM c JOIN lineitem ON l_orderkey = call_id) SELECT call_id, id FROM (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY misses, pos, id) AS n FROM j) WHERE n = 1")


def heritage_edges(s, d):
    c, n = table(s, d, "customer"), table(s, d, "nation")
    path = lambda k: F.concat(F.lit("n"), k.cast("string"), F.lit("/c.py"))
    sym = c.select(F.col("c_name").alias("id"), F.col("c_name").alias("name"), path(F.col("c_nationkey")).alias("file_path")).unionByName(n.select(F.col("n_name").alias("id"), F.col("n_name").alias("name"), F.lit("base/n.py").alias("file_path")))
    refs = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(path(F.col("c_nationkey")).alias("file"), F.col("c_name").alias("class_name"), F.col("n_name").alias("parent_name"), F.when(F.col("c_custkey") % 2 == 0, "implements").otherwise("extends").alias("kind"), F.lit(None).cast("boolean").alias("iface"))
    return linking.heritage(refs, sym, s.createDataFrame([], "file string, target string")).select("source_id", "target_id", "type")


_add("heritage_edges", heritage_edges, "SELECT c_name AS source_id, n_name AS target_id, CASE WHEN c_custkey % 2 = 0 THEN 'IMPLEMENTS' ELSE 'EXTENDS' END AS type FROM customer JOIN nation ON c_nationkey = n_nationkey")


def name_tiers(s, d):
    m = table(s, d, "clone_members").where("name is not null and file_path is not null")
    sym = m.select(F.col("member_id").cast("string").alias("id"), "name", "file_path")
    return extract.resolve_names(m.select(F.col("file_path").alias("file"), "name"), sym, s.createDataFrame([], "file string, target string")).select("file", "name", "tier", "confidence", "id")


_add("name_tiers", name_tiers, "SELECT file_path AS file, name, 1 AS tier, 1.0::DOUBLE AS confidence, min(member_id::VARCHAR) AS id FROM clone_members WHERE name IS NOT NULL AND file_path IS NOT NULL GROUP BY 1, 2")


def orphan_repair(s, d):
    c = table(s, d, "customer")
    nodes = c.select(F.concat(F.lit("File:"), F.col("c_name")).alias("id")).where("id like '%1'")
    edges = c.select(F.concat_ws("|", F.lit("e"), "c_custkey").alias("id"), F.concat(F.lit("Function:"), F.col("c_name"), F.lit(":f")).alias("source_id"), F.lit("t").alias("target_id"), F.lit("CALLS").alias("type"), F.lit(0.9).alias("confidence"), F.lit("r").alias("reason"))
    return linking.repaired_sources(PropertyGraph(nodes, edges)).select("id", "source_id", "reason")


_add("orphan_repair", orphan_repair, "SELECT DISTINCT 'calls_File:' || c_name || '_t' AS id, 'File:' || c_name AS source_id, 'repointed_orphan_source' AS reason FROM customer WHERE c_name LIKE '%1'")
_add("edge_set_diff", lambda s, d: (lambda e: linking.edge_diff(e.where("confidence > 0.95 or type <> 'SUPPLIES'"), e.where("confidence <= 0.95 or type <> 'SUPPLIES'")))(from_star_schema(s, d).edges), f"WITH {EDGES}, o AS (SELECT DISTINCT s, t, type FROM edges WHERE confidence > 0.95 OR type <> 'SUPPLIES'), n AS (SELECT DISTINCT s, t, type FROM edges WHERE confidence <= 0.95 OR type <> 'SUPPLIES') SELECT s AS source_id, t AS target_id, type, 'removed' AS change FROM (SELECT * FROM o EXCEPT SELECT * FROM n) UNION ALL SELECT s, t, type, 'added' FROM (SELECT * FROM n EXCEPT SELECT * FROM o)")


def _labelled(s, d):
    """The call graph by label: half of the functions as methods, with files to hold them."""
    g = call_graph(s, d)
    return PropertyGraph(g.nodes.withColumn("label", F.when(F.col("key") % 2 == 0, "Method").when(F.col("key") % 5 == 0, "File").otherwise("Function")), g.edges)


_add("zoom_symbols", lambda s, d: linking.zoom(_labelled(s, d), "symbol").edges.select("source_id", "target_id"), f"WITH {CALLS}, k AS (SELECT 'Function:' || s_suppkey AS id FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 5 <> 0) SELECT s AS source_id, t AS target_id FROM calls WHERE s IN (SELECT id FROM k) AND t IN (SELECT id FROM k)")
_add("endpoint_handlers", lambda s, d: (lambda g: inventory.endpoint_handlers(g.nodes.select(F.concat(F.lit("ep"), F.col("key").cast("string")).alias("id"), F.col("id").alias("handler_id")), g))(call_graph(s, d)), f"WITH {CALLS} SELECT 'ep' || s_suppkey AS id, 'Function:' || s_suppkey AS handler_id, (SELECT count(*) FROM calls WHERE t = 'Function:' || s_suppkey) AS callers, (SELECT count(*) FROM calls WHERE s = 'Function:' || s_suppkey) AS callees FROM supplier")


def _groups(g):
    return g.nodes.select("id", F.concat(F.lit("c"), F.col("key") % 5).alias("community"))


_add("community_labels", lambda s, d: (lambda g: linking.community_labels(g.nodes, _groups(g)))(call_graph(s, d)), "SELECT community, label FROM (SELECT 'c' || s_suppkey % 5 AS community, 'n' || s_nationkey AS label, row_number() OVER (PARTITION BY s_suppkey % 5 ORDER BY count(*) DESC, 'n' || s_nationkey) AS k FROM supplier GROUP BY s_suppkey % 5, s_nationkey) WHERE k = 1")
_add("features", lambda s, d: (lambda g: linking.features(_groups(g).select(F.col("community").alias("id"), F.upper("community").alias("name"), F.lit(None).cast("int").alias("symbol_count")).distinct(), _groups(g)))(call_graph(s, d)), "SELECT 'c' || s_suppkey % 5 AS id, 'C' || s_suppkey % 5 AS name, count(*) AS members FROM supplier GROUP BY 1, 2")


def _steps(s, d):
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("process"), F.concat(F.lit("Function:"), F.col("l_suppkey").cast("string")).alias("id"))


_add("process_kinds", lambda s, d: linking.process_kinds(_steps(s, d), _groups(call_graph(s, d))), "SELECT l_orderkey AS process, CASE WHEN count(DISTINCT l_suppkey % 5) <= 1 THEN 'intra_community' ELSE 'cross_community' END AS kind FROM lineitem GROUP BY 1")
_add("detect_changes", lambda s, d: linking.detect_changes(s.createDataFrame([("Function:1",), ("Function:2",)], "id string"), call_graph(s, d), _steps(s, d), 2), f"WITH RECURSIVE {CALLS}, w(id, depth) AS (SELECT * FROM (VALUES ('Function:1', 0), ('Function:2', 0)) UNION SELECT s, depth + 1 FROM w JOIN calls ON t = id WHERE depth < 2), r AS (SELECT id, min(depth) AS depth FROM w GROUP BY 1), p AS (SELECT count(DISTINCT l_orderkey) AS n FROM lineitem WHERE 'Function:' || l_suppkey IN (SELECT id FROM r)) SELECT (SELECT count(*) FROM r WHERE depth = 0) AS direct, (SELECT count(*) FROM r WHERE depth > 0) AS transitive, n AS processes, CASE WHEN n >= 2 OR (SELECT count(*) FROM r WHERE depth > 0) >= 20 THEN 'high' WHEN n >= 1 THEN 'medium' ELSE 'low' END AS risk FROM p")


def path_down(s, d):
    g = from_star_schema(s, d)
    region = table(s, d, "supplier").where("s_suppkey = 3").join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).first()["n_regionkey"]
    return traverse.shortest_path(g, "Supplier:3", f"Region:{region}", types=("IN_NATION", "IN_REGION")).select("depth", F.array_join("path", ">").alias("path"))


_add("path_down", path_down, "SELECT 2 AS depth, 'Supplier:3>Nation:' || n_nationkey || '>Region:' || n_regionkey AS path FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey = 3")
_add("impact_paths", lambda s, d: traverse.impact_paths(from_star_schema(s, d), "Nation:1", 2).select("direction", "id", "depth", F.array_join("path", ">").alias("path")), f"WITH {EDGES} SELECT 'downstream' AS direction, t AS id, 1 AS depth, s || '>' || t AS path FROM edges WHERE s = 'Nation:1' UNION ALL SELECT 'upstream', s, 1, t || '>' || s FROM edges WHERE t = 'Nation:1'")
_add("layer_skips", lambda s, d: (lambda g: quality.layer_violations(PropertyGraph(g.nodes.withColumn("label", F.when(F.col("key") % 3 == 0, "Controller").when(F.col("key") % 3 == 1, "Repository").otherwise("Service")), g.edges)))(call_graph(s, d)), f"WITH {CALLS} SELECT s AS source_id, t AS target_id FROM calls WHERE split_part(s, ':', 2)::INT % 3 = 0 AND split_part(t, ':', 2)::INT % 3 = 1")
_add("code_search", lambda s, d: inventory.search_code(_labelled(s, d), "supplier", 25).select("id", "tier"))
_add("enrichment", lambda s, d: inventory.enrichment_priority(call_graph(s, d).nodes.select("id", (F.col("key") % 10 / 10).alias("hotspot"), (F.col("key") % 7 / 10).alias("coupling"), F.lit(0.5).alias("size"), F.when(F.col("key") % 2 == 0, 1.0).alias("untested"), F.lit(0.0).alias("dead")), 100).select("id", F.round("priority", 6).alias("priority")), "SELECT id, round(p, 6) AS priority FROM (SELECT 'Function:' || s_suppkey AS id, 0.35::DOUBLE * (s_suppkey % 10 / 10) + 0.25::DOUBLE * (s_suppkey % 7 / 10) + 0.2::DOUBLE * 0.5 + CASE WHEN s_suppkey % 2 = 0 THEN 0.1::DOUBLE ELSE 0 END AS p FROM supplier) WHERE p >= 0.05 ORDER BY round(p, 9) DESC, id LIMIT 100")
_add("process_search", lambda s, d: inventory.search_processes(table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.col("p_size").alias("step_count")), "a", 50).select("id", "name"), "SELECT p_partkey AS id, p_name AS name FROM part WHERE contains(lower(p_name), 'a') OR contains(lower(coalesce(p_type, '')), 'a') ORDER BY p_size DESC, p_partkey LIMIT 50")
_add("best_hit_per_file", lambda s, d: search.best_per_file(from_star_schema(s, d).nodes.where("amount is not null").select(F.col("id").alias("nodeId"), F.col("amount").alias("score"), F.col("file_path").alias("filePath")), 1_000_000).select("nodeId", "filePath"), f"WITH {NODES} SELECT id AS \"nodeId\", file_path AS \"filePath\" FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY amount DESC, id) AS n FROM nodes WHERE amount IS NOT NULL) WHERE n = 1")
_add("health_by_repo", lambda s, d: history.health(table(s, d, "commit_files")).groupBy("grade").agg(F.count(F.lit(1)).alias("n")))

# ---- whole-graph analytics

_add("scc_cycles", lambda s, d: quality.cycle_members(call_graph(s, d).edges), f"WITH RECURSIVE {CALLS}, w(a, b) AS (SELECT s, t FROM calls UNION SELECT a, t FROM w JOIN calls ON s = b), c AS (SELECT x.a AS id, min(x.b) AS component FROM w x JOIN w y ON x.a = y.b AND x.b = y.a GROUP BY 1), n AS (SELECT component, count(*) AS length FROM c GROUP BY 1) SELECT component, id, length, CASE WHEN length <= 3 THEN 'low' WHEN length <= 6 THEN 'medium' ELSE 'high' END AS severity FROM c JOIN n USING (component)")
_RANKS = ", ".join(f"r{k} AS MATERIALIZED (SELECT id, 0.15 / n.n + 0.85 * (coalesce(g.v, 0) + (SELECT coalesce(sum(rank), 0) FROM r{k - 1} WHERE id NOT IN (SELECT s FROM calls)) / n.n) AS rank FROM r{k - 1} LEFT JOIN (SELECT t, sum(rank / o.n) AS v FROM r{k - 1} JOIN calls ON s = id JOIN o USING (s) GROUP BY 1) g ON g.t = id, n)" for k in range(1, 25))
_add("module_pagerank", lambda s, d: (lambda g: quality.pagerank(g.edges, g.nodes).withColumn("rank", F.round("rank", 9)))(call_graph(s, d)), f"WITH {CALLS}, n AS (SELECT count(*)::DOUBLE AS n FROM supplier), o AS (SELECT s, count(*)::DOUBLE AS n FROM calls GROUP BY 1), r0 AS (SELECT 'Function:' || s_suppkey AS id, 1.0::DOUBLE / n.n AS rank FROM supplier, n), {_RANKS} SELECT id, round(rank, 9) AS rank FROM r24")
_add("weak_components", lambda s, d: (lambda g: quality.components(g.edges.where("type = 'IN_REGION'"), g.nodes.where("label in ('Region', 'Nation')").select("id")))(from_star_schema(s, d)), "WITH e AS (SELECT 'Nation:' || n_nationkey AS a, 'Region:' || n_regionkey AS b FROM nation), c AS (SELECT b, min(a) AS component FROM e GROUP BY 1) SELECT a AS id, component FROM e JOIN c USING (b) UNION ALL SELECT b, component FROM c UNION ALL SELECT 'Region:' || r_regionkey, 'Region:' || r_regionkey FROM region WHERE 'Region:' || r_regionkey NOT IN (SELECT b FROM c)")
_CLONES = """WITH RECURSIVE o AS (SELECT DISTINCT run_id, member_id, tokens, list_distinct(tokens) AS ts FROM clone_members WHERE len(tokens) >= 30 AND run_id IS NOT NULL),
h AS (SELECT DISTINCT run_id, member_id, md5(list_slice(tokens, i, i + 29)::VARCHAR) AS h FROM o, range(1, 100000) t(i) WHERE i <= len(tokens) - 29),
p AS (SELECT DISTINCT x.run_id, x.member_id AS a, y.member_id AS b FROM h x JOIN h y ON x.run_id = y.run_id AND x.h = y.h AND x.member_id < y.member_id),
l AS (SELECT p.run_id, a, b FROM p JOIN o x ON x.member_id = a AND x.run_id = p.run_id JOIN o y ON y.member_id = b AND y.run_id = p.run_id WHERE len(list_intersect(x.ts, y.ts)) / len(list_distinct(list_concat(x.ts, y.ts))) >= 0.9),
u AS (SELECT run_id, a, b FROM l UNION SELECT run_id, b, a FROM l),
w(run_id, id, root) AS (SELECT run_id, a, a FROM u UNION SELECT w.run_id, u.b, w.root FROM w JOIN u ON u.run_id = w.run_id AND u.a = w.id),
c AS (SELECT run_id, id, min(root) AS cluster FROM w GROUP BY 1, 2)
SELECT run_id, cluster, id AS member_id, count(*) OVER (PARTITION BY run_id, cluster) AS size FROM c"""
_add("clone_clusters", lambda s, d: quality.clone_members(table(s, d, "clone_members")).select("run_id", "cluster", "member_id", "size"), _CLONES)

_USES = r"""\b(?:getenv|Getenv|LookupEnv|GetEnvironmentVariable|readEnv|env::var|env::var_os|environ\.get|ENV\.fetch)\(\s*["''`]([^"''`\n]+)["''`]"""
_add("env_inventory", lambda s, d: extract.env_inventory(table(s, d, "files")), rf"""
WITH d AS (SELECT DISTINCT repo_id, unnest(regexp_extract_all(content, '(?m)^[ \t]*(?:export[ \t]+)?([A-Za-z][\w.\-]*)[ \t]*=', 1)) AS name FROM files WHERE content IS NOT NULL AND language IS NULL AND regexp_matches(path, '\.(env|properties)$|(^|/)\.env$')),
u AS (SELECT repo_id, name, count(*) AS uses FROM (SELECT repo_id, unnest(regexp_extract_all(content, '{_USES}', 1)) AS name FROM files WHERE content IS NOT NULL AND language IS NOT NULL) GROUP BY 1, 2)
SELECT coalesce(d.repo_id, u.repo_id) AS repo_id, coalesce(d.name, u.name) AS name, d.name IS NOT NULL AS declared, coalesce(uses, 0) AS uses FROM d FULL JOIN u ON d.repo_id = u.repo_id AND d.name = u.name""")
