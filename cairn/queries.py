"""Queries over the engine's own operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.cypher import CypherEngine
from cairn.functions.text import module_of, path_weight, source_lines, terms
from cairn.graph import PropertyGraph, call_graph, from_star_schema
from cairn.operators import extract, history, inventory, quality, search, traverse
from cairn.plans.runtime import table
from cairn.streaming import maintain

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

NODES = """nodes AS (
SELECT 'Region:' || r_regionkey AS id, 'Region' AS label, r_name AS name, 'region/' || r_name AS file_path, r_regionkey::BIGINT AS key, NULL::DOUBLE AS amount, NULL AS kind FROM region
UNION ALL SELECT 'Nation:' || n_nationkey, 'Nation', n_name, 'nation/' || n_name, n_nationkey, NULL, NULL FROM nation
UNION ALL SELECT 'Customer:' || c_custkey, 'Customer', c_name, 'customer/' || c_mktsegment, c_custkey, c_acctbal, c_mktsegment FROM customer
UNION ALL SELECT 'Supplier:' || s_suppkey, 'Supplier', s_name, 'supplier/' || s_name, s_suppkey, s_acctbal, NULL FROM supplier
UNION ALL SELECT 'Part:' || p_partkey, 'Part', p_name, 'part/' || p_brand, p_partkey, p_retailprice, p_brand FROM part
UNION ALL SELECT 'Order:' || o_orderkey, 'Order', o_orderkey::VARCHAR, 'order/' || o_orderpriority, o_orderkey, o_totalprice, o_orderstatus FROM orders)"""
EDGES = """edges AS (
SELECT 'Nation:' || n_nationkey AS s, 'Region:' || n_regionkey AS t, 'IN_REGION' AS type, 1.0::DOUBLE AS confidence FROM nation
UNION ALL SELECT 'Customer:' || c_custkey, 'Nation:' || c_nationkey, 'IN_NATION', 1.0 FROM customer
UNION ALL SELECT 'Supplier:' || s_suppkey, 'Nation:' || s_nationkey, 'IN_NATION', 1.0 FROM supplier
UNION ALL SELECT 'Customer:' || o_custkey, 'Order:' || o_orderkey, 'PLACED', 1.0 FROM orders
UNION ALL SELECT 'Order:' || l_orderkey, 'Part:' || l_partkey, 'CONTAINS_PART', 1 - l_discount FROM lineitem
UNION ALL SELECT 'Supplier:' || l_suppkey, 'Part:' || l_partkey, 'SUPPLIES', 1 - l_discount FROM lineitem)"""
CALLS = """calls AS (SELECT DISTINCT 'Function:' || l_suppkey AS s, 'Function:' || nxt AS t FROM (
SELECT l_suppkey, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS nxt FROM lineitem) WHERE nxt IS NOT NULL)"""
_PATH = r"list_aggregate(list_filter(string_split(replace({0}, '\', '/'), '/'), lambda p: p <> '' AND p <> '.'), 'string_agg', '/')"
CHANGES = f"""changes AS (SELECT repo_id, "commit" AS c, path, lower(max(email)) AS email, max(ts) AS ts, max(coalesce(added, 0))::BIGINT AS added, max(coalesce(removed, 0))::BIGINT AS removed
FROM (SELECT *, {_PATH.format('file')} AS path FROM commit_files WHERE repo_id IS NOT NULL AND "commit" IS NOT NULL AND file IS NOT NULL) WHERE path <> '' GROUP BY 1, 2, 3)"""
_TERMS = r"list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def _add(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def _cypher(name: str, text: str, columns: list[str], sql: str, dialect: str = "std") -> None:
    """A statement on the star graph; its columns are renamed so that SQL can bear the same names."""
    _add(name, lambda s, d: CypherEngine(from_star_schema(s, d), dialect).run(text).toDF(*columns), f"WITH {NODES}, {EDGES} " + sql)


# ---- pattern language

_cypher("scan_label", "MATCH (n:Supplier) RETURN n.name, n.amount", ["name", "amount"], "SELECT name, amount FROM nodes WHERE label = 'Supplier'")
_cypher("filter_eq", "MATCH (c:Customer)-[:IN_NATION]->(n:Nation) WHERE n.name = 'NATION_3' RETURN c.name", ["name"], "SELECT c.name FROM nodes c JOIN edges e ON c.id = e.s AND e.type = 'IN_NATION' JOIN nodes n ON n.id = e.t WHERE c.label = 'Customer' AND n.label = 'Nation' AND n.name = 'NATION_3'")
_cypher("filter_neq_2vl", "MATCH (n) WHERE n.kind <> 'F' RETURN n.label, count(*) AS n", ["label", "n"], "SELECT label, count(*) AS n FROM nodes WHERE kind <> 'F' GROUP BY 1")
_cypher("filter_neq_null_b", "MATCH (n) WHERE n.kind <> 'F' RETURN count(*) AS n", ["n"], "SELECT count(*) AS n FROM nodes WHERE kind IS DISTINCT FROM 'F'", "B")
_cypher("filter_contains_starts_ends", "MATCH (n:Customer) WHERE n.name CONTAINS '1' AND n.name STARTS WITH 'C' AND NOT n.name ENDS WITH '7' RETURN n.id AS i", ["id"], "SELECT id FROM nodes WHERE label = 'Customer' AND contains(name, '1') AND starts_with(name, 'C') AND NOT suffix(name, '7')")
_cypher("filter_in", "MATCH (n:Customer) WHERE n.kind IN ['BUILDING', 'MACHINERY'] RETURN n.kind, count(*) AS n", ["kind", "n"], "SELECT kind, count(*) AS n FROM nodes WHERE label = 'Customer' AND kind IN ('BUILDING', 'MACHINERY') GROUP BY 1")
_cypher("filter_regex", "MATCH (n:Part) WHERE n.kind =~ '#[12]3' OR n.name =~ '[05]$' RETURN n.id AS i", ["id"], "SELECT id FROM nodes WHERE label = 'Part' AND (regexp_matches(kind, '#[12]3') OR regexp_matches(name, '[05]$'))")
_cypher("filter_range", "MATCH (n:Supplier) WHERE n.amount >= 0 AND n.amount < 5000.0 RETURN n.key, n.amount", ["key", "amount"], "SELECT key, amount FROM nodes WHERE label = 'Supplier' AND amount >= 0 AND amount < 5000")
_cypher("hop_in", "MATCH (n:Nation)<-[:IN_NATION]-(s:Supplier) RETURN n.name, s.name", ["nation", "supplier"], "SELECT n.name AS nation, s.name AS supplier FROM edges e JOIN nodes n ON n.id = e.t JOIN nodes s ON s.id = e.s WHERE e.type = 'IN_NATION' AND s.label = 'Supplier'")
_cypher("hop_undirected", "MATCH (n:Nation)-[]-(m) RETURN n.name, m.label, count(*) AS n", ["name", "label", "n"], "SELECT n.name, m.label, count(*) AS n FROM nodes n JOIN (SELECT s AS a, t AS b FROM edges UNION ALL SELECT t, s FROM edges) e ON n.id = e.a JOIN nodes m ON m.id = e.b WHERE n.label = 'Nation' GROUP BY 1, 2")
_cypher("hop_two", "MATCH (c:Customer)-[:IN_NATION]->(n:Nation)-[:IN_REGION]->(r:Region) RETURN r.name, count(*) AS n", ["name", "n"], "SELECT r.name, count(*) AS n FROM edges a JOIN edges b ON a.t = b.s JOIN nodes r ON r.id = b.t JOIN nodes c ON c.id = a.s WHERE a.type = 'IN_NATION' AND b.type = 'IN_REGION' AND c.label = 'Customer' GROUP BY 1")
_cypher("hop_three", "MATCH (o:Order)<-[:PLACED]-(c:Customer)-[:IN_NATION]->(n:Nation)-[:IN_REGION]->(r:Region) WHERE o.kind = 'O' RETURN r.name, sum(o.amount) AS total", ["name", "total"], "SELECT r.name, sum(o.amount) AS total FROM edges p JOIN nodes o ON o.id = p.t JOIN edges a ON a.s = p.s AND a.type = 'IN_NATION' JOIN edges b ON a.t = b.s AND b.type = 'IN_REGION' JOIN nodes r ON r.id = b.t WHERE p.type = 'PLACED' AND o.kind = 'O' GROUP BY 1")
QUERIES["hop_three"] = lambda s, d: CypherEngine(from_star_schema(s, d)).run("MATCH (o:Order)<-[:PLACED]-(c:Customer)-[:IN_NATION]->(n:Nation)-[:IN_REGION]->(r:Region) WHERE o.kind = 'O' RETURN r.name, sum(o.amount) AS total").toDF("name", "total").withColumn("total", F.round("total", 2))
ORACLES["hop_three"] = ORACLES["hop_three"].replace("sum(o.amount) AS total", "round(sum(o.amount), 2) AS total")
_cypher("hop_typed_all", "MATCH (a)-[r]->(b:Part) RETURN a.label, count(*) AS n", ["label", "n"], "SELECT a.label, count(*) AS n FROM edges e JOIN nodes a ON a.id = e.s JOIN nodes b ON b.id = e.t WHERE b.label = 'Part' GROUP BY 1")
_cypher("comma_shared_var", "MATCH (s:Supplier)-[:IN_NATION]->(n:Nation), (c:Customer)-[:IN_NATION]->(n) WHERE c.amount > 9000 RETURN s.name, c.name", ["supplier", "customer"], "SELECT s.name AS supplier, c.name AS customer FROM edges a JOIN nodes s ON s.id = a.s AND s.label = 'Supplier' JOIN edges b ON a.t = b.t AND b.type = 'IN_NATION' JOIN nodes c ON c.id = b.s AND c.label = 'Customer' WHERE a.type = 'IN_NATION' AND c.amount > 9000")
_cypher("comma_cross", "MATCH (r:Region), (n:Nation {name: 'NATION_1'}) RETURN r.name, n.name", ["region", "nation"], "SELECT r.name AS region, n.name AS nation FROM nodes r, nodes n WHERE r.label = 'Region' AND n.label = 'Nation' AND n.name = 'NATION_1'")
_cypher("prop_map", "MATCH (n:Order {kind: 'P'}) RETURN n.key", ["key"], "SELECT key FROM nodes WHERE label = 'Order' AND kind = 'P'")
_cypher("var_length_1_3", "MATCH (c:Customer)-[*1..3]->(x:Region) RETURN c.name, x.name", ["customer", "region"], "SELECT DISTINCT c.name AS customer, r.name AS region FROM nodes c JOIN edges a ON a.s = c.id AND a.type = 'IN_NATION' JOIN edges b ON b.s = a.t JOIN nodes r ON r.id = b.t WHERE c.label = 'Customer'")
_cypher("return_distinct", "MATCH (o:Order)-[:CONTAINS_PART]->(p:Part) RETURN DISTINCT o.kind, p.kind", ["status", "brand"], "SELECT DISTINCT o.kind AS status, p.kind AS brand FROM edges e JOIN nodes o ON o.id = e.s JOIN nodes p ON p.id = e.t WHERE e.type = 'CONTAINS_PART'")
_cypher("agg_count_distinct", "MATCH (s:Supplier)-[:SUPPLIES]->(p:Part) RETURN count(*) AS n, count(DISTINCT p.name) AS parts", ["n", "parts"], "SELECT count(*) AS n, count(DISTINCT p.name) AS parts FROM edges e JOIN nodes p ON p.id = e.t WHERE e.type = 'SUPPLIES'")
_cypher("agg_min_max_avg", "MATCH (n) RETURN n.label, count(n.amount) AS c, min(n.amount) AS lo, max(n.amount) AS hi", ["label", "c", "lo", "hi"], "SELECT label, count(amount) AS c, min(amount) AS lo, max(amount) AS hi FROM nodes GROUP BY 1")
_cypher("agg_counts_nulls_b", "MATCH (n) RETURN count(n.kind) AS c, count(DISTINCT n.label) AS d", ["c", "d"], "SELECT count(*) AS c, count(DISTINCT label) AS d FROM nodes", "B")
_add("agg_collect_sorted", lambda s, d: CypherEngine(from_star_schema(s, d)).run("MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN r.name, collect(n.name) AS names").toDF("name", "names").withColumn("names", F.array_join("names", ",")), f"WITH {NODES}, {EDGES} SELECT r.name, string_agg(n.name, ',' ORDER BY n.name) AS names FROM edges e JOIN nodes n ON n.id = e.s JOIN nodes r ON r.id = e.t WHERE e.type = 'IN_REGION' GROUP BY 1")
_cypher("order_limit_total", "MATCH (o:Order) RETURN o.key, o.amount ORDER BY o.amount DESC, o.key LIMIT 25", ["key", "amount"], "SELECT key, amount FROM nodes WHERE label = 'Order' ORDER BY amount DESC, key LIMIT 25")
_cypher("order_strings_a", "MATCH (n:Order) RETURN n.name ORDER BY n.name LIMIT 20", ["name"], "SELECT name FROM nodes WHERE label = 'Order' ORDER BY name::DOUBLE, name LIMIT 20", "A")
_cypher("functions", "MATCH (n:Part) RETURN n.key, size(n.name) AS a, toUpper(n.name) AS b, toLower(n.kind) AS c, coalesce(n.kind, 'x') AS d, toString(n.key) AS e", ["key", "a", "b", "c", "d", "e"], "SELECT key, strlen(name)::INT AS a, upper(name) AS b, lower(kind) AS c, coalesce(kind, 'x') AS d, key::VARCHAR AS e FROM nodes WHERE label = 'Part'")
_cypher("arithmetic", "MATCH (n:Part) RETURN n.key + 1 AS a, n.key - n.key AS b, n.name + '!' AS c", ["a", "b", "c"], "SELECT (key + 1)::DOUBLE AS a, 0::DOUBLE AS b, name || '!' AS c FROM nodes WHERE label = 'Part'")
QUERIES["arithmetic"] = lambda s, d: CypherEngine(from_star_schema(s, d)).run("MATCH (n:Part) RETURN n.key + 1 AS a, n.key - n.key AS b, n.name + '!' AS c").select(F.col("a").cast("double"), F.col("b").cast("double"), "c")

# ---- graph

_add("degree_in_out", lambda s, d: from_star_schema(s, d).degrees(), f"WITH {NODES}, {EDGES} SELECT id, coalesce(o, 0) AS out_degree, coalesce(i, 0) AS in_degree FROM nodes LEFT JOIN (SELECT s AS id, count(*) AS o FROM edges GROUP BY 1) USING (id) LEFT JOIN (SELECT t AS id, count(*) AS i FROM edges GROUP BY 1) USING (id)")
_add("label_histogram", lambda s, d: from_star_schema(s, d).nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n")), f"WITH {NODES} SELECT label, count(*) AS n FROM nodes GROUP BY 1")
_add("reltype_histogram", lambda s, d: from_star_schema(s, d).edges.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("confidence")), f"WITH {EDGES} SELECT type, count(*) AS n, round(avg(confidence), 6) AS confidence FROM edges GROUP BY 1")
_add("importance_topn", lambda s, d: traverse.importance(call_graph(s, d)).orderBy(F.desc("score"), "id").limit(50), f"WITH {CALLS} SELECT 'Function:' || s_suppkey AS id, 2.0 * (coalesce(o, 0) + coalesce(i, 0)) + CASE WHEN s_suppkey % 7 = 0 THEN 5 ELSE 0 END + CASE WHEN s_suppkey % 3 = 0 THEN 3 ELSE 0 END AS score FROM supplier LEFT JOIN (SELECT s, count(*) AS o FROM calls GROUP BY 1) ON s = 'Function:' || s_suppkey LEFT JOIN (SELECT t, count(*) AS i FROM calls GROUP BY 1) ON t = 'Function:' || s_suppkey ORDER BY score DESC, id LIMIT 50")
_add("induced_subgraph", lambda s, d: (lambda g: traverse.induced(g, g.nodes.where("key % 5 = 0").select("id")).edges.select("source_id", "target_id"))(call_graph(s, d)), f"WITH {CALLS} SELECT s AS source_id, t AS target_id FROM calls WHERE split_part(s, ':', 2)::INT % 5 = 0 AND split_part(t, ':', 2)::INT % 5 = 0")
_add("context_neighbours_topk", lambda s, d: (lambda g: traverse.neighbours(g, g.nodes.select("id"), ("CALLS",), 3))(call_graph(s, d)), f"WITH {CALLS}, b AS (SELECT s AS id, 'out' AS direction, t AS other FROM calls UNION SELECT t, 'in', s FROM calls) SELECT id, direction, 'CALLS' AS type, other FROM b QUALIFY row_number() OVER (PARTITION BY id, direction ORDER BY other) <= 3")
_BFS = "WITH RECURSIVE {calls}, w(id, depth) AS (SELECT 'Function:1', 0 UNION SELECT {to}, depth + 1 FROM w JOIN calls ON {frm} = id WHERE depth < 3), r AS (SELECT id, min(depth) AS depth FROM w GROUP BY 1)"
_add("impact_up_down", lambda s, d: traverse.impact(call_graph(s, d), "Function:1", 3), f"SELECT 'downstream' AS direction, id, depth FROM ({_BFS.format(calls=CALLS, to='t', frm='s')} SELECT * FROM r WHERE depth > 0) UNION ALL SELECT 'upstream', id, depth FROM ({_BFS.format(calls=CALLS, to='s', frm='t')} SELECT * FROM r WHERE depth > 0)")
_add("impact_affected_files", lambda s, d: (lambda g: traverse.affected_files(g, traverse.impact(g, "Function:1", 2).where("direction = 'downstream'")))(call_graph(s, d)), f"{_BFS.format(calls=CALLS, to='t', frm='s').replace('depth < 3', 'depth < 2')} SELECT 'src/n' || s_nationkey || '/f.py' AS file_path, count(*) AS symbols, min(depth) AS depth FROM r JOIN supplier ON id = 'Function:' || s_suppkey WHERE depth > 0 GROUP BY 1")
_add("neighbourhood_2", lambda s, d: traverse.neighbourhood(from_star_schema(s, d), "Region:1", 2, 100_000).nodes.select("id"), f"WITH RECURSIVE {EDGES}, u AS (SELECT s, t FROM edges UNION SELECT t, s FROM edges), w(id, depth) AS (SELECT 'Region:1', 0 UNION SELECT t, depth + 1 FROM w JOIN u ON s = id WHERE depth < 2) SELECT DISTINCT id FROM w")
_add("shortest_path_len", lambda s, d: traverse.shortest_path(from_star_schema(s, d), "Customer:1", "Supplier:1", directed=False, max_depth=4).select("depth"), f"WITH RECURSIVE {EDGES}, u AS (SELECT s, t FROM edges UNION SELECT t, s FROM edges), w(id, depth) AS (SELECT 'Customer:1', 0 UNION SELECT t, depth + 1 FROM w JOIN u ON s = id WHERE depth < 4) SELECT min(depth) AS depth FROM w WHERE id = 'Supplier:1' HAVING min(depth) IS NOT NULL")
_add("communities", lambda s, d: quality.communities(call_graph(s, d)))
_add("cohesion", lambda s, d: (lambda g: quality.cohesion(g.edges, g.nodes.select("id", F.concat(F.lit("c"), F.col("key") % 5).alias("community"))).withColumn("cohesion", F.round("cohesion", 6)))(call_graph(s, d)), f"WITH {CALLS}, e AS (SELECT 'c' || split_part(s, ':', 2)::INT % 5 AS a, 'c' || split_part(t, ':', 2)::INT % 5 AS b FROM calls), x AS (SELECT a AS community, a = b AS inn FROM e UNION ALL SELECT b, a = b FROM e) SELECT community, round(avg(inn::INT), 6) AS cohesion FROM x GROUP BY 1")
_add("process_paths", lambda s, d: quality.processes(call_graph(s, d), depth=5).withColumn("steps", F.array_join("steps", ">")))
_add("topo_levels", lambda s, d: (lambda g: quality.topo_levels(g.edges.where("type in ('IN_REGION', 'IN_NATION')"), g.nodes.where("label in ('Region', 'Nation', 'Customer', 'Supplier')")))(from_star_schema(s, d)), f"WITH {NODES}, {EDGES}, n AS (SELECT DISTINCT t FROM edges WHERE type = 'IN_NATION') SELECT id, CASE WHEN label IN ('Customer', 'Supplier') THEN 0 WHEN label = 'Nation' THEN CASE WHEN id IN (SELECT t FROM n) THEN 1 ELSE 0 END ELSE coalesce((SELECT max(CASE WHEN e.s IN (SELECT t FROM n) THEN 2 ELSE 1 END) FROM edges e WHERE e.type = 'IN_REGION' AND e.t = id), 0) END AS level FROM nodes WHERE label IN ('Region', 'Nation', 'Customer', 'Supplier')")
_add("dead_code", lambda s, d: quality.dead_code(call_graph(s, d)), f"WITH {CALLS} SELECT 'Function:' || s_suppkey AS id FROM supplier WHERE 'Function:' || s_suppkey NOT IN (SELECT t FROM calls)")
_add("coverage_by_owner", lambda s, d: quality.coverage(call_graph(s, d).nodes, ["file_path"]), "SELECT 'src/n' || s_nationkey || '/f.py' AS file_path, count(*) AS total, sum((s_suppkey % 3 = 0)::INT)::BIGINT AS traced, round(sum((s_suppkey % 3 = 0)::INT) * 100.0 / count(*), 0) AS pct FROM supplier GROUP BY 1")

# ---- retrieval


def _documents(s, d):
    return search.index(table(s, d, "documents"), "doc_id", "text")


def _bm25_sql(query: list[str]) -> str:
    terms_ = ", ".join(f"('{t}', {query.count(t)})" for t in dict.fromkeys(query))
    return f"""w AS (SELECT doc_id AS id, unnest({_TERMS.format('text')}) AS term FROM documents), l AS (SELECT doc_id AS id, len({_TERMS.format('text')}) AS len FROM documents), q(term, times) AS (VALUES {terms_}),
p AS (SELECT term, id, count(*) AS tf FROM w GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM p JOIN q USING (term) GROUP BY 1), st AS (SELECT count(*) AS n, greatest(1.0, avg(len)) AS a FROM l),
hits AS (SELECT id, sum(times * greatest(0, ln((n - df + 0.5) / (df + 0.5) + 1)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a))) AS score FROM p JOIN q USING (term) JOIN df USING (term) JOIN l USING (id), st GROUP BY 1)"""


def _bm25(s, d, text="memory leak in the parser parser"):
    return search.bm25(_documents(s, d), text)


_WORDS = "memory leak in the parser parser".split()
_add("bm25_scores", lambda s, d: _bm25(s, d).withColumn("score", F.round("score", 5)), f"WITH {_bm25_sql(_WORDS)} SELECT id, round(score, 5) AS score FROM hits")
_add("bm25_topk", lambda s, d: search.top(_bm25(s, d).withColumn("score", F.round("score", 6)), 20).select("id", "rank"), f"WITH {_bm25_sql(_WORDS)} SELECT id, rank::INT AS rank FROM (SELECT id, row_number() OVER (ORDER BY round(score, 6) DESC, id) AS rank FROM hits) WHERE rank <= 20")
_add("cosine_knn", lambda s, d: (lambda e: search.knn(e, list(e.where("vec_id = 0").first()["embedding"]), 25, key="vec_id", vector="embedding").withColumn("score", F.round("score", 6)).select("id", "score"))(table(s, d, "embeddings")), "WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0) SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]), 6) AS score FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]) DESC, vec_id LIMIT 25")
_add("rrf_fusion", lambda s, d: search.rrf({"a": search.top(_bm25(s, d, "garbage collector").withColumn("score", F.round("score", 6)), 40), "b": search.top(_bm25(s, d, "collector parser").withColumn("score", F.round("score", 6)), 40)}, 30).select("id", F.round("score", 9).alias("score"), F.array_join("sources", ",").alias("sources")), "WITH a AS (SELECT * FROM (WITH " + _bm25_sql(["garbage", "collector"]) + " SELECT id, row_number() OVER (ORDER BY round(score, 6) DESC, id) AS r FROM hits) WHERE r <= 40), b AS (SELECT * FROM (WITH " + _bm25_sql(["collector", "parser"]) + " SELECT id, row_number() OVER (ORDER BY round(score, 6) DESC, id) AS r FROM hits) WHERE r <= 40), u AS (SELECT id, r, 'a' AS s FROM a UNION ALL SELECT id, r, 'b' FROM b) SELECT id, round(sum(1.0 / (60 + r)), 9) AS score, string_agg(s, ',' ORDER BY s) AS sources FROM u GROUP BY 1 ORDER BY sum(1.0 / (60 + r)) DESC, id LIMIT 30")
_add("name_fallback_union", lambda s, d: search.with_name_fallback(s.createDataFrame([("Customer:1", 2.0)], "id string, score double"), from_star_schema(s, d).nodes, "nation_1", 20), f"WITH {NODES}, u AS (SELECT 'Customer:1' AS id, 2.0::DOUBLE AS score, 0 AS tier UNION ALL SELECT id, 0, 1 FROM nodes WHERE contains(lower(name), 'nation_1')) SELECT id, score, tier FROM u ORDER BY tier, score DESC, id LIMIT 20")
_add("resolve_target", lambda s, d: search.resolve_target(from_star_schema(s, d).nodes, "nation_2").select("id", "label"), "SELECT 'Nation:2' AS id, 'Nation' AS label")
_add("weights", lambda s, d: table(s, d, "files").select("file_id", path_weight(F.col("path")).alias("weight")), "SELECT file_id, CASE WHEN regexp_matches(lower(path), '\\.min\\.(js|css|map)|-min\\.(js|css)|[-.]vsdoc\\.js|\\.designer\\.cs|\\.g\\.cs|\\.g\\.i\\.cs|scripts/(jquery|knockout|kendo|telerik|angular|bootstrap|modernizr|moment|history)|(^|/)(packages|node_modules|bower_components|vendor|obj|bin)(/|$)|wwwroot/lib/') THEN 0.1 ELSE 1.0 END AS weight FROM files")

# ---- history

_add("hotspots", lambda s, d: history.hotspots(table(s, d, "commit_files")).select("repo_id", "path", "commits", "added", "removed", "churn", "authors", F.round("score", 6).alias("score")), f"WITH {CHANGES}, g AS (SELECT repo_id, path, count(*) AS commits, sum(added)::BIGINT AS added, sum(removed)::BIGINT AS removed, (sum(added) + sum(removed))::BIGINT AS churn, count(DISTINCT email) AS authors FROM changes GROUP BY 1, 2) SELECT *, round(CASE WHEN max(commits * churn) OVER (PARTITION BY repo_id) > 0 THEN commits * churn / max(commits * churn) OVER (PARTITION BY repo_id) ELSE 0 END, 6) AS score FROM g")
_COUPLING = "z AS (SELECT repo_id, c FROM changes GROUP BY 1, 2 HAVING count(*) <= 50), k AS (SELECT x.repo_id, x.c, x.path FROM changes x JOIN z USING (repo_id, c)), i AS (SELECT repo_id, path, count(*) AS n FROM k GROUP BY 1, 2), p AS (SELECT a.repo_id, a.path AS file_a, b.path AS file_b, count(*) AS shared FROM k a JOIN k b ON a.repo_id = b.repo_id AND a.c = b.c AND a.path < b.path GROUP BY 1, 2, 3 HAVING count(*) >= 3), cp AS (SELECT p.*, shared / greatest(x.n, y.n) AS strength FROM p JOIN i x ON x.repo_id = p.repo_id AND x.path = file_a JOIN i y ON y.repo_id = p.repo_id AND y.path = file_b)"
_add("coupling", lambda s, d: history.coupling(table(s, d, "commit_files")).withColumn("strength", F.round("strength", 6)), f"WITH {CHANGES}, {_COUPLING} SELECT repo_id, file_a, file_b, shared, round(strength, 6) AS strength FROM cp")
_OWN = "ow AS (SELECT repo_id, path, email, commits, commits * 100.0 / sum(commits) OVER (PARTITION BY repo_id, path) AS pct, count(*) OVER (PARTITION BY repo_id, path) AS authors FROM (SELECT repo_id, path, email, count(*) AS commits FROM changes WHERE email IS NOT NULL GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY repo_id, path ORDER BY commits DESC, email) = 1)"
_add("ownership", lambda s, d: history.ownership(table(s, d, "commit_files")).withColumn("pct", F.round("pct", 6)), f"WITH {CHANGES}, {_OWN} SELECT repo_id, path, email, commits, round(pct, 6) AS pct, authors FROM ow")
_HOT = "h AS (SELECT repo_id, sum((v > 0.7 * m)::INT) AS hot FROM (SELECT repo_id, v, max(v) OVER (PARTITION BY repo_id) AS m FROM (SELECT repo_id, path, count(*) * (sum(added) + sum(removed)) AS v FROM changes GROUP BY 1, 2)) GROUP BY 1)"
_add("health_grade", lambda s, d: history.health(table(s, d, "commit_files")), f"WITH {CHANGES}, {_COUPLING}, {_OWN}, {_HOT}, j AS (SELECT repo_id, round(greatest(0.0, least(100.0, 100.0 - 3 * hot - 2 * coalesce(st, 0) - 0.5 * coalesce(lo, 0))), 1)::DOUBLE AS score FROM h LEFT JOIN (SELECT repo_id, sum((strength > 0.7)::INT) AS st FROM cp GROUP BY 1) USING (repo_id) LEFT JOIN (SELECT repo_id, sum((pct < 50)::INT) AS lo FROM ow GROUP BY 1) USING (repo_id)) SELECT repo_id, score, CASE WHEN floor(score) >= 90 THEN 'A' WHEN floor(score) >= 75 THEN 'B' WHEN floor(score) >= 60 THEN 'C' WHEN floor(score) >= 40 THEN 'D' ELSE 'E' END AS grade FROM j")


def _hunks(s, d):
    m = table(s, d, "clone_members").where("member_id % 10 = 0")
    return m.select(F.concat_ws("|", "repo_id", "file_path").alias("file"), (F.col("start_line") + 2).alias("start"), (F.col("start_line") + 6).alias("end")).where("start is not null")


_add("interval_overlap_changes", lambda s, d: history.changed_symbols(_hunks(s, d), table(s, d, "clone_members").select(F.col("member_id").alias("id"), F.concat_ws("|", "repo_id", "file_path").alias("file_path"), "start_line", "end_line")).select("id"), "WITH m AS (SELECT member_id AS id, repo_id, file_path, start_line, end_line FROM clone_members) SELECT DISTINCT x.id FROM m x JOIN (SELECT * FROM m WHERE id % 10 = 0 AND start_line IS NOT NULL) h ON x.repo_id = h.repo_id AND x.file_path = h.file_path AND coalesce(x.start_line, 0) <= h.start_line + 6 AND h.start_line + 2 <= coalesce(x.end_line, 2147483647)")

# ---- quality


def _symbols(s, d):
    return table(s, d, "complex_symbols").dropDuplicates(["run_id", "repo_id", "node_id", "measured_at", "complexity"]).withColumn("complexity", F.when(F.col("complexity") > 0, F.col("complexity")))


_RANKS = "{pre} SELECT {k}, count(*) AS total, count(x) AS measured, round(avg(x), 6) AS avg, max(x) AS max, list_sort(list(x) FILTER (x IS NOT NULL))[(floor((count(x) - 1) * 0.5 + 0.5) + 1)::INT] AS p50, list_sort(list(x) FILTER (x IS NOT NULL))[(floor((count(x) - 1) * 0.9 + 0.5) + 1)::INT] AS p90, list_sort(list(x) FILTER (x IS NOT NULL))[(floor((count(x) - 1) * 0.99 + 0.5) + 1)::INT] AS p99, count(*) FILTER (x <= 5) AS low, count(*) FILTER (x > 5 AND x <= 10) AS medium, count(*) FILTER (x > 10 AND x <= 20) AS high, count(*) FILTER (x > 20) AS critical FROM s GROUP BY {k}"
_SYM = "WITH s AS (SELECT repo_id, {m} AS module, CASE WHEN complexity > 0 THEN complexity END AS x FROM (SELECT DISTINCT run_id, repo_id, node_id, measured_at, complexity, file_path, list_filter(string_split(replace(file_path, '\\', '/'), '/'), lambda x: x <> '') AS p FROM complex_symbols))"
_MOD = "CASE WHEN len(p) = 0 THEN '(root)' WHEN len(p) > 1 AND NOT contains(p[2], '.') THEN p[1] || '/' || p[2] ELSE p[1] END"
_add("complexity_percentiles", lambda s, d: quality.complexity_report(_symbols(s, d), ["repo_id"]).withColumn("avg", F.round("avg", 6)), _RANKS.format(pre=_SYM.format(m="''"), k="repo_id"))
_add("complexity_by_module", lambda s, d: quality.by_module(_symbols(s, d)).withColumn("avg", F.round("avg", 6)), _RANKS.format(pre=_SYM.format(m=_MOD), k="repo_id, module"))


def _snapshot(s, d, new: bool):
    c = table(s, d, "customer")
    return c.where("c_custkey % 10 <> 1").withColumn("c_acctbal", F.when(F.col("c_custkey") % 7 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))) if new else c.where("c_custkey % 10 <> 2")


_add("graph_diff_props", lambda s, d: quality.diff(_snapshot(s, d, False), _snapshot(s, d, True), "c_custkey").withColumn("fields", F.array_join("fields", ",")), "SELECT c_custkey, CASE WHEN c_custkey % 10 = 2 THEN 'added' WHEN c_custkey % 10 = 1 THEN 'removed' ELSE 'changed' END AS change, CASE WHEN c_custkey % 10 IN (1, 2) THEN '' ELSE 'c_acctbal' END AS fields FROM customer WHERE c_custkey % 10 IN (1, 2) OR (c_custkey % 7 = 0 AND c_acctbal IS NOT NULL)")


def _manifest(s, d, new: bool):
    f = table(s, d, "files").select(F.concat_ws("|", "repo_id", "path").alias("path"), F.col("file_id"))
    return f.where("file_id % 9 <> 1").select("path", F.when(F.col("file_id") % 5 == 0, "b").otherwise("a").alias("hash")) if new else f.where("file_id % 9 <> 2").select("path", F.lit("a").alias("hash"))


_add("manifest_diff", lambda s, d: maintain.manifest_diff(_manifest(s, d, False), _manifest(s, d, True)), "SELECT repo_id || '|' || path AS path, CASE WHEN file_id % 9 = 2 THEN 'added' WHEN file_id % 9 = 1 THEN 'removed' ELSE 'modified' END AS change FROM files WHERE file_id % 9 IN (1, 2) OR file_id % 5 = 0")

# ---- extraction

_add("todo_markers", lambda s, d: extract.todos(table(s, d, "files")).select("file_id", "line_no", "kind"), r"WITH l AS (SELECT file_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM files WHERE content IS NOT NULL), m AS (SELECT file_id, line_no::INT AS line_no, regexp_extract(line, '(?://|#|--|/\*|<!--|^\s*\*).*?\b(TODO|FIXME|HACK|XXX)\b', 1) AS kind FROM l) SELECT * FROM m WHERE kind <> ''")
_add("endpoints", lambda s, d: extract.endpoints(table(s, d, "files")))
_add("db_columns", lambda s, d: extract.tables(table(s, d, "files")))
_add("file_tree", lambda s, d: extract.file_tree(table(s, d, "files")).nodes.select("id", "label", "name"), "WITH p AS (SELECT DISTINCT string_split(path, '/') AS s FROM files), x AS (SELECT s, unnest(range(1, len(s) + 1)) AS n FROM p) SELECT DISTINCT CASE WHEN n = len(s) THEN 'File' ELSE 'Folder' END || ':' || array_to_string(s[1:n], '/') AS id, CASE WHEN n = len(s) THEN 'File' ELSE 'Folder' END AS label, s[n] AS name FROM x")
_add("mentions", lambda s, d: extract.mentions(table(s, d, "documents"), table(s, d, "clone_members").select("name")), r"WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(text, '[^\w]+')) AS name FROM documents WHERE text IS NOT NULL) SELECT doc_id, name FROM w WHERE length(name) >= 5 AND name IN (SELECT name FROM clone_members)")
_add("markdown_chunks", lambda s, d: extract.markdown_chunks(table(s, d, "documents")))
_add("document_lint", lambda s, d: extract.lint(table(s, d, "documents")))
_add("source_lines", lambda s, d: table(s, d, "files").where("content is not null").select("file_id", source_lines(F.col("content"), 2, 4).alias("lines")), "SELECT file_id, array_to_string(string_split(content, chr(10))[2:4], chr(10)) AS lines FROM files WHERE content IS NOT NULL")
_add("modules_of_files", lambda s, d: table(s, d, "files").select("file_id", module_of(F.col("path")).alias("module")), f"SELECT file_id, {_MOD} AS module FROM (SELECT file_id, list_filter(string_split(replace(path, '\\', '/'), '/'), lambda x: x <> '') AS p FROM files)")
_add("event_windows", lambda s, d: maintain.windowed_counts(table(s, d, "events"), "1 hour").select(F.col("start").cast("string").alias("start"), "event_type", "n", F.round("total", 4).alias("total")), "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
_add("term_frequencies", lambda s, d: table(s, d, "documents").select(F.explode(terms(F.coalesce("text", F.lit("")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")), f"SELECT term, count(*) AS n FROM (SELECT unnest({_TERMS.format('text')}) AS term FROM documents) GROUP BY 1")
_add("embedding_pairs", lambda s, d: (lambda e: search.nearest(e.where("vec_id % 20 = 0"), e).withColumn("best", F.round("best", 5)))(table(s, d, "embeddings")), "SELECT q.vec_id, round(max(list_cosine_similarity(q.embedding::DOUBLE[], x.embedding::DOUBLE[])), 5) AS best FROM embeddings q JOIN embeddings x ON q.vec_id <> x.vec_id WHERE q.vec_id % 20 = 0 GROUP BY 1")

# ---- inventory


def _member(g):
    return g.nodes.select("id", F.concat(F.lit("m"), (F.col("key") % 6).cast("string")).alias("module"))


_DEP = "d AS (SELECT 'm' || split_part(s, ':', 2)::INT % 6 AS source, 'm' || split_part(t, ':', 2)::INT % 6 AS target, count(*) AS n FROM calls GROUP BY 1, 2)"
_add("graph_stats", lambda s, d: inventory.stats(from_star_schema(s, d)), f"WITH {NODES}, {EDGES} SELECT 'label' AS kind, label AS name, count(*) AS n FROM nodes GROUP BY 2 UNION ALL SELECT 'type', type, count(*) FROM edges GROUP BY 2")
_add("connected_files", lambda s, d: inventory.connected_files(from_star_schema(s, d)), f"WITH {NODES}, {EDGES}, x AS (SELECT s AS id FROM edges UNION ALL SELECT t FROM edges) SELECT file_path, count(*) AS degree FROM x JOIN nodes USING (id) GROUP BY 1")
_add("symbols_per_file", lambda s, d: inventory.symbols_per_file(from_star_schema(s, d)), f"WITH {NODES} SELECT file_path, count(*) AS symbols FROM nodes WHERE file_path IS NOT NULL GROUP BY 1")
_add("module_dependencies", lambda s, d: (lambda g: inventory.module_dependencies(g, _member(g)))(call_graph(s, d)), f"WITH {CALLS}, {_DEP} SELECT * FROM d WHERE source <> target")
_add("module_stats", lambda s, d: (lambda g: inventory.module_stats(g, _member(g)))(call_graph(s, d)), f"WITH {CALLS}, {_DEP}, x AS (SELECT * FROM d WHERE source <> target) SELECT module, members, files, coalesce((SELECT sum(n) FROM x WHERE target = module), 0)::BIGINT AS calls_in, coalesce((SELECT sum(n) FROM x WHERE source = module), 0)::BIGINT AS calls_out FROM (SELECT 'm' || s_suppkey % 6 AS module, count(*) AS members, count(DISTINCT s_nationkey) AS files FROM supplier GROUP BY 1)")
_add("hub_symbol", lambda s, d: inventory.hub(call_graph(s, d)), f"WITH {CALLS} SELECT t AS id, s_name AS name, count(*) AS calls FROM calls JOIN supplier ON t = 'Function:' || s_suppkey GROUP BY 1, 2 ORDER BY calls DESC, id LIMIT 1")
_add("token_account", lambda s, d: inventory.token_account(table(s, d, "files")), "SELECT count(*) AS files, sum(b)::BIGINT AS bytes, floor(sum(b) / 4)::BIGINT AS tokens FROM (SELECT coalesce(strlen(content), size, 0) AS b FROM files)")
_add("repo_overview", lambda s, d: inventory.overview(table(s, d, "files")), "SELECT repo_id, coalesce(language, 'other') AS language, count(*) AS files, sum(coalesce(strlen(content), size, 0))::BIGINT AS bytes FROM files GROUP BY 1, 2")
_add("snapshot_summary", lambda s, d: (lambda g: inventory.snapshot_summary(PropertyGraph(g.nodes.where("key % 10 <> 2"), g.edges), PropertyGraph(g.nodes.where("key % 10 <> 1"), g.edges)))(from_star_schema(s, d)), f"WITH {NODES} SELECT label, count(*) FILTER (key % 10 <> 2) AS before, count(*) FILTER (key % 10 <> 1) AS after, count(*) FILTER (key % 10 = 2) AS added, count(*) FILTER (key % 10 = 1) AS removed FROM nodes GROUP BY 1")
_add("process_steps_renumbered", lambda s, d: inventory.renumber(table(s, d, "events").where("user_id is not null").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("process"), F.col("event_id").cast("string").alias("id"), F.col("event_id").alias("step"))), "SELECT 'u' || user_id AS process, event_id::VARCHAR AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INT AS step FROM events WHERE user_id IS NOT NULL")
_add("hits_by_process", lambda s, d: inventory.hits_by_process(table(s, d, "events").select(F.col("event_id").cast("string").alias("id"), F.col("value").alias("score")), table(s, d, "events").select(F.col("user_id").cast("string").alias("process"), F.col("event_id").cast("string").alias("id"))).select("process", F.size("hits").alias("n"), F.round("best", 6).alias("best")), "SELECT user_id::VARCHAR AS process, count(DISTINCT event_id)::INT AS n, round(max(value), 6) AS best FROM events GROUP BY 1")
_add("find_symbols", lambda s, d: inventory.find_symbols(from_star_schema(s, d).nodes, "nation_1").select("id", "name"), f"WITH {NODES} SELECT id, name FROM nodes WHERE contains(lower(name), 'nation_1') ORDER BY (lower(name) <> 'nation_1')::INT, length(name), id LIMIT 20")
_add("context_filter", lambda s, d: inventory.context_filter(from_star_schema(s, d).nodes, files=("customer/BUILDING", "nation"), labels=("Customer", "Nation")).select("id"), f"WITH {NODES} SELECT id FROM nodes WHERE label IN ('Customer', 'Nation') AND (file_path = 'customer/BUILDING' OR starts_with(file_path, 'customer/BUILDING/') OR starts_with(file_path, 'nation/'))")
_add("rename_preview", lambda s, d: inventory.rename_preview(table(s, d, "files").select(F.concat_ws("|", "repo_id", "path").alias("path"), "content"), "ledger", s.createDataFrame([], "path string, line_no int")).select("path", "line_no"), r"WITH l AS (SELECT repo_id || '|' || path AS path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1)::INT AS line_no FROM files WHERE content IS NOT NULL) SELECT path, line_no FROM l WHERE regexp_matches(line, '(^|[^A-Za-z0-9_])ledger($|[^A-Za-z0-9_])')")
_add("reading_guide", lambda s, d: (lambda g: inventory.reading_guide(inventory.module_stats(g, _member(g)).withColumn("rank", F.lit(0.5))).withColumn("score", F.round("score", 6)))(call_graph(s, d)), f"WITH {CALLS}, {_DEP}, x AS (SELECT * FROM d WHERE source <> target), q AS (SELECT module, members, files, coalesce((SELECT sum(n) FROM x WHERE target = module), 0) AS i, coalesce((SELECT sum(n) FROM x WHERE source = module), 0) AS o FROM (SELECT 'm' || s_suppkey % 6 AS module, count(*) AS members, count(DISTINCT s_nationkey) AS files FROM supplier GROUP BY 1)) SELECT module, round((0.4 * 0.5 + 0.25 * members / max(members) OVER () + coalesce(0.15 * i / nullif(max(i) OVER (), 0), 0) + coalesce(0.12 * o / nullif(max(o) OVER (), 0), 0) + 0.08 * files / max(files) OVER ())::DOUBLE, 6) AS score FROM q")


def flagship(s, d):
    """Which nations' customers sit in which region: a two-hop pattern."""
    return QUERIES["hop_two"](s, d)


__all__ = ["ORACLES", "QUERIES", "PropertyGraph", "flagship"]
