"""The p1_ to p10_ queries and, where SQL can state them over whole tables, their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.llm import encoding, handwritten, mixing, pieces, quantiles, secrets, spans, subjects, syntax, together
from cairn.plans.runtime import table


def _t(spark, d, *names):
    return [table(spark, d, n) for n in names]


def p1_found(spark, d):
    members, options = _t(spark, d, "clone_members", "clone_options")
    return spans.shared_spans(members, spans.strict_min_tokens(options))


def p1_shared(spark, d):
    members, options = _t(spark, d, "clone_members", "clone_options")
    return spans.shared_report(members, spans.strict_min_tokens(options))


def p2_percentiles(spark, d):
    return quantiles.symbol_percentiles(table(spark, d, "complex_symbols"))


def p2_certified(spark, d):
    found = quantiles.symbol_percentiles(table(spark, d, "complex_symbols"))
    bound = F.when(F.col("q") == 0.5, quantiles.error_bound(0.5)).when(F.col("q") == 0.9, quantiles.error_bound(0.9)).otherwise(quantiles.error_bound(0.99))
    return found.select("level", "repo_id", "module", F.col("day").cast("string").alias("day"), F.round("q", 2).alias("q"), "n", F.round("avg", 4).alias("avg"), (F.col("rank_error") <= bound + 1 / F.col("n")).alias("within"))


def p3_found(spark, d):
    return together.found(table(spark, d, "commit_files"))


def p3_pairs(spark, d):
    pairs = together.coupled_files(table(spark, d, "commit_files"), max_files=None, min_shared=1)  # every pair; the floor of five is p3_found's
    return pairs.select("repo_id", F.col("item_a").alias("file_a"), F.col("item_b").alias("file_b"), F.col("baskets").alias("commits"), F.col("count_a").alias("commits_a"), F.col("count_b").alias("commits_b"), F.col("shared").alias("shared_commits"), F.round("lift", 6).alias("lift"))


def p4_found(spark, d):
    return handwritten.found(*_t(spark, d, "files", "ingestion_config"))


def p4_reasons(spark, d):
    return handwritten.classify(*_t(spark, d, "files", "ingestion_config"))


def p4_hotspot_paths(spark, d):
    return handwritten.classify_paths(table(spark, d, "file_hotspots"))


def p5_found(spark, d):
    return syntax.found(table(spark, d, "files"))


def p5_repairs(spark, d):
    return syntax.check(table(spark, d, "files"))


def p5_rates(spark, d):
    return syntax.rates(table(spark, d, "files"))


def p6_found(spark, d):
    return secrets.scan(table(spark, d, "files")).select("file_id", "line_no")


def p6_redacted(spark, d):
    return secrets.scan(table(spark, d, "files"), text=True)


def p7_found(spark, d):
    files, options = _t(spark, d, "files", "chunk_options")
    cut = pieces.split_column(files, *pieces.chunk_limits(options), text=False)
    return cut.where("piece_no = 0 and n_pieces > 1").select("file_id")


def p7_pieces(spark, d):
    files, options = _t(spark, d, "files", "chunk_options")
    return pieces.split_column(files, *pieces.chunk_limits(options))


def p8_ids(spark, d):
    return encoding.encode_column(table(spark, d, "documents"))


def p9_mix(spark, d):
    return mixing.mix(*_t(spark, d, "documents", "source_weights"))


def p9_shares(spark, d):
    docs, weights = _t(spark, d, "documents", "source_weights")
    return mixing.shares(mixing.mix(docs, weights), weights)


def p10_found(spark, d):
    return subjects.found(*_t(spark, d, "documents", "subject_labels", "subjects"))


def p10_shares(spark, d):
    assigned = p10_found(spark, d)
    each = assigned.groupBy("doc_id").agg(F.collect_list("subject").alias("s")).select(F.explode("s").alias("subject"), (1 / F.size("s")).alias("part"))
    return each.groupBy("subject").agg(F.count(F.lit(1)).alias("documents"), F.sum("part").alias("weight"))


QUERIES = {k: v for k, v in globals().items() if k[:1] == "p" and k[1:2].isdigit()}

_CLEAN = r"list_aggregate(list_filter(string_split(replace(file, '\', '/'), '/'), lambda p: p <> '' AND p <> '.'), 'string_agg', '/')"


def _pairs(limit: str, least: int, having: str, columns: str) -> str:
    return f"""
WITH r AS (SELECT DISTINCT repo_id, "commit" AS c, {_CLEAN} AS f FROM commit_files WHERE repo_id IS NOT NULL AND "commit" IS NOT NULL AND file IS NOT NULL),
z AS (SELECT repo_id, c FROM r WHERE f IS NOT NULL GROUP BY 1, 2 {limit}),
k AS (SELECT r.* FROM r JOIN z USING (repo_id, c) WHERE f IS NOT NULL),
n AS (SELECT repo_id, count(DISTINCT c) AS n FROM k GROUP BY 1),
i AS (SELECT repo_id, f, count(*) AS n FROM k GROUP BY 1, 2),
s AS (SELECT a.repo_id, a.f AS file_a, b.f AS file_b, count(*) AS s FROM k a JOIN k b ON a.repo_id = b.repo_id AND a.c = b.c AND a.f < b.f GROUP BY 1, 2, 3 HAVING count(*) >= {least})
SELECT {columns} FROM s JOIN n USING (repo_id) JOIN i x ON x.repo_id = s.repo_id AND x.f = file_a JOIN i y ON y.repo_id = s.repo_id AND y.f = file_b {having}"""


_MODULE = r"""CASE WHEN file_path IS NULL THEN NULL WHEN len(p) = 0 THEN '(root)' WHEN len(p) > 1 AND NOT contains(p[2], '.') THEN p[1] || '/' || p[2] ELSE p[1] END"""
_SUM = "SELECT '{level}' AS level, repo_id, {module} AS module, {day} AS day, count(*) AS n, round(avg(complexity), 4) AS avg FROM c GROUP BY ALL"

_SPANS = """o AS (SELECT min_tokens AS m FROM clone_options WHERE option_name = 'strict'),
w AS (SELECT run_id, member_id, i - 1 AS pos, md5(list_slice(tokens, i, i + m - 1)::VARCHAR) AS h, m FROM clone_members, o, range(1, 100000) t(i) WHERE i <= len(tokens) - m + 1),
k AS (SELECT run_id, h FROM w GROUP BY 1, 2 HAVING min(member_id) < max(member_id)),
s AS (SELECT DISTINCT member_id, pos, m FROM w JOIN k USING (run_id, h)),
g AS (SELECT *, CASE WHEN pos > coalesce(lag(pos) OVER (PARTITION BY member_id ORDER BY pos), -m - 1) + m THEN 1 ELSE 0 END AS fresh FROM s),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY member_id ORDER BY pos) AS span FROM g)"""

ORACLES = {
    "p1_found": f"""
WITH {_SPANS}
SELECT member_id, min(pos)::INT AS span_start, (max(pos) + any_value(m))::INT AS span_end FROM r GROUP BY member_id, span""",
    "p1_shared": f"""
WITH {_SPANS},
f AS (SELECT member_id, (max(pos) + any_value(m)) - min(pos) AS n FROM r GROUP BY member_id, span),
v AS (SELECT member_id, sum(n)::BIGINT AS n FROM f GROUP BY 1),
ll AS (SELECT run_id, member_id, z, md5(list_slice(tokens, i, i + z - 1)::VARCHAR) AS h FROM clone_members, (SELECT (m * 2 ** k)::INT AS z FROM o, range(0, 14) t(k)), range(1, 100000) t(i) WHERE i <= len(tokens) - z + 1),
lk AS (SELECT run_id, z, h FROM ll GROUP BY 1, 2, 3 HAVING min(member_id) < max(member_id)),
lm AS (SELECT member_id, max(z) AS z FROM ll JOIN lk USING (run_id, z, h) GROUP BY 1)
SELECT c.member_id, coalesce(len(c.tokens), 0) AS n_tokens, coalesce(v.n, 0) AS shared_tokens, CASE WHEN coalesce(len(c.tokens), 0) > 0 THEN round(coalesce(v.n, 0) / len(c.tokens), 6) ELSE 0.0 END AS shared_ratio, coalesce(lm.z, 0) AS longest_level
FROM clone_members c LEFT JOIN v USING (member_id) LEFT JOIN lm USING (member_id)""",
    "p2_certified": f"""
WITH d AS (SELECT DISTINCT run_id, repo_id, node_id, file_path, measured_at, complexity FROM complex_symbols WHERE complexity >= 1),
c AS (SELECT repo_id, complexity, measured_at::DATE AS d, {_MODULE} AS m FROM (SELECT *, list_filter(string_split(replace(file_path, '\\', '/'), '/'), lambda x: x <> '') AS p FROM d)),
a AS ({_SUM.format(level="day", module="m", day="d")} UNION ALL {_SUM.format(level="module", module="m", day="NULL::DATE")} UNION ALL {_SUM.format(level="repo", module="NULL::VARCHAR", day="NULL::DATE")})
SELECT level, repo_id, module, day::VARCHAR AS day, q, n, avg, true AS within FROM a, (VALUES (0.5::DOUBLE), (0.9::DOUBLE), (0.99::DOUBLE)) t(q)""",
    "p3_found": _pairs("HAVING count(*) <= 50", 5, "WHERE s.s * n.n >= 4 * x.n * y.n", "s.repo_id, file_a, file_b"),
    "p3_pairs": _pairs("", 1, "", "s.repo_id, file_a, file_b, n.n AS commits, x.n AS commits_a, y.n AS commits_b, s.s AS shared_commits, round(s.s * n.n / (x.n * y.n), 6) AS lift"),
    "p7_found": "SELECT file_id FROM files WHERE strlen(content) > (SELECT max_bytes FROM chunk_options WHERE option_name = 'content')",
}
