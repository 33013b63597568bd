"""Composite reports over the projected tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.operators import reports
from gneiss.plans.catalog import query
from gneiss.plans.projections import Tables, with_tables

#: Diffs that touch ten lines of a brand's file.
_DIFF_LINES = "SELECT 'Brand#' || b AS file_path, CAST(a + i AS BIGINT) AS line FROM range(1, 6) t(b), range(0, 10) u(i), (VALUES (41), (251)) v(a)"


def _diffs(spark):
    return spark.createDataFrame([(f"d{b}", f"--- a/Brand#{b}\n+++ b/Brand#{b}\n@@ -41,10 +41,10 @@\n@@ -251,10 +251,10 @@") for b in range(1, 6)], "diff_id string, text string")


_TOUCHED = f"lines AS ({_DIFF_LINES}), touched AS (SELECT DISTINCT qualified_name, s.file_path FROM symbols AS s JOIN lines AS l ON l.file_path = s.file_path AND line BETWEEN start_line AND end_line)"


@query("t1_detect_changes", with_tables("symbols edges", _TOUCHED + """,
u AS (SELECT file_path, count(DISTINCT source) AS n_impacted FROM touched JOIN edges ON target = qualified_name GROUP BY 1), c AS (SELECT file_path, count(*) AS n_symbols FROM touched GROUP BY 1)
||select||SELECT f.file_path, coalesce(n_symbols, 0) AS n_symbols, coalesce(n_impacted, 0) AS n_impacted, '' AS hints, CASE WHEN n_symbols >= 8 THEN 'HIGH' WHEN n_symbols >= 3 OR n_impacted > 0 THEN 'MEDIUM' ELSE 'LOW' END AS risk
FROM (SELECT DISTINCT file_path FROM lines) AS f LEFT JOIN c USING (file_path) LEFT JOIN u USING (file_path)"""))  # fmt: skip
def t1_detect_changes(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return reports.detect_changes(_diffs(spark), t.symbols, t.links)


@query("t4_diff_context", with_tables("symbols edges", _TOUCHED + """,
a AS (SELECT qualified_name, array_to_string(list_slice(list_sort(list(DISTINCT source)), 1, 5), ',') AS callers FROM touched JOIN edges ON target = qualified_name GROUP BY 1),
b AS (SELECT qualified_name, array_to_string(list_slice(list_sort(list(DISTINCT target)), 1, 5), ',') AS callees FROM touched JOIN edges ON source = qualified_name GROUP BY 1)
||select||SELECT qualified_name, file_path, coalesce(callers, '') AS callers, coalesce(callees, '') AS callees FROM touched LEFT JOIN a USING (qualified_name) LEFT JOIN b USING (qualified_name)"""))  # fmt: skip
def t4_diff_context(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return reports.diff_context(_diffs(spark), t.symbols, t.links)


@query("t2_change_impact", with_tables("recursive symbols edges", _TOUCHED + """,
up AS (SELECT target AS a, relation, source AS b FROM edges),
r(node, depth) AS (SELECT qualified_name, 0 FROM touched UNION SELECT up.b, r.depth + 1 FROM r JOIN up ON up.a = r.node WHERE r.depth < 2),
d AS (SELECT node, min(depth) AS depth FROM r GROUP BY node)
||select||SELECT file_path AS impacted_file, count(*) AS n, CAST(min(depth) AS INT) AS nearest FROM d JOIN symbols ON qualified_name = node WHERE depth > 0 GROUP BY 1"""))  # fmt: skip
def t2_change_impact(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return reports.change_impact_report(_diffs(spark), t.symbols, t.edges).select("impacted_file", "n", "nearest")


@query("t9_explain_error", with_tables("symbols edges", """
f AS (SELECT event_id || ':0' AS frame_id, 'Brand#' || (1 + event_id % 5) AS file_path, CAST(user_id AS INT) AS line, 'run' AS function FROM events),
x AS (SELECT f.*, qualified_name, coalesce(line BETWEEN start_line AND end_line, false) AS inside, row_number() OVER (PARTITION BY frame_id ORDER BY coalesce(line BETWEEN start_line AND end_line, false) DESC,
  CASE WHEN line BETWEEN start_line AND end_line THEN end_line - start_line END NULLS LAST, start_line NULLS LAST, qualified_name NULLS LAST) AS k FROM f LEFT JOIN symbols USING (file_path)),
c AS (SELECT target, count(DISTINCT source) AS callers FROM edges GROUP BY 1)
||select||SELECT frame_id, file_path, line, function, qualified_name, inside, coalesce(callers, 0) AS callers FROM x LEFT JOIN c ON target = qualified_name WHERE k = 1"""))  # fmt: skip
def t9_explain_error(spark, sf_dir):
    t = Tables(spark, sf_dir)
    text = F.concat(F.lit('Traceback\n  File "Brand#'), 1 + F.col("event_id") % 5, F.lit('", line '), "user_id", F.lit(", in run\nValueError"))
    return reports.explain_error(t.raw("events").select(F.col("event_id").alias("trace_id"), text.alias("text")), t.symbols, t.edges)



@query("t10_file_summary", with_tables("symbols", """
k AS (SELECT file_path, kind, count(*) AS n, max(end_line) AS e FROM symbols GROUP BY ALL)
||select||SELECT file_path, CAST(sum(n) AS BIGINT) AS symbols, string_agg(kind || ':' || n, ',' ORDER BY kind || ':' || n) AS kinds, max(e) AS last_line FROM k GROUP BY file_path"""))  # fmt: skip
def t10_file_summary(spark, sf_dir):
    return reports.file_summary(Tables(spark, sf_dir).symbols)


@query("t8_index_health", with_tables("files symbols edges", "SELECT 'files' AS \"table\", count(*) AS rows, '' AS warning FROM files UNION ALL SELECT 'symbols', count(*), '' FROM symbols UNION ALL SELECT 'edges', count(*), '' FROM edges UNION ALL SELECT 'chunks', 0, 'empty'"))
def t8_index_health(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return reports.index_health(t.files, t.symbols, t.edges, t.files.select(F.col("path").alias("file_path")).limit(0))


@query("t12_community_names", """WITH w AS (SELECT p_brand, unnest(list_distinct(string_split(lower(p_name), ' '))) AS w FROM part), c AS (SELECT p_brand, w, count(*) AS n FROM w GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, w) AS k FROM c)
SELECT p_brand AS community, (SELECT count(*) FROM part AS q WHERE q.p_brand = r.p_brand) AS size, string_agg(w, ' ' ORDER BY k) AS name FROM r WHERE k <= 3 GROUP BY p_brand""")  # fmt: skip
def t12_community_names(spark, sf_dir):
    return reports.community_names(Tables(spark, sf_dir).raw("part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("community"), F.col("p_name").alias("name")))


@query("x13_api_impact", """WITH w AS (SELECT 'r' || (s_nationkey % 10) AS route, 'k' || (s_suppkey % 4) AS k FROM supplier), h AS (SELECT 'r' || r AS route FROM range(0, 8) t(r) WHERE r % 2 = 1), c AS (SELECT route, count(*) AS consumers FROM w GROUP BY 1),
m AS (SELECT route, string_agg(DISTINCT k, ',' ORDER BY k) AS missing FROM w WHERE route IN (SELECT route FROM h) AND k NOT IN ('k0', 'k1') GROUP BY 1)
SELECT route, consumers, coalesce(missing, '') AS missing, CASE WHEN missing IS NULL THEN 'OK' ELSE 'MISMATCH' END AS status, CASE WHEN missing IS NOT NULL OR consumers >= 5 THEN 'HIGH' ELSE 'MEDIUM' END AS risk FROM c LEFT JOIN m USING (route)""")  # fmt: skip
def x13_api_impact(spark, sf_dir):
    consumers = Tables(spark, sf_dir).raw("supplier").select(F.concat(F.lit("r"), F.col("s_nationkey") % 10).alias("route"), F.array(F.concat(F.lit("k"), F.col("s_suppkey") % 4)).alias("keys"))
    keys = F.when(F.col("id") % 2 == 1, F.array(F.lit("k0"), F.lit("k1"))).otherwise(F.array().cast("array<string>"))
    return reports.api_impact(spark.range(8).select(F.concat(F.lit("r"), "id").alias("route"), keys.alias("keys")), consumers)
