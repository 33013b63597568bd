"""Queries of the table store: reads by key, writes, processes, leading lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.functions import scalar as S
from gneiss.operators import store
from gneiss.plans.catalog import query
from gneiss.plans.projections import Tables, with_tables


@query("b1_file_symbols", with_tables("symbols", "SELECT qualified_name, file_path, start_line FROM symbols WHERE file_path IN (SELECT DISTINCT p_brand FROM part WHERE p_size > 40)"))
def b1_file_symbols(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return store.of_files(t.symbols, t.raw("part").where("p_size > 40").select(F.col("p_brand").alias("path"))).select("qualified_name", "file_path", "start_line")


@query("j5_symbol_info", with_tables("symbols edges", "SELECT w.name, file_path, start_line, kind FROM (SELECT DISTINCT target || CASE WHEN length(target) % 2 = 0 THEN '' ELSE '?' END AS name FROM edges) w LEFT JOIN symbols ON w.name = qualified_name"))
def j5_symbol_info(spark, sf_dir):
    t = Tables(spark, sf_dir)
    names = t.edges.select(F.concat("target", F.when(F.length("target") % 2 == 0, "").otherwise("?")).alias("name"))
    out = store.symbol_info(t.symbols.select("qualified_name", "file_path", "start_line", "kind"), names)
    return out


@query("b2_inserts", """WITH n AS (SELECT o_custkey AS k, min(struct_pack(a := o_orderstatus, b := o_orderkey)) AS r FROM orders GROUP BY 1)
SELECT c_custkey AS k, 'old' AS status, c_custkey + 1 AS v FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT k, r.a, r.b FROM n WHERE k NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)""")  # fmt: skip
def b2_inserts(spark, sf_dir):
    """Rows of new keys join the table; the first stays."""
    t = Tables(spark, sf_dir)
    old = t.raw("customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.lit("old").alias("status"), (F.col("c_custkey") + 1).alias("v"))
    return store.inserted(old, t.raw("orders").select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("v")), ["k"])


@query("b3_resolved_findings", "SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, CASE WHEN l_suppkey % 3 = 0 THEN 'resolved' ELSE l_linestatus END AS status FROM lineitem")
def b3_resolved_findings(spark, sf_dir):
    t = Tables(spark, sf_dir)
    findings = t.raw("lineitem").select(F.col("l_suppkey").cast("string").alias("file_path"), "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", F.col("l_linestatus").alias("status"))
    return store.resolved_findings(findings, t.raw("supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").cast("string").alias("path"))).select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "status")


def _processes(t):
    """A process for each conversation: its symbols in order, and a path for each."""
    per = t.steps.groupBy("process_id").agg(F.sort_array(F.collect_list(F.struct("step", "symbol"))).alias("s"))
    return per.select("process_id", F.transform("s", lambda x: x.symbol).alias("steps"), F.transform("s", lambda x: F.concat(F.lit("m"), x.step, F.lit("/"), x.symbol)).alias("file_paths"))


_P = "hit AS (SELECT DISTINCT process_id FROM steps WHERE step = 3 AND symbol LIKE 'user.%' AND process_id % 4 = 0)"


@query("b4_process_cascade", with_tables("steps", f"""{_P}, l AS (SELECT a.process_id AS x, b.process_id AS y FROM (SELECT DISTINCT process_id FROM steps) a JOIN (SELECT DISTINCT process_id FROM steps) b ON b.process_id = a.process_id + 1)
||select||SELECT 'processes' AS what, count(*) AS n FROM (SELECT DISTINCT process_id FROM steps) WHERE process_id NOT IN (SELECT process_id FROM hit) UNION ALL SELECT 'members', count(*) FROM steps WHERE process_id NOT IN (SELECT process_id FROM hit)
UNION ALL SELECT 'links', count(*) FROM l WHERE x NOT IN (SELECT process_id FROM hit) AND y NOT IN (SELECT process_id FROM hit)"""))  # fmt: skip
def b4_process_cascade(spark, sf_dir):
    t = Tables(spark, sf_dir)
    processes = _processes(t)
    ids = processes.select("process_id")
    links = ids.select(F.col("process_id").alias("left_id"), (F.col("process_id") + 1).alias("right_id")).join(ids.withColumnRenamed("process_id", "right_id"), "right_id", "left_semi")
    files = t.steps.where("step = 3 and symbol like 'user.%' and process_id % 4 = 0").select(F.concat(F.lit("m3/"), "symbol").alias("path"), "process_id")
    # Paths are shared by conversations: each gets its own.
    own = processes.withColumn("file_paths", F.transform("file_paths", lambda x: F.concat("process_id", F.lit(":"), x)))
    left = store.without_processes(own, store.memberships(processes), links, files.select(F.concat("process_id", F.lit(":"), "path").alias("path")))
    out = [x.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n") for name, x in zip(("processes", "members", "links"), left, strict=True)]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("b5_memberships", with_tables("steps", """
r AS (SELECT process_id, symbol, CAST(row_number() OVER (PARTITION BY process_id ORDER BY step, symbol) - 1 AS INT) AS step_index, count(*) OVER (PARTITION BY process_id) AS n FROM steps)
||select||SELECT process_id, symbol, step_index, CASE WHEN step_index = 0 THEN 'entry' WHEN step_index = n - 1 THEN 'terminal' ELSE 'intermediate' END AS role FROM r"""))  # fmt: skip
def b5_memberships(spark, sf_dir):
    return store.memberships(_processes(Tables(spark, sf_dir)))


@query("b31_flow_files", """WITH o AS (SELECT o_orderkey, [('c' || o_custkey), ('o' || o_orderkey)] AS steps, c_mktsegment AS a, o_orderstatus AS b FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT o_orderkey AS process_id, CASE WHEN a < b THEN a || ',' || b ELSE b || ',' || a END AS files FROM o""")  # fmt: skip
def b31_flow_files(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = t.raw("orders").select(F.col("o_orderkey").alias("process_id"), F.array(F.concat(F.lit("c"), "o_custkey"), F.concat(F.lit("o"), "o_orderkey")).alias("steps"))
    return store.process_files(rows, t.symbols).select("process_id", "files")


@query("b7_relation_scan", with_tables("edges", "SELECT relation, count(*) AS n FROM edges WHERE relation IN ('CALLS', 'EXTENDS') GROUP BY relation"))
def b7_relation_scan(spark, sf_dir):
    return store.relation_scan(Tables(spark, sf_dir).edges, ["CALLS", "EXTENDS"]).groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


@query("f14_compact_view", with_tables("symbols", "SELECT name, file_path, kind FROM symbols"))
def f14_compact_view(spark, sf_dir):
    return store.view(Tables(spark, sf_dir).symbols, "compact")


@query("b31_entry_order", """WITH c AS (SELECT s_nationkey AS root, 's' || s_suppkey AS symbol, CASE WHEN s_suppkey % 7 = 0 THEN 2 WHEN s_suppkey % 5 = 0 THEN 0 ELSE 1 END AS r, s_suppkey % 3 AS fan_in, s_suppkey % 4 AS fan_out FROM supplier)
SELECT root, symbol, CAST(row_number() OVER (PARTITION BY root ORDER BY r, fan_out DESC, fan_in, symbol) AS INT) AS position FROM c""")  # fmt: skip
def b31_entry_order(spark, sf_dir):
    k = F.col("s_suppkey")
    rows = Tables(spark, sf_dir).raw("supplier").select(F.col("s_nationkey").alias("root"), F.concat(F.lit("s"), k).alias("symbol"), F.when(k % 7 == 0, "src/tests/a.py").otherwise("src/a.py").alias("file_path"), F.when(k % 5 == 0, "route_entrypoint").otherwise("service").alias("role"), (k % 3).alias("fan_in"), (k % 4).alias("fan_out"))
    return store.entry_order(rows).select("root", "symbol", "position")


@query("c3_leading_lines", "SELECT 'f' || p_partkey AS file_path, 'g' AS qualified_name, CAST(CASE p_partkey % 5 WHEN 0 THEN 5 WHEN 1 THEN 3 WHEN 2 THEN 4 WHEN 3 THEN 2 ELSE 1 END AS INT) AS first_line FROM part")
def c3_leading_lines(spark, sf_dir):
    k = F.col("p_partkey")
    lead = F.array(*[F.lit(x) for x in ("x = 1\n# a\n\ny = 2\n", "x = 1\n\n# a\n  // b\n", "\n# a\nz\n@decorated\n", "x\n/* a\n * b\n'''c\n", "# a\n@b\n# c\n@d(1)\n")])[(k % 5).cast("int")]
    rows = Tables(spark, sf_dir).raw("part").select(F.concat(F.lit("f"), k).alias("path"), F.concat(lead, F.lit("def g(): pass")).alias("text"))
    return store.leading_lines(rows.select(F.col("path").alias("file_path"), F.lit("g").alias("qualified_name"), F.lit(5).alias("start_line")), rows)


@query("b37_unique_capped", "SELECT l_orderkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:3], ',') AS first FROM (SELECT l_orderkey, list_filter(list(trim(CASE WHEN l_linenumber = 2 THEN ' ' ELSE ' ' || l_returnflag || l_suppkey % 3 || ' ' END) ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag), lambda x: x <> '') AS l FROM lineitem GROUP BY l_orderkey)")
def b37_unique_capped(spark, sf_dir):
    text = F.when(F.col("l_linenumber") == 2, " ").otherwise(F.concat(F.lit(" "), "l_returnflag", (F.col("l_suppkey") % 3).cast("string"), F.lit(" ")))
    rows = Tables(spark, sf_dir).raw("lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", text.alias("t")))).alias("l"))
    return rows.select("l_orderkey", F.array_join(S.unique_capped(F.transform("l", lambda x: x.t), 3), ",").alias("first"))
