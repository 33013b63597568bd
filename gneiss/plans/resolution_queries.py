"""Queries of names, owners and references across files, of contracts and of test finding."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.functions import scalar as S
from gneiss.operators import contracts as C
from gneiss.operators import resolution as N
from gneiss.operators import test_finding as T
from gneiss.plans.catalog import query
from gneiss.plans.change_queries import _PATH, path_of
from gneiss.plans.projections import Tables, with_tables


def _typed(t):
    """symbols with the columns that resolution asks for."""
    return t.symbols.withColumn("exported", F.lit(True)).withColumn("default_export", F.lit(False))


@query("g2_resolution", with_tables("symbols", """
refs AS (SELECT DISTINCT 'o' || o_orderkey AS source, o_orderstatus AS file_path, ['CALLS', 'REFERENCES', 'IMPORTS'][CAST(o_orderkey % 3 AS INT) + 1] AS relation,
  CASE o_orderkey % 6 WHEN 0 THEN 's' || o_custkey % 10 WHEN 1 THEN n_name WHEN 2 THEN 'pkg.' || n_name WHEN 3 THEN 'order.' || o_orderpriority WHEN 4 THEN 'value' ELSE 'al' END AS raw, 'n' || o_custkey % 25 AS alias
  FROM orders JOIN nation ON n_nationkey = o_custkey % 25),
r AS (SELECT *, CASE WHEN raw = 'al' THEN alias ELSE raw END AS want, regexp_extract(CASE WHEN raw = 'al' THEN alias ELSE raw END, '([^.:]*)$', 1) AS tail FROM refs),
keys AS (SELECT DISTINCT unnest([name, qualified_name, regexp_extract(qualified_name, '([^.:]*)$', 1)]) AS key, qualified_name, file_path, start_line FROM symbols),
pick AS (SELECT r.*, CASE WHEN want IN (SELECT key FROM keys) THEN want WHEN tail <> want AND tail IN (SELECT key FROM keys) THEN tail END AS key FROM r),
every AS (SELECT key, min(qualified_name) AS lo, max(qualified_name) AS hi FROM keys GROUP BY key),
own AS (SELECT key, file_path, arg_min(qualified_name, struct_pack(a := start_line, b := qualified_name)) AS q FROM keys GROUP BY ALL),
tails AS (SELECT key, regexp_extract(qualified_name, '([^.:]*)$', 1) AS tail, min(qualified_name) AS lo, max(qualified_name) AS hi FROM keys GROUP BY ALL),
names AS (SELECT DISTINCT file_path, unnest([name, qualified_name]) AS want FROM symbols)
||select||SELECT source, relation, raw, nullif(CASE WHEN p.key IS NULL THEN NULL WHEN own.q IS NOT NULL THEN own.q WHEN relation = 'REFERENCES' AND p.want = 'value' THEN '' WHEN every.lo = every.hi THEN CASE WHEN every.lo = source THEN '' ELSE every.lo END
  WHEN names.want IS NOT NULL THEN '' WHEN relation IN ('CALLS', 'IMPORTS') OR p.tail <> p.want THEN CASE WHEN tails.lo = tails.hi THEN tails.lo END END, '') AS target
FROM pick p LEFT JOIN every USING (key) LEFT JOIN own ON own.key = p.key AND own.file_path = p.file_path LEFT JOIN tails ON tails.key = p.key AND tails.tail = p.tail LEFT JOIN names ON names.file_path = p.file_path AND names.want = p.want"""))  # fmt: skip
def g2_resolution(spark, sf_dir):
    t, k = Tables(spark, sf_dir), F.col("o_orderkey")
    rows = t.raw("orders").join(t.raw("nation"), F.col("n_nationkey") == F.col("o_custkey") % 25)
    raw = F.when(k % 6 == 0, F.concat(F.lit("s"), F.col("o_custkey") % 10)).when(k % 6 == 1, F.col("n_name")).when(k % 6 == 2, F.concat(F.lit("pkg."), "n_name")).when(k % 6 == 3, F.concat(F.lit("order."), "o_orderpriority")).when(k % 6 == 4, "value").otherwise("al")
    relation = F.array(*[F.lit(x) for x in ("CALLS", "REFERENCES", "IMPORTS")])[(k % 3).cast("int")]
    refs = rows.select(F.concat(F.lit("o"), k).alias("source"), F.col("o_orderstatus").alias("file_path"), F.lit("python").alias("language"), relation.alias("relation"), raw.alias("raw"), F.create_map(F.lit("al"), F.concat(F.lit("n"), F.col("o_custkey") % 25)).alias("aliases"))
    none = spark.createDataFrame([], "file_path string, associated string")
    return N.resolve(refs, _typed(t), none).select("source", "relation", "raw", "target")


@query("b10_ownership", """SELECT 'n' || n_nationkey AS source, 'HAS_METHOD' AS relation, 's' || s_suppkey AS target FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 2 = 0
UNION ALL SELECT 'n' || n_nationkey, 'HAS_PROPERTY', 's' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 2 = 1""")  # fmt: skip
def b10_ownership(spark, sf_dir):
    t = Tables(spark, sf_dir)
    file_path = lambda key: F.concat(F.lit("f"), key)
    owners = t.raw("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("qualified_name"), F.concat(F.lit("n"), "n_nationkey").alias("name"), F.lit("class").alias("kind"), file_path("n_nationkey").alias("file_path"), F.lit(1).alias("start_line"), F.lit("").alias("parent"))
    members = t.raw("supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("qualified_name"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 2 == 0, "method").otherwise("field").alias("kind"), file_path("s_nationkey").alias("file_path"), F.lit(2).alias("start_line"), F.concat(F.lit("pkg.n"), "s_nationkey").alias("parent"))
    return N.ownership(owners.unionByName(members))


@query("b11_referenced_files", f"""WITH f AS (SELECT {_PATH.format(k="p_partkey")} AS path FROM part), d AS (SELECT DISTINCT path, split_part(path, '/', -1) AS base FROM f),
r AS (SELECT s_suppkey AS source, CASE s_suppkey % 4 WHEN 0 THEN './src/util32.go' WHEN 1 THEN 'Dto\\Order12Request.cs' WHEN 2 THEN '"Startup"' ELSE 'store28' END AS raw FROM supplier),
c AS (SELECT source, regexp_replace(replace(trim(regexp_replace(raw, '^"|"$', '', 'g')), '\\', '/'), '^(\\./)+', '') AS ref FROM r)
SELECT DISTINCT source, path FROM c JOIN d ON path = ref OR ends_with(path, '/' || ref) OR base = split_part(ref, '/', -1) OR regexp_replace(base, '(.)\\.[^.]*$', '\\1') = regexp_replace(split_part(ref, '/', -1), '(.)\\.[^.]*$', '\\1')""")  # fmt: skip
def b11_referenced_files(spark, sf_dir):
    t, k = Tables(spark, sf_dir), F.col("s_suppkey")
    raw = F.when(k % 4 == 0, "./src/util32.go").when(k % 4 == 1, "Dto\\Order12Request.cs").when(k % 4 == 2, '"Startup"').otherwise("store28")
    return N.referenced_files(t.raw("supplier").select(k.alias("source"), raw.alias("raw")), t.raw("part").select(path_of("p_partkey").alias("path")).distinct())


@query("b12_match_keys", r"""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 2 = 0 THEN 'k' || l_suppkey ELSE 'f' || l_partkey END AS tail, CASE WHEN l_linenumber % 2 = 0 THEN 'decl.k' || l_suppkey WHEN l_linenumber % 3 = 0 THEN 'int f(int a)' ELSE 'A.f' || l_partkey END AS key FROM lineitem""")
def b12_match_keys(spark, sf_dir):
    n = F.col("l_linenumber")
    key = N.match_key(F.concat(F.lit("A::f"), "l_partkey"), F.when(n % 3 == 0, "int  f(int a) ").otherwise(""), F.when(n % 2 == 0, F.concat(F.lit(" decl::k"), "l_suppkey")))
    return Tables(spark, sf_dir).raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", key.alias("k")).select("l_orderkey", "l_linenumber", "l_partkey", "k.*")


@query("b32_associations", """WITH f AS (SELECT DISTINCT 'lib/x' || l_suppkey || CASE l_linenumber % 4 WHEN 0 THEN '.h' WHEN 1 THEN '.cpp' WHEN 2 THEN '.pas' ELSE '.dfm' END AS path, 'lib/x' || l_suppkey AS stem, CASE WHEN l_linenumber % 4 < 2 THEN 0 ELSE 1 END AS family FROM lineitem)
SELECT a.path, b.path AS associated FROM f a JOIN f b ON a.stem = b.stem AND a.family = b.family AND a.path <> b.path""")  # fmt: skip
def b32_associations(spark, sf_dir):
    end = F.array(*[F.lit(x) for x in (".h", ".cpp", ".pas", ".dfm")])[(F.col("l_linenumber") % 4).cast("int")]
    return N.association_pairs(Tables(spark, sf_dir).raw("lineitem").select(F.concat(F.lit("lib/x"), "l_suppkey", end).alias("path")).distinct())


@query("b32_module_associations", """SELECT 'web/a/m' || p_partkey || '.ts' AS path, CASE p_partkey % 3 WHEN 0 THEN 'web/b/n' || p_partkey || '.tsx' ELSE 'web/a/m' || p_partkey - 1 || '.ts' END AS associated FROM part
WHERE p_partkey % 3 = 0 OR (p_partkey % 3 = 1 AND p_partkey - 1 IN (SELECT p_partkey FROM part))""")  # fmt: skip
def b32_module_associations(spark, sf_dir):
    parts, k = Tables(spark, sf_dir).raw("part"), F.col("p_partkey")
    files = parts.select(F.explode(F.array(F.concat(F.lit("web/a/m"), k, F.lit(".ts")), F.concat(F.lit("web/b/n"), k, F.lit(".tsx")))).alias("path"))
    spec = F.when(k % 3 == 0, F.concat(F.lit("../b/./n"), k)).when(k % 3 == 1, F.concat(F.lit("./m"), k - 1)).otherwise("react")
    return N.module_associations(parts.select(F.concat(F.lit("web/a/m"), k, F.lit(".ts")).alias("path"), spec.alias("specifier")), files)


# --- contracts ---


@query("b15_frontend_summary", with_tables("edges symbols", """
f AS (SELECT qualified_name, file_path || CASE WHEN start_line % 3 = 0 THEN '.tsx' WHEN start_line % 3 = 1 THEN '.PY' ELSE '.Js' END AS file_path FROM symbols)
||select||SELECT relation, count(*) AS edges, count(DISTINCT source) AS symbols, count(DISTINCT file_path) AS files FROM edges JOIN f ON source = qualified_name WHERE regexp_matches(lower(file_path), '[.](tsx|js)$') GROUP BY relation"""))  # fmt: skip
def b15_frontend_summary(spark, sf_dir):
    t = Tables(spark, sf_dir)
    end = F.when(F.col("start_line") % 3 == 0, ".tsx").when(F.col("start_line") % 3 == 1, ".PY").otherwise(".Js")
    return C.frontend_summary(t.edges, t.symbols.select("qualified_name", F.concat("file_path", end).alias("file_path")))


@query("b14_code_entry_points", """SELECT 's' || s_suppkey AS qualified_name, CASE WHEN s_suppkey % 3 = 0 THEN 'route_handler' ELSE 'model' END AS reason FROM supplier WHERE s_suppkey % 3 < 2""")
def b14_code_entry_points(spark, sf_dir):
    rows, k = Tables(spark, sf_dir).raw("supplier"), F.col("s_suppkey")
    text = F.when(k % 3 == 0, F.concat(F.lit('@Router.get("/x")\ndef h():'), k)).when(k % 3 == 1, F.concat(F.lit("x = 1\nclass "), "s_name", F.lit("(Base, BaseModel):\n  a: int"))).otherwise("@cached\ndef f(): pass")
    name = F.regexp_replace("s_name", "[^A-Za-z0-9_]", "_")
    chunks = rows.select(F.lit("A.py").alias("file_path"), name.alias("name"), F.regexp_replace(text, F.lit("[#]"), F.lit("_")).alias("content"))
    return C.entry_points(chunks, rows.select(F.concat(F.lit("s"), k).alias("qualified_name"), F.upper(name).alias("name"), F.lit("a.py").alias("file_path")))


_GRAPH = """e AS (SELECT DISTINCT 'p' || l_partkey || CASE WHEN l_partkey % 10 = 0 THEN '.data' ELSE '' END AS symbol, 'route:/s/' || l_suppkey AS target, l_suppkey FROM lineitem),
fetches AS (SELECT '/s/' || l_suppkey || '/' AS route, symbol, row_number() OVER (PARTITION BY l_suppkey ORDER BY symbol) AS n FROM e WHERE symbol NOT LIKE '%.data'),
field AS (SELECT symbol, field, row_number() OVER (PARTITION BY symbol ORDER BY field) AS n FROM (SELECT DISTINCT 'p' || l_partkey AS symbol, 'q' || CAST(l_quantity AS INT) AS field FROM lineitem)),
both_ AS (SELECT route, f.symbol, field, row_number() OVER (PARTITION BY route ORDER BY f.symbol, field NULLS FIRST) AS n FROM fetches f LEFT JOIN field ON f.symbol = field.symbol AND field.n <= 64 WHERE f.n <= 16),
c AS (SELECT route, symbol, field FROM both_ WHERE n <= 200)"""


def _graph_contract(spark, sf_dir):
    lines = Tables(spark, sf_dir).raw("lineitem")
    fetch = lines.select(F.concat(F.lit("p"), "l_partkey", F.when(F.col("l_partkey") % 10 == 0, ".data").otherwise("")).alias("source"), F.lit("FETCHES").alias("relation"), F.concat(F.lit("route:/s/"), "l_suppkey").alias("target"))
    read = lines.select(F.concat(F.lit("p"), "l_partkey").alias("source"), F.lit("READS_FIELD").alias("relation"), F.concat(F.lit("field:q"), F.col("l_quantity").cast("int")).alias("target"))
    return C.graph_contract(fetch.unionByName(read), lines.select(F.concat(F.lit("/s/"), "l_suppkey", F.lit("/")).alias("route")).distinct())


@query("b18_graph_contract", f"WITH {_GRAPH} SELECT * FROM c")
def b18_graph_contract(spark, sf_dir):
    return _graph_contract(spark, sf_dir)


@query("b18_field_readers", f"WITH {_GRAPH} SELECT route, field, string_agg(DISTINCT symbol, ',' ORDER BY symbol) AS readers FROM c WHERE field IS NOT NULL GROUP BY ALL")
def b18_field_readers(spark, sf_dir):
    return C.field_readers(_graph_contract(spark, sf_dir))


@query("j23_wrapper_calls", """SELECT 'load' || l_suppkey AS wrapper, '/s/' || l_suppkey AS route, 'o' || l_orderkey || '.ts' AS path, 'view' AS function, count(*) AS calls FROM lineitem GROUP BY ALL""")
def j23_wrapper_calls(spark, sf_dir):
    lines = Tables(spark, sf_dir).raw("lineitem")
    one = F.concat(F.lit("const x = load"), "l_suppkey", F.lit("<Item> (1); loads(2);\n"))
    sources = lines.groupBy(F.concat(F.lit("o"), "l_orderkey", F.lit(".ts")).alias("path")).agg(F.array_join(F.collect_list(one), "").alias("text")).withColumn("function", F.lit("view"))
    own = lines.select(F.concat(F.lit("load"), "l_suppkey").alias("wrapper"), F.concat(F.lit("/s/"), "l_suppkey").alias("route")).distinct()
    # A wrapper that calls itself doesn't count.
    inner = own.select(F.lit("api.ts").alias("path"), F.concat("wrapper", F.lit("(a)")).alias("text"), F.col("wrapper").alias("function"))
    return C.wrapper_calls(own, sources.select("path", "text", "function").unionByName(inner))


@query("b17_handler_rows", """WITH a AS (SELECT '/r' || l_suppkey % 50 AS route, CASE WHEN l_linenumber % 2 = 0 THEN 'express' ELSE 'flask' END AS framework, CASE WHEN l_returnflag = 'A' THEN 'GET' ELSE 'POST' END AS method, 'h' || l_suppkey AS handler FROM lineitem),
h AS (SELECT route, string_agg(DISTINCT framework, ',' ORDER BY framework) AS frameworks, string_agg(DISTINCT method, ',' ORDER BY method) AS methods, string_agg(DISTINCT handler, ',' ORDER BY handler) AS handlers FROM a GROUP BY route),
c AS (SELECT '/r' || o_custkey % 60 AS route, count(DISTINCT o_orderpriority) AS consumers FROM orders GROUP BY ALL)
SELECT route, coalesce(frameworks, '') AS frameworks, coalesce(methods, '') AS methods, coalesce(handlers, '') AS handlers, coalesce(consumers, 0) AS consumers, CASE WHEN handlers IS NULL THEN 'no_handler' WHEN consumers IS NULL THEN 'no_consumer' ELSE 'ok' END AS status FROM h FULL JOIN c USING (route)""")  # fmt: skip
def b17_handler_rows(spark, sf_dir):
    t = Tables(spark, sf_dir)
    routes = t.raw("lineitem").select(F.concat(F.lit("/api/r"), F.col("l_suppkey") % 50, F.lit("/")).alias("route"), F.when(F.col("l_linenumber") % 2 == 0, "express").otherwise("flask").alias("framework"), F.when(F.col("l_returnflag") == "A", "GET").otherwise("POST").alias("method"), F.concat(F.lit("h"), "l_suppkey").alias("handler"), F.lit("x").alias("file_path"))
    return C.handler_rows(routes, t.raw("orders").select(F.concat(F.lit("r"), F.col("o_custkey") % 60, F.lit("?q=1")).alias("route"), F.col("o_orderpriority").alias("file_path")))


@query("x15_changed_routes", """WITH ch AS (SELECT DISTINCT 'p' || p_partkey AS f FROM part WHERE p_size = 7), a AS (SELECT '/s' || l_suppkey AS route, bool_or('p' || l_partkey IN (SELECT f FROM ch)) AS handler_changed FROM lineitem WHERE l_linenumber = 1 GROUP BY ALL),
b AS (SELECT route, count(*) AS consumers, count(*) FILTER (WHERE f IN (SELECT f FROM ch)) AS changed_consumers FROM (SELECT DISTINCT '/s' || l_suppkey AS route, 'p' || l_partkey AS f FROM lineitem WHERE l_linenumber > 3) GROUP BY route)
SELECT route, coalesce(handler_changed, false) AS handler_changed, coalesce(consumers, 0) AS consumers, coalesce(changed_consumers, 0) AS changed_consumers FROM a FULL JOIN b USING (route) WHERE handler_changed OR changed_consumers > 0""")  # fmt: skip
def x15_changed_routes(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = t.raw("lineitem").select(F.concat(F.lit("/s"), "l_suppkey").alias("route"), F.concat(F.lit("p"), "l_partkey").alias("file_path"), "l_linenumber")
    return C.changed_routes(rows.where("l_linenumber = 1"), rows.where("l_linenumber > 3"), t.raw("part").where("p_size = 7").select(F.concat(F.lit("p"), "p_partkey").alias("file_path")))


@query("x15_changed_processes", with_tables("steps", """
ch AS (SELECT DISTINCT symbol FROM steps WHERE process_id % 9 = 0 AND step = 2)
||select||SELECT process_id, count(*) AS steps, count(*) FILTER (WHERE symbol IN (SELECT symbol FROM ch)) AS changed_steps, min(step) FILTER (WHERE symbol IN (SELECT symbol FROM ch)) AS first_changed, CASE WHEN count(*) >= 4 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM steps GROUP BY process_id HAVING count(*) FILTER (WHERE symbol IN (SELECT symbol FROM ch)) > 0"""))  # fmt: skip
def x15_changed_processes(spark, sf_dir):
    steps = Tables(spark, sf_dir).steps
    return C.changed_processes(steps, steps.where("process_id % 9 = 0 and step = 2").select("symbol"))


_KINDS = """SELECT p_partkey, path, CASE WHEN regexp_matches(low, '[.](tsx|jsx)$') AND regexp_matches(low, '/(components|pages|views|screens)/') THEN 'frontend_component' WHEN regexp_matches(low, '[.]py$') AND regexp_matches(low, '/(routers|routes|api)/') THEN 'backend_endpoint'
  WHEN regexp_matches(low, '[.]py$') AND regexp_matches(low, '/(repositories|repository|models)/|/database|/db_') THEN 'repository' WHEN regexp_matches(low, '[.](ts|tsx|js|jsx)$') THEN 'frontend' WHEN regexp_matches(low, '[.]py$') THEN 'backend' ELSE 'other' END AS kind FROM (SELECT *, '/' || lower(path) AS low FROM f)"""


@query("f12_application_kinds", f"WITH f AS (SELECT p_partkey, {_PATH.format(k='p_partkey')} AS path FROM part) {_KINDS}")
def f12_application_kinds(spark, sf_dir):
    return Tables(spark, sf_dir).raw("part").select("p_partkey", path_of("p_partkey").alias("path")).withColumn("kind", C.file_kind(F.col("path")))


def _label_sql(table, otherwise):
    return "coalesce(nullif(array_to_string(list_filter([{}], lambda x: x IS NOT NULL), ','), ''), '{}')".format(", ".join("CASE WHEN regexp_matches(lower(path), '{}') THEN '{}' END".format("|".join(parts), name) for name, parts in table.items()), otherwise)


@query("f12_feature_labels", f"WITH f AS (SELECT p_partkey, {_PATH.format(k='p_partkey')} AS path FROM part) SELECT p_partkey, {_label_sql(C.TAGS, 'supporting_code')} AS tags, {_label_sql(C.ROLES, 'supporting')} AS roles FROM f")
def f12_feature_labels(spark, sf_dir):
    path = path_of("p_partkey")
    return Tables(spark, sf_dir).raw("part").select("p_partkey", F.array_join(C.labels(path, C.TAGS, "supporting_code"), ",").alias("tags"), F.array_join(C.labels(path, C.ROLES, "supporting"), ",").alias("roles"))


@query("r23_app_context")
def r23_app_context(spark, sf_dir):
    """Files around a route; its parts have queries of their own."""
    t = Tables(spark, sf_dir)
    files = t.raw("part").select(path_of("p_partkey").alias("path"), F.concat(F.lit("select 1 from t"), "p_size").alias("text")).dropDuplicates(["path"])
    handlers = t.raw("part").where("p_partkey % 41 = 20").select(path_of("p_partkey").alias("file_path"), F.lit("/users").alias("route"))
    symbols = t.raw("part").select(path_of("p_partkey").alias("file_path"), F.concat(F.lit("p"), "p_partkey").alias("qualified_name"))
    return C.app_context("/api/users", files, handlers, t.steps, t.edges, symbols)


# --- tests for a target ---


@query("r24_tests_by_calls", with_tables("edges symbols", """
h AS (SELECT qualified_name, file_path || CASE WHEN start_line % 20 = 1 THEN '/tests/t' ELSE '/src/t' END AS file_path FROM symbols), c AS (SELECT DISTINCT source, target FROM (SELECT source, target FROM edges WHERE relation IN ('CALLS', 'REFERENCES'))),
d0 AS (SELECT 't' || target AS target, source, row_number() OVER (PARTITION BY target ORDER BY source) AS n FROM c WHERE target LIKE 'p%'), d AS (SELECT target, source FROM d0 WHERE n <= 80),
s0 AS (SELECT x.target, x.source AS mid, c.source, row_number() OVER (PARTITION BY x.target, x.source ORDER BY c.source) AS n FROM (SELECT DISTINCT target, source FROM d) x JOIN c ON c.target = x.source)
||select||SELECT target, file_path, 12 AS score, 'calls' AS reason FROM d JOIN h ON source = qualified_name WHERE file_path LIKE '%/tests/%' UNION ALL SELECT target, file_path, 8, 'calls_indirectly' FROM s0 JOIN h ON source = qualified_name WHERE n <= 40 AND file_path LIKE '%/tests/%'"""))  # fmt: skip
def r24_tests_by_calls(spark, sf_dir):
    t = Tables(spark, sf_dir)
    calls = t.edges.where("relation in ('CALLS', 'REFERENCES')").withColumn("relation", F.lit("CALLS"))
    symbols = t.symbols.select("qualified_name", F.concat("file_path", F.when(F.col("start_line") % 20 == 1, "/tests/t").otherwise("/src/t")).alias("file_path"))
    targets = t.raw("part").select(F.concat(F.lit("tp"), "p_partkey").alias("target"), F.concat(F.lit("p"), "p_partkey").alias("symbol"))
    return T.by_calls(targets, calls, symbols)


@query("b28_project_tests", """SELECT 't' || s_suppkey AS target, CASE WHEN s_suppkey % 3 = 0 THEN 'Other/Suite.Tests/F' ELSE 'src/P' || s_nationkey || '.Tests/F' END || s_suppkey || 'Tests.cs' AS file_path, CASE WHEN s_suppkey % 3 = 0 THEN 11 ELSE 10 END AS score, CASE WHEN s_suppkey % 3 = 0 THEN 'project_reference' ELSE 'project_name' END AS reason FROM supplier""")
def b28_project_tests(spark, sf_dir):
    rows, k = Tables(spark, sf_dir).raw("supplier"), F.col("s_suppkey")
    folder = F.concat(F.lit("src/P"), "s_nationkey")
    source = F.concat(folder, F.lit("/F"), k, F.lit(".cs"))
    test = F.concat(F.when(k % 3 == 0, "Other/Suite.Tests/F").otherwise(F.concat(folder, F.lit(".Tests/F"))), k, F.lit("Tests.cs"))
    own, tests = F.concat(folder, F.lit("/P"), "s_nationkey", F.lit(".csproj")), F.concat(folder, F.lit(".Tests/P"), "s_nationkey", F.lit(".Tests.csproj"))
    files = rows.select(F.explode(F.array(source, test, own, tests, F.lit("Other/Suite.Tests/Suite.Tests.csproj"))).alias("path")).distinct()
    refs = rows.select(F.lit("Other/Suite.Tests/Suite.Tests.csproj").alias("test_project"), own.alias("project")).distinct()
    return T.by_project(rows.select(F.concat(F.lit("t"), k).alias("target"), source.alias("file_path")), files, refs)


@query("r24_tests_by_words", f"""WITH f AS (SELECT DISTINCT {_PATH.format(k="p_partkey")} AS path FROM part), x AS (SELECT path, list_distinct(list_filter(string_split_regex(lower(regexp_replace(path, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda w: w <> '')) AS w FROM f)
SELECT a.path AS target, b.path AS file_path, CAST(len(list_intersect(a.w, b.w)) AS INT) + 2 AS score, 'words' AS reason FROM x a, x b WHERE len(list_intersect(a.w, b.w)) > 0 AND regexp_matches(b.path, '^tests/|test[.]tsx$') AND regexp_matches(lower(b.path), '[.](py|tsx)$') AND regexp_matches(a.path, '^(app|web)/')""")  # fmt: skip
def r24_tests_by_words(spark, sf_dir):
    files = Tables(spark, sf_dir).raw("part").select(path_of("p_partkey").alias("file_path")).distinct()
    targets = files.where("file_path rlike '^(app|web)/'").select(F.col("file_path").alias("target"), F.col("file_path").alias("seed"))
    return T.by_words(targets, files.where(S.is_test_path(F.col("file_path"))))


@query("r24_found_tests", with_tables("", """SELECT target, file_path, score, reason FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY way, score DESC, file_path) AS m FROM (
  SELECT *, row_number() OVER (PARTITION BY target, file_path ORDER BY way, score DESC) AS n FROM (
    SELECT l_suppkey AS target, 'tests/t' || l_partkey AS file_path, CAST(l_quantity AS INT) AS score, CASE l_linenumber % 3 WHEN 0 THEN 'calls' WHEN 1 THEN 'mapped' ELSE 'words' END AS reason, CASE l_linenumber % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 7 END AS way FROM lineitem)) WHERE n = 1) WHERE m <= 10"""))  # fmt: skip
def r24_found_tests(spark, sf_dir):
    n = F.col("l_linenumber") % 3
    rows = Tables(spark, sf_dir).raw("lineitem").select(F.col("l_suppkey").alias("target"), F.concat(F.lit("tests/t"), "l_partkey").alias("file_path"), F.col("l_quantity").cast("int").alias("score"), F.when(n == 0, "calls").when(n == 1, "mapped").otherwise("words").alias("reason"))
    return T.found([rows])
