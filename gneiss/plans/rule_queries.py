"""Rule, contract and parser queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.functions import scalar as S
from gneiss.operators import parsers, reports, retrieval, rules
from gneiss.operators import relational as R
from gneiss.operators import text as T
from gneiss.plans.catalog import query
from gneiss.plans.projections import Tables, with_tables


def _supplier_files(spark, sf_dir, *parts, suffix=""):
    """One source file for each supplier: name s<key><suffix>, text of the parts."""
    return Tables(spark, sf_dir).raw("supplier").select(F.concat(F.lit("s"), "s_suppkey", F.lit(suffix)).alias("path"), F.concat(*[F.lit(p) if isinstance(p, str) and not p.startswith("s_") else F.col(p) for p in parts]).alias("text"))


_S = "SELECT 's' || s_suppkey AS file_path, {} FROM supplier"


@query("p5_csharp_symbols", _S.format("unnest(['class', 'method', 'interface']) AS kind, unnest(['A.C' || s_nationkey, 'A.Go', 'A.I']) AS name, CAST(unnest([2, 3, 5]) AS INT) AS line, '' AS detail"))
def p5_csharp_symbols(spark, sf_dir):
    return parsers.parsed(_supplier_files(spark, sf_dir, "namespace A;\npublic class C", "s_nationkey", " {\n  public int Go(int x) {\n  }\npublic interface I {}"), "csharp")


@query("p6_pascal_symbols", _S.format("unnest(['module', 'class', 'method']) AS kind, unnest(['U' || s_nationkey, 'T', 'T.Click']) AS name, CAST(unnest([1, 3, 4]) AS INT) AS line, '' AS detail"))
def p6_pascal_symbols(spark, sf_dir):
    return parsers.parsed(_supplier_files(spark, sf_dir, "unit U", "s_nationkey", ";\ntype\n  T = class(X)\nprocedure T.Click;"), "pascal")


@query("p8_project_references", _S.format("unnest(['project_reference', 'target']) AS kind, unnest(['../L' || s_nationkey || '/L.csproj', 'tool']) AS name, CAST(unnest([1, 2]) AS INT) AS line, '' AS detail"))
def p8_project_references(spark, sf_dir):
    return parsers.parsed(_supplier_files(spark, sf_dir, '<ProjectReference Include="..\\L', "s_nationkey", '\\L.csproj" />\nadd_executable(tool a.c)'), "project")


@query("p9_macro_expansion", _S.format("unnest(['A', 'B', 'C']) AS name, unnest([CAST(s_nationkey AS VARCHAR), '(' || s_nationkey || '+1)', '((' || s_nationkey || '+1)*2)']) AS detail"))
def p9_macro_expansion(spark, sf_dir):
    return parsers.parsed(_supplier_files(spark, sf_dir, "#define A ", "s_nationkey", "\n#define B (A+1)\n#define C (B*2)\n"), "expanded_macros").select("file_path", "name", "detail")


@query("p10_includes", "SELECT 's' || s_suppkey AS file_path, 'n' || s_nationkey || '.h' AS name, CASE WHEN s_nationkey % 2 = 0 THEN 'inc/n' ELSE 'src/n' END || s_nationkey || '.h' AS path FROM supplier")
def p10_includes(spark, sf_dir):
    t = Tables(spark, sf_dir)
    includes = t.raw("supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("file_path"), F.concat(F.lit("n"), "s_nationkey", F.lit(".h")).alias("name"))
    roots = spark.createDataFrame([(0, "inc"), (1, "src")], "position int, root string")
    n = t.raw("nation")
    files = n.where("n_nationkey % 2 = 0").select(F.concat(F.lit("inc/n"), "n_nationkey", F.lit(".h")).alias("path")).union(n.select(F.concat(F.lit("src/n"), "n_nationkey", F.lit(".h"))))
    return rules.resolve_includes(includes, roots, files)


@query("p11_useful_references", with_tables("symbols", "SELECT DISTINCT kind, lower(name) AS token FROM symbols WHERE length(name) > 8 AND kind <> 'orders'"))
def p11_useful_references(spark, sf_dir):
    return Tables(spark, sf_dir).symbols.where("length(name) > 8 and kind <> 'orders'").select("kind", F.lower("name").alias("token")).dropDuplicates()


@query("f4_cluster_search", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring') OR contains(lower(p_type), 'ring')")
def f4_cluster_search(spark, sf_dir):
    hit = F.exists(F.array("p_name", "p_brand", "p_type"), lambda x: F.contains(F.lower(x), F.lit("ring")))
    return Tables(spark, sf_dir).raw("part").where(hit).select("p_partkey")


@query("f7_entry_points", with_tables("steps", "SELECT process_id, step, regexp_matches(lower(regexp_extract(symbol, '([^.:]*)$', 1)), 'main|exports|__init__|index|app|server|run|start|setup|create_app|handler|cli') AS is_entry FROM steps"))
def f7_entry_points(spark, sf_dir):
    return Tables(spark, sf_dir).steps.select("process_id", "step", rules.is_entry_point(F.col("symbol"), F.lit("function")).alias("is_entry"))


@query("f12_file_kinds", "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'ui' WHEN 2 THEN 'config' WHEN 3 THEN 'docs' ELSE 'code' END AS kind FROM pages")
def f12_file_kinds(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in ("a/tests/b.py", "a/View.tsx", "a/b.yaml", "README.md", "a/b.py")])
    return Tables(spark, sf_dir).raw("pages").select("page_id", rules.file_kind(names[(F.col("page_id") % 5).cast("int")]).alias("kind"))


@query("f13_boundary_roles", "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'data_access' WHEN 1 THEN 'external_io' WHEN 2 THEN 'route_entrypoint' WHEN 3 THEN 'service' ELSE 'internal' END AS role FROM pages")
def f13_boundary_roles(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in ("src/UserRepository.cs", "src/clients/HttpClient.cs", "src/UserController.cs", "src/UserService.cs", "src/User.cs")])
    return Tables(spark, sf_dir).raw("pages").select("page_id", rules.boundary_role(names[(F.col("page_id") % 5).cast("int")], F.lit("x")).alias("role"))


@query("j16_declarations", "WITH s AS (SELECT l_suppkey AS g, 'm' || (l_partkey % 7) AS name, l_orderkey AS q, l_linenumber = 1 AND l_orderkey % 40 = 0 AS d FROM lineitem), u AS (SELECT g, name, min(q) AS definition FROM s WHERE d GROUP BY ALL HAVING count(*) = 1) SELECT q AS declaration, definition FROM s JOIN u USING (g, name) WHERE NOT d")
def j16_declarations(spark, sf_dir):
    s = Tables(spark, sf_dir).raw("lineitem")
    return rules.declaration_pairs(s.select(F.col("l_suppkey").alias("group"), F.concat(F.lit("m"), F.col("l_partkey") % 7).alias("name"), F.col("l_orderkey").alias("qualified_name"), F.expr("l_linenumber = 1 and l_orderkey % 40 = 0").alias("is_definition")))



@query("j17_overrides", "WITH e AS (SELECT n_nationkey AS child, n_regionkey AS parent FROM nation), m AS (SELECT DISTINCT s_nationkey AS owner, s_suppkey % 5 AS method FROM supplier) SELECT DISTINCT child, parent, a.method FROM e JOIN m AS a ON a.owner = child JOIN m AS b ON b.owner = parent AND b.method = a.method")
def j17_overrides(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return rules.overrides(t.raw("nation").select(F.col("n_nationkey").alias("child"), F.col("n_regionkey").alias("parent")), t.raw("supplier").select(F.col("s_nationkey").alias("owner"), (F.col("s_suppkey") % 5).alias("method")))


@query("j22_overlapping_processes", with_tables("steps", "SELECT DISTINCT process_id FROM steps WHERE symbol IN (SELECT symbol FROM steps WHERE process_id = 1)"))
def j22_overlapping_processes(spark, sf_dir):
    steps = Tables(spark, sf_dir).steps
    return steps.join(steps.where("process_id = 1").select("symbol").distinct(), "symbol", "left_semi").select("process_id").distinct()


@query("j26_convention_tests", "SELECT 'src/m' || s_suppkey || '.py' AS path, unnest(['tests/test_m' || s_suppkey || '.py', 'web/m' || s_suppkey || '.spec.ts']) AS test FROM supplier WHERE s_suppkey % 3 = 0")
def j26_convention_tests(spark, sf_dir):
    s = Tables(spark, sf_dir).raw("supplier")
    name = lambda a, b: F.concat(F.lit(a), "s_suppkey", F.lit(b)).alias("path")
    return rules.convention_tests(s.select(name("src/m", ".py")).union(s.where("s_suppkey % 3 = 0").select(name("tests/test_m", ".py"))).union(s.where("s_suppkey % 3 = 0").select(name("web/m", ".spec.ts"))))


@query("a5_neighbour_ranking", with_tables("edges", "SELECT target AS node, count(*) AS edge_count, count(DISTINCT relation) AS relations FROM edges WHERE source LIKE 'p%' GROUP BY target ORDER BY edge_count DESC, node LIMIT 30"))
def a5_neighbour_ranking(spark, sf_dir):
    e = Tables(spark, sf_dir).edges.where("source like 'p%'")
    return R.top(e.groupBy(F.col("target").alias("node")).agg(F.count(F.lit(1)).alias("edge_count"), F.countDistinct("relation").alias("relations")), [F.desc("edge_count"), F.asc("node")], 30)


@query("a21_repo_profile", with_tables("files", "SELECT split_part(path, '/', 1) AS module, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes, count(DISTINCT language) AS languages FROM files GROUP BY 1"))
def a21_repo_profile(spark, sf_dir):
    return Tables(spark, sf_dir).files.groupBy(S.module_of(F.col("path")).alias("module")).agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"), F.countDistinct("language").alias("languages"))


@query("a22_change_slices", with_tables("files", "SELECT split_part(path, '/', 1) AS slice, count(*) AS files, string_agg(DISTINCT language, ',' ORDER BY language) AS roles, CASE max(CASE WHEN size_bytes > 8000 THEN 3 WHEN size_bytes > 3000 THEN 2 ELSE 1 END) WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS risk, count(*) FILTER (WHERE size_bytes > 8000) = 0 AS ready FROM files GROUP BY 1"))
def a22_change_slices(spark, sf_dir):
    size = F.col("size_bytes")
    risk = F.max(F.when(size > 8000, 3).when(size > 3000, 2).otherwise(1))
    return Tables(spark, sf_dir).files.groupBy(S.module_of(F.col("path")).alias("slice")).agg(
        F.count(F.lit(1)).alias("files"), S.joined(F.collect_set("language")).alias("roles"), F.element_at(F.array(F.lit("LOW"), F.lit("MEDIUM"), F.lit("HIGH")), risk).alias("risk"), (F.count_if(size > 8000) == 0).alias("ready")
    )


@query("w8_carry_forward", "SELECT event_id, last_value(CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS header FROM events")
def w8_carry_forward(spark, sf_dir):
    e = Tables(spark, sf_dir).raw("events")
    least = e.agg(F.min("event_type").alias("least"))
    rows = e.join(F.broadcast(least)).select("event_id", "user_id", F.when(F.col("event_type") == F.col("least"), F.col("event_id")).alias("header"))
    return rules.carried_forward(rows, "user_id", "event_id", "header").select("event_id", "header")


@query("w9_proximity_boost", with_tables("files", "r AS (SELECT path, split_part(path, '/', 1) AS folder, CAST(modified_time % 97 AS DOUBLE) AS score FROM files), b AS (SELECT DISTINCT folder FROM (SELECT * FROM r ORDER BY score DESC, path LIMIT 5))||select||SELECT path, round(score + CASE WHEN folder IN (SELECT folder FROM b) THEN 0.08 ELSE 0 END, 4) AS score FROM r"))
def w9_proximity_boost(spark, sf_dir):
    return rules.proximity_boost(Tables(spark, sf_dir).files.select("path", (F.col("modified_time") % 97).cast("double").alias("score")))


@query("k3_composite_sort", with_tables("edges", "SELECT source AS node, count(*) AS n, count(DISTINCT relation) AS r FROM edges GROUP BY source ORDER BY r DESC, n DESC, node DESC LIMIT 40"))
def k3_composite_sort(spark, sf_dir):
    g = Tables(spark, sf_dir).edges.groupBy(F.col("source").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("relation").alias("r"))
    return R.top(g, [F.desc("r"), F.desc("n"), F.desc("node")], 40)


@query("r5_source_scores", "SELECT p_partkey, CAST(least(CASE WHEN p_size % 2 = 0 THEN 0.34 ELSE 0 END + CASE WHEN p_size % 3 = 0 THEN 0.24 ELSE 0 END + CASE WHEN p_size % 5 = 0 THEN 0.22 ELSE 0 END, 0.75) AS DOUBLE) AS score FROM part")
def r5_source_scores(spark, sf_dir):
    names = F.array_compact(F.array(F.when(F.col("p_size") % 2 == 0, "symbol"), F.when(F.col("p_size") % 3 == 0, "regex_expanded"), F.when(F.col("p_size") % 5 == 0, "graph")))
    return Tables(spark, sf_dir).raw("part").select("p_partkey", F.round(retrieval.source_score(names), 4).alias("score"))


@query("r9_graph_boost", with_tables("edges", "SELECT source, target, round(CASE relation WHEN 'CALLS' THEN 0.22 WHEN 'REFERENCES' THEN 0.16 WHEN 'EXTENDS' THEN 0.14 WHEN 'HAS_PROPERTY' THEN 0.09 ELSE 0.1 END::DOUBLE / 2, 4) AS boost FROM edges WHERE source LIKE 's%' OR source LIKE 'n%'"))
def r9_graph_boost(spark, sf_dir):
    return Tables(spark, sf_dir).edges.where("source like 's%' or source like 'n%'").select("source", "target", rules.graph_boost(F.col("relation"), F.lit(2)).alias("boost"))


@query("r25_source_context", with_tables("files", "SELECT path, array_to_string(list_slice(string_split(text, chr(10)), 1, 3), chr(10)) AS context, CASE WHEN language = 'en' THEN 'range' ELSE 'file' END AS origin FROM files"))
def r25_source_context(spark, sf_dir):
    files = Tables(spark, sf_dir).files
    first = F.array_join(F.slice(F.split("text", "\n"), 1, 3), "\n").alias("context")
    ranged = files.where("language = 'en'").select("path", first, F.lit("range").alias("origin"), F.lit(0).alias("o"))
    whole = files.select("path", first, F.lit("file").alias("origin"), F.lit(1).alias("o"))
    return R.best_per_key(ranged.unionByName(whole), ["path"], [F.asc("o")]).drop("o")



@query("c5_symbol_chunks", with_tables("files", "s AS (SELECT path AS file_path, 'sym' || modified_time AS qualified_name, 2 AS a, 3 AS b FROM files WHERE modified_time % 3 = 0)||select||SELECT file_path, qualified_name, sha256(array_to_string(list_slice(string_split(text, chr(10)), a, b), chr(10))) AS content_hash FROM s JOIN files ON path = file_path UNION ALL SELECT path, 'module', sha256(text) FROM files WHERE modified_time % 3 <> 0"))
def c5_symbol_chunks(spark, sf_dir):
    files = Tables(spark, sf_dir).files
    symbols = files.where("modified_time % 3 = 0").select(F.col("path").alias("file_path"), F.concat(F.lit("sym"), "modified_time").alias("qualified_name"), F.lit(2).alias("start_line"), F.lit(3).alias("end_line"))
    return rules.symbol_chunks(symbols, files).select("file_path", "qualified_name", "content_hash")


_ROUTES = "CAST(unnest([{1}]) AS INT) AS line, '' AS detail, unnest([{0}]) AS name, unnest(['GET', 'POST']) AS kind"


@query("x4_nest_routes", _S.format(_ROUTES.format("'/cats/:id', '/cats/n' || s_nationkey", "3, 5")))
def x4_nest_routes(spark, sf_dir):
    return parsers.parsed(_supplier_files(spark, sf_dir, "@Controller('cats')\nclass C {\n @Get(':id')\n x() {}\n @Post('n", "s_nationkey", "')\n y() {}\n}"), "controller_routes")


@query("x5_spring_routes", _S.format(_ROUTES.format("'/api/y', '/api/n' || s_nationkey", "3, 5")))
def x5_spring_routes(spark, sf_dir):
    return parsers.parsed(_supplier_files(spark, sf_dir, '@RequestMapping("/api")\npublic class X {\n @GetMapping("/y")\n X x() {}\n @PostMapping("n', "s_nationkey", '")\n X y() {}\n}'), "controller_routes")


@query("x6_aspnet_routes", _S.format(_ROUTES.format("'/api/cats/{id}', '/api/cats/n' || s_nationkey", "3, 5")))
def x6_aspnet_routes(spark, sf_dir):
    return parsers.parsed(_supplier_files(spark, sf_dir, '[Route("api/[controller]")]\npublic class CatsController {\n [HttpGet("{id}")]\n X x() {}\n [HttpPost("n', "s_nationkey", '")]\n X y() {}\n}'), "controller_routes")


@query("x6_minimal_routes", _S.format("'GET' AS kind, '/n' || s_nationkey AS name, 1 AS line, '' AS detail"))
def x6_minimal_routes(spark, sf_dir):
    return parsers.parsed(_supplier_files(spark, sf_dir, 'app.MapGet("/n', "s_nationkey", '", () => 1);'), "minimal_routes")


@query("x7_fetched_routes", _S.format("'/items/' || s_nationkey AS route"))
def x7_fetched_routes(spark, sf_dir):
    return T.fetched_routes(_supplier_files(spark, sf_dir, "await fetch('/api/items/", "s_nationkey", "?page=1'); axios.get('/items/", "s_nationkey", "/')"))


@query("x8_response_keys", _S.format("unnest(['k' || s_nationkey, 'm', 'm.a']) AS name"))
def x8_response_keys(spark, sf_dir):
    return parsers.parsed(_supplier_files(spark, sf_dir, 'def f():\n    return {"k', "s_nationkey", '": 1, "m": {"a": 2}}'), "response_keys").select("file_path", "name")


@query("x9_model_shapes", _S.format("unnest(['int', 'str']) AS kind, unnest(['M' || s_nationkey || '.a', 'M' || s_nationkey || '.b']) AS name"))
def x9_model_shapes(spark, sf_dir):
    return parsers.parsed(_supplier_files(spark, sf_dir, "class M", "s_nationkey", "(BaseModel):\n    a: int\n    b: str = ''\n"), "model_shapes").select("file_path", "kind", "name")


@query("x10_consumer_keys", _S.format("unnest(['a', 'n' || s_nationkey || '.x']) AS name"))
def x10_consumer_keys(spark, sf_dir):
    return parsers.parsed(_supplier_files(spark, sf_dir, "const data = await fetch('/x')\nconst { a } = data\nuse(data.n", "s_nationkey", ".x)"), "consumer_keys").select("file_path", "name")


@query("x14_field_impact", "SELECT s_suppkey FROM supplier WHERE s_nationkey % 5 IN (0, 1)")
def x14_field_impact(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in ("total", "metrics.total", "subtotal", "metrics.totals", "other")])
    s = Tables(spark, sf_dir).raw("supplier").select("s_suppkey", F.array(names[F.col("s_nationkey") % 5]).alias("keys"))
    return reports.field_impact(s, "total").select("s_suppkey")


@query("b16_field_matches", "SELECT s_suppkey, s_nationkey % 4 IN (0, 1, 2) AS hit FROM supplier")
def b16_field_matches(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in ("total", "a.total", "x.a.total", "subtotal")])
    return Tables(spark, sf_dir).raw("supplier").select("s_suppkey", rules.field_matches(names[F.col("s_nationkey") % 4], F.lit("total")).alias("hit"))


@query("t5_suggest_tests", "SELECT 'tests/test_m' || s_suppkey || '.py' AS file_path, 12 AS score, 'graph' AS reason FROM supplier WHERE s_suppkey BETWEEN 1 AND 8")
def t5_suggest_tests(spark, sf_dir):
    s = Tables(spark, sf_dir).raw("supplier").where("s_suppkey between 1 and 8")
    k = F.col("s_suppkey")
    line = lambda df, name, path: df.select(name.alias("qualified_name"), path.alias("file_path"), F.lit(1).alias("start_line"), F.lit(9).alias("end_line"))
    symbols = line(s, F.concat(F.lit("f"), k), F.concat(F.lit("src/m"), k, F.lit(".py"))).union(line(s, F.concat(F.lit("t"), k), F.concat(F.lit("tests/test_m"), k, F.lit(".py"))))
    edges = s.select(F.concat(F.lit("t"), k).alias("source"), F.lit("CALLS").alias("relation"), F.concat(F.lit("f"), k).alias("target"))
    diffs = s.select(k.cast("string").alias("diff_id"), F.concat(F.lit("+++ b/src/m"), k, F.lit(".py\n@@ -2 +2 @@")).alias("text"))
    return reports.suggest_tests(diffs, symbols, edges)


@query("t11_participation", with_tables("steps", "SELECT symbol, count(DISTINCT process_id) AS processes, min(step) AS earliest FROM steps GROUP BY symbol"))
def t11_participation(spark, sf_dir):
    return Tables(spark, sf_dir).steps.groupBy("symbol").agg(F.countDistinct("process_id").alias("processes"), F.min("step").alias("earliest"))


@query("t16_security_review", _S.format("1 AS line, 'sensitive value without verification' AS title") + " WHERE s_nationkey % 2 = 0 UNION ALL " + _S.format("2, 'sql from parts'"))
def t16_security_review(spark, sf_dir):
    s = Tables(spark, sf_dir).raw("supplier")
    first = F.when(F.col("s_nationkey") % 2 == 0, "api_key = load()").otherwise("design_token_color = 3")
    return rules.security_findings(s.select(F.concat(F.lit("s"), "s_suppkey").alias("path"), F.concat(first, F.lit('\ndb.execute(f"select * from t where a={x}")\nok()')).alias("text")))


@query("t17_agent_findings", "SELECT 'a' || s_nationkey AS agent, 'f' || s_suppkey AS file_path, CASE s_suppkey % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'medium' ELSE 'low' END AS severity, 'T' AS title, CASE WHEN s_suppkey % 2 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS confidence FROM supplier")
def t17_agent_findings(spark, sf_dir):
    k = F.col("s_suppkey")
    severity = F.when(k % 3 == 0, "BLOCKER").when(k % 3 == 1, "odd").otherwise("info")
    payload = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("f"), k).alias("file_path"), severity.alias("severity"), F.lit(" T ").alias("title"), F.when(k % 2 == 0, "n/a").otherwise("7").alias("confidence"))).alias("findings")))
    return rules.review_findings(Tables(spark, sf_dir).raw("supplier").select(F.concat(F.lit("a"), "s_nationkey").alias("agent"), payload.alias("payload")))


@query("b19_fingerprints", "SELECT s_suppkey, 'src/m' || (s_nationkey % 3) || '|security|sql from parts line' AS fingerprint FROM supplier")
def b19_fingerprints(spark, sf_dir):
    path = F.concat(F.lit("src/m"), F.col("s_nationkey") % 3, F.lit("/x.py"))
    return Tables(spark, sf_dir).raw("supplier").select("s_suppkey", rules.fingerprint(path, F.lit("security"), F.concat(F.lit("SQL from parts, line "), "s_suppkey")).alias("fingerprint"))


@query("st2_pending_paths", "SELECT user_id, count(DISTINCT event_type) AS pending, max(ts) AS last_change FROM events GROUP BY user_id")
def st2_pending_paths(spark, sf_dir):
    return Tables(spark, sf_dir).raw("events").groupBy("user_id").agg(F.countDistinct("event_type").alias("pending"), F.max("ts").alias("last_change"))


@query("b30_affected_processes", with_tables("steps", "SELECT process_id, count(*) AS steps FROM steps WHERE symbol IN (SELECT symbol FROM steps WHERE step = 0) GROUP BY process_id"))
def b30_affected_processes(spark, sf_dir):
    steps = Tables(spark, sf_dir).steps
    return steps.join(steps.where("step = 0").select("symbol").distinct(), "symbol", "left_semi").groupBy("process_id").agg(F.count(F.lit(1)).alias("steps"))


@query("a13_labels", "SELECT l_suppkey, CASE WHEN count(*) >= 650 THEN 'HIGH' WHEN count(*) >= 600 THEN 'MEDIUM' ELSE 'LOW' END AS label FROM lineitem GROUP BY l_suppkey")
def a13_labels(spark, sf_dir):
    n = F.count(F.lit(1))
    return Tables(spark, sf_dir).raw("lineitem").groupBy("l_suppkey").agg(F.when(n >= 650, "HIGH").when(n >= 600, "MEDIUM").otherwise("LOW").alias("label"))
