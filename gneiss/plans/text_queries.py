"""Text queries: chunks, generic symbols, traces, diffs, routes and reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.functions import scalar as S
from gneiss.operators import text as T
from gneiss.plans.catalog import query
from gneiss.plans.projections import Tables, with_tables

_CHUNKS = """parts AS (SELECT path, string_split(text, chr(10)) AS l, unnest(range(1, greatest(1, len(string_split(text, chr(10))) - 4) + 1, 16)) AS a FROM files),
cut AS (SELECT path AS file_path, CAST(a AS INT) AS start_line, CAST(least(a + 19, len(l)) AS INT) AS end_line, array_to_string(list_slice(l, a, a + 19), chr(10)) AS content FROM parts),
chunks AS (SELECT *, sha256(content) AS content_hash FROM cut WHERE length(content) <= 12000)"""


@query("c1_chunks", with_tables("files", _CHUNKS + "||select||SELECT file_path, start_line, end_line, length(content) AS n_chars, file_path || ':' || start_line || ':' || end_line || ':' || substr(content_hash, 1, 16) AS chunk_id FROM chunks"))
def c1_chunks(spark, sf_dir):
    return T.chunks(Tables(spark, sf_dir).files, 20, 4).select("file_path", "start_line", "end_line", F.length("content").cast("long").alias("n_chars"), "chunk_id")


@query("a7_chunk_summary", with_tables("files", _CHUNKS + "||select||SELECT count(*) AS chunks, count(DISTINCT content_hash) AS contents, count(*) - count(DISTINCT content_hash) AS duplicates FROM chunks"))
def a7_chunk_summary(spark, sf_dir):
    return T.chunk_summary(T.chunks(Tables(spark, sf_dir).files, 20, 4))


@query("c4_omitted_chunks", with_tables("files", "SELECT path, length(text) > 12000 AS omitted FROM files WHERE size_bytes > 8000"))
def c4_omitted_chunks(spark, sf_dir):
    return Tables(spark, sf_dir).files.where("size_bytes > 8000").select("path", (F.length("text") > 12000).alias("omitted"))


_SOURCE = "SELECT 'f' || p_partkey AS path, 'import ' || replace(p_name, ' ', '.') || chr(10) || 'class C' || p_size || ':' || chr(10) || '    def m' || (p_partkey % 7) || '(self):' || chr(10) || 'async def g(x):' || chr(10) || 'const k' || p_size || ' = 1' AS text FROM part"


def _source(spark, sf_dir):
    parts = (F.lit("import "), F.replace("p_name", F.lit(" "), F.lit(".")), F.lit("\nclass C"), F.col("p_size"), F.lit(":\n    def m"), F.col("p_partkey") % 7, F.lit("(self):\nasync def g(x):\nconst k"), F.col("p_size"), F.lit(" = 1"))
    return Tables(spark, sf_dir).raw("part").select(F.concat(F.lit("f"), "p_partkey").alias("path"), F.concat(*parts).alias("text"))


@query("p7_generic_symbols", f"""WITH s AS ({_SOURCE}) SELECT path AS file_path, 'function' AS kind, unnest(list_distinct(regexp_extract_all(text, '(?m)^[ \\t]*(?:async )?def ([A-Za-z_]\\w*)', 1))) AS name FROM s
UNION ALL SELECT path, 'class', unnest(regexp_extract_all(text, '(?m)^[ \\t]*class ([A-Za-z_]\\w*)', 1)) FROM s UNION ALL SELECT path, 'constant', unnest(regexp_extract_all(text, '(?m)^[ \\t]*const ([A-Za-z_]\\w*) *=', 1)) FROM s""")  # fmt: skip
def p7_generic_symbols(spark, sf_dir):
    return T.generic_symbols(_source(spark, sf_dir))



@query("p7_generic_imports", "SELECT 'f' || p_partkey AS file_path, replace(p_name, ' ', '.') AS module FROM part")
def p7_generic_imports(spark, sf_dir):
    return T.generic_imports(_source(spark, sf_dir))



@query("p1_python_symbols", "SELECT 'f' || p_partkey AS file_path, unnest(['C' || p_size, 'C' || p_size || '.m' || (p_partkey % 7)]) AS qualified_name, unnest(['class', 'method']) AS kind, unnest([1, 2]) AS start_line, unnest(['', 'self.n']) AS calls FROM part")
def p1_python_symbols(spark, sf_dir):
    parts = (F.lit("class C"), F.col("p_size"), F.lit(":\n    def m"), F.col("p_partkey") % 7, F.lit("(self):\n        return self.n()\n"))
    files = Tables(spark, sf_dir).raw("part").select(F.concat(F.lit("f"), "p_partkey").alias("path"), F.concat(*parts).alias("text"))
    found = T.python_symbols(files)
    return found.select("file_path", "qualified_name", "kind", "start_line", F.when(F.col("kind") == "class", "").otherwise(F.array_join("calls", ",")).alias("calls"))



@query("g1_graph_build", "SELECT 'f' || p_partkey AS source, 'DEFINES' AS relation, unnest(['C' || p_size, 'C' || p_size || '.m']) AS target FROM part UNION SELECT unnest(['C' || p_size, 'C' || p_size || '.m']), 'CALLS', 'self.n' FROM part UNION SELECT 'C' || p_size, 'EXTENDS', 'Base' FROM part")
def g1_graph_build(spark, sf_dir):
    parts = (F.lit("class C"), F.col("p_size"), F.lit("(Base):\n    def m(self):\n        return self.n()\n"))
    files = Tables(spark, sf_dir).raw("part").select(F.concat(F.lit("f"), "p_partkey").alias("path"), F.concat(*parts).alias("text"))
    return T.parsed_edges(T.python_symbols(files))



@query("p13_stack_frames", """SELECT event_id AS trace_id, unnest([0, 1]) AS position, unnest(['a/' || event_type || '.py', 'b.py']) AS file, unnest([CAST(user_id AS INT), 7]) AS line, unnest(['run', 'go']) AS function FROM events""")
def p13_stack_frames(spark, sf_dir):
    text = F.concat(F.lit('Traceback\n  File "a/'), "event_type", F.lit('.py", line '), "user_id", F.lit(', in run\n    x()\n  File "b.py", line 7, in go\nValueError: no'))
    return T.stack_frames(Tables(spark, sf_dir).raw("events").select(F.col("event_id").alias("trace_id"), text.alias("text")))



@query("p14_diff_lines", "SELECT o_orderkey AS diff_id, 'src/f' || (o_orderkey % 9) AS file_path, CAST(unnest(range(o_orderkey % 50 + 1, o_orderkey % 50 + 1 + o_orderkey % 4)) AS INT) AS line FROM orders UNION SELECT o_orderkey, 'src/f' || (o_orderkey % 9), 900 FROM orders")
def p14_diff_lines(spark, sf_dir):
    k = F.col("o_orderkey")
    text = F.concat(F.lit("diff --git a/x b/x\n--- a/x\n+++ b/src/f"), k % 9, F.lit("\n@@ -1,2 +"), k % 50 + 1, F.lit(","), k % 4, F.lit(" @@ def f\n-a\n+b\n@@ -9 +900 @@\n+c"))
    return T.diff_lines(Tables(spark, sf_dir).raw("orders").select(k.alias("diff_id"), text.alias("text")))



_NORMAL = "CASE WHEN regexp_full_match({0}, '/+') THEN '/' ELSE rtrim({0}, '/') END"
_ROUTE = _NORMAL.format("regexp_replace('/' || ltrim(regexp_replace(regexp_replace({0}, '[?#].*$', ''), '^[a-z]+://[^/]*', ''), '/'), '^/api(/|$)', '/')")


@query("x11_normal_routes", f"SELECT page_id, {_ROUTE.format('url')} AS route FROM pages")
def x11_normal_routes(spark, sf_dir):
    return Tables(spark, sf_dir).raw("pages").select("page_id", S.normal_route(F.col("url")).alias("route"))


@query("x3_express_routes", "SELECT 's' || s_suppkey AS file_path, unnest(['GET', 'ANY']) AS method, unnest(['/items/' || s_nationkey, '/all']) AS route FROM supplier")
def x3_express_routes(spark, sf_dir):
    text = F.concat(F.lit("app.get('/api/items/"), "s_nationkey", F.lit("/', h); router.all( \"all\", h)"))
    return T.express_routes(Tables(spark, sf_dir).raw("supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("path"), text.alias("text")))


@query("x2_django_routes", "SELECT 's' || s_suppkey AS file_path, 'ANY' AS method, '/items/{pk}/' || s_nationkey AS route FROM supplier")
def x2_django_routes(spark, sf_dir):
    text = F.concat(F.lit("urlpatterns = [path('items/<int:pk>/"), "s_nationkey", F.lit("/', view)]"))
    return T.django_routes(Tables(spark, sf_dir).raw("supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("path"), text.alias("text")))


@query("x12_route_map", """WITH h AS (SELECT '/n/' || s_nationkey AS route, 's' || s_suppkey AS f FROM supplier), c AS (SELECT DISTINCT '/n/' || (c_nationkey + 10) AS route, 'c' || (c_custkey % 40) AS f FROM customer),
a AS (SELECT route, string_agg(DISTINCT f, ',' ORDER BY f) AS handlers FROM h GROUP BY 1), b AS (SELECT route, string_agg(DISTINCT f, ',' ORDER BY f) AS consumers FROM c GROUP BY 1)
SELECT route, coalesce(handlers, '') AS handlers, coalesce(consumers, '') AS consumers FROM a FULL JOIN b USING (route)""")  # fmt: skip
def x12_route_map(spark, sf_dir):
    t = Tables(spark, sf_dir)
    handlers = T.express_routes(t.raw("supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("path"), F.concat(F.lit("app.get('/api/n/"), "s_nationkey", F.lit("')")).alias("text")))
    consumers = T.fetched_routes(t.raw("customer").select(F.concat(F.lit("c"), F.col("c_custkey") % 40).alias("path"), F.concat(F.lit("await fetch('/api/n/"), F.col("c_nationkey") + 10, F.lit("?x=1')")).alias("text")))
    return T.route_map(handlers, consumers)


@query("r23_table_names", "SELECT n_nationkey, 'nation_t,t' || n_regionkey AS tables FROM nation")
def r23_table_names(spark, sf_dir):
    text = F.concat(F.lit("SELECT * FROM nation_T x JOIN t"), "n_regionkey", F.lit(" y ON x.a = y.a"))
    return Tables(spark, sf_dir).raw("nation").select("n_nationkey", F.array_join(T.table_names(text), ",").alias("tables"))


@query("t15_review", with_tables("files", """
SELECT path AS file_path, 'legal' AS category, 'low' AS severity, 'license mention' AS title FROM files WHERE contains(lower(text), 'license')
UNION ALL SELECT path, 'maintainability', 'medium', 'long file' FROM files WHERE len(string_split(text, chr(10))) > 30
UNION ALL SELECT path, 'maintainability', 'low', 'open todo' FROM files WHERE contains(lower(text), 'todo') OR contains(lower(text), 'fixme')
UNION ALL SELECT path, 'security', 'high', 'token without validation' FROM files WHERE contains(lower(text), 'token') AND NOT (contains(lower(text), 'verify') OR contains(lower(text), 'validate') OR contains(lower(text), 'check')) AND (contains(text, '=') OR contains(lower(text), 'header') OR contains(lower(text), 'bearer'))"""))  # fmt: skip
def t15_review(spark, sf_dir):
    return T.review(Tables(spark, sf_dir).files, 30)


@query("t6_rename_preview", with_tables("files", r"""
l AS (SELECT path, unnest(string_split(text, chr(10))) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM files WHERE language = 'en' AND regexp_matches(text, '(?:^|[^A-Za-z0-9_])token(?:$|[^A-Za-z0-9_])'))
||select||SELECT path AS file_path, CAST(line AS INT) AS line, regexp_replace(t, '\btoken\b', 'credential', 'g') AS after FROM l WHERE regexp_matches(t, '\btoken\b')"""))  # fmt: skip
def t6_rename_preview(spark, sf_dir):
    return T.rename_preview(Tables(spark, sf_dir).files.where("language = 'en'"), "token", "credential")


@query("b22_phrase_terms", "WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM benchmark) SELECT item_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS term FROM (SELECT item_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)")
def b22_phrase_terms(spark, sf_dir):
    return Tables(spark, sf_dir).raw("benchmark").select("item_id", F.explode(T.phrase_terms(F.col("text"), 3)).alias("term"))


@query("b38_snippets", with_tables("files", "SELECT path, array_to_string(list_slice(string_split(text, chr(10)), 2, 6), chr(10)) AS snippet FROM files"))
def b38_snippets(spark, sf_dir):
    return Tables(spark, sf_dir).files.select("path", F.array_join(F.slice(F.split("text", "\n"), 2, 5), "\n").alias("snippet"))


@query("c2_semantic_chunks", with_tables("files recursive", """
l AS (SELECT path, unnest(string_split(text, chr(10))) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM files),
e AS (SELECT path, max(i) AS n FROM l GROUP BY path),
s(path, a) AS (SELECT path, 1::BIGINT FROM e UNION ALL SELECT s.path, (SELECT min(i) FROM l WHERE l.path = s.path AND i - s.a >= 5 AND starts_with(t, 'def ')) FROM s WHERE EXISTS (SELECT 1 FROM l WHERE l.path = s.path AND i - s.a >= 5 AND starts_with(t, 'def ')))
||select||SELECT path AS file_path, CAST(a AS INT) AS start_line, CAST(coalesce(lead(a) OVER (PARTITION BY path ORDER BY a) - 1, n) AS INT) AS end_line FROM s JOIN e USING (path)"""))  # fmt: skip
def c2_semantic_chunks(spark, sf_dir):
    from gneiss.operators.batching import semantic_chunks

    return semantic_chunks(Tables(spark, sf_dir).files, 5)



@query("w10_token_batches", """WITH RECURSIVE d AS (SELECT source, doc_id AS id, CAST(ceil(n_chars / 4) AS BIGINT) AS tokens, row_number() OVER (PARTITION BY source ORDER BY doc_id, n_chars) AS i FROM documents),
r AS (SELECT source, id, i, 0 AS batch, 1 AS n, tokens AS t FROM d WHERE i = 1
  UNION ALL SELECT d.source, d.id, d.i, CASE WHEN r.n >= 24 OR r.t + d.tokens > 12000 THEN r.batch + 1 ELSE r.batch END, CASE WHEN r.n >= 24 OR r.t + d.tokens > 12000 THEN 1 ELSE r.n + 1 END, CASE WHEN r.n >= 24 OR r.t + d.tokens > 12000 THEN d.tokens ELSE r.t + d.tokens END
  FROM r JOIN d ON d.source IS NOT DISTINCT FROM r.source AND d.i = r.i + 1) SELECT source, id, batch FROM r""")  # fmt: skip
def w10_token_batches(spark, sf_dir):
    from gneiss.operators.batching import token_batches

    rows = Tables(spark, sf_dir).raw("documents").select("source", F.col("doc_id").alias("id"), F.ceil(F.col("n_chars") / 4).alias("tokens"))
    return token_batches(rows, "source", 24, 12_000)


@query("x1_decorator_routes", "SELECT 's' || s_suppkey AS file_path, unnest(['GET', 'POST', 'DELETE']) AS kind, unnest(['/n/' || s_nationkey, '/n/' || s_nationkey, '/d']) AS name, unnest([1, 1, 4]) AS line, unnest(['f', 'f', 'g']) AS detail FROM supplier")
def x1_decorator_routes(spark, sf_dir):
    from gneiss.operators.parsers import parsed

    text = F.concat(F.lit('@app.route("/n/'), "s_nationkey", F.lit('", methods=["GET", "POST"])\ndef f():\n    pass\n@app.delete("d")\ndef g(): ...'))
    return parsed(Tables(spark, sf_dir).raw("supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("path"), text.alias("text")), "decorator_routes")


@query("p2_typescript_symbols", "SELECT 's' || s_suppkey || '.tsx' AS file_path, unnest(['component', 'interface', 'hook']) AS kind, unnest(['View' || s_nationkey, 'Props', 'useData']) AS name, CAST(unnest([1, 2, 3]) AS INT) AS line, unnest(['default', '', 'exported']) AS detail FROM supplier")
def p2_typescript_symbols(spark, sf_dir):
    from gneiss.operators.parsers import parsed

    text = F.concat(F.lit("export default function View"), "s_nationkey", F.lit("() {}\ninterface Props {}\nexport const useData = (a) => a"))
    return parsed(Tables(spark, sf_dir).raw("supplier").select(F.concat(F.lit("s"), "s_suppkey", F.lit(".tsx")).alias("path"), text.alias("text")), "typescript")


@query("p3_c_symbols", "SELECT 's' || s_suppkey || '.h' AS file_path, unnest(['macro', 'struct', 'declaration']) AS kind, unnest(['MAX' || s_nationkey, 'S', 'go']) AS name, CAST(unnest([1, 2, 3]) AS INT) AS line, 'header' AS detail FROM supplier")
def p3_c_symbols(spark, sf_dir):
    from gneiss.operators.parsers import parsed

    text = F.concat(F.lit("#define MAX"), "s_nationkey", F.lit(" 3\nstruct S { int a; };\nint go(int a);"))
    return parsed(Tables(spark, sf_dir).raw("supplier").select(F.concat(F.lit("s"), "s_suppkey", F.lit(".h")).alias("path"), text.alias("text")), "c_family")
