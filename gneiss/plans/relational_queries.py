"""Relational queries: scans, filters, joins, aggregates, windows, set operations and top-k over the projections."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gneiss.functions import scalar as S
from gneiss.operators import change as C
from gneiss.operators import graph as G
from gneiss.operators import relational as R
from gneiss.plans.catalog import query
from gneiss.plans.projections import Tables, with_tables

# --- scans and sinks ---


@query("s1_scan", "SELECT source || '/doc_' || doc_id AS path, lang AS language, CAST(strlen(text) AS BIGINT) AS size_bytes, sha256(text) AS sha256 FROM documents WHERE lang IS NOT NULL")
def s1_scan(spark, sf_dir):
    return Tables(spark, sf_dir).files.where("language is not null").select("path", "language", "size_bytes", "sha256")


@query("s2_language", """SELECT page_id, CASE page_id % 12 WHEN 0 THEN 'python' WHEN 1 THEN 'tsx' WHEN 2 THEN 'c' WHEN 3 THEN 'dockerfile' WHEN 4 THEN 'cpp' WHEN 6 THEN 'rust_project' WHEN 7 THEN 'object_pascal_form' WHEN 8 THEN 'typescript' WHEN 9 THEN 'go_project' WHEN 10 THEN 'kotlin' WHEN 11 THEN 'native_build' END AS language FROM pages""")
def s2_language(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in ("a/b.py", "src/x.test.TSX", "lib/y.h", "deploy/Dockerfile", "z.hpp", "data.unknown", "x/Cargo.toml", "Main.DFM", "a.js", "go.mod", "b.gradle.kts", "CMakeLists.txt")])
    pages = Tables(spark, sf_dir).raw("pages")
    return pages.select("page_id", S.language_of(names[(F.col("page_id") % 12).cast("int")]).alias("language"))


@query("s3_ignore_rules", with_tables("files", r"SELECT path FROM files WHERE NOT (regexp_matches(path, '^src1.*$') OR regexp_matches(path, '^(.*/)?doc_.7$'))"))
def s3_ignore_rules(spark, sf_dir):
    path = F.col("path")
    return Tables(spark, sf_dir).files.where(~(S.matches_glob(path, "src1*") | S.matches_glob(path, "doc_?7"))).select("path")


@query("s4_minified", with_tables("files", "SELECT path FROM files WHERE size_bytes >= 3000 AND len(string_split(text, chr(10))) <= 8 AND list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) >= 1500"))
def s4_minified(spark, sf_dir):
    return Tables(spark, sf_dir).files.where(S.is_minified(F.col("text"), 3000, 8, 1500)).select("path")


@query("s5_size_cap", with_tables("files", "SELECT path, size_bytes FROM files WHERE size_bytes <= 10000"))
def s5_size_cap(spark, sf_dir):
    return Tables(spark, sf_dir).files.where("size_bytes <= 10000").select("path", "size_bytes")


@query("s6_content_hash", with_tables("files", "SELECT sha256, count(*) AS n FROM files GROUP BY sha256 HAVING count(*) > 1"))
def s6_content_hash(spark, sf_dir):
    return Tables(spark, sf_dir).files.groupBy("sha256").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("s7_table_scan", "SELECT * FROM nation")
def s7_table_scan(spark, sf_dir):
    return Tables(spark, sf_dir).raw("nation")


@query("s8_point_lookup", "SELECT * FROM orders WHERE o_orderkey = 77")
def s8_point_lookup(spark, sf_dir):
    return Tables(spark, sf_dir).raw("orders").where("o_orderkey = 77")


@query("s9_symbols_by_file", with_tables("symbols", "SELECT file_path, string_agg(qualified_name, ',' ORDER BY qualified_name) AS symbols, count(*) AS n FROM symbols WHERE kind IN ('part', 'supplier') GROUP BY file_path"))
def s9_symbols_by_file(spark, sf_dir):
    some = Tables(spark, sf_dir).symbols.where("kind in ('part', 'supplier')")
    return some.groupBy("file_path").agg(S.joined(F.collect_list("qualified_name")).alias("symbols"), F.count(F.lit(1)).alias("n"))


@query("s10_upsert", "SELECT c_custkey, c_name, CASE WHEN c_custkey % 7 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS c_mktsegment FROM customer UNION ALL SELECT c_custkey + 1000000, c_name, 'NEW' FROM customer WHERE c_custkey % 50 = 0")
def s10_upsert(spark, sf_dir):
    old = Tables(spark, sf_dir).raw("customer").select("c_custkey", "c_name", "c_mktsegment")
    new = old.where("c_custkey % 7 = 0").withColumn("c_mktsegment", F.lit("CHANGED")).unionByName(old.where("c_custkey % 50 = 0").withColumn("c_custkey", F.col("c_custkey") + 1000000).withColumn("c_mktsegment", F.lit("NEW")))
    return R.upsert(old, new, ["c_custkey"])


@query("s11_cascade_delete", with_tables("symbols edges", """
gone AS (SELECT qualified_name FROM symbols WHERE file_path IN ('AUTOMOBILE', 'Brand#11'))
||select||SELECT relation, count(*) AS n FROM edges WHERE source NOT IN (SELECT * FROM gone) AND target NOT IN (SELECT * FROM gone) GROUP BY relation"""))  # fmt: skip
def s11_cascade_delete(spark, sf_dir):
    t = Tables(spark, sf_dir)
    files = spark.createDataFrame([("AUTOMOBILE",), ("Brand#11",)], "path string")
    return R.cascade_delete(t.edges, t.symbols, files)[1].groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


@query("s14_graph_write", with_tables("edges", "SELECT relation, count(*) AS n FROM (SELECT DISTINCT * FROM (SELECT * FROM edges UNION ALL SELECT * FROM edges)) GROUP BY relation"))
def s14_graph_write(spark, sf_dir):
    e = Tables(spark, sf_dir).edges
    return e.unionByName(e).distinct().groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


@query("s16_vector_upsert", "SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN -1 ELSE label END AS label FROM embeddings")
def s16_vector_upsert(spark, sf_dir):
    old = Tables(spark, sf_dir).raw("embeddings").select("vec_id", "label")
    new = old.where("vec_id % 5 = 0").withColumn("label", F.lit(-1))
    return R.without(old, new, "vec_id").unionByName(new)


@query("s17_embedding_cache", with_tables("files", "SELECT hit, count(*) AS n FROM (SELECT DISTINCT sha256, sha256 IN (SELECT sha256 FROM files WHERE modified_time % 3 = 0) AS hit FROM files) GROUP BY hit"))
def s17_embedding_cache(spark, sf_dir):
    files = Tables(spark, sf_dir).files
    cache = files.where("modified_time % 3 = 0").select("sha256").distinct()
    hits, misses = R.cache_lookup(files, cache, "sha256")
    return hits.select(F.lit(True).alias("hit")).unionByName(misses.select(F.lit(False).alias("hit"))).groupBy("hit").agg(F.count(F.lit(1)).alias("n"))


@query("s21_group_read", "SELECT repo, count(*) AS n FROM (SELECT 'a' AS repo FROM customer UNION ALL SELECT 'b' FROM supplier) GROUP BY repo")
def s21_group_read(spark, sf_dir):
    t = Tables(spark, sf_dir)
    a, b = (t.raw(x).select(F.lit(r).alias("repo")) for x, r in (("customer", "a"), ("supplier", "b")))
    return a.unionByName(b).groupBy("repo").agg(F.count(F.lit(1)).alias("n"))


# --- filters ---


@query("f1_symbol_search", with_tables("symbols", """
SELECT qualified_name, name, CASE WHEN name = 'nation_1' OR qualified_name = 'nation_1' THEN 0 WHEN lower(name) = 'nation_1' THEN 2 ELSE 3 END AS rank FROM symbols
WHERE contains(lower(name), 'nation_1') OR contains(lower(qualified_name), 'nation_1') OR file_path = 'nation_1' ORDER BY rank, file_path, start_line, qualified_name LIMIT 20"""))  # fmt: skip
def f1_symbol_search(spark, sf_dir):
    return R.search_symbols(Tables(spark, sf_dir).symbols, "nation_1", 20).select("qualified_name", "name", "rank")


@query("f2_chunk_search", with_tables("files", "SELECT path FROM files WHERE path = 'src3/doc_3' OR path IN (SELECT source || '/doc_' || doc_id FROM documents WHERE lang = 'fr' AND doc_id % 10 = 1) OR contains(lower(text), 'license')"))
def f2_chunk_search(spark, sf_dir):
    files = Tables(spark, sf_dir).files
    wanted = files.where("language = 'fr' and modified_time % 10 = 1").select("path").withColumn("__w", F.lit(True))
    return files.join(wanted, "path", "left").where("path = 'src3/doc_3' or __w or contains(lower(text), 'license')").select("path")


@query("f3_token_search", with_tables("files", """
SELECT path, CAST(contains(lower(text), 'license') AS INT) + CAST(contains(lower(text), 'token') AS INT) + CAST(contains(lower(text), 'the') AS INT) AS hits FROM files
WHERE contains(lower(text), 'license') OR contains(lower(text), 'token') OR contains(lower(text), 'the') ORDER BY hits DESC, path LIMIT 40"""))  # fmt: skip
def f3_token_search(spark, sf_dir):
    files = Tables(spark, sf_dir).files.select(F.col("path").alias("file_path"), F.lit(1).alias("start_line"), F.col("text").alias("content"))
    return R.search_tokens(files, "license of the token", 40).select(F.col("file_path").alias("path"), "hits")


@query("f5_glob", with_tables("symbols", r"SELECT qualified_name FROM symbols WHERE regexp_matches(file_path, '^Brand#1.$')"))
def f5_glob(spark, sf_dir):
    return Tables(spark, sf_dir).symbols.where(S.matches_glob(F.col("file_path"), "Brand#1?")).select("qualified_name")


@query("f6_test_paths", "SELECT page_id, page_id % 3 = 0 OR page_id % 5 = 0 AS is_test FROM pages")
def f6_test_paths(spark, sf_dir):
    path = F.when(F.col("page_id") % 3 == 0, "src/tests/a.py").when(F.col("page_id") % 5 == 0, "web/app.spec.ts").otherwise("src/contest/a.py")
    return Tables(spark, sf_dir).raw("pages").select("page_id", S.is_test_path(path).alias("is_test"))


@query("f8_noise_references", with_tables("symbols", "SELECT kind, count(*) AS n FROM symbols WHERE length(name) > 8 AND name NOT IN ('order.1-URGENT', 'ARGENTINA') GROUP BY kind"))
def f8_noise_references(spark, sf_dir):
    return Tables(spark, sf_dir).symbols.where((F.length("name") > 8) & ~F.col("name").isin("order.1-URGENT", "ARGENTINA")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


_HINTS = "array_to_string(list_filter([{}], lambda x: x IS NOT NULL), ',')".format(", ".join(f"CASE WHEN regexp_matches(lower({{p}}), '{p}') THEN '{h}' END" for h, p, *_ in C.PATH_RULES))
_RISKY = "(" + " OR ".join(f"regexp_matches(lower({{p}}), '{p}')" for _, p, high, _ in C.PATH_RULES if high) + ")"
_TOUCHED = "SELECT CASE l_suppkey % 4 WHEN 0 THEN 'src/auth/s' WHEN 1 THEN 'app/config/s' WHEN 2 THEN 'lib/core/s' ELSE 'tests/unit/s' END || l_suppkey AS file_path, count(DISTINCT l_partkey) % 10 AS n_symbols, count(*) % 3 AS n_impacted FROM lineitem GROUP BY l_suppkey"


def _touched(spark, sf_dir):
    place = F.array(*[F.lit(x) for x in ("src/auth/s", "app/config/s", "lib/core/s", "tests/unit/s")])[(F.col("l_suppkey") % 4).cast("int")]
    return Tables(spark, sf_dir).raw("lineitem").groupBy("l_suppkey").agg((F.countDistinct("l_partkey") % 10).alias("n_symbols"), (F.count(F.lit(1)) % 3).alias("n_impacted")).select(F.concat(place, "l_suppkey").alias("file_path"), "n_symbols", "n_impacted")


_FILE_RISK = f"""t AS ({_TOUCHED}), h AS (SELECT *, {_HINTS.format(p="file_path")} AS hints, {_RISKY.format(p="file_path")} AS risky FROM t),
f AS (SELECT file_path, n_symbols, n_impacted, hints, CASE WHEN n_symbols >= 8 OR risky THEN 'HIGH' WHEN n_symbols >= 3 OR n_impacted > 0 OR hints <> '' THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM h)"""


@query("f10_path_risk", f"WITH {_FILE_RISK} SELECT * FROM f")
def f10_path_risk(spark, sf_dir):
    return C.file_risk(_touched(spark, sf_dir))


@query("a12_change_risk", f"""WITH {_FILE_RISK}, o AS (SELECT count(*) AS files, CAST(sum(n_symbols) AS BIGINT) AS symbols, CAST(sum(n_impacted) AS BIGINT) AS impacted, count(*) FILTER (WHERE risk = 'HIGH') AS high, count(*) FILTER (WHERE risk = 'MEDIUM') AS medium FROM f),
p AS (SELECT *, CAST(least(2 * files, 50) + least(symbols, 60) + least(impacted // 2, 40) + 10 * high + 4 * medium AS BIGINT) AS points FROM o)
SELECT *, CASE WHEN files >= 25 OR symbols >= 100 OR impacted >= 50 THEN 'CRITICAL' WHEN high > 0 OR symbols >= 8 OR impacted >= 12 THEN 'HIGH' WHEN medium > 0 OR symbols >= 3 OR impacted >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS risk,
 CASE WHEN points >= 100 THEN 'CRITICAL' WHEN points >= 55 THEN 'HIGH' WHEN points >= 20 THEN 'MEDIUM' ELSE 'LOW' END AS points_label FROM p""")  # fmt: skip
def a12_change_risk(spark, sf_dir):
    return C.change_risk(C.file_risk(_touched(spark, sf_dir)))


@query("f15_module", with_tables("files", "SELECT split_part(path, '/', 1) AS module, count(*) AS n FROM files GROUP BY 1"))
def f15_module(spark, sf_dir):
    return Tables(spark, sf_dir).files.groupBy(S.module_of(F.col("path")).alias("module")).agg(F.count(F.lit(1)).alias("n"))


# --- joins ---


@query("j1_either_key", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT s_suppkey FROM supplier) OR o_custkey IN (SELECT s_nationkey FROM supplier)")
def j1_either_key(spark, sf_dir):
    t = Tables(spark, sf_dir)
    suppliers = t.raw("supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("s_nationkey"))
    return R.either_match(t.raw("orders"), suppliers, "o_custkey", ["s_suppkey", "s_nationkey"]).select("o_orderkey")


@query("j2_members", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def j2_members(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.raw("nation").join(t.raw("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


@query("j3_semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def j3_semi_join(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.raw("customer").join(t.raw("orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey")


@query("j4_symbol_files", with_tables("symbols edges", "SELECT file_path, count(*) AS n FROM edges LEFT JOIN symbols ON qualified_name = target GROUP BY file_path"))
def j4_symbol_files(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.edges.join(t.symbols.select(F.col("qualified_name").alias("target"), "file_path"), "target", "left").groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))


_LINES = "SELECT DISTINCT 'Brand#' || (10 + l_partkey % 45) AS file_path, CAST(l_orderkey % 960 AS BIGINT) AS line FROM lineitem WHERE l_suppkey = 1"


def _changed_lines(spark, sf_dir):
    return Tables(spark, sf_dir).raw("lineitem").where("l_suppkey = 1").select(F.concat(F.lit("Brand#"), 10 + F.col("l_partkey") % 45).alias("file_path"), (F.col("l_orderkey") % 960).alias("line")).distinct()


@query("j6_changed_symbols", with_tables("symbols", f"x AS ({_LINES})||select||SELECT DISTINCT qualified_name FROM symbols JOIN x ON x.file_path = symbols.file_path AND line BETWEEN start_line AND end_line"))
def j6_changed_symbols(spark, sf_dir):
    return R.changed_symbols(Tables(spark, sf_dir).symbols, _changed_lines(spark, sf_dir)).select("qualified_name")


_CHUNKS = """parts AS (SELECT path, string_split(text, chr(10)) AS l, unnest(range(1, greatest(1, len(string_split(text, chr(10))) - 2) + 1, 6)) AS a FROM files),
chunks AS (SELECT path AS file_path, a AS start_line, least(a + 7, len(l)) AS end_line, array_to_string(list_slice(l, a, a + 7), chr(10)) AS content, sha256(array_to_string(list_slice(l, a, a + 7), chr(10))) AS content_hash FROM parts),
ids AS (SELECT *, file_path || ':' || start_line || ':' || end_line || ':' || substr(content_hash, 1, 16) AS chunk_id FROM chunks WHERE length(content) <= 12000)"""


@query("j7_neighbour_chunks", with_tables("files", _CHUNKS + """,
seeds AS (SELECT chunk_id AS seed, file_path, start_line AS a, end_line AS b FROM ids WHERE start_line = 7),
r AS (SELECT seed, chunk_id, row_number() OVER (PARTITION BY seed ORDER BY (start_line <= a AND end_line >= b) DESC, abs(start_line - a), chunk_id) AS k FROM seeds JOIN ids USING (file_path) WHERE chunk_id <> seed AND start_line <= b + 10 AND end_line >= a - 10)
||select||SELECT seed, chunk_id FROM r WHERE k <= 4"""))  # fmt: skip
def j7_neighbour_chunks(spark, sf_dir):
    from gneiss.operators.text import chunks

    every = chunks(Tables(spark, sf_dir).files, 8, 2)
    return R.neighbour_chunks(every.where("start_line = 7"), every, 10, 4).select("seed", "chunk_id")


@query("j9_enclosing_symbols", with_tables("symbols", """
fr AS (SELECT event_id AS frame_id, 'Brand#' || (11 + event_id % 5) AS file_path, CAST(floor(value) AS INT) * 3 AS line FROM events),
x AS (SELECT frame_id, qualified_name, coalesce(line BETWEEN start_line AND end_line, false) AS inside, start_line, end_line FROM fr LEFT JOIN symbols USING (file_path)),
r AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY inside DESC, CASE WHEN inside THEN end_line - start_line END NULLS LAST, start_line NULLS LAST, qualified_name NULLS LAST) AS k FROM x)
||select||SELECT frame_id, qualified_name, inside FROM r WHERE k = 1"""))  # fmt: skip
def j9_enclosing_symbols(spark, sf_dir):
    t = Tables(spark, sf_dir)
    frames = t.raw("events").select(F.col("event_id").alias("frame_id"), F.concat(F.lit("Brand#"), 11 + F.col("event_id") % 5).alias("file_path"), (F.floor("value").cast("int") * 3).alias("line"))
    return R.enclosing_symbols(frames, t.symbols).select("frame_id", "qualified_name", "inside")



@query("j10_dead_code", with_tables("symbols edges", """
SELECT qualified_name, kind FROM symbols WHERE qualified_name NOT IN (SELECT target FROM edges WHERE relation IN ('CALLS', 'REFERENCES', 'EXTENDS')) AND kind NOT IN ('module', 'exports', 'entry_point', 'test_file')"""))  # fmt: skip
def j10_dead_code(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return R.dead_symbols(t.symbols, t.edges, ["CALLS", "REFERENCES", "EXTENDS"]).select("qualified_name", "kind")


@query("j11_untested", with_tables("symbols edges", "SELECT file_path, count(*) AS n FROM symbols WHERE kind IN ('part', 'supplier') AND qualified_name NOT IN (SELECT target FROM edges WHERE source IN (SELECT 'o' || o_orderkey FROM orders WHERE o_orderkey % 2 = 0)) GROUP BY file_path"))
def j11_untested(spark, sf_dir):
    t = Tables(spark, sf_dir)
    tests = t.raw("orders").where("o_orderkey % 2 = 0").select(F.concat(F.lit("o"), "o_orderkey").alias("source"))
    covered = t.links.select("source", "target").join(tests, "source", "left_semi")
    return R.without(t.symbols.where("kind in ('part', 'supplier')"), covered, "qualified_name", "target").groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))


@query("j12_plan_changes", with_tables("files", "SELECT path, CASE WHEN modified_time % 11 = 0 THEN 'deleted' WHEN modified_time % 13 = 0 OR modified_time % 17 = 0 THEN 'changed' ELSE 'unchanged' END AS status FROM files"))
def j12_plan_changes(spark, sf_dir):
    files = Tables(spark, sf_dir).files.select("path", "sha256", "modified_time")
    old = files.where("not (modified_time % 17 = 0 and modified_time % 11 <> 0)")
    new = files.where("modified_time % 11 <> 0").withColumn("sha256", F.when(F.col("modified_time") % 13 == 0, "x").otherwise(F.col("sha256")))
    return R.plan_changes(old, new)


@query("j13_chunk_diff", with_tables("files", "SELECT status, count(*) AS n FROM (SELECT sha256, CASE WHEN max(modified_time % 2) = 0 THEN 'stale' WHEN max(CAST(modified_time % 2 = 0 OR modified_time % 3 = 0 AS INT)) = 0 THEN 'new' ELSE 'unchanged' END AS status FROM (SELECT min(modified_time) AS modified_time, sha256 FROM files GROUP BY sha256) GROUP BY sha256) GROUP BY status"))
def j13_chunk_diff(spark, sf_dir):
    files = Tables(spark, sf_dir).files.groupBy("sha256").agg(F.min("modified_time").alias("m"))
    return R.id_changes(files.where("m % 2 = 0 or m % 3 = 0"), files.where("m % 2 = 1"), "sha256").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("j18_shared_members", "WITH m AS (SELECT DISTINCT l_suppkey AS g, l_partkey AS i FROM lineitem), f AS (SELECT * FROM m WHERE i IN (SELECT i FROM m GROUP BY i HAVING count(*) <= 24)) SELECT a.g AS left_id, b.g AS right_id, a.i AS item FROM f AS a JOIN f AS b ON a.i = b.i AND a.g < b.g")
def j18_shared_members(spark, sf_dir):
    m = Tables(spark, sf_dir).raw("lineitem").select(F.col("l_suppkey").alias("g"), F.col("l_partkey").alias("item"))
    return R.shared_members(m, "g", "item", 24)



@query("j19_cross_repo", "SELECT p.p_partkey AS left_id, s.s_suppkey AS right_id FROM part AS p JOIN supplier AS s ON p.p_partkey % 10 = CAST(right(s.s_name, 1) AS INT) AND p.p_partkey % 100 = s.s_suppkey")
def j19_cross_repo(spark, sf_dir):
    t = Tables(spark, sf_dir)
    p = t.raw("part").select(F.col("p_partkey").alias("left_id"), (F.col("p_partkey") % 10).cast("string").alias("tail"), (F.col("p_partkey") % 100).alias("right_id"))
    s = t.raw("supplier").select(F.col("s_suppkey").alias("right_id"), F.expr("right(s_name, 1)").alias("tail"))
    return p.join(s, ["right_id", "tail"]).select("left_id", "right_id")


@query("j21_missing_keys", """WITH want AS (SELECT 'r' || (l_suppkey % 20) AS route, unnest(['k' || (l_partkey % 6), 'k' || (l_linenumber % 6)]) AS k FROM lineitem), c AS (SELECT 'r' || (l_suppkey % 20) AS route, count(*) AS consumers FROM lineitem GROUP BY 1),
have AS (SELECT 'r' || r AS route, 'k' || k AS k FROM range(0, 15) a(r), range(0, 5) b(k) WHERE k <= r % 6),
m AS (SELECT route, string_agg(DISTINCT k, ',' ORDER BY k) AS missing FROM want WHERE route IN (SELECT route FROM have) AND (route, k) NOT IN (SELECT (route, k) FROM have) GROUP BY route)
SELECT route, consumers, coalesce(missing, '') AS missing, CASE WHEN missing IS NULL THEN 'OK' ELSE 'MISMATCH' END AS status, CASE WHEN missing IS NOT NULL OR consumers >= 5 THEN 'HIGH' ELSE 'MEDIUM' END AS risk FROM c LEFT JOIN m USING (route)""")  # fmt: skip
def j21_missing_keys(spark, sf_dir):
    lines = Tables(spark, sf_dir).raw("lineitem")
    key = lambda c: F.concat(F.lit("k"), F.col(c) % 6)
    consumed = lines.select(F.concat(F.lit("r"), F.col("l_suppkey") % 20).alias("route"), F.array(key("l_partkey"), key("l_linenumber")).alias("keys"))
    provided = spark.range(15).select(F.concat(F.lit("r"), "id").alias("route"), F.expr("transform(filter(sequence(0, 4), k -> k <= id % 6), k -> 'k' || k)").alias("keys"))
    return C.missing_keys(consumed, provided)


@query("j27_nearest_project", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'a/b' WHEN page_id % 3 = 1 THEN 'a' END AS project FROM pages")
def j27_nearest_project(spark, sf_dir):
    path = F.when(F.col("page_id") % 3 == 0, "a/b/c/x.py").when(F.col("page_id") % 3 == 1, "a/c/x.py").otherwise("z/x.py")
    pages = Tables(spark, sf_dir).raw("pages").select("page_id", F.split(path, "/").alias("parts"))
    prefixes = pages.select("page_id", F.explode(F.expr("transform(sequence(1, size(parts)), k -> array_join(slice(parts, 1, k), '/'))")).alias("project"))
    projects = spark.createDataFrame([("a",), ("a/b",)], "project string")
    found = prefixes.join(projects, "project").groupBy("page_id").agg(F.max_by("project", F.length("project")).alias("project"))
    return pages.select("page_id").join(found, "page_id", "left")


# --- aggregates ---


@query("a1_group_counts", "SELECT o_orderpriority AS key, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, key LIMIT 12")
def a1_group_counts(spark, sf_dir):
    return R.top(Tables(spark, sf_dir).raw("orders").groupBy(F.col("o_orderpriority").alias("key")).agg(F.count(F.lit(1)).alias("n")), [F.desc("n"), F.asc("key")], 12)


@query("a2_relation_counts", with_tables("edges", "SELECT relation, count(*) AS n FROM edges GROUP BY relation"))
def a2_relation_counts(spark, sf_dir):
    return Tables(spark, sf_dir).edges.groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


@query("a3_dependants", with_tables("symbols edges", "SELECT relation, file_path, count(DISTINCT source) AS dependants FROM edges JOIN symbols ON qualified_name = target GROUP BY GROUPING SETS ((relation), (relation, file_path))"))
def a3_dependants(spark, sf_dir):
    t = Tables(spark, sf_dir)
    joined = t.edges.join(t.symbols.select(F.col("qualified_name").alias("target"), "file_path"), "target")
    return joined.groupingSets([("relation",), ("relation", "file_path")], "relation", "file_path").agg(F.countDistinct("source").alias("dependants")).select("relation", "file_path", "dependants")


@query("a4_pivot", with_tables("edges", "SELECT left(source, 1) AS kind, count(*) FILTER (WHERE relation = 'CALLS') AS calls, count(*) FILTER (WHERE relation = 'REFERENCES') AS refs, count(*) FILTER (WHERE relation = 'USES_SERVICE') AS uses FROM edges GROUP BY 1"))
def a4_pivot(spark, sf_dir):
    p = Tables(spark, sf_dir).edges.groupBy(F.expr("left(source, 1)").alias("kind")).pivot("relation", ["CALLS", "REFERENCES", "USES_SERVICE"]).count().na.fill(0)
    return p.select("kind", F.col("CALLS").alias("calls"), F.col("REFERENCES").alias("refs"), F.col("USES_SERVICE").alias("uses"))


@query("a6_file_dependencies", with_tables("symbols edges", """
SELECT s.file_path AS from_file, t.file_path AS to_file, count(*) AS n, array_to_string(list_slice(list(source || '>' || target ORDER BY source || '>' || target), 1, 5), ',') AS samples FROM edges
JOIN symbols AS s ON s.qualified_name = source JOIN symbols AS t ON t.qualified_name = target WHERE relation IN ('USES_SERVICE', 'HAS_PROPERTY') GROUP BY ALL"""))  # fmt: skip
def a6_file_dependencies(spark, sf_dir):
    t = Tables(spark, sf_dir)
    ends = t.symbols.select("qualified_name", "file_path")
    e = t.edges.where("relation in ('USES_SERVICE', 'HAS_PROPERTY')")
    e = e.join(ends.select(F.col("qualified_name").alias("source"), F.col("file_path").alias("from_file")), "source").join(ends.select(F.col("qualified_name").alias("target"), F.col("file_path").alias("to_file")), "target")
    pair = F.concat("source", F.lit(">"), "target")
    # Only the five samples of a pair are kept, not its list.
    five = R.best_per_key(e.withColumn("pair", pair), ["from_file", "to_file"], [F.asc("pair")], 5).groupBy("from_file", "to_file").agg(S.joined(F.collect_list("pair")).alias("samples"))
    return e.groupBy("from_file", "to_file").agg(F.count(F.lit(1)).alias("n")).join(five, ["from_file", "to_file"])


@query("a8_clusters", with_tables("steps", """
p AS (SELECT process_id, count(*) AS n, string_agg(symbol, '>' ORDER BY step) AS path, min(symbol) AS least FROM steps GROUP BY process_id)
||select||SELECT left(least, 9) AS signature, count(*) AS processes, round(avg(n), 2) AS avg_steps, max(path) AS representative FROM p GROUP BY 1"""))  # fmt: skip
def a8_clusters(spark, sf_dir):
    p = Tables(spark, sf_dir).steps.groupBy("process_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("step", "symbol"))), lambda x: x.symbol), ">").alias("path"), F.min("symbol").alias("least"))
    return p.groupBy(F.expr("left(least, 9)").alias("signature")).agg(F.count(F.lit(1)).alias("processes"), F.round(F.avg("n"), 2).alias("avg_steps"), F.max("path").alias("representative"))


@query("a10_semantic_weight", with_tables("edges", "SELECT source AS node, CAST(sum(CASE relation WHEN 'CALLS' THEN 100 WHEN 'USES_SERVICE' THEN 80 WHEN 'EXTENDS' THEN 80 WHEN 'HAS_PROPERTY' THEN 45 WHEN 'REFERENCES' THEN 35 ELSE 25 END) AS DOUBLE) / 100 AS weight FROM edges GROUP BY source"))
def a10_semantic_weight(spark, sf_dir):
    weight = F.round(F.coalesce(S.lookup(G.WEIGHTS, F.col("relation")), F.lit(0.25)) * 100).cast("int")
    return Tables(spark, sf_dir).edges.groupBy(F.col("source").alias("node")).agg((F.sum(weight).cast("double") / 100).alias("weight"))


@query("a11_affected_modules", with_tables("files", "SELECT split_part(path, '/', 1) AS module, count(*) AS n FROM files WHERE size_bytes > 2000 GROUP BY 1 ORDER BY n DESC, module LIMIT 8"))
def a11_affected_modules(spark, sf_dir):
    some = Tables(spark, sf_dir).files.where("size_bytes > 2000")
    return R.top(some.groupBy(S.module_of(F.col("path")).alias("module")).agg(F.count(F.lit(1)).alias("n")), [F.desc("n"), F.asc("module")], 8)


_FINDINGS = "SELECT source || '|' || lang AS fingerprint, CASE doc_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS severity, left(text, doc_id % 30) AS description, (doc_id % 100) / 100.0 AS confidence, 't' || (doc_id % 3) AS review_type, doc_id FROM documents"


def _findings(spark, sf_dir):
    k = F.col("doc_id")
    return Tables(spark, sf_dir).raw("documents").select(
        F.concat_ws("|", "source", "lang").alias("fingerprint"), F.array(*[F.lit(x) for x in ("low", "medium", "high", "critical")])[(k % 4).cast("int")].alias("severity"),
        F.expr("left(text, doc_id % 30)").alias("description"), ((k % 100) / 100.0).alias("confidence"), F.concat(F.lit("t"), k % 3).alias("review_type"), "doc_id",
    )


@query("a14_merge_findings", f"""WITH f AS ({_FINDINGS}) SELECT fingerprint, arg_max(severity, list_position(['low', 'medium', 'high', 'critical'], severity)) AS severity, arg_max(description, struct_pack(a := length(description), b := description)) AS description,
 CAST(max(confidence) AS DOUBLE) AS confidence, count(*) AS occurrence_count, string_agg(DISTINCT review_type, ',' ORDER BY review_type) AS review_types FROM f GROUP BY fingerprint""")  # fmt: skip
def a14_merge_findings(spark, sf_dir):
    return R.merge_findings(_findings(spark, sf_dir))


@query("a15_accumulate_findings", f"""WITH f AS ({_FINDINGS}), o AS (SELECT fingerprint, count(*) AS n, min(doc_id) AS a, max(doc_id) AS b FROM f WHERE doc_id % 5 = 0 GROUP BY 1), w AS (SELECT fingerprint, count(*) AS n, min(doc_id) AS a, max(doc_id) AS b FROM f WHERE doc_id % 7 = 0 GROUP BY 1)
SELECT fingerprint, CAST(coalesce(o.n, 0) + coalesce(w.n, 0) AS BIGINT) AS occurrence_count, coalesce(o.a, w.a) AS first_seen, coalesce(w.b, o.b) AS last_seen FROM o FULL JOIN w USING (fingerprint)""")  # fmt: skip
def a15_accumulate_findings(spark, sf_dir):
    f = _findings(spark, sf_dir)
    part = lambda m: f.where(f"doc_id % {m} = 0").groupBy("fingerprint").agg(F.count(F.lit(1)).alias("occurrence_count"), F.min("doc_id").alias("first_seen"), F.max("doc_id").alias("last_seen"))
    return R.accumulate_findings(part(5), part(7))


@query("a16_summary_findings", f"""WITH f AS ({_FINDINGS}), k AS (SELECT *, list_position(['low', 'medium', 'high', 'critical'], severity) AS o FROM f WHERE severity <> 'low'), b AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY o DESC, confidence DESC, doc_id) AS r FROM k)
SELECT fingerprint, severity, doc_id FROM b WHERE r = 1 ORDER BY o DESC, confidence DESC, doc_id LIMIT 5""")  # fmt: skip
def a16_summary_findings(spark, sf_dir):
    f = _findings(spark, sf_dir).where("severity <> 'low'")
    order = [F.desc(F.array_position(F.array(*[F.lit(x) for x in ("low", "medium", "high", "critical")]), F.col("severity"))), F.desc("confidence"), F.asc("doc_id")]
    return R.top(R.best_per_key(f, ["fingerprint"], order), order, 5).select("fingerprint", "severity", "doc_id")


@query("a18_hotspots", with_tables("symbols edges", "SELECT file_path, count(*) AS dead FROM symbols WHERE qualified_name NOT IN (SELECT target FROM edges) GROUP BY file_path ORDER BY dead DESC, file_path LIMIT 20"))
def a18_hotspots(spark, sf_dir):
    t = Tables(spark, sf_dir)
    dead = R.without(t.symbols, t.edges, "qualified_name", "target")
    return R.top(dead.groupBy("file_path").agg(F.count(F.lit(1)).alias("dead")), [F.desc("dead"), F.asc("file_path")], 20)


@query("a19_community_keywords", """WITH w AS (SELECT p_brand, unnest(string_split(lower(p_name), ' ')) AS w FROM part), c AS (SELECT p_brand, w, count(*) AS n FROM w GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, w) AS k FROM c)
SELECT p_brand AS community, string_agg(w, ' ' ORDER BY k) AS name FROM r WHERE k <= 3 GROUP BY 1""")  # fmt: skip
def a19_community_keywords(spark, sf_dir):
    words = Tables(spark, sf_dir).raw("part").select("p_brand", F.explode(F.split(F.lower("p_name"), " ")).alias("w")).groupBy("p_brand", "w").agg(F.count(F.lit(1)).alias("n"))
    n = F.row_number().over(W.partitionBy("p_brand").orderBy(F.desc("n"), F.asc("w")))
    best = words.withColumn("k", n).where("k <= 3")
    return best.groupBy(F.col("p_brand").alias("community")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "w"))), lambda x: x.w), " ").alias("name"))


# --- windows, top-k, sets ---

_RANKED = "SELECT p_partkey AS id, p_brand AS file_path, CAST(p_size * 7919 + p_partkey * 31 AS BIGINT) % 1000 AS score FROM part"


def _ranked(spark, sf_dir):
    return Tables(spark, sf_dir).raw("part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("file_path"), ((F.col("p_size").cast("long") * 7919 + F.col("p_partkey") * 31) % 1000).alias("score"))


@query("w1_diversify", f"WITH r AS ({_RANKED}), x AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY score DESC, id) > 3 AS overflow FROM r) SELECT id, file_path, score FROM x ORDER BY overflow, score DESC, id LIMIT 90")
def w1_diversify(spark, sf_dir):
    return R.diversify(_ranked(spark, sf_dir), 3, 90).select("id", "file_path", "score")


@query("w2_edge_cap", with_tables("edges", "SELECT source, relation, target FROM (SELECT *, row_number() OVER (PARTITION BY source, relation ORDER BY target) AS k FROM edges) WHERE k <= 2"))
def w2_edge_cap(spark, sf_dir):
    return R.best_per_key(Tables(spark, sf_dir).edges, ["source", "relation"], [F.asc("target")], 2)


@query("w3_best_per_key", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1")
def w3_best_per_key(spark, sf_dir):
    return R.best_per_key(Tables(spark, sf_dir).raw("orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("w4_first_non_blank", "SELECT user_id, arg_min(props, event_id) AS props FROM events WHERE props <> '' GROUP BY user_id")
def w4_first_non_blank(spark, sf_dir):
    return Tables(spark, sf_dir).raw("events").where("props <> ''").groupBy("user_id").agg(F.min_by("props", "event_id").alias("props"))


@query("w5_step_roles", with_tables("steps", "SELECT process_id, step, CASE WHEN row_number() OVER w = 1 THEN 'entry' WHEN row_number() OVER w = count(*) OVER (PARTITION BY process_id) THEN 'terminal' ELSE 'intermediate' END AS role FROM steps WINDOW w AS (PARTITION BY process_id ORDER BY step, symbol)"))
def w5_step_roles(spark, sf_dir):
    n = F.row_number().over(W.partitionBy("process_id").orderBy("step", "symbol"))
    last = F.count(F.lit(1)).over(W.partitionBy("process_id"))
    return Tables(spark, sf_dir).steps.select("process_id", "step", F.when(n == 1, "entry").when(n == last, "terminal").otherwise("intermediate").alias("role"))


@query("w6_round_robin", f"""WITH h AS (SELECT 't' || (id % 3) AS term, id % 3 AS position, score AS rank, id // 2 AS id FROM ({_RANKED})), t AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY rank, id) AS n FROM h), u AS (SELECT *, CAST(ceil(n / 2.0) AS INT) AS turn FROM t),
f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY turn, position, n) AS k FROM u) SELECT id, term, turn FROM f WHERE k = 1""")  # fmt: skip
def w6_round_robin(spark, sf_dir):
    hits = _ranked(spark, sf_dir).select(F.concat(F.lit("t"), F.col("id") % 3).alias("term"), (F.col("id") % 3).alias("position"), F.col("score").alias("rank"), F.floor(F.col("id") / 2).alias("id"))
    return R.round_robin(hits, 2).select("id", "term", "turn")


@query("w7_ambiguity", f"WITH r AS ({_RANKED}), x AS (SELECT file_path, score, lead(score) OVER (PARTITION BY file_path ORDER BY score DESC, id) AS next, row_number() OVER (PARTITION BY file_path ORDER BY score DESC, id) AS k FROM r) SELECT file_path, coalesce(next >= score - 8, false) AS ambiguous FROM x WHERE k = 1")
def w7_ambiguity(spark, sf_dir):
    order = W.partitionBy("file_path").orderBy(F.desc("score"), F.asc("id"))
    x = _ranked(spark, sf_dir).withColumn("next", F.lead("score").over(order)).withColumn("k", F.row_number().over(order)).where("k = 1")
    return x.select("file_path", F.coalesce(F.col("next") >= F.col("score") - 8, F.lit(False)).alias("ambiguous"))


@query("k2_severity_sort", f"WITH f AS ({_FINDINGS}) SELECT doc_id, severity FROM f ORDER BY list_position(['low', 'medium', 'high', 'critical'], severity) DESC, doc_id LIMIT 30")
def k2_severity_sort(spark, sf_dir):
    order = F.array_position(F.array(*[F.lit(x) for x in ("low", "medium", "high", "critical")]), F.col("severity"))
    return R.top(_findings(spark, sf_dir), [F.desc(order), F.asc("doc_id")], 30).select("doc_id", "severity")


@query("k4_stable_sample", "SELECT doc_id FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR) || 'seed'), doc_id LIMIT 100")
def k4_stable_sample(spark, sf_dir):
    return R.top(Tables(spark, sf_dir).raw("documents"), [F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("seed"))).asc(), F.asc("doc_id")], 100).select("doc_id")


@query("k5_largest", with_tables("files", "SELECT path, size_bytes FROM files ORDER BY size_bytes DESC, path LIMIT 10"))
def k5_largest(spark, sf_dir):
    return R.top(Tables(spark, sf_dir).files, [F.desc("size_bytes"), F.asc("path")], 10).select("path", "size_bytes")


@query("k6_recent_runs", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def k6_recent_runs(spark, sf_dir):
    return R.top(Tables(spark, sf_dir).raw("events"), [F.desc("ts"), F.desc("event_id")], 20).select("event_id", "event_type")


@query("u1_union", "SELECT kind, count(*) AS n FROM (SELECT 'a' AS kind FROM part UNION ALL SELECT 'a' FROM supplier UNION ALL SELECT 'b' FROM nation) GROUP BY kind")
def u1_union(spark, sf_dir):
    t = Tables(spark, sf_dir)
    part = lambda x, k: t.raw(x).select(F.lit(k).alias("kind"))
    return part("part", "a").unionByName(part("supplier", "a")).unionByName(part("nation", "b")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("u2_intersection", "SELECT l_partkey AS k FROM lineitem WHERE l_suppkey = 1 INTERSECT SELECT l_partkey FROM lineitem WHERE l_suppkey = 2")
def u2_intersection(spark, sf_dir):
    lines = Tables(spark, sf_dir).raw("lineitem")
    return lines.where("l_suppkey = 1").select(F.col("l_partkey").alias("k")).intersect(lines.where("l_suppkey = 2").select("l_partkey"))


@query("u3_difference", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 200000")
def u3_difference(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return R.without(t.raw("customer").select(F.col("c_custkey").alias("k")), t.raw("orders").where("o_totalprice > 200000"), "k", "o_custkey")


@query("u4_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def u4_distinct(spark, sf_dir):
    return Tables(spark, sf_dir).raw("orders").select("o_orderstatus", "o_orderpriority").distinct()


@query("st3_debounced_bursts", """WITH x AS (SELECT user_id, ts, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER w >= 3600000000, true) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), y AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x)
SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM y GROUP BY user_id, s""")  # fmt: skip
def st3_debounced_bursts(spark, sf_dir):
    return R.gap_sessions(Tables(spark, sf_dir).raw("events"), "user_id", "ts", 3600)


@query("t7_stale_files", with_tables("files", "SELECT path FROM files WHERE modified_time > 800"))
def t7_stale_files(spark, sf_dir):
    runs = spark.createDataFrame([(1, "ok", 500), (2, "ok", 800), (3, "failed", 900)], "id int, status string, finished long")
    return C.stale_files(Tables(spark, sf_dir).files, runs).select("path")


@query("b3_resolve_findings", f"WITH f AS ({_FINDINGS}) SELECT doc_id, CASE WHEN fingerprint LIKE 'src1|%' THEN 'resolved' ELSE 'open' END AS status FROM f")
def b3_resolve_findings(spark, sf_dir):
    return _findings(spark, sf_dir).select("doc_id", F.when(F.col("fingerprint").startswith("src1|"), "resolved").otherwise("open").alias("status"))


@query("b4_process_delete", with_tables("steps", "SELECT process_id, count(*) AS n FROM steps WHERE process_id NOT IN (SELECT process_id FROM steps WHERE symbol LIKE 'system.%') GROUP BY process_id"))
def b4_process_delete(spark, sf_dir):
    steps = Tables(spark, sf_dir).steps
    return R.without(steps, steps.where("symbol like 'system.%'"), "process_id").groupBy("process_id").agg(F.count(F.lit(1)).alias("n"))


@query("b6_edges_with_files", with_tables("symbols edges", "SELECT relation, s.file_path AS source_file, t.file_path AS target_file, count(*) AS n FROM edges JOIN symbols AS s ON s.qualified_name = source JOIN symbols AS t ON t.qualified_name = target WHERE relation = 'CALLS' GROUP BY ALL"))
def b6_edges_with_files(spark, sf_dir):
    t = Tables(spark, sf_dir)
    ends = t.symbols.select("qualified_name", "file_path")
    e = t.edges.where("relation = 'CALLS'").join(ends.toDF("source", "source_file"), "source").join(ends.toDF("target", "target_file"), "target")
    return e.groupBy("relation", "source_file", "target_file").agg(F.count(F.lit(1)).alias("n"))


@query("b37_unique_capped", with_tables("steps", "SELECT process_id, array_to_string(list_slice(list_sort(list_distinct(list(symbol))), 1, 3), ',') AS symbols FROM steps GROUP BY process_id"))
def b37_unique_capped(spark, sf_dir):
    return Tables(spark, sf_dir).steps.groupBy("process_id").agg(F.array_join(F.slice(F.sort_array(F.collect_set("symbol")), 1, 3), ",").alias("symbols"))
