"""Retrieval queries: fused search, vectors, similarity and intents."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.functions import scalar as S
from gneiss.operators import relational as R
from gneiss.operators import retrieval as V
from gneiss.plans.catalog import query
from gneiss.plans.projections import Tables, with_tables

_CANDIDATES = """cand AS (SELECT path AS id, path AS file_path, 0.2 AS base, 'symbol' AS source FROM files WHERE contains(lower(text), 'license')
UNION ALL SELECT path, path, 0.16, 'chunk' FROM files WHERE contains(lower(text), 'token') UNION ALL SELECT path, path, 0.24, 'graph' FROM files WHERE language = 'es'
UNION ALL SELECT path, path, least(0.12 + 0.04 * (CAST(contains(lower(text), 'license') AS INT) + CAST(contains(lower(text), 'token') AS INT)), 0.34), 'regex_expanded' FROM files WHERE contains(lower(text), 'license') OR contains(lower(text), 'token')),
fused AS (SELECT id, min(file_path) AS file_path, CAST(max(base) AS DOUBLE) AS base, list_sort(list_distinct(list(source))) AS sources FROM cand GROUP BY id)"""


def _candidates(spark, sf_dir):
    files = Tables(spark, sf_dir).files
    low = F.lower("text")
    hit = lambda w: F.contains(low, F.lit(w))
    part = lambda df, base, source: df.select(F.col("path").alias("id"), F.col("path").alias("file_path"), base.alias("base"), F.lit(source).alias("source"))
    hits = hit("license").cast("int") + hit("token").cast("int")
    return [
        part(files.where(hit("license")), F.lit(0.2), "symbol"), part(files.where(hit("token")), F.lit(0.16), "chunk"), part(files.where("language = 'es'"), F.lit(0.24), "graph"),
        part(files.where(hits > 0), F.least(0.12 + 0.04 * hits, F.lit(0.34)), "regex_expanded"),
    ]


@query("r3_fused_candidates", with_tables("files", _CANDIDATES + "||select||SELECT id, round(base, 4) AS base, array_to_string(sources, ',') AS sources FROM fused"))
def r3_fused_candidates(spark, sf_dir):
    return V.fuse(_candidates(spark, sf_dir)).select("id", F.round("base", 4).alias("base"), F.array_join("sources", ",").alias("sources"))


@query("r1_hybrid_search", with_tables("files", _CANDIDATES + """,
x AS (SELECT *, least(list_sum(list_transform(sources, lambda s: CASE s WHEN 'symbol' THEN 0.34 WHEN 'regex_expanded' THEN 0.24 WHEN 'graph' THEN 0.22 WHEN 'chunk' THEN 0.18 ELSE 0 END)), 0.75) AS src,
 least((CAST(contains(file_path, '/doc_7') AND regexp_matches(file_path, '_7$') AS INT) + 1) * 0.12, 0.6) AS p FROM fused),
s AS (SELECT id, file_path, CAST(round(CAST(base AS DOUBLE) + CAST(src AS DOUBLE) + CAST(p AS DOUBLE), 4) AS DOUBLE) AS score FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY split_part(file_path, '/', 1) ORDER BY score DESC, id) > 3 AS overflow FROM s)
||select||SELECT id, score, CASE WHEN score >= 0.9 THEN 'high' WHEN score >= 0.72 THEN 'medium' ELSE 'low' END AS confidence FROM r ORDER BY overflow, score DESC, id LIMIT 30"""))  # fmt: skip
def r1_hybrid_search(spark, sf_dir):
    """Candidates of four searches for "doc 7", fused, scored and diversified by module."""
    scored = V.final_score(V.fuse(_candidates(spark, sf_dir)), "doc 7")
    ranked = scored.withColumn("file_path", S.module_of(F.col("file_path")))
    return R.diversify(ranked, 3, 30).select("id", "score", "confidence")


@query("r8_token_overlap", "WITH t AS (SELECT p_partkey, list_distinct(string_split(lower(p_name), ' ')) AS w FROM part) SELECT p_partkey, CAST(least(len(list_intersect(w, ['red', 'blue', 'widget'])) * 0.12, 0.6) AS DOUBLE) AS score FROM t")
def r8_token_overlap(spark, sf_dir):
    words = F.array(*[F.lit(x) for x in ("red", "blue", "widget")])
    return Tables(spark, sf_dir).raw("part").select("p_partkey", V.overlap_score(S.tokens(F.col("p_name")), words).alias("score"))


@query("r11_resolve_target", with_tables("symbols", """
c AS (SELECT qualified_name, CASE WHEN name = 'Supplier#000000001' THEN 1.0 WHEN contains(name, 'Supplier#00000000') THEN 0.72 ELSE 0 END + CASE WHEN file_path = 'supplier' THEN 0.45 ELSE 0 END AS score FROM symbols WHERE contains(name, 'Supplier#00000000'))
||select||SELECT qualified_name, CAST(score AS DOUBLE) AS score FROM c ORDER BY score DESC, qualified_name LIMIT 5"""))  # fmt: skip
def r11_resolve_target(spark, sf_dir):
    found = Tables(spark, sf_dir).symbols.where(F.contains("name", F.lit("Supplier#00000000")))
    score = F.when(F.col("name") == "Supplier#000000001", 1.0).otherwise(0.72) + F.when(F.col("file_path") == "supplier", 0.45).otherwise(0.0)
    return R.top(found.select("qualified_name", score.alias("score")), [F.desc("score"), F.asc("qualified_name")], 5)


@query("r12_fuzzy_symbols", with_tables("symbols", "SELECT qualified_name, CAST(contains(lower(name), 'red') AS INT) + CAST(contains(lower(name), 'widget') AS INT) + CAST(contains(lower(name), 'small') AS INT) AS hits FROM symbols WHERE hits >= 2 ORDER BY hits DESC, name, qualified_name LIMIT 25"))
def r12_fuzzy_symbols(spark, sf_dir):
    return R.fuzzy_symbols(Tables(spark, sf_dir).symbols, "red widget small", 25).select("qualified_name", "hits")


@query("r13_knn", """WITH q AS (SELECT vec_id AS q, embedding AS qe FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q AS query_id, vec_id AS id, round(list_cosine_similarity(CAST(qe AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS similarity FROM q, embeddings WHERE vec_id <> q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS k FROM s) SELECT query_id, id, similarity FROM r WHERE k <= 5""")  # fmt: skip
def r13_knn(spark, sf_dir):
    base = Tables(spark, sf_dir).raw("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return V.knn(base.where("id % 50 = 0"), base, 5)


@query("r14_duplicate_files", with_tables("files", "SELECT a.path AS left_path, b.path AS right_path FROM (SELECT sha256, min(path) AS path FROM files GROUP BY sha256 HAVING count(*) > 1) AS a JOIN files AS b ON a.sha256 = b.sha256 AND a.path <> b.path"))
def r14_duplicate_files(spark, sf_dir):
    """Exact copies as links from each to the class's representative: no pairs within a class."""
    files = Tables(spark, sf_dir).files.select("sha256", "path")
    first = files.groupBy("sha256").agg(F.min("path").alias("left_path"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return files.join(first, "sha256").where("path <> left_path").select("left_path", F.col("path").alias("right_path"))


@query("r14_near_duplicates")
def r14_near_duplicates(spark, sf_dir):
    chunks = Tables(spark, sf_dir).raw("embeddings").select(F.col("vec_id").alias("chunk_id"), F.concat(F.lit("f"), F.col("vec_id") % 40).alias("file_path"), F.col("embedding").alias("vector"))
    return V.near_duplicates(chunks)


@query("r15_similar_functions", """WITH f AS (SELECT p_partkey AS id, list_distinct(string_split(lower(p_name), ' ')) AS n, p_size % 5 AS p, p_type AS r, ['c' || (p_partkey % 3), 'd' || (p_partkey % 4)] AS c FROM part), t AS (SELECT * FROM f WHERE id = 1),
s AS (SELECT f.id, CAST(round(0.35 * (len(list_intersect(f.n, t.n)) / CAST(len(list_distinct(list_concat(f.n, t.n))) AS DOUBLE)) + 0.25 * (CASE WHEN greatest(f.p, t.p) = 0 THEN 1.0 WHEN least(f.p, t.p) = 0 THEN 0.0 ELSE 1 - abs(f.p - t.p) / CAST(greatest(f.p, t.p) AS DOUBLE) END)
 + 0.15 * CAST(f.r = t.r AS INT) + 0.25 * (len(list_intersect(f.c, t.c)) / CAST(len(list_distinct(list_concat(f.c, t.c))) AS DOUBLE)), 4) AS DOUBLE) AS score FROM f, t WHERE f.id <> t.id) SELECT id, score FROM s WHERE score >= 0.3 ORDER BY score DESC, id LIMIT 40""")  # fmt: skip
def r15_similar_functions(spark, sf_dir):
    k = F.col("p_partkey")
    f = Tables(spark, sf_dir).raw("part").select(k.alias("id"), F.col("p_name").alias("name"), (F.col("p_size") % 5).alias("params"), F.col("p_type").alias("returns"), F.array(F.concat(F.lit("c"), k % 3), F.concat(F.lit("d"), k % 4)).alias("callees"))
    return V.similar_functions(f, f.where("id = 1"), 0.3, 40)


_HEX = "list_transform(range(0, 32), lambda i: CAST(16 * (strpos('0123456789abcdef', substr(h, 2 * i + 1, 1)) - 1) + strpos('0123456789abcdef', substr(h, 2 * i + 2, 1)) - 1 AS DOUBLE) / 255)"


@query("r16_fallback_embedding", f"WITH v AS (SELECT doc_id, {_HEX} AS v FROM (SELECT doc_id, sha256(text) AS h FROM documents)) SELECT doc_id, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS first, round(v[32] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS last FROM v")
def r16_fallback_embedding(spark, sf_dir):
    v = Tables(spark, sf_dir).raw("documents").select("doc_id", V.hash_vector(F.col("text")).alias("v"))
    return v.select("doc_id", F.round(F.col("v")[0], 6).alias("first"), F.round(F.col("v")[31], 6).alias("last"))


@query("r18_intents", """WITH w AS (SELECT conv_id * 100 + turn AS id, list_filter(list_distinct(regexp_split_to_array(lower(text), '[^a-z0-9]+')), lambda x: x <> '') AS w FROM conversations), s AS (SELECT id, len(list_intersect(w, ['the', 'of'])) AS a, len(list_intersect(w, ['der', 'die', 'und'])) AS b, len(list_intersect(w, ['de', 'que'])) AS c FROM w)
SELECT id, CASE WHEN greatest(a, b, c) = 0 THEN 'general' WHEN a = greatest(a, b, c) THEN 'english' WHEN b = greatest(a, b, c) THEN 'german' ELSE 'romance' END AS intent, CAST(greatest(a, b, c) AS INT) AS hits FROM s""")  # fmt: skip
def r18_intents(spark, sf_dir):
    questions = Tables(spark, sf_dir).raw("conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.lower("text").alias("text"))
    return V.intents(questions, {"english": ["the", "of"], "german": ["der", "die", "und"], "romance": ["de", "que"]})


@query("r20_file_relevance", with_tables("files", _CANDIDATES + "||select||SELECT file_path, CAST(round(sum(CASE source WHEN 'symbol' THEN 1.6 WHEN 'chunk' THEN 1.0 WHEN 'graph' THEN 0.45 ELSE 0.85 END), 4) AS DOUBLE) AS relevance FROM cand GROUP BY file_path ORDER BY relevance DESC, file_path LIMIT 50"))
def r20_file_relevance(spark, sf_dir):
    from functools import reduce

    every = reduce(lambda a, b: a.unionByName(b), _candidates(spark, sf_dir))
    weight = F.when(F.col("source") == "symbol", 1.6).when(F.col("source") == "chunk", 1.0).when(F.col("source") == "graph", 0.45).otherwise(0.85)
    return R.top(every.groupBy("file_path").agg(F.round(F.sum(weight), 4).alias("relevance")), [F.desc("relevance"), F.asc("file_path")], 50)


@query("r24_find_tests", "WITH c AS (SELECT 't' || (l_partkey % 50) AS file_path, 12 AS score, 'graph' AS reason FROM lineitem WHERE l_suppkey = 1 UNION ALL SELECT 't' || (l_partkey % 50), 10, 'map' FROM lineitem WHERE l_suppkey = 2 UNION ALL SELECT 't' || (l_partkey % 50), 8, 'convention' FROM lineitem WHERE l_suppkey = 3) SELECT file_path, max(score) AS score, arg_max(reason, score) AS reason FROM c GROUP BY file_path")
def r24_find_tests(spark, sf_dir):
    lines = Tables(spark, sf_dir).raw("lineitem")
    part = lambda s, score, reason: lines.where(f"l_suppkey = {s}").select(F.concat(F.lit("t"), F.col("l_partkey") % 50).alias("file_path"), F.lit(score).alias("score"), F.lit(reason).alias("reason"))
    return V.first_per_file(part(1, 12, "graph").unionByName(part(2, 10, "map")).unionByName(part(3, 8, "convention")))


@query("a17_source_counts", with_tables("files", _CANDIDATES + "||select||SELECT source, count(*) AS n FROM (SELECT unnest(sources) AS source FROM fused) GROUP BY source"))
def a17_source_counts(spark, sf_dir):
    return V.fuse(_candidates(spark, sf_dir)).select(F.explode("sources").alias("source")).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("a20_embed_accounting", with_tables("files", "SELECT count(*) AS chunks, count(DISTINCT sha256) AS hashes, count(DISTINCT sha256) FILTER (WHERE hit) AS hits, count(DISTINCT sha256) FILTER (WHERE NOT hit) AS misses, CAST(ceil(count(DISTINCT sha256) FILTER (WHERE NOT hit) / 24.0) AS BIGINT) AS batches FROM (SELECT sha256, sha256 IN (SELECT sha256 FROM files WHERE modified_time % 3 = 0) AS hit FROM files)"))
def a20_embed_accounting(spark, sf_dir):
    files = Tables(spark, sf_dir).files.withColumnRenamed("sha256", "content_hash")
    return V.embed_plan(files, files.where("modified_time % 3 = 0"), 24)


@query("r7_symbol_relevance")
def r7_symbol_relevance(spark, sf_dir):
    """Parts by relevance for a name; the ratio by matching blocks has no SQL form."""
    parts = Tables(spark, sf_dir).symbols.where("kind = 'part'")
    scored = parts.select("qualified_name", "name", V.symbol_relevance(F.col("name"), F.col("kind"), "red widget").alias("score"))
    return R.top(scored, [F.desc("score"), F.asc("qualified_name")], 50)
