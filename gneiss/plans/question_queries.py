"""Queries of questions and of what a search finds: the turns of conversations are the questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.functions import scalar as S
from gneiss.operators import questions as Q
from gneiss.operators import search
from gneiss.plans.catalog import query
from gneiss.plans.projections import Tables, with_tables

#: What is asked about a turn, by the remainder of its number.
ASKED = (
    "Where is the RetryPolicy handled in app/core/Retry.py?", "Why is the flow of load_items called, and which calls trigger it", "What breaks if I change Order.total or its dependents?", "which tests cover parse_Row and verify src/api/routes.ts",
    "fix the wrong error response of /api/users/list please", "Show the dashboard page and selector filter, including Main shared view", "find and trace the shared utility code", "",
)


def _questions(spark, sf_dir):
    k = F.col("conv_id") * 8 + F.col("turn")
    lead = F.array(*[F.lit(x) for x in ASKED])[((F.col("turn") + F.col("conv_id")) % len(ASKED)).cast("int")]
    return Tables(spark, sf_dir).raw("conversations").select(k.alias("id"), F.concat_ws(" ", lead, F.substring_index("text", " ", 5)).alias("text"))


_LIST = "[{}]".format(", ".join("'" + x.replace("'", "''") + "'" for x in ASKED))
_Q = f"q AS (SELECT conv_id * 8 + turn AS id, {_LIST}[CAST((turn + conv_id) % {len(ASKED)} AS INT) + 1] || ' ' || array_to_string(string_split(text, ' ')[1:5], ' ') AS text FROM conversations)"
_STOP = "[{}]".format(", ".join(f"'{x}'" for x in [*Q.STOPWORDS, *Q.IMPERATIVES]))
_NOUNS = "[{}]".format(", ".join(f"'{x}'" for x in Q.NOUNS))
_GENERIC = "[{}]".format(", ".join(f"'{x}'" for x in Q.GENERIC))
#: First places of list entries, in order (DuckDB's list_distinct keeps none).
_KEEP = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
_TOKENS = f"t0 AS (SELECT id, text, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS l FROM q), t AS (SELECT id, text, {_KEEP.format('l')} AS tokens FROM t0)"
_SCORES = ", ".join(f"len(list_intersect(tokens, [{', '.join(repr(x) for x in words.split())}])) AS s{i}" for i, words in enumerate(Q.INTENTS.values()))
_ALL = ", ".join(f"s{i}" for i in range(len(Q.INTENTS)))
_INTENT = f"""{_Q}, {_TOKENS}, sc AS (SELECT id, text, tokens, {_SCORES} FROM t),
i AS (SELECT id, text, tokens, CASE WHEN s6 >= 2 AND s7 >= 1 THEN 'ui_ownership' WHEN greatest({_ALL}) = 0 THEN 'general' {' '.join(f"WHEN s{k} = greatest({_ALL}) THEN '{n}'" for k, n in enumerate(Q.INTENTS))} END AS intent FROM sc)"""


@query("r18_question_intents", f"WITH {_INTENT} SELECT id, array_to_string(tokens, ' ') AS tokens, intent FROM i")
def r18_question_intents(spark, sf_dir):
    return Q.with_intent(_questions(spark, sf_dir)).select("id", F.array_join("tokens", " ").alias("tokens"), "intent")


_SYMBOLS = rf"""n AS (SELECT id, tokens, intent, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM i),
f0 AS (SELECT id, tokens, intent, text, list_transform(list_concat(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_./:\-]{{2,}}'), regexp_extract_all(text, '/[A-Za-z0-9_\-./:]+')), lambda x: trim(x, ' .,:;()[]{{}}"''')) AS l FROM n),
f1 AS (SELECT id, tokens, intent, text, list_filter(l, lambda x: x <> '' AND NOT list_contains({_STOP}, lower(x)) AND NOT list_contains({_NOUNS}, lower(x))) AS l FROM f0),
f2 AS (SELECT id, tokens, intent, text, {_KEEP.format('l')} AS l FROM f1),
f AS (SELECT id, tokens, intent, text, list_transform(list_sort(list_transform(l, lambda x, p: {{s: -(CASE WHEN regexp_matches(x, '[./:]') THEN 5 ELSE 0 END + CASE WHEN regexp_matches(x, '[.](py|ts|tsx|js|jsx)$') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(x, '[a-z][A-Z]') THEN 3 ELSE 0 END
  + CASE WHEN x <> lower(x) OR NOT regexp_matches(x, '[a-z]') THEN 1 ELSE 0 END - CASE WHEN list_contains({_GENERIC}, lower(x)) THEN 3 ELSE 0 END - CASE WHEN regexp_matches(x, '^[a-z]+$') THEN 2 ELSE 0 END), l: -length(x), p: p, x: x}})), lambda y: y.x)[1:8] AS symbols FROM f2)"""


@query("r19_symbol_terms", f"WITH {_INTENT}, {_SYMBOLS} SELECT id, array_to_string(symbols, ' ') AS symbols, array_to_string(list_filter(symbols, lambda x: starts_with(x, '/') OR contains(lower(x), '/api/')), ' ') AS routes, array_to_string(list_filter(symbols, lambda x: contains(x, '/') OR regexp_matches(x, '[.](py|ts|tsx|js|jsx)$')), ' ') AS files FROM f")
def r19_symbol_terms(spark, sf_dir):
    rows = Q.rewritten(_questions(spark, sf_dir))
    return rows.select("id", *[F.array_join(f"{c}_terms", " ").alias(f"{c}s") for c in ("symbol", "route", "file")])


_LED = "CASE intent {} ELSE CAST([] AS VARCHAR[]) END".format(" ".join(f"WHEN '{k}' THEN [{', '.join(repr(x) for x in v)}]" for k, v in Q.LEADS.items()))
_VARIANTS = f"""c AS (SELECT *, list_filter(tokens, lambda x: length(x) >= 3 AND NOT list_contains({_STOP}, x))[1:8] AS core FROM f),
v0 AS (SELECT id, list_filter(list_concat([text, array_to_string(symbols[1:4], ' '), array_to_string(core[1:6], ' ')], CASE WHEN len(core) > 0 THEN list_transform({_LED}, lambda x: x || ' ' || array_to_string(core[1:5], ' ')) ELSE [] END), lambda x: x <> '') AS l FROM c)"""


@query("r19_query_variants", f"WITH {_INTENT}, {_SYMBOLS}, {_VARIANTS} SELECT id, array_to_string({_KEEP.format('l')}[1:6], '|') AS variants FROM v0")
def r19_query_variants(spark, sf_dir):
    return Q.rewritten(_questions(spark, sf_dir)).select("id", F.array_join("variants", "|").alias("variants"))


@query("b24_question_limits", f"WITH {_INTENT}, b AS (SELECT id, len(tokens) <= 3 OR len(list_filter(tokens, lambda x: NOT list_contains({_STOP}, x) AND NOT list_contains({_NOUNS}, x) AND NOT list_contains({_GENERIC}, x))) = 0 AS is_broad FROM i) SELECT id, is_broad, CASE WHEN is_broad THEN 3 ELSE 5 END AS most_files, CASE WHEN is_broad THEN 4 ELSE 8 END AS most_snippets FROM b")
def b24_question_limits(spark, sf_dir):
    return Q.limits(Q.with_intent(_questions(spark, sf_dir))).select("id", "is_broad", "most_files", "most_snippets")


@query("b26_next_tools", f"WITH {_INTENT} SELECT intent, count(*) AS n, CASE intent {' '.join(f"WHEN '{k}' THEN '{','.join(v)}'" for k, v in Q.NEXT_TOOLS.items())} END AS tools FROM i GROUP BY intent")
def b26_next_tools(spark, sf_dir):
    return Q.guidance(Q.with_intent(_questions(spark, sf_dir))).groupBy("intent", F.array_join("next_tools", ",").alias("tools")).agg(F.count(F.lit(1)).alias("n"))


@query("b22_phrases", f"WITH {_Q}, {_TOKENS}, p AS (SELECT id, list_filter(list_concat([array_to_string(tokens, ' ')], list_transform(range(1, greatest(len(tokens) - 1, 1)), lambda k: array_to_string(tokens[k : k + 2], ' ')), list_transform(range(1, greatest(len(tokens), 1)), lambda k: array_to_string(tokens[k : k + 1], ' ')), tokens), lambda x: x <> '') AS l FROM t) SELECT id, CAST(len({_KEEP.format('l')}) AS INT) AS n, md5(array_to_string({_KEEP.format('l')}, '|')) AS digest FROM p")
def b22_phrases(spark, sf_dir):
    rows = Q.with_intent(_questions(spark, sf_dir)).select("id", Q.phrases(F.col("tokens")).alias("p"))
    return rows.select("id", F.size("p").alias("n"), F.md5(F.array_join("p", "|")).alias("digest"))


@query("b13_target_shapes", r"""WITH t AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN 'app.core.Load' WHEN 2 THEN 'src/a' || page_id || '.ts' WHEN 3 THEN 'load items' WHEN 4 THEN '/users/' || page_id ELSE 'one two three' END AS t FROM pages)
SELECT page_id, starts_with(t, '/') OR contains(lower(t), '/api/') AS is_route, contains(t, '/') OR regexp_matches(lower(t), '[.](py|ts|tsx|js|jsx)$') AS is_file, regexp_matches(t, '[.:]') AS is_symbol, page_id % 6 = 3 AS is_broad FROM t""")  # fmt: skip
def b13_target_shapes(spark, sf_dir):
    k = F.col("page_id")
    target = F.when(k % 6 == 0, F.col("url")).when(k % 6 == 1, "app.core.Load").when(k % 6 == 2, F.concat(F.lit("src/a"), k, F.lit(".ts"))).when(k % 6 == 3, "load items").when(k % 6 == 4, F.concat(F.lit("/users/"), k)).otherwise("one two three")
    return Tables(spark, sf_dir).raw("pages").select("page_id", Q.target_shape(target).alias("s")).select("page_id", "s.*")


def _hits(spark, sf_dir):
    """Hits of a question for each line of an order."""
    sources = F.when(F.col("l_linenumber") % 3 == 0, F.array(F.lit("regex_expanded"), F.lit("symbol"))).when(F.col("l_linenumber") % 5 == 0, F.array(F.lit("window"))).otherwise(F.array(F.lit("regex"), F.lit("symbol")))
    path = F.concat(F.when(F.col("l_partkey") % 9 == 0, "tests/").otherwise("src/"), F.col("l_partkey"))
    return Tables(spark, sf_dir).raw("lineitem").select(F.col("l_orderkey").alias("question"), path.alias("file_path"), Q.hit_class(sources).alias("hit_class"), (F.col("l_returnflag") == "A").alias("has_snippet"), (F.col("l_linestatus") == "O").alias("in_app"))


_HITS = "h AS (SELECT l_orderkey AS question, CASE WHEN l_partkey % 9 = 0 THEN 'tests/' ELSE 'src/' END || l_partkey AS file_path, l_linenumber % 3 = 0 OR l_linenumber % 5 = 0 AS expanded, l_returnflag = 'A' AS has_snippet, l_linestatus = 'O' AS in_app FROM lineitem)"


@query("b25_retry", f"WITH {_HITS} SELECT question, count(*) FILTER (WHERE NOT expanded) = 0 AND (count(*) FILTER (WHERE expanded) > 0 OR count(*) FILTER (WHERE has_snippet) = 0) AS retry FROM h GROUP BY question")
def b25_retry(spark, sf_dir):
    return Q.needs_retry(_hits(spark, sf_dir))


@query("r20_question_files", f"WITH {_HITS} SELECT question, file_path, round(CAST(sum(CASE WHEN expanded THEN 85 ELSE 160 END + CASE WHEN has_snippet THEN 100 ELSE 0 END + CASE WHEN in_app THEN 45 ELSE 0 END) AS DOUBLE) / 100 + CASE WHEN file_path LIKE 'tests/%' THEN -0.5 ELSE 0.0 END, 2) AS relevance FROM h GROUP BY question, file_path")
def r20_question_files(spark, sf_dir):
    return Q.file_relevance(_hits(spark, sf_dir))


@query("b25_answer_confidence", f"WITH {_HITS}, c AS (SELECT question, count(DISTINCT file_path) AS files, count(*) FILTER (WHERE NOT expanded) AS seeds, count(*) FILTER (WHERE has_snippet) AS edges, count(*) FILTER (WHERE in_app) AS evidence FROM h GROUP BY question) SELECT question, CASE WHEN files > 0 AND seeds > 0 AND edges > 0 THEN 'high' WHEN evidence > 0 THEN 'medium' ELSE 'low' END AS confidence FROM c")
def b25_answer_confidence(spark, sf_dir):
    per = _hits(spark, sf_dir).groupBy("question").agg(F.countDistinct("file_path").alias("files"), F.count_if(F.col("hit_class") == "seed").alias("seeds"), F.count_if("has_snippet").alias("edges"), F.count_if("in_app").alias("evidence"))
    return per.select("question", Q.answer_confidence(F.col("files"), F.col("seeds"), F.col("edges"), F.lit(0), F.col("evidence")).alias("confidence"))


def _chunks(t):
    return t.files.select(F.col("path").alias("chunk_id"), F.col("path").alias("file_path"), F.concat(F.lit("doc."), F.col("modified_time").cast("string")).alias("qualified_name"), F.lit(1).alias("start_line"), (F.size(F.split("text", "\n"))).alias("end_line"), F.col("text").alias("content"))


@query("r1_hybrid_rounds")
def r1_hybrid_rounds(spark, sf_dir):
    """Hybrid search over symbols, chunks, words, vectors and graph; its parts have queries and tests of their own."""
    t = Tables(spark, sf_dir)
    vectors = t.raw("embeddings").join(t.files.select(F.col("modified_time").alias("vec_id"), F.col("path").alias("chunk_id")), "vec_id").select("chunk_id", F.col("embedding").alias("vector"))
    return search.hybrid_search(["license token", "supplier", "doc.3"], t.symbols, _chunks(t), t.edges, 25, vectors, [1.0] + [0.0] * 63).drop("content")


@query("r2_word_candidates", with_tables("files", """, h AS (SELECT path, modified_time, CAST(contains(lower(text), 'the') AS INT) + CAST(contains(lower(text), 'license') AS INT) + CAST(contains(lower(text), 'token') AS INT) AS hits FROM files)
||select||SELECT path AS file_path, 'doc.' || modified_time AS name, round(CAST(least(0.12 + 0.04 * hits, 0.34) AS DOUBLE), 4) AS base FROM h WHERE hits > 0 ORDER BY hits DESC, path LIMIT 30""".lstrip(", ")))  # fmt: skip
def r2_word_candidates(spark, sf_dir):
    return search.by_words(_chunks(Tables(spark, sf_dir)), "the license token", 30).select("file_path", "name", "base")


@query("r2_graph_candidates", with_tables("edges symbols", """
near AS (SELECT source AS seed, relation, 'out' AS way, target AS q FROM edges WHERE source IN ('o1', 's1', 'p7') UNION ALL SELECT target, relation, 'in', source FROM edges WHERE target IN ('o1', 's1', 'p7')),
r AS (SELECT *, row_number() OVER (PARTITION BY seed, relation, way ORDER BY q) AS n FROM near)
||select||SELECT qualified_name AS name, file_path, min(relation) AS relation, CAST(0.24 AS DOUBLE) AS base FROM r JOIN symbols ON q = qualified_name WHERE n <= 4 GROUP BY ALL"""))  # fmt: skip
def r2_graph_candidates(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return search.by_graph(spark.createDataFrame([("o1",), ("s1",), ("p7",)], "name string"), t.edges, t.symbols).select("name", "file_path", "relation", "base")


@query("r3_fused_places", """SELECT l_partkey AS part, CAST(l_linenumber AS BIGINT) AS start_line, max(l_quantity / 100) AS base, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS sources, min(nullif(l_linestatus, 'F')) AS relation FROM lineitem GROUP BY ALL""")
def r3_fused_places(spark, sf_dir):
    rows = Tables(spark, sf_dir).raw("lineitem")
    frame = rows.select(F.col("l_partkey").cast("string").alias("file_path"), F.col("l_partkey").cast("string").alias("name"), F.col("l_linenumber").cast("long").alias("start_line"), F.lit(0).cast("long").alias("end_line"), (F.col("l_quantity") / 100).alias("base"), F.col("l_returnflag").alias("source"), F.lit(None).cast("string").alias("content"), F.nullif("l_linestatus", F.lit("F")).alias("relation"))
    out = search.fused([frame])
    return out.select(F.col("name").cast("long").alias("part"), "start_line", "base", S.joined(F.col("sources")).alias("sources"), "relation")


@query("r11_resolved_targets")
def r11_resolved_targets(spark, sf_dir):
    """Symbols that a name may mean; the matching ratio has no SQL."""
    return search.resolved(Tables(spark, sf_dir).symbols, "nation:nation/x:n1", kind="nation").select("qualified_name", "score", "is_ambiguous")
