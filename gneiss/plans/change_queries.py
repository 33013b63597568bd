"""Queries of changes: risks of paths and symbols, slices, readiness. A change has a file for each part, with all kinds of paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.functions import scalar as S
from gneiss.operators import change as C
from gneiss.operators import slices as L
from gneiss.plans.catalog import query
from gneiss.plans.projections import Tables

#: Paths of a source repository, by the remainder of a key; # stands for the key.
PATHS = """src/boot/start#.s
fw/board#.mcp
inc/p30f#.h
inc/globals.h
fw/isr_#.c
fw/uart_init#.c
inc/api#.hpp
lib/impl#.cc
fw/mem#.ld
build/CMakeLists.txt
lib/exports/x#.txt
Web/Controllers/A#.cs
Web/Dto/Order#Request.cs
Web/Program.cs
Data/Migrations/M#.cs
Pas/App#.dpr
Pas/Main#.dfm
Pas/Unit#.pas
Pas/defs#.inc
app/auth/login#.py
app/routers/r#.py
app/db/repo#.py
app/services/s#.py
docs/guide#.md
tests/test_m#.py
web/src/app#.test.tsx
indexing/parsers/p#.py
indexing/graph#.py
storage/store#.py
frontend/pages/page#.tsx
backend/main#.py
backend/database/q#.py
src/util#.go
vector_store#.py
fw/vector.s
readme.txt
Lib/Startup.cs
app/my_reset.py
src/trap/x#.go
proj/a#.vcxproj.filters""".split()
_PATH = "replace([{}][CAST({{k}} % {} AS INT) + 1], '#', CAST({{k}} AS VARCHAR))".format(", ".join(f"'{x}'" for x in PATHS), len(PATHS))


def path_of(key: str):
    return F.replace(F.array(*[F.lit(x) for x in PATHS])[(F.col(key) % len(PATHS)).cast("int")], F.lit("#"), F.col(key).cast("string"))


def _files(spark, sf_dir):
    """A changed file for each part."""
    k = F.col("p_partkey")
    route = F.when(k % 7 == 0, F.concat(F.lit("/r"), (k % 3).cast("string"))).otherwise("")
    risk = F.array(*[F.lit(x) for x in ("LOW", "MEDIUM", "HIGH")])[(k % 3).cast("int")]
    return Tables(spark, sf_dir).raw("part").select(
        path_of("p_partkey").alias("file_path"), route.alias("route"), risk.alias("risk"), (k % 5).cast("long").alias("n_symbols"), (k % 4).cast("long").alias("n_impacted"), F.when(k % 11 == 0, 1).otherwise(0).cast("long").alias("n_tests"),
        (k % 2).cast("long").alias("n_consumers"), (k % 3).cast("long").alias("n_fields"), F.when(k % 13 == 0, 1).otherwise(0).cast("long").alias("n_processes"), F.when(k % 997 == 0, 1).otherwise(0).cast("long").alias("n_mismatches"), "p_partkey",
    )


_FILES = f"""files AS (SELECT {_PATH.format(k="p_partkey")} AS file_path, CASE WHEN p_partkey % 7 = 0 THEN '/r' || p_partkey % 3 ELSE '' END AS route, ['LOW', 'MEDIUM', 'HIGH'][CAST(p_partkey % 3 AS INT) + 1] AS risk,
  p_partkey % 5 AS n_symbols, p_partkey % 4 AS n_impacted, CASE WHEN p_partkey % 11 = 0 THEN 1 ELSE 0 END AS n_tests, p_partkey % 2 AS n_consumers, p_partkey % 3 AS n_fields,
  CASE WHEN p_partkey % 13 = 0 THEN 1 ELSE 0 END AS n_processes, CASE WHEN p_partkey % 997 = 0 THEN 1 ELSE 0 END AS n_mismatches, p_partkey FROM part)"""
_LOW = "replace(lower(file_path), chr(92), '/')"
_HITS = ", ".join(f"CASE WHEN regexp_matches({_LOW}, '{p}') THEN '{h}' END" for h, p, *_ in C.PATH_RULES)
_HIGH = " OR ".join(f"regexp_matches({_LOW}, '{p}')" for _, p, high, _ in C.PATH_RULES if high)
_EMBEDDED = " OR ".join(f"regexp_matches({_LOW}, '{p}')" for _, p, _, embedded in C.PATH_RULES if embedded)


@query("f10_path_rules", f"WITH {_FILES} SELECT file_path, array_to_string(list_filter([{_HITS}], lambda x: x IS NOT NULL), ',') AS hints, {_HIGH} AS is_high, {_EMBEDDED} AS is_embedded FROM files")
def f10_path_rules(spark, sf_dir):
    path = F.col("file_path")
    return _files(spark, sf_dir).select("file_path", F.array_join(C.path_hints(path), ",").alias("hints"), C.is_high_risk(path).alias("is_high"), C.is_embedded_sensitive(path).alias("is_embedded"))


@query("f11_symbol_hints", f"""WITH s AS (SELECT {_PATH.format(k="l_suppkey")} AS file_path, l_partkey % 6 AS k, l_linenumber AS n FROM lineitem)
SELECT file_path, array_to_string(list_filter([
  CASE WHEN regexp_matches({_LOW}, '[.](h|hh|hpp|hxx)$') AND bool_or(k IN (0, 1)) THEN 'native ABI/layout surface symbol' END, CASE WHEN bool_or(k = 2 AND n = 1) THEN 'native exported symbol' END,
  'native ABI surface kind(s): ' || array_to_string(list_sort(list_distinct(list(CASE WHEN k = 3 THEN 'abi' || n END) FILTER (WHERE k = 3)))[1:3], ', '),
  'native layout field(s): ' || array_to_string(list_sort(list_distinct(list('f' || n) FILTER (WHERE k = 4)))[1:5], ', '), 'native build target(s): ' || array_to_string(list_sort(list_distinct(list('t' || n) FILTER (WHERE k = 5)))[1:3], ', '),
  CASE WHEN bool_or(k = 1 AND n = 2) THEN 'Object Pascal public unit dependency surface' END, CASE WHEN bool_or(k = 1 AND n = 3) THEN 'Object Pascal project ownership surface' END,
  CASE WHEN bool_or(k = 1 AND n = 4) THEN 'Object Pascal include dependency surface' END, CASE WHEN bool_or(k = 1 AND n = 5) THEN 'Object Pascal conditional compilation surface' END], lambda x: x IS NOT NULL), '|') AS hints
FROM s GROUP BY file_path""")  # fmt: skip
def f11_symbol_hints(spark, sf_dir):
    k, n = F.col("l_partkey") % 6, F.col("l_linenumber")
    text = lambda lead: F.concat(F.lit(lead), n.cast("string"))
    some = lambda when: F.when(when, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    symbols = Tables(spark, sf_dir).raw("lineitem").select(
        path_of("l_suppkey").alias("file_path"), F.when(k == 0, "Macro").when(k == 1, "class").otherwise("function").alias("kind"), ((k == 2) & (n == 1)).alias("is_exported"), F.when(k == 3, text("abi")).otherwise("").alias("abi_surface"),
        F.when(k == 4, F.array(text("f"))).otherwise(F.array().cast("array<string>")).alias("layout_fields"), F.when(k == 5, text("t")).alias("build_target"), ((k == 1) & (n == 2)).alias("is_public_dependency"),
        ((k == 1) & (n == 3)).alias("is_project_owner"), some((k == 1) & (n == 4)).alias("include_files"), some((k == 1) & (n == 5)).alias("conditional_symbols"),
    )
    return C.symbol_hints(symbols).select("file_path", F.array_join("hints", "|").alias("hints"))


_CHANGES = """c AS (SELECT l_orderkey AS id, count(DISTINCT l_partkey) * 5 AS files, count(*) * 20 AS symbols, count(DISTINCT l_suppkey) * 9 AS impacted, count(*) FILTER (WHERE l_returnflag = 'A') AS high, count(*) FILTER (WHERE l_returnflag = 'R') AS medium,
  count(*) FILTER (WHERE l_linenumber = 3) AS embedded, count(*) FILTER (WHERE l_linenumber = 4) AS routes, count(*) FILTER (WHERE l_linenumber = 5) AS consumers, count(*) FILTER (WHERE l_linenumber = 6) AS mismatches,
  count(*) FILTER (WHERE l_linestatus = 'O') AS processes, count(*) FILTER (WHERE l_linestatus = 'F') AS high_processes, l_orderkey % 3 = 0 AS warned, l_orderkey % 2 = 0 AS capped FROM lineitem GROUP BY l_orderkey)"""


def _changes(spark, sf_dir):
    some = lambda when, name: F.count_if(when).alias(name)
    n = F.col("l_linenumber")
    return Tables(spark, sf_dir).raw("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        (F.countDistinct("l_partkey") * 5).alias("files"), (F.count(F.lit(1)) * 20).alias("symbols"), (F.countDistinct("l_suppkey") * 9).alias("impacted"), some(F.col("l_returnflag") == "A", "high"), some(F.col("l_returnflag") == "R", "medium"),
        some(n == 3, "embedded"), some(n == 4, "routes"), some(n == 5, "consumers"), some(n == 6, "mismatches"), some(F.col("l_linestatus") == "O", "processes"), some(F.col("l_linestatus") == "F", "high_processes"),
    ).withColumn("warned", F.col("id") % 3 == 0).withColumn("capped", F.col("id") % 2 == 0)


@query("b20_explanations", f"""WITH {_CHANGES} SELECT id, array_to_string(list_filter([files || ' files changed', symbols || ' indexed symbols changed', impacted || ' graph-impacted files detected',
  CASE WHEN high > 0 THEN high || ' changed files have high-risk characteristics' WHEN medium > 0 THEN medium || ' changed files have medium-risk characteristics' END, CASE WHEN files >= 25 THEN '25+ changed files escalates whole-tree risk' END,
  CASE WHEN symbols >= 100 THEN '100+ changed symbols escalates whole-tree risk' END, CASE WHEN impacted >= 50 THEN '50+ impacted files indicates broad graph blast radius' END, CASE WHEN embedded > 0 THEN embedded || ' embedded-C sensitive file(s) changed' END], lambda x: x IS NOT NULL), '; ') AS reasons,
  CASE WHEN warned AND capped THEN 'medium' WHEN warned OR (files > 0 AND symbols = 0) THEN 'low' WHEN files > 0 AND impacted = 0 THEN 'medium' WHEN symbols > 0 THEN 'high' ELSE 'medium' END AS confidence FROM c""")  # fmt: skip
def b20_explanations(spark, sf_dir):
    return C.explained(_changes(spark, sf_dir)).select("id", "reasons", "confidence")


@query("a12_weighted_points", f"""WITH {_CHANGES}, p AS (SELECT id, CAST(least(files * 2, 50) + least(symbols, 60) + least(impacted // 2, 40) + high * 10 + medium * 4 + embedded * 12 + routes * 12 + consumers * 5 + mismatches * 35 + processes * 6 + high_processes * 10 AS BIGINT) AS points FROM c)
SELECT id, points, CASE WHEN points >= 100 THEN 'CRITICAL' WHEN points >= 55 THEN 'HIGH' WHEN points >= 20 THEN 'MEDIUM' ELSE 'LOW' END AS label FROM p""")  # fmt: skip
def a12_weighted_points(spark, sf_dir):
    return C.weighted_points(_changes(spark, sf_dir)).select("id", "points", "label")


_RANK = "list_position(['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], {})"
_SLICES = f"""{_FILES}, sliced AS (SELECT *, CASE {" ".join(f"WHEN regexp_matches({_LOW}, '{p}') THEN '{n}'" for p, n, *_ in L.SLICES[:2])} WHEN route <> '' THEN 'route:' || route
  {" ".join(f"WHEN regexp_matches({_LOW}, '{p}') THEN '{n}'" for p, n, *_ in L.SLICES[2:])} END AS slice_id FROM files),
slices AS (SELECT slice_id, count(*) AS n_files, min(file_path) AS first_file, ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][max({_RANK.format("risk")})] AS risk, count(DISTINCT nullif(route, '')) AS n_routes,
  CAST(sum(n_tests) AS BIGINT) AS n_tests, CAST(sum(n_mismatches) AS BIGINT) AS n_mismatches,
  CASE {" ".join(f"WHEN slice_id = '{n}' THEN {place}" for _, n, _, place in L.SLICES)} ELSE 0 END AS position,
  CASE {" ".join(f"WHEN slice_id = '{n}' THEN '{title}'" for _, n, title, _ in L.SLICES)} ELSE 'Update API contract for ' || substr(slice_id, 7) END AS title FROM sliced GROUP BY slice_id),
acted AS (SELECT *, array_to_string(list_filter([CASE WHEN risk IN ('HIGH', 'CRITICAL') AND n_tests = 0 THEN 'find or add tests of this high-risk slice' END, CASE WHEN risk = 'MEDIUM' AND n_tests = 0 THEN 'run one focused test or context check' END], lambda x: x IS NOT NULL), '; ') AS required_actions FROM slices),
validated AS (SELECT *, CASE WHEN n_mismatches > 0 THEN 'blocked' WHEN required_actions <> '' THEN 'needs_validation' ELSE 'ready' END AS status FROM acted)"""


@query("b21_slices", f"WITH {_SLICES} SELECT slice_id, n_files, first_file, risk, n_routes, CAST(position AS INT) AS position, title FROM slices")
def b21_slices(spark, sf_dir):
    return L.slices(_files(spark, sf_dir)).select("slice_id", "n_files", "first_file", "risk", "n_routes", "position", "title")


@query("a23_slice_validation", f"WITH {_SLICES} SELECT slice_id, required_actions, status, CASE WHEN status = 'ready' AND risk = 'HIGH' THEN 'MEDIUM' WHEN status = 'ready' AND risk = 'MEDIUM' THEN 'LOW' ELSE risk END AS residual_risk FROM validated")
def a23_slice_validation(spark, sf_dir):
    return L.validated(L.slices(_files(spark, sf_dir))).select("slice_id", "required_actions", "status", "residual_risk")


_READY = """SELECT *, CASE WHEN mismatches > 0 OR risk = 'CRITICAL' OR blocked > 0 THEN 'not_ready' WHEN unvalidated > 0 OR needs_validation > 0 THEN 'needs_validation' ELSE 'ready' END AS status FROM (
  SELECT count(*) FILTER (WHERE status = 'ready') AS ready, count(*) FILTER (WHERE status = 'needs_validation') AS needs_validation, count(*) FILTER (WHERE status = 'blocked') AS blocked,
    count(*) FILTER (WHERE risk IN ('HIGH', 'CRITICAL') AND status <> 'ready') AS unvalidated, ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][max(list_position(['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], risk))] AS risk,
    ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][max(list_position(['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], CASE WHEN status = 'ready' AND risk = 'HIGH' THEN 'MEDIUM' WHEN status = 'ready' AND risk = 'MEDIUM' THEN 'LOW' ELSE risk END))] AS risk_after_validation,
    CAST(sum(n_mismatches) AS BIGINT) AS mismatches FROM validated)"""


@query("t3_post_change_review", f"""WITH {_SLICES}, r AS ({_READY}), old AS (SELECT count(*) AS stale_files FROM files WHERE file_path IN (SELECT file_path FROM files WHERE p_partkey % 29 = 0))
SELECT *, CASE WHEN stale_files > 0 THEN 'reindex_first' WHEN status = 'ready' THEN 'safe_to_commit' WHEN status = 'needs_validation' THEN 'validate_first' ELSE 'do_not_commit' END AS verdict FROM r, old""")  # fmt: skip
def t3_post_change_review(spark, sf_dir):
    files = _files(spark, sf_dir)
    return L.post_change_review(files, files.where("p_partkey % 29 = 0").select(F.col("file_path").alias("path")))


@query("a22_commit_plan", f"WITH {_SLICES} SELECT CAST(position AS INT) AS position, slice_id, title, risk, n_files, status FROM validated")
def a22_commit_plan(spark, sf_dir):
    return L.commit_plan(L.validated(L.slices(_files(spark, sf_dir))))


@query("b21_follow_ups", f"""WITH {_SLICES} SELECT slice_id, CAST(x.p AS INT) AS position, x.tool, x.target FROM (SELECT slice_id, unnest(list_filter([
  CASE WHEN slice_id LIKE 'route:%' THEN {{p: 1, tool: 'api_impact', target: substr(slice_id, 7)}} END, CASE WHEN slice_id LIKE 'route:%' THEN {{p: 2, tool: 'shape_check', target: substr(slice_id, 7)}} END, {{p: 3, tool: 'get_source_context', target: first_file}},
  CASE WHEN slice_id IN ('indexing-parsers', 'indexing-graph', 'graph-storage') THEN {{p: 4, tool: 'find_tests_for_target', target: first_file}} END, CASE WHEN slice_id = 'support-services' THEN {{p: 5, tool: 'impact_analysis', target: first_file}} END], lambda y: y IS NOT NULL)) AS x FROM slices)""")  # fmt: skip
def b21_follow_ups(spark, sf_dir):
    return L.follow_ups(L.slices(_files(spark, sf_dir)))


@query("f16_focused_change", f"WITH {_FILES} SELECT file_path, p_partkey FROM files WHERE lower(file_path) = 'app' OR ends_with(lower(file_path), '/app') OR starts_with(lower(file_path), 'app/') OR p_partkey % 50 = 3")
def f16_focused_change(spark, sf_dir):
    name = F.when(F.col("p_partkey") % 50 == 3, F.lit("Mod.App")).otherwise("Mod.Other")
    return L.focused(_files(spark, sf_dir).withColumn("symbols", F.array(name)), "App").select("file_path", "p_partkey")


@query("a13_risk_labels", f"""WITH {_FILES}, h AS (SELECT *, {_HIGH} AS risky, len(list_filter([{_HITS}], lambda x: x IS NOT NULL)) AS n_hints, {_EMBEDDED} AS embedded FROM files)
SELECT p_partkey, CASE WHEN n_symbols >= 8 OR risky THEN 'HIGH' WHEN n_symbols >= 3 OR n_impacted > 0 OR n_hints > 0 THEN 'MEDIUM' ELSE 'LOW' END AS risk, embedded FROM h""")  # fmt: skip
def a13_risk_labels(spark, sf_dir):
    return L.touched(_files(spark, sf_dir).drop("risk")).select("p_partkey", "risk", "embedded")


@query("d14_signatures", """SELECT p_partkey, CAST(p_partkey % 4 AS INT) AS n_params, CASE WHEN p_partkey % 2 = 0 THEN 'list[int]' ELSE '' END AS returns FROM part""")
def d14_signatures(spark, sf_dir):
    """Parameter counts and return types of signatures."""
    params = F.array(*[F.lit(x) for x in ("self", "self, a: int", "a, b=2", "cls, a, b, c")])[(F.col("p_partkey") % 4).cast("int")]
    sign = F.concat(F.lit("def f("), params, F.lit(")"), F.when(F.col("p_partkey") % 2 == 0, " -> list[int]:").otherwise(":"))
    return Tables(spark, sf_dir).raw("part").select("p_partkey", S.parameter_count(sign).alias("n_params"), S.return_type(sign).alias("returns"))
