"""Slices of a change: what belongs into one commit, in which order, and whether it is ready."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions import scalar as S
from gneiss.operators import change

#: Pattern of the lower-case path -> slice, title of its commit, place in the order; the first that matches counts. Fixed values.
SLICES = (
    (r"\.(md|rst|txt)$|/docs/|^docs/", "docs", "Update documentation", 21),
    (r"^tests/|/tests/|^test_|\.(test|spec)\.tsx?$|_test\.py$", "tests", "Update test coverage", 20),
    (r"(^|/)indexing/(.*/)?parsers/", "indexing-parsers", "Improve parser extraction", 2),
    (r"(^|/)indexing/", "indexing-graph", "Improve graph construction", 3),
    (r"(^|/)storage/", "graph-storage", "Update graph storage support", 4),
    (r"(^|/)services/", "support-services", "Update support intelligence services", 7),
    (r"(^|/)frontend/|\.(tsx|jsx|ts|js)$", "frontend", "Update frontend behavior", 8),
    (r"/repositories/|/processors/|/database|backend/database", "backend-core", "Update backend data logic", 1),
    (r"(^|/)backend/", "backend", "Update backend behavior", 9),
    ("", "other", "Update other changes", 22),
)
RISKS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")


def slice_of(path: Column, route: Column) -> Column:
    """The slice of a changed file. Files of a route, documents and tests apart, go with the route."""
    low = F.replace(F.lower(path), F.lit("\\"), F.lit("/"))
    docs, tests, *rest = SLICES
    out = F.when(low.rlike(docs[0]), docs[1]).when(low.rlike(tests[0]), tests[1]).when(F.coalesce(route, F.lit("")) != "", F.concat(F.lit("route:"), route))
    for pattern, name, _, _ in rest:
        out = out.when(low.rlike(pattern), name)
    return out


def _of_slice(slice_id: Column, place: int, route: Column) -> Column:
    out = F.when(F.startswith(slice_id, F.lit("route:")), route)
    for row in SLICES:
        out = out.when(slice_id == row[1], F.lit(row[place]))
    return out


def slice_order(slice_id: Column) -> Column:
    return F.coalesce(_of_slice(slice_id, 3, F.lit(0)), F.lit(19))


def commit_title(slice_id: Column) -> Column:
    return _of_slice(slice_id, 2, F.concat(F.lit("Update API contract for "), F.substring(slice_id, 7, 1_000_000)))


def risk_rank(risk: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in RISKS]), risk)


def slices(files: DataFrame) -> DataFrame:
    """(file_path, route, risk, n_tests, n_consumers, n_fields, n_processes, n_mismatches) of changed files -> a row for each slice, by order."""
    rows = files.withColumn("slice_id", slice_of(F.col("file_path"), F.col("route")))
    per = rows.groupBy("slice_id").agg(
        F.count(F.lit(1)).alias("n_files"), F.min("file_path").alias("first_file"), F.element_at(F.array(*[F.lit(x) for x in RISKS]), F.coalesce(F.max(risk_rank(F.col("risk"))), F.lit(1)).cast("int")).alias("risk"),
        F.countDistinct(F.nullif("route", F.lit(""))).alias("n_routes"), *[F.sum(c).alias(c) for c in ("n_tests", "n_consumers", "n_fields", "n_processes", "n_mismatches")],
    )
    return per.withColumn("position", slice_order(F.col("slice_id"))).withColumn("title", commit_title(F.col("slice_id")))


def validated(rows: DataFrame, broad_limited: bool = False) -> DataFrame:
    """slices -> with status (ready, needs_validation, blocked), what is to be done, and the risk that is left after it."""
    risky, limited = F.col("risk").isin("HIGH", "CRITICAL"), F.lit(broad_limited)
    actions = F.array_compact(F.array(
        F.when(limited & risky, "run the follow-up tools, as the traversal was capped"), F.when(risky & (F.col("n_tests") == 0), "find or add tests of this high-risk slice"),
        F.when((F.col("risk") == "MEDIUM") & (F.col("n_tests") == 0), "run one focused test or context check"),
    ))
    blocked = F.col("n_mismatches") > 0
    status = F.when(blocked, "blocked").when(F.size(actions) > 0, "needs_validation").otherwise("ready")
    left = F.when((status == "ready") & (F.col("risk") == "HIGH"), "MEDIUM").when((status == "ready") & (F.col("risk") == "MEDIUM"), "LOW").otherwise(F.col("risk"))
    return rows.withColumn("status", status).withColumn("required_actions", F.array_join(actions, "; ")).withColumn("residual_risk", left)


def readiness(rows: DataFrame, broad_limited: bool = False) -> DataFrame:
    """validated slices -> one row: whether the whole change is ready, counts by status, and the highest risks before and after."""
    risky = F.col("risk").isin("HIGH", "CRITICAL")
    highest = lambda c: F.element_at(F.array(*[F.lit(x) for x in RISKS]), F.coalesce(F.max(risk_rank(F.col(c))), F.lit(1)).cast("int"))
    one = rows.agg(
        *[F.count_if(F.col("status") == x).alias(x) for x in ("ready", "needs_validation", "blocked")], F.count_if(risky & (F.col("status") != "ready")).alias("unvalidated"),
        highest("risk").alias("risk"), highest("residual_risk").alias("risk_after_validation"), F.coalesce(F.sum("n_mismatches"), F.lit(0)).alias("mismatches"),
    )
    stopped = F.lit(broad_limited) | (F.col("mismatches") > 0) | (F.col("risk") == "CRITICAL") | (F.col("blocked") > 0)
    status = F.when(stopped, "not_ready").when((F.col("unvalidated") > 0) | (F.col("needs_validation") > 0), "needs_validation").otherwise("ready")
    return one.withColumn("status", status)


def commit_plan(rows: DataFrame) -> DataFrame:
    """validated slices -> their commits, in order. There are few slices, as routes of one change."""
    return rows.select("position", "slice_id", "title", "risk", "n_files", "status").orderBy("position", "slice_id")


def follow_ups(rows: DataFrame) -> DataFrame:
    """slices -> slice_id, tool, target: what to ask next, in order."""
    route = F.when(F.startswith("slice_id", F.lit("route:")), F.substring("slice_id", 7, 1_000_000))
    ask = lambda position, tool, target, when: F.when(when, F.struct(F.lit(position).alias("position"), F.lit(tool).alias("tool"), target.alias("target")))
    first = F.col("first_file")
    asked = F.array_compact(F.array(
        ask(1, "api_impact", route, route.isNotNull()), ask(2, "shape_check", route, route.isNotNull()), ask(3, "get_source_context", first, first.isNotNull()),
        ask(4, "find_tests_for_target", first, F.col("slice_id").isin("indexing-parsers", "indexing-graph", "graph-storage")), ask(5, "impact_analysis", first, F.col("slice_id") == "support-services"),
    ))
    return rows.select("slice_id", F.inline(asked))


def focused(files: DataFrame, target: str) -> DataFrame:
    """The changed files (file_path, symbols as an array) that a target names: a path, an end of one, or a changed symbol or its tail."""
    t = F.lit(target.replace("\\", "/").strip("/").lower())
    path, symbols = F.lower("file_path"), F.transform("symbols", F.lower)
    by_path = (path == t) | F.endswith(path, F.concat(F.lit("/"), t)) | F.startswith(path, F.concat(t, F.lit("/")))
    return files.where(by_path | F.exists(symbols, lambda x: (x == t) | (S.tail(x) == t)))


def post_change_review(files: DataFrame, stale: DataFrame, broad_limited: bool = False) -> DataFrame:
    """Changed files as for slices, and (path) of files newer than the index -> one row: readiness, stale changed files, and a verdict."""
    ready = readiness(validated(slices(files), broad_limited), broad_limited)
    old = files.join(stale.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_semi").agg(F.count(F.lit(1)).alias("stale_files"))
    both = ready.crossJoin(F.broadcast(old))  # one row each
    verdict = F.when(F.col("stale_files") > 0, "reindex_first").when(F.col("status") == "ready", "safe_to_commit").when(F.col("status") == "needs_validation", "validate_first").otherwise("do_not_commit")
    return both.withColumn("verdict", verdict)


def touched(files: DataFrame) -> DataFrame:
    """(file_path, n_symbols, n_impacted) as change.file_risk wants it, with the file's embedded sensitivity."""
    return change.file_risk(files).withColumn("embedded", change.is_embedded_sensitive(F.col("file_path")))
