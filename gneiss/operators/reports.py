"""Composite answers: change reports, test suggestions, contexts, index health and groups, each one a DataFrame."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.functions import scalar as S
from gneiss.operators import change, graph
from gneiss.operators import relational as R
from gneiss.operators.text import diff_lines


def detect_changes(diffs: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(diff_id, text), symbols and edges -> a row for each touched file: symbols, dependants, hints and risk."""
    lines = diff_lines(diffs).select("file_path", "line")
    touched = graph.cut(R.changed_symbols(symbols, lines).select("qualified_name", "file_path"))
    users = edges.join(touched.select(F.col("qualified_name").alias("target"), "file_path"), "target").groupBy("file_path").agg(F.countDistinct("source").alias("n_impacted"))
    counts = touched.groupBy("file_path").agg(F.count(F.lit(1)).alias("n_symbols"))
    files = lines.select("file_path").distinct().join(counts, "file_path", "left").join(users, "file_path", "left").na.fill(0, ["n_symbols", "n_impacted"])
    return change.file_risk(files)


def change_impact_report(diffs: DataFrame, symbols: DataFrame, edges: DataFrame, depth: int = 2) -> DataFrame:
    """detect_changes with what the touched symbols of a file reach upstream."""
    touched = R.changed_symbols(symbols, diff_lines(diffs).select("file_path", "line"))
    reached = graph.impact(edges, touched.select(F.col("qualified_name").alias("node")), "up", depth)
    homes = symbols.select(F.col("qualified_name").alias("node"), F.col("file_path").alias("impacted_file"))
    files = reached.join(homes, "node").groupBy("impacted_file").agg(F.count(F.lit(1)).alias("n"), F.min("depth").alias("nearest"), F.round(F.sum(F.col("weight").cast("decimal(20,2)")), 2).cast("double").alias("weight"))
    return files.withColumn("is_test", S.is_test_path(F.col("impacted_file")))


def suggest_tests(diffs: DataFrame, symbols: DataFrame, edges: DataFrame, k: int = 20) -> DataFrame:
    """Test files for a diff: by calls in one or two steps (12, 8), by convention of the name (9)."""
    lines = diff_lines(diffs).select("file_path", "line")
    touched = R.changed_symbols(symbols, lines).select(F.col("qualified_name").alias("node"))
    near = graph.reach(edges, touched, "up", 2).where("depth > 0").join(symbols.select(F.col("qualified_name").alias("node"), "file_path"), "node")
    by_graph = near.where(S.is_test_path(F.col("file_path"))).select("file_path", F.when(F.col("depth") == 1, 12).otherwise(8).alias("score"), F.lit("graph").alias("reason"))
    stem = lambda c: F.regexp_replace(F.regexp_replace(F.lower(S.base_name(c)), r"\.[^.]*$", ""), r"^tests?_|[._-](test|spec|tests)$", "")
    files = symbols.select("file_path").distinct()
    wanted = lines.select(stem(F.col("file_path")).alias("stem")).distinct()
    by_name = files.where(S.is_test_path(F.col("file_path"))).withColumn("stem", stem(F.col("file_path"))).join(wanted, "stem", "left_semi").select("file_path", F.lit(9).alias("score"), F.lit("convention").alias("reason"))
    best = R.best_per_key(by_graph.unionByName(by_name), ["file_path"], [F.desc("score"), F.asc("reason")])
    return R.top(best, [F.desc("score"), F.asc("file_path")], k)


def diff_context(diffs: DataFrame, symbols: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    """Touched symbols with their first k callers and callees as text."""
    touched = graph.cut(R.changed_symbols(symbols, diff_lines(diffs).select("file_path", "line")).select("qualified_name", "file_path"))  # of a known size, so that edges aren't shuffled for a few symbols

    def side(own: str, other: str, name: str) -> DataFrame:
        pairs = edges.join(touched.select(F.col("qualified_name").alias(own)), own, "left_semi").select(F.col(own).alias("qualified_name"), F.col(other).alias("x")).distinct()
        return R.best_per_key(pairs, ["qualified_name"], [F.asc("x")], k).groupBy("qualified_name").agg(S.joined(F.collect_list("x")).alias(name))

    out = touched.join(side("target", "source", "callers"), "qualified_name", "left").join(side("source", "target", "callees"), "qualified_name", "left")
    return out.na.fill("", ["callers", "callees"])


def explain_error(traces: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(trace_id, text) -> frames with the symbol around them and how many callers it has."""
    from gneiss.operators.text import stack_frames

    frames = stack_frames(traces).select(F.concat_ws(":", "trace_id", "position").alias("frame_id"), F.col("file").alias("file_path"), "line", "function")
    found = R.enclosing_symbols(frames, symbols)
    callers = edges.groupBy(F.col("target").alias("qualified_name")).agg(F.countDistinct("source").alias("callers"))
    return found.join(callers, "qualified_name", "left").select("frame_id", "file_path", "line", "function", "qualified_name", "inside", F.coalesce("callers", F.lit(0)).alias("callers"))


def symbol_context(symbols: DataFrame, edges: DataFrame, target: str) -> DataFrame:
    """The best match of target with its fan-in, fan-out and relations."""
    best = R.search_symbols(symbols, target, 1)
    return best.join(graph.degrees(edges).withColumnRenamed("node", "qualified_name"), "qualified_name", "left").na.fill(0, ["fan_in", "fan_out", "relations"])


def file_summary(symbols: DataFrame) -> DataFrame:
    kinds = symbols.groupBy("file_path", "kind").agg(F.count(F.lit(1)).alias("n"), F.max("end_line").alias("end"))
    return kinds.groupBy("file_path").agg(F.sum("n").alias("symbols"), S.joined(F.collect_list(F.concat_ws(":", "kind", "n"))).alias("kinds"), F.max("end").alias("last_line"))


def index_health(files: DataFrame, symbols: DataFrame, edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row for each table: rows and what is wrong with it."""
    count = lambda name, df: df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"))
    tables = reduce(DataFrame.unionByName, [count(n, df) for n, df in (("files", files), ("symbols", symbols), ("edges", edges), ("chunks", chunks))])
    per_file = chunks.groupBy("file_path").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("most"))
    warning = F.when(F.col("rows") == 0, "empty").when((F.col("table") == "chunks") & (F.col("most") > 25), "many chunks in a file").otherwise("")
    return tables.join(F.broadcast(per_file)).select("table", "rows", warning.alias("warning"))


def coverage_gaps(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Symbols that no test file's symbol points to, for each file."""
    tests = symbols.where(S.is_test_path(F.col("file_path"))).select(F.col("qualified_name").alias("source"))
    covered = edges.join(tests, "source", "left_semi")
    open_ = R.without(symbols.where(~S.is_test_path(F.col("file_path"))), covered, "qualified_name", "target")
    return open_.groupBy("file_path").agg(F.count(F.lit(1)).alias("untested"), S.joined(F.slice(F.sort_array(F.collect_set("qualified_name")), 1, 5)).alias("samples"))


def api_impact(handlers: DataFrame, consumers: DataFrame) -> DataFrame:
    """(route, keys) of handlers and consumers -> shape status and risk; a handler without keys takes those of its consumers."""
    provided = handlers.groupBy("route").agg(F.array_distinct(F.flatten(F.collect_list("keys"))).alias("keys")).withColumn("keys", F.nullif("keys", F.array().cast("array<string>")))
    return change.missing_keys(consumers, provided)


def field_impact(shapes: DataFrame, field: str) -> DataFrame:
    """(route, keys) rows of which a key equals the field or ends with it behind a dot."""
    return shapes.where(F.exists("keys", lambda k: (k == field) | k.endswith("." + field) | F.lit(field).endswith(F.concat(F.lit("."), k))))


def unified_groups(repos: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Edges of several repositories in one graph, node names led by the repository's."""
    named = lambda repo, e: e.select(F.concat(F.lit(f"{repo}:"), "source").alias("source"), "relation", F.concat(F.lit(f"{repo}:"), "target").alias("target"))
    return reduce(DataFrame.unionByName, [named(r, e) for r, e in repos])


def community_names(members: DataFrame, k: int = 3) -> DataFrame:
    """(node, community, name) -> community, its k most frequent words and its size."""
    sizes = members.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    words = members.select("community", F.explode(S.tokens(F.col("name"))).alias("w")).groupBy("community", "w").agg(F.count(F.lit(1)).alias("n"))
    best = R.best_per_key(words, ["community"], [F.desc("n"), F.asc("w")], k)
    names = best.groupBy("community").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(-F.col("n"), "w"))), lambda x: x.w), " ").alias("name"))
    return sizes.join(names, "community", "left")
