"""Tools by name: each takes engine tables and parameters and returns a DataFrame or a small payload."""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gneiss.functions import scalar as S
from gneiss.operators import change, communities, contracts, graph, parsers, relational, reports, retrieval, search, slices, store, test_finding, text
from gneiss.plans import indexing, investigation, jobs

MOST_BYTES, MOST_ROWS = 256_000, 50
#: Relations that data flows along. Fixed values.
DATA_RELATIONS = ("READS_FIELD", "ACCESSES", "FETCHES", "REFERENCES", "HAS_PROPERTY", "HAS_METHOD", "EXTENDS", "IMPLEMENTS", "ASSOCIATED_WITH", "DECLARES")


@dataclass(frozen=True)
class Tool:
    name: str
    run: Callable[..., DataFrame]
    doc: str

    def schema(self) -> dict:
        """Parameters by name, with their defaults."""
        return {p.name: None if p.default is p.empty else p.default for p in inspect.signature(self.run).parameters.values()}


TOOLS: dict[str, Tool] = {}


def tool(name: str, run: Callable[..., DataFrame]) -> None:
    TOOLS[name] = Tool(name, run, inspect.getdoc(run) or "")


def _neighbourhood(edges: DataFrame, node: str, depth: int = 1) -> DataFrame:
    """Nodes within depth steps of a node, either way."""
    return graph.reach(edges, edges.sparkSession.createDataFrame([(node,)], "node string"), "both", depth)


def _impact(edges: DataFrame, node: str, direction: str = "up", depth: int = 3) -> DataFrame:
    """What depends on a node (up), or what it depends on (down)."""
    return graph.impact(edges, edges.sparkSession.createDataFrame([(node,)], "node string"), direction, depth)


def _trace(edges: DataFrame, node: str, depth: int = 4, branches: int = 4) -> DataFrame:
    """Call paths from a node."""
    return graph.paths(edges.where(F.col("relation").isin("CALLS", "USES_SERVICE", "INJECTS")), edges.sparkSession.createDataFrame([(node,)], "node string"), depth, branches)


def _data_flow(edges: DataFrame, node: str, depth: int = 4) -> DataFrame:
    """Where a node's data goes to, by the relations that carry data."""
    return graph.reach(edges.where(F.col("relation").isin(*DATA_RELATIONS)), edges.sparkSession.createDataFrame([(node,)], "node string"), "down", depth)


def _one(edges: DataFrame, node: str) -> DataFrame:
    return edges.sparkSession.createDataFrame([(node,)], "node string")


def _calls(edges: DataFrame, node: str, k: int = 50) -> DataFrame:
    """What calls a node and what it calls, by relation and direction."""
    near = edges.where((F.col("source") == node) | (F.col("target") == node))
    rows = near.select(F.when(F.col("source") == node, "callee").otherwise("caller").alias("side"), "relation", F.when(F.col("source") == node, F.col("target")).otherwise(F.col("source")).alias("node"))
    return relational.best_per_key(rows.distinct(), ["side", "relation"], [F.asc("node")], k)


def _dependencies(edges: DataFrame, node: str) -> DataFrame:
    """Edges in and out of a node by relation, with the first five ends of each."""
    calls = _calls(edges, node, 1_000_000).withColumn("n", F.row_number().over(W.partitionBy("side", "relation").orderBy("node")))
    return calls.groupBy("side", "relation").agg(F.count(F.lit(1)).alias("edges"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("n") <= 5, F.col("node")))), ",").alias("samples"))


def _file_dependencies(edges: DataFrame, symbols: DataFrame, file_path: str) -> DataFrame:
    """Files that a file's symbols point to, and that point to them, with the number of edges."""
    home = symbols.select("qualified_name", "file_path").distinct()
    a, b = home.toDF("source", "from_file"), home.toDF("target", "to_file")
    both = edges.join(a, "source").join(b, "target").where("from_file <> to_file").where((F.col("from_file") == file_path) | (F.col("to_file") == file_path))
    return both.groupBy("from_file", "to_file").agg(F.count(F.lit(1)).alias("edges"), F.sort_array(F.collect_set("relation")).alias("relations"))


def _source_context(files: DataFrame, chunks: DataFrame, target: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """A range of a file's lines, else the chunks of a symbol, else the file's first lines."""
    lines = files.where(F.col("path") == target).select(F.col("path").alias("file_path"), F.split("text", "\n").alias("l"))
    if start is not None:
        return lines.select("file_path", F.lit("range").alias("origin"), F.array_join(F.slice("l", start, (end or start) - start + 1), "\n").alias("content"))
    own = chunks.where((F.col("qualified_name") == target) | (F.col("chunk_id") == target)).select("file_path", F.lit("chunk").alias("origin"), "content")
    return own.unionByName(lines.select("file_path", F.lit("file").alias("origin"), F.array_join(F.slice("l", 1, 120), "\n").alias("content")))


def _found_tests(target: str, files: DataFrame, symbols: DataFrame, edges: DataFrame, k: int = 10) -> DataFrame:
    """Tests of a symbol or file by calls, conventions and words."""
    hit = symbols.where((F.col("qualified_name") == target) | (F.col("name") == target) | (F.col("file_path") == target))
    targets = hit.select(F.lit(target).alias("target"), F.col("qualified_name").alias("symbol"), "file_path")
    seed = targets.select("target", F.concat_ws(" ", "target", "file_path", "symbol").alias("seed"))
    tests = files.where(S.is_test_path(F.col("path"))).select(F.col("path").alias("file_path"))
    return test_finding.found([test_finding.by_calls(targets, edges, symbols), test_finding.by_convention(targets, files), test_finding.by_words(seed, tests)], k)


def _processes(processes: DataFrame, text: str = "", k: int = 50) -> DataFrame:
    """Processes, or those with a symbol that holds the text, the longest first."""
    some = processes.where(F.exists("steps", lambda x: F.contains(F.lower(x), F.lit(text.lower()))))
    return some.select("process_id", F.size("steps").alias("n_steps"), F.element_at("steps", 1).alias("entry"), F.element_at("steps", -1).alias("terminal")).orderBy(F.desc("n_steps"), F.asc("process_id")).limit(k)


def _participation(processes: DataFrame, symbol: str) -> DataFrame:
    """Processes that a symbol takes part in, with its steps and roles."""
    return store.memberships(processes).where(F.col("symbol") == symbol)


def _community(members: DataFrame, community: str) -> DataFrame:
    """The members of a community."""
    return members.where(F.col("community") == community).orderBy("node")


def _community_of(members: DataFrame, node: str) -> DataFrame:
    """The community of a symbol, and its size."""
    own = members.where(F.col("node") == node).select("community")
    return members.join(F.broadcast(own), "community").groupBy("community").agg(F.count(F.lit(1)).alias("size"))


def _group_status(groups: indexing.Groups, group: str) -> DataFrame:
    """The members of a group, and whether each has an index."""
    rows = [(x.repo, x.root, indexing.Index(groups.spark, x.root).exists()) for x in groups.members().where(F.col("group") == group).collect()]  # a group's few members
    return groups.spark.createDataFrame(rows, "repo string, root string, is_indexed boolean")


for _name, _run in {
    "index_status": indexing.status, "index_health": reports.index_health, "get_recent_runs": indexing.recent_runs, "get_run_metrics": indexing.recent_runs, "list_repos": jobs.discover_repositories, "select_repo": indexing.Index,
    "reindex_project": jobs.Jobs.start, "reindex_status": jobs.Jobs.status, "unified_context": investigation.unified_context, "impact_analysis": _impact, "graph_query": relational.read_only_sql,
    "detect_changes": reports.detect_changes, "route_map": text.route_map, "api_impact": reports.api_impact, "shape_check": change.missing_keys, "field_impact": reports.field_impact, "app_context": contracts.app_context,
    "resolve_target": search.resolved, "trace_processes": _trace, "list_processes": _processes, "symbol_process_participation": _participation, "preview_rename": text.rename_preview, "semantic_code_search": search.hybrid_search,
    "investigate_codebase": investigation.investigate, "change_impact_report": reports.change_impact_report, "find_tests_for_target": _found_tests, "suggest_tests_for_change": reports.suggest_tests, "test_impact": reports.suggest_tests,
    "feature_context": investigation.feature_context, "get_dependencies": _dependencies, "get_review_history": jobs.review_history, "get_symbol_context": reports.symbol_context, "find_symbols": relational.search_symbols,
    "get_callers_and_callees": _calls, "get_graph_neighborhood": _neighbourhood, "get_file_dependencies": _file_dependencies, "get_file_summary": reports.file_summary, "get_source_context": _source_context,
    "check_stale_index": change.stale_files, "trace_data_flow": _data_flow, "post_change_review": slices.post_change_review, "detect_circular_dependencies": graph.cycles, "detect_dead_code": relational.dead_symbols,
    "detect_duplicate_code": retrieval.near_duplicates, "test_coverage_gaps": reports.coverage_gaps, "detect_communities": communities.communities, "list_communities": reports.community_names, "get_community_detail": _community,
    "get_symbol_community": _community_of, "group_create": indexing.Groups, "group_add_repo": indexing.Groups.add, "group_remove_repo": indexing.Groups.remove, "group_list": indexing.Groups.members, "group_detail": indexing.Groups.members,
    "group_sync": indexing.Groups.unified_graph, "group_query": indexing.Groups.read, "group_status": _group_status, "start_realtime_indexing": jobs.Watcher.start, "stop_realtime_indexing": jobs.Watcher.stop,
    "realtime_indexing_status": jobs.Watcher, "explain_error": reports.explain_error, "diff_context": reports.diff_context, "build_unified_graph": reports.unified_groups, "find_similar_functions": retrieval.similar_functions, "parse_files": parsers.parsed,
}.items():
    tool(_name, _run)


def payload(name: str, rows: DataFrame, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> dict:
    """The first rows as plain values, cut until they fit; says how many there were shown and whether there are more."""
    found = [x.asDict(recursive=True) for x in rows.limit(most_rows + 1).collect()]
    more, shown = len(found) > most_rows, found[:most_rows]
    while shown and len(json.dumps(shown, default=str)) > most_bytes:
        shown, more = shown[: max(len(shown) // 4, 3) if len(shown) > 3 else len(shown) - 1], True
    return {"tool": name, "rows": shown, "shown": len(shown), "truncated": more}


def call(name: str, /, *args, **kwargs) -> dict:
    return payload(name, TOOLS[name].run(*args, **kwargs))
