"""Reads and writes of the engine's tables by key, in whole frames instead of batches of keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.functions import scalar as S
from gneiss.operators.relational import upsert, without

#: View -> the columns of a payload that it keeps. Fixed values.
VIEWS = {
    "compact": ("name", "file_path", "kind", "score"), "callers": ("name", "callers"), "callees": ("name", "callees"), "dependencies": ("name", "dependencies"), "summary": ("name", "summary"),
}


def of_files(rows: DataFrame, files: DataFrame, file_key: str = "file_path") -> DataFrame:
    """Rows of the files (path), in order of file and line: symbols or chunks."""
    return rows.join(files.select(F.col("path").alias(file_key)).distinct(), file_key, "left_semi")


def symbol_info(symbols: DataFrame, names: DataFrame) -> DataFrame:
    """(name) -> the first symbol of each qualified name: file, kind and line; names without one stay, with nulls."""
    first = symbols.groupBy("qualified_name").agg(F.min(F.struct("file_path", "start_line", "kind")).alias("s"))
    return names.select("name").distinct().join(first.withColumnRenamed("qualified_name", "name"), "name", "left").select("name", "s.file_path", "s.start_line", "s.kind")


def inserted(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old and the rows of new whose key it hasn't; the first of new by its columns stays (insert or ignore)."""
    fresh = new.select(*old.columns).join(old.select(*keys).distinct(), list(keys), "left_anti")
    rest = [c for c in old.columns if c not in keys]
    one = fresh.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("r")).select(*keys, "r.*") if rest else fresh.distinct()
    return old.unionByName(one.select(*old.columns))


def replaced(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old with the rows of new in place of those with the same key (insert or replace)."""
    return upsert(old, new.select(*old.columns), keys)


def resolved_findings(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Findings of the files (path) get the status resolved."""
    gone = files.select(F.col("path").alias("file_path"), F.lit(True).alias("__gone")).distinct()
    return findings.join(gone, "file_path", "left").withColumn("status", F.when(F.col("__gone"), "resolved").otherwise(F.col("status"))).drop("__gone")


def without_processes(processes: DataFrame, members: DataFrame, links: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Processes whose paths hold a file (path), their memberships and the links between them go; the rest of all three."""
    hit = processes.select("process_id", F.explode("file_paths").alias("path")).join(files.select("path").distinct(), "path", "left_semi").select("process_id").distinct()
    kept_links = without(without(links, hit, "left_id", "process_id"), hit, "right_id", "process_id")
    return without(processes, hit, "process_id"), without(members, hit, "process_id"), kept_links


def memberships(processes: DataFrame) -> DataFrame:
    """(process_id, steps as an array of symbols) -> process_id, symbol, step_index, role: entry, terminal or intermediate."""
    rows = processes.select("process_id", F.size("steps").alias("n"), F.posexplode("steps").alias("step_index", "symbol"))
    role = F.when(F.col("step_index") == 0, "entry").when(F.col("step_index") == F.col("n") - 1, "terminal").otherwise("intermediate")
    return rows.select("process_id", "symbol", "step_index", role.alias("role"))


def process_files(processes: DataFrame, symbols: DataFrame) -> DataFrame:
    """(process_id, steps) -> process_id, files, modules: where its symbols lie, sorted."""
    homes = symbols.groupBy(F.col("qualified_name").alias("symbol")).agg(F.min("file_path").alias("file_path"))
    per = memberships(processes).join(homes, "symbol").groupBy("process_id").agg(S.joined(F.collect_set("file_path")).alias("files"), S.joined(F.collect_set(S.module_of(F.col("file_path")))).alias("modules"))
    return per


def relation_scan(edges: DataFrame, relations: Sequence[str] = ()) -> DataFrame:
    """All edges, or those of some relations, which a table partitioned by relation reads alone."""
    return edges.where(F.col("relation").isin(*relations)) if relations else edges


def view(rows: DataFrame, name: str) -> DataFrame:
    """The columns of a view that rows has."""
    return rows.select(*[c for c in VIEWS[name] if c in rows.columns])


def entry_order(rows: DataFrame) -> DataFrame:
    """(symbol, file_path, role, fan_in, fan_out) -> with position: route handlers first, tests last, then by calls out, calls in and name."""
    rank = F.when(S.is_test_path(F.col("file_path")), 2).when(F.col("role") == "route_entrypoint", 0).otherwise(1)
    from pyspark.sql import Window as W

    # One application's entry points: a short list.
    return rows.withColumn("position", F.row_number().over(W.partitionBy("root").orderBy(rank, F.desc("fan_out"), F.asc("fan_in"), F.asc("symbol"))))


def leading_lines(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(file_path, qualified_name, start_line) and (path, text) -> first_line: that of the comment lines and decorators right above a symbol, or its own."""
    lines = files.select(F.col("path").alias("file_path"), F.split("text", "\n").alias("lines"))
    above = F.reverse(F.slice("lines", F.lit(1), F.greatest(F.col("start_line") - 1, F.lit(0))))
    is_lead = lambda x: F.trim(x).rlike(r"""^(#|//|/\*|\*|\"\"\"|'''|@)""")
    attached = F.aggregate(above, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.when(s.on & is_lead(x), F.struct((s.n + 1).alias("n"), F.lit(True).alias("on"))).otherwise(F.struct(s.n.alias("n"), F.lit(False).alias("on"))), lambda s: s.n)
    return symbols.join(lines, "file_path").select("file_path", "qualified_name", (F.col("start_line") - attached).alias("first_line"))
