"""Index runs: scan, plan, parse, chunk, embed and write, for all files or for those that changed."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.functions import scalar as S
from gneiss.operators import parsers, reports, text
from gneiss.operators import relational as R
from gneiss.operators.retrieval import hash_vector
from gneiss.sources.files import SnapshotTable, scan_repository

#: Language -> registered parser; Python has its own, and the rest are parsed by general patterns.
PARSER_OF = {
    "typescript": "typescript", "tsx": "typescript", "csharp": "csharp", "c": "c_family", "cpp": "c_family", "object_pascal": "pascal", "object_pascal_project": "pascal", "object_pascal_package": "pascal",
    "object_pascal_form": "pascal_form", "csharp_project": "project", "csharp_solution": "project", "native_project": "project", "native_build": "project",
}
TABLES = ("files", "symbols", "edges", "chunks", "vectors", "runs")


class Index:
    """The engine's tables below one folder, each a SnapshotTable."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.tables = {name: SnapshotTable(spark, f"{self.root}/{name}") for name in TABLES}

    def read(self, name: str) -> DataFrame:
        return self.tables[name].read()

    def exists(self) -> bool:
        return bool(self.tables["files"].versions())

    def _replace(self, name: str, new: DataFrame, gone: DataFrame, key: str) -> None:
        """Rows of the gone files leave, new ones come: whole files are rewritten, so that nothing of them is lost."""
        table = self.tables[name]
        table.overwrite(R.without(table.read(), gone, key, "path").unionByName(new.select(*table.read().columns)) if table.versions() else new)


def parse_symbols(files: DataFrame) -> DataFrame:
    """(path, language, text) -> symbols of all languages in one form."""
    python = text.python_symbols(files.where("language = 'python'"))
    parts = [python]
    for parser in sorted(set(PARSER_OF.values())):
        some = files.where(F.col("language").isin(*[k for k, v in PARSER_OF.items() if v == parser]))
        found = parsers.parsed(some, parser)
        none = F.array().cast("array<string>")
        parts.append(found.select("file_path", F.col("name").alias("qualified_name"), F.regexp_extract("name", r"([^.]*)$", 1).alias("name"), "kind", F.col("line").alias("start_line"), F.col("line").alias("end_line"), none.alias("calls"), none.alias("bases")))
    rest = text.generic_symbols(files.where(~F.col("language").isin("python", *PARSER_OF)))
    none = F.array().cast("array<string>")
    parts.append(rest.select("file_path", F.col("name").alias("qualified_name"), "name", "kind", F.lit(0).alias("start_line"), F.lit(0).alias("end_line"), none.alias("calls"), none.alias("bases")))
    return reduce(DataFrame.unionByName, parts)


def link(symbols: DataFrame) -> DataFrame:
    """Edges of parsed symbols; a call goes to a symbol of the same file, else to the only one of that name, else stays a name."""
    raw = text.parsed_edges(symbols.where("kind <> 'parse_error'"))
    homes = symbols.select(F.col("qualified_name").alias("source"), "file_path").distinct()
    local = symbols.select("file_path", F.col("name").alias("short"), F.col("qualified_name").alias("t1")).groupBy("file_path", "short").agg(F.min("t1").alias("t1"))
    unique = symbols.groupBy(F.col("name").alias("short")).agg(F.count(F.lit(1)).alias("n"), F.min("qualified_name").alias("t2")).where("n = 1").drop("n")
    named = raw.where("relation <> 'DEFINES'").withColumn("short", S.tail(F.col("target"))).join(homes, "source")
    named = named.join(local, ["file_path", "short"], "left").join(unique, "short", "left").select("source", "relation", F.coalesce("t1", "t2", "target").alias("target"), "file_path")
    return raw.where("relation = 'DEFINES'").withColumn("file_path", F.col("source")).unionByName(named).distinct()


def run(spark: SparkSession, root: str, index: Index, full: bool = False) -> dict:
    """One index run; incremental unless full or first. Returns its counts, which are also a row of runs."""
    began = time.time()
    files = scan_repository(spark, root)
    listed = files.select("path", "sha256")
    first = full or not index.exists()
    plan = R.plan_changes(listed.limit(0) if first else index.read("files").select("path", "sha256"), listed)
    counts = {x.status: x["count"] for x in plan.groupBy("status").count().collect()}
    todo = plan.where("status <> 'unchanged'").select("path")
    changed = files.join(plan.where("status = 'changed'").select("path"), "path", "left_semi")
    symbols = parse_symbols(changed)
    chunks = text.chunks(changed, 100, 12)
    vectors = chunks.select("content_hash", hash_vector(F.col("content")).alias("vector")).dropDuplicates(["content_hash"])
    if first:
        for name, rows in (("symbols", symbols), ("chunks", chunks), ("vectors", vectors)):
            index.tables[name].overwrite(rows)
    else:
        index._replace("symbols", symbols, todo, "file_path")
        index._replace("chunks", chunks, todo, "file_path")
        misses = R.cache_lookup(vectors, index.read("vectors").select("content_hash"), "content_hash")[1]
        index.tables["vectors"].overwrite(index.read("vectors").unionByName(vectors.join(misses, "content_hash", "left_semi")))
    # Names may resolve otherwise after any change, so that edges are linked anew from all symbols.
    index.tables["edges"].overwrite(link(index.read("symbols")))
    index.tables["files"].overwrite(files.drop("text"))
    row = {"started": began, "finished": time.time(), "status": "ok", **{k: counts.get(k, 0) for k in ("changed", "deleted", "unchanged")}}
    rows = spark.createDataFrame([tuple(row.values())], "started double, finished double, status string, changed long, deleted long, unchanged long")
    index.tables["runs"].overwrite(index.read("runs").unionByName(rows) if index.tables["runs"].versions() else rows)
    return row


def status(index: Index) -> DataFrame:
    return reports.index_health(index.read("files"), index.read("symbols"), index.read("edges"), index.read("chunks"))


def recent_runs(index: Index, k: int = 10) -> DataFrame:
    return R.top(index.read("runs"), [F.desc("finished"), F.desc("started")], k)


class Groups:
    """Named groups of indexes, kept as a snapshot table of (group, repo, root)."""

    SCHEMA = "group string, repo string, root string"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.table = spark, SnapshotTable(spark, root)

    def members(self) -> DataFrame:
        return self.table.read() if self.table.versions() else self.spark.createDataFrame([], self.SCHEMA)

    def add(self, group: str, repo: str, root: str) -> str:
        if not self.members().where((F.col("group") == group) & (F.col("repo") == repo)).isEmpty():
            return "exists"
        self.table.overwrite(self.members().unionByName(self.spark.createDataFrame([(group, repo, root)], self.SCHEMA)))
        return "ok"

    def remove(self, group: str, repo: str) -> str:
        kept = self.members().where(~((F.col("group") == group) & (F.col("repo") == repo)))
        if kept.count() == self.members().count():
            return "not_found"
        self.table.overwrite(kept)
        return "ok"

    def _indexes(self, group: str) -> list[tuple[str, Index]]:
        return [(x.repo, Index(self.spark, x.root)) for x in self.members().where(F.col("group") == group).orderBy("repo").collect()]  # a group's few members

    def read(self, group: str, table: str) -> DataFrame:
        """A table of all members, with the repository's name."""
        return reduce(DataFrame.unionByName, [i.read(table).withColumn("repo", F.lit(repo)) for repo, i in self._indexes(group)])

    def unified_graph(self, group: str) -> DataFrame:
        """All members' edges in one graph, and CROSS_REPO_MATCH between symbols of one name."""
        edges = reports.unified_groups([(repo, i.read("edges")) for repo, i in self._indexes(group)])
        names = self.read(group, "symbols").where("name <> ''").select("repo", F.lower("name").alias("short"), F.concat_ws(":", "repo", "qualified_name").alias("node"))
        a, b = names.toDF("ra", "short", "source"), names.toDF("rb", "short", "target")
        cross = a.join(b, "short").where("ra < rb").select("source", F.lit("CROSS_REPO_MATCH").alias("relation"), "target")
        return edges.unionByName(cross).distinct()
