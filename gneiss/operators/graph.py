"""Graph operators over edges (source, relation, target).

Iterative operators keep a frontier: each level joins it with the edges and
drops what was visited. Levels are written to the shared folder, which cuts
lineage and survives lost executors.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gneiss.functions import scalar as S

#: What an edge of a relation carries over, and the relations that act at run time. Fixed values.
WEIGHTS = {
    "CALLS": 1.0, "FETCHES": 0.9, "INCLUDES": 0.8, "EXTENDS": 0.8, "USES_SERVICE": 0.8, "IMPLEMENTS": 0.75, "INJECTS": 0.75, "METHOD_OVERRIDES": 0.7,
    "METHOD_IMPLEMENTS": 0.65, "READS_FIELD": 0.55, "HAS_PROPERTY": 0.45, "HAS_METHOD": 0.4, "REFERENCES": 0.35, "ACCESSES": 0.35, "IMPORTS": 0.18,
}
RUNTIME = ("CALLS", "FETCHES", "READS_FIELD", "ACCESSES", "USES_SERVICE", "INJECTS")


def _work_dir(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not re.match(r"local(\[[^,\]]*\])?$", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{Path(tempfile.gettempdir()) / 'gneiss-shared'}"


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again. The folder goes when the application ends."""
    path = f"{_work_dir(df.sparkSession)}/gneiss/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    scratch = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    scratch.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).deleteOnExit(scratch)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def oriented(edges: DataFrame, direction: str) -> DataFrame:
    """(a, relation, b): steps from a to b downstream, upstream, or both."""
    down = edges.select(F.col("source").alias("a"), "relation", F.col("target").alias("b"))
    up = edges.select(F.col("target").alias("a"), "relation", F.col("source").alias("b"))
    return {"down": down, "up": up, "both": down.unionByName(up)}[direction]


def reach(edges: DataFrame, seeds: DataFrame, direction: str, depth: int, cap: int | None = None) -> DataFrame:
    """(node) seeds -> node, depth, parent, relation for all within depth steps, seeds at depth 0.

    With a cap, a node's neighbours by one relation are cut to the first so
    many in order of name. Of several parents on one level the least
    (parent, relation) is kept. A seed that nothing leaves is a result of its own.
    """
    steps = oriented(edges, direction)
    if cap is not None:
        n = F.row_number().over(W.partitionBy("a", "relation").orderBy("b"))
        steps = steps.withColumn("__n", n).where(F.col("__n") <= cap).drop("__n")
    if depth > 1:
        steps = cut(steps)  # each level reads what was projected and ranked once
    seen = cut(seeds.select("node").distinct().select("node", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("relation")))
    frontier = seen
    for level in range(1, depth + 1):
        found = frontier.select(F.col("node").alias("a")).join(steps, "a").select(F.col("b").alias("node"), F.struct(F.col("a").alias("parent"), "relation").alias("via"))
        found = found.groupBy("node").agg(F.min("via").alias("via")).join(seen, "node", "left_anti")
        frontier = cut(found.select("node", F.lit(level).alias("depth"), "via.parent", "via.relation"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def impact(edges: DataFrame, seeds: DataFrame, direction: str, depth: int, cap: int | None = None) -> DataFrame:
    """What a change of the seeds touches: reach by the relations that carry behaviour, with the weight of the edge that led there."""
    carrying = edges.where(F.col("relation").isin(*[x for x in WEIGHTS if x != "IMPORTS"]))
    found = reach(carrying, seeds, direction, depth, cap).where("depth > 0")
    return found.withColumn("weight", F.coalesce(S.lookup(WEIGHTS, F.col("relation")), F.lit(0.25)))


def impact_summary(found: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row: direct and total counts, weight, modules, and a risk label."""
    known = found.join(symbols.select(F.col("qualified_name").alias("node"), "file_path"), "node", "left")
    one = known.agg(
        F.count(F.lit(1)).alias("impacted"), F.count_if(F.col("depth") == 1).alias("direct"), F.count_if((F.col("depth") == 1) & F.col("relation").isin(*RUNTIME)).alias("runtime_direct"),
        F.round(F.coalesce(F.sum(F.col("weight").cast("decimal(20,2)")), F.lit(0)), 2).cast("double").alias("weight"), F.countDistinct("file_path").alias("files"),
    )
    risk = F.when(F.expr("runtime_direct >= 8 or weight >= 35 or files >= 12"), "HIGH").when(F.expr("runtime_direct >= 3 or weight >= 10 or files >= 5 or direct >= 20"), "MEDIUM").otherwise("LOW")
    return one.withColumn("risk", risk)


def paths(edges: DataFrame, entries: DataFrame, depth: int, branches: int) -> DataFrame:
    """Simple paths from entries (node) of at most depth steps; a node is left by its first ``branches`` targets.

    Children are ranked before the paths grow, so that a hub costs no more than
    its branches. A path that can't go on, or is depth steps long, is a result:
    entry, path and the ranks taken, whose order is that of a depth-first search.
    """
    ranked = cut(edges.select("source", "target").distinct().withColumn("rank", F.row_number().over(W.partitionBy("source").orderBy("target"))).where(F.col("rank") <= branches))
    growing = entries.select(F.col("node").alias("entry"), F.array("node").alias("path"), F.array().cast("array<int>").alias("ranks"))
    out = None
    for _ in range(depth):
        growing = cut(growing.withColumn("id", F.monotonically_increasing_id()))
        if growing.isEmpty():
            break
        longer = growing.withColumn("source", F.element_at("path", -1)).join(ranked, "source").where(~F.array_contains("path", F.col("target")))
        longer = cut(longer.select("entry", F.concat("path", F.array("target")).alias("path"), F.concat("ranks", F.array(F.col("rank"))).alias("ranks"), F.col("id").alias("from")))
        ended = growing.join(longer.select(F.col("from").alias("id")).distinct(), "id", "left_anti").drop("id")
        out = ended if out is None else out.unionByName(ended)
        growing = longer.drop("from")
    return growing.drop("id") if out is None else out.unionByName(growing.drop("id"))


def trimmed(steps: DataFrame, rounds: int) -> DataFrame:
    """(source, target) -> the edges that may lie on a cycle: those with an edge into their source and one out of their target, again and again until nothing goes, or so many times."""
    steps, left = cut(steps), None
    for _ in range(rounds):
        before, left = (left if left is not None else steps.count()), None
        rest = steps.join(steps.select(F.col("target").alias("source")).distinct(), "source", "left_semi").join(steps.select(F.col("source").alias("target")).distinct(), "target", "left_semi")
        steps = cut(rest.select("source", "target"))
        left = steps.count()
        if left == before:
            break
    return steps


def cycles(edges: DataFrame, longest: int) -> DataFrame:
    """Simple directed cycles of up to ``longest`` nodes, each once, turned so that its least node comes first."""
    steps = trimmed(edges.select("source", "target").distinct().where("source <> target"), longest)
    growing = steps.where("source < target").select(F.array("source", "target").alias("path"))
    out = None
    for size in range(2, longest + 1):
        growing = cut(growing)
        last = growing.withColumn("source", F.element_at("path", -1)).join(steps, "source")
        closed = last.where(F.col("target") == F.col("path")[0]).select("path")
        out = closed if out is None else out.unionByName(closed)
        growing = last.where((F.col("target") > F.col("path")[0]) & ~F.array_contains("path", F.col("target"))).select(F.concat("path", F.array("target")).alias("path"))
    return out


def adjacency(edges: DataFrame, relations: Sequence[str]) -> DataFrame:
    """(a, b) both ways without loops or repeats."""
    some = edges.where(F.col("relation").isin(*relations) & (F.col("source") != F.col("target")))
    return oriented(some, "both").select("a", "b").distinct()


def label_propagation(adjacent: DataFrame, rounds: int) -> DataFrame:
    """(a, b) both ways -> node, label: in each round all nodes take the label most of their neighbours have.

    Synchronous, and the least label wins a tie, so that results don't depend
    on an order of visits; a node's own label counts as one more neighbour's,
    which keeps two-coloured graphs from swapping labels for ever.
    """
    adjacent = cut(adjacent.union(adjacent.select("a", F.col("a").alias("b"))).distinct())
    labels = adjacent.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct()
    for _ in range(rounds):
        votes = adjacent.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a", "label").agg(F.count(F.lit(1)).alias("n"))
        labels = cut(votes.groupBy(F.col("a").alias("node")).agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("label")))
    return labels


def cohesion(adjacent: DataFrame, labels: DataFrame) -> DataFrame:
    """Label -> size, and its internal edges over all edges of its nodes, to three decimals."""
    a = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
    b = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    ends = adjacent.join(a, "a").join(b, "b").groupBy(F.col("la").alias("label")).agg(F.count_if(F.col("la") == F.col("lb")).alias("inner"), F.count_if(F.col("la") != F.col("lb")).alias("outer"))
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    # Each inner edge was seen from both ends.
    share = F.coalesce(F.col("inner") / 2 / F.nullif(F.col("inner") / 2 + F.col("outer"), F.lit(0.0)), F.lit(0.0))
    return sizes.join(ends, "label", "left").select("label", "size", F.round(share, 3).alias("cohesion"))


def degrees(edges: DataFrame) -> DataFrame:
    """node, fan_in, fan_out and the number of relations."""
    ends = edges.select(F.col("source").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"), "relation").unionByName(edges.select(F.col("target").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"), "relation"))
    return ends.groupBy("node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"), F.countDistinct("relation").alias("relations"))


def resolve_names(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(source, file_path, raw) -> source, raw, target: by stages, each of which must be certain.

    1. the qualified name; 2. the one symbol of the same file with that name,
    the first by line if there are several; 3. the one symbol anywhere with
    that name. Words of one or two letters resolve in their own file only.
    """
    known = symbols.select("qualified_name", "name", F.col("file_path").alias("in_file"), "start_line")
    exact = refs.join(known.select(F.col("qualified_name").alias("raw"), F.col("qualified_name").alias("t1")).distinct(), "raw", "left")
    local = known.groupBy(F.col("name").alias("raw"), F.col("in_file").alias("file_path")).agg(F.min_by("qualified_name", F.struct("start_line", "qualified_name")).alias("t2"))
    unique = known.groupBy(F.col("name").alias("raw")).agg(F.count(F.lit(1)).alias("n"), F.min("qualified_name").alias("t3")).where("n = 1 and length(raw) > 2").drop("n")
    out = exact.join(local, ["raw", "file_path"], "left").join(unique, "raw", "left")
    return out.select("source", "raw", F.coalesce("t1", "t2", "t3").alias("target"))
