"""Helpers of the corpus operators: tables, shared storage, bounded broadcasts.

Every intermediate that is read more than once is written as Parquet below the
folder that ``spark.checkpoint.dir`` names, which driver and executors share; a
lost executor costs a re-read, never a recomputation from the input.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A word: a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: For ``str.translate``: lower-cases A-Z only.
LOWER_AZ = {ord(a): b for a, b in zip(UPPER, LOWER, strict=True)}
#: Largest table, in bytes, that is sent whole to every executor.
BROADCAST_BYTES = 32 << 20
#: Rows of a few numbers that one task takes.
ROWS_OF_PART = 1 << 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors. Only a plain local session may go without the setting."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not re.match(r"local(\[[^,\]]*\])?$", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = Path(tempfile.gettempdir()) / "gneiss-shared"
    own.mkdir(parents=True, exist_ok=True)
    return f"file://{own}"


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/gneiss/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """df, written to the shared folder and read from there: cuts lineage and survives lost executors.

    The folder goes when the application ends.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    scratch = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    scratch.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).deleteOnExit(scratch)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, label: str, *more: Column) -> tuple[DataFrame, dict]:
    """stored, and the number of rows (n) and further aggregates, observed while it is written."""
    seen = Observation()
    out = stored(df.observe(seen, F.count(F.lit(1)).alias("n"), *more), label)
    return out, seen.get


def in_parts(df: DataFrame, rows: int) -> DataFrame:
    """df of so many short rows in partitions of about ROWS_OF_PART, so that small tables take no exchanges."""
    return df.coalesce(max(1, -(-rows // ROWS_OF_PART)))


def set_aside(docs: DataFrame, *needed: str) -> tuple[DataFrame, list[str], list[Column]]:
    """docs with its columns under names of their own, besides those needed by name; those names; and the columns under their old names."""
    own = [f"__c{i}" for i in range(len(docs.columns))]
    pairs = list(zip(docs.columns, own, strict=True))
    return docs.select(*[F.col(c).alias(x) for c, x in pairs], *needed), own, [F.col(x).alias(c) for c, x in pairs]


def lower_az(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def let(value: Column, use) -> Column:
    """use(value) with value evaluated once for each row (a bound variable inside one expression)."""
    return F.element_at(F.transform(F.array(value), use), 1)


def word_count(text: Column) -> Column:
    """Words of the whole text as long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def most_frequent(counts: DataFrame, most: int, n: str = "n") -> DataFrame:
    """The rows of the largest n, at most ``most`` of them: those from a bound on that a small histogram gives.

    The histogram has 16 steps for each doubling of n, hence some hundred rows
    for any corpus. Rows of the step that would pass the limit stay out, so that
    the result doesn't depend on ties, and no task sends more than its share.
    """
    step = F.floor(F.log2(F.col(n)) * 16)
    total, bound = 0, None
    for x in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("step")).collect():
        total += x.rows
        if total > most:
            break
        bound = x.step
    return counts.where(step >= bound) if bound is not None else counts.limit(0)


def is_frequent(counts: DataFrame, by: list[str], most: Callable[[tuple], int], n: str = "n") -> Column:
    """Whether a row is one of the most frequent of its values of by, of which there are few: most_frequent for each of them."""
    step = F.floor(F.log2(F.col(n)) * 16)
    total, bound, full = {}, {}, set()
    for x in counts.groupBy(*by, step.alias("step")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("step")).collect():
        key = tuple(x[c] for c in by)
        total[key] = total.get(key, 0) + x.rows
        if total[key] > most(key):
            full.add(key)
        if key not in full:
            bound[key] = x.step
    if not bound:
        return F.lit(False)
    texts = {"\u0001".join(map(str, key)): value for key, value in bound.items()}
    least = F.create_map(*[F.lit(y) for x in texts.items() for y in x])[F.concat_ws("\u0001", *[F.col(c).cast("string") for c in by])]
    return F.coalesce(step >= least, F.lit(False))


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """A broadcast hint if rows of row_bytes stay below the bound; else df as it is, for a shuffled join."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df
