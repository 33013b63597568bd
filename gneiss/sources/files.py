"""Sources and sinks: repository scans, snapshot tables, diffs and manifests."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.functions import scalar as S
from gneiss.operators.relational import upsert

EXCLUDED = (".git", "node_modules", "dist", "build", "__pycache__", ".venv", "vendor")


def scan_repository(spark: SparkSession, root: str, excluded: Sequence[str] = EXCLUDED, ignore: Sequence[str] = (), most_bytes: int = 10 << 20) -> DataFrame:
    """path, language, size_bytes, sha256, modified_time, text of the known source files below root.

    Any file system that Spark reads will do. Hidden and excluded folders, ignored
    globs, over-large and minified files are left out. The size limit is applied
    to the listing, so that large files are never read.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    full = F.regexp_replace("path", r"^[a-z]+:/*", "/")
    base = "/" + root.split(":", 1)[-1].strip("/") + "/"
    path = F.substring(full, F.lit(len(base) + 1), F.length(full))
    files = raw.where(F.col("length") <= most_bytes).select(path.alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_time"), "content")
    folders = F.split(F.concat(F.lit("/"), F.col("path")), "/")
    hidden = F.exists(F.slice(folders, F.lit(1), F.size(folders) - 1), lambda x: F.startswith(x, F.lit(".")) | x.isin(*excluded))
    files = files.where(~hidden).withColumn("language", S.language_of(F.col("path"))).where("language is not null")
    for pattern in ignore:
        files = files.where(~S.matches_glob(F.col("path"), pattern.rstrip("/") + "/*" if pattern.endswith("/") else pattern.lstrip("/")))
    files = files.select("path", "language", "size_bytes", F.sha2("content", 256).alias("sha256"), "modified_time", F.decode("content", "UTF-8").alias("text"))
    return files.where(~S.is_minified(F.col("text")))


class SnapshotTable:
    """A table of immutable snapshots below a folder: a write makes a new one, readers keep theirs.

    The current snapshot is the one of the highest number that was finished, so
    that a failed write leaves the last good state.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        fs = self._fs()
        if not fs.exists(self._path(self.root)):
            return []
        found = [x.getPath() for x in fs.listStatus(self._path(self.root))]
        return sorted(int(p.getName()[1:]) for p in found if p.getName()[:1] == "v" and fs.exists(self._path(f"{p.toString()}/_SUCCESS")))

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/v{version if version is not None else self.versions()[-1]}")

    def overwrite(self, df: DataFrame, *partition_by: str) -> int:
        version = max(self.versions(), default=-1) + 1
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{self.root}/v{version}")
        return version

    def upsert(self, new: DataFrame, keys: Sequence[str]) -> int:
        return self.overwrite(upsert(self.read(), new.select(*self.read().columns), keys) if self.versions() else new)

    def delete(self, gone: DataFrame, keys: Sequence[str]) -> int:
        return self.overwrite(self.read().join(gone.select(*keys).distinct(), list(keys), "left_anti"))


def write_manifest(spark: SparkSession, path: str, manifest: dict) -> None:
    """One JSON document."""
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def diff_source(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """Diff texts by name, as they come from the version control system, as (diff_id, text)."""
    return spark.createDataFrame(list(texts.items()), "diff_id string, text string")
