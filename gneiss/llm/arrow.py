"""Arrow-batched text operators, and files in the shared folder as seen from executors."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Name of the struct column that ``annotated`` adds.
OUT = "__gneiss"
#: Documents handled at once in a worker, so that its memory follows a few texts and not a whole batch.
ROWS_AT_ONCE = 256
#: Rows and bytes of a batch on its way to a worker, at most.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1024", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches, unless it has bounds of its own: two tasks' batches must fit beside the heap."""
    for key, value in BATCH.items():
        if str(spark.conf.get(key)).rstrip("b") in ("10000", str(64 << 20)):  # Spark's own defaults
            spark.conf.set(key, value)


def annotated(docs: DataFrame, keep: list[str], column: str, fields: str, start: Callable[[], Callable[[list], Iterable[tuple]]]) -> DataFrame:
    """docs' columns ``keep`` and a struct column OUT with ``fields``, computed from ``column``.

    start() runs once in each task and returns a function from a list of the
    column's values to one tuple each. Columns of docs can't clash with the
    fields, as these stay inside the struct until the caller selects them.
    """
    small_batches(docs.sparkSession)
    kind = T.StructType.fromDDL(fields)
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(OUT, kind)])
    names = [f.name for f in kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target, f = to_arrow_schema(schema), start()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                rows = list(f(batch.column(column).to_pylist()))
                out = pa.array([dict(zip(names, row, strict=True)) for row in rows], target.field(OUT).type)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).cast(target.field(c).type) for c in keep), out], schema=target)

    return docs.select(*dict.fromkeys([*keep, column])).mapInArrow(run, schema)


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or plain path, and the path in it."""
    return pafs.FileSystem.from_uri(uri) if ":" in uri.split("/", 1)[0] else (pafs.LocalFileSystem(), uri)


@contextmanager
def written(uri: str):
    """A binary stream whose bytes appear at uri once all are written: retried and speculative tasks leave whole files."""
    fs, path = file_system(uri)
    fs.create_dir(posixpath.dirname(path), recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    try:
        with fs.open_output_stream(draft, compression=None) as out:
            yield out
    except BaseException:
        fs.delete_file(draft)
        raise
    fs.move(draft, path)


class RangeReader:
    """Reads byte ranges of a file."""

    def __init__(self, uri: str):
        fs, path = file_system(uri)
        self._file = fs.open_input_file(path)
        self.size = self._file.size()

    def read(self, start: int, length: int) -> bytes:
        got = self._file.read_at(length, start)
        if len(got) != length:
            raise EOFError(f"{length} bytes at {start} of {self.size}")
        return got

    def close(self) -> None:
        self._file.close()
