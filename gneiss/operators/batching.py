"""Order-dependent folds: token-aware batches and semantic chunk borders."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.operators import graph


#: Rows that one task folds at a time.
BLOCK = 50_000


def _ends(tokens: np.ndarray, most_rows: int, most_tokens: int) -> np.ndarray:
    """Where a batch that starts at each place ends (exclusive). A null (NaN) keeps the sum unknown up to the batch's end."""
    n = len(tokens)
    ends, total, going = np.full(n, n), tokens.copy(), np.arange(n)
    for k in range(1, n + 1):
        going = going[going + k < n]
        if not len(going):
            break
        following = tokens[going + k]
        full = np.full(len(going), True) if k >= most_rows else total[going] + following > most_tokens
        ends[going[full]] = going[full] + k
        total[going] += following
        going = going[~full]
    return ends


def _carried(tokens: np.ndarray, n: int, t: float, most_rows: int, most_tokens: int) -> tuple[int, int, float]:
    """How many rows an open batch of n rows and t tokens takes in, and what it holds then."""
    at = 0
    while at < len(tokens) and n < most_rows and not t + tokens[at] > most_tokens:
        n, t, at = n + 1, t + tokens[at], at + 1
    return at, n, t


def token_batches(rows: DataFrame, group: str, most_rows: int, most_tokens: int) -> DataFrame:
    """(group, id, tokens) -> with batch: in order of id, a new batch where either limit would be passed.

    The running sum starts anew with each batch, which no window can say. The
    rows are dealt to blocks in order of group and id. A batch that is open at
    the end of a block goes on in the next, and as it takes in fewer than
    most_rows rows there, the first batch that starts in a block starts at one
    of its first rows: for each of them a block tells what it ends with. From
    these few rows follows how each block begins, and all are folded at once.
    A single row over the limit is a batch.
    """
    spark, kinds, most_rows = rows.sparkSession, rows.schema, max(most_rows, 1)
    order = [F.asc_nulls_last(group), F.asc_nulls_last("id"), F.asc_nulls_last("tokens")]
    blocks = max(1, -(-rows.count() // BLOCK))
    placed = rows.select(group, "id", F.col("tokens").cast("double").alias("tokens")).repartitionByRange(blocks, *order).sortWithinPartitions(*order)
    placed = graph.cut(placed.select(group, "id", "tokens", F.spark_partition_id().alias("block"), F.monotonically_increasing_id().alias("place")))

    def parts(table: pa.Table) -> tuple[pa.Table, np.ndarray, list[tuple[int, int]]]:
        """A block's rows in order, their tokens, and from where to where each group goes."""
        table = table.sort_by("place")
        names = table[group].to_pylist()
        starts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1])]
        return table, np.array(table["tokens"].to_numpy(), float), list(zip(starts, [*starts[1:], len(names)], strict=True))

    def borders(table: pa.Table) -> pa.Table:
        """What the first and the last group of a block look like from outside: first tokens; for each start among them batches, and rows and tokens of the last."""
        table, tokens, spans = parts(table)
        out = []
        for a, b in dict.fromkeys((spans[0], spans[-1])):
            own = tokens[a:b]
            ends, few = _ends(own, most_rows, most_tokens), min(most_rows, b - a)
            count, last = np.ones(b - a, int), np.arange(b - a)
            for i in range(b - a - 1, -1, -1):
                if ends[i] < b - a:
                    count[i], last[i] = 1 + count[ends[i]], last[ends[i]]
            tails = [float(own[i:].sum()) for i in last[:few]]
            out.append((table["block"][0].as_py(), a, b - a, own[:few].tolist(), count[:few].tolist(), (b - a - last[:few]).tolist(), tails))
        columns = ["block", "a", "size", "head", "count", "n", "t"]
        kind = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64())]
        named = pa.table({c: pa.array([x[i] for x in out], k) for i, (c, k) in enumerate(zip(columns, kind, strict=True))})
        return named.append_column(group, table[group].take([x[1] for x in out]).combine_chunks().cast(table.schema.field(group).type))

    seen = placed.groupBy("block").applyInArrow(borders, f"block int, a bigint, size bigint, head array<double>, count array<bigint>, n array<bigint>, t array<double>, `{group}` {kinds[group].dataType.simpleString()}")
    opened, state, before = {}, None, None
    for x in sorted(seen.collect(), key=lambda x: (x.block, x.a)):  # two of a block at most
        goes_on = state is not None and x.a == 0 and x[group] == before
        batch, n, t = state if goes_on else (-1, most_rows, 0.0)
        if goes_on:
            opened[x.block] = state
        at, n, t = _carried(np.array(x.head, float), n, t, most_rows, most_tokens)
        if at < x["size"]:
            batch, n, t = batch + x["count"][at], x.n[at], x.t[at]
        state, before = (batch, n, t), x[group]
    sent = spark.sparkContext.broadcast(opened)

    def fold(table: pa.Table) -> pa.Table:
        table, tokens, spans = parts(table)
        batches = np.zeros(table.num_rows, np.int32)
        for a, b in spans:
            batch, n, t = sent.value.get(table["block"][0].as_py(), (-1, most_rows, 0.0)) if a == 0 else (-1, most_rows, 0.0)
            at = _carried(tokens[a:b], n, t, most_rows, most_tokens)[0]
            ends, starts = _ends(tokens[a:b], most_rows, most_tokens), np.zeros(b - a, np.int32)
            while at < b - a:
                starts[at], at = 1, ends[at]
            batches[a:b] = batch + np.cumsum(starts)
        return table.select([group, "id"]).append_column("batch", pa.array(batches))

    return placed.groupBy("block").applyInArrow(fold, f"`{group}` {kinds[group].dataType.simpleString()}, id {kinds['id'].dataType.simpleString()}, batch int")


BORDER = r"^(?:#{1,6} |(?:export |public |static |async )*(?:class|def|function|interface|struct|enum|func|fn) )"


def semantic_chunks(files: DataFrame, least_lines: int = 100) -> DataFrame:
    """(path, text) -> file_path, start_line, end_line: cut before the first border line after at least so many lines."""
    border = BORDER.replace("\\", "\\\\")
    starts = f"""aggregate(sequence(1, size(l)), array(1), (s, i) -> if(i - element_at(s, -1) >= {least_lines} and l[i - 1] rlike '{border}', concat(s, array(i)), s))"""
    cut = files.select("path", F.split("text", "\n").alias("l")).select("path", F.size("l").alias("n"), F.expr(starts).alias("s"))
    spans = F.expr("transform(s, (a, k) -> struct(a as start_line, if(k + 1 < size(s), s[k + 1] - 1, n) as end_line))")
    return cut.select(F.col("path").alias("file_path"), F.explode(spans).alias("x")).select("file_path", "x.*")
