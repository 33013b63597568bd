"""Mixing sources to target weights by pivotal dependent rounding. DataFrame functions only.

A document's expected copies are its source's target over its source's size.
The whole part is fixed; the fractional parts are rounded by pivotal sampling:
two documents meet, words move at random from one to the other (a martingale,
so each keeps its expectation) until one of them is integral, and the other
goes on. The sum of words is kept in each meeting, so that a source misses its
target by the last residual document at most.

Meetings happen in a reduction tree: a source's documents are dealt by hash to
blocks of about ``FAN_IN``; each block is folded to one residual, and the
residuals of FAN_IN blocks meet one level up. No task ever holds a source.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gneiss.llm.common import let, set_aside, stored, table, word_count

WEIGHTS, SHARE, CAP = (5.0, 2.0, 1.0), 1.5, 2.0
FAN_IN, SEED = 64, 42
_EPS = 1e-12
_ITEM = "struct<size:bigint,doc_id:bigint,idx:int,p:double>"


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, size) rows -> (source, source_size, target), one row for each source.

    The budget is share times all sizes. Sources in code-point order, null
    last, take weights in turn. A target stops at cap times the source's size;
    what is over is shared again by weight. That is water filling: in the order
    of cap over weight, the first sources are full and the others stand at one
    level, so that it takes a window over the sources and no iteration.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"), F.sum((F.col("size") > 0).cast("long")).alias("n_items"))
    pos = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(pos, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    order = W.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    every = W.partitionBy(F.lit(1))
    before = F.sum("most").over(order.rowsBetween(W.unboundedPreceding, -1))
    after = F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    level = (F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(before, F.lit(0.0))) / after
    per = per.withColumn("level", level)
    rest = F.max(F.when(F.col("level") * F.col("weight") < F.col("most"), F.col("level"))).over(every)
    return per.withColumn("target", F.least(F.col("most"), F.coalesce(rest * F.col("weight"), F.col("most")))).select("source", "source_size", "n_items", "target")


def _uniform(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the columns and the seed only, so that reruns agree."""
    return F.pmod(F.xxhash64(*cols, F.lit(SEED)), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _integral(p: Column) -> Column:
    return (p <= _EPS) | (p >= 1 - _EPS)


def _item(x: Column, p: Column | None = None) -> Column:
    return F.struct(x["size"].alias("size"), x.doc_id.alias("doc_id"), x.idx.alias("idx"), (x.p if p is None else p).alias("p"))


def _meet(state: Column, x: Column) -> Column:
    """The fold's step: the block's residual meets x; the one that is integral then leaves."""
    cur = state.cur
    move = F.struct(F.least(cur.p * cur["size"], (1 - x.p) * x["size"]).alias("a"), F.least((1 - cur.p) * cur["size"], x.p * x["size"]).alias("b"))

    def moved(m: Column) -> Column:
        give = _uniform(cur.doc_id, cur.idx, x.doc_id, x.idx) < m.b / (m.a + m.b)
        return F.struct((cur.p + F.when(give, -m.a).otherwise(m.b) / cur["size"]).alias("p"), (x.p + F.when(give, m.a).otherwise(-m.b) / x["size"]).alias("q"))

    def met(m: Column) -> Column:
        out = F.when(_integral(m.p), _item(cur, m.p)).otherwise(_item(x, m.q))
        go_on = F.when(_integral(m.p), _item(x, m.q)).otherwise(_item(cur, m.p))
        return F.struct(F.concat(state.done, F.array(out)).alias("done"), go_on.alias("cur"))

    pair = let(let(move, moved), met)
    first = F.struct(state.done.alias("done"), _item(x).alias("cur"))
    leave = F.struct(F.concat(state.done, F.array(_item(cur))).alias("done"), _item(x).alias("cur"))
    kind = f"struct<done:array<{_ITEM}>,cur:{_ITEM}>"
    return F.when(cur.isNull(), first.cast(kind)).when(_integral(cur.p), leave.cast(kind)).otherwise(pair.cast(kind))


def _fold(blocks: DataFrame) -> DataFrame:
    """Rows (source, block, doc_id, idx, size, p) -> one row for each block: what was decided, and the residual. Large documents meet first, which keeps residuals small."""
    init = F.struct(F.array().cast(f"array<{_ITEM}>").alias("done"), F.lit(None).cast(_ITEM).alias("cur"))
    items = blocks.groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct("size", "doc_id", "idx", "p")), asc=False).alias("items"))
    return items.select("source", "block", F.aggregate("items", init, _meet).alias("s")).select("source", "block", "s.done", "s.cur")


def mix(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(doc_id, source, size) -> the same rows with source_size, target and copies (0 up to the cap's ceiling).

    Repeated rows are told apart by a running number and drawn each for itself.
    Null doc_ids count as one more id, null sources as one more source. A
    document without words takes the whole part of its source's ratio. An
    empty table gives an empty result.
    """
    sizes = sizes.select("doc_id", "source", "size")
    per = stored(source_targets(sizes, weights, share, cap), "mix-sources")
    items = sizes.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).cast("int").alias("n"))
    items = items.select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("idx"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    items = items.join(per.withColumnRenamed("source", "src"), F.col("source").eqNullSafe(F.col("src")), "left").drop("src").withColumn("ratio", ratio)
    # A ratio a rounding error below a whole number counts as that number.
    items = items.withColumn("base", F.floor(F.col("ratio") + _EPS)).withColumn("p", F.greatest(F.col("ratio") - F.col("base"), F.lit(0.0)))
    block = F.pmod(F.xxhash64("doc_id", "idx", F.lit(SEED)), F.ceil(F.col("n_items") / FAN_IN))
    items = stored(items.withColumn("block", F.when((F.col("size") > 0) & ~_integral(F.col("p")), block)), "mix-items")
    decided = [items.where("block is null").select("doc_id", "source", "size", F.lit(0).alias("up"))]
    level = items.where("block is not null").select("source", "block", "doc_id", "idx", "size", "p")
    most = per.agg(F.max(F.ceil(F.col("n_items") / FAN_IN)).alias("n")).first()["n"] or 1
    while True:
        folded = stored(_fold(level), "mix-level")
        done = folded.select("source", F.explode("done").alias("x"))
        decided.append(done.select("x.doc_id", "source", "x.size", F.round("x.p").cast("int").alias("up")))
        level = folded.select("source", F.floor(F.col("block") / FAN_IN).alias("block"), "cur.doc_id", "cur.idx", "cur.size", "cur.p")
        if most <= 1:
            break
        most = -(-most // FAN_IN)
    last = level.select("doc_id", "source", "size", (_uniform(F.col("doc_id"), F.col("idx"), F.lit("last")) < F.col("p")).cast("int").alias("up"))
    rows = reduce(DataFrame.unionByName, [*decided, last])
    rows = rows.join(per.withColumnRenamed("source", "src"), F.col("source").eqNullSafe(F.col("src")), "left").drop("src", "n_items")
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + _EPS)).otherwise(0)
    return rows.withColumn("copies", (base + F.col("up")).cast("long")).drop("up")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """Documents, each as often as the mix takes it, with the columns of docs.

    Rows of one id, source and size share their copies: by text, then by the
    other columns, the first ones take one more. Nulls, ties and empty tables
    as in mix.
    """
    rows, own, back = set_aside(docs, "doc_id", "source", "text")
    sizes = rows.select(*own, F.struct(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size")).alias("__key"), F.xxhash64("text").alias("__text"))
    got = mix(sizes.select("__key.doc_id", "__key.source", "__key.size"), **options)
    got = got.groupBy(F.struct("doc_id", "source", "size").alias("__key")).agg(F.sum("copies").alias("__copies"), F.count(F.lit(1)).alias("__n"))
    out = sizes.join(got, "__key").withColumn("__row", F.row_number().over(W.partitionBy("__key").orderBy("__text", *own)))
    times = F.floor(F.col("__copies") / F.col("__n")) + (F.col("__row") <= F.col("__copies") % F.col("__n")).cast("long")
    out = out.withColumn("__times", times).where("__times > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times"))))
    return out.select(*back)


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mix of documents: nulls, ties, repeats, long texts and empty tables as stated there."""
    docs = table(spark, sf_dir, "documents")
    sizes = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    return mix(sizes).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
