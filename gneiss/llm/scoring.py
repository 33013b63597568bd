"""Language-model scoring of whole documents.

Counts, vocabulary, classes, the frequencies of rare words and the recurrent
weights come from all training documents. The weights are trained in parallel
from one start and averaged after each round; which trainer sees what in which
order depends on the documents alone, not on the cluster.

Each document is cut into words once and kept as network ids. Only the ``HEAD``
most frequent words are sent to every executor; the rest of a document's words
are joined with their counts by shuffle, so that nothing that grows with the
corpus is ever broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.llm.arrow import small_batches
from gneiss.llm.common import most_frequent, stored, table
from gneiss.llm.recurrent import END, TAIL, Network

#: Words that executors know by heart, and those of them that the network tells apart.
HEAD, NEURAL = 150_000, 1_000
#: Rounds that the training documents are dealt to, at most so many trainers, with about so many documents each.
ROUNDS, TRAINERS, DEALT = 2, 64, 2048
#: Tokens that a task gathers before it scores their documents together; bytes of words that it counts at once.
TOGETHER, _COUNTED = 1 << 21, 32 << 20
#: Documents cut at once; looking up their words costs a table of the head words each time.
_CUT = 1024
#: How network ids are kept.
_ID = "u2" if NEURAL + 2 <= 1 << 16 else "i4"
#: Bytes of a block of weights.
_BLOCK = 1 << 16
#: The end of a document among words; no word is empty.
END_WORD = b""


def is_held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased, then the end."""
    return [*(text or "").encode().lower().split(), END_WORD]


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """words_of all texts in a row, and where those of each begin, closed by their number."""
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    # A last space leaves an empty word behind it: the end.
    parts = pc.ascii_split_whitespace(pc.if_else(pc.equal(pc.binary_length(trimmed), 0), "", pc.binary_join_element_wise(trimmed, "", " ")))
    return parts.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy())]).astype("i8")


def token_counts(docs: DataFrame) -> DataFrame:
    """(text) -> (token, n) over all rows; the end is the empty token."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.Array] = []

        def flush() -> pa.RecordBatch:
            values, counts = pa.chunked_array(waiting, pa.string()).value_counts().flatten()
            waiting.clear()
            return pa.RecordBatch.from_arrays([values, counts], ["token", "n"])

        size = 0
        for whole in batches:
            for at in range(0, whole.num_rows, _CUT):
                waiting.append(cut(whole.column(0).slice(at, _CUT))[0])
                size += waiting[-1].nbytes
                if size > _COUNTED:
                    yield flush()
                    size = 0
        yield flush()

    small_batches(docs.sparkSession)
    return docs.select("text").mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


class Vocabulary:
    """The most frequent words and their counts: the first NEURAL have network ids, the rest are TAIL."""

    def __init__(self, head: list[tuple[str, int]], total: int, distinct: int):
        self.total, self.distinct = total, distinct
        self.count = {w.encode(): n for w, n in head}
        ranked = [w for w in self.count if w != END_WORD][:NEURAL]
        self.id = {w: i + 2 for i, w in enumerate(ranked)} | {END_WORD: END}
        known = sum(self.count[w] for w in ranked) + self.count.get(END_WORD, 0)
        #: Tail words share their class's probability by count plus one, unseen words being one more word.
        self.tail_total = total - known + distinct - len(ranked) - (END_WORD in self.count) + 1
        self.words = pa.array([w for w, _ in head], pa.string())
        #: By place among the head words: log10 of the count plus one, and the network's id.
        self.logs = np.log10(np.array([*self.count.values()], float) + 1)
        self.ids_of = np.array([self.id.get(w, TAIL) for w in self.count], "i4")
        self.neural_counts = np.array([self.count.get(END_WORD, 0), total - known, *(self.count[w] for w in ranked)], float)

    def encoded(self, words: pa.Array, starts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], pa.Array, np.ndarray, np.ndarray]:
        """What cut gives -> network ids; by text: how many are head words, the sum of log10 of their counts plus one, the share of
        it that TAIL has, and how many are TAIL; the other words, once for each text, how often each is in it, and where those of each text begin."""
        places = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy()
        # Other words have place -1, the last.
        all_ids, all_logs = np.append(self.ids_of, TAIL), np.append(self.logs, 0.0)
        ids, first = all_ids[places], starts[:-1]
        of_text = [np.add.reduceat(x, first) for x in ((places >= 0).astype("i8"), all_logs[places], np.where(all_ids == TAIL, all_logs, 0.0)[places], (ids == TAIL).astype("i8"))]
        at = np.flatnonzero(places < 0)
        others = words.take(pa.array(at)).dictionary_encode()
        distinct = max(1, len(others.dictionary))
        found, times = np.unique((np.searchsorted(starts, at, "right") - 1) * distinct + others.indices.to_numpy(), return_counts=True)
        return ids, of_text, others.dictionary.take(pa.array(found % distinct)), times, np.searchsorted(found // distinct, np.arange(len(starts)))


def vocabulary(counts: DataFrame) -> Vocabulary:
    total, distinct = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    head = most_frequent(counts, HEAD).collect()  # of a bounded size
    end = counts.where("token = ''").collect()
    ranked = sorted({x.token: x.n for x in [*head, *end]}.items(), key=lambda x: (-x[1], x[0]))
    return Vocabulary(ranked, total or 0, distinct)


def trainers_for(words: Vocabulary) -> int:
    """So many trainers as the training documents, which have an end each, ask for."""
    return max(1, min(TRAINERS, round(words.count.get(END_WORD, 0) / (ROUNDS * DEALT))))


_ENCODED = "rid long, doc_id long, held boolean, n_tokens long, n_known long, base double, tail_base double, tail long, ids binary, rest array<struct<token:string,n:long>>"


def encoded(docs: DataFrame, words: Vocabulary) -> DataFrame:
    """(doc_id, text) -> a row for each, with the ids of its words and what the head words tell; rest: the other words, by number."""
    sent, schema = docs.sparkSession.sparkContext.broadcast(words), T.StructType.fromDDL(_ENCODED)

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target, rid = to_arrow_schema(schema), TaskContext.get().partitionId() << 36
        kind = target.field("rest").type
        for whole in batches:
            for at in range(0, whole.num_rows, _CUT):
                batch = whole.slice(at, _CUT)
                words, starts = cut(batch.column("text"))
                ids, (known, base, tail_base, tail), rest, times, ends = sent.value.encoded(words, starts)
                ids = ids.astype(_ID)
                blobs = pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer((starts * ids.itemsize).astype("i4")), pa.py_buffer(ids)])
                entries = pa.StructArray.from_arrays([rest, pa.array(times, pa.int64())], fields=list(kind.value_type))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries, type=kind)
                rids = np.arange(rid + 1, rid + 1 + len(batch))
                rid += len(batch)
                arrays = [pa.array(rids), batch.column("doc_id"), batch.column("held"), *(pa.array(x) for x in (np.diff(starts), known, base, tail_base, tail)), blobs, lists]
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(arrays, target, strict=True)], schema=target)

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out(F.col("doc_id")).alias("held"), "text")
    return rows.mapInArrow(encode, schema)


def dealt(docs: DataFrame, k: int, trainers: int, column: str = "text") -> DataFrame:
    """A column of the docs (doc_id, column) of round k, a partition for each trainer, in an order by hash."""
    part = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS)) == k).select(column, F.xxhash64("doc_id", column).alias("deal"))
    return part.repartition(trainers, "deal").sortWithinPartitions("deal").select(column)


def trained(docs: DataFrame, words: Vocabulary) -> bytes:
    """The network's weights after ROUNDS of parallel training, which see each of docs (doc_id, text or ids) once."""
    spark = docs.sparkSession
    if "ids" not in docs.columns:
        docs = stored(encoded(docs, words).select("doc_id", "ids"), "ids")
    sent, weights = spark.sparkContext.broadcast(words.neural_counts), Network(words.neural_counts).blob()
    trainers = trainers_for(words)
    for k in range(ROUNDS):
        start = spark.sparkContext.broadcast(weights)

        def train(batches: Iterable[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            network, seen = Network(sent.value), 0
            network.load(start.value)

            def texts() -> Iterator[np.ndarray]:
                nonlocal seen
                for batch in batches:
                    for blob in batch.column(0).to_pylist():
                        ids = np.frombuffer(blob, _ID)
                        seen += len(ids)
                        yield ids

            network.train(texts())
            blob, trainer = network.blob(), TaskContext.get().partitionId()
            for block in range(0, len(blob) if seen else 0, _BLOCK):
                yield pa.RecordBatch.from_pydict({"block": [block], "trainer": [trainer], "seen": [seen], "weights": [blob[block : block + _BLOCK]]})

        parts = dealt(docs, k, trainers, "ids").mapInArrow(train, "block long, trainer long, seen long, weights binary")
        # Weights are averaged block by block where they are; the driver gets one network.
        got = parts.repartition("block").sortWithinPartitions("block", "trainer").mapInArrow(_averaged, "block long, weights binary").collect()
        weights = b"".join(x.weights for x in sorted(got, key=lambda x: x.block)) or weights
    return weights


def _averaged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, trainer, seen, weights) in order -> each block's weights, averaged by the tokens seen."""
    block, total, weighed = None, 0, np.zeros(0)

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"block": [block], "weights": [(weighed / total).astype("f4").tobytes()]})

    for batch in batches:
        for x in batch.to_pylist():
            if x["block"] != block:
                if block is not None:
                    yield done()
                block, total, weighed = x["block"], 0, 0.0
            total, weighed = total + x["seen"], weighed + np.frombuffer(x["weights"], "f4").astype("f8") * x["seen"]
    if block is not None:
        yield done()


def likelihoods(codes: DataFrame, words: Vocabulary, weights: bytes) -> DataFrame:
    """encoded rows -> rid and score, the network's log10 probability of the ids."""
    sent = codes.sparkSession.sparkContext.broadcast((words.neural_counts, weights))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Network(sent.value[0])
        network.load(sent.value[1])
        rids: list[int] = []
        texts: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"rid": pa.array(rids, pa.int64()), "score": pa.array(network.score(texts) / math.log(10), pa.float64())})
            rids.clear()
            texts.clear()
            return out

        waiting = 0
        for batch in batches:
            for rid, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rids.append(rid)
                texts.append(np.frombuffer(blob, _ID))
                waiting += len(texts[-1])
                if waiting > TOGETHER:
                    yield flush()
                    waiting = 0
        yield flush()

    small_batches(codes.sparkSession)
    return codes.select("rid", "ids").mapInArrow(score, "rid long, score double")


def scored(codes: DataFrame, counts: DataFrame, words: Vocabulary, weights: bytes) -> DataFrame:
    """encoded rows -> doc_id, held, n_tokens, n_known, base_score and score for each.

    A null text is empty and has its end only. Rows that repeat a doc_id are
    scored each for itself. Without training documents every token is unseen.
    """
    rest = codes.select("rid", F.inline("rest")).join(counts.select("token", F.col("n").alias("c")), "token")
    rest = rest.groupBy("rid").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("log"))
    per = codes.drop("ids", "rest").join(likelihoods(codes, words, weights), "rid").join(rest, "rid", "left")
    log = F.coalesce("log", F.lit(0.0))  # an unseen word has the logarithm of one
    base = F.col("base") + log - F.col("n_tokens") * math.log10(words.total + words.distinct + 1)
    # Rare and unseen words: the network's TAIL, times their share of it.
    score = F.col("score") + F.col("tail_base") + log - F.col("tail") * math.log10(words.tail_total)
    return per.select("doc_id", "held", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), base.alias("base_score"), score.alias("score"))


def op6_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scored for documents: nulls, repeats, long texts and empty tables as stated there."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = stored(token_counts(docs.where(~is_held_out(F.col("doc_id")))), "token-counts")
    words = vocabulary(counts)
    codes = stored(encoded(docs, words), "codes")
    found = scored(codes, counts, words, trained(codes.where("not held").select("doc_id", "ids"), words))
    return found.select("doc_id", F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(words.total).cast("long").alias("train_tokens"), "base_score", "score")
