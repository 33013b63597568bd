"""Language identification by words first, with back-off to shorter character n-grams.

A word seen in training scores by its log frequency in each language. An unseen
word scores by its longest character n-grams that training knows: the mean over
its known 5-grams, else 4-grams, and so on to single characters.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gneiss.llm.arrow import OUT, annotated, small_batches
from gneiss.llm.common import is_frequent, set_aside, stored, table

#: Training documents of each language at most (those with the lowest hashes); words of each language, and n-grams of each language and length, that the tables take.
DOCS_PER_LANGUAGE, WORDS, GRAMS, LONGEST = 4_000, 100_000, 40_000, 5
#: Words after which more evidence no longer raises the score.
EVIDENCE_WORDS, UNKNOWN = 20, "und"
#: Learned words that one task holds before it hands counts on, and unseen words that a worker remembers.
_FLUSH, _CACHE = 50_000, 65_536
_WORDS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters."""
    return [x for x in _WORDS.findall((text or "").lower()) if x.isalpha() or any(map(str.isalpha, x))]


def grams_of(word: str, n: int) -> list[str]:
    padded = f" {word} " if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def is_held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def word_counts(docs: DataFrame) -> DataFrame:
    """(text, lang) -> (lang, word, n)."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def flush() -> pa.RecordBatch:
            rows = [(lang, word, n) for lang, c in counts.items() for word, n in c.items()]
            counts.clear()
            lang, word, n = zip(*rows, strict=True) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(word, pa.string()), pa.array(n, pa.int64())], ["lang", "word", "n"])

        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.setdefault(lang, Counter()).update(words_of(text))
                if sum(map(len, counts.values())) > _FLUSH:
                    yield flush()
        yield flush()

    small_batches(docs.sparkSession)
    return docs.select("text", "lang").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Model:
    """Per-language log frequencies of words and character n-grams. Its size is bounded by the table sizes above for each language."""

    def __init__(self, languages: list[str], tables: list[tuple[list[str], np.ndarray]]):
        """tables: keys, and their counts in each language in order; words first, then n-grams by length."""
        self.languages = sorted(languages)
        self.words, *self.grams = (self._table(*x) for x in tables)

    @staticmethod
    def _table(keys: list[str], n: np.ndarray) -> tuple[dict[str, int], np.ndarray]:
        return {key: i for i, key in enumerate(keys)}, np.log((n + 0.1) / (n.sum(0) + 0.1 * (len(keys) + 1))).astype("f4")

    def unseen(self, word: str) -> np.ndarray:
        for n in range(LONGEST, 0, -1):
            keys, logs = self.grams[n - 1]
            if known := [keys[x] for x in grams_of(word, n) if x in keys]:
                return logs[known].mean(0)
        return np.zeros(len(self.languages), "f4")


class Scorer:
    """Predictions by one task; the evidence of the unseen words met last is remembered."""

    def __init__(self, model: Model):
        self.model, self.places = model, {}
        self.evidence = np.zeros((0, len(model.languages)), "f4")

    def _unseen(self, words: list[str]) -> np.ndarray:
        """The summed evidence of unseen words; what is remembered bounds memory and changes no result."""
        fresh = [x for x in dict.fromkeys(words) if x not in self.places]
        if len(self.places) + len(fresh) > _CACHE:
            self.places, fresh = {}, list(dict.fromkeys(words))
        if fresh:
            new = len(self.places) + len(fresh)
            if new > len(self.evidence):
                self.evidence = np.concatenate([self.evidence, np.zeros((max(new, len(self.evidence)), self.evidence.shape[1]), "f4")])
            for x in fresh:
                self.evidence[len(self.places)] = self.model.unseen(x)
                self.places[x] = len(self.places)
        return self.evidence[[self.places[x] for x in words]].sum(0, dtype="f8")

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and its score: the softmax of the mean evidence of a word, times at most EVIDENCE_WORDS."""
        words, languages = words_of(text), self.model.languages
        if not words or not languages:
            return UNKNOWN, 0.0
        keys, logs = self.model.words
        places = [keys.get(x, -1) for x in words]
        total = logs[[i for i in places if i >= 0]].sum(0, dtype="f8")
        if unseen := [x for x, i in zip(words, places, strict=True) if i < 0]:
            total = total + self._unseen(unseen)
        total = total / len(words) * min(len(words), EVIDENCE_WORDS)
        best = int(total.argmax())
        return languages[best], float(1 / np.exp(total - total[best]).sum())


def sample_bounds(hashed: DataFrame, most: int) -> dict[str, tuple[int, int]]:
    """(lang, h) -> for each language the most-th least h, or the greatest if there are fewer, and how many rows there are up to it.

    A histogram of the hashes finds the step that holds the bound; only that
    step's rows, a few of all, are ranked. Languages are few.
    """
    step = F.shiftright("h", 48)
    counts = hashed.groupBy("lang", step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.max("h").alias("h"))
    upto = counts.withColumn("upto", F.sum("n").over(W.partitionBy("lang").orderBy("step")))  # at most 65,536 steps
    total = {x.lang: (x.h, x.n) for x in counts.groupBy("lang").agg(F.max("h").alias("h"), F.sum("n").alias("n")).collect()}
    full = {x.lang: (x.step, most - x.before) for x in upto.where(F.col("upto") >= most).groupBy("lang").agg(F.min("step").alias("step"), F.min(F.col("upto") - F.col("n")).alias("before")).collect()}
    if not full:
        return total
    place = F.create_map(*[y for lang, x in full.items() for y in (F.lit(lang), F.struct(F.lit(x[0]).cast("long").alias("step"), F.lit(x[1]).cast("long").alias("k")))])[F.col("lang")]
    some = hashed.select("lang", "h", place.alias("p")).where(step == F.col("p.step"))
    ranked = some.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("h"))).where(F.col("k") == F.col("p.k"))
    return total | {x.lang: (x.h, most) for x in ranked.select("lang", "h").collect()}


def train(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> Model:
    """A model from (doc_id, text, lang). Rows without language, text or letters teach nothing.

    The docs_per_language documents of a language with the least hashes of id
    and text are read: the model is a classifier fitted on a bounded sample.
    Copies of the last one, which share its hash, are read too. The result
    doesn't depend on the order of rows; an empty table teaches nothing.
    """
    hashed = docs.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    last = sample_bounds(stored(hashed.select("lang", "h"), "language-hashes"), docs_per_language)
    if not last:
        return Model([], [([], np.zeros((0, 0))) for _ in range(LONGEST + 1)])
    bound = F.element_at(F.create_map(*[F.lit(y) for lang, (h, _) in last.items() for y in (lang, h)]), F.col("lang"))
    counts = stored(word_counts(hashed.where(F.col("h") <= bound)), "language-words")
    # Words (k = 0) and n-grams are counted, ranked and fetched together.
    keys = F.expr(
        f"concat(array(struct(0 as k, word as key)), flatten(transform(sequence(1, {LONGEST}), k -> transform(sequence(1, greatest(length(if(k > 1, concat(' ', word, ' '), word)) - k + 1, 0)),"
        " i -> struct(k as k, substring(if(k > 1, concat(' ', word, ' '), word), i, k) as key)))))"
    )
    entries = counts.select("lang", "n", F.inline(keys)).where("k = 0 or length(key) = k").groupBy("lang", "k", "key").agg(F.sum("n").alias("n"))
    # What occurs once is noise in a drawn sample, but may be all there is of a small language.
    small = [lang for lang, (_, n) in last.items() if n < docs_per_language]
    entries = stored(entries.where((F.col("k") > 0) | (F.col("n") > 1) | F.col("lang").isin(small)), "language-entries")
    often = is_frequent(entries, ["lang", "k"], lambda key: WORDS if key[1] == 0 else GRAMS)
    languages = sorted(last)
    by = F.map_from_entries(F.collect_list(F.struct("lang", "n")))
    tables = entries.groupBy("k", "key").agg(by.alias("by"), F.bool_or(often).alias("often")).where("often")
    counts_of = F.transform(F.array(*[F.lit(x) for x in languages]), lambda x: F.coalesce(F.col("by")[x], F.lit(0)))
    # At most WORDS and GRAMS rows for each language, as columns: few bytes each.
    found = tables.select("k", "key", counts_of.alias("n")).toArrow().combine_chunks()
    k = found.column("k").to_numpy()
    n = found.column("n").combine_chunks().flatten().to_numpy().reshape(-1, len(languages))
    parts = []
    for i in range(LONGEST + 1):
        rows = np.flatnonzero(k == i)
        keys = found.column("key").take(rows).to_pylist()
        order = sorted(range(len(keys)), key=keys.__getitem__)
        parts.append(([keys[j] for j in order], n[rows[order]].astype("f4")))
    return Model(languages, parts)


def identified(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The columns keep of docs and a struct OUT with lang_pred and score, from the text alone.

    A null text, and one without a letter, is ``und`` with score 0, and so is
    every text where nothing was learned. Of equally likely languages the first
    by code point is taken; repeated rows are predicted each for itself. An empty table gives
    an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def start() -> Callable:
        predict = Scorer(sent.value).predict
        return lambda texts: map(predict, texts)

    return annotated(docs, keep, text, "lang_pred string, score double", start)


def with_known_language(docs: DataFrame, least_score: float = 0.5) -> DataFrame:
    """docs whose text has a language that the model finds likelier than all others together; all columns of docs.

    Texts without a letter go, null ones too. Where no row has a language nothing can be learned, and nothing is rejected
    but those texts. Repeated rows stay or go together; an empty table gives an empty result.
    """
    model = train(docs.where(~is_held_out(F.col("doc_id"))))
    if not model.languages:
        return docs.where(F.regexp_like("text", F.lit(r"\p{L}")))
    rows, own, back = set_aside(docs)
    sure = (F.col(f"{OUT}.lang_pred") != UNKNOWN) & (F.col(f"{OUT}.score") >= least_score)
    return identified(rows, model, own, own[docs.columns.index("text")]).where(sure).select(*back)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """identified for documents: nulls, ties, repeats, long texts and empty tables as stated there and in train."""
    docs = table(spark, sf_dir, "documents")
    found = identified(docs, train(docs.where(~is_held_out(F.col("doc_id")))), ["doc_id"])
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), f"{OUT}.lang_pred", f"{OUT}.score")
