"""Benchmark decontamination with one Aho-Corasick automaton over the benchmark's word windows.

Words are lower-cased (A-Z) runs of digits, letters a-z and anything beyond
ASCII, which in UTF-8 are byte runs of ``[0-9a-z\\x80-\\xff]``. Every word of
the benchmark has a code, a character; a text is the string of its words'
codes, and the automaton scans that string once. Position k of the string is
the k-th word, so that hits map back to places in the original text.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm.arrow import OUT, annotated
from gneiss.llm.common import set_aside, stored, table

WINDOW, HIT_SHARE = 13, 20
#: Benchmark text, in bytes, of one automaton. A larger benchmark takes several, each with a pass over the texts.
AUTOMATON_BYTES = 4 << 20
#: Words that one character tells apart; more take two, the first from the lower and the second from the upper half.
CODES = 0x8_0000
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
_FIELDS = "n_words long, hits array<int>, items array<string>, spans array<struct<start:int,end:int>>"


def words_of(text: str | None) -> list[bytes]:
    return _WORDS.findall((text or "").encode().lower())


class Automaton:
    """The windows of (item_id, text) rows, and the scan for them."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW, codes: int = CODES):
        import ahocorasick

        texts = [(None if item_id is None else str(item_id), words_of(text)) for item_id, text in items]
        known = dict.fromkeys(x for _, words in texts for x in words)
        self.width = 1 if len(known) < codes else 2
        self.codes: dict[bytes, str] = {x: self._code(k, codes) for k, x in enumerate(known, 1)}
        self.unknown = self._code(0, codes)
        self.items: list[str | None] = [item_id for item_id, _ in texts]
        found: dict[str, set[int]] = {}
        for k, (_, words) in enumerate(texts):
            for at in range(max(1, len(words) - window + 1) if words else 0):
                found.setdefault("".join([self.codes[x] for x in words[at : at + window]]), set()).add(k)
        self.tree = ahocorasick.Automaton()
        for key, ids in found.items():
            self.tree.add_word(key, (len(key) // self.width, tuple(ids)))
        if found:
            self.tree.make_automaton()
        self.empty = not found

    def _code(self, k: int, codes: int) -> str:
        """Word number k as width characters: a match of whole codes can't start or end within one."""
        char = lambda x: chr(x + 1 if x + 1 < 0xD800 else x + 0x801)
        return char(k) if self.width == 1 else char(k // codes) + char(codes + k % codes)

    def scan(self, text: str | None) -> tuple[int, list[int], list[str | None], list[tuple[int, int]]]:
        """Words of the text; positions of hit words; items with an occurring window; hit runs as code-point spans."""
        words = words_of(text)
        get, unknown = self.codes.get, self.unknown
        coded = "".join([get(x, unknown) for x in words])
        hit, items = bytearray(len(words)), set()
        if not self.empty and coded.count(unknown) < len(words):
            for last, (length, ids) in self.tree.iter(coded):
                end = last // self.width
                hit[end + 1 - length : end + 1] = b"\1" * length
                items.update(ids)
        if not items:
            return len(words), [], [], []
        raw = text.encode().lower()
        places = [m.span() for m in _WORDS.finditer(raw)]
        spans = []
        for run in re.finditer(b"\1+", hit):
            a, b = places[run.start()][0], places[run.end() - 1][1]
            start = len(raw[:a].decode())
            spans.append((start, start + len(raw[a:b].decode())))
        return len(words), [i for i, x in enumerate(hit) if x], sorted({self.items[i] for i in items}, key=lambda x: (x is None, x)), spans


def _shards(benchmark: DataFrame) -> list[list[tuple[object, str | None]]]:
    """The benchmark in parts of a bounded size, each for one automaton."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = total // AUTOMATON_BYTES + 1
    if n == 1:
        return [[tuple(x) for x in rows.collect()]]
    rows = stored(rows.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))), "benchmark")
    return [[tuple(x) for x in rows.where(F.col("part") == k).select("item_id", "text").collect()] for k in range(n)]


def contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str], window: int = WINDOW) -> DataFrame:
    """The columns keep of docs and a struct OUT: n_words, n_hit, n_items, items, spans, contaminated.

    Null and empty texts have no words and are clean; items without words match
    nothing; items with the same id count once, and those without id as one,
    whose id is null. Repeated documents are scanned each for itself. Spans are
    runs of hit words in code points of the original text. Empty tables give an
    empty result, or clean documents.
    """
    spark = docs.sparkSession
    shards = _shards(benchmark)

    def scanned(rows: DataFrame, columns: list[str], shard: list) -> DataFrame:
        sent = spark.sparkContext.broadcast(shard)

        def start() -> Callable:
            automaton = Automaton(sent.value, window)
            return lambda texts: [automaton.scan(x) for x in texts]

        return annotated(rows, columns, "text", _FIELDS, start)

    own = [f"__{i}" for i in range(len(keep))]  # free of clashes
    place = dict(zip(keep, own, strict=True))
    rows = docs.select(*[F.col(c).alias(x) for c, x in place.items()], "text")
    if len(shards) == 1:
        found = scanned(rows, own, shards[0]).select(*own, f"{OUT}.*")
    else:
        # Texts are written once; a pass over them for each automaton returns the few documents with hits.
        rows = stored(rows.withColumn("__row", F.monotonically_increasing_id()), "scan")
        first = scanned(rows, ["__row"], [])
        hits = reduce(DataFrame.union, [scanned(rows, ["__row"], x).where(F.size(f"{OUT}.hits") > 0).select("__row", f"{OUT}.*") for x in shards])
        joined = lambda name: F.array_distinct(F.flatten(F.collect_list(name))).alias(name)
        hits = hits.groupBy("__row").agg(joined("hits"), joined("items"), joined("spans"))
        none = lambda name, kind: F.coalesce(name, F.array().cast(kind)).alias(name)
        found = rows.drop("text").join(first.select("__row", f"{OUT}.n_words"), "__row").join(hits, "__row", "left")
        found = found.select(*own, "n_words", none("hits", "array<int>"), none("items", "array<string>"), none("spans", "array<struct<start:int,end:int>>"))
    n_hit, n_words = F.size("hits").cast("long"), F.col("n_words")
    out = F.struct(
        n_words, n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sort_array("items").alias("items"), _merged("spans").alias("spans"),
        ((n_hit > 0) & (HIT_SHARE * n_hit >= n_words)).alias("contaminated"),
    )
    return found.select(*[F.col(x).alias(c) for c, x in place.items()], out.alias(OUT))


def _merged(spans: str) -> F.Column:
    """Spans by start, overlapping ones of several automata as one."""
    return F.expr(f"""aggregate(array_sort({spans}), cast(array() as array<struct<start:int,end:int>>), (m, x) ->
        if(size(m) > 0 and element_at(m, -1).end >= x.start, concat(slice(m, 1, size(m) - 1), array(struct(element_at(m, -1).start as start, greatest(element_at(m, -1).end, x.end) as end))), concat(m, array(x))))""")


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that the benchmark contaminates; all columns of docs. Nulls, repeats and empty tables as in contamination."""
    rows, own, back = set_aside(docs, "text")
    return contamination(rows, benchmark, own).where(~F.col(f"{OUT}.contaminated")).select(*back)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contamination of documents by benchmark; items_sha256 lists the ids that aren't null."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    digest = F.sha2(F.array_join(f"{OUT}.items", ","), 256).alias("items_sha256")
    return found.select("doc_id", f"{OUT}.n_words", f"{OUT}.n_hit", f"{OUT}.n_items", digest, f"{OUT}.contaminated")


_W = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
ORACLE_SQL = f"""
WITH b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, {_W.format("text")} AS w FROM benchmark WHERE text IS NOT NULL
), bw AS (
  SELECT DISTINCT item_id, len(g) AS k, array_to_string(g, ' ') AS g FROM (
    SELECT item_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 13 THEN [w]
      ELSE list_transform(range(1, len(w) - 11), lambda i: list_slice(w, i, i + 12)) END) AS g FROM b)
), d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, {_W.format("coalesce(text, '')")} AS w FROM documents
), dw AS (
  SELECT r, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)
), hit AS (
  SELECT r, i, dw.k, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.k = bw.k
), words AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT r, i, k FROM hit)) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
