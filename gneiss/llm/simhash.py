"""SimHash near-duplicates by tiled exact comparison with exclusive-or and bit counts.

Distinct fingerprints are laid out in tiles: the population counts of their 64
bits cut into blocks. Flipping a bit changes one block's count by one, so that
two fingerprints within the radius lie in tiles whose counts differ by no more
than the radius in all; other tile pairs are skipped. The rest are compared
exactly in numpy. A tile with many fingerprints is cut into chunks, and each
task compares one chunk with one part of its neighbourhood, so that no task
holds a tile however many copies crowd it. Only a spanning forest of the links
found in a task leaves it; components come from alternating star joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gneiss.llm.arrow import OUT, annotated
from gneiss.llm.common import counted, in_parts, set_aside, stored, table

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Fingerprints of a chunk, and of the part of its neighbourhood that it is compared with at once.
CHUNK, PART = 1024, 4096
#: Blocks for up to so many distinct fingerprints: more blocks, fewer comparisons, more places to send each one. All are exact.
BLOCKS = ((2_000_000, 4), (200_000_000, 8), (float("inf"), 16))


def hashes_of(text: str | None) -> list[int]:
    words = (text or "").encode().lower().split()  # lower-cases A-Z and splits at ASCII white space only
    if len(words) < SHINGLE:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    return [xxhash.xxh64_intdigest(b" ".join(x), SEED) for x in zip(words, words[1:], words[2:], strict=False)]


def fingerprints_of(texts: list[str | None]) -> list[tuple[int]]:
    """A signed 64-bit fingerprint of each text; zero without words."""
    out = []
    for text in texts:
        hashes = np.array(hashes_of(text), "<u8")
        ones = np.zeros(64, "i8")
        for at in range(0, len(hashes), 1 << 14):
            part = hashes[at : at + (1 << 14)]
            ones += np.unpackbits(part.view("u1").reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype="i4")
        out.append((int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0]),))
    return out


def fingerprints(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns keep of docs and __fp."""

    def start() -> Callable:
        return fingerprints_of

    return annotated(docs, keep, "text", "fp long", start).select(*keep, F.col(f"{OUT}.fp").alias("__fp"))


def _offsets(blocks: int, radius: int, width: int) -> list[int]:
    """Tile-key differences to all tiles within the radius that come after a tile, and to itself."""
    steps = [tuple(0 for _ in range(blocks))]
    seen = set(steps)
    for _ in range(radius):
        steps = [tuple(x + d * (i == k) for i, x in enumerate(s)) for s in steps for k, d in product(range(blocks), (1, -1))]
        seen.update(steps)
    return sorted(x for x in (sum(c << (width * i) for i, c in enumerate(s)) for s in seen) if x >= 0)


def _forest(home: np.ndarray, other: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one cell, reduced to a spanning forest: each linked fingerprint and the least one of its local group.

    Groups grow block by block, so that memory follows a block's links and not the cell's.
    """
    nodes, where = np.unique(np.concatenate([home, other]), return_inverse=True)
    least, h, o = np.arange(len(nodes)), where[: len(home)], where[len(home) :]
    for at in range(0, len(home), 64):
        i, j = np.nonzero(np.bitwise_count(home[at : at + 64, None] ^ other[None, :]) <= radius)
        i, j = h[at + i], o[j]
        while True:
            a, b = least[i], least[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(least, np.maximum(a, b), np.minimum(a, b))  # a root joins a smaller one
            while (least[least] != least).any():
                least = least[least]
    linked = least != np.arange(len(nodes))
    return nodes[linked], nodes[least[linked]]


def _cells(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (fp, tile, chunk, part, visits) in the order of their cells -> fp and visits of one cell after another."""
    rest = None
    for batch in batches:
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
        columns[0] = columns[0].view("u8")
        if rest is not None:
            columns = [np.concatenate(x) for x in zip(rest, columns, strict=True)]
        starts = 1 + np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in columns[1:4]])) if len(columns[0]) else np.zeros(0, int)
        at = 0
        for end in starts:
            yield columns[0][at:end], columns[4][at:end]
            at = end
        rest = [x[at:] for x in columns]
    if rest is not None and len(rest[0]):
        yield rest[0], rest[4]


def links(distinct: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """(fp) distinct, n of them -> edges (a, b) whose components are those of all links within the radius."""
    blocks = next(b for most, b in BLOCKS if n <= most)
    size, width = 64 // blocks, 3 if blocks == 16 else 5
    count = lambda k: F.bit_count(F.shiftrightunsigned("fp", k * size).bitwiseAND(F.lit((1 << size) - 1))).cast("long")
    tile: Column = sum((F.shiftleft(count(k), width * k) for k in range(1, blocks)), count(0))
    tiled = in_parts(distinct, n).select("fp", tile.alias("tile"))
    offsets = F.array(*[F.lit(x).cast("long") for x in _offsets(blocks, radius, width)])
    around = F.explode(F.transform(offsets, lambda x: F.col("tile") - x)).alias("tile")
    homes = tiled.groupBy("tile").agg(F.count(F.lit(1)).alias("n"))
    loads = homes.select(around, "n").groupBy("tile").agg(F.sum("n").alias("load"))
    # A tile that only its one fingerprint visits has no links.
    shares = homes.join(loads, "tile").where("load > 1").select("tile", F.ceil(F.col("n") / CHUNK).alias("chunks"), F.ceil(F.col("load") / PART).alias("parts"))
    homes, seen = counted(shares, "tiles")
    homes = in_parts(homes, seen["n"])
    spread = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.col(k) - 1))
    home = tiled.join(homes, "tile").select("fp", "tile", F.pmod(F.xxhash64("fp"), "chunks").alias("chunk"), spread("parts").alias("part"), F.lit(False).alias("visits"))
    visit = tiled.select("fp", around).join(homes, "tile")
    visit = visit.select("fp", "tile", spread("chunks").alias("chunk"), F.pmod(F.xxhash64("fp", F.lit(1)), "parts").alias("part"), F.lit(True).alias("visits"))
    cell = ["tile", "chunk", "part"]

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for prints, visits in _cells(batches):
            a, b = _forest(prints[~visits], prints[visits], radius)
            if len(a):
                yield pa.RecordBatch.from_pydict({"a": a.view("i8"), "b": b.view("i8")})

    return home.unionByName(visit).repartition(*cell).sortWithinPartitions(*cell).mapInArrow(compare, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) -> (a, b) with b the least node of a's component, for every node but that one.

    Alternates the large-star and small-star steps until nothing changes; each
    round is written to the shared folder. The number of rounds grows with the
    logarithm of the longest chain. A node's least neighbour is aggregated
    before it is joined, and Spark splits the joins of nodes with many.
    """

    def starred(pairs: DataFrame) -> DataFrame:
        least = pairs.groupBy("a").agg(F.min("b").alias("m"))
        return pairs.join(least.select("a", F.least("a", "m").alias("m")), "a")

    def pairs_of(*pairs: tuple[Column | str, Column | str]) -> Column:
        return F.inline(F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in pairs]))

    same = F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("same")
    edges, state = counted(edges.select("a", "b").where("a <> b"), "links", same)
    last = None
    while state["n"] and state != last:
        last = state
        large = starred(in_parts(edges, state["n"]).select(pairs_of(("a", "b"), ("b", "a")))).where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = starred(large).select(pairs_of(("b", "m"), ("a", "m")))
        edges, state = counted(small.where("a <> b").distinct(), "links", same)
    return edges


def rooted(prints: DataFrame) -> DataFrame:
    """(doc_id, __fp) -> fp, least doc_id, and root, which is the same for all fingerprints of a component."""
    distinct, seen = counted(prints.groupBy(F.col("__fp").alias("fp")).agg(F.min("doc_id").alias("least")), "fingerprints")
    stars, found = counted(components(links(distinct.select("fp"), seen["n"])), "stars")
    joined = in_parts(distinct, seen["n"]).join(in_parts(stars, found["n"]).withColumnRenamed("a", "fp"), "fp", "left")
    rows, _ = counted(joined.select("fp", "least", F.coalesce("b", "fp").alias("root")), "roots")
    return in_parts(rows, seen["n"])


def keepers(roots: DataFrame) -> DataFrame:
    """root, its component's smallest doc_id, and the fingerprint of that document; null ids come last."""
    best = roots.groupBy("root").agg(F.min(F.struct(F.col("least").isNull(), "least", "fp")).alias("best"))
    return best.select("root", F.col("best.fp").alias("keeper"), F.col("best.least").alias("component_id"))


def grouped(prints: DataFrame) -> DataFrame:
    """(doc_id, __fp) -> (fp, keeper, component_id) for each distinct fingerprint; see keepers."""
    roots = rooted(prints)
    return roots.join(keepers(roots), "root").select("fp", "keeper", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, fingerprint (hexadecimal) and component_id for each row.

    component_id is the smallest doc_id of all documents reachable by links.
    Null and empty texts have fingerprint zero and link like any other. Repeated
    rows share a fingerprint. Null doc_ids never are the smallest; a group of
    nothing else has a null component_id. An empty table gives an empty result.
    """
    prints = stored(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"]), "prints")
    out = prints.join(grouped(prints).withColumnRenamed("fp", "__fp"), "__fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("__fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near-duplicates: that of the smallest doc_id. All columns of docs.

    Of rows that share that doc_id, the one whose fingerprint is least stays, of
    equal rows one. A group whose doc_ids all are null keeps one row. Null and
    empty texts are one group. An empty table gives an empty result.
    """
    key = [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key")]
    prints = stored(fingerprints(docs.select(*key, "text"), ["doc_id", "key"]), "prints")
    best = keepers(rooted(prints)).select(F.col("keeper").alias("__fp"), "component_id")
    # Texts of one id and fingerprint: the least key.
    chosen = prints.join(best, "__fp").where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("__fp", "doc_id").agg(F.min("key").alias("key")).select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"))
    rows, own, back = set_aside(docs)
    doc_id, text = (F.col(own[docs.columns.index(c)]) for c in ("doc_id", "text"))
    kept = rows.join(chosen, doc_id.cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__key")))
    first = F.row_number().over(W.partitionBy("__id", "__key").orderBy(*own))
    return kept.withColumn("__n", first).where("__n = 1").select(*back)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates of documents: nulls, ties, repeats, long texts and empty tables as stated there."""
    return near_duplicates(table(spark, sf_dir, "documents"))
