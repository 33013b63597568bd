"""Candidate scores, fusion, re-ranking and vector search."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions import scalar as S
from gneiss.operators.relational import best_per_key, top

#: What a search of a kind adds to a candidate. Fixed values.
SOURCE_SCORES = {"symbol": 0.34, "regex": 0.24, "graph": 0.22, "vector": 0.18, "chunk": 0.18}


#: Queries that are sent to all tasks at once.
QUERIES_AT_ONCE = 10_000
#: Chunks that the similarity self-join compares at once, the blocks they are dealt to, and the most of a block.
BLOCK, BLOCKS, LARGEST = 2_000, 32, 65_536


def fuse(frames: Sequence[DataFrame]) -> DataFrame:
    """Candidates (id, file_path, base, source) of several searches as one row for each id: best base, all sources."""
    every = reduce(DataFrame.unionByName, frames)
    return every.groupBy("id").agg(F.min("file_path").alias("file_path"), F.max("base").alias("base"), F.sort_array(F.collect_set("source")).alias("sources"))


def source_score(sources: Column, most: float = 0.75) -> Column:
    table = F.create_map(*[F.lit(x) for pair in SOURCE_SCORES.items() for x in pair])
    return F.least(F.aggregate(sources, F.lit(0.0), lambda t, x: t + F.coalesce(table[F.substring_index(x, "_", 1)], F.lit(0.0))), F.lit(most))


def overlap_score(a: Column, b: Column, each: float = 0.12, most: float = 0.6) -> Column:
    """Shared tokens of two arrays."""
    return F.least(F.size(F.array_intersect(a, b)) * each, F.lit(most))


def path_score(path: Column, query_tokens: Sequence[str]) -> Column:
    """Overlap of path and query; tests and infrastructure count less."""
    overlap = overlap_score(S.tokens(path), F.array(*[F.lit(x) for x in query_tokens]))
    return overlap + F.when(S.is_test_path(path), -0.1).otherwise(0.0) + F.when(F.lower(path).rlike("(^|/)(infra|deploy|scripts|tools)/"), -0.35).otherwise(0.0)


def confidence_label(score: Column) -> Column:
    return F.when(score >= 0.9, "high").when(score >= 0.72, "medium").otherwise("low")


def final_score(fused: DataFrame, query: str, content: str | None = None) -> DataFrame:
    """fused with score: base, sources, path and content together, to four decimals, and a confidence label."""
    words = [x for x in "".join(c if c.isalnum() else " " for c in query.lower()).split()]
    terms = F.array(*[F.lit(x) for x in words])
    score = F.col("base") + source_score(F.col("sources")) + path_score(F.col("file_path"), words)
    if content:
        score = score + overlap_score(S.tokens(F.col(content)), terms, 0.08, 0.4)
    score = F.round(score, 4)
    return fused.withColumn("score", score).withColumn("confidence", confidence_label(F.col("score")))


def knn(queries: DataFrame, base: DataFrame, k: int, least: float = -1.0, rounding: int = 6) -> DataFrame:
    """(id, vector) queries against all of base: the k nearest by cosine, in blocks of a stated query set.

    A block of about QUERIES_AT_ONCE queries is sent to all tasks, so that what
    is sent is bounded; more queries take more scans. A task keeps its k best
    for each query, batch by batch, and only these are shuffled.
    """
    spark, n = base.sparkSession, queries.count()
    blocks = max(1, -(-n // QUERIES_AT_ONCE))
    kind = base.schema["id"].dataType.simpleString()

    def unit(vectors: np.ndarray) -> np.ndarray:
        length = np.linalg.norm(vectors, axis=1, keepdims=True)
        return np.divide(vectors, length, out=np.full_like(vectors, np.nan), where=length > 0)

    def block(number: int) -> DataFrame:
        some = (queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == number)).select("id", F.col("vector").cast("array<double>")).where("id is not null and vector is not null").collect()  # a bounded number
        if not some:
            return base.select(F.col("id").alias("query_id"), "id", F.lit(0.0).alias("similarity")).limit(0)
        sent = spark.sparkContext.broadcast((np.array([x.id for x in some]), unit(np.array([x.vector for x in some], float))))

        def nearest(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
            ids, wanted = sent.value
            best_ids, best = np.empty((len(ids), 0), ids.dtype), np.empty((len(ids), 0))
            for rows in (whole.iloc[at : at + 256] for whole in batches for at in range(0, len(whole), 256)):
                own = rows["id"].to_numpy()
                near = np.round(wanted @ unit(np.stack(rows["vector"].to_list()).astype(float)).T, rounding)
                near[(ids[:, None] == own[None, :]) | ~(near >= least)] = -np.inf
                all_ids = np.concatenate([best_ids, np.broadcast_to(own, near.shape)], axis=1)
                near = np.concatenate([best, near], axis=1)
                order = np.lexsort((all_ids, -near), axis=1)[:, :k]
                best_ids, best = np.take_along_axis(all_ids, order, 1), np.take_along_axis(near, order, 1)
            keep = best > -np.inf
            yield pd.DataFrame({"query_id": np.repeat(ids, keep.sum(1)), "id": best_ids[keep], "similarity": best[keep]})

        usable = base.select("id", F.col("vector").cast("array<double>").alias("vector")).where("id is not null and vector is not null")
        found = usable.mapInPandas(nearest, f"query_id {kind}, id {kind}, similarity double")
        return best_per_key(found, ["query_id"], [F.desc("similarity"), F.asc("id")], k)

    return reduce(DataFrame.unionByName, map(block, range(blocks)))


def near_duplicates(chunks: DataFrame, least: float = 0.85, rounding: int = 6, block: int = BLOCK) -> DataFrame:
    """(chunk_id, file_path, vector) -> unordered pairs of chunks of different files whose cosine is at least least.

    Exact: chunks are dealt to blocks by hash, and each pair of blocks is one
    task. There are BLOCKS blocks at most, so that a chunk is sent to a fixed
    number of tasks; only beyond BLOCKS * LARGEST chunks there are more, as a
    task's memory has its bound. A task compares block chunks with as many at
    once. Chunks without a direction have no copies.
    """
    valid = chunks.where("chunk_id is not null and file_path is not null and size(vector) > 0 and exists(vector, x -> x <> 0) and not exists(vector, x -> x is null)")
    n = valid.count()
    blocks = max(1, min(-(-n // block), BLOCKS), -(-n // LARGEST))
    placed = valid.select("chunk_id", "file_path", "vector", F.size("vector").alias("dim"), F.pmod(F.xxhash64("chunk_id"), F.lit(blocks)).cast("int").alias("b"))
    other = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    tiles = other.select("chunk_id", "file_path", "vector", "dim", "b", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))

    def compare(key, rows: pd.DataFrame) -> pd.DataFrame:
        _, i, j = key
        unit = np.stack(rows["vector"].to_list()).astype(float)
        unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
        left, right = (np.flatnonzero(rows["b"].to_numpy() == x) for x in (i, j))
        paths, ids, found = rows["file_path"].to_numpy(), rows["chunk_id"].to_numpy(), []
        for x, y in ((left[p : p + block], right[q : q + block]) for p in range(0, len(left), block) for q in range(0, len(right), block)):
            near = np.round(unit[x] @ unit[y].T, rounding)
            a, b = np.nonzero(near >= least)
            similarity, a, b = near[a, b], x[a], y[b]
            kept = (paths[a] != paths[b]) & ((a < b) if i == j else True)
            found.append((similarity[kept], a[kept], b[kept]))
        similarity, a, b = (np.concatenate(part) for part in zip(*found, strict=True)) if found else (np.empty(0), *np.empty((2, 0), int))
        swap = ids[a] > ids[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        return pd.DataFrame({"left_id": ids[a], "right_id": ids[b], "left_path": paths[a], "right_path": paths[b], "similarity": similarity})

    kind = chunks.schema["chunk_id"].dataType.simpleString()
    return tiles.groupBy("dim", "i", "j").applyInPandas(compare, f"left_id {kind}, right_id {kind}, left_path string, right_path string, similarity double")


def hash_vector(text: Column) -> Column:
    """The fallback embedding: the 32 bytes of the SHA-256 over 255, of length one."""
    digest = F.sha2(text, 256)
    raw = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.conv(F.substr(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.element_at(F.transform(F.array(raw), lambda v: F.transform(v, lambda x: x / norm(v))), 1)


def embed_plan(chunks: DataFrame, cache: DataFrame, batch: int) -> DataFrame:
    """One row: chunks, distinct hashes, hits, misses and batches to embed."""
    wanted = chunks.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n")).join(cache.select("content_hash", F.lit(1).alias("hit")).distinct(), "content_hash", "left")
    out = wanted.agg(F.sum("n").alias("chunks"), F.count(F.lit(1)).alias("hashes"), F.count_if(F.col("hit").isNotNull()).alias("hits"), F.count_if(F.col("hit").isNull()).alias("misses"))
    return out.withColumn("batches", F.ceil(F.col("misses") / batch))


def similar_functions(functions: DataFrame, target: DataFrame, least: float, k: int) -> DataFrame:
    """(id, name, params, returns, callees) against one target row: names .35, parameters .25, returns .15, callees .25."""
    t = target.limit(1).select(*[F.col(c).alias(f"t_{c}") for c in ("id", "name", "params", "returns", "callees")])
    pairs = functions.join(F.broadcast(t)).where("id <> t_id")
    most = F.greatest("params", "t_params")
    params = F.when(most == 0, 1.0).when(F.least("params", "t_params") == 0, 0.0).otherwise(1 - F.abs(F.col("params") - F.col("t_params")) / most)
    score = 0.35 * S.jaccard(S.tokens(F.col("name")), S.tokens(F.col("t_name"))) + 0.25 * params + 0.15 * (F.col("returns") == F.col("t_returns")).cast("int") + 0.25 * S.jaccard(F.col("callees"), F.col("t_callees"))
    scored = pairs.select("id", F.round(score, 4).alias("score")).where(F.col("score") >= least)
    return top(scored, [F.desc("score"), F.asc("id")], k)


def intents(questions: DataFrame, sets: dict[str, Sequence[str]]) -> DataFrame:
    """(id, text) -> id, intent: the token set with most words in the question; the first declared wins a tie."""
    scores = F.array(*[F.struct(F.size(F.array_intersect(S.tokens(F.col("text")), F.array(*[F.lit(x) for x in words]))).alias("n"), F.lit(-i).alias("o"), F.lit(name).alias("name")) for i, (name, words) in enumerate(sets.items())])
    best = F.array_max(scores)
    return questions.select("id", F.when(best.n > 0, best["name"]).otherwise("general").alias("intent"), best.n.alias("hits"))


def first_per_file(candidates: DataFrame) -> DataFrame:
    """Test candidates (file_path, score, reason): the best reason of each file."""
    return best_per_key(candidates, ["file_path"], [F.desc("score"), F.asc("reason")])


def matching_ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp similarity of two strings; null counts as empty. Batched, as no built-in function has it."""
    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([SequenceMatcher(None, p or "", q or "").ratio() for p, q in zip(x, y, strict=True)], dtype="float64")

    return ratio(a, b)


def symbol_relevance(name: Column, kind: Column, query: str) -> Column:
    """Equal names 1, contained .72, a prefix .24 more, .35 of the matching ratio, shared tokens, callable kinds .05."""
    low, wanted = F.lower(name), F.lit(query.lower())
    match = F.when(low == wanted, 1.0).when(F.contains(low, wanted), 0.72).otherwise(0.0)
    tokens = overlap_score(S.tokens(name), F.array(*[F.lit(x) for x in query.lower().split()]))
    return F.round(match + F.when(F.startswith(low, wanted), 0.24).otherwise(0.0) + 0.35 * matching_ratio(low, wanted) + tokens + F.when(kind.isin("function", "method", "class"), 0.05).otherwise(0.0), 4)
