"""Lookups, filters, merges and rankings over files, symbols and chunks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gneiss.functions import scalar as S


#: Parts of a name, and kinds, that something outside calls. Fixed values.
ENTRY_NAMES = "main|exports|__init__|index|app|server|run|start|setup|create_app|handler|cli"
ENTRY_KINDS = ("module", "exports", "entry_point", "test_file")


def top(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows in a total order (a distributed top-k, never a global sort)."""
    return df.orderBy(*order).limit(k)


def best_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1) -> DataFrame:
    """Up to k rows for each key, in the given order; Spark prunes them before the shuffle."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", n).where(F.col("__n") <= k).drop("__n")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old with the rows of new in place of those with the same key; the last column-wise greatest of new wins a tie."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    return best_per_key(both, keys, [F.desc("__new"), *[F.desc(c) for c in rest]]).drop("__new")


def without(df: DataFrame, gone: DataFrame, key: str, other: str | None = None) -> DataFrame:
    """Rows of df whose key isn't in gone."""
    drop = gone.select(F.col(other or key).alias(key)).distinct()
    return df.join(drop, key, "left_anti")


def cascade_delete(edges: DataFrame, symbols: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols and edges that are left when files are gone: edges lose either end."""
    left = without(symbols, files.withColumnRenamed("path", "file_path"), "file_path")
    gone = symbols.join(files.select(F.col("path").alias("file_path")), "file_path", "left_semi").select("qualified_name").distinct()
    return left, without(without(edges, gone, "source", "qualified_name"), gone, "target", "qualified_name")


def cache_lookup(wanted: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of distinct keys."""
    wanted = wanted.select(key).distinct()
    return wanted.join(cache, key), wanted.join(cache, key, "left_anti")


def search_symbols(symbols: DataFrame, target: str, k: int) -> DataFrame:
    """By exact name, exact file, equal in any case, or part of name or qualified name; best rank first.

    The target is literal text: no character in it is a wildcard.
    """
    low, t = target.lower(), F.lit(target)
    name, qualified = F.lower("name"), F.lower("qualified_name")
    rank = F.when((F.col("name") == t) | (F.col("qualified_name") == t), 0).when(F.col("file_path") == t, 1).when((name == low) | (qualified == low), 2)
    rank = rank.when(F.contains(name, F.lit(low)) | F.contains(qualified, F.lit(low)), 3)
    found = symbols.withColumn("rank", rank).where("rank is not null")
    return top(found, [F.asc("rank"), F.asc("file_path"), F.asc("start_line"), F.asc("qualified_name")], k)


def search_tokens(chunks: DataFrame, query: str, k: int, least: int = 3, most: int = 8) -> DataFrame:
    """Chunks by how many of the query's distinct tokens their content has."""
    words = list(dict.fromkeys(x for x in "".join(c if c.isalnum() else " " for c in query.lower()).split() if len(x) >= least))[:most]
    content = F.lower("content")
    hits = reduce(lambda a, b: a + b, [F.contains(content, F.lit(x)).cast("int") for x in words], F.lit(0))
    return top(chunks.withColumn("hits", hits).where("hits > 0"), [F.desc("hits"), F.asc("file_path"), F.asc("start_line")], k)


def fuzzy_symbols(symbols: DataFrame, query: str, k: int) -> DataFrame:
    """Symbols whose name has at least max(2, n - 1) of the query's n tokens."""
    words = query.lower().split()
    hits = reduce(lambda a, b: a + b, [F.contains(F.lower("name"), F.lit(x)).cast("int") for x in words])
    return top(symbols.withColumn("hits", hits).where(F.col("hits") >= max(2, len(words) - 1)), [F.desc("hits"), F.asc("name"), F.asc("qualified_name")], k)


def overlapping(left: DataFrame, right: DataFrame, key: str, l1: str, l2: str, r1: str, r2: str) -> DataFrame:
    """Pairs with one key and overlapping closed intervals."""
    return left.join(right, (left[key] == right[key]) & (left[l1] <= right[r2]) & (right[r1] <= left[l2])).drop(right[key])


def changed_symbols(symbols: DataFrame, lines: DataFrame) -> DataFrame:
    """Symbols that hold a changed line."""
    return symbols.join(lines, (symbols.file_path == lines.file_path) & lines.line.between(symbols.start_line, symbols.end_line), "left_semi")


def _blocks(start: str, end: str) -> Column:
    """The fewest blocks of 2 ** level lines (level, block) that make up a closed interval of lines."""
    lo, hi = f"-shiftright(-{start}, l)", f"shiftright({end} + 1, l)"
    ends = f"filter(array(if({lo} & 1 = 1, struct(l as level, {lo} as block), null), if({hi} & 1 = 1, struct(l as level, {hi} - 1 as block), null)), x -> x is not null)"
    levels = f"sequence(0, cast(floor(log2(greatest({end} - {start} + 1, 1))) as int))"
    return F.expr(f"flatten(transform({levels}, l -> if({lo} < {hi}, {ends}, filter(array(struct(l as level, {lo} as block)), x -> false))))")


def enclosing_symbols(frames: DataFrame, symbols: DataFrame) -> DataFrame:
    """For each frame (frame_id, file_path, line) the narrowest symbol around the line, else the file's first.

    A file's frames and symbols are not paired: a symbol is known at the few
    blocks of lines it is made of, which keep their best symbol only, and a
    line asks the block of each size that it lies in.
    """
    rest = [c for c in symbols.columns if c != "file_path"]
    asked = frames.select("file_path", F.col("line").cast("long").alias("line")).where("file_path is not null").distinct()
    own = symbols.join(asked.select("file_path").distinct(), "file_path", "left_semi").select("file_path", F.struct(*rest).alias("symbol"), F.col("start_line").cast("long").alias("a"), F.col("end_line").cast("long").alias("b"))
    rank = [F.col("symbol.start_line").isNull().alias("s0"), F.col("symbol.start_line").alias("s1"), F.col("symbol.qualified_name").isNull().alias("q0"), F.col("symbol.qualified_name").alias("q1")]
    first = own.groupBy("file_path").agg(F.min_by("symbol", F.struct(*rank)).alias("first"))
    blocks = own.where("a <= b").select("file_path", F.explode(_blocks("a", "b")).alias("x"), F.struct((F.col("b") - F.col("a")).alias("width"), *rank).alias("rank"), "symbol")
    best = blocks.groupBy("file_path", "x.level", "x.block").agg(F.min("rank").alias("rank"), F.min_by("symbol", "rank").alias("symbol"))
    sizes = best.groupBy("file_path").agg(F.collect_set("level").alias("levels"))
    around = asked.where("line is not null").join(sizes, "file_path").select("file_path", "line", F.explode("levels").alias("level")).withColumn("block", F.expr("shiftright(line, level)"))
    inner = around.join(best, ["file_path", "level", "block"]).groupBy("file_path", "line").agg(F.min_by("symbol", "rank").alias("symbol"))
    found = frames.withColumn("__line", F.col("line").cast("long")).join(inner.withColumnRenamed("line", "__line"), ["file_path", "__line"], "left").join(first, "file_path", "left")
    found = found.withColumn("inside", F.col("symbol").isNotNull()).withColumn("symbol", F.coalesce("symbol", "first"))
    pairs = found.select(*frames.columns, *[F.col(f"symbol.{c}").alias(c) for c in rest], "inside")
    width = F.when(F.col("inside"), F.col("end_line") - F.col("start_line"))
    return best_per_key(pairs, ["frame_id"], [F.desc("inside"), width.asc_nulls_last(), F.col("start_line").asc_nulls_last(), F.col("qualified_name").asc_nulls_last()])


def neighbour_chunks(seeds: DataFrame, chunks: DataFrame, reach: int, k: int) -> DataFrame:
    """Up to k other chunks of a seed's file within so many lines: containing ones first, then the nearest."""
    s = seeds.select(F.col("chunk_id").alias("seed"), "file_path", F.col("start_line").alias("a"), F.col("end_line").alias("b"))
    pairs = s.join(chunks, "file_path").where(f"chunk_id <> seed and start_line <= b + {reach} and end_line >= a - {reach}")
    contains = (F.col("start_line") <= F.col("a")) & (F.col("end_line") >= F.col("b"))
    return best_per_key(pairs, ["seed"], [contains.desc(), F.abs(F.col("start_line") - F.col("a")).asc(), F.asc("chunk_id")], k)


def dead_symbols(symbols: DataFrame, edges: DataFrame, relations: Sequence[str]) -> DataFrame:
    """Symbols that no edge of the relations points to, entry points and tests apart."""
    used = edges.where(F.col("relation").isin(*relations)).select(F.col("target").alias("qualified_name"))
    entry = F.lower(S.tail(F.col("qualified_name"))).rlike(ENTRY_NAMES) | F.col("kind").isin(*ENTRY_KINDS)
    return without(symbols, used, "qualified_name").where(~entry & ~S.is_test_path(F.col("file_path")))


def plan_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, sha256) before and now -> path, status: changed, deleted or unchanged."""
    both = old.select("path", F.col("sha256").alias("was")).join(new.select("path", F.col("sha256").alias("now")), "path", "full_outer")
    return both.select("path", F.when(F.col("now").isNull(), "deleted").when(F.col("was").eqNullSafe(F.col("now")), "unchanged").otherwise("changed").alias("status"))


def id_changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, status: unchanged, stale (only before) or new."""
    both = old.select(key, F.lit(1).alias("a")).distinct().join(new.select(key, F.lit(1).alias("b")).distinct(), key, "full_outer")
    return both.select(key, F.when(F.col("b").isNull(), "stale").when(F.col("a").isNull(), "new").otherwise("unchanged").alias("status"))


def integrity(symbols: DataFrame, files: DataFrame, defines: DataFrame) -> DataFrame:
    """Symbols without their file, and symbols that nothing defines."""
    lost = without(symbols, files.withColumnRenamed("path", "file_path"), "file_path").select("qualified_name", F.lit("no_file").alias("problem"))
    undefined = without(symbols, defines.withColumnRenamed("target", "qualified_name"), "qualified_name").select("qualified_name", F.lit("no_defines").alias("problem"))
    return lost.unionByName(undefined)


def either_match(left: DataFrame, right: DataFrame, left_key: str, right_keys: Sequence[str]) -> DataFrame:
    """Left rows that match any of several right columns: a union of equality joins, so that no nested loop is planned."""
    keys = reduce(DataFrame.union, [right.select(F.col(k).alias(left_key)) for k in right_keys]).distinct()
    return left.join(keys, left_key, "left_semi")


def shared_members(members: DataFrame, group: str, item: str, hub: int) -> DataFrame:
    """Ordered pairs of groups that share an item; items in more than hub groups link nothing."""
    members = members.select(group, item).distinct()
    few = members.withColumn("__n", F.count(F.lit(1)).over(W.partitionBy(item))).where(F.col("__n") <= hub).drop("__n")
    a, b = few.withColumnRenamed(group, "left_id"), few.withColumnRenamed(group, "right_id")
    return a.join(b, item).where("left_id < right_id").select("left_id", "right_id", item)


def merge_findings(findings: DataFrame) -> DataFrame:
    """One row for each fingerprint: worst severity, longest text, highest confidence, count and distinct review types."""
    order = F.array_position(F.array(*[F.lit(x) for x in ("low", "medium", "high", "critical")]), F.col("severity"))
    return findings.groupBy("fingerprint").agg(
        F.max_by("severity", F.struct(order, "severity")).alias("severity"), F.max_by("description", F.struct(F.length("description"), "description")).alias("description"),
        F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("occurrence_count"), S.joined(F.collect_set("review_type")).alias("review_types"),
    )


def accumulate_findings(old: DataFrame, new: DataFrame) -> DataFrame:
    """Occurrences add up, first_seen stays, last_seen moves on."""
    a = old.select("fingerprint", F.col("occurrence_count").alias("n0"), F.col("first_seen").alias("f0"), F.col("last_seen").alias("l0"))
    both = a.join(new, "fingerprint", "full_outer")
    n = F.coalesce("n0", F.lit(0)) + F.coalesce("occurrence_count", F.lit(0))
    return both.select("fingerprint", n.cast("long").alias("occurrence_count"), F.coalesce("f0", "first_seen").alias("first_seen"), F.coalesce("last_seen", "l0").alias("last_seen"))


def diversify(ranked: DataFrame, cap: int, k: int) -> DataFrame:
    """At most cap rows of a file first; what overflows fills up the k."""
    n = F.row_number().over(W.partitionBy("file_path").orderBy(F.desc("score"), F.asc("id")))
    return top(ranked.withColumn("overflow", n > cap), [F.asc("overflow"), F.desc("score"), F.asc("id")], k)


def round_robin(hits: DataFrame, each: int) -> DataFrame:
    """Rows (term, position, rank, id) in turns of ``each`` from every term; an id keeps its first place."""
    n = F.row_number().over(W.partitionBy("term").orderBy("rank", "id"))
    turned = hits.withColumn("turn", F.ceil(n / each).cast("int")).withColumn("n", n)
    return best_per_key(turned, ["id"], [F.asc("turn"), F.asc("position"), F.asc("n")])


def gap_sessions(events: DataFrame, key: str, ts: str, gap_seconds: int) -> DataFrame:
    """The batch twin of a debounced stream: bursts with no pause of gap_seconds or more."""
    order = W.partitionBy(key).orderBy(ts)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    fresh = (micros - F.lag(micros).over(order) >= gap_seconds * 1_000_000) | F.lag(ts).over(order).isNull()
    marked = events.withColumn("__s", F.sum(fresh.cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(key, "__s").agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("n")).drop("__s")


BLOCKED = ("insert", "update", "delete", "drop", "create", "alter", "truncate", "merge", "copy", "set", "use", "cache")


def read_only_sql(spark, text: str, **views: DataFrame) -> DataFrame:
    """One SELECT or WITH statement over the given frames; anything that could write is refused."""
    import re

    bare = re.sub(r"'(?:[^']|'')*'", "''", text)
    if not re.match(r"\s*(select|with)\b", bare, re.IGNORECASE) or ";" in bare.rstrip().rstrip(";") or re.search(r"\b(" + "|".join(BLOCKED) + r")\b", bare, re.IGNORECASE):
        raise ValueError("only a single reading statement is allowed")
    for name in views:
        text = re.sub(rf"\b{name}\b", "{" + name + "}", text)
    return spark.sql(text, **views)
