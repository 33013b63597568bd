"""Tests for a target: by calls, by a map, by projects, by naming conventions and by shared words."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions import scalar as S
from gneiss.operators import graph
from gneiss.operators.relational import best_per_key

#: Endings of files that can be tests.
SOURCE = r"\.(py|cs|ts|tsx|js|jsx|c|cpp|cc|cxx|h|hpp|hh|hxx|java|kt|go|rs|rb)$"
_COLUMNS = ("target", "file_path", "score", "reason")


def stem_of(path: Column) -> Column:
    return F.regexp_replace(S.base_name(path), r"\.[^.]*$", "")


def by_calls(targets: DataFrame, edges: DataFrame, symbols: DataFrame, cap: int = 80, inner: int = 40) -> DataFrame:
    """(target, symbol) -> tests that call the symbol (12), or call what calls it (8); callers in order of name up to a cap."""
    calls = edges.where("relation = 'CALLS'").select("source", "target").distinct().withColumnRenamed("target", "symbol")
    direct = best_per_key(targets.select("target", "symbol").join(calls, "symbol"), ["target", "symbol"], [F.asc("source")], cap)
    second = best_per_key(direct.select("target", F.col("source").alias("symbol")).distinct().join(calls, "symbol"), ["target", "symbol"], [F.asc("source")], inner)
    home = symbols.where(S.is_test_path(F.col("file_path"))).select(F.col("qualified_name").alias("source"), "file_path").distinct()
    rows = direct.select("target", "source", F.lit(12).alias("score"), F.lit("calls").alias("reason")).unionByName(second.select("target", "source", F.lit(8).alias("score"), F.lit("calls_indirectly").alias("reason")))
    return rows.join(home, "source").select(*_COLUMNS)


def by_map(targets: DataFrame, markers: DataFrame, tests: DataFrame) -> DataFrame:
    """(target, seed text) and a map (marker, file_path) -> mapped tests that exist (10). The map is a short parameter table."""
    hit = targets.join(F.broadcast(markers), F.contains(F.lower("seed"), F.col("marker")))
    return hit.join(tests.select("file_path"), "file_path", "left_semi").select("target", "file_path", F.lit(10).alias("score"), F.lit("mapped").alias("reason"))


def nearest_project(paths: DataFrame, projects: DataFrame) -> DataFrame:
    """(path) and (project) -> path, project: the project of the longest folder above the path."""
    folder = F.regexp_replace("project", r"/?[^/]*$", "")
    have = projects.select("project", folder.alias("folder"))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    asked = paths.where(F.contains("path", F.lit("/"))).select("path", F.explode(above).alias("folder"))
    return best_per_key(asked.join(have, "folder"), ["path"], [F.length("folder").desc(), F.asc("project")]).select("path", "project")


def by_project(targets: DataFrame, files: DataFrame, references: DataFrame) -> DataFrame:
    """(target, file_path), (path) and (test_project, project) references -> tests named after the file in a test project that refers to its project (11), or is named after it (10)."""
    is_project = F.lower("path").rlike(r"\.csproj$")
    tests_ = S.is_test_path(F.col("path")) | F.lower(stem_of(F.col("path"))).rlike("(tests|test|specs)$")
    projects = files.where(is_project).select(F.col("path").alias("project"), tests_.alias("is_test"))
    sources = targets.where(F.lower("file_path").rlike(r"\.cs$")).select("target", F.col("file_path").alias("path"), F.lower(stem_of(F.col("file_path"))).alias("stem"))
    home = nearest_project(sources.select("path").distinct(), projects.where("not is_test").select("project"))
    sources = sources.join(home, "path").select("target", "stem", "project")
    near = nearest_project(files.where(F.lower("path").rlike(r"\.cs$")).select("path").distinct(), projects.where("is_test").select("project")).select(F.col("path").alias("file_path"), F.col("project").alias("test_project"))
    near = near.withColumn("stem", F.regexp_replace(F.lower(stem_of(F.col("file_path"))), r"(tests?|specs?)$", ""))
    pairs = sources.join(near, "stem").join(references.select("test_project", "project", F.lit(True).alias("refers")).distinct(), ["test_project", "project"], "left")
    named = F.contains(F.lower(stem_of(F.col("test_project"))), F.lower(stem_of(F.col("project"))))
    pairs = pairs.where(F.coalesce("refers", F.lit(False)) | named)
    return pairs.select("target", "file_path", F.when(F.col("refers"), 11).otherwise(10).alias("score"), F.when(F.col("refers"), "project_reference").otherwise("project_name").alias("reason"))


def by_convention(targets: DataFrame, files: DataFrame) -> DataFrame:
    """(target, file_path) -> tests of the same stem: of the same language (9), of another (8)."""
    bare = lambda p: F.regexp_replace(F.regexp_replace(F.lower(stem_of(p)), r"^tests?_|[._-](test|spec|tests)$", ""), r"^test_|(tests|test)$", "")
    a = targets.select("target", F.col("file_path").alias("source"), bare(F.col("file_path")).alias("stem"))
    b = files.where(S.is_test_path(F.col("path"))).select(F.col("path").alias("file_path"), bare(F.col("path")).alias("stem"))
    same = S.extension(F.col("source")) == S.extension(F.col("file_path"))
    return a.join(b, "stem").where("source <> file_path").select("target", "file_path", F.when(same, 9).otherwise(8).alias("score"), F.lit("convention").alias("reason"))


#: Pairs that a word may give before it counts as frequent, and pairs that one task makes.
RARE_PAIRS, PAIRS_A_TASK = 10_000, 5_000_000


def _by_signature(words: DataFrame, own: str, shared: DataFrame) -> DataFrame:
    """(own, word) -> own, sig: its frequent shared words as sorted text, rare: its other shared words."""
    kept = words.join(shared, "word").groupBy(own).agg(
        S.joined(F.collect_list(F.when(F.col("frequent"), F.col("word")))).alias("sig"), F.collect_list(F.when(~F.col("frequent"), F.col("word"))).alias("rare")
    )
    return graph.cut(kept)


def by_words(targets: DataFrame, tests: DataFrame) -> DataFrame:
    """(target, seed) and (file_path) -> source tests that share words with the target: one each, and two for being a test.

    The result has all pairs with a shared word, which are many where a word is
    frequent, so that no pair is shuffled that two equal sets of frequent words
    could speak for: targets and tests are grouped by these sets, the sets are
    compared, and the pairs of their members are made in tasks of a stated
    number of pairs. Only words of few pairs are joined pair by pair.
    """
    a = targets.select("target", F.explode(S.tokens(F.col("seed"))).alias("word")).distinct()
    b = tests.where(F.lower("file_path").rlike(SOURCE)).select("file_path", F.explode(S.tokens(F.col("file_path"))).alias("word")).distinct()
    count = lambda df, name: df.groupBy("word").agg(F.count(F.lit(1)).alias(name))
    shared = count(a, "n_a").join(count(b, "n_b"), "word").select("word", (F.col("n_a") * F.col("n_b") > RARE_PAIRS).alias("frequent"))
    left, right = _by_signature(a, "target", shared), _by_signature(b, "file_path", shared)

    sizes = lambda df, sig, n: df.where("sig <> ''").groupBy(F.col("sig").alias(sig)).agg(F.count(F.lit(1)).alias(n))
    words = lambda sizes, sig: sizes.select(sig, F.explode(F.split(sig, ",")).alias("word"))
    sig_a, sig_b = sizes(left, "sig_a", "n_a"), sizes(right, "sig_b", "n_b")
    alike = graph.cut(words(sig_a, "sig_a").join(words(sig_b, "sig_b"), "word").groupBy("sig_a", "sig_b").agg(F.count(F.lit(1)).cast("int").alias("n")))
    pairs = alike.join(sig_a, "sig_a").groupBy("sig_b").agg(F.sum("n_a").alias("n_a")).join(sig_b, "sig_b")
    tiles = graph.cut(pairs.select("sig_b", F.least("n_a", F.ceil(F.col("n_a") * F.col("n_b") / PAIRS_A_TASK)).cast("int").alias("tiles")))
    tasks = min(max(tiles.agg(F.sum("tiles")).first()[0] or 0, 1), 10_000)

    dealt = left.withColumnRenamed("sig", "sig_a").join(alike, "sig_a").join(tiles, "sig_b").select("target", "sig_b", "n", F.col("rare").alias("rare_a"), F.pmod(F.xxhash64("target"), "tiles").cast("int").alias("tile"))
    sent = right.withColumnRenamed("sig", "sig_b").join(tiles, "sig_b").select("file_path", "sig_b", F.col("rare").alias("rare_b"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
    also = F.when((F.size("rare_a") > 0) & (F.size("rare_b") > 0), F.size(F.array_intersect("rare_a", "rare_b"))).otherwise(0)
    frequent = dealt.repartition(tasks, "sig_b", "tile").join(sent.repartition(tasks, "sig_b", "tile"), ["sig_b", "tile"]).select("target", "file_path", (F.col("n") + also).alias("n"))

    few = lambda df, own, sig: df.select(own, F.col("sig").alias(sig), F.explode("rare").alias("word"))
    rare = few(left, "target", "sig_a").join(few(right, "file_path", "sig_b"), "word").join(alike, ["sig_a", "sig_b"], "left_anti")
    rare = rare.groupBy("target", "file_path").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return frequent.unionByName(rare).select("target", "file_path", (F.col("n") + 2).alias("score"), F.lit("words").alias("reason"))


#: Which way counts if several find a file, first to last.
ORDER = ("calls", "calls_indirectly", "mapped", "project_reference", "project_name", "convention", "words")


def found(frames: list[DataFrame], k: int = 10) -> DataFrame:
    """Candidates of several ways -> for each target the k best files, each by the first way that found it."""
    every = reduce(DataFrame.unionByName, frames).withColumn("way", F.array_position(F.array(*[F.lit(x) for x in ORDER]), F.col("reason")))
    first = best_per_key(every, ["target", "file_path"], [F.asc("way"), F.desc("score")])
    return best_per_key(first, ["target"], [F.asc("way"), F.desc("score"), F.asc("file_path")], k).select(*_COLUMNS)
