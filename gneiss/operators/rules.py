"""Rule expressions: roles, kinds, relevance parts and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions import scalar as S
from gneiss.operators.relational import ENTRY_KINDS, ENTRY_NAMES, best_per_key

#: What a neighbour by a relation adds, at distance one. Fixed values.
GRAPH_BOOSTS = {
    "CALLS": 0.22, "FETCHES": 0.2, "REFERENCES": 0.16, "INCLUDES": 0.16, "READS_FIELD": 0.14, "EXTENDS": 0.14, "IMPLEMENTS": 0.13, "IMPORTS": 0.12, "METHOD_OVERRIDES": 0.12,
    "METHOD_IMPLEMENTS": 0.11, "ACCESSES": 0.1, "DECLARES": 0.1, "HAS_METHOD": 0.09, "HAS_PROPERTY": 0.09, "ASSOCIATED_WITH": 0.08,
}


def boundary_role(path: Column, name: Column) -> Column:
    """What a symbol does at the border of its application. The words are fixed values."""
    low = F.lower(F.concat_ws(" ", path, name))
    has = lambda *words: F.exists(F.array(*[F.lit(x) for x in words]), lambda w: F.contains(low, w))
    return (
        F.when(has("repository", "/repositories/", "dbcontext", "entityframework", "dataaccess", "/data/"), "data_access")
        .when(has("httpclient", "grpc", "restclient", "externalclient", "/clients/"), "external_io")
        .when(has("controller", "/controllers/", "/endpoints/", "/minimalapi"), "route_entrypoint")
        .when(has("service", "/services/"), "service")
        .otherwise("internal")
    )


def file_kind(path: Column) -> Column:
    low = F.lower(path)
    return F.when(S.is_test_path(path), "test").when(low.rlike(r"\.(tsx|jsx|vue|css|html)$"), "ui").when(low.rlike(r"\.(json|ya?ml|toml|ini)$"), "config").when(low.rlike(r"\.(md|rst|txt)$"), "docs").otherwise("code")


def is_entry_point(qualified_name: Column, kind: Column) -> Column:
    return kind.isin(*ENTRY_KINDS) | F.lower(S.tail(qualified_name)).rlike(ENTRY_NAMES)


def graph_boost(relation: Column, distance: Column) -> Column:
    return F.round(F.coalesce(S.lookup(GRAPH_BOOSTS, relation), F.lit(0.1)) / distance, 4)


def field_matches(have: Column, wanted: Column) -> Column:
    """Equal, or one ends with the other behind a dot."""
    return (have == wanted) | F.endswith(have, F.concat(F.lit("."), wanted)) | F.endswith(wanted, F.concat(F.lit("."), have))


def declaration_pairs(symbols: DataFrame) -> DataFrame:
    """(group, name, qualified_name, is_definition) -> declaration, definition where the group has just one definition of the name."""
    definitions = symbols.where("is_definition").groupBy("group", "name").agg(F.count(F.lit(1)).alias("n"), F.min("qualified_name").alias("definition")).where("n = 1").drop("n")
    return symbols.where("not is_definition").join(definitions, ["group", "name"]).select(F.col("qualified_name").alias("declaration"), "definition")


def overrides(extends: DataFrame, methods: DataFrame) -> DataFrame:
    """(child, parent) and (owner, method) -> child, parent, method that both have."""
    child = methods.select(F.col("owner").alias("child"), "method")
    parent = methods.select(F.col("owner").alias("parent"), "method")
    return extends.join(child, "child").join(parent, ["parent", "method"]).select("child", "parent", "method").distinct()


def convention_tests(files: DataFrame) -> DataFrame:
    """(path) -> path, test: files and tests of one stem."""
    stem = F.regexp_replace(F.regexp_replace(F.lower(S.base_name(F.col("path"))), r"\.[^.]*$", ""), r"^tests?_|[._-](test|spec|tests)$", "")
    rows = files.withColumn("stem", stem).withColumn("is_test", S.is_test_path(F.col("path")))
    return rows.where("not is_test").select("path", "stem").join(rows.where("is_test").select(F.col("path").alias("test"), "stem"), "stem").select("path", "test")


def resolve_includes(includes: DataFrame, roots: DataFrame, files: DataFrame) -> DataFrame:
    """(file_path, name), (position, root) in order and (path) -> file_path, name, path: the first root that has it."""
    names = files.select("path", S.base_name(F.col("path")).alias("base"))
    # By base name first, so that no include meets all roots; then the root is what is left of the path.
    near = includes.withColumn("base", S.base_name(F.col("name"))).join(names, "base").where(F.endswith("path", F.concat(F.lit("/"), "name")))
    tried = near.withColumn("root", F.expr("substring(path, 1, length(path) - length(name) - 1)")).join(roots, "root").select("file_path", "name", "position", "path")
    return best_per_key(tried, ["file_path", "name"], [F.asc("position")]).select("file_path", "name", "path")


def carried_forward(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """value with nulls replaced by the last one before."""
    from pyspark.sql import Window as W

    return rows.withColumn(value, F.last(value, ignorenulls=True).over(W.partitionBy(group).orderBy(order)))


def proximity_boost(ranked: DataFrame, k: int = 5, boost: float = 0.08) -> DataFrame:
    """(path, score): what shares a folder with one of the first k gets more."""
    folder = F.regexp_replace("path", r"/[^/]*$", "")
    best = ranked.orderBy(F.desc("score"), F.asc("path")).limit(k).select(folder.alias("folder")).distinct()  # at most k rows
    boosted = ranked.withColumn("folder", folder).join(F.broadcast(best.withColumn("near", F.lit(True))), "folder", "left")
    return boosted.select("path", F.round(F.col("score") + F.when(F.col("near"), boost).otherwise(0.0), 4).alias("score"))


def review_findings(analyses: DataFrame) -> DataFrame:
    """(agent, payload as JSON with a list of findings) -> agent, file_path, severity, title, confidence."""
    kind = "findings array<struct<file_path:string,severity:string,title:string,confidence:string>>"
    rows = analyses.select("agent", F.explode(F.from_json("payload", kind).findings).alias("x"))
    severity = F.coalesce(S.lookup({"critical": "critical", "blocker": "critical", "high": "high", "major": "high", "medium": "medium", "moderate": "medium", "low": "low", "minor": "low", "info": "low"}, F.lower("x.severity")), F.lit("medium"))
    confidence = F.least(F.greatest(F.coalesce(F.expr("try_cast(x.confidence as double)"), F.lit(0.5)), F.lit(0.0)), F.lit(1.0))
    return rows.select("agent", "x.file_path", severity.alias("severity"), F.trim("x.title").alias("title"), confidence.alias("confidence"))


def fingerprint(file_path: Column, category: Column, title: Column) -> Column:
    """Area, category and the title's words, in any order of digits and case."""
    area = F.when(F.size(F.split(file_path, "/")) > 2, F.substring_index(file_path, "/", 2)).otherwise(F.substring_index(file_path, "/", 1))
    words = F.array_join(F.slice(S.tokens(F.regexp_replace(title, r"\d+", "")), 1, 6), " ")
    return F.concat_ws("|", area, category, words)


#: Names of sensitive values. Fixed values.
SECRET_NAMES = r"(?i)\b(?:password|passwd|secret|api_?key|auth_?token|access_?token|private_?key)\b"


def security_findings(files: DataFrame) -> DataFrame:
    """(path, text) -> file_path, line, title: sensitive names that are assigned without a check in the file, and SQL put together from parts."""
    lines = files.select(F.col("path").alias("file_path"), F.lower("text").alias("low"), F.posexplode(F.split("text", "\n")).alias("p", "t"))
    checked = F.col("low").rlike(r"verif|validat|compare_digest|hash|encrypt")
    sensitive = F.col("t").rlike(SECRET_NAMES + r"\s*[:=]") & ~checked
    dynamic = F.col("t").rlike(r"(?i)(?:execute|query)\s*\(\s*(?:f[\"']|[\"'][^\"']*[\"']\s*(?:%|\+|\.format))") & F.col("t").rlike(r"(?i)select|insert|update|delete")
    title = F.when(sensitive, "sensitive value without verification").when(dynamic, "sql from parts")
    return lines.select("file_path", (F.col("p") + 1).alias("line"), title.alias("title")).where("title is not null")


def symbol_chunks(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Symbols with their lines as content, and files without any as one chunk."""
    cut = symbols.join(files.select(F.col("path").alias("file_path"), F.split("text", "\n").alias("l")), "file_path")
    own = cut.select("file_path", "qualified_name", F.array_join(F.slice("l", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n").alias("content"))
    rest = files.select(F.col("path").alias("file_path"), F.col("text").alias("content")).join(symbols.select("file_path").distinct(), "file_path", "left_anti")
    every = own.unionByName(rest.select("file_path", F.lit("module").alias("qualified_name"), "content"))
    return every.withColumn("content_hash", F.sha2("content", 256))
