"""Text to rows: chunks, symbols, stack frames, diff lines, routes and review observations."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gneiss.functions import scalar as S


def lines(df: DataFrame, text: str = "text") -> DataFrame:
    """A row for each line of text, numbered from 1."""
    return df.select(*[c for c in df.columns if c != text], F.posexplode(F.split(text, "\n")).alias("__p", "line_text")).withColumn("line", F.col("__p") + 1).drop("__p")


def chunks(files: DataFrame, size: int, overlap: int, most_chars: int = 12_000) -> DataFrame:
    """Windows of size lines that overlap; the last one ends with the file. Over-long windows are omitted.

    chunk_id holds path, range and the first 16 digits of the content's hash.
    """
    rows = files.withColumn("__lines", F.split("text", "\n")).withColumn("__n", F.size("__lines"))
    # A window that starts before the last overlap lines still brings new ones.
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("__n") - overlap), F.lit(size - overlap))
    cut = rows.select("path", "__lines", "__n", F.explode(starts).alias("start_line"))
    content = F.array_join(F.slice("__lines", F.col("start_line"), F.lit(size)), "\n")
    cut = cut.select("path", "start_line", F.least(F.col("start_line") + size - 1, F.col("__n")).alias("end_line"), content.alias("content"))
    cut = cut.where(F.length("content") <= most_chars).withColumn("content_hash", F.sha2("content", 256))
    return cut.withColumn("chunk_id", F.concat_ws(":", "path", "start_line", "end_line", F.substring("content_hash", 1, 16))).withColumnRenamed("path", "file_path")


def chunk_summary(chunked: DataFrame) -> DataFrame:
    """One row: chunks, distinct contents, and how many repeat an earlier one."""
    return chunked.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("chunks"), F.count(F.lit(1)).alias("contents"), F.sum(F.col("n") - 1).alias("duplicates"))


#: (kind, pattern with the name as first group). Fixed values of the generic parser.
SYMBOL_PATTERNS = (
    ("function", r"(?m)^[ \t]*(?:export[ ]+)?(?:async[ ]+)?(?:def|function|func|fn|sub|procedure)[ ]+([A-Za-z_]\w*)"),
    ("class", r"(?m)^[ \t]*(?:export[ ]+)?(?:public[ ]+)?(?:class|struct|interface|trait|enum)[ ]+([A-Za-z_]\w*)"),
    ("constant", r"(?m)^[ \t]*(?:export[ ]+)?(?:const|let|var)[ ]+([A-Za-z_]\w*)[ ]*="),
)
IMPORT_PATTERN = r"(?m)^[ \t]*(?:import|from|use|require|include|using)[ ]+[\"'<]?([\w./:]+)"


def generic_symbols(files: DataFrame, most: int = 100) -> DataFrame:
    """(path, text) -> file_path, kind, name by regular expressions; the first occurrences of a file, up to ``most`` of a kind."""
    found = None
    for kind, pattern in SYMBOL_PATTERNS:
        part = files.select(F.col("path").alias("file_path"), F.lit(kind).alias("kind"), F.explode(F.slice(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))), 1, most)).alias("name"))
        found = part if found is None else found.unionByName(part)
    return found


def generic_imports(files: DataFrame) -> DataFrame:
    return files.select(F.col("path").alias("file_path"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(IMPORT_PATTERN), F.lit(1)))).alias("module"))


def python_symbols(files: DataFrame) -> DataFrame:
    """(path, text) -> symbols of Python sources by their syntax tree: classes, functions and methods with calls and bases.

    A file that doesn't parse gives one row of kind parse_error.
    """

    def parse(batches: Iterator) -> Iterator:
        import ast

        import pandas as pd

        def name_of(node: ast.AST) -> str:
            if isinstance(node, ast.Attribute):
                return f"{name_of(node.value)}.{node.attr}".strip(".")
            return node.id if isinstance(node, ast.Name) else ""

        def walk(path: str, body: list, parents: list[str]) -> Iterator[tuple]:
            for node in body:
                if isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                    is_class = isinstance(node, ast.ClassDef)
                    calls = sorted({name_of(x.func) for x in ast.walk(node) if isinstance(x, ast.Call)} - {""})
                    bases = [x for x in map(name_of, node.bases) if x] if is_class else []
                    kind = "class" if is_class else "method" if parents else "async_function" if isinstance(node, ast.AsyncFunctionDef) else "function"
                    yield path, ".".join([*parents, node.name]), node.name, kind, node.lineno, node.end_lineno or node.lineno, calls, bases
                    yield from walk(path, node.body, [*parents, node.name])

        columns = ["file_path", "qualified_name", "name", "kind", "start_line", "end_line", "calls", "bases"]
        for batch in batches:
            rows: list[tuple] = []
            for path, text in zip(batch["path"], batch["text"], strict=True):
                try:
                    rows += walk(path, ast.parse(text or "").body, [])
                except (SyntaxError, ValueError):
                    rows.append((path, "", "", "parse_error", 0, 0, [], []))
            yield pd.DataFrame(rows, columns=columns)

    schema = "file_path string, qualified_name string, name string, kind string, start_line int, end_line int, calls array<string>, bases array<string>"
    return files.select("path", "text").mapInPandas(parse, schema)


def parsed_edges(symbols: DataFrame) -> DataFrame:
    """DEFINES, CALLS and EXTENDS with raw targets, from parsed symbols."""
    part = lambda relation, targets: symbols.select(F.col("qualified_name").alias("source"), F.lit(relation).alias("relation"), F.explode(targets).alias("target"))
    defines = symbols.select(F.col("file_path").alias("source"), F.lit("DEFINES").alias("relation"), F.col("qualified_name").alias("target"))
    return defines.unionByName(part("CALLS", "calls")).unionByName(part("EXTENDS", "bases")).where("target <> ''").distinct()


FRAME = r'File "([^"]+)", line (\d+), in (\S+)'


def stack_frames(traces: DataFrame) -> DataFrame:
    """(trace_id, text) -> trace_id, position, file, line, function of each frame."""
    parts = F.arrays_zip(*[F.regexp_extract_all("text", F.lit(FRAME), F.lit(k)).alias(n) for k, n in ((1, "file"), (2, "line"), (3, "function"))])
    out = traces.select("trace_id", F.posexplode(parts).alias("position", "f"))
    return out.select("trace_id", "position", "f.file", F.col("f.line").cast("int").alias("line"), "f.function")


def diff_lines(diffs: DataFrame) -> DataFrame:
    """(diff_id, text) of unified diffs -> diff_id, file_path, line for each line of the new side that a hunk covers.

    A diff is read within its row: what stands between two file headers is
    that file's, and only hunks leave the row.
    """
    hunk = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    kept = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"^\+\+\+ (?:b/)?\S") | x.rlike(hunk))
    path = lambda x: F.regexp_extract(x, r"^\+\+\+ (?:b/)?(\S+)", 1)
    count = lambda x: F.when(F.regexp_extract(x, hunk, 2) == "", 1).otherwise(F.regexp_extract(x, hunk, 2).try_cast("int"))
    empty = F.array().cast("array<struct<file_path:string,a:int,n:int>>")
    start = F.struct(F.lit(None).cast("string").alias("own"), empty.alias("out"))
    step = lambda s, x: F.when(x.startswith("+++ "), F.struct(path(x).alias("own"), s["out"].alias("out"))).otherwise(
        F.struct(s["own"].alias("own"), F.concat(s["out"], F.array(F.struct(s["own"].alias("file_path"), F.regexp_extract(x, hunk, 1).cast("int").alias("a"), count(x).alias("n")))).alias("out"))
    )
    rows = diffs.select("diff_id", F.explode(F.array_distinct(F.aggregate(kept, start, step, lambda s: s["out"]))).alias("x")).select("diff_id", "x.*")
    rows = rows.where("n > 0 and file_path <> '/dev/null'").repartition("diff_id", "file_path")  # hunks move, and repeats of lines go where they meet
    return rows.select("diff_id", "file_path", F.explode(F.sequence(F.col("a"), F.col("a") + F.col("n") - 1)).alias("line")).distinct()


EXPRESS = r"\b(?:app|router)\.(get|post|put|delete|patch|all)\(\s*['\"`]([^'\"`]+)['\"`]"
DJANGO = r"\b(?:re_)?path\(\s*r?['\"]([^'\"]*)['\"]"
FETCH = r"\b(?:fetch|axios\.(?:get|post|put|delete|patch))\(\s*['\"`]([^'\"`]+)['\"`]"


def express_routes(files: DataFrame) -> DataFrame:
    """(path, text) -> file_path, method, route."""
    pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(EXPRESS), F.lit(1)).alias("m"), F.regexp_extract_all("text", F.lit(EXPRESS), F.lit(2)).alias("r"))
    method = F.when(F.col("x.m") == "all", "ANY").otherwise(F.upper("x.m"))
    return files.select(F.col("path").alias("file_path"), F.explode(pairs).alias("x")).select("file_path", method.alias("method"), S.normal_route(F.col("x.r")).alias("route"))


def django_routes(files: DataFrame) -> DataFrame:
    raw = files.select(F.col("path").alias("file_path"), F.explode(F.regexp_extract_all("text", F.lit(DJANGO), F.lit(1))).alias("r"))
    return raw.select("file_path", F.lit("ANY").alias("method"), S.normal_route(F.regexp_replace("r", r"<(?:\w+:)?(\w+)>", "{$1}")).alias("route"))


def fetched_routes(files: DataFrame) -> DataFrame:
    raw = files.select(F.col("path").alias("file_path"), F.explode(F.regexp_extract_all("text", F.lit(FETCH), F.lit(1))).alias("r"))
    return raw.select("file_path", S.normal_route(F.col("r")).alias("route")).distinct()


def route_map(handlers: DataFrame, consumers: DataFrame) -> DataFrame:
    """(route, file) on both sides -> route, handlers, consumers as sorted text; either may be missing."""
    side = lambda df, name: df.groupBy("route").agg(S.joined(F.collect_set("file_path")).alias(name))
    both = side(handlers, "handlers").join(side(consumers, "consumers"), "route", "full_outer")
    return both.select("route", F.coalesce("handlers", F.lit("")).alias("handlers"), F.coalesce("consumers", F.lit("")).alias("consumers"))


def table_names(text: Column) -> Column:
    """Tables that SQL in a text reads or writes."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\b(?:from|join|into|update)\s+([a-z_][\w.]*)"), F.lit(1)), F.lower))


def review(files: DataFrame, long_lines: int = 300) -> DataFrame:
    """(path, text) -> observations: open TODOs, long files, tokens that are used but never checked, identifiers of secrets."""
    low = F.lower("text")
    has = lambda *words: F.exists(F.array(*[F.lit(x) for x in words]), lambda w: F.contains(low, w))
    rule = lambda when, *what: F.when(when, F.struct(*[F.lit(x).alias(n) for n, x in zip(("category", "severity", "title"), what, strict=True)]))
    rules = F.array(
        rule(has("todo", "fixme"), "maintainability", "low", "open todo"),
        rule(F.size(F.split("text", "\n")) > long_lines, "maintainability", "medium", "long file"),
        rule(has("token") & ~has("verify", "validate", "check") & has("=", "header", "bearer"), "security", "high", "token without validation"),
        rule(has("license"), "legal", "low", "license mention"),
    )
    return files.select(F.col("path").alias("file_path"), F.explode(F.array_compact(rules)).alias("x")).select("file_path", "x.*")


def rename_preview(files: DataFrame, old: str, new: str) -> DataFrame:
    """Lines in which the identifier stands as a whole word: before and after."""
    word = rf"\b{old}\b"
    return lines(files.select("path", "text")).where(F.col("line_text").rlike(word)).select(F.col("path").alias("file_path"), "line", F.regexp_replace("line_text", word, new).alias("after"))


def phrase_terms(text: Column, n: int) -> Column:
    """Runs of n words."""
    words = F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda x: x != "")
    return F.when(F.size(words) < n, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " ")))
