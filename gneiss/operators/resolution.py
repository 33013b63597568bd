"""Raw names to symbols, members to owners, references to files, and what belongs to what across files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions import scalar as S
from gneiss.operators.relational import best_per_key

#: Words that name nothing in particular. Fixed values.
NOISE = "a args branch children className color data e error event html i id index item items key margin name result results row selected start text theme type value values views".split()
CALLABLE = ("procedure", "function", "constructor", "destructor", "method")


def _file_names(path: Column) -> Column:
    """Base name and stem of a path."""
    base = S.base_name(path)
    return F.array_distinct(F.array(base, F.regexp_replace(base, r"(.)\.[^.]*$", "$1")))


def candidates(symbols: DataFrame) -> DataFrame:
    """symbols -> key, qualified_name, file_path, start_line: under their names, qualified names and tails (n:), and a file's first symbol under the file's name and stem (f:)."""
    named = F.array_distinct(F.array("name", "qualified_name", S.tail(F.col("qualified_name"))))
    by_name = symbols.select(F.explode(F.transform(named, lambda x: F.concat(F.lit("n:"), x))).alias("key"), "qualified_name", "file_path", "start_line")
    first = symbols.groupBy("file_path").agg(F.min(F.struct("start_line", "qualified_name")).alias("x")).select("file_path", "x.*")
    by_file = first.select(F.explode(F.transform(_file_names(F.col("file_path")), lambda x: F.concat(F.lit("f:"), x))).alias("key"), "qualified_name", "file_path", "start_line")
    return by_name.unionByName(by_file)


def _only(low: str, high: str) -> Column:
    """The one value of a set, given its least and greatest."""
    return F.when(F.col(low) == F.col(high), F.col(low))


def special_targets(refs: DataFrame, symbols: DataFrame, associated: DataFrame) -> DataFrame:
    """refs -> __ref, special: what default imports, namespace members and form events mean in associated files; an empty string if they must mean one thing and don't."""
    member = F.when(F.contains("raw", F.lit(".")) & (F.col("aliases")[F.substring_index("raw", ".", 1)] == "__namespace__"), F.regexp_replace("raw", r"^[^.]*\.", ""))
    form = (F.col("language") == "object_pascal_form") & F.col("relation").isin("CALLS", "REFERENCES")
    kind = F.when(member.isNotNull(), "member").when(F.col("raw") == "default", "default").when(F.col("raw") == "__namespace__", "namespace").when(form, "form")
    asked = refs.where(F.col("relation").isin("IMPORTS", "CALLS", "REFERENCES")).withColumn("__kind", kind).where("__kind is not null").withColumn("__want", F.coalesce(member, F.col("raw")))
    near = asked.select("__ref", "file_path", "__kind", "__want").join(associated, "file_path").select("__ref", "__kind", "__want", F.col("associated").alias("__file"))
    own = symbols.select(F.col("file_path").alias("__file"), "name", "qualified_name", "kind", "exported", "default_export")
    fits = (
        F.when(F.col("__kind") == "member", (F.col("name") == F.col("__want")) & (F.coalesce("exported", F.lit(False)) | F.coalesce("default_export", F.lit(False))))
        .when(F.col("__kind") == "default", F.coalesce("default_export", F.lit(False)))
        .when(F.col("__kind") == "namespace", (F.col("kind") == "module") & (F.col("name") == "exports"))
        .otherwise((F.col("name") == F.col("__want")) & F.col("kind").isin(*CALLABLE))
    )
    found = near.join(own, "__file", "left").groupBy("__ref", "__kind").agg(F.min(F.when(fits, F.col("qualified_name"))).alias("lo"), F.max(F.when(fits, F.col("qualified_name"))).alias("hi"))
    # A form's event that isn't found there may be found elsewhere.
    return found.select("__ref", F.coalesce(_only("lo", "hi"), F.when(F.col("__kind") != "form", "")).alias("special")).where("special is not null")


def resolve(refs: DataFrame, symbols: DataFrame, associated: DataFrame) -> DataFrame:
    """(source, file_path, language, relation, raw, aliases) -> source, relation, raw, target or null.

    In this order: the alias of the name; special targets in associated files;
    candidates by name, for imports by file name, else by the name's tail; of
    these the only one in associated files, the first of the same file, the only
    one at all, or, by relation, the only one whose tail is the name's. Noise
    words resolve as references in their own files only, local names to nothing
    else. Candidates are aggregated by name before they are joined, so that
    common names cost no pairs.
    """
    keys = ["source", "file_path", "relation", "raw"]
    rows = refs.dropDuplicates(keys).withColumn("__asked", F.col("raw")).withColumn("raw", F.coalesce(F.nullif(F.trim(F.col("aliases")[F.col("raw")]), F.lit("")), F.col("raw")))
    rows = rows.withColumn("__ref", F.sha2(F.concat_ws("\u0001", "source", "file_path", "relation", "__asked"), 256))
    tail = S.tail(F.col("raw"))
    every = candidates(symbols)
    by_key = every.groupBy("key").agg(F.min("qualified_name").alias("all_lo"), F.max("qualified_name").alias("all_hi"))
    by_file = every.groupBy("key", "file_path").agg(F.min(F.struct("start_line", "qualified_name"))["qualified_name"].alias("local"), F.min("qualified_name").alias("lo"), F.max("qualified_name").alias("hi"))
    by_tail = every.groupBy("key", S.tail(F.col("qualified_name")).alias("tail")).agg(F.min("qualified_name").alias("tail_lo"), F.max("qualified_name").alias("tail_hi"))
    imports = F.col("relation") == "IMPORTS"
    tried = F.array(F.concat(F.lit("n:"), "raw"), F.when(imports, F.concat(F.lit("f:"), "raw")), F.when(imports & F.contains("raw", F.lit("/")), F.concat(F.lit("f:"), S.base_name(F.col("raw")))), F.when(tail != F.col("raw"), F.concat(F.lit("n:"), tail)))
    keyed = rows.select("*", F.posexplode(tried).alias("__p", "key")).join(by_key, "key")
    keyed = best_per_key(keyed, ["__ref"], [F.asc("__p")]).withColumn("tail", S.tail(F.col("raw")))
    near = keyed.select("__ref", "key", "file_path").join(associated, "file_path").select("__ref", "key", F.col("associated").alias("file_path")).join(by_file.drop("local"), ["key", "file_path"])
    near = near.groupBy("__ref").agg(F.min("lo").alias("near_lo"), F.max("hi").alias("near_hi"))
    names = symbols.select("file_path", F.explode(F.array("name", "qualified_name")).alias("raw")).distinct().withColumn("is_local", F.lit(True))
    full = keyed.join(near, "__ref", "left").join(by_file.select("key", "file_path", "local"), ["key", "file_path"], "left").join(by_tail, ["key", "tail"], "left").join(names, ["file_path", "raw"], "left")
    noise = (F.col("relation") == "REFERENCES") & F.col("raw").isin(*NOISE)
    itself = lambda x: F.when(x == F.col("source"), "").otherwise(x)
    by_relation = F.when(F.col("relation").isin("CALLS", "IMPORTS") | ((F.col("relation") == "REFERENCES") & (F.col("tail") != F.col("raw"))), _only("tail_lo", "tail_hi"))
    target = F.coalesce(
        F.when(_only("near_lo", "near_hi").isNotNull(), itself(_only("near_lo", "near_hi"))), F.col("local"), F.when(noise, ""),
        F.when(_only("all_lo", "all_hi").isNotNull(), itself(_only("all_lo", "all_hi"))), F.when(F.coalesce("is_local", F.lit(False)), ""), by_relation,
    )
    found = full.select("__ref", target.alias("target"))
    out = rows.join(special_targets(rows, symbols, associated), "__ref", "left").join(found, "__ref", "left")
    chosen = F.nullif(F.coalesce(F.when(F.col("special") == F.col("source"), "").otherwise(F.col("special")), F.col("target")), F.lit(""))
    return out.select("source", "file_path", "relation", F.col("__asked").alias("raw"), chosen.alias("target"))


def ownership(symbols: DataFrame) -> DataFrame:
    """(qualified_name, name, kind, file_path, start_line, parent) -> source, relation, target: members to the first symbol of their file that is their parent."""
    relation = F.when(F.col("kind").isin(*CALLABLE), "HAS_METHOD").when(F.col("kind").isin("field", "property"), "HAS_PROPERTY")
    members = symbols.where("coalesce(parent, '') <> ''").select("file_path", F.col("qualified_name").alias("target"), relation.alias("relation"), F.array_distinct(F.array(F.concat(F.lit("q:"), "parent"), F.concat(F.lit("n:"), S.tail(F.col("parent"))))).alias("keys")).where("relation is not null")
    owners = symbols.select("file_path", F.col("qualified_name").alias("source"), "start_line", F.explode(F.array(F.concat(F.lit("q:"), "qualified_name"), F.concat(F.lit("n:"), "name"))).alias("key"))
    owners = owners.groupBy("file_path", "key").agg(F.min(F.struct("start_line", "source")).alias("first"))
    pairs = members.select("file_path", "target", "relation", F.explode("keys").alias("key")).join(owners, ["file_path", "key"])
    return best_per_key(pairs, ["file_path", "target"], [F.asc("first")]).select("first.source", "relation", "target").where("source <> target")


def referenced_files(refs: DataFrame, files: DataFrame) -> DataFrame:
    """(source, raw) and (path) -> source, path: by the whole path, its end, its base name or its stem. Each way is an equality join."""
    clean = F.regexp_replace(F.replace(F.trim(F.regexp_replace("raw", "^[\"']|[\"']$", "")), F.lit("\\"), F.lit("/")), r"^(\./)+", "")
    wanted = refs.select("source", clean.alias("ref")).where("ref <> ''")
    keys = lambda path: F.array_distinct(F.concat(F.transform(_file_names(path), lambda x: F.concat(F.lit("n:"), x)), F.array(F.concat(F.lit("p:"), path))))
    parts = F.split("path", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("p:"), F.array_join(F.slice(parts, i, F.size(parts)), "/")))
    have = files.select("path", F.explode(F.array_distinct(F.concat(keys(F.col("path")), ends))).alias("key"))
    return wanted.select("source", F.explode(keys(F.col("ref"))).alias("key")).join(have, "key").select("source", "path").distinct()


def match_key(qualified_name: Column, signature: Column, declaration_key: Column) -> Column:
    """What a declaration and its definition share: the tail, and the declaration key, the signature or the qualified name."""
    plain = lambda x: F.trim(F.regexp_replace(F.replace(F.coalesce(x, F.lit("")), F.lit("::"), F.lit(".")), r"\s+", " "))
    declared, own, sign = plain(declaration_key), plain(qualified_name), plain(signature)
    return F.when(declared != "", F.struct(S.tail(declared).alias("tail"), declared.alias("key"))).otherwise(F.struct(S.tail(own).alias("tail"), F.when(sign != "", sign).otherwise(own).alias("key")))


def association_pairs(files: DataFrame) -> DataFrame:
    """(path) -> path, associated: headers and sources, units and forms, of one folder and stem, both ways."""
    stem, folder = F.regexp_replace(S.base_name(F.col("path")), r"\.[^.]*$", ""), F.regexp_replace("path", r"[^/]*$", "")
    role = F.when(S.extension(F.col("path")).isin("h", "hh", "hpp", "hxx"), "native:a").when(S.extension(F.col("path")).isin("c", "cc", "cpp", "cxx"), "native:b")
    role = role.when(S.extension(F.col("path")).isin("dfm", "lfm"), "pascal:a").when(S.extension(F.col("path")).isin("pas", "pp"), "pascal:b")
    rows = files.select("path", F.lower(stem).alias("stem"), folder.alias("folder"), F.substring_index(role, ":", 1).alias("family"), F.substring_index(role, ":", -1).alias("side")).where("family is not null")
    a, b = (rows.where(F.col("side") == x).select(F.col("path").alias(x), "stem", "folder", "family") for x in "ab")
    pairs = a.join(b, ["stem", "folder", "family"])
    return pairs.select(F.inline(F.array(F.struct(F.col("a").alias("path"), F.col("b").alias("associated")), F.struct(F.col("b").alias("path"), F.col("a").alias("associated")))))


def module_associations(modules: DataFrame, files: DataFrame) -> DataFrame:
    """(path, specifier) of imports and re-exports -> path, associated: relative specifiers joined to the folder, with the usual endings."""
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    joined = F.concat_ws("/", F.nullif(folder, F.lit("")), "specifier")
    parts = F.aggregate(F.split(joined, "/"), F.array().cast("array<string>"), lambda done, x: F.when(x.isin(".", ""), done).when((x == "..") & (F.size(done) > 0), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x))))
    base = F.array_join(parts, "/")
    tried = F.array(*[F.concat(base, F.lit(x)) for x in ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js")])
    asked = modules.where(F.startswith("specifier", F.lit("."))).select("path", "specifier", F.posexplode(tried).alias("p", "associated"))
    have = asked.join(files.select(F.col("path").alias("associated")), "associated", "left_semi")
    return best_per_key(have, ["path", "specifier"], [F.asc("p")]).select("path", "associated")


def raw_references(symbols: DataFrame) -> DataFrame:
    """Symbols with imports, calls, references, extends, implements and aliases -> refs for resolve."""
    kinds = {"IMPORTS": "imports", "CALLS": "calls", "REFERENCES": "references", "EXTENDS": "extends", "IMPLEMENTS": "implements"}
    one = lambda relation, column: symbols.select(F.col("qualified_name").alias("source"), "file_path", "language", F.lit(relation).alias("relation"), F.explode(column).alias("raw"), "aliases")
    return reduce(DataFrame.unionByName, [one(*x) for x in kinds.items()])
