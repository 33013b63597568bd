"""Change intelligence: risk labels and points over what a diff touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (hint, pattern of the lower-case path, whether it is a high risk, whether it is sensitive in embedded code). Fixed values of this operator.
PATH_RULES = (
    ("embedded/native assembly startup or include path", r"\.(s|asm|inc)$", True, True),
    ("MPLAB embedded project/config path", r"\.(mcp|mcw|mptags|scl|plt)$", True, True),
    ("device/vendor register header", r"(^|/)(p[0-9]+[a-z0-9_]*\.h|(xc|pic|dspic)[^/]*)$", True, True),
    ("global embedded C contract header", r"(^|/)(global|globals|typedefs|sysdefs)\.h$", True, True),
    ("interrupt/trap/startup path", r"(^|[^a-z0-9])(trap|isr|interrupt|reset)([^a-z0-9/][^/]*)?$|(^|[^a-z0-9])(vector|vectors|vectortable)([^a-z0-9/][^/]*)?\.(c|h|s|asm|inc|ld|lds)$", True, True),
    ("embedded peripheral/init/flash path", r"(uart|flash|init|bootloader)[^/]*$", False, True),
    ("public/native header surface", r"\.(h|hh|hpp|hxx)$", True, False),
    ("native implementation file", r"\.(c|cc|cpp|cxx)$", False, False),
    ("native linker/memory layout script", r"\.(gld|ld|lds)$", True, True),
    ("native build target/config path", r"(\.cmake|cmakelists\.txt|makefile|\.vcxproj|\.vcxproj\.filters)$", True, False),
    ("native exported API/ABI surface", r"\.(def|map)$|/exports/", True, False),
    ("C# public route/API path", r"(/controllers/|/endpoints/|/minimalapi).*\.cs$|program\.cs(.*\.cs)?$", True, False),
    ("C# DTO/API contract path", r"(dto|contract|request|response).*\.cs$", True, False),
    ("C# dependency-injection/config path", r"(servicecollection|dependencyinjection).*\.cs$|(startup|program)\.cs(.*\.cs)?$", True, False),
    ("C# database/schema path", r"(migration|dbcontext).*\.cs$", True, False),
    ("Object Pascal project/package path", r"\.(dpr|dpk|dproj|groupproj|lpi|lpk)$", True, False),
    ("Object Pascal form/resource path", r"\.(dfm|lfm)$", True, False),
    ("Object Pascal form event wiring path", r"\.(dfm|lfm)$", False, False),
    ("Object Pascal unit/source path", r"\.(pas|pp)$", False, False),
    ("Object Pascal/global include path", r"\.inc$", True, False),
    ("auth/security/middleware path", r"/(auth|security|middleware)", True, False),
    ("public route/API path", r"/(routers|routes|api)/", False, False),
    ("database/repository path", r"/(repositories|repository)/|/db|migration|schema", True, False),
    ("shared service/core path", r"/(services|core|shared|utils)/|/config", False, False),
)


def path_hints(path: Column) -> Column:
    return F.array_compact(F.array(*[F.when(_plain(path).rlike(p), h) for h, p, *_ in PATH_RULES]))


def is_high_risk(path: Column) -> Column:
    return F.exists(F.array(*[_plain(path).rlike(p) for _, p, high, _ in PATH_RULES if high]), lambda x: x)


def is_embedded_sensitive(path: Column) -> Column:
    return F.exists(F.array(*[_plain(path).rlike(p) for _, p, _, embedded in PATH_RULES if embedded]), lambda x: x)


def _plain(path: Column) -> Column:
    return F.replace(F.lower(path), F.lit("\\"), F.lit("/"))


def symbol_hints(symbols: DataFrame) -> DataFrame:
    """(file_path, kind, is_exported, abi_surface, layout_fields, build_target, is_public_dependency, is_project_owner, include_files, conditional_symbols) -> file_path, hints: what the file's symbols show to others."""
    header = _plain(F.col("file_path")).rlike(r"\.(h|hh|hpp|hxx)$")
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    per = symbols.groupBy("file_path").agg(
        some(header & F.lower("kind").isin("type", "typedef", "class", "macro", "constant")).alias("layout"), some(F.col("is_exported")).alias("exported"),
        F.sort_array(F.collect_set(F.nullif("abi_surface", F.lit("")))).alias("surfaces"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("layout_fields")))).alias("fields"),
        F.sort_array(F.collect_set(F.nullif("build_target", F.lit("")))).alias("targets"), some(F.col("is_public_dependency")).alias("public"), some(F.col("is_project_owner")).alias("owner"),
        some(F.size("include_files") > 0).alias("includes"), some(F.size("conditional_symbols") > 0).alias("conditional"),
    )
    listed = lambda lead, c, most: F.when(F.size(c) > 0, F.concat(F.lit(lead), F.array_join(F.slice(c, 1, most), ", ")))
    hints = [
        F.when(F.col("layout"), "native ABI/layout surface symbol"), F.when(F.col("exported"), "native exported symbol"), listed("native ABI surface kind(s): ", "surfaces", 3),
        listed("native layout field(s): ", "fields", 5), listed("native build target(s): ", "targets", 3), F.when(F.col("public"), "Object Pascal public unit dependency surface"),
        F.when(F.col("owner"), "Object Pascal project ownership surface"), F.when(F.col("includes"), "Object Pascal include dependency surface"),
        F.when(F.col("conditional"), "Object Pascal conditional compilation surface"),
    ]
    return per.select("file_path", F.array_compact(F.array(*hints)).alias("hints"))


def file_risk(touched: DataFrame) -> DataFrame:
    """(file_path, n_symbols, n_impacted) -> with hints and risk."""
    hints = path_hints(F.col("file_path"))
    risk = F.when((F.col("n_symbols") >= 8) | is_high_risk(F.col("file_path")), "HIGH").when((F.col("n_symbols") >= 3) | (F.col("n_impacted") > 0) | (F.size(hints) > 0), "MEDIUM").otherwise("LOW")
    return touched.withColumn("hints", F.array_join(hints, ",")).withColumn("risk", risk)


def change_risk(files: DataFrame) -> DataFrame:
    """file_risk's rows -> one row: totals, points and labels of the whole change."""
    one = files.agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("n_symbols"), F.lit(0)).alias("symbols"), F.coalesce(F.sum("n_impacted"), F.lit(0)).alias("impacted"),
        F.count_if(F.col("risk") == "HIGH").alias("high"), F.count_if(F.col("risk") == "MEDIUM").alias("medium"),
    )
    points = F.least(2 * F.col("files"), F.lit(50)) + F.least(F.col("symbols"), F.lit(60)) + F.least(F.floor(F.col("impacted") / 2), F.lit(40)) + 10 * F.col("high") + 4 * F.col("medium")
    label = F.when(F.expr("files >= 25 or symbols >= 100 or impacted >= 50"), "CRITICAL").when(F.expr("high > 0 or symbols >= 8 or impacted >= 12"), "HIGH").when(F.expr("medium > 0 or symbols >= 3 or impacted >= 5"), "MEDIUM").otherwise("LOW")
    one = one.withColumn("points", points.cast("long")).withColumn("risk", label)
    return one.withColumn("points_label", F.when(F.col("points") >= 100, "CRITICAL").when(F.col("points") >= 55, "HIGH").when(F.col("points") >= 20, "MEDIUM").otherwise("LOW"))


#: What each finding adds to the points of a change. Fixed values.
POINTS = {"routes": 12, "consumers": 5, "mismatches": 35, "processes": 6, "high_processes": 10, "embedded": 12}


def explained(changes: DataFrame) -> DataFrame:
    """Rows (files, symbols, impacted, high, medium, embedded, warned, capped), one for each change -> with reasons and confidence.

    warned: something was incomplete; capped: only a traversal was cut short.
    """
    count = lambda c, text: F.concat(F.col(c).cast("string"), F.lit(text))
    reasons = F.array_compact(F.array(
        count("files", " files changed"), count("symbols", " indexed symbols changed"), count("impacted", " graph-impacted files detected"),
        F.when(F.col("high") > 0, count("high", " changed files have high-risk characteristics")).when(F.col("medium") > 0, count("medium", " changed files have medium-risk characteristics")),
        F.when(F.col("files") >= 25, "25+ changed files escalates whole-tree risk"), F.when(F.col("symbols") >= 100, "100+ changed symbols escalates whole-tree risk"),
        F.when(F.col("impacted") >= 50, "50+ impacted files indicates broad graph blast radius"), F.when(F.col("embedded") > 0, count("embedded", " embedded-C sensitive file(s) changed")),
    ))
    level = F.when(F.col("warned") & F.col("capped"), "medium").when(F.col("warned"), "low").when((F.col("files") > 0) & (F.col("symbols") == 0), "low")
    level = level.when((F.col("files") > 0) & (F.col("impacted") == 0), "medium").when(F.col("symbols") > 0, "high").otherwise("medium")
    return changes.withColumn("reasons", F.array_join(reasons, "; ")).withColumn("confidence", level)


def weighted_points(changes: DataFrame) -> DataFrame:
    """Rows (files, symbols, impacted, high, medium) and the columns of POINTS, one for each change -> with points and their label."""
    points = F.least(2 * F.col("files"), F.lit(50)) + F.least(F.col("symbols"), F.lit(60)) + F.least(F.floor(F.col("impacted") / 2), F.lit(40)) + 10 * F.col("high") + 4 * F.col("medium")
    for c, each in POINTS.items():
        points = points + each * F.col(c)
    points = points.cast("long")
    return changes.withColumn("points", points).withColumn("label", F.when(points >= 100, "CRITICAL").when(points >= 55, "HIGH").when(points >= 20, "MEDIUM").otherwise("LOW"))


def missing_keys(consumed: DataFrame, provided: DataFrame) -> DataFrame:
    """(route, keys) on both sides -> route, missing keys as text, status and risk."""
    both = consumed.groupBy("route").agg(F.array_distinct(F.flatten(F.collect_list("keys"))).alias("want"), F.count(F.lit(1)).alias("consumers")).join(provided, "route", "left")
    missing = F.sort_array(F.array_except("want", F.coalesce("keys", F.col("want"))))
    out = both.select("route", "consumers", F.array_join(missing, ",").alias("missing"))
    status = F.when(F.col("missing") == "", "OK").otherwise("MISMATCH")
    return out.withColumn("status", status).withColumn("risk", F.when((status == "MISMATCH") | (F.col("consumers") >= 5), "HIGH").when(F.col("consumers") > 0, "MEDIUM").otherwise("LOW"))


def stale_files(files: DataFrame, runs: DataFrame) -> DataFrame:
    """Files changed after the last good run."""
    last = runs.where("status = 'ok'").agg(F.max("finished").alias("__last"))
    return files.join(F.broadcast(last)).where("__last is null or modified_time > __last").drop("__last")
