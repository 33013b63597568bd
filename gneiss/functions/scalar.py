"""Scalar expressions shared by the operators; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extension -> language, and whole file name -> language. Fixed values.
LANGUAGES = {
    "py": "python", "ts": "typescript", "tsx": "tsx", "js": "typescript", "jsx": "tsx", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp",
    "s": "assembly", "asm": "assembly", "inc": "assembly_include", "cs": "csharp", "java": "java", "csproj": "csharp_project", "sln": "csharp_solution", "vcxproj": "native_project",
    "mcp": "mplab_project", "mcw": "mplab_workspace", "mptags": "mplab_tags", "scl": "mplab_script", "plt": "mplab_plot", "pas": "object_pascal", "pp": "object_pascal",
    "dpr": "object_pascal_project", "dpk": "object_pascal_package", "lpr": "object_pascal_project", "lfm": "object_pascal_form", "dfm": "object_pascal_form", "dproj": "object_pascal_project",
    "groupproj": "object_pascal_project", "lpi": "object_pascal_project", "lpk": "object_pascal_package", "cmake": "native_build", "json": "json", "rb": "ruby", "go": "go", "rs": "rust",
    "php": "php", "swift": "swift", "kt": "kotlin", "kts": "kotlin", "scala": "scala", "dart": "dart", "lua": "lua", "r": "r", "m": "objective_c", "mm": "objective_cpp", "ex": "elixir",
    "exs": "elixir", "erl": "erlang", "hrl": "erlang", "fs": "fsharp", "fsx": "fsharp", "vb": "vbnet", "sh": "shell", "bash": "shell", "zsh": "shell", "ps1": "powershell", "sql": "sql",
    "html": "html", "css": "css", "scss": "scss", "vue": "vue", "svelte": "svelte", "xml": "xml", "yaml": "yaml", "yml": "yaml", "toml": "toml",
}
FILE_NAMES = {
    "compile_commands.json": "native_build", "cmakelists.txt": "native_build", "makefile": "native_build", "dockerfile": "dockerfile", "gemfile": "ruby_project", "rakefile": "ruby_project",
    "go.mod": "go_project", "cargo.toml": "rust_project", "composer.json": "php_project", "pubspec.yaml": "dart_project", "mix.exs": "elixir_project", "package.swift": "swift_project",
}
#: Parts of a path that mark a test. Fixed values.
TEST_MARKERS = ("/test/", "/tests/", "/__tests__/", "/spec/", "test_", "_test.", ".test.", ".spec.", "tests.")


def lookup(mapping: dict[str, str | float], key: Column) -> Column:
    """mapping[key], null where absent."""
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])[key]


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def module_of(path: Column) -> Column:
    """First path segment."""
    return F.substring_index(path, "/", 1)


def extension(path: Column) -> Column:
    return F.regexp_extract(F.lower(base_name(path)), r"\.([^.]+)$", 1)


def language_of(path: Column) -> Column:
    """By whole file name, else by extension; null if neither is known."""
    return F.coalesce(lookup(FILE_NAMES, F.lower(base_name(path))), lookup(LANGUAGES, extension(path)))


def tail(qualified_name: Column) -> Column:
    """What stands behind the last dot or double colon."""
    return F.regexp_extract(qualified_name, r"([^.:]*)$", 1)


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for a glob of *, ? and literals."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else c if c.isalnum() or c in "_/" else "\\" + c for c in pattern) + "$"


def matches_glob(path: Column, pattern: str) -> Column:
    """The whole path, or any part behind a slash, matches."""
    return path.rlike(glob_regex(pattern)) | path.rlike(glob_regex("*/" + pattern))


def is_test_path(path: Column) -> Column:
    low = F.concat(F.lit("/"), F.lower(path))
    return F.exists(F.array(*[F.lit(x) for x in TEST_MARKERS]), lambda m: F.contains(low, m))


def tokens(text: Column) -> Column:
    """Distinct lower-case tokens of letters and digits; camel case is cut."""
    cut = F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1 $2")
    return F.array_distinct(F.filter(F.split(F.lower(cut), r"[^a-z0-9]+"), lambda x: x != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; two empty ones are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def normal_route(route: Column) -> Column:
    """One leading slash, no query or fragment, no /api prefix, no trailing slash."""
    bare = F.regexp_replace(route, r"[?#].*$", "")
    bare = F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(bare, r"^[a-z]+://[^/]*", ""), r"^/+", ""))
    bare = F.regexp_replace(bare, r"^/api(/|$)", "/")
    bare = F.regexp_replace(bare, r"(.)/+$", "$1")
    return bare


def is_minified(text: Column, least_bytes: int = 5000, most_lines: int = 20, longest: int = 2000) -> Column:
    """Large, of few lines, and with a very long one."""
    lines = F.split(text, "\n")
    return (F.octet_length(text) >= least_bytes) & (F.size(lines) <= most_lines) & (F.array_max(F.transform(lines, F.length)) >= longest)


def parameter_count(signature: Column) -> Column:
    """Parameters between the first parentheses, self and cls not counted."""
    inner = F.regexp_extract(signature, r"\(([^()]*)\)", 1)
    names = F.transform(F.split(inner, ","), lambda x: F.trim(x))
    return F.size(F.filter(names, lambda x: (x != "") & ~x.isin("self", "cls")))


def return_type(signature: Column) -> Column:
    """What stands behind the arrow of a signature, empty if nothing does."""
    return F.trim(F.regexp_extract(signature, r"->\s*([^:{]+)", 1))


def unique_capped(values: Column, most: int) -> Column:
    """The first most distinct values that aren't blank, in their order."""
    return F.slice(F.array_distinct(F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x != "")), 1, most)


def any_in(text: Column, *parts: str) -> Column:
    """Whether text contains one of the parts."""
    return F.exists(F.array(*[F.lit(x) for x in parts]), lambda x: F.contains(text, x))


def joined(values: Column) -> Column:
    """An array of strings as sorted text."""
    return F.array_join(F.sort_array(values), ",")


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of numbers, as doubles."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
