"""Operators on tiny fixtures: caps, ties, cycles, empty frames, parsers, sources and streams."""

import json
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from gneiss.functions import scalar as S
from gneiss.operators import change, communities, graph, parsers, relational, retrieval, text
from gneiss.operators.batching import semantic_chunks, token_batches
from gneiss.plans import tools
from gneiss.sources import files as sources
from gneiss.streaming import changes


def edges(spark, *pairs, relation="CALLS"):
    return spark.createDataFrame([(a, relation, b) for a, b in pairs], "source string, relation string, target string")


def nodes(spark, *names):
    return spark.createDataFrame([(x,) for x in names], "node string")


def test_reach_diamond_cycle_and_cap(spark):
    e = edges(spark, ("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("d", "e"))
    got = {x.node: (x.depth, x.parent) for x in graph.reach(e, nodes(spark, "a"), "down", 9).collect()}
    assert got == {"a": (0, None), "b": (1, "a"), "c": (1, "a"), "d": (2, "b"), "e": (3, "d")}
    hub = edges(spark, *[("h", f"n{i}") for i in range(9)])
    assert graph.reach(hub, nodes(spark, "h"), "down", 2, cap=3).count() == 4
    assert graph.reach(e.limit(0), nodes(spark, "a"), "both", 3).count() == 1
    assert graph.reach(e, nodes(spark), "down", 3).count() == 0


def test_paths_and_cycles(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("b", "a"), ("c", "d"))
    got = {">".join(x.path) for x in graph.paths(e, nodes(spark, "a"), 5, 8).collect()}
    assert got == {"a>b>c>d"}
    assert {">".join(x.path) for x in graph.cycles(e, 4).collect()} == {"a>b>c", "a>b"}
    assert graph.cycles(e.limit(0), 3).count() == 0


def test_two_triangles(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("a", "c"), ("d", "e"), ("e", "f"), ("d", "f"))
    adjacent = graph.adjacency(e, ["CALLS"])
    labels = graph.label_propagation(adjacent, 5)
    assert {x.node: x.label for x in labels.collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "d"}
    assert {(x.label, x.size, x.cohesion) for x in graph.cohesion(adjacent, labels).collect()} == {("a", 3, 1.0), ("d", 3, 1.0)}
    groups = {x.node: x.community for x in communities.communities(adjacent).collect()}
    assert groups == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "d"}


def test_large_groups_are_split_without_loss():
    ring = {f"n{i:03}": [f"n{(i - 1) % 90:03}", f"n{(i + 1) % 90:03}"] for i in range(90)}
    parts = communities.split_large(list(ring), ring, most=20)
    assert max(map(len, parts)) <= 20 and sorted(x for p in parts for x in p) == sorted(ring)


def test_read_only_sql(spark):
    df = spark.range(3)
    assert relational.read_only_sql(spark, "select count(*) as n from t", t=df).first().n == 3
    for bad in ("drop table t", "select 1; select 2", "with x as (select 1) insert into t select * from x", "update t set a = 1"):
        with pytest.raises(ValueError):
            relational.read_only_sql(spark, bad, t=df)


@pytest.mark.parametrize(("n", "expected"), [(1, [(1, 1)]), (100, [(1, 100)]), (101, [(1, 100), (89, 101)]), (188, [(1, 100), (89, 188)]), (189, [(1, 100), (89, 188), (177, 189)])])
def test_chunk_windows(spark, n, expected):
    df = spark.createDataFrame([("f", "\n".join(f"line {i}" for i in range(n)))], "path string, text string")
    assert sorted((x.start_line, x.end_line) for x in text.chunks(df, 100, 12).collect()) == expected


def test_python_parser_survives_broken_files(spark):
    df = spark.createDataFrame([("a.py", "class A(B):\n    def m(self):\n        return f()\nasync def g(): pass\n"), ("b.py", "def ("), ("c.py", None)], "path string, text string")
    got = text.python_symbols(df)
    assert {(x.file_path, x.qualified_name, x.kind) for x in got.collect()} == {("a.py", "A", "class"), ("a.py", "A.m", "method"), ("a.py", "g", "async_function"), ("b.py", "", "parse_error")}
    assert ("A", "EXTENDS", "B") in {tuple(x) for x in text.parsed_edges(got.where("kind <> 'parse_error'")).collect()}


def test_diff_lines(spark):
    diff = "--- a/x.py\n+++ b/x.py\n@@ -1 +1,2 @@\n+a\n@@ -9,2 +10,0 @@\n-b\n--- a/gone\n+++ /dev/null\n@@ -1 +0,0 @@\n-x\n--- /dev/null\n+++ b/new.py\n@@ -0,0 +1 @@\n+n"
    got = text.diff_lines(sources.diff_source(spark, {"d": diff}))
    assert {(x.file_path, x.line) for x in got.collect()} == {("x.py", 1), ("x.py", 2), ("new.py", 1)}


def test_parsers(spark):
    found = {
        "csharp": ("namespace A;\npublic class C {\n  public int Go(int x) {\n", {("class", "A.C"), ("method", "A.Go")}),
        "pascal": ("unit U;\ntype T = class(X)\nprocedure T.Click;", {("module", "U"), ("class", "T"), ("method", "T.Click")}),
        "controller_routes": ('[Route("api/[controller]")]\npublic class CatsController {\n [HttpGet("{id}")]\n}', {("GET", "/api/cats/{id}")}),
        "response_keys": ('return {"a": 1, "b": {"c": 2}, "d": [{"z": 1}]}', {("key", "a"), ("key", "b"), ("key", "b.c"), ("key", "d")}),
        "consumer_keys": ("const data = await fetch('/x')\nconst { a } = data\nuse(data.m.x)", {("reads", "a"), ("reads", "m.x")}),
        "model_shapes": ("class A(BaseModel):\n    x: int\n", {("int", "A.x")}),
        "expanded_macros": ("#define A 1\n#define B (A+2)\n", {("macro", "A"), ("macro", "B")}),
        "compile_commands": ('[{"file": "a.c", "command": "cc -Iinc -DX=1 a.c"}]', {("include", "inc"), ("define", "X=1")}),
        "project": ('<ProjectReference Include="..\\B\\B.csproj" />', {("project_reference", "../B/B.csproj")}),
    }
    for name, (source, expected) in found.items():
        assert {(k, n) for _, k, n, *_ in parsers.PARSERS[name]("f", source)} == expected, name
    df = spark.createDataFrame([("a.json", "{"), ("b.json", "[]")], "path string, text string")
    assert [x.kind for x in parsers.parsed(df, "compile_commands").collect()] == ["parse_error"]


def test_folds(spark):
    rows = spark.createDataFrame([("f", i, t) for i, t in enumerate([5, 5, 5, 50, 1, 1, 1])], "g string, id long, tokens long")
    assert [x.batch for x in token_batches(rows, "g", 3, 12).orderBy("id").collect()] == [0, 0, 1, 2, 3, 3, 3]
    df = spark.createDataFrame([("f", "\n".join(["def a():", "x", "x", "def b():", "x", "def c():"]))], "path string, text string")
    assert sorted((x.start_line, x.end_line) for x in semantic_chunks(df, 3).collect()) == [(1, 3), (4, 6)]


def test_risk_paths(spark):
    df = spark.createDataFrame([("src/auth/login.py", 0, 0), ("docs/readme.md", 0, 0), ("app/config.py", 1, 0)], "file_path string, n_symbols int, n_impacted int")
    assert {x.file_path: x.risk for x in change.file_risk(df).collect()} == {"src/auth/login.py": "HIGH", "docs/readme.md": "LOW", "app/config.py": "MEDIUM"}
    assert change.change_risk(change.file_risk(df.limit(0))).first().risk == "LOW"


def test_upsert_and_cache(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (3, "e")], "k int, v string")
    assert sorted(map(tuple, relational.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "e")]
    hits, misses = relational.cache_lookup(new, old, "k")
    assert (hits.count(), misses.count()) == (1, 1)
    assert relational.upsert(old.limit(0), new.limit(0), ["k"]).count() == 0


def test_vectors(spark):
    base = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])], "id long, vector array<float>")
    assert [(x.query_id, x.id) for x in retrieval.knn(base.where("id = 1"), base, 1).collect()] == [(1, 2)]
    v = spark.range(1).select(retrieval.hash_vector(F.lit("x")).alias("v")).first().v
    assert len(v) == 32 and sum(x * x for x in v) == pytest.approx(1)


def test_globs_and_languages(spark):
    df = spark.createDataFrame([("src/a.min.js",), ("src/Dockerfile",), ("lib/x.TSX",), ("none",)], "p string")
    got = {x.p: (x.l, x.g) for x in df.select("p", S.language_of(F.col("p")).alias("l"), S.matches_glob(F.col("p"), "*.min.js").alias("g")).collect()}
    assert got == {"src/a.min.js": ("typescript", True), "src/Dockerfile": ("dockerfile", False), "lib/x.TSX": ("tsx", False), "none": (None, False)}


def test_scan_and_snapshots(spark, tmp_path):
    root = tmp_path / "repo"
    for name, body in {"app.py": "def hello(): pass\n", "node_modules/x.js": "1", ".git/y.py": "2", "sub/utils.py": "x = 1\n", "notes.xyz": "?", "big.min.js": "a" * 6000, "skip/z.py": "3"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)
    got = sources.scan_repository(spark, f"file://{root}", ignore=["skip/"])
    assert {(x.path, x.language, x.size_bytes) for x in got.collect()} == {("app.py", "python", 18), ("sub/utils.py", "python", 6)}
    table = sources.SnapshotTable(spark, f"file://{tmp_path}/files")
    table.overwrite(got.select("path", "sha256"))
    table.upsert(got.limit(1).select("path", F.lit("new").alias("sha256")), ["path"])
    table.delete(got.where("path = 'sub/utils.py'"), ["path"])
    assert table.versions() == [0, 1, 2] and table.read(0).count() == 2 and table.read().count() == 1
    sources.write_manifest(spark, f"file://{tmp_path}/manifest", {"b": 1, "a": [2]})
    assert sources.read_manifest(spark, f"file://{tmp_path}/manifest") == {"a": [2], "b": 1}


def test_debounced_stream(spark, tmp_path):
    source, seen = tmp_path / "in", []
    source.mkdir()
    stamps = [("r", "a.py", "2024-01-01T00:00:00Z"), ("r", "b.py", "2024-01-01T00:00:00.5Z"), ("r", "a.py", "2024-01-01T00:00:00.7Z"), ("r", "c.py", "2024-01-01T00:01:00Z"), ("r", "z.py", "2024-01-01T01:00:00Z")]
    for i, part in enumerate((stamps[:4], stamps[4:])):
        (source / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(("root", "path", "ts"), x))) for x in part))
        time.sleep(0.02)
    stream = spark.readStream.schema("root string, path string, ts timestamp").option("maxFilesPerTrigger", 1).json(f"file://{source}")
    bursts = changes.debounced(stream)
    query = changes.run_incrementally(bursts, lambda df, _: seen.extend(df.collect()), f"file://{tmp_path}/ck")
    query.awaitTermination(120)
    assert [(x.paths, x.changes) for x in sorted(seen, key=lambda x: x.first_ts)] == [(["a.py", "b.py"], 3), (["c.py"], 1)]


def test_symbol_relevance_against_difflib(spark):
    from difflib import SequenceMatcher

    names = ["red widget", "Red Widgets", "blue bolt", "", None]
    df = spark.createDataFrame([(x, "part") for x in names], "name string, kind string")
    got = {x.name: x.r for x in df.select("name", retrieval.matching_ratio(F.lower("name"), F.lit("red widget")).alias("r")).collect()}
    assert got == {x: SequenceMatcher(None, (x or "").lower(), "red widget").ratio() for x in names}
    scores = {x.name: x.s for x in df.select("name", retrieval.symbol_relevance(F.col("name"), F.col("kind"), "red widget").alias("s")).collect()}
    assert scores["red widget"] == 1.83 and scores["red widget"] > scores["Red Widgets"] > scores["blue bolt"]


def test_knn_in_blocks(spark, monkeypatch):
    base = spark.createDataFrame([(i, [float(i % 7) + 0.1, float(i % 5), float(i % 3)]) for i in range(40)], "id long, vector array<double>")
    whole = sorted(map(tuple, retrieval.knn(base.where("id % 4 = 0"), base, 3).collect()))
    monkeypatch.setattr(retrieval, "QUERIES_AT_ONCE", 3)
    assert sorted(map(tuple, retrieval.knn(base.where("id % 4 = 0"), base, 3).collect())) == whole and len(whole) == 30


def test_near_duplicates(spark):
    rng = random.Random(3)
    rows = []
    for k in range(60):  # near copies of ten vectors in seven files
        near = random.Random(k % 10)
        rows.append((f"c{k:02}", f"f{k % 7}", [near.gauss(0, 1) + rng.gauss(0, 0.25) for _ in range(16)]))
    rows += [("zero", "z", [0.0] * 16), ("null", "z", None), ("short", "z", [1.0]), ("short too", "y", [2.0])]

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))

    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] != b[1] and a[2] and b[2] and any(a[2]) and any(b[2]) and len(a[2]) == len(b[2]) and cosine(a[2], b[2]) >= 0.85}
    chunks = spark.createDataFrame(rows, "chunk_id string, file_path string, vector array<double>")
    for block in (7, 1000):
        got = [(x.left_id, x.right_id) for x in tools.TOOLS["detect_duplicate_code"].run(chunks, block=block).collect()]
        assert len(want) > 50 and len(got) == len(set(got)) and set(got) == want


def test_data_flow_keeps_to_its_relations(spark):
    edges = spark.createDataFrame([("a", "HAS_PROPERTY", "b"), ("b", "REFERENCES", "c"), ("a", "CALLS", "d"), ("e", "REFERENCES", "a")], "source string, relation string, target string")
    assert {x.node for x in tools.TOOLS["trace_data_flow"].run(edges, "a").collect()} == {"a", "b", "c"}
