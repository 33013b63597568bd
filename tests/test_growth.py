"""Work that grows with the input: what is shuffled, and results against plain Python on shapes that are dear for pairs."""

import random
import re

import duckdb
import pytest

from gneiss.operators import batching, relational, retrieval, test_finding
from gneiss.operators import text as parsers_text
from gneiss.plans import catalog


@pytest.fixture
def shuffled(spark):
    """Records written to shuffles while a frame is computed, and its rows."""
    jvm = spark.sparkContext._jvm

    def records():
        store, quantiles = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(jvm.double, 0)
        stages = store.stageList(None, False, False, quantiles, jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    def run(make):
        before = records()
        rows = make().collect()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return records() - before, rows

    return run


def words(x):
    return {w for w in re.split("[^a-z0-9]+", re.sub("([a-z0-9])([A-Z])", r"\1 \2", x).lower()) if w}


@pytest.mark.parametrize("most", [0, 3, 50, 10_000])
def test_tests_by_words_equal_all_pairs(spark, monkeypatch, most):
    monkeypatch.setattr(test_finding, "RARE_PAIRS", most)
    monkeypatch.setattr(test_finding, "PAIRS_A_TASK", 7)
    seeds = [("a", "loadItems order"), ("a", "order x9"), ("b", ""), ("c", "x9 test py"), ("d", "nothing here"), *[(f"t{i}", f"app/part{i % 7} item{i} py") for i in range(30)]]
    tests = ["tests/test_order.py", "tests/load_items.ts", "tests/readme.txt", *[f"tests/item{i}/part{i % 5}.py" for i in range(0, 40, 3)]]
    got = test_finding.by_words(spark.createDataFrame(seeds, "target string, seed string"), spark.createDataFrame([(x,) for x in tests], "file_path string"))
    want = {}
    for target in {t for t, _ in seeds}:
        own = set().union(*(words(s) for t, s in seeds if t == target))
        for path in tests:
            if (n := len(own & words(path))) and not path.endswith("txt"):
                want[target, path] = n + 2
    rows = got.collect()
    assert {(x.target, x.file_path): x.score for x in rows} == want and len(rows) == len(want) and {x.reason for x in rows} == {"words"}


def test_tests_by_words_shuffle_no_pairs(spark, shuffled):
    seeds = spark.range(300).selectExpr("concat('app/a', id, '.py') as target", "concat('app/a', id, '.py') as seed")
    tests = spark.range(300).selectExpr("concat('tests/b', id, '.py') as file_path")
    n, rows = shuffled(lambda: test_finding.by_words(seeds, tests))
    assert len(rows) == 90_000 and n < 10_000


def test_enclosing_symbols_equal_all_pairs(spark):
    dice = random.Random(5)
    spans = [(None, 4), (3, None), (9, 2), (-8, 3), (0, 0), (1, 1_000_000), (-5, -5), (7, 7), (7, 8)] + [(a, a + dice.randrange(40)) for a in (dice.randrange(-60, 200) for _ in range(150))]
    symbols = [(f"q{i}" if i % 30 else None, dice.choice("abc"), a, b) for i, (a, b) in enumerate(spans)]
    frames = [(i, dice.choice(["a", "b", "c", "none", None]), dice.choice([None, *range(-70, 250)])) for i in range(400)] + [(7, "a", 3), (7, "b", 9), (None, "a", 5), (None, "b", 200)]
    last = lambda x: (x is None, x if x is not None else 0)
    want = {}
    for frame, path, line in frames:
        own = [x for x in symbols if x[1] == path] or [(None, None, None, None)]
        for q, _, a, b in own:
            inside = None not in (a, b, line) and a <= line <= b
            rank = (not inside, b - a if inside else 0, last(a), (q is None, q or ""))
            want[frame] = min(want.get(frame, (rank, None)), (rank, (q, a, b, inside)), key=lambda x: x[0]) if frame in want else (rank, (q, a, b, inside))
    f = spark.createDataFrame(frames, "frame_id int, file_path string, line int")
    got = relational.enclosing_symbols(f, spark.createDataFrame(symbols, "qualified_name string, file_path string, start_line int, end_line int"))
    rows = got.collect()
    assert {x.frame_id: (x.qualified_name, x.start_line, x.end_line, x.inside) for x in rows} == {k: v[1] for k, v in want.items()} and len(rows) == len(want)


def test_enclosing_symbols_shuffle_no_pairs(spark, shuffled):
    frames = spark.range(500).selectExpr("id as frame_id", "'a' as file_path", "cast(id as int) as line")
    symbols = spark.range(500).selectExpr("concat('q', id) as qualified_name", "'a' as file_path", "cast(id as int) as start_line", "cast(id + id % 50 as int) as end_line")
    n, rows = shuffled(lambda: relational.enclosing_symbols(frames, symbols))
    assert len(rows) == 500 and n < 20_000


def folded(rows, most_rows, most_tokens):
    """Batches row by row; an unknown number of tokens keeps the sum unknown up to the batch's end."""
    last = lambda x: (x is None, x if x is not None else 0)
    out, before = [], ()
    for g, i, tokens in sorted(rows, key=lambda x: tuple(map(last, x))):
        if before != (g,):
            batch, n, t, before = 0, 1, tokens, (g,)
        elif n >= most_rows or (None not in (t, tokens) and t + tokens > most_tokens):
            batch, n, t = batch + 1, 1, tokens
        else:
            n, t = n + 1, None if None in (t, tokens) else t + tokens
        out.append((g, i, batch))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [3, 40, 10_000])
def test_token_batches_over_blocks(spark, monkeypatch, block):
    dice = random.Random(block)
    rows = [(g, i, dice.choice([1, 2, 3, 5, 30, 0, None]) if g != "d" else 1) for g in ("a", "b", None, "d") for i in range(dice.randrange(50, 90))] + [("a", None, 2), ("s", 1, 99), ("u", 5, 1), ("u", 5, 1)]
    monkeypatch.setattr(batching, "BLOCK", block)
    df = spark.createDataFrame(rows, "g string, id bigint, tokens bigint").repartition(5)
    assert sorted((tuple(x) for x in batching.token_batches(df, "g", 6, 12).collect()), key=repr) == folded(rows, 6, 12)
    assert batching.token_batches(df.limit(0), "g", 6, 12).count() == 0


def test_diff_lines_of_one_diff_in_rows(spark, shuffled):
    text = "--- a/x\n+++ b/one.py\n@@ -1,2 +3,3 @@ def f\n+a\n@@ -1 +4,2 @@\n@@ -1 +9,0 @@\n+++ /dev/null\n@@ -1 +1 @@\n+++ two.py\n@@ -5,1 +7 @@" + "\n text" * 50
    df = spark.range(200).selectExpr("id as diff_id", f"'{text}' as text".replace("\n", "\\n")).union(spark.createDataFrame([(0, text), (500, "@@ -1 +2 @@"), (None, text), (None, None)], "diff_id bigint, text string"))
    n, rows = shuffled(lambda: parsers_text.diff_lines(df))
    want = {(i, p, x) for i in [*range(200), None] for p, x in (("one.py", 3), ("one.py", 4), ("one.py", 5), ("two.py", 7))}
    assert {tuple(x) for x in rows} == want and len(rows) == len(want) and n < 1000


def test_near_duplicates_are_sent_to_few_blocks(spark, monkeypatch, shuffled):
    monkeypatch.setattr(retrieval, "BLOCKS", 3)
    dice = random.Random(1)
    chunks = spark.createDataFrame([(i, f"f{i % 3}", [dice.choice([0.0, 1.0, 2.0]) for _ in range(4)]) for i in range(120)], "chunk_id bigint, file_path string, vector array<float>")
    n, rows = shuffled(lambda: retrieval.near_duplicates(chunks, 0.9, block=5))
    assert n < 120 * 4
    monkeypatch.setattr(retrieval, "BLOCKS", 1)
    whole = retrieval.near_duplicates(chunks, 0.9, block=1000).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, whole)) and rows


@pytest.mark.parametrize("name, most", [("t4_diff_context", 6_000), ("j11_untested", 2_000), ("g23_unified_graph", 15_000)])
def test_edges_are_shuffled_once_at_most(spark, sf_dir, shuffled, name, most):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20kb")  # as if the tables were large
    try:
        n, rows = shuffled(lambda: catalog.QUERIES[name](spark, sf_dir))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows and n < most


@pytest.mark.parametrize("name", "r24_tests_by_words t1_detect_changes t4_diff_context j11_untested g23_unified_graph s15_graph_delete w10_token_batches".split())
def test_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem documents".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, cursor = catalog.QUERIES[name](spark, sf_dir), con.execute(catalog.ORACLES[name])
    columns = [x[0] for x in cursor.description]
    assert sorted(map(repr, (tuple(x) for x in got.select(columns).collect()))) == sorted(map(repr, cursor.fetchall()))
