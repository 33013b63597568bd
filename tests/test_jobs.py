"""Jobs, the watcher, the diff cache, reviews and summaries, and what the new operators do with awkward cases."""

import threading

import pytest
from pyspark.sql import functions as F

from gneiss.functions import scalar as S
from gneiss.operators import change, contracts, questions, resolution, search, slices, store
from gneiss.plans import investigation, jobs, tools


def test_jobs_outlive_their_session(spark, tmp_path):
    began, go = threading.Event(), threading.Event()

    def runner(target, full):
        began.set()
        go.wait(30)
        if target == "bad":
            raise ValueError("no such place")
        return {"changed": 2, "deleted": 0, "unchanged": 1}

    all_jobs = jobs.Jobs(spark, f"file://{tmp_path}/jobs", runner)
    first = all_jobs.start("here")
    assert began.wait(30) and all_jobs.start("here") == first  # one at a time for a target
    second = all_jobs.start("bad", full=True)
    go.set()
    assert all_jobs.wait(first, 60) == "ok" and all_jobs.wait(second, 60) == "failed"
    later = jobs.Jobs(spark, f"file://{tmp_path}/jobs", runner)
    assert (later.status(first), later.status(second), later.status("x")) == ("ok", "failed", "not_found")
    assert {(x.root, x.mode, x.message) for x in later.rows().collect()} == {("here", "incremental", "changed 2, deleted 0, unchanged 1"), ("bad", "full", "no such place")}
    later._save({"job_id": "gone", "root": "r", "mode": "full", "status": "running", "queued": 1.0, "started": 1.0, "finished": None, "message": ""})
    assert later.status("gone") == "lost"


def test_watcher_waits_for_quiet(spark):
    state, runs, told = {"a": 1.0, "b": 1.0}, [], []
    watcher = jobs.Watcher(lambda: spark.createDataFrame(list(state.items()), "path string, modified_time double"), lambda paths: runs.append(sorted(paths)) or 0, idle=0.01, notify=told.append)
    assert watcher.idle == jobs.LEAST_IDLE and not watcher.step(0.0)
    state.update(a=2.0)
    assert not watcher.step(1.0) and watcher.stats["pending"] == 1
    state.update(c=1.0)
    del state["b"]
    assert not watcher.step(1.1)  # still changing
    assert watcher.step(2.0) and runs == [["a", "b", "c"]] and watcher.stats == {"known": 2, "pending": 0, "runs": 1, "last_code": 0, "running": False}
    assert not watcher.step(9.0) and told[-1]["runs"] == 1

    def fails(paths):
        raise RuntimeError

    watcher.run = fails
    state.update(a=3.0)
    watcher.step(10.0)
    assert watcher.step(11.0) and watcher.stats["last_code"] == 1 and watcher.pending == {"a"}


def test_diff_cache_ages():
    now, texts = [0.0], iter(["one", "two"])
    cache = jobs.DiffCache(lambda scope: next(texts), clock=lambda: now[0], wait=5.0)
    assert cache.get("all") == ("fresh", "one") and cache.get("all") == ("fresh", "one")
    now[0] = 16.0
    assert cache.get("all") == ("fresh", "two")
    slow = threading.Event()
    waiting = jobs.DiffCache(lambda scope: slow.wait(30) or "late", wait=0.05)
    assert waiting.get("x") == ("pending", None)
    slow.set()


def test_reviews_and_summary(spark):
    tries = []

    def flaky(units):
        tries.append(1)
        if len(tries) < 3:
            raise RuntimeError("timeout")
        return units.select("file_path", F.lit("high").alias("severity"), F.lit("Long").alias("title"), F.lit(0.9).alias("confidence"))

    units = spark.createDataFrame([("a.py",), ("b.py",)], "file_path string")
    found = jobs.review(units, {"flaky": flaky}, pause=0.0)
    assert len(tries) == 3 and found.count() == 2
    with pytest.raises(ValueError):
        jobs.review(units, {"broken": lambda u: (_ for _ in ()).throw(ValueError("no"))})
    findings = spark.createDataFrame([("f1", "a.py", "low", "T", 0.5, 1, 3.0), ("f2", "a.py", "critical", "t", 0.4, 2, 1.0), ("f3", "b.py", "high", "U", 0.9, 1, 2.0)], "fingerprint string, file_path string, severity string, title string, confidence double, occurrence_count int, last_seen double")
    assert [x.fingerprint for x in jobs.review_history(findings).collect()] == ["f2", "f3", "f1"]
    assert [x.fingerprint for x in jobs.review_history(findings, "a.py", 1).collect()] == ["f2"]
    runs = spark.createDataFrame([(1.0, 2.0, "ok"), (3.0, 4.0, "failed")], "started double, finished double, status string")
    summary = jobs.run_summary(runs, findings)
    assert summary["run"]["status"] == "failed" and summary["severities"] == {"low": 1, "critical": 1, "high": 1}
    assert [(x["file_path"], x["severity"]) for x in summary["top"]] == [("a.py", "critical"), ("b.py", "high")]
    assert "1. **critical** t (a.py)" in jobs.summary_markdown(summary)
    assert jobs.run_summary(runs.limit(0), findings.limit(0)) == {"run": None, "severities": {}, "top": []}


def test_path_rules(spark):
    """Each kind of path, and names that only look like one."""
    cases = {
        "a/Start.S": ["embedded/native assembly startup or include path"], "p30f4011.h": ["device/vendor register header", "public/native header surface"], "my/vector_store.py": [], "fw/vectors.c": ["interrupt/trap/startup path", "native implementation file"],
        "src/trap/x.go": [], "x/reset_all.py": ["interrupt/trap/startup path"], "X\\Controllers\\A.cs": ["C# public route/API path"], "a/latest.py": [], "a/flash/x.py": [], "a/myflash.py": ["embedded peripheral/init/flash path"], "q/api/db1.py": ["public route/API path", "database/repository path"],
    }
    got = spark.createDataFrame([(x,) for x in cases], "p string").select("p", change.path_hints(F.col("p")).alias("h")).collect()
    assert {x.p: x.h for x in got} == cases


def test_resolution_stages(spark):
    """The order of the stages, each with one case."""
    columns = "qualified_name string, name string, kind string, file_path string, start_line int, exported boolean, default_export boolean"
    symbols = spark.createDataFrame([
        ("m.f", "f", "function", "m.ts", 1, True, False), ("n.f", "f", "function", "n.ts", 1, False, False), ("n.D", "D", "class", "n.ts", 2, False, True), ("m.only", "only", "function", "m.ts", 5, False, False), ("x.value", "value", "function", "x.ts", 1, False, False),
        ("u.Click", "Click", "procedure", "u.pas", 1, False, False), ("v.Click", "Click", "procedure", "v.pas", 1, False, False), ("here.g", "g", "function", "here.ts", 9, False, False), ("here.g2", "g", "function", "here.ts", 3, False, False), ("w.g", "g", "function", "w.ts", 1, False, False),
    ], columns)
    linked = spark.createDataFrame([("here.ts", "n.ts"), ("form.dfm", "v.pas")], "file_path string, associated string")
    refs = [
        ("f", "CALLS", "here.ts", "typescript", {}, "n.f"),  # the only one in associated files
        ("g", "CALLS", "here.ts", "typescript", {}, "here.g2"),  # the first of the same file
        ("ali", "CALLS", "else.ts", "typescript", {"ali": "only"}, "m.only"),  # by its alias
        ("f", "CALLS", "else.ts", "typescript", {}, None),  # ambiguous
        ("pkg.only", "REFERENCES", "else.ts", "typescript", {}, "m.only"),  # by its tail
        ("value", "REFERENCES", "else.ts", "typescript", {}, None),  # noise
        ("value", "CALLS", "else.ts", "typescript", {}, "x.value"),
        ("default", "IMPORTS", "here.ts", "typescript", {}, "n.D"),
        ("ns.f", "CALLS", "here.ts", "typescript", {"ns": "__namespace__"}, None),  # not exported there
        ("Click", "CALLS", "form.dfm", "object_pascal_form", {}, "v.Click"),
        ("lib/w", "IMPORTS", "else.ts", "typescript", {}, "w.g"),  # by the file's stem
        ("nothing", "CALLS", "else.ts", "typescript", {}, None), ("only", "CALLS", "m.ts", "typescript", {}, "m.only"),
    ]
    rows = spark.createDataFrame([("src", f, lang, rel, raw, aliases) for raw, rel, f, lang, aliases, _ in refs], "source string, file_path string, language string, relation string, raw string, aliases map<string,string>")
    got = {(x.raw, x.relation, x.file_path): x.target for x in resolution.resolve(rows, symbols, linked).collect()}
    assert got == {(raw, rel, f): want for raw, rel, f, _, _, want in refs}
    assert resolution.resolve(rows.limit(0), symbols.limit(0), linked.limit(0)).count() == 0


def test_hybrid_search_puts_the_backend_first(spark):
    """A symbol and word hit outranks a test's word hit, sources are sets, and nothing is found in nothing."""
    symbols = spark.createDataFrame([("svc.load_items", "load_items", "function", "backend/items.py", 1, 9), ("cli.main", "main", "function", "tools/run.py", 1, 5)], "qualified_name string, name string, kind string, file_path string, start_line int, end_line int")
    chunks = spark.createDataFrame([("c1", "backend/items.py", "svc.load_items", 1, 9, "def load_items(): items"), ("c2", "tests/test_items.py", "t", 1, 5, "load_items items"), ("c3", "backend/items.py", "svc.rest", 10, 30, "nothing")], "chunk_id string, file_path string, qualified_name string, start_line int, end_line int, content string")
    edges = spark.createDataFrame([("cli.main", "CALLS", "svc.load_items")], "source string, relation string, target string")
    vectors = spark.createDataFrame([("c1", [1.0, 0.0]), ("c2", [0.0, 1.0])], "chunk_id string, vector array<double>")
    got = search.hybrid_search(["load_items"], symbols, chunks, edges, 10, vectors, [1.0, 0.1]).collect()
    assert got[0].name == "svc.load_items" and got[0].file_path == "backend/items.py" and {"chunk", "regex", "symbol", "vector"} <= set(got[0].sources)
    assert {"cli.main"} <= {x.name for x in got if "graph" in x.sources} and any("window" in x.sources for x in got)
    assert [x.score for x in got if x.file_path.startswith("tests/")][0] < got[0].score
    assert search.hybrid_search(["zzz"], symbols, chunks, edges).count() == 0


def test_awkward_rows(spark):
    none = spark.createDataFrame([(1, None), (2, ""), (3, "Show ME the page filter, show it")], "id int, text string")
    got = {x.id: x for x in questions.rewritten(none).collect()}
    assert got[1].intent == got[2].intent == "general" and got[1].seeds == [] and got[3].intent == "ui_ownership"
    empty = spark.createDataFrame([], "file_path string, route string, risk string, n_tests long, n_consumers long, n_fields long, n_processes long, n_mismatches long")
    assert slices.readiness(slices.validated(slices.slices(empty))).first().status == "ready"
    sign = spark.createDataFrame([("def f(self, a, b=1) -> int:",), ("f()",), ("",)], "s string").select(S.parameter_count(F.col("s")).alias("n"), S.return_type(F.col("s")).alias("r")).collect()
    assert [(x.n, x.r) for x in sign] == [(2, "int"), (0, ""), (0, "")]
    lead = store.leading_lines(spark.createDataFrame([("a", "g", 3), ("a", "h", 1)], "file_path string, qualified_name string, start_line int"), spark.createDataFrame([("a", "# one\n@two\ndef g(): pass")], "path string, text string"))
    assert {x.qualified_name: x.first_line for x in lead.collect()} == {"g": 1, "h": 1}
    route = spark.createDataFrame([("//a/b/",), ("",)], "r string").select(contracts.route_node(F.col("r")).alias("n")).collect()
    assert [x.n for x in route] == ["route:/a/b", "route:/"]


def test_tools_run_their_operators(spark):
    files = spark.createDataFrame([("src/app/items.py", "def load():\n    return 1\n"), ("tests/test_items.py", "load()"), ("src/b.py", "x")], "path string, text string")
    symbols = spark.createDataFrame([("app.load", "load", "function", "src/app/items.py", 1, 2), ("t.case", "case", "function", "tests/test_items.py", 1, 1), ("b.go", "go", "function", "src/b.py", 1, 1)], "qualified_name string, name string, kind string, file_path string, start_line int, end_line int")
    chunks = spark.createDataFrame([("c1", "src/app/items.py", "app.load", 1, 2, "def load(): return 1"), ("c2", "src/b.py", "b.go", 1, 1, "x")], "chunk_id string, file_path string, qualified_name string, start_line int, end_line int, content string")
    edges = spark.createDataFrame([("t.case", "CALLS", "app.load"), ("app.load", "CALLS", "b.go")], "source string, relation string, target string")
    steps = spark.createDataFrame([(1, 0, "t.case"), (1, 1, "app.load")], "process_id int, step int, symbol string")
    handlers = spark.createDataFrame([("/items", "src/app/items.py")], "route string, file_path string")
    run = lambda name, *a, **k: tools.TOOLS[name].run(*a, **k)
    assert {(x.side, x.node) for x in run("get_callers_and_callees", edges, "app.load").collect()} == {("caller", "t.case"), ("callee", "b.go")}
    assert {(x.side, x.samples) for x in run("get_dependencies", edges, "app.load").collect()} == {("caller", "t.case"), ("callee", "b.go")}
    assert {(x.from_file, x.to_file) for x in run("get_file_dependencies", edges, symbols, "src/b.py").collect()} == {("src/app/items.py", "src/b.py")}
    assert [x.content for x in run("get_source_context", files, chunks, "src/app/items.py", 2, 2).collect()] == ["    return 1"]
    assert run("find_tests_for_target", "app.load", files, symbols, edges).first().file_path == "tests/test_items.py"
    processes = spark.createDataFrame([(1, ["t.case", "app.load", "b.go"])], "process_id int, steps array<string>")
    assert run("list_processes", processes, "LOAD").count() == 1 and run("symbol_process_participation", processes, "b.go").first().role == "terminal"
    answer = run("investigate_codebase", "Where is load handled in items.py?", files, symbols, chunks, edges, handlers, steps)
    assert answer["intent"] == "location" and answer["target"] == "app.load" and answer["confidence"] == "high" and answer["files"][0]["file_path"] == "src/app/items.py"
    assert investigation.investigate("", files, symbols, chunks, edges, handlers, steps)["confidence"] == "low"
    context = run("unified_context", "load", symbols, edges, chunks)
    assert context["symbol"]["qualified_name"] == "app.load" and {x["node"] for x in context["neighbours"]} == {"t.case", "b.go"}
    feature = run("feature_context", "load items", symbols, chunks, symbols.where("name = 'case'"))
    assert feature.first().file_path == "src/app/items.py" and run("feature_context", "", symbols, chunks, symbols).count() == 0
    assert len(tools.TOOLS) >= 64


def test_repositories_and_blocks(spark, tmp_path):
    for name in ("a/.git", "b/c/deep/.git", "b/d"):
        (tmp_path / name).mkdir(parents=True)
    (tmp_path / "b" / "d" / "manifest.json").write_text("{}")
    assert {(x.repo, x.is_indexed) for x in jobs.discover_repositories(spark, f"file://{tmp_path}").collect()} == {("a", False), ("deep", False), ("d", True)}
    once = jobs.with_block("# Notes\n", "one")
    assert jobs.with_block(once, "two") == once.replace("one", "two") and once.startswith("# Notes\n\n") and jobs.with_block("", "x").startswith(jobs.BEGIN)
