"""Index runs over a tiny repository: full, incremental, groups."""

from gneiss.plans import indexing


def write(root, files):
    for name, body in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)


def test_full_and_incremental_runs(spark, tmp_path):
    root, index = tmp_path / "repo", indexing.Index(spark, f"file://{tmp_path}/index")
    write(root, {"app.py": "def hello():\n    pass\n\ndef world():\n    hello()\n    add(1, 2)\n", "utils.py": "def add(a, b):\n    return a + b\n", "v.ts": "export function go() {}\n", "run.sh": "function start\n"})
    got = indexing.run(spark, f"file://{root}", index)
    assert (got["changed"], got["deleted"], got["unchanged"]) == (4, 0, 0)
    assert {x.qualified_name for x in index.read("symbols").collect()} == {"hello", "world", "add", "go", "start"}
    edges = {(x.source, x.relation, x.target) for x in index.read("edges").collect()}
    assert {("world", "CALLS", "hello"), ("world", "CALLS", "add"), ("app.py", "DEFINES", "world")} <= edges
    assert index.read("chunks").count() == 4 and index.read("vectors").count() == 4

    assert indexing.run(spark, f"file://{root}", index)["unchanged"] == 4
    (root / "utils.py").unlink()
    write(root, {"app.py": "def hello():\n    return 1\n"})
    got = indexing.run(spark, f"file://{root}", index)
    assert (got["changed"], got["deleted"], got["unchanged"]) == (1, 1, 2)
    assert {x.qualified_name for x in index.read("symbols").collect()} == {"hello", "go", "start"}
    assert index.read("chunks").count() == 3 and index.read("vectors").count() == 5
    assert indexing.recent_runs(index, 1).first().changed == 1
    assert {x.table: x.rows for x in indexing.status(index).collect()}["files"] == 3

    groups = indexing.Groups(spark, f"file://{tmp_path}/groups")
    assert groups.add("g", "a", index.root) == "ok" and groups.add("g", "a", index.root) == "exists" and groups.add("g", "b", index.root) == "ok"
    assert ("a:hello", "CROSS_REPO_MATCH", "b:hello") in {tuple(x) for x in groups.unified_graph("g").collect()}
    assert groups.remove("g", "b") == "ok" and groups.remove("g", "b") == "not_found"
