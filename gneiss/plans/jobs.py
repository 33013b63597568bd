"""Index jobs in the background, the change watcher that starts them, and what is kept between calls. Driver-side: all rows stay in Spark."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.plans import indexing
from gneiss.sources.files import SnapshotTable
from gneiss.streaming.changes import snapshot_changes

#: Seconds: least idle time and polling time, age of a cached diff, how long a caller waits for a fresh one, and between status events.
LEAST_IDLE, LEAST_POLL, DIFF_AGE, DIFF_WAIT, STATUS_EVERY = 0.25, 0.25, 15.0, 3.0, 5.0
_JOB = "job_id string, root string, mode string, status string, queued double, started double, finished double, message string"


class Jobs:
    """Index runs in threads, one at a time for each index; their states are a snapshot table and outlive the session."""

    def __init__(self, spark: SparkSession, root: str, runner: Callable[[str, bool], dict] | None = None):
        self.spark, self.table = spark, SnapshotTable(spark, root)
        self.runner = runner or (lambda target, full: indexing.run(spark, target, indexing.Index(spark, f"{root}/index"), full))
        self._threads: dict[str, threading.Thread] = {}
        self._lock, self._turn = threading.Lock(), threading.Lock()

    def rows(self) -> DataFrame:
        return self.table.read() if self.table.versions() else self.spark.createDataFrame([], _JOB)

    def _save(self, job: dict) -> None:
        with self._lock:
            row = self.spark.createDataFrame([tuple(job.values())], _JOB)
            self.table.upsert(row, ["job_id"])

    def start(self, target: str, full: bool = False) -> str:
        """Queues a run and returns its id; a target that is queued or running keeps its job."""
        with self._lock:
            running = next((k for k, t in self._threads.items() if t.is_alive() and t.name == target), None)
        if running:
            return running
        job = {"job_id": uuid.uuid4().hex[:16], "root": target, "mode": "full" if full else "incremental", "status": "queued", "queued": time.time(), "started": None, "finished": None, "message": ""}
        self._save(job)

        def work() -> None:
            with self._turn:
                job.update(status="running", started=time.time())
                self._save(job)
                try:
                    done = self.runner(target, full)
                    job.update(status="ok", message=", ".join(f"{k} {done[k]}" for k in ("changed", "deleted", "unchanged") if k in done))
                except Exception as e:  # a failed job is a state of its own, with its reason
                    job.update(status="failed", message=str(e)[:500])
                job["finished"] = time.time()
                self._save(job)

        thread = threading.Thread(target=work, name=target, daemon=True)
        self._threads[job["job_id"]] = thread
        thread.start()
        return job["job_id"]

    def wait(self, job_id: str, seconds: float | None = None) -> str:
        """The job's status after it ended, or after so many seconds."""
        if thread := self._threads.get(job_id):
            thread.join(seconds)
        return self.status(job_id)

    def status(self, job_id: str) -> str:
        """queued, running, ok, failed, lost (its session ended before it did) or not_found."""
        found = self.rows().where(F.col("job_id") == job_id).first()
        if found is None:
            return "not_found"
        alive = (thread := self._threads.get(job_id)) is not None and thread.is_alive()
        return found.status if found.status in ("ok", "failed") or alive else "lost"


@dataclass
class Watcher:
    """Polls a listing (path, modified_time), gathers changed paths, and calls run when nothing has changed for a while; runs never overlap."""

    listing: Callable[[], DataFrame]
    run: Callable[[set[str]], int]
    idle: float = 1.0
    poll: float = 1.0
    notify: Callable[[dict], None] = lambda event: None
    stats: dict = field(default_factory=lambda: {"known": 0, "pending": 0, "runs": 0, "last_code": None, "running": False})

    def __post_init__(self) -> None:
        self.idle, self.poll = max(self.idle, LEAST_IDLE), max(self.poll, LEAST_POLL)
        self.pending: set[str] = set()
        self._before: DataFrame | None = None
        self._changed_at, self._told_at = 0.0, 0.0
        self._stop, self._thread = threading.Event(), None

    def step(self, now: float) -> bool:
        """One poll at a time given in seconds; whether it ran the index. The first poll learns what is there."""
        seen = self.listing()
        rows = seen.select("path", F.col("modified_time").cast("double").alias("modified_time")).collect()  # the listing of one watched repository
        kept = seen.sparkSession.createDataFrame(rows, "path string, modified_time double")
        if self._before is not None:
            changed = {x.path for x in snapshot_changes(self._before, kept).collect()}
            if changed:
                self.pending |= changed
                self._changed_at = now
        self._before = kept
        ran = bool(self.pending) and now - self._changed_at >= self.idle
        if ran:
            batch, self.pending = self.pending, set()
            self.stats["running"] = True
            try:
                self.stats["last_code"] = self.run(batch)
            except Exception:
                self.stats["last_code"] = 1
                self.pending |= batch  # tried again with the next burst
                self._changed_at = now
            self.stats.update(runs=self.stats["runs"] + 1, running=False)
        self.stats.update(known=len(rows), pending=len(self.pending))
        if ran or now - self._told_at >= STATUS_EVERY:
            self._told_at = now
            self.notify(dict(self.stats))
        return ran

    def start(self) -> None:
        def loop() -> None:
            while not self._stop.is_set():
                self.step(time.monotonic())
                self._stop.wait(self.poll)

        if self._thread is None or not self._thread.is_alive():
            self._stop.clear()
            self._thread = threading.Thread(target=loop, name="watcher", daemon=True)
            self._thread.start()

    def stop(self) -> dict:
        self._stop.set()
        if self._thread is not None:
            self._thread.join()
        return dict(self.stats)


class DiffCache:
    """Diffs by scope: a fresh one is returned at once, an old one is read again in a thread for which the caller waits a bounded time."""

    def __init__(self, read: Callable[[str], str], age: float = DIFF_AGE, wait: float = DIFF_WAIT, clock: Callable[[], float] = time.monotonic):
        self.read, self.age, self.wait, self.clock = read, age, wait, clock
        self._kept: dict[str, tuple[float, str]] = {}
        self._threads: dict[str, threading.Thread] = {}

    def get(self, scope: str) -> tuple[str, str | None]:
        """(fresh, text), (stale, the text before) or (pending, None)."""
        if (kept := self._kept.get(scope)) and self.clock() - kept[0] <= self.age:
            return "fresh", kept[1]
        thread = self._threads.get(scope)
        if thread is None or not thread.is_alive():
            thread = threading.Thread(target=lambda: self._kept.__setitem__(scope, (self.clock(), self.read(scope))), daemon=True)
            self._threads[scope] = thread
            thread.start()
        thread.join(self.wait)
        now = self._kept.get(scope)
        if now and now is not kept:
            return "fresh", now[1]
        return ("stale", kept[1]) if kept else ("pending", None)


def review_history(findings: DataFrame, file_path: str = "", k: int = 50) -> DataFrame:
    """Findings of a file, or of all, the worst and latest first."""
    rank = F.array_position(F.array(*[F.lit(x) for x in ("low", "medium", "high", "critical")]), F.col("severity"))
    some = findings.where(F.col("file_path") == file_path) if file_path else findings
    return some.orderBy(rank.desc(), F.desc("last_seen"), F.asc("fingerprint")).limit(k)


def run_summary(runs: DataFrame, findings: DataFrame, k: int = 5) -> dict:
    """The last run, counts by severity and the k top findings: the worst, surest and most frequent of each area and title."""
    last = runs.orderBy(F.desc("finished")).limit(1).collect()
    rank = F.array_position(F.array(*[F.lit(x) for x in ("low", "medium", "high", "critical")]), F.col("severity"))
    order = F.struct(rank.alias("r"), "confidence", "occurrence_count", "fingerprint")
    best = findings.groupBy("file_path", F.lower("title").alias("key")).agg(F.max_by(F.struct("severity", "title", "confidence"), order).alias("f"), F.max(order).alias("o"))
    top = best.orderBy(F.desc("o"), F.asc("file_path")).limit(k).select("file_path", "f.*").collect()
    counts = {x.severity: x["count"] for x in findings.groupBy("severity").count().collect()}  # four severities
    return {"run": last[0].asDict() if last else None, "severities": counts, "top": [x.asDict() for x in top]}


def summary_markdown(summary: dict) -> str:
    """run_summary as a report."""
    lines = ["# Index run", ""]
    if run := summary["run"]:
        lines += [f"* {k}: {v}" for k, v in run.items()]
    lines += ["", "## Findings", "", *[f"* {k}: {n}" for k, n in sorted(summary["severities"].items())]]
    lines += ["", *[f"{i}. **{x['severity']}** {x['title']} ({x['file_path']})" for i, x in enumerate(summary["top"], 1)]]
    return "\n".join(lines) + "\n"


def review(units: DataFrame, reviewers: dict[str, Callable[[DataFrame], DataFrame]], tries: int = 3, pause: float = 0.5, is_passing: Callable[[Exception], bool] = lambda e: "timeout" in str(e).lower() or "429" in str(e)) -> DataFrame:
    """Findings (file_path, severity, title, confidence) of all reviewers over the units, with the reviewer's name.

    A reviewer is a function from units to findings; one that fails for a
    passing reason is tried again after a pause that doubles.
    """
    out = None
    for name, f in reviewers.items():
        for k in range(tries):
            try:
                found = f(units).select(F.lit(name).alias("reviewer"), "file_path", "severity", "title", "confidence")
                break
            except Exception as e:
                if k + 1 == tries or not is_passing(e):
                    raise
                time.sleep(pause * 2**k)
        out = found if out is None else out.unionByName(found)
    return out


def discover_repositories(spark: SparkSession, root: str, depth: int = 3) -> DataFrame:
    """repo, path, is_indexed: folders with an index manifest, and those with version control, up to so many levels below root."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    found, level = [], [root.rstrip("/")]
    for _ in range(depth + 1):
        below = []
        for folder in level:
            if not fs.exists(fs_path(folder)):
                continue
            names = {x.getPath().getName(): x.isDirectory() for x in fs.listStatus(fs_path(folder))}
            indexed = "manifest.json" in names
            if indexed or ".git" in names:
                found.append((folder.rsplit("/", 1)[-1], folder, indexed))
            below += [f"{folder}/{name}" for name, is_dir in sorted(names.items()) if is_dir and not name.startswith(".") and name not in ("node_modules", "__pycache__")]
        level = below
    return spark.createDataFrame(found, "repo string, path string, is_indexed boolean")


BEGIN, END = "<!-- index:begin -->", "<!-- index:end -->"


def with_block(text: str, block: str) -> str:
    """text with the marked block replaced, or put at its end; without markers nothing else changes."""
    marked = f"{BEGIN}\n{block.strip()}\n{END}"
    start, end = text.find(BEGIN), text.find(END)
    if 0 <= start < end:
        return text[:start] + marked + text[end + len(END) :]
    return (text.rstrip() + "\n\n" if text.strip() else "") + marked + "\n"
