"""Analyses as tasks: started in the background, watched, cancelled, and their results fetched."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import SparkSession

from simweave.config import KEPT_TASKS, AnalysisConfig
from simweave.plans.pipeline import Analysis, run
from simweave.sinks.report import collect_report, export_report, write_report, write_tables
from simweave.sources.pdf import scan_pdfs
from simweave.storage import scratch, written

FINISHED = ("Done", "Cancelled", "Failed")
#: Stages in order, with the share of the last 18 percent that each has reached.
STAGE_SHARE = {"Init": 0.0, "ReadingMeta": 0.0, "BuildingTextIndex": 0.04, "RecallingCandidates": 0.08, "ComparingText": 0.12, "GeneratingReport": 0.16}


@dataclass(frozen=True)
class Progress:
    """A snapshot of a task; everything is 0 at first."""

    stage: str = "Init"
    total_files: int = 0
    processed_files: int = 0
    total_pages: int = 0
    processed_pages: int = 0
    indexed_chunks: int = 0
    indexed_images: int = 0
    candidate_pairs: int = 0
    confirmed_pairs: int = 0
    confirmed_text_matches: int = 0
    confirmed_image_matches: int = 0
    groups: int = 0
    weak_groups: int = 0
    cache_hits: int = 0
    elapsed_seconds: float = 0.0
    eta_seconds: float | None = None
    message: str | None = None

    @property
    def percent(self) -> int:
        if self.stage == "Done":
            return 100
        read = self.processed_files / self.total_files if self.total_files else 0.0
        return min(99, round(82 * read + 100 * STAGE_SHARE.get(self.stage, 0.0)))


def eta(processed_pages: int, total_pages: int, elapsed: float) -> float | None:
    """Seconds left for the pages that are not read yet; None when there are none, or nothing to go by."""
    left = total_pages - processed_pages
    return left * elapsed / processed_pages if processed_pages > 0 and left > 0 else None


@dataclass
class _Record:
    progress: Progress = field(default_factory=Progress)
    result: dict | None = None
    cancelled: bool = False
    stop: Callable[[], None] | None = None
    created: float = field(default_factory=time.monotonic)


class TaskManager:
    """The tasks of this process. Of the finished ones the newest ``kept`` stay; active ones always do."""

    def __init__(self, kept: int = KEPT_TASKS):
        self._kept, self._lock, self._tasks = kept, threading.Lock(), {}

    def create(self, task_id: str | None = None) -> str:
        task_id = task_id or uuid.uuid4().hex
        with self._lock:
            self._tasks[task_id] = _Record()
        return task_id

    def update(self, task_id: str, **changes) -> None:
        with self._lock:
            if task_id in self._tasks:
                record = self._tasks[task_id]
                record.progress = replace(record.progress, **changes)

    def _end(self, task_id: str, stage: str, result: dict | None, message: str | None) -> None:
        self.update(task_id, stage=stage, message=message, eta_seconds=None)
        with self._lock:
            if task_id in self._tasks:
                self._tasks[task_id].result = result
            done = sorted((r.created, t) for t, r in self._tasks.items() if r.progress.stage in FINISHED)
            for _, t in done[: max(0, len(done) - self._kept)]:
                del self._tasks[t]

    def finish(self, task_id: str, result: dict) -> None:
        self._end(task_id, "Cancelled" if self.is_cancelled(task_id) else "Done", result, None)

    def fail(self, task_id: str, message: str) -> None:
        self._end(task_id, "Failed", None, message)

    def on_cancel(self, task_id: str, stop: Callable[[], None]) -> None:
        """What ends the work that the task is doing."""
        self._record(task_id).stop = stop

    def cancel(self, task_id: str) -> None:
        """Mark the task, and end the jobs that it is running; what it has finished is reported."""
        record = self._record(task_id)
        record.cancelled = True
        if record.stop:
            record.stop()

    def wait(self, task_id: str, seconds: float, on_progress: Callable[[Progress], None] | None = None, every: float = 0.8) -> Progress:
        """Look at a task until it has ended, or for so many seconds; tells each change."""
        end, last = time.monotonic() + seconds, None
        while True:
            now = self.progress(task_id)
            if on_progress and now != last:
                on_progress(now)
            if now.stage in FINISHED or time.monotonic() > end:
                return now
            last = now
            time.sleep(every)

    def is_cancelled(self, task_id: str) -> bool:
        """A task that isn't known counts as cancelled."""
        with self._lock:
            return task_id not in self._tasks or self._tasks[task_id].cancelled

    def _record(self, task_id: str) -> _Record:
        with self._lock:
            if task_id not in self._tasks:
                raise KeyError(f"no task {task_id}")
            return self._tasks[task_id]

    def progress(self, task_id: str) -> Progress:
        return self._record(task_id).progress

    def result(self, task_id: str) -> dict:
        found = self._record(task_id).result
        if found is None:
            raise KeyError(f"task {task_id} has no result")
        return found

    def __len__(self) -> int:
        return len(self._tasks)


TASKS = TaskManager()


def _watch_reading(counters: tuple, tell: Callable[..., None], ended: threading.Event, total: int) -> None:
    while not ended.wait(0.5):
        tell("ReadingMeta", processed_files=min(counters[0].value, total), processed_pages=counters[1].value)


def analyze_files(spark: SparkSession, config: AnalysisConfig, task_id: str, directory: str | None = None, tasks: TaskManager = TASKS, tables: str | None = None) -> dict:
    """Read the files of ``config.paths``, compare them and report; updates the task on the way.

    A cancelled task computes nothing more and reports what it has. With ``tables``, the whole
    result is written there as Parquet, from the executors. All written intermediate tables are deleted at the end.
    """
    began = time.monotonic()

    def stage(name: str, **changes) -> None:
        elapsed, now = time.monotonic() - began, tasks.progress(task_id)
        pages, total = changes.get("processed_pages", now.processed_pages), changes.get("total_pages", now.total_pages)
        tasks.update(task_id, stage=name, elapsed_seconds=elapsed, eta_seconds=eta(pages, total, elapsed), **changes)

    with scratch(spark):
        stage("ReadingMeta", total_files=len(config.paths))
        counters = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
        ended = threading.Event()
        watcher = threading.Thread(target=_watch_reading, args=(counters, stage, ended, len(config.paths)), daemon=True)
        watcher.start()
        try:
            files, pages, images = (written(df, name) for df, name in zip(scan_pdfs(spark, list(config.paths), counters), ("files", "pages", "images"), strict=True))
        finally:
            ended.set()
            watcher.join()
        n, p = files.count(), pages.count()
        stage("BuildingTextIndex", total_files=n, processed_files=n, total_pages=p, processed_pages=p, indexed_images=images.count())
        analysis = Analysis(pages, files, config, images)
        stopped = False
        try:
            run(analysis, stage, lambda: tasks.is_cancelled(task_id))
            stopped = tasks.is_cancelled(task_id)
        except Exception:
            if not tasks.is_cancelled(task_id):
                raise
            stopped = True  # the job that was running was ended
        if "chunks" in analysis.__dict__:
            tasks.update(task_id, indexed_chunks=analysis.chunks.count())
        if not stopped:
            tasks.update(task_id, **analysis.run_totals().first().asDict())
            if tables:
                write_tables(analysis, tables, files)
        report = collect_report(analysis, files, task_id, done_only=stopped)
    if directory:
        try:
            report["report_path"] = write_report(report, directory)
        except OSError as e:
            report["warnings"].append(f"the report was not written: {e}")
    return report


def create_task(spark: SparkSession, config: AnalysisConfig, directory: str | None = None, tasks: TaskManager = TASKS) -> str:
    """Start an analysis in the background; its Spark jobs form a group named after the task."""
    config.validate()
    task_id = tasks.create()
    tasks.on_cancel(task_id, lambda: spark.sparkContext.cancelJobGroup(task_id))

    def work() -> None:
        spark.sparkContext.setJobGroup(task_id, "simweave analysis", interruptOnCancel=True)
        try:
            tasks.finish(task_id, analyze_files(spark, config, task_id, directory, tasks))
        except Exception as e:  # noqa: BLE001 - a failed task keeps its message
            if tasks.is_cancelled(task_id):
                tasks.finish(task_id, {"task_id": task_id, "files": [], "pairs": [], "groups": [], "warnings": ["cancelled while the files were read"]})
            else:
                tasks.fail(task_id, str(e))

    threading.Thread(target=work, daemon=True).start()
    return task_id


def export_task(task_id: str, directory: str, tasks: TaskManager = TASKS, **options) -> list[str]:
    return export_report(tasks.result(task_id), directory, **options)
