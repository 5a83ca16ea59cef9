"""A whole run: scan a tree, keep its documentation, copy it, write index and reports."""

from __future__ import annotations

import os
import shutil
import signal
import tempfile
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.config import Config
from leafmill.operators import console, copyplan, predicates, reports, stats
from leafmill.sources import git_commits
from leafmill.sources.repo_files import scan_directory


class RunError(Exception):
    """A failure of one of the kinds in operators.messages."""

    def __init__(self, kind: str, detail: str = "") -> None:
        super().__init__(f"{kind}: {detail}")
        self.kind, self.detail = kind, detail


@dataclass(frozen=True)
class Repository:
    name: str
    owner: str = "local"
    url: str = ""
    default_branch: str = "main"
    total_commits: int = 0
    is_empty: bool = False


@dataclass(frozen=True)
class Run:
    """What a run did: where to, its numbers, its ledger of errors, and what the console shows of it."""

    output: str
    files: int
    bytes: int
    errors: tuple[str, ...]
    seconds: float
    summary: str = ""
    report: str = ""


@contextmanager
def cancellable(spark: SparkSession, tag: str) -> Iterator[Callable[[], None]]:
    """Jobs started inside can be stopped, from any thread, by the function given.

    A session's own tags are known to the thread that set them alone, so the context's are used besides.
    """
    context = spark.sparkContext
    spark.addTag(tag)
    context.addJobTag(tag)
    context.setInterruptOnCancel(True)
    try:
        yield lambda: context.cancelJobsWithTag(tag)
    finally:
        context.setInterruptOnCancel(False)
        context.removeJobTag(tag)
        spark.removeTag(tag)


@contextmanager
def interruptible(spark: SparkSession, tag: str, seconds: float | None = None, signals: tuple[signal.Signals, ...] = (signal.SIGINT, signal.SIGTERM)) -> Iterator[None]:
    """Jobs started inside are stopped at a deadline or by a signal; the body then ends with a RunError, of the first of these alone.

    Signals are heard where the body runs in the main thread; a second one interrupts Python itself.
    Jobs of others go on.
    """
    reasons: list[tuple[str, str]] = []
    over = threading.Event()
    deadline = None if seconds is None else time.monotonic() + seconds

    def heard(*_: object) -> None:
        if reasons:
            raise KeyboardInterrupt
        reasons.append(("cancelled", ""))

    def watch(stop: Callable[[], None]) -> None:
        while not over.wait(0.1):
            if not reasons and deadline is not None and time.monotonic() >= deadline:
                reasons.append(("timeout", f"{seconds:g}"))
            if reasons:
                stop()  # again and again, as the body may go on to another job

    main = threading.current_thread() is threading.main_thread()
    before = {s: signal.signal(s, heard) for s in signals} if main else {}
    try:
        with cancellable(spark, tag) as stop:
            watcher = threading.Thread(target=watch, args=(stop,), daemon=True)
            watcher.start()
            try:
                yield
            except RunError:
                raise
            except Exception as e:
                if reasons:
                    raise RunError(*reasons[0]) from e
                raise
            finally:
                over.set()
                watcher.join()
            if reasons and reasons[0][0] == "cancelled":  # the body swallowed it, or had no job left
                raise RunError(*reasons[0])
    finally:
        for s, handler in before.items():
            signal.signal(s, handler)


def described(spark: SparkSession, root: str, repository: Repository) -> Repository:
    """The repository with branch, commit count and emptiness of its checkout, if the tree is one."""
    try:
        found = git_commits.repositories(spark, {0: root}).first()
    except FileNotFoundError:
        return repository
    return replace(repository, default_branch=found["default_branch"], total_commits=found["total_commits"], is_empty=found["is_empty"])


def scan(spark: SparkSession, root: str, config: Config) -> DataFrame:
    """The documentation files of a tree; raises what a scan that finds none is due to."""
    if not os.path.isdir(root):
        raise RunError("invalid_path", root)
    found = scan_directory(spark, root, config.filters).cache()
    kept = predicates.documentation(found.where("error IS NULL"), config.filters)
    if kept.isEmpty():
        bad = found.where("error IS NOT NULL").first()
        raise RunError("permission", bad["source_path"]) if bad else RunError("no_documentation", ", ".join(config.filters.extensions))
    return kept


def scan_errors(spark: SparkSession, root: str, config: Config) -> DataFrame:
    """What the scan could not read."""
    return scan_directory(spark, root, config.filters).where("error IS NOT NULL").select("source_path", "error")


def check_writable(base: str) -> None:
    """Makes the base directory and writes a file there, for a moment, before any work is done."""
    try:
        os.makedirs(base, exist_ok=True)
        handle, probe = tempfile.mkstemp(prefix=".leafmill-write-test-", dir=base)
        os.close(handle)
        os.remove(probe)
    except OSError as e:
        raise RunError("permission", base) from e


def check_output(path: str, force: bool) -> None:
    """An output that is there is replaced only if ``force``."""
    if os.path.lexists(path) and not force:
        raise RunError("output_exists", path)


def write_lines(lines: DataFrame, path: str) -> None:
    """The report of one repository as a text file, line by line in order.

    Tasks write the parts, ranges of the order; the driver strings the parts together, and sees no line.
    """
    parts = f"{os.path.abspath(path)}.parts-{uuid.uuid4().hex}"
    try:
        # A line break inside a line is kept: the text sink ends each row by one more.
        lines.repartitionByRange("ordinal").sortWithinPartitions("ordinal").select("line").write.text(f"file://{parts}")
        with open(path, "wb") as whole:
            for name in sorted(x for x in os.listdir(parts) if x.startswith("part-")):
                with open(os.path.join(parts, name), "rb") as part:
                    shutil.copyfileobj(part, whole, 1 << 20)
    finally:
        shutil.rmtree(parts, ignore_errors=True)


def _identity(path: str) -> tuple[int, int] | None:
    """What tells a folder from another one of the same name."""
    try:
        found = os.stat(path)
    except FileNotFoundError:
        return None
    return found.st_dev, found.st_ino


def extract(
    spark: SparkSession, root: str, config: Config, repository: Repository, name: str, mode: str = "human", progress: Callable[[int, int], None] | None = None
) -> Run:
    """Copies the documentation of a tree to base_directory/name, with an index and three reports if the settings ask.

    ``progress`` is told of files and bytes while they are copied. What a run that fails has written is
    removed; an output that was there stays until the new one replaces it.
    """
    out = os.path.join(config.output.base_directory, name)
    catalog = scan(spark, root, config)
    check_writable(config.output.base_directory)
    check_output(out, config.output.force)
    before = _identity(out)
    try:
        return _write(spark, catalog, config, repository, out, mode, progress)
    except BaseException:
        if _identity(out) != before:
            shutil.rmtree(out, ignore_errors=True)
        raise


def _write(spark: SparkSession, catalog: DataFrame, config: Config, repository: Repository, out: str, mode: str, progress: Callable[[int, int], None] | None) -> Run:
    began = datetime.now(UTC)
    plan = copyplan.plan_copy(catalog, config.output.preserve_structure, config.output.force).cache()
    copied = copyplan.copy_files(plan, out, config.output.force, progress)
    written = copied.where("failure IS NULL").select(F.col("bytes_copied").alias("b"))
    done = written.union(plan.where("replaced").select("size")).agg(F.count("*").alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()
    late = [r["failure"] for r in copied.where("failure IS NOT NULL").orderBy("dest").select("failure").toLocalIterator()]
    errors = (*[r["message"] for r in copyplan.error_ledger(plan).orderBy("ordinal").toLocalIterator()], *late)
    seconds = (datetime.now(UTC) - began).total_seconds()
    repos = spark.createDataFrame([(0, repository.owner, repository.name, repository.url, repository.default_branch, repository.total_commits, repository.is_empty)], "repo_id long, owner string, name string, url string, default_branch string, total_commits long, is_empty boolean")
    told_of = (plan, repos, config, F.lit(began).cast("timestamp"), F.lit(int(seconds * 1000)))
    if config.output.generate_report:
        at, lasted = began.strftime("%Y-%m-%d %H:%M:%S UTC"), f"{seconds:.3f}s"
        write_lines(reports.text_lines(plan, repos, config, at, lasted), os.path.join(out, copyplan.METADATA, "extraction_report.txt"))
        write_lines(reports.summary_lines(plan, repos, at[:16] + " UTC", lasted), os.path.join(out, copyplan.SUMMARY))
        write_lines(reports.json_lines(*told_of), os.path.join(out, copyplan.METADATA, "extraction_report.json"))
    if config.output.create_index:
        write_lines(reports.index_lines(catalog, config.output.preserve_structure, began.strftime("%Y-%m-%d %H:%M:%S UTC")), os.path.join(out, copyplan.INDEX))
    ms, form = F.lit(int(seconds * 1000)), F.lit(mode)
    numbers = [F.lit(x).cast("long") for x in (done["n"], done["b"])]
    shown = console.summary(form, *numbers, ms, F.lit(len(errors)), F.lit(datetime.now(UTC).isoformat()))
    rows = reports.report_rows(*told_of, listed=mode == "json")
    told = reports.report_json(rows).first()["json"] if mode == "json" else rows.select(console.report(form, ms).alias("r")).first()["r"]
    return Run(out, done["n"], done["b"], errors, seconds, spark.range(1).select(shown.alias("s")).first()["s"], told)


def statistics(spark: SparkSession, root: str, config: Config) -> DataFrame:
    return stats.scan_statistics(scan(spark, root, config))
