"""A sink of files that shows either all of a job's files or none.

Rows name a file by ``dest``, a path below the sink's root, and bring its bytes (``content``) or the file
to copy (``source_path``, with its times). Each attempt of a task writes into a folder of its own; when
it is through, it moves its files, one rename each, into the job's staging tree, which nobody looks at.
So attempts never meet in an unfinished file, and two of one task put the same bytes in the same place.
The commit is one rename of the staging tree to the root; a job that fails removes it. A file that
can't be written is a row with ``failure`` in the ledger, and the others go on. The ledger lies with
the files, a part for each task, and becomes visible with them.

Root and sources must be mounted alike on the driver and all executors, and the root's parent must
take renames. No two rows may name the same ``dest`` (see plan_copy).
"""

from __future__ import annotations

import hashlib
import os
import shutil
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

#: Where the ledger of a job lies below its root, and its columns.
LEDGER = ".leafmill/file_ledger"
LEDGER_SCHEMA = "dest string, source_path string, bytes_copied long, sha256 string, failure string"
CHUNK = 1 << 20
#: Rows of the ledger that a task holds, and rows of files that come to it at once, which bring their contents.
HELD, AT_ONCE = 5_000, 250
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
KINDS = pa.schema([("dest", pa.string()), ("source_path", pa.string()), ("bytes_copied", pa.int64()), ("sha256", pa.string()), ("failure", pa.string())])


@dataclass
class Written(WriterCommitMessage):
    """What one task has in the staging tree, and which files it has not."""

    files: int
    bytes: int
    missing: tuple[str, ...]


def _folder(base: str, relative: str) -> None:
    """Makes a folder and those above it, down from ``base``, which must be there: a job that was stopped stays removed."""
    for end in [i for i, c in enumerate(relative) if c == "/"] + [len(relative)]:
        if relative[:end]:
            with suppress(FileExistsError):
                os.mkdir(os.path.join(base, relative[:end]))


def _remove(path: str) -> None:
    """Removes a folder, though tasks of the job that are being stopped may still write to it."""
    for _ in range(50):
        shutil.rmtree(path, ignore_errors=True)
        if not os.path.lexists(path):
            return
        time.sleep(0.1)


def _write_one(row: Row, base: str) -> tuple[int, str]:
    """Writes a file below ``base``; returns its size and checksum."""
    _folder(base, os.path.dirname(row["dest"]))
    target = os.path.join(base, row["dest"])
    seen, size = hashlib.sha256(), 0
    with open(target, "wb") as f:
        if "content" in row:
            size = f.write(bytes(row["content"] or b""))
            seen.update(row["content"] or b"")
        else:
            with open(row["source_path"], "rb") as source:
                while chunk := source.read(CHUNK):
                    size += f.write(chunk)
                    seen.update(chunk)
    if "content" not in row:
        stat = os.stat(row["source_path"])
        os.utime(target, ns=(stat.st_atime_ns, stat.st_mtime_ns))
    return size, seen.hexdigest()


class FileWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.root, self.overwrite = options["path"].rstrip("/"), overwrite
        self.stage = f"{self.root}.staging-{options['job']}"

    def begin(self) -> None:
        """Makes the staging folders, before the job."""
        os.makedirs(os.path.join(self.stage, "attempts"))
        os.makedirs(os.path.join(self.stage, "tree", LEDGER))

    def write(self, iterator: Iterator[Row]) -> Written:
        context = TaskContext.get()
        own = os.path.join(self.stage, "attempts", f"{context.partitionId()}-{context.taskAttemptId()}-{uuid.uuid4().hex}")
        tree = os.path.join(self.stage, "tree")
        os.mkdir(own)
        part, good, size = f"{own}.ledger", 0, 0
        missing: list[str] = []
        waiting: list[tuple] = []
        ledger: pq.ParquetWriter | None = None

        def hand_on() -> None:
            """The rows that wait go to the ledger's part, and their files to the staging tree once the task is through."""
            nonlocal ledger
            ledger = ledger or pq.ParquetWriter(part, KINDS)
            ledger.write_table(pa.table([pa.array(x, f.type) for x, f in zip(zip(*waiting, strict=True), KINDS, strict=True)], KINDS))
            waiting.clear()

        for row in iterator:
            source = None if "content" in row else row["source_path"]
            try:
                if os.path.isabs(row["dest"]) or ".." in row["dest"].split("/"):
                    raise ValueError(f"outside of the root: {row['dest']}")
                waiting.append((row["dest"], source, *_write_one(row, own), None))
                good, size = good + 1, size + waiting[-1][2]
            except (OSError, ValueError) as e:
                waiting.append((row["dest"], source, 0, None, f"Failed to copy {source or row['dest']}: {e}"))
                missing.append(row["dest"])
            if len(waiting) >= HELD:
                hand_on()
        if waiting:
            hand_on()
        if ledger is not None:
            ledger.add_key_value_metadata({"files": str(good), "bytes": str(size)})
            ledger.close()
            with pq.ParquetFile(part) as written:
                for batch in written.iter_batches(HELD, columns=["dest", "failure"]):
                    for dest, failure in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                        if failure is None:
                            _folder(tree, os.path.dirname(dest))
                            os.replace(os.path.join(own, dest), os.path.join(tree, dest))
            os.replace(part, os.path.join(tree, LEDGER, f"part-{context.partitionId():06d}.parquet"))
        shutil.rmtree(own, ignore_errors=True)
        return Written(good, size, tuple(missing))

    def commit(self, messages: list[Written | None]) -> None:
        tree = os.path.join(self.stage, "tree")
        for message in messages:  # another attempt may have had what this one counts as failed
            for dest in message.missing if message else ():
                if os.path.lexists(os.path.join(tree, dest)) and not os.path.isabs(dest) and ".." not in dest.split("/"):
                    os.remove(os.path.join(tree, dest))
        old = f"{self.root}.replaced-{uuid.uuid4().hex}"
        if os.path.lexists(self.root):
            if not self.overwrite:
                raise FileExistsError(self.root)
            os.rename(self.root, old)
        os.rename(tree, self.root)
        _remove(self.stage)
        _remove(old)

    def abort(self, messages: list[Written | None]) -> None:
        _remove(self.stage)


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "leafmill_files"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        return FileWriter(self.options, overwrite)


class _Tally:
    """Files and bytes that the ledger's parts tell of; each part's footer is read once."""

    def __init__(self) -> None:
        self.parts: dict[str, tuple[int, int]] = {}

    def read(self, folder: str) -> tuple[int, int]:
        with suppress(FileNotFoundError):  # just committed, or stopped
            for name in os.listdir(folder):
                if name not in self.parts and name.startswith("part-"):
                    told = pq.read_metadata(os.path.join(folder, name)).metadata
                    self.parts[name] = int(told[b"files"]), int(told[b"bytes"])
        files, size = zip(*self.parts.values(), strict=True) if self.parts else ((), ())
        return sum(files), sum(size)


@contextmanager
def _told(folder: str, done: str, progress: Callable[[int, int], None] | None, every: float = 0.2) -> Iterator[None]:
    """Tells ``progress``, from a thread of its own, of the files and bytes of ended tasks while the body runs, and of all when it is through."""
    if progress is None:
        yield
        return
    tally, over = _Tally(), threading.Event()

    def watch() -> None:
        last = (0, 0)
        while not over.wait(every):
            if (now := tally.read(folder)) != last:
                progress(*now)
                last = now

    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        yield
    finally:
        over.set()
        watcher.join()
    progress(*_Tally().read(done))


def write_files(rows: DataFrame, root: str, overwrite: bool = False, progress: Callable[[int, int], None] | None = None) -> DataFrame:
    """Writes rows of (dest, content) or (dest, source_path) below ``root``, and returns the ledger.

    ``progress`` is called with the files and bytes written so far, as tasks end, and with all at the end.
    """
    spark, root = rows.sparkSession, os.path.abspath(root)
    if os.path.lexists(root) and not overwrite:
        raise FileExistsError(root)
    spark.dataSource.register(FileSink)
    job = uuid.uuid4().hex
    writer = FileWriter({"path": root, "job": job}, overwrite)
    writer.begin()
    batch = spark.conf.get(BATCH)
    try:
        if not 0 < int(batch) <= AT_ONCE:
            spark.conf.set(BATCH, AT_ONCE)
        with _told(os.path.join(writer.stage, "tree", LEDGER), os.path.join(root, LEDGER), progress):
            rows.write.format("leafmill_files").mode("overwrite" if overwrite else "append").option("job", job).save(root)
    finally:
        spark.conf.set(BATCH, batch)
        writer.abort([])  # nothing is left of it after a commit
    return spark.read.schema(LEDGER_SCHEMA).parquet(f"file://{os.path.join(root, LEDGER)}")
