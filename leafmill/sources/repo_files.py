"""A directory tree as a table: one row for each regular file, links neither followed nor listed.

Spark's own file sources skip names that begin with a dot or underscore, and follow links. Here
directories are pruned while the tree is walked, by the rules that the settings have for their names,
and by the filters that a query pushes down: bounds on size and depth, extensions, and beginnings of
paths. The same rules as columns give the same rows, so filtering again changes nothing. Patterns are
left to the columns, so that one engine reads them. Entries that can't be read become rows with
``error`` set.

There are two ways through a tree, which give the same rows. The Python data source lists the upper
levels when it is planned, until they give enough directories to deal out. ``scan_levels`` lists
nothing on the driver: each level is a job that deals out the directories that the one before found.
``scan_directory`` takes it for trees whose upper levels have more than ``PROBED`` entries.
"""

from __future__ import annotations

import json
import math
import os
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import asdict
from datetime import UTC, datetime
from functools import reduce
from itertools import chain, islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    StringStartsWith,
)
from pyspark.sql.types import StructType

from leafmill.config import Filters
from leafmill.operators.predicates import BUILD_DIRS, SHOWN_HIDDEN_DIRS
from leafmill.tables import materialize

#: ``depth`` is the number of components of relative_path.
SCHEMA = "repo_id long, source_path string, relative_path string, filename string, extension string, size long, modified timestamp, error string, depth int"

#: Directories to deal out that are enough, levels that are listed at most for them, and files of a partition.
ENOUGH, LEVELS, FILES = 256, 4, 2_000
#: Partitions that directories are dealt out to at most, and entries that scan_directory looks at before it chooses a way.
DEALT, PROBED = 1_024, 5_000
#: Rows that a task makes at once.
ROWS = 5_000
PUSH_DOWN = "spark.sql.python.filterPushdown.enabled"


class Entry(InputPartition):
    """Some entries of the tree, by their paths below the root."""


class Walk(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.repo = options["path"], int(options.get("repoId", "0"))
        given = json.loads(options.get("filters", "{}"))
        self.depth = given.get("max_depth")
        self.excluded = {d.lower() for d in given.get("exclude_dirs", ())}
        self.prune, self.push_down = bool(given), options.get("pushDown", "true").lower() == "true"
        self.extensions: set[str] | None = None
        self.least, self.most, self.deepest = 0, math.inf, math.inf
        self.prefixes: list[str] = []
        self.readable = False
        if not os.path.isdir(self.root):
            raise ValueError(f"no directory: {self.root}")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes what it can decide; the others are left to Spark."""
        for given in filters:
            if not (self.push_down and self.takes(given)):
                yield given

    def takes(self, given: Filter) -> bool:
        column = getattr(given, "attribute", ("",))[0]
        value = getattr(given, "value", None)
        match given:
            case IsNull() if column == "error":
                self.readable = True
            case IsNotNull() if column in ("size", "extension", "filename", "modified"):
                self.readable = True  # only rows of errors lack them
            case IsNotNull() if column in ("relative_path", "source_path", "depth", "repo_id"):
                pass
            case EqualTo() | In() if column == "extension" and value is not None:
                values = set(value) if isinstance(given, In) else {value}
                self.extensions = values if self.extensions is None else self.extensions & values
                self.readable = True
            case LessThanOrEqual() | LessThan() | GreaterThanOrEqual() | GreaterThan() if column == "size":
                self.bound(given, value)
                self.readable = True
            case LessThanOrEqual() | LessThan() if column == "depth":
                self.deepest = min(self.deepest, value - isinstance(given, LessThan))
            case StringStartsWith() if column == "relative_path":
                self.prefixes.append(value)
            case _:
                return False
        return True

    def bound(self, given: Filter, value: int) -> None:
        if isinstance(given, LessThanOrEqual | LessThan):
            self.most = min(self.most, value - isinstance(given, LessThan))
        else:
            self.least = max(self.least, value + isinstance(given, GreaterThan))

    def partitions(self) -> list[Entry]:
        found, files = sorted(os.listdir(self.root)), []
        for _ in range(LEVELS):
            kinds = [os.path.isdir(p) and not os.path.islink(p) for p in (os.path.join(self.root, x) for x in found)]
            files += [x for x, inner in zip(found, kinds, strict=True) if not inner]
            found = [x for x, inner in zip(found, kinds, strict=True) if inner]
            if not found or len(found) >= ENOUGH:
                break
            below = []
            for x in found:
                try:
                    below += [f"{x}/{y}" for y in sorted(os.listdir(os.path.join(self.root, x)))] if self.enters(x) else []
                except OSError:
                    files.append(x)  # its task meets the error again, and gives a row for it
            found = below
        runs = [files[i : i + FILES] for i in range(0, len(files), FILES)]
        each = -(-len(found) // DEALT) or 1
        return [Entry(x) for x in [*(found[i : i + each] for i in range(0, len(found), each)), *runs]]

    def enters(self, relative: str) -> bool:
        """Whether anything below a directory may be wanted."""
        below = relative + "/"
        if relative.count("/") + 1 >= self.deepest or not all(x.startswith(below) or below.startswith(x) for x in self.prefixes):
            return False
        if not self.prune:
            return True
        name = os.path.basename(relative)
        low = name.lower()
        hidden = name.startswith(".") and low not in SHOWN_HIDDEN_DIRS
        deep = self.depth is not None and relative.count("/") + 1 >= self.depth
        return not (deep or hidden or low in self.excluded or low in BUILD_DIRS)

    def row(self, relative: str, error: OSError | None = None) -> tuple | None:
        """The row of a file, or of an entry that can't be read; None if a pushed filter drops it."""
        depth, whole = relative.count("/") + 1, os.path.join(self.root, relative)
        if depth > self.deepest or not all(relative.startswith(x) for x in self.prefixes):
            return None
        name = os.path.basename(relative)
        stem, dot, ext = name.rpartition(".")
        extension = ext.lower() if dot and stem else ""
        if error is None and self.extensions is not None and extension not in self.extensions:
            return None  # before the file's size is asked for
        try:
            if error is not None:
                raise error
            stat = os.stat(whole, follow_symlinks=False)
        except OSError as e:
            return None if self.readable else (self.repo, whole, relative, None, None, None, None, str(e), depth)
        if not self.least <= stat.st_size <= self.most:
            return None
        return self.repo, whole, relative, name, extension, stat.st_size, datetime.fromtimestamp(stat.st_mtime, UTC), None, depth

    def below(self, relative: str) -> Iterator[os.DirEntry]:
        """The entries of a directory, as they come."""
        with os.scandir(os.path.join(self.root, relative)) as entries:
            yield from entries

    def read(self, partition: Entry) -> Iterator[tuple]:
        waiting = list(partition.value) if partition is not None else []  # Spark gives None for an empty tree
        while waiting:
            relative = waiting.pop()
            whole = os.path.join(self.root, relative)
            row = None
            try:
                if os.path.islink(whole):
                    continue
                if os.path.isdir(whole):
                    if self.enters(relative):
                        waiting += [f"{relative}/{x}" for x in sorted(os.listdir(whole), reverse=True)]
                elif os.path.isfile(whole):
                    row = self.row(relative)
            except OSError as e:
                row = self.row(relative, e)
            if row is not None:
                yield row

    def level(self, relative: str) -> Iterator[tuple]:
        """Rows of the files of one directory, and rows of its directories that are to be entered, which have no source_path."""
        try:
            for entry in self.below(relative):
                inner = f"{relative}/{entry.name}" if relative else entry.name
                if entry.is_dir(follow_symlinks=False):
                    if self.enters(inner):
                        yield self.repo, None, inner, *[None] * 6
                elif entry.is_file(follow_symlinks=False) and (row := self.row(inner)):
                    yield row
        except OSError as e:
            if row := self.row(relative, e):
                yield row


class RepoFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repo_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Walk:
        return Walk(self.options)


def _options(root: str, filters: Filters | None, repo_id: int) -> dict[str, str]:
    return {"path": os.path.abspath(root), "repoId": str(repo_id), "filters": json.dumps(asdict(filters)) if filters else "{}"}


def _listed(options: dict[str, str]):
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        walk = Walk(options)
        rows = chain.from_iterable(walk.level(x) for part in parts for x in part["relative_path"])
        while some := list(islice(rows, ROWS)):
            found = pd.DataFrame(some, columns=names)
            yield found.astype({"repo_id": "Int64", "size": "Int64", "depth": "Int32"}).assign(modified=pd.to_datetime(found["modified"], utc=True))

    return run


def scan_levels(spark: SparkSession, root: str, filters: Filters | None = None, repo_id: int = 0) -> DataFrame:
    """The rows of a tree, listed level by level: a job for each, over the directories that the level before found.

    A directory is listed by one task, as its entries come, and its rows are never held together. The
    tree is read when this is called.
    """
    options, levels = _options(root, filters, repo_id), []
    frontier, count = spark.createDataFrame([("",)], "relative_path string"), 1
    while count:
        tasks = min(count, max(2 * spark.sparkContext.defaultParallelism, count // FILES))
        level = materialize(frontier.repartition(tasks).mapInPandas(_listed(options), SCHEMA), "level")
        levels.append(level.where("source_path IS NOT NULL"))
        frontier = level.where("source_path IS NULL").select("relative_path")
        count = frontier.count()
    return reduce(DataFrame.union, levels)


def is_large(root: str) -> bool:
    """Whether the upper levels of a tree have more than PROBED entries; no more than these are looked at."""
    seen, level = 0, [root]
    for _ in range(LEVELS):
        below = []
        for folder in level:
            with suppress(OSError), os.scandir(folder) as entries:
                for entry in entries:
                    seen += 1
                    if seen > PROBED:
                        return True
                    if entry.is_dir(follow_symlinks=False):
                        below.append(entry.path)
        level = below
    return False


def scan_directory(spark: SparkSession, root: str, filters: Filters | None = None, repo_id: int = 0, push_down: bool = True) -> DataFrame:
    """Files below a root; with ``filters``, directories that they exclude are not entered.

    Spark refuses a source that takes filters while the session turns that off, so it is turned on here.
    """
    if not os.path.isdir(root):
        raise NotADirectoryError(root)
    if is_large(root):
        return scan_levels(spark, root, filters, repo_id)
    spark.dataSource.register(RepoFiles)
    spark.conf.set(PUSH_DOWN, "true")
    return spark.read.format("repo_files").options(**_options(root, filters, repo_id), pushDown=push_down).load()
