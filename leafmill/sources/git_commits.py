"""Metadata of checkouts: head, branch and emptiness from the refs, commits as a table.

Refs are a few small files, read where this is called. Commits are read by executors: the directories
of loose objects and runs of the objects of packs are the partitions of a Python data source, which
gives (repo_id, commit_id, parents). Packed commits that are stored as differences are put together.
"""

from __future__ import annotations

import glob
import mmap
import os
import re
import struct
import zlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from leafmill.operators.commits import commit_counts

SCHEMA = "repo_id long, commit_id string, parents array<string>"
HEADS = "repo_id long, default_branch string, commit_id string"
#: Objects of a pack that a task reads.
OBJECTS = 100_000
COMMIT, OFFSET_DELTA, REF_DELTA = 1, 6, 7


@dataclass(frozen=True)
class Head:
    """Shorthand of HEAD, and the commit it stands at (None before the first commit)."""

    branch: str
    commit: str | None


def git_dir(checkout: str) -> str:
    """The repository's own folder: ``.git``, or where a file of this name points to, or the folder itself if it is bare."""
    inner = os.path.join(checkout, ".git")
    if os.path.isfile(inner):
        with open(inner, encoding="utf-8") as f:
            return os.path.normpath(os.path.join(checkout, f.read().removeprefix("gitdir:").strip()))
    if os.path.isdir(inner):
        return inner
    if os.path.isfile(os.path.join(checkout, "HEAD")) and os.path.isdir(os.path.join(checkout, "objects")):
        return checkout
    raise FileNotFoundError(f"no repository: {checkout}")


def _common(folder: str) -> str:
    """Where refs and objects lie; a linked worktree shares those of its main one."""
    link = os.path.join(folder, "commondir")
    if not os.path.isfile(link):
        return folder
    with open(link, encoding="utf-8") as f:
        return os.path.normpath(os.path.join(folder, f.read().strip()))


def _read(path: str) -> str | None:
    try:
        with open(path, encoding="utf-8") as f:
            return f.read()
    except (FileNotFoundError, IsADirectoryError, NotADirectoryError):
        return None


def read_head(checkout: str) -> Head:
    """HEAD of a checkout; a detached one has the shorthand HEAD. Loose refs go before packed ones."""
    folder = git_dir(checkout)
    common = _common(folder)
    name, value = "HEAD", (_read(os.path.join(folder, "HEAD")) or "").strip()
    for _ in range(10):  # refs may point to refs
        if not value.startswith("ref:"):
            break
        name = value.removeprefix("ref:").strip()
        loose = _read(os.path.join(folder, name)) or _read(os.path.join(common, name))
        packed = re.search(rf"(?m)^([0-9a-f]+) {re.escape(name)}$", _read(os.path.join(common, "packed-refs")) or "")
        value = (loose or (packed[1] if packed else "")).strip()
    short = re.sub(r"^refs/(heads/|tags/|remotes/)?", "", name)
    return Head(short, value if re.fullmatch(r"[0-9a-f]{40,64}", value) else None)


class Part(InputPartition):
    """(repo_id, folder of loose objects) or (repo_id, pack without its suffix, first object, object after the last)."""


def _parents(body: bytes) -> list[str]:
    """The parents that a commit's head names, in their order."""
    return [x.decode() for x in re.findall(rb"(?m)^parent ([0-9a-f]+)$", body.split(b"\n\n", 1)[0])]


def _loose(folder: str) -> Iterator[tuple[str, list[str]]]:
    for name in sorted(os.listdir(folder)):
        if re.fullmatch(r"[0-9a-f]{38}|[0-9a-f]{62}", name):
            with open(os.path.join(folder, name), "rb") as f:
                data = f.read()
            # Of other objects, which may be large, only the head is inflated.
            if zlib.decompressobj().decompress(data, 16).startswith(b"commit "):
                yield os.path.basename(folder) + name, _parents(zlib.decompress(data).split(b"\0", 1)[1])


class Pack:
    """A pack and its index (version 2, ids of 20 bytes)."""

    def __init__(self, path: str) -> None:
        with open(path + ".idx", "rb") as a, open(path + ".pack", "rb") as b:
            self.index, self.data = mmap.mmap(a.fileno(), 0, access=mmap.ACCESS_READ), mmap.mmap(b.fileno(), 0, access=mmap.ACCESS_READ)
        if self.index[:8] != b"\xfftOc\x00\x00\x00\x02":
            raise ValueError(f"not an index of version 2: {path}.idx")
        self.size = struct.unpack_from(">I", self.index, 8 + 255 * 4)[0]

    def id(self, i: int) -> bytes:
        at = 1032 + 20 * i
        return self.index[at : at + 20]

    def offset(self, i: int) -> int:
        start = 1032 + 24 * self.size
        near = struct.unpack_from(">I", self.index, start + 4 * i)[0]
        return near if near < 1 << 31 else struct.unpack_from(">Q", self.index, start + 4 * self.size + 8 * (near & 0x7FFFFFFF))[0]

    def find(self, wanted: bytes) -> int | None:
        """Where an object begins, by bisection."""
        low, high = 0, self.size
        while low < high:
            middle = (low + high) // 2
            low, high = (middle + 1, high) if self.id(middle) < wanted else (low, middle)
        return self.offset(low) if low < self.size and self.id(low) == wanted else None

    def head(self, at: int) -> tuple[int, int, int | None]:
        """Kind of the object at an offset, where its data begins, and the offset of what it differs from."""
        start, byte = at, self.data[at]
        kind = byte >> 4 & 7
        while byte & 128:
            at += 1
            byte = self.data[at]
        at += 1
        if kind == REF_DELTA:
            return kind, at + 20, self.find(self.data[at : at + 20])
        if kind != OFFSET_DELTA:
            return kind, at, None
        byte = self.data[at]
        back = byte & 127
        while byte & 128:
            at += 1
            byte = self.data[at]
            back = (back + 1 << 7) | byte & 127
        return kind, at + 1, start - back

    def inflated(self, at: int) -> bytes:
        stream, out = zlib.decompressobj(), b""
        while not stream.eof:
            out += stream.decompress(stream.unconsumed_tail or self.data[at : (at := at + 4096)])
        return out

    def commit(self, i: int) -> bytes | None:
        """The body of an object if it is a commit."""
        changes, at = [], self.offset(i)
        kind, start, base = self.head(at)
        while kind in (OFFSET_DELTA, REF_DELTA):
            if base is None:
                return None  # differs from an object outside the pack
            changes.append(start)
            kind, start, base = self.head(base)
        if kind != COMMIT:
            return None
        body = self.inflated(start)
        for change in reversed(changes):
            body = changed(body, self.inflated(change))
        return body


def changed(base: bytes, delta: bytes) -> bytes:
    """What a difference makes of its base: runs that are copied from it, and new bytes."""
    at = 0
    for _ in range(2):  # the sizes of base and result
        while delta[at] & 128:
            at += 1
        at += 1
    out = []
    while at < len(delta):
        code = delta[at]
        at += 1
        if code & 128:
            numbers = []
            for bits in (code & 15, code >> 4 & 7):
                value, shift = 0, 0
                while bits:
                    if bits & 1:
                        value |= delta[at] << shift
                        at += 1
                    bits, shift = bits >> 1, shift + 8
                numbers.append(value)
            start, size = numbers[0], numbers[1] or 0x10000
            out.append(base[start : start + size])
        else:
            out.append(delta[at : at + code])
            at += code
    return b"".join(out)


class Commits(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.repo, self.objects = int(options.get("repoId", "0")), os.path.join(_common(git_dir(options["path"])), "objects")

    def partitions(self) -> list[Part]:
        loose = [Part((self.repo, x)) for x in sorted(glob.glob(os.path.join(glob.escape(self.objects), "[0-9a-f][0-9a-f]")))]
        packs = [x.removesuffix(".idx") for x in sorted(glob.glob(os.path.join(glob.escape(self.objects), "pack", "*.idx")))]
        return loose + [Part((self.repo, x, i, i + OBJECTS)) for x in packs for i in range(0, Pack(x).size, OBJECTS)]

    def read(self, partition: Part) -> Iterator[tuple]:
        if partition is None:  # no objects at all
            return
        if len(partition.value) == 2:
            repo, folder = partition.value
            yield from ((repo, name, parents) for name, parents in _loose(folder))
            return
        repo, path, first, stop = partition.value
        pack = Pack(path)
        for i in range(first, min(stop, pack.size)):
            if (body := pack.commit(i)) is not None:
                yield repo, pack.id(i).hex(), _parents(body)


class GitCommits(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_commits"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Commits:
        return Commits(self.options)


def commits(spark: SparkSession, checkout: str, repo_id: int = 0) -> DataFrame:
    """The commits of one checkout; a commit that is both loose and packed comes twice."""
    spark.dataSource.register(GitCommits)
    return spark.read.format("git_commits").option("repoId", repo_id).load(os.path.abspath(checkout))


def repositories(spark: SparkSession, checkouts: Mapping[int, str]) -> DataFrame:
    """(repo_id, default_branch, head, total_commits, is_empty) of checkouts by their ids; commits are counted for all at once."""
    heads = [(repo, *vars(read_head(path)).values()) for repo, path in checkouts.items()]
    found = spark.createDataFrame(heads, HEADS)
    table = spark.createDataFrame([], SCHEMA)
    for repo, path in checkouts.items():
        table = table.union(commits(spark, path, repo))
    counted = commit_counts(table, found.select("repo_id", "commit_id"))
    return found.select("repo_id", "default_branch").join(counted, "repo_id").select("repo_id", "default_branch", F.col("head"), "total_commits", "is_empty")
