"""Suffix-array deduplication: bytes of strings that start at two places or more are removed.

Of equal texts one is looked at; all of them go, if they are long enough, as each repeats the others.
The other strings of ``length`` bytes meet in shards, which are made so that equal strings are always
in one: each string is sent by its anchor, the ``GRAM``-byte run with the smallest hash that it holds.
Anchors that occur once can't repeat, and their strings are not looked at further. What is left of a
text falls into regions, the bytes of the strings of one anchor.

Anchors that very many regions have are split: their regions are cut again by two more anchors, each
by another hash, so strings go on together only if they agree in three of their runs; equal regions
among them are then told by a checksum, and one of each goes on. So neither a passage that a third
of all texts have, nor a short phrase amid different texts, brings them to one task.

A task takes the distinct regions of its anchors in shards of bounded size. It sorts the suffixes of a shard
by Larsson-Sadakane refinement (groups of equal prefixes are split by the rank of what follows them,
with doubled length each time, and groups of one are left alone), and measures common prefixes in
Kasai's way, along the text, where each is at least the last one less a byte. Neighbours with
``length`` bytes in common start a repeated string. If an anchor has more regions than a shard holds,
their sorted strings are cut by binary search at common splitters, and merged range by range.

Null texts are empty. Bytes, not characters, are judged and removed; what is kept may not be UTF-8.
Repeated rows are equal texts. A null id is an id like others. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm import hashing
from leafmill.llm.common import join_checked, materialize, release, small_batches

LENGTH = 200
GRAM = 32
#: Bytes of texts whose anchors are sought at once: what is held for them fits in a core's cache.
AT_ONCE = 1 << 16
#: Bytes of a shard, so that sorting one stays near a core's cache.
SHARD = 1 << 18
#: Regions of an anchor above which it is split, and the hashes that do so.
HOT_REGIONS = 20_000
SALTS = (0x5851F42D4C957F2D, 0x14057B7EF767814F)
#: Bits of a string's places, up to 2^13 bytes; keys of anchors have the other bits of a hash.
PLACE_BITS = 13
#: Bytes that a word of a suffix's first key holds, seven of nine bits each.
FIRST = 7


def _window_least(values: np.ndarray, wide: int) -> np.ndarray:
    """The least of so many successive values, from each place on: of the rest of its block and of the start of the next."""
    n = len(values)
    rows = np.full(-(-n // wide) * wide, np.iinfo(values.dtype).max, values.dtype)
    rows[:n] = values
    rows = rows.reshape(-1, wide)
    first = np.minimum.accumulate(rows, axis=1).ravel()
    rest = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(rest[: n - wide + 1], first[wide - 1 : n])


def anchors(data: np.ndarray, ends: np.ndarray, length: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, key, first, last) for each anchor: the strings from ``first`` to ``last`` in their text have it."""
    none = (np.empty(0, np.int64),) * 4
    sizes = np.diff(ends, prepend=0)
    if len(data) < length:
        return none
    h = hashing.prefix_hashes(data)
    keys = hashing.mix(((h[GRAM:] - h[:-GRAM]) * hashing.powers(len(data) + 1)[1][: len(data) - GRAM + 1]) ^ np.uint64(salt))
    # The low bits of a key tell its place, which is less than 2^PLACE_BITS places on.
    places = np.arange(len(keys), dtype=np.uint64)
    mask = np.uint64((1 << PLACE_BITS) - 1)
    keys &= ~mask
    least = _window_least(keys | (places & mask), length - GRAM + 1) & mask
    at = (places[: len(least)] + ((least - places[: len(least)]) & mask)).astype(np.int64)
    start = ends - sizes
    text = np.repeat(np.arange(len(ends)), sizes)[: len(at)]
    place = np.flatnonzero(np.arange(len(at)) + length <= ends[text])
    if not len(place):
        return none
    text, at = text[place], at[place]
    new = np.ones(len(place), bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(place)) - 1
    return text[first], keys[at[first]].view(np.int64), place[first] - start[text[first]], place[last] - start[text[first]]


def suffix_ranks(data: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Ranks of all suffixes, each up to the end of its region, which ``left`` bytes are before.

    Equal suffixes have one rank: the place of their group's first member in the sorted sequence.
    """
    n = len(data)
    wide = np.zeros(n + FIRST, np.uint64)
    wide[:n] = data.astype(np.uint64) + np.uint64(1)
    key = np.zeros(n, np.uint64)
    for k in range(FIRST):
        key = (key << np.uint64(9)) | np.where(left > k, wide[k : n + k], np.uint64(0))
    order = np.argsort(key)
    head = np.ones(n, bool)
    head[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    alone = head & np.append(head[1:], True)
    open_, depth = order[~alone], FIRST
    whole = int(left.max(initial=0))
    while len(open_) and depth < whole:
        follow = open_ + depth
        second = np.where(left[open_] > depth, rank[np.minimum(follow, n - 1)] + 1, 0)
        pair = rank[open_] * (n + 1) + second
        order = np.argsort(pair)
        open_, pair = open_[order], pair[order]
        group = np.ones(len(open_), bool)
        own = rank[open_]
        group[1:] = own[1:] != own[:-1]
        head = np.ones(len(open_), bool)
        head[1:] = pair[1:] != pair[:-1]
        at = np.arange(len(open_))
        within = at - np.maximum.accumulate(np.where(group, at, 0))
        rank[open_] = own + np.maximum.accumulate(np.where(head, at, 0)) - (at - within)
        alone = head & np.append(head[1:], True)
        open_, depth = open_[~alone], depth * 2
    return rank


def common_prefixes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, before: np.ndarray, left: np.ndarray, length: int) -> np.ndarray:
    """Bytes, up to ``length``, that each suffix shares with the one sorted before it (-1: none), along all regions at once."""
    words = np.zeros(len(data) + length + 8, np.uint64)
    for k in range(8):
        words[: len(data) - k] |= data[k:].astype(np.uint64) << np.uint64(8 * k)
    out = np.zeros(len(data), np.int64)
    size = np.zeros(len(starts), np.int64)
    for step in range(int(sizes.max(initial=0)) - length + 1):
        live = np.flatnonzero(sizes - step >= length)
        i = starts[live] + step
        j = before[i]
        reach = np.where(j >= 0, np.minimum(np.minimum(left[i], left[j]), length), 0)
        h = np.minimum(np.maximum(size[live] - 1, 0), reach)
        going = np.flatnonzero(h < reach)
        while len(going):
            unlike = words[i[going] + h[going]] ^ words[j[going] + h[going]]
            low = unlike & (~unlike + np.uint64(1))
            same = np.where(unlike == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) // 8)
            h[going] = np.minimum(h[going] + same, reach[going])
            going = going[(same == 8) & (h[going] < reach[going])]
        size[live] = h
        out[i] = h
    return out


def sorted_strings(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all strings of a shard in sorted order, and whether each equals the one before it."""
    left = np.repeat(starts + sizes, sizes) - np.arange(len(data))
    order = np.argsort(suffix_ranks(data, left), kind="stable")  # equal suffixes by place, else Kasai's bound fails
    before = np.full(len(data), -1, np.int64)
    before[order[1:]] = order[:-1]
    shared = common_prefixes(data, starts, sizes, before, left, length)
    order = order[left[order] >= length]
    return order, shared[order] >= length


def repeated(shards: list[tuple[np.ndarray, np.ndarray, np.ndarray]], length: int) -> list[np.ndarray]:
    """For each shard (bytes, starts and sizes of its regions), which places start a string that is elsewhere too."""
    out, heads = [], []
    for data, starts, sizes in shards:
        order, same = sorted_strings(data, starts, sizes, length)
        flags = np.zeros(len(data), bool)
        flags[order] = same | np.append(same[1:], False)
        out.append(flags)
        if len(shards) > 1:
            heads.append((order[~same], np.repeat(np.flatnonzero(~same), np.diff(np.append(np.flatnonzero(~same), len(order)))), order))
    if len(shards) > 1:
        _merge(shards, heads, out, length)
    return out


def _merge(shards: list, heads: list, flags: list[np.ndarray], length: int) -> None:
    """Flags strings that more than one shard has: each shard's distinct sorted strings are cut at splitters and merged."""
    kind = np.dtype(f"S{length}")

    def strings(k: int, places: np.ndarray) -> np.ndarray:
        view = np.lib.stride_tricks.sliding_window_view(shards[k][0], length)
        return np.ascontiguousarray(view[places]).view(kind).ravel()

    def cut(k: int, value: np.ndarray) -> int:
        places, low = heads[k][0], 0
        high = len(places)
        while low < high:
            middle = (low + high) // 2
            if strings(k, places[middle : middle + 1])[0] < value:
                low = middle + 1
            else:
                high = middle
        return low

    parts = max(1, sum(len(h[0]) for h in heads) // 50_000)
    sample = np.sort(np.concatenate([strings(k, h[0][:: max(1, len(h[0]) // parts)]) for k, h in enumerate(heads) if len(h[0])]))
    splitters = sample[:: max(1, len(sample) // parts)]
    cuts = [[0, *[cut(k, v) for v in splitters], len(h[0])] for k, h in enumerate(heads)]
    for r in range(len(splitters) + 1):
        own = [heads[k][0][c[r] : c[r + 1]] for k, c in enumerate(cuts)]
        whole = np.concatenate([strings(k, x) for k, x in enumerate(own)])
        _, at, counts = np.unique(whole, return_inverse=True, return_counts=True)
        twice, low = counts[at] > 1, 0
        for k, x in enumerate(own):
            hit = x[twice[low : low + len(x)]]
            low += len(x)
            if len(hit):
                first, group, order = heads[k]
                head_of = np.zeros(len(flags[k]), bool)
                head_of[hit] = True
                flags[k][order[head_of[order[group]]]] = True


def _anchor_rows(length: int):
    """(t1, t2, text) -> an anchor a row."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, ends in hashing.slices(batch.column(2), AT_ONCE):
                text, key, first, last = anchors(data, ends, length)
                of = pa.array(text + row)
                yield pa.record_batch([batch.column(0).take(of), batch.column(1).take(of), *map(pa.array, (key, first, last))], ["t1", "t2", "key", "first", "last"])

    return find


def _split(rows: list[tuple[int, int, int, int, bytes]], length: int) -> list[tuple[int, int, int, int, bytes]]:
    """Regions (key, t1, t2, first, bytes) of anchors that are to be split, cut by further anchors."""
    for salt in SALTS:
        if not rows:
            break
        data = np.frombuffer(b"".join(r[4] for r in rows), np.uint8)
        text, sub, first, last = anchors(data, np.cumsum([len(r[4]) for r in rows]), length, salt)
        keys = np.array([r[0] for r in rows], np.int64).view(np.uint64)[text]
        keys = hashing.mix(keys ^ (sub.view(np.uint64) * np.uint64(hashing.MULTIPLIER))).view(np.int64)
        parts = zip(text.tolist(), keys.tolist(), first.tolist(), last.tolist(), strict=True)
        rows = [(k, rows[t][1], rows[t][2], rows[t][3] + f, rows[t][4][f : e + length]) for t, k, f, e in parts]
    return rows


def _region_rows(length: int):
    """(t1, t2, text, anchors) -> a region a row; those of hot anchors are split."""

    def batch_of(rows: list[tuple[int, int, int, int, bytes]], hot: bool) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.record_batch([*map(pa.array, columns, kinds), pa.array([hot] * len(rows), pa.bool_())], ["key", "t1", "t2", "first", "region", "hot"])

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                t1, t2, data, own = (c[i].as_py() for c in batch.columns)
                rows = [(x["key"], t1, t2, x["first"], data[x["first"] : x["last"] + length]) for x in own]
                yield batch_of([r for r, x in zip(rows, own, strict=True) if not x["hot"]], False)
                for r, x in zip(rows, own, strict=True):
                    if x["hot"]:
                        waiting.append(r)
                        size += len(r[4])
                if size >= hashing.SLICE:
                    yield batch_of(_split(waiting, length), True)
                    waiting, size = [], 0
        yield batch_of(_split(waiting, length), True)

    return take


def _packed(regions: list[bytes], shard: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The regions of whole anchors as one shard, or those of a large anchor as several."""
    shards, held, size = [], [], 0
    for x in [*regions, None]:
        if held and (x is None or size + len(x) > 2 * shard):
            sizes = np.array(list(map(len, held)), np.int64)
            shards.append((np.frombuffer(b"".join(held), np.uint8), np.cumsum(sizes) - sizes, sizes))
            held, size = [], 0
        if x is not None:
            held.append(x)
            size += len(x)
    return shards


def _spans(held: dict[bytes, list], length: int, shard: int) -> list[tuple[int, int, int, int]]:
    """(t1, t2, begin, end) of repeated strings in regions that were met once; those met again went before.

    ``held`` has, for each distinct region, [t1, t2, first, whether it was met again].
    """
    low, out = 0, []
    regions, owners = list(held), list(held.values())
    shards = _packed(regions, shard)
    for (_, starts, _), flags in zip(shards, repeated(shards, length), strict=True):
        edge = np.diff(flags.astype(np.int8), prepend=0, append=0)
        on, off = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        region = np.searchsorted(starts, on, "right") - 1
        for r, b, e in zip(region.tolist(), (on - starts[region]).tolist(), (off - starts[region]).tolist(), strict=True):
            t1, t2, first, again = owners[low + r]
            if not again:
                out.append((t1, t2, first + b, first + e + length - 1))
        low += len(starts)
    return out


def _repeated_rows(length: int, shard: int):
    """(key, t1, t2, first, region, again), sorted by key -> the spans of repeated strings.

    ``again`` marks a region that stands for equal ones, which are known to be repeated.

    Equal regions are held once: all their strings are repeated, and one of them stands for the others
    where regions differ. So what a task holds grows with the distinct regions of an anchor alone.
    """

    def batch_of(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 4
        return pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["t1", "t2", "begin", "end"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        size, last = 0, None
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            for key, t1, t2, first, region, again in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if size >= shard and key != last:
                    out += _spans(held, length, shard)
                    held, size = {}, 0
                last = key
                if one := held.get(region):
                    out.append((t1, t2, first, first + len(region)))
                    if not one[3]:
                        one[3] = True
                        out.append((*one[:2], one[2], one[2] + len(region)))
                else:
                    held[region] = [t1, t2, first, again]
                    size += len(region)
            yield batch_of(out)
        yield batch_of(_spans(held, length, shard) if held else [])

    return find


def kept_bytes(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left without the spans, the bytes removed, and the number of maximal removed runs."""
    kept, at, runs, open_ = [], 0, 0, False
    for begin, end in sorted(spans):
        if begin > at or not open_:
            kept.append(data[at:begin])
            at, runs, open_ = begin, runs + 1, True
        at = max(at, end)
    kept.append(data[at:])
    left = b"".join(kept)
    return left, len(data) - len(left), runs


def _kept_rows(length: int):
    """(t1, t2, text, copies, spans) -> what is kept of each text."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                made = []
                for data, copies, spans in zip(*[c.to_pylist() for c in part.columns[2:]], strict=True):
                    whole = copies > 1 and len(data) >= length
                    made.append((len(data), *kept_bytes(data, [(0, len(data))] if whole else [(x["begin"], x["end"]) for x in spans or []])))
                n, kept, removed, runs = zip(*made, strict=True)
                digests = [hashlib.sha256(x).hexdigest() for x in kept]
                yield pa.record_batch(
                    [*part.columns[:2], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests), pa.array(kept, pa.binary())],
                    ["t1", "t2", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
                )

    return keep


def _one_of_equals(regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The regions with one for all equal ones of a hot anchor, and the spans of those equal ones, which are whole regions."""
    sums = F.md5("region")
    hot = regions.where("hot").select("key", sums.alias("sum"), "t1", "t2", "first", F.octet_length("region").alias("size"))
    one = F.struct("t1", "t2", "first")
    groups = regions.where("hot").groupBy("key", sums.alias("sum")).agg(F.min(one).alias("one"), F.first("region").alias("region"), F.count("*").alias("many"))
    groups = materialize(groups, "groups")
    twice = materialize(groups.where("many > 1").select("key", "sum"), "twice")
    known = join_checked(hot, twice, ["key", "sum"], "left_semi").select("t1", "t2", F.col("first").alias("begin"), (F.col("first") + F.col("size")).alias("end"))
    alone = regions.where("NOT hot").select("key", "t1", "t2", "first", "region", F.lit(False).alias("again"))
    return alone.union(groups.select("key", "one.*", "region", F.col("many") > 1)), known


def text_keys(df: DataFrame, text: str = "text") -> DataFrame:
    """df with ``t1`` and ``t2``, two hashes that stand for the text (null: empty)."""
    body = F.coalesce(F.col(text), F.lit(""))
    return df.drop("t1", "t2").withColumns({"t1": F.xxhash64(F.lit(1), body), "t2": F.xxhash64(F.lit(2), body)})


def kept_texts(docs: DataFrame, text: str = "text", length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """For each distinct text (t1, t2): n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes."""
    small_batches(docs.sparkSession)
    bodies = text_keys(docs.select(text), text).select("t1", "t2", F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("body"))
    long = bodies.where(F.octet_length("body") >= length)
    found = long.mapInArrow(_anchor_rows(length), "t1 long, t2 long, key long, first long, last long")
    found = materialize(found, "anchors")
    shared = found.groupBy("key").count().where("count > 1").select("key", (F.col("count") > HOT_REGIONS).alias("hot"))
    shared = materialize(shared, "shared")
    own = join_checked(found, shared, ["key"], "inner", 2_000_000)
    own = own.groupBy("t1", "t2").agg(F.collect_set(F.struct("key", "first", "last", "hot")).alias("anchors"))

    distinct = bodies.groupBy("t1", "t2").agg(F.max("body").alias("body"), F.count("*").alias("copies"))
    cut = distinct.join(own, ["t1", "t2"]).select("t1", "t2", "body", "anchors")
    regions = cut.mapInArrow(_region_rows(length), "key long, t1 long, t2 long, first long, region binary, hot boolean")
    known = None
    if shared.where("hot").isEmpty():
        regions = regions.select("key", "t1", "t2", "first", "region", F.lit(False).alias("again"))
    else:
        regions = materialize(regions, "regions")
        release(found)  # nothing that follows reads the anchors, which take some 0.6 times the texts
        regions, known = _one_of_equals(regions)
    regions = regions.repartition("key").sortWithinPartitions("key")
    spans = regions.mapInArrow(_repeated_rows(length, shard), "t1 long, t2 long, begin long, end long")
    spans = spans.union(known) if known is not None else spans
    spans = spans.groupBy("t1", "t2").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    rows = distinct.join(spans, ["t1", "t2"], "left").select("t1", "t2", "body", "copies", "spans")
    return rows.mapInArrow(_kept_rows(length), "t1 long, t2 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, with_kept: bool = True) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, kept_sha256 and (``with_kept``) kept, the bytes left (same names are replaced)."""
    made = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_kept]
    docs = docs.drop(*made)
    kept = kept_texts(docs, text, length).select("t1", "t2", *made)
    carried = [c for c in docs.columns if with_kept or c != text]
    if not with_kept:  # texts are not moved for the sake of their digests
        kept = materialize(kept, "kept")
    rows = text_keys(docs.withColumnsRenamed({"t1": "t1__", "t2": "t2__"}), text)
    rows = rows.select(*[{"t1": "t1__", "t2": "t2__"}.get(c, c) for c in carried], "t1", "t2")
    out = rows.join(kept, ["t1", "t2"]).drop("t1", "t2").withColumnsRenamed({"t1__": "t1", "t2__": "t2"})
    return out.select(*carried, *made)
