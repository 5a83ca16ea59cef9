"""SentencePiece encoding and decoding by a relational lattice.

A text is cut where no piece can reach across, which the piece table itself tells: before each run of
spaces, around line ends, and between Latin letters and other characters if no piece has both. Every
distinct unit so found is encoded once: all its substrings of bounded length are exploded and
equi-joined to the piece table, these edges are grouped by unit, and a higher-order ``aggregate``
folds them to the pieces of the unit. Units that are frequent in a sample of documents, ``dictionary``
at most, are encoded once and sent to all tasks. All others go through the same steps in the tasks that
meet them, as arrays of many units at once (``Lattice``), so texts never move: bringing the codes of such
units to their texts by joins takes more than twice the input in disk. Unigram models, of which there is
no public one here, encode such units one by one.

The fold follows the kind of the model. For "unigram" it is Viterbi: the path of the greatest sum of
scores. A "bpe" model's scores are not additive (they are merge ranks), and the greatest sum gives
other pieces than the model does; there the fold goes through the edges in the order of their ranks,
and merges the two pieces that make up an edge where just two do. This gives the model's own pieces
if each piece is its own encoding by merges of ascending ranks, as in trained models; ``load_model``
checks that. Where pieces share a rank (runs of spaces do), a merge may complete an edge further left;
arrays go back to it, ``encode_units`` takes such units and those above ``LONGEST_UNIT`` characters,
which have more cuts than bits, one by one.
Characters without a piece become the pieces of their UTF-8 bytes. Decoding restores a text exactly,
but that U+2581, the mark of a space, reads as a space. Null texts have null ids, empty ones no ids.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm.common import let, materialize, small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Patterns (of Python and of Spark) that cut a text into units, finest first: Latin letters, others and
#: line ends, with the spaces before them; or all but spaces and line ends; or not at all.
CUTS = (f"{SPACE}*[{LATIN}]+|{SPACE}*[^{LATIN}{SPACE}\n]+|{SPACE}+|\n", f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n", "(?s).+")
#: Units that are sent to all tasks at most, and documents (about) among whose units these are chosen.
DICTIONARY, SAMPLE = 131_072, 20_000
#: Cuts of a unit, before and after each of its characters, are the bits of a positive long.
LONGEST_UNIT = 61
#: Units beside the frequent ones that a task remembers.
REMEMBERED = 100_000
#: An edge of the merge lattice as a long: rank, start, end, and id in so many bits; the last id marks a character without a piece.
END_BIT, START_BIT, RANK_BIT = 20, 26, 32
NO_PIECE = (1 << END_BIT) - 1
#: Rows that a task turns at once, and bytes of their texts, but for the last of them.
ROWS, BYTES = 128, 2_000_000


@dataclass(frozen=True)
class PieceModel:
    """Normal pieces with id and score, the ids of bytes, all pieces by id, and the kind of model."""

    pieces: dict[str, tuple[int, float]]
    first_byte: int
    by_id: tuple[bytes, ...]
    kind: str = "bpe"

    @cached_property
    def cut(self) -> str:
        """The finest of CUTS that leaves every piece in one unit; it looks at neighbouring characters alone, so no piece crosses it."""
        return next(c for c in CUTS if all(re.findall(c, p) == [p] for p in self.pieces))

    @cached_property
    def costs(self) -> dict[str, float]:
        return {p: -score for p, (_, score) in self.pieces.items()}

    @cached_property
    def tied(self) -> str:
        """A pattern of pieces that share their score with others; it finds every unit that holds one of two characters or more."""
        times = Counter(score for _, score in self.pieces.values())
        some = {p for p, (_, score) in self.pieces.items() if len(p) > 1 and times[score] > 1}
        least = [p for p in some if not any(p[a:b] in some for a in range(len(p)) for b in range(a + 2, len(p) + 1) if b - a < len(p))]
        return "|".join(map(re.escape, sorted(least))) or "(?!)"

    @property
    def longest(self) -> int:
        return max(map(len, self.pieces), default=1)


def load_model(path: str = MODEL, kind: str = "bpe") -> PieceModel:
    """Reads the piece table of a model with byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    special = {i for i in ids if model.is_control(i) or model.is_unknown(i) or model.is_byte(i)}
    pieces = {model.id_to_piece(i): (i, model.get_score(i)) for i in ids if i not in special}
    first = next(i for i in ids if model.is_byte(i))
    by_id = [b"" if i in special else model.id_to_piece(i).encode() for i in ids]
    by_id[first : first + 256] = [bytes((b,)) for b in range(256)]
    made = PieceModel(pieces, first, tuple(by_id), kind)
    if kind == "bpe" and (odd := next((p for p in pieces if len(p) > 1 and not _in_order(p, made.costs)), None)):
        raise ValueError(f"{path}: the piece {odd!r} is not its own encoding, by merges in the order of their ranks")
    return made


def units(text: Column, model: PieceModel) -> Column:
    """The units of a text; none for null and empty texts."""
    marked = F.concat(F.lit(SPACE), F.replace(text, F.lit(" "), F.lit(SPACE)))
    return F.when(text != "", F.regexp_extract_all(marked, F.lit(model.cut), F.lit(0))).otherwise(F.array().cast("array<string>"))


def frequent_units(docs: DataFrame, text: str, model: PieceModel, most: int) -> DataFrame:
    """The most frequent units that a sample of documents has twice or more."""
    drawn = docs.select(text).sample(min(1.0, SAMPLE / max(1, docs.count())), seed=1)
    counts = drawn.select(F.explode(units(F.col(text), model)).alias("unit")).groupBy("unit").agg(F.count("*").alias("n"))
    return materialize(counts.where("n > 1").orderBy(F.desc("n"), "unit").limit(most).select("unit"), "frequent")


def piece_table(spark: SparkSession, model: PieceModel) -> DataFrame:
    """(piece, id, score, rank): ranks number the scores from the best."""
    place = {score: k for k, score in enumerate(sorted({s for _, s in model.pieces.values()}, reverse=True))}
    rows = pd.DataFrame([(p, i, s, place[s]) for p, (i, s) in model.pieces.items()], columns=["piece", "id", "score", "rank"])
    return spark.createDataFrame(rows, "piece string, id int, score double, rank long")


def spans(unit_rows: DataFrame, model: PieceModel) -> DataFrame:
    """(unit, start, end, piece): all substrings of a unit that may be pieces, and all its characters."""
    rows = unit_rows.select("unit", F.explode(F.sequence(F.lit(0), F.length("unit") - 1)).alias("start"))
    rows = rows.select("*", F.explode(F.sequence(F.col("start") + 1, F.least(F.col("start") + model.longest, F.length("unit")))).alias("end"))
    return rows.withColumn("piece", F.substring(F.col("unit"), F.col("start") + 1, F.col("end") - F.col("start")))


def lattice(unit_rows: DataFrame, model: PieceModel) -> DataFrame:
    """(unit, edges): each edge is a piece with the characters ``start`` to ``end`` of the unit."""
    edges = spans(unit_rows, model).join(F.broadcast(piece_table(unit_rows.sparkSession, model)), "piece")
    edges = edges.groupBy("unit").agg(F.collect_list(F.struct("start", "end", "id", "score")).alias("edges"))
    return unit_rows.join(edges, "unit", "left").withColumn("edges", F.coalesce("edges", F.array().cast(edges.schema["edges"].dataType)))


def merge_lattice(unit_rows: DataFrame, model: PieceModel) -> DataFrame:
    """(unit, edges): each edge a long that sorts by rank, then from left to right; single characters are edges in any case."""
    rows = spans(unit_rows, model).join(F.broadcast(piece_table(unit_rows.sparkSession, model)), "piece", "left")
    rows = rows.where(F.col("id").isNotNull() | (F.col("end") - F.col("start") == 1))
    place = F.shiftleft(F.col("start").cast("long"), START_BIT) + F.shiftleft(F.col("end").cast("long"), END_BIT)
    edge = F.shiftleft(F.coalesce("rank", F.lit(0).cast("long")), RANK_BIT) + place + F.coalesce("id", F.lit(NO_PIECE))
    return rows.groupBy("unit").agg(F.sort_array(F.collect_list(edge)).alias("edges"))


def _bit(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), k.cast("int"))


def _fold_merges(n: Column, edges: Column) -> Column:
    """The edges that are the pieces of a byte-pair model, from left to right and without their ranks.

    The state has a bit for each place where one piece ends and another begins.
    """
    start = lambda e: F.shiftright(e, START_BIT).bitwiseAND(63)
    end = lambda e: F.shiftright(e, END_BIT).bitwiseAND(63)
    outer = lambda e: _bit(start(e)) + _bit(end(e))
    inner = lambda e: _bit(end(e)) - _bit(start(e) + 1)

    def whole(cuts: Column, e: Column, parts: int) -> Column:
        return (F.bit_count(cuts.bitwiseAND(inner(e))) == parts - 1) & (cuts.bitwiseAND(outer(e)) == outer(e))

    merged = F.aggregate(edges, _bit(n + 1) - 1, lambda cuts, e: F.when(whole(cuts, e, 2), cuts.bitwiseAND(F.bitwise_not(inner(e)))).otherwise(cuts))
    low = F.lit((1 << RANK_BIT) - 1).cast("long")
    return let(merged, lambda cuts: F.sort_array(F.transform(F.filter(edges, lambda e: whole(cuts, e, 1)), lambda e: e.bitwiseAND(low))))


def _fold_viterbi(n: Column, edges: Column, unknown: float) -> Column:
    """Where the pieces of the path of the greatest sum of scores end; a character alone scores ``unknown``."""

    def step(best: Column, end: Column) -> Column:
        def path(e: Column) -> Column:
            return F.when(e["end"] == end, F.struct((F.get(best, e["start"])["score"] + e["score"]).alias("score"), e["start"].alias("start")))

        alone = F.struct((F.get(best, end - 1)["score"] + F.lit(unknown)).alias("score"), (end - 1).alias("start"))
        return F.concat(best, F.array(F.array_max(F.concat(F.transform(edges, path), F.array(alone)))))

    def back(best: Column) -> Column:
        way = lambda cuts, _: F.when(F.get(cuts, F.lit(0)) == 0, cuts).otherwise(F.concat(F.array(F.get(best, F.get(cuts, F.lit(0)))["start"]), cuts))
        return F.aggregate(F.sequence(F.lit(1), n), F.array(n), way)

    start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("start")))
    return let(F.aggregate(F.sequence(F.lit(1), n), start, step), back)


def _bytes_of(text: Column, model: PieceModel) -> Column:
    """The ids of the UTF-8 bytes of a text."""
    code = F.hex(F.encode(text, "UTF-8"))
    return F.transform(F.sequence(F.lit(1), F.length(code), F.lit(2)), lambda k: F.conv(F.substring(code, k, F.lit(2)), 16, 10).cast("int") + model.first_byte)


def _path_ids(unit_rows: DataFrame, model: PieceModel) -> DataFrame:
    """(unit, ids) by Viterbi."""
    rows, n = lattice(unit_rows, model), F.length("unit")
    worst = min((s for _, s in model.pieces.values()), default=0.0) - 10

    def ids(cut: Column, j: Column, all_cuts: Column) -> Column:
        start, end = cut, F.get(all_cuts, j + 1)
        own = F.get(F.filter("edges", lambda e: (e["start"] == start) & (e["end"] == end)), F.lit(0))["id"]
        return F.when(own.isNotNull(), F.array(own)).otherwise(_bytes_of(F.substring(F.col("unit"), start + 1, end - start), model))

    parts = let(_fold_viterbi(n, F.col("edges"), worst), lambda c: F.flatten(F.transform(F.slice(c, F.lit(1), F.size(c) - 1), lambda x, j: ids(x, j, c))))
    return rows.select("unit", parts.alias("ids"))


def _merged_ids(unit_rows: DataFrame, model: PieceModel) -> DataFrame:
    """(unit, ids) by merges."""

    def ids(edge: Column) -> Column:
        own = edge.bitwiseAND(NO_PIECE).cast("int")
        start = F.shiftright(edge, START_BIT).cast("int") + 1
        return F.when(own != NO_PIECE, F.array(own)).otherwise(_bytes_of(F.substring(F.col("unit"), start, F.lit(1)), model))

    rows = merge_lattice(unit_rows, model)
    return rows.select("unit", F.flatten(F.transform(_fold_merges(F.length("unit"), F.col("edges")), ids)).alias("ids"))


def foldable(model: PieceModel) -> Column:
    """Whether a unit's merges can be folded as one pass over bits: neither too long nor with pieces of one rank."""
    short = F.length("unit") <= LONGEST_UNIT
    return short & ~F.col("unit").rlike(model.tied) if model.kind == "bpe" else short


def encode_units(unit_rows: DataFrame, model: PieceModel) -> DataFrame:
    """(unit, ids) of each unit, from its lattice; units must not repeat."""
    alone = encode_unit if model.kind == "bpe" else best_path

    def encode_long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [alone(u, model) for u in batch.column(0).to_pylist()]
            yield pa.record_batch({"unit": batch.column(0), "ids": pa.array(found, pa.list_(pa.int32()))})

    rows = unit_rows.select("unit").where("unit <> ''")
    folds = foldable(model)
    short = rows.where(folds)
    long = rows.where(~folds).mapInArrow(encode_long, "unit string, ids array<int>")
    return (_merged_ids if model.kind == "bpe" else _path_ids)(short, model).union(long)


def _merged(symbols: list[str], costs: dict[str, float]) -> list[str]:
    """Best pair first, by looking at all pairs each time: for short units."""
    of, never = costs.get, float("inf")
    pairs = [of(a + b, never) for a, b in zip(symbols, symbols[1:], strict=False)]
    while pairs and (best := min(pairs)) < never:
        i = pairs.index(best)
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = of(symbols[i - 1] + symbols[i], never)
        if i < len(pairs):
            pairs[i] = of(symbols[i] + symbols[i + 1], never)
    return symbols


def _in_order(piece: str, costs: dict[str, float]) -> bool:
    """Whether a piece is its own encoding, and its last merge has no better rank than those before it."""
    cost = costs.pop(piece)
    parts = _merged(list(piece), costs)
    costs[piece] = cost
    return len(parts) == 2 and all(len(x) == 1 or costs[x] <= cost for x in parts)


def _merged_long(symbols: list[str], costs: dict[str, float]) -> list[str]:
    """The same, by a heap over a linked list."""
    after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
    heap: list[tuple[float, int, str]] = []

    def meet(i: int, j: int) -> None:
        both = symbols[i] + symbols[j]
        if both in costs:
            heapq.heappush(heap, (costs[both], i, both))

    for i in range(len(symbols) - 1):
        meet(i, i + 1)
    while heap:
        _, i, both = heapq.heappop(heap)
        j = after[i] if symbols[i] else len(symbols)
        if j >= len(symbols) or symbols[i] + symbols[j] != both:
            continue
        symbols[i], symbols[j] = both, ""
        after[i] = after[j]
        if after[i] < len(symbols):
            before[after[i]] = i
            meet(i, after[i])
        if before[i] >= 0:
            meet(before[i], i)
    return [s for s in symbols if s]


def encode_unit(unit: str, model: PieceModel) -> list[int]:
    """The pieces of one unit of a byte-pair model."""
    out: list[int] = []
    for s in (_merged if len(unit) <= LONGEST_UNIT else _merged_long)(list(unit), model.costs):
        if s in model.pieces:
            out.append(model.pieces[s][0])
        else:
            out += [model.first_byte + b for b in s.encode("utf-8", "replace")]
    return out


def best_path(unit: str, model: PieceModel) -> list[int]:
    """The pieces of one unit of a unigram model."""
    worst = min((s for _, s in model.pieces.values()), default=0.0) - 10
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(unit) + 1):
        ways = [(best[start][0] + found[1], start) for start in range(max(0, end - model.longest), end) if (found := model.pieces.get(unit[start:end]))]
        best.append(max([*ways, (best[end - 1][0] + worst, end - 1)]))
    out: list[list[int]] = []
    end = len(unit)
    while end:
        part = unit[best[end][1] : end]
        out.append([model.pieces[part][0]] if part in model.pieces else [model.first_byte + b for b in part.encode("utf-8", "replace")])
        end = best[end][1]
    return list(chain.from_iterable(reversed(out)))


def _with_column(df: DataFrame, source: str, name: str, kind: T.DataType, convert) -> DataFrame:
    """df with ``name``, made from ``source`` a few rows at a time; ``convert()`` gives the function of an Arrow array."""
    small_batches(df.sparkSession)
    out = df.drop(name)
    at = df.columns.index(source)
    kept = [i for i, c in enumerate(df.columns) if c.lower() != name.lower()]
    names = [*out.columns, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = convert()
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], of(batch.column(at))], names)

    return df.mapInArrow(run, T.StructType([*out.schema.fields, T.StructField(name, kind)]))


class Lattice:
    """The lattices of many units at once, as arrays: exploded, equi-joined to the piece table, grouped and folded.

    This is ``merge_lattice`` and its fold for units that only few rows have. All starts are joined to the
    table of (beginning of a piece, next character) until no piece goes on, which gives the edges. Where no
    edge reaches across, a unit falls apart; each part is folded by itself, all parts together.
    """

    BITS = 19  # of a slot of the join table, for a model of 32,000 pieces; more for larger ones

    def __init__(self, model: PieceModel):
        place = {score: k for k, score in enumerate(sorted({s for _, s in model.pieces.values()}, reverse=True))}
        nodes, keys = {"": 0}, []
        for piece in model.pieces:
            for k, c in enumerate(piece):
                if (begun := piece[: k + 1]) not in nodes:
                    nodes[begun] = len(nodes)
                    keys.append(nodes[piece[:k]] << 21 | ord(c))
        self.id, self.rank = np.full(len(nodes), -1, np.int32), np.zeros(len(nodes), np.int64)
        for piece, (i, score) in model.pieces.items():
            self.id[nodes[piece]], self.rank[nodes[piece]] = i, place[score]
        #: Ranks that several pieces share.
        self.tied = np.bincount(self.rank[self.id >= 0], minlength=len(place)) > 1
        self.longest, self.first_byte, self.bits = model.longest, model.first_byte, max(self.BITS, len(keys).bit_length() + 2)
        self.keys, self.nodes = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        for node, (key, slot) in enumerate(zip(keys, self._slots(np.array(keys, np.int64)).tolist(), strict=True), 1):
            while self.keys[slot] >= 0:
                slot = slot + 1 & (1 << self.bits) - 1
            self.keys[slot], self.nodes[slot] = key, node

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _next(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The beginnings with one more character; -1 if no piece begins so."""
        keys = nodes.astype(np.int64) << 21 | chars
        slots = self._slots(keys)
        held = self.keys[slots]
        out = np.where(held == keys, self.nodes[slots], np.int32(-1))
        todo = np.flatnonzero((held != keys) & (held >= 0))
        while len(todo):
            slots[todo] = slots[todo] + 1 & (1 << self.bits) - 1
            held = self.keys[slots[todo]]
            hit = held == keys[todo]
            out[todo[hit]] = self.nodes[slots[todo[hit]]]
            todo = todo[~hit & (held >= 0)]
        return out

    def _edges(self, chars: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, rank) of the pieces of two characters or more; ``last`` is where the unit of a character ends."""
        at, size, found = np.arange(len(chars)), 1, []
        node = self._next(np.zeros(len(chars), np.int32), chars)
        while len(at):
            on = (node >= 0) & (at + size < last[at])
            at = at[on]
            node = self._next(node[on], chars[at + size])
            size += 1
            piece = np.flatnonzero((node >= 0) & (self.id[node] >= 0))
            found.append((at[piece], at[piece] + size, self.rank[node[piece]]))
        return tuple(map(np.concatenate, zip(*found, strict=True)))

    def _cuts(self, chars: np.ndarray, starts: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Where pieces begin, a boolean for each character."""
        begin, end, rank = self._edges(chars, last)
        crossed = np.cumsum(np.bincount(begin + 1, minlength=len(chars) + 1) - np.bincount(end, minlength=len(chars) + 1))[:-1] > 0
        crossed[starts] = False
        first = np.flatnonzero(~crossed)
        part = np.cumsum(~crossed) - 1
        sizes = np.diff(first, append=len(chars))
        own, start, stop = part[begin], begin - first[part[begin]], end - first[part[begin]]
        alone = sizes > LONGEST_UNIT
        alone[own[self.tied[rank]]] = True
        short = ~alone[own]
        # One number sorts the edges by part, by rank, and from left to right.
        edges = np.sort(own[short] << 36 | rank[short] << 12 | start[short] << 6 | stop[short])
        of, at, count = np.unique(edges >> 36, return_index=True, return_counts=True)
        order = np.argsort(-count, kind="stable")
        of, at, count = of[order], at[order], count[order]
        one = np.uint64(1)
        bits = (one << (sizes[of] + 1).astype(np.uint64)) - one
        for k in range(int(count[0]) if len(count) else 0):
            n = int(np.searchsorted(-count, -k, "left"))
            edge = edges[at[:n] + k].astype(np.uint64)
            low, high = one << (edge >> np.uint64(6) & np.uint64(63)), one << (edge & np.uint64(63))
            now, outer = bits[:n], low | high
            inside = now & (high - (low << one))
            two = ((now & outer) == outer) & (inside != 0) & ((inside & (inside - one)) == 0)
            bits[:n] = np.where(two, now ^ inside, now)
        whole = np.full(len(first), ~np.uint64(0))
        whole[of] = bits
        inner = np.minimum(np.arange(len(chars)) - first[part], 63).astype(np.uint64)
        cuts = (whole[part] >> inner & one).astype(bool)
        return cuts if short.all() else self._cuts_one_by_one(cuts, begin[~short], end[~short], rank[~short])

    def _cuts_one_by_one(self, cuts: np.ndarray, begin: np.ndarray, end: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The same fold edge by edge. Among pieces of one rank, a merge may complete an edge further left, which is then next."""
        order = np.lexsort((end, begin, rank))
        begins, ends, ranks = (x[order].tolist() for x in (begin, end, rank))
        held, k, first = bytearray(cuts.tobytes() + b"\1"), 0, 0
        while k < len(begins):
            a, b = begins[k], ends[k]
            if ranks[k] != ranks[first]:
                first = k
            k += 1
            if held[a] and held[b] and held.count(1, a + 1, b) == 1:
                held[held.index(1, a + 1, b)] = 0
                if self.tied[ranks[k - 1]]:
                    k = bisect_left(begins, b - self.longest, first, k)
        return np.frombuffer(held, bool)[:-1]

    def codes(self, units: list[str]) -> list[bytes]:
        """The ids of each unit, big-endian integers of 32 bits."""
        if not units:
            return []
        text = "".join(units)
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        ends = np.cumsum(sizes)
        begin = np.flatnonzero(self._cuts(chars, ends - sizes, np.repeat(ends, sizes)))
        end = np.append(begin[1:], len(chars))
        node, on, k = np.zeros(len(begin), np.int32), np.arange(len(begin)), 0
        while len(on):
            node[on] = self._next(node[on], chars[begin[on] + k])
            k += 1
            on = on[(node[on] >= 0) & (begin[on] + k < end[on])]
        ids = np.where(node >= 0, self.id[node], np.int32(-1)).astype(">i4")
        odd = np.flatnonzero(ids < 0)
        bytes_of = [np.frombuffer(text[i].encode("utf-8", "replace"), np.uint8) + np.int32(self.first_byte) for i in begin[odd].tolist()]
        n = np.ones(len(ids), np.int64)
        n[odd] = list(map(len, bytes_of))
        out = np.repeat(ids, n)
        if len(odd):
            out[np.repeat(ids < 0, n)] = np.concatenate(bytes_of)
        stops = (4 * np.cumsum(n)[np.searchsorted(begin, ends) - 1]).tolist()
        data = out.tobytes()
        return [data[a:b] for a, b in zip([0, *stops], stops, strict=False)]


class _Ids(dict):
    """The ids of units, as the bytes of 32-bit integers; ``own`` has those that a task has met."""

    own: dict[str, bytes]

    def __missing__(self, unit: str) -> bytes:
        return self.own[unit]


def _packed(coded: DataFrame) -> DataFrame:
    """(unit, code): the ids as big-endian integers of 32 bits."""
    return coded.select("unit", F.unhex(F.array_join(F.transform("ids", lambda i: F.lpad(F.hex(i), 8, "0")), "")).alias("code"))


def encode(docs: DataFrame, model: PieceModel, text: str = "text", name: str = "ids", dictionary: int = DICTIONARY) -> DataFrame:
    """docs with ``name``, the ids of the pieces of the whole text (a column of this name is replaced).

    Texts stay where they are. Units that are not among the frequent ones go through the lattice in the task that meets them.
    """
    small_batches(docs.sparkSession)
    frequent = frequent_units(docs, text, model, dictionary).where(foldable(model))
    known = _Ids(_packed(encode_units(frequent, model)).toPandas().itertuples(index=False))
    shared = docs.sparkSession.sparkContext.broadcast((known, Lattice(model) if model.kind == "bpe" else None))
    kept = [c for c in docs.columns if c.lower() != name.lower()]
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField(name, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (of, lattice), find = shared.value, re.compile(model.cut).findall
        of.own = {}
        for whole in batches:
            sizes = pc.fill_null(pc.binary_length(whole.column(whole.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
            groups = np.cumsum(sizes, dtype=np.int64) // BYTES + np.arange(whole.num_rows) // ROWS
            for start, end in pairwise([*np.flatnonzero(np.diff(groups, prepend=-1)).tolist(), whole.num_rows]):
                batch = whole.slice(start, end - start)
                texts = batch.column(batch.schema.get_field_index(text))
                split = [find(SPACE + x.replace(" ", SPACE)) if x else [] for x in texts.to_pylist()]
                if len(of.own) > REMEMBERED:
                    of.own = {}
                new = list(set(chain.from_iterable(split)).difference(of, of.own))
                codes = lattice.codes(new) if lattice else [np.array(best_path(u, model), ">i4").tobytes() for u in new]
                of.own.update(zip(new, codes, strict=True))
                found = [b"".join(map(of.__getitem__, own)) for own in split]
                ends = np.cumsum([0, *(len(x) // 4 for x in found)]).astype(np.int32)
                ids = pa.array(np.frombuffer(b"".join(found), ">i4").astype(np.int32))
                made = pa.ListArray.from_arrays(pa.array(ends), ids, mask=texts.is_null())
                yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in kept], made], [*kept, name])

    return docs.mapInArrow(run, schema)


def decode(df: DataFrame, model: PieceModel, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """df with ``name``, the text of the ids (a column of this name is replaced)."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def decoder():
        piece = [x.replace(SPACE.encode(), b" ") for x in shared.value.by_id].__getitem__

        def texts(rows: pa.Array) -> pa.Array:
            values = rows.values.to_numpy(zero_copy_only=False)
            ends = rows.offsets.to_pylist()
            of = lambda a, b: b"".join(map(piece, values[a:b].tolist())).decode("utf-8", "replace")[1:]
            return pa.array([of(a, b) if there else None for a, b, there in zip(ends, ends[1:], rows.is_valid().to_pylist(), strict=False)], pa.string())

        return texts

    return _with_column(df, ids, name, T.StringType(), decoder)
