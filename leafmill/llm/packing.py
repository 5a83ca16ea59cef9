"""Best-fit packing of documents into training sequences by a grouping genetic algorithm on islands.

A document is its tokens and one end token. Documents longer than a sequence are cut into pieces, all
but the last of them full; a full piece is a sequence of its own. The others are packed. They are
dealt by a hash of their row into blocks of about ``BLOCK`` pieces, and each block is a problem of its
own, solved by ``ISLANDS`` populations. An individual is a list of bins. Crossover injects some of the
best filled bins of one parent whole into the other, removes the bins that hold a piece twice, and
puts the displaced pieces back by best fit, longest first; mutation displaces the emptiest bins and a
few more. An individual is better if it has fewer bins or, with as many, fuller ones (sum of squared
fills), so what is free gathers in few bins. After each epoch an island's best migrate to the next
island of its block: islands are rows that tasks evolve, and migration is a join. A block that reaches
its bound, the sum of lengths over the capacity, rounded up, evolves no further.

Blocks alone would leave each a sequence that is not full. So each block keeps its fuller bins only and
gives the emptiest ``1 / PASSED_ON`` of them up to the next level, where their pieces are dealt into
blocks again, until one block holds all. A level has some sixteenth of the pieces of the one before, so
no task, group or driver ever holds more than a block.

Null and empty texts are one end token. Rows that repeat are documents of their own, rows without an
id too. Empty tables give empty results. All random choices are seeded by level, block, island and
epoch, so a task that runs again does the same.
"""

from __future__ import annotations

import codecs
import os
import random
import re
import zlib
from collections.abc import Iterator, Sequence
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm.common import free_name, materialize, release, small_batches

CAPACITY = 2048
#: Pieces of a block (about), islands of a block, individuals of an island, and how long they evolve.
BLOCK, ISLANDS, POPULATION, EPOCHS, GENERATIONS = 1024, 3, 6, 2, 5
#: Share of a block's bins that goes on to the next level.
PASSED_ON = 16
#: Words of a generation that a worker remembers, beside those of the texts at hand.
REMEMBERED = 500_000
#: Rows that a task encodes at once, and bytes after which it takes no more of them, or goes on behind the next white space.
ROWS, BYTES = 1000, 4_000_000
#: Kinds of bytes in words that are cut here; OTHER is in none of them.
SPACE, LETTER, DIGIT, SYMBOL, OTHER = range(5)
#: Two bytes with this one before are the letters U+00C0 to U+00FF, but for two signs among them.
LATIN, SIGNS = 0xC3, (0x97, 0xB7)
#: Words that are cut here.
PLAIN = re.compile(rb"(?:[!-~]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch
GAP = re.compile(rb"[\t-\r ]").search
MADE = ("piece", "start", "length", "ids_crc32", "sequence_id", "offset")

Bins = list[list[int]]


# ---- tokens ----


def _kinds() -> np.ndarray:
    kinds = np.full(256, OTHER, np.uint8)
    for byte in range(0x21, 0x7F):
        kinds[byte] = LETTER if chr(byte).isalpha() else DIGIT if chr(byte).isdigit() else SYMBOL
    kinds[list(b"\t\n\x0b\x0c\r ")] = SPACE
    # What follows another first byte than LATIN stands with that byte in a run that is not cut.
    kinds[[LATIN, *range(0x80, 0xC0)]] = LETTER
    return kinds


KINDS, LOWER = _kinds(), np.frombuffer(bytes(range(256)).lower(), np.uint8)


def _words(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word of a text begins, where it begins when words alone are left, and these.

    Words are runs of letters, single digits, runs of symbols, and an apostrophe with certain letters after it, all in
    small letters. A run without white space that has a marked token or other characters than ASCII's and the letters
    to U+00FF is one word and left as it is, for marks may join its letters. Begins and ends with white space.
    """
    raw = np.frombuffer(b" " + text + b"   ", np.uint8)
    kinds, low = KINDS[raw], LOWER[raw]
    begins = np.zeros(len(raw), bool)
    np.not_equal(kinds[1:], kinds[:-1], out=begins[1:])
    begins |= kinds == DIGIT
    words = kinds != SPACE
    begins &= words

    marks = np.flatnonzero(raw == ord("'"))
    marks = marks[begins[marks]]
    after, then = low[marks + 1], low[marks + 2]
    one = np.isin(after, list(b"stmd"))
    two = np.isin(after, list(b"rv")) & (then == ord("e")) | (after == ord("l")) & (then == ord("l"))
    begins[marks[one | two] + 1] = False
    begins[marks[two] + 2] = False
    ends = np.concatenate([marks[one] + 2, marks[two] + 3])
    begins[ends] = words[ends]

    second = np.flatnonzero(raw == LATIN) + 1
    capital = second[(raw[second] >= 0x80) & (raw[second] <= 0x9E)]
    low[capital] += 0x20
    token = np.flatnonzero(raw == ord("<"))
    whole = np.concatenate([np.flatnonzero(kinds == OTHER), second[np.isin(raw[second], SIGNS)], token[raw[token + 1] == ord("|")]])
    if len(whole):
        spaces = np.flatnonzero(~words)
        stop = np.unique(np.searchsorted(spaces, whole))
        first, stop = spaces[stop - 1] + 1, spaces[stop]
        edges = np.zeros(len(raw), np.int8)
        edges[first], edges[stop] = 1, -1
        inside = np.cumsum(edges, dtype=np.int8).view(bool)
        begins[inside] = False
        begins[first] = True
        np.copyto(low, raw, where=inside)
    return np.flatnonzero(begins) - 1, np.flatnonzero(begins[words]), low[words]


def _parts(text: bytes) -> Iterator[bytes]:
    """A long text, cut at white space."""
    at = 0
    while gap := GAP(text, at + BYTES):
        yield text[at : gap.start()]
        at = gap.start()
    yield text[at:]


def _byte_letters() -> str:
    """The letters for bytes in a vocabulary of bytes: printable ones are themselves. A space stays one."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    letters = [chr(x) if x in shown else chr(next(rest)) for x in range(256)]
    return "".join(letters[:0x20] + [" "] + letters[0x21:])


BYTE_LETTERS = _byte_letters()


class WordCoder:
    """Tokens of texts by a tokenizer that drops white space and never joins what ``_words`` separates.

    So a text's tokens are those of its words, one after the other, and a word is encoded once. New words
    are encoded together; each ends with a token that only ends words, which tells them apart. Words that
    are not cut any further go through the whole tokenizer. A tokenizer that differs in this is refused.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        # Words are cut and lower-cased already, so the same model takes them without the preparation of texts.
        self.plain.normalizer, self.plain.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        vocabulary = self.whole.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        #: Two generations of words: the older goes when the younger has grown, but what is met again is kept.
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        for sample in ("aB  cd,\n\tx", "it's 12. no'LL! ÀÉß×", "\x01 'tis <|a|> B"):
            if b"".join(self.texts([sample.encode()])) != self._ids([sample])[0]:
                raise ValueError(f"{path}: its tokens reach across words")
        if any("<|" not in x.content or GAP(x.content.encode()) for x in self.whole.get_added_tokens_decoder().values()):
            raise ValueError(f"{path}: its marked tokens are not those of words with <|")
        self.young = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, words: list[bytes]) -> None:
        """Encodes words that are cut already at once."""
        letters = codecs.charmap_decode(b" ".join(words), "strict", BYTE_LETTERS)[0]
        ids = np.array(self.plain.encode_batch_fast([letters], add_special_tokens=False)[0].ids, "<u4")
        data, stops = ids.tobytes(), (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
        if len(stops) != len(words) or stops[-1] != len(data):
            raise ValueError("a word's last token is not one that ends words")
        self.young |= zip(words, (data[a:b] for a, b in zip([0, *stops], stops, strict=False)), strict=True)

    def learn(self, words: list[bytes]) -> list[bytes]:
        """The ids of different words, which the young generation has from now on."""
        if len(self.young) > REMEMBERED:
            self.young, self.old = {}, self.young
        found = list(map(self.young.get, words))
        missing = [k for k, ids in enumerate(found) if ids is None]
        # What only the older generation has becomes young again.
        again = {words[k]: ids for k in missing if (ids := self.old.get(words[k])) is not None} if self.old else {}
        new = [words[k] for k in missing if words[k] not in again]
        plain, whole, tails = [], [], {}
        for word in new:
            if word.isalpha() or PLAIN(word) and b"<|" not in word:
                plain.append(word)
                continue
            head = word.rstrip(b".,")
            if head != word and b"<|" not in word and head.decode()[-1].isalpha():
                tails[word] = head, word[len(head) :]
            else:
                whole.append(word)
        if tails:
            # A letter and the stops behind it are two words, so many words differ in what is behind them alone.
            heads, stops = (set(x).difference(self.young, again, plain, whole) for x in zip(*tails.values(), strict=True))
            plain += stops
            whole += heads
        self.young |= again
        if plain:
            self._together(plain)
        if whole:
            self.young |= zip(whole, self._ids([word.decode() for word in whole]), strict=True)
        for word, (head, tail) in tails.items():
            self.young[word] = self.young[head] + self.young[tail]
        for k in missing:
            found[k] = self.young[words[k]]
        return found

    def _encoded(self, texts: list[bytes]) -> Iterator[bytes]:
        if not texts:
            return
        at, starts, data = _words(b" ".join(texts))
        offsets = np.append(starts, len(data)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        # Arrow's own to_pylist makes a scalar of each.
        _, stops, data = words.dictionary.buffers()
        stops, data = np.frombuffer(stops, np.int32)[: len(words.dictionary) + 1].tolist(), data.to_pybytes() if data else b""
        different = [data[a:b] for a, b in zip(stops, stops[1:], strict=False)]
        # What these words add may go beyond the bound, but is forgotten next.
        ids = pa.array(self.learn(different), pa.large_binary()).take(words.indices)
        _, stops, data = ids.buffers()
        first = np.cumsum([0, *(len(x) + 1 for x in texts)])
        cuts = np.frombuffer(stops, np.int64)[np.searchsorted(at, first)].tolist() if len(at) else [0] * len(first)
        data = memoryview(data or b"")
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield bytes(data[a:b])

    def texts(self, texts: list[bytes]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each whole UTF-8 text."""
        part, size = [], 0
        for text in texts:
            if size + len(text) > BYTES or len(part) == ROWS:
                yield from self._encoded(part)
                part, size = [], 0
            if len(text) > BYTES:
                yield b"".join(chain.from_iterable(self._encoded([x]) for x in _parts(text)))
            else:
                part.append(text)
                size += len(text)
        yield from self._encoded(part)


@cache
def _coder(path: str) -> WordCoder:
    """One for each worker, so that its words are known to all its tasks."""
    return WordCoder(path)


def _cut(path: str, capacity: int, end: int, with_ids: bool):
    stop = np.array([end], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path)
        for big in batches:
            for first in range(0, len(big), ROWS):
                batch = big.slice(first, ROWS)
                rows, starts, lengths, checks, ids = [], [], [], [], []
                for row, data in enumerate(coder.texts(batch.column(0).cast(pa.large_binary()).to_pylist())):
                    data += stop
                    for at in range(0, len(data), 4 * capacity):
                        own = data[at : at + 4 * capacity]
                        rows.append(row)
                        starts.append(at // 4)
                        lengths.append(len(own) // 4)
                        checks.append(zlib.crc32(own))
                        if with_ids:
                            ids.append(np.frombuffer(own, "<u4").astype(np.int32))
                start = np.array(starts, np.int64)
                made = {"piece": pa.array(start // capacity, pa.int32()), "start": pa.array(start), "length": pa.array(lengths, pa.int64()), "ids_crc32": pa.array(checks, pa.int64())}
                if with_ids:
                    made["ids"] = pa.array(ids, pa.list_(pa.int32()))
                kept = batch.select(batch.schema.names[1:]).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*kept.columns, *made.values()], [*kept.schema.names, *made])

    return cut


def pieces(
    docs: DataFrame, path: str, text: str = "text", keep: Sequence[str] = ("doc_id",), capacity: int = CAPACITY, end: int = 0, with_ids: bool = False
) -> DataFrame:
    """Kept columns, piece, start, length, ids_crc32 and, if wanted, ids of each piece of each document."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text_"), *keep)
    made = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())]
    made += [("ids", T.ArrayType(T.IntegerType()))] if with_ids else []
    fields = [*rows.schema.fields[1:], *(T.StructField(c, k) for c, k in made)]
    return rows.mapInArrow(_cut(path, capacity, end, with_ids), T.StructType(fields))


# ---- one island ----


class Problem:
    """The lengths of a block's pieces and the capacity of a bin."""

    def __init__(self, lengths: Sequence[int], capacity: int):
        self.lengths, self.capacity = list(lengths), capacity
        self.bound = -(-sum(self.lengths) // capacity)
        #: Of the bins that were made last.
        self.fills: list[int] = []

    def fill(self, own: list[int]) -> int:
        return sum(map(self.lengths.__getitem__, own))

    def best_fit(self, bins: Bins, displaced: list[int]) -> Bins:
        """Puts each displaced piece, in their order, into the fullest bin that takes it, or a new one."""
        lengths, capacity = self.lengths, self.capacity
        fills = [sum(map(lengths.__getitem__, own)) for own in bins]
        by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        mask = 0  # which amounts of free room some bin has
        for k, fill in enumerate(fills):
            free = capacity - fill
            by_free[free].append(k)
            mask |= 1 << free
        for piece in displaced:
            size = lengths[piece]
            if room := mask >> size:
                free = size + (room & -room).bit_length() - 1
                k = by_free[free].pop()
                if not by_free[free]:
                    mask ^= 1 << free
                bins[k].append(piece)
                fills[k] += size
            else:
                free, k = capacity, len(bins)
                bins.append([piece])
                fills.append(size)
            by_free[free - size].append(k)
            mask |= 1 << (free - size)
        self.fills = fills
        return bins

    def value(self, bins: Bins) -> tuple[int, int]:
        """Greater is better."""
        return -len(bins), sum(self.fill(own) ** 2 for own in bins)

    def crossed(self, first: Bins, second: Bins, draw: random.Random) -> Bins:
        """The first parent with some of the best filled bins of the second."""
        by_fill = sorted(second, key=self.fill, reverse=True)
        top = by_fill[: max(1, len(by_fill) // 2)]
        injected = draw.sample(top, max(1, len(top) // 3))
        held = {piece for own in injected for piece in own}
        kept, displaced = [list(own) for own in injected], []
        for own in first:
            if held.isdisjoint(own):
                kept.append(list(own))
            else:
                displaced += [piece for piece in own if piece not in held]
        return self.best_fit(kept, sorted(displaced, key=self.lengths.__getitem__, reverse=True))

    def mutated(self, bins: Bins, draw: random.Random) -> Bins:
        """Its emptiest bins and some others are displaced."""
        by_fill = sorted(bins, key=self.fill)
        empty = max(1, len(bins) // 20)
        others = set(draw.sample(range(empty, len(bins)), min(len(bins) - empty, 2 + len(bins) // 20)))
        displaced = [piece for k, own in enumerate(by_fill) if k < empty or k in others for piece in own]
        kept = [list(own) for k, own in enumerate(by_fill) if k >= empty and k not in others]
        draw.shuffle(displaced)
        if draw.random() < 0.7:
            displaced.sort(key=self.lengths.__getitem__, reverse=True)
        return self.best_fit(kept, displaced)

    def founders(self, draw: random.Random) -> list[Bins]:
        """Best fit, longest first; and after it orders that are shuffled in part."""
        order = sorted(range(len(self.lengths)), key=self.lengths.__getitem__, reverse=True)
        found = [self.best_fit([], order)]
        while len(found) < POPULATION and -len(found[0]) + self.bound < 0:
            spread = draw.choice((0.02, 0.1, 0.3)) * self.capacity
            noisy = sorted(order, key=lambda piece: self.lengths[piece] + draw.uniform(-spread, spread), reverse=True)
            found.append(self.best_fit([], noisy))
        return found

    def evolve(self, population: list[Bins], draw: random.Random) -> list[Bins]:
        """Best first. Each generation, the worst individual gives way to a child that is better than it and not there yet."""
        ranked = sorted(((self.value(x), x) for x in population), key=lambda x: x[0], reverse=True)
        for _ in range(GENERATIONS * POPULATION):
            if ranked[0][0][0] == -self.bound:
                break
            first, second = (ranked[min(draw.sample(range(len(ranked)), min(2, len(ranked))))][1] for _ in range(2))
            child = self.crossed(first, second, draw) if first is not second else self.mutated(first, draw)
            if draw.random() < 0.3:
                child = self.mutated(child, draw)
            value = -len(child), sum(x * x for x in self.fills)
            if value > ranked[-1][0] and all(value != x[0] for x in ranked):
                ranked = sorted([*ranked[: POPULATION - 1], (value, child)], key=lambda x: x[0], reverse=True)
        return [x for _, x in ranked]


# ---- islands over Spark ----

STATE = "block long, island int, lengths array<int>, population array<array<int>>, bins int, squares long, done boolean"


def _bins(of: np.ndarray) -> Bins:
    """Bins from the number of each piece's bin."""
    made: Bins = [[] for _ in range(int(of.max()) + 1)]
    for piece, k in enumerate(of.tolist()):
        made[k].append(piece)
    return made


def _numbers(bins: Bins, size: int) -> np.ndarray:
    out = np.empty(size, np.int32)
    for k, own in enumerate(bins):
        out[own] = k
    return out


def _epoch(level: int, epoch: int, capacity: int):
    """Evolves each island; a population is a list of the numbers of the pieces' bins, best first."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for r in part.itertuples():
                problem, draw = Problem(np.asarray(r.lengths).tolist(), capacity), random.Random(f"{level} {r.block} {r.island} {epoch}")
                population = [_bins(np.asarray(x)) for x in r.population] or problem.founders(draw)
                population = problem.evolve(population, draw)
                bins, squares = problem.value(population[0])
                rows.append((r.block, r.island, r.lengths, [_numbers(x, len(r.lengths)) for x in population], -bins, squares, -bins == problem.bound))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in STATE.split(", ")])

    return run


def _spread(df: DataFrame, blocks: int) -> DataFrame:
    """Islands over partitions of a few each: a row is small, but takes long."""
    return df.repartition(min(ISLANDS * blocks, max(2 * df.sparkSession.sparkContext.defaultParallelism, ISLANDS * blocks // 16)), "block", "island")


def solve(problems: DataFrame, level: int, blocks: int, capacity: int) -> DataFrame:
    """(block, of) from (block, lengths): the number of each piece's bin, in the best of the islands of each block."""
    islands = F.explode(F.array(*map(F.lit, range(ISLANDS))))
    start = problems.select("block", islands.alias("island"), "lengths", F.array().cast("array<array<int>>").alias("population"))
    state = materialize(_spread(start, blocks).mapInPandas(_epoch(level, 0, capacity), STATE), "islands")
    for epoch in range(1, EPOCHS):
        busy = state.join(state.groupBy("block").agg(F.bool_or("done").alias("solved")), "block").where("NOT solved")
        if busy.isEmpty():
            break
        guests = busy.select("block", ((F.col("island") + 1) % ISLANDS).alias("island"), F.slice("population", 1, 2).alias("guests"))
        met = busy.drop("solved").join(guests, ["block", "island"])
        met = met.withColumn("population", F.array_distinct(F.concat(F.slice("population", 1, POPULATION - 2), "guests"))).drop("guests")
        moved = _spread(met, blocks).mapInPandas(_epoch(level, epoch, capacity), STATE)
        rest = state.join(busy.select("block").distinct(), "block", "left_anti")
        before, state = state, materialize(moved.unionByName(rest.select(*moved.columns)), "islands")
        release(before)
    best = F.max_by(F.get("population", F.lit(0)), F.struct((-F.col("bins")).alias("bins"), "squares", (-F.col("island")).alias("island")))
    return state.groupBy("block").agg(best.alias("of"))


def _laid_out(level: int, capacity: int, last: bool):
    """(row, length, sequence_id, offset, stays) of each piece; those of the emptiest bins go on to the next level."""

    def lay(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.itertuples():
                of, lengths, rows = (np.asarray(x) for x in (r.of, r.lengths, r.rows))
                fill = np.bincount(of, lengths).astype(np.int64)
                stays = np.ones(len(fill), bool)
                if not last:
                    stays[np.argsort(fill, kind="stable")[: max(1, len(fill) // PASSED_ON)]] = False
                order = np.argsort(of, kind="stable")
                before = np.cumsum(lengths[order]) - lengths[order]
                first = np.searchsorted(of[order], np.arange(len(fill)))
                # Level, block and bin as one number; its last bit tells it from the rows that are sequences of their own.
                number = ((level << 57) + (r.block << 20) + of[order].astype(np.int64)) * 2 + 1
                yield pd.DataFrame({"row": rows[order], "length": lengths[order].astype(np.int64), "sequence_id": number, "offset": before - before[first[of[order]]], "stays": stays[of[order]]})

    return lay


def place(short: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(row, sequence_id, offset) of rows (row, length), whose lengths are 1 to capacity; ``row`` is a distinct long."""
    spark, level, placed = short.sparkSession, 0, []
    todo, count = short.select("row", "length"), short.count()
    while count:
        blocks = -(-count // BLOCK)
        dealt = todo.withColumn("block", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(blocks)))
        own = F.sort_array(F.collect_list(F.struct("length", "row")))
        problems = dealt.groupBy("block").agg(own.alias("own"))
        problems = materialize(problems.select("block", F.col("own.row").alias("rows"), F.col("own.length").cast("array<int>").alias("lengths")), "blocks")
        solved = problems.join(solve(problems.select("block", "lengths"), level, blocks, capacity), "block")
        laid = materialize(solved.mapInPandas(_laid_out(level, capacity, blocks == 1), "row long, length long, sequence_id long, offset long, stays boolean"), "laid")
        placed.append(laid.where("stays").select("row", "sequence_id", "offset"))
        todo, level = laid.where("NOT stays").select("row", "length"), level + 1
        count = todo.count()
    if not placed:
        return spark.createDataFrame([], "row long, sequence_id long, offset long")
    out = placed[0]
    for x in placed[1:]:
        out = out.union(x)
    return out


def pack(
    docs: DataFrame, path: str, text: str = "text", keep: Sequence[str] = ("doc_id",), capacity: int = CAPACITY, end: int = 0, with_ids: bool = False
) -> DataFrame:
    """Kept columns, MADE and, if wanted, ids of each piece of each document. Kept columns of these names are not kept."""
    keep = [c for c in keep if c.lower() not in {*MADE, "ids"}]
    row = free_name(docs, "row_")
    cut = pieces(docs, path, text, keep, capacity, end, with_ids).withColumn(row, F.monotonically_increasing_id())
    cut = materialize(cut, "pieces")
    short = materialize(cut.where(F.col("length") < capacity).select(F.col(row).alias("row"), "length"), "short")
    placed = place(short, capacity)
    full = cut.where(F.col("length") == capacity).withColumns({"sequence_id": F.col(row) * 2, "offset": F.lit(0).cast("long")})
    rest = cut.where(F.col("length") < capacity).join(placed.withColumnRenamed("row", row).hint("merge"), row)
    columns = [*keep, *MADE, *(["ids"] if with_ids else [])]
    return full.select(*columns).union(rest.select(*columns))
