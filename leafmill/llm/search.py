"""Ranked lexical search: the best documents for each item of a query set, exactly.

Terms are the maximal runs of digits, letters A-Z (lower-cased) and non-ASCII characters. A document's
score for an item sums, over the item's distinct terms, the term's weight times its saturated frequency,
in whole numbers (see ``contributions``). Items are taken in blocks of at most ``ITEMS``; the terms of a
block are what tasks know of it. For each block texts are read once and become vectors: how often a
document has each of these terms, and its length, which goes to a table. Counts over all documents give
the weights. Then each task turns its vectors into shards, one after the other, and searches all items
of the block in each, so that its best so far bound what is looked at next. The best of all tasks are
ranked last.

A shard is an inverted index in blocks. Each posting list is clustered on its own: its documents go to
the pivot, drawn from the list, whose sketch (a random projection of the vector) points most nearly in
their direction, longest sketches first, and clusters are cut into blocks of ``BLOCK``. A block's
summary is the coordinatewise maximum of its documents' contributions, for all terms that occur in an
item together with the list's own. An item goes through its lists by their greatest contributions.
Documents not met so far have terms of the remaining lists alone: so the search ends when these
lists' maxima can't reach the last of the best, and a block is passed over only if the sum of its
summary over the item's remaining terms can't. All others are scored in full, once per item.

Equal scores go by id, nulls last. Null and empty texts have no terms and are never found, but items and
documents may repeat: each row is one of its own. Terms are compared by 64-bit hashes of their bytes
(mixed, see hashing). Empty tables, and items without a term that a document has, give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm import hashing
from leafmill.llm.common import materialize, small_batches

#: Items that are searched together.
ITEMS = 2000
#: A shard holds so many documents or postings, whichever is reached first.
DOCUMENTS, POSTINGS = 16_384, 1 << 21
BLOCK = 64
SKETCH = 16
#: Blocks that are scored before the bound is looked at again; doubled each time.
FIRST = 2
VECTOR = "key long, n long, codes array<int>, counts array<int>"


def _words(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for first, data, ends in hashing.slices(column):
        yield first, *hashing.words(data, ends, hashing.NO_WORD, True)


def _vectors(terms: np.ndarray):
    """Turns (key, text) into rows of VECTOR; codes are places in the sorted ``terms``, ascending."""

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, words, ends in _words(batch.column(1)):
                at = np.searchsorted(terms, words)
                at[at == len(terms)] = 0
                hit = terms[at] == words if len(terms) else np.zeros(len(words), bool)
                sizes = np.diff(ends, prepend=0)
                of = np.repeat(np.arange(len(ends)), sizes)[hit]
                cell, counts = np.unique(of * max(1, len(terms)) + at[hit], return_counts=True)
                row, code = np.divmod(cell, max(1, len(terms)))
                offsets = pa.array(np.searchsorted(row, np.arange(len(ends) + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (code, counts)]
                yield pa.record_batch([batch.column(0).slice(first, len(ends)), pa.array(sizes), *lists], ["key", "n", "codes", "counts"])

    return turn


def _document_counts(size: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.zeros(size, np.int64)
        for batch in batches:
            have += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        at = np.flatnonzero(have)
        yield pa.record_batch({"code": pa.array(at), "df": pa.array(have[at])})

    return count


def term_weights(held: np.ndarray, documents: int) -> np.ndarray:
    """1000 ln((2 N + 2) / (2 df + 1)), rounded down."""
    return np.floor(1000 * np.log((2.0 * documents + 2) / (2.0 * held + 1))).astype(np.int64)


def contributions(weights: np.ndarray, counts: np.ndarray, lengths: np.ndarray, documents: int, words: int) -> np.ndarray:
    """weight x (10^9 tf div (1000 tf + 8 m)), with m = 10 + (90 n N) div L of the document's length n."""
    m = 10 + (90 * lengths * documents) // words
    return weights * ((1_000_000_000 * counts) // (1000 * counts + 8 * m))


class Best:
    """The best so far of one item: scores, ids (0 for null) and which ids are null."""

    def __init__(self, most: int):
        self.most, self.scores, self.ids, self.null = most, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    @property
    def least(self) -> int:
        """What a score must reach to count."""
        return int(self.scores[-1]) if len(self.scores) == self.most else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        use = scores >= self.least
        s, i, n = (np.concatenate((a, b[use])) for a, b in ((self.scores, scores), (self.ids, ids), (self.null, null)))
        order = np.lexsort((i, n, -s))[: self.most]
        self.scores, self.ids, self.null = s[order], i[order], n[order]


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class Shard:
    """An inverted index over some documents' contributions; lists are blocked when a search first needs them."""

    def __init__(self, ids: np.ndarray, null: np.ndarray, edges: np.ndarray, codes: np.ndarray, values: np.ndarray, beside: list[np.ndarray]):
        """Document i has the codes and values from edges[i] to edges[i + 1]; beside[t] are the codes that items have together with t."""
        self.ids, self.null, self.edges, self.codes, self.values, self.beside = ids, null, edges, codes, values, beside
        of = np.repeat(np.arange(len(ids)), np.diff(edges))
        order = np.argsort(codes, kind="stable")
        self.documents = of[order]
        self.lists = np.searchsorted(codes[order], np.arange(len(beside) + 1))
        self.greatest = np.zeros(len(beside), np.int64)
        some = np.flatnonzero(np.diff(self.lists))
        if len(some):
            self.greatest[some] = np.maximum.reduceat(values[order], self.lists[some])
        signs = np.random.default_rng(0).choice([-1.0, 1.0], (SKETCH, len(beside)))
        self.sketches = np.stack([np.bincount(of, values * s[codes], len(ids)) for s in signs], 1)
        self.column = np.full(len(beside), -1)
        self.blocked: dict[int, tuple] = {}
        self.scored = 0

    def blocks(self, term: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The list's documents in the order of its blocks, where blocks begin and end, and the summaries by ``beside``."""
        if term not in self.blocked:
            own = self.documents[self.lists[term] : self.lists[term + 1]]
            cluster = np.zeros(len(own), np.int64)
            sketch = self.sketches[own]
            size = np.sqrt((sketch**2).sum(1))
            if len(own) > BLOCK:
                pivots = sketch[:: -(-len(own) // -(-len(own) // BLOCK))]
                pivots = pivots / np.maximum(np.sqrt((pivots**2).sum(1, keepdims=True)), 1e-9)
                cluster = np.argmax(sketch @ pivots.T, 1)
            order = np.lexsort((-size, cluster))
            own, cluster = own[order], cluster[order]
            begins = np.flatnonzero(np.append(True, cluster[1:] != cluster[:-1]))
            place = np.arange(len(own)) - np.repeat(begins, np.diff(np.append(begins, len(own))))
            starts = np.flatnonzero(place % BLOCK == 0)
            block = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(own))))
            near = self.beside[term]
            self.column[near] = np.arange(len(near))
            sizes = self.edges[own + 1] - self.edges[own]
            at = ranges(self.edges[own], sizes)
            column = self.column[self.codes[at]]
            use = column >= 0
            summary = np.zeros(len(starts) * len(near), np.int64)
            np.maximum.at(summary, (np.repeat(block, sizes) * len(near) + column)[use], self.values[at][use])
            self.column[near] = -1
            self.blocked[term] = own, np.append(starts, len(own)), summary.reshape(len(starts), len(near))
        return self.blocked[term]

    def scores(self, documents: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Full scores; ``wanted`` tells for each code whether the item has it."""
        sizes = self.edges[documents + 1] - self.edges[documents]
        at = ranges(self.edges[documents], sizes)
        use = wanted[self.codes[at]]
        self.scored += len(documents)
        return np.bincount(np.repeat(np.arange(len(documents)), sizes)[use], self.values[at][use], len(documents)).astype(np.int64)

    def search(self, item: np.ndarray, best: Best) -> None:
        """Adds to ``best`` what this shard has for the item's terms."""
        terms = item[self.greatest[item] > 0]
        terms = terms[np.argsort(-self.greatest[terms], kind="stable")]
        after = np.cumsum(self.greatest[terms][::-1])[::-1]
        wanted, met = np.zeros(len(self.beside), bool), np.zeros(len(self.ids), bool)
        wanted[item] = True
        for i, term in enumerate(terms.tolist()):
            if after[i] < best.least:
                break
            own, cuts, summary = self.blocks(term)
            bounds = summary[:, np.searchsorted(self.beside[term], terms[i:])].sum(1)
            left = np.flatnonzero(bounds >= best.least)
            left, many = left[np.argsort(-bounds[left], kind="stable")], FIRST
            while len(left):
                now, left, many = left[:many], left[many:], many * 2
                new = own[ranges(cuts[now], cuts[now + 1] - cuts[now])]
                new = new[~met[new]]
                if len(new):
                    met[new] = True
                    best.add(self.scores(new, wanted), self.ids[new], self.null[new])
                left = left[bounds[left] >= best.least]


def _shards(batches: Iterator[pa.RecordBatch], weights: np.ndarray, documents: int, words: int, beside: list[np.ndarray]) -> Iterator[Shard]:
    """Shards of the vectors of a task; of each document the terms that add to a score."""
    held: list[tuple[np.ndarray, ...]] = []
    size = rows = 0

    def built() -> Shard:
        ids, null, lengths, sizes, codes, counts = (np.concatenate(x) for x in zip(*held, strict=True))
        of = np.repeat(np.arange(len(ids)), sizes)
        values = contributions(weights[codes], counts, lengths[of], documents, words)
        use = values > 0
        edges = np.concatenate(([0], np.cumsum(np.bincount(of[use], minlength=len(ids)))))
        return Shard(ids, null, edges, codes[use], values[use], beside)

    for batch in batches:
        key, n, codes, counts = batch.columns
        null = np.array(key.is_null())
        offsets = codes.offsets.to_numpy()
        held.append((key.fill_null(0).to_numpy(), null, n.to_numpy(), np.diff(offsets), codes.flatten().to_numpy().astype(np.int64), counts.flatten().to_numpy().astype(np.int64)))
        size, rows = size + len(held[-1][4]), rows + len(null)
        if rows >= DOCUMENTS or size >= POSTINGS:
            yield built()
            held, size, rows = [], 0, 0
    if held:
        yield built()


def _search(items: list[np.ndarray], weights: np.ndarray, documents: int, words: int, most: int):
    beside: list = [[] for _ in weights]
    for item in items:
        for term in item.tolist():
            beside[term].append(item)
    beside = [np.unique(np.concatenate(x)) if x else np.empty(0, np.int64) for x in beside]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(most) for _ in items]
        for shard in _shards(batches, weights, documents, words, beside):
            for item, own in zip(items, best, strict=True):
                shard.search(item, own)
        for i, own in enumerate(best):
            if len(own.scores):
                ids = pa.array(own.ids, mask=own.null)
                yield pa.record_batch({"number": pa.array(np.full(len(ids), i, np.int32)), "key": ids, "score": pa.array(own.scores)})

    return find


def _search_block(docs: DataFrame, key: str, text: str, items: list[tuple], item_key: str, kind, most: int) -> DataFrame:
    """The result for items of (key, text), which are few enough to be held by all tasks."""
    found: list[np.ndarray] = []
    for _, words, ends in _words(pa.array([x[1] for x in items], pa.large_string())):
        found += [np.unique(x) for x in np.split(words, ends[:-1])]
    terms = np.unique(np.concatenate(found or [np.empty(0, np.uint64)]))
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    vectors = materialize(rows.mapInArrow(_vectors(terms), VECTOR), "vectors")
    n, total = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = np.zeros(len(terms), np.int64)
    counts = vectors.select("codes").mapInArrow(_document_counts(len(terms)), "code long, df long")
    for r in counts.groupBy("code").agg(F.sum("df").alias("df")).collect():  # a row for each term of the items
        held[r["code"]] = r["df"]
    codes = [np.searchsorted(terms, x) for x in found]
    best = vectors.where(F.size("codes") > 0).mapInArrow(_search(codes, term_weights(held, n), n, max(1, total), most), "number int, key long, score long")
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.col("key").asc_nulls_last())
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    names = spark.createDataFrame([(i, x[0]) for i, x in enumerate(items)], f"number int, `{item_key}` {kind}")
    return best.join(F.broadcast(names), "number").select(item_key, "rank", F.col("key").alias(key), "score")


def search(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", most: int = 10
) -> DataFrame:
    """(item_key, rank, key, score) of the ``most`` best documents with a score above 0 of each row of items. Ids are whole numbers."""
    items = items.select(item_key, F.col(item_text).cast("string"))
    kind = items.schema[0].dataType.simpleString()
    count = items.count()
    if count <= ITEMS:
        parts = [items]
    else:  # each row keeps its part, so the parts are a table
        blocks = -(-count // (ITEMS // 2))
        dealt = materialize(items.toDF("k", "t").withColumn("part", F.floor(F.rand(0) * blocks)), "items")
        parts = [dealt.where(F.col("part") == b).select("k", "t") for b in range(blocks)]
    out = None
    for part in parts:
        found = _search_block(docs, key, text, [tuple(r) for r in part.collect()], item_key, kind, most)
        out = found if out is None else out.union(found)
    return out
