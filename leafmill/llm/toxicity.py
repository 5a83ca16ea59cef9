"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Examples are a bounded, seeded sample of the labelled rows, ``per_class`` of each label. Terms are the
lower-cased words (letters and non-ASCII characters) of at least ``min_df`` examples that go with a
label, by a likelihood ratio of ``min_ratio``; all other words of a text together are one more term,
of weight ``rest``, so that a long text with one telling word lies nearer to clean ones. Document
frequencies are counted over all documents. The index keeps, for each term, its postings in blocks of
examples, and the greatest weight in each block. A query bounds its cosine with every block by these,
scores the most promising blocks, and then all others whose bound reaches the k-th best so far; so
the k nearest are exact. Votes are weighted by squared cosine and by the inverse size of the class;
an isotonic curve turns them into probabilities of label 1 at the classes' true frequency. It is
fitted to votes of the examples of each of ``FOLDS`` parts by an index of the other parts, whose terms
these others chose, so no example's label has a say in its own vote.

Null and empty texts, and texts without a word, get the frequency of label 1; so do all without
examples of both labels (0 without any). Labels other than 0 and 1 and null ids are not learned from.
The model (``per_class`` x 2 examples and their terms) is what the driver holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm import hashing

PER_CLASS = 2000
MIN_DF = 5
MIN_RATIO = 20.0
REST = 0.3
NEAREST = 75
BLOCK = 64
EVIDENCE = 5
FOLDS = 5


def _terms(column: pa.Array, rows: int = 256) -> Iterator[tuple[int, np.ndarray]]:
    """(row, hashes of the lower-cased words) of each text, so many texts at a time."""
    for start in range(0, len(column), rows):
        lowered = pa.array([(x or "").lower() for x in column.slice(start, rows).to_pylist()], pa.large_string())
        for i, words in hashing.text_words(lowered, hashing.NO_LETTER, False):
            yield start + i, words


@dataclass
class Model:
    """Terms (sorted hashes) with their weights, the block-max index, and the calibration."""

    terms: np.ndarray
    idf: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    starts: np.ndarray  # term x (block + 1) -> posting
    examples: np.ndarray
    weights: np.ndarray
    greatest: np.ndarray  # term x block
    vote: np.ndarray
    curve: tuple[np.ndarray, np.ndarray] | None
    prior: float
    nearest: int
    rest: float

    def query(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Terms of a text, the rest as the last of them, and their normalised weights."""
        if not len(words):
            return np.empty(0, np.int64), np.empty(0)
        known, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        if len(self.terms):
            at = np.searchsorted(self.terms, words)
            at[at == len(self.terms)] = 0
            known, counts = np.unique(at[self.terms[at] == words], return_counts=True)
        weights = (1 + np.log(counts)) * self.idf[known]
        if others := len(words) - int(counts.sum()):
            known, weights = np.append(known, len(self.terms)), np.append(weights, (1 + np.log(others)) * self.rest)
        norm = np.sqrt((weights**2).sum())
        return (known, weights / norm) if norm > 0 else (known[:0], weights[:0])

    def _score(self, terms: np.ndarray, weights: np.ndarray, blocks: np.ndarray, out: np.ndarray) -> None:
        """Adds the exact cosines of the examples in the blocks."""
        start = self.starts[terms][:, blocks].ravel()
        size = self.starts[terms][:, blocks + 1].ravel() - start
        before = np.cumsum(size) - size
        at = np.repeat(start - before, size) + np.arange(size.sum())
        by = np.repeat(np.repeat(weights, len(blocks)), size)
        out += np.bincount(self.examples[at], by * self.weights[at], len(out))

    def neighbours(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest examples with a positive cosine, best first (ties by place), and their cosines."""
        terms, weights = self.query(words)
        if not len(terms):
            return np.empty(0, np.int64), np.empty(0)
        bounds = weights @ self.greatest[terms]
        order = np.argsort(-bounds, kind="stable")
        first, rest = np.split(order, [-(-self.nearest // BLOCK) + 2])
        cosines = np.zeros(len(self.labels))
        self._score(terms, weights, first, cosines)
        least = np.partition(cosines, -self.nearest)[-self.nearest] if len(cosines) > self.nearest else 0.0
        rest = rest[bounds[rest] >= least - 1e-9]
        if len(rest):
            self._score(terms, weights, rest, cosines)
        best = np.argpartition(-cosines, self.nearest - 1)[: self.nearest] if len(cosines) > self.nearest else np.arange(len(cosines))
        if len(cosines) > self.nearest:  # ties with the last by place
            last = cosines[best].min()
            above, equal = np.flatnonzero(cosines > last), np.flatnonzero(cosines == last)
            best = np.concatenate((above, equal[: self.nearest - len(above)]))
        best = best[cosines[best] > 0]
        best = best[np.lexsort((best, -cosines[best]))]
        return best, cosines[best]

    def share(self, best: np.ndarray, cosines: np.ndarray) -> float | None:
        """Label 1's share of the votes; None without votes."""
        votes = cosines**2 * self.vote[self.labels[best]]
        return float(votes[self.labels[best] == 1].sum() / votes.sum()) if len(best) else None

    def score(self, share: float | None) -> float:
        """A thousandth of the score is the share itself, to tell shares on a level part of the curve apart."""
        if share is None or self.curve is None:
            return self.prior
        return float(0.999 * np.interp(share, *self.curve) + 0.001 * share)


def _isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing curve nearest to y: neighbours out of order are pooled. Corner points of its steps."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # weight, weighted sum, first x, last x
    for xi, yi, wi in zip(x[order].tolist(), y[order].tolist(), w[order].tolist(), strict=True):
        pools.append([wi, wi * yi, xi, xi])
        while len(pools) > 1 and (pools[-2][3] == pools[-1][2] or pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]):
            last = pools.pop()
            pools[-1] = [pools[-1][0] + last[0], pools[-1][1] + last[1], pools[-1][2], last[3]]
    places = np.array([v for p in pools for v in p[2:]])
    values = np.array([p[1] / p[0] for p in pools for _ in range(2)])
    return places, values


def telling(words: list[np.ndarray], labels: np.ndarray, min_df: int, min_ratio: float) -> np.ndarray:
    """Sorted terms that go with a label: those of enough examples whose log-likelihood ratio is large."""
    empty = np.empty(0, np.uint64)
    every, at = np.unique(np.concatenate([np.unique(w) for w in words] or [empty]), return_inverse=True)
    of = np.repeat(labels, [len(np.unique(w)) for w in words]) if words else np.empty(0, np.int64)
    held = np.bincount(labels, minlength=2)
    if not len(every) or held.min() == 0:
        return empty
    seen = np.stack([np.bincount(at[of == k], minlength=len(every)) for k in (0, 1)])
    expected = seen.sum(0) * (held / held.sum())[:, None]
    ratio = 2 * np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / expected), 0).sum(0)
    return every[(seen.sum(0) >= min_df) & (ratio >= min_ratio)]


def _example_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [w for _, w in _terms(batch.column(2))]
        yield pa.record_batch({"doc_id": batch.column(0), "label": batch.column(1), "words": pa.array([w.view(np.int64) for w in found], pa.list_(pa.int64()))})


def _document_counts(terms: np.ndarray):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.zeros(len(terms) + 1, np.int64)
        for batch in batches:
            for _, words in _terms(batch.column(0)):
                have[-1] += 1
                if len(words) and len(terms):
                    at = np.searchsorted(terms, words)
                    at[at == len(terms)] = 0
                    have[np.unique(at[terms[at] == words])] += 1
        at = np.flatnonzero(have)
        yield pa.record_batch({"term": pa.array(at), "n": pa.array(have[at])})

    return count


def fit(
    labelled: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
    per_class: int = PER_CLASS, min_df: int = MIN_DF, min_ratio: float = MIN_RATIO, rest: float = REST, nearest: int = NEAREST, seed: int = 0,
) -> Model:
    """A model from (key, label) rows, whose texts are in docs."""
    labelled = labelled.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("doc_id"), F.col(label).cast("int").alias("label")).distinct()
    sizes = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    lot = F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")))
    zero, one = (labelled.where(F.col("label") == k).orderBy(lot, "doc_id").limit(per_class) for k in (0, 1))
    drawn = zero.union(one)
    texts = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(drawn), "doc_id").select("doc_id", "label", "text")
    rows = texts.mapInArrow(_example_terms, "doc_id long, label int, words array<long>").toPandas()
    rows = rows.sort_values(["label", "doc_id"], kind="stable")
    words = [np.asarray(x, np.int64).view(np.uint64) for x in rows["words"]]
    labels, ids = rows["label"].to_numpy(np.int64), rows["doc_id"].to_numpy(np.int64)
    part = (hashing.mix(ids.view(np.uint64)) % np.uint64(FOLDS)).astype(np.int64)
    chosen = [telling([w for w, p in zip(words, part, strict=True) if p != k], labels[part != k], min_df, min_ratio) for k in range(FOLDS + 1)]
    terms = np.unique(np.concatenate(chosen))

    got = docs.select(text).mapInArrow(_document_counts(terms), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    have = np.zeros(len(terms) + 1)
    have[got["term"].to_numpy()] = got["n"].to_numpy()
    idf = np.log((1 + have[-1]) / (1 + have[:-1]))

    prior = sizes.get(1, 0) / max(1, sum(sizes.values()))

    def indexed(k: int) -> Model:
        """Of the examples outside part k."""
        use = np.flatnonzero(part != k)
        made = Model(chosen[k], idf[np.searchsorted(terms, chosen[k])], ids[use], labels[use], *(np.empty(0),) * 4, np.ones(2), None, prior, nearest, rest)
        _index(made, [words[i] for i in use])
        held = np.bincount(made.labels, minlength=2)
        if held.min() > 0:
            made.vote = 1 / held
        return made

    model = indexed(FOLDS)
    held = np.bincount(labels, minlength=2)
    if held.min() > 0:
        votes = [(i, m.share(*m.neighbours(words[i]))) for k in range(FOLDS) for m in [indexed(k)] for i in np.flatnonzero(part == k).tolist()]
        own = np.array([i for i, share in votes if share is not None], np.int64)
        if len(own):
            weight = np.array([sizes[k] / held[k] for k in (0, 1)])[labels[own]]
            model.curve = _isotonic(np.array([share for _, share in votes if share is not None]), labels[own], weight)
    return model


def _index(model: Model, words: list[np.ndarray]) -> None:
    """Fills the index. Examples are placed by label and weightiest term, so that blocks are alike."""
    vectors = [model.query(w) for w in words]
    top = np.array([t[np.argmax(w)] if len(t) else -1 for t, w in vectors], np.int64)
    order = np.lexsort((top, model.labels))
    model.ids, model.labels = model.ids[order], model.labels[order]
    vectors = [vectors[i] for i in order]
    term = np.concatenate([t for t, _ in vectors] or [np.empty(0, np.int64)]).astype(np.int64)
    example = np.repeat(np.arange(len(vectors)), [len(t) for t, _ in vectors])
    weight = np.concatenate([w for _, w in vectors] or [np.empty(0)])
    order = np.lexsort((example, term))
    term, example, weight = term[order], example[order], weight[order]
    blocks = max(1, -(-len(vectors) // BLOCK))
    cell = term * blocks + example // BLOCK
    terms = len(model.terms) + 1
    edges = np.searchsorted(cell, np.arange(terms * blocks + 1))
    grid = edges[:-1].reshape(terms, blocks)
    model.starts = np.concatenate((grid, np.append(grid[1:, 0], edges[-1])[: len(grid), None]), axis=1)
    model.greatest = np.zeros((terms, blocks))
    np.maximum.at(model.greatest.ravel(), cell, weight)
    model.examples, model.weights = example, weight


def toxicity(text: Column, model: Model) -> Column:
    """Struct of ``score``, ``predicted`` and the nearest examples' ids and cosines."""

    @F.pandas_udf("score double, predicted int, evidence array<long>, cosines array<double>")
    def judge(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for _, words in _terms(pa.array(part, pa.large_string(), from_pandas=True)):
                best, cosines = model.neighbours(words)
                score = model.score(model.share(best, cosines))
                rows.append((score, int(score >= 0.5), model.ids[best[:EVIDENCE]], np.minimum(cosines[:EVIDENCE], 1.0)))
            yield pd.DataFrame(rows, columns=["score", "predicted", "evidence", "cosines"])

    return judge(text)


def score_toxicity(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with ``score``, ``predicted``, ``evidence`` and ``cosines`` (columns of these names are replaced)."""
    df = df.drop("score", "predicted", "evidence", "cosines")
    return df.select("*", toxicity(F.col(text), model).alias("judged__")).select(*df.columns, "judged__.*")
