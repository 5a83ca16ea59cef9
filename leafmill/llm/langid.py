"""Language identification by rank-order profiles of character n-grams.

Letters are lower-cased, everything else separates words, and n-grams of one to three characters are
counted, word boundaries included. A language's profile is its most frequent n-grams over all its
training texts, by rank; so is a document's over its whole text. The out-of-place distance sums, over
the document's n-grams, how far each is from its rank in the profile, or the profile's size if it is
not there. The nearest language wins, ties by name; the score is one minus the distance's share of
its greatest value.

Null texts, and texts without a letter, are ``und`` with score 0. With no training rows, all are.
Profiles hold ``size`` n-grams for each language, and are what the driver gets.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIZE = 400
SPACE = 32
#: Characters whose n-grams are counted at once, and distinct n-grams that a task holds before it hands its counts on.
AT_ONCE = 1 << 18
HELD = 500_000

Profiles = dict[str, tuple[np.ndarray, np.ndarray]]


@cache
def _folded() -> np.ndarray:
    """Code point -> lower-cased letter, or a space."""
    table = np.full(0x110000, SPACE, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def fold(text: str) -> np.ndarray:
    """Letters of a text with one space before, between and after words; empty without a letter."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    line = np.concatenate(([SPACE], _folded()[points], [SPACE]))
    keep = np.ones(len(line), bool)
    keep[1:] = (line[1:] != SPACE) | (line[:-1] != SPACE)
    line = line[keep]
    if line[-1] != SPACE:
        line = np.append(line, SPACE)
    return line.astype(np.uint64) if len(line) > 2 else np.empty(0, np.uint64)


def grams(line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams as sorted keys of 21 bits a character, and their counts."""
    shift = np.uint64(21)
    two = (line[:-1] << shift) | line[1:]
    three = (two[:-1] << shift) | line[2:]
    keys = np.concatenate((line[line != SPACE], two, three[line[1:-1] != SPACE]))
    return np.unique(keys, return_counts=True)


def ranked(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent keys, first to last; ties by key."""
    return keys[np.argsort(-counts, kind="stable")[:size]]


def _parts(lines: Iterable[np.ndarray]) -> Iterator[np.ndarray]:
    """The lines, joined to parts of about AT_ONCE characters."""
    part: list[np.ndarray] = []
    size = 0
    for line in lines:
        part.append(line)
        size += len(line)
        if size >= AT_ONCE:
            yield np.concatenate(part)
            part, size = [], 0
    if size:
        yield np.concatenate(part)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    n = 0

    def told() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([c for _, c in parts])).astype(np.int64)
            yield pa.record_batch({"lang": pa.array([lang] * len(keys)), "gram": pa.array(keys.astype(np.int64)), "n": pa.array(counts)})
        held.clear()

    for batch in batches:
        lang, text = batch.column(0).to_numpy(False), batch.column(1)
        for name in sorted(set(lang)):
            for part in _parts(fold(text[int(i)].as_py()) for i in np.flatnonzero(lang == name)):
                held.setdefault(name, []).append(grams(part))
                n += len(held[name][-1][0])
                if n > HELD:
                    yield from told()
                    n = 0
    yield from told()


def learn_profiles(train: DataFrame, text: str = "text", lang: str = "lang", size: int = SIZE) -> Profiles:
    """Profiles from the rows whose text and language are not null."""
    rows = train.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).cast("string"), text)
    counts = rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counts.withColumn("rank", first).where(F.col("rank") <= size).toPandas()
    profiles = {}
    for name, own in sorted(top.groupby("lang")):
        own = own.sort_values("gram")
        profiles[name] = (own["gram"].to_numpy(np.uint64), own["rank"].to_numpy(np.int64) - 1)
    return profiles


def nearest(text: str | None, profiles: Profiles, size: int = SIZE) -> tuple[str, float]:
    line = fold(text) if text else np.empty(0)
    if not len(line) or not profiles:
        return "und", 0.0
    own = ranked(*grams(line), size)
    place = np.arange(len(own))
    best, lang_best = None, "und"
    for lang, (keys, ranks) in profiles.items():
        at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        distance = int(np.where(keys[at] == own, np.minimum(np.abs(ranks[at] - place), size), size).sum())
        if best is None or distance < best:
            best, lang_best = distance, lang
    return lang_best, 1 - best / (size * len(own))


def language(text: Column, profiles: Profiles, size: int = SIZE) -> Column:
    """Struct of ``lang_pred`` and ``score`` for a text column."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([nearest(x, profiles, size) for x in part], columns=["lang_pred", "score"])

    return predict(text)


def identify(df: DataFrame, profiles: Profiles, text: str = "text", size: int = SIZE) -> DataFrame:
    """df with ``lang_pred`` and ``score`` (columns of these names are replaced)."""
    df = df.drop("lang_pred", "score")
    out = df.select("*", language(F.col(text), profiles, size).alias("found__"))
    return out.select(*df.columns, "found__.lang_pred", "found__.score")
