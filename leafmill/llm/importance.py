"""Target-distribution importance resampling of documents by hashed word features.

Words are the maximal runs of digits, lower-cased A-Z and non-ASCII characters; features are all words
and all pairs of successive words joined by one space, repeats counted. A feature falls into the bucket
that the checksum (CRC-32) of its bytes names. A bucket's gain is the logarithm of how much likelier a
target text is to show it than a document, both smoothed by one; a document's weight is the mean gain of
its features. The weight plus Gumbel noise that its id alone decides is its score, and the highest scores
among documents of enough words are drawn: a sample without replacement, likelier by weight.

Checksums of all features of a slice of texts are taken at once. A checksum is linear: that of a span
is the XOR of what each byte, at its distance from the span's end, contributes, and of a constant for
the span's length. Contributions come from a table of byte by distance and are put together by
``bitwise_xor.reduceat`` over the spans. Spans longer than the table fold in blocks of its depth: the
register so far moves on by a block, which takes four entries of the same table, and the block joins.

Null and empty texts have no features and weight 0. All rows count, repeated ones too. Rows without
an id share the noise of the empty id and come last among equal scores, rows that equal in score and
id in any order. Without target texts the target is uniform over the buckets; empty tables give empty
results. Columns of the input that are not carried are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm import hashing
from leafmill.llm.common import free_name, materialize, small_batches
from leafmill.llm.ranks import with_rank

BUCKETS = 10_000
#: Documents with fewer words are never drawn.
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
#: Longest span whose bytes are looked up at once; longer ones fold in blocks of this size.
DEPTH = 64
#: Bytes of texts whose features are held at once (a longer text is alone); their spans have some three times as many.
SLICE = 1 << 19
MADE = ("n_words", "n_features", "weight", "score", "rank")
SPACE = 32


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """What a byte contributes at each distance from a span's end (distance x byte), and the checksum of each number of zero bytes."""
    zeros = [zlib.crc32(bytes(n)) for n in range(DEPTH + 1)]
    table = [[zlib.crc32(bytes([b]) + bytes(d)) ^ zeros[d + 1] for b in range(256)] for d in range(DEPTH)]
    return np.array(table, np.uint32), np.array(zeros, np.uint32)


def _linear(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """XOR of the contributions of the bytes of each span; sizes are 1 to DEPTH."""
    if not len(starts):
        return np.empty(0, np.uint32)
    ends = np.cumsum(sizes)
    at = np.arange(ends[-1], dtype=np.int64)
    distance = np.repeat(ends - 1, sizes) - at
    own = data[at + np.repeat(starts - ends + sizes, sizes)]
    return np.bitwise_xor.reduceat(_tables()[0].ravel()[distance * 256 + own], ends - sizes)


def _moved(register: int) -> int:
    """A register after DEPTH more zero bytes: its own bytes stand as far from the new end as these say."""
    table = _tables()[0]
    return int(table[DEPTH - 1, register & 255] ^ table[DEPTH - 2, register >> 8 & 255] ^ table[DEPTH - 3, register >> 16 & 255] ^ table[DEPTH - 4, register >> 24])


def checksums(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """CRC-32 of data[start:stop] for each span; no span is empty."""
    sizes = stops - starts
    out = np.empty(len(starts), np.uint32)
    short = sizes <= DEPTH
    out[short] = _linear(data, starts[short], sizes[short]) ^ _tables()[1][sizes[short]]
    for i in np.flatnonzero(~short).tolist():
        first = int(sizes[i] - 1) % DEPTH + 1  # the first block is the one that may be shorter
        cuts = np.concatenate(([starts[i]], np.arange(starts[i] + first, stops[i], DEPTH)))
        register = 0
        for block in _linear(data, cuts, np.diff(np.append(cuts, stops[i]))).tolist():
            register = _moved(register) ^ block
        out[i] = register ^ zlib.crc32(bytes(int(sizes[i])))
    return out


def buckets(data: np.ndarray, ends: np.ndarray, size: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the words of texts that end at ``ends``, of each word with the next one, and where each text's words end.

    A pair that crosses from one text to the next is marked by -1.
    """
    inside = ~hashing.NO_WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    borders = ends[:-1][ends[:-1] < len(data)]
    first[borders] = inside[borders]
    last[:-1] &= ~inside[1:] | first[1:]
    starts = np.flatnonzero(first)
    sizes = np.flatnonzero(last) + 1 - starts
    text_ends = np.searchsorted(starts, ends, "left")
    if not len(starts):
        none = np.empty(0, np.int64)
        return none, none, text_ends
    # The words once more, lower-cased, one space between each and the next.
    begin = np.cumsum(sizes + 1) - sizes - 1
    joined = np.full(int(begin[-1] + sizes[-1]), SPACE, np.uint8)
    letters = data[inside]
    letters[(letters >= 65) & (letters <= 90)] += 32
    joined[np.arange(len(letters)) + np.repeat(np.arange(len(sizes)), sizes)] = letters
    stop = begin + sizes
    one = checksums(joined, begin, stop).astype(np.int64) % size
    two = checksums(joined, begin[:-1], stop[1:]).astype(np.int64) % size
    crossing = text_ends[:-1]
    two[crossing[(crossing > 0) & (crossing < len(starts))] - 1] = -1
    return one, two, text_ends


def _count(size: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.zeros(size, np.int64)
        for batch in batches:
            for _, data, ends in hashing.slices(batch.column(0), SLICE):
                one, two, _ = buckets(data, ends, size)
                have += np.bincount(one, minlength=size) + np.bincount(two[two >= 0], minlength=size)
        at = np.flatnonzero(have)
        yield pa.record_batch({"bucket": pa.array(at), "n": pa.array(have[at])})

    return count


def bucket_counts(df: DataFrame, text: str = "text", size: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket. Each task sends one row for each bucket at most."""
    small_batches(df.sparkSession)
    rows = df.select(F.col(text).cast("string")).mapInArrow(_count(size), "bucket long, n long")
    out = np.zeros(size, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of (smoothed share in the target / smoothed share in the raw texts), rounded down."""
    size = len(raw)
    share = ((target + 1.0) * (float(raw.sum()) + size)) / ((raw + 1.0) * (float(target.sum()) + size))
    return np.floor(1000 * np.log(share)).astype(np.int64)


def _weigh(gain: np.ndarray):
    size = len(gain)

    def sums(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(values)))
        start = np.minimum(start, len(values))  # of texts without words, which may stand last
        return total[np.maximum(stop, start)] - total[start]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, weights = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for row, data, ends in hashing.slices(batch.column(0), SLICE):
                one, two, stop = buckets(data, ends, size)
                start = np.concatenate(([0], stop[:-1]))
                own = sums(gain[one], start, stop) + sums(np.where(two >= 0, gain[two], 0), start, stop - 1)
                n = stop - start
                words[row : row + len(ends)] = n
                weights[row : row + len(ends)] = own // np.maximum(2 * n - 1, 1)
            made = {"n_words": pa.array(words), "n_features": pa.array(np.maximum(2 * words - 1, 0)), "weight": pa.array(weights)}
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *made.values()], [*batch.schema.names[1:], *made])

    return weigh


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down, that the seed and the id alone decide."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def _scored(docs: DataFrame, gain: np.ndarray, key: str, text: str, kept: Sequence[str], seed: int) -> DataFrame:
    """Kept columns, n_words, n_features, weight and score of each document."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(text).cast("string").alias("text_"), *kept)
    fields = [*rows.schema.fields[1:], *(T.StructField(c, T.LongType()) for c in MADE[:3])]
    return rows.mapInArrow(_weigh(gain), T.StructType(fields)).withColumn("score", F.col("weight") + noise(F.col(key), seed))


def _ranked(df: DataFrame, key: str) -> DataFrame:
    """df with ``rank`` from 0 by score, greatest first, then by key.

    Scores are whole and bounded by the logarithms of the counts, so they have few values: each is a bucket of the order.
    """
    every = free_name(df, "all_")
    return with_rank(df.withColumn(every, F.lit(0)), "rank", [every], -F.col("score"), [F.col(key).asc_nulls_last()]).drop(every)


def importance(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", carry: Sequence[str] = (),
    size: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED,
) -> DataFrame:
    """(key, carried columns, MADE) of every document; ``rank`` counts the drawn from 1 by score, others have none.

    Of N documents with ``least_words`` words or more, ``percent`` of a hundred are drawn, rounded down.
    Carried columns that have a name of MADE are replaced. Texts are read twice, not written.
    """
    gain = gains(bucket_counts(docs, text, size), bucket_counts(target, target_text, size))
    kept = [key, *(c for c in dict.fromkeys(carry) if c != key and c.lower() not in MADE)]
    weighed = materialize(_scored(docs, gain, key, text, kept, seed), "weights")
    able = F.col("n_words") >= least_words
    drawn = weighed.where(able).count() * percent // 100
    placed = _ranked(weighed.where(able), key).withColumn("rank", F.when(F.col("rank") < drawn, F.col("rank") + 1))
    short = weighed.where(~able).withColumn("rank", F.lit(None).cast("long"))
    return placed.select(*kept, *MADE).union(short.select(*kept, *MADE))


def resample(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
    size: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED,
) -> DataFrame:
    """The drawn documents, all their columns as they are, in no order.

    Counts of the scores tell the last score that is drawn. Rows above it stay where they are; only
    those that have just this score are ranked, so whole texts are hardly shuffled.
    """
    gain = gains(bucket_counts(docs, text, size), bucket_counts(target, target_text, size))
    names = {c: f"c{i}_" for i, c in enumerate(docs.columns)}
    own = docs.toDF(*names.values())
    scored = _scored(own, gain, names[key], names[text], list(names.values()), seed).where(F.col("n_words") >= least_words)
    counts = sorted(((r["score"], r["count"]) for r in scored.groupBy("score").count().collect()), reverse=True)
    left, last = sum(n for _, n in counts) * percent // 100, None
    for last, n in counts:
        if left <= n:
            break
        left -= n
    above = scored.where(F.col("score") > F.lit(last).cast("long"))
    level = _ranked(scored.where(F.col("score") == F.lit(last).cast("long")), names[key]).where(F.col("rank") < left)
    return above.select(*names.values()).union(level.select(*names.values())).toDF(*docs.columns)
