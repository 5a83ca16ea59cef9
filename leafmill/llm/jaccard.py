"""Near duplicates: a Jaccard join of word n-gram sets with rare-first prefix filtering.

A text's set holds its distinct runs of ``size`` words, ASCII letters lower-cased; a text with fewer
words is one run, a text without words has the empty set, and links with nothing. Sets link if 100
times their intersection is at least ``percent`` times their union. Runs are held as 64-bit hashes;
pairs that pass by these are compared once more by their words.

Documents with equal sets form a class, for which its smallest id stands from then on. All sets are
sorted by one order, rare runs first: by counters of hash buckets, which cover all documents and
grow in number with them up to a bound, then by hash. Two sets that link share a run in their prefixes. Rows (run,
class) of the prefixes meet in two rounds: first all classes that share a run with the class of the
smallest id among them; then pairs that the components of the links so found still keep apart, of
which one at least is not of the component that most of the run's classes belong to. Pairs pass the
length and the positional filter, those of the second round also a bound on what two sets can share
by the parities of their runs in ``8 * WORDS`` bytes, and are verified once, after a suffix filter that bounds the
intersection by halves. No pair of one component is made twice, so a large group of near copies
costs one pair for each copy.

Null ids belong to no component (null). Rows with one id and different texts link on their own;
classes with the same smallest id count as one. Empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm import hashing
from leafmill.llm.common import join_checked, materialize, release, sized, small_batches
from leafmill.llm.components import components

#: Counters that order the runs are a power of two, from 2^17 up to a bound on what the driver collects and sends to tasks (32 MB),
#: with some 32 documents to each in between.
COUNTER_BITS, DOCS_OF_A_COUNTER = (17, 22), 32
#: A run is hot if its bucket counts so many times the mean, or so many documents: no more rows of one run are in one window.
HOT, MOST_OF_RUN = 20, 100_000
#: Words of 64 bits that hold the parities of a set.
WORDS = 8
ROWS = 256
#: Of a task: classes with their prefixes, prefix rows or pairs of ids, and pairs with texts.
CLASSES, PREFIX_ROWS, TEXT_PAIRS = 4_000, 100_000, 2_000


def text_sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct run hashes) of each text."""
    for start in range(0, len(column), ROWS):
        for i, words in hashing.text_words(column.slice(start, ROWS), hashing.WHITE, True):
            yield start + i, np.unique(hashing.runs(words, size))


def counter_bits(docs: int) -> int:
    least, most = COUNTER_BITS
    return min(most, max(least, (docs // DOCS_OF_A_COUNTER).bit_length()))


def _bucket(runs: np.ndarray, counters: int) -> np.ndarray:
    """The counter of each run: its upper bits, of a power of two counters."""
    return (runs >> np.uint64(65 - counters.bit_length())).astype(np.int64)


def hot_bound(counters: np.ndarray) -> float:
    """What the bucket of a run that isn't hot counts at most."""
    return min(HOT * max(1.0, float(counters.mean())), MOST_OF_RUN)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def run_counters(docs: DataFrame, text: str, size: int) -> np.ndarray:
    """Documents with a run in each bucket of hashes, over all documents."""
    many = 1 << counter_bits(docs.count())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.zeros(many, np.int64)
        for batch in batches:
            held: list[np.ndarray] = []
            for i, runs in text_sets(batch.column(0), size):
                held.append(_bucket(runs, many))
                if len(held) == ROWS or i == batch.num_rows - 1:
                    have += np.bincount(np.concatenate(held), minlength=len(have))
                    held = []
        at = np.flatnonzero(have)
        yield pa.record_batch({"bucket": pa.array(at.astype(np.int32)), "n": pa.array(have[at])})

    got = docs.select(text).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    counters = np.zeros(many, np.int64)
    counters[got["bucket"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return counters


def parities(runs: np.ndarray) -> np.ndarray:
    """For each bit, whether an odd number of runs has it: sets differ in as many runs at least as their bits do."""
    at = (hashing.mix(runs ^ np.uint64(0x14057B7EF767814F)) % np.uint64(64 * WORDS)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=64 * WORDS) & 1).view(np.int64)


def _signatures(docs: DataFrame, key: str, text: str, carry: tuple[str, ...], size: int, percent: int, counters: np.ndarray) -> DataFrame:
    """(doc_id, carried columns, n, k1, k2, bits, prefix): the set's size, two hashes and the parities of the whole set, its prefix.

    A prefix has its runs in rare-first order, and how many of these, the first ones, are not hot.
    """
    shared, bound = docs.sparkSession.sparkContext.broadcast(counters), hot_bound(counters)
    of_prefix = pa.struct([("runs", pa.list_(pa.int64())), ("cold", pa.int32())])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                n, k1, k2, bits, prefixes = [], [], [], [], []
                for _, runs in text_sets(part.column(0), size):
                    n.append(len(runs))
                    k1.append(int(hashing.mix(runs).sum(dtype=np.uint64)))
                    k2.append(int(hashing.mix(runs ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)))
                    bits.append(parities(runs))
                    often = order[_bucket(runs, len(order))]
                    rare = np.argsort(often, kind="stable")[: prefix_length(len(runs), percent)]
                    prefixes.append({"runs": runs[rare].view(np.int64), "cold": int((often[rare] <= bound).sum())})
                signed = lambda v: pa.array(np.array(v, np.uint64).view(np.int64))
                made = [pa.array(n, pa.int32()), signed(k1), signed(k2), pa.array(bits, pa.list_(pa.int64())), pa.array(prefixes, of_prefix)]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *made], [*part.schema.names[1:], "n", "k1", "k2", "bits", "prefix"])

    rows = docs.select(text, F.col(key).cast("long").alias("doc_id"), *carry)
    made = "n int, k1 long, k2 long, bits array<long>, prefix struct<runs: array<long>, cold: int>"
    return rows.mapInArrow(sign, T.StructType([*rows.schema.fields[1:], *T.DataType.fromDDL(made).fields]))


def _met(rows: DataFrame, hot: Column) -> DataFrame:
    """(run, a, n_a, pos_a, b, n_b, pos_b): the classes b of each run that two or more have, beside its least class a.

    One exchange by run serves for the least class and the number of classes. Runs that too many
    documents have are reduced to their least class before they are joined to it.
    """
    one = F.struct("id", "n", "pos")
    few, most = (rows.where(x).drop("cold") for x in (~hot, hot))
    of_run = Window.partitionBy("run")
    few = few.withColumns({"head": F.min(one).over(of_run), "many": F.count("*").over(of_run)})
    heads = most.groupBy("run").agg(F.min(one).alias("head"), F.count("*").alias("many"))
    most = most.join(heads, "run").select(few.columns)
    a = [F.col(f"head.{c}").alias(d) for c, d in (("id", "a"), ("n", "n_a"), ("pos", "pos_a"))]
    b = [F.col(c).alias(d) for c, d in (("id", "b"), ("n", "n_b"), ("pos", "pos_b"))]
    return few.union(most).where("many > 1").select("run", *a, *b)


def _may_link(percent: int) -> Column:
    """Length filter, and whether a run at pos_a and pos_b is in the prefixes that this very pair needs.

    Sets of n_a and n_b runs need an intersection of percent (n_a + n_b) / (100 + percent), o in short;
    the first run they share is then among the first n_a - o + 1 of one, and n_b - o + 1 of the other.
    """
    na, nb = F.col("n_a"), F.col("n_b")
    near = 100 * F.least(na, nb) >= percent * F.greatest(na, nb)
    rest = F.least(na - F.col("pos_a"), nb - F.col("pos_b"))
    return near & ((100 + percent) * rest >= percent * (na + nb))


def _pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b) that pass the positional filter, from one row for each run that the prefixes they need share."""
    by = rows.groupBy("a", "b", "n_a", "n_b").agg(F.count("*").alias("c"), F.max("pos_a").alias("pos_a"), F.max("pos_b").alias("pos_b"))
    rest = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")) - 1
    enough = (100 + percent) * (F.col("c") + rest) >= percent * (F.col("n_a") + F.col("n_b"))
    return by.where(enough).select("a", "b")


def suffix_bound(x: np.ndarray, y: np.ndarray, depth: int = 3) -> int:
    """An upper bound on the intersection of two sorted sets: both are cut at the median of one, again and again."""
    if depth == 0 or min(len(x), len(y)) < 8:
        return min(len(x), len(y))
    m = y[len(y) // 2]
    i, j = int(np.searchsorted(x, m)), len(y) // 2
    same = int(i < len(x) and x[i] == m)
    return suffix_bound(x[:i], y[:j], depth - 1) + same + suffix_bound(x[i + same :], y[j + 1 :], depth - 1)


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if percent * (len(x) + len(y)) > (100 + percent) * suffix_bound(x, y):
        return False
    if len(x) > len(y):
        x, y = y, x
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = int((y[at] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def linked_by_words(a: str, b: str, size: int, percent: int) -> bool:
    """Whether two texts link, by the words themselves."""
    sets = []
    for text in (a, b):
        words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode("utf-8", "surrogatepass").lower())
        n = min(size, len(words))
        sets.append(set(zip(*(words[k : len(words) - n + 1 + k] for k in range(n)), strict=True)))
    both = len(sets[0] & sets[1])
    return 100 * both >= percent * (len(sets[0]) + len(sets[1]) - both)


def _verified(pairs: DataFrame, rows: int, docs: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """The pairs whose sets link, as a table.

    Texts are joined to the pairs, not sets: a text is half the size of its hashes once compressed.
    Only those of the pairs' documents are moved. ``rows`` are the prefix rows that the pairs come from.
    """
    pairs = materialize(sized(pairs, rows, PREFIX_ROWS), "pairs")
    many = pairs.count()
    needed = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    needed = materialize(sized(needed, 2 * many, PREFIX_ROWS), "needed")
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    own = join_checked(own, needed, ["doc_id"], "left_semi")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            hold = [linked(x, y, percent) for (_, x), (_, y) in zip(text_sets(left, size), text_sets(right, size), strict=True)]
            hold = [h and linked_by_words(left[i].as_py(), right[i].as_py(), size, percent) for i, h in enumerate(hold)]
            yield pa.record_batch([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(hold, pa.bool_()))

    with_a = pairs.join(own.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    with_both = with_a.join(own.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    found = sized(with_both.select("a", "b", "text_a", "text_b"), many, TEXT_PAIRS).mapInArrow(verify, "a long, b long")
    found = materialize(found, "links")
    release(pairs, needed)
    return found


def _may_share(percent: int) -> Column:
    """Whether what the parities of two sets leave to be shared is enough."""
    differ = sum((F.bit_count(F.get("bits_x", F.lit(k)).bitwiseXOR(F.get("bits_y", F.lit(k)))) for k in range(WORDS)), F.lit(0))
    both = F.col("x.n") + F.col("y.n")
    return (100 + percent) * (both - differ) >= 2 * percent * both


def _apart(shared: DataFrame, labels: DataFrame, classes: DataFrame, rows: int, percent: int) -> DataFrame:
    """Distinct (a, b) of classes that share a run, are not of one component, and pass the filters.

    Of each run, the component of the most of its classes is not joined with itself: its other
    classes, and only these, meet all classes of the run.
    """
    of = labels.withColumnRenamed("node", "id")
    own = shared.select("run", F.col("b").alias("id"), F.col("n_b").alias("n"), F.col("pos_b").alias("pos"))
    own = own.join(of, "id", "left").withColumn("label", F.coalesce("label", "id"))
    own = materialize(sized(own, rows, PREFIX_ROWS), "labelled")
    each = own.groupBy("run", "label").agg(F.count("*").alias("size"))
    main = each.groupBy("run").agg(F.max_by("label", F.struct("size", "label")).alias("main"), F.count("*").alias("labels"))
    mixed = own.join(main.where("labels > 1").drop("labels"), "run").join(classes.select("id", "bits"), "id")
    mixed = materialize(sized(mixed, rows, PREFIX_ROWS), "apart")
    release(own)
    row = F.struct("n", "id", "pos")
    minor = mixed.where("label <> main").select("run", row.alias("x"), F.col("label").alias("of_x"), F.col("bits").alias("bits_x"))
    every = mixed.select("run", row.alias("y"), F.col("label").alias("of_y"), (F.col("label") != F.col("main")).alias("minor"), F.col("bits").alias("bits_y"))
    met = minor.join(every, "run").where((F.col("of_x") != F.col("of_y")) & (~F.col("minor") | (F.col("x.id") < F.col("y.id"))) & _may_share(percent))
    met = met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    met = met.select(*[F.col(f"{s}.{c}").alias(d) for s, t in (("x", "a"), ("y", "b")) for c, d in (("id", t), ("n", f"n_{t}"), ("pos", f"pos_{t}"))])
    return _pairs(met.where(_may_link(percent)), percent)


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4, percent: int = 85, carry: tuple[str, ...] = ()
) -> DataFrame:
    """(doc_id, carried columns, n_shingles, component_id), one row for each row of docs; the component is its smallest id."""
    small_batches(docs.sparkSession)
    counters = run_counters(docs, text, size)
    signed = materialize(_signatures(docs, key, text, carry, size, percent, counters), "signatures")
    classes = signed.where("n > 0 AND doc_id IS NOT NULL").groupBy("k1", "k2")
    classes = classes.agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.min_by("prefix", "doc_id").alias("prefix"))
    classes = materialize(sized(classes, signed.count(), CLASSES), "classes")

    rows = classes.select("id", "n", F.col("prefix.cold").alias("cold"), F.posexplode("prefix.runs").alias("pos", "run"))
    shared = _met(rows, F.col("pos") >= F.col("cold"))
    shared = materialize(sized(shared, classes.count(), CLASSES), "shared")
    many = shared.count()
    pairs = _pairs(shared.where((F.col("a") != F.col("b")) & _may_link(percent)), percent)
    links = _verified(pairs, many, docs, key, text, size, percent)

    pairs = _apart(shared, components(links), classes, many, percent)
    more = _verified(pairs, many, docs, key, text, size, percent)
    release(shared)

    labels = components(links.union(more))
    of = classes.select("k1", "k2", F.col("id").alias("node")).join(labels, "node", "left")
    of = of.select("k1", "k2", F.coalesce("label", "node").alias("component_id"))
    alone = F.when(F.col("n") == 0, F.col("doc_id"))
    out = signed.drop("prefix", "bits").join(of, ["k1", "k2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(alone, "component_id"))
    out = materialize(out.select("doc_id", *carry, F.col("n").cast("long").alias("n_shingles"), component.alias("component_id")), "components")
    release(signed, classes, links, more)
    return out
