import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from leafmill.llm import hashing, suffixes


def brute(texts, length=200):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, np.int64)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        runs = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
        kept = bytes(np.frombuffer(d, np.uint8)[~gone])
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def got(df, **more):
    return sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.remove_repeats(df, **more).collect())


def test_ranks_and_prefixes():
    rng = np.random.default_rng(2)
    for letters, pieces in ((2, 5), (4, 40), (250, 3), (1, 4)):
        sizes = rng.integers(12, 60, pieces)
        data = rng.integers(0, letters, sizes.sum()).astype(np.uint8)
        data[30 : 30 + min(25, len(data) - 30)] = data[: min(25, len(data) - 30)]
        starts = np.cumsum(sizes) - sizes
        order, same = suffixes.sorted_strings(data, starts, sizes, 12)
        strings = [bytes(data[i : i + 12]) for i in order.tolist()]
        assert strings == sorted(strings) and len(strings) == int((sizes - 11).sum())
        assert same.tolist() == [i > 0 and s == strings[i - 1] for i, s in enumerate(strings)]


def test_shards_are_merged():
    rng = np.random.default_rng(3)
    shards = []
    for _ in range(5):
        sizes = rng.integers(8, 40, 60)
        shards.append((rng.integers(0, 3, sizes.sum()).astype(np.uint8), np.cumsum(sizes) - sizes, sizes))
    seen = Counter(bytes(d[i : i + 8]) for d, s, z in shards for a, n in zip(s, z, strict=True) for i in range(a, a + n - 7))
    for (d, s, z), flags in zip(shards, suffixes.repeated(shards, 8), strict=True):
        want = np.zeros(len(d), bool)
        for a, n in zip(s, z, strict=True):
            for i in range(a, a + n - 7):
                want[i] = seen[bytes(d[i : i + 8])] > 1
        assert np.array_equal(flags, want)


def test_each_string_has_one_anchor():
    rng = random.Random(5)
    texts = ["".join(rng.choices("ab", k=n)) for n in (0, 10, 199, 200, 201, 900)] + ["a" * 700]
    for _, data, ends in hashing.slices(pa.array(texts)):
        text, key, first, last = suffixes.anchors(data, ends, 200)
        places = sorted((t, i) for t, a, b in zip(text.tolist(), first.tolist(), last.tolist(), strict=True) for i in range(a, b + 1))
        assert places == [(t, i) for t, x in enumerate(texts) for i in range(len(x) - 199)]
        of = {}
        for t, k, a, b in zip(text.tolist(), key.tolist(), first.tolist(), last.tolist(), strict=True):
            for i in range(a, b + 1):
                assert of.setdefault(texts[t][i : i + 200], k) == k


def test_documents_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert got(docs) == sorted(brute([r["text"] for r in docs.select("text").collect()]))


def test_passages_by_brute_force(spark, monkeypatch):
    """Passages at all offsets, runs of one letter, periodic texts, overlaps, near misses; large anchors in small shards."""
    rng = random.Random(6)
    prose = lambda n: "".join(rng.choices("abcdefghijklmnop éü\n", k=n))
    passage, other = prose(330), prose(200)
    texts = [prose(rng.randrange(400)) + passage[rng.randrange(60) : 330 - rng.randrange(60)] + prose(rng.randrange(300)) for _ in range(40)]
    texts += [prose(50) + other + prose(50), other, other[:-1] + "#", "x" * 450, "x" * 199, "ab" * 260, prose(100) + "ab" * 130]
    texts += [passage, passage, prose(600), None, "", "z" * 200, "z" * 200]
    texts += [texts[0] * 2, prose(20) + other[1:] + prose(30)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    assert got(df) == sorted(brute(texts))
    rows = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, t1 int")
    kept = suffixes.kept_texts(rows, shard=900)
    assert sorted(tuple(r)[2:6] for r in kept.collect()) == sorted(set(brute(texts)))


def test_edges(spark, edge):
    assert got(edge) == sorted(brute([r["text"] for r in edge.collect()]))
    named = edge.withColumnRenamed("block", "t1").withColumnRenamed("bucket_", "kept")
    out = suffixes.remove_repeats(named)
    assert out.columns.count("kept") == 1 and "t1" in out.columns and out.count() == 11
    assert suffixes.remove_repeats(edge.limit(0)).count() == 0
    one = edge.where(F.col("doc_id") == 5)
    assert suffixes.remove_repeats(one).first()["kept"] is not None


def test_hot_anchors_are_split(spark, monkeypatch):
    """A short phrase amid different texts, a passage of many texts, and many equal texts, with every shared anchor hot."""
    monkeypatch.setattr(suffixes, "HOT_REGIONS", 1)
    rng = random.Random(12)
    noise = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    phrase, passage = "the very common phrase of forty-odd bytes, all alike", noise(700)
    texts = [noise(rng.randrange(120, 300)) + phrase + noise(rng.randrange(120, 300)) for _ in range(60)]
    texts += [noise(rng.randrange(0, 260)) + passage[: rng.randrange(150, 700)] + noise(rng.randrange(0, 260)) for _ in range(60)]
    texts += [noise(50) + "=" * rng.randrange(150, 420) + noise(50) for _ in range(20)] + [noise(400)] * 5 + ["x" * 199, "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    assert got(df) == sorted(brute(texts))
    rows = suffixes._split([(7, 1, 2, 5, (passage[:300] + phrase).encode())], 200)
    starts = sorted(s for _, _, _, first, region in rows for s in range(first, first + len(region) - 199))
    assert starts == list(range(5, 5 + 300 + len(phrase) - 199)) and len({r[0] for r in rows}) > 1


def test_anchors_go_when_the_regions_are_written(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT_REGIONS", 1)
    gone = []
    release = suffixes.release
    monkeypatch.setattr(suffixes, "release", lambda *tables: (gone.extend(c for t in tables for c in t.columns), release(*tables)))
    texts = ["".join(random.Random(i % 3).choices("abcdefgh ", k=300)) + str(i) for i in range(12)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert got(df) == sorted(brute(texts)) and gone == ["t1", "t2", "key", "first", "last"]
