import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from leafmill.llm import hashing, importance, queries

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def brute(docs, target, percent=25, least=20):
    raw, aim = Counter(), Counter()
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    for _, text in docs:
        raw.update(map(bucket, features(text)[1]))
    for text in target:
        aim.update(map(bucket, features(text)[1]))
    s, t = sum(raw.values()), sum(aim.values())
    gain = {b: math.floor(1000 * math.log((aim[b] + 1.0) * (s + 10000.0) / ((raw[b] + 1.0) * (t + 10000.0)))) for b in raw}
    rows = []
    for key, text in docs:
        words, found = features(text)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append([key, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words)])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: len(able) * percent // 100], 1):
        r[4] = k
    return rows


def test_checksums_are_those_of_zlib():
    rng = np.random.default_rng(5)
    data = rng.integers(0, 256, 3000).astype(np.uint8)
    starts = rng.integers(0, 2000, 400)
    sizes = np.concatenate((np.arange(1, 200), rng.integers(1, 1000, 201)))
    want = [zlib.crc32(data[a : a + n].tobytes()) for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
    assert importance.checksums(data, starts, starts + sizes).tolist() == want
    assert len(importance.checksums(data, starts[:0], starts[:0])) == 0


def test_features_of_odd_texts():
    texts = ["One TWO,two\n x9-é", None, "", " ..", "a", "中文 b", "y" * 700 + " " + "z" * 65 + " q", "é"]
    at = 0
    for first, data, ends in hashing.slices(pa.array(texts), 1 << 19):
        one, two, stop = importance.buckets(data, ends)
        for i, end in enumerate(stop.tolist()):
            words, found = features(texts[first + i])
            got = one[at:end].tolist() + two[at : max(at, end - 1)].tolist()
            assert got == [zlib.crc32(f.encode()) % 10000 for f in found], texts[first + i]
            at = end


def check(spark, docs, target, got):
    want = brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], target)
    order = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r) for r in got.collect()), key=order) == sorted((tuple(r[:5]) for r in want), key=order)
    return want


def test_query_is_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    target = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = check(spark, spark.read.parquet(f"{sf}/documents.parquet"), target, queries.QUERIES["op13_importance_resampling"](spark, sf))
    assert max(r[4] or 0 for r in want) > 20


def test_edge_rows(spark, edge):
    clash = edge.withColumns({"rank": edge["n_chars"], "score": edge["lang"], "bucket_": edge["lang"]})
    target = spark.createDataFrame([("The quick brown fox",), (None,), ("",)], "text string")
    got = importance.importance(clash, target, carry=clash.columns, percent=50)
    assert [c for c in got.columns if c not in clash.columns] == ["n_words", "n_features", "weight"] and "lang" in got.columns
    rows = got.select("doc_id", "n_features", "weight", "score", "rank").collect()
    want = brute([(r["doc_id"], r["text"]) for r in edge.collect()], ["The quick brown fox", None, ""], 50)
    assert sorted(map(repr, (tuple(r)[:4] for r in rows))) == sorted(map(repr, (tuple(r[:4]) for r in want)))
    assert sorted(r["rank"] for r in rows if r["rank"]) == sorted(r[4] for r in want if r[4])


def test_resample_keeps_the_columns_of_the_drawn(spark, edge, small):
    target = spark.createDataFrame([("the with of and",)], "text string")
    for docs in (small.withColumnRenamed("lang", "score"), edge):
        kept = importance.resample(docs, target)
        drawn = importance.importance(docs, target).where("rank IS NOT NULL")
        assert kept.columns == docs.columns
        assert sorted(map(repr, (r["doc_id"] for r in kept.collect()))) == sorted(map(repr, (r["doc_id"] for r in drawn.collect())))
    assert importance.resample(small.limit(0), target).count() == 0


def test_empty_tables(spark, small):
    none = small.limit(0)
    assert importance.importance(none, small.limit(3)).count() == 0
    assert importance.importance(small, none).count() == small.count()
