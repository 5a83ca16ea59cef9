import math
import re
from collections import Counter

import numpy as np

from leafmill.llm import queries, search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, most=10):
    """Sorted (item, rank, id, score); docs and items are (key, text)."""
    counts = [(key, Counter(terms(text))) for key, text in docs]
    n_docs = sum(1 for _, c in counts if c)
    words = sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for key, c in counts:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // max(words, 1)
            s = sum(math.floor(1000 * math.log((2.0 * n_docs + 2) / (2.0 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                scored.append((-s, key is None, key or 0, key))
        out += [(item, i, x[3], -x[0]) for i, x in enumerate(sorted(scored)[:most], 1)]
    return sorted(out, key=repr)


def pairs(df, key):
    return [(r[key], r["text"]) for r in df.select(key, "text").collect()]


def test_query_is_brute_force(spark, small):
    got = queries.QUERIES["op11_lexical_search"](spark, "/root/testdata/sf0.001").collect()
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    assert sorted(map(tuple, got), key=repr) == brute(pairs(small, "doc_id"), pairs(items, "item_id"))


def test_small_blocks_shards_and_parts_change_nothing(spark, small, monkeypatch):
    for name, value in (("BLOCK", 4), ("ITEMS", 12), ("FIRST", 1)):
        monkeypatch.setattr(search, name, value)
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").limit(30)
    got = search.search(small, items, most=3).collect()
    assert sorted(map(tuple, got), key=repr) == brute(pairs(small, "doc_id"), pairs(items, "item_id"), 3)


def test_edge_rows(spark, edge):
    items = spark.createDataFrame(
        [("a", "the QUICK-brown fox 中文"), ("a", "the QUICK-brown fox 中文"), ("b", None), (None, "two w5x5 w6x6"), ("c", "..."), ("d", "absent"), ("e", "Ünï")],
        "item_id string, text string",
    )
    clash = edge.withColumns({"rank": edge["n_chars"], "score": edge["lang"], "number": edge["lang"], "item_id": edge["lang"]})
    got = search.search(clash, items, most=4)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(pairs(edge, "doc_id"), pairs(items, "item_id"), 4)
    assert search.search(edge.limit(0), items).count() == 0
    assert search.search(edge, items.limit(0)).count() == 0
    assert search.search(edge, items.where("item_id = 'b'")).count() == 0


def built(rng, documents=3000, vocabulary=300, monkeypatch=None):
    """A shard of clustered vectors, items, and the scores of all documents for each."""
    topics = rng.dirichlet(np.full(vocabulary, 0.03), 12)
    rows = [np.unique(rng.choice(vocabulary, rng.integers(0, 30), p=topics[rng.integers(12)])) for _ in range(documents)]
    edges = np.concatenate(([0], np.cumsum([len(x) for x in rows])))
    codes, values = np.concatenate(rows), rng.integers(1, 1000, edges[-1]) ** 2
    items = [np.unique(rng.choice(vocabulary, 12, p=topics[rng.integers(12)])) for _ in range(40)]
    beside = [np.unique(np.concatenate([x for x in items if t in x] or [np.empty(0, np.int64)])).astype(np.int64) for t in range(vocabulary)]
    ids = rng.permutation(documents)
    shard = search.Shard(ids, np.zeros(documents, bool), edges, codes, values, beside)
    full = np.zeros((documents, vocabulary), np.int64)
    full[np.repeat(np.arange(documents), np.diff(edges)), codes] = values
    return shard, items, full


def test_summaries_bound_and_blocks_are_skipped():
    shard, items, full = built(np.random.default_rng(3))
    for item in items:
        best = search.Best(10)
        shard.search(item, best)
        scores = full[:, item].sum(1)
        want = sorted((-s, i) for s, i in zip(scores.tolist(), shard.ids.tolist(), strict=True) if s > 0)[:10]
        assert list(zip((-best.scores).tolist(), best.ids.tolist(), strict=True)) == want
    holding = sum(int((full[:, item].sum(1) > 0).sum()) for item in items)
    assert shard.scored < 0.75 * holding  # the rest was passed over by its bounds
    for term, (own, cuts, summary) in shard.blocked.items():
        assert sorted(own.tolist()) == np.flatnonzero(full[:, term]).tolist() and np.diff(cuts).max() <= search.BLOCK
        for a, b, row in zip(cuts[:-1], cuts[1:], summary, strict=True):
            assert row.tolist() == full[own[a:b]][:, shard.beside[term]].max(0).tolist()


def test_best_goes_by_score_then_id_then_null():
    best = search.Best(3)
    best.add(np.array([5, 5, 0, 7]), np.array([4, 0, 1, 9]), np.array([False, True, False, False]))
    assert best.ids.tolist() == [9, 4, 0] and best.null.tolist() == [False, False, True] and best.least == 5
    best.add(np.array([5, 4]), np.array([3, 2]), np.array([False, False]))
    assert best.ids.tolist() == [9, 3, 4] and best.least == 5
