import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from leafmill.llm import hashing, queries, toxicity


def test_word_hashes_are_those_of_the_words():
    texts = ["The the  cat\n", "", None, "a", "cat THE", " é x\té", "x" * 70, "no_break-here the"]
    for separators, pattern in ((hashing.WHITE, rb"[^\x20\x09-\x0D]+"), (hashing.NO_LETTER, rb"[A-Za-z\x80-\xff]+")):
        of = {}
        for i, got in hashing.text_words(pa.array(texts), separators, True):
            want = re.findall(pattern, (texts[i] or "").encode())
            lower = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in want]
            assert len(got) == len(lower)
            for w, h in zip(lower, got.tolist(), strict=True):
                assert of.setdefault(w, h) == h
        assert len(set(of.values())) == len(of)
    assert len(hashing.runs(np.arange(3, dtype=np.uint64), 4)) == 1 and len(hashing.runs(np.arange(6, dtype=np.uint64), 4)) == 3


def test_slices_cover_long_texts(monkeypatch):
    monkeypatch.setattr(hashing, "SLICE", 50)
    hashing._powers.cache_clear()
    texts = ["ab cd " * 30, "x", "", "ab " * 10, "cd"]
    got = {i: w for i, w in hashing.text_words(pa.array(texts).slice(0), hashing.WHITE, False)}
    assert [len(got[i]) for i in range(5)] == [60, 1, 0, 10, 1] and got[0][0] == got[3][0] and got[0][1] == got[4][0]
    hashing._powers.cache_clear()


def test_neighbours_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 8)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.fit(labels, docs, per_class=60, min_df=3, min_ratio=3.0, nearest=10)
    found = {r["doc_id"]: re.findall(r"[a-z\x80-\U0010ffff]+", r["text"].lower()) for r in docs.collect()}
    texts = {i: Counter(w) for i, w in found.items()}
    held = [sum(model.labels == k) for k in (0, 1)]
    df = [Counter(w for i, own in zip(model.ids.tolist(), model.labels.tolist(), strict=True) if own == k for w in texts[i]) for k in (0, 1)]

    def ratio(w):
        n = df[0][w] + df[1][w]
        return 2 * sum(df[k][w] * np.log(df[k][w] / (n * held[k] / sum(held))) for k in (0, 1) if df[k][w])

    terms = {w for w in df[0] | df[1] if df[0][w] + df[1][w] >= 3 and ratio(w) >= 3}
    every = Counter(w for t in texts.values() for w in t if w in terms)
    assert len(terms) > 20 and len(model.terms) == len(terms)

    def vector(i):
        v = {w: (1 + np.log(n)) * np.log((1 + len(texts)) / (1 + every[w])) for w, n in texts[i].items() if w in terms}
        if others := sum(n for w, n in texts[i].items() if w not in terms):
            v[""] = (1 + np.log(others)) * toxicity.REST
        norm = np.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()} if norm else {}

    examples, shares = [vector(i) for i in model.ids.tolist()], {}
    rows = docs.limit(120).select("doc_id", "text").toPandas()
    for k, words in toxicity._terms(pa.array(rows["text"])):
        own = vector(int(rows["doc_id"][k]))
        exact = np.array([sum(x * e.get(w, 0) for w, x in own.items()) for e in examples])
        best, cosines = model.neighbours(words)
        want = np.sort(exact[exact > 1e-12])[::-1][:10]
        assert len(best) == len(want) and np.allclose(cosines, want) and np.allclose(exact[best], cosines)
        votes = [(c * c / held[y], y) for c, y in zip(exact[best], model.labels[best].tolist(), strict=True)]
        shares[int(rows["doc_id"][k])] = sum(v for v, y in votes if y) / sum(v for v, _ in votes) if votes else None
    x, y = model.curve
    assert (np.diff(x) >= 0).all() and (np.diff(y) >= 0).all() and 0 <= y[0] and y[-1] <= 1
    for r in toxicity.score_toxicity(docs.limit(120), model).collect():
        share = shares[r["doc_id"]]
        at = [i for i, v in enumerate(x) if share is not None and v <= share]
        if share is None:
            want = model.prior
        elif not at or at[-1] == len(x) - 1:
            want = 0.999 * (y[at[-1]] if at else y[0]) + 0.001 * share
        else:
            i = at[-1]
            want = 0.999 * (y[i] + (y[i + 1] - y[i]) * (share - x[i]) / (x[i + 1] - x[i])) + 0.001 * share
        assert abs(r["score"] - want) < 1e-6 and r["predicted"] == int(r["score"] >= 0.5)


def test_held_out_labels(spark):
    out = queries.op9_toxicity(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("toxic is not null")
    got = out.where("held_out").join(labels, "doc_id").toPandas()
    hit = got["predicted"] == got["toxic"]
    marked = got[got["predicted"] == 1]
    print("held-out accuracy", hit.mean(), "precision", (marked["toxic"] == 1).mean(), "recall", len(marked[marked["toxic"] == 1]) / (got["toxic"] == 1).sum())
    assert hit.mean() > 0.98 and (marked["toxic"] == 1).mean() > 0.95 and len(marked) > 0.85 * (got["toxic"] == 1).sum()
    words = r"(?i)\b(idiot|moron|scum|stupid|worthless)\b"
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where(F.size(F.regexp_extract_all("text", F.lit(words), F.lit(0))) >= 2)
    insults = out.join(docs.select("doc_id"), "doc_id").toPandas()
    print("documents with insults", len(insults), "marked", insults["predicted"].mean())
    assert insults["predicted"].mean() > 0.9


def test_isotonic_curve():
    x, y = toxicity._isotonic(np.array([0.1, 0.2, 0.2, 0.3, 0.5]), np.array([0, 1, 0, 0, 1]), np.ones(5))
    assert x.tolist() == [0.1, 0.1, 0.2, 0.3, 0.5, 0.5] and np.allclose(y, [0, 0, 1 / 3, 1 / 3, 1, 1])


def test_edges(spark, edge):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (5, None), (8, 1), (7, 3)], "doc_id long, toxic int")
    model = toxicity.fit(labels, edge, min_df=1)
    out = toxicity.score_toxicity(edge.withColumn("evidence", F.lit(1)), model).collect()
    assert len(out) == 11 and all(0 <= r["score"] <= 1 for r in out)
    assert all(r["score"] == model.prior for r in out if not (r["text"] or "").strip())
    none = toxicity.fit(labels.limit(0), edge)
    assert {r["score"] for r in toxicity.score_toxicity(edge, none).collect()} == {0.0}
    assert toxicity.score_toxicity(edge.limit(0), model).count() == 0


def test_no_label_has_a_say_in_its_own_vote(spark):
    """With labels that go with nothing, votes on examples by the other parts tell nothing, and so do scores."""
    rng = np.random.default_rng(4)
    rows = [(i, " ".join("w" + "".join(chr(97 + int(d)) for d in str(k)) for k in rng.integers(0, 3000, 30)), int(rng.integers(0, 2))) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.select("doc_id", "toxic"), df, min_df=1, min_ratio=1.0, nearest=20)
    scores = np.array([r["score"] for r in toxicity.score_toxicity(df, model).collect()])
    assert len(model.terms) > 500 and np.quantile(np.abs(scores - model.prior), 0.5) < 0.25
