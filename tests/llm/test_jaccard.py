import itertools
import random
import re

import numpy as np

from leafmill.llm import components, jaccard


def brute(rows, size=4, percent=85):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        n = min(size, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set())
    index, up = {}, list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, s in enumerate(sets):
        for g in s:
            index.setdefault(g, []).append(i)
    tried = set()
    for own in index.values():
        for i, j in itertools.combinations(own, 2):
            if (i, j) not in tried:
                tried.add((i, j))
                if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                    up[find(j)] = find(i)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return sorted((str(k), len(s), str(None if k is None else least[find(i)])) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True)))


def got(df):
    return sorted((str(r[0]), r[1], str(r[2])) for r in jaccard.near_duplicates(df).collect())


def test_near_copies_by_brute_force(spark):
    """Chains, groups with few and with many changes, short texts and repeated lines."""
    rng = random.Random(4)
    rows, words = [], [f"w{i}" for i in range(400)]
    for g in range(14):
        base = rng.choices(words, k=rng.choice([3, 5, 30, 60, 120]))
        for _ in range(rng.choice([2, 5, 25])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows) * 7 % 1009 + 1, " ".join(copy)))
            if g % 3 == 0:
                base = copy
    common = " ".join(rng.choices(words, k=40))
    rows += [(2000 + i, common + " " + " ".join(rng.choices(words, k=rng.choice([3, 9, 60])))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(df) == brute(rows)


def test_documents_by_brute_force(spark, small):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    assert got(docs) == brute([tuple(r) for r in docs.collect()])


def test_hot_runs_and_more_counters(spark, small, monkeypatch):
    """Whatever bound makes a run hot, and however many counters there are, the links are the same."""
    hot = [(10_000 + i, f"this run is in a third of all rows {i // 2} and then some words more {i // 4} of its own {i // 8} at the end") for i in range(120)]
    rows = [(r["doc_id"], r["text"]) for r in small.limit(240).collect()] + hot
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows)
    assert [jaccard.counter_bits(n) for n in (0, 10**6, 10**7, 10**12)] == [17, 17, 19, 22]
    for most, bits in ((30, (17, 22)), (0, (5, 5)), (100_000, (20, 22))):
        monkeypatch.setattr(jaccard, "MOST_OF_RUN", most)
        monkeypatch.setattr(jaccard, "COUNTER_BITS", bits)
        counters = jaccard.run_counters(df, "text", 4)
        assert len(counters) == 1 << bits[0] and jaccard.hot_bound(counters) <= most
        assert got(df) == want


def test_edges(spark, edge):
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    assert got(edge) == brute(rows)
    assert got(edge.limit(0)) == []


def test_filters_never_lose_a_link():
    rng = np.random.default_rng(1)
    for _ in range(300):
        x = np.unique(rng.integers(0, 300, rng.integers(1, 120)).astype(np.uint64))
        y = np.unique(np.concatenate((x[rng.random(len(x)) > 0.1], rng.integers(0, 300, rng.integers(1, 12)).astype(np.uint64))))
        both = len(np.intersect1d(x, y))
        assert jaccard.suffix_bound(x, y) >= both
        differ = sum(int(v).bit_count() for v in (jaccard.parities(x) ^ jaccard.parities(y)).view(np.uint64))
        assert both <= (len(x) + len(y) - differ) / 2 and len(jaccard.parities(x)) == jaccard.WORDS
        assert jaccard.linked(x, y, 85) == (100 * both >= 85 * (len(x) + len(y) - both))
    for n in range(1, 200):
        p = jaccard.prefix_length(n, 85)
        assert 100 * (n - p + 1) >= 85 * n > 100 * (n - p)


def test_components(spark):
    links = [(i, i + 1) for i in range(10, 40)] + [(5, 40), (100, 99), (100, 100), (200, 200), (7, None)]
    rows = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    want = {i: 5 for i in [5, *range(10, 41)]} | {99: 99, 100: 99, 200: 200}
    assert {r["node"]: r["label"] for r in rows} == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def thue_morse(n, letters="ab"):
    return "".join(letters[bin(i).count("1") & 1] for i in range(n))


def test_words_that_collide_under_polynomials(spark):
    """Thue-Morse words and their complements have one hash modulo 2^64 under any odd multiplier."""
    rows = []
    for n in (64, 1024, 2048, 4096):
        for k, letters in enumerate(("ab", "ba")):
            rows.append((n + k, thue_morse(n, letters)))
            rows.append((2 * n + 5000 + k, " ".join(thue_morse(n, letters) + str(i) for i in range(8))))
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_pairs_are_compared_by_words():
    a = "One two three four five six"
    assert jaccard.linked_by_words(a, a.upper(), 4, 100) and jaccard.linked_by_words("x y", "X  Y", 4, 85)
    assert not jaccard.linked_by_words(a, a.replace("six", "seven"), 4, 85) and not jaccard.linked_by_words("x y", "y x", 4, 85)
    assert jaccard.linked_by_words("\ud800 a", "\ud800 A", 4, 85)


def test_mixed_runs(spark):
    """A large group of copies, near copies of it that do not link with its head, and strangers that share its rare runs."""
    rng = random.Random(9)
    words = [f"v{i}" for i in range(500)]
    base = rng.choices(words, k=50)
    rows = [(i, " ".join(base)) for i in range(40)]
    for i in range(40, 90):
        copy = list(base)
        for _ in range(rng.choice([1, 2, 3])):
            copy[rng.choice([0, 1, 2, 47, 48, 49])] = rng.choice(words)
        rows.append((i, " ".join(copy)))
    rows += [(100 + i, " ".join(base[20:30] + rng.choices(words, k=25))) for i in range(40)]
    rows += [(200 + i, " ".join(base[:25] + rng.choices(words, k=i % 4))) for i in range(30)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
