import math
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from leafmill.llm import mixing, ranks, sharding


def ideal(units, share, t):
    """Blocks of each source after t slots of a round, when all are served at once at their weights."""
    done, active = [Fraction(0)] * len(share), {i for i, b in enumerate(share) if b}
    while t > 0 and active:
        rate = sum(units[i] for i in active)
        step = min(Fraction(t), *(Fraction((share[i] - done[i]) * rate, units[i]) for i in active))
        for i in active:
            done[i] += step * units[i] / rate
        t -= step
        active = {i for i in active if done[i] < share[i]}
    return done


def test_schedule_stays_within_one_block(spark):
    for units, share in (([1], [1]), ([3, 1], [3, 1]), ([5, 3, 2, 1], [5, 3, 2, 1]), ([7, 2, 4], [7, 0, 4]), ([9, 9, 3], [2, 9, 3]), ([50, 31, 11, 7, 1], [20, 31, 2, 7, 0])):
        total = sum(share)
        rows = mixing.round_schedule(spark, [(0, 0, share)], units).collect()
        assert sorted(r["at"] for r in rows) == list(range(total))
        done = Counter()
        for r in sorted(rows, key=lambda r: r["at"]):
            assert r["release"] <= r["at"] < r["deadline"]
            done[r["number"]] += 1
            assert all(abs(done[i] - x) < 1 for i, x in enumerate(ideal(units, share, r["at"] + 1)))


def test_units_and_rounds():
    assert mixing.weight_units({"a": 3.0, "b": 1.0}, 10) == {"a": 7, "b": 3}
    assert sum(mixing.weight_units({str(i): i for i in range(7)}, 64).values()) == 64
    kinds = mixing.round_kinds([10, 3], [4, 2])
    assert kinds == [(0, 0, [4, 2]), (1, 6, [4, 1]), (2, 11, [2, 0])]


def test_mixture_of_rows(spark, small):
    out = mixing.mix_sources(small, {"src0": 0.5, "src1": 0.3, None: 0.1}, block_rows=2, resolution=100).collect()
    assert len(out) == small.count()
    blocks = defaultdict(list)
    for r in out:
        blocks[r["slot"]].append(r)
    assert sorted(blocks) == list(range(len(blocks)))
    assert all(len({(r["source"], r["block"]) for r in b}) == 1 for b in blocks.values())
    units = {r["source"]: r["weight_units"] for r in out}
    left = {s: -(-n // 2) for s, n in Counter(r["source"] for r in out).items()}
    served = Counter()
    total = sum(units.values())
    for slot in range(total):  # until the first source runs out
        served[blocks[slot][0]["source"]] += 1
        if any(served[s] >= left[s] for s in units):
            break
        for s, u in units.items():
            assert abs(served[s] - u * (slot + 1) / total) < 1


def test_mixing_edges(spark, edge):
    out = mixing.mix_sources(edge, block_rows=1, tie=("text",)).collect()
    assert len(out) == 11 and sorted(r["slot"] for r in out) == list(range(11))
    empty = mixing.mix_sources(edge.limit(0))
    assert empty.count() == 0 and set(mixing.MADE) <= set(empty.columns)


def test_shards(spark, small, edge):
    rows = sharding.assign_shards(small, 7).collect()
    sizes = Counter(r["shard"] for r in rows)
    assert len(rows) == small.count() and max(sizes.values()) - min(sizes.values()) <= 1
    for k in sizes:
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(sizes[k]))
    of = Counter(r["source"] for r in rows)
    for (_, s), n in Counter((r["shard"], r["source"]) for r in rows).items():
        assert abs(n - of[s] / 7) <= 2
    got = sharding.assign_shards(edge, 24, tie=("text",)).collect()
    assert len(got) == 11 and {r["slot"] for r in got} == {0} and len({r["shard"] for r in got}) == 11
    assert sharding.assign_shards(edge.limit(0), 24).count() == 0


def test_shards_by_brute_force(spark, small):
    import hashlib

    rows = small.select("doc_id", "source").collect()
    ranked, by = [], defaultdict(list)
    for r in rows:
        by["=" + r["source"]].append((hashlib.md5(f"0:{r['doc_id']}".encode()).hexdigest(), r["doc_id"]))
    for s, own in by.items():
        ranked += [((2 * i + 1) / (2 * len(own)), h, s, d) for i, (h, d) in enumerate(sorted(own))]
    want = {d: p * 24 // len(ranked) for p, (_, _, _, d) in enumerate(sorted(ranked))}
    assert {r["doc_id"]: r["shard"] for r in sharding.assign_shards(small, 24).collect()} == want


def test_exact_units():
    assert mixing.exact_units({"a": 0.7, "b": 0.3}) == {"a": 7, "b": 3} and mixing.exact_units({"a": 4.0, "b": 6.0}) == {"a": 2, "b": 3}
    assert mixing.exact_units({"a": 1.0, "b": 0.0}) is None and mixing.exact_units({"a": 0.123457, "b": 0.6}) is None


def test_stated_weights_at_a_million_blocks(spark):
    df = spark.range(1_000_000).selectExpr("id AS doc_id", "CASE WHEN id % 10 < 7 THEN 'a' ELSE 'b' END AS source")
    out = mixing.mix_sources(df, {"a": 0.7, "b": 0.3}, block_rows=1).selectExpr("block", "slot", "CASE source WHEN 'a' THEN 7 ELSE 3 END AS w", "weight_units")
    row = out.selectExpr(
        "count(DISTINCT slot) AS slots", "max(slot) AS last", "bool_and(weight_units = w) AS same",
        "max(10 * (block + 1) - w * (slot + 1)) AS ahead", "max(w * slot - 10 * block) AS behind",
    ).first()
    assert tuple(row)[:3] == (1_000_000, 999_999, True) and row["ahead"] < 10 and row["behind"] < 10


def edf(units, share):
    """The sources of a round's slots by earliest deadline first over the fluid schedule."""
    served = lambda k, a: sum(min(Fraction(u * k, a), b) for u, b in zip(units, share, strict=True))
    windows = [[(math.floor(served(k, a)), math.ceil(served(k + 1, a))) for k in range(b)] for a, b in zip(units, share, strict=True)]
    done, picks = [0] * len(units), []
    for t in range(sum(share)):
        i = min((w[d][1], i) for i, (w, d) in enumerate(zip(windows, done, strict=True)) if d < len(w) and w[d][0] <= t)[1]
        done[i] += 1
        picks.append(i)
    return picks


def test_component_blocks_by_brute_force(spark):
    rows = [(f"+0:{g}", f"={i}", float(1 + (i * 7 + g) % 5), 1 + (i * i + 3 * g) % 23) for g in range(4) for i in range(1 + 4 * g)]
    rows += [("+0:9", "", 0.0, 3), ("+0:9", "=z", 0.0, 20)]
    got = defaultdict(dict)
    for r in mixing.component_blocks(spark.createDataFrame(rows, "component string, item string, weight double, blocks long")).collect():
        assert r["slot"] not in got[r["component"]]
        got[r["component"]][r["slot"]] = (r["item"], r["block"])
    for g in got:
        own = sorted((i, w, n) for c, i, w, n in rows if c == g)
        units = [max(1, math.floor(w / (math.fsum(w for _, w, _ in own) or 1) * 4 * len(own) + 0.5)) for _, w, _ in own]
        want, past, first = [], [0] * len(own), 0
        while sum(past) < sum(n for _, _, n in own):
            share = [max(0, min(u, n - first * u)) for u, (_, _, n) in zip(units, own, strict=True)]
            for i in edf(units, share):
                want.append((own[i][0], past[i]))
                past[i] += 1
            first += 1
        assert [got[g][x] for x in range(len(want))] == want and len(got[g]) == len(want)


@pytest.mark.parametrize("sources, most", [(301, None), (10_000, None), (700, 60)])
def test_many_sources(spark, monkeypatch, sources, most):
    if most:  # three levels
        for name, value in (("MOST_SOURCES", most), ("HEAVIEST", 10), ("COMPONENT_SIZE", 8), ("LISTED_ROUNDS", 2)):
            monkeypatch.setattr(mixing, name, value)
    n = 4 * sources
    df = spark.range(n).selectExpr("id AS doc_id", f"CASE WHEN id % 3 = 0 THEN NULL ELSE cast(id % {sources} AS string) END AS source", "id AS item_", "'p' AS place_")
    rows = mixing.mix_sources(df, block_rows=2).orderBy("slot", "row_in_block").collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(n)) and all(r["item_"] == r["doc_id"] and r["place_"] == "p" for r in rows)
    of, last, held = {}, defaultdict(lambda: -1), Counter(r["source"] for r in rows)
    for r in rows:
        assert of.setdefault(r["slot"], (r["source"], r["block"])) == (r["source"], r["block"]) and r["release"] <= r["slot"] < r["deadline"]
    assert sorted(of) == list(range(sum(-(-x // 2) for x in held.values())))
    for slot in range(len(of)):  # blocks of a source come in their order
        source, block = of[slot]
        assert block == last[source] + 1
        last[source] = block
    counts = df.groupBy(ranks.stratum(F.col("source")).alias("item")).agg(F.count("*").cast("double").alias("weight"), F.count("*").alias("blocks"))
    items, placed = mixing.with_components(counts)
    left = {r["item"]: r["blocks"] for r in items.collect()}
    assert len(left) <= mixing.MOST_SOURCES and left[""] == held[None] and sum(left.values()) == n
    assert placed.count() + sum(v for k, v in left.items() if not k.startswith("+")) == n


def test_rows_without_an_id_are_shuffled_by_the_rest(spark):
    df = spark.range(4000).selectExpr("cast(NULL AS long) AS doc_id", "'a' AS source", "id AS other")
    keys = df.select(ranks.shuffle_key(0, "doc_id", df).alias("k"))
    assert keys.distinct().count() == 4000
    assert sharding.assign_shards(df, 7).groupBy("shard").count().count() == 7 and mixing.mix_sources(df).count() == 4000


def test_columns_with_clashing_names_are_kept(spark, small):
    names = ("at", "kind", "number", "k", "k_", "at_", "release_", "deadline_", "rank_", "rank_k", "hash_", "stratum_", "units_", "number_", "round_", "kind_", "bucket_", "before_", "n_")
    rows = small.select("doc_id", "source")
    plain = {r["doc_id"]: tuple(r[c] for c in mixing.MADE) for r in mixing.mix_sources(rows).collect()}
    odd = rows.selectExpr("doc_id", "source", *[f"concat('{n}', doc_id) AS {n}" for n in names], *[f"'old' AS {n}" for n in mixing.MADE])
    out = mixing.mix_sources(odd)
    assert out.columns == ["doc_id", "source", *names, *mixing.MADE]
    got = out.collect()
    assert {r["doc_id"]: tuple(r[c] for c in mixing.MADE) for r in got} == plain
    assert all(r[n] == f"{n}{r['doc_id']}" for r in got for n in names)


@pytest.mark.parametrize("given", [False, True])
def test_one_schedule_for_any_number_of_sources(spark, monkeypatch, given):
    df = spark.range(9000).selectExpr("id AS doc_id", "CASE WHEN id % 50 = 1 THEN NULL ELSE concat('s', cast(pow(id, 0.62) AS long)) END AS source")
    assert df.select("source").distinct().count() > mixing.MOST_SOURCES
    names = [r["source"] for r in df.select("source").distinct().collect()]
    weights = {s: 1.0 + len(s or "") * 0.37 for s in names} if given else None
    got = mixing.mix_sources(df, weights, block_rows=2).collect()
    monkeypatch.setattr(mixing, "MOST_SOURCES", 1000)  # the fold over the slots
    want = mixing.mix_sources(df, weights, block_rows=2).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)


def test_wide_schedule_by_brute_force(spark):
    for units, blocks in (([3, 1, 2], [10, 1, 5]), ([1] * 90, [1] * 90), ([7, 2, 4] * 30, [23, 5, 9, 40, 1, 6] * 15), ([5] * 40 + [300], [2] * 40 + [901])):
        names = [f"={i:04d}" for i in range(len(units))]
        rows = spark.createDataFrame(list(zip(names, units, blocks, strict=True)), "item string, units long, blocks long")
        plan, kinds = mixing.wide_schedule(rows)
        assert [(f, b) for f, b, _ in kinds] == [(f, b) for f, b, _ in mixing.round_kinds(blocks, units)]
        got = {(r["first"], r["at"]): r["item"] for r in plan.collect()}
        want = {(first, at): names[i] for first, _, share in mixing.round_kinds(blocks, units) for at, i in enumerate(edf(units, share))}
        assert got == want
