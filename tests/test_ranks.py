import random

import pytest
from pyspark.sql import functions as F

from leafmill.operators import ranks


@pytest.mark.parametrize("edges", [1, 5, 64, 256])
def test_running_against_brute_force(spark, monkeypatch, edges):
    """One group holds most rows; groups and places may be null, and places begin one another."""
    monkeypatch.setattr(ranks, "EDGES", edges)
    rng = random.Random(edges)
    parts = ["a", "a-b", "a\0", "A", "", "é", "\U0001f600", "￿", None]
    rows = {(rng.choice([1, 1, 1, 1, 2, None]), tuple(rng.choices(parts, k=rng.randrange(4)))): rng.randrange(100) for _ in range(600)}
    rows = [(g, list(p), n) for (g, p), n in rows.items()] + [(3, None, 7)]
    df = spark.createDataFrame(rows, "g long, parts array<string>, n long").repartition(5)
    sums = {"ordinal": F.lit(1), "up_to": F.col("n")}
    got = ranks.running(df, "g", F.col("parts"), sums, {"up_to": "whole"})
    assert got.columns == ["g", "parts", "n", "ordinal", "up_to", "whole"]
    want = []
    for group in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == group), key=lambda r: [(x is not None, (x or "").encode()) for x in r[1] or []])
        total = 0
        for k, (g, p, n) in enumerate(mine, 1):
            total += n
            want.append((g, p, n, k, total, sum(r[2] for r in mine)))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_a_hot_group_is_cut(spark):
    df = spark.range(20_000).select(F.lit(1).alias("g"), F.array(F.lpad(F.col("id").cast("string"), 6, "0")).alias("p"))
    edges = ranks._edges(df.select(F.concat(F.array(F.lit("=1")), "p").alias("k")), "k")
    most = df.groupBy(ranks._range(F.concat(F.array(F.lit("=1")), "p"), edges)).count().agg(F.max("count")).first()[0]
    assert len(edges) == ranks.EDGES and most < 20_000 / ranks.EDGES * 12
    assert ranks.with_ordinal(df, "g", F.col("p")).where(F.get("p", F.lit(0)).cast("int") + 1 != F.col("ordinal")).isEmpty()


def test_empty(spark):
    df = spark.createDataFrame([], "g long, p array<string>")
    assert ranks.with_ordinal(df, "g", F.col("p")).collect() == []


def test_sort_text_orders_as_arrays_do(spark):
    rng = random.Random(3)
    parts = ["a", "a-b", "a\0", "a\1", "a\1\2", "\0", "\1", "\2", "", "é", "\U0001f600", None]
    rows = {tuple(rng.choices(parts, k=rng.randrange(4))) for _ in range(500)}
    df = spark.createDataFrame([(list(x),) for x in rows], "p array<string>").withColumn("t", ranks.sort_text(F.col("p")))
    keys = {tuple(r["p"]): r["t"].encode() for r in df.collect()}
    assert len(set(keys.values())) == len(rows)
    assert sorted(rows, key=keys.get) == sorted(rows, key=lambda x: [(y is not None, (y or "").encode()) for y in x])
