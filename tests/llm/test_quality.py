import re
from collections import Counter

from leafmill.llm import quality


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen = Counter(grams)
    covered = {p for i, g in enumerate(grams) if seen[g] > 1 for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered)


def test_counts_match_brute_force(spark, edge, small):
    for df in (edge, small):
        for r in quality.quality_rules(df).collect():
            got = tuple(r[k] for k in quality.COUNTS)
            assert got == brute(r["text"])
            assert r["base_failed"] == (got[0] < 10 or 100 * got[4] > 20 * got[0])


def test_bad_hosts_are_rejected_and_good_ones_kept(spark):
    good = "some words of a quite ordinary sentence that goes on for long enough number"
    rows = [(i, "bad", "too short") for i in range(40)] + [(100, "bad", good)]
    rows += [(200 + 50 * h + i, f"h{h}", f"{good} {h} {i}") for h in range(10) for i in range(40)]
    rows += [(900, None, good), (901, None, None)]
    out = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    kept = {r["doc_id"]: r["kept"] for r in out.collect()}
    assert len(kept) == len(rows) and not any(kept[i] for i in range(40)) and not kept[100]
    assert all(kept[200 + 50 * h + i] for h in range(10) for i in range(40))
    assert kept[900] and not kept[901]


def test_clashing_columns_and_empty_table(spark, edge):
    out = quality.quality_rules(edge.withColumnRenamed("block", "kept").withColumnRenamed("n_chars", "counts_"))
    assert out.columns.count("kept") == 1 and out.count() == 11
    assert quality.quality_rules(edge.limit(0)).count() == 0
