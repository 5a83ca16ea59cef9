import random
import re
import time

from pyspark.sql import functions as F

from leafmill.llm import secrets

SAMPLE = re.compile(r"[A-Za-z0-9+/=_\-]{16,}", re.A)


def test_candidates_match_brute_force(spark, edge, small):
    for df in (edge, small):
        want = sorted((r["doc_id"] or 0, k, m.group(), r["text"][: m.start()][-48:]) for r in df.collect() for k, m in enumerate(SAMPLE.finditer(r["text"] or "")))
        got = secrets.candidates(df).collect()
        assert len(got) == len(want)
        short = sorted((r["doc_id"] or 0, r["ordinal"], r["candidate"]) for r in got)
        assert short == [x[:3] for x in want]
        assert all(w[3].endswith(b) for w, b in zip(want, [r["before"] for r in sorted(got, key=lambda r: (r["doc_id"] or 0, r["ordinal"], r["candidate"]))], strict=True))


def test_features(spark):
    words = spark.createDataFrame([("tion",), ("the",)], "word string")
    row = ("tests/a", 'my token = "', "thetion-0Az9ff00", '"')
    r = secrets.features(spark.createDataFrame([row], "path string, before string, candidate string, after string"), words).first()
    assert (r["length"], r["digits"], r["coverage"]) == (16.0, 4 / 16, 7 / 16)
    assert (r["odd_path"], r["named"], r["assigned"], r["quoted"], r["benign"]) == (1, 1, 1, 1, 0)


def test_held_out_findings(spark, small):
    words = secrets.dictionary(small).cache()
    rows = secrets.labelled_findings(spark, 3000).withColumn("part", F.pmod(F.xxhash64("candidate"), F.lit(4))).cache()
    model = secrets.train(rows.where("part <> 0"), words)
    held = model.transform(secrets.features(rows.where("part = 0"), words))
    total, right = held.count(), held.where("prediction = label").count()
    assert total > 500 and right / total > 0.97


def test_scan_finds_what_was_planted(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = secrets.scan(docs).collect()
    live = {r["candidate"] for r in got if r["is_secret"]}
    text = "\n".join(r["text"] for r in docs.collect())
    planted = set(re.findall(r'(?i)token = "([0-9a-f]{40})"', text))
    assert planted and planted <= live
    assert not any(re.fullmatch("[A-Za-z]+", x) for x in live)


def test_redaction_and_edges(spark, edge):
    key = "ab12cd34ef56ab78cd90ef12ab34cd56ef78ab90"
    docs = [(1, f'a token = "{key}" and the word internationalization.', "s"), (2, None, None), (3, "", "s"), (1, "none", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = sorted((r["doc_id"], r["text"]) for r in secrets.redact(df).collect() if r["text"])
    assert got == [(1, 'a token = "[SECRET]" and the word internationalization.'), (1, "none")]
    same = secrets.redact(edge.withColumnRenamed("block", "key_"))
    assert sorted(map(str, same.collect())) == sorted(map(str, edge.withColumnRenamed("block", "key_").collect()))
    assert secrets.scan(edge.limit(0)).count() == 0 and secrets.redact(edge.limit(0)).count() == 0


def test_keys_without_a_name_and_names_without_a_key(spark):
    """Live secrets in prose, in the .env form, in addresses and headers; words, paths and placeholders behind telling names."""
    aws, github, google = "AKIA" + "Q3ZK7WBN2LX5RT9D", "ghp_" + "b7Kx2QmZ9tLr4VwY8nJd3HsPf6GcAe1TuXoB", "AIza" + "SyD4kQ9zXw7Lm2Rt6Vb8Nc3Hj5Pf1Gs0Ea"
    key, hexed = "Zk8vQ2xLr9TmW4yB7nJd3HsPf6GcAe1TuXoKq5Vi", "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    live = {
        f"we met and {aws} was on the wall": aws,
        f"it said {github}, and then": github,
        f"some thing {key} stood there": key,
        f"export\nAPI_KEY={hexed}\n": hexed,
        f"AWS_SECRET_ACCESS_KEY={key}": key,
        f"https://maps.io/js?key={google}&v=3": google,
        f"https://maps.io/js?token={hexed}": hexed,
        f"Authorization: Bearer {key}\n": key,
    }
    dead = [
        'password = "internationalisierung"', "token: YOUR_TOKEN_GOES_HERE", 'secret = "/usr/share/keyrings/thing"',
        "API_KEY=xxxxxxxxxxxxxxxxxxxxxxxx", "it was internationalization then", f"commit {hexed}", "card 4785380592391139 of",
    ]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source")
    made = spark.createDataFrame([(-1 - k, x, "src/app") for k, x in enumerate([*live, *dead])], docs.schema)
    got = secrets.scan(docs.union(made)).where("doc_id < 0").collect()
    found = {(r["doc_id"], r["candidate"]) for r in got if r["is_secret"]}
    assert found == {(-1 - k, x) for k, x in enumerate(live.values())}
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(docs.union(made)).where("doc_id < 0").collect()}
    assert clean == {-1 - k: x.replace(live.get(x, "\0"), "[SECRET]") for k, x in enumerate([*live, *dead])}


def test_names_are_cut_off(spark):
    rows = ["API_KEY=0123456789abcdef", "a?key=0123456789abcdef==", "c2VjcmV0c2VjcmV0c2VjcmU=c2VjcmV0c2VjcmV0", "PASSWORD=short12345", "=" * 20]
    got = secrets.candidates(spark.createDataFrame([(k, x, "") for k, x in enumerate(rows)], "doc_id int, text string, source string"))
    assert [(r["before"], r["candidate"]) for r in sorted(got.collect(), key=lambda r: r["doc_id"])] == [
        ("API_KEY=", "0123456789abcdef"), ("a?key=", "0123456789abcdef=="), ("", rows[2]), ("", rows[3]), ("", rows[4])
    ]


def test_labelled_findings_decide_by_more_than_names(spark):
    rows = [r.asDict() for r in secrets.features(secrets.labelled_findings(spark, 1800), spark.createDataFrame([("tion",)], "word string")).collect()]
    assert {(r["named"], r["label"]) for r in rows if not r["odd_path"]} == {(0.0, 0.0), (0.0, 1.0), (1.0, 0.0), (1.0, 1.0)}
    assert not any(r["candidate"].lower().startswith(("token=", "secret_key=", "api_key=")) for r in rows)


def test_paths_are_weighed_by_whole_components(spark):
    names = ["docker-hub", "doctors.com", "latest-news", "contest", "a/testing", "docs", "tests/a", "x.example.org", "my-fixtures", None]
    words = spark.createDataFrame([("the",)], "word string")
    found = spark.createDataFrame([(k, p, "", "0123456789abcdef", "") for k, p in enumerate(names)], "k int, path string, before string, candidate string, after string")
    odd = {r["k"]: r["odd_path"] for r in secrets.features(found, words).collect()}
    assert [odd[k] for k in range(len(names))] == [0, 0, 0, 0, 0, 1, 1, 1, 1, 0]
    labelled = secrets.features(secrets.labelled_findings(spark, 2200), words)
    assert {r["label"] for r in labelled.where("odd_path = 1").select("label").distinct().collect()} == {0.0, 1.0}


def test_a_hot_source_with_an_odd_name_keeps_its_findings(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source")
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    made = spark.createDataFrame([(-1 - k, f'a token = "{key}" of', p) for k, p in enumerate(("docs", "latest-news", "test/a"))], docs.schema)
    assert secrets.scan(docs.union(made)).where(f"candidate = '{key}' and is_secret").count() == 3


def test_dictionary_has_words_of_every_length(spark):
    text = "internationalization " * 50 + "once " + "and " * 949 + "ab12cdefgh34ijkl"
    df = spark.createDataFrame([(text,), (None,)], "text string")
    assert {r["word"] for r in secrets.dictionary(df, share=0.01).collect()} == {"internationalization", "and"}
    assert {r["word"] for r in secrets.dictionary(df).collect()} == {"internationalization", "and", "once"}
    assert secrets.dictionary(df.limit(0)).count() == 0
    found = spark.createDataFrame([("", "", "xinternationalizationx", "")], "path string, before string, candidate string, after string")
    assert secrets.features(found, secrets.dictionary(df)).first()["coverage"] == 20 / 22


def test_labels_with_nulls_or_of_one_kind(spark, edge):
    schema = "path string, before string, candidate string, after string, label double"
    rows = [("a", "token = ", "9f86d081884c7d659a2feaa0c55ad015", "", 1.0), (None, None, "internationalization", None, 1.0), ("a", "", None, "", 0.0), ("a", "", "x" * 20, "", None)]
    docs = spark.createDataFrame([(1, "some internationalizations here", "s"), (2, "x" * 30, None)], "doc_id long, text string, source string")
    score = lambda labelled: {r["score"] for r in secrets.scan(docs, spark.createDataFrame(labelled, schema)).collect()}
    assert score(rows) == {1.0} and score([]) == {0.0}
    both = {r["doc_id"]: r["is_secret"] for r in secrets.scan(docs, spark.createDataFrame([*rows, *[("a", " ", "internationalizing", "", 0.0)] * 20, *rows * 10], schema)).collect()}
    assert len(both) == 2
    assert secrets.scan(edge, spark.createDataFrame(rows, schema)).count() == secrets.candidates(edge).count()


def test_a_hot_candidate(spark):
    """One candidate in a third of the rows has one coverage, and every row keeps it."""
    rows = [(k, "a", "internationalization" if k % 3 == 0 else f"internation{k:06d}abc") for k in range(900)]
    found = spark.createDataFrame(rows, "k int, path string, candidate string").withColumns({"before": F.lit(""), "after": F.lit("")})
    out = secrets.features(found, spark.createDataFrame([("internation",)], "word string")).collect()
    assert len(out) == 900 and {r["coverage"] for r in out if r["k"] % 3 == 0} == {11 / 20} and {r["coverage"] for r in out if r["k"] % 3} == {11 / 20}


def brute_coverage(candidate, words):
    low, covered = candidate.lower(), set()
    for at in range(len(low)):
        for n in {len(w) for w in words}:
            if at + n <= len(low) and low[at : at + n] in words:
                covered |= set(range(at, at + n))
    return len(covered) / len(candidate)


def test_coverage_by_brute_force_across_parts(spark, monkeypatch):
    monkeypatch.setattr(secrets, "PART", 5)
    draw = random.Random(3)
    words = {"abc", "bca", "cab", "aaa", "abcabcabc", "ccccc"}
    table = spark.createDataFrame([(w,) for w in words], "word string")
    given = {"".join(draw.choices("abcABC-1", weights=(9, 9, 9, 3, 3, 3, 1, 1), k=draw.randint(16, 90))) for _ in range(300)} | {"c" * 40, "A" * 31, "1234567890123456", "ab-" * 9}
    rows = spark.createDataFrame([(c,) for c in given] * 2, "candidate string")
    got = secrets._with_coverage(rows, table).collect()
    assert len(got) == 2 * len(given)
    for r in got:
        assert r["coverage"] == brute_coverage(r["candidate"], words), r["candidate"]
    none = secrets._with_coverage(rows, table.limit(0)).agg({"coverage": "max"}).first()[0]
    assert none == 0.0


def test_time_of_coverage_is_in_proportion_to_a_candidate(spark):
    draw = random.Random(5)
    words = spark.createDataFrame([("".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=3 + i % 9)),) for i in range(3000)], "word string").distinct()
    text = "".join(draw.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=1_000_000))
    took = []
    for size in (1_000, 100_000, 1_000_000):
        began = time.time()
        rows = spark.createDataFrame([(text[:size],), ("letters" * (size // 7),)], "candidate string")
        got = {r["candidate"][:7]: r["coverage"] for r in secrets._with_coverage(rows, words).collect()}
        assert 0 < got[text[:7]] < 1
        took.append(time.time() - began)
    assert took[2] < 60 and took[2] - took[0] < 30 * max(took[1] - took[0], 0.5), took
