import random

import pytest
import sentencepiece

from leafmill.llm import pieces

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
MODEL = pieces.load_model()
ODD = ["  hello  world\n\tfoo é 中 \x00 x", " a  b ", "   ", "\n\n \n", "x" * 300, "ab" * 500 + " " + "1234567890" * 20, "<s> <0x0A> </s>", "\U0001f600🏽 ünï", "a\n b", "don't stop…!!! == ----------------", "\r\n\x0b"]


def test_no_piece_crosses_a_unit():
    assert MODEL.cut == pieces.CUTS[0]
    mixed = pieces.PieceModel({"a.": (300, -1.0), ".": (301, -2.0)}, 3, ())
    crossing = pieces.PieceModel({"a\u2581b": (300, -1.0)}, 3, ())
    assert mixed.cut == pieces.CUTS[1] and crossing.cut == pieces.CUTS[2]
    for p in MODEL.pieces:
        assert "\n" not in p and pieces.SPACE not in p.lstrip(pieces.SPACE)


def test_ids_are_those_of_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    for size in (0, 3000):
        rows = pieces.decode(pieces.encode(docs if size else docs.limit(150), MODEL, dictionary=size), MODEL).collect()
        for r in rows:
            assert list(r["ids"]) == LIBRARY.encode(r["text"]) and r["decoded"] == r["text"]


def test_units_by_lattice_and_alone(spark):
    rng = random.Random(2)
    words = {"".join(rng.choices("abcdeinorst.,é▁中́", k=rng.randrange(1, 40))) for _ in range(400)} | {"\n", "▁▁▁", "▁hello", "\U0001f600"}
    rows = pieces.encode_units(spark.createDataFrame([(w,) for w in words], "unit string"), MODEL).collect()
    assert len(rows) == len(words)
    for r in rows:
        assert list(r["ids"]) == pieces.encode_unit(r["unit"], MODEL)


def test_both_ways_to_merge():
    rng = random.Random(7)
    for _ in range(500):
        word = list("".join(rng.choices("aabcdeinorst ▁é", k=rng.randrange(1, 60))))
        assert pieces._merged(list(word), MODEL.costs) == pieces._merged_long(list(word), MODEL.costs)


def test_odd_texts(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    for r in pieces.decode(pieces.encode(df.union(df), MODEL), MODEL).collect():
        assert list(r["ids"]) == LIBRARY.encode(r["text"]) and r["decoded"] == r["text"]


def test_viterbi_by_brute_force(spark):
    table = {"a": -2.0, "b": -2.5, "ab": -3.0, "abc": -4.1, "bc": -1.7, "c": -3.0, "ca": -2.0, "▁a": -1.5, "▁": -2.0}
    names = [*table]
    model = pieces.PieceModel({p: (300 + i, s) for i, (p, s) in enumerate(table.items())}, 3, (b"",) * 300 + tuple(p.encode() for p in names), "unigram")

    def paths(s):
        if not s:
            yield 0.0, []
        for k in range(1, len(s) + 1):
            if s[:k] in table or k == 1:
                own = (table[s[:k]], [300 + names.index(s[:k])]) if s[:k] in table else (-14.1, [3 + b for b in s[:k].encode()])
                for score, rest in paths(s[k:]):
                    yield own[0] + score, own[1] + rest

    rng = random.Random(8)
    words = {"".join(rng.choices("abcx▁", k=rng.randrange(1, 9))) for _ in range(80)}
    rows = pieces.encode_units(spark.createDataFrame([(w,) for w in words], "unit string"), model).collect()
    score = lambda ids: sum(table[names[i - 300]] if i >= 300 else -14.1 / 1 for i in ids if i >= 300 or (i - 3) < 128)
    for r in rows:
        best = max(s for s, _ in paths(r["unit"]))
        assert abs(score(r["ids"]) - best) < 1e-9 and list(r["ids"]) == pieces.best_path(r["unit"], model)


def test_edges(spark, edge):
    rows = pieces.decode(pieces.encode(edge.withColumnRenamed("block", "ids"), MODEL), MODEL)
    assert rows.columns.count("ids") == 1
    got = rows.collect()
    assert len(got) == 11
    for r in got:
        assert r["decoded"] == r["text"] and (r["ids"] is None) == (r["text"] is None)
        assert r["text"] is None or list(r["ids"]) == LIBRARY.encode(r["text"])
    assert pieces.encode(edge.limit(0), MODEL).count() == 0


def test_units_reach_the_rows_that_hold_them(spark):
    """Rare units are joined to their rows, also where one row, or one text, makes up a third of the table."""
    rows = [(i, f"common words and only{i}here x{'y' * (60 + i % 5)}") for i in range(60)] + [(1, "the hot row hasitsownword")] * 30 + [(100 + i, "one hottextwith manyids") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = pieces.encode(df, MODEL, dictionary=5).collect()
    assert len(got) == 120 and all(list(r["ids"]) == LIBRARY.encode(r["text"]) for r in got)


def test_every_piece_is_its_own_encoding(spark, monkeypatch, tmp_path):
    """The merge fold rests on this; a model that lacks it is refused."""
    names = [p for p in MODEL.pieces if len(p) > 1][::40]
    rows = {r["unit"]: list(r["ids"]) for r in pieces.encode_units(spark.createDataFrame([(p,) for p in names], "unit string"), MODEL).collect()}
    assert rows == {p: [MODEL.pieces[p][0]] for p in names}

    class Odd:
        def __init__(self, model_file):
            self.names = ["<unk>", *[f"<0x{i:02X}>" for i in range(256)], "a", "b", "abc"]

        get_piece_size = lambda self: len(self.names)
        is_control = is_unknown = lambda self, i: i == 0
        is_byte = lambda self, i: 0 < i < 257
        id_to_piece = lambda self, i: self.names[i]
        get_score = lambda self, i: -float(i)

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Odd)
    with pytest.raises(ValueError, match="abc"):
        pieces.load_model("odd")


def test_array_lattice_by_single_units():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdeinorst.,é▁中\u0301\U0001f600大的\n0123=-", k=rng.randrange(1, 200))) for _ in range(600)]
    words += ["".join(rng.choices("etaoinshr", k=20_000)), "中文的大" * 5000, "a", *(c * n for c in "=x▁-" for n in range(1, 140))]
    got = pieces.Lattice(MODEL).codes(words)
    for w, ids in zip(words, got, strict=True):
        assert [int.from_bytes(ids[k : k + 4], "big") for k in range(0, len(ids), 4)] == pieces.encode_unit(w, MODEL)
    assert pieces.Lattice(MODEL).codes([]) == [] and pieces.Lattice(pieces.PieceModel({}, 3, ())).codes(["é"]) == [bytes((0, 0, 0, 3 + 195, 0, 0, 0, 3 + 169))]


def test_pieces_of_one_rank(spark):
    """Runs of spaces are pieces of one score: after a merge, one further left may be next."""
    texts = [f"a{' ' * n}b" for n in range(12, 70)] + ["def f():\n" + " " * 15 + "x\n" + " " * 40 + "y"] * 5
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for size in (0, 1000):
        assert all(list(r["ids"]) == LIBRARY.encode(r["text"]) for r in pieces.encode(df, MODEL, dictionary=size).collect())
    units = [("▁" * n,) for n in range(1, 62)]
    assert all(list(r["ids"]) == pieces.encode_unit(r["unit"], MODEL) for r in pieces.encode_units(spark.createDataFrame(units, "unit string"), MODEL).collect())


def test_texts_stay_in_place(spark, small):
    """No shuffle on the way of a text, however many of its units are rare; long texts without a space go the same way."""
    long = spark.createDataFrame([(1, "中文的大" * 5000), (2, "x" * 3_000_000), (3, "qzx" * 7000)], "doc_id long, text string")
    coded = pieces.encode(small.select("doc_id", "text").union(long), MODEL, dictionary=10)
    plan = coded._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and not any(x in plan for x in ("Exchange", "Join", "Sort"))
    assert all(list(r["ids"]) == LIBRARY.encode(r["text"]) for r in coded.collect())
