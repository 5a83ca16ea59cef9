import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leafmill.llm import packing, queries

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def library(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_words_encode_as_the_library_does_whole_texts():
    odd = [
        "", "  It's 12.5% OFF!!! don't\tI'LL\n'S 's", "<|endoftext|> a<|endoftext|>b <|ENDOFTEXT|> x<|startoftext|>", "H̱ ẖ İ é É.",
        "a\x0bb\x0cc\x1cd\x1fe\x85f\xa0g h​i　j", "中文。日本語 ٣٤ ½ ǅ ẞ ΑΣ.", "x" * 5000 + "." * 300, "...a ...'re 're... a'S.B", "﻿Á́ ́a \x00\x01 \U0001f600\U0001f44d\U0001f3fd!?", "A.B,c;D: e!F?",
    ]
    draw = random.Random(4)
    alphabet = list("aAbZ '.,!<|>\n\t") + ["́", "̱", "é", "É", "中", "’", "\x85", " ", "ſ", "K", "12", "endoftext"]
    odd += ["".join(draw.choices(alphabet, k=draw.randint(1, 60))) for _ in range(3000)]
    coder = packing.WordCoder(PATH)
    for text, ids in zip(odd, coder.texts([x.encode() for x in odd]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library(text), repr(text)


def test_words_that_differ_in_case_and_stops_are_remembered_once():
    texts = ["Tail tail, TAIL. tail", "tail. TAIL,\ntail.", "H̱ H, ẖ. <|ENDOFTEXT|> A. <|endoftext|>. B,", "it'S. 'S, 12. É. é, K. !. ., a., b.\x0bc,\x1cd. e."]
    coder = packing.WordCoder(PATH)
    first = [np.frombuffer(x, "<u4").tolist() for x in coder.texts([x.encode() for x in texts[:2]])]
    assert {b"tail", b".", b","} <= set(coder.young) and len(coder.young) <= 4  # a stop at the end of a text stays where it is
    assert first + [np.frombuffer(x, "<u4").tolist() for x in coder.texts([x.encode() for x in texts[2:]])] == list(map(library, texts))


def test_words_are_cut_to_the_bone_before_they_are_remembered():
    texts = ["one-two, Two|three (ONE)", "été Été. \n(été)two", "10 1001 one2two", "It's ONE'S two'LL 'tis '", "é́t <|endoftext|>one ×one"]
    coder = packing.WordCoder(PATH)
    for text, ids in zip(texts, coder.texts([x.encode() for x in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library(text), text
    plain = {"one", "two", "three", "-", ",", "|", "(", ")", "été", ".", "0", "1", "2", "it", "'s", "'ll", "'t", "is", "'"}
    assert set(coder.young) == {x.encode() for x in plain} | {"é́t".encode(), b"<|endoftext|>one", "×one".encode()}


def test_stops_behind_words_of_other_scripts_are_parted(monkeypatch):
    texts, encoded = ["мир, мир. мир.,", "中文. ж́. \x01.", "мир ж, ."], []
    coder = packing.WordCoder(PATH)
    of = coder._ids
    monkeypatch.setattr(coder, "_ids", lambda words: encoded.extend(words) or of(words))
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.texts([x.encode() for x in texts])] == list(map(library, texts))
    assert sorted(encoded) == sorted(["мир", "中文", "ж́.", "\x01.", "ж"])


def test_long_texts_are_cut_at_white_space(monkeypatch):
    monkeypatch.setattr(packing, "BYTES", 10)
    draw = random.Random(6)
    texts = ["".join(draw.choices(["a", "It's", "É", "12", " ", "\n", "..", "中"], k=draw.randint(0, 40))) for _ in range(300)] + ["x" * 50, " " * 50, "x" * 30 + " y"]
    coder, sizes = packing.WordCoder(PATH), []
    of = packing._words
    monkeypatch.setattr(packing, "_words", lambda text: sizes.append(len(text)) or of(text))
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.texts([x.encode() for x in texts])] == list(map(library, texts))
    assert len(sizes) > 300


def test_remembered_words_are_bounded(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 5)
    monkeypatch.setattr(packing, "ROWS", 1)
    coder, texts = packing.WordCoder(PATH), ["one two three", "four five", "six seven eight", "one nine."]
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.texts([x.encode() for x in texts])] == list(map(library, texts))
    assert len(coder.young) + len(coder.old) <= 14


def check(rows, docs, capacity):
    """Pieces are those of the documents, and sequences are without gaps, overlaps or excess. Returns the number of sequences."""
    want = []
    for key, text in docs:
        ids = [*library(text), 0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            own = np.array(ids[at : at + capacity], "<u4")
            want.append((key, k, at, len(own), zlib.crc32(own.tobytes())))
    assert sorted((tuple(r)[:5] for r in rows), key=repr) == sorted(want, key=repr)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def least(rows, capacity):
    return -(-sum(r["length"] for r in rows) // capacity)


def test_query_packs_all_documents(spark, small):
    out = queries.QUERIES["op12_packing"](spark, "/root/testdata/sf0.001")
    assert dict(out.dtypes) == {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"}
    rows = out.collect()
    assert check(rows, [(r["doc_id"], r["text"]) for r in small.collect()], 2048) <= least(rows, 2048) + 1


def test_levels_and_islands(spark, small, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 40)
    rows = packing.pack(small, PATH, capacity=1024, with_ids=True).collect()
    docs = [(r["doc_id"], r["text"]) for r in small.collect()]
    check([r[:7] and r for r in rows], docs, 1024)
    of = dict(docs)
    assert all([*library(of[r["doc_id"]]), 0][r["start"] : r["start"] + r["length"]] == r["ids"] for r in rows)
    assert len({r["sequence_id"] for r in rows}) <= 1.02 * least(rows, 1024) + 1


def test_edge_rows(spark, edge):
    clash = edge.withColumns({"offset": F.col("n_chars"), "length": F.col("lang"), "row_": F.col("lang")})
    out = packing.pack(clash, PATH, keep=("doc_id", "row_", "length"), capacity=64)
    assert out.columns == ["doc_id", "row_", *packing.MADE]
    check(out.drop("row_").collect(), [(r["doc_id"], r["text"]) for r in edge.collect()], 64)
    assert packing.pack(edge.limit(0), PATH).count() == 0


def test_one_length_makes_a_third_of_all_rows(spark):
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("a " * 30)).otherwise(F.concat(F.lit("b "), F.repeat(F.lit("c "), (F.col("id") % 50).cast("int")))).alias("text"))
    rows = packing.pack(docs, PATH, capacity=64).collect()
    assert check(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], 64) <= 1.03 * least(rows, 64) + 1


def triples(draw, bins):
    """Lengths that fill so many bins of 100 without a rest."""
    lengths = []
    for _ in range(bins):
        a, b = draw.randint(30, 60), draw.randint(15, 30)
        lengths += [a, b, 100 - a - b]
    return lengths


def test_operators_keep_every_piece_once():
    draw = random.Random(2)
    problem = packing.Problem(triples(draw, 100), 100)
    population = problem.founders(draw)
    for _ in range(20):
        for bins in (problem.crossed(*draw.sample(population, 2), draw), problem.mutated(population[0], draw)):
            assert sorted(p for own in bins for p in own) == list(range(300)) and max(map(problem.fill, bins)) <= 100
    evolved = problem.evolve(population, draw)
    assert problem.value(evolved[0]) >= max(map(problem.value, population))


def test_crossover_injects_whole_well_filled_bins():
    problem = packing.Problem([6, 4, 5, 5, 9, 3, 3, 3], 10)
    first, second = [[0, 5], [1, 2], [3, 6], [4], [7]], [[0, 1], [2, 3], [4], [5, 6, 7]]
    for seed in range(10):
        child = problem.crossed(first, second, random.Random(seed))
        assert any(sorted(own) in (sorted(x) for x in child) for own in ([0, 1], [2, 3])) and len(child) <= len(first)


def test_genetic_search_beats_best_fit():
    draw = random.Random(8)
    won = 0
    for _ in range(4):
        lengths = triples(draw, 40)
        problem = packing.Problem(lengths, 100)
        plain = problem.best_fit([], sorted(range(120), key=lengths.__getitem__, reverse=True))
        population = problem.founders(draw)
        for _ in range(4):
            population = problem.evolve(population, draw)
        assert problem.value(population[0]) >= problem.value(plain)
        won += problem.value(population[0]) > problem.value(plain)
    assert won >= 2


def test_fills_of_the_last_bins_are_kept():
    draw = random.Random(4)
    problem = packing.Problem([draw.randrange(1, 90) for _ in range(200)], 100)
    founders = [problem.best_fit([], draw.sample(range(200), 200)) for _ in range(2)]
    for make in (lambda: problem.crossed(founders[0], founders[1], draw), lambda: problem.mutated(founders[0], draw)):
        bins = make()
        assert problem.fills == [problem.fill(own) for own in bins] and sorted(x for own in bins for x in own) == list(range(200))
