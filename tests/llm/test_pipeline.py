import re

import pytest
import sentencepiece

import corpus_pipeline
from leafmill.llm import mixing, pieces
from tests.llm.test_jaccard import brute as brute_components
from tests.llm.test_quality import brute as brute_counts

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, small, tmp_path_factory):
    """docs, and what each stage made of them."""
    out = [small]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns(stages):
    for df in stages[:-1]:
        assert df.columns == stages[0].columns and df.dtypes == stages[0].dtypes


def test_quality(stages):
    """All hosts of these tables are good ones."""
    docs, kept = rows(stages[0]), rows(stages[1])
    want = set()
    for i, r in docs.items():
        n, _, _, _, repeated = brute_counts(r["text"])
        if n >= 10 and 100 * repeated <= 20 * n:
            want.add(i)
    assert set(kept) == want and all(docs[i] == r for i, r in kept.items())


def test_near_copies(stages):
    docs, kept = rows(stages[1]), rows(stages[2])
    found = brute_components([(r["doc_id"], r["text"]) for r in docs.values()], 5, 80)
    assert set(kept) == {int(k) for k, _, c in found if k == c} and len(kept) < len(docs)


def test_secrets(stages):
    docs, clean = rows(stages[2]), rows(stages[3])
    assert set(docs) == set(clean)
    token = r'(?i)(token = )"[0-9a-f]{40}"'
    for i, r in docs.items():
        assert re.sub(token, r'\1"[SECRET]"', r["text"]) == clean[i]["text"]
        assert clean[i]["lang"] == r["lang"] and clean[i]["source"] == r["source"]


def test_mixture(stages):
    docs, mixed = stages[3], stages[4]
    assert rows(docs) == rows(mixed) and docs.count() == mixed.count()
    place = {r["doc_id"]: (r["slot"], r["row_in_block"]) for r in mixing.mix_sources(docs).collect()}
    assert [r["doc_id"] for r in mixed.coalesce(1).collect()] != sorted(place)
    for part in mixed.rdd.glom().collect():
        assert [place[r["doc_id"]] for r in part] == sorted(place[r["doc_id"]] for r in part)


def test_encoding(stages):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    docs, coded = rows(stages[4]), rows(stages[5])
    assert set(docs) == set(coded)
    for i, r in coded.items():
        assert list(r["ids"]) == library.encode(docs[i]["text"]) and r["n_pieces"] == len(r["ids"])


def test_run_is_the_stages(spark, stages):
    assert rows(corpus_pipeline.run(spark, SF)) == rows(stages[-1])


def test_run_is_in_the_order_of_the_mixture(spark, stages):
    want = mixing.mix_sources(stages[3]).orderBy("slot", "row_in_block").collect()
    got = corpus_pipeline.run(spark, SF).orderBy("place").collect()
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in want]
    assert [r["place"] for r in got] == list(range(len(want)))


def test_place_over_many_files(spark, tmp_path):
    path = str(tmp_path / "many")
    spark.range(0, 1000, 1, 13).write.option("maxRecordsPerFile", 30).parquet(path)
    placed = corpus_pipeline.with_place(spark.read.parquet(path)).collect()
    assert len(placed) == 1000 and all(r["place"] == r["id"] for r in placed)


def test_edges(spark, edge):
    docs = edge.select("doc_id", "text", "lang", "source", "n_chars")
    for start in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, start, SF).columns == docs.columns
            stage(spark, start, SF).collect()
        assert corpus_pipeline.encoding_stage(spark, start, SF).count() == start.count()
    copies = corpus_pipeline.near_copies_stage(spark, docs, SF).collect()
    assert sum(r["doc_id"] == 1 for r in copies) == 1 and not any(r["doc_id"] == 2 for r in copies)
    repeated = docs.where("doc_id = 5").union(docs.where("doc_id = 5"))
    assert corpus_pipeline.near_copies_stage(spark, repeated, SF).count() == 1


def test_rows_of_one_id(spark):
    """A row of a repeated id goes only if its own text is a copy."""
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    kept = lambda rows: sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.near_copies_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect())
    assert kept([(3, b), (7, b), (7, a)]) == [(3, b), (7, a)]
    assert kept([(3, b), (3, a), (7, a)]) == [(3, a), (3, b)]
    assert kept([(3, b), (3, b), (7, a), (7, a), (9, a)]) == [(3, b), (7, a)]
