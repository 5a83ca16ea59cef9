import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafmill.llm import langid, media, queries


def test_grams():
    assert not len(langid.fold("12 -- 3")) and not len(langid.fold(""))
    assert "".join(map(chr, langid.fold("Ab, c\n1É"))) == " ab c é "
    keys, counts = langid.grams(langid.fold("aa a"))
    found = {}
    for k, c in zip(keys.tolist(), counts.tolist(), strict=True):
        s = ""
        while k:
            s, k = chr(k & 0x1FFFFF) + s, k >> 21
        found[s] = c
    assert found == {"a": 3, " a": 2, "aa": 1, "a ": 2, " aa": 1, "aa ": 1, " a ": 1}


def test_held_out_accuracy(spark):
    rows = queries.op3_language_id(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "n_chars")
    got = rows.join(docs, "doc_id").where("held_out").collect()
    assert len(got) > 150 and all(0 <= r["score"] <= 1 for r in got)
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.97


def test_profiles_by_brute_force(spark):
    rows = [("x", "abc abd"), ("x", "abc"), ("y", "zzz"), ("y", None), (None, "qqq")]
    profiles = langid.learn_profiles(spark.createDataFrame(rows, "lang string, text string"), size=3)
    keys, ranks = profiles["x"]
    first = [k for _, k in sorted(zip(ranks.tolist(), keys.tolist(), strict=True))]
    pack = lambda s: sum(ord(c) << 21 * i for i, c in enumerate(reversed(s)))
    assert first == [pack("a"), pack("b"), pack(" a")] and set(profiles) == {"x", "y"}
    assert langid.nearest("zz", profiles, 3)[0] == "y" and langid.nearest("abd", profiles, 3)[0] == "x"


def test_language_edges(spark, edge):
    profiles = langid.learn_profiles(edge)
    got = langid.identify(edge.withColumn("score", F.lit("x")), profiles)
    rows = got.collect()
    assert len(rows) == 11 and got.columns.count("score") == 1
    for r in rows:
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))
    assert langid.learn_profiles(edge.limit(0)) == {}
    assert {r["lang_pred"] for r in langid.identify(edge, {}).collect()} == {"und"}


@pytest.mark.parametrize("compression", [media.NONE, media.PACKBITS, media.LZW, media.DEFLATE])
@pytest.mark.parametrize("tile", [0, 16])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff_round_trip(compression, tile, predictor, order):
    rng = np.random.default_rng(3)
    pages = [
        rng.integers(0, 256, (37, 41), np.uint8),
        np.repeat(rng.integers(0, 4, (50, 9, 3), np.uint16) * 20_000, 4, axis=1),
        np.zeros((130, 64), np.uint8),
    ]
    data = media.write_tiff(pages, compression, predictor, rows_per_strip=11, tile=tile, order=order)
    got = list(media.read_pages(data))
    assert len(got) == 3
    for a, b in zip(pages, got, strict=True):
        assert np.array_equal(a.reshape(b.shape), b)


def test_codecs():
    rng = np.random.default_rng(5)
    for data in (b"", b"a", b"aaaa", bytes(5000), rng.integers(0, 3, 20_000, np.uint8).tobytes(), rng.bytes(9000), b"ab" * 300 + b"c" * 300):
        assert media.unpack_bits(media.pack_bits(data)) == data
        assert media.lzw_decode(media.lzw_encode(data)) == data
    assert media.unpack_bits(bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")).hex() == "aaaaaa80002aaaaaaaaa80002a22" + "aa" * 10


def test_pages_of_a_table(spark):
    two = media.write_tiff([np.ones((2, 3), np.uint8), np.full((1, 1), 7, np.uint8)])
    broken = bytearray(two)
    broken[8:12] = b"\xff" * 4
    loop = bytearray(media.write_tiff([np.ones((2, 2), np.uint8)]))
    loop[-4:] = loop[4:8]
    rows = [(1, two), (2, None), (3, b"no tiff"), (4, bytes(broken)), (5, bytes(loop)), (6, b"")]
    df = spark.createDataFrame(rows, "page long, media binary").withColumnRenamed("page", "id")
    got = media.tiff_pages(df).orderBy("id", "page").collect()
    assert [(r["id"], r["page"], r["error"] is None) for r in got] == [(1, 0, True), (1, 1, True), (3, 0, False), (4, 0, False), (4, 1, True), (5, 0, True), (6, 0, False)]
    assert bytes(got[1]["samples"]) == b"\x07" and media.tiff_pages(df.limit(0)).count() == 0


def test_payloads_of_texts(spark, edge):
    stored = edge.select("text", media.store_text(F.col("text")).alias("media"))
    rows = media.tiff_pages(stored).collect()
    assert len(rows) == 11
    for r in rows:
        data = (r["text"] or "").encode()
        data += bytes(-len(data) % 64 or (0 if data else 64))
        assert bytes(r["samples"]) == data and r["error"] is None
    got = queries.op5_tiff_pages(spark, "/root/testdata/sf0.001").collect()
    texts = dict(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect())
    assert len(got) == len(texts)
    for r in got:
        data = texts[r["doc_id"]].encode()
        assert r["n_bytes"] == len(data)
        data += bytes(-len(data) % 64)
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))


def tiff(tags, body=b"", order="<"):
    """A file of one page, written out by hand: fields of 32-bit values, in order."""
    fields = b"".join(struct.pack(order + "HHII", tag, 4, 1, value) for tag, value in sorted(tags.items()))
    head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8 + len(body))
    return head + body + struct.pack(order + "H", len(tags)) + fields + bytes(4)


def test_outside_vectors():
    """The worked examples of the published format: LZW codes, PackBits bytes, and a tile by hand."""
    codes, bits = [256, 7, 258, 8, 8, 258, 6, 6, 257], ""
    bits = "".join(f"{c:09b}" for c in codes)
    data = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    want = bytes((7, 7, 7, 8, 8, 7, 7, 6, 6))
    assert media.lzw_decode(data) == want and media.lzw_encode(want) == data
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    page = tiff({256: 24, 257: 1, 258: 8, 259: 32773, 262: 1, 273: 8, 278: 1, 279: len(packed)}, packed, ">")
    (got,) = media.read_pages(page)
    assert got.tobytes().hex() == "aaaaaa80002aaaaaaaaa80002a22" + "aa" * 10
    tile = bytes(range(256))
    page = tiff({256: 3, 257: 2, 258: 8, 259: 1, 262: 1, 317: 1, 322: 16, 323: 16, 324: 8, 325: 256}, tile)
    (got,) = media.read_pages(page)
    assert got[:, :, 0].tolist() == [[0, 1, 2], [16, 17, 18]]
    page = tiff({256: 5, 257: 2, 258: 1, 259: 1, 262: 1, 273: 8, 278: 2, 279: 2}, b"\xa8\x40")
    (got,) = media.read_pages(page)
    assert got[:, :, 0].tolist() == [[1, 0, 1, 0, 1], [0, 1, 0, 0, 0]]
    page = tiff({256: 3, 257: 1, 258: 4, 259: 1, 262: 1, 273: 8, 278: 1, 279: 2}, b"\x1f\x70")
    (got,) = media.read_pages(page)
    assert got.ravel().tolist() == [1, 15, 7]


def test_hostile_headers(spark):
    """A page that can't be read gives a row with an error, whatever its header says."""
    whole = {256: 4, 257: 2, 258: 8, 259: 1, 262: 1, 273: 8, 278: 2, 279: 8}
    tiles = {256: 4, 257: 2, 258: 8, 259: 1, 262: 1, 322: 16, 323: 16, 324: 8, 325: 8}
    bomb = zlib.compress(bytes(1 << 24))
    files = [
        tiff(whole | {278: 0}, bytes(8)), tiff(whole | {257: 0}, bytes(8)), tiff(whole | {256: 0}, bytes(8)), tiff(whole | {256: 2**31}, bytes(8)),
        tiff(whole | {256: 2**32 - 1, 257: 2**32 - 1}, bytes(8)), tiff(whole | {273: 2**31}, bytes(8)), tiff(whole | {277: 0}, bytes(8)), tiff(whole | {258: 7}, bytes(8)),
        tiff(whole | {279: 2}, bytes(8)), tiff(tiles | {322: 0}, bytes(8)), tiff(tiles | {323: 2**20, 322: 2**20}, bytes(8)), tiff(whole | {259: 5}, b"\xff" * 8),
        tiff(whole | {259: 8}, b"\xff" * 8), tiff(whole | {317: 3}, bytes(8)), tiff(whole | {258: 4, 317: 2}, bytes(8)), tiff({256: 4, 257: 2}, b""),
    ]
    rows = spark.createDataFrame([(i, f) for i, f in enumerate(files)] + [(99, tiff(whole | {259: 8, 279: len(bomb)}, bomb))], "id long, media binary")
    got = {r["id"]: r for r in media.tiff_pages(rows).collect()}
    assert len(got) == len(files) + 1 and all(got[i]["error"] and got[i]["samples"] is None for i in range(len(files)))
    assert bytes(got[99]["samples"]) == bytes(8) and len(media.inflate(bomb, 100)) == 100
    fuzz = np.random.default_rng(8)
    good = media.write_tiff([fuzz.integers(0, 256, (20, 20), np.uint8)] * 2, media.LZW, 2, tile=16)
    for _ in range(300):
        bad = bytearray(good)
        for at in fuzz.integers(0, len(bad), 3).tolist():
            bad[at] = int(fuzz.integers(0, 256))
        assert all(isinstance(p, (np.ndarray, Exception)) for p in media.read_pages(bytes(bad)))


def test_stored_forms(spark):
    """The query's stored forms: one for equal texts, and every compression, predictor, layout, order and number of pages among them."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    forms, seen = set(), {}
    for r in docs.select("text", media.store_text(F.col("text"), varied=True).alias("media")).collect():
        data, order = bytes(r["media"]), "<" if r["media"][:2] == b"II" else ">"
        assert seen.setdefault(r["text"], data) == data
        tags, following = media._directory(data, struct.unpack_from(order + "I", data, 4)[0], order)
        forms |= {("order", order), ("compression", tags[259][0]), ("predictor", tags[317][0]), ("tiled", 324 in tags), ("pages", 1 + bool(following))}
        pages = list(media.read_pages(data))
        text = r["text"].encode() + bytes(-len(r["text"].encode()) % 64)
        assert pages[0].tobytes() == text and (len(pages) == 1 or pages[1].tobytes() == text[-64:])
    assert len(forms) == 2 + 4 + 2 + 2 + 2
    made = {r["doc_id"]: r for r in queries.op5_tiff_pages(spark, "/root/testdata/sf0.001").collect()}
    for r in docs.collect():
        payload, got = r["text"].encode() + bytes(-len(r["text"].encode()) % 64), made[r["doc_id"]]
        assert (got["media_bytes"], got["media_sha256"]) == (len(seen[r["text"]]), hashlib.sha256(seen[r["text"]]).hexdigest())
        assert got["feature"] == f"64x{len(payload) // 64}x1 sum={sum(payload)} distinct={len(set(payload))} max={max(payload)}"


def shared_strip(page, directories):
    """A TIFF whose directories all name one strip."""
    data = bytearray(media.write_tiff([page]))
    (at,) = struct.unpack_from("<I", data, 4)
    entries = data[at : at + 2 + 12 * struct.unpack_from("<H", data, at)[0]]
    link = at + len(entries)
    for _ in range(directories - 1):
        struct.pack_into("<I", data, link, len(data))
        link = len(data) + len(entries)
        data += entries + bytes(4)
    return bytes(data)


def test_directories_that_share_a_strip_are_handed_on_in_bounded_batches(spark, monkeypatch):
    page = np.zeros((1000, 1000), np.uint8)
    stored = shared_strip(page, 20)
    assert len(stored) < 20_000
    given = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([stored, None, b"x"], pa.binary())], ["id", "media"])
    monkeypatch.setattr(media, "HELD", 3_000_000)
    batches = list(media._page_batches(iter([given]), 1))
    assert max(sum(len(x or b"") for x in b.column("samples").to_pylist()) for b in batches) <= 4_000_000
    rows = [r for b in batches for r in b.to_pylist()]
    assert [(r["id"], r["page"], r["pages"]) for r in rows] == [(1, i, 20) for i in range(20)] + [(3, 0, 1)]
    assert all(r["samples"] == page.tobytes() for r in rows[:20]) and "not a TIFF" in rows[20]["error"]
    monkeypatch.setattr(media, "MAX_FILE", 5_000_000)
    rows = list(media._rows(stored))
    assert [r[-1] is None for r in rows] == [True] * 5 + [False] * 15
    got = media.tiff_pages(spark.createDataFrame([(1, stored), (2, None)], "id int, media binary")).groupBy("id").count().collect()
    assert [tuple(r) for r in got] == [(1, 20)]
