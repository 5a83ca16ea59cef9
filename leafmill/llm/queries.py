"""Queries of the operators over the driver's tables, and SQL where DuckDB can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import importance, jaccard, langid, media, mixing, packing, pieces, quality, search, secrets, sharding, suffixes, toxicity
from leafmill.llm.common import documents, materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_rules(documents(spark, sf_dir), keep_text=False)
    return out.select("doc_id", *quality.COUNTS, "base_failed", "kept", "host_rejected")


QUERIES["op4_quality_rules"] = op4_quality_rules
ORACLES["op4_quality_rules"] = r"""
WITH d AS (SELECT row_number() OVER () rid, doc_id, source, coalesce(text, '') t FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') w FROM d),
g AS (SELECT rid, i, struct_pack(a := w[i], b := w[i+1], c := w[i+2], d := w[i+3], e := w[i+4]) g
      FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) i FROM w WHERE len(w) >= 5)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) c FROM g) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT p) n FROM (SELECT rid, unnest(range(i, i + 5)) p FROM r) GROUP BY rid),
ln AS (SELECT rid, count(*) - count(DISTINCT l) n FROM (SELECT rid, unnest(string_split(t, chr(10))) l FROM d)
       WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
c AS (SELECT d.doc_id, d.source, CAST(len(w.w) AS BIGINT) n_words,
             CAST(length(array_to_string(w.w, '')) AS BIGINT) word_chars,
             CAST(len(regexp_extract_all(d.t, '[#*$%&|<>]')) AS BIGINT) n_symbols,
             CAST(coalesce(ln.n, 0) AS BIGINT) n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) n_repeat_words
      FROM d JOIN w USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN ln USING (rid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words base_failed FROM c),
f AS (SELECT *, base_failed OR 2 * n_symbols > n_words OR n_dup_lines >= 5 failed FROM b),
h AS (SELECT source, count(*) n, count(*) FILTER (failed) f FROM f WHERE source IS NOT NULL GROUP BY source),
s AS (SELECT count(*) k, sum(n) n, sum(f) / sum(n) m, sum(f * f / n) / sum(n) ff FROM h),
v AS (SELECT m, ff - m * m - m * (1 - m) * k / n spread FROM s),
p AS (SELECT m, CASE WHEN spread > 0 THEN least(greatest(m * (1 - m) / spread - 1, 1.0), 1e6) ELSE 1e6 END c FROM v),
bad AS (SELECT source FROM h, p WHERE (f + m * c) / (n + c) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND bad.source IS NULL kept, bad.source IS NOT NULL host_rejected
FROM b LEFT JOIN bad ON b.source = bad.source
"""


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir).select("doc_id", "source"))


QUERIES["op1_mix_sources"] = op1_mix_sources
ORACLES["op1_mix_sources"] = """
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce('=' || source, '') s, md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')) h FROM documents),
r AS (SELECT doc_id, source, s, row_number() OVER (PARTITION BY s ORDER BY h) - 1 r FROM d),
c AS (SELECT s, row_number() OVER (ORDER BY s) i, count(*) n, (count(*) + 7) // 8 b FROM d GROUP BY s),
t AS (SELECT greatest(512, 4 * count(*)) units, count(*) m, fsum(sqrt(n)) w FROM c),
x AS (SELECT s, i, b, sqrt(n) / w * (units - m) e, units FROM c, t),
u AS (SELECT s, i, b, CAST(1 + floor(e) + CASE WHEN row_number() OVER (ORDER BY floor(e) - e, s) <= units - sum(1 + floor(e)) OVER () THEN 1 ELSE 0 END AS BIGINT) a FROM x),
f AS (SELECT 0::BIGINT f UNION SELECT b // a FROM u UNION SELECT (b + a - 1) // a FROM u),
g AS (SELECT f, i, a, greatest(0, least(a, b - f * a)) q, least(b, f * a) past FROM f, u),
k AS (SELECT f, CAST(sum(q) AS BIGINT) total, CAST(sum(past) AS BIGINT) past, list(0::BIGINT) zeros FROM g GROUP BY f HAVING sum(q) > 0),
v AS (SELECT f, i, a, q, unnest(range(0, q)) j FROM g JOIN k USING (f)),
w AS (SELECT v.f, v.i, v.j, CAST(sum(least(g.a * v.j, g.q * v.a)) // v.a AS BIGINT) release,
        CAST((sum(least(g.a * (v.j + 1), g.q * v.a)) + v.a - 1) // v.a AS BIGINT) due FROM v JOIN g ON g.f = v.f GROUP BY v.f, v.i, v.j, v.a),
l AS (SELECT f, i, list(release ORDER BY j) releases, list(due ORDER BY j) dues FROM w GROUP BY f, i),
z AS (SELECT f, list(releases ORDER BY i) releases, list(dues ORDER BY i) dues, list(i ORDER BY i) names FROM l GROUP BY f),
e AS (SELECT f, 0::BIGINT AS spot, zeros AS done, 0::BIGINT AS pick FROM (SELECT f, list_transform(names, lambda y: 0::BIGINT) AS zeros FROM z)
  UNION ALL SELECT f, spot + 1, list_transform(done, lambda y, i: y + CASE WHEN i = p THEN 1 ELSE 0 END), p FROM (
    SELECT e.f, e.spot, e.done, list_min(list_filter(list_transform(z.releases, lambda y, i: CASE WHEN e.done[i] < len(y) AND y[e.done[i] + 1] <= e.spot
      THEN z.dues[i][e.done[i] + 1] * 100000 + i END), lambda y: y IS NOT NULL)) % 100000 p FROM e JOIN z ON z.f = e.f JOIN k ON k.f = e.f WHERE e.spot < k.total)),
o AS (SELECT e.f, z.names[pick] i, done[pick] - 1 j, spot - 1 AS spot FROM e JOIN z ON z.f = e.f WHERE spot > 0),
y AS (SELECT doc_id, source, u.i, u.a, r // 8 block, r % 8 row_in_block, (r // 8) // u.a rnd, (r // 8) % u.a j,
        (SELECT max(k.f) FROM k WHERE k.f <= (r // 8) // u.a) f FROM r JOIN u USING (s))
SELECT doc_id, source, CAST(a AS INTEGER) weight_units, block, k.past + (rnd - k.f) * k.total + o.spot slot, k.past + (rnd - k.f) * k.total + w.release release,
  k.past + (rnd - k.f) * k.total + w.due deadline, CAST(row_in_block AS INTEGER) row_in_block
FROM y JOIN k ON k.f = y.f JOIN o ON o.f = y.f AND o.i = y.i AND o.j = y.j JOIN w ON w.f = y.f AND w.i = y.i AND w.j = y.j
"""


def op8_shard_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = documents(spark, sf_dir).select(
        "doc_id",
        "source",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    rows = materialize(rows, "sizes")  # of the texts, only these are read again
    out = sharding.assign_shards(rows, 24, tie=("size", "text_crc32"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


QUERIES["op8_shard_stratified"] = op8_shard_stratified
ORACLES["op8_shard_stratified"] = """
WITH m AS (SELECT list(v ORDER BY i) m FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) v FROM range(256) q(i))),
b AS (SELECT doc_id, source, CAST(strlen(coalesce(text, '')) + 8 AS BIGINT) size, hex(encode(coalesce(text, ''))) hx, md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')) h FROM documents),
y AS (SELECT *, list_transform(regexp_extract_all(hx, '..'), lambda p: CAST((strpos('0123456789ABCDEF', p[1]) - 1) * 16 + strpos('0123456789ABCDEF', p[2]) - 1 AS BIGINT)) bytes FROM b),
d AS (SELECT doc_id, source, size, h, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, v: xor(c >> 8, m[CAST(xor(c, v) % 256 AS INTEGER) + 1])), 4294967295::BIGINT) crc FROM y, m),
r AS (SELECT *, coalesce('=' || source, '') s, (2 * row_number() OVER (PARTITION BY source ORDER BY h, size, crc) - 1) / (2 * count(*) OVER (PARTITION BY source)) frac FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY frac, h, s, size, crc) - 1 p, count(*) OVER () n FROM r)
SELECT doc_id, size, CAST(crc AS BIGINT) text_crc32, 'rows' law, CAST(p * 24 // n AS INTEGER) shard, CAST(p - (p * 24 // n * n + 23) // 24 AS BIGINT) slot, CAST(NULL AS INTEGER) grown_shard FROM p
"""


def _part(key: str, of: int):
    """crc32 of the id as text (null: of no bytes), modulo ``of``."""
    return F.crc32(F.encode(F.coalesce(F.col(key).cast("string"), F.lit("")), "UTF-8")) % of


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    profiles = langid.learn_profiles(docs.where(_part("doc_id", 4) != 2))
    found = langid.identify(docs.select("doc_id", "text"), profiles)
    return found.select("doc_id", (_part("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


QUERIES["op3_language_id"] = op3_language_id
ORACLES["op3_language_id"] = r"""
WITH m AS (SELECT list(v ORDER BY i) m FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) v FROM range(256) q(i))),
d AS (SELECT row_number() OVER () rid, doc_id, lang, text, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda c, v: xor(c >> 8, m[CAST(xor(c, v) % 256 AS INTEGER) + 1])), 4294967295::BIGINT) % 4 part FROM documents, m),
l AS (SELECT rid, lang, text IS NOT NULL AND lang IS NOT NULL AND part <> 2 AS learned, ' ' || lower(array_to_string(regexp_extract_all(text, '\p{L}+'), ' ')) || ' ' AS line FROM d WHERE regexp_matches(text, '\p{L}')),
p AS (SELECT rid, lang, learned, line, unnest(range(1, length(line) + 1)) i FROM l),
g AS (SELECT rid, lang, learned, substr(line, i, 1) gram FROM p WHERE substr(line, i, 1) <> ' '
  UNION ALL SELECT rid, lang, learned, substr(line, i, 2) FROM p WHERE i < length(line)
  UNION ALL SELECT rid, lang, learned, substr(line, i, 3) FROM p WHERE i < length(line) - 1 AND substr(line, i + 1, 1) <> ' '),
c AS (SELECT rid, lang, learned, gram, count(*) n FROM g GROUP BY ALL),
f AS (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY n DESC, length(gram), gram) - 1 place FROM (SELECT lang, gram, sum(n) n FROM c WHERE learned GROUP BY ALL) QUALIFY place < 400),
o AS (SELECT rid, gram, row_number() OVER (PARTITION BY rid ORDER BY n DESC, length(gram), gram) - 1 place FROM c QUALIFY place < 400),
n AS (SELECT rid, count(*) k FROM o GROUP BY rid),
h AS (SELECT rid, f.lang, sum(400 - least(abs(f.place - o.place), 400)) saved FROM o JOIN f USING (gram) GROUP BY ALL),
t AS (SELECT rid, k, x.lang, 400 * k - coalesce(saved, 0) dist FROM n CROSS JOIN (SELECT DISTINCT lang FROM f) x LEFT JOIN h USING (rid, lang)),
b AS (SELECT rid, lang, 1 - CAST(dist AS DOUBLE) / CAST(400 * k AS DOUBLE) score FROM t QUALIFY row_number() OVER (PARTITION BY rid ORDER BY dist, lang) = 1)
SELECT doc_id, part = 2 held_out, coalesce(b.lang, 'und') lang_pred, coalesce(score, 0.0::DOUBLE) score FROM d LEFT JOIN b USING (rid)
"""


def op5_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    stored = documents(spark, sf_dir).select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), media.store_text(F.col("text"), varied=True).alias("media"))
    pages = media.tiff_pages(stored).where("page = 0")  # the payload; the last line may follow as a page of its own
    return pages.select(
        "doc_id",
        "n_bytes",
        F.octet_length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring(F.col("samples"), F.octet_length("samples") - 63, F.lit(64))).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        "pages",
    )


QUERIES["op5_tiff_pages"] = op5_tiff_pages


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir))
    return found.select("doc_id", "ordinal", F.sha2("candidate", 256).alias("candidate_sha256"), F.col("length").cast("int"), "score", "is_secret")


QUERIES["op10_secret_scan"] = op10_secret_scan


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(labels.where(_part("doc_id", 5) != 0), docs)
    out = toxicity.score_toxicity(docs, model)
    return out.select("doc_id", (_part("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "evidence", "cosines")


QUERIES["op9_toxicity"] = op9_toxicity


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))


QUERIES["op7_jaccard_join"] = op7_jaccard_join
ORACLES["op7_jaccard_join"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) END) g FROM d),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id x, b.doc_id y, count(*) c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) n_shingles, least(d.doc_id, m.y) component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x, min(y) y FROM r GROUP BY x) m ON m.x = d.doc_id
"""


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = pieces.load_model()
    coded = pieces.decode(pieces.encode(documents(spark, sf_dir).select("doc_id", "text"), model), model)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


QUERIES["op6_sentencepiece"] = op6_sentencepiece


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"), with_kept=False)


QUERIES["op2_suffix_dedup"] = op2_suffix_dedup
ORACLES["op2_suffix_dedup"] = """
WITH d AS (SELECT row_number() OVER () rid, doc_id, hex(encode(coalesce(text, ''))) hx FROM documents),
p AS (SELECT rid, i, md5_number(substr(hx, 2 * i + 1, 400)) h FROM (SELECT rid, hx, unnest(range(0, length(hx) // 2 - 199)) i FROM d WHERE length(hx) >= 400)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY h) c FROM p) WHERE c > 1),
s AS (SELECT rid, i, CASE WHEN i <= lag(i) OVER (PARTITION BY rid ORDER BY i) + 200 THEN 0 ELSE 1 END new FROM r),
g AS (SELECT rid, i, sum(new) OVER (PARTITION BY rid ORDER BY i) k FROM s),
u AS (SELECT rid, min(i) b, max(i) + 200 e FROM g GROUP BY rid, k),
v AS (SELECT rid, b, e, lag(e, 1, 0) OVER (PARTITION BY rid ORDER BY b) before FROM u),
k AS (SELECT rid, string_agg(substr(hx, 2 * before + 1, 2 * (b - before)), '' ORDER BY b) head, max(e) tail, sum(e - b) removed, count(*) n FROM v JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, CAST(length(hx) // 2 AS BIGINT) n_bytes, CAST(coalesce(removed, 0) AS BIGINT) n_removed, CAST(coalesce(n, 0) AS BIGINT) n_spans,
  sha256(unhex(coalesce(head, '') || substr(hx, 2 * coalesce(tail, 0) + 1))) kept_sha256
FROM d LEFT JOIN k USING (rid)
"""


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = importance.importance(documents(spark, sf_dir).select("doc_id", "text"), target)
    return out.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES["op13_importance_resampling"] = op13_importance_resampling
ORACLES["op13_importance_resampling"] = r"""
WITH m AS (SELECT list(v ORDER BY i) m FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) v FROM range(256) q(i))),
t AS (SELECT row_number() OVER () rid, doc_id, text, 0 k FROM documents UNION ALL SELECT -row_number() OVER (), NULL, text, 1 FROM benchmark),
w AS (SELECT rid, doc_id, k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM t),
f AS (SELECT rid, k, unnest(w) f FROM w UNION ALL SELECT rid, k, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w),
g AS (SELECT rid, k, f, count(*) n FROM f GROUP BY ALL),
h AS (SELECT f, hex(encode(f)) hx FROM (SELECT DISTINCT f FROM g)),
b AS (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hx, '..'), lambda p: CAST((strpos('0123456789ABCDEF', p[1]) - 1) * 16 + strpos('0123456789ABCDEF', p[2]) - 1 AS BIGINT))),
  lambda c, v: xor(c >> 8, m[CAST(xor(c, v) % 256 AS INTEGER) + 1])), 4294967295::BIGINT) % 10000 b FROM h, m),
c AS (SELECT b, coalesce(sum(n) FILTER (k = 0), 0) s, coalesce(sum(n) FILTER (k = 1), 0) t FROM g JOIN b USING (f) GROUP BY b),
z AS (SELECT coalesce(sum(s), 0) s, coalesce(sum(t), 0) t FROM c),
a AS (SELECT b, CAST(floor(1000 * ln(((c.t + 1)::DOUBLE * (z.s + 10000)::DOUBLE) / ((c.s + 1)::DOUBLE * (z.t + 10000)::DOUBLE))) AS BIGINT) gain FROM c, z),
v AS (SELECT rid, CAST(sum(n) AS BIGINT) n, CAST(sum(n * gain) AS BIGINT) total FROM g JOIN b USING (f) JOIN a USING (b) WHERE k = 0 GROUP BY rid),
x AS (SELECT doc_id, len(w) words, coalesce(v.n, 0) n_features, CASE WHEN v.n IS NULL THEN 0 ELSE (total - ((total % n) + n) % n) // n END weight, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) hx FROM w LEFT JOIN v USING (rid) WHERE k = 0),
y AS (SELECT doc_id, words, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(hx, 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) score FROM x),
r AS (SELECT *, words >= 20 able, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) r, count(*) OVER (PARTITION BY words >= 20) n FROM y)
SELECT doc_id, CAST(n_features AS BIGINT) n_features, CAST(weight AS BIGINT) weight, CAST(score AS BIGINT) score, CASE WHEN able AND r <= 25 * n // 100 THEN CAST(r AS BIGINT) END "rank" FROM r
"""


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES["op11_lexical_search"] = op11_lexical_search
ORACLES["op11_lexical_search"] = r"""
WITH d AS (SELECT row_number() OVER () rid, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) t FROM documents),
p AS (SELECT rid, any_value(doc_id) doc_id, t, count(*) tf FROM d GROUP BY rid, t),
l AS (SELECT rid, CAST(sum(tf) AS BIGINT) n FROM p GROUP BY rid),
s AS (SELECT count(*) n, CAST(sum(n) AS BIGINT) l FROM l),
w AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(s.n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) w FROM p, s GROUP BY t),
q AS (SELECT DISTINCT i, item_id, t FROM (SELECT row_number() OVER () i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) t FROM benchmark)),
c AS (SELECT i, item_id, rid, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * l.n * s.n) // s.l)))) AS BIGINT) score
      FROM q JOIN w USING (t) JOIN p USING (t) JOIN l USING (rid), s GROUP BY i, item_id, rid, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) "rank", doc_id, score FROM c WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) <= 10
"""


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = documents(spark, sf_dir).select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", *packing.MADE)


QUERIES["op12_packing"] = op12_packing
