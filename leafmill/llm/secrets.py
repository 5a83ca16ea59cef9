"""Secret scans whose false positives a random forest removes. Native: DataFrame and Spark ML functions only.

A candidate is a maximal run of at least 16 characters that keys and tokens are made of. Where a run
begins with ``name=``, as in an .env file or an address, and 16 characters or more follow, the
candidate is what follows, and the name stands before it. A forest, trained from labelled findings,
reads its length, its transitions between kinds of characters, how much of it words of the corpus
cover, how it begins, the path it was found in, and the words beside it.

A candidate may be as long as its text, an embedded file say: all its features take time in proportion
to its length. Null and empty texts have no candidates; a null path has no path marks. Candidates are numbered in
their text from 0, so repeated rows give repeated findings. Empty tables give empty results. Labelled
rows without a candidate or a label are passed over; where all labels are one, it is the score of every
candidate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import free_name, join_checked, let, materialize

CANDIDATE = r"[A-Za-z0-9+/=_\-]{16,}"
#: The name at the head of a run. Its parts are shorter than the shortest candidate, so no key is taken for a name.
NAME = r"^([A-Za-z][A-Za-z0-9]{0,14}(?:[_\-]+[A-Za-z0-9]{1,15})*[_\-]*=)[^=].{15}"
#: Characters of the surroundings that are read on either side.
BESIDE = 48
#: A word of the dictionary makes up this share of the words at least. So there are at most 200,000, a bound on what is broadcast.
DICTIONARY_SHARE = 5e-6
#: Letters of a candidate that are looked up together (more only if a word of the dictionary is longer).
PART = 256
FEATURES = (
    "length", "digits", "uppers", "symbols", "changes", "letter_runs", "vowels", "distinct", "coverage",
    "odd_path", "named", "assigned", "quoted", "benign", "issued", "filler",
)
#: Components of paths that seldom hold live secrets, and words beside a candidate that speak for or against it.
ODD_PATH = r"(?i)(^|[/\\._-])(tests?|examples?|samples?|mocks?|fixtures?|docs?)([/\\._-]|$)"
NAMED = r"(?i)(token|secret|passw|pwd|api.?key|access.?key|private.?key|auth|bearer|credential|[?&]key|\bkey(?==))[a-z_\-]*\W{0,6}$"
ASSIGNED = r"[=:]\s*[\"'`]?$"
BENIGN = r"(?i)(commit|revision|checksum|sha-?\d*|md5|digest|hash|uuid|guid|etag|example|placeholder|dummy)\W{0,6}$"


#: Heads of keys that well-known issuers give out, and marks of values that stand for a key.
ISSUED = r"^(AKIA|ASIA|AIza|gh[pousr]_|github_pat_|glpat-|sk-|sk_live_|rk_live_|xox[abprs]-|ya29|npm_|pypi-|hf_|eyJ)[A-Za-z0-9+/=_\-]{12,}$"
FILLER = r"(?i)x{6}|0{6}|1234567|abcdab|example|dummy|change.?me|your.?(key|token|secret|pass)|goes.?here|placeholder"


def _name(run: Column) -> Column:
    """The ``name=`` that a run begins with, empty where it has none."""
    return F.regexp_extract(run, NAME, 1)


def candidates(df: DataFrame, text: str = "text", path: str = "source", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(kept columns, path, ordinal, candidate, before, after) of each candidate of the whole text."""
    body = F.coalesce(F.col(text), F.lit(""))
    found = let(
        F.split(body, CANDIDATE),
        lambda gaps: F.transform(
            F.regexp_extract_all(body, F.lit(CANDIDATE), F.lit(0)),
            lambda c, k: F.struct(
                k.alias("ordinal"),
                F.substr(c, F.length(_name(c)) + 1).alias("candidate"),
                F.right(F.concat(F.get(gaps, k), _name(c)), F.lit(BESIDE)).alias("before"),
                F.left(F.get(gaps, k + 1), F.lit(BESIDE)).alias("after"),
            ),
        ),
    )
    some = df.where(F.col(text).rlike(CANDIDATE))
    return some.select(*keep, F.col(path).cast("string").alias("path"), F.inline(found))


def dictionary(df: DataFrame, text: str = "text", share: float = DICTIONARY_SHARE) -> DataFrame:
    """The lower-case words, of three letters or more, that make up at least ``share`` of all words of the texts.

    Letters that stand among the other characters of keys are no words, lest keys cover themselves.
    """
    found = df.select(F.explode(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^a-z0-9+/=_\-]+")).alias("word"))
    counts = found.where(F.col("word").rlike("^[a-z]{3,}$")).groupBy("word").agg(F.count("*").alias("n"))
    counts = materialize(counts, "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.where(F.col("n") >= share * total).select("word")


def _parts(each: DataFrame, longest: int) -> DataFrame:
    """(id, text, first, last): the letter runs of candidates, cut into parts of PART letters (from first to last), with what a word may reach over on either side.

    Two passes of one pattern cut a run, so the cost is in proportion to its length.
    """
    reach = longest - 1
    size = max(PART, reach)
    cut = F.lit(f"(.{{1,{size}}})(?=(.{{0,{reach}}}))")
    runs = each.select("id", F.explode(F.regexp_extract_all(F.lower("candidate"), F.lit("[a-z]{3,}"), F.lit(0))).alias("run"))
    cuts = runs.select("id", F.regexp_extract_all("run", cut, F.lit(1)).alias("owns"), F.regexp_extract_all("run", cut, F.lit(2)).alias("afters"))

    def part(own: Column, i: Column) -> Column:
        before = F.when(i > 0, F.right(F.get("owns", i - 1), F.lit(reach))).otherwise(F.lit(""))
        return F.struct(before.alias("before"), own.alias("own"), F.get("afters", i).alias("after"))

    parts = cuts.select("id", F.inline(F.transform("owns", part)))
    first = F.length("before") + 1
    return parts.select("id", F.concat("before", "own", "after").alias("text"), first.alias("first"), (first + F.length("own") - 1).alias("last"))


def _with_coverage(found: DataFrame, words: DataFrame) -> DataFrame:
    """Adds ``coverage``: the share of a candidate's characters that lie in dictionary words.

    Distinct candidates are numbered; what is exploded carries a number and a part of bounded length,
    never a candidate, and the parts of a long one are dealt out.
    """
    sizes = sorted(r[0] for r in words.select(F.length("word")).distinct().collect())
    each = materialize(found.select("candidate").distinct().withColumn("id", F.monotonically_increasing_id()), "distinct")
    parts = _parts(each, max(sizes, default=1)).repartition("id", "text", "first")
    parts = materialize(parts.withColumn("part", F.monotonically_increasing_id()), "parts")
    starts = F.when(F.length("text") > 2, F.sequence(F.lit(1), F.length("text") - 2))
    spans = parts.select("id", "part", "first", "last", "text", F.explode(starts).alias("at"))
    spans = spans.withColumn("size", F.explode(F.array(*map(F.lit, sizes)).cast("array<int>"))).where(F.col("at") + F.col("size") <= F.length("text") + 1)
    spans = spans.withColumn("word", F.substr("text", F.col("at"), F.col("size"))).drop("text")
    hits = spans.join(F.broadcast(words), "word").groupBy("id", "part", "first", "last", "at").agg(F.max("size").alias("size"))
    start, stop = F.greatest("at", "first"), F.least(F.col("at") + F.col("size") - 1, F.col("last"))
    own = hits.where(start <= stop).groupBy("id", "part").agg(F.size(F.array_distinct(F.flatten(F.collect_list(F.sequence(start, stop))))).alias("n"))
    shares = own.groupBy("id").agg(F.sum("n").alias("n")).join(each, "id").select("candidate", (F.col("n") / F.length("candidate")).alias("coverage"))
    # As a table of distinct candidates, which is broadcast if small, and else joined so that a hot candidate is split.
    out = join_checked(found, materialize(shares, "coverage"), ["candidate"], "left")
    return out.withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))


def _share(pattern: str) -> Column:
    return F.regexp_count("candidate", F.lit(pattern)) / F.length("candidate")


def features(found: DataFrame, words: DataFrame) -> DataFrame:
    """Adds the columns of FEATURES."""
    change = r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])"
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return _with_coverage(found, words).withColumns(
        {
            "length": F.length("candidate").cast("double"),
            "digits": _share("[0-9]"),
            "uppers": _share("[A-Z]"),
            "symbols": _share("[^A-Za-z0-9]"),
            "changes": _share(change),
            "letter_runs": _share("[A-Za-z]{4,}"),
            "vowels": _share("[aeiouAEIOU]"),
            "distinct": F.size(F.array_distinct(F.split("candidate", ""))) / F.length("candidate"),
            "odd_path": flag(F.col("path").rlike(ODD_PATH)),
            "named": flag(F.col("before").rlike(NAMED)),
            "assigned": flag(F.col("before").rlike(ASSIGNED)),
            "quoted": flag(F.col("before").rlike("[\"'`]$") & F.col("after").rlike("^[\"'`]")),
            "benign": flag(F.col("before").rlike(BENIGN)),
            "issued": flag(F.col("candidate").rlike(ISSUED)),
            "filler": flag(F.col("candidate").rlike(FILLER)),
        }
    )


def labelled_findings(spark: SparkSession, rows: int = 4000) -> DataFrame:
    """Made-up findings with labels, for want of a labelled table: (path, before, candidate, after, label).

    Values are put into texts, and ``candidates`` finds them there, so that each row is split as those
    of a scan are. Live secrets are random keys behind a telling name (quoted, bare, in an address or
    a header), and without a name those of known issuers and mixed ones in prose. The others are long
    words and numbers in prose, named digests, paths, identifiers of tests, and placeholders; words,
    paths and placeholders also stand behind telling names, in ordinary paths. In paths of tests and
    documentation, keys of known issuers and random keys behind telling names are live too; digests
    there, and mixed keys without a name, are identifiers of tests.
    """
    i = F.col("id")
    bits = F.sha2(F.concat(F.lit("finding"), i.cast("string")), 512)
    of = lambda values, salt: F.get(F.array(*map(F.lit, values)), F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(len(values))).cast("int"))
    syllables = ("tion", "ing", "the", "er", "on", "ment", "eau", "sch", "ung", "cion", "que", "lich", "ver", "an", "en", "ado", "elle", "st", "re", "heit")
    word = F.concat(*[of(syllables, k) for k in range(7)], F.lit("heitung"))
    base64 = F.substring(F.base64(F.unhex(bits)), 1, 40)
    lead = of(("the of it ", "\n", "und der ", "config ", ""), "lead")
    name = of(("token", "secret", "password", "api_key", "apikey", "access_key", "auth_token", "TOKEN", "SECRET_KEY", "client_secret"), "name")
    # What stands before and after a value.
    quoted = F.concat(lead, name, of((' = "', ": '", '="', ' := "'), "assign")), of(('"', "'", '" '), "end")
    bare = F.concat(lead, of(("", "export ", "set "), "env"), F.upper(name), of(("=", " = ", ": "), "assign")), of(("\n", "", " and"), "end")
    address = F.concat(lead, F.lit("https://a.io/v1"), of(("?key=", "?api_key=", "?q=1&key=", "?token=", "&access_token=", "?auth="), "url")), of(("&n=1", "", " "), "end")
    header = F.concat(lead, of(("Authorization: Bearer ", "authorization: bearer ", "-H 'Authorization: Bearer ", "X-Auth-Token: "), "head")), of(("\n", "'", ""), "end")
    named = tuple(F.get(F.array(quoted[k], bare[k], address[k], header[k]), F.pmod(F.xxhash64(i, F.lit("way")), F.lit(4)).cast("int")) for k in (0, 1))
    prose = F.concat(of(("the thing of ", "de la ", "and, ", "oder die ", "\n", "so. ", ""), "prose"), of(syllables, "p"), F.lit(" ")), of((" and", ", ", ". ", "\n", ""), "end")
    digest = F.concat(of(("at ", "see ", ""), "lead"), of(("commit ", "sha256: ", "md5=", "checksum: ", "uuid ", 'etag: "', "hash = "), "digest")), of(("\n", '"', " "), "end")
    # Values.
    filler = F.concat(of(("xxxxxxxx", "00000000", "YOUR_KEY", "changeme", "12345678", "abcdabcd"), "filler"), of(("xxxxxxxxxxxx", "000000000000", "_GOES_HERE", "changeme1234", "1234567890"), "more"))
    hexed = F.left(bits, of((32, 40, 64), "size"))
    plain = F.regexp_replace(base64, r"[^A-Za-z0-9]", "x")
    key = F.concat(of(("AKIA", "AIza", "ghp_", "sk-", "glpat-", "xoxb-"), "key"), F.left(plain, of((16, 24, 36), "long")))
    number = F.left(F.translate(bits, "abcdef", "123456"), of((16, 19, 24), "digits"))
    file = F.concat(of(("src/", "lib/", "/usr/share/", "a/"), "root"), word, F.lit("/"), F.left(word, F.lit(9)))
    live = of(("src/app", "notes", "src0", "web", "config"), "path")
    odd = of(("tests/data", "docs/example", "fixtures"), "odd")
    kinds = [
        (live, named, hexed, 1), (live, named, base64, 1), (live, named, key, 1), (live, named, F.upper(hexed), 1),
        (live, named, plain, 1), (live, prose, key, 1), (live, prose, base64, 1), (live, prose, plain, 1),
        (odd, named, hexed, 1), (odd, named, base64, 1), (odd, named, key, 1), (odd, prose, key, 1),
        (live, prose, word, 0), (live, digest, hexed, 0), (odd, prose, hexed, 0), (odd, digest, hexed, 0), (odd, prose, plain, 0), (live, prose, file, 0), (odd, named, filler, 0),
        (live, named, filler, 0), (live, named, word, 0), (live, named, file, 0), (live, prose, number, 0), (live, named, number, 0),
    ]
    # Each kind computes its own rows only.
    parts = [
        spark.range(k, rows, len(kinds), 1).select(
            path.alias("path"), value.alias("value"), F.lit(float(live_)).alias("live"), head.alias("head"), end.alias("end")
        )
        for k, (path, (head, end), value, live_) in enumerate(kinds)
    ]
    texts = materialize(reduce(DataFrame.union, parts), "labelled").withColumn("text", F.concat("head", "value", "end"))
    found = candidates(texts, "text", "path", ("value", "live"))
    label = F.when(F.col("candidate") == F.col("value"), F.col("live")).otherwise(0.0)
    return found.select("path", "before", "candidate", "after", label.alias("label"))


def train(
    labelled: DataFrame, words: DataFrame, trees: int = 40, depth: int = 8, seed: int = 7, most: int = 50_000
) -> PipelineModel | float:
    """A forest from rows of (path, before, candidate, after, label), of which ``most`` at most are drawn by hash.

    Without two labels there is no forest, but the one label (0 without any).
    """
    usable = labelled.where(F.col("candidate").isNotNull() & F.col("label").isNotNull())
    usable = usable.withColumn("label", (F.col("label") >= 0.5).cast("double"))
    drawn = usable.orderBy(F.md5(F.concat_ws("\0", "candidate", "before", "after", "path")), "label").limit(most)
    drawn = materialize(drawn.select("path", "before", "candidate", "after", "label"), "drawn")
    labels = [r[0] for r in drawn.select("label").distinct().collect()]
    if len(labels) < 2:
        return labels[0] if labels else 0.0
    rows = features(drawn, words).select("label", *FEATURES).repartition(1).sortWithinPartitions("label", *FEATURES)
    rows = materialize(rows, "training")
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features__")
    forest = RandomForestClassifier(featuresCol="features__", numTrees=trees, maxDepth=depth, seed=seed)
    return PipelineModel([assembler, forest.fit(assembler.transform(rows))])


def scan(
    df: DataFrame,
    labelled: DataFrame | None = None,
    text: str = "text",
    path: str = "source",
    keep: tuple[str, ...] = ("doc_id",),
    threshold: float = 0.5,
) -> DataFrame:
    """Every candidate: kept columns, ``ordinal``, ``candidate``, its features, ``score``, ``is_secret``.

    ``labelled`` holds findings of (path, before, candidate, after, label); without it, those of
    ``labelled_findings`` are learned from.
    """
    words = materialize(dictionary(df, text), "dictionary")
    model = train(labelled_findings(df.sparkSession) if labelled is None else labelled, words)
    found = features(materialize(candidates(df, text, path, keep), "candidates"), words)
    if isinstance(model, float):
        out = found.withColumn("score", F.lit(model))
    else:
        out = model.transform(found).withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))
    return out.withColumn("is_secret", F.col("score") >= threshold).select(*keep, "ordinal", "candidate", *FEATURES, "score", "is_secret")


def redact(df: DataFrame, text: str = "text", path: str = "source", mark: str = "[SECRET]", labelled: DataFrame | None = None) -> DataFrame:
    """df with each secret in its text replaced by ``mark``; no row and no other character changes."""
    key, bad = free_name(df, "key_"), free_name(df, "secrets_")
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = df.withColumn(key, F.md5(F.concat(F.coalesce(F.col(path).cast("string"), F.lit("")), F.lit("\0"), body)))
    found = scan(keyed.where(F.col(text).isNotNull()), labelled, text, path, (key,)).where("is_secret")
    marks = materialize(found.groupBy(key).agg(F.collect_set("ordinal").alias(bad)), "secrets")
    out = join_checked(keyed, marks, [key], "left", 50_000)
    clean = let(
        F.regexp_extract_all(body, F.lit(CANDIDATE), F.lit(0)),
        lambda own: F.array_join(
            F.transform(
                F.split(body, CANDIDATE),
                lambda gap, k: F.concat(gap, F.when(F.array_contains(bad, k), F.concat(_name(F.get(own, k)), F.lit(mark))).otherwise(F.coalesce(F.get(own, k), F.lit("")))),
            ),
            "",
        ),
    )
    return out.withColumn(text, F.when(F.col(bad).isNotNull(), clean).otherwise(F.col(text))).select(*df.columns)
