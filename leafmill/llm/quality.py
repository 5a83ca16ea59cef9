"""Host-level quality rules: failures by domain, shrunk by an empirical beta prior, joined back.

Native: DataFrame functions only.

Null and empty texts have no words, so they fail the base rule. A null domain forms no host: such
documents are judged by their own base rule alone. Repeated rows count as often as they occur. An
empty table gives an empty result. Columns of the input that share a name with a result column are
replaced by the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import free_name, join_checked, let, materialize, words_of

WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(w: Column) -> Column:
    """Number of words that lie in a five-word window found at least twice in the text.

    A text whose windows are all distinct, the usual case, only pays for a hash set. Otherwise the
    windows are sorted with their positions, and the runs of the repeated ones are measured.
    """

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda v, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - v, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def repeated(rows: Column) -> Column:
        def same(k: Column, e: Column) -> Column:
            return F.coalesce(F.get(rows, k)["h"] == e["h"], F.lit(False))

        twins = F.filter(rows, lambda e, k: same(k + 1, e) | same(k - 1, e))
        return let(F.sort_array(F.transform(twins, lambda e: e["i"])), covered)

    def of_hashes(h: Column) -> Column:
        rows = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(F.sort_array(rows), repeated))

    hashes = F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + d) for d in range(1, WINDOW)]))
    whole = F.slice(hashes, F.lit(1), F.size(w) - (WINDOW - 1))
    return F.when(F.size(w) < WINDOW, F.lit(0)).otherwise(let(whole, of_hashes))


def text_counts(text: Column) -> Column:
    """The counts that the rules read, as one struct."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
        ),
    )


def document_rules(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts, ``base_failed`` and ``rule_failed`` (any rule, the host statistic)."""
    c = free_name(df, "counts_")
    df = df.withColumn(c, text_counts(F.col(text)))
    df = df.withColumns({k: F.col(c)[k] for k in COUNTS}).drop(c)
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    odd = (2 * F.col("n_symbols") > F.col("n_words")) | (F.col("n_dup_lines") >= 5)
    return df.withColumn("base_failed", base).withColumn("rule_failed", base | odd)


def rejected_hosts(judged: DataFrame, domain: str = "source", max_rate: float = 0.5) -> DataFrame:
    """Domains whose shrunk failure rate exceeds ``max_rate``: one column, named ``domain``.

    The prior is beta(m c, (1 - m) c): m is the failure rate of all documents, c comes from the
    variance of host rates beyond what sampling explains (method of moments, held to 1 ... 1e6).
    """
    hosts = (
        judged.where(F.col(domain).isNotNull())
        .groupBy(domain)
        .agg(F.count("*").alias("n_"), F.sum(F.col("rule_failed").cast("long")).alias("f_"))
    )
    hosts = materialize(hosts, "hosts")
    n, f = F.col("n_"), F.col("f_")
    total = hosts.agg(
        F.count("*").alias("hosts"), F.sum("n_").alias("n"), F.sum("f_").alias("f"), F.sum(f * f / n).alias("ff")
    ).first()
    mean = (total["f"] or 0) / (total["n"] or 1)
    even = mean * (1 - mean)
    spread = (total["ff"] or 0.0) / (total["n"] or 1) - mean * mean - even * total["hosts"] / (total["n"] or 1)
    c = min(max(even / spread - 1, 1.0), 1e6) if spread > 0 else 1e6
    return hosts.where((f + mean * c) / (n + c) > max_rate).select(domain)


def quality_rules(
    df: DataFrame, text: str = "text", domain: str = "source", max_rate: float = 0.5, keep_text: bool = True
) -> DataFrame:
    """The input (without its text if ``keep_text`` is false), its counts, ``base_failed``, ``host_rejected``, ``kept``.

    Host statistics and the result both read the judged rows. Without texts these are narrow and are
    written once to the shared folder; with texts they are judged twice instead, so that no text is.
    """
    made = {*COUNTS, "base_failed", "rule_failed", "host_rejected", "kept"}
    df = df.select(*[c for c in df.columns if c not in made])
    carried = [c for c in df.columns if keep_text or c != text]
    judged = document_rules(df, text).select(*carried, *COUNTS, "base_failed", "rule_failed")
    if not keep_text:
        judged = materialize(judged, "judged")
    hosts = rejected_hosts(judged, domain, max_rate).withColumn("host_rejected", F.lit(True))
    out = join_checked(judged, hosts, [domain], "left")
    out = out.withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False)))
    out = out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))
    return out.select(*carried, *COUNTS, "base_failed", "host_rejected", "kept")
