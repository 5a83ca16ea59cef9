"""Registered catalog queries and, written apart from them, their oracles in DuckDB's SQL."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill import config
from leafmill.config import Config, Filters, Git, Output
from leafmill.functions import paths, text, urls
from leafmill.operators import commits, console, copyplan, messages, predicates, ranks, reports, stats
from leafmill.sources.catalog import REPO_FILES, document_path, from_documents, repositories
from leafmill.sources.file_sink import write_files
from leafmill.sources.repo_files import scan_directory
from leafmill.tables import shared_dir

#: A size bound that leaves out some of the documents.
FILTERS = replace(Filters(), max_file_size=20_000)
CONFIG = Config(filters=FILTERS)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def _sql_values(rows: Sequence[tuple], columns: Sequence[str]) -> str:
    def shown(v: object) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool | int | float):
            return str(v)
        return "'" + str(v).replace("'", "''") + "'"

    return "(VALUES " + ", ".join("(" + ", ".join(map(shown, r)) + ")" for r in rows) + f") v({', '.join(columns)})"


def _in(values: Sequence[str]) -> str:
    return "(" + ", ".join("'" + v + "'" for v in values) + ")"


DEEP = "/".join(f"d{k}" for k in range(1, 11)) + "/"
CATALOG = f"""
p AS (SELECT doc_id // 77 AS repo_id, CAST(strlen(text) AS BIGINT) AS size, doc_id,
  CASE doc_id % 11 WHEN 0 THEN '' WHEN 1 THEN 'docs/' WHEN 2 THEN 'docs/guide/' WHEN 3 THEN 'web/node_modules/pkg/'
    WHEN 4 THEN '.github/' WHEN 5 THEN 'Build/site/' WHEN 6 THEN '.hidden/' WHEN 7 THEN 'a/' WHEN 8 THEN 'a-b/'
    WHEN 9 THEN '{DEEP}' ELSE source || '/' END
  || CASE doc_id % 7 WHEN 0 THEN 'README' WHEN 1 THEN 'guide_' || (doc_id % 20) || '.md' WHEN 2 THEN 'NOTES_' || doc_id || '.RST'
    WHEN 3 THEN 'main_' || doc_id || '.rs' WHEN 4 THEN 'LICENSE' WHEN 5 THEN lang || '.txt' ELSE 'page_' || doc_id || '.tar.adoc' END AS relative_path
  FROM documents),
c AS (SELECT *, string_split(relative_path, '/') AS parts, string_split(relative_path, '/')[-1] AS filename,
  lower(regexp_extract(string_split(relative_path, '/')[-1], '^.+\\.([^.]*)$', 1)) AS extension,
  list_slice(string_split(relative_path, '/'), 1, -2) AS dirs,
  array_to_string(list_slice(string_split(relative_path, '/'), 1, -2), '/') AS dir FROM p)"""
REASON = f"""CASE WHEN len(parts) > 10 THEN 'depth'
  WHEN len(list_filter(dirs, lambda d: lower(d) IN {_in(FILTERS.exclude_dirs)})) > 0 THEN 'excluded_dir'
  WHEN len(list_filter(dirs, lambda d: starts_with(d, '.') AND lower(d) NOT IN ('.github', '.vscode', '.devcontainer'))) > 0 THEN 'hidden_dir'
  WHEN len(list_filter(dirs, lambda d: lower(d) IN {_in(predicates.BUILD_DIRS)})) > 0 THEN 'build_dir'
  WHEN NOT (extension IN {_in(FILTERS.extensions)} OR lower(filename) IN {_in(predicates.SCAN_NAMES)}) THEN 'not_documentation'
  WHEN size > 20000 THEN 'size' END"""
KEPT = f"{CATALOG}, r AS (SELECT *, {REASON} AS reason FROM c), k AS (SELECT * FROM r WHERE reason IS NULL)"
#: Flat copies of what is kept: the first of the walk takes a name.
FLAT = f"""{KEPT}, l AS (SELECT *, filename AS dest,
  CASE WHEN row_number() OVER (PARTITION BY repo_id, filename ORDER BY parts) > 1 THEN 'exists' END AS reject_reason FROM k)"""
LEDGER = """e AS (SELECT repo_id, parts, row_number() OVER (PARTITION BY repo_id ORDER BY parts) AS ordinal, relative_path,
  'Failed to copy ' || relative_path || ': Output directory already exists: ' || dest AS message FROM l WHERE reject_reason IS NOT NULL)"""


def _bytes_sql(x: str) -> str:
    def scaled(unit: int, name: str) -> str:
        # half to even on one decimal: printf rounds the exact binary value, as sizes over powers of two are exact
        return f"printf('%.1f', {x} / {unit}.0) || ' {name}'"

    return f"CASE WHEN {x} < 1024 THEN {x} || ' B' WHEN {x} < 1048576 THEN {scaled(1 << 10, 'KB')} WHEN {x} < 1073741824 THEN {scaled(1 << 20, 'MB')} ELSE {scaled(1 << 30, 'GB')} END"


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicates.documentation(from_documents(spark, sf_dir), FILTERS)


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copyplan.plan_copy(_kept(spark, sf_dir), preserve=False)


@query(f"WITH {CATALOG} SELECT repo_id, relative_path, filename, extension, size FROM c")
def catalog_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_documents(spark, sf_dir).select("repo_id", "relative_path", "filename", "extension", "size")


@query(f"WITH {KEPT} SELECT repo_id, relative_path, filename, extension, size FROM k ORDER BY repo_id, parts")
def scan_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _kept(spark, sf_dir).orderBy("repo_id", paths.parts(F.col("relative_path")))
    return rows.select("repo_id", "relative_path", "filename", "extension", "size")


@query(f"WITH {KEPT} SELECT repo_id, coalesce(reason, 'kept') AS reason, count(*) AS files FROM r GROUP BY ALL")
def scan_reject_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.coalesce(predicates.reject_reason(FILTERS), F.lit("kept"))
    return from_documents(spark, sf_dir).groupBy("repo_id", reason.alias("reason")).agg(F.count("*").alias("files"))


PATTERNS = Filters(exclude_patterns=(r"^docs/g", r"src\d*[02468]$", r"[unclosed", r"d3/d4$", r"(?!x)", r"(?<=o)c", r"(?>a)", r"(.)\1", r"\Ra"))


@query(
    f"""WITH {CATALOG}, a AS (SELECT *, list_transform(range(1, len(dirs) + 1), lambda i: array_to_string(list_slice(dirs, 1, i), '/')) AS up FROM c)
    SELECT repo_id, relative_path, len(list_filter(up, lambda x: regexp_matches(x, '^docs/g') OR regexp_matches(x, 'src[0-9]*[02468]$') OR regexp_matches(x, 'd3/d4$'))) > 0 AS excluded,
      regexp_matches(filename, '^guide_1') OR regexp_matches(filename, '[.]rs$') AS name_hit FROM a"""
)
def scan_exclude_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = predicates.matches_any(F.col("filename"), (r"^guide_1", r"\.rs$"))
    return from_documents(spark, sf_dir).select("repo_id", "relative_path", predicates.in_matching_dir(PATTERNS).alias("excluded"), hit.alias("name_hit"))


NAMES = ("README", "LICENCE", "Security", "readme.md", "TODO", "SUPPORT", "Makefile", ".md", "a.", "a.tar.GZ", "..md", "CODE_OF_CONDUCT", "thanks", "")


@query(
    f"""WITH {CATALOG}, n AS (SELECT name FROM {_sql_values([(n,) for n in NAMES], ["name"])} UNION ALL SELECT filename FROM c)
    SELECT name, lower(regexp_extract(name, '^.+\\.([^.]*)$', 1)) AS extension, lower(name) IN {_in(predicates.SCAN_NAMES)} AS in_scan,
    regexp_extract(name, '^.+\\.([^.]*)$', 1) = '' AND lower(name) IN {_in(predicates.DOCUMENT_NAMES)} AS in_document FROM n"""
)
def extensionless_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(n,) for n in NAMES], "filename string").union(from_documents(spark, sf_dir).select("filename"))
    rows = rows.withColumn("extension", paths.extension(F.col("filename")))
    return rows.select(F.col("filename").alias("name"), "extension", predicates.known_name(F.col("filename")).alias("in_scan"), predicates.extensionless_document().alias("in_document"))


@query(f"WITH {KEPT} SELECT repo_id, CASE WHEN extension = '' THEN 'no_extension' ELSE extension END AS ext, count(*) AS files FROM k GROUP BY ALL ORDER BY files DESC, ext")
def extension_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.extension_counts(_kept(spark, sf_dir)).orderBy(F.desc("files"), "ext")


@query(
    f"""WITH {KEPT} SELECT repo_id, count(*) AS total_files, CAST(sum(size) AS BIGINT) AS total_size, max(size) AS largest_size,
    last(relative_path ORDER BY size, parts) AS largest_path FROM k GROUP BY repo_id"""
)
def scan_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.scan_statistics(_kept(spark, sf_dir))


@query(
    f"""WITH {FLAT} SELECT repo_id, count(*) FILTER (reject_reason IS NULL) AS files_processed,
    CAST(coalesce(sum(size) FILTER (reject_reason IS NULL), 0) AS BIGINT) AS bytes_processed, CAST(sum(size) // count(*) AS BIGINT) AS average_size,
    max(size) AS largest_size, first(relative_path ORDER BY size DESC, parts) AS largest_path FROM l GROUP BY repo_id"""
)
def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.report_summary(_flat(spark, sf_dir))


@query(f"WITH {CATALOG} SELECT repo_id, relative_path, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY parts) AS INTEGER) AS ordinal FROM c")
def sorted_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = from_documents(spark, sf_dir).select("repo_id", "relative_path")
    return ranks.with_ordinal(files, "repo_id", paths.parts(F.col("relative_path")))


@query(f"WITH {KEPT} SELECT repo_id, dir, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM k GROUP BY ALL ORDER BY repo_id, dir")
def index_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.index_sections(_kept(spark, sf_dir)).orderBy("repo_id", "dir")


@query(
    f"""WITH {KEPT}, s AS (SELECT DISTINCT repo_id, dir FROM k), t AS (SELECT repo_id, count(*) AS n, CAST(sum(size) AS BIGINT) AS b FROM k GROUP BY repo_id),
    x AS (SELECT repo_id, 1 AS s, '' AS g, 0 AS p, [''] AS parts, '# Documentation Index' AS line FROM t UNION ALL SELECT repo_id, 1, '', 1, [''], '' FROM t
      UNION ALL SELECT repo_id, 2, dir, 0, [''], '## ' || dir || '/' FROM s UNION ALL SELECT repo_id, 2, dir, 1, [''], '' FROM s
      UNION ALL SELECT repo_id, 2, dir, 2, parts, '- [' || filename || '](' || relative_path || ') (' || size || ' bytes)' FROM k
      UNION ALL SELECT repo_id, 2, dir, 3, [''], '' FROM s UNION ALL SELECT repo_id, 3, '', 0, [''], '---' FROM t
      UNION ALL SELECT repo_id, 3, '', 1, [''], 'Total files: ' || n FROM t UNION ALL SELECT repo_id, 3, '', 2, [''], 'Total size: ' || b || ' bytes' FROM t)
    SELECT repo_id, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY s, g, p, parts) AS INTEGER) AS ordinal, line FROM x"""
)
def index_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.index_lines(_kept(spark, sf_dir).cache())


@query(f"WITH {FLAT} SELECT repo_id, relative_path, dest, reject_reason FROM l")
def flatten_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(spark, sf_dir).select("repo_id", "relative_path", "dest", "reject_reason")


# Destinations under test.
DESTINATIONS = (
    "docs/a.md", "a<b.md", "a>b", "a:b", 'a"b', "a|b", "a?b", "a*b", "x?/fine.md", "tab\there", "end ", "end.", "dir./ok", "../up", "a/../b",
    "x" * 4096, "x" * 4097, "é" * 2049, "..a", "a..b", "\x7f", "",
)
# End of fixed values.


@query(
    f"""WITH {CATALOG}, d AS (SELECT path FROM {_sql_values([(d,) for d in DESTINATIONS], ["path"])} UNION ALL SELECT relative_path FROM c)
    SELECT path, CASE WHEN list_contains(string_split(path, '/'), '..') THEN 'traversal' WHEN strlen(path) > 4096 THEN 'too_long'
      WHEN regexp_matches(string_split(path, '/')[-1], '[<>:"|?*[:cntrl:]]') THEN 'invalid_characters'
      WHEN regexp_matches(string_split(path, '/')[-1], '[ .]$') THEN 'trailing_space_or_dot' END AS problem, strlen(path) > 260 AS over_260 FROM d"""
)
def dest_path_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(d,) for d in DESTINATIONS], "path string").union(from_documents(spark, sf_dir).select("relative_path"))
    return rows.select("path", predicates.path_problem(F.col("path")).alias("problem"), predicates.too_long(F.col("path"), 260).alias("over_260"))


@query(
    f"""WITH {FLAT}, w AS (SELECT repo_id, relative_path, CAST(row_number() OVER o AS INTEGER) AS ordinal,
      CAST(count(*) FILTER (reject_reason IS NULL) OVER o AS BIGINT) AS files_processed,
      CAST(coalesce(sum(size) FILTER (reject_reason IS NULL) OVER o, 0) AS BIGINT) AS bytes_processed,
      count(*) OVER (PARTITION BY repo_id) AS total_files, CAST(sum(size) OVER (PARTITION BY repo_id) AS BIGINT) AS total_bytes
      FROM l WINDOW o AS (PARTITION BY repo_id ORDER BY parts ROWS UNBOUNDED PRECEDING))
    SELECT *, CAST(files_processed AS DOUBLE) / CAST(total_files AS DOUBLE) * 100.0::DOUBLE AS percent FROM w"""
)
def copy_progress_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copyplan.progress_trace(_flat(spark, sf_dir).cache())


@query(f"WITH {FLAT}, {LEDGER} SELECT repo_id, CAST(ordinal AS INTEGER) AS ordinal, relative_path, message FROM e")
def copy_error_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copyplan.error_ledger(_flat(spark, sf_dir).cache())


SIZES = (0, 1, 500, 512, 1023, 1024, 1280, 1536, 1792, 1048575, 1048576, 2097152, 1073741823, 1073741824, 1 << 40)


@query(f"WITH {CATALOG}, s AS (SELECT CAST(size AS BIGINT) AS size FROM {_sql_values([(s,) for s in SIZES], ['size'])} UNION ALL SELECT size FROM c) SELECT size, {_bytes_sql('size')} AS shown FROM s")
def format_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(s,) for s in SIZES], "size long").union(from_documents(spark, sf_dir).select("size"))
    return rows.select("size", text.format_bytes(F.col("size")).alias("shown"))


@query(
    """WITH d AS (SELECT event_id, CAST(floor(abs(value) * 1000) AS BIGINT) AS ms FROM events)
    SELECT event_id, ms, CASE WHEN ms >= 60000 THEN (ms // 60000) || 'm ' || (ms // 1000 % 60) || 's' WHEN ms >= 1000 THEN (ms // 1000) || 's' ELSE ms || 'ms' END AS shown FROM d"""
)
def format_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.floor(F.abs("value") * 1000).cast("long")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", ms.alias("ms"), text.format_duration(ms).alias("shown"))


# Texts of sizes under test.
SIZE_TEXTS = ("10", "10KB", "5MB", "1GB", "invalid", "-5MB", "1.5mb", "10 mb", " 10 ", "1e3k", "1.5d", "nan", "inf", "", "b", "7b", ".5k", "5.k", "+2m", "10kk", "0x10", "5.9", "3g")
# End of fixed values.
UNITS = ("", "b", "k", " KB", "Mb", "g", "x")


@query(
    f"""WITH r AS (SELECT raw FROM {_sql_values([(s,) for s in SIZE_TEXTS], ["raw"])} UNION ALL SELECT (doc_id % 3000) || '.' || (doc_id % 10) || {list(UNITS)}[doc_id % {len(UNITS)} + 1] FROM documents),
    s AS (SELECT raw, lower(trim(raw)) AS s FROM r),
    u AS (SELECT raw, s, CASE WHEN regexp_matches(s, '(kb|k)$') THEN 'k' WHEN regexp_matches(s, '(mb|m)$') THEN 'm' WHEN regexp_matches(s, '(gb|g)$') THEN 'g' WHEN s LIKE '%b' THEN 'b' ELSE '' END AS u FROM s),
    n AS (SELECT raw, u, CASE u WHEN '' THEN s WHEN 'b' THEN rtrim(s, 'b') ELSE rtrim(regexp_replace(s, '(' || u || 'b)+$', ''), u) END AS body FROM u)
    SELECT raw, CASE WHEN regexp_matches(body, '^[+]?([0-9]+[.]?[0-9]*|[.][0-9]+)(e[+-]?[0-9]+)?$') THEN
      CAST(floor(CAST(body AS DOUBLE) * CASE u WHEN 'k' THEN 1024 WHEN 'm' THEN 1048576 WHEN 'g' THEN 1073741824 ELSE 1 END) AS BIGINT) END AS bytes FROM n"""
)
def parse_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size texts, and one made of each document's id."""
    i, unit = F.col("doc_id"), F.array(*map(F.lit, UNITS))
    made = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(i % 3000, F.lit("."), i % 10, F.get(unit, (i % len(UNITS)).cast("int"))))
    return spark.createDataFrame([(s,) for s in SIZE_TEXTS], "raw string").union(made).select("raw", text.parse_size(F.col("raw")).alias("bytes"))


# Names under test.
FILE_NAMES = ("normal_file.txt", "file<>with|bad*chars.txt", "file/with\\slashes.txt", "   ", "file...", "tab\tname", "a. .", "ünï½.md", "")
REPO_NAMES = ("normal-repo", "repo/with/slashes", "repo:with:colons", "", "   ", "a" * 150, "._x_.", "ünï ½ 中", "tab\tx", "a@b#c")
# End of fixed values.
LINES = "SELECT doc_id, string_split(text, chr(10))[1] AS line FROM documents"


@query(
    f"""WITH n AS (SELECT -1 AS doc_id, line FROM {_sql_values([(s,) for s in FILE_NAMES], ["line"])} UNION ALL {LINES}),
    s AS (SELECT doc_id, line, rtrim(regexp_replace(line, '[<>:"|?*/\\\\\\p{{Cc}}]', '_', 'g'), '. ') AS s FROM n)
    SELECT CAST(doc_id AS BIGINT) AS doc_id, line, CASE WHEN s = '' THEN 'unnamed_file' ELSE s END AS clean FROM s"""
)
def sanitize_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _first_lines(spark, sf_dir, FILE_NAMES).withColumn("clean", text.sanitize_filename(F.col("line")))


@query(
    f"""WITH n AS (SELECT -1 AS doc_id, line FROM {_sql_values([(s,) for s in REPO_NAMES], ["line"])} UNION ALL {LINES}),
    s AS (SELECT doc_id, line, trim(regexp_replace(line, '[^\\p{{L}}\\p{{N}}._-]', '_', 'g'), '._ ') AS s FROM n)
    SELECT CAST(doc_id AS BIGINT) AS doc_id, line, CASE WHEN s = '' THEN 'unnamed_repo' ELSE left(s, 100) END AS clean FROM s"""
)
def sanitize_repo_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _first_lines(spark, sf_dir, REPO_NAMES).withColumn("clean", text.sanitize_repo_name(F.col("line")))


def _first_lines(spark: SparkSession, sf_dir: str, more: Sequence[str]) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.get(F.split("text", "\n"), F.lit(0)).alias("line"))
    return spark.createDataFrame([(-1, s) for s in more], "doc_id long, line string").union(docs)


# Addresses under test.
URLS = (
    "https://github.com/microsoft/vscode", "https://github.com/rust-lang/rust.git", "git://github.com/o/r", "ssh://git@github.com/o/r", "http://github.com/o/r",
    "https://gitlab.com/o/r", "https://github.com/o", "https://github.com/", "https://github.com", "not-a-url", "ftp://github.com/o/r", "git://gitlab.com/o/r",
    "https://evilgithub.com/o/r", "git@github.com:o/r", "https://github.com/o/../x/y", "https://GITHUB.com/o/r", "https://github.com//r", "https://github.com/o/",
    "https://github.com/o$/r", "https://github.com/o/r!", "https://github.com/.o/r", "https://github.com/o/.r", "https://github.com/o/.git", "https://api.github.com/o/r/tree/main",
    "https://github.com/o/" + "r" * 100, "https://github.com/o/" + "r" * 101, "https://github.com/o/r.git.git",
    "https://github.com/a/./b", "https://github.com/a/b/..", "https://github.com/a/%2E%2e/x/y", "https://github.com/../../x/y/z/../..", "https://github.com/o/.", "https://github.com/..", "git://github.com/a/../o/r.git",
    "https://github.com/o r/x", "https://github.com/o/r|x", "https://github.com/o/r%zz", "https://github.com\\o\\r", "git://github.com/o\\r/x", " https://github.com/o/r\n", "https://github.com/o/<r>", "https://github.com/o/r?q=[1]#a b",
    "https://github.com/ünï/r", "https://github.com/½/r", "https://github.com/o/ünï", "https://github.com/o/中", "https://github.com/o/r_1.x-y",
)
# End of fixed values.
EXAMPLE = "example.com"


def _urls_sql(host: str) -> str:
    coded = "regexp_replace(regexp_extract(v, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '%([^0-9A-Fa-f]|[0-9A-Fa-f][^0-9A-Fa-f]|.?$)', '%25\\1', 'g')"
    for character, code in urls.ENCODED.items():
        coded = f"replace({coded}, '{character}', '{code}')"
    dots = "replace(lower(x[1]), '%2e', '.')"
    return f"""a AS (SELECT url, '{urls.HOST}' AS h FROM {_sql_values([(u,) for u in URLS], ["url"])} UNION ALL SELECT url, '{host}' FROM pages),
    b AS (SELECT url, h, regexp_replace(regexp_replace(url, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g'), '[\\t\\n\\r]', '', 'g') AS v FROM a),
    u AS (SELECT url, h, CASE WHEN regexp_matches(v, '^(?i:https?|ftp):') THEN replace(v, '\\', '/') ELSE v END AS v FROM b),
    w AS (SELECT *, string_split(regexp_replace({coded}, '^/', ''), '/') AS given FROM u),
    q AS (SELECT *, regexp_extract(v, '^([A-Za-z][A-Za-z0-9+.-]*):', 1) AS scheme, lower(regexp_extract(v, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/]*@)?([^/:?#]*)', 1)) AS host,
      list_concat(list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(given, lambda y: [y])), lambda s, x: CASE {dots} WHEN '..' THEN list_slice(s, 1, len(s) - 1) WHEN '.' THEN s ELSE list_concat(s, x) END),
        CASE WHEN replace(lower(given[-1]), '%2e', '.') IN ('.', '..') THEN [''] ELSE [] END) AS seg FROM w),
    t AS (SELECT *, seg[1] AS owner, regexp_replace(seg[2], '[.]git$', '') AS repo,
      CASE WHEN scheme = '' OR NOT regexp_matches(v, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN 'bad_url' WHEN lower(scheme) NOT IN ('https', 'ssh', 'git') THEN 'scheme'
        WHEN lower(scheme) = 'git' AND NOT contains(host, h) THEN 'git_host' WHEN host = '' THEN 'no_host' WHEN NOT ends_with(host, h) THEN 'host' END AS transport FROM q)"""


def _addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.createDataFrame([(u, urls.HOST) for u in URLS], "url string, h string")
    return given.union(spark.read.parquet(f"{sf_dir}/pages.parquet").select("url", F.lit(EXAMPLE)))


def _by_host(column: Callable) -> F.Column:
    return F.when(F.col("h") == EXAMPLE, column(F.col("url"), EXAMPLE)).otherwise(column(F.col("url"), urls.HOST))


@query(
    f"""WITH {_urls_sql(EXAMPLE)} SELECT url, coalesce(transport, CASE WHEN len(seg) < 2 THEN 'path'
      WHEN seg[1] = '' OR seg[2] = '' THEN 'empty' WHEN regexp_matches(owner, '[^A-Za-z0-9._-]') THEN 'owner_chars' WHEN regexp_matches(repo, '[^A-Za-z0-9._-]') THEN 'repo_chars'
      WHEN starts_with(owner, '.') OR starts_with(repo, '.') THEN 'dot' WHEN strlen(owner) > 100 OR strlen(repo) > 100 THEN 'length' ELSE 'ok' END) AS problem FROM t"""
)
def url_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _addresses(spark, sf_dir).select("url", _by_host(urls.url_problem).alias("problem"))


@query(f"WITH {_urls_sql(EXAMPLE)} SELECT url, coalesce(transport, 'ok') AS problem FROM t")
def cloner_url_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _addresses(spark, sf_dir).select("url", _by_host(urls.clone_problem).alias("problem"))


@query(f"WITH {_urls_sql(EXAMPLE)} SELECT url, owner, repo, 'docs_' || repo AS output_name, '/work/docs_' || repo AS output_path FROM t WHERE len(seg) >= 2")
def repo_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _addresses(spark, sf_dir).where(F.size(urls.segments(F.col("url"))) >= 2)
    name = urls.output_name(F.col("url"))
    return rows.select("url", urls.owner(F.col("url")).alias("owner"), urls.repository(F.col("url")).alias("repo"), name.alias("output_name"), urls.output_path(name, F.lit("/work")).alias("output_path"))


#: Settings of a file and options given: id, then extensions, directories, size, timeout, depth, base directory, then the options.
SETTINGS = (
    (1, "md,rst", "target,dist", 100, 30, 10, "/tmp/x", None, None, None, None, None),
    (2, "md", ".git", 100, 30, 10, "/tmp/x", " MD, .x ,,TXT ", "a,B,.git", 5, 0, "dev"),
    (3, "", "x", 0, 1, 10, "/tmp/x", "txt", None, None, 7, None),
    (4, "md", "x", 9, 1, 10, "/tmp/x", None, "x", 0, None, "main"),
    (5, "md", "x", 9, 0, 10, "/tmp/x", ",", " y ", None, None, None),
    (6, "md", "x", 9, 1, 0, "/tmp/x", None, None, None, None, None),
    (7, "md", "x", 9, 1, 1, "/no/such/directory/x", None, None, None, None, None),
    (8, "", "x", 0, 0, 0, "/no/such/directory/x", None, None, None, None, None),
)
SETTING_COLUMNS = ("id", "extensions", "dirs", "max_size", "timeout", "depth", "base", "formats", "exclude", "cli_size", "cli_timeout", "branch")
_split_sql = lambda c: f"CASE WHEN {c} = '' THEN []::VARCHAR[] ELSE string_split({c}, ',') END"
MERGED = f"""m AS (SELECT id, CASE WHEN formats IS NULL THEN {_split_sql("extensions")}
    ELSE list_filter(list_transform(string_split(formats, ','), lambda x: lower(trim(x))), lambda x: x <> '') END AS extensions,
    CASE WHEN exclude IS NULL THEN {_split_sql("dirs")} ELSE list_concat({_split_sql("dirs")}, string_split(exclude, ',')) END AS exclude_dirs,
    coalesce(cli_size, max_size) AS max_file_size, coalesce(cli_timeout, timeout) AS timeout, depth, base, branch FROM {_sql_values(SETTINGS, SETTING_COLUMNS)})"""


def _merged() -> list[tuple[int, Config]]:
    """The settings of each row, with its options over them."""
    found = []
    for i, extensions, dirs, size, timeout, depth, base, formats, exclude, cli_size, cli_timeout, branch in SETTINGS:
        listed = tuple(extensions.split(",")) if extensions else ()
        given = Config(Filters(extensions=listed, exclude_dirs=tuple(dirs.split(",")), max_file_size=size, max_depth=depth), Output(base_directory=base), Git(timeout=timeout))
        options = {"formats": formats, "exclude": exclude and exclude.split(","), "max_file_size": cli_size, "timeout": cli_timeout, "branch": branch}
        found.append((i, config.merge(given, options)))
    return found


@query(f"WITH {MERGED} SELECT id, array_to_string(extensions, '|') AS extensions, array_to_string(exclude_dirs, '|') AS exclude_dirs, max_file_size, timeout, branch FROM m")
def config_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(i, "|".join(c.filters.extensions), "|".join(c.filters.exclude_dirs), c.filters.max_file_size, c.git.timeout, c.git.branch) for i, c in _merged()]
    return spark.createDataFrame(rows, "id int, extensions string, exclude_dirs string, max_file_size int, timeout int, branch string")


@query(
    f"""WITH {MERGED} SELECT id, CASE WHEN len(extensions) = 0 THEN 'no_extensions' WHEN max_file_size <= 0 THEN 'max_file_size' WHEN timeout <= 0 THEN 'timeout'
    WHEN depth <= 0 THEN 'max_depth' WHEN base LIKE '/no/such/%' THEN 'base_directory' ELSE 'ok' END AS problem FROM m"""
)
def config_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(i, config.problem(c) or "ok") for i, c in _merged()], "id int, problem string")


LEVELS = ("success", "error", "warning", "info", "debug", "operation_start")
SHOWS = tuple((m, level, v, q) for m in ("human", "JSON", "Plain", "other") for level in LEVELS for v, q in ((0, False), (1, False), (2, False), (2, True)))


@query(
    f"""WITH s AS (SELECT lower(m) AS given, CASE WHEN lower(m) IN ('json', 'plain') THEN lower(m) ELSE 'human' END AS md, level, "verbose", quiet, 'Copied file ' || doc_id AS body FROM {_sql_values([(i, *x) for i, x in enumerate(SHOWS)], ("i", "m", "level", '"verbose"', "quiet"))} JOIN documents d ON d.doc_id % {len(SHOWS)} = i)
    SELECT given, level, "verbose", quiet,
      level IN ('success', 'error') OR (NOT quiet AND "verbose" >= CASE level WHEN 'debug' THEN 2 WHEN 'operation_start' THEN 0 ELSE 1 END) AS shown,
      level = 'error' AND md <> 'json' AS to_stderr,
      CASE md WHEN 'json' THEN '{{"type":"message","level":"' || level || '","message":"' || body || '"}}'
        WHEN 'plain' THEN CASE level WHEN 'operation_start' THEN 'STARTING' ELSE upper(level) END || ': ' || body
        ELSE CASE level WHEN 'success' THEN '✓' WHEN 'error' THEN '✗' WHEN 'warning' THEN '!' WHEN 'info' THEN 'i' WHEN 'debug' THEN '  DEBUG:' ELSE '>' END || ' ' || body END AS line FROM s"""
)
def message_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message for each document, in a mode and at a level that its id chooses."""
    shows = spark.createDataFrame([(i, *x) for i, x in enumerate(SHOWS)], "i long, m string, level string, verbose int, quiet boolean")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", (F.col("doc_id") % len(SHOWS)).alias("i"))
    rows = docs.join(F.broadcast(shows), "i")
    mode, level, body = messages.mode(F.col("m")), F.col("level"), F.concat(F.lit("Copied file "), F.col("doc_id"))
    return rows.select(
        F.lower("m").alias("given"), "level", "verbose", "quiet", messages.is_shown(level, F.col("verbose"), F.col("quiet")).alias("shown"),
        messages.to_stderr(mode, level).alias("to_stderr"), messages.render(mode, level, body).alias("line"),
    )


ENDS = (None, *messages.KINDS, "unheard_of")
ENDS_SQL = "NULL, " + ", ".join(f"'{k}'" for k in ENDS[1:])


@query(
    f"""SELECT kind, errors, CAST(CASE WHEN kind IS NULL THEN CASE WHEN errors > 0 THEN 2 ELSE 0 END WHEN kind = 'cancelled' THEN 130 WHEN kind = 'invalid_url' THEN 2
      WHEN kind = 'repository_not_found' THEN 3 WHEN kind = 'authentication_failed' THEN 4 WHEN kind = 'network' THEN 5 WHEN kind = 'no_documentation' THEN 6
      WHEN kind = 'permission' THEN 7 WHEN kind = 'output_exists' THEN 8 WHEN kind = 'timeout' THEN 9 ELSE 1 END AS INTEGER) AS code FROM (SELECT [{ENDS_SQL}][doc_id % {len(ENDS)} + 1] AS kind, CAST(doc_id % 4 AS INTEGER) AS errors FROM documents)"""
)
def exit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a run for each document would end, if it failed as the document's id says."""
    i = F.col("doc_id")
    kind = F.get(F.array(*map(F.lit, ENDS)), (i % len(ENDS)).cast("int"))
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(kind.alias("kind"), (i % 4).cast("int").alias("errors"))
    return rows.select("kind", "errors", messages.exit_code(F.col("kind"), F.col("errors")).alias("code"))


GIT_ERRORS = (("net", "generic"), ("net", "auth"), ("http", "auth"), ("http", "not_found"), ("http", "generic"), ("ssh", "auth"))


@query(
    f"""WITH k AS (SELECT kind FROM {_sql_values([(k,) for k in messages.KINDS], ["kind"])} UNION ALL
      SELECT CASE WHEN c = 'net' AND d = 'generic' THEN 'network' WHEN c = 'http' AND d = 'auth' THEN 'authentication_failed' WHEN c = 'http' AND d = 'not_found' THEN 'repository_not_found' ELSE 'git' END FROM {_sql_values(GIT_ERRORS, ("c", "d"))})
    SELECT kind, CASE kind WHEN 'timeout' THEN 'Operation timed out after X seconds' WHEN 'cancelled' THEN 'Operation was cancelled by user'
      WHEN 'git' THEN 'Git operation failed: X' WHEN 'io' THEN 'IO operation failed: X' WHEN 'invalid_url' THEN 'Invalid repository URL: X'
      WHEN 'repository_not_found' THEN 'Repository not found: X' WHEN 'authentication_failed' THEN 'Authentication failed for: X' WHEN 'network' THEN 'Network error: X'
      WHEN 'no_documentation' THEN 'No documentation files found with extensions: X' WHEN 'config' THEN 'Configuration error: X' WHEN 'permission' THEN 'Permission denied accessing: X'
      WHEN 'file_too_large' THEN 'File too large: X' WHEN 'invalid_path' THEN 'Invalid file path: X' WHEN 'output_exists' THEN 'Output directory already exists: X' END AS message,
      CASE kind WHEN 'invalid_url' THEN 'Please check that the URL is a valid GitHub repository URL (e.g., https://github.com/owner/repo)'
      WHEN 'repository_not_found' THEN 'Verify the repository exists and you have access to it. For private repositories, set the GITHUB_TOKEN environment variable.'
      WHEN 'authentication_failed' THEN 'Set the GITHUB_TOKEN environment variable with a valid personal access token for private repositories.'
      WHEN 'network' THEN 'Check your internet connection and try again. If the problem persists, the repository server might be temporarily unavailable.'
      WHEN 'no_documentation' THEN 'Try using different file extensions with --formats (e.g., --formats md,rst,txt,adoc) or check if the repository contains documentation files.'
      WHEN 'config' THEN 'Check your configuration file syntax and ensure all required fields are present.'
      WHEN 'permission' THEN 'Ensure you have the necessary read/write permissions for the target directory.'
      WHEN 'timeout' THEN 'The operation took longer than expected. Try again or increase the timeout with --timeout.'
      WHEN 'file_too_large' THEN 'Increase the maximum file size limit with --max-size or exclude large files.'
      WHEN 'output_exists' THEN 'Remove the existing directory, choose a different output name with --output, or use --force to overwrite.' END AS hint FROM k"""
)
def error_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = spark.createDataFrame([(k,) for k in messages.KINDS], "kind string")
    git = spark.createDataFrame(list(GIT_ERRORS), "c string, d string").select(messages.classify_git(F.col("c"), F.col("d")).alias("kind"))
    return kinds.union(git).select("kind", messages.message(F.col("kind"), F.lit("X")).alias("message"), messages.hint(F.col("kind")).alias("hint"))


SUMS = f"""t AS (SELECT repo_id, count(*) FILTER (reject_reason IS NULL) AS n, CAST(coalesce(sum(size) FILTER (reject_reason IS NULL), 0) AS BIGINT) AS b, CAST(sum(size) // count(*) AS BIGINT) AS a,
    max(size) AS s, first(relative_path ORDER BY size DESC, parts) AS p FROM l GROUP BY repo_id), {LEDGER},
    x AS (SELECT repo_id, CASE WHEN extension = '' THEN 'no_extension' ELSE extension END AS ext, count(*) AS n FROM l GROUP BY ALL)"""


def _lines_sql(rows: list[tuple[int, str, str, str]]) -> str:
    """UNION of (section, line, table, order)."""
    return " UNION ALL ".join(f"SELECT repo_id, {s} AS s, {order} AS o, {line} AS line FROM {table}" for s, line, table, order in rows)


_at = lambda i: f"[lpad('{i}', 3, '0')]"
_REPO = "'owner/repo' || repo_id"
TEXT_LINES = _lines_sql(
    [(1, line, "t", _at(i)) for i, line in enumerate([
        "'Documentation Extraction Report'", "'==============================='", "''", f"'Repository: ' || {_REPO}", f"'URL: https://github.com/' || {_REPO}", "'Branch: main'",
        "'Total commits: ' || (repo_id * 3 + 1)", "'Repository empty: false'", "''", "'Extraction Summary:'", "'  Files processed: ' || n",
        f"'  Bytes processed: ' || b || ' (' || {_bytes_sql('b')} || ')'", f"'  Average file size: ' || a || ' (' || {_bytes_sql('a')} || ')'", "''"])]
    + [(2, "'Files by extension:'", "t", "['']"), (3, "'  ' || ext || ': ' || n || ' files'", "x", "[lpad(CAST(1000000 - n AS VARCHAR), 9, '0'), ext]"), (4, "''", "t", "['']")]
    + [(5, line, "t", _at(i)) for i, line in enumerate([
        "'Largest file:'", "'  Name: ' || string_split(p, '/')[-1]", "'  Path: ' || p", f"'  Size: ' || s || ' (' || {_bytes_sql('s')} || ')'", "''", "'Configuration used:'",
        f"'  Extensions: {', '.join(FILTERS.extensions)}'", "'  Max file size: 20000 (19.5 KB)'", f"'  Excluded directories: {', '.join(FILTERS.exclude_dirs)}'", "'  Preserve structure: true'", "''"])]
    + [(6, "'Errors encountered:'", "(SELECT DISTINCT repo_id FROM e)", "['']"), (7, "'  - ' || message", "e", "parts"), (8, "''", "(SELECT DISTINCT repo_id FROM e)", "['']")]
    + [(9, "'Extracted files:'", "t", "['']"), (10, "'  ' || relative_path || ' (' || size || ' bytes) - ' || extension", "l", "parts")]
)
SUMMARY_LINES = _lines_sql(
    [(1, line, "t", _at(i)) for i, line in enumerate([
        "'# Documentation Extraction Summary'", "''", f"'**Repository:** [' || {_REPO} || '](https://github.com/' || {_REPO} || ')'", "''", "'## Statistics'", "''",
        "'- **Files processed:** ' || n", f"'- **Total size:** ' || {_bytes_sql('b')}", f"'- **Average file size:** ' || {_bytes_sql('a')}", "''"])]
    + [(2, "'## File Types'", "t", "['0']"), (2, "''", "t", "['1']"), (3, "'- **' || replace(ext, '_', ' ') || '**: ' || n || ' files'", "x", "[lpad(CAST(1000000 - n AS VARCHAR), 9, '0'), ext]"), (4, "''", "t", "['']")]
    + [(5, "'## Issues Encountered'", "(SELECT DISTINCT repo_id FROM e)", "['0']"), (5, "''", "(SELECT DISTINCT repo_id FROM e)", "['1']"), (6, "'- ' || message", "e", "parts"), (7, "''", "(SELECT DISTINCT repo_id FROM e)", "['']")]
    + [(8, "'---'", "t", "['0']"), (8, f"'*Generated by {reports.TOOL}*'", "t", "['1']")]
)
_NUMBERED = "SELECT repo_id, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY s, o) AS INTEGER) AS ordinal, line FROM y"


@query(f"WITH {FLAT}, {SUMS}, y AS ({TEXT_LINES}) {_NUMBERED}")
def report_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = _flat(spark, sf_dir).cache()
    return reports.text_lines(plan, repositories(plan), CONFIG)


@query(f"WITH {FLAT}, {SUMS}, y AS ({SUMMARY_LINES}) {_NUMBERED}")
def summary_md_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = _flat(spark, sf_dir).cache()
    return reports.summary_lines(plan, repositories(plan))


@query(
    f"""WITH {KEPT}, x AS (SELECT repo_id, CASE WHEN extension = '' THEN 'no_extension' ELSE extension END AS ext, count(*) AS n FROM k GROUP BY ALL),
    y AS (SELECT repo_id, string_agg('    ' || ext || ': ' || n || ' files' || chr(10), '' ORDER BY n DESC, ext) AS t FROM x GROUP BY repo_id),
    z AS (SELECT repo_id, count(*) AS n, CAST(sum(size) AS BIGINT) AS b, max(size) AS s, last(relative_path ORDER BY size, parts) AS p FROM k GROUP BY repo_id)
    SELECT repo_id, 'Scan Results:' || chr(10) || '  Total files: ' || n || chr(10) || '  Total size: ' || {_bytes_sql("b")} || chr(10) || '  Files by type:' || chr(10) || t
      || '  Largest file: ' || p || ' (' || {_bytes_sql("s")} || ')' || chr(10) AS summary FROM z JOIN y USING (repo_id)"""
)
def scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.scan_summary(_kept(spark, sf_dir))


_FILE = "{'filename': %s, 'relative_path': %s, 'extension': extension, 'size': size, 'modified': NULL}"
#: Each repository with the record of its largest file.
LARGEST = f"""g AS (SELECT repo_id, first({_FILE % ("filename", "relative_path")} ORDER BY size DESC, parts) AS f FROM l GROUP BY repo_id), w AS (SELECT t.*, g.f FROM t JOIN g USING (repo_id))"""
_OURS = """{'name': 'repo' || repo_id, 'owner': 'owner', 'default_branch': 'main', 'is_empty': false, 'total_commits': repo_id * 3 + 1, 'url': 'https://github.com/owner/repo' || repo_id}"""
_USED = f"{{'extensions': {list(FILTERS.extensions)}, 'max_file_size': 20000, 'exclude_dirs': {list(FILTERS.exclude_dirs)}, 'preserve_structure': true}}"
JSON_LINES = _lines_sql(
    [(1, line, "w", _at(i)) for i, line in enumerate([
        "'{'", f"""'  "repository_info": ' || to_json({_OURS}) || ','""", """'  "extraction_summary": {'""", """'    "total_files_processed": ' || n || ','""", """'    "total_bytes_processed": ' || b || ','""",
        """'    "extraction_duration": null,'""", """'    "files_by_extension": {'"""])]
    + [(2, """'      "' || ext || '": ' || n""", "x", "[ext]")]
    + [(3, line, "w", _at(i)) for i, line in enumerate(["'    },'", """'    "largest_file": ' || to_json(f) || ','""", """'    "average_file_size": ' || a""", "'  },'", """'  "files": ['"""])]
    + [(4, f"""'    ' || to_json({_FILE % ("filename", "relative_path")})""", "l", "parts")]
    + [(5, line, "w", _at(i)) for i, line in enumerate(["'  ],'", """'  "extraction_time": null,'""", """'  "errors": ['"""])]
    + [(6, "'    ' || to_json(message)", "e", "parts")]
    + [(7, line, "w", _at(i)) for i, line in enumerate(["'  ],'", f"""'  "config_used": ' || to_json({_USED})""", "'}'"])]
)


@query(
    f"""WITH {FLAT}, {SUMS}, {LARGEST}, y AS ({JSON_LINES}),
    z AS (SELECT repo_id, s, o, CAST(line AS VARCHAR) || CASE WHEN s IN (2, 4, 6) AND row_number() OVER (PARTITION BY repo_id, s ORDER BY o) < count(*) OVER (PARTITION BY repo_id, s) THEN ',' ELSE '' END AS line FROM y)
    SELECT repo_id, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY s, o) AS INTEGER) AS ordinal, line FROM z"""
)
def report_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = _flat(spark, sf_dir).cache()
    return reports.json_lines(plan, repositories(plan), CONFIG)


def _pretty(fields: Sequence[tuple[str, str]], depth: int) -> str:
    """SQL of an object over several lines; values are SQL texts."""
    pad = "  " * (depth + 1)
    inside = " || ',' || chr(10) || ".join(f"""'{pad}"{name}" : ' || {value}""" for name, value in fields)
    return f"('{{' || chr(10) || {inside} || chr(10) || '{'  ' * depth}}}')"


def _pretty_file(x: str, depth: int) -> str:
    return _pretty([*[(c, f"to_json({x}{c})") for c in ("filename", "relative_path", "extension", "size")], ("modified", "'null'")], depth)


def _pretty_list(items: Sequence[str]) -> str:
    return "'[ " + ", ".join(f'"{x}"' for x in items) + " ]'"


_REPO_OBJECT = [("name", "to_json('repo' || repo_id)"), ("owner", """'"owner"'"""), ("default_branch", """'"main"'"""), ("is_empty", "'false'"), ("total_commits", "(repo_id * 3 + 1)"), ("url", "to_json('https://github.com/owner/repo' || repo_id)")]
_SUM_OBJECT = [
    ("total_files_processed", "n"), ("total_bytes_processed", "b"), ("extraction_duration", "'null'"), ("files_by_extension", "types"),
    ("largest_file", _pretty_file("f.", 2)), ("average_file_size", "a"),
]
_USED_OBJECT = [("extensions", _pretty_list(FILTERS.extensions)), ("max_file_size", "20000"), ("exclude_dirs", _pretty_list(FILTERS.exclude_dirs)), ("preserve_structure", "'true'")]
_REPORT_OBJECT = [
    ("repository_info", _pretty(_REPO_OBJECT, 1)), ("extraction_summary", _pretty(_SUM_OBJECT, 1)), ("files", "'[ ' || files || ' ]'"), ("extraction_time", "'null'"),
    ("errors", "coalesce('[ ' || errors || ' ]', '[ ]')"), ("config_used", _pretty(_USED_OBJECT, 1)),
]


@query(
    f"""WITH {FLAT}, {SUMS}, {LARGEST},
    ta AS (SELECT repo_id, '{{' || chr(10) || string_agg('      "' || ext || '" : ' || n, ',' || chr(10) ORDER BY ext) || chr(10) || '    }}' AS types FROM x GROUP BY repo_id),
    fa AS (SELECT repo_id, string_agg({_pretty_file("", 1)}, ', ' ORDER BY parts) AS files FROM l GROUP BY repo_id),
    ea AS (SELECT repo_id, string_agg(CAST(to_json(message) AS VARCHAR), ', ' ORDER BY parts) AS errors FROM e GROUP BY repo_id)
    SELECT repo_id, {_pretty(_REPORT_OBJECT, 0)} AS json FROM w JOIN ta USING (repo_id) JOIN fa USING (repo_id) LEFT JOIN ea USING (repo_id)"""
)
def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = _flat(spark, sf_dir).cache()
    return reports.report_json(reports.report_rows(plan, repositories(plan), CONFIG))


@query(
    f"""WITH {FLAT}, {SUMS}, z AS (SELECT repo_id, string_agg('  ' || replace(ext, 'no_extension', 'no extension') || ': ' || n || ' files', chr(10) ORDER BY n DESC, ext) AS types FROM x GROUP BY repo_id),
    f AS (SELECT repo_id, count(*) AS k, string_agg('  - ' || message, chr(10) ORDER BY parts) AS issues FROM e GROUP BY repo_id),
    q AS (SELECT t.*, types, coalesce(k, 0) AS k, issues, n * 7 + 800 AS ms FROM t JOIN z USING (repo_id) LEFT JOIN f USING (repo_id)),
    d AS (SELECT *, CASE WHEN ms >= 1000 THEN (ms // 1000) || 's' ELSE ms || 'ms' END AS lasted FROM q)
    SELECT repo_id, m AS mode, CASE m WHEN 'plain' THEN concat_ws(chr(10), 'COMPLETED: Documentation extraction', 'Files processed: ' || n, 'Bytes processed: ' || b, printf('Duration: %.3fs', ms / 1000), CASE WHEN k > 0 THEN 'Errors: ' || k END)
      WHEN 'json' THEN '{{' || chr(10) || '  "type" : "summary",' || chr(10) || '  "files_processed" : ' || n || ',' || chr(10) || '  "bytes_processed" : ' || b || ',' || chr(10) || '  "duration_ms" : ' || ms || ',' || chr(10) || '  "errors" : ' || k || chr(10) || '}}'
      ELSE concat_ws(chr(10), '', repeat('-', 60), '✓ Documentation extraction completed!', '', '  Files processed: ' || n, '  Bytes processed: ' || {_bytes_sql("b")}, '  Time taken:      ' || lasted, CASE WHEN k > 0 THEN '  Errors:          ' || k END, repeat('-', 60)) END AS summary,
      CASE m WHEN 'plain' THEN concat_ws(chr(10), 'REPORT: Extraction completed', 'Repository: owner/repo' || repo_id, 'Files: ' || n, 'Size: ' || b || ' bytes', printf('Duration: %.3fs', ms / 1000), CASE WHEN k > 0 THEN 'Errors: ' || k END)
      WHEN 'human' THEN concat_ws(chr(10), '', '=== Extraction Report ===', '', 'Repository: owner/repo' || repo_id, 'URL: https://github.com/owner/repo' || repo_id, 'Extracted at: 2024-02-29 12:34 UTC', '', 'Files by type:' || chr(10) || types || chr(10), 'Issues encountered:' || chr(10) || issues) END AS report
    FROM d, (VALUES ('human'), ('json'), ('plain')) v(m)"""
)
def run_console(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the console shows of a run that took 800 ms and 7 ms for each file."""
    plan = _flat(spark, sf_dir).cache()
    rows = reports.report_rows(plan, repositories(plan), CONFIG, F.lit("2024-02-29 12:34:56Z").cast("timestamp"), listed=False)
    rows = rows.withColumn("mode", F.explode(F.array(*map(F.lit, ("human", "json", "plain")))))
    files, size = (F.col("extraction_summary")[c] for c in ("total_files_processed", "total_bytes_processed"))
    ms = files * 7 + 800
    return rows.select("repo_id", "mode", console.summary(F.col("mode"), files, size, ms, F.size("errors")).alias("summary"), console.report(F.col("mode"), ms).alias("report"))


#: A graph of commits from the documents: each is a commit of its repository, whose parent is the one before it; some are
#: first ones, some branch off three commits back, some merge what was four back. The head is the last that is no draft.
GRAPH = """g AS (SELECT doc_id // 77 AS repo_id, doc_id AS commit_id, doc_id % 77 AS i FROM documents),
    e AS (SELECT repo_id, commit_id, commit_id - CASE WHEN i % 7 = 3 THEN 3 ELSE 1 END AS parent FROM g WHERE i % 19 <> 0 AND (i % 7 <> 3 OR i >= 3)
      UNION ALL SELECT repo_id, commit_id, commit_id - 4 FROM g WHERE i % 19 <> 0 AND i % 5 = 0),
    h AS (SELECT repo_id, max(commit_id) FILTER (i % 11 <> 10 AND i % 77 <> 1) AS head FROM g GROUP BY repo_id)"""


@query(
    f"""WITH RECURSIVE {GRAPH}, r AS (SELECT repo_id, head AS c FROM h WHERE head IS NOT NULL UNION SELECT r.repo_id, e.parent FROM r JOIN e ON e.commit_id = r.c AND e.repo_id = r.repo_id JOIN g ON g.commit_id = e.parent AND g.repo_id = r.repo_id),
    n AS (SELECT repo_id, count(*) AS n FROM r GROUP BY repo_id)
    SELECT repo_id, head, coalesce(n, 0) AS total_commits, n IS NULL AS is_empty FROM h LEFT JOIN n USING (repo_id)"""
)
def commit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.expr("doc_id div 77").alias("repo_id"), F.col("doc_id").alias("commit_id"))
    i, c = F.col("commit_id") % 77, F.col("commit_id")
    first = F.when((i % 7 == 3) & (i >= 3), c - 3).when(i % 7 != 3, c - 1)
    parents = F.when(i % 19 != 0, F.array(first, F.when(i % 5 == 0, c - 4)))
    heads = docs.groupBy("repo_id").agg(F.max(F.when((i % 11 != 10) & (i != 1), c)).alias("commit_id"))
    return commits.commit_counts(docs.withColumn("parents", parents), heads)


#: Files of a small tree, with a link and directories that the rules know.
TREE = ("README", "guide.md", "_index.md", ".dot.md", "_drafts/d.md", ".github/c.md", ".hidden/h.md", "node_modules/x.md", "a/b.md", "a-b/c.md", "main.rs", "empty.txt", "Build/s.md", f"{DEEP}deep.md")


def make_tree(spark: SparkSession | None = None) -> str:
    """A small tree, below the shared folder if that is a mounted one; it goes when the program ends."""
    shared = (spark.conf.get("spark.checkpoint.dir", None) if spark else None) or ""
    shared = shared.removeprefix("file://")
    root = tempfile.mkdtemp(prefix="leafmill-tree-", dir=shared if os.path.isdir(shared) else None)
    atexit.register(shutil.rmtree, root, True)
    for i, name in enumerate(TREE):
        os.makedirs(os.path.dirname(os.path.join(root, name)), exist_ok=True)
        with open(os.path.join(root, name), "w") as f:
            f.write("" if name.startswith("empty") else f"file {i}\n")
    os.symlink(os.path.join(root, "guide.md"), os.path.join(root, "link.md"))
    return root


def document_tree(spark: SparkSession, sf_dir: str) -> str:
    """The documents as files of a tree, a folder for each repository, below the shared folder; it goes when the program ends."""
    root = os.path.join(shared_dir(spark).removeprefix("file://"), f"tree-{uuid.uuid4().hex}")
    atexit.register(shutil.rmtree, root, True)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    place = F.concat(F.lit("r"), F.expr(f"doc_id div {REPO_FILES}"), F.lit("/"), document_path())
    write_files(docs.select(place.alias("dest"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content")), root)
    return root


def _tree_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_directory(spark, document_tree(spark, sf_dir), FILTERS)
    return predicates.documentation(found.where("error IS NULL"), FILTERS)


@query(f"WITH {KEPT} SELECT 'r' || repo_id || '/' || relative_path AS relative_path, filename, extension, size FROM k")
def fs_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tree_kept(spark, sf_dir).select("relative_path", "filename", "extension", "size")
    return rows.where(~F.col("relative_path").startswith(".leafmill/")).orderBy(paths.parts(F.col("relative_path")))


@query(
    f"""WITH {KEPT} SELECT 'r' || repo_id || '/' || relative_path AS dest, size AS bytes_copied, sha256(text) AS sha256, CAST(NULL AS VARCHAR) AS failure
    FROM k JOIN documents USING (doc_id)"""
)
def copy_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = copyplan.plan_copy(_tree_kept(spark, sf_dir))
    out = os.path.join(shared_dir(spark).removeprefix("file://"), f"copy-{uuid.uuid4().hex}")
    atexit.register(shutil.rmtree, out, True)
    return copyplan.copy_files(plan, out).select("dest", "bytes_copied", "sha256", "failure")
