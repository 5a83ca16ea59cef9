"""Index and reports of an extraction, as tables of numbered lines or as one nested row for each repository.

``repos`` has repo_id, owner, name, url, default_branch, total_commits, is_empty. Wall-clock values
(time and duration as text) are parameters; lines with them are left out where they are None.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.config import Config
from leafmill.functions import paths
from leafmill.functions.text import format_bytes, shown_extension
from leafmill.operators import copyplan, ranks, stats

TOOL = "leafmill"


def index_sections(catalog: DataFrame) -> DataFrame:
    """Files and bytes of each directory."""
    where = paths.parent(F.col("relative_path"))
    return catalog.groupBy("repo_id", where.alias("dir")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def _line(order: list, text: Column | str) -> Column:
    """A line and the columns it is ordered by: section, directory or rank, part of the section, place."""
    section, group, part, place = order
    text = F.lit(text) if isinstance(text, str) else text
    as_array = place if isinstance(place, Column) else F.array(F.lit(place))
    as_group = group if isinstance(group, Column) else F.lit(group)
    return F.struct(F.lit(section).alias("s"), as_group.alias("g"), F.lit(part).alias("p"), as_array.alias("k"), text.alias("line"))


def _together(lines: list[DataFrame]) -> tuple[DataFrame, Column]:
    """All lines, and what orders them."""
    rows = reduce(DataFrame.unionByName, lines)
    return rows, F.concat(F.array("x.s", "x.g", F.lpad(F.col("x.p").cast("string"), 3, "0")), F.coalesce("x.k", F.array().cast("array<string>")))


def _numbered(lines: list[DataFrame]) -> DataFrame:
    rows, order = _together(lines)
    return ranks.with_ordinal(rows, "repo_id", order).select("repo_id", "ordinal", F.col("x.line").alias("line"))


def _exploded(df: DataFrame, *lines: Column) -> DataFrame:
    return df.select("repo_id", F.explode(F.array(*lines)).alias("x"))


def index_lines(catalog: DataFrame, preserve: bool = True, time: str | None = None) -> DataFrame:
    """The index: a section for each directory in byte order, files in the order of the walk, totals."""
    path = F.col("relative_path")
    files = catalog.withColumn("dir", paths.parent(path)).withColumn("parts", paths.parts(path))
    head = [_line(["a", "", 0, ""], "# Documentation Index"), _line(["a", "", 1, ""], "")]
    if time is not None:
        head += [_line(["a", "", 2, ""], f"Generated by {TOOL} on {time}"), _line(["a", "", 3, ""], "")]
    section = [_line(["b", F.col("dir"), 0, ""], F.concat(F.lit("## "), F.col("dir"), F.lit("/"))), _line(["b", F.col("dir"), 1, ""], ""), _line(["b", F.col("dir"), 3, ""], "")]
    entry = F.format_string("- [%s](%s) (%d bytes)", F.col("filename"), paths.link(path, preserve), F.col("size"))
    totals = catalog.groupBy("repo_id").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    foot = [
        _line(["c", "", 0, ""], "---"),
        _line(["c", "", 1, ""], F.format_string("Total files: %d", F.col("files"))),
        _line(["c", "", 2, ""], F.format_string("Total size: %d bytes", F.col("bytes"))),
    ]
    return _numbered(
        [
            _exploded(totals, *head),
            _exploded(files.select("repo_id", "dir").distinct(), *section),
            _exploded(files, _line(["b", F.col("dir"), 2, F.col("parts")], entry)),
            _exploded(totals, *foot),
        ]
    )


def _by_extension(plan: DataFrame, section: str, row: Column, title: str, gap: bool) -> list[DataFrame]:
    """Title, counts (most first, ties by extension), and a blank line."""
    counts = stats.extension_counts(plan).withColumn("g", F.format_string("%019d", F.lit((1 << 62) - 1) - F.col("files")))
    repos = counts.select("repo_id").distinct()
    top = [_line([section, "", 0, ""], title), *([_line([section, "", 1, ""], "")] if gap else [])]
    return [_exploded(repos, *top, _line([section, "~", 9, ""], "")), _exploded(counts, _line([section, F.col("g"), 2, F.array("ext")], row))]


def _error_lines(plan: DataFrame, section: str, title: str, mark: str, gap: bool) -> list[DataFrame]:
    bad = copyplan.failures(plan)
    top = [_line([section, "", 0, ""], title), *([_line([section, "", 1, ""], "")] if gap else [])]
    row = _line([section, "", 2, F.col("parts")], F.concat(F.lit(mark), F.col("message")))
    return [_exploded(bad.select("repo_id").distinct(), *top, _line([section, "~", 9, ""], "")), _exploded(bad, row)]


def _sized(label: str, column: str) -> Column:
    return F.format_string(f"  {label}: %d (%s)", F.col(column), format_bytes(F.col(column)))


def text_lines(plan: DataFrame, repos: DataFrame, config: Config, time: str | None = None, duration: str | None = None) -> DataFrame:
    """The plain report."""
    known = repos.join(stats.report_summary(plan), "repo_id")
    f, kept = config.filters, str(config.output.preserve_structure).lower()
    plain = [
        "Documentation Extraction Report", "===============================", "",
        F.format_string("Repository: %s/%s", F.col("owner"), F.col("name")),
        F.concat(F.lit("URL: "), F.col("url")),
        F.concat(F.lit("Branch: "), F.col("default_branch")),
        F.format_string("Total commits: %d", F.col("total_commits")),
        F.concat(F.lit("Repository empty: "), F.col("is_empty").cast("string")),
        "", "Extraction Summary:",
        *([f"  Extracted at: {time}"] if time is not None else []),
        *([f"  Duration: {duration}"] if duration is not None else []),
        F.format_string("  Files processed: %d", F.col("files_processed")),
        _sized("Bytes processed", "bytes_processed"),
        _sized("Average file size", "average_size"),
        "",
    ]
    top = [
        "Largest file:", F.concat(F.lit("  Name: "), paths.filename(F.col("largest_path"))), F.concat(F.lit("  Path: "), F.col("largest_path")),
        _sized("Size", "largest_size"), "",
        "Configuration used:", f"  Extensions: {', '.join(f.extensions)}",
        F.format_string("  Max file size: %d (%s)", F.lit(f.max_file_size), format_bytes(F.lit(f.max_file_size))),
        f"  Excluded directories: {', '.join(f.exclude_dirs)}", f"  Preserve structure: {kept}", "",
    ]
    entry = F.format_string("  %s (%d bytes) - %s", F.col("relative_path"), F.col("size"), F.col("extension"))
    return _numbered(
        [
            _exploded(known, *[_line(["a", "", i, ""], x) for i, x in enumerate(plain)]),
            *_by_extension(plan, "b", F.format_string("  %s: %d files", F.col("ext"), F.col("files")), "Files by extension:", False),
            _exploded(known, *[_line(["c", "", i, ""], x) for i, x in enumerate(top)]),
            *_error_lines(plan, "d", "Errors encountered:", "  - ", False),
            _exploded(known, _line(["e", "", 0, ""], "Extracted files:")),
            _exploded(plan, _line(["e", "", 1, F.col("parts")], entry)),
        ]
    )


def summary_lines(plan: DataFrame, repos: DataFrame, time: str | None = None, duration: str | None = None) -> DataFrame:
    """The summary in Markdown."""
    known = repos.join(stats.report_summary(plan), "repo_id")
    head = [
        "# Documentation Extraction Summary", "",
        F.format_string("**Repository:** [%s/%s](%s)", F.col("owner"), F.col("name"), F.col("url")),
        *([f"**Extracted:** {time}"] if time is not None else []),
        *([f"**Duration:** {duration}"] if duration is not None else []),
        "", "## Statistics", "",
        F.format_string("- **Files processed:** %d", F.col("files_processed")),
        F.concat(F.lit("- **Total size:** "), format_bytes(F.col("bytes_processed"))),
        F.concat(F.lit("- **Average file size:** "), format_bytes(F.col("average_size"))),
        "",
    ]
    row = F.format_string("- **%s**: %d files", shown_extension(F.col("ext")), F.col("files"))
    return _numbered(
        [
            _exploded(known, *[_line(["a", "", i, ""], x) for i, x in enumerate(head)]),
            *_by_extension(plan, "b", row, "## File Types", True),
            *_error_lines(plan, "c", "## Issues Encountered", "- ", True),
            _exploded(known, _line(["d", "", 0, ""], "---"), _line(["d", "", 1, ""], f"*Generated by {TOOL}*")),
        ]
    )


def scan_summary(catalog: DataFrame) -> DataFrame:
    """Several lines on what a scan found, as one text for each repository."""
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("files")).alias("less"), "ext", "files")))
    types = stats.extension_counts(catalog).groupBy("repo_id").agg(ranked.alias("types"))
    found = stats.scan_statistics(catalog).join(types, "repo_id")
    each = F.transform("types", lambda x: F.format_string("    %s: %d files", x["ext"], x["files"]))
    top = F.when(F.col("largest_size") > 0, F.concat(F.lit("  Largest file: "), F.col("largest_path"), F.lit(" ("), format_bytes(F.col("largest_size")), F.lit(")")))
    lines = F.concat(
        F.array(F.lit("Scan Results:"), F.format_string("  Total files: %d", F.col("total_files")), F.concat(F.lit("  Total size: "), format_bytes(F.col("total_size"))), F.lit("  Files by type:")),
        each,
        F.when(top.isNotNull(), F.array(top)).otherwise(F.array().cast("array<string>")),
    )
    return found.select("repo_id", F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("summary"))


def repository_summary() -> Column:
    return F.format_string("Repository: %s/%s\nBranch: %s\nCommits: %d\nEmpty: %s", F.col("owner"), F.col("name"), F.col("default_branch"), F.col("total_commits"), F.col("is_empty").cast("string"))


def _since_epoch(plan: DataFrame) -> Column:
    """When a file was changed, as seconds and nanoseconds; null where the catalog does not tell."""
    micros = F.unix_micros("modified") if "modified" in plan.columns else F.lit(None).cast("long")
    parts = F.struct(F.floor(micros / 1_000_000).cast("long").alias("secs_since_epoch"), (F.pmod(micros, F.lit(1_000_000)) * 1000).alias("nanos_since_epoch"))
    return F.when(micros.isNotNull(), parts)


def _duration(milliseconds: Column | None) -> Column:
    ms = F.lit(None).cast("long") if milliseconds is None else milliseconds.cast("long")
    return F.when(ms.isNotNull(), F.struct(F.floor(ms / 1000).cast("long").alias("secs"), (ms % 1000 * 1_000_000).alias("nanos")))


def _file(plan: DataFrame) -> Column:
    return F.struct("filename", "relative_path", "extension", "size", _since_epoch(plan).alias("modified"))


def _known(plan: DataFrame, repos: DataFrame) -> DataFrame:
    """Repositories with their totals and the record of the largest file, the first of equal ones."""
    first = F.struct((-F.col("size")).alias("less"), "parts")
    largest = plan.groupBy("repo_id").agg(F.min_by(_file(plan), first).alias("largest_file"))
    return repos.join(stats.report_summary(plan), "repo_id").join(largest, "repo_id")


def _described() -> Column:
    return F.struct("name", "owner", "default_branch", "is_empty", "total_commits", "url")


def _used(config: Config) -> Column:
    f = config.filters
    return F.struct(
        F.array(*map(F.lit, f.extensions)).alias("extensions"), F.lit(f.max_file_size).cast("long").alias("max_file_size"),
        F.array(*map(F.lit, f.exclude_dirs)).alias("exclude_dirs"), F.lit(config.output.preserve_structure).alias("preserve_structure"),
    )


def report_rows(plan: DataFrame, repos: DataFrame, config: Config, time: Column | None = None, duration_ms: Column | None = None, listed: bool = True) -> DataFrame:
    """One nested row for each repository: the report as data. Its files are those scanned, in the order of the walk.

    Without ``listed`` there are no files in it, and its size goes with the errors. ``json_lines`` has no such rows.
    """
    bad = copyplan.failures(plan).groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct("parts", "message"))).alias("errors"))
    known = _known(plan, repos).join(stats.counts_map(plan), "repo_id").join(bad, "repo_id", "left")
    if listed:
        files = F.array_sort(F.collect_list(F.struct("parts", _file(plan).alias("f"))))
        known = known.join(plan.groupBy("repo_id").agg(files.alias("files")), "repo_id")
    summary = F.struct(
        F.col("files_processed").alias("total_files_processed"), F.col("bytes_processed").alias("total_bytes_processed"),
        _duration(duration_ms).alias("extraction_duration"),
        "files_by_extension", "largest_file", F.col("average_size").alias("average_file_size"),
    )
    return known.select(
        "repo_id",
        _described().alias("repository_info"),
        summary.alias("extraction_summary"),
        *([F.transform("files", lambda x: x["f"]).alias("files")] if listed else []),
        (time if time is not None else F.lit(None).cast("timestamp")).alias("extraction_time"),
        F.coalesce(F.transform("errors", lambda x: x["message"]), F.array().cast("array<string>")).alias("errors"),
        _used(config).alias("config_used"),
    )


def _json(value: Column) -> Column:
    """A value of any type as JSON; null as null."""
    whole = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def _entry(indent: str, name: str, value: Column, more: bool = True) -> Column:
    return F.concat(F.lit(f'{indent}"{name}": '), _json(value), F.lit("," if more else ""))


def json_lines(plan: DataFrame, repos: DataFrame, config: Config, time: Column | None = None, duration_ms: Column | None = None) -> DataFrame:
    """The report as one JSON document, in lines: a file, an error or an extension is a line of its own.

    No row grows with a repository. Joined by line breaks they are the data of ``report_rows``.
    """
    known = _known(plan, repos)
    head = [
        "{", _entry("  ", "repository_info", _described()), '  "extraction_summary": {',
        _entry("    ", "total_files_processed", F.col("files_processed")), _entry("    ", "total_bytes_processed", F.col("bytes_processed")),
        _entry("    ", "extraction_duration", _duration(duration_ms)), '    "files_by_extension": {',
    ]
    middle = ["    },", _entry("    ", "largest_file", F.col("largest_file")), _entry("    ", "average_file_size", F.col("average_size"), False), "  },", '  "files": [']
    after = ["  ],", _entry("  ", "extraction_time", time if time is not None else F.lit(None).cast("timestamp")), '  "errors": [']
    foot = ["  ],", _entry("  ", "config_used", _used(config), False), "}"]
    fixed = [_line([section, "", i, ""], x) for section, lines in zip("aceg", (head, middle, after, foot), strict=True) for i, x in enumerate(lines)]
    kind = F.concat(F.lit("      "), _json(F.col("ext")), F.lit(": "), F.col("files").cast("string"))
    rows, order = _together(
        [
            _exploded(known, *fixed),
            _exploded(stats.extension_counts(plan), _line(["b", "", 0, F.array("ext")], kind)),
            _exploded(plan, _line(["d", "", 0, F.col("parts")], F.concat(F.lit("    "), _json(_file(plan))))),
            _exploded(copyplan.failures(plan), _line(["f", "", 0, F.col("parts")], F.concat(F.lit("    "), _json(F.col("message"))))),
        ]
    )
    listed = {"b": "types", "d": "files", "f": "errors"}  # all of these but the last end with a comma
    sums = {"ordinal": F.lit(1), **{name: (F.col("x.s") == section).cast("long") for section, name in listed.items()}}
    out = ranks.running(rows, "repo_id", order, sums, {name: f"all_{name}" for name in listed.values()})
    more = reduce(lambda a, b: a | b, [(F.col("x.s") == section) & (F.col(name) < F.col(f"all_{name}")) for section, name in listed.items()])
    return out.select("repo_id", F.col("ordinal").cast("int").alias("ordinal"), F.concat("x.line", F.when(more, F.lit(",")).otherwise(F.lit(""))).alias("line"))


def report_json(report: DataFrame, pretty: bool = True) -> DataFrame:
    """Reports as JSON text; absent values are written as null."""
    body = F.struct(*[c for c in report.columns if c != "repo_id"])
    return report.select("repo_id", F.to_json(body, {"ignoreNullFields": "false", "pretty": str(pretty).lower()}).alias("json"))
