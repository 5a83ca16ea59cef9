"""What a run tells on the console when it ends: a summary, and the report, in three modes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.text import format_bytes, format_duration, shown_extension, utc_text

RULE = "-" * 60


def _text(*lines: Column | str | None) -> Column:
    """Lines as one text; null ones are left out."""
    given = [F.lit(x) if isinstance(x, str) else x for x in lines if x is not None]
    return F.array_join(F.array(*given), "\n")


def _if_any(errors: Column, form: str) -> Column:
    return F.when(errors > 0, F.format_string(form, errors))


def _seconds(milliseconds: Column) -> Column:
    return F.format_string("%.3fs", milliseconds / 1000)


def summary(mode: Column, files: Column, size: Column, milliseconds: Column, errors: Column, time: Column | None = None) -> Column:
    """Numbers of a run. The JSON form has a timestamp if ``time`` is given."""
    fields = [F.lit("summary").alias("type"), files.alias("files_processed"), size.alias("bytes_processed"), milliseconds.alias("duration_ms"), errors.alias("errors")]
    fields += [time.alias("timestamp")] if time is not None else []
    plain = _text(
        "COMPLETED: Documentation extraction", F.format_string("Files processed: %d", files), F.format_string("Bytes processed: %d", size),
        F.concat(F.lit("Duration: "), _seconds(milliseconds)), _if_any(errors, "Errors: %d"),
    )
    human = _text(
        "", RULE, "✓ Documentation extraction completed!", "", F.format_string("  Files processed: %d", files),
        F.concat(F.lit("  Bytes processed: "), format_bytes(size)), F.concat(F.lit("  Time taken:      "), format_duration(milliseconds)),
        _if_any(errors, "  Errors:          %d"), RULE,
    )
    return F.when(mode == "json", F.to_json(F.struct(*fields), {"pretty": "true"})).when(mode == "plain", plain).otherwise(human)


def report(mode: Column, milliseconds: Column) -> Column:
    """The report of a row of ``reports.report_rows``; null in JSON mode, where it is that row itself as JSON."""
    repo, numbers = F.col("repository_info"), F.col("extraction_summary")
    named = F.format_string("Repository: %s/%s", repo["owner"], repo["name"])
    plain = _text(
        "REPORT: Extraction completed", named, F.format_string("Files: %d", numbers["total_files_processed"]),
        F.format_string("Size: %d bytes", numbers["total_bytes_processed"]), F.concat(F.lit("Duration: "), _seconds(milliseconds)),
        _if_any(F.size("errors"), "Errors: %d"),
    )
    ranked = F.array_sort(F.transform(F.map_entries(numbers["files_by_extension"]), lambda x: F.struct((-x["value"]).alias("less"), x["key"].alias("ext"))))
    types = F.transform(ranked, lambda x: F.format_string("  %s: %d files", shown_extension(x["ext"]), -x["less"]))
    typed = F.when(F.size(types) > 0, F.concat(F.lit("Files by type:\n"), F.array_join(types, "\n"), F.lit("\n")))
    issues = F.when(F.size("errors") > 0, F.concat(F.lit("Issues encountered:\n"), F.array_join(F.transform("errors", lambda x: F.concat(F.lit("  - "), x)), "\n")))
    at = F.when(F.col("extraction_time").isNotNull(), F.concat(F.lit("Extracted at: "), utc_text(F.col("extraction_time"), False)))
    human = _text("", "=== Extraction Report ===", "", named, F.concat(F.lit("URL: "), repo["url"]), at, "", typed, issues)
    return F.when(mode == "plain", plain).when(mode == "human", human)
