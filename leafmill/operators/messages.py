"""Kinds of failures with their texts, hints and exit codes, and messages in three modes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Failure kinds with message prefix, hint (if any) and exit code.
KINDS: dict[str, tuple[str, str | None, int]] = {
    "git": ("Git operation failed: ", None, 1),
    "io": ("IO operation failed: ", None, 1),
    "invalid_url": ("Invalid repository URL: ", "Please check that the URL is a valid GitHub repository URL (e.g., https://github.com/owner/repo)", 2),
    "repository_not_found": ("Repository not found: ", "Verify the repository exists and you have access to it. For private repositories, set the GITHUB_TOKEN environment variable.", 3),
    "authentication_failed": ("Authentication failed for: ", "Set the GITHUB_TOKEN environment variable with a valid personal access token for private repositories.", 4),
    "network": ("Network error: ", "Check your internet connection and try again. If the problem persists, the repository server might be temporarily unavailable.", 5),
    "no_documentation": ("No documentation files found with extensions: ", "Try using different file extensions with --formats (e.g., --formats md,rst,txt,adoc) or check if the repository contains documentation files.", 6),
    "config": ("Configuration error: ", "Check your configuration file syntax and ensure all required fields are present.", 1),
    "permission": ("Permission denied accessing: ", "Ensure you have the necessary read/write permissions for the target directory.", 7),
    "cancelled": ("Operation was cancelled by user", None, 130),
    "timeout": ("Operation timed out after ", "The operation took longer than expected. Try again or increase the timeout with --timeout.", 9),
    "file_too_large": ("File too large: ", "Increase the maximum file size limit with --max-size or exclude large files.", 1),
    "invalid_path": ("Invalid file path: ", None, 1),
    "output_exists": ("Output directory already exists: ", "Remove the existing directory, choose a different output name with --output, or use --force to overwrite.", 8),
}
OK, OK_WITH_ERRORS, OTHER = 0, 2, 1
GLYPHS = {"success": "✓", "error": "✗", "warning": "!", "info": "i"}
PLAIN = {"success": "SUCCESS", "error": "ERROR", "warning": "WARNING", "info": "INFO", "debug": "DEBUG", "operation_start": "STARTING"}
LEAST_VERBOSITY = {"operation_start": 0, "warning": 1, "info": 1, "debug": 2}
# End of fixed values.


def _of_kind(kind: Column, values: dict[str, object], default: object = None) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(kind == k, F.lit(v)).otherwise(out)
    return out


def message(kind: Column, detail: Column) -> Column:
    text = _of_kind(kind, {k: v[0] for k, v in KINDS.items()})
    tail = F.when(kind == "timeout", F.concat(detail, F.lit(" seconds"))).when(kind == "cancelled", F.lit("")).otherwise(detail)
    return F.concat(text, tail)


def hint(kind: Column) -> Column:
    return _of_kind(kind, {k: v[1] for k, v in KINDS.items() if v[1]})


def exit_code(kind: Column, errors: Column) -> Column:
    """Of a run: by the failure's kind, or, without one, by the number of copy errors."""
    of = _of_kind(kind, {k: v[2] for k, v in KINDS.items()}, OTHER)
    return F.when(kind.isNull(), F.when(errors > 0, OK_WITH_ERRORS).otherwise(OK)).otherwise(of).cast("int")


def classify_git(error_class: Column, code: Column) -> Column:
    """Failure kind of a Git library's error."""
    return (
        F.when((error_class == "net") & (code == "generic"), F.lit("network"))
        .when((error_class == "http") & (code == "auth"), F.lit("authentication_failed"))
        .when((error_class == "http") & (code == "not_found"), F.lit("repository_not_found"))
        .otherwise(F.lit("git"))
    )


def mode(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.isin("json", "plain"), low).otherwise(F.lit("human"))


def verbosity(verbose: Column, quiet: Column) -> Column:
    return F.when(quiet, F.lit(0)).otherwise(verbose)


def is_shown(level: Column, verbose: Column, quiet: Column) -> Column:
    """Successes and errors always; others from their verbosity on, unless quiet."""
    return level.isin("success", "error") | (~quiet & (verbose >= _of_kind(level, LEAST_VERBOSITY, 0)))


def render(in_mode: Column, level: Column, text: Column, time: Column | None = None) -> Column:
    """One message; JSON has a timestamp if ``time`` is given."""
    prefix = F.when(level == "debug", F.lit("  DEBUG:")).when(level == "operation_start", F.lit(">")).otherwise(_of_kind(level, GLYPHS))
    fields = [F.lit("message").alias("type"), level.alias("level"), text.alias("message"), *([time.alias("timestamp")] if time is not None else [])]
    plain = F.concat(_of_kind(level, PLAIN), F.lit(": "), text)
    return F.when(in_mode == "json", F.to_json(F.struct(*fields))).when(in_mode == "plain", plain).otherwise(F.concat(prefix, F.lit(" "), text))


def to_stderr(in_mode: Column, level: Column) -> Column:
    return (level == "error") & (in_mode != "json")
