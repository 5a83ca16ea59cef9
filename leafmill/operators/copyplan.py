"""Where files go, which copies fail, and how a copy proceeds: all decided before a byte is moved."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import paths
from leafmill.operators import ranks
from leafmill.operators.predicates import path_problem
from leafmill.sources.file_sink import write_files

#: Names of generated files, which replace copies of the same name.
INDEX, SUMMARY, METADATA = "_index.md", "EXTRACTION_SUMMARY.md", ".leafmill"


def plan_copy(catalog: DataFrame, preserve: bool = True, force: bool = False) -> DataFrame:
    """The catalog with ``dest``, ``reject_reason`` (null: taken), ``replaced``, and ``shadowed`` (by a generated file).

    The first file of the walk takes a destination, and later ones are rejected. With ``force`` the
    last one takes it; those before it are taken too, but ``replaced``, and not written.

    The first path of each destination is a minimum, which is taken before rows meet, and is joined
    back to them; only rows that repeat one and the same path are numbered. So the files of a common
    name, every README of a repository, are never in one task.
    """
    flat = catalog.withColumn("parts", paths.parts(F.col("relative_path")))
    flat = flat.withColumn("dest", F.col("relative_path") if preserve else paths.filename(F.col("relative_path")))
    flat = flat.withColumn("problem_", path_problem(F.col("dest")))
    flat = flat.withColumn("sound_", F.col("problem_").isNull()).withColumn("owner_", F.coalesce(F.col("repo_id").cast("string"), F.lit("")))
    twin = F.row_number().over(Window.partitionBy("owner_", "parts").orderBy("size")) > 1
    if preserve:  # a destination is a path, so only repeated paths meet
        flat = flat.withColumn("other_", twin)
    else:
        winner = (F.max if force else F.min)("parts").alias("winner_")
        winners = flat.groupBy("owner_", "dest", "sound_").agg(winner)
        flat = flat.withColumn("twin_", twin).join(winners, ["owner_", "dest", "sound_"])
        flat = flat.withColumn("other_", (F.col("parts") != F.col("winner_")) | F.col("twin_"))
    reason = F.coalesce("problem_", F.when(F.lit(not force) & F.col("other_"), F.lit("exists")))
    flat = flat.withColumn("reject_reason", reason).withColumn("replaced", reason.isNull() & F.col("other_"))
    return flat.withColumn("shadowed", reason.isNull() & F.col("dest").isin(INDEX, SUMMARY)).select(*catalog.columns, "parts", "dest", "reject_reason", "replaced", "shadowed")


def failure_message() -> Column:
    """The ledger's line for a rejected copy."""
    name = paths.filename(F.col("dest"))
    why = (
        F.when(F.col("reject_reason") == "exists", F.concat(F.lit("Output directory already exists: "), F.col("dest")))
        .when(F.col("reject_reason") == "traversal", F.concat(F.lit("Path validation failed: Directory traversal not allowed: "), F.col("dest")))
        .when(F.col("reject_reason") == "too_long", F.format_string("Path validation failed: Path too long: %d characters", F.octet_length("dest")))
        .when(F.col("reject_reason") == "invalid_characters", F.concat(F.lit("Path validation failed: Filename contains invalid characters: "), name))
        .otherwise(F.concat(F.lit("Path validation failed: Filename cannot end with space or dot: "), name))
    )
    return F.concat(F.lit("Failed to copy "), F.col("relative_path"), F.lit(": "), why)


def failures(plan: DataFrame) -> DataFrame:
    """Failed copies with their ``message``."""
    return plan.where("reject_reason IS NOT NULL").withColumn("message", failure_message())


def error_ledger(plan: DataFrame) -> DataFrame:
    """Failures of each repository, in the order of the walk."""
    return ranks.with_ordinal(failures(plan), "repo_id", F.col("parts")).select("repo_id", "ordinal", "relative_path", "message")


def percent_complete(done: Column, total: Column) -> Column:
    return F.when(total > 0, done / total * 100).otherwise(F.lit(0.0))


def remaining_seconds(done: Column, total: Column, elapsed: Column) -> Column:
    """What the rest takes at the rate so far; 0 before the first file."""
    return F.when((done > 0) & (elapsed > 0), (total - done) / (done / elapsed)).otherwise(F.lit(0.0))


def progress_trace(plan: DataFrame) -> DataFrame:
    """State after each file of the walk: only copies that succeed count."""
    good = F.col("reject_reason").isNull()
    sums = {
        "ordinal": F.lit(1),
        "files_processed": good.cast("long"),
        "bytes_processed": F.when(good, F.coalesce("size", F.lit(0))).otherwise(F.lit(0)),
        "scanned_": F.coalesce("size", F.lit(0)),
    }
    out = ranks.running(plan, "repo_id", F.col("parts"), sums, {"ordinal": "total_files", "scanned_": "total_bytes"})
    out = out.select("repo_id", "relative_path", F.col("ordinal").cast("int").alias("ordinal"), "files_processed", "bytes_processed", "total_files", "total_bytes")
    return out.withColumn("percent", percent_complete(F.col("files_processed"), F.col("total_files")))


def copy_files(plan: DataFrame, out: str, overwrite: bool = False, progress: Callable[[int, int], None] | None = None) -> DataFrame:
    """Copies the files of a plan that are taken and not replaced below ``out``, all of them or none; returns the ledger.

    The ledger has source_path, dest, bytes_copied, sha256 and failure of each. ``out`` must not be there,
    unless ``overwrite`` replaces it as a whole. ``progress`` is told of files and bytes as tasks end.
    """
    rows = plan.where("reject_reason IS NULL AND NOT replaced").select("dest", "source_path")
    return write_files(rows, out, overwrite, progress)
