"""Statistics of catalogs, for each repository. Ties follow the order of the walk (path components)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import paths


def extension_key() -> Column:
    return F.when(F.col("extension") == "", F.lit("no_extension")).otherwise(F.col("extension"))


def extension_counts(catalog: DataFrame, by: tuple[str, ...] = ("repo_id",)) -> DataFrame:
    """Files of each extension."""
    return catalog.groupBy(*by, extension_key().alias("ext")).agg(F.count("*").alias("files"))


def _walk(path: Column) -> Column:
    return paths.parts(path)


def largest_last(size: Column, path: Column) -> Column:
    """(size, path) of the largest file, the last of equal ones."""
    return F.max(F.struct(size.alias("size"), _walk(path).alias("parts"), path.alias("path")))


def largest_first(size: Column, path: Column) -> Column:
    """(size, path) of the largest file, the first of equal ones."""
    return F.min(F.struct((-size).alias("less"), _walk(path).alias("parts"), size.alias("size"), path.alias("path")))


def scan_statistics(catalog: DataFrame) -> DataFrame:
    """Files, bytes and the largest file of each repository, as the scan reports them."""
    found = catalog.groupBy("repo_id").agg(
        F.count("*").alias("total_files"), F.sum("size").alias("total_size"), largest_last(F.col("size"), F.col("relative_path")).alias("top")
    )
    return found.select("repo_id", "total_files", "total_size", F.col("top.size").alias("largest_size"), F.col("top.path").alias("largest_path"))


def report_summary(copy_log: DataFrame) -> DataFrame:
    """Totals of what was copied; mean size (whole bytes) and largest file of what was scanned."""
    good = F.col("reject_reason").isNull()
    found = copy_log.groupBy("repo_id").agg(
        F.count_if(good).alias("files_processed"),
        F.coalesce(F.sum(F.when(good, F.col("size"))), F.lit(0)).cast("long").alias("bytes_processed"),
        F.count("*").alias("n"),
        F.sum("size").alias("bytes"),
        largest_first(F.col("size"), F.col("relative_path")).alias("top"),
    )
    return found.select(
        "repo_id", "files_processed", "bytes_processed", F.expr("bytes div n").alias("average_size"),
        F.col("top.size").alias("largest_size"), F.col("top.path").alias("largest_path"),
    )


def counts_map(catalog: DataFrame) -> DataFrame:
    """Files of each extension as one map for each repository, sorted by extension."""
    pairs = F.array_sort(F.collect_list(F.struct("ext", "files")))
    return extension_counts(catalog).groupBy("repo_id").agg(F.map_from_entries(pairs).alias("files_by_extension"))


def fetch_progress(received: Column, total: Column, indexed: Column, deltas: Column, received_bytes: Column) -> Column:
    """Whole percent and message of a fetch."""
    percent = F.when(total > 0, F.floor(received * 100 / total)).otherwise(F.lit(0)).cast("long")
    objects = F.format_string("Receiving objects %d/%d (%.1f KB)", received, total, F.bround(received_bytes / F.lit(1024.0), 1))
    message = F.when(total <= 0, F.lit("Counting objects...")).when((received == total) & (deltas > 0), F.format_string("Resolving deltas %d/%d", indexed, deltas)).otherwise(objects)
    return F.struct(percent.alias("percent"), message.alias("message"))
