"""Ranks over large groups without bringing a group together in one task.

An order is cut into buckets that follow it; bucket sizes are counted and summed (a small table),
and rows are numbered inside their bucket only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm.common import free_name, join_checked

ROWS_PER_BUCKET = 4_000


def bucket_count(rows: int) -> int:
    return max(64, -(-rows // ROWS_PER_BUCKET))


def shuffle_key(seed: int, key: str, df: DataFrame) -> Column:
    """A hex string that orders rows as a seeded shuffle of their keys does; rows without a key go by their other columns."""
    rest = F.xxhash64(*[f.name for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)])
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.concat(F.lit("\0"), rest.cast("string")))))


def hex_bucket(hexed: Column, buckets: int) -> Column:
    """Which of so many equal ranges a hex string lies in."""
    return F.floor(F.conv(F.substring(hexed, 1, 8), 16, 10).cast("long") * buckets / F.lit(1 << 32)).cast("int")


def with_rank(df: DataFrame, name: str, group: Sequence[str], bucket: Column, order: Sequence[str]) -> DataFrame:
    """Adds ``name``, the 0-based rank in the group by (bucket, order). Group columns must not be null."""
    b, before = free_name(df, "bucket_"), free_name(df, "before_")
    df = df.withColumn(b, bucket)
    sizes = df.groupBy(*group, b).agg(F.count("*").alias("n_"))
    below = Window.partitionBy(*group).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*group, b, F.coalesce(F.sum("n_").over(below), F.lit(0)).alias(before))
    inside = Window.partitionBy(*group, b).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(inside) - 1)
    out = join_checked(out, starts, [*group, b], "inner")
    return out.withColumn(name, (F.col(name) + F.col(before)).cast("long")).drop(b, before)


def stratum(source: Column) -> Column:
    """The source as a key without nulls; null is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))
