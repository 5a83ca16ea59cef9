"""Ordinals and running sums inside large groups without bringing a group together in one task.

The order of all rows is cut into ranges at the sort keys of a sample, as a range partitioning does.
Sums of each range of a group are a small table, whose own running sums are where the ranges start;
rows are numbered and summed inside their range only. The sample decides where the cuts are, and
never a result.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys that the cuts are made at: those with the smallest hashes. The driver holds no more.
EDGES = 256


def sort_text(order: Column) -> Column:
    """An array of strings as one string that sorts, byte by byte, as the array does place by place.

    Each place ends with the byte 0 and begins with 2, or is the byte 1 where it is null; bytes 0 and 1 inside of a place are
    replaced by pairs that begin with 1.
    """

    def place(x: Column) -> Column:
        body = F.when(x.rlike("[\\x00\\x01]"), F.replace(F.replace(x, F.lit("\x01"), F.lit("\x01\x02")), F.lit("\x00"), F.lit("\x01\x01"))).otherwise(x)
        return F.coalesce(F.concat(F.lit("\x02"), body, F.lit("\x00")), F.lit("\x01"))

    return F.array_join(F.transform(order, place), "")


def _edges(df: DataFrame, key: str) -> list[str | list[str]]:
    drawn = df.select(key).orderBy(F.xxhash64(key), key).limit(EDGES)
    return drawn.agg(F.array_sort(F.collect_set(key))).first()[0]


def _array(items: list[str]) -> str:
    """An array in SQL, which the optimizer turns into one constant."""
    return f"array({', '.join(items)})"


def _literal(key: str | list[str]) -> str:
    return f"CAST(X'{key.encode().hex()}' AS STRING)" if isinstance(key, str) else _array(list(map(_literal, key)))


def _range(key: Column, edges: list[str | list[str]]) -> Column:
    """How many edges are not above the key, by bisection."""
    if not edges:
        return F.lit(0)
    at = F.expr(_array(list(map(_literal, edges))))
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(edges).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda low, step: F.when(F.get(at, low + step - 1) <= key, low + step).otherwise(low))


def running(df: DataFrame, group: str, order: Column, sums: Mapping[str, Column], totals: Mapping[str, str] | None = None) -> DataFrame:
    """df with the running sums of each group, this row included; equal places are in any order.

    ``order`` is an array of strings, compared place by place, null first. ``sums`` has non-null whole
    numbers to add up by the names of the new columns; ``totals`` names columns for the whole group's
    sums of some of them. A null group is a group of its own.
    """
    owner, key, bucket = "owner__", "key__", "range__"
    none = F.array().cast("array<string>")
    keyed = df.withColumn(owner, F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")))
    keyed = keyed.withColumn(key, sort_text(F.concat(F.array(owner), F.coalesce(order, none))))
    ranged = keyed.withColumn(bucket, _range(F.col(key), _edges(keyed, key)))

    sizes = ranged.groupBy(owner, bucket).agg(*[F.sum(v).alias(n) for n, v in sums.items()])
    before = Window.partitionBy(owner).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = [F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_before__") for n in sums]
    wholes = [F.sum(n).over(Window.partitionBy(owner)).alias(name) for n, name in (totals or {}).items()]
    starts = sizes.select(owner, bucket, *starts, *wholes)

    inside = Window.partitionBy(owner, bucket).orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = ranged.select("*", *[F.sum(v).over(inside).alias(f"{n}_inside__") for n, v in sums.items()])
    out = own.join(starts, [owner, bucket])
    shown = [(F.col(f"{n}_inside__") + F.col(f"{n}_before__")).alias(n) for n in sums]
    return out.select(*df.columns, *shown, *(totals or {}).values())


def with_ordinal(df: DataFrame, group: str, order: Column) -> DataFrame:
    """df with ``ordinal``, from 1, in each group."""
    return running(df, group, order, {"ordinal": F.lit(1)}).withColumn("ordinal", F.col("ordinal").cast("int"))
