"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash inside their source, placed at the fractional rank (r + 1/2) / n
of their source, sorted by it, and the sorted sequence is cut into equal runs. Every run then holds
each source in proportion, to within about one row. Shard sizes differ by at most one row.

Null texts have size 8 and the checksum of no bytes; a null source is a source; rows without an id are
shuffled by their other columns; rows with the same id are ordered by source and checksum, so that
equal rows are interchangeable. More
shards than rows leave shards empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import free_name
from leafmill.llm.ranks import bucket_count, hex_bucket, shuffle_key, stratum, with_rank


def assign_shards(
    df: DataFrame, n_shards: int, key: str = "doc_id", source: str = "source", seed: int = 0, tie: tuple[str, ...] = ()
) -> DataFrame:
    """df with ``shard`` and ``slot`` (0-based, gapless inside the shard)."""
    df = df.drop("shard", "slot")
    rows = df.count()
    buckets = bucket_count(rows)
    s, h, r, n, p = (free_name(df, x) for x in ("stratum_", "hash_", "rank_", "size_", "place_"))
    out = df.withColumn(s, stratum(F.col(source))).withColumn(h, shuffle_key(seed, key, df))
    sizes = out.groupBy(s).agg(F.count("*").alias(n))
    out = with_rank(out, r, [s], hex_bucket(F.col(h), buckets), [h, *tie])
    out = out.join(sizes, s)
    fraction = (2 * F.col(r) + 1) / (2 * F.col(n))
    out = out.withColumn(free_name(df, "fraction_"), fraction).withColumn(free_name(df, "all_"), F.lit(0))
    at = F.least(F.floor(fraction * buckets), F.lit(buckets - 1)).cast("int")
    out = with_rank(out, p, [free_name(df, "all_")], at, [free_name(df, "fraction_"), h, s, *tie])
    shard = F.expr(f"cast(({p} * {n_shards}L) div {max(rows, 1)}L as int)")
    out = out.withColumn("shard", shard)
    start = F.expr(f"(cast(shard as bigint) * {rows}L + {n_shards - 1}L) div {n_shards}L")
    return out.select(*df.columns, "shard", (F.col(p) - start).alias("slot"))
