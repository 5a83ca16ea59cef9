"""Helpers that several operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Sequence
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of the six ASCII white-space characters that separate words.
WHITE = r"[\x20\x09-\x0D]+"

_LOCAL: dict[str, str] = {}
#: Where the tables of ``materialize`` lie, as long as their DataFrames are held.
_TABLES: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where unset on one machine (tests) a temporary one."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="leafmill-")
        atexit.register(shutil.rmtree, _LOCAL[app], True)
    return _LOCAL[app]


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder as Parquet and read it back."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _TABLES[table] = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that no later result reads."""
    for table in tables:
        if path := _TABLES.pop(table, None):
            jvm, spark = table.sparkSession._jvm, table.sparkSession._jsparkSession
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sessionState().newHadoopConf()).delete(where, True)


def sized(df: DataFrame, rows: int, each: int) -> DataFrame:
    """df in no more partitions than give each about ``each`` of its ``rows`` rows, two for each core at least.

    Partitions are put together without a shuffle; none are added.
    """
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lowers the session's bound on the rows of an Arrow batch, which holds whole texts on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def join_checked(
    big: DataFrame, small: DataFrame, on: Sequence[str], how: str, max_broadcast_rows: int = 200_000
) -> DataFrame:
    """Join that broadcasts ``small`` only if it was counted to hold at most ``max_broadcast_rows`` rows.

    ``small`` must hold narrow rows. Beyond the bound this is a shuffle join, whose hot keys
    adaptive execution splits.
    """
    if small.count() <= max_broadcast_rows:
        return big.join(F.broadcast(small), list(on), how)
    return big.join(small.hint("merge"), list(on), how)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, though body may use it inside other lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE), "")


def free_name(df: DataFrame, base: str) -> str:
    """A column name starting with ``base`` that df doesn't have."""
    have, name = {c.lower() for c in df.columns}, base
    while name.lower() in have:
        name += "_"
    return name
