"""Helpers shared by the training-data operators.

Everything here is about running well on a cluster: durable intermediate
tables in the shared checkpoint folder, Arrow batch sizes that keep Python
workers small, and column expressions several operators need.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from ..storage import fresh_path, path_exists

#: Rows of text handed to a Python worker at once, and their bytes, whichever is reached first.
TEXT_ROWS_PER_BATCH, TEXT_BYTES_PER_BATCH = 256, 16 << 20
#: A table is broadcast only after its rows were counted and found below this.
BROADCAST_ROWS = 200_000


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings with ``values``, as they were afterwards."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def bounded(spark: SparkSession):
    """Settings for a job over whole texts: small batches for Python workers; its shuffles are deleted when it ends."""
    return settings(
        spark,
        {
            "spark.sql.execution.arrow.maxRecordsPerBatch": str(TEXT_ROWS_PER_BATCH),
            "spark.sql.execution.arrow.maxBytesPerBatch": str(TEXT_BYTES_PER_BATCH),
            "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
        },
    )


def durable(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage so that lost executors cost a re-read and not a recomputation.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    with bounded(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` if a count proves it has at most ``rows`` rows; otherwise leave the join to Spark."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: A key with more rows than this is dealt to several tasks, if no more than ``HOT_KEYS`` keys can have so many.
HOT_ROWS, HOT_KEYS = 1_000, 50_000


def spread_join(left: DataFrame, right: DataFrame, key: str, by: Column) -> DataFrame:
    """``left`` with the columns of ``right``, which has each ``key`` once; rows of ``left`` without a match go.

    Frequent keys are dealt out by a hash of ``by``.  Fewer than ``HOT_KEYS`` keys can have more than the total divided
    by that number, so their counts may be broadcast whatever the size of the tables.
    """
    most = max(HOT_ROWS, left.count() // HOT_KEYS)
    hot = left.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    hot = durable(hot.select(key, F.ceil(F.col("_n") / most).cast("int").alias("_parts")), "hot")
    if hot.isEmpty():
        return left.join(right, key)
    few = F.broadcast(hot)
    parts = F.coalesce("_parts", F.lit(1))
    dealt = left.join(few, key, "left").withColumn("_part", F.pmod(F.xxhash64(by), parts).cast("int")).drop("_parts")
    copies = right.join(few, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(copies, [key, "_part"]).drop("_part")


def unused(names: list[str], wanted: str) -> str:
    """A column name like ``wanted`` that ``names`` does not have in any case."""
    taken = {n.lower() for n in names}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.  Pure ASCII texts take Spark's fast ``lower``."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def fold_number(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def map_batches(
    df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str
) -> DataFrame:
    """``mapInArrow`` for a function of single batches.  Over texts, run it ``bounded``, as ``durable`` does."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = function(batch)
            if out is not None:
                yield out

    return df.mapInArrow(run, schema)
