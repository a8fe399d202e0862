"""Work done once per content: the store behind the blob ledger and the digest cache.

A store is a folder of Parquet files with one row per (content, version of the
work) and the results of that work.  Rows of input are addressed by the SHA-256
of their content.  Of each content that the store lacks, one row is chosen by
its id; the join that brings its text runs on content *and* id, so a text that
a third of all rows carry is neither moved to one task nor worked on twice.
Appends go through Spark's commit protocol: a lost executor leaves no half
entry.  Rows that repeat both id and content are worked on each; entries stored
twice, by these or by a repeated run, are read as one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


def digest(content: Column) -> Column:
    """32 bytes that name a content; a null content counts as the empty one."""
    return F.unhex(F.sha2(F.coalesce(content, F.lit("")).cast("binary"), 256))


def folder(spark: SparkSession, setting: str, label: str) -> str:
    """The store's folder that the session names in ``setting``; without one, a new store."""
    return spark.conf.get(setting, None) or common.fresh_path(spark, label)


class ContentStore:
    def __init__(self, spark: SparkSession, path: str, results: str, version: str):
        """``results``: DDL of the result columns.  ``version``: names rules or tokenizer."""
        self.spark, self.path, self.version = spark, path, version
        self.schema = f"content binary, version string, {results}"

    def entries(self) -> DataFrame:
        """Stored results of this version, one row per content."""
        if not common.path_exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.schema)
        found = self.spark.read.schema(self.schema).parquet(self.path)
        return found.where(F.col("version") == self.version)

    def complete(self, rows: DataFrame, content: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Work on contents not stored yet and append them.  Returns ``rows(id, content digest)``.

        ``rows`` has ``id`` and the column named by ``content``; ``work`` maps
        ``(content, text)`` to ``(content, result columns)``.
        """
        keyed = rows.select("id", digest(F.col(content)).alias("content"), F.coalesce(content, F.lit("")).alias("text"))
        keys = common.durable(keyed.select("id", "content"), "keys")
        known = self.entries().select("content")
        missing = keys.groupBy("content").agg(F.min("id").alias("id")).join(known, "content", "left_anti")
        missing = missing.select(F.col("content").alias("_content"), F.col("id").alias("_id")).hint("shuffle_hash")
        todo = keyed.join(
            missing,
            (keyed["content"] == missing["_content"]) & keyed["id"].eqNullSafe(missing["_id"]),
            "left_semi",
        ).select("content", "text")
        done = work(todo).withColumn("version", F.lit(self.version))
        order = [c.split()[0] for c in self.schema.split(", ")[:2]]
        with common.bounded(self.spark):
            done.select(*order, *[c for c in done.columns if c not in order]).write.mode("append").parquet(self.path)
        return keys

    def attach(self, keys: DataFrame) -> DataFrame:
        """Results for every row of ``keys(id, content)``."""
        others = [c for c in self.entries().columns if c not in ("content", "version")]
        once = self.entries().groupBy("content").agg(*[F.first(c).alias(c) for c in others])
        return common.spread_join(keys, once, "content", F.col("id"))
