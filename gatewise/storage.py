"""Tables that must outlive the executors that made them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``: a folder that the driver and all executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/checkpoints/gatewise"  # one process: the driver is the only executor


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/gatewise-{label}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def path_exists(spark: SparkSession, path: str) -> bool:
    files, where = _file_system(spark, path)
    return files.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    files, where = _file_system(spark, path)
    files.delete(where, True)


def _written(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")  # the job's shuffles go when it ends
    try:
        df.write.option("compression", "zstd").parquet(path)  # names of gates are hexadecimal, which other codecs leave as it is
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here."""
    return _written(df, fresh_path(df.sparkSession, label))


class Scratch:
    """Settled tables that go when they are dropped; nothing that is still to be read may stand on them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def settled(self, df: DataFrame, label: str = "step") -> DataFrame:
        self.paths.append(fresh_path(self.spark, label))
        return _written(df, self.paths[-1])

    def drop(self) -> None:
        for path in self.paths:
            remove(self.spark, path)
        self.paths = []
