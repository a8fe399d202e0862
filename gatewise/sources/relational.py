"""Tables as uncertain facts: one leaf per row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms

BASE = "http://example.org/"


@dataclass(frozen=True)
class Mapping:
    """Key columns name the entity; foreign keys become edges to entities of other tables."""

    table: str
    key: tuple[str, ...]
    foreign: tuple[tuple[str, str], ...] = ()


# Keys of the benchmark schema's tables.
MAPPINGS = (
    Mapping("region", ("r_regionkey",)),
    Mapping("nation", ("n_nationkey",), (("n_regionkey", "region"),)),
    Mapping("customer", ("c_custkey",), (("c_nationkey", "nation"),)),
    Mapping("supplier", ("s_suppkey",), (("s_nationkey", "nation"),)),
    Mapping("part", ("p_partkey",)),
    Mapping("orders", ("o_orderkey",), (("o_custkey", "customer"),)),
    Mapping("lineitem", ("l_orderkey", "l_linenumber"), (("l_orderkey", "orders"), ("l_partkey", "part"), ("l_suppkey", "supplier"))),
)


def entity(table: str, *key: Column) -> Column:
    return F.concat(F.lit(f"<{BASE}{table}/"), F.concat_ws("-", *[k.cast("string") for k in key]), F.lit(">"))


def token(table: str, *key: Column) -> Column:
    """The entity's name, as a leaf."""
    return F.concat(F.lit(f"{BASE}{table}/"), F.concat_ws("-", *[k.cast("string") for k in key]))


def plain(c: Column) -> Column:
    return F.concat(F.lit('"'), c.cast("string"), F.lit(f'"^^<{terms.STRING}>'))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def direct_mapping(rows: DataFrame, mapping: Mapping) -> DataFrame:
    """``(token, s, p, o)``: one fact per column of each row, all with the row's token, and its type."""
    foreign = dict(mapping.foreign)
    subject = entity(mapping.table, *[F.col(k) for k in mapping.key])
    pairs = [F.struct(F.lit("<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>").alias("p"), F.lit(f"<{BASE}{mapping.table}>").alias("o"))]
    for c in rows.columns:
        value = entity(foreign[c], F.col(c)) if c in foreign else plain(F.col(c))
        pairs.append(F.struct(F.lit(f"<{BASE}{c}>").alias("p"), value.alias("o")))
    return rows.select(
        token(mapping.table, *[F.col(k) for k in mapping.key]).alias("token"),
        subject.alias("s"),
        F.explode(F.array(*pairs)).alias("x"),
    ).select("token", "s", "x.p", "x.o").where(F.col("o").isNotNull()).distinct()
