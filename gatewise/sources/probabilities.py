"""Probabilities of tokens from JSON: an object from token to a number in [0, 1]."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parse(text: str) -> dict[str, float]:
    found = json.loads(text)
    if not isinstance(found, dict):
        raise ValueError("an object from token to probability is expected")
    for token, p in found.items():
        if isinstance(p, bool) or not isinstance(p, (int, float)) or math.isnan(p) or not 0 <= p <= 1:
            raise ValueError(f"{token}: not a probability: {p!r}")
    return {t: float(p) for t, p in found.items()}


def frame(spark: SparkSession, values: dict[str, float]) -> DataFrame:
    return spark.createDataFrame(list(values.items()), "token string, p double")


def load(spark: SparkSession, path: str) -> DataFrame:
    return frame(spark, parse(spark.read.text(path, wholetext=True).first()[0]))


def of_key(rows: DataFrame, token: Column, key: Column) -> DataFrame:
    """Deterministic probabilities (1 + key mod 97) / 101 for the rows of a table."""
    return rows.select(token.alias("token"), ((1 + F.pmod(key, F.lit(97))).cast("double") / 101).alias("p")).distinct()
