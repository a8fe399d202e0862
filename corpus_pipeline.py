"""A corpus from raw documents: rules, near-duplicates, benchmark leaks, secrets, pieces.

Every stage but the last returns the columns of ``documents``; the last gives,
per document, its pieces.  Each stage is written and read again before the
next, so a lost executor costs one stage's tasks at most.

Defined results, for every stage: other columns of the documents are kept as
they are, whatever their names; null ids and rows that repeat an id are rows of
their own; without documents there are none afterwards.  What a null or empty
text comes to is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gatewise.llm import common, decontamination, pieces, quality, secrets, simhash


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; lines above the limits go from the others.

    A null or empty text has no words and goes; a null source is a host of its own.
    """
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id, an id before none.

    Null and empty texts are one group.
    """
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go; a null or empty text has none, a null or empty item is none."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def take_out_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; all documents stay.  A null text stays null, an empty one empty."""
    return secrets.redact(docs)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of each document's piece ids, and the digest of what they decode to; a null or empty text has none."""
    import public_tokenizers

    return pieces.digests(docs, str(public_tokenizers.path("piece_bpe_32k.model")))


STAGES = [
    ("quality_rules", rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("secrets", take_out_secrets),
    ("pieces", to_pieces),
]

#: SimHash over XXH64 and SentencePiece are not to be had in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
