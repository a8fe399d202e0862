"""Secret scans through an incremental blob ledger.

Every version of every file is addressed by the digest of its content.  A scan
works on the contents that the ledger has no entry for under the present rule
version, records their findings (also that there are none), and joins findings
back to every path that carries the content.  See ``content_store``.

All of it is Spark SQL.  ``regexp_extract_all`` gives the leftmost
non-overlapping matches and ``split`` by the same pattern the text between
them, so offsets are running sums of lengths.

Defined results: a null text counts as empty; equal rows give equal rows; ids
may be null or repeated; other columns are ignored.  Offsets count code points,
the end is exclusive.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .content_store import ContentStore, digest, folder


@dataclass(frozen=True)
class Rule:
    """``measured``: the group whose length must reach ``least``; shorter matches are dropped after matching."""

    kind: str
    pattern: str
    measured: int
    least: int
    needs: str = ""  #: a plain string that every match holds, to skip other texts


# Fixed values of the contract: three base kinds, in the order in which equal starts are listed.
BASE_RULES = (
    Rule(
        "assign",
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    Rule("access", "AKIA[A-Z0-9]+", 0, 18, "AKIA"),
    # [0-9a-f]+ with 16 characters or more: maximal runs, so the bound may stand in the pattern
    Rule("hex", "[0-9a-f]{16,}", 0, 16),
)
# Public formats of well-known credentials.
MORE_RULES = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, "gh"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30, "eyJ"),
    # the header, and the body and footer if they follow
    Rule(
        "pem",
        r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=:,.\x20\x09-\x0D-]*?-----END [A-Z ]*PRIVATE KEY-----)?",
        0, 27, "-----BEGIN ",
    ),
)
RULES = BASE_RULES + MORE_RULES
#: Names the folder of the blob ledger; unset, every run has a new one.
LEDGER = "spark.gatewise.ledger"


def rules_version(rules: tuple[Rule, ...]) -> str:
    """Names what the rules find, so that other rules are never served these findings."""
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    measured = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.measured))
    rows = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), F.char_length).alias("gap"),
        F.transform(whole, F.char_length).alias("len"),
        F.transform(measured, F.char_length).alias("own"),
    )
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("found"))
    walked = F.aggregate(
        rows,
        empty,
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + F.coalesce(x["len"], F.lit(0))).alias("at"),
            F.when(
                x["own"] >= rule.least,
                F.concat(
                    acc["found"],
                    F.array(
                        F.struct(
                            (acc["at"] + x["gap"]).alias("start"),
                            F.lit(rank).alias("rank"),
                            (acc["at"] + x["gap"] + x["len"]).alias("end"),
                            F.lit(rule.kind).alias("kind"),
                        )
                    ),
                ),
            ).otherwise(acc["found"]).alias("found"),
        ),
        lambda acc: acc["found"],
    )
    there = text.rlike(rule.pattern)
    if rule.needs:
        there = text.contains(rule.needs) & there
    return F.when(there, walked).otherwise(F.array().cast(SPANS))


def find_spans(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All spans of a text, by start, then kind as listed."""
    return F.array_sort(F.concat(*[_spans(text, rule, k) for k, rule in enumerate(rules)]))


class BlobLedger:
    """Scans of contents under one version of the rules, kept in ``path``."""

    def __init__(self, spark: SparkSession, path: str, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.store = ContentStore(spark, path, f"spans {SPANS}", rules_version(rules))

    def _scan(self, blobs: DataFrame) -> DataFrame:
        return blobs.select("content", find_spans(F.col("text"), self.rules).alias("spans"))

    def scan(self, files: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Scan what is new; ``(id, content, spans)`` for every row of ``files``."""
        rows = files.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
        keys = self.store.complete(rows, "body", self._scan)
        return self.store.attach(keys).select(F.col("id").alias(id_col), "content", "spans")


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = BlobLedger(spark, folder(spark, LEDGER, "ledger")).scan(common.documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE_RULES))
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with every span, overlapping ones merged, replaced by ``[SECRET]``."""
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    return F.aggregate(
        spans,
        state,
        lambda acc, s: F.struct(
            F.when(
                s["start"] >= acc["at"],
                F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("[SECRET]")),
            ).otherwise(acc["out"]).alias("out"),
            F.greatest(acc["at"], s["end"]).alias("at"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))),
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets taken out of their texts and ``n_chars`` brought up to date.

    Findings are joined to the texts on content and id, so one content under
    many ids does not meet in one task.
    """
    found = BlobLedger(docs.sparkSession, folder(docs.sparkSession, LEDGER, "ledger")).scan(docs)
    hits = found.where(F.size("spans") > 0).distinct().select(
        F.col("doc_id").alias("_id"), F.col("content").alias("_content"), F.col("spans").alias("_spans")
    )
    text = F.col("text")
    clean = F.when(F.col("_spans").isNotNull(), redacted(text, F.col("_spans"))).otherwise(text)
    names = docs.columns
    joined = docs.join(
        hits, docs["doc_id"].eqNullSafe(hits["_id"]) & (digest(docs["text"]) == hits["_content"]), "left"
    ).withColumn("text", clean)
    if "n_chars" in names:
        joined = joined.withColumn("n_chars", F.when(F.col("_spans").isNotNull(), F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return joined.select(*names)


def _oracle_kind(rule: Rule, rank: int) -> str:
    """One kind in DuckDB: match k ends where the gaps and matches before it and itself end."""
    pattern = rule.pattern.replace("'", "''")
    return f"""
  SELECT rid, {rank} AS rank, '{rule.kind}' AS kind, list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k-1], lambda x: length(x))), 0) AS s,
         length(m[k]) AS n, length(o[k]) AS own
  FROM (SELECT rid, m, o, g, unnest(range(1, len(m) + 1)) AS k
        FROM (SELECT rid, regexp_extract_all(body, '{pattern}') AS m, regexp_extract_all(body, '{pattern}', {rule.measured}) AS o,
                     regexp_split_to_array(body, '{pattern}') AS g FROM d))
  WHERE length(o[k]) >= {rule.least}"""


ORACLE = (
    "WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body FROM documents),\nf AS ("
    + "\n  UNION ALL ".join(_oracle_kind(r, k) for k, r in enumerate(RULES))
    + """),
a AS (SELECT rid,
        count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
        string_agg(kind || ':' || CAST(CAST(s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(s + n AS BIGINT) AS VARCHAR), ',' ORDER BY s, rank) FILTER (rank < 3) AS base,
        string_agg(kind || ':' || CAST(CAST(s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(s + n AS BIGINT) AS VARCHAR), ',' ORDER BY s, rank) AS spans
      FROM f GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (rid)"""
)
