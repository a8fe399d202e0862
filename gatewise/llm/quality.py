"""Quality rules, with cross-document line frequency.

One pass in Arrow batches takes the statistics of each text and the hashes of
its normalised lines; what follows works on that narrow table.  A line is
frequent on its host (``source``) if more than ``max_docs`` documents hold it, or
more than ``max_long_docs`` if it has ``LONG_LINE`` words: such a passage hardly
occurs twice by chance.  The limits don't grow with the host.  Frequent lines are removed
everywhere but in the document with the smallest id that holds them on that
host, so that the content itself stays in the corpus once.  A document is
depleted, and rejected, if fewer than ``min_left`` of its words remain.

Documents per line are counted after each document's own repeats are folded,
so the count is a plain sum that is combined before the shuffle; a line that a
third of all rows hold is one row from each task.

Normalised lines: words (runs of other than ASCII white space) with A-Z in
lower case and digits as 0, joined by single spaces; lines without words don't
count.

Defined results: a null or empty text has no words and fails the base rules;
a null host is a host of its own; equal rows are counted as documents of their
own; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 8
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
MAX_DOCS = 20
LONG_LINE, MAX_LONG_DOCS = 50, 1
MIN_LEFT = 0.3
LINE_SEED = 42  #: that of Spark's xxhash64, so that either side can name a line
_DIGITS = bytes.maketrans(b"123456789", b"000000000")
_POWERS = np.array([pow(6364136223846793005, k, 1 << 64) for k in range(WINDOW)], np.uint64)


def repeated_words(words: list[bytes]) -> int:
    """Words inside any ``WINDOW``-word window that the text holds at least twice."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    hashed = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    rolled = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        rolled += hashed[k : k + n] * _POWERS[k]
    order = np.sort(rolled)
    again = order[1:][order[1:] == order[:-1]]
    if not len(again):
        return 0
    places = np.flatnonzero(np.isin(rolled, again)).tolist()
    seen: dict[tuple, list[int]] = {}
    for p in places:  # compare the words themselves, hashes may collide
        seen.setdefault(tuple(words[p : p + WINDOW]), []).append(p)
    edge = np.zeros(len(words) + 1, np.int64)
    for found in seen.values():
        if len(found) > 1:
            at = np.array(found)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def normal_line(line: bytes) -> bytes:
    return b" ".join(line.lower().translate(_DIGITS).split())


def describe(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and by hash of a line its words in all and in one."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    seen: set[bytes] = set()
    duplicates = 0
    lines: dict[int, tuple[int, int]] = {}
    for line in raw.split(b"\n"):
        n = len(line.split())
        if not n:
            continue
        if line in seen:
            duplicates += 1
        else:
            seen.add(line)
        key = xxhash.xxh64_intdigest(normal_line(line), LINE_SEED)
        lines[key] = (lines[key][0] + n if key in lines else n, n)
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        duplicates,
        repeated_words(words),
        lines,
    )


#: Of each distinct line: hash, words in all its repeats, words in one.
LINES = ("line", "line_words", "line_size")
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def statistics(docs: DataFrame, keep: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """Columns ``keep``, the five statistics and the lists ``LINES``, for every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [describe(t) for t in batch.column(len(keep)).to_pylist()]
        lines = [f[5] for f in found]
        columns = [batch.column(k) for k in range(len(keep))]
        columns += [pa.array([f[k] for f in found], pa.int64()) for k in range(5)]
        hashes = [np.fromiter(x.keys(), np.uint64, len(x)).view(np.int64) for x in lines]
        columns.append(pa.array(hashes, pa.list_(pa.int64())))
        columns += [pa.array([[v[k] for v in x.values()] for x in lines], pa.list_(pa.int64())) for k in (0, 1)]
        return pa.RecordBatch.from_arrays(columns, [*keep, *STATS, *LINES])

    rows = docs.select(*keep, F.col(text_col).alias("_text"))
    kept = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    stats = ", ".join(f"{c} long" for c in STATS)
    return common.map_batches(rows, run, f"{kept}, {stats}, {', '.join(f'{c} array<bigint>' for c in LINES)}")


def judge(
    described: DataFrame,
    max_docs: int = MAX_DOCS,
    max_long_docs: int = MAX_LONG_DOCS,
    min_left: float = MIN_LEFT,
) -> tuple[DataFrame, DataFrame]:
    """From a written table of ``_row, id, host`` and statistics: verdicts by row, and frequent lines.

    Verdicts add ``removed_words``, ``base_failed`` and ``kept``; frequent lines
    are ``(host_key, line, n_docs, first_id)``.
    """
    host = F.xxhash64("host")
    lines = described.select(
        "_row", "id", host.alias("host_key"), F.explode(F.arrays_zip(*LINES)).alias("l")
    ).select("_row", "id", "host_key", "l.*")
    frequent = (
        lines.groupBy("host_key", "line")
        .agg(F.count("*").alias("n_docs"), F.min("id").alias("first_id"), F.max("line_size").alias("size"))
        .where((F.col("n_docs") > max_docs) | (F.col("size") >= LONG_LINE) & (F.col("n_docs") > max_long_docs))
        .select("host_key", "line", "n_docs", "first_id")
    )
    frequent = common.durable(frequent, "frequent-lines")
    removed = (
        lines.join(common.if_small(frequent), ["host_key", "line"])
        .where(~F.col("id").eqNullSafe(F.col("first_id")))
        .groupBy("_row")
        .agg(F.sum("line_words").alias("removed_words"))
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words")
    verdict = (
        described.drop(*LINES)
        .join(removed, "_row", "left")
        .withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (left >= min_left * F.col("n_words")))
    )
    return verdict, frequent


def described(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> DataFrame:
    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"),
        F.col(id_col).alias("id"),
        F.col(host_col).alias("host"),
        F.col(text_col).alias("text"),
    )
    return common.durable(statistics(rows, ("_row", "id", "host")), "statistics")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict, _ = judge(described(common.documents(spark, sf_dir)))
    return verdict.select(F.col("id").alias("doc_id"), *STATS, "base_failed", "kept", "removed_words")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, without the lines removed from them.

    ``n_chars`` follows the text where lines were removed.  A null or empty text goes; a null host is one host; of rows
    that repeat an id, the lines of all with the smallest id stay; other columns are kept whatever their names; without
    rows the result has none.
    """
    names = docs.columns
    row, gone, new = (common.unused(names, n) for n in ("_row", "_gone", "_new"))
    numbered = common.durable(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    rows = numbered.select(F.col(row).alias("_row"), F.col("doc_id").alias("id"), F.col("source").alias("host"), "text")
    table = common.durable(statistics(rows, ("_row", "id", "host")), "statistics")
    verdict, frequent = judge(table)
    good = verdict.where("kept").select("_row", "removed_words")
    lines = table.select("_row", "id", F.xxhash64("host").alias("host_key"), F.explode("line").alias("line"))
    # Which lines of which rows go; only rows that are kept and lose something appear.
    lost = (
        lines.join(common.if_small(frequent), ["host_key", "line"])
        .where(~F.col("id").eqNullSafe(F.col("first_id")))
        .join(good.where("removed_words > 0").select("_row"), "_row", "left_semi")
        .groupBy("_row")
        .agg(F.collect_set("line").alias("gone"))
    )
    plan = good.join(lost, "_row", "left").select(F.col("_row").alias(row), F.col("gone").alias(gone))
    joined = numbered.join(plan.hint("shuffle_hash"), row)

    def stays(line):
        lowered = F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz000000000")
        normal = F.array_join(F.array_remove(F.split(lowered, r"[\x20\x09-\x0D]+"), ""), " ")
        return (normal == "") | ~F.array_contains(gone, F.xxhash64(normal))

    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(
        F.array_join(F.filter(F.split("text", "\n"), stays), "\n")
    )
    out = joined.withColumn(new, text)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col(gone).isNotNull(), F.char_length(new).cast("long")).otherwise(F.col("n_chars")))
    return out.withColumn("text", F.col(new)).select(*[f"`{n}`" for n in names])


ORACLE = """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
q AS (SELECT rid, p, array_to_string(w[p:p + 7], ' ') AS k
      FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS p FROM d WHERE len(w) >= 8)),
r AS (SELECT rid, p FROM q JOIN (SELECT rid, k FROM q GROUP BY rid, k HAVING count(*) > 1) USING (rid, k)),
rep AS (SELECT rid, count(DISTINCT u) AS n FROM (SELECT rid, unnest(range(p, p + 8)) AS u FROM r) GROUP BY rid),
l0 AS (SELECT rid, doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d),
l AS (SELECT rid, doc_id, source, line, list_filter(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM l0),
l1 AS (SELECT rid, doc_id, source, line, len(w) AS n,
              translate(array_to_string(w, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000') AS k
       FROM l WHERE len(w) > 0),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM l1 GROUP BY rid),
f AS (SELECT source, k, min(doc_id) AS first_id, count(DISTINCT rid) AS docs, max(n) AS size FROM l1 GROUP BY source, k),
bad AS (SELECT source, k, first_id FROM f WHERE docs > 20 OR size >= 50 AND docs > 1),
rem AS (SELECT rid, sum(l1.n) AS n FROM l1 JOIN bad ON l1.source IS NOT DISTINCT FROM bad.source AND l1.k = bad.k
        WHERE doc_id IS DISTINCT FROM first_id GROUP BY rid),
s AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
             length(text) - length(regexp_replace(text, '[^\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, CAST(coalesce(rem.n, 0) AS BIGINT) AS removed_words
      FROM d LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN rem USING (rid))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - removed_words >= 0.3 * n_words AS kept
FROM s
"""
