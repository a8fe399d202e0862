"""Benchmark decontamination by a prefix-filtered set join.

An item's windows (``window`` consecutive words, or the whole item if it is
shorter) are sets of word shingles.  A document contains a window only if it
contains all of its shingles, so it is enough to look for the rarest one: for
exact containment the necessary prefix has length one.  Shingles are ordered
by their frequency among the windows, ties by hash, so that neighbouring
windows mostly agree on their prefix shingle and a passage of 40 words costs
about eight probes.

Document side, one pass and no shuffle of texts: hash every shingle, drop
those whose bucket no prefix shingle has, join the rest with the prefix table,
apply the positional bound (the window must fit into the document around the
shingle) and compare the words themselves.  Only matches and one summary row
per document are shuffled.

Defined results: a null text has no words; an item without words or without
id is ignored; equal rows of documents give equal rows of results, as many as
there are; columns besides id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: What separates words, once A-Z are lower-cased: everything in ASCII but digits and letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Prefix entries that may be broadcast: about 300 bytes each.
BROADCAST_ENTRIES = 100_000
MAX_BUCKETS = 1 << 20


def words(text: Column) -> Column:
    lowered = common.ascii_lower(F.coalesce(text, F.lit("")))
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def _hasher(column: str, width: int) -> Callable[[Column], Column]:
    """A function from a position in an array of words to the hash of the shingle there."""
    return lambda start: F.xxhash64(*[F.get(column, start + k) for k in range(width)])


def _probe(width: int, reach: int) -> Callable[[Column], Column]:
    """A marked shingle with the words around it that any of its windows could hold."""
    low = lambda x: F.greatest(x["at"] - reach, F.lit(0))
    return lambda x: F.struct(
        F.lit(width).alias("width"),
        x["h"].alias("h"),
        x["at"].alias("at"),
        low(x).alias("from"),
        F.slice("w", low(x) + 1, F.lit(2 * reach + width)).alias("near"),
    )


def _both(hasher: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda i: F.struct(i.alias("at"), hasher(i).alias("h"))


def prefix_entries(items: DataFrame, item_col: str, text_col: str, window: int, shingle: int) -> DataFrame:
    """One row per window: its rarest shingle, where that stands in it, and its words."""
    split = items.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where(
        F.col("item").isNotNull() & (F.size("w") > 0)
    )
    length = F.least(F.lit(window), F.size("w"))
    windows = (
        split.select("item", "w", length.alias("len"), F.explode(F.sequence(F.lit(0), F.size("w") - length)).alias("at"))
        .select("item", F.slice("w", F.col("at") + 1, F.col("len")).alias("words"), "len")
        .distinct()
        .withColumn("width", F.least(F.lit(shingle), F.col("len")))
    )
    hashes = F.lit(None)
    for width in range(1, shingle + 1):
        every = F.transform(F.sequence(F.lit(0), F.col("len") - width), _hasher("words", width))
        hashes = F.when(F.col("width") == width, every).otherwise(hashes)
    shingles = windows.select("item", "words", "len", "width", F.posexplode(hashes).alias("offset", "h"))
    frequency = shingles.groupBy("width", "h").agg(F.count("*").alias("df"))
    return (
        shingles.join(frequency, ["width", "h"])
        .groupBy("item", "words", "len", "width")
        .agg(F.min(F.struct("df", "h", "offset")).alias("rarest"))
        .select("item", "words", "len", "width", "rarest.h", "rarest.offset")
    )


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    shingle: int = 5,
) -> DataFrame:
    """Per document row: id, text key, n_words, hit spans (word positions, merged), items found.

    ``hits`` are disjoint ``(start, end)`` word ranges, end exclusive; ``items``
    the ids of items with an occurring window, as sorted strings.
    """
    entries = common.durable(prefix_entries(items, item_col, item_text_col, window, shingle), "prefixes")
    shape = entries.agg(F.count("*").alias("n"), F.collect_set("width").alias("widths")).first()
    buckets = 1 << min(MAX_BUCKETS.bit_length() - 1, max(12, (32 * shape["n"]).bit_length()))
    bits = bytearray(buckets)
    for row in entries.select(F.pmod("h", F.lit(buckets)).cast("int").alias("b")).distinct().toLocalIterator():
        bits[row["b"]] = 1
    marks = F.lit(bytes(bits))

    base = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"),
        words(F.col(text_col)).alias("w"),
    )
    found: Column = F.array(
        F.struct(
            F.lit(0).alias("width"), F.lit(None).cast("long").alias("h"), F.lit(-1).alias("at"),
            F.lit(0).alias("from"), F.array().cast("array<string>").alias("near"),
        )
    )
    for width in sorted(shape["widths"]):
        reach = (window if width == shingle else width) - width
        positions = F.when(
            F.size("w") >= width, F.sequence(F.lit(0), F.size("w") - width)
        ).otherwise(F.array().cast("array<int>"))
        shingle_at = _hasher("w", width)
        hashed = F.transform(positions, _both(shingle_at))
        marked = F.filter(
            hashed,
            lambda x: F.substring(marks, F.pmod(x["h"], F.lit(buckets)).cast("int") + 1, F.lit(1)) == F.lit(b"\x01"),
        )
        found = F.concat(found, F.transform(marked, _probe(width, reach)))
    probes = base.select("id", "key", F.size("w").alias("n_words"), F.explode(found).alias("p")).select(
        "id", "key", "n_words", "p.*"
    )
    if shape["n"] <= BROADCAST_ENTRIES:
        entries = F.broadcast(entries)
    start = F.col("at") - F.col("offset")
    joined = probes.join(entries, ["width", "h"], "left").withColumn(
        "ok",
        F.coalesce(
            (start >= 0)
            & (start + F.col("len") <= F.col("n_words"))
            & (F.slice("near", F.greatest(start - F.col("from"), F.lit(0)) + 1, F.col("len")) == F.col("words")),
            F.lit(False),
        ),
    )
    grouped = (
        joined.where(F.col("ok") | (F.col("at") == -1))
        .groupBy("id", "key", "n_words")
        .agg(
            F.sum(F.when(F.col("at") == -1, 1).otherwise(0)).cast("int").alias("copies"),
            F.collect_set(F.when(F.col("ok"), F.struct(start.alias("start"), (start + F.col("len")).alias("end")))).alias("raw"),
            F.array_sort(F.collect_set(F.when(F.col("ok"), F.col("item")))).alias("items"),
        )
    )
    spans = "array<struct<start:int,end:int>>"
    one = lambda a, b: F.array(F.struct(a.alias("start"), b.alias("end"))).cast(spans)

    def merge(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.concat(
            F.slice(done, F.lit(1), F.size(done) - 1), one(last["start"], F.greatest(last["end"], x["end"]))
        )
        touching = (F.size(done) > 0) & (last["end"] >= x["start"])
        return F.when(touching, longer).otherwise(F.concat(done, one(x["start"], x["end"]))).cast(spans)

    merged = F.aggregate(F.array_sort("raw"), F.array().cast(spans), merge)
    return grouped.select(
        F.col("id").alias(id_col), "key", "n_words", merged.alias("hits"), "items",
        F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("copy"),
    ).drop("copy")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no window of an item occurs, whole and unchanged."""
    bad = (
        find_contamination(docs, items).where(F.size("items") > 0)
        .select(F.col("doc_id").alias("_bad_id"), F.col("key").alias("_bad_key")).distinct()
    )
    key = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_bad_id"]) & (key == bad["_bad_key"]), "left_anti")


ORACLE = """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
i AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
s AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS k FROM s),
lens AS (SELECT DISTINCT n FROM win),
dp AS (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lens WHERE len(w) >= n),
dw AS (SELECT rid, n, p, array_to_string(w[p:p + n - 1], ' ') AS k FROM dp),
hits AS (SELECT rid, p, win.n, item_id FROM dw JOIN win ON dw.n = win.n AND dw.k = win.k),
pos AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM hits) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
       FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN it USING (rid)
"""
