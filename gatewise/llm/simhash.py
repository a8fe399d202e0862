"""SimHash near-duplicates with pigeonhole blocks.

Fingerprints are made once per document in Arrow batches and written down;
everything after works on distinct fingerprints of eight bytes.  The 64 bits
are cut into blocks; of ``b`` blocks at most ``distance`` can differ between
two close fingerprints, so they agree on at least ``b - distance`` of them,
and a join on every choice of that many blocks loses no pair.  The number of
blocks follows the number of distinct fingerprints, so that random
fingerprints hardly ever share a bucket: this changes cost only.

A bucket is not expanded into pairs.  Its members are linked by a search that
compares one reached fingerprint with those not reached yet, which gives a
spanning forest of at most ``size - 1`` edges and the same components.  A
bucket above ``BUCKET_ROWS`` is cut into tiles of two chunks each, all pairs
of chunks, so no task ever holds more than two chunks of one bucket.
Components come from alternating large-star and small-star steps.

Defined results: a null or empty text has fingerprint zero; equal rows give
equal results; a null id takes part, and is the component's id only if the
component has no other; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHINGLE_WORDS = 4
SEED = 42
DISTANCE = 4
#: Distinct fingerprints of one bucket that one task may hold at once, twice over.
BUCKET_ROWS = 8_192
#: Blocks to cut 64 bits into, by how many distinct fingerprints there are at most.
BLOCKS = ((1 << 10, 5), (1 << 21, 6), (1 << 27, 7), (1 << 63, 8))


def fingerprint(text: bytes | None) -> int:
    """The SimHash of one text in UTF-8: 4-word shingles, XXH64, a majority vote per bit."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE_WORDS:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.empty_like(ends)
    starts[0] = 0
    starts[1:] = ends[:-1] + 1
    digest = xxhash.xxh64_intdigest
    cut = SHINGLE_WORDS - 1
    hashes = np.array(
        [digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - cut].tolist(), ends[cut:].tolist())], np.uint64
    )
    votes = np.zeros(64, np.int64)
    for low in range(0, len(hashes), 1 << 16):  # bounds memory for very long texts
        part = hashes[low : low + (1 << 16)]
        votes += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    bits = np.packbits(votes * 2 > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and ``fp`` (the fingerprint as a signed long) for every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(len(keep)).to_pylist()
        values = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays(
            [*(batch.column(k) for k in range(len(keep))), pa.array(values)], [*keep, "fp"]
        )

    rows = docs.select(*keep, F.col(text_col).cast("binary").alias("_text"))
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep), "fp long"])
    return common.map_batches(rows, run, schema)


def _masks(blocks: int, distance: int) -> list[int]:
    bounds = [64 * k // blocks for k in range(blocks + 1)]
    part = [((1 << (b - a)) - 1) << a for a, b in zip(bounds, bounds[1:])]
    masks = [sum(chosen) for chosen in combinations(part, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def forest(members: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of the graph that links members at most ``distance`` bits apart."""
    if len(members) == 2:
        a, b = members.tolist()
        return ([a], [b]) if ((a ^ b) & 0xFFFFFFFFFFFFFFFF).bit_count() <= distance else ([], [])
    left, right = [], []
    waiting = members.astype(np.int64)
    while len(waiting):
        queue, waiting = [int(waiting[0])], waiting[1:]
        while queue and len(waiting):
            here = queue.pop()
            near = np.bitwise_count((waiting ^ np.int64(here)).view(np.uint64)) <= distance
            if near.any():
                reached = waiting[near].tolist()
                left += [here] * len(reached)
                right += reached
                queue += reached
                waiting = waiting[~near]
    return left, right


def links(distinct: DataFrame, n: int, distance: int = DISTANCE, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Edges ``(a, b)``, a < b, with the same components as all pairs within ``distance``."""
    blocks = next(b for most, b in BLOCKS if n <= most) + max(0, distance - DISTANCE)
    masks = F.array(*[F.lit(m).cast("long") for m in _masks(blocks, distance)])
    keyed = distinct.select("fp", F.posexplode(masks).alias("t", "mask")).select(
        "fp", "t", F.col("fp").bitwiseAND(F.col("mask")).alias("k")
    )
    hot = common.durable(
        keyed.groupBy("t", "k").count().where(F.col("count") > bucket_rows)
        .select("t", "k", F.ceil(F.col("count") / bucket_rows).cast("int").alias("chunks")),
        "buckets",
    )
    tile = ["t", "k"]
    if not hot.isEmpty():
        chunk = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
        keyed = (
            keyed.join(common.if_small(hot), ["t", "k"], "left")
            .withColumn("chunks", F.coalesce("chunks", F.lit(1)))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
            .select("fp", "t", "k", F.least(chunk, "other").alias("i"), F.greatest(chunk, "other").alias("j"))
        )
        tile += ["i", "j"]
    full = keyed.groupBy(*tile).agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists, left, right = batch.column(0), [], []
        flat, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            x, y = forest(flat[a:b], distance)
            left += x
            right += y
        ends = np.array([left, right], np.int64).reshape(2, -1)
        return pa.RecordBatch.from_arrays([pa.array(ends.min(axis=0)), pa.array(ends.max(axis=0))], ["a", "b"])

    return common.map_batches(full, run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of an edge; the root is the least node of its component."""
    edges = common.durable(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct(), "edges")

    while True:
        both = edges.unionByName(edges.select(F.col("m").alias("v"), F.col("v").alias("m")))
        least = both.groupBy("v").agg(F.min("m").alias("low")).select("v", F.least("v", "low").alias("low"))
        large = both.join(least, "v").where(F.col("m") > F.col("v")).select(F.col("m").alias("v"), F.col("low").alias("m"))
        large = large.distinct()
        low = large.groupBy("v").agg(F.min("m").alias("low"))
        small = large.join(low, "v").select(
            F.explode(
                F.array(
                    F.struct(F.col("v").alias("v"), F.col("low").alias("m")),
                    F.struct(F.col("m").alias("v"), F.col("low").alias("m")),
                )
            ).alias("e")
        ).select("e.*")
        before, edges = edges, common.durable(small.where("v <> m").distinct(), "edges")
        if edges.count() == before.count() and edges.join(before, ["v", "m"], "left_anti").isEmpty():
            break
    roots = edges.select("v", F.col("m").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("v"), "root").distinct()).withColumnRenamed("v", "node")


def component_of(marked: DataFrame, id_col: str = "doc_id", distance: int = DISTANCE) -> DataFrame:
    """``(fp, component_id)`` for every distinct fingerprint of ``marked(id_col, fp)``."""
    distinct = common.durable(marked.groupBy("fp").agg(F.min(id_col).alias("least_id")), "distinct")
    roots = components(links(distinct, distinct.count(), distance))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "least_id", F.coalesce("root", "fp").alias("root")
    )
    rooted = common.durable(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return common.spread_join(rooted, least, "root", F.col("fp")).select("fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """Per row: id, ``fp`` and ``component_id``, the smallest id reachable through links, its own included."""
    marked = common.durable(
        fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))), "fingerprints"
    )
    named = component_of(marked, "doc_id", distance)
    return common.spread_join(marked, named, "fp", F.col("doc_id")).select(F.col("doc_id").alias(id_col), "fp", "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, whole: the one with the smallest id, the first written of equal ids.

    Texts that are null or empty are one component; of a component without an id any one row stays.  Other columns are
    kept whatever their names; without rows the result has none.
    """
    names = docs.columns
    row = common.unused(names, "_row")
    numbered = common.durable(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    marked = common.durable(
        fingerprints(numbered.select(F.col(row).alias("row"), "doc_id", "text"), keep=("row", "doc_id")), "fingerprints"
    )
    chosen = (
        common.spread_join(marked, component_of(marked), "fp", F.col("row"))
        .groupBy("component_id")
        .agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
        .select(F.col("first.row").alias(row))
    )
    return numbered.join(chosen.hint("shuffle_hash"), row, "left_semi").select(*[f"`{n}`" for n in names])
