"""Numbers dealt out in packed batches.

A post is a row with a compressed body of numpy arrays, addressed to one of
``parts`` tasks.  Dealing millions of keys out in bodies of thousands costs
the JVM a row per body; the work on the keys is done by numpy.  Every job over
posts is written to the shared folder, split by ``kind``.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from ..storage import fresh_path, remove
from . import common

SCHEMA = "kind string, to long, sender long, a double, b double, body binary"
#: kind, to, sender, a, b, body
Post = tuple[str, int, int, float, float, bytes]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes; numbers of signed types must not be negative, and take as few bytes as they need."""
    parts = []
    for a in arrays:
        if a.dtype.kind == "i":
            a = a.astype(np.min_scalar_type(int(a.max(initial=0))))
        flat = np.ascontiguousarray(a).reshape(-1).view(np.uint8).reshape(-1, a.itemsize)
        parts.append((a.dtype.str, a.shape, flat.T.tobytes()))  # bytes of equal weight together
    raw = pickle.dumps(parts, 5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(body: bytes) -> list[np.ndarray]:
    """What ``pack`` was given; whole numbers but uint64 as int64."""
    raw = pa.decompress(body[8:], int.from_bytes(body[:8], "little"), codec="zstd", asbytes=True)
    out = []
    for kind, shape, data in pickle.loads(raw):
        width = np.dtype(kind).itemsize
        a = np.frombuffer(data, np.uint8).reshape(width, -1).T.copy().reshape(-1).view(kind).reshape(shape)
        out.append(a.astype(np.int64) if a.dtype.kind in "iu" and a.dtype != np.uint64 else a)
    return out


def post(kind: str, to: int, sender: int, *arrays: np.ndarray, a: float = 0.0, b: float = 0.0) -> Post:
    return kind, to, sender, a, b, pack(*arrays)


def batch_of(rows: list[Post]) -> pa.RecordBatch:
    types = (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())
    columns = zip(*rows) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, types)], ["kind", "to", "sender", "a", "b", "body"]
    )


Inbox = dict[str, list[tuple[int, list[np.ndarray]]]]


def inboxes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Inbox]]:
    """Posts by addressee, from rows sorted by addressee, kind and sender."""
    here, found = None, {}
    for batch in batches:
        for kind, to, sender, body in zip(*(batch.column(c).to_pylist() for c in ("kind", "to", "sender", "body"))):
            if to != here:
                if here is not None:
                    yield here, found
                here, found = to, {}
            found.setdefault(kind, []).append((sender, body))
    if here is not None:
        yield here, found


def opened(found: Inbox, kind: str) -> list[tuple[int, list[np.ndarray]]]:
    return [(sender, unpack(body)) for sender, body in found.get(kind, [])]


class Table:
    """Posts in the shared folder, a folder for each kind."""

    def __init__(self, posts: DataFrame, label: str):
        self.spark: SparkSession = posts.sparkSession
        self.path = fresh_path(self.spark, label)
        with common.bounded(self.spark):
            posts.write.partitionBy("kind").parquet(self.path)

    def __getitem__(self, kind: str) -> DataFrame:
        rest = SCHEMA.split(", ", 1)[1]
        if not common.path_exists(self.spark, f"{self.path}/kind={kind}"):
            return self.spark.createDataFrame([], SCHEMA)
        found = self.spark.read.schema(rest).parquet(f"{self.path}/kind={kind}")
        return found.select(F.lit(kind).alias("kind"), *found.columns)

    def total(self, kind: str) -> tuple[float, float]:
        row = self[kind].agg(F.coalesce(F.sum("a"), F.lit(0.0)), F.coalesce(F.sum("b"), F.lit(0.0))).first()
        return row[0], row[1]

    def drop(self) -> None:
        remove(self.spark, self.path)


def deal(posts: list[DataFrame], parts: int, work: Callable[[int, Inbox], list[Post]], label: str) -> Table:
    """Give every addressee (0 to ``parts`` - 1) its posts in one go, and write what ``work`` makes of them."""
    every = posts[0]
    for more in posts[1:]:
        every = every.unionByName(more)
    ship(every.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for to, found in inboxes(batches):
            yield batch_of(work(to, found))

    dealt = every.repartitionById(parts, F.col("to").cast("int")).sortWithinPartitions("to", "kind", "sender")
    return Table(dealt.mapInArrow(run, SCHEMA), label)
