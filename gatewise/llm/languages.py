"""Language identification by a small convolutional network over bytes.

Filters of widths 2, 3 and 4 run over the bytes of fixed-length windows, their
responses are max-pooled, and a softmax layer reads the pooled values.  A
filter over one-hot bytes is a table of 256 weights per position, so a
response is a sum of table look-ups; look-ups of two neighbouring bytes are
folded into one table of byte pairs once training is over.  Training is Adam
on cross-entropy in numpy.

Bounded sample: at most about ``SAMPLE_ROWS`` labelled rows (chosen by a hash
of the id), ``SAMPLE_WINDOWS`` windows of each.  Every text is read whole: all
of its windows are classified, and their log-probabilities averaged.

Defined results: a null text or one without a letter is ``und`` with score 0;
without labelled rows every text is; equal rows give equal rows; other columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

HELD_OUT = 0
WINDOW = 192  #: bytes
WIDTHS = (2, 3, 4)
FILTERS = 12  #: of each width
SAMPLE_ROWS = 4_000
SAMPLE_WINDOWS = 3
EPOCHS = 4
BATCH = 64
#: Windows that one worker classifies at once.
WINDOWS_AT_ONCE = 512


@dataclass
class ByteNet:
    languages: list[str]
    kernels: list[np.ndarray]  #: per width: (width, 256, FILTERS)
    bias: np.ndarray  #: (len(WIDTHS) * FILTERS,)
    dense: np.ndarray  #: (len(WIDTHS) * FILTERS, languages)
    offset: np.ndarray

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Max responses (before the bias) and where they were."""
        values, places = [], []
        for k in self.kernels:
            n = windows.shape[1] - len(k) + 1
            response = sum(k[j][windows[:, j : j + n]] for j in range(len(k)))
            at = response.argmax(axis=1)
            places.append(at)
            values.append(np.take_along_axis(response, at[:, None, :], axis=1)[:, 0])
        return np.concatenate(values, axis=1), places

    def folded(self) -> Folded:
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS).astype(np.float32)
        two, three, four = self.kernels
        return Folded(
            self, pair(two[0], two[1]), pair(three[0], three[1]), three[2].astype(np.float32),
            pair(four[0], four[1]), pair(four[2], four[3]),
        )


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Folded:
    net: ByteNet
    two: np.ndarray
    three_a: np.ndarray
    three_b: np.ndarray
    four_a: np.ndarray
    four_b: np.ndarray

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        pairs = windows[:, :-1].astype(np.intp) * 256 + windows[:, 1:]
        third = windows[:, 2:]
        pooled = [
            self.two[pairs].max(axis=1),
            (self.three_a[pairs[:, :-1]] + self.three_b[third]).max(axis=1),
            (self.four_a[pairs[:, :-2]] + self.four_b[pairs[:, 2:]]).max(axis=1),
        ]
        hidden = np.maximum(np.concatenate(pooled, axis=1) + self.net.bias, 0)
        return np.log(_softmax(hidden @ self.net.dense + self.net.offset) + 1e-12)


def windows_of(text: bytes) -> np.ndarray:
    """The whole text as rows of ``WINDOW`` bytes, the last filled up with spaces."""
    n = max(1, -(-len(text) // WINDOW))
    return np.frombuffer(text.ljust(n * WINDOW), np.uint8).reshape(n, WINDOW)


def train(texts: list[bytes], languages: list[str], seed: int = 0) -> ByteNet:
    """From windows and their labels."""
    names = sorted(set(languages))
    x = np.stack([np.frombuffer(t[:WINDOW].ljust(WINDOW), np.uint8) for t in texts])
    y = np.array([names.index(one) for one in languages])
    rng = np.random.default_rng(seed)
    width = len(WIDTHS) * FILTERS
    net = ByteNet(
        names,
        [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(width, np.float32),
        rng.normal(0, 0.3, (width, len(names))).astype(np.float32),
        np.zeros(len(names), np.float32),
    )
    params = [*net.kernels, net.bias, net.dense, net.offset]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    weight = len(y) / (len(names) * np.bincount(y, minlength=len(names)))
    step = 0
    epochs = max(EPOCHS, -(-1500 * BATCH // max(1, len(y)))) if len(y) < 1500 * BATCH / EPOCHS else EPOCHS
    for _ in range(min(epochs, 60)):
        order = rng.permutation(len(y))
        for low in range(0, len(order), BATCH):
            some = order[low : low + BATCH]
            rows = x[some]
            pooled, places = net.pooled(rows)
            active = pooled + net.bias
            hidden = np.maximum(active, 0)
            p = _softmax(hidden @ net.dense + net.offset)
            p[np.arange(len(some)), y[some]] -= 1
            p *= (weight[y[some]] / len(some))[:, None]
            back = (p @ net.dense.T) * (active > 0)
            grads = []
            for k, (w, at) in enumerate(zip(WIDTHS, places)):
                g = np.zeros_like(net.kernels[k])
                part = back[:, k * FILTERS : (k + 1) * FILTERS]
                f = np.broadcast_to(np.arange(FILTERS), at.shape)
                for j in range(w):
                    np.add.at(g[j], (np.take_along_axis(rows, at + j, axis=1), f), part)
                grads.append(g)
            grads += [back.sum(axis=0), hidden.T @ p, p.sum(axis=0)]
            step += 1
            for q, g, m, v in zip(params, grads, first, second):
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                q -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS) -> ByteNet | None:
    labelled = docs.select("doc_id", "lang", "text").where(
        F.col("lang").isNotNull() & (common.fold_number(F.col("doc_id")) != HELD_OUT)
    )
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    cut = F.lit(0.0)
    for name, n in sizes.items():
        cut = F.when(F.col("lang") == name, F.lit(rows / len(sizes) / n)).otherwise(cut)
    chosen = labelled.where(
        (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < cut * (1 << 20)) & F.col("text").isNotNull()
    )
    length = F.greatest(F.char_length("text") - WINDOW, F.lit(0)) + 1
    starts = F.transform(
        F.sequence(F.lit(1), F.lit(SAMPLE_WINDOWS)), lambda k: F.pmod(F.xxhash64("doc_id", k), length).cast("int") + 1
    )
    windows = chosen.select(
        "lang", F.explode(F.transform(F.array_distinct(starts), lambda s: F.substring("text", s, F.lit(WINDOW)))).alias("w")
    )
    found = windows.collect()
    if not found:
        return None
    found = sorted((r["lang"], r["w"]) for r in found)
    return train([w.encode() for _, w in found], [lang for lang, _ in found])


def predict(docs: DataFrame, net: ByteNet | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, lang_pred, score)`` for every row."""
    if net is None:
        return docs.select(id_col, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        net = shared.value
        tables = net.__dict__.get("_folded") or net.folded()
        net._folded = tables
        texts = batch.column(1).to_pylist()
        coded = [(t or "").encode() for t in texts]
        counts = [max(1, -(-len(c) // WINDOW)) for c in coded]
        every = np.concatenate([windows_of(c) for c in coded])
        logs = np.concatenate(
            [tables.log_probabilities(every[k : k + WINDOWS_AT_ONCE]) for k in range(0, len(every), WINDOWS_AT_ONCE)]
        )
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        mean = np.add.reduceat(logs, starts, axis=0) / np.array(counts)[:, None]
        p = _softmax(mean)
        top = p.argmax(axis=1)
        known = [t is not None and any(map(str.isalpha, t)) for t in texts]
        names = [net.languages[k] if ok else "und" for k, ok in zip(top.tolist(), known)]
        values = np.where(known, p[np.arange(len(top)), top], 0.0).astype(np.float64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(names), pa.array(values)], [id_col, "lang_pred", "score"])

    rows = docs.select(id_col, F.col(text_col).alias("_text"))
    kind = rows.schema[id_col].dataType.simpleString()
    return common.map_batches(rows, run, f"`{id_col}` {kind}, lang_pred string, score double")


def op4_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return common.durable(predict(docs, fit(docs)), "languages").select(
        "doc_id", (common.fold_number(F.col("doc_id")) == HELD_OUT).alias("held_out"), "lang_pred", "score"
    )
