"""Toxicity by class-conditional Kneser-Ney models.

Two models of the letters of words, one of toxic and one of ordinary labelled
documents.  Each interpolates its own counts of ``ORDER``-letter sequences with
absolute discounting, and both back off to the same lower orders: Kneser-Ney
continuation counts pooled over the classes.  A rare expression is thus judged
by its stem as far as either class knows the stem, and alike by both beyond.
A text's score is the toxic less the ordinary log-likelihood, over all of its
letters and word ends, divided by their number, and put on a scale of 0 to 1 by
a logistic curve.

Learning: a document counts each of its words once, so that repetitions and
long texts don't outweigh others, and texts that repeat are learned from once.
Order, discount and sample sizes were chosen by, and the curve is fitted on,
labelled rows of the fold ``CALIBRATION``, which the models did not see; rows
of the fold ``HELD_OUT`` had no part in either.

Bounded sample: at most about ``PER_CLASS`` labelled rows of each class
(chosen by a hash of the id) are used for fitting; every text is scored whole.
What comes to the driver, and goes to the workers as a broadcast, is the counts
of distinct sequences of ``ORDER`` letters in those rows.

Defined results: a null or empty text has difference 0; without labelled rows
of both classes every score is 0.5 times the share of toxic labels plus 0.25;
equal rows give equal rows; labels that are null, neither 0 nor 1, or of a row
held out are not used; a null id takes part as the empty text in the choice of
folds; other columns are ignored.
"""

from __future__ import annotations

import gc
import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ORDER = 3
PER_CLASS = 12_000
HELD_OUT, CALIBRATION = 0, 4
DISCOUNT = 0.5
LETTERS = 512  #: of the uniform base
REMEMBERED = 400_000
BEGIN, END = "\x02", "\x03"


def split(text: str) -> list[str]:
    return text.lower().split()


def grams(word: str) -> list[str]:
    """What a word is a sequence of: each of its letters, and its end, after the letters before it."""
    line = BEGIN + word + END
    return [line[max(0, i - ORDER + 1) : i + 1] for i in range(1, len(line))]


class KneserNey:
    """Both class models and their shared lower orders."""

    def __init__(self, counts: dict[str, tuple[int, int]]):
        """``counts``: sequence of letters, as ``grams`` gives them -> times in (ordinary, toxic) rows."""
        own = tuple(Counter({g: n[c] for g, n in counts.items() if n[c]}) for c in (0, 1))
        kinds: list[set[str]] = [set() for _ in range(ORDER + 1)]
        for gram in counts:
            kinds[len(gram)].add(gram)
        # a sequence of k letters that starts a word stands for itself; others continue one of k + 1
        below: list[Counter] = [Counter() for _ in range(ORDER)]
        for k in range(ORDER, 1, -1):
            for gram in kinds[k]:
                short = gram[1:]
                below[k - 1][short] += 1
                if k > 2:
                    kinds[k - 1].add(short)
        self.own = own
        self.contexts = tuple(self._contexts(c) for c in own)
        self.below = below
        self.below_contexts = [self._contexts(c) for c in below]
        self.shift, self.slope = 0.0, 1.0
        self._ready()

    def _ready(self) -> None:
        self.known: dict[str, float] = {}
        self.words: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "words")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._ready()

    @staticmethod
    def _contexts(counts: Counter) -> dict[str, tuple[int, int]]:
        """context -> (times, kinds of letters after it)"""
        total: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for gram, n in counts.items():
            found = total[gram[:-1]]
            found[0] += n
            found[1] += 1
        return {k: (v[0], v[1]) for k, v in total.items()}

    def shared(self, gram: str) -> float:
        """Pooled Kneser-Ney probability of the last letter of ``gram`` after the others."""
        p = 1 / LETTERS
        for k in range(1, len(gram) + 1):
            part = gram[-k:]
            context = self.below_contexts[k].get(part[:-1]) if k < ORDER else None
            if context is None:
                break
            n, kinds = context
            p = (max(self.below[k].get(part, 0) - DISCOUNT, 0) + DISCOUNT * kinds * p) / n
        return p

    def of_gram(self, gram: str) -> float:
        """Difference of the classes' log-probabilities of the last letter."""
        context = gram[:-1]
        known = [c.get(context) for c in self.contexts]
        if known == [None, None]:
            return 0.0
        back = self.shared(gram[1:])
        logs = []
        for c in (0, 1):
            if known[c] is None:
                logs.append(math.log(back))
                continue
            n, kinds = known[c]
            logs.append(math.log((max(self.own[c].get(gram, 0) - DISCOUNT, 0) + DISCOUNT * kinds * back) / n))
        return logs[1] - logs[0]

    def of_word(self, word: str) -> float:
        total, known = 0.0, self.known
        for gram in grams(word):
            d = known.get(gram)
            if d is None:
                if len(known) > 2 * REMEMBERED:
                    known.clear()
                d = known[gram] = self.of_gram(gram)
            total += d
        return total

    def difference(self, text: str | None) -> float:
        """Toxic minus ordinary log-likelihood, per letter (word ends count as one)."""
        words = split(text or "")
        if not words:
            return 0.0
        known = self.words
        found = list(map(known.get, words))
        if None in found:
            if len(known) > REMEMBERED:
                known.clear()
            for w in set(words):
                if w not in known:
                    known[w] = self.of_word(w)
            found = list(map(known.__getitem__, words))
        return math.fsum(found) / (sum(map(len, words)) + len(words))

    def score(self, text: str | None) -> float:
        z = self.shift + self.slope * self.difference(text)
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def calibrate(differences: list[float], labels: list[int]) -> tuple[float, float]:
    """Logistic curve by Newton steps, a little ridge; classes are weighted by the square root of what would even them out."""
    x, y = np.array(differences), np.array(labels, float)
    if len(set(labels)) < 2:
        return 0.0, 1.0
    scale = x.std() or 1.0
    design = np.stack([np.ones(len(x)), x / scale], axis=1)
    weight = np.sqrt(np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())))
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (weight * (p - y)) + 0.01 * w * [0, 1]
        hess = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag([1e-9, 0.01])
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1] / scale)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> KneserNey | float:
    """The fitted models, or the share of toxic labels if there is only one class."""
    fold = common.fold_number(F.col("doc_id"))
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(
        (fold != HELD_OUT) & F.col("toxic").isin(0, 1)
    )
    sizes = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return float(next(iter(sizes), 0))
    cut = F.lit(0.0)
    for c, n in sizes.items():
        cut = F.when(F.col("toxic") == c, F.lit(per_class / n)).otherwise(cut)
    chosen = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < cut * (1 << 20)).distinct()
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    rows = common.durable(rows, "labelled")
    learned = rows.where(fold != CALIBRATION).dropDuplicates(["toxic", "text"]).select("toxic", "text")
    counts = common.durable(_count(learned), "grams").toArrow()
    columns = (counts.column(c).to_pylist() for c in ("gram", "ordinary", "bad"))
    model = KneserNey({g: (o, t) for g, o, t in zip(*columns)})
    check = common.durable(_differences(rows.where(fold == CALIBRATION).select("toxic", "text"), model), "differences").toPandas()
    model.shift, model.slope = calibrate(check["value"].tolist(), check["toxic"].tolist())
    return model


def _count(rows: DataFrame) -> DataFrame:
    """``(gram, ordinary, bad)``: words of either class with the sequence, each document's words once."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = (Counter(), Counter())
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words[label].update(set(split(text)))
        found = (Counter(), Counter())
        for c in (0, 1):
            for word, n in words[c].items():
                for gram in grams(word):
                    found[c][gram] += n
        every = list(found[0] | found[1])
        columns = [pa.array(every, pa.string()), *(pa.array([f[g] for g in every], pa.int64()) for f in found)]
        return pa.RecordBatch.from_arrays(columns, ["gram", "ordinary", "bad"])

    made = common.map_batches(rows, run, "gram string, ordinary long, bad long")
    return made.groupBy("gram").agg(F.sum("ordinary").alias("ordinary"), F.sum("bad").alias("bad"))


def _differences(rows: DataFrame, model: KneserNey) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = [shared.value.difference(t) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], ["toxic", "value"])

    return common.map_batches(rows, run, "toxic int, value double")


def score(docs: DataFrame, model: KneserNey | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` for every row."""
    if isinstance(model, float):
        return docs.select(id_col, F.lit(0.5 * model + 0.25).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        gc.disable()  # large tables without cycles
        values = [shared.value.score(t) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], [id_col, "score"])

    rows = docs.select(id_col, F.col(text_col).alias("_text"))
    return common.map_batches(rows, run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, score double")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return common.durable(score(docs, model), "toxicity").select(
        "doc_id",
        (common.fold_number(F.col("doc_id")) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
