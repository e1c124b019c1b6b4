"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import fold

PLACES = 1 << 20
#: Bound of the labelled sample that is fitted, in one task.
FIT_ROWS, EPOCHS = 20_000, 3
#: L1 grows with the root of the rows, as sums of noise do; features of fewer rows are left out.
ALPHA, BETA, L1_ROOT, L2, LEAST_ROWS = 1.0, 1.0, 0.1, 0.1, 4
_WORD = re.compile(r"\w+")


class Hasher:
    """Places of the words, pairs of neighbours and pairs with one or two words between."""

    def __init__(self) -> None:
        self.seen: dict[str, int] = {}

    def places(self, text: str | None) -> np.ndarray:
        words = _WORD.findall((text or "").lower())
        if not words:
            return np.zeros(0, dtype=np.int64)
        seen = self.seen
        if len(seen) > 400_000:
            seen.clear()
        h = []
        for w in words:
            x = seen.get(w)
            if x is None:
                x = zlib.crc32(w.encode("utf-8", "surrogatepass"))
                if len(w) <= 64:
                    seen[w] = x
            h.append(x)
        h = np.array(h, dtype=np.uint64)
        mixed = [h * np.uint64(0x9E3779B97F4A7C15)]
        for gap in (1, 2, 3):
            mixed.append((h[:-gap] * np.uint64(0x9E3779B97F4A7C15) + h[gap:]) * np.uint64(0xC2B2AE3D27D4EB4F + 2 * gap))
        return (np.concatenate(mixed) >> np.uint64(44)).astype(np.int64)


def sigmoid(x: float) -> float:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def ftrl(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights of PLACES features and, last, the intercept, which is not penalised."""
    z, n = np.zeros(PLACES + 1), np.zeros(PLACES + 1)
    l1 = np.full(PLACES + 1, max(1.0, L1_ROOT * len(rows) ** 0.5))
    l1[PLACES] = 0

    def weights(at):
        zi = z[at]
        return np.where(np.abs(zi) <= l1[at], 0.0, -(zi - np.sign(zi) * l1[at]) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    counts = np.zeros(PLACES, dtype=np.int64)
    for at, _ in rows:
        counts[at] += 1
    rows = [(np.append(at[counts[at] >= LEAST_ROWS], PLACES), y) for at, y in rows]
    for _ in range(epochs):
        for at, y in rows:
            w = weights(at)
            g = sigmoid(w.sum()) - y
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
    return weights(np.arange(PLACES + 1))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(places, weights) that are not 0, fitted on ``fit_rows`` labelled rows at most.

    They are those with the least hash of their id among rows with a label whose crc32(id)
    mod 5 is not 0; an id with several labels takes the largest. Tasks make the features;
    one task runs the online learner over the sample in the order of the hash.
    """
    named = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).where(fold(F.col(id_col)) != 0)
    some = named.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    some = some.withColumn("h", F.xxhash64("id")).orderBy("h", "id").limit(fit_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # Bounded: fit_rows ids and labels, and of each id the row with the least hash of its text.
    texts = texts.join(F.broadcast(some), "id").groupBy("id", "y", "h").agg(F.min(F.struct(F.xxhash64("text").alias("t"), "text")).alias("r")).select("r.text", "y", "h")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            at = [np.unique(hasher.places(t.as_py())).astype(np.int32) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.list_(pa.int32())), *b.columns[1:]], names=["at", "y", "h"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in batches:
            rows += [(a.values.to_numpy(), y.as_py()) for a, y in zip(b.column(0), b.column(1))]
        if rows:
            w = ftrl(rows)
            at = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], names=["at", "w"])

    rows = texts.mapInArrow(features, "at array<int>, y int, h long")
    # PLACES rows at most, few of them not 0.
    model = rows.repartition(1).sortWithinPartitions("h", "y").mapInArrow(train, "at long, w double").collect()
    model.sort()
    return np.array([r.at for r in model], dtype=np.int64), np.array([r.w for r in model], dtype=np.float64)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(id_col, held_out, score, predicted) for every row of ``docs``; fits on ``labels`` first.

    The score is the probability of label 1 from the presence of features in the whole
    text. Null and empty texts have no features and get the intercept's score; without any
    label all get 0.5, and predicted is then 1. Rows with a null id are held out.
    """
    at, w = fit(docs, labels, id_col, text_col, label_col)
    sent = docs.sparkSession.sparkContext.broadcast((at, w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w = sent.value
        weight = np.zeros(PLACES + 1)
        weight[at] = w
        used, hasher = weight != 0, Hasher()
        for b in batches:
            scores = []
            for t in b.column(1):
                x = hasher.places(t.as_py())
                scores.append(sigmoid(weight[PLACES] + weight[np.unique(x[used[x]])].sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, score double")
    return out.select(F.col("id").alias(id_col), (fold(F.col("id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
