"""Language identification: blended-spectrum kernels, Nystrom landmarks, kernel ridge regression."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from .common import fold

#: Character n-grams of these lengths, hashed to so many places.
ORDERS, PLACES = (1, 2, 3), 1 << 18
#: Bound of the sample that is fitted: rows for each language, and landmarks among them.
FIT_ROWS, LANDMARKS, RIDGE = 400, 24, 1e-3
#: Parts in which a language's sample is chosen before it is chosen as a whole; each gives SLOT_SHARE times its even share at most.
SLOTS, SLOT_SHARE = 256, 4
UNKNOWN = "und"
_OTHER = re.compile(r"[\W\d_]+")


def grams(text: str | None, seen: np.ndarray) -> np.ndarray | None:
    """Places of the n-grams present in the whole text, ascending; None without a letter.

    Texts are lower-cased and everything but letters is one blank. ``seen`` is scratch
    space of PLACES zeros, left as it was.
    """
    s = _OTHER.sub(" ", (text or "").lower()).strip()
    if not any(map(str.isalpha, set(s))):
        return None
    cp = np.frombuffer(f" {s} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    h = np.zeros(len(cp), dtype=np.uint64)
    for n in range(1, max(ORDERS) + 1):
        h = (h[: len(cp) - n + 1] + cp[n - 1 :] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        if n in ORDERS:
            seen[(h >> np.uint64(46)).astype(np.int64)] = True
    at = np.flatnonzero(seen)
    seen[at] = False
    return at


@dataclass
class Model:
    languages: list[str]
    row_of: np.ndarray  # place -> row of marks, -1 if no landmark has the n-gram
    marks: np.ndarray  # presence in each landmark, divided by the root of the landmark's size
    weights: np.ndarray  # landmark kernel -> score of each language
    bias: np.ndarray

    def kernels(self, present: list[np.ndarray]) -> np.ndarray:
        """Normalised presence kernel of each text with each landmark."""
        x = np.zeros((len(present), len(self.marks)), dtype=np.float32)
        for i, at in enumerate(present):
            rows = self.row_of[at]
            x[i, rows[rows >= 0]] = len(at) ** -0.5
        return x @ self.marks

    def scores(self, present: list[np.ndarray]) -> np.ndarray:
        return self.kernels(present) @ self.weights + self.bias


def marks_of(present: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    used = np.unique(np.concatenate(present))
    row_of = np.full(PLACES, -1, dtype=np.int32)
    row_of[used] = np.arange(len(used))
    marks = np.zeros((len(used), len(present)), dtype=np.float32)
    for j, at in enumerate(present):
        marks[row_of[at], j] = len(at) ** -0.5
    return row_of, marks


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS, landmarks: int = LANDMARKS) -> Model | None:
    """Fits on ``fit_rows`` rows of each language at most, whose crc32(id) mod 5 is not 0.

    They are those with the least hash of their id, of at most SLOT_SHARE times the even share
    of each slot of ids, the first ``landmarks`` of them the Nystrom landmarks. Tasks make the kernels of the sampled texts; the driver gets a row
    of landmark kernels for each and solves one ridge regression for each language.
    None if no row can be learned from.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang")).where("lang IS NOT NULL AND id IS NOT NULL")
    # An id counts once, with its first language, however many rows repeat it.
    narrow = narrow.groupBy("id").agg(F.min("lang").alias("lang"))
    # First by slot, so that the task of a language gets about SLOT_SHARE * fit_rows rows however many it has.
    narrow = narrow.where(fold(F.col("id")) != 0).withColumn("slot", F.pmod(F.hash("id"), F.lit(SLOTS)))
    for keys, most in ((["lang", "slot"], max(8, SLOT_SHARE * fit_rows // SLOTS)), (["lang"], fit_rows)):
        order = F.row_number().over(W.partitionBy(*keys).orderBy(F.xxhash64("id"), "id"))
        narrow = narrow.withColumn("n", order).where(F.col("n") <= most)
    some = narrow.drop("slot")
    # Bounded: fit_rows ids for each language, and of each id the row with the least hash of its text.
    texts = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(some), ["id", "lang"])
    texts = texts.groupBy("id", "lang", "n").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("r")).select("r.text", "lang", "n", "id")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(PLACES, dtype=bool)
        for b in batches:
            got = [grams(t.as_py(), seen) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([None if g is None else g.astype(np.int32) for g in got], pa.list_(pa.int32())), *b.columns[1:]], names=["at", "lang", "n", "id"])

    marked = texts.where(F.col("n") <= landmarks).mapInArrow(places, "at array<int>, lang string, n int, id long").where("at IS NOT NULL").orderBy("lang", "n").collect()
    if not marked:
        return None
    row_of, marks = marks_of([np.array(r.at) for r in marked])
    model = Model([], row_of, marks, np.zeros((marks.shape[1], 0)), np.zeros(0))
    sent = spark.sparkContext.broadcast(tuple(vars(model).values()))

    def kernels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, m = np.zeros(PLACES, dtype=bool), Model(*sent.value)
        for b in batches:
            got = [grams(t.as_py(), seen) for t in b.column(0)]
            some = [i for i, g in enumerate(got) if g is not None]
            for a in range(0, len(some), 128):
                part = some[a : a + 128]
                k = m.kernels([got[i] for i in part])
                yield pa.RecordBatch.from_arrays([pa.array(list(k), pa.list_(pa.float32())), b.column(1).take(pa.array(part))], names=["k", "lang"])

    rows = texts.mapInArrow(kernels, "k array<float>, lang string").collect()
    languages = sorted({r.lang for r in rows})
    k = np.array([r.k for r in rows], dtype=np.float64)
    y = np.array([[1.0 if r.lang == g else -1.0 for g in languages] for r in rows])
    # Nystrom: features k K_mm^-1/2, ridge regression on them, folded back onto the kernels.
    mm = marks.T.astype(np.float64) @ marks
    val, vec = np.linalg.eigh(mm)
    keep = val > 1e-8
    root = vec[:, keep] / np.sqrt(val[keep])
    phi = k @ root
    mean, ymean = phi.mean(axis=0), y.mean(axis=0)
    z = phi - mean
    beta = np.linalg.solve(z.T @ z + RIDGE * len(z) * np.eye(z.shape[1]), z.T @ (y - ymean))
    return Model(languages, row_of, marks, (root @ beta).astype(np.float32), ymean - mean @ beta)


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """(row, lang_pred, score) for every row of ``docs``; row is a struct of all its columns, score is from 0 to 1.

    Null texts and texts without a letter get 'und' and score 0, as all do without a model.
    Ties go to the first language in order.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model and tuple(vars(model).values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, seen = sent.value and Model(*sent.value), np.zeros(PLACES, dtype=bool)
        for b in batches:
            lang, score = [UNKNOWN] * b.num_rows, np.zeros(b.num_rows)
            held: list[tuple[int, np.ndarray]] = []

            def flush() -> None:
                s = m.scores([g for _, g in held])
                for (i, _), j, v in zip(held, s.argmax(axis=1), s.max(axis=1)):
                    lang[i], score[i] = m.languages[j], min(1.0, max(0.0, (float(v) + 1) / 2))
                held.clear()

            if m is not None:
                for i, t in enumerate(b.column(1)):
                    g = grams(t.as_py(), seen)
                    if g is not None:
                        held.append((i, g))
                        if len(held) == 64:
                            flush()
                if held:
                    flush()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score)], names=["row", "lang_pred", "score"])

    rows = docs.select(F.struct("*").alias("row"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id_col, held_out, lang_pred, score) for every row of ``docs``; fits on them first.

    held_out: crc32(id as text) mod 5 is 0. Rows with a null id are held out.
    """
    model = fit(docs, id_col, text_col, lang_col)
    out = predict(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), model)
    return out.select(F.col("row.id").alias(id_col), (fold(F.col("row.id")) == 0).alias("held_out"), "lang_pred", "score")


def identified_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that have a language, with all their columns; a null language becomes the predicted one.

    Those are the rows whose text has a letter: null, empty and other texts go. Without a
    model (no row to learn from, as in an empty table) a null language stays null. Repeated
    rows and null ids are kept; other columns may have any names.
    """
    model = fit(docs, id_col, text_col, lang_col)
    if model is None:
        return with_letters(docs, text_col)
    found = predict(docs, model, text_col).where(F.col("lang_pred") != UNKNOWN)
    row, kinds = F.col("row"), dict(docs.dtypes)
    return found.select(*((F.coalesce(row[c], F.col("lang_pred").cast(kinds[c])) if c == lang_col else row[c]).alias(c) for c in docs.columns))


def with_letters(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text has a letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [any(map(str.isalpha, set(t.as_py() or ""))) for t in b.column(1)]
            yield b.select([0]).filter(pa.array(ok, pa.bool_()))

    rows = docs.select(F.struct("*").alias("row"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, T.StructType([rows.schema["row"]])).select("row.*")
