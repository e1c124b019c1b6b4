"""The fitted models against plain versions."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from isoflow.llm import langid, toxicity

MASK = (1 << 64) - 1


def plain_places(text):
    h = [zlib.crc32(w.encode()) for w in re.findall(r"\w+", (text or "").lower())]
    mixed = [x * 0x9E3779B97F4A7C15 & MASK for x in h]
    for gap in (1, 2, 3):
        mixed += [((a * 0x9E3779B97F4A7C15 + b) & MASK) * (0xC2B2AE3D27D4EB4F + 2 * gap) & MASK for a, b in zip(h, h[gap:])]
    return sorted({x >> 44 for x in mixed})


def plain_ftrl(rows, epochs):
    """Weights by feature; the feature None is the intercept."""
    counts: dict = {}
    for at, _ in rows:
        for f in at:
            counts[f] = counts.get(f, 0) + 1
    l1 = max(1.0, toxicity.L1_ROOT * len(rows) ** 0.5)
    z: dict = {}
    n: dict = {}

    def weight(f):
        zi, penalty = z.get(f, 0.0), 0.0 if f is None else l1
        if abs(zi) <= penalty:
            return 0.0
        return -(zi - np.sign(zi) * penalty) / ((toxicity.BETA + n.get(f, 0.0) ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for _ in range(epochs):
        for at, y in rows:
            own = [f for f in at if counts[f] >= toxicity.LEAST_ROWS] + [None]
            w = {f: weight(f) for f in own}
            g = 1 / (1 + np.exp(-np.clip(sum(w.values()), -35, 35))) - y
            for f in own:
                step = ((n.get(f, 0.0) + g * g) ** 0.5 - n.get(f, 0.0) ** 0.5) / toxicity.ALPHA
                z[f] = z.get(f, 0.0) + g - step * w[f]
                n[f] = n.get(f, 0.0) + g * g
    return {f: weight(f) for f in z if weight(f)}


def test_toxicity_equals_plain_ftrl(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(40)] + ["Ärger", "rude", "vile"]
    rows = [(i, " ".join(rng.choice(words, rng.integers(1, 15)))) for i in range(200)] + [(900, None), (901, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int("vile" in (t or "") or "rude" in (t or ""))) for i, t in rows], "doc_id long, toxic int")
    hashes = {r.doc_id: r.h for r in df.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    label = {r.doc_id: r.toxic for r in labels.collect()}
    used = sorted((x for x in rows if zlib.crc32(str(x[0]).encode()) % 5), key=lambda x: hashes[x[0]])
    want = plain_ftrl([(plain_places(t), label[i]) for i, t in used], toxicity.EPOCHS)
    at, w = toxicity.fit(df, labels)
    got = {None if a == toxicity.PLACES else int(a): float(x) for a, x in zip(at, w)}
    assert got.keys() == want.keys() and len(want) > 2 and all(got[f] == pytest.approx(want[f], abs=1e-9) for f in want)
    scores = {r.doc_id: r.score for r in toxicity.toxicity(df, labels).collect()}
    for i, t in rows:
        x = want.get(None, 0.0) + sum(want.get(f, 0.0) for f in plain_places(t))
        assert scores[i] == pytest.approx(1 / (1 + np.exp(-x)), abs=1e-9)


def plain_grams(text):
    s = " " + re.sub(r"[\W\d_]+", " ", (text or "").lower()).strip() + " "
    return {s[i : i + n] for n in langid.ORDERS for i in range(len(s) - n + 1)}


def test_language_equals_exact_kernel_ridge(spark):
    rng = np.random.default_rng(6)
    stems = {"aa": ["banana", "karak", "tapas", "malama"], "bb": ["schloß", "über", "acht", "nicht"], "cc": ["élan", "œuvre", "que", "naïf"]}
    rows = [(i, " ".join(rng.choice(stems[g] + ["la", "de", "x"], rng.integers(2, 9))), g) for i, g in enumerate(rng.choice(list(stems), 90))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    used = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 5]
    # Every row is a landmark, so nothing is approximated.
    model = langid.fit(df, landmarks=langid.FIT_ROWS)
    sets = [plain_grams(t) for _, t, _ in rows]
    kernel = np.array([[len(a & b) / (len(a) * len(b)) ** 0.5 for b in sets] for a in sets])
    own = [x[0] for x in used]
    k = kernel[np.ix_(own, own)]
    n = len(own)
    h = np.eye(n) - 1 / n
    y = np.array([[1.0 if g == lang else -1.0 for lang in model.languages] for _, _, g in used])
    alpha = np.linalg.solve(h @ k @ h + langid.RIDGE * n * np.eye(n), y - y.mean(axis=0))
    want = y.mean(axis=0) + (kernel[:, own] - k.mean(axis=0)) @ h @ alpha
    seen = np.zeros(langid.PLACES, dtype=bool)
    got = model.scores([langid.grams(t, seen) for _, t, _ in rows])
    assert model.languages == sorted(stems) and np.allclose(got, want, atol=5e-3)
    predicted = {r.doc_id: r.lang_pred for r in langid.identify(df).collect()}
    assert [predicted[i] for i, _, _ in rows] == [g for _, _, g in rows]
