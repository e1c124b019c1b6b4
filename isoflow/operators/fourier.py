"""Fourier transforms of series that no task holds whole.

A series of N = N1 N2 values is a table of N1 rows: columns are transformed, turned by the
twiddle factors, and then rows are transformed. Lengths without two balanced factors go by a
chirp: their transform is a convolution, made of transforms of a power of two.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .blocks import kept

#: Values of a group at most, where several short lines of the table are transformed at once.
GROUP_ROWS = 50_000
#: A length whose larger factor is beyond this goes by the chirp.
LONGEST_LINE = 1_000_000

SERIES = "series int, n long, re double, im double"


def factors(length: int) -> tuple[int, int]:
    """N1 <= N2 with N1 N2 = length, as near to each other as can be."""
    a = math.isqrt(length)
    while length % a:
        a -= 1
    return a, length // a


def lines(df: DataFrame, line: Column, place: Column, count: int, size: int, finish: Callable) -> DataFrame:
    """Transforms each line (a column of values with places 0 .. size - 1) of each series; ``finish`` turns (line, place, values) into rows (n, values)."""
    at_once = max(1, min(GROUP_ROWS // size, math.ceil(count / (2 * df.sparkSession.sparkContext.defaultParallelism))))

    def run(key, p: pd.DataFrame) -> pd.DataFrame:
        first = int(key[1]) * at_once
        width = min(at_once, count - first)
        x = np.zeros((width, size), dtype=np.complex128)
        x[p.line.to_numpy() - first, p.place.to_numpy()] = p.re.to_numpy() + 1j * p.im.to_numpy()
        n, z = finish(np.arange(first, first + width)[:, None], np.arange(size)[None, :], np.fft.fft(x, axis=1))
        return pd.DataFrame({"series": np.int32(key[0]), "n": n.ravel(), "re": z.real.ravel(), "im": z.imag.ravel()})

    rows = df.select("series", line.alias("line"), place.alias("place"), "re", "im")
    return rows.groupBy("series", F.floor(F.col("line") / at_once).alias("part")).applyInPandas(run, SERIES)


def four_step(df: DataFrame, length: int) -> DataFrame:
    n1, n2 = factors(length)

    def turned(line, k, x):
        return k * n2 + line, x * np.exp(-2j * np.pi * ((line * k) % length) / length)

    # n = N2 a + b: over a for each b, then over b for each k1.
    half = lines(df, F.col("n") % n2, F.floor(F.col("n") / n2), n2, n1, turned)
    return lines(half, F.floor(F.col("n") / n2), F.col("n") % n2, n1, n2, lambda line, k, x: (line + n1 * k, x))


def scaled(df: DataFrame, angle: Column) -> DataFrame:
    """Values times exp(i angle)."""
    c, s = F.cos(angle), F.sin(angle)
    return df.select("series", "n", (F.col("re") * c - F.col("im") * s).alias("re"), (F.col("re") * s + F.col("im") * c).alias("im"))


def chirped(df: DataFrame, length: int) -> DataFrame:
    m = 1 << (2 * length - 1).bit_length()
    spark = df.sparkSession
    # exp(-+ i pi n^2 / N); n^2 modulo 2 N keeps the angle small.
    turn = F.lit(math.pi / length) * ((F.col("n") * F.col("n")) % (2 * length))
    a = scaled(df, -turn)
    series = df.select("series").distinct()
    both = spark.range(length).select(F.col("id").alias("n"), F.lit(1.0).alias("re"), F.lit(0.0).alias("im"), F.lit(0).alias("series"))
    b = scaled(both, turn)
    b = b.unionByName(b.where("n > 0").withColumn("n", m - F.col("n")))
    fa, fb = four_step(a, m), four_step(b, m).select("n", F.col("re").alias("x"), F.col("im").alias("y"))
    product = fa.join(fb, "n").select("series", "n", (F.col("re") * F.col("x") - F.col("im") * F.col("y")).alias("re"), (F.col("re") * F.col("y") + F.col("im") * F.col("x")).alias("im"))
    back = inverse(product, m, four_step).where(F.col("n") < length)
    return scaled(back, -turn).join(series, "series", "left_semi")


def transform(df: DataFrame, length: int) -> DataFrame:
    """(series, n, re, im): sums over n of value exp(-2 pi i n k / length), for every series of (series, n, re, im); missing values are 0."""
    own = four_step if factors(length)[1] <= LONGEST_LINE else chirped
    return own(df, length)


def inverse(df: DataFrame, length: int, forward=None) -> DataFrame:
    """The values whose ``transform`` is ``df``."""
    conjugate = df.select("series", "n", "re", (-F.col("im")).alias("im"))
    out = (forward or transform)(conjugate, length)
    return out.select("series", "n", (F.col("re") / length).alias("re"), (-F.col("im") / length).alias("im"))


def filtered(df: DataFrame, length: int, low: int | None = None, share: float | None = None) -> DataFrame:
    """The series with only the first and last ``low`` coefficients, or with those that reach ``share`` of the largest of any series; the constant stays."""
    z = kept(transform(df, length))
    if low is not None:
        stays = (F.col("n") < low) | (F.col("n") >= length - low)
    else:
        size = F.hypot("re", "im")
        most = z.where("n > 0").agg(F.max(size)).first()[0] or 0.0
        stays = size >= share * most
    return inverse(z.where((F.col("n") == 0) | stays), length)
