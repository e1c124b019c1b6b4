"""Frames: summaries, splits, centring, features, contacts, smoothing.

Frames are (frame bigint, coords array<array<double>>) with further columns such as time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geometry import let, minus, total
from . import fourier
from .blocks import kept


def summary(frames: DataFrame) -> DataFrame:
    """Frames, atoms, first and last time, precision of the last frame."""
    return frames.agg(
        F.count("*").alias("n_frames"),
        F.min_by(F.size("coords"), "frame").alias("n_atoms"),
        F.min_by("time", "frame").alias("start_time"),
        F.max_by("time", "frame").alias("end_time"),
        F.max_by("prec", "frame").alias("prec"),
    )


def rekey(df: DataFrame, key: str = "frame", to: str = "frame") -> DataFrame:
    """Numbers rows 0, 1, .. in the order of ``key``, nulls first, whatever its type; ``to`` replaces a column of that name.

    Rows are dealt by range and sorted there; the number is the place in the range and the
    rows of the ranges before, so no task orders all rows. Equal keys keep the order they
    are read in. What comes to the driver is a count for each range.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.struct("*").alias("row"), F.col(key).alias("key"), F.monotonically_increasing_id().alias("read"))
    order = [F.asc_nulls_first("key"), F.col("read")]
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # The id holds the range above bit 33 and the place below.
    rows = kept(rows.select("row", F.monotonically_increasing_id().alias("at")))
    part = F.shiftright("at", 33).cast("int")
    sizes = {r.part: r["count"] for r in rows.groupBy(part.alias("part")).count().collect()}
    before, total = [], 0
    for p in range(max(sizes, default=0) + 1):
        before.append(total)
        total += sizes.get(p, 0)
    number = F.get(F.array(*(F.lit(x).cast("long") for x in before)), part) + F.col("at").bitwiseAND((1 << 33) - 1)
    return rows.select(*(F.col("row").getField(c).alias(c) for c in df.columns if c != to), number.alias(to))


def split(frames: DataFrame, n: int, key: str = "frame") -> tuple[DataFrame, DataFrame]:
    """Landmarks, every n-th row, and the remainder; both in order."""
    return frames.where(F.col(key) % n == 0), frames.where(F.col(key) % n != 0)


def masses_of(masses: list[float] | None, coords: Column) -> Column:
    return F.transform(coords, lambda _: F.lit(1.0)) if masses is None else F.array(*map(F.lit, masses))


def centre_of_mass(coords: Column, masses: list[float] | None = None, atoms: list[int] | None = None) -> Column:
    """Weighted mean position of all atoms or some."""
    if atoms is not None:
        coords = F.array(*(coords[a] for a in atoms))
        masses = None if masses is None else [float(masses[a]) for a in atoms]
    m = masses_of(masses, coords)

    def mean(k: int) -> Column:
        return total(F.zip_with(coords, m, lambda p, w: p[k] * w)) / total(m)

    return F.array(*map(mean, range(3)))


def centred(coords: Column, masses: list[float] | None = None) -> Column:
    """Positions relative to the centre of mass."""
    return let(centre_of_mass(coords, masses), lambda c: F.transform(coords, lambda p: minus(p, c)))


def sample(df: DataFrame, n: int, key: str, seed: int = 42, digest: str = "xxhash64") -> DataFrame:
    """n rows without replacement, the same in every run: those with the least hash of seed and key (P5).

    ``digest`` "md5" takes the MD5 of ``seed:key``, which other engines have too.
    """
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null"))).cast("binary")) if digest == "md5" else F.xxhash64(F.lit(seed), key)
    return df.orderBy(hashed, key).limit(n)


def replicates(frames: DataFrame, block: int, out_of_sample: Column | None = None, outside: int = 0, key: str = "frame") -> DataFrame:
    """Replicate number of each frame: blocks of ``block`` frames from 1 on, ``outside`` for frames out of sample."""
    r = F.floor(F.col(key) / block).cast("long") + 1
    if out_of_sample is not None:
        r = F.when(out_of_sample, F.lit(outside).cast("long")).otherwise(r)
    return frames.withColumn("replicate", r)


def near_pairs(x: np.ndarray, y: np.ndarray, reach: float) -> np.ndarray:
    """i * |y| + j of the points of ``x`` and ``y`` closer than ``reach``, ascending; points that are not finite are near none.

    Points of ``y`` are sorted by the cell of a grid of that side, and each of ``x`` meets
    those of its own and the adjoining cells only.
    """
    fx, fy = (np.flatnonzero(np.isfinite(p).all(axis=1)) for p in (x, y))
    if reach <= 0 or not len(fx) or not len(fy):
        return np.zeros(0, dtype=np.int64)
    low = np.minimum(x[fx].min(axis=0), y[fy].min(axis=0))
    span = np.maximum(x[fx].max(axis=0), y[fy].max(axis=0)) - low
    # A wider side is as right; it keeps cell numbers small in sparse structures.
    side = np.maximum(reach * (1 + 1e-9), span / 1_000_000)
    cx, cy = (np.floor((p - low) / side).astype(np.int64) + 1 for p in (x[fx], y[fy]))
    shape = np.floor(span / side).astype(np.int64) + 3
    ky = (cy[:, 0] * shape[1] + cy[:, 1]) * shape[2] + cy[:, 2]
    order = np.argsort(ky, kind="stable")
    ky, hits = ky[order], []
    step = 4096
    for a in range(0, len(fx), step):
        for dx in (-1, 0, 1):
            for dy in (-1, 0, 1):
                # Three cells along the last axis adjoin in the order of y.
                c = cx[a : a + step]
                k = ((c[:, 0] + dx) * shape[1] + c[:, 1] + dy) * shape[2] + c[:, 2]
                lo, hi = np.searchsorted(ky, k - 1), np.searchsorted(ky, k + 1, "right")
                n = hi - lo
                i = np.repeat(np.arange(len(c)), n)
                j = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
                gap = x[fx[a + i]] - y[fy[j]]
                ok = np.sqrt(np.einsum("ij,ij->i", gap, gap)) < reach
                hits.append(fx[a + i[ok]] * len(y) + fy[j[ok]])
    return np.sort(np.concatenate(hits))


def atoms_of(coords: list | None) -> np.ndarray | None:
    """(atoms, 3); an atom that is null, holds null or has other than three numbers keeps its place as NaN."""
    if coords is None:
        return None
    sound = [p if p is not None and len(p) == 3 and None not in p else (np.nan,) * 3 for p in coords]
    return np.array(sound, dtype=np.float64).reshape(-1, 3)


def contacts(frames: DataFrame, epsilon: float = 9.0, group1: list[int] | None = None, group2: list[int] | None = None, scale: float = 10.0) -> DataFrame:
    """(frame, idx, val): pairs of atoms closer than ``epsilon`` (strictly), as a sparse vector of ones (F1).

    Feature i * |group2| + j is the pair of places i and j within the groups. ``scale``
    turns the unit of the coordinates into that of ``epsilon``; nanometres and Angstrom by
    default. Pairs are found in a grid of cells inside the row, so nothing is shuffled. A
    null frame has nulls; an atom that is null, has null or other than three coordinates or
    ones that are not finite keeps its place and touches nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for c in b.column(1):
                p = atoms_of(c.as_py())
                found.append(None if p is None else near_pairs(*(p * scale if g is None else p[g] * scale for g in (group1, group2)), epsilon))
            idx = pa.array(found, pa.list_(pa.int64()))
            ones = pa.array([None if f is None else np.ones(len(f)) for f in found], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), idx, ones], names=["frame", "idx", "val"])

    return frames.select(F.col("frame").cast("long"), F.col("coords").cast("array<array<double>>")).mapInArrow(run, "frame long, idx array<long>, val array<double>")


def contact_pairs(atoms: DataFrame, epsilon: float = 9.0, scale: float = 10.0) -> DataFrame:
    """(frame, a, b) of the ``atoms(frame, atom, x, y, z)`` of a frame that are closer than ``epsilon`` (strictly), both ways and with themselves (F1).

    For structures of any size: atoms are dealt by the cell of a grid of side ``epsilon``,
    each meets those of its own and the 26 adjoining cells, and no row holds a structure.
    Atoms with null or non-finite coordinates touch nothing.
    """
    sound = F.lit(True)
    for c in "xyz":
        sound = sound & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    own = atoms.where(sound).select("frame", "atom", *((F.col(c).cast("double") * scale).alias(c) for c in "xyz"))
    cell = [F.floor(F.col(c) / epsilon).alias(f"c{c}") for c in "xyz"]
    at = own.select("*", *cell)
    # Half of the adjoining cells would do for pairs of one group, but the result holds both directions.
    shift = [F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias(f"d{c}") for c in "xyz"]
    wide = at.select("*", shift[0]).select("*", shift[1]).select("*", shift[2])
    wide = wide.select("frame", F.col("atom").alias("a"), *(F.col(c).alias(f"a{c}") for c in "xyz"), *((F.col(f"c{c}") + F.col(f"d{c}")).alias(f"c{c}") for c in "xyz"))
    both = wide.join(at.withColumnRenamed("atom", "b"), ["frame", "cx", "cy", "cz"])
    gap = F.sqrt(sum(((F.col(f"a{c}") - F.col(c)) * (F.col(f"a{c}") - F.col(c)) for c in "xyz"), F.lit(0.0)))
    return both.where(gap < epsilon).select("frame", "a", "b")


def kabsch(x: np.ndarray, y: np.ndarray, m: np.ndarray, fit: bool = True) -> np.ndarray:
    """RMSD of each structure of ``x`` to each of ``y``; all centred, (n, atoms, 3)."""
    mass = m.sum()
    ex, ey = np.einsum("a,nak,nak->n", m, x, x), np.einsum("a,nak,nak->n", m, y, y)
    if not fit:
        out = np.empty((len(x), len(y)))
        for i in range(len(x)):
            g = x[i] - y
            out[i] = np.sqrt(np.einsum("a,nak,nak->n", m, g, g) / mass)
        return out
    out = np.empty((len(x), len(y)))
    for i in range(len(x)):
        h = np.einsum("a,ak,nal->nkl", m, x[i], y)
        u, s, vt = np.linalg.svd(h)
        s[:, 2] *= np.sign(np.linalg.det(u) * np.linalg.det(vt))
        out[i] = np.sqrt(np.maximum(0.0, ex[i] + ey - 2 * s.sum(axis=1)) / mass)
    return out


def centred_blocks(coords: list, m: np.ndarray) -> np.ndarray:
    x = np.array([atoms_of(c) for c in coords])
    return x - np.einsum("a,nak->nk", m, x)[:, None, :] / m.sum()


def rmsd_to(frames: DataFrame, reference: list[list[float]], masses: list[float] | None = None, fit: bool = True, scale: float = 10.0) -> DataFrame:
    """(frame, time, rmsd) to one structure, both centred first.

    Null for a null frame, one of another number of atoms than the reference, and one with an
    atom that is null, not of three coordinates or not finite.
    """
    if atoms_of(reference) is None or not np.isfinite(atoms_of(reference)).all() or not len(reference):
        raise ValueError("the reference needs atoms of three finite coordinates")
    m = np.ones(len(reference)) if masses is None else np.asarray(masses, dtype=np.float64)
    ref = centred_blocks([reference], m)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                rmsd, there = np.full(len(p), np.nan), np.array([c is not None and len(c) == len(m) and bool(np.isfinite(atoms_of(c)).all()) for c in p.coords], dtype=bool)
                if there.any():
                    rmsd[there] = kabsch(centred_blocks(list(p.coords[there]), m), ref, m, fit)[:, 0] * scale
                yield pd.DataFrame({"frame": p.frame, "time": p.time, "rmsd": pd.Series(rmsd, index=p.index).where(there, None)})

    return frames.select("frame", F.col("time").cast("double"), "coords").mapInPandas(run, "frame long, time double, rmsd double")


def smooth_angles(angles: DataFrame, percent: float = 10.0, mode: str = "amplitude") -> DataFrame:
    """(frame, v): each angle as a unit complex number, filtered along time by its Fourier coefficients.

    ``angles`` is (frame, v array<double>), in the order of frame; arrays of unlike lengths
    are series of their own as far as they go. "frequency" keeps of N coefficients the first and
    the last n = N (1 - percent / 100) / 2, halves rounded to even, the constant among the
    first; "amplitude" drops coefficients below ``percent / 100`` of the largest of any angle,
    the constant aside. A null angle or one that is not finite counts as no direction in its
    frame and gets the direction that the others give there. A null array stays null. No
    task holds a series: see ``fourier``.
    """
    if mode not in ("amplitude", "frequency"):
        raise ValueError(f"mode: {mode}")
    rows = kept(rekey(angles.select("frame", "v"), "frame", "n"))
    length = rows.count()
    there = F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < F.lit(float("inf")))
    long = rows.select("n", F.posexplode("v").alias("series", "x")).select("series", "n", *(F.when(there, f("x")).otherwise(0.0).alias(c) for f, c in ((F.cos, "re"), (F.sin, "im"))))
    keep = percent / 100
    low = round(length * (1 - keep) / 2) if mode == "frequency" else None
    out = fourier.filtered(long, length, low, keep) if length else long
    turn = F.atan2("im", "re")
    out = out.select("series", "n", F.when(turn < 0, turn + 2 * np.pi).otherwise(turn).alias("x"))
    out = out.groupBy("n").agg(F.transform(F.array_sort(F.collect_list(F.struct("series", "x"))), lambda s: s["x"]).alias("w"))
    sized = rows.join(out, "n", "left")
    return sized.select("frame", F.when(F.col("v").isNotNull(), F.slice(F.coalesce("w", F.array().cast("array<double>")), 1, F.size("v"))).alias("v"))
