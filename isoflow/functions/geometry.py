"""Scalar geometry on arrays of doubles. Degenerate angles are null, never an error."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, SparkSession, functions as F

#: Root of the machine epsilon: residuals above it mark an eigenpair as not converged.
ROOT_EPS = float(np.sqrt(np.finfo(np.float64).eps))


def let(x: Column, f) -> Column:
    """``f`` of the value of ``x``, computed once however often ``f`` uses it."""
    return F.transform(F.array(x), f)[0]


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def cross(a: Column, b: Column) -> Column:
    """Cross product of two vectors of three components."""
    return F.array(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def arc(cosine: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


def theta(p1: Column, p2: Column, p3: Column, degrees: bool = False) -> Column:
    """Supplement of the angle at p2, 0 for a straight chain; null if two points coincide (G1)."""

    def angle(l: Column, r: Column) -> Column:
        size = norm(l) * norm(r)
        x = F.when(size > 0, arc(-dot(l, r) / size))
        return F.degrees(x) if degrees else x

    return let(minus(p1, p2), lambda l: let(minus(p3, p2), lambda r: angle(l, r)))


def torsion(p1: Column, p2: Column, p3: Column, p4: Column, degrees: bool = False) -> Column:
    """Signed dihedral angle of four points; null if three of them are collinear."""

    def angle(n1: Column, n2: Column, b2: Column) -> Column:
        size = norm(n1) * norm(n2)
        x = F.when(size > 0, arc(dot(n1, n2) / size) * F.when(dot(cross(n1, n2), b2) < 0, -1.0).otherwise(1.0))
        return F.degrees(x) if degrees else x

    def of(b1: Column, b2: Column, b3: Column) -> Column:
        return let(cross(b1, b2), lambda n1: let(cross(b2, b3), lambda n2: angle(n1, n2, b2)))

    return let(minus(p2, p1), lambda b1: let(minus(p3, p2), lambda b2: let(minus(p4, p3), lambda b3: of(b1, b2, b3))))


def euclidean(a: Column, b: Column) -> Column:
    """Euclidean distance of two dense vectors."""
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def correlation_distance(a: Column, b: Column) -> Column:
    """sqrt((1 - r) / 2) with the sample correlation r; null for a constant vector."""

    def centred(x: Column) -> Column:
        return let(total(x) / F.size(x), lambda m: F.transform(x, lambda y: y - m))

    def of(u: Column, v: Column) -> Column:
        size = norm(u) * norm(v)
        return F.when(size > 0, F.sqrt(F.greatest(F.lit(0.0), (1 - dot(u, v) / size) / 2)))

    return let(centred(a), lambda u: let(centred(b), lambda v: of(u, v)))


def sparse_euclidean(a: Column, b: Column) -> Column:
    """Euclidean distance of two map<int,double> vectors; absent features are 0."""
    gap = F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0)))
    return norm(F.map_values(gap))


def sincos(angles: Column) -> Column:
    """Each angle as its sine and cosine, interleaved."""
    return F.flatten(F.transform(angles, lambda a: F.array(F.sin(a), F.cos(a))))


def gaussian(dist: Column, scale2: Column) -> Column:
    """exp(-d^2 / (2 scale2)); null for a scale of 0."""
    return F.when(scale2 > 0, F.exp(-dist * dist / (2 * scale2)))


def places(coords: Column, width: int) -> Column:
    """First places of the stretches of ``width`` atoms; none in a shorter chain."""
    return F.when(F.size(coords) >= width, F.sequence(F.lit(0), F.size(coords) - width)).otherwise(F.array().cast("array<int>"))


def backbone_torsions(coords: Column) -> Column:
    """psi1, phi2, psi2, .. of a backbone of N, CA, C triples."""
    at = F.filter(places(coords, 4), lambda x: x % 3 != 1)
    return F.transform(at, lambda x: torsion(coords[x], coords[x + 1], coords[x + 2], coords[x + 3]))


def alpha_angles(coords: Column) -> Column:
    """The thetas, then the torsions, of a chain of CA atoms."""
    thetas = F.transform(places(coords, 3), lambda x: theta(coords[x], coords[x + 1], coords[x + 2]))
    return F.concat(thetas, F.transform(places(coords, 4), lambda x: torsion(coords[x], coords[x + 1], coords[x + 2], coords[x + 3])))


def register_sql(spark: SparkSession) -> None:
    """Makes the scalar functions available in SQL as temporary functions."""
    vec = "ARRAY<DOUBLE>"
    total_sql = "aggregate({}, 0D, (s, x) -> s + x)"
    bodies = {
        "vec_dot": (f"a {vec}, b {vec}", "DOUBLE", total_sql.format("zip_with(a, b, (x, y) -> x * y)")),
        "vec_euclidean": (f"a {vec}, b {vec}", "DOUBLE", f"sqrt({total_sql.format('zip_with(a, b, (x, y) -> (x - y) * (x - y))')})"),
        "vec_cross": (f"a {vec}, b {vec}", vec, "array(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])"),
        "vec_sincos": (f"a {vec}", vec, "flatten(transform(a, x -> array(sin(x), cos(x))))"),
        "gaussian_affinity": ("d DOUBLE, sigma DOUBLE", "DOUBLE", "exp(try_divide(-d * d, 2 * sigma * sigma))"),
    }
    for name, (args, out, body) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {out} RETURN {body}")
