"""Vectors (struct x, y, z), 4x4 row-major matrices (array of 16 doubles) and boxes, as columns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

IDENTITY = [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]


def matrix(values) -> Column:
    return F.array(*(v if isinstance(v, Column) else F.lit(float(v)) for v in values))


def translation(x, y, z) -> Column:
    return matrix([1, 0, 0, x, 0, 1, 0, y, 0, 0, 1, z, 0, 0, 0, 1])


def scaling(x, y, z) -> Column:
    return matrix([x, 0, 0, 0, 0, y, 0, 0, 0, 0, z, 0, 0, 0, 0, 1])


def rotation_z(angle: float) -> Column:
    c, s = math.cos(angle), math.sin(angle)
    return matrix([c, -s, 0, 0, s, c, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1])


def multiply(a: Column, b: Column) -> Column:
    return F.array(*(sum((F.get(a, F.lit(4 * r + k)) * F.get(b, F.lit(4 * k + c)) for k in range(1, 4)), F.get(a, F.lit(4 * r)) * F.get(b, F.lit(c))) for r in range(4) for c in range(4)))


def transpose(m: Column) -> Column:
    return F.array(*(F.get(m, F.lit(4 * c + r)) for r in range(4) for c in range(4)))


def is_identity(m: Column, eps: float = 1e-5) -> Column:
    return F.forall(F.zip_with(m, matrix(IDENTITY), lambda a, b: F.abs(a - b) <= eps), lambda x: x)


def determinant(m: Column) -> Column:
    g = lambda r, c: F.get(m, F.lit(4 * r + c))
    two = lambda r, c: g(r, c[0]) * g(r + 1, c[1]) - g(r, c[1]) * g(r + 1, c[0])
    pairs = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
    signs = [1, -1, 1, 1, -1, 1]
    return sum((s * two(0, p) * two(2, q) for s, p, q in zip(signs[1:], pairs[1:], pairs[::-1][1:], strict=True)), two(0, pairs[0]) * two(2, pairs[-1]))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def inverse(m: pd.Series) -> pd.Series:
    """Inverse of each matrix; of a singular one, null."""
    out = []
    for x in m:
        a = None if x is None else np.asarray(x, float).reshape(4, 4)
        out.append(None if a is None or np.linalg.det(a) == 0 else np.linalg.inv(a).ravel().tolist())
    return pd.Series(out)


def vector(x, y, z) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def transform_point(m: Column, p: Column) -> Column:
    g = lambda i: F.get(m, F.lit(i))
    at = lambda r: g(4 * r) * p["x"] + g(4 * r + 1) * p["y"] + g(4 * r + 2) * p["z"] + g(4 * r + 3)
    return vector(at(0), at(1), at(2))


def transform_direction(m: Column, p: Column) -> Column:
    g = lambda i: F.get(m, F.lit(i))
    at = lambda r: g(4 * r) * p["x"] + g(4 * r + 1) * p["y"] + g(4 * r + 2) * p["z"]
    return vector(at(0), at(1), at(2))


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def cross(a: Column, b: Column) -> Column:
    return vector(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column) -> Column:
    n = norm(a)
    part = lambda c: F.when(n == 0, c).otherwise(c / n)
    return vector(part(a["x"]), part(a["y"]), part(a["z"]))


def box_transformed(m: Column, lo: list[Column], hi: list[Column]) -> tuple[list[Column], list[Column]]:
    """Bounds of the eight transformed corners."""
    g = lambda i: F.get(m, F.lit(i))
    low, high = [], []
    for r in range(3):
        ends = [(g(4 * r + k) * lo[k], g(4 * r + k) * hi[k]) for k in range(3)]
        low.append(sum((F.least(a, b) for a, b in ends), g(4 * r + 3)))
        high.append(sum((F.greatest(a, b) for a, b in ends), g(4 * r + 3)))
    return low, high


def box_size(lo: list[Column], hi: list[Column]) -> list[Column]:
    return [b - a for a, b in zip(lo, hi, strict=True)]


def box_volume(lo: list[Column], hi: list[Column]) -> Column:
    x, y, z = box_size(lo, hi)
    return x * y * z


def box_contains(lo: list[Column], hi: list[Column], p: list[Column]) -> Column:
    inside = F.lit(True)
    for a, b, c in zip(lo, hi, p, strict=True):
        inside = inside & (c >= a) & (c <= b)
    return inside


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def transform_normals(m: pd.Series, normals: pd.Series) -> pd.Series:
    """Normals (flattened triples) by the inverse transpose of each matrix, made unit length again."""
    out = []
    for a, n in zip(m, normals, strict=True):
        if a is None or n is None:
            out.append(None)
            continue
        turned = np.asarray(n, float).reshape(-1, 3) @ np.linalg.inv(np.asarray(a, float).reshape(4, 4)[:3, :3])
        size = np.linalg.norm(turned, axis=1, keepdims=True)
        out.append(np.divide(turned, size, out=turned, where=size > 0).ravel().tolist())
    return pd.Series(out)
