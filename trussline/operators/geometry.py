"""Triangle kernels on numpy batches, as Arrow-batched column functions.

Triangles are arrays of nine doubles.  All kernels work on whole batches; degenerate edges and
triangles are points or segments to them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _dot(a, b):
    return np.einsum("...k,...k->...", a, b)


def _ratio(a, b):
    return np.divide(a, b, out=np.zeros_like(a), where=b > 0)


def segment_points(p0, p1, q0, q1):
    """Closest points of segments p and q, both (n, 3)."""
    d1, d2, r = p1 - p0, q1 - q0, p0 - q0
    a, e, f = _dot(d1, d1), _dot(d2, d2), _dot(d2, r)
    b, c = _dot(d1, d2), _dot(d1, r)
    den = a * e - b * b
    s = np.clip(np.where(den > 1e-14 * a * e, _ratio(b * f - c * e, den), 0.0), 0, 1)
    t = _ratio(b * s + f, e)
    clipped = np.clip(t, 0, 1)
    s = np.where((t != clipped) | (e <= 0), np.clip(_ratio(b * clipped - c, a), 0, 1), s)
    return p0 + d1 * s[:, None], q0 + d2 * clipped[:, None]


def point_triangle(p, a, b, c):
    """Closest point to p on each triangle: the projection if inside, else the best edge point."""
    ab, ac = b - a, c - a
    n = np.cross(ab, ac)
    nn = _dot(n, n)
    off = _ratio(_dot(p - a, n), nn)
    q = p - n * off[:, None]
    u = _ratio(_dot(np.cross(q - a, ac), n), nn)
    v = _ratio(_dot(np.cross(ab, q - a), n), nn)
    inside = (nn > 0) & (u >= 0) & (v >= 0) & (u + v <= 1)
    best, dist = q, np.where(inside, 0.0, np.inf)
    for s, e in ((a, b), (b, c), (c, a)):
        d = e - s
        on = s + d * np.clip(_ratio(_dot(p - s, d), _dot(d, d)), 0, 1)[:, None]
        far = _dot(p - on, p - on)
        closer = far < dist
        best, dist = np.where(closer[:, None], on, best), np.where(closer, far, dist)
    return best


def segment_hits_triangle(p, q, a, b, c):
    """Does the segment cross the triangle's inside or border (not where it is parallel)?"""
    d = q - p
    n = np.cross(b - a, c - a)
    den = _dot(d, n)
    t = np.divide(_dot(a - p, n), den, out=np.full(len(p), np.inf), where=np.abs(den) > 1e-300)
    ok = (t >= 0) & (t <= 1)
    x = p + d * np.where(ok, t, 0)[:, None]
    nn = _dot(n, n)
    u, v = _ratio(_dot(np.cross(x - a, c - a), n), nn), _ratio(_dot(np.cross(b - a, x - a), n), nn)
    return ok & (u >= 0) & (v >= 0) & (u + v <= 1), x


def triangle_points(s: np.ndarray, t: np.ndarray):
    """Closest points (n, 3) of triangles s and t (n, 3, 3); the same point where they intersect."""
    best_a, best_b = s[:, 0].copy(), t[:, 0].copy()
    dist = np.full(len(s), np.inf)

    def take(pa, pb):
        nonlocal best_a, best_b, dist
        far = _dot(pa - pb, pa - pb)
        closer = far < dist
        best_a, best_b = np.where(closer[:, None], pa, best_a), np.where(closer[:, None], pb, best_b)
        dist = np.where(closer, far, dist)

    for i in range(3):
        for j in range(3):
            take(*segment_points(s[:, i], s[:, (i + 1) % 3], t[:, j], t[:, (j + 1) % 3]))
        take(s[:, i], point_triangle(s[:, i], t[:, 0], t[:, 1], t[:, 2]))
        take(point_triangle(t[:, i], s[:, 0], s[:, 1], s[:, 2]), t[:, i])
        for one, two in ((s, t), (t, s)):
            hit, x = segment_hits_triangle(one[:, i], one[:, (i + 1) % 3], two[:, 0], two[:, 1], two[:, 2])
            best_a, best_b = np.where(hit[:, None], x, best_a), np.where(hit[:, None], x, best_b)
            dist = np.where(hit, 0.0, dist)
    return best_a, best_b, np.sqrt(dist)


def _batch(s: pd.Series) -> np.ndarray:
    return np.array(s.tolist(), float).reshape(-1, 3, 3)


@F.pandas_udf(T.StructType([T.StructField("distance", T.DoubleType()), T.StructField("a", T.ArrayType(T.DoubleType())), T.StructField("b", T.ArrayType(T.DoubleType()))]))
def closest_points(s: pd.Series, t: pd.Series) -> pd.DataFrame:
    a, b, d = triangle_points(_batch(s), _batch(t))
    return pd.DataFrame({"distance": d, "a": list(a), "b": list(b)})


@F.pandas_udf(T.BooleanType())
def intersects(s: pd.Series, t: pd.Series) -> pd.Series:
    x, y = _batch(s), _batch(t)
    size = np.maximum(np.abs(x).max((1, 2)), np.abs(y).max((1, 2)))
    return pd.Series(triangle_points(x, y)[2] <= 1e-12 * np.maximum(size, 1))


def inside_mesh(points: np.ndarray, triangles: np.ndarray, seed: int = 7, tries: int = 10) -> np.ndarray:
    """Ray parity of each point in a closed mesh, all points at once; rays that graze an edge are thrown anew."""
    rng = np.random.default_rng(seed)
    a, ab, ac = triangles[:, 0], triangles[:, 1] - triangles[:, 0], triangles[:, 2] - triangles[:, 0]
    n = np.cross(ab, ac)
    nn = _dot(n, n)
    out = np.zeros(len(points), bool)
    open_ = np.flatnonzero(((points >= triangles.min((0, 1))) & (points <= triangles.max((0, 1)))).all(1))
    for _ in range(tries):
        if not len(open_):
            return out
        d = rng.normal(size=(len(open_), 3))
        den = d @ n.T
        t = np.divide(_dot(a, n) - points[open_] @ n.T, den, out=np.full(den.shape, -1.0), where=np.abs(den) > 1e-12)
        x = points[open_, None] + d[:, None] * t[..., None] - a
        u, v = (np.divide(w, nn, out=np.zeros_like(w), where=nn > 0) for w in (_dot(np.cross(x, ac), n), _dot(np.cross(ab, x), n)))
        edge = np.minimum(np.minimum(u, v), 1 - u - v)
        grazed = ((np.abs(edge) < 1e-9) & (t > 0)).any(1)
        out[open_] = ((edge > 0) & (t > 0)).sum(1) % 2 == 1
        open_ = open_[grazed]
    if len(open_):
        raise ValueError("every ray grazes an edge")
    return out


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def mesh_contains(points: pd.Series, triangles: pd.Series) -> pd.Series:
    """points: array of x, y, z triples flattened; triangles: flattened nines."""
    return pd.Series([inside_mesh(np.array(p, float).reshape(-1, 3), np.array(t, float).reshape(-1, 3, 3)).tolist() for p, t in zip(points, triangles, strict=True)])


def edge_uses(faces):
    """faces (mesh, face_no, v array<int>) to undirected edges with their number of uses.

    Edges are dealt before they are counted: most occur twice, so a count before would hold nearly all edges of a task's input and spare little."""
    corner = lambda i: F.get("v", F.lit(i))
    sides = F.array(*(F.struct(F.least(corner(i), corner((i + 1) % 3)).alias("lo"), F.greatest(corner(i), corner((i + 1) % 3)).alias("hi")) for i in range(3)))
    edges = faces.select("mesh", F.explode(sides).alias("e")).select("mesh", "e.lo", "e.hi")
    return edges.repartition("mesh", "lo").groupBy("mesh", "lo", "hi").agg(F.count("*").alias("uses"))


def closed_and_manifold(faces):
    """(mesh, closed): every undirected edge is used exactly twice."""
    return edge_uses(faces).groupBy("mesh").agg(F.every(F.col("uses") == 2).alias("closed"))


def distinct_vertices(vertices, keys):
    """(mesh, pos, new_pos): vertices equal in `keys` share the index of the first, counted densely."""
    from pyspark.sql import Window

    firsts = vertices.groupBy("mesh", *keys).agg(F.min("pos").alias("_first"))
    dense = firsts.withColumn("new_pos", F.row_number().over(Window.partitionBy("mesh").orderBy("_first")) - 1)
    return vertices.join(dense, ["mesh", *keys]).select("mesh", "pos", "new_pos")
