"""Exact signs for triangles and rays: numpy first, rational numbers where rounding could decide.

Coordinates are doubles and count as the numbers they are.  A sign is taken from the rounded determinant where that is larger than its error
can be; the few left are evaluated without rounding.  So near-degenerate input gets the answer of real arithmetic:
closed triangles that touch, in a point too, intersect, and rays know when they meet an edge.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Error of a rounded orientation, as a share of the sum of its terms' sizes, a little above what its operations can add up to.
ERROR_3D, ERROR_2D = 16 * np.finfo(float).eps, 8 * np.finfo(float).eps


def ulp(x: np.ndarray) -> np.ndarray:
    """The step from x to the next double away from zero (0: above it)."""
    return np.abs(np.spacing(x))


def _exact3(a, b, c, d) -> int:
    p = [[Fraction(float(x)) - Fraction(float(y)) for x, y in zip(v, d)] for v in (a, b, c)]
    (ax, ay, az), (bx, by, bz), (cx, cy, cz) = p
    det = ax * (by * cz - bz * cy) - ay * (bx * cz - bz * cx) + az * (bx * cy - by * cx)
    return (det > 0) - (det < 0)


def _exact2(a, b, c) -> int:
    ax, ay, bx, by, cx, cy = (Fraction(float(x)) for v in (a, b, c) for x in v)
    det = (ax - cx) * (by - cy) - (ay - cy) * (bx - cx)
    return (det > 0) - (det < 0)


def orient3d(a, b, c, d) -> np.ndarray:
    """For points (n, 3): 1 where d lies below the plane of a, b, c that are seen counter-clockwise from above, -1 above, 0 on it."""
    u, v, w = a - d, b - d, c - d
    with np.errstate(over="ignore", invalid="ignore"):
        pairs = [(1, 2, 0), (2, 0, 1), (0, 1, 2)]
        det = sum((v[:, i] * w[:, j] - v[:, j] * w[:, i]) * u[:, k] for i, j, k in pairs)
        size = sum((np.abs(v[:, i] * w[:, j]) + np.abs(v[:, j] * w[:, i])) * np.abs(u[:, k]) for i, j, k in pairs)
        out = np.sign(det)
        # products of tiny numbers lose bits that the share of sizes does not see
        unsure = ~(np.abs(det) > ERROR_3D * size + 1e-290)
    for k in np.flatnonzero(unsure):
        out[k] = _exact3(a[k], b[k], c[k], d[k])
    return out.astype(np.int8)


def orient2d(a, b, c) -> np.ndarray:
    """For points (n, 2): 1 where a, b, c turn counter-clockwise, -1 clockwise, 0 on a line."""
    left, right = (a[:, 0] - c[:, 0]) * (b[:, 1] - c[:, 1]), (a[:, 1] - c[:, 1]) * (b[:, 0] - c[:, 0])
    out = np.sign(left - right)
    for k in np.flatnonzero(~(np.abs(left - right) > ERROR_2D * (np.abs(left) + np.abs(right)) + 1e-290)):
        out[k] = _exact2(a[k], b[k], c[k])
    return out.astype(np.int8)


def _between(a, b, p) -> np.ndarray:
    """Whether p, on the line of a and b, lies in the box of the two (n, 2)."""
    return ((p >= np.minimum(a, b)) & (p <= np.maximum(a, b))).all(1)


def _segments_meet(a, b, c, d) -> np.ndarray:
    """Closed segments ab and cd of a plane share a point."""
    o = [orient2d(*x) for x in ((a, b, c), (a, b, d), (c, d, a), (c, d, b))]
    cross = (o[0] * o[1] < 0) & (o[2] * o[3] < 0)
    on = [(o[0] == 0) & _between(a, b, c), (o[1] == 0) & _between(a, b, d), (o[2] == 0) & _between(c, d, a), (o[3] == 0) & _between(c, d, b)]
    return cross | on[0] | on[1] | on[2] | on[3]


def _inside(p, t) -> np.ndarray:
    """Points (n, 2) in closed triangles (n, 3, 2) that are not flat."""
    o = np.stack([orient2d(t[:, k], t[:, (k + 1) % 3], p) for k in range(3)], 1)
    return (o >= 0).all(1) | (o <= 0).all(1)


def _flat(s, t) -> np.ndarray:
    """Coplanar triangles share a point, looked at along each axis: their shadows do on all three exactly if they do."""
    out = np.ones(len(s), bool)
    for k in range(3):
        keep = [x for x in range(3) if x != k]
        p, q = s[:, :, keep], t[:, :, keep]
        met = np.zeros(len(s), bool)
        for i in range(3):
            for j in range(3):
                met |= _segments_meet(p[:, i], p[:, (i + 1) % 3], q[:, j], q[:, (j + 1) % 3])
        solid = [orient2d(x[:, 0], x[:, 1], x[:, 2]) != 0 for x in (p, q)]
        met |= solid[1] & _inside(p[:, 0], q)
        met |= solid[0] & _inside(q[:, 0], p)
        out &= met
    return out


def segment_meets(p, q, t) -> np.ndarray:
    """Closed segments (n, 3) that do not lie in the plane of their triangle (n, 3, 3) meet the closed triangle."""
    a, b, c = t[:, 0], t[:, 1], t[:, 2]
    low, high = orient3d(a, b, c, p), orient3d(a, b, c, q)
    around = np.stack([orient3d(p, q, x, y) for x, y in ((a, b), (b, c), (c, a))], 1)
    return (low * high <= 0) & ((low != 0) | (high != 0)) & ((around >= 0).all(1) | (around <= 0).all(1))


def triangles_meet(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Whether closed triangles s and t (n, 3, 3), none of them flat, share a point."""
    plane = [np.stack([orient3d(y[:, 0], y[:, 1], y[:, 2], x[:, k]) for k in range(3)], 1) for x, y in ((s, t), (t, s))]
    out = np.zeros(len(s), bool)
    together = (plane[0] == 0).all(1)
    apart = [(np.abs(p.sum(1)) == 3) for p in plane]
    rest = np.flatnonzero(~together & ~apart[0] & ~apart[1])
    for x, y in ((s[rest], t[rest]), (t[rest], s[rest])):
        for k in range(3):
            out[rest] |= segment_meets(x[:, k], x[:, (k + 1) % 3], y)
    both = np.flatnonzero(together)
    out[both] = _flat(s[both], t[both])
    return out


def ray_meets(origin: np.ndarray, far: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hit, edge) of segments from `origin` to `far` (n, 3) and triangles: whether they meet, and whether at an edge, in a corner or along the plane.

    Of two triangles that share an edge a ray which meets it is told so by both, so no ray slips through between them.
    """
    a, b, c = t[:, 0], t[:, 1], t[:, 2]
    ends = np.stack([orient3d(a, b, c, origin), orient3d(a, b, c, far)], 1)
    along = (ends == 0).all(1)
    flat = np.flatnonzero(along)
    along[flat] = _flat(np.stack([origin[flat], far[flat], far[flat]], 1), t[flat])
    around = np.stack([orient3d(origin, far, x, y) for x, y in ((a, b), (b, c), (c, a))], 1)
    hit = segment_meets(origin, far, t)
    return hit, along | (hit & ((around == 0).any(1) | (ends == 0).any(1)))


def depth(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """How far triangles that meet have to move to come apart, the least over the normals of both and the products of their edges."""
    edges = [[x[:, (k + 1) % 3] - x[:, k] for k in range(3)] for x in (s, t)]
    axes = [np.cross(e[0], e[1]) for e in edges] + [np.cross(u, v) for u in edges[0] for v in edges[1]]
    best = np.full(len(s), np.inf)
    for axis in axes:
        length = np.linalg.norm(axis, axis=1)
        unit = np.divide(axis, length[:, None], out=np.zeros_like(axis), where=length[:, None] > 0)
        p, q = np.einsum("nkc,nc->nk", s, unit), np.einsum("nkc,nc->nk", t, unit)
        move = np.minimum(p.max(1) - q.min(1), q.max(1) - p.min(1))
        best = np.where(length > 0, np.minimum(best, move), best)
    return np.maximum(best, 0.0)


@F.pandas_udf(T.StructType([T.StructField("hit", T.BooleanType()), T.StructField("depth", T.DoubleType())]))
def triangle_test(s: pd.Series, t: pd.Series) -> pd.DataFrame:
    """Columns of nine doubles: whether the triangles meet, and how far they have to move (0 where they do not meet)."""
    x, y = (np.array(v.tolist(), float).reshape(-1, 3, 3) for v in (s, t))
    hit = triangles_meet(x, y)
    return pd.DataFrame({"hit": hit, "depth": np.where(hit, depth(x, y), 0.0)})


@F.pandas_udf(T.StructType([T.StructField("hit", T.BooleanType()), T.StructField("edge", T.BooleanType())]))
def ray_test(origin: pd.Series, far: pd.Series, t: pd.Series) -> pd.DataFrame:
    """Columns of three, three and nine doubles: `ray_meets`."""
    o, e = (np.array(v.tolist(), float).reshape(-1, 3) for v in (origin, far))
    hit, edge = ray_meets(o, e, np.array(t.tolist(), float).reshape(-1, 3, 3))
    return pd.DataFrame({"hit": hit, "edge": edge})
