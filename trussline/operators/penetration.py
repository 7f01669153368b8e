"""Hard clashes: how far two meshes must give way to come apart, up to a tolerance.

The smaller mesh may move or shrink, the larger stays.  Its tried positions are where it is, shifts along the axes in
fifths of the tolerance, and shrinking along the vertices' outward directions in twentieths of the tolerance; all of a
pair's positions are tested for contact in one batch.  No contact where it is: depth 0.  Else the least movement that
parts the boxes bounds the depth; if that is not below the tolerance, the widest shift without contact is taken, or the
first shrinking without.

No position moves a vertex by more than the tolerance.  So where both meshes are closed and of one piece, a point that lies in the one mesh deeper
than the tolerance, and in the other, lies in both in every position: all are in contact, and the positions need not be tried.  A point is
proposed for each pair of a batch, and proven against all triangles; pairs without a proven point are tested as said.

For most pairs that is told without their triangles: each mesh is given, once, a box that is proven to lie within it (`solids`), and where that of the
one, less the tolerance, and that of the other share a point, all positions are in contact and the boxes give the depth.  These
pairs are found, told and returned by tiles (see `sweep`), so no pair is shuffled; only the others are, with their meshes.

A depth above the tolerance is possible only where the boxes overlap by more than the tolerance along every axis,
which is a filter on columns before any mesh is read.
"""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import counted, materialize
from . import sweep
from .geometry import inside_mesh, point_triangle, triangle_points
from .spatial import AXES, overlaps

SHIFTS = 5
SHRINK = 0.05
CONTACT = 1e-9
#: Triangle pairs of all positions whose boxes are compared at a time.
LARGEST = 1 << 20


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=-1, keepdims=True)
    return np.divide(v, n, out=np.zeros_like(v), where=n > 0)


def outward(vertices: np.ndarray, faces: np.ndarray) -> np.ndarray:
    """Angle-weighted face normals at each vertex, bent outwards along open borders."""
    normals, borders = np.zeros_like(vertices), np.zeros_like(vertices)
    directed = {(int(a), int(b)) for f in faces for a, b in zip(f, np.roll(f, -1), strict=True)}
    p = vertices[faces]
    side = [_unit(p[:, (k + 1) % 3] - p[:, k]) for k in range(3)]
    n = _unit(np.cross(side[0], -side[2]))
    for k in range(3):
        angle = np.arccos(np.clip(np.einsum("ij,ij->i", side[k], -side[k - 1]), -1, 1))
        np.add.at(normals, faces[:, k], n * angle[:, None])
        open_ = np.array([(int(f[(k + 1) % 3]), int(f[k])) not in directed for f in faces])
        out = _unit(np.cross(side[k], n))[open_]
        np.add.at(borders, faces[open_, k], out)
        np.add.at(borders, faces[open_, (k + 1) % 3], out)
    return _unit(_unit(normals) + borders)


def closed(faces: np.ndarray) -> bool:
    edges = np.sort(np.concatenate([faces[:, [0, 1]], faces[:, [1, 2]], faces[:, [2, 0]]]), 1)
    return bool((np.unique(edges, axis=0, return_counts=True)[1] == 2).all())


def _meet(met: np.ndarray, at: np.ndarray, a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> None:
    """Marks in `met` the positions `at` (in order) some of whose triangle pairs a[i], b[j] meet.

    A few pairs of each position are tested at a time: most positions meet at once and need no more.
    """
    nth, few = np.arange(len(at)) - np.searchsorted(at, np.arange(len(met)))[at], 4
    while len(at):
        now = nth < few
        x, y = a[i[now]], b[j[now]]
        extent = (np.maximum(x.max(1), y.max(1)) - np.minimum(x.min(1), y.min(1))).max(1)
        met[at[now][triangle_points(x, y)[2] <= CONTACT * extent]] = True
        left = ~now & ~met[at]
        at, i, j, nth, few = at[left], i[left], j[left], nth[left], few * 4


def contacts(jobs: list[tuple]) -> list[np.ndarray]:
    """For each job (positions of mesh a's vertices, faces, vertices of mesh b, faces) and each of its positions: do
    triangles meet, or does one closed mesh hold the other whole?"""
    out = [np.zeros(len(moved), bool) for moved, *_ in jobs]
    group, load = [], 0
    for k, (moved, fa, _, fb) in enumerate([*jobs, (np.zeros((LARGEST, 0, 3)), [0], None, [0])]):
        pairs = len(moved) * len(fa) * len(fb)
        if group and load + pairs > LARGEST:
            _surfaces([jobs[g] for g in group], [out[g] for g in group])
            group, load = [], 0
        group.append(k)
        load += pairs
    for met, (moved, fa, vb, fb) in zip(out, jobs, strict=True):
        shut_a, shut_b = closed(fa), closed(fb)
        for k in np.flatnonzero(~met):
            low, high = moved[k].min(0), moved[k].max(0)
            inner = shut_b and (low >= vb.min(0)).all() and (high <= vb.max(0)).all()
            outer = shut_a and (low <= vb.min(0)).all() and (high >= vb.max(0)).all()
            met[k] = inner and inside_mesh(moved[k], vb[fb]).all() or outer and inside_mesh(vb, moved[k][fa]).all()
    return out


def _surfaces(jobs: list[tuple], out: list[np.ndarray]) -> None:
    """Marks the positions whose triangles meet, all jobs in one batch; a job of more than `LARGEST` pairs comes alone, in parts."""
    if len(jobs) == 1:
        moved, fa, vb, fb = jobs[0]
        size = max(1, LARGEST // (len(moved) * len(fb)))
        for start in range(0, len(fa), size):
            _near_surfaces([(moved, fa[start : start + size], vb, fb)], out)
    else:
        _near_surfaces(jobs, out)


def _near_surfaces(jobs: list[tuple], out: list[np.ndarray]) -> None:
    tri_a, tri_b, at, i, j, first = [], [], [], [], [], [0, 0, 0]
    for (moved, fa, vb, fb), met in zip(jobs, out, strict=True):
        a, b = moved[:, fa], vb[fb]
        near = ((a.min(2)[:, :, None] <= b.max(1) + CONTACT) & (b.min(1) - CONTACT <= a.max(2)[:, :, None])).all(3) & ~met[:, None, None]
        m, x, y = np.nonzero(near)
        at.append(m + first[0])
        i.append(m * len(fa) + x + first[1])
        j.append(y + first[2])
        tri_a.append(a.reshape(-1, 3, 3))
        tri_b.append(b)
        first = [first[0] + len(moved), first[1] + len(moved) * len(fa), first[2] + len(fb)]
    met = np.concatenate(out)
    _meet(met, *(np.concatenate(x) for x in (at, tri_a, i, tri_b, j)))
    for own, part in zip(out, np.split(met, np.cumsum([len(m) for m in out])[:-1]), strict=True):
        own[:] = part


def positions(va, fa, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """(positions tried, the depth that each stands for): in place, shifts from the widest, shrinking."""
    by = np.repeat(np.arange(SHIFTS - 1, 0, -1) * tolerance / SHIFTS, 6)
    shifts = by[:, None] * np.tile(np.concatenate([-np.eye(3), np.eye(3)]), (SHIFTS - 1, 1))
    shrunk = np.arange(1, int(1 / SHRINK) + 1)[:, None, None] * outward(va, fa) * tolerance * SHRINK
    tried = np.concatenate([va[None], va + shifts[:, None], va - shrunk])
    return tried, np.concatenate([[0.0], by, np.linalg.norm(shrunk, axis=2).max(1)])


@lru_cache(maxsize=4096)
def _whole(faces: bytes, dtype: str) -> bool:
    """Is the mesh of these faces closed and of one piece?"""
    f = np.frombuffer(faces, dtype).reshape(-1, 3)
    label = np.arange(f.max() + 1 if len(f) else 0)
    while len(f):
        least = label[f].min(1)
        now = label.copy()
        for k in range(3):
            np.minimum.at(now, f[:, k], least)
        if (now == label).all():
            break
        label = now
    return bool(len(f)) and closed(f) and len(np.unique(label[f])) == 1


def _depth_inside(points: np.ndarray, triangles: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """How far points lie from the surface of their own closed mesh: the triangles with `owner` (in order) their number; -1 outside, and where
    the ray that tells grazes an edge or a plane."""
    p, (a, b, c) = points[owner], triangles.swapaxes(0, 1)
    near = point_triangle(p, a, b, c)
    first = np.searchsorted(owner, np.arange(len(points)))
    far = np.sqrt(np.minimum.reduceat(((near - p) ** 2).sum(1), first))
    ab, ac, ray = b - a, c - a, np.array([0.36, 0.48, 0.8]) + np.array([0.01, -0.02, 0.0075])
    n = np.cross(ab, ac)
    nn, den = (n * n).sum(1), n @ ray
    flat = np.abs(den) <= 1e-9 * np.sqrt(nn)
    t = np.divide(((a - p) * n).sum(1), den, out=np.full(len(den), -1.0), where=~flat)
    x = p + ray * t[:, None] - a
    u, v = (np.divide((w * n).sum(1), nn, out=np.zeros_like(nn), where=nn > 0) for w in (np.cross(x, ac), np.cross(ab, x)))
    edge = np.minimum(np.minimum(u, v), 1 - u - v)
    unsure = np.add.reduceat((flat | (np.abs(edge) < 1e-9) & (t > -1e-9)).astype(int), first) > 0
    odd = np.add.reduceat(((edge > 0) & (t > 0)).astype(int), first) % 2 == 1
    return np.where(odd & ~unsure, far, -1.0)


def meet_always(pairs: list[tuple], tolerance: float) -> np.ndarray:
    """Which pairs are seen to be in contact wherever the first mesh moves by up to `tolerance`; others may be."""
    out = np.array([_whole(fa.tobytes(), fa.dtype.str) and _whole(fb.tobytes(), fb.dtype.str) for _, fa, _, fb in pairs], bool)
    tried = np.flatnonzero(out)
    if not len(tried):
        return out
    box = np.array([(va.min(0) + tolerance, va.max(0) - tolerance, vb.min(0), vb.max(0)) for va, _, vb, _ in (pairs[k] for k in tried)])
    points = (np.maximum(box[:, 0], box[:, 2]) + np.minimum(box[:, 1], box[:, 3])) / 2
    deep = []
    for mesh in (0, 2):
        own = [pairs[k][mesh][pairs[k][mesh + 1]] for k in tried]
        deep.append(_depth_inside(points, np.concatenate(own), np.repeat(np.arange(len(own)), [len(t) for t in own])))
    slack = 1e-9 * (tolerance + np.abs(box).max((1, 2)))
    out[tried] = (deep[0] > tolerance + slack) & (deep[1] > slack)
    return out


def depths(pairs: list[tuple], tolerance: float) -> list[float]:
    """Depth of each pair (vertices, faces, vertices, faces), the first mesh giving way."""
    best = [float(np.minimum(va.max(0) - vb.min(0), vb.max(0) - va.min(0)).min()) for va, _, vb, _ in pairs]
    known = meet_always(pairs, tolerance)
    if known.any():
        rest = iter(depths([p for p, k in zip(pairs, known, strict=True) if not k], tolerance)) if not known.all() else iter(())
        return [b if k else next(rest) for b, k in zip(best, known, strict=True)]
    tried = [positions(va, fa, tolerance) if b >= tolerance else (va[None], np.zeros(1)) for b, (va, fa, _, _) in zip(best, pairs, strict=True)]
    met = contacts([(moved, fa, vb, fb) for (moved, _), (_, fa, vb, fb) in zip(tried, pairs, strict=True)])
    return [b if m.all() else max(0.0, min(b, float(d[np.argmin(m)]))) for b, m, (_, d) in zip(best, met, tried, strict=True)]


def hard_clashes(pairs: DataFrame, meshes: DataFrame, tolerance: float) -> DataFrame:
    """(a, b, a_id, b_id, depth, positions): pairs whose depth passes `tolerance`.

    `meshes` is (id, v array<double>, f array<int>); pairs carry a_id, b_id, a_composite, b_composite and both boxes.
    """
    left, right = meshes.toDF("a_id", "av", "af"), meshes.toDF("b_id", "bv", "bf")
    deep = reduce(Column.__and__, (F.least(F.col(f"a_hi{k}") - F.col(f"b_lo{k}"), F.col(f"b_hi{k}") - F.col(f"a_lo{k}")) > tolerance for k in range(3)))
    rows = pairs.where(deep).select("a_composite", "b_composite", "a_id", "b_id").join(left, "a_id").join(right, "b_id")
    return _tested(rows, tolerance)


def _tested(rows: DataFrame, tolerance: float) -> DataFrame:
    """As `hard_clashes`, of pairs (a_composite, b_composite, a_id, b_id) with the meshes av, af, bv, bf."""
    rows = rows.select("a_composite", "b_composite", "a_id", "b_id", "av", "af", "bv", "bf")

    def test(it):
        for pdf in it:
            both = []
            for r in pdf.itertuples(index=False):
                m = [(np.array(v, float).reshape(-1, 3), np.array(f, int).reshape(-1, 3)) for v, f in ((r.av, r.af), (r.bv, r.bf))]
                both.append((m, sorted(m, key=lambda x: np.linalg.norm(np.ptp(x[0], axis=0)))))  # the smaller gives way
            found = depths([(*small, *large) for _, (small, large) in both], tolerance)
            centres = [[((v.min(0) + v.max(0)) / 2).tolist() for v, _ in m] for m, _ in both]
            out = pdf[["a_composite", "b_composite", "a_id", "b_id"]].set_axis(["a", "b", "a_id", "b_id"], axis=1).assign(depth=found, positions=centres)
            yield out[out["depth"] > tolerance]

    kinds = dict(rows.dtypes)
    schema = f"a {kinds['a_composite']}, b {kinds['b_composite']}, a_id {kinds['a_id']}, b_id {kinds['b_id']}, depth double, positions array<array<double>>"
    # pairs differ in cost by orders of magnitude: spread them evenly, whatever their meshes
    return rows.repartition(F.xxhash64("a_id", "b_id")).mapInPandas(test, schema)


def _size(v: np.ndarray) -> float:
    return np.linalg.norm(np.ptp(v, axis=0))


def within(meshes: list[tuple[np.ndarray, np.ndarray]], slack: float) -> np.ndarray:
    """For each mesh (vertices, faces) a box (lo, hi) all points of which lie in it, at least `slack` of the coordinates' size below its surface; lo is above hi
    where none is proven.  Boxes around the middle are tried: no triangle reaches into one, and its middle is inside."""
    out = np.tile([1.0, 1.0, 1.0, -1.0, -1.0, -1.0], (len(meshes), 1))
    tried = [k for k, (v, f) in enumerate(meshes) if np.isfinite(v).all() and _whole(f.tobytes(), f.dtype.str)]
    if not tried:
        return out
    triangles = [meshes[k][0][meshes[k][1]] for k in tried]
    middle = np.array([(v.min(0) + v.max(0)) / 2 for v, _ in (meshes[k] for k in tried)])
    inside = _depth_inside(middle, np.concatenate(triangles), np.repeat(np.arange(len(tried)), [len(t) for t in triangles])) > 0
    for k, c, t in (x for x, ok in zip(zip(tried, middle, triangles, strict=True), inside, strict=True) if ok):
        v = meshes[k][0]
        ends, small = np.array([v.min(0), v.max(0)]), slack * (1 + np.abs(v).max())
        n = _unit(np.cross(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0]))
        off, low, high = np.abs(((t[:, 0] - c) * n).sum(1)), t.min(1), t.max(1)
        for share in (1.0, 0.9, 0.75, 0.5, 0.25, 0.1):
            box = ends if share == 1 else c + (ends - c) * share
            apart = ((high <= box[0]) | (low >= box[1])).any(1) | (n.any(1) & (off > np.abs(n) @ ((box[1] - box[0]) / 2) + small))
            if apart.all():
                out[k] = [*(box[0] + small), *(box[1] - small)]
                break
    return out


def solids(meshes: DataFrame, slack: float = 1e-9) -> DataFrame:
    """`meshes` with v and f replaced by size, which tells the smaller mesh, the middle of its box (mid0 to 2), and the box `within` (in0 to 5)."""
    rest = [c for c in meshes.columns if c not in ("v", "f")]
    kinds = dict(meshes.dtypes)

    def told(it):
        for pdf in it:
            shapes = [(np.array(v, float).reshape(-1, 3), np.array(f, int).reshape(-1, 3)) for v, f in zip(pdf["v"], pdf["f"], strict=True)]
            middle = np.array([(v.min(0) + v.max(0)) / 2 for v, _ in shapes]).reshape(-1, 3)
            box = within(shapes, slack)
            yield pdf[rest].assign(size=[_size(v) for v, _ in shapes], **{f"mid{k}": middle[:, k] for k in AXES}, **{f"in{k}": box[:, k] for k in range(6)})

    numbers = ["size", *(f"mid{k}" for k in AXES), *(f"in{k}" for k in range(6))]
    return meshes.mapInPandas(told, ", ".join([*(f"{c} {kinds[c]}" for c in rest), *(f"{c} double" for c in numbers)]))


def clashing(boxes: DataFrame, tolerance: float, places: int = 9, cell: float | None = None) -> DataFrame:
    """`hard_clashes` of all pairs of `boxes` (id, composite, part A or B, corners, and each box's mesh v, f) of both parts and of different composites; depth and
    positions are to `places`."""
    stored, _ = counted(boxes.withColumn("_key", F.monotonically_increasing_id()))
    told = solids(stored).withColumns({f"mid{k}": F.round(f"mid{k}", places) for k in AXES})
    told = materialize(told)
    inner = [f"in{k}" for k in range(6)]

    def widths(x, y, x_by, y_by, least, greatest):
        return [least(x(f"in{k + 3}") - x_by, y(f"in{k + 3}") - y_by) - greatest(x(f"in{k}") + x_by, y(f"in{k}") + y_by) for k in AXES]

    def sure(x, y):
        """The smaller mesh moves, the pair's a of two as large."""
        moves = (x["size"] < y["size"]) | (x["size"] == y["size"]) & x["_first"]
        common = widths(x.get, y.get, np.where(moves, tolerance, 0.0), np.where(moves, 0.0, tolerance), np.minimum, np.maximum)
        return (common[0] > 0) & (common[1] > 0) & (common[2] > 0)

    def deep(m):
        return (m[0] > tolerance) & (m[1] > tolerance) & (m[2] > tolerance)

    a, b = (lambda c, s=s: F.col(f"{s}_{c}") for s in "ab")
    moves = a("size") <= b("size")
    common = widths(a, b, F.when(moves, tolerance).otherwise(0.0), F.when(moves, 0.0).otherwise(tolerance), F.least, F.greatest)
    is_sure = reduce(Column.__and__, (w > 0 for w in common))
    overlap = [F.least(a(f"hi{k}") - b(f"lo{k}"), b(f"hi{k}") - a(f"lo{k}")) for k in AXES]
    is_deep = reduce(Column.__and__, (w > tolerance for w in overlap), overlaps())
    depth = ("double", F.round(F.least(*overlap), places), lambda m, x, y: sweep.rounded(np.minimum(np.minimum(m[0], m[1]), m[2]), places))
    reads = ("size", *inner)
    left = sweep.Kind(is_deep & ~is_sure, 0.0, lambda m, x, y: deep(m) & ~sure(x, y), {}, reads)
    rest, n = counted(sweep.close_pairs(told, left, ["id", "composite", "_key"], cell))
    kind = sweep.Kind(is_deep & is_sure, 0.0, lambda m, x, y: deep(m) & sure(x, y), {"depth": depth}, reads)
    found = sweep.close_pairs(told, kind, ["id", "composite", "mid0", "mid1", "mid2"], cell)
    spot = F.array(*(F.array(*(F.col(f"{s}_mid{k}") for k in AXES)) for s in "ab"))
    found = found.select(F.col("a_composite").alias("a"), F.col("b_composite").alias("b"), "a_id", "b_id", "depth", spot.alias("positions"))
    if not n:
        return found
    mesh = stored.select("_key", "v", "f")
    tested = _tested(rest.join(mesh.toDF("a__key", "av", "af"), "a__key").join(mesh.toDF("b__key", "bv", "bf"), "b__key"), tolerance)
    near = F.transform("positions", lambda p: F.transform(p, lambda x: F.round(x, places)))
    return found.union(tested.withColumns({"depth": F.round("depth", places), "positions": near}))
