"""Exact predicates against rational arithmetic, above all where rounding decides."""

from fractions import Fraction
from itertools import product

import numpy as np
from pyspark.sql import functions as F

from trussline.operators import exact


def sign(x):
    return (x > 0) - (x < 0)


def det(a, b, c, d):
    u, v, w = ([Fraction(float(x)) - Fraction(float(y)) for x, y in zip(p, d)] for p in (a, b, c))
    return u[0] * (v[1] * w[2] - v[2] * w[1]) - u[1] * (v[0] * w[2] - v[2] * w[0]) + u[2] * (v[0] * w[1] - v[1] * w[0])


def test_orientation_near_a_plane():
    rng = np.random.default_rng(1)
    a, b, c = (rng.uniform(-1, 1, (3000, 3)) for _ in range(3))
    w = rng.dirichlet([1, 1, 1], 3000)
    d = w[:, :1] * a + w[:, 1:2] * b + w[:, 2:] * c  # on the plane, but for rounding
    d[:1000] = np.nextafter(d[:1000], rng.uniform(-2, 2, (1000, 3)))
    scale = 10.0 ** rng.integers(-120, 90, (3000, 1))
    got = exact.orient3d(a * scale, b * scale, c * scale, d * scale)
    assert got.tolist() == [sign(det(*(x[k] * scale[k] for x in (a, b, c, d)))) for k in range(3000)]
    e, f, g, h = (rng.integers(0, 3, (2000, 3)) / 3 for _ in range(4))
    flat = exact.orient3d(e, f, g, h)
    assert flat.tolist() == [sign(det(e[k], f[k], g[k], h[k])) for k in range(2000)] and 0 < (flat == 0).sum() < 2000
    assert exact.orient3d(np.array([[0.0, 0, 0]]), np.array([[1.0, 0, 0]]), np.array([[0.0, 1, 0]]), np.array([[0.0, 0, -1]]))[0] == 1


def meet(s, t):
    """A point of one closed triangle in the other, by linear programming's corners: an edge of one meets the other, or they lie in one plane."""
    s, t = ([[Fraction(float(x)) for x in p] for p in y] for y in (s, t))
    minus = lambda p, q: [x - y for x, y in zip(p, q)]
    cross = lambda p, q: [p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]]
    dot = lambda p, q: sum(x * y for x, y in zip(p, q))

    def holds(tri, p):  # p in the plane of tri
        n = cross(minus(tri[1], tri[0]), minus(tri[2], tri[0]))
        sides = [dot(cross(minus(tri[(k + 1) % 3], tri[k]), minus(p, tri[k])), n) for k in range(3)]
        return min(sides) >= 0

    for x, y in ((s, t), (t, s)):
        n = cross(minus(y[1], y[0]), minus(y[2], y[0]))
        for k in range(3):
            p, q = x[k], x[(k + 1) % 3]
            hp, hq = dot(minus(p, y[0]), n), dot(minus(q, y[0]), n)
            points = []
            if hp == hq == 0:
                points = [p, q]
                for j in range(3):  # where the edge crosses an edge of y in the plane
                    e = minus(y[(j + 1) % 3], y[j])
                    m = cross(e, n)
                    a, b = dot(minus(p, y[j]), m), dot(minus(q, y[j]), m)
                    if a != b and 0 <= a / (a - b) <= 1:
                        points.append([u + (v - u) * (a / (a - b)) for u, v in zip(p, q)])
            elif hp * hq <= 0:
                points = [[u + (v - u) * (hp / (hp - hq)) for u, v in zip(p, q)]]
            if any(holds(y, z) for z in points):
                return True
    return False


def test_triangles_on_a_grid():
    """Corners on a small grid touch in all ways: in corners, edges, planes."""
    rng = np.random.default_rng(2)
    s, t = (rng.integers(0, 4, (6000, 3, 3)).astype(float) for _ in range(2))
    solid = [np.abs(np.cross(x[:, 1] - x[:, 0], x[:, 2] - x[:, 0])).sum(1) > 0 for x in (s, t)]
    s, t = s[solid[0] & solid[1]], t[solid[0] & solid[1]]
    t[::5, :, 2] = s[::5, :, 2] = 1.0  # one plane
    solid = [np.abs(np.cross(x[:, 1] - x[:, 0], x[:, 2] - x[:, 0])).sum(1) > 0 for x in (s, t)]
    s, t = s[solid[0] & solid[1]], t[solid[0] & solid[1]]
    got = exact.triangles_meet(s, t)
    assert got.tolist() == [meet(x, y) for x, y in zip(s, t)] and 500 < got.sum() < len(s) - 500


def test_triangles_that_rounding_parts():
    """A corner on the other's plane, moved by single steps of a double."""
    rng = np.random.default_rng(3)
    t = rng.uniform(-1, 1, (600, 3, 3))
    w = rng.dirichlet([1, 1, 1], 600)
    tip = np.einsum("nk,nkc->nc", w, t)
    tip[:300] = np.nextafter(tip[:300], rng.uniform(-2, 2, (300, 3)))
    n = np.cross(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0])
    s = np.stack([tip, tip + n + rng.normal(size=(600, 3)) / 9, tip + n - rng.normal(size=(600, 3)) / 9], 1)
    got = exact.triangles_meet(s, t)
    assert got.tolist() == [meet(x, y) for x, y in zip(s, t)] and 0 < got.sum() < 600


def test_rays_through_a_fan():
    """Rays at the corners and edges of a closed mesh are told; others cross it an even number of times from outside."""
    corner = np.array(list(product((0.0, 1.0), repeat=3)))
    quads = [(0, 1, 3, 2), (4, 6, 7, 5), (0, 4, 5, 1), (2, 3, 7, 6), (0, 2, 6, 4), (1, 5, 7, 3)]
    tri = np.array([[corner[q[0]], corner[q[i]], corner[q[i + 1]]] for q in quads for i in (1, 2)])
    grid = np.array(list(product(np.linspace(-0.5, 1.5, 9), repeat=2)))
    start, far = (np.column_stack([grid, np.full(81, z)]) for z in (-1.0, 2.0))
    hit, edge = (x.reshape(81, 12) for x in exact.ray_meets(np.repeat(start, 12, 0), np.repeat(far, 12, 0), np.tile(tri, (81, 1, 1))))
    for k, (x, y) in enumerate(grid):
        inside = 0 < x < 1 and 0 < y < 1
        told = edge[k].any()
        assert told == ((0 <= x <= 1 and 0 <= y <= 1) and (x in (0, 1) or y in (0, 1) or x == y))
        assert told or hit[k].sum() == (2 if inside else 0)


def test_depth_and_columns(spark):
    s = [0.0, 0, 0, 4, 0, 0, 0, 4, 0]
    t = [1.0, 1, -0.25, 1, 1, 3, 2, 1, 3]
    far = [9.0, 9, 9, 10, 9, 9, 9, 10, 9]
    s, t, far = ([float(x) for x in v] for v in (s, t, far))
    rows = spark.createDataFrame([(s, t, [1.0, 1.0, 5.0]), (s, far, [0.0, 0.0, 5.0])], "s array<double>, t array<double>, o array<double>")
    below = F.array(F.get("o", F.lit(0)), F.get("o", F.lit(1)), F.lit(-5.0))
    got = rows.select(exact.triangle_test("s", "t").alias("x"), exact.ray_test("o", below, "s").alias("r")).collect()
    assert [(r.x.hit, r.x.depth) for r in got] == [(True, 0.25), (False, 0.0)]
    assert [(r.r.hit, r.r.edge) for r in got] == [(True, False), (True, True)]
    assert exact.ulp(np.array([1.0, -1.0, 0.0])).tolist() == [2**-52, 2**-52, 5e-324]


def test_pairs_that_meet_in_every_position_are_not_tried(monkeypatch):
    from trussline.operators import penetration

    corners = np.array([(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)], float)
    faces = np.array([(0, 2, 1), (0, 3, 2), (4, 5, 6), (4, 6, 7), (0, 1, 5), (0, 5, 4), (1, 2, 6), (1, 6, 5), (2, 3, 7), (2, 7, 6), (3, 0, 4), (3, 4, 7)])
    rng = np.random.default_rng(3)
    pairs = [(corners * size + at, faces, corners, faces) for size, at in zip(rng.uniform(0.2, 1, 60), rng.uniform(-0.9, 0.9, (60, 3)), strict=True)]
    pairs.append((corners * 0.5 + 0.2, faces[1:], corners, faces))  # open
    two = np.concatenate([corners * 0.3 + 0.3, corners * 0.3 + 5])
    pairs.append((two, np.concatenate([faces, faces + 8]), corners, faces))  # of two pieces, of which one is within
    pairs.append((corners * 0.02 + 0.4, faces, corners, faces))  # smaller than the tolerance
    known = penetration.meet_always(pairs, 0.05)
    assert known.sum() > 20 and not known[60:].any()
    with_proof = penetration.depths(pairs, 0.05)
    assert penetration.contacts([(penetration.positions(a, fa, 0.05)[0], fa, b, fb) for (a, fa, b, fb), k in zip(pairs, known, strict=True) if k])[0].all()
    tried = []
    run = penetration.contacts
    monkeypatch.setattr(penetration, "contacts", lambda jobs: tried.append(len(jobs)) or run(jobs))
    assert penetration.depths(pairs, 0.05) == with_proof and tried == [len(pairs) - known.sum()]
    monkeypatch.setattr(penetration, "meet_always", lambda pairs, tolerance: np.zeros(len(pairs), bool))
    assert penetration.depths(pairs, 0.05) == with_proof
