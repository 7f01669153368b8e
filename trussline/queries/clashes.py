"""Clash detection over boxes from the embeddings, triangle kernels over derived triangles."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..operators import clash, exact, geometry, penetration, spatial, sweep
from .scene import BOXES_SQL, boxes, table

QUERIES, ORACLE_SQL = {}, {}
TOLERANCE = 0.02
CELL = 0.25


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_GAPS = ", ".join(f"greatest(a.lo{k} - b.hi{k}, b.lo{k} - a.hi{k}, 0.0) AS g{k}" for k in range(3))
_OVERLAP = " AND ".join(f"a.lo{k} <= b.hi{k} AND b.lo{k} <= a.hi{k}" for k in range(3))
#: Sets: A holds labels 0 to 5, B labels 4 to 9, so labels 4 and 5 are in both.
_PARTS = f"{BOXES_SQL}, parts AS (SELECT *, CASE WHEN CAST(substr(composite, 2) AS INTEGER) < 4 THEN 'A' WHEN CAST(substr(composite, 2) AS INTEGER) > 5 THEN 'B' ELSE 'C' END AS part FROM boxes)"
_PAIRS = f"{_PARTS}, pairs AS (SELECT a.id AS a_id, b.id AS b_id, a.composite AS ac, b.composite AS bc, {_GAPS} FROM parts a JOIN parts b ON a.composite <> b.composite AND (a.part < b.part OR (a.part = 'C' AND b.part = 'C' AND a.id < b.id)))"


def _parts(spark, sf):
    b = boxes(spark, sf)
    n = F.substring("composite", 2, 5).cast("int")
    return clash.disjoint_sets(b.where(n <= 5), b.where(n >= 4))


@query(f"WITH {_PARTS} SELECT id, part FROM parts")
def disjoint_sets(spark, sf):
    return _parts(spark, sf).select("id", "part")


@query("SELECT 'A' AS set_name, o_custkey AS mesh, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY 2 HAVING count(DISTINCT o_orderpriority) > 1")
def duplicate_mesh_ids(spark, sf):
    return clash.duplicate_meshes(table(spark, sf, "orders").select(F.lit("A").alias("set_name"), F.col("o_custkey").alias("mesh"), F.col("o_orderpriority").alias("composite")))


@query(f"WITH {_PAIRS} SELECT a_id, b_id FROM pairs WHERE g0 = 0 AND g1 = 0 AND g2 = 0")
def broadphase_overlap_inter(spark, sf):
    return sweep.close_pairs(_parts(spark, sf), sweep.without_gap(), cell=CELL, within=["C"])


@query(f"WITH {BOXES_SQL} SELECT a.id AS a_id, b.id AS b_id FROM boxes a JOIN boxes b ON a.id < b.id AND {_OVERLAP}")
def broadphase_overlap_intra(spark, sf):
    b = boxes(spark, sf).drop("composite")
    return sweep.close_pairs(b, sweep.overlapping(), cell=CELL)


@query(f"WITH {_PAIRS} SELECT a_id, b_id FROM pairs WHERE g0 * g0 + g1 * g1 + g2 * g2 <= {TOLERANCE} * {TOLERANCE}")
def broadphase_distance(spark, sf):
    return sweep.close_pairs(_parts(spark, sf), sweep.within_distance(TOLERANCE), cell=CELL, within=["C"])


@query(f"WITH {BOXES_SQL} SELECT a.id AS a_id, b.id AS b_id FROM boxes a JOIN boxes b ON a.id < b.id AND greatest({', '.join(f'a.lo{k} - b.hi{k}, b.lo{k} - a.hi{k}' for k in range(3))}, 0.0) <= 1e-9 * greatest({', '.join(f'greatest(a.hi{k}, b.hi{k}) - least(a.lo{k}, b.lo{k})' for k in range(3))})")
def broadphase_contact(spark, sf):
    b = boxes(spark, sf).drop("composite")
    return sweep.close_pairs(b, sweep.in_contact(), cell=CELL)


@query(f"WITH {_PAIRS} SELECT DISTINCT least(ac, bc) AS a, greatest(ac, bc) AS b FROM pairs WHERE g0 = 0 AND g1 = 0 AND g2 = 0")
def composite_pairs(spark, sf):
    touching, pairs = clash.open_pairs(_parts(spark, sf), partial(spatial.overlap_join, cell=CELL))
    return touching.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(clash.composite_pairs(pairs)).distinct()


@query(f"WITH {_PAIRS} SELECT ac AS a, bc AS b, round(sqrt(min(g0 * g0 + g1 * g1 + g2 * g2)), 9) AS distance FROM pairs WHERE g0 * g0 + g1 * g1 + g2 * g2 <= {TOLERANCE} * {TOLERANCE} GROUP BY 1, 2")
def clearance_min_segment(spark, sf):
    touching, pairs = clash.open_pairs(_parts(spark, sf), partial(spatial.distance_join, tolerance=TOLERANCE, cell=CELL))
    return touching.withColumn("distance", F.lit(0.0)).union(clash.shortest(pairs).select("a", "b", F.round("distance", 9).alias("distance")))


_NEAREST = ", ".join(f"round(CASE WHEN {x}.hi{k} < {y}.lo{k} THEN {x}.hi{k} WHEN {y}.hi{k} < {x}.lo{k} THEN {x}.lo{k} ELSE (greatest(a.lo{k}, b.lo{k}) + least(a.hi{k}, b.hi{k})) / 2 END, 9) AS p{x}{k}" for x, y in ("ab", "ba") for k in range(3))


@query(f"WITH {BOXES_SQL} SELECT a.id AS a_id, b.id AS b_id, {_NEAREST} FROM boxes a JOIN boxes b ON b.id = a.id + 1")
def box_closest_points(spark, sf):
    b = boxes(spark, sf).drop("composite")
    a = b.select(*(F.col(c).alias(f"a_{c}") for c in b.columns))
    pairs = a.join(b.select(*(F.col(c).alias(f"b_{c}") for c in b.columns)), F.col("b_id") == F.col("a_id") + 1)
    return pairs.select("a_id", "b_id", *spatial.closest_points()).select("a_id", "b_id", *(F.round(f"p{x}{k}", 9).alias(f"p{x}{k}") for x in "ab" for k in range(3)))


_DEPTH = ", ".join(f"least(a.hi{k} - b.lo{k}, b.hi{k} - a.lo{k})" for k in range(3))


@query(f"WITH {BOXES_SQL} SELECT a.id AS a_id, b.id AS b_id, round(least({_DEPTH}), 9) AS depth, CAST(list_position([{_DEPTH}], least({_DEPTH})) - 1 AS INTEGER) AS axis FROM boxes a JOIN boxes b ON a.id < b.id AND {_OVERLAP}")
def min_separating_axis(spark, sf):
    b = boxes(spark, sf).drop("composite")
    return sweep.close_pairs(b, sweep.overlapping(**sweep.least_depth()), cell=CELL)


@query("SELECT o_orderkey AS id, o_totalprice * 100 AS worst FROM orders WHERE o_totalprice * 100 > 8e6")
def limit_violations(spark, sf):
    size = F.col("o_totalprice") * 100
    b = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), *(F.lit(0.0).alias(f"lo{k}") for k in range(3)), size.alias("hi0"), F.lit(1.0).alias("hi1"), F.lit(1.0).alias("hi2"))
    return clash.limit_violations(b)


@query(f"WITH {BOXES_SQL}, m AS (SELECT median((lo0 + hi0) / 2) AS plane FROM boxes) SELECT id, round(plane, 9) AS plane, side FROM boxes, m, (VALUES ('l'), ('r')) s(side) WHERE (side = 'l' AND lo0 < plane) OR (side = 'r' AND (hi0 > plane OR lo0 >= plane))")
def median_split(spark, sf):
    return spatial.median_split(boxes(spark, sf), 0).select("id", F.round("plane", 9).alias("plane"), "side")


@query()
def rd_tree(spark, sf):
    return spatial.rd_tree(boxes(spark, sf).drop("composite"), 5)


def _triangles(spark, sf):
    """Two triangles of each embedding: its first nine and next nine values."""
    nine = lambda at: F.transform(F.slice("embedding", at, 9), lambda x: x.cast("double"))
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), nine(1).alias("s"), nine(10).alias("t"))


@query()
def triangle_closest_points(spark, sf):
    return _triangles(spark, sf).withColumn("c", geometry.closest_points("s", "t")).select("id", "c.distance", "c.a", "c.b")


@query()
def triangle_intersects(spark, sf):
    return _triangles(spark, sf).select("id", geometry.intersects("s", "t").alias("hit"))


@query(f"WITH {BOXES_SQL}, p AS (SELECT a.id AS a_id, b.id AS b_id, a.lo0 <= b.hi0 AND b.lo0 <= a.hi0 AND a.lo1 <= b.hi1 AND b.lo1 <= a.hi1 AND (a.lo2 + a.hi2) / 2 BETWEEN b.lo2 AND b.hi2 AS hit FROM boxes a JOIN boxes b ON b.id = a.id + 1) SELECT a_id, b_id, hit FROM p")
def crossing_triangles(spark, sf):
    """A box's middle plane as two triangles against an upright square in the next box, as the exact test has them: the SQL asks their intervals."""
    b = boxes(spark, sf).drop("composite")
    a = b.select(*(F.col(c).alias(f"a_{c}") for c in b.columns))
    pairs = a.join(b.select(*(F.col(c).alias(f"b_{c}") for c in b.columns)), F.col("b_id") == F.col("a_id") + 1)
    c = F.col
    level = (c("a_lo2") + c("a_hi2")) / 2
    corner = lambda x, y: [c(f"a_{x}0"), c(f"a_{y}1"), level]
    flat = [F.array(*corner("lo", "lo"), *corner("hi", "lo"), *corner(*third)) for third in (("hi", "hi"),)] + [F.array(*corner("lo", "lo"), *corner("hi", "hi"), *corner("lo", "hi"))]
    wall = lambda x, y, z: [c(f"b_{x}0"), c(f"b_{y}1"), c(f"b_{z}2")]
    faces = []  # the walls of the other box, two triangles each, and its diagonal planes for what lies within
    for p, q in ((("lo", "lo"), ("hi", "lo")), (("hi", "lo"), ("hi", "hi")), (("hi", "hi"), ("lo", "hi")), (("lo", "hi"), ("lo", "lo")), (("lo", "lo"), ("hi", "hi")), (("lo", "hi"), ("hi", "lo"))):
        faces += [F.array(*wall(*p, "lo"), *wall(*q, "lo"), *wall(*q, "hi")), F.array(*wall(*p, "lo"), *wall(*q, "hi"), *wall(*p, "hi"))]
    tests = pairs.select("a_id", "b_id", F.explode(F.array(*(F.struct(f.alias("s"), w.alias("t")) for f in flat for w in faces))).alias("p"))
    return tests.select("a_id", "b_id", exact.triangle_test("p.s", "p.t").alias("r")).groupBy("a_id", "b_id").agg(F.max("r.hit").alias("hit"))


@query()
def clearance_clashes(spark, sf):
    """Broadphase on boxes of triangles, then the exact distance of the triangles themselves."""
    e = _triangles(spark, sf).select("id", "s")
    axis = lambda k: [F.get("s", F.lit(k)), F.get("s", F.lit(k + 3)), F.get("s", F.lit(k + 6))]
    b = e.select("id", F.concat(F.lit("L"), (F.col("id") % 10).cast("string")).alias("composite"), F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("part"), *(F.least(*axis(k)).alias(f"lo{k}") for k in range(3)), *(F.greatest(*axis(k)).alias(f"hi{k}") for k in range(3)))
    near = partial(spatial.distance_join, tolerance=TOLERANCE, cell=CELL)
    pairs = clash.candidate_pairs(clash.leading(b, e, near), near)
    return clash.clearance(pairs, e, TOLERANCE)


_CUBE = [(0, 2, 1), (0, 3, 2), (4, 5, 6), (4, 6, 7), (0, 1, 5), (0, 5, 4), (1, 2, 6), (1, 6, 5), (2, 3, 7), (2, 7, 6), (3, 0, 4), (3, 4, 7)]


def _faces(spark, sf):
    """A cube for every part; a face is missing where the size is even."""
    face = F.explode(F.array(*(F.struct(F.lit(i).alias("face_no"), F.array(*map(F.lit, f)).alias("v")) for i, f in enumerate(_CUBE)))).alias("f")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("mesh"), "p_size", face).select("mesh", "p_size", "f.face_no", "f.v").where("p_size % 2 = 1 or face_no > 0").drop("p_size")


@query("SELECT p_partkey AS mesh, p_size % 2 = 1 AS closed FROM part")
def closed_manifold(spark, sf):
    return geometry.closed_and_manifold(_faces(spark, sf))


_VERTEX = "SELECT l_orderkey AS mesh, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos, l_returnflag AS x, l_linestatus AS y FROM lineitem"


@query(f"WITH v AS ({_VERTEX}), f AS (SELECT mesh, x, y, min(pos) AS first FROM v GROUP BY ALL), d AS (SELECT *, row_number() OVER (PARTITION BY mesh ORDER BY first) - 1 AS new_pos FROM f) SELECT mesh, CAST(pos AS INTEGER) AS pos, CAST(new_pos AS INTEGER) AS new_pos FROM v JOIN d USING (mesh, x, y)")
def dedupe_vertices(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    v = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("mesh"), (F.row_number().over(w) - 1).alias("pos"), F.col("l_returnflag").alias("x"), F.col("l_linestatus").alias("y"))
    return geometry.distinct_vertices(v, ["x", "y"])


@query()
def mesh_contains(spark, sf):
    """Which of an embedding's points lie in a cube around the origin."""
    corners = [(-1, -1, -1), (1, -1, -1), (1, 1, -1), (-1, 1, -1), (-1, -1, 1), (1, -1, 1), (1, 1, 1), (-1, 1, 1)]
    cube = F.array(*(F.lit(0.1 * x) for f in _CUBE for i in f for x in corners[i]))
    points = F.transform(F.slice("embedding", 1, 30), lambda x: x.cast("double"))
    return table(spark, sf, "embeddings").select("vec_id", geometry.mesh_contains(points, cube).alias("inside"))


@query(f"WITH {BOXES_SQL}, p AS (SELECT a.composite AS a, b.composite AS b, a.id AS a_id, b.id AS b_id, least({_DEPTH}) AS depth, " + ", ".join(f"[{', '.join(f'round(({s}.lo{k} + {s}.hi{k}) / 2, 9)' for k in range(3))}] AS p{s}" for s in "ab") + f" FROM boxes a JOIN boxes b ON a.id % 2 = 0 AND b.id % 2 = 1 AND a.composite <> b.composite AND {_OVERLAP}) SELECT a, b, a_id, b_id, round(depth, 9) AS depth, [pa, pb] AS positions FROM p WHERE depth > {TOLERANCE}")
def hard_clash_depths(spark, sf):
    """Boxes as closed meshes: pairs that must give way by more than the tolerance to come apart.

    Boxes part only by the least movement along an axis, which the SQL states."""
    b = boxes(spark, sf).withColumn("part", F.when(F.col("id") % 2 == 0, "A").when(F.col("id") % 2 == 1, "B")).where("part IS NOT NULL")
    corners = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)]
    v = F.array(*(F.col(f"{'hi' if x[k] else 'lo'}{k}") for x in corners for k in range(3)))
    meshes = b.withColumns({"v": v, "f": F.array(*(F.lit(i) for f in _CUBE for i in f))})
    return penetration.clashing(meshes, TOLERANCE, 9, CELL)
