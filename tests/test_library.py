"""Filters, store, readers, spatial joins, geometry, packing and streaming, against brute force."""

import datetime
import gzip
import json
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from trussline.functions import documents, linear
from trussline.operators import clash, frames, geometry, graph, metadata, packing, partition, penetration, scenes, spatial, tree
from trussline.plans.filters import All, ElemMatch, Eq, Exists, Projection, any_of, condition, project
from trussline.sources import container, files, ifc, readers, store
from trussline.streaming import jobs, outbox


@pytest.fixture(scope="module")
def docs(spark):
    rows = [("a", 1, "x", ["p", "q"], [(1, "u"), (2, "v")]), ("b", 2, None, [], []), ("c", 3, "y", None, [(2, "u")]), ("d", 4, "x", ["q"], None)]
    return spark.createDataFrame(rows, "_id string, counter int, name string, tags array<string>, items array<struct<k:int,t:string>>")


@pytest.mark.parametrize(
    ("q", "want"),
    [
        (Eq("name", "x"), "ad"),
        (Eq("name", ["x", "y"]), "acd"),
        (Eq("tags", "q"), "ad"),
        (Eq("tags", ["p", "z"]), "a"),
        (Eq("items.k", 2), "ac"),
        (Exists("tags", False), "c"),
        (Exists("name"), "acd"),
        (ElemMatch("items", All((Eq("k", 2), Eq("t", "u")))), "c"),
        (any_of(Eq("counter", 2), ElemMatch("items", Eq("k", 1))), "ab"),
        (All((Eq("counter", []), Eq("name", "y"))), "c"),
    ],
)
def test_filters(docs, q, want):
    assert "".join(sorted(r._id for r in store.find_all(docs, q).collect())) == want


def test_empty_filters(docs):
    nothing = Eq("counter", [])
    assert condition(nothing, docs) is None
    assert store.find_all(docs, nothing).count() == 0
    assert store.count(docs, nothing).first().n == 4
    with pytest.raises(ValueError, match="filter"):
        store.find_cursor(docs, nothing)


def test_filters_reach_the_scan(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "d"))
    plan = store.find_all(spark.read.parquet(str(tmp_path / "d")), Eq("name", "x"), Projection(include=("name",)))._jdf.queryExecution().toString()
    assert "EqualTo(name,x)" in plan and "ReadSchema: struct<_id:string,name:string>" in plan


def test_projection_and_pages(docs):
    assert project(docs, Projection(include=("name",))).columns == ["_id", "name"]
    assert project(docs, Projection(include=("name",), exclude=("_id",))).columns == ["name"]
    assert project(docs, Projection(exclude=("tags", "items"))).columns == ["_id", "counter", "name"]
    assert [r.counter for r in store.page(docs, "counter", skip=1, limit=2).collect()] == [3, 2]
    assert store.page(docs, "counter", skip=10).count() == 0
    assert store.find_one(docs, Eq("name", "x"), "counter").first()._id == "d"


def test_store_versions(spark, docs, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"))
    small = docs.select("_id", "counter", "name")
    s.insert("t", "m.scene", small)
    s.upsert("t", "m.scene", spark.createDataFrame([("a", 10, None), ("z", 26, "new")], small.schema), overwrite=False)
    got = {r._id: (r.counter, r.name) for r in s.read("t", "m.scene").collect()}
    assert got == {"a": (10, "x"), "b": (2, None), "c": (3, "y"), "d": (4, "x"), "z": (26, "new")}
    s.upsert("t", "m.scene", spark.createDataFrame([("a", 11, None)], small.schema), overwrite=True)
    s.delete("t", "m.scene", spark.createDataFrame([("b",)], "_id string"))
    got = {r._id: (r.counter, r.name) for r in s.read("t", "m.scene").collect()}
    assert got == {"a": (11, None), "c": (3, "y"), "d": (4, "x"), "z": (26, "new")}
    assert s.collections("t") == ["m.scene"]
    assert s.drop("t", "m.scene") and s.collections("t") == []
    with pytest.raises(FileNotFoundError):
        s.read("t", "m.scene")


def test_csv_metadata(spark, tmp_path):
    (tmp_path / "m.csv").write_text("name|a|b\nn1|12| 12\nn2|1.5|1e3\nn3|abc|\n")
    got = {r.name: [(m.key, m.tag, m.value) for m in r.metadata] for r in readers.csv_metadata(spark, str(tmp_path / "m.csv"), "|").collect()}
    assert got == {
        "n1": [("name", "string", "n1"), ("a", "long", "12"), ("b", "string", " 12")],
        "n2": [("name", "string", "n2"), ("a", "double", "1.5"), ("b", "double", "1e3")],
        "n3": [("name", "string", "n3"), ("a", "string", "abc")],
    }


def test_text_meshes(spark, tmp_path):
    (tmp_path / "m.obj").write_text("# c\nv 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nf 1/1 2/2 3/3 4/4\nf -4 -3 -2\n")
    (tmp_path / "m.ply").write_text("ply\nformat ascii 1.0\nelement vertex 4\nproperty float x\nproperty float y\nproperty float z\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n0 0 0\n1 0 0\n1 1 0\n0 1 0\n4 0 1 2 3\n")
    a, b = readers.obj_mesh(spark, str(tmp_path / "m.obj")).first(), readers.ply_mesh(spark, str(tmp_path / "m.ply")).first()
    assert a.vertices == b.vertices == [[0, 0, 0], [1, 0, 0], [1, 1, 0], [0, 1, 0]]
    assert a.faces == [[0, 1, 2], [0, 2, 3], [0, 1, 2]] and b.faces == [[0, 1, 2], [0, 2, 3]]
    assert readers.reader_for("x/Y.OBJ") == "obj_mesh" and readers.reader_for("x.rvt") is None


def test_clash_config(spark, tmp_path):
    part = {"teamspace": "t", "container": "c", "revision": "r", "objects": [{"id": "1", "meshIds": ["m1"]}, {"id": "1", "meshIds": ["m2", "m1"]}]}
    (tmp_path / "c.json").write_text(json.dumps({"type": "hard", "tolerance": 0.1, "setA": [part], "setB": []}, indent=1))
    got = readers.clash_config(spark, str(tmp_path / "c.json")).collect()
    assert [(r.set_name, r.id, r.mesh_ids) for r in got] == [("A", "1", ["m1", "m2"])]


def test_blobs_and_files(spark):
    rows = spark.createDataFrame([(i, 10 + i) for i in range(50)], "k long, n long")
    packed = readers.pack_blobs(rows, "n", "k", 100).collect()
    files = {}
    for r in packed:
        files.setdefault(r.ref.name, []).append((r.ref.start, r.ref.size))
    for spans in files.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
    blobs = spark.createDataFrame([("/x/f1", bytearray(b"hello world"))], "path string, content binary")
    nodes = spark.createDataFrame([("a", ("f1", 6, 5))], "_id string, ref struct<name:string,start:int,size:int>")
    assert bytes(readers.resolve_ranges(nodes, blobs).first().data) == b"world"
    refs = spark.createDataFrame([("r", "z")], "_id string, link string")
    zipped = spark.createDataFrame([("/x/z", bytearray(gzip.compress(b"abc")))], "path string, content binary")
    assert bytes(readers.load_files(refs, zipped, gzip_encoded=True).first().data) == b"abc"
    with pytest.raises(Exception, match="no file"):
        readers.load_files(refs, blobs).collect()


def random_boxes(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        c = [rng.uniform(-1, 1) for _ in range(3)]
        s = [rng.choice([0, 0.01, 0.1, 1.5]) * rng.random() for _ in range(3)]
        rows.append((i, *(x - d for x, d in zip(c, s, strict=True)), *(x + d for x, d in zip(c, s, strict=True))))
    return rows


BOX = "id long, " + ", ".join(f"{c} double" for c in spatial.CORNERS)


def gaps(a, b):
    return [max(a[1 + k] - b[4 + k], b[1 + k] - a[4 + k], 0.0) for k in range(3)]


@pytest.mark.parametrize(("cell", "few"), [(0.02, 0), (0.5, 0), (None, 0), (None, spatial.FEW)])
def test_box_joins(spark, monkeypatch, cell, few):
    monkeypatch.setattr(spatial, "FEW", few)
    a, b = random_boxes(120, 1), [*random_boxes(100, 2), (999, -5.0, -5.0, -5.0, 5.0, 5.0, 5.0)]
    da, db = spark.createDataFrame(a, BOX), spark.createDataFrame(b, BOX)
    hit = [(r.a_id, r.b_id) for r in spatial.overlap_join(da, db, cell).collect()]
    assert sorted(hit) == sorted((x[0], y[0]) for x in a for y in b if max(gaps(x, y)) == 0)
    near = [(r.a_id, r.b_id) for r in spatial.distance_join(da, db, 0.2, cell).collect()]
    assert sorted(near) == sorted((x[0], y[0]) for x in a for y in b if sum(g * g for g in gaps(x, y)) <= 0.2 * 0.2)
    assert spatial.overlap_join(da.limit(0), db, cell).count() == 0


def test_box_join_plan_has_no_nested_loop(spark, monkeypatch):
    monkeypatch.setattr(spatial, "FEW", 0)
    d = spark.createDataFrame(random_boxes(10, 1), BOX)
    plan = spatial.overlap_join(d, d, 0.1)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_triangle_distance_is_known_by_construction():
    rng = np.random.default_rng(5)
    n = 2000
    s = rng.uniform(-1, 1, (n, 3, 3))
    s[:, :, 2] = -np.abs(s[:, :, 2]) * rng.integers(0, 2, (n, 3))
    t = rng.uniform(-1, 1, (n, 3, 3))
    gap = rng.uniform(0.01, 2, n)
    t[:, :, 2] = gap[:, None] + np.abs(t[:, :, 2])
    s[:, 0], t[:, 0] = 0, 0  # the closest vertices, one above the other
    t[:, 0, 2] = gap
    a, b, d = geometry.triangle_points(s, t)
    assert np.allclose(d, gap)
    assert np.allclose(np.linalg.norm(a - b, axis=1), d)


def test_triangle_distance_against_samples():
    rng = np.random.default_rng(6)
    s, t = rng.normal(size=(300, 3, 3)), rng.normal(size=(300, 3, 3)) + rng.normal(size=(300, 1, 3))
    d = geometry.triangle_points(s, t)[2]
    w = rng.dirichlet([0.4] * 3, 400)
    ps, pt = np.einsum("wk,nkc->nwc", w, s), np.einsum("wk,nkc->nwc", w, t)
    sampled = np.sqrt(((ps[:, :, None] - pt[:, None]) ** 2).sum(-1)).min((1, 2))
    assert (d <= sampled + 1e-12).all() and (sampled - d).mean() < 0.1


def test_triangles_that_cross_or_degenerate():
    s = np.array([[[0, 0, 0], [1, 0, 0], [0, 1, 0]]] * 3, float)
    t = np.array([[[0.2, 0.2, -1], [0.2, 0.2, 1], [2, 2, 0]], [[5, 0, 0], [5, 0, 0], [5, 0, 0]], [[0.1, 0.1, 0], [0.2, 0.1, 0], [0.1, 0.2, 0]]], float)
    assert np.allclose(geometry.triangle_points(s, t)[2], [0, 4, 0])


def test_inside_mesh():
    from trussline.queries.clashes import _CUBE

    corners = np.array([(-1, -1, -1), (1, -1, -1), (1, 1, -1), (-1, 1, -1), (-1, -1, 1), (1, -1, 1), (1, 1, 1), (-1, 1, 1)], float)
    cube = corners[np.array(_CUBE)]
    p = np.random.default_rng(1).uniform(-1.5, 1.5, (400, 3))
    assert (geometry.inside_mesh(p, cube) == (np.abs(p) < 1).all(1)).all()


def test_filled(spark):
    rows = [("a", i, n) for i, n in enumerate([5, 5, 1, 20, 3])] + [("b", 0, 0), ("b", 1, 30), (None, 0, 4), (None, 1, 7)]
    got = packing.filled(spark.createDataFrame(rows, "g string, id int, n int"), ["g"], ["id"], "bin", {"n": 10}).collect()
    assert sorted(((r.g or "", r.id), r.bin) for r in got) == [(("", 0), 0), (("", 1), 1), (("a", 0), 0), (("a", 1), 0), (("a", 2), 1), (("a", 3), 2), (("a", 4), 3), (("b", 0), 0), (("b", 1), 0)]


def test_bins_close_at_the_limit(spark):
    rows = [(1, i, v, float(i)) for i, v in enumerate([4, 6, 0, 9, 2, 5])] + [(None, 9, 3, 1.0)]
    m = spark.createDataFrame(rows, "g int, id long, vertices long, efficiency double")
    got = {(r.g, r.id): r.bin for r in packing.first_bins(m, ["g"], 10).collect()}
    assert got == {(1, 0): 0, (1, 1): 0, (1, 2): 1, (1, 3): 1, (1, 4): None, (1, 5): None, (None, 9): 0}
    wide = {r.id: r.bin for r in packing.first_bins(m.where("g = 1"), ["g"], 10, 0.9).collect()}  # until 23 of 26 vertices
    assert wide == {0: 0, 1: 0, 2: 1, 3: 1, 4: 1, 5: 2}


def test_running_totals_in_parts(spark):
    rng = np.random.default_rng(2)
    rows = [(None if k % 50 == 0 else int(rng.integers(0, 3)), i, int(rng.integers(0, 9))) for i, k in enumerate(range(3000))]
    df = spark.createDataFrame(rows, "g int, id long, n long").repartition(7)
    ask = lambda whole: sorted(((r.g is None, r.g, r.id), r.total, r.rows) for r in partition.running(df, ["g"], ["id"], {"total": "n", "rows": F.lit(1)}, whole).collect())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert ask(1_000_000) == ask(0)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert partition.running(df.limit(0), ["g"], ["id"], {"total": "n"}).count() == 0


def test_clusters_hold_the_limit(spark):
    boxes_ = [(0, *r[1:], r[0], 10 + r[0] % 7) for r in random_boxes(200, 3)]
    spot = [(1, *boxes_[0][1:7], 1000 + k, 20) for k in range(40)] + [(2, *boxes_[1][1:7], 5000, 90), (None, *boxes_[2][1:7], 5001, 1)]  # one spot, a large mesh, a null group
    m = spark.createDataFrame(boxes_ + spot, "g int, " + ", ".join(f"{c} double" for c in spatial.CORNERS) + ", id long, vertices long")
    got = packing.spatial_clusters(m, ["g"], 60).toPandas()
    assert sorted(got["id"]) == sorted(r[7] for r in boxes_ + spot)
    got["node"] = got["node"].map(tuple)
    sums = got.groupby(["g", "level", "node"], dropna=False)["vertices"].agg(["sum", "size"])
    assert ((sums["sum"] < 60) | (sums["size"] == 1)).all()
    part = got[got["g"] == 0]
    assert 200 * 13 / 60 < part.groupby(["level", "node"]).ngroups < 200  # and parts are not single meshes


def test_pack_leaves_what_is_to_be_split(spark):
    m = spark.createDataFrame([("a", i, n) for i, n in enumerate([5, 4, 30, 1, 2])], "g string, id long, vertices long")
    assert {r.id: r.batch for r in packing.pack(m, ["g"], 10).collect()} == {0: 0, 1: 0, 2: None, 3: 0, 4: 1}


def test_split_meshes(spark):
    """A grid of triangles, triangles in one spot, and a small mesh."""
    n = 24
    grid = []
    for x in range(n):
        for y in range(n):
            v = x * (n + 1) + y
            grid += [("grid", 2 * (x * n + y), [v, v + 1, v + n + 1], [x + 0.3, y + 0.3, 0.0]), ("grid", 2 * (x * n + y) + 1, [v + 1, v + n + 2, v + n + 1], [x + 0.7, y + 0.7, 0.0])]
    spot = [("spot", k, [3 * k, 3 * k + 1, 3 * k + 2], [1.0, 1.0, 1.0]) for k in range(100)]
    rows = grid + spot + [("small", 1, [7, 5, 7], [0.0, 0.0, 0.0])]
    faces = spark.createDataFrame(rows, "mesh string, face long, vertices array<long>, centre array<double>")
    got = packing.split_meshes(faces, 50).collect()
    assert sorted((r.mesh, r.face, r.vertices) for r in got) == sorted(r[:3] for r in rows)
    parts = {}
    for r in got:
        parts.setdefault((r.mesh, r.part), []).append(r)
    for own in parts.values():
        used = sorted({v for r in own for v in r.vertices})
        assert len(used) <= 50 and all([used[k] for k in r.local] == r.vertices for r in own)
    assert sorted(p for m, p in parts if m == "grid") == list(range(len([p for m, p in parts if m == "grid"])))
    assert 625 / 50 <= len([p for m, p in parts if m == "grid"]) <= 60 and [p for m, p in parts if m == "small"] == [0]
    assert packing.split_meshes(faces.limit(0)).count() == 0


def scene(spark):
    rows = [
        ("r", "1", "transformation", "root", [], None), ("a", "2", "transformation", "A", ["r"], 2.0), ("b", "3", "transformation", "B", ["a"], 3.0),
        ("m1", "4", "mesh", "x", ["a"], None), ("m2", "5", "mesh", "y (IFC Space)", ["b"], None), ("m3", "6", "mesh", "z", ["a", "b"], None),
    ]
    df = spark.createDataFrame(rows, "shared_id string, _id string, type string, name string, parents array<string>, s double")
    return df.withColumn("matrix", F.when(F.col("s").isNotNull(), linear.scaling(F.col("s"), F.col("s"), F.col("s")))).withColumn("hidden", F.lit(False)).drop("s")


def test_graph_with_two_parents(spark):
    n = scene(spark)
    got = sorted((r.ancestor, r.descendant) for r in graph.descendants(n, n.where("shared_id = 'a'"), "mesh").collect())
    assert got == [("a", "m1"), ("a", "m2"), ("a", "m3"), ("a", "m3")]  # reachable twice, there twice
    assert {r.shared_id: r.world[0] for r in graph.world_transforms(n).collect()} == {"r": 1, "a": 2, "b": 6}
    assert {r.mesh: r.world[0] for r in graph.sparse_world_transforms(n, n.where("type = 'mesh'")).collect()} == {"m1": 2, "m2": 6, "m3": 2}
    assert not graph.has_missing_nodes(n).first().missing
    assert graph.has_missing_nodes(n.where("shared_id <> 'b'")).first().missing
    cut = graph.abandon(n, spark.createDataFrame([("m3", "b")], "child string, parent string"))
    assert cut.where("shared_id = 'm3'").first().parents == ["a"]
    assert graph.set_parents(cut, spark.createDataFrame([("m3", "b"), ("m3", "a")], "child string, parent string")).where("shared_id = 'm3'").first().parents == ["a", "b"]
    loop = spark.createDataFrame([("x", "y"), ("y", "x")], "parent string, child string")
    with pytest.raises(RecursionError):
        graph.walk(loop.selectExpr("child as n"), lambda f: f.join(loop, f.n == loop.parent).selectExpr("child as n"), 5)


def test_selection_tree(spark):
    n = scene(spark)
    states = tree.toggle_states(n)
    assert {r.shared_id: r.state for r in states.collect()} == {"r": "parentOfInvisible", "a": "parentOfInvisible", "b": "parentOfInvisible", "m1": "visible", "m2": "invisible", "m3": "visible"}
    doc = json.loads(tree.tree_documents(n, states, 0).first().tree)
    assert doc["children"][0]["path"] == "r__a" and [c["name"] for c in doc["children"][0]["children"]] == ["B", "x", "z"]


def test_report_hides_clashes_behind_errors(spark):
    c = spark.createDataFrame([("a", "b", [[0.0]], "1")], "a string, b string, positions array<array<double>>, fingerprint string")
    none = spark.createDataFrame([], "type string, uniqueId string")
    some = spark.createDataFrame([("DuplicateMeshIdsException", "u")], none.schema)
    assert [r.kind for r in clash.report(c, none).collect()] == ["clash"]
    assert [json.loads(r.json) for r in clash.report(c, some).collect()] == [{"type": "DuplicateMeshIdsException", "uniqueId": "u"}]


def test_matrix_inverse_and_rotation(spark):
    m = linear.multiply(linear.rotation_z(0.3), linear.translation(1, 2, 3))
    r = spark.range(1).select(linear.is_identity(linear.multiply(m, linear.inverse(m))).alias("i"), linear.determinant(m).alias("d"), linear.inverse(linear.scaling(0, 1, 1)).alias("n")).first()
    assert r.i and math.isclose(r.d, 1) and r.n is None


def test_job_stream_resumes(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    handle = lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}")
    for lines in (["import -f /a", "bogus"], ["genStash t c tree"]):
        (src / f"{len(lines)}.txt").write_text("\n".join(lines))
        jobs.drain(jobs.job_stream(spark, str(src)), handle, str(tmp_path / "ck"))
    got = sorted((r.value, r.command, r.argument) for r in spark.read.parquet(out).collect())
    assert got == [("bogus", None, None), ("genStash t c tree", "genStash", "tree"), ("import -f /a", "import", "/a")]


def test_latest_values_stream(spark, tmp_path):
    src = tmp_path / "in"
    schema = "resource long, ts timestamp, seq long, value double, reset boolean"
    seen = {}

    def keep(batch, n):
        seen.update({r.resource: r.value for r in batch.collect()})

    stamp = lambda d: datetime.datetime(2024, 1, d)
    for rows in ([(1, stamp(1), 0, 5.0, False), (2, stamp(1), 1, 7.0, False)], [(1, stamp(3), 2, 9.0, True), (2, stamp(2), 3, 8.0, False)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(schema).parquet(str(src))
        q = jobs.latest_values(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert seen[2] == 8.0 and (seen[1] is None or math.isnan(seen[1]))


CORNERS = np.array([(-1, -1, -1), (1, -1, -1), (1, 1, -1), (-1, 1, -1), (-1, -1, 1), (1, -1, 1), (1, 1, 1), (-1, 1, 1)], float)


def cube():
    from trussline.queries.clashes import _CUBE

    return CORNERS.copy(), np.array(_CUBE)


def test_penetration_of_cubes():
    v, f = cube()
    for move, want in (([2.5, 0, 0], 0.0), ([1.9, 0.2, 0.1], 0.1), ([1.2, 0.1, 0.1], 0.8)):
        assert penetration.depths([(v * 0.999999 + move, f, v, f)], 0.5)[0] == pytest.approx(want, abs=1e-4)
    small = v * 0.1
    assert penetration.depths([(small, f, v, f)], 0.5)[0] == pytest.approx(1.1)  # wholly inside
    assert penetration.closed(f) and not penetration.closed(f[:-1])
    out = penetration.outward(v, f)
    assert (np.einsum("ij,ij->i", out, v) > 0.5).all()


def test_hard_clashes(spark):
    v, f = cube()
    rows = [(i, (v + [x, 0, 0]).ravel().tolist(), f.ravel().tolist()) for i, x in enumerate([0.0, 1.0, 1.95, 9.0])]
    meshes = spark.createDataFrame(rows, "id long, v array<double>, f array<int>")
    lo, hi = v.min(0), v.max(0)
    side = lambda x: [*map(float, lo + [x, 0, 0]), *map(float, hi + [x, 0, 0])]
    corners = ", ".join(f"{s}_{c}{k} double" for s in "ab" for c in ("lo", "hi") for k in range(3))
    boxed = [(0, j, "A", n, *side(0.0), *side(x)) for j, n, x in ((1, "B", 1.0), (2, "C", 1.95), (3, "D", 9.0))]
    pairs = spark.createDataFrame(boxed, "a_id long, b_id long, a_composite string, b_composite string, " + corners)
    got = penetration.hard_clashes(pairs, meshes, 0.5).collect()
    assert [(r.a, r.b, round(r.depth, 6)) for r in got] == [("A", "B", 1.0)] and got[0].positions == [[0, 0, 0], [1, 0, 0]]


def test_documents(spark):
    df = spark.createDataFrame([(1, "x", {"k": "1"}, {"k": "2", "l": "3"}, "<a><b>t</b></a>"), (None, None, {}, {}, "<a/>")], "n int, s string, a map<string,string>, b map<string,string>, x string")
    r = df.select(documents.field_names(df).alias("f"), documents.merged(F.col("a"), F.col("b")).alias("m"), documents.merged(F.col("a"), F.col("b"), unique=True).alias("u"), documents.xml_leaves(F.col("x"), {"b": "/a/b", "c": "/a/c"}).alias("x")).collect()
    assert r[0].f == ["a", "b", "n", "s", "x"] and r[0].m == {"k": "2", "l": "3"} and r[0].u == {"k": "1", "l": "3"}
    assert [(e.key, e.value) for e in r[0].x] == [("b", "t")] and r[1].x == []
    assert df.where("n is not null").select(documents.required(df, "n", "bigint").alias("n")).first().n == 1
    with pytest.raises(TypeError):
        documents.required(df, "s", "bigint")
    with pytest.raises(Exception, match="no field s"):
        df.select(documents.required(df, "s", "string")).collect()


def test_scene_edits_and_commit(spark, tmp_path):
    n = scene(spark)
    world = {r.shared_id: r.world[0] for r in graph.world_transforms(scenes.scale(n, 10.0)).collect()}
    assert world == {"r": 10, "a": 20, "b": 60}
    turned = graph.world_transforms(scenes.reorient(scenes.shift(n.where("shared_id = 'r'"), [0, 1, 2]))).first().world
    assert (turned[3], turned[7], turned[11]) == (0, 2, -1)
    assert spark.range(1).select(scenes.reorient_offset(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))).alias("o")).first().o == [1, 3, -2]
    s = store.Store(spark, str(tmp_path / "s"))
    rev = lambda i, day: spark.createDataFrame([(i, "main", datetime.datetime(2024, 1, day))], "_id string, branch string, timestamp timestamp")
    scenes.commit(s, "t", "m", rev("r1", 1), n)
    scenes.commit(s, "t", "m", rev("r2", 2), n.where("type <> 'mesh'"))
    assert scenes.load(s, "t", "m", "main").count() == 3
    scenes.set_status(s, "t", "m", "r2", 5)
    assert scenes.load(s, "t", "m", "main").count() == 6
    assert scenes.load(s, "t", "m", "main", (5,)).count() == 3


def test_element_hierarchy(spark):
    rel = spark.createDataFrame([("e1", "p2", "aggregates"), ("e1", "p1", "contains"), ("e2", "e1", "nests")], "element string, parent string, kind string")
    parents = scenes.element_parents(rel)
    assert {r.element: r.parent for r in parents.collect()} == {"e1": "p1", "e2": "e1"}
    elements = spark.createDataFrame([("e1", "Wall"), ("e2", "Door")], "element string, kind string")
    assert [(r.branch, r.n) for r in scenes.type_groups(elements, parents).collect()] == [("p1/Wall", 1)]


def test_settings(spark, tmp_path):
    from trussline.sources.config import Settings, read_settings

    (tmp_path / "c.json").write_text(json.dumps({"db": {"root": "/d"}, "fs": {"path": "/f", "level": 3}}, indent=1))
    assert read_settings(spark, str(tmp_path / "c.json")) == Settings("/d", "/f", 3, True)
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(ValueError, match="sections"):
        read_settings(spark, str(tmp_path / "bad.json"))


def test_scenes_that_are_not_whole(spark):
    n = scene(spark)
    assert graph.root(n).first().shared_id == "r"
    with pytest.raises(ValueError, match="more than one"):
        graph.root(n.union(n.where("shared_id = 'r'").withColumn("shared_id", F.lit("r2"))))
    with pytest.raises(ValueError, match="no root"):
        graph.root(n.where("shared_id <> 'r'"))
    meshes = n.where("type = 'mesh'").select("shared_id", F.get("parents", F.lit(0)).alias("parent"))
    worlds = graph.world_transforms(n)
    assert graph.in_world(meshes, worlds).where("world is not null").count() == 3
    with pytest.raises(Exception, match="no transformation above mesh m2"):
        graph.in_world(meshes, worlds.where("shared_id <> 'b'")).collect()
    rows = [("x", "i1", "material", ["m1", "m2", "m3"]), ("y", "i0", "material", ["m2"]), ("t", "i2", "texture", ["x"])]
    look = spark.createDataFrame(rows, "shared_id string, _id string, type string, parents array<string>")
    assert {r.shared_id: r.material for r in packing.with_material(meshes, look).collect()} == {"m1": "i1", "m2": "i0", "m3": "i1"}
    with pytest.raises(Exception, match="no material for mesh"):
        packing.with_material(meshes, look.where("shared_id = 'y'")).collect()
    assert sorted(tuple(r) for r in graph.textures_of(look, meshes).collect()) == [("m1", "t"), ("m2", "t"), ("m3", "t")]


def test_tree_sinks(spark, tmp_path):
    tree.write_documents(scene(spark), str(tmp_path / "t"))
    names = sorted(p.name for p in (tmp_path / "t").iterdir())
    assert names == ["fulltree", "idMap", "idToMeshes", "modelProperties", "tree_path"]
    assert spark.read.json(str(tmp_path / "t/idMap")).count() == 6


@pytest.mark.parametrize("most", [1 << 20, 700, 10])
def test_nested_trees(spark, most):
    """All nodes are in one document or another, children in order; the bound cuts, and what is cut is counted."""
    rows = [("r", "1", "transformation", "root", [])] + [(f"t{k}", f"1{k}", "transformation", f"T{k % 2}", ["r"]) for k in range(4)]
    rows += [(f"m{k}", f"2{k}", "mesh", ["b", "a", 'q"\\', "z (IFC Space)", ""][k % 5], [f"t{k % 3}"]) for k in range(15)]
    nodes = spark.createDataFrame(rows, "shared_id string, _id string, type string, name string, parents array<string>").withColumn("hidden", F.lit(False))
    meta = spark.createDataFrame([("x2", ["t1", "m4"]), ("x1", ["t1"])], "_id string, parents array<string>")
    docs = tree.tree_documents(nodes, tree.toggle_states(nodes), "acc", "pro", meta, most).collect()
    seen, kids = {}, {}

    def visit(doc, parent):
        assert doc["shared_id"] not in seen and (doc["account"], doc["project"]) == ("acc", "pro")
        seen[doc["shared_id"]] = (doc.get("name", ""), doc["type"], doc["toggleState"], doc.get("meta", []), parent)
        kids[doc["shared_id"]] = [c["shared_id"] for c in doc.get("children", [])]
        for c in doc.get("children", []):
            visit(c, doc["shared_id"])

    for d in docs:
        whole = json.loads(d.tree)
        assert whole["shared_id"] == d.shared_id and len(d.tree) <= most + 400
        visit(whole, d.parent)
    names = {r[0]: r for r in rows}
    assert {k: (v[0], v[1], v[4]) for k, v in seen.items()} == {r[0]: (r[3], r[2], r[4][0] if r[4] else None) for r in rows}
    assert seen["t1"][3] == ["x1", "x2"] and seen["m4"][3] == ["x2"] and seen["m3"][2] == "invisible" and seen["t0"][2] == "parentOfInvisible" and seen["t3"][2] == "visible"
    for own in kids.values():
        assert own == sorted(own, key=lambda s: ("(IFC Space)" not in names[s][3], names[s][3], s))
    assert len(docs) == 1 if most > 10_000 else len(docs) > 1
    assert tree.tree_documents(nodes.limit(0), tree.toggle_states(nodes.limit(0))).count() == 0


def test_sequences(spark, tmp_path):
    """Intervals, deltas and buffers of a small animation; a second commit replaces the first."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    rows = [("COLOR", 1, 1, "a", 4), ("COLOR", 1, 4, None, None), ("CLIP", 2, 1, "x", 2), ("CLIP", 2, 2, "x", None), ("COLOR", 3, 9, "late", None), ("CLIP", 5, 3, "between", 3)]
    found = spark.createDataFrame(rows, "kind string, resource long, frame int, state string, until int")
    line = spark.createDataFrame([(f,) for f in (1, 2, 4, 4, 7)], "frame int")
    held = lambda f: {(k, r, s) for k, r, low, s, high in rows if s and low <= f and (high is None or f < high)}
    got = {}
    for r in frames.cache(found, line).collect():
        got.setdefault(r.frame, set()).add((r.kind, r.resource, r.state))
    assert got == {f: held(f) for f in (1, 2, 4, 7)}
    frames.commit_sequence(found, line, str(tmp_path / "s"), "one", "old")
    frames.commit_sequence(found, line, str(tmp_path / "s"), "one", "new", found)
    frames.commit_sequence(found.where("frame < 3"), line, str(tmp_path / "s"), "two", "other")
    read = lambda t: spark.read.parquet(str(tmp_path / "s" / t))
    assert sorted((r.sequence, r.name, r.first, r.last, r.frames) for r in read("sequences").collect()) == [("one", "new", 1, 7, 4), ("two", "other", 1, 7, 4)]
    named = {r.frame: (r.entries, r.buffer) for r in read("frames").where("sequence = 'one'").collect()}
    for f in named:
        assert named[f][0] == len(held(f)) and all((held(f) == held(g)) == (named[f][1] == named[g][1]) for g in named)
    now, seen = set(), {}
    for r in read("deltas").where("sequence = 'one'").orderBy("frame", "enters").collect():
        (now.add if r.enters else now.discard)((r.kind, r.resource, r.state))
        seen[r.frame] = set(now)
    assert seen[4] == held(4) and now == held(7) and read("tasks").count() == len(rows)


def test_normals_and_flags(spark):
    from trussline.functions import values

    n = F.array(*(F.lit(x) for x in (1.0, 0.0, 0.0, 0.0, 0.0, 2.0)))
    r = spark.range(1).select(linear.transform_normals(linear.scaling(2, 3, 4), n).alias("n"), values.is_enabled(F.create_map(F.lit("vr"), F.lit(True)), "vr").alias("a"), values.is_enabled(F.create_map(F.lit("vr"), F.lit(True)), "x").alias("b")).first()
    assert r.n == [1, 0, 0, 0, 0, 1] and r.a and not r.b


def test_complex_numbers(spark):
    from trussline.functions import values

    r = spark.range(1).select(values.complex_number(F.lit(1.5), F.lit(-2.0)).alias("a"), values.complex_number(F.lit(-1.0), F.lit(0.25)).alias("b")).first()
    assert (r.a, r.b) == ("1.500000-2.000000i", "-1.000000+0.250000i")


def test_step_values(spark):
    cases = {
        "$": None, "*": None, "#12": None, '"0F"': None, "()": None, "(#1,#2)": None, ".T.": "true", ".F.": "false", ".U.": "UNKNOWN", ".ELEMENT.": "ELEMENT",
        "42": "42", "-1.5": "-1.5", "2.": "2.0", "1.E3": "1000.0", "'it''s'": "it's", "''": "", "(1.,2.)": "(1.0, 2.0)", "('a','b, c')": "(a, b, c)",
        "IFCLABEL('x')": "x", "IFCBOOLEAN(.T.)": "true", "'caf\\X2\\00E9\\X0\\ \\X\\FC \\\\ \\S\\d'": "café ü \\ ä", "'\\X4\\0001F600\\X0\\'": "\U0001f600",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", ifc.value(F.col("t")).alias("v")).collect()
    assert {r.t: r.v for r in rows} == cases
    text = spark.createDataFrame([("m", "#5 = IfcWall('a;b',\n $, (#1, (2., 'x)')), .T.) ;"), ("m", "ENDSEC")], "model string, value string")
    assert [tuple(r) for r in ifc.entities(text).drop("values").collect()] == [("m", 5, "IFCWALL", ["'a;b'", "$", "(#1, (2., 'x)'))", ".T."])]
    with pytest.raises(Exception, match="schema is not read"):
        ifc.schema_of(spark.createDataFrame([("m", "FILE_SCHEMA(('IFC9'))")], "model string, value string")).collect()


def test_own_properties_come_before_those_of_the_type(spark):
    lines = [
        "#1=IFCDOOR('0000000000000000000001',$,'d',$)", "#2=IFCPROPERTYSINGLEVALUE('A',$,IFCLABEL('own'),$)", "#3=IFCPROPERTYSET('0000000000000000000003',$,'P',$,(#2))",
        "#4=IFCRELDEFINESBYPROPERTIES('0000000000000000000004',$,$,$,(#1),#3)", "#5=IFCPROPERTYSINGLEVALUE('A',$,IFCLABEL('type'),$)", "#6=IFCPROPERTYSINGLEVALUE('B',$,IFCLENGTHMEASURE(2.),#10)",
        "#7=IFCPROPERTYSET('0000000000000000000007',$,'P',$,(#5,#6))", "#8=IFCDOORTYPE('0000000000000000000008',$,'t',$,$,(#7),$)", "#9=IFCRELDEFINESBYTYPE('0000000000000000000009',$,$,$,(#1),#8)",
        "#10=IFCCONVERSIONBASEDUNIT(#11,.LENGTHUNIT.,'FOOT',#12)", "#13=IFCELEMENTQUANTITY('0000000000000000000013',$,'Q',$,$,(#14))", "#14=IFCQUANTITYAREA('Gross',$,$,3.5)",
        "#15=IFCRELDEFINESBYPROPERTIES('0000000000000000000015',$,$,$,(#1),#13)", "#16=IFCSIUNIT(*,.AREAUNIT.,$,.SQUARE_METRE.)", "#17=IFCUNITASSIGNMENT((#16))",
    ]
    found = ifc.entities(spark.createDataFrame([("m", x) for x in lines], "model string, value string"))
    got = {(r.object, r.group, r.name): (r.value, r.unit) for r in ifc.properties(found).collect()}
    assert got == {(1, "P", "A"): ("own", None), (1, "P", "B"): ("2.0", "ft"), (1, "Q", "Gross"): ("3.5", "m²")}
    names = {(r.object, r.name): r.value for r in ifc.object_attributes(found).collect()}
    assert names[1, "IFC Name"] == "d" and {o for o, _ in names} == {1, 8}


def step_statements(text):
    """Statements of STEP text, one character after the other."""
    out, now, k, inside = [], "", 0, False
    while k < len(text):
        if not inside and text.startswith("/*", k):
            end = text.find("*/", k + 2)
            if end < 0:
                now, k = now + text[k:], len(text)
                continue
            k = end + 2
            continue
        c = text[k]
        inside ^= c == "'"
        if c == ";" and not inside:
            out, now = [*out, now], ""
        else:
            now += c
        k += 1
    return [s.strip(" \t\r\n\x0b\x0c") for s in [*out, now] if s.strip(" \t\r\n\x0b\x0c")]


def test_step_statements_over_splits(spark, tmp_path):
    rng = random.Random(12)
    words = ["#1=A(1)", ";", ";\r\n", "\n", "'", "''", "/*", "*/", "'x;y'", "/* ; ' */", "#2=B('it''s; /*')", "é", " ", "(", "*", "/"]
    texts = {f"m{k}.ifc": "".join(rng.choice(words) for _ in range(rng.randrange(400))) for k in range(12)}
    texts |= {"empty.ifc": "", "open.ifc": "#1=A(1);'never; closed", "long.ifc": "#1=A('" + "; " * 3000 + "');\r\n" * 3 + "#2=B();"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        lines = ifc.read(spark, str(tmp_path))
        assert ifc.pieces(spark, str(tmp_path)).select("model", "at.block").distinct().count() > 40
        got = {}
        for r in sorted(lines.collect(), key=lambda r: (r.model, r.no)):
            got.setdefault(r.model.rsplit("/", 1)[1], []).append(r.value)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {name: want for name, text in texts.items() if (want := step_statements(text))}


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_step_file(spark, tmp_path, end):
    text = end.join(["ISO-10303-21;", "HEADER;FILE_SCHEMA(('IFC4'));", "ENDSEC;", "DATA;", "#1=A(1); #2=B('x;y')", ";", "/* a; comment */ #3=C(#1,", "#2);#4=D(());", "#5=(E()F());", "#6=G(1;", "ENDSEC;END-ISO-10303-21;", ""])
    (tmp_path / "a.ifc").write_bytes(text.encode())
    lines = ifc.read(spark, str(tmp_path))
    assert sorted(r.id for r in ifc.entities(lines).collect()) == [1, 2, 3, 4]
    assert [r.args for r in ifc.entities(lines).where("id = 3").collect()] == [["#1", "#2"]]
    assert sorted(r.value for r in ifc.malformed(lines).collect()) == ["#5=(E()F())", "#6=G(1"]
    assert [r.schema for r in ifc.schema_of(lines).collect()] == ["IFC4"]


def test_containers(spark, tmp_path):
    """Files of several nodes: shared and unordered ranges, a second gzip member, textures with and without bytes, nodes that are no entities."""
    rng = random.Random(3)
    image = bytes(rng.randrange(256) for _ in range(200_000))
    corners = struct.pack("<9d", 0, 0, 0, 1, 0, 0, 0, 1, 0)
    data = image + corners + struct.pack("<3I", 2, 1, 0) + struct.pack("<9f", *[0, 0, 2] * 3) + struct.pack("<6f", 0, 0, 1, 0, 0, 1) + b"rest"
    at = len(image)
    geometry = {"vertices": [at, at + 72], "indices": [at + 72, at + 84], "normals": [at + 84, at + 120], "uv": [at + 120, at + 144], "material": 1}
    move = [1, 0, 0, 10, 0, 0, -1, 20, 0, 1, 0, 30, 0, 0, 0, 1]  # a quarter turn about x
    tree = {
        "nodes": [{"id": 7, "name": "root"}, {"id": 3, "parent": 7, "name": ""}, {"id": 4, "parent": 3, "name": "", "transformation": move, "geometry": geometry}, {"id": 5, "parent": 3, "name": "b", "geometry": {"primitive": 2, "vertices": [at, at + 72], "indices": [at + 72, at + 80], "material": 0}, "metadata": {"sName": "x", "dSize": 1.5}}],
        "materials": [{"diffuse": [1, 1, 1], "transparency": 0.25, "shininess": 2, "texture": -1}, {"texture": 9}],
        "textures": [{"id": 9, "filename": "a.png", "width": 2, "height": 3, "imageBytes": [0, at]}, {"id": 8, "filename": "b.png", "width": 0, "height": 3, "imageBytes": [5, 9]}, {"id": 6, "filename": "c.png", "width": 1, "height": 1}],
    }
    for version in (2, 3, 4):
        (tmp_path / f"v{version}.bim").write_bytes(container.packed(tree, data, version))
    whole = gzip.decompress(container.packed(tree, data))
    (tmp_path / "members.bim").write_bytes(gzip.compress(whole[:100]) + gzip.compress(whole[100:]))
    found = container.records(spark, str(tmp_path))
    starts = [r.start for r in found.where("text is null and model like '%v2.bim'").orderBy(F.monotonically_increasing_id()).collect()]
    assert starts == sorted(starts) and len(starts) == 8 and found.select("model").distinct().count() == 4
    meshes, offset = container.meshes(found)
    assert {tuple(r.offset) for r in offset.collect()} == {(0.0, 0.0, 0.0)}
    by = {}
    for r in meshes.collect():
        by.setdefault(r.model.rsplit("/", 1)[1], {})[r.id] = r
    assert len(by) == 4
    for own in by.values():
        assert [list(v) for v in own[4].vertices] == [[10, 20, 30], [11, 20, 30], [10, 20, 31]] and own[4].entity == 4 and own[5].entity == 5
        assert [[round(x, 6) for x in v] for v in own[4].normals] == [[0, -1, 0]] * 3 and own[4].uv == [[0, 0], [1, 0], [0, 1]]
        assert own[4].faces == [[2, 1, 0]] and own[5].faces == [[2, 1]] and own[5].normals is None
    assert {r.id: (r.parent, r.metadata) for r in container.nodes(found).where("model like '%v4.bim'").collect()}[5] == (3, {"Name": "x", "Size": "1.5"})
    assert [(r.material, r.opacity, r.shininess, r.texture) for r in container.materials(found).where("model like '%v4.bim'").orderBy("material").collect()] == [(0, 0.75, 10.0, None), (1, 1.0, None, 9)]
    assert {r.texture: r.image and len(r.image) for r in container.textures(found).where("model like '%v4.bim'").collect()} == {9: at, 8: None, 6: None}
    with pytest.raises(ValueError, match="version"):
        list(container.rows("x", gzip.compress(b"BIM009" + bytes(100))))
    with pytest.raises(ValueError, match="data ends within"):
        list(container.rows("x", container.packed(tree, data[:at])))


def test_files_and_references(spark, tmp_path):
    """Upload, re-upload, delete, and crashes between the steps."""
    path = str(tmp_path / "store")
    some = lambda *rows: spark.createDataFrame([(i, bytearray(b), {"n": i}) for i, b in rows], "_id string, content binary, metadata map<string,string>")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "_id string")
    read = lambda *x: {r._id: bytes(r.content) for r in files.load(ids(*x), path).collect()}
    assert files.references(spark, path).count() == 0 and files.sweep(spark, path) == 0
    files.upload(some(("a", b"1"), ("b", b"22"), ("c", b"")), path)
    assert read("a", "b", "c", "no") == {"a": b"1", "b": b"22", "c": b""}
    files.upload(some(("a", b"new")), path)
    assert read("a") == {"a": b"new"} and files.unreferenced(spark, path).count() == 1
    lost = files.put(some(("b", b"never told")), path)  # a crash before the reference
    assert read("b") == {"b": b"22"} and files.sweep(spark, path, before=3) == 1 and files.unreferenced(spark, path).count() == 1
    files.tell(lost, path)  # it went on after all
    assert read("b") == {"b": b"never told"}
    assert {r._id: r.found for r in files.delete(ids("b", "no"), path).collect()} == {"b": True, "no": False}
    assert read("b") == {} and {r._id for r in files.references(spark, path).collect()} == {"a", "c"}
    files.upload(some(("b", b"again")), path)
    assert files.sweep(spark, path) == 2 and read("a", "b", "c") == {"a": b"new", "b": b"again", "c": b""}
    (tmp_path / "store/files").rename(tmp_path / "store/files-new")  # a crash between the renames of a sweep
    files.recover(spark, path)
    assert read("a", "b") == {"a": b"new", "b": b"again"}
    import shutil

    shutil.rmtree(tmp_path / "store/files")
    with pytest.raises(Exception, match="no file for reference"):
        read("a")


def test_results_are_sent_once(spark, tmp_path):
    """A batch that fails half way is handled again and sends one result a job; a finished one that is handed out again sends none."""
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "1.txt").write_text("import -f a.ifc\nprocessClash t c k\nnonsense\nimport -f crash.ifc\nimport -f a.ifc\n")
    calls = []

    def imports(jobs):
        calls.append(sorted(r.argument for r in jobs.collect()))
        return jobs.where("argument <> 'crash.ifc'").select("job", F.lit(0).alias("value"))

    def clashes(jobs):
        if len(calls) == 1:
            raise RuntimeError("lost")
        return jobs.select("job", F.lit(7).alias("value"))

    run = lambda: outbox.work(jobs.job_stream(spark, str(inbox)).withColumn("job", F.sha2("value", 256)), {"import": imports, "processClash": clashes}, str(tmp_path / "out"), str(tmp_path / "check"))
    with pytest.raises(Exception, match="lost"):
        run()
    assert {r.kind for r in outbox.messages(spark, str(tmp_path / "out")).collect()} == {"status"}
    run()
    want = [("clash", 7), ("import", 0), ("import", outbox.CRASHED), (None, outbox.UNKNOWN)]
    results = lambda: sorted(((r.type, r.value) for r in outbox.messages(spark, str(tmp_path / "out")).where("kind = 'result'").collect()), key=str)
    assert results() == sorted(want, key=str) and calls == [["a.ifc", "crash.ifc"]] * 2
    outbox.handle({"import": imports, "processClash": clashes}, str(tmp_path / "out"))(jobs.decode(spark.createDataFrame([("import -f a.ifc", "x")], "message string, job string")), 0)
    assert len(calls) == 2 and results() == sorted(want, key=str)
    (inbox / "2.txt").write_text("import -f a.ifc\nimport -f b.ifc\n")  # delivered again in a later batch
    run()
    assert len(results()) == 5


def test_crowded_cells_are_dealt(spark, monkeypatch):
    rng = random.Random(4)
    at = [[rng.random() for _ in range(3)] for _ in range(400)] + [[50.0 + 9 * k, 0.0, 0.0] for k in range(40)]
    rows = [(k, *p, *(x + 0.2 for x in p)) for k, p in enumerate(at)]
    boxes = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in spatial.CORNERS))
    want = {(a[0], b[0]) for a in rows for b in rows if all(a[1 + k] <= b[4 + k] and b[1 + k] <= a[4 + k] for k in range(3))}
    monkeypatch.setattr(spatial, "FEW", 0)
    monkeypatch.setattr(spatial, "DENSE", 30)
    got = spatial.overlap_join(boxes, boxes, 0.25).select("a_id", "b_id").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    left, right = (spatial._cells(boxes, side, 0.25, [0], 0.0) for side in "ab")
    dealt, whole = spatial._dealt(left, right, 30)
    largest = lambda df, *by: max(r["count"] for r in df.groupBy(*by).count().collect())
    assert largest(dealt, *spatial.CELLS, "_part") <= 30 < largest(left, *spatial.CELLS)
    assert whole.where("_c0 >= 200").select("_part").distinct().count() == 1  # cells of few boxes are not


def _plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def test_edges_are_dealt_before_they_are_counted(spark):
    faces = spark.createDataFrame([(m, k, v) for m in (1, 2) for k, v in enumerate([[0, 1, 2], [0, 3, 1], [1, 3, 2], [2, 3, 0]]) if (m, k) != (2, 3)], "mesh long, face_no int, v array<int>")
    assert {tuple(r) for r in geometry.closed_and_manifold(faces).collect()} == {(1, True), (2, False)}
    assert _plan(geometry.edge_uses(faces)).count("Exchange") == 1 and "REPARTITION" in _plan(geometry.edge_uses(faces))


def test_statements_are_parsed_once_for_properties(spark):
    lines = spark.createDataFrame([("m", "#1=IFCPROPERTYSINGLEVALUE('a',$,IFCLABEL('x'),$)"), ("m", "#2=IFCPROPERTYSET('g',$,'Own',$,(#1))"), ("m", "#3=IFCRELDEFINESBYPROPERTIES('g',$,$,$,(#9),#2)")], "model string, value string")
    found = ifc.properties(ifc.entities(lines))
    assert [tuple(r) for r in found.collect()] == [("m", 9, "Own", "a", "x", None)]
    assert "ExistingRDD" not in _plan(found) and "regexp_extract_all(value" not in _plan(found)


def test_selection_tree_walks_once(spark, sf, monkeypatch):
    from trussline.queries import hierarchy

    walked, run = [], graph.walk
    monkeypatch.setattr(graph, "walk", lambda *a, **k: walked.append(1) or run(*a, **k))
    assert hierarchy.selection_tree_json(spark, sf).count() and walked == [1]


def test_metadata_moves_in_one_join(spark):
    nodes = spark.createDataFrame([("t", "transformation"), ("e", "transformation"), ("a", "mesh"), ("b", "mesh")], "shared_id string, type string")
    below = spark.createDataFrame([("t", "a"), ("t", "b"), ("a", "a"), ("b", "b"), ("a", "b")], "shared_id string, mesh string")
    attached = spark.createDataFrame([("m1", "t"), ("m1", "a"), ("m2", "e"), ("m3", "a"), ("m4", "gone")], "meta_id string, shared_id string")
    out = metadata.propagate(attached, nodes, below)
    assert sorted(tuple(r) for r in out.collect()) == [("m1", "a"), ("m1", "b"), ("m2", "e"), ("m3", "a"), ("m4", "gone")]
    assert "LeftAnti" not in _plan(out)


def test_container_json_in_pieces():
    """Records come one at a time, wherever the text is cut, and before the rest of it is read."""
    tree = {"version": 12, "nodes": [{"id": 7, "name": "café \\\" ]}", "x": [1, {"y": []}]}, {"id": 3}], "other": {"nodes": [1]}, "materials": [], "textures": [{"id": 9, "w": 1.5}], "last": 34}
    want = [(part[:-1], k, record) for part in container.PARTS for k, record in enumerate(tree[part])]
    for text in (json.dumps(tree), json.dumps(tree, ensure_ascii=False, indent=1)):
        for step in (1, 2, 7, 10_000):
            assert list(container.members(text[k : k + step] for k in range(0, len(text), step))) == want
        for wrong in (text[:-1], text + "x", text.replace("[", "", 1)):
            with pytest.raises(ValueError):
                list(container.members([wrong]))
    taken = []

    def endless():
        yield '{"nodes": ['
        for k in range(1000):
            taken.append(k)
            yield f'{{"id": {k}}}, '

    assert next(container.members(endless()))[2] == {"id": 0} and len(taken) < 5
