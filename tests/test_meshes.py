"""OBJ files over several splits, and STL files."""

import struct

import pytest

from trussline.sources import meshes, readers


def test_obj_over_splits(spark, tmp_path):
    lines = ["# a comment", "mtllib x.mtl", "o first", "v 0 0 0", "v 1 0 0 # corner", "v 1 1 0", "v 0 1 0", "vt 0 0", "vt 1 0", "vt 1 1", "vn 0 0 1", "usemtl red", "f 1/1/1 2/2/1 3/3/1 4/1/1", "g second", "v 5 5 5", "f -1 -2 -3", "usemtl blue", "f 1//1 2//1 5//1", "l 1 2", "", "o first", "usemtl red", "f 1/1/1 3/3/1 4/1/1"]
    (tmp_path / "a.obj").write_bytes("\r\n".join(lines).encode())
    (tmp_path / "b.obj").write_text("v 0 0 0\nv 2 0 0\nv 0 2 0\nf 1 2 3\n" * 40)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60")
    try:
        told = meshes.obj_lines(spark, str(tmp_path))
        assert told.select("model", "at.block").distinct().count() > 10
        points = {(r.model[-5:], r.number): r.point for r in meshes.obj_points(told).collect()}
        faces = sorted((r.model[-5:], tuple(r["at"]), r.nth, [tuple(c) for c in r.corners]) for r in meshes.obj_faces(told).collect())
        got = {(r.model[-5:], r.name, r.material, r.primitive): (r.faces, r.vertices, list(r.lo), list(r.hi), r.has_uv, r.has_normals) for r in meshes.obj_meshes(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert points["a.obj", 4] == [5, 5, 5] and points["b.obj", 119] == [0, 2, 0] and len(points) == 5 + 120
    assert [f[3] for f in faces if f[0] == "a.obj"][:3] == [[(0, 0, 0), (1, 1, 0), (2, 2, 0)], [(0, 0, 0), (2, 2, 0), (3, 0, 0)], [(4, None, None), (3, None, None), (2, None, None)]]
    assert got == {
        ("a.obj", "first", "red", 3): (3, 4, [0, 0, 0], [1, 1, 0], True, True),
        ("a.obj", "second", "red", 3): (1, 3, [0, 1, 0], [5, 5, 5], False, False),
        ("a.obj", "second", "blue", 3): (1, 3, [0, 0, 0], [5, 5, 5], False, True),
        ("a.obj", "second", "blue", 2): (1, 2, [0, 0, 0], [1, 0, 0], False, False),
        ("b.obj", None, None, 3): (40, 3, [0, 0, 0], [2, 2, 0], False, False),
    }


def test_stl(spark, tmp_path):
    facets = [((0, 0, 1), (0, 0, 0, 1, 0, 0, 0, 1, 0)), ((0, 1, 0), (0, 0, 0, 0, 0, 1, 1, 0, 0.5))]
    (tmp_path / "b.stl").write_bytes(b"solid looks like text".ljust(80) + struct.pack("<I", 2) + b"".join(struct.pack("<12fH", *n, *c, 0) for n, c in facets))
    text = "solid x\n" + "".join("facet normal {} {} {}\n outer loop\n  vertex {} {} {}\n  vertex {} {} {}\n  vertex {} {} {}\n endloop\nendfacet\n".format(*n, *c) for n, c in facets) + "endsolid x\n"
    (tmp_path / "t.stl").write_text(text)
    (tmp_path / "none.stl").write_text("solid\nendsolid\n")
    got = sorted((r.model[-5:], r.facet, tuple(r.normal), tuple(r.corners)) for r in meshes.stl_facets(spark, str(tmp_path)).collect())
    assert got == [(m, k, n, c) for m in ("b.stl", "t.stl") for k, (n, c) in enumerate(facets)]


def test_chooser(spark, tmp_path):
    (tmp_path / "a.IFC").write_text("#1=A();")
    (tmp_path / "a.obj").write_text("v 0 0 0\nv 1 0 0\nv 0 1 0\nf 1 2 3\n")
    assert readers.open_model(spark, str(tmp_path / "a.IFC")).count() == 1
    assert readers.open_model(spark, str(tmp_path / "a.obj")).first().faces == 1
    assert ".bim" in readers.supported()
    with pytest.raises(ValueError, match="supported are .bim, .csv"):
        readers.open_model(spark, "x.dwg")
