"""Text and binary meshes as tables: OBJ lines numbered over file splits, with groups, materials, normals and uv; STL facets.

A Wavefront file is read line by line in splits.  Which vertex a line defines, and which group and material a face is of, are
running counts over the lines before it, so no file is one row or one task, whatever its size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.partition import running
from ..plans.scratch import materialize


def obj_lines(spark: SparkSession, path: str) -> DataFrame:
    """(model, at, kind, tokens, v, vt, vn, change): the lines of OBJ files that say something, in the order of `at`; v, vt and vn count the
    definitions before a line, change the lines before it and with it that name an object, group or material."""
    meta = lambda c: F.col(f"_metadata.{c}")
    raw = spark.read.text(path).select(meta("file_path").alias("model"), meta("file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), F.split(F.trim(F.regexp_replace("value", r"#.*|[\r\t]", " ")), " +").alias("t"))
    kinds = ["v", "vt", "vn", "f", "l", "p", "g", "o", "usemtl"]
    told = materialize(raw.withColumn("kind", F.element_at("t", 1)).where(F.col("kind").isin(kinds)))
    one = lambda *k: F.when(F.col("kind").isin(*k), 1).otherwise(0)
    counted = running(told, ["model"], ["block", "n"], {"v": one("v"), "vt": one("vt"), "vn": one("vn"), "change": one("g", "o", "usemtl")})
    return materialize(counted.select("model", F.struct("block", "n").alias("at"), "kind", F.slice("t", F.lit(2), F.size("t")).alias("tokens"), "v", "vt", "vn", (F.col("change") + one("g", "o", "usemtl")).alias("change")))


def _numbers(size: int) -> Column:
    return F.transform(F.slice("tokens", 1, size), lambda x: x.try_cast("double"))


def obj_points(lines: DataFrame, kind: str = "v") -> DataFrame:
    """(model, number, point): the vertices ("v"), uv ("vt") or normals ("vn") of `obj_lines`, numbered from 0 in their file."""
    return lines.where(F.col("kind") == kind).select("model", F.col(kind).alias("number"), _numbers(2 if kind == "vt" else 3).alias("point"))


def obj_groups(lines: DataFrame) -> DataFrame:
    """(model, change, name, material): what holds after each change; before the first, change 0 has neither."""
    named = lines.where(F.col("kind").isin("g", "o", "usemtl"))
    text = F.array_join("tokens", " ")
    rows = named.select("model", "change", F.when(F.col("kind") != "usemtl", text).alias("_name"), F.when(F.col("kind") == "usemtl", text).alias("_material"))
    so_far = Window.partitionBy("model").orderBy("change")  # a row a change
    told = rows.select("model", "change", F.last("_name", ignorenulls=True).over(so_far).alias("name"), F.last("_material", ignorenulls=True).over(so_far).alias("material"))
    none = F.lit(None).cast("string")
    return told.union(lines.select("model").distinct().select("model", F.lit(0).cast("long"), none, none))


def obj_faces(lines: DataFrame) -> DataFrame:
    """(model, change, at, nth, corners): faces as fans of triangles, lines and points as they are; corners are structs of numbers v, vt and vn,
    as `obj_points` has them (vt and vn null where a corner has none).  Negative numbers count back from the line."""

    def corner(text: Column) -> Column:
        part = F.split(text, "/")

        def number(k: int, c: str) -> Column:
            x = F.get(part, F.lit(k)).try_cast("long")
            return F.when(x > 0, x - 1).when(x < 0, F.col(c) + x)

        return F.struct(number(0, "v").alias("v"), number(1, "vt").alias("vt"), number(2, "vn").alias("vn"))

    told = lines.where(F.col("kind").isin("f", "l", "p")).select("model", "change", "at", "kind", F.transform("tokens", corner).alias("c"))
    fan = F.transform(F.sequence(F.lit(1), F.size("c") - 2), lambda i: F.array(F.get("c", F.lit(0)), F.get("c", i), F.get("c", i + 1)))
    parts = F.when((F.col("kind") == "f") & (F.size("c") >= 3), fan).otherwise(F.array("c"))
    return told.select("model", "change", "at", F.posexplode(parts).alias("nth", "corners"))


def obj_meshes(spark: SparkSession, path: str) -> DataFrame:
    """One row a group of a file that has faces: (model, name, material, primitive, faces, vertices, lo, hi, has_uv, has_normals).

    A group is what has one name, material and number of corners; vertices counts the different ones.
    """
    lines = obj_lines(spark, path)
    faces = obj_faces(lines).join(obj_groups(lines), ["model", "change"])
    by = ["model", "name", "material", "primitive"]
    each = faces.withColumn("primitive", F.size("corners"))
    sizes = each.groupBy(*by).agg(F.count("*").alias("faces"), F.every(F.forall("corners", lambda c: c["vt"].isNotNull())).alias("has_uv"), F.every(F.forall("corners", lambda c: c["vn"].isNotNull())).alias("has_normals"))
    used = each.select(*by, F.explode("corners.v").alias("number")).distinct()
    points = obj_points(lines).select(F.col("model").alias("_of"), F.col("number").alias("_no"), "point")
    placed = used.join(points, (F.col("model") == F.col("_of")) & (F.col("number") == F.col("_no")))
    low, high = (F.array(*(f(F.get("point", F.lit(k))) for k in range(3))) for f in (F.min, F.max))
    bounds = placed.groupBy(*by).agg(F.count("*").alias("vertices"), low.alias("lo"), high.alias("hi"))
    same = None
    for c in by:
        term = F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}"))
        same = term if same is None else same & term
    return sizes.alias("r").join(bounds.alias("o"), same).select(*(F.col(f"r.{c}") for c in (*by, "faces")), "o.vertices", "o.lo", "o.hi", "r.has_uv", "r.has_normals")


_FACET = np.dtype([("normal", "<f4", 3), ("corners", "<f4", 9), ("attribute", "<u2")])
#: Facets that leave a task at once.
FACETS = 100_000


def stl_facets(spark: SparkSession, path: str) -> DataFrame:
    """(model, facet, normal, corners) of STL files: binary ones, told by their length, and text."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def text(content: bytes):
        words = content.split()
        at = [k for k, w in enumerate(words) if w.lower() == b"facet" and words[k - 1].lower() != b"end"]
        for k in at:
            take = [float(x) for x in words[k + 2 : k + 5]]
            corners = [float(x) for j in range(3) for x in words[k + 8 + 4 * j : k + 11 + 4 * j]]
            yield take, corners

    def batches(it):
        for batch in it:
            for model, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                count = int.from_bytes(content[80:84], "little") if len(content) >= 84 else -1
                if len(content) == 84 + 50 * count:
                    rows = np.frombuffer(content, _FACET, count, 84)
                    normals, corners = rows["normal"], rows["corners"]
                else:
                    found = list(text(content))
                    normals, corners = (np.array([f[k] for f in found], float).reshape(-1, 3 if k == 0 else 9) for k in (0, 1))
                for low in range(0, len(normals), FACETS):
                    part = slice(low, low + FACETS)
                    n = len(normals[part])
                    lists = [pa.FixedSizeListArray.from_arrays(pa.array(x[part].astype("f8").ravel()), w).cast(pa.list_(pa.float64())) for x, w in ((normals, 3), (corners, 9))]
                    yield pa.RecordBatch.from_arrays([pa.array([model] * n), pa.array(np.arange(low, low + n)), *lists], names=["model", "facet", "normal", "corners"])

    return files.mapInArrow(batches, "model string, facet long, normal array<double>, corners array<double>")
