"""Readers: raw metadata CSV, text meshes, clash configurations, blob ranges, files by extension."""

from __future__ import annotations

import gzip

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import guess_cast

#: Extension to reader name; formats that need a proprietary kit are not read here.
READERS = {".csv": "csv_metadata", ".obj": "obj_mesh", ".ply": "ply_mesh", ".json": "clash_config", ".ifc": "ifc", ".stl": "stl_facets", ".bim": "container"}


def reader_for(path: str) -> str | None:
    dot = path.rfind(".")
    return READERS.get(path[dot:].lower()) if dot >= 0 else None


def supported() -> list[str]:
    """The extensions that are read."""
    return sorted(READERS)


def open_model(spark: SparkSession, path: str) -> DataFrame:
    """What the reader of the path's extension gives; another extension raises."""
    from . import container, ifc, meshes

    name = reader_for(path)
    if name is None:
        raise ValueError(f"{path} is not read; supported are {', '.join(supported())}")
    readers = {"csv_metadata": csv_metadata, "obj_mesh": meshes.obj_meshes, "ply_mesh": ply_mesh, "clash_config": clash_config, "ifc": ifc.read, "stl_facets": meshes.stl_facets, "container": container.records}
    return readers[name](spark, path)


def csv_metadata(spark: SparkSession, path: str, delimiter: str = ",", headers: list[str] | None = None) -> DataFrame:
    """One row a line: name (token 0) and metadata [{key, tag, value}], typed by `guess_cast`.

    Lines are split as they are: no quoting, no escapes; a trailing empty field is not a field.
    Without `headers` the file's first line gives them.
    """
    lines = spark.read.option("wholetext", False).text(path).withColumn("_file", F.input_file_name())
    split = F.split("value", "\\Q" + delimiter + "\\E", -1)
    tokens = lines.select("_file", F.monotonically_increasing_id().alias("_n"), F.when(F.element_at(split, -1) == "", F.slice(split, 1, F.size(split) - 1)).otherwise(split).alias("t"))
    if headers is None:
        firsts = tokens.groupBy("_file").agg(F.min("_n").alias("_first"), F.min_by("t", "_n").alias("h"))
        tokens = tokens.join(F.broadcast(firsts), "_file").where("_n > _first")
    else:
        tokens = tokens.withColumn("h", F.array(*map(F.lit, headers)))
    pairs = F.slice(F.arrays_zip(F.col("h").alias("key"), F.col("t").alias("raw")), 1, F.least(F.size("h"), F.size("t")))
    typed = F.transform(pairs, lambda p: F.struct(p["key"].alias("key"), guess_cast(p["raw"])["tag"].alias("tag"), p["raw"].alias("value")))
    return tokens.where(F.size("t") > 0).select(F.element_at("t", 1).alias("name"), typed.alias("metadata"))


MESH = T.StructType([T.StructField("name", T.StringType()), T.StructField("vertices", T.ArrayType(T.ArrayType(T.DoubleType()))), T.StructField("faces", T.ArrayType(T.ArrayType(T.IntegerType())))])


def obj_mesh(spark: SparkSession, path: str) -> DataFrame:
    """Wavefront OBJ: one row a file; faces are fan-triangulated, indices from 0."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("name"), F.split("value", r"\r?\n").alias("l"))
    rows = F.transform("l", lambda x: F.split(F.trim(x), r"\s+"))
    vertices = F.transform(F.filter(rows, lambda t: t[0] == "v"), lambda t: F.transform(F.slice(t, 2, 3), lambda x: x.cast("double")))
    n = F.size(F.filter(rows, lambda t: t[0] == "v"))
    corner = lambda x: F.when(F.split(x, "/")[0].cast("int") > 0, F.split(x, "/")[0].cast("int") - 1).otherwise(n + F.split(x, "/")[0].cast("int"))
    polygons = F.transform(F.filter(rows, lambda t: t[0] == "f"), lambda t: F.transform(F.slice(t, 2, F.size(t) - 1), corner))
    fans = F.flatten(F.transform(polygons, lambda p: F.transform(F.sequence(F.lit(1), F.size(p) - 2), lambda i: F.array(p[0], F.get(p, i), F.get(p, i + 1)))))
    return files.select("name", vertices.alias("vertices"), fans.alias("faces"))


def ply_mesh(spark: SparkSession, path: str) -> DataFrame:
    """ASCII PLY with x y z first and polygon lists: one row a file."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("name"), F.split("value", r"\r?\n").alias("l"))
    count = lambda what: F.regexp_extract(F.array_join(F.slice("l", 1, F.array_position("l", "end_header").cast("int")), "\n"), rf"element {what} (\d+)", 1).cast("int")
    at = F.array_position("l", "end_header").cast("int")
    numbers = lambda x, kind: F.transform(F.split(F.trim(x), r"\s+"), lambda v: v.cast(kind))
    vertices = F.transform(F.slice("l", at + 1, count("vertex")), lambda x: F.slice(numbers(x, "double"), 1, 3))
    polygons = F.transform(F.slice("l", at + 1 + count("vertex"), count("face")), lambda x: F.slice(numbers(x, "int"), 2, F.size(numbers(x, "int")) - 1))
    fans = F.flatten(F.transform(polygons, lambda p: F.transform(F.sequence(F.lit(1), F.size(p) - 2), lambda i: F.array(p[0], F.get(p, i), F.get(p, i + 1)))))
    return files.select("name", vertices.alias("vertices"), fans.alias("faces"))


_OBJECTS = "array<struct<teamspace:string,container:string,revision:string,objects:array<struct<id:string,meshIds:array<string>>>>>"
CLASH_CONFIG = f"type string, tolerance double, numThreads int, selfIntersectsA boolean, selfIntersectsB boolean, resultsFile string, setA {_OBJECTS}, setB {_OBJECTS}"


def clash_config(spark: SparkSession, path: str) -> DataFrame:
    """The configuration's composites: set_name, teamspace, container, revision, id, mesh_ids; meshes
    of an id that occurs more than once are merged."""
    cfg = spark.read.schema(CLASH_CONFIG).json(path, multiLine=True)
    sides = [cfg.select(F.lit(s).alias("set_name"), F.explode(f"set{s}").alias("c")) for s in "AB"]
    each = sides[0].union(sides[1]).select("set_name", "c.teamspace", "c.container", "c.revision", F.explode("c.objects").alias("o"))
    return each.groupBy("set_name", "teamspace", "container", "revision", F.col("o.id").alias("id")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("o.meshIds")))).alias("mesh_ids"))


def resolve_ranges(nodes: DataFrame, blobs: DataFrame) -> DataFrame:
    """Joins each row's range (ref.name, ref.start, ref.size) to its blob file and cuts the bytes out."""
    files = blobs.select(F.element_at(F.split("path", "/"), -1).alias("_blob"), "content")
    return nodes.join(files, nodes["ref.name"] == files["_blob"]).withColumn("data", F.substring("content", F.col("ref.start").cast("int") + 1, F.col("ref.size").cast("int"))).drop("content", "_blob")


def pack_blobs(df: DataFrame, size: str, key: str, limit: int = 104_857_600) -> DataFrame:
    """`df` with ref {name, start, size}: blobs of about `limit` bytes, filled in hash-range order.

    Rows are packed within `pmod(hash, shards)` groups, so no single task orders the collection.
    """
    from pyspark.sql import Window

    total = df.agg(F.sum(size)).first()[0] or 0
    shards = max(1, -(-total // (8 * limit)))
    part = F.pmod(F.xxhash64(key), F.lit(shards))
    w = Window.partitionBy("_part").orderBy(key)
    before = F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = df.withColumn("_part", part).withColumn("_before", before).withColumn("_file", F.expr(f"_before div {limit}"))
    start = F.col("_before") - F.min("_before").over(Window.partitionBy("_part", "_file"))
    return placed.withColumn("ref", F.struct(F.concat_ws("-", F.lit("blob"), F.col("_part"), F.col("_file")).alias("name"), start.alias("start"), F.col(size).alias("size"))).drop("_part", "_before", "_file")


@F.udf(returnType=T.BinaryType(), useArrow=True)
def gunzip(data: bytes) -> bytes:
    return None if data is None else gzip.decompress(data)


@F.udf(returnType=T.BinaryType(), useArrow=True)
def gzipped(data: bytes) -> bytes:
    return None if data is None else gzip.compress(data, mtime=0)


def load_files(refs: DataFrame, blobs: DataFrame, gzip_encoded: bool = False) -> DataFrame:
    """References (_id, link) with their bytes; a reference without a file raises."""
    files = blobs.select(F.element_at(F.split("path", "/"), -1).alias("_link"), F.col("content"))
    found = refs.join(files, refs["link"] == files["_link"], "left")
    data: Column = F.when(F.col("_link").isNull(), F.raise_error(F.concat(F.lit("no file for reference "), F.col("_id")))).otherwise(F.col("content"))
    out = found.withColumn("data", data).drop("content", "_link")
    return out.withColumn("data", gunzip("data")) if gzip_encoded else out
