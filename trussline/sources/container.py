"""Gzipped binary scene containers: a JSON tree of nodes, materials and textures, and the bytes that its ranges point into.

A file is, once unzipped: six characters of version, a block of sizes whose length depends on the version, the JSON, and the data.
Gzip cannot be entered half way, so a file is one task, which unzips it once: the JSON is read a record at a time, of which
only the places of its ranges are kept (32 bytes each); ranges are read in the order of their start, a buffer of one range at a time.
Records and ranges leave the task as rows.  Everything after that (typed records, the tree's world
matrices, transformed vertices, the scene's offset) is joins and columns over all files.
"""

from __future__ import annotations

import codecs
import gzip
import io
import json
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import linear
from ..operators.graph import walk
from ..plans.scratch import materialize

#: Characters of the version, and bytes of the block of sizes by version number; the first eight are the JSON's size.
VERSION, SIZES = 6, {2: 56, 3: 72, 4: 72}
#: Bytes of rows that leave a task at once, and what a row takes besides its text and data.
FLUSH, ROW = 16 << 20, 1 << 10
#: Bytes of JSON that are read at once.
PIECE = 1 << 20
_SCHEMA = "model string, part string, id long, attribute string, start long, text string, data binary"
RANGES = ("vertices", "indices", "normals", "uv")
PARTS = ("nodes", "materials", "textures")
#: What a range is of, in the order in which ranges of one place are read.
_OF = (*(("node", name) for name in sorted(RANGES)), ("texture", "image"))


class Unzipped(io.RawIOBase):
    """The bytes of gzip members, unzipped as they are read."""

    def __init__(self, data: bytes):
        self.rest, self.open, self.ready = memoryview(data), zlib.decompressobj(31), memoryview(b"")

    def read(self, n: int) -> bytes:
        out = bytearray()
        while len(out) < n:
            if not self.ready:
                if not self.rest and not self.open.unconsumed_tail:
                    break
                if self.open.eof:  # the next member
                    self.rest, self.open = memoryview(self.open.unused_data + bytes(self.rest)), zlib.decompressobj(31)
                piece = self.open.unconsumed_tail
                if not piece:
                    piece, self.rest = bytes(self.rest[: 1 << 16]), self.rest[1 << 16 :]
                self.ready = memoryview(self.open.decompress(piece, 1 << 20))
                continue
            wanted = n - len(out)
            out += self.ready[:wanted]
            self.ready = self.ready[wanted:]
        return bytes(out)


def _pieces(stream: Unzipped, size: int) -> Iterator[str]:
    """The next `size` bytes as text."""
    coder = None
    while size > 0 and (data := stream.read(min(size, PIECE))):
        size -= len(data)
        coder = coder or codecs.getincrementaldecoder(json.detect_encoding(data))("surrogatepass")
        yield coder.decode(data, final=not size)


class _Json:
    """A JSON text that comes in pieces: values are taken off its start, and what is taken is let go."""

    def __init__(self, pieces: Iterable[str]):
        self.pieces, self.text, self.at, self.decoder = iter(pieces), "", 0, json.JSONDecoder()

    def more(self) -> bool:
        """At least as much again as is held, so that a value longer than a piece is tried a few times only."""
        held = [self.text[self.at :]]
        least, got = len(held[0]), 0
        while got <= least and (piece := next(self.pieces, None)) is not None:
            held.append(piece)
            got += len(piece)
        self.text, self.at = "".join(held), 0
        return got > 0

    def peek(self) -> str:
        """The next character that is not blank, or "" at the end."""
        while True:
            while self.at < len(self.text) and self.text[self.at] in " \t\r\n":
                self.at += 1
            if self.at < len(self.text) or not self.more():
                return self.text[self.at : self.at + 1]

    def take(self, wanted: str) -> str:
        c = self.peek()
        if not c or c not in wanted:
            raise ValueError(f"JSON: {c!r} in place of one of {wanted!r}")
        self.at += 1
        return c

    def value(self):
        self.peek()
        while True:
            try:
                found, end = self.decoder.raw_decode(self.text, self.at)
                if end < len(self.text):
                    self.at = end
                    return found
                if not self.more():  # else a number may go on
                    self.at = len(self.text)
                    return found
            except json.JSONDecodeError:
                if not self.more():
                    raise

    def items(self, close: str) -> Iterator[None]:
        """Stops before each item of an array or object that is open."""
        if self.peek() == close:
            self.at += 1
            return
        while True:
            yield
            if self.take("," + close) == close:
                return


def members(pieces: Iterable[str]) -> Iterator[tuple[str, int, dict]]:
    """(part, place, record) of the nodes, materials and textures of a tree, as its text comes."""
    text = _Json(pieces)
    text.take("{")
    for _ in text.items("}"):
        name = text.value()
        text.take(":")
        if name not in PARTS:
            text.value()
            continue
        text.take("[")
        for place, _ in enumerate(text.items("]")):
            yield name[:-1], place, text.value()
    if text.peek():
        raise ValueError("JSON: there is more after its end")


def _ranges(part: str, record: dict) -> Iterator[tuple[int, int, int, int]]:
    """(start, end, id, place in _OF) of what a record points at."""
    for k, (of, name) in enumerate(_OF):
        if of == part:
            low, high = (record.get("imageBytes") if of == "texture" else (record.get("geometry") or {}).get(name)) or (0, 0)
            if high > low:
                yield low, high, record["id"], k


def rows(model: str, content: bytes):
    """The records of one file: of its JSON first, then its ranges as the data comes."""
    stream = Unzipped(content)
    version = stream.read(VERSION).decode("ascii", "replace")
    number = version[3:]
    if version[:3] != "BIM" or not number.isdigit() or int(number) not in SIZES:
        raise ValueError(f"{model}: version {version!r} is not read")
    (size,) = struct.unpack_from("<q", stream.read(SIZES[int(number)]))
    found = array("q")
    for part, place, record in members(_pieces(stream, size)):
        for own in _ranges(part, record):
            found.extend(own)
        yield model, part, record.get("id", place), None, place, json.dumps(record), None
    places = np.frombuffer(found, np.int64).reshape(-1, 4)
    image = places[:, 3] == len(RANGES)
    at, held = 0, b""  # bytes read of the data, and those of them that later ranges may share
    for k in np.lexsort((places[:, 3], places[:, 2], image, places[:, 1], places[:, 0])):
        low, high, id_, of = places[k].tolist()
        part, name = _OF[of]
        skip = low - at
        while skip > 0 and (gone := stream.read(min(skip, 1 << 20))):
            skip -= len(gone)
            at, held = at + len(gone), b""
        held = held[len(held) - (at - low) :] if at > low else b""
        more = stream.read(max(0, high - at))
        held, at = held + more, at + len(more)
        data = held[: high - low]
        if len(data) < high - low:
            raise ValueError(f"{model}: the data ends within {name} of {part} {id_}")
        yield model, part, id_, name, low, None, data


def packed(tree: dict | bytes, data: bytes, version: int = 4) -> bytes:
    """A container of this tree, or its JSON, and data."""
    text = tree if isinstance(tree, bytes) else json.dumps(tree).encode()
    sizes = struct.pack("<qq", len(text), len(data)).ljust(SIZES[version], b"\0")
    return gzip.compress(b"BIM%03d" % version + sizes + text + data, 1, mtime=0)


def records(spark: SparkSession, path: str) -> DataFrame:
    """`unpacked` of the containers at `path`."""
    return unpacked(spark.read.format("binaryFile").load(path).select("path", "content"))


def unpacked(files: DataFrame) -> DataFrame:
    """(model, part, id, attribute, start, text, data) of containers (path, content): a row of JSON a node, material and texture, and
    a row a range, whose start is its place in the data; the start of the others is their place among their like."""

    def batches(it):
        schema = pa.schema([("model", pa.string()), ("part", pa.string()), ("id", pa.int64()), ("attribute", pa.string()), ("start", pa.int64()), ("text", pa.string()), ("data", pa.binary())])
        out, size = [], 0
        for batch in it:
            for model, content in zip(*batch.columns[:2], strict=True):
                for row in rows(model.as_py(), content.as_buffer()):  # no copy of the other files' contents
                    out.append(row)
                    size += ROW + len(row[5] or "") + len(row[6] or b"")
                    if size > FLUSH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                        out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return materialize(files.mapInArrow(batches, _SCHEMA))


_NODE = "id long, parent long, name string, transformation array<double>, metadata map<string,string>, geometry struct<primitive:int,numIndices:long,numVertices:long,material:long>"
_MATERIAL = "diffuse array<double>, ambient array<double>, specular array<double>, emissive array<double>, transparency double, shininess double, lineWeight double, texture long"
_TEXTURE = "id long, filename string, width int, height int, imageBytes array<long>"


def nodes(found: DataFrame) -> DataFrame:
    """(model, id, parent, name, matrix, metadata, primitive, material, has_geometry); metadata keys lose the character that tells
    their type; triangles are the default."""
    n = F.from_json("text", _NODE)
    told = found.where("part = 'node' and text is not null").select("model", "start", n.alias("n"))
    matrix = F.when(F.size("n.transformation") == 16, F.col("n.transformation")).otherwise(linear.matrix(linear.IDENTITY))
    keys = F.transform_keys(F.coalesce("n.metadata", F.create_map().cast("map<string,string>")), lambda k, _: F.substr(k, F.lit(2)))
    has = F.col("n.geometry").isNotNull()
    return told.select("model", "n.id", F.when(F.col("n.parent") >= 0, F.col("n.parent")).alias("parent"), F.coalesce("n.name", F.lit("")).alias("name"), matrix.alias("matrix"), keys.alias("metadata"), F.when(has, F.coalesce("n.geometry.primitive", F.lit(3))).alias("primitive"), F.col("n.geometry.material").alias("material"), has.alias("has_geometry"))


def materials(found: DataFrame) -> DataFrame:
    """(model, material, diffuse, ..., opacity, shininess, texture); materials are known by their place in the file."""
    m = F.from_json("text", _MATERIAL)
    told = found.where("part = 'material' and text is not null").select("model", F.col("start").alias("material"), m.alias("m"))
    own = [F.col(f"m.{c}").alias(c) for c in ("diffuse", "ambient", "specular", "emissive")]
    opacity, shine = 1 - F.coalesce("m.transparency", F.lit(0.0)), F.col("m.shininess") * 5
    return told.select("model", "material", *own, opacity.alias("opacity"), shine.alias("shininess"), F.col("m.lineWeight").alias("line_weight"), F.nullif(F.col("m.texture"), F.lit(-1)).alias("texture"))


def textures(found: DataFrame) -> DataFrame:
    """(model, texture, filename, width, height, image); one without bytes or size is missing (image null)."""
    t = F.from_json("text", _TEXTURE)
    told = found.where("part = 'texture' and text is not null").select("model", t.alias("t"))
    images = found.where("part = 'texture' and attribute = 'image'").select("model", F.col("id").alias("texture"), "data")
    named = told.select("model", F.col("t.id").alias("texture"), "t.filename", "t.width", "t.height")
    good = (F.col("width") > 0) & (F.col("height") > 0)
    return named.join(images, ["model", "texture"], "left").select("model", "texture", "filename", "width", "height", F.when(good, F.col("data")).alias("image"))


def worlds(scene: DataFrame) -> DataFrame:
    """(model, id, entity, world) of `nodes`: a node's world matrix, and the nearest node at or above it that is kept as a transformation.

    A node without name and transformation is none: what is below it belongs to its parent.  The first node is one in any case.
    """
    step = materialize(scene.select("model", "id", "parent", "matrix", ((F.col("name") != "") | ~linear.is_identity(F.col("matrix")) | F.col("parent").isNull()).alias("own")))
    start = step.where("parent is null").select("model", "id", F.col("id").alias("entity"), F.col("matrix").alias("world"))
    below = step.where("parent is not null")
    return walk(start, lambda f: f.withColumnRenamed("id", "parent").join(below, ["model", "parent"]).select("model", "id", F.when(F.col("own"), F.col("id")).otherwise(F.col("entity")).alias("entity"), linear.multiply(F.col("world"), F.col("matrix")).alias("world")))


def numbers(data: Column, kind: str) -> Column:
    """Little-endian numbers of a range: doubles ("d"), floats ("f") or unsigned 32-bit integers ("I"), as an array."""
    import numpy as np
    import pandas as pd

    dtype = {"d": "<f8", "f": "<f4", "I": "<u4"}[kind]
    out = "array<bigint>" if kind == "I" else "array<double>"

    def decode(col: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else np.frombuffer(b, dtype).astype("i8" if kind == "I" else "f8") for b in col])

    decode.__annotations__ = {"col": pd.Series, "return": pd.Series}
    return F.pandas_udf(decode, out)(data)


def triples(flat: Column, size: int = 3) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(flat), F.lit(size)), lambda k: F.slice(flat, k, size))


def meshes(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The meshes of the containers, and the offset of each (model, offset): the least corner of all its vertices.

    A mesh has model, id, entity, material, primitive, vertices (in the world, less the offset), normals (turned and of unit length), uv, faces.
    """
    scene = materialize(nodes(found))
    by = found.where("part = 'node' and attribute is not null").groupBy("model", "id").agg(*(F.max(F.when(F.col("attribute") == a, F.col("data"))).alias(a) for a in RANGES))
    placed = scene.where("has_geometry").join(by, ["model", "id"]).join(worlds(scene), ["model", "id"])
    w = F.col("world")
    g = lambda k: F.get(w, F.lit(k))
    point = lambda v: F.array(*(g(4 * r) * v[0] + g(4 * r + 1) * v[1] + g(4 * r + 2) * v[2] + g(4 * r + 3) for r in range(3)))
    turned = linear.inverse(w)
    t = lambda k: F.get("_turn", F.lit(k))

    def normal(v: Column) -> Column:
        along = F.array(*(t(r) * v[0] + t(4 + r) * v[1] + t(8 + r) * v[2] for r in range(3)))  # by the transpose of the inverse
        length = lambda a: F.sqrt(a[0] * a[0] + a[1] * a[1] + a[2] * a[2])
        return F.transform(along, lambda x: x / length(along))

    read = materialize(placed.select("model", "id", "entity", "material", "primitive", w.alias("world"), turned.alias("_turn"), numbers(F.col("vertices"), "d").alias("v"), numbers(F.col("normals"), "f").alias("n"), numbers(F.col("uv"), "f").alias("u"), numbers(F.col("indices"), "I").alias("i")))
    world = materialize(read.select("model", "id", "entity", "material", "primitive", "i", F.transform(triples(F.col("v")), point).alias("vertices"), F.transform(triples(F.col("n")), normal).alias("normals"), triples(F.col("u"), 2).alias("uv")))
    corners = world.select("model", F.transform(F.sequence(F.lit(0), F.lit(2)), lambda c: F.array_min(F.transform("vertices", lambda v: F.get(v, c)))).alias("low"))
    offset = materialize(corners.groupBy("model").agg(F.array(*(F.min(F.get("low", F.lit(k))) for k in range(3))).alias("offset")))
    moved = F.transform("vertices", lambda v: F.zip_with(v, "offset", lambda a, b: (a - b).cast("float")))
    faces = F.transform(F.sequence(F.lit(1), F.size("i"), F.col("primitive")), lambda k: F.slice("i", k, F.col("primitive")))
    return world.join(offset, "model").select("model", "id", "entity", "material", "primitive", moved.alias("vertices"), "normals", "uv", faces.alias("faces")), offset
