"""Names, ids, typed metadata values, units and colours, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO_UUID = "00000000-0000-0000-0000-000000000000"
#: Metres in a unit.
METRES = {"m": 1.0, "mm": 0.001, "cm": 0.01, "dm": 0.1, "ft": 0.3048, "in": 0.0254}
#: Level of detail to (linear, angular) deflection.
LEVELS_OF_DETAIL = {0: (0.001, 0.5), 1: (1000.0, 1.0), 2: (0.5, 0.698132), 3: (0.1, 0.25), 4: (0.01, 0.174), 5: (0.005, 0.05), 6: (0.0005, 0.0174)}
#: Characters that names may not hold.
NAME_BAD, EXTENSION_BAD, DATABASE_BAD = " $.", " $", ' /\\.$*<>:?"|'


def _replaced(c: Column, bad: str) -> Column:
    return F.translate(c, bad, "_" * len(bad))


def sanitize_name(c: Column) -> Column:
    return _replaced(c, NAME_BAD)


def sanitize_extension(c: Column) -> Column:
    return _replaced(c, EXTENSION_BAD)


def sanitize_database(c: Column) -> Column:
    return _replaced(c, DATABASE_BAD)


def sanitize_key(c: Column) -> Column:
    """Metadata keys: `$` and `.` become `:`."""
    return F.translate(c, "$.", "::")


def guess_cast(c: Column) -> Column:
    """struct(tag, l, d, s): a long if the whole text is one, else a double, else the text."""
    whole = F.regexp_like(c, F.lit(r"^[+-]?[0-9]+$"))
    long = F.when(whole, c.try_cast("long"))
    number = F.regexp_like(c, F.lit(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"))
    double = F.when(number, c.try_cast("double"))
    tag = F.when(long.isNotNull(), "long").when(double.isNotNull(), "double").when(c.isNotNull(), "string")
    return F.struct(tag.alias("tag"), long.alias("l"), F.when(long.isNull(), double).alias("d"), F.when((tag == "string"), c).alias("s"))


def normalise_uuid(c: Column) -> Column:
    """Lower-case canonical form; empty is the zero id; other text gives a version-3-like id from its MD5."""
    low = F.lower(c)
    digest = F.md5(c.cast("binary"))
    cut = F.concat_ws("-", *(F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    return F.when(c == "", ZERO_UUID).when(F.regexp_like(low, F.lit(r"^[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}$")), low).otherwise(cut)


def scale_factor(source: Column, target: Column) -> Column:
    """Factor from one unit to another; 1 where either is unknown."""
    table = F.create_map(*(F.lit(x) for pair in METRES.items() for x in pair))
    return F.coalesce(F.try_element_at(table, source) / F.try_element_at(table, target), F.lit(1.0))


def level_of_detail(lod: Column) -> Column:
    """struct(linear, angular) deflection; unknown levels are level 0."""
    table = F.create_map(*(x for k, (a, b) in LEVELS_OF_DETAIL.items() for x in (F.lit(k), F.struct(F.lit(a).alias("linear"), F.lit(b).alias("angular")))))
    return F.coalesce(F.try_element_at(table, lod), F.element_at(table, F.lit(0)))


def pack_colour(r: Column, g: Column, b: Column) -> Column:
    """Three shares of 0 to 1 as 8-bit fields of one number, red lowest."""
    byte = lambda c: F.floor(c * 255).cast("long")
    return byte(r).bitwiseOR(F.shiftleft(byte(g), 8)).bitwiseOR(F.shiftleft(byte(b), 16))


def unpack_colour(c: Column) -> Column:
    return F.array(*(F.shiftright(c, s).bitwiseAND(F.lit(255)) / 255.0 for s in (0, 8, 16)))


def to_text(tag: Column, value: Column) -> Column:
    """Text of a tagged value (value given as text): booleans 0/1, doubles with six decimals, dates
    day first."""
    return (
        F.when(tag == "bool", F.when(value.cast("boolean"), "1").otherwise("0"))
        .when(tag == "double", F.format_string("%.6f", value.try_cast("double")))
        .when(tag == "date", F.date_format(value.try_cast("timestamp"), "dd-MM-yyyy HH-mm-ss"))
        .otherwise(value)
    )


def same_value(tag_a: Column, a: Column, tag_b: Column, b: Column) -> Column:
    """Equal only within one type."""
    return (tag_a == tag_b) & a.eqNullSafe(b)


def metadata_key(group: Column, key: Column, units: Column) -> Column:
    """`group::key (units)`; an empty key is `Value`; absent parts are left out."""
    name = F.when(F.coalesce(key, F.lit("")) == "", "Value").otherwise(key)
    with_units = F.when(F.coalesce(units, F.lit("")) == "", name).otherwise(F.concat(name, F.lit(" ("), units, F.lit(")")))
    return F.when(F.coalesce(group, F.lit("")) == "", with_units).otherwise(F.concat_ws("::", group, with_units))


def last_wins(keys: Column, values: Column) -> Column:
    """Entries of two arrays up to the shorter one; of a repeated key the last."""
    pairs = F.slice(F.arrays_zip(keys.alias("k"), values.alias("v")), 1, F.least(F.size(keys), F.size(values)))
    kept = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(kept)


def material_class(has_texture: Column, uv_channels: Column, opacity: Column) -> Column:
    return F.when(has_texture & (uv_channels > 0), "textured").when(opacity == 1, "opaque").otherwise("transparent")


def mesh_format(has_vertices: Column, has_faces: Column, has_normals: Column, uv_channels: Column, primitive: Column) -> Column:
    """Layout bits: vertices 0, faces 1, normals 2, uv channels from 8, primitive from 16."""
    bit = lambda c, n: F.when(c, F.lit(1 << n)).otherwise(F.lit(0))
    return (
        bit(has_vertices, 0).bitwiseOR(bit(has_faces, 1)).bitwiseOR(bit(has_normals, 2))
        .bitwiseOR(F.shiftleft(uv_channels.cast("int"), 8)).bitwiseOR(F.shiftleft(primitive.cast("int"), 16))
    )


def plane_angle(parts: Column) -> Column:
    """Degrees, minutes, seconds and millionths as text; only the degrees carry a sign."""
    whole = [parts[0].cast("string"), *(F.abs(parts[i]).cast("string") for i in (1, 2, 3))]
    return F.concat(whole[0], F.lit("\u00b0 "), whole[1], F.lit("' "), whole[2], F.lit('" '), whole[3])


def complex_number(re: Column, im: Column) -> Column:
    """Both parts with six decimals, each with its own sign."""
    return F.concat(F.format_string("%.6f", re), F.format_string("%+.6f", im), F.lit("i"))


#: Bytes of a vertex or normal, of a uv pair, of an index.
VECTOR_BYTES, UV_BYTES, INDEX_BYTES = 12, 8, 4


def mesh_bytes(vertices: Column, faces: Column, normals: Column, uv_channels: Column, primitive: Column) -> Column:
    """Estimated size of a mesh's arrays."""
    return faces * primitive * INDEX_BYTES + vertices * VECTOR_BYTES + normals * VECTOR_BYTES + uv_channels * vertices * UV_BYTES


def is_enabled(add_ons: Column, name: str) -> Column:
    """An add-on flag of a map, false where it is not there."""
    return F.coalesce(F.try_element_at(add_ons, F.lit(name)), F.lit(False))
