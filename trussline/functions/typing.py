"""Typed values of other tools' properties: a source's kind of value to a tag and text, as columns.

Each rule gives struct(tag, value), null where the kind is not carried over.  Tags: bool, int, long, double, string, datetime.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NONE = "struct<tag:string,value:string>"


def _tagged(tag: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.struct(F.lit(tag).alias("tag"), value.cast("string").alias("value")))


def _chosen(kind: Column, rules: dict[str, Column]) -> Column:
    out = F.lit(None).cast(_NONE)
    for name, rule in rules.items():
        out = F.when(kind == name, rule).otherwise(out)
    return out


def file_name(key: Column, value: Column, keys: list[str]) -> Column:
    """For `keys`, whose values are paths, the part after the last slash; other values as they are."""
    return F.when(key.isin(keys), F.regexp_extract(value, r"([^/\\]*)$", 1)).otherwise(value)


def parameter_value(kind: Column, raw: Column, yes_no: Column, name: Column) -> Column:
    """Parameters with integers of several widths: 8 and 16 bits are int, 32 and 64 long, but 32-bit yes/no is a
    bool; an object is its name or, without one, its handle (`raw`)."""
    whole = raw.try_cast("long")
    return _chosen(kind, {
        "string": _tagged("string", raw), "bool": _tagged("bool", raw.try_cast("boolean")), "int8": _tagged("int", whole), "int16": _tagged("int", whole),
        "int32": F.when(yes_no, _tagged("bool", whole != 0)).otherwise(_tagged("long", whole)), "int64": _tagged("long", whole),
        "double": _tagged("double", raw.try_cast("double")), "object": _tagged("string", F.coalesce(F.nullif(name, F.lit("")), raw)),
    })


def property_value(kind: Column, key: Column, raw: Column, point: Column, paths: list[str]) -> Column:
    """Properties with measures, dates in seconds since 1970 and points (arrays of two or three doubles)."""
    at = lambda k: F.get(point, F.lit(k))
    number, text = _tagged("double", raw.try_cast("double")), _tagged("string", file_name(key, raw, paths))
    rules = dict.fromkeys(("double", "length", "angle", "area", "volume"), number) | dict.fromkeys(("display_string", "identifier_string"), text)
    return _chosen(kind, rules | {
        "int32": _tagged("long", raw.try_cast("long")), "bool": _tagged("bool", raw.try_cast("boolean")), "name": _tagged("string", raw),
        "datetime": _tagged("datetime", F.date_format(F.timestamp_seconds(raw.try_cast("long")), "yyyy-MM-dd HH:mm:ss")),
        "point2d": _tagged("string", F.format_string("%.6f, %.6f", at(0), at(1))), "point3d": _tagged("string", F.format_string("%.6f, %.6f, %.6f", at(0), at(1), at(2))),
    })


def mesh_property(kind: Column, key: Column, raw: Column) -> Column:
    """Properties of mesh files: 64 unsigned bits are long, floats double, vectors text; a string equal to its key says nothing."""
    whole = raw.try_cast("long")
    return _chosen(kind, {
        "bool": _tagged("bool", raw.try_cast("boolean")), "int32": _tagged("int", whole), "uint64": _tagged("long", whole), "float": _tagged("double", raw.try_cast("float").cast("double")),
        "double": _tagged("double", raw.try_cast("double")), "vector": _tagged("string", raw), "string": F.when(raw != key, _tagged("string", raw)),
    })
