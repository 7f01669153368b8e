"""Documents with optional fields: getters, merging, equality, XML leaves, error documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def required(df: DataFrame, name: str, kind: str) -> Column:
    """The field, or an error where it is missing; an int passes as a long, nothing else is cast."""
    found = dict(df.dtypes).get(name)
    if found is None or (found != kind and (found, kind) != ("int", "bigint")):
        raise TypeError(f"{name} is {found}, not {kind}")
    return F.when(F.col(name).isNull(), F.raise_error(f"no field {name}").cast(kind)).otherwise(F.col(name).cast(kind))


def array_or_empty(name: str, element: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast(f"array<{element}>"))


def field_names(df: DataFrame) -> Column:
    """Names of the fields a row has, sorted."""
    present = F.array(*(F.when(F.col(c).isNotNull(), F.lit(c)) for c in sorted(df.columns)))
    return F.filter(present, lambda c: c.isNotNull())


def is_empty(df: DataFrame) -> Column:
    return F.size(field_names(df)) == 0


def merged(a: Column, b: Column, unique: bool = False) -> Column:
    """Map a with the entries of b; of a key in both b's value, or with `unique` a's."""
    keep, add = (a, b) if unique else (b, a)
    rest = F.map_filter(add, lambda k, v: ~F.map_contains_key(keep, k))
    return F.map_concat(keep, rest)


#: Fields that make two nodes of a type the same, whatever their ids.
SEMANTIC = {
    "transformation": ("matrix",),
    "mesh": ("grouping", "primitive", "bounding_box", "faces", "vertices", "normals", "uv_channels"),
    "material": ("checksum", "n_parents"),
    "meta": ("metadata",),
    "texture": ("data",),
    "revision": ("author", "desc", "tag", "timestamp"),
}


def same_node(df: DataFrame, other: DataFrame, kind: str, a: str = "a", b: str = "b") -> Column:
    """Null-safe equality of the semantic fields of two tables (aliased a and b); a field that a table lacks is null in it."""
    same = F.lit(True)
    for c in SEMANTIC[kind]:
        sides = [F.col(f"{name}.{c}") for name, table in ((a, df), (b, other)) if c in table.columns]
        if sides:
            same = same & sides[0].eqNullSafe(sides[1] if len(sides) == 2 else F.lit(None))
    return same


def material_checksum(columns: list[str]) -> Column:
    """Content key of a material: equal contents, equal keys."""
    return F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns))


def xml_leaves(xml: Column, paths: dict[str, str]) -> Column:
    """[{key, value}] of the XPath texts that are there."""
    found = [F.struct(F.lit(k).alias("key"), F.get(F.xpath(xml, F.lit(p + "/text()")), F.lit(0)).alias("value")) for k, p in sorted(paths.items())]
    return F.filter(F.array(*found), lambda e: e["value"].isNotNull())


def error_json(kind: Column, **fields: Column) -> Column:
    return F.to_json(F.struct(kind.alias("type"), *(c.alias(n) for n, c in sorted(fields.items()))))


REVISION = T.StructType(
    [
        T.StructField("_id", T.StringType()), T.StructField("branch", T.StringType()), T.StructField("author", T.StringType()), T.StructField("timestamp", T.TimestampType()),
        T.StructField("offset", T.ArrayType(T.DoubleType())), T.StructField("files", T.ArrayType(T.StringType())), T.StructField("desc", T.StringType()), T.StructField("tag", T.StringType()),
        T.StructField("incomplete", T.IntegerType()), T.StructField("parents", T.ArrayType(T.StringType())),
    ]
)
