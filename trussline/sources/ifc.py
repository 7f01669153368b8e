"""Building models as STEP text (ISO 10303-21): statements, typed values, tree, properties, units, locations.

A file is its statements (`#id = TYPE(arguments);`), one a row after `read`; everything else is
joins over entities (model, id, type, args, values).  Geometry is not evaluated: that takes a CAD kernel.

`read` takes a file in splits.  Pieces between semicolons are Spark's records; a semicolon within a string or a comment
ends no statement, and whether a piece begins in one depends on all before it.  So each piece is told for three cases: that its split
began in plain text, in a string, or in a comment.  What a split makes of each case is one row; put together in order they
tell every split's case.  Statements are then numbered by a running count, and pieces of one number are joined.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.partition import running
from ..plans.scratch import materialize

#: Schemas that are read; others are refused.
SCHEMAS = ("IFC2X3", "IFC4", "IFC4X1", "IFC4X2", "IFC4X3", "IFC4X3_TC1", "IFC4X3_ADD1", "IFC4X3_ADD2", "IFC2X3_TC1", "IFC4_ADD1", "IFC4_ADD2")
#: Labels of SI units and prefixes.
SI_UNITS = {
    "AMPERE": "A", "BECQUEREL": "Bq", "CANDELA": "cd", "COULOMB": "C", "CUBIC_METRE": "m³", "DEGREE_CELSIUS": "°C", "FARAD": "F", "GRAM": "g",
    "GRAY": "Gy", "HENRY": "H", "HERTZ": "Hz", "JOULE": "J", "KELVIN": "K", "LUMEN": "lm", "LUX": "lx", "METRE": "m", "MOLE": "mol", "NEWTON": "N",
    "OHM": "Ω", "PASCAL": "Pa", "RADIAN": "rad", "SECOND": "s", "SIEMENS": "S", "SIEVERT": "Sv", "SQUARE_METRE": "m²", "STERADIAN": "sr", "TESLA": "T",
    "VOLT": "V", "WATT": "W", "WEBER": "Wb",
}
SI_PREFIXES = {"EXA": "E", "PETA": "P", "TERA": "T", "GIGA": "G", "MEGA": "M", "KILO": "k", "HECTO": "h", "DECA": "da", "DECI": "d", "CENTI": "c", "MILLI": "m", "MICRO": "µ", "NANO": "n", "PICO": "p", "FEMTO": "f", "ATTO": "a"}
#: Labels of units that files define by conversion, where they differ from the lower-case name.  US pints and gallons have the
#: label of UK ones, and "cubie inch" is spelled so, because results have to agree.
NAMED_UNITS = {
    "inch": "in", "foot": "ft", "yard": "yd", "mile": "mi", "acre": "ac", "square inch": "in²", "square foot": "ft²", "square yard": "yd²",
    "square mile": "mi²", "cubie inch": "in³", "cubic foot": "ft³", "cubic yard": "yd³", "litre": "l", "fluid ounce uk": "fl oz(UK)",
    "fluid ounce us": "fl oz(US)", "pint uk": "pint(UK)", "pint us": "pint(UK)", "gallon uk": "gal(UK)", "gallon us": "gal(UK)", "degree": "°",
    "ounce": "oz", "pound": "lb", "ton uk": "t(UK)", "ton us": "t(US)", "minute": "mins", "hour": "hr", "day": "day", "btu": "btu", "fahrenheit": "°F",
}
_STRING = "'(?:[^']|'')*+'"
_NESTED = r"\((?:[^()']++|" + _STRING + r")*+\)"
for _ in range(3):
    _NESTED = r"\((?:[^()']++|" + _STRING + "|" + _NESTED + r")*+\)"
#: One argument: text without commas, strings, and brackets up to four deep.
_ARGUMENT = "((?:[^,()']++|" + _STRING + "|" + _NESTED + ")++)"


#: Where text is read: plain, in a string, in a comment.
_CASES = {"n": "", "s": "'", "c": "/*"}
_QUOTED = re.compile(r"'[^']*(?P<s>'?)|/\*(?:.*?(?P<c>\*/)|.*)", re.DOTALL)
#: Statements that are no entities.
_FRAME = r"(?is)^(ISO-10303-21|END-ISO-10303-21|HEADER|DATA(\s*\(.*\))?|ENDSEC|(FILE_\w+|SCHEMA_POPULATION|SECTION_LANGUAGE|SECTION_CONTEXT)\s*\(.*\))$"
_ENTITY = r"(?s)^\s*#(\d+)\s*=\s*([A-Za-z0-9_]+)\s*\((.*)\)\s*;?\s*$"


def case_after(case: str, text: str) -> str:
    """Where one is after `text` that begins in `case`."""
    last = None
    for last in _QUOTED.finditer(_CASES[case] + text):
        pass
    if last is None or last["s"] or last["c"]:
        return "n"
    return "s" if last[0][0] == "'" else "c"


def _told(batches):
    """Adds to the pieces of splits, in order, where each ends if its split began in any of the cases."""
    now, cases = None, []
    for batch in batches:
        end = []
        for model, block, text in zip(*(batch.column(k).to_pylist() for k in ("model", "block", "value")), strict=True):
            if (model, block) != now:
                now, cases = (model, block), list(_CASES)
            after = {c: case_after(c, text) for c in set(cases)}
            cases = [after[c] for c in cases]
            end.append("".join(cases))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(end, pa.string())], names=[*batch.schema.names, "end"])


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(model, no, at, value, closed): the text between semicolons, with the number of the statement that it is of; `closed` tells
    that the piece does not end in a string or a comment."""
    meta = lambda c: F.col(f"_metadata.{c}")
    raw = spark.read.option("lineSep", ";").text(path).select(meta("file_path").alias("model"), meta("file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), "value")
    told = materialize(raw.mapInArrow(_told, "model string, block long, n long, value string, end string"))
    ends = told.groupBy("model", "block").agg(F.max_by("end", "n").alias("end"))  # a row a split
    case_of = lambda cases, case: F.substring(cases, F.instr(F.lit("".join(_CASES)), case), F.lit(1))
    whole = ends.groupBy("model").agg(F.array_sort(F.collect_list(F.struct("block", "end"))).alias("all"))
    start = F.struct(F.lit("n").alias("case"), F.array().cast("array<string>").alias("seen"))
    cases = F.aggregate("all", start, lambda acc, b: F.struct(case_of(b["end"], acc["case"]).alias("case"), F.array_append(acc["seen"], acc["case"]).alias("seen")))
    begun = whole.select("model", F.col("all.block").alias("blocks"), cases["seen"].alias("cases")).select("model", F.explode(F.arrays_zip("blocks", "cases")).alias("b"))
    begun = materialize(begun.select(F.col("model").alias("of"), F.col("b.blocks").alias("at"), F.col("b.cases").alias("first")))
    met = told.join(F.broadcast(begun), (F.col("model") == F.col("of")) & (F.col("block") == F.col("at")))  # as many rows as Spark has splits
    known = met.select("model", "block", "n", "value", (case_of(F.col("end"), F.col("first")) == "n").alias("closed"))
    counted = running(known, ["model"], ["block", "n"], {"no": F.col("closed").cast("long")})
    return counted.select("model", "no", F.struct("block", "n").alias("at"), "value", "closed")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Statements (model, no, value) of the files at `path`, without comments and the blanks around them.

    Any line ends, several statements a line, statements over several lines, and strings and comments with semicolons are read.  Text in
    which a string or comment is still open at the file's end is one statement, which `malformed` reports.
    """
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda p: p["value"]), ";")
    whole = pieces(spark, path).groupBy("model", "no").agg(parts.alias("t"))
    plain = F.regexp_replace("t", r"(?s)('[^']*+')|/\*.*?\*/", "$1")
    return whole.select("model", "no", F.regexp_replace(plain, r"^\s+|\s+$", "").alias("value")).where("value <> ''")


def malformed(lines: DataFrame) -> DataFrame:
    """The statements that are neither an entity nor of a file's frame, such as complex instances, or text that a quote left open."""
    rest = F.regexp_replace("value", "(?s)'[^']*'", "")
    count = lambda c: F.length(rest) - F.length(F.replace(rest, F.lit(c), F.lit("")))
    whole = ~F.contains(rest, F.lit("'")) & ~F.contains(rest, F.lit("/*")) & (count("(") == count(")"))
    return lines.where(~((F.col("value").rlike(_ENTITY) | F.col("value").rlike(_FRAME)) & whole))


def schema_of(lines: DataFrame) -> DataFrame:
    """(model, schema); a schema that is not read raises."""
    found = lines.select("model", F.regexp_extract("value", r"FILE_SCHEMA\s*\(\s*\(\s*'([^']*)'", 1).alias("schema")).where("schema <> ''")
    known = F.upper("schema").isin(*SCHEMAS)
    return found.select("model", F.when(known, F.col("schema")).otherwise(F.raise_error(F.concat(F.lit("schema is not read: "), F.col("schema")))).alias("schema"))


def arguments(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(_ARGUMENT), F.lit(1)), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))


def entities(lines: DataFrame) -> DataFrame:
    """(model, id, type, args, values) of the statements (model, value) that define an entity: arguments as written, and
    as `value` reads them."""
    part = lambda k: F.regexp_extract("value", _ENTITY, k)
    return lines.where(F.col("value").rlike(_ENTITY)).select("model", part(1).cast("long").alias("id"), F.upper(part(2)).alias("type"), arguments(part(3)).alias("args")).withColumn("values", F.transform("args", lambda x: value(x)))


def arg(k: int) -> Column:
    return F.get("args", F.lit(k))


def val(k: int) -> Column:
    return F.get("values", F.lit(k))


def reference(text: Column) -> Column:
    """The id that `#id` names, else null."""
    return F.regexp_extract(text, r"^#(\d+)$", 1).try_cast("long")


def references(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"#(\d+)"), F.lit(1)), lambda x: x.cast("long"))


def _with(x: Column, f) -> Column:
    """f(x) with x evaluated once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _coded(text: Column, mark: str, first) -> Column:
    """`text` with what follows each `mark` rewritten by `first`."""
    return _with(F.split(text, mark, -1), lambda p: F.concat(F.get(p, F.lit(0)), F.array_join(F.transform(F.slice(p, F.lit(2), F.size(p)), first), "")))


def decoded(text: Column) -> Column:
    """The characters of a string literal: doubled quotes, `\\X\\hh`, `\\X2\\..\\X0\\`, `\\X4\\..\\X0\\`, `\\S\\c` and doubled backslashes."""
    inner = F.regexp_replace(F.regexp_extract(text, "(?s)^'(.*)'$", 1), "''", "'")
    run = lambda charset: lambda p: F.concat(F.decode(F.unhex(F.substring_index(p, "\\X0\\", 1)), charset), F.regexp_replace(p, r"(?s)^[0-9A-Fa-f]*\\X0\\", ""))
    wide = _coded(_coded(inner, r"\\X2\\", run("UTF-16BE")), r"\\X4\\", run("UTF-32"))
    latin = _coded(wide, r"\\X\\(?=[0-9A-Fa-f]{2})", lambda p: F.concat(F.decode(F.unhex(F.substring(p, 1, 2)), "ISO-8859-1"), F.regexp_replace(p, "(?s)^..", "")))
    shifted = _coded(latin, r"\\S\\", lambda p: F.concat(F.char(F.ascii(p) + 128), F.regexp_replace(p, "(?s)^.", "")))
    return F.when(F.contains(inner, F.lit("\\")), F.replace(shifted, F.lit("\\\\"), F.lit("\\"))).otherwise(inner)


def measure(text: Column) -> Column:
    """The type that wraps a value, such as IFCLENGTHMEASURE, else null."""
    return F.nullif(F.upper(F.regexp_extract(text, r"(?s)^([A-Za-z]\w*)\s*\(.*\)$", 1)), F.lit(""))


def unwrapped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)^[A-Za-z]\w*\s*\((.*)\)$", "$1")


def _simple(t: Column) -> Column:
    number = F.regexp_replace(t, r"\.$|\.(?=[eE])", "")
    return (
        F.when(t.isin("$", "*", "()") | t.rlike('^(#|")'), None)
        .when(t.rlike("^'"), decoded(t))
        .when(t == ".T.", "true").when(t == ".F.", "false").when(t == ".U.", "UNKNOWN")
        .when(t.rlike(r"^\.\w+\.$"), F.regexp_replace(t, r"^\.|\.$", ""))
        .when(t.rlike(r"^[-+]?\d+$"), t)
        .when(t.rlike(r"^[-+]?\d+\.\d*([eE][-+]?\d+)?$"), number.try_cast("double").cast("string"))
    )


def value(text: Column) -> Column:
    """An argument's value as text: missing, derived, binary and entities are null, an unknown logical is "UNKNOWN",
    enumerations are their name, aggregates of values "(a, b)"."""

    def told(t: Column) -> Column:
        items = F.transform(arguments(F.regexp_replace(t, r"(?s)^\(|\)$", "")), lambda x: _with(unwrapped(x), _simple))
        aggregate = _with(items, lambda i: F.when(F.exists(i, lambda x: x.isNull()), None).otherwise(F.concat(F.lit("("), F.array_join(i, ", "), F.lit(")"))))
        return F.when(t.rlike(r"^\(.+\)$"), aggregate).otherwise(_simple(t))

    return _with(unwrapped(text), told)


def tree(found: DataFrame) -> DataFrame:
    """(model, parent, child, relation) of aggregation, nesting and containment."""
    whole = found.where(F.col("type").isin("IFCRELAGGREGATES", "IFCRELNESTS")).select("model", reference(arg(4)).alias("parent"), F.explode(references(arg(5))).alias("child"), F.col("type").alias("relation"))
    inside = found.where("type = 'IFCRELCONTAINEDINSPATIALSTRUCTURE'").select("model", reference(arg(5)).alias("parent"), F.explode(references(arg(4))).alias("child"), F.col("type").alias("relation"))
    return whole.union(inside)


def superscript(n: Column) -> Column:
    """An exponent; 1 is not written."""
    return F.when(n == 1, "").otherwise(F.translate(n.cast("string"), "-0123456789", "⁻⁰¹²³⁴⁵⁶⁷⁸⁹"))


def _lookup(table: dict[str, str], key: Column, default: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key), default)


def named_unit(name: Column) -> Column:
    return _lookup(NAMED_UNITS, F.lower(name), F.lower(name))


def si_unit(prefix: Column, name: Column) -> Column:
    return F.concat(_lookup(SI_PREFIXES, F.coalesce(prefix, F.lit("")), F.lit("")), _lookup(SI_UNITS, name, F.lit("")))


def units(found: DataFrame) -> DataFrame:
    """(model, id, unit_type, label) of every unit that a file defines."""
    kind = F.col("type")
    label = (
        F.when(kind == "IFCSIUNIT", si_unit(val(2), val(3)))
        .when(kind.isin("IFCCONVERSIONBASEDUNIT", "IFCCONVERSIONBASEDUNITWITHOFFSET", "IFCCONTEXTDEPENDENTUNIT"), named_unit(val(2)))
        .when(kind == "IFCMONETARYUNIT", val(0))
    )
    unit_type = F.when(kind == "IFCMONETARYUNIT", "MONETARYVALUE").otherwise(val(1))
    simple = found.select("model", "id", unit_type.alias("unit_type"), label.alias("label")).where("label is not null")
    element = found.where("type = 'IFCDERIVEDUNITELEMENT'").select("model", F.col("id").alias("element"), reference(arg(0)).alias("id"), arg(1).try_cast("int").alias("power"))
    derived = found.where("type = 'IFCDERIVEDUNIT'").select("model", F.col("id").alias("derived"), val(1).alias("unit_type"), F.posexplode(references(arg(0))).alias("at", "element"))
    # a base that is itself a square or a cube multiplies its exponent
    own = F.when(F.col("label").endswith("²"), 2).when(F.col("label").endswith("³"), 3).otherwise(1)
    part = F.concat(F.regexp_replace("label", "[²³]$", ""), superscript(F.col("power") * own))
    parts = derived.join(element, ["model", "element"]).join(simple.select("model", "id", "label"), ["model", "id"]).where("label <> ''")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", part.alias("p")))), lambda x: x["p"]), "·")
    return simple.union(parts.groupBy("model", "derived", "unit_type").agg(joined.alias("label")).select("model", F.col("derived").alias("id"), "unit_type", "label"))


def project_units(found: DataFrame, labels: DataFrame) -> DataFrame:
    """(model, unit_type, label) of the units that the project assigns; of two of a type that of the larger id."""
    assigned = found.where("type = 'IFCUNITASSIGNMENT'").select("model", F.explode(references(arg(0))).alias("id"))
    return assigned.join(labels, ["model", "id"]).groupBy("model", "unit_type").agg(F.max_by("label", "id").alias("label"))


def unit_type(measure_: Column) -> Column:
    """IFCPOSITIVELENGTHMEASURE to LENGTHUNIT, and so on."""
    return F.regexp_replace(measure_, "^IFC(?:POSITIVE|NONNEGATIVE)?(\\w+)MEASURE$", "$1UNIT")


_QUANTITY = {"IFCQUANTITYLENGTH": "LENGTHUNIT", "IFCQUANTITYAREA": "AREAUNIT", "IFCQUANTITYVOLUME": "VOLUMEUNIT", "IFCQUANTITYWEIGHT": "MASSUNIT", "IFCQUANTITYTIME": "TIMEUNIT", "IFCQUANTITYCOUNT": "COUNTUNIT"}


def property_values(found: DataFrame) -> DataFrame:
    """(model, property, name, value, unit, unit_type) of single, bounded, list and enumerated properties and of simple
    quantities; tables are left out."""
    kind = F.col("type")
    quantity = kind.isin(*_QUANTITY)
    plain = F.when(kind == "IFCPROPERTYBOUNDEDVALUE", F.concat(F.lit("["), F.coalesce(val(3), F.lit("")), F.lit(", "), F.coalesce(val(2), F.lit("")), F.lit("]"))).when(quantity, val(3)).otherwise(val(2))
    told = F.when(kind == "IFCPROPERTYBOUNDEDVALUE", F.coalesce(measure(arg(2)), measure(arg(3)))).when(kind == "IFCPROPERTYSINGLEVALUE", measure(arg(2))).otherwise(measure(F.get(arguments(F.regexp_replace(arg(2), r"(?s)^\(|\)$", "")), F.lit(0))))
    unit = F.when(quantity, arg(2)).when(kind == "IFCPROPERTYBOUNDEDVALUE", arg(4)).when(kind != "IFCPROPERTYENUMERATEDVALUE", arg(3))
    types = ["IFCPROPERTYSINGLEVALUE", "IFCPROPERTYBOUNDEDVALUE", "IFCPROPERTYLISTVALUE", "IFCPROPERTYENUMERATEDVALUE", *_QUANTITY]
    by = F.when(quantity, _lookup(_QUANTITY, kind, F.lit(None).cast("string"))).otherwise(unit_type(told))
    return found.where(kind.isin(types)).select("model", F.col("id").alias("property"), val(0).alias("name"), plain.alias("value"), reference(unit).alias("unit"), by.alias("unit_type")).where("value is not null")


def properties(found: DataFrame) -> DataFrame:
    """(model, object, group, name, value, unit): what property sets and quantities say of each object; an object's own
    sets come before those of its type, and of equal ones the last defined counts.  Text is parsed once: `found` is stored."""
    found = materialize(found)
    groups = found.where("type = 'IFCPROPERTYSET'").select("model", F.col("id").alias("set"), F.coalesce(val(2), F.lit("IfcPropertySet")).alias("group"), F.explode(references(arg(4))).alias("property"))
    amounts = found.where("type = 'IFCELEMENTQUANTITY'").select("model", F.col("id").alias("set"), F.coalesce(val(2), F.lit("IfcElementQuantity")).alias("group"), F.explode(references(arg(5))).alias("property"))
    own = found.where("type = 'IFCRELDEFINESBYPROPERTIES'").select("model", F.explode(references(arg(4))).alias("object"), reference(arg(5)).alias("set"), F.lit(0).alias("rank"))
    typed = found.where("type = 'IFCRELDEFINESBYTYPE'").select("model", F.explode(references(arg(4))).alias("object"), reference(arg(5)).alias("id"))
    sets_of_type = typed.join(found.select("model", "id", F.explode(references(arg(5))).alias("set")), ["model", "id"]).select("model", "object", "set", F.lit(1).alias("rank"))
    labels = units(found)
    values = property_values(found).join(labels.select("model", F.col("id").alias("unit"), F.col("label").alias("own_label")), ["model", "unit"], "left")
    values = values.join(project_units(found, labels), ["model", "unit_type"], "left").select("model", "property", "name", "value", F.coalesce("own_label", "label").alias("unit"))
    all_ = own.union(sets_of_type).join(groups.union(amounts), ["model", "set"]).join(values, ["model", "property"])
    first = Window.partitionBy("model", "object", "group", "name").orderBy("rank", F.desc("set"), F.desc("property"))
    return all_.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("model", "object", "group", "name", "value", "unit")


_PLACES = {"IFCPROJECT": "Project", "IFCBUILDING": "Building", "IFCBUILDINGSTOREY": "Storey"}


def object_attributes(found: DataFrame, floor_key: str = "Floor") -> DataFrame:
    """(model, object, group, name, value): type, name, GUID and description of every rooted object; projects, buildings
    and storeys also have a Location, storeys the key that splits floors.  A missing name is the type in brackets."""
    rooted = found.where(arg(0).rlike("^'.{22}'$") & ~F.col("type").rlike("^IFC(REL|PROPERTYSET|ELEMENTQUANTITY|.*PROPERTIES$)"))
    name = F.coalesce(val(2), F.concat(F.lit("("), F.col("type"), F.lit(")")))
    place = _lookup(_PLACES, F.col("type"), F.lit(None).cast("string"))
    entry = lambda group, key, v: F.struct(F.lit(group).alias("group"), (key if isinstance(key, Column) else F.lit(key)).alias("name"), v.alias("value"))
    rows = F.array(
        entry("", "IFC Type", F.col("type")), entry("", "IFC Name", name), entry("", "IFC GUID", val(0)), entry("", "IFC Description", val(3)),
        entry("Location", place, F.when(place.isNotNull(), name)), entry("", floor_key, F.when(F.col("type") == "IFCBUILDINGSTOREY", name)),
    )
    return rooted.select("model", F.col("id").alias("object"), F.explode(rows).alias("e")).select("model", "object", "e.*").where("value is not null")
