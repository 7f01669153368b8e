"""Names, typed values, units, materials and matrices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import linear, values
from .scene import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: Raw cells built from a part's key, for both engines.
_RAW = "CASE p_partkey % 7 WHEN 0 THEN CAST(p_partkey AS VARCHAR) WHEN 1 THEN ' 12' WHEN 2 THEN '1.5' WHEN 3 THEN '1e3' WHEN 4 THEN '' WHEN 5 THEN '-' || CAST(p_size AS VARCHAR) ELSE p_name END"


@query(f"""WITH r AS (SELECT p_partkey, {_RAW} AS raw FROM part),
t AS (SELECT *, CASE WHEN regexp_full_match(raw, '[+-]?[0-9]+') THEN TRY_CAST(raw AS BIGINT) END AS l, CASE WHEN regexp_full_match(raw, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST(raw AS DOUBLE) END AS d FROM r)
SELECT p_partkey, CASE WHEN l IS NOT NULL THEN 'long' WHEN d IS NOT NULL THEN 'double' ELSE 'string' END AS tag, l, CASE WHEN l IS NULL THEN d END AS d, CASE WHEN l IS NULL AND d IS NULL THEN raw END AS s FROM t""")
def metadata_guess_cast(spark, sf):
    p = table(spark, sf, "part").withColumn("raw", F.expr(_RAW.replace("VARCHAR", "STRING")))
    return p.select("p_partkey", values.guess_cast(F.col("raw")).alias("g")).select("p_partkey", "g.*")


@query("""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN '' ELSE p_brand || '::' END || CASE WHEN p_size % 3 = 0 THEN 'Value' ELSE p_name END || CASE WHEN p_size % 2 = 0 THEN ' (mm)' ELSE '' END AS key FROM part""")
def metadata_keys(spark, sf):
    c = F.col
    group = F.when(c("p_size") % 5 != 0, c("p_brand"))
    key = F.when(c("p_size") % 3 == 0, "").otherwise(c("p_name"))
    return table(spark, sf, "part").select("p_partkey", values.metadata_key(group, key, F.when(c("p_size") % 2 == 0, "mm")).alias("key"))


@query("SELECT p_partkey, translate('a$.' || p_name || '.b', '$.', '::') AS key FROM part")
def sanitise_key(spark, sf):
    return table(spark, sf, "part").select("p_partkey", values.sanitize_key(F.concat(F.lit("a$."), "p_name", F.lit(".b"))).alias("key"))


@query("""SELECT p_partkey, translate(n, ' $.', '___') AS name, translate(n, ' $', '__') AS ext, translate(n, ' /\\.$*<>:?"|', '____________') AS db FROM (SELECT p_partkey, p_name || '$.x/\\*<>:?"|' AS n FROM part)""")
def name_sanitize(spark, sf):
    n = F.concat("p_name", F.lit('$.x/\\*<>:?"|'))
    return table(spark, sf, "part").select("p_partkey", values.sanitize_name(n).alias("name"), values.sanitize_extension(n).alias("ext"), values.sanitize_database(n).alias("db"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '00000000-0000-0000-0000-000000000000' WHEN p_size % 3 = 1 THEN 'abcdef00-0000-0000-0000-' || lpad(CAST(p_partkey AS VARCHAR), 12, '0')
ELSE regexp_replace(md5(p_name), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') END AS id FROM part""")
def uuid_normalise(spark, sf):
    c = F.col
    raw = F.when(c("p_size") % 3 == 0, "").when(c("p_size") % 3 == 1, F.concat(F.lit("ABCDEF00-0000-0000-0000-"), F.lpad(c("p_partkey").cast("string"), 12, "0"))).otherwise(c("p_name"))
    return table(spark, sf, "part").select("p_partkey", values.normalise_uuid(raw).alias("id"))


_UNITS = "CASE p_partkey % 7 WHEN 0 THEN 'm' WHEN 1 THEN 'mm' WHEN 2 THEN 'cm' WHEN 3 THEN 'dm' WHEN 4 THEN 'ft' WHEN 5 THEN 'in' ELSE 'furlong' END"
_METRES = "CASE {} WHEN 'm' THEN 1.0 WHEN 'mm' THEN 0.001 WHEN 'cm' THEN 0.01 WHEN 'dm' THEN 0.1 WHEN 'ft' THEN 0.3048 WHEN 'in' THEN 0.0254 END::DOUBLE"


@query(f"WITH u AS (SELECT p_partkey, {_UNITS} AS u FROM part) SELECT p_partkey, u, round(coalesce({_METRES.format('u')} / 0.001::DOUBLE, 1.0), 6) AS to_mm FROM u")
def units_scale(spark, sf):
    u = table(spark, sf, "part").select("p_partkey", F.expr(_UNITS).alias("u"))
    return u.select("p_partkey", "u", F.round(values.scale_factor(F.col("u"), F.lit("mm")), 6).alias("to_mm"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 AND p_size % 4 > 0 THEN 'textured' WHEN p_partkey % 3 = 0 THEN 'opaque' ELSE 'transparent' END AS class FROM part")
def material_class(spark, sf):
    c = F.col
    return table(spark, sf, "part").select("p_partkey", values.material_class(c("p_size") % 2 == 0, c("p_size") % 4, F.when(c("p_partkey") % 3 == 0, 1.0).otherwise(0.5)).alias("class"))


@query("SELECT l_orderkey, l_linenumber, CAST(1 + 2 * CAST(l_discount > 0 AS INTEGER) + 4 * CAST(l_tax > 0 AS INTEGER) + 256 * (l_linenumber % 3) + 65536 * (2 + l_linenumber % 2) AS INTEGER) AS fmt FROM lineitem")
def mesh_format_bits(spark, sf):
    c = F.col
    fmt = values.mesh_format(F.lit(True), c("l_discount") > 0, c("l_tax") > 0, c("l_linenumber") % 3, 2 + c("l_linenumber") % 2)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", fmt.alias("fmt"))


@query("SELECT p_partkey, CAST(p_size % 51 * 5 + 256 * (p_partkey % 51 * 5) AS BIGINT) AS colour FROM part")
def colour_pack(spark, sf):
    c = F.col
    return table(spark, sf, "part").select("p_partkey", values.pack_colour(c("p_size") % 51 / 51.0 + 1e-9, c("p_partkey") % 51 / 51.0 + 1e-9, F.lit(0.0)).alias("colour"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN printf('%.6f', p_retailprice) ELSE CAST(p_size % 3 = 0 AS INTEGER)::VARCHAR END AS text FROM part")
def variant_text(spark, sf):
    c = F.col
    even = c("p_size") % 2 == 0
    tag = F.when(even, "double").otherwise("bool")
    raw = F.when(even, c("p_retailprice").cast("string")).otherwise((c("p_size") % 3 == 0).cast("string"))
    return table(spark, sf, "part").select("p_partkey", values.to_text(tag, raw).alias("text"))


@query("SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 WHERE a.p_size % 2 = b.p_size % 2 AND a.p_type = b.p_type")
def variant_equality(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.when(F.col("p_size") % 2 == 0, "string").otherwise("long").alias("tag"), F.col("p_type").alias("v"))
    a, b = p.toDF("a", "ta", "va"), p.toDF("b", "tb", "vb")
    return a.join(b, F.col("b") == F.col("a") + 1).where(values.same_value(F.col("ta"), F.col("va"), F.col("tb"), F.col("vb"))).select("a", "b")


@query("SELECT l_orderkey, max_by(l_quantity, (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS quantity, l_returnflag FROM lineitem GROUP BY 1, 3")
def metadata_last_wins(spark, sf):
    """Key and value arrays of an order's lines; of a repeated key the last value."""
    order = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_quantity")))
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(order.alias("r"))
    zipped = rows.select("l_orderkey", values.last_wins(F.col("r.l_returnflag"), F.col("r.l_quantity")).alias("m"))
    return zipped.select("l_orderkey", F.explode("m").alias("l_returnflag", "quantity"))


@query("SELECT p_partkey, (p_partkey % 90) || '° ' || (p_size % 60) || ''' ' || (p_size % 7) || '\" ' || (p_partkey % 11) AS angle FROM part")
def plane_angles(spark, sf):
    c = F.col
    return table(spark, sf, "part").select("p_partkey", values.plane_angle(F.array(c("p_partkey") % 90, -(c("p_size") % 60).cast("long"), (c("p_size") % 7).cast("long"), c("p_partkey") % 11)).alias("angle"))


def _vectors(spark, sf):
    c = F.col
    v = lambda *k: linear.vector(*((c(n) % m).cast("double") for n, m in k))
    return table(spark, sf, "part").select("p_partkey", v(("p_partkey", 7), ("p_size", 5), ("p_partkey", 11)).alias("a"), v(("p_size", 3), ("p_partkey", 4), ("p_size", 9)).alias("b"))


@query("""WITH v AS (SELECT p_partkey, (p_partkey % 7)::DOUBLE AS ax, (p_size % 5)::DOUBLE AS ay, (p_partkey % 11)::DOUBLE AS az, (p_size % 3)::DOUBLE AS bx, (p_partkey % 4)::DOUBLE AS by_, (p_size % 9)::DOUBLE AS bz FROM part)
SELECT p_partkey, ax * bx + ay * by_ + az * bz AS dot, ay * bz - az * by_ AS cx, az * bx - ax * bz AS cy, ax * by_ - ay * bx AS cz, round(sqrt(ax * ax + ay * ay + az * az), 6) AS norm FROM v""")
def vector_algebra(spark, sf):
    a, b = F.col("a"), F.col("b")
    x = linear.cross(a, b)
    return _vectors(spark, sf).select("p_partkey", linear.dot(a, b).alias("dot"), x["x"].alias("cx"), x["y"].alias("cy"), x["z"].alias("cz"), F.round(linear.norm(a), 6).alias("norm"))


@query("""WITH v AS (SELECT p_partkey, (p_partkey % 7)::DOUBLE AS x, (p_size % 5)::DOUBLE AS y, (p_partkey % 11)::DOUBLE AS z, (1 + p_size % 4)::DOUBLE AS s FROM part)
SELECT p_partkey, s * x + 1 AS x, s * y + 2 AS y, s * z + 3 AS z, s * s * s AS det, s = 1 AS same FROM v""")
def matrix_algebra(spark, sf):
    s = (1 + F.col("p_size") % 4).cast("double")
    df = _vectors(spark, sf).join(table(spark, sf, "part").select("p_partkey", "p_size"), "p_partkey")
    m = linear.multiply(linear.translation(1, 2, 3), linear.scaling(s, s, s))
    p = linear.transform_point(F.col("m"), F.col("a"))
    return df.withColumn("m", m).select("p_partkey", p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z"), linear.determinant(F.col("m")).alias("det"), linear.is_identity(linear.scaling(s, s, s)).alias("same"))


@query("SELECT p_partkey, round(1.0 / (1 + p_size % 4), 9) AS s, round(-2.0 / (1 + p_size % 4), 9) AS y FROM part")
def matrix_inverse(spark, sf):
    s = (1 + F.col("p_size") % 4).cast("double")
    m = linear.inverse(linear.multiply(linear.translation(0, 2, 0), linear.scaling(s, s, s)))
    return table(spark, sf, "part").withColumn("m", m).select("p_partkey", F.round(F.get("m", F.lit(0)), 9).alias("s"), F.round(F.get("m", F.lit(7)), 9).alias("y"))


_LOD = "CASE p_size % 9 WHEN 1 THEN 1000.0 WHEN 2 THEN 0.5 WHEN 3 THEN 0.1 WHEN 4 THEN 0.01 WHEN 5 THEN 0.005 WHEN 6 THEN 0.0005 ELSE 0.001 END"


@query(f"SELECT p_partkey, {_LOD}::DOUBLE AS linear FROM part")
def level_of_detail(spark, sf):
    return table(spark, sf, "part").select("p_partkey", values.level_of_detail(F.col("p_size") % 9)["linear"].alias("linear"))
