"""Building models as STEP text, written from the parts and read back: properties, tree, attributes, units."""

from __future__ import annotations

import json
import struct
import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import scratch
from ..sources import container, ifc, meshes
from .scene import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_GUID = "'%022d'"
#: Statements of a part, by their number after the part's own.
_PART = (
    f"#%d1=IFCWALL({_GUID},$,'%s; ''(a, b)''',$,$,$,$,$)",
    "#%d2=IFCPROPERTYSINGLEVALUE('Size',$,IFCPOSITIVELENGTHMEASURE(%d.),$)",
    "#%d3=IFCPROPERTYBOUNDEDVALUE('Range',$,IFCINTEGER(%d),IFCINTEGER(1),$,$)",
    "#%d4=IFCPROPERTYSINGLEVALUE('Kind',$,IFCLABEL('caf\\X2\\00E9\\X0\\ %s'),$)",
    f"#%d5=IFCPROPERTYSET({_GUID},$,'Own',$,(#%d2,#%d3,#%d4))",
    f"#%d6=IFCRELDEFINESBYPROPERTIES({_GUID},$,$,$,(#%d1),#%d5)",
    f"#%d7=IFCRELCONTAINEDINSPATIALSTRUCTURE({_GUID},$,$,$,(#%d1),#8)",
)
#: Statements of every model.
_MODEL = (
    "FILE_SCHEMA(('IFC4'))",
    "#1=IFCSIUNIT(*,.LENGTHUNIT.,.MILLI.,.METRE.)",
    "#2=IFCSIUNIT(*,.VOLUMEUNIT.,$,.CUBIC_METRE.)",
    "#3=IFCSIUNIT(*,.MASSUNIT.,.KILO.,.GRAM.)",
    "#4=IFCDERIVEDUNITELEMENT(#3,1)",
    "#5=IFCDERIVEDUNITELEMENT(#2,-1)",
    "#6=IFCDERIVEDUNIT((#4,#5),.MASSDENSITYUNIT.,$)",
    "#7=IFCUNITASSIGNMENT((#1,#2,#3,#6))",
    f"#8=IFCBUILDINGSTOREY({_GUID % 8},$,$,$,$,$,$,$,.ELEMENT.,0.)",
    f"#9=IFCBUILDING({_GUID % 9},$,'Main',.U.,$,$,$,$,.ELEMENT.,$,$,$)",
    f"#10=IFCRELAGGREGATES({_GUID % 10},$,$,$,#9,(#8))",
)


def statements(spark, sf) -> DataFrame:
    """(model, value): a model a brand, with its parts as walls of one storey."""
    p = table(spark, sf, "part").repartition("p_partkey").withColumn("k", F.col("p_partkey") + 100)  # a small file is one split: its text is much larger
    k, s = F.col("k"), F.col("p_size")
    given = ([k, k, "p_name"], [k, s], [k, s], [k, "p_type"], [k, k, k, k, k], [k, k, k, k], [k, k, k])
    lines = F.array(*(F.format_string(text, *values) for text, values in zip(_PART, given, strict=True)))
    models = p.select(F.col("p_brand").alias("model")).distinct().select("model", F.explode(F.array(*map(F.lit, _MODEL))).alias("value"))
    return p.select(F.col("p_brand").alias("model"), F.explode(lines).alias("value")).union(models)


@query("""WITH p AS (SELECT p_brand AS model, (p_partkey + 100) * 10 + 1 AS object, * FROM part)
SELECT model, object, 'Own' AS "group", 'Size' AS name, CAST(CAST(p_size AS DOUBLE) AS VARCHAR) AS value, 'mm' AS unit FROM p
UNION ALL SELECT model, object, 'Own', 'Range', '[1, ' || p_size || ']', NULL FROM p
UNION ALL SELECT model, object, 'Own', 'Kind', 'café ' || p_type, NULL FROM p""")
def ifc_properties(spark, sf):
    return ifc.properties(ifc.entities(statements(spark, sf)))


@query("""SELECT p_brand AS model, CAST(8 AS BIGINT) AS parent, (p_partkey + 100) * 10 + 1 AS child, 'IFCRELCONTAINEDINSPATIALSTRUCTURE' AS relation FROM part
UNION ALL SELECT DISTINCT p_brand, 9, 8, 'IFCRELAGGREGATES' FROM part""")
def ifc_tree(spark, sf):
    return ifc.tree(ifc.entities(statements(spark, sf)))


@query("""WITH m AS (SELECT DISTINCT p_brand AS model FROM part), w AS (SELECT p_brand AS model, (p_partkey + 100) * 10 + 1 AS object, * FROM part)
SELECT model, object, '' AS "group", 'IFC Type' AS name, 'IFCWALL' AS value FROM w
UNION ALL SELECT model, object, '', 'IFC Name', p_name || '; ''(a, b)''' FROM w
UNION ALL SELECT model, object, '', 'IFC GUID', lpad(CAST(p_partkey + 100 AS VARCHAR), 22, '0') FROM w
UNION ALL SELECT model, id, grp, name, value FROM m, (VALUES (8, '', 'IFC Type', 'IFCBUILDINGSTOREY'), (8, '', 'IFC Name', '(IFCBUILDINGSTOREY)'), (8, '', 'IFC GUID', '0000000000000000000008'),
 (8, 'Location', 'Storey', '(IFCBUILDINGSTOREY)'), (8, '', 'Floor', '(IFCBUILDINGSTOREY)'), (9, '', 'IFC Type', 'IFCBUILDING'), (9, '', 'IFC Name', 'Main'), (9, '', 'IFC GUID', '0000000000000000000009'),
 (9, '', 'IFC Description', 'UNKNOWN'), (9, 'Location', 'Building', 'Main')) v(id, grp, name, value)""")
def ifc_attributes(spark, sf):
    return ifc.object_attributes(ifc.entities(statements(spark, sf)))


@query("""SELECT DISTINCT p_brand AS model, unit_type, label FROM part, (VALUES ('LENGTHUNIT', 'mm'), ('VOLUMEUNIT', 'm³'), ('MASSUNIT', 'kg'), ('MASSDENSITYUNIT', 'kg·m⁻³')) u(unit_type, label)""")
def ifc_units(spark, sf):
    found = ifc.entities(statements(spark, sf))
    return ifc.project_units(found, ifc.units(found))


@query("SELECT DISTINCT p_brand AS model, 'IFC4' AS schema FROM part")
def ifc_schema(spark, sf):
    return ifc.schema_of(statements(spark, sf))


#: A part as tools write it: statements that share lines, strings and comments with semicolons and quotes, line ends within a statement.
_WRITTEN = "#%d1=IFCWALL('%022d',$,'%s; ''(a, b)''',$); /* it's; one */ #%d2 =\r\n IFCPROPERTYSINGLEVALUE('Size',$,/* ; '' */ IFCINTEGER(%d),$);\r\n#%d3=IFCLABEL('/* no; comment */');#%d4=BROKEN('%s';"


@query("""WITH k AS (SELECT p_partkey + 100 AS k, * FROM part)
SELECT k * 10 + 1 AS id, 'IFCWALL' AS type, p_name || '; ''(a, b)''' AS value FROM k UNION ALL SELECT k * 10 + 2, 'IFCPROPERTYSINGLEVALUE', CAST(p_size AS VARCHAR) FROM k
UNION ALL SELECT k * 10 + 3, 'IFCLABEL', '/* no; comment */' FROM k UNION ALL SELECT k * 10 + 4, 'malformed', '#' || (k * 10 + 4) || '=BROKEN(''' || p_name || '''' FROM k""")
def ifc_statements(spark, sf):
    """Models written as text and read back; what is no statement is reported."""
    p = table(spark, sf, "part").withColumn("k", F.col("p_partkey") + 100)
    path = f"{scratch.folder(spark)}/step-{uuid.uuid4().hex}"
    p.select(F.format_string(_WRITTEN, "k", "k", "p_name", "k", "p_size", "k", "k", "p_name")).write.option("lineSep", "\r\n").text(path)
    lines = ifc.read(spark, path)
    found = ifc.entities(lines)
    value = F.when(F.col("type") == "IFCLABEL", ifc.val(0)).otherwise(ifc.val(2))
    wrong = ifc.malformed(lines).select(F.regexp_extract("value", r"^#(\d+)", 1).cast("long").alias("id"), F.lit("malformed").alias("type"), "value")
    return found.select("id", "type", value.alias("value")).union(wrong)


def _containers(spark, sf) -> DataFrame:
    """A container a nation: its customers are triangles under a group that is moved and scaled."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        nation, data = int(pdf["c_nationkey"].iloc[0]), bytearray()
        group = [{"id": 0, "name": "nation", "transformation": [2, 0, 0, nation, 0, 2, 0, 0, 0, 0, 2, 5, 0, 0, 0, 1]}, {"id": 1, "parent": 0, "name": ""}]
        text = bytearray(b'{"nodes": ' + json.dumps(group)[:-1].encode())  # written a node at a time: as bytes they take a fraction
        for key in map(int, pdf["c_custkey"].sort_values()):
            corners = [key % 1000, key % 7, 0, key % 1000 + 1, key % 7, 0, key % 1000, key % 7 + 1, key % 3]
            at = len(data)
            data += struct.pack("<9d", *corners) + struct.pack("<3I", 0, 1, 2)
            node = {"id": key + 2, "parent": 1, "name": "", "metadata": {"skey": f"C{key}"}, "geometry": {"material": key % 2, "numVertices": 3, "vertices": [at, at + 72], "indices": [at + 72, at + 84]}}
            text += b", " + json.dumps(node).encode()
        materials = [{"diffuse": [1, 0, 0], "transparency": 0.25, "shininess": 0.5}, {"diffuse": [0, 1, 0]}]
        text += b'], "materials": ' + json.dumps(materials).encode() + b', "textures": []}'
        return pd.DataFrame({"path": [f"nation-{nation}"], "content": [container.packed(bytes(text), bytes(data))]})

    return table(spark, sf, "customer").select("c_nationkey", "c_custkey").groupBy("c_nationkey").applyInPandas(build, "path string, content binary")


@query("""WITH v AS (SELECT c_nationkey, c_custkey, unnest([0, 1, 2]) AS nth, 2 * (c_custkey % 1000) + c_nationkey AS x, 2 * (c_custkey % 7) AS y FROM customer),
p AS (SELECT c_nationkey, c_custkey, nth, CASE WHEN nth = 1 THEN x + 2 ELSE x END AS x, CASE WHEN nth = 2 THEN y + 2 ELSE y END AS y, CASE WHEN nth = 2 THEN 5 + 2 * (c_custkey % 3) ELSE 5 END AS z FROM v)
SELECT 'nation-' || c_nationkey AS model, c_custkey + 2 AS id, 0 AS entity, nth, CAST(x - min(x) OVER w AS DOUBLE) AS x, CAST(y - min(y) OVER w AS DOUBLE) AS y, CAST(z - min(z) OVER w AS DOUBLE) AS z, CAST(CASE WHEN c_custkey % 2 = 0 THEN 0.75 ELSE 1.0 END AS DOUBLE) AS opacity
FROM p WINDOW w AS (PARTITION BY c_nationkey)""")
def container_meshes(spark, sf):
    """Vertices of the meshes of scene containers, in the world less the scene's offset, with their material's opacity."""
    found = container.unpacked(_containers(spark, sf))
    meshes, _ = container.meshes(found)
    rows = meshes.select("model", "id", "entity", "material", F.posexplode("vertices").alias("nth", "v")).join(container.materials(found).select("model", "material", "opacity"), ["model", "material"])
    return rows.select("model", "id", F.col("entity").cast("int").alias("entity"), "nth", *(F.get("v", F.lit(k)).cast("double").alias(c) for k, c in enumerate("xyz")), "opacity")


_OBJ = "o part %d\nusemtl %s\nv %d 0 0\nv %d 1 0\nv %d 1 1\nv 0 0 %d\nf -4 -3 -2 -1"


@query("""SELECT 'part ' || p_partkey AS name, p_type AS material, CAST(2 AS BIGINT) AS faces, CAST(4 AS BIGINT) AS vertices, CAST(p_partkey AS DOUBLE) AS widest, CAST(greatest(1, p_size) AS DOUBLE) AS highest FROM part""")
def obj_groups(spark, sf):
    """Parts written as groups of OBJ files and read back."""
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    path = f"{scratch.folder(spark)}/obj-{uuid.uuid4().hex}"
    p.select(F.format_string(_OBJ, k, "p_type", k, k, k, "p_size")).write.text(path)
    found = meshes.obj_meshes(spark, path)
    return found.select("name", "material", "faces", "vertices", F.get("hi", F.lit(0)).alias("widest"), F.get("hi", F.lit(2)).alias("highest"))
