"""A scene derived from the tables: root, regions, nations, customers (transformations), orders
(meshes), parts of a few brands (metadata and materials)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.linear import IDENTITY, matrix


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _matrix(scale, x, y, z):
    return matrix([scale, 0, 0, x, 0, scale, 0, y, 0, 0, scale, z, 0, 0, 0, 1])


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """shared_id, _id, type, name, parents, matrix, hidden, floor, grouping, vertices."""

    def rows(df, sid, kind, name, parent, m=None, hidden=None, floor=None, vertices=None):
        return df.select(
            sid.alias("shared_id"), F.concat(F.lit("id-"), sid).alias("_id"), F.lit(kind).alias("type"), name.alias("name"),
            (F.array(parent) if parent is not None else F.array().cast("array<string>")).alias("parents"),
            (m if m is not None else F.lit(None).cast("array<double>")).alias("matrix"),
            (hidden if hidden is not None else F.lit(False)).alias("hidden"),
            (floor if floor is not None else F.lit(None).cast("string")).alias("floor"),
            (vertices if vertices is not None else F.lit(None).cast("long")).alias("vertices"),
        )

    c = F.col
    key = lambda p, k: F.concat(F.lit(p), c(k).cast("string"))
    r, n, cu, o = (table(spark, sf, t) for t in ("region", "nation", "customer", "orders"))
    root = rows(spark.range(1), F.lit("root"), "transformation", F.lit("root"), None, matrix(IDENTITY))
    regions = rows(r, key("R", "r_regionkey"), "transformation", c("r_name"), F.lit("root"), _matrix(F.lit(2.0), c("r_regionkey").cast("double"), F.lit(0.0), F.lit(1.0)), floor=c("r_name"))
    nations = rows(n, key("N", "n_nationkey"), "transformation", c("n_name"), key("R", "n_regionkey"), _matrix(F.lit(1.0), (c("n_nationkey") % 7).cast("double"), (c("n_nationkey") % 3).cast("double"), F.lit(0.0)))
    customers = rows(cu, key("C", "c_custkey"), "transformation", c("c_name"), key("N", "c_nationkey"), _matrix(F.lit(0.5), F.lit(0.0), (c("c_custkey") % 5).cast("double"), (c("c_custkey") % 4).cast("double")))
    name = F.when(c("o_orderkey") % 50 == 0, F.concat(F.lit("Room (IFC Space) "), c("o_orderkey").cast("string"))).when(c("o_orderkey") % 3 == 0, F.lit("")).otherwise(key("Order ", "o_orderkey"))
    orders = rows(o, key("O", "o_orderkey"), "mesh", name, key("C", "o_custkey"), hidden=c("o_orderstatus") == "P", vertices=F.floor(c("o_totalprice")).cast("long"))
    return root.union(regions).union(nations).union(customers).union(orders)


#: The same scene for DuckDB; `w` columns are world scale and offsets, exact in binary.
NODES_SQL = """
nodes AS (
  SELECT 'root' AS shared_id, 'transformation' AS type, 'root' AS name, NULL AS parent, 1.0::DOUBLE AS s, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS z, false AS hidden, NULL AS floor, NULL::BIGINT AS vertices
  UNION ALL SELECT 'R' || r_regionkey, 'transformation', r_name, 'root', 2.0, r_regionkey, 0.0, 1.0, false, r_name, NULL FROM region
  UNION ALL SELECT 'N' || n_nationkey, 'transformation', n_name, 'R' || n_regionkey, 1.0, n_nationkey % 7, n_nationkey % 3, 0.0, false, NULL, NULL FROM nation
  UNION ALL SELECT 'C' || c_custkey, 'transformation', c_name, 'N' || c_nationkey, 0.5, 0.0, c_custkey % 5, c_custkey % 4, false, NULL, NULL FROM customer
  UNION ALL SELECT 'O' || o_orderkey, 'mesh', CASE WHEN o_orderkey % 50 = 0 THEN 'Room (IFC Space) ' || o_orderkey WHEN o_orderkey % 3 = 0 THEN '' ELSE 'Order ' || o_orderkey END,
    'C' || o_custkey, 1.0, 0.0, 0.0, 0.0, o_orderstatus = 'P', NULL, CAST(floor(o_totalprice) AS BIGINT) FROM orders)
"""

TREE_SQL = f"""
WITH RECURSIVE {NODES_SQL},
tree AS (
  SELECT shared_id, type, name, hidden, vertices, [shared_id] AS ids, shared_id AS path, 0 AS depth, s AS ws, x AS wx, y AS wy, z AS wz, floor AS branch FROM nodes WHERE parent IS NULL
  UNION ALL
  SELECT n.shared_id, n.type, n.name, n.hidden, n.vertices, list_append(t.ids, n.shared_id), t.path || '__' || n.shared_id, t.depth + 1,
         t.ws * n.s, t.ws * n.x + t.wx, t.ws * n.y + t.wy, t.ws * n.z + t.wz, coalesce(n.floor, t.branch)
  FROM tree t JOIN nodes n ON n.parent = t.shared_id)
"""


def boxes(spark: SparkSession, sf: str, half: float = 0.03) -> DataFrame:
    """id, composite, part source side and corners from the first three embedding values."""
    e = table(spark, sf, "embeddings")
    at = [F.get("embedding", F.lit(k)).cast("double") for k in range(3)]
    size = F.lit(half) * (1 + F.col("vec_id") % 3)
    return e.select(F.col("vec_id").alias("id"), F.concat(F.lit("L"), F.col("label").cast("string")).alias("composite"), *((at[k] - size).alias(f"lo{k}") for k in range(3)), *((at[k] + size).alias(f"hi{k}") for k in range(3)))


BOXES_SQL = """
boxes AS (
  SELECT vec_id AS id, 'L' || label AS composite, {cols} FROM embeddings)
""".format(cols=", ".join([f"embedding[{k + 1}]::DOUBLE - 0.03 * (1 + vec_id % 3) AS lo{k}" for k in range(3)] + [f"embedding[{k + 1}]::DOUBLE + 0.03 * (1 + vec_id % 3) AS hi{k}" for k in range(3)]))
