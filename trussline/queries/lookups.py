"""Finds by id, pages, typed values of other tools, document rules, node lists, clusters with their geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import documents, typing
from ..operators import metadata, packing, sequence, tree
from ..plans.filters import Eq, Projection
from ..sources import store
from .scene import NODES_SQL, TREE_SQL, nodes, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def find_cursor(spark, sf):
    return store.find_cursor(table(spark, sf, "orders"), Eq("o_orderstatus", "F"), Projection(include=("o_orderkey", "o_totalprice")))


@query(f"WITH {NODES_SQL} SELECT shared_id, name FROM nodes WHERE shared_id = 'C7'")
def find_by_shared_id(spark, sf):
    return store.find_all(nodes(spark, sf), Eq("shared_id", "C7")).select("shared_id", "name")


@query(f"WITH {NODES_SQL} SELECT 'id-' || shared_id AS _id, type FROM nodes WHERE shared_id = 'O9'")
def find_by_unique_id(spark, sf):
    return store.find_all(nodes(spark, sf), Eq("_id", "id-O9")).select("_id", "type")


@query("SELECT c_custkey AS _id, c_name FROM customer ORDER BY c_custkey LIMIT 40 OFFSET 80")
def page_continued(spark, sf):
    c = table(spark, sf, "customer").withColumnRenamed("c_custkey", "_id")
    return store.page(c, "_id", ascending=True, skip=80, limit=40).select("_id", "c_name")


@query(f"{TREE_SQL} SELECT e.event_id AS task, t.shared_id AS resource FROM events e JOIN tree t ON t.type = 'mesh' AND list_contains(t.ids, 'C' || e.user_id)")
def resource_expansion(spark, sf):
    tasks = table(spark, sf, "events").select(F.col("event_id").alias("task"), F.concat(F.lit("C"), F.col("user_id").cast("string")).alias("resource"))
    return sequence.expand_resources(tasks, tree.id_to_meshes(nodes(spark, sf))).select("task", "resource")


@query("""SELECT p_partkey AS id, 'brand=' || p_brand || ',name=' || p_name || ',size=' || p_size AS late, 'brand=' || p_brand || ',name=' || p_type || ',size=' || p_size AS first FROM part""")
def document_merge(spark, sf):
    p = table(spark, sf, "part")
    a, b = F.create_map(F.lit("name"), "p_type", F.lit("brand"), "p_brand"), F.create_map(F.lit("name"), "p_name", F.lit("size"), F.col("p_size").cast("string"))
    text = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return p.select(F.col("p_partkey").alias("id"), text(documents.merged(a, b)).alias("late"), text(documents.merged(a, b, unique=True)).alias("first"))


@query("SELECT a.o_orderkey AS id, a.o_custkey IS NOT DISTINCT FROM b.o_custkey AND a.o_orderstatus = 'P' AS same FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1")
def node_equality(spark, sf):
    """Materials with a checksum and a parent count that is null in one of them unless the order is open."""
    o = table(spark, sf, "orders")
    a = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("checksum"), F.when(F.col("o_orderstatus") != "P", 1).alias("n_parents")).alias("a")
    b = o.select((F.col("o_orderkey") - 1).alias("id"), F.col("o_custkey").alias("checksum")).alias("b")
    return a.join(b, F.col("a.id") == F.col("b.id")).select("a.id", documents.same_node(a, b, "material").alias("same"))


_KINDS = ["int16", "int32", "yes_no", "double", "string", "object", "void"]


@query("""WITH k AS (SELECT l_orderkey, l_linenumber, l_suppkey % 7 AS k, l_quantity AS q, l_suppkey FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE k WHEN 0 THEN 'int' WHEN 1 THEN 'long' WHEN 2 THEN 'bool' WHEN 3 THEN 'double' WHEN 4 THEN 'string' WHEN 5 THEN 'string' END AS tag,
 CASE k WHEN 0 THEN CAST(CAST(q AS BIGINT) AS VARCHAR) WHEN 1 THEN CAST(CAST(q AS BIGINT) AS VARCHAR) WHEN 2 THEN CASE WHEN q > 25 THEN 'true' ELSE 'false' END
  WHEN 3 THEN CAST(q AS VARCHAR) WHEN 4 THEN CAST(CAST(q AS BIGINT) AS VARCHAR) WHEN 5 THEN CASE WHEN q > 25 THEN 'named' ELSE CAST(CAST(q AS BIGINT) AS VARCHAR) END END AS value FROM k""")
def parameter_typing(spark, sf):
    c = F.col
    k, q = c("l_suppkey") % 7, c("l_quantity")
    kind = F.get(F.array(*map(F.lit, _KINDS)), k.cast("int"))
    raw = F.when(kind == "double", q.cast("string")).when(kind == "yes_no", (q > 25).cast("int").cast("string")).otherwise(q.cast("long").cast("string"))
    v = typing.parameter_value(F.when(kind == "yes_no", "int32").otherwise(kind), raw, kind == "yes_no", F.when(q > 25, "named").otherwise(""))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", v["tag"].alias("tag"), v["value"].alias("value"))


@query("""SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'double' WHEN 1 THEN 'string' WHEN 2 THEN 'string' WHEN 3 THEN 'datetime' WHEN 4 THEN 'string' END AS tag,
 CASE p_partkey % 5 WHEN 0 THEN CAST(CAST(p_size AS DOUBLE) AS VARCHAR) WHEN 1 THEN p_name || '.x' WHEN 2 THEN 'C:\\a/' || p_name || '.x'
  WHEN 3 THEN strftime(to_timestamp(p_partkey * 86400), '%Y-%m-%d %H:%M:%S') ELSE printf('%.6f, %.6f', CAST(p_size AS DOUBLE), CAST(p_partkey AS DOUBLE)) END AS value FROM part""")
def property_typing(spark, sf):
    c = F.col
    k = c("p_partkey") % 5
    kind = F.get(F.array(*map(F.lit, ("area", "display_string", "identifier_string", "datetime", "point2d"))), k.cast("int"))
    path = F.concat(F.lit("C:\\a/"), "p_name", F.lit(".x"))
    raw = F.when(k == 0, c("p_size").cast("string")).when(k == 3, (c("p_partkey") * 86400).cast("string")).otherwise(path)
    v = typing.property_value(kind, F.when(k == 1, "Source File").otherwise("Other"), raw, F.array(c("p_size").cast("double"), c("p_partkey").cast("double")), ["Source File"])
    return table(spark, sf, "part").select(c("p_partkey").alias("id"), v["tag"].alias("tag"), v["value"].alias("value"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'long' WHEN p_partkey % 3 = 1 THEN 'string' END AS tag, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS VARCHAR) WHEN p_partkey % 3 = 1 THEN p_name END AS value FROM part")
def mesh_property_typing(spark, sf):
    c = F.col
    k = c("p_partkey") % 3
    v = typing.mesh_property(F.when(k == 0, "uint64").otherwise("string"), F.when(k == 2, c("p_name")).otherwise("key"), F.when(k == 0, c("p_size").cast("string")).otherwise(c("p_name")))
    return table(spark, sf, "part").select(c("p_partkey").alias("id"), v["tag"].alias("tag"), v["value"].alias("value"))


@query("SELECT 'C' || o_custkey AS shared_id, 'M' || o_orderkey AS meta_id FROM orders UNION ALL SELECT 'X' || o_orderpriority, 'M' || o_orderkey FROM orders")
def node_metadata(spark, sf):
    o = table(spark, sf, "orders")
    meta = o.select(F.concat(F.lit("M"), F.col("o_orderkey").cast("string")).alias("_id"), F.array(F.concat(F.lit("C"), F.col("o_custkey").cast("string")), F.concat(F.lit("X"), "o_orderpriority")).alias("parents"))
    return metadata.of_nodes(meta)


@query("SELECT o_custkey AS cluster, l_orderkey AS mesh, l_linenumber AS part FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def cluster_geometry(spark, sf):
    clusters = table(spark, sf, "orders").select(F.col("o_orderkey").alias("mesh"), F.lit("r1").alias("rev_id"), F.col("o_custkey").alias("cluster"))
    geometry = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("mesh"), F.lit("r1").alias("rev_id"), F.col("l_linenumber").alias("part"))
    older = geometry.withColumn("rev_id", F.lit("r0"))
    return packing.with_geometry(clusters, geometry.union(older)).select("cluster", "mesh", "part")


@query("SELECT 'N' || c_nationkey AS shared_id, arg_max(c_mktsegment, c_custkey) AS branch FROM customer WHERE c_acctbal > 0 GROUP BY 1")
def floor_tags(spark, sf):
    """Branches that metadata with a floor tag give their parents; customers in debt have another tag."""
    entry = lambda k, v: F.struct(k.alias("key"), v.alias("value"))
    tags = F.array(entry(F.lit("Colour"), F.col("c_name")), entry(F.when(F.col("c_acctbal") > 0, "Floor").otherwise("Area"), F.col("c_mktsegment")))
    meta = table(spark, sf, "customer").select(F.col("c_custkey").alias("_id"), F.array(F.concat(F.lit("N"), F.col("c_nationkey").cast("string"))).alias("parents"), tags.alias("metadata"))
    return metadata.tagged_branches(meta, "Floor")
