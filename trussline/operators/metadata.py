"""Attaching metadata to nodes and typing its values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialize


def attach_by_name(nodes: DataFrame, meta: DataFrame, exact: bool = True) -> DataFrame:
    """(meta_id, shared_id): metadata on nodes of its name.

    Not exact: the node's name is cut at its first space, and both are compared in upper case.
    """
    key = F.col("name") if exact else F.upper(F.substring_index("name", " ", 1))
    left = nodes.select("shared_id", key.alias("_key"))
    right = meta.select(F.col("_id").alias("meta_id"), (F.col("name") if exact else F.upper("name")).alias("_key"))
    return right.join(left, "_key").select("meta_id", "shared_id")


def propagate(attached: DataFrame, nodes: DataFrame, below: DataFrame) -> DataFrame:
    """Moves metadata of a transformation to all its descendant meshes, if it has any.

    `below` is (shared_id, mesh) as `tree.id_to_meshes` gives it.
    """
    transformations = nodes.where("type = 'transformation'").select(F.col("shared_id").alias("_at"), F.lit(True).alias("_moves"))
    told = materialize(attached.join(transformations, F.col("shared_id") == F.col("_at"), "left").drop("_at"))
    lower = below.where("shared_id <> mesh").select(F.col("shared_id").alias("_at"), "mesh")  # a mesh is no transformation
    moved = told.where("_moves").join(lower, F.col("shared_id") == F.col("_at"), "left").select("meta_id", F.coalesce("mesh", "shared_id").alias("shared_id"))
    return told.where("_moves is null").select("meta_id", "shared_id").unionByName(moved).distinct()


def leaf_parents(nodes: DataFrame) -> DataFrame:
    """(meta_id, mesh): below a leaf transformation (no child transformations, all child meshes
    unnamed) each unnamed mesh becomes a parent of the transformation's metadata."""
    child = nodes.select("shared_id", "_id", "type", "name", F.explode("parents").alias("parent"))
    unnamed = (F.col("type") == "mesh") & (F.coalesce("name", F.lit("")) == "")
    leaf = (
        child.groupBy("parent")
        .agg(F.max((F.col("type") == "transformation").cast("int")).alias("t"), F.sum(F.when((F.col("type") == "mesh") & ~unnamed, 1).otherwise(0)).alias("named"))
        .where("t = 0 and named = 0")
        .select("parent")
    )
    meta = child.where("type = 'meta'").select("parent", F.col("_id").alias("meta_id"))
    return meta.join(leaf, "parent").join(child.where(unnamed).select("parent", F.col("shared_id").alias("mesh")), "parent").select("meta_id", "mesh")


def dropped(df: DataFrame, column: str, deny: list[str]) -> DataFrame:
    """Rows whose `column` is not on a deny list, in any case."""
    return df.where(~F.upper(column).isin([d.upper() for d in deny]))


def resolve_properties(properties: DataFrame) -> DataFrame:
    """(node, key) once: the direct property, else the nested, else the type-level one (rank)."""
    return properties.groupBy("node", "key").agg(F.min_by("value", F.struct("rank", "value")).alias("value"))


def of_nodes(meta: DataFrame) -> DataFrame:
    """(shared_id, meta_id): the metadata that name a node as a parent, one row each."""
    return meta.select(F.explode("parents").alias("shared_id"), F.col("_id").alias("meta_id"))


def tagged_branches(meta: DataFrame, key: str, order: str = "_id") -> DataFrame:
    """(shared_id, branch): the value of `key` in the metadata (array of key, value) of each parent; of several the last by `order`."""
    own = F.filter("metadata", lambda m: m["key"] == key)
    found = meta.where(F.exists("metadata", lambda m: m["key"] == key)).select(F.explode("parents").alias("shared_id"), F.element_at(own, -1)["value"].alias("branch"), order)
    return found.groupBy("shared_id").agg(F.max_by("branch", order).alias("branch"))
