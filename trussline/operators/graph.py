"""Scene-graph operators: edges, closure, paths, world transforms, inherited values, folds.

Hierarchies are walked level by level: each level is one join of the frontier with the edges, written
to the shared folder, so depth costs jobs but never memory on the driver, and the walk stops when a
level is empty.  What every level joins is written once before the first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.linear import IDENTITY, matrix, multiply
from ..plans.scratch import counted, materialize

MAX_DEPTH = 256


def edges(nodes: DataFrame) -> DataFrame:
    """(parent, child) for every parent a node names; graph identity is shared_id."""
    return nodes.select(F.explode("parents").alias("parent"), F.col("shared_id").alias("child"))


def children_of(nodes: DataFrame, parents: DataFrame, kind: str | None = None) -> DataFrame:
    """Nodes whose parents hold a shared_id of `parents`, once for each such parent."""
    e = edges(nodes).join(parents.select(F.col("shared_id").alias("parent")), "parent")
    found = e.join(nodes, e.child == nodes.shared_id).drop("child")
    return found if kind is None else found.where(F.col("type") == kind)


def parents_of(nodes: DataFrame, children: DataFrame, kind: str | None = None) -> DataFrame:
    e = edges(children)
    found = e.join(nodes, e.parent == nodes.shared_id).drop("parent")
    return found if kind is None else found.where(F.col("type") == kind)


def walk(start: DataFrame, step, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Union of start, step(start), step(step(start)), ... until a level has no rows."""
    levels = [materialize(start)]
    while len(levels) <= max_depth:
        following, n = counted(step(levels[-1]))
        if not n:
            return reduce(DataFrame.unionByName, levels)
        levels.append(following)
    raise RecursionError(f"deeper than {max_depth} levels: is there a cycle?")


def closure(e: DataFrame) -> DataFrame:
    """(ancestor, descendant, depth) with depth >= 1; a node reachable twice is there twice."""
    e = materialize(e)
    start = e.select(F.col("parent").alias("ancestor"), F.col("child").alias("descendant"), F.lit(1).alias("depth"))
    return walk(start, lambda f: f.join(e, f.descendant == e.parent).select("ancestor", F.col("child").alias("descendant"), (F.col("depth") + 1).alias("depth")))


def descendants(nodes: DataFrame, of: DataFrame, kind: str) -> DataFrame:
    """(ancestor, descendant) of one type below the nodes of `of`, with multiplicity."""
    e = materialize(edges(nodes))
    start = of.select(F.col("shared_id").alias("ancestor"), F.col("shared_id").alias("descendant"))
    below = walk(start, lambda f: f.join(e, f.descendant == e.parent).select("ancestor", F.col("child").alias("descendant")))
    typed = nodes.where(F.col("type") == kind).select(F.col("shared_id").alias("descendant"))
    return below.where("ancestor <> descendant").join(typed, "descendant").select("ancestor", "descendant")


def roots(nodes: DataFrame) -> DataFrame:
    """Transformations without parents; a scene has one."""
    return nodes.where((F.col("type") == "transformation") & (F.coalesce(F.size("parents"), F.lit(0)) <= 0))


def root(nodes: DataFrame) -> DataFrame:
    """The root of a scene; a scene without one, or with two, raises."""
    found = materialize(roots(nodes))
    n = found.limit(2).count()
    if n != 1:
        raise ValueError("the scene has no root" if not n else "the scene has more than one root")
    return found


def textures_of(nodes: DataFrame, meshes: DataFrame) -> DataFrame:
    """(mesh, texture): the textures of the materials of `meshes` (shared_id), a row each; none for a mesh without."""
    used = children_of(nodes, meshes, "material").select(F.col("parent").alias("mesh"), F.col("shared_id").alias("parent"))
    textures = edges(nodes.where("type = 'texture'"))
    return used.join(textures, "parent").select("mesh", F.col("child").alias("texture")).distinct()


def in_world(meshes: DataFrame, worlds: DataFrame) -> DataFrame:
    """`meshes` (with parent) and the world matrix of their parent; a mesh whose parent has none raises."""
    found = meshes.join(worlds.select(F.col("shared_id").alias("_of"), F.col("world").alias("_world")), F.col("parent") == F.col("_of"), "left")
    lost = F.raise_error(F.concat(F.lit("no transformation above mesh "), F.col("shared_id"))).cast("array<double>")
    return found.withColumn("world", F.when(F.col("_of").isNull(), lost).otherwise(F.col("_world"))).drop("_of", "_world")


def has_missing_nodes(nodes: DataFrame) -> DataFrame:
    """One row: does a node other than a transformation lack parents, or name one that is not there?"""
    orphan = nodes.where((F.col("type") != "transformation") & (F.coalesce(F.size("parents"), F.lit(0)) <= 0)).select(F.lit(1).alias("x"))
    dangling = edges(nodes).join(nodes.select(F.col("shared_id").alias("parent")), "parent", "left_anti").select(F.lit(1).alias("x"))
    return orphan.union(dangling).agg((F.count("*") > 0).alias("missing"))


def paths(nodes: DataFrame, separator: str = "__") -> DataFrame:
    """(shared_id, path array from the root, path text) along first parents."""
    first = materialize(nodes.select("shared_id", F.get("parents", F.lit(0)).alias("parent")))
    start = roots(nodes).select("shared_id", F.array("shared_id").alias("ids"))
    down = walk(start, lambda f: f.select(F.col("shared_id").alias("parent"), "ids").join(first, "parent").select("shared_id", F.array_append("ids", F.col("shared_id")).alias("ids")))
    return down.select("shared_id", "ids", F.array_join("ids", separator).alias("path"))


def world_transforms(nodes: DataFrame, tag: str | None = None) -> DataFrame:
    """World matrix (parent times local) of every transformation, and the nearest `tag` above or at it."""
    t = materialize(nodes.where("type = 'transformation'").select("shared_id", F.get("parents", F.lit(0)).alias("parent"), F.coalesce("matrix", matrix(IDENTITY)).alias("local"), (F.col(tag) if tag else F.lit(None).cast("string")).alias("own")))
    start = t.where("parent is null").select("shared_id", F.col("local").alias("world"), F.col("own").alias("branch"))
    return walk(
        start,
        lambda f: f.select(F.col("shared_id").alias("parent"), "world", "branch").join(t, "parent").select("shared_id", multiply(F.col("world"), F.col("local")).alias("world"), F.coalesce("own", "branch").alias("branch")),
    )


def sparse_world_transforms(nodes: DataFrame, meshes: DataFrame) -> DataFrame:
    """World matrix above each of `meshes`, walking up only from them (first parents)."""
    t = materialize(nodes.where("type = 'transformation'").select(F.col("shared_id").alias("up"), F.get("parents", F.lit(0)).alias("next"), F.coalesce("matrix", matrix(IDENTITY)).alias("local")))
    start = meshes.select(F.col("shared_id").alias("mesh"), F.get("parents", F.lit(0)).alias("up"), matrix(IDENTITY).alias("world"))
    climbed = walk(start, lambda f: f.where("up is not null").join(t, "up").select("mesh", F.col("next").alias("up"), multiply(F.col("local"), F.col("world")).alias("world")))
    return climbed.where("up is null").select("mesh", "world")


def set_parents(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Adds (child, parent) links; existing ones stay once."""
    new = links.groupBy(F.col("child").alias("shared_id")).agg(F.array_sort(F.collect_set("parent")).alias("_add"))
    none = F.array().cast("array<string>")
    return nodes.join(new, "shared_id", "left").withColumn("parents", F.array_union(F.coalesce("parents", none), F.coalesce("_add", none))).select(*nodes.columns)


def abandon(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Removes (child, parent) links; nodes stay."""
    gone = links.groupBy(F.col("child").alias("shared_id")).agg(F.collect_set("parent").alias("_gone"))
    return nodes.join(gone, "shared_id", "left").withColumn("parents", F.when(F.col("_gone").isNull(), F.col("parents")).otherwise(F.array_except("parents", "_gone"))).select(*nodes.columns)


def change_set(before: DataFrame, after: DataFrame, key: str = "shared_id") -> DataFrame:
    """(key, change) with added, removed or modified."""
    hashed = lambda df, n: df.select(F.col(key), F.xxhash64(*sorted(df.columns)).alias(n))
    both = hashed(before, "_a").join(hashed(after, "_b"), key, "full_outer")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "modified")
    return both.select(key, change.alias("change")).where("change is not null")
