"""Scene edits and commits: root transforms, offsets, revisions, element hierarchy, properties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.linear import IDENTITY, matrix, multiply
from ..sources.store import Store

#: Fixed value: the turn that makes a y-up model z-up.
REORIENT = [1, 0, 0, 0, 0, 0, 1, 0, 0, -1, 0, 0, 0, 0, 0, 1]


def transform_root(nodes: DataFrame, m: Column) -> DataFrame:
    """Applies m before the root's matrix; other nodes follow through the tree."""
    root = (F.col("type") == "transformation") & (F.coalesce(F.size("parents"), F.lit(0)) <= 0)
    return nodes.withColumn("matrix", F.when(root, multiply(m, F.coalesce("matrix", matrix(IDENTITY)))).otherwise(F.col("matrix")))


def scale(nodes: DataFrame, factor: float) -> DataFrame:
    return transform_root(nodes, matrix([factor, 0, 0, 0, 0, factor, 0, 0, 0, 0, factor, 0, 0, 0, 0, 1]))


def scale_offset(offset: Column, factor: float) -> Column:
    return F.transform(offset, lambda x: x * factor)


def reorient(nodes: DataFrame) -> DataFrame:
    return transform_root(nodes, matrix(REORIENT))


def reorient_offset(offset: Column) -> Column:
    return F.array(F.get(offset, F.lit(0)), F.get(offset, F.lit(2)), -F.get(offset, F.lit(1)))


def shift(nodes: DataFrame, by: list[float]) -> DataFrame:
    return transform_root(nodes, matrix([1, 0, 0, by[0], 0, 1, 0, by[1], 0, 0, 1, by[2], 0, 0, 0, 1]))


def element_parents(relations: DataFrame) -> DataFrame:
    """(element, parent): containment decides, then nesting or aggregation (kind), then the smallest id."""
    rank = F.when(F.col("kind") == "contains", 0).otherwise(1)
    return relations.groupBy("element").agg(F.min(F.struct(rank.alias("rank"), "parent")).alias("p")).select("element", F.col("p.parent").alias("parent"))


def type_groups(elements: DataFrame, parents: DataFrame) -> DataFrame:
    """Branches for elements under parents that are no elements themselves: (parent, kind, branch, n)."""
    placed = elements.join(parents, "element")
    outside = placed.join(elements.select(F.col("element").alias("parent")), "parent", "left_anti")
    return outside.groupBy("parent", "kind").agg(F.count("*").alias("n")).select("parent", "kind", F.concat_ws("/", "parent", "kind").alias("branch"), "n")


def commit(store: Store, database: str, project: str, revision: DataFrame, nodes: DataFrame, sequences: DataFrame | None = None) -> None:
    """Writes a revision as incomplete, then its nodes and sequences, then marks it complete; a reader
    that takes complete revisions only never sees half a scene."""
    rev = revision.select("_id").first()[0]
    store.insert(database, f"{project}.history", revision.withColumn("incomplete", F.lit(1)))
    store.insert(database, f"{project}.scene", nodes.withColumn("rev_id", F.lit(rev)))
    if sequences is not None:
        store.insert(database, f"{project}.sequences", sequences.withColumn("rev_id", F.lit(rev)))
    set_status(store, database, project, rev, None)


def set_status(store: Store, database: str, project: str, revision_id: str, status: int | None) -> None:
    history = store.read(database, f"{project}.history")
    new = F.lit(status).cast("int")
    store.replace(database, f"{project}.history", history.withColumn("incomplete", F.when(F.col("_id") == revision_id, new).otherwise(F.col("incomplete"))))


def load(store: Store, database: str, project: str, branch: str, statuses: tuple[int, ...] = ()) -> DataFrame:
    """Nodes of the branch's newest complete revision (or one of the given statuses)."""
    ok = F.col("incomplete").isNull()
    if statuses:
        ok = ok | F.col("incomplete").isin(*statuses)
    history = store.read(database, f"{project}.history").where(ok & (F.col("branch") == branch))
    head = history.orderBy(F.desc("timestamp"), "_id").limit(1).select(F.col("_id").alias("rev_id"))
    return store.read(database, f"{project}.scene").join(F.broadcast(head), "rev_id", "left_semi")  # one row
