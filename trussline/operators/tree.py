"""Selection tree: visibility fold, descendant meshes, id maps and nested JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialize
from .graph import paths

SPACE = "(IFC Space)"


def hidden(nodes: DataFrame) -> DataFrame:
    """Nodes hidden by default: flagged ones and meshes named as spaces."""
    return nodes.where(F.col("hidden") | ((F.col("type") == "mesh") & F.contains(F.col("name"), F.lit(SPACE))))


def toggle_states(nodes: DataFrame, routes: DataFrame | None = None) -> DataFrame:
    """(shared_id, state): invisible, parentOfInvisible if something hidden lies below, else visible."""
    routes = paths(nodes) if routes is None else routes
    gone = hidden(nodes).select("shared_id", F.lit(True).alias("_hidden"))
    above = routes.join(gone.drop("_hidden"), "shared_id").select(F.explode(F.slice("ids", 1, F.size("ids") - 1)).alias("shared_id")).distinct().withColumn("_above", F.lit(True))
    state = F.when(F.col("_hidden"), "invisible").when(F.col("_above"), "parentOfInvisible").otherwise("visible")
    return routes.select("shared_id").join(gone, "shared_id", "left").join(above, "shared_id", "left").select("shared_id", state.alias("state"))


def id_to_meshes(nodes: DataFrame, routes: DataFrame | None = None) -> DataFrame:
    """(shared_id, mesh) for every mesh at or below a node: one row each, no list to outgrow a task."""
    routes = paths(nodes) if routes is None else routes
    meshes = nodes.where("type = 'mesh'").select("shared_id")
    return routes.join(meshes, "shared_id").select(F.col("shared_id").alias("mesh"), F.explode("ids").alias("shared_id")).select("shared_id", "mesh")


def id_map(nodes: DataFrame) -> DataFrame:
    return nodes.select("shared_id", "_id")


def model_properties(nodes: DataFrame) -> DataFrame:
    """Hidden nodes, the only model properties."""
    return hidden(nodes).select(F.col("shared_id").alias("hidden_node"))


#: Bytes of children's text that a document holds.
MOST_BYTES = 64 << 20


def _text(**columns) -> Column:
    """The inside of a JSON object of these columns; nulls are left out."""
    return F.regexp_extract(F.to_json(F.struct(*(F.coalesce(c, F.lit(None).cast("string")).alias(k) for k, c in columns.items()))), r"(?s)^\{(.*)\}$", 1)


def tree_documents(nodes: DataFrame, states: DataFrame, account: str = "", project: str = "", metadata: DataFrame | None = None, most: int = MOST_BYTES, routes: DataFrame | None = None) -> DataFrame:
    """(shared_id, parent, tree): the nested JSON of the scene, a document a row.

    Documents are folded from the deepest level up, a grouped aggregate a level: a node's text holds those of its children, spaces
    first, then by name and id.  Where the children's text would be above `most` bytes (summed first), each stays a document of
    its own, `parent` names their node, and its text counts them as `cutChildren`.  So no row is above the bound by more than a
    node's own text, a node may have any number of children, and a scene that is small enough is one document.
    `metadata` (_id, parents) is listed at the nodes it belongs to.
    """
    routes = paths(nodes) if routes is None else routes
    own = routes.join(nodes.select("shared_id", "_id", "name", "type", F.get("parents", F.lit(0)).alias("parent")), "shared_id").join(states, "shared_id")
    listed = None
    if metadata is not None:
        quoted = F.transform(F.array_sort(F.collect_list("_id")), lambda x: F.concat(F.lit('"'), x, F.lit('"')))
        listed = metadata.select("_id", F.explode("parents").alias("shared_id")).groupBy("shared_id").agg(F.concat(F.lit(',"meta":['), F.array_join(quoted, ","), F.lit("]")).alias("_meta"))
    own = own.join(listed, "shared_id", "left") if listed is not None else own.withColumn("_meta", F.lit(None).cast("string"))
    head = _text(account=F.lit(account), project=F.lit(project), type=F.col("type"), name=F.nullif("name", F.lit("")), path=F.col("path"), _id=F.col("_id"), shared_id=F.col("shared_id"))
    tail = F.concat(F.coalesce("_meta", F.lit("")), F.lit(","), _text(toggleState=F.col("state")))
    rows = materialize(own.select("shared_id", "parent", (F.size("ids") - 1).alias("depth"), F.when(F.contains("name", F.lit(SPACE)), 0).otherwise(1).alias("rank"), "name", head.alias("head"), tail.alias("tail")))
    deepest = rows.agg(F.max("depth")).first()[0]
    done, below = [], None
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        level = rows.where(F.col("depth") == depth)
        if below is None:
            inside = F.lit("")
        else:
            sizes = below.groupBy("parent").agg(F.sum(F.octet_length("tree") + 1).alias("bytes"), F.count("*").alias("n")).withColumnRenamed("parent", "_of")
            sizes = materialize(sizes)
            fit = below.join(sizes.where(F.col("bytes") <= most).select("_of"), F.col("parent") == F.col("_of")).drop("_of")
            done.append(below.join(sizes.where(F.col("bytes") > most).select("_of"), F.col("parent") == F.col("_of")).select("shared_id", "parent", "tree"))
            listed_ = F.transform(F.array_sort(F.collect_list(F.struct("rank", "name", "shared_id", "tree"))), lambda c: c["tree"])
            joined = fit.groupBy(F.col("parent").alias("_p")).agg(F.concat(F.lit(',"children":['), F.array_join(listed_, ","), F.lit("]")).alias("_children"))
            level = level.join(joined, F.col("shared_id") == F.col("_p"), "left").join(sizes.where(F.col("bytes") > most), F.col("shared_id") == F.col("_of"), "left")
            inside = F.coalesce(F.col("_children"), F.concat(F.lit(',"cutChildren":'), F.col("n").cast("string")), F.lit(""))
        text = F.concat(F.lit("{"), F.col("head"), inside, F.col("tail"), F.lit("}"))
        below = materialize(level.select("shared_id", "parent", "rank", "name", text.alias("tree")))
    if below is None:
        return rows.select("shared_id", "parent", F.col("head").alias("tree"))
    return reduce(DataFrame.union, done, below.select("shared_id", "parent", "tree"))


def write_documents(nodes: DataFrame, path: str, account: str = "", project: str = "", most: int = MOST_BYTES) -> None:
    """Writes fulltree, tree_path, idMap, idToMeshes and, if something is hidden, modelProperties as
    JSON lines in folders of these names."""
    routes = paths(nodes)
    routes = materialize(routes)
    tree_documents(nodes, toggle_states(nodes, routes), account, project, most=most, routes=routes).select("tree").write.text(f"{path}/fulltree")
    routes.select("shared_id", "path").write.json(f"{path}/tree_path")
    id_map(nodes).write.json(f"{path}/idMap")
    id_to_meshes(nodes, routes).write.json(f"{path}/idToMeshes")
    properties = model_properties(nodes)
    if not properties.isEmpty():
        properties.write.json(f"{path}/modelProperties")
