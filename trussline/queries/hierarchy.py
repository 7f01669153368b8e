"""Scene graph, selection tree and metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import documents, linear
from ..operators import graph, metadata, scenes, tree
from .scene import NODES_SQL, TREE_SQL, nodes, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {NODES_SQL} SELECT parent, shared_id AS child FROM nodes WHERE parent IS NOT NULL")
def scene_edges(spark, sf):
    return graph.edges(nodes(spark, sf))


@query(f"WITH {NODES_SQL} SELECT c.shared_id, c.parent FROM nodes c JOIN nodes p ON c.parent = p.shared_id WHERE c.type = 'mesh' AND p.name LIKE '%1'")
def children_by_type(spark, sf):
    n = nodes(spark, sf)
    return graph.children_of(n, n.where("name like '%1'"), "mesh").select("shared_id", "parent")


@query(f"WITH {NODES_SQL} SELECT p.shared_id, c.shared_id AS child FROM nodes c JOIN nodes p ON c.parent = p.shared_id WHERE c.hidden AND p.type = 'transformation'")
def parents_by_type(spark, sf):
    n = nodes(spark, sf)
    return graph.parents_of(n, n.where("hidden"), "transformation").select("shared_id", "child")


@query(f"{TREE_SQL} SELECT t.ids[3] AS ancestor, t.shared_id AS descendant FROM tree t WHERE t.type = 'mesh' AND t.ids[3] LIKE 'N%'")
def descendants_by_type(spark, sf):
    n = nodes(spark, sf)
    return graph.descendants(n, n.where("shared_id like 'N%'"), "mesh")


@query(f"{TREE_SQL} SELECT a.anc AS ancestor, t.shared_id AS descendant, CAST(t.depth - a.i + 1 AS INTEGER) AS depth FROM tree t, LATERAL (SELECT unnest(t.ids) AS anc, generate_subscripts(t.ids, 1) AS i) a WHERE a.anc <> t.shared_id")
def scene_closure(spark, sf):
    return graph.closure(graph.edges(nodes(spark, sf)))


@query(f"{TREE_SQL} SELECT shared_id, path FROM tree")
def tree_paths(spark, sf):
    return graph.paths(nodes(spark, sf)).select("shared_id", "path")


_WORLD = "ws AS scale, wx AS x, wy AS y, wz AS z"


def _world(df, key):
    m = F.col("world")
    return df.select(key, F.get(m, F.lit(0)).alias("scale"), *(F.get(m, F.lit(4 * r + 3)).alias(n) for r, n in enumerate("xyz")))


@query(f"{TREE_SQL} SELECT shared_id, {_WORLD} FROM tree WHERE type = 'transformation'")
def world_transforms(spark, sf):
    return _world(graph.world_transforms(nodes(spark, sf)), "shared_id")


@query(f"{TREE_SQL} SELECT shared_id AS mesh, {_WORLD} FROM tree WHERE hidden")
def sparse_world_transforms(spark, sf):
    n = nodes(spark, sf)
    return _world(graph.sparse_world_transforms(n, n.where("hidden")), "mesh")


@query(f"{TREE_SQL} SELECT shared_id, branch FROM tree WHERE type = 'transformation'")
def floor_branch(spark, sf):
    return graph.world_transforms(nodes(spark, sf), "floor").select("shared_id", "branch")


def _mesh_boxes(n):
    """Unit boxes moved by the key, in their parents' frames, as world boxes."""
    k = F.regexp_extract("shared_id", r"(\d+)", 1).try_cast("long")
    lo = [(k % 10).cast("double"), (k % 20).cast("double"), (k % 30).cast("double")]
    hi = [c + 1 + (k % 2) for c in lo]
    meshes = n.where("type = 'mesh'").select("shared_id", F.get("parents", F.lit(0)).alias("parent"), *(c.alias(f"lo{i}") for i, c in enumerate(lo)), *(c.alias(f"hi{i}") for i, c in enumerate(hi)))
    low, high = linear.box_transformed(F.col("world"), [F.col(f"lo{i}") for i in range(3)], [F.col(f"hi{i}") for i in range(3)])
    return graph.in_world(meshes, graph.world_transforms(n)).select("shared_id", "parent", *(c.alias(f"lo{i}") for i, c in enumerate(low)), *(c.alias(f"hi{i}") for i, c in enumerate(high)))


_BOXES = TREE_SQL + """, mesh AS (
  SELECT shared_id, ids, ws * (k % 10) + wx AS lo0, ws * (k % 20) + wy AS lo1, ws * (k % 30) + wz AS lo2,
         ws * (k % 10 + 1 + k % 2) + wx AS hi0, ws * (k % 20 + 1 + k % 2) + wy AS hi1, ws * (k % 30 + 1 + k % 2) + wz AS hi2
  FROM (SELECT *, CAST(substr(shared_id, 2) AS BIGINT) AS k FROM tree WHERE type = 'mesh'))
"""
_BOUNDS = ", ".join([f"min(lo{i}) AS lo{i}" for i in range(3)] + [f"max(hi{i}) AS hi{i}" for i in range(3)])


def _bounds(df, *by):
    return df.groupBy(*by).agg(*(F.min(f"lo{i}").alias(f"lo{i}") for i in range(3)), *(F.max(f"hi{i}").alias(f"hi{i}") for i in range(3)))


@query(f"{_BOXES} SELECT {_BOUNDS} FROM mesh")
def scene_bounds(spark, sf):
    return _bounds(_mesh_boxes(nodes(spark, sf)))


@query(f"{_BOXES} SELECT ids[4] AS parent, {_BOUNDS} FROM mesh GROUP BY 1")
def bounds_by_parent(spark, sf):
    return _bounds(_mesh_boxes(nodes(spark, sf)), "parent")


_HIDDEN = "(hidden OR (type = 'mesh' AND name LIKE '%(IFC Space)%'))"


@query(f"{TREE_SQL}, above AS (SELECT DISTINCT unnest(ids[:-2]) AS shared_id FROM tree WHERE {_HIDDEN}) SELECT t.shared_id, CASE WHEN {_HIDDEN} THEN 'invisible' WHEN a.shared_id IS NOT NULL THEN 'parentOfInvisible' ELSE 'visible' END AS state FROM tree t LEFT JOIN above a USING (shared_id)")
def toggle_state(spark, sf):
    return tree.toggle_states(nodes(spark, sf))


@query(f"{TREE_SQL} SELECT unnest(ids) AS shared_id, shared_id AS mesh FROM tree WHERE type = 'mesh'")
def id_to_meshes(spark, sf):
    return tree.id_to_meshes(nodes(spark, sf))


@query(f"{TREE_SQL} SELECT shared_id, depth FROM tree")
def node_depths(spark, sf):
    return graph.paths(nodes(spark, sf)).select("shared_id", (F.size("ids") - 1).alias("depth"))


@query(f"WITH {NODES_SQL} SELECT shared_id, 'id-' || shared_id AS _id FROM nodes")
def id_map(spark, sf):
    return tree.id_map(nodes(spark, sf))


@query(f"WITH {NODES_SQL} SELECT shared_id AS hidden_node FROM nodes WHERE {_HIDDEN}")
def hidden_nodes(spark, sf):
    return tree.model_properties(nodes(spark, sf))


_TREE_BYTES = 30_000


def _json_sql(depth: int) -> str:
    """Tables l4 to l0 of the documents of each level, bottom up, as text is cut."""
    own = """'{"account":"a","project":"p","type":"' || type || CASE WHEN name <> '' THEN '","name":"' || name ELSE '' END || '","path":"' || path || '","_id":"id-' || shared_id || '","shared_id":"' || shared_id || '"'"""
    end = """',"toggleState":"' || state || '"}'"""
    out = [f"l{depth} AS (SELECT shared_id, parent, name, rank, {own} || {end} AS tree FROM n WHERE depth = {depth})"]
    for k in range(depth - 1, -1, -1):
        below = f"l{k + 1}"
        out.append(f"s{k} AS (SELECT parent, sum(strlen(tree) + 1) AS bytes, count(*) AS c, string_agg(tree, ',' ORDER BY rank, name, shared_id) AS t FROM {below} GROUP BY 1)")
        inside = f"""coalesce(CASE WHEN bytes <= {_TREE_BYTES} THEN ',"children":[' || t || ']' ELSE ',"cutChildren":' || c END, '')"""
        out.append(f"l{k} AS (SELECT n.shared_id, n.parent, name, rank, {own} || {inside} || {end} AS tree FROM n LEFT JOIN s{k} s ON s.parent = n.shared_id WHERE depth = {k})")
    cut = " UNION ALL ".join(f"SELECT l.shared_id, l.parent, tree FROM l{k + 1} l JOIN s{k} s ON s.parent = l.parent WHERE bytes > {_TREE_BYTES}" for k in range(depth))
    return ", ".join(out) + f" SELECT shared_id, parent, tree FROM l0 UNION ALL {cut}"


@query(f"""{TREE_SQL}, above AS (SELECT DISTINCT unnest(ids[:-2]) AS shared_id FROM tree WHERE {_HIDDEN}),
n AS (SELECT t.shared_id, CASE WHEN len(ids) > 1 THEN ids[-2] END AS parent, type, name, path, depth, CASE WHEN contains(name, '(IFC Space)') THEN 0 ELSE 1 END AS rank,
 CASE WHEN {_HIDDEN} THEN 'invisible' WHEN a.shared_id IS NOT NULL THEN 'parentOfInvisible' ELSE 'visible' END AS state FROM tree t LEFT JOIN above a USING (shared_id)),
{_json_sql(4)}""")
def selection_tree_json(spark, sf):
    """The scene as nested documents of about 30,000 bytes at most."""
    n = nodes(spark, sf)
    routes = graph.paths(n)
    return tree.tree_documents(n, tree.toggle_states(n, routes), "a", "p", most=_TREE_BYTES, routes=routes)


@query("SELECT CAST(NULL AS VARCHAR) AS shared_id, CAST(NULL AS VARCHAR) AS change WHERE false UNION ALL SELECT 'O' || o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'removed' ELSE 'modified' END FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 UNION ALL SELECT 'new', 'added'")
def change_set(spark, sf):
    old = nodes(spark, sf)
    k = F.regexp_extract("shared_id", r"^O(\d+)$", 1)
    key = F.when(k != "", k.cast("long"))
    new = old.where(key.isNull() | (key % 5 != 0)).withColumn("hidden", F.when(key % 7 == 0, ~F.col("hidden")).otherwise(F.col("hidden")))
    added = old.limit(1).withColumn("shared_id", F.lit("new"))
    return graph.change_set(old, new.union(added))


def _meta(spark, sf):
    """Metadata named after customers (in other case) and nations."""
    c = table(spark, sf, "customer").select(F.concat(F.lit("m"), F.col("c_custkey").cast("string")).alias("_id"), F.upper("c_name").alias("name"))
    return c.union(table(spark, sf, "nation").select(F.concat(F.lit("mn"), F.col("n_nationkey").cast("string")), "n_name"))


_META = "meta AS (SELECT 'm' || c_custkey AS _id, upper(c_name) AS name FROM customer UNION ALL SELECT 'mn' || n_nationkey, n_name FROM nation)"


@query(f"WITH {NODES_SQL}, {_META} SELECT _id AS meta_id, shared_id FROM nodes JOIN meta USING (name)")
def metadata_attach_exact(spark, sf):
    return metadata.attach_by_name(nodes(spark, sf), _meta(spark, sf))


_LOOSE = f"{NODES_SQL}, {_META}, att AS (SELECT _id AS meta_id, shared_id FROM nodes JOIN meta ON upper(split_part(nodes.name, ' ', 1)) = upper(meta.name))"


@query(f"WITH {_LOOSE} SELECT * FROM att")
def metadata_attach_prefix(spark, sf):
    return metadata.attach_by_name(nodes(spark, sf), _meta(spark, sf), exact=False)


@query(f"{TREE_SQL}, {_META}, att AS (SELECT _id AS meta_id, shared_id FROM nodes JOIN meta ON upper(split_part(nodes.name, ' ', 1)) = upper(meta.name)), below AS (SELECT unnest(ids) AS shared_id, shared_id AS mesh FROM tree WHERE type = 'mesh') SELECT DISTINCT meta_id, coalesce(mesh, att.shared_id) AS shared_id FROM att LEFT JOIN below ON att.shared_id = below.shared_id")
def metadata_attach_propagate(spark, sf):
    n = nodes(spark, sf)
    return metadata.propagate(metadata.attach_by_name(n, _meta(spark, sf), exact=False), n, tree.id_to_meshes(n))


@query(f"""WITH {NODES_SQL}, leaf AS (SELECT parent FROM nodes WHERE parent IS NOT NULL GROUP BY parent HAVING bool_and(type = 'mesh' AND name NOT LIKE 'Room%'))
SELECT 'meta-' || n.parent AS meta_id, n.shared_id AS mesh FROM nodes n JOIN leaf USING (parent)""")
def leaf_metadata_parents(spark, sf):
    """Meshes without a name, all but rooms here, take the metadata of a parent that has no other children."""
    plain = (F.col("type") == "mesh") & ~F.col("name").startswith("Room")
    n = nodes(spark, sf).select("shared_id", "_id", "type", F.when(plain, "").otherwise(F.col("name")).alias("name"), "parents")
    meta = n.where("shared_id like 'C%'").select(F.concat(F.lit("M"), "shared_id").alias("shared_id"), F.concat(F.lit("meta-"), "shared_id").alias("_id"), F.lit("meta").alias("type"), F.lit("m").alias("name"), F.array("shared_id").alias("parents"))
    return metadata.leaf_parents(n.union(meta))


@query("""WITH mat AS (SELECT 'mat' || p_partkey AS m, 'O' || (p_partkey * 3) AS mesh FROM part), tex AS (SELECT 'tex' || p_partkey AS t, 'mat' || (p_partkey * 2) AS m FROM part)
SELECT 'O' || o_orderkey AS mesh, min(t) AS texture FROM orders LEFT JOIN mat ON mesh = 'O' || o_orderkey LEFT JOIN tex USING (m) GROUP BY 1""")
def texture_for_mesh(spark, sf):
    """Mesh to first material to first texture, along two parent links."""
    of = lambda prefix, k: F.concat(F.lit(prefix), k.cast("string"))
    k = F.col("p_partkey")
    p = table(spark, sf, "part")
    node = lambda kind, own, above: p.select(of(own, k).alias("shared_id"), F.lit(kind).alias("type"), F.array(above).alias("parents"))
    n = node("material", "mat", of("O", k * 3)).union(node("texture", "tex", of("mat", k * 2)))
    meshes = table(spark, sf, "orders").select(of("O", F.col("o_orderkey")).alias("shared_id"))
    found = graph.textures_of(n, meshes).groupBy("mesh").agg(F.min("texture").alias("texture"))
    return meshes.withColumnRenamed("shared_id", "mesh").join(found, "mesh", "left").select("mesh", "texture")


@query("SELECT p_brand AS node, p_type AS key, min_by(p_name, CAST(p_size % 3 AS VARCHAR) || p_name) AS value FROM part GROUP BY 1, 2")
def property_precedence(spark, sf):
    """Direct before nested before type-level values of one key."""
    return metadata.resolve_properties(table(spark, sf, "part").select(F.col("p_brand").alias("node"), F.col("p_type").alias("key"), F.col("p_name").alias("value"), (F.col("p_size") % 3).alias("rank")))


@query("SELECT p_partkey, p_name FROM part WHERE lower(p_type) NOT IN ('economy', 'small')")
def metadata_deny_list(spark, sf):
    return metadata.dropped(table(spark, sf, "part"), "p_type", ["Economy", "small"]).select("p_partkey", "p_name")


def _relations(spark, sf):
    c = F.col
    return table(spark, sf, "lineitem").select(
        c("l_orderkey").alias("element"), F.concat(F.lit("P"), (c("l_partkey") % 50).cast("string")).alias("parent"), F.when(c("l_returnflag") == "A", "contains").otherwise("aggregates").alias("kind")
    )


_PARENTS = "SELECT l_orderkey AS element, min_by('P' || (l_partkey % 50), CASE WHEN l_returnflag = 'A' THEN '0' ELSE '1' END || 'P' || (l_partkey % 50)) AS parent FROM lineitem GROUP BY 1"


@query(_PARENTS)
def element_parents(spark, sf):
    return scenes.element_parents(_relations(spark, sf))


@query(f"WITH p AS ({_PARENTS}) SELECT parent, o_orderpriority AS kind, parent || '/' || o_orderpriority AS branch, count(*) AS n FROM p JOIN orders ON element = o_orderkey GROUP BY ALL")
def element_type_groups(spark, sf):
    elements = table(spark, sf, "orders").select(F.col("o_orderkey").alias("element"), F.col("o_orderpriority").alias("kind"))
    parents = scenes.element_parents(_relations(spark, sf))
    # parents are never elements here: give both one type
    return scenes.type_groups(elements.withColumn("element", F.col("element").cast("string")), parents.withColumn("element", F.col("element").cast("string")))


@query(f"{TREE_SQL} SELECT shared_id, 10 * ws AS scale, 10 * wx AS x, 10 * wy AS y, 10 * wz AS z FROM tree WHERE type = 'transformation'")
def scaled_world_transforms(spark, sf):
    return _world(graph.world_transforms(scenes.scale(nodes(spark, sf), 10.0)), "shared_id")


@query(f"{TREE_SQL} SELECT shared_id, ws AS scale, wx AS x, wz AS y, -wy AS z FROM tree WHERE type = 'transformation' AND depth > 0")
def reoriented_offsets(spark, sf):
    m = F.col("world")
    w = graph.world_transforms(scenes.reorient(nodes(spark, sf))).where("shared_id <> 'root'")
    return w.select("shared_id", F.get(m, F.lit(0)).alias("scale"), *(F.get(m, F.lit(4 * r + 3)).alias(n) for r, n in enumerate("xyz")))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'c_custkey,c_mktsegment,c_name' ELSE 'balance,c_custkey,c_mktsegment,c_name' END AS fields FROM customer")
def document_fields(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"))
    return c.select("c_custkey", F.array_join(documents.field_names(c), ",").alias("fields"))


@query("SELECT count(DISTINCT (p_brand, p_type, p_size % 4)) AS materials FROM part")
def material_checksums(spark, sf):
    p = table(spark, sf, "part").withColumn("shine", F.col("p_size") % 4)
    return p.agg(F.countDistinct(documents.material_checksum(["p_brand", "p_type", "shine"])).alias("materials"))


@query("SELECT event_id, event_type AS name, CAST(value AS VARCHAR) AS unit FROM events WHERE event_type <> 'view'")
def xml_linkages(spark, sf):
    """XML leaves as entries; one leaf is missing where the type is view."""
    c = F.col
    body = F.concat(F.lit("<e><n>"), c("event_type"), F.lit("</n>"), F.when(c("event_type") == "view", "").otherwise(F.concat(F.lit("<u>"), c("value").cast("string"), F.lit("</u>"))), F.lit("</e>"))
    leaves = table(spark, sf, "events").select("event_id", documents.xml_leaves(body, {"name": "/e/n", "unit": "/e/u"}).alias("l")).where(F.size("l") == 2)
    return leaves.select("event_id", F.get("l", F.lit(0))["value"].alias("name"), F.get("l", F.lit(1))["value"].alias("unit"))
