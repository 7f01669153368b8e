"""Mesh batches, sequences, runs and jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import values
from ..operators import packing, sequence
from ..plans import scratch
from ..streaming import jobs
from .scene import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: Factors and moduli that place orders in space, no two in one spot.
_SPOTS = ((7919, 100003), (104729, 99991), (1299709, 99989))


def _meshes(spark, sf):
    """Orders as meshes: vertices from the price, extents from the key, grouped by priority."""
    c = F.col
    extents = [(1 + c("o_orderkey") % m).cast("double") for m in (7, 5, 3)]
    vertices = F.floor(c("o_totalprice")).cast("long")
    return table(spark, sf, "orders").select(
        c("o_orderkey").alias("id"), c("o_orderpriority").alias("grouping"), c("o_custkey").alias("customer"), vertices.alias("vertices"), F.floor(vertices / 2).cast("long").alias("faces"),
        packing.efficiency(vertices, extents).alias("efficiency"), *(((c("o_orderkey") * p) % m).cast("double").alias(f"lo{k}") for k, (p, m) in enumerate(_SPOTS)), *((((c("o_orderkey") * p) % m) + extents[k]).alias(f"hi{k}") for k, (p, m) in enumerate(_SPOTS)),
    )


_M = "m AS (SELECT o_orderkey AS id, o_orderpriority AS grouping, o_custkey AS customer, CAST(floor(o_totalprice) AS BIGINT) AS vertices, floor(o_totalprice) / ((1 + o_orderkey % 7) + (1 + o_orderkey % 5) + (1 + o_orderkey % 3)) AS efficiency, " + ", ".join(f"(o_orderkey * {p}) % {m} + (1 + o_orderkey % {e}) / 2.0 AS c{k}" for k, ((p, m), e) in enumerate(zip(_SPOTS, (7, 5, 3)))) + " FROM orders)"


def subtrees_sql(items: str, key: str, place: str, total: str, most: str, levels: int = 60) -> str:
    """Tables coded and told (key, code, level, node): places on a curve of 20 bits an axis, and the largest subtree above each
    whose total is small enough."""
    cell = "CASE WHEN max(c{k}) OVER g > min(c{k}) OVER g THEN CAST(least(floor((c{k} - min(c{k}) OVER g) / (max(c{k}) OVER g - min(c{k}) OVER g) * 1048576), 1048575) AS BIGINT) ELSE 0 END AS q{k}"
    bits = "list_sum(list_transform(range(20), lambda b: CAST(((q{k} >> b) & 1) << (3 * b + {up}) AS HUGEINT)))"
    return f"""cells AS (SELECT *, {", ".join(cell.format(k=k) for k in range(3))} FROM {items} WINDOW g AS (PARTITION BY {key})),
coded AS (SELECT *, CAST({" + ".join(bits.format(k=k, up=2 - k) for k in range(3))} AS BIGINT) AS code FROM cells),
sums AS (SELECT {key}, level, code >> (60 - level) AS node, {total} AS total FROM coded, range(0, {levels} + 1) l(level) GROUP BY 1, 2, 3 HAVING {total} {most}),
told AS (SELECT {key}, code, level, code >> (60 - level) AS node FROM (SELECT p.{key}, p.code, min(s.level) AS level FROM (SELECT DISTINCT {key}, code FROM {place}) p JOIN sums s ON p.{key} = s.{key} AND s.node = p.code >> (60 - s.level) GROUP BY 1, 2))"""


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'textured T' || (o_custkey % 3) WHEN o_orderstatus = 'F' THEN 'opaque' ELSE 'transparent' END || '; primitive ' || (2 + o_orderkey % 2) || '; ' || CASE WHEN o_orderkey % 4 = 0 THEN 'normals' ELSE 'no normals' END AS job FROM orders")
def optimizer_jobs(spark, sf):
    c = F.col
    texture = F.when(c("o_orderkey") % 5 == 0, F.concat(F.lit("T"), (c("o_custkey") % 3).cast("string")))
    return table(spark, sf, "orders").select(c("o_orderkey").alias("id"), packing.job(2 + c("o_orderkey") % 2, c("o_orderstatus") == "F", texture, c("o_orderkey") % 4 == 0).alias("job"))


@query(f"WITH {_M} SELECT grouping, customer % 5 AS floor, count(*) AS meshes, CAST(sum(vertices) AS BIGINT) AS vertices FROM m GROUP BY 1, 2")
def mesh_groups(spark, sf):
    return _meshes(spark, sf).groupBy("grouping", (F.col("customer") % 5).alias("floor")).agg(F.count("*").alias("meshes"), F.sum("vertices").alias("vertices"))


@query(f"WITH {_M} SELECT id, row_number() OVER (PARTITION BY customer ORDER BY efficiency, id) AS place FROM m")
def cluster_efficiency_order(spark, sf):
    w = Window.partitionBy("customer").orderBy("efficiency", "id")
    return _meshes(spark, sf).select("id", F.row_number().over(w).cast("long").alias("place"))


_BINS = "ahead AS (SELECT *, coalesce(sum(vertices) OVER (PARTITION BY {0} ORDER BY efficiency, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM m), bins AS (SELECT *, CASE WHEN before < 1200000 THEN 0 WHEN before = 1200000 THEN 1 END AS bin FROM ahead)"


@query(f"WITH {_M}, {_BINS.format('customer')} SELECT id, CAST(bin AS BIGINT) AS bin FROM bins")
def cluster_first_bins(spark, sf):
    return packing.first_bins(_meshes(spark, sf), ["customer"]).select("id", "bin")


@query(f"WITH {_M} SELECT id, CAST((row_number() OVER (PARTITION BY customer ORDER BY id) - 1) // 3 AS BIGINT) AS chunk FROM m")
def cluster_cap_chunks(spark, sf):
    return packing.capped(_meshes(spark, sf), ["customer"], ["id"], 3).select("id", "chunk")


@query(f"WITH {_M} SELECT id, CAST(sum(vertices) OVER w - vertices AS BIGINT) AS v_from, CAST(sum(vertices) OVER w AS BIGINT) AS v_to, CAST(sum(vertices // 2) OVER w - vertices // 2 AS BIGINT) AS t_from, CAST(sum(vertices // 2) OVER w AS BIGINT) AS t_to FROM m WINDOW w AS (PARTITION BY customer ORDER BY id ROWS UNBOUNDED PRECEDING)")
def mapping_offsets(spark, sf):
    return packing.mapping_offsets(_meshes(spark, sf), ["customer"], ["id"]).select("id", "v_from", "v_to", "t_from", "t_to")


@query("""WITH RECURSIVE m AS (SELECT o_custkey AS customer, o_orderkey AS id, CAST(floor(o_totalprice) AS BIGINT) AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
f AS (SELECT customer, id, n, 0 AS batch, v AS used FROM m WHERE n = 1
UNION ALL SELECT m.customer, m.id, m.n, CASE WHEN f.used + m.v > 1200000 THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.used + m.v > 1200000 THEN m.v ELSE f.used + m.v END FROM f JOIN m ON m.customer = f.customer AND m.n = f.n + 1)
SELECT id, CAST(batch AS BIGINT) AS batch FROM f""")
def supermesh_pack(spark, sf):
    return packing.pack(packing.capped(_meshes(spark, sf), ["customer"], ["id"]), ["customer", "chunk"]).select("id", "batch")


@query(f"WITH {_M}, {subtrees_sql('m', 'grouping', 'coded', 'sum(vertices)', '< 1200000')} SELECT c.grouping, id, CAST(level AS INT) AS level, CAST(node AS BIGINT) AS node FROM coded c JOIN told t ON t.grouping = c.grouping AND t.code = c.code")
def supermesh_spatial_clusters(spark, sf):
    """Parts of a hierarchy over all boxes of a group, of less than 1.2 million vertices each."""
    return packing.spatial_clusters(_meshes(spark, sf), ["grouping"]).select("grouping", "id", "level", F.col("node.head").alias("node"))


@query(f"""WITH {_M}, {_BINS.format('grouping')}, far AS (SELECT * FROM bins WHERE bin IS NULL), {subtrees_sql('far', 'grouping', 'coded', 'sum(vertices)', '< 1200000')},
both_ AS (SELECT id, grouping, efficiency, bin, NULL AS level, NULL AS node FROM bins WHERE bin IS NOT NULL
UNION ALL SELECT id, c.grouping, efficiency, NULL, level, node FROM coded c JOIN told t ON t.grouping = c.grouping AND t.code = c.code)
SELECT id, CAST(bin AS BIGINT) AS bin, CAST(level AS INT) AS level, CAST(node AS BIGINT) AS node, CAST((row_number() OVER (PARTITION BY grouping, bin, level, node ORDER BY efficiency, id) - 1) // 4 AS BIGINT) AS chunk FROM both_""")
def mesh_clusters(spark, sf):
    """Efficiency bins, then parts by space, then runs of four meshes."""
    return packing.clusters(_meshes(spark, sf), ["grouping"], most=4).select("id", "bin", "level", F.col("node.head").alias("node"), "chunk")


def _faces(spark, sf):
    """Order lines as triangles of four large meshes."""
    c = F.col
    corners = F.array(c("l_partkey"), 100_000 + c("l_suppkey") * 7 + c("l_linenumber"), 200_000 + c("l_orderkey") % 5000)
    centre = [(c("l_orderkey") % 997).cast("double"), (c("l_partkey") % 991).cast("double"), c("l_quantity") + c("l_linenumber") * 50]
    face = c("l_orderkey") * 8 + c("l_linenumber")
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*(F.min(k).alias(k) for k in ("l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")))
    return lines.select(F.concat("l_returnflag", "l_linestatus").alias("mesh"), face.alias("face"), corners.alias("vertices"), F.array(*centre).alias("centre"))


_FACES = """l AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, min(l_suppkey) AS s, min(l_quantity) AS q, min(l_returnflag) || min(l_linestatus) AS mesh FROM lineitem GROUP BY 1, 2),
f AS (SELECT mesh, l_orderkey * 8 + l_linenumber AS face, [p, 100000 + s * 7 + l_linenumber, 200000 + l_orderkey % 5000] AS vertices, CAST(l_orderkey % 997 AS DOUBLE) AS c0, CAST(p % 991 AS DOUBLE) AS c1, q + l_linenumber * 50 AS c2 FROM l),
corners AS (SELECT mesh, face, c0, c1, c2, unnest(vertices) AS vertex, generate_subscripts(vertices, 1) AS nth FROM f)"""


@query(f"""WITH {_FACES}, {subtrees_sql('corners', 'mesh', 'coded', 'count(DISTINCT vertex)', '<= 400', 24)},
parts AS (SELECT DISTINCT mesh, level, node, dense_rank() OVER (PARTITION BY mesh ORDER BY node << (60 - level)) - 1 AS part FROM told),
own AS (SELECT c.mesh, c.face, c.vertex, c.nth, part, dense_rank() OVER (PARTITION BY c.mesh, part ORDER BY c.vertex) - 1 AS local FROM coded c JOIN told t ON t.mesh = c.mesh AND t.code = c.code JOIN parts p ON p.mesh = t.mesh AND p.level = t.level AND p.node = t.node)
SELECT mesh, face, CAST(part AS BIGINT) AS part, string_agg(local, ',' ORDER BY nth) AS local FROM own GROUP BY 1, 2, 3""")
def mesh_split(spark, sf):
    """Faces of meshes that are too large, in parts of at most 400 vertices with numbers of their own."""
    return packing.split_meshes(_faces(spark, sf), 400).select("mesh", "face", "part", F.array_join("local", ",").alias("local"))


@query("""WITH RECURSIVE m AS (SELECT o_custkey AS customer, o_orderkey AS id, CAST(floor(o_totalprice) AS BIGINT) AS v, CAST(floor(o_totalprice) AS BIGINT) // 2 AS t, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
f AS (SELECT customer, id, n, 0 AS part, v AS uv, t AS ut FROM m WHERE n = 1
UNION ALL SELECT m.customer, m.id, m.n, CASE WHEN f.uv + m.v > 500000 OR f.ut + m.t > 200000 THEN f.part + 1 ELSE f.part END,
 CASE WHEN f.uv + m.v > 500000 OR f.ut + m.t > 200000 THEN m.v ELSE f.uv + m.v END, CASE WHEN f.uv + m.v > 500000 OR f.ut + m.t > 200000 THEN m.t ELSE f.ut + m.t END
FROM f JOIN m ON m.customer = f.customer AND m.n = f.n + 1)
SELECT customer, id, CAST(part AS BIGINT) AS part FROM f""")
def mesh_rechunk(spark, sf):
    offsets = packing.mapping_offsets(_meshes(spark, sf), ["customer"], ["id"]).select("customer", "id", "vertices", "faces", "v_from")
    return packing.rechunk(offsets, ["customer"], 500_000, 200_000).select("customer", "id", "part")


_RUNS = """WITH RECURSIVE f AS (SELECT l_partkey AS mesh, l_orderkey * 8 + l_linenumber AS face, [min(l_suppkey), 100 + l_orderkey % 13, 200 + l_linenumber] AS v FROM lineitem GROUP BY l_partkey, l_orderkey, l_linenumber),
o AS (SELECT *, row_number() OVER (PARTITION BY mesh ORDER BY face) AS n FROM f),
r AS (SELECT mesh, face, n, 0 AS piece, v AS seen, 1 AS faces, v FROM o WHERE n = 1
UNION ALL SELECT o.mesh, o.face, o.n, CASE WHEN len(seen) + 3 > 24 OR faces >= 20 THEN piece + 1 ELSE piece END, CASE WHEN len(seen) + 3 > 24 OR faces >= 20 THEN o.v ELSE list_concat(seen, list_filter(o.v, lambda x: NOT list_contains(seen, x))) END,
 CASE WHEN len(seen) + 3 > 24 OR faces >= 20 THEN 1 ELSE faces + 1 END, o.v FROM r JOIN o ON o.mesh = r.mesh AND o.n = r.n + 1)"""


def _runs(spark, sf):
    """Order lines as faces of their part, cut at 24 vertices and 20 faces."""
    c = F.col
    lines = table(spark, sf, "lineitem").groupBy("l_partkey", "l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("s"))
    faces = lines.select(c("l_partkey").alias("mesh"), (c("l_orderkey") * 8 + c("l_linenumber")).alias("face"), F.array(c("s"), 100 + c("l_orderkey") % 13, (200 + c("l_linenumber")).cast("long")).alias("vertices"))
    return packing.split_runs(faces, 24, 20)


@query(f"{_RUNS} SELECT mesh, face, CAST(piece AS BIGINT) AS piece, array_to_string(list_transform(v, lambda x: list_position(seen, x) - 1), ',') AS local FROM r")
def mesh_split_runs(spark, sf):
    return _runs(spark, sf).select("mesh", "face", "piece", F.array_join("local", ",").alias("local"))


@query(f"""{_RUNS}, pieces AS (SELECT mesh, piece, max(len(seen)) AS vertices, count(*) AS faces FROM r GROUP BY 1, 2),
m AS (SELECT p_brand AS brand, p_partkey AS mesh, CASE WHEN p_size > 45 THEN 30 ELSE p_size % 11 + 1 END AS vertices, p_size % 7 + 1 AS faces, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)),
b AS (SELECT brand, mesh, n, vertices, faces, 0 AS bin, vertices AS uv, faces AS uf FROM m WHERE n = 1
UNION ALL SELECT m.brand, m.mesh, m.n, m.vertices, m.faces, CASE WHEN uv + m.vertices > 24 OR uf + m.faces > 20 THEN bin + 1 ELSE bin END, CASE WHEN uv + m.vertices > 24 OR uf + m.faces > 20 THEN m.vertices ELSE uv + m.vertices END,
 CASE WHEN uv + m.vertices > 24 OR uf + m.faces > 20 THEN m.faces ELSE uf + m.faces END FROM b JOIN m ON m.brand = b.brand AND m.n = b.n + 1),
k AS (SELECT mesh, count(*) AS k FROM pieces GROUP BY 1),
p AS (SELECT brand, mesh, n, vertices, faces, vertices > 24 AS large, bin + coalesce(sum(CASE WHEN vertices > 24 THEN k - 1 ELSE 0 END) OVER (PARTITION BY brand ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM b JOIN k USING (mesh)),
a AS (SELECT brand, mesh, 0 AS piece, n - 1 AS index, part, vertices, faces FROM p WHERE NOT large UNION ALL SELECT brand, mesh, piece, n - 1, part + piece, c.vertices, c.faces FROM p JOIN pieces c USING (mesh) WHERE large)
SELECT brand, mesh, CAST(piece AS BIGINT) AS piece, CAST(index AS BIGINT) AS index, CAST(part AS BIGINT) AS part, CAST(vertices AS BIGINT) AS vertices, CAST(faces AS BIGINT) AS faces,
 CAST(coalesce(sum(vertices) OVER w, 0) AS BIGINT) AS v_from, CAST(coalesce(sum(faces) OVER w, 0) AS BIGINT) AS t_from FROM a WINDOW w AS (PARTITION BY brand, part ORDER BY index, piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def mesh_rechunk_map(spark, sf):
    """Parts of brands re-chunked, those of the largest sizes cut into runs of faces."""
    size = F.col("p_size")
    known = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey")).distinct()
    meshes = table(spark, sf, "part").join(known, "p_partkey", "left_semi").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("mesh"), F.col("p_partkey").alias("place"), F.when(size > 45, 30).otherwise(size % 11 + 1).cast("long").alias("vertices"), (size % 7 + 1).cast("long").alias("faces"))
    return packing.rechunk_map(meshes, ["brand"], packing.pieces_of(_runs(spark, sf)), 24, 20)


@query("SELECT o_custkey AS mesh, min('M' || o_orderkey) AS material FROM orders GROUP BY 1")
def material_first_match(spark, sf):
    m = table(spark, sf, "orders").select(F.concat(F.lit("M"), F.col("o_orderkey").cast("string")).alias("_id"), F.lit("material").alias("type"), F.array("o_custkey").alias("parents"))
    return packing.first_material(m)


@query("SELECT l_partkey % 10 AS checksum, l_orderkey * 10 + l_linenumber AS mesh, CAST((row_number() OVER (PARTITION BY l_partkey % 10 ORDER BY l_orderkey * 10 + l_linenumber) - 1) // 500 AS BIGINT) AS copy FROM (SELECT DISTINCT l_partkey % 10 AS l_partkey, l_orderkey, l_linenumber FROM lineitem)")
def material_copies(spark, sf):
    uses = table(spark, sf, "lineitem").select((F.col("l_partkey") % 10).alias("checksum"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("mesh")).distinct()
    return packing.material_copies(uses, 500)


def _tasks(spark, sf):
    c = F.col
    return table(spark, sf, "events").select(c("user_id").alias("resource"), "ts", c("event_id").alias("seq"), F.round(c("value") % 4, 0).alias("value"), (c("event_type") == "signup").alias("reset"))


_STATES = "s AS (SELECT user_id AS resource, ts, event_id AS seq, CASE WHEN event_type = 'signup' THEN 1.0 ELSE round(value % 4, 0) END AS value, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS until FROM events)"


@query(f"WITH {_STATES} SELECT resource, seq, value, until FROM s")
def frame_state_visibility(spark, sf):
    return sequence.running_state(_tasks(spark, sf)).select("resource", "seq", "value", "until")


@query(f"""WITH {_STATES}, e AS (SELECT max(date_trunc('day', ts)) AS last FROM s)
SELECT frame, value, count(*) AS n FROM (SELECT unnest(generate_series(date_trunc('day', ts), coalesce(date_trunc('day', until) - INTERVAL 1 DAY, last), INTERVAL 1 DAY)) AS frame, value FROM s, e WHERE value <> 1) GROUP BY 1, 2""")
def frame_state_color_groups(spark, sf):
    return sequence.frame_cache(sequence.running_state(_tasks(spark, sf)), "day")


@query("SELECT user_id AS resource, event_id AS seq, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS state FROM events")
def frame_state_fold(spark, sf):
    t = table(spark, sf, "events").select(F.col("user_id").alias("resource"), "ts", F.col("event_id").alias("seq"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("value"))
    return sequence.filled_state(t).select("resource", "seq", "state")


@query("SELECT o_custkey AS sequence, epoch_ms(min(o_orderdate)) AS start_ms, epoch_ms(max(o_orderdate + INTERVAL 7 DAY)) AS end_ms FROM orders GROUP BY 1")
def task_time_frame(spark, sf):
    utc = F.to_utc_timestamp(F.col("o_orderdate").cast("timestamp"), "UTC")
    t = table(spark, sf, "orders").select(F.col("o_custkey").alias("sequence"), utc.alias("start"), (utc + F.expr("interval 7 days")).alias("end"))
    return sequence.time_frame(t, "sequence")


@query("SELECT r_name AS parent, string_agg(n_name, ',' ORDER BY n_name) AS children FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def task_tree(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("parent")).agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("children"))


@query("SELECT user_id AS rid, max(value) AS max_memory, round(sum(value), 2) AS process_seconds, count(*) AS samples FROM events GROUP BY 1")
def run_stats(spark, sf):
    r = table(spark, sf, "events").select(F.col("user_id").alias("rid"), F.col("value").alias("memory"), F.col("value").alias("seconds"))
    return jobs.run_stats(r).withColumn("process_seconds", F.round("process_seconds", 2))


_MESSAGE = "CASE event_type WHEN 'view' THEN 'import -f /tmp/' || event_id || '.json' WHEN 'click' THEN 'processClash team' || user_id || ' box cfg' || event_id WHEN 'purchase' THEN 'genStash team' || user_id || ' box tree' WHEN 'signup' THEN 'processDrawing /tmp/' || event_id ELSE 'unknown ' || event_id END"


@query(f"""WITH m AS (SELECT event_id, event_type, user_id, split({_MESSAGE}, ' ') AS t FROM events)
SELECT event_id, CASE WHEN event_type <> 'error' THEN t[1] END AS command, CASE WHEN event_type IN ('click', 'purchase') THEN t[2] END AS teamspace, CASE WHEN event_type IN ('click', 'purchase') THEN t[3] END AS container,
CASE event_type WHEN 'view' THEN t[3] WHEN 'signup' THEN t[2] WHEN 'click' THEN t[4] WHEN 'purchase' THEN t[4] END AS argument FROM m""")
def job_decode(spark, sf):
    messages = table(spark, sf, "events").select("event_id", F.expr(_MESSAGE).alias("message"))
    return jobs.decode(messages).drop("message")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def job_stream_available_now(spark, sf):
    """The events as a file stream, drained in batches into a table and counted there."""
    place = f"{scratch.folder(spark)}/jobs-{uuid.uuid4().hex}"
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")
    jobs.drain(stream, lambda batch, n: batch.groupBy("event_type").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{place}/out/batch={n}"), f"{place}/checkpoint")
    return spark.read.parquet(f"{place}/out").groupBy("event_type").agg(F.sum("n").alias("n"))


@query("""WITH m AS (SELECT o_custkey AS customer, o_orderkey AS k, CAST(floor(o_totalprice) AS BIGINT) AS v FROM orders)
SELECT customer, count(*) AS submeshes, CAST(sum(v) AS BIGINT) AS vertices, CAST(sum(v // 2) AS BIGINT) AS faces, min((k * 7) % 1000)::DOUBLE AS lo0, min((k * 11) % 1000)::DOUBLE AS lo1, min((k * 13) % 1000)::DOUBLE AS lo2,
max((k * 7) % 1000 + 1 + k % 7)::DOUBLE AS hi0, max((k * 11) % 1000 + 1 + k % 5)::DOUBLE AS hi1, max((k * 13) % 1000 + 1 + k % 3)::DOUBLE AS hi2 FROM m GROUP BY 1""")
def supermesh_assets(spark, sf):
    """Bounds of a customer's orders, which lie in a cube of their own, a thousand wide."""
    low = [(F.col("id") * p % 1000).cast("double") for p in (7, 11, 13)]
    place = {f"{side}{k}": at if side == "lo" else at + 1 + F.col("id") % m for k, (at, m) in enumerate(zip(low, (7, 5, 3), strict=True)) for side in ("lo", "hi")}
    return packing.assets(_meshes(spark, sf).withColumns(place), ["customer"])


@query("SELECT l_suppkey AS layer, l_returnflag AS material, l_linenumber % 2 AS fmt, count(*) AS n FROM lineitem GROUP BY ALL")
def face_groups(spark, sf):
    c = F.col
    faces = table(spark, sf, "lineitem").select(c("l_suppkey").alias("layer"), c("l_returnflag").alias("material"), (c("l_linenumber") % 2).alias("fmt"))
    return packing.face_groups(faces, "layer", "material", "fmt").drop("group")


@query("SELECT o_orderkey AS id, CAST(floor(o_totalprice) AS BIGINT) // 2 * 3 * 4 + 24 * CAST(floor(o_totalprice) AS BIGINT) + o_orderkey % 2 * CAST(floor(o_totalprice) AS BIGINT) * 8 AS bytes FROM orders")
def mesh_bytes(spark, sf):
    m = _meshes(spark, sf)
    return m.select("id", values.mesh_bytes(F.col("vertices"), F.col("faces"), F.col("vertices"), F.col("id") % 2, F.lit(3)).alias("bytes"))
