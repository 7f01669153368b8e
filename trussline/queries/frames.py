"""Animation frames over the events: five kinds of tasks, states, caches, the time line; vertex order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.linear import translation
from ..operators import frames
from .scene import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_KIND = {"error": frames.CLIP, "signup": frames.VISIBILITY, "click": frames.COLOUR, "view": frames.TRANSFORMATION, "purchase": frames.CAMERA}
#: Colours are 2 at first; resources of even number end moved by 3.
_TASKS = f"""t AS (
  SELECT CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _KIND.items())} END AS kind, user_id AS resource,
         date_trunc('day', ts) AS frame, event_id AS seq, CAST(round(value % 4) AS BIGINT) AS v FROM events),
s AS (
  SELECT kind, CASE WHEN kind <> 'CAMERA' THEN resource END AS resource, frame, seq,
         CASE WHEN kind = 'CAMERA' THEN CAST(v AS VARCHAR)
              WHEN kind = 'TRANSFORMATION' THEN CASE
                WHEN resource % 2 = 0 THEN CASE WHEN v = 0 THEN '-3' WHEN v <> 3 THEN CAST(v - 3 AS VARCHAR) END
                WHEN v <> 0 THEN CAST(v AS VARCHAR) END
              WHEN v = 0 OR kind = 'COLOR' AND v = 2 THEN NULL ELSE CAST(v AS VARCHAR) END AS state FROM t),
k AS (SELECT kind, resource, frame, arg_max(CASE WHEN state IS NULL THEN '' ELSE state END, seq) AS st FROM s GROUP BY ALL),
states AS (SELECT kind, resource, frame, nullif(st, '') AS state, lead(frame) OVER (PARTITION BY kind, resource ORDER BY frame) AS until FROM k)"""


def _tasks(spark, sf):
    c = F.col
    kind = F.coalesce(*(F.when(c("event_type") == k, v) for k, v in _KIND.items()))
    v = F.round(c("value") % 4).cast("long")
    e = table(spark, sf, "events").select(kind.alias("kind"), c("user_id").alias("resource"), F.date_trunc("day", "ts").alias("frame"), c("event_id").alias("seq"), v.alias("v"))
    moved = e.withColumns({"matrix": translation(c("v").cast("double"), 0, 0), "reset": c("v") == 0, "last": F.when(c("resource") % 2 == 0, translation(3, 0, 0))})
    moved = frames.with_transforms(moved, [5.0, 6.0, 7.0])
    by = F.round(F.get("moved", F.lit(3))).cast("long").cast("string")
    transformation = c("kind") == frames.TRANSFORMATION
    return moved.select(
        "kind", "resource", "frame", "seq", F.when(transformation, by).otherwise(c("v").cast("string")).alias("value"),
        F.when(transformation, c("moved").isNull()).otherwise(c("reset")).alias("reset"), F.when(c("kind") == frames.COLOUR, "2").alias("initial"),
    )


@query(f"WITH {_TASKS} SELECT * FROM states")
def frame_states(spark, sf):
    return frames.states(_tasks(spark, sf))


@query(f"WITH {_TASKS}, f AS (SELECT DISTINCT frame FROM t) SELECT f.frame, kind, state, resource FROM states s JOIN f ON f.frame >= s.frame AND (until IS NULL OR f.frame < until) WHERE state IS NOT NULL")
def frame_cache_sets(spark, sf):
    t = _tasks(spark, sf)
    return frames.cache(frames.states(t), t)


@query(f"""WITH {_TASKS}, f AS (SELECT DISTINCT frame FROM t), c AS (SELECT f.frame, kind, state, resource FROM f LEFT JOIN states s ON f.frame >= s.frame AND (until IS NULL OR f.frame < until) AND state IS NOT NULL),
b AS (SELECT frame, count(state) AS entries, coalesce(string_agg(kind || ':' || coalesce(CAST(resource AS VARCHAR), '') || ':' || state, ',' ORDER BY kind, resource, state), '') AS held FROM c GROUP BY 1)
SELECT frame, entries, min(frame) OVER (PARTITION BY held) AS first_alike FROM b""")
def sequence_buffers(spark, sf):
    """How many states each frame's cache holds, and the first frame with the same cache."""
    t = _tasks(spark, sf)
    found = frames.buffers(*frames.intervals(frames.states(t), t))
    firsts = found.groupBy("buffer").agg(F.min("frame").alias("first_alike"))
    return found.join(firsts, "buffer").select("frame", "entries", "first_alike")


@query(f"""WITH {_TASKS}, f AS (SELECT frame, lag(frame) OVER (ORDER BY frame) AS before FROM (SELECT DISTINCT frame FROM t)), c AS (SELECT f.frame, kind, state, resource FROM states s JOIN f ON f.frame >= s.frame AND (until IS NULL OR f.frame < until) WHERE state IS NOT NULL),
p AS (SELECT f.frame, kind, state, resource FROM c JOIN f ON f.before = c.frame)
SELECT frame, kind, resource, state, true AS enters FROM (SELECT * FROM c EXCEPT SELECT * FROM p) UNION ALL SELECT frame, kind, resource, state, false FROM (SELECT * FROM p EXCEPT SELECT * FROM c)""")
def sequence_deltas(spark, sf):
    """What each frame changes in the cache; a state that a task sets again stays."""
    t = _tasks(spark, sf)
    d = frames.deltas(*frames.intervals(frames.states(t), t))
    sign = F.sum(F.when(F.col("enters"), 1).otherwise(-1))
    return d.groupBy("frame", "kind", "resource", "state").agg(sign.alias("n")).where("n <> 0").select("frame", "kind", "resource", "state", (F.col("n") > 0).alias("enters"))


@query("SELECT DISTINCT date_trunc('day', ts) AS frame, false AS initial FROM events UNION ALL SELECT TIMESTAMP '2023-12-31', true")
def frame_timeline(spark, sf):
    return frames.timeline(table(spark, sf, "events").select(F.date_trunc("day", "ts").alias("frame")), F.lit("2023-12-31").cast("timestamp_ntz"))


_XYZ = [f"round(embedding[{k + 1}]::DOUBLE, 9) AS {c}" for k, c in enumerate("xyz")]


@query(f"""WITH v AS (SELECT vec_id AS id, label, {', '.join(_XYZ)} FROM embeddings),
g AS (SELECT *, greatest(abs(x), abs(y), abs(z)) AS far FROM v),
d AS (SELECT *, CASE WHEN abs(x) = far THEN 0 WHEN abs(y) = far THEN 2 ELSE 4 END + CASE WHEN (CASE WHEN abs(x) = far THEN x WHEN abs(y) = far THEN y ELSE z END) < 0 THEN 1 ELSE 0 END AS grp FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY label, grp ORDER BY far DESC, id) AS turn FROM d)
SELECT id, label, CAST(row_number() OVER (PARTITION BY label ORDER BY turn, grp) - 1 AS INTEGER) AS place FROM r""")
def vertex_direction_order(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", *(F.round(F.get("embedding", F.lit(k)).cast("double"), 9).alias(c) for k, c in enumerate("xyz")))
    return frames.direction_order(v, ["label"]).select("id", "label", "place")


@query("SELECT o_orderkey AS id, CAST(2 * (o_custkey % 3) AS DOUBLE) AS tx, CAST(2 * (o_orderkey % 4) AS DOUBLE) AS ty, CAST(0 AS DOUBLE) AS tz FROM orders")
def world_matrices(spark, sf):
    """A shift by (x, 0, y) of the z-up world, scaled by two: the turns around it show in the offset's part."""
    o = table(spark, sf, "orders")
    o = o.withColumn("m", translation((F.col("o_custkey") % 3).cast("double"), 0, (F.col("o_orderkey") % 4).cast("double")))
    m = frames.to_world(F.col("m"), [1.0, 2.0, 3.0], 2.0)
    return o.select(F.col("o_orderkey").alias("id"), *(F.get(m, F.lit(4 * k + 3)).alias(c) for k, c in enumerate(("tx", "ty", "tz"))))
