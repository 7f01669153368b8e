"""Animation frames: the state that tasks of five kinds leave, snapshots of it at every frame, and the time line.

Tasks are rows (kind, resource, frame, seq, value, reset, initial): `value` is what the task sets, as text,
`initial` what the resource has without any task.  A camera has no resource and is never reset; the other
kinds lose their state with a reset, and with a value that is the initial one.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.linear import IDENTITY, inverse, is_identity, matrix, multiply
from ..plans.scratch import materialize
from .partition import running

CAMERA, CLIP, COLOUR, TRANSFORMATION, VISIBILITY = "CAMERA", "CLIP", "COLOR", "TRANSFORMATION", "VISIBILITY"
#: Turns between the y-up and the z-up world.
Z_UP = [1, 0, 0, 0, 0, 0, 1, 0, 0, -1, 0, 0, 0, 0, 0, 1]
Y_UP = [1, 0, 0, 0, 0, 0, -1, 0, 0, 1, 0, 0, 0, 0, 0, 1]


def to_world(m: Column, offset: list[float], scale: float = 1.0) -> Column:
    """A matrix (a plain column) of the animation's z-up world, at an offset and scale, in the scene's world.

    What stands before and behind the matrix is known beforehand, so an element is a sum of its few products.
    """
    there, sized = np.eye(4), np.diag([scale, scale, scale, 1.0])
    there[:3, 3] = offset
    before = sized @ there @ np.reshape(Z_UP, (4, 4))
    behind = np.reshape(Y_UP, (4, 4)) @ np.linalg.inv(there) @ np.linalg.inv(sized)
    terms = lambda r, c: [F.get(m, F.lit(4 * k + n)) * float(before[r, k] * behind[n, c]) for k in range(4) for n in range(4) if before[r, k] * behind[n, c]]
    return F.array(*(reduce(add, terms(r, c), F.lit(0.0)) for r in range(4) for c in range(4)))


def with_transforms(tasks: DataFrame, offset: list[float], scale: float = 1.0) -> DataFrame:
    """Adds `moved` to tasks with `matrix`, `reset` and `last`, the transformation of the resource's last task (or null):
    the geometry stands where the last task leaves it, so a movement is told from there.  Null: not moved."""
    base = tasks.withColumn("_undo", inverse(F.coalesce("last", matrix(IDENTITY))))
    base = base.withColumn("_wanted", multiply(F.col("matrix"), F.col("_undo")))
    base = base.withColumn("_wanted", F.when(F.col("reset"), F.when(F.col("last").isNotNull(), F.col("_undo"))).otherwise(F.col("_wanted")))
    base = base.withColumn("_moved", to_world(F.col("_wanted"), offset, scale))
    still = F.col("_wanted").isNull() | is_identity(F.col("_moved"))
    return base.withColumn("moved", F.when(~still, F.col("_moved"))).drop("_undo", "_wanted", "_moved")


def states(tasks: DataFrame) -> DataFrame:
    """(kind, resource, frame, state, until): what a resource has from a frame on, up to (not with) the next it changes in.

    Of a frame's tasks on a resource the last counts; a null state is the initial one.
    """
    state = F.when(F.col("kind") == CAMERA, F.col("value")).when(F.col("reset") | (F.col("value") == F.col("initial")), None).otherwise(F.col("value"))
    told = tasks.select("kind", F.when(F.col("kind") != CAMERA, F.col("resource")).alias("resource"), "frame", F.struct("seq", state.alias("state")).alias("s"))
    kept = told.groupBy("kind", "resource", "frame").agg(F.max("s").alias("s"))
    until = F.lead("frame").over(Window.partitionBy("kind", "resource").orderBy("frame"))
    return kept.select("kind", "resource", "frame", F.col("s.state").alias("state"), until.alias("until"))


def positions(times: DataFrame, frames: DataFrame) -> DataFrame:
    """(frame, position, real): the distinct times of both tables in order; position counts the frames before, real tells a frame."""
    both = frames.select("frame", F.lit(1).alias("_real")).union(times.select("frame", F.lit(0).alias("_real")))
    once = both.where("frame is not null").groupBy("frame").agg(F.max("_real").alias("_real"))
    return materialize(running(once.withColumn("_all", F.lit(0)), ["_all"], ["frame"], {"position": "_real"}).select("frame", "position", (F.col("_real") == 1).alias("real")))


def intervals(found: DataFrame, frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The states of `found` (as of `states`) as intervals (kind, resource, state, low, high) of positions in the ordered `frames`, high not
    included (null: to the end), and the table of `positions`.  States that no frame sees are left out."""
    line = positions(found.select("frame").union(found.select("until")), frames)
    from_ = line.select("frame", F.col("position").alias("low"))
    to = line.select(F.col("frame").alias("until"), F.col("position").alias("high"))
    placed = found.where("state is not null").join(from_, "frame").join(to, "until", "left")
    last = F.col("high").isNull() | (F.col("low") < F.col("high"))
    return placed.where(last).select("kind", "resource", "state", "low", "high"), line


def cache(found: DataFrame, frames: DataFrame) -> DataFrame:
    """(frame, kind, state, resource): at every one of `frames` the resources that hold a state, one row each.

    `found` is as of `states`; a row lives in the frames from its own to before its next.  Its frames are a range of numbers, joined
    to the ordered frames by equality: nothing looks at frames that a state does not live in.
    """
    spans, line = intervals(found, frames)
    real = line.where("real").select("frame", "position")
    ends = real.agg(F.max("position").alias("m")).first().m
    spread = spans.where(F.col("low") <= F.lit(ends)).select("kind", "state", "resource", F.explode(F.sequence("low", F.coalesce(F.col("high") - 1, F.lit(ends)))).alias("position"))
    return spread.join(real, "position").select("frame", "kind", "state", "resource")


def deltas(spans: DataFrame, line: DataFrame) -> DataFrame:
    """(frame, kind, resource, state, enters): what a frame's cache holds that the one before did not, and the other way round."""
    changes = spans.select("kind", "resource", "state", F.explode(F.array(F.struct(F.col("low").alias("position"), F.lit(True).alias("enters")), F.struct(F.col("high").alias("position"), F.lit(False).alias("enters")))).alias("c"))
    real = line.where("real").select("frame", "position")
    return changes.select("kind", "resource", "state", "c.*").join(real, "position").select("frame", "kind", "resource", "state", "enters")


def buffers(spans: DataFrame, line: DataFrame) -> DataFrame:
    """(frame, position, entries, buffer): how many states a frame's cache holds, and a name that equal caches share.

    The name is a sum of hashes that each state adds when it enters and takes away when it leaves, so that no cache is put together.
    """
    low, high = (F.xxhash64("kind", "resource", "state", F.lit(k)).cast("decimal(20,0)") for k in (1, 2))
    sign = F.when(F.col("enters"), 1).otherwise(-1)
    each = deltas(spans, line).groupBy("frame").agg(F.sum(sign).alias("n"), F.sum(low * sign).alias("a"), F.sum(high * sign).alias("b"))
    rows = line.where("real").select("frame", "position").join(each, "frame", "left").withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("n", "a", "b")})
    summed = running(rows.withColumn("_all", F.lit(0)), ["_all"], ["position"], {"_n": "n", "_a": "a", "_b": "b"})
    text = F.concat_ws("-", *((F.col(f"_{c}") + F.col(c)).cast("string") for c in ("n", "a", "b")))
    return summed.select("frame", "position", (F.col("_n") + F.col("n")).cast("long").alias("entries"), F.sha2(text, 256).alias("buffer"))


def commit_sequence(found: DataFrame, frames: DataFrame, path: str, sequence: str, name: str, tasks: DataFrame | None = None) -> None:
    """Writes a sequence below `path` as tables partitioned by its id, which a second commit of the same id replaces: `sequences` (name, first and last
    frame, number of frames), `frames` (frame, buffer), `deltas` (what each frame changes; a buffer is their sum up to a frame
    that has it) and, if given, `tasks`."""
    spans, line = intervals(found, frames)
    spans = materialize(spans)
    listed = materialize(buffers(spans, line))
    whole = listed.agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.count("*").alias("frames")).withColumn("name", F.lit(name))
    for table, rows in (("deltas", deltas(spans, line)), ("tasks", tasks), ("frames", listed.select("frame", "entries", "buffer")), ("sequences", whole)):
        if rows is not None:
            rows.write.mode("overwrite").parquet(f"{path}/{table}/sequence={sequence}")


def timeline(tasks: DataFrame, start: Column | None = None) -> DataFrame:
    """(frame, initial): the frames of an animation, before them one at `start` (in their unit) if the first is later."""
    frames = tasks.select("frame").distinct()
    if start is None:
        return frames.withColumn("initial", F.lit(False))
    first = frames.agg(F.min("frame").alias("_first")).where(F.col("_first") > start).select(start.alias("frame"), F.lit(True).alias("initial"))
    return first.union(frames.withColumn("initial", F.lit(False)))


def initial_states(resources: DataFrame, start: Column) -> DataFrame:
    """States of transformed resources (resource, state) at a frame before the first task, as of `states`."""
    return resources.select(F.lit(TRANSFORMATION).alias("kind"), "resource", start.alias("frame"), "state", F.lit(None).cast("timestamp").alias("until"))


def direction_order(vertices: DataFrame, keys: list[str]) -> DataFrame:
    """Adds place: vertices (x, y, z, id) go round six direction groups (+x, -x, +y, -y, +z, -z of their largest
    coordinate), the furthest of each group first."""
    size = [F.abs(c) for c in ("x", "y", "z")]
    largest = F.greatest(*size)
    group = F.coalesce(*(F.when(s == largest, F.lit(2 * k) + F.when(F.col(c) < 0, 1).otherwise(0)) for k, (c, s) in enumerate(zip("xyz", size, strict=True))))
    ranked = vertices.withColumns({"_group": group, "_far": largest})
    ranked = ranked.withColumn("_turn", F.row_number().over(Window.partitionBy(*keys, "_group").orderBy(F.desc("_far"), "id")))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_turn", "_group")) - 1
    return ranked.withColumn("place", place).drop("_group", "_far", "_turn")
