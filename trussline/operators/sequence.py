"""Construction sequences: state per resource folded over time, frames, task times."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_state(tasks: DataFrame, default: float = 1.0) -> DataFrame:
    """Value of each resource from each of its tasks on: (resource, ts, seq, value, until).

    A task sets its value; a reset sets the resource's default.  `until` is the next task's time.
    """
    w = Window.partitionBy("resource").orderBy("ts", "seq")
    value = F.when(F.col("reset"), F.lit(default)).otherwise(F.col("value"))
    return tasks.select("resource", "ts", "seq", value.alias("value"), F.lead("ts").over(w).alias("until"))


def filled_state(tasks: DataFrame) -> DataFrame:
    """As a running fold: the last non-null value so far, per resource."""
    w = Window.partitionBy("resource").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return tasks.withColumn("state", F.last("value", ignorenulls=True).over(w))


def frame_cache(states: DataFrame, width: str, default: float = 1.0) -> DataFrame:
    """(frame, value, n): at each frame's end how many resources hold a value other than the default.

    A state lives in the frames whose ends fall between its time and the next task's, so it is
    exploded over those frames only while it lasts (to the last frame there is).
    """
    last = states.agg(F.max(F.date_trunc(width, "ts")).alias("last"))
    step = F.expr(f"interval 1 {width}")
    open_end = states.withColumn("first", F.date_trunc(width, "ts")).where(F.col("value") != default)
    # one row, and known only now: the table's last frame
    end = last.first()["last"]
    if end is None:
        return states.select(F.col("ts").alias("frame"), "value", F.lit(0).cast("long").alias("n")).limit(0)
    upto = F.coalesce(F.date_trunc(width, "until") - step, F.lit(end))
    lived = open_end.withColumn("upto", upto).where(F.col("upto") >= F.col("first"))
    return lived.select(F.explode(F.sequence("first", "upto", step)).alias("frame"), "value").groupBy("frame", "value").agg(F.count("*").alias("n"))


def time_frame(tasks: DataFrame, group: str) -> DataFrame:
    """First start and last end of each sequence, in milliseconds."""
    ms = lambda c: F.unix_millis(c)
    return tasks.groupBy(group).agg(F.min(ms(F.col("start"))).alias("start_ms"), F.max(ms(F.col("end"))).alias("end_ms"))


def expand_resources(tasks: DataFrame, below: DataFrame) -> DataFrame:
    """Tasks on entities spread to the entities' meshes (`below`: shared_id, mesh)."""
    return tasks.join(below, tasks.resource == below.shared_id).drop("resource", "shared_id").withColumnRenamed("mesh", "resource")
