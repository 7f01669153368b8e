"""Cutting large groups: running totals in parts, and hierarchies over space cut where a subtree is small enough.

A hierarchy is given by codes: the bits of a space-filling (Morton) curve through a group's boxes, then bits of a
hash, which part what lies in one spot.  A node is a prefix of such codes, its halves are the two longer ones.  Nodes of a bounded number of
rows are one task's work; larger groups are parted by their prefixes, `STEP` levels at a time, so no group passes through one task.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.scratch import materialize

#: Bits of a code for each axis; a code has three times as many, its hash another `SPACE`.
AXIS = 20
SPACE = 3 * AXIS
#: Levels after which a node that is too large for a task is parted, and rows of a task.
STEP = 12
TASK = 500_000
#: Rows of a group that one task orders; running totals of larger groups are taken in parts.
WHOLE = 1_000_000


def equal(columns: list[str]) -> Column:
    """Rows r and o with the same values, nulls included."""
    on = F.lit(True)
    for c in columns:
        on = on & F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}"))
    return on


def running(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, str | Column], whole: int = WHOLE) -> DataFrame:
    """Adds for each name in `sums` the total of its column over the earlier rows of the group, in `order` (which should leave no ties).

    Groups of up to `whole` rows are windows.  If one is larger, rows are dealt by ranges of keys and order; each part's totals are
    summed, and what lies before a part is added to its own running totals: as many rows as parts are handed to all tasks.
    """
    largest = rows.groupBy(*keys).count().agg(F.max("count")).first()[0]
    values = {name: F.col(c) if isinstance(c, str) else c for name, c in sums.items()}
    earlier = lambda *by: Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    if (largest or 0) <= whole:
        return rows.withColumns({name: F.coalesce(F.sum(v).over(earlier(*keys)), none) for name, v in values.items()})
    dealt = materialize(rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    parts = dealt.groupBy(*keys, "_part").agg(*(F.sum(v).alias(name) for name, v in values.items()))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    offsets = parts.select(*keys, "_part", F.lag(F.lit(1)).over(Window.partitionBy(*keys).orderBy("_part")).alias("_later"), *(F.sum(n).over(before).alias(f"_{n}") for n in values)).where("_later = 1")
    own = dealt.withColumns({name: F.coalesce(F.sum(v).over(earlier(*keys, "_part")), none) for name, v in values.items()})
    met = own.alias("r").join(F.broadcast(offsets.alias("o")), equal([*keys, "_part"]), "left")
    return met.select(*(F.col(f"r.{c}") for c in rows.columns), *((F.col(f"r.{n}") + F.coalesce(F.col(f"o._{n}"), none)).alias(n) for n in values))


def _spread(x: Column) -> Column:
    """The bits of a number of `AXIS` bits, two places apart."""
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def coded(items: DataFrame, keys: list[str], centre: list[Column], id_: str) -> DataFrame:
    """Adds _code, the place of `centre` on the curve through its group's bounds, and _tail, the bits that part equal places."""
    axes = [f"_c{k}" for k in range(3)]
    placed = items.withColumns(dict(zip(axes, centre, strict=True)))
    bounds = materialize(placed.groupBy(*keys).agg(*(F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(f"_b{k}") for k, c in enumerate(axes))))

    def step(k: int) -> Column:
        lo, hi = F.col(f"o._b{k}.lo"), F.col(f"o._b{k}.hi")
        cell = F.floor((F.col(f"r._c{k}") - lo) / (hi - lo) * float(1 << AXIS))
        return F.when(hi > lo, F.least(cell, F.lit((1 << AXIS) - 1))).otherwise(0).cast("long")

    code = F.shiftleft(_spread(step(0)), 2).bitwiseOR(F.shiftleft(_spread(step(1)), 1)).bitwiseOR(_spread(step(2)))
    met = placed.alias("r").join(bounds.alias("o"), equal(keys))
    return met.select(*(F.col(f"r.{c}") for c in items.columns), code.alias("_code"), F.shiftrightunsigned(F.xxhash64(F.col(f"r.{id_}")), 64 - SPACE).alias("_tail"))


def _filled(level: int) -> dict[str, Column]:
    """A prefix of so many bits, in _code and _tail, filled up with zeros."""
    return {"_code": F.shiftleft("_code", max(SPACE - level, 0)), "_tail": F.shiftleft("_tail", SPACE - max(level - SPACE, 0))}


def _prefix(level: Column) -> Column:
    """The first `level` bits of _code and _tail, as one number a half."""
    head = F.call_function("shiftrightunsigned", F.col("_code"), F.lit(SPACE) - F.least(level, F.lit(SPACE)))
    tail = F.call_function("shiftrightunsigned", F.col("_tail"), F.lit(SPACE) - F.greatest(level - SPACE, F.lit(0)))
    return F.struct(head.cast("long").alias("head"), tail.cast("long").alias("tail"))


def _levels(rows: pd.DataFrame, keys: list[str], base: int, most: int, distinct: bool) -> pd.DataFrame:
    """The places of `rows` (keys, _code, _tail, _m), whole nodes of level `base`: the first level whose node holds `most` or less, and
    whether the node of level `base` holds more.

    Places in order make each node a stretch of them; by value, then place, the equal values of a node stand together.
    """
    group = rows.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
    code, tail = rows["_code"].to_numpy(), rows["_tail"].to_numpy()
    order = np.lexsort((tail, code, group))
    group, code, tail = group[order], code[order], tail[order]
    new = np.r_[True, (group[1:] != group[:-1]) | (code[1:] != code[:-1]) | (tail[1:] != tail[:-1])]
    at, head = np.cumsum(new) - 1, np.flatnonzero(new)
    if distinct:
        value = pd.factorize(rows["_m"], use_na_sentinel=False)[0][order]
        by = np.lexsort((at, value))
        at, value = at[by], value[by]
    else:
        value, told = rows["_m"].fillna(0).to_numpy()[order], rows["_m"].notna().to_numpy()[order]
    group, code, tail = group[head], code[head], tail[head]
    level, heavy, place = np.full(len(head), 2 * SPACE, np.int32), np.zeros(len(head), bool), np.arange(len(head))
    for now in range(base, 2 * SPACE):
        front, back = code >> max(SPACE - now, 0), tail >> (SPACE - max(now - SPACE, 0))
        node = np.cumsum(np.r_[True, (group[1:] != group[:-1]) | (front[1:] != front[:-1]) | (back[1:] != back[:-1])]) - 1
        own = node[at]
        if distinct:
            once = np.r_[True, (value[1:] != value[:-1]) | (own[1:] != own[:-1])]
            total = np.bincount(own[once], minlength=node[-1] + 1)
            small = total <= most
        else:
            total = np.zeros(node[-1] + 1, value.dtype)
            np.add.at(total, own, value)
            small = (total <= most) & (np.bincount(own, told, node[-1] + 1) > 0)
        if now == base:
            heavy = (total > most)[node]
        done = small[node]
        level[place[done]] = now
        left = ~done
        if not left.any():
            break
        kept, moved = left[at], np.cumsum(left) - 1
        at, value = moved[at[kept]], value[kept]
        told = told[kept] if not distinct else None
        group, code, tail, place = group[left], code[left], tail[left], place[left]
    return rows.iloc[order[head]][[*keys, "_code", "_tail"]].assign(level=level, _heavy=heavy)


def subtrees(items: DataFrame, keys: list[str], measure: str, most: int, distinct: bool = False, task: int = TASK) -> DataFrame:
    """(keys, _code, _tail, level, node) of every place of `items` (as of `coded`): the largest node above it whose total is `most` or less.

    The total is the sum of `measure`, which is not negative, or, if `distinct`, the number of its different values.  A place that is above
    `most` by itself is a node of its own, at the last level.

    Nodes of up to `task` rows are looked through by one task each, several together; larger ones are parted `STEP` levels further on.
    What such a part holds is no more than what the nodes above it hold, so only parts of `most` or less can have a larger node, and only
    their rows are summed on the levels above.
    """
    place = [*keys, "_code", "_tail"]
    rows = materialize(items.select(*place, F.col(measure).alias("_m")))
    depth = 2 * SPACE
    kinds = T.StructType([*rows.select(*place).schema.fields, T.StructField("level", T.IntegerType()), T.StructField("_heavy", T.BooleanType())])
    told, left = [], rows
    for base in range(0, depth + 1, STEP):
        node = left.withColumn("_node", _prefix(F.lit(base)))
        now = crowded = None
        if base < depth:
            sizes = node.groupBy(*keys, "_node").agg(F.count("*").alias("_rows"))
            crowded = materialize(sizes.where(F.col("_rows") > task).drop("_rows"))
            if crowded.isEmpty():
                crowded, now = None, node
            else:
                now = node.alias("r").join(F.broadcast(crowded.alias("o")), equal([*keys, "_node"]), "left_anti")
            buckets = max(1, 2 * left.count() // task)
            dealt = now.withColumn("_bucket", F.pmod(F.xxhash64(*keys, "_node"), F.lit(buckets))).drop("_node")
            found = dealt.repartition(buckets, "_bucket").groupBy("_bucket").applyInPandas(lambda pdf: _levels(pdf, keys, base, most, distinct), kinds)
        else:
            total = F.count_distinct(F.struct("_m")) if distinct else F.sum("_m")
            found = left.groupBy(*place).agg(total.alias("_n")).select(*place, F.lit(depth).alias("level"), F.coalesce(F.col("_n") > most, F.lit(False)).alias("_heavy"))
        told.append((base, materialize(found)))
        if crowded is None:
            break
        left = materialize(node.alias("r").join(F.broadcast(crowded.alias("o")), equal([*keys, "_node"]), "left_semi").drop("_node"))
    out = reduce(DataFrame.union, (t for _, t in told))
    if len(told) > 1:
        above = lambda t, base: t.select("*", F.explode(F.sequence(F.lit(0), F.lit(base - 1))).alias("_up")).withColumn("_node", _prefix(F.col("_up")))
        lower = [(base, t) for base, t in told if base]
        heavy = materialize(reduce(DataFrame.union, (above(t.where("_heavy").select(*keys, (n := _prefix(F.lit(base)))["head"].alias("_code"), n["tail"].alias("_tail")).distinct().withColumns(_filled(base)), base) for base, t in lower)).select(*keys, "_up", "_node").distinct())
        light = reduce(DataFrame.union, (above(t.where("not _heavy").select(*place), base) for base, t in lower))
        may = materialize(light.alias("r").join(heavy.alias("o"), equal([*keys, "_up", "_node"]), "left_anti"))
        if not may.isEmpty():
            summed = may.alias("r").join(rows.alias("o"), equal(place)).select(*(F.col(f"r.{c}") for c in (*keys, "_up", "_node")), "o._m")
            total = F.count_distinct(F.struct("_m")) if distinct else F.sum("_m")
            small = materialize(summed.groupBy(*keys, "_up", "_node").agg(total.alias("_n")).where(F.col("_n") <= most).drop("_n"))
            first = may.alias("r").join(small.alias("o"), equal([*keys, "_up", "_node"]), "left_semi").groupBy(*place).agg(F.min("_up").alias("_first"))
            out = out.alias("r").join(materialize(first).alias("o"), equal(place), "left").select(*(F.col(f"r.{c}") for c in place), F.coalesce("o._first", "r.level").alias("level"))
    return out.select(*place, "level", _prefix(F.col("level")).alias("node"))
