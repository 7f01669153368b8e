"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions.

The ring has `CELLS` cells.  Each shard owns `NODES` virtual nodes at cells given by a hash; a row
belongs to the cell of its doc_id's hash and, clockwise, to the next virtual node: its arc.  Loads
are bounded as tightly as can be: N rows on n shards give N mod n shards one row more than the
others, and the capacities add up to N, so every shard ends exactly full (law "rows").

Rows of an arc all see the same shards clockwise, so which shard takes how many of them needs the
arc's row count only: first every arc fills its own shard, in ring order, then what a full shard
could not take continues clockwise to the next shards with room.  That fold runs over one row an arc
(`shards * NODES` rows, whatever the size of the table).  Rows are then numbered within their arc
and cut at the fold's bounds.

No key is hot: rows are counted and numbered within (cell, salt), where the salt, from a hash of the
row's columns, spreads a repeated doc_id over `SALTS` parts; the counts are at most CELLS * SALTS rows.  Rows are
numbered in the order of that hash, so where a row goes depends on the table's rows alone, not on how they are
dealt; rows equal in all columns are counted first and numbered in `PARTS` parts, which of them is which being all one.

Defined cases: a null text has 0 bytes and a null checksum is that of the empty text; null and
repeated doc_ids are placed like others; rows equal in all columns may part; an empty table gives an empty result;
fewer rows than shards leave some shards empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, shielded, table

SHARDS = 40
NODES = 64
CELLS = 1 << 14
SALTS = 16
PARTS = 16
OVERHEAD = 16


def _cell(h: Column) -> Column:
    return F.shiftrightunsigned(h, 50).cast("int")  # the top 14 bits


def ring(spark, shards: int = SHARDS) -> DataFrame:
    """One row an arc: arc number in ring order, its last cell, and the distinct shards met clockwise."""
    nodes = spark.range(shards * NODES).select(
        F.expr(f"cast(id div {NODES} as int)").alias("shard"), F.xxhash64(F.lit("node"), "id").alias("h")
    )
    placed = F.array_sort(F.collect_list(F.struct(_cell(F.col("h")).alias("cell"), "h", "shard")))
    whole = nodes.agg(placed.alias("nodes"))  # shards * NODES entries, fixed by the parameters
    names = F.col("nodes").getField("shard")
    n = shards * NODES
    return whole.select(names.alias("names"), F.posexplode("nodes").alias("arc", "node")).select(
        "arc",
        F.col("node.cell").alias("last_cell"),
        F.array_distinct(F.concat(F.slice("names", F.col("arc") + 1, n), F.slice("names", 1, n))).alias("walk"),
    )


def cells(arcs: DataFrame) -> DataFrame:
    """Arc of every cell: the first whose node lies at the cell or after it, else the ring's first."""
    firsts = arcs.groupBy("last_cell").agg(F.min("arc").alias("at"))
    every = arcs.sparkSession.range(CELLS).select(F.col("id").cast("int").alias("cell"))
    after = Window.orderBy(F.col("cell").desc()).rowsBetween(Window.unboundedPreceding, 0)  # CELLS rows
    return every.join(F.broadcast(firsts), every.cell == firsts.last_cell, "left").select(
        "cell", F.coalesce(F.last("at", ignorenulls=True).over(after), F.lit(0)).alias("arc")
    )


def plan(counts: DataFrame, arcs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Which rows of an arc go where: (arc, low, high, shard, slot) for arc ranks low <= r < high.

    `counts` has (arc, n).  The fold's state is the room left in each shard and the pieces so far.
    """
    n = F.expr("aggregate(arcs, 0L, (s, a) -> s + a.n)")
    gathered = (
        arcs.join(counts, "arc", "left")
        .select("arc", "walk", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
        .agg(F.array_sort(F.collect_list(F.struct("arc", "n", "walk"))).alias("arcs"))  # shards * NODES entries
        .select("arcs", n.alias("total"))
    )
    room = f"transform(sequence(0, {shards - 1}), s -> total div {shards} + if(s < total % {shards}, 1L, 0L))"
    piece = "named_struct('arc', {arc}, 'low', {low}, 'high', {low} + {took}, 'shard', {shard}, 'slot', {slot})"
    # first pass: every arc's own shard
    first = f"""
        aggregate(arcs,
          named_struct('room', room, 'left', cast(array() as array<bigint>),
                       'pieces', cast(array() as array<struct<arc:int,low:bigint,high:bigint,shard:int,slot:bigint>>)),
          (s, a) -> named_struct(
            'room', transform(s.room, (r, i) -> if(i = a.walk[0], r - least(r, a.n), r)),
            'left', array_append(s.left, a.n - least(s.room[a.walk[0]], a.n)),
            'pieces', if(least(s.room[a.walk[0]], a.n) = 0, s.pieces, array_append(s.pieces,
              {piece.format(arc="a.arc", low="0L", took="least(s.room[a.walk[0]], a.n)", shard="a.walk[0]", slot="full[a.walk[0]] - s.room[a.walk[0]]")}))))
    """
    # second pass: what is left of an arc walks on
    second = f"""
        aggregate(filter(transform(arcs, (a, i) -> named_struct('arc', a.arc, 'n', a.n, 'walk', a.walk, 'left', done.left[i])), a -> a.left > 0),
          named_struct('room', done.room, 'pieces', done.pieces),
          (s, a) -> aggregate(a.walk,
            named_struct('room', s.room, 'pieces', s.pieces, 'left', a.left),
            (t, w) -> if(t.left = 0 or t.room[w] = 0, t, named_struct(
              'room', transform(t.room, (r, i) -> if(i = w, r - least(r, t.left), r)),
              'pieces', array_append(t.pieces,
                {piece.format(arc="a.arc", low="a.n - t.left", took="least(t.room[w], t.left)", shard="w", slot="full[w] - t.room[w]")}),
              'left', t.left - least(t.room[w], t.left))),
            t -> named_struct('room', t.room, 'pieces', t.pieces)))
    """
    # the folds are written between each other: the optimizer would otherwise nest one in the other's lambda
    filled = materialize(gathered.selectExpr("arcs", f"{room} as full").selectExpr("arcs", "full", "full as room").selectExpr("arcs", "full", f"{first} as done"))
    return filled.selectExpr(f"{second} as done").select(F.inline_outer("done.pieces")).where("arc is not null")


def assign(keys: DataFrame, doc_id: str = "doc_id", shards: int = SHARDS) -> DataFrame:
    """`keys` (a materialized table) with _shard and _slot, gapless from 0 in every shard.

    `keys` needs a column _hash of the row and a column _part in 0 to PARTS - 1 that is stored with it.
    """
    arcs = materialize(ring(keys.sparkSession, shards))
    placed = keys.withColumns({"_cell": _cell(F.xxhash64(F.col(doc_id))), "_salt": F.pmod("_hash", F.lit(SALTS)).cast("int")})
    alike = ["_cell", "_salt", "_hash", "_part"]
    groups = placed.groupBy(*alike).agg(F.count("*").alias("_n"))
    counts = groups.groupBy(F.col("_cell").alias("cell"), F.col("_salt").alias("salt")).agg(F.sum("_n").alias("n"))
    order = Window.partitionBy("arc").orderBy("cell", "salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = materialize(
        counts.join(F.broadcast(cells(arcs)), "cell").select(
            "arc", F.col("cell").alias("_c"), F.col("salt").alias("_s"), "n", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("_before")
        )
    )
    pieces = materialize(plan(parts.groupBy("arc").agg(F.sum("n").alias("n")), arcs, shards))
    before = Window.partitionBy("_cell", "_salt").orderBy("_hash", "_part").rowsBetween(Window.unboundedPreceding, -1)
    based = groups.select(*alike, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    nth = placed.withColumn("_nth", F.row_number().over(Window.partitionBy(*alike).orderBy(F.lit(0))) - 1)
    ranked = nth.join(based, alike).withColumn("_rank", F.col("_base") + F.col("_nth"))
    # both tables are bounded by the ring's parameters, not by the rows
    parts = parts.select(F.col("arc").alias("_arc"), "_c", "_s", "_before")
    pieces = pieces.select(F.col("arc").alias("_of"), F.col("low").alias("_low"), F.col("high").alias("_high"), F.col("shard").alias("_shard"), F.col("slot").alias("_first"))
    at = ranked.join(F.broadcast(parts), (F.col("_cell") == F.col("_c")) & (F.col("_salt") == F.col("_s"))).withColumn("_rank", F.col("_rank") + F.col("_before"))
    hit = (F.col("_arc") == F.col("_of")) & (F.col("_rank") >= F.col("_low")) & (F.col("_rank") < F.col("_high"))
    placed_rows = at.join(F.broadcast(pieces), hit).withColumn("_slot", F.col("_first") + F.col("_rank") - F.col("_low"))
    return placed_rows.select(*(c for c in keys.columns if c not in ("_hash", "_part")), "_shard", "_slot")


def _keys(docs: DataFrame, *more: Column) -> DataFrame:
    hashed = [F.col(f.name) for f in docs.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    part = F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)).cast("int").alias("_part")
    return materialize(docs.select(*more, F.xxhash64(*hashed).alias("_hash"), part))


@shielded
def shard_documents(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id") -> DataFrame:
    """`docs` with shard (0 to shards - 1) and slot; earlier columns of these names are replaced."""
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    keys = _keys(docs, *(F.col(c) for c in kept))
    return assign(keys, doc_id, shards).withColumnsRenamed({"_shard": "shard", "_slot": "slot"}).withColumn("slot", F.col("slot").cast("long"))


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = _keys(
        table(spark, sf_dir, "documents"),
        F.col("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return assign(keys).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("_shard").alias("shard"), F.col("_slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
