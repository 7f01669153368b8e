"""Classes of similar items: those that share a block meet, and links are verified.

An item (a line, a document's set of shingles) is filed under a few block keys.  All pairs of a block would be
a square, and most of them lie within one class, where they tell nothing new.  So:

1. In each block every item meets the block's `HEADS` heads.  Verified links give classes: a group of near copies is
   stars around its heads.  Filings are dealt by block once.  A block that a sample shows to be large is dealt in `PARTS` parts,
   whose heads meet again, so no block is one task's work.
2. What is left are pairs of different classes in one block.  A block that holds, besides its largest class, at most `FEW` items
   has these meet all others of the block.
3. In blocks with more of them (a template that many unlike items share) items meet exactly: by prefix filtering, under
   their rarest tokens, so many that any two which are similar enough share one of them, and where what follows the shared token
   could still be enough.  A token's items again meet only across classes, and those outside its largest class meet all.

So no pair of a block that could join two classes is left out, whatever the block's size, and the classes do not depend on what
else the table holds: parts, heads and `FEW` choose between ways of finding the same classes.  Rows that meet grow with the
filings, but for tokens that are the rarest of many unlike items.  Tables that meet are stored first, so that
Spark splits a block that holds many rows over several tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, materialize, small

#: Items outside a block's largest class that meet all its items; beyond, its items meet under their rarest tokens.
FEW = 4
#: Items of a block that all others meet first: those of least hash under as many seeds.
HEADS = 4
#: Blocks are counted on one item of `EVERY`; those with more than 1 / MOST of the counted filings, MOST at most, are dealt in `PARTS`.
EVERY, MOST, PARTS = 16, 2_000, 64


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("x"), F.greatest(a, b).alias("y")]


def _largest(rows: DataFrame, by: str) -> DataFrame:
    """The keys that several classes share: largest class, and the number of rows outside it."""
    each = rows.groupBy(by, "_class").agg(F.count("*").alias("n"))
    whole = each.groupBy(by).agg(F.max(F.struct("n", "_class")).alias("m"), F.sum("n").alias("n"))
    return materialize(whole.where("n > m.n").select(F.col(by).alias("_of"), F.col("m._class").alias("_main"), (F.col("n") - F.col("m.n")).alias("_others")))


def _apart(a: str, b: str, alike: Callable[[str, str], Column]) -> Column:
    return (F.col(f"{a}._class") != F.col(f"{b}._class")) & alike(a, b)


def _met(items: DataFrame) -> DataFrame:
    """Filings in blocks of more than one item: the item a, the heads b of its block (or of its part), _key, and _filed, which
    is false for the further rows in which heads of parts meet."""

    def heads(item: str) -> Column:
        return F.array_distinct(F.transform(F.array(*(F.min(F.struct(F.xxhash64(f"{item}._id", F.lit(k)).alias("_h"), F.col(item).alias("b"))) for k in range(HEADS))), lambda h: h["b"]))

    own = [c for c in items.columns if c != "_keys"]
    filed = items.select(*own, F.explode("_keys").alias("_key"))
    counted = items.where(F.pmod("_id", F.lit(EVERY)) == 0).select(F.explode("_keys").alias("_key"))
    least = counted.count() // MOST + 64
    hot = materialize(counted.groupBy("_key").agg(F.count("*").alias("n")).where(F.col("n") > least).select(F.col("_key").alias("_hot")))  # MOST rows at most
    by = ["_key"]
    if not hot.isEmpty():
        met = filed.join(F.broadcast(hot), F.col("_key") == F.col("_hot"), "left")
        filed, by = met.withColumn("_part", F.when(F.col("_hot").isNotNull(), F.pmod("_id", F.lit(PARTS)))).drop("_hot"), ["_key", "_part"]
    filed = filed.repartition(*by)  # before the heads' columns are made, which would be dealt too
    block = Window.partitionBy(*by)
    least = [F.min(F.struct(F.xxhash64("_id", F.lit(k)).alias("_h"), F.struct(*own).alias("a"))).over(block).getField("a") for k in range(HEADS)]
    part = F.col("_part") if len(by) > 1 else F.lit(None).cast("bigint")
    headed = filed.select(F.struct(*own).alias("a"), "_key", part.alias("_part"), F.array_distinct(F.array(*least)).alias("b"), F.count("*").over(block).alias("n")).where("n > 1 or _part is not null")
    met = materialize(headed.select("a", "b", "_key", "_part", F.lit(True).alias("_filed")))
    if len(by) == 1:
        return met
    firsts = met.where("_part is not null").groupBy("_key", "_part").agg(F.first("b").alias("b")).select("_key", "_part", F.explode("b").alias("a"))
    whole = materialize(firsts.groupBy("_key").agg(heads("a").alias("b")))  # a row a hot block
    again = firsts.join(F.broadcast(whole), "_key").select("a", "b", "_key", "_part", F.lit(False).alias("_filed"))
    return met.union(again)


def _few(rows: DataFrame, alike) -> DataFrame:
    a, b = rows.where("_class <> _main").alias("a"), rows.alias("b")
    once = (F.col("b._class") == F.col("b._main")) | (F.col("a._id") < F.col("b._id"))
    return a.join(b, (F.col("a._key") == F.col("b._key")) & _apart("a", "b", alike) & once).select(*_pair("a._id", "b._id"))


def _many(rows: DataFrame, alike, prefixes, least_shared) -> DataFrame:
    """Pairs that share one of their rarest tokens."""
    items = materialize(rows.drop("_key", "_of", "_main", "_others").distinct())
    held = materialize(prefixes(items.select("_id")).select("_id", "_index", "_probe", F.size("_set").alias("_size"), F.explode("_set").alias("_token")))
    common = materialize(held.groupBy("_token").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("_token").alias("_t"), "_n"))
    rarest = Window.partitionBy("_id").orderBy(F.coalesce("_n", F.lit(1)), "_token")  # an item's own tokens
    ranked = held.join(common, F.col("_token") == F.col("_t"), "left").withColumn("_at", F.row_number().over(rarest))
    filed = ranked.where("_at <= greatest(_index, _probe) and _n is not null").select(F.col("_id").alias("_item"), "_token", "_size", (F.col("_size") - F.col("_at")).alias("_after"), (F.col("_at") <= F.col("_index")).alias("_indexed"), (F.col("_at") <= F.col("_probe")).alias("_probes"))
    met = materialize(filed.join(items, F.col("_item") == F.col("_id")).drop("_item"))
    main = _largest(met, "_token")
    open_rows = materialize(met.join(main, F.col("_token") == F.col("_of")))
    a, b = open_rows.where("_indexed").alias("a"), open_rows.where("_probes").alias("b")
    enough = 1 + F.least("a._after", "b._after") >= least_shared("a", "b")  # at the first token that two share, all others follow
    same = (F.col("a._token") == F.col("b._token")) & (F.col("a._len") <= F.col("b._len")) & (F.col("a._id") != F.col("b._id")) & enough & _apart("a", "b", alike)
    outside = a.where("_class <> _main").join(b, same)
    inside = a.where("_class = _main").join(b.where("_class <> _main"), same)
    return outside.select(*_pair("a._id", "b._id")).union(inside.select(*_pair("a._id", "b._id")))


def classes(
    items: DataFrame,
    alike: Callable[[str, str], Column],
    verify: Callable[[DataFrame], DataFrame],
    prefixes: Callable[[DataFrame], DataFrame],
    least_shared: Callable[[str, str], Column],
    first: Callable[[str, str], Column] | None = None,
    few: int = FEW,
    pairs: DataFrame | None = None,
) -> DataFrame:
    """(node, root) of the classes of `items`, a stored table with a row each: _id (long), _len, _keys, and what `alike` reads.

    `alike(a, b)` tells of two items under these aliases whether they may link.  `verify` gives the links of a table of pairs
    (x, y).  `prefixes` gives, for a table of _id, the items' _set of distinct tokens and how many of the rarest of
    them are looked up in longer items (_index) and in items not longer (_probe); `least_shared(a, b)` is how many tokens two
    items with _size tokens have to share at least.  `first`, of the pairs that `alike` lets pass, are those that meet as stars;
    up to `few` items outside a block's largest class meet all its items.  `pairs` (x, y) are verified with the stars.
    """
    first = first or alike
    met = _met(items)
    star = met.select("a", F.explode("b").alias("b")).where((F.col("a._id") != F.col("b._id")) & first("a", "b")).select(*_pair("a._id", "b._id"))
    links = materialize(verify(materialize((star if pairs is None else star.union(pairs)).distinct())))
    filed = met.where("_filed").select("a.*", "_key")

    roots = materialize(components(links, "x", "y"))
    told = materialize(filed.join(small(roots), F.col("_id") == F.col("node"), "left").withColumn("_class", F.coalesce("root", "_id")).drop("node", "root"))
    rows = materialize(told.join(small(_largest(told, "_key")), F.col("_key") == F.col("_of")))
    pairs = _few(rows.where(F.col("_others") <= few), alike)
    many = rows.where(F.col("_others") > few)
    if not many.isEmpty():
        pairs = pairs.union(_many(many, alike, prefixes, least_shared))
    stored = materialize(pairs.distinct())
    if stored.isEmpty():
        return roots
    more = materialize(verify(stored))
    if more.isEmpty():
        return roots
    return components(links.union(more), "x", "y")
