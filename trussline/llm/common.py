"""Helpers shared by the corpus operators: tables, scratch tables, words, components."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import materialize, remove

#: Tables of ids are handed to every task up to this many rows of some 8 to 24 bytes; beyond, they meet by shuffle.
BROADCAST = 1_000_000

#: A-Z to a-z, every other byte unchanged.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _alnum_table() -> bytes:
    """Lower-case A-Z; bytes that are neither 0-9, a-z nor part of a non-ASCII character become blanks."""
    keep = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
    return bytes(LOWER[b] if LOWER[b] in keep else 0x20 for b in range(256))


#: bytes.translate(ALNUM).split(b" ") leaves the words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text.
ALNUM = _alnum_table()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame) -> DataFrame:
    """`df` (a materialized table) to be broadcast if its size allows."""
    return F.broadcast(df) if df.count() <= BROADCAST else df


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 40) -> DataFrame:
    """Connected components of an undirected graph as rows (node, root), root the smallest node.

    Alternates large-star and small-star steps: each keeps the components and moves every node
    closer to its smallest neighbour, so the number of rounds grows with the logarithm of the
    longest chain.  Every step is a grouped minimum and a join; nothing is collected but a count
    and a checksum.  Roots themselves and nodes without an edge have no row.
    """
    def stored(df: DataFrame):
        """The table, and what tells one state from another, taken as it is written."""
        seen = Observation()
        table_ = materialize(df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")))
        return table_, (seen.get.get("n"), seen.get.get("h"))

    cur, seen = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    if not seen[0]:
        return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(rounds):
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        ).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(down, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), "m"), F.struct("u", "m"))).alias("e"))
            .select(F.col("e.u").alias("u"), F.col("e.m").alias("v"))
            .where("u <> v")
        ).distinct()
        new, now = stored(small)
        remove(cur)
        cur = new
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))


def slices(batches, rows: int = 256):
    """Arrow batches in pieces of so many rows, so that a worker holds the texts and results of few at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def shielded(stage):
    """For functions from documents (and more) to documents: columns of theirs that begin with an
    underscore, as the operators' own do, are renamed on the way in and named back on the way out."""

    @wraps(stage)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        names = {c: f"own{i}{c}" for i, c in enumerate(docs.columns) if c.startswith("_")}
        return stage(docs.withColumnsRenamed(names), *args, **kwargs).withColumnsRenamed({new: old for old, new in names.items()})

    return run
