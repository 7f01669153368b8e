"""SimHash near-duplicates, found through pivot distance tables.

A fingerprint is 64 bits: bit i is set when over half of the XXH64 values (seed 42) of the text's
word shingles have it set.  Two fingerprints link when they differ in at most two bits.

How links are found, over the *distinct* fingerprints:

1. For each fingerprint the table of its Hamming distances to `PIVOTS` reference fingerprints is
   computed once and packed into one long.
2. Two fingerprints that differ in two bits agree on at least two of four 16-bit blocks, so
   candidates meet under the six block pairs.  (Pivot distances alone give no equality key: one
   coordinate within two keeps a third of all random pairs.)
3. A candidate pair whose distances to some pivot differ by more than two cannot link (triangle
   inequality) and is discarded; survivors are verified by XOR and bit count.
4. A key shared by more than `HOT` fingerprints is not paired up.  Its members emit themselves and
   their 64 one-bit variants instead; members that share a variant z are linked to the smallest of
   them.  Sharing z is the same as differing in at most two bits up to connection, so the
   components are exactly those of all pairs, with 65 rows a fingerprint in place of a square.

Defined cases: null and empty texts and texts without words have fingerprint 0 and link like any
other; repeated rows and equal texts share a fingerprint; a null doc_id never is the smallest of a
component that has another; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import minmax
from .blocks import classes
from .common import LOWER, components, materialize, shielded, slices, small, table

SEED = 42
#: Reference fingerprints; their distances to a fingerprint fill the eight bytes of a long.
PIVOTS = tuple(xxhash.xxh64_intdigest(b"pivot %d" % i, SEED) for i in range(8))
BLOCK_BITS = 16
#: A block pair shared by more fingerprints than this is linked through one-bit variants.
HOT = 64
RADIUS = 2
#: Of near duplicates that `keep_one` drops: words of a shingle, percent of the union that their sets share, and the most
#: bits that their SimHashes differ in (4 in 1,000 random pairs are as close).
SHINGLE, PERCENT, WIDE = 5, 80, 21


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """The SimHash of one text: majority of each bit over its word shingles, repeats included."""
    words = text.translate(LOWER).split() if text else []
    if not words:
        return 0
    if len(words) > shingle:
        pieces = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    else:
        pieces = [b" ".join(words)]
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), np.uint64))


def majority(h: np.ndarray) -> int:
    """The bits that over half of the 64-bit hashes have set."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "_fp", shingle: int = 3) -> DataFrame:
    """`docs` and a long column `name` with the fingerprint of `text`; an earlier column of that name is replaced."""
    docs = docs.drop(name)
    at = docs.columns.index(text)

    def batches(it):
        for batch in it:
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            fps = np.fromiter((fingerprint(t, shingle) for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps)], names=[*batch.schema.names, name])

    return docs.mapInArrow(batches, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def _distances(fp: Column) -> Column:
    packed = F.lit(0).cast("long")
    for i, p in enumerate(PIVOTS):
        signed = p - (1 << 64) if p >> 63 else p
        packed = packed.bitwiseOR(F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(signed))).cast("long"), 8 * i))
    return packed


def _coordinate(packed: Column, i: int) -> Column:
    return F.shiftrightunsigned(packed, 8 * i).bitwiseAND(F.lit(255))


def _block_keys(fp: Column) -> Column:
    def block(i):
        return F.shiftrightunsigned(fp, BLOCK_BITS * i).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))

    pairs = [(i, j) for i in range(4) for j in range(i)]
    return F.array(
        *(
            F.shiftleft(block(i), 16).bitwiseOR(block(j)).bitwiseOR(F.lit(n << 32))
            for n, (i, j) in enumerate(pairs)
        )
    )


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) over distinct fingerprints `fp` whose components are those of all links."""
    keyed = fps.select("fp", _distances(F.col("fp")).alias("table"), F.explode(_block_keys(F.col("fp"))).alias("key"))
    sized = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = materialize(keyed.join(sized, "key"))
    cold = met.where(F.col("n") <= HOT)
    a, b = cold.alias("a"), cold.alias("b")
    apart = F.greatest(*(F.abs(_coordinate(F.col("a.table"), i) - _coordinate(F.col("b.table"), i)) for i in range(len(PIVOTS))))
    pairs = a.join(
        b,
        (F.col("a.key") == F.col("b.key"))
        & (F.col("a.fp") < F.col("b.fp"))
        & (apart <= RADIUS)
        & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= RADIUS),
    ).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    hot = met.where(F.col("n") > HOT).select("fp").distinct()
    variants = [F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit((1 << i) - (1 << 64 if i == 63 else 0))) for i in range(64))]
    stars = hot.select("fp", F.explode(F.array(*variants)).alias("z"))
    heads = stars.groupBy("z").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").select("z", "b")
    return pairs.union(stars.join(heads, "z").where("fp <> b").select(F.col("fp").alias("a"), "b"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (doc_id, fp, component_id) for each row of `docs`; component_id is the smallest
    doc_id reachable through links."""
    prints = materialize(with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), name="fp").select("doc_id", "fp"))
    fps = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(fps.select("fp")))
    classes = fps.join(roots, fps.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    named = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(classes.join(named, "root").select("fp", "component_id"), "fp")


def sketches(docs: DataFrame, text: str) -> DataFrame:
    """`docs` without `text` but with _id, a hash of its set of shingles, the set's size _len and SimHash _fp, and block keys _keys
    (bands of least and greatest images, as in `minmax`).  Texts without words have _id 0 and no keys."""
    at, kept = docs.columns.index(text), [f for f in docs.schema.fields if f.name != text]
    added = [T.StructField("_id", T.LongType()), T.StructField("_len", T.LongType()), T.StructField("_fp", T.LongType()), T.StructField("_keys", T.ArrayType(T.LongType()))]

    def batches(it):
        for batch in slices(it):
            found = [minmax.shingles(t, SHINGLE) for t in batch.column(at).cast(pa.binary()).to_pylist()]
            ids = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) if len(h) else 0 for h in found], np.uint64).view(np.int64)
            fps = np.array([majority(h) for h in found], np.uint64).view(np.int64)
            keys = pa.array([minmax.bands(minmax.signature(h)).view(np.int64) if len(h) else [] for h in found], pa.list_(pa.int64()))
            own = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*own, pa.array(ids), pa.array([len(h) for h in found], pa.int64()), pa.array(fps), keys], names=[f.name for f in (*kept, *added)])

    return docs.mapInArrow(batches, T.StructType([*kept, *added]))


def print_pairs(items: DataFrame) -> DataFrame:
    """Pairs (x, y) of `items` (_id, _len, _fp) whose SimHashes link, as `links` finds them: blocks propose, pivot distances discard.

    Items of one fingerprint meet the least of them, and those the least of each fingerprint linked to theirs.
    """
    sized = items.where("_len > 0").select("_id", F.col("_fp").alias("fp"))
    prints = materialize(sized.groupBy("fp").agg(F.min("_id").alias("least"), F.count("*").alias("n")))
    same = sized.join(prints.where("n > 1"), "fp").where("_id <> least").select(F.col("_id").alias("p"), F.col("least").alias("q"))
    of = lambda end: prints.select(F.col("fp").alias(end), F.col("least").alias("p" if end == "a" else "q"))
    apart = links(prints.select("fp")).join(of("a"), "a").join(of("b"), "b").select("p", "q")
    return materialize(same.union(apart).select(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y")).distinct())


def similar_classes(rows: DataFrame, made: DataFrame, firsts: DataFrame) -> DataFrame:
    """Classes (node, root) of texts whose sets of shingles share `PERCENT` of their union, also through others.  `rows` has
    _doc, _null, _row, _text, `made` their sketches, and `firsts` (_id, least) a row of each distinct set."""
    items = materialize(made.groupBy("_id").agg(*(F.first(c).alias(c) for c in ("_len", "_fp", "_keys"))))

    def alike(a: str, b: str) -> Column:
        near = F.bit_count(F.col(f"{a}._fp").bitwiseXOR(F.col(f"{b}._fp"))) <= WIDE
        return near & (100 * F.least(f"{a}._len", f"{b}._len") >= PERCENT * F.greatest(f"{a}._len", f"{b}._len"))

    def load(ids: DataFrame) -> DataFrame:
        wanted = materialize(firsts.join(ids.select(F.col("_id").alias("_want")).distinct(), F.col("_id") == F.col("_want")).select(F.col("least._doc").alias("_d"), F.col("least._row").alias("_r")))
        texts = rows.join(small(wanted), F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_row") == F.col("_r"))).select("_text")
        return materialize(minmax.sets(texts, SHINGLE))

    def verify(pairs: DataFrame) -> DataFrame:
        return minmax.jaccard_links(pairs, load(pairs.select(F.explode(F.array("x", "y")).alias("_id"))), PERCENT)

    found = materialize(classes(items, alike, verify, lambda ids: minmax.jaccard_prefixes(load(ids).join(ids, "_id", "left_semi"), PERCENT), minmax.jaccard_shared(PERCENT)))
    near = print_pairs(items)
    if near.isEmpty():
        return found
    # what the bands have put in one class already tells nothing new
    root = lambda end: found.select(F.col("node").alias(f"_{end}"), F.col("root").alias(f"_{end}root"))
    met = near.join(root("x"), F.col("x") == F.col("_x"), "left").join(root("y"), F.col("y") == F.col("_y"), "left")
    open_ = materialize(met.where(F.coalesce("_xroot", "x") != F.coalesce("_yroot", "y")).select("x", "y"))
    if open_.isEmpty():
        return found
    more = materialize(verify(open_))
    return components(found.select(F.col("node").alias("x"), F.col("root").alias("y")).union(more), "x", "y")


@shielded
def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with one row of each group of near duplicates: the smallest doc_id (nulls last), ties settled by the row's hash.

    Texts whose sets of shingles of `SHINGLE` words share `PERCENT` of their union are duplicates, also through
    others.  Texts without words are duplicates of each other.

    Such texts differ in about ten bits of a SimHash of 64, where neither pivots nor pairs of bit blocks tell
    candidates from random pairs.  So texts meet under bands of least and greatest hashes (`minmax`), across
    classes only (`blocks`), where SimHash discards pairs beyond `WIDE` bits.  Texts whose SimHashes differ in `RADIUS` bits or
    fewer meet through blocks and pivots (`links`).  The sets verify both.
    Rows equal in every column that can be hashed are one row's copies, of which one stays.
    """
    hashed = [F.col(f.name) for f in docs.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    tagged = docs.withColumns({"_row": F.xxhash64(*hashed), "_null": F.col(doc_id).isNull()})
    rows = tagged.select(F.col(doc_id).alias("_doc"), "_null", "_row", F.col(text).alias("_text"))
    made = materialize(sketches(rows, "_text"))
    firsts = materialize(made.groupBy("_id").agg(F.min(F.struct("_null", "_doc", "_row")).alias("least")))
    roots = similar_classes(rows, made, firsts)
    heads = firsts.join(roots, firsts["_id"] == roots["node"], "left").groupBy(F.coalesce("root", "_id").alias("root")).agg(F.min("least").alias("k"))
    heads = heads.select(F.col("k._doc").alias("_k"), F.col("k._row").alias("_krow"))
    copies = made.groupBy(F.col("_doc").alias("_d"), F.col("_row").alias("_r")).agg(F.count("*").alias("_n"))
    kept = materialize(heads.join(copies, F.col("_k").eqNullSafe(F.col("_d")) & (F.col("_krow") == F.col("_r"))).select("_k", "_krow", "_n"))
    stay = tagged.join(kept, tagged[doc_id].eqNullSafe(kept["_k"]) & (tagged["_row"] == kept["_krow"]))
    once = stay.where("_n = 1").select(*docs.columns)
    if kept.where("_n > 1").isEmpty():
        return once
    more = stay.where("_n > 1").groupBy("_k", "_krow").agg(F.first(F.struct(*(F.col(c) for c in docs.columns))).alias("_d"))
    return once.union(more.select(*(F.col("_d").getField(c).alias(c) for c in docs.columns)))


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
