r"""MinHash near-duplicates with min-max hashing.

A document's set are its distinct word shingles, as 64-bit hashes.  Each of `PERMUTATIONS` permutations of the hashes is
evaluated once and gives two values, its least and its greatest image, so a signature of twice as many
values costs half the evaluations; either agrees for two sets with their Jaccard similarity as probability, and as
least and greatest exclude each other the estimate varies less than with as many independent values.

Bands of `ROWS` values are block keys: bands of least values and bands of greatest values, never mixed, so the values of a
band are independent.  Two sets of similarity 0.8 share none of the 24 bands with probability 7e-5, of 0.85 with 2e-6.
One bit of each value makes a sketch of 128 bits, which differ in a tenth of the bits at a similarity of
0.8; pairs beyond `FAR` bits (3 in a million at 0.8) are discarded before their sets are read.
Items meet within blocks as `blocks` has it: no cap, no square.  Full sets confirm every link.

Documents with equal sets are one item.  Links are those of 100 * intersection >= 80 * union.

Defined cases: null, empty and wordless texts have an empty set, link with nothing and stay; fewer words than a
shingle are one shingle; a null doc_id is the smallest of no component that has another, and a component without any keeps all
its rows; repeated rows are linked as equal sets, and rows of the kept doc_id all stay; an empty table gives no rows; other columns of
`docs` are not read.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import classes
from .common import LOWER, materialize, slices, small, table

SEED = 42
#: Words of a shingle of the query; percent of the union that linked sets share.
SHINGLE, PERCENT = 2, 80
PERMUTATIONS, ROWS = 64, 5
#: Of 128 sketch bits, so many differ at most.
FAR = 30


def _constants(name: bytes, n: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(b"%s %d" % (name, k), SEED) | 1 for k in range(n)], np.uint64)


_FACTORS, _SHIFTS, _MIX = _constants(b"factor", PERMUTATIONS), _constants(b"shift", PERMUTATIONS), _constants(b"row", ROWS)
BANDS = 2 * (PERMUTATIONS // ROWS)
_BAND = _constants(b"band", BANDS)


def shingles(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; with fewer words, of the whole sequence."""
    words = text.translate(LOWER).split() if text else []
    pieces = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)) if len(words) > size else [b" ".join(words)] * bool(words)
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), np.uint64))


def signature(hashes: np.ndarray) -> np.ndarray:
    """Least images under each permutation, then greatest, of a set that is not empty."""
    low, high = np.full(PERMUTATIONS, ~np.uint64(0)), np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(hashes), 2048):
        images = _FACTORS[:, None] * hashes[at : at + 2048] + _SHIFTS[:, None]
        np.minimum(low, images.min(1), out=low)
        np.maximum(high, images.max(1), out=high)
    return np.concatenate([low, high])


def bands(signed: np.ndarray) -> np.ndarray:
    """A block key for each band: half of them over least values, half over greatest."""
    half = BANDS // 2 * ROWS
    rows = np.concatenate([signed[:half], signed[PERMUTATIONS : PERMUTATIONS + half]]).reshape(BANDS, ROWS)
    return (rows * _MIX).sum(1, dtype=np.uint64) * _BAND + _BAND


def sketch(signed: np.ndarray) -> np.ndarray:
    """One bit of each value, as two 64-bit numbers."""
    return np.packbits((signed * _FACTORS[0]) >> np.uint64(63)).view(np.uint64)


_COLUMNS = ("_id", "_len", "_low", "_high", "_keys")


def sketched(docs: DataFrame, text: str, size: int) -> DataFrame:
    """`docs` without `text` but with _id (a hash of the set; null for an empty one), _len, the sketch and the block keys."""
    at, kept = docs.columns.index(text), [c for c in docs.columns if c != text]
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != text), "_id long, _len long, _low long, _high long, _keys array<long>"])

    def one(t: bytes | None):
        if not len(h := shingles(t, size)):
            return None, 0, None, None, None
        signed = signature(h)
        low, high = sketch(signed).view(np.int64).tolist()
        return int(np.int64(np.uint64(xxhash.xxh64_intdigest(h.tobytes(), SEED)))), len(h), low, high, bands(signed).view(np.int64)

    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))

    def batches(it):
        for batch in slices(it):
            found = list(map(one, batch.column(at).cast(pa.binary()).to_pylist()))
            cols = [pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != at), *cols], names=[*kept, *_COLUMNS])

    return docs.mapInArrow(batches, fields)


def sets(texts: DataFrame, size: int) -> DataFrame:
    """(_id, _set) of a table of one column of texts; empty sets have no row."""

    def batches(it):
        for batch in slices(it):
            found = [h for t in batch.column(0).cast(pa.binary()).to_pylist() if len(h := shingles(t, size))]
            ids = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([h.view(np.int64) for h in found], pa.list_(pa.int64()))], names=["_id", "_set"])

    return texts.mapInArrow(batches, "_id long, _set array<long>").dropDuplicates(["_id"])


def close(a: str, b: str, percent: int = PERCENT) -> Column:
    """Whether two items' sizes and sketches allow a link."""
    apart = sum(F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in ("_low", "_high"))
    return (apart <= FAR) & (100 * F.least(f"{a}._len", f"{b}._len") >= percent * F.greatest(f"{a}._len", f"{b}._len"))


def jaccard_links(pairs: DataFrame, held: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (x, y) whose sets in `held` (_id, _set) share so much of their union."""
    both = pairs.join(held.select(F.col("_id").alias("x"), F.col("_set").alias("a")), "x").join(held.select(F.col("_id").alias("y"), F.col("_set").alias("b")), "y")
    shared = F.size(F.array_intersect("a", "b"))
    return both.where(100 * shared >= percent * (F.size("a") + F.size("b") - shared)).select("x", "y")


def jaccard_prefixes(held: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Prefix lengths of sets for `blocks.classes`: of sizes n <= m the intersection is percent / (100 + percent) * (n + m) or more."""
    n = F.size("_set")
    return held.select("_id", "_set", (n - F.ceil(2 * percent * n / (100 + percent)) + 1).alias("_index"), (n - F.ceil(percent * n / 100) + 1).alias("_probe"))


def jaccard_shared(percent: int = PERCENT):
    """The least intersection of two sets, as `blocks.classes` asks for it."""
    return lambda a, b: F.ceil(percent * (F.col(f"{a}._size") + F.col(f"{b}._size")) / (100 + percent))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row (doc_id, n_shingles, component_id, kept) for each row of `docs`."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    made = materialize(sketched(rows, "text", shingle))
    items = materialize(made.where("_id is not null").groupBy("_id").agg(F.min("doc_id").alias("_least"), *(F.first(c).alias(c) for c in _COLUMNS[1:])))

    def load(ids: DataFrame) -> DataFrame:
        wanted = materialize(items.join(ids.select(F.col("_id").alias("_want")).distinct(), F.col("_id") == F.col("_want")).select(F.col("_least").alias("_doc")).distinct())
        texts = rows.join(small(wanted), F.col("doc_id").eqNullSafe(F.col("_doc"))).select("text")
        return materialize(sets(texts, shingle))

    def verify(pairs: DataFrame) -> DataFrame:
        return jaccard_links(pairs, load(pairs.select(F.explode(F.array("x", "y")).alias("_id"))), percent)

    def prefixes(ids: DataFrame) -> DataFrame:
        return jaccard_prefixes(load(ids).join(ids, "_id", "left_semi"), percent)

    roots = classes(items.drop("_least"), lambda a, b: close(a, b, percent), verify, prefixes, jaccard_shared(percent))
    rooted = materialize(items.select("_id", "_least").join(roots, F.col("_id") == F.col("node"), "left").select("_id", "_least", F.coalesce("root", "_id").alias("_root")))
    least = materialize(rooted.groupBy(F.col("_root").alias("_r")).agg(F.min("_least").alias("_component")))
    named = materialize(rooted.join(least, F.col("_root") == F.col("_r")).select(F.col("_id").alias("_of"), "_component"))
    out = made.join(named, F.col("_id") == F.col("_of"), "left")
    component = F.when(F.col("_id").isNull(), F.col("doc_id")).otherwise(F.col("_component"))
    return out.select("doc_id", F.col("_len").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op11_minmax(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
