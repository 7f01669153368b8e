"""LM scoring: prediction by partial matching over a byte-context trie.

Texts are lower-cased (A-Z).  The trie holds, for every four bytes and the byte that follows, how
often training texts have them; four 0xFF bytes stand before a text and 0xFE ends it (neither byte
occurs in UTF-8).  A byte's probability is that of method C with full symbol exclusion: from the
longest context down, a context with counts T of q kinds gives n / (T + q) to a byte it has seen and
q / (T + q) to escaping, after the bytes seen in longer contexts are taken out of T and q; below
order 0 the bytes left of 256 are equally likely.  A text's score is the sum of log10 over its bytes
and its end.  Shorter contexts' counts are sums of longer ones', so the four-byte table is all that
is gathered.

On Spark: texts are dealt into chunks of about `CHUNK` bytes.  A chunk's distinct words and grams go,
with their training counts, to the exchange by key, are summed there over the whole corpus, turned
into values (grams by groups of the last two context bytes, at most 2**24 rows each) and travel back
to the chunks that asked for them, where the texts are scored.  Neither the trie nor the vocabulary
is collected, broadcast or cut; both grow with the corpus.

Defined cases: null and empty texts are an end alone; a null doc_id counts as an empty text under the
fold's checksum, so it is training; equal and repeated rows each count; without training texts every
byte has probability 1/256.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, table

ORDER = 4
PAD, END = 0xFF, 0xFE
CHUNK = 12 << 20
#: Small tables are still dealt into this many chunks, so that all tasks have work.
LEAST_CHUNKS = 32
FOLDS, HELD = 5, 1
#: Above this many (context, byte) cells ids are found by sorting instead of a table of the cells.
CELLS = 1 << 26
END_TOKEN = b"\n"
#: First byte of keys.
WORD, GRAM = b"w", b"g"


def gram_ids(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grams of all texts: distinct keys (rows of five bytes, sorted), the key number at every
    predicted byte, and each text's first position; positions of pads are left out."""
    pads = bytes([PAD]) * ORDER
    joined = np.frombuffer(b"".join([pads + t + bytes([END]) for t in texts]), np.uint8)
    used = np.unique(joined)
    dense = np.zeros(256, np.int32)
    dense[used] = np.arange(len(used), dtype=np.int32)
    x = dense[joined]
    ids, keys, a = x, used[:, None], len(used)
    for _ in range(ORDER):
        size = len(keys) * a
        if size <= CELLS:
            cell = ids[:-1] * np.int32(a) + x[len(x) - len(ids) + 1 :]
            present = np.zeros(size, bool)
            present[cell] = True
            found = np.flatnonzero(present)
            rank = np.cumsum(present, dtype=np.int32) - np.int32(1)
            ids = rank[cell]
        else:
            cell = ids[:-1].astype(np.int64) * a + x[len(x) - len(ids) + 1 :]
            found, ids = np.unique(cell, return_inverse=True)
            ids = ids.astype(np.int32)
        keys = np.concatenate([keys[found // a], used[found % a][:, None]], 1)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    begins = np.concatenate(([0], lengths.cumsum()))
    real = np.ones(len(ids), bool)  # ids[i] is the gram that ends at joined[i + ORDER]
    starts = begins[:-1] + ORDER * np.arange(len(texts))
    for j in range(ORDER):
        later = starts[1:] - ORDER + j
        real[later] = False
    return keys, ids[real], begins


def dictionary(chunk: int, texts: list[bytes], train: np.ndarray) -> pa.Table:
    """The chunk's distinct words and grams with their counts in training texts."""
    counts: Counter = Counter()
    rest: set[bytes] = set()
    for t, learn in zip(texts, train, strict=True):
        if learn:
            counts.update(t.split())
            counts[END_TOKEN] += 1
        else:
            rest.update(t.split())
            rest.add(END_TOKEN)
    rest.difference_update(counts)
    words = [WORD + w for w in (*counts, *rest)]
    keys, ids, begins = gram_ids(texts)
    learned = np.repeat(train, np.diff(begins))
    n = np.bincount(ids[learned], minlength=len(keys))
    asked = np.zeros(len(keys), bool)
    asked[ids] = True
    marked = np.concatenate([np.full((int(asked.sum()), 1), GRAM[0], np.uint8), keys[asked]], 1)
    flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(ORDER + 2), len(marked), [None, pa.py_buffer(marked.tobytes())])
    size = len(words) + len(flat)
    return pa.table(
        {
            "chunk": pa.array(np.full(size, chunk, np.int32)),
            "key": pa.concat_arrays([pa.array(words, pa.binary()), flat.cast(pa.binary())]),
            "n": pa.array(np.concatenate([np.fromiter(counts.values(), np.int64, len(counts)), np.zeros(len(rest), np.int64), n[asked]]).astype(np.int64)),
        }
    )


def log_probabilities(keys: np.ndarray, n: np.ndarray, n1: np.ndarray, n0: np.ndarray) -> np.ndarray:
    """log10 of P(byte | four bytes) for rows of keys that share the last two context bytes.

    n are the rows' counts, n1 and n0 the 256 counts after the last context byte and overall; all
    rows with counts must be there.  Rows with count 0 are questions only.
    """
    c4, at4 = np.unique(keys[:, 0].astype(np.int64) * 256 + keys[:, 1], return_inverse=True)
    at3, s = c4[at4] & 255, keys[:, 4].astype(np.int64)
    n3 = np.bincount(at3 * 256 + s, n, 1 << 16).reshape(256, 256)
    n2 = n3.sum(0)
    seen = n > 0
    t4, q4 = np.bincount(at4, n, len(c4)), np.bincount(at4, seen, len(c4))
    # what each context takes out of the next shorter one
    x3 = np.bincount(at4[seen], n3[at3[seen], s[seen]], len(c4))
    x2 = ((n3 > 0) * n2).sum(1)
    x1, x0 = ((n2 > 0) * n1).sum(), ((n1 > 0) * n0).sum()
    q3, q2, q1, q0 = (n3 > 0).sum(1), (n2 > 0).sum(), (n1 > 0).sum(), (n0 > 0).sum()
    rows = len(keys)
    full = np.ones(rows)
    levels = (
        (n, t4[at4], q4[at4]),
        (n3[at3, s], (n3.sum(1)[at3] - x3[at4]), q3[at3] - q4[at4]),
        (n2[s], n2.sum() - x2[at3], q2 - q3[at3]),
        (n1[s], (n1.sum() - x1) * full, (q1 - q2) * full),
        (n0[s], (n0.sum() - x0) * full, (q0 - q1) * full),
    )
    out, open_ = np.zeros(rows), np.ones(rows, bool)
    for count, total, kinds in levels:
        whole = total + kinds
        hit = open_ & (count > 0)
        out[hit] += np.log10(count[hit] / whole[hit])
        open_ &= ~hit
        escape = open_ & (kinds > 0)
        out[escape] += np.log10(kinds[escape] / whole[escape])
    out[open_] -= math.log10(256 - q0)
    return out


def _chunk_dictionary(batch: pa.Table) -> pa.Table:
    texts = [(t or b"").translate(LOWER) for t in batch.column("text").to_pylist()]
    return dictionary(batch.column("chunk")[0].as_py(), texts, batch.column("train").to_numpy(zero_copy_only=False))


def _rows(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _group_values(batch: pa.Table) -> pa.Table:
    head = batch.filter(batch.column("n1").is_valid())
    n1, n0 = (np.array(head.column(c)[0].as_py(), np.float64) for c in ("n1", "n0"))
    rows = batch.filter(batch.column("key").is_valid())
    keys = _rows(rows.column("key"), ORDER + 2)[:, 1:]
    value = log_probabilities(keys, rows.column("n").to_numpy().astype(np.float64), n1, n0)
    return pa.table({"key": rows.column("key"), "value": pa.array(value)})


def _score_chunk(docs: pa.Table, values: pa.Table) -> pa.Table:
    if not docs.num_rows:
        return pa.table({c: pa.array([], t) for c, t in (("i", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()))})
    texts = [(t or b"").translate(LOWER) for t in docs.column("text").to_pylist()]
    is_gram = pc.starts_with(values.column("key"), GRAM)
    words, grams = values.filter(pc.invert(is_gram)), values.filter(is_gram)
    number = {key[1:]: i for i, key in enumerate(words.column("key").to_pylist())}
    c = words.column("value").to_numpy()
    logs, known = np.log10(c + 0.5), c > 0
    n_tokens, n_known, base = [], [], []
    for t in texts:
        w = t.split()
        w.append(END_TOKEN)
        at = np.fromiter(map(number.__getitem__, w), np.int64, len(w))
        n_tokens.append(len(w))
        n_known.append(int(known[at].sum()))
        base.append(float(logs[at].sum()))
    keys, ids, begins = gram_ids(texts)
    asked = np.zeros(len(keys), bool)
    asked[ids] = True
    got = _rows(grams.column("key"), ORDER + 2)[:, 1:]
    order = np.lexsort(got.T[::-1])
    if not np.array_equal(got[order], keys[asked]):
        raise ValueError("a chunk's grams are not those that were asked for")
    value = np.zeros(len(keys))
    value[asked] = grams.column("value").to_numpy()[order]
    score = np.add.reduceat(value[ids], begins[:-1])
    return pa.table({"i": docs.column("i"), "held_out": pc.invert(docs.column("train")), "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()), "base": pa.array(base), "score": pa.array(score)})


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD


def _byte(key: Column, i: int) -> Column:
    return F.conv(F.hex(F.substring(key, i + 1, 1)), 16, 10).cast("int")


def _dense(counts: DataFrame, *by: str) -> DataFrame:
    """256 counts by byte `s` (one row each) in an array, for each `by`."""
    pairs = F.map_from_entries(F.collect_list(F.struct("s", "n")))
    filled = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0).cast("long")))
    return counts.groupBy(*by).agg(pairs.alias("m")).select(*by, filled.alias("a"))


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row for each row of `docs`: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score and score.

    Chunks come from row numbers that the scan gives, so `docs` should be a table or materialized.
    """
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    chunks = max(LEAST_CHUNKS, math.ceil(total / chunk))
    dealt = docs.select(
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(chunks)).cast("int").alias("chunk"),
        F.col(doc_id).cast("long").alias("i"),
        F.col(text).cast("binary").alias("text"),
        (~held_out(F.col(doc_id))).alias("train"),
    )
    asked = dealt.groupBy("chunk").applyInArrow(_chunk_dictionary, "chunk int, key binary, n long")
    # One exchange by key serves the sums and the way back, and one by suffix all that is asked of grams.
    # Filters on keys and unused columns would move below an exchange and make each reader one of its own,
    # for which the chunks would be read once more; so kinds are aggregates, and every reader uses every column.
    by_key = asked.repartition("key")
    is_gram = F.max((F.substring("key", 1, 1) == F.lit(GRAM)).cast("int")).alias("is_gram")
    sums = by_key.groupBy("key").agg(F.sum("n").alias("n"), is_gram, F.max("chunk").alias("last")).where("last >= 0")
    word = F.col("is_gram") == 0
    totals = sums.agg(F.coalesce(F.sum(F.when(word, F.col("n"))), F.lit(0)).alias("N"), F.count(F.when(word & (F.col("n") > 0), 1)).alias("V")).select(F.struct("N", "V").alias("t"))
    grams = sums.where("is_gram = 1").select("key", "n", F.substring("key", 4, 2).alias("suffix")).repartition("suffix")
    never_null = lambda i: F.coalesce(_byte(F.col("key"), i), F.lit(-1))  # noqa: E731  a join's null check would be such a filter
    last = grams.groupBy(never_null(4).alias("k3"), never_null(5).alias("s")).agg(F.sum("n").alias("n"), F.count("suffix").alias("rows")).where("n > 0 and rows > 0")
    zeros = F.array_repeat(F.lit(0).cast("long"), 256)
    n0 = _dense(last.groupBy("s").agg(F.sum("n").alias("n"))).select("a")
    heads = (
        grams.groupBy("suffix").agg(F.count("key").alias("rows"), F.sum("n").alias("all")).where("rows > 0 and all >= 0")
        .select("suffix", _byte(F.col("suffix"), 1).alias("k3"), F.lit(None).cast("binary").alias("key"), F.lit(None).cast("long").alias("n"))
        .join(F.broadcast(_dense(last, "k3")), "k3", "left")  # 256 rows at most
        .select("key", "n", "suffix", F.coalesce("a", zeros).alias("n1"), F.coalesce(n0.scalar(), zeros).alias("n0"))
    )
    none = F.lit(None).cast("array<bigint>")
    values = grams.select("key", "n", "suffix", none.alias("n1"), none.alias("n0")).union(heads).groupBy("suffix").applyInArrow(_group_values, "key binary, value double")
    # a key has one row a chunk, so a window holds as many rows as there are chunks at most
    whole = by_key.select("chunk", "key", F.sum("n").over(Window.partitionBy("key")).cast("double").alias("c"))
    told = whole.join(values, "key", "left").select("chunk", "key", F.coalesce("value", "c").alias("value"))
    scored = dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_score_chunk, "i long, held_out boolean, n_tokens long, n_known long, base double, score double")
    t = totals.scalar()
    return scored.withColumn("_t", t).select(
        F.col("i").alias("doc_id"),
        "held_out",
        "n_tokens",
        "n_known",
        F.col("_t.N").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.log10(F.col("_t.N") + 0.5 * (F.col("_t.V") + 1))).alias("base_score"),
        "score",
    )


def op6_lm_score(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
