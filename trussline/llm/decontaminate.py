r"""Benchmark decontamination with an Aho-Corasick automaton.

Benchmark texts are normalised to words (A-Z lower-cased, `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`) and cut
into windows of ten words; an item with fewer, but not none, is one window.  Each document is scanned
once by one automaton, and matches are mapped back to byte offsets of the original.

Ten words in a row hold one of the blocks of five that begin at every fifth word of an item.  So the
automaton's patterns are those blocks and the short items: as many nodes as the benchmark has words,
not ten times as many.  A block found in a document is extended to both sides along the item; ten words or more
are windows, and all of them are hit.

A benchmark of up to `MOST_WORDS` words (counted first) is one automaton, of about 100 bytes of a worker's memory a word.
Its words are broadcast, a size that the count bounds, and every Python worker builds the automaton from them once.  A
larger benchmark is dealt by a hash into parts within that bound, each with a pass of its own: what a pass has found is stored before
the next one begins, so a worker never holds two automata.  Hits are united, and the result is the same.  Items of more than
`SEGMENT` words are cut into segments that overlap by a window less one word, which keeps every window.

Defined cases: null, empty and wordless documents have no words and are clean; null and wordless
items are no windows; items with equal texts are all reported; a null item_id is no item but its windows hit; repeated rows are scanned alike; an
empty benchmark leaves every document clean; extra columns pass, but for columns with the result's own names, which are replaced.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from itertools import repeat

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, materialize, shielded, table

WINDOW = 10
#: Words of a block: two blocks and a window less one word have the same length.
BLOCK = WINDOW // 2
#: Benchmark words that one automaton holds.
MOST_WORDS = 5_000_000
#: Words of an item that stay together.
SEGMENT = 100_000
_NOT_BLANK = bytes(0 if b == 0x20 else 1 for b in range(256))


class Scanner:
    """Finds the windows of items, given as (item, text), in texts.  The automaton's letters are word numbers."""

    def __init__(self, items):
        owners: dict[tuple, set] = defaultdict(set)
        for item, text in items:
            if words := tuple(text.translate(ALNUM).split()) if text else ():
                owners[words].add(item)
        self.owners = list(owners.values())
        self.number: dict[bytes, int] = {}
        self.words: list[np.ndarray] = []  # of each distinct text, as numbers
        number, places = self.number, defaultdict(list)
        for k, words in enumerate(owners):
            coded = tuple(number.setdefault(w, len(number) + 1) for w in words)
            self.words.append(np.array(coded, np.int32))
            if len(coded) < WINDOW:
                places[coded].append((k, 0))
            else:
                for at in range(0, len(coded) - BLOCK + 1, BLOCK):
                    places[coded[at : at + BLOCK]].append((k, at))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for pattern, where in places.items():
            self.automaton.add_word(pattern, (len(pattern), where))
        if self.words:
            self.automaton.make_automaton()

    def find(self, text: bytes | None):
        """(number of words, hit mask over words or None, items with an occurring window)."""
        words = text.translate(ALNUM).split() if text else []
        if not words or not self.words:
            return len(words), None, ()
        codes = tuple(map(self.number.get, words, repeat(0)))
        hit, items, done = None, set(), {}
        for last, (size, places) in self.automaton.iter(codes):
            begin = last + 1 - size
            for k, at in places:
                if done.get((k, begin - at), -1) > begin:  # inside a stretch already followed
                    continue
                item = self.words[k]
                if len(item) < WINDOW:
                    left, right = begin, last + 1
                else:
                    back, ahead = min(at, begin), min(len(item) - at, len(words) - begin)
                    same = item[at - back : at + ahead] == codes[begin - back : begin + ahead]
                    wrong = np.flatnonzero(~same)
                    after = wrong.searchsorted(back)
                    left = begin - back + (int(wrong[after - 1]) + 1 if after else 0)
                    right = begin - back + (int(wrong[after]) if after < len(wrong) else back + ahead)
                    done[k, begin - at] = right
                    if right - left < WINDOW:
                        continue
                hit = np.zeros(len(words), bool) if hit is None else hit
                hit[left:right] = True
                items |= self.owners[k]
        return len(words), hit, items


_KEPT: dict[str, Scanner] = {}


def _scanner(name: str, held: Broadcast) -> Scanner:
    """The automaton of a part; a worker keeps one."""
    if name not in _KEPT:
        _KEPT.clear()
        part = pa.ipc.open_stream(held.value).read_all()
        _KEPT[name] = Scanner(zip(part.column("i").to_pylist(), part.column("t").to_pylist(), strict=True))
    return _KEPT[name]


def parts(benchmark: DataFrame, item: str = "item_id", text: str = "text", most: int = MOST_WORDS) -> list[DataFrame]:
    """Stored tables (i, t) of the benchmark's items and their words, of at most `most` words each (or one segment)."""
    # words as the automaton has them: A-Z lower-cased, all that is not ASCII kept
    low = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")
    told = benchmark.where(F.col(text).isNotNull()).select(F.col(item).cast("string").alias("i"), words.alias("w"))
    whole, step = F.size("w") <= SEGMENT, SEGMENT - WINDOW + 1
    cut = F.when(whole, F.array("w")).otherwise(F.transform(F.sequence(F.lit(0), F.size("w") - WINDOW, F.lit(step)), lambda k: F.slice("w", k + 1, SEGMENT)))
    rows = materialize(told.where(F.size("w") > 0).select("i", F.explode(cut).alias("w")).select("i", F.array_join("w", " ").cast("binary").alias("t"), F.size("w").cast("long").alias("n")))
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    number = max(1, -(-total // most))
    while True:
        dealt = F.pmod(F.xxhash64("t", "i"), F.lit(number))
        sizes = rows.groupBy(dealt.alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("c")).where((F.col("n") > most) & (F.col("c") > 1))
        if sizes.isEmpty() or number > 4 * total:
            return [rows.where(dealt == k).select("i", "t") for k in range(number)]
        number *= 2


def sent(part: DataFrame) -> Broadcast:
    """One part's rows, for all workers."""
    held, sink = part.toArrow(), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, held.schema) as stream:
        stream.write_table(held)
    return part.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())


def word_offsets(text: bytes) -> np.ndarray:
    """Start and end byte of every word in the original text."""
    inside = np.frombuffer(text.translate(ALNUM).translate(_NOT_BLANK), np.uint8).astype(np.int8)
    step = np.diff(np.concatenate(([0], inside, [0])))
    return np.stack([np.flatnonzero(step == 1), np.flatnonzero(step == -1)], 1)


@F.pandas_udf(T.ArrayType(T.ArrayType(T.LongType())))
def spans(text: pd.Series, hit: pd.Series) -> pd.Series:
    """Byte ranges in each original text of the runs of its hit words (word numbers in order)."""
    out = []
    for t, words in zip(text, hit, strict=True):
        if t is None or not len(words):
            out.append([])
            continue
        off, breaks = word_offsets(t.encode()), np.flatnonzero(np.diff(words) > 1)
        first, last = words[np.append(0, breaks + 1)], words[np.append(breaks, len(words) - 1)]
        out.append(np.stack([off[first, 0], off[last, 1]], 1).tolist())
    return pd.Series(out)


_FOUND = [
    T.StructField("_n_words", T.LongType()),
    T.StructField("_hit_words", T.ArrayType(T.LongType())),
    T.StructField("_items", T.ArrayType(T.StringType())),
]


def scan(docs: DataFrame, part: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with _n_words, _hit_words (word numbers) and _items, for a part of the benchmark."""
    at, held = docs.columns.index(text), sent(part)
    name = uuid.uuid4().hex

    def batches(it):
        find = _scanner(name, held).find
        for batch in it:
            n, hits, found = [], [], []
            for t in batch.column(at).cast(pa.binary()).to_pylist():
                words, hit, own = find(t)
                n.append(words)
                hits.append([] if hit is None else np.flatnonzero(hit))
                found.append(sorted(i for i in own if i is not None))
            cols = [pa.array(n, pa.int64()), pa.array(hits, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, *(f.name for f in _FOUND)])

    return docs.mapInArrow(batches, T.StructType([*docs.schema.fields, *_FOUND]))


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", most: int = MOST_WORDS) -> DataFrame:
    """One row for each row of `docs`, with its columns, those of `scan`, and _spans: the original byte
    ranges of the runs of hit words; earlier columns of these names are replaced."""
    docs = docs.drop("_spans", *(f"{f.name}{k}" for f in _FOUND for k in ("", "2")))
    first, *more = parts(benchmark, item, most=most)
    out = scan(docs, first, text)
    for part in more:
        names = {f.name: f"{f.name}2" for f in _FOUND}
        out = scan(materialize(out).withColumnsRenamed(names), part, text).select(
            *docs.columns,
            "_n_words",
            F.array_sort(F.array_union("_hit_words", "_hit_words2")).alias("_hit_words"),
            F.array_sort(F.array_union("_items", "_items2")).alias("_items"),
        )
    return out.withColumn("_spans", F.when(F.size("_hit_words") > 0, spans(text, "_hit_words")).otherwise(F.array().cast("array<array<bigint>>")))


@shielded
def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs` in which no window of the benchmark occurs."""
    return matches(docs, benchmark, text).where(F.size("_hit_words") == 0).select(*docs.columns)


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = matches(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.size("_hit_words").cast("long").alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "_items").cast("binary"), 256).alias("items_sha256"),
        (F.size("_hit_words") > 0).alias("contaminated"),
    )


OP8_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS win
  FROM b, LATERAL (SELECT unnest(generate_series(1, greatest(1, len(w) - 9))) AS i) WHERE len(w) > 0),
words AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
runs AS (SELECT rid, i, list(word) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS l FROM words),
hits AS (
  SELECT rid, i, s.n, item_id
  FROM runs JOIN (SELECT DISTINCT n FROM bw) s ON len(l) >= s.n
  JOIN bw ON bw.n = s.n AND bw.win = array_to_string(l[1:s.n], ' ')),
hit_words AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY rid),
items AS (SELECT rid, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words h USING (rid) LEFT JOIN items t USING (rid)
"""
