r"""Runs of periodic words, found by way of the runs theorem.

A run is a stretch of words with smallest period p, `EXPONENT` times p and `LEAST` words long at least, that no
neighbouring word extends with that period.  For each text:

1. Words become numbers; the suffix array and its inverse come from prefix doubling, the table of longest
   common prefixes from one walk over the text.
2. The longest Lyndon word at a place ends where the inverse suffix array has its next smaller value, and
   under the inverse order of letters where it has its next larger one (the text's end is the least letter of
   the first order and the largest of the second).  Each run has such a word, of the length of its period, among
   the first p places: by the runs theorem no text has more runs than words.
3. A Lyndon word is extended to the right by the longest common prefix of its two places, a minimum over a range of
   the table, and to the left by that of the reversed text.  Range minima are answered from a sparse
   table, a level at a time, so that a text takes memory in proportion to its words.

Roots that cannot reach the exponent to the right are left out before the reversed text is indexed.  A text is one
task's work, as its runs are its own; time is n log n a text.

Defined cases: null, empty and wordless texts have no runs and an empty collapsed text; a null doc_id plays no part (the
query's rewriting leaves such rows as they are); repeated rows have the same runs each; an empty table gives no rows;
extra columns pass, but for columns with the result's own names, which are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

#: Words of a run at least, and how often its period has to fit.
LEAST, EXPONENT = 6, 4


def suffix_array(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and each suffix's place in it; a text's end comes before every number."""
    n, rank, step = len(codes), codes.astype(np.int64), 1
    base = max(n, int(codes.max(initial=0)) + 1) + 1
    while True:
        key = rank * base
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        held = key[order]
        new = np.concatenate(([0], np.cumsum(held[1:] != held[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order, rank
        step *= 2


def common_prefixes(codes: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Entry r: words that the suffixes at places r - 1 and r of the order begin with alike."""
    n, text, at, out, same = len(codes), codes.tolist(), order.tolist(), [0] * len(codes), 0
    for i, r in enumerate(rank.tolist()):
        if not r:
            same = 0
            continue
        j = at[r - 1]
        far = n - max(i, j)
        while same < far and text[i + same] == text[j + same]:
            same += 1
        out[r] = same
        same -= same > 0
    return np.array(out, np.int64)


def range_minima(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least of values[low : high + 1] for many ranges: a sparse table of which one level is held at a time."""
    out = np.empty(len(low), values.dtype)
    level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    row = values
    for k in range(int(level.max(initial=-1)) + 1):
        mine = np.flatnonzero(level == k)
        out[mine] = np.minimum(row[low[mine]], row[high[mine] - (1 << k) + 1])
        row = np.minimum(row[: -(1 << k)], row[1 << k :])
    return out


class Extensions:
    """Longest common prefixes of any two suffixes of a text."""

    def __init__(self, codes: np.ndarray):
        self.order, self.rank = suffix_array(codes)
        self.shared = common_prefixes(codes, self.order, self.rank)

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.rank[i], self.rank[j]
        return range_minima(self.shared, np.minimum(a, b) + 1, np.maximum(a, b))


def next_smaller(values: list[int]) -> list[int]:
    """For each place the next one with a smaller value, or the length."""
    out, waiting = [len(values)] * len(values), []
    for i, x in enumerate(values):
        while waiting and values[waiting[-1]] > x:
            out[waiting.pop()] = i
        waiting.append(i)
    return out


def runs(codes: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start, then period; `exponent` is 2 or more."""
    n, none = len(codes), np.empty((0, 3), np.int64)
    if n < max(least, exponent):
        return none
    ahead = Extensions(codes)
    ends = np.concatenate([next_smaller(v.tolist()) for v in (ahead.rank, -ahead.rank)])
    i, fits = np.tile(np.arange(n), 2), (ends < n)
    i, j = i[fits], ends[fits]
    # of a run's roots, one begins within its first period: that one leaves so many periods to its right
    short = i + (exponent - 1) * (j - i) < n
    i, j = i[short], j[short]
    right = ahead(i, j)
    near = right >= (exponent - 2) * (j - i)
    i, j, right = i[near], j[near], right[near]
    if not len(i):
        return none
    left, inside = np.zeros(len(i), np.int64), i > 0
    if inside.any():
        left[inside] = Extensions(codes[::-1])(n - i[inside], n - j[inside])
    period = j - i
    found = np.stack([i - left, j + right - (i - left), period], 1)
    found = found[found[:, 1] >= np.maximum(least, exponent * period)]
    found = np.unique(found, axis=0)  # by start, then length
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def numbered(words: list[bytes]) -> np.ndarray:
    number: dict[bytes, int] = {}
    return np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))


def collapsed(words: list[bytes], found: np.ndarray) -> bytes:
    """The words without those that stand in a run after its first period."""
    keep = np.ones(len(words), bool)
    for start, length, period in found.tolist():
        keep[start + period : start + length] = False
    return b" ".join(words if keep.all() else [words[k] for k in np.flatnonzero(keep).tolist()])


_RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
_FOUND = [T.StructField("_n_words", T.LongType()), T.StructField("_runs", T.ArrayType(_RUN)), T.StructField("_collapsed", T.StringType())]


def with_runs(docs: DataFrame, text: str = "text", least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """`docs` with _n_words, _runs (start, length, period, by start, then period) and _collapsed (kept words joined by a blank)."""
    docs = docs.drop(*(f.name for f in _FOUND))
    at = docs.columns.index(text)

    def batches(it):
        for batch in it:
            n, found, kept = [], [], []
            for t in batch.column(at).cast(pa.binary()).to_pylist():
                words = t.split() if t else []
                own = runs(numbered(words), least, exponent)
                n.append(len(words))
                found.append(own)
                kept.append(collapsed(words, own))
            ends = np.cumsum([0, *map(len, found)])
            rows = np.concatenate([np.empty((0, 3), np.int64), *found])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(3)], _RUN.names))
            cols = [pa.array(n, pa.int64()), lists, pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, *(f.name for f in _FOUND)])

    return docs.mapInArrow(batches, T.StructType([*docs.schema.fields, *_FOUND]))


def strongest(found: Column) -> Column:
    """Of an array of runs that with the greatest exact length / period, the first among equals; null without runs."""
    return F.aggregate(found, F.get(found, 0), lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))


def planted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` in which a tenth of the texts, told by their doc_id, repeat a stretch of theirs up to the end."""
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    words = F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")
    told = docs.withColumns({"_g": F.floor(h / 10), "_w": F.when(h % 10 == 0, words)})
    n = F.nullif(F.size("_w"), F.lit(0))
    spots = told.withColumn("_a", F.col("_g") % n).withColumn("_p", 1 + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8)))
    turned = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("_w", F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int")))
    return spots.withColumn(text, F.when(n > 0, F.array_join(turned, " ")).otherwise(F.col(text))).select(*docs.columns)


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    found = with_runs(planted(table(spark, sf_dir, "documents").select("doc_id", "text"))).withColumn("_best", strongest(F.col("_runs")))
    rows = F.array_join(F.transform("_runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    return found.select(
        "doc_id",
        F.size("_runs").cast("long").alias("n_runs"),
        F.col("_best.start").alias("start"),
        F.col("_best.length").alias("length"),
        F.col("_best.period").alias("period"),
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(rows.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("_collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


#: A run of period p is a stretch of equal words p apart; what holds with a smaller period too goes.
OP13_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT b, 0 AS k, b AS c FROM range(256) r(b)
  UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
tab AS (SELECT b, c FROM bits WHERE k = 8),
ids AS (SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR) AS s FROM documents),
crc AS (
  SELECT doc_id, s, 0 AS k, CAST(4294967295 AS BIGINT) AS c FROM ids
  UNION ALL SELECT doc_id, s, k + 1, xor(tab.c, crc.c >> 8) FROM crc JOIN tab ON tab.b = xor(crc.c, ascii(s[k + 1])) & 255 WHERE k < length(s)),
h AS (SELECT doc_id, xor(c, 4294967295) AS h FROM crc WHERE k = length(s)),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT d.*, h, h // 10 AS g, len(w) AS n, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d LEFT JOIN h USING (doc_id)),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM g),
x AS (SELECT rid, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM p),
t AS (SELECT rid, n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM x),
pairs AS (SELECT s.rid, s.i, e.i - s.i AS p FROM t s JOIN t e ON s.rid = e.rid AND s.word = e.word AND e.i > s.i AND 4 * (e.i - s.i) <= s.n),
isles AS (SELECT rid, p, i, i - row_number() OVER (PARTITION BY rid, p ORDER BY i) AS isle FROM pairs),
wide AS (SELECT rid, p, min(i) AS start, count(*) + p AS length FROM isles GROUP BY rid, p, isle HAVING count(*) + p >= greatest(6, 4 * p)),
runs AS (SELECT rid, start, length, min(p) AS period FROM wide GROUP BY 1, 2, 3),
best AS (SELECT rid, start, length, period FROM runs QUALIFY row_number() OVER (PARTITION BY rid ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) = 1),
told AS (SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS s FROM runs GROUP BY 1),
gone AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS s FROM t ANTI JOIN gone USING (rid, i) GROUP BY 1)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period,
       CAST(1000 * length // period AS BIGINT) AS exponent_milli, sha256(coalesce(told.s, '')) AS runs_sha256, sha256(coalesce(kept.s, '')) AS collapsed_sha256
FROM x LEFT JOIN told USING (rid) LEFT JOIN best USING (rid) LEFT JOIN kept USING (rid)
"""
