"""Quality rules: gradient-boosted trees over document statistics.

Statistics of every whole text come from one pass of Arrow batches.  A tree ensemble is fitted to
the labelled documents (`labels.quality`) on at most `SAMPLE` of them, taken by the order of a hash
of doc_id; its margin must not rise with the shares of symbols, duplicate lines, repeated words and
shouted words.  A document is kept unless a base rule rejects it or the model gives it a probability
of good quality below `THRESHOLD`.  Without any labelled document only the base rules decide.

Defined cases: null, empty and wordless texts have all counts 0 and fail the base rule (fewer than
20 words); of a doc_id labelled more than once the lowest quality counts; labels that are null or of
unknown documents are ignored; repeated rows are judged alike; extra columns pass, but for columns with the
result's own names, which are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .boosting import Trees, fit
from .common import shielded, table

#: Labelled documents the trees are fitted to, at most.
SAMPLE = 20_000
THRESHOLD = 0.5
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
_CONTINUATION = bytes(range(0x80, 0xC0))
_NOT_SYMBOL = bytes(b for b in range(256) if b not in SYMBOLS)
_NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_NOT_DIGIT = bytes(b for b in range(256) if not 48 <= b <= 57)
_NOT_STOP = bytes(b for b in range(256) if b not in b".!?;:,")

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Name of each feature and the sign its effect on quality must have (0: free).
FEATURES = (
    ("log_words", 0),
    ("mean_word", 0),
    ("symbol_share", -1),
    ("dup_line_share", -1),
    ("repeat_share", -1),
    ("distinct_share", 0),
    ("upper_share", -1),
    ("digit_share", 0),
    ("stop_share", 0),
    ("line_words", 0),
    ("pipe_share", -1),
    ("bang_share", -1),
)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words inside any run of `size` words that occurs twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    roll = np.zeros(n, np.uint64)
    for j in range(size):
        roll = roll * _ODD + h[j : j + n]
    order = np.sort(roll)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(roll, twice))
    groups: dict[tuple, list[int]] = {}
    for i in at.tolist():  # the hash only proposes; equal words decide
        groups.setdefault(tuple(words[i : i + size]), []).append(i)
    edge = np.zeros(len(words) + 1, np.int64)
    for starts in groups.values():
        if len(starts) > 1:
            np.add.at(edge, starts, 1)
            np.add.at(edge, np.add(starts, size), -1)
    return int((edge.cumsum() > 0).sum())


def statistics(text: bytes | None) -> tuple[list[int], list[float]]:
    """COUNTS and FEATURES of one text."""
    text = text or b""
    words = text.split()
    if not words:
        symbols = len(text.translate(None, _NOT_SYMBOL))
        return [0, 0, symbols, 0, 0], [0.0] * len(FEATURES)
    n = len(words)
    chars = len(text.translate(None, SPACE + _CONTINUATION))
    symbols = len(text.translate(None, _NOT_SYMBOL))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    return [n, chars, symbols, dup, repeat], [
        float(np.log1p(n)),
        chars / n,
        symbols / chars,
        dup / len(lines),
        repeat / n,
        len(set(words)) / n,
        len(text.translate(None, _NOT_UPPER)) / chars,
        len(text.translate(None, _NOT_DIGIT)) / chars,
        len(text.translate(None, _NOT_STOP)) / n,
        n / len(lines),
        text.count(b"|") / n,
        text.count(b"!!") / n,
    ]


def base_failed(n_words, n_repeat):
    return (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", sample: int = SAMPLE) -> Trees | None:
    """Trees for `labels.quality`, or None without labelled documents of both kinds.

    The sample is taken from the labels before any text is read; only its numbers reach the driver.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", F.col(text).alias("_text")).join(F.broadcast(chosen), "doc_id")

    def batches(it):
        for batch in it:
            feats = [statistics(t)[1] for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(feats, pa.list_(pa.float64()))], names=["i", "y", "x"])

    # repeated rows of a doc_id count once, so the sample's size holds whatever the table repeats
    rows = texts.select("doc_id", "_text", "_quality").mapInArrow(batches, "i long, y int, x array<double>").groupBy("i").agg(F.min(F.struct("x", "y")).alias("r")).select("i", "r.x", "r.y").toArrow()
    order = np.argsort(rows.column("i").to_numpy(), kind="stable")
    y = (rows.column("y").to_numpy()[order] > 0).astype(float)
    if len(set(y.tolist())) < 2:
        return None
    x = np.array(rows.column("x").to_pylist(), float)[order]
    return fit(x, y, [s for _, s in FEATURES])


def judge(docs: DataFrame, trees: Trees | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with the COUNTS as _<name>, _base_failed, _quality (probability) and _kept; earlier columns of these names are replaced."""
    added = [*(T.StructField(f"_{c}", T.LongType()) for c in COUNTS), T.StructField("_base_failed", T.BooleanType()), T.StructField("_quality", T.DoubleType()), T.StructField("_kept", T.BooleanType())]
    docs = docs.drop(*(f.name for f in added))
    at = docs.columns.index(text)

    def batches(it):
        for batch in it:
            got = [statistics(t) for t in batch.column(at).cast(pa.binary()).to_pylist()]
            counts = np.array([c for c, _ in got], np.int64).reshape(-1, len(COUNTS))
            feats = np.array([f for _, f in got], float).reshape(-1, len(FEATURES))
            failed = base_failed(counts[:, 0], counts[:, 4])
            p = 1 / (1 + np.exp(-trees.margin(feats))) if trees else np.ones(len(got))
            cols = [*(pa.array(counts[:, j]) for j in range(len(COUNTS))), pa.array(failed), pa.array(p), pa.array(~failed & (p >= threshold))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, *(f.name for f in added)])

    return docs.mapInArrow(batches, T.StructType([*docs.schema.fields, *added]))


@shielded
def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their columns."""
    return judge(docs, train(docs, labels)).where("_kept").select(*docs.columns)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = judge(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", *(F.col(f"_{c}").alias(c) for c in COUNTS), F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"), F.round("_quality", 6).alias("quality"))
