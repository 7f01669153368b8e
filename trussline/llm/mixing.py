"""Soft-membership mixing of domains to target token weights.

A softmax regression over the hashed words that tell the domains apart, fitted to at most `SAMPLE` labelled documents (in the order
of a hash of doc_id), gives every document a posterior over the domains low (quality 0), toxic and
clean.  Document rates r >= 0 minimise the squared distance of the expected domain token totals
sum(r * tokens * posterior) from the targets, by accelerated projected gradient from r = 1.  Distances
are measured in the inverse of the domains' Gram matrix, so that domains which share documents do not
slow the descent and a step of 1 is the longest safe one: where no rate meets zero, one step ends
the fit.  Each step is one aggregate of as many sums as there are domains over the documents' table,
after which only those sums reach the driver.  The rates themselves are a fold of the steps over the rows, so nothing but
the table of posteriors is stored.

Targets are weights of the result; its size is such that the domain `ANCHOR` keeps its expected
tokens; scarcer domains are raised to their weight, richer ones lowered.  A fit that is not within
`TOLERANCE` after `STEPS` steps, as where all posteriors are alike, gives a warning with its totals.  A document is taken floor(rate) times and once more with the probability of the fraction,
decided by a hash of the row.

Defined cases: null, empty and wordless texts have no tokens, posteriors that follow from the bias
alone, and rate 1; a doc_id labelled more than once takes the worst of its labels; domains without
labels get posterior 0, without any label all documents are clean; a domain without expected
tokens is left out of the targets; equal rows get equal rates and share the decision; an empty table gives no rows.
"""

from __future__ import annotations

import warnings
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, materialize, shielded, table

DOMAINS = ("low", "toxic", "clean")
WEIGHTS = {"low": 0.05, "toxic": 0.05, "clean": 0.9}
ANCHOR = "clean"
SAMPLE = 6_000
BUCKETS = 1 << 17
TELLING = 6.0
STEPS = 60
#: The fit ends when no domain is off by more than this share of its own target tokens.
TOLERANCE = 2e-3


def features(text: bytes | None) -> tuple[int, np.ndarray]:
    """(number of words, hash buckets of the distinct words and of the text's marks)."""
    if not text:
        return 0, np.zeros(0, np.int32)
    words = text.translate(ALNUM).split()
    distinct = set(words)
    marks = {b"\x00" + bytes([c]) * min(3, text.count(bytes([c])) * 40 // len(text)) for c in b"|!#%$&*"}
    repeat = b"\x01" + b"r" * int(4 * len(distinct) / max(1, len(words)))
    found = {zlib.crc32(w) % BUCKETS for w in (*distinct, *marks, repeat)}
    return len(words), np.fromiter(found, np.int32, len(found))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _sums(index: np.ndarray, owner: np.ndarray, rows: int, weights: np.ndarray) -> np.ndarray:
    return np.stack([np.bincount(owner, weights[index, k], rows) for k in range(weights.shape[1])], 1)


def telling(index: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Buckets whose count in some class is `TELLING` deviations from that of a bucket that tells nothing."""
    k = len(DOMAINS)
    n = np.stack([np.bincount(index[classes == j], minlength=BUCKETS) for j in range(k)], 1)
    share = n.sum(0) / max(1, n.sum())
    total = n.sum(1, keepdims=True)
    z = (n - total * share) / np.sqrt(total * share * (1 - share) + 1)
    return np.abs(z).max(1) >= TELLING


def fit(features_: list[np.ndarray], y: np.ndarray, steps: int = 200, rate: float = 0.3, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights (BUCKETS, domains), zero but for telling buckets, and bias, by full-batch Adagrad."""
    k = len(DOMAINS)
    w, b = np.zeros((BUCKETS, k)), np.zeros(k)
    if not len(y):
        b[np.arange(k) != DOMAINS.index(ANCHOR)] = -np.inf
        return w, b
    b[np.bincount(y, minlength=k) == 0] = -np.inf
    index = np.concatenate(features_)
    owner = np.repeat(np.arange(len(y)), [len(f) for f in features_])
    chosen = telling(index, y[owner])
    owner, index = owner[chosen[index]], index[chosen[index]]
    goal = np.eye(k)[y]
    seen_w, seen_b = np.full_like(w, 1e-8), np.full(k, 1e-8)
    for _ in range(steps):
        d = (softmax(_sums(index, owner, len(y), w) + b) - goal) / len(y)
        g = np.stack([np.bincount(index, d[owner, j], BUCKETS) for j in range(k)], 1) + ridge * w
        seen_w += g * g
        gb = d.sum(0)
        seen_b += gb * gb
        w -= rate * g / np.sqrt(seen_w)
        b -= rate * gb / np.sqrt(seen_b)
    return w, b


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    known = (
        labels.where("doc_id is not null and (quality is not null or toxic is not null)")
        .groupBy("doc_id")
        .agg(F.coalesce(F.min("quality"), F.lit(1)).alias("_q"), F.coalesce(F.max("toxic"), F.lit(0)).alias("_t"))
        .select("doc_id", F.when(F.col("_q") <= 0, 0).when(F.col("_t") > 0, 1).otherwise(2).alias("_y"))
    )
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "_y")

    def batches(it):
        for batch in it:
            got = [features(t)[1] for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([g.tolist() for g in got], pa.list_(pa.int32()))], names=["i", "y", "x"])

    rows = texts.mapInArrow(batches, "i long, y int, x array<int>").groupBy("i").agg(F.min(F.struct("y", "x")).alias("r")).select("i", "r.y", "r.x").toArrow()
    order = np.argsort(rows.column("i").to_numpy(), kind="stable")
    x = rows.column("x").to_pylist()
    return fit([np.sort(np.array(x[i], np.int32)) for i in order], rows.column("y").to_numpy()[order])


def with_posteriors(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text: str = "text") -> DataFrame:
    """`docs` with _tokens and _p, the posterior over DOMAINS; earlier columns of these names are replaced."""
    docs = docs.drop("_tokens", "_p")
    at = docs.columns.index(text)
    w, b = model[0].astype(np.float32), model[1]
    added = [T.StructField("_tokens", T.LongType()), T.StructField("_p", T.ArrayType(T.DoubleType()))]

    def batches(it):
        for batch in it:
            n, z = [], []
            for t in batch.column(at).cast(pa.binary()).to_pylist():
                words, f = features(t)
                n.append(words)
                z.append(w[f].sum(0, dtype=np.float64) + b)
            p = softmax(np.array(z).reshape(-1, len(DOMAINS))) if z else np.zeros((0, len(DOMAINS)))
            cols = [pa.array(n, pa.int64()), pa.array(p.tolist(), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, *(f.name for f in added)])

    return docs.mapInArrow(batches, T.StructType([*docs.schema.fields, *added]))


def replay(tokens: np.ndarray, p: np.ndarray, steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(r, y) of every row after all steps: r' = max(0, y - tokens * <p, step>) and
    y' = r' + momentum * (r' - r); a step's last entry is its momentum."""
    r, y = np.ones(len(tokens)), np.ones(len(tokens))
    for step in steps:
        new = np.maximum(0.0, y - tokens * (p @ step[:-1]))
        y = new + step[-1] * (new - r)
        r = new
    return r, y


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    tokens = batch.column(batch.schema.get_field_index("_tokens")).to_numpy(zero_copy_only=False).astype(float)
    return tokens, batch.column(batch.schema.get_field_index("_p")).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(DOMAINS))


def _totals(posts: DataFrame, steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Expected domain tokens at r and at y: one row of sums a task comes from Python, one in all here."""

    def batches(it):
        sums = np.zeros(2 * len(DOMAINS))
        for batch in it:
            tokens, p = _columns(batch)
            mass = p * tokens[:, None]
            sums += np.concatenate([v @ mass for v in replay(tokens, p, steps)])
        yield pa.RecordBatch.from_arrays([pa.array([float(x)]) for x in sums], names=names)

    names = [f"s{i}" for i in range(2 * len(DOMAINS))]
    rows = posts.select("_tokens", "_p").mapInArrow(batches, ", ".join(f"{n} double" for n in names))
    got = np.array(rows.agg(*(F.coalesce(F.sum(n), F.lit(0.0)) for n in names)).first())
    return got[: len(DOMAINS)], got[len(DOMAINS) :]


def fit_rates(posts: DataFrame, weights: dict[str, float] | None = None):
    """(steps of the fit, expected totals at r = 1, at the end, targets) for a table with _tokens and _p."""
    weights = weights or WEIGHTS
    k = range(len(DOMAINS))
    mass = [F.col("_tokens") * F.element_at("_p", i + 1) for i in k]
    row = posts.agg(*(F.coalesce(F.sum(m), F.lit(0.0)) for m in mass), *(F.coalesce(F.sum(mass[i] * mass[j]), F.lit(0.0)) for i in k for j in k)).first()
    start, gram = np.array(row[: len(DOMAINS)]), np.array(row[len(DOMAINS) :]).reshape(len(DOMAINS), -1)
    anchor = DOMAINS.index(ANCHOR)
    share = np.array([weights[d] for d in DOMAINS])
    target = np.where(start > 0, share / share[anchor] * start[anchor], 0.0) if start[anchor] > 0 else start
    whiten = np.linalg.pinv(gram, rcond=1e-9, hermitian=True)
    steps: list[np.ndarray] = []
    now, ahead, t = start, start, 1.0

    def met() -> bool:
        return bool(np.all(np.abs(now - target) <= TOLERANCE * target))

    for _ in range(STEPS):
        if met():
            break
        faster = (1 + np.sqrt(1 + 4 * t * t)) / 2
        steps.append(np.append(whiten @ (ahead - target), (t - 1) / faster))
        t = faster
        now, ahead = _totals(posts, steps)
    if not met():
        warnings.warn(f"rates miss their targets after {STEPS} steps: tokens {now.tolist()}, targets {target.tolist()}", RuntimeWarning, stacklevel=2)
    return steps, start, now, target


def with_copies(posts: DataFrame, steps: list[np.ndarray]) -> DataFrame:
    """`posts` with _rate and _copies."""
    schema = T.StructType([*posts.schema.fields, T.StructField("_rate", T.DoubleType())])

    def batches(it):
        for batch in it:
            rate = replay(*_columns(batch), steps)[0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rate)], names=[*batch.schema.names, "_rate"])

    uniform = F.shiftrightunsigned(F.xxhash64(F.lit("copies"), F.col("doc_id"), F.col("_crc")), 11) / F.lit(float(1 << 53))
    return posts.mapInArrow(batches, schema).withColumn("_copies", F.floor(F.col("_rate") + uniform))


def rates(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each row of `docs`: doc_id, _tokens, _p, _rate, _copies."""
    model = train(docs, labels)
    posts = materialize(with_posteriors(docs.select("doc_id", "text"), model).select("doc_id", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("_crc"), "_tokens", "_p"))
    return with_copies(posts, fit_rates(posts)[0])


@shielded
def mix(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs`, each row as often as its rate says, none times included; columns unchanged."""
    posts = with_posteriors(docs, train(docs, labels)).withColumn("_crc", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    stored = materialize(posts)
    out = with_copies(stored, fit_rates(stored)[0]).where("_copies > 0")
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(*docs.columns)


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    out = rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", F.col("_tokens").alias("n_tokens"), *(F.element_at("_p", i + 1).alias(f"p_{d}") for i, d in enumerate(DOMAINS)), F.col("_rate").alias("rate"), F.col("_copies").alias("copies"))
