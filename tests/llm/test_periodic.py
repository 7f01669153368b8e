"""Periodic runs against brute force over all stretches and periods."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_operators import docs_of, words_space

from trussline.llm import periodic


def brute(word, least=6, exponent=4):
    """Every stretch that keeps a period and no neighbour extends; the smallest period of equal stretches."""
    n, found = len(word), {}
    for p in range(1, n // exponent + 1):
        start = 0
        while start + p < n:
            end = start
            while end + p < n and word[end] == word[end + p]:
                end += 1
            if end > start and end + p - start >= max(least, exponent * p):
                found.setdefault((start, end + p - start), p)
            start = max(end, start + 1)
    return sorted((s, length, p) for (s, length), p in found.items())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=70), st.sampled_from([(6, 4), (2, 2), (6, 3)]))
def test_runs(word, bounds):
    assert [tuple(r) for r in periodic.runs(np.array(word, np.int64), *bounds).tolist()] == brute(word, *bounds)


def test_runs_of_repeated_words():
    rng = random.Random(5)
    for _ in range(200):
        word = []
        while len(word) < 150:
            word += [rng.randint(0, 4) for _ in range(rng.randint(1, 6))] * rng.randint(1, 9)
        assert [tuple(r) for r in periodic.runs(np.array(word, np.int64)).tolist()] == brute(word)


def test_range_minima():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 64, 100):
        v, low = rng.integers(0, 50, n), rng.integers(0, n, 40)
        high = np.array([rng.integers(a, n) for a in low])
        assert periodic.range_minima(v, low, high).tolist() == [v[a : b + 1].min() for a, b in zip(low, high)]


def rewritten(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


def test_query_rows(spark, tmp_path):
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 40))) for _ in range(150)]
    texts += [None, "", " \t\x0b\n", "é " * 9, "x x " * 5, "ab " * 30_000, "\n".join(["eins zwei drei"] * 6), "same", "same"]
    ids = [*range(len(texts) - 2), 3, None]
    planted = [i for i in range(400, 900) if zlib.crc32(str(i).encode()) % 10 == 0][:9]
    texts, ids = texts + [None, "", " ", *texts[:6]], ids + planted
    docs_of(spark, texts, ids).withColumns({"_runs": F.lit(1), "start": F.lit("clash")}).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in periodic.op13_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    want = []
    for i, t in zip(ids, texts, strict=True):
        words = rewritten(i, words_space(t))
        found = [(0, len(words), 1)] if len(words) >= 6 and len(set(words)) == 1 else brute(words) if len(words) < 1000 else None
        best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        gone = {k for s, length, p in found for k in range(s + p, s + length)}
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{a},{b},{c}\n" for a, b, c in found), kept)]
        want.append((i, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *digest))
    assert got == sorted(want, key=repr)


def test_columns_and_empty_tables(spark):
    docs = docs_of(spark, ["a b " * 5]).withColumns({"_collapsed": F.lit(7), "more": F.lit(None).cast("string")})
    row = periodic.with_runs(docs).first()
    assert (row._n_words, [tuple(r) for r in row._runs], row._collapsed, row.more) == (10, [(0, 10, 2)], "a b", None)
    assert periodic.with_runs(docs_of(spark, [])).count() == 0
