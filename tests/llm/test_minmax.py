"""Min-max near-duplicates against all pairs of full sets."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import corpus, docs_of, lower, union_find, words_space

from trussline.llm import blocks, minmax, simhash
from trussline.llm.common import materialize, table


def sets_of(texts, size=2):
    out = []
    for t in texts:
        w = words_space(lower(t or ""))
        out.append({" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    return out


def linked(sets):
    """All pairs of similarity 0.8 that are not empty."""
    often, at = defaultdict(int), defaultdict(list)
    for s in sets:
        for x in s:
            often[x] += 1
    for k, s in enumerate(sets):
        for x in sorted(s, key=lambda x: (often[x], x))[: len(s) // 5 + 1]:
            at[x].append(k)
    pairs = {(i, j) for own in at.values() for k, i in enumerate(own) for j in own[:k]}
    return [(i, j) for i, j in pairs if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]


def check(got, ids, texts):
    """Every row as brute force has it; `got` are rows in any order, equal ids with equal answers."""
    sets = sets_of(texts)
    root, least = union_find(range(len(sets)), linked(sets)), {}
    for k, i in enumerate(ids):
        if i is not None:
            least[root[k]] = min(i, least.get(root[k], i))
    want = [(i, len(s), c := least.get(root[k]) if s else i, i == c) for k, (i, s) in enumerate(zip(ids, sets, strict=True))]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_cases(spark):
    texts = corpus(7) + ["Aa bb", "aA BB", "one two three four five six seven eight nine ten eleven", "one two three four five six seven eight nine ten eleven x"]
    rng = random.Random(1)
    ids = rng.sample(range(1000), len(texts))
    ids[0] = ids[40] = None
    ids[5] = ids[6]
    docs = docs_of(spark, texts, ids).withColumns({"_id": F.lit("clash"), "kept": F.lit(1), "n_shingles": F.lit(None).cast("string")})
    check(minmax.near_duplicates(docs).collect(), ids, texts)
    assert minmax.near_duplicates(docs_of(spark, [])).count() == 0


def test_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").collect()
    check(minmax.op11_minmax(spark, "/root/testdata/sf0.01").collect(), [r.doc_id for r in docs], [r.text for r in docs])


def templated(pairs, shared, own, seed):
    """Pairs of texts that share most words with all others, and with their partner all but one word."""
    rng = random.Random(seed)
    base, out = [f"t{k}" for k in range(shared)], []
    for p in range(pairs):
        mine = [f"p{p}w{k}" for k in range(own)]
        other = [*mine[:-1], f"q{p}"]
        cut = rng.randrange(shared)
        out += [" ".join([*base[:cut], *m, *base[cut:]]) for m in (mine, other)]
    return out


@pytest.mark.parametrize("few", [1000, 0])
def test_texts_of_one_template(spark, monkeypatch, few):
    monkeypatch.setattr(blocks, "FEW", few)  # the exact way for blocks of many classes
    texts = templated(150, 80, 20, 3)
    check(minmax.near_duplicates(docs_of(spark, texts)).collect(), list(range(len(texts))), texts)


def test_templated_documents_of_the_pipeline(spark):
    texts = templated(300, 80, 20, 5)
    kept = {r.doc_id for r in simhash.keep_one(docs_of(spark, texts)).collect()}
    assert sum(2 * k in kept and 2 * k + 1 not in kept for k in range(300)) >= 297 and len(kept) <= 303


def test_classes_do_not_depend_on_parts(spark, monkeypatch):
    """One block of chains: every link is found, whether the block is dealt whole or in parts, met directly or under rare tokens."""
    rng = random.Random(2)
    sets = {}
    for c in range(60):
        tokens = [rng.randrange(10**9) for _ in range(40)]
        for _ in range(rng.randrange(1, 5)):
            tokens = tokens[2:] + [rng.randrange(10**9) for _ in range(2)]
            sets[len(sets) * 7919 % 10007] = tokens
    rows = [(i, 40, 0, 0, [1, 2 + i % 3]) for i in sets]
    items = materialize(spark.createDataFrame(rows, "_id long, _len long, _low long, _high long, _keys array<long>"))
    held = materialize(spark.createDataFrame(list(sets.items()), "_id long, _set array<long>"))
    ids = sorted(sets)
    want = union_find(range(len(ids)), [(i, j) for j in range(len(ids)) for i in range(j) if 100 * len(set(sets[ids[i]]) & set(sets[ids[j]])) >= 80 * len(set(sets[ids[i]]) | set(sets[ids[j]]))])
    want = {ids[k]: ids[r] for k, r in want.items() if k != r}
    assert want
    for every, few in ((16, 1000), (1, 4), (16, 4)):
        monkeypatch.setattr(blocks, "FEW", few)
        monkeypatch.setattr(blocks, "EVERY", every)
        monkeypatch.setattr(blocks, "MOST", 10**9 if every == 1 else 2000)
        roots = blocks.classes(items, minmax.close, lambda p: minmax.jaccard_links(p, held), lambda want: minmax.jaccard_prefixes(held.join(want, "_id", "left_semi")), minmax.jaccard_shared())
        assert {r.node: r.root for r in roots.collect()} == want


def test_signatures():
    """Values agree as often as the sets are similar, and the sketch's bits half as often differ."""
    rng, agree, differ = np.random.default_rng(4), [], []
    for _ in range(300):
        h = rng.integers(0, 1 << 63, 110, np.uint64)
        a, b = minmax.signature(h[:100]), minmax.signature(h[10:])
        agree.append((a == b).mean())
        differ.append(sum(int(x).bit_count() for x in minmax.sketch(a) ^ minmax.sketch(b)))
    assert abs(np.mean(agree) - 90 / 110) < 0.01 and abs(np.mean(differ) / 128 - 10 / 110) < 0.01
    assert np.var(agree) < 90 * 20 / 110**2 / 128 * 1.25 and max(differ) <= minmax.FAR
