"""Hierarchies over space against plain sums over all prefixes, whole and in tasks of a few rows."""

import random

import pytest

from trussline.operators import partition


@pytest.mark.parametrize("distinct", [False, True])
@pytest.mark.parametrize("task", [40, 500_000])
def test_subtrees_in_parts(spark, distinct, task):
    draw = random.Random(5)
    spots = [draw.getrandbits(60) for _ in range(150)] + [draw.getrandbits(40) for _ in range(150)] + [7] * 100
    data = [("a" if k % 3 else None, spots[k], draw.getrandbits(60) if k % 5 else 9, draw.choice([0, 1, 2, 3, 4, None])) for k in range(400)]
    items = spark.createDataFrame(data, "g string, _code long, _tail long, v long")
    got = {(r.g, r._code, r._tail): (r.level, r.node["head"], r.node["tail"]) for r in partition.subtrees(items, ["g"], "v", 4, distinct, task).collect()}

    held = {}
    node = lambda g, c, t, n: (g, n, c >> max(60 - n, 0), t >> (60 - max(n - 60, 0)))
    for g, c, t, v in data:
        for n in range(121):
            held.setdefault(node(g, c, t, n), []).append(v)
    told = [{*vs} if distinct else [v for v in vs if v is not None] for vs in held.values()]
    small = {k for k, vs in zip(held, told, strict=True) if (len(vs) if distinct else sum(vs)) <= 4 and vs}
    want = {(g, c, t): next(node(g, c, t, n)[1:] for n in range(121) if n == 120 or node(g, c, t, n) in small) for g, c, t, _ in data}
    assert got == want
