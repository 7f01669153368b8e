"""The audit of filter orders against counting documents one by one."""

import random
from itertools import permutations

from pyspark.sql import functions as F
from test_operators import docs_of, words_space

from trussline.llm import audit

LABELS = "doc_id long, quality int, toxic int"


def fails(rows, k):
    i, t, _ = rows[k]
    words, t = words_space(t), t or ""
    return {
        "A": len(words) < 200,
        "B": 100 * len(set(words)) < 50 * len(words),
        "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
        "D": any(c in "#$%&*|" for c in t),
        "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows),
    }


def brute(rows, labels):
    verdicts, out = [fails(rows, k) for k in range(len(rows))], {}
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    for part in {p or "" for *_, p in rows}:
        mine, removed = [k for k, r in enumerate(rows) if (r[2] or "") == part], dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = set(mine)
            for step, c in enumerate(order, 1):
                lost = {k for k in left if verdicts[k][c]}
                left -= lost
                removed[c] += len(lost)
                own = [k for k in mine if verdicts[k][c]]
                out[part, order, step] = [len(left), len(lost), len(own) - len(lost), sum(sum(verdicts[k].values()) == 1 for k in own), sum(rows[k][0] in good for k in lost), sum(rows[k][0] in toxic for k in lost)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removed[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_audit(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(60):
        t = " ".join(rng.choice(words[: rng.choice([40, 400])]) for _ in range(rng.choice([20, 199, 200, 230])))
        texts.append(t.upper() if rng.random() < 0.3 else t + rng.choice(["", " #", "|", "\t\x0b"]))
    texts += texts[:20] + texts[:5] + [None, "", " ", None, "é" * 500, "A" + "é" * 32, "A" + "é" * 33, "word " * 20_000]
    ids = [rng.randint(0, 70) for _ in texts]  # repeated doc_ids, in several parts
    ids[3] = ids[70] = None
    parts = [rng.choice(["en", "de", "", None]) for _ in texts]
    rows = list(zip(ids, texts, parts, strict=True))
    rows += rows[:4]
    labels = [(rng.randint(0, 90), rng.choice([0, 1, None]), rng.choice([0, 0, 1])) for _ in range(80)] + [(None, 1, 1)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, mask string")
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in audit.audit(docs, spark.createDataFrame(labels, LABELS)).collect()}
    assert got == brute(rows, labels)


def test_empty_tables(spark):
    docs, labels = docs_of(spark, []), spark.createDataFrame([], LABELS)
    assert audit.audit(docs, labels).count() == 0
    only = audit.audit(docs_of(spark, [None]).withColumn("lang", F.lit(None).cast("string")), labels).collect()
    assert len(only) == 600 and {r.part for r in only} == {""}
    assert {(r.kept, r.removed) for r in only if r.filter_order == "ABCDE"} == {(0, 1), (0, 0)}
