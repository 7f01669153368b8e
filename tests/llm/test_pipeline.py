"""The pipeline's stages against their operators' brute-force rules."""

from collections import Counter

import corpus_pipeline
from test_operators import similar_texts, union_find, words_alnum

from trussline.llm import quality, sharding
from trussline.llm.common import materialize, table


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns, before, seen = docs.columns, None, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf))
        seen[name] = (before.collect(), docs.collect())
        if name != "sharding":
            assert docs.columns == columns
            assert {tuple(r) for r in seen[name][1]} <= {tuple(r) for r in seen[name][0]}
    raw, good = seen["quality rules"]
    assert 0 < len(good) < len(raw)
    assert not any(quality.base_failed(c[0], c[4]) for c in (quality.statistics(r.text.encode())[0] for r in good))

    raw, one = seen["SimHash near-dedup"]
    texts = {r.doc_id: r.text for r in raw}
    ids = sorted(texts)
    root = union_find(range(len(ids)), similar_texts([texts[i] for i in ids]))
    assert sorted(r.doc_id for r in one) == sorted(ids[k] for k in set(root.values()))

    raw, clean = seen["benchmark decontamination"]
    windows = set()
    for r in table(spark, sf, "benchmark").collect():
        w = words_alnum(r.text)
        windows |= {" ".join(w[i : i + 10]) for i in range(max(1, len(w) - 9))}
    dirty = {r.doc_id for r in raw if any(f" {x} " in f" {' '.join(words_alnum(r.text))} " for x in windows)}
    assert {r.doc_id for r in clean} == {r.doc_id for r in raw} - dirty

    raw, out = seen["sharding"]
    assert len(raw) == len(out)
    sizes = Counter(r.shard for r in out)
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(sharding.SHARDS)) <= 1
