"""Candidates of the pipeline's near-dedup that SimHash itself proposes."""

from trussline.llm import simhash


def test_pairs_of_close_prints(spark):
    prints = [(1, 10, 0), (2, 10, 3), (3, 10, 0), (4, 10, 0b111 << 20), (5, 0, 0), (6, 10, -1), (7, 10, -1 ^ 5)]
    items = spark.createDataFrame(prints, "_id long, _len long, _fp long")
    got = {(r.x, r.y) for r in simhash.print_pairs(items).collect()}
    assert got == {(1, 2), (1, 3), (6, 7)}
    assert simhash.print_pairs(items.limit(0)).isEmpty()


def test_bands_alone_do_not_decide(spark, monkeypatch):
    """Near copies that share no band are dropped if their SimHashes are close."""
    words = [f"w{k}" for k in range(3000)]
    docs = [(1, " ".join(words)), (2, " ".join([*words[:-1], "other"])), (3, " ".join(reversed(words)))]
    monkeypatch.setattr(simhash, "classes", lambda items, *rest: items.select("_id", "_id").toDF("node", "root").limit(0))
    assert sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect()) == [1, 3]
