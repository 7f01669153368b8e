"""The corpus operators against brute force, on fixtures with nulls, ties, repeats and long texts."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from math import log10

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from trussline.llm import boosting, chat, decontaminate, licenses, lines, mixing, ppm, quality, sharding, simhash, tokens
from trussline.llm.common import components, table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower(text):
    return text.translate(LOW)


def words_space(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def words_alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))


def corpus(seed=1, n=120):
    """Texts with exact and near copies, blanks, odd characters and a long text."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéßX") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    texts = []
    for _ in range(n):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60)))
        texts.append(text.replace(" ", rng.choice([" ", "\n", "  ", ". "]), 3))
    texts += texts[:15] + [t + " zusatz" for t in texts[:15]]
    return [*texts, None, "", "   ", "\n\n", "é", "a", "a b", "<s> </s> <unk>", "x" * 3000, "ab " * 4000, "#*$%&|<> x"]


def docs_of(spark, texts, ids=None):
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, DOCS)


def union_find(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = union_find({x for e in edges for x in e}, edges)
    assert got == {n: r for n, r in want.items() if n != r}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1: sharding
@pytest.mark.parametrize("kind", ["ids", "hot", "null", "few", "none"])
def test_sharding_law(spark, kind):
    ids = {"ids": list(range(5001)), "hot": [5] * 900 + list(range(1700)), "null": [None] * 50 + list(range(60)), "few": [1, 2, 3], "none": []}[kind]
    docs = docs_of(spark, [f"t{i}" for i in range(len(ids))], ids).withColumn("shard", table_null(spark))
    got = sharding.shard_documents(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in got) == sorted((i is None, i or 0, f"t{n}") for n, i in enumerate(ids))
    sizes = Counter(r.shard for r in got)
    counts = [sizes.get(s, 0) for s in range(sharding.SHARDS)]
    assert max(counts) - min(counts) <= 1
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))


def table_null(spark):
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_sharding_moves_little(spark):
    docs = docs_of(spark, [""] * 4000)
    a = {r.doc_id: r.shard for r in sharding.shard_documents(docs, 20).collect()}
    b = {r.doc_id: r.shard for r in sharding.shard_documents(docs, 21).collect()}
    assert sum(a[i] != b[i] for i in a) < 3 * len(a) / 21  # least possible is 1 / 21; a plain modulo moves 95 %


def test_sharding_depends_on_rows_alone(spark):
    docs = docs_of(spark, [f"t{i % 2500}" for i in range(3000)], [i % 500 for i in range(3000)])
    docs = docs.union(docs.where("doc_id = 7").limit(1).crossJoin(spark.range(400)).drop("id"))  # equal rows
    place = lambda d: sorted((r.doc_id, r.text, r.shard, r.slot) for r in sharding.shard_documents(d).collect())
    assert place(docs) == place(docs.repartition(13)) == place(docs.orderBy(docs.text.desc()))


def test_sharding_query(spark, sf):
    got = sharding.op1_sharding(spark, sf).collect()
    want = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    import zlib

    assert len(got) == len(want)
    for r in got:
        raw = (want[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "rows", None)


# 2: token counts
def test_token_counts(spark):
    texts = corpus()
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(tokens.MODEL))
    got = {r.doc_id: r for r in tokens.with_counts(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert got[i]._n_tokens == len(sp.encode(t or ""))
        assert got[i]._n_bytes == len((t or "").encode())
        assert got[i]._over_limit == (got[i]._n_tokens > 4096)


_COUNTER = []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" \n\t▁ab.eé<>s/日\x00A0")), max_size=40))
def test_any_text_counts_as_the_library_does(text):
    if not _COUNTER:
        _COUNTER.append(tokens.WordCounter(public_tokenizers.path(tokens.MODEL)))
    assert _COUNTER[0].counts([text]) == [len(_COUNTER[0].processor.encode(text))]


# 3: chat
def test_perspectives(spark):
    rows = [(1, 0, "system", "be <|kind|>"), (1, 1, "Ann", "hi\\"), (1, 2, "Bob", None), (1, 3, "Ann", "<|user"), (1, None, None, "x"), (2, 0, "system", "alone"), (None, 1, "Ann", "y"), (None, 1, "Ann", "y"), (3, 500, "A", "late"), (3, 2, "B", "early")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = defaultdict(list)
    for r in chat.perspectives(turns).collect():
        got[r.conv_id, r.perspective].append(r)
    assert set(got) == {(1, "Ann"), (1, "Bob"), (1, "unknown"), (None, "Ann"), (3, "A"), (3, "B")}
    for (conv, who), parts in got.items():
        parts.sort(key=lambda r: r.position)
        whole = "".join(r.segment for r in parts)
        assert [r.position for r in parts] == list(range(len(parts)))
        told = [r for r in rows if r[0] == conv]
        assert len(parts) == len(told)
        mine = Counter((r[3] or "") for r in told if (r[2] or "unknown") == who)
        masked = Counter()
        for r in parts:
            assert whole[r.start : r.end] == r.segment
            if r.mask_start is not None:
                assert r.segment.startswith("<|assistant|>\n")
                masked[chat.unescape(whole[r.mask_start : r.mask_end][:-1])] += 1
        assert masked == mine
        assert whole.count("<|assistant|>") == sum(mine.values())
    assert [r.speaker for r in got[3, "A"]] == ["B", "A"]


def test_role_names_do_not_forge_headers(spark):
    names = ["x|>\n<|assistant|>\nfree", "a\nb", "c\\", "|>"]
    turns = spark.createDataFrame([(1, i, n, "said") for i, n in enumerate(names)], "conv_id long, turn long, role string, text string")
    for who in names:
        parts = chat.perspectives(turns).where(chat.F.col("perspective") == who).orderBy("position").collect()
        whole = "".join(r.segment for r in parts)
        assert whole.count("<|assistant|>") == 1 and whole.count("\n") == 2 * len(names)
        assert len({r.segment for r in parts}) == len(names)


# 4: lines
def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_line_classes(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rng.randint(0, 9)) for _ in range(40)) for _ in range(12)]
    texts = ["\n".join(rng.choice(base) if rng.random() < 0.5 else rng.choice(base)[:-1] + rng.choice("xyz") for _ in range(4)) for _ in range(30)]
    texts += [None, "", "\n \n", base[0].upper(), "  " + base[1].replace(" ", "   "), "w " * 40_000, "w v " * 90, " ".join(f"w{i % 97}" for i in range(300)), "one two"]
    docs = docs_of(spark, texts)
    got = {(r.doc_id, r.line_no): r for r in lines.classes(docs).collect()}
    norm = {}
    for i, t in enumerate(texts):
        for k, line in enumerate((t or "").split("\n")):
            n = " ".join(words_alnum(line.lower()))
            if n:
                norm[i, k] = n
    assert set(got) == set(norm)
    distinct = sorted(set(norm.values()))
    names = {r._norm: r._id for r in lines.lines(docs).collect()}
    made = {r._id: r for r in lines.sketches(lines.lines(docs)).collect()}
    assert len(made) == sum(len(n.split()) >= 4 for n in distinct)
    for n in distinct:  # the packed counters are a majority vote of 64-bit hashes
        hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in n.split(" ")]
        if len(hashes) >= 4:
            fp = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
            assert (made[names[n]]._fp & (2**64 - 1), made[names[n]]._len) == (fp, len(hashes))
    check_classes(got, norm, 1.0)
    assert lines.classes(docs_of(spark, [])).count() == 0


def similar_lines(cut):
    """All pairs of word lists with edit similarity 0.8: candidates share one of their rarest words, which 0.8 implies."""
    often, at = Counter(w for c in cut for w in set(c)), defaultdict(list)
    for i, c in enumerate(cut):
        nth = Counter()
        for w in sorted(c, key=lambda w: (often[w], w))[: len(c) * 5 // 4 // 5 + 1]:
            at[w, nth[w]].append(i)
            nth[w] += 1
    pairs = {(i, j) for own in at.values() for k, i in enumerate(own) for j in own[:k] if min(len(cut[i]), len(cut[j])) >= 0.8 * max(len(cut[i]), len(cut[j]))}
    bags = [Counter(c) for c in cut]
    most = {p: max(len(cut[p[0]]), len(cut[p[1]])) // 5 for p in pairs}
    return [p for p in pairs if sum((bags[p[0]] & bags[p[1]]).values()) >= 4 * most[p] and levenshtein(cut[p[0]], cut[p[1]]) <= most[p]]


def check_classes(got, norm, least):
    """Classes join equal lines and hold to edit similarity; of similar lines a share of `least` is joined, whatever their length."""
    distinct = sorted(set(norm.values()))
    cut = [n.split(" ") for n in distinct]
    edges = similar_lines(cut)
    full = union_find(range(len(cut)), edges)
    of, heads = {}, defaultdict(list)
    for key, n in norm.items():
        own = of.setdefault(n, (got[key].class_doc, got[key].class_line))
        assert own == (got[key].class_doc, got[key].class_line)
        heads[own].append(key)
    for head, keys in heads.items():
        assert head == min(keys) and [k for k in keys if got[k].kept] == [head]
        assert len({full[distinct.index(norm[k])] for k in {norm[k]: k for k in keys}.values()}) == 1
    for low, high in ((0, 10), (11, 30), (31, 1 << 30)):
        joined = [of[distinct[i]] == of[distinct[j]] for i, j in edges if low <= max(len(cut[i]), len(cut[j])) <= high]
        assert sum(joined) >= least * len(joined)
    return len(edges)


def norms(texts):
    return {(i, k): " ".join(w) for i, t in texts.items() for k, x in enumerate((t or "").split("\n")) if (w := words_alnum(x.lower()))}


def test_line_links_by_edit_similarity_alone(spark):
    rng = random.Random(8)
    distinct = []
    for n in [4, 5, 6, 7, 8, 9, 10, 12, 13, 15, 16, 20, 24, 25, 40, 80] * 3:
        base = [f"w{rng.randrange(400)}" for _ in range(n)]
        distinct.append(base)
        for edits in range(1, n // 5 + 2):
            line = list(base)
            for _ in range(edits):
                at, kind = rng.randrange(len(line)), rng.randrange(3)
                line[at : at + (kind < 2)] = [f"new{rng.randrange(400)}"] * (kind > 0)
            distinct.append(line)
    distinct = sorted({" ".join(x) for x in distinct if x})
    got = {(r.doc_id, r.line_no): r for r in lines.classes(docs_of(spark, distinct)).collect()}
    assert check_classes(got, norms(dict(enumerate(distinct))), 0.95) > 100


def test_line_recall_on_a_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    got = {(r.doc_id, r.line_no): r for r in lines.classes(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    norm = {k: " ".join(words_alnum(x.lower())) for k, x in ((k, (texts[k[0]]).split("\n")[k[1]]) for k in got)}
    assert check_classes(got, norm, 0.9) > 300


def test_large_group_of_near_copies(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(30)]
    copies = [" ".join([*base[:k], f"x{i}", *base[k + 1 :]]) for i in range(400) if (k := rng.randrange(30)) >= 0]
    docs = docs_of(spark, copies + [" ".join(rng.choices(base, k=30)) for _ in range(50)])
    got = lines.classes(docs).where(f"doc_id < {len(copies)}").select("class_doc").distinct().count()
    assert got == 1


@pytest.mark.parametrize(("shared", "own"), [(7, 3), (14, 6)])
def test_lines_of_one_template(spark, shared, own):
    """Pairs that share most words with all lines, and differ from their partner in one word of their own."""
    rng = random.Random(shared)
    base, texts = [f"t{k}" for k in range(shared)], []
    for p in range(600):
        mine = [f"p{p}w{k}" for k in range(own)]
        cut = rng.randrange(shared)
        texts += [" ".join([*base[:cut], *m, *base[cut:]]) for m in (mine, [*mine[:-1], f"q{p}"])]
    got = {r.doc_id: r.class_doc for r in lines.classes(docs_of(spark, texts)).collect()}
    found = sum(got[2 * p] == got[2 * p + 1] for p in range(600))
    assert found >= 0.95 * 600 and all(c in (i, i - i % 2) for i, c in got.items())


# 5: quality
def test_statistics():
    for t in corpus():
        counts, _ = quality.statistics(None if t is None else t.encode())
        w = words_space(t)
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        seen = Counter(windows)
        hit = {j for i, x in enumerate(windows) if seen[x] > 1 for j in range(i, i + 8)}
        ls = [x for x in (t or "").split("\n") if words_space(x)]
        assert counts == [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(ls) - len(set(ls)), len(hit)]


def test_trees_are_monotone_and_learn():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] < 0.4) ^ (rng.random(3000) < 0.05)).astype(float)
    trees = boosting.fit(x, y, [-1, 1, 0])
    assert ((trees.margin(x) > 0) == (y > 0)).mean() > 0.93
    grid = np.repeat(rng.random((50, 1, 3)), 40, 1)
    for j, sign in ((0, -1), (1, 1)):
        g = grid.copy()
        g[:, :, j] = np.linspace(0, 1, 40)
        m = trees.margin(g.reshape(-1, 3)).reshape(50, 40)
        assert (sign * np.diff(m, axis=1) >= -1e-12).all()


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    half = "crc32(cast(cast(doc_id as string) as binary)) % 2 = "
    out = quality.judge(docs, quality.train(docs, labels.where(half + "0"))).join(labels.where(half + "1"), "doc_id").collect()
    bad, good = [r for r in out if r.quality == 0], [r for r in out if r.quality == 1]
    assert sum(r._kept for r in good if not r._base_failed) > 0.97 * sum(not r._base_failed for r in good)
    assert sum(r._kept for r in bad) < 0.2 * len(bad)


def test_quality_without_labels(spark):
    docs = docs_of(spark, corpus())
    labels = spark.createDataFrame([(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.judge(docs, quality.train(docs, labels)).collect()
    assert all(r._kept != r._base_failed for r in got)
    assert quality.keep_good(docs, labels).columns == docs.columns


# 6: PPM
def brute_ppm(texts, train):
    counts = defaultdict(Counter)
    padded = [b"\xff" * 4 + lower(t or "").encode() + b"\xfe" for t in texts]
    for t, learn in zip(padded, train, strict=True):
        for i in range(4, len(t)) if learn else ():
            for k in range(5):
                counts[t[i - k : i]][t[i]] += 1

    def p(context, s):
        out, gone = 1.0, set()
        for k in range(4, -1, -1):
            seen = {b: n for b, n in counts.get(context[4 - k :], {}).items() if b not in gone}
            if not seen:
                continue
            total = sum(seen.values()) + len(seen)
            if s in seen:
                return out * seen[s] / total
            out *= len(seen) / total
            gone |= set(seen)
        return out / (256 - len(gone))

    return p, [sum(log10(p(t[i - 4 : i], t[i])) for i in range(4, len(t))) for t in padded]


@pytest.mark.parametrize("chunk", [400, 1 << 20])
def test_ppm(spark, chunk):
    texts = [t for t in corpus(2, 40) if t is None or len(t) < 2500]
    import zlib

    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))]
    p, want = brute_ppm(texts, [not h for h in held])
    for context in (b"\xff\xff\xff\xff", b"ab c", b"zzzz"):
        assert abs(sum(p(context, s) for s in range(256)) - 1) < 1e-9
    got = {r.doc_id: r for r in ppm.score(docs_of(spark, texts), chunk=chunk).collect()}
    toks = [[*words_space(lower(t or "")), "\n"] for t in texts]
    c = Counter(w for t, h in zip(toks, held, strict=True) if not h for w in t)
    n, v = sum(c.values()), len(c)
    assert len(got) == len(texts)
    for i in range(len(texts)):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(toks[i]), sum(c[w] > 0 for w in toks[i]), n)
        assert r.base_score == pytest.approx(sum(log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in toks[i]))
        assert r.score == pytest.approx(want[i])


def test_ppm_empty_table_and_sorted_ids(spark, monkeypatch):
    assert ppm.score(docs_of(spark, [])).count() == 0
    texts = [b"abcabc", b"", b"abcd" * 5]
    a = ppm.gram_ids(texts)
    monkeypatch.setattr(ppm, "CELLS", 0)
    for x, y in zip(a, ppm.gram_ids(texts), strict=True):
        assert np.array_equal(x, y)


# 7: licences
def test_licence_phrases_and_templates():
    scan = licenses.LicenseScanner().scan
    rng = random.Random(4)
    vocabulary = ["cc", "by", "general", "public", "license", "all", "rights", "reserved", "x", "the", "gnu", "under"]
    for _ in range(300):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40))).title()
        w = words_alnum(text)
        want = sorted((i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        n, places, _ = scan(text.encode())
        assert n == len(w) and sorted((s, label) for s, _, label in places) == want
    for label, text in licenses.NOTICES:
        n, _, hits = scan(("foo Bar, " + text.upper() + " -- qux").encode())
        assert any(h[0] == label and (h[1], h[2]) == (2, n - 1) and h[3] == pytest.approx(1) for h in hits), label
    words = " ".join(words_alnum(licenses.NOTICES[1][1])).split()
    broken = " ".join(words[:12] + ["oops"] + words[12:])
    assert any(h[0] == "apache-2.0" and h[3] == pytest.approx(1) for h in scan(broken.encode())[2])
    assert scan(b"the license of the software is free")[2] == []
    assert scan(None) == (0, [], [])


def test_licence_templates_inside_longer_ones():
    scan = licenses.LicenseScanner().scan
    hits = scan(b'Licensed under the Apache License, Version 2.0 (the "License"). See NOTICE')[2]
    assert ("apache-2.0", 0, 8, 1.0) in hits
    found = 0
    notices = [(label, " ".join(words_alnum(t))) for label, t in licenses.NOTICES]
    for label, short in notices:
        for _, long in notices:
            at = f" {long} ".find(f" {short} ")
            if at >= 0 and short != long:
                first, n = len(long[:at].split()), len(short.split())
                assert (label, first, first + n, 1.0) in scan(long.encode())[2]
                found += 1
    assert found


def test_licence_stretches_of_each_template(monkeypatch):
    rng = random.Random(6)
    for _ in range(200):
        templates = [[rng.choice("abcd") for _ in range(rng.randint(1, 12))] for _ in range(rng.randint(1, 4))]
        w = [rng.choice("abcdz") for _ in range(rng.randint(0, 25))]
        scanner, got, want = licenses.LicenseScanner([(str(k), " ".join(t)) for k, t in enumerate(templates)], {"a b": "p"}), [], []
        monkeypatch.setattr(scanner, "_chain", got.extend)
        scanner.scan(" ".join(w).encode())
        for k, t in enumerate(templates):
            for e in range(1, len(w) + 1):
                for t1 in range(1, len(t) + 1):
                    n = next((n for n in range(min(e, t1)) if w[e - 1 - n] != t[t1 - 1 - n]), min(e, t1))
                    if n >= licenses.LONG and (e == len(w) or t1 == len(t) or w[e] != t[t1]):
                        want.append((k, e - n, e, t1 - n, t1))
        assert sorted(got) == sorted(want)


def test_licence_chains(monkeypatch):
    rng, found = random.Random(9), 0
    for _ in range(300):
        template = [rng.choice("abcdefg") for _ in range(rng.randint(3, 14))]
        w = list(template)
        for _ in range(rng.randint(0, 4)):
            w.insert(rng.randint(0, len(w)), rng.choice("zzzabc"))
        w = [*rng.choices("abz", k=3), *w, *rng.choices("abz", k=2), *template[: rng.randint(0, 14)]]
        scanner, stretches = licenses.LicenseScanner([("t", " ".join(template))], {"q r": "p"}), []
        text = " ".join(w).encode()
        hits = scanner.scan(text)[2]
        monkeypatch.setattr(scanner, "_chain", stretches.extend)
        scanner.scan(text)
        parts = sorted(x[1:] for x in stretches)

        def best(k):  # of all chains that end with part k: words covered, and where it begins
            start, end, t0, t1 = parts[k]
            out = [(t1 - t0, start)]
            for j in range(k):
                _, last, _, t = parts[j]
                over = max(0, t - t0)
                if last - over <= start <= last + licenses.GAP and t <= t1 and t0 - t <= licenses.GAP + start - last:
                    out.append((best(j)[0] + t1 - t0 - over, best(j)[1]))
            return max(out)

        most = max((best(k)[0] for k in range(len(parts))), default=0)
        assert (round(max((h[3] for h in hits), default=0) * len(template)) == most) == (most >= licenses.COVERED * len(template) or not most)
        assert all(a[2] <= b[1] for a, b in zip(sorted(hits, key=lambda h: h[1]), sorted(hits, key=lambda h: h[1])[1:], strict=False))
        found += bool(hits)
    assert found > 100


def test_licence_of_many_pieces():
    template = " ".join(f"w{i}" for i in range(99))
    text = " ".join(f"w{i} w{i + 1} w{i + 2} oops" for i in range(0, 99, 3))
    hits = licenses.LicenseScanner([("t", template)], {"q r": "p"}).scan(f"x {text} x {text}".encode())[2]
    assert [(h[1], h[2], h[3]) for h in hits] == [(1, 132, 1.0), (134, 265, 1.0)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), min_size=1, max_size=8), min_size=1, max_size=4), st.lists(st.integers(0, 2), max_size=15))
def test_suffix_automaton_matches_stretches(sequences, text):
    a = licenses.SuffixAutomaton(sequences)
    pieces = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    state = size = 0
    for i, w in enumerate(text):
        while state and w not in a.next[state]:
            state = a.link[state]
            size = a.length[state]
        state, size = (a.next[state][w], size + 1) if w in a.next[state] else (0, 0)
        want = max((k for k in range(1, i + 2) if tuple(text[i + 1 - k : i + 1]) in pieces), default=0)
        assert size == want
        for k, end in a.ends[state] if size else ():
            assert sequences[k][end + 1 - size : end + 1] == text[i + 1 - size : i + 1]


def test_licence_query_rows(spark):
    texts = corpus()
    got = {r.doc_id: r for r in licenses.scan(docs_of(spark, [*texts, "All rights reserved. CC-BY cc by"])).collect()}
    last = got[len(texts)]
    assert (last._n_base, last._first_word, last._last_word, last._base_labels, last._score) == (3, 0, 5, "cc-by,reserved", 1.0)
    assert got[0]._labels == "" and got[0]._first_word is None


# 8: decontamination
def brute_windows(items):
    windows = defaultdict(set)
    for i, t in items:
        w = words_alnum(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(str(i))
    return windows


def brute_hits(text, windows):
    w = words_alnum(text)
    hit, found = set(), set()
    for key, own in windows.items():
        for k in range(len(w) - len(key) + 1):
            if tuple(w[k : k + len(key)]) == key:
                hit |= set(range(k, k + len(key)))
                found |= own
    return len(w), sorted(hit), sorted(found)


@given(st.lists(st.lists(st.sampled_from("ab"), max_size=25), max_size=6), st.lists(st.sampled_from("aabc"), max_size=60))
@settings(max_examples=300, deadline=None)
def test_scanner_hits_all_windows(items, text):
    items = [(str(i), " ".join(t)) for i, t in enumerate(items)]
    n, hit, found = decontaminate.Scanner((i, t.encode()) for i, t in items).find(" ".join(text).encode())
    assert (n, [] if hit is None else np.flatnonzero(hit).tolist(), sorted(found)) == brute_hits(" ".join(text), brute_windows(items))


def test_one_pass_over_a_large_benchmark(spark):
    rng = random.Random(2)
    vocabulary = ["w%d" % i for i in range(30_000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=200))) for i in range(3000)]  # 3 MB
    docs = docs_of(spark, [t[:1200] for _, t in items[::300]] + ["clean words only"] * 3)
    found = decontaminate.matches(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    want = [([str(i)], len(brute_hits(t[:1200], brute_windows([(i, t)]))[1])) for i, t in items[::300]]
    assert [(r._items, len(r._hit_words)) for r in found.orderBy("doc_id").collect()] == want + [([], 0)] * 3


def test_benchmark_parts(spark, monkeypatch):
    """Words are counted as the automaton has them; long items are cut without losing a window; no part is above the bound."""
    rng = random.Random(6)
    items = [("ru", " ".join(f"слово{k}" for k in range(501))), ("many", " ".join(f"w{k}" for k in range(330))), *((f"i{k}", " ".join(rng.choices("abcdefgh", k=12))) for k in range(40)), (None, "x y"), ("null", None), ("none", "- -")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    monkeypatch.setattr(decontaminate, "SEGMENT", 100)
    held = [[(r.i, len(r.t.split())) for r in p.collect()] for p in decontaminate.parts(bench, most=300)]
    assert len(held) > 3 and all(sum(n for _, n in part) <= 300 for part in held)
    docs = docs_of(spark, [" ".join(f"слово{k}" for k in range(85, 110)), " ".join(f"w{k}" for k in range(320, 340)), " ".join(f"w{k}" for k in range(322, 340)), "", None])
    whole = sorted(map(repr, decontaminate.matches(docs, bench).collect()))
    out = decontaminate.matches(docs, bench, most=300)
    rows = out.collect()
    assert sorted(map(repr, rows)) == whole
    assert [len(r._hit_words) for r in sorted(rows, key=lambda r: r.doc_id)] == [25, 10, 0, 0, 0]
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1  # the passes before are stored


@pytest.mark.parametrize("most", [decontaminate.MOST_WORDS, 20])
def test_decontamination(spark, most):
    texts = corpus(7)
    items = [(1, texts[3] + " extra words at end"), (2, "a b"), (3, None), (4, "..."), (5, texts[9]), (6, texts[9].upper()), (10, texts[30])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts += [f"before; {texts[3]} after", "A-b? " * 6]
    got = {r.doc_id: r for r in decontaminate.matches(docs_of(spark, texts), bench, most=most).collect()}
    windows = brute_windows(items)
    for i, t in enumerate(texts):
        r, (n, hit, own) = got[i], brute_hits(t, windows)
        assert (r._n_words, r._hit_words, r._items) == (n, hit, own)
        w = words_alnum(t)
        cut = [w for s in r._spans for w in words_alnum(t.encode()[s[0] : s[1]].decode())]
        assert set(cut) == {w[k] for k in hit}
    assert sum(bool(r._hit_words) for r in got.values()) > 4
    kept = decontaminate.drop_contaminated(docs_of(spark, texts), bench)
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r._hit_words}
    none = bench.limit(0)
    assert decontaminate.drop_contaminated(docs_of(spark, texts), none).count() == len(texts)


def test_decontamination_digest(spark, sf):
    r = decontaminate.op8_decontaminate(spark, sf).where("n_items = 0").first()
    assert r.items_sha256 == hashlib.sha256(b"").hexdigest() and not r.contaminated


# 9: SimHash
def brute_fingerprint(text):
    w = words_space(lower(text or ""))
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("hot", [64, 1])
def test_simhash_components(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    long = [f"w{i} v{i % 7}" for i in range(400)]
    texts = corpus(11) + [" ".join(long[:i] + ["new"] + long[i + 1 :]) for i in range(0, 60)]
    docs = docs_of(spark, texts, [1000 - i for i in range(len(texts))])
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    fps = {1000 - i: brute_fingerprint(t) for i, t in enumerate(texts)}
    assert {i: r.fp & (2**64 - 1) for i, r in got.items()} == fps
    ids = sorted(fps)
    root = union_find(ids, [(a, b) for n, a in enumerate(ids) for b in ids[:n] if bin(fps[a] ^ fps[b]).count("1") <= 2])
    assert {i: r.component_id for i, r in got.items()} == root
    assert len(set(root.values())) < len(ids) - 20


def test_simhash_hot_neighbours_without_all_pairs(spark):
    rng = random.Random(1)
    base = rng.getrandbits(64)
    near = {base ^ (1 << rng.randrange(24)) ^ (1 << rng.randrange(24)) ^ (1 << rng.randrange(24)) for _ in range(400)}
    fps = [x - (1 << 64) if x >> 63 else x for x in near]
    got = {r.node: r.root for r in components(simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"))).collect()}
    want = union_find(fps, [(a, b) for n, a in enumerate(fps) for b in fps[:n] if bin((a ^ b) & (2**64 - 1)).count("1") <= 2])
    assert {x: got.get(x, x) for x in fps} == want


def similar_texts(texts):
    """All pairs of texts whose sets of five-word shingles have a Jaccard similarity of 0.8."""
    cut = [words_space(lower(t or "")) for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in cut]
    return [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if cut[i] == cut[j] or min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b)]


def test_keep_one(spark):
    texts = corpus(13)
    rng = random.Random(13)
    for t in corpus(14)[:40]:  # near copies by one word, and by several
        w = t.split(" ")
        for edits in (1, 1, 2, 5):
            for _ in range(edits):
                w[rng.randrange(len(w))] = f"new{rng.randrange(99)}"
            texts.append(" ".join(w * 2))
    edges = similar_texts(texts)
    root = union_find(range(len(texts)), edges)
    assert len(edges) > 50
    docs = docs_of(spark, [*texts, *texts[:5]], [*range(len(texts)), *range(5)]).union(docs_of(spark, [None, "a b c"], [None, None]))
    kept = simhash.keep_one(docs).collect()
    assert [r.text for r in kept if r.doc_id is None] == ["a b c"]
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(set(root.values()))


def test_near_duplicate_recall_on_a_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(texts)
    root = union_find(range(len(ids)), similar_texts([texts[i] for i in ids]))
    got = {r.doc_id for r in simhash.keep_one(docs).collect()}
    want = {ids[r] for r in root.values()}
    assert len(want) < len(ids) and want <= got and len(got) - len(want) <= 0.02 * (len(ids) - len(want))


# 10: mixing
def test_mixing_meets_its_targets(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    posts = mixing.with_posteriors(docs, mixing.train(docs, labels))
    posts = posts.selectExpr("doc_id", "1L as _crc", "_tokens", "_p")
    steps, start, now, target = mixing.fit_rates(posts)
    rows = mixing.with_copies(posts, steps).collect()
    r, p, t = np.array([x._rate for x in rows]), np.array([x._p for x in rows]), np.array([x._tokens for x in rows])
    assert (r >= 0).all()
    assert np.allclose((r * t) @ p, now, rtol=1e-6)
    assert (np.abs(now - target) <= mixing.TOLERANCE * target.sum()).all()
    assert np.abs(start - target).max() > 10 * mixing.TOLERANCE * target.sum()


def test_mixing_raises_scarce_domains_to_the_weights(spark):
    rng = np.random.default_rng(2)
    likely = [[0.7, 0.2, 0.1]] * 2 + [[0.1, 0.8, 0.1]] * 5 + [[0.005, 0.005, 0.99]] * 290
    rows = [(i, 1, int(rng.integers(20, 200)), p) for i, p in enumerate(likely)]
    schema = "doc_id long, _crc long, _tokens long, _p array<double>"
    steps, start, now, _ = mixing.fit_rates(spark.createDataFrame(rows, schema))
    weights = np.array([mixing.WEIGHTS[d] for d in mixing.DOMAINS])
    assert (start[:2] < weights[:2] * start.sum()).all() and steps
    assert (np.abs(now - weights / weights[2] * start[2]) <= mixing.TOLERANCE * now).all()
    assert np.allclose(now / now.sum(), weights, rtol=2 * mixing.TOLERANCE)
    with pytest.warns(RuntimeWarning, match="miss their targets"):
        mixing.fit_rates(spark.createDataFrame([(i, 1, 50, [0.3, 0.3, 0.4]) for i in range(5)], schema))


def test_mixing_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    half = "crc32(cast(cast(doc_id as string) as binary)) % 2 = "
    model = mixing.train(docs, labels.where(half + "0"))
    out = mixing.with_posteriors(docs, model).join(labels.where(half + "1"), "doc_id").collect()
    truth = [0 if r.quality == 0 else 1 if r.toxic else 2 for r in out]
    assert np.mean([int(np.argmax(r._p)) == y for r, y in zip(out, truth, strict=True)]) > 0.9


def test_mixing_odd_rows(spark):
    docs = docs_of(spark, corpus())
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert mixing.mix(docs, labels).count() == docs.count()
    assert mixing.mix(docs.limit(0), labels).count() == 0
    some = spark.createDataFrame([(0, 0, 0), (0, 1, 1), (1, 1, 1), (2, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = mixing.rates(docs, some).collect()
    assert len(got) == docs.count() and all(r._rate >= 0 for r in got)


def test_empty_tables(spark):
    docs = docs_of(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    for out in (
        sharding.shard_documents(docs), tokens.with_counts(docs), chat.perspectives(turns), quality.keep_good(docs, labels), licenses.scan(docs),
        decontaminate.drop_contaminated(docs, bench), simhash.near_duplicates(docs), simhash.keep_one(docs), mixing.mix(docs, labels),
    ):
        assert out.count() == 0


def test_clashing_columns_keep_their_values(spark):
    from pyspark.sql import functions as F

    names = ["_row", "_fp", "_null", "_p", "_tokens", "_crc", "_rate", "_copies", "_copy", "_salt", "_cell", "_shard", "_spans", "_items", "_kept", "_quality", "fp", "kept", "rate", "arc", "n", "cell"]
    docs = docs_of(spark, corpus(17, 60)).where("doc_id < 80").withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in names})
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "no such words at all in any text here ever once")], "item_id long, text string")
    for out in (quality.keep_good(docs, labels), simhash.keep_one(docs), decontaminate.drop_contaminated(docs, bench), mixing.mix(docs, labels), sharding.shard_documents(docs)):
        rows = out.collect()
        assert rows and out.columns[: len(docs.columns)] == docs.columns
        assert all(r[c] == f"{c}{r.doc_id}" for r in rows for c in names)


def test_own_names_are_replaced(spark):
    docs = docs_of(spark, ["a b", None, "", "x y z " * 20])
    bench = spark.createDataFrame([(1, "x y z"), (2, "no such")], "item_id long, text string")
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    model = mixing.train(docs, labels)
    for run in (
        tokens.with_counts, licenses.scan, lambda d: quality.judge(d, None), lambda d: decontaminate.matches(d, bench), lambda d: decontaminate.matches(d, bench, most=1),
        lambda d: mixing.with_posteriors(d, model), simhash.with_fingerprint,
    ):
        once = run(docs)
        twice = run(once)
        assert sorted(twice.columns) == sorted(once.columns)
        assert sorted(map(str, twice.select(sorted(once.columns)).collect())) == sorted(map(str, once.select(sorted(once.columns)).collect()))


def test_every_line_that_links_shares_a_run(spark):
    """Edits at even distances leave no run longer than they must; none of the links is missed."""
    rng = random.Random(11)
    texts = []
    for n in [5, 6, 7, 9, 10, 11, 14, 15, 16, 19, 20, 21, 25, 40, 64, 120] * 6:
        base = [f"e{rng.randrange(10**6)}" for _ in range(n)]
        d, cut = n // 5, list(base)
        for k in range(d):
            at = (k + 1) * n // (d + 1) - (k % 2)
            cut[min(at, n - 1)] = f"f{rng.randrange(10**6)}"
        texts += [" ".join(base), " ".join(cut)]
    got = {r.doc_id: r.class_doc for r in lines.classes(docs_of(spark, texts)).collect()}
    assert [p for p in range(0, len(texts), 2) if got[p] != got[p + 1]] == []


def test_lines_are_filed_without_python(spark):
    """Blocks and sketches are DataFrame functions alone, and linked lines share a block though an edit stands in each fifth word."""
    base = [f"g{k}" for k in range(57)]
    cut = [f"h{k}" if k % 5 == 4 else w for k, w in enumerate(base)]
    found = lines.lines(docs_of(spark, [" ".join(base), " ".join(cut)]))
    filed = lines.filings(found.select("_id", "_norm"))
    assert filed.groupBy("_key").count().where("count > 1").count() > 0 and filed.count() <= 2 * (2 * 11 + 1)
    for made in (filed, lines.sketches(found)):
        assert "Arrow" not in (plan := made._jdf.queryExecution().toString()) and "Python" not in plan


def test_lines_that_share_a_pair_of_words_by_chance_do_not_meet(spark):
    """Linked lines agree in several blocks, whichever words are edited; of small blocks only pairs that do are kept."""
    rng = random.Random(12)
    texts = []
    for n in [4, 5, 6, 7, 8, 9, 10, 14, 15, 19, 20, 24, 25, 40, 64, 120] * 4:
        base = [f"e{rng.randrange(10**6)}" for _ in range(n)]
        cut = list(base)
        if n == 4:
            cut.insert(rng.randrange(5), "f")
        for k in range(n // 5):
            cut[min((k + 1) * n // (n // 5 + 1) - (k % 2), n - 1)] = f"f{rng.randrange(10**6)}"
        texts += [" ".join(base), " ".join(cut)]
    texts += [f"{' '.join(f'c{p}w{k}s{side}' for k in range(20))} shared{p} pair{p}" for p in range(50) for side in range(2)]
    texts += ["w w w w w w", "w w w w w w w", "a b a b a b a b a b", "a b a b a b a b a c"]
    once = lines.lines(docs_of(spark, texts)).select(lines.F.col("doc_id").alias("_id"), "_norm")
    agreed, larger = lines._candidates(lines.materialize(once))
    got = {(r.x, r.y) for r in agreed.collect()}
    assert larger.count() == 0 and got >= {(x, x + 1) for x in [*range(0, 128, 2), 228, 230]}
    assert not any(x in range(128, 228) for x, _ in got)


def test_runs_of_three_words_are_seldom_shared_by_chance(spark):
    """Of two lines with many pairs of words in common, but no run of three, no filing is shared; short lines that link share one wherever the edit stands."""
    rng = random.Random(13)
    texts = []
    for n, m in ((4, 5), (5, 5), (5, 6), (6, 6), (7, 7), (9, 10), (13, 15)):
        for at in range(n):
            for p in range(3):
                base = [f"e{rng.randrange(10**6)}" for _ in range(n)]
                cut = base[:at] + ["f"] * (1 + m - n) + base[at + 1 :] if (n, m) == (13, 15) else base[:at] + ["f"] * (m > n) + base[at:]
                if m == n:
                    cut[at] = f"f{p}"
                texts += [" ".join(base), " ".join(cut)]
    links = len(texts)
    for p in range(20):
        pairs = [f"q{p}w{2 * k} q{p}w{2 * k + 1}" for k in range(10)]
        texts += [" ".join(f"{x} s{p}side{side}k{k}" for k, x in enumerate(pairs)) for side in range(2)]
    once = lines.materialize(lines.lines(docs_of(spark, texts)).select(lines.F.col("doc_id").alias("_id"), "_norm"))
    agreed, larger = lines._candidates(once)
    got = {(r.x, r.y) for r in agreed.collect()}
    assert larger.count() == 0 and got >= {(x, x + 1) for x in range(0, links, 2)}
    filed = lines.filings(once.where(f"_id >= {links}"), lines.AGREE, lines.RUN)
    assert filed.groupBy("_key").count().where("count > 1").count() == 0
