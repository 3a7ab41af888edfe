import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from notelake.llm import bagminhash, exchange, repeats, suffix_dedup
from notelake.llm.graph import components

from .conftest import corpus, docs_of, text

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_windows(rows, n):
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < i:
                gone[k : k + n] = [True] * n
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out)


@pytest.mark.parametrize("n", [1, 5, 13, 30])
def test_word_windows_against_brute_force(spark, n):
    rng = random.Random(n)
    texts = corpus(rng)
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    ids[3] = ids[4]  # two rows of one document
    got = repeats.cut_repeats(docs_of(spark, texts, ids), n=n, chunk_bytes=2000).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.text) for r in got) == brute_windows(list(zip(ids, texts)), n)
    assert all(sum(x.length for x in r.removed) == r.n_removed for r in got)


def test_word_windows_of_nothing(spark, empty):
    assert repeats.cut_repeats(empty).count() == 0
    r = repeats.cut_repeats(docs_of(spark, ["a " * 20, "a " * 20], [None, 5])).collect()
    assert sorted((x.doc_id or 0, x.n_removed) for x in r) == [(0, 0), (5, 20)]


def test_null_ids_beside_ids_beyond_doubles(spark):
    t = " ".join(f"w{k}" for k in range(30))
    got = repeats.cut_repeats(docs_of(spark, [t, t, "other"], [2**60, 2**60 + 1, None])).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (2**60, 0), (2**60 + 1, 30)]
    ids = [-(2**63), 2**63 - 1, -(2**63) + 1, None, 0]
    got = repeats.cut_repeats(docs_of(spark, [t] * 5, ids), chunk_bytes=100).collect()
    assert {r.doc_id: r.n_removed for r in got} == {-(2**63): 30, 2**63 - 1: 30, -(2**63) + 1: 30, None: 0, 0: 30}


FAR = {
    "outlier": [*range(2000), 2**62],
    "two clusters": [*range(1000), *range(2**61, 2**61 + 1000)],
    "close and large": [2**60 + k for k in range(2000)],
    "hashes": [int.from_bytes(hashlib.blake2b(str(k).encode(), digest_size=8).digest(), "little", signed=True) for k in range(2000)],
    "both ends": [-(2**63), 2**63 - 1, *range(-1000, 1000)],
    "powers": [s * 2**k + j for k in range(62) for s in (1, -1) for j in range(20)],
    "one id": [*range(1000), *[500] * 1000],
    "no id": [*range(1000), *[None] * 1000],
    "few": [3, 4, 5],
}


@pytest.mark.parametrize("kind", FAR)
def test_ranges_of_any_ids(spark, kind):
    ids = FAR[kind]
    df = spark.createDataFrame([(i, str(k)) for k, i in enumerate(ids)], "doc_id long, text string")
    of = exchange.by_range(df, 16)
    got = [(r.doc_id, r.c) for r in df.select("doc_id", of.chunk(F.col("doc_id"), F.xxhash64("text")).alias("c")).collect()]
    chunks = [(c, i) for i, c in got]
    sizes = Counter(c for c, _ in chunks)
    assert max(sizes.values()) <= 2 * max(len(ids) / 16, 1)
    key = lambda i: -(2**64) if i is None else i
    place = {c: int(of.place(np.array([c]))[0]) for c, _ in chunks}
    order = sorted((key(i), place[c]) for c, i in chunks)
    assert [p for _, p in order] == sorted(p for _, p in order)  # chunks follow the ids
    assert all(len({place[c] for c, i in chunks if i == x}) == 1 for x in set(ids) if sum(i == x for _, i in chunks) > 1)


@pytest.mark.parametrize("kind", ["outlier", "close and large", "one id", "no id"])
def test_word_windows_with_any_ids(spark, kind):
    rng = random.Random(8)
    ids = rng.sample(FAR[kind], 120)
    texts = [text(rng, rng.randint(1, 60)) for _ in ids]
    for k in range(0, 120, 3):
        texts[k] = texts[(k * 7 + 1) % 120]
    got = repeats.cut_repeats(docs_of(spark, texts, ids), chunk_bytes=1500).collect()
    rows = list(zip(ids, texts, strict=True))
    want = brute_windows([(-1 if i is None else i, t) for i, t in rows], 13)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.text) for r in got) == want


def brute_bytes(rows, n):
    count = Counter(b[k : k + n] for _, b in rows for k in range(len(b) - n + 1))
    out = []
    for i, b in rows:
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if count[b[k : k + n]] > 1:
                gone[k : k + n] = b"\1" * n
        spans = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("n", "most"), [(400, 64), (120, 64), (120, 1), (90, 2)])
def test_byte_strings_against_brute_force(spark, n, most):
    rng = random.Random(n)
    texts = [*corpus(rng, 50), "periodic! " * 300, "solo " + "z" * 1200, "q" * (n - 1), "q" * (n - 1)]
    rng2 = random.Random(9)
    passage = text(rng2, 60)
    texts += [text(rng2, 30) + passage + text(rng2, 30) for _ in range(80 if most == 64 else 12)]
    got = suffix_dedup.cut_repeats(docs_of(spark, texts), length=n, chunk_bytes=3000, max_contents=most).collect()
    found = sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got)
    assert found == brute_bytes([(i, (t or "").encode()) for i, t in enumerate(texts)], n)


def test_byte_strings_of_nothing(spark, empty):
    assert suffix_dedup.cut_repeats(empty).count() == 0
    got = suffix_dedup.cut_repeats(docs_of(spark, [None, "", "short"])).collect()
    assert [(r.n_removed, bytes(r.kept)) for r in sorted(got, key=lambda r: r.doc_id)] == [(0, b""), (0, b""), (0, b"short")]


def bags(texts, n=5):
    out = []
    for t in texts:
        w = WORD.findall(t or "")
        out.append(Counter(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else Counter())
    return out


def brute_classes(ids, texts, least=0.8):
    b = bags(texts)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(ids)):
        for y in range(x):
            both, all_ = sum((b[x] & b[y]).values()), sum((b[x] | b[y]).values())
            if (all_ and both / all_ >= least) or ids[x] == ids[y]:
                p, q = find(ids[x]), find(ids[y])
                root[max(p, q)] = min(p, q)
    return sorted((i, find(i)) for i in ids)


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(4)
    texts = corpus(rng)
    whole = text(rng, 200).split()
    for _ in range(12):  # copies of copies, and of one document
        w = list(whole)
        w[rng.randrange(200)] = "new"
        texts.append(" ".join(w))
        whole = w if rng.random() < 0.5 else whole
    ids = list(range(100, 100 + len(texts)))
    rng.shuffle(ids)
    ids[7] = ids[8]
    got = bagminhash.near_duplicates(docs_of(spark, texts, ids)).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == brute_classes(ids, texts)
    size = defaultdict(set)
    for r in got:
        size[r.class_id].add(r.doc_id)
    assert all(r.class_size == len(size[r.class_id]) for r in got)


def test_near_duplicates_of_nothing(spark, empty):
    assert bagminhash.near_duplicates(empty).count() == 0
    got = bagminhash.near_duplicates(docs_of(spark, ["", None, "a b c d e f", "a b c d e f", "a b c d e f"], [1, 2, 3, 4, None])).collect()
    assert sorted(((r.doc_id or 0, r.class_id) for r in got), key=str) == [(0, None), (1, 1), (2, 2), (3, 3), (4, 3)]


def edited(rng, whole, n, most):
    out = []
    for _ in range(n):
        w = list(whole)
        for _ in range(rng.randint(1, most)):
            w[rng.randrange(len(w))] = f"n{rng.random()}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block", [4, 30, 256])
def test_strays_find_links_that_stars_miss(spark, monkeypatch, block):
    monkeypatch.setattr(bagminhash, "BLOCK_DOCS", block)  # used where the plan is built only
    monkeypatch.setattr(bagminhash, "PIVOTS", 3)
    rng = random.Random(8)
    texts = edited(rng, text(rng, 300).split(), 60, 9) + edited(rng, text(rng, 120).split(), 40, 8)
    got = bagminhash.near_duplicates(docs_of(spark, texts)).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == brute_classes(list(range(100)), texts)


def shuffled_bytes(spark, f):
    """f() and the bytes that its tasks wrote for shuffles."""
    spark.sparkContext.setJobGroup(group := f"g{random.random()}", "")
    f()
    spark.sparkContext.setJobGroup("none", "")
    tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    return sum(int(store.lastStageAttempt(s).shuffleWriteBytes()) for s in stages)


def test_bytes_follow_the_documents_of_a_cluster(spark):
    rng = random.Random(5)
    whole = text(rng, 150).split()
    small, large = edited(rng, whole, 1200, 5), edited(rng, whole, 4800, 5)
    sent = []
    for texts in (small, large):
        docs = docs_of(spark, texts).select("doc_id", "text").cache()
        sent.append(shuffled_bytes(spark, lambda docs=docs: bagminhash.near_duplicates(docs).collect()))
    assert sent[1] < 5 * sent[0], sent


@pytest.mark.parametrize("local_edges", [10**6, 40, 0])
def test_components_against_union_find(spark, local_edges):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(150)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(260)] + [(5, 5), (None, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    df = spark.createDataFrame(edges, "a long, b long")
    assert sorted((r.id, r.class_id) for r in components(df, local_edges).collect()) == sorted((x, find(x)) for x in list(root))
    assert components(df.filter("a < 0"), local_edges).count() == 0


def test_signatures_estimate_weighted_jaccard():
    import numpy as np

    rng = np.random.default_rng(3)
    h = rng.integers(0, 2**62, 60).astype(np.uint64)
    a, b = rng.integers(0, 9, 60), rng.integers(0, 9, 60)
    some = np.concatenate([np.flatnonzero(a), np.flatnonzero(b)])
    doc = np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()])
    s = bagminhash.signatures(h[some], doc, np.concatenate([a[a > 0], b[b > 0]]), 2, 4096)
    assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03


def test_doubling_until_no_candidates_survive(spark, empty):
    rng = random.Random(21)
    shared = text(rng, 130).split()
    texts = [text(rng, 40) + " " + " ".join(shared[:k]) + " " + text(rng, 15) for k in (130, 130, 60, 12)] + [text(rng, 80), None, "", "x " * 200]
    got = {r.doc_id: r.words for r in repeats.longest_repeats(docs_of(spark, texts), 13, chunk_bytes=1000).collect()}
    assert got == {0: 104, 1: 104, 2: 52, 3: 0, 4: 0, 5: 0, 6: 0, 7: 0}
    assert repeats.longest_repeats(empty).count() == 0
