import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from notelake.functions.tables import numbered, settled
from notelake.llm import merkle, partitions, resampling
from notelake.llm.text import text_blocks

from .conftest import corpus, docs_of, vectors

QUERIES = "vec_id % 50 = 0"


# places in a global order


def test_places_of_rows_in_groups(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None, "c"]), rng.randrange(20)) for _ in range(500)] + [("a", 7)] * 300
    got = numbered(settled(spark.createDataFrame(rows, "g string, x int")), [F.col("x").asc()], "g", most=0).collect()
    for g in {g for g, _ in rows}:
        own = sorted((r.position, r.x, r.total) for r in got if r.g == g)
        assert [x for _, x, _ in own] == sorted(x for h, x in rows if h == g)
        assert [p for p, _, _ in own] == list(range(len(own))) and {t for _, _, t in own} == {len(own)}
    assert numbered(settled(spark.createDataFrame([], "x int")), [F.col("x").asc()], most=0).count() == 0


# nearest neighbours


def brute_nearest(rows, k=5):
    """By the contract, for all queries, with sums from the first component to the last."""
    dim = Counter(len(v) for i, v in rows if i is not None and v).most_common(1)[0][0]
    usable = {(i, tuple(float(np.float32(x)) for x in v)) for i, v in rows if i is not None and v and len(v) == dim and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, v in usable:
        if i % 50 == 0:
            near = sorted((-dot(v, w) / (math.sqrt(dot(v, v)) * math.sqrt(dot(w, w))), j) for j, w in usable if (j, w) != (i, v))[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(near, 1)]
    return sorted(out)


def test_nearest_of_odd_vectors_is_exact_in_one_part(spark):
    df = vectors(spark, random.Random(4))
    got = sorted(tuple(r) for r in partitions.search(df, F.expr(QUERIES)).collect())
    want = brute_nearest([(r.vec_id, r.embedding) for r in df.collect()])
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=0, atol=1e-12)
    assert [g for g in got if g[0] == 50][:5] == [(50, r, 999 + r, pytest.approx(1.0)) for r in range(1, 6)]


def test_nearest_of_few_or_no_rows(spark):
    one = spark.createDataFrame([(0, [1.0, 0.0]), (7, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in partitions.search(one, F.expr(QUERIES)).collect()] == [(0, 1, 7, 1 / math.sqrt(2))]
    assert partitions.search(one.limit(0), F.expr(QUERIES)).count() == 0
    assert partitions.search(one.withColumn("embedding", F.lit(None).cast("array<double>")), F.expr(QUERIES)).count() == 0
    far = spark.createDataFrame([(0, [1e300, 1e300]), (1, [1e-300, 2e-300]), (2, [5e-324, 0.0])], "vec_id long, embedding array<double>")
    assert [(r.rank, r.vec_id, round(r.score, 9)) for r in partitions.search(far, F.expr(QUERIES)).collect()] == [(1, 1, round(3 / math.sqrt(10), 9)), (2, 2, round(1 / math.sqrt(2), 9))]


def test_recall_and_share_of_clustered_vectors(spark):
    rng = np.random.default_rng(5)
    middle = rng.standard_normal((60, 16)) * 2
    x = (middle[rng.integers(0, 60, 6000)] + rng.standard_normal((6000, 16))).astype(np.float32)
    x[4000:] = np.where(rng.random(2000)[:, None] < 0.9, x[0], x[4000:])  # one vector in three rows of ten
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(6000), "embedding": pa.array(x.tolist(), pa.list_(pa.float32()))}))
    router = partitions.fitted(df, part_rows=128, sample=4096)
    assert router.parts == 32
    got = partitions.search(df, F.expr(QUERIES), router=router).collect()
    u = partitions.unit(x.astype(float))
    hits = share = 0
    home, of = np.bincount(router.home(x.astype(float)), minlength=router.parts), list(range(0, 6000, 50))
    found = {q: [(r.vec_id, r.score) for r in g] for q, g in itertools.groupby(sorted(got), key=lambda r: r.query_id)}
    for q in of:
        s = u @ u[q]
        s[q] = -2
        least = np.sort(s)[-5]
        assert len(found[q]) == 5 and [p for p, _ in found[q]] == [p for p, _ in sorted(found[q], key=lambda p: (-p[1], p[0]))]
        assert np.allclose([s[p] for p, _ in found[q]], [v for _, v in found[q]], atol=1e-12)
        hits += sum(v >= least - 1e-12 for _, v in found[q])
        share += home[router.routes(x[[q]].astype(float))[0]].sum() / 6000
    assert hits >= 0.95 * 5 * len(of) and share < 0.45 * len(of)
    common = np.flatnonzero((x == x[0]).all(axis=1))
    assert [p for p, _ in found[0]] == list(common[1:6])


def test_parts_are_of_equal_size_and_cut_few_edges():
    rng = np.random.default_rng(6)
    x = partitions.unit(np.repeat(rng.standard_normal((8, 12)) * 6, 50, axis=0) + rng.standard_normal((400, 12)))
    near = partitions.neighbours(x, 8)
    label = partitions.balanced(near, 8)
    assert set(np.bincount(label)) == {50}
    assert (label[near] == label[:, None]).mean() > 0.9


# resampling

NAME = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_features(text, n, buckets):
    w = NAME.findall((text or "").translate(LOWER))
    return [zlib.crc32(" ".join(w[i : i + j]).encode()) % buckets for j in range(1, n + 1) for i in range(len(w) - j + 1)]


def brute_resample(docs, target, percent, least, n, buckets):
    s, t = (Counter(b for x in texts for b in brute_features(x, n, buckets)) for texts in ([x for _, x in docs], target))
    ss, tt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets))))
    rows = []
    for i, x in docs:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        f = brute_features(x, n, buckets)
        weight = sum(map(gain, f))
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(NAME.findall((x or "").translate(LOWER))) >= least])
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    return rows, able[: len(able) * percent // 100]


ODD = ["Ünï çödé ÀB Z9 a-b_c", "tab\tnew\nline\x00nul", "w" * 700 + " " + "é" * 300 + " x", "ʼ０１ Ａ", "\x7f\x80 a", "a" * 256 + " " + "b" * 257]


@pytest.mark.parametrize(("n", "buckets"), [(1, 10_000), (1, 7), (3, 10_000)])
def test_resampling_against_brute_force(spark, n, buckets):
    rng = random.Random(n)
    texts = corpus(rng) + ODD
    ids = [*range(len(texts) - 2), None, 3]  # a null id, and two rows of one id
    target = [texts[5], None, "", *ODD[:2]]
    got = resampling.resample(docs_of(spark, texts, ids), docs_of(spark, target), 30, 5, n, buckets).collect()
    rows, drawn = brute_resample(list(zip(ids, texts, strict=True)), target, 30, 5, n, buckets)
    key = lambda r: tuple(-(10**9) if x is None else x for x in r)
    assert sorted(map(key, (r[:4] for r in got))) == sorted(map(key, (r[:4] for r in rows)))
    assert [key(r[:4]) for r in sorted((r for r in got if r.rank), key=lambda r: r.rank)] == [key(r[:4]) for r in drawn]
    assert sorted(r.rank for r in got if r.rank) == list(range(1, len(drawn) + 1))


def test_resampling_without_documents_or_target(spark, empty):
    assert resampling.resample(empty, docs_of(spark, ["a b"])).count() == 0
    got = resampling.resample(docs_of(spark, ["a b a", None]), empty, 100, 1).collect()
    assert sorted((r.doc_id, r.n_features, r.rank) for r in got) == [(0, 3, 1), (1, 0, None)]


def test_checksums_of_all_lengths_at_once():
    texts = pa.array(["".join(random.Random(k).choices("abcxyz09é漢", k=k)) for k in [*range(1, 40), 255, 256, 257, 3000]])
    for t in text_blocks(texts, 500):
        bucket, row, n = resampling.features(t, 1, 1 << 31)
        assert bucket.tolist() == [zlib.crc32(t.bytes_of(i)) % (1 << 31) for i in row] and set(n) == {1}


# manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_tree(leaves, f):
    """Root and each leaf's siblings, by recursion over levels."""
    ways, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        runs = [level[i : i + f] for i in range(0, len(level), f)]
        for i, way in enumerate(ways):
            run, own = divmod(at[i], f)
            way += [x for j, x in enumerate(runs[run]) if j != own]
            at[i] = run
        level = [h(*r) for r in runs]
    return level[0], ways


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute_manifest(rows, f):
    leaf = lambda r, more=0: h(*map(field, (r[0], r[1], r[2], None if r[3] is None else r[3] + more, r[4])))
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: sorted(((r[0] is not None, r[0] or 0, leaf(r)), r) for r in rows if r[2] == x) for x in langs}
    subs = {x: brute_tree([k[2] for k, _ in trees[x]], f) for x in langs}
    root, top = brute_tree([subs[x][0] for x in langs], f)
    out = []
    for x, above in zip(langs, top, strict=True):
        for (k, r), way in zip(trees[x], subs[x][1], strict=True):
            changed = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            out.append((r[0], k[2], subs[x][0], root, h(*way, *above), not changed))
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string, tree string, position int")


def some_rows(n):
    rng = random.Random(n)
    langs = [None, "de", "Ž", "en", "z", "\U0001f600", "￿"]
    rows = [(rng.choice([None, *range(n)]), rng.choice([None, "s", "tüv"]), rng.choice(langs) if rng.random() < 0.5 else "en", rng.choice([None, 5, 2**63 - 1]), rng.choice([None, "", "text", "é" * 50]), "x", 1) for _ in range(n)]
    return rows + rows[: n // 3]  # repeated rows


@pytest.mark.parametrize("n", [1, 2, 3, 8, 200])
def test_checked_manifest_against_recursion(spark, n):
    rows = some_rows(n)
    got = merkle.checked(table(spark, rows)).collect()
    key = lambda r: (r[0] is not None, *map(str, r))
    assert sorted(map(key, ((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.verified) for r in got))) == sorted(map(key, brute_manifest(rows, 2)))
    assert all((r.folded_root == r.root) == r.verified for r in got)


@pytest.mark.parametrize(("fanout", "most"), [(2, 4), (3, 9), (5, 4096), (2, 2)])
def test_blocks_and_fanouts_give_the_same_trees(spark, fanout, most):
    rows = some_rows(150)
    leaves = table(spark, rows).select("doc_id", "lang", merkle.leaf([F.col(c) for c in merkle.COLUMNS]).alias("leaf"))
    got = merkle.folded(merkle.manifest(leaves, ["doc_id"], fanout=fanout, most=most), fanout=fanout).collect()
    want = brute_manifest(rows, fanout)
    key = lambda r: (r[0] is not None, *map(str, r))
    assert sorted(map(key, ((r.doc_id, r.leaf, r.subroot, r.root, hashlib.sha256(bytes(r.proof)).hexdigest()) for r in got))) == sorted(map(key, (w[:5] for w in want)))
    assert all(r.folded_root == r.root for r in got)


def test_manifest_of_nothing(spark):
    assert merkle.checked(table(spark, [])).count() == 0
