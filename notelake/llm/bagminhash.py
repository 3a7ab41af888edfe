"""Near-duplicate documents by BagMinHash and verified multiset overlap.

A document is the multiset of its five-word shingles.  The weight axis of a shingle is
cut into dyadic intervals (0,1], (1,2], (2,4], ...; each interval of each shingle has
its own Poisson process of points (time, place on the axis, register), the same in
every document.  A document sees the points that lie below its count, and a register
keeps the earliest point it sees.  Two registers agree with a probability equal to the
weighted Jaccard similarity.  Points come in order of time, so a process stops as soon
as it is later than the document's latest register.

Registers are banded.  Candidates are a bucket's documents against its smallest one;
they are verified on the full multisets.  Where verified links leave a cluster of
candidates in several parts, its strays (what is outside the largest part) are compared
with documents of the whole cluster until few are left, and these with all of it, in
blocks, by inverted lists.  So there is no cap on partners, no group is expanded into
pairs, and work grows with the strays that stay apart, not with the cluster's square.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.llm.exchange import bounded, settled
from notelake.llm.graph import components
from notelake.llm.text import mix, text_blocks, window_hash, window_ok, word_hash, words

U64 = np.uint64
SHINGLE = 5
SIMILARITY = 0.8
#: Bands and registers of each: a pair at similarity 0.8 is missed with a probability of 4e-7.
BANDS, ROWS = 28, 4
#: Ids (8 bytes) that are broadcast at most; longer lists are joined by shuffle.
MAX_BROADCAST = 1_000_000
#: Documents of one block of a comparison.
BLOCK_DOCS = 256
#: Documents of a large cluster, about, that its strays are compared with in a round.
PIVOTS = 32
#: Logarithm of the sizes' ratio in one class of them.
SIZE_CLASS = 0.05


def shingles(h: np.ndarray, doc: np.ndarray, n_docs: int, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of each shingle; a document of fewer words has one of all its words."""
    at = np.flatnonzero(window_ok(doc, n))
    hs, ds = [window_hash(h, n)[at]], [doc[at]]
    size = np.bincount(doc, minlength=n_docs)
    first = np.concatenate([[0], np.cumsum(size)])[:-1]
    for k in range(1, n):
        few = np.flatnonzero(size == k)
        if len(few):
            hs.append(window_hash(h, k)[first[few]])
            ds.append(few)
    return np.concatenate(hs), np.concatenate(ds)


def _counted(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each document's distinct shingles and how often it has them."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])) if len(h) else np.zeros(0, int)
    return h[new], doc[new], np.diff(np.append(new, len(h)))


def signatures(h: np.ndarray, doc: np.ndarray, count: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """The point that each of m registers keeps, for each document (0: no shingles)."""
    parts = [(h, doc, count, np.zeros(len(h), np.int64), np.ones(len(h), np.int64))]
    lo = 1
    while True:  # the interval (lo, 2 lo], for those who reach into it
        some = np.flatnonzero(count > lo)
        if not len(some):
            break
        parts.append((h[some], doc[some], count[some], np.full(len(some), lo), np.full(len(some), lo)))
        lo *= 2
    h, doc, count, low, length = (np.concatenate(x) for x in zip(*parts, strict=True))
    with np.errstate(over="ignore"):
        seed = mix(h ^ mix(low.astype(U64) + U64(0x5851F42D4C957F2D)))
    times = np.full(n_docs * m, np.inf)
    points = np.zeros(n_docs * m, U64)
    t = np.zeros(len(h))
    step = 0
    while len(seed):
        step += 1
        with np.errstate(over="ignore"):
            z = mix(seed + U64(step) * U64(0x9E3779B97F4A7C15))
            y = mix(z ^ U64(0xA0761D6478BD642F))
        t = t - np.log(((z >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53) / length
        register = ((y >> U64(32)) * U64(m) >> U64(32)).astype(np.int64)
        place = low + 1 + (((y & U64(0xFFFFFFFF)) * length.astype(U64)) >> U64(32)).astype(np.int64)
        at = doc * m + register
        seen = np.flatnonzero((place <= count) & (t < times[at]))
        np.minimum.at(times, at[seen], t[seen])
        won = seen[t[seen] == times[at[seen]]]
        points[at[won]] = z[won]
        latest = times.reshape(n_docs, m).max(1)
        live = np.flatnonzero(t < latest[doc])
        seed, doc, count, low, length, t = (x[live] for x in (seed, doc, count, low, length, t))
    return points.reshape(n_docs, m)


def sketch(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, key (128 bits of the words) and band hashes of each row; no words: null key and no bands."""
    m = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list = []
            flat, sizes = [], []
            for t in text_blocks(batch.column("text")):
                start, end, doc = words(t)
                h = word_hash(t.data, start, end)
                cut = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(t)))])
                keys += [hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(cut, cut[1:], strict=False)]
                points = signatures(*_counted(*shingles(h, doc, len(t), shingle)), len(t), m).reshape(len(t), bands, rows)
                with np.errstate(over="ignore"):
                    band = np.arange(1, bands + 1, dtype=U64)[None, :] * U64(0xD6E8FEB86659FD93)
                    for j in range(rows):
                        band = mix(band * U64(0x9E3779B97F4A7C15) + points[:, :, j])
                some = np.diff(cut) > 0
                flat.append(band[some].ravel().view(np.int64))
                sizes.append(np.where(some, bands, 0))
            ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1, int)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys, pa.binary()), lists], names=["doc_id", "key", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, key binary, bands array<bigint>")


def _elements(column: pa.ChunkedArray | pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Elements (a shingle and the number of its occurrence, hashed) of all texts, and where each text's begin."""
    es, ds, first = [], [], 0
    for t in text_blocks(column):
        start, end, doc = words(t)
        h, d, n = _counted(*shingles(word_hash(t.data, start, end), doc, len(t), shingle))
        number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        es.append(mix(np.repeat(h, n) ^ mix(number.astype(U64) + U64(7))))
        ds.append(np.repeat(d, n) + t.first)
        first = t.first + len(t)
    e, d = (np.concatenate(x) if x else np.zeros(0, int) for x in (es, ds))
    return e, np.searchsorted(d, np.arange(first + 1))


def _similarities(a: pa.ChunkedArray | pa.Array, b: pa.ChunkedArray | pa.Array, shingle: int) -> np.ndarray:
    """Weighted Jaccard similarity of each pair of texts."""
    (x, at), (y, bt) = _elements(a, shingle), _elements(b, shingle)
    out = np.zeros(len(a))
    for i in range(len(a)):
        p, q = x[at[i] : at[i + 1]], y[bt[i] : bt[i + 1]]
        both = len(np.intersect1d(p, q, assume_unique=True))
        out[i] = both / (len(p) + len(q) - both) if both else 0.0
    return out


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The different texts of each id (one but for repeated ids); the ids are broadcast where there are few, so that other texts don't move."""
    few = ids.count() <= MAX_BROADCAST
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").groupBy("doc_id", F.md5("text")).agg(F.min("text").alias("text")).select("doc_id", "text")


def _links(docs: DataFrame, candidates: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Candidates (a, b) whose multisets are similar enough, with their similarity."""
    texts = _texts_of(docs, candidates.select(F.col("a").alias("doc_id")).union(candidates.select("b")).distinct())

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = _similarities(batch.column("text_a"), batch.column("text_b"), shingle)
            whole = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(s)], names=["a", "b", "similarity"])
            yield whole.filter(pa.array(s >= similarity))

    pairs = candidates.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(verify, "a bigint, b bigint, similarity double")


def _with_small(rows: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with a settled table of fixed-width rows, which is broadcast where it is short."""
    return rows.join(F.broadcast(small) if small.count() <= MAX_BROADCAST else small, on, how)


def _open(clusters: DataFrame, links: DataFrame, least: int) -> DataFrame:
    """Documents of the clusters of ``least`` or more that ``links`` leave in several parts.

    The columns of ``clusters`` (id, cluster and others), part, size (rows of the cluster), top (its
    largest part), strays (rows outside of it).
    """
    parts = components(links).withColumnRenamed("class_id", "part")
    member = settled(clusters.join(parts, "id", "left").withColumn("part", F.coalesce("part", "id")))
    each = member.groupBy("cluster", "part").agg(F.count("id").alias("n"))
    tops = each.groupBy("cluster").agg(F.max(F.struct("n", "part")).alias("t"), F.sum("n").alias("size"), F.count("part").alias("parts"))
    tops = settled(tops.filter((F.col("parts") > 1) & (F.col("size") >= least)).select("cluster", "size", F.col("t.part").alias("top"), (F.col("size") - F.col("t.n")).alias("strays")))
    return settled(_with_small(member, tops, ["cluster"]))


def _reach(texts: DataFrame, open_: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """key, n (elements) and reach of each text: the most elements that a text may have to be similar enough to it.

    Of its elements a text shares at most those that another text of the cluster has, so a
    text with elements of its own reaches less far.  Blocks of a cluster's texts send each
    element once, so what is sent are the elements of few texts.
    """

    def run(table: pa.Table) -> pa.Table:
        e, cut = _elements(table.column("text"), shingle)
        size = np.diff(cut)
        doc = np.repeat(np.arange(len(size)), size)
        with np.errstate(over="ignore"):
            e = mix(e ^ mix(table.column("cluster").to_numpy().view(U64))[doc])
        e, first, n = np.unique(e, return_index=True, return_counts=True)
        keys = table.column("key").to_numpy()
        return pa.table({"e": pa.concat_arrays([pa.array(e.view(np.int64)), pa.nulls(len(size), pa.int64())]), "n": np.concatenate([n, size]), "key": np.concatenate([keys[doc[first]], keys])})

    deal = F.xxhash64("cluster", F.pmod(F.xxhash64("key"), F.ceil(F.col("size") / (4 * BLOCK_DOCS)).cast("int")))
    rows = settled(open_.select("key", "cluster", "size").join(texts, "key").withColumn("deal", deal).select("deal", "cluster", "key", "text").groupBy("deal").applyInArrow(run, "e bigint, n bigint, key bigint"))
    own = rows.filter("e is not null").groupBy("e").agg(F.sum("n").alias("n"), F.max("key").alias("key")).filter("n = 1").groupBy("key").agg(F.count("n").alias("own"))
    shared = F.col("n") - F.coalesce("own", F.lit(0))
    return rows.filter("e is null").select("key", "n").join(settled(own), "key", "left").select("key", "n", (shared * ((1 + similarity) / similarity) * (1 + 1e-9) - F.col("n")).alias("reach"))


def _every_link(texts: DataFrame, open_: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Links of strays to all documents of their clusters that can be similar enough, by size classes and blocks of them."""
    kind = lambda n: F.floor(F.log(F.greatest(n, F.lit(1.0))) / SIZE_CLASS).cast("int")
    blocks = lambda n: F.ceil(n / BLOCK_DOCS).cast("int")
    own = lambda n, seed: F.pmod(F.xxhash64("key", F.lit(seed)), n).cast("int")
    t = settled(open_.join(settled(_reach(texts, open_, similarity, shingle)), "key").withColumn("kind", kind(F.col("n"))))
    kinds = settled(t.groupBy("cluster", "kind").agg(F.max("reach").alias("furthest"), F.count("key").alias("rows")))
    low = F.col("n") * (similarity * (1 - 1e-9))
    strays = t.filter(F.col("stray") & (F.col("reach") >= low)).withColumn("kind", F.explode(F.sequence(kind(low), kind(F.col("reach")))))
    strays = settled(_with_small(strays, kinds, ["cluster", "kind"]).filter(F.col("furthest") >= F.col("n")))
    asked = settled(strays.groupBy("cluster", "kind").agg(F.count("key").alias("asked"), F.min("n").alias("least")))
    strays = _with_small(strays, asked, ["cluster", "kind"]).withColumn("x", own(blocks(F.col("asked")), 0)).withColumn("y", F.explode(F.sequence(F.lit(0), blocks(F.col("rows")) - 1)))
    others = _with_small(_with_small(t, kinds.select("cluster", "kind", "rows"), ["cluster", "kind"]), asked, ["cluster", "kind"]).filter(F.col("reach") >= F.col("least"))
    others = others.withColumn("stray", F.lit(False)).withColumn("y", own(blocks(F.col("rows")), 1)).withColumn("x", F.explode(F.sequence(F.lit(0), blocks(F.col("asked")) - 1)))
    unit = [F.xxhash64("cluster", "kind", "x", "y").alias("unit"), "key", "id", "part", "top", "stray"]
    return _stray_links(texts, strays.select(*unit).unionByName(others.select(*unit)), similarity, shingle)


def _stray_links(texts: DataFrame, dealt: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Links of strays to documents of other parts, within units.

    ``dealt``: unit, key, id, part, top, stray; a unit holds some hundreds of documents.  Strays
    that have come to the largest part are not looked at again; documents of parts that are
    joined by now need no further link.
    """
    groups = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-dealt.count() // BLOCK_DOCS))
    rows = dealt.join(texts, "key").select(F.pmod("unit", F.lit(groups)).alias("deal"), "unit", "id", "part", "top", "stray", "text")

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("unit")
        unit, ids, part, top, stray = (table.column(c).to_numpy() for c in ("unit", "id", "part", "top", "stray"))
        e, cut = _elements(table.column("text"), shingle)
        out: list[tuple[int, int]] = []
        edges = np.concatenate([[0], np.flatnonzero(np.diff(unit)) + 1, [len(unit)]])
        for lo, hi in zip(edges, edges[1:], strict=False):
            out += _unit_links(ids[lo:hi], part[lo:hi], int(top[lo]), np.flatnonzero(stray[lo:hi]), e[cut[lo] : cut[hi]], cut[lo : hi + 1] - cut[lo], similarity)
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    return rows.groupBy("deal").applyInArrow(compare, "a bigint, b bigint")


def _unit_links(ids: np.ndarray, part: np.ndarray, top: int, strays: np.ndarray, e: np.ndarray, cut: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Pairs of one unit that join parts: each stray's overlap with all others is counted by inverted lists."""
    root = {int(p): int(p) for p in part} | {top: top}

    def find(p: int) -> int:
        while root[p] != p:
            root[p] = root[root[p]]
            p = root[p]
        return p

    size = np.diff(cut)
    _, number = np.unique(e, return_inverse=True)
    order = np.argsort(number, kind="stable")
    lists, begin = np.repeat(np.arange(len(ids)), size)[order], np.searchsorted(number[order], np.arange(number.max(initial=-1) + 2))
    out = []
    for i in strays:
        mine = number[cut[i] : cut[i + 1]]
        length = begin[mine + 1] - begin[mine]
        stop = np.cumsum(length)
        if not len(stop) or find(int(part[i])) == find(top):
            continue
        both = np.bincount(lists[np.repeat(begin[mine] - (stop - length), length) + np.arange(stop[-1])], minlength=len(ids))
        for j in np.flatnonzero(both / (size[i] + size - both) >= similarity):
            p, q = find(int(part[i])), find(int(part[j]))
            if p != q:
                root[max(p, q)] = min(p, q)
                out.append((int(ids[i]), int(ids[j])))
    return out


def _rest(docs: DataFrame, candidates: DataFrame, links: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """``links`` with what else joins the parts of the candidates' clusters.

    Small clusters are compared completely.  In a large one each round compares the strays
    (documents outside the largest part) among themselves in blocks and with ``PIVOTS``
    documents of the whole cluster, so a round moves each stray once; most strays come to
    the largest part.  Those that don't are compared with all documents of their cluster
    that they can be similar to.
    """
    clusters = settled(components(candidates).withColumnRenamed("class_id", "cluster"))
    number = lambda n, seed: F.pmod(F.xxhash64("key", F.lit(seed)), n)
    stray, found, small = F.col("part") != F.col("top"), links, 2 * BLOCK_DOCS
    open_ = _open(clusters, found, 3)
    texts = settled(_texts_of(docs, open_.select(F.col("id").alias("doc_id"))).select(F.col("doc_id").alias("id"), F.xxhash64("doc_id", "text").alias("key"), "text"))
    open_ = settled(open_.join(texts.select("id", "key"), "id"))
    clusters = open_.select("id", "cluster", "key")
    texts, before = texts.select("key", "text"), None
    while True:
        n, most = open_.agg(F.count(F.when(stray, 1)), F.max("strays")).first()
        if not n:
            return found
        open_ = open_.withColumn("stray", stray)
        if before is not None and (most <= BLOCK_DOCS or 2 * n > before):
            return found.union(settled(_every_link(texts, open_, similarity, shingle)))
        whole, blocks = F.col("size") <= small, F.ceil(F.col("strays") / BLOCK_DOCS).cast("int")
        mine = F.when(whole, 0).otherwise(number(blocks, 0)).cast("int")
        pivot = number(F.col("size"), 1 if before is None else before) < PIVOTS
        places = F.when(pivot & ~whole, F.sequence(F.lit(0), blocks - 1)).when(stray | whole, F.array(mine))
        rows = open_.withColumn("mine", mine).withColumn("x", F.explode(places))
        units = rows.select(F.xxhash64("cluster", "x").alias("unit"), "key", "id", "part", "top", (F.col("stray") & (F.col("x") == F.col("mine"))).alias("stray"))
        found, before = found.union(settled(_stray_links(texts, units, similarity, shingle))), n
        open_ = _open(clusters, found, small + 1)


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE) -> DataFrame:
    """The class of each row of ``docs``: documents joined by links of ``similarity`` or more.

    Needs doc_id (integer) and text; others are ignored, whatever their names.  Texts
    of equal words are one class from the start.  A document without words is alone in
    its class.  Rows with one id are one document.  A row whose id is null has a null
    class.  Repeated rows stay; an empty table gives an empty result.

    Returns doc_id, class_id (smallest doc_id of the class), class_size (different
    doc_ids in it).
    """
    plain = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = settled(sketch(plain, bands, rows, shingle))
    filled = sketches.filter("doc_id is not null and key is not null")
    kinds = settled(filled.groupBy("key").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands")))
    banded = kinds.select("id", F.explode("bands").alias("band"))
    least = banded.groupBy("band").agg(F.min("id").alias("b"), F.max("id").alias("most")).filter("b < most").select("band", "b")
    candidates = settled(banded.join(least, "band").filter("id <> b").select(F.col("id").alias("a"), "b").distinct())
    links = settled(_links(plain, candidates, similarity, shingle).select("a", "b"))
    if not candidates.isEmpty():
        links = _rest(plain, candidates, links, similarity, shingle)
    # one id with several texts, and one text with several ids, join what they belong to
    same = filled.select("doc_id", "key").distinct().join(kinds.select("key", "id"), "key").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    shared = same.groupBy("a").agg(F.min("b").alias("b"), F.max("b").alias("most")).filter("b < most").select("a", "b")
    classes = components(links.union(shared.select("a", "b")).union(same.join(shared.select("a"), "a", "left_semi")))
    by_key = kinds.select("key", "id").join(classes, "id", "left").select("key", F.coalesce("class_id", "id").alias("class_id"))
    out = settled(sketches.select("doc_id", "key").join(by_key, "key", "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id")))
    sizes = out.select("doc_id", "class_id").distinct().groupBy("class_id").agg(F.count("doc_id").alias("class_size"))
    many = settled(sizes.filter("class_size > 1"))
    return _with_small(out, many, ["class_id"], "left").select("doc_id", "class_id", F.coalesce("class_size", F.lit(1)).alias("class_size"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, all columns, but of each class only the document with the smallest id.

    Rows with one id are one document and stay or go together; rows with a null id stay.
    """
    gone = settled(near_duplicates(docs, similarity).filter("doc_id <> class_id").select("doc_id").distinct())
    few = gone.count() <= MAX_BROADCAST
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*docs.columns)
