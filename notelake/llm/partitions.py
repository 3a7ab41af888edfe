"""Nearest neighbours by learned partitions.

The neighbour graph of a bounded sample is cut into balanced parts, and a small network
learns to tell from a vector alone in which parts its neighbours lie.  Every row is
indexed under its most probable part.  A query goes to its most probable parts, as many
as held-out points of the sample needed to find their neighbours; rows of these parts
are ranked again by the exact measure.

Fitting sees about ``SAMPLE`` rows, whatever the table's size; indexing sees all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelake.llm.exchange import bounded, settled

#: Rows that the parts and the network are fitted on, about; they are chosen by a hash.
SAMPLE = 8192
#: Rows of a part in the table, at least, and sampled rows of a part, at least.
PART_ROWS, PART_SAMPLE = 512, 64
#: Share of a held-out point's neighbours that its parts have to hold.
TARGET = 0.96
#: Neighbours in the graph, units of the hidden layer, rounds over the sample.
DEGREE, HIDDEN, EPOCHS = 12, 128, 40
#: Bytes of a chunk's vectors (as doubles), and rows at least; queries that meet a chunk at once.
CHUNK_BYTES, CHUNK_ROWS, BLOCK = 16 << 20, 1024, 4096
#: Approximate cosines closer than this are compared by the exact measure.
SLACK = 1e-9


def matrix(vectors: pa.Array | pa.ChunkedArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors take part (``dim`` finite components, not all zero), and these as doubles, row by row."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.chunk(0)
    starts = vectors.offsets.to_numpy()
    ok = (np.diff(starts) == dim) & ~vectors.is_null().to_numpy(zero_copy_only=False)
    at = starts[:-1][ok]
    values = vectors.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null components become NaN
    rows = values[at[:, None] + np.arange(dim)] if len(at) else np.zeros((0, dim))
    good = np.isfinite(rows).all(axis=1) & (rows != 0).any(axis=1)
    return np.flatnonzero(ok)[good], rows[good]


def scaled(rows: np.ndarray) -> np.ndarray:
    """Rows whose squares would leave the range of doubles, times a power of two (which changes no cosine)."""
    most = np.abs(rows).max(axis=1)
    odd = (most > 1e120) | (most < 1e-120)
    if odd.any():
        rows = rows.copy()
        rows[odd] = np.ldexp(rows[odd], -np.frexp(most[odd])[1][:, None])
    return rows


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of products of each row of ``a`` with that of ``b``, component after component, so that equal rows give equal sums."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    rows = scaled(rows)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def neighbours(x: np.ndarray, k: int, of: np.ndarray | None = None, step: int = 512) -> np.ndarray:
    """The ``k`` other rows of ``x`` (unit vectors) with the largest cosine, for each row or those of ``of``."""
    of = np.arange(len(x)) if of is None else of
    out = np.empty((len(of), k), np.int64)
    for lo in range(0, len(of), step):
        s = x[of[lo : lo + step]] @ x.T
        s[np.arange(len(s)), of[lo : lo + step]] = -np.inf
        out[lo : lo + step] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def _halves(n: int, u: np.ndarray, v: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Cuts a graph into two halves with few edges between them: the second eigenvector first, exchanges of pairs then."""
    degree = np.sqrt(np.maximum(np.bincount(u, minlength=n), 1))
    trivial = degree / np.linalg.norm(degree)
    x = rng.standard_normal(n)
    for _ in range(60):
        x -= trivial * (trivial @ x)
        x /= np.linalg.norm(x) or 1
        y = x / degree
        x = x + np.bincount(u, weights=y[v], minlength=n) / degree  # the lazy walk has no negative eigenvalues
    side = np.zeros(n, bool)
    side[np.argsort(x, kind="stable")[n // 2 :]] = True
    for _ in range(10):
        across = np.bincount(u, weights=np.where(side[u] != side[v], 1.0, -1.0), minlength=n)  # what a move would save
        a, b = np.flatnonzero(side), np.flatnonzero(~side)
        a, b = a[np.argsort(-across[a], kind="stable")], b[np.argsort(-across[b], kind="stable")]
        m = min(len(a), len(b))
        better = int(np.argmin(np.append(across[a[:m]] + across[b[:m]] > 0, False)))
        if not better:
            break
        take = max(better // 2, 1)
        before = np.count_nonzero(side[u] != side[v])
        side[a[:take]], side[b[:take]] = False, True
        if np.count_nonzero(side[u] != side[v]) >= before:
            side[a[:take]], side[b[:take]] = True, False
            break
    return side


def balanced(near: np.ndarray, parts: int, seed: int = 1) -> np.ndarray:
    """Parts (a power of two) of equal size for the nodes of a neighbour graph, by cutting it in halves again and again."""
    n, rng = len(near), np.random.default_rng(seed)
    u, v = np.repeat(np.arange(n), near.shape[1]), near.ravel()
    u, v = np.concatenate([u, v]), np.concatenate([v, u])
    label, have = np.zeros(n, np.int64), 1
    while have < parts:
        inner = label[u] == label[v]
        u, v = u[inner], v[inner]
        for k in range(have):
            nodes = np.flatnonzero(label == k)
            own = label[u] == k
            place = np.zeros(n, np.int64)
            place[nodes] = np.arange(len(nodes))
            label[nodes[_halves(len(nodes), place[u[own]], place[v[own]], rng)]] += have
        have *= 2
    return label


@dataclass
class Router:
    """A network with one hidden layer from unit vectors to probabilities of parts, and the mass of parts that a query visits."""

    dim: int
    parts: int
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    mass: float = 1.0

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def home(self, rows: np.ndarray) -> np.ndarray:
        """The most probable part of each row."""
        return self.probabilities(unit(rows)).argmax(axis=1) if self.parts > 1 and len(rows) else np.zeros(len(rows), np.int64)

    def routes(self, rows: np.ndarray) -> list[np.ndarray]:
        """The most probable parts of each row, until those before hold more than ``mass``."""
        if self.parts == 1:
            return [np.zeros(1, np.int64)] * len(rows)
        order, before = _before(self.probabilities(unit(rows)))
        return [o[: max(int(n), 1)] for o, n in zip(order, (before <= self.mass).sum(axis=1), strict=True)]


def _before(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parts by falling probability, and the probability of those before each."""
    order = np.argsort(-p, axis=1, kind="stable")
    q = np.take_along_axis(p, order, axis=1)
    return order, np.cumsum(q, axis=1) - q


def _learn(x: np.ndarray, goal: np.ndarray, seed: int = 2) -> Router:
    """Cross-entropy with soft labels, by Adam."""
    rng, (n, dim), parts = np.random.default_rng(seed), x.shape, goal.shape[1]
    w = [rng.standard_normal((dim, HIDDEN)) * np.sqrt(2 / dim) * np.sqrt(dim) / 4, np.zeros(HIDDEN), rng.standard_normal((HIDDEN, parts)) * np.sqrt(1 / HIDDEN), np.zeros(parts)]
    first, second, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for epoch in range(EPOCHS):
        rate = 0.01 * (1 - epoch / EPOCHS) + 1e-4
        for at in np.array_split(rng.permutation(n), max(n // 256, 1)):
            h = np.maximum(x[at] @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            d = (z / z.sum(axis=1, keepdims=True) - goal[at]) / len(at)
            e = (d @ w[2].T) * (h > 0)
            step += 1
            for i, g in enumerate((x[at].T @ e, e.sum(axis=0), h.T @ d, d.sum(axis=0))):
                g = g + 1e-5 * w[i]
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                w[i] -= rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return Router(dim, parts, *w)


def fit(sample: np.ndarray, parts: int, k: int = 5, target: float = TARGET) -> Router:
    """Parts and their router from sampled rows; an eighth of them is held out to find the mass of parts that ``target`` needs."""
    x = np.unique(unit(sample), axis=0)
    while parts > 1 and len(x) < parts * PART_SAMPLE:
        parts //= 2
    if parts <= 1:
        return Router(sample.shape[1], 1, *(np.zeros(0),) * 4)
    x = x[np.random.default_rng(3).permutation(len(x))]
    held = len(x) // 8
    seen = x[held:]
    near = neighbours(seen, DEGREE)
    label = balanced(near, parts)
    goal = np.zeros((len(seen), parts))
    for j in range(DEGREE):
        np.add.at(goal, (np.arange(len(seen)), label[near[:, j]]), 1 / (DEGREE + 1))
    np.add.at(goal, (np.arange(len(seen)), label), 1 / (DEGREE + 1))
    router = _learn(seen, goal)
    p = router.probabilities(x)
    home = p.argmax(axis=1)
    order, before = _before(p[:held])
    place = np.argsort(order, axis=1)
    there = np.take_along_axis(place, home[neighbours(x, k, np.arange(held))], axis=1)
    needed = np.take_along_axis(before, there, axis=1)
    router.mass = float(np.quantile(needed, target, method="higher"))
    return router


def _usable(df: DataFrame, dim: int) -> DataFrame:
    """vec_id and embedding of the rows that take part."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.take(pa.array(matrix(batch.column("embedding"), dim)[0]))

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return bounded(df).select("vec_id", "embedding").filter("vec_id IS NOT NULL AND embedding IS NOT NULL").mapInArrow(keep, f"vec_id {kinds['vec_id']}, embedding {kinds['embedding']}")


def fitted(df: DataFrame, k: int = 5, target: float = TARGET, part_rows: int = PART_ROWS, sample: int = SAMPLE) -> Router | None:
    """The router of a table (vec_id, embedding): its dimension is that of most rows (the larger of two); None without rows."""
    found = df.filter("vec_id IS NOT NULL AND size(embedding) > 0").groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if found is None:
        return None
    dim, rows = found["dim"], found["count"]
    parts = 1
    while parts * 2 * part_rows <= rows and parts * 2 * PART_SAMPLE <= sample:
        parts *= 2
    if parts == 1:
        return Router(dim, 1, *(np.zeros(0),) * 4)
    some = _usable(df, dim)
    if rows > sample:
        some = some.filter(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(1 << 31)) < int(sample / rows * (1 << 31)))
    some = some.dropDuplicates()  # any number of equal rows counts once
    return fit(matrix(some.select("embedding").toArrow().column("embedding"), dim)[1], parts, k, target)


def indexed(df: DataFrame, router: Router) -> DataFrame:
    """vec_id, embedding and part of every row that takes part."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = matrix(batch.column("embedding"), router.dim)
            yield batch.take(pa.array(at)).append_column("part", pa.array(router.home(rows), pa.int32()))

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return bounded(df).select("vec_id", "embedding").filter("vec_id IS NOT NULL AND embedding IS NOT NULL").mapInArrow(assign, f"vec_id {kinds['vec_id']}, embedding {kinds['embedding']}, part int")


def _best(queries: pa.Table, rows: pa.Table, dim: int, k: int) -> tuple[np.ndarray, ...]:
    """Number of the query, score, vec_id and whether the vectors are equal, of the best ``k`` rows for each query.

    Equal vectors are compared once and stand for their ``k`` smallest ids.
    """
    q = scaled(matrix(queries.column("embedding"), dim)[1])
    c = np.ascontiguousarray(matrix(rows.column("embedding"), dim)[1]) + 0.0  # no negative zeros
    ids = rows.column("vec_id").to_numpy()
    _, first, kind = np.unique(c.view(np.dtype((np.void, c.itemsize * dim))).ravel(), return_index=True, return_inverse=True)
    order = np.lexsort((ids, kind))
    ids, kind = ids[order], kind[order]
    new = np.concatenate([[True], (kind[1:] != kind[:-1]) | (ids[1:] != ids[:-1])])
    ids, kind = ids[new], kind[new]
    begin = np.searchsorted(kind, np.arange(len(first) + 1))
    size = np.minimum(np.diff(begin), k)
    original, c = c[first], scaled(c[first])
    norms, q_norms = np.sqrt(dots(c, c)), np.sqrt(dots(q, q))
    units, q_units = c / norms[:, None], q / q_norms[:, None]
    exact_q = matrix(queries.column("embedding"), dim)[1] + 0.0
    out = []
    step = max(1, (32 << 20) // (8 * len(c)))
    for lo in range(0, len(q), step):
        s = q_units[lo : lo + step] @ units.T
        least = np.partition(s, len(c) - k, axis=1)[:, len(c) - k] if len(c) > k else np.full(len(s), -np.inf)
        i, j = np.nonzero(s >= least[:, None] - SLACK)
        i += lo
        for a in range(0, len(i), 1 << 16):  # many near ties are compared in steps
            ii, jj = i[a : a + (1 << 16)], j[a : a + (1 << 16)]
            score = dots(q[ii], c[jj]) / (q_norms[ii] * norms[jj])
            own = (exact_q[ii] == original[jj]).all(axis=1)
            n = size[jj]
            at = np.repeat(begin[jj] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out.append((np.repeat(ii, n), np.repeat(score, n), ids[at], np.repeat(own, n)))
    number, score, vec_id, own = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((vec_id, -score, number))
    number, score, vec_id, own = number[order], score[order], vec_id[order], own[order]
    rank = np.arange(len(number)) - np.searchsorted(number, number, "left")
    keep = rank < k
    return number[keep], score[keep], vec_id[keep], own[keep]


def search(df: DataFrame, queries: Column, k: int = 5, router: Router | None = None) -> DataFrame:
    """The ``k`` nearest rows by cosine that the index finds for each row where ``queries`` holds, but for that row itself.

    Needs vec_id (integer) and embedding (array of float or double); others are ignored.
    A vector that is null, zero, of another length than most, or that holds a null or
    non-finite component takes no part, nor does a row with a null vec_id.  Ties go to
    the smaller vec_id.  Repeated rows are one row; rows that share an id but not the
    vector are different ones.  With at most ``k`` candidates all are found.  No rows
    give no rows.  Tables under twice ``PART_ROWS`` are one part, so the search is exact.

    A part is cut into chunks and its queries into blocks, however large it is; equal
    queries are searched once.

    Returns query_id, rank (from 1), vec_id, score.
    """
    id_kind = df.schema["vec_id"].dataType.simpleString()
    router = router or fitted(df, k)
    if router is None:
        return df.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dim, wanted = router.dim, k + 1
    rows = settled(indexed(df, router))
    rows = rows.withColumn("at", F.monotonically_increasing_id())
    asked = rows.filter(F.coalesce(queries, F.lit(False))).select(F.col("vec_id").alias("query_id"), F.xxhash64("embedding").alias("h"), F.xxhash64(F.lit(7), "embedding").alias("g"), "embedding")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("parts", pa.array(router.routes(matrix(batch.column("embedding"), dim)[1]), pa.list_(pa.int32())))

    vector = df.schema["embedding"].dataType.simpleString()
    routed = settled(asked.select("h", "g", "embedding").dropDuplicates(["h", "g"]).mapInArrow(route, f"h bigint, g bigint, embedding {vector}, parts array<int>"))
    sizes, visits = np.zeros(router.parts, np.int64), np.zeros(router.parts, np.int64)
    for r in rows.groupBy("part").count().collect():  # as many as parts
        sizes[r["part"]] = r["count"]
    for r in routed.select(F.explode("parts").alias("part")).groupBy("part").count().collect():
        visits[r["part"]] = r["count"]
    most = int(np.clip(2 * sizes.sum() // router.parts, CHUNK_ROWS, max(CHUNK_BYTES // (8 * dim), CHUNK_ROWS)))
    of = lambda counts, size: F.element_at(F.array(*(F.lit(int(max(1, -(-n // size)))) for n in counts)), F.col("part") + 1)
    chunks, blocks = of(sizes, most), of(visits, BLOCK)
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = routed.select(F.explode("parts").alias("part"), "h", "g", "embedding").select("part", F.pmod("h", blocks).cast("int").alias("block"), every(chunks).alias("chunk"), "h", "g", "embedding")
    right = rows.select("part", every(blocks).alias("block"), F.pmod(F.xxhash64("vec_id", "at"), chunks).cast("int").alias("chunk"), "vec_id", "embedding")

    def compare(key: tuple, queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not queries.num_rows or not rows.num_rows:
            return _NONE.cast(pa.schema([*_NONE.schema][:-2] + [pa.field("vec_id", rows.schema.field("vec_id").type), _NONE.schema.field("own")]))
        number, score, vec_id, own = _best(queries, rows, dim, wanted)
        near = queries.select(["h", "g"]).take(pa.array(number))
        return near.append_column("score", pa.array(score)).append_column("vec_id", pa.array(vec_id, rows.schema.field("vec_id").type)).append_column("own", pa.array(own))

    by = ("part", "block", "chunk")
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(compare, f"h bigint, g bigint, score double, vec_id {id_kind}, own boolean")
    best = found.withColumn("place", F.dense_rank().over(Window.partitionBy("h", "g").orderBy(F.desc("score"), "vec_id", "own"))).filter(F.col("place") <= wanted)
    best = best.groupBy("h", "g").agg(F.collect_set(F.struct((-F.col("score")).alias("far"), "vec_id", "own")).alias("near"))
    near = asked.select("query_id", "h", "g").distinct().join(best, ["h", "g"])
    others = F.filter("near", lambda x: ~(x["own"] & (x["vec_id"] == F.col("query_id"))))
    out = near.select("query_id", F.posexplode(F.slice(F.sort_array(others), 1, k)).alias("i", "x"))
    return out.select(F.col("query_id").cast("long").alias("query_id"), (F.col("i") + 1).alias("rank"), F.col("x.vec_id").cast("long").alias("vec_id"), (-F.col("x.far")).alias("score"))


_NONE = pa.table({"h": pa.array([], pa.int64()), "g": pa.array([], pa.int64()), "score": pa.array([], pa.float64()), "vec_id": pa.array([], pa.int64()), "own": pa.array([], pa.bool_())})
