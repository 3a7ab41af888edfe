"""Vector search, semantic search, re-ranking and novelty (D, F3, C1, C13)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake import literals as L
from notelake.functions import scalar as S
from notelake.operators import neighbours


def nearest(vectors: DataFrame, m: DataFrame, query: Sequence[float] | DataFrame, k: int = 10, namespace: str | None = None, spec: str | None = None, mode: str = "post") -> DataFrame:
    """The k nearest records with their distance, nearest first, ties by id.

    ``query``: a vector, or a DataFrame with one row and column q.  mode "post": the 3 k
    nearest vectors are found first and filtered afterwards, so fewer than k may be left;
    "pre": records are filtered first, which is exact.  The search keeps 3 k rows a task.
    """
    if isinstance(query, DataFrame):
        scored = vectors.crossJoin(F.broadcast(query.limit(1))).withColumn("distance", S.l2_distance(F.col("embedding"), F.col("q"))).drop("q")
    else:
        scored = vectors.withColumn("distance", S.l2_distance(F.col("embedding"), F.array(*(F.lit(float(x)) for x in query))))
    scored = scored.select("id", "distance")
    keep = m
    if namespace is not None:
        keep = keep.filter(F.col("namespace") == namespace)
    if spec is not None:
        keep = keep.filter(F.col("spec") == spec)
    if mode == "pre":
        scored = scored.join(keep.select("id"), "id", "left_semi")
        winners = scored.orderBy("distance", "id").limit(k)
        return keep.join(F.broadcast(winners), "id").orderBy("distance", "id")
    winners = scored.orderBy("distance", "id").limit(3 * k)
    return keep.join(F.broadcast(winners), "id").orderBy("distance", "id").limit(k)


def search(vectors: DataFrame, m: DataFrame, query: Sequence[float] | DataFrame, k: int = 10, namespace: str | None = None, spec: str | None = None, min_similarity: float | None = None, mode: str = "post") -> DataFrame:
    """Nearest records with similarity 1 / (1 + d), cut off after the limit."""
    found = nearest(vectors, m, query, k, namespace, spec, mode).withColumn("similarity", S.recall_similarity(F.col("distance")))
    return found if min_similarity is None else found.filter(F.col("similarity") >= min_similarity)


def similar(vectors: DataFrame, m: DataFrame, memory_id: str, k: int = 5, exclude_self: bool = True) -> DataFrame:
    """Neighbours of a record, itself left out; none if it has no vector."""
    q = vectors.filter(F.col("id") == memory_id).select(F.col("embedding").alias("q"))
    found = nearest(vectors, m, q, k + 1 if exclude_self else k, mode="pre")
    return (found.filter(F.col("id") != memory_id) if exclude_self else found).orderBy("distance", "id").limit(k)


def embed(texts: DataFrame, model: Callable[[list[str]], Sequence[Sequence[float]]], dimensions: int, batch: int = 32, column: str = "text") -> DataFrame:
    """``texts`` with unit vectors; blank texts get zeros.  The model is called with batches, once loaded in each worker."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out: list[list[float]] = []
            values = part.tolist()
            for lo in range(0, len(values), batch):
                some = values[lo : lo + batch]
                filled = [t for t in some if t and t.strip()]
                vectors = iter(model(filled) if filled else [])
                for t in some:
                    v = [float(x) for x in next(vectors)] if t and t.strip() else [0.0] * dimensions
                    norm = sum(x * x for x in v) ** 0.5
                    out.append([x / norm for x in v] if norm else v)
            yield pd.Series(out)

    return texts.withColumn("embedding", run(F.col(column)))


def rerank(results: DataFrame, as_of: Column, target_spec: str | None = None, target_namespace: str | None = None, target_tags: Sequence[str] = (), weights: tuple[float, float, float, float] = (0.2, 0.1, 0.15, 0.1)) -> DataFrame:
    """Results by distance less a tenth of a boost for recency, namespace, spec and tags; ties stay in order.

    ``results`` has distance, timestamp, namespace, spec, tags and id.
    """
    priority = F.create_map(*(F.lit(x) for kv in L.NAMESPACE_PRIORITY.items() for x in kv))
    recency = S.temporal_decay("timestamp", as_of)
    space = F.coalesce(F.try_element_at(priority, F.col("namespace")), F.lit(0.5)) + (F.when(F.col("namespace") == target_namespace, 0.2).otherwise(0.0) if target_namespace else F.lit(0.0))
    spec = F.when(F.col("spec") == target_spec, 1.0).otherwise(0.0) if target_spec else F.lit(0.0)
    wanted = F.array(*map(F.lit, dict.fromkeys(target_tags))).cast("array<string>")
    tags = F.coalesce(F.size(F.array_intersect("tags", wanted)) / F.lit(float(max(len(target_tags), 1))), F.lit(0.0)) if target_tags else F.lit(0.0)
    a, b, c, d = weights
    boost = F.lit(a) * recency + F.lit(b) * space + F.lit(c) * spec + F.lit(d) * tags
    out = results.withColumn("rank_factors", F.struct(recency.alias("recency"), space.alias("namespace"), spec.cast("double").alias("spec"), tags.alias("tags")))
    return out.withColumn("boosted", F.greatest(F.lit(0.0), F.col("distance") - boost * F.lit(0.1))).orderBy("boosted", "distance", "id")


def nearest_many(queries: DataFrame, vectors: DataFrame, m: DataFrame, k: int = 5, **sizes: int) -> DataFrame:
    """query_id, id and distance of the k nearest records of each query's namespace, exactly.

    ``queries``: query_id (number, unique), namespace, embedding (null finds nothing).
    Cells around pivots and the triangle inequality spare most comparisons where vectors
    lie in clusters (``neighbours``, with its ``sizes``).
    """
    return neighbours.nearest(queries, vectors.join(m.select("id", "namespace"), "id"), k, **sizes)[0]


def novelty(queries: DataFrame, vectors: DataFrame, m: DataFrame, k: int = 5, threshold: float = 0.3, similar_from: float = 0.7) -> DataFrame:
    """Novelty of each query (query_id, namespace, embedding) against its namespace's records.

    1 less the largest similarity of the k nearest; without vector or neighbours 1.
    """
    best = nearest_many(queries, vectors, m, k).withColumn("s", S.recall_similarity(F.col("distance")))
    found = best.groupBy("query_id").agg(F.max("s").alias("highest_similarity"), F.array_sort(F.collect_list(F.when(F.col("s") >= similar_from, F.col("id")))).alias("similar_ids"))
    out = queries.select("query_id").join(found, "query_id", "left")
    score = F.lit(1.0) - F.coalesce("highest_similarity", F.lit(0.0))
    return out.select("query_id", score.alias("novelty_score"), (score >= threshold).alias("is_novel"), F.coalesce("highest_similarity", F.lit(0.0)).alias("highest_similarity"), F.coalesce("similar_ids", F.array().cast("array<string>")).alias("similar_ids"))


class SearchCache:
    """F6, N5c-N5e: results by key with a size limit (least recently used goes) and a time to live."""

    def __init__(self, size: int = 100, ttl_seconds: float = 300.0, clock: Callable[[], float] | None = None):
        import time

        self._size, self._ttl, self._clock = size, ttl_seconds, clock or time.monotonic
        self._entries: dict[str, tuple[float, object]] = {}
        self._hits = self._misses = 0

    def get(self, key: str) -> object | None:
        entry = self._entries.pop(key, None)
        if entry is None or self._clock() - entry[0] > self._ttl:
            self._misses += 1
            return None
        self._entries[key] = entry
        self._hits += 1
        return entry[1]

    def set(self, key: str, value: object) -> None:
        self._entries.pop(key, None)
        while len(self._entries) >= self._size:
            self._entries.pop(next(iter(self._entries)))
        self._entries[key] = (self._clock(), value)

    def invalidate(self, part: str | None = None) -> int:
        gone = [k for k in self._entries if part is None or part in k]
        for k in gone:
            del self._entries[k]
        return len(gone)

    def stats(self) -> dict[str, float]:
        return {"size": len(self._entries), "max_size": self._size, "ttl_seconds": self._ttl, "hits": self._hits, "misses": self._misses}
