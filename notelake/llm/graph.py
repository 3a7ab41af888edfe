"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.llm.exchange import forget, settled

#: Edges (16 bytes each) up to which one task joins all that are left; more never meet in one place.
LOCAL_EDGES = 1_000_000


def least_members(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges, ascending, and the smallest node that each is connected with."""
    ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(ids))
    while True:
        p, q = root[u], root[v]
        apart = np.flatnonzero(p != q)
        if not len(apart):
            return ids, ids[root]
        u, v, p, q = u[apart], v[apart], p[apart], q[apart]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root[root] != root).any():
            root = root[root]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(batches, pa.schema([("u", pa.int64()), ("v", pa.int64())]))
    ids, least = least_members(table.column("u").to_numpy(), table.column("v").to_numpy())
    yield from pa.table({"id": ids, "class_id": least}).to_batches(max_chunksize=100_000)


def components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """id and class_id (the component's smallest id) of each node of ``edges`` (columns a, b).

    While more than ``local_edges`` edges are left, the graph is contracted: each node
    moves to the one with the smallest hash among itself and its neighbours, edges follow
    their ends, and loops and repeats go; some half of the nodes or more vanish in each
    round, whatever the shape.  One task joins the edges that are left, and labels go back
    the way the nodes came.  Minima are summed map-side and joins are of two settled
    tables, which Spark splits at skewed keys, so a hub is no one task's work.  Loops and
    null ends are ignored; no edges give an empty result.
    """
    e = settled(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct())
    moves = []
    while e.count() > local_edges:
        near = e.union(e.select("v", "u")).groupBy("u").agg(F.min(F.struct(F.xxhash64("v").alias("h"), "v")).alias("m"))
        least = F.least("m", F.struct(F.xxhash64("u").alias("h"), F.col("u").alias("v")))["v"]
        move = settled(near.select(F.col("u").alias("id"), least.alias("to")))
        moves.append(move)
        ends = e.join(move.withColumnRenamed("to", "p"), e["u"] == move["id"]).select("p", "v")
        ends = ends.join(move.withColumnRenamed("to", "q"), F.col("v") == F.col("id")).select("p", "q").filter("p <> q")
        before, e = e, settled(ends.select(F.greatest("p", "q").alias("u"), F.least("p", "q").alias("v")).distinct())
        forget(before)
    found = e.repartition(1).mapInArrow(_joined, "id bigint, class_id bigint")
    for move in reversed(moves):
        label = settled(found)
        found = move.join(label.withColumnRenamed("id", "to"), "to", "left").select("id", F.coalesce("class_id", "to").alias("class_id"))
    if not moves:
        return found
    found = settled(found)
    least = settled(found.groupBy("class_id").agg(F.min("id").alias("least")))
    return found.join(least, "class_id").select("id", F.col("least").alias("class_id"))
