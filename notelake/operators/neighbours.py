"""Exact nearest neighbours of many queries, with cells and bounds instead of all pairs.

Records lie in the cell of their nearest pivot.  A query first searches the cells nearest
to it that hold k records; the k-th distance found bounds all others, so by the triangle
inequality it only has to visit cells that can hold a nearer record, and in these only
records whose distance to the pivot is near enough to its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notelake.functions.tables import settled, small

#: Records of a cell, on average, and cells at most; sampled records for each cell.
CELL, MOST_CELLS, SAMPLED = 2048, 256, 16
#: Records and queries that meet in a task.
CHUNK, BLOCK = 16_384, 1024
#: Bounds are loosened by this share, far more than rounding can change.
SLACK = 1e-9
_KEY = ["namespace", "cell"]


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def distances(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Distance of each row to each other, in steps of bounded size."""
    out = np.empty((len(rows), len(others)))
    for i, x in enumerate(others):
        out[:, i] = np.sqrt(((rows - x) ** 2).sum(1))
    return out


def pivots(known: DataFrame, cells: int, rows: int, rounds: int = 5) -> np.ndarray:
    """Middles of cells by some rounds of k-means over about ``SAMPLED`` records for each, chosen by a hash of their ids."""
    share = min(1.0, SAMPLED * cells / max(rows, 1))
    some = known.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) <= int(share * (1 << 30))).select("embedding").distinct()
    x = matrix(some.toArrow().column("embedding"))
    x = x[np.lexsort(x.T)]
    middle = x[np.random.default_rng(1).permutation(len(x))[:cells]]
    for _ in range(rounds):
        home = distances(x, middle).argmin(axis=1)
        sums = np.zeros_like(middle)
        np.add.at(sums, home, x)
        n = np.bincount(home, minlength=len(middle))
        middle = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], middle)
    return middle


def _placed(known: DataFrame, middle: np.ndarray) -> DataFrame:
    """``known`` with cell and distance to its pivot."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = distances(matrix(batch.column("embedding")), middle)
            home = d.argmin(axis=1) if len(d) else np.zeros(0, np.int64)
            yield batch.append_column("cell", pa.array(home, pa.int32())).append_column("far", pa.array(d[np.arange(len(d)), home]))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in known.schema)
    return known.mapInArrow(place, f"{kinds}, cell int, far double")


def _visits(asked: DataFrame, middle: np.ndarray, k: int) -> DataFrame:
    """``asked`` (with cells, bound: null in the first round) with ``to``: cells to visit and the query's distances to their pivots."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = distances(matrix(batch.column("embedding")), middle)
            out = []
            for own, cells, bound in zip(d, batch.column("cells").to_pylist(), batch.column("bound").to_pylist(), strict=True):
                cell, n, low, high = (np.array(x) for x in zip(*((c["cell"], c["n"], c["low"], c["high"]) for c in cells), strict=True))
                q = own[cell]
                order = np.argsort(q, kind="stable")
                first = np.zeros(len(q), bool)
                first[order[: np.searchsorted(np.cumsum(n[order]), k, "left") + 1]] = True
                if bound is None:
                    go = first
                else:
                    # by the ring of the cell, and by the plane between its pivot and the nearest one
                    least = np.maximum.reduce([q - high, low - q, (q - own.min()) / 2, np.zeros(len(q))])
                    go = ~first & (least <= bound * (1 + SLACK) + SLACK)
                out.append([{"cell": int(c), "own": float(x)} for c, x in zip(cell[go], q[go], strict=True)])
            yield batch.append_column("to", pa.array(out, pa.list_(pa.struct([("cell", pa.int32()), ("own", pa.float64())]))))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema)
    return asked.mapInArrow(route, f"{kinds}, to array<struct<cell: int, own: double>>")


def _met(visits: DataFrame, placed: DataFrame, k: int, chunk: int, block: int) -> DataFrame:
    """query_id, id, distance of the k nearest of each visited chunk, and compared: distances computed there (once for each chunk)."""
    each = visits.select("query_id", F.col("namespace").alias("namespace"), F.col("embedding").alias("query"), "bound", F.explode("to").alias("x"))
    each = each.select("query_id", "namespace", "query", "bound", F.col("x.cell").alias("cell"), F.col("x.own").alias("own"))
    asked = each.groupBy(*_KEY).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    sizes = placed.groupBy(*_KEY).agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks"))
    shape = small(settled(asked.join(sizes, _KEY)))
    number = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = each.join(shape, _KEY).withColumn("b", number("query_id", "blocks")).withColumn("c", every("chunks")).drop("blocks", "chunks")
    right = placed.join(shape, _KEY).withColumn("c", number("id", "chunks")).withColumn("b", every("blocks")).drop("blocks", "chunks")

    def meet(key: tuple, some: pa.Table, rows: pa.Table) -> pa.Table:
        ids, number, far, compared = [], [], [], []
        if some.num_rows and rows.num_rows:
            rows = rows.sort_by("far")
            x, ring, names = matrix(rows.column("embedding")), rows.column("far").to_numpy(), rows.column("id").to_pylist()
            for q, e, own, bound in zip(some.column("query_id").to_pylist(), matrix(some.column("query")), some.column("own").to_pylist(), some.column("bound").to_pylist(), strict=True):
                lo, hi = 0, len(x)
                if bound is not None:
                    wide = bound * (1 + SLACK) + SLACK
                    lo, hi = np.searchsorted(ring, own - wide, "left"), np.searchsorted(ring, own + wide, "right")
                d = np.sqrt(((x[lo:hi] - e) ** 2).sum(1))
                near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if len(d) > k else range(len(d))
                best = sorted((float(d[i]), names[lo + i]) for i in near)[:k]
                far += [None, *(y for y, _ in best)]
                ids += [None, *(i for _, i in best)]
                number += [q] * (len(best) + 1)
                compared += [int(hi - lo), *[0] * len(best)]
        return pa.table({"query_id": pa.array(number, pa.int64()), "id": pa.array(ids, pa.string()), "distance": pa.array(far, pa.float64()), "compared": pa.array(compared, pa.int64())})

    by = [*_KEY, "b", "c"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(meet, "query_id bigint, id string, distance double, compared bigint")


def nearest(queries: DataFrame, known: DataFrame, k: int, cell: int = CELL, chunk: int = CHUNK, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The k nearest records of each query's namespace, and the work done for each query.

    ``queries``: query_id (number, unique), namespace, embedding; ``known``: id, namespace,
    embedding.  Rows with a null in any of these take no part.  Ties go to the smaller
    id.  There are as many cells as ``cell`` records each make, ``MOST_CELLS`` at most.
    Cells of any size are cut into chunks and their queries into blocks.

    Returns (query_id, id, distance) and (query_id, compared: distances computed, records: of the namespace).
    """
    whole = lambda df, key: df.filter(f"{key} IS NOT NULL AND namespace IS NOT NULL AND embedding IS NOT NULL").select(key, "namespace", "embedding")
    known, asked = settled(whole(known, "id")), whole(queries, "query_id")
    rows = known.count()
    cells = min(rows // cell, MOST_CELLS)
    middle = pivots(known, cells, rows) if cells > 1 else np.zeros((1, len((known.select("embedding").first() or [[0.0]])[0])))
    placed = settled(_placed(known, middle)) if cells > 1 else known.withColumns({"cell": F.lit(0), "far": F.lit(0.0)})
    about = placed.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n"), F.min("far").alias("low"), F.max("far").alias("high"))
    about = about.groupBy("namespace").agg(F.collect_list(F.struct("cell", "n", "low", "high")).alias("cells"), F.sum("n").alias("records"))
    asked = asked.join(about, "namespace").withColumn("bound", F.lit(None).cast("double"))
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    best = lambda df: df.filter("id IS NOT NULL").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k)
    if cells <= 1:
        met = _met(asked.withColumn("to", F.array(F.struct(F.lit(0).alias("cell"), F.lit(0.0).alias("own")))), placed, k, chunk, block)
    else:
        first = settled(_met(_visits(asked, middle, k), placed, k, chunk, block))
        kth = best(first).groupBy("query_id").agg(F.max("distance").alias("kth"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == k).drop("n")
        again = asked.drop("bound").join(kth, "query_id").withColumnRenamed("kth", "bound")  # with fewer than k records all cells were visited
        met = first.unionByName(settled(_met(_visits(again, middle, k), placed, k, chunk, block)))
    work = met.groupBy("query_id").agg(F.sum("compared").alias("compared")).join(asked.select("query_id", "records"), "query_id")
    return best(met).select("query_id", "id", "distance"), work
