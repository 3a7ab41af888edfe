"""Finding equal hashes across all documents without gathering any key's rows.

Documents are dealt into chunks of bounded size.  A chunk sends each of its hashes
once, packed with others of one hash range; a hash range is resolved in one place and
answers each chunk with the hashes that concern it.  So a value that stands in a third
of all documents costs one entry a chunk, and nothing grows with a value's frequency.
"""

from __future__ import annotations

import math
import re
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.functions.tables import release  # noqa: F401

U64 = np.uint64
#: A task's share of the executors' heap by the input bytes (as stored) of a chunk.  The work on a chunk takes some
#: 30 times its bytes, in Python; larger chunks make packed rows longer and fewer.
HEAP_BY_CHUNK = 300
MIN_CHUNK, MAX_CHUNK = 1 << 20, 256 << 20
#: Equal ranges of ids in which documents are counted before ids are dealt into chunks; most ranges of a later count.
ID_RANGES, MAX_EDGES = 1 << 14, 1 << 18
#: Bytes of an Arrow batch between Spark and Python.
BATCH_BYTES = 16 << 20
#: Chunks whose hashes one hash range gets on average.
CHUNKS_PER_RANGE = 4
PACKED = "bucket int, chunk int, payload binary"
ANSWER = "chunk int, payload binary"


def bounded(df: DataFrame) -> DataFrame:
    """``df``, with Arrow batches of its session limited to ``BATCH_BYTES``, so that very long texts don't add up."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(conf.get(key).rstrip("bB")) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def stored_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes that ``df`` is stored in, if it is read off files; else half of the bytes of a column, counted in one pass."""
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    if leaves.size() == 1 and leaves.head().getClass().getSimpleName() == "LogicalRelation":
        return int(str(plan.stats().sizeInBytes()))
    return (df.agg(F.sum(F.octet_length(column))).first()[0] or 0) // 2


def _bytes(text: str) -> int:
    digits = text.lower().rstrip("kmgtb")
    return int(float(digits) * 1024 ** " kmgt".index((text.lower().rstrip("b")[len(digits) :] or " ")[0]))


def chunk_bytes(spark: SparkSession, share: float = 1.0) -> int:
    """Input bytes of a chunk by the memory that a task has: the executor's heap by its cores, in a local session the driver's."""
    conf = spark.sparkContext.getConf()
    master = re.findall(r"[\w*-]+", spark.sparkContext.master)
    local = master[0] == "local"
    heap = conf.get("spark.driver.memory" if local else "spark.executor.memory", "1g")
    cores = spark.sparkContext.defaultParallelism if local else int(conf.get("spark.executor.cores") or (master[2] if master[0] == "local-cluster" else 1))
    return min(max(int(_bytes(heap) / cores / HEAP_BY_CHUNK * share), MIN_CHUNK), MAX_CHUNK)


def chunk_count(df: DataFrame, size: int | None = None, share: float = 1.0) -> tuple[int, int]:
    """Chunks and hash ranges for ``df``: by its size (in bytes of ``size``, or by the tasks' memory), and one for each shuffle partition at least."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = max(parts, math.ceil(stored_bytes(df) / (size or chunk_bytes(df.sparkSession, share))))
    if chunks >= 1 << 31:
        raise ValueError(f"{chunks} chunks are more than can be numbered: give executors more memory")
    return chunks, max(parts, math.ceil(chunks / CHUNKS_PER_RANGE))


def settled(df: DataFrame) -> DataFrame:
    """``df``, worked out once and kept in the shared checkpoint folder, with its lineage cut.

    The folder is ``spark.checkpoint.dir``; only in a local session without it, as in tests, one of our own is set.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir is to name a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="notelake-checkpoints-"))
    return df.checkpoint(eager=True)


def forget(df: DataFrame) -> None:
    """Deletes the files of a settled table that nothing reads any more."""
    plan = df._jdf.queryExecution().logical()
    if plan.getClass().getSimpleName() == "LogicalRDD" and (found := plan.rdd().getCheckpointFile()).isDefined():
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(found.get())
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@dataclass
class Ranges:
    """Chunks by ranges of ids: where each begins, and which chunks one id with many rows is split over."""

    starts: np.ndarray  # smallest id of each range, but the first, which begins at the smallest number
    number: np.ndarray  # first chunk of each range
    split: np.ndarray  # chunks of each range; more than one for an id with many rows
    nulls: int  # chunks of rows without an id; they come before all others

    def chunk(self, column: Column, salt: Column) -> Column:
        """Chunk number of a row; the salt tells in which of an id's chunks it is."""
        starts, number, split, nulls = self.starts, self.number, self.split, self.nulls

        @F.pandas_udf("int")
        def find(ids: pd.Series, known: pd.Series, salts: pd.Series) -> pd.Series:
            at = np.maximum(np.searchsorted(starts, ids.to_numpy(np.int64), "right") - 1, 0)
            known = known.to_numpy(bool)
            first, n = np.where(known, number[at], 0), np.where(known, split[at], max(nulls, 1))
            return pd.Series((first + salts.to_numpy(np.int64).view(U64) % n.astype(U64).clip(1)).astype(np.int32))

        split_any = nulls > 1 or (split > 1).any()
        return find(F.coalesce(column.cast("long"), F.lit(0)), column.isNotNull(), salt if split_any else F.lit(0).cast("long"))

    def place(self, chunk: np.ndarray) -> np.ndarray:
        """The first chunk that holds rows of the ids in ``chunk``, for each of some chunks."""
        at = np.maximum(np.searchsorted(self.number, chunk, "right") - 1, 0)
        found = np.where(chunk < self.nulls, 0, chunk)
        return np.where((chunk >= self.nulls) & (self.split[at] > 1), self.number[at], found) if len(self.number) else found


def _counted(df: DataFrame, column: str, edges: np.ndarray) -> np.ndarray:
    """Rows in each range of ids [edges[i], edges[i + 1]); ids are not below the first edge."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(edges), np.int64)
        for batch in batches:
            sums += np.bincount(np.searchsorted(edges, batch.column(0).to_numpy(), "right") - 1, minlength=len(edges))
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[at], pa.int64())], names=["i", "n"])

    ids = df.select(F.col(column).cast("long").alias("id")).filter("id IS NOT NULL")
    found = ids.mapInArrow(count, "i int, n bigint").groupBy("i").agg(F.sum("n").alias("n")).toArrow()  # no more rows than edges
    out = np.zeros(len(edges), np.int64)
    out[found.column("i").to_numpy()] = found.column("n").to_numpy()
    return out


def by_range(df: DataFrame, n: int, column: str = "doc_id") -> Ranges:
    """About ``n`` chunks by ranges of an integer column, none much over the mean, whatever the ids; null comes before all values.

    Rows are counted in ``ID_RANGES`` equal ranges between the smallest and the largest
    id, and again within each range that holds over an eighth of a chunk, until none
    does or it is a single id.  An id with more rows than a chunk gets several, which
    only it has.  The counts of ranges reach the driver, a bounded number of them.
    """
    x = F.col(column).cast("long")
    low, high, known, rows = df.agg(F.min(x), F.max(x), F.count(x), F.count(F.lit(1))).first()
    mean = max(rows / max(n, 1), 1.0)
    nulls = -(-(rows - known) // math.ceil(mean))
    if not known or n <= 1:
        return Ranges(np.array([low] if known else [], np.int64), np.full(min(known, 1), nulls, np.int64), np.ones(min(known, 1), np.int64), nulls)
    edges, spans = [low], [high - low + 1]  # whole numbers of any size
    split, many = [0], 1
    while True:
        parts = max(2, min(ID_RANGES, MAX_EDGES // many))
        cut: list[tuple[int, int]] = []
        over = set(split)
        for i, (a, span) in enumerate(zip(edges, spans, strict=True)):
            m = min(parts, span) if i in over else 1
            at = [a + span * k // m for k in range(m + 1)]
            cut += [(b, c - b) for b, c in zip(at, at[1:], strict=False)]
        edges, spans = [a for a, _ in cut], [b for _, b in cut]
        counts = _counted(df, column, np.array(edges, np.int64))
        split = [i for i in np.flatnonzero(counts > max(mean / 8, 1)).tolist() if spans[i] > 1]
        many = len(split)
        if not many:
            break
        some = np.flatnonzero(counts)  # ranges without rows go to the one before
        spans = [spans[i] if counts[i] else 0 for i in range(len(edges))]
        split = np.searchsorted(some, split).tolist()
        edges, spans = [edges[i] for i in some], [spans[i] for i in some]
    starts, number, pieces, held, last = [], [], [], 0.0, nulls - 1
    for a, c in zip(edges, counts.tolist(), strict=True):
        if not c:
            continue
        own = -(-c // math.ceil(mean)) if c > mean else 1
        if not starts or own > 1 or pieces[-1] > 1 or held + c > mean:
            starts.append(a)
            number.append(last + 1)
            pieces.append(own)
            last, held = last + own, 0.0
        held += c
    return Ranges(np.array(starts, np.int64), np.array(number, np.int64), np.array(pieces, np.int64), nulls)


def by_hash(n: int, column: str = "doc_id") -> Column:
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """Hash range (of n) of each hash, in the order of the hashes."""
    return ((h >> U64(40)) * U64(n)) >> U64(24)


def pack(chunk: int, n: int, sorted_hashes: np.ndarray, *columns: np.ndarray, whole: bool = True) -> pa.Table:
    """Rows for the hash ranges: ascending hashes (unless not ``whole``: shortened) with further fixed-width columns."""
    columns = (sorted_hashes if whole else shortened(sorted_hashes), *columns)
    buckets = bucket_of(sorted_hashes, n)
    cut = np.concatenate([[0], np.flatnonzero(np.diff(buckets)) + 1, [len(buckets)]]) if len(buckets) else np.zeros(1, int)
    payload = [b"".join(np.ascontiguousarray(c[a:b]).tobytes() for c in columns) for a, b in zip(cut, cut[1:], strict=False)]
    ids = buckets[cut[:-1]].astype(np.int32) if len(buckets) else np.zeros(0, np.int32)
    return pa.table({"bucket": pa.array(ids, pa.int32()), "chunk": pa.array(np.full(len(ids), chunk), pa.int32()), "payload": pa.array(payload, pa.binary())})


def shortened(h: np.ndarray) -> np.ndarray:
    """The lower five bytes of hashes.  With the hash range they tell enough where a false match only costs work."""
    return np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)[:, :5]


def lengthened(b: np.ndarray) -> np.ndarray:
    """What ``shortened`` has left (entries of kind ``SHORT``) as numbers."""
    out = np.zeros((len(b), 8), np.uint8)
    out[:, :5] = np.ascontiguousarray(b).view(np.uint8).reshape(-1, 5)
    return out.view(U64).ravel()


SHORT = np.dtype("V5")
LOW = U64((1 << 40) - 1)


def unpack(table: pa.Table, *kinds: type) -> tuple[np.ndarray, ...]:
    """Number of the row that each entry comes from, and the entries' columns; ``kinds``: dtypes as packed."""
    width = sum(np.dtype(k).itemsize for k in kinds)
    parts: list[list[np.ndarray]] = [[] for _ in kinds]
    rows = []
    for i, x in enumerate(table.column("payload")):
        b = x.as_buffer()
        n, at = b.size // width, 0
        for k, part in zip(kinds, parts, strict=True):
            part.append(np.frombuffer(b, k, n, at))
            at += n * np.dtype(k).itemsize
        rows.append(np.full(n, i, np.int32))
    empty = [np.zeros(0, np.int32), *(np.zeros(0, k) for k in kinds)]
    return tuple(np.concatenate(p) if p else e for p, e in zip([rows, *parts], empty, strict=True))


def answers(table: pa.Table, row: np.ndarray, wanted: np.ndarray, *columns: np.ndarray) -> pa.Table:
    """For each row of ``table``, the wanted entries' columns, packed, for that row's chunk."""
    at = np.flatnonzero(wanted)
    at = at[np.argsort(row[at], kind="stable")]
    cut = np.searchsorted(row[at], np.arange(table.num_rows + 1))
    chunks = table.column("chunk").to_numpy()
    some = [i for i in range(table.num_rows) if cut[i + 1] > cut[i]]
    payload = [b"".join(np.ascontiguousarray(c[at[cut[i] : cut[i + 1]]]).tobytes() for c in columns) for i in some]
    return pa.table({"chunk": pa.array(chunks[some], pa.int32()), "payload": pa.array(payload, pa.binary())})


def deal(df: DataFrame, chunk: Column, partitions: int) -> DataFrame:
    """chunk and blob (compressed rows) of ``df``, dealt by chunk and settled, for work that goes through it several times.

    The settled rows keep their partitioning, so later steps by chunk don't move them
    again; Spark only knows it of plans that are not adaptive.
    """

    def blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))
        for batch in batches:
            table = pa.Table.from_batches([batch]).combine_chunks()
            chunks = table.column("__chunk").to_numpy()
            order = np.argsort(chunks, kind="stable")
            cut = np.concatenate([[0], np.flatnonzero(np.diff(chunks[order])) + 1, [len(order)]]) if len(order) else [0]
            out = []
            for a, b in zip(cut, cut[1:], strict=False):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema.remove(table.schema.get_field_index("__chunk")), options=options) as w:
                    w.write_table(table.take(pa.array(order[a:b])).drop_columns(["__chunk"]))
                out.append((int(chunks[order[a]]), sink.getvalue().to_pybytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=["chunk", "blob"])

    conf = df.sparkSession.conf
    adaptive = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return settled(df.withColumn("__chunk", chunk).mapInArrow(blobs, "chunk int, blob binary").repartition(partitions, "chunk"))
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)


def dealt_rows(table: pa.Table) -> Iterator[pa.Table]:
    """The rows in a chunk's blobs, blob by blob."""
    for x in table.column("blob"):
        yield pa.ipc.open_stream(x.as_buffer()).read_all()


_CODEC = pa.Codec("zstd", 1)


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes, with their sizes."""
    raw = b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return np.array([len(raw), *map(len, arrays)], np.int64).tobytes() + _CODEC.compress(raw, asbytes=True)


def stretch(payload: pa.Scalar | bytes, *kinds: object) -> list[np.ndarray]:
    """The arrays of ``squeeze``; ``kinds``: their dtypes."""
    b = payload.as_buffer() if isinstance(payload, pa.Scalar) else pa.py_buffer(payload)
    head = np.frombuffer(b, np.int64, len(kinds) + 1)
    raw = _CODEC.decompress(b.slice(head.nbytes), int(head[0]))
    out, at = [], 0
    for k, n in zip(kinds, head[1:], strict=True):
        out.append(np.frombuffer(raw, k, n, at))
        at += int(n) * np.dtype(k).itemsize
    return out


def with_answers(dealt: DataFrame, answer: DataFrame | None, f: Callable[..., pa.Table], schema: str, *args: object) -> DataFrame:
    """``f(key, table, answers, *args)`` for each chunk's rows and the answers to it; no answers (None) if there are none to come."""
    if answer is None:
        return dealt.groupBy("chunk").applyInArrow(lambda key, table: f(key, table, None, *args), schema)
    return dealt.groupBy("chunk").cogroup(answer.groupBy("chunk")).applyInArrow(lambda key, table, found: f(key, table, found, *args), schema)
