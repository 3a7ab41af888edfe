"""A Merkle manifest of a table: one tree of row digests for each language, one over their roots.

Leaves get their place by a distributed sort.  A block holds ``fanout**k``
consecutive leaves, so whole subtrees lie within it: one task turns its digests into a
matrix of 64 hex bytes a row, reshapes it by the fanout and hashes the rows, level by
level.  The blocks' digests are the leaves of the next round, until each tree has one
node; the languages' subroots are a tree in the same way.  A node's siblings are found
by index arithmetic, in its block and in those above, and joined to its proof.

Digests are lower-case hex SHA-256 of their inputs, one after another, digests as hex text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.functions.tables import numbered, settled, small

#: Nodes of a block, at most; a block is the largest power of the fanout within.
BLOCK = 4096
FANOUT = 2
#: Bytes of a hex digest.
HEX = 64
#: Blocks up to which their paths (a few KB each) are broadcast.
MAX_PATHS = 10_000
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def field(column: Column) -> Column:
    """``-`` for null, else the value's UTF-8 bytes, their number first."""
    text = column.cast("string")
    return F.when(column.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(columns: Sequence[Column]) -> Column:
    """Digest of a row's columns."""
    return F.sha2(F.concat(*map(field, columns)), 256)


def height(n: int, fanout: int = FANOUT) -> int:
    """Levels above ``n`` nodes."""
    up = 0
    while n > 1:
        n, up = -(-n // fanout), up + 1
    return up


def block_height(fanout: int, most: int = BLOCK) -> int:
    """Levels of a whole block of at most ``most`` nodes."""
    k = 1
    while fanout ** (k + 1) <= most:
        k += 1
    return k


def _hashed(rows: np.ndarray) -> np.ndarray:
    """Hex digests of the rows of a byte matrix, as a matrix."""
    return np.frombuffer("".join([sha256(r).hexdigest() for r in rows]).encode(), np.uint8).reshape(-1, HEX)


def levels(nodes: np.ndarray, fanout: int, up: int) -> list[np.ndarray]:
    """The nodes (hex digests, one a row) and the ``up`` levels above them; runs of ``fanout`` nodes become one."""
    out = [np.ascontiguousarray(nodes)]
    for _ in range(up):
        last = out[-1]
        whole = len(last) // fanout
        parts = [_hashed(last[: whole * fanout].reshape(whole, fanout * HEX))] if whole else []
        if len(last) % fanout:
            parts.append(_hashed(last[whole * fanout :].reshape(1, -1)))
        out.append(np.concatenate(parts))
    return out


def siblings(tree: list[np.ndarray], fanout: int) -> list[bytes]:
    """For each node of the lowest level its siblings' digests, level by level, left to right."""
    n = len(tree[0])
    place = np.arange(n)
    others = np.arange(fanout - 1)
    paths = np.zeros((n, (len(tree) - 1) * (fanout - 1), HEX), np.uint8)
    there = np.zeros(paths.shape[:2], bool)
    for k, level in enumerate(tree[:-1]):
        own = place % fanout
        at = (place - own)[:, None] + others + (others >= own[:, None])  # the run's other nodes
        has = at < len(level)
        to = slice(k * (fanout - 1), (k + 1) * (fanout - 1))
        paths[:, to] = level[np.where(has, at, 0)]
        there[:, to] = has
        place = place // fanout
    whole = there.all(axis=1)
    return [p.tobytes() if w else p[t].tobytes() for p, t, w in zip(paths, there, whole, strict=True)]


def fold(leaf: str, proof: bytes, trees: Sequence[tuple[int, int]], fanout: int = FANOUT) -> str:
    """The root that a leaf and its siblings lead to; ``trees``: place and number of nodes in each tree on the way."""
    digest, at = leaf.encode(), 0
    for place, n in trees:
        while n > 1:
            own = place % fanout
            more = min(fanout, n - place + own) - 1
            left, end = at + own * HEX, at + more * HEX
            digest = sha256(proof[at:left] + digest + proof[left:end]).hexdigest().encode()
            place, n, at = place // fanout, -(-n // fanout), end
    return digest.decode()


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Hex digests of an Arrow column as a matrix over its bytes."""
    texts = column.combine_chunks()
    texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
    _, offsets, data = texts.buffers()
    width = 8 if pa.types.is_large_string(texts.type) else 4
    first = int(np.frombuffer(offsets, np.int64 if width == 8 else np.int32, 1, texts.offset * width)[0]) if len(texts) else 0
    return np.frombuffer(data, np.uint8, len(texts) * HEX, first).reshape(-1, HEX) if len(texts) else np.zeros((0, HEX), np.uint8)


def _climb(nodes: DataFrame, kind: str, fanout: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Root of each tree (tree, digest) and path to it of each node (tree, position, path); ``nodes``: tree, position, total, digest."""
    up = block_height(fanout, most)
    size = fanout**up

    def block(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("position")
        total = table.column("total")[0].as_py()
        tree = levels(_matrix(table.column("digest")), fanout, min(up, height(total, fanout)))
        return pa.table(
            {
                "tree": table.column("tree").slice(0, 1).combine_chunks(),
                "position": pa.array([key[1].as_py()], pa.int64()),
                "total": pa.array([-(-total // size)], pa.int64()),
                "digest": pa.array([tree[-1][0].tobytes().decode()]),
                "paths": pa.array([siblings(tree, fanout)], pa.list_(pa.binary())),
            }
        )

    steps = []
    while True:
        rows = nodes.groupBy("tree", F.floor(F.col("position") / size).alias("block"))
        nodes = settled(rows.applyInArrow(block, f"tree {kind}, position bigint, total bigint, digest string, paths array<binary>"))
        steps.append(nodes)
        if (nodes.agg(F.max("total")).first()[0] or 0) <= 1:
            break
        nodes = nodes.drop("paths")
    paths = None
    for step in reversed(steps):
        own = step.select("tree", F.col("position").alias("block"), F.posexplode("paths").alias("i", "path")).withColumn("position", F.col("block") * size + F.col("i"))
        if paths is not None:
            above = paths.select(F.col("tree").alias("tree_"), F.col("position").alias("block_"), F.col("path").alias("rest"))
            own = own.join(above, F.col("tree").eqNullSafe(F.col("tree_")) & (F.col("block") == F.col("block_"))).withColumn("path", F.concat("path", "rest"))
        paths = own.select("tree", "position", "path")
    return steps[-1].select("tree", "digest"), paths


def manifest(rows: DataFrame, order: Sequence[str], by: str = "lang", fanout: int = FANOUT, most: int = BLOCK) -> DataFrame:
    """Proof of each row: its place in the tree of its ``by``, that tree's root and the root over all.

    Needs ``leaf`` (hex digest) and the columns named; all columns of ``rows`` are kept,
    so give it small ones.  Leaves of a tree stand in ``order`` (null first), equal ones
    by their leaf; trees in the order of ``by`` (null first, bytewise).  A null ``by`` is
    a tree of its own, a single leaf is its tree's root, a single tree's root is the
    root.  Repeated rows are leaves as often as they occur.  No rows give no rows.
    A block has ``most`` nodes at most.

    Adds position and total (in the tree), place and trees (of the tree among all),
    subroot, root and proof (siblings' hex digests, from the leaf to the root).
    """
    kind = rows.schema[by].dataType.simpleString()
    up = block_height(fanout, most)
    size = fanout**up
    kept = rows.columns
    found = numbered(settled(rows), [*(F.col(c).asc_nulls_first() for c in order), F.col("leaf").asc()], by, most=0)
    schema = found.schema

    def block(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("position").combine_chunks()
        total = table.column("total")[0].as_py()
        tree = levels(_matrix(table.column("leaf")), fanout, min(up, height(total, fanout)))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 1))) as w:
            w.write_table(table)
        return pa.table(
            {
                "tree": table.column(by).slice(0, 1).combine_chunks(),
                "position": pa.array([key[1].as_py()], pa.int64()),
                "total": pa.array([-(-total // size)], pa.int64()),
                "digest": pa.array([tree[-1][0].tobytes().decode()]),
                "blob": pa.array([sink.getvalue().to_pybytes()], pa.binary()),
            }
        )

    blocks = found.groupBy(by, F.floor(F.col("position") / size).alias("block__")).applyInArrow(block, f"tree {kind}, position bigint, total bigint, digest string, blob binary")
    blocks = settled(blocks)
    roots, paths = _climb(blocks.drop("blob"), kind, fanout, most)
    trees = numbered(settled(roots.withColumnRenamed("digest", "subroot")), [F.col("tree").asc_nulls_first()], most=0)
    trees = settled(trees)
    root, places = _climb(trees.select(F.lit("all").alias("tree"), "position", "total", F.col("subroot").alias("digest")), "string", fanout, most)
    top = trees.select(F.col("tree").alias("tree_"), "subroot", F.col("position").alias("place"), F.col("total").alias("trees"))
    top = top.join(places.select(F.col("position").alias("place"), F.col("path").alias("last")), "place").crossJoin(F.broadcast(root.select(F.col("digest").alias("root"))))  # one row
    way = paths.join(small(settled(top), MAX_PATHS), F.col("tree").eqNullSafe(F.col("tree_")))
    way = small(settled(way.select(F.col("tree").alias("of"), F.col("position").alias("nr"), F.concat("path", "last").alias("rest"), "subroot", "place", "trees", "root")), MAX_PATHS)
    joined = blocks.join(way, F.col("tree").eqNullSafe(F.col("of")) & (F.col("position") == F.col("nr"))).select("blob", "rest", "subroot", "place", "trees", "root")
    added = [("subroot", pa.string()), ("place", pa.int64()), ("trees", pa.int64()), ("root", pa.string())]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                table = pa.ipc.open_stream(batch.column("blob")[r].as_buffer()).read_all().combine_chunks()
                total, rest = table.column("total")[0].as_py(), batch.column("rest")[r].as_py()
                tree = levels(_matrix(table.column("leaf")), fanout, min(up, height(total, fanout)))
                for name, t in added:
                    table = table.append_column(name, pa.array([batch.column(name)[r].as_py()] * table.num_rows, t))
                yield from table.append_column("proof", pa.array([p + rest for p in siblings(tree, fanout)], pa.binary())).to_batches()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    out = joined.mapInArrow(unpack, f"{fields}, subroot string, place bigint, trees bigint, root string, proof binary")
    return out.select(*kept, "position", "total", "place", "trees", "subroot", "root", "proof")


def folded(proofs: DataFrame, leaf: str = "leaf", name: str = "folded_root", fanout: int = FANOUT) -> DataFrame:
    """``proofs`` (as from ``manifest``) with the root that the column ``leaf`` leads to."""

    @F.udf("string", useArrow=True)
    def root_of(leaf: str, proof: bytes, position: int, total: int, place: int, trees: int) -> str:
        return fold(leaf, proof, ((position, total), (place, trees)), fanout)

    return proofs.withColumn(name, root_of(leaf, "proof", "position", "total", "place", "trees"))


def tampered_leaf(docs: DataFrame) -> Column:
    """The leaf with n_chars one higher, for rows whose crc32(doc_id) 7 divides; null for all others.  A null n_chars stays null."""
    more = [(F.col(c).cast("decimal(20,0)") + 1).cast("decimal(20,0)") if c == "n_chars" else F.col(c) for c in COLUMNS]
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, leaf(more))


def checked(docs: DataFrame) -> DataFrame:
    """The manifest of ``documents`` and the check of each row's proof after rows were tampered with.

    Needs doc_id, source, lang, n_chars and text; others are ignored.  Any of them may
    be null; a row with a null doc_id is not tampered with.

    Returns doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.
    """
    rows = docs.select("doc_id", "lang", leaf([F.col(c) for c in COLUMNS]).alias("leaf"), tampered_leaf(docs).alias("other"))
    proofs = manifest(rows, ["doc_id"]).withColumn("shown", F.coalesce("other", "leaf"))
    found = folded(proofs, "shown")
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
