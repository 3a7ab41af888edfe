"""Substring search that opens only files that can hold the query.

The signature of a file is the exact set of byte trigrams of its texts, A-Z folded, as
bitmaps of 32,768 codes each; a file of 128 MB has at most 512 of them, 2 MB in all.  A
query is cut at its wildcards into literal runs, and a file that lacks a trigram of a
run cannot hold a match.  Files are known by path, size and time of change, so one
written after the signatures, or again, is always searched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.functions import scalar as S

BITS = 32_768  # of a bitmap, as bitmap_construct_agg makes them
BLOCK = 8 << 20  # bytes of text whose trigrams a task holds at once

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def codes(data: np.ndarray, inside: np.ndarray | None = None) -> np.ndarray:
    """Different folded trigrams of some bytes as numbers; ``inside`` marks starts that do not reach into the next text."""
    if len(data) < 3:
        return np.zeros(0, np.int32)
    b = _FOLD[data].astype(np.int32)
    found = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
    return np.unique(found if inside is None else found[inside])


def _of_texts(texts: pa.Array) -> Iterator[np.ndarray]:
    """Trigram codes of texts, block by block; a text longer than a block goes through overlapping ones."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or ends[-1] == ends[0]:
        return
    data = np.frombuffer(texts.buffers()[2], np.uint8)
    for a in range(int(ends[0]), int(ends[-1]), BLOCK):
        block = data[a : min(a + BLOCK + 2, int(ends[-1]))]
        inside = np.ones(max(len(block) - 2, 0), bool)
        cuts = ends[np.searchsorted(ends, a, "right") : np.searchsorted(ends, a + len(block))] - a
        for back in (1, 2):
            at = cuts - back
            inside[at[(at >= 0) & (at < len(inside))]] = False
        yield codes(block, inside)


def file_key() -> Column:
    """Path, size and time of change of the file that a row is read from."""
    return F.concat_ws("|", F.col("_metadata.file_path"), F.col("_metadata.file_size").cast("string"), F.col("_metadata.file_modification_time").cast("string"))


def signatures(rows: DataFrame, columns: tuple[str, ...] = ("summary", "content")) -> DataFrame:
    """Bitmaps of the trigrams of text columns: file, bucket, bits; a row without bits (bucket -1) for each file.

    ``rows`` is a table read from files.  A task sends each trigram of a file once a
    batch, so what is shuffled follows the number of different trigrams, not of bytes.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = batch.column("file").dictionary_encode()
            for i, file in enumerate(files.dictionary.to_pylist()):
                mine = batch.filter(pa.compute.equal(files.indices, i)) if len(files.dictionary) > 1 else batch
                found = [c for name in columns for c in _of_texts(mine.column(name))]
                some = np.concatenate([np.array([-1], np.int32), *map(np.unique, [np.concatenate(found)] if found else [])])
                yield pa.RecordBatch.from_pydict({"file": pa.array([file] * len(some), pa.string()), "code": pa.array(some, pa.int32())})

    each = rows.select(file_key().alias("file"), *columns).mapInArrow(find, "file string, code int")
    bucket = F.when(F.col("code") < 0, -1).otherwise(F.shiftright("code", 15)).alias("bucket")
    return each.groupBy("file", bucket).agg(F.bitmap_construct_agg(F.when(F.col("code") >= 0, F.col("code") % BITS).otherwise(F.lit(0)).cast("long")).alias("bits"))


def runs(query: str) -> list[str]:
    """Literal runs of a query: what stands between its wildcards % and _."""
    return [r for r in re.split("[%_]", query) if r]


def absent(found: DataFrame, query: str) -> DataFrame:
    """Keys of files in ``signatures`` that cannot hold the query: a run's trigram is missing.

    Queries whose runs are under three bytes exclude no file.
    """
    needed = np.unique(np.concatenate([np.zeros(0, np.int32), *(codes(np.frombuffer(r.encode(), np.uint8)) for r in runs(query))]))
    files = found.select("file").where("bucket = -1")
    if not len(needed):
        return files.limit(0)
    holds = F.lit(0)
    for bucket in np.unique(needed >> 15):
        bits = [F.shiftright(F.conv(F.hex(F.substring("bits", int(p) // 8 + 1, 1)), 16, 10).cast("int"), int(p) % 8).bitwiseAND(1) for p in needed[needed >> 15 == bucket] % BITS]
        holds = F.when(F.col("bucket") == int(bucket), sum(bits[1:], bits[0])).otherwise(holds)
    buckets = [int(b) for b in np.unique(needed >> 15)]
    counts = found.where(F.col("bucket").isin([-1, *buckets])).groupBy("file").agg(F.sum(F.when(F.col("bucket") >= 0, holds)).alias("n"))
    return counts.where(F.coalesce("n", F.lit(0)) < len(needed)).select("file")


def search(rows: DataFrame, found: DataFrame, query: str, columns: tuple[str, ...] = ("summary", "content")) -> DataFrame:
    """The rows of a table read from files in which a column contains the query, as ``LIKE '%query%'`` with A-Z folded.

    Names of files go into a filter on the files' metadata, by which Spark leaves them
    out when it plans the scan; the driver holds the list of a table's files anyway.
    Null texts hold nothing; a blank query finds nothing.
    """
    if not query.strip():
        return rows.limit(0)
    out = [r[0] for r in absent(found, query).toLocalIterator()]
    hit = S.contains_like(F.col(columns[0]), query)
    for name in columns[1:]:
        hit |= S.contains_like(F.col(name), query)
    return (rows.where(~file_key().isin(out)) if out else rows).where(hit)
