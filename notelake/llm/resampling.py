"""Importance resampling towards a target distribution, by hashed word features.

Texts are handled as Arrow's UTF-8 bytes, many at once: a table classifies each byte,
differences of neighbours find where words begin and end, and one table-driven CRC-32
runs over all words together, a byte of each at a step.  Two counts of buckets, of the
documents and of the target texts, give each bucket a gain; a document's weight is the
sum over its features, and noise drawn from its id makes the highest scores a sample.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.functions.tables import numbered, settled
from notelake.llm.exchange import bounded
from notelake.llm.text import Texts, lower_ascii, text_blocks

#: Buckets of features.
BUCKETS = 10_000
#: Words of a feature, at most.
MOST_WORDS = 1
#: Words of a text that can be drawn, at least.
MIN_WORDS = 20
#: Drawn share of these, in percent.
PERCENT = 10
SEED = "2024"
#: Words of more bytes get their CRC one by one, as the joint steps are as many as the longest word's bytes.
LONG = 256
_FULL = np.uint32(0xFFFFFFFF)


def crc_table() -> np.ndarray:
    """CRC-32 (reflected polynomial EDB88320) of each byte."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, np.uint32(0xEDB88320) ^ (t >> 1), t >> 1)
    return t


_CRC = crc_table()
#: Bytes of words, after lower-casing: digits, small letters and all beyond ASCII.
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


def words(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and start, end and text number of each word."""
    data = lower_ascii(t.data)
    kind = np.zeros(len(data) + len(t) + 1, np.int8)  # one byte that is no word's before each text and after the last
    shift = np.repeat(np.arange(1, len(t) + 1), np.diff(t.offsets))
    kind[np.arange(len(data)) + shift] = _WORD[data]
    edge = np.diff(kind)
    start, end = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    row = np.searchsorted(t.offsets[:-1] + np.arange(1, len(t) + 1), start, "right") - 1
    return data, start - row - 1, end - row - 1, row


def advance(state: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC states after the bytes [start, end) of each, a byte of all at each step."""
    size = end - start
    order = np.argsort(-size, kind="stable")
    out, at, size = state[order], start[order], size[order]
    first = int(np.searchsorted(-size, -LONG, "left"))
    for i in range(first):
        rest = zlib.crc32(data[at[i] : at[i] + size[i]], int(out[i] ^ _FULL))
        out[i] = np.uint32(rest) ^ _FULL
    out_, at_ = out[first:], at[first:]
    longest = int(size[first]) if first < len(size) else 0
    left = len(out_) - np.searchsorted(size[first:][::-1], np.arange(1, longest + 1), "left") if longest else []
    for k, n in enumerate(left):  # the first n words have more than k bytes
        s = out_[:n]
        out_[:n] = _CRC[(s ^ data[at_[:n] + k]) & 0xFF] ^ (s >> np.uint32(8))
    back = np.empty_like(out)
    back[order] = out
    return back


def features(t: Texts, most_words: int = MOST_WORDS, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text number of each run of 1 to ``most_words`` words, and the words of each text."""
    data, start, end, row = words(t)
    state, out, rows = np.full(len(start), _FULL), [], []
    for j in range(most_words):
        n = len(start) - j
        if n <= 0:
            break
        inside = np.flatnonzero(row[:n] == row[j:])
        s = state[inside]
        if j:
            s = _CRC[(s ^ np.uint32(0x20)) & 0xFF] ^ (s >> np.uint32(8))
        s = advance(s, data, start[inside + j], end[inside + j])
        state[inside] = s
        out.append((s ^ _FULL) % np.uint32(buckets))
        rows.append(row[inside])
    none = np.zeros(0, np.int64)
    return np.concatenate(out or [none]).astype(np.int64), np.concatenate(rows or [none]), np.bincount(row, minlength=len(t))


def bucket_counts(df: DataFrame, most_words: int = MOST_WORDS, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall in each bucket.  A task sends its counts once, at most one row a bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for t in text_blocks(batch.column("text")):
                sums += np.bincount(features(t, most_words, buckets)[0], minlength=buckets)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums[at], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in bounded(df).select("text").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most one row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the target's share over the source's), shares with one more feature in each bucket."""
    n, s, t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(b) + 1) * (s + n) / ((float(a) + 1) * (t + n)))) for a, b in zip(source, target, strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, most_words: int = MOST_WORDS) -> DataFrame:
    """doc_id, n_words, n_features and weight (sum of the features' gains) of each text."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for t in text_blocks(batch.column("text")):
                bucket, row, n = features(t, most_words, len(gain))
                parts.append((n, np.bincount(row, minlength=len(t)), _sums(gain[bucket], row, len(t))))
            if parts:
                n_words, n_features, weight = (pa.array(np.concatenate(x).astype(np.int64), pa.int64()) for x in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n_words, n_features, weight], names=["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return bounded(docs).select("doc_id", "text").mapInArrow(weigh, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")


def _sums(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Whole-number sums by row."""
    out = np.zeros(n, np.int64)
    np.add.at(out, row, values)
    return out


def noise(seed: str = SEED) -> Column:
    """floor(1000 * standard Gumbel noise) from the first 32 bits of SHA-256 of seed and doc_id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, most_words: int = MOST_WORDS, buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """Draws ``percent`` of the texts with at least ``min_words`` words, towards the distribution of ``target``'s texts.

    Needs doc_id (integer) and text of ``docs``, text of ``target``; others are ignored,
    whatever their names.  A null or empty text has no features and weight 0.  A null
    doc_id counts as the empty text in the noise and comes before all others in ties;
    repeated rows are drawn one by one.  An empty target leaves one feature a bucket; no
    documents give no rows.  Scores are ranked by a distributed sort.

    Returns doc_id, n_features, weight, score, rank (from 1; null if not drawn).
    """
    gain = gains(bucket_counts(docs, most_words, buckets), bucket_counts(target, most_words, buckets))
    scored = weighed(docs, gain, most_words)
    scored = settled(scored.select("doc_id", "n_features", "weight", (F.col("weight") + noise(seed)).alias("score"), (F.col("n_words") >= min_words).alias("enough")))
    drawn = scored.filter("enough").count() * percent // 100
    placed = numbered(scored, [F.col("enough").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_first()], most=0)
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("position") < drawn, F.col("position") + 1).alias("rank"))
