"""Substring deduplication over words, by level-wise doubling.

Windows of n words that also start in a document with a smaller id are cut out.  The
search starts with windows of half the length (rounded up) and goes on with twice the
length, at most n, for those windows alone that hold a repeated one, until n is
reached or no candidates survive.

A longer window is represented at the level below by the window in it with the
smallest hash.  Equal windows have equal representatives, so nothing is lost, and a
level exchanges few of them, by five bytes, as a false match only costs work.  The last
level compares 96 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.functions.tables import small
from notelake.llm import exchange as X
from notelake.llm.text import covered, mix, text_blocks, window_hash, window_ok, word_hash, words

U64 = np.uint64
#: Words of the shortest windows compared, at most.
BASE = 4
#: Words of a window.
WINDOW = 13


def levels(n: int, base: int = BASE) -> list[int]:
    """Window lengths from at most ``base`` words to n, each at most twice the one before."""
    out = [n]
    while out[0] > max(base, 1):
        out.insert(0, -(-out[0] // 2))
    return out


def _doc_numbers(table: pa.Table) -> np.ndarray:
    """Rank of each row's doc_id in the chunk; null is the smallest, equal ids are one document."""
    ids = table.column("doc_id")
    number = np.unique(ids.fill_null(0).to_numpy(), return_inverse=True)[1].astype(np.int64) + 1
    number[ids.is_null().to_numpy()] = 0
    return number


def _word_blocks(table: pa.Table, number: np.ndarray) -> Iterator[tuple]:
    """Texts, word starts and ends, row in the block, document number and word hash, block by block."""
    for t in text_blocks(table.column("text")):
        start, end, row = words(t)
        yield t, start, end, row, number[t.first + row], word_hash(t.data, start, end)


def _smallest(h: np.ndarray, short: int, long: int) -> np.ndarray:
    """For each window of ``long`` words, the ``short``-word window in it with the smallest hash, as a hash with the lowest bit 0."""
    w = window_hash(h, short)
    steps = long - short + 1
    out, have = w, 1
    while have < steps:  # minima of twice as many windows each time
        by = min(have, steps - have)
        out = np.minimum(out[:-by], out[by:]) if len(out) > by else out[:0]
        have += by
    return mix(out) & ~U64(1)  # smallest hashes are small; this spreads them over all hash ranges


def _found(answer: pa.Table, whole: bool = False) -> np.ndarray:
    """What a chunk was told at a level, in order."""
    return np.unique(X.unpack(answer, U64)[1] if whole else X.lengthened(X.unpack(answer, X.SHORT)[1]))


def _member(h: np.ndarray, found: np.ndarray, whole: bool = False) -> np.ndarray:
    """Which hashes are among those found, by their lower bytes or as a whole."""
    if not len(found):
        return np.zeros(len(h), bool)
    h = h if whole else h & X.LOW
    return found[np.minimum(np.searchsorted(found, h), len(found) - 1)] == h


def _entries(hashes: list[np.ndarray], docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order, and whether each stands in two documents of the chunk or more."""
    h, d = np.concatenate(hashes or [np.zeros(0, U64)]), np.concatenate(docs or [np.zeros(0, np.int64)])
    order = np.argsort(h)
    h, d = h[order], d[order]
    if not len(h):
        return h, np.zeros(0, bool)
    at = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1])
    return h[at], np.minimum.reduceat(d, at) != np.maximum.reduceat(d, at)


def _answer_level(table: pa.Table, whole: bool = False) -> pa.Table:
    """Each chunk's hashes that stand in two documents or more; the lowest bit of an entry says so for its own chunk."""
    row, entries = X.unpack(table, U64 if whole else X.SHORT)
    h = entries if whole else X.lengthened(entries)
    many, h = (h & U64(1)).astype(bool), h & ~U64(1)
    order = np.argsort(h)
    s = h[order]
    same = s[1:] == s[:-1]
    hot = many[order].copy()
    hot[1:] |= same
    hot[:-1] |= same
    wanted = np.zeros(len(h), bool)
    wanted[order] = hot
    return X.answers(table, row, wanted, h if whole else X.shortened(h))


def _answer_last(table: pa.Table, ids: X.Ranges) -> pa.Table:
    """Each chunk's hashes that an earlier chunk has too, of other ids."""
    row, h, g = X.unpack(table, U64, np.uint32)
    place = ids.place(table.column("chunk").to_numpy().astype(np.int64))[row] if len(row) else row
    order = np.lexsort((place, g, h))
    h_, g_, place = h[order], g[order], place[order]
    new = np.concatenate([[True], (h_[1:] != h_[:-1]) | (g_[1:] != g_[:-1])]) if len(h) else np.zeros(0, bool)
    wanted = np.zeros(len(h), bool)
    wanted[order] = place > place[np.flatnonzero(new)][np.cumsum(new) - 1]
    return X.answers(table, row, wanted, h, g)


def _second(h: np.ndarray, n: int) -> np.ndarray:
    return (window_hash(h, n, seed=1) >> U64(32)).astype(np.uint32)


def cut_repeats(docs: DataFrame, n: int = WINDOW, base: int = BASE, chunk_bytes: int | None = None) -> DataFrame:
    """Each document's text without the words that lie in a window known from a document with a smaller id.

    Needs doc_id (integer) and text; others are ignored, whatever their names.  A null
    or empty text has no words.  Rows with one id are one document, so they don't take
    words from each other; a null id comes before all others.  An empty table gives an
    empty result.  Ids may be any 64-bit numbers, however they lie; rows of one id that are
    more than a chunk are dealt by their text.

    Returns doc_id, text (kept words joined by one blank), n_words, n_removed, removed
    (array of first word and number of words of each run removed).
    """
    plain = X.bounded(docs).select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    parts, ranges = X.chunk_count(plain, chunk_bytes)
    of = X.by_range(plain, parts)
    dealt = plain.select(of.chunk(F.col("doc_id"), F.xxhash64("text")).alias("chunk"), "doc_id", "text")
    steps = levels(n, base)
    known: DataFrame | None = None
    for short, long in zip(steps, steps[1:], strict=False):

        def send(key: tuple, table: pa.Table, answer: pa.Table | None, short: int, long: int, before: int) -> pa.Table:
            found = None if answer is None else _found(answer)
            hashes, ids = [], []
            for _, _, _, row, doc, h in _word_blocks(table, _doc_numbers(table)):
                if len(h) < long:
                    continue
                m, ok = _smallest(h, short, long), window_ok(row, long)
                if found is not None:
                    ok &= _member(_smallest(h, before, long), found)
                m, d = m[ok], doc[: len(ok)][ok]
                if len(m):
                    first = np.concatenate([[True], (m[1:] != m[:-1]) | (d[1:] != d[:-1])])
                    hashes.append(m[first])
                    ids.append(d[first])
            h, many = _entries(hashes, ids)
            return X.pack(key[0].as_py(), ranges, h | many.astype(U64), whole=False)

        sent = X.with_answers(dealt, known, send, X.PACKED, short, long, steps[steps.index(short) - 1] if known is not None else 0)
        known = sent.groupBy("bucket").applyInArrow(lambda key, table: _answer_level(table), X.ANSWER)

    def send_last(key: tuple, table: pa.Table, found: pa.Table | None) -> pa.Table:
        some = _found(found) if found is not None else None
        hs, gs = [], []
        for _, _, _, row, _, h in _word_blocks(table, _doc_numbers(table)):
            if len(h) < n:
                continue
            ok = window_ok(row, n)
            if some is not None:
                ok &= _member(_smallest(h, steps[-2], n), some)
            at = np.flatnonzero(ok)
            if len(at):
                hs.append(window_hash(h, n)[at])
                gs.append(_second(h, n)[at])
        h, g = np.concatenate(hs or [np.zeros(0, U64)]), np.concatenate(gs or [np.zeros(0, np.uint32)])
        order = np.lexsort((g, h))
        h, g = h[order], g[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])]) if len(h) else np.zeros(0, bool)
        return X.pack(key[0].as_py(), ranges, h[new], g[new])

    sent = X.with_answers(dealt, known, send_last, X.PACKED)
    earlier = sent.groupBy("bucket").applyInArrow(lambda key, table: _answer_last(table, of), X.ANSWER)

    def cut(key: tuple, table: pa.Table, found: pa.Table) -> pa.Table:
        _, known_h, known_g = X.unpack(found, U64, np.uint32)
        order = np.argsort(known_h)
        known_h, known_g = known_h[order], known_g[order]
        number = _doc_numbers(table)
        blocks = list(_word_blocks(table, number))
        at, hs, gs, ds = [], [], [], []
        for _, _, _, row, doc, h in blocks:
            p = np.flatnonzero(window_ok(row, n))
            at.append(p)
            hs.append(window_hash(h, n)[p])
            gs.append(_second(h, n)[p] if len(h) >= n else np.zeros(0, np.uint32))
            ds.append(doc[p])
        h, g, d = (np.concatenate(x) if x else np.zeros(0, int) for x in (hs, gs, ds))
        gone = np.zeros(len(h), bool)
        if len(h):
            if len(known_h):
                i = np.minimum(np.searchsorted(known_h, h), len(known_h) - 1)
                gone = (known_h[i] == h) & (known_g[i] == g)
            order = np.lexsort((d, g, h))
            new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])])
            lowest = d[order][np.flatnonzero(new)][np.cumsum(new) - 1]
            gone[order] |= lowest < d[order]
        out, lo = [], 0
        for (t, start, end, row, _, _), p in zip(blocks, at, strict=True):
            mask = covered(len(start), p[gone[lo : lo + len(p)]], n)
            lo += len(p)
            out.append(_without(t, start, end, row, mask))
        flat = pa.concat_tables(out) if out else _NO_TEXT
        return flat.append_column("doc_id", table.column("doc_id")).select(["doc_id", "text", "n_words", "n_removed", "removed"])

    schema = f"doc_id {kind}, text string, n_words bigint, n_removed bigint, removed array<struct<start: bigint, length: bigint>>"
    return X.with_answers(dealt, earlier, cut, schema)


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64())])
_NO_TEXT = pa.table({"text": pa.array([], pa.string()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "removed": pa.array([], pa.list_(_RUN))})


def _without(t, start: np.ndarray, end: np.ndarray, row: np.ndarray, gone: np.ndarray) -> pa.Table:
    """Kept words of each text joined by a blank, counts and removed runs."""
    n = np.bincount(row, minlength=len(t))
    keep = np.flatnonzero(~gone)
    size = end[keep] - start[keep] + 1
    stop = np.cumsum(size)
    total = int(stop[-1]) if len(keep) else 0
    source = np.repeat(start[keep] - (stop - size), size) + np.arange(total)
    raw = t.data[np.minimum(source, len(t.data) - 1)] if total else np.zeros(0, np.uint8)
    raw[stop - 1] = 32
    kept = np.bincount(row[keep], minlength=len(t))
    ends = np.concatenate([[0], stop])[np.cumsum(kept)]
    last = np.ones(total, bool)
    last[ends[kept > 0] - 1] = False  # the blank after the last word
    raw = raw[last]
    offsets = np.concatenate([[0], ends - np.cumsum(kept > 0)]).astype(np.int64)
    text = pa.LargeStringArray.from_buffers(len(t), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))).cast(pa.string())
    edge = np.concatenate([[0], gone.astype(np.int8), [0]])
    begin = np.flatnonzero((edge[1:] == 1) & ((edge[:-1] == 0) | np.concatenate([[True], row[1:] != row[:-1], [True]])))
    over = np.flatnonzero((edge[:-1] == 1) & ((edge[1:] == 0) | np.concatenate([[True], row[1:] != row[:-1], [True]])))
    first_word = np.concatenate([[0], np.cumsum(n)])[:-1]
    runs = pa.StructArray.from_arrays([pa.array(begin - first_word[row[begin]]), pa.array(over - begin)], fields=list(_RUN))
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[begin], np.arange(len(t) + 1)), pa.int32()), runs)
    return pa.table({"text": text, "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(np.bincount(row[gone], minlength=len(t)), pa.int64()), "removed": lists})


def longest_repeats(docs: DataFrame, n: int = WINDOW, chunk_bytes: int | None = None) -> DataFrame:
    """For each document the longest of n, 2 n, 4 n, ... words at which it shares a window with another document (0: none).

    Only windows whose two halves are repeated go on to the next length; the search ends
    when no candidates survive.  A match is told by 63 bits, as it is the result.  What a
    step has exchanged goes before the next one.  Inputs and odd cases are as for ``cut_repeats``.

    Returns doc_id, words.
    """
    plain = X.bounded(docs).select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    parts, ranges = X.chunk_count(plain, chunk_bytes)
    dealt = plain.select(X.by_hash(parts).alias("chunk"), "doc_id", "text")

    def hashes(h: np.ndarray, row: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        return window_hash(h, length) & ~U64(1), window_ok(row, length)

    def alive(h: np.ndarray, row: np.ndarray, length: int, found: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows, and which of them have two repeated halves."""
        w, ok = hashes(h, row, length)
        if found is not None and len(w):
            half = length // 2
            m = _member(hashes(h, row, half)[0], found, True)
            ok = ok & m[: len(w)] & m[half : half + len(w)]
        return w, ok

    def send(key: tuple, table: pa.Table, answer: pa.Table | None, length: int) -> pa.Table:
        found = None if answer is None else _found(answer, True)
        hs, ds = [], []
        for _, _, _, row, doc, h in _word_blocks(table, _doc_numbers(table)):
            w, ok = alive(h, row, length, found)
            hs.append(w[ok])
            ds.append(doc[: len(w)][ok])
        h, many = _entries(hs, ds)
        return X.pack(key[0].as_py(), ranges, h | many.astype(U64))

    def mark(key: tuple, table: pa.Table, answer: pa.Table, length: int) -> pa.Table:
        found = _found(answer, True)
        hit = np.zeros(table.num_rows, bool)
        for t, _, _, row, _, h in _word_blocks(table, _doc_numbers(table)):
            w, ok = hashes(h, row, length)
            hit[t.first + row[: len(w)][ok & _member(w, found, True)]] = True
        some = table.filter(pa.array(hit)).select(["doc_id"])
        return some.append_column("words", pa.array(np.full(some.num_rows, length), pa.int64()))

    spark, out = docs.sparkSession, plain.select("doc_id").withColumn("words", F.lit(0).cast("bigint"))
    known, length, some = None, n, dealt
    while True:
        before, known = known, X.settled(X.with_answers(some, known, send, X.PACKED, length).groupBy("bucket").applyInArrow(lambda key, table: _answer_level(table, True), X.ANSWER))
        if before is not None:
            X.forget(before)
        X.release(spark)
        if known.isEmpty():
            X.forget(known)
            return out.groupBy("doc_id").agg(F.max("words").alias("words"))
        hits = X.settled(X.with_answers(some, known, mark, f"doc_id {kind}, words bigint", length))
        X.release(spark)
        out = out.unionByName(hits)
        # a longer repeat holds one of this length, so only these documents are read again
        again = small(X.settled(hits.select(F.col("doc_id").alias("hit")).distinct()))
        some = dealt.join(again, F.col("doc_id").eqNullSafe(F.col("hit")), "left_semi")
        length *= 2
