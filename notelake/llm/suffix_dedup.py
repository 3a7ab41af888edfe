"""Suffix-array deduplication of byte strings that repeat anywhere in the corpus.

Every byte covered by a ``length``-byte string that also starts elsewhere, in the same
document or another, is removed.

To bring equal strings together, each window of ``length`` bytes is labelled with the
smallest hash of the 64-byte strings in it.  Neighbouring windows of one label form a
segment; equal windows have equal labels, so only segments of one label have to be
compared.  Labels and content hashes of segments are exchanged first, each once a
chunk of documents.  Then the different contents of a label - each sent once, by one
chunk - form a shard text.  The shards' suffix arrays are built by induced sorting, and
permuted common prefixes of ``length`` or more show the repeated windows.  A content that
occurs twice is repeated as a whole.

A label with more than ``max_contents`` contents (a passage in very many different
surroundings) is split: its windows are exchanged one by one by hashes of all their
bytes, so that no shard grows with the frequency of a passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from notelake.llm import exchange as X
from notelake.llm.suffixes import common_prefixes, suffix_arrays
from notelake.llm.text import Texts, mix, prefix_sums, range_hash, text_blocks

U64 = np.uint64
LENGTH = 400
GRAM = 64
#: Contents of a label up to which they form a shard; the windows of others are compared one by one.
MAX_CONTENTS = 64
#: Symbols of the shards that are sorted together.
BATCH = 1 << 20
#: Bytes of a long text that are labelled at once.
PIECE = 4 << 20

ALL, COMPARE, SEND, SPLIT = 1, 2, 4, 8
_SENT = "bucket int, chunk int, kind int, payload binary, body binary"
_ANSWER = "chunk int, kind int, payload binary"


def _sliding(x: np.ndarray, w: int, f: np.ufunc, fill: int) -> np.ndarray:
    """f (minimum or maximum) of each w neighbours."""
    n = len(x)
    if n < w:
        return x[:0]
    padded = np.concatenate([x, np.full(-n % w, fill, x.dtype)]).reshape(-1, w)
    right = f.accumulate(padded, axis=1).ravel()
    left = f.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(left[: n - w + 1], right[w - 1 : n])


class Segments:
    """Segments of some bytes: label, content hash, first window, number of windows."""

    def __init__(self, data: np.ndarray, valid: np.ndarray, length: int, gram: int, inner: bool = False):
        """``valid``: whether a window may start at each place (len(data) - length + 1 places)."""
        self.length = length
        self.sums = prefix_sums(data, 3)
        at = np.arange(len(data) - gram + 1)
        h = range_hash(self.sums, at, at + gram, 3)
        w = length - gram + 1
        v = _sliding(h, w, np.minimum, 0xFFFFFFFFFFFFFFFF)
        first = valid.copy()
        first[1:] &= ~valid[:-1] | (v[1:] != v[:-1])
        last = valid.copy()
        last[:-1] &= ~valid[1:] | (v[1:] != v[:-1])
        self.start = np.flatnonzero(first)
        self.count = np.flatnonzero(last) - self.start + 1
        smallest = v[self.start]
        self.label = mix(smallest)  # smallest hashes are small; this spreads them over all hash ranges
        self.content = mix(range_hash(self.sums, self.start, self.start + self.count + length - 1, 3) ^ U64(0x6A09E667F3BCC909)) & ~U64(3)
        self.inner = np.zeros(len(self.start), bool)
        if inner and len(self.start):
            # labels that stand at several places, where a segment may repeat its own windows
            most = _sliding(np.concatenate([np.zeros(w - 1, U64), np.where(valid, v, U64(0)), np.zeros(w - 1, U64)]), w, np.maximum, 0)
            least = np.sort(h[most == h])
            twice = np.unique(least[1:][least[1:] == least[:-1]])
            if len(twice):
                self.inner = twice[np.minimum(np.searchsorted(twice, smallest), len(twice) - 1)] == smallest

    @property
    def key(self) -> np.ndarray:
        return mix(self.label ^ mix(self.content))

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and 96-bit hash of each window of some segments."""
        n = self.count[which]
        at = np.repeat(self.start[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        h = range_hash(self.sums, at, at + self.length, 3)
        half = range_hash(self.sums, at, at + self.length // 2, 3)
        return at, mix(h ^ U64(0xBB67AE8584CAA73B)), (mix(half + h) >> U64(32)).astype(np.uint32)


def _blocks(table: pa.Table, length: int, gram: int, inner: bool = False) -> Iterator[tuple[Texts, int, np.ndarray, Segments]]:
    """Texts, place, bytes and segments of each part of a chunk's texts; a long text comes in several parts."""
    for t in text_blocks(table.column("text")):
        n = len(t.data)
        for lo in range(0, max(n - length + 1, 1), PIECE):
            data = t.data[lo : lo + PIECE + length - 1]
            if len(data) < length:
                continue
            steps = np.zeros(n + 2, np.int32)
            long = np.diff(t.offsets) >= length
            np.add.at(steps, t.offsets[:-1][long], 1)
            np.add.at(steps, t.offsets[1:][long] - length + 1, -1)
            valid = np.cumsum(steps)[lo : lo + len(data) - length + 1] > 0
            yield t, lo, data, Segments(data, valid, length, gram, inner)


def _statuses(table: pa.Table, max_contents: int) -> pa.Table:
    """What each chunk has to do with its segments: key and status of those that may repeat."""
    row, label, content = X.unpack(table, U64, U64)
    chunk = table.column("chunk").to_numpy()[row] if len(row) else row
    many, inner, content = (content & U64(1)) > 0, (content & U64(2)) > 0, content & ~U64(3)
    order = np.lexsort((chunk, content, label))
    v, c = label[order], content[order]
    if not len(v):
        return pa.table({"chunk": pa.array([], pa.int32()), "kind": pa.array([], pa.int32()), "payload": pa.array([], pa.binary())})
    new_v = np.concatenate([[True], v[1:] != v[:-1]])
    new_c = new_v | np.concatenate([[True], c[1:] != c[:-1]])
    of_c, of_v = np.cumsum(new_c) - 1, np.cumsum(new_v) - 1
    twice = (np.bincount(of_c) > 1) | (np.bincount(of_c, many[order]) > 0)
    contents = np.bincount(of_v, new_c)[of_v]
    twice = twice[of_c]
    split = contents > max_contents
    compare = ~split & ((contents > 1) | (inner[order] & ~twice))
    status = np.zeros(len(v), np.uint8)
    status[order] = twice * ALL + (compare * COMPARE) + ((compare & new_c) * SEND) + (split & ~twice) * SPLIT + (split & twice & new_c) * SPLIT
    out = X.answers(table, row, status > 0, mix(label ^ mix(content)), status)
    return out.append_column("kind", pa.array(np.zeros(out.num_rows), pa.int32())).select(["chunk", "kind", "payload"])


def _shards(table: pa.Table, length: int) -> pa.Table:
    """Repeated windows of the contents that chunks sent: chunk, segment key, first window and number of windows."""
    labels, keys, bodies, owners = [], [], [], []
    for chunk, payload, body in zip(table.column("chunk").to_pylist(), table.column("payload"), table.column("body"), strict=True):
        b = payload.as_buffer()
        n = b.size // 20
        labels.append(np.frombuffer(b, U64, n))
        keys.append(np.frombuffer(b, U64, n, 8 * n))
        size = np.frombuffer(b, np.uint32, n, 16 * n).astype(np.int64)
        data, stop = np.frombuffer(body.as_buffer(), np.uint8), np.cumsum(size)
        bodies += [data[e - k : e] for e, k in zip(stop, size, strict=True)]
        owners.append(np.full(n, chunk, np.int32))
    label, key, owner = np.concatenate(labels), np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(label, kind="stable")
    cut = np.concatenate([[0], np.flatnonzero(np.diff(label[order])) + 1, [len(order)]])
    sizes = np.array([len(bodies[i]) + 1 for i in range(len(bodies))])
    total = np.add.reduceat(sizes[order], cut[:-1]) + 1
    by_size = np.argsort(-total, kind="stable")
    found: list[list[np.ndarray]] = [[], [], [], []]
    lo = 0
    while lo < len(by_size):
        hi = lo + max(1, int(np.searchsorted(np.cumsum(total[by_size[lo:]]), BATCH, "right")))
        members = np.concatenate([order[cut[g] : cut[g + 1]] for g in by_size[lo:hi]])
        ends_of = np.cumsum([cut[g + 1] - cut[g] for g in by_size[lo:hi]]) - 1
        text, place, room = [], [], []
        at = 0
        closing = set(ends_of.tolist())
        for j, i in enumerate(members):
            k = len(bodies[i])
            text += [bodies[i].astype(np.int32) + 2, np.ones(1, np.int32)]
            place.append(at)
            room.append(k)
            at += k + 1
            if j in closing:
                text.append(np.zeros(1, np.int32))
                at += 1
        raw = np.concatenate(text)
        size = total[by_size[lo:hi]]
        shard = np.repeat(np.arange(len(size)), size)
        _, symbols = np.unique(shard * 258 + raw, return_inverse=True)
        symbols = symbols.astype(np.int64)
        sa = suffix_arrays(symbols, size)
        phi, common = common_prefixes(symbols, sa, np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        left = np.zeros(len(raw), np.int64)  # bytes from each place to the end of its content
        for p, k in zip(place, room, strict=True):
            left[p : p + k] = np.arange(k, 0, -1)
        same = np.flatnonzero((common >= length) & (left >= length))
        repeated = np.zeros(len(raw), bool)
        repeated[same] = True
        repeated[phi[same]] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], repeated.view(np.int8), [0]])))
        begin, over = edge[::2], edge[1::2]
        which = np.searchsorted(np.array(place), begin, "right") - 1
        for column, values in zip(found, (owner[members[which]], key[members[which]], (begin - np.array(place)[which]).astype(np.uint32), (over - begin).astype(np.uint32)), strict=True):
            column.append(values)
        lo = hi
    owner, key, start, count = (np.concatenate(x) for x in found)
    chunks = np.unique(owner)
    payload = [b"".join(x[owner == c].tobytes() for x in (key, start, count)) for c in chunks]
    return pa.table({"chunk": pa.array(chunks, pa.int32()), "kind": pa.array(np.ones(len(chunks)), pa.int32()), "payload": pa.array(payload, pa.binary())})


def _single_windows(table: pa.Table) -> pa.Table:
    """Hashes of split labels' windows that occur twice, for each chunk that has them."""
    row, h, g, many = X.unpack(table, U64, np.uint32, np.uint8)
    order = np.lexsort((g, h))
    same = (h[order][1:] == h[order][:-1]) & (g[order][1:] == g[order][:-1])
    hot = many[order] > 0
    hot[1:] |= same
    hot[:-1] |= same
    wanted = np.zeros(len(h), bool)
    wanted[order] = hot
    out = X.answers(table, row, wanted, h, g)
    return out.append_column("kind", pa.array(np.full(out.num_rows, 2), pa.int32())).select(["chunk", "kind", "payload"])


def cut_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, chunk_bytes: int | None = None, max_contents: int = MAX_CONTENTS) -> DataFrame:
    """Each document's bytes without those covered by a ``length``-byte string that starts anywhere else too.

    Needs doc_id (integer) and text; others are ignored, whatever their names.  A null
    or empty text has no bytes.  Every row counts as a document of its own, so the texts
    of repeated rows are removed as far as they are ``length`` bytes long.  An empty table
    gives an empty result.

    Returns doc_id, kept (binary), n_bytes, n_removed, spans (array of first byte and
    length of each run removed).
    """
    plain = X.bounded(docs).select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    parts, ranges = X.chunk_count(plain, chunk_bytes)
    dealt = plain.select(X.by_hash(parts).alias("chunk"), "doc_id", "text")

    def label(key: tuple, table: pa.Table, _: None) -> pa.Table:
        parts_ = [(s.label, s.content, s.inner) for *_, s in _blocks(table, length, gram, True)]
        v, c, inner = (np.concatenate([p[i] for p in parts_]) if parts_ else np.zeros(0, U64) for i in range(3))
        order = np.lexsort((c, v))
        v, c, inner = v[order], c[order], inner[order]
        new = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (c[1:] != c[:-1])])) if len(v) else np.zeros(0, int)
        many = np.diff(np.append(new, len(v))) > 1
        some = np.add.reduceat(inner.astype(np.int64), new) > 0 if len(new) else many
        return X.pack(key[0].as_py(), ranges, v[new], c[new] | many.astype(U64) | (some.astype(U64) << U64(1)))

    statuses = X.with_answers(dealt, None, label, X.PACKED).groupBy("bucket").applyInArrow(lambda table: _statuses(table, max_contents), _ANSWER)

    def send(key: tuple, table: pa.Table, answer: pa.Table) -> pa.Table:
        chunk = key[0].as_py()
        _, known, status = X.unpack(answer, U64, np.uint8)
        send_, split = np.sort(known[(status & SEND) > 0]), np.sort(known[(status & SPLIT) > 0])
        labels, keys, bodies, hs, gs = [], [], [], [], []
        done: set[int] = set()
        for _, _, data, s in _blocks(table, length, gram):
            k = s.key
            for i in np.flatnonzero(_in(k, send_)):
                if int(k[i]) not in done:
                    done.add(int(k[i]))
                    labels.append(s.label[i])
                    keys.append(k[i])
                    bodies.append(data[s.start[i] : s.start[i] + s.count[i] + length - 1].tobytes())
            which = np.flatnonzero(_in(k, split))
            if len(which):
                _, h, g = s.windows(which)
                hs.append(h)
                gs.append(g)
        v, k = np.array(labels, U64), np.array(keys, U64)
        order = np.argsort(v, kind="stable")
        bucket = X.bucket_of(v[order], ranges)
        rows: list[tuple] = []
        for b in np.unique(bucket):
            mine = order[bucket == b]
            sizes = np.array([len(bodies[i]) for i in mine], np.uint32)
            rows.append((int(b), chunk, 0, v[mine].tobytes() + k[mine].tobytes() + sizes.tobytes(), b"".join(bodies[i] for i in mine)))
        if hs:
            h, g = np.concatenate(hs), np.concatenate(gs)
            order = np.lexsort((g, h))
            h, g = h[order], g[order]
            new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])]))
            packed = X.pack(chunk, ranges, h[new], g[new], (np.diff(np.append(new, len(h))) > 1).astype(np.uint8))
            rows += [(b, chunk, 1, p, b"") for b, p in zip(packed.column("bucket").to_pylist(), packed.column("payload").to_pylist(), strict=True)]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        return pa.table({n: pa.array(x, t) for n, x, t in zip(("bucket", "chunk", "kind", "payload", "body"), columns, (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)})

    def resolve(table: pa.Table) -> pa.Table:
        of = table.column("kind").to_numpy()
        out = [f(table.filter(pa.array(of == k))) for k, f in ((0, lambda x: _shards(x, length)), (1, _single_windows)) if (of == k).any()]
        return pa.concat_tables(out)

    sent = X.with_answers(dealt, statuses, send, _SENT)
    answers = statuses.unionByName(sent.groupBy("bucket").applyInArrow(resolve, _ANSWER))

    def cut(key: tuple, table: pa.Table, answer: pa.Table) -> pa.Table:
        of = answer.column("kind").to_numpy()
        _, known, status = X.unpack(answer.filter(pa.array(of == 0)), U64, np.uint8)
        whole, split = np.sort(known[(status & ALL) > 0]), np.sort(known[(status & (SPLIT | ALL)) == SPLIT])
        _, run_key, run_start, run_count = X.unpack(answer.filter(pa.array(of == 1)), U64, np.uint32, np.uint32)
        order = np.argsort(run_key, kind="stable")
        run_key, run_start, run_count = run_key[order], run_start[order].astype(np.int64), run_count[order].astype(np.int64)
        _, single_h, single_g = X.unpack(answer.filter(pa.array(of == 2)), U64, np.uint32)
        order = np.argsort(single_h)
        single_h, single_g = single_h[order], single_g[order]
        out: list[pa.Table] = []
        spans = _blocks(table, length, gram)
        pending = next(spans, None)
        for t in text_blocks(table.column("text")):
            steps = np.zeros(len(t.data) + 1, np.int32)
            while pending is not None and pending[0].first == t.first:
                _, lo, _, s = pending
                k = s.key
                w = np.flatnonzero(_in(k, whole))
                starts, sizes = [s.start[w]], [s.count[w]]
                a, b = np.searchsorted(run_key, k), np.searchsorted(run_key, k, "right")
                some = np.flatnonzero(b > a)
                if len(some):
                    n = (b - a)[some]
                    run = np.repeat(a[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    starts.append(np.repeat(s.start[some], n) + run_start[run])
                    sizes.append(run_count[run])
                which = np.flatnonzero(_in(k, split))
                if len(which) and len(single_h):
                    at, h, g = s.windows(which)
                    i = np.minimum(np.searchsorted(single_h, h), len(single_h) - 1)
                    at = at[(single_h[i] == h) & (single_g[i] == g)]
                    starts.append(at)
                    sizes.append(np.ones(len(at), np.int64))
                start, size = np.concatenate(starts) + lo, np.concatenate(sizes)
                np.add.at(steps, start, 1)
                np.add.at(steps, start + size + length - 1, -1)
                pending = next(spans, None)
            out.append(_without(t, np.cumsum(steps[:-1]) > 0))
        flat = pa.concat_tables(out) if out else _NO_BYTES
        return flat.append_column("doc_id", table.column("doc_id")).select(["doc_id", "kept", "n_bytes", "n_removed", "spans"])

    schema = f"doc_id {kind}, kept binary, n_bytes bigint, n_removed bigint, spans array<struct<start: bigint, length: bigint>>"
    return X.with_answers(dealt, answers, cut, schema)


def _in(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[np.minimum(np.searchsorted(table, h), len(table) - 1)] == h if len(table) else np.zeros(len(h), bool)


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64())])
_NO_BYTES = pa.table({"kept": pa.array([], pa.binary()), "n_bytes": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "spans": pa.array([], pa.list_(_RUN))})


def _without(t: Texts, gone: np.ndarray) -> pa.Table:
    """Bytes of each text that are not gone, counts and runs."""
    size = np.diff(t.offsets)
    sums = np.concatenate([[0], np.cumsum(~gone)])
    offsets = sums[t.offsets].astype(np.int64)
    kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(t), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(t.data[~gone]))]).cast(pa.binary())
    first = np.zeros(len(gone) + 1, bool)
    first[t.offsets] = True
    begin = np.flatnonzero(gone & (first[:-1] | ~np.concatenate([[False], gone[:-1]])))
    over = np.flatnonzero(gone & (first[1:] | ~np.concatenate([gone[1:], [False]]))) + 1
    doc = np.searchsorted(t.offsets[:-1], begin, "right") - 1
    runs = pa.StructArray.from_arrays([pa.array(begin - t.offsets[doc]), pa.array(over - begin)], fields=list(_RUN))
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(t) + 1)), pa.int32()), runs)
    return pa.table({"kept": kept, "n_bytes": pa.array(size, pa.int64()), "n_removed": pa.array(size - np.diff(offsets), pa.int64()), "spans": lists})
