"""Benchmark decontamination by template canonicalisation.

A text becomes a sequence of tokens: words without outer punctuation, in lower case,
where numbers, names and units are replaced by typed placeholders.  Windows of
template tokens of the benchmark form a hash table; every window of every document
probes it.  Windows that match one item at one shift are laid on each other, and the
values in their slots have to agree: equal values of the item stand for equal values
of the document and different for different ones.  So a question with other numbers
or names is found, and a text that only shares a form is not.  Windows of the exact
words are looked for as well, so verbatim copies are found whatever they consist of.
A text holds an item if half of the item's tokens agree, or ``MIN_RUN`` of them in one
run, whatever the item's length.

The benchmark is a stated query set.  It is gone through in slices of at most
``SLICE_WINDOWS`` windows, each broadcast as the build side of the hash join, so what a
task holds is bounded whatever its size.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame

from notelake.llm.exchange import bounded
from notelake.llm.text import Texts, lower_ascii, mix, text_blocks, window_hash, window_ok, word_hash, words

#: Tokens of a window, and how many of them at least are no placeholders where these stand for any value.
WINDOW = 8
MIN_LITERALS = 4
#: Tokens of the shortest items that are looked for.
MIN_TOKENS = 4
#: Share of an item's tokens that consistent windows have to cover.
MIN_COVERAGE = 0.5
#: Item tokens in one run that are enough, however long the item is.
MIN_RUN = 13
#: Windows of the benchmark that a task holds at once (about 80 MB).
SLICE_WINDOWS = 1_000_000

# Number words, units and frequent first names.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
UNITS = "mm cm m km meter meters metre metres kilometer kilometers centimeter centimeters mile miles foot feet inch inches yard yards mg g kg gram grams kilogram kilograms ton tons pound pounds ounce ounces ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros percent degree degrees watt watts volt volts joule joules newton newtons kmh mph".split()
NAMES = "James John Robert Michael William David Richard Joseph Thomas Charles Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Tom Tim Bob Alice Anna Ann Jane Jack Sam Ben Emma Olivia Sophia Lily Natalia Weng Betty Julie Mark Peter Paul Maria Jose Juan Carlos Ana Luis Pedro Pierre Marie Jean Claire Hans Klaus Anja Julia".split()

LITERAL, NUMBER, NAME, UNIT = 0, 1, 2, 3
_SLOT = mix(np.arange(1, 5, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))

_PUNCT = np.zeros(256, bool)
_PUNCT[list(b"!\"'()*,./:;<>?[\\]^_`{|}~#&=@-")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_NUMERIC = _DIGIT.copy()
_NUMERIC[list(b".,:/%+-$^")] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:;")] = True


def _hashes(values: list[str]) -> np.ndarray:
    raw = [v.lower().encode() for v in values]
    ends = np.cumsum([len(b) for b in raw])
    return np.sort(word_hash(np.frombuffer(b"".join(raw), np.uint8), ends - [len(b) for b in raw], ends))


_NUMBER_WORDS, _UNITS, _NAMES = map(_hashes, (NUMBER_WORDS, UNITS, NAMES))


def _among(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[np.minimum(np.searchsorted(table, h), len(table) - 1)] == h


@dataclass
class Template:
    """Template tokens of some texts: hash, hash of the word itself, kind, place in the bytes and text number."""

    token: np.ndarray
    word: np.ndarray
    kind: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray


def canonical(t: Texts) -> Template:
    start, end, doc = words(t)
    if not len(start):
        return Template(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int8), start, end, doc)
    data = t.data
    stops = _STOP[data[end - 1]]  # before punctuation goes
    first = np.empty(len(start), bool)  # first word of a sentence, line or text
    first[0] = True
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    first[1:] = stops[:-1] | (doc[1:] != doc[:-1]) | (lines[start[1:]] != lines[start[:-1]])
    start, end = start.copy(), end.copy()
    live = np.flatnonzero(_PUNCT[data[start]])
    while len(live):
        start[live] += 1
        live = live[start[live] < end[live]]
        live = live[_PUNCT[data[start[live]]]]
    live = np.flatnonzero(start < end)
    live = live[_PUNCT[data[end[live] - 1]]]
    while len(live):
        end[live] -= 1
        live = live[_PUNCT[data[end[live] - 1]]]  # its first byte is no punctuation
    some = start < end
    start, end, doc, first = start[some], end[some], doc[some], first[some]
    if not len(start):
        return Template(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int8), start, end, doc)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data], dtype=np.int32)])
    has_digit = np.flatnonzero(digits[end] > digits[start])
    h = word_hash(lower_ascii(data), start, end)
    kind = np.zeros(len(h), np.int8)
    lead, after = data[start], data[np.minimum(start + 1, len(data) - 1)]
    capital = ((lead >= 65) & (lead <= 90)) | ((lead == 0xC3) & (after >= 0x80) & (after <= 0x9E) & (after != 0x97))
    kind[(capital & ~first) | (capital & _among(h, _NAMES))] = NAME
    if len(has_digit):
        odd = np.concatenate([[0], np.cumsum(~_NUMERIC[data], dtype=np.int32)])
        kind[has_digit[odd[end[has_digit]] == odd[start[has_digit]]]] = NUMBER
    kind[_among(h, _NUMBER_WORDS)] = NUMBER
    after_number = np.flatnonzero((kind[:-1] == NUMBER) & (doc[1:] == doc[:-1])) + 1
    kind[after_number[_among(h[after_number], _UNITS)]] = UNIT
    return Template(np.where(kind == LITERAL, h, _SLOT[kind]), h, kind, start, end, doc)


def _windows(x: Template, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Position and hash of each n-token window: of the template where it has enough literals, and of the exact words."""
    if len(x.doc) < n or n < MIN_TOKENS:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    ok = window_ok(x.doc, n)
    literal = np.concatenate([[0], np.cumsum(x.kind == LITERAL)])
    at = np.flatnonzero(ok & (literal[n:] - literal[: len(literal) - n] >= MIN_LITERALS))
    exact = np.flatnonzero(ok)
    return np.concatenate([at, exact]), np.concatenate([window_hash(x.token, n)[at], window_hash(x.word, n, seed=1)[exact]])


@dataclass
class Index:
    """Windows of some benchmark items, and the hashes of their words."""

    items: list
    lengths: list[int]
    slots: list[dict[int, tuple[int, str]]]
    words: list[np.ndarray]
    sizes: list[int]
    tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def build_index(items: list[tuple[object, str]], n: int = WINDOW) -> Index:
    """``items``: id and text of each.

    Items shorter than a window make one window of their own length;
    items of fewer than ``MIN_TOKENS`` tokens say too little to be looked for."""
    text = pa.array([x[1] or "" for x in items], pa.large_string())
    slots: list[dict] = [{} for _ in items]
    hashes = [np.zeros(0, np.uint64) for _ in items]
    lengths = [0] * len(items)
    found: dict[int, list] = defaultdict(list)
    for t in text_blocks(text):
        x = canonical(t)
        for d in range(len(t)):
            mine = np.flatnonzero(x.doc == d)
            i = t.first + d
            lengths[i] = len(mine)
            if not len(mine):
                continue
            one = Template(*(a[mine] for a in (x.token, x.word, x.kind, x.start, x.end, x.doc)))
            hashes[i] = one.word
            slots[i] = {p: (int(k), t.data[a:b].tobytes().decode().lower()) for p, (k, a, b) in enumerate(zip(one.kind, one.start, one.end, strict=True)) if k}
            size = min(n, len(mine))
            at, h = _windows(one, size)
            found[size] += [(int(v), i, int(p)) for v, p in zip(h, at, strict=True)]
    tables = {}
    for size, rows in found.items():
        rows.sort()
        if rows:
            tables[size] = (np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
    return Index([x[0] for x in items], lengths, slots, hashes, [min(n, k) for k in lengths], tables)


def _agree(places: list[int], shift: int, slots: dict, kinds: Callable[[int], tuple[int, str]]) -> bool | None:
    """Whether all slots among these item tokens keep their values; None if slots disagree."""
    there: dict = {}
    back: dict = {}
    exact = True
    for p in places:
        if p in slots:
            kind, value = slots[p]
            other = kinds(p + shift)[1]
            if there.setdefault((kind, value), other) != other or back.setdefault((kind, other), value) != value:
                return None
            exact &= other == value
    return exact


def _runs(places: list[int]) -> list[list[int]]:
    """Places in order, in runs without gaps."""
    out: list[list[int]] = []
    for p in places:
        if out and out[-1][-1] == p - 1:
            out[-1].append(p)
        else:
            out.append([p])
    return out


def _parts(places: list[int], shift: int, min_run: int, slots: dict, kinds: Callable[[int], tuple[int, str]], same: Callable[[int], bool]) -> list[tuple[list[int], bool]]:
    """Item tokens that windows at one shift cover, as far as they agree, and whether all slots keep their values.

    All of them if their slots agree; else the long runs that agree in themselves, and the long verbatim parts of the others."""
    if (exact := _agree(places, shift, slots, kinds)) is not None:
        return [(places, exact)]
    out = []
    for run in _runs(places):
        if len(run) < min_run:
            continue
        if (exact := _agree(run, shift, slots, kinds)) is not None:
            out.append((run, exact))
        else:
            out += [(part, True) for part in _runs([p for p in run if same(p)]) if len(part) >= min_run]
    return out


def matches(t: Texts, index: Index, min_coverage: float = MIN_COVERAGE, min_run: int = MIN_RUN) -> list[tuple[int, int, int, float, bool]]:
    """Text number, item number, matched windows, coverage and exactness for each contaminated text and item."""
    x = canonical(t)
    hits: dict[tuple[int, int], dict[tuple[int, int], set[int]]] = defaultdict(lambda: defaultdict(set))
    for size, (keys, item, place) in index.tables.items():
        at, h = _windows(x, size)
        lo = np.searchsorted(keys, h)
        near = keys[np.minimum(lo, len(keys) - 1)] == h
        for p, k in zip(at[near], lo[near], strict=True):
            v = keys[k]
            while k < len(keys) and keys[k] == v:
                hits[int(x.doc[p]), int(item[k])][int(p) - int(place[k]), size].add(int(place[k]))
                k += 1
    out = []
    for (doc, item), shifts in sorted(hits.items()):
        cover: set[int] = set()
        exact, n, long = True, 0, False
        value = lambda p: (int(x.kind[p]), t.data[x.start[p] : x.end[p]].tobytes().decode().lower())
        for (shift, size), starts in sorted(shifts.items()):
            same = lambda p, shift=shift: x.word[p + shift] == index.words[item][p]
            for part, kept in _parts(sorted({p + j for p in starts for j in range(size)}), shift, min_run, index.slots[item], value, same):
                inside = set(part)
                cover |= inside
                exact &= kept
                n += sum(p in inside and p + size - 1 in inside for p in starts)
                long |= any(len(run) >= min_run for run in _runs(part))
        share = len(cover) / index.lengths[item]
        if cover and (long or share >= min_coverage):
            out.append((doc, item, n, share, exact))
    return out


def _slices(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[object, str]]]:
    """Items in slices of about ``limit`` words at most."""
    some: list = []
    size = 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        some.append((r[0], r[1]))
        size += len((r[1] or "").split()) + 1
        if size >= limit:
            yield some
            some, size = [], 0
    if some:
        yield some


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_coverage: float = MIN_COVERAGE, slice_windows: int = SLICE_WINDOWS, min_run: int = MIN_RUN) -> DataFrame:
    """Each document that holds a benchmark item, with the item.

    Needs doc_id and text of ``docs`` and item_id and text of ``benchmark``; other
    columns are ignored, whatever their names.  Null or empty texts match nothing;
    items of fewer than ``MIN_TOKENS`` tokens are never found, and of those with fewer
    than ``MIN_LITERALS`` words that are no placeholders only verbatim copies.  A run of
    ``min_run`` item tokens is enough, whatever share of the item it is.  Repeated rows give repeated results; empty
    tables give an empty one.

    Returns doc_id, item_id, n_windows, coverage (share of the item's tokens that
    consistent windows cover), exact (all slots have the item's own values).
    """
    kinds = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, n_windows int, coverage double, exact boolean"
    out = None
    for items in _slices(benchmark, slice_windows):
        shared = docs.sparkSession.sparkContext.broadcast(build_index(items, window))

        def find(batches: Iterator[pa.RecordBatch], shared: Broadcast[Index] = shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                rows = [(t.first + d, *rest) for t in text_blocks(batch.column("text")) for d, *rest in matches(t, index, min_coverage, min_run)]
                if rows:
                    doc, item, n, share, exact = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").take(pa.array(doc)), "item_id": [index.items[i] for i in item], "n_windows": pa.array(n, pa.int32()), "coverage": share, "exact": exact})

        part = bounded(docs).select("doc_id", "text").mapInArrow(find, schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_coverage: float = MIN_COVERAGE, slice_windows: int = SLICE_WINDOWS, min_run: int = MIN_RUN) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no benchmark item; no shuffle."""
    for items in _slices(benchmark, slice_windows):
        shared = docs.sparkSession.sparkContext.broadcast(build_index(items, window))

        def keep(batches: Iterator[pa.RecordBatch], shared: Broadcast[Index] = shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                bad = np.zeros(batch.num_rows, bool)
                for t in text_blocks(batch.column("text")):
                    bad[[t.first + m[0] for m in matches(t, index, min_coverage, min_run)]] = True
                yield batch.filter(pa.array(~bad))

        docs = bounded(docs).mapInArrow(keep, docs.schema)
    return docs
