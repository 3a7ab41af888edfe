"""Quality rules: divergence of a document's histograms from language references.

Two histograms describe a document: shares of character classes, and shares of a
fixed list of common words.  The references are the same histograms summed over
all documents of a language.  A document fails when its Jensen-Shannon distance to
even the nearest language reference is too large and it is long enough for its
shares to mean something (the minimum-length guards; the limit of the word distance
rises for short texts).

Both passes read each text once, in Arrow batches; the only thing that reaches the
driver is one row of sums for each language of ``COMMON_WORDS`` and one for all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.llm.exchange import bounded
from notelake.llm.text import Texts, covered, lower_ascii, mix, per_text, text_blocks, window_hash, window_ok, word_hash, words

# Common words of each language.
COMMON_WORDS = {
    "en": "the of and to in a is that it for on was as with be by are this at an from not or have which but they his her were been has had will would there their what all can".split(),
    "fr": "de la le et les des en un une du que qui dans pour est pas au par sur ce il plus ne se avec son sa ou aux sont mais cette elle nous vous".split(),
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este".split(),
}
# Character classes, the last one for everything else.
CLASSES = {
    "space": " \t\x0b\x0c\r",
    "newline": "\n",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": "0123456789",
    "stop": ".",
    "comma": ",",
    "mark": "!?;:",
    "quote": "'\"()[]-",
    "symbol": "#*$%&|<>",
}
SYMBOLS = "#*$%&|<>"

#: Words and code points below which the word or the class histogram is not judged.
MIN_WORDS = 50
MIN_CHARS = 400
#: Words below which the limit of the word distance rises, with the inverse root of their number as chance does.
FULL_WORDS = 150
SHORT_SURPLUS = 1.2
#: Jensen-Shannon distances (0 to 1) above which a document fails.
MAX_CLASS_DISTANCE = 0.28
MAX_WORD_DISTANCE = 0.32

_CLASS = np.full(256, len(CLASSES), np.uint8)  # other ASCII
_CLASS[0xC0:] = len(CLASSES) + 1  # first byte of a character beyond ASCII
_CLASS[0x80:0xC0] = len(CLASSES) + 2  # its other bytes: not counted
for _i, _chars in enumerate(CLASSES.values()):
    _CLASS[list(_chars.encode())] = _i
N_CLASSES = len(CLASSES) + 2
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True


def _vocabulary(common: dict[str, list[str]]) -> tuple[np.ndarray, int]:
    """Sorted hashes of all the languages' common words."""
    every = sorted({w for ws in common.values() for w in ws})
    raw = [w.encode() for w in every]
    ends = np.cumsum([len(b) for b in raw])
    data = np.frombuffer(b"".join(raw), np.uint8)
    h = word_hash(data, ends - [len(b) for b in raw], ends)
    return np.sort(h), len(every)


def _histograms(t: Texts, start: np.ndarray, end: np.ndarray, doc: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of character classes and of common words (last: any other word), a row for each text."""
    n = len(t)
    of_byte = np.repeat(np.arange(n), np.diff(t.offsets))
    classes = np.bincount(of_byte * (N_CLASSES + 1) + _CLASS[t.data], minlength=n * (N_CLASSES + 1)).reshape(n, -1)[:, :N_CLASSES]
    short = end - start <= 24  # no common word is longer
    h = word_hash(lower_ascii(t.data), start[short], end[short])
    at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    column = np.full(len(start), len(vocabulary))
    column[np.flatnonzero(short)] = np.where(vocabulary[at] == h, at, len(vocabulary))
    width = len(vocabulary) + 1
    return classes, np.bincount(doc * width + column, minlength=n * width).reshape(n, width)


def word_limit(n: np.ndarray, limit: float) -> np.ndarray:
    """The word distance that a text of n words may have."""
    return limit + SHORT_SURPLUS * np.maximum(1 / np.sqrt(np.maximum(n, 1)) - 1 / np.sqrt(FULL_WORDS), 0)


def js_distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (square root of the divergence in bits) of each row's shares to the reference's."""
    p = counts / np.maximum(counts.sum(1, keepdims=True), 1)
    q = reference / max(reference.sum(), 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


def language_references(docs: DataFrame, common: dict[str, list[str]] = COMMON_WORDS) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Summed histograms over all documents, for each language of ``common`` that occurs and for all rows ("")."""
    vocabulary, size = _vocabulary(common)
    width = N_CLASSES + size + 1
    known = sorted(common)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(known) + 1, width), np.int64)
        for batch in batches:
            lang = np.array([known.index(x) if x in common else len(known) for x in batch.column("lang").to_pylist()], np.int64)
            for t in text_blocks(batch.column("text")):
                start, end, doc = words(t)
                both = np.hstack(_histograms(t, start, end, doc, vocabulary))
                np.add.at(total, lang[t.first : t.first + len(t)], both)
        yield pa.RecordBatch.from_pydict({"lang": [*known, ""], "sums": total.tolist()})

    parts = bounded(docs).select("lang", "text").mapInArrow(sums, "lang string, sums array<bigint>")
    rows = parts.select("lang", F.posexplode("sums").alias("i", "n")).groupBy("lang", "i").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "n"))).alias("s")).collect()
    found = {r["lang"]: np.array([x["n"] for x in r["s"]], float) for r in rows}
    everything = sum(found.values(), np.zeros(width))
    found = {k: v for k, v in found.items() if k and v[N_CLASSES:].sum()}
    return {k: (v[:N_CLASSES], v[N_CLASSES:]) for k, v in {**found, "": everything}.items() if k or not found}


class Rules:
    """The rules with their references, for the texts of Arrow batches."""

    def __init__(self, references: dict[str, tuple[np.ndarray, np.ndarray]], common: dict[str, list[str]], min_words: int, min_chars: int, max_class_distance: float, max_word_distance: float):
        self.class_refs = [r[0] for r in references.values()]
        self.word_refs = [r[1] for r in references.values()]
        self.vocabulary, _ = _vocabulary(common)
        self.limits = (min_chars, min_words, max_class_distance, max_word_distance)

    def judge(self, texts: pa.Array) -> list[np.ndarray]:
        """For each text: words, their code points, symbols, repeated lines, repeated words, base verdict, two distances, verdict."""
        min_chars, min_words, max_class, max_word = self.limits
        parts = []
        for t in text_blocks(texts):
            start, end, doc = words(t)
            n = np.bincount(doc, minlength=len(t))
            kind = _CLASS[t.data]
            chars = per_text(t, ((t.data & 0xC0) != 0x80) & (kind > 1))
            symbols = per_text(t, _SYMBOL[t.data])
            n_repeat = np.bincount(doc[_repeated_words(word_hash(t.data, start, end), doc, 5)], minlength=len(t))
            failed = (n < 10) | (100 * n_repeat > 20 * n)
            classes, common_words = _histograms(t, start, end, doc, self.vocabulary)
            near = [np.min([js_distance(x, r) for r in refs], axis=0) if refs else np.zeros(len(t)) for x, refs in ((classes, self.class_refs), (common_words, self.word_refs))]
            guard = [classes.sum(1) >= min_chars, n >= min_words]
            bad = (guard[0] & (near[0] > max_class)) | (guard[1] & (near[1] > word_limit(n, max_word)))
            parts.append((n, chars, symbols, _duplicate_lines(t), n_repeat, failed, np.where(guard[0], near[0], np.nan), np.where(guard[1], near[1], np.nan), ~failed & ~bad))
        return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, int)] * 5 + [np.zeros(0, bool), np.zeros(0), np.zeros(0), np.zeros(0, bool)]


def quality_rules(
    docs: DataFrame,
    references: dict[str, tuple[np.ndarray, np.ndarray]] | None = None,
    common: dict[str, list[str]] = COMMON_WORDS,
    min_words: int = MIN_WORDS,
    min_chars: int = MIN_CHARS,
    max_class_distance: float = MAX_CLASS_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
) -> DataFrame:
    """Counts, distances and verdict for each row of ``docs``.

    Needs columns doc_id, lang and text; others are ignored, whatever their names.
    A null or empty text has no words and fails the base rule; a null or unknown lang
    only means that the row adds to no language's reference.  Distances are to the
    nearest reference, so a wrong lang does no harm; they are null below the guards.
    Repeated rows are judged one by one.  An empty table gives an empty result.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, class_distance, word_distance, kept.
    """
    rules = Rules(language_references(docs, common) if references is None else references, common, min_words, min_chars, max_class_distance, max_word_distance)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *counts, failed, c, w, kept = rules.judge(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in counts), pa.array(failed), pa.array(c, mask=np.isnan(c)), pa.array(w, mask=np.isnan(w)), pa.array(kept)],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept"],
            )

    schema = "doc_id {}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, class_distance double, word_distance double, kept boolean"
    return bounded(docs).select("doc_id", "text").mapInArrow(judge, schema.format(docs.schema["doc_id"].dataType.simpleString()))


def keep_good(docs: DataFrame, common: dict[str, list[str]] = COMMON_WORDS, min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS, max_class_distance: float = MAX_CLASS_DISTANCE, max_word_distance: float = MAX_WORD_DISTANCE) -> DataFrame:
    """The rows of ``docs``, all columns, that ``quality_rules`` keeps; no shuffle but the references' sums."""
    rules = Rules(language_references(docs, common), common, min_words, min_chars, max_class_distance, max_word_distance)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(rules.judge(batch.column("text"))[-1]))

    return docs.mapInArrow(keep, docs.schema)


def _repeated_words(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Mask of the words that lie in an n-word window found twice or more in their text."""
    at = np.flatnonzero(window_ok(doc, n))
    keys = window_hash(h, n)[at] ^ mix(doc[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return covered(len(h), at[twice], n)


def _duplicate_lines(t: Texts) -> np.ndarray:
    """For each text, the lines with a word that equal an earlier line."""
    if not len(t.data):
        return np.zeros(len(t), np.int64)
    breaks = np.flatnonzero(t.data == 10)
    start = np.union1d(t.offsets[:-1][np.diff(t.offsets) > 0], breaks + 1)
    start = start[start < len(t.data)]
    doc = np.searchsorted(t.offsets[:-1], start, "right") - 1
    stop = np.searchsorted(breaks, start)
    end = np.minimum(np.append(breaks, len(t.data))[stop], t.offsets[doc + 1])
    filled = np.zeros(len(t.data) + 1, np.int64)
    np.cumsum(_CLASS[t.data] > 1, out=filled[1:])
    some = filled[end] > filled[start]
    start, end, doc = start[some], end[some], doc[some]
    keys = word_hash(t.data, start, end) ^ mix(doc.astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys)
    again = np.zeros(len(order), bool)
    again[order[1:]] = keys[order][1:] == keys[order][:-1]
    return np.bincount(doc[again], minlength=len(t))
