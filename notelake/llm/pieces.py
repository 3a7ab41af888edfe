"""SentencePiece encoding and decoding on the ``tokenizers`` library.

The model file is parsed here (protobuf wire format, no protobuf library), and its
parts are rebuilt as a ``tokenizers.Tokenizer``: the normaliser (compiled character
map, removal of extra white space), the metaspace marker with the dummy prefix, the
vocabulary as BPE merges or unigram scores, and byte fallback.  Batches are encoded
by the library's own threads.  ``parity`` holds the ids against the SentencePiece
library.

Decoding is a table look-up of piece bytes, vectorised over all ids of a batch.
"""

from __future__ import annotations

import functools
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from notelake.llm.exchange import bounded

MARK = "▁"
# Fixed values of the model format: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2

#: Code points after which a long text is cut for encoding, at a lone blank.
PART = 1 << 15
#: Code points that one call of the encoder gets.
CALL = 1 << 19


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (b[i] & 127) << shift
        shift += 7
        i += 1
        if b[i - 1] < 128:
            return value, i


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field number and value of each field of a protobuf message."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        kind = key & 7
        if kind == 0:
            value, i = _varint(b, i)
        else:
            if kind == 2:
                size, i = _varint(b, i)
            elif kind in (1, 5):
                size = 8 if kind == 1 else 4
            else:
                raise ValueError(f"wire type {kind} in a model file")
            value, i = b[i : i + size], i + size
            if len(value) < size:
                raise ValueError("a model file that ends early")
        yield key >> 3, value


@dataclass
class Model:
    """The parts of a model file that encoding and decoding need."""

    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    trim: bool = True
    escape: bool = True
    unknown_text: str = " ⁇ "

    @classmethod
    def parse(cls, data: bytes) -> Model:
        m = cls()
        for number, value in _fields(data):
            if number == 1:
                piece = {1: b"", 2: b"\0\0\0\0", 3: NORMAL} | dict(_fields(value))
                m.pieces.append(piece[1].decode())
                m.scores.append(struct.unpack("<f", piece[2])[0])
                m.kinds.append(piece[3])
            elif number == 2:
                trainer = dict(_fields(value))
                m.kind = trainer.get(3, UNIGRAM)
                m.byte_fallback = bool(trainer.get(35, 0))
                m.unknown_text = trainer.get(44, m.unknown_text.encode()).decode()
                if trainer.get(24):
                    raise ValueError("models that treat white space as a suffix are not supported")
            elif number == 3:
                spec = dict(_fields(value))
                m.charsmap = spec.get(2, b"")
                m.dummy_prefix, m.trim, m.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        if not m.pieces:
            raise ValueError("no pieces: not a SentencePiece model")
        if m.kind not in (UNIGRAM, BPE):
            raise ValueError(f"model type {m.kind} is not supported")
        return m

    @property
    def cuttable(self) -> bool:
        """Whether no piece goes on over a marker, so that a text can be cut at a lone blank without changing its ids."""
        return self.dummy_prefix and self.escape and not any(k in (NORMAL, USER) and MARK in p.lstrip(MARK) for p, k in zip(self.pieces, self.kinds, strict=True))

    def tokenizer(self):
        """The model as a ``tokenizers.Tokenizer``."""
        from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

        unknown = self.kinds.index(UNKNOWN) if UNKNOWN in self.kinds else None
        if self.kind == BPE:
            rank = {p: i for i, p in enumerate(self.pieces)}
            merges = []
            for p, score, kind in zip(self.pieces, self.scores, self.kinds, strict=True):
                if kind == NORMAL:
                    splits = [(p[:i], p[i:]) for i in range(1, len(p)) if p[:i] in rank and p[i:] in rank]
                    merges += [(-score, rank[a], rank[b], a, b) for a, b in splits]
            merges = [(a, b) for _, _, _, a, b in sorted(merges)]
            model = models.BPE(vocab=rank, merges=merges, unk_token=self.pieces[unknown] if unknown is not None else None, fuse_unk=True, byte_fallback=self.byte_fallback, cache_capacity=0)
        else:
            model = models.Unigram(list(zip(self.pieces, self.scores, strict=True)), unk_id=unknown, byte_fallback=self.byte_fallback)
        t = Tokenizer(model)
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.trim:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(MARK if self.escape else " "))
        if self.escape:
            steps.append(normalizers.Replace(" ", MARK))
        t.normalizer = normalizers.Sequence(steps)
        user = [AddedToken(p, normalized=True, special=False) for p, k in zip(self.pieces, self.kinds, strict=True) if k == USER]
        if user:
            t.add_tokens(user)
        tail = [decoders.Strip(" ", 1, 0)] if self.dummy_prefix else []
        t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), *([decoders.ByteFallback()] if self.byte_fallback else []), decoders.Fuse(), *tail])
        return t

    def surfaces(self) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all pieces as they appear in decoded text, and where each begins (one more at the end)."""
        parts = []
        for p, kind in zip(self.pieces, self.kinds, strict=True):
            if kind == BYTE:
                parts.append(bytes([int(p[3:-1], 16)]))
            elif kind == UNKNOWN:
                parts.append(self.unknown_text.encode())
            else:
                parts.append(b"" if kind == CONTROL else p.replace(MARK, " ").encode())
        return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])


@functools.lru_cache(maxsize=2)
def _loaded(data: bytes):
    m = Model.parse(data)
    return m, m.tokenizer(), m.surfaces(), m.cuttable


def _cut(text: str, cuttable: bool) -> list[str]:
    """The text in parts whose ids, one after another, are those of the text."""
    if len(text) <= PART or not cuttable:
        return [text]
    parts, lo = [], 0
    lone = re.compile(rf"(?<=[^ {MARK}]) (?=[^ {MARK}])")
    while len(text) - lo > PART and (m := lone.search(text, lo + PART)):
        parts.append(text[lo : m.start()])
        lo = m.end()
    return [*parts, text[lo:]]


def encode_texts(texts: list[str], data: bytes) -> list[np.ndarray]:
    """Ids of each text."""
    _, tokenizer, _, cuttable = _loaded(data)
    out: list[list[np.ndarray]] = [[] for _ in texts]
    call: list[str] = []
    owner: list[int] = []

    def flush() -> None:
        for i, e in zip(owner, tokenizer.encode_batch_fast(call, add_special_tokens=False), strict=True):
            out[i].append(np.array(e.ids, np.int32))
        call.clear()
        owner.clear()

    size = 0
    for i, text in enumerate(texts):
        for part in _cut(text, cuttable):
            if call and size + len(part) > CALL:
                flush()
                size = 0
            call.append(part)
            owner.append(i)
            size += len(part)
    if call:
        flush()
    return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]


def decode_ids(ids: np.ndarray, ends: np.ndarray, data: bytes) -> pa.Array:
    """Texts of the id lists that follow one another in ``ids`` and end at ``ends``.

    Bytes that are no UTF-8 become U+FFFD.
    """
    model, _, (surface, begin), _ = _loaded(data)
    if len(ids) and (ids.min() < 0 or ids.max() >= len(model.pieces)):
        raise ValueError("an id outside the vocabulary")
    length = np.diff(begin)[ids]
    stop = np.cumsum(length)
    total = int(stop[-1]) if len(ids) else 0
    raw = surface[np.repeat(begin[ids] - (stop - length), length) + np.arange(total)]
    offsets = np.concatenate([[0], np.concatenate([[0], stop])[ends]]).astype(np.int64)
    if model.dummy_prefix:
        lead = offsets[:-1][(np.diff(offsets) > 0)]
        lead = lead[raw[lead] == 32]
        keep = np.ones(total, bool)
        keep[lead] = False
        raw = raw[keep]
        offsets = offsets - np.searchsorted(lead, offsets)
    texts = pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw)))
    try:
        texts.validate(full=True)
    except pa.ArrowInvalid:
        texts = pa.array([raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets, offsets[1:])], pa.large_string())
    return texts


def _threads(n: int) -> None:
    os.environ.setdefault("RAYON_NUM_THREADS", str(n))
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")


def read_model(path: str) -> bytes:
    """The model file's bytes; it is a small file (a few MB), closed over by the tasks."""
    with open(path if os.path.exists(path) else SparkFiles.get(path), "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: bytes, threads: int = 2) -> DataFrame:
    """Ids of each text and whether decoding gives the text back.

    Needs columns doc_id and text; others are ignored, whatever their names.  A null
    or empty text has no ids.  Rows stay one to one, also repeated ones; an empty
    table gives an empty result.  ``round_trip`` compares with the text as the
    model's normaliser leaves it where the model has none but the identity, that is
    with markers read as blanks; with other normalisers it may be false.

    Returns doc_id, ids, n_tokens, round_trip.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _threads(threads)
        for batch in batches:
            for lo in range(0, max(batch.num_rows, 1), 512):
                some = batch.slice(lo, 512)
                text = some.column("text").fill_null("")
                ids = encode_texts(text.to_pylist(), model)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                ends = np.cumsum([len(x) for x in ids], dtype=np.int64)
                back = decode_ids(flat, ends, model)
                same = pc.equal(back, pc.replace_substring(text.cast(pa.large_string()), MARK, " "))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), lists, pa.array(np.diff(ends, prepend=0), pa.int32()), same], names=["doc_id", "ids", "n_tokens", "round_trip"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return bounded(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>, n_tokens int, round_trip boolean")


def decode(rows: DataFrame, model: bytes) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null or empty ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, max(batch.num_rows, 1), 512):
                some = batch.slice(lo, 512)
                lists = [x or [] for x in some.column("ids").to_pylist()]
                flat = np.array([i for x in lists for i in x], np.int32)
                text = decode_ids(flat, np.cumsum([len(x) for x in lists], dtype=np.int64), model)
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), text.cast(pa.string())], names=["doc_id", "text"])

    return bounded(rows).select("doc_id", "ids").mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


#: Texts that ``parity`` compares at once.
AT_ONCE = 64


def parity(docs: DataFrame, model: bytes, threads: int = 2) -> DataFrame:
    """The doc_id of every text for which the SentencePiece library gives other ids, or another text back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        _threads(threads)
        library = sentencepiece.SentencePieceProcessor(model_proto=model)
        for batch in batches:
            for lo in range(0, batch.num_rows, AT_ONCE):  # lists of numbers take many times the texts' memory
                some = batch.slice(lo, AT_ONCE)
                texts = some.column("text").fill_null("").to_pylist()
                ids = encode_texts(texts, model)
                theirs = library.encode(texts, num_threads=threads)
                back = decode_ids(np.concatenate(ids), np.cumsum([len(x) for x in ids], dtype=np.int64), model).to_pylist()
                bad = [a.tolist() != b or t != u for a, b, t, u in zip(ids, theirs, back, library.decode(theirs), strict=True)]
                yield pa.RecordBatch.from_arrays([some.column("doc_id").filter(pa.array(bad, pa.bool_()))], names=["doc_id"])

    return bounded(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}")
