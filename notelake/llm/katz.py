"""Language-model scoring: Katz backoff with Good-Turing discounts.

Words and one end token per text are the tokens; the model has bigrams over unigrams
over one unknown token:

    P(w)     = d_c(w) c(w) / N                      for seen w; what is left goes to the unknown token
    P(w | h) = d_c(hw) c(hw) / c(h)                 for seen h w
             = alpha(h) P(w)                        else, with P(. | h) summing to 1 exactly
    P(w | h) = P(w)                                 for unseen h

Counts live in tables that are partitioned by hash range.  A chunk of documents asks
for its distinct tokens, and then for its distinct bigrams, once each; a range adds up
the training counts in the questions and answers with the corpus counts, so counting
and scoring share one exchange for each order.  Contexts that make up more than
``HOT_SHARE`` of all tokens (a bounded number) are spread over all ranges by bigram
and their sums are put together afterwards; all others are summed where their bigrams
lie.  Everything gathered grows with the corpus; only counts of counts, the most
frequent tokens and a row for each hot context reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.llm import exchange as X
from notelake.llm.text import lower_ascii, mix, text_blocks, word_hash, words

U64 = np.uint64
#: Counts up to K are discounted.
K = 5
#: Share of all training tokens from which on a context is spread.
HOT_SHARE = 0.0005
#: Input of one chunk, by what ``exchange`` gives chunks.
CHUNK_SHARE = 8 / 3
END, BEGIN = U64(0x1F83D9ABFB41BD6B), U64(0x5BE0CD19137E2179)

_ASK = "bucket int, chunk int, kind int, payload binary"
_TELL = "chunk int, bucket int, kind int, payload binary"


@dataclass
class Discounts:
    """Share of a count's mass that seen events with this count keep."""

    keep: np.ndarray  # by count, 0..K; larger counts keep all

    def of(self, count: np.ndarray) -> np.ndarray:
        return np.where(count <= K, self.keep[np.minimum(count, K).astype(np.int64)], 1.0)

    @classmethod
    def good_turing(cls, n: np.ndarray) -> Discounts:
        """From the numbers n[r] of events seen r times, r = 0..K+1.

        Katz's discounts where all of them lie in (0, 1).  Else, as documents in several
        copies make some counts too frequent, n[r] is smoothed first to a power of r
        (simple Good-Turing, steeper than 1/r), for which they always do.
        """
        r = np.arange(1, K + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            tail = (K + 1) * n[K + 1] / n[1]
            d = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail)
        if not (np.isfinite(d).all() and (d > 0).all() and (d < 1).all()):
            some = np.flatnonzero(n[1:]) + 1
            slope = np.polyfit(np.log(some), np.log(n[some]), 1)[0] if len(some) > 1 else -2.0
            power = 1 + min(slope, -1.05)
            tail = float(K + 1) ** power
            d = (((r + 1) / r) ** power - tail) / (1 - tail)
        return cls(np.concatenate([[0.0], d]))


@dataclass
class Unigrams:
    tokens: int
    types: int
    texts: int
    discounts: Discounts
    left: float

    def p(self, count: np.ndarray) -> np.ndarray:
        """Probability of tokens with these counts; 0: of the unknown token."""
        whole = self.tokens + (self.left <= 0)  # nothing discounted: as if one unknown token had been seen
        return np.where(count > 0, self.discounts.of(count) * count / whole, (self.left if self.left > 0 else 1.0) / whole)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1) / (self.tokens + 1 * (self.types + 1)))


class _Chunk:
    """Tokens of a chunk's texts: distinct ones, and which of them each token and its context are."""

    def __init__(self, table: pa.Table):
        hs, ds, ids, trains, n = [], [], [], [], 0
        for part in X.dealt_rows(table):
            ids.append(part.column("doc_id").combine_chunks())
            trains.append(part.column("train").to_numpy())
            for t in text_blocks(part.column("text")):
                start, end, doc = words(t)
                h = np.empty(len(start) + len(t), U64)
                h[np.arange(len(start)) + doc] = word_hash(lower_ascii(t.data), start, end)
                size = np.bincount(doc, minlength=len(t)) + 1
                h[np.cumsum(size) - 1] = END
                hs.append(h)
                ds.append(np.repeat(np.arange(len(t)) + n + t.first, size))
            n += part.num_rows
        self.ids = pa.chunked_array(ids) if ids else None
        self.train = np.concatenate(trains) if trains else np.zeros(0, bool)
        h, self.doc = np.concatenate(hs) if hs else np.zeros(0, U64), np.concatenate(ds).astype(np.int32) if ds else np.zeros(0, np.int32)
        del hs, ds
        self.n_docs = n
        self.distinct, number = np.unique(h, return_inverse=True)
        self.token = number.astype(np.int32)
        first = np.concatenate([[True], self.doc[1:] != self.doc[:-1]]) if n else np.zeros(0, bool)
        self.context = np.empty_like(self.token)
        self.context[1:] = self.token[:-1]
        self.context[first] = len(self.distinct)  # the beginning
        self.of_train = self.train[self.doc] if n else np.zeros(0, bool)

    def counts(self) -> np.ndarray:
        return np.bincount(self.token[self.of_train], minlength=len(self.distinct))

    def pairs(self, spread: Callable[[np.ndarray], np.ndarray], ranges: int) -> None:
        """Distinct bigrams in the order of the questions: kind (spread or not), range, context, hash."""
        code = self.context.astype(np.int64) * (len(self.distinct) + 1) + self.token
        code, where = np.unique(code, return_inverse=True)
        context, token = code // (len(self.distinct) + 1), code % (len(self.distinct) + 1)
        del code
        h = np.append(self.distinct, BEGIN)
        with np.errstate(over="ignore"):
            pair = mix(mix(h[context]) + self.distinct[token] * U64(0x9E3779B97F4A7C15))
        hot = spread(context)
        group = np.where(hot, pair, mix(h[context] ^ U64(0x3C6EF372FE94F82B)))
        bucket = X.bucket_of(group, ranges)
        order = np.lexsort((pair, group, bucket, hot))
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        self.pair_of = place[where]
        del where, place, group
        self.hot, self.bucket, self.pair_context, self.pair_token, self.pair = hot[order], bucket[order].astype(np.int64), context[order], token[order], pair[order]
        self.pair_count = np.bincount(self.pair_of[self.of_train], minlength=len(order))


def _low(pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """48 bits of each bigram's hash, which tell the words after one context apart, as two columns."""
    return (pair & U64(0xFFFFFFFF)).astype(np.uint32), ((pair >> U64(32)) & U64(0xFFFF)).astype(np.uint16)


def _joined(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(U64) | (high.astype(U64) << U64(32))


def _table(rows: list[tuple], schema: str) -> pa.Table:
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.binary() if x.endswith("binary") else pa.int32() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.table({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)})


def _cuts(x: np.ndarray) -> np.ndarray:
    """Bounds of the runs of equal values."""
    return np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1, [len(x)]]) if len(x) else np.zeros(1, np.int64)


def _asked(table: pa.Table, *kinds: object) -> tuple[list[int], list[list[np.ndarray]]]:
    return table.column("chunk").to_pylist(), [X.stretch(p, *kinds) for p in table.column("payload")]


def _fold(keys: list[np.ndarray], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by keys (most significant last), place of each distinct one's first entry, and its summed count for each entry."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    number = np.cumsum(new) - 1
    total = np.bincount(number, counts[order], minlength=1)
    out = np.empty(len(order), np.int64)
    out[order] = total[number] if len(number) else 0
    return order, np.flatnonzero(new), out


def _stats(kind: int, *arrays: np.ndarray) -> tuple:
    return (-1, -1, kind, X.squeeze(*arrays))


def _totals(told: DataFrame, size: int, *kinds: type) -> np.ndarray:
    """Sum of the statistics of all hash ranges, added up by the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for x in batch.column("payload"):
                total += np.concatenate(X.stretch(x, *kinds))
        yield pa.RecordBatch.from_pydict({"n": pa.array([total.tolist()], pa.list_(pa.int64()))})

    parts = told.filter("kind = 9").select("payload").mapInArrow(run, "n array<bigint>")
    rows = parts.select(F.posexplode("n").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).orderBy("i").collect()
    return np.array([r["n"] for r in rows], np.int64) if rows else np.zeros(size, np.int64)


def score(docs: DataFrame, train: Column | None = None, chunk_bytes: int | None = None) -> DataFrame:
    """Scores of each text, from a model of the rows where ``train`` holds (default: those whose crc32(doc_id) mod 7 is not 2).

    Needs doc_id and text; others are ignored, whatever their names.  A null or empty
    text is one end token.  A null doc_id counts as training.  Repeated rows count as
    often as they occur; an empty table gives an empty result.  Without training rows
    every token has probability 1 to the unknown token.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False)) if train is None else ~F.coalesce(train, F.lit(False))
    kind = docs.schema["doc_id"].dataType.simpleString()
    plain = X.bounded(docs).select("doc_id", "text", (~held).alias("train"))
    chunks, ranges = X.chunk_count(docs.select("doc_id", "text"), chunk_bytes, CHUNK_SHARE)
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spark = docs.sparkSession
    dealt = X.deal(plain, F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(chunks)).cast("int"), partitions)
    X.release(spark)

    # tokens: each chunk's distinct ones with its training counts; answered with the corpus counts
    def ask_tokens(key: tuple, table: pa.Table, _: None) -> pa.Table:
        c = _Chunk(table)
        n, bucket = c.counts().astype(np.uint32), X.bucket_of(c.distinct, ranges)
        rows = [(int(bucket[a]), key[0].as_py(), 0, X.squeeze(c.distinct[a:b], n[a:b])) for a, b in zip(_cuts(bucket), _cuts(bucket)[1:], strict=False)]
        return _table([*rows, (0, key[0].as_py(), 1, X.squeeze(np.array([c.train.sum()], np.int64)))], _ASK)

    def tell_tokens(key: tuple, table: pa.Table) -> pa.Table:
        of = table.column("kind").to_numpy()
        texts = sum(int(X.stretch(p, np.int64)[0][0]) for p in table.filter(pa.array(of == 1)).column("payload"))
        asked = table.filter(pa.array(of == 0))
        owners, parts = _asked(asked, U64, np.uint32)
        if not parts:
            return _table([_stats(9, np.array([0, 0, texts], np.int64), np.zeros(K + 2, np.int64))], _TELL)
        h, n = (np.concatenate([p[i] for p in parts]) for i in range(2))
        order, first, total = _fold([h], n)
        types = total[order[first]]
        seen = types[types > 0]
        often = np.flatnonzero(types >= max(HOT_SHARE * seen.sum(), 1))  # what is hot in the corpus is so in its range
        rows = [_stats(9, np.array([seen.sum(), len(seen), texts], np.int64), np.bincount(np.minimum(seen, K + 2), minlength=K + 3)[: K + 2].astype(np.int64)), _stats(8, h[order[first[often]]], types[often])]
        lo = 0
        for chunk, p in zip(owners, parts, strict=True):
            rows.append((chunk, key[0].as_py(), 0, X.squeeze(total[lo : lo + len(p[0])])))
            lo += len(p[0])
        return _table(rows, _TELL)

    told = X.settled(X.with_answers(dealt, None, ask_tokens, _ASK).groupBy("bucket").applyInArrow(tell_tokens, _TELL))
    X.release(spark)
    (tokens, types, texts), counts = np.split(_totals(told, 3 + K + 2, np.int64, np.int64), [3])
    tokens, types, texts = int(tokens), int(types), int(texts)

    def often_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column("payload"):
                h, n = X.stretch(x, U64, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)[n >= least])], names=["h"])

    least = max(HOT_SHARE * tokens, 1)
    frequent = told.filter("kind = 8").select("payload").mapInArrow(often_rows, "h bigint").collect()  # 1 / HOT_SHARE rows at most
    discounts = Discounts.good_turing(counts.astype(float))
    left = float((counts[1 : K + 1] * np.arange(1, K + 1) * (1 - discounts.keep[1:])).sum())
    model = Unigrams(tokens, types, texts, discounts, left)
    hot = np.sort(np.append(np.array([r["h"] for r in frequent], np.int64).view(U64), BEGIN))

    def spread(c: _Chunk) -> Callable[[np.ndarray], np.ndarray]:
        h = np.append(c.distinct, BEGIN)
        is_hot = hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h
        return lambda context: is_hot[context]

    def answered(answer: pa.Table, kind: int, *kinds: object) -> list[list[np.ndarray]]:
        """Payloads of one kind in the order of the questions."""
        some = answer.filter(pa.array(answer.column("kind").to_numpy() == kind))
        some = some.take(pa.array(np.argsort(some.column("bucket").to_numpy(), kind="stable")))
        return [X.stretch(p, *kinds) for p in some.column("payload")]

    def token_counts(answer: pa.Table) -> np.ndarray:
        found = answered(answer, 0, np.int64)
        return np.concatenate([x[0] for x in found]) if found else np.zeros(0, np.int64)

    # bigrams: each chunk's distinct ones, with their word's corpus count for the sum of P(w) over a context's words
    def ask_pairs(key: tuple, table: pa.Table, answer: pa.Table) -> pa.Table:
        c, n = _Chunk(table), token_counts(answer)
        c.pairs(spread(c), ranges)
        h = np.append(c.distinct, BEGIN)
        word, count = n[c.pair_token].astype(np.uint32), c.pair_count.astype(np.uint32)
        rows = []
        cut = _cuts(c.bucket * 2 + c.hot)
        for a, b in zip(cut, cut[1:], strict=False):
            context = h[c.pair_context[a:b]]
            if c.hot[a]:
                rows.append((int(c.bucket[a]), key[0].as_py(), 2, X.squeeze(np.searchsorted(hot, context).astype(np.uint16), *_low(c.pair[a:b]), word[a:b], count[a:b])))
            else:
                runs = _cuts(context)
                rows.append((int(c.bucket[a]), key[0].as_py(), 1, X.squeeze(context[runs[:-1]], np.diff(runs).astype(np.uint32), *_low(c.pair[a:b]), word[a:b], count[a:b])))
        return _table(rows, _ASK)

    def sums(group: np.ndarray, n_groups: int, first: np.ndarray, order: np.ndarray, total: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each context: how many words follow it 1..K times, and the sum of P over the words that follow it."""
        one = order[first]
        one = one[total[one] > 0]
        few = total[one] <= K
        times = np.bincount(group[one][few] * K + total[one][few] - 1, minlength=n_groups * K).reshape(-1, K)
        return times.astype(np.uint32), np.bincount(group[one], model.p(word[one]), minlength=n_groups)

    def tell_pairs(key: tuple, table: pa.Table) -> pa.Table:
        of = table.column("kind").to_numpy()
        rows, n_of = [], np.zeros(K + 2, np.int64)
        owners, parts = _asked(table.filter(pa.array(of == 1)), U64, np.uint32, np.uint32, np.uint16, np.uint32, np.uint32)
        if parts:
            contexts, lengths, low, high, word, count = (np.concatenate([p[i] for p in parts]) for i in range(6))
            pair = _joined(low, high)
            values, of_run = np.unique(contexts, return_inverse=True)
            group = np.repeat(of_run, lengths)
            order, first, total = _fold([pair, group], count)
            times, mass = sums(group, len(values), first, order, total, word)
            n_of += np.bincount(np.minimum(total[order[first]], K + 2), minlength=K + 3)[: K + 2]
            at = run = 0
            for chunk, p in zip(owners, parts, strict=True):
                mine = of_run[run : run + len(p[0])]
                rows.append((chunk, key[0].as_py(), 1, X.squeeze(total[at : at + len(p[2])].astype(np.uint32), times[mine].ravel(), mass[mine])))
                at, run = at + len(p[2]), run + len(p[0])
        owners, parts = _asked(table.filter(pa.array(of == 2)), np.uint16, np.uint32, np.uint16, np.uint32, np.uint32)
        if parts:
            group, low, high, word, count = (np.concatenate([p[i] for p in parts]) for i in range(5))
            group, pair = group.astype(np.int64), _joined(low, high)
            order, first, total = _fold([pair, group], count)
            times, mass = sums(group, len(hot), first, order, total, word)
            n_of += np.bincount(np.minimum(total[order[first]], K + 2), minlength=K + 3)[: K + 2]
            at = 0
            for chunk, p in zip(owners, parts, strict=True):
                rows.append((chunk, key[0].as_py(), 2, X.squeeze(total[at : at + len(p[0])].astype(np.uint32))))
                at += len(p[0])
        else:
            times, mass = np.zeros((len(hot), K), np.uint32), np.zeros(len(hot))
        n_of[0] = 0
        rows.append(_stats(9, n_of))
        some = np.flatnonzero(mass)
        if len(some):
            rows.append(_stats(8, some.astype(np.int64), times[some].astype(np.int64).ravel(), mass[some]))
        return _table(rows, _TELL)

    told_pairs = X.settled(X.with_answers(dealt, told.filter("kind < 8"), ask_pairs, _ASK).groupBy("bucket").applyInArrow(tell_pairs, _TELL))
    X.release(spark)
    n_of, hot_times, hot_mass = _totals(told_pairs, K + 2, np.int64), np.zeros((len(hot), K)), np.zeros(len(hot))

    def hot_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column("payload"):
                i, t, m = X.stretch(x, np.int64, np.int64, np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(i), *(pa.array(c) for c in t.reshape(-1, K).T), pa.array(m)], names=["i", *times_of, "mass"])

    times_of = [f"t{k}" for k in range(1, K + 1)]
    parts = told_pairs.filter("kind = 8").select("payload").mapInArrow(hot_rows, ", ".join(["i bigint", *(f"{t} bigint" for t in times_of), "mass double"]))
    for r in parts.groupBy("i").agg(*(F.sum(c).alias(c) for c in (*times_of, "mass"))).collect():  # a row for each hot context
        hot_times[r["i"]], hot_mass[r["i"]] = [r[t] for t in times_of], r["mass"]
    pair_discounts = Discounts.good_turing(n_of.astype(float))
    free = np.arange(1, K + 1) * (1 - pair_discounts.keep[1:])  # mass set free by a word that follows 1..K times

    def rate(key: tuple, table: pa.Table, answer: pa.Table) -> pa.Table:
        c, n = _Chunk(table), token_counts(answer)
        c.pairs(spread(c), ranges)
        with_begin = np.append(n, model.texts)
        total = np.zeros(len(c.pair), np.int64)
        n_cold = int((~c.hot).sum())
        freed, mass = np.zeros(len(c.pair)), np.zeros(len(c.pair))
        cold = answered(answer, 1, np.uint32, np.uint32, np.float64)
        if n_cold:
            total[:n_cold] = np.concatenate([x[0] for x in cold])
            runs = _cuts(c.pair_context[:n_cold])
            length = np.diff(runs)
            freed[:n_cold] = np.repeat(np.concatenate([x[1] for x in cold]).reshape(-1, K) @ free, length)
            mass[:n_cold] = np.repeat(np.concatenate([x[2] for x in cold]), length)
        if n_cold < len(total):
            total[n_cold:] = np.concatenate([x[0] for x in answered(answer, 2, np.uint32)])
            i = np.searchsorted(hot, np.append(c.distinct, BEGIN)[c.pair_context[n_cold:]])
            freed[n_cold:], mass[n_cold:] = (hot_times @ free)[i], hot_mass[i]
        before = with_begin[c.pair_context].astype(float)
        none = freed <= 0  # nothing discounted in this context: as if it had been followed once by something new
        whole = before + none
        lower = model.p(n[c.pair_token])
        with np.errstate(divide="ignore", invalid="ignore"):
            higher = pair_discounts.of(total) * total / whole
            alpha = np.where(none, 1.0, freed) / whole / np.maximum(1 - mass, 1e-300)
        p = np.where(before == 0, lower, np.where(total > 0, higher, alpha * lower))
        score_of = np.bincount(c.doc, np.log10(p)[c.pair_of], minlength=c.n_docs) if c.n_docs else np.zeros(0)
        base = np.bincount(c.doc, model.base(n)[c.token], minlength=c.n_docs) if c.n_docs else np.zeros(0)
        known = np.bincount(c.doc, (n > 0)[c.token], minlength=c.n_docs) if c.n_docs else np.zeros(0)
        return pa.table(
            {
                "doc_id": c.ids if c.ids is not None else pa.array([], pa.int64()),
                "held_out": pa.array(~c.train),
                "n_tokens": pa.array(np.bincount(c.doc, minlength=c.n_docs), pa.int64()),
                "n_known": pa.array(known.astype(np.int64)),
                "train_tokens": pa.array(np.full(c.n_docs, model.tokens), pa.int64()),
                "base_score": pa.array(base),
                "score": pa.array(score_of),
            }
        )

    answers = told.filter("kind < 8").unionByName(told_pairs.filter("kind < 8"))
    return X.with_answers(dealt, answers, rate, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
