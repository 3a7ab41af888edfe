"""Toxicity by a linear-chain conditional random field over tokens.

Labels are of documents, so tokens are labelled first: a word that is much more
frequent in toxic documents than in others is toxic where it stands in a toxic
document (it has to be so in many different surroundings, as copies say nothing), and every token of another document is not.  A two-state chain (emission
weights for words and for their strength, transition and start weights) is fitted to
these tokens by gradient ascent on its likelihood.  Forward-backward marginals tag
tokens; a document's score is a logistic function of the chance that any of its tokens
is toxic, fitted to the documents' labels.

The model is fitted on a bounded sample of labelled rows (``SAMPLE`` of each label, and
for the chain as many of these as make up ``CHAIN_TOKENS``), in the order of a hash of
their ids, whatever their length.  Scoring
goes once through all texts; the recursions run over all tokens of a block at once, as
products of 2 x 2 matrices in rows of about a square root of their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.llm.exchange import bounded, settled
from notelake.llm.text import Texts, lower_ascii, mix, text_blocks, word_hash, words

#: Labelled rows of each label that the model learns from at most.
SAMPLE = 10_000
#: Words of each label's documents, about, that the chain is fitted to.
CHAIN_TOKENS = 60_000
#: How much more frequent in toxic documents a word of the lexicon is at least.
MIN_RATIO = 8.0
#: Bytes of the beginnings of words that are features.
BEGINNINGS = (5, 6, 7, 8)
#: The log-likelihood ratio that a word needs above twice the logarithm of the number of words looked at.
MIN_SURPLUS = 4.0

_EDGE = np.zeros(256, bool)
_EDGE[[i for i in range(33, 127) if not chr(i).isalnum()]] = True


def tokens(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, text and hash of each word, in lower case and without outer punctuation."""
    start, end, doc = words(t)
    start, end = start.copy(), end.copy()
    live = np.flatnonzero(_EDGE[t.data[start]]) if len(start) else start
    while len(live):
        start[live] += 1
        live = live[start[live] < end[live]]
        live = live[_EDGE[t.data[start[live]]]]
    live = np.flatnonzero(start < end)
    live = live[_EDGE[t.data[end[live] - 1]]]
    while len(live):
        end[live] -= 1
        live = live[_EDGE[t.data[end[live] - 1]]]
    some = start < end
    start, end, doc = start[some], end[some], doc[some]
    return start, end, doc, word_hash(lower_ascii(t.data), start, end)


def features(t: Texts, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Hashes of each word's features, a row for each kind: the word, and its beginnings if it goes on after them (else 0)."""
    data = lower_ascii(t.data)
    out = [h | np.uint64(1)]
    for k in BEGINNINGS:
        at = np.flatnonzero(end - start > k)
        row = np.zeros(len(h), np.uint64)
        row[at] = mix(word_hash(data, start[at], start[at] + k) + np.uint64(k)) | np.uint64(1)
        out.append(row)
    return np.stack(out)


def _find(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Place of each hash in the table, its length for those that are not there."""
    if not len(table):
        return np.zeros(h.shape, np.int64)
    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return np.where(table[at] == h, at, len(table))


@dataclass
class Model:
    """Lexicon (sorted hashes of features), their weights and strengths, and the weights of chain and document."""

    lexicon: np.ndarray
    weight: np.ndarray
    strength: np.ndarray
    strong: float
    bias: float
    move: np.ndarray
    start: np.ndarray
    document: np.ndarray

    def emissions(self, found: np.ndarray) -> np.ndarray:
        """Of tokens with these features (places in the lexicon)."""
        return self.bias + np.append(self.weight, 0.0)[found].sum(0) + self.strong * np.append(self.strength, 0.0)[found].max(0)

    def tag(self, t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, end, text and marginal of each token."""
        start, end, doc, h = tokens(t)
        first = np.concatenate([[True], doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, bool)
        e = self.emissions(_find(self.lexicon, features(t, start, end, h))) if len(doc) else np.zeros(0)
        return start, end, doc, marginals(e, first, self.move, self.start)[0]


def _steps(e: np.ndarray, first: np.ndarray, move: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Matrix of each token: [to, from]; at the first token of a text whatever came before counts alike."""
    e = np.clip(e, -30, 30)
    weight = np.stack([np.exp(-np.maximum(e, 0)), np.exp(np.minimum(e, 0))])  # the two states, the larger one 1
    m = np.exp(move.T)[:, :, None] * weight[:, None, :]
    s = np.exp(start)[:, None] * weight
    return np.where(first, s[:, None, :], m)


def _scan(m: np.ndarray, back: bool) -> np.ndarray:
    """Forward (back: backward) vectors of a sequence of step matrices, each up to a factor; shape (2, n)."""
    n = m.shape[2]
    if back:
        # beta[t] = transposed m[t+1] beta[t+1]
        m = np.concatenate([np.transpose(m, (1, 0, 2))[:, :, 1:], np.ones((2, 2, 1))], axis=2)[:, :, ::-1]
    width = max(int(np.sqrt(n)), 1)
    rows = -(-n // width)
    m = np.concatenate([m, np.broadcast_to(np.eye(2)[:, :, None], (2, 2, rows * width - n))], axis=2).reshape(2, 2, rows, width)
    (a, b), (c, d) = m
    p = [np.ones(rows), np.zeros(rows), np.zeros(rows), np.ones(rows)]
    for j in range(width):  # the product of each row
        x, y, z, w = p
        aj, bj, cj, dj = a[:, j], b[:, j], c[:, j], d[:, j]
        x, y, z, w = aj * x + bj * z, aj * y + bj * w, cj * x + dj * z, cj * y + dj * w
        top = np.maximum(np.maximum(x, y), np.maximum(z, w))
        p = [x / top, y / top, z / top, w / top]
    u, v = 1.0, 1.0
    enter = np.empty((2, rows))
    for r, (x, y, z, w) in enumerate(zip(*(q.tolist() for q in p), strict=True)):
        enter[:, r] = u, v
        u, v = x * u + y * v, z * u + w * v
        u, v = u / (u + v), v / (u + v)
    out = np.empty((2, rows, width))
    u, v = enter
    for j in range(width):
        u, v = a[:, j] * u + b[:, j] * v, c[:, j] * u + d[:, j] * v
        s = u + v
        u, v = u / s, v / s
        out[0, :, j], out[1, :, j] = u, v
    out = out.reshape(2, -1)[:, :n]
    return out[:, ::-1] if back else out


def marginals(e: np.ndarray, first: np.ndarray, move: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chance of the toxic state for each token, and the forward and backward vectors."""
    if not len(e):
        return np.zeros(0), np.zeros((2, 0)), np.zeros((2, 0))
    m = _steps(e, first, move, start)
    alpha, beta = _scan(m, False), _scan(m, True)
    p = alpha * beta
    return p[1] / p.sum(0), alpha, beta


def fit_chain(feature: np.ndarray, strength: np.ndarray, n_features: int, first: np.ndarray, y: np.ndarray, rounds: int = 150) -> tuple[np.ndarray, float, float, np.ndarray, np.ndarray]:
    """Weights of features, of strength, bias, transitions and start that maximise the likelihood of ``y``.

    ``feature``: places of each token's features in the lexicon, a row for each kind, ``n_features`` for none.
    """
    w, move, start = np.zeros(n_features + 1), np.zeros((2, 2)), np.zeros(2)
    strong, bias = 0.0, 0.0
    n = len(y)
    pairs = np.flatnonzero(~first)
    real = np.zeros((2, 2))
    np.add.at(real, (y[pairs - 1], y[pairs]), 1)
    begin = np.bincount(y[first], minlength=2)
    state: list = [[0.0, 0.0] for _ in range(5)]
    for step in range(1, rounds + 1):
        e = w[feature].sum(0) + strong * strength + bias
        p, alpha, beta = marginals(e, first, move, start)
        m = _steps(e, first, move, start)[:, :, pairs]
        joint = m * alpha[None, :, pairs - 1] * beta[:, None, pairs]  # [to, from]
        joint = (joint / joint.sum((0, 1))).sum(2).T
        short = np.stack([1 - p[first], p[first]]).sum(1)
        miss = y - p
        grads = [
            np.append(np.bincount(feature.ravel(), np.broadcast_to(miss, feature.shape).ravel(), minlength=n_features + 1)[:n_features], 0.0) - 0.1 * w,
            float((miss * strength).sum()),
            float(miss.sum()),
            real - joint - 0.02 * move,
            begin - short - 0.02 * start,
        ]
        values = [w, strong, bias, move, start]
        for i, g in enumerate(grads):  # Adam
            g = g / max(n, 1) ** 0.5
            state[i][0] = 0.9 * state[i][0] + 0.1 * g
            state[i][1] = 0.99 * state[i][1] + 0.01 * g * g
            values[i] = values[i] + 0.2 * (state[i][0] / (1 - 0.9**step)) / (np.sqrt(state[i][1] / (1 - 0.99**step)) + 1e-8)
        w, strong, bias, move, start = values
    return w[:n_features], float(strong), float(bias), move, start


def document_inputs(p: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Log odds that any token of each text is toxic, log of the expected number of toxic tokens and of the number of all."""
    none = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=n_docs)
    any_ = np.clip(-np.expm1(none), 1e-6, 1 - 1e-6)
    expected = np.bincount(doc, p, minlength=n_docs)
    return np.stack([np.log(any_ / (1 - any_)), np.log(expected + 1e-3), np.log1p(np.bincount(doc, minlength=n_docs))])


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the inputs (rows of x) and of 1, by damped Newton steps with a weak prior."""
    x = np.vstack([x, np.ones(x.shape[1])])
    w = np.zeros(len(x))
    for _ in range(60):
        s = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
        h = (x * (s * (1 - s) + 1e-6)) @ x.T + 0.1 * np.eye(len(x))
        w = w + np.clip(np.linalg.solve(h, x @ (y - s) - 0.1 * w), -1, 1)
    return w


def document_score(model: Model, inputs: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model.document[:-1] @ inputs + model.document[-1], -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE, chain_tokens: int = CHAIN_TOKENS) -> Model:
    """A model from the labelled rows where ``learn`` (an expression of doc_id) holds.

    Labels other than 0 and 1 are ignored; of several labels of a document the largest
    counts.  Without rows of both labels the score is the constant (toxic + 1) / (all + 2).
    Texts of the same words (whatever the case and blanks) and label count once.
    """
    known = labels.filter("toxic in (0, 1) and doc_id is not null").filter(learn).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    mark = F.xxhash64("doc_id")
    some = known.filter("toxic = 1").orderBy(mark, "doc_id").limit(sample).union(known.filter("toxic = 0").orderBy(mark, "doc_id").limit(sample))
    rows = bounded(docs).select("doc_id", "text").join(F.broadcast(some), "doc_id").select("doc_id", "text", "toxic")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column("toxic").to_numpy()
            hs, ts, ns = [np.zeros(1, np.uint64)], [np.zeros(1)], [np.zeros(1)]
            for t in text_blocks(batch.column("text")):
                start, end, doc, h = tokens(t)
                size = np.bincount(doc, minlength=len(t))
                h = features(t, start, end, h)
                doc = np.broadcast_to(doc, h.shape)[h > 0]
                h = h[h > 0]
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.zeros(0, bool)
                h, doc = h[new], doc[new]
                weight, bad = np.minimum(1.0, 200 / np.maximum(size[doc], 1)), toxic[t.first + doc] > 0
                hs.append(h)
                ts.append(weight * bad)
                ns.append(weight * ~bad)
                # the row of hash 0 sums up the documents themselves
                hs.append(np.zeros(len(t), np.uint64))
                each = np.minimum(1.0, 200 / np.maximum(size, 1))
                ts.append(each * (toxic[t.first : t.first + len(t)] > 0))
                ns.append(each * (toxic[t.first : t.first + len(t)] == 0))
            h, where = np.unique(np.concatenate(hs), return_inverse=True)
            yield pa.RecordBatch.from_pydict({"h": h.view(np.int64), "t": np.bincount(where, np.concatenate(ts)), "n": np.bincount(where, np.concatenate(ns))})

    # copies of a whole text count once for each label; what near copies share stands in few surroundings, see below
    same = F.sha2(F.trim(F.regexp_replace(F.lower("text"), r"[ \t-\r]+", " ")), 256)
    single = rows.groupBy(same.alias("same"), "toxic").agg(F.min("text").alias("text"))
    weights = single.select("text", "toxic").mapInArrow(weigh, "h bigint, t double, n double").groupBy("h").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    all_ = weights.filter("h = 0").collect()
    count = some.groupBy("toxic").count().collect()
    number = {r["toxic"]: r["count"] for r in count}
    prior = (number.get(1, 0) + 1) / (sum(number.values()) + 2)
    constant = Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), 0.0, -20.0, np.zeros((2, 2)), np.zeros(2), np.array([0.0, 0.0, 0.0, np.log(prior / (1 - prior))]))
    if not number.get(0) or not number.get(1) or not all_ or not all_[0]["t"] or not all_[0]["n"]:
        return constant
    weights = settled(weights.filter("h <> 0"))
    toxic_weight, other_weight = all_[0]["t"], all_[0]["n"]
    share = toxic_weight / (toxic_weight + other_weight)
    t, n = F.col("t") + 1e-9, F.col("n") + 1e-9
    needed = 2 * float(np.log(max(weights.count(), 1))) + MIN_SURPLUS
    ratio = (F.col("t") + 0.5) / (F.col("n") + 0.5) * F.lit(other_weight / toxic_weight)

    def surprise(t: Column, n: Column) -> Column:
        t, n = t + 1e-9, n + 1e-9
        return 2 * (t * F.log(t / ((t + n) * share)) + n * F.log(n / ((t + n) * (1 - share))))

    found = weights.withColumn("ratio", ratio).filter((F.col("ratio") >= MIN_RATIO) & (surprise(F.col("t"), F.col("n")) >= needed)).select("h", "ratio").toPandas()
    if not len(found):
        return constant
    strengths = dict(zip(found["h"].tolist(), found["ratio"].tolist(), strict=True))
    chosen = np.sort(found["h"].to_numpy(np.int64).view(np.uint64))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column("toxic").to_numpy()
            for t in text_blocks(batch.column("text")):
                start, end, doc, h = tokens(t)
                if not len(h):
                    continue
                f = features(t, start, end, h)
                # neighbours in the same text only: others would make each copy's first and last word look new
                one = doc[1:] == doc[:-1]
                around = mix(np.concatenate([np.zeros(1, np.uint64), np.where(one, h[:-1], np.uint64(0))])) ^ np.concatenate([np.where(one, h[1:], np.uint64(0)), np.zeros(1, np.uint64)])
                kind, at = np.nonzero(_find(chosen, f) < len(chosen))
                yield pa.RecordBatch.from_pydict({"h": f[kind, at].view(np.int64), "around": around[at].view(np.int64), "toxic": pa.array(toxic[t.first + doc[at]], pa.int32())})

    # a toxic word stands between ever new neighbours; the words of copies that were missed don't
    each = rows.select("text", "toxic").mapInArrow(contexts, "h bigint, around bigint, toxic int").distinct().groupBy("h").agg(F.sum("toxic").cast("double").alias("t"), F.sum(1 - F.col("toxic")).cast("double").alias("n"))
    found = each.filter(surprise(F.col("t"), F.col("n")) >= needed).filter(ratio >= MIN_RATIO).select("h").collect()
    if not found:
        return constant
    lexicon = np.sort(np.array([r["h"] for r in found], np.int64).view(np.uint64))
    strength = np.log(np.array([strengths[v] for v in lexicon.view(np.int64).tolist()]))
    # a row for each sampled document: in the order of the sample as many as make up the words wanted, the last one whole
    sized = rows.groupBy("doc_id", "toxic").agg(F.sum(F.size(F.split("text", " "))).alias("n")).orderBy("toxic", mark, "doc_id").collect()
    behind, chosen_ids = {0: 0, 1: 0}, []
    for r in sized:
        if behind[r["toxic"]] < chain_tokens:
            chosen_ids.append((r["doc_id"],))
        behind[r["toxic"]] += r["n"] or 0
    taken = docs.sparkSession.createDataFrame(chosen_ids, "doc_id bigint")
    texts = rows.join(F.broadcast(taken), "doc_id").select("doc_id", "text", "toxic").distinct().orderBy("toxic", mark, "doc_id", "text").select("text", "toxic").collect()
    column, toxic = pa.array([r["text"] or "" for r in texts], pa.large_string()), np.array([r["toxic"] for r in texts])
    founds, firsts, ys = [], [], []
    for t in text_blocks(column):
        start, end, doc, h = tokens(t)
        found_ = _find(lexicon, features(t, start, end, h)) if len(doc) else np.zeros((1 + len(BEGINNINGS), 0), np.int64)
        founds.append(found_)
        firsts.append(np.concatenate([[True], doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, bool))
        ys.append(((found_ < len(lexicon)).any(0) & (toxic[t.first + doc] > 0)).astype(int))
    feature, first, y = np.concatenate(founds, axis=1), np.concatenate(firsts), np.concatenate(ys)
    if not len(y):
        return constant
    w, strong, bias, move, start = fit_chain(feature, np.append(strength, 0.0)[feature].max(0), len(lexicon), first, y)
    model = Model(lexicon, w, strength, strong, bias, move, start, constant.document)

    def inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in text_blocks(batch.column("text")):
                _, _, doc, p = model.tag(t)
                a, b, c = document_inputs(p, doc, len(t))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c), batch.column("toxic").slice(t.first, len(t))], names=["a", "b", "c", "toxic"])

    seen = rows.select("text", "toxic").mapInArrow(inputs, "a double, b double, c double, toxic int").toPandas()
    model.document = _logistic(seen[["a", "b", "c"]].to_numpy().T, seen["toxic"].to_numpy(float))
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """Score, verdict and toxic spans of each row of ``docs``.

    Needs doc_id and text; others are ignored, whatever their names.  A null or empty
    text has no token and the score of a text without toxic tokens.  Rows stay one to
    one; an empty table gives an empty result.

    Returns doc_id, score, predicted (score >= threshold), spans (array of first and
    last byte's place, half open, in UTF-8, and marginal of tokens above one half).
    """
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, lists = [np.zeros(0)], []
            for t in text_blocks(batch.column("text")):
                start, end, doc, p = model.tag(t)
                scores.append(document_score(model, document_inputs(p, doc, len(t))))
                at = np.flatnonzero(p > 0.5)
                runs = pa.StructArray.from_arrays([pa.array(start[at] - t.offsets[doc[at]], pa.int64()), pa.array(end[at] - t.offsets[doc[at]], pa.int64()), pa.array(p[at])], fields=list(span))
                lists.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[at], np.arange(len(t) + 1)), pa.int32()), runs))
            s = np.concatenate(scores)
            spans = pa.concat_arrays(lists) if lists else pa.array([], pa.list_(span))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32)), spans], names=["doc_id", "score", "predicted", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return bounded(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int, spans array<struct<start: bigint, end: bigint, p: double>>")


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text is divisible by 5; null ids are held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))
