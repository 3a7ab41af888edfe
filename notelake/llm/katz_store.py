"""A stored Katz model of any order: trained once, scores other texts later.

Tables of a model, partitioned by order and bucket:

    grams     k, bucket, gram, p          p(w | h) of seen h w, discounted
    contexts  k, bucket, context, alpha   what seen contexts leave to the order below
    model     order, unknown, buckets     probability of a token that was never seen

``score`` evaluates each token recursively: a seen n-gram's p, or else alpha of its
context (1 where that is unseen) times the value of the order below.  The rules are those
of ``katz``, whose ``score`` trains and scores at once with less exchanged data; for
bigrams both give the same values.

The bucket of an n-gram follows from the token before its last one, which stands in its
context and in all shorter n-grams that it backs off to, down to bigrams.  So a few
buckets at a time are trained or looked up by themselves, in passes over the texts, and
what a pass has exchanged goes before the next one.  Unigrams, which all passes need,
have buckets by their hash.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.functions.tables import settled, unwritten, written
from notelake.llm import exchange as X
from notelake.llm.katz import BEGIN, END, Discounts, K
from notelake.llm.text import lower_ascii, mix, text_blocks, word_hash, words

U64 = np.uint64
#: Buckets that each order's tables are partitioned into.
BUCKETS = 16
#: Stored bytes of texts for each pass, and most passes: from there on a pass takes a share of the texts' n-grams that stays the same.
PASS_BYTES, MAX_PASSES = 1 << 20, 8
_ODD = U64(0xD1342543DE82EF95)


def _sequences(column: pa.Array, order: int) -> Iterator[tuple[int, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """Block by block: first text, text of each token (in the block), and for each order k the hashes of its k-gram and of the k - 1 tokens before it."""
    for t in text_blocks(column):
        start, end, doc = words(t)
        size = np.bincount(doc, minlength=len(t)) + 1
        h, of = np.empty(len(start) + len(t), U64), np.repeat(np.arange(len(t)), size)
        h[np.arange(len(start)) + doc] = word_hash(lower_ascii(t.data), start, end)
        h[np.cumsum(size) - 1] = END
        place = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
        back = [h]  # the token j places before, or the beginning
        for j in range(1, order):
            back.append(np.where(place >= j, np.concatenate([np.zeros(j, U64), h[:-j]])[: len(h)], BEGIN))

        def folded(steps: list[np.ndarray]) -> np.ndarray:
            out = np.zeros(len(steps[0]), U64)
            with np.errstate(over="ignore"):
                for x in steps:
                    out = mix(out * _ODD + x)
            return out

        yield t.first, of, [(folded(back[k - 1 :: -1]), folded(back[k - 1 : 0 : -1]) if k > 1 else np.zeros(len(h), U64)) for k in range(1, order + 1)]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _passes(texts: DataFrame, buckets: int, most: int | None) -> list[tuple[int, int]]:
    """Ranges of buckets, one for each pass over ``texts``."""
    n = min(buckets, most or min(MAX_PASSES, max(1, math.ceil(X.stored_bytes(texts) / PASS_BYTES))))
    return [(i * buckets // n, (i + 1) * buckets // n) for i in range(n)]


def _few(docs: DataFrame, order: int) -> dict[tuple[int, int], int]:
    """How many n-grams of each order k from 2 on occur c times, c up to K + 1: hashes and counts meet packed by hash range."""
    ranges = X.chunk_count(docs)[1]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, levels in _sequences(batch.column("text"), order):
                for k, (gram, _) in enumerate(levels[1:], 2):
                    values, n = np.unique(gram, return_counts=True)
                    yield from X.pack(k, ranges, values, n.astype(np.uint32)).to_batches()

    def add(table: pa.Table) -> pa.Table:
        _, h, n = X.unpack(table, U64, np.uint32)
        _, at = np.unique(h, return_inverse=True)
        c = np.bincount(at, n).astype(np.int64)
        times = np.bincount(np.minimum(c, K + 2), minlength=K + 3)[: K + 2]
        some = np.flatnonzero(times)
        return pa.table({"k": pa.array(np.full(len(some), table.column("chunk")[0].as_py()), pa.int32()), "c": pa.array(some), "n": pa.array(times[some])})

    rows = docs.select("text").mapInArrow(send, X.PACKED).groupBy("bucket", "chunk").applyInArrow(add, "k int, c bigint, n bigint")
    return {(r["k"], r["c"]): r["n"] for r in rows.groupBy("k", "c").agg(F.sum("n").alias("n")).collect()}  # order * (K + 1) rows


def train(docs: DataFrame, folder: str, order: int = 3, buckets: int = BUCKETS, passes: int | None = None) -> None:
    """Counts the n-grams of ``docs`` (text; null: empty) up to ``order`` and writes the model's tables to ``folder``.

    Every row counts.  Without rows every token is unknown, with probability 1.  ``passes``
    over the texts: by default as many as their size asks for.
    """
    spark, docs = docs.sparkSession, X.bounded(docs).select("text")

    def tokens_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, levels in _sequences(batch.column("text"), 1):
                values, n = np.unique(levels[0][0], return_counts=True)
                yield pa.RecordBatch.from_pydict({"gram": _signed(values), "n": pa.array(n, pa.int64())})

    def count(batches: Iterator[pa.RecordBatch], lo: int, hi: int) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, levels in _sequences(batch.column("text"), order):
                bucket = levels[1][1] % U64(buckets)
                mine = np.flatnonzero((bucket >= U64(lo)) & (bucket < U64(hi)))
                bucket, lower = bucket[mine].astype(np.int32), levels[0][0][mine]
                for k, (gram, context) in enumerate(levels[1:], 2):
                    gram, context = gram[mine], context[mine]
                    values, first, n = np.unique(gram, return_index=True, return_counts=True)
                    yield pa.RecordBatch.from_pydict({"k": pa.array(np.full(len(values), k), pa.int32()), "bucket": bucket[first], "gram": _signed(values), "context": _signed(context[first]), "lower": _signed(lower[first]), "n": pa.array(n, pa.int64())})
                    lower = gram

    ones = written(docs.mapInArrow(tokens_of, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("c")))
    few = {(1, r["c"]): r["count"] for r in ones.filter(F.col("c") <= K + 1).groupBy("c").count().collect()}
    if order > 1:
        few |= _few(docs, order)
    X.release(spark)
    keeps = {k: Discounts.good_turing(np.array([0.0, *(few.get((k, r), 0) for r in range(1, K + 2))])).keep for k in range(1, order + 1)}
    keep = lambda k: F.when(F.col("c") <= K, F.element_at(F.array(*(F.lit(float(x)) for x in keeps[k][1:])), F.col("c").cast("int"))).otherwise(F.lit(1.0)) if few else F.lit(1.0)
    tokens, left = ones.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum((1 - keep(1)) * F.col("c")), F.lit(0.0))).first()
    whole = tokens + (left <= 0)
    single = ones.select("gram", (keep(1) * F.col("c") / F.lit(float(whole))).alias("p"))
    _write(single.withColumns({"k": F.lit(1), "bucket": F.pmod("gram", F.lit(buckets)).cast("int")}), f"{folder}/grams", "gram", "overwrite")
    _write(spark.createDataFrame([], "context bigint, alpha double, k int, bucket int"), f"{folder}/contexts", "context", "overwrite")
    for lo, hi in _passes(docs, buckets, passes) if order > 1 else ():
        rows = docs.mapInArrow(lambda batches, lo=lo, hi=hi: count(batches, lo, hi), "k int, bucket int, gram bigint, context bigint, lower bigint, n bigint")
        counts = written(rows.groupBy("k", "bucket", "gram", "context", "lower").agg(F.sum("n").alias("c")))
        X.release(spark)
        below, gone = single, [counts]
        for k in range(2, order + 1):
            mine = counts.filter(F.col("k") == k)
            sums = mine.groupBy("bucket", "context").agg(F.sum("c").alias("total"), F.sum((1 - keep(k)) * F.col("c")).alias("freed"))
            sums = written(sums.withColumn("none", F.col("freed") <= 1e-12))  # nothing discounted: as if the context had been followed once by something new
            held = F.col("total") + F.col("none").cast("int")
            seen = written(mine.join(sums.drop("bucket"), "context").select("bucket", "gram", (keep(k) * F.col("c") / held).alias("p")))
            X.release(spark)
            mass = mine.select("context", "lower").join(below.withColumnRenamed("gram", "lower"), "lower").groupBy("context").agg(F.sum("p").alias("mass"))
            alpha = F.when(F.col("none"), F.lit(1.0)).otherwise(F.col("freed")) / held / F.greatest(1 - F.col("mass"), F.lit(1e-300))
            _write(sums.join(mass, "context").select("context", alpha.alias("alpha"), F.lit(k).alias("k"), "bucket"), f"{folder}/contexts", "context", "append")
            X.release(spark)
            _write(seen.withColumn("k", F.lit(k)), f"{folder}/grams", "gram", "append")
            X.release(spark)
            below, gone = seen.select("gram", "p"), [*gone, sums, seen]
        for x in gone:
            unwritten(x)
    unwritten(ones)
    spark.createDataFrame([(order, (left if left > 0 else 1.0) / whole, buckets)], "order int, unknown double, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/model")


def _write(table: DataFrame, path: str, key: str, mode: str) -> None:
    """Adds rows to a table, in the order of their hashes, whose differences are stored."""
    dealt = table.hint("rebalance", F.col("bucket")).sortWithinPartitions("k", "bucket", key)
    dealt.write.mode(mode).option("parquet.writer.version", "v2").option("compression", "zstd").partitionBy("k", "bucket").parquet(path)


def score(texts: DataFrame, folder: str, passes: int | None = None) -> DataFrame:
    """n_tokens and log10 probability of each row's text by a stored model.

    Each different n-gram of all texts is looked up once; texts meet only its value, so
    the tables are joined with as many rows as there are different n-grams.  N-grams that
    are not seen, and only these, are looked up in the orders below.

    Needs doc_id and text (null: empty, one end token); others are ignored, whatever
    their names.  Equal texts are worked out once; repeated rows stay; an empty table
    gives an empty result.  Joins with the tables are split by Spark where a frequent
    n-gram skews them.  All ``passes`` but the last are worked out here.

    Returns doc_id, n_tokens, score.
    """
    spark: SparkSession = texts.sparkSession
    order, unknown, buckets = spark.read.parquet(f"{folder}/model").first()
    grams = spark.read.schema("gram bigint, p double, k int, bucket int").parquet(f"{folder}/grams")
    contexts = spark.read.schema("context bigint, alpha double, k int, bucket int").parquet(f"{folder}/contexts")
    key = F.substring(F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)), 1, 16)
    plain = X.bounded(texts).select("doc_id", "text").withColumn("key", key)
    names = [f"g{k}" for k in range(1, order + 1)] + [f"c{k}" for k in range(2, order + 1)]
    top = f"g{order}"

    def spread(batches: Iterator[pa.RecordBatch], lo: int, hi: int) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, of, levels in _sequences(batch.column("text"), order):
                bucket = levels[min(1, order - 1)][order > 1] % U64(buckets)
                mine = np.flatnonzero((bucket >= U64(lo)) & (bucket < U64(hi)))
                _, at, n = np.unique(mix(levels[-1][0][mine]) ^ mix(of[mine].astype(U64) + U64(1)), return_index=True, return_counts=True)  # an n-gram of a text once
                at = mine[at]
                columns = [_signed(g[at]) for g, _ in levels] + [_signed(c[at]) for _, c in levels[1:]]
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(first + of[at])), pa.array(n, pa.int64()), *map(pa.array, columns)], names=["key", "n", *names])

    def values(rows: DataFrame, lo: int, hi: int, last: bool) -> DataFrame:
        """The value of each different n-gram."""
        table = lambda t, k: t.filter((F.col("k") == k) & (F.lit(k == 1) | F.col("bucket").between(lo, hi - 1)))
        rest, found, factors = rows.select(*names).dropDuplicates([top]), [], []
        for k in range(order, 0, -1):
            held = f"p{k}"
            rest = rest.join(table(grams, k).select(F.col("gram").alias(f"g{k}"), F.col("p").alias(held)), f"g{k}", "left")
            value: Column = F.col(held) if k > 1 else F.coalesce(held, F.lit(unknown))
            for a in reversed(factors):
                value = F.col(a) * value
            if k > 1:
                # of a seen n-gram nothing else is needed
                later = [f"g{j}" for j in range(1, k)] + [f"c{j}" for j in range(2, k + 1)]
                rest = rest.select(top, held, *factors, *(F.when(F.col(held).isNull(), F.col(c)).alias(c) for c in later))
                if not last:
                    rest = written(rest)
                    gone.append(rest)
                    X.release(spark)
                found.append(rest.filter(F.col(held).isNotNull()).select(top, F.log10(value).alias("log")))
                rest = rest.filter(F.col(held).isNull()).drop(held).join(table(contexts, k).select(F.col("context").alias(f"c{k}"), F.coalesce("alpha", F.lit(1.0)).alias(f"a{k}")), f"c{k}", "left").fillna(1.0, [f"a{k}"]).drop(f"c{k}")
                factors.append(f"a{k}")
            else:
                found.append(rest.select(top, F.log10(value).alias("log")))
        return functools.reduce(DataFrame.unionByName, found)

    single = plain.groupBy("key").agg(F.min("text").alias("text"))
    turns = _passes(texts, buckets, passes)
    if len(turns) > 1:
        single = written(single)
        X.release(spark)
    sums, gone = [], []
    for lo, hi in turns:
        last = (lo, hi) == turns[-1]
        rows = single.mapInArrow(lambda batches, lo=lo, hi=hi: spread(batches, lo, hi), ", ".join(["key binary", "n bigint", *(f"{c} bigint" for c in names)]))
        if len(turns) > 1:
            rows = written(rows)
            gone.append(rows)
            X.release(spark)
        each = values(rows, lo, hi, last)
        mine = rows.select("key", "n", top).join(each, top).groupBy("key").agg(F.sum("n").alias("n_tokens"), F.sum(F.col("n") * F.col("log")).alias("score"))
        if not last:
            mine = settled(mine)
            X.release(spark)
            while gone:
                unwritten(gone.pop())
        sums.append(mine)
    whole = functools.reduce(DataFrame.unionByName, sums)
    if len(sums) > 1:
        whole = whole.groupBy("key").agg(F.sum("n_tokens").alias("n_tokens"), F.sum("score").alias("score"))
    return plain.select("doc_id", "key").join(whole, "key").select("doc_id", "n_tokens", "score")
