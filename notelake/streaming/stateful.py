"""Steps with keyed state: sessions that close, and rolling samples (N18, F18, section 2.11).

Both keep a bounded number of rows for each key over micro-batches.  They need the
RocksDB state store (``spark.sql.streaming.stateStore.providerClass``); ``rocksdb`` sets
it for the queries that are started within.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from notelake.operators import signals
from notelake.operators.telemetry import SAMPLES

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started within keep their state in RocksDB; the session's setting comes back."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class _Closing(StatefulProcessor):
    """Holds the surest signals of a session until nothing has come for ``gap_ms``."""

    def __init__(self, gap_ms: int, min_confidence: float, most: int):
        self.gap_ms, self.min_confidence, self.most = gap_ms, min_confidence, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", _HELD)
        self.last = handle.getValueState("last", "ms bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found, latest = list(self.held.get()), self.last.get()[0] if self.last.exists() else None
        before = latest
        for part in rows:
            ms = int(part["ms"].max())
            latest = ms if latest is None else max(latest, ms)
            sure = part[part["confidence"] >= self.min_confidence]  # rows without a signal have none
            found += [(int(a), int(b), str(c), str(d), str(e), float(f), str(g)) for a, b, c, d, e, f, g in sure[_FIELDS].itertuples(index=False)]
        found = sorted(set(found), key=lambda s: (-s[5], s[0], s[1]))[: self.most]
        if found:
            self.held.put(found)
        self.last.update((latest,))
        if before is not None:
            self.handle.deleteTimer(before + self.gap_ms)
        self.handle.registerTimer(latest + self.gap_ms)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        found = list(self.held.get())
        self.held.clear()
        self.last.clear()
        out = pd.DataFrame(found, columns=_FIELDS)
        out.insert(0, "conv_id", key[0])
        out["rank"] = range(1, len(found) + 1)
        yield out

    def close(self) -> None:
        pass


_FIELDS = ["turn", "position", "type", "match", "context", "confidence", "suggested_namespace"]
_HELD = "turn bigint, position int, type string, match string, context string, confidence double, suggested_namespace string"


def closed_sessions(messages: DataFrame, gap: str = "30 minutes", late: str = "1 hour", min_confidence: float = 0.8, most: int = 50) -> DataFrame:
    """The surest signals of each session (conv_id, turn, text, ts), ``most`` at most, once it is closed.

    A session closes when no message has come for ``gap`` of event time; until then its
    signals are held over micro-batches, so how messages are dealt into batches does not
    matter.  Rows later than ``late`` are dropped.  A message after the end opens a
    session anew.  Returns conv_id, ``signals.SIGNALS``' fields, turn and rank.
    """
    ms = int(messages.sparkSession.sql(f"SELECT unix_millis(timestamp_seconds(0) + INTERVAL {gap}) - unix_millis(timestamp_seconds(0))").first()[0])
    each = messages.withWatermark("ts", late).select("conv_id", "turn", "ts", F.explode_outer(signals.detect(F.col("text"))).alias("s"))
    rows = each.select("conv_id", "turn", "ts", F.unix_millis("ts").alias("ms"), "s.*")
    return rows.groupBy("conv_id").transformWithStateInPandas(_Closing(ms, min_confidence, most), f"conv_id bigint, {_HELD}, rank bigint", "Append", "EventTime")


class _Rolling(StatefulProcessor):
    """Holds the latest ``n`` samples of a series."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "us bigint, event_id bigint, value double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [(int(a), int(b), None if c is None else float(c)) for a, b, c in self.held.get()]
        for part in rows:
            held += [(int(a), int(b), None if pd.isna(c) else float(c)) for a, b, c in part[["us", "event_id", "value"]].itertuples(index=False)]
        held = sorted(held, key=lambda r: (-r[0], -r[1]))[: self.n]
        self.held.put(held)
        out = pd.DataFrame(held, columns=["us", "event_id", "value"])
        out.insert(0, "name", key[0])
        out["rank"] = range(1, len(held) + 1)
        yield out

    def close(self) -> None:
        pass


def rolling_samples(obs: DataFrame, n: int = SAMPLES) -> DataFrame:
    """the latest ``n`` samples (name, us: microseconds, event_id, value, rank) of each series that a micro-batch has rows of.

    ``obs``: ts, event_id, name, value.  A sink keeps the last answer of each series; a
    series' state never holds more than ``n`` samples.
    """
    rows = obs.select("name", F.unix_micros("ts").alias("us"), F.col("event_id").cast("long").alias("event_id"), "value").filter("us IS NOT NULL AND event_id IS NOT NULL")
    return rows.groupBy("name").transformWithStateInPandas(_Rolling(n), "name string, us bigint, event_id bigint, value double, rank bigint", "Update", "None")


def by_batch(path: str, stream: str, step: Callable[[DataFrame], DataFrame] = lambda df: df) -> Callable[[DataFrame, int], None]:
    """A batch function that writes each micro-batch's rows once, whatever is replayed.

    Rows lie under their stream and batch, which is the ledger of what has been written;
    a batch that comes again after a failure replaces its own rows and adds none.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = step(batch).withColumns({"stream": F.lit(stream), "batch": F.lit(number).cast("long")})
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stream", "batch").parquet(path)

    return write
