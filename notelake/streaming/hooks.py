"""Streaming forms of the event-driven steps (K8, section 2.11, N16-N18).

Each takes and returns DataFrames, streaming or not; ``run`` starts a query with a
checkpoint.  Windows, watermarks and deduplication are additions to what is derived from.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark import InheritableThread
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from notelake import literals as L
from notelake.functions import scalar as S
from notelake.operators import capture, context, lookup, neighbours, signals


def once(events: DataFrame, key: str = "event_id", ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each event once, as far as its repetition is not later than ``late``."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def within(spark: SparkSession, seconds: float, step: Callable[[], object], default: object = None) -> object:
    """K8: what ``step`` returns, or ``default`` once ``seconds`` have gone; its Spark jobs are interrupted then.

    The step runs in a thread of its own under a tag, so no other job of the session is
    touched.  Its own errors are raised.
    """
    tag, out, context = f"within-{uuid.uuid4().hex}", [], spark.sparkContext

    def run() -> None:
        context.addJobTag(tag)
        context.setInterruptOnCancel(True)
        try:
            out.append((step(), None))
        except Exception as e:  # noqa: BLE001  handed to the caller
            out.append((None, e))
        finally:
            context.removeJobTag(tag)

    thread = InheritableThread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    if not out:
        context.cancelJobsWithTag(tag)
        return default
    value, error = out[0]
    if error is not None:
        raise error
    return value


def session_start(m: DataFrame, as_of: Column, project: str, spec: str | None = None, found: DataFrame | None = None, mode: str = "adaptive", fixed: int = 1000) -> DataFrame:
    """N18d, K8: one row with the context that a session begins with.

    The number of records sets the budget; ``found`` (section, rank and fields of records,
    as from ``context.semantic_context``) is added to working memory.
    """
    size = context.budget(lookup.count(m, spec=spec).first().n, mode, fixed)
    held = ["section", "rank", "id", "namespace", "summary", "tags"]
    rows = context.working_memory(m, as_of, size["working_memory"], spec).select(*held, F.lit(None).cast("double").alias("relevance"))
    return context.to_xml(rows if found is None else rows.unionByName(found.select(*held, "relevance")), project)


def prompt_decisions(prompts: DataFrame, auto: float = 0.85, suggest: float = 0.7, column: str = "prompt") -> DataFrame:
    """Each prompt's marker, or else what its signals say: capture at once, suggest or skip.  Row by row, so it streams without state."""
    out = prompts.withColumn("marker", signals.marker(F.col(column))).withColumn("signals", signals.detect(F.col(column)))
    top = F.array_max(F.transform("signals", lambda s: s["confidence"]))
    explicit = F.exists("signals", lambda s: s["type"] == "explicit")
    action = F.when(F.col("marker").isNotNull(), "auto").when(top >= auto, "auto").when((top >= suggest) | explicit, "suggest").otherwise("skip")
    best = F.get(F.sort_array(F.transform("signals", lambda s: F.struct((-s["confidence"]).alias("c"), s["position"].alias("p"), s["suggested_namespace"].alias("n")))), F.lit(0))
    namespace = F.coalesce(F.col("marker.namespace"), F.when(F.col("marker.marker_type") == "remember", F.lit("learnings")), best["n"], F.when(F.col("marker").isNotNull(), F.lit("learnings")))
    return out.withColumns({"action": action, "namespace": namespace})


def tool_captures(events: DataFrame, min_confidence: float = 0.8) -> DataFrame:
    """N16b, N18e: captures from what file tools write, tagged with the file."""
    text = capture.tool_content(F.col("raw"))
    path = F.get_json_object("raw", "$.tool_input.file_path")
    found = events.withColumns({"text": text, "file_path": path}).filter(F.col("text").isNotNull())
    each = found.select("*", F.explode(signals.detect(F.col("text"), min_confidence=min_confidence)).alias("s"))
    body = F.coalesce(F.nullif("s.context", F.lit("")), "s.match")
    return each.select("session_id", F.col("s.suggested_namespace").alias("namespace"), signals.summary(body, 100).alias("summary"), body.alias("content"), F.array(F.lit("auto-captured"), F.lit("post-tool-use"), F.concat(F.lit("file:"), F.element_at(F.split("file_path", "/"), -1))).alias("tags"), S.domain_terms(F.col("file_path")).alias("terms"), F.col("s.confidence").alias("confidence"))


def related(queries: DataFrame, vectors: DataFrame, m: DataFrame, k: int = 3, min_similarity: float = 0.6) -> DataFrame:
    """The k nearest records of each query (query_id, namespace, embedding of a file's terms) that are similar enough.

    Records of two commits can share an id; each is found by its own commit.
    """
    record = F.concat("id", F.lit(" "), "commit_sha").alias("record")
    known = vectors.select("id", "embedding").join(m.select("id", record, "namespace"), "id").select(F.col("record").alias("id"), "namespace", "embedding")
    found = neighbours.nearest(queries, known, k)[0].withColumnRenamed("id", "record").withColumn("similarity", S.recall_similarity(F.col("distance"))).filter(F.col("similarity") >= min_similarity)
    return found.join(m.select(record, "id", "summary", "content", "tags"), "record").drop("record")


def pre_compact_summary(match, context):
    """A short summary of a signal: its match, or context if that is short, without label, 100 characters at most."""
    text = F.when(F.length(match) < 20, F.coalesce(F.nullif(context, F.lit("")), match)).otherwise(match)
    text = S.strip(F.regexp_replace(S.strip(text), r"^(?:\.\.\.|\[\w+\]\s*)", ""))
    return F.when(F.length(text) > 100, F.concat(F.substr(text, F.lit(1), F.lit(97)), F.lit("..."))).otherwise(text)


def windowed_metrics(obs: DataFrame, every: str = "1 minute", late: str = "10 minutes", bounds: list[float] | None = None) -> DataFrame:
    """Counts, sums and buckets of each series in tumbling windows; late rows are dropped after ``late``."""
    bounds = list(L.LATENCY_BUCKETS if bounds is None else bounds)
    edges = [float("-inf"), *bounds, float("inf")]
    inside = [F.count_if((F.col("value") > a) & (F.col("value") <= b)) for a, b in zip(edges, edges[1:], strict=False)]
    w = F.window("ts", every)
    out = obs.withWatermark("ts", late).groupBy(w, "name").agg(F.count("value").alias("count"), F.sum("value").alias("sum"), F.array(*inside).alias("buckets"))
    return out.select(F.col("window.start").alias("start"), "name", "count", "sum", "buckets")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", key: str = "user_id") -> DataFrame:
    """Sessions of each key: events with no longer gap than ``gap``."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(w, key).agg(F.count(F.lit(1)).alias("events")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def run(df: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None] | None = None, path: str | None = None, mode: str = "append", once_only: bool = True) -> StreamingQuery:
    """Starts a query that hands each micro-batch to ``batch``, or appends Parquet to ``path``; ``once_only`` stops when the input is used up."""
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    w = w.foreachBatch(batch) if batch is not None else w.format("parquet").option("path", path)
    return (w.trigger(availableNow=True) if once_only else w).start()


def surest(messages: DataFrame, min_confidence: float, most: int, novelty: DataFrame | None = None) -> DataFrame:
    """What to capture of sessions' messages (conv_id, turn, text): each session's ``most`` surest signals of at least ``min_confidence``.

    Signals rank by confidence, then turn and position; ``novelty`` (conv_id, turn,
    position, is_novel) leaves the new ones.  Messages without text have none.  A task
    keeps ``most`` of a session before the shuffle, however long the session.
    """
    sure = signals.session_signals(signals.signals(messages, "conv_id", "turn"), min_confidence, most, novelty=novelty)
    body = F.coalesce(F.nullif("context", F.lit("")), "match")
    return sure.select("conv_id", "turn", "position", F.col("suggested_namespace").alias("namespace"), pre_compact_summary(F.col("match"), F.col("context")).alias("summary"), body.alias("content"), signals.tags(F.col("type"), body).alias("tags"), "confidence")


def pre_compact(messages: DataFrame, min_confidence: float = 0.85, most: int = 50, prompt_first: bool = False, novelty: DataFrame | None = None) -> DataFrame:
    """N17, N18f: before sessions are compacted, what is captured of each, or with ``prompt_first`` only suggested.

    Captures go through the checks and the filter of secrets of ``capture.capture``;
    suggestions are the same rows as found, for a person to choose from.
    """
    found = surest(messages, min_confidence, most, novelty)
    return found if prompt_first else capture.capture(found)[0]


def session_end(store_write: Callable[[DataFrame], None], min_confidence: float = 0.8, most: int = 50) -> Callable[[DataFrame, int], None]:
    """A batch function that captures the surest signals of closed sessions' messages (conv_id, turn, text)."""

    def handle(batch: DataFrame, _: int) -> None:
        store_write(capture.capture(surest(batch, min_confidence, most))[0])

    return handle
