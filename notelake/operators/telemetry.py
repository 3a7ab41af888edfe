"""Counters, gauges, histograms, percentiles, spans and their exports (E10-E16, A38-A41, M, N8, N9, N21)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelake import literals as L
from notelake.functions import scalar as S
from notelake.functions.tables import settled, small

SAMPLES = 3600
#: Different values that windows over series rank at once; different values of a slice of a longer series, and slices at most.
WHOLE, SLICE, MOST_SLICES = 200_000, 50_000, 4096
#: Size of a sketch: series up to it are kept whole; beyond, ranks are off by about 2.3 / k of the count.
SKETCH = 1024


def sketches(obs: DataFrame, every: str, keys: tuple[str, ...] = ("name",), k: int = SKETCH, time: str = "ts") -> DataFrame:
    """E13-E15 over time: a quantile sketch, count and sum of each series in each window of length ``every``.

    Rows are sketched before the shuffle, so a series in a third of all rows costs one
    sketch a task.  Works on streams too: a watermark on ``time`` closes windows.  Null
    values and times count nowhere.  Returns the keys, start, count, sum, sketch.
    """
    rows = obs.filter(F.col("value").isNotNull() & F.col(time).isNotNull())
    found = rows.groupBy(*keys, F.window(time, every).alias("__w")).agg(F.count("value").alias("count"), F.sum("value").alias("sum"), F.kll_sketch_agg_double(F.col("value").cast("double"), F.lit(k)).alias("sketch"))
    return found.select(*keys, F.col("__w.start").alias("start"), "count", "sum", "sketch")


def merged(found: DataFrame, every: str | None = None, keys: tuple[str, ...] = ("name",)) -> DataFrame:
    """``sketches`` merged into windows of length ``every`` (a multiple of theirs), or into one row a series; no observation is read."""
    by = [*keys] if every is None else [*keys, F.window("start", every)["start"].alias("start")]
    return found.groupBy(*by).agg(F.sum("count").alias("count"), F.sum("sum").alias("sum"), F.kll_merge_agg_double("sketch").alias("sketch"))


def sketched_percentiles(found: DataFrame, points: tuple[int, ...] = (50, 90, 95, 99)) -> DataFrame:
    """``sketches`` with minimum, maximum, mean and percentiles in place of sketches.

    A percentile is the smallest value whose share of values up to it reaches p, exact
    for windows of at most k values, else within the sketch's error of rank.
    """
    at = lambda q: F.kll_sketch_get_quantile_double("sketch", F.lit(float(q)))
    return found.withColumns({"mean": F.col("sum") / F.col("count"), "min": at(0.0), "max": at(1.0), **{f"p{p}": at(p / 100) for p in points}}).drop("sketch")


def window_percentiles(obs: DataFrame, found: DataFrame, every: str, keys: tuple[str, ...] = ("name",), points: tuple[int, ...] = (50, 90, 95, 99), **sizes: int) -> DataFrame:
    """``sketched_percentiles`` of ``obs``' windows of length ``every`` (``found``), with exact percentiles however many values a window has.

    Counts, sums and ends come from the merged sketches; percentiles are ranked (``percentiles``).
    """
    rows = obs.filter(F.col("value").isNotNull() & F.col("ts").isNotNull()).withColumn("start", F.window("ts", every)["start"])
    exact = percentiles(rows, (*keys, "start"), points, reached=True, **sizes)
    names = [*keys, "start"]
    right = exact.select(*(F.col(c).alias(f"__{c}") for c in names), *(f"p{p}" for p in points))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in names]
    return sketched_percentiles(found, ()).join(right, same).drop(*(f"__{c}" for c in names))


def counters(obs: DataFrame) -> DataFrame:
    """Sum of each series."""
    return obs.groupBy("name", S.labels_key(F.col("labels")).alias("labels_key")).agg(F.sum("value").alias("value"))


def histogram(obs: DataFrame, bounds: list[float] | None = None) -> DataFrame:
    """Each series' sum, count and number of values in each bucket (the first bound that is not smaller; last: above all)."""
    bounds = list(L.LATENCY_BUCKETS if bounds is None else bounds)
    edges = [float("-inf"), *bounds, float("inf")]
    inside = [F.count_if((F.col("value") > a) & (F.col("value") <= b)) if a > float("-inf") else F.count_if(F.col("value") <= b) for a, b in zip(edges, edges[1:], strict=False)]
    return obs.groupBy("name", S.labels_key(F.col("labels")).alias("labels_key")).agg(F.count("value").alias("count"), F.sum("value").alias("sum"), F.array(*inside).alias("buckets"))


def gauges(obs: DataFrame) -> DataFrame:
    """Last value set and later changes of each series; kind is set or add.

    Both are sums over a series, joined by it, so no series' rows have to meet.
    """
    each = obs.withColumn("labels_key", S.labels_key(F.col("labels")))
    last = each.filter("kind = 'set'").groupBy("name", "labels_key").agg(F.max("ts").alias("__t"), F.max_by("value", "ts").alias("__set"))
    change = F.when((F.col("kind") == "add") & (F.col("__t").isNull() | (F.col("ts") > F.col("__t"))), F.col("value"))
    joined = each.join(last, ["name", "labels_key"], "left")
    return joined.groupBy("name", "labels_key").agg((F.coalesce(F.max("__set"), F.lit(0.0)) + F.coalesce(F.sum(change), F.lit(0.0))).alias("value"))


def last_samples(obs: DataFrame, n: int = SAMPLES, keys: tuple[str, ...] = ("name",), order: str = "ts") -> DataFrame:
    """the latest n rows of each series; Spark drops others before the shuffle."""
    tie = [F.col("event_id").desc()] if "event_id" in obs.columns else []
    return obs.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc(), *tie))).filter(F.col("__r") <= n).drop("__r")


def percentiles(obs: DataFrame, keys: tuple[str, ...] = ("name",), points: tuple[int, ...] = (50, 90, 95, 99), whole: int = WHOLE, reached: bool = False) -> DataFrame:
    """Count, sum, mean and percentiles by floor rank, sorted[min(floor(n p / 100), n - 1)], of each series.

    With ``reached`` a percentile is the smallest value whose share of values up to it
    reaches p, sorted[max(ceil(n p / 100), 1) - 1], as in ``sketched_percentiles``.

    Equal values are counted first.  If there are at most ``whole`` different ones, each
    series is ranked at once; else approximate quantiles cut it into slices of about
    ``SLICE`` values, which are ranked behind the sizes of the slices before.  Either way
    ranks are exact, and neither a long series nor a frequent value is one task's work.
    """
    keys_ = list(keys)
    counts = settled(obs.filter(F.col("value").isNotNull()).groupBy(*keys_, "value").agg(F.count(F.lit(1)).alias("__c")))
    by, n = Window.partitionBy(*keys_), counts.count()
    if n <= whole:
        ranked = counts.withColumns({"__upto": F.sum("__c").over(by.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)), "__n": F.sum("__c").over(by)})
    else:
        slices = min(max(n // SLICE, 2), MOST_SLICES)
        cuts = settled(counts.groupBy(*keys_).agg(F.percentile_approx("value", [i / slices for i in range(1, slices)], 20 * slices).alias("__cuts")))
        rows = counts.join(small(cuts), keys_).withColumn("__s", F.size(F.filter("__cuts", lambda c: c < F.col("value")))).drop("__cuts")
        sizes = rows.groupBy(*keys_, "__s").agg(F.sum("__c").alias("__size"))
        before = F.coalesce(F.sum("__size").over(by.orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        sizes = settled(sizes.select(*keys_, "__s", before.alias("__before"), F.sum("__size").over(by).alias("__n")))
        within = Window.partitionBy(*keys_, "__s").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
        ranked = rows.withColumn("__upto", F.sum("__c").over(within)).join(small(sizes), [*keys_, "__s"]).withColumn("__upto", F.col("__upto") + F.col("__before"))
    share = lambda p: F.col("__n") * p / 100
    rank = lambda p: F.greatest(F.ceil(share(p)), F.lit(1)) - 1 if reached else F.least(F.floor(share(p)), F.col("__n") - 1)
    found = [F.max(F.when((F.col("__upto") - F.col("__c") <= rank(p)) & (rank(p) < F.col("__upto")), F.col("value"))).alias(f"p{p}") for p in points]
    total = F.sum(F.col("value") * F.col("__c"))
    return ranked.groupBy(*keys_).agg(F.sum("__c").alias("count"), total.alias("sum"), (total / F.sum("__c")).alias("mean"), *found)


def timeout_rate(obs: DataFrame, executions: str, timeouts: str) -> DataFrame:
    """Timeouts by executions, in percent; 0 without executions."""
    e, t = (F.coalesce(F.sum(F.when(F.col("name") == n, F.col("value"))), F.lit(0.0)) for n in (executions, timeouts))
    return obs.agg(F.when(e > 0, t / e * 100).otherwise(0.0).alias("timeout_rate"))


def trace_summary(spans: DataFrame) -> DataFrame:
    """Number, duration in ms and errors of each operation."""
    return spans.groupBy("operation").agg(F.count(F.lit(1)).alias("n"), F.sum(duration_ms()).alias("total_ms"), F.count_if(F.col("status") == "error").alias("errors"))


def duration_ms() -> Column:
    """N9b."""
    return F.coalesce((F.col("end_time") - F.col("start_time")) * 1000, F.lit(0.0))


def span_children(spans: DataFrame) -> DataFrame:
    """M2: each span with the number and duration of its children, and the rest of its own duration."""
    child = spans.filter(F.col("parent_span_id").isNotNull()).groupBy("trace_id", F.col("parent_span_id").alias("span_id")).agg(F.count(F.lit(1)).alias("children"), F.sum(duration_ms()).alias("child_ms"))
    out = spans.join(child, ["trace_id", "span_id"], "left")
    return out.select("trace_id", "span_id", "operation", F.coalesce("children", F.lit(0)).alias("children"), duration_ms().alias("duration_ms"), (duration_ms() - F.coalesce("child_ms", F.lit(0.0))).alias("self_ms"))


def span_trees(spans: DataFrame) -> DataFrame:
    """M2: each span's root, depth (0: the root) and path_ms, the duration of all spans from the root to it.

    Pointer doubling: a span knows an ancestor and what lies between, and in each round
    takes over what that one knows, so a chain of n spans takes log n rounds.  A span
    without parent is a root, as is one whose parent is not there (is_orphan); spans on a
    cycle, or below one, have no root, depth or path.  Span ids are unique in a trace.
    """
    own = settled(spans.select("trace_id", "span_id", "parent_span_id", duration_ms().alias("ms")))
    there = own.select(F.col("trace_id").alias("t"), F.col("span_id").alias("s"))
    linked = own.join(there, (F.col("trace_id") == F.col("t")) & (F.col("parent_span_id") == F.col("s")), "left")
    up = F.col("s")
    state = settled(linked.select("trace_id", "span_id", (up.isNull() & F.col("parent_span_id").isNotNull()).alias("is_orphan"), F.coalesce(up, "span_id").alias("up"), up.isNull().alias("done"), F.when(up.isNull(), 0).otherwise(1).cast("long").alias("depth"), F.when(up.isNull(), F.lit(0.0)).otherwise(F.col("ms")).alias("below"), "ms"))
    n, reach = state.count(), 1
    while reach < 2 * n and not state.filter(~F.col("done")).isEmpty():
        above = state.select(F.col("trace_id").alias("t"), F.col("span_id").alias("s"), F.col("up").alias("up_"), F.col("done").alias("done_"), F.col("depth").alias("depth_"), F.col("below").alias("below_"))
        open_ = state.filter(~F.col("done")).join(above, (F.col("trace_id") == F.col("t")) & (F.col("up") == F.col("s")))
        moved = open_.select("trace_id", "span_id", "is_orphan", F.col("up_").alias("up"), F.col("done_").alias("done"), (F.col("depth") + F.col("depth_")).alias("depth"), (F.col("below") + F.col("below_")).alias("below"), "ms")
        state, reach = settled(state.filter("done").unionByName(moved)), 2 * reach
    root = state.filter("depth = 0").select(F.col("trace_id").alias("t"), F.col("span_id").alias("s"), F.col("ms").alias("root_ms"))
    found = state.join(root, F.col("done") & (F.col("trace_id") == F.col("t")) & (F.col("up") == F.col("s")), "left")
    path = F.when(F.col("depth") == 0, F.col("ms")).otherwise(F.col("below") + F.col("root_ms"))
    return found.select("trace_id", "span_id", F.when(F.col("done"), F.col("up")).alias("root_id"), F.when(F.col("done"), F.col("depth")).alias("depth"), F.when(F.col("done"), path).alias("path_ms"), "is_orphan")


def critical_paths(trees: DataFrame) -> DataFrame:
    """M2: of each tree (``span_trees``) its spans, depth, and the last span and duration of the longest path from the root, ties by id."""
    worst = F.max_by(F.col("span_id"), F.struct("path_ms", F.col("span_id")))
    return trees.filter("root_id IS NOT NULL").groupBy("trace_id", "root_id").agg(F.count(F.lit(1)).alias("spans"), F.max("depth").alias("depth"), worst.alias("last_span"), F.max("path_ms").alias("path_ms"))


def _number(x: Column) -> Column:
    """As Python writes a float, for values that are whole or short: digits alone from 0.0001 up to 1e16."""
    text = x.cast("string")
    digits = F.rtrim(text.cast("decimal(38, 22)").cast("string"), F.lit("0"))
    short = F.concat(F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", ""), F.lit("e-"), F.lpad(F.substring_index(text, "E-", -1), 2, "0"))
    plain = F.when(~F.contains(text, F.lit("E")), text).when(F.abs(x) >= 1e-4, digits).otherwise(short)
    return F.when(x == F.floor(x), F.concat(F.format_string("%d", x.cast("long")), F.lit(".0"))).otherwise(plain)


def _quoted(key: Column, extra: Column | None = None) -> Column:
    pairs = F.filter(F.split(key, ","), lambda p: p != "")
    quoted = F.transform(pairs, lambda p: F.concat(F.substring_index(p, "=", 1), F.lit('="'), F.substr(p, F.length(F.substring_index(p, "=", 1)) + 2), F.lit('"')))
    quoted = quoted if extra is None else F.array_sort(F.concat(quoted, F.array(extra)))
    return F.when(F.size(quoted) > 0, F.concat(F.lit("{"), F.array_join(quoted, ","), F.lit("}"))).otherwise("")


def prometheus(hist: DataFrame, bounds: list[float] | None = None) -> DataFrame:
    """Exposition lines (name, labels_key, line_no, line) of histograms: cumulated buckets, sum, count."""
    bounds = list(L.LATENCY_BUCKETS if bounds is None else bounds)
    names = [str(int(b)) if b == int(b) else str(b) for b in bounds] + ["+Inf"]
    upto = [F.aggregate(F.slice("buckets", 1, i + 1), F.lit(0).cast("bigint"), lambda a, x: a + x) for i in range(len(names))]
    lines = [F.concat("name", F.lit("_bucket"), _quoted(F.col("labels_key"), F.lit(f'le="{n}"')), F.lit(" "), c.cast("string")) for n, c in zip(names, upto, strict=True)]
    lines += [F.concat("name", F.lit("_sum"), _quoted(F.col("labels_key")), F.lit(" "), _number(F.col("sum"))), F.concat("name", F.lit("_count"), _quoted(F.col("labels_key")), F.lit(" "), _number(F.col("count").cast("double")))]
    return hist.select("name", "labels_key", F.posexplode(F.array(*lines)).alias("line_no", "line"))


def prometheus_counters(series: DataFrame, kind: str = "counter") -> DataFrame:
    """Exposition lines of counters or gauges."""
    head = lambda a: F.concat(F.lit(f"# {a} "), "name", F.lit(f" {kind.title()} metric" if a == "HELP" else f" {kind}"))
    heads = series.select("name").distinct().select("name", F.lit("").alias("labels_key"), F.posexplode(F.array(head("HELP"), head("TYPE"))).alias("line_no", "line"))
    return heads.unionByName(series.select("name", "labels_key", F.lit(2).alias("line_no"), F.concat("name", _quoted(F.col("labels_key")), F.lit(" "), _number(F.col("value"))).alias("line")))


def flush(lines: DataFrame, path: str) -> None:
    """Appends exposition lines, in order, as text."""
    lines.orderBy("name", "labels_key", "line_no").select("line").write.mode("append").text(path)


def text_lines(stats: DataFrame) -> DataFrame:
    """Each series' figures as text."""
    f = lambda c: F.format_string(f"  {c}: %.2f", F.col(c))
    return stats.select("name", F.array_join(F.array(F.concat("name", F.lit(":")), F.format_string("  count: %d", "count"), f("sum"), f("mean"), f("p50"), f("p90"), f("p95"), f("p99")), "\n").alias("text"))


def metrics_json(stats: DataFrame) -> DataFrame:
    """Each series as JSON."""
    return stats.select("name", F.to_json(F.struct(*[c for c in stats.columns if c != "name"])).alias("json"))


def otlp_spans(spans: DataFrame) -> DataFrame:
    """Spans as OTLP JSON."""
    ns = lambda c: (c * 1e9).cast("decimal(38,0)").cast("string")
    attributes = F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.struct(e["key"].alias("key"), F.struct(e["value"].alias("stringValue")).alias("value")))
    status = F.struct(F.when(F.col("status") == "ok", 1).otherwise(2).alias("code"), F.col("error_message").alias("message"))
    return spans.select(
        "trace_id",
        "span_id",
        F.to_json(
            F.struct(
                F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), F.col("parent_span_id").alias("parentSpanId"), F.col("operation").alias("name"), F.lit(1).alias("kind"),
                ns(F.col("start_time")).alias("startTimeUnixNano"), ns(F.coalesce("end_time", "start_time")).alias("endTimeUnixNano"), attributes.alias("attributes"), status.alias("status"),
            )
        ).alias("json"),
    )


def otlp_histograms(hist: DataFrame, time_ns: int, bounds: list[float] | None = None) -> DataFrame:
    """Histograms as OTLP JSON, with counts of each bucket (not cumulated)."""
    bounds = list(L.LATENCY_BUCKETS if bounds is None else bounds)
    attributes = F.transform(F.filter(F.split("labels_key", ","), lambda p: p != ""), lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.struct(F.substr(p, F.length(F.substring_index(p, "=", 1)) + 2).alias("stringValue")).alias("value")))
    point = F.struct(F.col("count").cast("string").alias("count"), F.col("sum"), F.transform("buckets", lambda x: x.cast("string")).alias("bucketCounts"), F.array(*map(F.lit, bounds)).alias("explicitBounds"), F.lit(str(time_ns)).alias("timeUnixNano"), attributes.alias("attributes"))
    return hist.select("name", "labels_key", F.to_json(F.struct("name", F.struct(F.array(point).alias("dataPoints"), F.lit(2).alias("aggregationTemporality")).alias("histogram"))).alias("json"))
