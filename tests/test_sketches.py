"""Quantile sketches of windows: merged, streamed, and their error of rank."""

import datetime
import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from notelake.operators import telemetry
from notelake.plans import queries
from tests.test_queries import form

SCHEMA = "name string, ts timestamp, value double"
T0 = datetime.datetime(2024, 1, 1)


def observations(n, seed=1):
    r = random.Random(seed)
    return [("hot" if r.random() < 0.7 else f"s{r.randrange(3)}", T0 + datetime.timedelta(seconds=r.randrange(4 * 3600)), r.choice([r.gauss(0, 100), 5.0])) for _ in range(n)]


def kth(values, p):
    values = sorted(values)
    return values[max(-(-len(values) * p // 100), 1) - 1]


def test_small_windows_are_exact(spark):
    rows = [*observations(3000), ("hot", None, 1.0), ("hot", T0, None), (None, T0, 3.0)]
    hours = telemetry.sketches(spark.createDataFrame(rows, SCHEMA), "1 hour", k=4096)
    for every in ("2 hours", None):
        want = {}
        for name, ts, v in rows:
            if ts is not None and v is not None:
                want.setdefault((name, ts.replace(hour=ts.hour // 2 * 2, minute=0, second=0) if every else None), []).append(v)
        found = telemetry.sketched_percentiles(telemetry.merged(hours, every)).collect()
        assert {(r["name"], r["start"] if every else None): (r["count"], r["min"], r["max"], r["p50"], r["p99"]) for r in found} == {k: (len(v), min(v), max(v), kth(v, 50), kth(v, 99)) for k, v in want.items()}


def test_error_of_rank_is_bounded(spark):
    """Whether sketched at once or merged from 48 windows, ranks of 400,000 values with ties are off by under 1 %."""
    obs = spark.range(400_000, numPartitions=8).select(F.lit("a").alias("name"), F.timestamp_seconds(F.col("id") % 172_800).alias("ts"), F.when(F.rand(3) < 0.2, 0.25).otherwise(F.rand(4) * F.rand(5)).alias("value")).cache()
    values = np.sort([r["value"] for r in obs.select("value").collect()])
    for found in (telemetry.sketches(obs, "100 days", k=512), telemetry.merged(telemetry.sketches(obs, "1 hour", k=512))):
        row = telemetry.sketched_percentiles(found).first()
        assert row["count"] == len(values) and row["min"] == values[0] and row["max"] == values[-1]
        for p in (50, 90, 95, 99):
            lo, hi = np.searchsorted(values, row[f"p{p}"], "left") / len(values), np.searchsorted(values, row[f"p{p}"], "right") / len(values)
            assert lo - 0.01 <= p / 100 <= hi + 0.01
    obs.unpersist()


def test_stream_and_batch_agree(spark, tmp_path):
    """Windows that a watermark closes over three micro-batches equal those of the whole table."""
    rows = sorted(observations(1500, 2), key=lambda r: r[1])
    for i in range(3):
        spark.createDataFrame(rows[i * 500 : (i + 1) * 500], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withWatermark("ts", "10 hours")
    q = telemetry.sketches(stream, "1 hour").writeStream.outputMode("complete").format("memory").queryName("sketched").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    q.stop()
    form = lambda df: sorted(map(tuple, telemetry.sketched_percentiles(df).select("name", "start", "count", "p50", "p90", "max").collect()))
    assert form(spark.table("sketched")) == form(telemetry.sketches(spark.createDataFrame(rows, SCHEMA), "1 hour"))


def test_no_rows(spark):
    assert telemetry.sketched_percentiles(telemetry.merged(telemetry.sketches(spark.createDataFrame([], SCHEMA), "1 hour"), "1 day")).count() == 0


def test_days_with_more_values_than_a_sketch_keeps_are_exact(spark, tmp_path):
    """The query over one day of 20,000 values agrees with its SQL, whether series are ranked at once or slice by slice."""
    values = spark.range(20_000).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") % 80_000 + 1_704_067_200).alias("ts"), F.lit("view").alias("event_type"), F.lit(1).alias("user_id"), (F.pmod(F.col("id") * 7919, F.lit(20_011)) / 100).alias("value"))
    values.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    found = queries.QUERIES["e13_windows"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(queries.ORACLE_SQL["e13_windows"]).fetchall()
    assert [tuple(map(form, r)) for r in found.collect()] == [tuple(map(form, r)) for r in want]
    obs = values.withColumnRenamed("event_type", "name")
    sliced = telemetry.window_percentiles(obs, telemetry.merged(telemetry.sketches(obs, "1 hour"), "1 day"), "1 day", whole=100).first()
    assert [form(sliced[f"p{p}"]) for p in (50, 90, 95, 99)] == [form(x) for x in want[0][-4:]]
