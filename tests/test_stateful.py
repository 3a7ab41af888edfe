"""Sessions and rolling samples over micro-batches, restarts and replayed batches."""

import glob
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from notelake.operators import signals, telemetry
from notelake.streaming import hooks, stateful

BASE = datetime(2024, 1, 1, tzinfo=timezone.utc)
TEXTS = ["I decided to use the new parser.", "Today I learned that caching helps.", "nothing here at all", "We are blocked by the review.", "I prefer to keep it small.", "Please remember this for later."]
MESSAGES = "conv_id long, turn long, text string, ts timestamp"


def fed(spark, tmp_path, schema, parts, build, write, each=lambda k: None):
    """Runs a stream over one file after another, starting it anew for each."""
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        with stateful.rocksdb(spark):
            q = hooks.run(build(stream), str(tmp_path / "c"), batch=write, mode="update" if write.__name__ == "keep" else "append")
            q.awaitTermination(120)
        each(k)


@pytest.mark.parametrize("cuts", [[], [3, 9]])
def test_sessions_close_alike_however_messages_come(spark, tmp_path, cuts):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(TEXTS), BASE + timedelta(minutes=7 * t + c)) for c in range(3) for t in range(5)]
    rows.sort(key=lambda r: r[3])
    ends = [(99, 0, "done", BASE + timedelta(days=2)), (99, 1, "done", BASE + timedelta(days=4))]
    parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)] + [[e] for e in ends]
    fed(spark, tmp_path, MESSAGES, parts, lambda s: stateful.closed_sessions(s, most=3), stateful.by_batch(str(tmp_path / "out"), "sessions"))
    got = spark.read.parquet(str(tmp_path / "out")).filter("conv_id < 99").select("conv_id", "turn", "position", "match", "rank").collect()
    found = signals.signals(spark.createDataFrame(rows, MESSAGES), "conv_id", "turn")
    want = signals.auto_capture(found, 0.8, 3).filter("captured").select("conv_id", "turn", "position", "match").collect()
    assert sorted(tuple(r)[:4] for r in got) == sorted(tuple(r) for r in want) and len(got) == 9
    assert sorted({r.rank for r in got}) == [1, 2, 3]


def test_rolling_samples_after_each_batch(spark, tmp_path):
    rng = random.Random(6)
    rows = [(BASE + timedelta(seconds=rng.randrange(500)), k, rng.choice("ab"), rng.choice([None, float(k)])) for k in range(90)]
    parts, held, schema = [rows[:20], rows[20:25], rows[25:]], {}, "ts timestamp, event_id long, name string, value double"

    def keep(batch, _):
        new = {}
        for r in batch.collect():
            new.setdefault(r.name, []).append((r["rank"], r.us, r.event_id, r.value))
        held.update(new)

    def check(k):
        seen = spark.createDataFrame([r for p in parts[: k + 1] for r in p], schema)
        want = {}
        for r in telemetry.last_samples(seen, 12).select("name", F.unix_micros("ts").alias("us"), "event_id", "value").collect():
            want.setdefault(r.name, []).append((r.us, r.event_id, r.value))
        assert {n: sorted(x[1:] for x in v) for n, v in held.items()} == {n: sorted(v) for n, v in want.items()}
        assert all(len(v) <= 12 and sorted(x[0] for x in v) == list(range(1, len(v) + 1)) for v in held.values())

    fed(spark, tmp_path, schema, parts, lambda s: stateful.rolling_samples(s, 12), keep, check)


def test_a_batch_that_fails_after_its_write_adds_nothing_twice(spark, tmp_path):
    spark.createDataFrame([(i, f"I decided to use number {i}") for i in range(6)], "event_id int, prompt string").coalesce(1).write.json(str(tmp_path / "in"))
    write, calls = stateful.by_batch(str(tmp_path / "out"), "prompts", lambda df: df.filter("action = 'auto'").select("event_id", "namespace")), []

    def failing(batch, number):
        write(batch, number)
        calls.append(number)
        if len(calls) == 1:
            raise OSError("lost after the write")

    for _ in range(2):
        stream = spark.readStream.schema("event_id int, prompt string").json(str(tmp_path / "in"))
        q = hooks.run(hooks.prompt_decisions(stream), str(tmp_path / "c"), batch=failing)
        try:
            q.awaitTermination(120)
        except Exception as e:  # noqa: BLE001  the stream's own error
            assert "lost after the write" in str(e)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert calls == [0, 0] and sorted(r.event_id for r in got) == list(range(6)) and {(r.stream, r.batch) for r in got} == {("prompts", 0)}
    assert len(glob.glob(str(tmp_path / "out/stream=prompts/*"))) == 1
