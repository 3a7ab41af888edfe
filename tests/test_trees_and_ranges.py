"""Span trees by pointer doubling, reconciliation by digests, and deadlines."""

import random
import time

import pytest
from pyspark.sql import functions as F

from notelake import schema
from notelake.operators import reconcile, sync, telemetry
from notelake.streaming import hooks


def spans(spark, rows):
    """Rows: trace, span, parent, milliseconds."""
    return spark.createDataFrame([(t, s, p, "op", 1.0, 1.0 + ms / 1000, {}, "ok", None) for t, s, p, ms in rows], schema.SPANS)


def brute_trees(rows):
    by = {(t, s): (p, ms) for t, s, p, ms in rows}
    out = {}
    for t, s in by:
        at, seen, total, depth = s, set(), 0.0, -1
        while at not in seen:
            seen.add(at)
            p, ms = by[t, at]
            total, depth = total + ms, depth + 1
            if p is None or (t, p) not in by:
                out[t, s] = (at, depth, round(total, 3))
                break
            at = p
        else:
            out[t, s] = (None, None, None)
    return {k: (*v, by[k][0] is not None and (k[0], by[k][0]) not in by) for k, v in out.items()}


def test_span_trees_against_walking_up(spark):
    rng = random.Random(2)
    rows = [("chain", f"s{i}", f"s{i - 1}" if i else None, i % 5) for i in range(300)]
    rows += [("tree", f"s{i}", None if i == 0 else f"s{rng.randrange(i)}", rng.randrange(9)) for i in range(200)]
    rows += [("loop", "a", "c", 1), ("loop", "b", "a", 1), ("loop", "c", "b", 1), ("loop", "below", "a", 1), ("loop", "self", "self", 1), ("lost", "x", "gone", 2), ("lost", "y", "x", 3), ("lost", "chain", "s5", 4)]
    rng.shuffle(rows)
    trees = telemetry.span_trees(spans(spark, rows))
    got = {(r.trace_id, r.span_id): (r.root_id, r.depth, None if r.path_ms is None else round(r.path_ms, 3), r.is_orphan) for r in trees.collect()}
    assert got == brute_trees(rows)
    worst = {(r.trace_id, r.root_id): (r.spans, r.depth, round(r.path_ms, 3)) for r in telemetry.critical_paths(trees).collect()}
    assert worst["chain", "s0"] == (300, 299, 600.0) and worst["lost", "x"] == (2, 1, 5.0) and not any(t == "loop" for t, _ in worst)
    assert telemetry.span_trees(spans(spark, [])).count() == 0


def shuffled(spark):
    time.sleep(1)  # figures of tasks come in after them
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


@pytest.mark.parametrize("changed", [0, 1, 40, 3000])
def test_reconciliation_finds_what_a_join_finds(spark, changed):
    rng = random.Random(changed)
    m = [(f"id{i}", rng.choice(["s", None, ""]), f"text {i}") for i in range(3000)]
    other = list(m)
    for i in rng.sample(range(3000), changed):
        kind = rng.randrange(3)
        other[i] = (m[i][0], m[i][1], "changed") if kind == 0 else (m[i][0] + "x", m[i][1], m[i][2]) if kind == 1 else None
    fields = "id string, summary string, content string"
    expected, indexed = spark.createDataFrame(m, fields), spark.createDataFrame([r for r in other if r], fields)
    want = sorted(map(tuple, sync.verify(expected, indexed).collect()))
    assert sorted(map(tuple, reconcile.verify(expected, indexed, bits=6, rows=8).collect())) == want
    a, b = reconcile.differing(*(df.select("id", F.md5("content").alias("value")) for df in (expected, indexed)), bits=6, rows=8)
    if changed <= 1:
        assert a.count() + b.count() <= 16 * changed
    assert reconcile.verify(expected, expected.limit(0)).filter("problem = 'missing'").count() == 3000


def test_what_is_shuffled_follows_the_difference(spark):
    rows = spark.range(200_000).select(F.concat(F.lit("id"), "id").alias("id"), F.lit("s").alias("summary"), F.md5(F.col("id").cast("string")).alias("content"))
    off = rows.withColumn("content", F.when(F.col("id") == "id77", "x").otherwise(F.col("content")))
    used = []
    for f in (sync.verify, reconcile.verify):
        before = shuffled(spark)
        assert [tuple(r) for r in f(rows, off).collect()] == [("id77", "mismatched")]
        used.append(shuffled(spark) - before)
    assert used[1] < 0.05 * used[0]


def test_a_step_that_is_too_slow_is_interrupted(spark):
    @F.udf("long")
    def slow(x):
        time.sleep(0.5)
        return x

    began = time.time()
    assert hooks.within(spark, 2, lambda: spark.range(60).select(slow("id")).agg(F.sum("slow(id)")).first()[0], "default") == "default"
    assert time.time() - began < 10
    tracker = spark.sparkContext.statusTracker()
    until = time.time() + 15
    while tracker.getActiveJobsIds() and time.time() < until:
        time.sleep(0.2)
    assert not tracker.getActiveJobsIds()
    assert hooks.within(spark, 60, lambda: spark.range(3).count()) == 3
    with pytest.raises(ZeroDivisionError):
        hooks.within(spark, 60, lambda: 1 // 0)
