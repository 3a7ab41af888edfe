"""A change of the store writes only the partitions anew that it concerns, a few at a time."""

import os

import pytest
from pyspark.sql import functions as F

from notelake.functions import tables
from notelake.operators import sync
from notelake.sources.store import Store

NAMES = ["a", "b", "c d", "e%2F/f", "g=h", "ü{i}", "k:[l]", "m", "n", "o"]


def rows_of(spark, ids, summary="s"):
    """A record for each number, in the namespace of its last digit."""
    return spark.createDataFrame([(f"id{i}", "sha", NAMES[i % 10], summary, f"content {i}") for i in ids], "id string, commit_sha string, namespace string, summary string, content string").withColumn("timestamp", F.timestamp_seconds(F.lit(0)))


def held(s):
    return sorted((r.id, r.namespace, r.summary, r.content) for r in s.read().collect())


def rows(ids, summary="s", namespace=None):
    return [(f"id{i}", namespace or NAMES[i % 10], summary, f"content {i}") for i in ids]


def files(folder):
    return {os.path.join(d, n) for d, _, names in os.walk(folder) for n in names if n.endswith(".parquet")}


@pytest.mark.parametrize("partition", ["namespace", None])
def test_changes_leave_other_partitions_alone(spark, tmp_path, partition):
    s = Store(spark, str(tmp_path / "s"), partition=partition, key=sync.RECORD)
    assert s.update(rows_of(spark, [1])) == 1 and s.delete(rows_of(spark, [1])) == 2 and held(s) == []
    s.insert(rows_of(spark, range(40)))
    s.insert(rows_of(spark, range(30, 60)))
    before = files(s.path)
    s.update(rows_of(spark, [3, 13, 99], "new").unionByName(rows_of(spark, [3], "new")))
    want = sorted(rows(i for i in range(60) if i not in (3, 13)) and [*rows(i for i in range(60) if i not in (3, 13)), *rows([3, 13], "new")])
    assert held(s) == want
    written = files(s.path) - before
    if partition:
        assert written and all("namespace=e%252F%2Ff" in f for f in written)
    s.update(rows_of(spark, [4], "moved").withColumn("namespace", F.lit("b")))
    want = sorted([r for r in want if r[0] != "id4"] + rows([4], "moved", "b"))
    assert held(s) == want
    s.delete(rows_of(spark, [*range(0, 60, 2), 1000]))
    want = [r for r in want if int(r[0][2:]) % 2]
    assert held(s) == want and s.version() == 7
    assert s.vacuum() == 6 and held(s) == want
    assert len(files(s.path)) == len(s.read().inputFiles())
    assert s.insert(rows_of(spark, range(60))) == 30 and s.clear() == 60 and held(s) == [] and s.vacuum() == 2


def test_a_change_exchanges_a_group_of_partitions_at_a_time(spark, tmp_path, monkeypatch):
    s = Store(spark, str(tmp_path / "s"), key=sync.RECORD)
    s.replace(rows_of(spark, range(100)))
    sizes, write = [], s._write
    monkeypatch.setattr(s, "_write", lambda df: (sizes.append(df.count()), write(df))[1])
    left = {n for n in os.listdir(tables._folder(s.read()).removeprefix("file:")) if n.startswith("table-")}
    s.delete(rows_of(spark, range(10)))
    assert sum(sizes) == 90 and max(sizes) <= 18 and held(s) == sorted(rows(range(10, 100)))
    assert left == {n for n in os.listdir(tables._folder(s.read()).removeprefix("file:")) if n.startswith("table-")}
