"""Search pruned by trigrams: the same rows as a whole scan, and which files are read."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from notelake.functions import scalar as S
from notelake.operators import trigrams

SCHEMA = "id long, summary string, content string"
WORDS = "alpha Bravo čaj delta ECHO straße 日本語 100% a_b x".split()


@pytest.fixture
def table(spark, tmp_path):
    def put(rows, files=8, name="t"):
        spark.createDataFrame(rows, SCHEMA).repartitionByRange(files, "id").write.mode("append").parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    return put


def rows_of(n, seed=1):
    r = random.Random(seed)
    return [(i, r.choice([None, "", f"only{i // 10}", "x" * 30]), r.choice([None, " ".join(r.choice(WORDS) for _ in range(r.randrange(9)))])) for i in range(n)]


def files_read(df):
    """Files that the plan's scan opens."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    nodes = plan.collectLeaves()
    return sum(nodes.apply(i).metrics().apply("numFiles").value() for i in range(nodes.size()))


def whole(rows, query):
    return rows.where(S.contains_like(F.col("summary"), query) | S.contains_like(F.col("content"), query))


@pytest.mark.parametrize("query", ["only7", "ONLY3", "čaj", "straße", "STRASSE", "日本語", "本", "a_b", "al%vo", "echo%日", "_nly1_", "100%", "ab", "%", "zzzz", "xxx%only", "a d", "o delta e"])
def test_same_rows(spark, table, query):
    rows = table(rows_of(400))
    found = trigrams.signatures(rows)
    assert sorted(r[0] for r in trigrams.search(rows, found, query).select("id").collect()) == sorted(r[0] for r in whole(rows, query).select("id").collect())


def test_files_without_the_query_are_not_opened(spark, table):
    rows = table([(i, f"only{i // 10}", b) for i, _, b in rows_of(400)])
    found = trigrams.signatures(rows)
    assert files_read(whole(rows, "only31")) == 8
    assert files_read(trigrams.search(rows, found, "only31")) in (1, 2)  # ids are dealt by range, so ten in a row lie in two files at most
    assert trigrams.search(rows, found, "nowhere").count() == 0 and trigrams.absent(found, "nowhere").count() == 8
    assert trigrams.absent(found, "ab").count() == 0 and trigrams.search(rows, found, " ").count() == 0


def test_files_written_later_are_searched(spark, table):
    rows = table(rows_of(80))
    found = trigrams.signatures(rows).cache()
    found.count()
    later = table([(1000, "brand new", None)], 1)
    assert [r["id"] for r in trigrams.search(later, found, "brand").collect()] == [1000]
    found.unpersist()


def test_texts_longer_than_a_block_and_no_trigram_across_texts(spark, table, monkeypatch):
    monkeypatch.setattr(trigrams, "BLOCK", 64)
    texts = ["abc" * 100 + "needle" + "d" * 70, "ab", "cd", None, "", "é" * 90]
    import pyarrow as pa

    found = np.unique(np.concatenate(list(trigrams._of_texts(pa.array(["skipped", *texts]).slice(1)))))
    want = {t.encode()[i : i + 3] for t in texts if t for i in range(len(t.encode()) - 2)}
    assert {int(c).to_bytes(3, "big") for c in found} == want


def test_no_rows(spark, table):
    rows = table([(1, None, None)], 1)
    found = trigrams.signatures(rows)
    assert found.count() == 1 and trigrams.search(rows, found, "abc").count() == 0
    assert trigrams.search(rows.limit(0), found, "ab").count() == 0
