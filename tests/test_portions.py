"""What a Python worker holds at once does not grow with its batch."""

import pandas as pd
from pyspark.sql import functions as F

from notelake.functions import tables
from notelake.operators import security, signals


def test_portions_are_bounded_and_whole():
    part = pd.Series(["a" * 10, None, "", "b" * (3 << 20), *["c" * 5000] * 1000])
    some = list(tables.portions(part))
    assert [x for p in some for x in p] == list(part)
    assert all(len(p) <= tables.PORTION_ROWS for p in some)
    assert all(len(p) == 1 or sum(len(x or "") for x in p) <= tables.PORTION_CHARACTERS for p in some)
    assert not list(tables.portions(pd.Series([], dtype=object)))


def test_detection_of_many_rows_in_one_batch(spark):
    """Rows keep their own findings where a batch is handled in portions, and batches are limited by bytes."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    text = F.when(F.col("id") % 3 == 0, F.concat(F.lit("I decided to use "), F.col("id"))).when(F.col("id") % 3 == 1, "mail 555-123-4567")
    rows = spark.range(1000, numPartitions=1).withColumn("text", text).withColumns({"s": F.size(signals.detect("text")), "d": F.size(security.detect("text"))})
    assert all((r.s, r.d) == {0: (1, 0), 1: (0, 1), 2: (0, 0)}[r.id % 3] for r in rows.collect())
    assert int(spark.conf.get(key).rstrip("bB")) <= tables.BATCH_BYTES
