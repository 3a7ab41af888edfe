"""Tables that are worked out once, and places of rows in a global order."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a small table up to which it is broadcast; tables are counted before.
MAX_BROADCAST = 200_000
#: Bytes of an Arrow batch of texts, and characters and rows of it that a Python worker handles at once.
BATCH_BYTES, PORTION_CHARACTERS, PORTION_ROWS = 8 << 20, 1 << 20, 256
_PART_BITS = 33  # monotonically_increasing_id: number of the partition above, of the row below


def _folder(df: DataFrame) -> str:
    """The session's shared checkpoint folder: ``spark.checkpoint.dir``; only in a local session without it one of our own is set."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir is to name a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="notelake-checkpoints-"))
    return context.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """``df``, worked out once and kept in the session's shared checkpoint folder, with its lineage cut."""
    _folder(df)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table of its own in the session's shared checkpoint folder, for what needs files."""
    path = f"{_folder(df)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unwritten(df: DataFrame) -> None:
    """Deletes the files of a table by ``written`` that nothing reads any more."""
    if files := df.inputFiles():
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that are gone now, not at some later garbage collection."""
    for _ in range(2):  # what the driver's Python has let go may reach the JVM behind its first collection
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def small_batches() -> None:
    """Limits the Arrow batches of the active session to ``BATCH_BYTES``, so that what a worker holds doesn't grow with its partition."""
    session, key = SparkSession.getActiveSession(), "spark.sql.execution.arrow.maxBytesPerBatch"
    if session is not None and int(session.conf.get(key).rstrip("bB")) > BATCH_BYTES:
        session.conf.set(key, str(BATCH_BYTES))


def portions(part: pd.Series) -> Iterator[pd.Series]:
    """The texts (null: empty) of a batch, in order, some at a time; one that is longer than a portion stands alone."""
    sizes = [len(x) if isinstance(x, str) else 0 for x in part]
    lo = held = 0
    for i, n in enumerate(sizes):
        if i > lo and (i - lo == PORTION_ROWS or held + n > PORTION_CHARACTERS):
            yield part.iloc[lo:i]
            lo, held = i, 0
        held += n
    if lo < len(part):
        yield part.iloc[lo:]


def small(df: DataFrame, most: int = MAX_BROADCAST) -> DataFrame:
    """``df`` (settled), to be broadcast if it has at most ``most`` rows; otherwise Spark joins it by a shuffle."""
    return F.broadcast(df) if df.count() <= most else df


def numbered(df: DataFrame, order: Sequence[Column], group: str | None = None, most: int = MAX_BROADCAST) -> DataFrame:
    """``df`` (settled) with ``position`` (from 0) of each row in its group by ``order`` and ``total``, the group's rows.

    Rows are dealt by ranges of their keys and sorted within each range.  A row's place
    is its number in its range plus the rows of its group in the ranges before; only the
    counts of groups by range meet in one place.  A null group is a group.  Rows that tie
    in all of ``order`` get places in an arbitrary, but lasting order, so any number of
    equal rows is dealt over several ranges.  A table with at most ``most`` rows is
    numbered by a window.  ``df`` has no columns position, total, tie__, part__, at__ or
    begin__.
    """
    if df.count() <= most:
        within = Window.partitionBy(*([group] if group else []))
        return df.withColumns({"position": F.row_number().over(within.orderBy(*order)).cast("long") - 1, "total": F.count(F.lit(1)).over(within)})
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*([F.col(group).asc_nulls_first()] if group else []), *order, F.col("tie__").asc()]
    tied = df.withColumn("tie__", F.monotonically_increasing_id())
    dealt = settled(tied.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("tie__").withColumn("at__", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("part__", F.shiftright("at__", _PART_BITS))
    by = [group] if group else []
    within = Window.partitionBy(*by)
    runs = dealt.groupBy(*by, "part__").agg(F.count("*").alias("n"), F.min("at__").alias("first"))
    before = F.coalesce(F.sum("n").over(within.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = settled(runs.select(*[F.col(g).alias("group__") for g in by], F.col("part__").alias("run__"), (before - F.col("first")).alias("begin__"), F.sum("n").over(within).alias("total")))
    on = F.col("part__") == F.col("run__")
    if group:
        on &= F.col(group).eqNullSafe(F.col("group__"))
    found = dealt.join(small(runs), on)
    return found.withColumn("position", F.col("at__") + F.col("begin__")).drop("at__", "part__", "begin__", "run__", "group__")
