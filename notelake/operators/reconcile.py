"""Which records differ between two tables, by digests of ranges instead of a join of all rows.

Both sides are digested by ranges of their ids' hashes.  A digest does not depend on the
order of rows, so tasks digest what they have and only a row for each range and task is
shuffled.  Ranges that agree are done; those that differ are digested again in finer
ranges, and only rows of ranges that still differ are joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.functions.tables import settled, small
from notelake.operators.sync import columns

#: Bits of a hash that one level tells apart.
BITS = 10
#: Rows of a range, on average, from which on it is joined.
ROWS = 64


def _prefix(bits: int) -> Column:
    return F.shiftrightunsigned("h", 64 - bits)


def _digests(df: DataFrame, keys: list[str], bits: int, name: str) -> DataFrame:
    both = (F.bit_xor(F.xxhash64(*keys, "value")), F.bit_xor(F.xxhash64(F.lit(1), *keys, "value")))
    return df.groupBy(_prefix(bits).alias("range")).agg(F.struct(F.count(F.lit(1)).alias("n"), both[0].alias("x"), both[1].alias("y")).alias(name))


def differing(left: DataFrame, right: DataFrame, bits: int = BITS, rows: int = ROWS, key: str | Sequence[str] = "id") -> tuple[DataFrame, DataFrame]:
    """The rows (key, value) of both sides that lie in ranges whose digests differ.

    Keys are unique on each side and not null.  Equal tables leave nothing; where most
    ranges differ, finer ones are not tried, as a join of all is cheaper then.
    """
    keys = columns(key)
    sides = [settled(df.select(*keys, "value").withColumn("h", F.xxhash64(*keys))) for df in (left, right)]
    depth = bits
    while True:
        a, b = (_digests(s, keys, depth, n) for s, n in zip(sides, ("a", "b"), strict=True))
        size = F.greatest(F.coalesce("a.n", F.lit(0)), F.coalesce("b.n", F.lit(0)))
        all_ = a.join(b, "range", "full_outer").select("range", size.alias("n"), (~F.col("a").eqNullSafe(F.col("b"))).alias("off"))
        all_ = settled(all_)
        ranges, off, inside = all_.agg(F.count(F.lit(1)), F.count_if("off"), F.coalesce(F.sum(F.when(F.col("off"), F.col("n"))), F.lit(0))).first()
        some = small(settled(all_.filter("off").select(F.col("range").alias("r"))))
        sides = [s.join(some, _prefix(depth) == F.col("r"), "left_semi") for s in sides]
        if not off or inside <= rows * off or 2 * off > ranges or depth + bits > 60:
            return tuple(s.drop("h") for s in sides)
        depth += bits


def _values(df: DataFrame, keys: list[str], no_summary: str) -> DataFrame:
    return df.select(*keys, F.md5(F.concat_ws("|", F.coalesce("summary", F.lit(no_summary)), F.coalesce("content", F.lit("")))).alias("value"))


def verify(expected: DataFrame, indexed: DataFrame, bits: int = BITS, rows: int = ROWS, key: str | Sequence[str] = "id") -> DataFrame:
    """As ``sync.verify`` (key and problem: missing, orphaned, mismatched), for tables that differ little.

    What is shuffled follows the differences, not the tables.
    """
    keys = columns(key)
    a, b = differing(_values(expected, keys, "None"), _values(indexed, keys, ""), bits, rows, keys)
    problem = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "orphaned").when(F.col("a") != F.col("b"), "mismatched")
    both = a.withColumnRenamed("value", "a").join(b.withColumnRenamed("value", "b"), keys, "full_outer")
    return both.select(*keys, problem.alias("problem")).filter(F.col("problem").isNotNull())
