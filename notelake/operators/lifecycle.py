"""Ageing of records: transitions, sweeps, archiving (K, F19, N3)."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake import literals as L
from notelake.functions import scalar as S

ARCHIVE_DAYS, TOMBSTONE_DAYS, DELETE_DAYS, MIN_RELEVANCE, HALF_LIFE = 90.0, 180.0, 365.0, 0.1, 30.0


def can_transition(current: Column, target: Column | str) -> Column:
    """K1: whether a state may become another."""
    target = F.lit(target) if isinstance(target, str) else target
    return F.coalesce(F.concat_ws(">", current, target).isin([f"{a}>{b}" for a, b in L.TRANSITIONS]), F.lit(False))


def should_archive(as_of: Column, days: float = ARCHIVE_DAYS, min_relevance: float = MIN_RELEVANCE, half_life: float = HALF_LIFE) -> Column:
    """K2: active or resolved, and old or irrelevant."""
    state = S.status_or_active(F.col("status"))
    return state.isin("active", "resolved") & ((S.age_days("timestamp", as_of) >= days) | (S.temporal_decay("timestamp", as_of, half_life) < min_relevance))


def should_tombstone(as_of: Column, days: float = TOMBSTONE_DAYS) -> Column:
    """K2b."""
    return (S.status_or_active(F.col("status")) == "archived") & (S.age_days("timestamp", as_of) >= days)


def should_delete(as_of: Column, days: float = DELETE_DAYS) -> Column:
    """K2c."""
    return (S.status_or_active(F.col("status")) == "tombstone") & (S.age_days("timestamp", as_of) >= days)


def action(as_of: Column) -> Column:
    """K4: what a sweep does with a record, in order: delete, tombstone, archive, skip; error for an unknown state."""
    known = S.status_or_active(F.col("status")).isin(L.STATUSES)
    return F.when(~known, "error").when(should_delete(as_of), "deleted").when(should_tombstone(as_of), "tombstoned").when(should_archive(as_of), "archived").otherwise("skipped")


def sweep_stats(m: DataFrame, as_of: Column) -> DataFrame:
    """K4, K6, N3f: how many records a sweep would delete, tombstone, archive, skip, and fail on; processed is the sum of the first three."""
    a = action(as_of)
    return m.select(a.alias("a")).agg(
        F.count(F.lit(1)).alias("scanned"), *(F.count_if(F.col("a") == n).alias(n) for n in ("archived", "tombstoned", "deleted", "skipped")), F.count_if(F.col("a") == "error").alias("errors"), F.count_if(F.col("a").isin("archived", "tombstoned", "deleted")).alias("processed")
    )


def _unpacked(data: bytes | None) -> str | None:
    try:
        return None if data is None else zlib.decompress(data).decode()
    except (zlib.error, UnicodeDecodeError):
        return None


def compress(text: Column) -> Column:
    """K7: zlib at level 6."""

    @F.pandas_udf("binary")
    def run(part: pd.Series) -> pd.Series:
        return part.map(lambda t: None if t is None else zlib.compress(t.encode(), 6))

    return run(text)


def decompress(data: Column) -> Column:
    """Null for data that is no zlib stream of UTF-8."""

    @F.pandas_udf("string")
    def run(part: pd.Series) -> pd.Series:
        return part.map(_unpacked)

    return run(data)


def compression_ratio(text: Column, data: Column) -> Column:
    """Compressed by original bytes; 1 for an empty text."""
    return F.when(F.octet_length(text) == 0, F.lit(1.0)).otherwise(F.octet_length(data) / F.octet_length(text))


def transition(m: DataFrame, ids: DataFrame, target: str, squeeze: bool = False, keep_bytes: bool = False) -> DataFrame:
    """K3, K5, N3-N3d: ``m`` with the records of ``ids`` in state ``target`` where that is allowed.

    Archiving with ``squeeze`` replaces the content by a description; ``keep_bytes`` keeps
    the compressed original in content_z.  Tombstones lose summary, content and tags.
    """
    marked = m.join(ids.select("id").distinct().withColumn("__hit", F.lit(True)), "id", "left")
    go = F.coalesce(F.col("__hit"), F.lit(False)) & can_transition(S.status_or_active(F.col("status")), target)
    out = marked.withColumn("__go", go)
    if target == "archived" and squeeze:
        fresh = F.col("__go") & ~F.col("content").startswith(L.ARCHIVED_PREFIX)
        out = out.withColumn("__z", compress(F.when(fresh, F.col("content"))))
        note = F.format_string(L.ARCHIVED_PREFIX + "[Compressed: %d bytes, ratio: %.2f] Original summary: %s", F.octet_length("__z"), compression_ratio(F.col("content"), F.col("__z")), F.col("summary"))
        out = out.withColumn("content", F.when(fresh, note).otherwise(F.col("content")))
        out = out.withColumnRenamed("__z", "content_z") if keep_bytes else out.drop("__z")
    if target == "tombstone":
        out = out.withColumns({"summary": F.when(F.col("__go"), "").otherwise(F.col("summary")), "content": F.when(F.col("__go"), "").otherwise(F.col("content")), "tags": F.when(F.col("__go"), F.array().cast("array<string>")).otherwise(F.col("tags"))})
    return out.withColumn("status", F.when(F.col("__go"), target).otherwise(F.col("status"))).drop("__hit", "__go")


def sweep(m: DataFrame, as_of: Column) -> DataFrame:
    """K4, K6: the records after a sweep: some gone, some tombstoned or archived; one pass, no shuffle."""
    a = F.col("__a")
    out = m.withColumn("__a", action(as_of)).filter(a != "deleted")
    empty = a == "tombstoned"
    out = out.withColumns({"summary": F.when(empty, "").otherwise(F.col("summary")), "content": F.when(empty, "").otherwise(F.col("content")), "tags": F.when(empty, F.array().cast("array<string>")).otherwise(F.col("tags"))})
    return out.withColumn("status", F.when(empty, "tombstone").when(a == "archived", "archived").otherwise(F.col("status"))).drop("__a")


def delete(m: DataFrame, ids: DataFrame) -> DataFrame:
    """A8, A8b, N3e: ``m`` without some ids."""
    return m.join(ids.select("id").distinct(), "id", "left_anti")


def stale(m: DataFrame, as_of: Column, max_relevance: float = 0.3, min_age_days: float = 30.0) -> DataFrame:
    """active records that are old and little relevant, least relevant first."""
    relevance = S.temporal_decay("timestamp", as_of, HALF_LIFE)
    return m.filter(S.status_or_active(F.col("status")) == "active").withColumn("relevance", relevance).filter((F.col("relevance") <= max_relevance) & (S.age_days("timestamp", as_of) >= min_age_days)).orderBy("relevance", "id")
