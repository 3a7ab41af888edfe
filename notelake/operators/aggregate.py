"""Aggregations over records (E)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake import literals as L
from notelake.functions import scalar as S


def stats(m: DataFrame) -> DataFrame:
    """Total, and counts by namespace and spec, in one pass (kind, key, n); a missing spec is not counted."""
    sets = m.groupingSets([["namespace"], ["spec"], []], "namespace", "spec").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 1, "namespace").when(F.col("g") == 2, "spec").otherwise("total")
    out = sets.select(kind.alias("kind"), F.when(F.col("g") == 1, F.col("namespace")).when(F.col("g") == 2, F.col("spec")).alias("key"), "n")
    return out.filter((F.col("kind") == "total") | F.col("key").isNotNull()).orderBy("kind", F.col("n").desc(), "key")


def lifecycle_summary(m: DataFrame) -> DataFrame:
    """Number of records in each state, zeros included, and their total, in one row."""
    state = S.status_or_active(F.col("status"))
    counts = [F.count_if(state == s).alias(s) for s in L.STATUSES]
    return m.agg(*counts, F.count_if(state.isin(L.STATUSES)).alias("total"))


def spec_context(m: DataFrame, full: bool = False) -> DataFrame:
    """For each spec the number of records and a token estimate; ``full`` counts contents too."""
    size = F.length("summary") + (F.length("content") if full else F.lit(0)) + 50
    return m.filter(F.col("spec").isNotNull()).groupBy("spec").agg(F.count(F.lit(1)).alias("n"), F.floor(F.sum(size) * F.lit(0.25)).cast("long").alias("tokens"))


def grouped_by_namespace(m: DataFrame) -> DataFrame:
    """E5: ids of each namespace, newest first.  A namespace's ids are one row; for large ones use ``lookup.by_namespace``."""
    return m.groupBy("namespace").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.unix_micros("timestamp")).alias("t"), "id"))), lambda x: x["id"]).alias("ids"))


def capture_totals(captures: DataFrame) -> DataFrame:
    """Captures by namespace with successes."""
    return captures.groupBy("namespace").agg(F.count(F.lit(1)).alias("n"), F.count_if("success").alias("successful"))


def audit_stats(audit: DataFrame) -> DataFrame:
    """Audit entries by event type, namespace, action and secret type (kind, key, n), in one pass over exploded keys."""
    keys = [F.struct(F.lit("event_type").alias("kind"), F.col("event_type").alias("key")), F.struct(F.lit("namespace").alias("kind"), F.col("namespace").alias("key")), F.struct(F.lit("action").alias("kind"), F.col("action").alias("key"))]
    types = F.transform("secret_types", lambda t: F.struct(F.lit("secret_type").alias("kind"), t.alias("key")))
    return audit.select(F.explode(F.concat(F.array(*keys), types)).alias("k")).groupBy("k.kind", "k.key").agg(F.count(F.lit(1)).alias("n"))


def by_type(rows: DataFrame, array: str, *keys: str) -> DataFrame:
    """Elements of an array column of structs with a type field, grouped by it."""
    e = rows.select(*keys, F.explode(array).alias("e"))
    field = "secret_type" if "secret_type" in e.schema["e"].dataType.fieldNames() else "type"
    return e.groupBy(*keys, F.col(f"e.{field}").alias("type")).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("e")).alias("items"))


def complexity(n: Column) -> Column:
    """Tier of a project by its number of records."""
    return F.when(n < 10, "simple").when(n < 50, "medium").when(n < 200, "complex").otherwise("full")
