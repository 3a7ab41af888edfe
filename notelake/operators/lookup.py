"""Point lookups, filters, top-k and text search over records (B, N1)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.functions import scalar as S


def _where(m: DataFrame, namespace: str | None = None, spec: str | None = None, status: str | None = None) -> DataFrame:
    for column, value in (("namespace", namespace), ("spec", spec), ("status", status)):
        if value is not None:
            m = m.filter((S.status_or_active(F.col("status")) if column == "status" else F.col(column)) == value)
    return m


def newest(m: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest first, ties by id; a limit makes it a top-k without a full sort."""
    ordered = m.orderBy(F.col("timestamp").desc(), "id")
    return ordered if limit is None else ordered.limit(limit)


def get(m: DataFrame, memory_id: str) -> DataFrame:
    """The record of an id."""
    return m.filter(F.col("id") == memory_id).limit(1)


def get_batch(m: DataFrame, ids: Sequence[str] | DataFrame) -> DataFrame:
    """The records of some ids (a list, or a DataFrame with id); missing ones are left out."""
    return m.join(ids.select("id").distinct(), "id", "left_semi") if isinstance(ids, DataFrame) else m.filter(F.col("id").isin(list(ids)))


def by_spec(m: DataFrame, spec: str, namespace: str | None = None, limit: int | None = None) -> DataFrame:
    """B3, N1d."""
    return newest(_where(m, namespace, spec), limit)


def by_commit(m: DataFrame, sha: str) -> DataFrame:
    """Oldest first."""
    return m.filter(F.col("commit_sha") == sha).orderBy("timestamp", "id")


def by_namespace(m: DataFrame, namespace: str, spec: str | None = None, limit: int | None = None) -> DataFrame:
    """B5, N1c."""
    return newest(_where(m, namespace, spec), limit)


def list_recent(m: DataFrame, limit: int = 10, namespace: str | None = None, spec: str | None = None) -> DataFrame:
    """B6, N1e: the newest records, with distance 0."""
    return newest(_where(m, namespace, spec), limit).withColumn("distance", F.lit(0.0))


def all_ids(m: DataFrame) -> DataFrame:
    """B7."""
    return m.select("id")


def all_memories(m: DataFrame, namespace: str | None = None) -> DataFrame:
    """B8."""
    return newest(_where(m, namespace))


def exists(m: DataFrame, ids: DataFrame) -> DataFrame:
    """Id and whether ``m`` (records, or vectors) has it."""
    return ids.select("id").distinct().join(m.select("id").distinct().withColumn("found", F.lit(True)), "id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def typed(rows: DataFrame) -> DataFrame:
    """Stored text fields as typed columns: list of tags, timestamp, status with its default."""
    return rows.withColumns({"tags": S.split_list(F.col("tags")), "relates_to": S.split_list(F.col("relates_to")), "timestamp": S.parse_timestamp(F.col("timestamp")), "status": S.status_or_active(F.col("status"))})


def search_text(m: DataFrame, query: str, limit: int = 10, namespace: str | None = None, spec: str | None = None) -> DataFrame:
    """Records whose summary or content contains the query; a blank query finds nothing."""
    if not query.strip():
        return m.limit(0)
    return newest(_where(m, namespace, spec).filter(S.contains_like(F.col("summary"), query) | S.contains_like(F.col("content"), query)), limit)


def select_by(m: DataFrame, spec: str | None = None, namespace: str | None = None, status: str | None = None) -> DataFrame:
    """Records by spec, namespace and status; pushed down to the scan."""
    return _where(m, namespace, spec, status)


def list_patterns(patterns: DataFrame, status: str | None = None, pattern_type: str | None = None) -> DataFrame:
    """Patterns by status and type, most confident first."""
    if status is not None:
        patterns = patterns.filter(F.col("status") == status)
    if pattern_type is not None:
        patterns = patterns.filter(F.col("pattern_type") == pattern_type)
    return patterns.orderBy(F.col("confidence").desc(), "name")


def get_pattern(patterns: DataFrame, name: str) -> DataFrame:
    """The pattern of a name."""
    return patterns.filter(F.col("name") == name).limit(1)


def without_embeddings(m: DataFrame, vectors: DataFrame, limit: int | None = None) -> DataFrame:
    """Ids of records without a vector."""
    missing = m.select("id").join(vectors.select("id"), "id", "left_anti")
    return missing if limit is None else missing.orderBy("id").limit(limit)


def spans_matching(spans: DataFrame, operation: str | None = None, status: str | None = None, limit: int = 20) -> DataFrame:
    """Finished spans by part of the operation's name and status, latest end first."""
    if operation:
        spans = spans.filter(F.lower("operation").contains(operation.lower()))
    if status:
        spans = spans.filter(F.col("status") == status)
    return spans.orderBy(F.coalesce("end_time", "start_time").desc(), "span_id").limit(limit)


def metrics_matching(series: DataFrame, name: str) -> DataFrame:
    """B20."""
    return series.filter(F.col("name").contains(name))


def count(m: DataFrame, namespace: str | None = None, spec: str | None = None) -> DataFrame:
    """One row with the number of records."""
    return _where(m, namespace, spec).agg(F.count(F.lit(1)).alias("n"))


def hydrate(results: DataFrame, notes: DataFrame, commits: DataFrame | None = None, files: DataFrame | None = None, level: str = "summary") -> DataFrame:
    """Results with full note ("full"), and with commit and files at that commit ("files").

    What is missing is null.  ``notes``: namespace, commit_sha, note; ``commits``: sha and fields; ``files``: sha, path, content.
    """
    if level == "summary":
        return results
    note = notes.groupBy("namespace", "commit_sha").agg(F.min("note").alias("full_content"))
    out = results.join(note, ["namespace", "commit_sha"], "left")
    if commits is not None:
        fields = [c for c in commits.columns if c != "sha"]
        out = out.join(commits.dropDuplicates(["sha"]).select(F.col("sha").alias("commit_sha"), F.struct("sha", *fields).alias("commit")), "commit_sha", "left")
    if level == "files" and files is not None:
        held = files.join(results.select(F.col("commit_sha").alias("sha")).distinct(), "sha", "left_semi").dropDuplicates(["sha", "path"])
        out = out.join(held.groupBy(F.col("sha").alias("commit_sha")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "content")))).alias("files")), "commit_sha", "left")
    return out


def with_prefix(short: DataFrame, commits: DataFrame, sha: Column | str = "sha7") -> DataFrame:
    """Full sha of each short one (the smallest that begins so), by equality of seven characters."""
    full = commits.select(F.substring("sha", 1, 7).alias("__p"), "sha").groupBy("__p").agg(F.min("sha").alias("commit_sha"))
    return short.join(full, F.substring(F.col(sha) if isinstance(sha, str) else sha, 1, 7) == F.col("__p"), "left").drop("__p")
