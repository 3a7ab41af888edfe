"""Consistency between notes and the table, upserts, and merging of notes (G, A4-A10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.operators import notes


#: Columns that tell records apart: an id holds seven digits of its commit, so records of two commits can share one.
RECORD = ("id", "commit_sha")
PROBLEMS = ("missing", "orphaned", "mismatched")


def columns(key: str | Sequence[str]) -> list[str]:
    """The columns of a key: its name, or several."""
    return [key] if isinstance(key, str) else list(key)


def insert(m: DataFrame, new: DataFrame, key: str | Sequence[str] = "id") -> DataFrame:
    """A4, A5: ``new`` records whose key is not in ``m``, each once; these are to be appended."""
    k = columns(key)
    return new.dropDuplicates(k).join(m.select(*k), k, "left_anti").select(*new.columns)


def upsert(m: DataFrame, changed: DataFrame, key: str | Sequence[str] = "id") -> DataFrame:
    """``m`` with the rows of ``changed`` in place of those with their key; keys that ``m`` lacks are added."""
    k = columns(key)
    fresh = changed.dropDuplicates(k)
    return m.join(fresh.select(*k), k, "left_anti").select(*m.columns).unionByName(fresh.select(*m.columns))


def update(m: DataFrame, changed: DataFrame, key: str | Sequence[str] = "id") -> DataFrame:
    """As ``upsert``, but keys that ``m`` lacks stay absent."""
    k = columns(key)
    return upsert(m, changed.join(m.select(*k), k, "left_semi"), k)


def verify(expected: DataFrame, indexed: DataFrame, key: str | Sequence[str] = "id") -> DataFrame:
    """Key and problem (missing, orphaned, mismatched) where notes and table differ; one full outer join.

    Contents differ by the md5 of summary|content; a missing summary is the text None among the notes and empty in the table.
    """
    k = columns(key)
    a = expected.select(*k, F.md5(F.concat_ws("|", F.coalesce("summary", F.lit("None")), F.coalesce("content", F.lit("")))).alias("a"))
    b = indexed.select(*k, F.md5(F.concat_ws("|", F.coalesce("summary", F.lit("")), F.coalesce("content", F.lit("")))).alias("b"))
    problem = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "orphaned").when(F.col("a") != F.col("b"), "mismatched")
    return a.join(b, k, "full_outer").select(*k, problem.alias("problem")).filter(F.col("problem").isNotNull())


def verification(problems: DataFrame, ids: bool = False) -> DataFrame:
    """How many records have each problem (or, with ``ids``, their sorted ids), how many in all, and whether all is well, in one row."""
    each = (lambda hit: F.sort_array(F.collect_list(F.when(hit, F.col("id"))))) if ids else F.count_if
    found = [each(F.col("problem") == p).alias(p) for p in PROBLEMS]
    return problems.agg(*found, F.count("problem").alias("total_issues")).withColumn("is_consistent", F.col("total_issues") == 0)


def repair(indexed: DataFrame, expected: DataFrame, key: str | Sequence[str] = "id") -> DataFrame:
    """The table without orphans and with missing and mismatched records from the notes."""
    k = columns(key)
    problems = verify(expected, indexed, k)
    kept = indexed.join(problems.select(*k), k, "left_anti").select(*indexed.columns)
    again = expected.join(problems.filter("problem <> 'orphaned'").select(*k), k, "left_semi")
    return kept.unionByName(again.select(*indexed.columns))


def reindex(records: DataFrame, indexed: DataFrame | None = None, key: str | Sequence[str] = "id") -> DataFrame:
    """Records to write: all of them, or (with ``indexed``) only those that are not there yet."""
    return records.dropDuplicates(columns(key)) if indexed is None else insert(indexed, records, key)


def merge_notes(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Notes of both sides by (namespace, commit_sha): the different lines of both, sorted."""
    both = ours.select("namespace", "commit_sha", "note").unionByName(theirs.select("namespace", "commit_sha", "note"))
    lines = both.select("namespace", "commit_sha", F.explode(F.split("note", "\n")).alias("line")).distinct()
    return lines.groupBy("namespace", "commit_sha").agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("note"))


def fetch_notes(tracking: DataFrame, remote: DataFrame, namespaces: list[str] | None = None) -> DataFrame:
    """The tracking table with the remote's notes of some namespaces (all by default) in place of its own."""
    wanted = F.lit(True) if namespaces is None else F.col("namespace").isin(namespaces)
    return tracking.filter(~wanted).unionByName(remote.filter(wanted).select(*tracking.columns))


def push_notes(remote: DataFrame, ours: DataFrame) -> DataFrame:
    """A43d: the remote's notes with ours in place of those of the same commit and namespace."""
    key = ["namespace", "commit_sha"]
    return remote.join(ours.select(*key), key, "left_anti").select(*remote.columns).unionByName(ours.select(*remote.columns))


def sync_remote(ours: DataFrame, remote: DataFrame, as_of: Column, indexed: DataFrame | None = None, key: str | Sequence[str] = "id") -> tuple[DataFrame, DataFrame]:
    """The merged notes of both sides, to be pushed, and their records that are not ``indexed`` yet."""
    merged = merge_notes(ours, remote)
    return merged, reindex(notes.to_memories(notes.records(merged), as_of), indexed, key)


def sync_notes(m: DataFrame, raw: DataFrame, as_of: Column, key: str | Sequence[str] = "id") -> DataFrame:
    """``m`` with every record of some notes (``raw``: namespace, commit_sha, note) added or in place of the one with its key."""
    fresh = notes.to_memories(notes.records(raw), as_of)
    missing = [F.lit(None).cast(m.schema[c].dataType).alias(c) for c in m.columns if c not in fresh.columns]
    return upsert(m, fresh.select("*", *missing), key)
