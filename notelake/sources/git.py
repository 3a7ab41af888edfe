"""Notes and commits of a git repository as Spark sources, a partition for each namespace.

    spark.dataSource.register(GitNotes)
    spark.read.format("commit_notes").option("repo", path).option("prefix", "refs/notes/mem").load()
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from notelake import literals as L
from notelake import schema


def git(repo: str, *args: str, data: bytes | None = None) -> bytes:
    return subprocess.run(["git", "-C", repo, *args], input=data, capture_output=True, check=True, timeout=30).stdout


class _Namespace(InputPartition):
    def __init__(self, namespace: str):
        super().__init__(namespace)


class GitNotes(DataSource):
    """All notes under ``prefix``/<namespace>: namespace, commit_sha, note.  A namespace that cannot be read has none."""

    @classmethod
    def name(cls) -> str:
        return "commit_notes"

    def schema(self) -> str:
        return schema.RAW_NOTES

    def reader(self, schema: object) -> DataSourceReader:
        return _NotesReader(self.options["repo"], self.options.get("prefix", "refs/notes/mem"), self.options.get("namespaces", ",".join(L.NAMESPACES)).split(","))


class _NotesReader(DataSourceReader):
    def __init__(self, repo: str, prefix: str, namespaces: list[str]):
        self.repo, self.prefix, self.namespaces = repo, prefix, namespaces

    def partitions(self) -> list[InputPartition]:
        return [_Namespace(n) for n in self.namespaces]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        try:
            listed = git(self.repo, "notes", f"--ref={self.prefix}/{partition.value}", "list").decode().split("\n")
            pairs = [tuple(x.split()) for x in listed if x.strip()]
            yield from zip([partition.value] * len(pairs), [c for _, c in pairs], blobs(self.repo, [b for b, _ in pairs]), strict=True)
        except (subprocess.CalledProcessError, subprocess.TimeoutExpired):
            return


def blobs(repo: str, names: list[str]) -> list[str | None]:
    """Contents of many objects through one process; None for one that is missing."""
    raw = git(repo, "cat-file", "--batch", data="".join(f"{n}\n" for n in names).encode()) if names else b""
    out: list[str | None] = []
    at = 0
    for _ in names:
        end = raw.index(b"\n", at)
        head = raw[at:end].split()
        if head[-1] == b"missing":
            out.append(None)
            at = end + 1
        else:
            size = int(head[-1])
            out.append(raw[end + 1 : end + 1 + size].decode("utf-8", "replace"))
            at = end + 2 + size
    return out


def commits(spark: SparkSession, repo: str, revisions: str = "HEAD") -> DataFrame:
    """Sha, author, email, ISO date and subject of each commit that ``revisions`` reaches."""
    text = git(repo, "log", "--format=%H%x1f%an%x1f%ae%x1f%aI%x1f%s%x1e", revisions, "--").decode()
    return spark.createDataFrame([tuple(x.strip("\n").split("\x1f")) for x in text.split("\x1e") if x.strip()], schema.COMMITS)


def commit_files(spark: SparkSession, repo: str, sha: str) -> DataFrame:
    """Changed files of a commit with their contents then (null if gone)."""
    paths = [p for p in git(repo, "diff-tree", "--no-commit-id", "--name-only", "-r", "--root", sha).decode().split("\n") if p]
    return spark.createDataFrame(list(zip([sha] * len(paths), paths, blobs(repo, [f"{sha}:{p}" for p in paths]), strict=True)), schema.COMMIT_FILES)


def write_note(repo: str, prefix: str, namespace: str, sha: str, note: str, mode: str = "append") -> None:
    """Appends, overwrites or removes the note of a commit."""
    ref = f"--ref={prefix}/{namespace}"
    if mode == "remove":
        git(repo, "notes", ref, "remove", "--ignore-missing", sha)
    else:
        git(repo, "notes", ref, *(["append"] if mode == "append" else ["add", "-f"]), "-F", "-", sha, data=note.encode())
