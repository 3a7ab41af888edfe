"""Helpers of the driver: telemetry of calls, shared services, projects."""

from __future__ import annotations

import contextlib
import functools
import hashlib
import json
import os
import re
import time
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from notelake import schema


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path that all executors reach: below ``spark.checkpoint.dir``, else the warehouse."""
    conf = spark.sparkContext.getConf()
    top = conf.get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Telemetry:
    """Observations and spans of this process, to be turned into tables.  The last ``spans`` spans are kept."""

    def __init__(self, spans: int = 1000, clock: Callable[[], float] = time.time):
        self._rows: list[tuple] = []
        self._spans: deque[dict] = deque(maxlen=spans)
        self._open: list[dict] = []
        self._trace: str | None = None
        self._clock = clock

    def _add(self, name: str, kind: str, value: float, labels: dict[str, str] | None) -> None:
        self._rows.append((datetime.fromtimestamp(self._clock(), timezone.utc), name, kind, dict(labels or {}), float(value)))

    def increment(self, name: str, amount: float = 1.0, labels: dict[str, str] | None = None) -> None:
        self._add(name, "counter", amount, labels)

    def observe(self, name: str, value: float, labels: dict[str, str] | None = None) -> None:
        self._add(name, "histogram", value, labels)

    def set_gauge(self, name: str, value: float, labels: dict[str, str] | None = None) -> None:
        self._add(name, "set", value, labels)

    def change_gauge(self, name: str, amount: float, labels: dict[str, str] | None = None) -> None:
        self._add(name, "add", amount, labels)

    @contextlib.contextmanager
    def timed(self, name: str, labels: dict[str, str] | None = None) -> Iterator[None]:
        """M3, N9d: duration in ms of a block, with its outcome as a label."""
        began, status = self._clock(), "error"
        try:
            yield
            status = "success"
        finally:
            self.observe(f"{name}_duration_ms", (self._clock() - began) * 1000, {**(labels or {}), "status": status})

    def measured(self, name: str, labels: dict[str, str] | None = None) -> Callable:
        """M1: a decorator that times calls and records a span."""

        def wrap(f: Callable) -> Callable:
            @functools.wraps(f)
            def run(*args: object, **kwargs: object) -> object:
                with self.timed(name, labels), self.span(name, **(labels or {})):
                    return f(*args, **kwargs)

            return run

        return wrap

    def start_trace(self, trace_id: str | None = None) -> str:
        """N9c."""
        self._trace = trace_id or uuid.uuid4().hex
        return self._trace

    @contextlib.contextmanager
    def span(self, operation: str, **tags: object) -> Iterator[dict]:
        """M2: a span below the one that is open; an exception makes its status error."""
        s = {
            "trace_id": self._open[-1]["trace_id"] if self._open else self._trace or uuid.uuid4().hex, "span_id": uuid.uuid4().hex[:16], "parent_span_id": self._open[-1]["span_id"] if self._open else None, "operation": operation,
            "start_time": self._clock(), "end_time": None, "tags": {k: str(v) for k, v in tags.items()}, "status": "ok", "error_message": None,
        }
        self._open.append(s)
        try:
            yield s
        except BaseException as e:
            s.update(status="error", error_message=str(e))
            raise
        finally:
            s["end_time"] = self._clock()
            self._open.pop()
            self._spans.append(s)

    def observations(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self._rows, schema.OBSERVATIONS)

    def spans(self, spark: SparkSession) -> DataFrame:
        """N9."""
        names = [c.split()[0] for c in schema.SPANS.replace("MAP<STRING,STRING>", "M").split(", ")]
        return spark.createDataFrame([tuple(s[n] for n in names) for s in self._spans], schema.SPANS)

    def clear(self) -> None:
        self._rows.clear()
        self._spans.clear()


class Registry:
    """One instance of each service; others can be put in their place, as tests do."""

    def __init__(self) -> None:
        self._held: dict[type, object] = {}

    def get(self, kind: type, **options: object) -> object:
        if kind not in self._held:
            self._held[kind] = kind(**options)
        return self._held[kind]

    def register(self, kind: type, instance: object) -> None:
        self._held[kind] = instance

    def reset(self, kind: type | None = None) -> None:
        self._held.clear() if kind is None else self._held.pop(kind, None)


def detect_project(folder: str) -> dict[str, str | None]:
    """Root (with .git), name (pyproject.toml, package.json, folder) and identifier of the project around a folder."""
    root = folder = os.path.abspath(folder)
    while not os.path.isdir(os.path.join(root, ".git")):
        up = os.path.dirname(root)
        if up == root:
            root = folder
            break
        root = up
    name = None
    with contextlib.suppress(OSError):
        with open(os.path.join(root, "pyproject.toml")) as f:
            name = (m := re.search(r"(?m)^name\s*=\s*[\"']([^\"']+)", f.read())) and m[1]
    if not name:
        with contextlib.suppress(OSError, ValueError, AttributeError):
            with open(os.path.join(root, "package.json")) as f:
                name = json.load(f).get("name")
    return {"root": root, "name": name or os.path.basename(root), "id": hashlib.sha256(root.encode()).hexdigest()[:12]}


def session_id(host: str, repo: str, started: datetime) -> str:
    """Session of a process: host, hash of the repository, start in hex, chance."""
    return f"{host}:{hashlib.sha256(repo.encode()).hexdigest()[:8]}:{int(started.timestamp()):x}:{uuid.uuid4().hex[:8]}"
