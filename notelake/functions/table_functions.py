"""Table functions for SQL: signals and secrets of each text, and the surest signals of each session (section 2.12).

    register(spark)
    SELECT m.turn, s.* FROM messages m, LATERAL detect_signals(m.text) s
    SELECT * FROM surest_signals(TABLE(messages) PARTITION BY (conv_id), 5, 0.7)
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from notelake.operators import security, signals

_TEXT, _INT, _DOUBLE = StringType(), IntegerType(), DoubleType()
_SIGNAL = [("type", _TEXT), ("match", _TEXT), ("confidence", _DOUBLE), ("context", _TEXT), ("suggested_namespace", _TEXT), ("position", _INT)]
_DETECTION = [("secret_type", _TEXT), ("start", _INT), ("end", _INT), ("confidence", _DOUBLE), ("detector", _TEXT), ("line_number", _INT), ("secret_hash", _TEXT)]


def _struct(fields: list[tuple]) -> StructType:
    return StructType([StructField(*f) for f in fields])


def _texts(argument: AnalyzeArgument, name: str) -> None:
    if argument.isTable or not isinstance(argument.dataType, StringType):
        raise ValueError(f"{name} takes a text")


class DetectSignals:
    """A row for each signal of a text, as ``signals.detect``; the least confidence may follow."""

    @staticmethod
    def analyze(text: AnalyzeArgument, min_confidence: AnalyzeArgument | None = None) -> AnalyzeResult:
        _texts(text, "detect_signals")
        return AnalyzeResult(_struct(_SIGNAL))

    def eval(self, text: str, min_confidence: float = 0.0) -> Iterator[tuple]:
        for s in signals.detect_one(text, min_confidence=float(min_confidence), most=None):
            yield tuple(s[n] for n, _ in _SIGNAL)


class DetectSecrets:
    """A row for each personal datum or secret of a text, as ``security.detect``."""

    @staticmethod
    def analyze(text: AnalyzeArgument) -> AnalyzeResult:
        _texts(text, "detect_secrets")
        return AnalyzeResult(_struct(_DETECTION))

    def eval(self, text: str) -> Iterator[tuple]:
        for d in security.detect_one(text):
            yield tuple(d[n] for n, _ in _DETECTION)


class SurestSignals:
    """The most confident signals of each partition's texts (conv_id, turn, text), ``top`` at most, which is all it holds."""

    def __init__(self) -> None:
        self.top, self.held = 0, []

    @staticmethod
    def analyze(messages: AnalyzeArgument, top: AnalyzeArgument, min_confidence: AnalyzeArgument) -> AnalyzeResult:
        if not messages.isTable or not {"conv_id", "turn", "text"} <= set(messages.dataType.fieldNames()):
            raise ValueError("surest_signals takes a table with conv_id, turn and text")
        if not top.isConstantExpression or not isinstance(top.value, int) or top.value < 1:
            raise ValueError("surest_signals takes the number of signals as a constant from 1 on")
        return AnalyzeResult(_struct([("conv_id", LongType()), ("turn", LongType()), *_SIGNAL, ("rank", _INT)]))

    def eval(self, messages: object, top: int, min_confidence: float) -> None:
        self.top = top
        for s in signals.detect_one(messages["text"], most=None):
            if s["confidence"] >= float(min_confidence):
                row = (messages["conv_id"], messages["turn"], *(s[n] for n, _ in _SIGNAL))
                key = (s["confidence"], -messages["turn"], -s["position"])
                heapq.heappush(self.held, (key, row))
                if len(self.held) > top:
                    heapq.heappop(self.held)

    def terminate(self) -> Iterator[tuple]:
        for i, (_, row) in enumerate(sorted(self.held, key=lambda x: x[0], reverse=True)):
            yield (*row, i + 1)


def register(spark: SparkSession) -> None:
    """Makes the functions known to SQL as detect_signals, detect_secrets and surest_signals."""
    from pyspark.sql.functions import udtf

    for name, handler in (("detect_signals", DetectSignals), ("detect_secrets", DetectSecrets), ("surest_signals", SurestSignals)):
        spark.udtf.register(name, udtf(handler))
