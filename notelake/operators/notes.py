"""Notes: YAML front matter with a Markdown body."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from notelake import literals as L
from notelake.functions import scalar as S

# White space of any kind, as ``str.strip`` has it.
_BLANK = r"[\s\x1c-\x1f]"
_BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


#: Texts and names up to these lengths stand on one line of a YAML file; what they have to look like to need no quotes, and words that would be read as something else.
_SHORT, _SHORT_NAME = 60, 16
_PLAIN = r"\A[A-Za-z][A-Za-z0-9_/.-]*(?: [A-Za-z0-9_/.-]+)*\z"
_READ_OTHERWISE = ["yes", "no", "true", "false", "on", "off", "null"]


def _strip(x: Column) -> Column:
    return F.btrim(x, F.lit(_BLANKS))


def _lines(lines: Column, first: Column, end: Column) -> Column:
    return F.array_join(F.slice(lines, first + 1, F.greatest(end - first, F.lit(0))), "\n")


def split_notes(text: Column | str) -> Column:
    """The notes in a text as an array of idx, raw, head (front matter as it stands) and body; null stays null.

    The lines that are --- alone come in pairs; the first of a pair opens a note, which
    goes on to the next pair, and the second closes its front matter (head is null if there
    is none).  A text without such lines is one part without head.
    """
    x = S._col(text)

    def parts(lines: Column) -> Column:
        marks = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(lines, i).contains("---") & (_strip(F.get(lines, i)) == "---"))

        def part(marks: Column, k: Column) -> Column:
            mark = lambda j, default: F.coalesce(F.get(marks, 2 * k + j), default)
            opens, closes, end = F.get(marks, 2 * k), F.get(marks, 2 * k + 1), mark(2, F.size(lines))
            return F.struct(k.alias("idx"), _lines(lines, opens, end).alias("raw"), F.when(closes.isNotNull(), _lines(lines, opens + 1, closes)).alias("head"), F.when(closes.isNotNull(), _strip(_lines(lines, closes + 1, end))).otherwise("").alias("body"))

        whole = F.array(F.struct(F.lit(0).alias("idx"), F.array_join(lines, "\n").alias("raw"), F.lit(None).cast("string").alias("head"), F.lit("").alias("body")))
        return _bound(marks, lambda m: F.when(F.size(m) == 0, whole).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(m), F.lit(1)) - 1) / 2).cast("int")), lambda k: part(m, k))))

    return F.when(x.isNotNull(), _bound(F.split(x, "\n", -1), parts))


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value worked out once, also where ``f`` uses it inside of lambdas."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _text(value: object) -> str:
    return ",".join(str(v) for v in value) if isinstance(value, list) else str(value)


def parse_front_matter(head: str | None) -> tuple[dict[str, str] | None, str | None]:
    """Front matter as text pairs or, where it cannot be parsed, the error."""
    import yaml

    try:
        data = yaml.load(head, getattr(yaml, "CSafeLoader", yaml.SafeLoader))
    except yaml.YAMLError:
        return None, "invalid YAML"
    if not isinstance(data, dict):
        return None, "front matter is no mapping"
    return {str(k): _text(v) for k, v in data.items() if v is not None}, None


def _parsed(heads: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(None, None) if h is None else parse_front_matter(h) for h in heads], columns=["front_matter", "error"])


def parse_notes(rows: DataFrame, column: str = "note") -> DataFrame:
    """All notes in a text column, in place of it: idx, front_matter, body, raw and, where a part cannot be parsed, error.

    Texts are split by expressions; only front matter goes to Python.
    """
    parts = rows.select(*(c for c in rows.columns if c != column), F.explode(split_notes(F.col(column))).alias("n"))
    parsed = F.pandas_udf(_parsed, "front_matter map<string, string>, error string")
    parts = parts.select("*", "n.*", parsed(F.col("n")["head"]).alias("p")).drop("n")
    opened = F.col("raw").rlike(rf"(?U)\A{_BLANK}*---{_BLANK}*(?:\n|\z)")
    why = F.when(_strip(F.col("raw")) == "", "empty").when(~opened, "no front matter").when(F.col("head").isNull(), "front matter not closed")
    return parts.withColumns({"front_matter": F.col("p.front_matter"), "error": F.coalesce(why, "p.error")}).drop("p", "head")


def records(raw: DataFrame, keep_bad: bool = False) -> DataFrame:
    """Note records of ``raw`` (namespace, commit_sha, note); a note's own type wins over the namespace."""
    out = parse_notes(raw.select("commit_sha", "namespace", "note"))
    if not keep_bad:
        out = out.filter(F.col("error").isNull())
    return out.withColumn("namespace", F.coalesce(F.try_element_at("front_matter", F.lit("type")), "namespace"))


def missing_fields(front_matter: Column) -> Column:
    """A26, N7e: required fields that are absent."""
    return F.array_except(F.array(*map(F.lit, L.REQUIRED_FIELDS)), F.map_keys(front_matter))


def to_memories(notes: DataFrame, as_of: Column) -> DataFrame:
    """Records as memories; a bad or missing timestamp is ``as_of``, a missing summary empty, a missing status active."""
    get = lambda k: F.try_element_at("front_matter", F.lit(k))
    return notes.select(
        S.memory_id(F.col("namespace"), F.col("commit_sha"), F.col("idx")).alias("id"),
        "commit_sha",
        "namespace",
        F.coalesce(get("summary"), F.lit("")).alias("summary"),
        F.col("body").alias("content"),
        F.coalesce(S.parse_timestamp(get("timestamp")), as_of).alias("timestamp"),
        get("spec").alias("spec"),
        get("phase").alias("phase"),
        S.split_list(get("tags")).alias("tags"),
        S.status_or_active(get("status")).alias("status"),
        S.split_list(get("relates_to")).alias("relates_to"),
        missing_fields(F.col("front_matter")).alias("missing_fields"),
    )


def serialize(front_matter: dict[str, object], body: str) -> str:
    """A note; fields in the order given."""
    import yaml

    head = yaml.safe_dump(front_matter, sort_keys=False, allow_unicode=True, default_flow_style=False)
    return f"---\n{head}---\n\n{body}" if body else f"---\n{head}---\n"


def _dumped(odd: pd.DataFrame) -> pd.DataFrame:
    """The lines of each value that is there, as the YAML library writes them."""
    import yaml

    def lines(name: str, v: object) -> str | None:
        if v is None:
            return None
        return yaml.safe_dump({name: v if isinstance(v, str) else list(v)}, sort_keys=False, allow_unicode=True, default_flow_style=False)

    return pd.DataFrame({name: pd.Series([lines(name, v) for v in odd[name]], dtype=object) for name in odd.columns})


def _stands_plain(x: Column) -> Column:
    """Whether a text is written as it stands: short, words of letters and digits from a letter on, none that YAML reads otherwise."""
    return F.coalesce((F.length(x) <= _SHORT) & x.rlike(_PLAIN) & ~F.lower(x).isin(_READ_OTHERWISE), F.lit(False))


def serialize_notes(rows: DataFrame, fields: list[str], body: str = "content") -> DataFrame:
    """``rows`` with a column note; fields are texts or lists of texts; null and empty ones, and an active status, are left out.

    Expressions write plain values; only the others, never the body, go to Python to be quoted.
    """
    written, odd = [], []
    for name in fields:
        value, many = F.col(name), isinstance(rows.schema[name].dataType, ArrayType)
        kept = F.size(value) > 0 if many else (F.length(value) > 0) & (F.lit(name != "status") | (value != "active"))
        plain = F.forall(value, _stands_plain) if many else _stands_plain(value)
        plain &= F.lit(len(name) <= _SHORT_NAME and re.fullmatch(r"[A-Za-z_]\w*", name, re.ASCII) is not None and name.lower() not in _READ_OTHERWISE)
        line = F.concat(F.lit(f"{name}:\n- "), F.array_join(value, "\n- "), F.lit("\n")) if many else F.concat(F.lit(f"{name}: "), value, F.lit("\n"))
        written.append(F.when(kept & plain, line))
        odd.append(F.when(kept & ~plain, value).alias(name))
    dumped = F.pandas_udf(_dumped, StructType([StructField(name, StringType()) for name in fields]))(F.struct(*odd))
    out = rows.withColumn("__dumped", dumped)
    head = F.concat(*(F.coalesce(line, F.col("__dumped").getField(name), F.lit("")) for line, name in zip(written, fields, strict=True)))
    text = F.when(F.length(body) > 0, F.concat(F.lit("\n"), F.col(body))).otherwise("")
    return out.withColumn("note", F.concat(F.lit("---\n"), F.when(head == "", "{}\n").otherwise(head), F.lit("---\n"), text)).drop("__dumped")
