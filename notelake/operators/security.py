"""Secrets and personal data: detection, deduplication, redaction, allowlist, audit (J, B17, B18, C9, F15-F17, N10-N12)."""

from __future__ import annotations

import bisect
import functools
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake import literals as L
from notelake.functions.gates import Patterns
from notelake.functions.tables import portions, small_batches

DETECTIONS = "array<struct<secret_type: string, start: int, end: int, confidence: double, detector: string, line_number: int, secret_hash: string>>"
FIELDS = ["secret_type", "start", "end", "confidence", "detector", "line_number", "secret_hash"]
ACTIONS = ["allowed", "warned", "masked", "redacted", "blocked"]  # by severity
#: Allowlist entries up to which they are broadcast.
MAX_BROADCAST = 100_000
STRATEGY_ACTION = {"redact": "redacted", "mask": "masked", "block": "blocked", "warn": "warned"}


def luhn(text: str) -> bool:
    digits = [int(c) for c in text if c.isdigit()]
    total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits)))
    return len(digits) >= 13 and total % 10 == 0


@functools.lru_cache(maxsize=1)
def _patterns() -> Patterns:
    """The patterns of known secrets."""
    return Patterns([p for _, _, p in L.SECRET_PATTERNS], [a.split("|") for a in L.SECRET_ANCHORS])


@functools.lru_cache(maxsize=1)
def _others() -> tuple[list[tuple], list[tuple]]:
    """Those of personal data and of random strings, which have no anchors."""
    return [(t, n, re.compile(p), v) for t, n, p, v in L.PII_PATTERNS], [(t, n, re.compile(p)) for t, n, p in L.ENTROPY_PATTERNS]


_DIGITS = re.compile(r"\d{3}")  # every pattern of personal data has them
_QUOTED = re.compile(r"[\"'][0-9A-Za-z+/_=-]{16}")  # and every random string


def _entropy(s: str) -> float:
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values()) if s else 0.0


def _one_span(found: list[dict]) -> list[dict]:
    """Of detections of one span, the one that is not by entropy, then the more confident, then the first."""
    best: dict[tuple[int, int], dict] = {}
    for d in found:
        at = (d["start"], d["end"])
        rank = lambda x: (x["secret_type"] not in L.UNSPECIFIC, x["confidence"])
        if at not in best or rank(d) > rank(best[at]):
            best[at] = d
    return sorted(best.values(), key=lambda d: (d["start"], d["end"]))


def disjoint(found: list[dict]) -> list[dict]:
    """F15, N12e: disjoint detections, in order of start, specific before unspecific, longer, more confident."""
    kept: list[dict] = []
    for d in sorted(found, key=lambda d: (d["start"], d["secret_type"] in L.UNSPECIFIC, d["start"] - d["end"], -d["confidence"])):
        if not kept or d["start"] >= kept[-1]["end"]:
            kept.append(d)
    return kept


def detect_one(text: str | None, pii: bool = True, secrets: bool = True, entropy_limit: float = L.ENTROPY_LIMIT, possible: int | None = None) -> list[dict]:
    """Detections of a text: personal data, and secrets by pattern and entropy.

    ``possible`` are the patterns of known secrets to try, where a pass over many texts has told them already.
    """
    if not text:
        return []
    starts = None
    personal, random_ = _others()

    def make(kind: str, name: str, a: int, b: int, sure: float) -> dict:
        nonlocal starts
        starts = starts or [0, *(m.end() for m in re.finditer("\n", text))]
        return dict(zip(FIELDS, (kind, a, b, sure, name, bisect.bisect_right(starts, a), hashlib.sha256(text[a:b].encode()).hexdigest()), strict=True))

    found: list[dict] = []
    if pii and (not text.isascii() or any(d in text for d in "0123456789")) and _DIGITS.search(text):
        found += _one_span([make(t, n, *m.span(), 0.9 if v else 0.7) for t, n, p, v in personal for m in p.finditer(text) if not v or luhn(m.group())])
    if secrets:
        bits = next(_patterns().possible([text])) if possible is None else possible
        known = ((t, n, p) for i, ((t, n, _), p) in enumerate(zip(L.SECRET_PATTERNS, _patterns().compiled, strict=True)) if bits >> i & 1)
        some = [make(t, n, *m.span(m.lastindex or 0), 0.9) for t, n, p in known for m in p.finditer(text)]
        some += [make(t, n, *m.span(1), 0.6) for t, n, p in (random_ if _QUOTED.search(text) else ()) for m in p.finditer(text) if _entropy(m[1]) >= (entropy_limit if t.endswith("64") else min(entropy_limit, 3.0))]
        found += _one_span(some)
    return disjoint(found)


def detect_many(texts: Iterable[str | None], pii: bool = True, secrets: bool = True, entropy_limit: float = L.ENTROPY_LIMIT) -> list[list[dict]]:
    """The detections of each text, with one pass over all of them for the secrets to look for."""
    texts = list(texts)
    bits = _patterns().possible(texts) if secrets else [0] * len(texts)
    return [detect_one(t, pii, secrets, entropy_limit, p) for t, p in zip(texts, bits, strict=True)]


def detect(column: Column | str, pii: bool = True, secrets: bool = True, entropy_limit: float = L.ENTROPY_LIMIT) -> Column:
    """Detections of each text as an array, disjoint and by start."""

    @F.pandas_udf(DETECTIONS)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in (x for part in parts for x in portions(part)):
            yield pd.Series(detect_many(some, pii, secrets, entropy_limit), dtype=object)

    small_batches()
    return run(column)


def mask(value: Column) -> Column:
    """The first and last four characters (separators between them kept), stars between; eight characters or fewer all stars."""
    plain = F.regexp_replace(value, r"[-. ]", "")
    head = F.regexp_extract(value, r"^([-. ]*(?:[^-. ][-. ]*?){4})", 1)
    tail = F.regexp_extract(value, r"([^-. ](?:[-. ]*[^-. ]){3}[-. ]*)$", 1)
    return F.when(F.length(plain) <= 8, F.repeat(F.lit("*"), F.length(plain))).otherwise(F.concat(head, F.repeat(F.lit("*"), F.greatest(F.lit(4), F.length(plain) - 8)), tail))


def strategy(kind: Column, strategies: dict[str, str], default: str = "redact") -> Column:
    """What to do with a type of secret."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in strategies.items() for x in kv)), kind), F.lit(default)) if strategies else F.lit(default)


def namespace_strategy(namespace: Column, strategies: dict[str, str], default: str = "redact") -> Column:
    """N12d: the strategy that a namespace is configured with; filtering goes by type and does not ask for it (Q13)."""
    return strategy(namespace, strategies, default)


def redact(text: Column, found: Column, strategies: dict[str, str] | None = None, default: str = "redact") -> Column:
    """The text with disjoint detections (by start) replaced by their strategy, in one fold."""

    def put(state: Column, d: Column) -> Column:
        value = F.substr(text, d["start"] + 1, d["end"] - d["start"])
        s = strategy(d["secret_type"], strategies or {}, default)
        new = F.when(s == "redact", F.concat(F.lit("[REDACTED:"), d["secret_type"], F.lit("]"))).when(s == "mask", mask(value)).otherwise(value)
        return F.struct(F.concat(state["out"], F.substr(text, state["at"] + 1, d["start"] - state["at"]), new).alias("out"), d["end"].alias("at"))

    end = F.aggregate(found, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), put)
    return F.when(F.size(found) > 0, F.concat(end["out"], F.substr(text, end["at"] + 1, F.greatest(F.length(text) - end["at"], F.lit(0))))).otherwise(text)


def action(found: Column, strategies: dict[str, str] | None = None, default: str = "redact") -> Column:
    """The most severe action of any detection; allowed without one."""
    order = F.create_map(*(F.lit(x) for s, a in STRATEGY_ACTION.items() for x in (s, ACTIONS.index(a))))
    worst = F.coalesce(F.array_max(F.transform(found, lambda d: F.element_at(order, strategy(d["secret_type"], strategies or {}, default)))), F.lit(0))
    return F.element_at(F.array(*map(F.lit, ACTIONS)), worst + 1)


def live_allowlist(allowlist: DataFrame, as_of: Column) -> DataFrame:
    """Entries that have not expired."""
    return allowlist.filter(~F.coalesce(as_of > F.col("expires_at"), F.lit(False)))


def list_allowlist(allowlist: DataFrame, as_of: Column, namespace: str | None = None, include_global: bool = True) -> DataFrame:
    """A namespace's live entries and the global ones that it has none for, newest first, undated last."""
    live = live_allowlist(allowlist, as_of)
    own = live.filter(F.col("namespace") == namespace) if namespace else live.filter("namespace is null")
    if namespace and include_global:
        own = own.unionByName(live.filter("namespace is null").join(own.select("secret_hash"), "secret_hash", "left_anti").select(*own.columns))
    return own.orderBy(F.col("added_at").desc_nulls_last(), "secret_hash")


def is_allowed(hashes: DataFrame, allowlist: DataFrame, as_of: Column, skip_expired: bool = False) -> DataFrame:
    """secret_hash, namespace and whether an entry of the namespace, or else a global one, allows it.

    An expired entry of the namespace stops the search (``skip_expired``: it does not).
    """
    expired = F.coalesce(as_of > F.col("expires_at"), F.lit(False))
    entries = (live_allowlist(allowlist, as_of) if skip_expired else allowlist).groupBy("secret_hash", "namespace").agg(F.min(expired).alias("expired"))
    own = entries.filter("namespace is not null").withColumnRenamed("expired", "own")
    everywhere = entries.filter("namespace is null").select("secret_hash", F.col("expired").alias("all"))
    out = hashes.join(own, ["secret_hash", "namespace"], "left").join(everywhere, "secret_hash", "left")
    return out.withColumn("allowed", F.coalesce(~F.col("own"), ~F.col("all"), F.lit(False))).drop("own", "all")


def add_allowed(allowlist: DataFrame, entry: DataFrame) -> DataFrame:
    """With an entry, in place of one for the same hash and namespace."""
    return remove_allowed(allowlist, entry).unionByName(entry.select(*allowlist.columns))


def remove_allowed(allowlist: DataFrame, keys: DataFrame) -> DataFrame:
    """J10b, N10d."""
    k = keys.select("secret_hash", F.coalesce("namespace", F.lit("")).alias("__n")).distinct()
    return allowlist.withColumn("__n", F.coalesce("namespace", F.lit(""))).join(k, ["secret_hash", "__n"], "left_anti").select(*allowlist.columns)


def filter_texts(rows: DataFrame, column: str = "text", allowlist: DataFrame | None = None, as_of: Column | None = None, strategies: dict[str, str] | None = None, default: str = "redact", dry_run: bool = False, **options: object) -> DataFrame:
    """``rows`` with detections, action, filtered text and warnings; ``dry_run`` leaves the text.

    Hashes on the allowlist (global, or of the row's namespace) are let through.  Blocked
    texts become null.  The allowlist is joined as one row of hashes for each namespace.
    """
    out = rows.withColumn("detections", detect(column, **options))
    n_all = F.size("detections")
    out = out.withColumn("__n", n_all)
    if allowlist is not None:
        live = live_allowlist(allowlist, as_of)
        small = F.broadcast if live.count() <= MAX_BROADCAST else (lambda df: df)
        by = live.groupBy(F.coalesce("namespace", F.lit("")).alias("__ns")).agg(F.collect_set("secret_hash").alias("__h"))
        everywhere = by.filter("__ns = ''").select(F.col("__h").alias("__g"))
        out = out.crossJoin(small(everywhere.agg(F.flatten(F.collect_list("__g")).alias("__g"))))
        names = F.col("namespace") if "namespace" in rows.columns else F.lit("")
        out = out.withColumn("__ns", F.coalesce(names, F.lit(""))).join(small(by), "__ns", "left")
        ok = F.concat(F.coalesce("__g", F.array().cast("array<string>")), F.coalesce("__h", F.array().cast("array<string>")))
        out = out.withColumn("detections", F.filter("detections", lambda d: ~F.array_contains(ok, d["secret_hash"]))).drop("__ns", "__g", "__h")
    let = F.col("__n") - F.size("detections")
    act = action(F.col("detections"), strategies, default)
    verb = "Would be " if dry_run else ""
    notes = F.filter(F.array(F.when(let > 0, F.format_string("%d allowlisted", let)), F.when(act != "allowed", F.format_string(verb + "%s: %d", act, F.size("detections")))), lambda x: x.isNotNull())
    text = F.col(column) if dry_run else F.when(act == "blocked", F.lit(None).cast("string")).otherwise(redact(F.col(column), F.col("detections"), strategies, default))
    return out.withColumns({"action": act, "filtered": text, "warnings": notes}).drop("__n")


def audit_events(filtered: DataFrame, kind: str, ts: Column, source: str = "", namespace: Column | None = None) -> DataFrame:
    """Audit rows of filtered or scanned texts; clean texts are only written for scans."""
    some = filtered if kind == "scan" else filtered.filter(F.size("detections") > 0)
    types = F.array_sort(F.array_distinct(F.transform("detections", lambda d: d["secret_type"])))
    return some.select(ts.alias("timestamp"), F.lit(kind).alias("event_type"), (namespace if namespace is not None else F.lit("")).alias("namespace"), types.alias("secret_types"), "action", F.size("detections").alias("detection_count"), F.lit(source).alias("source"))


def allowlist_events(entries: DataFrame, change: str, ts: Column) -> DataFrame:
    """Audit rows of allowlist changes, with 16 digits of the hash."""
    return entries.select(ts.alias("timestamp"), F.lit("allowlist_change").alias("event_type"), F.coalesce("namespace", F.lit("")).alias("namespace"), F.create_map(F.lit("action"), F.lit(change), F.lit("hash"), F.substring("secret_hash", 1, 16), F.lit("reason"), F.coalesce("reason", F.lit(""))).alias("details"))


def query_audit(audit: DataFrame, since: Column | None = None, until: Column | None = None, event_type: str | None = None, namespace: str | None = None, secret_type: str | None = None, action_: str | None = None, limit: int | None = 100) -> DataFrame:
    """Entries that meet all conditions, newest first; a row without a valid timestamp meets no time condition."""
    for ok in (
        F.col("timestamp") >= since if since is not None else None,
        F.col("timestamp") <= until if until is not None else None,
        F.col("event_type") == event_type if event_type else None,
        F.col("namespace") == namespace if namespace else None,
        F.array_contains("secret_types", secret_type) if secret_type else None,
        F.col("action") == action_ if action_ else None,
    ):
        if ok is not None:
            audit = audit.filter(ok)
    order = audit.orderBy(F.col("timestamp").desc(), *([F.col("event_id")] if "event_id" in audit.columns else []))
    return order if limit is None else order.limit(limit)
