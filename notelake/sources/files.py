"""Transcripts, hook events, audit logs, allowlists, configuration and contexts in files."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake import schema
from notelake.functions import scalar as S

_JOB = re.compile(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}")
_LINE = "type string, userType string, message string, isMeta boolean"


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Path, turn, role and text of messages in transcripts: JSON lines if a file begins with {, else Human:/Assistant: blocks."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value"))
    return parse_transcripts(whole)


def parse_transcripts(whole: DataFrame) -> DataFrame:
    """As ``transcripts``, for rows of path and value."""
    json = whole.filter(F.ltrim("value").startswith("{"))
    lines = json.select("path", F.posexplode(F.split("value", "\n")).alias("turn", "line")).withColumn("o", F.from_json("line", _LINE))
    lines = lines.filter(F.col("o").isNotNull() & ~F.coalesce(F.col("o.type").isin("summary", "file-history-snapshot"), F.lit(False)))
    content = F.get_json_object("line", "$.message.content")
    blocks = F.from_json(content, "array<struct<type: string, text: string>>")
    flat = F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")
    text = F.coalesce(F.nullif(flat, F.lit("")), F.when(~content.startswith("["), content), F.when(~F.col("o.message").startswith("{"), F.col("o.message")))
    role = F.when(F.coalesce(F.col("o.userType"), F.lit("")).isin("external", "user", "human"), "user").otherwise(F.when(F.col("o.type") == "user", "user").otherwise("assistant"))
    from_json = lines.select("path", "turn", role.alias("role"), text.alias("text")).filter(~S.is_blank(F.col("text")))
    plain = whole.filter(~F.ltrim("value").startswith("{"))
    part = r"(?ms)^((?:Human|User|Assistant):.*?)(?=^(?:Human|User|Assistant):|\z)"
    each = plain.select("path", F.posexplode(F.regexp_extract_all("value", F.lit(part), F.lit(1))).alias("turn", "block"))
    from_plain = each.select("path", "turn", F.when(F.col("block").startswith("Assistant"), "assistant").otherwise("user").alias("role"), S.strip(F.regexp_replace("block", r"^\w+:", "")).alias("text"))
    return from_json.unionByName(from_plain.filter(F.col("text") != ""))


def hook_events(lines: DataFrame, max_bytes: int = 10 << 20) -> DataFrame:
    """session_id, event, prompt, transcript_path, tool_name and raw of each line that is a JSON object and not too long."""
    ok = lines.filter((F.octet_length("value") <= max_bytes) & F.ltrim("value").startswith("{") & F.try_parse_json("value").isNotNull())
    get = lambda k: F.get_json_object("value", f"$.{k}")
    return ok.select(get("session_id").alias("session_id"), get("hook_event_name").alias("event"), get("prompt").alias("prompt"), get("transcript_path").alias("transcript_path"), get("tool_name").alias("tool_name"), F.col("value").alias("raw"))


def write_audit(events: DataFrame, path: str, max_records: int = 100_000) -> None:
    """Appends JSON lines, a new file after so many records."""
    events.write.mode("append").option("maxRecordsPerFile", max_records).json(path)


def rotate_audit(spark: SparkSession, path: str, keep: int = 10, appends: bool = False) -> int:
    """Removes all but the ``keep`` newest files of an audit log, or the files of all but the newest appends, and returns how many."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found: dict[str, list[tuple]] = {}  # of one append: the writing job's id is in its files' names
    for s in fs.listStatus(folder):
        if (name := s.getPath().getName()).startswith("part-"):
            job = _JOB.search(name) if appends else None
            found.setdefault(job[0] if job else name, []).append((s.getModificationTime(), name, s.getPath()))
    newest = sorted(found.values(), key=lambda some: max((t, n) for t, n, _ in some), reverse=True)
    old = [p for some in newest[keep:] for _, _, p in some]
    for p in old:
        fs.delete(p, False)
    return len(old)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Audit entries; lines that are no JSON are dropped."""
    return spark.read.schema(schema.AUDIT).option("mode", "DROPMALFORMED").json(path)


def read_allowlist(spark: SparkSession, path: str, namespace: str | None, as_of: Column | None = None) -> DataFrame:
    """A namespace's allowlist from YAML; entries without hash are skipped, expired ones dropped."""
    import yaml

    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())  # one small file
    data = yaml.safe_load(text) or {}
    items = data.get("entries", []) if isinstance(data, dict) else data
    rows = [(str(e["secret_hash"]), *(None if e.get(k) is None else str(e[k]) for k in ("reason", "added_by", "added_at")), namespace, None if e.get("expires_at") is None else str(e["expires_at"])) for e in items if isinstance(e, dict) and e.get("secret_hash")]
    raw = spark.createDataFrame(rows, "secret_hash string, reason string, added_by string, added_at string, namespace string, expires_at string")
    out = raw.withColumns({c: F.try_to_timestamp(F.col(c)) for c in ("added_at", "expires_at")})
    return out if as_of is None else out.filter(~F.coalesce(as_of > F.col("expires_at"), F.lit(False)))


#: Settings with their defaults: of hooks, secrets and telemetry.
DEFAULTS: dict[str, object] = {
    "HOOK_ENABLED": True, "HOOK_BUDGET_MODE": "adaptive", "HOOK_FIXED_BUDGET_SIZE": 1000, "HOOK_AUTO_CAPTURE_THRESHOLD": 0.85, "HOOK_SUGGEST_THRESHOLD": 0.7, "HOOK_NOVELTY_THRESHOLD": 0.3,
    "HOOK_STOP_MIN_CONFIDENCE": 0.8, "HOOK_STOP_MAX_CAPTURES": 50, "HOOK_PRE_COMPACT_MIN_CONFIDENCE": 0.85, "HOOK_PRE_COMPACT_MAX_CAPTURES": 50, "HOOK_POST_TOOL_USE_MIN_SIMILARITY": 0.6, "HOOK_POST_TOOL_USE_MAX_RESULTS": 3,
    "SECRETS_FILTER_ENABLED": True, "SECRETS_FILTER_DEFAULT_STRATEGY": "redact", "SECRETS_FILTER_ENTROPY_ENABLED": True, "SECRETS_FILTER_PII_ENABLED": True, "TELEMETRY_ENABLED": True,
}


def load_config(env: Mapping[str, str] | None = None, yaml_text: str | None = None) -> dict[str, object]:
    """Settings: environment before YAML before defaults; values that cannot be read as the default's type are ignored."""
    import yaml

    held = {**DEFAULTS, **{k: v for k, v in ((yaml.safe_load(yaml_text) or {}) if yaml_text else {}).items() if k in DEFAULTS}}
    for k, v in (os.environ if env is None else env).items():
        if k in DEFAULTS:
            kind = type(DEFAULTS[k])
            try:
                held[k] = v.strip().lower() in ("1", "true", "yes", "on") if kind is bool else kind(v)
            except ValueError:
                pass
    return held


def spec_id(text: Column) -> Column:
    """A project's spec from its description by three patterns in turn."""
    patterns = (r"(?im)^\s*spec(?:[ _-]?id)?\s*:\s*`?([\w./-]+)`?\s*$", r"(?i)SPEC-([\w-]+)", r"(?i)docs/spec/active/([\w.-]+)")
    return F.coalesce(*(F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns))


def repository_name(url: Column) -> Column:
    """The last part of a remote's url without .git."""
    return F.nullif(F.regexp_extract(url, r"([^/:]+?)(?:\.git)?/?$", 1), F.lit(""))
