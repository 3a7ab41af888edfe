"""The model's tables, derived from the generic test tables, in Spark and as SQL.

Both forms use the same arithmetic, so a query over them can be held against SQL.
``AS_OF`` is the fixed present; nothing asks the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake import literals as L

AS_OF_EPOCH = 1_709_251_200  # 2024-03-01T00:00:00Z
SIGNAL_SENTENCES = [
    "", "I decided to use the new parser.", "Today I learned that caching helps.", "We are blocked by the review.", "I fixed the failing build.", "We finished the migration, which is important.",
    "This is a best practice for us.", "I prefer to keep it small.", "Please remember this for later.",
]


def as_of() -> Column:
    return F.timestamp_seconds(F.lit(AS_OF_EPOCH))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return t.withColumns({f.name: F.col(f.name).cast("timestamp") for f in t.schema if f.dataType.typeName() == "timestamp_ntz"})


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records from documents; quality of labels as a tag."""
    d = table(spark, sf_dir, "documents")
    quality = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("label_id")).agg(F.max("quality").alias("quality"))
    sha = F.md5(F.col("doc_id").cast("string"))
    namespace = F.element_at(F.array(*map(F.lit, L.NAMESPACES)), (F.col("doc_id") % 10 + 1).cast("int"))
    ts = F.lit(AS_OF_EPOCH) - (F.col("doc_id") * 37) % 500 * 86400 - F.col("doc_id") % 1440 * 60
    kind = F.col("doc_id") % 11
    return d.join(quality, d["doc_id"] == quality["label_id"], "left").select(
        "doc_id",
        F.concat(namespace, F.lit(":"), F.substring(sha, 1, 7), F.lit(":0")).alias("id"),
        sha.alias("commit_sha"),
        namespace.alias("namespace"),
        F.substring(F.split("text", "\n")[0], 1, 100).alias("summary"),
        F.col("text").alias("content"),
        F.timestamp_seconds(ts).alias("timestamp"),
        F.lit(None).cast("string").alias("repo_path"),
        F.when(F.col("doc_id") % 7 != 0, F.col("source")).alias("spec"),
        F.lit(None).cast("string").alias("phase"),
        F.when(F.col("quality").isNull(), F.array("lang")).otherwise(F.array(F.col("lang"), F.concat(F.lit("q"), F.col("quality").cast("string")))).alias("tags"),
        F.when(kind == 6, "resolved").when(kind == 7, "archived").when(kind == 8, "tombstone").when(kind == 9, "").when(kind < 6, "active").alias("status"),
    )


MEMORIES_SQL = f"""memories AS (
  SELECT d.doc_id,
    list_extract([{", ".join(f"'{n}'" for n in L.NAMESPACES)}], CAST(d.doc_id % 10 + 1 AS BIGINT)) || ':' || substring(md5(CAST(d.doc_id AS VARCHAR)), 1, 7) || ':0' AS id,
    md5(CAST(d.doc_id AS VARCHAR)) AS commit_sha,
    list_extract([{", ".join(f"'{n}'" for n in L.NAMESPACES)}], CAST(d.doc_id % 10 + 1 AS BIGINT)) AS namespace,
    substring(split_part(d.text, chr(10), 1), 1, 100) AS summary, d.text AS content,
    {AS_OF_EPOCH} - ((d.doc_id * 37) % 500) * 86400 - (d.doc_id % 1440) * 60 AS ts,
    CASE WHEN d.doc_id % 7 <> 0 THEN d.source END AS spec, d.lang AS lang, l.quality AS quality,
    CASE WHEN l.quality IS NULL THEN d.lang ELSE d.lang || ',q' || CAST(l.quality AS VARCHAR) END AS tags,
    CASE WHEN d.doc_id % 11 = 6 THEN 'resolved' WHEN d.doc_id % 11 = 7 THEN 'archived' WHEN d.doc_id % 11 = 8 THEN 'tombstone' WHEN d.doc_id % 11 = 9 THEN '' WHEN d.doc_id % 11 < 6 THEN 'active' END AS status
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id)"""


def memory_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors by memory id; vectors without a document keep an id that no memory has."""
    e = table(spark, sf_dir, "embeddings")
    namespace = F.element_at(F.array(*map(F.lit, L.NAMESPACES)), (F.col("vec_id") % 10 + 1).cast("int"))
    return e.select(F.concat(namespace, F.lit(":"), F.substring(F.md5(F.col("vec_id").cast("string")), 1, 7), F.lit(":0")).alias("id"), "vec_id", "embedding")


VECTORS_SQL = f"""vectors AS (
  SELECT list_extract([{", ".join(f"'{n}'" for n in L.NAMESPACES)}], CAST(vec_id % 10 + 1 AS BIGINT)) || ':' || substring(md5(CAST(vec_id AS VARCHAR)), 1, 7) || ':0' AS id, vec_id, CAST(embedding AS DOUBLE[]) AS embedding
  FROM embeddings)"""


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 7) -> DataFrame:
    """One row with the embedding that is searched for."""
    return table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).select(F.col("embedding").alias("q"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with a signal sentence behind each turn."""
    c = table(spark, sf_dir, "conversations")
    sentence = F.element_at(F.array(*map(F.lit, SIGNAL_SENTENCES)), ((F.col("conv_id") + F.col("turn")) % 9 + 1).cast("int"))
    return c.select("conv_id", "turn", "role", F.concat_ws(" ", "text", sentence).alias("text"))


# What the sentences of SIGNAL_SENTENCES say: number, type, namespace, base confidence, match and its place in the sentence.
SIGNALS = [
    (1, "decision", "decisions", 0.90, "I decided to", 0), (2, "learning", "learnings", 0.90, "I learned that", 6), (3, "blocker", "blockers", 0.92, "blocked by", 7), (4, "resolution", "progress", 0.92, "fixed the", 2),
    (5, "progress", "progress", 0.90, "finished", 3), (6, "pattern", "patterns", 0.88, "best practice", 10), (7, "preference", "learnings", 0.88, "I prefer to", 0), (8, "explicit", "learnings", 0.98, "remember this", 7),
]


def quoted(x: object) -> str:
    """A value as an SQL literal."""
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows) + ")"


BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
# The signal of each message: the conversations hold none, so it is the sentence's; its context goes back to where a word or blank begins, a hundred characters before.
SIGNALS_SQL = f"""messages AS (
  SELECT c.conv_id, c.turn, c.role, c.text || ' ' || s.sentence AS text, s.k, length(c.text) + 1 AS start
  FROM conversations c JOIN {values(list(enumerate(SIGNAL_SENTENCES)))} s(k, sentence) ON s.k = (c.conv_id + c.turn) % 9),
placed AS (
  SELECT m.conv_id, m.turn, m.text, v.type, v.match, v.ns, CAST(v.base AS DOUBLE) AS base, CAST(m.start + v.off AS INTEGER) AS position, m.start + v.off - 100 AS before
  FROM messages m JOIN {values(SIGNALS)} v(k, type, ns, base, match, off) ON v.k = m.k),
cut AS (
  SELECT *, CASE WHEN before > 0 THEN greatest(before - length(regexp_extract(substring(text, 1, before), '[\\p{{L}}\\p{{N}}]*$')), length(regexp_extract(substring(text, 1, before + 10), '(?s)^.* '))) ELSE 0 END AS first FROM placed),
around AS (
  SELECT *, CASE WHEN first > 0 THEN '...' ELSE '' END || trim(substring(text, first + 1), {BLANKS}) AS context FROM cut),
signals AS (
  SELECT conv_id, turn, type, match, round(least(1.0, least(1.0, base + 0.02) + CASE WHEN regexp_matches(lower(context), 'important|critical|key|essential|must|need') THEN 0.05 ELSE 0 END), 3) AS confidence, context, ns AS suggested_namespace, position FROM around)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("ts"), F.col("event_type").alias("name"), F.lit("histogram").alias("kind"), F.create_map(F.lit("user"), (F.col("user_id") % 5).cast("string")).alias("labels"), "value")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One span an event; a tree for each ten."""
    e = table(spark, sf_dir, "events")
    begin = F.unix_seconds("ts").cast("double")
    return e.select(
        (F.col("event_id") - F.col("event_id") % 10).cast("string").alias("trace_id"),
        F.col("event_id").cast("string").alias("span_id"),
        F.when(F.col("event_id") % 10 != 0, (F.col("event_id") - F.col("event_id") % 10 + F.floor(F.col("event_id") % 10 / 2)).cast("string")).alias("parent_span_id"),
        F.col("event_type").alias("operation"),
        begin.alias("start_time"),
        (begin + F.col("event_id") % 7).alias("end_time"),
        F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("tags"),
        F.when(F.col("event_id") % 13 == 0, "error").otherwise("ok").alias("status"),
        F.when(F.col("event_id") % 13 == 0, "failed").alias("error_message"),
    )


SPANS_SQL = """spans AS (
  SELECT CAST(event_id - event_id % 10 AS VARCHAR) AS trace_id, CAST(event_id AS VARCHAR) AS span_id,
    CASE WHEN event_id % 10 <> 0 THEN CAST(event_id - event_id % 10 + (event_id % 10) // 2 AS VARCHAR) END AS parent_span_id, event_type AS operation,
    CAST(floor(epoch(ts)) AS DOUBLE) AS start_time, CAST(floor(epoch(ts)) + event_id % 7 AS DOUBLE) AS end_time, CASE WHEN event_id % 13 = 0 THEN 'error' ELSE 'ok' END AS status
  FROM events)"""


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    types = F.when(F.col("event_id") % 3 == 0, F.array(F.lit("pii_phone"))).when(F.col("event_id") % 3 == 1, F.array(F.lit("pii_phone"), F.lit("password"))).otherwise(F.array().cast("array<string>"))
    return e.select(
        "event_id",
        F.col("ts").alias("timestamp"),
        F.element_at(F.array(*map(F.lit, ("detection", "filter", "scan", "allowlist_change"))), (F.col("event_id") % 4 + 1).cast("int")).alias("event_type"),
        F.element_at(F.array(*map(F.lit, L.NAMESPACES)), (F.col("event_id") % 10 + 1).cast("int")).alias("namespace"),
        types.alias("secret_types"),
        F.element_at(F.array(*map(F.lit, ("allowed", "redacted", "masked", "warned", "blocked"))), (F.col("event_id") % 5 + 1).cast("int")).alias("action"),
        F.size(types).alias("detection_count"),
    )


AUDIT_SQL = f"""audit AS (
  SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts, list_extract(['detection', 'filter', 'scan', 'allowlist_change'], CAST(event_id % 4 + 1 AS BIGINT)) AS event_type,
    list_extract([{", ".join(f"'{n}'" for n in L.NAMESPACES)}], CAST(event_id % 10 + 1 AS BIGINT)) AS namespace,
    CASE WHEN event_id % 3 = 0 THEN ['pii_phone'] WHEN event_id % 3 = 1 THEN ['pii_phone', 'password'] ELSE [] END AS secret_types,
    list_extract(['allowed', 'redacted', 'masked', 'warned', 'blocked'], CAST(event_id % 5 + 1 AS BIGINT)) AS action
  FROM events)"""


def front_matter(m: DataFrame) -> DataFrame:
    """Notes of memories: YAML front matter and body, with the record's fields."""
    stamp = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    quoted = F.concat(F.lit("'"), F.replace(F.col("summary"), F.lit("'"), F.lit("''")), F.lit("'"))
    lines = F.concat_ws("\n", F.lit("---"), F.concat(F.lit("type: "), "namespace"), F.concat(F.lit("spec: "), F.coalesce("spec", F.lit("none"))), F.concat(F.lit("timestamp: '"), stamp, F.lit("'")), F.concat(F.lit("summary: "), quoted), F.lit("---"), F.lit(""), F.col("content"))
    return m.select("namespace", "commit_sha", lines.alias("note"))
