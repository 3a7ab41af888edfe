"""Schemas of the tables."""

from __future__ import annotations

MEMORIES = "id STRING NOT NULL, commit_sha STRING NOT NULL, namespace STRING NOT NULL, summary STRING NOT NULL, content STRING NOT NULL, timestamp TIMESTAMP NOT NULL, repo_path STRING, spec STRING, phase STRING, tags ARRAY<STRING>, status STRING, relates_to ARRAY<STRING>, created_at TIMESTAMP, updated_at TIMESTAMP"
MEMORY_VECTORS = "id STRING NOT NULL, embedding ARRAY<FLOAT> NOT NULL"
RAW_NOTES = "namespace STRING, commit_sha STRING, note STRING"
NOTE_RECORDS = "commit_sha STRING, namespace STRING, idx INT, front_matter MAP<STRING,STRING>, body STRING, raw STRING"
COMMITS = "sha STRING, author_name STRING, author_email STRING, date STRING, message STRING"
COMMIT_FILES = "sha STRING, path STRING, content STRING"
PATTERNS = "name STRING, pattern_type STRING, description STRING, evidence ARRAY<STRING>, confidence DOUBLE, tags ARRAY<STRING>, status STRING, first_seen TIMESTAMP, last_seen TIMESTAMP, occurrence_count INT"
MESSAGES = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"
SIGNAL = "type STRING, match STRING, confidence DOUBLE, context STRING, suggested_namespace STRING, position INT"
DETECTION = "secret_type STRING, start INT, end INT, confidence DOUBLE, detector STRING, line_number INT, secret_hash STRING"
ALLOWLIST = "secret_hash STRING, reason STRING, added_by STRING, added_at TIMESTAMP, namespace STRING, expires_at TIMESTAMP"
AUDIT = "timestamp TIMESTAMP, event_type STRING, namespace STRING, secret_types ARRAY<STRING>, action STRING, detection_count INT, source STRING, session_id STRING, details MAP<STRING,STRING>"
OBSERVATIONS = "ts TIMESTAMP, name STRING, kind STRING, labels MAP<STRING,STRING>, value DOUBLE"
SPANS = "trace_id STRING, span_id STRING, parent_span_id STRING, operation STRING, start_time DOUBLE, end_time DOUBLE, tags MAP<STRING,STRING>, status STRING, error_message STRING"
