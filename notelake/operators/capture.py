"""Typed captures: validation, templates, front matter."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelake.functions import scalar as S
from notelake.operators import notes, security


def _sections(*parts: tuple[str, Column]) -> Column:
    """Markdown sections; those without content are left out."""
    return F.array_join(F.filter(F.array(*(F.when(~S.is_blank(c), F.concat(F.lit(f"## {title}\n\n"), c)) for title, c in parts)), lambda x: x.isNotNull()), "\n\n")


def _bullets(x: Column) -> Column:
    return F.array_join(F.transform(F.coalesce(x, F.array().cast("array<string>")), lambda v: F.concat(F.lit("- "), v)), "\n")


def _tags(extra: Column | None = None) -> Column:
    own = F.coalesce("tags", F.array().cast("array<string>"))
    return own if extra is None else F.when(extra.isNotNull(), F.concat(own, F.array(extra))).otherwise(own)


def decisions(rows: DataFrame) -> DataFrame:
    """I16: summary, context, rationale, alternatives (array) -> record."""
    return _record(rows, "decisions", _sections(("Context", F.col("context")), ("Rationale", F.col("rationale")), ("Alternatives Considered", _bullets(F.col("alternatives")))))


def blockers(rows: DataFrame) -> DataFrame:
    """Description, impact."""
    return _record(rows, "blockers", _sections(("Description", F.col("description")), ("Impact", F.col("impact"))))


def resolutions(rows: DataFrame) -> DataFrame:
    """memory_id (blockers:sha:n, else an error), resolution; relates to the blocker."""
    ok = (F.size(F.split("memory_id", ":")) >= 3) & (F.split("memory_id", ":")[0] == "blockers")
    named = rows.withColumn("summary", F.concat(F.lit("Resolved: "), "memory_id"))
    out = _record(named, "blockers", F.concat(F.lit("## Resolution\n\n"), "resolution"), status="resolved", relates=F.array("memory_id"))
    return out.withColumn("errors", F.when(ok, F.col("errors")).otherwise(F.concat("errors", F.array(F.lit("memory_id")))))


def learnings(rows: DataFrame) -> DataFrame:
    """I16d: insight, context."""
    return _record(rows, "learnings", _sections(("Insight", F.col("insight")), ("Context", F.col("context"))))


def progress(rows: DataFrame) -> DataFrame:
    """I16e: milestone, details."""
    return _record(rows, "progress", _sections(("Milestone", F.col("milestone")), ("Details", F.col("details"))))


def retrospectives(rows: DataFrame) -> DataFrame:
    """I16f: content, outcome; phase completed."""
    return _record(rows, "retrospective", F.col("content"), tags=_tags(F.concat(F.lit("outcome:"), "outcome")), phase="completed")


def patterns(rows: DataFrame) -> DataFrame:
    """I16g: pattern_type, evidence, confidence (0 to 1, else an error)."""
    out = _record(rows, "patterns", _sections(("Pattern Type", F.col("pattern_type")), ("Evidence", F.col("evidence")), ("Confidence", F.format_string("%.2f", F.col("confidence")))), tags=_tags(F.concat(F.lit("pattern:"), "pattern_type")), status="candidate")
    return out.withColumn("errors", F.when(F.col("confidence").between(0, 1), F.col("errors")).otherwise(F.concat("errors", F.array(F.lit("confidence")))))


def reviews(rows: DataFrame) -> DataFrame:
    """I16h: findings, verdict."""
    return _record(rows, "reviews", _sections(("Findings", F.col("findings")), ("Verdict", F.col("verdict"))), tags=_tags(F.concat(F.lit("verdict:"), "verdict")))


def _record(rows: DataFrame, namespace: str, content: Column, tags: Column | None = None, status: str = "active", phase: str | None = None, relates: Column | None = None) -> DataFrame:
    out = rows.withColumns({"content": content, "namespace": F.lit(namespace), "tags": _tags() if tags is None else tags, "status": F.lit(status), "relates_to": F.array().cast("array<string>") if relates is None else relates})
    if phase is not None:
        out = out.withColumn("phase", F.lit(phase))
    return out.withColumn("errors", S.validation_errors(F.col("namespace"), F.col("summary"), F.col("content")))


def front_matter(rows: DataFrame) -> Column:
    """Fields of a note as a map; empty ones and an active status are left out."""
    held = {"type": "namespace", "summary": "summary", "timestamp": "timestamp", "spec": "spec", "phase": "phase", "tags": "tags", "status": "status", "relates_to": "relates_to"}
    pairs = []
    for k, c in held.items():
        if c in rows.columns:
            v = F.array_join(c, ",") if c in ("tags", "relates_to") else F.col(c).cast("string")
            pairs += [F.lit(k), v]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull() & (v != "") & ~((k == "status") & (v == "active")))


def capture(rows: DataFrame, secrets: bool = True) -> tuple[DataFrame, DataFrame]:
    """Valid records, with secrets in summary and content redacted, and rejected rows with their errors."""
    checked = rows if "errors" in rows.columns else rows.withColumn("errors", S.validation_errors(F.col("namespace"), F.col("summary"), F.col("content")))
    bad = checked.filter(F.size("errors") > 0)
    good = checked.filter(F.size("errors") == 0).drop("errors")
    if secrets:
        for c in ("summary", "content"):
            good = security.filter_texts(good, c).withColumn(c, F.col("filtered")).drop("detections", "action", "filtered", "warnings")
    return good, bad


def append_notes(rows: DataFrame, held: DataFrame, order: str = "id") -> tuple[DataFrame, DataFrame]:
    """Notes with captured records appended, and the records with their ids.

    ``rows`` (from ``capture``): commit_sha, namespace, summary, content and fields of the
    front matter; ``held``: namespace, commit_sha, note.  A record's ordinal follows those
    of its commit's note and, among ``rows``, the ``order`` column.  The notes do not depend
    on the index, so a failure to write records loses none: they are synchronised later.
    """
    key = ["namespace", "commit_sha"]
    fields = [c for c in ("type", "summary", "timestamp", "spec", "phase", "tags", "status", "relates_to") if c in rows.columns or c == "type"]
    texts = {c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssXXX") for c in ("timestamp",) if c in rows.columns}
    written = notes.serialize_notes(rows.withColumns({"type": F.col("namespace"), **texts}), fields).select(*key, order, "note")
    before = held.select(*key, F.col("note").alias("__old"), F.size(notes.split_notes(F.col("note"))).alias("__n"))
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(order)) - 1
    placed = rows.join(before.select(*key, "__n"), key, "left").withColumn("idx", F.coalesce("__n", F.lit(0)) + nth).drop("__n")
    added = written.groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "note"))), lambda x: x["note"]), "\n").alias("__new"))
    out = before.join(added, key, "full_outer").select(*key, F.concat_ws("\n", "__old", "__new").alias("note"))
    return out, placed.withColumn("id", S.memory_id(F.col("namespace"), F.col("commit_sha"), F.col("idx")))


def record(rows: DataFrame, held: DataFrame, write_notes: Callable[[DataFrame], object], write_index: Callable[[DataFrame], object], secrets: bool = True) -> tuple[DataFrame, str | None]:
    """I13 as a whole: valid rows, without secrets, go into notes and then into the index.

    Returns the rejected rows and, where the index could not be written, a warning: the
    notes are kept all the same, and a later synchronisation finds the records in them.
    """
    good, bad = capture(rows, secrets)
    notes_, placed = append_notes(good, held)
    write_notes(notes_)
    try:
        write_index(placed)
    except Exception as e:  # noqa: BLE001  whatever the index raises, the capture has succeeded
        return bad, f"Indexing failed: {e}"
    return bad, None


def tool_content(event: Column) -> Column:
    """The text that a file tool writes, from its JSON event (Write, Edit, MultiEdit); null for others."""
    get = lambda p: F.get_json_object(event, p)
    edits = F.from_json(get("$.tool_input.edits"), "array<struct<new_string: string>>")
    name = get("$.tool_name")
    return F.when(name == "Write", get("$.tool_input.content")).when(name == "Edit", get("$.tool_input.new_string")).when(name == "MultiEdit", F.array_join(F.transform(edits, lambda e: e["new_string"]), "\n"))
