"""Session context under a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelake import literals as L
from notelake.functions import scalar as S


def budget(n_records: int, mode: str = "adaptive", fixed: int = 1000) -> dict[str, int]:
    """Tokens for working memory, semantic context and commands."""
    if mode == "adaptive" or mode == "full":
        tier = "full" if mode == "full" else "simple" if n_records < 10 else "medium" if n_records < 50 else "complex" if n_records < 200 else "full"
        total, working, semantic = L.BUDGET_TIERS[tier]
        return {"total": total, "working_memory": working, "semantic_context": semantic, "commands": 100}
    total = 500 if mode == "minimal" else fixed
    commands = min(100, total // 10)
    working = int((total - commands) * 0.7)
    return {"total": total, "working_memory": working, "semantic_context": total - commands - working, "commands": commands}


def within_budget(rows: DataFrame, tokens: int, order: list[Column], partition: list[str] | None = None) -> DataFrame:
    """rows in order for as long as their tokens fit; what follows the first one that doesn't is left out.

    ``rows`` are the few of a section; without a partition they are one task's.
    """
    w = Window.partitionBy(*(partition or [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    cost = S.record_tokens(F.col("summary"), F.col("tags"))
    return rows.withColumn("tokens", cost).withColumn("running", F.sum("tokens").over(w)).filter(F.col("running") <= tokens)


def working_memory(m: DataFrame, as_of: Column, tokens: int, spec: str | None = None, max_items: int = 9, recent_days: float = 7.0) -> DataFrame:
    """blockers (half of the tokens), recent decisions (two fifths), pending progress (a tenth), with section and rank.

    As in the rules followed, decisions and progress are limited before they are filtered.
    """
    each = max(max_items // 3, 3)
    if spec is not None:
        m = m.filter(F.col("spec") == spec)

    def top(namespace: str) -> DataFrame:
        return m.filter(F.col("namespace") == namespace).orderBy(F.col("timestamp").desc(), "id").limit(each)

    order = [F.col("timestamp").desc(), F.col("id")]
    parts = [
        ("blockers", top("blockers"), 0.5),
        ("decisions", top("decisions").filter(S.age_days("timestamp", as_of) <= recent_days), 0.4),
        ("progress", top("progress").filter(F.col("status").isin("pending", "in-progress")), 0.1),
    ]
    out = None
    for name, rows, share in parts:
        part = within_budget(rows, int(tokens * share), order).withColumn("section", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("section").orderBy(*order)))


def semantic_context(learnings: DataFrame, patterns: DataFrame, tokens: int) -> DataFrame:
    """found learnings (three fifths of the tokens) and patterns (two fifths), nearest first; both have distance."""
    order = [F.col("distance"), F.col("id")]
    a = within_budget(learnings, int(tokens * 0.6), order).withColumn("section", F.lit("learnings"))
    b = within_budget(patterns, int(tokens * 0.4), order).withColumn("section", F.lit("patterns"))
    return a.unionByName(b).withColumn("relevance", S.recall_similarity(F.col("distance"))).withColumn("rank", F.row_number().over(Window.partitionBy("section").orderBy(*order)))


def memory_xml(expand_from: float = 0.85) -> Column:
    """A42, N16d: a record as an element; very relevant ones are marked to be expanded."""
    relevance = F.when(F.col("relevance").isNotNull(), F.concat(F.lit(' relevance="'), F.format_string("%.2f", "relevance"), F.lit('"'), F.when(F.col("relevance") >= expand_from, F.lit(' auto_expand="true"')).otherwise("")))
    tags = F.array_join(F.slice(F.coalesce("tags", F.array().cast("array<string>")), 1, 5), ",")
    return F.concat(F.lit('<memory id="'), S.xml_escape(F.col("id")), F.lit('" namespace="'), F.col("namespace"), F.lit('"'), F.coalesce(relevance, F.lit("")), F.lit("><summary>"), S.xml_escape(F.col("summary")), F.lit("</summary><tags>"), S.xml_escape(tags), F.lit("</tags></memory>"))


def to_xml(sections: DataFrame, project: str) -> DataFrame:
    """One row with the context: sections in order of name, records by rank.  A context is of bounded size."""
    if "relevance" not in sections.columns:
        sections = sections.withColumn("relevance", F.lit(None).cast("double"))
    parts = sections.select("section", "rank", memory_xml().alias("xml")).groupBy("section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "xml"))), lambda x: x["xml"]), "").alias("body"))
    whole = parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "body"))), lambda x: F.concat(F.lit("<"), x["section"], F.lit(">"), x["body"], F.lit("</"), x["section"], F.lit(">"))), "").alias("inner"))
    head = F.concat(F.lit('<memory_context project="'), S.xml_escape(F.lit(project)), F.lit('">'))
    return whole.select(F.concat(head, F.col("inner"), F.lit("</memory_context>")).alias("xml"))
