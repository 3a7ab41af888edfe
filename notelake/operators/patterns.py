"""Patterns in records by co-occurring terms (H, C10, C11, N4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelake import literals as L
from notelake.functions import scalar as S
from notelake.functions.tables import numbered, settled, small
from notelake.operators.sweep import FIRST, LOCAL, sweep

TERM = r"\b[a-z][a-z0-9_-]*[a-z0-9]\b|\b[a-z]\b"
MIN_OCCURRENCES, PROMOTION, VALIDATION = 2, 5, 0.6


def terms(summary: Column, content: Column, tags: Column) -> Column:
    """H1: the different terms of a record: words of summary, content and tags that are no stop words and longer than one character."""
    text = F.lower(F.concat_ws(" ", summary, content, F.array_join(F.coalesce(tags, F.array().cast("array<string>")), " ")))
    return F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), lambda w: (F.length(w) >= 2) & ~w.isin(L.STOP_WORDS)))


def inverted(m: DataFrame) -> DataFrame:
    """C11, H2: term and id of each record that has it."""
    return m.select("id", F.explode(terms(F.col("summary"), F.col("content"), F.col("tags"))).alias("term"))


def frequencies(m: DataFrame) -> DataFrame:
    """H2: number of records with each term."""
    return inverted(m).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _kind(words: Column, hints: dict[str, Column]) -> Column:
    """H5: kind with the most key words and namespace hints (their numbers); ties go to the first declared, none to technical."""
    score = lambda k, v: F.size(F.array_intersect(words, F.array(*map(F.lit, v.split())))) + hints.get(k, F.lit(0))
    best = F.greatest(*(F.struct(score(k, v).cast("long").alias("n"), F.lit(-i).alias("i"), F.lit(k).alias("kind")) for i, (k, v) in enumerate(L.PATTERN_KEYWORDS.items())))
    return F.when(best["n"] > 0, best["kind"]).otherwise("technical")


def _records(m: DataFrame, group: str | None) -> DataFrame:
    """__g, __d, id, namespace, timestamp and terms, a row for each id of a group; what shares an id is one record with the terms of all."""
    keyed = m.withColumn("__g", (F.col(group) if group else F.lit("")).cast("string")).filter("__g IS NOT NULL AND id IS NOT NULL")
    each = keyed.select("__g", F.xxhash64("id").alias("__d"), "id", "namespace", "timestamp", terms(F.col("summary"), F.col("content"), F.col("tags")).alias("terms"))
    return each.groupBy("__g", "__d").agg(F.min("id").alias("id"), F.min("namespace").alias("namespace"), F.max("timestamp").alias("timestamp"), F.array_distinct(F.flatten(F.collect_set("terms"))).alias("terms"), F.count(F.lit(1)).alias("rows"))


def detect(m: DataFrame, as_of: Column, min_occurrences: int = MIN_OCCURRENCES, max_candidates: int = 20, group: str | None = None, local: int = LOCAL, first: int = FIRST) -> DataFrame:
    """H3-H8: pattern candidates, for all records or each value of ``group`` (a column such as spec or namespace).

    Frequent terms are swept in the order (more records first, then alphabet): a seed
    takes every later term with which enough of its records are left (``sweep``, with its
    ``local`` and ``first``).  Scores need only the numbers of records; the records
    themselves are gathered for the best clusters alone.  Records with a null id or group
    take no part.
    """
    records = settled(_records(m, group))
    postings = records.select("__g", "__d", F.explode("terms").alias("term"))
    frequent = settled(postings.groupBy("__g", "term").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") >= min_occurrences))
    words = settled(numbered(frequent, [F.col("df").desc(), F.col("term").asc()], "__g").select("__g", "term", "df", F.col("position").cast("int").alias("t")))
    listed = settled(postings.join(small(words.drop("df").hint("shuffle_hash")), ["__g", "term"]).groupBy("__g", "__d").agg(F.sort_array(F.collect_list("t")).alias("ts")))
    swept = sweep(listed.select(F.col("__g").alias("g"), F.col("__d").alias("d"), "ts"), min_occurrences, local, first)
    once = swept.groupBy("g", "n", "digest").agg(F.min(F.struct("seed", "members")).alias("c")).select(F.col("g").alias("__g"), "n", "c.seed", "c.members")
    totals = records.groupBy("__g").agg(F.sum("rows").alias("total"))
    each = once.select("__g", "seed", "n", F.explode("members").alias("t")).join(small(words), ["__g", "t"])
    named = each.groupBy("__g", "seed", "n").agg(F.sort_array(F.collect_list(F.struct("t", "term", "df"))).alias("w")).join(totals, "__g")
    idf = F.aggregate("w", F.lit(0.0), lambda a, w: a + F.log(F.col("total") / w["df"])) / F.size("w")
    scored = named.select("__g", "seed", F.col("w.t").alias("members"), F.col("w.term").alias("terms"), (idf * F.sqrt("n") * F.pow(F.size("w"), F.lit(0.3))).alias("raw_score"))
    best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("__g").orderBy(F.col("raw_score").desc(), F.col("terms")[0]))).filter(F.col("rank") <= max_candidates)
    best = settled(best.withColumn("top", F.max("raw_score").over(Window.partitionBy("__g"))))
    holds = F.array_contains("ts", F.col("seed")) & (F.size(F.array_except("members", "ts")) == 0)
    hits = listed.join(small(best.select("__g", "seed", "members")), "__g").filter(holds).select("__g", "seed", "__d")
    hits = hits.join(records.select("__g", "__d", "id", "namespace", S.temporal_decay("timestamp", as_of).alias("decay")), ["__g", "__d"])
    gathered = hits.groupBy("__g", "seed").agg(F.sort_array(F.collect_list("id")).alias("evidence"), F.avg("decay").alias("recency"), *(F.count_if(F.col("namespace") == n).alias(f"__{n}") for n in L.PATTERN_HINTS))
    kind = _kind(F.col("terms"), {k: F.col(f"__{n}") for n, k in L.PATTERN_HINTS.items()})
    label = F.concat(S.title_case(F.array_join(F.slice("terms", 1, 3), " ")), F.lit(" ("), S.title_case(F.replace(F.col("pattern_type"), F.lit("-"), F.lit(" "))), F.lit(")"))
    found = best.join(gathered, ["__g", "seed"]).withColumn("pattern_type", kind)
    found = found.select(F.col("__g").alias("group"), label.alias("name"), "pattern_type", "terms", "evidence", "raw_score", "recency", F.col("terms")[0].alias("seed"), "top", "rank")
    found = found.withColumn("normalized_score", F.when(F.col("top") > 0, F.col("raw_score") / F.col("top")).otherwise(0.0)).withColumn("occurrence_count", F.size("evidence")).drop("top")
    return found.withColumn("confidence", confidence(F.col("normalized_score"), F.col("occurrence_count"), F.col("recency")))


def confidence(normalized: Column, occurrences: Column, recency: Column) -> Column:
    """H8: from score, evidence and recency, between 0 and 1."""
    part = F.least(F.lit(1.0), occurrences / F.lit(float(PROMOTION)))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (normalized * 0.6 + part * 0.4) * (F.lit(1.0) + recency * 0.2)))


def to_patterns(candidates: DataFrame, as_of: Column) -> DataFrame:
    """H8, N4f: candidates as patterns."""
    text = F.concat(F.lit("Pattern based on terms: "), F.array_join(F.slice("terms", 1, 5), ", "))
    return candidates.select("name", "pattern_type", text.alias("description"), "evidence", "confidence", F.col("terms").alias("tags"), F.lit("candidate").alias("status"), as_of.alias("first_seen"), as_of.alias("last_seen"), "occurrence_count")


def transition(patterns: DataFrame, names: DataFrame, target: str) -> DataFrame:
    """H9, H9b, N4d, N4e: named patterns in state ``target`` where their state allows it."""
    marked = patterns.join(names.select("name").distinct().withColumn("__hit", F.lit(True)), "name", "left")
    go = F.coalesce("__hit", F.lit(False)) & F.col("status").isin(L.PATTERN_TRANSITIONS[target])
    return marked.withColumn("status", F.when(go, target).otherwise(F.col("status"))).drop("__hit")


def add_evidence(patterns: DataFrame, evidence: DataFrame) -> DataFrame:
    """Patterns with new evidence (name, id): counted once each, 0.05 more confidence each, validated from 0.6 on."""
    new = evidence.groupBy("name").agg(F.collect_set("id").alias("__new"))
    out = patterns.join(new, "name", "left").withColumn("__add", F.array_sort(F.array_except(F.coalesce("__new", F.array().cast("array<string>")), "evidence")))
    n = F.size("__add")
    sure = F.least(F.lit(1.0), F.col("confidence") + n * 0.05)
    return out.withColumns({"evidence": F.concat("evidence", "__add"), "occurrence_count": F.col("occurrence_count") + n, "confidence": sure, "status": F.when((n > 0) & (F.col("status") == "candidate") & (sure >= VALIDATION), "validated").otherwise(F.col("status"))}).drop("__new", "__add")


def matching(m: DataFrame, patterns: DataFrame, min_overlap: int = 2) -> DataFrame:
    """Records and patterns with enough common terms, by equality of terms; score is the overlap by the larger number."""
    a = m.withColumn("__t", terms(F.col("summary"), F.col("content"), F.col("tags"))).select("id", F.size("__t").alias("na"), F.explode("__t").alias("term"))
    b = patterns.filter(F.col("status") != "deprecated").select("name", F.size("tags").alias("nb"), F.explode(F.array_distinct("tags")).alias("term"))
    both = a.join(b, "term").groupBy("id", "name", "na", "nb").agg(F.count(F.lit(1)).alias("overlap")).filter(F.col("overlap") >= min_overlap)
    return both.select("id", "name", "overlap", (F.col("overlap") / F.greatest("na", "nb")).alias("score"))
