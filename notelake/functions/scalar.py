"""Column functions: time, similarity, text predicates, identifiers, validation."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from notelake import literals as L


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def age_days(ts: Column | str, as_of: Column) -> Column:
    """Days from ``ts`` to ``as_of``, not negative; null: 0."""
    return F.coalesce(F.greatest(F.lit(0.0), (F.unix_micros(as_of) - F.unix_micros(_col(ts))) / F.lit(86_400_000_000.0)), F.lit(0.0))


def temporal_decay(ts: Column | str, as_of: Column, half_life_days: float = 30.0, floor: float | None = None) -> Column:
    """2 ** (-age / half life); null: 0.5; future: 1; not below ``floor``."""
    value = F.when(_col(ts).isNull(), F.lit(0.5)).otherwise(F.pow(F.lit(2.0), -age_days(ts, as_of) / F.lit(half_life_days)))
    return value if floor is None else F.greatest(value, F.lit(floor))


def l2_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two vectors, in double precision."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def dot_similarity(a: Column, b: Column) -> Column:
    """Dot product; raises where the lengths differ."""
    checked = F.when(F.size(a) == F.size(b), a).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("array<float>"))
    return F.aggregate(F.zip_with(checked, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def recall_similarity(distance: Column) -> Column:
    """1 / (1 + d), as recall, novelty and context use it (Q17)."""
    return F.lit(1.0) / (F.lit(1.0) + distance)


def linear_similarity(distance: Column) -> Column:
    """1 - d, as the tool-use report uses it (Q17)."""
    return F.lit(1.0) - distance


def ascii_lower(x: Column) -> Column:
    return F.translate(x, string.ascii_uppercase, string.ascii_lowercase)


def contains_like(x: Column, query: str) -> Column:
    """``LIKE '%query%'`` with % and _ as wildcards, case folded for A-Z only, no escapes."""
    escape = next(c for c in "\\^~`|@#$0123456789" if c not in query)
    folded = query.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    return F.like(ascii_lower(x), F.lit(f"%{folded}%"), F.lit(escape))


def strip(x: Column) -> Column:
    """Without white space at both ends, of any kind."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def is_blank(x: Column) -> Column:
    return F.coalesce(strip(x) == "", F.lit(True))


def title_case(x: Column) -> Column:
    """Each run of letters with a capital first and small others; everything else parts words (H6)."""
    pieces = F.regexp_extract_all(x, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.substr(p, F.lit(1), F.lit(1))), F.lower(F.substr(p, F.lit(2))))), "")


def split_list(x: Column) -> Column:
    """Comma-separated text as an array of trimmed, non-empty parts (N7c, N7d)."""
    return F.coalesce(F.filter(F.transform(F.split(x, ","), strip), lambda v: v != ""), F.array().cast("array<string>"))


def status_or_active(x: Column) -> Column:
    """Status with null and empty read as active."""
    return F.coalesce(F.nullif(x, F.lit("")), F.lit("active"))


def parse_timestamp(x: Column) -> Column:
    """ISO 8601 with Z, offset or blank separator; null for anything else."""
    return F.try_to_timestamp(x)


def memory_id(namespace: Column, sha: Column, idx: Column, short: bool = True) -> Column:
    """namespace:sha:ordinal, with seven characters of the sha unless not ``short`` (Q1)."""
    return F.concat_ws(":", namespace, F.substring(sha, 1, 7) if short else sha, idx.cast("string"))


def embedding_text(summary: Column, content: Column) -> Column:
    """The text that is embedded for a record (Q3)."""
    return F.concat_ws("\n", summary, content)


def hash_value(x: Column) -> Column:
    return F.sha2(x, 256)


def project_identifier(source: Column) -> Column:
    """First 12 hex digits of the hash of a remote url or root."""
    return F.substring(F.sha2(source, 256), 1, 12)


def is_valid_namespace(x: Column) -> Column:
    return F.coalesce(x.isin(L.NAMESPACES), F.lit(False))


def is_valid_git_ref(x: Column) -> Column:
    """Whether a reference is safe to hand to git: plain characters, no leading dash, no '..' (N13d)."""
    return F.coalesce(x.rlike(r"^[A-Za-z0-9_./^~@{}-]+$") & ~x.startswith("-") & ~x.contains(".."), F.lit(False))


def validation_errors(namespace: Column, summary: Column, content: Column) -> Column:
    """Names of the rules that a record breaks."""
    checks = [
        ("namespace", ~is_valid_namespace(namespace)),
        ("summary_empty", is_blank(summary)),
        ("summary_length", F.length(summary) > L.MAX_SUMMARY_CHARS),
        ("content_empty", is_blank(content)),
        ("content_size", F.octet_length(content) > L.MAX_CONTENT_BYTES),
    ]
    return F.filter(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in checks)), lambda x: x.isNotNull())


def luhn_ok(x: Column) -> Column:
    """Luhn test of the digits in a text, thirteen at least."""
    digits = F.regexp_replace(x, r"\D", "")
    return (F.length(digits) >= 13) & F.call_function("luhn_check", digits)


def xml_escape(x: Column) -> Column:
    """The five predefined entities, & first."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def labels_key(labels: Column) -> Column:
    """A map as text that can be grouped by: sorted k=v, comma-separated."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


def domain_terms(path: Column, limit: int = 5, shortest: int = 3) -> Column:
    """Terms of a file path: useful directories, then parts of the file name, each once (H11, N15e)."""
    parts = F.split(path, "/")
    directories = F.filter(F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), F.lower), lambda d: (F.length(d) >= shortest) & ~d.startswith(".") & ~d.isin(L.SKIP_DIRECTORIES))
    stem = F.regexp_replace(F.element_at(parts, -1), r"(?<=.)\.[^.]*$", "")
    names = F.filter(F.split(F.lower(stem), r"[_\-./]"), lambda p: (F.length(p) >= shortest) & ~p.isin(L.SKIP_FILE_PARTS))
    return F.when(path.isNull() | (path == ""), F.array().cast("array<string>")).otherwise(F.slice(F.array_distinct(F.concat(directories, names)), 1, limit))


def query_tokens(query: Column) -> Column:
    """Words of a query longer than one character, without punctuation."""
    return F.filter(F.split(F.translate(query, L.QUERY_PUNCTUATION, " " * len(L.QUERY_PUNCTUATION)), r"\s+"), lambda t: F.length(t) > 1)


def expand_query(query: Column, limit: int = 5) -> Column:
    """Synonyms and domain terms that are not in the query, sorted, twice ``limit`` at most."""
    table = F.create_map(*(F.lit(v) for k in sorted({*L.SYNONYMS, *L.DOMAIN_TERMS}) for v in (k, " ".join([*L.SYNONYMS.get(k, "").split()[:limit], *L.DOMAIN_TERMS.get(k, "").split()[:limit]]))))
    low = F.transform(query_tokens(query), F.lower)
    found = F.flatten(F.transform(F.filter(low, lambda t: F.map_contains_key(table, t)), lambda t: F.split(F.element_at(table, t), " ")))
    return F.slice(F.array_sort(F.array_except(F.array_distinct(found), low)), 1, 2 * limit)


def cache_key(query: Column, terms: Column, filters: Column) -> Column:
    """16 hex digits of original|terms|filters."""
    return F.substring(F.sha2(F.concat_ws("|", query, F.array_join(F.array_sort(terms), ","), filters), 256), 1, 16)


def record_tokens(summary: Column, tags: Column) -> Column:
    """Token estimate of a record in a context (F8)."""
    tags = F.coalesce(tags, F.array().cast("array<string>"))
    return F.floor(F.lit(0.25) * (F.length(summary) + 50 + F.aggregate(tags, F.lit(0), lambda a, t: a + F.length(t)) + 2 * F.size(tags))).cast("int")
