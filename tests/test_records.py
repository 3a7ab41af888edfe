"""Scalar functions, lookups, search, ranking, lifecycle, sync, notes."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from notelake import literals as L
from notelake import schema
from notelake.functions import scalar as S
from notelake.operators import context, knn, lifecycle, lookup, notes, sync
from notelake.sources.store import Conflict, Store

NOW = datetime(2024, 3, 1, tzinfo=timezone.utc)
def as_of():
    return F.lit("2024-03-01 00:00:00").cast("timestamp")


def records(spark, rows):
    """Rows of id, namespace, summary, content, age in days, spec, tags, status."""
    full = [(i, "sha" + i, n, s, c, NOW - timedelta(days=a), sp, t, st) for i, n, s, c, a, sp, t, st in rows]
    return spark.createDataFrame(full, "id string, commit_sha string, namespace string, summary string, content string, timestamp timestamp, spec string, tags array<string>, status string")


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def at(days):
    return F.lit((NOW - timedelta(days=days)).strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")


@pytest.mark.parametrize(("days", "want"), [(0, 1.0), (30, 0.5), (60, 0.25), (-5, 1.0)])
def test_decay(spark, days, want):
    assert one(spark, S.temporal_decay(at(days), as_of())) == pytest.approx(want)


def test_decay_of_nothing_and_floor(spark):
    assert one(spark, S.temporal_decay(F.lit(None).cast("timestamp"), as_of())) == 0.5
    assert one(spark, S.temporal_decay(at(3000), as_of(), floor=0.1)) == 0.1
    assert one(spark, S.age_days(F.lit(None).cast("timestamp"), as_of())) == 0.0


def test_like_folds_ascii_only_and_keeps_wildcards(spark):
    ok = lambda text, q: one(spark, S.contains_like(F.col("t"), q), t=text)
    assert ok("Use PostgreSQL", "postgres") and ok("a_b", "A_B") and ok("axb", "a_b") and not ok("ÉTÉ", "été") and ok(r"a\b", "a\\b") and ok("100%", "0%")


def test_titles(spark):
    t = lambda s: one(spark, S.title_case(F.col("s")), s=s)
    for s in ("user_id trade-off", "database design", "they're 3rd"):
        assert t(s) == s.title()


def test_luhn(spark):
    ok = lambda s: one(spark, S.luhn_ok(F.col("s")), s=s)
    assert ok("4532015112830366") and ok("4532-0151-1283-0366") and ok("378282246310005") and not ok("4532015112830367") and not ok("42")


def test_query_expansion(spark):
    terms = one(spark, S.expand_query(F.col("q")), q="Why the bug, in (frontend)?")
    assert terms == sorted({*L.SYNONYMS["why"].split(), *L.SYNONYMS["bug"].split(), *L.DOMAIN_TERMS["frontend"].split()} - {"why", "the", "bug", "in", "frontend"})[:10]
    assert one(spark, S.expand_query(F.col("q")), q="") == []


@pytest.mark.parametrize(
    ("path", "want"),
    [("src/auth/jwt_handler.py", ["auth", "jwt", "handler"]), ("services/user/profile/avatar_service.py", ["services", "user", "profile", "avatar", "service"]), ("tests/test_index.py", ["index"]), ("", []), ("a/b.py", []), (".git/x/config.yml", ["config"])],
)
def test_domain_terms(spark, path, want):
    assert one(spark, S.domain_terms(F.col("p")), p=path) == want


def test_validation(spark):
    e = lambda n, s, c: one(spark, S.validation_errors(F.col("n"), F.col("s"), F.col("c")), n=n, s=s, c=c)
    assert e("decisions", "s", "c") == [] and e("x", " ", "") == ["namespace", "summary_empty", "content_empty"]
    assert e("decisions", "s" * 101, "é" * 51_201) == ["summary_length", "content_size"] and e("decisions", "s" * 100, "é" * 51_200) == []
    assert one(spark, S.is_valid_git_ref(F.col("r")), r="refs/notes/x") and not one(spark, S.is_valid_git_ref(F.col("r")), r="-x") and not one(spark, S.is_valid_git_ref(F.col("r")), r="a..b")


THREE = [("decisions:a:0", "decisions", "Use PostgreSQL", "text", 0, "alpha", ["db"], "active"), ("learnings:b:0", "learnings", "Caching", "uses postgres", 10, "alpha", None, None), ("blockers:c:0", "blockers", "CI", "x", 20, None, [], "")]


def test_lookups(spark):
    m = records(spark, THREE)
    ids = lambda df: [r.id for r in df.collect()]
    assert ids(lookup.get(m, "learnings:b:0")) == ["learnings:b:0"] and ids(lookup.get(m, "no")) == []
    assert ids(lookup.search_text(m, "POSTGRES")) == ["decisions:a:0", "learnings:b:0"] and ids(lookup.search_text(m, "  ")) == []
    assert ids(lookup.list_recent(m, 2)) == ["decisions:a:0", "learnings:b:0"]
    assert set(ids(lookup.select_by(m, status="active"))) == {x[0] for x in THREE}
    assert ids(lookup.by_spec(m, "alpha", limit=1)) == ["decisions:a:0"]


def vectors(spark, rows):
    return spark.createDataFrame([(i, [v] * 8) for i, v in rows], schema.MEMORY_VECTORS)


def test_nearest(spark):
    m = records(spark, [(i, n, "s", "c", 0, None, [], "active") for i, n in (("a", "decisions"), ("b", "learnings"), ("c", "learnings"))])
    v = vectors(spark, [("a", 0.1), ("b", 0.5), ("c", 0.9), ("lost", 0.1)])
    found = knn.nearest(v, m, [0.1] * 8, 2).collect()
    assert [r.id for r in found] == ["a", "b"] and found[0].distance < 0.01
    assert [r.id for r in knn.nearest(v, m, [0.1] * 8, 1, "learnings").collect()] == ["b"]
    far = vectors(spark, [*((f"x{i}", 0.1) for i in range(9)), ("c", 0.9)])
    assert knn.nearest(far, m, [0.1] * 8, 1, "learnings").count() == 0  # filtered after the limit
    assert [r.id for r in knn.nearest(far, m, [0.1] * 8, 1, "learnings", mode="pre").collect()] == ["c"]
    assert [r.id for r in knn.similar(v, m, "a", 5).collect()] == ["b", "c"] and knn.similar(v, m, "none").count() == 0
    assert [round(r.similarity, 3) for r in knn.search(v, m, [0.1] * 8, 3, min_similarity=0.4).collect()] == [1.0, 0.469]


def test_rerank(spark):
    rows = [("1", "decisions", "s", "c", 0, "alpha", ["db", "x"], "active"), ("2", "learnings", "s", "c", 7, "beta", [], "active"), ("3", "other", "s", "c", 30, "alpha", ["db"], "active")]
    m = records(spark, rows).join(spark.createDataFrame([("1", 0.25), ("2", 0.3), ("3", 0.2)], "id string, distance double"), "id")
    got = {r.id: r for r in knn.rerank(m, as_of(), "alpha", "decisions", ["db", "y"]).collect()}
    assert got["1"].boosted == pytest.approx(0.25 - 0.1 * (0.2 * 1 + 0.1 * 1.2 + 0.15 * 1 + 0.1 * 0.5))
    assert got["3"].boosted == pytest.approx(0.2 - 0.1 * (0.2 * 0.5 + 0.1 * 0.5 + 0.15 * 1 + 0.1 * 0.5))
    assert [r.id for r in knn.rerank(m, as_of()).collect()] == ["3", "1", "2"]


def test_novelty(spark):
    m = records(spark, [("a", "decisions", "s", "c", 0, None, [], "active"), ("b", "learnings", "s", "c", 0, None, [], "active")])
    q = spark.createDataFrame([(1, "decisions", [0.1] * 8), (2, "progress", [0.1] * 8), (3, "learnings", None)], "query_id int, namespace string, embedding array<float>")
    got = {r.query_id: r for r in knn.novelty(q, vectors(spark, [("a", 0.1), ("b", 9.0)]), m).collect()}
    assert got[1].novelty_score == 0.0 and not got[1].is_novel and got[1].similar_ids == ["a"]
    assert got[2].novelty_score == 1.0 and got[3].is_novel


def test_embedding_keeps_places_of_blanks(spark):
    df = spark.createDataFrame([("ab",), ("",), (None,), ("c",)], "text string").coalesce(1)
    got = [r.embedding for r in knn.embed(df, lambda ts: [[len(t), 0.0] for t in ts], 2, batch=3).collect()]
    assert got == [[1.0, 0.0], [0.0, 0.0], [0.0, 0.0], [1.0, 0.0]]


def test_search_cache():
    now = [0.0]
    c = knn.SearchCache(2, 10, lambda: now[0])
    c.set("a", 1)
    c.set("b", 2)
    assert c.get("a") == 1
    c.set("c", 3)
    assert c.get("b") is None and c.get("a") == 1 and c.invalidate("c") == 1
    now[0] = 11
    assert c.get("a") is None and c.stats()["hits"] == 2


@pytest.mark.parametrize(("status", "age", "want"), [("active", 10, "skipped"), ("active", 95, "archived"), ("resolved", 90, "archived"), ("archived", 180, "tombstoned"), ("archived", 179, "skipped"), ("tombstone", 365, "deleted"), ("tombstone", 10, "skipped"), (None, 100, "archived"), ("odd", 0, "error")])
def test_sweep(spark, status, age, want):
    m = records(spark, [("a", "decisions", "s", "c", age, None, [], status)])
    assert m.select(lifecycle.action(as_of()).alias("x")).first().x == want


def test_transitions(spark):
    m = records(spark, [(s, "decisions", "sum", "c" * 50, 0, None, ["t"], s) for s in L.STATUSES])
    got = lambda target, **k: {r.id: r for r in lifecycle.transition(m, m.select("id"), target, **k).collect()}
    assert {i: r.status for i, r in got("archived").items()} == {"active": "archived", "resolved": "archived", "archived": "archived", "tombstone": "tombstone"}
    assert {i: r.status for i, r in got("active").items()} == {"active": "active", "resolved": "resolved", "archived": "active", "tombstone": "active"}
    assert got("tombstone")["active"].content == "" and got("tombstone")["active"].tags == []
    z = got("archived", squeeze=True, keep_bytes=True)["active"]
    assert z.content.startswith("[ARCHIVED] [Compressed: ") and z.content.endswith("Original summary: sum")
    back = spark.createDataFrame([(z.content_z,), (bytearray(b"no"),)], "z binary").select(lifecycle.decompress(F.col("z")).alias("t")).collect()
    assert [r.t for r in back] == ["c" * 50, None]


def test_verify_and_repair(spark):
    m = records(spark, THREE)
    drifted = m.filter("id <> 'blockers:c:0'").withColumn("content", F.when(F.col("namespace") == "learnings", "other").otherwise(F.col("content"))).unionByName(m.limit(1).withColumn("id", F.lit("gone")))
    problems = sync.verify(m, drifted)
    assert sorted(map(tuple, problems.collect())) == [("blockers:c:0", "missing"), ("gone", "orphaned"), ("learnings:b:0", "mismatched")]
    assert tuple(sync.verification(problems).first()) == (1, 1, 1, 3, False)
    assert sync.verification(sync.verify(m, sync.repair(drifted, m))).first().is_consistent
    assert sorted(r.id for r in sync.insert(m, drifted.unionByName(drifted)).collect()) == ["gone"]


NOTE = "---\ntype: decisions\nspec: alpha\ntimestamp: '2024-01-15T10:30:00Z'\nsummary: Use it\ntags:\n  - a\n  - b\n---\n\n## Body\ntext"


def parsed(spark, *texts):
    rows = notes.parse_notes(spark.createDataFrame(list(enumerate(texts)), "i int, note string")).orderBy("i", "idx")
    return [(r.front_matter, r.body, r.raw, r.error) for r in rows.collect()]


def test_notes(spark):
    assert [raw for _, _, raw, _ in parsed(spark, NOTE + "\n" + NOTE, "plain", "before\n" + NOTE)] == [NOTE, NOTE, "plain", NOTE]
    errors = [e for *_, e in parsed(spark, "", " \t\n", "text", "---\na: b", "---\na: [\n---", "---\n- a\n---", "---\n---\nx", None)]
    assert errors == ["empty", "empty", "no front matter", "front matter not closed", "invalid YAML", "front matter is no mapping", "front matter is no mapping"]
    raw = spark.createDataFrame([("learnings", "abcdef1234", NOTE + "\n---\nsummary: only\n---\nb"), ("x", "y", "broken"), ("x", "z", None)], schema.RAW_NOTES)
    got = notes.to_memories(notes.records(raw), as_of()).orderBy("id").collect()
    assert [(r.id, r.summary, r.tags, r.content, r.missing_fields) for r in got] == [("decisions:abcdef1:0", "Use it", ["a", "b"], "## Body\ntext", []), ("learnings:abcdef1:1", "only", [], "b", ["type", "spec", "timestamp"])]
    rows = spark.createDataFrame([("t", None, "active", ["a"], "C")], "type string, spec string, status string, tags array<string>, content string")
    written = [notes.serialize({"type": "decisions", "summary": "é: x", "tags": ["a", "b"]}, "B"), notes.serialize_notes(rows, ["type", "spec", "status", "tags"]).first().note]
    assert [(fm, body) for fm, body, *_ in parsed(spark, *written)] == [({"type": "decisions", "summary": "é: x", "tags": "a,b"}, "B"), ({"type": "t", "tags": "a"}, "C")]


def test_splitting_pairs_up_marks(spark):
    rng = random.Random(3)
    texts = ["\n".join(rng.choice(["---", " --- ", "\u2003---\t", "----", "a: 1", "", "- b", "text --- x", "\x1f"]) for _ in range(rng.randint(0, 14))) for _ in range(300)]
    want = []
    for t in texts:
        lines = t.split("\n")
        marks = [i for i, x in enumerate(lines) if x.strip() == "---"]
        for k in range(0, len(marks), 2):
            stop = marks[k + 2] if k + 2 < len(marks) else len(lines)
            want.append(("\n".join(lines[marks[k] : stop]), "\n".join(lines[marks[k + 1] + 1 : stop]).strip() if k + 1 < len(marks) else ""))
        want += [] if marks else [(t, "")]
    assert [(raw, body) for _, body, raw, _ in parsed(spark, *texts)] == want


def test_budget(spark):
    assert context.budget(5)["total"] == 500 and context.budget(60)["working_memory"] == 900 and context.budget(0, "full")["total"] == 3000
    assert context.budget(0, "fixed", 1000) == {"total": 1000, "working_memory": 630, "semantic_context": 270, "commands": 100}
    m = records(spark, [("a", "n", "s" * 30, "c", 1, None, [], None), ("b", "n", "s" * 350, "c", 2, None, [], None), ("c", "n", "s", "c", 3, None, [], None)])
    got = context.within_budget(m, 40, [F.col("timestamp").desc()]).collect()
    assert [(r.id, r.tokens) for r in got] == [("a", 20)]  # the second does not fit, so the third is left out too


def test_two_writers_lose_nothing(spark, tmp_path):
    a, b = (Store(spark, str(tmp_path / "s")) for _ in range(2))
    one, two = (records(spark, [(f"{n}:{i}", "n", "s", "c", 1, None, [], None) for i in range(3)]) for n in "ab")
    both = one.unionByName(two)
    write = a._write

    def slow(df):
        name = write(df)
        if b.version() == 0:
            assert b.insert(two) == 3  # while the first one is about to switch
        return name

    a._write = slow
    assert a.insert(both) == 3 and sorted(r.id for r in a.read().collect()) == sorted(r.id for r in both.collect())
    folders = a._pointers()[a.version()]
    assert len(folders) == 2 and a.insert(two) == 0 and a._pointers()[a.version()][:2] == folders


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    assert s.read().count() == 0 and s.version() == 0
    m = records(spark, THREE)
    assert s.insert(m) == 3 and s.insert(m.withColumn("summary", F.lit("new"))) == 0
    with pytest.raises(ValueError):
        s.insert(m, strict=True)
    s.update(m.filter("namespace = 'blockers'").withColumn("summary", F.lit("new")))
    assert {r.summary for r in s.read().collect()} == {"Use PostgreSQL", "Caching", "new"}
    s.delete(m.filter("namespace = 'decisions'"))
    with pytest.raises(Conflict):
        s.replace(m, s.version() - 1)
    assert s.read().count() == 2 and s.vacuum() > 0 and s.read().count() == 2 and s.clear() == 2 and s.read().count() == 0


def test_notes_are_written_as_the_library_writes_them(spark):
    rng = random.Random(11)
    some = ["plain", "two words", "a  b", "a - b", "x: y", "a #b", "yes", "No", "null", "Nullable", "12", "1.5e3", "2024-01-15", "- a", "é", "it's", "a\nb", " lead", "trail ", "w" * 61, "long words " * 12 + "end", "x" * 200, "~", "v1.2/b-c_d", "[x]", "{x}", "a, b", "@x", "", "a\ttab", "on", "e.g. this", "a:", "\U0001f600", "___", "."]
    rows = [(k, rng.choice([*some, None]), rng.choice([*some, "active", "resolved"]), rng.choice([None, [], [rng.choice(some)], rng.choices(some, k=3), ["a", None]]), rng.choice(["", None, "body\n---\n"])) for k in range(1500)]
    df = spark.createDataFrame(rows, "k long, summary string, status string, relates_to array<string>, content string")
    got = {r.k: r.note for r in notes.serialize_notes(df, ["summary", "status", "relates_to"]).collect()}
    for k, summary, status, relates_to, content in rows:
        kept = {n: v for n, v in (("summary", summary), ("status", status), ("relates_to", relates_to)) if v and not (n == "status" and v == "active")}
        assert got[k] == notes.serialize(kept, content or "")
    odd = notes.serialize_notes(spark.createDataFrame([("a", "b", None)], "`on` string, `a b` string, content string"), ["on", "a b"]).first().note
    assert odd == notes.serialize({"on": "a", "a b": "b"}, "")
    assert notes.serialize_notes(df.limit(0), ["summary"]).count() == 0
