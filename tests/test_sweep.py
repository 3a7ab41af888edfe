"""The parallel sweep of terms and whole pattern detection against plain Python."""

import datetime
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from notelake import literals as L
from notelake.functions.tables import numbered, settled
from notelake.operators import patterns
from notelake.operators import sweep as module
from notelake.operators.sweep import sweep

TERM = re.compile(r"\b[a-z][a-z0-9_-]*[a-z0-9]\b|\b[a-z]\b")


def brute_clusters(sets, least):
    """Members and records, seed by seed; ``sets``: each term's records, in order."""
    used, out = set(), []
    for i in range(len(sets)):
        if i in used:
            continue
        members, left = [i], set(sets[i])
        for j in range(i + 1, len(sets)):
            if j not in used and len(left & sets[j]) >= least:
                members.append(j)
                left &= sets[j]
        used |= set(members)
        out.append((members, left))
    return out


def random_groups(seed, sizes, least):
    """Records of three groups, with hubs, blocks of terms that go together, and terms of their own."""
    rng, groups = random.Random(seed), {}
    for g, n in zip(("a", "b", ""), sizes, strict=True):
        hubs, records = [f"hub{k}" for k in range(4)], []
        for i in range(n):
            own = [h for k, h in enumerate(hubs) if rng.random() < 0.8 - 0.15 * k]
            topic = rng.randrange(8)
            own += [f"t{topic}_{k}" for k in range(6) if rng.random() < 0.7] + [f"w{rng.randrange(60)}" for _ in range(rng.randrange(5))]
            records.append(set(own))
        count = {}
        for r in records:
            for t in r:
                count[t] = count.get(t, 0) + 1
        order = {t: i for i, t in enumerate(sorted((t for t, c in count.items() if c >= least), key=lambda t: (-count[t], t)))}
        groups[g] = [sorted(order[t] for t in r if t in order) for r in records]
    return groups


@pytest.mark.parametrize(("n", "share", "first", "least"), [((60, 30, 9), 9.0, 256, 1), ((60, 30, 9), 9.0, 256, 3), ((25, 12, 9), 0.75, 256, 3), ((14, 6, 3), 0.4, 4, 2), ((5, 3, 0), 0.0, 256, 2)])
def test_parallel_sweep_is_the_sequential_one(spark, n, share, first, least):
    """From one task a group to rounds and joins for all (``share`` of the largest group's postings is swept by one task)."""
    groups = random_groups(len(n) + first + least, n, least)
    rows = [(g, 1000 * k + i, r) for k, (g, rs) in enumerate(groups.items()) for i, r in enumerate(rs) if r]
    df = settled(spark.createDataFrame(rows, "g string, d long, ts array<int>").coalesce(1))
    local = int(share * max(sum(map(len, rs)) for rs in groups.values()))
    got = sorted((r.g, r.seed, tuple(r.members), r.n, r.digest) for r in sweep(df, least, local, first).collect())
    want = []
    for g in groups:
        own = [(d, r) for h, d, r in rows if h == g]
        names = sorted({t for _, r in own for t in r})
        for members, left in brute_clusters([{d for d, r in own if t in r} for t in names], least):
            digest = 0
            for d in left:
                digest ^= d
            want.append((g, names[members[0]], tuple(names[m] for m in members), len(left), digest))
    assert got == sorted(want)


def test_sweep_of_nothing(spark):
    assert sweep(settled(spark.createDataFrame([], "g string, d long, ts array<int>")), 2).count() == 0


def brute_detect(rows, as_of, least, most):
    """Candidates of each namespace by the rules, in plain Python."""
    out = []
    for g in sorted({r["namespace"] for r in rows}):
        own = {}
        for r in rows:
            if r["namespace"] == g:
                own[r["id"]] = {w for w in TERM.findall(" ".join([r["summary"], r["content"], " ".join(r["tags"])]).lower()) if len(w) > 1 and w not in L.STOP_WORDS}
        count = {}
        for ws in own.values():
            for w in ws:
                count[w] = count.get(w, 0) + 1
        names = sorted((w for w, c in count.items() if c >= least), key=lambda w: (-count[w], w))
        seen, found = set(), []
        for members, left in brute_clusters([{i for i, ws in own.items() if w in ws} for w in names], least):
            if frozenset(left) not in seen:
                seen.add(frozenset(left))
                ws = [names[m] for m in members]
                raw = sum(math.log(len(own) / count[w]) for w in ws) / len(ws) * math.sqrt(len(left)) * len(ws) ** 0.3
                found.append((raw, ws, sorted(left)))
        found.sort(key=lambda x: (-x[0], x[1][0]))
        top = found[0][0] if found else 0
        for raw, ws, left in found[:most]:
            score = raw / top if top > 0 else 0.0
            decay = [2 ** (-max(0, (as_of - r["timestamp"]).total_seconds() / 86400) / 30) for r in rows if r["id"] in left]
            sure = (score * 0.6 + min(1, len(left) / 5) * 0.4) * (1 + 0.2 * sum(decay) / len(decay))
            out.append((g, tuple(ws), tuple(left), round(score, 6), round(max(0, min(1, sure)), 6)))
    return sorted(out)


@pytest.mark.parametrize("local", [10**6, 420])
def test_detection_against_plain_python(spark, local):
    rng = random.Random(3)
    now = datetime.datetime(2024, 3, 1, tzinfo=datetime.timezone.utc)
    topics = [["cache", "redis", "ttl"], ["token", "auth", "login", "session"], ["index", "query"]]
    rows = []
    for i in range(90):
        words = [w for w in rng.choice(topics) if rng.random() < 0.8] + [f"w{rng.randrange(25)}" for _ in range(6)] + ["the", "Größe", "x"]
        rows.append({"id": f"n:{i:07d}:0", "namespace": rng.choice(["decisions", "learnings"]), "summary": " ".join(words[:3]), "content": " ".join(words), "tags": [rng.choice(["perf", "security"])], "timestamp": now - datetime.timedelta(days=rng.randrange(200))})
    df = spark.createDataFrame(rows, "id string, namespace string, summary string, content string, tags array<string>, timestamp timestamp")
    df = df.unionByName(df.limit(0)).unionByName(spark.createDataFrame([(None, "decisions", "cache", "cache", ["perf"], None)], df.schema))
    got = patterns.detect(df, F.lit(now), min_occurrences=3, group="namespace", max_candidates=12, local=local, first=16).collect()
    assert sorted((r.group, tuple(r.terms), tuple(r.evidence), round(r.normalized_score, 6), round(r.confidence, 6)) for r in got) == brute_detect(rows, now, 3, 12)
    assert sorted(r.rank for r in got if r.group == "decisions") == list(range(1, 13))


def test_places_by_ranges_and_by_a_window_agree(spark):
    rng = random.Random(1)
    df = settled(spark.createDataFrame([(rng.choice(["a", "b", None]), rng.randrange(15)) for _ in range(400)], "g string, x int"))
    kept = [sorted((str(r.g), r.x, r.position, r.total) for r in numbered(df, [F.col("x").asc()], "g", most).collect()) for most in (0, 10**6)]
    assert kept[0] == kept[1]


@pytest.mark.parametrize("share", [0.5, 0.15])
def test_rounds_follow_the_postings_not_the_terms(spark, monkeypatch, share):
    """A large group takes a round for each block, and its blocks are few; seeds go in turns if they have many records left."""
    blocks, turns, block = [], [], module._block
    cut = module._cut
    monkeypatch.setattr(module, "_cut", lambda *a: (blocks.append(x := cut(*a)), x)[1])
    monkeypatch.setattr(module, "_block", lambda least, new: (turns.append(new), block(least, new))[1])
    groups = random_groups(5, (400, 30, 0), 2)
    rows = [(g, 1000 * k + i, r) for k, (g, rs) in enumerate(groups.items()) for i, r in enumerate(rs) if r]
    size = sum(map(len, groups["a"]))
    got = sorted((r.g, r.seed, tuple(r.members), r.n) for r in sweep(settled(spark.createDataFrame(rows, "g string, d long, ts array<int>")), 2, int(share * size), 8).collect())
    want = []
    for g in groups:
        own = [(d, r) for h, d, r in rows if h == g]
        names = sorted({t for _, r in own for t in r})
        want += [(g, names[m[0]], tuple(names[i] for i in m), len(left)) for m, left in brute_clusters([{d for d, r in own if t in r} for t in names], 2)]
    assert got == sorted(want)
    rounds = blocks[0][0].groupBy("g").count().agg(F.max("count")).first()[0]
    assert rounds <= 1 / share + 4 and rounds <= len(turns) <= 3 * rounds


def test_seeds_in_turns_are_the_sequential_ones(spark):
    """Earlier seeds that have more records left than a task takes go in turns, each without the terms taken before."""
    rng = random.Random(2)
    sets = [{d for d in range(40) if rng.random() < 0.5} for _ in range(12)]
    rows = [("a", d, [t for t in range(12) if d in sets[t]]) for d in range(40)]
    docs = spark.createDataFrame([(g, d, [t for t in ts if t >= 6]) for g, d, ts in rows], "g string, d long, ts array<int>")
    seeds = {0: set(range(30)), 1: set(range(10, 40)), 2: set(range(0, 40, 2)), 4: set(range(5))}
    state = settled(spark.createDataFrame([("a", s, d) for s, ds in seeds.items() for d in ds], "g string, seed int, d long"))
    used, want = set(), set()
    for seed, left in [*sorted(seeds.items()), *((t, None) for t in range(6, 12))]:
        if seed in used:
            continue
        members, left = ([seed], set(sets[seed])) if left is None else ([], set(left))
        for t in range(max(seed + 1, 6), 12):
            if t not in used and len(left & sets[t]) >= 4:
                members.append(t)
                left &= sets[t]
        used |= set(members)
        want |= {(seed, t, None) for t in members} | ({(seed, None, d) for d in left} if members else set())
    for local in (10, 1000):
        assert {(r.seed, r.t, r.d) for r in module._step(docs, state, 4, local).collect()} == want
