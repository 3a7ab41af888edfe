"""The pass that tells which patterns to try on a text, against trying all of them."""

import random
import re
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from notelake import literals as L
from notelake.functions import gates
from notelake.operators import security, signals
from notelake.plans import views as V

STATED = [(L.BLOCK_PATTERN, re.M | re.S, L.BLOCK_ANCHOR)]
STATED += [(p, 0, a) for kind, ps in L.SIGNAL_PATTERNS.items() for (p, _), a in zip(ps, L.SIGNAL_ANCHORS[kind], strict=True)]
STATED += [(p, 0, a) for (_, _, p), a in zip(L.SECRET_PATTERNS, L.SECRET_ANCHORS, strict=True)]


@pytest.mark.parametrize(("pattern", "flags", "anchors"), STATED)
def test_every_match_holds_an_anchor(pattern, flags, anchors):
    @settings(max_examples=30, deadline=None, database=None, suppress_health_check=list(HealthCheck))
    @given(st.from_regex(re.compile(pattern, flags)))
    def check(text):
        low = gates.folded(text)
        assert any(a in low for a in anchors.split("|"))

    check()


@pytest.mark.parametrize("at_once", [1, 7, 1 << 22])
def test_portions_and_patterns_without_anchors(monkeypatch, at_once):
    monkeypatch.setattr(gates, "AT_ONCE", at_once)
    p = gates.Patterns(["ab", "b", "x|y", "[0-9]"], [["ab"], ["b"], ["x", "y"], []])
    rng = random.Random(3)
    texts = [None, "", "AB", "é", "Ab", "", *("".join(rng.choices("aBxyz ", k=rng.randrange(6))) for _ in range(300)), None]
    want = [sum(1 << i for i, some in enumerate([["ab"], ["b"], ["x", "y"], [""]]) if any(s in (t or "").lower() for s in some)) for t in texts]
    assert list(p.possible(texts)) == want
    assert list(p.possible([])) == [] and list(gates.Patterns(["a"], [[]]).possible(["q", None])) == [1, 1]


def test_detectors_find_what_all_patterns_find(spark):
    texts = [r.text for name in ("documents", "conversations") for r in V.table(spark, "/root/testdata/sf0.001", name).select("text").collect()]
    rng = random.Random(5)
    bits = ["I decided to ", "We'll go with ", "[l] ", "TİL ", "Key insight: ", "AKIA" + "A" * 16, ' password = "hunter2x" ', "▶ learned ─── T\nb\n────\n", "\n", "ſhipped ", "AC" + "0a" * 16, " (555) 123-4567 ", None]
    texts += ["".join(filter(None, rng.choices(bits, k=4))) for _ in range(300)] + [None, "", "    ", "x" * 200_000 + " I decided to"]
    every = (1 << 100) - 1
    found = signals.detect_many(texts)
    assert found == [signals.detect_one(t, possible=every) for t in texts] == [signals.detect_one(t) for t in texts]
    assert sum(map(len, found)) > 300
    found = security.detect_many(texts)
    assert found == [security.detect_one(t, possible=every) for t in texts] == [security.detect_one(t) for t in texts]
    assert sum(map(len, found)) > 200
    assert security.detect_many(texts, secrets=False) == [security.detect_one(t, secrets=False) for t in texts]


def test_cost_does_not_follow_the_number_of_patterns():
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9))
    texts = [" ".join(word() for _ in range(200)) for _ in range(500)]

    def seconds(n):
        words = [word() for _ in range(n)]
        p = gates.Patterns(words, [[w] for w in words])
        best = []
        for _ in range(3):
            began = time.perf_counter()
            assert len(list(p.possible(texts))) == len(texts)
            best.append(time.perf_counter() - began)
        return min(best)

    assert seconds(1600) < 8 * seconds(100)
