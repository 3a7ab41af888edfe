import os

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")]))

WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa the of and to in".split()


def text(rng, n):
    return " ".join(rng.choice(WORDS) + (str(rng.randint(0, 400)) if rng.random() < 0.7 else "") for _ in range(n))


def corpus(rng, n=60):
    """Texts with copies, near copies, shared passages, repeats, and the odd cases."""
    base = [text(rng, rng.randint(1, 120)) for _ in range(n)]
    passage = text(rng, 90)
    for i in range(0, n, 4):
        base[i] = base[(i * 7 + 1) % n]
    for i in range(1, n, 6):
        w = base[(i * 5 + 2) % n].split()
        if w:
            w[rng.randrange(len(w))] = "changed"
        base[i] = " ".join(w)
    for i in range(2, n, 9):
        base[i] = base[i] + "\n" + passage + "\n" + text(rng, 10)
    return [*base, "", None, " \t\n ", "one", "same same " * 400, "x" * 5000, "ab " * 9000, "é" * 700, passage, passage]


def docs_of(spark, texts, ids=None):
    """A documents table with columns whose names operators use inside."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", "src", len(t or ""), 1, 2, "x", "y", [1], 0.5) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, chunk int, bucket int, kept string, kind string, ids array<int>, score double")


def vectors(spark, rng, n=150):
    """An embeddings table with copies, ties, and every vector that takes no part."""
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(n)]
    rows += [(i, rows[50][1]) for i in range(1000, 1040)] + [(i, [2 * x for x in rows[3][1]]) for i in range(1050, 1060)]
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * 6, [None, *[1.0] * 5], [nan, *[1.0] * 5], [inf, *[1.0] * 5], [1.0] * 5, [-0.0, 1.0, *[0.0] * 4], [0.0, 1.0, *[0.0] * 4], [1e-30] * 6, [1e30] * 6]
    rows += [(2000 + 50 * k, v) for k, v in enumerate(odd)] + [(None, [1.0] * 6), (50, rows[50][1]), (50, rows[50][1])]
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, part int, h string")


@pytest.fixture(scope="session")
def empty(spark):
    return docs_of(spark, [])
