"""Neighbours by cells and bounds against all pairs."""

import numpy as np
import pytest

from notelake.operators import knn, neighbours


def rows_of(rng, n, clusters, dim=8):
    middle = rng.standard_normal((clusters, dim)) * 5
    x = middle[rng.integers(0, clusters, n)] + rng.standard_normal((n, dim)) * 0.6
    x[: n // 3] = x[0] + rng.standard_normal((n // 3, dim)) * 0.01 * (rng.random(n // 3)[:, None] < 0.5)  # a third close together, many equal
    names = rng.choice(["a", "b", "c"], n, p=[0.8, 0.199, 0.001])
    return [(f"{names[i]}:{i:05d}", str(names[i]), [float(v) for v in np.float32(x[i])]) for i in range(n)]


def brute(queries, known, k):
    out = []
    for q, ns, e in queries:
        near = sorted((float(np.sqrt(((np.array(v) - np.array(e)) ** 2).sum())), i) for i, name, v in known if name == ns)[:k]
        out += [(q, i, round(d, 9)) for d, i in near]
    return sorted(out)


@pytest.mark.parametrize(("clusters", "cell", "chunk", "block"), [(25, 40, 16_384, 1024), (25, 60, 150, 7), (1, 10**6, 300, 9)])
def test_nearest_of_many_queries_are_exact(spark, clusters, cell, chunk, block):
    rng = np.random.default_rng(cell)
    known = rows_of(rng, 1800, clusters)
    asked = [(k, known[j][1], known[j][2]) for k, j in enumerate(rng.integers(0, 1800, 60))] + [(100, "c", known[5][2]), (101, "none", known[5][2])]
    queries = spark.createDataFrame([*asked, (102, "a", None), (103, None, known[5][2])], "query_id long, namespace string, embedding array<float>")
    df = spark.createDataFrame([*known, ("x", "a", None)], "id string, namespace string, embedding array<float>")
    found, work = neighbours.nearest(queries, df, 5, cell, chunk, block)
    assert sorted((r.query_id, r.id, round(r.distance, 9)) for r in found.collect()) == brute(asked, known, 5)
    done = {r.query_id: (r.compared, r.records) for r in work.collect()}
    assert set(done) == {q for q, ns, _ in asked if ns != "none"} and all(0 < c <= n for c, n in done.values())
    if clusters > 1:
        assert np.mean([c / n for c, n in done.values() if n > 1000]) < 0.3


def test_nearest_of_nothing(spark):
    q = spark.createDataFrame([(1, "a", [1.0, 2.0])], "query_id long, namespace string, embedding array<float>")
    v = spark.createDataFrame([("i", [1.0, 2.0])], "id string, embedding array<float>")
    m = spark.createDataFrame([("i", "a")], "id string, namespace string")
    assert [tuple(r) for r in knn.nearest_many(q, v, m).collect()] == [(1, "i", 0.0)]
    assert knn.nearest_many(q, v.limit(0), m).count() == 0 and knn.nearest_many(q.limit(0), v, m).count() == 0
