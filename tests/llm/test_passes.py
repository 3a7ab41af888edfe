"""Models that are trained and read in passes: the same values, and nothing left behind."""

import os
import random

import pytest

from notelake.functions import tables
from notelake.llm import exchange, katz_store, repeats
from tests.llm.conftest import corpus, docs_of


def _left(spark):
    folder = tables._folder(spark.range(1)).removeprefix("file:")
    return {n for n in os.listdir(folder) if n.startswith("table-")}


@pytest.mark.parametrize("order", [1, 3])
def test_passes_do_not_change_a_model(spark, tmp_path, order):
    docs, other = docs_of(spark, corpus(random.Random(5), 40)), docs_of(spark, corpus(random.Random(6), 20))
    before, got = _left(spark), []
    for passes in (1, 3):
        folder = f"{tmp_path}/{passes}"
        katz_store.train(docs, folder, order, passes=passes)
        assert _left(spark) == before  # what training has written in between is gone
        got.append({r.doc_id: (r.n_tokens, r.score) for t in (docs, other) for r in katz_store.score(t, folder, passes=passes).collect()})
        grams = spark.read.parquet(f"{folder}/grams")
        assert grams.count() == grams.select("k", "gram").distinct().count()
    assert got[0].keys() == got[1].keys() and all(got[0][i] == (got[1][i][0], pytest.approx(got[1][i][1], rel=1e-12)) for i in got[0])


def test_large_tables_take_several_passes(spark):
    docs = docs_of(spark, ["a b"])
    assert katz_store._passes(docs, 16, None) == [(0, 16)]
    assert katz_store._passes(docs, 16, 5) == [(0, 3), (3, 6), (6, 9), (9, 12), (12, 16)]
    large = katz_store._passes(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text"), 16, None)
    assert 4 < len(large) <= katz_store.MAX_PASSES and (large[0][0], large[-1][1]) == (0, 16)


def test_answers_of_a_length_go_with_the_next(spark, monkeypatch):
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "x " + " ".join(words)), (3, " ".join(words[:14])), (4, "y")], "doc_id bigint, text string")
    made, released, settled, release = [], [], exchange.settled, exchange.release
    monkeypatch.setattr(exchange, "settled", lambda df: (made.append(settled(df)), made[-1])[1])
    monkeypatch.setattr(exchange, "release", lambda session: (released.append(1), release(session)))
    assert {r.doc_id: r.words for r in repeats.longest_repeats(docs).collect()} == {1: 52, 2: 52, 3: 13, 4: 0}
    answers = [df for df in made if "payload" in df.columns]
    files = [df._jdf.queryExecution().logical().rdd().getCheckpointFile().get().removeprefix("file:") for df in answers]
    assert len(files) == 4 and not any(map(os.path.exists, files)) and len(released) == 7
