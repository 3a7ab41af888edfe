"""What the stored model joins, and what the search for longest repeats reads again."""

import hashlib

from notelake.llm import exchange, katz_store, queries, repeats


def test_stored_model_looks_up_each_ngram_once(spark, tmp_path):
    """N-grams are grouped before the tables are joined; equal parts of different texts score alike."""
    docs = spark.createDataFrame([(i, f"a b c d e {i % 3}") for i in range(30)], "doc_id int, text string")
    katz_store.train(docs, str(tmp_path), 3)
    found = katz_store.score(docs, str(tmp_path))
    assert "first(g1" in found._jdf.queryExecution().optimizedPlan().toString()
    rows = found.collect()
    assert len(rows) == 30 and {r.n_tokens for r in rows} == {7}
    assert len({(r.doc_id % 3, round(r.score, 9)) for r in rows}) == 3


def test_only_documents_with_a_repeat_are_read_again(spark, monkeypatch):
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (2, "x " + " ".join(words)), (3, " ".join(words[:14])), (None, " ".join(words[20:50])), *((i, " ".join(f"u{i}.{j}" for j in range(80))) for i in range(10, 40))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    read = []
    plain = exchange.with_answers
    monkeypatch.setattr(exchange, "with_answers", lambda dealt, *rest: (read.append(dealt.count()), plain(dealt, *rest))[1])
    found = {r.doc_id: r.words for r in repeats.longest_repeats(docs).collect()}
    assert found == {1: 52, 2: 52, 3: 13, None: 26, **dict.fromkeys(range(10, 40), 0)}
    assert read == [34, 34, 4, 4, 3, 3, 2]


def test_the_registered_query_of_word_repeats_runs(spark, tmp_path):
    words = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(words)), (2, "x " + " ".join(words[:20])), (3, "y z"), (4, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.QUERIES["op9_word_repeats"](spark, str(tmp_path)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {1: (40, 0, sha(rows[0][1])), 2: (21, 20, sha("x")), 3: (2, 0, sha("y z")), 4: (0, 0, sha(""))}
