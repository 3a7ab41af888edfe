"""The operators' queries against their SQL in DuckDB, on the smallest tables and on odd rows."""

import glob
import os
import random

import duckdb
import pytest
from notelake.llm import queries

from .conftest import corpus, docs_of, text, vectors

DATA = "/root/testdata/sf0.001"


def compared(spark, name, folder):
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        files = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{files}'")
    found = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    df = queries.QUERIES[name](spark, folder)
    assert sorted(df.columns) == sorted(names)
    form = lambda v: round(v, 5) if isinstance(v, float) else v
    got = sorted((tuple(form(r[c]) for c in names) for r in df.collect()), key=str)
    assert got == sorted((tuple(map(form, r)) for r in found.fetchall()), key=str)
    return got


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query(spark, name):
    rows = compared(spark, name, DATA)
    assert rows or name == "sentencepiece_parity"


@pytest.mark.parametrize("name", [n for n in queries.ORACLE_SQL if n != "sentencepiece_parity"])
def test_odd_rows(spark, name, tmp_path):
    rng = random.Random(2)
    near = text(rng, 200).split()
    texts = corpus(rng, 40) + [" ".join(w if rng.random() > 0.01 else "x" for w in near) for _ in range(8)]
    docs_of(spark, texts).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    docs_of(spark, [text(rng, 60), "été ÉTÉ 42", None, ""]).selectExpr("cast(doc_id as string) AS item_id", "text").write.parquet(f"{tmp_path}/benchmark.parquet")
    vectors(spark, rng).write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = compared(spark, name, str(tmp_path))
    assert len(rows) == len(texts) or name == "op11_learned_partitions"
