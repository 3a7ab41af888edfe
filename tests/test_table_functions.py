"""Table functions in SQL against the column forms."""

import pytest
from pyspark.sql import functions as F

from notelake.functions import table_functions
from notelake.operators import security, signals

TEXTS = ["I decided to use the new parser. Then we finished the migration, which is important.", "078-05-1120 and (555) 123-4567\npassword: \"hunter2hunter\"", "", None, "nothing", "Please remember this for later. I prefer to keep it small."]


@pytest.fixture
def messages(spark):
    table_functions.register(spark)
    df = spark.createDataFrame([(k % 2, k, t) for k, t in enumerate(TEXTS)], "conv_id long, turn long, text string")
    df.createOrReplaceTempView("messages_")
    return df


def test_signals_and_secrets_of_each_text(spark, messages):
    got = spark.sql("SELECT m.turn, s.* FROM messages_ m, LATERAL detect_signals(m.text) s").collect()
    want = signals.signals(messages, "turn").select("turn", "type", "match", "confidence", "context", "suggested_namespace", "position").collect()
    assert sorted(got) == sorted(want) and len(got) == 4
    sure = spark.sql("SELECT m.turn, s.confidence FROM messages_ m, LATERAL detect_signals(m.text, 0.9) s").collect()
    assert sorted(sure) == sorted((r.turn, r.confidence) for r in want if r.confidence >= 0.9)
    got = spark.sql("SELECT m.turn, d.* FROM messages_ m, LATERAL detect_secrets(m.text) d").collect()
    want = messages.select("turn", F.explode(security.detect("text")).alias("x")).select("turn", "x.*").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 3


def test_surest_signals_of_each_session(spark, messages):
    got = spark.sql("SELECT conv_id, turn, type, position, rank FROM surest_signals(TABLE(messages_) PARTITION BY (conv_id), 2, 0.5)").collect()
    want = signals.session_signals(signals.signals(messages, "conv_id", "turn"), 0.5, 2).select("conv_id", "turn", "type", "position", "rank").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and {r["rank"] for r in got} == {1, 2}


def test_arguments_are_checked(spark, messages):
    for bad in ("SELECT * FROM detect_signals(1)", "SELECT * FROM surest_signals(TABLE(SELECT 1 AS x), 2, 0.5)", "SELECT * FROM surest_signals(TABLE(messages_), 0, 0.5)"):
        with pytest.raises(Exception, match="detect_signals takes|surest_signals takes"):
            spark.sql(bad).collect()
