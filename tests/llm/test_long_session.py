from .test_dedup import shuffled_bytes


def test_status_of_skipped_stages_is_kept(spark):
    """Spark forgets skipped stages first once it holds more stages than it may retain (1,000 by default)."""
    once = spark.sparkContext.parallelize([1], 1)._jrdd
    again = once.repartition(1)

    def run():
        for _ in range(2):
            again.count()  # the second job skips a stage
        for _ in range(600):
            once.repartition(1).count()

    assert shuffled_bytes(spark, run) > 0
