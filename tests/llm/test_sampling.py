from pyspark.sql import functions as F

from causalog.llm.common import bounded_sample


def test_a_sample_is_bounded_and_copies_do_not_fill_it(spark):
    rows = spark.range(60_000).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.lit("same")).otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    one_id = rows.withColumn("id", F.when(F.col("text") == "same", F.lit(None).cast("long")).otherwise(F.col("id")))
    for table in (rows, one_id):
        for keys in (["text", "id"], ["text"]):
            sample = bounded_sample(table, 6000, 0.1, keys, 7)
            assert 3500 <= sample.count() <= 6000 and sample.count() == bounded_sample(table, 6000, 0.1, keys, 7).intersect(sample).count()
    share = bounded_sample(rows, 6000, 0.1, ["text", "id"], 7).where("text = 'same'").count() / 6000
    assert 0.25 < share < 0.42
    assert bounded_sample(rows, 50, 1.0, ["text", "id"], 7).count() == 50
    twice = rows.limit(100).crossJoin(spark.range(2).select(F.col("id").alias("label")))
    assert {(r.label, r.id is None) for r in bounded_sample(twice, 500, 1.0, ["text", "id"], 7).collect()} == {(0, False)}
    assert bounded_sample(rows.limit(0), 50, 1.0, ["text"], 7).count() == 0
