"""A model is asked once per distinct prompt, however often its answers are used."""

from clauseloom.operators.scoring import cached_responses
from pyspark.sql import functions as F


def test_each_missing_prompt_is_scored_once(spark):
    asked = spark.sparkContext.accumulator(0)

    def scorer(batches):
        for b in batches:
            asked.add(len(b))
            yield b.assign(response="r " + b["prompt"])[["cache_key", "response"]]

    prompts = spark.range(40).select((F.col("id") % 8).cast("string").alias("cache_key"), (F.col("id") % 8).cast("string").alias("prompt"))
    cache = spark.createDataFrame([("0", "known"), ("1", "known")], "cache_key string, response string")
    responses, fresh = cached_responses(prompts, cache, scorer)
    assert responses.count() == 8 and fresh.count() == 6 and responses.where("is_hit").count() == 2
    assert {r.response for r in responses.where("cache_key = '5'").collect()} == {"r 5"}
    assert asked.value == 6


def test_running_number_with_many_ranges(spark):
    from clauseloom.operators.numbering import running_number

    rows = spark.range(500).select((F.col("id") * F.col("id")).alias("o"), F.when(F.col("id") % 3 == 0, "hot").alias("k"), F.lit(1).alias("n_"))
    got = {r.o: r.n for r in running_number(rows, ["k"], "o", "n", range_rows=40).collect()}
    want = {}
    for hot in (True, False):
        want.update({i * i: n for n, i in enumerate([i for i in range(500) if (i % 3 == 0) == hot], 1)})
    assert got == want
