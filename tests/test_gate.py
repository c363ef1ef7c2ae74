"""The gate of a machine reads the mean that the summary shows."""

import itertools

import duckdb
from pyspark.sql import functions as F

from clauseloom.operators import lifecycle as L


def test_mean_just_below_the_limit_is_judged_as_shown(spark):
    confidences = (0.333333, 0.444444, 0.5, 0.722222)  # their mean is 0.49999975
    states = spark.createDataFrame(
        [("m", f"s{i}", i, c, False, "operational") for i, c in enumerate(confidences)],
        "machine string, name string, ord int, confidence double, is_terminal boolean, category string")
    moves = spark.createDataFrame([("m", f"s{i}", f"s{i + 1}", "t", 0.5) for i in range(3)],
                                  "machine string, source string, target string, trigger string, confidence double")
    row = L.validation_summary(states, moves).first()
    assert row["avg_confidence"] == 0.5 and row["passes_gate"]


def test_means_that_end_in_a_half_are_rounded_as_in_sql(spark):
    shares = [round(n / (n + 10), 6) for n in range(1, 30)]
    rows = [(f"m{k}", f"s{i}", i, c, False, "operational") for k, pair in enumerate(itertools.combinations(shares, 2)) for i, c in enumerate(pair)]
    states = spark.createDataFrame(rows, "machine string, name string, ord int, confidence double, is_terminal boolean, category string")
    moves = states.where("ord = 0").select("machine", F.col("name").alias("source"), F.lit("s1").alias("target"),
                                           F.lit("t").alias("trigger"), "confidence")
    got = {r["machine"]: r["avg_confidence"] for r in L.validation_summary(states, moves).collect()}
    pairs = ", ".join(f"('{m}', {c!r}::DOUBLE)" for m, _, _, c, _, _ in rows)
    want = dict(duckdb.sql(f"SELECT m, round(avg(c), 6) FROM (VALUES {pairs}) t(m, c) GROUP BY m").fetchall())
    assert got == want
