"""Cleaning and windows of long texts: same words, made once per text."""

import time

from pyspark.sql import functions as F

from clauseloom.functions import text as X


def test_clean_text_and_its_word_count(spark):
    texts = {" a \t\n b  c ": "a b c", "Page 3 of 12 x": "x", "[***] and $[****]  (***)": "and $", "12 \n": "", "": "",
             "a  b\n c": "a b c", "* ** ***": "* ** ***", "**[***]*": "***", " \t": ""}
    rows = spark.createDataFrame([(k, v) for k, v in texts.items()] + [(None, None)], "text string, want string")
    found = rows.withColumn("c", X.clean_text(F.col("text"))).select(
        "want", "c", X.clean_word_count(F.col("c")).alias("n"), X.word_count(F.col("c")).alias("words"))
    for r in found.collect():
        assert r["c"] == r["want"] and r["n"] == r["words"]


def test_windows_cover_a_very_long_text_in_time(spark):
    # 500,000 words in 5,000 windows; the text must not be split again for each of them.
    rows = spark.range(2).select(F.repeat(F.lit("word  "), 500_000).alias("text")).repartition(2)
    started = time.time()
    for clean in (False, True):
        text = X.clean_text(F.col("text")) if clean else F.col("text")
        runs = rows.select(F.explode(X.word_windows(text, 100, clean)).alias("w")).agg(
            F.count("*").alias("n"), F.sum(X.word_count(F.col("w"))).alias("words")).first()
        assert (runs["n"], runs["words"]) == (10_000, 1_000_000)
    assert time.time() - started < 120


def test_windows_of_short_and_missing_texts(spark):
    rows = spark.createDataFrame([("a b c",), (" a  b ",), ("",), (None,)], "text string")
    got = [r[0] for r in rows.select(X.word_windows(F.col("text"), 2)).collect()]
    assert got == [["a b", "c"], [" a  b "], [""], [None]]
