"""Pattern work over parties: each pattern once per row, and rows dealt out over the cores."""

from pyspark.sql import functions as F

from clauseloom.functions.parties import BETWEEN_PATTERNS
from clauseloom.operators import extraction as E

SF = "/root/testdata/sf0.001"


def test_late_names_are_read_in_all_tasks(spark):
    from __spark_entry__ import queries

    tasks = queries()["extract_parties_late_and_many"](spark, SF).select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks == int(spark.conf.get("spark.clauseloom.readPartitions"))


def test_fallback_reads_each_pattern_once(spark):
    rows = spark.createDataFrame([("c", "insurance", 1, "made by and between Acme Inc. and Beta Corporation WHEREAS both agree")],
                                 "contract_id string, clause_type string, clause_seq long, context string")
    found = E.fallback_parties(rows)
    assert found._jdf.queryExecution().optimizedPlan().toString().count(BETWEEN_PATTERNS[0]) == 1
    assert [r["parties"] for r in found.collect()] == [["Acme Inc"]]


def test_one_file_of_a_stream_is_extracted_in_all_tasks(spark):
    from clauseloom.streaming.clauses import extracted_stream

    rows = spark.createDataFrame([("c", "insurance", 1, "Coverage of EUR 5.00 is mandatory.")],
                                 "contract_id string, clause_type string, clause_seq long, text string").coalesce(1)
    found = extracted_stream(rows)
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
    assert found.where("v_amount = 5.0").count() == 1
