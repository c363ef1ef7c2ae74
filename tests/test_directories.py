"""Directory matching by containment, with names that all end alike."""

from clauseloom.operators.graph import match_directories
from pyspark.sql import functions as F


def test_names_with_one_ending(spark):
    n = 3000
    contracts = spark.range(n).select(F.concat(F.lit("party"), F.format_string("%05d", "id"), F.lit("_SUPPLY_AGREEMENT")).alias("contract_id"))
    directories = spark.range(n).select(F.concat(F.lit("x-party"), F.format_string("%05d", "id"), F.lit("_supply_agreement-template")).alias("directory"))
    got = {r.directory: r.contract_id for r in match_directories(directories, contracts).collect()}
    assert len(got) == n and all(f"party{k:05d}_SUPPLY_AGREEMENT" == got[f"x-party{k:05d}_supply_agreement-template"] for k in range(n))


def test_only_the_table_of_run_lengths_is_broadcast(spark):
    rows = spark.createDataFrame([("DEAL_1_x", "old deal_1_x copy")], "contract_id string, directory string")
    found = match_directories(rows.select("directory"), rows.select("contract_id"))
    assert found._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") == 0
    assert [tuple(r) for r in found.collect()] == [("old deal_1_x copy", "DEAL_1_x")]
