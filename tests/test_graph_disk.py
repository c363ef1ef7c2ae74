"""Graph tables are written small, and shuffles go when what was made of them is stored."""

import os
import time

from pyspark.sql import functions as F

from clauseloom.operators import extraction as E
from clauseloom.operators import graph as G
from clauseloom.operators import templates as T
from clauseloom.session import stored
from clauseloom.sources import writers

COLUMNS = "contract_id string, clause_seq long, clause_type string, text string"
ROWS = [("c", 3, "insurance", "Coverage of EUR 5,000.00 is mandatory."), ("c", 1, "insurance", "Coverage of EUR 5,000.00 is mandatory."),
        ("c", 2, "insurance", "Coverage of EUR 7.50 is mandatory."), ("d", 4, "insurance", "Nothing is said."),
        ("d", 5, "insurance", "EUR 9"), (None, 6, "insurance", "EUR 8"), ("d|x", 7, "insurance", "Coverage of EUR 7.50 is mandatory.")]


def _tables(spark):
    clauses = E.extract_contracts(spark.createDataFrame(ROWS, COLUMNS))
    keys = T.template_keys(clauses)
    return G.build(clauses, T.generate(clauses, keys=keys), keys=keys)


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def _shuffles(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f.getName() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_")}


def test_stored_frames_leave_no_shuffle(spark):
    before = _shuffles(spark)
    out = stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "swept")
    for _ in range(50):
        if not (left := _shuffles(spark) - before):
            break
        time.sleep(0.1)
    assert not left and out.count() == 7


def test_written_tables_are_read_back_and_sorted(spark, tmp_path):
    plain, tables = _tables(spark), _tables(spark)
    writers.write_graph(tables, str(tmp_path))
    for name in tables.names():
        read = spark.read.parquet(f"{tmp_path}/{name}")
        assert sorted(map(str, read.collect())) == sorted(map(str, plain[name].collect())), name
        assert all(f.endswith(".zstd.parquet") or f.endswith(".zst.parquet") for f in os.listdir(tmp_path / name) if f.endswith(".parquet"))
        assert tables[name].inputFiles() and all(str(tmp_path) in f for f in tables[name].inputFiles())
    assert {r.from_id for r in tables["USES_VARIABLES"].collect()} == {r.to_id for r in tables["GENERATES"].collect()}


def test_repeats_of_uses_edges_take_no_shuffle_of_their_own(spark):
    generates = spark.createDataFrame([("k", "t"), ("k", "t"), ("k", "s"), ("m", "t")], "from_id string, to_id string")
    variables = spark.createDataFrame([("k", "k|a"), ("k", "k|a"), ("m", "m|a"), ("n", "n|a")], "clause_id string, variable_id string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = G.uses_edges(generates, variables)
        assert _exchanges(edges) == 2
        assert sorted(map(tuple, edges.collect())) == [("s", "k|a"), ("t", "k|a"), ("t", "m|a")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_variables_of_a_clause_come_once_and_together(spark):
    rows = [(f"c{k % 50}", f"c{k % 50}|{v}") for k in range(200) for v in "ab"]
    edges = G.variable_edges(spark.createDataFrame(rows, "clause_id string, variable_id string"))
    assert sorted(map(tuple, edges.collect())) == sorted(set(rows))
    parts = edges.select(F.spark_partition_id().alias("p"), "from_id").distinct().groupBy("from_id").count()
    assert parts.where("count > 1").count() == 0
