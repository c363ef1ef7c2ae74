"""A sample of registered queries against their oracle SQL, and the driver contract."""

import pytest
from oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"
SAMPLE = [
    "extraction_long_table", "consistency_rules_amounts", "extraction_documents_control", "processed_table_round_trip",
    "question_routing", "nearest_by_clause_id", "text_similarity_relation", "templates", "graph_template_edges",
    "lifecycle_validation", "stream_conformance", "response_cache",
]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, name):
    from __spark_entry__ import oracle_sql, queries

    ok, note = compare(spark, connect(SF_DIR), name, queries()[name], oracle_sql()[name], SF_DIR)
    assert ok, note


def test_entry(spark):
    from __spark_entry__ import entry

    assert entry(spark).count() == 11


def test_result_does_not_depend_on_partitions(spark):
    from __spark_entry__ import queries

    runs = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        runs.append(sorted(map(str, queries()["graph_edges"](spark, SF_DIR).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert runs[0] == runs[1]
