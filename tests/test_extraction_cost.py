"""Extraction looks up a clause's schema once per kind of value, and reads only what matched."""

from datetime import date

from pyspark.sql import functions as F

from clauseloom.functions import typed as X
from clauseloom.operators import extraction as E


def test_each_kind_of_value_is_looked_up_once(spark):
    rows = spark.createDataFrame([("c", 1, "volume_restriction", "Orders are limited to 5 units.")], "contract_id string, clause_seq long, clause_type string, text string")
    plan = E.extract_raw(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("exists(schema_vars") == 6


def test_values_of_all_forms_and_of_none(spark):
    texts = {
        "Made on 2020-02-30 or May 5, 2021.": (date(2021, 5, 5), None, None), "On the 1st day of March, 2020.": (date(2020, 3, 1), None, None),
        "Room 1234, Foo 12, 2020, no date.": (None, None, None), "For ten (10) years.": (None, (10, "Years"), None),
        "Sixty days (see 4).": (None, (60, "Days"), None), "A 3-year term.": (None, (3, "Years"), None),
        "Fees of 12 per cent (of sales).": (None, None, 0.12), "A share of percent (7).": (None, None, 0.07), "percent": (None, None, None), None: (None, None, None)}
    t = F.col("t")
    got = {r.t: (r.d and r.d.dt, r.u and (r.u.amount, r.u.unit), r.p and r.p.value) for r in spark.createDataFrame(
        [(x,) for x in texts], "t string").select("t", X.date_of(t).alias("d"), X.duration_of(t).alias("u"), X.percent_of(t).alias("p")).collect()}
    assert got == texts
