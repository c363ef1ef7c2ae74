"""Extraction drops repeats first; amounts and polarity are those of all forms."""

from pyspark.sql import functions as F

from clauseloom.functions import typed as X
from clauseloom.operators import extraction as E

COLUMNS = "contract_id string, clause_seq long, clause_type string, text string"
ROWS = [("c", 3, "insurance", "Coverage of EUR 5,000.00 is mandatory."), ("c", 1, "insurance", "Coverage of EUR 5,000.00 is mandatory."),
        ("c", 2, "insurance", "Coverage of EUR 7.50 is mandatory."), ("d", 4, "insurance", "Nothing is said."), ("d", None, "insurance", "EUR 9"),
        ("d", 5, "insurance", "EUR 9"), (None, 6, "insurance", "EUR 8")]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_repeats_are_dropped_before_any_pattern_runs(spark):
    rows = spark.createDataFrame(ROWS, COLUMNS)
    found = E.extract_contracts(rows)
    late = E.dedup_clauses(E.extract_clauses(rows))
    assert sorted(map(str, found.collect())) == sorted(map(str, late.select(found.columns).collect()))
    plan = _plan(found)
    assert "Window" not in plan and plan.index("Generate explode") < plan.index("Aggregate")


def test_money_of_all_forms(spark):
    texts = {"$1,234.50": (1234.5, "USD", "$1,234.50"), "EUR 5 million": (5e6, "USD", "5 million"), "USD 2K": (2000.0, "USD", "USD 2K"),
             "pay 7 GBP": (7.0, "GBP", "7 GBP"), "€3.25 now": (3.25, "EUR", "€3.25"), "£ 9": (9.0, "GBP", "£ 9"), "no 5": None, None: None}
    got = {r.t: r.m and tuple(r.m) for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.money_of(F.col("t")).alias("m")).collect()}
    assert got == texts


def test_polarity_of_words_at_their_start_only(spark):
    texts = {"He shall not pay.": False, "They marshall not.": None, "It must pay.": True, "Limited to 5.": True, "no cap": False, "unlimited to": None}
    got = {r.t: r.b for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.polarity_of(F.col("t")).alias("b")).collect()}
    assert got == texts
