"""What needs no template text does not make one."""

from clauseloom.operators import extraction as E
from clauseloom.operators import graph as G
from clauseloom.operators import templates as T

COLUMNS = "contract_id string, clause_seq long, clause_type string, text string"
ROWS = [("c", 3, "insurance", "Coverage of EUR 5,000.00 is mandatory."), ("c", 1, "insurance", "Coverage of EUR 5,000.00 is mandatory."),
        ("c", 2, "insurance", "Coverage of EUR 7.50 is mandatory."), ("d", 4, "insurance", "Nothing is said."),
        ("d", 5, "insurance", "EUR 9"), (None, 6, "insurance", "EUR 8")]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_edges_and_stages_make_no_template_text(spark):
    clauses = E.extract_contracts(spark.createDataFrame(ROWS, COLUMNS))
    keys = T.template_keys(clauses)
    tables = G.build(clauses, T.generate(clauses, keys=keys), keys=keys)
    marker = "{{/if}}"  # of the placeholders around a text
    assert marker in _plan(T.generate(clauses, keys=keys))
    for name in ("BASED_ON", "GENERATES", "USES_VARIABLES"):
        assert marker not in _plan(tables[name])
    assert {(r.from_id, r.to_id) for r in tables["BASED_ON"].collect()} == {("c_insurance-001", "c"), ("c_insurance-002", "c"), ("d_insurance", "d")}
    whole = G.build(clauses, T.generate(clauses))
    for name in ("GENERATES", "USES_VARIABLES", "Template"):
        assert sorted(map(str, tables[name].collect())) == sorted(map(str, whole[name].collect()))
    passing = T.passing(clauses)
    assert "Window" not in _plan(passing)
    assert {r.clause_seq for r in passing.collect()} == {r.clause_seq for r in keys.collect()} == {1, 2, 5}
