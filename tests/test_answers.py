"""Extraction with a model: every part of a text is asked about, equal texts once."""

from clauseloom.operators import answers as A
from clauseloom.operators import extraction as E
from clauseloom.operators import lifecycle as L

CLAUSES = "contract_id string, clause_type string, clause_seq long, context string, answer_text string"


def test_windows_cover_whole_texts(spark):
    texts = ["", "short", "a" * 1000, "b" * 1001, "".join(chr(97 + i % 26) for i in range(5003)), None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {}
    for r in A.windows(rows, "t", 1000, 200).collect():
        got.setdefault(r.id, []).append((r.window, r.window_text))
    assert 5 not in got
    for i, text in enumerate(texts[:5]):
        parts = [p for _, p in sorted(got[i])]
        assert parts[0] + "".join(p[200:] for p in parts[1:]) == text
        assert all(len(p) > 200 for p in parts[1:])


def _scorer(asked):
    def run(batches):
        for b in batches:
            asked.add(len(b))
            law = b["cache_key"].str.contains("governingLaw") & b["prompt"].str.contains("laws of Ohio")
            yield b.assign(response=["laws of Ohio" if x else "null" for x in law])[["cache_key", "response"]]
    return run


def test_copies_are_asked_once_and_a_second_run_asks_nothing(spark):
    late = "Both sides agree to what follows here. " * 60 + "Governed by the laws of Ohio."
    recital = "x" * 600 + " This Agreement is made by and between Acme Trading Corporation and Zeta Supply Corporation WHEREAS both agree."
    rows = [(f"C{i}", "governing_law", i, None, late) for i in range(60)]
    rows += [("C1", "governing_law", 1000, None, late), ("C2", "governing_law", 1001, None, None),
             ("C3", "governing_law", 1002, "", ""), ("C4", "parties", 1003, "No side is named.", None),
             ("C4", "audit_rights", 1004, recital, "null"), (None, "governing_law", 1005, late, None)]
    clauses = spark.createDataFrame(rows, CLAUSES)
    asked = spark.sparkContext.accumulator(0)
    found, fresh = A.extract_with_model(clauses, _scorer(asked))
    long = E.to_long(found)
    laws = long.where("var_name = 'governingLaw'").collect()
    assert {(r.contract_id, r.clause_seq) for r in laws} == {(f"C{i}", i) for i in range(60)} | {(None, 1005)}
    assert {r.v_string for r in laws} == {"laws of Ohio"}
    named = long.where("var_type = 'Party[]'").collect()
    assert [(r.contract_id, r.source_clause, r.v_parties) for r in named] == [
        ("C4", "audit_rights", ["Acme Trading Corporation", "Zeta Supply Corporation"])]
    n_asked = asked.value
    # three windows of the long text by two variables (equal windows share a prompt), and the parties clause
    assert n_asked == fresh.count() <= 9
    again, none = A.extract_with_model(clauses, _scorer(asked), cache=fresh)
    assert none.count() == 0 and asked.value == n_asked and again.count() == found.count()


def test_empty_clauses(spark):
    found, fresh = A.extract_with_model(spark.createDataFrame([], CLAUSES), _scorer(spark.sparkContext.accumulator(0)))
    assert found.count() == 0 and fresh.count() == 0 and "source_clause" in found.columns


def test_structure_gate(spark):
    states = spark.createDataFrame(
        [("a", n) for n in ("draft", "active", "terminated", "draft")] + [("b", "draft"), (None, "active"), ("c", None)], "machine string, name string")
    moves = spark.createDataFrame(
        [("a", "draft", "active", t) for t in ("sign", "sign", "execute")] + [("a", "active", "terminated", "end"), ("z", "x", "y", "t"), (None, "active", "active", "t")],
        "machine string, source string, target string, trigger string")
    got = {r.machine: (r.missing_states, r.n_transitions, r.passes) for r in L.structure_gate(states, moves).collect()}
    assert got == {"a": ([], 3, True), "b": (["active", "terminated"], 0, False), None: (["draft", "terminated"], 1, False),
                   "c": (["draft", "active", "terminated"], 0, False)}
    assert L.structure_gate(states.limit(0), moves).count() == 0
