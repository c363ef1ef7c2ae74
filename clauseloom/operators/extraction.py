"""Typed variable extraction over a clause table.

All variables of a clause are computed in one row, so the consistency rules that
relate variables of the same clause need no shuffle; the long form is an explode.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseloom import lookups
from clauseloom.functions import parties as P
from clauseloom.functions import typed as X
from clauseloom.session import dealt

DURATION_UNITS = ["days", "weeks", "months", "years"]
LONG_VALUES = [
    "v_string", "v_bool", "v_double", "v_date", "v_amount", "v_currency",
    "v_dur_amount", "v_dur_unit", "v_parties",
]


def _needs(var_type: str) -> str:
    return f"_needs_{var_type}"


def with_schema(clauses: DataFrame, kinds: Sequence[str] = ()) -> DataFrame:
    """Attach the array of variables to extract; clause types without a schema drop out.

    ``kinds`` of value add a flag each, looked up once per clause type and not per clause.
    """
    def holds(kind: str) -> Column:
        return F.exists("schema_vars", lambda v: v["var_type"] == kind).alias(_needs(kind))

    schema = (
        lookups.schema_frame(clauses.sparkSession)
        .groupBy("clause_type")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "var_name", "var_type", "deniers"))).alias("schema_vars"))
        .select("*", *map(holds, kinds))
    )
    # The schema frame is the fixed table of 41 clause types, hence the broadcast.
    return clauses.join(F.broadcast(schema), "clause_type")


def clause_variables(clauses: DataFrame) -> DataFrame:
    """One row per clause and schema variable to extract, before any value is read."""
    return with_schema(clauses).select(
        "*", F.explode("schema_vars").alias("sv")).select(
        *clauses.columns, F.col("sv.var_name"), F.col("sv.var_type"), F.col("sv.pos"))


def _rule_for(var: Column, all_vars: Column, text: Column) -> Column:
    """Name of the first consistency rule that clears this value, else null."""
    denied = F.exists(all_vars, lambda h: F.array_contains(var["deniers"], h["var_name"]) & ~h["b"])
    amount, unit = var["amount"], F.lower(var["dur_unit"])
    return (
        F.when((F.size(var["deniers"]) > 0) & denied, "denied_by_has")
        .when((amount > 5e8) & ~X.mentions_large_amount(amount, text), "unsupported_large_amount")
        .when(var["d"].isNotNull() & F.contains(F.lower(var["var_name"]), F.lit("percentage"))
              & ~X.supports_percentage(var["d"], text), "unsupported_percentage")
        .when(unit.isNotNull() & ~unit.isin(DURATION_UNITS), "unknown_unit")
        .when((amount <= 0) | (amount > 1e12), "amount_out_of_range")
    )


VALUE_TYPES = {
    "s": "string", "b": "boolean", "d": "double", "dt": "date", "amount": "double", "currency": "string",
    "dur_amount": "int", "dur_unit": "string", "parties": "array<string>", "span": "string",
}
VALUE_FIELDS = list(VALUE_TYPES)
VALUE_KINDS = ["DateTime", "MonetaryAmount", "Duration", "Double", "Boolean", "Party[]"]


def _with_rule(var: Column, rule: Column) -> Column:
    return F.struct(*[var[f].alias(f) for f in ("pos", "var_name", "var_type", *VALUE_FIELDS)],
                    rule.alias("nulled_by"))


def _cleared(var: Column) -> Column:
    return F.when(var["nulled_by"].isNull(), var).otherwise(F.struct(
        *[var[f].alias(f) for f in ("pos", "var_name", "var_type")], *_values({}), var["nulled_by"].alias("nulled_by")))


def _values(known: dict[str, Column]) -> list[Column]:
    """The value fields of a variable, null but for the known ones."""
    return [known.get(f, F.lit(None)).cast(t).alias(f) for f, t in VALUE_TYPES.items()]


def _extractor_columns(response: str | None) -> dict[str, Column]:
    """One column per kind of value, evaluated only for clauses whose schema has that kind."""
    text = F.col("text")

    def needs(var_type):
        return F.col(_needs(var_type))

    return {
        "x_date": F.when(needs("DateTime"), X.date_of(text)),
        "x_money": F.when(needs("MonetaryAmount"), X.money_of(text)),
        "x_dur": F.when(needs("Duration"), X.duration_of(text)),
        "x_num": X.double_of(F.col("num_text")),
        "x_bool": F.when(needs("Boolean"), X.polarity_of(text)),
        "x_parties": F.when(needs("Party[]"), P.parties_of(text, F.col(response) if response else None)),
    }


def extract_raw(clauses: DataFrame, response: str | None = None) -> DataFrame:
    """Pattern extraction: adds ``raw_vars``, one typed struct per schema variable.

    ``response`` names an optional string column with a model answer for parties.
    """
    # A column of its own: the extractor reads its text many times, and would look up the schema each time.
    of_number = F.when(F.col(_needs("Double")), F.col("text"))
    found = with_schema(clauses, VALUE_KINDS).withColumn("num_text", of_number).withColumns(_extractor_columns(response))
    known = {
        "Boolean": {"b": F.col("x_bool")}, "Double": {"d": F.col("x_num.value"), "span": F.col("x_num.span")},
        "DateTime": {"dt": F.col("x_date.dt"), "span": F.col("x_date.span")},
        "MonetaryAmount": {f: F.col(f"x_money.{f}") for f in ("amount", "currency", "span")},
        "Duration": {"dur_amount": F.col("x_dur.amount"), "dur_unit": F.col("x_dur.unit"), "span": F.col("x_dur.span")},
        "Party[]": {"parties": F.col("x_parties")},
    }

    def typed(v: Column) -> Column:
        """The kind is asked for once per variable, and not once per field."""
        def filled(values):
            return F.struct(*[v[f].alias(f) for f in ("pos", "var_name", "var_type", "deniers")], *_values(values))

        out = F.when(v["var_type"] == VALUE_KINDS[0], filled(known[VALUE_KINDS[0]]))
        for kind in VALUE_KINDS[1:]:
            out = out.when(v["var_type"] == kind, filled(known[kind]))
        return out.otherwise(filled({}))

    return found.withColumn("raw_vars", F.transform("schema_vars", typed)).drop(
        "x_date", "x_money", "x_dur", "x_num", "x_bool", "x_parties", "num_text", "schema_vars", *map(_needs, VALUE_KINDS))


def apply_rules(extracted: DataFrame) -> DataFrame:
    """Replace ``raw_vars`` by ``vars`` with the consistency rules applied.

    Two transforms, so that a rule is evaluated once per variable and not once per field.
    """
    raw, text = F.col("raw_vars"), F.col("text")
    ruled = F.transform(raw, lambda v: _with_rule(v, _rule_for(v, raw, text)))
    return extracted.withColumn("vars", F.transform(ruled, _cleared)).drop("raw_vars")


def is_set(v: Column) -> Column:
    return (v["s"].isNotNull() | v["b"].isNotNull() | v["d"].isNotNull() | v["dt"].isNotNull()
            | v["amount"].isNotNull() | v["dur_amount"].isNotNull() | v["parties"].isNotNull())


def with_values(ruled: DataFrame) -> DataFrame:
    """Clause rows with at least one value.

    The drop is written as an explode of a one-element array: a plain filter would be
    pushed below the projections and evaluate every pattern a second time.
    """
    rest = [c for c in ruled.columns if c != "vars"]
    kept = F.filter(F.array(F.col("vars")), lambda vs: F.exists(vs, is_set))
    return ruled.select(*rest, F.explode(kept).alias("vars"))


def extract_clauses(clauses: DataFrame) -> DataFrame:
    """clause rows -> clause rows with ``vars``; clauses without any value drop out."""
    return with_values(apply_rules(extract_raw(clauses)))


def to_long(extracted: DataFrame) -> DataFrame:
    """One row per clause and schema variable, nulls kept."""
    keep = [c for c in extracted.columns if c != "vars"]
    return extracted.select(*keep, F.explode_outer("vars").alias("v")).select(
        *keep, F.col("v.var_name"), F.col("v.var_type"), F.col("v.pos").alias("var_pos"),
        F.col("v.s").alias("v_string"), F.col("v.b").alias("v_bool"), F.col("v.d").alias("v_double"),
        F.col("v.dt").alias("v_date"), F.col("v.amount").alias("v_amount"),
        F.col("v.currency").alias("v_currency"), F.col("v.dur_amount").alias("v_dur_amount"),
        F.col("v.dur_unit").alias("v_dur_unit"), F.col("v.parties").alias("v_parties"),
        F.col("v.span"), F.col("v.nulled_by"), is_set(F.col("v")).alias("is_set"))


def dedup_clauses(extracted: DataFrame, prefix: int | None = None) -> DataFrame:
    """First clause wins per contract, type and text, or the first ``prefix`` characters of it.

    ``row_number() = 1`` is cut on the map side (WindowGroupLimit), so a group of
    copies that holds much of the data never meets in one task.
    """
    same = F.col("text") if prefix is None else F.substring("text", 1, prefix)
    first = Window.partitionBy("contract_id", "clause_type", F.sha2(same, 256)).orderBy("clause_seq")
    return extracted.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")


def distinct_clauses(clauses: DataFrame) -> DataFrame:
    """``dedup_clauses``; rows of contract, type, text and number alone take a partial aggregate and no sort."""
    same = ["contract_id", "clause_type", "text"]
    if sorted(clauses.columns) != sorted([*same, "clause_seq"]):
        return dedup_clauses(clauses)
    # A clause without a number comes first, as in the order of ``dedup_clauses``.
    first = F.when(F.count("*") == F.count("clause_seq"), F.min("clause_seq")).alias("clause_seq")
    return clauses.groupBy(*same).agg(first).select(*clauses.columns)


def contract_coverage(clauses: DataFrame) -> DataFrame:
    return clauses.groupBy("contract_id", "clause_type").agg(F.count("*").alias("n_clauses"))


def score_contracts(coverage: DataFrame) -> DataFrame:
    """15 per type + clauses + 5 from ten types on; contracts with one type drop out."""
    return (
        coverage.groupBy("contract_id")
        .agg(F.count("*").alias("num_types"), F.sum("n_clauses").alias("total_clauses"))
        .where("num_types > 1")
        .withColumn("score", F.col("num_types") * 15 + F.col("total_clauses")
                    + F.when(F.col("num_types") >= 10, 5).otherwise(0))
    )


def select_contracts(coverage: DataFrame, n: int) -> DataFrame:
    return score_contracts(coverage).orderBy(F.desc("score"), "contract_id").limit(n)


def fallback_parties(clauses: DataFrame, longer_than: int = 0, named: DataFrame | None = None) -> DataFrame:
    """Party rows for contracts without a parties clause, read from their longest context.

    ``clauses`` needs contract_id, clause_type, clause_seq and context; ``named`` holds the
    contract_id of contracts whose parties are known, unset those with a parties clause.
    The winner is chosen on lengths and numbers alone; its text is joined back, so no
    aggregate buffer holds texts, however many clauses a contract has.
    """
    order = F.create_map(*[F.lit(x) for pair in lookups.type_positions().items() for x in pair])
    have = clauses.where("clause_type = 'parties'").select("contract_id").distinct() if named is None else named
    longest = F.struct(F.length("context").alias("col1"), (-order[F.col("clause_type")]).alias("col2"),
                       (-F.col("clause_seq")).alias("col3"))
    usable = clauses.where((F.col("clause_type") != "parties") & (F.length("context") > longer_than))
    best = (
        usable.groupBy("contract_id").agg(F.max(longest).alias("w")).join(have, "contract_id", "left_anti")
        .select("contract_id", F.element_at(F.array(*map(F.lit, sorted(lookups.type_positions(), key=lookups.type_positions().get))),
                                            (1 - F.col("w.col2")).cast("int")).alias("clause_type"),
                (-F.col("w.col3")).alias("clause_seq"))
        .join(usable, ["contract_id", "clause_type", "clause_seq"])
    )
    best = dealt(best, "contract_id")  # a row per contract, to be read by many patterns
    # An explode of at most one element rather than a filter, which would find the parties a second time.
    parties = F.filter(F.array(P.parties_of(F.col("context"))), lambda p: F.size(p) >= 1)
    return best.select(
        "contract_id", F.lit("parties").alias("clause_type"), "clause_seq", F.explode(parties).alias("parties"),
        F.col("context").alias("original_text"), F.col("clause_type").alias("source_clause"))


def extract_contracts(clauses: DataFrame, max_contracts: int | None = None) -> DataFrame:
    """The end-to-end extraction: select contracts, drop repeats, extract, apply rules.

    Repeats have equal values or none, so the rows are those of a drop afterwards; it is made
    before, while rows are narrow and no pattern has run.
    """
    if max_contracts is not None:
        chosen = select_contracts(contract_coverage(clauses), max_contracts).select("contract_id")
        clauses = clauses.join(chosen, "contract_id", "left_semi")
    return extract_clauses(dealt(distinct_clauses(clauses), "clause_seq"))
