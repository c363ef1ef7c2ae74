"""The record of a run: one figure a row, each stage table read once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.operators.extraction import is_set
from clauseloom.session import stored

TOP = 10


def _rows(frame: DataFrame, section: str, figures: dict[str, Column], category: Column | None = None) -> DataFrame:
    named = F.array(*[F.struct(F.lit(n).alias("metric"), v.cast("double").alias("value")) for n, v in figures.items()])
    label = F.lit(None).cast("string") if category is None else category.cast("string")
    return frame.select(F.lit(section).alias("section"), label.alias("category"), F.explode(named).alias("f")).select(
        "section", "f.metric", "category", "f.value")


def _rate(part: Column, whole: Column) -> Column:
    return F.round(part / F.greatest(whole, F.lit(1)), 6)


def run_record(clauses: DataFrame, states: DataFrame, transitions: DataFrame, summary: DataFrame,
               completion: DataFrame) -> DataFrame:
    """section, metric, category, value.

    ``clauses`` are extracted clauses with ``vars``, ``summary`` the machine validation,
    ``completion`` has is_complete per contract.  Rates of empty tables are 0; the ten most
    common types and states go by count, then name.
    """
    given = F.filter("vars", is_set)
    per_type = stored(clauses.select(
        "contract_id", "clause_type", F.size("vars").alias("v"), F.size(given).alias("s"),
        F.exists("vars", lambda x: F.coalesce(F.size(x["parties"]) > 0, F.lit(False))).alias("p")
    ).groupBy("contract_id", "clause_type").agg(
        F.count("*").alias("n"), F.sum("v").alias("v"), F.sum("s").alias("s"), F.max("p").alias("p")), "per_type")
    per_contract = per_type.groupBy("contract_id").agg(
        *[F.sum(c).alias(c) for c in ("n", "v", "s")], F.max("p").alias("p"))
    whole = per_contract.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v", "s")],
                             F.count("*").alias("contracts"), F.count_if("p").alias("named"))
    types = per_type.groupBy("clause_type").agg(F.sum("n").alias("n"), F.sum("v").alias("v"), F.sum("s").alias("s"))
    by_name = stored(states.groupBy("name", "category").agg(
        F.count("*").alias("n"), F.count_if(F.col("confidence") > 0.8).alias("high")), "state_counts")
    names = by_name.groupBy("name").agg(F.sum("n").alias("n"))
    common = lambda frame, name: frame.orderBy(F.desc("n"), name).limit(TOP)
    machines = summary.agg(F.count("*").alias("m"), F.count_if("is_valid").alias("valid"),
                           F.count_if(F.col("n_warnings") > 0).alias("warned"), F.count_if("passes_gate").alias("gated"))
    confident = by_name.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("high"), F.lit(0)).alias("high"))
    moves = transitions.agg(F.count("*").alias("moves"))
    done = completion.agg(F.count("*").alias("c"), F.count_if("is_complete").alias("done"))
    c = F.col
    parts = [
        _rows(whole, "extraction", {
            "clauses": c("n"), "contracts": c("contracts"), "variables": c("v"), "values": c("s"),
            "success_rate": _rate(c("s"), c("v")), "party_rate": _rate(c("named"), c("contracts"))}),
        _rows(types, "clause_type", {"clauses": c("n"), "success_rate": _rate(c("s"), c("v"))}, c("clause_type")),
        _rows(common(types, "clause_type"), "most_common", {"clause_type": c("n")}, c("clause_type")),
        _rows(machines.crossJoin(confident).crossJoin(moves), "lifecycle", {
            "machines": c("m"), "states": c("n"), "transitions": c("moves"), "pass_rate": _rate(c("valid"), c("m")),
            "gate_rate": _rate(c("gated"), c("m")), "warning_rate": _rate(c("warned"), c("m")),
            "high_confidence_rate": _rate(c("high"), c("n")), "states_per_machine": _rate(c("n"), c("m")),
            "transitions_per_machine": _rate(c("moves"), c("m"))}),
        _rows(common(names, "name"), "most_common", {"state": c("n")}, c("name")),
        _rows(by_name.groupBy("category").agg(F.sum("n").alias("n")), "state_category", {"states": c("n")}, c("category")),
        _rows(done, "integration", {"complete": c("done"), "success_rate": _rate(c("done"), c("c"))}),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
