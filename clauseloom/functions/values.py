"""Predicates and formats over the typed value columns of the long table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clauseloom.functions.text import strip


def _first_set(pairs) -> Column:
    expr = None
    for cond, value in pairs:
        expr = F.when(cond, value) if expr is None else expr.when(cond, value)
    return expr


def value_kind(prefix: str = "") -> Column:
    """boolean, numeric, text, entity_list, monetary, temporal, unknown - in that order.

    Dates count as text because their exported form is a string.
    """
    c = lambda name: F.col(prefix + name)
    return _first_set([
        (c("v_bool").isNotNull(), "boolean"), (c("v_double").isNotNull(), "numeric"),
        (c("v_string").isNotNull() | c("v_date").isNotNull(), "text"),
        (c("v_parties").isNotNull(), "entity_list"), (c("v_amount").isNotNull(), "monetary"),
        (c("v_dur_amount").isNotNull(), "temporal")]).otherwise("unknown")


def is_usable(prefix: str = "") -> Column:
    """0 and false are usable; blank strings and lists of blanks are not."""
    c = lambda name: F.col(prefix + name)
    return F.coalesce(
        c("v_bool").isNotNull() | c("v_double").isNotNull() | c("v_date").isNotNull()
        | c("v_amount").isNotNull() | c("v_dur_amount").isNotNull()
        | F.coalesce(strip(c("v_currency")) != "", F.lit(False))
        | F.coalesce(strip(c("v_dur_unit")) != "", F.lit(False))
        | F.coalesce(strip(c("v_string")) != "", F.lit(False))
        | F.coalesce(F.exists(c("v_parties"), lambda p: strip(p) != ""), F.lit(False)), F.lit(False))


def is_graph_valid(prefix: str = "") -> Column:
    """Any non-empty list counts, an amount of 0 without a currency does not."""
    c = lambda name: F.col(prefix + name)
    return F.coalesce(
        c("v_bool").isNotNull() | c("v_double").isNotNull() | c("v_date").isNotNull()
        | F.coalesce(c("v_amount") != 0, F.lit(False)) | F.coalesce(c("v_currency") != "", F.lit(False))
        | F.coalesce(c("v_dur_amount") != 0, F.lit(False)) | F.coalesce(c("v_dur_unit") != "", F.lit(False))
        | F.coalesce(strip(c("v_string")) != "", F.lit(False))
        | F.coalesce(F.size(c("v_parties")) > 0, F.lit(False)), F.lit(False))


def coverage(vars_col: str = "vars") -> Column:
    """Share of schema variables with a value."""
    from clauseloom.operators.extraction import is_set

    n = F.size(vars_col)
    return F.when(n > 0, F.size(F.filter(vars_col, is_set)) / n).otherwise(0.0)


def _valid_struct(v: Column) -> Column:
    present = (
        v["b"].isNotNull() | v["d"].isNotNull() | v["dt"].isNotNull()
        | F.coalesce(v["amount"] != 0, F.lit(False)) | F.coalesce(v["currency"] != "", F.lit(False))
        | F.coalesce(v["dur_amount"] != 0, F.lit(False)) | F.coalesce(v["dur_unit"] != "", F.lit(False))
        | F.coalesce(strip(v["s"]) != "", F.lit(False)) | F.coalesce(F.size(v["parties"]) > 0, F.lit(False)))
    return F.coalesce(present, F.lit(False))


def valid_coverage(vars_col: str = "vars") -> Column:
    """Share of extracted variables that are valid for the graph."""
    n = F.size(vars_col)
    return F.when(n > 0, F.size(F.filter(vars_col, _valid_struct)) / n).otherwise(0.0)


def plain_number(value: Column) -> Column:
    """A double as its shortest text: 5.0 -> "5.0", 0.25 -> "0.25"."""
    return F.when(value == F.floor(value), F.format_string("%.1f", value)).otherwise(
        F.regexp_replace(F.format_string("%.10f", value), "0+$", ""))


def display_text(prefix: str = "", limit: int | None = None) -> Column:
    """Text of a value as shown on a graph node, or its first ``limit`` characters."""
    c = lambda name: F.col(prefix + name)
    text = _first_set([
        (c("v_bool").isNotNull(), F.when(c("v_bool"), "True").otherwise("False")),
        (c("v_double").isNotNull(), plain_number(c("v_double"))),
        (c("v_string").isNotNull(), c("v_string")),
        (c("v_date").isNotNull(), iso_timestamp(c("v_date"))),
        (c("v_parties").isNotNull(), F.array_join(c("v_parties"), ", ")),
        (c("v_amount").isNotNull(), F.concat(plain_number(c("v_amount")), F.lit(" "), c("v_currency"))),
        (c("v_dur_amount").isNotNull(), F.concat(c("v_dur_amount").cast("string"), F.lit(" "), c("v_dur_unit"))),
    ])
    return text if limit is None else F.substring(text, 1, limit)


def iso_timestamp(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd'T00:00:00.000Z'")
