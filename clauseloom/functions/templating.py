"""Placeholder substitution and value texts for templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clauseloom.functions.values import iso_timestamp, plain_number

# Class names of exported typed values.
MONEY_CLASS = "org.accordproject.money.MonetaryAmount"
DURATION_CLASS = "org.accordproject.time.Duration"
PARTY_CLASS = "org.accordproject.organization.Organization"
JOIN_SEPARATOR = ' separator=" and "'

# Currency symbols where they differ from the code itself.
CURRENCY_SYMBOL = {
    "USD": "$", "EUR": "€", "GBP": "£", "JPY": "¥", "CNY": "¥", "RMB": "¥", "CAD": "$", "AUD": "$",
    "NZD": "$", "HKD": "$", "SGD": "$", "CHF": "CHF", "SEK": "kr", "NOK": "kr", "DKK": "kr", "PLN": "zł",
    "CZK": "Kč", "HUF": "Ft", "RUB": "₽", "INR": "₹", "KRW": "₩", "THB": "฿", "MYR": "RM", "IDR": "Rp",
    "PHP": "₱", "VND": "₫", "TRY": "₺", "ILS": "₪", "SAR": "﷼", "AED": "د.إ", "EGP": "£", "ZAR": "R",
    "NGN": "₦", "KES": "KSh", "GHS": "GH₵", "BWP": "P", "BRL": "R$", "ARS": "$", "CLP": "$", "COP": "$",
    "PEN": "S/", "MXN": "$", "GTQ": "Q", "CRC": "₡", "PAB": "B/.", "DOP": "RD$",
}
# Number words used in durations and counts.
NUMBER_WORDS = {
    1: "one", 2: "two", 3: "three", 4: "four", 5: "five", 6: "six", 7: "seven", 8: "eight", 9: "nine",
    10: "ten", 11: "eleven", 12: "twelve", 13: "thirteen", 14: "fourteen", 15: "fifteen", 16: "sixteen",
    17: "seventeen", 18: "eighteen", 19: "nineteen", 20: "twenty", 21: "twenty-one", 22: "twenty-two",
    23: "twenty-three", 24: "twenty-four", 25: "twenty-five", 30: "thirty", 31: "thirty-one",
    32: "thirty-two", 33: "thirty-three", 34: "thirty-four", 35: "thirty-five", 40: "forty",
    45: "forty-five", 48: "forty-eight", 50: "fifty", 60: "sixty", 90: "ninety", 100: "one hundred",
    120: "one hundred twenty", 365: "three hundred sixty-five",
}


def title_case(name: Column) -> Column:
    """Words split at underscores, first letters upper and the rest lower."""
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def heading(clause_type: Column) -> Column:
    return F.concat(F.lit("## "), title_case(clause_type))


def braces(*parts) -> Column:
    return F.concat(F.lit("{{"), *[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit("}}"))


def placeholder(name: Column, var_type: Column) -> Column:
    money = F.concat(braces(name, ".doubleValue"), F.lit(" "), braces(name, ".currencyCode"))
    duration = F.concat(braces(name, ".amount"), F.lit(" "), braces(name, ".unit"))
    join = F.concat(braces("#join ", name, JOIN_SEPARATOR), F.lit("{{partyId}}{{/join}}"))
    return (F.when(var_type == "MonetaryAmount", money).when(var_type == "Duration", duration)
            .when(var_type == "Party[]", join).otherwise(braces(name)))


def replace_first(text: Column, span: Column, by: Column) -> Column:
    """Replace the first occurrence; a span of digits never matches inside a longer number."""
    digits = span.rlike(r"^\d")
    at = F.when(digits, F.regexp_instr(text, F.concat(F.lit(r"(?<![\d.,])\Q"), span, F.lit(r"\E(?!\d)")))
                ).otherwise(F.call_function("instr", text, span))
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), by,
                                   F.substring(text, at + F.length(span), F.length(text)))).otherwise(text)


def first_form(text: Column, forms: Column) -> Column:
    """First of the candidate literals that the text contains, else null."""
    return F.get(F.filter(forms, lambda f: F.contains(text, f)), F.lit(0))


def party_forms(parties: Column) -> Column:
    """How a list of names may stand in a text: pairs first, then a single name."""
    a, b = F.get(parties, F.lit(0)), F.get(parties, F.lit(1))
    q = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    pairs = [F.concat_ws(" and ", q(a), q(b)), F.concat_ws(" and ", a, b), F.concat_ws(", ", q(a), q(b)), F.concat_ws(", ", a, b)]
    both = F.when(b.isNotNull(), F.array(*pairs)).otherwise(F.array().cast("array<string>"))
    single = F.flatten(F.transform(parties, lambda p: F.array(q(p), p)))
    return F.concat(both, single)


def date_forms(day: Column) -> Column:
    return F.array(*[F.date_format(day, f) for f in (
        "d 'day of' MMMM, yyyy", "MMMM d, yyyy", "MMMM d yyyy", "MMM d, yyyy", "yyyy-MM-dd", "M/d/yyyy", "MM/dd/yyyy")])


def _symbol(currency: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in CURRENCY_SYMBOL.items() for x in pair])
    return F.coalesce(table[currency], currency)


def money_forms(amount: Column, currency: Column) -> Column:
    """Symbol or code, thousands separators or none, cents or none; longest forms first."""
    grouped, cents = F.format_number(amount, 2), F.format_string("%.2f", amount)
    whole = amount == F.floor(amount)
    numbers = F.filter(F.array(
        grouped, cents, F.when(whole, F.format_number(amount, 0)), F.when(whole, F.format_string("%d", amount.cast("bigint")))),
        lambda n: n.isNotNull())
    symbol = _symbol(currency)
    styles = F.transform(numbers, lambda n: F.array(
        F.concat(F.lit('"'), symbol, n, F.lit('"')), F.concat(symbol, n), F.concat(currency, F.lit(" "), n),
        F.concat(n, F.lit(" "), currency)))
    return F.flatten(styles)


def number_forms(value: Column) -> Column:
    """A fraction as percentage first, then the number itself and its word."""
    words = F.create_map(*[F.lit(x) for pair in NUMBER_WORDS.items() for x in pair])
    percent = F.regexp_replace(F.format_string("%.4f", value * 100), r"\.?0+$", "")
    whole = value == F.floor(value)
    as_int = F.format_string("%d", value.cast("bigint"))
    forms = F.array(
        F.when((value > 0) & (value <= 1), F.concat(percent, F.lit(" percent"))),
        F.when((value > 0) & (value <= 1), F.concat(percent, F.lit("%"))),
        F.when(whole, F.concat(words[value.cast("int")], F.lit(" ("), as_int, F.lit(")"))),
        plain_number(value), F.when(whole, as_int), F.when(whole, words[value.cast("int")]))
    return F.filter(forms, lambda f: f.isNotNull())


def duration_pattern(amount: Column, unit: Column) -> Column:
    """One alternation for "ten (10) years", "10 years", "10-year", "ten years"."""
    words = F.create_map(*[F.lit(x) for pair in NUMBER_WORDS.items() for x in pair])
    number = amount.cast("string")
    word = F.coalesce(words[amount], number)
    stem = F.regexp_replace(F.lower(unit), "s$", "")
    return F.concat(F.lit(r"(?i)(?<!\d)(?:"), word, F.lit(r" \("), number, F.lit(r"\)|\("), number, F.lit(r"\)|"), number,
                    F.lit("|"), word, F.lit(r")[ -]"), stem, F.lit("s?"))


def string_forms(value: Column) -> Column:
    wrap = lambda a, b: F.concat(F.lit(a), value, F.lit(b))
    return F.array(wrap('"', '"'), wrap("'", "'"), wrap("(", ")"), wrap(" ", " "), value)


def json_value(v: Column) -> Column:
    """Typed value of a variable struct as JSON text, null when unset."""
    quote = lambda x: F.concat(F.lit('"'), F.regexp_replace(x, r'(["\\])', r"\\$1"), F.lit('"'))
    money = F.concat(F.lit(f'{{"$class":"{MONEY_CLASS}","doubleValue":'), plain_number(v["amount"]),
                     F.lit(',"currencyCode":'), quote(v["currency"]), F.lit("}"))
    duration = F.concat(F.lit(f'{{"$class":"{DURATION_CLASS}","amount":'), v["dur_amount"].cast("string"),
                        F.lit(',"unit":'), quote(v["dur_unit"]), F.lit("}"))
    names = F.transform(v["parties"], lambda p: F.concat(F.lit(f'{{"$class":"{PARTY_CLASS}","partyId":'), quote(p), F.lit("}")))
    return (F.when(v["b"].isNotNull(), v["b"].cast("string")).when(v["d"].isNotNull(), plain_number(v["d"]))
            .when(v["s"].isNotNull(), quote(v["s"])).when(v["dt"].isNotNull(), quote(iso_timestamp(v["dt"])))
            .when(v["amount"].isNotNull(), money).when(v["dur_amount"].isNotNull(), duration)
            .when(F.size(v["parties"]) > 0, F.concat(F.lit("["), F.array_join(names, ","), F.lit("]"))))


def sample_value(v: Column) -> Column:
    """Value of a variable struct as shown in a sample text."""
    whole = F.format_string("%d", v["d"].cast("bigint"))
    return (F.when(v["b"].isNotNull(), F.when(v["b"], "yes").otherwise("no"))
            .when(v["d"].isNotNull(), F.when(v["d"] == F.floor(v["d"]), whole).otherwise(plain_number(v["d"])))
            .when(v["s"].isNotNull(), F.concat(F.lit('"'), v["s"], F.lit('"')))
            .when(v["dt"].isNotNull(), iso_timestamp(v["dt"]))
            .when(v["amount"].isNotNull(), F.concat(plain_number(v["amount"]), F.lit(" "), v["currency"]))
            .when(v["dur_amount"].isNotNull(), F.concat(v["dur_amount"].cast("string"), F.lit(" "), v["dur_unit"]))
            .when(v["parties"].isNotNull(), F.concat(F.lit('"'), F.array_join(v["parties"], '" and "'), F.lit('"'))))
