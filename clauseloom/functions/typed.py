"""Typed extraction from clause text: dates, money, durations, numbers, polarity.

Every extractor tries its patterns in order, looks at the first match of each,
and moves on when that match is no valid value.  Each returns a struct with the
value and ``span``, the text that matched, or null.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clauseloom.functions.text import any_of, once, rx

# Date patterns (ISO, month-first, month name, ordinal day).
DATE_PATTERNS = [
    r"\b(\d{4})-(\d{1,2})-(\d{1,2})\b",
    r"\b(\d{1,2})[/-](\d{1,2})[/-](\d{4})\b",
    r"\b([A-Za-z]+)\s+(\d{1,2}),?\s+(\d{4})\b",
    r"\b(\d{1,2})(?:st|nd|rd|th)\s+(?:day\s+of\s+)?([A-Za-z]+),?\s+(\d{4})\b",
]
# Group numbers of (year, month, day) in each date pattern.
DATE_GROUPS = [(1, 2, 3), (3, 1, 2), (3, 1, 2), (3, 2, 1)]
MONTHS = [
    "january", "february", "march", "april", "may", "june", "july",
    "august", "september", "october", "november", "december",
]

# Money patterns, multipliers and the currency they imply.
# A number in a token of letters and digits ("c298c25511b") is no amount unless a short word such as a
# currency code precedes it; nor is one after a run of currency signs ("$$$ 170.116.163.254"), which is noise.
AMOUNT = r"(\d+(?:,\d{3})*(?:\.\d{1,2})?)"
STANDALONE = r"(?:(?<![\p{L}\d])|(?<=\b\p{L}{1,3}))"
DOLLAR, EURO, POUND = (rf"(?<!{sign}){sign}" for sign in (r"\$", "€", "£"))
UNITS = r"(MM|M|B|K|million|billion|thousand)"
MONEY_PATTERNS = [
    rf"(?:{DOLLAR}|USD)\s*{AMOUNT}(?:\s*{UNITS}\b)?",
    rf"{STANDALONE}{AMOUNT}\s*{UNITS}\b",
    rf"(?:{DOLLAR}|USD)\s*{AMOUNT}",
    rf"{STANDALONE}{AMOUNT}\s*(?:dollars?|USD)",
    rf"(?:{EURO}|EUR)\s*{AMOUNT}",
    rf"{STANDALONE}{AMOUNT}\s*(?:€|EUR)",
    rf"(?:{POUND}|GBP)\s*{AMOUNT}",
    rf"{STANDALONE}{AMOUNT}\s*(?:£|GBP)",
]
MULTIPLIERS = {
    "hundred": 100.0, "thousand": 1e3, "k": 1e3, "million": 1e6, "m": 1e6, "mm": 1e6,
    "billion": 1e9, "b": 1e9,
}

# Number words accepted in durations, and the duration patterns.
DURATION_WORDS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8,
    "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "twenty": 20, "thirty": 30, "forty": 40,
    "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90, "hundred": 100,
}
_SMALL = "one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve"
DURATION_PATTERNS = [
    rf"(?:(?:{_SMALL})\s*\(\d+\)\s+(?:additional\s+)?)?(?:{_SMALL})\s*\((\d+)\)\s+(year|month|week|day)s?",
    r"(\d+)\s+(?:calendar\s+)?(days?|weeks?|months?|years?)",
    rf"\b({'|'.join(DURATION_WORDS)})\s+(days?|weeks?|months?|years?)\b",
    r"(\d+)-(day|week|month|year)",
]

# Percent patterns, and the reference forms that disqualify a match.
PERCENT_PATTERNS = [
    r"(\d+(?:\.\d+)?)\s*%",
    r"(\d+(?:\.\d+)?)\s+percent(?:\s|\b)",
    r"(\d+(?:\.\d+)?)\s+per\s+cent(?:\s|\b)",
    r"(?:percent|per\s+cent)\s*\((\d+(?:\.\d+)?)\s*%\)",
    r"\((\d+(?:\.\d+)?)\s*%\)\s*(?:percent|per\s+cent)",
    r"(?:percent|per\s+cent)\s*\((\d+(?:\.\d+)?)\)",
]
PERCENT_BLOCKERS = [
    r"section\s+\d+(?:\.\d+)*", r"clause\s+\d+(?:\.\d+)*", r"paragraph\s+\d+(?:\.\d+)*",
    r"article\s+\d+(?:\.\d+)*", r"subsection\s+\d+(?:\.\d+)*", r"\d+\.\d+\([a-z]\)",
    r"exhibit\s+[a-z0-9]+", r"schedule\s+[a-z0-9]+", r"appendix\s+[a-z0-9]+",
]
PERCENT_WINDOW, PERCENT_NEAR = 50, 10

# Texts with no standalone integer, and words that must not be near one.
INTEGER_BLOCKERS = [
    r"\d+[/-]\d+[/-]\d+", r"[\$€£]\d+", r"\d+\s*%", r"section\s+\d+", r"clause\s+\d+",
    r"paragraph\s+\d+", r"article\s+\d+", r"exhibit\s+\d+", r"schedule\s+\d+", r"table\s+\d+",
    r"\d+\.\d+\([a-z]\)",
]
INTEGER_REFERENCE_WORDS = [
    "section", "clause", "paragraph", "article", "exhibit", "schedule", "table", "appendix",
    "subsection", "part", "chapter",
]
INTEGER_WINDOW = 30

# Polarity patterns, negative ones first.
NEGATIVE_PATTERNS = [
    r"\bshall\s+not\b",
    r"\bmay\s+not\b",
    r"\bcannot\b",
    r"\bis\s+not\s+(?:required|applicable|permitted|subject)\b",
    r"\bno\s+(?:such|liability|cap|obligation|restrictions?)\b",
    r"\bexcluded\b",
    r"\bprohibited\b",
    r"\bnot\s+subject\s+to\b",
    r"\bexempt\s+from\b",
    r"\bdoes\s+not\s+(?:apply|exist|have|contain|include)\b",
    r"\bwithout\s+(?:any\s+)?(?:liability|obligation|restriction)\b",
    r"\bno\s+(?:minimum|maximum|limit|cap|restriction)\b",
]
POSITIVE_PATTERNS = [
    r"\bshall\s+(?:be\s+)?(?:required|subject|liable|apply|have|contain|include)\b",
    r"\bmust\s+(?:be\s+|have\s+|contain\s+|include\s+)?\w+",
    r"\bis\s+required\s+to\b",
    r"\bmandatory\b",
    r"\bobligated\s+to\b",
    r"\bsubject\s+to\b",
    r"\bliable\s+for\b",
    r"\bapplies\s+to\b",
    r"\bin\s+effect\b",
    r"\benforceable\b",
    r"\bshall\s+(?:not\s+)?exceed\b",
    r"\bmaximum\s+(?:of\s+)?\$",
    r"\bminimum\s+(?:of\s+)?\$",
    r"\bmust\s+not\s+exceed\b",
    r"\bcannot\s+exceed\b",
    r"\blimited\s+to\b",
]

# Currency codes in detection order, then symbols.
CURRENCY_CODES = [
    "USD", "EUR", "GBP", "JPY", "CNY", "RMB", "CAD", "AUD", "NZD", "HKD", "SGD", "CHF", "SEK", "NOK", "DKK", "PLN",
    "CZK", "HUF", "RUB", "INR", "KRW", "THB", "MYR", "IDR", "PHP", "VND", "TRY", "ILS", "SAR", "AED", "EGP", "ZAR",
    "NGN", "KES", "GHS", "BWP", "BRL", "ARS", "CLP", "COP", "PEN", "MXN", "GTQ", "CRC", "PAB", "DOP",
]
CURRENCY_SYMBOLS = [
    (r"\$", "USD"), ("€", "EUR"), ("£", "GBP"), ("¥", "JPY"), ("₹", "INR"), ("₽", "RUB"),
    ("₩", "KRW"), ("₪", "ILS"), ("₺", "TRY"), ("₦", "NGN"), ("₫", "VND"), ("₱", "PHP"),
    ("฿", "THB"), (r"R\b", "ZAR"), (r"R\$", "BRL"),
]


def _literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _month_number(name: Column) -> Column:
    numbers = {m: str(i) for i, m in enumerate(MONTHS, 1)}
    numbers.update({m[:3]: str(i) for i, m in enumerate(MONTHS, 1)})
    return _literal_map(numbers)[F.lower(name)]


def date_of(text: Column) -> Column:
    """struct<dt date, span string>"""
    tries = []
    for i, (pattern, (y, m, d)) in enumerate(zip(DATE_PATTERNS, DATE_GROUPS)):
        p = rx(pattern)
        month = F.regexp_extract(text, p, m)
        if i >= 2:
            month = _month_number(month)
        value = F.try_to_date(
            F.concat_ws("-", F.regexp_extract(text, p, y), month, F.regexp_extract(text, p, d)), "yyyy-M-d")
        # Only what matches is read as a date: a failed reading costs far more than a failed match.
        tries.append(F.when(text.rlike(p), once(value, lambda v: F.when(v.isNotNull(), F.struct(
            v.alias("dt"), F.regexp_extract(text, p, 0).alias("span"))))))
    return F.when(text.rlike(r"\d{4}"), F.coalesce(*tries))


def _money(amount: Column):
    """The amount with the currency that its span names, as a function of the span."""
    def of(span: Column) -> Column:
        upper = F.upper(span)
        currency = F.when(upper.rlike("€|EUR"), "EUR").when(upper.rlike("£|GBP"), "GBP").otherwise("USD")
        return F.struct(F.bround(amount, 2).alias("amount"), currency.alias("currency"), span.alias("span"))

    return of


def money_of(text: Column) -> Column:
    """struct<amount double, currency string, span string>"""
    expr = None
    for i, pattern in enumerate(MONEY_PATTERNS):
        p = rx(pattern)
        number = F.regexp_replace(F.regexp_extract(text, p, 1), ",", "")
        # Digits of other scripts are no double, and are read by the dearer format.
        amount = F.coalesce(number.try_cast("double"), F.try_to_number(number, F.lit("999999999999999999999D99")).cast("double"))
        if i <= 1:
            unit = F.lower(F.regexp_extract(text, p, 2))
            amount = amount * F.when(unit == "", 1.0).otherwise(F.coalesce(_literal_map(MULTIPLIERS)[unit], F.lit(1.0)))
        cond, found = text.rlike(p), once(F.regexp_extract(text, p, 0), _money(amount))
        expr = F.when(cond, found) if expr is None else expr.when(cond, found)
    return F.when(text.rlike(r"\d"), expr)


def duration_of(text: Column) -> Column:
    """struct<amount int, unit string, span string>"""
    tries = []
    for i, pattern in enumerate(DURATION_PATTERNS):
        p = rx(pattern)
        raw = F.regexp_extract(text, p, 1)
        amount = _literal_map(DURATION_WORDS)[F.lower(raw)] if i == 2 else raw.try_cast("int")
        unit = F.concat(F.initcap(F.regexp_replace(F.regexp_extract(text, p, 2), "(?i)s$", "")), F.lit("s"))
        found = F.when(amount.isNotNull(), F.struct(
            amount.cast("int").alias("amount"), unit.alias("unit"),
            F.regexp_extract(text, p, 0).alias("span")))
        # The first form, the dearest to look for, has a number in brackets; the others begin with a match.
        tries.append(F.when(F.contains(text, F.lit("(")) if i == 0 else text.rlike(p), found))
    return F.when(text.rlike("(?i)day|week|month|year"), F.coalesce(*tries))


_SPANNED_DOUBLE = T.StructType([T.StructField("value", T.DoubleType()), T.StructField("span", T.StringType())])


@F.pandas_udf(_SPANNED_DOUBLE)
def _percent_beside_references(text: pd.Series) -> pd.DataFrame:
    """Percent search for the few texts that also hold a section-like reference."""
    import re

    patterns = [re.compile(p, re.IGNORECASE) for p in PERCENT_PATTERNS]
    blockers = [re.compile(p) for p in PERCENT_BLOCKERS]

    def accepted(t, m):
        begin = max(0, m.start() - PERCENT_WINDOW)
        window = t[begin:m.end() + PERCENT_WINDOW].lower()
        hits = (b.search(window) for b in blockers)
        return not any(h and abs(h.start() - (m.start() - begin)) < PERCENT_NEAR for h in hits)

    rows = []
    for t in text:
        found = (None, None)
        if t is not None:
            found = next(((round(float(m.group(1)) / 100.0, 4), m.group(0))
                          for p in patterns for m in p.finditer(t) if accepted(t, m)), found)
        rows.append(found)
    return pd.DataFrame(rows, columns=["value", "span"])


def percent_of(text: Column) -> Column:
    """struct<value double, span string>; the value is a fraction.

    Without a section-like reference in the text the first match always counts,
    so only texts that hold one go through Arrow to have match offsets compared.
    """
    candidate = F.when(text.rlike(rx(r"\d\s*%|percent|per\s+cent")), text)
    blocked = candidate.rlike(rx("|".join(PERCENT_BLOCKERS)))
    tries = []
    for pattern in PERCENT_PATTERNS:
        p = rx(pattern)
        value = F.regexp_extract(candidate, p, 1).try_cast("double")
        tries.append(F.when(candidate.rlike(p), once(value, lambda v: F.when(v.isNotNull(), F.struct(
            F.bround(v / 100.0, 4).alias("value"), F.regexp_extract(candidate, p, 0).alias("span"))))))
    near = _percent_beside_references(F.when(blocked, candidate))
    return F.when(blocked, F.when(near["value"].isNotNull(), near)).otherwise(F.coalesce(*tries))


def integer_pattern() -> str:
    """One pattern for a standalone number from 1 to 999,999 away from reference words.

    A reference word counts when it lies wholly within the window on either side,
    which a bounded look-behind and look-ahead state directly.
    """
    before = "".join(f"(?<!{w}.{{0,{INTEGER_WINDOW - len(w)}}})" for w in INTEGER_REFERENCE_WORDS)
    after = "".join(f"(?!.{{0,{INTEGER_WINDOW - len(w)}}}{w})" for w in INTEGER_REFERENCE_WORDS)
    # A digit is asked for first: the look-behinds would otherwise run at both ends of each word.
    return rf"\b(?=[0-9]){before}(0*[1-9]\d{{0,5}})\b{after}(?!\.)"


def integer_of(text: Column) -> Column:
    """struct<value double, span string>"""
    eligible = text.rlike(r"\d") & ~text.rlike(rx("|".join(INTEGER_BLOCKERS)))
    number = F.regexp_extract(text, rx(integer_pattern(), "isU"), 1)
    return F.when(eligible & (number != ""), F.struct(
        number.try_cast("double").alias("value"), number.alias("span")))


def double_of(text: Column) -> Column:
    """Integers first, then percentages, as for every variable of type Double."""
    return F.coalesce(integer_of(text), percent_of(text))


def _at_word_start(patterns: list[str]) -> str:
    """Any of the patterns, all of which begin with a word boundary: it is looked for once per place."""
    assert all(p.startswith(r"\b") for p in patterns)
    return r"\b(?:" + "|".join(p[2:] for p in patterns) + ")"


def polarity_of(text: Column) -> Column:
    return (F.when(text.rlike(rx(_at_word_start(NEGATIVE_PATTERNS))), F.lit(False))
            .when(text.rlike(rx(_at_word_start(POSITIVE_PATTERNS))), F.lit(True)))


def currency_of(text: Column) -> Column:
    expr = F.when(text.rlike(rx(rf"\b{CURRENCY_CODES[0]}\b")), CURRENCY_CODES[0])
    for code in CURRENCY_CODES[1:]:
        expr = expr.when(text.rlike(rx(rf"\b{code}\b")), code)
    for pattern, code in CURRENCY_SYMBOLS:
        expr = expr.when(text.rlike(rx(pattern, "U")), code)
    return expr.otherwise("USD")


def mentions_large_amount(amount: Column, text: Column) -> Column:
    low = F.lower(text)
    billion, million = F.contains(low, F.lit("billion")), F.contains(low, F.lit("million"))
    return F.when(amount >= 1e9, billion).when(amount >= 1e6, billion | million).otherwise(F.lit(True))


# Words that let a percentage stand without its literal form in the text.
REVENUE_WORDS = ["advertising", "sales", "revenue", "profit", "share"]


def supports_percentage(value: Column, text: Column) -> Column:
    """Range check, then the percent in one of its written forms or a revenue word."""
    low = F.lower(text)
    percent = value * 100
    whole = percent.cast("bigint").cast("string")
    short = F.regexp_replace(F.format_string("%.4f", percent), r"\.?0+$", "")
    forms = [
        F.concat(F.lit(r"(?U)\b"), whole, F.lit(r"\s*%")),
        F.concat(F.lit(r"(?U)\b"), F.regexp_replace(short, r"\.", r"\\."), F.lit(r"\s*%")),
        F.concat(F.lit(r"(?U)\b"), F.regexp_replace(F.format_string("%.1f", percent), r"\.", r"\\."),
                 F.lit(r"\s*%")),
        F.concat(F.lit(r"(?U)\b"), whole, F.lit(r"\s+percent")),
        F.lit(r"(?U)\bthirty\s*%"),
    ]
    stated = low.rlike(any_of(REVENUE_WORDS))
    for form in forms:
        stated = stated | F.regexp_like(low, form)
    return (value >= 0) & (value <= 10.0) & stated
