"""Reading model answers: typed values, written amounts, string acceptance."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clauseloom.functions import typed as X
from clauseloom.functions.text import any_of, rx, strip

# Answers that mean nothing was found, and fluff cut from the others.
NULL_ANSWERS = [
    "null", "none", "n/a", "not found", "not specified", "not mentioned", "not applicable", "not clear", "unclear",
]
ANSWER_FLUFF = [
    r"^(?:the\s+)?(?:extracted\s+)?(?:value\s+(?:is|for)\s*:?\s*)", r"^(?:answer\s*:?\s*)", r"^(?:result\s*:?\s*)",
    r"^(?:based\s+on.*?:?\s*)", r"^(?:according\s+to.*?:?\s*)", r"^(?:from\s+the\s+text.*?:?\s*)",
    r"^(?:it\s+(?:appears|seems)\s+.*?:?\s*)", r"(?:appears?\s+to\s+be|seems?\s+to\s+be)",
    r"(?:based\s+on|according\s+to|from\s+the)", r"(?:the\s+text\s+(?:states|mentions|indicates))",
]
KEEP_SHARE = 0.3
META_WORDS = [
    "extract", "mention", "state", "indicate", "refer", "describe", "text", "document", "clause", "contract",
    "based", "according",
]
YES_WORDS, NO_WORDS = ["true", "yes", "present"], ["false", "no", "not"]
LIMIT_WORDS = ["exceed", "limit", "cap", "restrict", "maximum", "minimum"]
TERM_PHRASES = ["term duration", "until termination", "until expiration", "during the term"]

# Phrases and tests that make a string answer unacceptable.
STRING_FLUFF = [
    "based on", "according to", "the text", "appears to be", "seems to be", "likely", "probably",
    "indicates that", "suggests that", "mentions", "states that", "specifies that", "refers to", "describes",
    "outlines", "establishes",
]
FRAGMENT_ENDS = [" and ", " or ", " to ", " with ", " ("]
FRAGMENT_STARTS = ["and ", "or ", ") and ", ") or "]
FRAGMENT_PATTERNS = [r"\bSection\s+\d+\.\d+\s*\([^)]*$", r"^[^(]*\)\s+and\s+Section"]
SHORT_FRAGMENT_WORDS = ["section", "clause", "grant", "scope", "pursuant", "accordance"]

# Written amounts in an answer.
PERCENT_MARKS, MONEY_MARKS = ["%", "percent", "per cent"], ["$", "€", "£", "dollar", "usd", "eur", "gbp"]
CURRENCY_WORDS = r"(?:dollars?|usd|euros?|eur|pounds?|gbp)"
# "three times $5" is tried first, or the bare "$5" in it would win.
WRITTEN_PATTERNS = [
    (r"(one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve)\s+times.*?[\$€£](\d+(?:,\d{3})*(?:\.\d{1,2})?)", "times"),
    (r"[\$€£](\d+(?:,\d{3})*(?:\.\d+)?)\s*(mm|m|b|k|million|billion|thousand)?\b", "scaled"),
    (r"(\d+(?:,\d{3})*(?:\.\d+)?)\s*(mm|m|b|k|million|billion|thousand)\b(?!\s*%)", "scaled"),
    (r"[\$€£](\d+(?:,\d{3})*(?:\.\d{1,2})?)", "plain"),
    (rf"(\d+(?:,\d{{3}})*(?:\.\d{{1,2}})?)\s*{CURRENCY_WORDS}", "plain"),
    (rf"(\d+(?:\.\d+)?)\s+(thousand|million|billion|hundred)\s*{CURRENCY_WORDS}", "scaled"),
]
MAX_AMOUNT = 1e12


def _contains_any(text: Column, words: list[str]) -> Column:
    return text.rlike(any_of(words))


def cleaned_answer(response: Column) -> Column:
    """The answer without quotes and fluff; null for "not found" and for pure fluff."""
    bare = F.regexp_replace(F.regexp_replace(strip(response), "^[\"'`]+|[\"'`]+$", ""), r"\.+$", "")
    out = bare
    for pattern in ANSWER_FLUFF:
        out = strip(F.regexp_replace(out, rx(pattern), ""))
    kept = F.length(out) >= F.length(bare) * KEEP_SHARE
    missing = F.coalesce(strip(F.lower(response)), F.lit("")).isin([*NULL_ANSWERS, ""])
    return F.when(~missing & kept, strip(F.regexp_replace(out, "^[\"'`.,;:]+|[\"'`.,;:]+$", "")))


def boolean_answer(answer: Column) -> Column:
    low = F.lower(answer)
    return (F.when(_contains_any(low, YES_WORDS), F.lit(True)).when(_contains_any(low, NO_WORDS), F.lit(False))
            .when(_contains_any(low, LIMIT_WORDS), F.lit(True)))


def double_answer(answer: Column) -> Column:
    number = F.regexp_extract(answer, r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    plain = F.regexp_extract(F.regexp_replace(answer, ",", ""), r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    percent = _contains_any(F.lower(answer), PERCENT_MARKS)
    return F.when(percent, F.bround(F.when(number > 1, number / 100.0).otherwise(number), 4)).otherwise(F.bround(plain, 4))


def duration_answer(answer: Column) -> Column:
    """struct<amount, unit>; "during the term" and the like count as one Term."""
    p = r"(?U)(\d+)\s+(\w+)"
    unit = F.concat(F.initcap(F.regexp_replace(F.lower(F.regexp_extract(answer, p, 2)), "s+$", "")), F.lit("s"))
    found = F.struct(F.regexp_extract(answer, p, 1).try_cast("int").alias("amount"), unit.alias("unit"))
    term = F.struct(F.lit(1).alias("amount"), F.lit("Term").alias("unit"))
    return F.when(answer.rlike(p), found).when(_contains_any(F.lower(answer), TERM_PHRASES), term)


def date_answer(answer: Column) -> Column:
    return F.coalesce(X.date_of(answer)["dt"], F.try_to_date(F.substring(answer, 1, 10), "yyyy-MM-dd"))


# Number words of written amounts.
_UNITS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16,
    "seventeen": 17, "eighteen": 18, "nineteen": 19,
}
_TENS = {
    "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
}
_SCALES = {"thousand": 10**3, "million": 10**6, "billion": 10**9}


def words_to_number(text: str) -> float | None:
    """"two million five hundred thousand" -> 2500000.0; null when a word is no number."""
    total = group = 0
    seen = False
    for word in text.lower().replace("-", " ").split():
        if word == "and":
            continue
        if word in _UNITS or word in _TENS:
            group += _UNITS.get(word, 0) + _TENS.get(word, 0)
        elif word == "hundred":
            group = max(group, 1) * 100
        elif word in _SCALES:
            total, group = total + max(group, 1) * _SCALES[word], 0
        else:
            return None
        seen = True
    return float(total + group) if seen else None


@F.pandas_udf(T.DoubleType())
def _number_words(text: pd.Series) -> pd.Series:
    return text.map(lambda t: words_to_number(t) if t else None).astype("float64")


def written_amount(answer: Column) -> Column:
    """Amount of money in an answer: symbols, multipliers, "three times $5", number words."""
    low = strip(F.lower(answer))
    tries = []
    for pattern, form in WRITTEN_PATTERNS:
        p = rx(pattern, "sU")
        if form == "times":
            value = X._literal_map(X.DURATION_WORDS)[F.regexp_extract(low, p, 1)] * F.regexp_replace(
                F.regexp_extract(low, p, 2), ",", "").try_cast("double")
        else:
            value = F.regexp_replace(F.regexp_extract(low, p, 1), ",", "").try_cast("double")
            if form == "scaled":
                value = value * F.coalesce(X._literal_map(X.MULTIPLIERS)[F.regexp_extract(low, p, 2)], F.lit(1.0))
        tries.append(F.when((value > 0) & (value <= MAX_AMOUNT), value))
    words = strip(F.regexp_replace(F.regexp_replace(low, r"dollars?|usd|euro?s?|eur|pounds?|gbp|\$|€|£", ""), "amount|fee|cost|price", ""))
    wordy = _contains_any(low, ["dollar", "usd", "euro", "eur", "pound", "gbp"]) & ~words.rlike(r"\d") & words.rlike(r"\S\s+\S")
    spelled = _number_words(F.when(wordy, words))
    tries.append(F.when((spelled > 0) & (spelled <= MAX_AMOUNT), spelled))
    is_percent = _contains_any(low, PERCENT_MARKS) & ~_contains_any(low, MONEY_MARKS)
    return F.when(~is_percent & ~low.isin("null", "none", "n/a", ""), F.coalesce(*tries))


def string_answer(answer: Column) -> Column:
    ok = ~_contains_any(F.lower(answer), META_WORDS) & (F.length(answer) >= 3) & (F.length(answer) <= 300)
    return F.when(ok, answer)


def is_fragment(value: Column) -> Column:
    low = F.lower(value)
    count = lambda ch: F.length(value) - F.length(F.replace(value, F.lit(ch), F.lit("")))
    tests = [value.endswith(e) for e in FRAGMENT_ENDS] + [value.startswith(s) for s in FRAGMENT_STARTS]
    tests += [count("(") != count(")"), count('"') % 2 != 0, count("'") % 2 != 0]
    tests += [F.contains(value, F.lit(" )")) & ~strip(value).endswith(")"),
              value.startswith("(") & ~F.contains(value, F.lit(")"))]
    tests += [value.rlike("(?U)" + p) for p in FRAGMENT_PATTERNS]
    few = F.size(F.filter(F.split(value, r"(?U)\s+"), lambda w: w != "")) < 3
    tests.append(few & _contains_any(low, SHORT_FRAGMENT_WORDS))
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def accepted_string(value: Column, var_name: Column) -> Column:
    """The trimmed value when it reads as a complete, meaningful unit, else null."""
    v = strip(value)
    symbols = F.length(F.regexp_replace(v, r"(?U)[\w\s]", ""))
    dangling = F.contains(F.lower(var_name), F.lit("scope")) & v.rlike("(?U)" + FRAGMENT_PATTERNS[0])
    ok = ((F.length(v) >= 5) & (F.length(v) <= 500) & v.rlike("[a-zA-Z]") & (symbols <= F.length(v) * 0.3)
          & ~_contains_any(F.lower(v), STRING_FLUFF) & ~is_fragment(v) & ~dangling)
    return F.when(ok, v)


def parse_responses(rows: DataFrame, response: str = "response", var_type: str = "var_type") -> DataFrame:
    """Adds s, b, d, dt, amount, currency, dur_amount, dur_unit read by variable type.

    The cleaned answer is a column of its own: written into each rule it would make
    expressions too large to compile.
    """
    a = F.col("_answer")
    of = lambda kind, value: F.when(F.col(var_type) == kind, value)
    cleaned = rows.withColumn("_answer", cleaned_answer(F.col(response)))
    amounts = cleaned.withColumn("_written", F.when(F.col(var_type) == "MonetaryAmount", written_amount(a))).withColumn(
        "_pattern", of("MonetaryAmount", X.money_of(a))).withColumn("_duration", of("Duration", duration_answer(a)))
    written = F.col("_written").isNotNull()
    return amounts.withColumns({
        "s": of("String", string_answer(a)), "b": of("Boolean", boolean_answer(a)), "d": of("Double", double_answer(a)),
        "dt": of("DateTime", date_answer(a)),
        "amount": F.when(written, F.bround("_written", 2)).otherwise(F.col("_pattern.amount")),
        "currency": F.when(written, F.lit("USD")).otherwise(F.col("_pattern.currency")),
        "dur_amount": F.col("_duration.amount"), "dur_unit": F.col("_duration.unit"),
    }).drop("_answer", "_written", "_pattern", "_duration")
