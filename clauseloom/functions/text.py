"""Text predicates and projections: cleaning, non-answers, routing, truncation, ids."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from clauseloom.lookups import CLAUSE_MAPPINGS, ROUTING_SHARE, ROUTING_STOPWORDS

# Patterns removed when text is cleaned (case-insensitive).
REMOVE_PATTERNS = [
    r"Page \d+ of \d+",
    r"^\d+\s*$",
    r"\[\*{3,}\]",
    r"\$\[\*{3,}\]",
    r"\[\.\.\.\*{3,}\.\.\.\]",
    r"\(\*{3,}\)",
]

# Answers that mean "no answer".
NON_ANSWERS = [
    "none", "n/a", "not applicable", "not specified",
    "not mentioned", "not provided", "not found", "not included", "does not specify",
    "is not mentioned", "not disclosed", "null", "",
]
NON_ANSWER_PATTERNS = [
    r"^no\.?$",
    r"^none\.?$",
    r"^not?\s+applicable\.?$",
    r"^n/?a\.?$",
    r"^not?\s+(mentioned|specified|provided|found|included)\.?$",
    r"^\s*$",
    r"^\.+$",
    r"^-+$",
]
MIN_ANSWER_LENGTH = 2

# Substrings that mark the last "__" part of a contract id as a clause label.
ID_LABEL_WORDS = [
    "document", "name", "parties", "agreement", "date", "effective", "expiration", "renewal", "term", "notice",
    "period", "termination", "convenience", "governing", "law", "most", "favored", "nation", "non", "compete",
    "exclusivity", "solicit", "customers", "employees", "competitive", "restriction", "exception", "disparagement",
    "rofr", "rofo", "rofn", "right", "first", "refusal", "change", "control", "anti", "assignment", "revenue",
    "profit", "sharing", "price", "restrictions", "minimum", "commitment", "volume", "restriction", "ip",
    "ownership", "assignment", "joint", "license", "grant", "transferable", "affiliate", "licensor", "licensee",
    "unlimited", "all", "you", "can", "eat", "irrevocable", "perpetual", "source", "code", "escrow", "post",
    "termination", "services", "audit", "rights", "uncapped", "liability", "cap", "on", "liquidated", "damages",
    "warranty", "duration", "insurance", "covenant", "not", "to", "sue", "third", "party", "beneficiary",
]


def rx(pattern: str, flags: str = "iU") -> str:
    """A Java pattern that reads \\s, \\b, \\w and letters the Unicode way."""
    return f"(?{flags}){pattern}"


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed a single time, however often ``use`` reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def any_of(words: list[str]) -> str:
    """An alternation that matches any of the words literally."""
    return "(?:" + "|".join(re.sub(r"([^\w\s])", r"\\\1", w) for w in words) + ")"


def strip(text: Column, chars: str = "") -> Column:
    """Both-end strip of all white space plus the given regex class characters."""
    return F.regexp_replace(text, rf"(?U)^[\s{chars}]+|[\s{chars}]+$", "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def clean_text(text: Column) -> Column:
    """The text without removed patterns, each run of white space one blank, none at the ends."""
    def without(value: Column, patterns: list[str]) -> Column:
        for pattern in patterns:
            value = F.regexp_replace(value, rx(pattern), "")
        return value

    # Long texts seldom hold stars: the patterns that need three of them are tried on those that do.
    starred = [p for p in REMOVE_PATTERNS if r"\*{3,}" in p]
    out = once(without(text, [p for p in REMOVE_PATTERNS if p not in starred]),
               lambda t: F.when(F.contains(t, F.lit("***")), without(t, starred)).otherwise(t))
    return F.trim(F.regexp_replace(out, r"(?U) \s+|[\s&&[^ ]]\s*", " "))


def clean_word_count(text: Column) -> Column:
    """``word_count`` of what ``clean_text`` returns, without making the words."""
    blanks = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))
    return F.when(text == "", 0).otherwise(blanks + 1)


def is_non_answer(text: Column) -> Column:
    low = strip(F.lower(text))
    return text.isNull() | low.isin(NON_ANSWERS) | low.rlike(
        "(?U)" + "|".join(f"(?:{p})" for p in NON_ANSWER_PATTERNS))


def first_valid_answer(answers: Column, min_length: int = MIN_ANSWER_LENGTH) -> Column:
    """First acceptable answer of an array<struct<text, answer_start>>, else null."""
    trimmed = F.transform(answers, lambda a: F.struct(
        strip(F.coalesce(a["text"], F.lit(""))).alias("text"),
        F.coalesce(a["answer_start"], F.lit(0)).alias("answer_start")))
    good = F.filter(trimmed, lambda a: (~is_non_answer(a["text"])) & (F.length(a["text"]) >= min_length))
    return F.get(good, F.lit(0))


def _key_words(label: str) -> list[str]:
    return [w for w in label.lower().replace("-", " ").split() if w not in ROUTING_STOPWORDS]


def clause_type_of(question: Column, match: str = "first") -> Column:
    """Route a question to a clause type.

    ``first`` follows mapping order; ``longest`` prefers the longest label found,
    so that a question that merely mentions a short label is not captured by it.
    """
    low = F.lower(question)
    order = CLAUSE_MAPPINGS if match == "first" else sorted(
        CLAUSE_MAPPINGS, key=lambda m: -len(m[0]))
    branches = [(F.contains(low, F.lit(label.lower())), kind) for label, kind in order]
    for label, kind in CLAUSE_MAPPINGS:
        keys = _key_words(label)
        hits = sum((F.contains(low, F.lit(k)).cast("int") for k in keys), F.lit(0))
        branches.append((hits >= len(keys) * ROUTING_SHARE, kind))
    expr = F.when(branches[0][0], F.lit(branches[0][1]))
    for cond, kind in branches[1:]:
        expr = expr.when(cond, F.lit(kind))
    return F.when(question.isNull(), F.lit("unknown")).otherwise(expr.otherwise("unknown"))


def clause_type_by_pattern(question: Column, patterns: list[str]) -> Column:
    """Alternate router: label substring, else a pattern whose group 1 holds a label."""
    def by_label(text: Column) -> Column:
        low = F.lower(text)
        return F.coalesce(*[F.when(F.contains(low, F.lit(label.lower())), F.lit(kind))
                            for label, kind in CLAUSE_MAPPINGS])

    tries = [by_label(question)]
    tries += [by_label(F.regexp_extract(question, rx(p), 1)) for p in patterns]
    return F.coalesce(*tries, F.lit("unknown"))


def truncate_words(text: Column, limit: Column | int) -> Column:
    """First ``limit`` words joined by one blank; shorter text is returned unchanged."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    parts = words(text)
    return F.when(F.size(parts) > limit, F.array_join(F.slice(parts, F.lit(1), F.greatest(limit, F.lit(0))), " ")
                  ).otherwise(text)


def word_windows(text: Column, size: Column | int, clean: bool = False) -> Column:
    """array<string>: the text as runs of ``size`` words (at least one); a text that fits is one run, unchanged.

    ``clean`` says that the text comes from ``clean_text``, so that its words stand between single blanks.
    """
    size = F.greatest(F.lit(size) if isinstance(size, int) else size, F.lit(1))

    def cut(parts: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(parts) / size).cast("int") - 1, F.lit(0)))
        runs = F.transform(starts, lambda k: F.array_join(F.slice(parts, k * size + 1, size), " "))
        return F.when(F.size(parts) > size, runs)

    # The words are made once per text; read in the inner function, they would be made again for each run.
    return F.coalesce(once(F.split(text, " ") if clean else words(text), cut), F.array(text))


def sample_context_limit(question: Column, model_words: int = 512) -> Column:
    return F.lit(model_words) - word_count(question) - 20


def model_input(text: Column, model_words: int = 512) -> Column:
    """Shorten the context half of ``question [SEP] context`` for a model of ``model_words``."""
    parts = F.split(text, r" ?\[SEP\] ?", 2)
    question, context = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    limit = F.floor((F.lit(model_words) - word_count(question) - 10) * 0.75).cast("int")
    return F.when(context.isNull(), text).otherwise(
        F.concat(question, F.lit(" [SEP] "), truncate_words(context, limit)))


def base_contract_id(contract_id: Column) -> Column:
    parts = F.split(contract_id, "_")
    return F.when(F.size(parts) >= 3, F.get(parts, F.lit(0))).otherwise(contract_id)


def normalized_contract_id(contract_id: Column) -> Column:
    clean = strip(contract_id)
    last = F.lower(F.element_at(F.split(clean, "__"), -1))
    labelled = F.contains(clean, F.lit("__")) & last.rlike(any_of(sorted(set(ID_LABEL_WORDS))))
    parts = F.split(clean, "__")
    kept = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), "__")
    return F.when(labelled, kept).otherwise(clean)


def embedding_text(primary: Column, *fallbacks: Column, default: str = "empty clause") -> Column:
    def usable(col: Column) -> Column:
        trimmed = strip(col)
        return F.when((trimmed != "") & (F.lower(trimmed) != "nan"), trimmed)

    return F.coalesce(usable(primary), *[usable(c) for c in fallbacks], F.lit(default))


def extraction_text(clause_type: Column, context: Column, answer_text: Column, window: int | None = None) -> Column:
    """Text the extractors read; null when there is nothing usable. ``window`` cuts what is read for party names."""
    names = F.coalesce(context, answer_text)
    full = F.when(clause_type == "parties", names if window is None else F.substring(names, 1, window)
                  ).otherwise(F.coalesce(answer_text, context))
    trimmed = strip(full)
    return F.when((F.length(trimmed) >= 10) & ~full.isin("nan", "None", "", "null"), trimmed)
