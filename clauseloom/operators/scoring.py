"""Pluggable batch scorers behind a response cache.

A scorer is ``Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]``; it is
run by ``mapInPandas`` inside executors, so a model is loaded once per worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.session import stored

Scorer = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]

# Fixed value: characters of a cache key's digest.
KEY_LENGTH = 16

# Prompt wording per variable type; {v} is the variable name, the clause text follows.
PROMPTS = {
    "String": "Copy the exact wording for {v}; answer null when it is absent.",
    "Boolean": "Is {v} present in the text? Answer true, false or null.",
    "Duration": "Give the duration for {v} as number and unit, or null.",
    "MonetaryAmount": "Give the amount of money for {v}, never a percentage, or null.",
    "Percentage": "Give the percentage for {v} as a decimal fraction, or null.",
    "Double": "Give the number for {v}, or null.",
    "Party[]": "List the companies that are {v} to the contract, one per line; answer NONE when there are none.",
    "Other": "Give the value of {v}, or null.",
}
# Name parts that mark a Double variable as a percentage.
PERCENT_NAMES = ["percentage", "percent", "share", "rate"]


def prompt_for(var_name: Column, var_type: Column, text: Column, limit: int | None = None) -> Column:
    """The prompt over the whole text, or its first ``limit`` characters."""
    is_percent = F.lower(var_name).rlike("|".join(PERCENT_NAMES))
    kind = F.when((var_type == "Double") & is_percent, F.lit("Percentage")).otherwise(var_type)
    wording = F.lit(PROMPTS["Other"])
    for name, words in PROMPTS.items():
        wording = F.when(kind == name, F.lit(words)).otherwise(wording)
    return F.concat(F.replace(wording, F.lit("{v}"), var_name), F.lit("\nText: "),
                    text if limit is None else F.substring(text, 1, limit), F.lit("\nAnswer:"))


def variable_key(prompt: Column, var_name: Column, var_type: Column) -> Column:
    """Cache key of an extraction prompt: short SHA-256, variable and type."""
    return F.concat_ws("|", F.substring(F.sha2(prompt, 256), 1, KEY_LENGTH), var_name, var_type)


def short_key(prefix: str, content: Column) -> Column:
    return F.concat_ws("_", F.lit(prefix), F.substring(F.sha2(content, 256), 1, KEY_LENGTH))


def score(rows: DataFrame, scorer: Scorer, schema: str) -> DataFrame:
    return rows.mapInPandas(scorer, schema)


def cached_responses(prompts: DataFrame, cache: DataFrame, scorer: Scorer) -> tuple[DataFrame, DataFrame]:
    """Answer every prompt once.  ``prompts``: cache_key, prompt; ``cache``: cache_key, response.

    Returns (responses for the distinct keys, the part that was scored now).
    Append the second to the cache table; nothing is rewritten.
    """
    wanted = prompts.groupBy("cache_key").agg(F.min("prompt").alias("prompt"))
    missing = wanted.join(cache.select("cache_key"), "cache_key", "left_anti")
    # stored: the answers returned, appended and joined are those of one run of the model
    fresh = stored(missing.mapInPandas(scorer, "cache_key string, response string"), "responses")
    known = cache.select("cache_key", "response").join(wanted.select("cache_key"), "cache_key", "left_semi")
    return known.withColumn("is_hit", F.lit(True)).unionByName(fresh.withColumn("is_hit", F.lit(False))), fresh


def above(probability: Column, threshold: float = 0.3) -> Column:
    """Strictly above the threshold counts as positive."""
    return (probability > threshold).cast("int")
