"""Extraction with a model behind the patterns.

Per variable: pattern, then model answers over windows of the text, then the consistency
rules; per contract: parties from its longest context where no parties clause gave any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.functions import parties as P
from clauseloom.functions import responses as R
from clauseloom.functions import text as T
from clauseloom.operators import extraction as E
from clauseloom.operators import scoring as S
from clauseloom.session import stored

# Characters of a prompt window, and how many of them the next window repeats, so that an
# answer of up to that length stands whole in some window.
WINDOW, OVERLAP = 1000, 200
# Fixed value: a context must be longer than this to be read for parties.
FALLBACK_LENGTH = 500

TEXT_ID = ["clause_type", "text_key"]


def with_extraction_text(clauses: DataFrame) -> DataFrame:
    """Adds ``text``, chosen from ``context`` and ``answer_text``; clauses without a usable text drop out.

    Written as an explode, so that the choice is made once and not in each pattern that reads it.
    """
    chosen = T.extraction_text(F.col("clause_type"), F.col("context"), F.col("answer_text"))
    rest = [c for c in clauses.columns if c != "text"]
    return clauses.select(*rest, F.explode(F.filter(F.array(chosen), lambda x: x.isNotNull())).alias("text"))


def windows(rows: DataFrame, text: str, length: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """One row per window of ``text``: adds ``window`` (from 0) and ``window_text``.

    The windows cover the whole text, whatever its length. A null text has none, an empty
    one has one empty window.
    """
    step = length - overlap
    last = F.greatest(F.ceil((F.length(text) - overlap) / step) - 1, F.lit(0))
    numbered = rows.withColumn("window", F.explode(
        F.when(F.col(text).isNotNull(), F.sequence(F.lit(0).cast("bigint"), last))))
    return numbered.withColumn("window_text", F.substr(text, (F.col("window") * step + 1).cast("int"), F.lit(length)))


def open_variables(extracted: DataFrame) -> DataFrame:
    """One row per text and variable that the patterns left open; parties are always asked for.

    What a pattern finds depends on type and text alone, so equal texts are asked once.
    """
    asked = F.filter("raw_vars", lambda v: ~E.is_set(v) | (v["var_type"] == "Party[]"))
    texts = extracted.where("text IS NOT NULL").select(*TEXT_ID, "text", asked.alias("asked")).where(
        F.size("asked") > 0).dropDuplicates(TEXT_ID)
    return texts.select(*TEXT_ID, "text", F.explode("asked").alias("v")).select(
        *TEXT_ID, "text", F.col("v.pos").alias("pos"), F.col("v.var_name").alias("var_name"),
        F.col("v.var_type").alias("var_type"))


def prompts(variables: DataFrame) -> DataFrame:
    """Prompts of open variables, one per window, with their cache keys."""
    part = F.when(F.col("var_type") == "Party[]", P.party_section(F.col("text"))).otherwise(F.col("text"))
    cut = windows(variables.withColumn("part", part).drop("text"), "part")
    prompt = S.prompt_for(F.col("var_name"), F.col("var_type"), F.col("window_text"))
    return cut.withColumn("prompt", prompt).drop("part", "window_text").withColumn(
        "cache_key", S.variable_key(F.col("prompt"), F.col("var_name"), F.col("var_type")))


def first_accepted(answered: DataFrame) -> DataFrame:
    """The value of the first window whose answer is acceptable, per text and variable.

    ``answered`` has a text's id, pos, var_name, var_type, window and response. Variables
    without an acceptable answer are missing from the result.
    """
    parsed = R.parse_responses(answered).withColumn("s", R.accepted_string(F.col("s"), F.col("var_name"))).withColumn(
        "parties", F.when(F.col("var_type") == "Party[]", P.parties_from_answer(F.col("response"))))
    fields = [f for f in E.VALUE_FIELDS if f != "span"]
    value = F.struct(*[F.col(f) for f in fields])
    # an explode and no filter, which would be pushed below and read every answer twice
    accepted = parsed.select(*TEXT_ID, "pos", "window", F.explode(F.filter(F.array(value), E.is_set)).alias("value"))
    return accepted.groupBy(*TEXT_ID, "pos").agg(F.min_by("value", "window").alias("value"))


def _filled(v: Column, answer: Column, kinds: dict) -> Column:
    """The variable with the model's value where there is one; a value of the model has no span."""
    plain = [v[f].alias(f) for f in ("pos", "var_name", "var_type", "deniers")]
    values = [F.coalesce(answer[f].cast(kinds[f]), v[f]).alias(f) for f in E.VALUE_FIELDS if f != "span"]
    return F.struct(*plain, *values, F.when(answer.isNull(), v["span"]).alias("span"))


def with_answers(extracted: DataFrame, answers: DataFrame) -> DataFrame:
    """Fills ``raw_vars`` from answers per text; a text has at most one answer per schema variable."""
    kinds = {f.name: f.dataType for f in extracted.schema["raw_vars"].dataType.elementType.fields}
    per_text = answers.groupBy(*TEXT_ID).agg(
        F.map_from_entries(F.collect_list(F.struct("pos", "value"))).alias("answers"))
    filled = F.transform("raw_vars", lambda v: _filled(v, F.try_element_at("answers", v["pos"]), kinds))
    return extracted.join(per_text, TEXT_ID, "left").withColumn("raw_vars", filled).drop("answers")


def extract_with_model(clauses: DataFrame, scorer: S.Scorer, cache: DataFrame | None = None,
                       max_contracts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The whole extraction; returns the clause rows with ``vars`` and the new responses.

    ``clauses`` needs contract_id, clause_type, clause_seq, context and answer_text. The
    rows carry ``source_clause``: the type whose context gave the parties, else null.
    Append the new responses (cache_key, response) to the cache for the next run. A null
    context or answer_text is replaced by the other; clauses without either, and clauses
    without any value, drop out; of clauses equal in contract, type and text the first stays.
    """
    spark = clauses.sparkSession
    if max_contracts is not None:
        chosen = E.select_contracts(E.contract_coverage(clauses), max_contracts).select("contract_id")
        clauses = clauses.join(chosen, "contract_id", "left_semi")
    if cache is None:
        cache = spark.createDataFrame([], "cache_key string, response string")
    texts = with_extraction_text(clauses).select("contract_id", "clause_type", "clause_seq", "text")
    # stored: read for the prompts and again for the values
    raw = stored(E.extract_raw(texts.withColumn("text_key", F.sha2("text", 256))), "raw_variables")
    asked = stored(prompts(open_variables(raw)), "prompts")
    responses, fresh = S.cached_responses(asked.select("cache_key", "prompt"), cache, scorer)
    answered = asked.drop("prompt").join(responses.select("cache_key", "response"), "cache_key")
    ruled = E.apply_rules(with_answers(raw, first_accepted(answered)))
    # stored: the rows, and the contracts that they give parties
    own = stored(E.dedup_clauses(E.with_values(ruled.drop("text_key"))), "extracted")
    named = own.where("clause_type = 'parties'").select("contract_id").distinct()
    found = E.fallback_parties(clauses.where("clause_type <> 'parties'"), FALLBACK_LENGTH, named)
    return own.withColumn("source_clause", F.lit(None).cast("string")).unionByName(
        _party_rows(found, own.schema["vars"].dataType.elementType)), fresh


def _party_rows(found: DataFrame, kind) -> DataFrame:
    """Fallback parties in the form of extracted clauses."""
    known = {"pos": F.lit(0), "var_name": F.lit("parties"), "var_type": F.lit("Party[]"), "parties": F.col("parties")}
    var = F.struct(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.fields])
    return found.select("clause_type", "contract_id", "clause_seq", F.col("original_text").alias("text"),
                        F.array(var).alias("vars"), "source_clause")
