"""Queries over classifiers, scorers and their evaluation."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from clauseloom.corpus_model import CLAUSES_SQL, rendered_clauses
from clauseloom.lookups import schema_rows, sql_values, type_positions
from clauseloom.operators import answers as A
from clauseloom.operators import corpus as C
from clauseloom.operators import evaluate as E
from clauseloom.operators import extraction as X
from clauseloom.operators import models as M
from clauseloom.operators import scoring as S
from clauseloom.plans.corpus import SAMPLES_SQL, corpus_samples
from clauseloom.plans.extraction import RAW_SQL
from clauseloom.plans.registry import query
from clauseloom.plans.similarity import predictions
from clauseloom.session import table

_SCORES_SQL = """scores AS (SELECT doc_id, quality AS truth, (doc_id * 37 % 100) / 100.0::DOUBLE AS score FROM labels)"""
_SWEEP_SQL = f"""{_SCORES_SQL},
counts AS (SELECT t AS threshold, count(*) FILTER (WHERE score > t AND truth = 1) AS tp, count(*) FILTER (WHERE score > t AND truth = 0) AS fp,
  count(*) FILTER (WHERE NOT score > t AND truth = 1) AS fn, count(*) FILTER (WHERE NOT score > t AND truth = 0) AS tn
  FROM scores, (VALUES (0.2::DOUBLE), (0.3), (0.4), (0.5), (0.6)) th(t) GROUP BY t),
pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS precision,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS recall FROM counts),
sweep AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1,
  (tp + tn) / (tp + fp + fn + tn)::DOUBLE AS accuracy FROM pr)"""


def fixed_scores(spark, sf_dir):
    return table(spark, sf_dir, "labels").select(
        "doc_id", F.col("quality").alias("truth"), (F.pmod(F.col("doc_id") * 37, F.lit(100)) / 100.0).alias("score"))


def _rounded(df, keep, cols):
    return df.select(*keep, *[F.round(c, 6).alias(c) for c in cols])


@query("batch_scoring", f"WITH {_SCORES_SQL} SELECT doc_id, score AS probability, (score > 0.3)::INT AS prediction FROM scores")
def batch_scoring(spark, sf_dir):
    """A scorer run by mapInPandas, then the strict threshold as a column."""
    def scorer(batches):
        for b in batches:
            b["probability"] = (b["doc_id"] * 37 % 100) / 100.0
            yield b

    scored = S.score(table(spark, sf_dir, "labels").select("doc_id"), scorer, "doc_id long, probability double")
    return scored.withColumn("prediction", S.above(F.col("probability")))


@query("two_stage_classification", f"""WITH {SAMPLES_SQL},
s AS (SELECT *, (clause_seq * 37 % 100) / 100.0::DOUBLE AS p FROM samples),
pos AS (SELECT *, row_number() OVER (ORDER BY clause_seq) - 1 AS n FROM s WHERE p > 0.3)
SELECT 'main_' || n AS clause_id, contract_id AS original_id, clause_type AS predicted_clause_type, coalesce(answer_text, '') AS answer_text,
  CASE WHEN has_answer THEN question || ' ' || answer_text ELSE question END AS qa_combination, round(0.5 + p / 2, 6) AS multiclass_confidence,
  CASE WHEN has_answer THEN len(string_split(answer_text, ' ')) ELSE 0 END AS answer_length FROM pos""")
def two_stage_classification(spark, sf_dir):
    """Stage 2 sees stage-1 positives only: the filter stands before its scorer."""
    def relevance(batches):
        for b in batches:
            b["p"] = (b["clause_seq"] * 37 % 100) / 100.0
            yield b

    def typing(batches):
        for b in batches:
            b["multiclass_confidence"] = 0.5 + b["p"] / 2
            yield b

    rows = corpus_samples(spark, sf_dir).select(
        "clause_seq", "contract_id", "title", "question", "context", "clause_type", "answer_text",
        F.lit("main").alias("split"))
    schema = ("clause_seq long, contract_id string, title string, question string, context string, clause_type string, "
              "answer_text string, split string, p double")
    stage1 = S.score(rows, relevance, schema).withColumn("binary_prediction", S.above(F.col("p")))
    stage2 = S.score(stage1.where("binary_prediction = 1"), typing,
                     schema + ", binary_prediction int, multiclass_confidence double")
    ready = stage2.withColumn("predicted_clause_type", F.col("clause_type")).withColumn(
        "context_length", F.lit(0))
    return C.classified_clauses(ready, "clause_seq").select(
        "clause_id", "original_id", "predicted_clause_type", "answer_text", "qa_combination",
        F.round("multiclass_confidence", 6).alias("multiclass_confidence"), "answer_length")


@query("threshold_sweep", f"""WITH {_SWEEP_SQL} SELECT threshold, tp, fp, fn, tn, round(precision, 6) AS precision,
  round(recall, 6) AS recall, round(f1, 6) AS f1, round(accuracy, 6) AS accuracy FROM sweep""")
def threshold_sweep(spark, sf_dir):
    return _rounded(E.threshold_sweep(fixed_scores(spark, sf_dir)), ["threshold", "tp", "fp", "fn", "tn"],
                    ["precision", "recall", "f1", "accuracy"])


@query("derived_binary_metrics", f"""WITH {_SWEEP_SQL}, s AS (SELECT *, (tp + fp + fn + tn)::DOUBLE AS n FROM sweep WHERE threshold = 0.3)
SELECT threshold, round(tn / (tn + fp)::DOUBLE, 6) AS specificity, round(tp / (tp + fn)::DOUBLE, 6) AS sensitivity,
  round(fp / (fp + tn)::DOUBLE, 6) AS false_positive_rate, round(fn / (fn + tp)::DOUBLE, 6) AS false_negative_rate,
  round(tp / (tp + fp)::DOUBLE, 6) AS ppv, round(tn / (tn + fn)::DOUBLE, 6) AS npv, round((tp + fn) / n, 6) AS positive_ratio,
  round((tp + fn) / n * (tp / (tp + fn)::DOUBLE) * 0.9 + (tn + fp) / n * (tn / (tn + fp)::DOUBLE), 6) AS pipeline_accuracy,
  round(tp / (tp + fp)::DOUBLE * 0.9, 6) AS pipeline_precision, round(1 - (tp + fn) / n, 6) AS work_avoided FROM s""")
def derived_binary_metrics(spark, sf_dir):
    m = E.derived_metrics(E.threshold_sweep(fixed_scores(spark, sf_dir)), stage2_accuracy=0.9)
    return _rounded(m, ["threshold"], [c for c in m.columns if c != "threshold"])


@query("threshold_improvement", f"""WITH {_SWEEP_SQL} SELECT round(a.recall - b.recall, 6) AS recall_improvement,
  round(a.precision - b.precision, 6) AS precision_change, round(a.f1 - b.f1, 6) AS f1_improvement,
  round(a.accuracy - b.accuracy, 6) AS accuracy_change FROM sweep a JOIN sweep b ON a.threshold = 0.3 AND b.threshold = 0.5""")
def threshold_improvement(spark, sf_dir):
    m = E.threshold_improvement(E.threshold_sweep(fixed_scores(spark, sf_dir)))
    return _rounded(m, [], m.columns)


_PRED_SQL = """p AS (SELECT label::VARCHAR AS truth, CASE WHEN vec_id % 5 = 0 THEN (label + 1) % 10 ELSE label END::VARCHAR AS predicted FROM embeddings)"""
_REPORT_SQL = f"""{_PRED_SQL},
t AS (SELECT truth AS label, count(*) AS support, count(*) FILTER (WHERE truth = predicted) AS tp FROM p GROUP BY truth),
f AS (SELECT predicted AS label, count(*) AS n_predicted FROM p GROUP BY predicted),
report AS (SELECT label, coalesce(support, 0) AS support, coalesce(tp / nullif(n_predicted, 0)::DOUBLE, 0) AS precision,
  coalesce(tp / nullif(support, 0)::DOUBLE, 0) AS recall, 2 * tp / (support + n_predicted)::DOUBLE AS f1 FROM t FULL JOIN f USING (label))"""


@query("class_report", f"""WITH {_REPORT_SQL} SELECT label, support, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(f1, 6) AS f1 FROM report""")
def class_report(spark, sf_dir):
    return _rounded(E.class_report(predictions(spark, sf_dir)), ["label", "support"], ["precision", "recall", "f1"])


@query("class_report_best_worst", f"""WITH {_REPORT_SQL} (SELECT 'best' AS side, label, round(f1, 6) AS f1 FROM report ORDER BY report.f1 DESC, label LIMIT 5)
UNION ALL (SELECT 'worst', label, round(f1, 6) FROM report ORDER BY report.f1, label LIMIT 5)""")
def class_report_best_worst(spark, sf_dir):
    return _rounded(E.best_and_worst(E.class_report(predictions(spark, sf_dir))), ["side", "label"], ["f1"])


@query("class_report_weighted", f"""WITH {_REPORT_SQL} SELECT sum(support) AS n, round(sum(recall * support) / sum(support), 6) AS accuracy,
  round(sum(precision * support) / sum(support), 6) AS weighted_precision, round(sum(recall * support) / sum(support), 6) AS weighted_recall,
  round(sum(f1 * support) / sum(support), 6) AS weighted_f1, count(*) FILTER (WHERE support > 0) AS n_classes FROM report""")
def class_report_weighted(spark, sf_dir):
    return _rounded(E.weighted_summary(predictions(spark, sf_dir)), ["n", "n_classes"],
                    ["accuracy", "weighted_precision", "weighted_recall", "weighted_f1"])


@query("confusion_matrix", f"WITH {_PRED_SQL} SELECT truth, predicted, count(*) AS n FROM p GROUP BY ALL")
def confusion_matrix(spark, sf_dir):
    return E.confusion(predictions(spark, sf_dir))


@query("prediction_agreement", f"""WITH {_PRED_SQL}, k AS (SELECT * FROM (SELECT CASE truth WHEN '9' THEN 'unknown' ELSE truth END AS truth, predicted FROM p)
  WHERE truth <> 'unknown')
SELECT truth, count(*) AS total, count(*) FILTER (WHERE truth = predicted) AS correct, round(avg((truth = predicted)::INT), 6) AS accuracy
FROM k GROUP BY truth""")
def prediction_agreement(spark, sf_dir):
    p = predictions(spark, sf_dir).withColumn("truth", F.when(F.col("truth") == "9", "unknown").otherwise(F.col("truth")))
    return _rounded(E.agreement(p), ["truth", "total", "correct"], ["accuracy"])


@query("prediction_agreement_summary", f"""WITH {_PRED_SQL}, g AS (SELECT truth, count(*) AS t, count(*) FILTER (WHERE truth = predicted) AS c FROM p GROUP BY truth)
SELECT sum(t) AS total_classified, sum(c) AS correct_predictions, round(sum(c) / sum(t)::DOUBLE, 6) AS overall_accuracy,
  round(avg(c / t::DOUBLE), 6) AS average_type_accuracy FROM g""")
def prediction_agreement_summary(spark, sf_dir):
    return _rounded(E.agreement_summary(predictions(spark, sf_dir)), ["total_classified", "correct_predictions"],
                    ["overall_accuracy", "average_type_accuracy"])


@query("label_concentration", f"""WITH {CLAUSES_SQL}, c AS (SELECT n_name AS label, count(*) AS c FROM clauses GROUP BY n_name),
top AS (SELECT * FROM c ORDER BY c DESC, label LIMIT 5)
SELECT (SELECT sum(c) FROM c) AS total, round(sum(c) / (SELECT sum(c) FROM c)::DOUBLE, 6) AS top_share,
  round(max(c) / min(c)::DOUBLE, 6) AS first_to_last, round(max(c) / (SELECT sum(c) FROM c)::DOUBLE, 6) AS dominant_share FROM top""")
def label_concentration(spark, sf_dir):
    labels = rendered_clauses(spark, sf_dir).select(F.col("n_name").alias("label"))
    return _rounded(E.concentration(labels), ["total"], ["top_share", "first_to_last", "dominant_share"])


@query("class_balance", """SELECT count(*) AS n, count(*) FILTER (WHERE quality = 1) AS positives, count(*) FILTER (WHERE quality = 0) AS negatives,
  round(count(*) FILTER (WHERE quality = 0) / count(*) FILTER (WHERE quality = 1)::DOUBLE * 0.4, 6) AS positive_weight FROM labels""")
def class_balance(spark, sf_dir):
    b = M.class_balance(table(spark, sf_dir, "labels").select(F.col("quality").alias("label")))
    return _rounded(b, ["n", "positives", "negatives"], ["positive_weight"])


@query("class_weights", """WITH b AS (SELECT round(count(*) FILTER (WHERE quality = 0) / count(*) FILTER (WHERE quality = 1)::DOUBLE * 0.4, 6) AS w FROM labels)
SELECT doc_id, quality AS label, CASE WHEN quality = 1 THEN w ELSE 1.0 END AS weight FROM labels, b""")
def class_weights(spark, sf_dir):
    rows = M.with_class_weight(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")))
    return rows.select("doc_id", "label", F.round("weight", 6).alias("weight"))


@query("top_labels", f"""WITH {CLAUSES_SQL}, c AS (SELECT clause_type, count(*) AS n_rows FROM clauses GROUP BY clause_type)
SELECT clause_type, n_rows, row_number() OVER (ORDER BY n_rows DESC, clause_type) AS rank FROM c QUALIFY rank <= 5""")
def top_labels(spark, sf_dir):
    return E.top_counts(rendered_clauses(spark, sf_dir), "clause_type", 5)


@query("relevance_model")
def relevance_model(spark, sf_dir):
    """Weighted logistic regression on hashed text, scored at the strict threshold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = docs.join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "text", F.col("quality").alias("label"))
    scored = M.binary_probability(M.train_binary(rows), rows)
    return scored.select("doc_id", "label", S.above(F.col("probability")).alias("prediction"))


@query("relevance_model_held_out", """SELECT count(*) AS n_held_out, true AS beats_majority FROM documents JOIN labels USING (doc_id) WHERE doc_id % 5 = 1""")
def relevance_model_held_out(spark, sf_dir):
    """Fitted on four fifths of the labelled rows, judged on the fifth that it never saw."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(
        "doc_id", "text", F.col("quality").alias("label"))
    held_out = F.col("doc_id") % 5 == 1
    scored = M.binary_probability(M.train_binary(rows.where(~held_out)), rows.where(held_out)).withColumn(
        "right", ((F.col("probability") > 0.5).cast("int") == F.col("label")).cast("double"))
    return scored.agg(F.count("*").alias("n_held_out"), (F.avg("right") > F.greatest(
        F.avg("label"), 1 - F.avg("label"))).alias("beats_majority"))


@query("type_model_held_out", f"""WITH {CLAUSES_SQL} SELECT count(*) AS n_held_out, true AS nine_of_ten FROM clauses WHERE clause_seq % 5 = 1""")
def type_model_held_out(spark, sf_dir):
    rows = rendered_clauses(spark, sf_dir).select("clause_seq", "text", F.col("clause_type").alias("label"))
    held_out = F.col("clause_seq") % 5 == 1
    scored = M.multiclass_prediction(M.train_multiclass(rows.where(~held_out)), rows.where(held_out))
    return scored.agg(F.count("*").alias("n_held_out"), (F.avg((F.col("predicted") == F.col("label")).cast("double")) >= 0.9).alias("nine_of_ten"))


@query("type_model")
def type_model(spark, sf_dir):
    """Multinomial logistic regression over clause texts of twelve types."""
    rows = rendered_clauses(spark, sf_dir).select("clause_seq", "text", F.col("clause_type").alias("label"))
    scored = M.multiclass_prediction(M.train_multiclass(rows), rows)
    return scored.select("clause_seq", "label", "predicted")


@query("text_embeddings", "SELECT doc_id, 384 AS dimension, 1.0::DOUBLE AS norm FROM documents")
def text_embeddings(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    vec = M.encode(M.encoder(docs), docs)
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return vec.select("doc_id", F.size("vec").alias("dimension"), F.round(norm, 3).alias("norm"))


_SCHEMA = f"(SELECT * FROM {sql_values(schema_rows(), 'clause_type, var_name, var_type, pos')})"


def _prompt_rows(spark, sf_dir):
    clauses = rendered_clauses(spark, sf_dir).select("clause_seq", "clause_type", "text")
    rows = X.clause_variables(clauses).where("var_type = 'String'")
    prompt = S.prompt_for(F.col("var_name"), F.col("var_type"), F.col("text"))
    return rows.withColumn("prompt", prompt).withColumn(
        "cache_key", S.variable_key(F.col("prompt"), F.col("var_name"), F.col("var_type")))


_PROMPT_SQL = f"""{CLAUSES_SQL},
prompts AS (SELECT c.clause_seq, s.var_name, s.var_type, c.text,
    'Copy the exact wording for ' || s.var_name || '; answer null when it is absent.' || chr(10) || 'Text: ' || c.text
    || chr(10) || 'Answer:' AS prompt FROM clauses c JOIN {_SCHEMA} s USING (clause_type) WHERE s.var_type = 'String'),
keyed AS (SELECT *, sha256(prompt)[1:16] || '|' || var_name || '|' || var_type AS cache_key FROM prompts)"""


@query("extraction_prompts", f"""WITH {_PROMPT_SQL} SELECT clause_seq, var_name, length(prompt) AS prompt_length, cache_key FROM keyed""")
def extraction_prompts(spark, sf_dir):
    return _prompt_rows(spark, sf_dir).select("clause_seq", "var_name", F.length("prompt").alias("prompt_length"), "cache_key")


def length_scorer(batches):
    """Deterministic stand-in for a model: the length of the prompt."""
    for b in batches:
        yield pd_response(b)


def pd_response(batch):
    batch = batch.assign(response="length " + batch["prompt"].str.len().astype(str))
    return batch[["cache_key", "response"]]


@query("response_cache", f"""WITH {_PROMPT_SQL},
d AS (SELECT cache_key, min(prompt) AS prompt, min(clause_seq) AS s FROM keyed GROUP BY cache_key)
SELECT k.clause_seq, k.var_name, k.cache_key, CASE WHEN d.s % 2 = 0 THEN 'cached' ELSE 'length ' || length(d.prompt) END AS response, d.s % 2 = 0 AS is_hit
FROM keyed k JOIN d USING (cache_key)""")
def response_cache(spark, sf_dir):
    """Prompts already answered are reused, each other distinct prompt is scored once."""
    prompts = _prompt_rows(spark, sf_dir)
    cache = prompts.groupBy("cache_key").agg(F.min("clause_seq").alias("s")).where("s % 2 = 0").select(
        "cache_key", F.lit("cached").alias("response"))
    responses, _ = S.cached_responses(prompts.select("cache_key", "prompt"), cache, length_scorer)
    return prompts.join(responses, "cache_key").select("clause_seq", "var_name", "cache_key", "response", "is_hit")


# --- the whole extraction with a scorer -----------------------------------------------------

_FILLER = "Both sides agree to the terms that follow here. "
_UNNAMED = "The sides are named on the first page."


def wording_scorer(batches):
    """Deterministic stand-in for a model: copies wording from the prompt's own window."""
    fixed = {"CapPeriod": "12 months", "InsurancePeriod": "during the term", "hasRevenueSharing": "Yes.",
             "minimumCommitmentVolume": "1,200 units", "insuranceCalculationBasis": "Based on the text it is unclear",
             "parties": "NONE"}

    def answer(key, prompt):
        name = key.split("|")[1]
        if name == "governingLaw":
            found = re.search(r"laws of \w+(?=\.)", prompt)
            if found and found.group().endswith("7"):
                return f"The parties describe it as {found.group()}"
            return f'"{found.group()}"' if found else "not found"
        return fixed.get(name, "null")

    for b in batches:
        yield b.assign(response=[answer(k, p) for k, p in zip(b["cache_key"], b["prompt"])])[["cache_key", "response"]]


def _documents_of_clauses(spark, sf_dir):
    """Clauses with context and answer; half of the governing laws stand behind several windows of text."""
    recital = F.concat(
        F.lit(_FILLER * 10), F.lit("This Agreement is made by and between "), F.initcap("c_mktsegment"),
        F.lit(" Trading Corporation and "), F.col("side"), F.lit(" Supply Corporation WHEREAS both agree."),
        F.repeat(F.lit(" and so on"), F.col("clause_seq") % 5))
    unnamed = F.pmod("o_custkey", F.lit(5)) == 0
    late = (F.col("kind") == 9) & (F.pmod("clause_seq", F.lit(2)) == 1)
    return rendered_clauses(spark, sf_dir).select(
        "contract_id", "clause_type", "clause_seq",
        F.when(F.col("kind") != 8, recital).when(unnamed, _UNNAMED).otherwise(F.col("text")).alias("context"),
        F.when(late, F.concat(F.repeat(F.lit(_FILLER), F.lit(45)), "text")).when(
            F.col("kind") != 8, F.col("text")).alias("answer_text"))


@query("extraction_with_model", f"""WITH {RAW_SQL},
src AS (SELECT clause_seq, o_custkey, n_name, CASE WHEN kind = 9 AND clause_seq % 2 = 1 THEN repeat('{_FILLER}', 45) || text
    WHEN kind = 8 AND o_custkey % 5 = 0 THEN '{_UNNAMED}' ELSE text END AS shown,
  repeat('{_FILLER}', 10) || 'This Agreement is made by and between ' || seg || ' Trading Corporation and ' || side ||
    ' Supply Corporation WHEREAS both agree.' || repeat(' and so on', (clause_seq % 5)::INT) AS context,
  seg || ' Trading Corporation|' || side || ' Supply Corporation' AS both_names FROM clauses),
model AS (SELECT e.* REPLACE (
    CASE WHEN var_name = 'CapPeriod' THEN 12 WHEN kind <> 6 THEN v_dur_amount END AS v_dur_amount,
    CASE WHEN var_name = 'CapPeriod' THEN 'Months' WHEN kind <> 6 THEN v_dur_unit END AS v_dur_unit,
    CASE WHEN var_name = 'hasRevenueSharing' THEN true ELSE v_bool END AS v_bool,
    CASE WHEN var_name = 'minimumCommitmentVolume' THEN 1200.0::DOUBLE ELSE v_double END AS v_double),
  CASE WHEN var_name = 'governingLaw' AND n_name NOT LIKE '%7' THEN 'laws of ' || n_name END AS v_string,
  CASE WHEN var_type = 'Party[]' AND o_custkey % 5 <> 0 THEN both_names END AS v_parties,
  CASE WHEN var_name = 'nonCompeteDuration' THEN 'denied_by_has' WHEN var_name = 'InsurancePeriod' THEN 'unknown_unit' END AS nulled_by,
  shown FROM expected_raw e JOIN src USING (clause_seq)),
judged AS (SELECT *, coalesce(v_string, v_parties, v_dur_unit, v_bool::VARCHAR, v_double::VARCHAR, v_amount::VARCHAR, v_date::VARCHAR) IS NOT NULL AS is_set FROM model),
kept AS (SELECT * FROM (SELECT clause_seq, contract_id, clause_type, any_value(shown) AS shown FROM judged GROUP BY ALL HAVING bool_or(is_set))
  QUALIFY row_number() OVER (PARTITION BY contract_id, clause_type, shown ORDER BY clause_seq) = 1),
fallback AS (SELECT c.contract_id, c.clause_seq, c.clause_type, both_names FROM clauses c JOIN src USING (clause_seq)
  JOIN (SELECT * FROM {sql_values([(k, v) for k, v in type_positions().items()], "clause_type, type_pos")}) USING (clause_type)
  WHERE kind <> 8 AND c.contract_id NOT IN (SELECT contract_id FROM kept WHERE clause_type = 'parties')
  QUALIFY row_number() OVER (PARTITION BY c.contract_id ORDER BY length(context) DESC, type_pos, c.clause_seq) = 1)
SELECT j.contract_id, j.clause_seq, j.clause_type, var_name, is_set, v_string, v_bool, v_double, strftime(v_date, '%Y-%m-%d') AS v_date,
  v_amount, v_dur_amount, v_dur_unit, v_parties, nulled_by, NULL AS source_clause FROM judged j SEMI JOIN kept k ON k.clause_seq = j.clause_seq
UNION ALL SELECT contract_id, clause_seq, 'parties', 'parties', true, NULL, NULL, NULL, NULL, NULL, NULL, NULL, both_names, NULL, clause_type FROM fallback""")
def extraction_with_model(spark, sf_dir):
    """Patterns, model answers over windows, rules and fallback parties in one run over all contracts."""
    rows, _ = A.extract_with_model(_documents_of_clauses(spark, sf_dir), wording_scorer)
    return X.to_long(rows).select(
        "contract_id", "clause_seq", "clause_type", "var_name", "is_set", "v_string", "v_bool", "v_double",
        F.col("v_date").cast("string").alias("v_date"), "v_amount", "v_dur_amount", "v_dur_unit",
        F.array_join("v_parties", "|").alias("v_parties"), "nulled_by", "source_clause")


@query("prompt_windows", """WITH d AS (SELECT doc_id, text, greatest(ceil((length(text) - 200) / 800.0) - 1, 0)::BIGINT AS last FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, text, unnest(generate_series(0, last)) AS "window" FROM d)
SELECT doc_id, "window", length(text[("window" * 800 + 1):("window" * 800 + 1000)]) AS n_chars, md5(text[("window" * 800 + 1):("window" * 800 + 1000)]) AS window_md5 FROM w""")
def prompt_windows(spark, sf_dir):
    """The windows that a model is asked about, over whole texts of any length."""
    cut = A.windows(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return cut.select("doc_id", "window", F.length("window_text").alias("n_chars"), F.md5("window_text").alias("window_md5"))
