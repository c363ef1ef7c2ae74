"""Question/answer corpus: flatten, clean, route, profile, training samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.functions import text as X
from clauseloom.operators.numbering import running_number
from clauseloom.session import stored

QA_SCHEMA = (
    "idx bigint, title string, paragraphs array<struct<context: string, qas: array<struct<"
    "id: string, question: string, answers: array<struct<text: string, answer_start: int>>>>>>"
)


def flatten_corpus(docs: DataFrame) -> DataFrame:
    """Nested contract -> paragraph -> qa records to one row per question.

    ``idx`` is the record's position and only supplies default ids and titles.
    Records without ``paragraphs`` or ``qas`` drop out.
    """
    paragraphs = docs.select(
        "idx", F.coalesce("title", F.concat(F.lit("Contract_"), F.col("idx"))).alias("title"),
        *[c for c in docs.columns if c not in ("idx", "title", "paragraphs")],
        F.posexplode("paragraphs").alias("p_pos", "p"))
    keep = [c for c in paragraphs.columns if c not in ("p", "p_pos")]
    qas = paragraphs.select(*keep, "p_pos", F.coalesce("p.context", F.lit("")).alias("context"),
                            F.posexplode("p.qas").alias("q_pos", "q"))
    return qas.select(
        *[c for c in keep if c != "idx"],
        F.coalesce("q.id", F.concat_ws("_", "idx", "p_pos", "q_pos")).alias("contract_id"),
        "context", F.coalesce("q.question", F.lit("")).alias("question"),
        F.coalesce("q.answers", F.array().cast("array<struct<text:string,answer_start:int>>")).alias("answers"))


def route_and_answer(samples: DataFrame) -> DataFrame:
    """Add clause_type, has_answer, answer_text and answer_start."""
    best = X.first_valid_answer(F.col("answers"))
    return samples.withColumn("clause_type", X.clause_type_of(F.col("question"))).withColumn(
        "best", best).select("*", F.col("best").isNotNull().alias("has_answer"),
                             F.col("best.text").alias("answer_text"),
                             F.col("best.answer_start").alias("answer_start")).drop("best")


def processed_rows(samples: DataFrame, max_words: int | None = None) -> DataFrame:
    """The 12-column processed table (plus ``split`` when present); ``max_words`` cuts the stored context.

    ``context_length`` counts the words of the whole context, cut or not.
    """
    cleaned = samples.withColumn("_context", X.clean_text(F.col("context"))).withColumn(
        "_answer", X.clean_text(F.col("answer_text")))
    extra = ["split"] if "split" in samples.columns else []
    return cleaned.withColumn("_words", X.clean_word_count(F.col("_context"))).select(
        *extra, "contract_id", X.base_contract_id(F.col("contract_id")).alias("base_contract_id"), "title",
        (F.col("_context") if max_words is None else X.truncate_words(F.col("_context"), max_words)).alias("context"),
        X.clean_text(F.col("question")).alias("question"), "clause_type", "has_answer",
        F.col("_answer").alias("answer_text"), "answer_start",
        F.col("_words").alias("context_length"),
        F.coalesce(X.word_count(F.col("_answer")), F.lit(0)).alias("answer_length"),
        (F.lit(False) if max_words is None else F.col("_words") > max_words).alias("was_truncated"))


def training_samples(samples: DataFrame, model_words: int = 512) -> DataFrame:
    """``question [SEP] context`` rows with both labels; unrouted questions drop out.

    A context longer than a model reads gives several rows, ``window_no`` 0, 1, ..., which cover all of it.
    """
    question, context = X.clean_text(F.col("question")), X.clean_text(F.col("context"))
    known = samples.where("clause_type <> 'unknown'").withColumn("_q", question).withColumn("_c", context)
    known = known.select("*", F.posexplode(
        X.word_windows(F.col("_c"), X.sample_context_limit(F.col("_q"), model_words), clean=True)).alias("window_no", "_w"))
    extra = ["split"] if "split" in samples.columns else []
    return known.select(*extra, F.concat(F.col("_q"), F.lit(" [SEP] "), F.col("_w")).alias("text"),
                        F.col("has_answer").cast("int").alias("binary_label"), "clause_type", "contract_id",
                        "has_answer", "window_no")


def multiclass_training_rows(samples: DataFrame) -> DataFrame:
    """Known label and an answer; a missing flag counts as answered."""
    return samples.where((F.col("label") != "unknown") & F.coalesce("has_answer", F.lit(True)))


def augment_positives(samples: DataFrame, key: str, label: str = "label", text: str = "text") -> DataFrame:
    """Each positive gets one or two more copies in one of three surface forms.

    The number of copies and the form follow from the row key, so a rerun gives
    the same rows: 1 + key mod 2 copies, form (key + copy) mod 3.
    """
    copies = F.when(F.col(label) == 1, F.lit(1) + F.pmod(F.col(key), F.lit(2))).otherwise(F.lit(0)).cast("int")
    grown = samples.withColumn("copy_no", F.explode(F.sequence(F.lit(0), copies)))
    parts = F.split(F.col(text), r"\[SEP\]", 2)
    question, context = X.strip(F.get(parts, F.lit(0))), X.strip(F.get(parts, F.lit(1)))
    form = F.pmod(F.col(key) + F.col("copy_no"), F.lit(3))
    asked = F.concat(X.strip(F.regexp_replace(question, r"\?+$", "")), F.lit("? [SEP] "), context)
    closed = F.concat(question, F.lit(" [SEP] "), F.regexp_replace(context, r"^\.+|\.+$", ""), F.lit("."))
    plain = F.concat(question, F.lit(" [SEP] "), context)
    surface = F.when(form == 0, plain).when(form == 1, asked).otherwise(closed)
    return grown.withColumn(text, F.when((F.col("copy_no") == 0) | context.isNull(), F.col(text)).otherwise(surface))


def split_profile(samples: DataFrame) -> DataFrame:
    return samples.groupBy("split").agg(
        F.count("*").alias("total_samples"), F.count_if("has_answer").alias("samples_with_answers"),
        F.round(F.count_if("has_answer") / F.count("*"), 6).alias("answer_ratio"))


def top_clause_types(samples: DataFrame, n: int = 15) -> DataFrame:
    """Most frequent clause types per split, over all and over answered rows."""
    scoped = samples.select("split", "clause_type", F.explode(F.when(
        F.col("has_answer"), F.array(F.lit("all"), F.lit("answered"))).otherwise(F.array(F.lit("all")))).alias("scope"))
    counts = scoped.groupBy("split", "scope", "clause_type").agg(F.count("*").alias("n_rows"))
    ranked = Window.partitionBy("split", "scope").orderBy(F.desc("n_rows"), "clause_type")
    return counts.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= n)


def contract_diversity(samples: DataFrame) -> DataFrame:
    """Contracts, contracts with an answer, contracts with more than one answered type."""
    # One row per (contract, type) first: a contract with very many rows shrinks on the map side.
    typed = samples.withColumn("base", X.base_contract_id(F.col("contract_id"))).groupBy(
        "split", "base", "clause_type").agg(F.max("has_answer").alias("answered"))
    per_contract = typed.groupBy("split", "base").agg(F.count_if("answered").alias("types"))
    return per_contract.groupBy("split").agg(
        F.count("*").alias("total_contracts"), F.count_if(F.col("types") > 0).alias("contracts_with_answers"),
        F.count_if(F.col("types") > 1).alias("multi_clause_contracts"))


def answer_stats(samples: DataFrame) -> DataFrame:
    """Answer-processing counters; rejections are judged on the first answer."""
    first = X.strip(F.coalesce(F.get("answers", F.lit(0))["text"], F.lit("")))
    listed = F.size("answers") > 0
    bad = X.is_non_answer(first)
    counters = {
        "total_processed": F.count("*"),
        "has_answers_list": F.count_if(listed),
        "valid_answers": F.count_if("has_answer"),
        "filtered_non_answers": F.count_if(listed & ~F.col("has_answer") & bad),
        "filtered_too_short": F.count_if(
            listed & ~F.col("has_answer") & ~bad & (F.length(first) < X.MIN_ANSWER_LENGTH)),
    }
    out = samples.agg(*[c.alias(n) for n, c in counters.items()])
    pct = lambda n: F.when(F.col("total_processed") > 0, F.round(F.col(n) * 100.0 / F.col("total_processed"), 4)
                           ).otherwise(0.0)
    return out.select(*counters, *[pct(n).alias(n + "_pct") for n in list(counters)[1:]])


def clause_dataset_stats(rows: DataFrame) -> DataFrame:
    return rows.where("clause_type <> 'unknown'").groupBy("split", "clause_type", "base_contract_id").agg(
        F.count("*").alias("t"), F.count_if("has_answer").alias("a")).groupBy("split", "clause_type").agg(
        F.sum("t").alias("total_rows"), F.sum("a").alias("answered_rows"), F.count("*").alias("contracts")
    ).where("answered_rows > 0")


def clause_datasets(rows: DataFrame) -> DataFrame:
    """All rows of every clause type that has an answered row in its split."""
    answered = rows.where("has_answer AND clause_type <> 'unknown'").select("split", "clause_type").distinct()
    return rows.join(answered, ["split", "clause_type"], "left_semi")


def classified_clauses(scored: DataFrame, order: str) -> DataFrame:
    """Clause records of stage-1 positives with running ids ``{split}_{n}`` over ordered splits.

    ``scored`` needs the processed columns, ``binary_prediction``,
    ``predicted_clause_type``, ``multiclass_confidence``, ``split``, ``split_pos``
    and a unique integer ``order`` that increases with ``split_pos``.
    """
    positive = stored(scored.where("binary_prediction = 1"), "scored")
    numbered = running_number(positive, [], order, "n")
    answer = X.strip(F.coalesce("answer_text", F.lit("")))
    return numbered.withColumn("answer_text", answer).select(
        F.concat_ws("_", "split", (F.col("n") - 1).cast("string")).alias("clause_id"),
        F.col("contract_id").alias("original_id"), "split", "title", "question", "context",
        F.col("clause_type").alias("ground_truth_clause_type"), "predicted_clause_type", "answer_text",
        F.when(F.col("answer_text") != "", F.concat_ws(" ", "question", "answer_text")).otherwise(
            F.col("question")).alias("qa_combination"),
        "binary_prediction", "multiclass_confidence", "context_length",
        X.word_count(F.col("answer_text")).alias("answer_length"))
