"""Queries over the question/answer corpus, text predicates and sinks."""

from __future__ import annotations


from pyspark.sql import functions as F

from clauseloom.corpus_model import CLAUSES_SQL, KINDS, rendered_clauses
from clauseloom.functions import text as X
from clauseloom.lookups import CLAUSE_MAPPINGS, ROUTING_STOPWORDS
from clauseloom.operators import corpus as C
from clauseloom.operators.numbering import running_number
from clauseloom.plans.registry import query
from clauseloom.session import scratch_path, table
from clauseloom.sources import readers, writers

_LABELS = {kind: label for label, kind in CLAUSE_MAPPINGS}
_KIND_LABELS = [_LABELS[k] for k in KINDS]
_SQL_LABEL = "([" + ", ".join("'" + l + "'" for l in _KIND_LABELS) + "])[kind + 1]"
_SQL_SPLIT = "CASE WHEN clause_seq % 5 = 0 THEN 'test' ELSE 'train' END"

# Expected samples: questions that could not be answered are judged on clause_seq % 7.
SAMPLES_SQL = f"""{CLAUSES_SQL},
samples AS (
  SELECT {_SQL_SPLIT} AS split, contract_id AS title,
    CASE WHEN clause_seq % 3 = 0 THEN clause_seq || '_0_0' ELSE 'Q_' || o_custkey || '_' || clause_seq END AS contract_id,
    text AS context, 'Highlight the parts related to "' || {_SQL_LABEL} || '"' AS question, clause_type,
    clause_seq % 7 > 3 AS has_answer, CASE WHEN clause_seq % 7 > 3 THEN text END AS answer_text,
    CASE WHEN clause_seq % 7 > 3 THEN 0 END AS answer_start, clause_seq, o_custkey,
    CASE clause_seq % 7 WHEN 0 THEN 'N/A' WHEN 1 THEN 'none' WHEN 2 THEN '.' WHEN 3 THEN NULL ELSE text END AS first_answer
  FROM clauses
)"""


def nested_corpus(spark, sf_dir):
    """The rendered clauses as nested contract records, one per clause."""
    c = rendered_clauses(spark, sf_dir)
    label = F.element_at(F.array(*[F.lit(l) for l in _KIND_LABELS]), F.col("kind") + 1)
    m = F.pmod("clause_seq", F.lit(7))
    text = F.when(m == 0, "N/A").when(m == 1, "none").when(m == 2, ".").otherwise(F.col("text"))
    answer = F.struct(text.alias("text"), F.lit(0).alias("answer_start"))
    answers = F.when(m == 3, F.array().cast("array<struct<text:string,answer_start:int>>")).otherwise(F.array(answer))
    qa = F.struct(
        F.when(F.col("clause_seq") % 3 != 0, F.concat_ws("_", F.lit("Q"), "o_custkey", "clause_seq")).alias("id"),
        F.concat(F.lit('Highlight the parts related to "'), label, F.lit('"')).alias("question"),
        answers.alias("answers"))
    return c.select(
        F.col("clause_seq").alias("idx"), F.col("contract_id").alias("title"),
        F.array(F.struct(F.col("text").alias("context"), F.array(qa).alias("qas"))).alias("paragraphs"))


def corpus_samples(spark, sf_dir):
    """Flattened samples with their split, without a trip through files."""
    docs = nested_corpus(spark, sf_dir).withColumn(
        "split", F.when(F.col("idx") % 5 == 0, "test").otherwise("train")).withColumn("clause_seq", F.col("idx"))
    return C.route_and_answer(C.flatten_corpus(docs))


_FLAT = ["contract_id", "title", "context", "question", "clause_type", "has_answer", "answer_text", "answer_start"]
_FLAT_SQL = ", ".join(_FLAT)


@query("corpus_read_nested", f"WITH {SAMPLES_SQL} SELECT {_FLAT_SQL} FROM samples")
def corpus_read_nested(spark, sf_dir):
    """Write nested JSON records, read them with the fixed schema, flatten and route."""
    path = scratch_path(spark, "qa")
    nested_corpus(spark, sf_dir).write.json(path)
    return C.route_and_answer(readers.read_qa_corpus(spark, path)).select(*_FLAT)


@query("corpus_read_splits", f"""WITH {SAMPLES_SQL}
SELECT 'main' AS split, contract_id, question, has_answer FROM samples
UNION ALL SELECT split, contract_id, question, has_answer FROM samples WHERE split = 'test'""")
def corpus_read_splits(spark, sf_dir):
    """Two of the three split files exist; the missing one is skipped."""
    folder = scratch_path(spark, "splits")
    docs = nested_corpus(spark, sf_dir)
    docs.write.json(f"{folder}/CUADv1.json")
    docs.where("idx % 5 = 0").write.json(f"{folder}/test.json")
    return C.route_and_answer(readers.read_splits(spark, folder)).select(
        "split", "contract_id", "question", "has_answer")


_PROCESSED_SQL = f"""WITH {SAMPLES_SQL}
SELECT split, contract_id, CASE WHEN len(string_split(contract_id, '_')) >= 3 THEN string_split(contract_id, '_')[1]
  ELSE contract_id END AS base_contract_id, title, context, question, clause_type, has_answer,
  coalesce(answer_text, '') AS answer_text, answer_start, len(string_split(context, ' ')) AS context_length,
  CASE WHEN has_answer THEN len(string_split(answer_text, ' ')) ELSE 0 END AS answer_length, false AS was_truncated
FROM samples"""


@query("processed_table_round_trip", _PROCESSED_SQL)
def processed_table_round_trip(spark, sf_dir):
    """Processed rows written per split and read back with fixed types."""
    path = scratch_path(spark, "processed")
    writers.write_processed(C.processed_rows(corpus_samples(spark, sf_dir)), path)
    return readers.read_processed(spark, path)


@query("processed_rows", _PROCESSED_SQL.replace("coalesce(answer_text, '') AS answer_text", "answer_text"))
def processed_rows(spark, sf_dir):
    return C.processed_rows(corpus_samples(spark, sf_dir))


@query("clause_datasets_round_trip", f"""WITH {SAMPLES_SQL},
ok AS (SELECT DISTINCT split, clause_type FROM samples WHERE has_answer)
SELECT s.split, s.clause_type, s.contract_id, s.has_answer FROM samples s SEMI JOIN ok USING (split, clause_type)""")
def clause_datasets_round_trip(spark, sf_dir):
    path = scratch_path(spark, "clause-datasets")
    writers.write_clause_datasets(C.clause_datasets(C.processed_rows(corpus_samples(spark, sf_dir))), path)
    return spark.read.parquet(path).select("split", "clause_type", "contract_id", "has_answer")


@query("training_samples_round_trip", f"""WITH {SAMPLES_SQL}
SELECT split, 'binary' AS task, question || ' [SEP] ' || context AS text, has_answer::INT::VARCHAR AS label FROM samples
UNION ALL SELECT split, 'multiclass', question || ' [SEP] ' || context, clause_type FROM samples""")
def training_samples_round_trip(spark, sf_dir):
    path = scratch_path(spark, "samples")
    writers.write_training_samples(C.training_samples(corpus_samples(spark, sf_dir)), path)
    return spark.read.schema(
        "text string, contract_id string, clause_type string, has_answer boolean, label string, split string, task string"
    ).json(path).select("split", "task", "text", "label")


@query("training_samples", f"""WITH {SAMPLES_SQL}
SELECT contract_id, question || ' [SEP] ' || context AS text, has_answer::INT AS binary_label, clause_type FROM samples""")
def training_samples(spark, sf_dir):
    return C.training_samples(corpus_samples(spark, sf_dir)).select("contract_id", "text", "binary_label", "clause_type")


@query("multiclass_training_rows", f"""WITH {SAMPLES_SQL}
SELECT clause_seq FROM samples WHERE clause_seq % 11 <> 0 AND (clause_seq % 4 = 0 OR has_answer)""")
def multiclass_training_rows(spark, sf_dir):
    """Label ``unknown`` and unanswered rows drop; a missing flag counts as answered."""
    rows = corpus_samples(spark, sf_dir).select(
        "clause_seq", F.when(F.col("clause_seq") % 11 == 0, "unknown").otherwise(F.col("clause_type")).alias("label"),
        F.when(F.col("clause_seq") % 4 != 0, F.col("has_answer")).alias("has_answer"))
    return C.multiclass_training_rows(rows).select("clause_seq")


@query("positive_augmentation", f"""WITH {SAMPLES_SQL},
t AS (SELECT clause_seq, has_answer::INT AS label, question || ' [SEP] ' || context AS text, question, context FROM samples),
grown AS (SELECT *, unnest(range(CASE WHEN label = 1 THEN 2 + clause_seq % 2 ELSE 1 END)) AS copy_no FROM t)
SELECT clause_seq, label, copy_no, CASE WHEN copy_no = 0 OR (clause_seq + copy_no) % 3 = 0 THEN text
  WHEN (clause_seq + copy_no) % 3 = 1 THEN question || '? [SEP] ' || context
  ELSE question || ' [SEP] ' || trim(context, '.') || '.' END AS text FROM grown""")
def positive_augmentation(spark, sf_dir):
    rows = C.training_samples(corpus_samples(spark, sf_dir).withColumn("contract_id", F.col("clause_seq"))).select(
        F.col("contract_id").alias("clause_seq"), F.col("binary_label").alias("label"), "text")
    return C.augment_positives(rows, "clause_seq")


@query("split_profile", f"""WITH {SAMPLES_SQL}
SELECT split, count(*) AS total_samples, count(*) FILTER (WHERE has_answer) AS samples_with_answers,
  round(count(*) FILTER (WHERE has_answer) / count(*)::DOUBLE, 6) AS answer_ratio FROM samples GROUP BY split""")
def split_profile(spark, sf_dir):
    return C.split_profile(corpus_samples(spark, sf_dir))


@query("split_top_clause_types", f"""WITH {SAMPLES_SQL},
scoped AS (SELECT split, clause_type, 'all' AS scope FROM samples
  UNION ALL SELECT split, clause_type, 'answered' FROM samples WHERE has_answer),
counts AS (SELECT split, scope, clause_type, count(*) AS n_rows FROM scoped GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY split, scope ORDER BY n_rows DESC, clause_type) AS rank FROM counts
QUALIFY rank <= 15""")
def split_top_clause_types(spark, sf_dir):
    return C.top_clause_types(corpus_samples(spark, sf_dir))


@query("contract_diversity", f"""WITH {SAMPLES_SQL},
b AS (SELECT split, CASE WHEN len(string_split(contract_id, '_')) >= 3 THEN string_split(contract_id, '_')[1]
    ELSE contract_id END AS base, clause_type, has_answer FROM samples),
g AS (SELECT split, base, count(DISTINCT clause_type) FILTER (WHERE has_answer) AS types FROM b GROUP BY ALL)
SELECT split, count(*) AS total_contracts, count(*) FILTER (WHERE types > 0) AS contracts_with_answers,
  count(*) FILTER (WHERE types > 1) AS multi_clause_contracts FROM g GROUP BY split""")
def contract_diversity(spark, sf_dir):
    return C.contract_diversity(corpus_samples(spark, sf_dir))


@query("answer_processing_stats", f"""WITH {SAMPLES_SQL},
c AS (SELECT count(*) AS total_processed, count(first_answer) AS has_answers_list,
  count(*) FILTER (WHERE has_answer) AS valid_answers,
  count(*) FILTER (WHERE first_answer IN ('N/A', 'none', '.')) AS filtered_non_answers, 0 AS filtered_too_short FROM samples)
SELECT *, round(has_answers_list * 100.0::DOUBLE / total_processed, 4) AS has_answers_list_pct,
  round(valid_answers * 100.0::DOUBLE / total_processed, 4) AS valid_answers_pct,
  round(filtered_non_answers * 100.0::DOUBLE / total_processed, 4) AS filtered_non_answers_pct,
  0.0::DOUBLE AS filtered_too_short_pct FROM c""")
def answer_processing_stats(spark, sf_dir):
    return C.answer_stats(corpus_samples(spark, sf_dir))


@query("clause_dataset_stats", f"""WITH {SAMPLES_SQL}
SELECT split, clause_type, count(*) AS total_rows, count(*) FILTER (WHERE has_answer) AS answered_rows,
  count(DISTINCT CASE WHEN len(string_split(contract_id, '_')) >= 3 THEN string_split(contract_id, '_')[1]
    ELSE contract_id END) AS contracts FROM samples GROUP BY split, clause_type HAVING answered_rows > 0""")
def clause_dataset_stats(spark, sf_dir):
    return C.clause_dataset_stats(C.processed_rows(corpus_samples(spark, sf_dir)))


_CANDIDATES = ["", "N/A", "none", ".", "x", "Not Specified", "--", "no applicable.", "  null ", "n/a.", None, "not foundation"]


@query("answer_selection", f"""WITH {CLAUSES_SQL}
SELECT clause_seq, CASE WHEN kind = 11 THEN 'not foundation' ELSE text END AS answer_text,
  CASE WHEN kind = 11 THEN 0 ELSE 7 END AS answer_start FROM clauses""")
def answer_selection(spark, sf_dir):
    """First valid answer after one that must be passed over."""
    first = F.element_at(F.array(*[F.lit(c) for c in _CANDIDATES]), F.col("kind") + 1)
    answers = F.array(F.struct(first.alias("text"), F.lit(0).alias("answer_start")),
                      F.struct(F.col("text").alias("text"), F.lit(7).alias("answer_start")))
    return rendered_clauses(spark, sf_dir).withColumn("a", X.first_valid_answer(answers)).select(
        "clause_seq", F.col("a.text").alias("answer_text"), F.col("a.answer_start").alias("answer_start"))


@query("non_answer_test", """SELECT doc_id, regexp_matches(trim(lower(probe)), '^(no\\.?|none\\.?|not?\\s+applicable\\.?|n/?a\\.?|not?\\s+(mentioned|specified|provided|found|included)\\.?|\\s*|\\.+|-+|null|not disclosed|is not mentioned|does not specify)$') AS is_non_answer
FROM (SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'No.' WHEN 1 THEN 'Not Mentioned' WHEN 2 THEN '-----' WHEN 3 THEN 'NULL'
  WHEN 4 THEN 'none of it' WHEN 5 THEN 'Not disclosed' WHEN 6 THEN 'north' ELSE text END AS probe FROM documents)""")
def non_answer_test(spark, sf_dir):
    m = F.pmod("doc_id", F.lit(8))
    probe = (F.when(m == 0, "No.").when(m == 1, "Not Mentioned").when(m == 2, "-----").when(m == 3, "NULL")
             .when(m == 4, "none of it").when(m == 5, "Not disclosed").when(m == 6, "north").otherwise(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", X.is_non_answer(probe).alias("is_non_answer"))


def _routing_case(expr: str) -> str:
    first = " ".join(f"WHEN contains({expr}, '{label.lower()}') THEN '{kind}'" for label, kind in CLAUSE_MAPPINGS)
    second = []
    for label, kind in CLAUSE_MAPPINGS:
        keys = [w for w in label.lower().replace("-", " ").split() if w not in ROUTING_STOPWORDS]
        hits = " + ".join(f"contains({expr}, '{k}')::INT" for k in keys)
        second.append(f"WHEN {hits} >= {len(keys)} * 0.7 THEN '{kind}'")
    return f"CASE {first} {' '.join(second)} ELSE 'unknown' END"


@query("question_routing", f"""WITH {CLAUSES_SQL},
q AS (SELECT clause_seq, CASE clause_seq % 4 WHEN 0 THEN 'Highlight "' || {_SQL_LABEL} || '"'
  WHEN 1 THEN 'Is there a ' || reverse(reverse(lower(replace({_SQL_LABEL}, ' ', ' and its ')))) || ' in it?'
  WHEN 2 THEN 'What do the Parties say on ' || {_SQL_LABEL} || '?' ELSE 'Anything else in ' || n_name || '?' END AS question
  FROM clauses)
SELECT clause_seq, {_routing_case('lower(question)')} AS clause_type FROM q""")
def question_routing(spark, sf_dir):
    label = F.element_at(F.array(*[F.lit(l) for l in _KIND_LABELS]), F.col("kind") + 1)
    m = F.pmod("clause_seq", F.lit(4))
    question = (
        F.when(m == 0, F.concat(F.lit('Highlight "'), label, F.lit('"')))
        .when(m == 1, F.concat(F.lit("Is there a "), F.lower(F.regexp_replace(label, " ", " and its ")), F.lit(" in it?")))
        .when(m == 2, F.concat(F.lit("What do the Parties say on "), label, F.lit("?")))
        .otherwise(F.concat(F.lit("Anything else in "), F.col("n_name"), F.lit("?"))))
    return rendered_clauses(spark, sf_dir).withColumn("question", question).select(
        "clause_seq", X.clause_type_of(F.col("question")).alias("clause_type"))


@query("question_routing_longest", f"""WITH {CLAUSES_SQL} SELECT clause_seq, clause_type FROM clauses""")
def question_routing_longest(spark, sf_dir):
    """With the longest label preferred, a mention of "Parties" no longer captures a question."""
    label = F.element_at(F.array(*[F.lit(l) for l in _KIND_LABELS]), F.col("kind") + 1)
    question = F.when(F.col("clause_type") == "insurance", F.lit("What Insurance must be held?")).otherwise(
        F.concat(F.lit("What do the Parties say on "), label, F.lit("?")))
    return rendered_clauses(spark, sf_dir).withColumn("question", question).select(
        "clause_seq", X.clause_type_of(F.col("question"), match="longest").alias("clause_type"))


@query("question_routing_by_pattern", f"""WITH {CLAUSES_SQL} SELECT clause_seq,
CASE WHEN clause_seq % 2 = 0 THEN clause_type ELSE 'unknown' END AS clause_type FROM clauses""")
def question_routing_by_pattern(spark, sf_dir):
    label = F.element_at(F.array(*[F.lit(l) for l in _KIND_LABELS]), F.col("kind") + 1)
    hyphenated = F.regexp_replace(label, "^(.)", "$1$1")
    question = F.when(F.col("clause_seq") % 2 == 0, F.concat(F.lit('related to "'), label, F.lit('" that should'))
                      ).otherwise(F.concat(F.lit("on "), hyphenated.substr(1, 1), F.lit(" nothing")))
    return rendered_clauses(spark, sf_dir).withColumn("question", question).select(
        "clause_seq", X.clause_type_by_pattern(F.col("question"), ['related to "([^"]+)"']).alias("clause_type"))


@query("text_cleaning", f"""WITH {CLAUSES_SQL}
SELECT clause_seq, CASE WHEN clause_seq % 8 = 3 THEN '$ ' ELSE '' END || text AS cleaned FROM clauses""")
def text_cleaning(spark, sf_dir):
    """The bare star pattern comes first in the list, so "$[***]" leaves its dollar sign."""
    t = F.col("text")
    noisy = [F.concat(F.lit("Page 3 of 12 "), t), F.concat(t, F.lit(" [***]")), F.concat(F.lit("  "), t, F.lit("\t\n")),
             F.concat(F.lit("$[*****] "), t), F.concat(F.lit("(****)"), t), F.concat(F.lit("[...***...] "), t),
             F.regexp_replace(t, " ", "   "), F.concat(t, F.lit(" page 1 OF 2"))]
    pick = F.element_at(F.array(*noisy), (F.pmod("clause_seq", F.lit(8)) + 1).cast("int"))
    return rendered_clauses(spark, sf_dir).withColumn("noisy", pick).select(
        "clause_seq", X.clean_text(F.col("noisy")).alias("cleaned"))


_WORDS_SQL = "list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')"


@query("word_truncation", f"""WITH d AS (SELECT doc_id, text, {_WORDS_SQL} AS w FROM documents)
SELECT doc_id, len(w) AS n_words, len(w) > 2048 AS was_truncated,
  md5(CASE WHEN len(w) > 2048 THEN array_to_string(w[1:2048], ' ') ELSE text END) AS context_hash,
  md5(CASE WHEN len(w) > 400 THEN array_to_string(w[1:400], ' ') ELSE text END) AS embed_hash,
  md5('Which law? [SEP] ' || CASE WHEN len(w) > 375 THEN array_to_string(w[1:375], ' ') ELSE text END) AS model_hash FROM d""")
def word_truncation(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    joined = F.concat(F.lit("Which law? [SEP] "), F.col("text"))
    return docs.select(
        "doc_id", X.word_count(F.col("text")).alias("n_words"), (X.word_count(F.col("text")) > 2048).alias("was_truncated"),
        F.md5(X.truncate_words(F.col("text"), 2048)).alias("context_hash"),
        F.md5(X.truncate_words(F.col("text"), 400)).alias("embed_hash"), F.md5(X.model_input(joined)).alias("model_hash"))


@query("contract_id_bases", """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'A' || o_custkey WHEN 1 THEN
  'CONTRACT_' || o_custkey ELSE 'ONE' || o_custkey END AS base_id, CASE o_orderkey % 3 WHEN 0 THEN 'DEAL_' || o_custkey
  WHEN 1 THEN 'DEAL_' || o_custkey || '__X9' ELSE 'DEAL' || o_custkey END AS normal_id FROM orders""")
def contract_id_bases(spark, sf_dir):
    m, k = F.pmod("o_orderkey", F.lit(3)), F.col("o_custkey")
    base = (F.when(m == 0, F.concat(F.lit("A"), k, F.lit("_b_c"))).when(m == 1, F.concat(F.lit("CONTRACT_"), k))
            .otherwise(F.concat(F.lit("ONE"), k)))
    labelled = (F.when(m == 0, F.concat(F.lit("DEAL_"), k, F.lit("__Governing Law")))
                .when(m == 1, F.concat(F.lit("DEAL_"), k, F.lit("__X9"))).otherwise(F.concat(F.lit(" DEAL"), k)))
    return table(spark, sf_dir, "orders").select("o_orderkey", X.base_contract_id(base).alias("base_id"),
                                                 X.normalized_contract_id(labelled).alias("normal_id"))


@query("embedding_text_choice", """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN trim(text, ' \t\n\r') WHEN 1 THEN 'q ' || source
  WHEN 2 THEN source ELSE 'empty clause' END AS chosen FROM documents""")
def embedding_text_choice(spark, sf_dir):
    m = F.pmod("doc_id", F.lit(4))
    none = F.lit(None).cast("string")
    primary = F.when(m == 0, F.col("text")).when(m == 1, "nan").otherwise(F.lit("  "))
    qa = F.when(m == 1, F.concat(F.lit(" q "), F.col("source"))).otherwise(none)
    question = F.when(m == 2, F.col("source")).otherwise(F.lit("\t"))
    return table(spark, sf_dir, "documents").select("doc_id", X.embedding_text(primary, qa, question).alias("chosen"))


@query("extraction_text_choice", f"""WITH {CLAUSES_SQL}
SELECT clause_seq, CASE kind WHEN 8 THEN text || repeat(' x', 10) WHEN 0 THEN 'answer ' || clause_seq || ' given'
  WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE text END AS chosen FROM clauses""")
def extraction_text_choice(spark, sf_dir):
    kind = F.col("kind")
    context = F.when(kind == 8, F.concat(F.col("text"), F.lit(" x" * 10))).otherwise(F.col("text"))
    answer = (F.when(kind == 0, F.concat(F.lit("answer "), F.col("clause_seq"), F.lit(" given "))).when(kind == 1, "short")
              .when(kind == 2, "nan"))
    return rendered_clauses(spark, sf_dir).select(
        "clause_seq", X.extraction_text(F.col("clause_type"), context, answer).alias("chosen"))


@query("global_clause_numbers", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'main_' ELSE 'test_' END
  || (row_number() OVER (ORDER BY o_orderkey) - 1) AS clause_id FROM orders""")
def global_clause_numbers(spark, sf_dir):
    numbered = running_number(table(spark, sf_dir, "orders"), [], "o_orderkey", "n")
    split = F.when(F.col("o_orderstatus") == "F", "main").otherwise("test")
    return numbered.select("o_orderkey", F.concat_ws("_", split, (F.col("n") - 1).cast("string")).alias("clause_id"))


@query("file_inventory", """SELECT '.parquet' AS extension, count(DISTINCT o_orderstatus) AS n_files, true AS has_bytes FROM orders
UNION ALL SELECT '.json', count(DISTINCT o_orderpriority), true FROM orders""")
def file_inventory(spark, sf_dir):
    """Files by extension, of orders written one file per status and one per priority."""
    folder, orders = scratch_path(spark, "inventory"), table(spark, sf_dir, "orders")
    orders.repartition("o_orderstatus").write.partitionBy("o_orderstatus").parquet(f"{folder}/a")
    orders.select("o_orderkey", "o_orderpriority").repartition("o_orderpriority").write.partitionBy("o_orderpriority").json(f"{folder}/b")
    found = readers.file_inventory(spark, folder).where("extension IN ('.parquet', '.json')")
    return found.select("extension", "n_files", (F.col("n_bytes") > 0).alias("has_bytes"))


@query("newest_extraction_file", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'")
def newest_extraction_file(spark, sf_dir):
    """Two runs written one after the other, each as many files; the rows of the newest are read back."""
    folder, orders = scratch_path(spark, "newest"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    for name, rows in (("run-1", orders.where("o_orderstatus <> 'F'")), ("run-2", orders.where("o_orderstatus = 'F'"))):
        rows.drop("o_orderstatus").write.parquet(f"{folder}/{name}")
    return spark.read.parquet(readers.newest_run(spark, folder, "*.parquet").first()["path"])


@query("metrics_long_form", f"""WITH {SAMPLES_SQL},
c AS (SELECT clause_type AS category, count(*) AS count, count(*) FILTER (WHERE has_answer)::DOUBLE AS answered,
  round(count(*) FILTER (WHERE has_answer) / count(*)::DOUBLE, 6) AS rate FROM samples GROUP BY clause_type)
SELECT 'corpus' AS component, 'answered' AS metric_type, category, answered AS value, count FROM c
UNION ALL SELECT 'corpus', 'rate', category, rate, count FROM c""")
def metrics_long_form(spark, sf_dir):
    per_type = corpus_samples(spark, sf_dir).groupBy("clause_type").agg(
        F.count("*").alias("n"), F.count_if("has_answer").alias("answered"),
        F.round(F.count_if("has_answer") / F.count("*"), 6).alias("rate"))
    return writers.long_metrics(per_type, "corpus", "clause_type", "n")


@query("extraction_file_shapes", f"""WITH {CLAUSES_SQL}
SELECT clause_seq::VARCHAR AS seq, contract_id, clause_type, text AS original_text FROM clauses""")
def extraction_file_shapes(spark, sf_dir):
    """The five file shapes, each holding a fifth of the records, read back as one table."""
    folder = scratch_path(spark, "shapes")
    rec = F.to_json(F.struct("contract_id", "clause_type", F.create_map(F.lit("seq"), F.col("clause_seq").cast("string")
                                                                       ).alias("extractions"), F.col("text").alias("original_text")))
    rows = rendered_clauses(spark, sf_dir).select(F.pmod("clause_seq", F.lit(5)).alias("shape"), rec.alias("value"))
    forms = {0: ('{"metadata": {"mode": "debug"}, "extractions": [', "]}"), 1: ('{"results": [', "]}"), 2: ("", ""), 3: ("[", "]")}
    out = None
    for shape, (head, tail) in forms.items():
        rows.where(F.col("shape") == shape).select(F.concat(F.lit(head), "value", F.lit(tail)).alias("value")).write.text(
            f"{folder}/{shape}")
        docs = spark.read.text(f"{folder}/{shape}")
        part = readers.parse_extraction_documents(docs)
        out = part if out is None else out.unionByName(part)
    lines = rows.where("shape = 4").select(F.explode(F.array(F.col("value"), F.lit('{"broken'))).alias("value"))
    lines.write.text(f"{folder}/lines")
    out = out.unionByName(readers.read_extractions(spark, f"{folder}/lines", "lines"))
    return out.select(F.col("extractions")["seq"].alias("seq"), "contract_id", "clause_type", "original_text")


@query("processed_rows_long_texts", f"""WITH d AS (SELECT doc_id, repeat(text || ' ', 8) AS long FROM documents),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(long, '\\s+'), lambda w: w <> '') AS w FROM d)
SELECT doc_id::VARCHAR AS contract_id, len(w) AS context_length, false AS was_truncated, ceil(len(w) / 490.0)::BIGINT AS n_windows, len(w) AS window_words FROM w""")
def processed_rows_long_texts(spark, sf_dir):
    """Contexts of any length are stored whole, and their samples cover every word of them."""
    samples = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("contract_id"), F.lit("t").alias("title"), F.repeat(F.concat("text", F.lit(" ")), F.lit(8)).alias("context"),
        F.lit("Governing Law?").alias("question"), F.lit("governing_law").alias("clause_type"), F.lit(False).alias("has_answer"),
        F.lit(None).cast("string").alias("answer_text"), F.lit(None).cast("int").alias("answer_start"))
    rows = C.processed_rows(samples).select("contract_id", "context_length", "was_truncated")
    windows = C.training_samples(samples).withColumn("w", F.element_at(F.split("text", r" \[SEP\] ", 2), 2)).withColumn(
        "n", X.clean_word_count(F.col("w")))
    counts = windows.groupBy("contract_id").agg(F.count("*").alias("n_windows"), F.sum("n").alias("window_words"))
    return rows.join(counts, "contract_id")
