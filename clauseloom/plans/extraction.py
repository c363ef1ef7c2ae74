"""Queries over typed extraction; the oracle reads the typed source columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom import lookups
from clauseloom.corpus_model import CLAUSES_SQL, rendered_clauses
from clauseloom.functions import parties as P
from clauseloom.functions import typed as X
from clauseloom.operators import extraction as E
from clauseloom.plans.registry import query
from clauseloom.session import dealt, stored, table

_SCHEMA_VALUES = lookups.sql_values(lookups.schema_rows(), "clause_type, var_name, var_type, pos")

# Every schema variable of every rendered clause with its expected value.
RAW_SQL = f"""{CLAUSES_SQL},
expected_raw AS (
  SELECT c.contract_id, c.clause_seq, c.clause_type, c.text, c.kind, c.n, s.var_name, s.var_type, s.pos,
    CASE WHEN s.var_type = 'DateTime' THEN CAST(o_orderdate AS DATE) END AS v_date,
    CASE WHEN s.var_type = 'MonetaryAmount' THEN o_totalprice END AS v_amount,
    CASE WHEN s.var_type = 'MonetaryAmount' THEN CASE WHEN kind = 11 THEN 'EUR' ELSE 'USD' END END AS v_currency,
    CASE WHEN s.var_type = 'Duration' AND kind IN (4, 6, 7) THEN n END AS v_dur_amount,
    CASE WHEN s.var_type = 'Duration' AND kind = 4 THEN 'Days'
         WHEN s.var_type = 'Duration' AND kind IN (6, 7) THEN 'Months' END AS v_dur_unit,
    CASE WHEN s.var_type = 'Boolean' AND kind = 6 THEN false
         WHEN s.var_type = 'Boolean' AND kind IN (2, 3, 7, 10, 11) THEN true END AS v_bool,
    CASE WHEN s.var_type = 'Double' AND kind = 5 THEN round_even(n / 100.0, 4)::DOUBLE
         WHEN s.var_type = 'Double' AND kind = 10 THEN n::DOUBLE END AS v_double,
    CASE WHEN s.var_type = 'Party[]' THEN seg || ' Trading Corporation' END AS party_1,
    CASE WHEN s.var_type = 'Party[]' THEN side || ' Supply Corporation' END AS party_2
  FROM clauses c JOIN {_SCHEMA_VALUES} ON true
  JOIN (SELECT 1) ON lookup.clause_type = c.clause_type
)"""
RAW_SQL = RAW_SQL.replace(f"JOIN {_SCHEMA_VALUES} ON true\n  JOIN (SELECT 1) ON lookup.clause_type = c.clause_type",
                          f"JOIN (SELECT * FROM {_SCHEMA_VALUES}) s ON s.clause_type = c.clause_type")

# After the rules: a denied clause loses its duration; clauses with no value and
# later clauses that repeat contract, type and text drop out.
LONG_SQL = f"""{RAW_SQL},
expected_rules AS (
  SELECT * REPLACE (CASE WHEN kind = 6 THEN NULL ELSE v_dur_amount END AS v_dur_amount,
                    CASE WHEN kind = 6 THEN NULL ELSE v_dur_unit END AS v_dur_unit)
  FROM expected_raw
),
expected_set AS (
  SELECT *, (v_date IS NOT NULL OR v_amount IS NOT NULL OR v_dur_amount IS NOT NULL OR v_bool IS NOT NULL
             OR v_double IS NOT NULL OR party_1 IS NOT NULL) AS is_set
  FROM expected_rules
),
kept AS (
  SELECT clause_seq FROM clauses WHERE kind <> 9
  QUALIFY row_number() OVER (PARTITION BY contract_id, clause_type, text ORDER BY clause_seq) = 1
),
long AS (SELECT e.* FROM expected_set e SEMI JOIN kept k ON k.clause_seq = e.clause_seq)"""


def rendered_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long extraction table of the rendered corpus."""
    return E.to_long(rendered_extracted(spark, sf_dir))


def rendered_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    clauses = rendered_clauses(spark, sf_dir).select("contract_id", "clause_seq", "clause_type", "text")
    return E.extract_contracts(clauses)


def rendered_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extracted clauses as a written table, for stages that read them several times."""
    return stored(rendered_extracted(spark, sf_dir), "extracted")


@query("clause_corpus_rendered", f"WITH {CLAUSES_SQL} SELECT contract_id, clause_seq, clause_type, text FROM clauses")
def clause_corpus_rendered(spark, sf_dir):
    return rendered_clauses(spark, sf_dir).select("contract_id", "clause_seq", "clause_type", "text")


@query("extract_dates", f"""WITH {CLAUSES_SQL}
SELECT clause_seq, CASE WHEN kind IN (0, 1) THEN strftime(o_orderdate, '%Y-%m-%d') END AS found_date,
  CASE kind WHEN 0 THEN strftime(o_orderdate, '%B %-d, %Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') END AS span
FROM clauses""")
def extract_dates(spark, sf_dir):
    found = rendered_clauses(spark, sf_dir).withColumn("x", X.date_of(F.col("text")))
    return found.select("clause_seq", F.col("x.dt").cast("string").alias("found_date"), F.col("x.span").alias("span"))


@query("extract_money", f"""WITH {CLAUSES_SQL}
SELECT clause_seq, CASE WHEN kind IN (2, 3, 11) THEN o_totalprice END AS amount,
  CASE WHEN kind IN (2, 3) THEN 'USD' WHEN kind = 11 THEN 'EUR' END AS currency
FROM clauses""")
def extract_money(spark, sf_dir):
    found = rendered_clauses(spark, sf_dir).withColumn(
        "x", X.money_of(F.col("text")))
    return found.select("clause_seq", F.col("x.amount").alias("amount"), F.col("x.currency").alias("currency"))


@query("extract_durations", f"""WITH {CLAUSES_SQL}
SELECT clause_seq, CASE WHEN kind IN (4, 6, 7) THEN n END AS amount,
  CASE WHEN kind = 4 THEN 'Days' WHEN kind IN (6, 7) THEN 'Months' END AS unit FROM clauses""")
def extract_durations(spark, sf_dir):
    found = rendered_clauses(spark, sf_dir).withColumn("x", X.duration_of(F.col("text")))
    return found.select("clause_seq", F.col("x.amount").alias("amount"), F.col("x.unit").alias("unit"))


@query("extract_percentages", f"""WITH {CLAUSES_SQL}
SELECT clause_seq, CASE WHEN kind = 5 THEN round_even(n / 100.0, 4)::DOUBLE END AS fraction FROM clauses""")
def extract_percentages(spark, sf_dir):
    found = rendered_clauses(spark, sf_dir).withColumn("x", X.percent_of(F.col("text")))
    return found.select("clause_seq", F.col("x.value").alias("fraction"))


@query("extract_percentages_near_references", f"""WITH {CLAUSES_SQL}
SELECT clause_seq, CASE WHEN n % 2 = 0 THEN NULL ELSE round_even(n / 100.0, 4)::DOUBLE END AS fraction FROM clauses""")
def extract_percentages_near_references(spark, sf_dir):
    """A percent right after a section reference is no percentage; one far from it is."""
    n = F.col("n")
    text = F.when(n % 2 == 0, F.concat(F.lit("See Section "), n.cast("string"), F.lit("% of the whole."))
                  ).otherwise(F.concat(F.lit("Section 4 sets out what each side owes the other: "),
                                       n.cast("string"), F.lit("% of the whole.")))
    found = rendered_clauses(spark, sf_dir).withColumn("x", X.percent_of(text))
    return found.select("clause_seq", F.col("x.value").alias("fraction"))


@query("extract_integers", f"""WITH {CLAUSES_SQL}
SELECT clause_seq, CASE WHEN kind IN (4, 6, 7, 10) THEN n WHEN kind = 0 THEN day(o_orderdate)
  WHEN kind = 11 AND o_totalprice >= 1000000 THEN floor(o_totalprice / 1000000) WHEN kind = 11 AND o_totalprice >= 1000 THEN floor(o_totalprice / 1000)
  WHEN kind = 11 THEN nullif(round(o_totalprice * 100)::BIGINT % 100, 0) END::DOUBLE AS number FROM clauses""")
def extract_integers(spark, sf_dir):
    found = rendered_clauses(spark, sf_dir).withColumn(
        "x", X.integer_of(F.col("text")))
    return found.select("clause_seq", F.col("x.value").alias("number"))


@query("extract_polarity", f"""WITH {CLAUSES_SQL}
SELECT clause_seq, CASE WHEN kind = 6 THEN false WHEN kind IN (2, 3, 7, 10, 11) THEN true END AS polarity
FROM clauses""")
def extract_polarity(spark, sf_dir):
    return rendered_clauses(spark, sf_dir).select("clause_seq", X.polarity_of(F.col("text")).alias("polarity"))


_PARTY_SQL = f"""WITH {CLAUSES_SQL}
SELECT clause_seq, CASE WHEN kind = 8 THEN seg || ' Trading Corporation' END AS party_1,
  CASE WHEN kind = 8 THEN side || ' Supply Corporation' END AS party_2, CASE WHEN kind = 8 THEN 2 END AS n_parties
FROM clauses"""


def _party_columns(df, names):
    return df.withColumn("p", names).select(
        "clause_seq", F.get("p", F.lit(0)).alias("party_1"), F.get("p", F.lit(1)).alias("party_2"),
        F.size("p").alias("n_parties"))


@query("extract_parties_recital", _PARTY_SQL)
def extract_parties_recital(spark, sf_dir):
    df = rendered_clauses(spark, sf_dir)
    return _party_columns(df, P.parties_by_recital(F.col("text")))


@query("extract_parties_cascade", _PARTY_SQL)
def extract_parties_cascade(spark, sf_dir):
    df = rendered_clauses(spark, sf_dir)
    return _party_columns(df, P.parties_of(F.col("text")))


@query("extract_parties_suffix", f"""WITH {CLAUSES_SQL}
SELECT clause_seq, seg || ' Trading Corporation' AS party_1, side || ' Supply Corporation' AS party_2, 2 AS n_parties
FROM clauses""")
def extract_parties_suffix(spark, sf_dir):
    text = F.concat(F.lit('Signed for "'), F.initcap("c_mktsegment"), F.lit(' Trading Corporation" with "'),
                    F.col("side"), F.lit(' Supply Corporation" as witnesses.'))
    return _party_columns(rendered_clauses(spark, sf_dir), P.parties_by_suffix(text))


@query("party_name_validity", f"""WITH {CLAUSES_SQL}
SELECT clause_seq, kind IN (0, 1, 2) AS is_valid FROM clauses""")
def party_name_validity(spark, sf_dir):
    seg = F.initcap("c_mktsegment")
    names = [
        F.concat(seg, F.lit(" Trading Corporation")), F.concat(F.col("side"), F.lit(" Holdings")),
        F.concat(seg, F.lit(" Supply Inc")), F.lit("Delaware Corporation"), F.concat(F.lit("the "), seg, F.lit(" Company")),
        seg, F.lit("Company LLC"), F.concat(seg, F.lit(" 123456789 Inc")), F.lit("Co"),
        F.concat(seg, F.lit(" Agreement Company")), F.concat(F.lit("and "), seg, F.lit(" Limited")),
        F.concat(seg, F.lit(" a corporation")),
    ]
    name = F.element_at(F.array(*names), F.col("kind") + 1)
    return rendered_clauses(spark, sf_dir).select("clause_seq", P.is_valid_party_name(name).alias("is_valid"))


@query("currency_detection", f"""WITH {CLAUSES_SQL}
SELECT clause_seq, (['EUR', 'GBP', 'CAD', 'USD', 'EUR', 'GBP', 'JPY', 'INR', 'ILS', 'USD', 'CHF', 'EUR'])[kind + 1]
  AS currency FROM clauses""")
def currency_detection(spark, sf_dir):
    m = F.format_number("o_totalprice", 2)
    forms = [F.concat(F.lit(a), m, F.lit(b)) for a, b in [
        ("EUR ", ""), ("", " gbp due"), ("CAD ", " in cash"), ("$", ""), ("€", ""), ("£", " due"), ("¥", ""),
        ("₹", ""), ("₪", ""), ("about ", " in all"), ("fee of ", " CHF"), ("$1 or EUR ", "")]]
    text = F.element_at(F.array(*forms), F.col("kind") + 1)
    return rendered_clauses(spark, sf_dir).select("clause_seq", X.currency_of(text).alias("currency"))


@query("clause_variable_join", f"""WITH {CLAUSES_SQL}
SELECT c.clause_seq, s.var_name, s.var_type, s.pos FROM clauses c
JOIN (SELECT * FROM {_SCHEMA_VALUES}) s ON s.clause_type = c.clause_type""")
def clause_variable_join(spark, sf_dir):
    return E.clause_variables(rendered_clauses(spark, sf_dir).select("clause_seq", "clause_type")).select(
        "clause_seq", "var_name", "var_type", "pos")


@query("consistency_rules", f"""WITH {RAW_SQL}
SELECT clause_seq, var_name,
  CASE WHEN kind = 6 AND var_name = 'nonCompeteDuration' THEN 'denied_by_has' END AS nulled_by,
  CASE WHEN kind = 6 THEN NULL ELSE v_dur_amount END AS v_dur_amount, v_bool
FROM expected_raw""")
def consistency_rules(spark, sf_dir):
    clauses = rendered_clauses(spark, sf_dir).select("contract_id", "clause_seq", "clause_type", "text")
    return E.to_long(E.apply_rules(E.extract_raw(clauses))).select(
        "clause_seq", "var_name", "nulled_by", "v_dur_amount", "v_bool")


@query("consistency_rules_amounts", f"""WITH {CLAUSES_SQL}
SELECT clause_seq,
  CASE kind WHEN 0 THEN 'unsupported_large_amount' WHEN 2 THEN 'amount_out_of_range'
            WHEN 3 THEN 'unsupported_large_amount' WHEN 4 THEN 'amount_out_of_range' END AS nulled_by,
  CASE kind WHEN 1 THEN round(o_totalprice, 0) * 1000000.0
            WHEN 5 THEN round(o_totalprice, 0) ELSE CASE WHEN kind > 5 THEN o_totalprice END END AS v_amount
FROM clauses""")
def consistency_rules_amounts(spark, sf_dir):
    """Amounts over 500 million need million/billion in the text; none may pass 1e12 or be 0."""
    whole = F.round("o_totalprice", 0).cast("bigint").cast("string")
    text = (
        F.when(F.col("kind") == 0, F.concat(F.lit("Liability is limited to $"), whole, F.lit("000000 only.")))
        .when(F.col("kind") == 1, F.concat(F.lit("Liability is limited to $"), whole, F.lit(" million only or one billion.")))
        .when(F.col("kind") == 2, F.lit("Liability is limited to $0 in all."))
        .when(F.col("kind") == 3, F.concat(F.lit("Liability is limited to $"), whole, F.lit("000 K in all.")))
        .when(F.col("kind") == 4, F.lit("Liability is limited to $2000 billion in all."))
        .when(F.col("kind") == 5, F.concat(F.lit("Liability is limited to $"), whole, F.lit(" in all.")))
        .otherwise(F.concat(F.lit("Liability is limited to $"), F.format_number("o_totalprice", 2), F.lit(" by law.")))
    )
    clauses = rendered_clauses(spark, sf_dir).select(
        "contract_id", "clause_seq", F.lit("cap_on_liability").alias("clause_type"), text.alias("text"))
    return E.to_long(E.apply_rules(E.extract_raw(clauses))).where("var_name = 'capAmount'").select(
        "clause_seq", "nulled_by", "v_amount")


_LONG_OUT = """SELECT contract_id, clause_seq, clause_type, var_name, var_type, is_set,
  strftime(v_date, '%Y-%m-%d') AS v_date, v_amount, v_currency, v_dur_amount, v_dur_unit, v_bool, v_double,
  party_1 || '|' || party_2 AS v_parties FROM long"""


@query("extraction_long_table", f"WITH {LONG_SQL} {_LONG_OUT}")
def extraction_long_table(spark, sf_dir):
    return rendered_long(spark, sf_dir).select(
        "contract_id", "clause_seq", "clause_type", "var_name", "var_type", "is_set",
        F.col("v_date").cast("string").alias("v_date"), "v_amount", "v_currency", "v_dur_amount", "v_dur_unit",
        "v_bool", "v_double", F.array_join("v_parties", "|").alias("v_parties"))


@query("extraction_summary_by_type", f"""WITH {LONG_SQL}
SELECT clause_type, count(DISTINCT clause_seq) AS n_clauses, count(*) AS n_variables,
  count(*) FILTER (WHERE is_set) AS n_set, round(count(*) FILTER (WHERE is_set) / count(*)::DOUBLE, 6) AS success_rate,
  coalesce(sum(v_amount::DECIMAL(18, 2)), 0)::DOUBLE AS committed_amount
FROM long GROUP BY clause_type""")
def extraction_summary_by_type(spark, sf_dir):
    """Success rate and total committed amount per clause type (the flagship query)."""
    long = rendered_long(spark, sf_dir)
    return long.groupBy("clause_type").agg(
        F.count_if(F.col("var_pos") == 0).alias("n_clauses"), F.count("*").alias("n_variables"),
        F.count_if("is_set").alias("n_set"),
        F.round(F.count_if("is_set") / F.count("*"), 6).alias("success_rate"),
        F.coalesce(F.sum(F.col("v_amount").cast("decimal(18,2)")), F.lit(0)).cast("double").alias("committed_amount"))


@query("extraction_summary", f"""WITH {LONG_SQL}
SELECT count(DISTINCT clause_seq) AS n_extractions, count(*) AS n_variables, count(*) FILTER (WHERE is_set) AS n_successful,
  round(count(*) FILTER (WHERE is_set) / count(*)::DOUBLE, 6) AS success_rate,
  count(DISTINCT clause_type) AS n_types, count(DISTINCT contract_id) AS n_contracts,
  count(DISTINCT contract_id) FILTER (WHERE party_1 IS NOT NULL) AS n_contracts_with_parties
FROM long""")
def extraction_summary(spark, sf_dir):
    # Grouping by contract first keeps the distinct counts to one row per contract.
    per_contract = rendered_long(spark, sf_dir).groupBy("contract_id", "clause_type").agg(
        F.count_if(F.col("var_pos") == 0).alias("e"), F.count("*").alias("v"), F.count_if("is_set").alias("s"),
        F.max(F.col("v_parties").isNotNull().cast("int")).alias("p"))
    return per_contract.agg(
        F.sum("e").alias("n_extractions"), F.sum("v").alias("n_variables"), F.sum("s").alias("n_successful"),
        F.round(F.sum("s") / F.sum("v"), 6).alias("success_rate"),
        F.count_distinct("clause_type").alias("n_types"), F.count_distinct("contract_id").alias("n_contracts"),
        F.count_distinct(F.when(F.col("p") == 1, F.col("contract_id"))).alias("n_contracts_with_parties"))


@query("extraction_success_by_value_type", f"""WITH {LONG_SQL},
typed AS (SELECT var_type, is_set, CASE WHEN v_bool IS NOT NULL THEN 'boolean' WHEN v_double IS NOT NULL THEN 'numeric'
  WHEN v_date IS NOT NULL THEN 'text' WHEN party_1 IS NOT NULL THEN 'entity_list' WHEN v_amount IS NOT NULL THEN 'monetary'
  WHEN v_dur_amount IS NOT NULL THEN 'temporal' ELSE 'unknown' END AS value_kind FROM long)
SELECT 'schema' AS grouping, var_type AS type_name, count(*) AS total, count(*) FILTER (WHERE is_set) AS successful,
  count(*) FILTER (WHERE NOT is_set) AS nulls, round(count(*) FILTER (WHERE is_set) / count(*)::DOUBLE, 6) AS rate
FROM typed GROUP BY var_type
UNION ALL
SELECT 'inferred', value_kind, count(*), count(*) FILTER (WHERE is_set), count(*) FILTER (WHERE NOT is_set),
  round(count(*) FILTER (WHERE is_set) / count(*)::DOUBLE, 6) FROM typed GROUP BY value_kind""")
def extraction_success_by_value_type(spark, sf_dir):
    from clauseloom.functions.values import value_kind

    typed = rendered_long(spark, sf_dir).withColumn("value_kind", value_kind())
    both = typed.select("is_set", F.explode(F.array(
        F.struct(F.lit("schema").alias("g"), F.col("var_type").alias("t")),
        F.struct(F.lit("inferred").alias("g"), F.col("value_kind").alias("t")))).alias("x"))
    return both.groupBy(F.col("x.g").alias("grouping"), F.col("x.t").alias("type_name")).agg(
        F.count("*").alias("total"), F.count_if("is_set").alias("successful"),
        F.count_if(~F.col("is_set")).alias("nulls"), F.round(F.count_if("is_set") / F.count("*"), 6).alias("rate"))


@query("coverage_scores", f"""WITH {LONG_SQL}
SELECT contract_id, clause_seq, clause_type, round(avg(is_set::INT), 6) AS schema_coverage,
  round(avg(is_set::INT), 6) AS valid_coverage FROM long GROUP BY ALL""")
def coverage_scores(spark, sf_dir):
    """Per clause: share of schema variables set, and share of extracted values that are valid."""
    from clauseloom.functions.values import coverage, valid_coverage

    return rendered_extracted(spark, sf_dir).select(
        "contract_id", "clause_seq", "clause_type", F.round(coverage(), 6).alias("schema_coverage"),
        F.round(valid_coverage(), 6).alias("valid_coverage"))


@query("extraction_documents_control", """SELECT doc_id, NULL::VARCHAR AS found_date, NULL::DOUBLE AS amount,
  NULL::INT AS dur_amount, NULL::BOOLEAN AS polarity, 0 AS n_parties FROM documents""")
def extraction_documents_control(spark, sf_dir):
    """Negative control: prose without contract wording yields no value."""
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", X.date_of(text)["dt"].cast("string").alias("found_date"), X.money_of(text)["amount"].alias("amount"),
        X.duration_of(text)["amount"].alias("dur_amount"), X.polarity_of(text).alias("polarity"),
        F.coalesce(F.size(P.parties_of(text)), F.lit(0)).alias("n_parties"))


@query("contract_type_coverage", f"""WITH {CLAUSES_SQL}
SELECT contract_id, clause_type, count(*) AS n_clauses FROM clauses GROUP BY ALL""")
def contract_type_coverage(spark, sf_dir):
    return E.contract_coverage(rendered_clauses(spark, sf_dir))


@query("contract_coverage_wide", f"""WITH {CLAUSES_SQL}
SELECT contract_id, count(*) FILTER (WHERE kind = 8) AS parties, count(*) FILTER (WHERE kind = 0) AS agreement_date,
  count(*) FILTER (WHERE kind = 9) AS governing_law, count(*) FILTER (WHERE kind = 1) AS effective_date,
  count(*) FILTER (WHERE kind = 2) AS cap_on_liability, count(*) FILTER (WHERE kind = 3) AS minimum_commitment,
  count(*) FILTER (WHERE kind = 4) AS notice_period_renewal, count(*) FILTER (WHERE kind = 5) AS revenue_profit_sharing,
  count(*) FILTER (WHERE kind = 6) AS non_compete, count(*) FILTER (WHERE kind = 7) AS audit_rights,
  count(*) FILTER (WHERE kind = 10) AS volume_restriction, count(*) FILTER (WHERE kind = 11) AS insurance
FROM clauses GROUP BY contract_id""")
def contract_coverage_wide(spark, sf_dir):
    wide = rendered_clauses(spark, sf_dir).groupBy("contract_id").pivot(
        "clause_type", [
            "parties", "agreement_date", "governing_law", "effective_date", "cap_on_liability", "minimum_commitment",
            "notice_period_renewal", "revenue_profit_sharing", "non_compete", "audit_rights", "volume_restriction",
            "insurance"]).count()
    return wide.na.fill(0)


@query("contract_selection", f"""WITH {CLAUSES_SQL},
scored AS (SELECT contract_id, count(DISTINCT clause_type) AS num_types, count(*) AS total_clauses FROM clauses
  GROUP BY contract_id HAVING count(DISTINCT clause_type) > 1)
SELECT *, num_types * 15 + total_clauses + CASE WHEN num_types >= 10 THEN 5 ELSE 0 END AS score
FROM scored ORDER BY score DESC, contract_id LIMIT 20""")
def contract_selection(spark, sf_dir):
    """Top 20 contracts by diversity score; the limit is the feature."""
    return E.select_contracts(E.contract_coverage(rendered_clauses(spark, sf_dir)), 20)


@query("extraction_selected_contracts", f"""WITH {LONG_SQL},
scored AS (SELECT contract_id, count(DISTINCT clause_type) AS num_types, count(*) AS total_clauses FROM clauses
  GROUP BY contract_id HAVING count(DISTINCT clause_type) > 1),
chosen AS (SELECT contract_id FROM scored ORDER BY num_types * 15 + total_clauses
  + CASE WHEN num_types >= 10 THEN 5 ELSE 0 END DESC, contract_id LIMIT 15)
{_LONG_OUT} SEMI JOIN chosen USING (contract_id)""")
def extraction_selected_contracts(spark, sf_dir):
    """The extraction run over the 15 best-covered contracts, as the default mode does."""
    clauses = rendered_clauses(spark, sf_dir).select("contract_id", "clause_seq", "clause_type", "text")
    return E.to_long(E.extract_contracts(clauses, max_contracts=15)).select(
        "contract_id", "clause_seq", "clause_type", "var_name", "var_type", "is_set",
        F.col("v_date").cast("string").alias("v_date"), "v_amount", "v_currency", "v_dur_amount", "v_dur_unit",
        "v_bool", "v_double", F.array_join("v_parties", "|").alias("v_parties"))


@query("extraction_dedup", f"""WITH {CLAUSES_SQL}
SELECT clause_seq, contract_id, clause_type FROM clauses
QUALIFY row_number() OVER (PARTITION BY contract_id, clause_type, text ORDER BY clause_seq) = 1""")
def extraction_dedup(spark, sf_dir):
    return E.dedup_clauses(rendered_clauses(spark, sf_dir)).select("clause_seq", "contract_id", "clause_type")


@query("documents_dedup", """SELECT doc_id FROM documents
QUALIFY row_number() OVER (PARTITION BY source, lang, text ORDER BY doc_id) = 1""")
def documents_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.col("source").alias("contract_id"), F.col("lang").alias("clause_type"), "text",
        F.col("doc_id").alias("clause_seq"))
    return E.dedup_clauses(docs).select(F.col("clause_seq").alias("doc_id"))


@query("parties_fallback", f"""WITH {CLAUSES_SQL},
ctx AS (SELECT contract_id, clause_seq, clause_type, kind, seg, side, o_custkey,
    CASE WHEN kind = 8 THEN text ELSE repeat('Both sides agree to the terms that follow here. ', 10) ||
      'This Agreement is made by and between ' || seg || ' Trading Corporation and ' || side ||
      ' Supply Corporation WHEREAS both agree.' || repeat(' and so on', (clause_seq % 5)::INT) END AS context FROM clauses),
have AS (SELECT DISTINCT contract_id FROM ctx WHERE kind = 8)
SELECT contract_id, clause_seq, seg || ' Trading Corporation' AS party_1, side || ' Supply Corporation' AS party_2,
  context AS original_text, clause_type AS source_clause
FROM ctx ANTI JOIN have USING (contract_id)
JOIN (SELECT * FROM {lookups.sql_values([(k, v) for k, v in lookups.type_positions().items()], "clause_type, type_pos")})
  USING (clause_type)
QUALIFY row_number() OVER (PARTITION BY contract_id ORDER BY length(context) DESC, type_pos, clause_seq) = 1""")
def parties_fallback(spark, sf_dir):
    """Contracts without a parties clause take parties from their longest context."""
    recital = F.concat(
        F.lit("Both sides agree to the terms that follow here. " * 10), F.lit("This Agreement is made by and between "),
        F.initcap("c_mktsegment"), F.lit(" Trading Corporation and "), F.col("side"),
        F.lit(" Supply Corporation WHEREAS both agree."), F.repeat(F.lit(" and so on"), F.col("clause_seq") % 5))
    clauses = rendered_clauses(spark, sf_dir).withColumn(
        "context", F.when(F.col("clause_type") == "parties", F.col("text")).otherwise(recital))
    return E.fallback_parties(clauses.select("contract_id", "clause_type", "clause_seq", "context")).select(
        "contract_id", "clause_seq", F.get("parties", F.lit(0)).alias("party_1"),
        F.get("parties", F.lit(1)).alias("party_2"), "original_text", "source_clause")


@query("extraction_dedup_long_texts", """WITH t AS (SELECT doc_id, source, repeat('The same opening of every text. ', 10) || text AS text FROM documents)
SELECT doc_id FROM t QUALIFY row_number() OVER (PARTITION BY source, text ORDER BY doc_id) = 1""")
def extraction_dedup_long_texts(spark, sf_dir):
    """Texts that differ only after 320 equal characters stay apart."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("source").alias("contract_id"), F.lit("any").alias("clause_type"),
        F.concat(F.repeat(F.lit("The same opening of every text. "), F.lit(10)), "text").alias("text"), F.col("doc_id").alias("clause_seq"))
    return E.dedup_clauses(docs).select(F.col("clause_seq").alias("doc_id"))


@query("extract_parties_late_and_many", """SELECT c_custkey, 6 AS n_parties,
  list_transform(['East', 'West', 'North', 'South', 'Upper', 'Lower'], lambda s: s || ' ' || upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ' Trading Corporation')::VARCHAR[] AS names
FROM customer""")
def extract_parties_late_and_many(spark, sf_dir):
    """Six names, all of them past character 3600."""
    names = [F.concat(F.lit(f'"{side} '), F.initcap("c_mktsegment"), F.lit(' Trading Corporation"')) for side in
             ("East", "West", "North", "South", "Upper", "Lower")]
    text = F.concat(F.repeat(F.lit("what was said before, "), F.lit(165)), F.array_join(F.array(*names), "; "), F.lit("; all agree."))
    found = dealt(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey").withColumn("p", P.parties_by_suffix(text))
    return found.select("c_custkey", F.size("p").alias("n_parties"), F.col("p").alias("names"))
