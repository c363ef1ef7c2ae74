"""Queries over template data."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauseloom.corpus_model import CLAUSES_SQL, rendered_clauses
from clauseloom.functions.values import is_graph_valid, is_usable
from clauseloom.lookups import TEMPLATE_MAP, priority_rows, sql_values
from clauseloom.operators import extraction as E
from clauseloom.operators import templates as T
from clauseloom.plans.extraction import LONG_SQL, rendered_long
from clauseloom.plans.extraction import rendered_stored as rendered_extracted
from clauseloom.plans.registry import query

_TEMPLATES = f"(SELECT * FROM {sql_values(TEMPLATE_MAP, 'clause_type, template')})"
_PRIORITIES = f"(SELECT * FROM {sql_values(priority_rows(), 'clause_type, priority, priority_rank')})"

# Expected grammar of each rendered kind.
_GRAMMAR = """CASE kind
  WHEN 0 THEN 'This Agreement is made on {{signatureDate}}.'
  WHEN 1 THEN 'This Agreement takes effect on {{effectiveDate}}.'
  WHEN 2 THEN '{{#if isCapCalculated}}{{#if hasCapOnLiability}}Liability is limited to {{capAmount.doubleValue}} {{capAmount.currencyCode}}.{{/if}}{{/if}}'
  WHEN 3 THEN '{{#if hasMinimumCommitment}}Buyer must purchase a minimum of {{minimumCommitmentAmount.doubleValue}} {{minimumCommitmentAmount.currencyCode}}.{{/if}}'
  WHEN 4 THEN 'Either side may give {{renewalNoticePeriod.amount}} {{renewalNoticePeriod.unit}} notice before renewal.'
  WHEN 5 THEN 'Partner shall receive {{revenueSharePercentage}} of net revenue.'
  WHEN 6 THEN '{{#if hasNonCompete}}{{else}}The distributor shall not compete for ' || n || ' months.{{/if}}'
  WHEN 7 THEN '{{#if hasAuditRights}}The licensee is subject to audit every {{auditFrequency.amount}} {{auditFrequency.unit}}.{{/if}}'
  WHEN 8 THEN 'This Agreement is made by and between {{#join parties separator=" and "}}{{partyId}}{{/join}} WHEREAS both agree.'
  WHEN 10 THEN '{{#if hasVolumeRestriction}}Orders are limited to {{volumeLimit}} units per quarter.{{/if}}'
  WHEN 11 THEN '{{#if isInsuranceCalculated}}{{#if additionalInsured}}{{#if hasInsuranceRequirement}}Coverage of {{insuranceCoverageAmount.doubleValue}} {{insuranceCoverageAmount.currencyCode}} is mandatory.{{/if}}{{/if}}{{/if}}'
END"""
_REPLACED = "CASE kind WHEN 2 THEN 3 WHEN 3 THEN 2 WHEN 7 THEN 2 WHEN 10 THEN 2 WHEN 11 THEN 4 ELSE 1 END"

# Templates expected from the rendered corpus: kept clauses with their directory names.
TEMPLATES_SQL = LONG_SQL + f""",
kc AS (SELECT c.* FROM clauses c SEMI JOIN kept k ON k.clause_seq = c.clause_seq),
cov AS (SELECT clause_seq, avg(is_set::INT) AS coverage FROM long GROUP BY clause_seq),
named AS (SELECT kc.*, coverage, CASE WHEN count(*) OVER w > 1
    THEN kc.clause_type || '-' || lpad((row_number() OVER (PARTITION BY contract_id, kc.clause_type ORDER BY kc.clause_seq))::VARCHAR, 3, '0')
    ELSE kc.clause_type END AS directory FROM kc JOIN cov USING (clause_seq) WINDOW w AS (PARTITION BY contract_id, kc.clause_type)),
made AS (SELECT n.*, t.template, coalesce(p.priority, 'unknown') AS priority, coalesce(p.priority_rank, 4) AS priority_rank,
    {_GRAMMAR} AS grammar, {_REPLACED} AS n_replacements
  FROM named n JOIN {_TEMPLATES} t USING (clause_type) LEFT JOIN {_PRIORITIES} p USING (clause_type) WHERE coverage >= 0.1)"""


def rendered_templates(spark, sf_dir):
    return T.generate(rendered_extracted(spark, sf_dir))


@query("templates", f"""WITH {TEMPLATES_SQL} SELECT contract_id, clause_seq, directory, template, priority, round(coverage, 6) AS coverage,
  grammar, n_replacements FROM made""")
def templates(spark, sf_dir):
    """Gate, naming and placeholder substitution over all extracted clauses."""
    return rendered_templates(spark, sf_dir).select(
        "contract_id", "clause_seq", "directory", "template", "priority", F.round("coverage", 6).alias("coverage"),
        "grammar", "n_replacements")


@query("template_data_records", f"""WITH {TEMPLATES_SQL},
cells AS (SELECT l.clause_seq, l.pos, '"' || var_name || '":' || coalesce(v_bool::VARCHAR, v_double::VARCHAR,
    '"' || strftime(v_date, '%Y-%m-%d') || 'T00:00:00.000Z"',
    '{{"$class":"org.accordproject.money.MonetaryAmount","doubleValue":' || v_amount || ',"currencyCode":"' || v_currency || '"}}',
    '{{"$class":"org.accordproject.time.Duration","amount":' || v_dur_amount || ',"unit":"' || v_dur_unit || '"}}',
    '[{{"$class":"org.accordproject.organization.Organization","partyId":"' || party_1 || '"}},{{"$class":"org.accordproject.organization.Organization","partyId":"' || party_2 || '"}}]'
  ) AS cell FROM long l WHERE is_set)
SELECT clause_seq, '{{' || string_agg(cell, ',' ORDER BY pos) || '}}' AS request FROM cells GROUP BY clause_seq""".replace("{{", "{").replace("}}", "}"))
def template_data_records(spark, sf_dir):
    return rendered_templates(spark, sf_dir).select("clause_seq", "request")


@query("template_samples", f"""WITH {TEMPLATES_SQL} SELECT clause_seq, '## ' || array_to_string(list_transform(string_split(clause_type, '_'),
  lambda w: upper(w[1]) || w[2:]), ' ') || chr(10) || chr(10) || text AS sample FROM made""")
def template_samples(spark, sf_dir):
    return rendered_templates(spark, sf_dir).select("clause_seq", "sample")


@query("template_fallbacks", f"""WITH {TEMPLATES_SQL} SELECT clause_seq, CASE kind
  WHEN 0 THEN '## Agreement Date' || chr(10) || chr(10) || 'Signaturedate: {{{{signatureDate}}}}'
  WHEN 6 THEN '## Non Compete' || chr(10) || chr(10) || '{{{{#if hasNonCompete}}}}' || chr(10) || 'Hasnoncompete applies.' || chr(10) || '{{{{else}}}}'
    || chr(10) || 'Hasnoncompete does not apply.' || chr(10) || '{{{{/if}}}}'
  ELSE '## Parties' || chr(10) || chr(10) || '{{{{#join parties separator=" and "}}}}{{{{partyId}}}}{{{{/join}}}}' END AS grammar,
  CASE kind WHEN 0 THEN '## Agreement Date' || chr(10) || chr(10) || 'Signaturedate: ' || strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00.000Z'
  WHEN 6 THEN '## Non Compete' || chr(10) || chr(10) || 'Hasnoncompete: no'
  ELSE '## Parties' || chr(10) || chr(10) || 'Parties: "' || seg || ' Trading Corporation" and "' || side || ' Supply Corporation"' END AS sample
FROM made WHERE kind IN (0, 6, 8)""".replace("{{{{", "{{").replace("}}}}", "}}"))
def template_fallbacks(spark, sf_dir):
    """Clauses whose text is lost get a template and a sample from their variables."""
    lost = rendered_extracted(spark, sf_dir).where(
        F.col("clause_type").isin("agreement_date", "non_compete", "parties")).withColumn("text", F.lit(" "))
    return T.generate(lost).select("clause_seq", "grammar", "sample")


@query("template_gate", f"""WITH {TEMPLATES_SQL} SELECT clause_seq, round(coverage, 6) AS coverage,
  CASE WHEN coverage < 0.7 THEN 'low_coverage' END AS reject_reason FROM named""")
def template_gate(spark, sf_dir):
    gated = T.with_gate(rendered_extracted(spark, sf_dir), min_coverage=0.7)
    return gated.select("clause_seq", F.round("coverage", 6).alias("coverage"), "reject_reason")


@query("template_incremental", f"""WITH {TEMPLATES_SQL} SELECT contract_id, directory FROM made WHERE NOT (clause_seq % 2 = 0)""")
def template_incremental(spark, sf_dir):
    """Clauses that already have a template are skipped."""
    clauses = rendered_extracted(spark, sf_dir)
    existing = T.with_directory_name(clauses).where("clause_seq % 2 = 0").select("contract_id", "directory")
    return T.generate(clauses, existing).select("contract_id", "directory")


@query("template_priorities", f"""WITH {CLAUSES_SQL} SELECT clause_seq, coalesce(priority, 'unknown') AS priority,
  coalesce(priority_rank, 4) AS priority_rank, CASE WHEN kind IN (1, 8, 9) THEN 'essential' WHEN kind = 5 THEN 'high' ELSE 'medium' END AS graph_priority
FROM clauses c LEFT JOIN {_PRIORITIES} p ON p.clause_type = CASE WHEN c.clause_seq % 10 = 0 THEN 'side_letter' ELSE c.clause_type END""")
def template_priorities(spark, sf_dir):
    rows = rendered_clauses(spark, sf_dir).select("clause_seq", F.col("clause_type").alias("t"), F.when(
        F.col("clause_seq") % 10 == 0, "side_letter").otherwise(F.col("clause_type")).alias("clause_type"))
    return T.with_priority(rows).select("clause_seq", "priority", "priority_rank", T.graph_priority(F.col("t")).alias("graph_priority"))


@query("template_mapping", f"""WITH {CLAUSES_SQL} SELECT 'mapped' AS side, clause_seq, template FROM clauses JOIN {_TEMPLATES} t USING (clause_type) WHERE clause_seq % 10 <> 0
UNION ALL SELECT 'unmapped', clause_seq, NULL FROM clauses WHERE clause_seq % 10 = 0""")
def template_mapping(spark, sf_dir):
    rows = rendered_clauses(spark, sf_dir).select("clause_seq", F.when(
        F.col("clause_seq") % 10 == 0, "side_letter").otherwise(F.col("clause_type")).alias("clause_type"))
    return T.with_template(rows).select(F.lit("mapped").alias("side"), "clause_seq", "template").unionByName(
        T.unmapped(rows).select(F.lit("unmapped").alias("side"), "clause_seq", F.lit(None).cast("string").alias("template")))


@query("template_filters", f"""WITH {TEMPLATES_SQL}, f AS (SELECT * FROM made WHERE priority IN ('high', 'medium') AND starts_with(template, 'a')),
first AS (SELECT DISTINCT contract_id FROM f ORDER BY contract_id LIMIT 10)
SELECT contract_id, clause_seq, template FROM f SEMI JOIN first USING (contract_id)""")
def template_filters(spark, sf_dir):
    """Template prefix, priorities and the first ten contracts; the limit is the feature."""
    rows = T.with_priority(T.with_template(rendered_extracted(spark, sf_dir)))
    return T.filter_templates(rows, "a", ["high", "medium"], 10).select("contract_id", "clause_seq", "template")


@query("record_validity", f"""WITH {CLAUSES_SQL} SELECT CASE clause_seq % 6 WHEN 0 THEN 'missing_ids' WHEN 1 THEN 'no_mapping' WHEN 2 THEN 'empty' ELSE 'ok' END AS skip_reason,
  count(*) AS n FROM clauses GROUP BY 1""")
def record_validity(spark, sf_dir):
    m = F.pmod("clause_seq", F.lit(6))
    rows = rendered_clauses(spark, sf_dir).select(
        F.when(m == 0, " ").otherwise(F.col("contract_id")).alias("contract_id"),
        F.when(m == 1, "side_letter").otherwise(F.col("clause_type")).alias("clause_type"),
        F.when(m.isin(2, 3), "").otherwise(F.col("text")).alias("text"), F.when(m == 2, 0).otherwise(2).alias("n_values"))
    return T.with_skip_reason(rows).groupBy(F.coalesce("skip_reason", F.lit("ok")).alias("skip_reason")).agg(F.count("*").alias("n"))


@query("usable_values", f"""WITH {LONG_SQL} SELECT clause_seq, var_name, is_set AS usable, is_set AS graph_valid FROM long""")
def usable_values(spark, sf_dir):
    return rendered_long(spark, sf_dir).select("clause_seq", "var_name", is_usable().alias("usable"), is_graph_valid().alias("graph_valid"))


@query("usable_values_edge_cases", f"""WITH {CLAUSES_SQL} SELECT clause_seq, clause_seq % 4 IN (0, 3) AS usable, clause_seq % 4 IN (1) AS graph_valid FROM clauses""")
def usable_values_edge_cases(spark, sf_dir):
    """The two predicates differ on lists of blanks and on a zero amount without a currency."""
    m = F.pmod("clause_seq", F.lit(4))
    none = lambda t: F.lit(None).cast(t)
    rows = rendered_clauses(spark, sf_dir).select(
        "clause_seq", none("boolean").alias("v_bool"), none("double").alias("v_double"),
        F.when(m == 2, "  ").alias("v_string"), none("date").alias("v_date"),
        F.when(m == 0, 0.0).alias("v_amount"), none("string").alias("v_currency"),
        F.when(m == 3, 0).alias("v_dur_amount"), none("string").alias("v_dur_unit"),
        F.when(m == 1, F.array(F.lit(" "))).alias("v_parties"))
    return rows.select("clause_seq", is_usable().alias("usable"), is_graph_valid().alias("graph_valid"))


@query("template_generation_stats", f"""WITH {TEMPLATES_SQL},
s AS (SELECT (SELECT count(DISTINCT contract_id) FROM kc) AS contracts_processed, count(DISTINCT contract_id) AS contracts_successful,
  count(*) AS templates_generated, 0 AS fallback_templates_generated, count(*) FILTER (WHERE kind IN (5, 10)) AS double_replacements FROM made)
SELECT *, templates_generated AS original_text_preserved, round(contracts_successful / contracts_processed::DOUBLE, 6) AS success_rate,
  round(templates_generated / contracts_successful::DOUBLE, 6) AS templates_per_contract, 1.0::DOUBLE AS preservation_rate, 0.0::DOUBLE AS fallback_rate,
  round(double_replacements / templates_generated::DOUBLE, 6) AS double_replacement_rate FROM s""")
def template_generation_stats(spark, sf_dir):
    clauses = rendered_extracted(spark, sf_dir)
    s = T.generation_stats(clauses, T.generate(clauses))
    rates = [c for c in s.columns if c.endswith("rate") or c == "templates_per_contract"]
    return s.select(*[F.round(c, 6).alias(c) if c in rates else F.col(c) for c in s.columns])


def rendered_checks(spark, sf_dir):
    """Three checks per clause: has_text, has_value, covered."""
    c = E.apply_rules(E.extract_raw(rendered_clauses(spark, sf_dir).select("contract_id", "clause_seq", "clause_type", "text")))
    from clauseloom.functions.values import coverage

    checks = F.array(
        F.struct(F.lit("has_text").alias("t"), (F.length("text") > 0).alias("s")),
        F.struct(F.lit("has_value").alias("t"), F.exists("vars", E.is_set).alias("s")),
        F.struct(F.lit("covered").alias("t"), (coverage() >= 0.5).alias("s")))
    return c.select(F.concat_ws("/", "contract_id", "clause_type").alias("template_path"), F.explode_outer(checks).alias("c")).select(
        "template_path", F.col("c.t").alias("test_name"), F.col("c.s").alias("success"))


_CHECKS_SQL = f"""{LONG_SQL}, per AS (SELECT clause_seq, contract_id || '/' || clause_type AS template_path, avg(is_set::INT) AS coverage
  FROM expected_set GROUP BY ALL),
checks AS (SELECT template_path, 'has_text' AS test_name, true AS success FROM per UNION ALL SELECT template_path, 'has_value', coverage > 0 FROM per
  UNION ALL SELECT template_path, 'covered', coverage >= 0.5 FROM per)"""


@query("check_rollup", f"""WITH {_CHECKS_SQL}
SELECT CASE grouping(test_name, template_path) WHEN 3 THEN 'all' WHEN 1 THEN 'test' ELSE 'template' END AS level, test_name, template_path,
  count(*) FILTER (WHERE success) AS passed, count(*) FILTER (WHERE NOT success) AS failed, count(*) AS total,
  round(count(*) FILTER (WHERE success) * 100.0::DOUBLE / count(*), 6) AS success_rate
FROM checks GROUP BY GROUPING SETS ((), (test_name), (template_path))""")
def check_rollup(spark, sf_dir):
    return T.check_rollup(rendered_checks(spark, sf_dir)).withColumn("success_rate", F.round("success_rate", 6))


@query("template_completeness", f"""WITH {TEMPLATES_SQL} SELECT contract_id || '/' || directory AS template_path, 'structure' AS test_name,
  clause_seq % 3 <> 0 AS success, CASE WHEN clause_seq % 3 = 0 THEN 'model' ELSE '' END AS error, 'sample' AS found_optional FROM made""")
def template_completeness(spark, sf_dir):
    """Five required parts must be present; optional ones are listed."""
    made = rendered_templates(spark, sf_dir)
    parts = {"grammar": F.col("grammar"), "model": F.when(F.col("clause_seq") % 3 != 0, "m").otherwise(" "),
             "request": F.col("request"), "state": F.lit("s"), "package": F.lit("p"), "sample": F.col("sample"), "readme": F.lit(" ")}
    return T.part_checks(made, parts)


@query("clause_presence", f"""WITH {CLAUSES_SQL} SELECT contract_id, CASE WHEN bool_or(kind = 8) THEN '' ELSE 'parties' END AS missing_required,
  array_to_string(list_filter([CASE WHEN NOT bool_or(kind = 9) THEN 'governing_law' END, CASE WHEN NOT bool_or(kind = 0) THEN 'agreement_date' END],
    lambda x: x IS NOT NULL), ',') AS missing_recommended FROM clauses GROUP BY contract_id""")
def clause_presence(spark, sf_dir):
    return T.clause_presence(rendered_clauses(spark, sf_dir)).select(
        "contract_id", F.array_join("missing_required", ",").alias("missing_required"),
        F.array_join("missing_recommended", ",").alias("missing_recommended"))


@query("template_value_forms", f"""WITH {CLAUSES_SQL} SELECT clause_seq, CASE kind % 6
  WHEN 0 THEN 'due on {{{{due}}}} at noon' WHEN 1 THEN 'fee of {{{{fee.doubleValue}}}} {{{{fee.currencyCode}}}} net'
  WHEN 2 THEN 'term of {{{{term.amount}}}} {{{{term.unit}}}} only' WHEN 3 THEN 'share of {{{{share}}}} of it'
  WHEN 4 THEN 'law of {{{{law}}}} applies' ELSE 'by {{{{#join who separator=" and "}}}}{{{{partyId}}}}{{{{/join}}}} today' END AS grammar FROM clauses""".replace("{{{{", "{{").replace("}}}}", "}}"))
def template_value_forms(spark, sf_dir):
    """Values without a span are found through their literal forms."""
    kind = F.col("kind") % 6
    c = rendered_clauses(spark, sf_dir)
    text = (F.when(kind == 0, F.concat(F.lit("due on "), F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit(" at noon")))
            .when(kind == 1, F.concat(F.lit("fee of $"), F.format_number("o_totalprice", 2), F.lit(" net")))
            .when(kind == 2, F.concat(F.lit("term of "), F.col("n"), F.lit("-month only")))
            .when(kind == 3, F.concat(F.lit("share of "), F.col("n"), F.lit(" percent of it")))
            .when(kind == 4, F.concat(F.lit('law of "'), F.col("n_name"), F.lit('" applies')))
            .otherwise(F.concat(F.lit('by "'), F.initcap("c_mktsegment"), F.lit(' Inc" and "'), F.col("side"), F.lit(' LLC" today'))))
    name = F.element_at(F.array(*[F.lit(x) for x in ("due", "fee", "term", "share", "law", "who")]), kind + 1)
    var_type = F.element_at(F.array(*[F.lit(x) for x in ("DateTime", "MonetaryAmount", "Duration", "Double", "String", "Party[]")]), kind + 1)
    var = F.struct(
        F.lit(0).alias("pos"), name.alias("var_name"), var_type.alias("var_type"), F.when(kind == 4, F.col("n_name")).alias("s"),
        F.lit(None).cast("boolean").alias("b"), F.when(kind == 3, F.bround(F.col("n") / 100.0, 4)).alias("d"),
        F.when(kind == 0, F.col("o_orderdate").cast("date")).alias("dt"), F.when(kind == 1, F.col("o_totalprice")).alias("amount"),
        F.when(kind == 1, "USD").alias("currency"), F.when(kind == 2, F.col("n")).alias("dur_amount"),
        F.when(kind == 2, "Months").alias("dur_unit"),
        F.when(kind == 5, F.array(F.concat(F.initcap("c_mktsegment"), F.lit(" Inc")), F.concat("side", F.lit(" LLC")))).alias("parties"),
        F.lit(None).cast("string").alias("span"))
    return T.with_grammar(c.select("clause_seq", text.alias("text"), F.array(var).alias("vars"))).select("clause_seq", "grammar")
