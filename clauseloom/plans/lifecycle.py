"""Queries over lifecycle machines, model answers, and the run as a whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauseloom.corpus_model import CLAUSES_SQL, rendered_clauses
from clauseloom.functions import responses as R
from clauseloom.functions.parties import parties_from_answer, party_section
from clauseloom.operators import evaluate as E
from clauseloom.operators import lifecycle as L
from clauseloom.operators import record
from clauseloom.operators import templates as T
from clauseloom.operators.extraction import to_long
from clauseloom.plans.extraction import LONG_SQL, rendered_stored
from clauseloom.plans.registry import query
from clauseloom.plans.templates import TEMPLATES_SQL
from clauseloom.session import scratch_path, stored, table
from clauseloom.sources import writers
from clauseloom.streaming import clauses as stream_clauses
from clauseloom.streaming import conformance as stream_conformance

ALLOWED = [("signup", "view"), ("signup", "click"), ("view", "click"), ("view", "view"), ("click", "purchase"), ("click", "view"),
           ("purchase", "view"), ("error", "view")]
_ALLOWED_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in ALLOWED) + ") al(source, target)"

EVENTS_SQL = """ev AS (SELECT user_id::VARCHAR AS machine, event_type AS name, ts, event_id FROM events),
steps AS (SELECT machine, lag(name) OVER (PARTITION BY machine ORDER BY ts, event_id) AS source, name AS target FROM ev),
firsts AS (SELECT machine, name, count(*) AS n, arg_min(ts, (ts, event_id)) AS at, min((ts, event_id)) AS k FROM ev GROUP BY ALL),
states AS (SELECT machine, name, row_number() OVER (PARTITION BY machine ORDER BY k) AS ord, round(n / (n + 10)::DOUBLE, 6) AS confidence,
  name = 'purchase' AS is_terminal, CASE name WHEN 'signup' THEN 'formation' WHEN 'purchase' THEN 'termination' ELSE 'operational' END AS category FROM firsts),
trans AS (SELECT machine, source, target, 'AFTER_' || upper(source) AS trigger, round(count(*) / (count(*) + 10)::DOUBLE, 6) AS confidence
  FROM steps WHERE source IS NOT NULL GROUP BY ALL),
good AS (SELECT * FROM trans WHERE source <> target AND source <> 'purchase'),
init AS (SELECT machine, name AS initial FROM states WHERE ord = 1)"""


def user_events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("event"), F.col("ts").cast("timestamp").alias("ts"), "event_id")


def event_machines(spark, sf_dir):
    describe = F.when(F.col("name") == "purchase", "completed order").otherwise(F.concat_ws(" ", "name", F.lit("event")))
    states, transitions = L.machines_from_events(user_events(spark, sf_dir), describe)
    return stored(states, "states"), stored(transitions, "transitions")


def allowed(spark):
    return spark.createDataFrame(ALLOWED, "source string, target string")


@query("lifecycle_states", f"WITH {EVENTS_SQL} SELECT machine, name, ord, confidence, is_terminal, category FROM states")
def lifecycle_states(spark, sf_dir):
    return event_machines(spark, sf_dir)[0].select("machine", "name", "ord", "confidence", "is_terminal", "category")


@query("lifecycle_state_normalization", f"""WITH {CLAUSES_SQL} SELECT clause_seq,
  (['under_review', 'active', 'renewing', 'final_notice', 'something', 'suspended'])[clause_seq % 6 + 1] AS name,
  (['formation', 'operational', 'modification', 'termination', 'operational', 'modification'])[clause_seq % 6 + 1] AS category,
  clause_seq % 6 IN (3, 5) AS is_terminal FROM clauses""")
def lifecycle_state_normalization(spark, sf_dir):
    """By the substring rule "suspended" holds "ended" and counts as terminal."""
    names = ["Under Review", "Active", "Renewing", "Final Notice", "something", "Suspended"]
    raw = rendered_clauses(spark, sf_dir).select(
        "clause_seq", F.element_at(F.array(*[F.lit(x) for x in names]), (F.pmod("clause_seq", F.lit(6)) + 1).cast("int")).alias("name"),
        F.lit("").alias("description"), F.lit(None).cast("boolean").alias("is_terminal"))
    return L.normalized_states(raw).select("clause_seq", "name", "category", "is_terminal")


@query("lifecycle_transition_rules", f"""WITH {EVENTS_SQL} SELECT machine, source, target, CASE WHEN source = 'purchase' AND target <> 'purchase' THEN 'forbidden_move'
  WHEN source = target THEN 'self_loop' END AS reject_reason FROM trans""")
def lifecycle_transition_rules(spark, sf_dir):
    states, transitions = event_machines(spark, sf_dir)
    return L.judged_transitions(transitions, states).select("machine", "source", "target", "reject_reason")


@query("lifecycle_accepted_transitions", f"WITH {EVENTS_SQL} SELECT machine, source, target, trigger, confidence FROM good")
def lifecycle_accepted_transitions(spark, sf_dir):
    states, transitions = event_machines(spark, sf_dir)
    return L.accepted_transitions(transitions, states)


@query("lifecycle_default_flow", f"""WITH {CLAUSES_SQL}, m AS (SELECT DISTINCT contract_id AS machine FROM clauses),
f AS (SELECT * FROM (VALUES ('draft', 'under_review'), ('under_review', 'approved'), ('approved', 'signed'), ('signed', 'effective'), ('effective', 'active'),
  ('active', 'terminated')) v(source, target))
SELECT machine, source, target, upper(source) || '_TO_' || upper(target) AS trigger, 0.6::DOUBLE AS confidence FROM m, f""")
def lifecycle_default_flow(spark, sf_dir):
    """Machines without any valid transition get the default flow over the states they have."""
    names = ["draft", "under_review", "approved", "signed", "effective", "active", "terminated"]
    states = L.normalized_states(rendered_clauses(spark, sf_dir).select(F.col("contract_id").alias("machine")).distinct().select(
        "machine", F.explode(F.array(*[F.lit(n) for n in names])).alias("name"), F.lit("").alias("description"), F.lit(False).alias("is_terminal")))
    loops = states.select("machine", F.col("name").alias("source"), F.col("name").alias("target"), F.lit("LOOP").alias("trigger"), F.lit(0.9).alias("confidence"))
    return L.accepted_transitions(loops, states)


@query("lifecycle_reachability", f"""WITH RECURSIVE {EVENTS_SQL}, r AS (SELECT machine, initial AS name FROM init
  UNION SELECT r.machine, g.target FROM r JOIN good g ON g.machine = r.machine AND g.source = r.name) SELECT machine, name FROM r""")
def lifecycle_reachability(spark, sf_dir):
    states, transitions = event_machines(spark, sf_dir)
    return L.reachable(L.accepted_transitions(transitions, states), L.initial_states(states)).select("machine", "name")


@query("lifecycle_non_determinism", f"""WITH {EVENTS_SQL} SELECT machine, source, trigger, count(DISTINCT target) AS n_targets FROM good GROUP BY ALL HAVING n_targets > 1""")
def lifecycle_non_determinism(spark, sf_dir):
    states, transitions = event_machines(spark, sf_dir)
    return L.non_deterministic(L.accepted_transitions(transitions, states))


@query("lifecycle_orphans", f"""WITH {EVENTS_SQL}, t AS (SELECT * FROM good WHERE source <> 'error' AND target <> 'error')
SELECT machine, name FROM states s WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.machine = s.machine AND (t.source = s.name OR t.target = s.name))""")
def lifecycle_orphans(spark, sf_dir):
    states, transitions = event_machines(spark, sf_dir)
    kept = L.accepted_transitions(transitions, states).where("source <> 'error' AND target <> 'error'")
    return L.orphan_states(states, kept)


@query("lifecycle_terminal_exits", f"WITH {EVENTS_SQL} SELECT machine, source, target FROM trans WHERE source = 'purchase'")
def lifecycle_terminal_exits(spark, sf_dir):
    return L.terminal_with_exit(*event_machines(spark, sf_dir))


_SUMMARY_SQL = f"""{EVENTS_SQL}, r AS (SELECT machine, initial AS name FROM init UNION SELECT r.machine, g.target FROM r JOIN trans g ON g.machine = r.machine AND g.source = r.name),
rc AS (SELECT machine, count(*) AS n FROM r GROUP BY machine), sc AS (SELECT machine, count(*) AS n, avg(confidence) AS c FROM states GROUP BY machine),
tc AS (SELECT machine, count(*) AS n, count(*) FILTER (WHERE source = 'purchase') AS x FROM trans GROUP BY machine),
nd AS (SELECT machine, count(*) AS n FROM (SELECT machine, source FROM trans GROUP BY ALL HAVING count(DISTINCT target) > 1) GROUP BY machine),
orph AS (SELECT machine, count(*) AS n FROM states s WHERE NOT EXISTS (SELECT 1 FROM trans t WHERE t.machine = s.machine AND (t.source = s.name OR t.target = s.name)) GROUP BY machine),
summary0 AS (SELECT sc.machine, sc.n AS n_states, coalesce(tc.n, 0) AS n_transitions, round(rc.n / sc.n::DOUBLE * 100, 6) AS reachability_percentage,
  nd.n IS NULL AS is_deterministic, coalesce(orph.n, 0) AS n_orphans, coalesce(tc.x, 0) AS n_terminal_exits,
  (rc.n < sc.n)::INT + (nd.n IS NOT NULL)::INT + (orph.n IS NOT NULL)::INT + coalesce(tc.x, 0) AS n_warnings, true AS is_valid, round(sc.c, 6) AS avg_confidence
  FROM sc LEFT JOIN rc USING (machine) LEFT JOIN tc USING (machine) LEFT JOIN nd USING (machine) LEFT JOIN orph USING (machine)),
summary AS (SELECT *, reachability_percentage >= 80 AND n_warnings <= 5 AND avg_confidence >= 0.5 AS passes_gate FROM summary0)"""


@query("lifecycle_validation", f"WITH RECURSIVE {_SUMMARY_SQL} SELECT * FROM summary")
def lifecycle_validation(spark, sf_dir):
    return L.validation_summary(*event_machines(spark, sf_dir))


@query("lifecycle_stats", f"""WITH RECURSIVE {_SUMMARY_SQL}, s AS (SELECT count(*) AS total_states, avg(confidence) AS ac, count(*) FILTER (WHERE confidence > 0.8) AS hc,
  count(*) FILTER (WHERE category = 'formation') AS f, count(*) FILTER (WHERE category = 'operational') AS o, count(*) FILTER (WHERE category = 'termination') AS t FROM states),
v AS (SELECT count(*) AS n, avg(is_valid::INT) AS vr, avg((n_warnings > 0)::INT) AS wr, avg(reachability_percentage) AS mr FROM summary)
SELECT total_states, round(ac, 5) AS average_confidence, hc AS high_confidence_states, f AS formation, o AS operational, 0 AS modification, t AS termination,
  (SELECT count(*) FROM trans) AS total_transitions, n AS total_machines, round(vr, 5) AS valid_rate, round(wr, 5) AS warning_rate, round(mr, 5) AS mean_reachability,
  round(total_states / n::DOUBLE, 5) AS states_per_machine, round((SELECT count(*) FROM trans) / n::DOUBLE, 5) AS transitions_per_machine FROM s, v""")
def lifecycle_stats(spark, sf_dir):
    states, transitions = event_machines(spark, sf_dir)
    out = L.lifecycle_stats(states, transitions, L.validation_summary(states, transitions))
    rounded = {"average_confidence", "valid_rate", "warning_rate", "mean_reachability", "states_per_machine", "transitions_per_machine"}
    return out.select(*[F.round(c, 5).alias(c) if c in rounded else F.col(c) for c in out.columns])


@query("lifecycle_top_states", f"""WITH {EVENTS_SQL}, c AS (SELECT name, count(*) AS n_rows FROM states GROUP BY name)
SELECT name, n_rows, row_number() OVER (ORDER BY n_rows DESC, name) AS rank FROM c QUALIFY rank <= 10""")
def lifecycle_top_states(spark, sf_dir):
    return E.top_counts(event_machines(spark, sf_dir)[0], "name", 10)


@query("lifecycle_initial_states", f"""WITH {CLAUSES_SQL} SELECT contract_id AS machine, CASE WHEN bool_or(kind = 0) THEN 'signed' WHEN bool_or(kind = 1) THEN 'effective'
  ELSE arg_min(clause_type, clause_seq) END AS initial FROM clauses GROUP BY contract_id""")
def lifecycle_initial_states(spark, sf_dir):
    t = F.col("clause_type")
    states = rendered_clauses(spark, sf_dir).select(F.col("contract_id").alias("machine"), F.col("clause_seq").alias("ord"),
                                                    F.when(t == "agreement_date", "signed").when(t == "effective_date", "effective").otherwise(t).alias("name"))
    return L.initial_states(states)


def event_configs(spark, sf_dir):
    states, transitions = event_machines(spark, sf_dir)
    return L.machine_records(states, transitions)


@query("lifecycle_config_round_trip", f"""WITH {EVENTS_SQL} SELECT t.machine, source, target, trigger || '_' || target AS trigger, 'machine-' || t.machine AS id, initial
FROM trans t JOIN init USING (machine)""")
def lifecycle_config_round_trip(spark, sf_dir):
    """Machines as JSON configs and back; half of the targets in object form."""
    as_object = F.regexp_replace("config", r'"(AFTER_\w+)":"([a-z]+)"', r'"$1":{"target":"$2"}')
    records = event_configs(spark, sf_dir).withColumn(
        "config", F.when(F.col("machine").cast("int") % 2 == 0, as_object).otherwise(F.col("config")))
    heads, _, transitions = L.parse_configs(records)
    return transitions.join(heads, "machine").select("machine", "source", "target", "trigger", "id", "initial")


@query("lifecycle_config_messages", f"""WITH RECURSIVE {EVENTS_SQL}, m AS (SELECT machine, machine::INT % 4 AS d, initial FROM init),
r AS (SELECT machine, initial AS name FROM m WHERE d <> 1 UNION SELECT r.machine, g.target FROM r JOIN trans g ON g.machine = r.machine AND g.source = r.name)
SELECT machine, 'error' AS severity, 'missing_field' AS code, 'id' AS item FROM m WHERE d = 2
UNION ALL SELECT machine, 'error', 'unknown_initial', 'nowhere' FROM m WHERE d = 1
UNION ALL SELECT DISTINCT t.machine, 'error', 'unknown_target', source || '>limbo' FROM trans t JOIN m ON m.machine = t.machine AND d = 3
UNION ALL SELECT machine, 'warning', 'unreachable', name FROM states s WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.machine = s.machine AND r.name = s.name)
UNION ALL SELECT machine, 'suggestion', 'no_exit', name FROM states s WHERE NOT is_terminal AND NOT EXISTS (SELECT 1 FROM trans t WHERE t.machine = s.machine AND t.source = s.name)""")
def lifecycle_config_messages(spark, sf_dir):
    d = F.col("machine").cast("int") % 4
    broken = (F.when(d == 1, F.regexp_replace("config", r'"initial":"[a-z]+"', '"initial":"nowhere"'))
              .when(d == 2, F.regexp_replace("config", r'"id":"[^"]+",', ""))
              .when(d == 3, F.regexp_replace("config", r'"on":\{', '"on":{"X":"limbo",')).otherwise(F.col("config")))
    return L.config_messages(*L.parse_configs(event_configs(spark, sf_dir).withColumn("config", broken)))


@query("lifecycle_machine_profile", f"""WITH {EVENTS_SQL}, s AS (SELECT machine, count(*) AS total_states, count(*) FILTER (WHERE is_terminal) AS final_states FROM states GROUP BY machine),
t AS (SELECT machine, count(*) AS n, count(DISTINCT trigger) AS e FROM trans GROUP BY machine), j AS (SELECT s.*, coalesce(n, 0) AS n, coalesce(e, 0) AS e FROM s LEFT JOIN t USING (machine))
SELECT machine, total_states, final_states, total_states - final_states AS simple_states, n AS total_transitions, e AS unique_events, total_states + n AS complexity_score,
  CASE WHEN total_states + n < 5 THEN 'simple' WHEN total_states + n < 15 THEN 'moderate' WHEN total_states + n < 30 THEN 'complex' ELSE 'very_complex' END AS complexity_level,
  round(n / total_states::DOUBLE, 6) AS branching_factor FROM j""")
def lifecycle_machine_profile(spark, sf_dir):
    return L.machine_profile(*event_machines(spark, sf_dir))


@query("event_conformance", f"""WITH {EVENTS_SQL} SELECT s.source AS previous, s.target AS event, count(*) AS n_steps, any_value(al.source IS NOT NULL) AS is_allowed
FROM steps s LEFT JOIN {_ALLOWED_SQL} ON al.source = s.source AND al.target = s.target WHERE s.source IS NOT NULL GROUP BY ALL""")
def event_conformance(spark, sf_dir):
    return L.conformance(user_events(spark, sf_dir), allowed(spark))


@query("confidence_bands", f"""WITH {EVENTS_SQL} SELECT machine, name, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' WHEN confidence >= 0.4 THEN 'low' ELSE 'very_low' END AS band,
  round(confidence * 0.5 + 0.3 + is_terminal::INT * 0.2, 6) AS quality,
  CASE WHEN round(confidence * 0.5 + 0.3 + is_terminal::INT * 0.2, 6) >= 0.9 THEN 'excellent' WHEN round(confidence * 0.5 + 0.3 + is_terminal::INT * 0.2, 6) >= 0.7 THEN 'good'
    WHEN round(confidence * 0.5 + 0.3 + is_terminal::INT * 0.2, 6) >= 0.5 THEN 'acceptable' ELSE 'poor' END AS quality_band FROM states""")
def confidence_bands(spark, sf_dir):
    from clauseloom.lookups import QUALITY_BANDS

    c = F.col("confidence")
    quality = F.round(L.quality_score(c, c, F.lit(1.0), F.col("is_terminal").cast("int")), 6)
    return event_machines(spark, sf_dir)[0].withColumn("quality", quality).select(
        "machine", "name", L.confidence_band(c).alias("band"), "quality", L.confidence_band(F.col("quality"), QUALITY_BANDS, "poor").alias("quality_band"))


@query("contract_context", f"""WITH {CLAUSES_SQL}, p AS (SELECT contract_id, clause_seq, CASE clause_type WHEN 'effective_date' THEN 0 WHEN 'agreement_date' THEN 2 WHEN 'notice_period_renewal' THEN 5 ELSE 6 END AS rank,
  '[' || clause_type || '] ' || text AS part FROM clauses),
h AS (SELECT contract_id, count(*) AS n_parts,
  'lifecycle_' || sha256(count(*) || '|' || sum(('0x' || sha256(rank || ':' || clause_seq || ':' || part)[1:15])::BIGINT::HUGEINT))[1:16] AS cache_key FROM p GROUP BY contract_id),
e AS (SELECT *, sum(length(part)) OVER (PARTITION BY contract_id ORDER BY rank, clause_seq) AS upto FROM p)
SELECT contract_id, any_value(n_parts) AS n_parts, ((upto - 1) // 3000)::BIGINT AS window_no,
  string_agg(part, chr(10) || chr(10) ORDER BY rank, clause_seq) AS context, any_value(cache_key) AS cache_key
FROM e JOIN h USING (contract_id) GROUP BY contract_id, ((upto - 1) // 3000)::BIGINT""")
def contract_context(spark, sf_dir):
    return L.contract_context(rendered_clauses(spark, sf_dir))


@query("evidence_sources", f"""WITH {CLAUSES_SQL}, s AS (SELECT DISTINCT contract_id, unnest([{{'n': 'signed', 'w': ['agreement', 'made']}}, {{'n': 'terminated', 'w': ['liability', 'orders', 'nothing']}}]) AS st FROM clauses)
SELECT s.contract_id, st.n AS name, string_agg(DISTINCT clause_type, ',' ORDER BY clause_type) AS source_clause_types FROM s JOIN clauses c ON c.contract_id = s.contract_id
  AND len(list_filter(st.w, lambda w: contains(lower(text), w))) > 0 GROUP BY ALL""")
def evidence_sources(spark, sf_dir):
    c = rendered_clauses(spark, sf_dir)
    states = c.select("contract_id").distinct().select("contract_id", F.explode(F.array(
        F.struct(F.lit("signed").alias("name"), F.lit("Agreement made").alias("evidence")),
        F.struct(F.lit("terminated").alias("name"), F.lit("Liability  Orders nothing limited").alias("evidence")))).alias("s")).select("contract_id", "s.*")
    return L.source_clauses(states, c).withColumn("source_clause_types", F.array_join("source_clause_types", ","))


@query("trigger_words", f"""WITH {CLAUSES_SQL} SELECT clause_seq, 'signed,terminated,renewal,'[1:CASE WHEN clause_seq % 2 = 0 THEN 17 ELSE 6 END] AS triggers FROM clauses""")
def trigger_words(spark, sf_dir):
    evidence = F.when(F.col("clause_seq") % 2 == 0, "When Signed or\tterminated by both").otherwise(F.concat(F.lit("signed in "), "n_name"))
    return rendered_clauses(spark, sf_dir).select("clause_seq", F.array_join(L.trigger_words(evidence), ",").alias("triggers"))


@query("state_answer_parsing", f"""WITH {CLAUSES_SQL} SELECT clause_seq, (['clean', 'clean', 'clean', 'rebuild', 'manual', 'fallback', 'fallback', 'empty', 'aggressive', 'clean'])[clause_seq % 10 + 1] AS parse_stage,
  ([ 'draft,active', 'draft,active', 'draft', 'draft,active', 'draft', 'signed', 'active', '', 'draft', 'draft'])[clause_seq % 10 + 1] AS names FROM clauses""")
def state_answer_parsing(spark, sf_dir):
    """Model answers in ten conditions, each read by the first repair stage that works."""
    two = '"states": [{"name": "draft", "confidence": 0.9}, {"name": "active", "confidence": 0.8}]'
    forms = [
        "{" + two + "}", "```json\n{" + two + "}\n```", '{"states": [{name: "draft", "confidence": 0.9,},]}',
        '{"states": [{"name": "draft", "confidence": 0.9} {"name": "active" "confidence": 0.8}',
        "name: draft, description: first form, confidence: 0.7", "It was signed by both.", "Nothing to see.", "  ",
        "{\"states\": [{\"name\": 'draft', \"confidence\": 0.9}]}", 'Sure! {"states": [{"name": "draft", "confidence": 0.5}]} Done.',
    ]
    answer = F.element_at(F.array(*[F.lit(f) for f in forms]), (F.pmod("clause_seq", F.lit(10)) + 1).cast("int"))
    states, stage = L.parsed_states(F.col("answer"))
    return rendered_clauses(spark, sf_dir).select("clause_seq", answer.alias("answer")).select(
        "clause_seq", stage.alias("parse_stage"), F.array_join(F.transform(states, lambda s: s["name"]), ",").alias("names"))


@query("transition_answer_parsing", f"""WITH {CLAUSES_SQL} SELECT clause_seq, (['draft>active', 'draft>active', 'draft>signed', NULL])[clause_seq % 4 + 1] AS pairs FROM clauses""")
def transition_answer_parsing(spark, sf_dir):
    forms = ['{"transitions": [{"source_state": "draft", "target_state": "active"}]}', '[{"source_state": "draft", "target_state": "active"} oops',
             "Draft -> Signed", "nothing here"]
    answer = F.element_at(F.array(*[F.lit(f) for f in forms]), (F.pmod("clause_seq", F.lit(4)) + 1).cast("int"))
    pairs = F.transform(L.parsed_transitions(F.col("answer")), lambda t: F.concat_ws(">", t["source"], t["target"]))
    return rendered_clauses(spark, sf_dir).select("clause_seq", answer.alias("answer")).select("clause_seq", F.array_join(pairs, ",").alias("pairs"))


@query("answer_values", f"""WITH {CLAUSES_SQL} SELECT clause_seq,
  CASE WHEN clause_seq % 8 = 0 THEN 'Laws of ' || n_name END AS s, CASE clause_seq % 8 WHEN 1 THEN true END AS b,
  CASE clause_seq % 8 WHEN 2 THEN round_even(n / 100.0, 4)::DOUBLE WHEN 3 THEN n::DOUBLE END AS d,
  CASE clause_seq % 8 WHEN 4 THEN strftime(o_orderdate, '%Y-%m-%d') END AS dt,
  CASE clause_seq % 8 WHEN 5 THEN o_totalprice WHEN 7 THEN 2500000.0 END AS amount, CASE clause_seq % 8 WHEN 6 THEN n END AS dur_amount,
  CASE clause_seq % 8 WHEN 6 THEN 'Months' END AS dur_unit FROM clauses""")
def answer_values(spark, sf_dir):
    """Model answers read by variable type."""
    m, n = F.pmod("clause_seq", F.lit(8)), F.col("n").cast("string")
    types = ["String", "Boolean", "Double", "Double", "DateTime", "MonetaryAmount", "Duration", "MonetaryAmount"]
    # A percent of 1 or below is read as a fraction already, so 1 is written as 0.01.
    pct = F.when(F.col("n") == 1, "0.01 percent").otherwise(F.concat(n, F.lit(" percent")))
    forms = [F.concat(F.lit('Answer: "Laws of '), "n_name", F.lit('".')), F.lit("Yes"), pct, F.concat(n, F.lit(" in all")),
             F.date_format("o_orderdate", "MMMM d, yyyy"), F.concat(F.lit("$"), F.format_number("o_totalprice", 2)),
             F.concat(n, F.lit(" months")), F.lit("two million five hundred thousand dollars")]
    pick = lambda xs: F.element_at(F.array(*xs), (m + 1).cast("int"))
    rows = rendered_clauses(spark, sf_dir).select("clause_seq", pick(forms).alias("response"), pick([F.lit(t) for t in types]).alias("var_type"))
    return R.parse_responses(rows).select(
        "clause_seq", "s", "b", "d", F.col("dt").cast("string").alias("dt"), "amount", "dur_amount", "dur_unit")


@query("answer_written_money", f"""WITH {CLAUSES_SQL} SELECT clause_seq, CASE clause_seq % 6 WHEN 0 THEN n * 1000000.0 WHEN 1 THEN n * 1000.0 WHEN 2 THEN 3 * o_totalprice
  WHEN 3 THEN n::DOUBLE WHEN 4 THEN NULL ELSE 42.0 END AS amount FROM clauses""")
def answer_written_money(spark, sf_dir):
    m, n = F.pmod("clause_seq", F.lit(6)), F.col("n").cast("string")
    forms = [F.concat(F.lit("$"), n, F.lit("MM")), F.concat(n, F.lit(" thousand")), F.concat(F.lit("three times $"), F.format_number("o_totalprice", 2)),
             F.concat(n, F.lit(" dollars")), F.concat(n, F.lit("%")), F.lit("forty-two dollars and fee")]
    answer = F.element_at(F.array(*forms), (m + 1).cast("int"))
    return rendered_clauses(spark, sf_dir).select("clause_seq", F.round(R.written_amount(answer), 4).alias("amount"))


@query("answer_string_acceptance", f"""WITH {CLAUSES_SQL} SELECT clause_seq, CASE WHEN clause_seq % 6 = 0 THEN 'State of ' || n_name END AS accepted FROM clauses""")
def answer_string_acceptance(spark, sf_dir):
    m = F.pmod("clause_seq", F.lit(6))
    forms = [F.concat(F.lit("  State of "), "n_name", F.lit(" ")), F.lit("likely the State"), F.lit("and the rest of it"), F.lit("(open only"),
             F.lit("12345"), F.lit("the grant")]
    value = F.element_at(F.array(*forms), (m + 1).cast("int"))
    return rendered_clauses(spark, sf_dir).select("clause_seq", R.accepted_string(value, F.lit("licenseScope")).alias("accepted"))


@query("answer_parties", f"""WITH {CLAUSES_SQL} SELECT clause_seq, CASE clause_seq % 3 WHEN 0 THEN seg || ' Trading Corp|' || side || ' Holdings LLC' WHEN 1 THEN seg || ' Systems' END AS names FROM clauses""")
def answer_parties(spark, sf_dir):
    seg, m = F.initcap("c_mktsegment"), F.pmod("clause_seq", F.lit(3))
    answer = (F.when(m == 0, F.concat(F.lit("Here are the names:\n1. "), seg, F.lit(" Trading Corp, a Delaware corporation\n- "), "side", F.lit(" Holdings LLC")))
              .when(m == 1, F.concat(F.lit("* by and between "), seg, F.lit(" Systems\nDelaware Corporation\n"), seg, F.lit(" Systems"))).otherwise("NONE"))
    return rendered_clauses(spark, sf_dir).select("clause_seq", F.array_join(parties_from_answer(answer), "|").alias("names"))


@query("party_sections", f"""WITH {CLAUSES_SQL} SELECT clause_seq, ' ' || seg || ' Trading Corporation and ' || side || ' Supply Corporation ' AS section FROM clauses WHERE kind = 8""")
def party_sections(spark, sf_dir):
    """The part of the opening that names the parties, as put into a prompt."""
    rows = rendered_clauses(spark, sf_dir).where("clause_type = 'parties'")
    return rows.select("clause_seq", party_section(F.col("text")).alias("section"))


def contract_machines(clauses):
    """Contracts whose dates give them lifecycle states."""
    return clauses.where(F.col("clause_type").isin("agreement_date", "effective_date")).select("contract_id").distinct()


def stage_completion(clauses, templates):
    """Per contract: which stages gave a result."""
    flag = lambda df, name: df.select("contract_id").distinct().withColumn(name, F.lit(True))
    out = flag(clauses, "has_variables").join(flag(templates, "has_templates"), "contract_id", "left").join(
        flag(contract_machines(clauses), "has_machine"), "contract_id", "left").na.fill(False)
    return out.withColumn("is_complete", F.col("has_variables") & F.col("has_templates") & F.col("has_machine"))


_COMPLETE_SQL = f"""{TEMPLATES_SQL}, done AS (SELECT contract_id, true AS has_variables, contract_id IN (SELECT contract_id FROM made) AS has_templates, bool_or(kind IN (0, 1)) AS has_machine
  FROM kc GROUP BY contract_id)"""


@query("stage_completion", f"WITH {_COMPLETE_SQL} SELECT *, has_templates AND has_machine AS is_complete FROM done")
def stage_completion_query(spark, sf_dir):
    clauses = rendered_stored(spark, sf_dir)
    return stage_completion(clauses, T.passing(clauses))


@query("run_summary", f"""WITH {_COMPLETE_SQL} SELECT (SELECT count(*) FROM kc) AS n_clauses, (SELECT count(DISTINCT clause_type) FROM kc) AS n_types, (SELECT count(*) FROM long) AS n_variables,
  (SELECT count(*) FROM long WHERE is_set) AS n_set, (SELECT count(*) FROM made) AS n_templates, count(*) AS n_contracts, count(*) FILTER (WHERE has_templates AND has_machine) AS n_complete,
  round(count(*) FILTER (WHERE has_templates AND has_machine) / count(*)::DOUBLE, 6) AS completion_rate FROM done""")
def run_summary(spark, sf_dir):
    """One-row record of a run, assembled from the stage tables."""
    clauses = rendered_stored(spark, sf_dir)
    templates = stored(T.generate(clauses), "templates")
    long = to_long(clauses).agg(F.count("*").alias("n_variables"), F.count_if("is_set").alias("n_set"))
    c = clauses.agg(F.count("*").alias("n_clauses"), F.count_distinct("clause_type").alias("n_types"))
    t = templates.agg(F.count("*").alias("n_templates"))
    d = stage_completion(clauses, templates).agg(F.count("*").alias("n_contracts"), F.count_if("is_complete").alias("n_complete"),
                                                 F.round(F.avg(F.col("is_complete").cast("int")), 6).alias("completion_rate"))
    return c.crossJoin(long).crossJoin(t).crossJoin(d)


@query("run_outputs_written", f"""WITH {LONG_SQL}, {EVENTS_SQL}
SELECT 'extractions' AS name, count(*) AS n_rows FROM long UNION ALL SELECT 'states', count(*) FROM states
UNION ALL SELECT 'transitions', count(*) FROM trans UNION ALL SELECT 'validation', count(DISTINCT machine) FROM states UNION ALL SELECT 'report', 1""")
def run_outputs_written(spark, sf_dir):
    """Extraction table with its run record, lifecycle tables and report written and read back."""
    path = scratch_path(spark, "run")
    writers.write_extractions(to_long(rendered_stored(spark, sf_dir)), path, "production", None)
    states, transitions = event_machines(spark, sf_dir)
    writers.write_lifecycle({"states": states, "transitions": transitions, "validation": L.validation_summary(states, transitions)}, path)
    writers.write_report(spark.read.parquet(f"{path}/run"), f"{path}/report")
    counts = [spark.read.parquet(f"{path}/{n}").agg(F.lit(n).alias("name"), F.count("*").alias("n_rows"))
              for n in ("extractions", "states", "transitions", "validation")]
    out = spark.read.json(f"{path}/report").agg(F.lit("report").alias("name"), F.count("*").alias("n_rows"))
    for c in counts:
        out = out.unionByName(c)
    return out


@query("stream_extraction", f"""WITH {CLAUSES_SQL}, d AS (SELECT DISTINCT contract_id, clause_type, text, CASE WHEN kind IN (2, 3, 11) THEN o_totalprice END AS amount FROM clauses WHERE kind <> 9)
SELECT contract_id, clause_type, count(*) AS n_clauses, sum(amount::DECIMAL(18, 2))::DOUBLE AS total FROM d GROUP BY ALL""")
def stream_extraction(spark, sf_dir):
    """Clauses as a file stream, one file a batch and dates in any order: extracted, de-duplicated, appended to a table."""
    folder = scratch_path(spark, "stream")
    rows = rendered_clauses(spark, sf_dir).select(
        F.col("o_orderdate").cast("timestamp").alias("ts"), "contract_id", "clause_type", "clause_seq", "text")
    rows.repartition(4, "clause_seq").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("ts timestamp, contract_id string, clause_type string, clause_seq long, text string").option(
        "maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    stream_clauses.run_to_table(stream_clauses.extracted_stream(stream), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out").groupBy("contract_id", "clause_type").agg(
        F.count_if(F.col("var_pos") == 0).alias("n_clauses"), F.sum(F.col("v_amount").cast("decimal(18,2)")).cast("double").alias("total"))


@query("stream_conformance", f"""WITH {EVENTS_SQL} SELECT s.source AS previous, s.target AS event, count(*) AS n_steps, any_value(al.source IS NOT NULL) AS is_allowed
FROM steps s LEFT JOIN {_ALLOWED_SQL} ON al.source = s.source AND al.target = s.target WHERE s.source IS NOT NULL GROUP BY ALL""")
def stream_conformance_query(spark, sf_dir):
    """Events arriving in three instalments, the latest days first and every seventh event last, with the stream restarted for each."""
    folder = scratch_path(spark, "conformance")
    events = user_events(spark, sf_dir)
    newest, late = F.col("ts") >= "2024-01-21", F.coalesce(F.col("event_id") % 7 == 0, F.lit(True))
    for part in (newest & ~late, ~F.coalesce(newest, F.lit(False)) & ~late, late):
        events.where(part).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema("key string, event string, ts timestamp, event_id long").parquet(f"{folder}/in")
        stream_conformance.run(stream, f"{folder}/kept")
    return stream_conformance.result(spark, f"{folder}/kept", allowed(spark))


@query("lifecycle_structure_gate", f"""WITH {EVENTS_SQL}, n AS (SELECT machine, count(*) AS k FROM (SELECT DISTINCT machine, source, target, trigger FROM trans) GROUP BY machine),
g AS (SELECT s.machine, list_filter(['click', 'purchase', 'signup'], lambda x: NOT list_contains(list(s.name), x)) AS missing, coalesce(any_value(n.k), 0) AS n_transitions
  FROM states s LEFT JOIN n ON n.machine = s.machine GROUP BY s.machine)
SELECT machine, array_to_string(missing, ',') AS missing_states, n_transitions, len(missing) = 0 AND n_transitions >= 3 AS passes FROM g""")
def lifecycle_structure_gate(spark, sf_dir):
    """Machines of events must hold three required states and three transitions."""
    gate = L.structure_gate(*event_machines(spark, sf_dir), required=["click", "purchase", "signup"])
    return gate.withColumn("missing_states", F.array_join("missing_states", ","))


@query("run_record", f"""WITH RECURSIVE {LONG_SQL}, {_SUMMARY_SQL},
pc AS (SELECT contract_id, count(DISTINCT clause_seq) AS n, count(*) AS v, count(*) FILTER (WHERE is_set) AS s, bool_or(party_1 IS NOT NULL) AS p FROM long GROUP BY contract_id),
ty AS (SELECT clause_type, count(DISTINCT clause_seq) AS n, count(*) AS v, count(*) FILTER (WHERE is_set) AS s FROM long GROUP BY clause_type),
w AS (SELECT sum(n) AS n, sum(v) AS v, sum(s) AS s, count(*) AS contracts, count(*) FILTER (WHERE p) AS named FROM pc),
m AS (SELECT count(*) AS m, count(*) FILTER (WHERE is_valid) AS valid, count(*) FILTER (WHERE n_warnings > 0) AS warned, count(*) FILTER (WHERE passes_gate) AS gated FROM summary),
st AS (SELECT count(*) AS n, count(*) FILTER (WHERE confidence > 0.8) AS high FROM states), mv AS (SELECT count(*) AS moves FROM trans)
SELECT 'extraction' AS section, unnest(['clauses', 'contracts', 'variables', 'values', 'success_rate', 'party_rate']) AS metric, NULL AS category,
  unnest([n::DOUBLE, contracts, v, s, round(s / v::DOUBLE, 6), round(named / contracts::DOUBLE, 6)]) AS value FROM w
UNION ALL SELECT 'clause_type', unnest(['clauses', 'success_rate']), clause_type, unnest([n::DOUBLE, round(s / v::DOUBLE, 6)]) FROM ty
UNION ALL (SELECT 'most_common', 'clause_type', clause_type, n::DOUBLE FROM ty ORDER BY n DESC, clause_type LIMIT 10)
UNION ALL SELECT 'lifecycle', unnest(['machines', 'states', 'transitions', 'pass_rate', 'gate_rate', 'warning_rate', 'high_confidence_rate', 'states_per_machine', 'transitions_per_machine']), NULL,
  unnest([m::DOUBLE, n, moves, round(valid / m::DOUBLE, 6), round(gated / m::DOUBLE, 6), round(warned / m::DOUBLE, 6), round(high / n::DOUBLE, 6), round(n / m::DOUBLE, 6), round(moves / m::DOUBLE, 6)]) FROM m, st, mv
UNION ALL (SELECT 'most_common', 'state', name, count(*)::DOUBLE FROM states GROUP BY name ORDER BY count(*) DESC, name LIMIT 10)
UNION ALL SELECT 'state_category', 'states', category, count(*)::DOUBLE FROM states GROUP BY category
UNION ALL SELECT 'integration', unnest(['complete', 'success_rate']), NULL, unnest([count(*) FILTER (WHERE p)::DOUBLE, round(avg(p::INT), 6)]) FROM pc""")
def run_record_query(spark, sf_dir):
    """Extraction, lifecycle and integration figures of a run; a contract with parties counts as complete here."""
    clauses = rendered_stored(spark, sf_dir)
    states, transitions = event_machines(spark, sf_dir)
    completion = clauses.groupBy("contract_id").agg(F.max(F.col("clause_type") == "parties").alias("is_complete"))
    return record.run_record(clauses, states, transitions, L.validation_summary(states, transitions), completion)
