"""Queries over the property-graph tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauseloom.corpus_model import CLAUSES_SQL, rendered_clauses
from clauseloom.operators import graph as G
from clauseloom.operators import templates as T
from clauseloom.plans.extraction import rendered_stored as rendered_extracted
from clauseloom.plans.registry import query
from clauseloom.plans.similarity import relation_sql
from clauseloom.plans.templates import TEMPLATES_SQL
from clauseloom.session import scratch_path, stored, table
from clauseloom.sources import writers

# The expected graph tables of the rendered corpus.
_PARTY = "{0} || ' Trading Corporation'"
GRAPH_SQL = TEMPLATES_SQL + """,
cn AS (SELECT *, contract_id || '_' || clause_type || '_' || sha256(text)[1:32] AS clause_id FROM named),
vn AS (SELECT cn.clause_id, cn.clause_id || '|' || var_name AS variable_id, cn.clause_type, var_name, var_type AS schema_type, v_amount AS amount,
  CASE WHEN v_bool IS NOT NULL THEN 'boolean' WHEN v_double IS NOT NULL THEN 'numeric' WHEN v_date IS NOT NULL THEN 'text'
    WHEN party_1 IS NOT NULL THEN 'entity_list' WHEN v_amount IS NOT NULL THEN 'monetary' ELSE 'temporal' END AS var_type,
  coalesce(CASE v_bool WHEN true THEN 'True' WHEN false THEN 'False' END, v_double::VARCHAR, strftime(v_date, '%Y-%m-%d') || 'T00:00:00.000Z',
    party_1 || ', ' || party_2, v_amount || ' ' || v_currency, v_dur_amount || ' ' || v_dur_unit) AS value
  FROM long JOIN cn USING (clause_seq) WHERE is_set),
pc AS (SELECT DISTINCT contract_id, unnest([seg || ' Trading Corporation', side || ' Supply Corporation']) AS name FROM named WHERE kind = 8),
pid AS (SELECT *, replace(lower(name), ' ', '_') AS party_id FROM pc),
tn AS (SELECT lower(contract_id) || '_' || directory AS template_id, contract_id, clause_type, directory, priority, coverage, grammar FROM made),
gen AS (SELECT min(clause_id) AS clause_id, contract_id, clause_type FROM cn GROUP BY contract_id, clause_type),
generates AS (SELECT DISTINCT clause_id AS from_id, template_id AS to_id FROM tn JOIN gen USING (contract_id, clause_type)),
contracts AS (SELECT contract_id, max(CASE WHEN kind = 8 THEN seg END) AS s, max(CASE WHEN kind = 8 THEN side END) AS d, list(DISTINCT clause_type) AS types
  FROM named GROUP BY contract_id),
titled AS (SELECT contract_id, CASE WHEN s IS NOT NULL THEN (s || ' Trading Corporation & ' || d || ' Supply Corporation Agreement')[1:60]
  ELSE array_to_string(list_transform(string_split(coalesce(list_filter(['license_grant', 'non_compete', 'revenue_profit_sharing', 'termination_convenience',
    'governing_law', 'parties', 'effective_date'], lambda t: list_contains(types, t))[1], list_min(types)), '_'), lambda w: upper(w[1]) || w[2:]), ' ')
    || ' Agreement' END AS title FROM contracts)"""


def graph_tables(spark, sf_dir):
    clauses = rendered_extracted(spark, sf_dir)
    keys = stored(T.template_keys(clauses), "template-keys")
    return G.build(clauses, T.generate(clauses, keys=keys), keys=keys)


def clause_tables(spark, sf_dir):
    return G.build(rendered_extracted(spark, sf_dir))


@query("graph_contract_nodes", f"WITH {GRAPH_SQL} SELECT contract_id, title FROM titled")
def graph_contract_nodes(spark, sf_dir):
    return clause_tables(spark, sf_dir)["Contract"]


@query("graph_clause_nodes", f"""WITH {GRAPH_SQL} SELECT clause_id, contract_id, clause_type, text AS original_text, text AS shown_text, round(coverage, 6) AS coverage_score FROM cn""")
def graph_clause_nodes(spark, sf_dir):
    return clause_tables(spark, sf_dir)["Clause"].withColumn("coverage_score", F.round("coverage_score", 6))


@query("graph_clause_nodes_long_text", """SELECT doc_id, 'C_' || lang || '_' || sha256(text)[1:32] AS clause_id,
  md5(text) AS text_hash, CASE WHEN length(text) > 2000 THEN md5(text[1:2000] || '...') ELSE md5(text) END AS shown_hash FROM documents""")
def graph_clause_nodes_long_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.lit("C").alias("contract_id"), F.col("lang").alias("clause_type"),
        F.array(F.lit(None).cast("struct<s:string,b:boolean,d:double,dt:date,amount:double,currency:string,dur_amount:int,dur_unit:string,parties:array<string>>")
                ).alias("vars"))
    nodes = G.clause_nodes(docs.withColumn("contract_id", F.concat_ws("~", F.lit("C"), "doc_id")))
    return nodes.select(F.split("contract_id", "~")[1].cast("bigint").alias("doc_id"),
                        F.regexp_replace("clause_id", r"~\d+", "").alias("clause_id"), F.md5("original_text").alias("text_hash"),
                        F.md5("shown_text").alias("shown_hash"))


@query("graph_variable_nodes", f"""WITH {GRAPH_SQL} SELECT variable_id, clause_id, var_name, schema_type, var_type, value FROM vn""")
def graph_variable_nodes(spark, sf_dir):
    return clause_tables(spark, sf_dir)["Variable"].select("variable_id", "clause_id", "var_name", "schema_type", "var_type", "value")


@query("graph_party_nodes", f"""WITH {GRAPH_SQL} SELECT party_id, min(name) AS name, 'corporation' AS entity_type FROM pid GROUP BY party_id""")
def graph_party_nodes(spark, sf_dir):
    return clause_tables(spark, sf_dir)["Party"]


@query("graph_entity_types", f"""WITH {CLAUSES_SQL} SELECT clause_seq, (['corporation', 'llc', 'partnership', 'individual', 'unknown', 'corporation'])[clause_seq % 6 + 1] AS entity_type,
  (['acme_inc', 'zeta_llc', 'firm_llp', 'a_person', 'the_union', 'obrien_company'])[clause_seq % 6 + 1] || '_' || n AS party_id FROM clauses""")
def graph_entity_types(spark, sf_dir):
    names = ["Acme, Inc.", "Zeta LLC", "Firm LLP", "A Person", "The Union", "O'Brien Company"]
    name = F.element_at(F.array(*[F.lit(x) for x in names]), (F.pmod("clause_seq", F.lit(6)) + 1).cast("int"))
    return rendered_clauses(spark, sf_dir).select(
        "clause_seq", G.entity_type(name).alias("entity_type"), G.party_id(F.concat_ws(" ", name, "n")).alias("party_id"))


@query("graph_edges", f"""WITH {GRAPH_SQL} SELECT 'CONTAINS' AS edge, contract_id AS from_id, clause_id AS to_id, NULL AS role FROM cn
UNION ALL SELECT 'HAS_VARIABLE', clause_id, variable_id, NULL FROM vn
UNION ALL SELECT 'INVOLVES', contract_id, party_id, CASE WHEN party_id LIKE 'b%' THEN 'buyer' ELSE 'party' END FROM pid""")
def graph_edges(spark, sf_dir):
    """Contract-clause, clause-variable and contract-party edges; roles from responses where valid."""
    clauses = rendered_extracted(spark, sf_dir)
    t = G.build(clauses)
    roles = t["INVOLVES"].select(F.col("from_id").alias("contract_id"), F.col("to_id").alias("party_id"), F.when(
        F.col("to_id").startswith("b"), " Buyer ").otherwise("captain").alias("response"))
    involves = G.involves_edges(G.contract_parties(clauses), roles)
    none = F.lit(None).cast("string")
    out = involves.select(F.lit("INVOLVES").alias("edge"), "from_id", "to_id", "role")
    for e in ("CONTAINS", "HAS_VARIABLE"):
        out = out.unionByName(t[e].select(F.lit(e).alias("edge"), "from_id", "to_id", none.alias("role")))
    return out


@query("graph_template_nodes", f"""WITH {GRAPH_SQL} SELECT template_id, contract_id, clause_type, directory AS template_name, priority, round(coverage, 6) AS coverage_score,
  length(trim(regexp_replace(grammar, '\\{{\\{{[^}}]+\\}}\\}}', '', 'g'))) > 100 AND contains(grammar, '{{{{') AS original_text_preserved FROM tn""")
def graph_template_nodes(spark, sf_dir):
    return graph_tables(spark, sf_dir)["Template"].withColumn("coverage_score", F.round("coverage_score", 6))


@query("graph_template_edges", f"""WITH {GRAPH_SQL} SELECT 'BASED_ON' AS edge, template_id AS from_id, contract_id AS to_id FROM tn
UNION ALL SELECT 'GENERATES', from_id, to_id FROM generates
UNION ALL SELECT DISTINCT 'USES_VARIABLES', g.to_id, variable_id FROM generates g JOIN vn ON vn.clause_id = g.from_id""")
def graph_template_edges(spark, sf_dir):
    t = graph_tables(spark, sf_dir)
    out = None
    for e in ("BASED_ON", "GENERATES", "USES_VARIABLES"):
        part = t[e].select(F.lit(e).alias("edge"), "from_id", "to_id")
        out = part if out is None else out.unionByName(part)
    return out


@query("graph_clause_matching", f"""WITH {GRAPH_SQL},
w AS (SELECT DISTINCT contract_id, kind, CASE kind WHEN 0 THEN 'agreement-date' WHEN 2 THEN 'CAP_ON_LIABILITY' WHEN 7 THEN 'audit' ELSE clause_type END AS wanted FROM cn)
SELECT w.contract_id, wanted AS clause_type, g.clause_id, CASE kind WHEN 0 THEN 2 WHEN 2 THEN 4 WHEN 7 THEN 7 ELSE 1 END AS tier
FROM w JOIN (SELECT contract_id, kind, min(clause_id) AS clause_id FROM cn GROUP BY ALL) g USING (contract_id, kind)""")
def graph_clause_matching(spark, sf_dir):
    """Template types in other spellings still find their clause, by tier."""
    nodes = clause_tables(spark, sf_dir)["Clause"]
    t = F.col("clause_type")
    wanted = nodes.select("contract_id", F.when(t == "agreement_date", "agreement-date").when(t == "cap_on_liability", "CAP_ON_LIABILITY")
                          .when(t == "audit_rights", "audit").otherwise(t).alias("clause_type"))
    return G.match_clauses(wanted, nodes)


@query("graph_directory_matching", """SELECT CASE c_custkey % 4 WHEN 0 THEN 'deal_' || c_custkey || '_x' WHEN 1 THEN 'DEAL-' || c_custkey || '-x'
  WHEN 2 THEN 'deal-' || c_custkey || '-x' ELSE 'old deal_' || c_custkey || '_x copy' END AS directory, 'DEAL_' || c_custkey || '_x' AS contract_id FROM customer""")
def graph_directory_matching(spark, sf_dir):
    k, m = F.col("c_custkey"), F.pmod("c_custkey", F.lit(4))
    name = lambda a, sep, b: F.concat(F.lit(a), F.lit(sep), k, F.lit(sep), F.lit(b))
    c = table(spark, sf_dir, "customer").select(
        name("DEAL", "_", "x").alias("contract_id"),
        F.when(m == 0, name("deal", "_", "x")).when(m == 1, name("DEAL", "-", "x")).when(m == 2, name("deal", "-", "x"))
        .otherwise(F.concat(F.lit("old "), name("deal", "_", "x"), F.lit(" copy"))).alias("directory"))
    return G.match_directories(c.select("directory"), c.select("contract_id"))


_SIM = GRAPH_SQL + ", src AS (SELECT clause_seq AS id, clause_type AS type, text FROM named)"


@query("graph_similar_edges", f"""WITH {relation_sql(_SIM)},
ids AS (SELECT clause_seq, clause_id FROM cn),
rel AS (SELECT 'copy' AS kind, id AS f, rep AS t, NULL AS hub_token, 1.0::DOUBLE AS score FROM copies
  UNION ALL SELECT 'hub', rep, hub_rep, hub_token, round(score, 6) FROM hubs
  UNION ALL SELECT 'pair', rep_a, rep_b, NULL, round(score, 6) FROM sim WHERE NOT (na = nb AND both_n = na - 1))
SELECT kind, a.clause_id AS from_id, b.clause_id AS to_id, hub_token, score FROM rel JOIN ids a ON a.clause_seq = f JOIN ids b ON b.clause_seq = t""")
def graph_similar_edges(spark, sf_dir):
    """SIMILAR_TO in its compact form, keyed by clause id."""
    return clause_tables(spark, sf_dir)["SIMILAR_TO"].withColumn("score", F.round("score", 6))


_SIMILAR_SQL = f"""WITH {relation_sql(_SIM)},
ids AS (SELECT clause_seq, clause_id FROM cn),
rel AS (SELECT 'hub' AS kind, rep AS f, hub_rep AS t, round(score, 6) AS score FROM hubs
  UNION ALL SELECT 'pair', rep_a, rep_b, round(score, 6) FROM sim WHERE NOT (na = nb AND both_n = na - 1))"""


@query("graph_top_similar_pairs", f"""{_SIMILAR_SQL}
SELECT kind, a.clause_id AS from_id, b.clause_id AS to_id, score FROM rel JOIN ids a ON a.clause_seq = f JOIN ids b ON b.clause_seq = t
WHERE a.clause_id <> b.clause_id ORDER BY score DESC, from_id, to_id, kind LIMIT 20""")
def graph_top_similar_pairs(spark, sf_dir):
    """The twenty most similar clauses of different wording; the limit is the feature."""
    edges = graph_similar_edges(spark, sf_dir).where("kind <> 'copy' AND from_id <> to_id")
    return edges.select("kind", "from_id", "to_id", "score").orderBy(F.desc("score"), "from_id", "to_id", "kind").limit(20)


@query("graph_upsert", f"""WITH {CLAUSES_SQL}, w AS (SELECT contract_id, clause_type, clause_seq AS seq, text AS payload FROM clauses
  UNION ALL SELECT contract_id, clause_type, clause_seq + 1000000000, 'new ' || text FROM clauses WHERE kind < 6)
SELECT contract_id, clause_type, seq, payload FROM w QUALIFY row_number() OVER (PARTITION BY contract_id, clause_type ORDER BY seq DESC) = 1""")
def graph_upsert(spark, sf_dir):
    """Last write wins per key."""
    c = rendered_clauses(spark, sf_dir)
    current = c.select("contract_id", "clause_type", F.col("clause_seq").alias("seq"), F.col("text").alias("payload"))
    changes = c.where("kind < 6").select("contract_id", "clause_type", (F.col("clause_seq") + 1000000000).alias("seq"),
                                         F.concat(F.lit("new "), "text").alias("payload"))
    return G.upsert(current, changes, ["contract_id", "clause_type"], "seq")


@query("graph_valid_edges", """SELECT DISTINCT o_custkey AS from_id, c_nationkey AS to_id FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey""")
def graph_valid_edges(spark, sf_dir):
    """Edges to missing nodes and repeated edges drop out."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    edges = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_custkey").alias("from_id"), F.explode(F.array("c_nationkey", F.col("c_nationkey") + 1000)).alias("to_id"))
    return G.valid_edges(edges, c.select("c_custkey"), table(spark, sf_dir, "nation").select("n_nationkey"))


_TOTALS_SQL = f"""WITH {relation_sql(_SIM)} SELECT 'Contract' AS label, count(*) AS n FROM contracts UNION ALL SELECT 'Clause', count(*) FROM cn
UNION ALL SELECT 'Variable', count(*) FROM vn UNION ALL SELECT 'Party', count(DISTINCT party_id) FROM pid UNION ALL SELECT 'CONTAINS', count(*) FROM cn
UNION ALL SELECT 'HAS_VARIABLE', count(*) FROM vn UNION ALL SELECT 'INVOLVES', count(*) FROM pid UNION ALL SELECT 'Template', count(*) FROM tn
UNION ALL SELECT 'BASED_ON', count(*) FROM tn UNION ALL SELECT 'GENERATES', count(*) FROM generates
UNION ALL SELECT 'USES_VARIABLES', count(*) FROM generates g JOIN vn ON vn.clause_id = g.from_id
UNION ALL SELECT 'SIMILAR_TO', (SELECT count(*) FROM copies) + (SELECT count(*) FROM hubs)
  + (SELECT count(*) FROM sim WHERE NOT (na = nb AND both_n = na - 1))"""


@query("graph_totals", _TOTALS_SQL)
def graph_totals(spark, sf_dir):
    return G.totals(graph_tables(spark, sf_dir))


@query("graph_first_contracts", f"""WITH {GRAPH_SQL}, first AS (SELECT contract_id FROM contracts ORDER BY contract_id LIMIT 10)
SELECT contract_id, clause_id FROM cn SEMI JOIN first USING (contract_id)""")
def graph_first_contracts(spark, sf_dir):
    """A graph of the first ten contracts; the limit is the feature."""
    return G.build(rendered_extracted(spark, sf_dir), max_contracts=10)["Clause"].select("contract_id", "clause_id")


@query("graph_top_parties", f"""WITH {GRAPH_SQL} SELECT min(name) AS name, count(*) AS contract_count FROM pid GROUP BY party_id ORDER BY count(*) DESC, party_id LIMIT 5""")
def graph_top_parties(spark, sf_dir):
    return G.top_parties(clause_tables(spark, sf_dir))


@query("graph_clauses_by_type", f"WITH {GRAPH_SQL} SELECT clause_type, count(*) AS n FROM cn GROUP BY clause_type")
def graph_clauses_by_type(spark, sf_dir):
    return clause_tables(spark, sf_dir)["Clause"].groupBy("clause_type").agg(F.count("*").alias("n"))


@query("graph_template_success", f"""WITH {GRAPH_SQL}, j AS (SELECT cn.clause_type, g.to_id FROM cn LEFT JOIN generates g ON g.from_id = cn.clause_id)
SELECT clause_type, count(*) AS total_clauses, count(to_id) AS templates_generated, round(100.0 * count(to_id) / count(*))::DOUBLE AS success_rate
FROM j GROUP BY clause_type ORDER BY success_rate DESC, clause_type LIMIT 10""")
def graph_template_success(spark, sf_dir):
    return G.template_success(graph_tables(spark, sf_dir)).orderBy(F.desc("success_rate"), "clause_type").limit(10)


@query("graph_template_success_distinct", f"""WITH {GRAPH_SQL}, g AS (SELECT DISTINCT from_id FROM generates)
SELECT clause_type, count(*) AS total_clauses, count(from_id) AS templates_generated, round(100.0 * count(from_id) / count(*))::DOUBLE AS success_rate
FROM cn LEFT JOIN g ON from_id = clause_id GROUP BY clause_type""")
def graph_template_success_distinct(spark, sf_dir):
    return G.template_success(graph_tables(spark, sf_dir), distinct=True)


@query("graph_clauses_with_templates", f"""WITH {GRAPH_SQL}, d AS (SELECT clause_type, count(*) AS c FROM generates JOIN cn ON clause_id = from_id GROUP BY clause_type),
t AS (SELECT clause_type, count(*) AS n FROM cn GROUP BY clause_type)
SELECT clause_type, c AS clauses_with_templates, n AS total_clauses, round(100.0 * c / n)::DOUBLE AS success_rate FROM d JOIN t USING (clause_type)""")
def graph_clauses_with_templates(spark, sf_dir):
    return G.clauses_with_templates(graph_tables(spark, sf_dir))


@query("graph_caps_above", f"""WITH {GRAPH_SQL} SELECT title, text AS original_text, value, amount FROM vn JOIN cn USING (clause_id) JOIN titled USING (contract_id)
WHERE vn.clause_type = 'cap_on_liability' AND schema_type = 'MonetaryAmount' AND amount > 300000""")
def graph_caps_above(spark, sf_dir):
    return G.caps_above(clause_tables(spark, sf_dir), 300000)


@query("graph_neighbourhood", f"""WITH {GRAPH_SQL}, v AS (SELECT clause_id, count(*) AS v FROM vn GROUP BY clause_id),
c AS (SELECT contract_id, count(*) AS n_clauses, coalesce(sum(v), 0) AS n_variables FROM cn LEFT JOIN v USING (clause_id) GROUP BY contract_id),
p AS (SELECT contract_id, count(*) AS n_parties FROM pid GROUP BY contract_id), t AS (SELECT contract_id, count(*) AS n_templates FROM tn GROUP BY contract_id)
SELECT contract_id, title, n_clauses, n_variables, coalesce(n_parties, 0) AS n_parties, coalesce(n_templates, 0) AS n_templates
FROM titled JOIN c USING (contract_id) LEFT JOIN p USING (contract_id) LEFT JOIN t USING (contract_id)""")
def graph_neighbourhood(spark, sf_dir):
    return G.neighbourhood(graph_tables(spark, sf_dir))


@query("graph_neighbours", f"""WITH {GRAPH_SQL} SELECT contract_id, 'Clause' AS label, clause_id AS neighbour_id FROM cn
UNION ALL SELECT cn.contract_id, 'Variable', vn.variable_id FROM vn JOIN cn USING (clause_id)
UNION ALL SELECT contract_id, 'Party', party_id FROM pid UNION ALL SELECT contract_id, 'Template', template_id FROM tn""")
def graph_neighbours(spark, sf_dir):
    return G.neighbours(graph_tables(spark, sf_dir))


@query("graph_template_text_checks", """SELECT doc_id, doc_id % 2 = 0 AND length(trim(text, ' \t\n\r')) > 100 AS preserved, CASE WHEN doc_id % 3 = 0 THEN 'audit_rights' ELSE 'parties' END AS clause_type FROM documents""")
def graph_template_text_checks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    grammar = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit("{{name}}"))).otherwise(F.col("text"))
    directory = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("audit_rights-"), F.lpad(F.col("doc_id").cast("string"), 6, "0"))).otherwise("parties")
    return docs.select("doc_id", T.preserves_text(grammar).alias("preserved"), T.directory_type(directory).alias("clause_type"))


@query("graph_title_cleanup", f"""WITH {CLAUSES_SQL} SELECT clause_seq, CASE clause_seq % 4 WHEN 0 THEN seg || ' License Agreement' WHEN 1 THEN 'Fallback Agreement'
  WHEN 2 THEN seg || ' Supply Agreement' ELSE 'Fallback Agreement' END AS title FROM clauses""")
def graph_title_cleanup(spark, sf_dir):
    """Model titles lose their wrapping; an invented pair of parties falls back."""
    seg, m = F.initcap("c_mktsegment"), F.pmod("clause_seq", F.lit(4))
    response = (F.when(m == 0, F.concat(F.lit('Title: "'), seg, F.lit(' License Agreement"')))
                .when(m == 1, F.lit("Acme & Zeta Agreement"))
                .when(m == 2, F.concat(F.lit("- "), seg, F.lit(" Supply Agreement (short). It fits best."))))
    return rendered_clauses(spark, sf_dir).select(
        "clause_seq", G.guarded_title(response, F.lit(1), F.lit("Fallback Agreement")).alias("title"))


@query("graph_tables_written", _TOTALS_SQL)
def graph_tables_written(spark, sf_dir):
    """Every node and edge table written and counted from what was read back."""
    path = scratch_path(spark, "graph")
    tables = graph_tables(spark, sf_dir)
    writers.write_graph(tables, path)
    return G.totals({name: spark.read.parquet(f"{path}/{name}") for name in tables.names()})


@query("graph_changes_applied", f"""WITH {CLAUSES_SQL} SELECT contract_id, clause_seq, CASE WHEN o_custkey % 100 = 1 AND kind < 6 THEN 'new ' || text ELSE text END AS text
FROM clauses WHERE NOT (o_custkey % 100 = 1 AND kind = 11)
UNION ALL SELECT contract_id, clause_seq + 1000000000, 'added ' || text FROM clauses WHERE o_custkey % 100 = 1 AND kind = 0""")
def graph_changes_applied(spark, sf_dir):
    """Clause rows written in buckets by contract, then changed, removed and added for one contract in a hundred.

    The changes come in two sets, the later versions first.
    """
    path = scratch_path(spark, "versions")
    c = rendered_clauses(spark, sf_dir).select("contract_id", "clause_seq", "text", "kind", "o_custkey")
    columns = ["contract_id", "clause_seq", "text"]
    writers.write_versions(c.select(*columns), path, "contract_id")
    some = c.where("o_custkey % 100 = 1")

    def change(rows, seq, text, version, gone):
        return rows.select("contract_id", seq.alias("clause_seq"), text.alias("text"), F.lit(version).alias("version"), F.lit(gone).alias("gone"))

    seq, text = F.col("clause_seq"), F.col("text")
    later = change(some.where("kind < 6"), seq, F.concat(F.lit("new "), text), 2, False).unionByName(
        change(some.where("kind = 11"), seq, text, 2, True)).unionByName(
        change(some.where("kind = 0"), seq + 1000000000, F.concat(F.lit("added "), text), 2, False))
    earlier = change(some.where("kind < 6 OR kind = 11"), seq, F.concat(F.lit("old "), text), 1, False)
    for changes in (later, earlier):
        writers.apply_versions(changes, path, ["contract_id", "clause_seq"], "contract_id")
    return writers.read_versions(spark, path)
