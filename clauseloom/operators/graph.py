"""Property-graph tables: nodes, edges, upserts and the standard graph queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseloom import lookups
from clauseloom.functions.templating import json_value, title_case
from clauseloom.functions.text import any_of, rx, strip
from clauseloom.functions.values import display_text, is_graph_valid, valid_coverage, value_kind
from clauseloom.operators import extraction as E
from clauseloom.operators import setsim
from clauseloom.session import stored

# Display only: characters of a title, and of the text shown beside the full one.
TITLE_LENGTH = 60
TEXT_LENGTH = 2000


def clause_id() -> Column:
    return F.concat_ws("_", "contract_id", "clause_type", F.substring(F.sha2("text", 256), 1, 32))


def clause_nodes(clauses: DataFrame) -> DataFrame:
    shown = F.when(F.length("text") > TEXT_LENGTH, F.concat(F.substring("text", 1, TEXT_LENGTH), F.lit("..."))).otherwise(F.col("text"))
    return clauses.select(clause_id().alias("clause_id"), "contract_id", "clause_type", F.col("text").alias("original_text"),
                          shown.alias("shown_text"),
                          valid_coverage().alias("coverage_score"))


def variable_nodes(clauses: DataFrame) -> DataFrame:
    """One node per clause and valid variable, keyed by both so names never mix across clauses."""
    long = E.to_long(clauses.withColumn("clause_id", clause_id()).withColumn(
        "_json", F.transform("vars", json_value)))
    return long.where(is_graph_valid()).select(
        F.concat_ws("|", "clause_id", "var_name").alias("variable_id"), "clause_id", "clause_type", "var_name",
        F.col("var_type").alias("schema_type"), value_kind().alias("var_type"), display_text().alias("value"),
        F.col("v_amount").alias("amount"), F.get("_json", F.col("var_pos")).alias("extracted_value"))


def party_id(name: Column) -> Column:
    bare = F.regexp_replace(F.lower(name), r"(?U)[^\w\s]", "")
    return F.array_join(F.filter(F.split(bare, r"(?U)\s+"), lambda w: w != ""), "_")


def entity_type(name: Column) -> Column:
    low, expr = F.lower(name), None
    for kind, words in lookups.ENTITY_TYPE_WORDS:
        cond = low.rlike(any_of(words))
        expr = F.when(cond, kind) if expr is None else expr.when(cond, kind)
    return expr.otherwise("unknown")


def contract_parties(clauses: DataFrame) -> DataFrame:
    """contract_id, name, at: every party name of a contract with its first position."""
    lists = E.to_long(clauses).where("var_type = 'Party[]' AND v_parties IS NOT NULL")
    names = lists.select("contract_id", "clause_seq", F.posexplode("v_parties").alias("pos", "name")).withColumn(
        "name", strip(F.col("name"))).where("name <> ''")
    return names.groupBy("contract_id", F.lower("name").alias("key")).agg(
        F.min_by("name", F.struct("clause_seq", "pos")).alias("name"), F.min(F.struct("clause_seq", "pos")).alias("at"))


def party_nodes(parties: DataFrame) -> DataFrame:
    return parties.withColumn("party_id", party_id(F.col("name"))).groupBy("party_id").agg(
        F.min("name").alias("name")).withColumn("entity_type", entity_type(F.col("name")))


def primary_type(types: Column) -> Column:
    ranked = F.array_intersect(F.array(*[F.lit(t) for t in lookups.TITLE_PRIORITY_TYPES]), types)
    return F.coalesce(F.get(ranked, F.lit(0)), F.array_min(types))


def contract_title(contract_id: Column, parties: Column, types: Column) -> Column:
    """Title from up to three names and the clause types."""
    names = F.filter(parties, lambda p: F.length(strip(p)) > 1)
    kind = title_case(primary_type(types))
    a, b = F.get(names, F.lit(0)), F.get(names, F.lit(1))
    plain = F.initcap(F.translate(contract_id, "_-", "  "))
    title = (
        F.when(F.size(names) >= 3, F.concat(a, F.lit(" & "), b, F.lit(" & Others Agreement")))
        .when(F.size(names) == 2, F.concat(a, F.lit(" & "), b, F.lit(" Agreement")))
        .when(F.size(names) == 1, F.concat(a, F.lit(" "), F.coalesce(kind, F.lit("Agreement"))))
        .when(kind.isNotNull(), F.concat(kind, F.lit(" Agreement")))
        .otherwise(F.concat(plain, F.lit(" Contract"))))
    return F.substring(title, 1, TITLE_LENGTH)


def contract_nodes(clauses: DataFrame) -> DataFrame:
    """Contracts with titles; only the first three names per contract are gathered."""
    types = clauses.groupBy("contract_id").agg(F.collect_set("clause_type").alias("types"))
    first = Window.partitionBy("contract_id").orderBy("at")
    names = contract_parties(clauses).withColumn("rn", F.row_number().over(first)).where("rn <= 3").groupBy(
        "contract_id").agg(F.array_sort(F.collect_list(F.struct("rn", "name"))).alias("n"))
    both = types.join(names, "contract_id", "left").withColumn(
        "names", F.coalesce(F.transform("n", lambda x: x["name"]), F.array().cast("array<string>")))
    return both.select("contract_id", contract_title(F.col("contract_id"), F.col("names"), F.col("types")).alias("title"))


# Fluff cut from a title proposed by a model, and invented party pairs.
TITLE_FLUFF = [
    r"^(?:Here is|Here's|The title is|Title:|Contract title:)\s*", r"^(?:Based on|Given|Considering)\s+.*?,\s*",
    r"\s*(?:would be|could be|should be)\s*:?\s*", r"\s*\(.*?\)\s*", r"\s*\.+$", r'^"|"$', r"^\s*[\-*]\s*",
]
TITLE_SEPARATORS = [".", ":", "!", "?", "\n", "because", "since", "as it", "which"]
INVENTED_PARTIES = [
    r"\b[A-Z][a-z]+ & [A-Z][a-z]+\b", r"\b[A-Z]+ & [A-Z]+\b", r"\bCompany A & Company B\b",
    r"\bParty A & Party B\b", r"\bClient & Vendor\b",
]


def clean_title(response: Column) -> Column:
    title = strip(response)
    for pattern in TITLE_FLUFF:
        title = strip(F.regexp_replace(title, rx(pattern), ""))
    cuts = F.coalesce(*[F.when(F.contains(title, F.lit(s)) & (strip(F.substring_index(title, s, 1)) != ""),
                               strip(F.substring_index(title, s, 1))) for s in TITLE_SEPARATORS], title)
    bare = F.regexp_replace(cuts, r"(?U)[^\w\s&\-]", "")
    return strip(F.regexp_replace(bare, r"(?U)\s+", " "))


def guarded_title(response: Column, n_parties: Column, fallback: Column) -> Column:
    """A proposed title, unless it names a pair of parties the contract does not have."""
    title = clean_title(response)
    invented = (n_parties <= 1) & title.rlike(rx("|".join(INVENTED_PARTIES)))
    return F.when(response.isNull() | invented, fallback).otherwise(F.substring(title, 1, TITLE_LENGTH))


def party_role(response: Column) -> Column:
    role = strip(F.lower(response))
    return F.when(role.isin(lookups.PARTY_ROLES), role).otherwise("party")


def contains_edges(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("contract_id").alias("from_id"), F.col("clause_id").alias("to_id")).distinct()


def variable_edges(variables: DataFrame) -> DataFrame:
    """Clause to variable, each once; those of a clause travel together and lie together."""
    own = variables.groupBy(F.col("clause_id").alias("from_id")).agg(F.collect_set(F.struct("variable_id")).alias("own"))
    return own.select("from_id", F.explode("own.variable_id").alias("to_id"))


def involves_edges(parties: DataFrame, roles: DataFrame | None = None) -> DataFrame:
    """Contract to party with a role; ``roles``: contract_id, party_id, response."""
    edges = parties.select("contract_id", party_id(F.col("name")).alias("party_id")).distinct()
    if roles is not None:
        edges = edges.join(roles, ["contract_id", "party_id"], "left")
    else:
        edges = edges.withColumn("response", F.lit(None).cast("string"))
    return edges.select(F.col("contract_id").alias("from_id"), F.col("party_id").alias("to_id"),
                        party_role(F.col("response")).alias("role"))


def slug(name: Column, limit: int | None = None) -> Column:
    """Lower case with dashes; part of keys, so it is cut only on request."""
    bare = F.regexp_replace(F.lower(name), r"(?U)[^\w\s-]", "")
    dashed = F.regexp_replace(bare, r"(?U)[-\s]+", "-")
    return F.regexp_replace(dashed if limit is None else F.substring(dashed, 1, limit), "^-+|-+$", "")


def _grams(text: Column, k: Column) -> Column:
    n = F.length(text) - k + 1
    return F.when(n >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                                                       lambda i: F.substring(text, i, k))))


def match_directories(directories: DataFrame, contracts: DataFrame, gram: int = 8) -> DataFrame:
    """directory -> contract_id: exact id variants, else containment either way.

    Containment is an equi-join on a key, not a comparison of all pairs: every run of
    ``gram`` characters of the contained name must occur in the containing one, and the
    run that the fewest names have is the key, so an ending that all names share costs
    nothing. Names shorter than that are their own key.

    All sides grow with the input, and an explode hides it from size estimates: the joins
    are told to merge, lest a side be broadcast.
    """
    forms = contracts.select("contract_id", slug(F.col("contract_id")).alias("slug"))
    variants = forms.select("contract_id", F.explode(F.array_distinct(F.array(
        "slug", "contract_id", F.lower("contract_id"), F.replace("contract_id", F.lit("_"), F.lit("-"))))).alias("directory"))
    exact = directories.select("directory").distinct().join(variants.hint("merge"), "directory").groupBy("directory").agg(
        F.min("contract_id").alias("contract_id"))
    rest = directories.select("directory").distinct().join(exact.hint("merge"), "directory", "left_anti")
    flat = lambda c: F.replace(c, F.lit("-"), F.lit("_"))
    same = rest.withColumn("k", flat(F.col("directory"))).join(
        forms.select("contract_id", flat(F.col("slug")).alias("k")).hint("merge"), "k").select(
        "directory", "contract_id", F.lit(1000).alias("weight"))

    def inside(small, small_col, big, big_col):
        k = F.least(F.length(small_col), F.lit(gram))
        sizes = small.select(k.alias("k")).distinct()  # at most ``gram`` rows; other runs are never asked for
        parts = big.crossJoin(F.broadcast(sizes)).withColumn("key", F.explode(_grams(F.col(big_col), F.col("k"))))
        common = parts.groupBy("k", "key").agg(F.count("*").alias("n"))
        grams = small.withColumn("k", k).withColumn("key", F.explode(_grams(F.col(small_col), F.col("k"))))
        rarest = grams.join(common.hint("merge"), ["k", "key"]).groupBy(*small.columns, "k").agg(
            F.min(F.struct("n", "key")).alias("r"), F.count("*").alias("met"))
        # a part that the other side does not have at all rules the name out
        whole = F.col("met") == F.size(_grams(F.col(small_col), F.col("k")))
        keyed = rarest.where(whole).select(*small.columns, "k", F.col("r.key").alias("key"))
        return keyed.hint("merge").join(parts.hint("merge"), ["k", "key"]).where(F.contains(F.col(big_col), F.col(small_col)))

    slugs = forms.where("slug <> ''")
    contained = inside(rest, "directory", slugs, "slug").unionByName(inside(slugs, "slug", rest, "directory")).select(
        "directory", "contract_id", F.least(F.length("slug"), F.length("directory")).alias("weight"))
    fuzzy = same.unionByName(contained).groupBy("directory").agg(
        F.min(F.struct((-F.col("weight")).alias("w"), "contract_id")).alias("best")).select(
        "directory", F.col("best.contract_id").alias("contract_id"))
    return exact.unionByName(fuzzy)


def match_clauses(templates: DataFrame, nodes: DataFrame) -> DataFrame:
    """(contract_id, template type) -> one clause, by exact type, spelling variants, containment.

    Both sides are reduced to their distinct types per contract before they meet,
    so the join is bounded by the number of clause types and not by clauses.
    """
    wanted = templates.select("contract_id", F.col("clause_type").alias("wanted")).distinct()
    have = nodes.groupBy("contract_id", "clause_type").agg(F.min("clause_id").alias("clause_id"))
    w, t = F.col("wanted"), F.col("clause_type")
    under, dash = F.replace(w, F.lit("-"), F.lit("_")), F.replace(w, F.lit("_"), F.lit("-"))
    tier = (F.when(t == w, 1).when(t == under, 2).when(t == dash, 3).when(t == F.lower(w), 4).when(t == F.lower(under), 5)
            .when(t == F.lower(dash), 6)
            .when(F.contains(F.lower(t), F.lower(w)) | F.contains(F.lower(w), F.lower(t)), 7))
    pairs = wanted.join(have, "contract_id").withColumn("tier", tier).where("tier IS NOT NULL")
    best = pairs.groupBy("contract_id", "wanted").agg(F.min(F.struct(
        "tier", F.length("clause_type").alias("len"), "clause_id")).alias("b"))
    return best.select("contract_id", F.col("wanted").alias("clause_type"), F.col("b.clause_id").alias("clause_id"),
                       F.col("b.tier").alias("tier"))


def template_ids(keys: DataFrame) -> DataFrame:
    return keys.select(_template_id(), "contract_id", "clause_type")


def _template_id() -> Column:
    return F.concat_ws("_", slug(F.col("contract_id")), "directory").alias("template_id")


def template_nodes(templates: DataFrame) -> DataFrame:
    from clauseloom.operators.templates import preserves_text

    return templates.select(
        _template_id(), "contract_id", "clause_type", F.col("directory").alias("template_name"), "priority", F.col("coverage").alias("coverage_score"),
        preserves_text(F.col("grammar")).alias("original_text_preserved"))


def based_on_edges(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("template_id").alias("from_id"), F.col("contract_id").alias("to_id")).distinct()


def generates_edges(nodes: DataFrame, clauses: DataFrame) -> DataFrame:
    # stored, so that what was shuffled to match is gone before the edges are made
    matched = nodes.join(stored(match_clauses(nodes, clauses), "matches"), ["contract_id", "clause_type"])
    return matched.select(F.col("clause_id").alias("from_id"), F.col("template_id").alias("to_id")).distinct()


def uses_edges(generates: DataFrame, variables: DataFrame) -> DataFrame:
    """Template to variable.  A variable belongs to one clause, so repeats lie where the join put that clause."""
    return generates.join(variables.select(F.col("clause_id").alias("from_id"), "variable_id"), "from_id").dropDuplicates(
        ["from_id", "to_id", "variable_id"]).select(F.col("to_id").alias("from_id"), F.col("variable_id").alias("to_id"))


def similar_edges(clauses: DataFrame, threshold: float = 0.7) -> DataFrame:
    """SIMILAR_TO between clauses of one type, in the compact form of the set join.

    kind, from_id, to_id, hub_token, score; the ends are clause ids.  ``clause_seq`` must
    tell clauses apart.  Texts that are null or without words have no edge.
    """
    rows = clauses.select(F.col("clause_seq").alias("id"), F.col("clause_type").alias("type"), "text")
    # Named the same on both sides, so that they are shuffled once.
    ids = clauses.select("clause_seq", clause_id().alias("clause_id"))
    return setsim.similarity_relation(rows, threshold).join(ids.alias("a"), F.col("from_id") == F.col("a.clause_seq")).join(
        ids.alias("b"), F.col("to_id") == F.col("b.clause_seq")).select(
        "kind", F.col("a.clause_id").alias("from_id"), F.col("b.clause_id").alias("to_id"), "hub_token", "score")


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Last write wins per key; the map-side cut keeps rewritten keys from piling up."""
    last = Window.partitionBy(*keys).orderBy(F.desc(seq))
    return current.unionByName(changes).withColumn("_rn", F.row_number().over(last)).where("_rn = 1").drop("_rn")


def valid_edges(edges: DataFrame, from_ids: DataFrame, to_ids: DataFrame) -> DataFrame:
    """Edges whose two ends exist, each (from, to) once.  The frames have one id column."""
    a, b = from_ids.toDF("from_id"), to_ids.toDF("to_id")
    return edges.dropDuplicates(["from_id", "to_id"]).join(a, "from_id", "left_semi").join(b, "to_id", "left_semi")


class GraphTables:
    """Node and edge tables by name, each planned when it is first asked for."""

    def __init__(self, makers: dict):
        self._makers, self._made = makers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def put(self, name: str, frame: DataFrame) -> None:
        """The table as it is stored, for what is planned from now on."""
        self._made[name] = frame

    def names(self) -> list[str]:
        return list(self._makers)

    def items(self):
        return ((name, self[name]) for name in self._makers)


def build(clauses: DataFrame, templates: DataFrame | None = None, max_contracts: int | None = None,
          keys: DataFrame | None = None) -> GraphTables:
    """All node and edge tables of the extracted clauses.

    ``keys`` are the ``template_keys`` of the templates, if stored: edges are made from them, without any text.
    """
    if max_contracts is not None:
        first = clauses.select("contract_id").distinct().orderBy("contract_id").limit(max_contracts)
        clauses = clauses.join(first, "contract_id", "left_semi")
    makers = {
        "Contract": lambda: contract_nodes(clauses), "Clause": lambda: clause_nodes(clauses),
        "Variable": lambda: variable_nodes(clauses), "Party": lambda: party_nodes(contract_parties(clauses)),
        "CONTAINS": lambda: contains_edges(tables["Clause"]), "HAS_VARIABLE": lambda: variable_edges(tables["Variable"]),
        "INVOLVES": lambda: involves_edges(contract_parties(clauses)), "SIMILAR_TO": lambda: similar_edges(clauses),
    }
    if templates is not None:
        makers["Template"] = lambda: template_nodes(templates)
        ids = template_ids(templates if keys is None else keys)
        makers["BASED_ON"] = lambda: based_on_edges(ids)
        makers["GENERATES"] = lambda: generates_edges(ids, tables["Clause"])
        makers["USES_VARIABLES"] = lambda: uses_edges(tables["GENERATES"], tables["Variable"])
    tables = GraphTables(makers)
    return tables


def totals(tables: GraphTables) -> DataFrame:
    out = None
    for name, frame in tables.items():
        part = frame.agg(F.lit(name).alias("label"), F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


def top_parties(tables: GraphTables, n: int = 5) -> DataFrame:
    # A name is looked up for the n winners only.
    counts = tables["INVOLVES"].groupBy("to_id").agg(F.count("*").alias("contract_count"))
    return counts.orderBy(F.desc("contract_count"), "to_id").limit(n).join(
        tables["Party"].withColumnRenamed("party_id", "to_id"), "to_id").select("name", "contract_count")


def template_success(tables: GraphTables, distinct: bool = False) -> DataFrame:
    """Clauses and templates per type by optional match: a clause with two templates counts twice
    unless ``distinct``."""
    made = tables["GENERATES"].groupBy(F.col("from_id").alias("clause_id")).agg(F.count("*").alias("t"))
    rows = tables["Clause"].join(made, "clause_id", "left").withColumn("t", F.coalesce("t", F.lit(0)))
    total = F.count("*") if distinct else F.sum(F.greatest("t", F.lit(1)))
    done = F.count_if(F.col("t") > 0) if distinct else F.sum("t")
    return rows.groupBy("clause_type").agg(total.alias("total_clauses"), done.alias("templates_generated")).withColumn(
        "success_rate", F.round(F.col("templates_generated") * 100.0 / F.col("total_clauses")))


def clauses_with_templates(tables: GraphTables) -> DataFrame:
    """Success by type with totals from a second match: types without a template drop out."""
    made = tables["GENERATES"].join(tables["Clause"].select(F.col("clause_id").alias("from_id"), "clause_type"), "from_id")
    done = made.groupBy("clause_type").agg(F.count("*").alias("clauses_with_templates"))
    total = tables["Clause"].groupBy("clause_type").agg(F.count("*").alias("total_clauses"))
    return done.join(total, "clause_type").withColumn(
        "success_rate", F.round(F.col("clauses_with_templates") * 100.0 / F.col("total_clauses")))


def caps_above(tables: GraphTables, bound: float) -> DataFrame:
    """Liability caps above an amount with their contract's title."""
    caps = tables["Variable"].where((F.col("clause_type") == "cap_on_liability") & (F.col("schema_type") == "MonetaryAmount")
                                    & (F.col("amount") > bound)).select("clause_id", "amount", "value")
    return caps.join(tables["Clause"], "clause_id").join(tables["Contract"], "contract_id").select(
        "title", "original_text", "value", "amount")


def neighbours(tables: GraphTables) -> DataFrame:
    """contract_id, label, neighbour_id: everything one step around a contract, and the variables of its clauses."""
    row = lambda label, neighbour: ("contract_id", F.lit(label).alias("label"), F.col(neighbour).alias("neighbour_id"))
    clause = tables["Clause"].select("contract_id", "clause_id")
    parts = [
        clause.select(*row("Clause", "clause_id")),
        tables["Variable"].select("clause_id", "variable_id").join(clause, "clause_id").select(*row("Variable", "variable_id")),
        tables["INVOLVES"].withColumnRenamed("from_id", "contract_id").select(*row("Party", "to_id")),
        tables["BASED_ON"].withColumnRenamed("to_id", "contract_id").select(*row("Template", "from_id"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def neighbourhood(tables: GraphTables) -> DataFrame:
    """Per contract the numbers of clauses, parties, variables and templates around it."""
    clause = tables["Clause"].select("clause_id", "contract_id")
    per_clause = clause.join(tables["Variable"].groupBy("clause_id").agg(F.count("*").alias("v")), "clause_id", "left")
    counts = per_clause.groupBy("contract_id").agg(F.count("*").alias("n_clauses"), F.coalesce(F.sum("v"), F.lit(0)).alias("n_variables"))
    parties = tables["INVOLVES"].groupBy(F.col("from_id").alias("contract_id")).agg(F.count("*").alias("n_parties"))
    made = tables["BASED_ON"].groupBy(F.col("to_id").alias("contract_id")).agg(F.count("*").alias("n_templates"))
    return tables["Contract"].join(counts, "contract_id", "left").join(parties, "contract_id", "left").join(
        made, "contract_id", "left").na.fill(0)
