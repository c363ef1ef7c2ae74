"""Queries over vectors and token sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauseloom.operators import setsim as S
from clauseloom.operators import vectors as V
from clauseloom.plans.registry import query
from clauseloom.session import scratch_path, spread, table
from clauseloom.sources import readers, writers

_UNIT_SQL = """e AS (SELECT vec_id AS id, label, label::VARCHAR AS type, vec_id % 50 AS contract, embedding::DOUBLE[] AS v FROM embeddings),
u AS (SELECT *, sqrt(list_dot_product(v, v)) + 1e-8 AS norm FROM e)"""
_SCORE = "list_dot_product(a.v, b.v) / (a.norm * b.norm)"


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("label").cast("string").alias("type"),
        F.pmod("vec_id", F.lit(50)).cast("string").alias("contract"))


def label_centroids(spark, sf_dir):
    """One query vector per label: the mean of its vectors (component sums, then division)."""
    cells = vectors(spark, sf_dir).select("type", F.posexplode(F.col("vec").cast("array<double>")).alias("pos", "x"))
    means = cells.groupBy("type", "pos").agg(F.avg("x").alias("x"))
    return means.groupBy("type").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("c")).select(
        F.col("type").cast("bigint").alias("id"), F.transform("c", lambda c: c["x"]).alias("vec"), "type",
        F.lit("").alias("contract"))


@query("vector_normalization", f"""WITH {_UNIT_SQL}
SELECT id, round(v[1] / norm, 6) AS first_cell, round(list_dot_product(v, v) / (norm * norm), 6) AS squared_norm FROM u""")
def vector_normalization(spark, sf_dir):
    n = vectors(spark, sf_dir).withColumn("n", V.normalized(F.col("vec")))
    return n.select("id", F.round(F.get("n", F.lit(0)), 6).alias("first_cell"),
                    F.round(V.cosine(F.col("n"), F.col("n")), 6).alias("squared_norm"))


@query("embedding_table_round_trip", """SELECT vec_id AS id, label::VARCHAR AS type, len(embedding) AS dimension FROM embeddings""")
def embedding_table_round_trip(spark, sf_dir):
    path = scratch_path(spark, "vectors")
    writers.write_embeddings(vectors(spark, sf_dir), path, "type")
    return readers.read_embeddings(spark, path).select("id", F.col("type").cast("string").alias("type"),
                                                       F.size("vec").alias("dimension"))


@query("similar_vector_pairs", f"""WITH {_UNIT_SQL}
SELECT a.id AS id_a, b.id AS id_b, round({_SCORE}, 6) AS score FROM u a JOIN u b ON a.id < b.id WHERE {_SCORE} >= 0.3""")
def similar_vector_pairs(spark, sf_dir):
    pairs = V.similar_pairs(vectors(spark, sf_dir), 0.3)
    return pairs.select("id_a", "id_b", F.round("score", 6).alias("score"))


@query("vector_pair_statistics", f"""WITH {_UNIT_SQL}, s AS (SELECT {_SCORE} AS x FROM u a JOIN u b ON a.id < b.id)
SELECT count(*) AS n_pairs, round(avg(x), 6) AS mean_score, round(stddev_pop(x), 6) AS std_score, round(min(x), 6) AS min_score,
  round(max(x), 6) AS max_score, count(*) FILTER (WHERE x > 0.8) AS over_high, count(*) FILTER (WHERE x > 0.3) AS over_low FROM s""")
def vector_pair_statistics(spark, sf_dir):
    s = V.pair_statistics(vectors(spark, sf_dir), [0.8, 0.3])
    return s.select("n_pairs", *[F.round(c, 6).alias(c) for c in ("mean_score", "std_score", "min_score", "max_score")],
                    F.col("over_0").alias("over_high"), F.col("over_1").alias("over_low"))


@query("nearest_for_queries", f"""WITH {_UNIT_SQL},
cells AS (SELECT label, unnest(v) AS x, unnest(range(len(v))) AS pos FROM e),
m AS (SELECT label, pos, avg(x) AS x FROM cells GROUP BY ALL),
q0 AS (SELECT label AS id, list(x ORDER BY pos) AS v FROM m GROUP BY label),
q AS (SELECT *, sqrt(list_dot_product(v, v)) + 1e-8 AS norm FROM q0),
s AS (SELECT a.id AS id, b.id AS other_id, {_SCORE} AS x FROM q a JOIN u b ON true)
SELECT id, other_id, round(x, 5) AS score, row_number() OVER (PARTITION BY id ORDER BY x DESC, other_id) AS rank FROM s
WHERE x >= 0.1 QUALIFY rank <= 10""")
def nearest_for_queries(spark, sf_dir):
    """Ten nearest clauses to each label's mean vector."""
    top = V.top_k_for_queries(label_centroids(spark, sf_dir), vectors(spark, sf_dir), 10, 0.1)
    return top.select("id", "other_id", F.round("score", 5).alias("score"), "rank")


@query("nearest_for_queries_same_type", f"""WITH {_UNIT_SQL},
cells AS (SELECT label, unnest(v) AS x, unnest(range(len(v))) AS pos FROM e),
m AS (SELECT label, pos, avg(x) AS x FROM cells GROUP BY ALL),
q0 AS (SELECT label AS id, list(x ORDER BY pos) AS v FROM m GROUP BY label),
q AS (SELECT *, sqrt(list_dot_product(v, v)) + 1e-8 AS norm FROM q0),
s AS (SELECT a.id AS id, b.id AS other_id, {_SCORE} AS x FROM q a JOIN u b ON a.id = b.label)
SELECT id, other_id, round(x, 5) AS score, row_number() OVER (PARTITION BY id ORDER BY x DESC, other_id) AS rank FROM s
WHERE x >= 0.0 QUALIFY rank <= 10""")
def nearest_for_queries_same_type(spark, sf_dir):
    top = V.top_k_for_queries(label_centroids(spark, sf_dir), vectors(spark, sf_dir), 10, 0.0, same_type_only=True)
    return top.select("id", "other_id", F.round("score", 5).alias("score"), "rank")


_BY_ID_SQL = f"""WITH {_UNIT_SQL},
s AS (SELECT a.id AS id, b.id AS other_id, a.label = b.label AS type_match,
    {_SCORE} * CASE WHEN a.label = b.label THEN 1.1 ELSE 1.0 END AS x FROM u a JOIN u b ON a.id <> b.id AND a.contract <> b.contract),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY x DESC, other_id) AS rank FROM s QUALIFY rank <= 10)"""


@query("nearest_by_clause_id", f"{_BY_ID_SQL} SELECT id, other_id, round(x, 6) AS score, type_match, rank FROM r")
def nearest_by_clause_id(spark, sf_dir):
    return V.top_k_by_id(vectors(spark, sf_dir)).select(
        "id", "other_id", F.round("score", 6).alias("score"), "type_match", "rank")


@query("similar_clause_context", f"""{_BY_ID_SQL}
SELECT id, other_id, 'clause ' || other_id AS similar_text, row_number() OVER (PARTITION BY id ORDER BY rank) AS context_rank
FROM r WHERE type_match AND x > 0.3 AND other_id % 6 <> 0 QUALIFY context_rank <= 3""")
def similar_clause_context(spark, sf_dir):
    """Up to three similar answered clauses of the same type as context for a prompt."""
    v = vectors(spark, sf_dir)
    texts = v.select("id", F.when(F.col("id") % 6 == 0, "").otherwise(F.concat(F.lit("clause "), "id")).alias("answer_text"))
    return V.context_clauses(V.top_k_by_id(v), texts, min_score=0.3).select(
        "id", "other_id", "similar_text", "context_rank")


@query("similarity_csv_export", f"""{_BY_ID_SQL}
SELECT rank, round(x, 6) AS similarity_score, other_id AS clause_id, id AS original_id, 'rank,similarity_score,clause_id,original_id' AS header FROM r""")
def similarity_csv_export(spark, sf_dir):
    """The ten nearest of every vector as CSV in the fixed column order, read back."""
    path = scratch_path(spark, "similar")
    top = V.top_k_by_id(vectors(spark, sf_dir))
    writers.write_similarity_csv(top.select(
        F.col("other_id").alias("clause_id"), "rank", F.col("id").alias("original_id"), F.col("score").alias("similarity_score")), path)
    back = spark.read.option("header", True).schema("rank int, similarity_score double, clause_id long, original_id long").csv(path)
    header = spark.read.text(path).agg(F.max("value")).first()[0]
    return back.withColumn("similarity_score", F.round("similarity_score", 6)).withColumn("header", F.lit(header))


@query("embedding_value_statistics", """WITH c AS (SELECT unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT (SELECT count(*) FROM embeddings) AS n_vectors, 64 AS dimension, round(avg(x), 6) AS mean_value,
  round(stddev_pop(x), 6) AS std_value, round(min(x), 6) AS min_value, round(max(x), 6) AS max_value FROM c""")
def embedding_value_statistics(spark, sf_dir):
    s = V.value_statistics(vectors(spark, sf_dir))
    return s.select("n_vectors", "dimension", *[F.round(c, 6).alias(c) for c in
                                                ("mean_value", "std_value", "min_value", "max_value")])


@query("embedding_counts_by_type", """WITH p AS (SELECT label::VARCHAR AS truth,
  CASE WHEN vec_id % 5 = 0 THEN (label + 1) % 10 ELSE label END::VARCHAR AS predicted FROM embeddings)
SELECT 'truth' AS facet, truth AS type, count(*) AS n FROM p GROUP BY truth
UNION ALL SELECT 'predicted', predicted, count(*) FROM p GROUP BY predicted""")
def embedding_counts_by_type(spark, sf_dir):
    both = predictions(spark, sf_dir).select(F.explode(F.array(
        F.struct(F.lit("truth").alias("facet"), F.col("truth").alias("type")),
        F.struct(F.lit("predicted").alias("facet"), F.col("predicted").alias("type")))).alias("f"))
    return both.groupBy(F.col("f.facet").alias("facet"), F.col("f.type").alias("type")).agg(F.count("*").alias("n"))


def predictions(spark, sf_dir):
    """Truth and a prediction that is wrong for every fifth vector."""
    e = table(spark, sf_dir, "embeddings")
    wrong = F.when(F.col("vec_id") % 5 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return e.select("vec_id", F.col("label").cast("string").alias("truth"), wrong.cast("string").alias("predicted"))


@query("inverted_index", """SELECT label::VARCHAR AS type, vec_id // 4096 AS block_no,
  string_agg(vec_id::VARCHAR, ',' ORDER BY vec_id) AS ids FROM embeddings GROUP BY ALL""")
def inverted_index(spark, sf_dir):
    return V.posting_blocks(vectors(spark, sf_dir), "type", "id").select(
        "type", "block_no", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query("vector_clusters")
def vector_clusters(spark, sf_dir):
    """k-means assignment with ten restarts."""
    assigned, _ = V.kmeans(vectors(spark, sf_dir))
    return assigned


@query("vector_clusters_summary", """SELECT count(*) AS n_vectors, 10 AS n_clusters, true AS no_dearer_than_one_run FROM embeddings""")
def vector_clusters_summary(spark, sf_dir):
    """Every vector in one of ten clusters, at a cost that no single run undercuts."""
    rows = vectors(spark, sf_dir)
    assigned, cost = V.kmeans(rows)
    _, single = V.kmeans(rows, restarts=1)
    return assigned.agg(F.count("*").alias("n_vectors"), F.count_distinct("cluster").cast("int").alias("n_clusters")).withColumn(
        "no_dearer_than_one_run", F.lit(cost <= single))


@query("cluster_profile", """WITH t AS (SELECT vec_id % 7 AS cluster, label::VARCHAR AS type, count(*) AS n FROM embeddings GROUP BY ALL),
m AS (SELECT cluster, type AS most_common_type FROM t QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, type) = 1)
SELECT cluster, sum(n) AS size, count(*) AS distinct_types, any_value(most_common_type) AS most_common_type,
  round(count(*) / sum(n)::DOUBLE, 6) AS diversity FROM t JOIN m USING (cluster) GROUP BY cluster""")
def cluster_profile(spark, sf_dir):
    return V.cluster_profile(vectors(spark, sf_dir).select(F.pmod("id", F.lit(7)).alias("cluster"), "type"))


@query("approximate_vector_pairs", f"""WITH {_UNIT_SQL}
SELECT count(*) AS n_exact, 0::BIGINT AS n_false, true AS nine_of_ten FROM u a JOIN u b ON a.id < b.id WHERE {_SCORE} >= 0.3""")
def approximate_vector_pairs(spark, sf_dir):
    """Pairs from the inverted-file index against the exact ones: none false, at least nine of ten found."""
    rows = vectors(spark, sf_dir)
    exact, found = V.similar_pairs(rows, 0.3).select("id_a", "id_b"), V.approximate_neighbours(rows, 0.3).select("id_a", "id_b", F.lit(1).alias("hit"))
    both = exact.withColumn("true", F.lit(1)).join(found, ["id_a", "id_b"], "full")
    return both.agg(F.count("true").alias("n_exact"), F.count_if(F.col("true").isNull()).alias("n_false"),
                    (F.count_if((F.col("true") == 1) & (F.col("hit") == 1)) >= 0.9 * F.count("true")).alias("nine_of_ten"))


def document_sets(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents"), "doc_id")
    return docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("type"), "text")


def relation_sql(source: str) -> str:
    """The three parts of the relation, by brute force over distinct token sets."""
    return f"""{source},
tok0 AS (SELECT id, type, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> ''))) AS w FROM src),
tok AS (SELECT * FROM tok0 WHERE len(w) > 0),
grp AS (SELECT type, w, min(id) AS rep, count(*) AS n_copies, len(w) AS n FROM tok GROUP BY type, w),
copies AS (SELECT t.type, t.id, g.rep FROM tok t JOIN grp g ON t.type = g.type AND t.w = g.w WHERE t.id <> g.rep),
cells AS (SELECT type, rep, n, n_copies, unnest(w) AS token FROM grp),
sums AS (SELECT rep, sum(hash(token)::HUGEINT) AS total FROM cells GROUP BY rep),
slots AS (SELECT c.*, total - hash(token)::HUGEINT AS rest FROM cells c JOIN sums USING (rep) WHERE (n - 1) / (n + 1)::DOUBLE >= 0.7),
hub AS (SELECT type, n, rest, min(rep) AS hub_rep, arg_min(token, rep) AS hub_token FROM slots GROUP BY ALL HAVING count(*) > 1),
hubs AS (SELECT s.type, h.hub_rep, h.hub_token, s.rep, s.n_copies, (s.n - 1) / (s.n + 1)::DOUBLE AS score
  FROM slots s JOIN hub h ON s.type = h.type AND s.n = h.n AND s.rest = h.rest),
ov AS (SELECT a.type, a.rep AS rep_a, b.rep AS rep_b, a.n AS na, b.n AS nb, a.n_copies AS ca, b.n_copies AS cb, count(*) AS both_n
  FROM cells a JOIN cells b ON a.type = b.type AND a.token = b.token AND a.rep < b.rep AND least(a.n, b.n) >= 0.7 * greatest(a.n, b.n) - 1e-9
  GROUP BY ALL),
sim AS (SELECT *, both_n / (na + nb - both_n)::DOUBLE AS score FROM ov WHERE both_n / (na + nb - both_n)::DOUBLE >= 0.7)"""


_RELATION_SELECT = """SELECT 'copy' AS kind, type, id AS from_id, rep AS to_id, NULL AS hub_token, 1.0::DOUBLE AS score FROM copies
UNION ALL SELECT 'hub', type, rep, hub_rep, hub_token, round(score, 6) FROM hubs
UNION ALL SELECT 'pair', type, rep_a, rep_b, NULL, round(score, 6) FROM sim WHERE NOT (na = nb AND both_n = na - 1)"""
_DOCS = "src AS (SELECT doc_id AS id, lang AS type, text FROM documents)"


@query("text_similarity_relation", f"WITH {relation_sql(_DOCS)} {_RELATION_SELECT}")
def text_similarity_relation(spark, sf_dir):
    return S.similarity_relation(document_sets(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query("text_similarity_pair_counts", f"""WITH {relation_sql(_DOCS)},
eq AS (SELECT type, sum(n_copies * (n_copies - 1) // 2) AS n FROM grp GROUP BY type),
df AS (SELECT type, sum(ca * cb) AS n FROM sim GROUP BY type)
SELECT eq.type, (eq.n + coalesce(df.n, 0))::BIGINT AS n_pairs FROM eq LEFT JOIN df USING (type)""")
def text_similarity_pair_counts(spark, sf_dir):
    return S.pair_counts(document_sets(spark, sf_dir))


@query("text_similarity_minhash", f"""WITH {relation_sql(_DOCS)}
SELECT type, count(*) AS n_exact, true AS all_true, true AS recall_reached FROM sim WHERE NOT (na = nb AND both_n = na - 1) GROUP BY type""")
def text_similarity_minhash(spark, sf_dir):
    """Approximate pairs against the exact number of explicit pairs per type: none false, at least nine of ten found."""
    sets = S.token_sets(document_sets(spark, sf_dir))
    apart = S.minhash_pairs(sets).where("size_a <> size_b OR abs(score - (size_a - 1) / (size_a + 1)) > 1e-9")
    found = apart.groupBy("type").agg(
        F.count("*").alias("n"), F.min(F.col("score")).alias("least"))
    exact = S.explicit_pairs(sets, 0.7).groupBy("type").agg(F.count("*").alias("n_exact"))
    return exact.join(found, "type", "left").select(
        "type", "n_exact", (F.col("least") >= 0.7).alias("all_true"),
        ((F.col("n") >= 0.9 * F.col("n_exact")) & (F.col("n") <= F.col("n_exact"))).alias("recall_reached"))
