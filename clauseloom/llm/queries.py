"""The queries of this subpackage, opN_<name>, with the SQL they are checked against where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored, table
from . import decontaminate, htmltext, langid, mixing, neardup, pii, quality, simhash, spelling, substring, tokenalign, tokencount, urlfilter

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


TOKENIZER = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokencount.with_token_counts(docs, public_tokenizers.path(TOKENIZER), TOKEN_LIMIT).select(
        "doc_id", "n_bytes", "n_tokens", "over_limit")


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ratios = quality.fitted(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, ratios).select("doc_id", "quality_rules.*").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@query
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judged(pages, rules).select("page_id", "host", "path", "rule", "verdict")


ORACLES["op6_url_filter"] = """
WITH u AS (
    SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
p AS (
    SELECT page_id,
           coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
           coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
    FROM u),
rules(h, q, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                          ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
urls AS (SELECT DISTINCT host, path FROM p),
best AS (
    SELECT host, path, arg_max(h || q, length(h || q)) AS rule, arg_max(v, length(h || q)) AS verdict
    FROM urls JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)
    GROUP BY host, path)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN best USING (host, path)
"""


@query
def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in training order of the first copy; documents that the mix does not reach come first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    sizes = stored(mixing.sized(docs, F.col("doc_id")), "op9-sizes")
    mix = mixing.mixed(sizes, sizes.drop("doc_id")).select(
        "doc_id", "size", "source_size", "target", "taken", F.try_element_at("copies", F.lit(1))["position"].alias("position"), "place")
    return mixing.in_order(mix).drop("place")


ORACLES["op9_source_mix"] = """
WITH d AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
           md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')) AS place
    FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rnk FROM s),
w AS (SELECT *, (rnk % 3 + 1)::BIGINT AS weight, source_size * 3 AS cap FROM r),
f AS (
    SELECT *, row_number() OVER o AS nth,
           (sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
           / (sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level
    FROM w WINDOW o AS (ORDER BY cap::DOUBLE / weight, rnk)),
g AS (SELECT *, min(CASE WHEN cap > level * weight THEN nth END) OVER () AS first_open FROM f),
t AS (
    SELECT source, source_size, rnk,
           CASE WHEN first_open IS NULL OR nth < first_open THEN cap::DOUBLE
                ELSE max(CASE WHEN nth = first_open THEN level END) OVER () * weight END AS target
    FROM g),
m AS (
    SELECT d.doc_id, d.size, t.source_size, t.target, t.rnk, floor(t.target)::BIGINT AS wanted,
           (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS start
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, CASE WHEN source_size > 0 THEN wanted // source_size ELSE 0 END AS whole FROM m),
q AS (SELECT *, greatest(0, least(size, wanted - whole * source_size - start)) AS part, start::DOUBLE / target AS f FROM k)
SELECT doc_id, size, source_size, target, (whole * size + part)::BIGINT AS taken,
       CASE WHEN size = 0 OR whole + part = 0 THEN NULL
            WHEN rnk % 3 = 0 THEN 0.0 + (f * 1.0 - 0.0) / 1.0
            WHEN rnk % 3 = 1 THEN 0.0 + (sqrt(greatest(0.0, 2.25 + -2.0 * (f * 1.0 - 0.0))) - 1.5) / -1.0
            WHEN f <= 0.375 THEN 0.0 + (sqrt(greatest(0.0, 0.25 + 2.0 * (f * 1.0 - 0.0))) - 0.5) / 1.0
            ELSE 0.5 + (sqrt(greatest(0.0, 1.0 + 2.0 * (f * 1.0 - 0.375))) - 1.0) / 1.0 END AS position
FROM q
"""


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    learned = docs.where(~held_out & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("key"), "text", "lang")
    model = langid.fitted(learned)
    return docs.select("doc_id", held_out.alias("held_out"), langid.predicted(F.col("text"), model).alias("p")).select(
        "doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


@query
def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return htmltext.with_main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = pii.trained(pii.pattern_counts(docs))
    return docs.select("doc_id", pii.found(F.col("text"), model).alias("p")).select("doc_id", "p.*")


@query
def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.grouped(table(spark, sf_dir, "documents"), shingle=2, percent=80)


@query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents, with the items they overlap."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))


@query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regions that are cut out, one row each, with the document that keeps the passage."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.repeated_regions(docs).select(
        "doc_id", "first_doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "n_runs")


@query
def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.grouped(table(spark, sf_dir, "documents"))


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


@query
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokenalign.with_alignment(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path(TOKENIZER))


ORACLES["op1_decontamination"] = """
WITH d AS (SELECT doc_id, hash(text) AS k, list_filter(regexp_split_to_array(regexp_replace(lower(text), '([\\p{Han}\\p{Hiragana}\\p{Katakana}\\p{Thai}\\p{Lao}\\p{Khmer}\\p{Myanmar}])', ' \\1 ', 'g'), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS t FROM documents WHERE text IS NOT NULL),
i0 AS (SELECT item_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '([\\p{Han}\\p{Hiragana}\\p{Katakana}\\p{Thai}\\p{Lao}\\p{Khmer}\\p{Myanmar}])', ' \\1 ', 'g'), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS t FROM benchmark WHERE text IS NOT NULL),
i AS (SELECT min(item_id) AS item_id, t, hash(t) AS ik FROM i0 WHERE len(t) >= 1 GROUP BY t),
short AS (SELECT DISTINCT len(t) AS n FROM i WHERE len(t) < 8),
dp AS (SELECT doc_id, k, t, unnest(range(1, len(t) + 1)) AS p FROM d),
ip AS (SELECT ik, t, unnest(range(1, len(t) + 1)) AS p FROM i WHERE len(t) >= 8),
masks(m, x) AS (VALUES (0, [0, 1, 3, 6, 7]), (1, [0, 1, 3, 4, 5]), (2, [0, 1, 2, 3, 6]), (3, [0, 1, 3, 5, 7]), (4, [0, 4, 5, 6, 7])),
ds AS (SELECT doc_id, k, p, m, hash([t[p], t[p + x[2]], t[p + x[3]], t[p + x[4]], t[p + x[5]]]) AS s FROM dp, masks WHERE p + x[5] <= len(t)
  UNION ALL SELECT doc_id, k, p, -n, hash(t[p:p + n - 1]) FROM dp, short WHERE p + n - 1 <= len(t)),
s AS (SELECT ik, p, m, hash([t[p], t[p + x[2]], t[p + x[3]], t[p + x[4]], t[p + x[5]]]) AS s FROM ip, masks WHERE p + x[5] <= len(t)
  UNION ALL SELECT ik, 1, -len(t), hash(t) FROM i WHERE len(t) < 8),
g AS (SELECT DISTINCT doc_id, k, ik, ds.p - s.p AS shift FROM ds JOIN s ON ds.m = s.m AND ds.s = s.s),
l AS (SELECT g.doc_id, i.item_id, least(13, len(i.t)) AS w,
    list_transform(range(1, len(i.t) + 1), lambda j: CASE WHEN j + shift >= 1 AND i.t[j] = d.t[j + shift] THEN 1 ELSE 0 END) AS same
  FROM g JOIN d ON g.doc_id IS NOT DISTINCT FROM d.doc_id AND g.k = d.k JOIN i ON g.ik = i.ik),
b AS (SELECT doc_id, item_id, w, list_sum(same) AS shared,
    list_max(list_transform(range(1, len(same) - w + 2), lambda j: list_sum(same[j:j + w - 1]))) AS matched FROM l)
SELECT doc_id, item_id, max(matched)::BIGINT AS matched, max(w)::BIGINT AS "window", max(shared)::BIGINT AS shared
FROM b WHERE 100 * matched >= 76 * w GROUP BY doc_id, item_id
"""

ORACLES["op2_near_duplicates"] = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS t FROM documents),
s AS (SELECT doc_id, CASE WHEN t IS NULL OR len(t) = 0 THEN []::VARCHAR[] WHEN len(t) = 1 THEN [t[1]]
    ELSE list_sort(list_distinct(list_transform(range(1, len(t)), lambda j: t[j] || ' ' || t[j + 1]))) END AS g FROM w),
sets AS (SELECT g, min(doc_id) AS rep, len(g) AS n FROM s WHERE len(g) > 0 GROUP BY g),
x AS (SELECT rep, n, unnest(g) AS c FROM sets),
ov AS (SELECT a.rep AS a, b.rep AS b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb FROM x a JOIN x b ON a.c = b.c AND a.rep < b.rep
  AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.rep, b.rep),
e AS (SELECT a, b FROM ov WHERE 100 * k >= 80 * (na + nb - k)),
sym AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT rep AS a, rep AS b FROM sets UNION SELECT r.a, sym.b FROM r JOIN sym ON r.b = sym.a),
c AS (SELECT a AS rep, min(b) AS component_id FROM r GROUP BY a)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id,
  s.doc_id = coalesce(c.component_id, s.doc_id) AS kept
FROM s LEFT JOIN sets ON s.g = sets.g LEFT JOIN c ON sets.rep = c.rep
"""
