"""The rendered clause corpus: one clause sentence per order.

The driver tables hold no contract wording, so clause sentences are built from
typed columns; the source column is then the expected value of an extractor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.session import dealt, table

KINDS = [
    "agreement_date", "effective_date", "cap_on_liability", "minimum_commitment",
    "notice_period_renewal", "revenue_profit_sharing", "non_compete", "audit_rights",
    "parties", "governing_law", "volume_restriction", "insurance",
]


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def rendered_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contract_id, clause_seq, clause_type, text and the typed source columns.

    customer and nation are left to the optimizer: their sizes are in the file
    statistics, so Spark broadcasts them only below its size threshold.
    """
    orders = dealt(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"), "o_orderkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    base = (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .withColumn("kind", F.pmod("o_orderkey", F.lit(12)).cast("int"))
        .withColumn("n", (F.pmod("o_orderkey", F.lit(90)) + 1).cast("int"))
        .withColumn("side", F.when(F.pmod("o_custkey", F.lit(2)) == 0, "North").otherwise("South"))
    )
    n = F.col("n").cast("string")
    money = F.format_number("o_totalprice", 2)
    sentences = [
        F.concat(F.lit("This Agreement is made on "), F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit(".")),
        F.concat(F.lit("This Agreement takes effect on "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(".")),
        F.concat(F.lit("Liability is limited to $"), money, F.lit(".")),
        F.concat(F.lit("Buyer must purchase a minimum of $"), money, F.lit(".")),
        F.concat(F.lit("Either side may give "), n, F.lit(" days notice before renewal.")),
        F.concat(F.lit("Partner shall receive "), n, F.lit("% of net revenue.")),
        F.concat(F.lit("The distributor shall not compete for "), n, F.lit(" months.")),
        F.concat(F.lit("The licensee is subject to audit every "), n, F.lit(" months.")),
        F.concat(F.lit("This Agreement is made by and between "), F.initcap("c_mktsegment"),
                 F.lit(" Trading Corporation and "), F.col("side"),
                 F.lit(" Supply Corporation WHEREAS both agree.")),
        F.concat(F.lit("Governed by the laws of "), F.col("n_name"), F.lit(".")),
        F.concat(F.lit("Orders are limited to "), n, F.lit(" units per quarter.")),
        F.concat(F.lit("Coverage of EUR "), money, F.lit(" is mandatory.")),
    ]
    text = F.lit(None).cast("string")
    for i, sentence in reversed(list(enumerate(sentences))):
        text = F.when(F.col("kind") == i, sentence).otherwise(text)
    return base.select(
        F.concat(F.lit("CONTRACT_"), F.col("o_custkey")).alias("contract_id"),
        F.col("o_orderkey").alias("clause_seq"),
        _pick(KINDS, F.col("kind")).alias("clause_type"),
        text.alias("text"),
        "kind", "n", "side", "o_custkey", "o_orderdate", "o_totalprice", "c_mktsegment", "n_name",
    )


# The same corpus for the oracle: a WITH body that defines ``clauses``.
_KIND_LIST = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
CLAUSES_SQL = f"""
base AS (
  SELECT o.*, c.c_mktsegment, n.n_name, (o_orderkey % 12)::INT AS kind,
         (o_orderkey % 90 + 1)::INT AS n,
         CASE WHEN o_custkey % 2 = 0 THEN 'North' ELSE 'South' END AS side,
         upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS seg
  FROM orders o JOIN customer c ON o_custkey = c_custkey JOIN nation n ON c_nationkey = n_nationkey
),
clauses AS (
  SELECT 'CONTRACT_' || o_custkey AS contract_id, o_orderkey AS clause_seq,
         ({_KIND_LIST})[kind + 1] AS clause_type,
         CASE kind
           WHEN 0 THEN 'This Agreement is made on ' || strftime(o_orderdate, '%B %-d, %Y') || '.'
           WHEN 1 THEN 'This Agreement takes effect on ' || strftime(o_orderdate, '%Y-%m-%d') || '.'
           WHEN 2 THEN 'Liability is limited to $' || format('{{:,.2f}}', o_totalprice) || '.'
           WHEN 3 THEN 'Buyer must purchase a minimum of $' || format('{{:,.2f}}', o_totalprice) || '.'
           WHEN 4 THEN 'Either side may give ' || n || ' days notice before renewal.'
           WHEN 5 THEN 'Partner shall receive ' || n || '% of net revenue.'
           WHEN 6 THEN 'The distributor shall not compete for ' || n || ' months.'
           WHEN 7 THEN 'The licensee is subject to audit every ' || n || ' months.'
           WHEN 8 THEN 'This Agreement is made by and between ' || seg || ' Trading Corporation and '
                       || side || ' Supply Corporation WHEREAS both agree.'
           WHEN 9 THEN 'Governed by the laws of ' || n_name || '.'
           WHEN 10 THEN 'Orders are limited to ' || n || ' units per quarter.'
           ELSE 'Coverage of EUR ' || format('{{:,.2f}}', o_totalprice) || ' is mandatory.'
         END AS text,
         kind, n, side, seg, o_custkey, o_orderdate, o_totalprice, c_mktsegment, n_name
  FROM base
)"""
