"""Writers: tables partitioned the way later stages read them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clauseloom.session import stored, swept

# Column order of exported similarity results.
SIMILARITY_COLUMNS = [
    "rank", "similarity_score", "predicted_clause_type", "ground_truth_clause_type", "clause_id",
    "original_id", "split", "question", "answer_text", "context", "multiclass_confidence",
]


def write_processed(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").partitionBy("split").parquet(path)


def write_clause_datasets(rows: DataFrame, path: str) -> None:
    """One directory per split and type.

    Rebalancing brings the rows of a directory together, and adaptive execution cuts a
    type that holds much of the data into tasks of the advisory size.
    """
    rows.hint("rebalance", "split", "clause_type").write.mode("overwrite").partitionBy("split", "clause_type").parquet(path)


def write_training_samples(samples: DataFrame, path: str) -> None:
    """Both tasks as JSON, partitioned by split and task."""
    tasks = samples.select(
        "split", "text", "contract_id", "clause_type", "has_answer",
        F.explode(F.array(
            F.struct(F.lit("binary").alias("task"), F.col("binary_label").cast("string").alias("label")),
            F.struct(F.lit("multiclass").alias("task"), F.col("clause_type").alias("label")))).alias("t"))
    tasks.select("text", "contract_id", "clause_type", "has_answer", "split", "t.label", "t.task").write.mode(
        "overwrite").partitionBy("split", "task").json(path)


def write_extractions(long: DataFrame, path: str, mode: str, max_contracts: int | None) -> None:
    """Long table plus a one-row run record beside it."""
    long.write.mode("overwrite").parquet(f"{path}/extractions")
    written = long.sparkSession.read.parquet(f"{path}/extractions")
    written.agg(
        F.lit(mode).alias("mode"), F.lit(max_contracts).cast("int").alias("max_contracts"),
        F.count("*").alias("total_variables"), F.count_if(F.col("var_pos") == 0).alias("total_extractions"),
        F.count_distinct("contract_id").alias("contracts"), F.current_timestamp().alias("written_at"),
    ).write.mode("overwrite").parquet(f"{path}/run")


def write_embeddings(table: DataFrame, path: str, by: str) -> None:
    """Partitioned by a column; rebalanced, so that a partition is a few files of the advisory size."""
    table.hint("rebalance", by).write.mode("overwrite").partitionBy(by).parquet(path)


def write_similarity_csv(results: DataFrame, path: str) -> None:
    """Fixed column order; columns the frame lacks are skipped."""
    results.select(*[c for c in SIMILARITY_COLUMNS if c in results.columns]).write.mode("overwrite").option(
        "header", True).csv(path)


def long_metrics(frame: DataFrame, component: str, category: str, count: str) -> DataFrame:
    """component, metric_type, category, value, count - one row per metric."""
    metrics = [c for c in frame.columns if c not in (category, count)]
    wide = frame.select(F.col(category).cast("string").alias("category"), F.col(count).cast("bigint").alias("count"),
                        *[F.col(m).cast("double") for m in metrics])
    return wide.unpivot(["category", "count"], metrics, "metric_type", "value").select(
        F.lit(component).alias("component"), "metric_type", "category", "value", "count")


def write_graph(tables, path: str) -> None:
    """One table per node label and edge type, rewritten as a whole.

    Ids hold hashes as hexadecimal digits, which zstd halves; edges are sorted inside files, so that an id
    which several edges share is stored about once.  What is written is read back where a later
    table is made of it, if ``tables`` are ``GraphTables``.
    """
    for name in tables.names() if hasattr(tables, "names") else list(tables):
        frame = tables[name]
        spark = frame.sparkSession
        rows = frame.sortWithinPartitions("to_id") if "to_id" in frame.columns else frame
        with swept(spark):
            rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
        if hasattr(tables, "put"):
            tables.put(name, spark.read.schema(frame.schema).parquet(f"{path}/{name}"))


def _with_bucket(rows: DataFrame, by: str, buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64(by), F.lit(buckets)).cast("int"))


def _write_buckets(rows: DataFrame, path: str) -> None:
    """Only the buckets that ``rows`` holds are replaced; a bucket with a hot key is cut into several files."""
    rows.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "bucket").parquet(path)


def write_versions(rows: DataFrame, path: str, by: str, buckets: int = 256) -> None:
    """A node or edge table that changes can be applied to, in buckets of the hash of ``by``.

    Bucket by what changes together, such as the contract of a clause.  Every row starts as
    version 0.  ``buckets`` has to be the same in every later call.
    """
    _write_buckets(_with_bucket(rows, by, buckets).withColumns({"version": F.lit(0).cast("bigint"), "gone": F.lit(False)}), path)


def apply_versions(changes: DataFrame, path: str, keys: list[str], by: str, buckets: int = 256) -> list[int]:
    """Apply changes to a table of ``write_versions``; returns the buckets that were rewritten.

    ``changes`` has the table's columns, ``version`` and ``gone``.  The highest version of a
    key wins, of equal versions a removal, then any row of equal content; the same changes
    twice, or sets of changes in any order, give the same table.  Removed rows stay as
    marks, so an older change that comes late does not bring them back.  A null key is a
    key, a null ``gone`` is false, a null ``version`` is 0.  Buckets without a change are
    neither read nor written; at most ``buckets`` numbers come to the driver.
    """
    spark = changes.sparkSession
    marked = _with_bucket(changes, by, buckets).withColumns(
        {"version": F.coalesce("version", F.lit(0)).cast("bigint"), "gone": F.coalesce("gone", F.lit(False))})
    fresh = stored(marked, "changes")
    touched = sorted(r.bucket for r in fresh.select("bucket").distinct().collect())
    if not touched:
        return []
    current = spark.read.parquet(path).where(F.col("bucket").isin(touched))
    content = F.xxhash64(*[c for c in sorted(current.columns) if c not in ("bucket", "version", "gone")])
    last = Window.partitionBy("bucket", *keys).orderBy(F.desc("version"), F.desc("gone"), content)
    merged = current.unionByName(fresh).withColumn("_rn", F.row_number().over(last)).where("_rn = 1").drop("_rn")
    # stored first: a bucket cannot be read and replaced in one job
    _write_buckets(stored(merged, "merged"), path)
    return touched


def read_versions(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the table that are not removed."""
    return spark.read.parquet(path).where("NOT gone").drop("gone", "version", "bucket")


def write_lifecycle(tables: dict[str, DataFrame], path: str, bucket_rows: int = 1_000_000) -> None:
    """states, transitions and validation, partitioned by a hash bucket of the machine, about ``bucket_rows`` rows each."""
    for name, frame in tables.items():
        buckets = frame.count() // bucket_rows + 1
        frame.withColumn("bucket", F.pmod(F.xxhash64("machine"), F.lit(buckets)).cast("int")).hint(
            "rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}")


def write_report(one_row: DataFrame, path: str) -> None:
    one_row.write.mode("overwrite").json(path)
