"""Readers for the corpus, extraction and embedding files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.operators.corpus import QA_SCHEMA, flatten_corpus

# File stem -> split name.
SPLIT_FILES = [("CUADv1", "main"), ("test", "test"), ("train_separate_questions", "train")]

PROCESSED_SCHEMA = (
    "contract_id string, base_contract_id string, title string, context string, question string, "
    "clause_type string, has_answer boolean, answer_text string, answer_start int, context_length int, "
    "answer_length int, was_truncated boolean, split string"
)
EXTRACTION_SCHEMA = (
    "contract_id string, clause_type string, extractions map<string,string>, original_text string, "
    "source_clause string"
)


def exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def read_qa_corpus(spark: SparkSession, path: str, layout: str = "lines") -> DataFrame:
    """Nested corpus as one row per question.

    ``file``: the published form, one JSON document ``{"data": [...]}`` per file,
    which Spark can only read whole.  ``lines``: one contract record per line,
    splittable, the form to use for large corpora.
    """
    if layout == "file":
        record = QA_SCHEMA.replace("idx bigint, title string, paragraphs array", "title: string, paragraphs: array")
        nested = spark.read.schema(f"data array<struct<{record}>>").option("multiLine", True).json(path)
        docs = nested.select(F.posexplode("data").alias("idx", "d")).select("idx", "d.*")
    else:
        docs = spark.read.schema(QA_SCHEMA).json(path)
        docs = docs.withColumn("idx", F.coalesce("idx", F.abs(F.xxhash64("title", F.to_json("paragraphs")))))
    return flatten_corpus(docs)


def read_splits(spark: SparkSession, folder: str, layout: str = "lines") -> DataFrame:
    """The three split files as one table; a missing file is skipped."""
    out = None
    for stem, split in SPLIT_FILES:
        path = f"{folder}/{stem}.json"
        if not exists(spark, path):
            continue
        part = read_qa_corpus(spark, path, layout).withColumn("split", F.lit(split))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise FileNotFoundError(f"no corpus file in {folder}")
    return out


def read_processed(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Processed rows with their fixed types; a missing answer reads as ''."""
    reader = spark.read.schema(PROCESSED_SCHEMA)
    if fmt == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
    rows = reader.format(fmt).load(path)
    return rows.withColumn("answer_text", F.coalesce(F.trim("answer_text"), F.lit("")))


def read_training_samples(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_extractions(spark: SparkSession, path: str, layout: str = "lines") -> DataFrame:
    """Extraction records from any of the five shapes.

    ``lines``: one record per line, unreadable lines skipped.  ``document``: whole
    files that hold ``{metadata, extractions}``, ``{results}``, one record or a list.
    """
    if layout == "lines":
        raw = spark.read.schema(EXTRACTION_SCHEMA + ", _corrupt_record string").option(
            "columnNameOfCorruptRecord", "_corrupt_record").json(path)
        return raw.where("_corrupt_record IS NULL").drop("_corrupt_record")
    return parse_extraction_documents(spark.read.text(path, wholetext=True))


def parse_extraction_documents(docs: DataFrame) -> DataFrame:
    """Records of JSON documents in a ``value`` column, whichever of four shapes they have."""
    fields = EXTRACTION_SCHEMA.replace(" string", ": string").replace(" map<", ": map<")
    whole = docs.select("value", F.ltrim("value").startswith("[").alias("bare"))
    records = (
        F.when(F.col("bare"), F.from_json("value", f"array<struct<{fields}>>"))
        .when(F.get_json_object("value", "$.extractions").startswith("["),
              F.from_json("value", f"struct<extractions: array<struct<{fields}>>>")["extractions"])
        .when(F.get_json_object("value", "$.results").isNotNull(),
              F.from_json("value", f"struct<results: array<struct<{fields}>>>")["results"])
        .otherwise(F.array(F.from_json("value", f"struct<{fields}>")))
    )
    return whole.select(F.explode(records).alias("r")).select("r.*")


def _files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Path and time of the files that match a pattern; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option(
        "recursiveFileLookup", True).load(folder).select("path", "modificationTime")


def newest_file(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Path and time of the most recently modified file that matches a pattern."""
    return _files(spark, folder, pattern).agg(
        F.max_by("path", F.struct("modificationTime", "path")).alias("path"), F.max("modificationTime").alias("modified_at"))


def newest_run(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Folder and time of the newest output: of equal times the last path, and all files beside it belong to it."""
    newest = newest_file(spark, folder, pattern)
    return newest.withColumn("path", F.regexp_replace("path", "/[^/]*$", ""))


def file_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Files and bytes by extension; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    return files.withColumn("extension", F.regexp_extract("path", r"(\.[^./]+)$", 1)).groupBy("extension").agg(
        F.count("*").alias("n_files"), F.sum("length").alias("n_bytes"))


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """One table of vectors beside their metadata."""
    return spark.read.parquet(path)
