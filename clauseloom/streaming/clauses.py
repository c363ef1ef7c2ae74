"""Streaming extraction: the stateless extractors and keyed de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.operators.extraction import extract_clauses, to_long
from clauseloom.session import dealt


def extracted_stream(clauses: DataFrame, delay: str | None = None) -> DataFrame:
    """``clauses``: ts timestamp, contract_id, clause_type, clause_seq, text; as stream or table.

    As in the batch run, clauses are extracted, those without a value drop out, and then
    repeats of contract, type and text. The keys seen are kept for good, whatever order
    the clauses arrive in; with ``delay`` they expire behind a watermark on ``ts``.
    """
    key = ["contract_id", "clause_type", "_text_key"]
    # dealt out first: a batch may be one file with one split
    found = extract_clauses(dealt(clauses, "clause_seq")).withColumn("_text_key", F.sha2("text", 256))
    once = found.dropDuplicates(key) if delay is None else found.withWatermark("ts", delay).dropDuplicatesWithinWatermark(key)
    return to_long(once.drop("_text_key"))


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything that is there into a parquet table, then stop."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(
        "append").trigger(availableNow=True).start().awaitTermination()
