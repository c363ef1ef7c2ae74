"""Quality rules: per-text counts, and a log-likelihood ratio of hashed n-grams between trusted and raw text.

Words and pairs of neighbouring words (lower-cased on A-Z) are hashed into a fixed number
of buckets. One multinomial is counted over all documents, one over trusted documents; a
document's score is the mean of log(trusted / raw) over all its n-grams, so long texts are
not favoured, and it is kept if the score reaches a fixed threshold. The same text gets
the same verdict wherever it stands.

The raw counts cover every document. The trusted side is a fit on labelled rows, bounded by
``TRUSTED_ROWS``: the documents of that many labels, the smallest by hash of their id.

Defined cases: a null or empty text has zero counts, fails the base rules and scores 0;
repeated rows count as often as they stand; labels for absent documents and null labels
are ignored, several labels of a document count once if any trusts it; without trusted
text the ratio is 0 everywhere and only the base rules reject; other columns go along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textarrays import Piece, mixed, ngrams, pieces

BUCKETS = 1 << 16
TRUSTED_ROWS = 20_000
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
THRESHOLD = -0.3
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def buckets_of(piece: Piece) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of every word and every pair of neighbouring words."""
    starts, ends = piece.words()
    texts = piece.texts_of(starts)
    single = piece.hashes(starts, ends, lower=True)
    double, at = ngrams(single, texts, 2)
    return (np.concatenate([mixed(single), double]) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([texts, texts[at]])


def ngram_counts(docs: DataFrame, trusted: Column, text: str = "text") -> DataFrame:
    """(bucket, raw, trusted): n-grams of all rows, and of the rows for which ``trusted`` is true."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            flags = batch.column(1).fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
            for piece in pieces(batch.column(0)):
                buckets, texts = buckets_of(piece)
                raw += np.bincount(buckets, minlength=BUCKETS)
                chosen = flags[piece.first + texts]
                if chosen.any():
                    good += np.bincount(buckets[chosen], minlength=BUCKETS)
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(raw[seen]), pa.array(good[seen])], ["bucket", "raw", "trusted"])

    parts = docs.select(F.col(text), trusted.alias("trusted")).mapInArrow(counted, "bucket long, raw long, trusted long")
    return parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))


def log_ratios(counts: DataFrame) -> np.ndarray:
    """log(trusted / raw) per bucket, with one added to each count; BUCKETS values."""
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for bucket, r, t in counts.collect():  # BUCKETS rows at most
        raw[bucket], good[bucket] = r, t
    if not good.sum():
        return np.zeros(BUCKETS)
    return np.log((good + 1) / (good.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


def fitted(docs: DataFrame, labels: DataFrame, rows: int = TRUSTED_ROWS) -> np.ndarray:
    """The log ratios for a corpus, with labels (doc_id, quality, toxic); trusted: quality 1 and not toxic."""
    good = labels.where("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("good_id")).distinct()
    good = good.orderBy(F.xxhash64("good_id"), "good_id").limit(rows)
    flagged = docs.select("doc_id", "text").join(F.broadcast(good), F.col("doc_id") == F.col("good_id"), "left")
    return log_ratios(ngram_counts(flagged, F.col("good_id").isNotNull()))


def measured(piece: Piece, ratios: np.ndarray | None) -> dict[str, np.ndarray]:
    """The counts and the score of each text of a piece."""
    n, data = piece.n, piece.data
    starts, ends = piece.words()
    texts = piece.texts_of(starts)
    hashes = piece.hashes(starts, ends)
    words = np.bincount(texts, minlength=n)
    inside = np.zeros(len(data) + 1, np.int64)
    inside[starts] += 1  # starts are distinct, and so are ends
    inside[ends] -= 1
    in_word = np.cumsum(inside[:-1]) > 0
    chars = piece.sums(in_word & ((data & 0xC0) != 0x80))

    # lines with a word that equal an earlier line of the same text; the whole line counts, white space too
    first, last = piece.runs(data != 10)
    line_text = piece.texts_of(first)
    has_word = np.searchsorted(starts, last) > np.searchsorted(starts, first)
    line = mixed(piece.hashes(first, last) + line_text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[has_word]
    line_text = line_text[has_word]
    new = np.zeros(len(line), bool)
    new[np.unique(line, return_index=True)[1]] = True
    dup_lines = np.bincount(line_text[~new], minlength=n)

    grams, at = ngrams(hashes, texts, 5)
    _, inverse, count = np.unique(mixed(grams + texts[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
    again = at[count[inverse] > 1]
    cover = np.zeros(len(hashes) + 1, np.int64)
    cover[again] += 1  # positions are distinct
    cover[again + 5] -= 1
    repeats = np.bincount(texts[np.cumsum(cover[:-1]) > 0], minlength=n)

    out = {"n_words": words, "word_chars": chars, "n_symbols": piece.sums(SYMBOLS[data]), "n_dup_lines": dup_lines, "n_repeat_words": repeats}
    if ratios is not None:
        buckets, of = buckets_of(piece)
        total = np.bincount(of, minlength=n)
        out["score"] = np.bincount(of, weights=ratios[buckets], minlength=n) / np.maximum(total, 1)
    return out


def measures(text: Column, ratios: np.ndarray) -> Column:
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    @F.arrow_udf(", ".join(f"{f} long" for f in fields) + ", score double")
    def measure(column: pa.Array) -> pa.Array:
        parts = [measured(p, ratios) for p in pieces(column)]
        arrays = [np.concatenate([p[f] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64) for f in fields]
        arrays.append(np.concatenate([p["score"] for p in parts]) if parts else np.zeros(0))
        return pa.StructArray.from_arrays([pa.array(a) for a in arrays], [*fields, "score"])

    return measure(text)


def scored(docs: DataFrame, ratios: np.ndarray, threshold: float = THRESHOLD, text: str = "text", to: str = "quality_rules") -> DataFrame:
    """Adds struct ``to``: the counts, score, base_failed and kept."""
    m = F.col(to)
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
    return docs.withColumn(to, measures(F.col(text), ratios)).withColumn(
        to, m.withField("base_failed", failed)).withColumn(to, m.withField("kept", ~m["base_failed"] & (m["score"] >= threshold)))
