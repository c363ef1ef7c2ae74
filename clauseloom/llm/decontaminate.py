"""Benchmark passages in training text, by spaced seeds and substitution-tolerant overlaps.

Tokens are runs of letters and digits, lower-cased; in scripts without spaces each character
is one. Each of ``MASKS`` reads five tokens of a window of at most eight and ignores the
others; its hash is a seed. Seeds of all benchmark items and of all documents meet in an
equi-join, and a shared seed puts an item and a document on a diagonal (the difference of
the two positions). Only these diagonals are verified, token against token: a document is
contaminated by an item if some window of ``WINDOW`` item tokens, or the whole of a shorter
item, has at least ``PERCENT`` of its tokens at the same places of the document. For windows
of 8 to 13 tokens every placement of the substitutions that ``PERCENT`` allows leaves a seed
of some mask whole. An item of fewer than ``SPAN`` tokens has one seed, all its tokens, and
is found as an exact copy.

All of it is DataFrame functions. Seeds of the benchmark are broadcast if there are at most
``BROADCAST_SEEDS``, and joined by shuffle beyond it. A seed met often costs a row per
document and item; verified rows are distinct.

Defined cases: a text or item that is null or has no tokens has no seeds and matches
nothing; items of equal tokens count as one, named by the smallest id; rows of one
id are one document each for the search and one row in the result; a null document id is
an id like another; empty tables give empty results; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASKS = ((0, 1, 3, 6, 7), (0, 1, 3, 4, 5), (0, 1, 2, 3, 6), (0, 1, 3, 5, 7), (0, 4, 5, 6, 7))
#: A character of a script that is written without spaces.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"
SPAN = 8
WINDOW = 13
PERCENT = 76
BROADCAST_SEEDS = 2_000_000


def token_hashes(text: Column) -> Column:
    """array<long>: the hash of every token, in order."""
    lower = F.lower(text)
    unspaced = (F.octet_length(text) != F.length(text)) & lower.rlike(UNSPACED)
    apart = F.when(unspaced, F.regexp_replace(lower, f"({UNSPACED})", " $1 ")).otherwise(lower)
    hashes = F.transform(F.split(apart, r"[^\p{L}\p{N}]+"), lambda w: F.xxhash64(w))
    return F.array_remove(hashes, F.xxhash64(F.lit("")))


def seed(mask: tuple[int, ...], tokens: list[Column]) -> Column:
    """The seed of one mask from the tokens of its window, null if the window is not whole."""
    return F.when(tokens[mask[-1]].isNotNull(), F.xxhash64(F.lit(",".join(map(str, mask))), *(tokens[p] for p in mask)))


def with_seeds(hashed: DataFrame, *kept: str, short: tuple[int, ...] = ()) -> DataFrame:
    """One row per seed: the kept columns, seed and at (token position); each length of short items is a mask too."""
    shifted = [F.slice("hashes", p + 1, F.size("hashes")).alias(f"t{p}") for p in range(SPAN)]
    places = hashed.select(*kept, F.posexplode(F.arrays_zip(*shifted)).alias("at", "w"))
    tokens = [F.col(f"w.t{p}") for p in range(SPAN)]
    found = F.array(*(seed(mask, tokens) for mask in MASKS + tuple(tuple(range(n)) for n in short)))
    return places.select(*kept, "at", F.explode(found).alias("seed")).where("seed IS NOT NULL")


def laid_on(item: Column, doc: Column, shift: Column) -> Column:
    """array<int>: 1 for each item token that the document has at the same place, shifted."""
    return F.transform(F.sequence(F.lit(0), F.size(item) - 1),
                       lambda j: F.when(F.get(item, j) == F.get(doc, j + shift), 1).otherwise(0))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, matched, window, shared): one row per document and item that overlap.

    ``matched`` tokens of ``window`` agree in the best window, ``shared`` on the whole diagonal.
    """
    items = benchmark.select("item_id", token_hashes(F.col("text")).alias("hashes")).where(F.size("hashes") > 0)
    items = items.groupBy("hashes").agg(F.min("item_id").alias("item_id")).withColumn("item_key", F.xxhash64("hashes"))
    few_tokens = items.where(F.size("hashes") < SPAN)
    short = tuple(sorted(r[0] for r in few_tokens.select(F.size("hashes")).distinct().collect()))  # fewer than SPAN numbers
    item_seeds = with_seeds(items.where(F.size("hashes") >= SPAN), "item_key").select("item_key", "seed", "at")
    for n in short:
        whole = seed(tuple(range(n)), [F.get("hashes", F.lit(p)) for p in range(n)])
        item_seeds = item_seeds.union(few_tokens.where(F.size("hashes") == n).select("item_key", whole.alias("seed"), F.lit(0).alias("at")))
    item_seeds = item_seeds.withColumnRenamed("at", "item_at")
    few = item_seeds.limit(BROADCAST_SEEDS + 1).count() <= BROADCAST_SEEDS

    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    hashed = texts.select("doc_id", "text_key", token_hashes(F.col("text")).alias("hashes"))
    hits = with_seeds(hashed, "doc_id", "text_key", short=short).join(F.broadcast(item_seeds) if few else item_seeds, "seed")
    diagonals = hits.select("doc_id", "text_key", "item_key", (F.col("at") - F.col("item_at")).alias("shift")).distinct()

    d = diagonals.select(F.col("doc_id").alias("hit_doc"), F.col("text_key").alias("hit_key"), "item_key", "shift")
    found = texts.join(d, F.col("doc_id").eqNullSafe(F.col("hit_doc")) & (F.col("text_key") == F.col("hit_key")))
    found = found.select("doc_id", "item_key", "shift", token_hashes(F.col("text")).alias("tokens")).join(items, "item_key")
    laid = found.select("doc_id", "item_id", laid_on(F.col("hashes"), F.col("tokens"), F.col("shift")).alias("same"))
    window = F.least(F.lit(WINDOW), F.size("same"))
    laid = laid.withColumn("window", window)
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.size("same") - F.col("window") + 1),
                                   lambda j: F.size(F.filter(F.slice("same", j, F.col("window")), lambda x: x == 1))))
    laid = laid.select("doc_id", "item_id", "window", best.alias("matched"), F.size(F.filter("same", lambda x: x == 1)).alias("shared"))
    laid = laid.where(100 * F.col("matched") >= PERCENT * F.col("window"))
    return laid.groupBy("doc_id", "item_id").agg(
        F.max("matched").cast("long").alias("matched"), F.max("window").cast("long").alias("window"), F.max("shared").cast("long").alias("shared"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that no benchmark item overlaps, with all their columns."""
    gone = contaminated(docs, benchmark).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["__gone"]), "left_anti")
