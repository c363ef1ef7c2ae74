"""Exact Jaccard self-join of token sets within a type, in a form that stays small.

Rows with equal token sets are one *set* with a representative and copies.  Sets
of equal size that differ in one token meet at a *hub*, the set without that
token: all of a hub's members have the same score with each other, so a hub of m
members takes m rows instead of m * m pairs.  What is left are explicit pairs.
Together the three tables are the whole similarity relation.

Tokens are made again from the texts wherever they are needed, and what is made of
them is moved: a signature, part hashes, short codes.  No text crosses a shuffle but
those of sets that may have a hub.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.functions.text import words
from clauseloom.operators import settiles
from clauseloom.session import stored, swept

FREQUENT_TOKENS = 131072
#: Bits of the map of ids that may have a hub; texts of other ids are passed over.
ID_BITS = 2**20


def token_set(text: Column) -> Column:
    return F.array_distinct(words(F.lower(text)))


def _hashed(rows: DataFrame, *columns: str) -> DataFrame:
    """The columns and ``hashes``, the hash of each token with the type."""
    return rows.select(*columns, F.transform("tokens", lambda t: F.xxhash64("type", t)).alias("hashes"))


@dataclass
class TokenSets:
    """The sets of ``rows`` (id, type, text) without their tokens.

    keys: id, type, sig, size, p0, p1, p2 of every row.  sets: type, rep, size, n_copies, p0, p1, p2.
    """

    rows: DataFrame
    keys: DataFrame
    reps: DataFrame
    sets: DataFrame
    copies: DataFrame

    def tokens(self) -> DataFrame:
        """id, type, tokens of every row, copies too."""
        return self.rows.select("id", "type", token_set(F.col("text")).alias("tokens"))

    def of_reps(self, made: DataFrame, *more: str) -> DataFrame:
        """What was made of every row, id first, for the representatives only, as rep."""
        return made.join(self.reps.select("id", *more), "id").withColumnRenamed("id", "rep")

    @cached_property
    def codes(self) -> DataFrame:
        """type, rep, size, rare, common."""
        hashed = _hashed(self.tokens().withColumn("size", F.size("tokens")), "id", "type", "size")
        return self.of_reps(settiles.encoded(hashed.where("size > 0 AND type IS NOT NULL"), _frequent(hashed)))

    def may_have_hubs(self, threshold: float) -> DataFrame:
        """type, rep, tokens, size, n_copies of the sets that may be one token apart from another."""
        some = stored(_sharing_a_part(self.sets.where(_hub_score() >= threshold)).select(F.col("rep").alias("id"), "n_copies"), "one-apart")
        bit = lambda: F.pmod(F.xxhash64("id"), F.lit(ID_BITS))
        bits = some.select(bit().alias("bit")).distinct()
        texts = self.rows.withColumn("bit", bit()).join(F.broadcast(bits), "bit", "left_semi").drop("bit")
        return stored(texts.join(some.distinct(), "id").withColumn("tokens", token_set(F.col("text"))).select(
            "type", F.col("id").alias("rep"), "tokens", F.size("tokens").alias("size"), "n_copies"), "hub-sets")


def token_sets(rows: DataFrame | TokenSets) -> TokenSets:
    """``rows``: id, type, text.

    Equal sets collapse in a partial aggregate on a SHA-256 of the sorted tokens, however many
    rows share one text.
    """
    if isinstance(rows, TokenSets):
        return rows
    tokens = rows.select("id", "type", token_set(F.col("text")).alias("tokens"))
    sig = F.unhex(F.sha2(F.concat_ws("\n", F.sort_array("tokens")), 256))
    keys = stored(settiles.with_parts(_hashed(tokens.select(
        "id", "type", "tokens", sig.alias("sig"), F.size("tokens").alias("size")), "id", "type", "sig", "size")), "set-keys")
    groups = keys.where("size > 0").groupBy("type", "sig").agg(F.min("id").alias("rep"), F.count("*").alias("n_copies"))
    copies = keys.where("size > 0").join(groups.where("n_copies > 1"), ["type", "sig"]).where("id <> rep").select("type", "id", "rep")
    reps = stored(groups.select(F.col("rep").alias("id"), "n_copies"), "set-reps")
    sets = stored(keys.drop("sig").join(reps, "id").withColumnRenamed("id", "rep"), "sets")
    return TokenSets(rows, keys, reps, sets, copies)


def distinct_sets(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sets, copies) of ``rows``: id, type, text, with all tokens.

    sets: type, rep, tokens, size, n_copies.  copies: type, id, rep - every row
    but the representatives.
    """
    made = token_sets(rows)
    return made.of_reps(made.tokens().withColumn("size", F.size("tokens")), "n_copies").select(
        "type", "rep", "tokens", "size", "n_copies"), made.copies


def _sharing_a_part(sets: DataFrame) -> DataFrame:
    """Of ``sets`` with p0, p1 and p2 those that may differ in one token from another of their size; no such set is left out.

    Tokens fall into three parts by hash. Two sets one token apart differ by a token each,
    so in at most two parts, and the third is equal.
    """
    keys = F.array(*[F.xxhash64("type", "size", F.lit(k), f"p{k}") for k in range(3)])
    parts = sets.select("rep", F.explode(keys).alias("key"))
    common = parts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    return sets.join(parts.join(common, "key", "left_semi").select("rep").distinct(), "rep", "left_semi")


def _maybe_one_apart(sets: DataFrame) -> DataFrame:
    """The same of ``sets`` with tokens."""
    narrow = settiles.with_parts(_hashed(sets, "type", "rep", "size"))
    return sets.join(_sharing_a_part(narrow).select("rep").distinct(), "rep", "left_semi")


def _hub_score() -> Column:
    return (F.col("size") - 1) / (F.col("size") + 1)


def hubs(sets: DataFrame | TokenSets, threshold: float) -> DataFrame:
    """type, hub_rep, hub_token, rep, n_copies, score for sets one token apart.

    The set without a token is known by the xor of two independent 64-bit token
    hashes, so each set that may have a hub gives one short row per token.
    """
    sets = sets.may_have_hubs(threshold) if isinstance(sets, TokenSets) else _maybe_one_apart(sets)

    def fold(seed):
        return F.aggregate("tokens", F.lit(0).cast("bigint"), lambda acc, t: acc.bitwiseXOR(F.xxhash64(F.lit(seed), t)))

    score = _hub_score()
    whole = sets.where(score >= threshold).withColumn("h1", fold("a")).withColumn("h2", fold("b"))
    slots = whole.select("type", "rep", "size", "n_copies", "h1", "h2", F.explode("tokens").alias("token")).select(
        "type", "rep", "size", "n_copies", "token",
        F.col("h1").bitwiseXOR(F.xxhash64(F.lit("a"), "token")).alias("k1"),
        F.col("h2").bitwiseXOR(F.xxhash64(F.lit("b"), "token")).alias("k2"))
    key = ["type", "size", "k1", "k2"]
    shared = slots.groupBy(*key).agg(
        F.count("*").alias("m"), F.min("rep").alias("hub_rep"), F.min_by("token", "rep").alias("hub_token")).where("m > 1")
    return slots.join(shared, key).select("type", "hub_rep", "hub_token", "rep", "n_copies", score.alias("score"))


def _frequent(hashed: DataFrame):
    """The hashes in most rows, ascending, and their ranks by number of rows, carried to every task.

    That list has a fixed length.  Any order of tokens that is the same for all sets gives the same pairs.
    """
    with swept(hashed.sparkSession):
        top = hashed.select(F.explode("hashes").alias("h")).groupBy("h").count().where("count > 1").orderBy(
            F.desc("count"), "h").limit(FREQUENT_TOKENS).toPandas()
    by_hash = np.argsort(top["h"].to_numpy("int64"), kind="stable")
    return hashed.sparkSession.sparkContext.broadcast(
        (top["h"].to_numpy("int64")[by_hash], (len(top) - by_hash).astype("int64")))


def _rarest_first(sets: DataFrame) -> DataFrame:
    """rep, size and ``o``: the token hashes in the order of their codes, those in few sets first."""
    hashed = _hashed(sets, "rep", "size")
    carried = _frequent(hashed)

    @F.pandas_udf("array<bigint>")
    def ordered(hashes: pd.Series) -> pd.Series:
        return hashes.map(lambda h: h[np.argsort(settiles.codes(h, *carried.value))])

    return hashed.select("rep", "size", ordered("hashes").alias("o"))


def explicit_pairs(sets: DataFrame | TokenSets, threshold: float) -> DataFrame:
    """type, rep_a, rep_b, score for similar sets that share no hub.

    Prefix filter: similar sets share a token among their rarest ones.  Sets meet in ranges
    of sizes, as codes (see ``settiles``); tokens are known by their 64-bit hash with the type.
    """
    if isinstance(sets, TokenSets):
        codes, narrow = sets.codes, sets.sets.select("type", "rep", "size").distinct()
    else:
        hashed = _hashed(sets, "rep", "type", "size").where("size > 0 AND type IS NOT NULL")
        codes, narrow = settiles.encoded(hashed, _frequent(hashed)), sets.select("type", "rep", "size").distinct()
    return settiles.similar_pairs(codes, narrow, threshold).select(
        "type", F.least("x", "y").alias("rep_a"), F.greatest("x", "y").alias("rep_b"), "score")


def similarity_relation(rows: DataFrame | TokenSets, threshold: float = 0.7) -> DataFrame:
    """All three parts in one table: kind, type, from_id, to_id, hub_token, score.

    copy: a row and the representative of its token set.  hub: a set and its hub,
    named by the hub's lowest member and the token it lacks.  pair: two sets.
    """
    sets = token_sets(rows)
    none = F.lit(None).cast("string")
    return (
        sets.copies.select(F.lit("copy").alias("kind"), "type", F.col("id").alias("from_id"), F.col("rep").alias("to_id"),
                      none.alias("hub_token"), F.lit(1.0).alias("score"))
        .unionByName(hubs(sets, threshold).select(
            F.lit("hub").alias("kind"), "type", F.col("rep").alias("from_id"), F.col("hub_rep").alias("to_id"),
            "hub_token", "score"))
        .unionByName(explicit_pairs(sets, threshold).select(
            F.lit("pair").alias("kind"), "type", F.col("rep_a").alias("from_id"), F.col("rep_b").alias("to_id"),
            none.alias("hub_token"), "score")))


def pair_counts(rows: DataFrame | TokenSets, threshold: float = 0.7) -> DataFrame:
    """Number of similar row pairs per type, from the compact form."""
    made = token_sets(rows)
    sets, c = made.sets, F.col("n_copies")
    equal = sets.groupBy("type").agg(F.sum(c * (c - 1) / 2).alias("n"))
    hub = hubs(made, threshold).groupBy("type", "hub_rep", "hub_token").agg(
        F.sum("n_copies").alias("s"), F.sum(c * c).alias("ss")).groupBy("type").agg(
        F.sum((F.col("s") * F.col("s") - F.col("ss")) / 2).alias("n"))
    size = sets.select("rep", "n_copies")
    pairs = explicit_pairs(made, threshold).join(
        size.select(F.col("rep").alias("rep_a"), c.alias("ca")), "rep_a").join(
        size.select(F.col("rep").alias("rep_b"), c.alias("cb")), "rep_b").groupBy("type").agg(
        F.sum(F.col("ca") * F.col("cb")).cast("double").alias("n"))
    return equal.unionByName(hub).unionByName(pairs).groupBy("type").agg(F.sum("n").cast("bigint").alias("n_pairs"))


def minhash_pairs(rows: DataFrame | TokenSets, threshold: float = 0.7, bands: int = 24, band_rows: int = 5) -> DataFrame:
    """Approximate option: banded MinHash candidates among distinct sets of one type, exact scores.

    A pair of similarity s becomes a candidate with probability 1 - (1 - s^rows)^bands.
    """
    made = token_sets(rows)

    def smallest(seed: int) -> Column:
        return F.array_min(F.transform("tokens", lambda t: F.xxhash64(F.lit(seed), t)))

    least = [smallest(k) for k in range(bands * band_rows)]
    keys = F.array(*[F.xxhash64(F.lit(b), *least[b * band_rows:(b + 1) * band_rows]) for b in range(bands)])
    banded = stored(made.of_reps(made.tokens().select("id", "type", keys.alias("keys"))), "minhash")
    one = banded.select("type", "rep", F.explode("keys").alias("key"))
    pairs = one.alias("a").join(one.alias("b"), ["type", "key"]).where("a.rep < b.rep").select(
        F.col("a.rep").alias("x"), F.col("b.rep").alias("y")).distinct()
    scored = settiles.scored_pairs(made.codes, made.sets.select("type", "rep", "size").distinct(), stored(pairs, "minhash-pairs"), threshold)
    return scored.join(made.sets.select(F.col("rep").alias("y")), "y").select(
        "type", F.col("x").alias("rep_a"), F.col("y").alias("rep_b"), F.col("n").cast("int").alias("size_a"), F.col("m").cast("int").alias("size_b"), "score")
