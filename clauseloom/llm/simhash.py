"""Near-duplicate documents by SimHash fingerprints, joined on Golay codeword indices of their segments.

A fingerprint has 64 bits: bit k is 1 if over half of the XXH64 hashes of the text's word
shingles, repeats included, have it set. Two fingerprints are linked if they differ in at
most ``DISTANCE`` bits.

The binary Golay code [23, 12, 7] is perfect: every 23-bit word is within three bits of
exactly one codeword. A fingerprint is cut into segments of 22, 21 and 21 bits, each padded
to 23. A segment is decoded to the indices of all codewords within four bits of it, which
are one or six, so two segments that differ in at most two bits always share an index (that
of the word between them). Pigeonhole over the segments then gives seven kinds of keys, each
an index and about 21 exact bits: a whole segment and an index of the next segment round the
circle, or an index of the first segment and a half each of the other two. Three differing
bits leave at least one kind whole: if the first segment has at most two of them and each
other segment a clean half, the latter kinds; else two segments have one at most between
them, and one of the former does. A fingerprint has 7 to 42 keys; by chance two share one
with a probability of about 1.6e-8.

Equal fingerprints are one node from the start. In a bucket of equal keys the members meet
the smallest one, its pivot; only members that are not in their pivot's component then meet
the others of the bucket, in a join that verifies the distance as it goes and yields pairs
of components. So a large group of near copies costs a few rows per member, and no link
between components is lost.

Defined cases: a text without words (null, empty, white space) has fingerprint zero and is
linked like any other; fewer words than a shingle are one shingle, the whole sequence; rows
of one id are one document, so that their fingerprints are in one component; a component is
named by its smallest id, null only if no row of it has one; repeated rows give repeated
results, an empty table an empty one; other columns are not looked at.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .components import components, merged

SHINGLE = 3
SEED = 42
DISTANCE = 3
#: First bit and width of each segment; halves of the last two are cut after 11 bits.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
HALF = 11
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 generates the code.
GENERATOR, CODE_BITS, CHECK_BITS = 0b110001110101, 23, 11
#: Hashes whose bits are counted at once.
COUNTED = 65_536
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def bit_majority(hashes: list[int]) -> int:
    """The number whose bits are 1 where over half of the 64-bit numbers have a 1."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), COUNTED):
        some = np.array(hashes[k:k + COUNTED], np.dtype("<u8"))
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_of(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of a UTF-8 text."""
    words = text.translate(LOWER).split()  # at exactly space, \t, \n, \v, \f, \r
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED) if words else 0
    ends = list(accumulate(map(len, words), lambda end, n: end + 1 + n))
    starts = [0] + [end + 1 for end in ends]
    digest = xxhash.xxh64_intdigest
    return bit_majority([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1:])])


def fingerprints(text: Column, shingle: int = SHINGLE) -> Column:
    """long: the 64 bits of the fingerprint (null counts as the empty text)."""

    @F.arrow_udf("long")
    def prints(column: pa.Array) -> pa.Array:
        texts = column.cast(pa.large_binary()).to_pylist()
        return pa.array(np.array([fingerprint_of(x or b"", shingle) for x in texts], np.uint64).view(np.int64))

    return prints(text)


@lru_cache(maxsize=1)
def decoding() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of single bits; per remainder the error patterns of up to four bits to the codewords near by, and their number."""
    remainders = [1]
    while len(remainders) < CODE_BITS:
        up = remainders[-1] << 1
        remainders.append(up ^ GENERATOR if up >> CHECK_BITS else up)
    found: dict[int, list[int]] = {}
    for weight in range(5):
        for bits in combinations(range(CODE_BITS), weight):
            r = 0
            for b in bits:
                r ^= remainders[b]
            found.setdefault(r, []).append(sum(1 << b for b in bits))
    errors = np.zeros((1 << CHECK_BITS, 6), np.int64)
    count = np.zeros(1 << CHECK_BITS, np.int64)
    for r, patterns in found.items():
        errors[r, :len(patterns)], count[r] = patterns, len(patterns)
    return np.array(remainders), errors, count


def codeword_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per 23-bit word, the indices (upper 12 bits) of the codewords within four bits, six columns, and how many count."""
    remainders, errors, count = decoding()
    r = np.zeros(len(words), np.int64)
    for b in range(CODE_BITS):
        r ^= np.where(words >> b & 1, remainders[b], 0)
    return (words[:, None] ^ errors[r]) >> CHECK_BITS, count[r]


def key_matrix(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each fingerprint, 42 columns, and which of them count."""
    u = prints.view(np.uint64)
    segment = [(u >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    near = [codeword_indices(s) for s in segment]
    exact = [(segment[i], (i + 1) % 3) for i in range(3)]
    halves = [(s & ((1 << HALF) - 1), s >> HALF) for s in segment[1:]]
    exact += [(a << HALF | b, 0) for a in halves[0] for b in halves[1]]
    keys, valid = [], []
    for kind, (bits, at) in enumerate(exact):
        index, count = near[at]
        keys.append((bits[:, None] << 12 | index) << 3 | kind)
        valid.append(np.arange(6) < count[:, None])
    return np.concatenate(keys, axis=1), np.concatenate(valid, axis=1)


def golay_keys(fingerprint: Column) -> Column:
    """array<long>: the keys of a fingerprint; fingerprints of at most three differing bits share one."""

    @F.arrow_udf("array<long>")
    def keys(column: pa.Array) -> pa.Array:
        matrix, valid = key_matrix(column.to_numpy(zero_copy_only=False).astype(np.int64))
        offsets = np.concatenate([[0], np.cumsum(valid.sum(axis=1))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix[valid]))

    return keys(fingerprint)


def distance(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.bit_count(a.bitwiseXOR(b))


def linked_components(prints: DataFrame) -> DataFrame:
    """(node, component) for the distinct fingerprints (print) that are linked with another one."""
    keys = stored(prints.select("print", F.explode(golay_keys(F.col("print"))).alias("key")), "simhash-keys")
    shared = keys.groupBy("key").agg(F.min("print").alias("pivot"), F.count("*").alias("members")).where("members > 1")
    buckets = stored(keys.join(shared, "key"), "simhash-buckets")
    stars = buckets.where(F.col("print") != F.col("pivot")).where(distance("print", "pivot") <= DISTANCE)
    found = stored(components(stars.select(F.col("pivot").alias("a"), F.col("print").alias("b"))), "simhash-found")

    of = found.select(F.col("node").alias("print"), F.col("component").alias("c"))
    of_pivot = found.select(F.col("node").alias("pivot"), F.col("component").alias("pc"))
    placed = buckets.where("members > 2").join(of, "print", "left").join(of_pivot, "pivot", "left").select(
        "key", "print", F.coalesce("c", "print").alias("c"), (F.coalesce("c", "print") != F.coalesce("pc", "pivot")).alias("outside"))
    placed = stored(placed, "simhash-placed")
    outside = placed.where("outside").select("key", F.col("print").alias("other"), F.col("c").alias("other_c"))
    more = outside.join(placed, "key").where((F.col("c") != F.col("other_c")) & (distance("print", "other") <= DISTANCE)).select(
        F.least("c", "other_c").alias("a"), F.greatest("c", "other_c").alias("b")).distinct()
    return merged(found, stored(more, "simhash-more"))


def grouped(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs (doc_id, text)."""
    rows = stored(docs.select("doc_id", fingerprints(F.col("text"), shingle).alias("print")), "simhash-rows")
    prints = stored(rows.groupBy("print").agg(F.min("doc_id").alias("least")), "simhash-prints")
    found = linked_components(prints.select("print"))
    several = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("print").alias("a"), F.max("print").alias("z")).where("a <> z")
    of_one_id = rows.join(several, "doc_id").select("a", F.col("print").alias("b")).where("a <> b").distinct()
    found = stored(merged(found, stored(of_one_id, "simhash-ids")), "simhash-components")

    placed = prints.join(found, prints["print"] == found["node"], "left").select(
        F.col("print").alias("of_print"), "least", F.coalesce("component", "print").alias("component"))
    named = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    placed = placed.join(named, "component").select("of_print", "component_id")
    return rows.join(placed, rows["print"] == placed["of_print"]).select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The documents, one of each component: rows whose id is the smallest of it, with all their columns."""
    gone = grouped(docs, shingle).where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
