"""Near-duplicate documents by SetSketch registers, banding, joint likelihood and an exact check.

A document is the set of its distinct word shingles. Its sketch has ``REGISTERS`` values:
each shingle draws one exponential value for every register, the values spaced so that
the first falls in the lowest of REGISTERS slices of the exponential distribution, the
next in the second, and so on (truncated draws), dealt to the registers in an order of
its own; a register keeps the smallest draw on a logarithmic scale. Slices are drawn
until no register can get smaller, so long texts need few draws per shingle. Sketches of
parts merge by the larger register.

Registers of two sets agree with a probability close to their Jaccard similarity, so
bands of ``BAND_ROWS`` equal registers propose pairs: at 0.8 a pair is missed with
probability (1 - 0.8^5)^51, about 2e-9. For proposed pairs the counts of larger, equal
and smaller registers and the known set sizes give the maximum-likelihood similarity;
pairs more than ``MARGIN`` (six standard deviations) under the threshold go. The rest
is checked on full shingle sets.

Documents with equal sets are one node from the start, by an aggregate that combines
before its shuffle. In a bucket of a band, members meet the bucket's smallest member, its
pivot, first. Only members that did not end up in their pivot's component then meet the
others around that pivot, blocks of full sets against blocks, in numpy inside tasks, and
only links come out. So a large group of near copies costs a few rows per member, and no
link between different sets is skipped: two members that never met are in one component.

Defined cases: a text without words (null, empty, white space) has an empty set, is
linked with nothing and is its own component; a text with fewer words than a shingle has
one shingle, its whole sequence; rows with one id and several texts are one document, so
that their sets are in one component; rows without an id get the component of their set if
any row with an id has the same set, else null, and are kept if it is null; repeated rows
get the same component; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .components import components, merged
from .textarrays import Piece, mixed, ngrams, pieces

REGISTERS = 256
BASE = 1.001
RATE = 20.0
BAND_ROWS = 5
BANDS = REGISTERS // BAND_ROWS
MARGIN = 0.15
SHINGLE = 5
PERCENT = 80
#: Ids that are sent to all executors at most, eight bytes each.
BROADCAST_IDS = 1_000_000
#: Sets and shingles of a block at most (a single larger set is a block), and columns multiplied at once.
BLOCK_SETS, BLOCK_SHINGLES, MATRIX_COLUMNS = 1000, 500_000, 2048
_U = np.uint64


def shingle_sets(piece: Piece, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    starts, ends = piece.words()
    texts = piece.texts_of(starts)
    words = piece.hashes(starts, ends, lower=True)
    grams, at = ngrams(words, texts, n)
    of = texts[at]
    cut = np.searchsorted(of, np.arange(piece.n + 1))
    first = np.searchsorted(texts, np.arange(piece.n + 1))
    out = []
    for k in range(piece.n):
        few = first[k + 1] - first[k]
        if 0 < few < n:
            whole = np.full(1, few, _U)
            for w in words[first[k]:first[k + 1]]:
                whole = mixed(whole * _U(3) + w)
            out.append(whole)
        else:
            out.append(np.unique(grams[cut[k]:cut[k + 1]]))
    return out


def registers(shingles: np.ndarray) -> np.ndarray:
    """The sketch of a non-empty set; larger values stand for smaller draws."""
    best = np.full(REGISTERS, np.inf)
    start, step = mixed(shingles ^ _U(0xA5A5A5A5)), mixed(shingles ^ _U(0x5A5A5A5A00)) | _U(1)
    slices = max(1, min(REGISTERS, 2048 // len(shingles)))
    level = 0
    while level < REGISTERS and best.max() >= level:
        js = np.arange(level, min(REGISTERS, level + slices), dtype=_U)
        register = (start[:, None] + step[:, None] * js) & _U(REGISTERS - 1)
        draw = js + (mixed(shingles[:, None] + js * _U(0xD1342543DE82EF95)) >> _U(11)) * 2.0**-53
        np.minimum.at(best, register.ravel().astype(np.int64), draw.ravel())
        level += slices
    x = -np.log1p(-best / REGISTERS) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, 65535).astype(np.uint16)


def sketches(text: Column, shingle: int) -> Column:
    """struct<n, key, sketch>: set size, 128 bits that name the set, and its registers (null for the empty set)."""

    @F.arrow_udf("n long, key binary, sketch binary")
    def sketch(column: pa.Array) -> pa.Array:
        sizes, keys, out = [], [], []
        for piece in pieces(column):
            for s in shingle_sets(piece, shingle):
                sizes.append(len(s))
                if len(s):
                    keys.append(np.array([len(s) + mixed(s).sum(), (mixed(s ^ _U(0x77)) * _U(7)).sum()], _U).tobytes())
                    out.append(registers(s).tobytes())
                else:
                    keys.append(None)
                    out.append(None)
        return pa.StructArray.from_arrays(
            [pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(out, pa.binary())], ["n", "key", "sketch"])

    return sketch(text)


def rows_of(column: pa.Array) -> np.ndarray:
    """Sketches as a matrix."""
    if not len(column):
        return np.zeros((0, REGISTERS), np.uint16)
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def band_keys(sketch: Column) -> Column:
    """array<long>: one key per band; equal keys mean equal registers in the same band."""

    @F.arrow_udf("array<long>")
    def bands(column: pa.Array) -> pa.Array:
        rows = rows_of(column)[:, :BANDS * BAND_ROWS].astype(_U).reshape(-1, BANDS, BAND_ROWS)
        key = np.broadcast_to(np.arange(BANDS, dtype=_U), rows.shape[:2])
        for k in range(BAND_ROWS):
            key = mixed(key * _U(3) + rows[:, :, k])
        flat = pa.array(key.astype(np.int64).ravel())
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32)), flat)

    return bands(sketch)


def likely_similarity(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity from two sketches and the set sizes, per row."""
    above, below = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = REGISTERS - above - below
    u = size_a / (size_a + size_b)
    v = 1 - u
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def loss(j: np.ndarray) -> np.ndarray:
        more, less = p(u - v * j), p(v - u * j)
        tiny = 1e-12
        return -(above * np.log(np.maximum(more, tiny)) + below * np.log(np.maximum(less, tiny))
                 + equal * np.log(np.maximum(1 - more - less, tiny)))

    for _ in range(40):  # the likelihood is concave in j
        one, two = low + (high - low) * 0.382, low + (high - low) * 0.618
        left = loss(one) < loss(two)
        low, high = np.where(left, low, one), np.where(left, two, high)
    return (low + high) / 2


def estimated(a: Column, b: Column, size_a: Column, size_b: Column) -> Column:
    @F.arrow_udf("double")
    def estimate(a: pa.Array, b: pa.Array, size_a: pa.Array, size_b: pa.Array) -> pa.Array:
        return pa.array(likely_similarity(rows_of(a), rows_of(b), size_a.to_numpy(zero_copy_only=False).astype(float),
                                          size_b.to_numpy(zero_copy_only=False).astype(float)))

    return estimate(a, b, size_a, size_b)


def similar(a: Column, b: Column, shingle: int, percent: int) -> Column:
    """Whether two texts' full sets reach the similarity."""

    @F.arrow_udf("boolean")
    def check(left: pa.Array, right: pa.Array) -> pa.Array:
        out, last, last_set = [], None, None
        for x, y in zip(left.to_pylist(), right.to_pylist()):
            if x != last:
                last, last_set = x, shingle_sets(next(pieces(pa.array([x]))), shingle)[0]
            other = shingle_sets(next(pieces(pa.array([y]))), shingle)[0]
            common = len(np.intersect1d(last_set, other, assume_unique=True))
            out.append(100 * common >= percent * (len(last_set) + len(other) - common))
        return pa.array(out, pa.bool_())

    return check(a, b)


def confirmed(pairs: DataFrame, reps: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) of set representatives whose sets reach the similarity."""
    left = reps.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a"))
    right = reps.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("sketch_b"))
    near = pairs.join(right, "b").join(left, "a").where(
        (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))).select(
        "a", "b", estimated(F.col("sketch_a"), F.col("sketch_b"), F.col("n_a"), F.col("n_b")).alias("j"))
    near = stored(near.where(F.col("j") >= percent / 100 - MARGIN).select("a", "b"), "near-likely")
    texts = stored(texts_of(docs, reps, near.select(F.col("a").alias("rep")).union(near.select("b"))), "near-texts")
    joined = near.join(texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b").join(
        texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a")
    return stored(joined.where(similar(F.col("text_a"), F.col("text_b"), shingle, percent)).select("a", "b"), "near-links")


def texts_of(docs: DataFrame, reps: DataFrame, nodes: DataFrame) -> DataFrame:
    """(rep, text) of some representatives, found by id and hash of the text; texts are shuffled only if there are more than ``BROADCAST_IDS``."""
    ids = stored(reps.join(nodes, "rep", "left_semi").select("rep", F.col("least").alias("of_id"), "text_key"), "near-ids")
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.where("text IS NOT NULL").join(
        F.broadcast(ids) if few else ids, (F.col("doc_id") == F.col("of_id")) & (F.xxhash64("text") == F.col("text_key"))).select("rep", "text")


def full_sets(text: Column, shingle: int) -> Column:
    """binary: the sorted shingle hashes, eight bytes each."""

    @F.arrow_udf("binary")
    def sets(column: pa.Array) -> pa.Array:
        return pa.array([s.tobytes() for piece in pieces(column) for s in shingle_sets(piece, shingle)], pa.binary())

    return sets(text)


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all left with all right sets, by products of presence matrices."""
    out = np.zeros((len(left), len(right)), np.float32)
    codes, code = np.unique(np.concatenate(left + right), return_inverse=True)
    cut = sum(map(len, left))
    in_both = np.zeros(len(codes), np.int8)
    in_both[code[:cut]] |= 1
    in_both[code[cut:]] |= 2
    column = np.cumsum(in_both == 3) - 1  # shingles of one side only share nothing
    shared = in_both[code] == 3
    row_left, row_right = np.repeat(np.arange(len(left)), [len(x) for x in left]), np.repeat(np.arange(len(right)), [len(x) for x in right])
    col_left, row_left = column[code[:cut]][shared[:cut]], row_left[shared[:cut]]
    col_right, row_right = column[code[cut:]][shared[cut:]], row_right[shared[cut:]]
    for first in range(0, int((in_both == 3).sum()), MATRIX_COLUMNS):
        a, b = np.zeros((len(left), MATRIX_COLUMNS), np.float32), np.zeros((len(right), MATRIX_COLUMNS), np.float32)
        here = (col_left >= first) & (col_left < first + MATRIX_COLUMNS)
        a[row_left[here], col_left[here] - first] = 1
        here = (col_right >= first) & (col_right < first + MATRIX_COLUMNS)
        b[row_right[here], col_right[here] - first] = 1
        out += a @ b.T
    return out


def block_links(percent: int):
    """For the rows of one pair of blocks, the links from outsiders to sets of other components."""

    def links(batch: pa.Table) -> pa.Table:
        role = batch.column("role").to_numpy()
        rep, c = batch.column("rep").to_numpy(), batch.column("c").to_numpy()
        sets = [np.frombuffer(x, _U) for x in batch.column("set").to_pylist()]
        o, m = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        found_a, found_b = [], []
        if len(o) and len(m):
            size = np.array([len(x) for x in sets])
            common = common_counts([sets[i] for i in o], [sets[i] for i in m])
            linked = (100 * common >= percent * (size[o][:, None] + size[m] - common)) & (c[o][:, None] != c[m])
            x, y = np.nonzero(linked)
            found_a, found_b = rep[o[x]], rep[m[y]]
        return pa.table({"a": pa.array(found_a, pa.int64()), "b": pa.array(found_b, pa.int64())})

    return links


def rest_of(stars: DataFrame, found: DataFrame, reps: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links of members outside their pivot's component with the others around the pivot."""
    own = found.select(F.col("node").alias("b"), F.col("component").alias("c"))
    of_pivot = found.select(F.col("node").alias("a"), F.col("component").alias("pc"))
    placed = stars.join(own, "b", "left").join(of_pivot, "a", "left").select(
        F.col("a").alias("pivot"), F.col("b").alias("rep"), F.coalesce("c", "b").alias("c"), F.coalesce("pc", "a").alias("pc"))
    placed = stored(placed.join(reps.select("rep", "n"), "rep"), "near-placed")
    around = placed.groupBy("pivot").agg(
        F.count("*").alias("rows"), F.sum("n").alias("shingles"), F.max((F.col("c") != F.col("pc")).cast("int")).alias("open")).where(
        "open = 1 AND rows > 1")
    blocks = F.greatest(F.ceil(F.col("rows") / BLOCK_SETS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    rows = placed.join(around.select("pivot", blocks.alias("blocks")), "pivot").withColumn("own", F.pmod(F.hash("rep"), "blocks"))
    sets = texts_of(docs, reps, rows.select("rep")).select("rep", full_sets(F.col("text"), shingle).alias("set"))
    rows = rows.join(sets, "rep")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    members = rows.select("pivot", every.alias("i"), F.col("own").alias("j"), F.lit(1).alias("role"), "rep", "c", "set")
    outsiders = rows.where("c <> pc").select("pivot", F.col("own").alias("i"), every.alias("j"), F.lit(0).alias("role"), "rep", "c", "set")
    return members.union(outsiders).groupBy("pivot", "i", "j").applyInArrow(block_links(percent), "a long, b long")


def sets_of_one_id(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges (a, b) between the representatives of the sets that stand under one id."""
    under = rows.where("doc_id IS NOT NULL AND key IS NOT NULL").select("doc_id", "key")
    several = under.groupBy("doc_id").agg(F.min("key").alias("one"), F.max("key").alias("other")).where("one <> other")
    keys = under.join(several, "doc_id").where("key <> one").select("one", "key").distinct()
    return keys.join(sets.select(F.col("key").alias("one"), F.col("rep").alias("a")), "one").join(
        sets.select("key", F.col("rep").alias("b")), "key").select("a", "b")


def grouped(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    rows = stored(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("text_key"),
                              sketches(F.col("text"), shingle).alias("s")).select("row", "doc_id", "text_key", "s.*"), "near-sketches")
    own = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "row", "text_key")))
    sets = rows.where("key IS NOT NULL").groupBy("key").agg(own.alias("first")).where("first IS NOT NULL")
    sets = stored(sets.select("key", F.col("first.row").alias("rep"), F.col("first.doc_id").alias("least"), F.col("first.text_key").alias("text_key")), "near-sets")
    reps = stored(rows.select("row", "n", "sketch").join(sets.drop("key"), F.col("row") == F.col("rep")).drop("row"), "near-reps")

    bands = reps.select("rep", F.explode(band_keys(F.col("sketch"))).alias("band"))
    shared = bands.groupBy("band").agg(F.min("rep").alias("pivot"), F.count("*").alias("members")).where("members > 1").select("band", "pivot")
    stars = bands.join(shared, "band").where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    stars = stored(stars, "near-stars")
    links = confirmed(stars, reps, docs, shingle, percent)
    found = stored(components(links), "near-found")
    found = merged(found, stored(rest_of(stars, found, reps, docs, shingle, percent), "near-rest"))
    found = stored(merged(found, stored(sets_of_one_id(rows, sets), "near-one-id")), "near-components")

    placed = sets.join(found, sets["rep"] == found["node"], "left").select(
        F.col("key").alias("set_key"), "least", F.coalesce("component", "rep").alias("component"))
    names = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    of_set = placed.join(names, "component").select("set_key", "component_id")
    full = rows.where("key IS NOT NULL").select("doc_id", "n", "key").join(of_set, F.col("key") == F.col("set_key"), "left").select("doc_id", "n", "component_id")
    empty = rows.where("key IS NULL").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return full.union(empty).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents, one of each group: those that ``grouped`` keeps, with all their columns."""
    verdict = grouped(docs, shingle, percent).where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(verdict, docs["doc_id"] == verdict["__gone"], "left_anti")
