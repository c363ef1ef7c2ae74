"""Passages that repeat across documents, by sliding spans of sentences and of words.

A text is cut into sentences, at sentence and clause marks before white space and at line
ends. From every sentence on, the shortest run of at least ``SENTENCES`` sentences and
``MIN_WORDS`` words is hashed on its words, so white space does not matter. All runs of all
documents meet by hash; of equal runs the first, by document id, then text, then place,
stays, and the sentences of every other are covered. What is covered is cut out.

Wherever they start and end, all windows of ``PASSAGE`` words that stand somewhere before
are covered too. A window's anchor is the smallest hash of ``GRAM`` words in it, so equal
windows have equal anchors. Neighbouring windows with one anchor form a block, and blocks
meet by hash like runs. Only where an anchor stands in different blocks, the first of each
kind is taken apart into its windows, and these meet by hash; later blocks of a kind are
covered as a whole. So the result is that of comparing all windows, but rows grow with the
anchors and the edges of passages. A window that overlaps its own first copy covers only
what comes after that.

The number of runs is at most that of the sentences, that of blocks about one in 18 words.
Both are counted by an aggregate that combines before its shuffle, and only those seen twice
or more go on. What equal runs have in common is stored and met again by equi-joins, whose
large groups the engine can split; only the runs of one document come together in one place.

Defined cases: null and empty texts and texts with fewer sentences or words have no runs
and stay as they are; rows equal in id and text are one document, so copies of a row do
not remove each other's text; other repeats within a document count; rows without an
id come last; an empty table gives an empty result; other columns go along.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .textarrays import Piece, mixed, pieces

SENTENCES = 2
MIN_WORDS = 20
PASSAGE = 50
GRAM = 16
_U = np.uint64
_MULTIPLIER = 0x9DDFEA08EB382D69
_INVERSE = _U(pow(_MULTIPLIER, -1, 1 << 64))
MARKS, PUNCTUATION = np.zeros(256, bool), np.zeros(256, bool)
MARKS[list(b".!?,;:|")] = True
PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def powers(base: np.uint64, n: int) -> np.ndarray:
    values = np.full(n, base, _U)
    values[:1] = 1
    return np.multiply.accumulate(values)


def span_hashes(one: np.ndarray, first: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Two hashes of every span of words; ``one`` has a hash per word."""
    up, down = powers(_U(_MULTIPLIER), len(one)), powers(_INVERSE, len(one))
    out = []
    for words in (one, mixed(one ^ _U(0x1234567))):
        total = np.concatenate([np.zeros(1, _U), np.cumsum(words * up)])
        out.append(mixed((total[end] - total[first]) * down[first] + (end - first).astype(_U)).astype(np.int64))
    return out


def runs_of(piece: Piece, sentences: int, min_words: int) -> tuple[np.ndarray, ...]:
    """Text, two hashes, first and last byte (exclusive) of every run, in order."""
    starts, ends = piece.words()
    if not len(starts):
        return (np.zeros(0, np.int64),) * 5
    data, texts = piece.data, piece.texts_of(starts)
    closes, trailing = np.zeros(len(ends), bool), np.ones(len(ends), bool)
    for back in range(1, 9):  # a mark counts if only punctuation follows it in the word
        at = ends - back
        trailing &= at >= starts
        byte = data[np.maximum(at, 0)]
        trailing &= PUNCTUATION[byte]
        closes |= trailing & MARKS[byte]
    lines = np.cumsum(data == 10)
    last = np.ones(len(starts), bool)
    last[:-1] = closes[:-1] | (texts[1:] != texts[:-1]) | (lines[starts[1:]] != lines[ends[:-1] - 1])
    stop = np.flatnonzero(last) + 1  # sentences as ranges of words
    start = np.concatenate([[0], stop[:-1]])
    of = texts[start]
    to = np.maximum(np.searchsorted(stop, start + min_words), np.arange(len(start)) + sentences - 1)
    whole = to < len(stop)
    whole[whole] = of[to[whole]] == of[whole]
    first, end = start[whole], stop[to[whole]]
    h1, h2 = span_hashes(piece.hashes(starts, ends), first, end)
    return of[whole], h1, h2, starts[first], ends[end - 1]


def anchors(one: np.ndarray, texts: np.ndarray, passage: int) -> tuple[np.ndarray, ...]:
    """First word and anchor (its place and hash) of every window of ``passage`` words within one text."""
    n, gram = len(one) - passage + 1, min(GRAM, passage)
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    best = np.arange(len(one) - gram + 1)
    value = span_hashes(one, best, best + gram)[0]
    reach, wide = 1, passage - gram + 1
    while reach < wide:  # the leftmost smallest of ``reach`` places, and of ``step`` more
        step = min(reach, wide - reach)
        left, right = best[:-step], best[step:]
        best = np.where(value[right] < value[left], right, left)
        reach += step
    first = np.flatnonzero(texts[:n] == texts[passage - 1:])
    return first, best[first], value[best[first]]


def blocks_of(piece: Piece, passage: int) -> tuple[np.ndarray, ...]:
    """Text, two hashes, first and last byte (exclusive), anchor hash, first word in the text and windows of every block."""
    starts, ends = piece.words()
    texts, one = piece.texts_of(starts), piece.hashes(starts, ends)
    first, at, value = anchors(one, texts, passage)
    if not len(first):
        return (np.zeros(0, np.int64),) * 8
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    count = np.diff(np.append(new, len(first)))
    low = first[new]
    end = low + count - 1 + passage
    h1, h2 = span_hashes(one, low, end)
    return texts[low], h1, h2, starts[low], ends[end - 1], value[new], low - np.searchsorted(texts, texts[low]), count


def windows_of(piece: Piece, passage: int, blocks: list[list[dict]]) -> tuple[np.ndarray, ...]:
    """As ``runs_of``, the windows of the blocks named by first word and number of windows, per text."""
    starts, ends = piece.words()
    begin = np.searchsorted(piece.texts_of(starts), np.arange(piece.n))
    of = np.repeat(np.arange(piece.n), [len(x) for x in blocks])
    if not len(of):
        return (np.zeros(0, np.int64),) * 5
    low = begin[of] + np.array([b["word"] for x in blocks for b in x], np.int64)
    count = np.array([b["windows"] for x in blocks for b in x], np.int64)
    first = np.repeat(low - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
    h1, h2 = span_hashes(piece.hashes(starts, ends), first, first + passage)
    return np.repeat(of, count), h1, h2, starts[first], ends[first + passage - 1]


def listed(column: pa.Array, spans, names: tuple[str, ...] = ()) -> pa.Array:
    """Per text the spans that ``spans`` finds in each piece, with places in code points; further values are named."""
    counts, parts = [], []
    for piece in pieces(column):
        of, h1, h2, a, b, *more = spans(piece)
        points = np.concatenate([[0], np.cumsum((piece.data & 0xC0) != 0x80)])
        base = points[piece.at[:-1]][of]
        parts.append((h1, h2, (points[a] - base).astype(np.int32), (points[b] - base).astype(np.int32), *more))
        counts.append(np.bincount(of, minlength=piece.n))
    names = ("h1", "h2", "start", "end", *names)
    values = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int64)] * len(names)
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1)
    types = [pa.int64() if name in ("h1", "h2", "anchor") else pa.int32() for name in names]
    flat = pa.StructArray.from_arrays([pa.array(x.astype(t.to_pandas_dtype()), t) for x, t in zip(values, types)], list(names))
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), flat)


def runs(text: Column, sentences: int, min_words: int) -> Column:
    """array<struct<h1, h2, start, end>>: hashes and place (code points, end exclusive) of every run."""

    @F.arrow_udf("array<struct<h1: long, h2: long, start: int, end: int>>")
    def find(column: pa.Array) -> pa.Array:
        return listed(column, lambda piece: runs_of(piece, sentences, min_words))

    return find(text)


def blocks(text: Column, passage: int) -> Column:
    """array<struct<h1, h2, start, end, anchor, word, windows>>: the blocks of every text."""

    @F.arrow_udf("array<struct<h1: long, h2: long, start: int, end: int, anchor: long, word: int, windows: int>>")
    def find(column: pa.Array) -> pa.Array:
        return listed(column, lambda piece: blocks_of(piece, passage), ("anchor", "word", "windows"))

    return find(text)


def windows(text: Column, within: Column, passage: int) -> Column:
    """array<struct<h1, h2, start, end>>: the windows of some blocks (array<struct<word, windows>>) of every text."""

    @F.arrow_udf("array<struct<h1: long, h2: long, start: int, end: int>>")
    def find(column: pa.Array, within: pa.Array) -> pa.Array:
        wanted = within.to_pylist()
        return listed(column, lambda piece: windows_of(piece, passage, wanted[piece.first:piece.first + piece.n]))

    return find(text, within)


def repeated_passages(docs: DataFrame, place: Column, passage: int) -> DataFrame:
    """(doc_id, text_key, h1, h2, start, end): blocks, and windows of blocks whose anchor stands in other blocks too."""
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    every = docs.select("doc_id", "text_key", F.inline(blocks(F.col("text"), passage)))  # read twice rather than stored
    several = (F.min("h1") < F.max("h1")) | (F.min("h2") < F.max("h2"))
    shared = stored(every.groupBy("anchor").agg(F.count("*").alias("n"), several.alias("several")).where("n > 1").drop("n"), "substring-anchors")
    met = stored(every.join(shared, "anchor"), "substring-met")
    one = met.where("several").groupBy("h1", "h2").agg(F.min(F.struct(place.alias("place"), "word", "windows")).alias("b"))
    within = one.groupBy(F.col("b.place.doc_id").alias("in_id"), F.col("b.place.text_key").alias("in_key")).agg(
        F.collect_list(F.struct("b.word", "b.windows")).alias("within"))
    apart = docs.join(within, F.col("doc_id").eqNullSafe(F.col("in_id")) & (F.col("text_key") == F.col("in_key"))).select(
        "doc_id", "text_key", F.inline(windows(F.col("text"), F.col("within"), passage)))
    columns = ["doc_id", "text_key", "h1", "h2", "start", "end"]
    return met.select(columns).union(stored(apart, "substring-windows").select(columns))


def repeated_regions(docs: DataFrame, sentences: int = SENTENCES, min_words: int = MIN_WORDS, passage: int = PASSAGE) -> DataFrame:
    """(doc_id, text_key, start, end, first_doc_id, n_runs): regions covered by runs and passages that are not the first of their kind.

    ``first_doc_id`` is the smallest document that holds a first one; start and end are
    code points, end exclusive.
    """
    found = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.inline(runs(F.col("text"), sentences, min_words)))
    keys = stored(found.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2"), "substring-keys")
    repeated = stored(found.join(keys, ["h1", "h2"], "left_semi"), "substring-repeated")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "start", "end")
    repeated = repeated.withColumn("passage", F.lit(False)).unionByName(repeated_passages(docs, place, passage).withColumn("passage", F.lit(True)))
    first = stored(repeated.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "substring-first")
    own = F.col("passage") & F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    later = repeated.join(first, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first"))).select(
        "doc_id", "text_key", F.when(own, F.greatest("start", "first.end")).otherwise(F.col("start")).alias("start"), "end",
        F.col("first.doc_id").alias("first_doc_id")).where("start < end")
    # runs of a document that touch are one region; equal rows of a document are one
    inside = Window.partitionBy("doc_id", "text_key").orderBy("start", "end")
    reach = F.max("end").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    later = later.groupBy("doc_id", "text_key", "start", "end").agg(F.min("first_doc_id").alias("first_doc_id"))
    later = later.withColumn("new", F.when(F.col("start") < reach, 0).otherwise(1))
    later = later.withColumn("region", F.sum("new").over(inside))
    return later.groupBy("doc_id", "text_key", "region").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min("first_doc_id").alias("first_doc_id"), F.count("*").alias("n_runs")).drop("region")


def without_repeats(docs: DataFrame, sentences: int = SENTENCES, min_words: int = MIN_WORDS, text: str = "text",
                    passage: int = PASSAGE) -> DataFrame:
    """The documents with the covered sentences and passages cut out of their text; all rows and columns stay."""
    cuts = repeated_regions(docs.select("doc_id", F.col(text).alias("text")), sentences, min_words, passage).groupBy("doc_id", "text_key").agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__cuts")).select(
        F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "__cuts")
    joined = docs.join(cuts, docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs[text]) == F.col("__key")), "left")
    ends = F.concat(F.array(F.lit(0)), F.transform("__cuts", lambda c: c["end"]))
    starts = F.concat(F.transform("__cuts", lambda c: c["start"]), F.array(F.length(F.col(text))))
    rest = F.array_join(F.zip_with(ends, starts, lambda a, b: F.substring(F.col(text), a + 1, b - a)), "")
    return joined.withColumn(text, F.when(F.col("__cuts").isNull(), F.col(text)).otherwise(rest)).drop("__id", "__key", "__cuts")
