"""Spelling variants: frequent words and the rare ones that differ from them by one letter.

Two words are near if one inserted, deleted or replaced code point turns one into the other.
The index of a block of words is a table of bitsets: for each position and letter, which
words have that letter there. A query is walked once through its letters with four sets of
words: those that agree so far (no error), and those that agree but for one replaced letter,
one more letter in the word (read one position further on) or one less (one position back).
Each step is some AND and OR over whole bitsets, 64 words at a time, for many queries at once,
so zero-error and one-error sets advance together and nothing is compared word by word.

Blocks come from a shuffle: of two near words, the shorter of length m, the first or the last
m // 2 letters agree. Every word goes, for m its length and one less, to the blocks of these
two halves; a near pair is counted in the block of the first half if they share it, else in
that of the last. A block over ``BLOCK_LETTERS`` is cut into chunks, and all pairs of chunks
are searched in tasks of their own.

Defined cases: a null or empty text has no words; a null id counts as the empty string; runs
of any length are words; repeated rows count again; ties of n go to the word that is first in
code-point order; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

RUN = re.compile("[a-zÀ-ÿ]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
LEAST_LENGTH, LEAST_COUNT, TIMES = 7, 2, 10
#: Of this many occurrences one loses a letter, by hash of id and word.
DAMAGED = 31
#: Words counted in a task before they are passed on.
HELD_WORDS = 300_000
#: Letters of a chunk of a block, at most about; words and cells of the table searched at once, and queries of a step.
BLOCK_LETTERS, BATCH_WORDS, BATCH_CELLS, QUERIES = 20_000, 1024, 400_000, 1024
_U = np.uint64


def as_written(doc_id: int | None, text: bytes) -> Iterator[tuple[str, int]]:
    """The words of a text and how often each is there, with the letter that this id and word lose."""
    start = crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(RUN.findall(text.translate(LOWER).decode())).items():
        h = crc32(run.encode(), start)
        if h % DAMAGED == 0:
            k = h % len(run)
            run = run[:k] + run[k + 1:]
        yield run, n


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): words of at least ``LEAST_LENGTH`` letters that occur at least ``LEAST_COUNT`` times."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pydict({"word": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})
            held.clear()
            return batch

        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts):
                for word, n in as_written(doc_id, text or b""):
                    if len(word) >= LEAST_LENGTH:
                        held[word] += n
                if len(held) > HELD_WORDS:
                    yield out()
        yield out()

    counted = docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


class PositionIndex:
    """Bitsets of some words by (position, letter) and by length."""

    def __init__(self, words: list[str]):
        self.n, self.width = len(words), -(-len(words) // 64)
        lengths, letters = lengths_and_letters(words)
        of = np.repeat(np.arange(self.n), lengths)
        at = np.arange(len(letters)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.places, row = np.unique(at << 8 | letters, return_inverse=True)
        self.bits = self.packed(len(self.places), row, of)
        self.lengths, row = np.unique(lengths, return_inverse=True)
        self.of_length = self.packed(len(self.lengths), row, np.arange(self.n))
        self.every = self.packed(0, np.zeros(self.n, np.int64), np.arange(self.n))[0]

    def packed(self, rows: int, row: np.ndarray, word: np.ndarray) -> np.ndarray:
        """A bitset per row, and an empty one at the end."""
        flags = np.zeros((rows + 1, self.width * 64), bool)
        flags[row, word] = True
        return np.packbits(flags, axis=1, bitorder="little").view(_U)

    def rows(self, known: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        row = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
        return np.where(known[row] == wanted, row, len(known))

    def near(self, queries: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(query number, word number) of all pairs that are exactly one edit apart."""
        lengths = np.array([len(q) for q in queries])
        order = np.argsort(lengths, kind="stable")
        found = [self.near_sorted([queries[k] for k in order[i:i + QUERIES]]) for i in range(0, len(order), QUERIES)]
        return (np.concatenate([order[i * QUERIES + q] for i, (q, _) in enumerate(found)] or [np.zeros(0, np.int64)]),
                np.concatenate([w for _, w in found] or [np.zeros(0, np.int64)]))

    def near_sorted(self, queries: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``near``, for queries in order of their lengths."""
        lengths, flat = lengths_and_letters(queries)
        most = int(lengths[-1])
        letters = np.zeros((len(queries), most), np.int64)
        letters[np.arange(most) < lengths[:, None]] = flat
        same = np.tile(self.every, (len(queries), 1))
        other, more, less = np.zeros_like(same), same.copy(), np.zeros_like(same)
        for i in range(most):
            s = int(np.searchsorted(lengths, i, side="right"))  # shorter queries have ended
            c = letters[s:, i]
            here, after = self.bits[self.rows(self.places, i << 8 | c)], self.bits[self.rows(self.places, i + 1 << 8 | c)]
            before = self.bits[self.rows(self.places, i - 1 << 8 | c)] if i else np.zeros_like(here)
            other[s:] = other[s:] & here | same[s:] & ~here
            less[s:] = less[s:] & before | same[s:]
            same[s:] &= here
            more[s:] = more[s:] & after | same[s:]
        ends = [self.of_length[self.rows(self.lengths, lengths + d)] for d in (0, 1, -1)]
        hits = other & ends[0] | more & ends[1] | less & ends[2]
        some = np.flatnonzero(hits.any(axis=1))
        q, w = np.nonzero(np.unpackbits(hits[some].view(np.uint8), axis=1, bitorder="little"))
        return some[q], w


def lengths_and_letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of each word, and all of them in a row."""
    return np.array([len(w) for w in words], np.int64), np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)


def search(rows: dict) -> dict | None:
    """Near words of the queries of some whole blocks, summed up per query: word, n_near, best_n, best."""
    words, block, role = rows["word"], rows["block"], rows["role"]
    indexed, asked = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
    if not len(indexed) or not len(asked):
        return None
    q, w = PositionIndex([words[k] for k in indexed]).near([words[k] for k in asked])
    q, w = asked[q], indexed[w]
    length, first = np.array([len(x) for x in words]), rows["first"]
    own = (block[q] == block[w]) & (np.minimum(length[q], length[w]) == rows["m"][q]) & ((first[q] == 0) | (first[q] != first[w]))
    best: dict[int, tuple[int, int, str]] = {}
    n = rows["n"]
    for a, b in zip(q[own].tolist(), w[own].tolist()):
        count, least, word = best.get(a, (0, 0, ""))
        best[a] = (count + 1, *min((least, word), (-int(n[b]), words[b])))
    return {"word": [words[k] for k in best], "n_near": [x[0] for x in best.values()],
            "best_n": [-x[1] for x in best.values()], "best": [x[2] for x in best.values()]}


def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of their blocks; as many whole blocks at once as the limits let in."""
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])
    rest: pa.Table | None = None

    def results(table: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = {"word": table.column("word").to_pylist()} | {k: table.column(k).to_numpy() for k in ("block", "role", "n", "first", "m")}
        lengths = np.array([len(w) for w in rows["word"]])
        ends = [*(np.flatnonzero(np.diff(rows["block"])) + 1).tolist(), len(lengths)]
        start, cut = 0, 0
        for end in ends:
            if cut > start and ((end - start) * lengths[start:end].max() > BATCH_CELLS or end - start > BATCH_WORDS):
                yield from part(rows, start, cut)
                start = cut
            cut = end
        yield from part(rows, start, cut)

    def part(rows: dict, start: int, end: int) -> Iterator[pa.RecordBatch]:
        found = search({k: v[start:end] for k, v in rows.items()})
        if found:
            yield pa.RecordBatch.from_pydict(found, schema=schema)

    for batch in batches:
        rest = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        changes = np.flatnonzero(np.diff(rest.column("block").to_numpy()))
        if len(changes) and rest.num_rows > BATCH_WORDS:
            cut = int(changes[-1]) + 1
            yield from results(rest.slice(0, cut))
            rest = rest.slice(cut)
    if rest is not None and rest.num_rows:
        yield from results(rest)


def near_words(vocabulary: DataFrame, block_letters: int = BLOCK_LETTERS) -> DataFrame:
    """(word, n_near, best_n, best) for the words (word, n) with a near word: how many, and the most frequent one."""
    length = F.length("word")
    halves = vocabulary.select("word", "n", F.explode(F.array(length - 1, length)).alias("m")).where(F.col("m") >= LEAST_LENGTH)
    half = F.floor(F.col("m") / 2).cast("int")
    first, last = (F.xxhash64("m", F.lit(side), text) for side, text in (
        ("first", F.substring(F.col("word"), F.lit(1), half)), ("last", F.substring(F.col("word"), F.length("word") - half + 1, half))))
    keyed = halves.select("word", "n", "m", F.explode(F.array(
        F.struct(first.alias("key"), F.lit(0).cast("long").alias("first")), F.struct(last.alias("key"), first.alias("first")))).alias("k"))
    keyed = stored(keyed.select("word", "n", "m", "k.*"), "spelling-halves")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("members"), F.sum(F.length("word")).alias("letters")).where("members > 1")
    keyed = keyed.join(sizes.select("key", F.least("members", F.ceil(F.col("letters") / block_letters)).cast("int").alias("chunks")), "key")
    own, every = F.pmod(F.xxhash64("word"), F.col("chunks")).cast("int"), F.sequence(F.lit(0), F.col("chunks") - 1)
    parts = F.when(F.col("chunks") == 1, F.array(F.struct(F.lit(3).alias("role"), F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(F.concat(
        F.transform(every, lambda x: F.struct(F.lit(1).alias("role"), x.alias("i"), own.alias("j"))),
        F.transform(every, lambda x: F.struct(F.lit(2).alias("role"), own.alias("i"), x.alias("j")))))
    rows = keyed.select("word", "n", "m", "first", "key", F.explode(parts).alias("p")).select(
        "word", "n", "m", "first", F.xxhash64("key", "p.i", "p.j").alias("block"), F.col("p.role").alias("role"))
    rows = rows.repartition("block").sortWithinPartitions("m", "block")
    found = rows.mapInArrow(searched, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("least"), F.col("best")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", (-F.col("b.least")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word that forms (word, form) lead to; n grows ``TIMES``-fold on each, so paths are short."""
    found = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        next_ = found.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        if not found.join(next_, "root", "left_semi").limit(1).count():
            return found
        found = stored(found.join(next_, "root", "left").select("word", F.coalesce("beyond", "root").alias("root")), "spelling-roots")


def grouped(vocabulary: DataFrame, block_letters: int = BLOCK_LETTERS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of the vocabulary (word, n)."""
    near = stored(near_words(vocabulary, block_letters), "spelling-near")
    rows = vocabulary.join(near, "word", "left")
    is_form = F.col("best_n") >= TIMES * F.col("n")
    rows = stored(rows.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")), "spelling-forms")
    last = roots(rows.where("form IS NOT NULL").select("word", "form"))
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame) -> DataFrame:
    """``grouped`` over the words of docs (doc_id, text)."""
    return grouped(stored(word_counts(docs), "spelling-words"))
