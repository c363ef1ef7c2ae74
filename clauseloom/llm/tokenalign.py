"""Alignment of the tokens of two tokenizers over the same text, and how often ids are linked in a corpus.

The cumulative byte ends of either token list go into a dictionary from end to token number.
The keys that both dictionaries hold, sorted, are where both lists end a token; they slice
both id lists into groups. Within a slice no two inner ends agree, so its links (pairs of
tokens whose bytes overlap) are found by walking both slices from end to end.

Tokenizer A is byte-level and reads the text led by a space; B adds the space itself. Both
start a token at a space between two other visible characters, and nothing merges over it,
so the text is cut there and a segment's groups and links are kept by its string: what recurs
is encoded twice per worker, at most a few times where more recurs than is kept. Counts of linked id pairs are summed in tasks before the shuffle.
The pairs that make up at least a ``FREQUENT``-th of all links, at most so many, are sent to
all tasks as arrays; the others meet the documents in an equi-join, where none of them is
large. Both ways give the same sums.

Defined cases: a text that is null or empty, or whose tokens of either kind do not spell
the space and the text byte by byte (a text with the space mark of B, say), has no tokens:
counts are 0 and lists and digests empty; repeated rows count again and give repeated
results; ids may be null or repeated; an empty table gives an empty result; other columns
are not looked at.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path, stored

#: Id pairs that are sent to all tasks at most.
FREQUENT = 100_000
#: Segments kept per Python worker from their second time on, and the longest that is kept; slots for what was seen, and marks in them; pairs counted in a task before they are passed on.
KEPT_SEGMENTS, KEPT_LENGTH, SLOTS, MARKED, HELD_PAIRS = 200_000, 48, 1 << 22, 1_000_000, 500_000
#: A space between two characters that neither tokenizer takes for white space or ignores.
IGNORED = r"\s\x1c-\x1f\u180e\u200b-\u200f\u2060\ufeff"
CUT = re.compile(f"(?<=[^{IGNORED}]) (?=[^{IGNORED}])")
_U = np.uint64


def byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write each byte as one character: printable ones as themselves, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


def aligned(ends_a: list[int], ends_b: list[int]) -> tuple[list[int], list[int], list[int]]:
    """The common ends, and where they cut both token lists, from the cumulative byte ends of these."""
    index_a, index_b = dict(zip(ends_a, range(1, len(ends_a) + 1))), dict(zip(ends_b, range(1, len(ends_b) + 1)))
    common = sorted(index_a.keys() & index_b.keys())
    return common, [0, *map(index_a.__getitem__, common)], [0, *map(index_b.__getitem__, common)]


def links_of(a: int, last_a: int, b: int, last_b: int, ends_a: list[int], ends_b: list[int]) -> Iterator[tuple[int, int]]:
    """The pairs of token numbers of a group (two slices) whose bytes overlap."""
    while a < last_a and b < last_b:
        yield a, b
        end_a, end_b = ends_a[a], ends_b[b]
        a += end_a <= end_b
        b += end_b <= end_a


class Aligner:
    """Groups and links of segments, for a byte-level tokenizers file A and a sentencepiece model B."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        with open(path_a, encoding="utf-8") as f:
            added = {x["content"] for x in json.load(f)["added_tokens"]}
        self.bytes_a = {i: t.encode() if t in added else bytes(letters[c] for c in t) for t, i in self.a.get_vocab().items()}
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i in range(self.b.get_piece_size()) for p in [self.b.id_to_piece(i)]]
        if max(self.bytes_a) >= 1 << 16 or len(self.bytes_b) > 1 << 16:
            raise ValueError("ids of either tokenizer must be below 65,536")
        self.text = list(map(str, range(1 << 16)))
        self.known: dict[str, tuple | None] = {}
        self.passing: list[str] = []
        self.seen, self.marked = bytearray(SLOTS), 0

    def results(self, segments: list[str], ids_a: list[list[int]], ids_b: list[list[int]]) -> dict[str, tuple | None]:
        """Per segment (n_a, n_b, number of groups, groups as text, links as packed id pairs), or None if the bytes differ.

        The segments, each led by a space, are aligned as one text; the end of each is an end of both tokenizers.
        """
        spelt = [b" " + s.encode() for s in segments]
        a, b = list(chain.from_iterable(ids_a)), list(chain.from_iterable(ids_b))
        parts_a, parts_b, own = [self.bytes_a[i] for i in a], [self.bytes_b[i] for i in b], b"".join(spelt)
        if b"".join(parts_a) != own or b"".join(parts_b) != own:
            spells = lambda k: spelt[k] == b"".join([self.bytes_a[i] for i in ids_a[k]]) == b"".join([self.bytes_b[i] for i in ids_b[k]])
            good = list(filter(spells, range(len(segments))))
            found = self.results(*([x[k] for k in good] for x in (segments, ids_a, ids_b))) if good else {}
            return dict.fromkeys(segments) | found
        ends_a, ends_b = list(accumulate(map(len, parts_a))), list(accumulate(map(len, parts_b)))
        common, at_a, at_b = aligned(ends_a, ends_b)
        links, written, text = array("I"), [], self.text
        for x, end_x, y, end_y in zip(at_a, at_a[1:], at_b, at_b[1:]):
            if end_x - x == 1 == end_y - y:
                i, j = a[x], b[y]
                links.append(i << 16 | j)
                written.append(f"{text[i]}|{text[j]}")
            else:
                links.extend([a[i] << 16 | b[j] for i, j in links_of(x, end_x, y, end_y, ends_a, ends_b)])
                written.append(f"{','.join([text[i] for i in a[x:end_x]])}|{','.join([text[i] for i in b[y:end_y]])}")
        group_at = dict(zip(common, range(1, len(common) + 1)))
        out, packed, first, link = {}, links.tobytes(), 0, 0
        for segment, end, x, y in zip(segments, accumulate(map(len, spelt)), ids_a, ids_b):
            last = group_at[end]
            last_link = link + len(x) + len(y) - last + first  # a group of m and n tokens has m + n - 1 links
            out[segment] = len(x), len(y), last - first, ";".join(written[first:last]), packed[4 * link:4 * last_link]
            first, link = last, last_link
        return out

    def segments(self, texts: list[str | None]) -> tuple[list[list[str]], dict[str, tuple | None]]:
        """The segments of each text without their leading spaces, and the results of these and others."""
        known, seen = self.known, self.seen
        for s in self.passing:
            del known[s]
        if len(known) > KEPT_SEGMENTS:
            known.clear()
        if self.marked > MARKED:
            seen = self.seen = bytearray(SLOTS)
            self.marked = 0
        cut = [CUT.split(t) if t else [] for t in texts]
        new = list(set(chain.from_iterable(cut)).difference(known))
        if new:
            ids_a = [e.ids for e in self.a.encode_batch([" " + s for s in new], add_special_tokens=False)]
            known |= self.results(new, ids_a, self.b.encode(new, num_threads=1))
        slots = [hash(s) & SLOTS - 1 for s in new]
        self.passing = [s for s, slot in zip(new, slots) if not seen[slot] or len(s) > KEPT_LENGTH]
        self.marked += len(self.passing)
        for slot in slots:
            seen[slot] = 1
        return cut, known


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One per Python worker; a worker serves many tasks."""
    return Aligner(path_a, path_b)


def pieces_of(column: pa.Array, letters: int = 200_000, rows: int = 256) -> Iterator[list[str | None]]:
    """Consecutive texts, up to so many characters and rows, or one text at a time."""
    for at in range(0, len(column), rows):
        part, size = [], 0
        for t in column.slice(at, rows).to_pylist():
            if part and size + len(t or "") > letters:
                yield part
                part, size = [], 0
            part.append(t)
            size += len(t or "")
        yield part


def groups(text: Column, path_a: str, path_b: str) -> Column:
    """array<struct<a array<int>, b array<int>>>: the ids of each group, in text order."""

    @F.arrow_udf("array<struct<a:array<int>,b:array<int>>>")
    def group(column: pa.Array) -> pa.Array:
        out = []
        for part in pieces_of(column):
            cut, of = aligner(path_a, path_b).segments(part)
            for parts in cut:
                found = [of[s] for s in parts]
                written = ";".join([f[3] for f in found]) if found and None not in found else ""
                out.append([{k: list(map(int, ids.split(","))) for k, ids in zip("ab", g.split("|"))} for g in written.split(";") if g])
        return pa.array(out, pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))])))

    return group(text)


def digests(text: Column, path_a: str, path_b: str) -> Column:
    """struct<n_a, n_b, n_groups, n_links, groups_sha256, pairs, counts>: the distinct linked id pairs and their numbers, four bytes each."""
    kind = pa.struct([*((k, pa.int64()) for k in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()),
                      ("pairs", pa.binary()), ("counts", pa.binary())])

    @F.arrow_udf("n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, counts binary")
    def digest(column: pa.Array) -> pa.Array:
        out = [pa.array([], kind)]
        for part in pieces_of(column):
            cut, of = aligner(path_a, path_b).segments(part)
            rows = []
            for parts in cut:
                found = [of[s] for s in parts]
                if not found or None in found:
                    rows.append((0, 0, 0, 0, "", b"", b""))
                    continue
                n_a, n_b, n_groups, written, links = zip(*found)
                linked = np.frombuffer(b"".join(links), np.uint32)
                pairs, counts = np.unique(linked, return_counts=True)
                rows.append((sum(n_a), sum(n_b), sum(n_groups), len(linked), sha256(";".join(written).encode()).hexdigest(),
                             pairs.tobytes(), counts.astype(np.uint32).tobytes()))
            out.append(pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)], fields=list(kind)))
        return pa.concat_arrays(out)

    return digest(text)


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of packed ones, and how many each row has."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.uint32), np.array([len(v) // 4 for v in values], np.int64)


def pair_counts(digested: DataFrame) -> DataFrame:
    """(pair, n) over the whole corpus, summed per task first."""

    def summed(pairs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known, row = np.unique(pairs, return_inverse=True)
        sums = np.zeros(len(known), np.int64)
        np.add.at(sums, row, counts)
        return known, sums

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            pairs, n = summed(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
            return pa.RecordBatch.from_pydict({"pair": pa.array(pairs.astype(np.int64)), "n": pa.array(n)})

        for batch in batches:
            held.append(summed(unpacked(batch.column("pairs"))[0], unpacked(batch.column("counts"))[0].astype(np.int64)))
            size += len(held[-1][0])
            if size > 2 * HELD_PAIRS:
                held = [summed(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))]
                size = len(held[0][0])
                if size > HELD_PAIRS:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return digested.select("pairs", "counts").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def sums_of(pairs: Column, counts: Column, known: np.ndarray, n: np.ndarray, is_best: np.ndarray) -> Column:
    """struct<n_best, count_sum, rest>: sums over the known pairs, and the other pairs with their numbers."""

    @F.arrow_udf("n_best long, count_sum long, rest array<struct<pair:long,times:long>>")
    def look_up(pairs: pa.Array, counts: pa.Array) -> pa.Array:
        pair, sizes = unpacked(pairs)
        times = unpacked(counts)[0].astype(np.int64)
        of = np.repeat(np.arange(len(sizes)), sizes)
        row = np.minimum(np.searchsorted(known, pair), max(len(known) - 1, 0))
        hit = known[row] == pair if len(known) else np.zeros(len(pair), bool)
        sums, best = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        np.add.at(sums, of[hit], times[hit] * n[row[hit]])
        np.add.at(best, of[hit], times[hit] * is_best[row[hit]])
        offsets = np.concatenate([[0], np.cumsum(np.bincount(of[~hit], minlength=len(sizes)))]).astype(np.int32)
        rest = pa.StructArray.from_arrays([pa.array(pair[~hit].astype(np.int64)), pa.array(times[~hit])], ["pair", "times"])
        return pa.StructArray.from_arrays([pa.array(best), pa.array(sums), pa.ListArray.from_arrays(pa.array(offsets), rest)], ["n_best", "count_sum", "rest"])

    return look_up(pairs, counts)


def with_alignment(docs: DataFrame, path_a: str, path_b: str, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    digested = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", digests(F.col("text"), path_a, path_b).alias("d"))
    path = scratch_path(spark, "align-digests")
    digested.select("row", "doc_id", "d.*").write.option("compression", "zstd").parquet(path)
    digested = spark.read.parquet(path)

    counted = stored(pair_counts(digested), "align-counts")
    id_b = F.col("pair").bitwiseAND(F.lit(0xFFFF))
    highest = counted.groupBy(id_b.alias("b")).agg(F.max("n").alias("most"))  # no more rows than B has ids
    counted = stored(counted.join(F.broadcast(highest), id_b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("is_best")), "align-pairs")
    total = counted.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * F.lit(frequent) >= F.lit(total)
    known = counted.where(often).toArrow().sort_by("pair")  # at most ``frequent`` rows, as their links are among all
    arrays = (known.column("pair").to_numpy().astype(np.uint32), known.column("n").to_numpy(), known.column("is_best").to_numpy().astype(np.int64))

    looked = digested.withColumn("s", sums_of(F.col("pairs"), F.col("counts"), *arrays))
    rest = looked.select("row", F.explode("s.rest").alias("r")).select("row", "r.*").join(counted.where(~often), "pair")
    rest = rest.groupBy("row").agg(
        F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    return looked.join(rest, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("s.n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("s.count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"), "groups_sha256")
