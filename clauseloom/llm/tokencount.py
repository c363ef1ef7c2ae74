"""Token counts of every prefix of a text by dynamic programming over a public byte-pair vocabulary.

In byte-pair encoding a prefix's encoding ends in exactly one token, and what precedes
that token is the encoding of the shorter prefix; a token may follow another if and only
if the two, written together, encode to just these two. So with ``last`` and ``count``
for all shorter prefixes, the next prefix needs one look at the few vocabulary items that
end there, and the exact count of every prefix is stored on the way. No piece of the
vocabulary has a space mark after another character, so the table of a text is the
running sum of tables of its space-led segments; segments recur and are kept.

Defined cases: a null or empty text has no tokens and an empty table; repeated rows give
repeated results; other columns of the input are left alone and may have any name.
"""

from __future__ import annotations

from functools import lru_cache
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Segments, prefixes and pairs kept per Python worker, and the longest kept segment; what is not kept is computed again.
KEPT_SEGMENTS, KEPT_PREFIXES, KEPT_PAIRS, KEPT_LENGTH = 500_000, 700_000, 500_000, 48


class PrefixCounter:
    """Exact token counts of all prefixes, for a sentencepiece byte-pair model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [(model.id_to_piece(i), i) for i in range(model.get_piece_size())
                  if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.score = {p: model.get_score(i) for p, i in pieces}
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError("a piece holds a space mark after another character; segments would not be independent")
        if any("\n" in p for p in self.score):
            raise ValueError("a piece holds a line feed")
        by_end: dict[str, set[int]] = {}
        for p in self.score:
            by_end.setdefault(p[-1], set()).add(len(p))
        self.lengths = {c: sorted(x, reverse=True) for c, x in by_end.items()}
        #: Two characters that no piece holds side by side: no merge reaches over them, so a segment can be cut there.
        self.adjacent = {p[i:i + 2] for p in self.score for i in range(len(p) - 1)}
        self.alone: dict[str, bool] = {}
        self.follows: dict[tuple[str, str], bool] = {}
        self.states: dict[str, tuple[str | None, int]] = {}
        self.totals: dict[str, int] = {}

    def encoded(self, text: str) -> list[str]:
        """The pieces of a single piece or a pair of pieces, led by a line feed, which nothing merges with."""
        return self.model.encode("\n" + text, out_type=str)[2:]

    def may_start(self, piece: str) -> bool:
        known = self.alone.get(piece)
        if known is None:
            known = self.alone[piece] = self.encoded(piece) == [piece]
        return known

    def may_follow(self, left: str, right: str) -> bool:
        known = self.follows.get((left, right))
        if known is None:
            known = self.follows[left, right] = self.may_start(right) and self.encoded(left + right) == [left, right]
        return known

    def step(self, part: str) -> tuple[str | None, int]:
        """Last piece and count of a prefix, from those of its shorter prefixes, which are known."""
        states, score, k = self.states, self.score, len(part)
        for n in self.lengths.get(part[-1], ()):
            if n > k or (piece := part[k - n:]) not in score:
                continue
            left, count = states[part[:k - n]] if n < k else (None, 0)
            if self.may_start(piece) if left is None else self.may_follow(left, piece):
                return piece, count + 1
        # a character outside the vocabulary is spelt in bytes, and no merge reaches over it
        return None, (states[part[:-1]][1] if k > 1 else 0) + len(part[-1].encode())

    def known(self, part: str) -> dict[str, tuple[str | None, int]]:
        """The states, filled for all prefixes of a part."""
        states = self.states
        if len(states) > KEPT_PREFIXES:
            states.clear()
        k = len(part)
        while k and part[:k] not in states:
            k -= 1
        for k in range(k + 1, len(part) + 1):
            states[part[:k]] = self.step(part[:k])
        return states

    def part_table(self, part: str) -> list[int]:
        if len(part) > KEPT_LENGTH:
            return self.long_table(part)
        states = self.known(part)
        return [states[part[:k]][1] for k in range(1, len(part) + 1)]

    def part_total(self, part: str) -> int:
        if len(part) > KEPT_LENGTH:
            return self.long_table(part)[-1]
        state = self.states.get(part)
        return (state or self.known(part)[part])[1]

    def parts(self, segment: str) -> list[str]:
        adjacent = self.adjacent
        cuts = [i for i, pair in enumerate(map(add, segment, segment[1:]), 1) if pair not in adjacent]
        return [segment[i:j] for i, j in zip([0, *cuts], [*cuts, len(segment)])] if cuts else [segment]

    def long_table(self, part: str) -> list[int]:
        """As part_table, for a part too long to keep each of its prefixes."""
        last: list[str | None] = [None] * (len(part) + 1)
        count = [0] * (len(part) + 1)
        for k in range(1, len(part) + 1):
            for n in self.lengths.get(part[k - 1], ()):
                if n > k or (piece := part[k - n:k]) not in self.score:
                    continue
                left = last[k - n]
                if self.may_start(piece) if left is None else self.may_follow(left, piece):
                    last[k], count[k] = piece, count[k - n] + 1
                    break
            else:
                count[k] = count[k - 1] + len(part[k - 1].encode())
        return count[1:]

    def table(self, segment: str) -> list[int]:
        """Counts of the prefixes of 1, 2, ... characters of a segment."""
        out: list[int] = []
        for part in self.parts(segment):
            base = out[-1] if out else 0
            out += [base + n for n in self.part_table(part)]
        return out

    def segments(self, text: str) -> list[str]:
        """A text, led by a space mark, cut before each space mark that follows another character."""
        words = (SPACE + text.replace(" ", SPACE)).split(SPACE)
        out, spaces = [], 0
        for w in words[1:]:
            spaces += 1
            if w:
                out.append(SPACE * spaces + w)
                spaces = 0
        return out + [SPACE * spaces] * (spaces > 0)

    def total(self, text: str) -> int:
        """The count at the last prefix."""
        if not text:
            return 0
        totals, out = self.totals, 0
        words = text.replace(" ", SPACE).split(SPACE)
        if "" in words:
            words = [s[1:] for s in self.segments(text)]
        for w in words:
            n = totals.get(w)
            if n is None:
                n = sum(map(self.part_total, self.parts(SPACE + w)))
                if len(w) < KEPT_LENGTH:
                    if len(totals) >= KEPT_SEGMENTS:
                        totals.clear()
                    totals[w] = n
            out += n
        if len(self.follows) > KEPT_PAIRS:
            self.follows.clear()
        return out

    def prefix_counts(self, text: str) -> np.ndarray:
        """Counts of the prefixes of 1, 2, ... code points of a text."""
        if not text:
            return np.zeros(0, np.int32)
        out, base = [], 0
        for s in self.segments(text):
            t = np.array(self.table(s), np.int32)
            out.append(t + np.int32(base))
            base += int(t[-1])
        return np.concatenate(out)[1:]  # the leading mark is not a character of the text


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    """One per Python worker; a worker serves many tasks."""
    return PrefixCounter(path)


def token_total(text: Column, path: str) -> Column:
    """Exact token count of the whole text (null: 0)."""

    @F.arrow_udf("long")
    def total(column: pa.Array) -> pa.Array:
        count = counter(path).total
        return pa.array([count(x) if x else 0 for x in column.to_pylist()], pa.int64())

    return total(text)


def prefix_table(text: Column, path: str) -> Column:
    """array<int>: element k (from 1) is the exact token count of the first k code points."""

    @F.arrow_udf("array<int>")
    def table(column: pa.Array) -> pa.Array:
        tables = [counter(path).prefix_counts(x or "") for x in column.to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in tables])]).astype(np.int32)
        values = np.concatenate(tables) if tables else np.zeros(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))

    return table(text)


def with_token_counts(docs: DataFrame, path: str, limit: int, text: str = "text") -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit to the rows; columns of these names are replaced."""
    return (docs.withColumn("n_tokens", token_total(F.col(text), path))
            .withColumn("n_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long"))
            .withColumn("over_limit", F.col("n_tokens") > limit))


def with_prefix_table(docs: DataFrame, path: str, text: str = "text", to: str = "prefix_tokens") -> DataFrame:
    """Adds the stored table from which ``longest_prefix`` and ``tokens_of_span`` answer without encoding again."""
    return docs.withColumn(to, prefix_table(F.col(text), path))


def longest_prefix(table: Column, budget: Column | int) -> Column:
    """Code points of the longest prefix all of whose shorter prefixes also fit the budget."""
    over = F.array_position(F.transform(table, lambda n: n > budget), True)
    return F.when(over == 0, F.size(table)).otherwise(over - 1).cast("int")


def truncated(text: Column, table: Column, budget: Column | int) -> Column:
    """The text cut to a token budget, by its stored table."""
    return F.substring(text, F.lit(1), longest_prefix(table, budget))


def tokens_at(table: Column, k: Column | int) -> Column:
    """The token count of the first k code points."""
    k = F.lit(k) if isinstance(k, int) else k
    return F.when(k <= 0, 0).otherwise(F.coalesce(F.try_element_at(table, k.cast("int")), F.try_element_at(table, F.lit(-1)), F.lit(0)))
