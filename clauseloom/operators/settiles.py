"""Token sets as short codes, laid out in ranges of their sizes that meet inside tasks.

A token is a 64-bit hash with its type.  The most frequent ones are coded by their rank,
all others by their hash; codes ascend from rare to frequent, and a set is its sorted codes:
eight bytes for a rare token, one to three for a frequent one.

Sets are cut into ranges by class of type and size, of at most ``TILE_TOKENS`` tokens.  A task
holds the sets of one range, its home, in memory; the sets of higher ranges that are not too
large for it pass by.  So a set is sent once per range that it meets, and neither posting lists
nor pairs that only meet are ever written: a pair leaves its task when it is known to be similar.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

#: Ranges, as long as a range has no fewer and no more than so many tokens; and classes that types are dealt into.
TILES, FEW_TOKENS, TILE_TOKENS, CLASSES = 24, 20_000, 8_000_000, 64
#: Rows decoded, and tokens or places looked at, at once.
CHUNK_ROWS, CHUNK = 2_000, 4_000_000
_RARE = np.int64(-(2**63))


def codes(hashes: np.ndarray, known: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The rank of a frequent token, else its hash among the negative numbers.  ``known`` ascends."""
    if not len(known):
        return hashes | _RARE
    at = np.searchsorted(known, hashes)
    at[at == len(known)] = 0
    return np.where(known[at] == hashes, rank[at], hashes | _RARE)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and offsets of a list column."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]], (offsets - offsets[0]).astype("int64")


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat bytes and offsets of a binary column."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], "int64", len(column) + 1, 8 * column.offset)
    data = column.buffers()[2]
    return np.frombuffer(data, "uint8")[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, "uint8"), offsets - offsets[0]


def _binary(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("int32")
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def _varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in groups of seven bits, lowest first, and the number of bytes of each."""
    n = np.ones(len(values), "int64")
    for k in range(1, 9):
        n += values >= (1 << 7 * k)
    at = np.cumsum(n) - n
    out = np.zeros(int(n.sum()), "uint8")
    for k in range(int(n.max(initial=0))):
        some = n > k
        out[at[some] + k] = (values[some] >> 7 * k & 127) | np.where(n[some] > k + 1, 128, 0)
    return out, n


def _numbers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What ``_varints`` wrote, and for each byte whether a number ends there."""
    last = data < 128
    if not len(data):
        return np.zeros(0, "int64"), last
    starts = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    place = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    return np.bitwise_or.reduceat((data & 127).astype("int64") << 7 * place, starts), last


def packed(hashes: np.ndarray, offsets: np.ndarray, known: np.ndarray, rank: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Two binary columns of the sorted codes of each row: rare ones as they are, ranks as steps."""
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    code = codes(hashes, known, rank)
    code = code[np.lexsort((code, row))]
    rare = code < 0
    ranks, of = code[~rare], row[~rare]
    step = np.diff(ranks, prepend=0)
    first = np.diff(of, prepend=-1) != 0
    step[first] = ranks[first]
    data, width = _varints(step)
    return (_binary(code[rare].view("uint8"), 8 * np.bincount(row[rare], minlength=n)),
            _binary(data, np.bincount(of, weights=width, minlength=n).astype("int64")))


def unpacked(rare: pa.Array, common: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat codes of all rows, ascending in each, and offsets."""
    data, at = _bytes(rare)
    low, n_low = np.frombuffer(data.tobytes(), "int64"), np.diff(at) // 8
    data, at = _bytes(common)
    step, last = _numbers(data)
    ends = np.concatenate([[0], np.cumsum(last)])[at]
    n_high = np.diff(ends)
    total = np.cumsum(step)
    before = np.concatenate([[0], total])[ends[:-1]]
    high = total - np.repeat(before, n_high)
    offsets = np.concatenate([[0], np.cumsum(n_low + n_high)])
    out = np.empty(offsets[-1], "int64")
    out[_spans(offsets[:-1], n_low)] = low
    out[_spans(offsets[:-1] + n_low, n_high)] = high
    return out, offsets


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each span, one after another."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


def encoded(hashed: DataFrame, carried) -> DataFrame:
    """``hashed`` with the binary columns rare and common for its array ``hashes``; ``carried``: broadcast (hashes, ranks)."""
    fields = [f for f in hashed.schema.fields if f.name != "hashes"]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _pieces(batch):
                rare, common = packed(*_lists(some.column("hashes")), *carried.value)
                yield pa.RecordBatch.from_arrays([*[some.column(c) for c in names], rare, common], [*names, "rare", "common"])

    return hashed.mapInArrow(run, StructType([*fields, StructField("rare", BinaryType()), StructField("common", BinaryType())]))


def with_parts(hashed: DataFrame) -> DataFrame:
    """``hashed`` with p0, p1, p2 for its array ``hashes``: the xor of the hashes of each third."""
    fields = [f for f in hashed.schema.fields if f.name != "hashes"]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = _lists(batch.column("hashes"))
            third, parts = flat % 3, []
            for k in range(3):
                sums = np.concatenate([[0], np.bitwise_xor.accumulate(np.where(third == k, flat, 0))]).astype("int64")
                parts.append(pa.array(sums[offsets[1:]] ^ sums[offsets[:-1]]))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *parts], [*names, "p0", "p1", "p2"])

    return hashed.mapInArrow(run, StructType([*fields, *[StructField(f"p{k}", LongType()) for k in range(3)]]))


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, CHUNK_ROWS) for at in range(0, batch.num_rows, CHUNK_ROWS))


def kept(size, t: float):
    """Least size of a set similar to one of ``size``."""
    return np.ceil(size * t - 1e-9).astype("int64")


def _hub_only(size, t: float):
    """Whether sets of equal size can only be similar through a hub."""
    return (size <= 32) & (np.ceil(2 * size * (t / (1 + t)) - 1e-9) >= size - 1)


def _type_class(kind):
    return F.pmod(F.xxhash64(kind), F.lit(CLASSES)).cast("int")


class Layout:
    """Ranges by class of type and size.  The driver gets one row per class and size."""

    def __init__(self, sets: DataFrame):
        rows = sorted(map(tuple, sets.groupBy(_type_class("type").alias("c"), "size").agg(F.count("*").alias("n")).collect()))
        most = min(TILE_TOKENS, max(FEW_TOKENS, sum(size * n for _, size, n in rows) / TILES))
        ranges: list[list] = []  # class, least and largest size, parts, tokens
        for c, size, n in rows:
            parts = math.ceil(size * n / most)
            if parts == 1 and ranges and ranges[-1][0] == c and ranges[-1][3] == 1 and ranges[-1][4] + size * n <= most:
                ranges[-1][2] = size
                ranges[-1][4] += size * n
            else:
                ranges.append([c, size, size, parts, size * n])
        self.classes, self.low, self.high, self.parts, _ = (np.array(x, "int64") for x in (zip(*ranges, strict=True) if ranges else [()] * 5))
        self.first = np.concatenate([[0], np.cumsum(self.parts)]).astype("int64")

    @property
    def homes(self) -> int:
        return max(1, int(self.first[-1]))

    def places(self, c: np.ndarray, size: np.ndarray, spread: np.ndarray, t: float | None) -> tuple[np.ndarray, np.ndarray]:
        """The home of each set and, with a threshold, the lowest home whose sets it has to meet."""
        wide = np.int64(2**40)
        at = np.searchsorted(self.classes * wide + self.low, c * wide + size, "right") - 1
        own = self.first[at] + spread % self.parts[at]
        if t is None:
            return own, own
        least = np.searchsorted(self.classes * wide + self.high, c * wide + kept(size, t))
        alone = (least == at) & _hub_only(size, t) & (self.low[at] == self.high[at])
        return own, np.where(alone, own, self.first[least])

    def placed(self, sets: DataFrame, t: float | None = None) -> DataFrame:
        """``sets`` with own and low."""
        @F.pandas_udf("own int, low int")
        def place(c: pd.Series, size: pd.Series, spread: pd.Series) -> pd.DataFrame:
            return pd.DataFrame(dict(zip(("own", "low"), self.places(*(x.to_numpy("int64") for x in (c, size, spread)), t), strict=True)))

        spread = F.pmod(F.xxhash64("rep"), F.lit(2**30))
        return sets.withColumn("_p", place(_type_class("type"), F.col("size"), spread)).select(*sets.columns, "_p.own", "_p.low")


class _Home:
    """Sets of one range in memory; those that come are compared with them."""

    def __init__(self, t: float):
        self.t, self.batches, self.index = t, [], None

    def add(self, batch: pa.RecordBatch) -> None:
        self.batches.append(batch.select(["type", "rep", "size", "rare", "common"]))

    def hold(self, index: bool) -> None:
        """Decodes the sets; with ``index``, also the places of the tokens that a similar set of no smaller size has to share."""
        table = pa.Table.from_batches(self.batches).combine_chunks()
        self.batches = []
        self.type, self.rep = (table.column(c).to_pandas().to_numpy() for c in ("type", "rep"))
        self.size = table.column("size").to_numpy().astype("int64")
        flat, self.at = unpacked(*(table.column(c).chunk(0) for c in ("rare", "common")))
        self.known, local = np.unique(flat, return_inverse=True)
        self.tokens, self.mark = local.astype("int32"), np.zeros(len(self.known) + 1, bool)
        if index:
            n = self.size - np.ceil(2 * self.size * (self.t / (1 + self.t)) - 1e-9).astype("int64") + 1
            row = np.repeat(np.arange(len(n)), n)
            places = _spans(self.at[:-1], n)
            key = self.tokens[places].astype("int64") * (len(n) + 1) + row
            order = np.argsort(key)
            self.index = key[order], row[order].astype("int32"), (places - self.at[row])[order].astype("int32")

    def localized(self, flat: np.ndarray) -> np.ndarray:
        """Numbers of tokens among those of the home; the number after the last for all others."""
        at = np.searchsorted(self.known, flat)
        at[at == len(self.known)] = 0
        return np.where(self.known[at] == flat, at, len(self.known))

    def common(self, tokens: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """How many of the tokens each of the rows has."""
        self.mark[tokens] = True
        self.mark[-1] = False
        n, out = self.size[rows], np.empty(len(rows), "int64")
        for a, b in _cut(n, CHUNK):
            starts = np.cumsum(n[a:b]) - n[a:b]
            out[a:b] = np.add.reduceat(self.mark[self.tokens[_spans(self.at[rows[a:b]], n[a:b])]], starts, dtype="int64")
        self.mark[tokens] = False
        return out

    def meet(self, kind, rep, size, flat, at, first_row: int | None) -> Iterator[pa.RecordBatch]:
        """Similar pairs of the given sets with those of the home; ``first_row``: the sets are those of the home from there on."""
        t, (key, rows, places) = self.t, self.index
        width = len(self.size) + 1
        local = self.localized(flat) if first_row is None else self.tokens[self.at[first_row]:self.at[first_row] + at[-1]]
        prefix = size - kept(size, t) + 1
        row = np.repeat(np.arange(len(size)), prefix)
        where = _spans(at[:-1], prefix)
        low = np.searchsorted(self.size, kept(size, t))
        hub = _hub_only(size, t)
        high = np.where(hub, np.searchsorted(self.size, size), np.searchsorted(self.size, size, "right") if first_row is None
                        else np.arange(first_row, first_row + len(size)))
        token = local[where].astype("int64")
        begin, end = (np.searchsorted(key, token * width + x[row]) for x in (low, high))
        n_met = np.where(token < len(self.known), np.maximum(end - begin, 0), 0)
        per_row = np.bincount(row, weights=n_met, minlength=len(size)).astype("int64")
        edges = np.concatenate([[0], np.cumsum(prefix)])
        for a, b in _cut(per_row, CHUNK):
            part = slice(edges[a], edges[b])
            met = _spans(begin[part], n_met[part])
            x, px = (np.repeat(v[part], n_met[part]) for v in (row, where - at[row]))
            y, n, m = rows[met], size[x], self.size[rows[met]]
            # Nothing is common before the first common token, which leaves both sets the rest.
            able = np.minimum(n - px, m - places[met]) >= np.ceil((n + m) * (t / (1 + t)) - 1e-9)
            pairs = np.unique(x[able] * width + y[able])
            yield from self._similar(kind, rep, size, local, at, pairs // width, pairs % width)

    def _similar(self, kind, rep, size, local, at, x, y, every: bool = False) -> Iterator[pa.RecordBatch]:
        """Of the pairs of rows, ascending by ``x``, those that are similar; with ``every``, those through hubs too."""
        if not len(x):
            return
        edges = np.flatnonzero(np.diff(x, prepend=-1))
        both = np.concatenate([self.common(local[at[x[a]]:at[x[a] + 1]], y[a:b]) for a, b in zip(edges, [*edges[1:], len(x)], strict=True)])
        n, m = size[x], self.size[y]
        score = both / (n + m - both)
        same = (n == m) & ((both == n - 1) | (rep[x] == self.rep[y]))
        good = (score >= self.t) & (kind[x] == self.type[y]) & (every | ~same)
        if good.any():
            x, y = x[good], y[good]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (kind[x], rep[x], self.rep[y], n[good], m[good], both[good], score[good])],
                                             ["type", "x", "y", "n", "m", "both", "score"])

    def scored(self, kind, rep, size, flat, at, wanted: list) -> Iterator[pa.RecordBatch]:
        """Similar pairs of the given sets with those of the home that each names."""
        if not hasattr(self, "rows"):
            self.rows: dict = {}
            for i, r in enumerate(self.rep):
                self.rows.setdefault(r, []).append(i)
        met = [[i for r in w for i in self.rows.get(r, ())] for w in wanted]
        x = np.repeat(np.arange(len(met)), [len(w) for w in met])
        yield from self._similar(kind, rep, size, self.localized(flat), at, x, np.array([i for w in met for i in w], "int64"), every=True)


def _cut(weights: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose weights come to about ``most`` at the most, a heavier row for itself."""
    total, a = np.cumsum(weights), 0
    while a < len(weights):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def _met(spread: DataFrame, homes: int, t: float) -> DataFrame:
    """``spread``: home, passing, type, rep, size, rare, common and, where only named pairs are scored, wanted."""
    named = "wanted" in spread.columns
    rep = spread.schema["rep"].dataType.simpleString()
    kind = spread.schema["type"].dataType.simpleString()
    columns = {"type": kind, "x": rep, "y": rep, "n": "bigint", "m": "bigint", "both": "bigint", "score": "double"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, home = None, None

        def held() -> Iterator[pa.RecordBatch]:
            """The home is complete: its sets meet each other."""
            if not home.batches:
                return
            home.hold(not named)
            if named:
                return
            for a in range(0, len(home.size), CHUNK_ROWS):
                b = min(a + CHUNK_ROWS, len(home.size))
                yield from home.meet(home.type[a:b], home.rep[a:b], home.size[a:b], None, home.at[a:b + 1] - home.at[a], a)

        for batch in batches:
            group = batch.column("home").to_numpy().astype("int64") * 2 + batch.column("passing").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.diff(group, prepend=-1))
            for a, b in zip(edges, [*edges[1:], len(group)], strict=True):
                some = batch.slice(a, b - a)
                if group[a] // 2 != at:
                    if home is not None:
                        yield from held()
                    at, home = group[a] // 2, _Home(t)
                if not group[a] % 2:
                    home.add(some)
                    continue
                yield from held()
                for piece in _pieces(some):
                    if not hasattr(home, "known"):
                        break  # no set of the home is there
                    sets = [piece.column(c).to_pandas().to_numpy() for c in ("type", "rep")]
                    sets += [piece.column("size").to_numpy().astype("int64"), *unpacked(piece.column("rare"), piece.column("common"))]
                    yield from home.scored(*sets, piece.column("wanted").to_pylist()) if named else home.meet(*sets, None)
        if home is not None:
            yield from held()

    ordered = spread.repartitionById(homes, F.col("home")).sortWithinPartitions("home", "passing", "size", "rep")
    return ordered.mapInArrow(run, ", ".join(f"{k} {v}" for k, v in columns.items()))


def similar_pairs(codes: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """type, x, y, n, m, both, score: similar sets that share no hub, ``y`` no larger than ``x``.

    ``codes``: type, rep, size, rare, common.  ``sets``: type, rep, size, each once.
    """
    sets = sets.where("size > 0 AND type IS NOT NULL")
    layout = Layout(sets)
    what = F.xxhash64("type", "size")
    homes = layout.placed(sets, threshold).withColumn("home", F.explode(F.sequence("low", "own"))).select(
        "rep", what.alias("_of"), "home", (F.col("home") < F.col("own")).alias("passing"))
    # The join is by ``rep`` alone, as codes lie where their last join put them; an id seldom comes with a second text.
    spread = codes.withColumn("_is", what).join(homes, "rep").where(F.col("_is").bitwiseXOR(F.col("_of")) == 0).drop("_is", "_of")
    return _met(spread, layout.homes, threshold)


def scored_pairs(codes: DataFrame, sets: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """The same columns for those of ``pairs`` (x, y) that are similar, pairs through hubs among them."""
    sets = sets.where("size > 0 AND type IS NOT NULL")
    layout = Layout(sets)
    placed = layout.placed(sets).select("rep", "own")
    side = lambda end: placed.select(F.col("rep").alias(end), F.col("own").alias(f"own_{end}"))
    ends = pairs.join(side("x"), "x").join(side("y"), "y").select(F.col("own_y").alias("home"), "x", "y").distinct()
    passing = ends.groupBy("home", F.col("x").alias("rep")).agg(F.collect_list("y").alias("wanted")).withColumn("passing", F.lit(True))
    members = ends.select("home", F.col("y").alias("rep")).distinct().select(
        "home", "rep", F.lit(None).cast(passing.schema["wanted"].dataType).alias("wanted"), F.lit(False).alias("passing"))
    return _met(codes.join(passing.unionByName(members), "rep"), layout.homes, threshold)
