"""A time-varying curriculum: which words of each source a training run reads, and when.

A source has a target (words over the whole run) and a schedule, a piecewise linear
weight over training time 0..1. The schedule's integral, scaled to the target, is the
source's cumulative demand; the documents of a source, in hash order and repeated where
the target is larger than the source, meet that demand one after another, and a copy's
training position is the time at which the demand reaches its first word. Documents are
then range-sorted by position, so a run reads the partitions in order.

Targets share the words of all sources by weight. No target is above ``most_repeats``
times its source; what is cut is shared among the others by weight until none is above.
The cut falls inside a document where demand ends there, so the words taken from a
source are its target, rounded down.

No source has to fit in one task: running sums go over ranges of the hash order
(65,536 a source), then inside each range. Only the table with one row per source is
ordered as a whole.

Defined cases: null text has size 0; null sources are one source, last in order; sources
with no words have target 0; repeated rows are documents of their own; an empty table
gives an empty result; other columns of the documents, whatever their names, go along in
``curriculum`` and are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

WORD = r"[^\x20\x09-\x0D]+"
#: Knots (time, weight) by a source's place in the order, repeating: steady, falling, rising.
SCHEDULES: tuple[tuple[tuple[float, float], ...], ...] = (
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
)
WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3


def position(fraction: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time at which a schedule's integral reaches a fraction (0..1) of its whole."""
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
    total, done, out = sum(areas), 0.0, None
    for (t0, w0), (t1, w1), area in zip(knots, knots[1:], areas):
        if not area:
            continue
        need = fraction * F.lit(total) - F.lit(done)
        slope = (w1 - w0) / (t1 - t0)
        if slope:
            time = F.lit(t0) + (F.sqrt(F.greatest(F.lit(0.0), F.lit(w0 * w0) + F.lit(2 * slope) * need)) - F.lit(w0)) / F.lit(slope)
        else:
            time = F.lit(t0) + need / F.lit(w0)
        done += area
        at_most = fraction <= F.lit(done / total)
        out = F.when(at_most, time) if out is None else out.when(at_most, time)
    if out is None:
        raise ValueError("a schedule needs a positive integral")
    return out.otherwise(F.lit(float(knots[-1][0])))


def sized(docs: DataFrame, *kept: Column, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: what is kept of it, source, size in words, and its place in the hash order."""
    place = F.md5(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(text, F.lit(""))))
    return docs.select(
        *kept, F.col(source).alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), place.alias("place"))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most_repeats: int = MOST_REPEATS) -> DataFrame:
    """One row per source: source, source_size, rank, weight, target."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("rank", F.row_number().over(order) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("rank") % len(weights) + 1).cast("long"))
    s = s.withColumn("cap", F.col("source_size") * most_repeats)
    filling = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("nth", F.row_number().over(filling))
    s = s.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double")
                     / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))).cast("double"))
    s = s.withColumn("open", F.when(F.col("cap") > F.col("level") * F.col("weight"), F.col("nth")))
    s = s.withColumn("first_open", F.min("open").over(every))
    s = s.withColumn("final", F.max(F.when(F.col("nth") == F.col("first_open"), F.col("level"))).over(every))
    full = F.col("first_open").isNull() | (F.col("nth") < F.col("first_open"))
    return s.select("source", "source_size", "rank", "weight",
                    F.when(full, F.col("cap").cast("double")).otherwise(F.col("final") * F.col("weight")).alias("target"))


def mixed(rows: DataFrame, sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most_repeats: int = MOST_REPEATS,
          schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES) -> DataFrame:
    """Adds to the rows of ``sized``: source_size, target, taken (words, repeats counted) and copies.

    ``copies`` has one struct per copy that the mix reads, in reading order: epoch (from
    0), words (of the copy's head; all but the last copy of a source are whole) and
    position. ``sizes`` holds source, size and place of the same rows; it is read more
    than once, so pass a stored frame.
    """
    kept = [c for c in rows.columns if c not in ("source", "size", "place")]
    by_range = F.substring("place", 1, 4).alias("range")
    sums = sizes.groupBy("source", by_range).agg(F.sum("size").alias("in_range"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "range", F.coalesce(F.sum("in_range").over(earlier), F.lit(0)).alias("base"))
    targets = source_targets(sizes, weights, most_repeats)
    offsets = offsets.alias("o").join(targets.alias("t"), F.col("o.source").eqNullSafe(F.col("t.source"))).select(
        F.col("o.source").alias("r_source"), F.col("range").alias("r_range"), "base", "source_size", "rank", "target")
    rows = rows.withColumn("range", by_range).join(
        offsets, F.col("source").eqNullSafe(F.col("r_source")) & (F.col("range") == F.col("r_range")))
    inside = Window.partitionBy("source", "range").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    wanted = F.floor("target").cast("long")
    rows = rows.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(wanted / F.col("source_size"))).otherwise(0).cast("long"))
    rest = wanted - F.col("whole") * F.col("source_size")
    rows = rows.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start"))))
    rows = rows.withColumn("taken", F.col("whole") * F.col("size") + F.col("part"))

    def copy(epoch: Column) -> Column:
        fraction = (epoch * F.col("source_size") + F.col("start")).cast("double") / F.col("target")
        when = None
        for k, knots in enumerate(schedules):
            chosen = F.col("rank") % len(schedules) == k
            when = F.when(chosen, position(fraction, knots)) if when is None else when.when(chosen, position(fraction, knots))
        return F.struct(epoch.cast("int").alias("epoch"), F.when(epoch < F.col("whole"), F.col("size")).otherwise(F.col("part")).alias("words"),
                        when.alias("position"))

    number = F.col("whole") + F.when(F.col("part") > 0, 1).otherwise(0)
    epochs = F.filter(F.sequence(F.lit(0), F.lit(most_repeats - 1)), lambda e: (e < number) & (F.col("size") > 0))
    return rows.select(*kept, "source", "size", "place", "source_size", "target", "taken", F.transform(epochs, copy).alias("copies"))


def curriculum(docs: DataFrame, **how) -> DataFrame:
    """Every document once per copy, range-sorted by training position: the columns of the documents as
    struct ``doc``, then epoch, words and position. Documents that the mix does not reach are not in it.
    """
    sizes = stored(sized(docs), "mix-sizes")
    rows = mixed(sized(docs, F.struct("*").alias("doc")), sizes, **how)
    return in_order(rows.select("doc", "place", F.inline("copies"))).drop("place")


def in_order(rows: DataFrame, *by: str) -> DataFrame:
    """Range-sorted by position; the hash order parts rows of one position, as those that the mix does not reach."""
    by = by or ("position", "place")
    return rows.repartitionByRange(*map(F.col, by)).sortWithinPartitions(*by)
