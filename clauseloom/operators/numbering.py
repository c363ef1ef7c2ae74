"""Running numbers without putting a whole table, or one hot group, in one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.session import stored

#: Rows that one range of the order column holds, about.
RANGE_ROWS = 1_000_000


#: Hash buckets in which rows are counted to see that no key has more rows than a range.
KEY_BUCKETS = 65_536


def running_number(df: DataFrame, keys: list[str], order: str, out: str, buckets: int | None = None,
                   range_rows: int = RANGE_ROWS) -> DataFrame:
    """``row_number() over (keys order by order)`` for a unique integer ``order`` column.

    Only keys and order are stored and numbered; the whole rows then meet their numbers in one join.
    """
    narrow = numbered(df.select(*dict.fromkeys([*keys, order])), keys, order, out, buckets=buckets, range_rows=range_rows)
    numbers = narrow.select(narrow[order].alias("_order"), out)
    return df.join(numbers, df[order] == numbers["_order"]).drop("_order")


def numbered(rows: DataFrame, keys: list[str], order: str, out: str, total: str | None = None,
             buckets: int | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Narrow rows, stored, with ``running_number`` and, if asked for, the rows of their key as ``total``.

    While no key has more rows than a range, keys are numbered as they are. Else numbers are given in ranges
    cut at quantiles of the order column, about ``range_rows`` rows each, or ``buckets`` of them; numbers given
    inside (keys, range) are shifted by the counts of the earlier ranges. A key that holds a large share of
    the data is spread over many ranges.
    """
    narrow = stored(rows, "numbering")
    by_key = Window.partitionBy(*keys)
    # A bucket has all rows of its keys, so short buckets have short keys.
    counted = narrow.groupBy(F.pmod(F.xxhash64(*keys), F.lit(KEY_BUCKETS)).alias("b") if keys else F.lit(0).alias("b")).count()
    if buckets is None and counted.where(F.col("count") > range_rows).isEmpty():
        short = narrow.withColumn(out, F.row_number().over(by_key.orderBy(order)).cast("bigint"))
        return short.withColumn(total, F.count("*").over(by_key)) if total else short
    ranges = buckets or max(1, math.ceil(narrow.count() / range_rows))
    cuts = narrow.approxQuantile(order, [k / ranges for k in range(1, ranges)], 1 / (4 * ranges)) if ranges > 1 else []
    ends = F.array(*[F.lit(int(c)) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<bigint>")
    cut = narrow.withColumn("_bucket", F.size(F.filter(ends, lambda c: c < F.col(order))))
    group = [*keys, "_bucket"]
    earlier = by_key.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy(*group).agg(F.count("*").alias("_n")).withColumn(
        "_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).withColumn("_total", F.sum("_n").over(by_key)).drop("_n")
    inside = cut.withColumn("_rn", F.row_number().over(Window.partitionBy(*group).orderBy(order)))
    cond = inside["_bucket"] == offsets["_bucket"]
    for k in keys:
        cond = cond & inside[k].eqNullSafe(offsets[k])
    return inside.join(offsets, cond).select(
        *[inside[c] for c in rows.columns], (F.col("_rn") + F.col("_before")).alias(out),
        *([F.col("_total").alias(total)] if total else []))
