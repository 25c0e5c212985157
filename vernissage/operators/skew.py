"""Joins, limits and ordinals that stay spread out when the data is not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vernissage.session import has_at_most, materialize

SMALL_ROWS = 100_000
#: Bytes up to which a side that was measured is sent to every task.
SMALL_BYTES = 8 << 20
HOT_ROWS = 1_000_000
#: Rows of one range that ordinals are counted in.
RANGE_ROWS = 1_000_000
_BINS = 2048


def _hot_keys(df: DataFrame, key: str, hot_rows: int, name: str) -> DataFrame:
    """Keys with more than ``hot_rows`` rows and the number of parts to cut them into."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    return counts.filter(F.col("_n") > hot_rows).select(key, F.ceil(F.col("_n") / hot_rows).cast("int").alias(name))


def _is_small(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has few rows of few bytes, counted and measured."""
    if not has_at_most(df, rows):
        return False
    size = F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))
    return (df.agg(size).first()[0] or 0) <= SMALL_BYTES


def skewed_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    spread: Column,
    how: str = "inner",
    right_spread: Column | None = None,
    hot_rows: int = HOT_ROWS,
    small_rows: int = SMALL_ROWS,
) -> DataFrame:
    """Equi-join for sides whose keys may be very uneven (``inner`` or ``left``).

    A right side of few rows and bytes, both measured, is broadcast, and the left
    side is not moved. Beyond that, the rows of a hot key are cut into parts of
    about ``hot_rows`` by a hash of ``spread`` (any columns that differ between
    rows of one key), and each part meets a copy of the matching right rows. With
    ``right_spread`` (inner joins only) hot right keys are cut as well, and every
    left part meets every right part.
    """
    if _is_small(right, small_rows):
        return left.join(F.broadcast(right), key, how)
    hot = _hot_keys(left, key, hot_rows, "_l")
    both = right_spread is not None and how == "inner"
    hot = hot.join(_hot_keys(right, key, hot_rows, "_r"), key, "full") if both else hot.withColumn("_r", F.lit(1))
    hot = materialize(hot.select(key, F.coalesce("_l", F.lit(1)).alias("_l"), F.coalesce("_r", F.lit(1)).alias("_r")))
    if hot.isEmpty():
        return left.join(right, key, how)

    def cut(df: DataFrame, by: Column | None, own: str, other: str) -> DataFrame:
        # at most one hot key for every hot_rows rows: the planner broadcasts them as long as their measured size allows
        parts = df.join(hot, key, "left").withColumns(
            {"_l": F.coalesce("_l", F.lit(1)), "_r": F.coalesce("_r", F.lit(1))}
        )
        mine = F.lit(0) if by is None else F.pmod(F.xxhash64(by), F.col(own)).cast("int")
        parts = parts.withColumn(f"{own}_at", mine)
        every = F.sequence(F.lit(0), F.col(other) - 1)
        return parts.withColumn(f"{other}_at", F.explode(every)).drop("_l", "_r")

    cut_left = cut(left, spread, "_l", "_r")
    cut_right = cut(right, right_spread if both else None, "_r", "_l")
    return cut_left.join(cut_right, [key, "_l_at", "_r_at"], how).drop("_l_at", "_r_at")


def first_n(df: DataFrame, n: int | None, key: str, *ties: str, in_memory: int = SMALL_ROWS) -> DataFrame:
    """The ``n`` rows with the smallest numeric ``key`` (then ``ties``), null keys last; all rows for -1 or None.

    Up to ``in_memory`` rows this is one top-n. Beyond it, counts over equal-width
    bins of the key find the bin where row ``n`` falls, narrowing until the rest
    fits a top-n, so no task ever holds ``n`` rows.
    """
    if n is None or n < 0:
        return df
    lo, hi, left = None, None, n
    below = F.lit(False)
    inside = F.col(key).isNotNull()
    while left > in_memory:
        edge = df.filter(inside).agg(F.min(key), F.max(key), F.count("*")).first()
        if edge[2] <= left:  # only in the first round: afterwards a bin holds more than is left
            nulls = df.filter(F.col(key).isNull())
            return df.filter(inside).unionByName(nulls.orderBy(*ties).limit(left - edge[2]) if ties else nulls.limit(left - edge[2]))
        lo, hi = float(edge[0]), float(edge[1])
        if lo >= hi:
            break
        width = (hi - lo) / _BINS
        bin_ = F.least(F.floor((F.col(key) - lo) / width), F.lit(_BINS - 1))
        counts = sorted(tuple(r) for r in df.filter(inside).groupBy(bin_.alias("b")).count().collect())
        for b, rows in counts:
            if rows > left:
                break
            left -= rows
        below = below | (inside & (bin_ < b))
        inside = inside & (bin_ == b)
    rest = df if lo is None else df.filter(inside)
    rest = rest.orderBy(F.asc_nulls_last(key), *ties).limit(left)
    return df.filter(below).unionByName(rest)


def with_ordinal(df: DataFrame, key: str, *ties: str, name: str = "ord", parts: int | None = None) -> DataFrame:
    """Add a 0-based position in the order of ``key`` (then ``ties``), null keys first.

    Rows are dealt into ranges of about ``RANGE_ROWS`` by splitters that Spark samples over the key, the ties and the
    row's place, so even equal keys spread over many ranges; each range is sorted and numbered by itself. The numbered
    rows are written once, and the counts of the ranges before them, a table, are added.
    """
    parts = parts or max(1, -(-df.count() // RANGE_ROWS))
    order = [key, *ties, "_place"]
    ranged = df.withColumn("_place", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # counts the rows of a partition from 0
    ranged = materialize(ranged.withColumn("_range", F.spark_partition_id()).withColumn("_at", at).drop("_place"))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each range
    before = materialize(sizes.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")))
    return ranged.join(before, "_range").withColumn(name, (F.col("_at") + F.col("_before")).cast("long")).drop("_range", "_at", "_before")
