"""Exact percentiles without holding a group's values in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from vernissage.session import materialize

ACCURACY = 10_000


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join on ``keys`` in which null equals null; the keys are those of ``left``."""
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(other, same, how).drop(*[f"_r_{k}" for k in keys])


def exact_percentile(df: DataFrame, by: list[str], value: str, q: float, name: str) -> DataFrame:
    """Linear-interpolation percentile of ``value`` per group, one row per group.

    A quantile sketch brackets the answer. The brackets, one row per group, go to the rows, which are then counted in one
    pass: those below a bracket as one number, those inside (about ``4 / accuracy`` of a group) by value. Only these
    counts are shuffled, equal values added up before. Groups of up to ``ACCURACY`` rows are inside as a whole.
    """
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    margin = 2.0 / ACCURACY  # twice the sketch's error, so the bracket also covers the next rank
    low = F.percentile_approx("_v", max(0.0, q - margin), ACCURACY)
    high = F.percentile_approx("_v", min(1.0, q + margin), ACCURACY)
    whole = (F.count("*") <= ACCURACY)
    bounds = materialize(rows.groupBy(*by).agg(
        F.count("*").alias("_n"),
        F.when(whole | F.lit(q <= margin), F.min("_v")).otherwise(low).alias("_lo"),
        F.when(whole | F.lit(q >= 1 - margin), F.max("_v")).otherwise(high).alias("_hi"),
    ))
    near = null_safe_join(rows, bounds, by, "inner").filter("_v <= _hi")
    inside = F.when(F.col("_v") >= F.col("_lo"), F.col("_v"))  # null stands for all that lies below
    counted = materialize(near.groupBy(*by, inside.alias("_v"), "_n").agg(F.count("*").alias("_c")))
    ordered = Window.partitionBy(*by).orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = counted.withColumn("_to", F.sum("_c").over(ordered)).filter("_v is not null")
    # _to = number of values up to and including this one: rank r (from 0) is the first with _to > r
    at = F.lit(q) * (F.col("_n").cast("double") - 1)
    first = F.min(F.when(F.col("_to") > F.floor(at), F.col("_v")))
    second = F.min(F.when(F.col("_to") > F.ceil(at), F.col("_v")))
    return running.groupBy(*by).agg((first + (second - first) * F.max(at - F.floor(at))).alias(name))
