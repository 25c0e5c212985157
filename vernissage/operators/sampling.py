"""Reproducible samples and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vernissage.operators.skew import SMALL_ROWS, first_n, with_ordinal


def _digest(seed: int, key: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))


def sample_n(df: DataFrame, n: int, seed: int = 42, key: str = "id") -> DataFrame:
    """``min(n, rows)`` rows without replacement, in the order of a keyed hash; -1 keeps all.

    Rows without a key are left out first. The same rows come back whatever the
    partitioning.
    """
    valid = df.filter(F.col(key).isNotNull())
    if n is None or n < 0:
        return valid
    digest = _digest(seed, F.col(key))
    lead = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    marked = valid.withColumn("_lead", lead).withColumn("_digest", digest)
    return first_n(marked, n, "_lead", "_digest", key).drop("_lead", "_digest")


def sample_rank(df: DataFrame, n: int, seed: int = 42, key: str = "id") -> DataFrame:
    """A sample with its 1-based ``rank`` in the order of the hash."""
    digest = _digest(seed, F.col(key))
    drawn = (
        sample_n(df, n, seed, key)
        .withColumn("_lead", F.conv(F.substring(digest, 1, 8), 16, 10).cast("double"))
        .withColumn("_digest", digest)
    )
    if n is not None and 0 <= n <= SMALL_ROWS:
        # the window sees only the sampled rows
        ranked = drawn.withColumn("rank", F.row_number().over(Window.orderBy("_digest", key)).cast("long"))
    else:
        ranked = with_ordinal(drawn, "_lead", "_digest", key, name="rank").withColumn("rank", F.col("rank") + 1)
    return ranked.drop("_lead", "_digest")


def take(df: DataFrame, n: int, key: str, *ties: str) -> DataFrame:
    """The first ``n`` rows by numeric ``key`` (then ``ties``); -1 means all."""
    return first_n(df, n, key, *ties)
