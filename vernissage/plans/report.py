"""Catalog diagnostics and the ranked artist table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def diagnostics(metadata: DataFrame) -> DataFrame:
    """One row: paintings and distinct artists (missing artists are not counted)."""
    per_artist = metadata.groupBy("artist").agg(F.count("*").alias("n"))
    return per_artist.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("paintings"), F.count("artist").alias("artists")
    )


def top_artists(metadata: DataFrame, n: int | None = 100) -> DataFrame:
    """Artists by number of paintings with their rank, names in order on ties; 0 or None gives no rows."""
    counts = metadata.filter(F.col("artist").isNotNull()).groupBy("artist").agg(F.count("*").alias("paintings"))
    top = counts.orderBy(F.desc("paintings"), "artist").limit(n or 0)
    # the window sees at most n rows
    place = F.row_number().over(Window.orderBy(F.desc("paintings"), "artist"))
    return top.select(place.alias("rank"), "artist", "paintings")
