"""Joining hits to their records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vernissage.operators.skew import SMALL_ROWS, skewed_join
from vernissage.schema import RESULT_COLUMNS, UNKNOWN_ARTIST, UNKNOWN_ID, UNKNOWN_LABEL
from vernissage.session import has_at_most, materialize


def dedupe_last(df: DataFrame, key: str = "id", order: str = "ord") -> DataFrame:
    """The row with the highest ``order`` per key, by one aggregation that combines before its shuffle."""
    columns = df.columns
    last = F.max_by(F.struct(*columns), F.col(order)).alias("last")
    return df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(last).select("last.*")


def find_matches(hits: DataFrame, metadata: DataFrame, order: str = "ord", latency: Column | None = None) -> DataFrame:
    """Search results: one row per hit (``qid, label, confidence, fallback_used``) with its record.

    A hit is unknown if its label is ``Unknown`` or has no record; its confidence
    is then 0 and its fallback flag false. The last duplicate of an id wins. Only
    records of returned labels are looked at, and a label returned by very many
    queries is spread over several tasks.
    """
    stored = materialize(hits)
    asked = stored.filter(F.col("label") != UNKNOWN_LABEL).select(F.col("label").alias("id")).distinct()
    columns = ["id", "title", "artist", "url", "genre", "style", "date"]
    records = dedupe_last(metadata.select(*columns, order).join(asked, "id", "left_semi"), order=order).select(
        F.col("id").alias("label"), *columns[1:], F.lit(True).alias("_found")
    )
    if has_at_most(stored, SMALL_ROWS):  # then there are no more records than that either
        joined = stored.join(records, "label", "left")
    else:
        joined = skewed_join(stored, materialize(records), "label", F.col("qid"), how="left")
    known = F.coalesce(F.col("_found"), F.lit(False))

    def pick(column: str, unknown: str) -> Column:
        return F.when(known, F.coalesce(F.col(column), F.lit(""))).otherwise(F.lit(unknown))

    out = {
        "artwork_id": pick("label", UNKNOWN_ID),
        "title": pick("title", UNKNOWN_ARTIST),
        "artist": pick("artist", UNKNOWN_ARTIST),
        "source_url": pick("url", ""),
        "confidence": F.when(known, F.col("confidence")).otherwise(F.lit(0.0)),
        "latency_ms": (F.lit(None) if latency is None else latency).cast("double"),
        "fallback_triggered": known & F.col("fallback_used"),
        "genre": pick("genre", ""),
        "style": pick("style", ""),
        "date": pick("date", ""),
    }
    return joined.select("qid", *[out[c].alias(c) for c in RESULT_COLUMNS])


def resolve_returned(detail: DataFrame, sample: DataFrame, store: DataFrame) -> DataFrame:
    """Content of the item each query returned, with where it came from.

    ``detail`` has ``id`` and ``label``; ``sample`` and ``store`` have ``id`` and
    ``content``. Own content for a right answer, then the sample, then the store,
    else own content again. ``Unknown`` is never looked up and every other label
    is fetched from the store once.
    """
    rows = materialize(detail.select("id", "label"))
    own = sample.select("id", F.col("content").alias("_own"))
    seen = sample.select(F.col("id").alias("label"), F.col("content").alias("_sampled"))
    wanted = rows.filter((F.col("label") != UNKNOWN_LABEL) & (F.col("label") != F.col("id"))).select("label").distinct()
    wanted = wanted.join(sample.select(F.col("id").alias("label")), "label", "left_anti")
    fetched = store.select(F.col("id").alias("label"), F.col("content").alias("_fetched")).join(wanted, "label", "left_semi")
    joined = rows.join(own, "id", "left")
    if has_at_most(rows, SMALL_ROWS):
        joined = joined.join(seen, "label", "left").join(fetched, "label", "left")
    else:
        joined = skewed_join(joined, materialize(seen), "label", F.col("id"), how="left")
        joined = skewed_join(joined, materialize(fetched), "label", F.col("id"), how="left")
    same = F.col("label") == F.col("id")
    origin = (
        F.when(same, "same")
        .when(F.col("_sampled").isNotNull(), "sample")
        .when(F.col("_fetched").isNotNull(), "store")
        .otherwise("original")
    )
    content = F.when(same, F.col("_own")).otherwise(F.coalesce("_sampled", "_fetched", "_own"))
    return joined.select("id", "label", origin.alias("origin"), content.alias("content"))
