"""Catalog items and the metadata table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vernissage.functions.text import or_default
from vernissage.schema import META_SCHEMA, RAW_SCHEMA, SOURCE, SOURCE_URL, UNKNOWN_TITLE
from vernissage.sources.manifest import read_if_there


def open_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Raw items from Parquet, with their position in ``idx``."""
    return spark.read.schema(RAW_SCHEMA).parquet(path)


def visual_id(idx: Column | str = "idx") -> Column:
    """The id of the item at a position."""
    return F.concat(F.lit(f"{SOURCE}_"), (F.col(idx) if isinstance(idx, str) else idx).cast("string"))


def standard_schema(items: DataFrame) -> DataFrame:
    """Items (with ``canonical``) as standard records; an ``image`` column is carried along."""
    record = [
        visual_id().alias("visual_id"),
        or_default("title", UNKNOWN_TITLE).alias("title"),
        F.col("canonical").alias("artist"),
        or_default("genre", "").alias("genre"),
        or_default("style", "").alias("style"),
        or_default("date", "").alias("date"),
        F.concat(visual_id(), F.lit(".jpg")).alias("filename"),
        F.concat(F.lit(f"hf://{SOURCE}/"), F.col("idx").cast("string")).alias("ImageURL"),
        F.lit(SOURCE_URL).alias("SourceURL"),
        F.lit(SOURCE).alias("Source"),
    ]
    return items.select(*record, *[c for c in ("image",) if c in items.columns])


def to_metadata(records: DataFrame) -> DataFrame:
    """Standard records as metadata rows."""
    renamed = {"id": "visual_id", "url": "SourceURL"}
    return records.select(
        *[F.coalesce(F.col(renamed.get(f.name, f.name)), F.lit("")).alias(f.name) for f in META_SCHEMA]
    )


def load_metadata(spark: SparkSession, path: str) -> DataFrame:
    """The metadata table; empty if there is none yet. A folder that cannot be read is an error."""
    rows = read_if_there(spark, META_SCHEMA, path)
    return spark.createDataFrame([], META_SCHEMA) if rows is None else rows.select(META_SCHEMA.names)


def write_metadata(metadata: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write metadata rows in the fixed column order."""
    metadata.select(META_SCHEMA.names).write.mode(mode).parquet(path)
