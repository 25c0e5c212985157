"""Tables whose rows lie in bucket files by a key, so that joins by that key move the other side alone.

A table is a folder of segments, one for each write. Which of them count is up to the caller's manifest: readers name the
segments, so one that a crash has left half written is never seen.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from vernissage.sources.manifest import fresh_folder

#: Buckets of one table that Spark allows unless told otherwise; beyond that they grow instead.
MOST_BUCKETS = 100_000


def _define(spark: SparkSession, name: str, folder: str, schema: str, key: str, buckets: int) -> None:
    """An external table over a folder, with no segment in it yet."""
    folder = folder.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({schema}, segment string) USING parquet PARTITIONED BY (segment)"
        f" CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{folder}'"
    )


def _name(*parts: object) -> str:
    return "segments_" + hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


def write_segment(rows: DataFrame, path: str, folder: str, schema: str, key: str, buckets: int, group_bytes: int) -> str:
    """Write rows as a new segment of the table in ``folder`` below ``path``, a file for each bucket; the segment's folder.

    Files are sorted by the key, with row groups of about ``group_bytes``, so that a lookup of few keys skips most of them.
    """
    spark, segment = rows.sparkSession, fresh_folder("segment")
    name = _name(path, segment)
    _define(spark, name, f"{path}/{folder}", schema, key, buckets)
    columns = [column.split()[0] for column in schema.split(", ")]
    (
        rows.select(*columns, F.lit(segment).alias("segment")).repartition(buckets, key).write.mode("append").format("parquet")
        .option("parquet.block.size", group_bytes).partitionBy("segment").bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    )
    spark.sql(f"DROP TABLE {name}")  # the files stay
    return f"{folder}/segment={segment}"


def open_segments(spark: SparkSession, path: str, segments: list[str], schema: str, key: str, buckets: int) -> DataFrame:
    """The rows of the given segments, all of one table, as they lie in their buckets."""
    name = _name(path, *segments)
    _define(spark, name, f"{path}/{segments[0].rpartition('/')[0]}", schema, key, buckets)
    parts = " ".join(f"PARTITION (segment = '{s.rpartition('=')[2]}')" for s in segments)
    spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS {parts}")
    return spark.table(name).drop("segment")
