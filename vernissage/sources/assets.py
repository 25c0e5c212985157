"""Stored items by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vernissage.functions.perturb import hash_unit
from vernissage.sources.bucketed import MOST_BUCKETS, open_segments, write_segment
from vernissage.sources.manifest import Version, commit, current, fresh_folder

#: Bytes of a bucket of assets, the least number of them, and bytes of a row group.
BUCKET_BYTES, LEAST_BUCKETS, _GROUP_BYTES = 128 << 20, 16, 8 << 20
_STORED = "id string, content binary, bucket int"


def id_from_key(key: Column | str) -> Column:
    """``images/x.jpg`` -> ``x``."""
    key = F.col(key) if isinstance(key, str) else key
    return F.regexp_replace(F.substring_index(key, "/", -1), r"\.jpg$", "")


def known_ids(keys: DataFrame, column: str) -> DataFrame:
    """Distinct ids of asset keys."""
    return keys.select(id_from_key(column).alias("id")).distinct()


def list_asset_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids of the files in an asset folder; contents are not read."""
    return known_ids(spark.read.format("binaryFile").option("pathGlobFilter", "*.jpg").load(path).select("path"), "path")


def read_asset_files(spark: SparkSession, path: str) -> DataFrame:
    """(id, content) of the files in an asset folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jpg").load(path)
    return files.select(id_from_key("path").alias("id"), "content")


def _bucket(id_: Column, buckets: int) -> Column:
    return F.floor(hash_unit(0, "bucket", id_) * buckets).cast("int")


def write_assets(assets: DataFrame, path: str, version: Version) -> tuple[dict, dict]:
    """Write (id, content) rows for a version of the dataset at ``path`` without committing: the tables and figures.

    Rows lie in bucket files by id, as many as their bytes ask for (of ``BUCKET_BYTES``, ``LEAST_BUCKETS`` at least). They
    join the assets that the version has; these keep their buckets, until a compaction counts them anew.
    """
    before, buckets = version.tables.get("assets", []), version.figures.get("asset buckets")
    if before:
        folder = before[0].rpartition("/")[0]
    else:
        size = assets.agg(F.sum(F.octet_length("content"))).first()[0] or 0
        folder, buckets = fresh_folder("assets"), min(MOST_BUCKETS, max(LEAST_BUCKETS, -(-size // BUCKET_BYTES)))
    placed = assets.select("id", "content", _bucket(F.col("id"), buckets).alias("bucket"))
    segment = write_segment(placed, path, folder, _STORED, "id", buckets, _GROUP_BYTES)
    return {"assets": [*before, segment]}, {"asset buckets": buckets}


def open_assets(spark: SparkSession, path: str, version: Version) -> DataFrame:
    """The (id, content, bucket) rows of a version."""
    segments = version.tables.get("assets")
    if not segments:
        return spark.createDataFrame([], _STORED)
    return open_segments(spark, path, segments, _STORED, "id", version.figures["asset buckets"])


def store_assets(assets: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write (id, content) rows as a dataset of their own: in place of what it holds, or with ``append`` beside it."""
    before = current(assets.sparkSession, path)
    tables, figures = write_assets(assets, path, before if mode == "append" else Version())
    commit(assets.sparkSession, path, before, tables, figures)


def load_assets(spark: SparkSession, path: str) -> DataFrame:
    """The stored (id, content, bucket) rows."""
    return open_assets(spark, path, current(spark, path))


def fetch_assets(wanted: DataFrame, assets: DataFrame, few: int = 1_000) -> DataFrame:
    """Every wanted id with its content, null where nothing is stored.

    A short list of ids becomes a filter that picks buckets and row groups. A longer one is dealt into the buckets that the
    stored rows lie in, so these are neither moved nor sorted; each task holds the wanted ids of its bucket.
    """
    ids = wanted.select("id").filter("id is not null").distinct()
    stored = assets.select("id", "content")
    listed = [r["id"] for r in ids.limit(few + 1).collect()]
    if len(listed) <= few:
        found = ids.join(stored.filter(F.col("id").isin(listed)), "id", "left")
    else:
        found = stored.join(ids.hint("shuffle_hash"), "id", "right")
    nothing = wanted.filter("id is null").select("id").distinct().withColumn("content", F.lit(None).cast("binary"))
    return found.select("id", "content").unionByName(nothing)
