"""Full rebuild and incremental update of a stored dataset: metadata, assets and the vector index of the same items.

All three are written into folders of their own and become visible together, with one new version of the manifest.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from vernissage.operators.index import CellIndex, compact_postings, open_index, train_kmeans, write_append, write_index
from vernissage.operators.matching import authority_filter
from vernissage.operators.skew import SMALL_ROWS, first_n
from vernissage.schema import INGEST_THRESHOLD, META_SCHEMA
from vernissage.session import has_at_most, materialize
from vernissage.sources.assets import open_assets, write_assets
from vernissage.sources.catalog import standard_schema, to_metadata, visual_id, write_metadata
from vernissage.sources.manifest import Version, commit, current, fresh_folder, read_table, vacuum

#: From vectors (``id``, ``vec`` and whatever else they bring) to centroids.
Train = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class IngestConfig:
    """Limit on new rows (-1 for all) and the bar for a fuzzy artist match."""

    limit: int = 1000
    threshold: int = INGEST_THRESHOLD


@dataclass(frozen=True)
class Dataset:
    """One version of a stored dataset; ``index`` is None as long as no vector was stored."""

    metadata: DataFrame
    assets: DataFrame
    index: CellIndex | None
    version: Version


def open_dataset(spark: SparkSession, path: str, version: Version | None = None) -> Dataset:
    """The latest version of a dataset, or the given one; empty tables if there is none yet."""
    version = version or current(spark, path)
    return Dataset(
        read_table(spark, path, version, "metadata", META_SCHEMA), open_assets(spark, path, version),
        open_index(spark, path, version) if "postings" in version.tables else None, version,
    )


def new_items(
    catalog: DataFrame, authority: DataFrame, known: DataFrame | None, config: IngestConfig
) -> DataFrame:
    """Catalog items not in ``known`` (column ``id``) whose artist passes, up to the limit by ``idx``.

    Known ids are dropped before names are matched; the limit counts what is left.
    """
    items = catalog
    if known is not None:
        items = items.withColumn("_id", visual_id())
        seen = known.select(F.col("id").alias("_id"))
        if has_at_most(items, SMALL_ROWS):
            # a small delivery goes to the stored ids, so that these are scanned but not shuffled
            seen = seen.join(F.broadcast(items.select("_id")), "_id", "left_semi")
        items = items.join(seen.distinct(), "_id", "left_anti").drop("_id")
    return first_n(authority_filter(items, authority, config.threshold), config.limit, "idx")


def new_metadata(catalog: DataFrame, authority: DataFrame, known: DataFrame | None, config: IngestConfig) -> DataFrame:
    """Metadata rows of the new items."""
    return to_metadata(standard_schema(new_items(catalog, authority, known, config)))


def add_items(
    delta: DataFrame, path: str, before: Version, keep: bool, contents: DataFrame | None, vectors: DataFrame | None, train: Train,
    figures: dict[str, int] | None = None,
) -> Version:
    """Store metadata rows with the assets (``id``, ``content``) and vectors (``id``, ``vec``) of the same ids, and commit.

    With ``keep`` they join what the version ``before`` holds, else they take its place.
    """
    spark, tables = delta.sparkSession, {name: list(folders) for name, folders in before.tables.items()} if keep else {}
    folder, figures = fresh_folder("metadata"), dict(figures or {})
    write_metadata(delta, f"{path}/{folder}")
    tables["metadata"] = [*tables.get("metadata", []), folder]
    ids = delta.select("id").distinct()
    written = []
    if contents is not None:
        mine = contents.join(ids, "id", "left_semi")
        written.append(write_assets(mine, path, before if keep else Version()))
    if vectors is not None:
        mine = materialize(vectors.join(ids, "id", "left_semi"))
        if not mine.isEmpty():
            written.append(write_append(mine, path, before) if "postings" in tables else write_index(mine, path, train(mine)))
    for folders, counts in written:
        tables, figures = {**tables, **folders}, {**figures, **counts}
    return commit(spark, path, before, tables, figures)


def _trained(vectors: DataFrame) -> DataFrame:
    return train_kmeans(vectors, max(16, int(vectors.count() ** 0.5)))


def run_rebuild(
    catalog: DataFrame, authority: DataFrame, path: str, config: IngestConfig = IngestConfig(), contents: DataFrame | None = None,
    vectors: DataFrame | None = None, train: Train = _trained, purge: bool = True,
) -> DataFrame:
    """Replace the dataset; returns its metadata.

    The older version stays readable until the new one is committed, whole; then its files are removed, unless ``purge`` is
    off. A run that dies before that changes nothing.
    """
    spark, before = catalog.sparkSession, current(catalog.sparkSession, path)
    delta = materialize(new_metadata(catalog, authority, None, config))
    version = add_items(delta, path, before, False, contents, vectors, train)
    if purge:
        vacuum(spark, path)
    return open_dataset(spark, path, version).metadata


def run_incremental(
    catalog: DataFrame, authority: DataFrame, path: str, config: IngestConfig = IngestConfig(), contents: DataFrame | None = None,
    vectors: DataFrame | None = None, train: Train = _trained,
) -> tuple[DataFrame, int]:
    """Append unseen items; returns the metadata and the number added.

    Known ids come from the committed metadata, so a crashed run leaves no
    orphans to be skipped for ever. Nothing new means nothing is written.
    """
    spark, stored = catalog.sparkSession, open_dataset(catalog.sparkSession, path)
    delta = materialize(new_metadata(catalog, authority, stored.metadata, config))
    added = delta.count()
    version = add_items(delta, path, stored.version, True, contents, vectors, train) if added else stored.version
    return open_dataset(spark, path, version).metadata, added


def compact_dataset(spark: SparkSession, path: str) -> Version:
    """Write every table of a dataset anew, in one folder each, and remove the many that updates have left."""
    stored = open_dataset(spark, path)
    tables, figures, before = {}, {}, stored.version
    if "metadata" in before.tables:
        tables["metadata"] = [fresh_folder("metadata")]
        write_metadata(stored.metadata, f"{path}/{tables['metadata'][0]}")
    if "assets" in before.tables:
        written, figures = write_assets(stored.assets, path, Version())
        tables |= written
    if stored.index is not None:
        written, counts = compact_postings(stored.index, path)
        tables, figures = {**tables, "centroids": before.tables["centroids"], **written}, {**figures, **counts}
    version = commit(spark, path, before, tables, figures)
    vacuum(spark, path)
    return version
