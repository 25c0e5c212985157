"""Catalog ingest as a file stream: same rows as the batch plans, restartable."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from vernissage.plans.ingest import IngestConfig, Train, add_items, new_metadata, open_dataset
from vernissage.session import materialize


def ingest_batch(
    items: DataFrame,
    batch_id: int,
    authority: DataFrame,
    path: str,
    config: IngestConfig = IngestConfig(limit=-1),
    vectors: DataFrame | None = None,
    centroids: DataFrame | None = None,
    run: str = "direct",
    contents: DataFrame | None = None,
) -> int:
    """Store the unseen items of one micro-batch; returns how many were added.

    ``run`` names the stream that counts the batches. A batch is one commit of metadata, assets (``contents``: ``id``,
    ``content``) and index (``vectors``: ``id``, ``vec``, with trained ``centroids``), which also notes the run's last
    batch: a batch that comes again after its commit is left alone, and one that died before it has left nothing to see.
    The limit counts rows over all batches.
    """
    stored = open_dataset(items.sparkSession, path)
    last, count = f"batch of {run}", f"rows of {run}"
    if stored.version.figures.get(last, -1) >= batch_id:
        return stored.version.figures[count] if stored.version.figures[last] == batch_id else 0
    left = config.limit
    if left >= 0:
        left = max(0, left - stored.metadata.count())
    fresh = items.dropDuplicates(["idx"])
    delta = materialize(new_metadata(fresh, authority, stored.metadata, IngestConfig(left, config.threshold)))
    added = delta.count()
    if added:
        train: Train = lambda _: centroids
        add_items(delta, path, stored.version, True, contents, vectors if centroids is not None else None, train, {last: batch_id, count: added})
    return added


def start_ingest(
    source: DataFrame,
    authority: DataFrame,
    path: str,
    checkpoint: str,
    config: IngestConfig = IngestConfig(limit=-1),
    vectors: DataFrame | None = None,
    centroids: DataFrame | None = None,
    contents: DataFrame | None = None,
) -> StreamingQuery:
    """Run everything the stream holds now and stop; call again to pick up what came later.

    ``source`` is a streaming frame of raw items; cap its batches with
    ``maxFilesPerTrigger`` or ``maxBytesPerTrigger``.
    """

    def on_batch(items: DataFrame, batch_id: int) -> None:
        # the checkpoint names the run: the same after a restart, another one with a new checkpoint
        run = json.loads(items.sparkSession.read.text(f"{checkpoint}/metadata").first()["value"])["id"]
        ingest_batch(items, batch_id, authority, path, config, vectors, centroids, run, contents)

    return (
        source.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def load_ingested(spark: SparkSession, path: str) -> DataFrame:
    """The metadata written so far."""
    return open_dataset(spark, path).metadata
