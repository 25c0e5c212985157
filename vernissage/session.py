"""Session settings and the shared scratch area for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "vernissage", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew-join splitting and Arrow switched on.

    Partition counts and memory are left to the cluster; pass them as ``conf``
    (dots written as double underscores) when they must be fixed, as tests do.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder under the shared one the cluster names in ``spark.checkpoint.dir``.

    A machine-local folder is used only for a local master; on a cluster the
    setting is required, because executors must see what other executors wrote.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        root = tempfile.mkdtemp(prefix="vernissage-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to a scratch table and read it back.

    Cuts lineage in a way that survives the loss of executors, computes the
    input once however often it is used, and gives the planner measured sizes,
    so a later broadcast is chosen only below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def has_at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has no more than ``rows`` rows: a plain count, which no single task has to gather."""
    return df.count() <= rows


def wide(df: DataFrame, *keys: str) -> DataFrame:
    """Spread ``df`` by ``keys`` over all cores before work that is heavy for its number of bytes.

    A fixed number of partitions keeps adaptive execution from merging them again:
    one per core for a small input, else at least as many as a shuffle has.
    """
    spark = df.sparkSession
    parts = spark.sparkContext.defaultParallelism
    if not has_at_most(df, 1_000_000):
        parts = max(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts, *keys)
