"""The authority list: loading, ranking and writing."""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from vernissage.schema import AUTHORITY_SCHEMA

log = logging.getLogger(__name__)


def load_authority(spark: SparkSession, path: str) -> DataFrame:
    """Distinct names of a JSON array; empty, with a warning, if the file is absent.

    A file that holds anything but an array of texts is an error: an empty list
    would let every artist pass.
    """
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        log.warning("no authority list at %s: every artist passes", path)
        return spark.createDataFrame([], AUTHORITY_SCHEMA)
    names = F.from_json("value", "array<string>", {"mode": "FAILFAST"})
    broken = F.raise_error(F.lit(f"no JSON array of names in {path}")).cast("array<string>")
    return text.select(F.explode(F.coalesce(names, broken)).alias("name")).distinct()


def top_names(ranked: DataFrame, n: int = 1000) -> DataFrame:
    """Names of the ``n`` rows with the highest ``weight``, blank and unlabelled ones dropped after.

    Equal weights go to the lowest ``key``. A label starting with ``Q`` is a bare
    entity number.
    """
    top = ranked.orderBy(F.desc("weight"), "key").limit(n)
    return top.filter((F.col("name") != "") & ~F.col("name").startswith("Q"))


def authority_json(names: DataFrame) -> DataFrame:
    """The names as one sorted JSON array (column ``value``).

    A JSON array is one value: the list is as long as the caller's limit on it.
    """
    return names.agg(F.to_json(F.array_sort(F.collect_list("name"))).alias("value"))


def write_authority(names: DataFrame, path: str) -> None:
    """Write the names as one sorted JSON array."""
    authority_json(names).coalesce(1).write.mode("overwrite").text(path)
