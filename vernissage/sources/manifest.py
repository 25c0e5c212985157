"""Versions of a stored dataset: what belongs to it is listed in one small record that is written last.

Tables are written into folders of their own first. A version names the folders of every table; readers take the
highest version, so they see all tables of a commit or none. A writer that dies before its commit leaves folders that no
version names; ``vacuum`` removes them. One writer at a time.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

_RECORD = "version bigint, tables map<string, array<string>>, figures map<string, bigint>"
_FOLDER = "versions"


@dataclass(frozen=True)
class Version:
    """The folders of each table, relative to the dataset's own, and named figures."""

    number: int = -1
    tables: dict[str, list[str]] = field(default_factory=dict)
    figures: dict[str, int] = field(default_factory=dict)


def read_if_there(spark: SparkSession, schema, path: str, nested: bool = False) -> DataFrame | None:
    """A Parquet table, or nothing if it has not been written yet; any other trouble is an error."""
    try:
        return spark.read.schema(schema).parquet(path, recursiveFileLookup=nested or None)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def current(spark: SparkSession, path: str) -> Version:
    """The latest version; an empty one with number -1 if nothing was committed."""
    listed = read_if_there(spark, _RECORD, f"{path}/{_FOLDER}", nested=True)
    last = None if listed is None else listed.orderBy(F.desc("version")).first()
    return Version() if last is None else Version(last["version"], last["tables"], last["figures"])


def fresh_folder(table: str) -> str:
    """A folder name for a table that no other commit uses."""
    return f"{table}-{uuid.uuid4().hex}"


def commit(spark: SparkSession, path: str, before: Version, tables: dict[str, list[str]], figures: dict[str, int] | None = None) -> Version:
    """Switch to a version with these tables; fails if another writer has committed since ``before`` was read."""
    if current(spark, path).number != before.number:
        raise RuntimeError(f"{path} has changed since version {before.number} was read")
    after = Version(before.number + 1, tables, {**before.figures, **(figures or {})})
    record = spark.createDataFrame([(after.number, after.tables, after.figures)], _RECORD).coalesce(1)
    # half of a record that a crash has left has no rows, and is replaced here
    record.write.mode("overwrite").parquet(f"{path}/{_FOLDER}/{after.number:012d}")
    return after


def read_table(spark: SparkSession, path: str, version: Version, table: str, schema) -> DataFrame:
    """The rows of a table in a version; none if the version has no such table."""
    folders = [f"{path}/{folder}" for folder in version.tables.get(table, [])]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Remove what commits have written below ``path`` and the current version does not name; the folders removed.

    Only folders with names of ``fresh_folder``, segments in them, and records of older versions are looked at.
    """
    version, gone = current(spark, path), []
    named = {folder for folders in version.tables.values() for folder in folders}
    keep = named | {folder.split("/")[0] for folder in named}
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def sweep(folder: str, ours: str, kept: set[str]) -> None:
        for status in files.listStatus(hadoop(f"{path}/{folder}")):
            name = status.getPath().getName()
            inside = f"{folder}/{name}".lstrip("/")
            if re.fullmatch(ours, name) and inside not in kept:
                files.delete(status.getPath(), True)
                gone.append(inside)

    sweep("", r"[a-z]+-[0-9a-f]{32}", keep)
    for table in {folder.split("/")[0] for folder in named if "/" in folder}:
        sweep(table, r"segment=segment-[0-9a-f]{32}", named)
    sweep(_FOLDER, r"\d{12}", {f"{_FOLDER}/{version.number:012d}"})
    return gone
