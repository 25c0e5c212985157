"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The characters of ``[\x20\x09-\x0D]``.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def named(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def carried(docs: DataFrame, carry: list[str] | None, results: list[str]) -> list[str]:
    """The caller's columns that an operator passes on: all by default, never one that a result column replaces."""
    taken = {r.lower() for r in results}
    return [c for c in (docs.columns if carry is None else carry) if c.lower() not in taken]


def whole(text_col: str) -> Column:
    """The text of a row; null counts as empty."""
    return F.coalesce(named(text_col).cast("string"), F.lit(""))


def fold_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else; the fast built-in serves texts of ASCII alone."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def hash128(*parts: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of the same values."""
    return F.xxhash64(*parts), F.xxhash64(F.lit(1), *parts)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run``, after which the worker gives freed memory back: it stays for later tasks, beside those of other stages."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return wrapped


def slices(batches: Iterator[pa.RecordBatch], most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded size, or of a single row where that is larger."""
    for batch in batches:
        rows = max(1, min(batch.num_rows, int(batch.num_rows * most_bytes / max(1, batch.nbytes))))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
