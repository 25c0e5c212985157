"""Exact deduplication by content sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vernissage.llm.common import SPACES, carried, named, whole
from vernissage.session import materialize

RESULTS = ["keep_id", "group_size", "kept", "text_sha256"]
#: Bytes of the normalised text that lead the range key; the sort itself compares whole texts.
LEAD = 32


def without_spaces(text: Column) -> Column:
    """The text without any character of ``[\\x20\\x09-\\x0D]``."""
    for space in SPACES:
        text = F.replace(text, F.lit(space), F.lit(""))
    return text


def _better(size: Column, key: Column) -> Column:
    """Orders the rows of a group: longest first, then the smallest identifier, a null one last."""
    return F.struct((-size).alias("size"), key.isNull().alias("no_id"), key.alias("id"))


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, hot_rows: int = 500
) -> DataFrame:
    """Mark the copies among ``docs``: the ``carry`` columns (default all) with ``RESULTS``, one row per input row.

    Sampled splitters range-partition the rows by the first bytes of the normalised text and its hash; within a range an
    external sort by the whole normalised text places equals adjacent, and comparing neighbours forms the groups. Of a
    group the row with the most code points, then the smallest identifier, is kept.

    A group of over ``hot_rows`` rows is cut into parts by a hash of the identifier, so that it spreads over ranges; its
    totals come from a count that is combined before its shuffle. There is one such group for every ``hot_rows`` rows at
    most; they are a written table, which the planner broadcasts as long as its measured size allows.

    Null texts count as empty and equal each other. A null identifier sorts last. Of rows that repeat both the identifier
    and the length of the kept one, one is kept. An empty table gives an empty result. Columns of ``docs`` that have the
    name of a result column are replaced by it.
    """
    text, keep = whole(text_col), carried(docs, carry, RESULTS)
    rows = docs.select(
        F.struct(F.lit(0).alias("_"), *[named(c).alias(f"c{i}") for i, c in enumerate(keep)]).alias("row"),
        named(id_col).alias("id"), without_spaces(text).alias("norm"), F.char_length(text).alias("size"),
    ).withColumns({"lead": F.substring("norm", 1, LEAD), "hash": F.xxhash64("norm")})

    hot = rows.groupBy("hash").agg(F.count("*").alias("n")).filter(F.col("n") > hot_rows)
    hot = materialize(hot.select("hash", F.ceil(F.col("n") / hot_rows).cast("int").alias("parts")))
    totals, keys = None, ["lead", "hash"]
    if not hot.isEmpty():
        marked = rows.join(hot, "hash", "left")
        totals = materialize(
            marked.filter("parts is not null").groupBy("norm")
            .agg(F.min(_better(F.col("size"), F.col("id"))).alias("best"), F.count("*").alias("total"))
            .select(F.sha2("norm", 256).alias("digest"), "best", "total")
        )
        cut = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
        rows = marked.withColumn("part", F.coalesce(cut, F.lit(0))).drop("parts")
        keys.append("part")

    group = Window.partitionBy(*keys, "norm")
    order = group.orderBy(F.desc("size"), F.asc_nulls_last("id"))
    found = (
        rows.repartitionByRange(*keys)
        .select(
            "row", "id", "size", "norm", F.row_number().over(order).alias("rank"),
            F.first(_better(F.col("size"), F.col("id"))).over(order).alias("best"), F.count("*").over(group).alias("total"),
        )
        .withColumn("digest", F.sha2("norm", 256))
        .drop("norm")
    )
    if totals is not None:
        totals = totals.withColumnsRenamed({"best": "all_best", "total": "all_total"})
        found = found.join(totals, "digest", "left").withColumns(
            {"best": F.coalesce("all_best", "best"), "total": F.coalesce("all_total", "total")}
        )
    return found.select(
        *[F.col(f"row.c{i}").alias(c) for i, c in enumerate(keep)],
        F.col("best.id").alias("keep_id"), F.col("total").alias("group_size"),
        ((F.col("rank") == 1) & F.col("best").eqNullSafe(_better(F.col("size"), F.col("id")))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
