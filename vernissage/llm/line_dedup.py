"""Removal of lines that many documents share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vernissage.llm.common import SPACES, carried, fold_ascii, hash128, named, whole
from vernissage.session import materialize

RESULTS = ["n_lines", "n_dropped", "kept_text"]


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_keys(text: Column) -> Column:
    """The key of every line: stripped at both ends, A-Z lower-cased."""
    return F.transform(_lines(fold_ascii(text)), lambda line: F.btrim(line, F.lit(SPACES)))


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1,
    carry: list[str] | None = None,
) -> DataFrame:
    """Drop every line whose key stands in at least ``min_docs`` documents: the ``carry`` columns with ``RESULTS``.

    The distinct keys of each document are exploded as 128-bit hashes and counted with a combine before the shuffle. The
    frequent ones select the positions to drop, and each text is put together again from the other positions.

    Keys of fewer than ``min_chars`` code points are never dropped. A null or empty text is one empty line. Each row is a
    document; a row that repeats both identifier and text gets the same result. A document that loses all its lines
    keeps an empty text. An empty table gives an empty result. Columns named like a result column are replaced by it.
    """
    keep, text = carried(docs, carry, RESULTS), whole(text_col)
    row = F.struct(F.lit(0).alias("_"), *[named(c).alias(f"c{i}") for i, c in enumerate(keep)]).alias("row")
    one, two = hash128(named(id_col), text)
    docs = docs.select(row, text.alias("text"), one.alias("d1"), two.alias("d2"))
    line1, line2 = hash128(F.col("key"))
    hashes = [line1.alias("h1"), line2.alias("h2")]

    keys = docs.select(F.explode(F.array_distinct(line_keys(F.col("text")))).alias("key"))
    counts = keys.filter(F.char_length("key") >= min_chars).select(*hashes).groupBy("h1", "h2").agg(F.count("*").alias("n"))
    frequent = materialize(counts.filter(F.col("n") >= min_docs).select("h1", "h2"))

    places = docs.select("d1", "d2", F.posexplode(line_keys(F.col("text"))).alias("at", "key"))
    places = places.filter(F.char_length("key") >= min_chars).select("d1", "d2", "at", *hashes)
    drops = places.join(frequent, ["h1", "h2"], "left_semi").groupBy("d1", "d2").agg(F.collect_set("at").alias("drop"))

    lines = _lines(F.col("text"))
    rest = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "drop")
    kept = F.array_join(F.transform(rest, lambda at: F.get("lines", at)), "\n")
    return (
        docs.join(drops, ["d1", "d2"], "left")
        .withColumn("lines", lines)
        .select(
            *[F.col(f"row.c{i}").alias(c) for i, c in enumerate(keep)],
            F.size("lines").cast("long").alias("n_lines"),
            F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
            F.when(F.col("drop").isNull(), F.col("text")).otherwise(kept).alias("kept_text"),
        )
    )
