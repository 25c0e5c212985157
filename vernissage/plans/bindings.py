"""The library's inputs, derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vernissage.functions.text import title_case
from vernissage.sources.catalog import standard_schema, to_metadata, visual_id


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Raw catalog items from ``part``; artists are written in eight different ways."""
    first, second = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    name = F.col("p_name")
    r = F.col("p_partkey") % 8
    artist = (
        F.when(r == 0, name)
        .when(r == 1, F.concat(second, F.lit(", "), first))
        .when(r == 2, F.concat(F.upper(name), F.lit(" ("), F.col("p_size").cast("string"), F.lit(")")))
        .when(r == 3, F.concat(first, F.lit("-"), second))
        .when(r == 4, F.concat(F.substring(name, 1, 2), F.expr("substring(p_name, 4)")))
        .when(r == 5, F.translate(name, "aeo", "áéö"))
        .when(r == 7, F.concat(F.lit("The "), F.col("p_brand")))
    )
    title = (
        F.when(F.col("p_partkey") % 5 == 0, F.lit(None).cast("string"))
        .when(F.col("p_partkey") % 7 == 0, F.lit(""))
        .otherwise(F.concat("p_type", F.lit(" "), "p_name"))
    )
    date = F.when(F.col("p_partkey") % 11 != 0, (F.col("p_size") + 1900).cast("string"))
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("idx"), title.alias("title"), artist.alias("artist"), date.alias("date"),
        F.col("p_type").alias("genre"), F.col("p_brand").alias("style"),
    )


def authority(spark: SparkSession, sf: str) -> DataFrame:
    """About eleven sixteenths of the distinct part names, so that misses exist."""
    names = table(spark, sf, "part").select(F.col("p_name").alias("name")).distinct()
    return names.filter(F.md5("name") < "b")


def earlier_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids an earlier run has stored: every item of one genre."""
    return catalog(spark, sf).filter(F.col("genre") == "ECONOMY").select(visual_id().alias("id"))


def metadata_history(spark: SparkSession, sf: str) -> DataFrame:
    """Metadata rows in the order they were written (``ord``).

    Items without an artist never got a row; larger ones were written again
    later with a new date.
    """
    items = catalog(spark, sf).filter(F.col("artist").isNotNull()).withColumn("canonical", title_case("artist"))
    size = table(spark, sf, "part").select(F.col("p_partkey").alias("idx"), "p_size")
    first = to_metadata(standard_schema(items)).withColumn(
        "ord", 2 * F.expr("cast(substring_index(id, '_', -1) as bigint)")
    )
    big = size.filter("p_size > 25").select(visual_id().alias("id"))
    again = first.join(big, "id", "left_semi").withColumn("date", F.lit("2000")).withColumn("ord", F.col("ord") + 1)
    return first.unionByName(again)


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Stored vectors with the ids of the catalog items."""
    return table(spark, sf, "embeddings").select(
        visual_id("vec_id").alias("id"), F.col("vec_id").alias("ord"),
        F.col("embedding").cast("array<double>").alias("vec"), "label",
    )


def latencies(spark: SparkSession, sf: str) -> DataFrame:
    """A stored measure standing in for query latency, by item id."""
    return table(spark, sf, "events").select(visual_id("event_id").alias("id"), F.col("value").alias("latency_ms"))


def document_assets(spark: SparkSession, sf: str) -> DataFrame:
    """Whole document texts as binary assets."""
    return table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.encode("text", "UTF-8").alias("content")
    )


def item_contents(spark: SparkSession, sf: str) -> DataFrame:
    """Whole document texts as the assets of the catalog items of the same number."""
    return table(spark, sf, "documents").select(visual_id("doc_id").alias("id"), F.encode("text", "UTF-8").alias("content"))


def turn_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Every turn of a conversation with the next one."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return turns.join(after, ["conv_id", "turn"])
