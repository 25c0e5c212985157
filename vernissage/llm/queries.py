"""The registered queries ``opN_<name>``: each operator over its whole table, reduced to the columns that are compared."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from vernissage.llm.byte_bpe import encode
from vernissage.llm.collocations import collocations
from vernissage.llm.common import table
from vernissage.llm.exact_dedup import exact_dedup
from vernissage.llm.group_packing import pack_groups
from vernissage.llm.hard_negatives import hard_negatives
from vernissage.llm.language import fit_text_model, identify, page_parts
from vernissage.llm.licences import fit_licences, scan_licences
from vernissage.llm.line_dedup import line_dedup
from vernissage.llm.neighbours import nearest_neighbours
from vernissage.llm.packing import pack
from vernissage.llm.simhash import simhash_groups
from vernissage.llm.substring_dedup import repeated_passages
from vernissage.llm.toxicity import fit_toxicity, score_toxicity


def op1_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup(table(spark, sf, "documents"), carry=["doc_id"])


def op2_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return pack(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = encode(table(spark, sf, "documents"), ranks, public_tokenizers.PATTERN, with_text=True)
    return found.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return repeated_passages(table(spark, sf, "documents"))


def op5_nearest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    return nearest_neighbours(rows, rows.filter(F.col("vec_id") % 50 == 0))


def op6_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs, held_out = table(spark, sf, "documents"), F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = fit_toxicity(docs, table(spark, sf, "labels").filter(~held_out))
    return score_toxicity(docs, model, carry=["doc_id"]).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = line_dedup(table(spark, sf, "documents"), carry=["doc_id"])
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_simhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return simhash_groups(table(spark, sf, "documents"))


def op9_licence_scan(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    found = scan_licences(docs, fit_licences(docs), carry=["doc_id"])
    return found.select("doc_id", "n_paragraphs", F.array_join("licences", ",").alias("licences"))


def op10_language_id(spark: SparkSession, sf: str) -> DataFrame:
    """Documents, whose source stands for the host, and pages; the other identifier is null in either."""
    docs, pages = table(spark, sf, "documents"), table(spark, sf, "pages")
    train = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    model = fit_text_model(docs.filter(train))
    found = identify(docs, model, F.col("text"), host=F.col("source"), carry=["doc_id"])
    parts = page_parts(F.col("html"), F.col("url"))
    web = identify(pages, model, carry=["page_id"], **parts)
    columns = ["doc_id", "page_id", "language", "confidence", "rejected"]
    nothing = F.lit(None).cast("bigint")
    return found.withColumn("page_id", nothing).select(columns).unionByName(web.withColumn("doc_id", nothing).select(columns))


def op11_first_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return pack_groups(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", shifted), F.col("vec_id") % 100 == 0)


def op13_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations(table(spark, sf, "documents"))


QUERIES = [
    op1_exact_dedup, op2_best_fit_packing, op3_byte_bpe, op4_substring_dedup, op5_nearest_neighbours, op6_toxicity,
    op7_line_dedup, op8_simhash_near_dedup, op9_licence_scan, op10_language_id,
    op11_first_fit_packing, op12_hard_negatives, op13_collocations,
]
REGISTRY = {f.__name__: f for f in QUERIES}
