"""A corpus pipeline: five stages from the documents to packed token sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written and read again for the next one.

In every stage a null text counts as empty, and an empty table gives an empty result. Columns beside the five of
``documents`` are not passed on. Rows that repeat are judged each for itself by the language stage; the two stages after it
keep one row of them, and the last two treat what is left row by row, whatever its length.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from vernissage.llm.exact_dedup import exact_dedup
from vernissage.llm.language import fit_text_model, identify
from vernissage.llm.packing import pack
from vernissage.llm.simhash import drop_near_copies
from vernissage.llm.substring_dedup import drop_repeats
from vernissage.session import scratch_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; ``lang`` trains the text model, the source stands for the host."""
    found = identify(docs, fit_text_model(docs), F.col("text"), host=F.col("source"))
    return found.filter(~F.col("rejected")).select(COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup(docs).filter("kept").select(COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: fingerprints of four-word shingles, linked at four or fewer differing bits."""
    return drop_near_copies(docs, words=4, radius=4).select(COLUMNS)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that another document keeps."""
    return drop_repeats(docs, size_col="n_chars").select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every token in sequences of 4,096."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("substring_dedup", substring), ("packing", packing)]
#: Fingerprints, band keys and tokens are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = f"{scratch_dir(spark)}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
