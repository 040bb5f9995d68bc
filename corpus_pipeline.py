"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's documents.

A stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the columns
of ``documents``; extra columns are dropped. Null and empty texts pass as they are, but the repeat stage makes null texts
empty. Rows alike in id and text share their fate. The near-dup stage goes by id: rows that share one are one document and
stay or go together, and rows with a null id stay. The contamination stage goes by row, whatever its id.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstead.llm import decontaminate, near_dup, packing, quality, suffix_dedup
from loomstead.llm.runtime import ship, stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    ship(spark)
    trees = quality.learn(docs.select(F.col("doc_id").alias("id"), "text"), table(spark, sf_dir, "labels"))
    return quality.score(docs.select(*COLUMNS), trees, keep_text=True).where(F.col("quality_score") >= quality.KEEP_FROM).select(*COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest id: five-word shingles, similarity 0.8 or more."""
    gone = near_dup.near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that an earlier document has too are cut out, in whole characters; every document stays."""
    cut = suffix_dedup.repeated_bytes(docs, characters=True, carry=("lang", "source"))
    text = F.col("kept").cast("string")
    kind = docs.schema["n_chars"].dataType
    return cut.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), text.alias("text"), "lang", "source", F.length(text).cast(kind).alias("n_chars"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    rows = docs.select(*COLUMNS).withColumn("row", F.xxhash64("doc_id", "text"))
    gone = decontaminate.contained(rows, table(spark, sf_dir, "benchmark"), id_col="row").select("row").distinct()
    return rows.join(gone, "row", "left_anti").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents and their places in sequences of 2048 tokens."""
    return packing.pack(docs, TOKENIZER)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_dup", keep_one_of_each_group),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: A learned classifier and a tokenizer can't be expressed in SQL; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
