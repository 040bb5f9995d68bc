"""Labelled documents for the two scorers: folds by id, and a bounded sample to learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A scorer learns from at most so many labelled documents, those with the smallest hash of their id.
LEARN_FROM = 20_000


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves remainder 0 by 5; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn_from(docs: DataFrame, labels: DataFrame, label: str, most: int = LEARN_FROM) -> DataFrame:
    """(id, text, label) of at most about ``most`` labelled documents that are not held out.

    Null labels and ids are left out; where an id has several labels the larger holds. The sampled ids are at most
    ``most`` numbers, so they are broadcast.
    """
    picked = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("label")).where("id IS NOT NULL AND label IS NOT NULL")
    picked = picked.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(most)
    return docs.select("id", "text").join(F.broadcast(picked), "id")
