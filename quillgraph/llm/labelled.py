"""Bounded samples of labelled documents and the fold that is held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """True where crc32(doc_id as text) mod 5 is 0; a null doc_id is held out too."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int, longest: int) -> DataFrame:
    """doc_id, text, y of at most ``most`` labelled rows of each class outside the held-out fold, in an order fixed by a hash.

    The ids are chosen from the labels alone, so at most 2 * most of them are broadcast.
    Texts of over ``longest`` characters are not trained on (all texts are scored).
    """
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", F.col(label).cast("int").alias("y")).groupBy("doc_id").agg(F.max("y").alias("y"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("y = 1").orderBy(*order).limit(most).unionByName(known.where("y = 0").orderBy(*order).limit(most))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") <= longest)
    return texts.join(F.broadcast(chosen), "doc_id")
