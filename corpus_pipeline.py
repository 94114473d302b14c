"""The corpus pipeline: toxicity, exact and near de-duplication, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and
returns the columns of documents; the last returns pieces of packed sequences. Stages
are cut by Parquet tables in the shared folder.

In every stage a null text counts as empty, repeated rows are rows each (exact
de-duplication leaves one of them), rows without doc_id are never linked to others by
near-duplicate links, further columns are carried along unread whatever their names, and
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from quillgraph.llm.common import cut, table

#: SQL can express neither the toxicity model nor sketches nor packing; tests hold each stage against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores below the toxicity threshold, empty texts among them."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows whose texts are equal but for white space, the one with the most code points, then the smallest doc_id."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id; texts without words stay."""
    return near_dedup.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, in training order (a text without words once for each whole pass of its source); what a down-sampled source does not give goes."""
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a packed sequence; each copy of a row is packed on its own."""
    return packing.pack_instructions(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each on what its predecessor wrote."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
