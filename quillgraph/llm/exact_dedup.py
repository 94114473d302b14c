"""Exact de-duplication with a heavy-hitter split (operator 10, DataFrame operations only).

Texts are equal when they are identical after deleting white space. Each text is
reduced once to (doc_id, SHA-256, length); the narrow table is written to the shared
folder. A Misra-Gries summary (Spark's mergeable frequent-items sketch) names digests
that may hold over one row in ``heavy_share``. Their exact counts and winners are then
verified by a partial aggregation and broadcast: at most ``heavy_share`` rows, whatever
the input. Rows of heavy digests meet their winner map-side; all others take an
ordinary shuffle on the digest: their winners are aggregated with partial sums first and
joined back, so no group is sorted or held in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, without_white

#: A digest is heavy if it may hold more than one row in this many; also the most winners that are broadcast.
HEAVY_SHARE = 1000
#: Counters of the Misra-Gries summary; its error is then far below one row in HEAVY_SHARE.
COUNTERS = 1 << 14
#: A group of fewer rows is never heavy.
HEAVY_LEAST = 64


def narrow(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest binary, n code points of the original text) of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(without_white(text), 256)).alias("digest"), F.length(text).cast("long").alias("n"))


def _best() -> Column:
    """The row that stays: most code points, then smallest doc_id (a null doc_id last)."""
    return F.min_by("doc_id", F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("absent"), F.col("doc_id").alias("id")))


def heavy_digests(rows: DataFrame, total: int, heavy_share: int = HEAVY_SHARE) -> DataFrame:
    """Digests whose estimated count passes the bar: at most ``heavy_share`` rows."""
    bar = max(HEAVY_LEAST, total // heavy_share)
    top = rows.agg(F.expr(f"approx_top_k(hex(digest), {heavy_share}, {COUNTERS})").alias("top"))
    return top.select(F.explode("top").alias("t")).where(F.col("t.count") > bar).select(F.unhex("t.item").alias("digest"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy_share: int = HEAVY_SHARE) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty, and all empty texts are one group. Repeated rows with one
    doc_id are counted each and share the decision; rows without doc_id stay only in a group
    where one of them has the most code points and no row with a doc_id has as many. An empty table gives no rows. Columns
    of the input other than the two named are not read, so their names cannot clash.
    """
    rows = cut(narrow(docs, id_col, text_col), "digests")
    heavy = heavy_digests(rows, rows.count(), heavy_share)
    winners = cut(rows.join(F.broadcast(heavy), "digest", "left_semi").groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), _best().alias("keep_id")), "winners")
    hot = rows.join(F.broadcast(winners), "digest")
    others = rows.join(F.broadcast(winners), "digest", "left_anti")
    cold = others.join(others.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), _best().alias("keep_id")), "digest")
    return hot.select(*cold.columns).unionByName(cold).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """Documents without exact copies: the row of each group that stays, with all its columns; of rows with equal doc_id in a group one."""
    stay = exact_groups(docs).where("kept").select("doc_id", "text_sha256").distinct()
    digest = F.lower(F.sha2(without_white(docs["text"]), 256))
    return docs.join(stay, (digest == stay["text_sha256"]) & docs["doc_id"].eqNullSafe(stay["doc_id"]), "left_semi")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents),
     w AS (SELECT doc_id, h, count(*) OVER (PARTITION BY h) AS group_size,
                  first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id FROM d)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM w
"""
