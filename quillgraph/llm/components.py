"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each neighbour above u joins the smallest of u and its neighbours."""
    around = _both(edges)
    low = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return around.join(low, "u").where("v > u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its lower neighbours join the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    lower = down.join(low, "u").select("v", "m").where("v <> m").unionByName(low.select(F.col("u").alias("v"), "m"))
    return lower.select(F.col("m").alias("u"), "v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links -> (id, component): each linked id with the smallest id that it reaches. Ids without a link have no row.

    The result reads a written table, so discard() may delete it. Every step is a shuffle of the edge table and cut by a written table; a hub's edges are
    pre-aggregated by min before the shuffle, and the joins on hubs are split by AQE.
    """
    now = cut(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        last, now = now, cut(_small_star(_large_star(now)), "stars")
        discard(last)
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("u").cast("decimal(38,0)"))).head()
        if state == seen:
            found = now.select(F.col("v").alias("id"), F.col("u").alias("component"))
            found._cut_at = now._cut_at
            return found
        seen = state
