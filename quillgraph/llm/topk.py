"""Exact top-k inner-product search by term-at-a-time accumulation (operator 3).

Vectors are quantised to integers and read as sparse rows: a component is a term, its
non-zero weights are a posting list. Rows and queries are dealt into blocks of bounded
size. For a pair of blocks, each term's postings are scattered, weighted by the queries'
own weights, into a dense score array (rows x queries), and the k best of each query are
selected by partition.

Queries go round by round: a round holds as many query blocks as fit ``ROUND_BYTES`` and
is sent to all tasks; each task keeps the k best of every query of the round while it runs
through its row blocks, and only these meet in a merge. Rows stay where they are, in a
number of partitions that depends on the cluster and not on the table, so what is
shuffled grows with the queries alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, discard, table, workers_see_us

K = 5
SCALE = 256.0
#: Rows of a block, and queries of a block: a score array has at most ROWS * QUERIES cells.
ROWS = 4096
QUERIES = 256
#: Bytes of the query blocks of one round, which are collected and broadcast (one block may be larger).
ROUND_BYTES = 32 << 20
#: Row partitions for each core of the cluster.
SPREAD = 4
#: Selected rows that a task gathers before it merges them.
_HELD = 1 << 18
_LONG = 1 << 62
BLOCK_SCHEMA = "block long, ids array<long>, lengths array<int>, cells binary, exact array<string>"
_BLOCK = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("cells", pa.binary()), ("exact", pa.list_(pa.string()))])


def quantised(ids: pa.Array, vectors: pa.Array, scale: float = SCALE) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ids and floor(scale * x) of the vectors that take part: neither null nor holding a null or non-finite component."""
    lengths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    x = np.floor(vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) * scale)
    at = np.concatenate([[0], np.cumsum(lengths)])
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    takes_part = (bad[at[1:]] == bad[at[:-1]]) & vectors.is_valid().to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False)
    wide = bool((np.abs(x[np.isfinite(x)]) >= _LONG).any())
    cells = x if wide else np.where(np.isfinite(x), x, 0).astype(np.int64)
    own = [cells[at[i] : at[i + 1]] for i in np.flatnonzero(takes_part)]
    if wide:
        own = [v.astype(np.int64) if not v.size or np.abs(v).max() < _LONG else np.array([int(c) for c in v], dtype=object) for v in own]
    return ids.fill_null(0).to_numpy(zero_copy_only=False)[takes_part], own


def _blocks(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        count = TaskContext.get().partitionId() << 32
        ids: list[int] = []
        vectors: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            wide = any(v.dtype == object for v in vectors)
            cells = b"" if wide else np.concatenate(vectors).astype("<i8").tobytes()
            exact = [str(x) for v in vectors for x in v] if wide else None
            return pa.RecordBatch.from_pylist([{"block": count, "ids": ids, "lengths": [len(v) for v in vectors], "cells": cells, "exact": exact}], schema=_BLOCK)

        for batch in batches:
            keys, own = quantised(batch.column(0), batch.column(1))
            for key, vector in zip(keys.tolist(), own):
                ids.append(key)
                vectors.append(vector)
                if len(ids) == most:
                    yield out()
                    count, ids, vectors = count + 1, [], []
        if ids:
            yield out()

    return run


def _sparse(lengths, cells, exact) -> list[np.ndarray]:
    flat = np.frombuffer(cells, "<i8") if exact is None else np.array([int(x) for x in exact], dtype=object)
    return np.split(flat, np.cumsum(lengths)[:-1])


def postings(vectors: list[np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Term -> rows that hold it, and their weights."""
    lengths = {len(v) for v in vectors}
    if len(lengths) == 1 and vectors[0].dtype != object:
        m = np.stack(vectors)
        return {d: (at, m[at, d]) for d in range(m.shape[1]) if len(at := np.flatnonzero(m[:, d]))}
    out: dict[int, tuple[list, list]] = {}
    for i, v in enumerate(vectors):
        for d in np.flatnonzero(v):
            out.setdefault(int(d), ([], []))[0].append(i)
            out[int(d)][1].append(v[d])
    return {d: (np.array(at), np.array(w, dtype=vectors[0].dtype)) for d, (at, w) in out.items()}


def accumulate(lists: dict, n: int, queries: list[np.ndarray]) -> np.ndarray:
    """Scores (rows x queries): one term after another, each scattered into the dense array."""
    peak = max((int(np.abs(w).max()) for _, w in lists.values()), default=1) * max((int(np.abs(q).max()) for q in queries if len(q)), default=1) * max(len(lists), 1)
    peak = max([peak, *(int(np.abs(w).max()) for _, w in lists.values())])
    kind = np.int32 if peak < 2**31 else np.int64 if peak < 2**63 else object
    scores = np.zeros((n, len(queries)), dtype=kind)
    if kind is object:
        lists = {d: (at, np.array([int(x) for x in w], dtype=object)) for d, (at, w) in lists.items()}
    for d, (at, weights) in lists.items():
        asked = np.array([int(q[d]) if d < len(q) else 0 for q in queries], dtype=kind)
        who = np.flatnonzero(asked)
        if len(who) == len(queries) and len(at) == n:
            scores += weights.astype(kind)[:, None] * asked
        elif len(who) * 2 > len(queries):
            scores[at] += weights.astype(kind)[:, None] * asked
        elif len(who):
            scores[np.ix_(at, who)] += weights.astype(kind)[:, None] * asked[who]
    return scores


def best(scores: np.ndarray, ids: np.ndarray, query_ids: np.ndarray, k: int, bars: np.ndarray | None = None) -> pd.DataFrame:
    """The k highest scores of each query but its own row, ties to the smaller id, by partition selection: at (the query's place), query_id, vec_id, score. Scores below the query's bar are passed over."""
    found = []
    for j, q in enumerate(query_ids):
        column = scores[:, j]
        other = np.flatnonzero((ids != q) & (column >= bars[j])) if bars is not None else np.flatnonzero(ids != q)
        s = column[other]
        if len(s) > k:
            bar = np.partition(s, len(s) - k)[len(s) - k] if s.dtype != object else sorted(s)[-k]
            keep = np.flatnonzero(s >= bar)
            other, s = other[keep], s[keep]
        order = sorted(range(len(s)), key=lambda i: (-int(s[i]), ids[other[i]]))[:k]
        found += [(j, int(q), int(ids[other[i]]), max(-(1 << 63), min(int(s[i]), (1 << 63) - 1))) for i in order]
    return pd.DataFrame(found, columns=["at", "query_id", "vec_id", "score"], dtype="int64")


class _Best:
    """The k best so far of each query of a block of queries."""

    def __init__(self, queries: Row, k: int):
        self.vectors = _sparse(queries.lengths, queries.cells, queries.exact)
        self.ids, self.first, self.k = np.asarray(queries.ids), queries.block * QUERIES, k
        self.parts: list[pd.DataFrame] = []
        self.held = 0
        #: Score of the k-th best, once there are k.
        self.bars = np.full(len(self.ids), -(1 << 63))

    def see(self, lists: dict, row_ids: np.ndarray) -> None:
        found = best(accumulate(lists, len(row_ids), self.vectors), row_ids, self.ids, self.k, self.bars)
        self.parts.append(found)
        self.held += len(found)
        if len(self.parts) == 1 or self.held > _HELD:
            self.merge()

    def merge(self) -> pd.DataFrame:
        every = pd.concat(self.parts).sort_values(["at", "score", "vec_id"], ascending=[True, False, True])
        top = every.groupby("at", sort=False).head(self.k)
        full = top.groupby("at")["score"].agg(["min", "size"])
        full = full[full["size"] == self.k]
        self.bars[full.index.to_numpy()] = full["min"].to_numpy()
        self.parts, self.held = [top], len(top)
        return top


def _search(held, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked = [_Best(q, k) for q in held.value]
        seen = False
        for batch in batches:
            for r in batch.itertuples(index=False):
                lists, row_ids, seen = postings(_sparse(r.lengths, r.cells, r.exact)), np.asarray(r.ids), True
                for q in asked:
                    q.see(lists, row_ids)
        for q in asked if seen else []:
            top = q.merge()
            yield top.assign(query=top["at"] + q.first)[["query", "query_id", "vec_id", "score"]]

    return run


def _rounds(asked: DataFrame, most: int) -> Iterator[list[Row]]:
    """Query blocks, gathered until they hold ``most`` bytes; the driver reads one partition of blocks at a time."""
    now, size = [], 0
    for q in asked.toLocalIterator():
        own = len(q.cells) + sum(map(len, q.exact or ())) + 8 * len(q.ids)
        if now and size + own > most:
            yield now
            now, size = [], 0
        now.append(q)
        size += own
    if now:
        yield now


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query with all rows but its own.

    Both tables have vec_id and embedding; other columns are not read. Vectors that are null
    or hold null, NaN or infinite components take no part, nor do rows without vec_id. Vectors
    of different lengths meet in the components that both have. Rows with equal vec_id are
    candidates each, but never of a query with that id; each query row is answered on its own.
    Scores beyond 64 bits are clamped. An empty table gives no rows. What is broadcast is
    bounded by ROUND_BYTES, whatever the number of queries.
    """
    spark = vectors.sparkSession
    workers_see_us(spark)
    pick = [F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")]
    rows = cut(vectors.select(*pick).mapInArrow(_blocks(ROWS), BLOCK_SCHEMA), "row-blocks")
    asked = cut(queries.select(*pick).mapInArrow(_blocks(QUERIES), BLOCK_SCHEMA), "query-blocks")
    spread = rows.coalesce(SPREAD * spark.sparkContext.defaultParallelism)
    schema = "query long, query_id long, vec_id long, score long"
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    found: list[DataFrame] = []
    for blocks in _rounds(asked, ROUND_BYTES):
        held = spark.sparkContext.broadcast(blocks)
        top = spread.mapInPandas(_search(held, k), schema).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        found.append(cut(top.select("query_id", "rank", "vec_id", "score"), "top"))
        held.destroy()
    discard(rows, asked)
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return found[0] if len(found) == 1 else spark.read.schema(found[0].schema).parquet(*[f._cut_at for f in found])


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


OP3_SQL = """
WITH v AS (SELECT vec_id, CAST([CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS BIGINT[]) AS q FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
