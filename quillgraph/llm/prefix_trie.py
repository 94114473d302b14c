"""Trie of conversation prefixes by smallest-member ownership (operator 13).

A node is a distinct sequence of first turns; its members are the conversations that begin
with it, and its owner is the smallest of them. Members of a node are members of all nodes
above it, so what a conversation owns is a suffix of its path. Every node is owned once, and
by one of the members of each node above it. So a sum over a subtree is a sum over the
members of its top: of the tokens of a member's turns from the top down (occurrences) less
those at nodes it owns, and of a flag for a member whose last node is an owned leaf. No
subtree is walked and no ancestor is joined; one group-by on the prefix gives all figures.

A prefix is known by its depth and two 64-bit lanes, each the exclusive or of hashes of
(place, digest of the turn) along the path: a running window gives all prefixes of a
conversation in one pass. Two of n prefixes of one depth coincide with odds of about
n^2 / 2^129.

The owner of a node is a minimum with partial sums and not a window over its members, as
the root has every conversation as a member; windows over each conversation's path then
mark what it owns. Nodes of more than one occurrence in a thousand are broadcast, fewer
than a thousand; others meet their rows in a shuffle. The list of the conversations that end
at a node is hashed as a stream: ranges of (node, conv_id) become strings of about
``PIECE`` characters, in parallel even within one node, and only these are hashed in turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, discard, table, word_count, workers_see_us

#: A conversation borrows first turns from the one whose id is the multiple of FAMILY at or (below 0) above it, fewer than MOST of them.
FAMILY, MOST = 20, 4
#: Nodes with more than one occurrence in so many are broadcast.
HEAVY_SHARE = 1000
#: Characters of joined ids that travel as one row.
PIECE = 1 << 16
NODE = ["depth", "a", "b"]
_LANES = {"a": 11, "b": 29}


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, k from 1, digest, words) of every turn of rows with a conv_id.

    Turns go by turn (null first), ties by role and text; null role or text is empty. The
    digest tells any two pairs of role and text apart.
    """
    blank = lambda name: F.coalesce(F.col(name), F.lit("")).alias(name)
    rows = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", blank("role"), blank("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    return rows.select("conv_id", F.row_number().over(order).cast("long").alias("k"), digest.alias("digest"), word_count(F.col("text")).alias("words"))


def rebuilt(turns: DataFrame, family: int = FAMILY, most: int = MOST) -> DataFrame:
    """Rows (conv_id, part, k, digest, words) of the rebuilt conversations, to be read in order of (part, k).

    Part 0 holds a row without digest for every conversation, even one without turns, and
    the borrowed turns; part 1 its own later ones. A missing lender lends nothing.
    """
    borrowed = (F.crc32(F.col("conv_id").cast("string")) % most).alias("h")
    every = turns.where("k = 1").select("conv_id", borrowed)
    start = every.select("conv_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("k"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("words"))
    lent = turns.where((F.col("conv_id") % family == 0) & (F.col("k") < most)).withColumnRenamed("conv_id", "lender")
    lender = F.col("conv_id") - F.col("conv_id") % family
    taken = every.where("h > 0").withColumn("lender", lender).join(lent, "lender").where("k <= h")
    own = turns.where(F.col("k") > F.crc32(F.col("conv_id").cast("string")) % most)
    part = lambda df, p: df.select("conv_id", F.lit(p).alias("part"), "k", "digest", "words")
    return start.unionByName(part(taken, 0)).unionByName(part(own, 1))


def occurrences(rows: DataFrame) -> DataFrame:
    """A row for each prefix of each conversation, the empty one included.

    conv_id, depth, lanes a and b of the prefix, deepest (the conversation's length) and
    tail (words of the turns from this one on). One conversation's rows meet in one task.
    """
    path = Window.partitionBy("conv_id").orderBy("part", "k")
    so_far, before, whole = (path.rowsBetween(Window.unboundedPreceding, x) for x in (0, -1, Window.unboundedFollowing))
    rows = rows.withColumn("depth", F.row_number().over(path).cast("long") - 1)
    lane = lambda seed: F.when(F.col("digest").isNull(), 0).otherwise(F.xxhash64(F.lit(seed), "depth", "digest"))
    return rows.select(
        "conv_id",
        "depth",
        *[F.bit_xor(lane(seed)).over(so_far).alias(name) for name, seed in _LANES.items()],
        F.max("depth").over(whole).alias("deepest"),
        (F.sum("words").over(whole) - F.coalesce(F.sum("words").over(before), F.lit(0))).alias("tail"),
    )


def with_owners(occ: DataFrame, heavy_share: int = HEAVY_SHARE) -> DataFrame:
    """Occurrences with their node's owner and reach (length of its longest member)."""
    stats = [F.min("conv_id").alias("owner"), F.max("deepest").alias("reach")]
    bar = occ.count() // heavy_share
    heavy = cut(occ.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n"), *stats).where(F.col("n") > bar).drop("n"), "trie-heavy")
    hot = occ.join(F.broadcast(heavy), NODE)
    others = occ.join(F.broadcast(heavy), NODE, "left_anti")
    out = hot.unionByName(others.join(others.groupBy(*NODE).agg(*stats), NODE))
    out._parts = [heavy]
    return out


def nodes(owned: DataFrame) -> DataFrame:
    """One row per node from with_owners(): windows mark each conversation's owned suffix, one group-by sums over members."""
    path = Window.partitionBy("conv_id").orderBy("depth")
    whole = path.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = F.col("owner") == F.col("conv_id")
    is_leaf = own & (F.col("depth") == F.col("deepest")) & (F.col("reach") == F.col("depth"))
    flag = lambda c: F.when(c, 1).otherwise(0).cast("long")
    marked = owned.select(
        *NODE,
        "conv_id",
        F.lag("owner").over(path).alias("parent"),
        F.coalesce(F.lead(flag(own)).over(path), F.lit(0)).alias("child"),
        F.max(flag(is_leaf)).over(whole).alias("leaf"),
        (F.col("tail") - F.when(own, F.col("tail")).otherwise(F.coalesce(F.max(F.when(own, F.col("tail"))).over(whole), F.lit(0)))).alias("saved"),
    )
    return marked.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"),
        F.min("parent").alias("parent_conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.sum("child").alias("n_children"),
        F.sum("leaf").alias("n_leaves"),
        F.sum("saved").alias("saved_tokens"),
    )


def _by_node(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[tuple[tuple | None, object]]:
    """(node, value of column) row by row, then (None, None)."""
    for batch in batches:
        yield from zip(zip(*(batch.column(c).to_pylist() for c in NODE)), batch.column(column).to_pylist())
    yield None, None


def _packed(rows: list[tuple], last: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    fields = [(c, pa.int64()) for c in NODE] + last
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], [name for name, _ in fields])


def join_ids(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, conv_id) rows to comma-joined strings of about PIECE characters: node, first conv_id, ids."""
    node, held, size, out = None, [], 0, []
    for now, conv_id in _by_node(batches, "conv_id"):
        if held and (now != node or size >= PIECE):
            out.append((*node, held[0], ",".join(map(str, held))))
            held, size = [], 0
            if len(out) >= 256:
                yield _packed(out, [("first", pa.int64()), ("ids", pa.string())])
                out = []
        if now is not None:
            node = now
            held.append(conv_id)
            size += len(str(conv_id)) + 1
    if out:
        yield _packed(out, [("first", pa.int64()), ("ids", pa.string())])


def hash_ids(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings of join_ids(), sorted by node and first, to node and SHA-256 of the whole list; memory holds one string's batch."""
    node, state, out = None, None, []
    for now, ids in _by_node(batches, "ids"):
        if now != node:
            if node is not None:
                out.append((*node, state.hexdigest()))
            if len(out) >= 4096:
                yield _packed(out, [("ends_sha256", pa.string())])
                out = []
            node, state = now, hashlib.sha256()
        elif now is not None:
            state.update(b",")
        if now is not None:
            state.update(ids.encode())
    if out:
        yield _packed(out, [("ends_sha256", pa.string())])


def ends(occ: DataFrame) -> DataFrame:
    """(node, ends_sha256) of nodes where conversations end: their ids ascending, as decimals joined by commas."""
    workers_see_us(occ.sparkSession)
    last = occ.where("depth = deepest").select(*NODE, "conv_id")
    pieces = last.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    pieces = pieces.mapInArrow(join_ids, "depth long, a long, b long, first long, ids string")
    sorted_pieces = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first")
    return sorted_pieces.mapInArrow(hash_ids, "depth long, a long, b long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, family: int = FAMILY, most: int = MOST) -> DataFrame:
    """All nodes of the trie of rebuilt conversations.

    Rows without conv_id take no part; a repeated row is a turn of its own; no
    conversations, no nodes, not even a root. Columns other than conv_id, turn, role and
    text are not read.
    """
    turns = cut(numbered(conversations), "trie-turns")
    occ = cut(occurrences(rebuilt(turns, family, most)), "trie-occurrences")
    owned = with_owners(occ)
    found = nodes(owned).join(ends(occ), NODE, "left")
    nothing: Column = F.lit(hashlib.sha256(b"").hexdigest())
    out = cut(
        found.select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
        ),
        "trie-nodes",
    )
    discard(turns, occ, *owned._parts)
    return out


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


OP13_SQL = r"""
WITH c AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
           FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s FROM c),
h AS (SELECT conv_id, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, 1 + length(s)), lambda j: CAST(ascii(substr(s, j, 1)) AS BIGINT))),
          lambda x, y: list_reduce(list_prepend(xor(x, y), range(8)), lambda u, v: xor(u >> 1, 3988292384 * (u & 1)))), 4294967295) % 4 AS h FROM i),
r AS (SELECT h.conv_id, 0 AS part, c.k, c.role, c.text FROM h JOIN c ON c.conv_id = h.conv_id - h.conv_id % 20 AND c.k <= h
      UNION ALL SELECT c.conv_id, 1, c.k, c.role, c.text FROM h JOIN c USING (conv_id) WHERE c.k > h),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, k) AS depth,
             sha256(role) || sha256(text) AS x, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w FROM r),
o AS (SELECT conv_id, 0 AS depth, '' AS path, 0 AS w FROM h UNION ALL
      SELECT conv_id, depth, sha256(string_agg(x, '') OVER (PARTITION BY conv_id ORDER BY depth)), w FROM t),
z AS (SELECT conv_id, max(depth) AS deepest FROM o GROUP BY conv_id),
p AS (SELECT o.*, deepest, lag(path) OVER (PARTITION BY o.conv_id ORDER BY depth) AS above FROM o JOIN z USING (conv_id)),
n AS (SELECT depth, path, min(above) AS above, min(conv_id) AS owner, count(*) AS n_convs, min(w) AS w,
             coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = deepest), '') AS ids FROM p GROUP BY depth, path),
k AS (SELECT depth - 1 AS depth, above AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (depth, path)),
s AS (SELECT o.depth, o.path, sum((m.n_convs - 1) * m.w) AS saved_tokens, count(*) FILTER (m.n_children = 0) AS n_leaves
      FROM m JOIN o ON o.conv_id = m.owner AND o.depth <= m.depth GROUP BY o.depth, o.path)
SELECT m.owner AS conv_id, CAST(m.depth AS BIGINT) AS depth, u.owner AS parent_conv_id, m.n_convs, CAST(m.n_children AS BIGINT) AS n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(m.ids) AS ends_sha256
FROM m JOIN s USING (depth, path) LEFT JOIN n AS u ON u.depth = m.depth - 1 AND u.path = m.above
"""
