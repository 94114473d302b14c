"""Filter interaction audit by multilinear-extension Shapley (operator 11).

Five filters read each text once and leave a mask of five bits; the masks are counted for
each part, so a part is at most 32 rows whatever the corpus holds. All further figures come
from those counts. A part's removal polynomial is the multilinear extension

    f(x) = sum over masks M of count[M] * (1 - prod over i in M of (1 - x_i)),

kept as its coefficients on the monomials of subsets. At the corner of a filter set S it is
the number of rows that S removes, which gives the survivors of every prefix of an order.
On the diagonal its partial derivative in x_i is a polynomial in one variable; its integral
from 0 to 1, in exact rationals, is the filter's Shapley value, and 120 times that is what
the filter removes summed over all orders.

Filter E compares texts across the whole table. Digests that may hold more than one row in
a thousand are found by a Misra-Gries summary and their smallest doc_id is broadcast; all
others meet theirs in a shuffle of narrow rows.
"""

from __future__ import annotations

from collections.abc import Iterable
from fractions import Fraction
from itertools import permutations
from math import factorial

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, cut, discard, table, workers_see_us
from .exact_dedup import HEAVY_SHARE, heavy_digests

FILTERS = "ABCDE"
STEPS = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def local_failures(text: Column) -> dict[str, Column]:
    """The failure conditions that one text decides alone; no text and no words fail A, and nothing else."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    long = lambda c: c.cast("long")  # noqa: E731  (a hundred times an int may not be one)
    n = long(F.size(words))
    return {
        "A": n < 100,
        "B": 100 * long(F.size(F.array_distinct(words))) < 80 * n,
        "C": 100 * long(F.regexp_count(text, F.lit("[A-Z]"))) > 10 * long(F.length(text)),
        "D": text.rlike(r"[#$%&*|]"),
    }


def masked(docs: DataFrame, heavy_share: int = HEAVY_SHARE) -> DataFrame:
    """(doc_id, part, mask) of every row, written in the shared folder; bit i of mask is set where the text fails filter i.

    A null text is empty, a null lang is the part "". Rows with one doc_id do not precede
    each other. A row without doc_id has no smaller one, and is smaller than none.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    bits = [F.when(fails, 1 << FILTERS.index(name)).otherwise(0) for name, fails in local_failures(text).items()]
    rows = cut(
        docs.select(
            "doc_id",
            F.coalesce(F.col("lang"), F.lit("")).alias("part"),
            F.unhex(F.sha2(text, 256)).alias("digest"),
            sum(bits[1:], bits[0]).alias("mask"),
        ),
        "audit-rows",
    )
    heavy = heavy_digests(rows, rows.count(), heavy_share)
    first = F.min("doc_id").alias("first")
    known = cut(rows.join(F.broadcast(heavy), "digest", "left_semi").groupBy("digest").agg(first), "audit-heavy")
    hot = rows.join(F.broadcast(known), "digest")
    others = rows.join(F.broadcast(known), "digest", "left_anti")
    cold = others.join(others.groupBy("digest").agg(first), "digest")
    copy = F.when(F.col("doc_id") > F.col("first"), 1 << FILTERS.index("E")).otherwise(0)
    out = cut(hot.unionByName(cold).select("doc_id", "part", (F.col("mask") + copy).alias("mask")), "audit-masks")
    discard(rows, known)
    return out


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): counts of rows, and of those whose doc_id is labelled quality 1 and toxic 1.

    Of repeated label rows one that says 1 is enough. Labels meet only rows with a doc_id;
    all sums are partial ones before any shuffle.
    """
    one = lambda name: F.max(F.when(F.col(name) == 1, 1).otherwise(0)).cast("long")
    said = labels.where("quality = 1 OR toxic = 1").groupBy("doc_id").agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    labelled = masks.where("doc_id IS NOT NULL").join(said, "doc_id")
    sums = lambda df, *cols: df.groupBy("part", "mask").agg(*cols)
    n = sums(masks, F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    marked = sums(labelled, F.lit(0).cast("long").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    return sums(n.unionByName(marked), *[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


class RemovalPolynomial:
    """The multilinear extension of "rows that a set of filters removes", from counts of failure masks."""

    def __init__(self, counts: dict[int, int], n_filters: int):
        self.n = n_filters
        self.coefficients: dict[int, int] = {}
        for mask, count in counts.items():
            sub = mask
            while sub:  # 1 - prod(1 - x_i) is the sum of (-1)^(|T|+1) prod(x_i, i in T) over non-empty T within the mask
                sign = 1 if sub.bit_count() % 2 else -1
                self.coefficients[sub] = self.coefficients.get(sub, 0) + sign * count
                sub = (sub - 1) & mask

    def corner(self, filters: int) -> int:
        """Rows removed by a set of filters: the value where exactly their variables are 1."""
        return sum(a for t, a in self.coefficients.items() if t & filters == t)

    def diagonal_derivative(self, i: int) -> list[int]:
        """Coefficients by power of t of the partial derivative in x_i at (t, ..., t)."""
        powers = [0] * self.n
        for t, a in self.coefficients.items():
            if t >> i & 1:
                powers[t.bit_count() - 1] += a
        return powers

    def shapley(self, i: int) -> Fraction:
        """The integral of that derivative from 0 to 1."""
        return sum((Fraction(a, k + 1) for k, a in enumerate(self.diagonal_derivative(i))), Fraction(0))


def audit_part(part: str, counts: pd.DataFrame, names: str = FILTERS) -> Iterable[tuple]:
    """All steps of all orders of one part, from its counts by mask."""
    every = (1 << len(names)) - 1
    made = {c: RemovalPolynomial(dict(zip(counts["mask"].tolist(), counts[c].tolist())), len(names)) for c in ("n", "good", "toxic")}
    gone = {c: [p.corner(s) for s in range(every + 1)] for c, p in made.items()}
    total, removed = int(counts["n"].sum()), gone["n"]
    scaled = [made["n"].shapley(i) * factorial(len(names)) for i in range(len(names))]
    assert all(value.denominator == 1 for value in scaled)
    for order in permutations(range(len(names))):
        text, before = "".join(names[i] for i in order), 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            here = removed[after] - removed[before]
            yield (
                part, text, step, total - removed[after], here, removed[1 << i] - here, removed[every] - removed[every & ~(1 << i)],
                gone["good"][after] - gone["good"][before], gone["toxic"][after] - gone["toxic"][before], int(scaled[i]),
            )
            before = after


def audit(counts: DataFrame) -> DataFrame:
    """STEPS rows from mask_counts(): a group is one part's counts, 32 rows at most."""

    def steps(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        columns = [c.split()[0] for c in STEPS.split(", ")]
        return pd.DataFrame(audit_part(key[0], group), columns=columns)

    workers_see_us(counts.sparkSession)
    return counts.groupBy("part").applyInPandas(steps, STEPS)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part, order and step over all documents. No documents, no rows; further columns are not read."""
    masks = masked(table(spark, sf_dir, "documents"))
    counts = cut(mask_counts(masks, table(spark, sf_dir, "labels")), "audit-counts")
    discard(masks)
    return audit(counts)


OP11_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
l AS (SELECT doc_id, coalesce(max(CASE WHEN quality = 1 THEN 1 ELSE 0 END), 0) AS good,
             coalesce(max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END), 0) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, good, toxic,
             [len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words),
              100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t), regexp_matches(t, '[#$%&*|]'),
              coalesce(w.doc_id > first, false)] AS fails
      FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
m AS (SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f GROUP BY part, fails),
p AS (SELECT '' AS o UNION ALL SELECT o || x FROM p, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) AS v(x) WHERE NOT contains(o, x)),
s AS (SELECT o, step, ascii(substr(o, step, 1)) - 64 AS i, list_transform(range(1, step), lambda k: ascii(substr(o, k, 1)) - 64) AS earlier
      FROM p, (SELECT unnest([1, 2, 3, 4, 5]) AS step) WHERE length(o) = 5),
r AS (SELECT part, o, step, i, n, good, toxic, fails[i] AS bad,
             len(list_filter(earlier, lambda k: fails[k])) > 0 AS gone,
             fails[i] AND len(list_filter(fails, lambda b: b)) = 1 AS only_it FROM m, s),
a AS (SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step, i,
             CAST(coalesce(sum(n) FILTER (NOT gone AND NOT bad), 0) AS BIGINT) AS kept,
             CAST(coalesce(sum(n) FILTER (NOT gone AND bad), 0) AS BIGINT) AS removed,
             CAST(coalesce(sum(n) FILTER (gone AND bad), 0) AS BIGINT) AS redundant,
             CAST(coalesce(sum(n) FILTER (only_it), 0) AS BIGINT) AS unique_fails,
             CAST(coalesce(sum(good) FILTER (NOT gone AND bad), 0) AS BIGINT) AS good_lost,
             CAST(coalesce(sum(toxic) FILTER (NOT gone AND bad), 0) AS BIGINT) AS toxic_lost FROM r GROUP BY part, o, step, i)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, i) AS BIGINT) AS shapley FROM a
"""
