"""Mixing sources to target weights by a time-varying curriculum (operator 9).

Targets: sources in code-point order take the weights of ``weights`` in turn and share
all words; no target exceeds ``most`` times its source, and what the capped sources
leave is shared again by weight. That water filling has a closed form: sources saturate
in order of cap / weight, so one ordered pass over the sources table settles all of them.

Times: a source's weight over training time t in [0, 1] is 1 + slope * (2t - 1) times its
share. Its integral, the cumulative demand (1 - slope) t + slope t^2, is inverted at each
copy's cumulative taken words over all words taken from the source, which gives the copy's
position; copies are then range-sorted by position. A source is gone through once for each
copy that all its documents have, and then once more as far as the target reaches, so
taken words follow the schedule whatever the target is. Order within a pass is that of
md5(doc_id), and running sums go through 4096 hash ranges a source, so no task holds a
whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table, word_count

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
#: Slopes of the weight schedules, in turn: early, even and late sources.
SLOPES = (-0.5, 0.0, 0.5)


def _in_turn(values: tuple[float, ...], k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size) -> adds k (rank by code point), weight and target. One row per source; null is a source of its own, and last."""
    every = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("k", F.row_number().over(every) - 1)
    ranked = ranked.withColumn("weight", _in_turn(weights, F.col("k"))).withColumn("cap", most * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "k")
    everyone = Window.orderBy(F.col("cap") / F.col("weight"), "k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    stepped = ranked.select(
        "*",
        F.sum("source_size").over(everyone).alias("total"),
        (F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap")).alias("full"),
        F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)).alias("open"),
    )
    level = (F.col("total") - F.col("full")) / F.col("open")
    settled = stepped.withColumn("level", F.when(F.col("cap") / F.col("weight") > level, level))
    settled = settled.withColumn("level", F.first("level", ignorenulls=True).over(everyone))
    return settled.select("source", "source_size", "k", "weight", F.coalesce(F.least("cap", F.col("weight") * F.col("level")), "cap").alias("target"))


def curriculum(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, slopes: tuple[float, ...] = SLOPES) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, taken, position, positions; range-sorted by position.

    Every document is taken floor(target / source_size) times, and once more while the
    words before it, in md5 order, leave room for over half of it. positions has one entry
    for each copy and position is the first; a document without copies has the position that
    it would have if the documents that are not taken were a mix of their own. A null text has size 0
    and is taken 0 words; rows with equal doc_id are told apart only by their size. An
    empty table gives no rows.
    """
    sized = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    sized = sized.withColumn("h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).withColumn("cell", F.substring("h", 1, 3))
    cells = sized.groupBy("source", "cell").agg(F.sum("size").alias("words"))
    goal = targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most).withColumn("slope", _in_turn(slopes, F.col("k")))
    starts = cells.withColumn("before", F.sum("words").over(Window.partitionBy("source").orderBy("cell")) - F.col("words"))
    known = starts.join(goal, starts["source"].eqNullSafe(goal["source"])).select(
        starts["source"].alias("s"), starts["cell"].alias("c"), "before", "source_size", "target", "slope"
    )
    ran = sized.withColumn("run", F.sum("size").over(Window.partitionBy("source", "cell").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    placed = ran.join(known, ran["source"].eqNullSafe(known["s"]) & (ran["cell"] == known["c"]))
    first = F.col("before") + F.col("run")
    whole = F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)))
    spare = F.col("target") - whole * F.col("source_size")
    fits = (F.col("size") > 0) & (first + F.col("size") / 2.0 <= spare)
    copies = F.when(F.col("source_size") == 0, 1).otherwise(whole + fits.cast("long")).cast("long")
    # words of the last pass, which ends in one cell of each source at most: only these cells are run through again
    ended = starts.join(F.broadcast(goal), starts["source"].eqNullSafe(goal["source"])).select(
        starts["source"].alias("s"), starts["cell"].alias("c"), "before", "words", "source_size", spare.alias("spare")
    ).where("source_size > 0")
    within = F.col("before") + F.col("words")
    edge = ended.where((F.col("before") < F.col("spare")) & (F.col("spare") < within)).select("s", "c", "before", "spare")
    edge_rows = sized.join(F.broadcast(edge), sized["source"].eqNullSafe(edge["s"]) & (sized["cell"] == edge["c"]))
    edge_run = edge_rows.withColumn("run", F.sum("size").over(Window.partitionBy("s", "c").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    reached = edge_run.where((F.col("size") > 0) & (first + F.col("size") / 2.0 <= F.col("spare"))).select("s", (first + F.col("size")).alias("extra"))
    full = ended.where(within <= F.col("spare")).select("s", within.alias("extra"))
    extras = full.unionByName(reached).groupBy("s").agg(F.max("extra").alias("extra")).withColumnRenamed("s", "es")
    placed = placed.join(F.broadcast(extras), placed["s"].eqNullSafe(extras["es"]), "left").withColumn("extra", F.coalesce("extra", F.lit(0)))
    middle = first + F.col("size") / 2.0
    total = whole * F.col("source_size") + F.col("extra")
    rest = F.col("source_size") - F.col("extra")
    a = F.col("slope")

    def invert(share: Column) -> Column:
        share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))
        return F.when(a == 0, share).otherwise((a - 1 + F.sqrt((1 - a) * (1 - a) + 4 * a * share)) / (2 * F.when(a == 0, 1.0).otherwise(a)))

    ratio = lambda x, y: F.when(y > 0, x / F.when(y > 0, y)).otherwise(0.0)
    passes = F.when(F.col("copies") > 0, F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).otherwise(F.array().cast("array<long>"))
    placed = placed.withColumn("copies", copies)
    placed = placed.withColumn("positions", F.transform(passes, lambda k: invert(ratio(k * F.col("source_size") + middle, total))))
    position = F.when(F.col("copies") > 0, F.element_at("positions", 1)).otherwise(invert(ratio(middle - F.col("extra"), rest)))
    placed = placed.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), position.alias("position"), "positions")
    return placed.repartitionByRange(F.col("position"), F.col("doc_id")).sortWithinPartitions("position", "doc_id")


def mix_documents(docs: DataFrame) -> DataFrame:
    """Documents as the mix takes them: each row as often as its copies say, each copy at its own position, in the order of positions; rows that are not taken go."""
    plan = curriculum(docs).select(F.col("doc_id").alias("__id"), F.col("size").alias("__n"), "positions").where(F.size("positions") > 0)
    plan = plan.groupBy("__id", "__n").agg(F.max(F.struct(F.size("positions").alias("copies"), "positions")).alias("most")).select("__id", "__n", F.col("most.positions").alias("__places"))
    own = [f"__c{k}" for k in range(len(docs.columns))]  # the columns have other names for a while, so that none can clash
    at = {c: own[k] for k, c in enumerate(docs.columns)}
    rows = docs.toDF(*own)
    taken = rows.join(plan, rows[at["doc_id"]].eqNullSafe(plan["__id"]) & (word_count(rows[at["text"]]) == plan["__n"]))
    taken = taken.select(*own, "__id", F.posexplode("__places").alias("__copy", "__at"))
    dealt = taken.repartitionByRange(F.col("__at"), F.col("__id"), F.col("__copy")).sortWithinPartitions("__at", "__id", "__copy")
    return dealt.select(*own).toDF(*docs.columns)


#: Positions are reported in billionths of the training run, as whole numbers.
UNIT = 1e9


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix with position (of the first copy) and positions (of all copies, joined by commas) in billionths of the run."""
    units = lambda p: F.floor(p * UNIT).cast("long")
    every = F.array_join(F.transform("positions", lambda p: units(p).cast("string")), ",")
    return curriculum(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", units(F.col("position")).alias("position"), every.alias("positions"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
                  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
k AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM s),
w AS (SELECT *, CAST(CASE k % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight, CAST(3 AS DOUBLE) * source_size AS cap FROM k),
f AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) AS total,
             sum(cap) OVER (ORDER BY cap / weight, k ROWS UNBOUNDED PRECEDING) - cap AS fullest,
             sum(weight) OVER (ORDER BY cap / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS opened FROM w),
l AS (SELECT (total - fullest) / opened AS level FROM f WHERE cap / weight > (total - fullest) / opened ORDER BY cap / weight, k LIMIT 1),
t AS (SELECT source, source_size, coalesce(least(cap, weight * (SELECT level FROM l)), cap) AS target,
             CAST(CASE k % 3 WHEN 0 THEN -0.5 WHEN 1 THEN 0 ELSE 0.5 END AS DOUBLE) AS slope FROM f),
r AS (SELECT d.*, CAST(sum(size) OVER (PARTITION BY source ORDER BY h, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS before FROM d),
g AS (SELECT r.*, t.source_size, t.target, t.slope, CAST(floor(t.target / t.source_size) AS BIGINT) AS whole,
             t.target - floor(t.target / t.source_size) * t.source_size AS spare, r.before + CAST(r.size AS DOUBLE) / 2 AS middle
      FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, CASE WHEN source_size = 0 THEN 1 ELSE whole + CASE WHEN size > 0 AND middle <= spare THEN 1 ELSE 0 END END AS copies FROM g),
x AS (SELECT source, max(before + size) AS extra FROM c WHERE size > 0 AND middle <= spare GROUP BY source),
y AS (SELECT c.*, coalesce(x.extra, 0) AS extra FROM c LEFT JOIN x ON c.source IS NOT DISTINCT FROM x.source),
z AS (SELECT *, [CASE WHEN whole * source_size + extra > 0 THEN (i * source_size + middle) / CAST(whole * source_size + extra AS DOUBLE) ELSE 0 END FOR i IN range(copies)] AS shares,
             CASE WHEN source_size - extra > 0 THEN (middle - extra) / CAST(source_size - extra AS DOUBLE) ELSE 0 END AS untaken FROM y),
q AS (SELECT *, [CAST(floor(1e9 * CASE WHEN slope = 0 THEN p ELSE (slope - 1 + sqrt((1 - slope) * (1 - slope) + 4 * slope * p)) / (2 * slope) END) AS BIGINT)
                 FOR p IN [CAST(greatest(0, least(1, coalesce(v, 0))) AS DOUBLE) FOR v IN CASE WHEN copies > 0 THEN shares ELSE [untaken] END]] AS placed FROM z)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies, placed[1] AS position, CASE WHEN copies > 0 THEN array_to_string(placed, ',') ELSE '' END AS positions FROM q
"""
