"""Hybrid retrieval: text search fused with one-hop, intent-aware graph expansion."""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strings
from ..sources.files import staged
from .search import search_entities

#: Boost of an entity by the direction of a relation that reaches it.
BOOSTS = {"supports_task": 20.0, "outgoing_neighbor": 2.0, "incoming_neighbor": 2.0}
#: All directions that expand() gives.
DIRECTIONS = ["incoming_neighbor", "matched_seed", "outgoing_neighbor", "supports_task"]
#: Ids up to which a table of them is broadcast, about 100 bytes each; more are met in shuffles.
MOST_BROADCAST = 2_500_000
PENALTIES = {"trimmed": 0.7, "rejected": 0.4}
_DEPENDENCIES = re.compile(r"\bwhat\s+does\s+.+\s+depend\s+(?:on|upon)\b")
_DEPENDENTS = re.compile(r"\bwhat\s+depends?\s+(?:on|upon)\b")


def intent(task: str) -> str:
    """dependencies, dependents or none."""
    task = task.strip().lower()
    return "dependencies" if _DEPENDENCIES.search(task) else "dependents" if _DEPENDENTS.search(task) else "none"


def boost(direction: Column) -> Column:
    out = F.lit(0.0)
    for name, value in BOOSTS.items():
        out = F.when(direction == name, value).otherwise(out)
    return out


def few(rows: DataFrame, most: int = MOST_BROADCAST) -> bool:
    """Whether the rows may be broadcast: they are counted, up to the bound."""
    return rows.limit(most + 1).count() <= most


def expand(relations: DataFrame | Callable[[DataFrame | None], DataFrame], seeds: DataFrame, wanted: str, incoming: DataFrame | None = None) -> DataFrame:
    """(id, direction, from_id, to_id, kind): what each relation that touches a seed gives to its ends.

    Exactly one case holds for a relation: the intent's case for DEPENDS_ON, else its from
    end is a seed, else its to end is. seeds: distinct ids as ``id``; relations are unique by
    (from_id, kind, to_id), as the store returns them. With ``incoming``, the same keys
    clustered by to_id, each end is looked up where the table lies and only touched
    relations are moved to learn of their other end. relations may be a function that gives
    those that touch the given ids (all without ids): then seeds, if few(), are broadcast and
    relations without one are never shuffled.
    """
    if callable(relations):
        near = few(seeds)
        relations = relations(seeds if near else None)
    else:
        near = False
    hint = F.broadcast if near else lambda df: df
    at = lambda c: hint(seeds.select(F.col("id").alias(c), F.lit(True).alias(f"{c}_seed")))
    edges = relations.select("from_id", "to_id", "kind")
    if incoming is None:
        flagged = edges.join(at("from_id"), "from_id", "left").join(at("to_id"), "to_id", "left")
    else:
        out = edges.join(at("from_id"), "from_id").join(at("to_id"), "to_id", "left")
        into = incoming.select("from_id", "to_id", "kind").join(at("to_id"), "to_id").join(at("from_id").select("from_id"), "from_id", "left_anti")
        flagged = out.unionByName(into.withColumn("from_id_seed", F.lit(None).cast("boolean")))
    starts, ends = F.coalesce("from_id_seed", F.lit(False)), F.coalesce("to_id_seed", F.lit(False))
    depends = F.upper("kind") == "DEPENDS_ON"
    give = lambda end, direction: F.struct(F.col(end).alias("id"), F.lit(direction).alias("direction"))
    given = F.when(starts, F.array(give("to_id", "outgoing_neighbor"))).when(ends, F.array(give("from_id", "incoming_neighbor")))
    if wanted == "dependents":
        given = F.when(depends & ends, F.array(give("from_id", "supports_task"), give("to_id", "matched_seed"))).otherwise(given)
    elif wanted == "dependencies":
        given = F.when(depends & starts, F.array(give("to_id", "supports_task"), give("from_id", "matched_seed"))).otherwise(given)
    return flagged.where(starts | ends).select(F.explode(given).alias("g"), "from_id", "to_id", "kind").select("g.id", "g.direction", "from_id", "to_id", "kind")


def structural(expanded: DataFrame, refs: bool = True) -> DataFrame:
    """(id, structural, refs): summed boosts and the relations behind them, by (kind, from, to)."""
    ref = F.struct("kind", "from_id", "to_id", "direction")
    more = [F.array_sort(F.collect_list(ref)).alias("graph_refs")] if refs else []
    return expanded.groupBy("id").agg(F.sum(boost(F.col("direction"))).alias("structural"), F.count(F.lit(1)).alias("n_refs"), *more)


def candidates(entities: DataFrame, relations: DataFrame | Callable[[DataFrame | None], DataFrame], task: str) -> DataFrame:
    """The candidates of hybrid() as entities with all their columns, with matched_terms and, in place of the relations behind them, graph_counts: their number by direction.

    Entities are joined once and by left joins only, so each side is shuffled by its id once;
    relations are counted and never gathered.
    """
    found = search_entities(entities, task).select(F.col("doc_id").alias("id"), "matched_terms")
    given = expand(relations, found.select("id"), intent(task))
    near = given.groupBy("id").agg(*[F.count_if(F.col("direction") == d).alias(d) for d in DIRECTIONS])
    counts = near.select("id", F.struct(*DIRECTIONS).alias("graph_counts"))
    met = entities.join(counts, "id", "left").join(found, "id", "left").where("graph_counts IS NOT NULL OR matched_terms IS NOT NULL")
    none = F.struct(*[F.lit(0).cast("long").alias(d) for d in DIRECTIONS])
    return met.withColumns({"matched_terms": F.coalesce("matched_terms", strings([])), "graph_counts": F.coalesce("graph_counts", none)})


def hybrid(
    entities: DataFrame,
    relations: DataFrame | Callable[[DataFrame | None], DataFrame],
    task: str,
    refs: bool = True,
    hits: DataFrame | None = None,
    incoming: DataFrame | None = None,
) -> DataFrame:
    """Candidates with score, text, structural, matched_terms, n_refs (and graph_refs): seeds and their neighbours that are entities.

    relations: a table, or a function as expand() takes it.
    hits: what a stored index found for the task; without it all entities are searched.
    incoming: keys of the relations of a stored graph clustered by to_id; both ends of its
    relations are entities, so neighbours are not looked up again.
    """
    hits = search_entities(entities, task) if hits is None else hits
    found = hits.select(F.col("doc_id").alias("id"), F.col("score").alias("text"), "matched_terms")
    near = structural(expand(relations, found.select("id"), intent(task), incoming), refs)
    if incoming is None:
        near = near.join(entities.select("id"), "id", "left_semi")
    fused = found.join(near, "id", "full_outer")
    text, struct_ = F.coalesce("text", F.lit(0.0)), F.coalesce("structural", F.lit(0.0))
    empty = F.array().cast("array<struct<kind:string,from_id:string,to_id:string,direction:string>>")
    more = [F.coalesce("graph_refs", empty).alias("graph_refs")] if refs else []
    return fused.select("id", (text + struct_).alias("score"), text.alias("text"), struct_.alias("structural"), F.coalesce("matched_terms", strings([])).alias("matched_terms"), F.coalesce("n_refs", F.lit(0)).alias("n_refs"), *more)


def ranked(results: DataFrame) -> DataFrame:
    """rank 1..n by score, ties by id.

    Results are dealt by ranges of (score, id), sorted and numbered within each range, and
    written once in the shared folder; the sizes of the ranges, one row each, then give
    every range its first rank. No task sees more than a range.
    """
    here = F.monotonically_increasing_id()  # the number of the range in the upper bits, the row's place in it in the lower 33
    dealt = results.repartitionByRange(F.desc("score"), F.asc("id")).sortWithinPartitions(F.desc("score"), F.asc("id"))
    placed = staged(dealt.withColumn("__at", here), "ranked")
    part, place = F.shiftright("__at", 33).cast("int"), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r["part"], r["n"]) for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    before = dict(zip([p for p, _ in sizes], [0, *accumulate(n for _, n in sizes)]))
    offset = F.element_at(F.create_map(*[F.lit(x) for p, n in before.items() for x in (p, n)]), part) if before else F.lit(0)
    return placed.withColumn("rank", (offset + place + 1).cast("int")).drop("__at")


def down_ranked(results: DataFrame, confidence: DataFrame) -> DataFrame:
    """Scores weighed by the fate of each candidate. confidence: id, composite, fate, stale."""
    met = results.join(confidence, "id", "left")
    factor = F.lit(1.0)
    for fate, value in PENALTIES.items():
        factor = F.when(F.col("fate") == fate, value).otherwise(factor)
    why = F.when(F.col("stale"), "stale entity").otherwise("low confidence")
    note = F.when(factor < 1, F.format_string("%s (composite=%.2f, fate=%s)", why, "composite", "fate"))
    return met.withColumn("score", F.col("score") * factor).withColumn("down_ranked", factor < 1).withColumn("down_rank_note", note)


def explanation(results: DataFrame) -> DataFrame:
    """Ranking reasons (id, position, type, role, contribution, path_count, edge_kinds) of candidates with graph_refs.

    Order: the text match, one reason for each role that adds to the score, the breakdown.
    """
    text = results.where((F.size("matched_terms") > 0) | (F.col("text") > 0)).select("id", F.lit(0).alias("position"), F.lit("text_match").alias("type"), F.lit("").alias("role"), F.col("text").alias("contribution"), F.lit(0).cast("long").alias("path_count"), F.array_join("matched_terms", ",").alias("detail"))
    paths = results.select("id", F.explode("graph_refs").alias("r")).withColumn("b", boost(F.col("r.direction"))).where("b > 0")
    roles = paths.groupBy("id", F.col("r.direction").alias("role")).agg(F.sum("b").alias("contribution"), F.count(F.lit(1)).alias("path_count"), F.array_join(F.array_sort(F.collect_set("r.kind")), ",").alias("detail"))
    graph = roles.select("id", F.lit(1).alias("position"), F.lit("graph_path").alias("type"), "role", "contribution", "path_count", "detail")
    total = results.select("id", F.lit(2).alias("position"), F.lit("score_breakdown").alias("type"), F.lit("").alias("role"), F.col("score").alias("contribution"), F.lit(0).cast("long").alias("path_count"), F.lit("").alias("detail"))
    return text.unionByName(graph).unionByName(total)
