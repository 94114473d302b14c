"""Differences between revisions, and the sync of a graph to a target."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import canonical_json
from ..functions.text import tags_normal
from ..sources.adapter import CONTENT


def _comparable(df: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """Keys and content with one form for each meaning; long contents travel as hashes."""
    out = [F.col(k) for k in keys]
    for c in df.columns:
        if c in keys or c not in CONTENT:
            continue
        if c == "tags":
            value: Column = F.array_join(tags_normal(F.col(c)), "\x1f")
        elif c == "props_json":
            value = F.coalesce(canonical_json(F.col(c)), F.lit(""))
        else:
            value = F.coalesce(F.col(c), F.lit(""))
        if c == "content":
            value = F.when(F.length(value) > 64, F.sha2(value, 256)).otherwise(value)
        out.append(value.alias(prefix + c))
    return df.select(*out, F.lit(True).alias(f"{prefix}here"))


def diff_entities(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, change, changed_fields) of entities that differ: added, removed, retagged or updated.

    A change of kind or of the normal form of the tags makes it retagged, whatever else changed.
    """
    return entity_changes(_comparable(before, ["id"], "b_").join(_comparable(after, ["id"], "a_"), "id", "full_outer"))


def _tags(prefix: str) -> Column:
    """The tags of one side of a comparison; none where that side is absent."""
    return F.filter(F.split(F.coalesce(f"{prefix}tags", F.lit("")), "\x1f"), lambda t: t != "")


def entity_changes(met: DataFrame, with_tags: bool = False) -> DataFrame:
    """diff_entities() of both sides' comparable fields (b_*, a_*), met by id; with tags_added and tags_removed if asked for."""
    fields = F.array_compact(F.array(*[F.when(~F.col(f"b_{c}").eqNullSafe(F.col(f"a_{c}")), F.lit(c)) for c in CONTENT]))
    change = (
        F.when(F.col("b_here").isNull(), "added")
        .when(F.col("a_here").isNull(), "removed")
        .when(F.array_contains("fields", "kind") | F.array_contains("fields", "tags"), "retagged")
        .when(F.size("fields") > 0, "updated")
    )
    listed = F.when(F.col("b_here") & F.col("a_here"), F.array_join("fields", ",")).otherwise("")
    more = [F.array_except(_tags(x), _tags(y)).alias(name) for x, y, name in (("a_", "b_", "tags_added"), ("b_", "a_", "tags_removed"))] if with_tags else []
    return met.withColumn("fields", fields).select("id", change.alias("change"), listed.alias("changed_fields"), *more).where("change is not null")


def diff_tags(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, change, tags_added, tags_removed): tags in normal form that one side has and the other has not, of entities where there are any."""
    met = _comparable(before, ["id"], "b_").join(_comparable(after, ["id"], "a_"), "id", "full_outer")
    found = entity_changes(met, with_tags=True)
    return found.where((F.size("tags_added") > 0) | (F.size("tags_removed") > 0)).drop("changed_fields")


def diff_relations(before: DataFrame, after: DataFrame) -> DataFrame:
    """(from_id, to_id, change, kind_before, kind_after) of relations that differ.

    A removed and an added relation of the same ends are one retagged relation where each
    side has exactly one; all others stay removed and added.
    """
    return relation_changes(_differing(before, after, ["from_id", "kind", "to_id"]))


def _differing(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change) of relations that differ: both tables meet in one grouping by their keys.

    Properties are compared by two 64-bit hashes with one key, so buffers have a fixed width
    and nothing is sorted. Of relations with equal keys those with the largest hashes count.
    """
    props = F.coalesce(canonical_json(F.col("props_json")), F.lit(""))
    side = lambda df, is_before: df.select(*keys, F.lit(is_before).alias("before"), F.xxhash64(props).alias("x"), F.xxhash64(F.lit(1), props).alias("y"))
    largest = [F.max(F.when(F.col("before") == is_before, F.col(h))).alias(p + h) for p, is_before in (("b_", True), ("a_", False)) for h in ("x", "y")]
    met = side(before, True).unionByName(side(after, False)).groupBy(*keys).agg(*largest)
    change = F.when(F.col("b_x").isNull(), "added").when(F.col("a_x").isNull(), "removed").when((F.col("b_x") != F.col("a_x")) | (F.col("b_y") != F.col("a_y")), "updated")
    return met.select(*keys, change.alias("change")).where("change is not null")


def stored_relation_changes(both: DataFrame) -> DataFrame:
    """diff_relations() of both sides' comparable properties (b_*, a_*), met by key; rows that only one side or neither has may be absent."""
    differ = both.where(F.col("b_here").isNull() | F.col("a_here").isNull() | (F.col("b_props_json") != F.col("a_props_json")))
    state = F.when(F.col("b_here").isNull(), "added").when(F.col("a_here").isNull(), "removed").otherwise("updated")
    return relation_changes(differ.withColumn("change", state))


def relation_changes(marked: DataFrame) -> DataFrame:
    """diff_relations() of relations marked added, removed or updated: those of the same ends are paired."""
    ends = Window.partitionBy("from_id", "to_id")
    count = lambda what: F.count_if(F.col("change") == what).over(ends)
    other = F.max(F.when(F.col("change") == "added", F.col("kind"))).over(ends)
    paired = marked.select("*", ((count("removed") == 1) & (count("added") == 1)).alias("pair"), other.alias("kind_new"))
    kept = paired.where(~(F.col("pair") & (F.col("change") == "added")))
    change = F.when(F.col("pair") & (F.col("change") == "removed"), "retagged").otherwise(F.col("change"))
    return kept.select(
        "from_id",
        "to_id",
        change.alias("change"),
        F.when(F.col("change") != "added", F.col("kind")).alias("kind_before"),
        F.when(change == "retagged", F.col("kind_new")).when(F.col("change") != "removed", F.col("kind")).alias("kind_after"),
    )


def touched(before: DataFrame, after: DataFrame, keys: list[str], removed: DataFrame | None = None) -> DataFrame:
    """What a write does to its keys: (keys, change, b_*, a_*), with the comparable fields of both sides.

    after: rows that are written, unique by key; removed: keys that go. Of the current rows
    only those are read on. change is created, updated (also with equal content) or removed.
    """
    named = after.select(*keys) if removed is None else after.select(*keys).unionByName(removed.select(*keys))
    met = _comparable(before.join(named, keys, "left_semi"), keys, "b_").join(_comparable(after, keys, "a_"), keys, "full_outer")
    change = F.when(F.col("b_here").isNull(), "created").when(F.col("a_here").isNull(), "removed").otherwise("updated")
    return met.withColumn("change", change)


def folded(changes: DataFrame, keys: list[str], backwards: bool = False) -> DataFrame:
    """Many versions' touched() rows with their ``number`` as one: each key's first state before and last state after.

    Backwards, the sides change places. Keys that neither side holds are left out.
    """
    sides = {p: [c for c in changes.columns if c.startswith(p)] for p in ("b_", "a_")}
    state = lambda p: F.struct(*[F.col(c).alias(c[2:]) for c in sides[p]])
    ends = changes.groupBy(*keys).agg(F.min_by(state("b_"), "number").alias("b"), F.max_by(state("a_"), "number").alias("a"))
    ends = ends.where(F.col("b.here").isNotNull() | F.col("a.here").isNotNull())
    one, other = ("a", "b") if backwards else ("b", "a")
    return ends.select(*keys, *[F.col(f"{one}.{c[2:]}").alias(c) for c in sides["b_"]], *[F.col(f"{other}.{c[2:]}").alias(c) for c in sides["a_"]])


def diff_summary(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(record, change, n) of both differences."""
    count = lambda df, name: df.groupBy("change").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("record"), "change", "n")
    return count(entities, "entity").unionByName(count(relations, "relation"))


def sync_diff(current: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change): what brings the current rows to the target: created, updated, removed.

    Both tables meet in one grouping by keys and content, so nothing is sorted; what only one
    side has is grouped by its keys again.
    """
    side = lambda df, p: _comparable(df, keys, "").drop("here").withColumns({x: F.lit(x == p) for x in ("b", "a")})
    fields = [c for c in CONTENT if c in current.columns and c not in keys]
    either = side(current.select(*keys, *fields), "b").unionByName(side(target.select(*keys, *fields), "a"))
    differ = either.groupBy(*keys, *fields).agg(F.max("b").alias("b"), F.max("a").alias("a")).where("b <> a")
    met = differ.groupBy(*keys).agg(F.max("b").alias("b"), F.max("a").alias("a"))
    return met.select(*keys, F.when(~F.col("b"), "created").when(~F.col("a"), "removed").otherwise("updated").alias("change"))


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Current rows with the incoming ones written over them: an update replaces all content and ``updated_*``, and keeps ``created_*``."""
    old = current.select([F.col(c).alias(f"o_{c}") for c in current.columns])
    new = incoming.select([F.col(c).alias(f"n_{c}") for c in current.columns] + [F.lit(True).alias("n__new")])
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(f"o_{k}") == F.col(f"n_{k}"))
    met = old.join(new, on, "full_outer")

    def value(c: str) -> Column:
        if c in keys:
            return F.coalesce(f"n_{c}", f"o_{c}")
        if c.startswith("created_"):
            return F.coalesce(f"o_{c}", f"n_{c}")
        return F.when(F.col("n__new"), F.col(f"n_{c}")).otherwise(F.col(f"o_{c}"))

    change = F.when(F.col("n__new").isNull(), "kept").when(F.col(f"o_{keys[0]}").isNull(), "created").otherwise("updated")
    return met.select(*[value(c).alias(c) for c in current.columns], change.alias("change"))


def rewritten(current: DataFrame, incoming: DataFrame, keys: list[str], updated: DataFrame | None, removed: DataFrame | None) -> DataFrame:
    """upsert() without the keys that go, for a caller who knows the keys of both that the current rows hold (None: none): few are broadcast, and the current rows stay in place."""
    stay = current if removed is None else current.join(removed.select(*keys), keys, "left_anti").select(*current.columns)
    incoming = incoming.select(*current.columns)
    if updated is None:
        return stay.unionByName(incoming)
    known = updated.select(*keys)
    new = incoming.join(known, keys, "left_semi").select([F.col(c).alias(f"n_{c}") for c in current.columns] + [F.lit(True).alias("n__new")])
    met = stay.join(new, [F.col(k) == F.col(f"n_{k}") for k in keys], "left")
    value = lambda c: F.col(c) if c in keys or c.startswith("created_") else F.when(F.col("n__new"), F.col(f"n_{c}")).otherwise(F.col(c))
    return met.select(*[value(c).alias(c) for c in current.columns]).unionByName(incoming.join(known, keys, "left_anti").select(*current.columns))


def lacks_ends(relations: DataFrame, *entity_tables: DataFrame) -> bool:
    """Whether missing_endpoints() has rows; ends are distinct before they meet entities."""
    ids = reduce(DataFrame.unionByName, [t.select("id") for t in entity_tables])
    ends = relations.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
    return not ends.join(ids, "id", "left_anti").isEmpty()


def missing_endpoints(relations: DataFrame, *entity_tables: DataFrame) -> DataFrame:
    """(from_id, kind, to_id, missing) of relations with an end that no table of entities holds."""
    ids = entity_tables[0].select("id")
    for t in entity_tables[1:]:
        ids = ids.unionByName(t.select("id"))
    ids = ids.distinct()
    ends = relations.select("from_id", "kind", "to_id", F.explode(F.array("from_id", "to_id")).alias("id"))
    lost = ends.join(ids, "id", "left_anti")
    return lost.groupBy("from_id", "kind", "to_id").agg(F.array_join(F.array_sort(F.collect_set("id")), ",").alias("missing"))


def once_each(relations: DataFrame) -> DataFrame:
    """(from_id, kind, to_id, props_json) of relations, one of those with equal keys.

    They are dealt by from_id, once, and sorted by a hash of the keys, which tells nearly all apart.
    """
    keys = ["from_id", "kind", "to_id"]
    dealt = relations.select(*keys, "props_json").repartition("from_id").withColumn("hash", F.xxhash64(*keys))
    return dealt.groupBy("hash", *keys).agg(F.first("props_json").alias("props_json")).drop("hash")


def connected_once(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """once_each() of connected(): relations travel to their to end and then to their from end, where equal ones meet as well."""
    at = lambda c: entities.select(F.col("id").alias(c)).hint("shuffle_hash")
    aimed = relations.select("from_id", "kind", "to_id", "props_json").join(at("to_id"), "to_id", "left_semi")
    return once_each(aimed).join(at("from_id"), "from_id", "left_semi").select("from_id", "kind", "to_id", "props_json")


def connected(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations whose both ends are entities."""
    ids = entities.select("id")
    met = relations.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    return met.select(*relations.columns)


def contains_all(desired: DataFrame, current: DataFrame) -> DataFrame:
    """Keys and comparable content of desired rows that the current ones lack or hold with other content (none: nothing to write)."""
    keys = ["id"] if "id" in desired.columns else ["from_id", "kind", "to_id"]
    shown = lambda df: _comparable(df.select(*desired.columns), keys, "").drop("here")
    return shown(desired).exceptAll(shown(current))


def revision_for(revisions: DataFrame, ref: str) -> DataFrame:
    """The revision that ref names: its id, else the oldest with that anchor."""
    met = revisions.where((F.col("id") == ref) | (F.col("anchor") == ref))
    return met.orderBy(F.desc(F.col("id") == ref), "created_at", "id").limit(1)


def latest_revision(revisions: DataFrame, anchor: str) -> DataFrame:
    """The newest revision with the anchor, else the newest of all."""
    return revisions.orderBy(F.desc(F.col("anchor") == anchor), F.desc("created_at"), F.desc("id")).limit(1)


def anchor(df: DataFrame, *columns: str) -> DataFrame:
    """One row with a digest of the named columns that does not depend on row order: per-row hashes, whose four parts of 56 bits are summed.

    Halves of a part are summed as longs, which hold 2^35 rows, and put together at the end.
    """
    h = F.sha2(F.to_json(F.struct(*columns)), 256)
    rows = df.select(*[F.conv(F.substring(h, i, 14), 16, 10).cast("long").alias(f"p{i}") for i in (1, 15, 29, 43)])
    half = lambda x: F.sum(x).cast("decimal(38,0)")
    part = lambda i: half(F.shiftright(f"p{i}", 28)) * F.lit(1 << 28).cast("decimal(10,0)") + half(F.col(f"p{i}").bitwiseAND(F.lit((1 << 28) - 1)))
    return rows.agg(F.sha2(F.concat_ws("|", F.count(F.lit(1)), *[part(i).cast("decimal(38,0)") for i in (1, 15, 29, 43)]), 256).alias("anchor"))
