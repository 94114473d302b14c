"""Steps whose work must not grow faster than the tables: what they shuffle, and the same rows as before."""

from functools import partial, reduce

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import diff as D
from quillgraph.operators import evaluation as E
from quillgraph.operators import health as H
from quillgraph.operators import retrieval as R
from quillgraph.operators import search as S
from quillgraph.sources import adapter

SMALL = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_relations_that_touch_ids_are_those_of_the_whole_table(spark):
    ids = spark.createDataFrame([("part:3",), ("supplier:2",), ("order:5",), ("customer:1",), ("nation:4",)], "id string")
    want = adapter.relations(spark, SMALL).where(reduce(lambda a, b: a | b, [F.col(c).isin([r["id"] for r in ids.collect()]) for c in ("from_id", "to_id")]))
    assert rows_of(adapter.relations(spark, SMALL, ids)) == rows_of(want) != []


def test_larger_tables_get_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(adapter, "TASK_BYTES", 10_000)
    assert "12), REPARTITION_BY_NUM" in adapter.relations(spark, SMALL)._jdf.queryExecution().toString()


@pytest.mark.parametrize("most", [0, 1000])
def test_expansion_from_a_function_equals_that_from_a_table(spark, monkeypatch, most):
    monkeypatch.setattr(R, "few", lambda rows: rows.count() <= most)
    seeds = spark.createDataFrame([("part:3",), ("part:7",), ("supplier:2",)], "id string")
    for wanted in ("none", "dependents", "dependencies"):
        got = R.expand(partial(adapter.relations, spark, SMALL), seeds, wanted)
        assert rows_of(got) == rows_of(R.expand(adapter.relations(spark, SMALL), seeds, wanted)) != []


def test_postings_are_not_shuffled(spark, graph):
    found = S.postings(S.documents(graph[0]))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [0, 1000])
def test_opponents_are_counted_up_to_two(spark, monkeypatch, most):
    monkeypatch.setattr(E, "MOST_TERMS", most)
    texts = [["x", "enabled"], ["disabled", "x"], ["active", "y"], ["y", "z", "stale"], ["allow", "z"], ["deny", "z"], ["enabled", "disabled", "w"], ["w", "ready"], ["alone", "enabled"], ["x", "y", "removed"], ["plain"]]
    rows = spark.createDataFrame([(f"t{k}", t) for k, t in enumerate(texts)], "id string, terms array<string>")
    exact = {}
    for a, _ in rows_of(E.conflicts(rows, rows)):
        exact[a] = min(2, exact.get(a, 0) + 1)
    assert {r["id"]: r["n_opposed"] for r in E.opposed_among(rows).collect()} == exact != {}


@pytest.mark.parametrize("most", [0, 1000])
def test_opponents_among_stored_texts(spark, monkeypatch, most):
    monkeypatch.setattr(E, "MOST_TERMS", most)
    table = lambda texts, p: spark.createDataFrame([(f"{p}{k}", t) for k, t in enumerate(texts)], "id string, terms array<string>")
    rows = table([["x", "enabled"], ["y", "stale"], ["allow", "z"], ["w", "ready"], ["alone", "enabled"], ["v", "enabled", "disabled"], ["plain"]], "t")
    stored = table([["disabled", "x"], ["y", "active"], ["y", "active", "z"], ["deny", "z"], ["alone", "enabled"], ["v", "enabled", "disabled"]], "t")
    exact = {}
    for a, _ in rows_of(E.conflicts(rows, stored, but_itself=False)):
        exact[a] = min(2, exact.get(a, 0) + 1)
    got = E.opposed_among(rows, stored)
    assert {r["id"]: r["n_opposed"] for r in got.collect()} == exact != {}
    assert rows_of(got) == rows_of(E.opposed_by(rows, E.stances(stored), but_itself=False))


def test_equal_relations_are_found_where_their_ends_are(spark):
    keys, schema = ["from_id", "kind", "to_id"], "from_id string, kind string, to_id string, props_json string"
    edges = [("a", "x", "b", None), ("a", "x", "b", None), ("a", "y", "c", '{"k":1}'), ("c", "x", "lost", None), (None, "x", "b", None)]
    relations, ids = spark.createDataFrame(edges, schema), spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    assert rows_of(D.connected_once(relations, ids)) == sorted({edges[0], edges[2]}, key=repr)
    assert D.lacks_ends(relations, ids) and not D.lacks_ends(relations.limit(3), ids)
    current = spark.createDataFrame([("a", "x", "b", None), ("a", "y", "c", '{"k":2}'), ("b", "x", "c", None)], schema)
    incoming = spark.createDataFrame([("a", "y", "c", '{"k":1}'), ("c", "x", "a", None)], schema)
    moves = D.sync_diff(current, incoming.unionByName(current.limit(1)), keys)
    assert rows_of(moves) == [("a", "y", "c", "updated"), ("b", "x", "c", "removed"), ("c", "x", "a", "created")]
    plan = moves._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Sort" not in plan
    part = lambda change: moves.where(F.col("change") == change)
    want = D.upsert(current, incoming, keys).where("from_id <> 'b'").drop("change")
    assert rows_of(D.rewritten(current, incoming, keys, part("updated"), part("removed"))) == rows_of(want)
    assert rows_of(D.rewritten(current.limit(0), incoming, keys, None, None)) == rows_of(incoming)


def test_indicators_without_clustering(spark):
    e, r = adapter.entities(spark, SMALL), adapter.relations(spark, SMALL)
    whole, some = H.indicators(e, r).head().asDict(), H.indicators(e, r, clustered=False).head().asDict()
    assert some == {k: v for k, v in whole.items() if k != "clustering" and k != "eligible"}


def test_ends_are_distinct_before_they_meet_entities(spark, graph):
    plan = H.orphans(*graph)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("LeftAnti") < plan.index("Aggregate")


def test_ids_are_looked_up_by_number(spark):
    ids = spark.createDataFrame([("part:3",), ("part:007",), ("part:x",), ("supplier:2",)], "id string")
    df = spark.createDataFrame([(3,), (7,), (2,), (None,)], "k int")
    marked = adapter._marked(df, "part", "k", "near", ids)
    assert rows_of(marked) == rows_of(spark.createDataFrame([(3, True), (7, False), (2, False), (None, True)], "k int, near boolean"))
    plan = marked._jdf.queryExecution().executedPlan().toString()
    assert "HashedRelationBroadcastMode(List(input[0, bigint, true]" in plan


@pytest.mark.parametrize("task", ["what depends on red widget?", "blue gear supplier overview", "what does blue gear depend on?"])
def test_candidates_are_those_of_hybrid_with_counts_for_lists(spark, task):
    e, r = adapter.entities(spark, SMALL), partial(adapter.relations, spark, SMALL)
    found = R.candidates(e, r, task)
    whole = R.hybrid(e, r, task).join(e, "id")
    n = lambda d: F.size(F.filter("graph_refs", lambda x: x["direction"] == d)).cast("long").alias(d)
    texts = ["id", "title", "updated_at", "matched_terms"]
    assert rows_of(found.select(*texts, "graph_counts.*")) == rows_of(whole.select(*texts, *map(n, R.DIRECTIONS))) != []
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "FullOuter" not in plan and "LeftSemi" not in plan
    scores = lambda df: rows_of(E.evaluate(df, task, "2024-06-01T00:00:00Z").drop("reason"))
    assert scores(found) == scores(whole)


@pytest.mark.parametrize("most", [0, 1000])
def test_remap_looks_each_end_up_once(spark, monkeypatch, most):
    monkeypatch.setattr(H, "MOST_MEMBERS", most)
    ids = [f"n{k}" for k in range(40)]
    edges = [(a, kind, b) for i, a in enumerate(ids) for j, b in enumerate(ids) for kind in ("x", "y") if (7 * i + 3 * j + len(kind)) % 5 < 2 or i == j]
    edges += [(None, "x", "n1"), ("n1", "x", None)]
    into = {x: ids[k - k % 4] for k, x in enumerate(ids[:24]) if k % 4}
    want = {}
    for a, kind, b in sorted(e for e in edges if None not in e):
        key = (into.get(a, a), kind, into.get(b, b))
        if key[0] != key[2]:
            want.setdefault(key, (f"{a}{b}", a, b))
    relations = spark.createDataFrame([(*e, f"{e[0]}{e[2]}") for e in edges], "from_id string, kind string, to_id string, props_json string")
    got = H.remap(relations, spark.createDataFrame(list(into.items()), "id string, canonical_id string"), ends=True)
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got.collect()} == want and got.count() == len(want)
    if most == 0:
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join") == 4 and "LeftSemi" not in plan and "LeftAnti" not in plan


@pytest.mark.parametrize("alive", [True, False])
def test_continuing_scores_once(spark, alive):
    rows = [("a", 0.7, "survived" if alive else "trimmed"), ("b", 0.5, "trimmed"), ("c", 0.1, "rejected")]
    scored = spark.createDataFrame(rows, "id string, composite double, fate string")
    found = E.bundle(scored, "continue")
    assert rows_of(found) == (rows[:1] if alive else rows)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" in plan and "LogicalRDD" not in plan and "LocalRelation" not in plan


def test_the_best_candidate_comes_from_one_pass(spark):
    rows = [("b", 0.7, "survived"), ("a", 0.7, "survived"), ("c", 0.9, "trimmed"), ("d", 0.1, "rejected")]
    scored = spark.createDataFrame(rows, "id string, composite double, fate string")
    found = E.bundle(scored, "minimal")
    assert rows_of(found) == rows[1:2] and found.columns == scored.columns
    assert rows_of(E.bundle(scored.where("id > 'b'"), "minimal")) == rows[2:3]
    assert rows_of(E.bundle(scored.limit(0), "minimal")) == []
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
