import random

import pytest
from pyspark.sql import functions as F

from quillgraph.functions.text import terms
from quillgraph.operators import evaluation as E


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def composite(spark, config):
    df = frame(spark, [(0.9, 0.6, 0.8)], "r double, c double, u double")
    return df.select(E.composite(F.col("r"), F.col("c"), F.col("u"), config).alias("x")).head()["x"]


def test_composite(spark):
    assert composite(spark, E.Config()) == pytest.approx(0.767)
    assert composite(spark, E.Config(weights=(0.5, 0.3, 0.2))) == pytest.approx(0.79)
    assert composite(spark, E.Config(weights=(0, -1, 0))) == pytest.approx(0.767)


def test_aggregate_prefers_survivors(spark):
    df = frame(spark, [("survived", 0.85), ("trimmed", 0.51), ("rejected", 0.12)], "fate string, composite double")
    assert df.agg(E.aggregate_confidence().alias("x")).head()["x"] == pytest.approx(0.85)
    assert df.where("fate <> 'survived'").agg(E.aggregate_confidence().alias("x")).head()["x"] == pytest.approx(0.51)
    assert df.limit(0).agg(E.aggregate_confidence().alias("x")).head()["x"] == 0


def test_write_gate_boundaries(spark):
    df = frame(spark, [(0.55,), (0.80,), (0.54,)], "x double").select("x", *E.write_gate(F.col("x")))
    assert {r["x"]: r["write_status"] for r in df.collect()} == {0.55: "deferred", 0.80: "approved", 0.54: "skipped"}


def test_outcomes(spark):
    df = frame(spark, [(0.7, None), (0.69, None), (0.4, None), (0.39, None), (0.9, 1.0), (0.5, 0.6)], "c double, p double").select(E.outcome(F.col("c"), F.col("p")).alias("o"))
    assert [r["o"] for r in df.collect()] == ["continue", "minimal", "minimal", "abstain", "continue" if 1.0 - 0.9 < 0.1 else "backtrack", "minimal" if 0.6 - 0.5 < 0.1 else "backtrack"]


def test_thresholds_are_checked():
    with pytest.raises(ValueError):
        E.Thresholds(minimal=0.9)
    with pytest.raises(ValueError):
        E.Thresholds(write=1.5)


def test_conflicts_need_a_shared_subject(spark):
    rows = frame(spark, [("a", "cache enabled"), ("b", "cache disabled"), ("c", "queue disabled"), ("d", "cache stable")], "id string, t string").select("id", terms(F.col("t")).alias("terms"))
    assert sorted((r["id"], r["other"]) for r in E.conflicts(rows, rows).collect()) == [("a", "b"), ("b", "a")]


def test_evaluate(spark, graph):
    from quillgraph.operators import retrieval as R

    found = R.hybrid(*graph, "what depends on auth?")
    rows = found.select("id", "matched_terms", "graph_refs").join(graph[0], "id")
    got = {r["id"]: r for r in E.evaluate(rows, "what depends on auth?", "2026-03-22T14:00:00Z").collect()}
    assert got["service:login-api"]["fate"] == "survived" and not got["service:login-api"]["stale"]
    old = {r["id"]: r for r in E.evaluate(rows, "what depends on auth?", "2026-06-22T14:00:00Z").collect()}
    assert old["service:login-api"]["stale"] and old["service:login-api"]["consistency"] < got["service:login-api"]["consistency"]
    assert E.evaluate(rows.limit(0), "auth", "2026-03-22T14:00:00Z").isEmpty()


# ---------------------------------------------------------------- conflicts by summary, outputs

_PLAIN = ["cache", "queue", "index", "node", "auth"]
_POLAR = ["enabled", "disabled", "allowed", "blocked", "stable", "deprecated", "active"]


def _said(spark, n, seed, prefix=""):
    r = random.Random(seed)
    rows = [(f"{prefix}{i:03d}", " ".join(r.sample(_PLAIN, r.randint(0, 3)) + r.sample(_POLAR, r.randint(0, 3)))) for i in range(n)]
    return spark.createDataFrame(rows, "id string, t string").select("id", terms(F.col("t")).alias("terms"))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 12, 40])
def test_summary_tells_none_one_and_several_conflicts(spark, n):
    rows, stored = _said(spark, n, n), _said(spark, n, n + 100)
    for right, itself in ((rows, True), (stored, False)):
        exact = {r["id"]: min(r["n"], 2) for r in E.conflicts(rows, right, itself).groupBy("id").agg(F.count("*").alias("n")).collect()}
        assert {r["id"]: r["n_opposed"] for r in E.opposed_by(rows, E.stances(right), itself).collect()} == exact


def test_a_common_term_does_not_make_pairs(spark):
    """Twenty thousand texts on one subject, half of either opinion: the summary has one row a term and every text meets it once."""
    rows = spark.range(20_000).select(F.format_string("n%06d", "id").alias("id"), F.when(F.col("id") % 2 == 0, F.array(F.lit("cache"), F.lit("enabled"))).otherwise(F.array(F.lit("cache"), F.lit("disabled"))).alias("terms"))
    summary = E.stances(rows)
    assert [(r["term"], r["pos0_n"], r["neg0_n"]) for r in summary.collect()] == [("cache", 10_000, 10_000)]
    found = E.opposed_by(rows, summary)
    assert found.count() == 20_000 and found.where("n_opposed = 2").count() == 20_000


def _candidates(spark, rows):
    refs = "array<struct<kind:string,from_id:string,to_id:string,direction:string>>"
    df = spark.createDataFrame(rows, "id string, summary string")
    texts = {c: F.lit("") for c in ("kind", "title", "content", "repo_path")}
    return df.withColumns(texts | {"tags": F.array().cast("array<string>"), "matched_terms": F.array().cast("array<string>"), "graph_refs": F.array().cast(refs), "updated_at": F.lit("2026-03-01T00:00:00Z"), "created_at": F.lit(None).cast("string")})


def test_scores_of_capped_and_of_exact_conflicts_are_equal(spark):
    r = random.Random(3)
    rows = _candidates(spark, [(f"c{i}", " ".join(r.sample(_PLAIN, 2) + r.sample(_POLAR, 1))) for i in range(12)])
    stored = _candidates(spark, [(f"c{i}" if i % 3 else f"g{i}", " ".join(r.sample(_PLAIN, 1) + r.sample(_POLAR, 1))) for i in range(12)])
    score = lambda exact: {x["id"]: (x["relevance"], x["consistency"], x["usefulness"], x["composite"], x["fate"]) for x in E.evaluate(rows, "cache index", "2026-03-02T00:00:00Z", graph_state=stored, exact=exact).collect()}
    assert score(False) == score(True) and len({v[1] for v in score(False).values()}) > 1


def test_graph_state_that_contradicts(spark):
    rows = _candidates(spark, [("svc", "cache layer enabled")])
    against = _candidates(spark, [("svc", "cache layer disabled")])
    alone = E.evaluate(rows, "cache layer", "2026-03-02T00:00:00Z").head()
    held = E.evaluate(rows, "cache layer", "2026-03-02T00:00:00Z", graph_state=against).head()
    assert (alone["n_conflicts"], held["n_conflicts"]) == (0, 1) and held["consistency"] < alone["consistency"] and held["usefulness"] < alone["usefulness"]


def _outputs(spark, rows):
    return spark.createDataFrame(rows, "id string, summary string, content string, prior_id string, prior_summary string, prior_content string")


def test_output_that_got_worse(spark):
    task = "update the auth middleware and add tests for the login flow"
    rows = [
        ("candidate-2", "Updates auth middleware", "Changed auth middleware only.", "candidate-1", "Updates auth middleware and tests", "Changed auth middleware and added login flow tests with coverage for failure cases."),
        ("same", "Updates auth middleware", "text", "same", "Updates auth middleware", "text"),
        ("first", "Updates auth middleware", "text", None, None, None),
        ("empty", " ", None, None, "was something", "auth"),
    ]
    got = {r["id"]: r for r in E.evaluate_output(_outputs(spark, rows), task, "2026-01-01T00:00:00Z").collect()}
    assert got["candidate-2"]["regressed"] and got["candidate-2"]["composite"] < got["candidate-2"]["prior_composite"] and "composite confidence regressed" in got["candidate-2"]["reasons"]
    assert not got["same"]["regressed"] and got["same"]["composite_delta"] == 0 and got["same"]["reasons"] == []
    assert got["first"]["regressed"] is None and got["first"]["composite"] > 0
    assert [got["empty"][c] for c in ("relevance", "consistency", "usefulness", "composite")] == [0, 0, 0, 0] and got["empty"]["regressed"] is None
    assert E.evaluate_output(_outputs(spark, rows).limit(0), task, "2026-01-01T00:00:00Z").isEmpty()


def test_finish_gates_on_its_own_score(spark, graph, tmp_path, monkeypatch):
    import json

    from quillgraph.api import Engine

    meta = {"agent_id": "a", "session_id": "s", "timestamp": "2026-01-01T00:00:00Z"}
    e = Engine(spark, f"file://{tmp_path}")
    e.store.write(*graph, meta)
    done = {"schema_version": "v1", "metadata": meta, "task": "auth token rotation", "summary": "auth token rotation", "decisions": [{"summary": "auth token rotation"}]}
    held = e.finish(json.dumps(done | {"task": "something else entirely", "summary": "x"}))["result"]
    assert not held["written"] and held["gate"]["write_status"] == "deferred" and 0.55 <= held["gate"]["confidence"] == held["gate"]["scores"]["composite"] < 0.8
    assert e.attribution(held["attribution"])["result"]["memory_decision"] == "deferred"
    low = Engine(spark, e.base, thresholds=E.Thresholds(write=0.3, defer=0.2))
    passed = low.finish(json.dumps(done))["result"]
    assert passed["written"] and passed["gate"]["write_status"] == "approved" and passed["gate"]["confidence"] == passed["gate"]["scores"]["composite"]
    monkeypatch.setattr(E, "evaluate_output", lambda *_: 1 / 0)
    again = e.finish(json.dumps(done | {"summary": "open when scoring fails"}))["result"]
    assert again["written"] and "gate" not in again
