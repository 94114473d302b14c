import pytest
from pyspark.sql import functions as F

from quillgraph.operators import lab as L
from quillgraph.operators import workflow as W

CASES = [
    ("Implement delegated workflow start command", "workflow_context", ""),
    ("Write the production handler for kickoff classification", "write_producing", ""),
    ("Diagnose why kickoff returns low-context results", "troubleshooting_diagnosis", ""),
    ("Audit graph stats counts and verify indicators", "verification_audit", "stats_audit"),
    ("Produce a synthesis report of campaign findings", "reporting_synthesis", ""),
    ("Need help soon", "ambiguous_task", ""),
    ("Verify workflow kickoff and handoff behavior", "verification_audit", "workflow_verification"),
    ("Review provenance evidence for the latest report", "verification_audit", "general_verification"),
]


def test_families(spark):
    rows = W.classify(spark.createDataFrame([(c[0],) for c in CASES], "task string")).collect()
    assert [(r["task"], r["family"], r["subprofile"]) for r in rows] == CASES
    assert rows[5]["basis"] == ["no_family_keywords_matched"]


def test_readiness(spark):
    row = (2, 1, 0.5, 0.0, 0.0, 0)
    df = spark.createDataFrame([row, (0, 0, 0.0, 0.0, 0.0, 0), (9, 9, 0.5, 0.2, 0.3, 1), (9, 9, 0.5, 0.0, 0.0, 0)], "nodes int, edges int, density double, duplication_rate double, orphan_rate double, contradictory_facts int")
    got = [(r["recommendation"], r["reasons"]) for r in W.readiness(df).collect()]
    assert got == [("gather_context", ["graph_too_small", "graph_relationships_sparse"]), ("bootstrap", ["graph_empty"]), ("inspect_hygiene", ["contradictions_detected", "duplication_rate_high", "orphan_rate_high"]), ("proceed", ["current_revision_available", "acceptable_health_indicators"])]


@pytest.fixture(scope="module")
def ledger(spark):
    def run(i, mode, model, seed, tokens, wall, ok, q, r, task="task-001", scored=True):
        return (i, task, "write_producing", mode, model, "delegated-parallel", seed, f"2026-01-01T00:00:{seed:02d}Z", "complete", tokens, wall, ok, q, r, scored)

    rows = [
        run("ag1", "graph_backed", "model-a", 1, 100, 10, True, 0.90, 0.80),
        run("ab1", "baseline", "model-a", 1, 150, 20, True, 0.70, 0.60),
        run("ag2", "graph_backed", "model-a", 2, 110, 11, True, 0.88, 0.78),
        run("ab2", "baseline", "model-a", 2, 160, 22, True, 0.68, 0.58),
        run("bg1", "graph_backed", "model-b", 1, 210, 26, True, 0.50, 0.45),
        run("bb1", "baseline", "model-b", 1, 180, 18, True, 0.60, 0.50),
        run("bg2", "graph_backed", "model-b", 2, 220, 27, False, 0.48, 0.43),
        run("bb2", "baseline", "model-b", 2, 185, 19, True, 0.62, 0.55),
        run("u", "graph_backed", "model-a", 9, 130, 13, None, None, None, task="task-002", scored=False),
    ]
    return spark.createDataFrame(rows, "run_id string, task_id string, family string, mode string, model string, topology string, seed long, started_at string, measurement_status string, total_tokens long, wall_clock_seconds long, success boolean, quality_score double, resumability_score double, scored boolean")


def test_paired_statistics(ledger):
    pairs = L.paired(ledger)
    rows = {(r["task_id"], r["model"], r["metric"]): r for r in L.summary(L.deltas(pairs), *L.KEY).collect()}
    q = rows["task-001", "model-a", "quality_score"]
    assert (round(q["mean_delta"], 6), round(q["lower"], 6), round(q["upper"], 6)) == (0.2, 0.2, 0.2)
    assert rows["task-001", "model-a", "total_tokens"]["mean_delta"] == -50 and rows["task-001", "model-a", "wall_clock_seconds"]["mean_delta"] == -10.5
    b = rows["task-001", "model-b", "quality_score"]
    assert (round(b["mean_delta"], 4), round(b["lower"], 4), round(b["upper"], 4)) == (-0.12, -0.1592, -0.0808)
    assert rows["task-001", "model-b", "total_tokens"]["mean_delta"] == 32.5 and rows["task-001", "model-b", "success"]["mean_delta"] == -0.5
    lone = {r["task_id"]: r for r in L.pair_counts(ledger, pairs).collect() if r["task_id"] == "task-002"}["task-002"]
    assert (lone["pair_count"], lone["scored_pair_count"], lone["incomplete"]) == (1, 0, True)
    assert pairs.where("task_id = 'task-002'").head()["incomplete_reason"] == "missing_condition_match"


def test_groups_and_notes(ledger):
    groups = L.grouped(L.deltas(L.paired(ledger)))
    assert {r["value"] for r in groups.where("grouping = 'model'").collect()} == {"model-a", "model-b"}
    assert L.variation_notes(groups).count() == 5
    negative = L.findings(L.summary(L.deltas(L.paired(ledger)), *L.KEY), groups).where("finding = 'negative' and scope = 'paired_task'")
    assert {r["name"].split("|")[1] for r in negative.collect()} == {"model-b"}


def test_gate(spark):
    schema = "profile string, token_samples long, quality_samples long, mean_token_delta double, mean_quality_delta double"
    decide = lambda *rows: L.gate(spark.createDataFrame(list(rows), schema)).head()["decision"]
    assert decide(("a", 1, 1, 10.0, 0.1)) == "proceed"
    assert decide(("a", 1, 1, 200000.0, 0.1), ("b", 0, 0, 0.0, 0.0)) == "stop-and-recalibrate"
    assert decide(("a", 0, 1, 0.0, 0.0)) == "hold" and decide(("a", 1, 1, 10.0, -0.05)) == "hold" and decide() == "not_applicable"


def test_family_mean_matches_the_published_one():
    means = {"write_producing": (2, -40576), "troubleshooting": (3, -7748), "verification": (4, -2089), "reporting": (3, 4325)}
    assert round(sum(n * x for n, x in means.values()) / 12) == -8315


def test_benchmark(spark):
    rows = [("s1", "with_graph", 1100), ("s1", "without_graph", 1500), ("s2", "with_graph", 1), ("s3", "with_graph", 1), ("s3", "with_graph", 2), ("s3", "without_graph", 2)]
    got = {r["scenario_id"]: (r["status"], r["input_delta"]) for r in L.benchmark(spark.createDataFrame(rows, "scenario_id string, mode string, input long"), ["input"]).collect()}
    assert got == {"s1": ("comparable", -400), "s2": ("incomplete", None), "s3": ("non_comparable", None)}


def test_kickoff_advisory(spark):
    rows = spark.createDataFrame([("Audit graph stats", 0, 0, 0, 2, 50, 50, ""), ("Implement it", 3, 2, 2, 0, 50, 50, "")], "task string, n_results int, n_projected int, n_high_signal int, n_suppressed int, nodes int, edges int, requested_mode string")
    out = W.advisory(W.kickoff_confidence(W.with_policy(W.classify(rows)))).orderBy(F.col("task")).collect()
    assert [(r["effective_mode"], r["budget"]) for r in out] == [("abstain", 0), ("inject", 1200)]
