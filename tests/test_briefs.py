import json

import pytest

from quillgraph.api import Engine
from quillgraph.operators import attribution, briefs
from quillgraph.sources.files import write_text

META = {"agent_id": "a", "session_id": "s", "timestamp": "2026-01-01T00:00:00Z"}
NOW = "2026-03-22T00:00:00Z"
KIND = {"family": "write_producing", "subprofile": "", "default_mode": "inject", "inject_at": 0.7, "minimal_at": 0.4, "low_mode": "minimal"}
STATS = {"nodes": 5, "edges": 4, "recommendation": "proceed", "reasons": ["ok"], "status": "ready"}
ADVICE = {"confidence": 0.8, "confidence_reasons": ["retrieval_results_available"], "level": "high", "effective_mode": "inject", "threshold": 0.7, "budget": 100, "next_step": "proceed_with_kickoff"}
PACKED = {"truncated": True, "omitted_results": 3, "results": [{"rank": 1, "score": 12.0, "entity": {"id": "x", "kind": "Doc", "title": "T", "summary": "S"}, "relationships": [{"kind": "Z", "direction": "d", "peer": "q"}, {"kind": "A", "direction": "d", "peer": ""}], "matched_terms": ["m"], "inclusion_reason": "why"}]}
NONE = {"truncated": False, "omitted_results": 0, "results": []}


def test_coverage():
    assert [briefs.coverage("abstain", 1, PACKED), briefs.coverage("inject", 1, PACKED), briefs.coverage("inject", 0, PACKED), briefs.coverage("inject", 1, NONE)] == ["abstained", "grounded", "low_context", "low_context"]


@pytest.mark.parametrize(
    ("kind", "confidence", "asked", "last"),
    [
        ({}, 0.8, "", "retrieval_results_available"),
        ({}, 0.5, "", "minimal_kickoff_selected"),
        ({}, 0.1, "", "low_confidence_minimal"),
        ({"low_mode": "abstain"}, 0.1, "", "low_confidence_abstain"),
        ({}, 0.8, "none", "explicit_no_kickoff_requested"),
        ({}, 0.8, "minimal", "minimal_kickoff_selected"),
        ({"default_mode": "abstain"}, 0.8, "", "family_policy_default_no_kickoff"),
    ],
)
def test_reason_codes(kind, confidence, asked, last):
    assert briefs.reason_codes(KIND | kind, ADVICE | {"confidence": confidence}, asked)[-1] == last


def test_recommendation_gives_way_to_the_tasks_own_context():
    stats = STATS | {"recommendation": "inspect_hygiene", "reasons": ["orphan_rate_high"]}
    assert briefs.recommended(KIND, stats, True) == ("proceed", ["task_specific_context_grounded", "graph_hygiene_advisory"])
    assert briefs.recommended(KIND, stats, False)[0] == "gather_context"
    assert briefs.recommended(KIND | {"family": "workflow_context"}, stats, False)[0] == "inspect_hygiene"
    assert briefs.recommended(KIND, STATS, False) == ("proceed", ["ok"])


def test_delegation_brief_of_grounded_context():
    told = briefs.kickoff_context("Do it", KIND, STATS, "proceed", [], "grounded", 4, PACKED)
    text = briefs.delegation_brief("Do it", KIND, "auto", ADVICE, STATS, ("ready", "proceed"), "rev:1", told, PACKED)
    assert told["summary"] == "Projected 1 result of the highest-value graph results within the token budget; 3 additional result(s) were omitted."
    assert text.endswith("- T [Doc]: S\n  relationships: A, Z -> q\n  matched terms: m\n  included because: why\n- additional omitted results: 3")
    assert "- confidence: high (0.80)" in text and "- current revision: rev:1" in text


def test_low_context_says_what_to_do_next():
    told = briefs.kickoff_context(" Do it ", KIND | {"family": "verification_audit"}, STATS, "inspect_hygiene", ["low_confidence_minimal"], "low_context", 2, NONE)
    assert told["summary"].startswith("The requested token budget is too small") and told["guidance"][0].startswith("Increase --max-tokens")
    assert 'Treat "Do it" as' in told["guidance"][1] and told["guidance"][-1].startswith("Inspect graph hygiene") and len(told["guidance"]) == 6
    none = briefs.kickoff_context("x", KIND, STATS | {"nodes": 0}, "bootstrap", [], "low_context", 0, NONE)
    assert none["guidance"][0].startswith("Bootstrap baseline")


def test_start_finish_seed_and_stored_decisions(spark, graph, tmp_path):
    e = Engine(spark, f"file://{tmp_path}", gate_writes=False)
    e.store.write(*graph, META)
    got = e.start("Implement what depends on auth", NOW)["result"]
    assert got["brief"]["status"] == got["context"]["coverage"] and got["brief"]["prompt"].startswith("Task: Implement what depends on auth\nKickoff family: write_producing")
    if got["context"]["results"]:
        assert got["context"]["results"][0]["inclusion_reason"].startswith("Included for the write_producing family")
    done = {"schema_version": "v1", "metadata": META, "task": "T", "summary": "S", "decisions": [{"summary": "D", "status": "accepted"}], "follow_up": [{"summary": "F", "owner": "o", "status": "open"}]}
    held = e.finish(json.dumps(done), 0.6)["result"]
    assert e.attribution(held["attribution"])["result"]["memory_decision"] == "deferred"
    out = e.finish(json.dumps(done))["result"]
    assert out["brief"]["decisions"] == ["D (accepted)"] and "- F (owner: o) [open]" in out["brief"]["prompt"] and "- nodes created: 3" in out["brief"]["prompt"]
    asked = e.context("what depends on auth?", NOW)["result"]
    write_text(spark, f"file://{tmp_path}/attribution/bad.json", "{")
    listed = e.attributions()["result"]["records"]
    assert {r["id"] for r in listed} == {held["attribution"], asked["attribution_id"]}
    assert [r["id"] for r in e.attributions(outcome=asked["decision"])["result"]["records"]] == [asked["attribution_id"]]
    assert e.attribution("nope")["error"]["code"] == "attribution_not_found"
    docs = spark.createDataFrame([("README.md", "# Title\n\nFirst paragraph.")], "path string, text string")
    first, again = e.seed(docs, META), e.seed(docs, META)
    assert first["result"]["written"] and again["result"] == {"written": False, "nodes": 0, "relationships": 0}
    changed = e.seed(spark.createDataFrame([("README.md", "# Title\n\nOther paragraph.")], "path string, text string"), META)
    assert changed["result"]["written"] and changed["result"]["nodes"]["updated"] >= 1


def test_records_of_no_folder(spark, tmp_path):
    assert attribution.stored(spark, f"file://{tmp_path}/none").isEmpty() and attribution.by_run(spark, f"file://{tmp_path}/none").isEmpty()


def test_report_is_kept_and_runs_can_be_chosen(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}")
    e.lab_init()
    e.files.write_json("lab/suite.json", {"schema_version": "v1", "suite_id": "s", "tasks": [{"task_id": "t1", "family": "verification_audit", "description": "Audit graph stats", "acceptance_criteria_ref": "r"}]})
    at = "2026-01-01T00:00:00Z"
    done = json.dumps({"schema_version": "v1", "metadata": META | {"revision": {"properties": {"execution_usage": {"input_tokens": 1, "output_tokens": 2, "total_tokens": 3}}}}, "task": "T", "summary": "S"})
    ids = [e.lab_run("t1", c, "m", "d", 1, at, at, "do it", done)["result"]["run_id"] for c in ("with-graph", "without-graph", "with-harness")]
    for i in ids[:2]:
        e.lab_evaluate({"schema_version": "v1", "run_id": i, "evaluator": "e", "evaluated_at": NOW, "scores": {"success": True, "quality_score": 0.5, "resumability_score": 0.5, "human_intervention_count": 0}})
    e.files.write_json(f"lab/runs/{ids[2]}/attribution-summary.json", {"run_id": ids[2], "outcomes": {"abstain": 2, "continue": 6}})
    out = e.report(at)["result"]
    assert out["gate"]["profiles"] == 1 and out["verification"][0]["profile"] == "stats_audit" and out["unscored_run_ids"] == [ids[2]]
    assert {(r["scope"], r["outcome"]): r["percentage"] for r in out["outcomes"]}["overall", "abstain"] == 25.0
    assert (out["over_abstention"]["runs"], out["over_abstention"]["abstentions"]) == (1, 2)
    assert e.files.read_json(f"lab/reports/{out['report_id']}/report.json")["counters"]["runs"] == 3
    assert out["limitations"][0].startswith("1 selected runs are unscored")
    few = e.report(run_ids=ids[:2] + ids[:1])["result"]
    assert few["counters"]["runs"] == 2 and "report_id" not in few and few["selection"]["mode"] == "run_ids"
    assert e.report(run_ids=["ghost"])["status"] == "error"
