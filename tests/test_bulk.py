"""Remapped relations, discovered baselines, session logs and benchmark summaries in bulk."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from quillgraph.api import Engine
from quillgraph.operators import bench_summary as B
from quillgraph.operators import health, seed
from quillgraph.sources import ledger

META = {"agent_id": "a", "session_id": "s", "timestamp": "2026-01-01T00:00:00Z"}


@pytest.mark.parametrize("seed_", [1, 2])
def test_remap_equals_the_rule_one_by_one(spark, seed_):
    r = random.Random(seed_)
    nodes = [f"n{i}" for i in range(14)]
    rows = sorted({(r.choice(nodes), r.choice("AB"), r.choice(nodes)) for _ in range(90)})
    into = {"n1": "n0", "n2": "n0", "n5": "n4", "n9": "n8"}
    want = {}
    for f, k, t in rows:
        key = (into.get(f, f), k, into.get(t, t))
        if key[0] != key[2]:
            want.setdefault(key, f"{f} {k} {t}")
    edges = spark.createDataFrame([(*x, " ".join(x)) for x in rows], "from_id string, kind string, to_id string, props_json string")
    moved = spark.createDataFrame(list(into.items()), "id string, canonical_id string")
    assert {(x[0], x[1], x[2]): x[3] for x in health.remap(edges, moved).collect()} == want
    alone = {(f, k, t) for f, k, t in rows if f != t}
    assert {(x[0], x[1], x[2]) for x in health.remap(edges, moved.limit(0)).collect()} == alone


def _repository(root):
    os.makedirs(root / "docs" / "architecture" / "deep")
    os.makedirs(root / "docs" / "plan")
    (root / "README.md").write_text("# My + project\n\nFirst paragraph.\n\n```\ncode\n```\n\nSecond one.\n")
    (root / "docs" / "architecture" / "b c.md").write_text("x")
    (root / "docs" / "architecture" / "a.md").write_text("x")
    (root / "docs" / "architecture" / "deep" / "no.md").write_text("x")
    (root / "docs" / "plan" / "backlog.yaml").write_text("# plan\nproject: \"bridge\"\nthemes:\n  - one\n")


def test_baseline_is_found_and_written_once(spark, tmp_path):
    root = tmp_path / "repo one"
    _repository(root)
    nodes, edges = seed.baseline(spark, f"file://{root}", "r")
    by = {n["id"]: n for n in nodes}
    assert list(by) == ["repo:r", "artifact:r:readme", "artifact:r:architecture", "artifact:r:backlog"]
    assert (by["artifact:r:readme"]["title"], by["artifact:r:readme"]["summary"]) == ("My + project", "First paragraph.")
    assert by["artifact:r:architecture"]["summary"] == "Architecture reference directory with 2 document(s): a.md, b c.md."
    assert by["artifact:r:backlog"]["summary"] == "Project backlog for bridge with themes, epics, and stories." and "project" in by["artifact:r:backlog"]["props_json"]
    assert {(e["from_id"], e["to_id"]) for e in edges} == {(n, "repo:r") for n in by if n != "repo:r"}
    e = Engine(spark, f"file://{tmp_path}/g", repository="r")
    first, again = e.seed_repository(f"file://{root}", META)["result"], e.seed_repository(f"file://{root}", META)["result"]
    assert first["written"] and first["nodes"] == {"created": 4} and first["found"] == ["README.md", "docs/architecture", "docs/plan/backlog.yaml"]
    assert not again["written"]
    (root / "README.md").write_text("# Other\n\nText.")
    assert e.seed_repository(f"file://{root}", META)["result"]["written"]


def test_baseline_of_an_empty_root(spark, tmp_path):
    nodes, edges = seed.baseline(spark, f"file://{tmp_path}", "r")
    assert [n["id"] for n in nodes] == ["repo:r"] and edges == []
    os.makedirs(tmp_path / "README.md")
    with pytest.raises(ValueError, match="must be a file"):
        seed.baseline(spark, f"file://{tmp_path}", "r")


def _log(folder, session, *lines):
    os.makedirs(folder / session)
    (folder / session / "events.jsonl").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")


def _shut(model, **tokens):
    return {"type": "session.shutdown", "data": {"currentModel": model, "modelMetrics": {m: {"usage": {"inputTokens": a, "outputTokens": b}} for m, (a, b) in tokens.items()}}}


def test_usage_of_many_sessions(spark, tmp_path):
    _log(tmp_path, "one", {"type": "user"}, "not json", _shut("m", m=(1, 1)), _shut("m", m=(10, 5), k=(7, 7)), {"type": "later"})
    _log(tmp_path, "two", _shut("gone", m=(3, 4)))
    _log(tmp_path, "three", _shut("gone", m=(3, 4), k=(1, 2)))
    _log(tmp_path, "four", {"type": "user"}, "{")
    _log(tmp_path, "five", _shut("m", m=(0, 4)))
    rows = lambda df: {r["session_id"]: (r["model"], r["total_tokens"], r["problem"]) for r in df.collect()}
    assert rows(ledger.session_usages(spark, f"file://{tmp_path}")) == {
        "one": ("m", 15, None), "two": ("m", 7, None), "three": (None, None, "model_metrics_not_found"),
        "four": (None, None, "session_usage_unavailable"), "five": (None, None, "session_usage_incomplete"),
    }
    asked = spark.createDataFrame([("one", "k"), ("three", "k"), ("two", None), ("ghost", "m")], "session_id string, model string")
    got = rows(ledger.session_usages(spark, f"file://{tmp_path}", asked))
    assert (got["one"], got["three"], got["two"], got["ghost"]) == (("k", 14, None), ("k", 3, None), ("m", 7, None), (None, None, "session_log_not_found"))
    assert ledger.session_usages(spark, f"file://{tmp_path}/none").isEmpty()
    for name in ("one", "two"):  # as one log at a time
        assert ledger.session_usage(spark, f"file://{tmp_path}/{name}/events.jsonl")["total_tokens"] == rows(ledger.session_usages(spark, f"file://{tmp_path}"))[name][1]


def _run(scenario, run_id, mode, version="v1", **metrics):
    values = {"input_tokens": 5, "output_tokens": 2, "prompt_count": 1, "prompt_characters": 9, "step_count": 3, "quality_rating": "good", "resumability_rating": "fine", "acceptance_checks_passed": 1, "acceptance_checks_total": 2} | metrics
    part = lambda *names: {n: values.get(n) for n in names}
    volume = part("input_tokens", "output_tokens", "prompt_count", "prompt_characters")
    orientation = part("step_count", "repo_scans", "follow_up_prompts", "context_reloads")
    outcome = part("quality_rating", "resumability_rating", "acceptance_checks_passed", "acceptance_checks_total")
    return {"schema_version": version, "kind": None, "run_id": run_id, "scenario_id": scenario, "mode": mode, "metrics": {"volume": volume, "orientation": orientation, "outcome": outcome}}


def test_summary_of_stored_scenarios(spark, tmp_path):
    base = tmp_path / "benchmarks"
    two = [{"mode": "With_Graph", "task_prompt": "p"}, {"mode": "without_graph ", "task_prompt": "q"}]

    def put(scenario, runs, modes=two):
        os.makedirs(base / "scenarios", exist_ok=True)
        os.makedirs(base / "runs" / scenario)
        (base / "scenarios" / f"{scenario}.json").write_text(json.dumps({"schema_version": " v1", "scenario_id": scenario, "modes": modes}))
        for k, run in enumerate(runs):
            (base / "runs" / scenario / f"{k}.json").write_text(json.dumps(run))

    put("fine", [_run("fine", "a", "with_graph"), _run("fine", "b", "Without_Graph", input_tokens=9, quality_rating="poor", repo_scans=4)])
    put("lacking", [_run("lacking", "a", "with_graph", prompt_count=None, acceptance_checks_passed=3), _run("lacking", "b", "without_graph")])
    put("half", [_run("half", "a", "with_graph", prompt_count=0)])
    put("twice", [_run("twice", "a", "with_graph"), _run("twice", "b", "with_graph"), _run("twice", "c", "without_graph")])
    put("odd", [_run("other", "a", "with_graph"), _run("", "b", "third"), _run("odd", "c", "third", "v7")], [{"mode": "", "task_prompt": ""}, {"mode": "x", "task_prompt": ""}, two[0], two[0]])
    e = Engine(spark, f"file://{tmp_path}")
    fine = e.benchmark_summary("fine")["result"]
    assert fine["comparable"] and fine["issues"] == [] and [(r["mode"], r["run_id"]) for r in fine["runs"]] == [("with_graph", "a"), ("without_graph", "b")]
    by = {r["metric"]: r for r in fine["comparison"]}
    assert [r["metric"] for r in fine["comparison"]] == [m for m, *_ in B.METRICS]
    assert by["volume.input_tokens"]["delta"] == -4 and by["orientation.repo_scans"]["delta"] == -4 and by["outcome.quality_rating"]["matches"] is False and by["outcome.resumability_rating"]["matches"] is True
    lacking = e.benchmark_summary("lacking")["result"]
    assert lacking["status"] == "incomplete" and lacking["comparison"] == []
    assert [(x["code"], x["run_id"], x["fields"]) for x in lacking["issues"]] == [("missing_comparison_fields", "a", ["metrics.volume.prompt_count", "metrics.outcome.acceptance_checks_passed"])]
    assert [x["code"] for x in e.benchmark_summary("half")["result"]["issues"]] == ["missing_mode_run"]
    twice = e.benchmark_summary("twice")["result"]
    assert (twice["status"], twice["issues"][0]["code"], twice["issues"][0]["n"]) == ("non_comparable", "multiple_mode_runs", 2)
    odd = sorted(x["code"] for x in e.benchmark_summary("odd")["result"]["issues"])
    assert odd == ["duplicate_scenario_mode", "missing_mode_run", "missing_mode_run", "run_scenario_id_missing", "run_scenario_mismatch", "scenario_mode_missing", "scenario_mode_missing", "unsupported_run_mode", "unsupported_run_schema", "unsupported_scenario_mode"]
    kept, made = ledger.benchmark_tables(spark, f"file://{base}")
    status = B.benchmark_status(kept, B.benchmark_issues(kept, made))
    assert {r["scenario_id"]: r["status"] for r in status.collect()} == {"fine": "comparable", "lacking": "incomplete", "half": "incomplete", "twice": "non_comparable", "odd": "non_comparable"}
    assert e.benchmark_summary("ghost")["error"]["code"] == "benchmark_scenario_not_found"
    present = {(r["mode"], r["metric"]): r["present"] for r in B.metric_rows(made.where("of = 'fine'"), "mode").collect()}
    assert present["without_graph", "orientation.repo_scans"] and not present["with_graph", "orientation.repo_scans"]


def test_workspace_has_one_identity(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/w", repository="one")
    assert e.open()["error"]["code"] == "workspace_not_initialized"
    told = e.start("Audit graph stats", "2026-01-01T00:00:00Z")["result"]
    assert told["readiness"]["reasons"] == ["workspace_not_initialized"] and told["recommendation"]["what"] == "bootstrap"
    assert [e.init()["result"]["already_exists"] for _ in range(2)] == [False, True] and e.open()["result"]["repository"] == "one"
    other = Engine(spark, e.base, repository="two")
    assert other.open()["error"]["code"] == other.init()["error"]["code"] == "workspace_mismatch"


def test_batch_of_runs_with_usage_of_their_sessions(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/w")
    e.lab_init()
    e.files.write_json("lab/suite.json", {"schema_version": "v1", "suite_id": "s", "tasks": [{"task_id": t, "family": "verification_audit", "description": f"Audit {t}", "acceptance_criteria_ref": "r"} for t in ("t1", "t2")]})
    at = "2026-01-01T00:00:00Z"
    plan = e.lab_plan(7, at)["result"]
    assert len(plan["entries"]) == 10
    _log(tmp_path / "logs", "s1", _shut("m", m=(8, 4)))
    _log(tmp_path / "logs", "s2", {"type": "user"})
    own = {"schema_version": "v1", "metadata": META, "task": "T", "summary": "S"}
    out = e.lab_batch(plan["batch_id"], "m", "delegated", at, at, outcomes={1: json.dumps(own)}, sessions={1: "s1", 2: "s2", 3: "ghost"}, logs=f"file://{tmp_path}/logs")["result"]
    assert out["failed"] == 0 and len({r["run_id"] for r in out["runs"]}) == 10
    runs = {r["run_id"]: r for r in ledger.runs(spark, f"{e.base}/lab").collect()}
    by = {r["entry"]: runs[r["run_id"]]["telemetry"] for r in out["runs"]}
    assert (by[1]["measurement_status"], by[1]["total_tokens"]) == ("complete", 12)
    assert by[2]["incomplete_reasons"] == ["session_usage_unavailable"] and by[3]["incomplete_reasons"] == ["session_log_not_found"]
    assert e.lab_batch("ghost", "m", "delegated", at, at)["error"]["code"] == "batch_plan_not_found"
