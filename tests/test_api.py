import json

import pytest

from quillgraph.api import Engine
from quillgraph.operators import finish
from quillgraph.sources import ledger
from quillgraph.sources.payload import PayloadError, bulk_violations, parse_edge, parse_node, validate
from quillgraph.streaming.streams import decision_counts, distinct_events, ingest_payloads

META = {"agent_id": "a", "session_id": "s", "timestamp": "2026-03-21T14:00:00Z"}
NOW = "2026-03-22T14:00:00Z"


def payload(nodes=(), edges=(), **more):
    return json.dumps({"schema_version": "v1", "metadata": META, "nodes": list(nodes), "edges": list(edges)} | more)


AUTH = payload(
    [
        {"id": "component:authentication", "type": "Subsystem", "title": "Authentication subsystem", "summary": "Handles user authentication", "tags": ["security", " "]},
        {"id": "service:login-api", "kind": "Service", "properties": {"title": "Login API", "summary": "Accepts login requests and depends on the authentication subsystem"}},
        {"id": "service:billing", "kind": "Service", "title": "Billing service", "owner": "x"},
    ],
    [{"source": "service:login-api", "kind": "DEPENDS_ON", "target": "component:authentication", "weight": 1}],
)


@pytest.mark.parametrize(
    "text, code",
    [
        ("{", "malformed_json"),
        ("[]", "invalid_payload_shape"),
        ("{}", "missing_required_fields"),
        (payload(schema_version="v9"), "unsupported_schema_version"),
        (payload(metadata=META | {"timestamp": "2026-01-01"}), "invalid_timestamp"),
        (payload().replace('"nodes": []', '"nodes": {}'), "invalid_payload_shape"),
    ],
)
def test_payload_errors(text, code):
    with pytest.raises(PayloadError) as e:
        validate(text)
    assert e.value.code == code


def test_node_and_edge_rows():
    row = parse_node({"id": " a ", "type": "T", "properties": {"title": "p", "x": 1}, "props": {"x": 2}, "y": 3, "tags": ["b", 1]})
    assert row == ("a", "T", "p", None, None, None, None, None, '{"tags":["b",1],"x":2,"y":3}')
    assert parse_edge({"source": "a", "target": "b", "kind": "K", "w": 1}) == ("a", "K", "b", '{"w":1}')
    for bad, code in (({"id": "a"}, "invalid_node_payload"), ({"id": 1, "kind": "x"}, "invalid_node_payload"), ({"id": "a", "kind": "ReasoningUnit"}, "incomplete_provenance")):
        with pytest.raises(PayloadError) as e:
            parse_node(bad)
        assert e.value.code == code


def test_bulk_validation(spark):
    df = spark.createDataFrame([(payload(),), ("{",), (payload(schema_version="v2"),)], "payload string")
    assert [sorted(v["field"] for v in r["violations"])[:1] for r in bulk_violations(df).collect()] == [[], ["edges"], ["schema_version"]]


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, f"file://{tmp_path_factory.mktemp('engine')}")
    assert e.write(AUTH)["result"]["nodes"] == {"created": 3}
    return e


def test_query_context_explain(engine):
    got = engine.query("what depends on auth?")
    assert got["status"] == "ok" and [r["id"] for r in got["result"]["results"]][0] == "service:login-api"
    packed = engine.context("what depends on auth?", NOW, 200)["result"]
    assert packed["decision"] == "continue" and packed["context"]["estimated_tokens"] <= 200 and packed["attribution"]["scores"]
    assert engine.explain("what depends on auth?")["result"]["reasons"][0]["type"] == "text_match"
    assert engine.context("auth", NOW, 0)["error"]["code"] == "invalid_argument"
    assert engine.query(" ")["status"] == "error"


def test_failed_write_is_an_envelope(engine):
    bad = engine.write(payload([], [{"from": "x", "kind": "K", "to": "y"}]))
    assert bad["error"]["code"] == "unresolved_relationship_endpoint" and engine.stats()["result"]["nodes"] == 3


def test_hygiene_cycle(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/e")
    pair = lambda i, v: {"id": f"adr:db-{v}", "kind": "ADR", "title": "Database choice for persistence", "summary": f"{i} selected as primary database", "value": i.lower()}
    e.write(payload([pair("PostgreSQL", "postgres"), pair("MySQL", "mysql"), {"id": "service:api", "kind": "Service", "title": "API"}], [{"from": "adr:db-postgres", "kind": "CONTRADICTS", "to": "adr:db-mysql"}, {"from": "service:api", "kind": "DEPENDS_ON", "to": "adr:db-postgres"}]))
    plan = e.hygiene()
    assert [a["id"] for a in plan["result"]["actions"]] == ["contradiction:adr:db-postgres"]
    assert e.apply(plan, META, ["nope"])["error"]["code"] == "unknown_action"
    done = e.apply(plan, META | {"timestamp": NOW})
    assert done["status"] == "ok", done
    stats = e.stats()["result"]
    assert (stats["nodes"], stats["edges"]) == (2, 1)
    assert e.store.graph().entities.where("id = 'adr:db-postgres'").head()["summary"] == "postgresql"
    assert e.apply(plan, META)["error"]["code"] == "stale_plan"


def test_start_and_finish(engine):
    got = engine.start("Audit graph stats counts", NOW)["result"]
    assert got["task"]["subprofile"] == "stats_audit" and got["advisory"]["effective_mode"] in ("abstain", "minimal")
    done = {"schema_version": "v1", "metadata": META | {"revision": {"properties": {"execution_usage": {"input_tokens": 8200, "output_tokens": 1800, "total_tokens": 10000}}}}, "task": "T", "summary": "S", "decisions": [{"summary": "use spark", "rationale": "scale"}], "changed_artifacts": [{"path": "a/./b.py", "summary": "x"}], "follow_up": [{"summary": "more"}]}
    assert engine.finish(json.dumps(done), 0.6)["result"]["gate"]["write_status"] == "deferred"
    out = engine.finish(json.dumps(done), 0.9)["result"]
    assert out["summary"]["nodes"] == {"kept": 3, "created": 4} and out["telemetry"]["measurement_status"] == "complete"
    assert engine.finish(json.dumps(done | {"decisions": [], "changed_artifacts": [], "follow_up": []}))["result"]["reason"] == "no_items"
    assert engine.finish(json.dumps(done | {"extra": 1}))["error"]["code"] == "unknown_fields"
    for path in ("../x", "/x", "..\\x", "C:\\x", "."):
        with pytest.raises(PayloadError):
            finish.safe_path(path)


def test_report_and_ledger(spark, tmp_path):
    base = tmp_path / "lab"
    (base / "runs" / "r1").mkdir(parents=True)
    (base / "runs" / "batches" / "b").mkdir(parents=True)
    (base / "evaluations").mkdir()

    def run(i, condition, seed, tokens):
        return {"schema_version": "v1", "run_id": i, "task_id": "t1", "condition_id": condition, "model": "m", "session_topology": "d", "seed": seed, "prompt_variant": "p", "started_at": "2026-01-01T00:00:00Z", "finished_at": "2026-01-01T00:01:00Z", "telemetry": {"measurement_status": "complete", "source": "lab", "total_tokens": tokens, "input_tokens": 1, "output_tokens": 1, "wall_clock_seconds": 60, "retry_count": 0, "delegated_sessions": 1}, "kickoff_inputs_ref": "a", "session_structure_ref": "b", "writeback_outputs_ref": "c", "outcome_artifacts_ref": "d"}

    (base / "runs" / "r1" / "run.json").write_text(json.dumps(run("r1", "with-graph", 1, 100)))
    (base / "runs" / "r2.json").write_text(json.dumps(run("r2", "without-graph", 1, 150)))
    (base / "runs" / "batches" / "b" / "run.json").write_text(json.dumps(run("rx", "with-graph", 1, 1)))
    score = lambda q: {"schema_version": "v1", "evaluator": "e", "evaluated_at": "2026-01-02T00:00:00Z", "scores": {"success": True, "quality_score": q, "resumability_score": q, "human_intervention_count": 0}}
    for i, q in (("r1", 0.9), ("r2", 0.7)):
        (base / "evaluations" / f"{i}.json").write_text(json.dumps({"schema_version": "v1", "run_id": i, "records": [score(0.1) | {"run_id": i}, score(q) | {"run_id": i}]}))
    (base / "suite.json").write_text(json.dumps({"schema_version": "v1", "suite_id": "s", "tasks": [{"task_id": "t1", "family": "f", "description": "d", "acceptance_criteria_ref": "r"}]}))
    (base / "conditions.json").write_text(json.dumps({"schema_version": "v1", "conditions": [{"condition_id": c, "workflow_mode": m, "description": d} for c, m, d in ledger.DEFAULT_CONDITIONS], "blocking_factors": ledger.FACTORS}))
    out = Engine(spark, f"file://{tmp_path}").report()
    assert out["status"] == "ok", out
    metric = {m["metric"]: m for m in out["result"]["metrics"]}
    assert round(metric["quality_score"]["mean_delta"], 6) == 0.2 and metric["total_tokens"]["mean_delta"] == -50 and out["result"]["counters"]["runs"] == 2
    at = f"file://{base}"
    checked = ledger.run_violations(ledger.runs(spark, at), ledger.tasks(spark, at), ledger.conditions(spark, at))
    assert all(r["violations"] == [] for r in checked.collect())
    assert ledger.manifest_violations({"schema_version": "v1", "suite_id": "s", "tasks": [{"task_id": "t"}, {"task_id": "t", "family": "f", "description": "d", "acceptance_criteria_ref": "r"}]})[-1] == ("tasks[1].task_id", "task_id must be unique")
    with pytest.raises(Exception, match="r1"):
        ledger.append_runs(ledger.runs(spark, at).where("run_id = 'r1'"), ledger.runs(spark, at), f"{tmp_path}/new")


def test_session_usage(spark, tmp_path):
    log = tmp_path / "events.jsonl"
    shut = lambda n: json.dumps({"type": "session.shutdown", "data": {"currentModel": "m", "modelMetrics": {"m": {"usage": {"inputTokens": n, "outputTokens": 300, "cacheReadTokens": 400, "cacheWriteTokens": 0}}}}})
    log.write_text("\n".join([json.dumps({"type": "x", "data": {}}), shut(5), shut(1200), ""]))
    got = ledger.session_usage(spark, str(log))
    assert (got["input_tokens"], got["output_tokens"], got["total_tokens"], got["cache_read_tokens"]) == (1200, 300, 1500, 400)


def test_streams(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/e")
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.json").write_text(AUTH)
    for _ in range(2):
        ingest_payloads(spark, str(folder), e.store, str(tmp_path / "check")).awaitTermination()
    assert e.store.graph().entities.count() == 3 and e.store.revisions().count() == 1
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source = tmp_path / "events"
    events.write.parquet(str(source))
    stream = distinct_events(spark.readStream.schema(events.schema).parquet(str(source)))
    q = stream.writeStream.format("memory").queryName("seen").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("seen").count() == events.count()
    counted = decision_counts(spark.readStream.schema(events.schema).parquet(str(source))).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    counted.awaitTermination()
    assert sorted(map(tuple, spark.table("counts").select("start", "event_type", "n").collect())) == sorted(map(tuple, decision_counts(events).select("start", "event_type", "n").collect()))


def test_lab_cycle(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/e")
    assert e.lab_init()["result"]["manifests"] == {"suite.json": "installed", "conditions.json": "installed"}
    assert e.lab_init()["result"]["manifests"] == {"suite.json": "preserved", "conditions.json": "preserved"}
    e.files.write_json("lab/suite.json", {"schema_version": "v1", "suite_id": "s", "tasks": [{"task_id": "t1", "family": "f", "description": "d", "acceptance_criteria_ref": "r"}]})
    plan = e.lab_plan(7, "2026-01-01T00:00:00Z")["result"]
    assert len(plan["entries"]) == 5 and plan["entries"] == e.lab_plan(7, "2026-01-01T00:00:00Z")["result"]["entries"]
    outcome = json.dumps({"schema_version": "v1", "metadata": META | {"revision": {"properties": {"execution_usage": {"input_tokens": 1, "output_tokens": 2, "total_tokens": 3}}}}, "task": "T", "summary": "S"})
    one = e.lab_run("t1", "with-graph", "m", "d", 1, "2026-01-01T00:00:00Z", "2026-01-01T00:00:00Z", "do it", outcome)["result"]
    two = e.lab_run("t1", "without-graph", "m", "d", 1, "2026-01-01T00:00:00Z", "2026-01-01T00:02:00Z", "do it")["result"]
    assert (one["run_id"], two["run_id"]) == ("run-20260101t000000z", "run-20260101t000000z-02")
    assert one["telemetry"]["measurement_status"] == "complete" and one["telemetry"]["wall_clock_seconds"] == 1
    assert two["telemetry"]["incomplete_reasons"] == ["baseline_run_did_not_receive_execution_outcome"]
    blind = e.lab_present(one["run_id"])["result"]
    assert "condition" not in blind and "graph_backed" not in blind["artifacts"]["writeback_outputs"]
    assert e.lab_present(two["run_id"], False)["result"]["condition"]["workflow_mode"] == "baseline"
    score = {"schema_version": "v1", "run_id": one["run_id"], "evaluator": "e", "evaluated_at": NOW, "scores": {"success": True, "quality_score": 0.5, "resumability_score": 0.5, "human_intervention_count": 0}}
    assert e.lab_evaluate(score)["result"]["evaluations"] == 1 and e.lab_evaluate(score)["result"]["evaluations"] == 2
    assert e.lab_evaluate(score | {"run_id": "ghost"})["status"] == "error"
    report = e.report()["result"]
    assert report["counters"] == {"runs": 2, "scored": 1, "unscored": 1} and report["warnings"] == ["missing_evaluations"]


def test_managed_assets(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/e")
    assert e.init_workflow({"a.md": "1", "b.md": "2"})["result"]["installed"] == ["workflow/assets/a.md", "workflow/assets/b.md"]
    again = e.init_workflow({"a.md": "1", "b.md": "3"}, ["b.md"])["result"]
    assert (again["skipped"], again["preserved"], e.files.read("workflow/assets/b.md")) == (["workflow/assets/a.md"], ["workflow/assets/b.md"], "2")
    assert e.init_workflow({"a.md": "1", "b.md": "3"})["result"]["refreshed"] == ["workflow/assets/b.md"]


def test_levels_of_overlapping_actions():
    """Two hundred actions in fifty chains of four take four rounds, and nothing moves past an action that it shares a node with."""
    import random

    from quillgraph.api import Engine

    actions = [{"id": f"{c}.{k}", "target_ids": [f"n{c}.{k}", f"n{c}.{k + 1}"], "canonical_id": f"n{c}.{k}"} for k in range(4) for c in range(50)]
    levels = Engine._levels(actions)
    assert len(levels) == 4 and sum(map(len, levels)) == 200
    r = random.Random(2)
    actions = [{"id": str(i), "target_ids": [f"n{x}" for x in r.sample(range(60), r.randint(1, 3))], "canonical_id": None} for i in range(200)]
    place = {a["id"]: k for k, level in enumerate(Engine._levels(actions)) for a in level}
    for i, a in enumerate(actions):
        for b in actions[i + 1 :]:
            assert not set(a["target_ids"]) & set(b["target_ids"]) or place[a["id"]] < place[b["id"]]


def test_commands_leave_no_staged_tables(spark, graph, tmp_path):
    import os

    from quillgraph.api import Engine
    from quillgraph.sources.files import shared_dir

    e = Engine(spark, f"file://{tmp_path}/w")
    e.store.write(*graph, META)
    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    assert e.query("what depends on auth?")["status"] == "ok" and e.stats()["status"] == "ok" and e.hygiene()["status"] == "ok"
    assert {n for n in os.listdir(folder) if not n.startswith(".")} <= before
