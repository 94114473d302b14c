import pytest

from quillgraph.api import Engine
from quillgraph.sources import bench_files
from quillgraph.sources.store import StoreError

NOW = "2026-01-01T00:00:00Z"
SCENARIO = {"scenario_id": " s1 ", "task_family": "f", "modes": [{"mode": " Without_Graph ", "task_prompt": " b "}, {"mode": "WITH_GRAPH", "task_prompt": "a", "notes": [" n ", " "]}]}
RUN = {"run_id": "r1", "mode": "with_graph", "metrics": {"volume": {"input_tokens": 5}, "orientation": {"step_count": 1}, "outcome": {"quality_rating": " good "}}}


def test_normal_forms():
    kept = bench_files.scenario(SCENARIO, NOW)
    assert kept["scenario_id"] == "s1" and kept["created_at"] == NOW and [(m["mode"], m["task_prompt"], m["notes"]) for m in kept["modes"]] == [("with_graph", "a", ["n"]), ("without_graph", "b", [])]
    run = bench_files.run(RUN, kept, NOW)
    assert run["scenario_id"] == "s1" and run["metrics"]["outcome"]["quality_rating"] == "good" and run["metrics"]["volume"]["output_tokens"] == 0


@pytest.mark.parametrize("change", [{"schema_version": "v2"}, {"kind": "x"}, {"scenario_id": "../x"}, {"scenario_id": ""}, {"task_family": " "}, {"modes": []}, {"modes": [SCENARIO["modes"][0]] * 2}, {"modes": [{"mode": "x", "task_prompt": "p"}, SCENARIO["modes"][0]]}, {"modes": [{"mode": "with_graph"}, SCENARIO["modes"][0]]}])
def test_bad_scenarios(change):
    with pytest.raises(StoreError) as e:
        bench_files.scenario(SCENARIO | change, NOW)
    assert e.value.code == "invalid_benchmark_scenario"


def _metrics(part, **values):
    return {"metrics": RUN["metrics"] | {part: values}}


@pytest.mark.parametrize("change", [{"schema_version": "v2"}, {"kind": "x"}, {"run_id": "a/b"}, {"scenario_id": "other"}, {"mode": "x"}, _metrics("volume"), _metrics("volume", input_tokens=-1), _metrics("orientation", step_count=0), _metrics("orientation", step_count=1, repo_scans=-1), _metrics("outcome"), _metrics("outcome", quality_rating="g", acceptance_checks_passed=2, acceptance_checks_total=1)])
def test_bad_runs(change):
    with pytest.raises(StoreError) as e:
        bench_files.run(RUN | change, bench_files.scenario(SCENARIO, NOW), NOW)
    assert e.value.code == "invalid_benchmark_report"


def test_written_and_compared(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}")
    assert e.write_benchmark_run("s1", RUN, NOW)["error"]["code"] == "benchmark_scenario_not_found"
    e.write_scenario(SCENARIO, NOW)
    for mode, tokens in (("with_graph", 5), ("without_graph", 9)):
        assert e.write_benchmark_run("s1", RUN | {"run_id": mode, "mode": mode} | _metrics("volume", input_tokens=tokens), NOW)["status"] == "ok"
    got = e.benchmark("s1")["result"]
    assert (got["status"], got["input_tokens_delta"]) == ("comparable", -4)
    assert [s["scenario_id"] for s in e.scenarios()["result"]["scenarios"]] == ["s1"]
