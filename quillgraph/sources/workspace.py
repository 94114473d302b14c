"""Small files of a workspace: managed assets, lab scaffolding, run artifacts and their presentation."""

from __future__ import annotations

import hashlib
import json
import re
from datetime import datetime, timezone

from pyspark.sql import SparkSession

from ..operators.blinding import REVEALING, sanitized
from . import files, ledger
from .store import StoreError


class Files:
    """Text files under a base path, through Hadoop's file system, so that any shared store will do."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = files.file_system(spark, self.base)

    def read(self, name: str) -> str | None:
        return files.read_text(self.spark, f"{self.base}/{name}")

    def read_json(self, name: str) -> dict | None:
        """A JSON file; None if it is absent or not JSON."""
        try:
            return json.loads(text) if (text := self.read(name)) else None
        except ValueError:
            return None

    def write(self, name: str, text: str) -> None:
        files.write_text(self.spark, f"{self.base}/{name}", text)

    def write_json(self, name: str, value: object) -> None:
        self.write(name, json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True))

    def names(self, folder: str) -> list[str]:
        """Relative paths of all files below a folder, sorted."""
        root = self._path(f"{self.base}/{folder}")
        if not self._fs.exists(root):
            return []
        found, out = self._fs.listFiles(root, True), []
        prefix = self._fs.makeQualified(root).toString().rstrip("/") + "/"
        while found.hasNext():
            out.append(found.next().getPath().toString().removeprefix(prefix))
        return sorted(out)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def ensure_assets(files: Files, wanted: dict[str, str], overrides: set[str] = frozenset()) -> dict:
    """Install or refresh managed files whose digest differs; overridden ones are preserved. Returns the paths by action and the manifest's assets."""
    out: dict[str, list[str]] = {"installed": [], "refreshed": [], "skipped": [], "preserved": []}
    for path, text in sorted(wanted.items()):
        have = files.read(path)
        action = "preserved" if path in overrides else "installed" if have is None else "skipped" if digest(have) == digest(text) else "refreshed"
        if action in ("installed", "refreshed"):
            files.write(path, text)
        out[action].append(path)
    assets = [{"path": p, "status": "preserved" if p in overrides else "installed", "digest": None if p in overrides else digest(t)} for p, t in sorted(wanted.items())]
    return {**out, "assets": assets}


def init_lab(files: Files) -> dict:
    """Write an empty suite and the default conditions where they are absent or invalid; keep valid ones and everything else."""
    suite = {"schema_version": "v1", "suite_id": "default", "tasks": []}
    conditions = {"schema_version": "v1", "conditions": [{"condition_id": c, "workflow_mode": m, "description": d} for c, m, d in ledger.DEFAULT_CONDITIONS], "blocking_factors": ledger.FACTORS}
    out: dict[str, str] = {}
    for name, default, check in (("suite.json", suite, lambda d: ledger.manifest_violations(suite=d)), ("conditions.json", conditions, lambda d: ledger.manifest_violations(conditions_=d))):
        have = files.read(f"lab/{name}")
        valid = have is not None and (doc := files.read_json(f"lab/{name}")) is not None and not check(doc)
        if not valid:
            files.write_json(f"lab/{name}", default)
        out[name] = "preserved" if valid else "installed" if have is None else "refreshed"
    return {"manifests": out, "preserved": [n for n in files.names("lab") if n not in ("suite.json", "conditions.json")]}


def free_id(files: Files, prefix: str, at: str, folder: str) -> str:
    """prefix-<compact UTC time>, with -02, -03 and so on while it is taken."""
    stamp = datetime.fromisoformat(at.replace("Z", "+00:00")).astimezone(timezone.utc).strftime("%Y%m%dt%H%M%Sz")
    taken = {n.split("/")[0].removesuffix(".json") for n in files.names(folder)}
    name, k = f"{prefix}-{stamp}", 2
    while name in taken:
        name, k = f"{prefix}-{stamp}-{k:02d}", k + 1
    return name


def run_telemetry(usage: dict | None, started: str, finished: str, graph_backed: bool, outcome_given: bool) -> dict:
    """A run's telemetry from its outcome's usage; without one, why there is none. The clock shows one second at least."""
    parse = lambda t: datetime.fromisoformat(t.replace("Z", "+00:00"))
    out = {"measurement_status": "unavailable", "source": "lab_run", "wall_clock_seconds": max(1, int((parse(finished) - parse(started)).total_seconds())), "retry_count": 0, "delegated_sessions": 2 if graph_backed else 1}
    if not outcome_given:
        return out | {"incomplete_reasons": ["synthetic_finish_payload_carries_no_execution_usage" if graph_backed else "baseline_run_did_not_receive_execution_outcome"]}
    if usage is None:
        return out | {"source": "finish_input", "incomplete_reasons": ["outcome_payload_has_no_execution_usage"]}
    return out | usage


def prompt_metadata(prompt: str) -> dict:
    return {"character_count": len(prompt.encode()), "word_count": len(prompt.split())}


def record_run(files: Files, record: dict, artifacts: dict[str, object]) -> str:
    """Write a run's artifacts and, last, its record; a known run id is refused."""
    run_id = record["run_id"]
    if not re.match(r"^[A-Za-z0-9][A-Za-z0-9._-]*$", run_id) or ".." in run_id:
        raise StoreError("record_validation_failed", "run_id must be a safe identifier")
    if files.read(f"lab/runs/{run_id}/run.json") is not None:
        raise StoreError("run_already_exists", run_id)
    for name, value in artifacts.items():
        files.write_json(f"lab/runs/{run_id}/{name}", value)
    files.write_json(f"lab/runs/{run_id}/run.json", record)
    return f"lab/runs/{run_id}/run.json"


def add_evaluation(files: Files, record: dict) -> int:
    """Append an evaluation to its run's history; returns how many there are."""
    name = f"lab/evaluations/{record['run_id']}.json"
    have = files.read_json(name) or {"schema_version": "v1", "run_id": record["run_id"], "records": []}
    have["records"].append(record)
    files.write_json(name, have)
    return len(have["records"])


def present(files: Files, run_id: str, blind: bool) -> dict:
    """What an evaluator sees of a run: its task and artifacts, and its condition unless the view is blind."""
    paths = [f"lab/runs/{run_id}/run.json", f"lab/runs/{run_id}.json"]
    record = next((r for p in paths if (r := files.read_json(p))), None)
    if record is None:
        raise StoreError("run_not_found", run_id)
    suite, conditions = files.read_json("lab/suite.json") or {}, files.read_json("lab/conditions.json") or {}
    task = next((t for t in suite.get("tasks", []) if t["task_id"] == record["task_id"]), None)
    if task is None:
        raise StoreError("record_validation_failed", "task_id must reference an existing suite task")
    root = f"lab/runs/{run_id}/"
    parts = {"writeback_outputs": files.read_json(root + record["writeback_outputs_ref"]), "outcome_summary": files.read_json(root + record["outcome_artifacts_ref"] + "/summary.json")}
    out = {"run_id": run_id, "blind": blind, "task": {k: task.get(k) for k in ("task_id", "description", "acceptance_criteria_ref")}}
    if blind:
        return out | {"artifacts": sanitized(parts), "hidden_fields": REVEALING}
    mode = next((c["workflow_mode"] for c in conditions.get("conditions", []) if c["condition_id"] == record["condition_id"]), "")
    return out | {"artifacts": parts, "condition": {"condition_id": record["condition_id"], "workflow_mode": mode}}
