"""Benchmark scenarios and runs as stored documents: one normal form and one table of rules for each."""

from __future__ import annotations

import re

from .store import StoreError

# Fixed values of the stored documents.
VERSION = "v1"
KINDS = {"scenario": "delegated_workflow_benchmark_scenario", "run": "delegated_workflow_benchmark_run"}
MODES = ("with_graph", "without_graph")

_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")
_VOLUME = ("input_tokens", "output_tokens", "prompt_count", "prompt_characters")
_EFFORT = ("step_count", "repo_scans", "follow_up_prompts", "context_reloads")
_CHECKS = ("acceptance_checks_passed", "acceptance_checks_total")
_RATINGS = ("quality_rating", "resumability_rating")


def _text(value: object) -> str:
    return str(value or "").strip()


def _mode(value: object) -> str:
    return _text(value).lower()


def _notes(values: object) -> list[str]:
    return [n for n in map(_text, values or []) if n]


# The messages of the rules below.
def _checked(code: str, *rules: tuple[object, str]) -> None:
    """The first rule that does not hold is the error."""
    for holds, message in rules:
        if not holds:
            raise StoreError(code, message)


def scenario(document: dict, now: str) -> dict:
    """A scenario in normal form: trimmed texts, its two modes in order of name."""
    texts = {k: _text(document.get(k)) for k in ("scenario_id", "task_family", "title", "acceptance_criteria_ref")}
    out = {"schema_version": _text(document.get("schema_version")) or VERSION, "kind": _text(document.get("kind")) or KINDS["scenario"], **texts, "created_at": _text(document.get("created_at")) or now}
    modes = [{"mode": _mode(m.get("mode")), "task_prompt": _text(m.get("task_prompt")), "notes": _notes(m.get("notes"))} for m in document.get("modes") or []]
    named = sorted(m["mode"] for m in modes)
    _checked(
        "invalid_benchmark_scenario",
        (out["schema_version"] == VERSION, "schema_version is unsupported"),
        (out["kind"] == KINDS["scenario"], "kind is unsupported"),
        (_ID.fullmatch(out["scenario_id"]), "scenario_id must be a safe identifier"),
        (out["task_family"], "task_family is required"),
        (len(modes) == 2, "exactly two comparable workflow modes are needed"),
        (set(named) <= set(MODES), "a mode is unsupported"),
        (named == sorted(MODES), "modes must be unique and include with_graph and without_graph"),
        (all(m["task_prompt"] for m in modes), "every mode requires a task_prompt"),
    )
    return out | {"modes": sorted(modes, key=lambda m: m["mode"])}


def run(document: dict, of: dict, now: str) -> dict:
    """A run of a stored scenario in normal form; absent counts are 0."""
    metrics = document.get("metrics") or {}
    count = lambda part, names: {n: int((metrics.get(part) or {}).get(n) or 0) for n in names}
    volume, effort, checks = count("volume", _VOLUME), count("orientation", _EFFORT), count("outcome", _CHECKS)
    ratings = {n: _text((metrics.get("outcome") or {}).get(n)) for n in _RATINGS}
    out = {
        "schema_version": _text(document.get("schema_version")) or VERSION,
        "kind": _text(document.get("kind")) or KINDS["run"],
        "run_id": _text(document.get("run_id")),
        "scenario_id": _text(document.get("scenario_id")) or of["scenario_id"],
        "mode": _mode(document.get("mode")),
        "recorded_at": _text(document.get("recorded_at")) or now,
        "metrics": {"volume": volume, "orientation": effort, "outcome": ratings | checks},
        "notes": _notes(document.get("notes")),
        "labels": document.get("labels") or {},
    }
    _checked(
        "invalid_benchmark_report",
        (out["schema_version"] == VERSION, "schema_version is unsupported"),
        (out["kind"] == KINDS["run"], "kind is unsupported"),
        (_ID.fullmatch(out["run_id"]), "run_id must be a safe identifier"),
        (out["scenario_id"] == of["scenario_id"], "scenario_id does not match the stored scenario"),
        (out["mode"] in [m["mode"] for m in of["modes"]], "mode is not defined by the stored scenario"),
        (min(volume.values()) >= 0, "volume metrics must be zero or greater"),
        (any(volume.values()), "token or prompt volume metrics are required"),
        (effort["step_count"] > 0 and min(effort.values()) >= 0, "orientation effort metrics are required"),
        (any(ratings.values()), "quality or resumability signals are required"),
        (0 <= checks["acceptance_checks_passed"] <= checks["acceptance_checks_total"], "acceptance check counts are invalid"),
    )
    return out
