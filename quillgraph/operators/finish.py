"""The end of a delegated task: its outcome as graph objects, and its execution telemetry."""

from __future__ import annotations

import hashlib
import json
import re

from ..sources.payload import PayloadError, _time_ok
from .seed import cut_bytes

_FIELDS = {"decisions": ("summary", "rationale", "status"), "changed_artifacts": ("path", "summary", "change_type", "language"), "follow_up": ("summary", "owner", "status")}
_NEEDED = {"decisions": ("summary",), "changed_artifacts": ("path", "summary"), "follow_up": ("summary",)}
USAGE = "execution_usage"


def parse(text: str) -> dict:
    """A finish payload with every list present; unknown fields are errors at every level."""
    try:
        doc = json.loads(text)
    except ValueError as e:
        raise PayloadError("malformed_json", str(e)) from None
    if not isinstance(doc, dict):
        raise PayloadError("invalid_payload_shape", "the payload must be an object")
    if odd := sorted(set(doc) - {"schema_version", "metadata", "task", "summary", *_FIELDS}):
        raise PayloadError("unknown_fields", ", ".join(odd))
    meta = doc.get("metadata") or {}
    missing = [n for n in ("schema_version", "task", "summary") if not str(doc.get(n) or "").strip()]
    missing += [f"metadata.{n}" for n in ("agent_id", "session_id", "timestamp") if not str(meta.get(n) or "").strip()]
    if missing:
        raise PayloadError("missing_required_fields", ", ".join(missing))
    if doc["schema_version"] != "v1":
        raise PayloadError("unsupported_schema_version", str(doc["schema_version"]))
    if not _time_ok(meta["timestamp"]):
        raise PayloadError("invalid_timestamp", str(meta["timestamp"]))
    out = {**doc, "task": doc["task"].strip(), "summary": doc["summary"].strip()}
    for name, fields in _FIELDS.items():
        rows = doc.get(name) or []
        if not isinstance(rows, list):
            raise PayloadError("invalid_payload_shape", f"{name} must be an array")
        for i, row in enumerate(rows):
            if not isinstance(row, dict) or set(row) - set(fields) or any(not str(row.get(f) or "").strip() for f in _NEEDED[name]):
                raise PayloadError("invalid_payload_shape", f"{name}[{i}]")
        out[name] = [{f: str(row.get(f) or "").strip() for f in fields} for row in rows]
    for row in out["changed_artifacts"]:
        row["path"] = safe_path(row["path"])
    return out


def safe_path(path: str) -> str:
    """A clean relative path inside the repository."""
    parts: list[str] = []
    plain = path.replace("\\", "/")
    if plain.startswith("/") or re.match(r"^[A-Za-z]:", plain):
        raise PayloadError("invalid_repo_path", path)
    for part in plain.split("/"):
        if part == "..":
            if not parts:
                raise PayloadError("invalid_repo_path", path)
            parts.pop()
        elif part not in ("", "."):
            parts.append(part)
    if not parts:
        raise PayloadError("invalid_repo_path", path)
    return "/".join(parts)


def is_noop(outcome: dict) -> bool:
    return not any(outcome[name] for name in _FIELDS)


def root_id(outcome: dict, repository: str) -> str:
    meta = outcome["metadata"]
    token = re.sub(r"[-_:/]+", "-", re.sub(r"[^a-z0-9\-_:/]", "", meta["session_id"].strip().lower())).strip("-")[:24]
    digest = hashlib.sha256("\n".join([repository, meta["session_id"], meta["timestamp"], outcome["task"], outcome["summary"]]).encode()).hexdigest()
    return f"workflow-finish:{repository}:{token or 'session'}:{digest[:12]}"


def content(outcome: dict) -> str:
    """The reasoning text: task, summary and a section for each list that has entries."""
    out = [f"Task: {outcome['task']}", "", f"Summary: {outcome['summary']}"]
    line = {"decisions": lambda r: f"- {r['summary']}" + (f" — {r['rationale']}" if r["rationale"] else ""), "changed_artifacts": lambda r: f"- {r['path']}: {r['summary']}", "follow_up": lambda r: f"- {r['summary']}"}
    for name, title in (("decisions", "Decisions:"), ("changed_artifacts", "Changed artifacts:"), ("follow_up", "Follow-up:")):
        if outcome[name]:
            out += ["", title, *map(line[name], outcome[name])]
    return "\n".join(out)


def objects(outcome: dict, repository: str) -> tuple[list[dict], list[dict]]:
    """Nodes and edges of an outcome, as payload objects in order of id."""
    root, meta = root_id(outcome, repository), outcome["metadata"]
    counts = {"decision_count": len(outcome["decisions"]), "changed_artifact_count": len(outcome["changed_artifacts"]), "follow_up_count": len(outcome["follow_up"])}
    mark = {"workflow_command": "workflow.finish"}
    own = {n: meta[n] for n in ("agent_id", "session_id", "timestamp")}
    nodes = [{"id": root, "kind": "ReasoningUnit", "title": cut_bytes(outcome["task"], 120), "summary": cut_bytes(outcome["summary"], 240), "content": content(outcome), "tags": ["workflow", "handoff", "delegated"], "props": mark | {"task": outcome["task"]} | counts | own}]
    edges: list[dict] = []

    def add(name: str, link: str, relation: str, make) -> None:
        for i, row in enumerate(outcome[name], 1):
            node = make(row) | {"id": f"{root}:{relation}:{i:02d}"}
            nodes.append(node)
            edges.append({"from": root, "kind": link, "to": node["id"], "props": {"relation": {"decision": "decision", "artifact": "changed_artifact", "follow-up": "follow_up"}[relation]}})

    add("decisions", "RELATES_TO", "decision", lambda r: {"kind": "Decision", "title": cut_bytes(r["summary"], 120), "summary": cut_bytes(r["rationale"] or r["summary"], 240), "tags": ["workflow", "decision"], "props": mark | {"decision": r["summary"], "rationale": r["rationale"], "status": r["status"]}})
    add("changed_artifacts", "ABOUT", "artifact", lambda r: {"kind": "Artifact", "title": r["path"], "summary": cut_bytes(r["summary"], 240), "repo_path": r["path"], "tags": ["workflow", "artifact"], "props": mark | {"path": r["path"], "change_type": r["change_type"]}} | ({"language": r["language"]} if r["language"] else {}))
    add("follow_up", "DEPENDS_ON", "follow-up", lambda r: {"kind": "Task", "title": cut_bytes(r["summary"], 120), "summary": cut_bytes(r["summary"], 240), "tags": ["workflow", "follow-up"], "props": mark | {"owner": r["owner"], "status": r["status"]}})
    return sorted(nodes, key=lambda n: n["id"]), sorted(edges, key=lambda e: (e["from"], e["kind"], e["to"]))


def telemetry(outcome: dict) -> dict | None:
    """Token usage that an outcome reports, with its status inferred where it is not given."""
    properties = ((outcome.get("metadata") or {}).get("revision") or {}).get("properties") or {}
    if USAGE not in properties:
        return None
    raw = properties[USAGE]
    if not isinstance(raw, dict):
        return {"measurement_status": "unavailable", "source": "finish_input", "incomplete_reasons": ["invalid_execution_usage_shape"]}
    out = {"measurement_status": str(raw.get("measurement_status") or "").strip(), "source": str(raw.get("source") or "").strip() or "finish_input", "provider": str(raw.get("provider") or "").strip()}
    known = {n: int(raw[n]) for n in ("input_tokens", "output_tokens", "total_tokens") if isinstance(raw.get(n), (int, float)) and not isinstance(raw.get(n), bool)}
    out |= known
    out["measurement_status"] = out["measurement_status"] or ("complete" if len(known) == 3 else "partial" if known else "unavailable")
    reasons = [r for r in raw.get("incomplete_reasons") or [] if isinstance(r, str)]
    if out["measurement_status"] != "complete":
        out["incomplete_reasons"] = reasons or ["token_measurement_incomplete"]
    return out


def inject(outcome: dict, usage: dict) -> dict:
    """The outcome with a measured usage among its revision's properties, as telemetry() reads it; blank texts and absent counts are left out.

    Another revision property stays as it is; a usage that was reported gives way.
    """
    told = {k: str(usage.get(k) or "").strip() for k in ("measurement_status", "source", "provider")}
    told = {k: v for k, v in told.items() if v or k != "provider"}
    told |= {k: int(usage[k]) for k in ("input_tokens", "output_tokens", "total_tokens") if usage.get(k) is not None}
    if usage.get("incomplete_reasons"):
        told["incomplete_reasons"] = list(usage["incomplete_reasons"])
    meta = outcome.get("metadata") or {}
    revision = meta.get("revision") or {}
    properties = (revision.get("properties") or {}) | {USAGE: told}
    return outcome | {"metadata": meta | {"revision": revision | {"properties": properties}}}


def synthetic(run_id: str, finished: str, task: dict) -> dict:
    """The payload of a controlled run that reports nothing itself (fixed texts)."""
    meta = {"agent_id": "lab-runner", "session_id": run_id, "timestamp": finished}
    lists = {"decisions": [], "changed_artifacts": [], "follow_up": []}
    return {"schema_version": "v1", "metadata": meta, "task": task["description"], "summary": f"Completed controlled run for {task['task_id']}", **lists}
