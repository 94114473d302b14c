"""Texts of a delegated task's start and end: coverage, guidance, recommendation, delegation brief and handoff brief.

All of it concerns one task, so it is plain Python over counts and packed results.
"""

from __future__ import annotations

ABSTAINED, LOW, GROUNDED = "abstained", "low_context", "grounded"

# Texts of briefs, each under the code that selects it.
_SUMMARY = {
    "explicit_no_kickoff_requested": "Kickoff context was skipped because the caller explicitly requested no kickoff.",
    "low_confidence_abstain": "Kickoff context abstained because the retrieved evidence did not meet the confidence threshold for this task family.",
    "verification_off_profile_contamination": "Kickoff context abstained because the strongest available graph evidence was off-profile for this verification task, so the safer move is to pull graph evidence on demand.",
    "reporting": "This task family defaults to no kickoff context because reporting and synthesis work is currently more vulnerable to retrieval contamination than helped by pushed graph context.",
    "policy": "Kickoff context abstained under the selected family policy.",
    "no_graph": "The graph is not available yet, so this kickoff cannot rely on existing graph context.",
    "no_results": "Graph retrieval found no useful task-specific context for this delegation.",
    "no_room": "The requested token budget is too small to carry even the top-ranked graph result.",
    "weak": "Graph retrieval found only weak task-specific signals, so this kickoff should be treated as low context.",
}
_GUIDE = {
    "fresh": "Start from fresh repository context and pull graph information on demand only if the task later proves to need it.",
    "landmarks": "Use `graph context` on demand once concrete task landmarks emerge, rather than trusting a weak kickoff brief.",
    "audit_target": "Pull graph evidence on demand only after you know which exact audit target must be verified.",
    "reporting": "Treat reporting and synthesis as an abstention-first family until future evidence justifies broader kickoff injection.",
    "no_graph": "Bootstrap baseline graph knowledge before relying on a delegated kickoff brief.",
    "no_room": "Increase --max-tokens so the top-ranked graph result fits into the kickoff context.",
    "sources": "Inspect repository sources such as README.md, docs/architecture/, and the active backlog or story files before delegating.",
    "low": 'Treat "{task}" as a low-context task until concrete graph evidence is gathered.',
    "capture": "Capture newly discovered context explicitly instead of assuming the graph already covers this subtask.",
    "reduced": "Proceed with the reduced kickoff brief and pull more graph context only if the task proves to need it.",
    "audit_pull": "Prefer targeted verification pulls over broad kickoff context for audit work.",
    "hygiene": "Inspect graph hygiene before trusting ambiguous or duplicate-heavy context.",
}


def reason_codes(kind: dict, advice: dict, asked: str) -> list[str]:
    """Codes of an advisory: those of its confidence, then what the request, the policy and the audit rules did."""
    audit = kind["family"] == "verification_audit"
    codes = list(advice["confidence_reasons"])
    dirty, bare = "verification_off_profile_contamination" in codes, "verification_sparse_aligned_evidence" in codes
    asked = (asked or "").strip().lower()
    codes += ["verification_stricter_threshold"] if audit else []
    if asked in ("none", "abstain"):
        codes.append("explicit_no_kickoff_requested")
    elif kind["default_mode"] == "abstain":
        codes.append("family_policy_default_no_kickoff")
    elif asked == "minimal":
        codes.append("minimal_kickoff_selected")
    elif not (advice["confidence"] >= kind["inject_at"] and kind["default_mode"] == "inject"):
        sure = advice["confidence"] >= kind["minimal_at"]
        gives_up = kind["low_mode"] == "abstain" or kind["family"] == "ambiguous_task"
        codes.append("minimal_kickoff_selected" if sure else "low_confidence_abstain" if gives_up else "low_confidence_minimal")
    if audit and dirty and (kind["subprofile"] == "stats_audit" or bare):
        codes.append("verification_contamination_abstain")
    elif audit and dirty and kind["subprofile"] == "workflow_verification":
        codes.append("verification_contamination_minimal")
    return list(dict.fromkeys(codes))


def coverage(mode: str, n_high: int, packed: dict) -> str:
    """abstained, grounded (a strong result, and something fits) or low_context."""
    return ABSTAINED if mode == "abstain" else GROUNDED if n_high and packed["results"] else LOW


def recommended(kind: dict, stats: dict, grounded: bool) -> tuple[str, list[str]]:
    """Readiness for this task: advice to inspect hygiene gives way to what the task's own context says, but for workflow tasks and audits of statistics."""
    what, why = stats["recommendation"], list(stats["reasons"])
    own = kind["family"] == "workflow_context" or (kind["family"], kind["subprofile"]) == ("verification_audit", "stats_audit")
    if what != "inspect_hygiene" or own:
        return what, why
    return ("proceed", ["task_specific_context_grounded", "graph_hygiene_advisory"]) if grounded else ("gather_context", ["task_context_sparse", "graph_hygiene_advisory"])


def kickoff_context(task: str, kind: dict, stats: dict, what: str, codes: list[str], state: str, n_results: int, packed: dict) -> dict:
    """coverage, summary and guidance of a kickoff. Texts of reasons that do not hold are left out; none is said twice."""
    family, shown = kind["family"], len(packed["results"])
    audit, reporting, empty = family == "verification_audit", family == "reporting_synthesis", stats["nodes"] == 0
    if state == ABSTAINED:
        first = next((c for c in ("explicit_no_kickoff_requested", "low_confidence_abstain", "verification_off_profile_contamination") if c in codes), "reporting" if reporting else "policy")
        keys = [("fresh", True), ("landmarks", "low_confidence_abstain" in codes), ("audit_target", audit), ("reporting", reporting)]
        return {"coverage": state, "summary": _SUMMARY[first], "guidance": [_GUIDE[k] for k, holds in keys if holds], "abstention_reason": codes[0] if codes else ""}
    if state == GROUNDED:
        results = f"{shown} result" + ("" if shown == 1 else "s")
        text = f"Projected {results} of task-relevant graph context within the token budget."
        if packed["truncated"]:
            text = f"Projected {results} of the highest-value graph results within the token budget; {packed['omitted_results']} additional result(s) were omitted."
        return {"coverage": state, "summary": text, "guidance": []}
    why = "no_graph" if empty else "no_results" if not n_results else "no_room" if not shown else "weak"
    keys = [
        (why if why in ("no_graph", "no_room") else "sources", True),
        ("low", True),
        ("capture", True),
        ("reduced", bool({"minimal_kickoff_selected", "low_confidence_minimal"} & set(codes))),
        ("audit_pull", audit),
        ("hygiene", what == "inspect_hygiene"),
    ]
    return {"coverage": state, "summary": _SUMMARY[why], "guidance": [_GUIDE[k].format(task=task.strip()) for k, holds in keys if holds]}


def _shown(result: dict) -> list[str]:
    """A packed result in a brief: its name, then indented what is known of it."""
    entity = result["entity"]
    head = f"- {entity.get('title', '').strip() or entity['id']} [{entity['kind']}]"
    links = sorted(r["kind"] + (f" -> {r['peer']}" if r["peer"] else "") for r in result.get("relationships", []))
    more = {"relationships": ", ".join(links), "matched terms": ", ".join(result.get("matched_terms", [])), "included because": result.get("inclusion_reason", "").strip()}
    return [head + (f": {entity['summary'].strip()}" if entity.get("summary", "").strip() else ""), *(f"  {k}: {v}" for k, v in more.items() if v)]


def delegation_brief(task: str, kind: dict, asked: str, advice: dict, stats: dict, ready: tuple[str, str], revision: str | None, told: dict, packed: dict) -> str:
    """The prompt for the agent that takes the task over (fixed section titles and line forms)."""
    sections = {
        "Kickoff advisory:": {
            "requested mode": asked,
            "effective mode": advice["effective_mode"],
            "confidence": f"{advice['level']} ({advice['confidence']:.2f})",
            "effective threshold": f"{advice['threshold']:.2f}",
            "token budget applied": advice["budget"],
            "next step": advice["next_step"],
        },
        "Graph state:": {
            "readiness": ready[0],
            "recommendation": ready[1],
            "graph available": str(stats["nodes"] > 0).lower(),
            "snapshot": f"{stats['nodes']} node(s), {stats['edges']} relationship(s)",
        } | ({"current revision": revision} if revision else {}),
    }
    lines = [f"Task: {task}", f"Kickoff family: {kind['family']}"]
    for title, facts in sections.items():
        lines += ["", title, *(f"- {k}: {v}" for k, v in facts.items())]
    lines += ["", f"Kickoff context ({told['coverage']}):", told["summary"]]
    if told["coverage"] != GROUNDED:
        return "\n".join([*lines, "", "Next best action:", *(f"- {g}" for g in told["guidance"])])
    for result in packed["results"]:
        lines += _shown(result)
    return "\n".join(lines + ([f"- additional omitted results: {packed['omitted_results']}"] if packed["truncated"] else []))


def handoff_brief(outcome: dict, before: dict | None, after: dict | None, counts: dict) -> dict:
    """The brief that a finished task leaves for the next agent (fixed section titles and line forms)."""
    mark = lambda text, form, value: text + form.format(value) if value else text
    decisions = [mark(d["summary"], " ({})", d["status"]) for d in outcome["decisions"]]
    artifacts = [mark(f"{a['path']} — {a['summary']}", " [{}]", a["change_type"]) for a in outcome["changed_artifacts"]]
    follow = [mark(mark(f["summary"], " (owner: {})", f["owner"]), " [{}]", f["status"]) for f in outcome["follow_up"]]
    label = lambda r: f"{r['id']} ({r['anchor']})" if r else "none"
    written = {f"{many} {did}": counts[one].get(did, 0) for one, many in (("nodes", "nodes"), ("relationships", "edges")) for did in ("created", "updated")}
    lines = [f"Task complete: {outcome['task']}", "", f"Outcome summary: {outcome['summary']}", "", "Revision anchors:", f"- before: {label(before)}", f"- after: {label(after)}"]
    lines += ["", "Graph write summary:", *(f"- {k}: {v}" for k, v in written.items())]
    for title, rows in (("Key decisions:", decisions), ("Changed artifacts:", artifacts)):
        lines += ["", title, *(f"- {x}" for x in rows)] if rows else []
    lines += ["", "Next-agent brief:", *(f"- {x}" for x in follow or ["No explicit follow-up items were captured in this handoff."])]
    return {
        "status": "ready",
        "summary": f'Persisted delegated task outcome for "{outcome["task"]}" from revision {label(before)} to {label(after)}.',
        "prompt": "\n".join(lines),
        "decisions": decisions,
        "changed_artifacts": artifacts,
        "follow_up": follow,
    }
