"""Packing ranked results under a token budget.

The cost of a result is the number of words in its compact JSON, which depends on field
order, omitted empty fields and number formats; each step depends on the budget left. So
packing is a sequential Python fold, one task's ranked results to a group.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(rb"[A-Za-z0-9_]+")
PRIORITY = ["supports_task", "matched_seed", "outgoing_neighbor", "incoming_neighbor"]
_STEPS = ["created_by", "created_session_id", "updated_by", "updated_session_id", "created_at", "updated_at"]


def number(x: float) -> str:
    """Shortest form of a float, without a fraction for whole numbers."""
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    text = repr(float(x))
    return re.sub(r"e([+-])0?(\d)$", r"e\g<1>0\2", text) if "e" in text else text


def render(value: object) -> str:
    """Compact JSON with <, > and & escaped; empty values of dicts are left out, apart from required ones kept by the caller."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{render(k)}:{render(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(render, value)) + "]"
    if isinstance(value, float):
        return number(value)
    text = json.dumps(value, ensure_ascii=False)
    return text.replace("<", "\\u003c").replace(">", "\\u003e").replace("&", "\\u0026")


def estimate(value: object) -> int:
    return len(_WORD.findall(render(value).encode()))


def _shape(head: dict, more: dict) -> dict:
    """The result with its fields in order: head, summary inside the entity, then the optional parts."""
    entity = dict(head["entity"])
    if more.get("summary"):
        entity["summary"] = more["summary"]
    out = {"rank": head["rank"], "score": head["score"], "entity": entity}
    for key in ("relationships", "provenance", "matched_terms", "omitted_relationships"):
        if more.get(key):
            out[key] = more[key]
    return out


def pack_one(result: dict, left: int) -> tuple[dict, int] | None:
    """A result in order of priority: identity, relationships, provenance, summary, matched terms. None if its identity does not fit."""
    entity = {"id": result["id"], "kind": result["kind"] or ""}
    if (title := (result.get("title") or "").strip()) != "":
        entity["title"] = title
    head, more = {"rank": int(result["rank"]), "score": float(result["score"]), "entity": entity}, {}
    if (used := estimate(_shape(head, more))) > left:
        return None

    def fits(**change: object) -> bool:
        nonlocal used, more
        cost = estimate(_shape(head, trial := more | change))
        if cost <= left:
            used, more = cost, trial
        return cost <= left

    place = {d: i for i, d in enumerate(PRIORITY)}
    refs = sorted(result.get("graph_refs") or [], key=lambda r: (place.get(r["direction"], 4), r["kind"], r["from_id"], r["to_id"]))
    shown: list[dict] = []
    omitted = 0
    for i, r in enumerate(refs):
        peer = r["to_id"] if r["from_id"] == result["id"] else r["from_id"] if r["to_id"] == result["id"] else ""
        if not fits(relationships=[*shown, {"kind": r["kind"], "direction": r["direction"], "peer": peer}]):
            omitted = len(refs) - i
            break
        shown = more["relationships"]
    trace: dict = {}
    for step in _STEPS:
        if value := (result.get(step) or "").strip():
            if fits(provenance={k: v for k, v in sorted((trace | {step: value}).items())}):
                trace[step] = value
    if words := (result.get("summary") or "").split():
        if not fits(summary=" ".join(words)):
            low, high = 1, len(words)
            while low <= high:
                mid = (low + high) // 2
                short = " ".join(words[:mid]) + ("…" if mid < len(words) else "")
                if fits(summary=short):
                    low = mid + 1
                else:
                    high = mid - 1
    for term in result.get("matched_terms") if result.get("matched_terms") is not None else []:
        if term.strip() and not fits(matched_terms=[*more.get("matched_terms", []), term.strip()]):
            break
    if omitted:
        fits(omitted_relationships=omitted)
    return _shape(head, more), used


def pack(results: Iterable[dict], max_tokens: int, total: int | None = None) -> dict:
    """An envelope of results in rank order, up to the first whose identity does not fit; none behind it is taken.

    A result costs two tokens at least, so the first ``max_tokens`` results will do; ``total``
    then says how many there are in all.
    """
    if max_tokens <= 0:
        raise ValueError("max_tokens must be positive")
    results = list(results)
    total = len(results) if total is None else total
    out: dict = {"max_tokens": max_tokens, "estimated_tokens": 0, "truncated": False, "omitted_results": 0, "results": []}
    for i, result in enumerate(results):
        packed = pack_one(result, max_tokens - out["estimated_tokens"])
        if packed is None:
            return out | {"truncated": True, "omitted_results": total - i}
        out["results"].append(packed[0])
        out["estimated_tokens"] += packed[1]
    return out | ({"truncated": True, "omitted_results": total - len(results)} if total > len(results) else {})


def pack_groups(results: DataFrame, key: str, max_tokens: int) -> DataFrame:
    """(key, rank, id, packed JSON, tokens) of what fits each key's budget. A row costs two tokens at least, so only the first max_tokens rows of a key can matter."""
    kept = results.where(F.col("rank") <= max_tokens)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        left, out = max_tokens, []
        for r in rows.sort_values("rank").to_dict("records"):
            r["graph_refs"] = [x if isinstance(x, dict) else x.asDict() for x in (r["graph_refs"] if r["graph_refs"] is not None else [])]
            if (packed := pack_one(r, left)) is None:
                break
            left -= packed[1]
            out.append((r[key], int(r["rank"]), r["id"], render(packed[0]), packed[1]))
        return pd.DataFrame(out, columns=[key, "rank", "id", "packed", "tokens"])

    return kept.groupBy(key).applyInPandas(run, f"{key} string, rank int, id string, packed string, tokens int")
