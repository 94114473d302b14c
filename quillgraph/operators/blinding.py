"""Blinding: records without the keys that reveal an experiment's condition."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The keys that name a condition.
REVEALING = ["condition_id", "workflow_mode", "graph_backed", "kickoff_used", "handoff_used", "delegated_sessions"]


def sanitized(value: object, keys: frozenset[str] = frozenset(REVEALING)) -> object:
    """The value without these keys at any depth."""
    if isinstance(value, dict):
        return {k: sanitized(v, keys) for k, v in value.items() if k not in keys}
    if isinstance(value, list):
        return [sanitized(v, keys) for v in value]
    return value


def _one(text: str | None) -> str | None:
    try:
        return None if text is None else json.dumps(sanitized(json.loads(text)), separators=(",", ":"), ensure_ascii=False, sort_keys=True)
    except ValueError:
        return None


def blinded(record: Column) -> Column:
    """JSON records of open schema, blinded at any depth, keys sorted; invalid JSON is null."""

    @F.pandas_udf(StringType())
    def blind(records: pd.Series) -> pd.Series:
        return records.map(_one)

    return blind(record)
