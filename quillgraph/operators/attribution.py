"""Decision logs: the two record forms, their filters, and what is counted from them."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files

# The two forms share a directory but no schema; each is read with its own.
WRITTEN = "id string, timestamp string, outcome string, task string, aggregate_confidence double, memory_decision string, memory_decision_reason string, candidate_fates array<struct<candidate_id:string,fate:string>>, inline_summary struct<outcome:string,confidence:double,candidate_count:long>"
RECORDED = "id string, timestamp timestamp, task string, outcome string, confidence double, scores array<struct<candidate_id:string,composite:double,fate:string>>, memory_decision string, summary string"


def filter_written(records: DataFrame, outcome: str | None = None, after: str | None = None, before: str | None = None) -> DataFrame:
    """Records of an outcome strictly between two time stamps, compared as text."""
    if outcome:
        records = records.where(F.col("outcome") == outcome)
    if after:
        records = records.where(F.col("timestamp") > after)
    if before:
        records = records.where(F.col("timestamp") < before)
    return records


def filter_recorded(records: DataFrame, outcome: str | None = None, task: str | None = None, start: str | None = None, end: str | None = None, at: str = "decided_at") -> DataFrame:
    """Records of an outcome whose task holds a text, within two times, both included."""
    if outcome:
        records = records.where(F.col("outcome") == outcome)
    if task:
        records = records.where(F.contains("task", F.lit(task)))
    if start:
        records = records.where(F.col(at) >= F.to_timestamp(F.lit(start)))
    if end:
        records = records.where(F.col(at) <= F.to_timestamp(F.lit(end)))
    return records


def outcome_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("family", "outcome").agg(F.count(F.lit(1)).alias("n"))


def latest_by_session(records: DataFrame) -> DataFrame:
    """The last decision of each session: session_id, event_id, outcome, usage."""
    last = F.max_by(F.struct("event_id", "outcome", "usage"), F.struct("decided_at", "event_id"))
    return records.groupBy("session_id").agg(last.alias("last")).select("session_id", "last.*")


def recorded(scored: DataFrame, task: str, outcome: str, confidence: float, at: str, wrote: bool = False) -> DataFrame:
    """One record of a decision with all candidate scores, best first."""
    score = F.struct((-F.col("composite")).alias("order"), F.col("id").alias("candidate_id"), "composite", "fate")
    rows = scored.agg(F.array_sort(F.collect_list(score)).alias("s"))
    plain = F.transform("s", lambda x: F.struct(x["candidate_id"].alias("candidate_id"), x["composite"].alias("composite"), x["fate"].alias("fate")))
    stamp = F.to_timestamp(F.lit(at))
    name = F.concat(F.lit("attr-"), F.date_format(stamp, "yyyyMMdd-HHmmss"), F.lit("-"), F.substring(F.sha2(F.concat_ws("|", F.lit(task), F.lit(outcome), F.lit(at)), 256), 1, 8))
    kept = F.size(F.filter("s", lambda x: x["fate"] == "survived"))
    text = F.format_string("outcome %s with confidence %.3f over %d candidates, %d survived", F.lit(outcome), F.lit(float(confidence)), F.size("s"), kept)
    return rows.select(name.alias("id"), stamp.alias("timestamp"), F.lit(task).alias("task"), F.lit(outcome).alias("outcome"), F.lit(float(confidence)).alias("confidence"), plain.alias("scores"), F.lit("approved" if wrote else "skipped").alias("memory_decision"), text.alias("summary"))


def written(task: str, outcome: str, confidence: float, at: str, decision: str | None = None, reason: str | None = None, fates: list[tuple[str, str]] = (), n: int | None = None) -> dict:
    """A decision as it is stored, with a short summary that fits an envelope."""
    name = f"attr-{outcome}-{hashlib.sha256('|'.join([at, outcome, task]).encode()).hexdigest()[:12]}"
    summary = {"outcome": outcome, "confidence": confidence, "candidate_count": len(fates) if n is None else n}
    record = {"id": name, "timestamp": at, "outcome": outcome, "task": task, "aggregate_confidence": confidence, "memory_decision": decision, "memory_decision_reason": reason, "candidate_fates": [{"candidate_id": i, "fate": f} for i, f in fates], "inline_summary": summary}
    return {k: v for k, v in record.items() if v not in (None, [])}


def store(spark: SparkSession, base: str, record: dict) -> None:
    """One file a record, whole or absent; the same record again takes its place."""
    files.write_text(spark, f"{base}/{record['id']}.json", json.dumps(record, ensure_ascii=False, indent=2, sort_keys=True) + "\n")


def stored(spark: SparkSession, base: str) -> DataFrame:
    """Stored records; files that are not one are passed over, a missing folder has none."""
    if not files.file_system(spark, base).exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)):
        return spark.createDataFrame([], WRITTEN)
    rows = spark.read.schema(WRITTEN).option("multiLine", True).option("mode", "DROPMALFORMED").option("pathGlobFilter", "*.json").json(base)
    return rows.where("id is not null and outcome is not null")


def by_run(spark: SparkSession, base: str) -> DataFrame:
    """(run_id, outcome, n) from the attribution summaries that runs keep beside their records."""
    schema = "run_id string, outcomes map<string,long>"
    at = f"{base}/runs"
    if not files.file_system(spark, at).exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)):
        return spark.createDataFrame([], "run_id string, outcome string, n long")
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").option("pathGlobFilter", "attribution-summary.json").option("recursiveFileLookup", True).json(at)
    return rows.where("run_id is not null").select("run_id", F.explode("outcomes").alias("outcome", "n"))
