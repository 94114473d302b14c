"""Readers and writers of the run ledger's JSON files, always with an explicit schema."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import is_rfc3339, is_safe_id, is_safe_path, violations
from ..operators.bench_summary import loose_runs, loose_scenarios
from . import files
from .store import StoreError

RUN = (
    "schema_version string, run_id string, task_id string, condition_id string, model string, session_topology string, seed long, prompt_variant string, started_at string, finished_at string, "
    "telemetry struct<measurement_status:string,source:string,provider:string,total_tokens:int,input_tokens:int,output_tokens:int,wall_clock_seconds:int,retry_count:int,delegated_sessions:int,incomplete_reasons:array<string>>, "
    "kickoff_inputs_ref string, workflow_start_response_ref string, baseline_prompt_metadata_ref string, attribution_summary_ref string, session_structure_ref string, writeback_outputs_ref string, outcome_artifacts_ref string"
)
SCORES = "struct<success:boolean,quality_score:double,resumability_score:double,human_intervention_count:int>"
EVALUATION = f"schema_version string, run_id string, evaluator string, evaluated_at string, scores {SCORES}, notes string"
EVALUATION_FILE = f"schema_version string, run_id string, records array<struct<schema_version:string,run_id:string,evaluator:string,evaluated_at:string,scores:{SCORES},notes:string>>"
PLAN = "schema_version string, batch_id string, seed long, created_at string, entries array<struct<entry:int,task_id:string,condition_id:string>>"
SUITE = "schema_version string, suite_id string, tasks array<struct<task_id:string,family:string,description:string,acceptance_criteria_ref:string>>"
CONDITIONS = "schema_version string, conditions array<struct<condition_id:string,workflow_mode:string,description:string>>, blocking_factors array<string>"
SCENARIO = "schema_version string, kind string, scenario_id string, task_family string, title string, acceptance_criteria_ref string, created_at string, modes array<struct<mode:string,task_prompt:string,notes:array<string>>>"
BENCH_RUN = "schema_version string, kind string, run_id string, scenario_id string, mode string, recorded_at string, metrics struct<volume:struct<input_tokens:int,output_tokens:int,prompt_count:int,prompt_characters:int>,orientation:struct<step_count:int,repo_scans:int,follow_up_prompts:int,context_reloads:int>,outcome:struct<quality_rating:string,resumability_rating:string,acceptance_checks_passed:int,acceptance_checks_total:int>>, notes array<string>, labels map<string,string>"
MODES = ["graph_backed", "baseline", "with_harness", "without_harness", "graph_only"]
FACTORS = ["task_family", "model", "session_topology"]
#: The five conditions that a new suite starts with: id, mode, description.
DEFAULT_CONDITIONS = [
    ("with-graph", "graph_backed", "kickoff and handoff with graph context"),
    ("without-graph", "baseline", "delegation without graph context"),
    ("with-harness", "with_harness", "retrieval, evaluation, decision and attribution"),
    ("without-harness", "without_harness", "no engine at all"),
    ("graph-only", "graph_only", "retrieval and packing without evaluation"),
]


def _json(spark: SparkSession, schema: str, path: str, pattern: str = "*.json", recursive: bool = True, lines: bool = False) -> DataFrame:
    """JSON documents under a path; a missing path has none."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema).withColumn("path", F.lit(None).cast("string"))
    reader = spark.read.schema(schema).option("multiLine", not lines).option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).option("mode", "PERMISSIVE")
    return reader.json(path).withColumn("path", F.col("_metadata.file_path"))


def runs(spark: SparkSession, base: str) -> DataFrame:
    """Run records: run.json at any depth under runs/, or any JSON file directly in it; batches/ is left out."""
    deep = _json(spark, RUN, f"{base}/runs", "run.json")
    flat = _json(spark, RUN, f"{base}/runs", "*.json", recursive=False).where(~F.col("path").endswith("/run.json"))
    return deep.unionByName(flat).where(~F.contains("path", F.lit("/batches/")) & F.col("run_id").isNotNull())


def evaluations(spark: SparkSession, base: str) -> DataFrame:
    """(run_id, position, success, quality_score, resumability_score) of every evaluation; the last position is the latest."""
    files = _json(spark, EVALUATION_FILE, f"{base}/evaluations")
    one = files.select(F.posexplode("records").alias("position", "r"))
    return one.select("r.run_id", "position", "r.scores.success", "r.scores.quality_score", "r.scores.resumability_score")


def plans(spark: SparkSession, base: str) -> DataFrame:
    files = _json(spark, PLAN, f"{base}/runs", "plan.json")
    return files.select("batch_id", "seed", "created_at", F.size("entries").alias("entries")).orderBy("batch_id")


def tasks(spark: SparkSession, base: str) -> DataFrame:
    return _json(spark, SUITE, f"{base}/suite.json").select(F.inline("tasks"))


def conditions(spark: SparkSession, base: str) -> DataFrame:
    return _json(spark, CONDITIONS, f"{base}/conditions.json").select(F.inline("conditions"))


def scenarios(spark: SparkSession, base: str) -> DataFrame:
    return _json(spark, SCENARIO, f"{base}/scenarios", recursive=False).orderBy("scenario_id")


def benchmark_runs(spark: SparkSession, base: str, scenario_id: str) -> DataFrame:
    found = _json(spark, BENCH_RUN, f"{base}/runs/{scenario_id}")
    return found.where(F.col("scenario_id") == scenario_id).orderBy("mode", "recorded_at", "run_id", "path")


def benchmark_tables(spark: SparkSession, base: str, scenario_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Scenarios and runs as they are stored, in loose form, all of them or one scenario's; ``of`` is the scenario that a run is kept under, by its folder."""
    kept = _json(spark, SCENARIO, f"{base}/scenarios", recursive=False)
    made = _json(spark, BENCH_RUN, f"{base}/runs" + (f"/{scenario_id}" if scenario_id else ""))
    named = F.when(F.coalesce("scenario_id", F.lit("")) == "", F.regexp_extract("path", r"([^/]+)\.json$", 1)).otherwise(F.col("scenario_id"))
    scenarios_ = loose_scenarios(kept).withColumn("of", named)
    runs_ = loose_runs(made).withColumn("of", F.regexp_extract("path", r"/runs/([^/]+)/", 1))
    if scenario_id:
        scenarios_ = scenarios_.where(F.col("of") == scenario_id)
    return scenarios_, runs_


def session_usage(spark: SparkSession, log: str, model: str | None = None) -> dict:
    """Tokens of a session from the last shutdown event of its log of JSON lines: the asked model, else the current one, else the only one."""
    usage = "struct<usage:struct<inputTokens:long,outputTokens:long,cacheReadTokens:long,cacheWriteTokens:long>>"
    schema = f"type string, data struct<currentModel:string,modelMetrics:map<string,{usage}>>"
    lines = spark.read.text(log, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "text"))
    last = lines.select("line", F.from_json("text", schema).alias("e")).where("e.type = 'session.shutdown'").agg(F.max_by("e.data", "line").alias("d")).head()["d"]
    if last is None or not last["modelMetrics"]:
        raise StoreError("session_usage_unavailable", "the log holds no shutdown event with model metrics")
    known = last["modelMetrics"]
    name = model if model in known else last["currentModel"] if not model and last["currentModel"] in known else next(iter(known)) if len(known) == 1 else None
    if name is None:
        raise StoreError("model_metrics_not_found", f"no metrics for {model!r}; there are {', '.join(sorted(known))}")
    u = known[name]["usage"]
    if (u["inputTokens"] or 0) <= 0 or (u["outputTokens"] or 0) <= 0:
        raise StoreError("session_usage_incomplete", f"model {name} reported no tokens")
    return {"model": name, "input_tokens": u["inputTokens"], "output_tokens": u["outputTokens"], "total_tokens": u["inputTokens"] + u["outputTokens"], "cache_read_tokens": u["cacheReadTokens"], "cache_write_tokens": u["cacheWriteTokens"]}


_USAGE = "struct<usage:struct<inputTokens:long,outputTokens:long,cacheReadTokens:long,cacheWriteTokens:long>>"
_EVENT = f"type string, data struct<currentModel:string,modelMetrics:map<string,{_USAGE}>>"
#: Columns of session_usages().
USAGE = "session_id string, model string, input_tokens long, output_tokens long, total_tokens long, cache_read_tokens long, cache_write_tokens long, problem string"


def session_usages(spark: SparkSession, logs: str, requested: DataFrame | None = None, session: str = r"([^/]+)/[^/]+$") -> DataFrame:
    """USAGE rows, one for each log of JSON lines that a path or pattern names: the tokens of its last shutdown event.

    requested: (session_id, model) that sessions were to use, or null; without it the
    current model counts, else the only one. ``session`` takes the id out of a log's path.
    Logs are read line by line and split between tasks; lines that are no JSON are passed
    over. A log without a usable event has a row with its ``problem`` and no tokens; a
    requested session without a log has one too. A path that does not exist has no logs.
    """
    jvm = spark.sparkContext._jvm
    fs = files.file_system(spark, logs)
    if fs.globStatus(jvm.org.apache.hadoop.fs.Path(logs)):
        lines = spark.read.option("recursiveFileLookup", True).text(logs)
        at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
        told = lines.select(F.regexp_extract(F.col("_metadata.file_path"), session, 1).alias("session_id"), at.alias("at"), F.from_json("value", _EVENT).alias("e"))
        shut = F.when(F.col("e.type") == "session.shutdown", F.col("e.data"))
        last = told.groupBy("session_id").agg(F.max_by(shut, F.when(shut.isNotNull(), F.col("at"))).alias("d"))
    else:
        last = spark.createDataFrame([], f"session_id string, d {_EVENT.split('data ')[1]}")
    if requested is None:
        met = last.withColumn("asked", F.lit(None).cast("string")).withColumn("has_log", F.lit(True))
    else:
        asked = requested.select("session_id", F.nullif(F.trim("model"), F.lit("")).alias("asked"))
        met = last.withColumn("has_log", F.lit(True)).join(asked, "session_id", "full_outer")
    known = F.map_keys(F.coalesce("d.modelMetrics", F.create_map().cast(f"map<string,{_USAGE}>")))
    named = F.when(F.array_contains(known, F.col("asked")), F.col("asked"))
    current = F.when(F.col("asked").isNull() & F.array_contains(known, F.col("d.currentModel")), F.col("d.currentModel"))
    model = F.coalesce(named, current, F.when(F.size(known) == 1, F.element_at(known, 1)))
    got = met.withColumn("model", model).withColumn("u", F.element_at("d.modelMetrics", F.col("model"))["usage"])
    spent = (F.coalesce("u.inputTokens", F.lit(0)) > 0) & (F.coalesce("u.outputTokens", F.lit(0)) > 0)
    problem = (
        F.when(F.col("has_log").isNull(), "session_log_not_found")
        .when(F.size(known) == 0, "session_usage_unavailable")
        .when(F.col("model").isNull(), "model_metrics_not_found")
        .when(~spent, "session_usage_incomplete")
    )
    there = lambda c: F.when(problem.isNull(), F.col(f"u.{c}"))
    return got.select(
        "session_id",
        F.when(problem.isNull(), F.col("model")).alias("model"),
        there("inputTokens").alias("input_tokens"),
        there("outputTokens").alias("output_tokens"),
        (there("inputTokens") + there("outputTokens")).alias("total_tokens"),
        there("cacheReadTokens").alias("cache_read_tokens"),
        there("cacheWriteTokens").alias("cache_write_tokens"),
        problem.alias("problem"),
    )


# --------------------------------------------------------------------------- validation


def run_violations(records: DataFrame, tasks_: DataFrame, conditions_: DataFrame) -> DataFrame:
    """Adds ``violations`` to run records; both manifests are small and broadcast."""
    known = records.join(F.broadcast(tasks_.select("task_id", F.lit(True).alias("__task")).distinct()), "task_id", "left").join(F.broadcast(conditions_.select("condition_id", F.lit(True).alias("__condition")).distinct()), "condition_id", "left")
    t = lambda c: F.col(f"telemetry.{c}")
    filled = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    whole = t("measurement_status") == "complete"
    positive = lambda c: F.coalesce(t(c) > 0, F.lit(False))
    found = violations(
        (F.col("schema_version") == "v1", "schema_version", "unsupported schema version"),
        (is_safe_id(F.col("run_id")), "run_id", "must be a safe identifier"),
        (F.col("__task"), "task_id", "task_id must reference an existing suite task"),
        (F.col("__condition"), "condition_id", "condition_id must reference an existing condition"),
        (filled(F.col("model")), "model", "field is required"),
        (filled(F.col("session_topology")), "session_topology", "field is required"),
        (F.col("seed").isNotNull(), "seed", "field is required"),
        (filled(F.col("prompt_variant")), "prompt_variant", "field is required"),
        (is_rfc3339(F.col("started_at")), "started_at", "must be an RFC 3339 time stamp"),
        (is_rfc3339(F.col("finished_at")), "finished_at", "must be an RFC 3339 time stamp"),
        (F.coalesce(F.try_to_timestamp("finished_at") >= F.try_to_timestamp("started_at"), F.lit(True)), "finished_at", "finished_at must not be earlier than started_at"),
        (t("measurement_status").isin("complete", "partial", "unavailable"), "telemetry.measurement_status", "must be a known status"),
        (filled(t("source")), "telemetry.source", "field is required"),
        (~whole | (positive("total_tokens") & F.coalesce(t("input_tokens") >= 0, F.lit(False)) & F.coalesce(t("output_tokens") >= 0, F.lit(False))), "telemetry.total_tokens", "must be complete and greater than zero"),
        (positive("wall_clock_seconds"), "telemetry.wall_clock_seconds", "must be greater than zero"),
        (F.coalesce(t("retry_count") >= 0, F.lit(False)), "telemetry.retry_count", "must not be negative"),
        (F.coalesce(t("delegated_sessions") >= 0, F.lit(False)), "telemetry.delegated_sessions", "must not be negative"),
        (whole | (F.size(F.coalesce(t("incomplete_reasons"), F.array().cast("array<string>"))) > 0), "telemetry.incomplete_reasons", "field is required when token telemetry is not complete"),
        *[(is_safe_path(F.col(c)), c, "must be a relative path") for c in ("kickoff_inputs_ref", "session_structure_ref", "writeback_outputs_ref", "outcome_artifacts_ref")],
    )
    return known.withColumn("violations", found).drop("__task", "__condition")


def evaluation_violations(records: DataFrame, known_runs: DataFrame) -> DataFrame:
    met = records.join(known_runs.select("run_id", F.lit(True).alias("__run")).distinct(), "run_id", "left")
    share = lambda c: F.coalesce(F.col(f"scores.{c}").between(0, 1), F.lit(False))
    found = violations(
        (F.col("schema_version") == "v1", "schema_version", "unsupported schema version"),
        (F.col("__run"), "run_id", "run_id must reference an existing run record"),
        (F.trim(F.coalesce("evaluator", F.lit(""))) != "", "evaluator", "field is required"),
        (is_rfc3339(F.col("evaluated_at")), "evaluated_at", "must be an RFC 3339 time stamp"),
        (F.col("scores.success").isNotNull(), "scores.success", "field is required"),
        (share("quality_score"), "scores.quality_score", "must lie between 0 and 1"),
        (share("resumability_score"), "scores.resumability_score", "must lie between 0 and 1"),
        (F.coalesce(F.col("scores.human_intervention_count") >= 0, F.lit(False)), "scores.human_intervention_count", "must not be negative"),
    )
    return met.withColumn("violations", found).drop("__run")


def manifest_violations(suite: dict | None = None, conditions_: dict | None = None) -> list[tuple[str, str]]:
    """(field, message) of everything wrong with a suite or a conditions manifest; both are small documents."""
    out: list[tuple[str, str]] = []

    def rows(items: list, name: str, key: str, fields: list[str]) -> None:
        seen: set = set()
        for i, item in enumerate(items):
            out.extend((f"{name}[{i}].{f}", "field is required") for f in fields if not item.get(f))
            if item.get(key) in seen:
                out.append((f"{name}[{i}].{key}", f"{key} must be unique"))
            seen.add(item.get(key) or object())

    for doc in filter(None, (suite, conditions_)):
        if doc.get("schema_version") != "v1":
            out.append(("schema_version", "unsupported schema version"))
    if suite is not None:
        if not suite.get("suite_id"):
            out.append(("suite_id", "field is required"))
        rows(suite.get("tasks") or [], "tasks", "task_id", ["task_id", "family", "description", "acceptance_criteria_ref"])
    if conditions_ is not None:
        listed = conditions_.get("conditions") or []
        rows(listed, "conditions", "condition_id", ["condition_id", "workflow_mode", "description"])
        out.extend((f"conditions[{i}].workflow_mode", "workflow_mode must be recognized") for i, c in enumerate(listed) if c.get("workflow_mode") and c["workflow_mode"] not in MODES)
        factors = conditions_.get("blocking_factors") or []
        out.extend(("blocking_factors", f"missing required blocking factor {f!r}") for f in FACTORS if f not in factors)
        out.extend((f"blocking_factors[{i}]", "blocking factor must be recognized") for i, f in enumerate(factors) if f not in FACTORS)
    return out


# --------------------------------------------------------------------------- writing


def append_runs(new: DataFrame, known: DataFrame, path: str) -> None:
    """Append run records; a run id that is known already is refused."""
    if (row := new.join(known.select("run_id"), "run_id", "left_semi").head()) is not None:
        raise StoreError("run_already_exists", f"run {row['run_id']} is in the ledger")
    new.write.mode("append").json(path)


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """One JSON document, whole or not at all."""
    files.write_text(spark, path, json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True))
