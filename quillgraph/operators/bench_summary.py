"""Benchmark scenarios and their runs, compared in bulk: loose normal forms, issues, worst status, metric by metric.

All tables are keyed by scenario, so any number of scenarios is one plan. Metrics travel as
rows of a typed map (name, whether it is there, number or text), so that rules and
comparisons are written once and not for each metric. Issues are rows, never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strings, trimmed

# Fixed values of the stored documents and of the summary.
VERSION = "v1"
KIND = {"scenario": "delegated_workflow_benchmark_scenario", "run": "delegated_workflow_benchmark_run"}
MODES = ["with_graph", "without_graph"]
STATUS = ["comparable", "incomplete", "non_comparable"]
#: Metric, whether it is a text, and whether a comparison needs it (a number above 0, a text that is not blank).
METRICS = [
    ("volume.input_tokens", False, True), ("volume.output_tokens", False, True), ("volume.prompt_count", False, True), ("volume.prompt_characters", False, True),
    ("orientation.step_count", False, True), ("orientation.repo_scans", False, False), ("orientation.follow_up_prompts", False, False), ("orientation.context_reloads", False, False),
    ("outcome.quality_rating", True, True), ("outcome.resumability_rating", True, True),
    ("outcome.acceptance_checks_passed", False, False), ("outcome.acceptance_checks_total", False, True),
]

ISSUE = "scenario_id string, severity int, code string, mode string, run_id string, n long, fields array<string>"


def _mode(value: Column) -> Column:
    return F.lower(trimmed(value))


def _notes(values: Column) -> Column:
    return F.filter(F.transform(F.coalesce(values, strings([])), trimmed), lambda n: n != "")


def loose_scenarios(scenarios: DataFrame) -> DataFrame:
    """Scenarios trimmed and with their modes in order of (mode, prompt); nothing is filled in or refused."""
    plain = {c: trimmed(F.col(c)) for c in ("schema_version", "kind", "scenario_id", "task_family", "title", "acceptance_criteria_ref", "created_at")}
    one = lambda m: F.struct(_mode(m["mode"]).alias("mode"), trimmed(m["task_prompt"]).alias("task_prompt"), _notes(m["notes"]).alias("notes"))
    modes = F.array_sort(F.transform(F.coalesce("modes", F.array().cast("array<struct<mode:string,task_prompt:string,notes:array<string>>>")), one))
    return scenarios.withColumns(plain | {"modes": modes})


def loose_runs(runs: DataFrame) -> DataFrame:
    """Runs trimmed, modes in lower case, without blank notes and labels' white space; nothing is filled in or refused."""
    plain = {c: trimmed(F.col(c)) for c in ("schema_version", "kind", "run_id", "scenario_id", "recorded_at")} | {"mode": _mode(F.col("mode"))}
    ratings = [trimmed(F.col(f"metrics.outcome.{c}")).alias(c) for c in ("quality_rating", "resumability_rating")]
    checks = [F.col(f"metrics.outcome.acceptance_checks_{c}").alias(f"acceptance_checks_{c}") for c in ("passed", "total")]
    metrics = F.struct(F.col("metrics.volume").alias("volume"), F.col("metrics.orientation").alias("orientation"), F.struct(*ratings, *checks).alias("outcome"))
    return runs.withColumns(plain | {"notes": _notes(F.col("notes")), "metrics": metrics})


def metric_rows(runs: DataFrame, *keys: str) -> DataFrame:
    """(keys, place, metric, is_text, needed, present, number, text): a row for each metric of each run; an absent number is not present and counts as 0."""
    one = []
    for k, (name, is_text, needed) in enumerate(METRICS):
        value = F.col(f"metrics.{name}")
        number = F.lit(None).cast("long") if is_text else F.coalesce(value.cast("long"), F.lit(0))
        text = F.coalesce(trimmed(value), F.lit("")) if is_text else F.lit(None).cast("string")
        head = [F.lit(k).alias("place"), F.lit(name).alias("metric"), F.lit(is_text).alias("is_text"), F.lit(needed).alias("needed")]
        one.append(F.struct(*head, value.isNotNull().alias("present"), number.alias("number"), text.alias("text")))
    return runs.select(*keys, F.explode(F.array(*one)).alias("m")).select(*keys, "m.*")


def missing_fields(runs: DataFrame, *keys: str) -> DataFrame:
    """(keys, fields): the fields that each run lacks for a comparison, in their order; runs that lack none are left out."""
    passed, total = (F.coalesce(F.col(f"metrics.outcome.acceptance_checks_{c}"), F.lit(0)) for c in ("passed", "total"))
    lacks = [F.when(F.coalesce(F.col(f"metrics.{m}"), F.lit(0)) <= 0, f"metrics.{m}") for m, is_text, needed in METRICS if needed and not is_text and "outcome" not in m]
    lacks += [F.when(trimmed(F.col(f"metrics.{m}")) == "", f"metrics.{m}") for m, is_text, _ in METRICS if is_text]
    lacks += [F.when(total <= 0, "metrics.outcome.acceptance_checks_total"), F.when((passed < 0) | (passed > total), "metrics.outcome.acceptance_checks_passed")]
    return runs.select(*keys, F.array_compact(F.array(*lacks)).alias("fields")).where(F.size("fields") > 0)


def _issue(severity: int, code: str, mode: Column | None = None, run_id: Column | None = None, n: Column | None = None, fields: Column | None = None) -> Column:
    """One issue without its scenario."""
    given = [(mode, "string", "mode"), (run_id, "string", "run_id"), (n, "long", "n"), (fields, "array<string>", "fields")]
    return F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), *[(F.lit(None) if c is None else c).cast(t).alias(name) for c, t, name in given])


def _found(rows: DataFrame, *issues: Column) -> DataFrame:
    """ISSUE rows of those issues (null where they do not arise) of each row; arrays of issues are taken apart."""
    return rows.select("of", F.explode(F.array_compact(F.flatten(F.array(*issues)))).alias("i")).select(F.col("of").alias("scenario_id"), "i.*")


def _when(holds: Column, issue: Column) -> Column:
    return F.array(F.when(holds, issue))


def _unlike(c: str, value: str) -> Column:
    return (F.col(c) != "") & (F.col(c) != value)


def mode_runs(scenarios: DataFrame, runs: DataFrame) -> DataFrame:
    """(of, mode, n, run_id): for each scenario and each of the two modes its number of runs, and the run's id where there is exactly one."""
    valid = runs.where((F.col("scenario_id") == F.col("of")) & F.col("mode").isin(MODES))
    counted = valid.groupBy("of", "mode").agg(F.count(F.lit(1)).alias("n"), F.min("run_id").alias("run_id"))
    wanted = scenarios.select("of", F.explode(strings(MODES)).alias("mode"))
    met = wanted.join(counted, ["of", "mode"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return met.withColumn("run_id", F.when(F.col("n") == 1, F.col("run_id")))


def benchmark_issues(scenarios: DataFrame, runs: DataFrame) -> DataFrame:
    """ISSUE rows: what keeps scenarios and their runs from being compared, severity 2 for non_comparable and 1 for incomplete.

    scenarios, runs: in loose form; ``of`` is the scenario that a run is kept under (its own
    id, for scenarios). A run lacks fields only where its scenario has exactly one run of
    either mode and nothing of severity 2.
    """
    modes = lambda keep: F.filter("modes", keep)
    odd = modes(lambda m: (m["mode"] != "") & ~m["mode"].isin(MODES))
    count = {x: F.size(F.filter(F.transform("modes", lambda m: m["mode"]), lambda name: name == x)) for x in MODES}  # noqa: B023
    of_scenario = _found(
        scenarios,
        _when(_unlike("schema_version", VERSION), _issue(2, "unsupported_scenario_schema")),
        _when(_unlike("kind", KIND["scenario"]), _issue(2, "unsupported_scenario_kind")),
        F.transform(modes(lambda m: m["mode"] == ""), lambda m: _issue(2, "scenario_mode_missing", mode=F.lit(""))),
        F.transform(odd, lambda m: _issue(2, "unsupported_scenario_mode", mode=m["mode"])),
        *[_when(n == 0, _issue(2, "scenario_mode_missing", mode=F.lit(x))) for x, n in count.items()],
        *[_when(n > 1, _issue(2, "duplicate_scenario_mode", mode=F.lit(x), n=n)) for x, n in count.items()],
    )
    own, run_id = F.col("scenario_id"), F.col("run_id")
    of_run = _found(
        runs,
        _when(_unlike("schema_version", VERSION), _issue(2, "unsupported_run_schema", run_id=run_id)),
        _when(_unlike("kind", KIND["run"]), _issue(2, "unsupported_run_kind", run_id=run_id)),
        _when(own == "", _issue(2, "run_scenario_id_missing", run_id=run_id)),
        _when((own != "") & (own != F.col("of")), _issue(2, "run_scenario_mismatch", run_id=run_id)),
        _when((own == F.col("of")) & ~F.col("mode").isin(MODES), _issue(2, "unsupported_run_mode", mode=F.col("mode"), run_id=run_id)),
    )
    per_mode = mode_runs(scenarios, runs)
    of_mode = _found(
        per_mode,
        _when(F.col("n") == 0, _issue(1, "missing_mode_run", mode=F.col("mode"))),
        _when(F.col("n") > 1, _issue(2, "multiple_mode_runs", mode=F.col("mode"), n=F.col("n"))),
    )
    so_far = of_scenario.unionByName(of_run).unionByName(of_mode)
    barred = so_far.where("severity = 2 OR code = 'missing_mode_run'").select(F.col("scenario_id").alias("of")).distinct()
    selected = runs.where((F.col("scenario_id") == F.col("of")) & F.col("mode").isin(MODES)).join(barred, "of", "left_anti")
    lacking = missing_fields(selected, "of", "mode", "run_id")
    return so_far.unionByName(_found(lacking, F.array(_issue(1, "missing_comparison_fields", mode=F.col("mode"), run_id=run_id, fields=F.col("fields")))))


def benchmark_status(scenarios: DataFrame, issues: DataFrame) -> DataFrame:
    """(scenario_id, status, comparable, n_issues): the worst of comparable, incomplete and non_comparable over a scenario's issues."""
    worst = issues.groupBy("scenario_id").agg(F.max("severity").alias("severity"), F.count(F.lit(1)).alias("n_issues"))
    met = scenarios.select(F.col("of").alias("scenario_id")).join(worst, "scenario_id", "left")
    status = F.element_at(strings(STATUS), F.coalesce("severity", F.lit(0)) + 1)
    return met.select("scenario_id", status.alias("status"), (status == STATUS[0]).alias("comparable"), F.coalesce("n_issues", F.lit(0)).alias("n_issues"))


def benchmark_comparison(runs: DataFrame, status: DataFrame) -> DataFrame:
    """(scenario_id, place, metric, with_graph, without_graph, delta, matches) of comparable scenarios, a row a metric.

    Numbers have a delta with - without, texts say whether they match; the other is null.
    """
    chosen = runs.where((F.col("scenario_id") == F.col("of")) & F.col("mode").isin(MODES))
    chosen = chosen.join(status.where("comparable").select(F.col("scenario_id").alias("of")), "of", "left_semi")
    rows = metric_rows(chosen, "of", "mode")
    pick = lambda c, mode: F.max(F.when(F.col("mode") == mode, F.col(c)))
    sides = [pick(c, m).alias(f"{c}_{m}") for c in ("number", "text") for m in MODES]
    met = rows.groupBy("of", "place", "metric", "is_text").agg(*sides)
    shown = [F.coalesce(F.col(f"number_{m}").cast("string"), F.col(f"text_{m}")).alias(m) for m in MODES]
    delta = F.col("number_with_graph") - F.col("number_without_graph")
    return met.select(F.col("of").alias("scenario_id"), "place", "metric", *shown, delta.alias("delta"), (F.col("text_with_graph") == F.col("text_without_graph")).alias("matches"))
