"""Paired-experiment statistics over a run ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workflow import classify

GRAPH, BASELINE = "graph_backed", "baseline"
HARNESS, NO_HARNESS, GRAPH_ONLY = "with_harness", "without_harness", "graph_only"
KEY = ["task_id", "family", "model", "topology"]
#: Metrics of a report, and whether a higher value is better.
METRICS = {"success": True, "quality_score": True, "resumability_score": True, "total_tokens": False, "wall_clock_seconds": False}
CLOSE = 1e-9
#: Token increases that count as a regression and as a catastrophe, and the quality loss that is one.
TOKEN_REGRESSION, TOKEN_CATASTROPHE, QUALITY_CATASTROPHE = 25_000.0, 100_000.0, -0.10


def join_ledger(runs: DataFrame, tasks: DataFrame, conditions: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Runs with their task's family, their condition's mode and their latest evaluation; unknown tasks are of family unknown.

    evaluations: run_id, position, success, quality_score, resumability_score; the last position of a run counts.
    """
    score = F.struct("success", "quality_score", "resumability_score")
    latest = evaluations.groupBy("run_id").agg(F.max_by(score, "position").alias("e")).select("run_id", "e.*", F.lit(True).alias("scored"))
    out = runs.join(F.broadcast(tasks.select("task_id", "family")), "task_id", "left").join(F.broadcast(conditions.select("condition_id", F.col("workflow_mode").alias("mode"))), "condition_id", "left")
    out = out.join(latest, "run_id", "left")
    return out.withColumn("family", F.coalesce("family", F.lit("unknown"))).withColumn("mode", F.coalesce("mode", F.lit(""))).withColumn("scored", F.coalesce("scored", F.lit(False)))


def _metrics() -> Column:
    """The five metric values of a run; a missing score reads as 0, an incomplete token count stays null."""
    tokens = F.when(F.col("measurement_status") == "complete", F.col("total_tokens").cast("double"))
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    return F.struct(F.coalesce(F.col("success").cast("int").cast("double"), F.lit(0.0)).alias("success"), zero("quality_score"), zero("resumability_score"), tokens.alias("total_tokens"), zero("wall_clock_seconds"), F.col("quality_score").alias("raw_quality"))


def paired(runs: DataFrame) -> DataFrame:
    """Positional pairs: the i-th graph run meets the i-th baseline run of its key, by (seed, started_at, run_id).

    One row a pair: KEY, position, graph_run_id, baseline_run_id, scored, incomplete_reason,
    g and b (metric structs). One window orders both sides, so the ledger is shuffled once.
    """
    side = F.when(F.col("mode") == GRAPH, "g").when(F.col("mode") == BASELINE, "b")
    order = Window.partitionBy(*KEY, "side").orderBy(F.col("seed").asc_nulls_first(), "started_at", "run_id")
    placed = runs.withColumn("side", side).where("side is not null").select(*KEY, "side", F.row_number().over(order).alias("position"), "run_id", "scored", _metrics().alias("m"))
    pick = lambda c, s: F.max(F.when(F.col("side") == s, F.col(c)))
    met = placed.groupBy(*KEY, "position").agg(
        pick("run_id", "g").alias("graph_run_id"), pick("run_id", "b").alias("baseline_run_id"), pick("scored", "g").alias("gs"), pick("scored", "b").alias("bs"), pick("m", "g").alias("g"), pick("m", "b").alias("b")
    )
    lone = F.col("graph_run_id").isNull() | F.col("baseline_run_id").isNull()
    why = F.when(lone, "missing_condition_match").when(~(F.col("gs") & F.col("bs")), "missing_evaluation")
    return met.select(*KEY, "position", "graph_run_id", "baseline_run_id", why.isNull().alias("scored"), why.alias("incomplete_reason"), "g", "b")


def pair_counts(runs: DataFrame, pairs: DataFrame) -> DataFrame:
    """KEY, pair_count, scored_pair_count, incomplete for every key of the ledger, also those without a run of either side."""
    counted = pairs.groupBy(*KEY).agg(F.count(F.lit(1)).alias("pair_count"), F.count_if("scored").alias("scored_pair_count"))
    keys = runs.select(*KEY).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return keys.join(counted, KEY, "left").select(*KEY, zero("pair_count"), zero("scored_pair_count"), (F.coalesce("pair_count", F.lit(0)) > F.coalesce("scored_pair_count", F.lit(0))).alias("incomplete"))


def deltas(pairs: DataFrame) -> DataFrame:
    """Scored pairs in long form: KEY, position, metric, graph, baseline, delta. Tokens only where both sides are complete."""
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"g.{m}").alias("graph"), F.col(f"b.{m}").alias("baseline")) for m in METRICS])
    long = pairs.where("scored").select(*KEY, "position", F.explode(cells).alias("c")).select(*KEY, "position", "c.*")
    return long.where("graph is not null and baseline is not null").withColumn("delta", F.col("graph") - F.col("baseline"))


def better(metric: Column) -> Column:
    return metric.isin([m for m, up in METRICS.items() if up])


def summary(rows: DataFrame, *by: str) -> DataFrame:
    """by, metric, n, graph_mean, baseline_mean, mean_delta, lower, upper, method; the interval is normal, from two samples on."""
    out = rows.groupBy(*by, "metric").agg(F.count("delta").alias("n"), F.avg("graph").alias("graph_mean"), F.avg("baseline").alias("baseline_mean"), F.avg("delta").alias("mean_delta"), F.stddev_samp("delta").alias("sd"))
    margin = F.when(F.col("n") > 1, 1.96 * F.col("sd") / F.sqrt(F.col("n").cast("double")))
    return out.select(*by, "metric", "n", "graph_mean", "baseline_mean", "mean_delta", (F.col("mean_delta") - margin).alias("lower"), (F.col("mean_delta") + margin).alias("upper"), F.when(F.col("n") > 1, "paired_mean_normal_approximation").otherwise("not_available").alias("method"))


def full_summary(keys: DataFrame, rows: DataFrame, *by: str) -> DataFrame:
    """summary() with a row for every key and each of the five metrics, n = 0 where nothing was measured."""
    every = keys.select(*by).distinct().withColumn("metric", F.explode(F.array(*map(F.lit, METRICS))))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    met = every.join(summary(rows, *by), [*by, "metric"], "left")
    return met.select(*by, "metric", F.coalesce("n", F.lit(0)).alias("n"), zero("graph_mean"), zero("baseline_mean"), zero("mean_delta"), "lower", "upper", F.coalesce("method", F.lit("not_available")).alias("method"))


def grouped(rows: DataFrame) -> DataFrame:
    """grouping, family, value, metric and summary: each pair counts for its model and for its topology, in one pass of grouping sets."""
    sets = rows.groupingSets([["family", "metric", "model"], ["family", "metric", "topology"]], "family", "metric", "model", "topology").agg(
        F.grouping("model").alias("g"), F.count("delta").alias("n"), F.avg("delta").alias("mean_delta"), F.stddev_samp("delta").alias("sd")
    )
    margin = F.when(F.col("n") > 1, 1.96 * F.col("sd") / F.sqrt(F.col("n").cast("double")))
    by_topology = F.col("g") == 1
    return sets.select(F.when(by_topology, "session_topology").otherwise("model").alias("grouping"), "family", F.when(by_topology, F.col("topology")).otherwise(F.col("model")).alias("value"), "metric", "n", "mean_delta", (F.col("mean_delta") - margin).alias("lower"), (F.col("mean_delta") + margin).alias("upper"))


def variation_notes(groups: DataFrame) -> DataFrame:
    """Groupings in which a metric's effect differs between two or more groups."""
    met = groups.groupBy("grouping", "family", "metric").agg(F.count(F.lit(1)).alias("groups"), F.min("mean_delta").alias("lowest"), F.max("mean_delta").alias("highest"))
    # Fixed value: the text.
    note = F.format_string("graph effect for %s varies across %s groups (mean delta range %.3f to %.3f)", "metric", "grouping", "lowest", "highest")
    return met.where((F.col("groups") >= 2) & (F.col("highest") - F.col("lowest") >= CLOSE)).withColumn("note", note)


def worse(metric: Column, delta: Column) -> Column:
    return F.when(better(metric), delta < 0).otherwise(delta > 0)


def findings(summaries: DataFrame, groups: DataFrame) -> DataFrame:
    """Null and negative effects of the paired and the grouped summaries: scope, finding, metric, family, name, n, mean_delta."""
    columns = lambda scope, name: [F.lit(scope).alias("scope"), "metric", "family", name.alias("name"), "n", "mean_delta"]
    both = summaries.select(*columns("paired_task", F.concat_ws("|", "task_id", "model", "topology"))).unionByName(groups.select(*columns("grouped_comparison", F.concat_ws("|", "grouping", "value"))))
    what = F.when(F.abs("mean_delta") < CLOSE, "null").when(worse(F.col("metric"), F.col("mean_delta")), "negative")
    return both.where("n > 0").withColumn("finding", what).where("finding is not null")


def verification(pairs: DataFrame) -> DataFrame:
    """profile, pairs, token and quality samples and means, for scored verification pairs with a profile column.

    Quality is absent, not 0, where a side has none.
    """
    tokens = F.col("g.total_tokens") - F.col("b.total_tokens")
    quality = F.col("g.raw_quality") - F.col("b.raw_quality")
    out = pairs.where("scored").groupBy("profile").agg(F.count(F.lit(1)).alias("pairs"), F.count(tokens).alias("token_samples"), F.count(quality).alias("quality_samples"), F.coalesce(F.avg(tokens), F.lit(0.0)).alias("mean_token_delta"), F.coalesce(F.avg(quality), F.lit(0.0)).alias("mean_quality_delta"))
    return out


def verification_modes(observations: DataFrame) -> DataFrame:
    """How kickoffs of each verification profile went: effective_modes (mode -> pairs), abstention_rate, mean_confidence, pairs with baseline prompt metadata.

    observations: profile, effective_mode, confidence, abstained, has_prompt_metadata. Pairs
    are counted by (profile, mode) first, so a profile's map is made of a few rows; a null mode
    is "", a null confidence counts as 0.
    """
    mode = F.coalesce("effective_mode", F.lit("")).alias("mode")
    yes = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    sums = [F.count(F.lit(1)).alias("n"), yes("abstained").alias("away"), F.sum(F.coalesce("confidence", F.lit(0.0))).alias("sure"), yes("has_prompt_metadata").alias("told")]
    by_mode = observations.groupBy("profile", mode).agg(*sums)
    out = by_mode.groupBy("profile").agg(
        F.sum("n").alias("pairs"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("mode", "n")))).alias("effective_modes"),
        F.sum("away").alias("away"),
        F.sum("sure").alias("sure"),
        F.sum("told").alias("baseline_prompt_pairs"),
    )
    return out.select("profile", "pairs", "effective_modes", (F.col("away") / F.col("pairs")).alias("abstention_rate"), (F.col("sure") / F.col("pairs")).alias("mean_confidence"), "baseline_prompt_pairs")


def gate(profiles: DataFrame) -> DataFrame:
    """One row: the decision whether to rerun, from the profiles' means."""
    whole = (F.col("token_samples") > 0) & (F.col("quality_samples") > 0)
    any_ = lambda c: F.coalesce(F.max(c), F.lit(False))
    t, q = F.col("mean_token_delta"), F.col("mean_quality_delta")
    found = profiles.agg(
        F.count(F.lit(1)).alias("profiles"),
        any_(~whole).alias("incomplete"),
        any_(whole & ((t > TOKEN_CATASTROPHE) | (q < QUALITY_CATASTROPHE))).alias("catastrophe"),
        any_(whole & (t > TOKEN_REGRESSION)).alias("regressed"),
        any_(whole & (q < 0)).alias("lost_quality"),
        F.coalesce(F.avg(F.when(whole, t)), F.lit(0.0)).alias("mean_tokens"),
    )
    decision = (
        F.when(F.col("profiles") == 0, "not_applicable")
        .when(F.col("catastrophe"), "stop-and-recalibrate")
        .when(F.col("incomplete"), "hold")
        .when((F.col("mean_tokens") <= TOKEN_REGRESSION) & ~F.col("regressed") & ~F.col("lost_quality"), "proceed")
        .otherwise("hold")
    )
    return found.withColumn("decision", decision)


def token_means(runs: DataFrame) -> DataFrame:
    """mode, task_id, family, tokens: means of runs with complete telemetry."""
    return runs.where("measurement_status = 'complete' and total_tokens is not null").groupBy("mode", "task_id", "family").agg(F.avg("total_tokens").alias("tokens"))


def token_comparison(means: DataFrame, a: str, b: str) -> DataFrame:
    """One row: tasks that both modes ran, mean absolute and percent saving of a against b, and from ten tasks on an interval."""
    of = lambda mode, name: means.where(F.col("mode") == mode).groupBy("task_id").agg(F.avg("tokens").alias(name))
    met = of(a, "x").join(of(b, "y"), "task_id").where("x <> 0 and y <> 0").withColumn("d", F.col("y") - F.col("x"))
    out = met.agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean_absolute"), F.avg(F.col("d") / F.col("y") * 100).alias("mean_percent"), F.stddev_samp("d").alias("sd"))
    margin = F.when(F.col("n") >= 10, 1.96 * F.col("sd") / F.sqrt(F.col("n").cast("double")))
    return out.select(F.lit(a).alias("condition_a"), F.lit(b).alias("condition_b"), "n", "mean_absolute", "mean_percent", (F.col("mean_absolute") - margin).alias("lower"), (F.col("mean_absolute") + margin).alias("upper"))


def task_distribution(means: DataFrame) -> DataFrame:
    """task_id, family and the mean tokens of each harness mode."""
    return means.groupBy("task_id", "family").pivot("mode", [HARNESS, NO_HARNESS, GRAPH_ONLY]).agg(F.avg("tokens")).where(F.coalesce(HARNESS, NO_HARNESS, GRAPH_ONLY).isNotNull())


def over_abstention(runs: DataFrame, abstentions: DataFrame) -> DataFrame:
    """One row: abstention rate of harness runs, and whether they save tokens and lose quality at once.

    abstentions: run_id, n. The means are over tasks that both modes ran.
    """
    harness = runs.where(F.col("mode") == HARNESS)
    counts = harness.join(abstentions, "run_id", "left").agg(F.count(F.lit(1)).alias("runs"), F.coalesce(F.sum("n"), F.lit(0)).alias("abstentions"))

    def lower(value: Column, ok: Column, name: str) -> DataFrame:
        means = runs.where(ok & F.col("mode").isin(HARNESS, NO_HARNESS)).groupBy("task_id").pivot("mode", [HARNESS, NO_HARNESS]).agg(F.avg(value))
        return means.where(F.col(HARNESS).isNotNull() & F.col(NO_HARNESS).isNotNull()).agg(F.coalesce(F.avg(HARNESS) < F.avg(NO_HARNESS), F.lit(False)).alias(name))

    saved = lower(F.col("total_tokens"), (F.col("measurement_status") == "complete") & F.col("total_tokens").isNotNull(), "token_savings")
    lost = lower(F.col("quality_score"), F.col("quality_score").isNotNull(), "quality_regression")
    row = counts.crossJoin(saved).crossJoin(lost)
    return row.select("runs", "abstentions", F.coalesce(F.try_divide("abstentions", "runs"), F.lit(0.0)).alias("abstention_rate"), "token_savings", "quality_regression", (F.col("token_savings") & F.col("quality_regression")).alias("warning"))


def outcome_distribution(outcomes: DataFrame) -> DataFrame:
    """scope (overall or a family), outcome, n, percentage. outcomes: family, outcome, n."""
    sets = outcomes.groupingSets([["family", "outcome"], ["outcome"]], "family", "outcome").agg(F.grouping("family").alias("g"), F.sum("n").alias("n"))
    named = sets.select(F.when(F.col("g") == 1, "overall").otherwise(F.col("family")).alias("scope"), "outcome", "n")
    return named.withColumn("percentage", F.try_divide(F.col("n"), F.sum("n").over(Window.partitionBy("scope"))) * 100)


def report_counters(runs: DataFrame) -> DataFrame:
    """One row: runs, scored and unscored ones."""
    return runs.agg(F.count(F.lit(1)).alias("runs"), F.count_if("scored").alias("scored"), F.count_if(~F.col("scored")).alias("unscored"))


def token_sparse(pairs: DataFrame) -> DataFrame:
    """One row: comparisons with a scored pair of which a side lacks complete token counts."""
    lacks = F.col("g.total_tokens").isNull() | F.col("b.total_tokens").isNull()
    return pairs.where(F.col("scored") & lacks).select(*KEY).distinct().agg(F.count(F.lit(1)).alias("n"))


def selected(runs: DataFrame, run_ids: list[str]) -> DataFrame:
    """The named runs, each once; a name that is no run is an error."""
    wanted = runs.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(run_ids)], "run_id string")
    if (lost := wanted.join(runs, "run_id", "left_anti").orderBy("run_id").head()) is not None:
        raise ValueError(f"run_ids: {lost['run_id']} is not in the ledger")
    return runs.join(wanted, "run_id", "left_semi")


def report(runs: DataFrame, outcomes: DataFrame, tasks: DataFrame) -> dict[str, DataFrame]:
    """The tables of a report by name. outcomes: run_id, outcome, n; tasks: task_id and its description, from which audits get their profile."""
    pairs = paired(runs)
    rows, means = deltas(pairs), token_means(runs)
    groups = grouped(rows)
    described = tasks.select("task_id", F.coalesce("description", F.lit("")).alias("task"))
    profile = classify(described).select("task_id", F.col("subprofile").alias("profile"))
    profiles = verification(pairs.where("family = 'verification_audit'").join(profile, "task_id", "left").withColumn("profile", F.coalesce(F.nullif("profile", F.lit("")), F.lit("general_verification"))))
    harness = runs.where(F.col("mode") == HARNESS).select("run_id", "family").join(outcomes, "run_id")
    return {
        "counters": report_counters(runs),
        "token_sparse": token_sparse(pairs),
        "comparisons": pair_counts(runs, pairs).orderBy(*KEY),
        "metrics": full_summary(runs, rows, *KEY).orderBy(*KEY, "metric"),
        "groups": groups.orderBy("grouping", "family", "value", "metric"),
        "notes": variation_notes(groups),
        "findings": findings(summary(rows, *KEY), groups),
        "verification": profiles.orderBy("profile"),
        "gate": gate(profiles),
        "primary": token_comparison(means, HARNESS, NO_HARNESS),
        "secondary": token_comparison(means, HARNESS, GRAPH_ONLY),
        "distribution": task_distribution(means).orderBy("task_id"),
        "over_abstention": over_abstention(runs, outcomes.where("outcome = 'abstain'").groupBy("run_id").agg(F.sum("n").alias("n"))),
        "outcomes": outcome_distribution(harness.groupBy("family", "outcome").agg(F.sum("n").alias("n"))).orderBy("scope", "outcome"),
    }


def limitations(counts: dict, sparse: int, without_tokens: int) -> list[str]:
    """What a report cannot say (fixed texts)."""
    told = [
        (counts["unscored"], "{} selected runs are unscored; quality, success, and resumability metrics only reflect scored runs."),
        (sparse, "{} paired comparisons have fewer than two scored pairs, so interval estimates are missing or highly uncertain."),
        (not counts["runs"], "No run records matched the report selection."),
        (without_tokens, "{} paired comparisons lack complete token telemetry for at least one scored pair, so token metrics exclude incomplete measurements."),
    ]
    return [text.format(n) for n, text in told if n]


def batch_plan(tasks: DataFrame, conditions: DataFrame, seed: int) -> DataFrame:
    """Every task with every condition of the two small manifests, in an order that the seed fixes: entry, task_id, condition_id."""
    every = tasks.select("task_id").crossJoin(conditions.select("condition_id"))
    order = Window.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "task_id", "condition_id")), "task_id", "condition_id")
    return every.select(F.row_number().over(order).alias("entry"), "task_id", "condition_id")


def benchmark(runs: DataFrame, values: list[str]) -> DataFrame:
    """scenario_id, status, issues and the deltas with - without of the given metrics. Exactly one run of each mode is comparable.

    runs: scenario_id, mode (with_graph or without_graph) and the metrics.
    """
    side = lambda mode: F.col("mode") == mode
    pick = lambda c, mode: F.max(F.when(side(mode), F.col(c)))
    out = runs.groupBy("scenario_id").agg(
        F.count_if(side("with_graph")).alias("n_with"), F.count_if(side("without_graph")).alias("n_without"), *[(pick(c, "with_graph") - pick(c, "without_graph")).alias(f"{c}_delta") for c in values]
    )
    issues = F.array_compact(F.array(F.when(F.col("n_with") == 0, "missing with_graph run"), F.when(F.col("n_without") == 0, "missing without_graph run"), F.when(F.col("n_with") > 1, "duplicate with_graph runs"), F.when(F.col("n_without") > 1, "duplicate without_graph runs")))
    status = F.when((F.col("n_with") > 1) | (F.col("n_without") > 1), "non_comparable").when((F.col("n_with") == 0) | (F.col("n_without") == 0), "incomplete").otherwise("comparable")
    shown = [F.when(status == "comparable", F.col(f"{c}_delta")).alias(f"{c}_delta") for c in values]
    return out.select("scenario_id", status.alias("status"), issues.alias("issues"), *shown)
