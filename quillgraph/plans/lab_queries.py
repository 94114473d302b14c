"""Queries over the run ledger and the decision log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import rounded
from ..operators import bench_summary as B
from ..operators import lab as L
from ..operators.attribution import filter_recorded, filter_written, latest_by_session, outcome_counts
from ..sources.adapter import decisions, runs, table
from ..sources.ledger import run_violations
from ..streaming.streams import decision_counts
from .sqlbase import RUNS, r, with_

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[rounded(F.col(c), 6).alias(c) if c in columns else F.col(c) for c in df.columns])


_METRICS = "success quality_score resumability_score total_tokens wall_clock_seconds".split()
_VALUE = {
    "success": "CAST(coalesce({s}.success, false) AS INTEGER)",
    "quality_score": "coalesce({s}.quality_score, 0)",
    "resumability_score": "coalesce({s}.resumability_score, 0)",
    "total_tokens": "CASE WHEN {s}.measurement_status = 'complete' THEN {s}.total_tokens END",
    "wall_clock_seconds": "{s}.wall_clock_seconds",
}
_KEY = "task_id, family, model, topology"
_PAIRS = f"""
placed AS (SELECT *, row_number() OVER (PARTITION BY {_KEY}, mode ORDER BY seed NULLS FIRST, started_at, run_id) AS position FROM runs WHERE mode IN ('graph_backed', 'baseline')),
g AS (SELECT * FROM placed WHERE mode = 'graph_backed'), b AS (SELECT * FROM placed WHERE mode = 'baseline'),
pairs AS (SELECT coalesce(g.task_id, b.task_id) AS task_id, coalesce(g.family, b.family) AS family, coalesce(g.model, b.model) AS model, coalesce(g.topology, b.topology) AS topology, coalesce(g.position, b.position) AS position,
   g.run_id AS graph_run_id, b.run_id AS baseline_run_id, CASE WHEN g.run_id IS NULL OR b.run_id IS NULL THEN 'missing_condition_match' WHEN NOT (g.scored AND b.scored) THEN 'missing_evaluation' END AS incomplete_reason,
   g.quality_score AS gq, b.quality_score AS bq, g.started_at AS gstart, {', '.join(f"{_VALUE[m].format(s='g')} AS g_{m}, {_VALUE[m].format(s='b')} AS b_{m}" for m in _METRICS)}
   FROM g FULL JOIN b ON g.task_id = b.task_id AND g.family = b.family AND g.model = b.model AND g.topology = b.topology AND g.position = b.position),
long AS ({' UNION ALL '.join(f"SELECT {_KEY}, position, '{m}' AS metric, CAST(g_{m} AS DOUBLE) AS graph, CAST(b_{m} AS DOUBLE) AS baseline FROM pairs WHERE incomplete_reason IS NULL" for m in _METRICS)}),
delta AS (SELECT *, graph - baseline AS delta FROM long WHERE graph IS NOT NULL AND baseline IS NOT NULL)"""


@query(with_(RUNS, _PAIRS) + f"SELECT {_KEY}, CAST(position AS INTEGER) AS position, graph_run_id, baseline_run_id, incomplete_reason IS NULL AS scored, incomplete_reason FROM pairs")
def paired_runs(spark: SparkSession, d: str) -> DataFrame:
    return L.paired(runs(spark, d)).drop("g", "b")


@query(
    with_(RUNS, _PAIRS)
    + f", c AS (SELECT {_KEY}, count(*) AS p, count(*) FILTER (incomplete_reason IS NULL) AS s FROM pairs GROUP BY ALL), k AS (SELECT DISTINCT {_KEY} FROM runs) SELECT {_KEY}, CAST(coalesce(p, 0) AS BIGINT) AS pair_count, CAST(coalesce(s, 0) AS BIGINT) AS scored_pair_count, coalesce(p, 0) > coalesce(s, 0) AS incomplete FROM k LEFT JOIN c USING ({_KEY})"
)
def pair_counts(spark: SparkSession, d: str) -> DataFrame:
    ledger = runs(spark, d)
    return L.pair_counts(ledger, L.paired(ledger))


def _deltas(spark: SparkSession, d: str) -> DataFrame:
    return L.deltas(L.paired(runs(spark, d)))


@query(with_(RUNS, _PAIRS) + f"SELECT {_KEY}, CAST(position AS INTEGER) AS position, metric, {r('graph')} AS graph, {r('baseline')} AS baseline, {r('delta')} AS delta FROM delta")
def metric_deltas(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_deltas(spark, d), "graph", "baseline", "delta")


_MARGIN = "CASE WHEN count(*) > 1 THEN 1.96 * stddev_samp(delta) / sqrt(count(*)) END"


@query(
    with_(RUNS, _PAIRS)
    + f"""SELECT {_KEY}, metric, count(*) AS n, {r('avg(graph)')} AS graph_mean, {r('avg(baseline)')} AS baseline_mean, {r('avg(delta)')} AS mean_delta, {r(f'(avg(delta) - {_MARGIN})')} AS lower, {r(f'(avg(delta) + {_MARGIN})')} AS upper,
CASE WHEN count(*) > 1 THEN 'paired_mean_normal_approximation' ELSE 'not_available' END AS method FROM delta GROUP BY {_KEY}, metric"""
)
def metric_summary_ci(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(L.summary(_deltas(spark, d), *L.KEY), "graph_mean", "baseline_mean", "mean_delta", "lower", "upper")


@query(
    with_(RUNS, _PAIRS)
    + f""", k AS (SELECT DISTINCT family FROM runs), m AS (SELECT unnest([{', '.join(f"'{m}'" for m in _METRICS)}]) AS metric), s AS (SELECT family, metric, count(*) AS n, avg(delta) AS mean_delta FROM delta GROUP BY ALL)
SELECT family, metric, CAST(coalesce(n, 0) AS BIGINT) AS n, {r('coalesce(mean_delta, 0.0)')} AS mean_delta FROM k CROSS JOIN m LEFT JOIN s USING (family, metric)"""
)
def metric_summary_full(spark: SparkSession, d: str) -> DataFrame:
    ledger = runs(spark, d)
    out = L.full_summary(ledger, L.deltas(L.paired(ledger)), "family")
    return _rounded(out.select("family", "metric", "n", "mean_delta"), "mean_delta")


_GROUPED = f"""
grp AS (SELECT 'model' AS grouping, family, model AS value, metric, delta FROM delta UNION ALL SELECT 'session_topology', family, topology, metric, delta FROM delta),
sums AS (SELECT grouping, family, value, metric, count(*) AS n, avg(delta) AS mean_delta, avg(delta) - {_MARGIN} AS lower, avg(delta) + {_MARGIN} AS upper FROM grp GROUP BY grouping, family, value, metric)"""


@query(with_(RUNS, _PAIRS, _GROUPED) + f"SELECT grouping, family, value, metric, n, {r('mean_delta')} AS mean_delta, {r('lower')} AS lower, {r('upper')} AS upper FROM sums")
def grouped_effects(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(L.grouped(_deltas(spark, d)), "mean_delta", "lower", "upper")


@query(
    with_(RUNS, _PAIRS, _GROUPED)
    + f"""SELECT grouping, family, metric, count(*) AS groups, {r('min(mean_delta)')} AS lowest, {r('max(mean_delta)')} AS highest FROM sums GROUP BY grouping, family, metric HAVING count(*) >= 2 AND max(mean_delta) - min(mean_delta) >= 1e-9"""
)
def variation_notes(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(L.variation_notes(L.grouped(_deltas(spark, d))).drop("note"), "lowest", "highest")


_WORSE = "CASE WHEN metric IN ('success', 'quality_score', 'resumability_score') THEN mean_delta < 0 ELSE mean_delta > 0 END"


@query(
    with_(RUNS, _PAIRS, _GROUPED)
    + f""", both_ AS (SELECT 'paired_task' AS scope, metric, family, task_id || '|' || model || '|' || topology AS name, count(*) AS n, avg(delta) AS mean_delta FROM delta GROUP BY metric, {_KEY}
UNION ALL SELECT 'grouped_comparison', metric, family, grouping || '|' || value, n, mean_delta FROM sums),
f AS (SELECT *, CASE WHEN abs(mean_delta) < 1e-9 THEN 'null' WHEN {_WORSE} THEN 'negative' END AS finding FROM both_)
SELECT scope, metric, family, name, n, {r('mean_delta')} AS mean_delta, finding FROM f WHERE finding IS NOT NULL"""
)
def findings(spark: SparkSession, d: str) -> DataFrame:
    rows = _deltas(spark, d)
    return _rounded(L.findings(L.summary(rows, *L.KEY), L.grouped(rows)), "mean_delta")


_PROFILE = "CASE position % 3 WHEN 0 THEN 'stats_audit' WHEN 1 THEN 'workflow_verification' ELSE 'general_verification' END"
_VERIFY = f"""
v AS (SELECT {_PROFILE} AS profile, g_total_tokens - b_total_tokens AS t, gq - bq AS q FROM pairs WHERE incomplete_reason IS NULL AND family = 'verification_audit'),
prof AS (SELECT profile, count(*) AS pairs, count(t) AS token_samples, count(q) AS quality_samples, coalesce(avg(t), 0) AS mean_token_delta, coalesce(avg(q), 0) AS mean_quality_delta FROM v GROUP BY profile)"""


def _profiles(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("position") % 3
    pairs = L.paired(runs(spark, d)).where("family = 'verification_audit'")
    return L.verification(pairs.withColumn("profile", F.when(k == 0, "stats_audit").when(k == 1, "workflow_verification").otherwise("general_verification")))


@query(with_(RUNS, _PAIRS, _VERIFY) + f"SELECT profile, pairs, token_samples, quality_samples, {r('mean_token_delta')} AS mean_token_delta, {r('mean_quality_delta')} AS mean_quality_delta FROM prof")
def verification_profiles(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_profiles(spark, d), "mean_token_delta", "mean_quality_delta")


_SEEN = f"""
seen AS (SELECT {_PROFILE} AS profile, coalesce(gq, 0) AS sure, CASE WHEN coalesce(gq, 0) >= 0.7 THEN 'inject' WHEN coalesce(gq, 0) >= 0.4 THEN 'minimal' ELSE 'abstain' END AS mode,
                b_total_tokens IS NOT NULL AS told FROM pairs WHERE family = 'verification_audit'),
modes AS (SELECT profile, mode, count(*) AS n FROM seen GROUP BY ALL)"""


@query(
    with_(RUNS, _PAIRS, _SEEN)
    + f"""SELECT profile, count(*) AS pairs, (SELECT string_agg(mode || ':' || n, ',' ORDER BY mode) FROM modes m WHERE m.profile = seen.profile) AS effective_modes,
 {r("count(*) FILTER (mode = 'abstain') / CAST(count(*) AS DOUBLE)")} AS abstention_rate, {r('avg(sure)', 4)} AS mean_confidence, count(*) FILTER (told) AS baseline_prompt_pairs FROM seen GROUP BY profile"""
)
def verification_modes(spark: SparkSession, d: str) -> DataFrame:
    """The mode that a graph run's quality would have led to, by profile."""
    k = F.col("position") % 3
    pairs = L.paired(runs(spark, d)).where("family = 'verification_audit'")
    sure = F.coalesce("g.raw_quality", F.lit(0.0))
    mode = F.when(sure >= 0.7, "inject").when(sure >= 0.4, "minimal").otherwise("abstain")
    profile = F.when(k == 0, "stats_audit").when(k == 1, "workflow_verification").otherwise("general_verification")
    seen = pairs.select(profile.alias("profile"), mode.alias("effective_mode"), sure.alias("confidence"), (mode == "abstain").alias("abstained"), F.col("b.total_tokens").isNotNull().alias("has_prompt_metadata"))
    shown = L.verification_modes(seen).withColumn("effective_modes", F.array_join(F.transform(F.map_entries("effective_modes"), lambda x: F.concat_ws(":", x["key"], x["value"].cast("string"))), ","))
    return _rounded(shown, "abstention_rate").withColumn("mean_confidence", rounded(F.col("mean_confidence"), 4))


@query(
    with_(RUNS, _PAIRS, _VERIFY)
    + """, x AS (SELECT *, token_samples > 0 AND quality_samples > 0 AS whole FROM prof),
s AS (SELECT count(*) AS profiles, coalesce(bool_or(NOT whole), false) AS incomplete, coalesce(bool_or(whole AND (mean_token_delta > 100000 OR mean_quality_delta < -0.1)), false) AS catastrophe, coalesce(bool_or(whole AND mean_token_delta > 25000), false) AS regressed, coalesce(bool_or(whole AND mean_quality_delta < 0), false) AS lost, coalesce(avg(mean_token_delta) FILTER (whole), 0) AS m FROM x)
SELECT profiles, CASE WHEN profiles = 0 THEN 'not_applicable' WHEN catastrophe THEN 'stop-and-recalibrate' WHEN incomplete THEN 'hold' WHEN m <= 25000 AND NOT regressed AND NOT lost THEN 'proceed' ELSE 'hold' END AS decision FROM s"""
)
def verification_gate(spark: SparkSession, d: str) -> DataFrame:
    return L.gate(_profiles(spark, d)).select("profiles", "decision")


_MEANS = "means AS (SELECT mode, task_id, family, avg(total_tokens) AS tokens FROM runs WHERE measurement_status = 'complete' GROUP BY mode, task_id, family)"


@query(with_(RUNS, _MEANS) + f"SELECT mode, task_id, family, {r('tokens')} AS tokens FROM means")
def token_means(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(L.token_means(runs(spark, d)), "tokens")


@query(
    with_(RUNS, _MEANS)
    + f""", m AS (SELECT mode, task_id, avg(tokens) AS tokens FROM means GROUP BY mode, task_id), x AS (SELECT a.tokens AS x, b.tokens AS y, b.tokens - a.tokens AS delta FROM m a JOIN m b ON a.task_id = b.task_id AND a.mode = 'with_harness' AND b.mode = 'without_harness' WHERE a.tokens <> 0 AND b.tokens <> 0)
SELECT 'with_harness' AS condition_a, 'without_harness' AS condition_b, count(*) AS n, {r('avg(delta)')} AS mean_absolute, {r('avg(delta / y * 100)')} AS mean_percent, {r('(avg(delta) - CASE WHEN count(*) >= 10 THEN 1.96 * stddev_samp(delta) / sqrt(count(*)) END)')} AS lower, {r('(avg(delta) + CASE WHEN count(*) >= 10 THEN 1.96 * stddev_samp(delta) / sqrt(count(*)) END)')} AS upper FROM x"""
)
def token_comparison(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(L.token_comparison(L.token_means(runs(spark, d)), L.HARNESS, L.NO_HARNESS), "mean_absolute", "mean_percent", "lower", "upper")


@query(
    with_(RUNS, _MEANS)
    + f"SELECT task_id, family, {r('avg(tokens) FILTER (mode = $$with_harness$$)')} AS with_harness, {r('avg(tokens) FILTER (mode = $$without_harness$$)')} AS without_harness, {r('avg(tokens) FILTER (mode = $$graph_only$$)')} AS graph_only FROM means WHERE mode IN ('with_harness', 'without_harness', 'graph_only') GROUP BY task_id, family"
)
def task_distribution(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(L.task_distribution(L.token_means(runs(spark, d))), L.HARNESS, L.NO_HARNESS, L.GRAPH_ONLY)


@query(
    with_(RUNS)
    + """, h AS (SELECT count(*) AS runs, CAST(coalesce(sum(CASE WHEN wall_clock_seconds % 4 = 0 THEN 1 ELSE 0 END), 0) AS BIGINT) AS abstentions FROM runs WHERE mode = 'with_harness'),
t AS (SELECT task_id, avg(total_tokens) FILTER (mode = 'with_harness') AS a, avg(total_tokens) FILTER (mode = 'without_harness') AS b FROM runs WHERE measurement_status = 'complete' GROUP BY task_id),
q AS (SELECT task_id, avg(quality_score) FILTER (mode = 'with_harness') AS a, avg(quality_score) FILTER (mode = 'without_harness') AS b FROM runs WHERE quality_score IS NOT NULL GROUP BY task_id),
s AS (SELECT coalesce(avg(a) < avg(b), false) AS saved FROM t WHERE a IS NOT NULL AND b IS NOT NULL), l AS (SELECT coalesce(avg(a) < avg(b), false) AS lost FROM q WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT runs, abstentions, floor(abstentions / runs * 1e6 + 0.5) / 1e6 AS abstention_rate, saved AS token_savings, lost AS quality_regression, saved AND lost AS warning FROM h, s, l"""
)
def over_abstention(spark: SparkSession, d: str) -> DataFrame:
    ledger = runs(spark, d)
    gone = ledger.where("wall_clock_seconds % 4 = 0").select("run_id", F.lit(1).alias("n"))
    return _rounded(L.over_abstention(ledger, gone), "abstention_rate")


@query(with_(RUNS) + "SELECT count(*) AS runs, count(*) FILTER (scored) AS scored, count(*) FILTER (NOT scored) AS unscored FROM runs")
def report_counters(spark: SparkSession, d: str) -> DataFrame:
    return L.report_counters(runs(spark, d))


_FAMILY = "CASE user_id % 4 WHEN 0 THEN 'write_producing' WHEN 1 THEN 'troubleshooting_diagnosis' WHEN 2 THEN 'verification_audit' ELSE 'reporting_synthesis' END"


@query(
    f"""WITH o AS (SELECT {_FAMILY} AS family, event_type AS outcome, count(*) AS n FROM events GROUP BY ALL), s AS (SELECT family AS scope, outcome, n FROM o UNION ALL SELECT 'overall', outcome, sum(n) FROM o GROUP BY outcome)
SELECT scope, outcome, CAST(n AS BIGINT) AS n, {r('(n * 100.0 / sum(n) OVER (PARTITION BY scope))')} AS percentage FROM s"""
)
def outcome_distribution(spark: SparkSession, d: str) -> DataFrame:
    key = F.substring_index("session_id", "-", -1).cast("long") % 4
    family = F.when(key == 0, "write_producing").when(key == 1, "troubleshooting_diagnosis").when(key == 2, "verification_audit").otherwise("reporting_synthesis")
    return _rounded(L.outcome_distribution(outcome_counts(decisions(spark, d).withColumn("family", family))), "percentage")


@query("SELECT 'session-' || user_id AS session_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS outcome, arg_max(CAST(json_extract(props, '$.k') AS BIGINT), (ts, event_id)) AS usage FROM events GROUP BY user_id")
def session_usage_latest(spark: SparkSession, d: str) -> DataFrame:
    return latest_by_session(decisions(spark, d))


@query(
    """SELECT 'written' AS form, event_id FROM events WHERE event_type = 'purchase' AND strftime(ts, '%Y-%m-%dT%H:%M:%S') > '2024-01-02T00:00:00' AND strftime(ts, '%Y-%m-%dT%H:%M:%S') < '2024-01-20T00:00:00'
UNION ALL SELECT 'recorded', event_id FROM events WHERE event_type = 'error' AND contains('session-' || user_id, '1') AND ts >= TIMESTAMP '2024-01-02 00:00:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00'"""
)
def attribution_filter(spark: SparkSession, d: str) -> DataFrame:
    log = decisions(spark, d).withColumn("timestamp", F.date_format("decided_at", "yyyy-MM-dd'T'HH:mm:ss")).withColumn("task", F.col("session_id"))
    a = filter_written(log, "purchase", "2024-01-02T00:00:00", "2024-01-20T00:00:00").select(F.lit("written").alias("form"), "event_id")
    b = filter_recorded(log, "error", "1", "2024-01-02 00:00:00", "2024-01-20 00:00:00").select(F.lit("recorded").alias("form"), "event_id")
    return a.unionByName(b)


@query(
    """WITH x AS (SELECT 'scenario-' || (o_orderkey // 2) AS scenario_id, CASE WHEN o_custkey % 3 = 0 THEN 'with_graph' ELSE 'without_graph' END AS mode, CAST(floor(o_totalprice) AS BIGINT) AS tokens, o_orderkey % 13 AS prompts FROM orders),
s AS (SELECT scenario_id, count(*) FILTER (mode = 'with_graph') AS a, count(*) FILTER (mode = 'without_graph') AS b, max(tokens) FILTER (mode = 'with_graph') - max(tokens) FILTER (mode = 'without_graph') AS t, max(prompts) FILTER (mode = 'with_graph') - max(prompts) FILTER (mode = 'without_graph') AS p FROM x GROUP BY scenario_id),
k AS (SELECT *, CASE WHEN a > 1 OR b > 1 THEN 'non_comparable' WHEN a = 0 OR b = 0 THEN 'incomplete' ELSE 'comparable' END AS status FROM s)
SELECT scenario_id, status, concat_ws(',', CASE WHEN a = 0 THEN 'missing with_graph run' END, CASE WHEN b = 0 THEN 'missing without_graph run' END, CASE WHEN a > 1 THEN 'duplicate with_graph runs' END, CASE WHEN b > 1 THEN 'duplicate without_graph runs' END) AS issues,
       CASE WHEN status = 'comparable' THEN CAST(t AS DOUBLE) END AS tokens_delta, CASE WHEN status = 'comparable' THEN CAST(p AS DOUBLE) END AS prompts_delta FROM k"""
)
def benchmark_compare(spark: SparkSession, d: str) -> DataFrame:
    """All orders are runs; neighbouring order keys share a scenario, so scenarios grow with the table and have one or two runs."""
    k = F.col("o_orderkey")
    recorded = table(spark, d, "orders").select(
        F.concat(F.lit("scenario-"), F.floor(k / 2).cast("string")).alias("scenario_id"),
        F.when(F.col("o_custkey") % 3 == 0, "with_graph").otherwise("without_graph").alias("mode"),
        F.floor("o_totalprice").cast("double").alias("tokens"),
        (k % 13).cast("double").alias("prompts"),
    )
    return L.benchmark(recorded, ["tokens", "prompts"]).withColumn("issues", F.array_join("issues", ","))


@query(
    """WITH t AS (SELECT DISTINCT 'task-' || (o_custkey % 40) AS task_id FROM orders), c AS (SELECT unnest(['with-graph', 'without-graph', 'with-harness', 'without-harness', 'graph-only']) AS condition_id)
SELECT CAST(row_number() OVER (ORDER BY md5('42|' || task_id || '|' || condition_id), task_id, condition_id) AS INTEGER) AS entry, task_id, condition_id FROM t CROSS JOIN c"""
)
def batch_plan_cross(spark: SparkSession, d: str) -> DataFrame:
    tasks = runs(spark, d).select("task_id").distinct()
    conditions = spark.createDataFrame([(c,) for c in ("with-graph", "without-graph", "with-harness", "without-harness", "graph-only")], "condition_id string")
    return L.batch_plan(tasks, conditions, 42)


@query(
    with_(RUNS)
    + """, k AS (SELECT *, CAST(substr(run_id, 5) AS BIGINT) AS k FROM runs)
SELECT run_id, concat_ws(',', CASE WHEN k % 23 = 0 THEN 'schema_version' END, CASE WHEN k % 17 = 0 THEN 'run_id' END, CASE WHEN CAST(substr(task_id, 6) AS BIGINT) >= 35 THEN 'task_id' END, CASE WHEN mode = 'graph_only' THEN 'condition_id' END,
  CASE WHEN k % 29 = 0 THEN 'model' END, CASE WHEN k % 31 = 0 THEN 'seed' END, CASE WHEN k % 19 = 0 THEN 'finished_at' END, CASE WHEN measurement_status = 'complete' AND k % 9 = 0 THEN 'telemetry.total_tokens' END,
  CASE WHEN k % 13 = 0 THEN 'telemetry.wall_clock_seconds' END, CASE WHEN measurement_status <> 'complete' AND k % 2 = 0 THEN 'telemetry.incomplete_reasons' END, CASE WHEN k % 37 = 0 THEN 'kickoff_inputs_ref' END) AS fields FROM k"""
)
def validation_violations(spark: SparkSession, d: str) -> DataFrame:
    """The ledger's own rules over run records, some of which break one or more of them."""
    k = F.col("k")
    known = runs(spark, d).withColumn("k", F.substring("run_id", 5, 20).cast("long")).withColumnRenamed("run_id", "name")
    complete = F.col("measurement_status") == "complete"
    telemetry = F.struct(
        F.col("measurement_status"),
        F.lit("lab").alias("source"),
        F.lit("p").alias("provider"),
        F.when(k % 9 != 0, F.col("total_tokens") + 1).otherwise(0).cast("int").alias("total_tokens"),
        F.lit(1).alias("input_tokens"),
        F.lit(1).alias("output_tokens"),
        F.when(k % 13 != 0, F.col("wall_clock_seconds")).otherwise(0).cast("int").alias("wall_clock_seconds"),
        F.lit(0).alias("retry_count"),
        F.lit(0).alias("delegated_sessions"),
        F.when(~complete & (k % 2 != 0), F.array(F.lit("lost"))).otherwise(F.array().cast("array<string>")).alias("incomplete_reasons"),
    )
    records = known.select(
        "name",
        F.when(k % 23 != 0, "v1").otherwise("v9").alias("schema_version"),
        F.when(k % 17 != 0, F.col("name")).otherwise(F.concat(F.lit("../"), "name")).alias("run_id"),
        "task_id",
        F.col("mode").alias("condition_id"),
        F.when(k % 29 != 0, F.col("model")).otherwise(" ").alias("model"),
        F.col("topology").alias("session_topology"),
        F.when(k % 31 != 0, F.col("seed")).alias("seed"),
        F.lit("default").alias("prompt_variant"),
        "started_at",
        F.when(k % 19 != 0, F.col("started_at")).otherwise("1970-01-01T00:00:00Z").alias("finished_at"),
        telemetry.alias("telemetry"),
        F.when(k % 37 != 0, "a.json").otherwise("/etc/a.json").alias("kickoff_inputs_ref"),
        *[F.lit("b.json").alias(c) for c in ("session_structure_ref", "writeback_outputs_ref", "outcome_artifacts_ref")],
    )
    tasks = spark.createDataFrame([(f"task-{i}",) for i in range(35)], "task_id string")
    conditions = spark.createDataFrame([(m,) for m in ("graph_backed", "baseline", "with_harness", "without_harness")], "condition_id string")
    found = run_violations(records, tasks, conditions)
    return found.select(F.col("name").alias("run_id"), F.array_join(F.transform("violations", lambda v: v["field"]), ",").alias("fields"))


#: Orders as benchmark runs: two neighbouring keys share a scenario; some name another one, an unknown mode or schema, or lack a metric.
_BENCH = """
run AS (SELECT 's' || (o_orderkey // 2) AS of, 'r' || o_orderkey AS run_id, CASE WHEN o_orderkey % 41 = 0 THEN 'v9' ELSE 'v1' END AS version,
        CASE WHEN o_orderkey % 43 = 0 THEN '' WHEN o_orderkey % 47 = 0 THEN 'other' ELSE 's' || (o_orderkey // 2) END AS own,
        CASE WHEN o_orderkey % 53 = 0 THEN 'third' WHEN (o_orderkey + o_custkey % 5 // 4) % 2 = 0 THEN 'with_graph' ELSE 'without_graph' END AS mode,
        CAST(floor(o_totalprice) AS BIGINT) AS tokens, CASE WHEN o_custkey % 7 = 0 THEN 0 ELSE o_custkey END AS prompts, o_orderpriority AS rating, o_custkey % 4 AS passed FROM orders),
scen AS (SELECT DISTINCT of FROM run),
good AS (SELECT * FROM run WHERE own = of AND mode IN ('with_graph', 'without_graph')),
per AS (SELECT scen.of, m.mode, count(good.run_id) AS n FROM scen CROSS JOIN (VALUES ('with_graph'), ('without_graph')) AS m(mode) LEFT JOIN good ON good.of = scen.of AND good.mode = m.mode GROUP BY ALL),
first AS (SELECT of, 2 AS severity, 'unsupported_run_schema' AS code, NULL::VARCHAR AS mode, run_id, NULL::BIGINT AS n, '' AS fields FROM run WHERE version <> 'v1'
  UNION ALL SELECT of, 2, 'run_scenario_id_missing', NULL, run_id, NULL, '' FROM run WHERE own = ''
  UNION ALL SELECT of, 2, 'run_scenario_mismatch', NULL, run_id, NULL, '' FROM run WHERE own NOT IN ('', of)
  UNION ALL SELECT of, 2, 'unsupported_run_mode', mode, run_id, NULL, '' FROM run WHERE own = of AND mode = 'third'
  UNION ALL SELECT of, 1, 'missing_mode_run', mode, NULL, NULL, '' FROM per WHERE n = 0
  UNION ALL SELECT of, 2, 'multiple_mode_runs', mode, NULL, n, '' FROM per WHERE n > 1),
issue AS (SELECT * FROM first UNION ALL
  SELECT of, 1, 'missing_comparison_fields', mode, run_id, NULL, concat_ws(',', CASE WHEN prompts <= 0 THEN 'metrics.volume.prompt_count' END, CASE WHEN passed > 2 THEN 'metrics.outcome.acceptance_checks_passed' END)
  FROM good WHERE (prompts <= 0 OR passed > 2) AND of NOT IN (SELECT of FROM first)),
told AS (SELECT scen.of, coalesce(max(severity), 0) AS worst, count(issue.of) AS n_issues FROM scen LEFT JOIN issue ON issue.of = scen.of GROUP BY scen.of)"""


def _bench(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    of = F.concat(F.lit("s"), F.floor(k / 2).cast("string"))
    mode = F.when(k % 53 == 0, "third").when((k + F.floor(c % 5 / 4)) % 2 == 0, " With_Graph").otherwise("without_graph")
    whole = lambda x: x.cast("int")
    volume = F.struct(whole(F.floor("o_totalprice")).alias("input_tokens"), F.lit(7).alias("output_tokens"), whole(F.when(c % 7 != 0, c)).alias("prompt_count"), F.lit(9).alias("prompt_characters"))
    effort = F.struct(F.lit(1).alias("step_count"), F.lit(0).alias("repo_scans"), F.lit(None).cast("int").alias("follow_up_prompts"), F.lit(2).alias("context_reloads"))
    rated = F.concat(F.lit(" "), F.col("o_orderpriority"))
    outcome = F.struct(rated.alias("quality_rating"), F.lit("fine").alias("resumability_rating"), whole(c % 4).alias("acceptance_checks_passed"), F.lit(2).alias("acceptance_checks_total"))
    made = table(spark, d, "orders").select(
        of.alias("of"),
        F.when(k % 41 == 0, "v9").otherwise("v1").alias("schema_version"),
        F.lit(None).cast("string").alias("kind"),
        F.concat(F.lit("r"), k.cast("string")).alias("run_id"),
        F.when(k % 43 == 0, F.lit(None)).when(k % 47 == 0, F.lit("other")).otherwise(of).alias("scenario_id"),
        mode.alias("mode"),
        F.lit(None).cast("string").alias("recorded_at"),
        F.lit(None).cast("array<string>").alias("notes"),
        F.struct(volume.alias("volume"), effort.alias("orientation"), outcome.alias("outcome")).alias("metrics"),
    )
    modes = F.transform(F.array(F.lit("without_graph"), F.lit("WITH_GRAPH ")), lambda m: F.struct(m.alias("mode"), F.lit("do").alias("task_prompt"), F.lit(None).cast("array<string>").alias("notes")))
    kept = made.select("of").distinct().select("of", F.col("of").alias("scenario_id"), modes.alias("modes"), *[F.lit(v).cast("string").alias(n) for n, v in (("schema_version", "v1"), ("kind", None), ("task_family", "f"), ("title", "t"), ("acceptance_criteria_ref", None), ("created_at", None))])
    return B.loose_scenarios(kept), B.loose_runs(made)


@query(with_(_BENCH) + "SELECT of AS scenario_id, severity, code, coalesce(mode, '') AS mode, coalesce(run_id, '') AS run_id, coalesce(n, 0) AS n, fields FROM issue")
def benchmark_issues(spark: SparkSession, d: str) -> DataFrame:
    """Orders as runs of scenarios: everything that keeps them from being compared."""
    found = B.benchmark_issues(*_bench(spark, d))
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return found.select("scenario_id", "severity", "code", blank("mode"), blank("run_id"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.array_join("fields", ","), F.lit("")).alias("fields"))


@query(with_(_BENCH) + "SELECT CASE worst WHEN 0 THEN 'comparable' WHEN 1 THEN 'incomplete' ELSE 'non_comparable' END AS status, count(*) AS n, CAST(sum(n_issues) AS BIGINT) AS n_issues FROM told GROUP BY worst")
def benchmark_status(spark: SparkSession, d: str) -> DataFrame:
    kept, made = _bench(spark, d)
    return B.benchmark_status(kept, B.benchmark_issues(kept, made)).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("n_issues").alias("n_issues"))


@query(
    with_(_BENCH)
    + """, pair AS (SELECT a.of, a.tokens AS ta, b.tokens AS tb, a.prompts AS pa, b.prompts AS pb, a.rating AS ra, b.rating AS rb, a.passed AS ca, b.passed AS cb
  FROM good a JOIN good b ON a.of = b.of AND a.mode = 'with_graph' AND b.mode = 'without_graph' JOIN told ON told.of = a.of WHERE worst = 0)
SELECT of AS scenario_id, 'volume.input_tokens' AS metric, CAST(ta AS VARCHAR) AS with_graph, CAST(tb AS VARCHAR) AS without_graph, ta - tb AS delta, NULL::BOOLEAN AS matches FROM pair
UNION ALL SELECT of, 'volume.prompt_count', CAST(pa AS VARCHAR), CAST(pb AS VARCHAR), pa - pb, NULL FROM pair UNION ALL SELECT of, 'outcome.quality_rating', ra, rb, NULL, ra = rb FROM pair
UNION ALL SELECT of, 'outcome.acceptance_checks_passed', CAST(ca AS VARCHAR), CAST(cb AS VARCHAR), ca - cb, NULL FROM pair
UNION ALL SELECT of, m, v, v, CASE WHEN v = 'fine' THEN NULL ELSE 0 END, CASE WHEN v = 'fine' THEN true END FROM pair, (VALUES ('volume.output_tokens', '7'), ('volume.prompt_characters', '9'), ('orientation.step_count', '1'),
  ('orientation.repo_scans', '0'), ('orientation.follow_up_prompts', '0'), ('orientation.context_reloads', '2'), ('outcome.resumability_rating', 'fine'), ('outcome.acceptance_checks_total', '2')) AS c(m, v)"""
)
def benchmark_comparison(spark: SparkSession, d: str) -> DataFrame:
    kept, made = _bench(spark, d)
    return B.benchmark_comparison(made, B.benchmark_status(kept, B.benchmark_issues(kept, made))).drop("place")


@query(
    """SELECT 'run-' || o_orderkey AS run_id, '{"outcome":{"status":"' || o_orderstatus || '"},"task":"task-' || (o_custkey % 40) || '"}' AS shown FROM orders"""
)
def blinding_projection(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.blinding import blinded

    record = F.to_json(F.struct(F.concat(F.lit("task-"), (F.col("o_custkey") % 40).cast("string")).alias("task"), F.lit("with-graph").alias("condition_id"), F.struct(F.col("o_orderstatus").alias("status"), F.lit("graph_backed").alias("workflow_mode")).alias("outcome")))
    return table(spark, d, "orders").select(F.concat(F.lit("run-"), F.col("o_orderkey").cast("string")).alias("run_id"), blinded(record).alias("shown"))




@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def decision_windows(spark: SparkSession, d: str) -> DataFrame:
    counted = decision_counts(table(spark, d, "events"), "1 day")
    return counted.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("value", 4).alias("value"))
