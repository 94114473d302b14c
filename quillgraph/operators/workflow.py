"""Task families, kickoff policies, readiness and advisories, as expressions over columns of tasks and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strings

# Fixed values of task classification.
WRITE_WORDS = ["implement", "add ", "build", "create", "write", "modify", "refactor", "ship"]
TROUBLE_WORDS = ["diagnose", "debug", "troubleshoot", "investigate", "broken", "failing", "failure", "error"]
VERIFY_WORDS = ["audit", "verify", "validation", "validate", "check", "inspect", "review", "snapshot", "provenance", "evidence"]
STATS_WORDS = ["graph stats", "stats", "snapshot", "health indicator", "graph health", "count", "counts", "density", "duplicate", "duplication", "orphan", "contradiction", "contradictory"]
VERIFY_WORKFLOW_WORDS = ["workflow", "kickoff", "handoff", "delegated", "delegate", "bootstrap", "finish"]
REPORT_WORDS = ["report", "summarize", "summary", "synthesis", "synthesize", "debrief", "writeup", "analysis"]
WORKFLOW_WORDS = ["workflow", "handoff", "delegated", "delegate", "bootstrap"]
HYGIENE_WORDS = ["hygiene", "contradiction", "contradictory", "duplicate", "duplication", "orphan", "graph stats", "health indicator", "graph health"]
# Fixed values that several policies suppress.
_PLAIN = ["workflow_", "workflow-finish:"]
_HEALTH = ["graph stats", "graph health", "health indicator", "duplicate", "duplication", "contradiction", "orphan"]
# Fixed values of the policies: family, subprofile, allowed kinds, suppressed patterns, default mode,
# inject and minimal thresholds, inject and minimal token budgets, mode at low confidence.
POLICIES = [
    ("workflow_context", "", [], [], "inject", 0.70, 0.45, 1200, 300, "minimal"),
    ("write_producing", "", ["document", "decision", "story", "reasoningunit", "coderef", "file", "type", "function"], _PLAIN, "inject", 0.70, 0.45, 1200, 300, "minimal"),
    ("troubleshooting_diagnosis", "", ["document", "decision", "reasoningunit", "coderef", "file", "type", "function", "researchfinding"], _PLAIN, "inject", 0.70, 0.45, 900, 300, "minimal"),
    ("verification_audit", "stats_audit", ["document", "decision", "file", "researchfinding"], _PLAIN + VERIFY_WORKFLOW_WORDS, "minimal", 0.95, 0.60, 220, 120, "abstain"),
    ("verification_audit", "workflow_verification", ["document", "decision", "coderef", "file", "type", "function", "reasoningunit"], list(dict.fromkeys(_HEALTH + HYGIENE_WORDS)), "minimal", 0.90, 0.55, 320, 180, "minimal"),
    ("verification_audit", "general_verification", ["document", "decision", "coderef", "file", "type", "function", "researchfinding"], _PLAIN, "minimal", 0.85, 0.55, 400, 220, "abstain"),
    ("reporting_synthesis", "", [], _PLAIN, "abstain", 0.0, 1.0, 0, 0, "abstain"),
    ("ambiguous_task", "", ["document", "decision", "story", "coderef", "file"], _PLAIN, "minimal", 0.90, 0.50, 600, 220, "abstain"),
]
POLICY_SCHEMA = "family string, subprofile string, allowed_kinds array<string>, suppressed array<string>, default_mode string, inject_at double, minimal_at double, inject_budget int, minimal_budget int, low_mode string"


def normal_task(task: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(task, F.lit(""))), r"(?U)\s+", " "))


def _hits(task: Column, words: list[str]) -> Column:
    """The keywords, trimmed, that a task holds as substrings."""
    return F.filter(strings(list(dict.fromkeys(w.strip() for w in words))), lambda w: F.contains(task, w))


def _any(task: Column, words: list[str]) -> Column:
    return task.rlike("|".join(w.strip() for w in words))


def classify(tasks: DataFrame, task: str = "task") -> DataFrame:
    """Adds family, subprofile and basis (the matched keywords). Verification is tested first, writing last."""
    t = F.col("__t")
    verify = _any(t, VERIFY_WORDS) | _any(t, HYGIENE_WORDS)
    stats = _any(t, STATS_WORDS) | _any(t, HYGIENE_WORDS)
    workflow = _any(t, VERIFY_WORKFLOW_WORDS)
    family = (
        F.when(verify, "verification_audit")
        .when(_any(t, WORKFLOW_WORDS), "workflow_context")
        .when(_any(t, REPORT_WORDS), "reporting_synthesis")
        .when(_any(t, TROUBLE_WORDS), "troubleshooting_diagnosis")
        .when(_any(t, WRITE_WORDS), "write_producing")
        .otherwise("ambiguous_task")
    )
    sub = F.when(verify & stats, "stats_audit").when(verify & workflow, "workflow_verification").when(verify, "general_verification").otherwise("")
    seen = F.concat(_hits(t, VERIFY_WORDS), _hits(t, HYGIENE_WORDS))
    basis = (
        F.when(sub == "stats_audit", F.concat(seen, _hits(t, STATS_WORDS)))
        .when(sub == "workflow_verification", F.concat(seen, _hits(t, VERIFY_WORKFLOW_WORDS)))
        .when(verify, seen)
        .when(family == "workflow_context", _hits(t, WORKFLOW_WORDS))
        .when(family == "reporting_synthesis", _hits(t, REPORT_WORDS))
        .when(family == "troubleshooting_diagnosis", _hits(t, TROUBLE_WORDS))
        .when(family == "write_producing", _hits(t, WRITE_WORDS))
        .otherwise(strings(["no_family_keywords_matched"]))
    )
    return tasks.withColumn("__t", normal_task(F.col(task))).select("*", family.alias("family"), sub.alias("subprofile"), F.array_distinct(basis).alias("basis")).drop("__t")


def policies(spark: SparkSession) -> DataFrame:
    """The eight policies; a fixed small table, broadcast wherever it is joined."""
    return spark.createDataFrame(POLICIES, POLICY_SCHEMA)


def with_policy(classified: DataFrame) -> DataFrame:
    return classified.join(F.broadcast(policies(classified.sparkSession)), ["family", "subprofile"], "left")


def suppressed(family: str, subprofile: str = "") -> Column:
    """Whether a candidate (id, kind, title, summary) is off a family's profile. The workflow family is not filtered."""
    if family == "workflow_context":
        return F.lit(False)
    policy = next(p for p in POLICIES if p[:2] == (family, subprofile))
    low = {c: F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))) for c in ("kind", "id", "title", "summary")}
    off = F.lit(False)
    if policy[2]:
        off = ~low["kind"].isin(policy[2])
    for text in low.values():
        for pattern in policy[3]:
            off = off | F.contains(text, F.lit(pattern.strip()))
    if (family, subprofile) != ("verification_audit", "workflow_verification"):
        off = off | low["kind"].startswith("workflow_") | low["id"].startswith("workflow-finish:")
    return off


def high_signal() -> Column:
    """score >= 10, two matched terms, or a relation that supports the task or meets a seed."""
    near = F.exists("graph_refs", lambda r: r["direction"].isin("supports_task", "matched_seed"))
    return (F.col("score") >= 10) | (F.size("matched_terms") >= 2) | near


def readiness(stats: DataFrame) -> DataFrame:
    """recommendation and reasons from a row of nodes, edges, density, duplication_rate, orphan_rate, contradictory_facts."""
    some = lambda *pairs: F.array_compact(F.array(*[F.when(c, name) for c, name in pairs]))
    care = some((F.col("contradictory_facts") > 0, "contradictions_detected"), (F.col("duplication_rate") >= 0.15, "duplication_rate_high"), (F.col("orphan_rate") >= 0.20, "orphan_rate_high"))
    thin = some((F.col("nodes") < 3, "graph_too_small"), (F.col("edges") < 2, "graph_relationships_sparse"), (F.col("density") < 0.10, "graph_density_low"))
    what = F.when(F.col("nodes") == 0, "bootstrap").when(F.size(care) > 0, "inspect_hygiene").when(F.size(thin) > 0, "gather_context").otherwise("proceed")
    why = F.when(what == "bootstrap", strings(["graph_empty"])).when(what == "inspect_hygiene", care).when(what == "gather_context", thin).otherwise(strings(["current_revision_available", "acceptable_health_indicators"]))
    return stats.select("*", what.alias("recommendation"), why.alias("reasons"), F.when(what == "proceed", "ready").otherwise("action_required").alias("status"))


def kickoff_confidence(rows: DataFrame) -> DataFrame:
    """confidence, level and reasons from n_results, n_projected, n_high_signal, n_suppressed, nodes, edges, family."""
    family, audit = F.col("family"), F.col("family") == "verification_audit"
    high = F.col("n_high_signal")
    sparse = (F.col("nodes") < 3) | (F.col("edges") < 2)
    points = [
        (family == "ambiguous_task", 0.0, "ambiguous_task_family"),
        (F.col("n_results") > 0, 0.2, "retrieval_results_available"),
        (F.col("n_projected") > 0, 0.2, "projected_context_available"),
        (high >= 2, 0.4, "multiple_high_signal_results"),
        (high == 1, 0.25, "single_high_signal_result"),
        (high == 0, 0.0, "high_signal_results_missing"),
        (sparse, -0.15, "sparse_graph_state"),
        (family == "ambiguous_task", -0.15, None),
        (audit & (F.col("n_suppressed") > 0), -0.15, "verification_off_profile_contamination"),
        (audit & (F.col("n_results") == 0), -0.10, "verification_sparse_aligned_evidence"),
    ]
    total = sum((F.when(c, v).otherwise(0.0) for c, v, _ in points), F.lit(0.0))
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))
    level = F.when(score >= 0.7, "high").when(score >= 0.4, "medium").otherwise("low")
    why = F.array_compact(F.array(*[F.when(c, name) for c, _, name in points if name]))
    return rows.select("*", score.alias("confidence"), level.alias("level"), why.alias("confidence_reasons"))


def advisory(rows: DataFrame, max_tokens: int = 1200) -> DataFrame:
    """effective_mode, threshold, budget and next_step from confidence, its reasons, the policy columns and requested_mode."""
    asked = F.coalesce(F.nullif(F.lower(F.trim("requested_mode")), F.lit("")), F.lit("auto"))
    asked = F.when(asked == "none", "abstain").when(asked.isin("auto", "minimal", "abstain"), asked).otherwise("auto")
    none = F.col("default_mode") == "abstain"
    audit = F.col("family") == "verification_audit"
    low = F.when((F.col("low_mode") == "abstain") | (F.col("family") == "ambiguous_task"), "abstain").otherwise("minimal")
    auto = F.when((F.col("confidence") >= F.col("inject_at")) & (F.col("default_mode") == "inject"), "inject").when(F.col("confidence") >= F.col("minimal_at"), "minimal").otherwise(low)
    mode = F.when((asked == "abstain") | none, "abstain").when(asked == "minimal", "minimal").otherwise(auto)
    dirty = audit & F.array_contains("confidence_reasons", "verification_off_profile_contamination")
    bare = F.array_contains("confidence_reasons", "verification_sparse_aligned_evidence")
    mode = (
        F.when(dirty & (F.col("subprofile") == "stats_audit"), "abstain")
        .when(dirty & bare, "abstain")
        .when(dirty & (F.col("subprofile") == "workflow_verification"), "minimal")
        .otherwise(mode)
    )
    mode = F.when(audit & (F.col("subprofile") == "stats_audit") & (mode == "inject"), "minimal").otherwise(mode)
    most = F.lit(max_tokens)
    within = lambda c: F.when((F.col(c) > 0) & (F.col(c) < most), F.col(c)).otherwise(most)
    budget = F.when(mode == "abstain", 0).when(mode == "minimal", within("minimal_budget")).otherwise(within("inject_budget"))
    step = (
        F.when(mode == "inject", "proceed_with_kickoff")
        .when(mode == "minimal", "proceed_with_minimal_kickoff")
        .when(asked == "abstain", "proceed_with_fresh_context")
        .when(audit, "pull_verification_context_on_demand")
        .otherwise("pull_graph_on_demand")
    )
    return rows.select("*", mode.alias("effective_mode"), F.when(mode == "inject", F.col("inject_at")).otherwise(F.col("minimal_at")).alias("threshold"), budget.cast("int").alias("budget"), step.alias("next_step"))


def inclusion_reason(family: Column, subprofile: Column) -> Column:
    """Why a result is in the kickoff context."""
    label = F.when(subprofile != "", F.concat_ws("/", family, subprofile)).otherwise(family)
    # The three texts.
    return (
        F.when(F.size("matched_terms") > 0, F.format_string("Included for the %s family because it matches task terms: %s.", label, F.array_join("matched_terms", ", ")))
        .when(F.size("graph_refs") > 0, F.format_string("Included for the %s family because graph relationships connect it to the delegated task context.", label))
        .otherwise(F.format_string("Included for the %s family because it survived the family policy and ranked among the strongest available kickoff candidates.", label))
    )
