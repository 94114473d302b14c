"""Queries of candidate scoring, decisions, task families, advisories and packing."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_rfc3339, ratio, rounded
from ..functions.text import NEGATIVE, POLAR, POSITIVE, STOP_WORDS, excerpt, slug, terms
from ..operators import context as C
from ..operators import evaluation as E
from ..operators import health as H
from ..operators import retrieval as R
from ..operators import workflow as W
from ..operators.seed import markdown_summaries
from ..sources.adapter import entities, relations, table
from .graph_queries import _INDICATORS, TASK, TASK_TERMS
from .sqlbase import ENTITY, FUSED, POSTED, RELATION, expand_sql, r, search_sql, with_

QUERIES: dict = {}
ORACLE: dict = {}
NOW = "2024-06-01T00:00:00Z"
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# --------------------------------------------------------------------------- candidate scores

_CLAMP = "least(1.0, greatest(0.0, {}))"


def clamp_sql(x: str) -> str:
    return _CLAMP.format(x)


_TERMS_SQL = f"list_sort(list_distinct(list_filter(regexp_extract_all(lower(concat_ws(' ', id, kind, coalesce(title, ''), coalesce(summary, ''), coalesce(content, ''), coalesce(repo_path, ''), coalesce(tag, ''))), '[a-z0-9]+'), lambda x: x NOT IN ({_STOP}))))"
_N = len(TASK_TERMS)
_ASKED = "[" + ", ".join(f"'{t}'" for t in TASK_TERMS) + "]"
_REL = clamp_sql("0.5 * cov + 0.35 * weighted + 0.15 * support")
_CONS0 = clamp_sql("0.45 * recency + 0.35 * " + clamp_sql("0.45 + 0.55 * support") + " + 0.2 * cov - 0.0")
_CONS = f"CASE WHEN cov > 0.6 THEN {clamp_sql(_CONS0 + ' + 0.1')} ELSE {_CONS0} END"
_USE0 = clamp_sql(f"0.55 * {_REL} + 0.25 * focus + 0.2 * dense")
_USE = f"CASE WHEN stale THEN {clamp_sql(_USE0 + ' - 0.1')} ELSE {_USE0} END"
_SUPPORT_SQL = "CASE direction WHEN 'supports_task' THEN 1.0 WHEN 'matched_seed' THEN 0.6 WHEN 'outgoing_neighbor' THEN 0.35 WHEN 'incoming_neighbor' THEN 0.35 ELSE 0.15 END"
_SCORES = with_(ENTITY, RELATION, POSTED, search_sql(TASK_TERMS), expand_sql("dependents"), FUSED) + f""",
ref AS (SELECT id, sum({_SUPPORT_SQL}) AS raw, count(*) AS n FROM gave GROUP BY id),
wt AS (SELECT id, sum(w) AS w FROM posted WHERE term IN ({', '.join(f"'{t}'" for t in TASK_TERMS)}) GROUP BY id),
cand AS (SELECT e.*, {_TERMS_SQL} AS terms, f.matched FROM fused f JOIN entity e USING (id)),
ages AS (SELECT *, greatest(0.0, (epoch_us(TIMESTAMP '2024-06-01 00:00:00') - epoch_us(strptime(coalesce(updated_at, '2024-01-01T00:00:00Z'), '%Y-%m-%dT%H:%M:%SZ'))) / 1e6 / 86400.0) AS age FROM cand),
part AS (SELECT a.id, a.terms, list_intersect({_ASKED}, list_distinct(list_concat(a.terms, a.matched))) AS hits, age, age > 30 AS stale,
   CASE WHEN age <= 30 THEN {clamp_sql('1 - 0.15 * age / 30.0')} ELSE {clamp_sql('0.85 - 0.45 * (age - 30.0) / 30.0')} END AS recency,
   {clamp_sql('1 - exp(-coalesce(ref.raw, 0))')} AS support, {clamp_sql(f'coalesce(wt.w, 0) / {3.0 * _N}')} AS weighted,
   {clamp_sql("((CASE WHEN trim(coalesce(title, '')) <> '' THEN 1 ELSE 0 END) + (CASE WHEN trim(coalesce(summary, '')) <> '' THEN 1 ELSE 0 END) + (CASE WHEN trim(coalesce(content, '')) <> '' THEN 1 ELSE 0 END) + (CASE WHEN trim(coalesce(repo_path, '')) <> '' THEN 1 ELSE 0 END) + (CASE WHEN tag IS NULL THEN 0 ELSE 1 END) + least(coalesce(ref.n, 0), 2)) / 8.0")} AS dense
   FROM ages a LEFT JOIN ref ON a.id = ref.id LEFT JOIN wt ON a.id = wt.id),
feat AS (SELECT *, len(hits) / {_N}.0 AS cov, CASE WHEN len(terms) = 0 THEN 0.0 ELSE len(hits) / CAST(len(terms) AS DOUBLE) END AS focus FROM part),
dims AS (SELECT id, {r(_REL, 3)} AS relevance, {r(_CONS, 3)} AS consistency, {r(_USE, 3)} AS usefulness, len(hits) AS n_matched, stale, {r('age', 3)} AS age_days FROM feat),
score AS (SELECT *, {r(clamp_sql('relevance * (1 / 3.0) + consistency * (1 / 3.0) + usefulness * (1 / 3.0)'), 3)} AS composite FROM dims),
fated AS (SELECT *, CASE WHEN relevance < 0.25 THEN 'below relevance threshold' WHEN consistency < 0.35 THEN 'below consistency threshold' WHEN usefulness < 0.2 THEN 'below usefulness threshold' WHEN composite < 0.4 THEN 'below composite threshold' END AS reason FROM score),
scored AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 'rejected' WHEN composite >= 0.65 THEN 'survived' ELSE 'trimmed' END AS fate FROM fated)
"""


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return R.candidates(entities(spark, d), partial(relations, spark, d), TASK)


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return E.evaluate(_candidates(spark, d), TASK, NOW, among=False)


@query(_SCORES + "SELECT id, relevance, consistency, usefulness, composite, fate, CAST(n_matched AS BIGINT) AS n_matched, stale, age_days FROM scored")
def candidate_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("id", "relevance", "consistency", "usefulness", "composite", "fate", F.size("matched").cast("long").alias("n_matched"), "stale", "age_days")


@query(_SCORES + "SELECT fate, coalesce(reason, '') AS reason, count(*) AS n FROM scored GROUP BY fate, reason")
def fate_classify(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).groupBy("fate", F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


_AGG = clamp_sql("coalesce(avg(composite) FILTER (fate = 'survived'), avg(composite) FILTER (fate = 'trimmed'), avg(composite), 0)")


@query(_SCORES + f"SELECT {r(_AGG)} AS confidence FROM scored")
def aggregate_confidence(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).agg(rounded(E.aggregate_confidence(), 6).alias("confidence"))


# --------------------------------------------------------------------------- conflicts and outputs

#: What an order's status says, with words of opposite sense.
_STATED = "CASE status WHEN 'O' THEN 'currently active' WHEN 'F' THEN 'now removed' ELSE 'in doubt' END"
_AGAINST = "CASE WHEN kind <> 'Order' THEN 0 WHEN status = 'O' THEN n_gone WHEN status = 'F' THEN n_here ELSE 0 END"
_CONS0_C = _CONS0.replace("- 0.0", "- least(0.75, 0.4 * nc)")
_CONS_C = f"CASE WHEN cov > 0.6 AND nc = 0 THEN {clamp_sql(_CONS0_C + ' + 0.1')} ELSE {_CONS0_C} END"
_USE_C = f"CASE WHEN nc > 0 THEN {clamp_sql('(' + _USE + ') - 0.15')} ELSE {_USE} END"
_SCORES_C = (
    _SCORES.replace(
        "cand AS (SELECT e.*,",
        f"stated AS (SELECT * REPLACE (CASE WHEN kind = 'Order' THEN {_STATED} ELSE content END AS content) FROM entity),\ncand AS (SELECT e.*,",
    )
    .replace("FROM fused f JOIN entity e USING (id))", "FROM fused f JOIN stated e USING (id)),\ntold AS (SELECT count(*) FILTER (kind = 'Order' AND status = 'O') AS n_here, count(*) FILTER (kind = 'Order' AND status = 'F') AS n_gone FROM cand)")
    .replace("part AS (SELECT a.id,", f"part AS (SELECT a.id, {_AGAINST} AS nc,")
    .replace("FROM ages a LEFT JOIN ref", "FROM told, ages a LEFT JOIN ref")
    .replace(f"{r(_CONS, 3)} AS consistency", f"{r(_CONS_C, 3)} AS consistency")
    .replace(f"{r(_USE, 3)} AS usefulness", f"{r(_USE_C, 3)} AS usefulness, least(nc, 2) AS nc")
)


def _stated(df: DataFrame) -> DataFrame:
    """Orders say their status in words, so that they contradict each other."""
    status = F.get_json_object("props_json", "$.status")
    words = F.when(status == "O", "currently active").when(status == "F", "now removed").otherwise("in doubt")
    return df.withColumn("content", F.when(F.col("kind") == "Order", words).otherwise(F.col("content")))


@query(_SCORES_C + "SELECT id, relevance, consistency, usefulness, composite, fate, coalesce(reason, '') AS reason, CAST(nc AS BIGINT) AS n_conflicts FROM scored")
def conflicting_scores(spark: SparkSession, d: str) -> DataFrame:
    """Candidates that contradict each other, with the penalty; every order has thousands of opponents on one subject."""
    scored = E.evaluate(_stated(_candidates(spark, d)), TASK, NOW)
    return scored.select("id", "relevance", "consistency", "usefulness", "composite", "fate", F.coalesce("reason", F.lit("")).alias("reason"), "n_conflicts")


_OUT_TASK = "red widget order"
_WORDS = lambda x: f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda x: x NOT IN ({_STOP})))"
_OUT_SCORE = f"""
{{p}}m AS (SELECT *, len(list_intersect(terms, ['order', 'red', 'widget'])) AS m, len(list_intersect({_WORDS('summary')}, ['order', 'red', 'widget'])) AS ms, len(terms) AS nt FROM {{p}}t),
{{p}}f AS (SELECT *, m / 3.0 AS cov, m / CAST(nt AS DOUBLE) AS focus, least(1.0, (0.25 * mi + 2.5 * ms) / 9.0) AS weighted, (1 + (CASE WHEN content <> '' THEN 1 ELSE 0 END)) / 8.0 AS dense FROM {{p}}m),
{{p}}r AS (SELECT *, {clamp_sql('0.5 * cov + 0.35 * weighted')} AS rel, {clamp_sql('0.45 * 0.65 + 0.35 * 0.45 + 0.2 * cov - least(0.75, 0.4 * nc)')} AS con FROM {{p}}f),
{{p}}u AS (SELECT *, {clamp_sql('0.55 * rel + 0.25 * focus + 0.2 * dense')} AS use0 FROM {{p}}r),
{{p}}d AS (SELECT id, least(nc, 2) AS nc, {r('rel', 3)} AS relevance, {r('CASE WHEN nc = 0 AND cov > 0.6 THEN ' + clamp_sql('con + 0.1') + ' ELSE con END', 3)} AS consistency,
   {r('CASE WHEN nc > 0 THEN ' + clamp_sql('use0 - 0.15') + ' ELSE use0 END', 3)} AS usefulness FROM {{p}}u),
{{p}}s AS (SELECT *, {r(clamp_sql('relevance * (1 / 3.0) + consistency * (1 / 3.0) + usefulness * (1 / 3.0)'), 3)} AS composite FROM {{p}}d)"""


@query(
    with_(ENTITY)
    + f""", o AS (SELECT id, title, summary AS priority, {_STATED} AS said, status FROM entity WHERE kind = 'Order'),
n AS (SELECT count(*) FILTER (status = 'O') AS n_here, count(*) FILTER (status = 'F') AS n_gone FROM o),
cur_t AS (SELECT id, title || ' ' || said AS summary, priority AS content, 1 AS mi, CASE status WHEN 'O' THEN n_gone WHEN 'F' THEN n_here ELSE 0 END AS nc,
       {_WORDS("concat_ws(' ', id, 'task_output', title, said, priority)")} AS terms FROM o, n),
pri_t AS (SELECT id, 'Red widget order' AS summary, '' AS content, 1 AS mi, 0 AS nc, {_WORDS("concat_ws(' ', id, 'task_output', 'red widget order')")} AS terms FROM o WHERE status <> 'P'),"""
    + _OUT_SCORE.replace("{p}", "cur_")
    + ","
    + _OUT_SCORE.replace("{p}", "pri_")
    + f""" SELECT a.id, a.relevance, a.consistency, a.usefulness, a.composite, CAST(a.nc AS BIGINT) AS n_conflicts, b.composite AS prior_composite, {r('(a.composite - b.composite)', 3)} AS composite_delta,
 ({r('(a.composite - b.composite)', 3)} < -0.05) OR (a.relevance + 0.05 < b.relevance) OR (a.usefulness + 0.05 < b.usefulness) AS regressed
FROM cur_s a LEFT JOIN pri_s b ON a.id = b.id"""
)
def output_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """A text about every order, scored against the stored orders, which contradict it, and against an earlier text where there was one."""
    stored = _stated(entities(spark, d).where("kind = 'Order'"))
    had = F.get_json_object("props_json", "$.status") != "P"
    outputs = stored.select(
        "id", F.concat_ws(" ", "title", "content").alias("summary"), F.col("summary").alias("content"),
        F.when(had, "Red widget order").alias("prior_summary"), F.lit(None).cast("string").alias("prior_content"),
    )
    return E.evaluate_output(outputs, _OUT_TASK, NOW, stored).drop("matched", "reasons")


def _lists(name: str, groups: list[list[str]]) -> str:
    return ", ".join(f"list_has_any(terms, [{', '.join(repr(w) for w in g)}]) AS {name}{i}" for i, g in enumerate(groups))


_POLAR = "[" + ", ".join(repr(w) for w in POLAR) + "]"


_STATES = "CASE o_orderkey % 40 WHEN 0 THEN 'enabled' WHEN 1 THEN 'disabled' WHEN 2 THEN 'allowed' WHEN 3 THEN 'blocked' ELSE 'stable' END"


@query(
    f"""WITH c AS (SELECT 'order:' || o_orderkey AS id, list_sort(list_distinct(['customer' || o_custkey, {_STATES}])) AS terms FROM orders),
p AS (SELECT id, {_lists('p', POSITIVE)}, {_lists('n', NEGATIVE)}, unnest(list_filter(terms, lambda t: NOT list_contains({_POLAR}, t))) AS term FROM c)
SELECT DISTINCT a.id, b.id AS other FROM p a JOIN p b ON a.term = b.term AND a.id <> b.id WHERE (a.p0 AND b.n0) OR (a.n0 AND b.p0) OR (a.p1 AND b.n1) OR (a.n1 AND b.p1)"""
)
def candidate_conflicts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 40
    state = F.when(k == 0, "enabled").when(k == 1, "disabled").when(k == 2, "allowed").when(k == 3, "blocked").otherwise("stable")
    text = F.concat_ws(" ", F.concat(F.lit("customer"), F.col("o_custkey").cast("string")), state)
    rows = table(spark, d, "orders").select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("id"), terms(text).alias("terms"))
    return E.conflicts(rows, rows)


# --------------------------------------------------------------------------- decisions

_DEC = "WITH v AS (SELECT o_orderkey AS k, (o_orderkey % 1001) / 1000.0 AS confidence, CASE WHEN o_orderkey % 3 = 0 THEN ((o_orderkey * 7) % 1001) / 1000.0 END AS prior FROM orders)"


def _confidences(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("k"), ((k % 1001) / 1000.0).alias("confidence"), F.when(k % 3 == 0, ((k * 7) % 1001) / 1000.0).alias("prior"))


@query(_DEC + " SELECT k, CASE WHEN prior - confidence >= 0.1 THEN 'backtrack' WHEN confidence >= 0.7 THEN 'continue' WHEN confidence >= 0.4 THEN 'minimal' ELSE 'abstain' END AS outcome FROM v")
def decide_outcome(spark: SparkSession, d: str) -> DataFrame:
    return _confidences(spark, d).select("k", E.outcome(F.col("confidence"), F.col("prior")).alias("outcome"))


@query(
    _DEC
    + """ SELECT k, CASE WHEN confidence >= 0.8 THEN 'write' ELSE 'abstain' END AS outcome, CASE WHEN confidence >= 0.8 THEN 'approved' WHEN confidence >= 0.55 THEN 'deferred' ELSE 'skipped' END AS write_status,
CASE WHEN confidence >= 0.8 THEN NULL WHEN confidence >= 0.55 THEN 'composite confidence ' || format('{:.4f}', confidence) || ' is below write threshold 0.8000 but above defer threshold 0.5500; write held for retry' ELSE 'composite confidence ' || format('{:.4f}', confidence) || ' is below defer threshold 0.5500; write suppressed without auto-retry' END AS reason FROM v"""
)
def write_gate(spark: SparkSession, d: str) -> DataFrame:
    return _confidences(spark, d).select("k", *E.write_gate(F.col("confidence")))


@query(_SCORES + ", k AS (SELECT *, row_number() OVER (ORDER BY (fate = 'survived') DESC, composite DESC, id) AS place, max(CASE WHEN fate = 'survived' THEN 1 ELSE 0 END) OVER () AS alive FROM scored) SELECT id, composite FROM k WHERE alive = 0 OR fate = 'survived'")
def decision_bundle(spark: SparkSession, d: str) -> DataFrame:
    return E.bundle(_scored(spark, d).select("id", "composite", "fate"), "continue").select("id", "composite")


@query(_SCORES + "SELECT id, composite FROM scored ORDER BY (fate = 'survived') DESC, composite DESC, id LIMIT 1")
def decision_bundle_minimal(spark: SparkSession, d: str) -> DataFrame:
    return E.bundle(_scored(spark, d).select("id", "composite", "fate"), "minimal").select("id", "composite")


@query(
    "WITH a AS (SELECT o_orderkey AS k, (o_orderkey % 997) / 1000.0 AS c, (o_orderkey % 89) / 100.0 AS rel, (o_orderkey % 97) / 100.0 AS u, (o_orderkey % 991) / 1000.0 AS pc, (o_orderkey % 83) / 100.0 AS pr, (o_orderkey % 79) / 100.0 AS pu FROM orders)"
    f" SELECT k AS id, {r('(c - pc)', 3)} AS composite_delta, ({r('(c - pc)', 3)} < -0.05) OR (rel + 0.05 < pr) OR (u + 0.05 < pu) AS regressed FROM a"
)
def output_regression(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    make = lambda c, r_, u: table(spark, d, "orders").select(k.alias("id"), ((k % c) / 1000.0).alias("composite"), ((k % r_) / 100.0).alias("relevance"), ((k % u) / 100.0).alias("usefulness"))
    return E.regression(make(997, 89, 97), make(991, 83, 79)).select("id", "composite_delta", "regressed")


# --------------------------------------------------------------------------- tasks and advisories

_VERBS = ["Implement", "Diagnose why", "Audit", "Produce a report on", "Review the workflow of", "Look at", "Check the count of", "Hand off and delegate"]
_TASK_SQL = "CASE o_orderkey % 8 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(_VERBS)) + " END || ' ' || CASE o_orderkey % 5 WHEN 0 THEN 'the  kickoff handler' WHEN 1 THEN 'graph stats' WHEN 2 THEN 'an ERROR in parsing' WHEN 3 THEN 'provenance records' ELSE 'order ' || o_orderkey END"


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    verb = F.element_at(F.array(*map(F.lit, _VERBS)), (k % 8 + 1).cast("int"))
    what = F.when(k % 5 == 0, "the  kickoff handler").when(k % 5 == 1, "graph stats").when(k % 5 == 2, "an ERROR in parsing").when(k % 5 == 3, "provenance records").otherwise(F.concat(F.lit("order "), k.cast("string")))
    return table(spark, d, "orders").select(k, F.concat_ws(" ", verb, what).alias("task"))


def _any_sql(words: list[str]) -> str:
    return f"regexp_matches(t, '{'|'.join(w.strip() for w in words)}')"


_CLASS = f"""WITH x AS (SELECT o_orderkey, trim(regexp_replace(lower({_TASK_SQL}), '\\s+', ' ', 'g')) AS t FROM orders),
y AS (SELECT *, {_any_sql(W.VERIFY_WORDS + W.HYGIENE_WORDS)} AS verify FROM x),
classed AS (SELECT o_orderkey, CASE WHEN verify THEN 'verification_audit' WHEN {_any_sql(W.WORKFLOW_WORDS)} THEN 'workflow_context' WHEN {_any_sql(W.REPORT_WORDS)} THEN 'reporting_synthesis' WHEN {_any_sql(W.TROUBLE_WORDS)} THEN 'troubleshooting_diagnosis' WHEN {_any_sql(W.WRITE_WORDS)} THEN 'write_producing' ELSE 'ambiguous_task' END AS family,
 CASE WHEN NOT verify THEN '' WHEN {_any_sql(W.STATS_WORDS + W.HYGIENE_WORDS)} THEN 'stats_audit' WHEN {_any_sql(W.VERIFY_WORKFLOW_WORDS)} THEN 'workflow_verification' ELSE 'general_verification' END AS subprofile FROM y)"""


@query(_CLASS + " SELECT * FROM classed")
def family_classify(spark: SparkSession, d: str) -> DataFrame:
    return W.classify(_tasks(spark, d)).select("o_orderkey", "family", "subprofile")


_POLICY = "policy(family, subprofile, default_mode, inject_at, minimal_at, inject_budget, minimal_budget, low_mode) AS (VALUES " + ", ".join(f"('{p[0]}', '{p[1]}', '{p[4]}', CAST({p[5]} AS DOUBLE), CAST({p[6]} AS DOUBLE), {p[7]}, {p[8]}, '{p[9]}')" for p in W.POLICIES) + ")"


@query(_CLASS + f", {_POLICY} SELECT o_orderkey, family, subprofile, default_mode, inject_at, minimal_at, inject_budget, minimal_budget, low_mode FROM classed JOIN policy USING (family, subprofile)")
def policy_join(spark: SparkSession, d: str) -> DataFrame:
    return W.with_policy(W.classify(_tasks(spark, d))).select("o_orderkey", "family", "subprofile", "default_mode", "inject_at", "minimal_at", "inject_budget", "minimal_budget", "low_mode")


def _off_sql(policy: tuple) -> str:
    """A policy's filter in SQL: kinds that are not allowed, suppressed patterns in any text, and workflow traces."""
    family, subprofile, kinds, patterns = policy[:4]
    if family == "workflow_context":
        return "false"
    texts = [f"lower(trim(coalesce({c}, '')))" for c in ("kind", "id", "title", "summary")]
    off = [f"lower(kind) NOT IN ({', '.join(repr(k) for k in kinds)})"] if kinds else []
    off += [f"contains({t}, '{p.strip()}')" for t in texts for p in patterns]
    if (family, subprofile) != ("verification_audit", "workflow_verification"):
        off += [f"starts_with({texts[0]}, 'workflow_')", f"starts_with({texts[1]}, 'workflow-finish:')"]
    return " OR ".join(off) or "false"


_SUPPRESSED = " UNION ALL ".join(f"SELECT '{p[0]}' AS family, '{p[1]}' AS subprofile, kind, count(*) AS n FROM e WHERE NOT ({_off_sql(p)}) GROUP BY kind" for p in W.POLICIES)


@query(with_(ENTITY) + f", e AS (SELECT id, kind, title, summary FROM entity UNION ALL SELECT 'workflow-finish:' || id, 'Workflow_Trace', title, 'Stats  ' || summary FROM entity WHERE kind IN ('Part', 'Region')) {_SUPPRESSED}")
def suppress_filter(spark: SparkSession, d: str) -> DataFrame:
    """What every family's profile leaves of the entities and of traces made from some of them."""
    e = entities(spark, d).select("id", "kind", "title", "summary")
    traces = e.where("kind in ('Part', 'Region')").select(F.concat(F.lit("workflow-finish:"), "id").alias("id"), F.lit("Workflow_Trace").alias("kind"), "title", F.concat(F.lit("Stats  "), "summary").alias("summary"))
    rows = e.unionByName(traces)
    left = [rows.where(~W.suppressed(p[0], p[1])).groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.lit(p[0]).alias("family"), F.lit(p[1]).alias("subprofile"), "kind", "n") for p in W.POLICIES]
    return reduce(DataFrame.unionByName, left)


@query(
    "WITH i AS (" + _INDICATORS + """), c AS (SELECT *, array_to_string(list_filter([CASE WHEN contradictory_facts > 0 THEN 'contradictions_detected' END, CASE WHEN duplication_rate >= 0.15 THEN 'duplication_rate_high' END, CASE WHEN orphan_rate >= 0.2 THEN 'orphan_rate_high' END], lambda x: x IS NOT NULL), ',') AS care,
array_to_string(list_filter([CASE WHEN nodes < 3 THEN 'graph_too_small' END, CASE WHEN edges < 2 THEN 'graph_relationships_sparse' END, CASE WHEN density < 0.1 THEN 'graph_density_low' END], lambda x: x IS NOT NULL), ',') AS thin FROM i)
SELECT CASE WHEN nodes = 0 THEN 'bootstrap' WHEN care <> '' THEN 'inspect_hygiene' WHEN thin <> '' THEN 'gather_context' ELSE 'proceed' END AS recommendation, CASE WHEN care <> '' THEN care ELSE thin END AS reasons FROM c"""
)
def readiness(spark: SparkSession, d: str) -> DataFrame:
    """Readiness asks for no clustering, so no triangle is counted."""
    return W.readiness(H.indicators(entities(spark, d), relations(spark, d), clustered=False)).select("recommendation", F.array_join("reasons", ",").alias("reasons"))


_COUNTS = "o_orderkey % 4 AS n_results, o_orderkey % 3 AS n_projected, o_orderkey % 3 AS n_high_signal, (o_orderkey // 4) % 2 AS n_suppressed, CASE WHEN o_orderkey % 11 = 0 THEN 2 ELSE 50 END AS nodes, 100 AS edges, CASE o_orderkey % 6 WHEN 0 THEN 'minimal' WHEN 1 THEN 'none' WHEN 2 THEN 'inject' ELSE '' END AS requested_mode"
_KICK = (
    _CLASS
    + f", {_POLICY}, z AS (SELECT *, {_COUNTS} FROM classed JOIN policy USING (family, subprofile)), aud AS (SELECT *, family = 'verification_audit' AS audit FROM z),"
    + """ pts AS (SELECT *, least(1.0, greatest(0.0, 0.0 + 0.0 + CASE WHEN n_results > 0 THEN 0.2 ELSE 0.0 END + CASE WHEN n_projected > 0 THEN 0.2 ELSE 0.0 END + CASE WHEN n_high_signal >= 2 THEN 0.4 ELSE 0.0 END + CASE WHEN n_high_signal = 1 THEN 0.25 ELSE 0.0 END + 0.0 + CASE WHEN nodes < 3 OR edges < 2 THEN -0.15 ELSE 0.0 END + CASE WHEN family = 'ambiguous_task' THEN -0.15 ELSE 0.0 END + CASE WHEN audit AND n_suppressed > 0 THEN -0.15 ELSE 0.0 END + CASE WHEN audit AND n_results = 0 THEN -0.10 ELSE 0.0 END)) AS confidence FROM aud)"""
)


def _kick(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = W.with_policy(W.classify(_tasks(spark, d)))
    rows = rows.select("*", (k % 4).alias("n_results"), (k % 3).alias("n_projected"), (k % 3).alias("n_high_signal"), (F.floor(k / 4) % 2).alias("n_suppressed"), F.when(k % 11 == 0, 2).otherwise(50).alias("nodes"), F.lit(100).alias("edges"), F.when(k % 6 == 0, "minimal").when(k % 6 == 1, "none").when(k % 6 == 2, "inject").otherwise("").alias("requested_mode"))
    return W.kickoff_confidence(rows)


@query(_KICK + f" SELECT o_orderkey, {r('confidence')} AS confidence, CASE WHEN confidence >= 0.7 THEN 'high' WHEN confidence >= 0.4 THEN 'medium' ELSE 'low' END AS level FROM pts")
def kickoff_confidence(spark: SparkSession, d: str) -> DataFrame:
    return _kick(spark, d).select("o_orderkey", rounded(F.col("confidence"), 6).alias("confidence"), "level")


@query(
    _KICK
    + """, m AS (SELECT *, CASE requested_mode WHEN 'none' THEN 'abstain' WHEN 'minimal' THEN 'minimal' ELSE 'auto' END AS asked FROM pts),
n AS (SELECT *, CASE WHEN asked = 'abstain' OR default_mode = 'abstain' THEN 'abstain' WHEN asked = 'minimal' THEN 'minimal' WHEN confidence >= inject_at AND default_mode = 'inject' THEN 'inject' WHEN confidence >= minimal_at THEN 'minimal' WHEN low_mode = 'abstain' OR family = 'ambiguous_task' THEN 'abstain' ELSE 'minimal' END AS mode0 FROM m),
o AS (SELECT *, CASE WHEN audit AND n_suppressed > 0 AND subprofile = 'stats_audit' THEN 'abstain' WHEN audit AND n_suppressed > 0 AND n_results = 0 THEN 'abstain' WHEN audit AND n_suppressed > 0 AND subprofile = 'workflow_verification' THEN 'minimal' ELSE mode0 END AS mode FROM n)
SELECT o_orderkey, mode AS effective_mode, CAST(CASE WHEN mode = 'abstain' THEN 0 WHEN mode = 'minimal' THEN CASE WHEN minimal_budget > 0 AND minimal_budget < 1200 THEN minimal_budget ELSE 1200 END ELSE CASE WHEN inject_budget > 0 AND inject_budget < 1200 THEN inject_budget ELSE 1200 END END AS INTEGER) AS budget,
CASE WHEN mode = 'inject' THEN 'proceed_with_kickoff' WHEN mode = 'minimal' THEN 'proceed_with_minimal_kickoff' WHEN asked = 'abstain' THEN 'proceed_with_fresh_context' WHEN audit THEN 'pull_verification_context_on_demand' ELSE 'pull_graph_on_demand' END AS next_step FROM o"""
)
def kickoff_advisory(spark: SparkSession, d: str) -> DataFrame:
    return W.advisory(_kick(spark, d)).select("o_orderkey", "effective_mode", "budget", "next_step")


# --------------------------------------------------------------------------- scalar functions


@query(
    "SELECT c_custkey, regexp_replace(regexp_replace(substr(regexp_replace(regexp_replace(lower(c_name || ' / ' || c_mktsegment), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 24), '-+$', ''), '^$', '') AS slug, CASE WHEN c_acctbal = 0 THEN 0.0 ELSE c_custkey / c_acctbal END AS share FROM customer"
)
def scalar_functions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", slug(F.concat_ws(" / ", "c_name", "c_mktsegment")).alias("slug"), ratio(F.col("c_custkey"), F.col("c_acctbal")).alias("share"))


@query("SELECT event_id, event_id % 3 <> 1 AS ok FROM events")
def timestamp_check(spark: SparkSession, d: str) -> DataFrame:
    stamp = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+02:00'"))
    return table(spark, d, "events").select("event_id", is_rfc3339(stamp).alias("ok"))


# --------------------------------------------------------------------------- sequential operators (no SQL form)


@query()
def context_pack(spark: SparkSession, d: str) -> DataFrame:
    """One packed context for each part brand: its parts by size and name, within 300 tokens."""
    part = entities(spark, d).where("kind = 'Part'").withColumn("brand", F.col("summary"))
    near = R.structural(relations(spark, d).where("kind = 'DEPENDS_ON' and from_id like 'part:%'").select(F.col("from_id").alias("id"), F.lit("outgoing_neighbor").alias("direction"), "from_id", "to_id", "kind"))
    rows = part.join(near, "id", "left").withColumn("score", F.coalesce("structural", F.lit(0.0))).withColumn("matched_terms", terms(F.col("title")))
    placed = rows.withColumn("rank", F.row_number().over(Window.partitionBy("brand").orderBy(F.desc("score"), "id")))
    return C.pack_groups(placed.select("brand", "rank", "score", "id", "kind", "title", "summary", "matched_terms", "graph_refs", "created_at", "updated_at", "created_by", "updated_by", "created_session_id", "updated_session_id"), "brand", 300)


@query()
def markdown_summary(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("# Document "), F.col("doc_id").cast("string"), F.lit("\n\n"), F.coalesce("text", F.lit(""))).alias("text"))
    return markdown_summaries(docs, "doc_id", "text")


@query(
    r"""WITH d AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[\s\x0b\x85\p{Z}]+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, CASE WHEN strlen(t) <= 240 THEN t ELSE trim(left(t, list_max(list_filter(range(0, 238), lambda k: strlen(left(t, k)) <= 237)))) || '...' END AS excerpt FROM d"""
)
def text_excerpt(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", excerpt(F.col("text"), 240).alias("excerpt"))


