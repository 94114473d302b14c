"""The commands of the engine as methods that return response envelopes."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import attribution, bench_summary, briefs, context, diff, evaluation, finish, health, lab, retrieval, seed, workflow
from .sources import bench_files, ledger, workspace
from .sources.files import staged, staging
from .sources.index import TextIndex
from .sources.payload import EDGE, NODE, parse_edge, parse_node, read_payload
from .sources.store import Graph, Store, StoreError

VERSION = "v1"
#: Fates that a stored decision lists, best first; its count is of all candidates.
MOST_FATES = 1_000
#: Results that one page of a query holds unless another number is asked for.
MOST_RESULTS = 1_000
#: Rows of a plan's targets up to which they are broadcast.
BROADCAST_ROWS = 10_000


def command(name: str) -> Callable:
    """A method whose result or failure becomes an envelope; tables that it staged are deleted, as its result holds none."""

    def wrap(f: Callable) -> Callable:
        @wraps(f)
        def run(self, *args, **named) -> dict:
            try:
                with staging(self.spark):
                    return {"schema_version": VERSION, "command": name, "status": "ok", "result": f(self, *args, **named)}
            except (StoreError, ValueError) as e:
                return {"schema_version": VERSION, "command": name, "status": "error", "error": {"category": "validation", "type": type(e).__name__, "code": getattr(e, "code", "invalid_argument"), "message": str(e), "details": {}}}

        return run

    return wrap


def _plain(rows: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in rows.collect()]


@dataclass
class Engine:
    """A graph store and a ledger under one base path. Results that a command returns are reports, so they are collected."""

    spark: SparkSession
    base: str
    repository: str = "local"
    config: evaluation.Config = field(default_factory=evaluation.Config)
    thresholds: evaluation.Thresholds = field(default_factory=evaluation.Thresholds)
    #: Whether finish() scores an outcome against the graph before it is written.
    gate_writes: bool = True

    def __post_init__(self) -> None:
        self.store = Store(self.spark, f"{self.base}/graph")
        self.files = workspace.Files(self.spark, self.base)
        self.index = TextIndex(self.spark, f"{self.base}/index")

    def _config(self) -> dict:
        return {"schema_version": VERSION, "repository": self.repository}

    @command("init")
    def init(self) -> dict:
        """Keep the workspace's identity beside the graph; one that is there already must be the same."""
        have = self.files.read_json("workspace.json")
        if have is None:
            self.files.write_json("workspace.json", self._config())
        elif have != self._config():
            raise StoreError("workspace_mismatch", "the workspace is of another repository or schema version")
        return {"base": self.base, "repository": self.repository, "initialized": True, "already_exists": have is not None}

    @command("open")
    def open(self) -> dict:
        """The workspace's identity, checked."""
        have = self.files.read_json("workspace.json")
        if have is None:
            raise StoreError("workspace_not_initialized", f"{self.base} holds no workspace")
        if have != self._config():
            raise StoreError("workspace_mismatch", "the workspace is of another repository or schema version")
        return have

    @command("write")
    def write(self, payload: str) -> dict:
        return self.store.write(*read_payload(self.spark, payload))

    # ---------------------------------------------------------------- queries

    def _ranked(self, graph: Graph, task: str, hits: DataFrame | None = None) -> DataFrame:
        if not task.strip():
            raise ValueError("a task is required")
        found = retrieval.hybrid(graph.entities, graph.relations, task, hits=hits, incoming=graph.incoming)
        return retrieval.ranked(found).join(graph.entities, "id")

    def _indexed(self, task: str) -> tuple[DataFrame, str]:
        """Ranked results of the current graph by its stored index, and the index's status."""
        if not task.strip():
            raise ValueError("a task is required")
        graph, version = self.store.current()
        meta, status = self.index.ensure(graph.entities, version, self.store.changed_since)
        return self._ranked(graph, task, self.index.search(meta, task)), status

    def _scored(self, results: DataFrame, task: str, now: str) -> DataFrame:
        return evaluation.evaluate(results, task, now, self.config)

    @command("query")
    def query(self, task: str, after: int = 0, most: int = MOST_RESULTS) -> dict:
        """A page of ranked results: at most ``most`` of those after rank ``after``, and the number of all."""
        results, status = self._indexed(task)
        page = results.where(F.col("rank").between(after + 1, after + most))
        return {"query": task, "index": {"status": status}, "total": results.count(), "results": _plain(page.orderBy("rank"))}

    @command("explain")
    def explain(self, task: str, after: int = 0, most: int = MOST_RESULTS) -> dict:
        """The ranking reasons of the same page."""
        results, status = self._indexed(task)
        page = results.where(F.col("rank").between(after + 1, after + most))
        reasons = retrieval.explanation(page).join(page.select("id", "rank"), "id")
        return {"query": task, "index": {"status": status}, "total": results.count(), "reasons": _plain(reasons.orderBy("rank", "position", "role"))}

    @command("context")
    def context(self, task: str, now: str, max_tokens: int = 1200) -> dict:
        if max_tokens <= 0:
            raise ValueError("max_tokens must be positive")
        results, _ = self._indexed(task)
        scored = self._scored(results, task, now)
        confidence = scored.agg(evaluation.aggregate_confidence().alias("c")).head()["c"]
        decided = self.spark.range(1).select(evaluation.outcome(F.lit(confidence), F.lit(None).cast("double"), self.thresholds).alias("o")).head()["o"]
        delivered = results.join(evaluation.bundle(scored, decided).select("id"), "id", "left_semi")
        head = delivered.orderBy("rank").limit(max_tokens)
        record = attribution.recorded(scored, task, decided, confidence, now)
        kept = attribution.written(task, decided, float(confidence), now, None, None, [(r["id"], r["fate"]) for r in scored.orderBy(F.desc("composite"), "id").select("id", "fate").limit(MOST_FATES).collect()], scored.count())
        attribution.store(self.spark, f"{self.base}/attribution", kept)
        return {"decision": decided, "confidence": confidence, "attribution_id": kept["id"], "context": context.pack(_plain(head), max_tokens, delivered.count()), "attribution": _plain(record)[0]}

    # ---------------------------------------------------------------- versions and health

    @command("diff")
    def diff(self, before: str, after: str) -> dict:
        """What differs between two revisions: entities with the tags that they gained and lost, relations, and counts by change."""
        nodes, links = self.store.diff(before, after)
        told = nodes.join(self.store.diff_tags(before, after).drop("change"), "id", "left")
        summary: dict = {}
        for r in _plain(diff.diff_summary(nodes, links).orderBy("record", "change")):
            summary.setdefault(r["record"], {})[r["change"]] = r["n"]
        listed = _plain(told.orderBy("change", "id"))
        return {"summary": summary, "entities": listed, "relationships": _plain(links.orderBy("change", "from_id", "to_id"))}

    @command("stats")
    def stats(self) -> dict:
        graph = self.store.graph()
        return _plain(health.indicators(graph.entities, graph.relations))[0]

    @command("hygiene")
    def hygiene(self) -> dict:
        graph = self.store.graph()
        return {"snapshot_anchor": self.store.anchor(graph), "actions": _plain(health.plan_actions(graph.entities, graph.relations).orderBy("id"))}

    @command("hygiene.apply")
    def apply(self, plan: dict, metadata: dict, selected: list[str] | None = None) -> dict:
        """Apply plan actions in the order of selection. Each is validated on what the one before it left."""
        plan = plan.get("result", plan)
        graph = self.store.graph()
        if plan.get("snapshot_anchor") != self.store.anchor(graph):
            raise StoreError("stale_plan", "the graph has changed since the plan was made")
        known = {a.get("action_id") or a.get("id"): a for a in plan["actions"]}
        nodes, edges = graph.entities, graph.relations
        wanted = list(dict.fromkeys(selected or known))
        if lost := [i for i in wanted if i not in known]:
            raise StoreError("unknown_action", ", ".join(lost))
        batches = self._levels([known[name] for name in wanted])
        for k, batch in enumerate(batches):
            nodes, edges = self._apply_batch(nodes, edges, batch)
            if k + 1 < len(batches):
                nodes, edges = staged(nodes, "nodes"), staged(edges, "edges")
        return self.store.replace(Graph(nodes.select(*graph.entities.columns), edges.select(*graph.relations.columns)), metadata)

    @staticmethod
    def _levels(actions: list[dict]) -> list[list[dict]]:
        """The actions by level: one above the highest earlier action that shares a node. A level is one merge of all its groups.

        Actions that share no node do not depend on each other, so any number of them in
        chains of length c takes c levels.
        """
        out: list[list[dict]] = []
        level: dict[str, int] = {}
        for action in actions:
            touched = {*action["target_ids"], *filter(None, [action.get("canonical_id")])}
            k = max((level.get(n, 0) for n in touched), default=0)
            if k == len(out):
                out.append([])
            out[k].append(action)
            level.update(dict.fromkeys(touched, k + 1))
        return out

    def _apply_batch(self, nodes: DataFrame, edges: DataFrame, actions: list[dict]) -> tuple[DataFrame, DataFrame]:
        """Actions that share no node, checked in two jobs and applied in one plan, however many there are."""
        rows = [(a.get("id") or a.get("action_id"), a["type"], t, a.get("canonical_id"), a.get("resolved")) for a in actions for t in a["target_ids"]]
        asked = self.spark.createDataFrame(rows, "action string, type string, id string, into string, resolved string")
        asked = F.broadcast(asked) if len(rows) <= BROADCAST_ROWS else asked
        if (row := asked.join(nodes.select("id"), "id", "left_anti").orderBy("action").head()) is not None:
            raise StoreError("invalid_action", f"{row['action']}: a target is no longer there")
        pruned = asked.where("type = 'prune_orphan'")
        ends = edges.select(F.explode(F.array("from_id", "to_id")).alias("id"))
        if (row := pruned.join(ends, "id", "left_semi").orderBy("action").head()) is not None:
            raise StoreError("invalid_action", f"{row['action']}: the node has relations")
        nodes, edges = health.remove_nodes(nodes, edges, pruned)
        merged = asked.where("type <> 'prune_orphan'")
        moved = merged.where("id <> into").select("id", F.col("into").alias("canonical_id"))
        settled = merged.where("type = 'resolve_contradiction'").groupBy(F.col("into").alias("id")).agg(F.first("resolved").alias("settled"))
        out = health.merge_entities(nodes, moved).join(settled, "id", "left")
        out = out.withColumn("summary", F.coalesce("settled", "summary")).drop("settled")
        return out, health.remap(edges, moved)

    # ---------------------------------------------------------------- workflow

    @command("workflow.start")
    def start(self, task: str, now: str, max_tokens: int = 1200, kickoff_mode: str = "") -> dict:
        """Readiness, advice, packed context and brief for a task. Where neither workspace nor graph is there yet, only that is said."""
        if self.store.is_new() and self.files.read_json("workspace.json") is None:
            state = {"workspace_initialized": False, "graph_available": False, "current_revision": None}
            ready = {"recommendation": "bootstrap", "status": "action_required", "reasons": ["workspace_not_initialized"], **state}
            return {"readiness": ready, "recommendation": {"what": "bootstrap", "reasons": ready["reasons"]}}
        graph = self.store.graph()
        stats = health.indicators(graph.entities, graph.relations)
        ready = _plain(workflow.readiness(stats))[0]
        kind = _plain(workflow.with_policy(workflow.classify(self.spark.createDataFrame([(task,)], "task string"))))[0]
        results, _ = self._indexed(task)
        scored = self._scored(results, task, now)
        weighed = retrieval.down_ranked(results, scored.select("id", "composite", "fate", "stale"))
        kept = retrieval.ranked(weighed.drop("rank").where(~workflow.suppressed(kind["family"], kind["subprofile"] or "")))
        kept = kept.withColumn("inclusion_reason", workflow.inclusion_reason(F.lit(kind["family"]), F.lit(kind["subprofile"] or "")))
        n_all, rows = results.count(), _plain(kept.orderBy("rank").limit(max_tokens))
        n_kept, n_high = kept.count(), kept.where(workflow.high_signal()).count()
        packed = context.pack(rows, max_tokens, n_kept)
        counted = [(n_kept, len(packed["results"]), n_high, n_all - n_kept, ready["nodes"], ready["edges"], kickoff_mode)]
        counts = self.spark.createDataFrame(counted, "n_results long, n_projected long, n_high_signal long, n_suppressed long, nodes long, edges long, requested_mode string")
        for name in ("family", "subprofile", "default_mode", "inject_at", "minimal_at", "inject_budget", "minimal_budget", "low_mode"):
            counts = counts.withColumn(name, F.lit(kind[name]))
        advice = _plain(workflow.advisory(workflow.kickoff_confidence(counts), max_tokens))[0]
        mode = advice["effective_mode"]
        shown = {"max_tokens": 0, "truncated": False, "omitted_results": 0, "results": []} if mode == "abstain" else context.pack(rows, advice["budget"], n_kept)
        reasons = {r["id"]: r["inclusion_reason"] for r in rows}
        for r in shown["results"]:
            r["inclusion_reason"] = reasons[r["entity"]["id"]]
        state = briefs.coverage(mode, n_high, shown)
        codes = briefs.reason_codes(kind, advice, kickoff_mode)
        what, why = briefs.recommended(kind, ready, bool(n_high and shown["results"]))
        told = briefs.kickoff_context(task, kind, ready, what, codes, state, n_kept, shown)
        revision = (self.store.current_revision() or {}).get("id")
        prompt = briefs.delegation_brief(task, kind, kickoff_mode or "auto", advice, ready, (ready["status"], what), revision, told, shown)
        return {
            "readiness": ready,
            "recommendation": {"what": what, "reasons": why},
            "task": {k: kind[k] for k in ("family", "subprofile", "basis")},
            "advisory": {k: advice[k] for k in ("confidence", "level", "effective_mode", "threshold", "budget", "next_step", "confidence_reasons")} | {"reason_codes": codes},
            "context": shown | told,
            "brief": {"status": state, "prompt": prompt, "guidance": told["guidance"]},
        }

    def _output_score(self, outcome: dict) -> dict | None:
        """The scores of an outcome as a task output against the stored texts; None if they cannot be had."""
        row = (finish.root_id(outcome, self.repository), outcome["summary"], finish.content(outcome))
        output = self.spark.createDataFrame([row], "id string, summary string, content string")
        try:
            stored = self.store.graph().entities
        except StoreError:  # scored without the graph, as an unreadable one is
            stored = None
        try:
            scored = evaluation.evaluate_output(output, outcome["task"] or outcome["summary"], outcome["metadata"]["timestamp"], stored, self.config)
            return _plain(scored)[0]
        except Exception:  # a failure of the scoring never holds a write back
            return None

    @command("workflow.finish")
    def finish(self, payload: str, confidence: float | None = None) -> dict:
        """Write an outcome's objects if it has any and the write gate lets them pass.

        The gate's confidence is the composite of the outcome's own text, scored against the
        stored graph, unless one is given. Without ``gate_writes``, or if scoring fails, the
        gate is open.
        """
        outcome = finish.parse(payload)
        usage = finish.telemetry(outcome)
        if finish.is_noop(outcome):
            return {"written": False, "reason": "no_items", "telemetry": usage}
        scores = self._output_score(outcome) if confidence is None and self.gate_writes else None
        confidence = scores["composite"] if scores else confidence
        gated: dict = {}
        if confidence is not None:
            gate = _plain(self.spark.range(1).select(*evaluation.write_gate(F.lit(float(confidence)), self.thresholds)))[0]
            kept = attribution.written(outcome["task"], gate["outcome"], float(confidence), outcome["metadata"]["timestamp"], gate["write_status"], gate["reason"])
            attribution.store(self.spark, f"{self.base}/attribution", kept)
            told = {"confidence": float(confidence), "write_threshold": self.thresholds.write, "defer_threshold": self.thresholds.defer}
            gated = {"gate": gate | told | ({"scores": scores} if scores else {}), "attribution": kept["id"]}
            if gate["outcome"] != "write":
                return {"written": False, **gated, "telemetry": usage}
        before = self.store.current_revision()
        nodes, edges = finish.objects(outcome, self.repository)
        rows = self.spark.createDataFrame([parse_node(n) for n in nodes], NODE), self.spark.createDataFrame([parse_edge(e) for e in edges], EDGE)
        summary = self.store.write(*rows, outcome["metadata"])
        brief = briefs.handoff_brief(outcome, before, summary["revision"], summary)
        return {"written": True, "root": finish.root_id(outcome, self.repository), "summary": summary, "brief": brief, "telemetry": usage, **gated}

    @command("workflow.seed")
    def seed(self, documents: DataFrame, metadata: dict) -> dict:
        """Write the repository's documents (path, text) as baseline knowledge, if the graph lacks any of it."""
        return self._seeded(*seed.seed_rows(self.spark, self.repository, documents), metadata)

    @command("workflow.seed.repository")
    def seed_repository(self, root: str, metadata: dict) -> dict:
        """Find README, architecture folder and backlog below a root and write them as the baseline, if the graph lacks any of it."""
        nodes, edges = seed.baseline(self.spark, root, self.repository)
        node = "id string, kind string, title string, summary string, content string, repo_path string, tags array<string>, props_json string"
        rows = self.spark.createDataFrame(nodes, node), self.spark.createDataFrame(edges, "from_id string, kind string, to_id string, props_json string")
        return {"found": [n["repo_path"] for n in nodes[1:]]} | self._seeded(*rows, metadata | {"reason": "Seed baseline repository knowledge"})

    def _seeded(self, nodes: DataFrame, edges: DataFrame, metadata: dict) -> dict:
        graph = self.store.graph()
        new, linked = diff.contains_all(nodes, graph.entities), diff.contains_all(edges, graph.relations)
        if new.isEmpty() and linked.isEmpty():
            return {"written": False, "nodes": 0, "relationships": 0}
        whole = lambda df, like: df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(like.schema[c].dataType).alias(c) for c in like.columns])
        return {"written": True} | self.store.write(whole(nodes, graph.entities), whole(edges, graph.relations), metadata)

    @command("attribution.list")
    def attributions(self, outcome: str | None = None, after: str | None = None, before: str | None = None) -> dict:
        """Stored decisions strictly between two times, oldest first."""
        found = attribution.filter_written(attribution.stored(self.spark, f"{self.base}/attribution"), outcome, after, before)
        return {"records": _plain(found.orderBy("timestamp", "id"))}

    @command("attribution.show")
    def attribution(self, record_id: str) -> dict:
        row = attribution.stored(self.spark, f"{self.base}/attribution").where(F.col("id") == record_id).head()
        if row is None:
            raise StoreError("attribution_not_found", f"there is no record {record_id!r}")
        return row.asDict(recursive=True)

    @command("workflow.benchmark.scenario")
    def write_scenario(self, document: dict, now: str) -> dict:
        """Check and keep a benchmark scenario; one with the same id gives way."""
        kept = bench_files.scenario(document, now)
        self.files.write_json(f"benchmarks/scenarios/{kept['scenario_id']}.json", kept)
        return kept

    @command("workflow.benchmark.run")
    def write_benchmark_run(self, scenario: str, document: dict, now: str) -> dict:
        """Check and keep a run of a stored scenario."""
        of = self.files.read_json(f"benchmarks/scenarios/{scenario}.json")
        if of is None:
            raise StoreError("benchmark_scenario_not_found", f"there is no scenario {scenario!r}")
        kept = bench_files.run(document, of, now)
        self.files.write_json(f"benchmarks/runs/{scenario}/{kept['mode']}-{kept['run_id']}.json", kept)
        return kept

    @command("workflow.benchmark.list")
    def scenarios(self) -> dict:
        return {"scenarios": _plain(ledger.scenarios(self.spark, f"{self.base}/benchmarks"))}

    @command("workflow.benchmark")
    def benchmark(self, scenario: str) -> dict:
        found = ledger.benchmark_runs(self.spark, f"{self.base}/benchmarks", scenario)
        flat = found.select("scenario_id", "mode", "metrics.volume.*", "metrics.orientation.*")
        values = ["input_tokens", "output_tokens", "prompt_count", "prompt_characters", "step_count", "repo_scans", "follow_up_prompts", "context_reloads"]
        rows = _plain(lab.benchmark(flat, values))
        return rows[0] if rows else {"scenario_id": scenario, "status": "incomplete", "issues": ["no runs"]}

    @command("workflow.benchmark.summary")
    def benchmark_summary(self, scenario: str) -> dict:
        """A scenario's issues with the worst status, the runs of either mode, and the comparison of every metric where it is comparable."""
        found, made = ledger.benchmark_tables(self.spark, f"{self.base}/benchmarks", scenario)
        if found.isEmpty():
            raise StoreError("benchmark_scenario_not_found", f"there is no scenario {scenario!r}")
        issues = bench_summary.benchmark_issues(found, made)
        status = bench_summary.benchmark_status(found, issues)
        rows = bench_summary.benchmark_comparison(made, status).orderBy("place").drop("place", "scenario_id")
        modes = bench_summary.mode_runs(found, made).orderBy("mode").drop("of")
        told = _plain(issues.orderBy(F.desc("severity"), "code", "mode", "run_id").drop("scenario_id", "severity"))
        return _plain(status)[0] | {"issues": told, "runs": _plain(modes), "comparison": _plain(rows)}

    # ---------------------------------------------------------------- lab

    @command("workflow.init")
    def init_workflow(self, assets: dict[str, str], overrides: list[str] | None = None) -> dict:
        """Install the managed assets and keep a manifest of them."""
        done = workspace.ensure_assets(self.files, {f"workflow/assets/{p}": t for p, t in assets.items()}, {f"workflow/assets/{p}" for p in overrides or []})
        self.files.write_json("workflow/manifest.json", {"schema_version": VERSION, "assets": done["assets"]})
        return {k: v for k, v in done.items() if k != "assets"}

    @command("lab.init")
    def lab_init(self) -> dict:
        return workspace.init_lab(self.files)

    @command("lab.run")
    def lab_run(self, task_id: str, condition_id: str, model: str, topology: str, seed: int, started: str, finished: str, prompt: str, outcome: str | None = None) -> dict:
        """Record one run: its telemetry from the outcome payload, its artifacts, then its record."""
        condition = next((c for c in (self.files.read_json("lab/conditions.json") or {}).get("conditions", []) if c["condition_id"] == condition_id), None)
        if condition is None:
            raise StoreError("record_validation_failed", "condition_id must reference an existing condition")
        backed = condition["workflow_mode"] not in ("baseline", "without_harness")
        parsed = finish.parse(outcome) if outcome else None
        usage = workspace.run_telemetry(finish.telemetry(parsed) if parsed else None, started, finished, backed, outcome is not None)
        run_id = workspace.free_id(self.files, "run", started, "lab/runs")
        record = {"schema_version": VERSION, "run_id": run_id, "task_id": task_id, "condition_id": condition_id, "model": model, "session_topology": topology, "seed": seed, "prompt_variant": "default", "started_at": started, "finished_at": finished, "telemetry": usage}
        record |= {"kickoff_inputs_ref": "kickoff-inputs.json", "session_structure_ref": "session-structure.json", "writeback_outputs_ref": "writeback-outputs.json", "outcome_artifacts_ref": "outcome"}
        parts: dict = {"kickoff-inputs.json": {"task_id": task_id, "prompt": prompt}, "session-structure.json": {"delegated_sessions": usage["delegated_sessions"]}, "writeback-outputs.json": {"graph_backed": backed, "outcome": parsed or {}}, "outcome/summary.json": {"summary": (parsed or {}).get("summary", "")}}
        if not backed:
            record["baseline_prompt_metadata_ref"] = "baseline-prompt.json"
            parts["baseline-prompt.json"] = workspace.prompt_metadata(prompt)
        return {"run_id": run_id, "path": workspace.record_run(self.files, record, parts), "telemetry": usage}

    @command("lab.plan")
    def lab_plan(self, seed: int, at: str) -> dict:
        """A batch plan over every task and condition, in the order that the seed fixes."""
        base = f"{self.base}/lab"
        entries = _plain(lab.batch_plan(ledger.tasks(self.spark, base), ledger.conditions(self.spark, base), seed).orderBy("entry"))
        batch = workspace.free_id(self.files, "batch", at, "lab/runs/batches")
        self.files.write_json(f"lab/runs/batches/{batch}/plan.json", {"schema_version": VERSION, "batch_id": batch, "seed": seed, "created_at": at, "entries": entries})
        return {"batch_id": batch, "entries": entries}

    @command("lab.batch")
    def lab_batch(self, batch_id: str, model: str, topology: str, started: str, finished: str, outcomes: dict[int, str] | None = None, sessions: dict[int, str] | None = None, logs: str | None = None) -> dict:
        """Record a run for every entry of a stored plan.

        outcomes: payload by entry; an entry without one gets a synthetic payload. sessions and
        logs: the session of an entry and where session logs are: the usage of all sessions
        is read by one job and brought into the payloads. An entry that cannot be recorded is
        told with its error; the others are not held up.
        """
        plan = self.files.read_json(f"lab/runs/batches/{batch_id}/plan.json")
        if plan is None:
            raise StoreError("batch_plan_not_found", f"there is no batch {batch_id!r}")
        tasks = {t["task_id"]: t for t in (self.files.read_json("lab/suite.json") or {}).get("tasks", [])}
        usage: dict = {}
        if sessions and logs:
            asked = self.spark.createDataFrame([(s, model) for s in dict.fromkeys(sessions.values())], "session_id string, model string")
            found = ledger.session_usages(self.spark, logs, asked).join(asked.select("session_id"), "session_id", "left_semi")
            usage = {r["session_id"]: r for r in _plain(found)}
        done = []
        for entry in plan["entries"]:
            k, task = entry["entry"], tasks.get(entry["task_id"])
            told = {"entry": k, "task_id": entry["task_id"], "condition_id": entry["condition_id"]}
            if task is None:
                done.append(told | {"error": "record_validation_failed"})
                continue
            given = (outcomes or {}).get(k)
            payload = json.loads(given) if given else finish.synthetic(f"{batch_id}-{k}", finished, task)
            measured = usage.get((sessions or {}).get(k, ""))
            if measured is not None:
                counts = {c: measured[c] for c in ("input_tokens", "output_tokens", "total_tokens")}
                lost = {"measurement_status": "unavailable", "incomplete_reasons": [measured["problem"]]}
                state = lost if measured["problem"] else counts | {"measurement_status": "complete"}
                payload = finish.inject(payload, state | {"source": "session_log", "provider": "session"})
            made = self.lab_run(entry["task_id"], entry["condition_id"], model, topology, plan["seed"], started, finished, task["description"], json.dumps(payload))
            if made["status"] == "ok":
                done.append(told | {"run_id": made["result"]["run_id"], "measurement_status": made["result"]["telemetry"]["measurement_status"]})
            else:
                done.append(told | {"error": made["error"]["code"]})
        return {"batch_id": batch_id, "runs": done, "failed": sum("error" in d for d in done)}

    @command("lab.evaluate")
    def lab_evaluate(self, record: dict) -> dict:
        checked = ledger.evaluation_violations(self.spark.createDataFrame([record], ledger.EVALUATION), ledger.runs(self.spark, f"{self.base}/lab")).head()["violations"]
        if checked:
            raise StoreError("record_validation_failed", "; ".join(f"{v['field']}: {v['message']}" for v in checked))
        return {"run_id": record["run_id"], "evaluations": workspace.add_evaluation(self.files, record)}

    @command("lab.evaluate.present")
    def lab_present(self, run_id: str, blind: bool = True) -> dict:
        return workspace.present(self.files, run_id, blind)

    @command("lab.report")
    def report(self, generated_at: str | None = None, run_ids: list[str] | None = None) -> dict:
        """Statistics of all runs or of the named ones; with a time the report is kept under lab/reports."""
        at = f"{self.base}/lab"
        raw = ledger.runs(self.spark, at).select("run_id", "task_id", "condition_id", "model", F.col("session_topology").alias("topology"), "seed", "started_at", "telemetry.measurement_status", "telemetry.total_tokens", "telemetry.wall_clock_seconds")
        everything = lab.join_ledger(raw, ledger.tasks(self.spark, at), ledger.conditions(self.spark, at), ledger.evaluations(self.spark, at))
        runs = (everything if run_ids is None else lab.selected(everything, run_ids)).cache()
        try:
            found = lab.report(runs, attribution.by_run(self.spark, at), ledger.tasks(self.spark, at))
            out = {name: _plain(df) for name, df in found.items()}
            for one in ("counters", "gate", "over_abstention"):
                out[one] = out[one][0]
            without_tokens = out.pop("token_sparse")[0]["n"]
            sparse = sum(c["scored_pair_count"] < 2 for c in out["comparisons"])
            out["token_decline"] = out.pop("primary")[0] | {"graph_only": out.pop("secondary")[0]}
            out["notes"] = [r["note"] for r in out["notes"]]
            out["unscored_run_ids"] = [r["run_id"] for r in runs.where("not scored").select("run_id").orderBy("run_id").collect()]
            warned = [("missing_evaluations", out["unscored_run_ids"]), ("no_runs_selected", not out["counters"]["runs"]), ("incomplete_token_telemetry", without_tokens)]
            out["warnings"] = [w for w, holds in warned if holds]
            out["limitations"] = lab.limitations(out["counters"], sparse, without_tokens)
            out |= {"selection": {"mode": "all_runs" if run_ids is None else "run_ids", "run_ids": run_ids or []}, "batch_plans": _plain(ledger.plans(self.spark, at))}
            if generated_at:
                name = workspace.free_id(self.files, "report", generated_at, "lab/reports")
                out |= {"generated_at": generated_at, "report_id": name}
                self.files.write(f"lab/reports/{name}/report.json", json.dumps(out, default=str, ensure_ascii=False, sort_keys=True))
            return out
        finally:
            runs.unpersist()

    def respond(self, envelope: dict, path: str | None = None) -> str:
        """An envelope as JSON, also written to a path if one is given."""
        if path:
            ledger.write_json(self.spark, path, envelope)
        return json.dumps(envelope, default=str, ensure_ascii=False)
