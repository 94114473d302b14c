"""Rule-based confidence: candidate scores, conflicts, fates, and the decisions made from them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clamp, ratio, rounded
from ..functions.text import FIELD_WEIGHTS, NEGATIVE, POSITIVE, polar, polarity, strings, tags_normal, terms, terms_of, trimmed
from ..sources.files import staged
from .retrieval import DIRECTIONS, few
from .search import holds

#: Contested terms up to which their counts are broadcast.
MOST_TERMS = 100_000
#: Support that a relation's direction lends to a candidate.
SUPPORT = {"supports_task": 1.0, "matched_seed": 0.6, "outgoing_neighbor": 0.35, "incoming_neighbor": 0.35}
OTHER_SUPPORT = 0.15
DAY = 86_400.0


@dataclass(frozen=True)
class Config:
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0)
    survive: float = 0.65
    trim: float = 0.40
    least_relevance: float = 0.25
    least_consistency: float = 0.35
    least_usefulness: float = 0.20
    stale_days: float = 30.0
    tolerance: float = 0.05

    def shares(self) -> tuple[float, float, float]:
        """Weights that add up to one; thirds if none is positive."""
        w = [max(0.0, x) for x in self.weights]
        total = sum(w)
        return tuple(x / total for x in w) if total else (1 / 3, 1 / 3, 1 / 3)


@dataclass(frozen=True)
class Thresholds:
    injection: float = 0.70
    minimal: float = 0.40
    regression: float = 0.10
    write: float = 0.80
    defer: float = 0.55

    def __post_init__(self) -> None:
        if not all(0 <= x <= 1 for x in (self.injection, self.minimal, self.regression, self.write, self.defer)):
            raise ValueError("thresholds must lie between 0 and 1")
        if self.minimal > self.injection or self.defer > self.write:
            raise ValueError("a lower threshold must not exceed the higher one")


_TEXTS = ["id", "kind", "title", "summary", "content", "repo_path"]


def candidate_terms(matched: bool = True) -> Column:
    """Terms of all texts of a candidate and of the task terms that it matched."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in _TEXTS] + [F.array_join(F.coalesce("tags", strings([])), " ")]
    if matched:
        parts.append(F.array_join("matched_terms", " "))
    return terms(F.concat_ws(" ", *parts))


def weighted_coverage(task: list[str]) -> Column:
    """Field weights of the task terms that a candidate holds, over three a term."""
    hit = lambda text, w: sum((F.when(holds(text, [t]), w).otherwise(0.0) for t in task), F.lit(0.0))
    own = sum((hit(F.col(c), FIELD_WEIGHTS[c]) for c in _TEXTS), F.lit(0.0))
    tags = F.aggregate(F.coalesce("tags", strings([])), F.lit(0.0), lambda a, t: a + hit(t, FIELD_WEIGHTS["tag"]))
    everything = F.concat_ws(" ", *_TEXTS, F.array_join(F.coalesce("tags", strings([])), " "))
    return clamp(F.when(holds(everything, task), own + tags).otherwise(0.0) / F.lit(3.0 * len(task))) if task else F.lit(0.0)


def support(refs: Column) -> Column:
    """1 - exp(-raw), where each relation adds its direction's support."""

    def one(r: Column) -> Column:
        value = F.lit(OTHER_SUPPORT)
        for name, x in SUPPORT.items():
            value = F.when(r["direction"] == name, x).otherwise(value)
        return value

    return clamp(1 - F.exp(-F.aggregate(refs, F.lit(0.0), lambda a, r: a + one(r))))


def support_of(counts: Column) -> Column:
    """support() of relations that are counted by direction."""
    return clamp(1 - F.exp(-sum((counts[d] * SUPPORT[d] for d in DIRECTIONS), F.lit(0.0))))


def seen_at() -> Column:
    """updated_at, else created_at; null where that is no time stamp."""
    return F.try_to_timestamp(F.coalesce(F.nullif(trimmed(F.col("updated_at")), F.lit("")), F.nullif(trimmed(F.col("created_at")), F.lit(""))))


def recency(at: Column, now: str, stale_days: float) -> tuple[Column, Column, Column]:
    """Score, staleness and age in days of a seen_at(), which is a column of its own so that it is parsed once; .65 where it is null."""
    seconds = F.unix_micros(F.to_timestamp(F.lit(now))) - F.unix_micros(at)
    age = F.greatest(seconds / 1e6 / DAY, F.lit(0.0))
    fresh = clamp(1 - 0.15 * age / stale_days)
    old = clamp(0.85 - 0.45 * (age - stale_days) / stale_days)
    score = F.when(at.isNull(), 0.65).when(age <= stale_days, fresh).otherwise(old)
    return score, F.coalesce(age > stale_days, F.lit(False)), F.coalesce(age, F.lit(0.0))


def conflicts(left: DataFrame, right: DataFrame, but_itself: bool = True) -> DataFrame:
    """(id, other) of all pairs that share a term beside the polarity words and take opposite sides in a word group.

    left, right: id, terms. Only texts that hold a polarity word can conflict; they alone are
    exploded and met on shared terms, so no cross product is formed. The result has every
    pair, so it grows with the square of a term's texts: scores use stances() and opposed_by().
    """

    def sides(df: DataFrame, p: str) -> DataFrame:
        return _sides(df).select("term", *[F.col(c).alias(f"{p}{c}") for c in ("id", "pos", "neg")])

    met = sides(left, "l").join(sides(right, "r"), "term")
    met = met.where("lid <> rid") if but_itself else met
    opposed = F.exists(F.arrays_zip("lpos", "lneg", "rpos", "rneg"), lambda g: (g["lpos"] & g["rneg"]) | (g["lneg"] & g["rpos"]))
    return met.where(opposed).select(F.col("lid").alias("id"), F.col("rid").alias("other")).distinct()


def _held(df: DataFrame) -> DataFrame:
    """(id, pos, neg, terms) of texts that hold a polarity word: the word groups that they hold on either side, and their other terms."""
    held = df.where(F.size(polar(F.col("terms"), True)) > 0)
    pos, neg = polarity(F.col("terms"), POSITIVE), polarity(F.col("terms"), NEGATIVE)
    return held.select("id", pos.alias("pos"), neg.alias("neg"), polar(F.col("terms"), False).alias("terms"))


def _sides(df: DataFrame) -> DataFrame:
    """_held() with one row a term."""
    return _told(_held(df))


def _told(held: DataFrame) -> DataFrame:
    return held.select("id", "pos", "neg", F.explode("terms").alias("term"))


def stances(rows: DataFrame) -> DataFrame:
    """For each term, who takes which side of each word group: one row a term, however many texts hold it.

    rows: id (unique) and terms. Columns ``<side><group>_n`` count the texts, ``_low`` and
    ``_high`` are the smallest and largest id: enough to tell none, one and several others.
    All are partial aggregates, so a term that most texts hold is never gathered.
    """
    sums = []
    for side, groups in (("pos", POSITIVE), ("neg", NEGATIVE)):
        for g in range(len(groups)):
            there = F.when(F.col(side)[g], F.col("id"))
            sums += [F.count(there).alias(f"{side}{g}_n"), F.min(there).alias(f"{side}{g}_low"), F.max(there).alias(f"{side}{g}_high")]
    return _sides(rows).groupBy("term").agg(*sums)


def opposed_by(rows: DataFrame, summary: DataFrame, but_itself: bool = True) -> DataFrame:
    """(id, n_opposed): 1 or 2 (two and more) texts of a stances() summary that conflict with each row; rows without conflict are left out.

    The score's penalty is full at the second conflict, so no more needs to be known. A
    row meets one summary row for each of its terms: work grows with the terms and not with
    the pairs of texts. ``but_itself``: the summary holds the rows themselves, and no text
    conflicts with itself; else a text of the same id counts.
    """
    return _opposed(_sides(rows).join(summary, "term"), but_itself)


def opposed_among(rows: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """opposed_by(rows, stances(rows)), for many rows; with ``stored``, opposed_by(rows, stances(stored), but_itself=False).

    Only terms that rows on one side of a word group and others on its other side hold are
    looked at: sides are counted first, in buffers of a fixed width, and ids are gathered only
    for the terms where a side has one or two texts. Few such terms are broadcast, so texts
    are not shuffled by term.
    """
    told = _told(staged(_held(rows), "sides"))
    others = told if stored is None else _told(staged(_held(stored), "stored-sides"))
    names = [(side, g) for side, groups in (("pos", POSITIVE), ("neg", NEGATIVE)) for g in range(len(groups))]
    marked = told.withColumns({"mine": F.lit(True), "theirs": F.lit(stored is None)})
    if stored is not None:
        marked = marked.unionByName(others.withColumns({"mine": F.lit(False), "theirs": F.lit(True)}))
    count = lambda side, g, whose: F.count_if(F.col(side)[g] & F.col(whose))
    counts = marked.groupBy("term").agg(*[count(side, g, whose).alias(f"{side}{g}_{x}") for side, g in names for whose, x in (("theirs", "n"), ("mine", "own"))])
    opposite = [(F.col(f"{a}{g}_own") > 0) & (F.col(f"{b}{g}_n") > 0) for g in range(len(POSITIVE)) for a, b in (("pos", "neg"), ("neg", "pos"))]
    contested = staged(counts.where(reduce(Column.__or__, opposite)).select("term", *[f"{side}{g}_n" for side, g in names]), "contested")
    hint = F.broadcast if few(contested, MOST_TERMS) else lambda df: df
    rare = contested.where(reduce(Column.__or__, [F.col(f"{side}{g}_n").between(1, 2) for side, g in names])).select("term")
    there = lambda side, g: F.when(F.col(side)[g], F.col("id"))
    ends = [f(there(side, g)).alias(f"{side}{g}_{x}") for side, g in names for f, x in ((F.min, "low"), (F.max, "high"))]
    known = others.join(hint(rare), "term", "left_semi").groupBy("term").agg(*ends)
    return _opposed(told.join(hint(contested.join(known, "term", "left")), "term"), stored is None)


def _opposed(met: DataFrame, but_itself: bool) -> DataFrame:
    """opposed_by() of sides that have met the summary. Ids are compared only where no term has two others."""
    several, others = F.lit(False), []
    for g in range(len(POSITIVE)):
        for mine, theirs in (("pos", "neg"), ("neg", "pos")):
            n, low, high = (F.col(f"{theirs}{g}_{x}") for x in ("n", "low", "high"))
            itself = F.col(theirs)[g].cast("int") if but_itself else F.lit(0)
            left = F.when(F.col(mine)[g], n - itself).otherwise(0)
            several = several | (left >= 2)
            other = F.when((itself == 1) & (low == F.col("id")), high).otherwise(low)
            others.append(F.when(left == 1, other))
    known = F.array_compact(F.array(*others))
    found = met.select("id", several.alias("several"), F.array_min(known).alias("low"), F.array_max(known).alias("high"))
    sure = found.where("several").select("id", F.lit(2).cast("long").alias("n"))
    rest = found.where("NOT several AND low IS NOT NULL").groupBy("id").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    rest = rest.select("id", F.when(F.col("low") != F.col("high"), 2).otherwise(1).cast("long").alias("n"))
    return sure.unionByName(rest).groupBy("id").agg(F.max("n").alias("n_opposed"))


def fate(relevance: Column, consistency: Column, usefulness: Column, composite: Column, config: Config) -> tuple[Column, Column]:
    """Fate of a candidate and, if it is rejected, why (fixed texts)."""
    why = (
        F.when(relevance < config.least_relevance, "below relevance threshold")
        .when(consistency < config.least_consistency, "below consistency threshold")
        .when(usefulness < config.least_usefulness, "below usefulness threshold")
        .when(composite < min(config.trim, config.survive), "below composite threshold")
    )
    return F.when(why.isNotNull(), "rejected").when(composite >= config.survive, "survived").otherwise("trimmed"), why


def composite(relevance: Column, consistency: Column, usefulness: Column, config: Config) -> Column:
    a, b, c = config.shares()
    return rounded(clamp(relevance * a + consistency * b + usefulness * c), 3)


def evaluate(
    candidates: DataFrame,
    task: str,
    now: str,
    config: Config = Config(),
    graph_state: DataFrame | None = None,
    among: bool = True,
    exact: bool = False,
) -> DataFrame:
    """Scores of candidates (id, texts, tags, matched_terms, graph_refs or graph_counts, time stamps) for a task.

    One row each: relevance, consistency, usefulness, composite, fate, reason, matched, signals
    (distinct directions of its relations), stale, age_days, n_conflicts. ``now`` is an argument, so results can be repeated. ids are unique.
    graph_state: stored texts (id, texts, tags) that candidates may also conflict with, one of
    the same id included. n_conflicts counts conflicts with candidates and with stored texts,
    each up to two, which is all that scores depend on; ``exact`` counts every one, at the
    price of all pairs that conflict.
    """
    asked = terms_of(task)
    rows = candidates.withColumns({"terms": candidate_terms(), "seen_at": seen_at()})
    found = F.array_intersect(strings(asked), F.array_union("terms", "matched_terms"))
    score, stale, age = recency(F.col("seen_at"), now, config.stale_days)
    if "graph_counts" in candidates.columns:
        here = [F.col("graph_counts")[d] for d in DIRECTIONS]
        backed, n_refs = support_of(F.col("graph_counts")), sum(here, F.lit(0))
        signals = F.array_compact(F.array(*[F.when(n > 0, d) for n, d in zip(here, DIRECTIONS)]))
    else:
        directions = F.filter(F.transform("graph_refs", lambda x: trimmed(x["direction"])), lambda x: x != "")
        backed, n_refs, signals = support(F.col("graph_refs")), F.size("graph_refs"), F.array_sort(F.array_distinct(directions))
    lost = []
    count = lambda pairs: pairs.groupBy("id").agg(F.count(F.lit(1)).alias("n_opposed"))
    if among:
        rows = rows if exact else staged(rows, "candidates")
        lost.append(count(conflicts(rows, rows)) if exact else opposed_among(rows))
    if graph_state is not None:
        stored = graph_state.withColumn("terms", candidate_terms(False))
        lost.append(count(conflicts(rows, stored, but_itself=False)) if exact else opposed_among(rows, stored))
    if lost:
        every = lost[0] if len(lost) == 1 else lost[0].unionByName(lost[1])
        rows = rows.join(every.groupBy("id").agg(F.sum("n_opposed").alias("n_conflicts")), "id", "left")
    else:
        rows = rows.withColumn("n_conflicts", F.lit(None).cast("long"))
    rows = rows.withColumn("n_conflicts", F.coalesce("n_conflicts", F.lit(0)).cast("long")).select(
        "*", found.alias("matched"), score.alias("recency"), stale.alias("stale"), rounded(age, 3).alias("age_days"), backed.alias("support"), weighted_coverage(asked).alias("weighted")
    )
    n = len(asked)
    cover = ratio(F.size("matched"), F.lit(n))
    penalty = F.least(F.lit(0.75), 0.4 * F.col("n_conflicts"))
    relevance = clamp(0.5 * cover + 0.35 * F.col("weighted") + 0.15 * F.col("support"))
    steady = clamp(0.45 * F.col("recency") + 0.35 * clamp(0.45 + 0.55 * F.col("support")) + 0.20 * cover - penalty)
    steady = F.when((F.col("n_conflicts") == 0) & (cover > 0.6), clamp(steady + 0.1)).otherwise(steady)
    present = sum((F.when(F.col(c).rlike(r"(?U)\S"), 1.0).otherwise(0.0) for c in ("title", "summary", "content", "repo_path")), F.lit(0.0))
    dense = clamp((present + F.least(F.size(tags_normal(F.col("tags"))), F.lit(2)) + F.least(n_refs, F.lit(2))) / 8.0)
    focus = clamp(ratio(F.size("matched"), F.size("terms")))
    use = clamp(0.55 * relevance + 0.25 * focus + 0.20 * dense)
    use = F.when(F.col("stale"), clamp(use - 0.1)).otherwise(use)
    use = F.when(F.col("n_conflicts") > 0, clamp(use - 0.15)).otherwise(use)
    scored = rows.select("id", rounded(relevance, 3).alias("relevance"), rounded(steady, 3).alias("consistency"), rounded(use, 3).alias("usefulness"), "matched", signals.alias("signals"), "stale", "age_days", "n_conflicts")
    r, c, u = F.col("relevance"), F.col("consistency"), F.col("usefulness")
    scored = scored.withColumn("composite", composite(r, c, u, config))
    verdict, why = fate(r, c, u, F.col("composite"), config)
    return scored.select("id", "relevance", "consistency", "usefulness", "composite", verdict.alias("fate"), why.alias("reason"), "matched", "signals", "stale", "age_days", "n_conflicts")


def aggregate_confidence() -> Column:
    """Mean composite of the survivors, else of the trimmed, else of all; 0 of none."""
    of = lambda f: F.avg(F.when(F.col("fate") == f, F.col("composite")))
    return clamp(F.coalesce(of("survived"), of("trimmed"), F.avg("composite"), F.lit(0.0)))


def outcome(confidence: Column, prior: Column, t: Thresholds = Thresholds()) -> Column:
    """backtrack, continue, minimal or abstain. A null prior never backtracks."""
    return (
        F.when(prior - confidence >= t.regression, "backtrack")
        .when(confidence >= t.injection, "continue")
        .when(confidence >= t.minimal, "minimal")
        .otherwise("abstain")
    )


def bundle(scored: DataFrame, decided: Column | str) -> DataFrame:
    """Candidates that a decision delivers: the survivors (all if none) to continue, the best one at minimal.

    Whether any survived and which one is best are aggregated to one row, so candidates
    are neither sorted nor gathered in one task. They are scored once: the best one is taken
    whole by the aggregate, else all are written first.
    """
    lives = F.col("fate") == "survived"
    place = F.struct((~lives).alias("late"), (-F.col("composite")).alias("c"), F.col("id").alias("i"))
    if isinstance(decided, str) and decided == "minimal":
        best = scored.agg(F.min_by(F.struct(*scored.columns), place).alias("best")).where("best IS NOT NULL")
        return best.select("best.*")
    decided = F.lit(decided) if isinstance(decided, str) else decided
    scored = staged(scored, "scored")
    known = scored.agg(F.coalesce(F.max(lives), F.lit(False)).alias("__alive"), F.min_by("id", place).alias("__best"))
    keep = F.when(decided == "continue", ~F.col("__alive") | lives).when(decided == "minimal", F.col("id") == F.col("__best")).otherwise(F.lit(False))
    return scored.crossJoin(F.broadcast(known)).where(keep).drop("__alive", "__best")


def write_gate(value: Column, t: Thresholds = Thresholds()) -> list[Column]:
    """outcome, write_status and reason of a candidate output's composite."""
    decided = F.when(value >= t.write, "write").otherwise("abstain")
    status = F.when(value >= t.write, "approved").when(value >= t.defer, "deferred").otherwise("skipped")
    # The two texts.
    held = F.format_string(f"composite confidence %.4f is below write threshold {t.write:.4f} but above defer threshold {t.defer:.4f}; write held for retry", value)
    lost = F.format_string(f"composite confidence %.4f is below defer threshold {t.defer:.4f}; write suppressed without auto-retry", value)
    return [decided.alias("outcome"), status.alias("write_status"), F.when(status == "deferred", held).when(status == "skipped", lost).alias("reason")]


def regression(now_scores: DataFrame, prior_scores: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """(id, composite_delta, regressed, reasons): outputs against their earlier scores."""
    prior = prior_scores.select("id", *[F.col(c).alias(f"p_{c}") for c in ("relevance", "usefulness", "composite")])
    delta, reasons = _regressed(tolerance)
    met = now_scores.join(prior, "id")
    return met.select("id", delta.alias("composite_delta"), (F.size(reasons) > 0).alias("regressed"), reasons.alias("reasons"))


def evaluate_output(outputs: DataFrame, task: str, now: str, graph_state: DataFrame | None = None, config: Config = Config()) -> DataFrame:
    """Scores of task outputs against the stored graph and, where there is one, an earlier output.

    outputs: id (unique), summary, content and, for a comparison, prior_summary,
    prior_content and perhaps prior_id (unique; else the id). One row each: id, relevance, consistency, usefulness, composite, matched,
    n_conflicts, prior_composite, composite_delta, regressed and reasons (all four null without
    an earlier output). An output without summary and content scores zeros and is not
    compared. Outputs and earlier outputs are scored by one plan; they never conflict with each other.
    """
    has_prior = "prior_summary" in outputs.columns
    blank = lambda a, b: trimmed(F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))) == ""
    text = lambda p, c: trimmed(F.col(p + c)).alias(c) if has_prior or not p else F.lit("").alias(c)
    none = lambda kind: F.lit(None).cast(kind)

    def side(p: str) -> DataFrame:
        named = trimmed(F.coalesce("prior_id", "id") if p and "prior_id" in outputs.columns else F.col("id"))
        rows = outputs.select(trimmed(F.col("id")).alias("of"), named.alias("name"), text(p, "summary"), text(p, "content"), F.lit(bool(p)).alias("prior"))
        return rows.where(~blank(F.col("summary"), F.col("content")))

    both = side("").unionByName(side("prior_")) if has_prior else side("")
    refs = "array<struct<kind:string,from_id:string,to_id:string,direction:string>>"
    empty = {c: F.lit("") for c in ("title", "repo_path")} | {"kind": F.lit("task_output"), "tags": strings([]), "matched_terms": strings([])}
    rows = both.withColumns(empty | {"graph_refs": F.array().cast(refs), "updated_at": none("string"), "created_at": none("string")})
    # A mark that is no term keeps outputs and earlier ones apart where they have one id.
    rows = rows.withColumn("id", F.concat(F.when(F.col("prior"), F.lit("\x02")).otherwise(F.lit("\x01")), "name"))
    scored = evaluate(rows, task, now, config, graph_state, among=False).join(rows.select("id", "of", "prior"), "id").drop("id").withColumnRenamed("of", "id")
    pick = ["relevance", "consistency", "usefulness", "composite", "matched", "n_conflicts"]
    own = scored.where("NOT prior").select("id", *pick)
    out = outputs.select(trimmed(F.col("id")).alias("id")).join(own, "id", "left")
    if has_prior:
        before = scored.where("prior").select("id", *[F.col(c).alias(f"p_{c}") for c in ("relevance", "usefulness", "composite")])
        out = out.join(before, "id", "left")
    else:
        out = out.withColumns({f"p_{c}": none("double") for c in ("relevance", "usefulness", "composite")})
    delta, why = _regressed(config.tolerance)
    compared = F.col("composite").isNotNull() & F.col("p_composite").isNotNull()
    return out.select(
        "id",
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in pick[:4]],
        F.coalesce("matched", strings([])).alias("matched"),
        F.coalesce("n_conflicts", F.lit(0)).alias("n_conflicts"),
        F.when(compared, F.col("p_composite")).alias("prior_composite"),
        F.when(compared, delta).alias("composite_delta"),
        F.when(compared, F.size(why) > 0).alias("regressed"),
        F.when(compared, why).alias("reasons"),
    )


def _regressed(tolerance: float) -> tuple[Column, Column]:
    """The change of the composite, and why an output is worse than its earlier one (fixed texts)."""
    delta = rounded(F.col("composite") - F.col("p_composite"), 3)
    reasons = F.array_compact(
        F.array(
            F.when(delta < -tolerance, "composite confidence regressed"),
            F.when(F.col("relevance") + tolerance < F.col("p_relevance"), "relevance regressed"),
            F.when(F.col("usefulness") + tolerance < F.col("p_usefulness"), "usefulness regressed"),
        )
    )
    return delta, reasons
