"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy (operator 4).

A word's input is the sum of a word vector and of character vectors (its first three to
six and last three and four bytes), all in one hashed table. Windows of WINDOW words
that overlap by half run through a GRU in either direction; attention pools the states
into one logit. A document's score is that of its most toxic window, over all windows
of the whole text.

Only documents are labelled, so training alternates between choosing the windows that
stand for a document (those the model finds most toxic) and fitting them with Adam. The
first choice is by smoothed log-odds of the hashed inputs, which also start one channel
of the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Spans, _LOWER, arrow_bytes, blocks, give_back, mix, table, word_spans, workers_see_us
from .labelled import held_out, training_rows
from .tokens import forget

#: The most labelled rows of each class that are trained on, and the longest text among them.
MOST_ROWS = 2500
LONGEST = 20_000
CUT = 0.5
WINDOW, STRIDE = 24, 12
BUCKETS, WIDTH, STATES = 1 << 15, 8, 8
_PREFIXES, _SUFFIXES = (3, 4, 5, 6), (3, 4)
INPUTS = 1 + len(_PREFIXES) + len(_SUFFIXES)
_CHUNK = 1 << 21
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def word_inputs(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs (distinct words x INPUTS) as buckets, the distinct word at each place, and each text's first place. Case and punctuation around a word do not count."""
    raw = _LOWER[raw]
    starts, ends, first = word_spans(raw, at)
    if not len(starts):
        return np.zeros((0, INPUTS), np.int64), np.zeros(0, np.int64), first
    for _ in range(4):
        ends = ends - (_PUNCTUATION[raw[ends - 1]] & (ends - starts > 1))
        starts = starts + (_PUNCTUATION[raw[starts]] & (ends - starts > 1))
    hashes = Spans(raw)
    _, one, place = np.unique(hashes(starts, ends), return_index=True, return_inverse=True)
    s, e = starts[one], ends[one]
    spans = [(s, e), *((s, np.minimum(s + k, e)) for k in _PREFIXES), *((np.maximum(e - k, s), e) for k in _SUFFIXES)]
    hashed = [mix(hashes(a, b) + np.uint64(k)) % np.uint64(BUCKETS) for k, (a, b) in enumerate(spans)]
    return np.stack(hashed, 1).astype(np.int64), place, first


def many_word_inputs(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """word_inputs of any number of texts, a block at a time."""
    rows, places, firsts, base = [np.zeros((0, INPUTS), np.int64)], [np.zeros(0, np.int64)], [np.zeros(1, np.int64)], 0
    for a, b in blocks(at, _CHUNK):
        buckets, place, first = word_inputs(raw[at[a] : at[b]], at[a : b + 1] - at[a])
        rows.append(buckets)
        places.append(place + base)
        firsts.append(first[1:] + firsts[-1][-1])
        base += len(buckets)
    distinct, back = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
    return distinct, back.ravel().astype(np.int32)[np.concatenate(places)], np.concatenate(firsts)


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and text of every window: they start each STRIDE words until one reaches the text's end."""
    words = np.diff(first)
    count = np.where(words > 0, 1 + np.maximum(0, -(-(words - WINDOW) // STRIDE)), 0)
    owner = np.repeat(np.arange(len(words)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    return first[:-1][owner] + nth * STRIDE, owner


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """Parameters and passes. Places beyond a text's end have a mask of 0: they leave the state as it is and get no attention."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        h, w = STATES, WIDTH
        self.p = {
            "table": r.normal(0, 0.05, (BUCKETS, w)),
            **{f"W{d}": r.normal(0, 0.4, (w, 3 * h)) for d in "fb"},
            **{f"U{d}": r.normal(0, 0.3, (h, 3 * h)) for d in "fb"},
            **{f"c{d}": np.zeros(3 * h) for d in "fb"},
            "attend": r.normal(0, 0.3, 2 * h),
            "out": r.normal(0, 0.3, 2 * h),
            "bias": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.rate = 0.05

    def inputs(self, buckets: np.ndarray) -> np.ndarray:
        return self.p["table"][buckets].sum(1)

    def forward(self, x: list[np.ndarray], mask: np.ndarray, keep: bool = False):
        """x: gate inputs of either direction for each place (places x windows x 3 states); mask: places x windows."""
        n, b, h = len(mask), mask.shape[1], STATES
        states = np.zeros((n, b, 2 * h), np.float32)
        trail: dict = {}
        whole = mask.all(1)
        for d, (k, order) in enumerate((("f", range(n)), ("b", range(n - 1, -1, -1)))):
            u, state = self.p[f"U{k}"], np.zeros((b, h), np.float32)
            for t in order:
                own, rec = x[d][t], state @ u
                zr = own[:, : 2 * h] + rec[:, : 2 * h]
                np.negative(zr, out=zr)
                np.exp(zr, out=zr)
                zr += 1
                np.reciprocal(zr, out=zr)
                z, r, un = zr[:, :h], zr[:, h:], rec[:, 2 * h :]
                c = np.tanh(own[:, 2 * h :] + r * un)
                new = c + z * (state - c)
                if not whole[t]:
                    new = np.where(mask[t][:, None], new, state)
                if keep:
                    trail[d, t] = (state, z, r, un, c)
                state = new
                states[t, :, d * h : (d + 1) * h] = state
        a = states @ self.p["attend"]
        a[~mask] = -1e9
        a = np.exp(a - a.max(0))
        a /= a.sum(0)
        pooled = np.einsum("tb,tbh->bh", a, states)
        logit = pooled @ self.p["out"] + self.p["bias"]
        return (logit, states, a, pooled, trail) if keep else logit

    def gates(self, x: np.ndarray) -> list[np.ndarray]:
        return [x @ self.p[f"W{k}"] + self.p[f"c{k}"] for k in "fb"]

    def gradients(self, buckets: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
        """Of the weighted mean logistic loss. buckets: places x windows x INPUTS."""
        p, h = self.p, STATES
        x = p["table"][buckets].sum(2)
        logit, states, a, pooled, trail = self.forward(self.gates(x), mask, keep=True)
        g: dict = {k: np.zeros_like(v) for k, v in p.items() if k != "table"}
        dl = (weight * (_sigmoid(logit) - y) / weight.sum()).astype(np.float32)
        g["bias"][0] = dl.sum()
        g["out"] = pooled.T @ dl
        dp = dl[:, None] * p["out"]
        da = np.einsum("tbh,bh->tb", states, dp)
        ds = a * (da - (a * da).sum(0))
        g["attend"] = np.einsum("tb,tbh->h", ds, states)
        dstates = a[:, :, None] * dp + ds[:, :, None] * p["attend"]
        dx = np.zeros_like(x)
        for d, (k, order) in enumerate((("f", range(len(mask) - 1, -1, -1)), ("b", range(len(mask))))):
            u, w, dh = p[f"U{k}"], p[f"W{k}"], np.zeros_like(states[0, :, :h])
            for t in order:
                before, z, r, un, c = trail[d, t]
                dh = dh + dstates[t, :, d * h : (d + 1) * h]
                m = mask[t][:, None]
                live = dh * m
                dz = live * (before - c) * z * (1 - z)
                dc = live * (1 - z) * (1 - c * c)
                dr = dc * un * r * (1 - r)
                dgate = np.concatenate([dz, dr, dc], 1)
                drec = np.concatenate([dz, dr, dc * r], 1)
                g[f"W{k}"] += x[t].T @ dgate
                g[f"c{k}"] += dgate.sum(0)
                g[f"U{k}"] += before.T @ drec
                dx[t] += dgate @ w.T
                dh = live * z + drec @ u.T + dh * ~m
        return g | {"x": dx}

    def score_windows(self, gates: list[np.ndarray], place: np.ndarray, starts: np.ndarray, stops: np.ndarray, batch: int = 2048) -> np.ndarray:
        """Logits of windows. gates: of each distinct word; place: distinct word at each place; stops: the places at which the windows' texts end."""
        out = np.zeros(len(starts), np.float32)
        for i in range(0, len(starts), batch):
            at = starts[i : i + batch] + np.arange(min(WINDOW, int((stops - starts)[i : i + batch].max())))[:, None]
            mask = at < stops[i : i + batch]
            word = place[np.minimum(at, len(place) - 1)]
            out[i : i + batch] = self.forward([gates[0][word], gates[1][word]], mask)
        return out


def score_texts(net: Network, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Score of each text, and (window starts, owners, logits)."""
    buckets, place, first = word_inputs(raw, at)
    starts, owner = windows(first)
    top = np.full(len(at) - 1, -np.inf)
    logit = np.zeros(0, np.float32)
    if len(starts):
        logit = net.score_windows([g.astype(np.float32) for g in net.gates(net.inputs(buckets))], place, starts, first[1:][owner])
        np.maximum.at(top, owner, logit)
    return np.where(np.isinf(top), net.rate, _sigmoid(np.clip(top, -40, 40))), (starts, owner, logit)


def _best_windows(owner: np.ndarray, value: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Indices of the most[o] highest values of each owner."""
    order = np.lexsort((-value, owner))
    o = owner[order]
    begin = np.concatenate([[0], np.flatnonzero(np.diff(o)) + 1])
    nth = np.arange(len(o)) - np.repeat(begin, np.diff(np.append(begin, len(o))))
    return order[nth < most[o]]


def train_network(texts: list[str], y: np.ndarray, rounds: int = 4, epochs: int = 2, batch: int = 128, seed: int = 7) -> Network:
    """Alternate the choice of windows and Adam steps. Deterministic for given texts in a given order."""
    net, rng = Network(seed), np.random.default_rng(seed)
    positive = y.sum()
    net.rate = float((positive + 1) / (len(y) + 20))
    if not positive or positive == len(y):
        net.p["bias"][:] = np.log(net.rate / (1 - net.rate))
        net.p["out"][:] = 0
        return net
    raw, at = arrow_bytes(pa.array(texts, pa.large_string()))
    buckets, place, first = many_word_inputs(raw, at)
    starts, owner = windows(first)
    in_pos, in_all = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for k, label_k in enumerate(y):
        seen = np.unique(buckets[place[first[k] : first[k + 1]]])
        in_pos[seen] += label_k
        in_all[seen] += 1
    odds = np.log((in_pos + 0.5) / (positive + 1)) - np.log((in_all - in_pos + 0.5) / (len(y) - positive + 1))
    odds = np.where(in_all >= 3, np.clip(odds, 0, None), 0) * np.sqrt(np.minimum(in_pos, 50) / 50)
    net.p["table"][:, 0] = odds / 4
    score = odds[buckets].max(1)[place]
    value = np.zeros(len(starts))
    for i in range(0, len(starts), 1 << 14):
        held = starts[i : i + (1 << 14)] + np.arange(WINDOW)[:, None]
        value[i : i + (1 << 14)] = np.where(held < first[1:][owner[i : i + (1 << 14)]], score[np.minimum(held, len(score) - 1)], 0).max(0)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step = 0
    for _ in range(rounds):
        pick = _best_windows(owner, value, np.where(y > 0, 1, 2))
        pick = np.unique(np.concatenate([pick, rng.choice(np.flatnonzero(y[owner] == 0), min(len(texts), (y[owner] == 0).sum()), replace=False)]))
        target = y[owner[pick]].astype(np.float32)
        weight = np.where(target > 0, (1 - target).sum() / max(target.sum(), 1) * 0.5, 1.0).astype(np.float32)
        for _ in range(epochs):
            order = rng.permutation(len(pick))
            for i in range(0, len(order), batch):
                k = order[i : i + batch]
                here = starts[pick[k]] + np.arange(WINDOW)[:, None]
                mask = here < first[1:][owner[pick[k]]]
                own = buckets[place[np.minimum(here, len(place) - 1)]]
                g = net.gradients(own, mask, target[k], weight[k])
                step += 1
                rate = 0.01 * min(1.0, step / 20) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                dx = np.repeat(g.pop("x").reshape(-1, 1, WIDTH), INPUTS, 1).reshape(-1, WIDTH)
                rows, back = np.unique(own.ravel(), return_inverse=True)
                dt = np.stack([np.bincount(back, dx[:, j], len(rows)) for j in range(WIDTH)], 1).astype(np.float32)
                for name, grad in (*g.items(), ("table", dt)):
                    at_rows = rows if name == "table" else slice(None)
                    m, v = moments[name]
                    m[at_rows] = 0.9 * m[at_rows] + 0.1 * grad
                    v[at_rows] = 0.999 * v[at_rows] + 0.001 * grad * grad
                    net.p[name][at_rows] -= rate * m[at_rows] / (np.sqrt(v[at_rows]) + 1e-6)
        value = net.score_windows([q.astype(np.float32) for q in net.gates(net.inputs(buckets))], place, starts, first[1:][owner])
    return net


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MOST_ROWS) -> Network:
    """Fit on a bounded sample: at most 2 * most texts of at most LONGEST characters come to the driver."""
    rows = training_rows(docs, labels, label, most, LONGEST).select("doc_id", "text", "y").toPandas().sort_values(["doc_id", "text"])
    texts, y = rows["text"].tolist(), rows["y"].to_numpy(float)
    del rows
    give_back()
    net = train_network(texts, y)
    del texts
    give_back()
    return net


def _score(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        net = held.value
        for batch in batches:
            _, at = arrow_bytes(batch.column(1))
            for a, b in blocks(at, _CHUNK):
                score, _ = score_texts(net, *arrow_bytes(batch.column(1).slice(a, b - a)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(score.astype(np.float64))], names=["doc_id", "held_out", "score"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", cut_at: float = CUT) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Null and empty texts have the smoothed rate of label 1 as score, as has every text when
    the labels hold one class or none. Repeated rows are scored each; an empty table gives
    no rows. Only doc_id and text are read. The network that is broadcast has a fixed size.
    """
    spark = docs.sparkSession
    workers_see_us(spark)
    net = spark.sparkContext.broadcast(train(docs, labels, label))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), held_out(docs["doc_id"]).alias("held_out"))
    scored = rows.mapInArrow(_score(net), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= cut_at).cast("int"))


def _clean(held, at_text: int, cut_at: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            _, at = arrow_bytes(batch.column(at_text))
            for a, b in blocks(at, _CHUNK):
                part = batch.slice(a, b - a)
                score, _ = score_texts(held.value, *arrow_bytes(part.column(at_text)))
                yield part.filter(pa.array(score < cut_at))

    return run


def drop_toxic(docs: DataFrame, labels: DataFrame, cut_at: float = CUT) -> DataFrame:
    """Documents whose score stays below the cut, with all their columns; each partition streams through one task."""
    spark = docs.sparkSession
    workers_see_us(spark)
    net = spark.sparkContext.broadcast(train(docs, labels))
    return docs.mapInArrow(_clean(net, docs.columns.index("text"), cut_at), docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
