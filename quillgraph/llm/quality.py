"""Quality classifier: histogram gradient-boosted trees over document statistics (operator 7)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import Trees, fit
from .common import Spans, arrow_bytes, blocks, table, word_spans, workers_see_us
from .labelled import held_out, training_rows

#: The most labelled rows of each class that are trained on, and the longest text among them.
MOST_ROWS = 4000
LONGEST = 100_000
CUT = 0.3
_CHUNK = 1 << 21
_CLASSES = {
    "upper": list(range(65, 91)),
    "lower": list(range(97, 123)),
    "digit": list(range(48, 58)),
    "stop": [33, 46, 63],
    "bang": [33],
    "bar": [124],
    "symbol": [35, 36, 37, 38, 42, 64, 94, 126, 43, 61, 60, 62, 95, 92, 47],
    "comma": [44, 58, 59],
    "bracket": [40, 41, 91, 93, 123, 125],
    "line": [10],
    "high": list(range(128, 256)),
}
_CLASS = np.zeros((256, len(_CLASSES)))
for _k, _members in enumerate(_CLASSES.values()):
    _CLASS[_members, _k] = 1


def _distinct(owner: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each owner, and the count of its most frequent one."""
    if not len(value):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((value, owner))
    o, v = owner[order], value[order]
    new = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (v[1:] != v[:-1])]))
    runs = np.diff(np.append(new, len(v)))
    top = np.zeros(n)
    np.maximum.at(top, o[new], runs)
    return np.bincount(o[new], minlength=n).astype(float), top


def statistics(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Statistics (rows x features) of whole texts given as UTF-8 bytes and offsets."""
    n, size = len(at) - 1, np.diff(at)
    owner = np.repeat(np.arange(n), size)
    counts = np.bincount(owner * 256 + raw, minlength=n * 256).reshape(n, 256).astype(float)
    starts, ends, first = word_spans(raw, at)
    words = np.diff(first)
    word_owner = np.repeat(np.arange(n), words)
    length = (ends - starts).astype(float)
    hashes = Spans(raw)
    hashed = hashes(starts, ends)
    some, many = np.maximum(size, 1), np.maximum(words, 1)
    shares = counts @ _CLASS / some[:, None]
    p = counts / some[:, None]
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(1)

    def by_row(v: np.ndarray) -> np.ndarray:
        return np.bincount(word_owner, v, n) if len(v) else np.zeros(n)

    mean = by_row(length) / many
    spread = np.sqrt(np.maximum(by_row(length**2) / many - mean**2, 0))
    last, head = (raw[ends - 1], raw[starts]) if len(starts) else (raw, raw)
    shout = (head >= 65) & (head <= 90) & (last != head)
    distinct, top = _distinct(word_owner, hashed, n)
    pair = hashed[:-1] * np.uint64(31) + hashed[1:] if len(hashed) > 1 else np.zeros(0, np.uint64)
    inside = np.flatnonzero(word_owner[:-1] == word_owner[1:]) if len(hashed) > 1 else np.zeros(0, np.int64)
    pairs, top_pair = _distinct(word_owner[inside], pair[inside], n)
    breaks = np.flatnonzero(raw == 10)
    line_starts = np.unique(np.concatenate([at[:-1][size > 0], breaks[breaks + 1 < len(raw)] + 1]))
    line_ends = np.append(line_starts[1:], len(raw))
    line_owner = owner[line_starts] if len(line_starts) else line_starts
    lines = np.bincount(line_owner, minlength=n) if len(line_starts) else np.zeros(n)
    lines_distinct, top_line = _distinct(line_owner, hashes(line_starts, line_ends), n) if len(line_starts) else (np.zeros(n), np.zeros(n))
    longest = np.zeros(n)
    if len(length):
        np.maximum.at(longest, word_owner, length)
    symbol_end = ((last < 48) | ((last > 57) & (last < 65)) | ((last > 90) & (last < 97)) | ((last > 122) & (last < 128))) if len(starts) else np.zeros(0, bool)
    columns = [
        np.log1p(size), np.log1p(words), mean, spread, longest, entropy,
        by_row(shout.astype(float)) / many, by_row(symbol_end.astype(float)) / many, by_row((length <= 3).astype(float)) / many, by_row((length == 1).astype(float)) / many,
        distinct / many, top / many, pairs / np.maximum(words - 1, 1), top_pair / np.maximum(words - 1, 1),
        np.log1p(lines), words / np.maximum(lines, 1), lines_distinct / np.maximum(lines, 1), top_line / np.maximum(lines, 1),
        shares[:, 0] / np.maximum(shares[:, 0] + shares[:, 1], 1e-9),
    ]
    return np.column_stack([*columns, shares])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, at = arrow_bytes(batch.column(1))
        for a, b in blocks(at, _CHUNK):
            x = statistics(*arrow_bytes(batch.column(1).slice(a, b - a)))
            yield pa.RecordBatch.from_arrays([batch.column(2).slice(a, b - a), pa.array(list(x), pa.list_(pa.float64()))], names=["y", "x"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST_ROWS) -> Trees:
    """Fit on a bounded sample; statistics are computed where the texts are, and only they come to the driver."""
    rows = training_rows(docs, labels, label, most, LONGEST).select("doc_id", "text", "y").mapInArrow(_features, "y int, x array<double>").toPandas()
    if not len(rows):
        return Trees(0.0, 1)
    x, y = np.stack(rows["x"]), rows["y"].to_numpy(float)
    order = np.lexsort(x.T[::-1])  # the sample's order of arrival must not matter
    return fit(x[order], y[order], np.ones(len(y)))


def _score(model: Trees):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, at = arrow_bytes(batch.column(1))
            for a, b in blocks(at, _CHUNK):
                score = model.score(statistics(*arrow_bytes(batch.column(1).slice(a, b - a))))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(score)], names=["doc_id", "held_out", "score"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", cut_at: float = CUT) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Only the text is scored, whole; null counts as empty, and an empty text has the score
    of its (zero) statistics. Without labels of both classes every score is the rate of
    label 1, 0.5 without any. Repeated rows are scored each; an empty table gives no rows.
    Only doc_id and text are read.
    """
    workers_see_us(docs.sparkSession)
    model = train(docs, labels, label)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), held_out(docs["doc_id"]).alias("held_out"))
    scored = rows.mapInArrow(_score(model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= cut_at).cast("int"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
