"""Token counts by offset-mapped attribution (operator 5).

A document is encoded once, as a whole. The byte-level vocabulary loses nothing, so the
running sum of token lengths maps every token to its span in the text. An interval join
of those spans with the sections (here the lines of the text, each with its line end)
counts tokens by section. A token that crosses boundaries belongs to the section that
holds its first byte; the section also reports how many of its tokens run on beyond it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_bytes, table, workers_see_us
from .tokens import BYTE_BPE, byte_bpe

SCHEMA = "doc_id long, section long, start_byte long, n_bytes long, n_tokens long, crossing long, doc_tokens long"
_ARROW = pa.schema([(x.split()[0], pa.int64()) for x in SCHEMA.split(", ")])


def sections_of(raw: np.ndarray) -> np.ndarray:
    """First byte of each line; an empty text is one empty section."""
    starts = np.concatenate([[0], np.flatnonzero(raw == 10) + 1])
    return starts[:-1] if len(starts) > 1 and starts[-1] == len(raw) else starts


def attribute(ends: np.ndarray, sections: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section by the first-byte rule, and those of them that end beyond the section."""
    begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    owner = np.searchsorted(sections, begins, side="right") - 1
    reach = np.searchsorted(sections, ends - 1, side="right") - 1
    return np.bincount(owner, minlength=len(sections)), np.bincount(owner[reach > owner], minlength=len(sections))


def _count(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = byte_bpe(vocabulary)
        for batch in batches:
            raw, at = arrow_bytes(batch.column(1))
            ids = batch.column(0).to_pylist()
            out: list[list[np.ndarray]] = []
            keys: list[tuple] = []
            for i, doc_id in enumerate(ids):
                own = raw[at[i] : at[i + 1]]
                ends = model.ends(own.tobytes().decode("utf-8", "replace"))
                starts = sections_of(own)
                n, crossing = attribute(ends, starts)
                out.append([np.arange(len(starts)), starts, np.diff(np.append(starts, len(own))), n, crossing, np.full(len(starts), len(ends))])
                keys += [doc_id] * len(starts)
            if out:
                columns = [np.concatenate(c).astype(np.int64) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *map(pa.array, columns)], schema=_ARROW)

    return run


def token_counts(docs: DataFrame, vocabulary: str = BYTE_BPE) -> DataFrame:
    """One row per section: doc_id, section (from 0), start_byte, n_bytes, n_tokens, crossing, doc_tokens.

    The sections' n_tokens add up to doc_tokens, the length of the encoding of the whole
    text. Null and empty texts have one empty section without tokens. Repeated rows are
    counted each; an empty table gives no rows; only doc_id and text are read. Each
    partition streams through one task, nothing is shuffled.
    """
    workers_see_us(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(_count(vocabulary), SCHEMA)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
