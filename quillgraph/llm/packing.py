"""Vector bin packing of documents into training sequences (operator 6).

A sequence has simultaneous limits on tokens, segments and loss-bearing tokens. For
instruction data the first lines of a text of more lines are its prompt: they bear no
loss, nor does a document's first token. Long documents are cut (into whole sequences
where the loss limit lets one bear loss throughout, else into halves) and what is left of
each document goes to a bounded pool. The dot-product heuristic then fills one sequence at a time with
the feasible piece whose demand vector, weighted by the pool's mean demand, points most
along what the sequence has left. Where no piece fits, the longest is cut to fill it.
A sequence whose loss is spent takes heads of prompts, which bear none, and is padded for
the rest. The last pieces of a partition go to sequences of a power of two tokens, which
need no padding. Nothing is shuffled: each partition streams through one task with a pool of
``POOL`` pieces, and gives the same result whenever it runs again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import table, workers_see_us
from .tokens import WORD_BPE, word_bpe

TOKENS = 2048
SEGMENTS = 128
LOSS = 2048
#: Production limits for instruction data: a sequence trains on at most 31 of 32 of its tokens, so it needs examples with prompts.
INSTRUCTION = (TOKENS, SEGMENTS, 1984)
PROMPT_LINES = 1
POOL = 512
#: A sequence that another limit closed is kept, and padded, from this share of its tokens on; a shorter one ends at a power of two.
FULL = 0.9
#: Fewest tokens of a prompt that fill up a sequence whose loss is spent.
LEAST_HEAD = 4
END_ID = 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long, closed_by string"
_ARROW = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (x.split() for x in SCHEMA.split(", "))])


class Packer:
    """Places pieces (doc_id, start, ids as bytes, doc_tokens, tokens of the document before its first loss) into sequences."""

    def __init__(self, first_id: int, limits: tuple[int, int, int] = (TOKENS, SEGMENTS, LOSS), pool: int = POOL):
        self.next, self.limits, self.most = first_id, np.array(limits, float), pool
        self.capacity, self.segments, self.loss = limits
        self.rows: list[tuple] = []
        self.pool: list[tuple] = []
        self.whole = self.loss >= self.capacity
        self.step = self.capacity if self.whole else 1 << (max(1, min(self.loss, self.capacity // 2)).bit_length() - 1)

    @staticmethod
    def demand(piece: tuple) -> tuple[int, int, int]:
        """Tokens, segments and loss-bearing tokens."""
        n = len(piece[2]) // 4
        return n, 1, max(0, piece[1] + n - max(piece[1], piece[4]))

    @staticmethod
    def unlearned(piece: tuple) -> int:
        """Tokens at the head of a piece that bear no loss."""
        return max(0, min(piece[4] - piece[1], len(piece[2]) // 4))

    def put(self, pieces: list[tuple], closed_by: str) -> None:
        """Close a sequence."""
        offset = 0
        for piece in pieces:
            doc_id, start, ids, total, _ = piece
            n, _, loss = self.demand(piece)
            self.rows.append((doc_id, start, n, zlib.crc32(ids), total, self.next, offset, loss, closed_by))
            offset += n
        self.next += 1

    def add(self, doc_id: int | None, ids: bytes, prompt: int = 0) -> None:
        """Take a document whose first ``prompt`` tokens bear no loss; nothing predicts its first token."""
        total, start, prompt = len(ids) // 4, 0, max(1, prompt)
        while start < total:
            piece = (doc_id, start, ids[4 * start : 4 * (start + self.step)], total, prompt)
            start += self.step
            if self.whole and start <= total:
                self.put([piece], "tokens")
                continue
            self.pool.append(piece)
            if len(self.pool) >= 2 * self.most:
                self.fill(self.most)

    def fill(self, leave: int) -> None:
        """Fill sequences until the pool holds at most ``leave`` pieces."""
        pool = self.pool
        need = np.array([self.demand(p) for p in pool], float)
        prompts = np.array([self.unlearned(p) for p in pool], np.int64)
        free = np.ones(len(pool), bool)
        if not pool:
            return
        pull = need.mean(0) / self.limits / self.limits
        left_over, waiting = len(pool), int(need[:, 0].sum())
        while left_over > leave:
            size = self.capacity
            if leave == 0 and (rest := waiting) < self.capacity:
                size = 1 << (rest.bit_length() - 1)
            left = np.array([size, self.segments, min(self.loss, size)], float)
            chosen: list[tuple] = []
            while left[0] > 0 and left[1] > 0:
                fits = free & (need[:, 0] <= left[0]) & (need[:, 2] <= left[2])
                if fits.any():
                    k = int(np.argmax(np.where(fits, need @ (pull * left), -1.0)))
                    chosen.append(pool[k])
                    left -= need[k]
                    free[k] = False
                    left_over -= 1
                elif left_over and left[2] > 0:
                    k = int(np.argmax(np.where(free, need[:, 0], -1.0)))
                    head, pool[k] = self.split(pool[k], int(min(left[0], left[2] + max(0, pool[k][4] - pool[k][1]))))
                    chosen.append(head)
                    left -= self.demand(head)
                    need[k], prompts[k] = self.demand(pool[k]), self.unlearned(pool[k])
                else:
                    break
            closed_by = "tokens" if left[0] == 0 and size == self.capacity else "end" if left[0] == 0 else "segments" if left[1] == 0 else "loss"
            if closed_by == "loss":
                left_over -= self.fill_with_prompts(chosen, left, free, need, prompts)
            used = sum(len(p[2]) for p in chosen) // 4
            if size == self.capacity and used >= FULL * self.capacity:
                self.put(chosen, closed_by)
                waiting -= used
                continue
            back = used - (1 << (used.bit_length() - 1)) if used < self.capacity else 0
            while back:  # a sequence that another limit closed: end it at a power of two
                n = len(chosen[-1][2]) // 4
                if n > back:
                    head, tail = self.split(chosen.pop(), n - back)
                    chosen.append(head)
                else:
                    tail = chosen.pop()
                back -= min(n, back)
                left_over += 1
                pool.append(tail)
                need = np.vstack([need, self.demand(tail)])
                prompts = np.append(prompts, self.unlearned(tail))
                free = np.append(free, True)
            self.put(chosen, closed_by)
            waiting -= sum(len(p[2]) for p in chosen) // 4
        self.pool = [p for p, x in zip(pool, free) if x]

    def fill_with_prompts(self, chosen: list[tuple], left: np.ndarray, free: np.ndarray, need: np.ndarray, prompts: np.ndarray) -> int:
        """Put heads of prompts, which bear no loss, into a sequence that may bear no more; longest first, none under LEAST_HEAD tokens.

        Returns how many pieces of the pool went in whole.
        """
        pool, whole = self.pool, 0
        prompt = prompts * free
        for k in np.argsort(-prompt, kind="stable"):
            n = int(min(prompt[k], left[0]))
            if n < LEAST_HEAD or left[1] < 1:
                break
            if n == len(pool[k][2]) // 4:
                head, free[k] = pool[k], False
                whole += 1
            else:
                head, pool[k] = self.split(pool[k], n)
                need[k], prompts[k] = self.demand(pool[k]), self.unlearned(pool[k])
            chosen.append(head)
            left -= self.demand(head)
        return whole

    @staticmethod
    def split(piece: tuple, n: int) -> tuple[tuple, tuple]:
        doc_id, start, ids, *rest = piece
        return (doc_id, start, ids[: 4 * n], *rest), (doc_id, start + n, ids[4 * n :], *rest)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows), _ARROW)], schema=_ARROW)
            self.rows = []


def prompt_of(text: str, lines: int) -> str:
    """The first ``lines`` lines of a text of more lines; of any other text nothing."""
    at = -1
    for _ in range(lines):
        at = text.find("\n", at + 1)
        if at < 0:
            return ""
    return text[: at + 1]


def _pack(vocabulary: str, limits: tuple[int, int, int], pool: int, prompt_lines: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, end = word_bpe(vocabulary), np.array([END_ID], "<u4").tobytes()
        packer = Packer(TaskContext.get().partitionId() << 40, limits, pool)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            prompts = [prompt_of(x, prompt_lines) if prompt_lines else "" for x in texts]
            for doc_id, (own, prompt) in zip(batch.column(0).to_pylist(), model.ids_and_heads(texts, prompts)):
                packer.add(doc_id, own + end, prompt)
            yield from packer.flush()
        packer.fill(0)
        yield from packer.flush()

    return run


def pack(docs: DataFrame, vocabulary: str = WORD_BPE, limits: tuple[int, int, int] = (TOKENS, SEGMENTS, LOSS), pool: int = POOL, prompt_lines: int = 0) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens, closed_by.

    Each id of each row's text lies in exactly one piece; null and empty texts are the end
    id alone. Repeated rows are packed each. An empty table gives no rows. Sequence ids
    hold the partition and a running number; offsets run from 0 without gaps. loss_tokens
    are those of the piece; closed_by says which limit closed its sequence (tokens, segments
    or loss; end: the partition's last sequences, of a power of two). A sequence that
    segments or loss closed is padded if it is full to FULL at least, else it ends at a power of two.
    """
    workers_see_us(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return rows.mapInArrow(_pack(vocabulary, limits, pool, prompt_lines), SCHEMA)


def pack_instructions(docs: DataFrame) -> DataFrame:
    """pack() with the production limits: first lines are prompts, and the loss limit binds."""
    return pack(docs, limits=INSTRUCTION, prompt_lines=PROMPT_LINES)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_instructions(table(spark, sf_dir, "documents"))
