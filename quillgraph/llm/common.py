"""Session helpers, table access and byte-level text kernels shared by the operators."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of all contracts: space and U+0009 to U+000D.
WHITE = [" ", "\t", "\n", "\x0b", "\x0c", "\r"]
WORD = r"[^\x20\x09-\x0D]+"
_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local one of our own only where a local session names none."""
    sc = spark.sparkContext
    if (named := spark.conf.get("spark.checkpoint.dir", None)) or (named := sc.getCheckpointDir()):
        return named
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), "quillgraph-checkpoints"))
    return sc.getCheckpointDir()


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there and lost executors cost nothing.

    A lazy result may still read the table after its maker returned, so what discard() does
    not delete sooner goes when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_at = path
    fs, at = _file_system(spark, path)
    fs.deleteOnExit(at)
    return out


def cut_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one for files that are no tables; it goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, at = _file_system(spark, path)
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def discard(*tables: DataFrame) -> None:
    """Delete tables that cut() wrote, once everything made from them has been written too."""
    for df in tables:
        fs, at = _file_system(df.sparkSession, df._cut_at)
        fs.delete(at, True)


def give_back() -> None:
    """Return the driver's freed memory to the system: what training took would else stay with the process beside the JVM's heap."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library than glibc
        pass


def python_partitions(spark: SparkSession, units: int, most: int) -> int:
    """Partitions for a stage whose cost is in Python, by its own measure of work: at most ``most`` units each, and none joined by its bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-units // most))


#: Rows and bytes of an Arrow batch: what a Python worker holds at once, however long the texts are.
BATCH_ROWS, BATCH_BYTES = 1024, 16 << 20


def workers_see_us(spark: SparkSession) -> None:
    """Put the repository on the Python workers' path, whatever folder the driver was started in, and bound the batches they get."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if _ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *filter(None, [have])])


def without_white(text: Column) -> Column:
    """The text without any character of WHITE; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in WHITE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def word_count(text: Column) -> Column:
    """Number of WORD matches; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


# --------------------------------------------------------------------------- kernels on UTF-8 bytes

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WHITE = np.zeros(256, dtype=bool)
_IS_WHITE[[32, *range(9, 14)]] = True
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: A random-looking 64-bit value for each byte, from the finaliser.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_P))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i modulo 2^64 for i < n."""
    for key, base in (("up", _P), ("down", _P_INV)):
        have = _POWERS.get(key, np.ones(1, dtype=np.uint64))
        while len(have) < n:
            step = np.uint64(pow(base, len(have), 1 << 64))
            have = np.concatenate([have, have * step])
        _POWERS[key] = have
    return _POWERS["up"][:n], _POWERS["down"][:n]


def arrow_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of an Arrow string column, without a copy; null rows are empty."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if not (pa.types.is_large_string(column.type) or pa.types.is_string(column.type)):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def word_spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the first word of each row (with a last entry for the total)."""
    inside = ~_IS_WHITE[raw]
    before = np.empty(len(raw), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    first = at[:-1][at[:-1] < len(raw)]
    before[first] = False  # a row's first byte begins a word even if the last row's text ended in one
    begins = inside & ~before
    after = np.empty(len(raw), bool)
    after[-1:] = False
    after[:-1] = inside[1:] & before[1:]
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


class Spans:
    """64-bit hashes of any spans of a buffer's bytes, by one prefix polynomial over it."""

    def __init__(self, raw: np.ndarray):
        up, self.down = _powers(len(raw) + 1)
        self.prefix = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[raw] * up[: len(raw)], out=self.prefix[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        value = (self.prefix[ends] - self.prefix[starts]) * self.down[starts]
        return mix(value + (ends - starts).astype(np.uint64) * np.uint64(_P))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return Spans(raw)(starts, ends)


def word_hashes(raw: np.ndarray, at: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (A-Z lower-cased if asked) and the first word of each row."""
    if lower:
        raw = _LOWER[raw]
    starts, ends, first = word_spans(raw, at)
    return span_hashes(raw, starts, ends), first


def blocks(at: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or of a single longer row."""
    out, i, n = [], 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        out.append((i, min(j, n)))
        i = out[-1][1]
    return out
