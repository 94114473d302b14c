"""Near-duplicate detection with HyperMinHash sketches (operator 1).

Each document's set of five-word shingles becomes 256 registers. A register holds the
smallest hash of its bucket in compressed form: the count of leading zeros and ten
mantissa bits (Yu and Weber). Empty registers borrow from pseudo-random others (optimal
densification), so short documents band as well as long ones. Bands of four registers
give candidate pairs; the share of equal registers, corrected for the chance that two
different minima have one compressed form, estimates Jaccard similarity; pairs within
five deviations of the bar are confirmed on the full sets. Sets of fewer shingles than
registers share few values among many registers, so their estimate spreads wider than a
binomial one and rejects nothing: pairs with such a set are confirmed on the full sets.

Rows with equal sets are one class, and classes, not doc_ids, are what is linked: a class
has a number of its own and the smallest doc_id of its rows. No pairs are formed within a
bucket at first: each member meets the bucket's smallest number. Confirmed links become
components, and only buckets that still hold several components have their
remaining cross-component pairs estimated, in blocks of bounded size. A pair whose ends
already are connected needs no test, so no link between different components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_bytes, blocks, cut, discard, mix, python_partitions, table, word_hashes, workers_see_us
from .components import components
from .tokens import forget

WORDS = 5
#: Similarity bar in hundredths.
BAR = 75
REGISTERS = 256
#: Bands of BAND registers each; the other registers only sharpen the estimate.
BANDS, BAND = 32, 4
MANTISSA = 10
#: Deviations of the estimate below the bar at which a pair is still confirmed on full sets.
MARGIN = 5.0
#: Members of a bucket, and shingles of theirs, that one side of a block pair in the second round has on average.
BLOCK, BLOCK_SHINGLES = 256, 1 << 20
#: Rows of block pairs in one task of the second round.
TASK_ROWS = 4096
_CHUNK = 1 << 21
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it, and each text's first hash. Texts of fewer words have one; texts without words none."""
    raw, at = arrow_bytes(texts)
    hashed, first = word_hashes(raw, at)
    count = np.diff(first)
    doc = np.repeat(np.arange(len(count)), count)
    last = first[1:][doc] - words
    begin = np.flatnonzero(np.arange(len(hashed)) <= last)
    value = np.zeros(len(begin), np.uint64)
    for k in range(words):
        value = mix(value * _STEP + hashed[begin + k])
    owner = doc[begin]
    short = np.flatnonzero((count > 0) & (count < words))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for k in range(words - 1):
            here = count[short] > k
            whole[here] = mix(whole[here] * _STEP + hashed[first[short[here]] + k])
        value = np.concatenate([value, mix(whole + count[short].astype(np.uint64))])
        owner = np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        value, owner = value[order], owner[order]
    cuts = np.searchsorted(owner, np.arange(len(count) + 1))
    parts = [np.unique(value[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
    sizes = np.array([len(p) for p in parts], np.int64)
    return (np.concatenate(parts) if parts else value), np.concatenate([[0], np.cumsum(sizes)])


def _donors(registers: int, tries: int = 64) -> np.ndarray:
    """The register from which each empty one borrows at each try: fixed by a hash, the same for all documents."""
    j = np.arange(registers, dtype=np.uint64)
    return np.array([mix(j * _STEP + np.uint64(t + 1)) % np.uint64(registers) for t in range(tries)]).astype(np.int64)


def _ranks(registers: int) -> np.ndarray:
    """(borrower, donor) -> order in which a borrower that found nothing turns to the donors: hashed for each borrower on its own, the same for all documents."""
    j = np.arange(registers, dtype=np.uint64)
    return np.argsort(np.argsort(mix(mix(j * _STEP)[:, None] ^ (j + np.uint64(1 << 32))), axis=1), axis=1).astype(np.uint16)


def sketches(value: np.ndarray, at: np.ndarray, registers: int = REGISTERS, mantissa: int = MANTISSA) -> np.ndarray:
    """Compressed registers (documents x registers) of shingle sets; rows of empty sets are all ones."""
    n = len(at) - 1
    owner = np.repeat(np.arange(n), np.diff(at))
    low = np.full(n * registers, _EMPTY)
    np.minimum.at(low, owner * registers + (value % np.uint64(registers)).astype(np.int64), value // np.uint64(registers))
    low = low.reshape(n, registers)
    fraction, exponent = np.frexp(low.astype(np.float64))
    packed = ((64 - exponent).astype(np.uint16) << np.uint16(mantissa)) | np.minimum((fraction * 2 - 1) * (1 << mantissa), (1 << mantissa) - 1).astype(np.uint16)
    packed[low == _EMPTY] = 0xFFFF
    todo = np.flatnonzero(np.diff(at) > 0)
    base = packed.copy()
    for take in _donors(registers):
        here = packed[todo]
        packed[todo] = np.where(here == 0xFFFF, base[todo][:, take], here)
        todo = todo[(packed[todo] == 0xFFFF).any(1)]
    ranks = _ranks(registers) if len(todo) else None
    for d in todo:  # few registers hold anything: each empty one takes the first of these in its own order
        empty, full = np.flatnonzero(packed[d] == 0xFFFF), np.flatnonzero(base[d] != 0xFFFF)
        packed[d, empty] = base[d, full[ranks[empty[:, None], full].argmin(1)]]
    return packed


_SKETCH = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.binary()), ("registers", pa.binary())])


def _set_ids(value: np.ndarray, first: np.ndarray) -> list[bytes | None]:
    """128 bits that equal sets share; None for an empty set."""
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(value + _STEP))])
    other = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(value ^ _STEP))])
    ids = np.stack([run[first[1:]] - run[first[:-1]], other[first[1:]] - other[first[:-1]]], 1)
    return [None if n == 0 else ids[i].tobytes() for i, n in enumerate(np.diff(first))]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    for batch in batches:
        _, at = arrow_bytes(batch.column(2))
        for a, b in blocks(at, _CHUNK):
            value, first = shingle_sets(batch.column(2).slice(a, b - a))
            regs = [r.tobytes() for r in sketches(value, first)]
            own = [batch.column(k).slice(a, b - a) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(first)), pa.array(_set_ids(value, first), pa.binary()), pa.array(regs, pa.binary())], schema=_SKETCH)


def sketch_table(docs: DataFrame) -> DataFrame:
    """doc_id, mark (a hash of the text, to find the row again), n_shingles, set_id (128 bits that equal sets share; null for an empty set), registers."""
    workers_see_us(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("mark"), docs["text"].alias("text"))
    return rows.mapInArrow(_sketch, "doc_id long, mark long, n_shingles long, set_id binary, registers binary")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    for batch in batches:
        _, at = arrow_bytes(batch.column(1))
        for a, b in blocks(at, _CHUNK):
            value, first = shingle_sets(batch.column(1).slice(a, b - a))
            sets = pa.array([value[i:j].tobytes() for i, j in zip(first[:-1], first[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(_set_ids(value, first), pa.binary()), sets], names=["rep", "set_id", "shingles"])


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, mantissa: int = MANTISSA) -> np.ndarray:
    """Jaccard estimate from the share of equal registers, less the share that compression alone makes equal.

    Two independent minima with rates n and m fall into one cell of relative width
    2^-mantissa with probability 0.7213 * 2^-mantissa * n m / (n + m)^2, where 0.7213 is
    1 / (2 ln 2), the mean of cell width over value.
    """
    equal = (a == b).mean(-1)
    na, nb = na.astype(float), nb.astype(float)
    chance = 0.5 / np.log(2) * 2.0**-mantissa * na * nb / np.maximum(na + nb, 1.0) ** 2
    return (equal - chance) / (1 - chance)


def _floor(bar: int = BAR, registers: int = REGISTERS) -> float:
    p = bar / 100
    return p - MARGIN * np.sqrt(p * (1 - p) / registers)


def within_reach(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that go to confirmation, and the estimates. No estimate rejects a pair of which a set has fewer shingles than there are registers."""
    near = estimate(a, b, na, nb)
    return (near >= _floor()) | (np.minimum(na, nb) < REGISTERS), near


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(len(column), -1)


def similar_enough(pairs: DataFrame, sketched: DataFrame) -> DataFrame:
    """Pairs (u, v) whose sizes and estimate leave the bar within reach."""
    left = sketched.select(F.col("id").alias("u"), F.col("registers").alias("ru"), F.col("n_shingles").alias("nu"))
    right = sketched.select(F.col("id").alias("v"), F.col("registers").alias("rv"), F.col("n_shingles").alias("nv"))

    @F.pandas_udf("boolean")
    def near(ru: pd.Series, rv: pd.Series, nu: pd.Series, nv: pd.Series) -> pd.Series:
        return pd.Series(within_reach(_matrix(ru), _matrix(rv), nu.to_numpy(), nv.to_numpy())[0]) if len(ru) else pd.Series([], dtype=bool)

    met = pairs.join(left, "u").join(right, "v").where(100 * F.least("nu", "nv") >= BAR * F.greatest("nu", "nv"))
    return met.where(near("ru", "rv", "nu", "nv")).select("u", "v")


def shared(x: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Size of the intersection of a sorted set with each of several."""
    sizes = np.array([len(o) for o in others])
    flat = np.concatenate(others)
    hit = x[np.minimum(np.searchsorted(x, flat), len(x) - 1)] == flat
    return np.add.reduceat(hit, np.concatenate([[0], np.cumsum(sizes)[:-1]]), dtype=np.int64)


def full_sets(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, shingles) of the asked classes (id, rep, set_id): only texts of rows with such a doc_id are read again, and of each class one row's set stays."""
    texts = docs.select(docs["doc_id"].cast("long").alias("rep"), docs["text"].alias("text")).join(asked.select("rep"), "rep", "left_semi")
    found = texts.mapInArrow(_sets, "rep long, set_id binary, shingles binary").join(asked, ["rep", "set_id"])
    return found.select("id", "shingles").dropDuplicates(["id"])


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets reach the bar: 100 * intersection >= 75 * union."""

    @F.pandas_udf("boolean")
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.zeros(len(a), bool)
        for i, (x, y) in enumerate(zip(a, b)):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = int(shared(x, [y])[0])
            out[i] = 100 * both >= BAR * (len(x) + len(y) - both)
        return pd.Series(out)

    met = pairs.join(sets.select(F.col("id").alias("u"), F.col("shingles").alias("a")), "u").join(sets.select(F.col("id").alias("v"), F.col("shingles").alias("b")), "v")
    return met.where(linked("a", "b")).select("u", "v")


def _candidates(rows: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each first-side row of a pair of blocks: second-side rows of other components that are similar enough by size and estimate and share no earlier band with it, best first."""
    side, ids, component, n = (rows[c].to_numpy() for c in ("side", "id", "component", "n_shingles"))
    regs = _matrix(rows["registers"])
    band = int(rows["band"].iloc[0])
    two = np.flatnonzero(side >= 1)
    for u in np.flatnonzero(side <= 1):
        v = two[(component[two] != component[u]) & (100 * np.minimum(n[two], n[u]) >= BAR * np.maximum(n[two], n[u]))]
        if side[u] == 1:
            v = v[ids[v] > ids[u]]
        if len(v):
            keep, near = within_reach(regs[u], regs[v], np.full(len(v), n[u]), n[v])
            v, near = v[keep], near[keep]
            if band and len(v):
                earlier = (regs[u, : band * BAND] == regs[v, : band * BAND]).reshape(len(v), band, BAND).all(2).any(1)
                v, near = v[~earlier], near[~earlier]
            if len(v):
                order = np.argsort(-near, kind="stable")
                yield u, v[order], near[order]


def _flag(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows of a pair of blocks that stand in a candidate pair of this band."""
    keep = np.zeros(len(rows), bool)
    for u, v, _ in _candidates(rows):
        keep[u] = keep[v] = True
    return rows.loc[keep, ["key", "i", "j", "id", "side"]]


def _connect(rows: pd.DataFrame) -> pd.DataFrame:
    """Confirmed links between components of a pair of blocks, as many as connect what can be connected there."""
    sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"]]
    ids, size = rows["id"].to_numpy(), np.array([len(x) for x in sets])
    root = {c: c for c in rows["component"]}
    component = rows["component"].to_numpy()

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    out = []
    for u, v, _ in _candidates(rows):
        for k in range(0, len(v), 64):
            part = np.array([w for w in v[k : k + 64] if find(component[w]) != find(component[u])], np.int64)
            if len(part):
                both = shared(sets[u], [sets[w] for w in part])
                for w in part[100 * both >= BAR * (size[u] + size[part] - both)]:
                    a, b = find(component[u]), find(component[w])
                    if a != b:
                        root[max(a, b)] = min(a, b)
                        out.append((min(ids[u], ids[w]), max(ids[u], ids[w])))
    return pd.DataFrame(out, columns=["u", "v"], dtype="int64")


def late_links(bands: DataFrame, members: DataFrame, sets: DataFrame) -> DataFrame:
    """A written table of links between different components that share a band. bands: key, band, id; members: id, component, n_shingles, registers.

    Only buckets that hold several components are looked at. A small one is one group. A larger one's greatest component and
    its other members are dealt by hash into parts of about BLOCK members or BLOCK_SHINGLES
    shingles each; the others' parts meet each other and the largest component's parts, which
    never meet among themselves. So a bucket of one great component and a few strays costs
    little more than its rows, and each pair of parts is a bounded group. A first pass over
    registers keeps the members that stand in a candidate pair, each pair in its first common
    band; the second brings their full sets and gives links that connect components, never
    all pairs.
    """
    held = bands.join(members.select("id", "component", "n_shingles"), "id")
    each = held.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("m"))
    most = F.struct("n", "component", "m")
    sums = each.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("m").alias("m"), F.max(most).alias("main")).where("k > 1")
    parts = lambda n, m: F.greatest(F.ceil(n / F.lit(BLOCK)), F.ceil(m / F.lit(BLOCK_SHINGLES))).cast("long")
    whole = (F.col("n") <= BLOCK) & (F.col("m") <= BLOCK_SHINGLES)
    p_main, p_other = parts(F.col("main.n"), F.col("main.m")), parts(F.col("n") - F.col("main.n"), F.col("m") - F.col("main.m"))
    cut_up = sums.select("key", F.when(~whole, F.col("main.component")).alias("main"), F.when(whole, 0).otherwise(p_main).alias("p_main"), F.when(whole, 1).otherwise(p_other).alias("p_other"))
    dealt = held.join(cut_up, "key").withColumn("own", F.coalesce(F.col("component") == F.col("main"), F.lit(False)))
    part = F.pmod(F.xxhash64("id"), F.when(F.col("own"), F.col("p_main")).otherwise(F.col("p_other")))
    dealt = dealt.select("key", "band", "id", "own", "p_main", "p_other", part.alias("part"))
    upto = lambda p: F.when(F.col(p) > 0, F.sequence(F.lit(0).cast("long"), F.col(p) - 1)).otherwise(F.array().cast("array<long>"))
    place = lambda i, j, side: F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"), side.cast("int").alias("side"))
    a = F.col("part")
    among = F.transform(upto("p_other"), lambda b: place(F.least(a, b), F.greatest(a, b), F.when(a < b, 0).when(a == b, 1).otherwise(2)))
    with_main = F.transform(upto("p_main"), lambda b: place(-1 - a, b, F.lit(0)))
    from_main = F.transform(upto("p_other"), lambda b: place(-1 - b, a, F.lit(2)))
    met = cut(dealt.select("key", "band", "id", F.inline(F.when(F.col("own"), from_main).otherwise(F.concat(among, with_main)))), "met")
    group = ["key", "i", "j"]
    tasks = python_partitions(met.sparkSession, met.count(), TASK_ROWS)
    rows = met.join(members, "id").repartition(tasks, *group)
    flagged = cut(rows.groupBy(*group).applyInPandas(_flag, "key long, i long, j long, id long, side int"), "flagged")
    full = flagged.join(members, "id").join(sets, "id").join(bands.select("key", "id", "band"), ["key", "id"])
    tasks = python_partitions(met.sparkSession, flagged.count(), TASK_ROWS)
    late = cut(full.repartition(tasks, *group).groupBy(*group).applyInPandas(_connect, "u long, v long").distinct(), "late")
    discard(met, flagged)
    return late


def _labelled(docs: DataFrame) -> DataFrame:
    """doc_id, mark, n_shingles, component_id, kept of each row."""
    sketched = cut(sketch_table(docs), "sketches")
    known = sketched.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = known.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"))
    classes = cut(classes.withColumn("id", F.monotonically_increasing_id()), "classes")  # numbers hold once they are written
    width = 2 * BAND
    keys = F.array(*[F.struct(F.lit(i).alias("band"), F.xxhash64(F.substring("registers", 1 + width * i, width), F.lit(i)).alias("key")) for i in range(BANDS)])
    every = classes.select("id", F.inline(keys))
    common = every.groupBy("key").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "low")
    bands = cut(every.join(common, "key"), "bands")
    asked = classes.select("id", "rep", "set_id").join(bands.select("id"), "id", "left_semi")
    sets = cut(full_sets(docs, asked), "sets")
    stars = bands.where("id <> low").select(F.col("low").alias("u"), F.col("id").alias("v")).distinct()
    links = cut(confirm(similar_enough(stars, classes), sets), "links")
    found = components(links)
    members = classes.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"), "n_shingles", "registers")
    members = cut(members, "members")
    late = late_links(bands.select("key", "band", "id"), members, sets)
    if not late.isEmpty():
        discard(found)
        found = components(links.unionByName(late))
    placed = classes.select("id", "rep", "set_id").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    lowest = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    label = cut(placed.join(lowest, "component").select("set_id", "component_id"), "labels")
    discard(classes, bands, sets, links, members, late, found)
    out = sketched.join(label, (sketched["set_id"] == label["set_id"]) & sketched["doc_id"].isNotNull(), "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "mark", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Each row is a text of its own: links go from shingle set to shingle set, so of rows with
    one doc_id and different texts each has its own links and component, and that component
    is the smallest doc_id of all rows reached. Texts without words have no shingles and are
    components of their own. Rows without doc_id take no part: they have a null component,
    are kept, and link nothing. An empty table gives no rows. Only doc_id and text are read,
    so other columns cannot clash.
    """
    return _labelled(docs).drop("mark")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """Documents with one document of each near-duplicate group: the one with the smallest doc_id. Rows of one doc_id are decided each by its own text; rows without doc_id stay."""
    stay = _labelled(docs).where("kept").select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")).distinct()
    return docs.join(stay, docs["doc_id"].cast("long").eqNullSafe(stay["__id"]) & (F.xxhash64(docs["text"]) == stay["__mark"]), "left_semi")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN [array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)] WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS both_ FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * both_ >= 75 * (x.n + y.n - both_)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r(id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.id),
c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept FROM w JOIN c ON c.id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""
