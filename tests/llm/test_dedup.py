import hashlib
import itertools
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import exact_dedup, near_dedup
from quillgraph.llm.components import components

CLASH = dict.fromkeys(("digest", "id", "key", "band", "u", "v", "component", "set_id", "n", "keep_id", "registers", "rep"), "x")


# --------------------------------------------------------------------------- exact copies


def exact_brute(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    out = {}
    for norm, members in groups.items():
        keep = min(members)[1]
        for _, i in members:
            out[i] = (keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest())
    return out


def exact_rows(df):
    return {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.exact_groups(df).collect()}


@pytest.mark.parametrize("more", [None, CLASH])
def test_exact_groups(docs, more):
    rows = [(1, "a b"), (2, "ab"), (3, "a\tb\n"), (4, None), (5, ""), (6, " \r\n"), (7, "A b"), (8, "é\x0bx"), (9, "éx"), (10, "x" * 200_000), (11, "a\u00a0b")]
    assert exact_rows(docs(rows, more)) == exact_brute(rows)


def test_heavy_digests_take_the_broadcast_path(docs):
    rows = [(i, "hot text " + " " * (i % 7)) for i in range(300)] + [(1000 + i, f"t{i // 2}") for i in range(100)]
    df = docs(rows)
    narrow = exact_dedup.narrow(df)
    heavy = exact_dedup.heavy_digests(narrow, len(rows), 10)
    assert heavy.count() == 1
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.exact_groups(df, heavy_share=10).collect()}
    assert got == exact_brute(rows)


def test_exact_empty_table(docs):
    assert exact_dedup.exact_groups(docs([])).count() == 0
    assert exact_dedup.drop_copies(docs([])).count() == 0


def test_drop_copies_keeps_columns(docs):
    df = docs([(1, "a b"), (2, "a  b"), (3, None), (4, ""), (5, "c")])
    out = exact_dedup.drop_copies(df)
    assert out.columns == df.columns and sorted(r["doc_id"] for r in out.collect()) == [2, 3, 5]


# --------------------------------------------------------------------------- components


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {x["id"]: x["component"] for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root if x != find(x)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# --------------------------------------------------------------------------- near copies


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def near_brute(rows):
    sets = {i: shingles(t) for i, t, *_ in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def near_rows(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df).collect()}


def variants(seed, n=220):
    """Near copies of a few texts with 0 to 12 words changed, so that similarities lie on both sides of the bar, and short texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    bases = [[word() for _ in range(r.choice([6, 9, 30, 80, 160]))] for _ in range(6)]
    rows = []
    for i in range(n):
        words = list(r.choice(bases))
        for _ in range(r.randint(0, max(1, len(words) // 12))):
            words[r.randrange(len(words))] = word()
        rows.append((i, (" " if r.random() < 0.5 else "\n\t").join(words)))
    return rows + [(n, None), (n + 1, ""), (n + 2, "one two"), (n + 3, "One  TWO"), (n + 4, "two one"), (n + 5, "ÉCOLE two"), (n + 6, "école two")]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_against_brute_force(docs, seed):
    rows = variants(seed)
    assert near_rows(docs(rows)) == near_brute(rows)


def test_near_clashing_columns_repeated_rows_and_empty(docs):
    rows = variants(3, 40)
    assert near_rows(docs(rows, CLASH)) == near_brute(rows)
    twice = docs(rows).unionAll(docs(rows))
    assert near_dedup.near_duplicates(twice).count() == 2 * len(rows)
    assert near_dedup.near_duplicates(docs([])).count() == 0
    kept = near_dedup.drop_near_copies(docs(rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, x in near_brute(rows).items() if x[2])


def test_late_links_join_components_of_one_bucket(docs, monkeypatch):
    """A chain whose neighbours link, in one hot bucket: stars to the smallest id alone would lose it."""
    r = random.Random(5)
    words = [f"w{r.randint(0, 9999)}" for _ in range(150)]
    rows = []
    for i in range(40):
        rows.append((i, " ".join(words)))
        for _ in range(2):
            words[r.randrange(150)] = f"n{i}{r.randint(0, 99)}"
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    assert near_rows(docs(rows)) == near_brute(rows)


def appended(seed, n):
    """Texts of 7 to 12 words, each followed by itself with one word more."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        words = [f"w{r.randrange(10**9)}" for _ in range(7 + i % 6)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words, "more"]))]
    return rows


def test_short_texts_with_one_word_appended(docs):
    """3 to 8 shingles and one more: similarities from 0.75 to 0.89, of which the estimate must not reject any."""
    rows = appended(7, 600) + [(5000, "a b c d e"), (5001, "a b c d e f"), (5002, "a b c d e f g"), (5003, "p q r s t u"), (5004, "p q r s t u v")]
    assert near_rows(docs(rows)) == near_brute(rows)


def test_empty_registers_borrow_independently():
    import numpy as np

    value, at = near_dedup.shingle_sets(pa.array(["a b c d e f g h", "a b c d e f g h i"]))
    regs = near_dedup.sketches(value, at)
    assert at[1] == 4 and (regs != 0xFFFF).all()
    bands = (regs[0, :128] == regs[1, :128]).reshape(32, 4).all(1)
    assert 3 <= bands.sum() <= 26
    shares = []
    for i in range(300):
        value, at = near_dedup.shingle_sets(pa.array([" ".join(f"{i}x{k}" for k in range(n)) for n in (7, 8)]))
        a, b = near_dedup.sketches(value, at)
        shares.append((a == b).mean())
    assert abs(np.mean(shares) - 0.75) < 0.02 and np.std(shares) < 0.07


def test_very_long_text(docs):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, long), (2, long.replace("w500 ", "x ")), (3, "w1 w2 w3 w4 w5 w6")]
    assert near_rows(docs(rows)) == near_brute(rows)


def test_estimate_is_unbiased_after_correction():
    import numpy as np

    r = np.random.default_rng(0)
    found = []
    for _ in range(200):
        pool = r.integers(0, 2**63, 900).astype(np.uint64)
        a, b = np.sort(pool[:600]), np.sort(pool[200:800])
        regs = near_dedup.sketches(np.concatenate([a, b]), np.array([0, 600, 1200]))
        found.append(near_dedup.estimate(regs[:1], regs[1:], np.array([600]), np.array([600]))[0])
    assert abs(np.mean(found) - 0.5) < 0.01
    assert np.std(found) < 0.05


def test_shingle_sets_equal_across_batches():
    texts = ["a b c d e f g", "x y", "", "A B C D E F G"]
    value, at = near_dedup.shingle_sets(pa.array(texts))
    one, _ = near_dedup.shingle_sets(pa.array(["a b c d e f g"]))
    assert list(at) == [0, 3, 4, 4, 7] and list(value[:3]) == list(one) == list(value[4:])


def test_exact_copies_without_id(docs):
    """Of equal lengths a row with doc_id stays before one without; a longer row without doc_id stays itself."""
    rows = [(None, "a b"), (3, "ab"), (None, "c d"), (4, "c d"), (None, "e"), (None, "e")]
    got = sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(docs(rows)).collect())
    assert got == sorted([("None", "None", 2, True), ("3", "None", 2, False), ("None", "4", 2, False), ("4", "4", 2, True), ("None", "None", 2, True), ("None", "None", 2, True)])


def _text(k, n=40):
    return " ".join(f"t{k}w{i}" for i in range(n))


def test_links_go_from_set_to_set_not_from_id_to_id(docs):
    """Rows of one doc_id with different texts: each has the links of its own text."""
    a, b = _text(1), _text(2)
    got = sorted(tuple(r) for r in near_dedup.near_duplicates(docs([(1, a), (1, b), (2, a + " x"), (3, b + " y"), (4, _text(3))])).collect())
    assert got == [(1, 36, 1, True), (1, 36, 1, True), (2, 37, 1, False), (3, 37, 1, False), (4, 36, 4, True)]
    got = sorted(tuple(r) for r in near_dedup.near_duplicates(docs([(5, a), (5, b), (2, a + " x"), (3, b + " y")])).collect())
    assert got == [(2, 37, 2, True), (3, 37, 3, True), (5, 36, 2, False), (5, 36, 3, False)]


def test_rows_without_id_take_no_part(docs):
    a = _text(1)
    df = docs([(None, a), (None, a), (7, a), (8, a + " x"), (None, None)], {"mark": F.lit("m"), "component_id": F.lit("c"), "set_id": F.lit(1)})
    got = sorted((tuple(r) for r in near_dedup.near_duplicates(df).collect()), key=str)
    assert got == [(7, 36, 7, True), (8, 37, 7, False), (None, 0, None, True), (None, 36, None, True), (None, 36, None, True)]
    left = near_dedup.drop_near_copies(df)
    assert left.columns == df.columns and sorted((str(r["doc_id"]) for r in left.collect())) == ["7", "None", "None", "None"]


def test_near_copies_that_go_are_rows_not_ids(docs):
    a, b = _text(1), _text(2)
    df = docs([(5, a), (5, b), (2, a + " x")])
    assert sorted((r["doc_id"], r["text"]) for r in near_dedup.drop_near_copies(df).collect()) == [(2, a + " x"), (5, b)]


def test_written_tables_go(spark, docs):
    import os

    from quillgraph.llm.common import shared_dir

    before = set(os.listdir(shared_dir(spark)))
    near_dedup.near_duplicates(docs([(1, _text(1)), (2, _text(1) + " x"), (3, _text(2))])).collect()
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(shared_dir(spark))) - before}
    assert left <= {"sketches", "labels"}  # what the lazy result reads; it goes when the JVM ends
