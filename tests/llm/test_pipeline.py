import corpus_pipeline
import pytest

from pyspark.sql import functions as F

from quillgraph.llm import packing, registry
from quillgraph.llm.common import table

SF = "/root/testdata/sf0.001"


def test_registry():
    numbers = sorted(int(name[2:].split("_")[0]) for name in registry.QUERIES)
    assert numbers == list(range(1, 14)) and set(registry.ORACLE) <= set(registry.QUERIES)


@pytest.fixture(scope="module")
def steps(spark):
    """What each stage gives, from what the one before it wrote."""
    from quillgraph.llm.common import cut

    docs, out = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, SF), name)
        out.append((name, docs))
    return out


def test_stages(spark, steps):
    from tests.llm.test_dedup import near_brute
    from tests.llm.test_search_tokens_packing import check_packing

    docs = table(spark, SF, "documents")
    assert [name for name, _ in steps] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    assert all(df.columns == docs.columns for _, df in steps[:-1])
    ids = {name: [r["doc_id"] for r in df.collect()] for name, df in steps[:-1]}
    toxic = {r["doc_id"] for r in table(spark, SF, "labels").where("toxic = 1").collect()}
    assert len(set(ids["toxicity"]) & toxic) <= 0.2 * len(toxic)
    clean = {r["doc_id"] for r in table(spark, SF, "labels").where("toxic = 0").collect()}
    assert len(set(ids["toxicity"]) & clean) >= 0.97 * len(clean)
    left = steps[1][1].collect()
    norm = ["".join((r["text"] or "").split()) for r in left]
    assert len(set(norm)) == len(norm)
    want = near_brute([(r["doc_id"], r["text"]) for r in left])
    assert sorted(ids["near_dedup"]) == sorted(i for i, x in want.items() if x[2])
    assert set(ids["mixing"]) <= set(ids["near_dedup"])
    pieces = steps[-1][1].collect()
    assert {p["doc_id"] for p in pieces} == set(ids["mixing"])
    once = {r["doc_id"]: r["text"] for r in steps[3][1].collect()}
    whole = {p["doc_id"]: p["doc_tokens"] for p in pieces}
    assert sum(p["length"] for p in pieces) == sum(whole[i] for i in ids["mixing"])
    assert set(once) == set(whole)
    once_each = [(r["doc_id"], r["text"]) for r in steps[2][1].collect()]
    packed = corpus_pipeline.STAGES[-1][1](spark, steps[2][1], SF).collect()
    check_packing(once_each, packed)
    loss = {}
    for p in packed:
        loss[p["sequence_id"]] = loss.get(p["sequence_id"], 0) + p["loss_tokens"]
    assert max(loss.values()) <= packing.INSTRUCTION[2]


CLASHES = ["size", "kept", "component_id", "mark", "score", "positions", "__id", "__mark", "__digest", "__size", "y", "predicted", "source_size", "key", "id"]


def test_stages_carry_clashing_columns_and_nulls(spark, docs):
    """Null texts, ids and sources, repeated rows and columns with the names that stages use inside."""
    words = " ".join(f"w{i}" for i in range(30))
    rows = [(1, words, "a"), (2, words + " x", "a"), (3, words, "b"), (3, words, "b"), (4, None, None), (None, "some words of no id", "a"), (5, "", "b"), (6, "quite another text with words", None)]
    now = docs(rows, {c: "clash" for c in CLASHES})
    columns = now.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.columns == columns, name
        assert {r["mark"] for r in now.collect()} <= {"clash"}
    ids = {r["doc_id"] for r in now.collect()}
    assert 1 in ids and not ids & {2, 3, 5}
    assert {p["doc_id"] for p in corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()} == ids


def test_stages_of_an_empty_table(spark, docs):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs([]).withColumn("size", F.lit(1)), SF).count() == 0, name
