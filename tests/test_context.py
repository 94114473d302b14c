import pytest

from quillgraph.operators import context as C
from quillgraph.operators.blinding import sanitized
from quillgraph.operators.seed import cut_bytes, summarize_markdown, yaml_scalar


def result(rank=1, refs=(), summary="one two three four five six seven eight nine ten"):
    return {"rank": rank, "score": 12.5, "id": f"n:{rank}", "kind": "Service", "title": "T", "summary": summary, "matched_terms": ["alpha", "beta"], "graph_refs": list(refs), "created_by": "dev", "created_at": "2026-01-01T00:00:00Z"}


def ref(kind, direction, a="n:1", b="n:2"):
    return {"kind": kind, "direction": direction, "from_id": a, "to_id": b}


def test_estimate_counts_keys_and_number_parts():
    assert C.estimate({"score": 12.5}) == 3
    assert C.estimate({"a": "<"}) == 2
    assert C.render({"s": 20.0, "t": 0.1}) == '{"s":20,"t":0.1}'


def test_tight_budget_keeps_relations_and_drops_the_summary():
    r = result(refs=[ref("DEPENDS_ON", "supports_task")], summary="word " * 200)
    whole, used = C.pack_one(r, 60)
    assert whole["relationships"] and whole["provenance"]["created_by"] == "dev" and used <= 60
    assert len(whole["entity"].get("summary", "").split()) < 200


def test_no_relation_is_taken_past_one_that_does_not_fit():
    big = ref("K " * 80, "supports_task")
    packed, used = C.pack_one(result(refs=[big, ref("SMALL", "incoming_neighbor")]), 40)
    assert "relationships" not in packed and packed["omitted_relationships"] == 2 and used <= 40


@pytest.mark.parametrize("budget", [5, 30, 60, 120, 1000])
def test_pack_stays_within_its_budget(budget):
    out = C.pack([result(i) for i in range(1, 9)], budget)
    assert out["estimated_tokens"] <= budget
    assert len(out["results"]) + out["omitted_results"] == 8
    assert [x["rank"] for x in out["results"]] == list(range(1, len(out["results"]) + 1))


def test_budget_must_be_positive():
    with pytest.raises(ValueError):
        C.pack([], 0)


def test_blinding_is_recursive():
    assert sanitized({"a": [{"condition_id": 1, "b": 2}], "workflow_mode": "x"}) == {"a": [{"b": 2}]}


def test_markdown():
    text = "intro\n\n# Title\n\nFirst para\nmore.\n\n```\ncode\n```\n\n> Second."
    assert summarize_markdown(text) == ("Title", "intro", "intro First para more.")
    assert cut_bytes("é" * 10, 9) == "ééé..."
    assert yaml_scalar("a: 1\nname: 'x y'\n", "name") == "x y"


def test_excerpt_equals_its_python_form(spark):
    from pyspark.sql import functions as F

    from quillgraph.functions.text import excerpt

    texts = ["é" * 10, "a" * 30, "ab  cd\n", "日本語" * 5, "", "x é日" * 9]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", excerpt(F.col("t"), 20).alias("e")).collect()
    assert [r["e"] for r in rows] == [cut_bytes(t, 20) for t in texts]


def test_packing_by_groups_equals_packing_one_by_one(spark):
    """Random results of several groups, packed in parallel and by the plain loop over each group."""
    import random

    from quillgraph.operators import context as C

    r = random.Random(8)
    word = lambda n: " ".join(r.choice(["alpha", "beta é", "x<y", "42", "a_b"]) for _ in range(n))
    ref = lambda i: {"kind": r.choice("AB"), "from_id": f"n{i}", "to_id": f"n{r.randint(0, 9)}", "direction": r.choice([*C.PRIORITY, "other"])}
    rows = []
    for group in ("g1", "g2", "g3"):
        for rank in range(1, r.randint(4, 12)):
            refs = [ref(rank) for _ in range(r.randint(0, 4))]
            rows.append((group, rank, r.choice([0.5, 2.0, 1e-7]), f"n{rank}", "K", word(r.randint(0, 4)), word(r.randint(0, 30)), [word(1)] * r.randint(0, 2), refs, "2026", None, "me", None, "s", None))
    refs = "array<struct<kind:string,from_id:string,to_id:string,direction:string>>"
    schema = f"g string, rank int, score double, id string, kind string, title string, summary string, matched_terms array<string>, graph_refs {refs}, created_at string, updated_at string, created_by string, updated_by string, created_session_id string, updated_session_id string"
    df = spark.createDataFrame(rows, schema)
    got = {}
    for x in C.pack_groups(df, "g", 120).orderBy("rank").collect():
        got.setdefault(x["g"], []).append((x["id"], x["packed"], x["tokens"]))
    names = [c.split()[0] for c in schema.replace(refs, "x").split(", ")]
    for group in ("g1", "g2", "g3"):
        whole = C.pack([dict(zip(names, row)) for row in rows if row[0] == group], 120)
        assert [C.render(x) for x in whole["results"]] == [p for _, p, _ in got[group]]
        assert whole["estimated_tokens"] == sum(t for *_, t in got[group]) <= 120
