import pytest
from pyspark.sql import functions as F

from quillgraph.functions.text import terms_of
from quillgraph.operators import retrieval as R
from quillgraph.operators import search as S


def ranked(entities, relations, task):
    rows = R.ranked(R.hybrid(entities, relations, task)).orderBy("rank").collect()
    return [(r["id"], round(r["score"], 6), round(r["text"], 6), r["structural"]) for r in rows]


def test_terms():
    assert terms_of("What depends on Auth?") == ["auth", "authentication", "depends"]


def test_postings_count_a_term_once_a_field(graph):
    got = {(r["term"], r["doc_id"]): r["weight"] for r in S.postings(S.documents(graph[0])).collect()}
    assert got["auth", "component:authentication"] == pytest.approx(7.75)
    assert got["login", "service:login-api"] == pytest.approx(6.75)
    assert got["api", "service:login-api"] == pytest.approx(7.25)


def test_only_terms_prunes_before_the_shuffle(graph):
    some = S.postings(S.documents(graph[0]), ["auth"]).collect()
    assert {r["term"] for r in some} == {"auth"}


def test_dependents(graph):
    got = ranked(*graph, "what depends on auth?")
    assert got == [("service:login-api", 25.756463, 5.756463, 20.0), ("component:authentication", 10.743781, 10.743781, 0.0)]
    assert [x[0] for x in ranked(*graph, "what depends upon auth?")][0] == "service:login-api"


def test_dependencies(graph):
    got = ranked(*graph, "what does login-api depend on?")
    assert got == [("component:authentication", 20.0, 0.0, 20.0), ("service:login-api", 12.82807, 12.82807, 0.0)]


def test_two_seeds_boost_only_the_target(spark, graph):
    edges = graph[1].withColumn("kind", F.lit("RELATES_TO"))
    got = {x[0]: x[3] for x in ranked(graph[0], edges, "login authentication")}
    assert got == {"component:authentication": 2.0, "service:login-api": 0.0}


def test_explanation(graph):
    rows = R.explanation(R.hybrid(*graph, "what depends on auth?")).where("id = 'service:login-api'").orderBy("position").collect()
    assert [(r["type"], r["role"], r["path_count"]) for r in rows] == [("text_match", "", 0), ("graph_path", "supports_task", 1), ("score_breakdown", "", 0)]


def test_down_rank(spark, graph):
    found = R.hybrid(*graph, "what depends on auth?")
    weak = spark.createDataFrame([("service:login-api", 0.3, "rejected", True)], "id string, composite double, fate string, stale boolean")
    rows = {r["id"]: r for r in R.down_ranked(found, weak).collect()}
    assert rows["service:login-api"]["score"] == pytest.approx(25.756463 * 0.4, abs=1e-5)
    assert rows["service:login-api"]["down_rank_note"] == "stale entity (composite=0.30, fate=rejected)"
    assert rows["component:authentication"]["down_rank_note"] is None


def test_ranks_of_many_ranges_run_on(spark):
    """Ranks are 1..n by (score, id) over every range, ties included, and no task sorts all rows."""
    df = spark.range(5000).select(F.format_string("n%05d", (F.col("id") * 7919) % 5000).alias("id"), (F.col("id") % 17).cast("double").alias("score"))
    got = [(r["rank"], r["id"], r["score"]) for r in R.ranked(df.repartition(6)).orderBy("rank").collect()]
    want = sorted(((r["id"], r["score"]) for r in df.collect()), key=lambda x: (-x[1], x[0]))
    assert got == [(k, *x) for k, x in enumerate(want, 1)]
    assert R.ranked(df.limit(0)).isEmpty()
    assert "SinglePartition" not in R.ranked(df)._jdf.queryExecution().toString()


@pytest.mark.parametrize("task", ["auth", "authentication", "log login api2", "red", "the of", "", "io"])
def test_search_by_pattern_equals_search_by_postings(spark, graph, task):
    texts = ["Auth-Token", "authentications", "logins & Login", "API2 api", "shared RED_red", "İO io", "éred red2", None, "red"]
    rows = spark.createDataFrame([(f"d{i}", t, i) for i, t in enumerate(texts)], "id string, t string, i int")
    e = rows.select(*[F.col("id") if c == "id" else F.col("t").alias(c) if c in ("title", "content") else F.array("t", F.upper("t"), F.lit(" x ")).alias(c) if c == "tags" else F.to_json(F.struct(F.array("t").alias("aliases"))).alias(c) if c == "props_json" else F.lit(None).cast("string").alias(c) for c in graph[0].columns])
    asked = terms_of(task)
    want = {}
    for p in S.postings(S.documents(e)).collect():
        if p["term"] in asked:
            want.setdefault(p["doc_id"], [0.0] * len(asked))[asked.index(p["term"])] = p["weight"]
    assert {r["doc_id"]: r["weights"] for r in S.matches(e, asked).collect()} == want


def test_pages_of_a_query(spark, graph, tmp_path):
    from quillgraph.api import Engine

    e = Engine(spark, f"file://{tmp_path}")
    e.store.write(*graph, {"agent_id": "a", "session_id": "s", "timestamp": "2026-01-01T00:00:00Z"})
    whole = e.query("what depends on auth?")["result"]
    pages = [e.query("what depends on auth?", after=k, most=1)["result"] for k in range(3)]
    assert [r["id"] for p in pages for r in p["results"]] == [r["id"] for r in whole["results"]] and {p["total"] for p in pages} == {2}
    assert {r["id"] for r in e.explain("what depends on auth?", after=1, most=1)["result"]["reasons"]} == {whole["results"][1]["id"]}


@pytest.mark.parametrize("wanted", ["none", "dependents", "dependencies"])
def test_expansion_from_both_clusterings_equals_that_from_one_table(spark, wanted):
    import random

    r = random.Random(4)
    nodes = [f"n{i}" for i in range(20)]
    rows = sorted({(r.choice(nodes), r.choice(["DEPENDS_ON", "depends_on", "ABOUT"]), r.choice(nodes)) for _ in range(120)})
    edges = spark.createDataFrame(rows, "from_id string, kind string, to_id string")
    seeds = spark.createDataFrame([(n,) for n in nodes[:6]], "id string")
    rows_of = lambda df: sorted(map(tuple, df.collect()))
    assert rows_of(R.expand(edges, seeds, wanted, edges)) == rows_of(R.expand(edges, seeds, wanted)) != []
