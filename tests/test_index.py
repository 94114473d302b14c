import os
import shutil

import pytest
from pyspark.sql import functions as F

from quillgraph.api import Engine
from quillgraph.operators.search import search_entities
from quillgraph.sources.files import read_text, write_text
from quillgraph.sources.index import TextIndex
from quillgraph.sources.store import StoreError


def test_states_of_the_index(spark, graph, tmp_path):
    """Missing and stale ones are built, an equal one is ready, a corrupt one is an error and stays."""
    index = TextIndex(spark, f"file://{tmp_path}/index")
    assert index.load() is None
    meta, status = index.ensure(graph[0])
    assert (status, meta["document_count"]) == ("rebuilt", 3)
    assert index.ensure(graph[0])[1] == "ready"
    changed = graph[0].withColumn("title", F.concat("title", F.lit(" zebra")))
    again, status = index.ensure(changed)
    assert status == "rebuilt" and again["anchor"] != meta["anchor"] and index.search(again, "zebra").count() == 3
    for text in ("{", "[]", '{"schema_version": "v1"}', '{"schema_version": "v9", "folder": "x", "document_count": 1, "anchor": "a"}'):
        write_text(spark, f"{index.base}/index.json", text)
        with pytest.raises(StoreError) as e:
            index.ensure(graph[0])
        assert e.value.code == "text_index_corrupt" and read_text(spark, f"{index.base}/index.json") == text


def test_a_wrong_count_is_corrupt(spark, graph, tmp_path):
    index = TextIndex(spark, f"file://{tmp_path}/index")
    meta, _ = index.ensure(graph[0])
    graph[0].select("id").limit(1).write.mode("append").parquet(f"{index.base}/{meta['folder']}/documents")
    with pytest.raises(StoreError) as e:
        index.ensure(graph[0])
    assert e.value.code == "text_index_corrupt"


def test_search_by_index_equals_search_by_scan(spark, graph, tmp_path):
    index = TextIndex(spark, f"file://{tmp_path}/index")
    meta, _ = index.ensure(graph[0])
    for task in ("what depends on auth?", "billing platform", "the of", ""):
        rows = lambda df: sorted((r["doc_id"], round(r["score"], 9), r["matched_terms"]) for r in df.collect())
        assert rows(index.search(meta, task)) == rows(search_entities(graph[0], task))


def test_query_says_the_status(spark, graph, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}")
    engine.store.write(*graph, {"agent_id": "a", "session_id": "s", "timestamp": "2026-01-01T00:00:00Z"})
    first, second = engine.query("what depends on auth?"), engine.query("what depends on auth?")
    assert [x["result"]["index"]["status"] for x in (first, second)] == ["rebuilt", "ready"]
    assert first["result"]["results"] == second["result"]["results"]
    write_text(spark, f"file://{tmp_path}/index/index.json", "broken")
    assert engine.query("auth")["error"]["code"] == "text_index_corrupt"


@pytest.mark.parametrize("lost", ["postings", "documents", "struck", ""])
def test_lost_files_are_corrupt(spark, graph, tmp_path, lost):
    """An index without its postings never answers "ready" with no results."""
    engine = Engine(spark, f"file://{tmp_path}")
    engine.store.write(*graph, {"agent_id": "a", "session_id": "s", "timestamp": "2026-01-01T00:00:00Z"})
    assert engine.query("auth")["result"]["index"]["status"] == "rebuilt"
    shutil.rmtree(os.path.join(tmp_path, "index", engine.index.load()["folder"], lost))
    told = engine.query("auth")
    assert told["status"] == "error" and told["error"]["code"] == "text_index_corrupt"


def _rows(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


def test_a_refresh_tokenises_what_changed_alone(spark, graph, tmp_path, monkeypatch):
    from quillgraph.sources import index as module

    index = TextIndex(spark, f"file://{tmp_path}/index")
    index.ensure(graph[0])
    asked = []
    monkeypatch.setattr(module, "postings", lambda docs, f=module.postings: (asked.append(sorted(r["id"] for r in docs.select("id").collect())), f(docs))[1])
    retitled = graph[0].withColumn("title", F.when(F.col("id") == "service:billing", F.lit("Zebra desk")).otherwise(F.col("title")))
    later = retitled.where("id <> 'component:authentication'").unionByName(graph[0].limit(1).withColumn("id", F.lit("new:one")))
    meta, status = index.ensure(later)
    assert (status, meta["tokenised"], meta["document_count"], len(meta["segments"])) == ("rebuilt", 2, 3, 2)
    assert asked == [["new:one", "service:billing"]]
    fresh = TextIndex(spark, f"file://{tmp_path}/fresh")
    want, _ = fresh.ensure(later)
    assert _rows(index.postings(meta)) == _rows(fresh.postings(want)) and meta["anchor"] == want["anchor"]
    for task in ("zebra", "authentication platform", "invoices"):
        assert _rows(index.search(meta, task).withColumn("matched_terms", F.array_join("matched_terms", ","))) == _rows(fresh.search(want, task).withColumn("matched_terms", F.array_join("matched_terms", ",")))


def test_segments_are_folded_and_old_folders_go(spark, graph, tmp_path, monkeypatch):
    from quillgraph.sources import index as module

    monkeypatch.setattr(module, "MOST_SEGMENTS", 2)
    index = TextIndex(spark, f"file://{tmp_path}/index")
    index.ensure(graph[0])
    for word in ("one", "two", "three", "four"):
        now = graph[0].withColumn("title", F.when(F.col("id") == "service:billing", F.lit(word)).otherwise(F.col("title")))
        meta, status = index.ensure(now)
        assert (status, meta["tokenised"]) == ("rebuilt", 1)
        assert [r["doc_id"] for r in index.search(meta, word).collect()] == ["service:billing"]
    assert index.search(meta, "one").isEmpty() and len(meta["segments"]) <= 2
    assert index.ensure(now)[1] == "ready"
    held = [n for n in os.listdir(tmp_path / "index") if not n.startswith((".", "index.json"))]
    assert set(held) == {s["folder"] for s in meta["segments"]} | set(meta["previous"])
    back, status = index.ensure(graph[0].limit(0))
    assert (status, back["document_count"]) == ("rebuilt", 0) and index.search(back, "auth").isEmpty()


def test_a_write_is_brought_in_by_its_change_table(spark, graph, tmp_path, monkeypatch):
    from quillgraph.sources import index as module

    engine = Engine(spark, f"file://{tmp_path}")
    meta = {"agent_id": "a", "session_id": "s", "timestamp": "2026-01-01T00:00:00Z"}
    engine.store.write(*graph, meta)
    engine.query("auth")
    engine.store.write(graph[0].where("id = 'service:billing'").withColumn("title", F.lit("Zebra desk")), graph[1].limit(0), meta)
    seen = []
    monkeypatch.setattr(module, "documents", lambda e, f=module.documents: (seen.append(sorted(r["id"] for r in e.select("id").collect())), f(e))[1])
    told = engine.query("zebra")["result"]
    assert told["index"]["status"] == "rebuilt" and [r["id"] for r in told["results"]] == ["service:billing"]
    assert seen == [["service:billing"]]
    assert engine.query("zebra")["result"]["index"]["status"] == "ready" and len(seen) == 1
