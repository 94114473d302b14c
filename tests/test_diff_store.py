import pytest
from pyspark.sql import functions as F

from quillgraph.operators import diff as D
from quillgraph.sources.store import Graph, Store, StoreError

META = {"agent_id": "a", "session_id": "s", "timestamp": "2026-01-01T00:00:00Z"}


def edges(spark, rows):
    return spark.createDataFrame([(*r, None) for r in rows], "from_id string, kind string, to_id string, props_json string")


def test_diff_of_equal_graphs_is_empty(graph):
    assert D.diff_entities(graph[0], graph[0]).isEmpty()
    assert D.diff_relations(graph[1], graph[1]).isEmpty()


def test_retag_wins_over_update(graph):
    after = graph[0].withColumn("kind", F.lit("X")).withColumn("title", F.lit("new"))
    rows = D.diff_entities(graph[0], after).collect()
    assert {(r["change"], r["changed_fields"]) for r in rows} == {("retagged", "kind,title")}


def test_relation_retag_needs_one_on_each_side(spark):
    one = D.diff_relations(edges(spark, [("a", "PART_OF", "b")]), edges(spark, [("a", "DEPENDS_ON", "b")])).collect()
    assert [(r["change"], r["kind_before"], r["kind_after"]) for r in one] == [("retagged", "PART_OF", "DEPENDS_ON")]
    two = D.diff_relations(edges(spark, [("a", "PART_OF", "b")]), edges(spark, [("a", "DEPENDS_ON", "b"), ("a", "RELATES_TO", "b")])).collect()
    assert sorted((r["change"], r["kind_before"], r["kind_after"]) for r in two if r["change"] == "removed") == [("removed", "PART_OF", None)]
    assert sorted(r["kind_after"] for r in two if r["change"] == "added") == ["DEPENDS_ON", "RELATES_TO"]


def test_relations_meet_in_one_grouping(spark):
    """Neither side is sorted or joined; properties that differ are an update, repeated relations count once."""
    full = lambda rows: spark.createDataFrame(rows, "from_id string, kind string, to_id string, props_json string")
    before = full([("a", "R", "b", '{"x":1,"y":2}'), ("a", "R", "c", None), ("a", "R", "c", "{}"), ("a", "R", "d", '{"x":1}')])
    found = D.diff_relations(before, full([("a", "R", "b", '{"y":2,"x":1}'), ("a", "R", "c", " "), ("a", "R", "d", '{"x":2}')]))
    assert [(r["to_id"], r["change"], r["kind_before"], r["kind_after"]) for r in found.collect()] == [("d", "updated", "R", "R")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "SortAggregate" not in plan


def test_blank_null_and_empty_props_are_equal(spark, graph):
    after = graph[0].withColumn("props_json", F.coalesce("props_json", F.lit("{}")))
    assert D.diff_entities(graph[0], after).isEmpty()


def test_store_round_trip(spark, graph, tmp_path):
    store = Store(spark, f"file://{tmp_path}/g")
    assert store.graph().entities.count() == 0
    first = store.write(*graph, META)
    assert first["nodes"] == {"created": 3} and first["relationships"] == {"created": 1}
    again = store.write(*graph, META | {"timestamp": "2026-01-02T00:00:00Z"})
    assert again["nodes"] == {"updated": 3}
    row = store.graph().entities.where("id = 'service:billing'").head()
    assert (row["created_at"], row["updated_at"]) == ("2026-01-01T00:00:00Z", "2026-01-02T00:00:00Z")
    changed = graph[0].where("id = 'service:billing'").withColumn("title", F.lit("Billing"))
    third = store.write(changed, graph[1].limit(0), META | {"timestamp": "2026-01-03T00:00:00Z"})
    nodes, links = store.diff(first["revision"]["id"], third["revision"]["id"])
    assert [(r["id"], r["change"], r["changed_fields"]) for r in nodes.collect()] == [("service:billing", "updated", "title")]
    assert links.isEmpty() and store.current_revision()["id"] == third["revision"]["id"]
    with pytest.raises(StoreError) as e:
        store.diff("nope", third["revision"]["id"])
    assert e.value.code == "revision_anchor_not_found"


def test_failed_write_changes_nothing(spark, graph, tmp_path):
    store = Store(spark, f"file://{tmp_path}/g")
    store.write(*graph, META)
    lost = edges(spark, [("service:billing", "DEPENDS_ON", "ghost")])
    with pytest.raises(StoreError) as e:
        store.write(graph[0].limit(0), lost, META)
    assert e.value.code == "unresolved_relationship_endpoint"
    assert store.graph().relations.count() == 1 and store.revisions().count() == 1


def test_replace(spark, graph, tmp_path):
    store = Store(spark, f"file://{tmp_path}/g")
    store.write(*graph, META)
    now = store.graph()
    assert store.replace(now, META)["revision"] is None
    target = Graph(now.entities.where("id <> 'service:billing'"), now.relations)
    assert store.replace(target, META)["nodes"] == {"removed": 1}
    assert store.graph().entities.count() == 2


def test_two_writers_from_one_version(spark, graph, tmp_path, monkeypatch):
    """The second of two writers that began from one version is refused; the first's write stays whole."""
    store, other = Store(spark, f"file://{tmp_path}/g"), Store(spark, f"file://{tmp_path}/g")
    store.write(*graph, META)
    commit = Store._commit

    def slow(self, *args):
        monkeypatch.setattr(Store, "_commit", commit)
        other.write(graph[0].where("id = 'service:billing'").withColumn("title", F.lit("First")), graph[1].limit(0), META)
        return commit(self, *args)

    monkeypatch.setattr(Store, "_commit", slow)
    with pytest.raises(StoreError) as e:
        store.write(graph[0].where("id = 'service:billing'").withColumn("title", F.lit("Second")), graph[1].limit(0), META)
    assert e.value.code == "concurrent_write"
    assert store.graph().entities.where("id = 'service:billing'").head()["title"] == "First" and store.revisions().count() == 2


@pytest.mark.parametrize("step", ["entity", "relation", "revision", "pointer"])
def test_a_write_that_dies_between_steps_changes_nothing(spark, graph, tmp_path, monkeypatch, step):
    from pyspark.sql.readwriter import DataFrameWriter

    from quillgraph.sources import files

    store = Store(spark, f"file://{tmp_path}/g")
    store.write(*graph, META)
    parquet, text = DataFrameWriter.parquet, files.write_text

    def die(self, path, *args, **named):
        if path.endswith(f"/{step}"):
            raise RuntimeError("killed")
        return parquet(self, path, *args, **named)

    def die_too(spark_, path, *args, **named):
        if step == "pointer":
            raise RuntimeError("killed")
        return text(spark_, path, *args, **named)

    monkeypatch.setattr(DataFrameWriter, "parquet", die)
    monkeypatch.setattr(files, "write_text", die_too)
    with pytest.raises(RuntimeError):
        store.write(graph[0].limit(1).withColumn("title", F.lit("X")), graph[1].limit(0), META)
    monkeypatch.undo()
    again = Store(spark, f"file://{tmp_path}/g")
    assert again.graph().entities.where("title = 'X'").isEmpty() and again.revisions().count() == 1
    assert again.write(graph[0].limit(1), graph[1].limit(0), META)["nodes"]["updated"] == 1


def test_small_files_are_whole_or_absent(spark, tmp_path):
    from quillgraph.sources import files

    at = f"file://{tmp_path}/d/x.json"
    assert files.read_text(spark, at) is None
    files.write_text(spark, at, "one é")
    files.write_text(spark, at, "two")
    assert files.read_text(spark, at) == "two"
    with pytest.raises(files.Taken):
        files.write_text(spark, at, "three", replace=False)
    assert files.read_text(spark, at) == "two" and [p.name for p in (tmp_path / "d").iterdir() if not p.name.startswith(".")] == ["x.json"]


def test_relations_without_an_end_are_not_returned(spark, graph, tmp_path):
    store = Store(spark, f"file://{tmp_path}/g")
    store.write(*graph, META)
    version = store._pointer()
    store._read(version, "relation", store.graph().relations.schema).withColumn("to_id", F.lit("ghost")).write.mode("append").parquet(f"{store.base}/{version}/relation")
    assert [r["to_id"] for r in store.graph().relations.collect()] == ["component:authentication"]


def test_snapshot_checks_both_counts(spark, graph, tmp_path):
    store = Store(spark, f"file://{tmp_path}/g")
    row = store.write(*graph, META)["revision"]
    assert store.snapshot(row["id"]).relations.count() == 1
    store._read(row["id"][4:], "relation", store.graph().relations.schema).withColumn("kind", F.lit("MORE")).write.mode("append").parquet(f"{store.base}/{row['id'][4:]}/relation")
    with pytest.raises(StoreError) as e:
        store.snapshot(row["id"])
    assert e.value.code == "revision_snapshot_unavailable"


# ---------------------------------------------------------------- layout and change tables


def _plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.fixture(scope="module")
def history(spark, graph, tmp_path_factory):
    """Five revisions: written, retitled and linked anew, one removed, one back with another tag, everything written again."""
    store = Store(spark, f"file://{tmp_path_factory.mktemp('history')}/h")
    at = lambda day: META | {"timestamp": f"2026-01-0{day}T00:00:00Z"}
    ids = [store.write(*graph, at(1))["revision"]["id"]]
    more = edges(spark, [("service:billing", "DEPENDS_ON", "component:authentication"), ("service:login-api", "RELATES_TO", "service:billing")])
    ids.append(store.write(graph[0].where("id = 'service:billing'").withColumn("title", F.lit("Billing")), more, at(2))["revision"]["id"])
    now = store.graph()
    ids.append(store.replace(Graph(now.entities.where("id <> 'service:billing'"), now.relations), at(3))["revision"]["id"])
    back = graph[0].where("id = 'service:billing'").withColumn("tags", F.array(F.lit("money"), F.lit("payments ")))
    moved = edges(spark, [("service:login-api", "PART_OF", "component:authentication")])
    ids.append(store.write(back, moved, at(4))["revision"]["id"])
    ids.append(store.write(*graph, at(5))["revision"]["id"])
    return store, ids


def test_differences_from_changes_equal_those_of_snapshots(history, monkeypatch):
    store, ids = history
    rows = lambda dfs: [sorted(tuple(r) for r in df.collect()) for df in dfs]
    pairs = [(ids[a], ids[b]) for a, b in ((0, 4), (4, 0), (1, 3), (2, 2), (3, 4), (2, 1))]
    by_changes = [rows([*store.diff(a, b), store.diff_tags(a, b).selectExpr("id", "change", "array_join(tags_added, ',')", "array_join(tags_removed, ',')")]) for a, b in pairs]
    monkeypatch.setattr(Store, "_changes_between", lambda *_: None)
    by_snapshots = [rows([*store.diff(a, b), store.diff_tags(a, b).selectExpr("id", "change", "array_join(tags_added, ',')", "array_join(tags_removed, ',')")]) for a, b in pairs]
    assert by_changes == by_snapshots
    assert any(x[2] and x[2][0][2] == "money" for x in by_changes)


def test_a_difference_reads_no_snapshot(history):
    store, ids = history
    for df in store.diff(ids[0], ids[4]):
        plan = _plan(df)
        assert "/changes/" in plan and "/entity]" not in plan.replace("/changes/entity", "") and "Bucketed" not in plan
    kept, moved = (store._path(f"{store.base}/{ids[2][4:]}/{name}") for name in ("changes", "elsewhere"))
    store._fs.rename(kept, moved)
    try:
        assert "/changes/" not in _plan(store.diff(ids[0], ids[4])[0]) and store.diff(ids[3], ids[4])[0].count() == 1
    finally:
        store._fs.rename(moved, kept)


def test_a_revision_names_what_it_touched(history):
    store, ids = history
    third = store.revision(ids[2])
    assert third["touched_nodes"]["removed"] == ["service:billing"] and third["touched_nodes"]["n_updated"] == 0
    assert third["touched_edges"]["removed"] == ["service:billing DEPENDS_ON component:authentication", "service:login-api RELATES_TO service:billing"]
    assert (third["node_count"], third["edge_count"], third["number"]) == (2, 1, 3)
    second = store.revision(ids[1])
    assert second["touched_nodes"]["updated"] == ["service:billing"] and second["touched_edges"]["n_created"] == 2
    nodes, links = store.touched(ids[4])
    assert {r["change"] for r in nodes.collect()} == {"updated"} and nodes.count() == 3 and links.count() == 1
    assert sorted(r["id"] for r in store.changed_since(ids[2][4:]).collect()) == ["component:authentication", "service:billing", "service:login-api"]
    assert store.changed_since(ids[4][4:]).isEmpty() and store.changed_since("unknown") is None


def test_many_touched_ids_are_counted_and_listed_in_part(spark, graph, tmp_path, monkeypatch):
    from quillgraph.sources import store as module

    monkeypatch.setattr(module, "MOST_TOUCHED", 2)
    store = Store(spark, f"file://{tmp_path}/g")
    row = store.write(*graph, META)["revision"]
    assert row["touched_nodes"]["created"] == ["component:authentication", "service:billing"] and row["touched_nodes"]["n_created"] == 3
    assert store.touched(row["id"])[0].count() == 3


def test_stored_tables_are_joined_where_they_lie(spark, graph, history):
    store, _ = history
    now = store.graph()
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" not in _plan(now.relations) and "Bucketed: true" in _plan(now.relations.join(now.entities.withColumnRenamed("id", "from_id"), "from_id"))
        for side, key in ((now.relations, "from_id"), (now.incoming, "to_id")):
            assert "Exchange" not in _plan(side.join(now.entities.withColumnRenamed("id", key), key, "left_semi"))
        plan = _plan(D.upsert(now.entities, graph[0].where("title <> 'x'").select(*now.entities.columns), ["id"]))
        assert "hashpartitioning(n_id" in plan and "hashpartitioning(o_id" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert sorted(map(tuple, now.incoming.select("from_id", "kind", "to_id").collect())) == sorted(map(tuple, now.relations.select("from_id", "kind", "to_id").collect()))


def test_replace_takes_relations_once_and_with_both_ends(spark, graph, tmp_path):
    store = Store(spark, f"file://{tmp_path}/g")
    store.write(*graph, META)
    now = store.graph()
    lost = now.relations.withColumn("to_id", F.lit("ghost"))
    more = now.relations.withColumn("kind", F.lit("PART_OF"))
    done = store.replace(Graph(now.entities, now.relations.unionByName(lost).unionByName(more).unionByName(more)), META)
    assert done["relationships"] == {"created": 1} and done["revision"]["edge_count"] == 2 and store.graph().relations.count() == 2


def test_buckets_grow_with_the_rows(spark, graph, tmp_path, monkeypatch):
    from quillgraph.sources import store as module

    store = Store(spark, f"file://{tmp_path}/g")
    store.write(*graph, META)
    assert store._layout(store._pointer())["buckets"] == module.LEAST_BUCKETS
    monkeypatch.setattr(module, "BUCKET_ROWS", 1)
    many = graph[0].limit(1).drop("id").crossJoin(spark.range(40).select(F.format_string("x:%d", "id").alias("id")))
    store.write(many.select(*graph[0].columns), graph[1].limit(0), META)
    assert store._layout(store._pointer())["buckets"] == 43 and store.graph().entities.count() == 43
    assert store.graph().incoming.count() == 1 and store.graph().relations.count() == 1


def test_an_empty_store_is_joined_with_nothing(spark, graph, tmp_path):
    """A first write passes its rows through: no join, so no shuffle for one."""
    now = Store(spark, f"file://{tmp_path}/empty").graph()
    met = D.upsert(now.entities, graph[0], ["id"])
    assert "Join" not in met._jdf.queryExecution().optimizedPlan().toString()
    assert {r["change"] for r in met.collect()} == {"created"}
