"""The versioned store: immutable, clustered Parquet versions behind numbered pointers.

A write builds a whole new version beside the old ones and then adds the pointer with the
next number, by one rename that fails if there is such a pointer (the base must be on a
file system whose rename is atomic, which object stores do not give by themselves).
Pointers are never changed or deleted and the highest one counts, so readers see a version
or the next, a write that ends before its rename changes nothing, and of two writers that
began from one version the second is told that the graph has changed.

A version is five tables. Entities are bucketed by id, relations by from_id, and their keys
once more by to_id, so that joins on an end, upserts and snapshots shuffle only what they are
joined with. A commit holds that keys are unique and that both ends of a relation are
entities; reads rely on it as long as a version's files are those that its layout file names,
and else read defensively. The changes that a version made to the one before it, with the
comparable fields of both sides, are tables of their own: a difference of two revisions folds
the changes between them and reads no snapshot.
All file operations go through Hadoop's file system of the base path.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import canonical_json
from ..operators import diff as D
from . import files

ENTITY = (
    "id string, kind string, title string, summary string, content string, repo_path string, language string, tags array<string>, props_json string, "
    "created_at string, updated_at string, created_by string, updated_by string, created_session_id string, updated_session_id string"
)
RELATION = (
    "from_id string, kind string, to_id string, props_json string, "
    "created_at string, updated_at string, created_by string, updated_by string, created_session_id string, updated_session_id string"
)
INCOMING = "to_id string, kind string, from_id string"
#: Ids (for relations: from kind to) of a revision by what was done to them, sorted, at most MOST_TOUCHED of each; the counts are of all.
TOUCHED = "struct<created: array<string>, updated: array<string>, removed: array<string>, n_created: long, n_updated: long, n_removed: long>"
REVISION = (
    "id string, anchor string, reason string, node_count long, edge_count long, created_at string, created_by string, created_session_id string, "
    f"number long, touched_nodes {TOUCHED}, touched_edges {TOUCHED}"
)
EDGE_KEY = ["from_id", "kind", "to_id"]
MOST_TOUCHED = 1000
#: Rows of the larger table for each bucket, and the least number of buckets; a version with four times as many rows as its buckets are for is dealt anew.
BUCKET_ROWS, LEAST_BUCKETS = 2_000_000, 8
_CLUSTERED = {"entity": ("id", ENTITY), "relation": ("from_id", RELATION), "incoming": ("to_id", INCOMING)}
_COMPARED = {"entity": ["kind", "title", "summary", "content", "repo_path", "language", "tags", "props_json"], "relation": ["props_json"]}
_KEYS = {"entity": ["id"], "relation": EDGE_KEY}


def _change_schema(record: str) -> str:
    sides = [f"{p}{c} string" for p in ("b_", "a_") for c in _COMPARED[record]]
    return ", ".join([*(f"{k} string" for k in _KEYS[record]), "change string", *sides, "b_here boolean, a_here boolean, number long"])


class StoreError(ValueError):
    """A failure with a code that callers can test."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass
class Graph:
    """Entities and relations; a stored graph also has the keys of its relations clustered by to_id."""

    entities: DataFrame
    relations: DataFrame
    incoming: DataFrame | None = None


class Store:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = files.file_system(spark, self.base)

    # ---------------------------------------------------------------- pointer

    def _last(self) -> int:
        """Number of the highest pointer; 0 if nothing has been written."""
        root = self._path(f"{self.base}/pointers")
        if not self._fs.exists(root):
            return 0
        names = [f.getPath().getName() for f in self._fs.listStatus(root)]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def _version(self, number: int) -> str | None:
        return files.read_text(self.spark, f"{self.base}/pointers/{number:012d}") if number else None

    def _pointer(self) -> str | None:
        return self._version(self._last())

    def _swap(self, version: str, after: int) -> None:
        try:
            files.write_text(self.spark, f"{self.base}/pointers/{after + 1:012d}", version, replace=False)
        except files.Taken:
            raise StoreError("concurrent_write", "another writer changed the graph meanwhile; nothing was written") from None

    def _exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def _read(self, version: str | None, name: str, schema: str) -> DataFrame:
        if version is None or not self._exists(f"{self.base}/{version}/{name}"):
            return self.spark.createDataFrame([], schema).where(F.lit(False))  # the optimizer leaves out joins with it
        return self.spark.read.schema(schema).parquet(f"{self.base}/{version}/{name}")

    # ---------------------------------------------------------------- layout

    def _listed(self, version: str) -> str:
        """A digest of the names and lengths of a version's data files, from listings alone."""
        seen = []
        for name in _CLUSTERED:
            if self._exists(f"{self.base}/{version}/{name}"):
                found = self._fs.listStatus(self._path(f"{self.base}/{version}/{name}"))
                seen += sorted(f"{name}/{f.getPath().getName()} {f.getLen()}" for f in found if not f.getPath().getName().startswith((".", "_")))
        return hashlib.sha256("\n".join(seen).encode()).hexdigest()

    def _layout(self, version: str | None) -> dict | None:
        """A version's layout file, if its data files are those that were committed."""
        text = files.read_text(self.spark, f"{self.base}/{version}/layout.json") if version else None
        layout = json.loads(text) if text else None
        return layout if layout and layout["files"] == self._listed(version) else None

    @staticmethod
    def _name(version: str, table: str) -> str:
        return f"quillgraph_{version}_{table}"

    def _clustered(self, version: str, table: str, buckets: int) -> DataFrame:
        """A committed table of a version, declared with its buckets."""
        key, schema = _CLUSTERED[table]
        name = self._name(version, table)
        at = f"{self.base}/{version}/{table}"
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet CLUSTERED BY ({key}) INTO {buckets} BUCKETS LOCATION '{at}'")
        return self.spark.table(name)

    def _write_clustered(self, df: DataFrame, version: str, table: str, buckets: int) -> None:
        """Each task has a file open for each bucket that it meets, so rows are neither shuffled nor sorted; scans make no use of a declared order."""
        key, name = _CLUSTERED[table][0], self._name(version, table)
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        with self._set("spark.sql.maxConcurrentOutputFileWriters", str(buckets)):
            df.write.format("parquet").option("path", f"{self.base}/{version}/{table}").bucketBy(buckets, key).saveAsTable(name)

    @contextlib.contextmanager
    def _set(self, name: str, value: str) -> Iterator[None]:
        before = self.spark.conf.get(name)
        self.spark.conf.set(name, value)
        try:
            yield
        finally:
            self.spark.conf.set(name, before)

    def _by_first_key(self) -> contextlib.AbstractContextManager[None]:
        """Joins on several keys may use a table's clustering by one of them."""
        return self._set("spark.sql.requireAllClusterKeysForCoPartition", "false")

    # ---------------------------------------------------------------- reading

    def _at(self, version: str | None) -> Graph:
        if (layout := self._layout(version)) is not None:
            return Graph(*(self._clustered(version, table, layout["buckets"]) for table in _CLUSTERED))
        entities = self._read(version, "entity", ENTITY)
        return Graph(entities, D.connected(self._read(version, "relation", RELATION).dropDuplicates(EDGE_KEY), entities))

    def is_new(self) -> bool:
        """Whether nothing has been written yet."""
        return self._last() == 0

    def graph(self) -> Graph:
        """The current graph; empty if nothing has been written. Relations are unique and have both ends."""
        return self._at(self._pointer())

    def current(self) -> tuple[Graph, str | None]:
        """The current graph and the name of its version, which never changes once it is written."""
        version = self._pointer()
        return self._at(version), version

    def revisions(self) -> DataFrame:
        return self._read(self._pointer(), "revision", REVISION)

    def revision(self, ref: str) -> dict:
        row = D.revision_for(self.revisions(), ref).head()
        if row is None:
            raise StoreError("revision_anchor_not_found", f"no revision has the id or anchor {ref!r}")
        return row.asDict(recursive=True)

    def current_revision(self) -> dict | None:
        """The newest revision whose anchor is that of the current graph, else the newest. The anchor is the one that the version's own revision has."""
        revisions = self.revisions()
        own = revisions.where(F.col("id") == f"rev:{self._pointer()}").head()
        anchor = own["anchor"] if own else self.anchor(self.graph())
        row = D.latest_revision(revisions, anchor).head()
        return row.asDict(recursive=True) if row else None

    def snapshot(self, ref: str) -> Graph:
        """The graph as of a revision: a version is its snapshot, so this reads one folder. One whose files are as committed is whole; else both counts are checked."""
        row = self.revision(ref)
        version = row["id"].removeprefix("rev:")
        graph = self._at(version)
        if self._layout(version) is None and (graph.entities.count(), graph.relations.count()) != (row["node_count"], row["edge_count"]):
            raise StoreError("revision_snapshot_unavailable", f"the snapshot of {row['id']} is not whole")
        return graph

    @staticmethod
    def anchor(graph: Graph) -> str:
        a = D.anchor(graph.entities, *graph.entities.columns).head()["anchor"]
        b = D.anchor(graph.relations, *graph.relations.columns).head()["anchor"]
        return f"{a[:32]}{b[:32]}"

    # ---------------------------------------------------------------- changes

    def touched(self, ref: str) -> tuple[DataFrame, DataFrame]:
        """All that a revision did, (id, change) and (from_id, kind, to_id, change), from its change tables."""
        version = self.revision(ref)["id"].removeprefix("rev:")
        nodes, edges = (self._read(version, f"changes/{record}", _change_schema(record)) for record in _KEYS)
        return nodes.select("id", "change").orderBy("id"), edges.select(*EDGE_KEY, "change").orderBy(*EDGE_KEY)

    def _changes_between(self, before: dict, after: dict) -> dict[str, DataFrame] | None:
        """Both records' changes from one revision to the other, folded; None where a version between them has no change table."""
        low, high = sorted((before["number"] or 0, after["number"] or 0))
        if not low:
            return None
        between = self.revisions().where(F.col("number").between(low + 1, high)).select("id").collect()
        versions = [r["id"].removeprefix("rev:") for r in between]
        if len(versions) != high - low or not all(self._exists(f"{self.base}/{v}/changes/{record}/_SUCCESS") for v in versions for record in _KEYS):
            return None
        out = {}
        for record, keys in _KEYS.items():
            schema = _change_schema(record)
            paths = [f"{self.base}/{v}/changes/{record}" for v in versions]
            rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
            out[record] = D.folded(rows, keys, backwards=before["number"] > after["number"])
        return out

    def changed_since(self, version: str) -> DataFrame | None:
        """Ids (id) of entities that writes after a version touched; None where that is not known."""
        revisions = self.revisions()
        row = revisions.where(F.col("id") == f"rev:{version}").head()
        last = revisions.where(F.col("id") == f"rev:{self._pointer()}").head()
        changes = self._changes_between(row.asDict(), last.asDict()) if row and last else None
        return None if changes is None else changes["entity"].select("id")

    def diff(self, before: str, after: str) -> tuple[DataFrame, DataFrame]:
        """Entities and relations that differ between two revisions, by the changes between them; by both snapshots where changes are missing."""
        rows = self.revision(before), self.revision(after)
        if (changes := self._changes_between(*rows)) is not None:
            return D.entity_changes(changes["entity"]), D.stored_relation_changes(changes["relation"])
        a, b = self.snapshot(before), self.snapshot(after)
        return D.diff_entities(a.entities, b.entities), D.diff_relations(a.relations, b.relations)

    def diff_tags(self, before: str, after: str) -> DataFrame:
        """Tags that entities gained and lost between two revisions, read as diff() reads."""
        if (changes := self._changes_between(self.revision(before), self.revision(after))) is not None:
            found = D.entity_changes(changes["entity"], with_tags=True)
            return found.where((F.size("tags_added") > 0) | (F.size("tags_removed") > 0)).drop("changed_fields")
        return D.diff_tags(self.snapshot(before).entities, self.snapshot(after).entities)

    # ---------------------------------------------------------------- writing

    def _summary(self, changes: DataFrame, keys: list[str]) -> dict:
        """TOUCHED of a change table: a bounded head of each list, and all counts."""
        counts = {r["change"]: r["count"] for r in changes.groupBy("change").count().collect()}
        out: dict = {}
        for change in ("created", "updated", "removed"):
            head = changes.where(F.col("change") == change).orderBy(*keys).select(*keys).limit(MOST_TOUCHED) if change in counts else None
            out[change] = [" ".join(r) for r in head.collect()] if head is not None else []
            out[f"n_{change}"] = counts.get(change, 0)
        return out

    def _buckets(self, layout: dict | None, rows: int) -> int:
        """As many as the version before had, unless it has outgrown them."""
        needed = max(LEAST_BUCKETS, -(-rows // BUCKET_ROWS))
        return layout["buckets"] if layout and layout["buckets"] * 4 >= needed else needed

    def _commit(self, now: Graph, nodes: DataFrame, edges: DataFrame, gone: tuple[DataFrame | None, DataFrame | None], metadata: dict, after: int) -> tuple[dict, dict, dict]:
        """Write rows over the current ones as a new version and make it current, if no pointer was added since the one numbered ``after`` was read.

        nodes and edges: what is written, unique and with both ends; gone: keys that go.
        Returns the revision and the summaries of both records.
        """
        version, old = uuid.uuid4().hex, self._version(after)
        at, layout = f"{self.base}/{version}", self._layout(old)
        told, made = {}, {}
        with self._by_first_key():
            for record, current, rows, lost in (("entity", now.entities, nodes, gone[0]), ("relation", now.relations, edges, gone[1])):
                found = D.touched(current, rows, _KEYS[record], lost).withColumn("number", F.lit(after + 1).cast("long"))
                schema = [c.strip().split()[0] for c in _change_schema(record).split(",")]
                found.select(*schema).write.parquet(f"{at}/changes/{record}")
                made[record] = self._read(version, f"changes/{record}", _change_schema(record))
                told[record] = self._summary(made[record], _KEYS[record])
            counts = layout["counts"] if layout else {"entity": now.entities.count(), "relation": now.relations.count()}
            counts = {k: n + told[k]["n_created"] - told[k]["n_removed"] for k, n in counts.items()}
            buckets = self._buckets(layout, max(counts.values()))
            part = lambda record, change: made[record].where(F.col("change") == change) if told[record][f"n_{change}"] else None
            merged = D.rewritten(now.entities, nodes, ["id"], part("entity", "updated"), part("entity", "removed"))
            linked = D.rewritten(now.relations, edges, EDGE_KEY, part("relation", "updated"), part("relation", "removed"))
            aimed = now.incoming if now.incoming is not None else now.relations.select("to_id", "kind", "from_id")
            aimed = D.rewritten(aimed, edges, EDGE_KEY, part("relation", "updated"), part("relation", "removed"))
            for table, df in (("entity", merged), ("relation", linked), ("incoming", aimed)):
                self._write_clustered(df, version, table, buckets)
        new = Graph(*(self._clustered(version, table, buckets) for table in _CLUSTERED))
        files.write_text(self.spark, f"{at}/layout.json", json.dumps({"buckets": buckets, "counts": counts, "files": self._listed(version)}))
        reason = metadata.get("reason") or f"Graph write by {metadata['agent_id']} in session {metadata['session_id']} at {metadata['timestamp']}"
        row = {"id": f"rev:{version}", "anchor": self.anchor(new), "reason": reason, "node_count": counts["entity"], "edge_count": counts["relation"]}
        row |= {"created_at": metadata["timestamp"], "created_by": metadata["agent_id"], "created_session_id": metadata["session_id"]}
        row |= {"number": after + 1, "touched_nodes": told["entity"], "touched_edges": told["relation"]}
        added = self.spark.createDataFrame([row], REVISION)
        self._read(old, "revision", REVISION).unionByName(added).coalesce(1).write.parquet(f"{at}/revision")
        self._swap(version, after)
        return row, told["entity"], told["relation"]

    @staticmethod
    def _stamped(df: DataFrame, metadata: dict) -> DataFrame:
        for p in ("created", "updated"):
            df = df.withColumn(f"{p}_at", F.lit(metadata["timestamp"])).withColumn(f"{p}_by", F.lit(metadata["agent_id"]))
            df = df.withColumn(f"{p}_session_id", F.lit(metadata["session_id"]))
        return df.withColumn("props_json", canonical_json(F.col("props_json")))

    def _unique(self, df: DataFrame, keys: list[str]) -> None:
        if (row := df.groupBy(*keys).count().where("count > 1").head()) is not None:
            raise StoreError("duplicate_key", f"the payload holds {'|'.join(row[k] for k in keys)} twice")

    @staticmethod
    def _tally(told: dict, total: int) -> dict:
        """What was created, updated and kept, without zeros."""
        kept = total - told["n_created"] - told["n_updated"]
        return {k: n for k, n in (("created", told["n_created"]), ("updated", told["n_updated"]), ("kept", kept)) if n}

    def write(self, nodes: DataFrame, edges: DataFrame, metadata: dict) -> dict:
        """Upsert a payload and record a revision. Returns the counts and the revision with what it touched; a failure leaves the store as it was."""
        after = self._last()
        now = self._at(self._version(after))
        own = files.staged(nodes, "write-entity"), files.staged(D.once_each(edges), "write-relation")
        try:
            nodes, edges = (self._stamped(df, metadata) for df in own)
            self._unique(nodes, ["id"])
            if D.lacks_ends(edges, nodes, now.entities):
                lost = D.missing_endpoints(edges, nodes, now.entities).orderBy(*EDGE_KEY).head()
                raise StoreError("unresolved_relationship_endpoint", f"{lost['from_id']} {lost['kind']} {lost['to_id']} needs {lost['missing']}")
            revision, on_nodes, on_edges = self._commit(now, nodes, edges, (None, None), metadata, after)
        finally:
            files.discard(*own)
        return {"nodes": self._tally(on_nodes, revision["node_count"]), "relationships": self._tally(on_edges, revision["edge_count"]), "revision": revision}

    def replace(self, target: Graph, metadata: dict) -> dict:
        """Make the graph equal to the target; provenance of what stays is kept. Nothing is written if nothing differs.

        Relations of the target are taken once each, and only those with both ends in it.
        """
        after = self._last()
        now = self._at(self._version(after))
        relations = files.staged(D.connected_once(target.relations, target.entities), "sync-target")
        moves, written = {}, []
        with self._by_first_key():
            for record, current, wanted in (("entity", now.entities, target.entities), ("relation", now.relations, relations)):
                moves[record] = files.staged(D.sync_diff(current, wanted, _KEYS[record]), f"sync-{record}")
        count = lambda df: {r["change"]: r["count"] for r in df.groupBy("change").count().collect()}
        change = {"nodes": count(moves["entity"]), "relationships": count(moves["relation"])}
        try:
            if not any(change.values()):
                return {**change, "revision": None}
            rows, gone = [], []
            for record, current, wanted in (("entity", now.entities, target.entities), ("relation", now.relations, relations)):
                new = moves[record].where("change <> 'removed'")
                written.append(files.staged(wanted.join(new.select(*_KEYS[record]), _KEYS[record], "left_semi"), f"sync-written-{record}"))
                rows.append(self._stamped(written[-1], metadata).select(*current.columns))
                gone.append(moves[record].where("change = 'removed'").select(*_KEYS[record]))
            revision, _, _ = self._commit(now, *rows, tuple(gone), metadata, after)
            return {**change, "revision": revision}
        finally:
            files.discard(relations, *moves.values(), *written)
