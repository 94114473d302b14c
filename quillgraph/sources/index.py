"""The stored text index: postings of the graph's searchable texts in segments, kept up by what changes.

A segment holds the postings of some documents, sorted by term, the digest of each document's
searchable texts, and the ids whose postings in older segments no longer count. A refresh
reads the documents that may have changed (those that the store's change tables name, or
else all digests), tokenises those whose digest differs and adds a segment. When there are
many segments they are folded into one from their postings; no text is read for that.

One small file names the segments with their counts and a digest of their files' names and
lengths. It is changed in one step, so readers see the index before or after. Folders that
neither it nor the description before it names are deleted.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.search import documents, postings, search
from . import files
from .store import StoreError

VERSION = "v2"
#: Postings in one file, sorted by term, so that a query reads the few row groups of its terms.
FILE_POSTINGS = 5_000_000
#: Segments beyond which all are folded into one.
MOST_SEGMENTS = 8
_POSTINGS, _DIGESTS, _STRUCK = "term string, doc_id string, weight double", "id string, digest string", "id string"
#: A digest's parts, each of 56 bits, whose sums over all documents are the anchor.
_PARTS = (1, 15, 29, 43)


def _part(i: int) -> Column:
    return F.conv(F.substring("digest", i, 14), 16, 10).cast("decimal(38,0)")


class TextIndex:
    """Segments under a folder, and one small file that describes them."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    # ---------------------------------------------------------------- description

    def _corrupt(self, what: str) -> StoreError:
        return StoreError("text_index_corrupt", f"{what}; remove {self.base} and the next query builds the index again")

    def load(self) -> dict | None:
        """The index's description; None if there is none. One that cannot be read or is of another version is an error, never built over."""
        text = files.read_text(self.spark, f"{self.base}/index.json")
        if text is None:
            return None
        try:
            meta = json.loads(text)
            version = meta["schema_version"]
            if version == VERSION:
                for name in ("document_count", "anchor", "sums", "folder", "previous"):
                    meta[name]
                for segment in meta["segments"]:
                    for name in ("folder", "n_documents", "n_postings", "n_struck", "files"):
                        segment[name]
        except (ValueError, KeyError, TypeError):
            raise self._corrupt("the text index is unreadable") from None
        if version != VERSION:
            raise self._corrupt(f"the text index has version {version}, not {VERSION}")
        return meta

    def _listed(self, folder: str) -> str:
        """A digest of a segment's files by name and length; of none if the folder is gone."""
        seen = []
        for part in ("postings", "documents", "struck"):
            fs, at = files.file_system(self.spark, self.base), self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{folder}/{part}")
            found = fs.listStatus(at) if fs.exists(at) else []
            seen += sorted(f"{part}/{f.getPath().getName()} {f.getLen()}" for f in found if not f.getPath().getName().startswith((".", "_")))
        return hashlib.sha256("\n".join(seen).encode()).hexdigest()

    def verify(self, meta: dict) -> None:
        """Every segment's postings, documents and struck ids are the files that were written; no table is read for that."""
        if any(self._listed(s["folder"]) != s["files"] for s in meta["segments"]):
            raise self._corrupt("the text index and its description differ")

    def _describe(self, segments: list[dict], sums: list[int], count: int, version: str | None, before: dict | None) -> dict:
        anchor = hashlib.sha256("|".join(map(str, [count, *sums])).encode()).hexdigest()
        old = [s["folder"] for s in before["segments"]] if before else []
        meta = {"schema_version": VERSION, "folder": segments[0]["folder"], "segments": segments, "previous": old}
        meta |= {"document_count": count, "sums": [str(x) for x in sums], "anchor": anchor, "graph_version": version}
        files.write_text(self.spark, f"{self.base}/index.json", json.dumps(meta))
        named = {*old, *(s["folder"] for s in segments)}
        for folder in before["previous"] if before else []:
            if folder not in named:
                files.remove(self.spark, f"{self.base}/{folder}")
        return meta

    # ---------------------------------------------------------------- segments

    def _table(self, folder: str, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.base}/{folder}/{name}")

    def _live(self, meta: dict, name: str, schema: str, key: str) -> DataFrame:
        """A table of all segments without the rows of ids that a later segment struck out."""
        segments, parts = meta["segments"], []
        for k, segment in enumerate(segments):
            rows = self._table(segment["folder"], name, schema)
            later = [self._table(s["folder"], "struck", _STRUCK) for s in segments[k + 1 :] if s["n_struck"]]
            if later:
                rows = rows.join(reduce(DataFrame.unionByName, later).withColumnRenamed("id", key), key, "left_anti").select(*rows.columns)
            parts.append(rows)
        return reduce(DataFrame.unionByName, parts)

    def postings(self, meta: dict) -> DataFrame:
        """(term, doc_id, weight) of the indexed texts as they are now; a filter on the term reaches every segment's scan."""
        return self._live(meta, "postings", _POSTINGS, "doc_id")

    def _write_segment(self, found: DataFrame, digests: DataFrame, struck: DataFrame | None) -> dict:
        folder = uuid.uuid4().hex
        kept = files.staged(found, "postings")
        try:
            parts = max(1, -(-(n := kept.count()) // FILE_POSTINGS))
            kept.repartitionByRange(parts, "term", "doc_id").sortWithinPartitions("term", "doc_id").write.parquet(f"{self.base}/{folder}/postings")
        finally:
            files.discard(kept)
        digests.select("id", "digest").write.parquet(f"{self.base}/{folder}/documents")
        none = self.spark.createDataFrame([], _STRUCK)
        (none if struck is None else struck.select("id")).write.parquet(f"{self.base}/{folder}/struck")
        count = lambda name, schema: self._table(folder, name, schema).count()
        return {"folder": folder, "n_documents": count("documents", _DIGESTS), "n_postings": n, "n_struck": count("struck", _STRUCK), "files": self._listed(folder)}

    @staticmethod
    def _digested(docs: DataFrame) -> DataFrame:
        return docs.withColumn("digest", F.sha2(F.to_json(F.struct(*docs.columns)), 256))

    @staticmethod
    def _sums(digests: DataFrame) -> tuple[int, list[int]]:
        row = digests.agg(F.count(F.lit(1)).alias("n"), *[F.sum(_part(i)).alias(f"p{i}") for i in _PARTS]).head()
        return row["n"], [int(row[f"p{i}"] or 0) for i in _PARTS]

    def build(self, entities: DataFrame, version: str | None, before: dict | None = None) -> dict:
        """All texts anew, as one segment."""
        docs = documents(entities)
        segment = self._write_segment(postings(docs), self._digested(docs), None)
        count, sums = self._sums(self._table(segment["folder"], "documents", _DIGESTS))
        return self._describe([segment], sums, count, version, before) | {"tokenised": count}

    def _fold(self, meta: dict) -> dict:
        """One segment with the postings of all, by reading these alone."""
        segment = self._write_segment(self.postings(meta), self._live(meta, "documents", _DIGESTS, "id"), None)
        return self._describe([segment], [int(x) for x in meta["sums"]], meta["document_count"], meta["graph_version"], meta)

    def refresh(self, meta: dict, entities: DataFrame, version: str | None, changed: DataFrame | None = None) -> dict:
        """The index after what differs between its digests and the entities: ``changed`` (id) names where to look, else everywhere.

        Returns the description with the number of documents ``tokenised``.
        """
        had = self._live(meta, "documents", _DIGESTS, "id")
        if changed is not None:
            ids = changed.select("id").distinct()
            entities, had = entities.join(ids, "id", "left_semi").select(*entities.columns), had.join(ids, "id", "left_semi")
        docs = documents(entities)
        met = self._digested(docs).select("id", "digest").join(had.select("id", F.col("digest").alias("old")), "id", "full_outer")
        moved = files.staged(met.where(~F.col("digest").eqNullSafe(F.col("old"))), "moved")
        try:
            n, plus = self._sums(moved.where("digest IS NOT NULL"))
            m, minus = self._sums(moved.where("old IS NOT NULL").select(F.col("old").alias("digest")))
            if not n and not m:
                files.write_text(self.spark, f"{self.base}/index.json", json.dumps(meta | {"graph_version": version}))
                return meta | {"graph_version": version, "tokenised": 0}
            new = moved.where("digest IS NOT NULL")
            segment = self._write_segment(postings(docs.join(new.select("id"), "id", "left_semi")), new, moved.where("old IS NOT NULL"))
        finally:
            files.discard(moved)
        sums = [int(a) + b - c for a, b, c in zip(meta["sums"], plus, minus)]
        out = self._describe([*meta["segments"], segment], sums, meta["document_count"] + n - m, version, meta)
        if len(out["segments"]) > MOST_SEGMENTS:
            out = self._fold(out)
        return out | {"tokenised": n}

    def ensure(self, entities: DataFrame, version: str | None = None, changed_since=None) -> tuple[dict, str]:
        """The index of these entities and its status: ready, or rebuilt if it was missing or of other texts (then what changed is brought in).

        ``version`` names an immutable state of the graph: if the index was last seen with it,
        no text is read at all. ``changed_since(version)`` may give the ids (id) that changed
        since the index's version; without an answer all digests are compared.
        """
        meta = self.load()
        if meta is None:
            return self.build(entities, version), "rebuilt"
        self.verify(meta)
        seen = meta.get("graph_version")
        if version is not None and seen == version:
            return meta | {"tokenised": 0}, "ready"
        changed = changed_since(seen) if changed_since is not None and seen is not None else None
        out = self.refresh(meta, entities, version, changed)
        return out, "ready" if out["anchor"] == meta["anchor"] else "rebuilt"

    def search(self, meta: dict, query: str) -> DataFrame:
        """(doc_id, score, matched_terms) from the stored postings of the query's terms alone."""
        size = self.spark.range(1).select(F.lit(meta["document_count"]).alias("n"))
        return search(self.postings(meta), size, query)
