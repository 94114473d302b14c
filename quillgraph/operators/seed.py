"""Seeding a graph from a repository's documents."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cut_bytes(text: str, most: int) -> str:
    """White space collapsed; over ``most`` UTF-8 bytes, cut to most - 3 bytes, trimmed and marked with dots."""
    text = " ".join(text.split())
    raw = text.encode()
    return text if len(raw) <= most else raw[: most - 3].decode(errors="ignore").strip() + "..."


def summarize_markdown(text: str) -> tuple[str, str, str]:
    """Title (the first level-one heading), summary (first paragraph) and excerpt (first two) of a document; code fences are skipped."""
    title, paragraphs, lines, fenced = "", [], [], False

    def close() -> None:
        if lines:
            paragraphs.append(" ".join(lines))
            lines.clear()

    for line in text.splitlines():
        line = line.strip()
        if line.startswith("```"):
            fenced = not fenced
            close()
        elif fenced:
            continue
        elif line.startswith("# ") and not title:
            title = line[2:].strip()
            close()
        elif not line or line.startswith("#"):
            close()
        else:
            lines.append(line.lstrip(">").strip())
    close()
    paragraphs = [p for p in paragraphs if p.strip()]
    return title, cut_bytes(paragraphs[0], 240) if paragraphs else "", cut_bytes(" ".join(paragraphs[:2]), 400)


def markdown_summaries(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, title, summary, excerpt) of Markdown documents, a batch of rows at a time."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = [summarize_markdown(t or "") for t in b[text]]
            yield pd.DataFrame({key: b[key], "title": [p[0] for p in parts], "summary": [p[1] for p in parts], "excerpt": [p[2] for p in parts]})

    return docs.select(key, text).mapInPandas(run, f"{key} {kind}, title string, summary string, excerpt string")


def yaml_scalar(text: str, key: str) -> str:
    """The value of the first top-level ``key:`` line."""
    for line in text.splitlines():
        if line.strip().startswith(f"{key}:"):
            return line.strip()[len(key) + 1 :].strip().strip("\"'")
    return ""


# Fixed values of the baseline: tags, titles and texts of what is found in a repository.
_FOUND = {
    "readme": ("README.md", "README", "Repository overview and setup guidance.", ["readme", "repository", "workflow"], "markdown"),
    "architecture": ("docs/architecture", "Architecture documentation", "Architecture reference directory.", ["architecture", "docs", "workflow"], "directory"),
    "backlog": ("docs/plan/backlog.yaml", "Project backlog", "Project backlog with themes, epics, and stories.", ["backlog", "planning", "workflow"], "yaml"),
}
_LISTED = "Architecture reference directory with %d document(s): %s."
_PROJECT = "Project backlog for %s with themes, epics, and stories."
BACKLOG_BYTES = 320


def found_files(spark: SparkSession, root: str) -> DataFrame:
    """(path relative to the root, text) of the files below a repository that a baseline looks at; text of README and backlog only.

    One recursive listing with a path filter; contents of other files are not read.
    """
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base = fs.makeQualified(at).toString().rstrip("/")
    wanted = [f"{base}/{p}" for p in ("README.md", "docs/plan/backlog.yaml", "docs/architecture")]
    there = [w for w in wanted if fs.exists(jvm.org.apache.hadoop.fs.Path(w))]
    if not there:
        return spark.createDataFrame([], "path string, text string")
    for w in there:
        if fs.getFileStatus(jvm.org.apache.hadoop.fs.Path(w)).isDirectory() != w.endswith("architecture"):
            raise ValueError(f"{w} must be a {'directory' if w.endswith('architecture') else 'file'}")
    listed = [spark.read.format("binaryFile").load(w) for w in there if not w.endswith("architecture") or fs.listStatus(jvm.org.apache.hadoop.fs.Path(w))]
    plain = F.regexp_replace("_metadata.file_path", r"^[a-z0-9]+:/+(?=/)|^[a-z0-9]+:(?=/[^/])", "")
    start = F.length(F.regexp_replace(F.lit(base), r"^[a-z0-9]+:/+(?=/)|^[a-z0-9]+:(?=/[^/])", "")) + 2
    out = None
    for df in listed:
        rows = df.select(F.substr(F.url_decode(F.replace(plain, F.lit("+"), F.lit("%2B"))), start).alias("path"), F.col("content"))
        rows = rows.select("path", F.when(~F.startswith("path", F.lit("docs/architecture/")), F.col("content").cast("string")).alias("text"))
        out = rows if out is None else out.unionByName(rows)
    return spark.createDataFrame([], "path string, text string") if out is None else out


def _props(**pairs: object) -> str:
    return json.dumps({k: v for k, v in pairs.items() if v}, ensure_ascii=False, sort_keys=True)


def baseline(spark: SparkSession, root: str, repository_id: str) -> tuple[list[dict], list[dict]]:
    """Nodes and edges of a repository's baseline: the repository, and README, architecture folder and backlog where they are there."""
    name = root.rstrip("/").rsplit("/", 1)[-1]
    rows = {r["path"]: r["text"] for r in found_files(spark, root).collect()}
    folder = "docs/architecture/"
    listed = sorted(p.removeprefix(folder) for p in rows if p.startswith(folder) and "/" not in p.removeprefix(folder))
    seen: list[dict] = []
    for key, (path, title, summary, tags, source) in _FOUND.items():
        node = {"id": f"artifact:{repository_id}:{key}", "kind": "Document", "title": title, "summary": summary, "content": "", "repo_path": path, "tags": tags}
        if key == "readme" and path in rows:
            told = summarize_markdown(rows[path] or "")
            seen.append(node | {"title": told[0] or title, "summary": told[1] or summary, "content": told[2], "props_json": _props(source_type=source)})
        elif key == "architecture" and listed:
            seen.append(node | {"summary": _LISTED % (len(listed), ", ".join(listed)), "props_json": _props(source_type=source, files=listed)})
        elif key == "backlog" and path in rows:
            project = yaml_scalar(rows[path] or "", "project")
            told = _PROJECT % project if project else summary
            seen.append(node | {"summary": told, "content": cut_bytes(rows[path] or "", BACKLOG_BYTES), "props_json": _props(source_type=source, project=project)})
    top = {"id": f"repo:{repository_id}", "kind": "Repository", "title": name, "content": "", "repo_path": ".", "tags": ["repository", "workflow"]}
    about = next((n["summary"] for n in seen if n["id"].endswith(":readme")), "")
    top |= {"summary": about or f"Repository {name}.", "props_json": _props(repository_id=repository_id, root_path=root)}
    edges = [{"from_id": n["id"], "kind": "PART_OF", "to_id": top["id"], "props_json": _props(source_path=n["repo_path"])} for n in seen]
    return [top, *seen], edges


def seed_rows(spark: SparkSession, repository_id: str, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A Repository node, a Document node for each file (path, text), and PART_OF between them."""
    title = markdown_summaries(documents, "path", "text")
    node = F.concat(F.lit("document:"), "path")
    docs = title.select(node.alias("id"), F.lit("Document").alias("kind"), F.coalesce(F.nullif("title", F.lit("")), "path").alias("title"), "summary", F.col("excerpt").alias("content"), F.col("path").alias("repo_path"))
    root = spark.createDataFrame([(f"repository:{repository_id}", "Repository", repository_id, "", "", "")], "id string, kind string, title string, summary string, content string, repo_path string")
    edges = title.select(node.alias("from_id"), F.lit("PART_OF").alias("kind"), F.lit(f"repository:{repository_id}").alias("to_id"))
    return root.unionByName(docs), edges
