"""Main-text extraction by a tree-structured graphical model (operator 2).

Each block element of a page is a binary variable (content or not) of a conditional
random field over the DOM tree. Unary potentials come from tag, class and id words,
text length, link density, sentence ends, share of the page's text and cue words of
boilerplate; a 2 x 2 potential for each kind of child connects parent and child.
Sum-product messages, upward and then downward, give exact marginals, for all pages of a
batch at once, level by level. Weights maximise the conditional likelihood of labelled
pages, with the same messages giving the expected counts. As no table labels pages, these
are generated from a grammar of layouts (``layouts``); the fitted weights are kept in
``layout_model.json``, which ``python -m quillgraph.llm.extract`` fits and writes anew.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table, workers_see_us
from .dom import EDGES, FEATURES, Forest
from .layouts import label_of, labelled_pages

STEPS = 300
MODEL = Path(__file__).with_name("layout_model.json")
_CHUNK = 1 << 20


def _sum(a: np.ndarray, axis: int) -> np.ndarray:
    """Log of the sum of exponentials over an axis of two."""
    return np.logaddexp(a.take(0, axis), a.take(1, axis))


def unary(t: dict, w: np.ndarray) -> np.ndarray:
    """Log potential of label 1 of each node."""
    return np.bincount(t["node"], t["value"] * w[t["feature"]], len(t["parent"]))


def marginals(t: dict, one: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Node marginals (nodes x 2) and pair marginals (nodes x parent 2 x child 2; zero at roots). pair: edge type x 2 x 2, as logs."""
    n = len(one)
    up = np.stack([np.zeros(n), one], 1)
    psi = pair[t["edge"]]
    message = np.zeros((n, 2))
    for level in t["levels"][:0:-1]:
        message[level] = _sum(psi[level] + up[level][:, None, :], 2)
        np.add.at(up, t["parent"][level], message[level])
    belief, joint = up.copy(), np.zeros((n, 2, 2))
    for level in t["levels"][1:]:
        from_parent = belief[t["parent"][level]] - message[level]
        both = from_parent[:, :, None] + psi[level] + up[level][:, None, :]
        belief[level] = _sum(both, 1)
        joint[level] = np.exp(both - _sum(_sum(both, 2), 1)[:, None, None])
    return np.exp(belief - _sum(belief, 1)[:, None]), joint


def train(pages: list[str] | None = None, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights of features and log potentials of edges, by Adam on the exact conditional likelihood."""
    forest = Forest(label_of)
    for page in labelled_pages() if pages is None else pages:
        forest.add(page)
    t = forest.arrays()
    y = np.array([x or 0 for x in forest.label])
    child = np.flatnonzero(t["parent"] >= 0)
    rest = np.bincount(t["parent"][child], 1 - y[child], len(y))
    roots = np.array(forest.roots, np.int64)
    y[roots] = rest[roots] == 0  # a page is content where all that is in it is
    seen = np.zeros((EDGES, 2, 2))
    np.add.at(seen, (t["edge"][child], y[t["parent"][child]], y[child]), 1)
    wanted = np.bincount(t["feature"], t["value"] * y[t["node"]], FEATURES)
    w, pair = np.zeros(FEATURES), np.zeros((EDGES, 2, 2))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(pair), np.zeros_like(pair)]
    for step in range(1, steps + 1):
        node, joint = marginals(t, unary(t, w), pair)
        expected = np.zeros_like(pair)
        np.add.at(expected, t["edge"][child], joint[child])
        for k, (value, grad, ridge) in enumerate(((w, wanted - np.bincount(t["feature"], t["value"] * node[:, 1][t["node"]], FEATURES), 0.5), (pair, seen - expected, 0.5))):
            g = grad - ridge * value
            m, v = moments[2 * k], moments[2 * k + 1]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            value += 0.15 / (1 + step / 60) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return w, pair


@functools.cache
def default_model() -> tuple[np.ndarray, np.ndarray]:
    """The kept model of the generated layouts, read on the driver only."""
    kept = json.loads(MODEL.read_text())
    w, pair = np.zeros(FEATURES), np.zeros(EDGES * 4)
    w[kept["features"]], pair[kept["edges"]] = kept["feature_weights"], kept["edge_weights"]
    return w, pair.reshape(EDGES, 2, 2)


def write_model(model: tuple[np.ndarray, np.ndarray], at: Path = MODEL) -> None:
    """Keep the weights that are not zero, at three decimals."""
    w, pair = model[0].round(3), model[1].round(3).ravel()
    f, e = np.flatnonzero(w), np.flatnonzero(pair)
    kept = {"features": f.tolist(), "feature_weights": w[f].tolist(), "edges": e.tolist(), "edge_weights": pair[e].tolist()}
    at.write_text("{\n" + ",\n".join(f" {json.dumps(k)}: {json.dumps(v)}" for k, v in kept.items()) + "\n}\n")


def extract_texts(pages: list[str], model: tuple[np.ndarray, np.ndarray]) -> list[str]:
    """Main text of each page: blocks whose elements are content with probability over one half, in page order."""
    forest = Forest()
    for page in pages:
        forest.add(page)
    t = forest.arrays()
    w, pair = model
    content = (marginals(t, unary(t, w), pair)[0][:, 1] > 0.5).tolist()
    out = []
    for blocks in forest.pages:
        kept = (" ".join("".join([s for k, s in block if content[k]]).split()) for block in blocks)
        out.append("\n".join([x for x in kept if x]))
    return out


def _extract(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            pages = [x or "" for x in batch.column(2).to_pylist()]
            texts: list[str] = []
            part: list[str] = []
            size = 0
            for page in pages:
                part.append(page)
                size += len(page)
                if size > _CHUNK:
                    texts += extract_texts(part, model)
                    part, size = [], 0
            if part:
                texts += extract_texts(part, model)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, model: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Null, empty and text-free pages have an empty text. Truncated and badly nested pages
    are read as far as they go; nothing is cut or capped. Repeated rows are extracted each;
    an empty table gives no rows; only page_id, url and html are read. The model that is
    broadcast has a fixed size.
    """
    spark = pages.sparkSession
    workers_see_us(spark)
    held = spark.sparkContext.broadcast(default_model() if model is None else model)
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].alias("html"))
    return rows.mapInArrow(_extract(held), "page_id long, url string, text string, n_chars long")


def op2_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


if __name__ == "__main__":
    write_model(train())
