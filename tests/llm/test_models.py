import html
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import boosting, dom, extract, labelled, layouts, quality, toxicity
from quillgraph.llm.common import arrow_bytes, blocks, span_hashes, word_spans

WORDS = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]


def corpus(n=900, seed=1):
    """Toxic: a stem with a changing ending, once. Low quality: words with marks."""
    r = random.Random(seed)
    rows, marks = [], []
    for i in range(n):
        words = [r.choice(WORDS) + r.choice(["", "s", "ed"]) for _ in range(r.randint(5, 120))]
        toxic, good = r.random() < 0.2, r.random() < 0.8
        if toxic:
            words[r.randrange(len(words))] = "zxgrub" + r.choice(["a", "ber", "ing", "oso", "!"])
        if not good:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words)))
        marks.append((i, int(good), int(toxic)))
    return rows, marks


@pytest.fixture(scope="module")
def labelled_corpus():
    return corpus()


def labels_of(spark, marks):
    return spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_held_out(spark):
    got = spark.range(200).select("id", labelled.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in got)


@pytest.mark.parametrize("which", ["quality", "toxic"])
def test_held_out_accuracy(spark, docs, labelled_corpus, which):
    rows, marks = labelled_corpus
    score = quality.score_quality if which == "quality" else toxicity.score_toxicity
    got = {r["doc_id"]: r for r in score(docs(rows, {"score": F.lit("x"), "y": F.lit(1)}), labels_of(spark, marks)).collect()}
    assert len(got) == len(rows)
    truth = {i: (q if which == "quality" else t) for i, q, t in marks}
    held = [i for i in truth if got[i]["held_out"]]
    assert len(held) > 100 and sum(got[i]["predicted"] == truth[i] for i in held) / len(held) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_held_out_labels_do_not_matter(spark, docs, labelled_corpus):
    rows, marks = labelled_corpus
    turned = [(i, 1 - q, t) if zlib.crc32(str(i).encode()) % 5 == 0 else (i, q, t) for i, q, t in marks]
    a, b = (sorted((r["doc_id"], r["score"]) for r in quality.score_quality(docs(rows), labels_of(spark, m)).collect()) for m in (marks, turned))
    assert a == b


@pytest.mark.parametrize("score", [quality.score_quality, toxicity.score_toxicity])
def test_scores_of_odd_rows(spark, docs, score):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a " * 30_000), (5, "x"), (5, "x"), (6, "日本語 é")]
    got = score(docs(rows), labels_of(spark, [])).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert score(docs([]), labels_of(spark, [])).count() == 0
    one_class = score(docs(rows), labels_of(spark, [(i, 1, 1) for i in range(1, 7)])).collect()
    assert len({round(r["score"], 6) for r in one_class}) == 1


def test_every_window_is_scored(spark, docs, labelled_corpus):
    """One toxic word anywhere in a very long text is found."""
    rows, marks = labelled_corpus
    clean = " ".join(random.Random(9).choice(WORDS) for _ in range(5000)).split()
    more = []
    for k, at in enumerate([0, 11, 23, 24, 2500, 4999]):
        words = list(clean)
        words[at] = "zxgrubber"
        more.append((10_000 + k, " ".join(words)))
    more.append((10_100, " ".join(clean)))
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(docs(rows + more), labels_of(spark, marks)).collect()}
    assert [got[10_000 + k] for k in range(6)] == [1] * 6 and got[10_100] == 0
    kept = toxicity.drop_toxic(docs(rows + more), labels_of(spark, marks))
    assert {r["doc_id"] for r in kept.collect()} == {i for i, p in got.items() if p == 0}


def test_windows_cover_every_word():
    first = np.array([0, 0, 5, 29, 30, 130])
    starts, owner = toxicity.windows(first)
    seen = {(o, p) for s, o in zip(starts, owner) for p in range(s, min(s + toxicity.WINDOW, first[o + 1]))}
    assert seen == {(o, p) for o in range(5) for p in range(first[o], first[o + 1])}


def test_gradients_by_finite_differences():
    r = np.random.default_rng(0)
    net = toxicity.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    buckets = r.integers(0, 50, (6, 3, toxicity.INPUTS))
    mask = np.arange(6)[:, None] < np.array([6, 4, 1])
    y, w = np.array([1.0, 0.0, 1.0]), np.ones(3)

    def loss():
        x = net.p["table"][buckets].sum(2)
        logit = net.forward(net.gates(x), mask)
        return float((np.logaddexp(0, logit) - y * logit).mean())

    g = net.gradients(buckets, mask, y, w)
    for name in ("Wf", "Ub", "cf", "attend", "out", "bias"):
        flat, own = net.p[name].reshape(-1), g[name].reshape(-1)
        for k in r.choice(len(flat), min(4, len(flat)), replace=False):
            old, e = flat[k], 1e-3
            flat[k] = old + e
            up = loss()
            flat[k] = old - e
            down = loss()
            flat[k] = old
            assert own[k] == pytest.approx((up - down) / (2 * e), abs=2e-3)


def test_flat_trees_equal_a_plain_walk():
    r = np.random.default_rng(1)
    x = r.normal(size=(400, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.5)).astype(float)
    model = boosting.fit(x, y, np.ones(400), trees=20, depth=3)

    def walk(row):
        out = model.base
        for f, t, v in zip(model.feature, model.threshold, model.value):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            out += v[node - len(f)]
        return out

    assert np.allclose(model.margin(x[:50]), [walk(row) for row in x[:50]])
    assert ((model.score(x) > 0.5) == y).mean() > 0.95


def test_statistics_do_not_depend_on_neighbours():
    texts = ["One two.\nOne two.\n", "", "A", "x | y | z", "é é é", "\n\n"]
    together = quality.statistics(*arrow_bytes(pa.array(texts)))
    alone = np.vstack([quality.statistics(*arrow_bytes(pa.array([t]))) for t in texts])
    assert np.allclose(together, alone) and np.isfinite(together).all()


def test_kernels():
    texts = ["ab c", " d", "", None, "e", "\t", "f g\x0bh"]
    column = pa.array(["junk", *texts]).slice(1)
    raw, at = arrow_bytes(column)
    starts, ends, first = word_spans(raw, at)
    words = [bytes(raw[a:b]).decode() for a, b in zip(starts, ends)]
    assert words == ["ab", "c", "d", "e", "f", "g", "h"] and list(np.diff(first)) == [2, 1, 0, 0, 1, 0, 3]
    again = np.frombuffer(b"zz ab", np.uint8)
    assert span_hashes(raw, starts[:1], ends[:1])[0] == span_hashes(again, np.array([3]), np.array([5]))[0]
    assert blocks(np.array([0, 5, 5, 30, 31]), 10) == [(0, 2), (2, 3), (3, 4)]


# --------------------------------------------------------------------------- pages


@pytest.fixture(scope="module")
def model():
    return extract.default_model()


def test_marginals_against_enumeration():
    import itertools

    forest = dom.Forest()
    forest.add("<body><div class=a><p>x</p><p>y y y</p></div><nav><a>z</a></nav></body>")
    t, r = forest.arrays(), np.random.default_rng(0)
    n = len(t["parent"])
    one, pair = r.normal(size=n), r.normal(size=(dom.EDGES, 2, 2))
    total, mass = 0.0, np.zeros(n)
    for y in itertools.product((0, 1), repeat=n):
        s = sum(one[i] * y[i] for i in range(n)) + sum(pair[t["edge"][i]][y[t["parent"][i]], y[i]] for i in range(n) if t["parent"][i] >= 0)
        total += np.exp(s)
        mass += np.exp(s) * np.array(y)
    node, joint = extract.marginals(t, one, pair)
    assert np.allclose(node[:, 1], mass / total)
    child = np.flatnonzero(t["parent"] >= 0)
    assert np.allclose(joint[child].sum(1), node[child])


def test_fresh_layouts(model):
    forest = dom.Forest(layouts.label_of)
    for page in layouts.labelled_pages(150, seed=77):
        forest.add(page)
    y = np.array([x or 0 for x in forest.label])
    t = forest.arrays()
    found = extract.marginals(t, extract.unary(t, model[0]), model[1])[0][:, 1] > 0.5
    assert (found == y).mean() > 0.97


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x}</style><script>var a="<p>no</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li><li><a href="/b">B</a></li></ul></nav>
<!-- ad --><div class="ad">Buy this now.</div><article><h1>Head &amp; more</h1><p><b>First   one
here &quot;q&quot; &am<br><p>Second&nbsp;one. <a href="x">link</a> text</p><p></p></article><footer>&copy; site</footer></body></html>"""


def test_page(model):
    assert extract.extract_texts([PAGE], model) == ['Head & more\nFirst one here "q" &am\nSecond one. link text']


def test_odd_pages(spark, model):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "plain text only, of some length"), (4, "u", "<p>one</p><p>two &lt;b&gt;</p>"), (5, "u", "<article><p>cut <b>off"), (6, "u", "<" * 500), (7, "u", PAGE), (7, "u", PAGE), (8, "u", "<script>x"), (9, "u", "<article>" + "<p>long paragraph of words</p>" * 5000 + "</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {}
    for r in extract.extract(df, model).collect():
        got.setdefault(r["page_id"], []).append(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert got[1] == got[2] == got[8] == [""] and got[4] == ["one\ntwo <b>"] and len(got[7]) == 2
    assert got[3] == ["plain text only, of some length"] and got[5] == ["cut off"] and got[9][0].count("\n") == 4999
    assert extract.extract(df.limit(0), model).count() == 0


@pytest.mark.parametrize(
    "odd",
    ['<svg class="i"/>', "<SVG a='>' />", "<svg/>", '<svg class="i"><path d="M0"/></svg>', '<svg><svg/></svg>', '<svg-icon name="x"></svg-icon>', "<title-bar></title-bar>", "<template-card></template-card>", "<style-guide/>", "<script-x>", "<iframe.x>", "<!-->", "<!--->", "<!-- a --!>", "<!---->", "<!-- a > b -->", "<script>'<p>'</script>"],
)
def test_nothing_after_an_odd_tag_is_cut(odd):
    forest = dom.Forest()
    forest.add(f"<p>one</p>{odd}<p>two</p><p>three</p>")
    forest.add(f"<p>one {odd} two</p><p>three</p>")
    assert [" ".join(t for block in page for _, t in block).split() for page in forest.pages] == [["one", "two", "three"]] * 2


def test_text_after_an_icon_is_extracted(model):
    page = "<article><p>one is a sentence of some words</p>{}<p>two is a sentence of some words</p></article>"
    assert extract.extract_texts([page.format(x) for x in ('<svg class="i"/>', "<!-->")], model) == ["one is a sentence of some words\ntwo is a sentence of some words"] * 2


def test_given_pages(spark, model):
    rows = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]

    def expected(page):
        inner = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)[^>]*>", inner)]
        return "\n".join(x for x in parts if x)

    assert extract.extract_texts(rows, model) == [expected(p) for p in rows]
