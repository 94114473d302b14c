"""Pages written by hand, of layouts that the training grammar never saw, and pages that are broken in many ways."""

import random
import time

import pytest

from quillgraph.llm import dom, extract, layouts

_SAID = ["The river rose over the old bridge, and the town waited.", "Nobody had planned for rain this late in the year.", "When the council met again, its members agreed on a slower repair.", "Costs, they said, would be shared between both districts."]
CASES = {}


def S(n, first=0):
    """n sentences."""
    return " ".join(_SAID[(i + first) % 4] for i in range(n))


def case(name, page, want):
    CASES[name] = (page, "\n".join(want))


# fmt: off
case("col8", f'''<html><body><div class="row"><div class="col-4"><a href="/">Home</a> <a href="/n">News</a> <a href="/s">Sport</a></div><div class="col-8"><h2>A bridge is mended</h2><div>By Ann Lee, 3 May</div><p>{S(3)}</p><p>{S(2,1)}</p><figure><img src="x.png"><figcaption>The bridge in spring.</figcaption></figure><ul><li>Stone for the piers</li><li>Wood for the deck</li></ul><pre>piers = 4</pre></div></div></body></html>''',
 ["A bridge is mended","By Ann Lee, 3 May",S(3),S(2,1),"The bridge in spring.","Stone for the piers","Wood for the deck","piers = 4"])
case("table_layout", f'''<html><body><table width="100%"><tr><td colspan="2"><a href="/">Site name</a></td></tr><tr><td valign="top"><a href="/a">Essays</a><br><a href="/b">Books</a><br><a href="/c">About</a></td><td><h1>On bridges</h1><p>{S(4)}</p><p>{S(3,2)}</p></td></tr></table></body></html>''',
 ["On bridges",S(4),S(3,2)])
case("dl_details", f'''<html><body><header><a href="/">Home</a></header><article><h1>Terms of bridges</h1><p>{S(2)}</p><dl><dt>Pier</dt><dd>A support that stands in the water.</dd><dt>Deck</dt><dd>What one walks on.</dd></dl><details><summary>More on decks</summary><p>{S(2,1)}</p></details></article><footer>Copyright</footer></body></html>''',
 ["Terms of bridges",S(2),"Pier","A support that stands in the water.","Deck","What one walks on.","More on decks",S(2,1)])
case("hostile", f'''<html><body><div data-y="left"><article title="pos y=top" y="1"><h1>Head</h1><p data-y="" y=0>{S(3)}</p></article></div><div y="1" class="footer">All rights reserved</div></body></html>''', ["Head",S(3)])
case("wrappers", f'''<html><body><div id="page"><div id="masthead"><div class="logo">Daily</div></div><div class="wrap"><div class="inner"><div><div><h1>Flood year</h1><p>{S(3)}</p><div><p>{S(2,3)}</p></div><div><p>{S(2,2)}</p></div></div></div></div><div><h3>Most read</h3><ul><li><a href="/1">One story about a cat</a></li><li><a href="/2">Two stories about dogs</a></li></ul></div></div><div>Copyright 2020 Daily. All rights reserved.</div></div></body></html>''',
 ["Flood year",S(3),S(2,3),S(2,2)])
case("plain_divs", f'''<html><body><div><a href="/">Home</a> | <a href="/x">Archive</a> | <a href="/y">Contact</a></div><div><h1>Walls</h1><div>{S(3)}</div><div>{S(4,1)}</div><div>{S(2,2)}</div></div><div><a href="/p">Privacy</a> <a href="/t">Terms</a></div></body></html>''', ["Walls",S(3),S(4,1),S(2,2)])
case("sections", f'''<html><body><nav><a href="/">Home</a></nav><main><article><header><h1>Guide</h1><p class="byline">By <a href="/u">Sam Hill</a></p></header><section><h2>First steps</h2><p>{S(2)}</p></section><section><h2>Second steps</h2><ol><li>Open it.</li><li>Close it again.</li></ol><blockquote><p>{S(1)}</p></blockquote><table><thead><tr><th>Year</th><th>Cost</th></tr></thead><tbody><tr><td>1990</td><td>12</td></tr></tbody></table></section><section class="comments"><h2>Comments</h2><div class="comment"><p>{S(1,2)}</p></div></section></article><aside class="related"><h3>Related</h3><p>{S(1,1)}</p></aside></main><footer><p>&copy; 2021</p></footer></body></html>''',
 ["Guide","By Sam Hill","First steps",S(2),"Second steps","Open it.","Close it again.",S(1),"Year","Cost","1990","12"])
case("cookie", f'''<html><body><div class="cookie-banner"><p>We use cookies to give you the best experience. By going on you agree to our policy.</p><button>Accept</button></div><div class="content"><h1>News</h1><p>{S(3)}</p></div><div class="newsletter"><form><p>Sign up for our newsletter and get the best stories.</p><input></form></div></body></html>''', ["News",S(3)])
case("short", f'''<html><body><ul class="menu"><li><a href="/">Home</a></li><li><a href="/a">All</a></li></ul><div class="post"><h2>Note</h2><p>Closed today.</p></div><div class="footer">2020</div></body></html>''', ["Note","Closed today."])
case("unclosed", f'''<html><body><div id=nav><a href=/>Home</a><a href=/b>Back</a></div><div id=content><h1>Old page</h1><p>{S(2)}<p>{S(3,1)}<ul><li>one thing<li>another thing</ul></div><div id=footer>Mail the webmaster</div>''', ["Old page",S(2),S(3,1),"one thing","another thing"])
case("forum", f'''<html><body><div id="hd"><a href="/">Board</a></div><div class="entry"><h1>How it was made</h1><p>{S(3)}</p></div><ol class="commentlist"><li class="comment"><b>joe</b><p>{S(2)}</p></li><li class="comment"><b>ann</b><p>{S(3,2)}</p></li></ol></body></html>''', ["How it was made",S(3)])
case("code", f'''<html><body><div class="navbar"><a href="/">Docs</a></div><div class="container"><div class="row"><div class="col-md-3"><ul><li><a href="#a">Install</a></li><li><a href="#b">Use</a></li></ul></div><div class="col-md-9"><h1>Install</h1><p>Run this first.</p><pre><code>make all
make install</code></pre><p>{S(2)}</p><div class="highlight"><pre>x = 1</pre></div></div></div></div></body></html>''', ["Install","Run this first.","make all make install",S(2),"x = 1"])
case("bootstrap", f'''<html><body><div class="navbar navbar-default"><div class="container"><ul class="nav"><li><a href="/">Home</a></li></ul></div></div><div class="container"><div class="row"><div class="col-sm-8"><h1>Privacy in small towns</h1><p class="lead">{S(1)}</p><p>{S(3,1)}</p><h2>Search for a method</h2><p>{S(2,2)}</p></div><div class="col-sm-3"><div class="well"><h4>About</h4><p>{S(1,3)}</p></div><div><h4>Archives</h4><ol><li><a href="#">March 2014</a></li></ol></div></div></div></div><div class="footer"><p>Built by us. <a href="#">Back to top</a></p></div></body></html>''',
 ["Privacy in small towns",S(1),S(3,1),"Search for a method",S(2,2)])
case("german", f'''<html><body><div id="kopf"><a href="/">Startseite</a></div><div id="inhalt"><h1>Die Br&uuml;cke</h1><p>Der Fluss stieg &uuml;ber die alte Br&uuml;cke, und die Stadt wartete. Niemand hatte mit Regen gerechnet.</p><p>Als der Rat wieder tagte, einigten sich alle auf eine langsame Reparatur.</p></div><div id="fuss">Impressum | Datenschutz | AGB</div></body></html>''',
 ["Die Brücke","Der Fluss stieg über die alte Brücke, und die Stadt wartete. Niemand hatte mit Regen gerechnet.","Als der Rat wieder tagte, einigten sich alle auf eine langsame Reparatur."])
case("recipe", f'''<html><body><header class="site-header"><a href="/">Kitchen</a><nav><a href="/a">All</a></nav></header><main><h1>Bread</h1><p>{S(1)}</p><h2>Ingredients</h2><ul><li>500 g flour</li><li>10 g salt</li></ul><h2>Method</h2><ol><li>Mix all of it.</li><li>Wait for a day.</li></ol><div class="ad">Buy flour from us today.</div></main><section id="comments"><h3>3 comments</h3><article class="comment"><p>{S(3)}</p></article><article class="comment"><p>{S(1,1)}</p></article></section></body></html>''',
 ["Bread",S(1),"Ingredients","500 g flour","10 g salt","Method","Mix all of it.","Wait for a day."])
case("nested_quotes", f'''<html><body><article title='he said "no" > yes' data-x="it's"><p onclick="go('x')">{S(2)}</p><p title=5">{S(1,1)}</p></article></body></html>''', [S(2),S(1,1)])
case("amp_list", f'''<html><body><article><h2>List of parts</h2><ol>'''+"".join(f"<li><a href='/{i}'>Part {i}</a>: a piece of wood that holds the deck in place.</li>" for i in range(6))+'''</ol></article></body></html>''', ["List of parts"]+[f"Part {i}: a piece of wood that holds the deck in place." for i in range(6)])
case("news_grid", f'''<html><body><div class="grid"><div class="grid-item"><img src="l.png"></div><div class="grid-item"><a href="/w">World</a><a href="/b">Business</a></div></div><div class="grid"><div class="unit-8"><span class="kicker">City</span><h1>Trains stop at noon</h1><div class="meta">By Jo Marsh | 4 June</div><div><p>{S(2)}</p><p>{S(3,1)}</p><div class="share-buttons"><a href="#">Tweet</a> <a href="#">Share</a></div><p>{S(2,3)}</p></div></div><div class="unit-4"><h3>More news</h3><p><a href="/1">A dog found its way home</a></p><p><a href="/2">The lake is frozen</a></p></div></div></body></html>''',
 ["City","Trains stop at noon","By Jo Marsh | 4 June",S(2),S(3,1),S(2,3)])
case("faq", f'''<html><body><nav><a href="/">Start</a></nav><main><h1>Questions</h1><details><summary>How long?</summary>{S(2)}</details><details><summary>How much?</summary><p>{S(1,1)}</p></details></main><footer><div>Copyright</div></footer></body></html>''',["Questions","How long?",S(2),"How much?",S(1,1)])
case("docs_dl", f'''<html><body><div class="sidebar"><ul><li><a href="#">Intro</a></li><li><a href="#">Options</a></li></ul></div><div class="body"><h1>Options</h1><p>{S(1)}</p><dl class="option"><dt>--fast</dt><dd>{S(1,1)}</dd><dt>--slow</dt><dd><p>{S(2,1)}</p></dd></dl></div></body></html>''',["Options",S(1),"--fast",S(1,1),"--slow",S(2,1)])
case("old_table2", f'''<html><body><center><table width="760"><tr><td><img src="logo.gif"></td><td><a href="/">home</a> | <a href="/m">mail</a></td></tr></table><table width="760"><tr><td width="160"><ul><li><a href="/1">news</a><li><a href="/2">links</a></ul></td><td width="600"><h2>Report</h2><p>{S(3)}<p>{S(2,1)}<p>{S(4,2)}</td></tr></table><hr><font size="1">&copy; 1999 us. All rights reserved.</font></center></body></html>''',["Report",S(3),S(2,1),S(4,2)])
case("blog", f'''<html><body><div id="header"><h1><a href="/">My garden</a></h1><div class="description">A diary of plants</div></div><div id="main"><div class="post hentry"><h2 class="entry-title">First frost</h2><div class="entry-content"><p>{S(2)}</p><p>{S(2,1)}</p><blockquote>{S(1,3)}</blockquote></div><div class="tags">Tagged: <a href="/t">frost</a>, <a href="/u">soil</a></div></div><div id="comments"><h3>2 responses</h3><ol><li><cite>Al</cite><p>{S(1)}</p></li><li><cite>Bo</cite><p>{S(2,2)}</p></li></ol><div id="respond"><h3>Leave a reply</h3><form><p>Your email will not be published.</p><textarea></textarea></form></div></div></div><div id="sidebar"><div class="widget"><h3>Recent posts</h3><ul><li><a href="/a">Roses in May</a></li></ul></div></div></body></html>''',["First frost",S(2),S(2,1),S(1,3)])
case("bare_table_data", f'''<html><body><article><h1>Costs</h1><p>{S(1)}</p><table><tr><td>Stone</td><td>12</td></tr><tr><td>Wood</td><td>7</td></tr></table></article></body></html>''',["Costs",S(1),"Stone","12","Wood","7"])
case("div_soup", f'''<html><body><div><div><div>Acme</div><div><a href="/">Shop</a></div></div><div><div><div>How we mend bridges</div><div>{S(2)}</div><div>{S(3,1)}</div><div>{S(3,2)}</div></div></div><div><div>We use cookies to make this site work. <a href="/c">Cookie policy</a></div><div>© Acme 2022</div></div></div></body></html>''',["How we mend bridges",S(2),S(3,1),S(3,2)])
case("essay_table", f'''<html><body><table><tr><td><a href="/i">Index</a> <a href="/n">Notes</a></td></tr><tr><td><p>{S(3)}</p><p>{S(3,1)}</p></td></tr></table></body></html>''',[S(3),S(3,1)])
# An article and nothing else, in wrappers that say nothing, and pages with little around it.
case("plain_div", f"<html><body><div><p>{S(2)}</p></div></body></html>", [S(2)])
case("fragment_div", "<div><p>Para one is a full sentence, with words enough.</p></div>", ["Para one is a full sentence, with words enough."])
case("one_sentence", f"<html><body><div><p>{S(1)}</p></div></body></html>", [S(1)])
case("three_words", "<html><body><div><p>Closed today.</p></div></body></html>", ["Closed today."])
case("one_word", "<html><body><div><div>word</div></div></body></html>", ["word"])
case("wrapped_thrice", f"<html><body><div><div><div class='x'><p>{S(3)}</p></div></div></div></body></html>", [S(3)])
case("long_paragraph", f"<html><body><div class='a'><div class='b'><p>{S(12)}</p></div></div></body></html>", [S(12)])
case("two_divs", f"<html><body><div><p>{S(1)}</p></div><div><p>{S(1,1)}</p></div></body></html>", [S(1), S(1,1)])
case("text_in_div", f"<html><body><div>{S(2)}</div></body></html>", [S(2)])
case("in_section", f"<html><body><section><p>{S(2)}</p></section></body></html>", [S(2)])
case("title_in_div", f"<html><body><div><h1>Title here</h1><p>{S(2)}</p></div></body></html>", ["Title here", S(2)])
case("spans_before_div", f"<html><body><div><span>One short line.</span><br><span>And another one</span><div>{S(2)}</div></div></body></html>", ["One short line. And another one", S(2)])
case("spans_before_p", f"<html><body><div><span>{S(1)}</span> <span>{S(1,1)}</span><div><p>{S(2,2)}</p></div></div></body></html>", [S(2), S(2,2)])
case("list_in_div", f"<html><body><div><p>{S(1)}</p><ul><li>one thing</li><li>two things</li></ul></div></body></html>", [S(1), "one thing", "two things"])
case("table_in_div", "<html><body><div><table><tr><td>a thing</td><td>12</td></tr><tr><td>other</td><td>7</td></tr></table></div></body></html>", ["a thing","12","other","7"])
case("site_name_main", f"<html><body><header><h1>My Site</h1></header><main><h1>Head</h1><p>{S(2)}</p></main></body></html>", ["Head", S(2)])
case("site_name_article", f"<html><body><header><h1>My Site</h1></header><article><h1>Head</h1><p>{S(2)}</p></article><footer><p>Copyright</p></footer></body></html>", ["Head", S(2)])
case("site_name_div", f"<html><body><header><h1>My Site</h1></header><div><h2>Head</h2><p>{S(3)}</p><p>{S(2)}</p></div></body></html>", ["Head", S(3), S(2)])
case("site_name_nav", f"<html><body><header><h1>Site of mine</h1><nav><a href='/'>Home</a><a href='/a'>About</a></nav></header><main><p>{S(1)}</p><p>{S(2,2)}</p></main><footer><p>All rights reserved</p></footer></body></html>", [S(1), S(2,2)])
case("nav_and_div", f"<html><body><nav><a href='/'>Home</a> <a href='/b'>Blog</a></nav><div><p>{S(2)}</p></div></body></html>", [S(2)])
case("div_and_footer", f"<html><body><div><p>{S(2)}</p><p>{S(1,1)}</p></div><footer>Copyright 2020</footer></body></html>", [S(2), S(1,1)])
case("notice", f"<html><body><div class='notice'><p>This site will be down on Monday.</p></div><article><h1>H</h1><p>{S(2)}</p></article></body></html>", ["H", S(2)])
# fmt: on


@pytest.fixture(scope="module")
def kept():
    return extract.default_model()


@pytest.mark.parametrize("name", CASES)
def test_page_written_by_hand(kept, name):
    page, want = CASES[name]
    assert extract.extract_texts([page], kept) == [want]


def test_pages_of_one_batch_do_not_touch_each_other(kept):
    assert extract.extract_texts([page for page, _ in CASES.values()], kept) == [want for _, want in CASES.values()]


@pytest.mark.parametrize("attribute", ['data-y="left"', 'data-y=""', 'title="pos y=top"', 'y="1"', "y=0", "y", "y='x'", "data-class='footer'", 'title="5\' tall"', "title='a \"b\" > c'", "alt=5\"", "=", "a = b"])
def test_attributes_of_a_page_are_never_labels(kept, attribute):
    page = f"<article><h1>Head</h1><p {attribute}>{S(2)}</p></article><div class=footer {attribute}>Copyright us</div>"
    assert extract.extract_texts([page], kept) == ["Head\n" + S(2)]
    forest = dom.Forest()
    forest.add(page)
    assert set(forest.label) == {None}


def test_labels_come_only_through_the_reader_of_training_pages():
    forest = dom.Forest(layouts.label_of)
    forest.add('<div class="a" y="0"><p y="1">one</p></div>')
    assert forest.label == [None, None, 0, 1]
    assert layouts.label_of(' class="a" y="0"') == (0, ' class="a"')


def test_fuzzed_pages_never_fail(kept):
    r = random.Random(5)
    pages = [page for page, _ in CASES.values()]
    bits = ["<", ">", '"', "'", "=", "</", "<!--", "-->", "<svg/>", "<svg>", "</p>", "<td>", "<li>", "&#x110000;", "&bogus;", "\x00", "<a href='", "<p y=", 'data-y="left"', "<textarea>", "</body>", "</html>", "<html>", "é", "\ud7ff"]
    for _ in range(600):
        page = r.choice(pages)
        for _ in range(r.randint(1, 12)):
            a = r.randrange(len(page) + 1)
            b = min(len(page), a + r.choice([0, 0, 1, 5, 40]))
            page = page[:a] + r.choice(bits) + page[b:]
        text = extract.extract_texts([page], kept)[0]
        assert isinstance(text, str) and "  " not in text and not text.startswith("\n")


def test_very_deep_and_very_wide_pages(kept):
    deep = "<div>" * 3000 + S(3) + "</div>" * 3000
    assert extract.extract_texts([f"<article><h1>Deep</h1>{deep}</article>"], kept)[0].startswith("Deep")
    wide = "".join(f"<p>{S(1, k)}</p>" for k in range(20_000))
    assert extract.extract_texts([f"<article>{wide}</article>"], kept)[0].count("\n") == 19_999
    assert extract.extract_texts(["</div>" * 20_000 + "<b>" * 20_000], kept) == [""]


_UNCLOSED = ["<p ", '<a b="', "<a b='", "<svg ", "<script ", "<!--", "<", "<x><li>", "<p a=\"'", "</p ", "<p =\"", "&amp", "<b class=x>"]


@pytest.mark.parametrize("bit", _UNCLOSED)
@pytest.mark.parametrize("end", ["", '=">"', ">", "-->", "</script>"])
def test_reading_takes_time_in_proportion(bit, end):
    """Eight times as much of what is never closed takes about eight times as long, however it ends."""

    def seconds(n):
        page = bit * (n // len(bit)) + end
        best = float("inf")
        for _ in range(3):
            began = time.perf_counter()
            dom.Forest().add(page)
            best = min(best, time.perf_counter() - began)
        return best

    assert seconds(320_000) < 30 * seconds(40_000) + 0.05


def test_a_tag_without_end_is_dropped_and_no_more():
    text = lambda page: ["".join(s for _, s in b) for b in _read(page).pages[0]]
    assert text("one <b two <i>three</i> four") == ["one three four"]
    assert text("a < b and 3 <4") == ["a < b and 3 <4"]
    assert text('<p title="a<b">x</p><p onclick=a<b>y</p>') == ["x", "y"]


def _read(page):
    forest = dom.Forest()
    forest.add(page)
    return forest


def test_training_finds_the_way_from_few_pages():
    model = extract.train(layouts.labelled_pages(240, seed=3), steps=100)
    forest = dom.Forest(layouts.label_of)
    for page in layouts.labelled_pages(60, seed=4):
        forest.add(page)
    t = forest.arrays()
    found = extract.marginals(t, extract.unary(t, model[0]), model[1])[0][:, 1] > 0.5
    told = [k for k, y in enumerate(forest.label) if y is not None]
    assert sum(found[k] == forest.label[k] for k in told) / len(told) > 0.94


def test_model_is_kept_and_read_back(tmp_path, kept):
    at = tmp_path / "model.json"
    extract.write_model(kept, at)
    assert at.read_text() == extract.MODEL.read_text()
