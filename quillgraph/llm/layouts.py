"""A grammar of page layouts: training pages for main-text extraction whose elements carry their label.

No table labels the pages, so the extractor learns from pages made here. A page is a
layout (marked-up, classed, neutral grid, bare divs, layout table or a fragment) of
boilerplate regions and one article; names, tags, lengths and order are drawn at random.
An element is labelled 1 if all text under it belongs to the article, but for boilerplate
that stands inside the article.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Callable

from .dom import CUES

PAGES, SEED = 2600, 13
#: Fragments for each page of a whole layout; shares of wrapped articles and of sparse pages among them, to 7 of other kinds.
FRAGMENTS, WHOLE, SPARSE = 0.4, 5, 6
#: Share of whole pages that are made of divs alone.
SOUP = 0.08
_LABEL = re.compile(r' y="([01])"')

_CONTENT = "article post entry content story main text body prose page document".split()
_NOISE = {
    "nav": "nav menu navigation navbar links topics breadcrumb breadcrumbs pagination pager toc categories".split(),
    "header": "header top masthead branding logo banner topbar site".split(),
    "footer": "footer bottom copyright legal colophon imprint credits".split(),
    "more": "sidebar side widget related recommended popular trending aside archive rail more".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion banner adbox dfp partner".split(),
    "cookie": "cookie cookies notice consent gdpr alert notification warning message popup modal overlay paywall".split(),
    "sign": "form search login subscribe contact newsletter register field signup".split(),
    "talk": "comment comments reply replies discussion responses thread disqus respond feedback".split(),
    "share": "share social follow sharing buttons tags meta".split(),
}
_CUES_OF = {"nav": "menu", "header": "menu", "footer": "legal"}
_NEUTRAL = "box row col wrap wrapper container inner outer block section c grid item unit x page".split()
_ANY_CUE = " ".join(CUES.values()).split()
_BYLINE = "byline author meta date dateline posted info published".split()


def label_of(attributes: str) -> tuple[int | None, str]:
    """The label of an element of a training page, and its attributes without it."""
    found = _LABEL.search(attributes)
    return (int(found[1]), _LABEL.sub("", attributes)) if found else (None, attributes)


class _Writer:
    """Draws pages; every method returns HTML."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.named = 1.0  # how likely boilerplate of the page at hand says in a class or tag what it is

    # ---- words

    def words(self, k: int, cued: float = 0.06) -> str:
        """k words; now and then one of them is a cue word, as it may be in any article."""
        r = self.r
        said = ["".join(r.choice("abcdefghilmnoprstuvé") for _ in range(r.randint(2, 9))) for _ in range(k)]
        if said and r.random() < cued:
            said[r.randrange(k)] = r.choice(_ANY_CUE)
        return " ".join(said)

    def sentences(self, k: int) -> str:
        """About k words in sentences."""
        r, out = self.r, []
        while k > 0:
            n = min(k, r.randint(4, 18))
            said = self.words(n)
            if n > 8 and r.random() < 0.5:
                said = said.replace(" ", ", ", 1)
            out.append(said.capitalize() + r.choice("....?!"))
            k -= n
        return " ".join(out)

    def length(self, scale: float) -> int:
        return int(math.exp(self.r.uniform(0, scale)))

    def cue(self, group: str) -> str:
        r = self.r
        return " ".join(r.choice(CUES[group].split()) for _ in range(r.choice([1, 1, 2]))).capitalize()

    # ---- elements

    def el(self, tag: str, y: int, inner: str, names: list[str] | None = None) -> str:
        return f'<{tag}{self.attrs(names)} y="{y}">{inner}</{tag}>'

    def plain(self, tag: str, y: int, inner: str) -> str:
        return f'<{tag} y="{y}">{inner}</{tag}>'

    def attrs(self, names: list[str] | None) -> str:
        r = self.r
        if names is None:
            name = r.choice(_NEUTRAL) + r.choice(["", "", "-" + str(r.randint(1, 12))]) if r.random() < 0.4 else ""
        else:
            name = r.choice(names) + r.choice(["", "", "", "-" + r.choice(_NEUTRAL), "_" + r.choice(_NEUTRAL), " " + r.choice(_NEUTRAL)])
        return f' {r.choice(["class", "class", "id"])}="{name}"' if name else ""

    def wrap(self, y: int, inner: str, most: int = 3) -> str:
        for _ in range(self.r.choice([0] * 3 + list(range(1, most + 1)))):
            inner = self.el(self.r.choice(["div", "div", "div", "section"]), y, inner)
        return inner

    def links(self, k: int) -> str:
        r, tag = self.r, self.r.choice(["li", "li", "br", "bar", "div"])
        cue = lambda: self.cue("menu") if r.random() < 0.3 else self.words(r.randint(1, 6))
        made = [f'<a href="/x">{cue()}</a>' for _ in range(k)]
        if tag == "li":
            return self.el(r.choice(["ul", "ul", "ol"]), 0, "".join(self.plain("li", 0, a) for a in made))
        if tag == "div":
            return "".join(self.plain("div", 0, a) for a in made)
        return ("<br>" if tag == "br" else r.choice([" | ", " ", " &middot; "])).join(made)

    # ---- boilerplate

    def noise(self, kind: str, inside: bool = False) -> str:
        """A boilerplate region: one that stands inside the article, and most of the others, says what it is by tag, name or cue word."""
        r = self.r
        said = r.random() < (0.9 if inside else self.named)
        names = _NOISE[kind] if said else None
        cues = _CUES_OF.get(kind, kind)
        tag = {"nav": "nav", "header": "header", "footer": "footer", "more": "aside", "sign": "form"}.get(kind, "section") if said and r.random() < 0.5 else "div"
        if tag in ("nav", "header", "footer", "aside", "form") and r.random() < 0.6:
            names = None
        cued = lambda n: self.cue(cues) + " " + (self.sentences(n) if r.random() < 0.5 else self.words(n))
        if kind == "nav":
            return self.el(tag, 0, (self.links if r.random() < 0.9 or inside else lambda k: self.plain("ul", 0, "".join(self.plain("li", 0, self.words(r.randint(1, 3))) for _ in range(k))))(r.randint(2, 12)), names)
        if kind == "header":
            parts = [r.choice([self.plain("h1", 0, f'<a href="/">{self.words(2)}</a>'), self.el("div", 0, self.words(r.randint(1, 3)), _NOISE["header"]), f'<a href="/">{self.words(2)}</a>', self.plain("p", 0, self.words(r.randint(2, 8))), *[self.plain(r.choice(["h1", "h1", "h2"]), 0, self.words(r.randint(1, 4)))] * 2])]
            if not said and r.random() < 0.4:
                parts = [self.plain("div", 0, self.words(r.randint(1, 3)))]
            return self.el(tag, 0, "".join(parts) + r.choice(["", self.noise("nav")]), names or (_NOISE["header"] if tag == "div" else None))
        if kind == "footer":
            legal = r.choice(["&copy; ", "Copyright ", "&copy; 2020 "]) + self.words(r.randint(1, 20)) + r.choice(["", ". All rights reserved."])
            return self.el(tag, 0, r.choice([self.plain("p", 0, legal), legal, self.plain("div", 0, legal) + self.links(3), self.links(r.randint(2, 6))]), names)
        if kind == "more":
            head = self.cue("more") if not said or r.random() < 0.4 else self.words(r.randint(1, 3))
            body = r.choice([self.links(r.randint(2, 8)), self.plain("p", 0, self.sentences(r.randint(8, 60)))]) if said else self.links(r.randint(2, 8))
            return self.el(tag, 0, self.plain(r.choice(["h2", "h3", "h4", "div", "b"]), 0, head) + body, names)
        if kind == "sign":
            return self.plain("form", 0, r.choice([cued(r.randint(1, 9)), self.plain("label", 0, self.words(2)) + self.plain("p", 0, cued(r.randint(3, 30)))]) + '<input name="q">' + r.choice(["", self.plain("button", 0, self.cue("sign"))])) if r.random() < 0.6 else self.el("div", 0, self.plain("p", 0, cued(r.randint(2, 20))), names or _NOISE["sign"])
        if kind == "talk":
            scale = r.uniform(1.5, 5)
            who = lambda: r.choice(["", self.plain(r.choice(["h4", "b", "div"]), 0, self.words(r.randint(1, 3)))])
            one = lambda: self.el(r.choice(["div", "li", "section", "div", "li", "article"]), 0, who() + "".join(self.plain("p", 0, self.sentences(self.length(scale))) for _ in range(r.randint(1, 3))), _NOISE["talk"])
            return self.el(r.choice(["section", "div", "ol", "aside"]), 0, r.choice(["", self.plain(r.choice(["h2", "h3"]), 0, self.cue("talk"))]) + "".join(one() for _ in range(r.randint(1, 5))), _NOISE["talk"])
        if kind == "share":
            return self.el(r.choice(["div", "ul", "p"]), 0, self.cue("share") + " " + self.links(r.randint(1, 4)) if r.random() < 0.6 else " ".join(self.cue("share") for _ in range(r.randint(1, 3))), _NOISE["share"])
        many = self.length(4.5)
        if kind == "cookie" and (not said or r.random() < 0.5):
            text = self.sentences(many // 2) + " " + self.cue("cookie") + " " + self.sentences(many // 2)
        else:
            text = cued(many) if not said else self.sentences(many)
        return self.el(r.choice(["div", "div", "p", "section", "aside"]), 0, text if r.random() < 0.5 else self.plain("p", 0, text) + r.choice(["", self.plain("button", 0, self.cue(cues))]), names or _NOISE[kind])

    # ---- the article

    def prose(self, n: int) -> str:
        r = self.r
        text = self.sentences(n) if r.random() < 0.85 else self.words(n)
        x = r.random()
        if x < 0.15:
            text += f' <a href="/y">{self.words(r.randint(1, 4))}</a> ' + self.sentences(n)
        elif x < 0.25:
            text = f"<b>{self.words(2)}</b> {text}"
        return text

    def block(self, kind: str, scale: float) -> str:
        r, n, one = self.r, self.length(scale), 1
        if kind == "p":
            return self.plain("p", one, self.prose(n))
        if kind == "div":
            return self.el("div", one, self.prose(n + 4)) if r.random() < 0.7 else self.el("div", one, self.plain("p", one, self.prose(n)))
        if kind == "head":
            return self.plain(r.choice(["h2", "h3", "h4"]), one, self.words(r.randint(1, 7), 0.2))
        if kind == "list":
            item = lambda: r.choice([self.words, self.sentences])(r.randint(1, 20)) + (self.plain("ul", one, self.plain("li", one, self.words(3))) if r.random() < 0.05 else "")
            return self.plain(r.choice(["ul", "ol"]), one, "".join(self.plain("li", one, item()) for _ in range(r.randint(1, 8))))
        if kind == "dl":
            return self.plain("dl", one, "".join(self.plain("dt", one, self.words(r.randint(1, 3))) + self.plain("dd", one, r.choice([self.words, self.sentences])(r.randint(2, 20))) for _ in range(r.randint(1, 5))))
        if kind == "quote":
            return self.plain("blockquote", one, self.plain("p", one, self.prose(n)) if r.random() < 0.7 else self.prose(n))
        if kind == "code":
            code = "\n".join(self.words(r.randint(1, 4)) for _ in range(r.randint(1, 6)))
            pre = self.plain("pre", one, code if r.random() < 0.5 else f"<code>{code}</code>")
            return pre if r.random() < 0.6 else self.el("div", one, pre, ["highlight", "code", "source", "listing"])
        if kind == "figure":
            caption = self.plain("figcaption", one, r.choice([self.words, self.sentences])(r.randint(2, 14)))
            return self.plain("figure", one, '<img src="x.png">' + caption)
        if kind == "table":
            cell = lambda tag: self.plain(tag, one, self.words(r.randint(1, 4)))
            k = r.randint(2, 4)
            head = self.plain("tr", one, "".join(cell("th") for _ in range(k)))
            rows = "".join(self.plain("tr", one, "".join(cell("td") for _ in range(k))) for _ in range(r.randint(1, 6)))
            return self.plain("table", one, self.plain("thead", one, head) + self.plain("tbody", one, rows) if r.random() < 0.5 else r.choice(["", head]) + rows)
        if kind == "details":
            return self.plain("details", one, self.plain("summary", one, self.words(r.randint(1, 5))) + r.choice([self.plain("p", one, self.prose(n)), self.prose(n)]))
        if kind == "section":
            return self.el(r.choice(["section", "section", "div"]), one, self.plain("h2", one, self.words(r.randint(1, 6))) + "".join(self.block(r.choice(["p", "p", "p", "list", "code", "quote", "table"]), scale) for _ in range(r.randint(1, 4))))
        if kind == "spans":  # text of the wrapper's own before a nested block
            said = [f"<span>{r.choice([self.words, self.sentences])(r.randint(2, 16))}</span>" for _ in range(r.randint(1, 3))]
            return self.el("div", one, r.choice(["", " ", "<br>"]).join(said) + self.el("div", one, self.prose(n + 4)))
        if kind == "verse":
            lines = "<br>".join(self.words(r.randint(2, 9)) for _ in range(r.randint(2, 12)))
            return r.choice([lines, self.plain("p", one, lines), self.el("div", one, lines)])
        return r.choice(["<br>", "<br><br>"]).join(self.prose(n) for _ in range(r.randint(1, 4)))  # bare text

    def title(self, within: bool = True) -> str:
        """A heading and perhaps a byline; in a header only where an element of the article stands around it."""
        r = self.r
        head = self.plain(r.choice(["h1", "h1", "h1", "h2"]), 1, self.words(r.randint(1, 10), 0.2))
        if r.random() < 0.45:
            link = f'<a href="/u">{self.words(r.randint(1, 3))}</a>'
            by = r.choice([f"By {self.words(2)}", f"By {link}, {self.words(2)}", f"By {link}", f"{self.words(1)} {link}", f"<time>{self.words(2)}</time>", self.words(r.randint(2, 6))])
            head += self.el(r.choice(["p", "div", "address"]), 1, by, r.choice([_BYLINE, None]))
        if within and r.random() < 0.25:
            head = self.plain(r.choice(["header", "header", "div"]), 1, head)
        return head

    def blocks(self) -> list[str]:
        r, scale = self.r, self.r.uniform(1.5, 6)
        main = r.choice(["p"] * 8 + ["div", "div", "bare", "bare", "section", "verse", "spans"])
        kinds = [main] * 12 + "head head list list dl quote code figure table details bare p section".split()
        out = [self.block(r.choice(kinds), scale) for _ in range(r.choice([1, 1, 2, 3, 4, 5, 8, 12, 20, 30, 80]))]
        if r.random() < 0.8:
            out.insert(0, self.title())
        if r.random() < 0.45:
            for _ in range(r.randint(1, 2)):
                out.insert(r.randint(0, len(out)), self.noise(r.choice(["ad", "share", "more", "cookie", "sign", "nav"]), inside=True))
        if r.random() < 0.15:
            out.append(self.noise("talk"))
        return out

    def article(self, neutral: float = 0.0) -> str:
        r, inner = self.r, "".join(self.blocks())
        if r.random() < 0.3:
            inner = self.wrap(1, inner)
        if r.random() < neutral:
            return self.wrap(1, self.el("div", 1, inner))
        x = r.random()
        if x < 0.4:
            return self.el("article", 1, inner, r.choice([None, _CONTENT]))
        if x < 0.52:
            return self.el("main", 1, inner)
        return self.wrap(1, self.el(r.choice(["div", "div", "section"]), 1, inner, _CONTENT))

    # ---- pages

    def page(self) -> str:
        r = self.r
        if r.random() < SOUP:
            return self.page_of(self.soup())
        layout = r.choice(["named"] * 5 + ["grid", "grid", "bare", "bare", "bare", "table"])
        self.named = {"named": 0.95, "grid": 0.6, "bare": 0.25, "table": 0.15}[layout]
        before = [self.noise(k) for k in r.sample(["nav", "header", "ad", "cookie", "sign", "nav"], r.randint(0, 4))]
        after = [self.noise(k) for k in r.sample(["footer", "more", "talk", "ad", "share", "cookie", "sign", "nav", "footer"], r.randint(0, 5))]
        sides = [self.noise(r.choice(["nav", "more", "nav"])) for _ in range(r.choice([0, 1, 1, 2]))]
        middle = self.article({"named": 0.05, "grid": 0.6, "bare": 0.85, "table": 1.0}[layout])
        if layout == "table":
            return self.page_of(self.layout_table(before[:2], sides, after[:2]))
        if sides and r.random() < (0.35 if layout == "named" else 0.75):
            parts = [middle, *sides]
            r.shuffle(parts)
            middle = self.wrap(0, self.el("div", 0, "".join(self.el("div", 0, x) if x is not middle and r.random() < 0.4 else x for x in parts)))
        before, after = (self.grouped(x) for x in (before, after))
        inner = "".join([*before, middle, *after])
        return self.page_of(self.wrap(0, inner) if r.random() < 0.6 and (before or after) else inner)

    def soup(self) -> str:
        """A page of nothing but divs that say nothing; boilerplate is told by links and cue words alone."""
        r, div = self.r, lambda y, inner: self.el("div", y, inner)
        lines = [self.words(r.randint(1, 8))] * (r.random() < 0.7) + [self.prose(self.length(5) + 4) for _ in range(r.randint(1, 6))]
        text = "".join(div(1, x) for x in lines)
        text = div(1, text) if r.random() < 0.7 else text
        name = div(0, self.words(r.randint(1, 3)))
        top = r.choice([name, ""]) + r.choice([div(0, self.links(r.randint(1, 5))), self.links(r.randint(1, 5))])
        told = self.sentences(r.randint(2, 9)) + " " + self.cue("cookie") + r.choice(["", f' <a href="/c">{self.cue("cookie")} {self.words(1)}</a>'])
        legal = r.choice(["&copy; ", "Copyright "]) + self.words(r.randint(1, 4)) + r.choice(["", " 2021", ". All rights reserved."])
        ends = [div(0, x) for x in r.sample([told, legal, legal, self.links(3)], r.randint(1, 2))]
        inner = div(0, top) * (r.random() < 0.8) + (div(1, text) if r.random() < 0.6 else text) + (div(0, "".join(ends)) if r.random() < 0.7 else "".join(ends))
        return div(0, inner) if r.random() < 0.6 else inner

    def grouped(self, regions: list[str]) -> list[str]:
        """Now and then regions of boilerplate stand in one wrapper."""
        return [self.el("div", 0, "".join(regions))] if len(regions) > 1 and self.r.random() < 0.4 else regions

    def page_of(self, inner: str) -> str:
        return "<html><head><title>x</title></head>" + self.plain("body", int(' y="0"' not in inner), inner) + "</html>"

    def layout_table(self, before: list[str], sides: list[str], after: list[str]) -> str:
        r = self.r
        inner = "".join(self.blocks())
        if r.random() < 0.3:
            inner = self.el("div", 1, inner)
        text = self.plain("td", 1, f'<font size="2">{inner}</font>' if r.random() < 0.3 else inner)
        cells = [self.plain("td", 0, r.choice([self.links(r.randint(2, 8)), side])) for side in sides] or [self.plain("td", 0, self.links(3))]
        cells.insert(r.randint(0, len(cells)), text)
        rows = [self.plain("tr", 0, self.plain("td", 0, x)) for x in before] + [self.plain("tr", 0, "".join(cells))] + [self.plain("tr", 0, self.plain("td", 0, x)) for x in after]
        table = self.plain("table", 0, "".join(rows))
        if r.random() < 0.6:
            return table
        legal = f"<hr><font size=\"1\">{r.choice(['&copy; ', 'Copyright '])}{self.words(r.randint(1, 6))}. {r.choice(['', 'All rights reserved.'])}</font>"
        return self.plain("center", 0, table + r.choice(["", legal, legal]))

    def lone(self) -> str:
        """An article of one to three blocks, in up to four wrappers that say nothing."""
        r, scale = self.r, self.r.uniform(1.5, 5)
        kinds = ["p"] * 6 + ["div", "div", "bare", "spans", "list", "quote", "verse"]
        inner = "".join(self.block(r.choice(kinds), scale) for _ in range(r.randint(1, 3)))
        if r.random() < 0.4:
            inner = self.title(False) + inner
        for _ in range(r.randint(0, 4)):
            inner = r.choice([self.plain, self.el])(r.choice(["div", "div", "div", "section"]), 1, inner)
        return inner

    def sparse(self) -> str:
        """Such an article between one or two regions of boilerplate that say what they are."""
        r = self.r
        self.named = 0.95
        before = [self.noise(r.choice(["nav", "header", "header"])) for _ in range(r.choice([0, 1, 1]))]
        after = [self.noise(r.choice(["footer", "footer", "cookie", "nav"])) for _ in range(1 - len(before) if r.random() < 0.5 else 1)]
        return self.page_of("".join([*before, self.lone(), *after]))

    def whole(self) -> str:
        return self.page_of(self.lone()) if self.r.random() < 0.8 else self.lone()

    def fragment(self) -> str:
        """Pages without boilerplate: an article, its blocks or plain text alone."""
        r = self.r
        whole = lambda inner: f'<body y="1">{inner}</body>'
        makers: list[Callable[[], str]] = [
            *[self.whole] * WHOLE,
            *[self.sparse] * SPARSE,
            lambda: self.article(0.3),
            lambda: "".join(self.block(r.choice(["p", "p", "list", "head", "dl"]), 4) for _ in range(r.randint(1, 6))),
            lambda: self.plain("article", 1, self.plain("p", 1, self.prose(self.length(4)))),
            lambda: whole(self.prose(self.length(5))),
            lambda: whole(f"{self.words(self.length(4))}<br>{self.prose(self.length(5))}"),
            lambda: whole(self.words(self.length(4)) + self.plain("p", 1, self.prose(self.length(5)))),
            lambda: whole(self.title(False) + self.wrap(1, "".join(self.block("p", 4) for _ in range(3)))),
        ]
        return r.choice(makers)()


def labelled_pages(n: int = PAGES, seed: int = SEED) -> list[str]:
    """n pages of whole layouts after n * FRAGMENTS fragments, the same for the same seed."""
    w = _Writer(seed)
    return [w.fragment() for _ in range(int(n * FRAGMENTS))] + [w.page() for _ in range(n)]
