"""A fast, forgiving HTML reader: block elements as a forest, and the text of each."""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np

#: Hash space of tag, class and id features; after it come the numeric ones.
HASHED = 1 << 13
LENGTHS, DENSITIES, SHARES = 10, 5, 8
#: Words that boilerplate likes, in groups, in the languages of the web's larger part; a hint beside structure, never a rule.
CUES = {
    "legal": "copyright © (c) rights reserved privacy imprint impressum datenschutz agb rechte vorbehalten droits réservés mentions légales derechos reservados privacidad terms webmaster",
    "cookie": "cookie cookies consent accept gdpr einwilligung akzeptieren zustimmen accepter consentement aceptar consentimiento",
    "sign": "subscribe newsletter sign signup login log register password email e-mail abonnieren anmelden registrieren abonnez-vous inscription connexion suscríbete suscribirse registrarse search suche recherche buscar",
    "share": "share tweet facebook twitter whatsapp pinterest linkedin follow teilen folgen partager suivez compartir seguir print tags tagged filed",
    "more": "related popular trending recommended most read latest mehr beliebt ähnliche meistgelesen verwandte populaires similaires recommandés relacionados populares recomendados archives categories recent",
    "talk": "comments comment reply replies responses discussion kommentare kommentar antworten commentaires répondre comentarios responder respuestas",
    "ad": "advertisement advert sponsored promoted anzeige werbung gesponsert publicité sponsorisé publicidad patrocinado sponsor",
    "menu": "home menu navigation skip contact about startseite kontakt accueil inicio contacto next previous back top sitemap",
}
_CUE = {w + end: k for k, group in enumerate(CUES.values()) for w in group.split() for end in ("", ".", ",", ":", "!", "?")}
_CUE_WORDS = frozenset(_CUE)
#: Numeric features: first column of each group.
_SIZE = HASHED
_DIRECT = _SIZE + LENGTHS
_LINKED = _DIRECT + LENGTHS
_SHARE = _LINKED + LENGTHS * DENSITIES
_KIN = _SHARE + SHARES * 2
_PLACE = _KIN + SHARES
_ENDS = _PLACE + 4 * 3
_PROSE = _ENDS + 4 * 4
_CUED = _PROSE + 8
_CUED_UNDER = _CUED + len(CUES)
_TITLED = _CUED_UNDER + len(CUES)
_KINDS_OF_CUE = _TITLED + len(CUES)
FEATURES = _KINDS_OF_CUE + 8
_CLASSES = {t: k + 1 for k, group in enumerate("html,body div,span,center section article main aside nav header footer,address form,fieldset ul,ol,menu dl li dt,dd p h1 h2,h3,h4,h5,h6 blockquote,q pre,code table,tbody,thead,tfoot tr td,th figure,figcaption a,b,i,em,strong,font details,summary".split()) for t in group.split(",")}
_KINDS = max(_CLASSES.values()) + 1
EDGES = _KINDS * _KINDS

#: Attributes of a tag: a quote opens a value only after an equals sign. One "<" may stand outside of quotes; a second begins
#: another tag, so that what a tag without end costs is bounded by the next two and not by the rest of the page.
_PLAIN = r"(?:[^<>\"'=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[\"'=])*+"
_INSIDE = rf"{_PLAIN}(?:<{_PLAIN})?+"
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    rf"|<(script|style|noscript|template|svg(?!{_INSIDE}(?<=/)>)|title|textarea|iframe)(?=[\s/>]){_INSIDE}>.*?(?:</\1\s*+>|\Z)"
    rf"|<(/?)([a-zA-Z][^\s/<>]*+)({_INSIDE})>"
    r"|</?[a-zA-Z!?][^<>]*+>"
    r"|<[a-zA-Z/!][^<>]*+(?=<|\Z)",
    re.S | re.I,
)
#: One attribute, its name read whole, so that data-class is not class.
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_READ = frozenset(("class", "id", "role", "itemprop"))
_NAME = re.compile(r"[a-z]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo big br cite code del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Tags that an implied end cannot pass.
_WALLS = frozenset("ul ol table div section article main aside body html nav header footer form dl blockquote".split())
_known: dict[tuple[str, str, str], tuple] = {}


def _hash(word: str) -> int:
    return zlib.crc32(word.encode()) % HASHED


def attribute_values(attributes: str) -> Iterator[tuple[str, str]]:
    """(name, value) of each attribute, names in lower case."""
    for name, *values in _ATTRIBUTE.findall(attributes):
        yield name.lower(), next((v for v in values if v), "")


def describe(above: str, tag: str, attributes: str) -> tuple[tuple[int, int], tuple[int, ...], int]:
    """Feature ids of the tag and of names, and edge type (parent's tag and own) of an element."""
    if (have := _known.get((above, tag, attributes))) is not None:
        return have
    ids = set()
    for name, value in attribute_values(attributes):
        if name in _READ:
            for word in _NAME.findall(value.lower()):
                ids.add(_hash("." + word))
                if word.endswith("s"):
                    ids.add(_hash("." + word[:-1]))
    out = ((_hash("<" + tag), _hash(above + "<" + tag)), tuple(sorted(ids)), _CLASSES.get(above, 0) * _KINDS + _CLASSES.get(tag, 0))
    if len(_known) > 20_000:
        _known.clear()
    _known[above, tag, attributes] = out
    return out


class Forest:
    """Nodes of many pages in one set of arrays; node order is document order, so a parent comes before its children."""

    def __init__(self, label_of: Callable[[str], tuple[int | None, str]] | None = None) -> None:
        """``label_of`` gives the label that the generator of training pages put into an element's attributes, and the other attributes; pages of a table are read without it."""
        self.label_of = label_of
        self.tag: list[str] = []
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.edge: list[int] = []
        self.label: list[int | None] = []
        #: Two tag features of each node; class and id words as (node, feature) in two lists.
        self.tagged: list[int] = []
        self.sparse_node: list[int] = []
        self.sparse_feature: list[int] = []
        self.own: list[int] = []
        self.linked: list[int] = []
        self.ends: list[int] = []
        self.words: list[int] = []
        self.titled: list[int] = []
        #: (node, group of cue words) for each cue word of a node's own text.
        self.cues: list[tuple[int, int]] = []
        #: First node of each page.
        self.roots: list[int] = []
        #: One list for each page: blocks, each a list of (node, text).
        self.pages: list[list[list[tuple[int, str]]]] = []

    def _node(self, parent: int, tag: str, attributes: str) -> int:
        label, attributes = self.label_of(attributes) if self.label_of else (None, attributes)
        tagged, ids, edge = describe(self.tag[parent] if parent >= 0 else "", tag, attributes)
        k = len(self.parent)
        self.tag.append(tag)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.edge.append(edge)
        self.label.append(label)
        self.tagged += tagged
        self.sparse_node += [k] * len(ids)
        self.sparse_feature += ids
        self.own.append(0)
        self.linked.append(0)
        self.ends.append(0)
        self.words.append(0)
        self.titled.append(-2)
        return k

    def add(self, page: str) -> None:
        """Read one page, whole."""
        root = self._node(-1, "html", "")
        self.roots.append(root)
        stack: list[tuple[str, int]] = [("html", root)]
        opened: Counter[str] = Counter()
        blocks: list[list[tuple[int, str]]] = []
        block: list[tuple[int, str]] = []
        at = links = 0
        node = root

        def begin() -> None:
            """A body of its own for content that comes before any."""
            nonlocal node
            node = self._node(root, "body", "")
            push("body", node)

        def push(tag: str, k: int) -> None:
            stack.append((tag, k))
            opened[tag] += 1

        def pop() -> str:
            tag = stack.pop()[0]
            opened[tag] -= 1
            return tag

        def text(piece: str) -> None:
            if piece:
                if len(stack) == 1 and not piece.isspace():
                    begin()
                if "&" in piece:
                    piece = html.unescape(piece)
                block.append((node, piece))
                if n := len(piece) - piece.count(" "):
                    self.own[node] += n
                    if links:
                        self.linked[node] += n
                    told = piece.lower().split()
                    self.words[node] += len(told)
                    if told:
                        self.ends[node] += told[-1][-1] in ".!?。！？…" or ". " in piece
                        cues = [_CUE[x] for x in told if x in _CUE] if not _CUE_WORDS.isdisjoint(told) else []
                        self.cues += [(node, c) for c in cues]
                        if self.titled[node] == -2:  # the first text under this node and under those around it that had none
                            first, k = cues[0] if cues and len(told) < 8 else -1, node
                            while k >= 0 and self.titled[k] == -2:
                                self.titled[k] = first
                                k = self.parent[k]

        for m in _TOKEN.finditer(page):
            if m.start() > at:
                text(page[at : m.start()])
            at = m.end()
            tag = m[3]
            if tag is None:
                if m[1] is not None and block:
                    block.append((node, " "))
                continue
            tag = tag.lower()
            if tag == "svg" and not m[2]:  # self-closed, or the pattern would have taken its content
                if block:
                    block.append((node, " "))
                continue
            inline = tag in _INLINE
            if len(stack) == 1 and not m[2] and tag not in ("html", "head", "body", "meta", "link", "base"):
                begin()
            if m[2]:
                if tag == "a":
                    links = max(0, links - 1)
                if not opened[tag]:
                    if not inline and block:
                        blocks.append(block)
                        block = []
                    continue
                if inline:
                    # an inline end does not close blocks
                    k = len(stack) - 1
                    while k and stack[k][0] != tag and stack[k][0] in _INLINE:
                        k -= 1
                    if stack[k][0] == tag:
                        while len(stack) > k:
                            pop()
                        node = stack[-1][1]
                    continue
                while pop() != tag:
                    pass
                node = stack[-1][1]
                if block:
                    blocks.append(block)
                    block = []
                continue
            if inline:
                if tag == "br":
                    block.append((node, " "))
                    continue
                if tag == "a":
                    links += 1
                if tag != "a" and ("class" in m[4] or "id=" in m[4]) and tag not in _VOID and not m[4].endswith("/"):
                    node = self._node(node, tag, m[4])
                    push(tag, node)
                continue
            if block:
                blocks.append(block)
                block = []
            links = 0
            if tag in _VOID:
                continue
            if tag == "html" or tag == "body" and len(stack) > 1:
                continue
            while len(stack) > 1 and stack[-1][0] in _INLINE:
                pop()
            shut = _CLOSES.get(tag, ())
            k = len(stack) - 1
            if shut:
                while k and stack[k][0] not in _WALLS and stack[k][0] not in shut:
                    k -= 1
                if stack[k][0] in shut:
                    while len(stack) > k:
                        pop()
            if stack[-1][0] == "p":
                pop()
            node = self._node(stack[-1][1], tag, m[4])
            push(tag, node)
        if at < len(page):
            text(page[at:])
        if block:
            blocks.append(block)
        self.pages.append(blocks)

    def arrays(self) -> dict[str, np.ndarray]:
        """The nodes with sparse (node, feature, value) triples, and levels of the forest."""
        parent, depth = np.array(self.parent, np.int64), np.array(self.depth, np.int64)
        own, linked = np.array(self.own, np.int64), np.array(self.linked, np.int64)
        order = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[order], np.arange(depth.max() + 2)) if len(depth) else np.zeros(1, np.int64)
        levels = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        ends, words = np.array(self.ends, np.int64), np.array(self.words, np.int64)
        plain = own - linked
        cue = np.zeros((len(parent), len(CUES)))
        if self.cues:
            np.add.at(cue, tuple(np.array(self.cues, np.int64).T), 1)
        prose = ((ends > 0) & (words - linked // 5 > 6)).astype(np.int64)
        under, under_links, under_plain, under_prose, under_words, under_cue = own.copy(), linked.copy(), plain.copy(), prose.copy(), words.copy(), cue.copy()
        for level in levels[:0:-1]:
            for total in (under, under_links, under_plain, under_prose, under_words, under_cue):
                np.add.at(total, parent[level], total[level])
        n, edge = np.arange(len(parent)), np.array(self.edge, np.int64)
        bucket = lambda x, most: np.minimum(np.log2(x + 1).astype(np.int64), most - 1)
        size, direct = bucket(under, LENGTHS), bucket(own, LENGTHS)
        density = np.minimum(under_links * DENSITIES // np.maximum(under, 1), DENSITIES - 1)
        roots = np.array(self.roots, np.int64)
        page = np.repeat(np.arange(len(roots)), np.diff(np.append(roots, len(parent))))
        whole = under_plain[roots][page] if len(roots) else under_plain
        parts = lambda x, of: np.minimum(x * SHARES // np.maximum(of, 1), SHARES - 1)
        share, kin_share = parts(under_plain, whole), parts(under_plain, under_plain[np.maximum(parent, 0)])
        so_far = np.cumsum(plain) - plain  # plain text before each node, in document order
        before = so_far - (so_far[roots][page] if len(roots) else 0)
        edge_of_page = (before * 50 < whole) * 2 + ((whole - before - under_plain) * 50 < whole)
        _, kin, count = np.unique((parent + 1) * EDGES + edge, return_inverse=True, return_counts=True)
        alone = 1.0 / count[kin]  # siblings of one tag tell together what one of them tells
        tagged = np.array(self.tagged, np.int64)
        numeric = [
            tagged[::2],
            tagged[1::2],
            _SIZE + size,
            _DIRECT + direct,
            _LINKED + size * DENSITIES + density,
            _SHARE + share * 2 + (density > 1),
            _KIN + kin_share,
            _PLACE + edge_of_page * 3 + np.minimum(share, 2),
            _ENDS + np.minimum(ends, 3) * 4 + np.minimum(direct // 3, 3),
            _PROSE + bucket(under_prose, 8),
            _KINDS_OF_CUE + np.minimum((under_cue > 0).sum(1), 3) * 2 + (under_links > 0),
        ]
        at_own, at_under = np.nonzero(cue), np.nonzero(under_cue)
        titled = np.array(self.titled, np.int64)
        with_title = np.flatnonzero(titled >= 0)
        node = np.concatenate([np.array(self.sparse_node, np.int64), *[n] * len(numeric), at_own[0], at_under[0], with_title])
        feature = np.concatenate([np.array(self.sparse_feature, np.int64), *numeric, _CUED + at_own[1], _CUED_UNDER + at_under[1], _TITLED + titled[with_title]])
        told = np.minimum(4 * cue[at_own] / np.maximum(words[at_own[0]], 1), 1.0)
        told_under = np.minimum(4 * under_cue[at_under] / np.maximum(under_words[at_under[0]], 1), 1.0)
        value = np.concatenate([np.ones(len(self.sparse_node)), *[alone] * len(numeric), told, told_under, np.ones(len(with_title))])
        return {"parent": parent, "edge": edge, "node": node, "feature": feature, "value": value, "levels": levels}
