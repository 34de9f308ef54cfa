"""Main text of web pages by wrapper induction.

Pages of one host share a template. A few reference pages per host are parsed
into DOM trees and aligned by simple tree matching; nodes whose text stays the
same over references with different articles are the host's template, nodes
whose text varies are content slots. Every page is then aligned with its
host's template tree. Inside what markup itself names as the article only
parts that are constant or named as something else go, prose if over half of
the references, and three at least, show it at its place; where nothing is
named, the varying slots outside menus and other link lists are the article.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import saved, table

#: Reference pages per host (the documented bound of what a template is induced from); templates shipped to all tasks up to this size.
REFERENCES, SHIPPED_BYTES = 8, 16 << 20
#: Element names by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end a run of text; all others stand in it.
BLOCKS = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li "
    "main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose inside is no text of the page; they end no run.
SILENT = frozenset("audio button canvas datalist iframe noscript object script select style svg template textarea video".split())
APART = frozenset("nav footer aside dialog menu head title".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th figcaption caption summary".split())
CLOSED_BY_BLOCKS = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HEAD = frozenset("base link meta noscript script style template title".split())
LISTS = frozenset("ul ol dl table tbody thead".split())
BOXES = frozenset("div section span main article center font".split())
#: Parts of class words that name adverts, comments of readers, and other parts beside an article.
_ADVERTS = re.compile(r"ads?|advert\w*|adsense|sponsor\w*|promo\w*")
_COMMENTS = re.compile(r"comments?|commentlist|respond|repl(?:y|ies)|disqus")
_APART_NAMES = re.compile(
    r"banner|cookies?|consent|gdpr|notice|notification|alert|sidebar|sidenav|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead"
    r"|shar(?:e|ing)|social|related|recommend\w*|newsletter|subscri\w*|signup|login|popup|modal|overlay|widget|toolbar|pagination|pager|copyright|disclaimer|skip"
)
#: Parts of class words that tell a state or a layout, and such as boxes of any kind are called by (a year is none).
_STATES = re.compile(r"has|have|no|non|not|with|without|is|are|open(?:ed)?|closed?|enabled?|disabled?|on|off|allow(?:ed)?|left|right|none|full|layout|count|format|type|status|tag|category")
_PLAIN = re.compile(
    r"\d{1,3}|\d{5,}|area|articles?|bars?|block|body|box|btn|buttons?|bottom|center|col|container|content|fixed|footer|form|group|header|heading|icons?|inner|items?|links?|lists?|main|message|outer|page|panel|posts?"
    r"|region|row|section|site|slot|space|sticky|stories|text|title|top|unit|wrap|wrapper"
)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_MAIN_NAMES = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|main)(?:[_-](?:body|content|text))?(?:$|\s)", re.IGNORECASE)
_APART_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())


def words_of(said: str) -> list[list[str]]:
    """The class words and ids of an element, each as its parts; ``shareButtons`` has two, digits at the end of one are one of their own."""
    return [[p.lower() for p in re.findall(r"[A-Za-z][a-z]+|[A-Z]+(?![a-z])|[a-z]+|\d+", w)] for w in said.split()]


def names(words: list[list[str]], kind: re.Pattern) -> tuple[bool, bool]:
    """Whether one of the words has a part of that kind and none that tells a state; and whether one has nothing else besides plain parts."""
    some = [w for w in words if any(kind.fullmatch(p) for p in w) and not any(_STATES.fullmatch(p) for p in w)]
    return bool(some), any(all(kind.fullmatch(p) or _PLAIN.fullmatch(p) for p in w) for w in some)


class Node:
    __slots__ = ("tag", "name", "kids", "text", "links", "apart", "said", "named", "main", "size", "length", "headed", "holds", "_mark")

    def __init__(self, tag: str, name: str = ""):
        self.tag, self.name, self.kids = tag, name, []
        self.text, self.links = "", 0
        #: Apart by its tag, role or attributes; by a word of its class; by a word that says nothing else; the main part.
        self.apart = self.said = self.named = self.main = False
        #: Nodes and characters below, a title among them, a main part among them.
        self.size, self.length, self.headed, self.holds = 1, 0, False, False
        self._mark = None

    @property
    def mark(self) -> str:
        """The digest of a leaf's text, computed once."""
        if self._mark is None:
            self._mark = digest(self.text)
        return self._mark


class _Tree(HTMLParser):
    """Block elements are nodes; runs of text between them are leaves with the tag "#".

    Elements end where the standard lets their end tags be left out: ``head``
    at the first thing that cannot be in it, ``p`` at blocks, list items and
    cells at their like. Text of inline elements that are hidden or adverts
    is left out; such an element ends with the block that it stands in.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html")
        self.open = [self.root]
        self.places: dict[str, list[int]] = {"html": [0]}  # tag -> places of its open elements
        self.words: list[str] = []
        self.anchor = self.linked = 0
        self.mute: list[tuple[int, str]] = []
        #: Open elements from the outermost silent one on.
        self.silent: list[str] = []

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            leaf = Node("#")
            leaf.text, leaf.links = text, self.linked
            self.open[-1].kids.append(leaf)
        self.linked = 0

    def _pop(self, to: int) -> None:
        self.flush()
        to = max(1, to)
        for n in self.open[to:]:
            self.places[n.tag].pop()
        del self.open[to:]
        while self.mute and self.mute[-1][0] >= to:
            self.mute.pop()

    def _end_head(self) -> None:
        if self.places.get("head"):
            self._pop(self.places["head"][-1])

    def _last(self, tag: str) -> int:
        """The place of the innermost open element of that tag, or 0."""
        at = self.places.get(tag)
        return at[-1] if at else 0

    def handle_starttag(self, tag, attrs):
        if tag == "body" or (tag not in HEAD and tag not in ("html", "head")):
            self._end_head()
        if tag in ("html", "body"):
            return
        if self.silent or tag in SILENT:
            if tag not in VOID:
                self.silent.append(tag)
            return
        a = {k: v or "" for k, v in attrs}
        said = " ".join(x for x in (a.get("class"), a.get("id")) if x)
        hidden = "hidden" in a or a.get("aria-hidden") == "true" or bool(_HIDDEN.search(a.get("style", "")))
        words = words_of(said)
        advert, only_advert = names(words, _ADVERTS)
        if tag not in BLOCKS:
            if tag == "a":
                self.anchor = 1
            elif tag == "br":
                self.words.append(" ")
            if tag not in VOID and (self.mute or hidden or advert):
                self.mute.append((len(self.open) - 1, tag))
            return
        self.flush()
        if tag in CLOSED_BY_BLOCKS and self._last("p"):
            self._pop(self._last("p"))
        elif tag in ENDS:
            inside = max(map(self._last, LISTS))
            ended = [at for at in map(self._last, ENDS[tag]) if at > inside]
            if ended:
                self._pop(min(ended))
        self.anchor = 0
        node = Node(tag, re.sub(r"\d+", "", said).strip())
        role = a.get("role", "").lower()
        comment, _ = names(words, _COMMENTS)
        node.said, node.named = names(words, _APART_NAMES)
        node.apart = tag in APART or role in _APART_ROLES or hidden or bool(self.mute)
        node.main = tag in ("article", "main") or role in ("main", "article") or bool(said and _MAIN_NAMES.search(said))
        if node.main:
            # what is called an article is none only if a word says so and nothing else: a post with open comments, or of a promotion, is one
            comment = tag != "main" and any(w and _COMMENTS.fullmatch(w[0]) and not any(_STATES.fullmatch(p) for p in w) for w in words)
            advert, node.said = tag != "main" and only_advert, tag != "main" and node.named
        node.apart = node.apart or advert or comment
        self.open[-1].kids.append(node)
        if tag not in VOID:
            self.places.setdefault(tag, []).append(len(self.open))
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.silent:
            if tag in self.silent:
                del self.silent[len(self.silent) - 1 - self.silent[::-1].index(tag) :]
                return
            if not (tag in BLOCKS and self._last(tag)):
                return
            self.silent = []  # never closed: it ends with what it stands in
        if tag not in BLOCKS:
            if tag == "a":
                self.anchor = 0
            if self.mute and self.mute[-1][1] == tag:
                self.mute.pop()
            return
        if self._last(tag):
            self._pop(self._last(tag))
        else:
            self.flush()

    def handle_data(self, data):
        if self.open[-1].tag == "head" and data.strip():
            self._end_head()
        if self.mute or self.silent:
            return
        if self.anchor:
            self.linked += len(data)
        self.words.append(data)


def parse(html: str | None) -> Node:
    t = _Tree()
    t.feed(html or "")
    t.close()
    t.flush()
    stack, order = [t.root], []
    while stack:
        n = stack.pop()
        order.append(n)
        stack += n.kids
    for n in reversed(order):
        n.size = 1 + sum(k.size for k in n.kids)
        n.length = len(n.text) + sum(k.length for k in n.kids)
        n.headed = any(k.headed or k.tag in ("h1", "h2") for k in n.kids)
        n.holds = any(k.holds or (k.main and not k.apart) for k in n.kids)
    return t.root


def digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=6).hexdigest()


# ---------------------------------------------------------------- simple tree matching


class Template:
    """A tree whose leaves know the digests of texts that references showed there, and of how many; unpacked, 2 marks texts that most of them showed."""

    __slots__ = ("tag", "name", "kids", "texts")

    def __init__(self, tag, name, kids, texts):
        self.tag, self.name, self.kids, self.texts = tag, name, kids, texts

    @classmethod
    def of(cls, n: Node) -> Template:
        root = cls(n.tag, n.name, [], {n.mark: 1} if n.tag == "#" else {})
        todo = [(n, root)]
        while todo:
            x, own = todo.pop()
            for k in x.kids:
                own.kids.append(cls(k.tag, k.name, [], {k.mark: 1} if k.tag == "#" else {}))
                todo.append((k, own.kids[-1]))
        return root

    def packed(self, least: int, most: int = 1 << 30) -> list:
        """The nodes, parents first, each with its number of children; of texts those of at least ``least`` references, and apart from these those of at least ``most``."""
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            some, many = ([d for d, c in n.texts.items() if c >= least and (c >= most) == x] for x in (False, True))
            out.append([n.tag, n.name, len(n.kids), some, many])
            stack += reversed(n.kids)
        return out

    @classmethod
    def unpacked(cls, rows: list) -> Template:
        made = [cls(x[0], x[1], [], dict.fromkeys(x[3], 1) | dict.fromkeys(x[4], 2)) for x in rows]
        lacking: list[list] = []  # open nodes, and how many children they still wait for
        for x, n in zip(rows, made):
            if lacking:
                lacking[-1][0].kids.append(n)
                lacking[-1][1] -= 1
                if not lacking[-1][1]:
                    lacking.pop()
            if x[2]:
                lacking.append([n, x[2]])
        return made[0]


def matchings(a: Node, b: Template, most_cells: int = 20_000) -> dict[tuple[int, int], tuple[float, list]]:
    """Of two trees, and of pairs of their nodes: the weight of the largest order-preserving matching, and the pairs of children in it.

    The matching of two nodes is found by dynamic programming over their
    children; what it needs of their matchings is computed first, on a stack
    of its own, so that trees may be of any depth. Where the table of two
    lists would be large, its rows are numpy arrays and only the way back is
    kept; the matching is as good.
    """
    known: dict[tuple[int, int], tuple[float, list]] = {}

    def plain(x: Node, y: Template) -> float | None:
        """The weight of a pair with one label that needs no table."""
        p, q = x.kids, y.kids
        if x.tag == "#":
            return 2.0 if x.mark in y.texts else 1.0
        if len(p) == 1 and len(q) == 1 and p[0].tag == "#" == q[0].tag:
            return 3.0 if p[0].mark in q[0].texts else 2.0
        return None if p and q else 1.0

    def matching(x: Node, y: Template):
        """A generator: asks for pairs whose weight it needs and is not known, then leaves its own in ``known``."""
        p, q = x.kids, y.kids
        m, n = len(p), len(q)
        if m * n > most_cells:
            pairs, total = yield from _tracks(p, q, plain, known)
            known[id(x), id(y)] = 1 + total, [(p[i], q[j]) for i, j in pairs]
            return
        names = [(v.tag, v.name) for v in q]
        best = [[0.0] * (n + 1) for _ in range(m + 1)]
        for i in range(m - 1, -1, -1):
            row, below, u = best[i], best[i + 1], p[i]
            label, right = (u.tag, u.name), 0.0
            for j in range(n - 1, -1, -1):
                if below[j] > right:
                    right = below[j]
                if names[j] == label and below[j + 1] + u.size * 2 > right:
                    w = plain(u, q[j])
                    if w is None:
                        key = id(u), id(q[j])
                        if key not in known:
                            yield u, q[j]
                        w = known[key][0]
                    if below[j + 1] + w > right:
                        right = below[j + 1] + w
                row[j] = right
        pairs, i, j = [], 0, 0
        while i < m and j < n:
            if best[i][j] == best[i + 1][j]:
                i += 1
            elif best[i][j] == best[i][j + 1]:
                j += 1
            else:
                pairs.append((p[i], q[j]))
                i, j = i + 1, j + 1
        known[id(x), id(y)] = 1 + best[0][0], pairs

    stack = [matching(a, b)]
    while stack:
        asked = next(stack[-1], None)
        if asked is None:
            stack.pop()
        else:
            stack.append(matching(*asked))
    return known


def align(a: Node, b: Template, most_cells: int = 20_000) -> list[tuple[Node, Template]]:
    """Pairs of leaves that the largest matching of the two trees puts together, in page order."""
    if (a.tag, a.name) != (b.tag, b.name):
        return []
    known = matchings(a, b, most_cells)
    out, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        if x.tag == "#":
            out.append((x, y))
        elif x.kids and y.kids:
            found = known.get((id(x), id(y)))
            todo += reversed(found[1] if found else [(x.kids[0], y.kids[0])])  # of a pair without a table: one leaf each
    return out


def _tracks(p: list[Node], q: list[Template], plain, known: dict):
    """Like ``matching`` for two long lists, row by row, of which two bits a cell are kept: places of the pairs, and their weight."""

    def weight(u: Node, v: Template):
        w = plain(u, v)
        if w is None:
            if (id(u), id(v)) not in known:
                yield u, v
            w = known[id(u), id(v)][0]
        return w

    n = len(q)
    at: dict[tuple[str, str], list[int]] = {}
    for j, v in enumerate(q):
        at.setdefault((v.tag, v.name), []).append(j)
    places = {label: np.array(js) for label, js in at.items()}
    below, rows = np.zeros(n + 1), []
    for u in reversed(p):
        row = below.copy()
        js = places.get((u.tag, u.name))
        if js is not None:
            js = js[below[js + 1] + u.size * 2 > below[js]]
            each = []
            for j in js.tolist():
                each.append((yield from weight(u, q[j])))
            gain = below[js + 1] + np.array(each)
            row[js] = np.maximum(row[js], gain)
            row[:n] = np.maximum.accumulate(row[n - 1 :: -1])[::-1] if n else row[:n]
        rows.append((np.packbits(row[:n] == below[:n]), np.packbits(row[:n] == row[1:])))
        below = row
    rows.reverse()
    out, i, j = [], 0, 0
    while i < len(p) and j < n:
        down, right = (x[j >> 3] >> (7 - (j & 7)) & 1 for x in rows[i])
        if down:
            i += 1
        elif right:
            j += 1
        else:
            out.append((i, j))
            i, j = i + 1, j + 1
    return out, float(below[0])


def layouts(pages: list[str]) -> list[tuple[Template, int]]:
    """A template for every layout of the reference pages, and of how many with different articles it is.

    Pages are of one layout if at least half of the smaller one's leaves find
    their like in the larger. Layouts of fewer than two different pages have
    no template.
    """
    rest, out = sorted((parse(h) for h in pages), key=lambda t: -t.size), []
    while len(rest) > 1:
        template, seen = Template.of(rest[0]), 1
        size, pairs, others = len(leaves(rest[0])), [[]], []
        group = rest[:1]
        for t in rest[1:]:
            found = align(t, template)
            if 2 * len(found) >= min(size, len(leaves(t))):
                group.append(t)
                pairs.append(found)
            else:
                others.append(t)
        told = _told(group)
        said = [told[0]]
        for found, own in zip(pairs[1:], told[1:]):
            if not own or any(2 * len(own & s) > min(len(own), len(s)) for s in said):
                continue  # a copy tells nothing about what stays the same
            said.append(own)
            seen += 1
            for n, at in found:
                at.texts[n.mark] = at.texts.get(n.mark, 0) + 1
        if seen > 1:
            out.append((template, seen))
        rest = others
    return out


def induce(pages: list[str]) -> tuple[Template, int] | None:
    """The template of the largest layout; None if no two references are alike but for their articles."""
    return next(iter(layouts(pages)), None)


def _told(trees: list[Node]) -> list[frozenset[str]]:
    """Of each tree the texts by which it can be a copy of another: not menus and other link lists, nor what three of four different pages show."""
    told = [frozenset(n.mark for n, (apart, _, _) in leaves(t) if not apart and 2 * n.links <= len(n.text)) for t in trees]
    pages = set(told)
    shown = Counter(d for t in pages for d in t)
    return [frozenset(d for d in t if len(pages) < 4 or 4 * shown[d] < 3 * len(pages)) for t in told]


def leaves(root: Node, wrapped: bool = False) -> list[tuple[Node, tuple[bool, bool, Node]]]:
    """Leaves in page order with: inside something apart, inside the main part, their parent.

    What a class is called sets parts apart everywhere, but in the main part
    only boxes whose word says nothing else, and what is mostly links: an
    article may have a menu of dishes and a section on related work. A form is
    apart unless it holds a main part, or a title and most of the page's text.
    With ``wrapped``, what the boxes around the main part are called does not
    count.
    """
    out, stack = [], [(root, False, False, False, root)]
    while stack:
        n, apart, said, main, parent = stack.pop()
        if n.tag == "#":
            out.append((n, (apart or said, main, parent)))
            continue
        if n.tag == "header" and not apart:
            apart = not (main and n.headed)
        if n.tag == "form" and (main or not (n.holds or (n.headed and 2 * n.length >= root.length))):
            apart = True
        apart = apart or n.apart
        if n.main and wrapped:
            said = False
        said = said or (n.said and (not main or (n.named and n.tag in BOXES) or _linked(n)))
        main = main or (n.main and not apart and not said)
        stack += [(k, apart, said, main, n) for k in reversed(n.kids)]
    return out


def _linked(root: Node) -> bool:
    """Whether most of a part's text is in links."""
    text, links, stack = 0, 0, [root]
    while stack:
        n = stack.pop()
        text, links = text + len(n.text), links + n.links
        stack += n.kids
    return 2 * links > text


def extract(html: str | None, template: Template | None, seen: int = 0) -> str:
    """The main text: blocks in page order, joined by two line feeds; empty if there is none."""
    return extract_by(html, [(template, seen)] if template else [])


def extract_by(html: str | None, known: list[tuple[Template, int]]) -> str:
    """The main text by that of the templates which has a place for most of the page's leaves."""
    root = parse(html)
    pairs = max((align(root, t) for t, seen in known if seen >= 2), key=len, default=[])
    constant = {id(n): at.texts[n.mark] for n, at in pairs if n.mark in at.texts}
    all_ = leaves(root)
    if not any(main and not apart for _, (apart, main, _) in all_):
        all_ = leaves(root, wrapped=True)
    inside = [(n, p) for n, (apart, main, p) in all_ if main and not apart]
    if inside:
        # prose that several articles quote is theirs, until most show it at the same place: then it is the template's, as are all constant parts that no markup calls prose, or that are named like boilerplate
        kept = [n for n, p in inside if constant.get(id(n), 0) < (2 if p.tag in PROSE and not p.said else 1)]
    else:
        kept = [n for n, (apart, _, p) in all_ if not apart and id(n) not in constant and not (2 * n.links > len(n.text) and p.tag != "p")]
    return "\n\n".join(n.text for n in kept)


# ---------------------------------------------------------------- pages


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def _induce(pdf: pd.DataFrame) -> pd.DataFrame:
    rows = []
    for template, seen in layouts([h for h in pdf.sort_values("bucket")["html"] if h]):
        rows.append((pdf["host"].iloc[0], json.dumps(template.packed(max(2, (seen + 1) // 2), max(3, seen // 2 + 1)), separators=(",", ":")), seen))
    return pd.DataFrame(rows, columns=["host", "template", "seen"]).astype({"host": str, "template": str, "seen": int})


def templates(pages: DataFrame, references: int = REFERENCES) -> DataFrame:
    """(host, template, seen): the layouts of hosts with at least two different pages, the largest first.

    The references are the pages whose ids hash lowest in each of a few
    buckets: an aggregate that map tasks reduce first, so a host with most of
    the pages sends no more rows than any other.
    """
    p = pages.select("page_id", "html", host_of(F.col("url")).alias("host")).where("html is not null and host <> ''")
    h = F.xxhash64("page_id")
    refs = p.groupBy("host", F.pmod(h, F.lit(references)).alias("bucket")).agg(F.min_by("html", F.struct(h, F.xxhash64("html"))).alias("html"))
    return refs.groupBy("host").applyInPandas(_induce, "host string, template string, seen int")


def _extract(shipped):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, list[tuple[Template, int]]] = {}
        for pdf in batches:
            out = []
            found = pdf["layouts"] if shipped is None else [shipped.value.get(h) for h in pdf["host"]]
            for html, host, packed in zip(pdf["html"], pdf["host"], found):
                if packed is not None and host not in known:
                    if len(known) > 256:
                        known.clear()
                    known[host] = [(Template.unpacked(json.loads(x["template"])), int(x["seen"])) for x in packed]
                out.append(extract_by(html, known[host] if packed is not None else []))
            text = pd.Series(out, dtype=object)
            yield pd.DataFrame({"page_id": pdf["page_id"].astype("Int64"), "url": pdf["url"], "text": text, "n_chars": text.str.len().astype("int64") if len(text) else pd.Series([], dtype="int64")})

    return run


def extract_pages(pages: DataFrame, shipped_bytes: int = SHIPPED_BYTES) -> DataFrame:
    """page_id, url, text, n_chars of every page; null pages have an empty text, null urls no template.

    Templates are induced once and written to the shared folder. Up to a
    measured size they are shipped to all tasks; beyond it they are joined by
    host, where adaptive execution splits a host that has most pages. Repeated
    ids keep their rows, other columns are ignored; pages may be nested to any
    depth.
    """
    spark = pages.sparkSession
    t = saved(templates(pages), "templates")
    p = pages.select(F.col("page_id").cast("long"), "url", "html", host_of(F.col("url")).alias("host"))
    size = t.agg(F.sum(F.length("template") + F.length("host"))).first()[0] or 0
    each = t.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("seen", "template")), asc=False).alias("layouts"))
    out = "page_id long, url string, text string, n_chars long"
    if size <= shipped_bytes:
        shipped = spark.sparkContext.broadcast({r["host"]: [x.asDict() for x in r["layouts"]] for r in each.collect()})
        return p.mapInPandas(_extract(shipped), out)
    return p.join(each, "host", "left").mapInPandas(_extract(None), out)


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of all ``pages``; see ``extract_pages`` for nulls, repeated ids and empty pages."""
    return extract_pages(table(spark, sf_dir, "pages"))
