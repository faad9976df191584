"""Main text of HTML pages by tree scoring.

A page becomes a tree of its block elements. Boilerplate goes by element, role and class words; paragraphs pass points
for length and commas to their ancestors, half of them at each level; what a container gets is discounted by its share
of link text. The best container, widened to the article around it, and siblings that score like it are the main text.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import fresh

_ATTRS = r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+"
_TOKEN = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?P<raw>script|style|title|textarea|iframe|noscript|template|noframes|noembed)\b{_ATTRS}>.*?(?:</(?P=raw)\b[^>]*+>|\Z)"
    rf"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*+)(?P<attrs>{_ATTRS})>|<[a-z/!?][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_NAMED = re.compile(r"(?<![\w-])(class|id|role|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)

_set = lambda s: frozenset(s.split())
BLOCKS = _set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search "
    "section summary table tbody td tfoot th thead tr ul"
)
VOID = _set("area base br col embed hr img input link meta param source track wbr")
HEADINGS = _set("h1 h2 h3 h4 h5 h6")
#: Elements whose points and text belong to what is around them.
PARAGRAPHS = HEADINGS | _set("p pre dt dd figcaption caption summary legend address")
PARTS = _set("tr tbody thead tfoot th td li")
#: Elements that are never part of the main text.
DROPPED = _set("nav aside footer menu dialog search optgroup option button select datalist object svg canvas audio video map head")
#: Class words of what is no article wherever it stands, and of layout that goes unless it holds an article.
NEVER = _set(
    "ad ads advert adverts advertisement advertisements advertising adsense adslot adbox sponsor sponsors sponsored promo promos promotion teaser teasers comment comments commentlist disqus reply replies respond newsletter subscribe subscription signup "
    "cookie cookies consent gdpr notice notices notification notifications alert alerts popup popups modal overlay related recommended recommendations recirc breadcrumb breadcrumbs pagination pager paginator tags taglist"
)
LAYOUT = _set("sidebar sidebars aside nav navbar navigation menu menus topbar toolbar footer banner banners widget widgets share sharing social login skip toc rail")
HEADS = _set("header masthead pageheader siteheader")
ROLES = {"navigation": 2, "complementary": 2, "contentinfo": 2, "search": 2, "menu": 2, "menubar": 2, "toolbar": 2, "dialog": 3, "alert": 3, "alertdialog": 3, "banner": 1}
GOOD = _set("content article articlebody main body post entry story text page")
#: Words before a class word that say the opposite: has-sidebar, no-comments.
_NOT = _set("has with no without")

#: Points: of an article element, of a well named container; the share of the best score that keeps a sibling.
ARTICLE, NAMED, SIBLING = 10.0, 5.0, 0.2
LONG = 25


@lru_cache(1 << 14)
def _named(attrs: str) -> tuple[int, bool, bool]:
    """(kind of boilerplate that attributes tell: 0 none, 1 header, 2 layout, 3 never an article; well named; main)."""
    kind, good, main = 0, False, False
    for name, value in _NAMED.findall(attrs):
        value = unescape(value.strip("\"'"))
        if name.lower() == "role":
            kind, main = max(kind, ROLES.get(value.strip().lower(), 0)), main or value.strip().lower() in ("main", "article")
        elif name.lower() == "itemprop":
            main = main or value.strip().lower() == "articlebody"
        else:
            for part in value.split():
                last = ""
                for piece in re.split(r"[^A-Za-z0-9]+", part):
                    piece = piece.rstrip("0123456789")
                    for word in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", piece) if piece.isalpha() else []:
                        word = word.lower()
                        if last not in _NOT:
                            kind = max(kind, 3 if word in NEVER else 2 if word in LAYOUT else 1 if word in HEADS else 0)
                            good = good or word in GOOD
                        last = word
    return kind, good, main


class _Page:
    """Block elements of a page in document order: parents come before their children."""

    def __init__(self, html: str):
        self.tag, self.parent, self.kind, self.good, self.main = ["html"], [-1], [0], [False], [False]
        self.blocks: list[tuple[int, str, int]] = []  # (element, text, characters of it in links)
        self.links = [0]
        self._stack, self._open = [0], defaultdict(list)
        self._text, self._linked, self._anchors = [], 0, 0
        self._read(html)

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                self.blocks.append((self._stack[-1], text, min(self._linked, len(text))))
            self._text, self._linked = [], 0

    def _add(self, text: str) -> None:
        text = unescape(text) if "&" in text else text
        self._text.append(text)
        if self._anchors:
            self._linked += len(" ".join(text.split()))

    def _pop_to(self, depth: int) -> None:
        self._flush()
        self._anchors = 0
        while len(self._stack) > depth:
            self._open[self.tag[self._stack.pop()]].pop()

    def _top(self, *names: str) -> int:
        return max((self._open[n][-1] for n in names if self._open[n]), default=0)

    def _close_before(self, name: str) -> None:
        """End tags that a start tag implies."""
        last = self.tag[self._stack[-1]]
        if last == "p" or last in HEADINGS and name in HEADINGS:
            self._pop_to(len(self._stack) - 1)
        for of, closes, around in (("li", ("li",), ("ul", "ol", "menu", "dir", "table")), ("dt", ("dt", "dd"), ("dl", "table")), ("dd", ("dt", "dd"), ("dl", "table")), ("option", ("option",), ("table",)), ("td", ("td", "th"), ("table",)), ("th", ("td", "th"), ("table",)), ("tr", ("tr",), ("table",)), ("tbody", ("tbody", "thead", "tfoot"), ("table",)), ("tfoot", ("tbody", "thead", "tfoot"), ("table",))):
            if name == of and (at := self._top(*closes)) > self._top(*around):
                self._pop_to(at)

    def _start(self, name: str, attrs: str) -> None:
        self._close_before(name)
        self._flush()
        kind, good, main = _named(attrs) if "=" in attrs else (0, False, False)
        if name in ("html", "body", "main"):
            kind = 0
        elif name == "article":
            kind = kind if kind == 3 else 0
        kind = 4 if name in DROPPED else max(kind, {"header": 1, "form": 2}.get(name, 0))
        self._open[name].append(len(self._stack))
        self.parent.append(self._stack[-1])
        self._stack.append(len(self.tag))
        self.tag.append(name)
        self.kind.append(kind)
        self.good.append(good)
        self.main.append((main or name in ("article", "main")) and kind == 0)
        self.links.append(0)
        if name in VOID:
            self._pop_to(len(self._stack) - 1)

    def _end(self, name: str) -> None:
        names = HEADINGS if name in HEADINGS else (name,)
        at = self._top(*names)
        around = self._top("td", "th", "caption", "table") if name not in ("td", "th", "caption", "table", "tr", "tbody", "thead", "tfoot") else self._top("table") if name != "table" else 0
        if at and at >= around and name not in ("html", "body"):
            self._pop_to(at)
        else:
            self._flush()

    def _read(self, html: str) -> None:
        at, skip, depth, level = 0, None, 0, 0  # skip: an inline element that is left out, open so many times
        for m in _TOKEN.finditer(html):
            if m.start() > at and skip is None:
                self._add(html[at : m.start()])
            at = m.end()
            name = m["name"]
            if name is None:
                continue
            name, end = name.lower(), bool(m["end"])
            block = name in BLOCKS
            if skip is not None:
                if name == skip and name not in VOID:
                    depth += -1 if end else 1
                if depth > 0 and not (block and (end and self._open[name] and self._open[name][-1] <= level or not end and skip not in DROPPED)):
                    continue
                skip = None
                if depth == 0 and name not in BLOCKS:
                    continue
            if block:
                self._end(name) if end else self._start(name, m["attrs"])
            elif name == "br":
                self._text.append(" ")
            elif not end and name not in VOID and (name in DROPPED or "=" in m["attrs"] and _named(m["attrs"])[0] >= 2) and not m["attrs"].rstrip().endswith("/"):
                skip, depth, level = name, 1, len(self._stack) - 1
            elif name == "a":
                self._anchors = 0 if end else 1
                self.links[self._stack[-1]] += not end
        if at < len(html) and skip is None:
            self._add(html[at:])
        self._pop_to(1)

    def gone(self) -> list[int]:
        """Of each element: 0 if it stays, 1 if only headings in it stay, 2 if it is left out."""
        holds, inside = self.main[:], self.main[:]
        for i in range(len(self.tag) - 1, 0, -1):
            holds[self.parent[i]] |= holds[i]
        out = [0] * len(self.tag)
        for i in range(1, len(self.tag)):
            inside[i] |= inside[self.parent[i]]
            kind = self.kind[i]
            if holds[i] and kind in (1, 2):
                kind = 0
            mine = 0 if kind == 0 else 1 if kind == 1 and inside[self.parent[i]] else 2
            above = out[self.parent[i]]
            out[i] = 0 if above == 1 and self.tag[i] in HEADINGS and mine == 0 else max(above, mine)
        return out

    def text(self) -> str:
        gone, n = self.gone(), len(self.tag)
        blocks = [b for b in self.blocks if gone[b[0]] == 0]
        points, chars, linked, links = [0.0] * n, [0] * n, [0] * n, self.links[:]
        for i, text, in_links in blocks:
            chars[i] += len(text)
            linked[i] += in_links
            if self.tag[i] not in HEADINGS:
                worth = (len(text) >= LONG) + len(text) / 100 + sum(map(text.count, ",،、，"))
                points[self.parent[i] if self.tag[i] in PARAGRAPHS and i else i] += worth * (1 - in_links / len(text))
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            points[p] += points[i] / 2
            chars[p] += chars[i]
            linked[p] += linked[i]
            links[p] += links[i]
        share = [a / b if b else 0.0 for a, b in zip(linked, chars)]
        score = [0.0 if gone[i] or not chars[i] or self.tag[i] in PARAGRAPHS else (points[i] + (ARTICLE if self.main[i] else NAMED if self.good[i] else 0)) * (1 - share[i]) for i in range(n)]
        best = max(range(n), key=score.__getitem__)
        while self.tag[best] in PARTS and (self.tag[best] != "td" or 2 * chars[best] < chars[self.parent[best]]):
            best = self.parent[best]  # rows, items and small cells stand for their table or list
        up = best
        while up > 0 and not self.main[up]:
            up = self.parent[up]
        best = up if up > 0 else best

        kept = {best}
        if best and not self.main[best]:
            heads: list[int] = []
            for i in range(1, n):
                if self.parent[i] != self.parent[best] or gone[i] or i == best:
                    heads = heads if i != best else kept.update(heads) or []
                    continue
                heads = [*heads, i] if self.tag[i] in HEADINGS else []
                prose = self.tag[i] == "p" and share[i] < 0.25 and (chars[i] >= 80 or chars[i] > 0 and share[i] == 0)
                if prose or score[i] >= max(1.0, SIBLING * score[best]) and share[i] < 1 / 3:
                    kept.add(i)
        elif best:
            kept |= {i for i in range(1, n) if self.parent[i] == self.parent[best] and self.main[i] and score[i] >= score[best] / 2}

        within, menu = [False] * n, [False] * n
        for i in range(n):
            p = self.parent[i]
            within[i] = i in kept or p >= 0 and within[p]
            menu[i] = p >= 0 and menu[p] or self.tag[i] in ("ul", "ol", "dl") and links[i] >= 3 and share[i] > 0.6
        return "\n".join(t for i, t, _ in blocks if within[i] and not menu[i])


def page_text(html: str | None) -> str:
    """The main text of one page, a line per block; an empty string for null, empty and textless pages."""
    return _Page(html).text() if html else ""


@F.arrow_udf(T.StringType())
def _texts(html: pa.Array) -> pa.Array:
    return pa.array((page_text(h.as_py()) for h in html), pa.string())


def main_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with ``_text``, the main text of each page, and ``_n_chars``, its length in code points; a name that the
    table has already gets one more underscore in front.

    Whole pages of any length are read. A null or empty page has an empty text, as has one of boilerplate alone; pages
    that repeat, or share their id, are pages each; all other columns stay as they are. Unclosed elements end with what
    is around them, and a page that is cut short keeps what it holds of its article. One map over the pages, no exchange.
    """
    text, n = fresh(pages.columns, "_text", "_n_chars")
    return pages.withColumn(text, _texts(F.col(f"`{html}`"))).withColumn(n, F.length(text).cast("long"))
