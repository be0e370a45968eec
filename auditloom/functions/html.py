"""One parse of a page's markup to a struct of everything that the audit needs.

The tree builder follows the parts of the HTML standard that crawled pages exercise: void and raw-text elements, implied
html, head and body, implied ends of p, li, dt, dd, option and table parts, formatting elements reopened in later
blocks, end tags without a start ignored, character references decoded, the first of repeated attributes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import cached_property
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .accessibility import violations
from .signatures import BARE_COMPONENTS, COMPONENT_TAGS, SKELETON_SKIP

_VOID = frozenset((
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
))
_HEAD = frozenset((
    "base", "link", "meta", "title", "style", "script", "noscript", "template",
))
_FORMATTING = frozenset((
    "b", "big", "code", "em", "font", "i", "s", "small", "strike", "strong", "tt", "u", "nobr",
))
_BLOCK = frozenset((
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer",
    "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table",
    "ul",
))
_SPACED = frozenset((
    "p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "br", "tr", "td", "section", "article", "header", "footer", "nav", "ul", "ol",
))
#: A start tag ends these open elements, up to the nearest of the limits.
_IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist")),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
    "thead": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
}


class Element:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def walk(self):
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if not isinstance(c, str))

    def text(self, skip=frozenset(), spaced=frozenset()) -> str:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            elif node.tag not in skip:
                if node.tag in spaced:
                    out.append(" ")
                    stack.append(" ")
                stack.extend(reversed(node.children))
        return "".join(out)


class Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.html, self.head, self.body = Element("html", {}), Element("head", {}), Element("body", {})
        self.html.children = [self.head, self.body]
        self.open: list[Element] = []  # below body
        self.in_head: Element | None = None
        self.started = False
        self.active: list[Element] = []

    @property
    def here(self) -> Element:
        return self.open[-1] if self.open else self.body

    def reopen(self) -> None:
        for f in [x for x in self.active if x not in self.open]:
            copy = Element(f.tag, f.attrs)
            self.here.children.append(copy)
            self.open.append(copy)
            self.active[self.active.index(f)] = copy

    def close(self, *tags: str, limits: tuple[str, ...] = ()) -> None:
        """End the nearest open element of these tags, and what is open inside it."""
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag in tags:
                del self.open[i:]
                return
            if self.open[i].tag in limits:
                return

    def handle_starttag(self, tag, attrs):
        given: dict[str, str] = {}
        for k, v in attrs:
            given.setdefault(k, v or "")
        if tag in ("html", "head", "body"):
            target = {"html": self.html, "head": self.head, "body": self.body}[tag]
            for k, v in given.items():
                target.attrs.setdefault(k, v)
            self.started |= tag == "body"
            return
        if not self.started and tag in _HEAD:
            node = Element(tag, given)
            self.head.children.append(node)
            if tag not in _VOID:
                self.in_head = node
            return
        self.started, self.in_head = True, None
        if tag in _BLOCK:
            self.close("p", limits=("button",))
        if tag in _IMPLIED:
            tags, limits = _IMPLIED[tag]
            for _ in tags:
                self.close(*tags, limits=limits)
        if tag in ("td", "th", "tr", "option"):
            pass
        elif tag not in _BLOCK:
            self.reopen()
        node = Element(tag, given)
        self.here.children.append(node)
        if tag not in _VOID:
            self.open.append(node)
            if tag in _FORMATTING:
                self.active.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.in_head is not None and self.in_head.tag == tag:
            self.in_head = None
            return
        if tag in ("html", "head", "body") or tag in _VOID:
            self.started |= tag == "head"
            return
        if tag in _FORMATTING:
            for f in reversed(self.active):
                if f.tag == tag:
                    self.active.remove(f)
                    if f in self.open:
                        # what was opened inside stays open beside it
                        at = self.open.index(f)
                        inner = self.open[at + 1 :]
                        del self.open[at:]
                        for n in inner:
                            copy = Element(n.tag, n.attrs)
                            self.here.children.append(copy)
                            self.open.append(copy)
                            if n in self.active:
                                self.active[self.active.index(n)] = copy
                    return
            return
        if any(n.tag == tag for n in self.open):
            self.close(tag)
        elif tag == "p":
            self.here.children.append(Element("p", {}))

    def handle_data(self, data):
        if self.in_head is not None:
            self.in_head.children.append(data)
            return
        if not self.started:
            if not data.strip():
                return
            self.started = True
        if data.strip():
            self.reopen()
        self.here.children.append(data)


def parse(html: str) -> Builder:
    b = Builder()
    b.feed(html)
    HTMLParser.close(b)
    return b


def classes(node: Element, most: int) -> list[str]:
    return sorted(node.attrs.get("class", "").split())[:most]


def skeleton(node: Element, depth: int, deepest: int) -> str:
    """Tags with their first three classes, runs of equal siblings folded to one with a star."""
    if depth > deepest:
        return ""
    out: list[list] = []
    for c in node.children:
        if isinstance(c, str) or c.tag in SKELETON_SKIP:
            continue
        shape = f"{c.tag}.{'.'.join(classes(c, 3))}({skeleton(c, depth + 1, deepest)})"
        if out and out[-1][0] == shape:
            out[-1][1] = "*"
        else:
            out.append([shape, ""])
    return "|".join(s + star for s, star in out)


def component_signatures(body: Element, nodes: list[Element]) -> list[str]:
    """Tags with their first two classes, each once, but for those that hold over 60 % of the body's text."""
    whole = max(len(body.text()), 1)
    found: dict[str, None] = {}
    for tag in COMPONENT_TAGS:
        for n in nodes:
            if n.tag != tag:
                continue
            names = classes(n, 2)
            if (names or tag in BARE_COMPONENTS) and len(n.text().strip()) / whole <= 0.6:
                found[".".join([tag, *names])] = None
    return list(found)


def form_purpose(types: list[str], hints: str) -> str:
    rules = (
        ("search", "search" in types or "search" in hints),
        ("newsletter", "newsletter" in hints or "subscribe" in hints),
        ("login", "password" in types),
        ("contact", "contact" in hints),
        ("lead-gen", "email" in types or "tel" in types),
    )
    return next((name for name, hit in rules if hit), "other")


def _squeezed(s: str) -> str:
    return re.sub(r"\s+", " ", s).strip()


_SPACES = np.array([chr(i).isspace() for i in range(0x3001)] + [False])


def count_words(text: str) -> int:
    """The number of words that ``split`` finds, without making them: the places where a word begins after a space."""
    space = _SPACES[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), len(_SPACES) - 1)]
    return int(np.count_nonzero(space[:-1] & ~space[1:])) + int(len(space) > 0 and not space[0])


class _Page:
    """A parsed page and what several of its fields rest on, each found once and only where a field asks for it."""

    def __init__(self, html: str | None, deepest: int):
        self.tree, self.deepest = parse(html or ""), deepest

    @cached_property
    def inside(self) -> list[Element]:
        return list(self.tree.body.walk())[1:]

    @cached_property
    def every(self) -> list[Element]:
        return list(self.tree.head.walk())[1:] + self.inside

    @cached_property
    def visible(self) -> str:
        return self.tree.body.text({"script", "style", "noscript"}, _SPACED)

    @cached_property
    def n_words(self) -> int:
        return count_words(self.visible)

    def of(self, *tags: str) -> list[Element]:
        return [n for n in self.every if n.tag in tags]

    def first(self, tag: str, **attrs: str) -> Element | None:
        return next((n for n in self.every if n.tag == tag and all(n.attrs.get(k) == v for k, v in attrs.items())), None)


def _told(node: Element | None, read: Callable):
    return None if node is None else read(node)


def _forms(p: _Page) -> list[dict]:
    forms = []
    for f in p.of("form"):
        get = lambda n, k: n.attrs.get(k)
        fields = [n for n in f.walk() if n.tag in ("input", "textarea", "select")]
        types = [(get(n, "type") or n.tag).lower() for n in fields]
        hints = f"{get(f, 'action') or ''} {get(f, 'class') or ''} {get(f, 'id') or ''}".lower()
        forms.append({"action": get(f, "action"), "hints": hints, "types": types, "inputs": [{"type": (get(n, "type") or "").lower(), "name": (get(n, "name") or "").lower()} for n in fields if n.tag == "input"], "purpose": form_purpose(types, hints)})
    return forms


def _widgets(p: _Page) -> list[str]:
    css = [(n, set((n.attrs.get("class") or "").split())) for n in p.every]
    widgets = {
        "modal": any("modal" in c or n.attrs.get("role") == "dialog" for n, c in css),
        "accordion": any("accordion" in c or "aria-expanded" in n.attrs for n, c in css),
        "carousel": any(c & {"carousel", "slider"} or "carousel" in (n.attrs.get("class") or "") for n, c in css),
        "tabs": any("tabs" in c or n.attrs.get("role") == "tablist" for n, c in css),
    }
    return [k for k, hit in widgets.items() if hit]


def _resources(p: _Page) -> list[str]:
    loaded = [n for n in p.of("img", "script", "iframe") if "src" in n.attrs] + [n for n in p.of("link") if "href" in n.attrs]
    return [u for n in loaded if (u := n.attrs.get("src") or n.attrs.get("href"))]


def _is_video(n: Element) -> bool:
    return n.tag == "video" or (n.tag == "iframe" and re.search("youtube|vimeo", n.attrs.get("src") or "") is not None)


def _attrs(nodes: list[Element], *names: str) -> list[dict]:
    return [{k: n.attrs.get(k) for k in names} for n in nodes]


#: Each field of a page: its type, and how it is read.
FIELDS: dict[str, tuple[str, Callable]] = {
    "title": ("string", lambda p: _told(p.first("title"), lambda n: _squeezed(n.text()) or None)),
    "meta_description": ("string", lambda p: _told(p.first("meta", name="description"), lambda n: n.attrs.get("content"))),
    "h1_text": ("string", lambda p: _told(p.first("h1"), lambda n: n.text().strip() or None)),
    "canonical": ("string", lambda p: _told(p.first("link", rel="canonical"), lambda n: n.attrs.get("href"))),
    "lang": ("string", lambda p: p.tree.html.attrs.get("lang") or None),
    "hreflang": ("array<struct<locale:string,url:string>>", lambda p: [{"locale": a["hreflang"], "url": a["href"]} for a in (n.attrs for n in p.of("link")) if a.get("rel") == "alternate" and a.get("hreflang") and a.get("href")]),
    "body_text": ("string", lambda p: p.tree.body.text()),
    "visible_text": ("string", lambda p: _squeezed(p.visible)),
    "word_count": ("int", lambda p: p.n_words),
    "anchors": ("array<struct<href:string,text:string>>", lambda p: [{"href": n.attrs.get("href"), "text": n.text()} for n in p.of("a")]),
    "images": ("array<struct<src:string,alt:string>>", lambda p: _attrs(p.of("img"), "src", "alt")),
    "scripts": ("array<struct<src:string,type:string>>", lambda p: _attrs(p.of("script"), "src", "type")),
    "resources": ("array<string>", _resources),
    "metas": ("array<struct<name:string,property:string,content:string>>", lambda p: _attrs(p.of("meta"), "name", "property", "content")),
    "json_ld": ("array<string>", lambda p: [n.text() for n in p.of("script") if n.attrs.get("type") == "application/ld+json"]),
    "itemscope": ("boolean", lambda p: any("itemscope" in n.attrs for n in p.every)),
    "forms": ("array<struct<action:string,hints:string,types:array<string>,inputs:array<struct<type:string,name:string>>,purpose:string>>", _forms),
    "videos": ("array<string>", lambda p: [u for n in p.every if _is_video(n) and (u := n.attrs.get("src"))] + [u for v in p.of("video") for n in v.walk() if n.tag == "source" and (u := n.attrs.get("src"))]),
    "has_video": ("boolean", lambda p: any(map(_is_video, p.every))),
    "interactions": ("array<string>", _widgets),
    "client_rendered": ("boolean", lambda p: bool(p.of("script")) and sum(not isinstance(c, str) for c in p.tree.body.children) < 10 and p.n_words < 50),
    "components": ("array<string>", lambda p: component_signatures(p.tree.body, p.inside)),
    "skeleton": ("string", lambda p: skeleton(p.tree.body, 0, p.deepest)),
    "violations": ("array<struct<id:string,impact:string,description:string,nodesCount:int>>", lambda p: violations(p.tree)),
}


def extract_page(html: str | None, deepest: int = 6, fields: Iterable[str] = tuple(FIELDS)) -> dict:
    page = _Page(html, deepest)
    return {k: FIELDS[k][1](page) for k in fields}


def dom(html: Column, fields: Iterable[str] = tuple(FIELDS)) -> Column:
    """The struct of a page's markup, of all fields or of those named; of null markup that of an empty page.

    The markup is parsed whole in any case. What isn't named is neither made nor sent back, which long texts cost most by.
    """
    fields = tuple(fields)

    @F.pandas_udf(f"struct<{','.join(f'{k}:{FIELDS[k][0]}' for k in fields)}>")
    def run(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([extract_page(p, fields=fields) for p in pages], columns=list(fields))

    return run(html)


def fingerprint(dom_column: Column) -> Column:
    """Twelve hexadecimal digits for the skeleton."""
    return F.substring(F.sha1(dom_column["skeleton"]), 1, 12)
