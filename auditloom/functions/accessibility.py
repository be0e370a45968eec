"""Accessibility rules that can be told from markup alone, as a table of selectors and of what an element must have.

The rules bear the names, impacts and texts that scanners in browsers use. What only rendering shows (contrast, size, focus) isn't
judged. Elements that are hidden, or inside something hidden, are left out, as scanners leave them out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

_HIDDEN_STYLES = ("display:none", "visibility:hidden")
_TEXT_INPUTS = "input:not([type=hidden|submit|button|reset|image])"


def selector(text: str) -> Callable:
    """A test of elements from ``tag``, ``tag[attribute]``, ``tag[attribute=a|b]`` or ``tag:not([attribute=a|b])``."""
    negated = ":not(" in text
    tag, _, rest = text.replace(":not(", "").rstrip(")").partition("[")
    name, _, values = rest.rstrip("]").partition("=")
    wanted = frozenset(filter(None, values.split("|")))

    def test(node) -> bool:
        if tag not in ("*", node.tag):
            return False
        if not name:
            return True
        hit = name in node.attrs and (not wanted or node.attrs[name].strip().lower() in wanted)
        return hit != negated

    return test


@dataclass
class Page:
    """What the rules look up: visible elements in order, elements by id, labels."""

    html: object
    nodes: list
    title: str
    ids: dict = field(default_factory=dict)
    labels: dict = field(default_factory=dict)
    inside: dict = field(default_factory=dict)
    texts: dict = field(default_factory=dict)

    def text(self, node) -> str:
        """Text of an element, with the alternatives of its images; each is read once."""
        key = id(node)
        if key not in self.texts:
            parts = [node.text({"script", "style"})] + [n.attrs.get("alt", "") + n.attrs.get("aria-label", "") for n in node.walk() if n.tag in ("img", "svg") or "aria-label" in n.attrs]
            self.texts[key] = " ".join(parts).strip()
        return self.texts[key]

    def named(self, node) -> bool:
        """Whether an element has a name of its own: an ARIA label, an element that labels it, or a title."""
        a = node.attrs
        if a.get("aria-label", "").strip() or a.get("title", "").strip():
            return True
        return any(self.text(self.ids[i]) for i in a.get("aria-labelledby", "").split() if i in self.ids)

    def labelled(self, node) -> bool:
        """Whether a label names a form field."""
        fitting = [*self.labels.get(node.attrs.get("id", ""), ()), *self.inside.get(id(node), ())]
        return any(self.text(x) for x in fitting)


def page_of(builder) -> Page:
    """A parsed page as the rules see it."""
    hidden = lambda n: "hidden" in n.attrs or n.attrs.get("aria-hidden", "").lower() == "true" or n.tag == "template" or any(s in n.attrs.get("style", "").replace(" ", "").lower() for s in _HIDDEN_STYLES)
    nodes: list = []
    inside: dict = {}
    around: list[tuple] = [(builder.body, None)]
    while around:
        node, label = around.pop()
        if node is not builder.body:
            if hidden(node):
                continue
            nodes.append(node)
        label = node if node.tag == "label" else label
        if label is not None and node is not label:
            inside[id(node)] = [label]
        around.extend((c, label) for c in reversed(node.children) if not isinstance(c, str))
    titles = [n for n in builder.head.walk() if n.tag == "title"]
    page = Page(builder.html, nodes, titles[0].text().strip() if titles else "", inside=inside)
    for n in builder.body.walk():
        if "id" in n.attrs:
            page.ids.setdefault(n.attrs["id"], n)
    for n in nodes:
        if n.tag == "label" and "for" in n.attrs:
            page.labels.setdefault(n.attrs["for"], []).append(n)
    return page


def _plain(node) -> bool:
    """Whether an element is there for show only."""
    return node.attrs.get("role", "").strip().lower() in ("presentation", "none")


def _headings(page: Page) -> Iterable:
    """Headings that go down by more than one level."""
    last = None
    for n in page.nodes:
        role = n.attrs.get("role", "").strip().lower()
        level = int(n.tag[1]) if len(n.tag) == 2 and n.tag[0] == "h" and n.tag[1] in "123456" and not role else None
        if role == "heading" and n.attrs.get("aria-level", "").isdigit():
            level = int(n.attrs["aria-level"])
        if level is None:
            continue
        if last is not None and level > last + 1:
            yield n
        last = level


def _repeated_ids(page: Page) -> Iterable:
    return [i for i, n in Counter(n.attrs["id"] for n in page.nodes if n.attrs.get("id", "").strip()).items() if n > 1]


@dataclass(frozen=True)
class Rule:
    """A rule: the elements that it is about, and which of them break it; or the places of a page that do."""

    id: str
    impact: str
    description: str
    about: tuple[str, ...] = ()
    breaks: Callable | None = None
    places: Callable | None = None

    def nodes(self, page: Page) -> int:
        """How many places break the rule."""
        if self.places is not None:
            return len(list(self.places(page)))
        tests = [selector(s) for s in self.about]
        return sum(any(t(n) for t in tests) and self.breaks(page, n) for n in page.nodes)


#: Names, impacts and texts are fixed values.
RULES = (
    Rule("button-name", "critical", "Buttons must have discernible text", ("button",), lambda p, n: not _plain(n) and not p.named(n) and not p.text(n)),
    Rule("document-title", "serious", "Documents must have <title> element to aid in navigation", places=lambda p: () if p.title else (p.html,)),
    Rule("duplicate-id", "minor", "id attribute value must be unique", places=_repeated_ids),
    Rule("frame-title", "serious", "Frames must have an accessible name", ("iframe", "frame"), lambda p, n: not _plain(n) and not p.named(n)),
    Rule("heading-order", "moderate", "Heading levels should only increase by one", places=_headings),
    Rule("html-has-lang", "serious", "<html> element must have a lang attribute", places=lambda p: () if p.html.attrs.get("lang", "").strip() else (p.html,)),
    Rule("image-alt", "critical", "Images must have alternative text", ("img",), lambda p, n: "alt" not in n.attrs and not _plain(n) and not p.named(n)),
    Rule("input-button-name", "critical", "Input buttons must have discernible text", ("input[type=button]",), lambda p, n: not n.attrs.get("value", "").strip() and not p.named(n)),
    Rule("input-image-alt", "critical", "Image buttons must have alternative text", ("input[type=image]",), lambda p, n: not n.attrs.get("alt", "").strip() and not p.named(n)),
    Rule("label", "critical", "Form elements must have labels", (_TEXT_INPUTS, "textarea"), lambda p, n: not p.named(n) and not n.attrs.get("placeholder", "").strip() and not p.labelled(n)),
    Rule("link-name", "serious", "Links must have discernible text", ("a[href]",), lambda p, n: not _plain(n) and not p.named(n) and not p.text(n)),
    Rule("select-name", "critical", "Select element must have an accessible name", ("select",), lambda p, n: not p.named(n) and not p.labelled(n)),
)


def violations(builder, rules: tuple[Rule, ...] = RULES) -> list[dict]:
    """The rules that a parsed page breaks: id, impact, description, nodesCount; in the order of the rules."""
    page = page_of(builder)
    return [{"id": r.id, "impact": r.impact, "description": r.description, "nodesCount": n} for r in rules if (n := r.nodes(page))]
