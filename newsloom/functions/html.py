"""A small document tree over the standard HTML parser, and what articles need of it."""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser
from urllib.parse import urljoin

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = ("script", "style", "noscript")
#: Where articles keep their text, for some sources first, then for all.
CONTENT = {"vnexpress": (".fck_detail", "article.fck_detail", ".Normal"), "cafef": (".detail-content", ".newscontent", "#mainContent"), "genk": (".knc-content", ".detail-content", ".content")}
CONTENT_ANY = ("article", ".article-content", ".content-detail", ".detail-content", ".post-content")
#: Meta names that tell when an article was published, in order.
PUBLISHED = (("property", "article:published_time"), ("name", "article:published_time"), ("property", "article:modified_time"), ("name", "article:modified_time"), ("name", "pubdate"), ("name", "publishdate"), ("name", "datePublished"), ("name", "parsely-pub-date"), ("name", "date"), ("itemprop", "datePublished"), ("itemprop", "dateModified"))
#: Where dates are shown, for some sources first, then for all.
PUBLISHED_AT = {
    "vnexpress": (".date", ".time", ".article-date", "time"),
    "genk": (".kbwcm-time", ".knc-date", ".detail-time", ".news-date", ".time", "time"),
    "diendandoanhnghiep": (".detail-date", ".article-date", ".detail__time", ".b-maincontent__time", ".block-sc-publish-time", ".sc-longform-header-date", ".time-public", ".date-public", ".time", ".date", "time"),
    "cafef": (".time", ".pdate", ".date", "time"),
}
PUBLISHED_AT_ANY = ("time", ".date", ".time", ".article-date", ".detail-date", ".pdate")
#: Elements whose text is never a shown date.
UNSHOWN = ("script", "style", "template", "rt", "rp")
#: Signs of images that are none.
PLACEHOLDERS = ("loading", "placeholder", "blank.gif", "pixel.gif")
JUNK = ("logo", "icon", "avatar", "banner", "tracking", "sprite")


class Node:
    """An element: its name, attributes, parent and children (elements and strings)."""

    __slots__ = ("name", "attrs", "parent", "children")

    def __init__(self, name: str, attrs: dict[str, str], parent: Node | None):
        self.name, self.attrs, self.parent, self.children = name, attrs, parent, []

    def walk(self):
        """All elements below, in order."""
        stack = [iter(self.children)]
        while stack:
            for child in stack[-1]:
                if isinstance(child, Node):
                    yield child
                    stack.append(iter(child.children))
                    break
            else:
                stack.pop()

    def text(self, hidden: tuple[str, ...] = HIDDEN) -> str:
        """The text below without that of hidden elements, pieces parted by one space."""
        parts: list[str] = []
        stack: list = [self]
        while stack:
            at = stack.pop()
            if isinstance(at, str):
                parts.append(at)
            elif at.name not in hidden:
                stack.extend(reversed(at.children))
        return " ".join(" ".join(parts).split())

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.name != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    """The tree of a page, however broken; null gives an empty one."""
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def dismantled(root: Node) -> None:
    """Cut the ties of a tree that is done with: elements and their parents name each other, so it would stay until the collector of cycles comes by."""
    for node in list(root.walk()):
        node.parent = None


_STEP = re.compile(r"([\w-]+)|\.([\w-]+)|#([\w-]+)|\[([\w-]+)(?:=['\"]?([^'\"\]]*)['\"]?)?\]")


def matches(node: Node, step: str) -> bool:
    """Whether an element fits a step of a selector: tag, .class, #id, [attribute], [attribute='value']."""
    for tag, cls, ident, attr, value in _STEP.findall(step):
        if tag and node.name != tag or cls and cls not in node.classes() or ident and node.attrs.get("id") != ident:
            return False
        if attr and (attr not in node.attrs or value and node.attrs[attr] != value):
            return False
    return True


def select(root: Node, selector: str) -> list[Node]:
    """Elements that fit a selector of steps, each below the one before."""
    *above, last = selector.split()
    found = []
    for node in root.walk():
        if not matches(node, last):
            continue
        at, left = node.parent, list(above)
        while left and at is not None:
            if matches(at, left[-1]):
                left.pop()
            at = at.parent
        if not left:
            found.append(node)
    return found


def title(root: Node) -> str:
    """The page's title."""
    found = select(root, "title")
    return found[0].text() if found else ""


def content(root: Node, source: str = "") -> str:
    """The text of paragraphs in the first place of an article that holds 200 characters; else of all paragraphs."""
    for selector in (*CONTENT.get(source, ()), *CONTENT_ANY):
        for node in select(root, selector)[:1]:
            text = " ".join(filter(None, (p.text() for p in node.walk() if p.name in ("p", "h2"))))
            if len(text) >= 200:
                return text
    return " ".join(filter(None, (p.text() for p in select(root, "p"))))


_GAP = r"(?:\s|,|\||-|–|—|lúc|luc)+"
_DAY, _HOUR, _ZONE = r"\d{1,2}[/-]\d{1,2}[/-]\d{4}", r"\d{1,2}:\d{2}(?::\d{2})?\s*(?:AM|PM|SA|CH)?", r"(?:\s*\(?GMT\s*[+-]\s*\d{1,2}:?\d{0,2}\)?)?"
#: A date in running text: with a time after it, with one before it, alone.
DATES = tuple(re.compile(p, re.IGNORECASE) for p in (_DAY + _GAP + _HOUR + _ZONE, _HOUR + _GAP + _DAY + _ZONE, _DAY))


def published(root: Node, source: str = "") -> str:
    """When the page says that it was published: in meta, in time elements, where dates are shown, or the first date in its text."""

    def said(node: Node, *names: str) -> str:
        return " ".join(unescape(next(filter(None, map(node.attrs.get, names)), "")).split())

    metas, times, first = [], [], {}  # the first element of each name and of each .class
    for node in root.walk():
        if node.name in ("meta", "time"):
            (metas if node.name == "meta" else times).append(node)
        for kind in (node.name, *("." + c for c in node.classes())):
            first.setdefault(kind, node)
    for key, name in PUBLISHED:
        value = said(next((node for node in metas if node.attrs.get(key) == name), root), "content")
        if value:
            return value
    for node in times:
        value = said(node, "datetime", "content")
        if value:
            return value
    for selector in (*PUBLISHED_AT.get(source, ()), *PUBLISHED_AT_ANY):
        node = first.get(selector, Node("", {}, None))
        value = said(node, "datetime", "content") if node.attrs.get("datetime") or node.attrs.get("content") else shown(node)
        if value:
            return value
    text = shown(root)
    return next((m.group() for m in (date.search(text) for date in DATES) if m), "")


def shown(node: Node) -> str:
    """The text below as a date is looked for in it."""
    return " ".join(unescape(node.text(UNSHOWN)).split())


def tagless(text: str) -> str:
    """The text without tags, references as characters and white space collapsed."""
    return " ".join(unescape(parse(text).text(())).split())


def canonical(root: Node, url: str) -> str:
    """The page's own address: og:url, the canonical link, or that by which it was found."""
    for selector, attr in (("meta[property='og:url']", "content"), ("link[rel='canonical']", "href")):
        for node in select(root, selector)[:1]:
            if node.attrs.get(attr, "").strip():
                return urljoin(url, node.attrs[attr].strip())
    return url


def links(root: Node, url: str) -> list[tuple[str, str]]:
    """Different addresses to which the page links, with the first text of each, in order."""
    found: dict[str, str] = {}
    for node in select(root, "a[href]"):
        href = node.attrs["href"].strip()
        if href and not href.startswith(("#", "javascript:", "mailto:")):
            found.setdefault(urljoin(url, href).split("#")[0], node.text())
    return list(found.items())


def images(root: Node, url: str) -> list[tuple[int, str, str, str]]:
    """position, address, alt, caption of the page's real images, each address once."""
    out, seen = [], set()
    for node in select(root, "img"):
        values = [node.attrs.get(a, "").strip() for a in ("data-src", "data-original", "data-lazy-src", "src")]
        values += [node.attrs.get(a, "").split(",")[0].strip().split(" ")[0] for a in ("data-srcset", "srcset")]
        value = next((v for v in values if v and not v.startswith("data:") and not any(p in v.lower() for p in PLACEHOLDERS)), "")
        full = urljoin(url, value) if value else ""
        size = [re.search(r"\d+", node.attrs.get(a, "")) for a in ("width", "height")]
        tiny = all(size) and all(int(m.group()) <= 2 for m in size)
        hay = " ".join((full, node.attrs.get("class", ""), node.attrs.get("id", ""), node.attrs.get("alt", ""))).lower()
        if not full or full in seen or tiny or any(j in hay for j in JUNK):
            continue
        seen.add(full)
        at, caption = node, ""
        while at is not None and at.name != "figure":
            at = at.parent
        if at is not None:
            caption = next((c.text() for c in at.walk() if c.name == "figcaption"), "")
        out.append((len(out), full, node.attrs.get("alt", ""), caption))
    return out
