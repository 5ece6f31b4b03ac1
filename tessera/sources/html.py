"""Work, tag, author and search pages from HTML, with the standard library's parser.

A page is parsed into a small tree; fields are found by simple selectors (tag, classes,
ancestors). `parse_pages` runs it in Arrow batches; `listed_works` turns the works of
listing pages into rows, the first of each work on a page.
"""

from __future__ import annotations

import html
import html.parser
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.urls import ORIGIN, RESERVED, decode_tag_text, encode_tag_text

#: Pages that are parsed before their rows are given on.
ROWS = 256
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Tags that end an open tag of their kind.
CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "p": {"p"}, "option": {"option"}}

# Where the fields stand in a page.
WORK_META = "dl.work.meta.group"
TAG_GROUPS = ("fandom", "relationship", "character", "freeform")
BLURB = "ol.work.index.group li.work.blurb"
TITLE = "h2.title"


# Pages made of these tokens alone are cut by one expression; any other is read by the standard library's parser whole.
_TOKEN = re.compile(
    r'([^<]+)|</([a-zA-Z][a-zA-Z0-9]*)[ \t\n\r\f]*>|<([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n\r\f]+[a-zA-Z][a-zA-Z0-9-]*="[^"<>]*")*)[ \t\n\r\f]*(/?)>|<!--(?!-?>)(?:(?!--)[^<>])*-->|<![dD][oO][cC][tT][yY][pP][eE][^<>"\'\[-]*>|(<)'
)
_ATTRIBUTE = re.compile(r'([a-zA-Z][a-zA-Z0-9-]*)="([^"]*)"')
_unescape_value = getattr(html.parser, "_unescape_attrvalue", html.unescape)
#: Elements whose text is read by rules of its own; without a "<" in it all rules agree.
SPECIAL = {"script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes", "noscript"}


@lru_cache(4096)
def _attributes(text: str) -> tuple[dict[str, str], frozenset[str]]:
    attrs = {k.lower(): _unescape_value(v) if "&" in v else v for k, v in _ATTRIBUTE.findall(text)}
    return attrs, frozenset(attrs.get("class", "").split())


@lru_cache(1024)
def _selector(text: str) -> tuple[tuple[tuple[str, frozenset[str], str | None, bool, str], ...], frozenset[str]]:
    """Parts tag.class.class[attr*=value] or [attr=value] of a selector, the innermost last, and all their classes."""
    out = []
    for part in text.split():
        tag, classes, attr, how, value = re.fullmatch(r"([a-z0-9]*)((?:\.[\w-]+)*)(?:\[(\w+)(\*?=)\"?([^\"\]]*)\"?\])?", part).groups()
        out.append((tag, frozenset(c for c in classes.split(".") if c), attr, how == "*=", value))
    return tuple(out), frozenset(c for part in out for c in part[1])


class Document:
    """A page's nodes in document order, and those of each class."""

    __slots__ = ("nodes", "classes")

    def __init__(self) -> None:
        self.nodes: list[Node] = []
        self.classes: dict[str, list[Node]] = defaultdict(list)

    def release(self) -> None:
        """Cut the links back, so that the tree goes at once and not when cycles are looked for."""
        for n in self.nodes:
            n.parent = None
        self.nodes.clear()
        self.classes.clear()


class Node:
    __slots__ = ("tag", "attrs", "classes", "children", "parent", "document", "place", "last")

    def __init__(self, tag: str, attrs: dict[str, str], parent: "Node | None", classes: frozenset[str] | None = None):
        self.tag, self.attrs, self.parent, self.last = tag, attrs, parent, None
        self.classes = frozenset(attrs.get("class", "").split()) if classes is None else classes
        self.children: list[Node | str] = []
        if parent is None:
            self.document, self.place = Document(), -1
            return
        self.document = d = parent.document
        self.place = len(d.nodes)
        d.nodes.append(self)
        for c in self.classes:
            d.classes[c].append(self)
        parent.children.append(self)
        parent.last = self

    def text(self) -> str:
        return "".join([c if isinstance(c, str) else c.text() for c in self.children])

    def _is(self, part: tuple[str, frozenset[str], str | None, bool, str]) -> bool:
        tag, classes, attr, within, value = part
        if tag and tag != self.tag or not classes <= self.classes:
            return False
        if attr:
            have = self.attrs.get(attr)
            return have is not None and (value in have if within else have == value)
        return True

    def _end(self) -> int:
        """The place after this node's last descendant; descendants stand together in document order."""
        if self.place < 0:
            return len(self.document.nodes)
        n = self
        while n.last is not None:
            n = n.last
        return n.place + 1

    def _each(self, selector: str, end: int) -> Iterator["Node"]:
        parts, needed = _selector(selector)
        found = self.document.classes
        for c in needed:
            if c not in found:
                return
        last = parts[-1]
        nodes = self.document.nodes
        some = min([found[c] for c in last[1]], key=len) if last[1] else nodes[self.place + 1 : end]
        if len(some) > 1 and len(parts) > 1 and parts[-2][1]:  # a lone holder tells where to look
            holders = min([found[c] for c in parts[-2][1]], key=len)
            if len(holders) == 1 and (stop := holders[0]._end()) - holders[0].place <= len(some):
                some = nodes[holders[0].place + 1 : stop]
        for n in some:
            if self.place < n.place < end and n._is(last) and (len(parts) == 1 or n._within(parts)):
                yield n

    def _within(self, parts: tuple) -> bool:
        rest, up = len(parts) - 2, self.parent
        while rest >= 0 and up is not None:
            if up._is(parts[rest]):
                rest -= 1
            up = up.parent
        return rest < 0

    def all(self, *selectors: str) -> list["Node"]:
        """Descendants that any selector fits, in document order."""
        end = self._end()
        if len(selectors) == 1:
            return list(self._each(selectors[0], end))
        return [n for _, n in sorted({n.place: n for s in selectors for n in self._each(s, end)}.items())]

    def first(self, *selectors: str) -> "Node | None":
        end = self._end()
        if len(selectors) == 1:
            return next(self._each(selectors[0], end), None)
        got = [n for n in (next(self._each(s, end), None) for s in selectors) if n is not None]
        return min(got, key=lambda n: n.place) if got else None


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.open(tag, {k: v or "" for k, v in attrs}, None)

    def open(self, tag: str, attrs: dict[str, str], classes: frozenset[str] | None) -> None:
        if self.at.tag in CLOSES.get(tag, ()):
            self.at = self.at.parent or self.root
        node = Node(tag, attrs, self.at, classes)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag: str) -> None:
        up = self.at
        while up is not self.root and up.tag != tag:
            up = up.parent or self.root
        if up is not self.root:
            self.at = up.parent or self.root

    def handle_data(self, data: str) -> None:
        if self.at.tag not in ("script", "style"):
            self.at.children.append(data)


def plain_tree(text: str) -> Node | None:
    """The tree of a page of plain tokens, as the library's parser would build it; None for other pages."""
    at = root = Node("", {}, None)
    special = ""
    for data, ends, tag, attrs, closed, bad in _TOKEN.findall(text):
        if bad:
            return None
        if data:
            if special not in ("script", "style"):
                at.children.append(html.unescape(data) if "&" in data else data)
            continue
        if special:
            if ends.lower() != special:
                return None
            special = ""
        if tag:
            tag = tag.lower()
            if tag in SPECIAL:
                special = tag
            if tag == "plaintext" or special and closed:
                return None
            if at.tag in CLOSES.get(tag, ()):
                at = at.parent
            values, classes = _attributes(attrs) if attrs else ({}, frozenset())
            node = Node(tag, values, at, classes)
            if tag not in VOID:
                at = node
            if closed:
                ends = tag
        if ends:
            ends = ends.lower()
            up = at
            while up is not root and up.tag != ends:
                up = up.parent
            if up is not root:
                at = up.parent
    return root if not special else None


def tree(text: str) -> Node:
    got = plain_tree(text)
    if got is not None:
        return got
    b = _Builder()
    b.feed(text)
    b.close()
    return b.root


def _unique(values: list[str]) -> list[str]:
    return [v for v in dict.fromkeys(v.strip() for v in values) if v]


def _texts(root: Node, *selectors: str) -> list[str]:
    return _unique([n.text() for n in root.all(*selectors)])


def _number(text: str | None, pattern: str) -> int | None:
    m = re.search(pattern, text or "", re.I)
    digits = m[1].replace(",", "") if m else ""
    return int(digits) if digits else None


def completion(text: str | None) -> str | None:
    m = re.match(r"([\d,]+)\s*/\s*([\d,?]+)", (text or "").strip())
    if not m:
        return None
    if m[2] == "?":
        return "Incomplete"
    a, b = (re.match(r"\d+", x.replace(",", "")) for x in m.groups())
    if not a or not b or int(b[0]) <= 0:
        return None
    return "Complete" if int(a[0]) >= int(b[0]) else "Incomplete"


def author_key(href: str) -> str | None:
    m = re.search(r"/users/([^/?#]+(?:/pseuds/[^/?#]+)?)(?:/works)?/?(?:[?#]|$)", href)
    return m[1] if m and m[1].split("/")[0] not in RESERVED else None


def _authors(root: Node, selector: str) -> list[dict]:
    out: dict[str, dict] = {}
    for link in root.all(selector):
        key = author_key(link.attrs.get("href", ""))
        if key:
            out.setdefault(key, {"key": key, "displayName": link.text().strip() or key})
    return list(out.values())


def _label(blurb: Node, selector: str) -> str | None:
    """A required tag's title, else its text."""
    n = blurb.first(selector)
    if n is None:
        return None
    inner = n.first(".text")
    return n.attrs.get("title", "").strip() or (inner.text().strip() if inner else "") or n.text().strip() or None


def _meta(**given: object) -> dict:
    return {"language": None, "rating": None, "completionStatus": None, "archiveWarnings": [], "fandoms": [], "categories": []} | given


def parse_blurb(blurb: Node) -> dict | None:
    link = blurb.first('h4.heading a[href*="/works/"]', 'h3.title a[href*="/works/"]')
    m = re.search(r"/works/(\d+)", link.attrs.get("href", "")) if link else None
    if not m:
        return None
    words = blurb.first("dl.stats dd.words")
    language, chapters = blurb.first("dl.stats dd.language"), blurb.first("dl.stats dd.chapters")
    warnings = _texts(blurb, "ul.tags.commas li.warnings a.tag") or _unique((_label(blurb, "ul.required-tags .warnings") or "").split(","))
    wip = (_label(blurb, "ul.required-tags .iswip") or "").lower()
    done = "Complete" if wip in ("complete", "completed") else "Incomplete" if wip in ("incomplete", "work in progress", "wip") else completion(chapters.text() if chapters else None)
    meta = _meta(language=(language.text().strip() or None) if language else None, rating=_label(blurb, "ul.required-tags .rating"), completionStatus=done, archiveWarnings=warnings, fandoms=_texts(blurb, "h5.fandoms.heading a.tag"), categories=_unique((_label(blurb, "ul.required-tags .category") or "").split(",")))
    return {"workId": m[1], "title": link.text().strip() or f"Work {m[1]}", "tags": _texts(blurb, "h5.fandoms.heading a.tag", "ul.tags.commas a.tag"), "authors": _authors(blurb, 'h4.heading a[rel="author"]'), "wordCount": _number(words.text().strip() if words else None, r"^([\d,]+)"), "meta": meta}


def parse_listed(root: Node) -> list[dict]:
    out: dict[str, dict] = {}
    for blurb in root.all(BLURB):
        got = parse_blurb(blurb)
        if got:
            out.setdefault(got["workId"], got)
    return list(out.values())


def _page_of(address: str) -> int | None:
    m = re.search(r"[?&]page=\s*(\d+)", address)
    return int(m[1]) if m and int(m[1]) > 0 else None


def pagination(root: Node, url: str) -> tuple[int, int | None]:
    """The page's own number (as shown, else as addressed, else 1) and the next one's."""
    shown = root.first("ol.pagination li.current")
    digits = re.sub(r"\D", "", shown.text()) if shown else ""
    page = int(digits) if digits and int(digits) > 0 else _page_of(url) or 1
    link = root.first("ol.pagination li.next a")
    href = link.attrs.get("href") if link else None
    return page, None if not href else _page_of(href) or page + 1


def parse_page(url: str, text: str, origin: str = ORIGIN) -> dict | None:
    """The page's data by the kind its address tells, or None for other pages."""
    trees: list[Node] = []
    try:
        return _read_page(url or "", text or "", origin, trees)
    finally:
        for t in trees:
            t.document.release()


def _read_page(url: str, text: str, origin: str, trees: list[Node]) -> dict | None:
    if m := re.search(r"/works/(\d+)", url):
        root = tree(text)
        trees.append(root)
        title = root.first(TITLE, "h1.title")
        words, language, chapters = (root.first(f"{WORK_META} dd.{c}") for c in ("words", "language", "chapters"))
        meta = _meta(language=(language.text().strip() or None) if language else None, rating=next(iter(_texts(root, f"{WORK_META} dd.rating a.tag")), None), completionStatus=completion(chapters.text() if chapters else None), archiveWarnings=_texts(root, f"{WORK_META} dd.warning a.tag"), fandoms=_texts(root, f"{WORK_META} dd.fandom a.tag"), categories=_texts(root, f"{WORK_META} dd.category a.tag"))
        tags = [t for t in (n.text().strip() for n in root.all(*[f"{WORK_META} dd.{g} a.tag" for g in TAG_GROUPS])) if t]
        return {"kind": "work", "workId": m[1], "title": re.sub(r"\s+", " ", title.text().strip()) if title and title.text().strip() else f"Work {m[1]}", "tags": tags, "authors": _authors(root, f'{WORK_META} dd.users a[href*="/users/"]'), "wordCount": _number(words.text() if words else None, r"([\d,]+)\s+Words?"), "url": f"{origin}/works/{m[1]}", "meta": meta}
    search = re.match(r"[a-zA-Z][\w+.-]*://[^/?#]*/works/search(?:[?#]|$)", url)
    tag, author = re.search(r"/tags/([^/]+)/works", url), re.search(r"/users/([^/?#]+(?:/pseuds/[^/?#]+)?)(?:/works)?(?:[/?#]|$)", url)
    if author and author[1].split("/")[0] in RESERVED:
        author = None
    if not (search or tag or author):
        return None
    root = tree(text)
    trees.append(root)
    head = root.first("h2.heading")
    heading = head.text() if head else ""
    count = _number(heading, r"([\d,]+)\s+Works?")
    page, following = pagination(root, url)
    out = {"workCount": count, "works": parse_listed(root), "page": page, "nextPage": following}
    more = f"?page={page}" if page > 1 else ""
    if search:
        return {"kind": "search", **out, "workCount": count if count is not None else _number(heading, r"([\d,]+)\s+Found"), "url": url}
    if tag:
        name = decode_tag_text(tag[1])
        return {"kind": "tag", **out, "tagName": name, "url": f"{origin}/tags/{encode_tag_text(name)}/works{more}"}
    name = re.sub(r"^Works by\s+", "", re.sub(r"\s*-\s*Works.*$", "", heading, flags=re.I | re.S), flags=re.I).strip()
    return {"kind": "author", **out, "authorKey": author[1], "displayName": name or author[1], "url": f"{origin}/users/{author[1]}/works{more}"}


_META_DDL = "struct<language:string,rating:string,completionStatus:string,archiveWarnings:array<string>,fandoms:array<string>,categories:array<string>>"
_AUTHOR_DDL = "array<struct<key:string,displayName:string>>"
_LISTED_DDL = f"struct<workId:string,title:string,tags:array<string>,authors:{_AUTHOR_DDL},wordCount:bigint,meta:{_META_DDL}>"
#: The union of the four kinds; fields of other kinds are null.
PAGE_DDL = f"kind string, workId string, title string, tags array<string>, authors {_AUTHOR_DDL}, wordCount bigint, meta {_META_DDL}, tagName string, authorKey string, displayName string, workCount bigint, page int, nextPage int, works array<{_LISTED_DDL}>, url string"


def parse_pages(pages: DataFrame, key: str = "page_id", origin: str = ORIGIN) -> DataFrame:
    """pages (key, url, html) -> key and the page's data; pages of no known kind have kind null."""

    shape = to_arrow_type(T.StructType.fromDDL(PAGE_DDL))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                got = pa.array([parse_page(u, h, origin) for u, h in zip(part.column(1).to_pylist(), part.column(2).to_pylist())], shape)
                yield pa.RecordBatch.from_arrays([part.column(0), *got.flatten()], names=["__key", *shape.names])

    slim = pages.select(F.col(key).alias("__key"), "url", "html")
    kind = slim.schema["__key"].dataType.simpleString()
    return slim.mapInArrow(run, f"__key {kind}, {PAGE_DDL}").withColumnRenamed("__key", key)


def listed_works(parsed: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, position, workId, ...) of the works that listing pages show."""
    return parsed.select(key, "kind", F.posexplode("works").alias("position", "work")).select(key, "kind", "position", "work.*")
