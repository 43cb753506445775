"""Main text of web pages by consensus of the paths of a host's pages.

1. Each page is read into blocks (paragraphs, headings, list items, cells ...) that belong to
   containers (body, article, main, section, div ...). Parts that are never main text are left
   out: scripts and styles, menus, forms, and elements whose tag, role, class or id names them
   as header, footer, sidebar, notice, advert or reader comments. A name that only mentions such
   a part ("related-work") counts in the article if links or form fields make up the content, and
   ids of headings, paragraphs and inline elements never do. The page chooses the
   outermost container that stands clear of such parts and of blocks of links, with all
   remaining text in it: nothing else beside it is given up, and an article is never cut.
2. The page votes for the generalised path of its container: tags with classes, digits and
   positions left out. Votes are summed per host and path; the path with most votes wins.
3. Each page is extracted again from the containers at its host's winning path, with the
   headings, paragraphs, lists, tables and quotes that stand beside them in the page's own
   choice, or from its own choice where it has none.

Defined results: a null or empty html gives an empty text; unclosed, stray and cut-off tags
are closed where HTML would close them; a null url is a host of its own; repeated rows vote
each; an empty table gives an empty result; other columns are ignored. Pages are used whole.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, written

#: Winning paths are broadcast up to so many hosts, and joined by shuffle (salted) beyond.
BROADCAST_HOSTS = 200_000
SALTS = 64

_TAG = re.compile(r"""<(?:!--.*?(?:--!?>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)(?:>|\Z)|[!?/][^>]*+(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|aria-label|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_SPLIT = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")
_END = re.compile(r"</([a-zA-Z][^\s/>]*)")
_HOST = re.compile(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")

#: How HTML elements behave.
_RAW = frozenset(("script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "canvas", "select", "head"))
_VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
_CONTAINERS = frozenset(("body", "article", "main", "section", "div", "td", "center", "table", "tbody", "tr", "ul", "ol", "dl", "blockquote", "figure", "details", "fieldset", "header"))
_BLOCKS = frozenset(("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "pre", "th", "figcaption", "summary", "caption", "address", "hr", "html", "nav", "footer", "aside", "form", "thead", "tfoot")) | _CONTAINERS
#: Containers that are content, not page structure.
_CONTENT = frozenset(("table", "ul", "ol", "dl", "blockquote", "figure", "details"))
_SKIPPED = frozenset(("nav", "footer", "aside", "form", "button", "menu", "dialog", "input"))
#: Fixed value: words of a class, id or role that name a part outside the article.
_OUTSIDE = frozenset((
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "adslot", "adbox", "sponsor", "sponsored", "sponsors", "promo", "promotion", "banner",
    "nav", "navbar", "navigation", "menu", "menus", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc", "skip",
    "sidebar", "aside", "widget", "widgets", "related", "recommended", "recommendations", "trending", "popular",
    "footer", "foot", "copyright", "header", "masthead", "topbar", "toolbar",
    "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal", "overlay", "paywall",
    "comment", "comments", "disqus", "respond", "replies", "reply", "reviews",
    "share", "sharing", "social", "newsletter", "subscribe", "subscription", "signup", "login", "search", "form", "hidden", "contentinfo", "complementary"))
#: Words that mark the article itself, whatever else the class says.
_INSIDE = frozenset(("article", "content", "post", "entry", "story", "main", "body", "text"))


#: Words that leave a name's meaning as it is: "related-posts" is a page part, "related-work" is not.
_NEUTRAL = frozenset((
    "left", "right", "top", "bottom", "inner", "outer", "main", "primary", "secondary", "global", "site", "page", "mobile", "desktop", "sticky", "fixed", "js", "the", "my", "of", "and",
    "box", "block", "bar", "wrap", "wrapper", "container", "holder", "section", "area", "region", "panel", "module", "component", "group", "row", "col", "column", "slot", "unit", "zone", "placeholder",
    "list", "item", "items", "link", "links", "button", "buttons", "btn", "icon", "icons", "message", "text", "content", "title", "heading", "body", "post", "posts", "article", "articles", "story", "stories", "media", "tags", "thread", "trail", "us", "now"))
#: Words that also describe what a paragraph says; of such an element alone they name no page part.
_TOPICS = frozenset(("alert", "notice", "notices", "notification", "related", "recommended", "recommendations", "popular", "trending", "reviews", "search", "promotion", "header", "foot", "form", "reply", "replies", "comment", "menu"))
#: A form field counts as so many characters of links.
FIELD = 40


def _names(attributes: str) -> tuple[list[str], list[tuple[str, list[str]]], bool]:
    """(classes, (attribute, words) of each class, id and role, hidden)."""
    classes, names, hidden = [], [], False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m.group(1).lower(), (m.group(2) or "").strip("\"'")
        if key == "hidden" or key == "aria-hidden":
            hidden |= m.group(2) is None or key == "aria-hidden" and value.lower() == "true" or key == "hidden"
        elif key == "aria-label":
            continue
        else:
            if key == "class":
                classes = value.split()
            names += [(key, words) for x in value.split() if (words := [w for w in _SPLIT.split(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", x).lower()) if w])]
    return classes, names, hidden


def _words(names: list[tuple[str, list[str]]]) -> list[str]:
    return [w for _, words in names for w in words]


def _whole(words: list[str]) -> bool:
    """Whether the name as a whole names a page part."""
    return any(w in _OUTSIDE for w in words) and all(w in _OUTSIDE or w in _NEUTRAL for w in words)


def _outside(tag: str, names: list[tuple[str, list[str]]], in_article: bool) -> bool | None:
    """Whether the element is outside the article; None if its content decides."""
    if tag in _SKIPPED or tag == "header" and not in_article:
        return True
    if tag in ("body", "html", "article", "main"):
        return False
    if tag not in _CONTAINERS or tag in _CONTENT:  # a heading, paragraph, list or inline element: its id is a link target
        return any(key != "id" and _whole(words) and any(w in _OUTSIDE and w not in _TOPICS for w in words) for key, words in names)
    words = _words(names)
    if not any(w in _OUTSIDE for w in words):
        return False
    # "post-content comments-open": a name of the article wins, unless the last word says otherwise
    if words[-1] in _INSIDE:
        return False
    if any(_whole(x) for _, x in names):
        return True
    # outside the article a class that mentions a part will do; an id may be made from a heading
    return True if not in_article and any(w in _OUTSIDE for key, x in names if key != "id" for w in x) else None


def _child_key(parent: int, label: str) -> int:
    """Number of a path in this process: equal paths have equal ones."""
    return hash((parent, label))


def _mostly_links(text: str, links: int) -> bool:
    return 1.5 * links >= len(text)


class Page:
    """Blocks and containers of one page."""

    def __init__(self, html: str):
        self.parent, self.label, self.key, self.boost = [-1], ["body"], [_child_key(0, "body")], [1.0]  # key: of the path from the body
        self.tag, self.framed = ["body"], [False]  # framed: a part that is never main text lies directly in it
        self.blocks: list[tuple[int, str, int, str]] = []  # container, text, characters in links, tag
        self._read(html)

    def path(self, i: int) -> str:
        """Generalised path of a container."""
        labels = []
        while i >= 0:
            labels.append(self.label[i])
            i = self.parent[i]
        return ">".join(reversed(labels))

    def _read(self, html: str) -> None:
        # open elements: (tag, container, skipped, is block); the first stands for the body
        stack: list[tuple[str, int, bool, bool]] = [("body", 0, False, True)]
        open_tags: Counter = Counter()  # how often each tag is open, so that an end without a start costs no search
        last_end = {m.group(1).lower(): m.start() for m in _END.finditer(html)}
        text: list[str] = []
        links, kind, at, n, link_depth, fields = 0, "p", 0, len(html), 0, 0
        doubts: list[tuple[int, int, int, int]] = []  # open elements: depth, first block, fields before, container

        def flush(container: int) -> None:
            nonlocal links
            if text:
                block = " ".join("".join(text).split())
                if block:
                    self.blocks.append((container, block, links, kind))
                text.clear()
            links = 0

        def close(i: int) -> None:
            nonlocal link_depth
            if any(e[3] for e in stack[i:]):
                flush(stack[-1][1])
            judge(i)
            for e in stack[i:]:
                open_tags[e[0]] -= 1
                link_depth -= e[0] == "a"
            del stack[i:]

        def judge(i: int) -> None:
            """Leave out what ends at depth i if its name mentions a page part and its content is one."""
            while doubts and doubts[-1][0] >= i:
                _, first, before, container = doubts.pop()
                held = self.blocks[first:]
                if 2 * (sum(b[2] for b in held) + FIELD * (fields - before)) > sum(len(b[1]) for b in held):
                    del self.blocks[first:]
                    self.framed[container] = True

        def find(names, stop=()) -> int:
            if not any(open_tags[x] for x in names):
                return 0
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in names:
                    return i
                if stack[i][0] in stop:
                    return 0
            return 0

        find_tag = _TAG.search
        while at < n:
            s = html.find("<", at)
            m = find_tag(html, s) if s >= 0 else None
            end = m.start() if m else n
            if end > at and not stack[-1][2]:
                piece = unescape(html[at:end]) if "&" in html[at:end] else html[at:end]
                text.append(piece)
                if link_depth:
                    links += len(piece)
            if not m:
                break
            at = m.end()
            tag = (m.group(2) or "").lower()
            if not tag:
                continue
            if m.group(1):  # an end tag
                if tag in ("p", "br"):
                    i = find(("p",), _CONTAINERS) if tag == "p" else 0
                    if i:
                        close(i)
                    elif not stack[-1][2]:
                        flush(stack[-1][1]) if tag == "p" else text.append(" ")
                elif tag not in ("html", "body"):
                    i = find((tag,), () if tag in _BLOCKS else _BLOCKS)
                    if i:
                        close(i)
                continue
            fields += tag in ("input", "select", "textarea", "button")
            if tag in _RAW:
                if tag != "head" and not m.group(3).endswith("/"):
                    e = re.compile(f"</{tag}(?=[\\s/>])|</{tag}\\Z", re.I).search(html, at) if last_end.get(tag, -1) >= at else None
                    if e:
                        g = html.find(">", e.start())
                        at = g + 1 if g >= 0 else n
                    elif tag not in ("svg", "noscript", "canvas", "select"):
                        at = n
                elif tag == "head":
                    pass
                if not stack[-1][2] and tag not in ("svg", "canvas", "select"):
                    text.append(" ") if text else None
                continue
            if tag in _VOID:
                if tag == "hr":
                    flush(stack[-1][1])
                elif tag in ("br", "img", "wbr", "input") and tag != "wbr" and not stack[-1][2]:
                    text.append(" ")
                continue
            if tag in ("html", "body"):
                continue
            block = tag in _BLOCKS
            if block:
                i = find(("p",), _CONTAINERS | {"button"})
                if i:
                    close(i)
                if tag == "li":
                    i = find(("li",), ("ul", "ol"))
                elif tag in ("dt", "dd"):
                    i = find(("dt", "dd"), ("dl",))
                elif tag in ("td", "th"):
                    i = find(("td", "th"), ("table", "tr"))
                elif tag == "tr":
                    i = find(("tr",), ("table",))
                elif stack[-1][2] and (tag in ("article", "main") or any(w in _INSIDE for w in _words(_names(m.group(3))[1]))):
                    # an article within a menu or notice: that was never closed, or nests by mistake
                    j = bisect.bisect_left(stack, True, key=lambda e: e[2])  # all within a skipped element are skipped
                    i = 0 if open_tags["article"] or open_tags["main"] or last_end.get(stack[j][0], -1) >= at and tag not in ("article", "main") else j
                else:
                    i = 0
                if i:
                    close(i)
                flush(stack[-1][1])
            _, container, skipped, _ = stack[-1]
            if not skipped and (block or m.group(3)):
                classes, names, hidden = _names(m.group(3)) if m.group(3) else ([], [], False)
                in_article = open_tags["article"] + open_tags["main"] > 0
                outside = _outside(tag, names, in_article or tag != "header" and self.boost[container] > 1)
                if outside is None and not hidden:
                    doubts.append((len(stack), len(self.blocks), fields, container))
                skipped = hidden or bool(outside)
                self.framed[container] |= skipped
                if not skipped and tag in _CONTAINERS:
                    label = ".".join([tag, *sorted({re.sub(r"[0-9]+", "", c).strip("-_").lower() for c in classes} - {""})]).replace(">", "")
                    self.parent.append(container)
                    self.label.append(label)
                    self.key.append(_child_key(self.key[container], label))
                    self.tag.append(tag)
                    self.framed.append(False)
                    good = tag in ("article", "main") or any(w in _INSIDE for w in _words(names))
                    self.boost.append(max(self.boost[container], 2.0 if good else 1.0))
                    container = len(self.parent) - 1
            elif tag in _SKIPPED:
                self.framed[container] |= not skipped
                skipped = True
            if block and not skipped:
                kind = tag
            if tag == "a":
                link_depth += 1
            if not m.group(3).endswith("/") or tag not in ("path",):
                stack.append((tag, container, skipped, block))
                open_tags[tag] += 1
        flush(stack[-1][1])
        judge(0)

    def weights(self) -> list[float]:
        """Of each container with all below it."""
        w = [0.0] * len(self.parent)
        for container, text, links, tag in self.blocks:
            full = max(0, len(text) - 1.5 * links)
            w[container] += full * self.boost[container] * (0.3 if tag in ("li", "td", "th") else 1.0)
        for i in range(len(w) - 1, 0, -1):
            w[self.parent[i]] += w[i]
        return w

    def sizes(self) -> tuple[list[int], list[int]]:
        """Of each container with all below it: characters, and those of blocks that are not mostly links."""
        whole, own = [0] * len(self.parent), [0] * len(self.parent)
        for container, text, links, _ in self.blocks:
            whole[container] += len(text)
            own[container] += 0 if _mostly_links(text, links) else len(text)
        for i in range(len(own) - 1, 0, -1):
            whole[self.parent[i]] += whole[i]
            own[self.parent[i]] += own[i]
        return whole, own

    def choice(self) -> int:
        """The outermost container that stands clear of the page's frame and leaves no text behind."""
        whole, own = self.sizes()
        full: list[list[int]] = [[] for _ in own]
        for i in range(1, len(own)):
            if own[i]:
                full[self.parent[i]].append(i)
        at = best = 0
        while self.tag[at] != "article" and len(full[at]) == 1 and own[full[at][0]] == own[at]:
            child = full[at][0]
            if self.framed[at] or whole[child] < whole[at]:
                best = child
            at = child
        return best

    def text_of(self, chosen: set[int], around: int | None = None) -> str:
        """The text of the chosen containers, with the content that stands directly in the containers
        between them and ``around``."""
        within, line = [False] * len(self.parent), set()
        if around is not None:
            for i in range(len(within)):
                within[i] = i == around or self.parent[i] >= 0 and within[self.parent[i]]
            for i in chosen:
                while i != around and within[i]:
                    i = self.parent[i]
                    line.add(i)
            own = self.sizes()[1]
        inside = [False] * len(self.parent)
        for i in range(len(inside)):
            up = self.parent[i]
            inside[i] = i in chosen or up >= 0 and (inside[up] or up in line and self.tag[i] in _CONTENT and own[i] > 0)
        return "\n".join(b[1] for b in self.blocks if inside[b[0]] or b[0] in line and not _mostly_links(b[1], b[2]))

    def extract(self, path: str | None) -> str:
        """The text at ``path``, or of the page's own choice where that has none."""
        key = 0
        for label in (path or "").split(">"):
            key = _child_key(key, label)
        own, chosen = self.choice(), {i for i, k in enumerate(self.key) if k == key}
        return (self.text_of(chosen, own) if chosen and self.text_of(chosen) else "") or self.text_of({own})


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m.group(1).lower() if m else ""


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums: dict[tuple[str, str], list[float]] = {}
        for url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            page = Page(html or "")
            w = page.weights()
            if w[0] > 0:
                i = page.choice()
                s = sums.setdefault((host_of(url), page.path(i)), [0, 0.0])
                s[0] += 1
                s[1] += w[i]
        rows = [(h, p, v, s) for (h, p), (v, s) in sums.items()]
        cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.float64())], names=["host", "path", "votes", "score"])


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the winning path of every host; ties go to the greater score, then the smaller path."""
    votes = pages.select("url", "html").mapInArrow(frugal(_votes), "host string, path string, votes long, score double")
    total = votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("score").alias("score"))
    best = F.max_by("path", F.struct("votes", F.round("score", 3), F.length("path") * -1))
    return total.groupBy("host").agg(best.alias("path"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [Page(html).extract(path) if html else "" for html, path in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars per page."""
    rows = pages.select(F.col("page_id").cast("long"), "url", "html")
    winners = written(host_paths(rows), "host-paths")
    host = F.lower(F.coalesce(F.regexp_extract("url", _HOST.pattern, 1), F.lit("")))
    keyed = rows.withColumn("host", host)
    if winners.count() <= BROADCAST_HOSTS:
        joined = keyed.join(F.broadcast(winners), "host", "left")
    else:  # a host may hold a third of all pages
        salted = winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = keyed.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    return joined.select("page_id", "url", "html", "path").mapInArrow(frugal(_extract), "page_id long, url string, text string, n_chars long")


def op10_frame(pages: DataFrame) -> DataFrame:
    return extract_pages(pages)
