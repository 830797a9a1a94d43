"""Main text of web pages by composite text density.

Every element of the DOM has a density: its characters for each tag below it, adjusted
by its links (characters and tags inside links count against it, measured against the
share of link text in the whole body). The element whose children have the largest sum
of densities is where the prose is. The smallest density on the path from there to the
body is the threshold: a sibling of the same kind (tag and class) that reaches it is
more of the same text, so the subtree grows to their parent; within a declared article
(or main part) it grows to that. The text of this one subtree is the result, whole.

Left out before anything is measured: elements that hold no prose (scripts, styles,
forms, …), and page furniture that says what it is by its tag, role, class or id (menus,
headers, footers, sidebars, notices, adverts, reader comments). A class or id does not
count if the element holds the page's `main` or headline.

The parser is tolerant: end tags may be missing or superfluous, attributes unquoted,
comments and scripts unclosed (they then reach to the end). Each step is linear in the
length of the page, however deep or broken it is.

Defined cases: NULL and empty html give an empty text, as do pages without prose; rows
are independent, so repeated rows give equal results; nothing is cut, whatever the length.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements of HTML by their role in parsing and layout.
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes noscript".split())
HEAD = frozenset("title meta link script style base noscript template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s "
                   "samp small span strike strong sub sup time tt u var wbr img".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer "
                     "form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: An element that a new one of the same list ends, unless one of the scopes lies between.
SIBLINGS = {name: frozenset(group.split()) for group in ("li", "dd dt", "tr", "td th", "thead tbody tfoot", "option")
            for name in group.split()}
SCOPES = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("tr", "table"),
          "th": ("tr", "table"), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",),
          "option": ("select", "datalist"), "p": ("button", "table", "td", "th")}
# Elements without prose of the article.
NO_PROSE = frozenset("head script style noscript template svg canvas iframe object embed audio video form button select "
                     "textarea input datalist nav aside footer menu dialog title noembed noframes".split())
NO_PROSE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar "
                           "toolbar".split())
# Words in a class or id that name page furniture, and words around them that take that meaning away.
FURNITURE = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar aside "
    "rail comment comments commentlist commentarea discussion disqus respond reply replies cookie cookies consent gdpr "
    "notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing "
    "social related recommended recommendations teaser teasers menu nav navbar navigation breadcrumb breadcrumbs "
    "pagination pager footer toolbar skiplink widget widgets paywall disclaimer cta".split())
HEADERS = frozenset("header masthead banner topbar".split())
WITHOUT = frozenset("no not has with without is hide show".split())
AROUND = frozenset("wrap wrapper wrapped container open closed enabled disabled layout".split())

_TAG = re.compile(r"<(?:!--|(/?)([a-zA-Z][^\s/>]*)|[!?/])")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


def _names(text: str) -> set[str]:
    """The words of class names and ids, without those of names such as `no-sidebar`."""
    words = set()
    for name in _CAMEL.sub("-", text).lower().split():
        parts = re.split("[^a-z0-9]+", name)
        if parts[0] not in WITHOUT and parts[-1] not in AROUND:
            words.update(parts)
    return words


def _end_of_tag(html: str, at: int) -> int:
    """Where the tag ends: at the first `>` outside quotes, else at the first one."""
    first = html.find(">", at)
    if first < 0:
        return len(html)
    if '"' not in html[at:first] and "'" not in html[at:first]:
        return first + 1
    stop, n = at, len(html)
    while stop < n:
        char = html[stop]
        if char == ">":
            return stop + 1
        if char in "\"'":
            close = html.find(char, stop + 1)
            if close < 0:
                return first + 1
            stop = close
        stop += 1
    return first + 1


class Page:
    """Elements in page order (`tag`, `kind`, `parent`, `last` descendant) and the text between their tags."""

    def __init__(self, html: str):
        self.tag, self.kind, self.parent, self.last = ["#page"], [""], [0], [0]
        self.runs: list[tuple[int, str]] = []
        self._stack, self._open, self._blocks = [0], {}, [0]
        self.dropped: list[int] = []
        self.named: list[tuple[int, bool]] = []
        self._parse(html)
        while len(self._stack) > 1:
            self._pop()
        self.last[0] = len(self.tag) - 1

    def _push(self, name: str, kind: str) -> int:
        node = len(self.tag)
        self.tag.append(name)
        self.kind.append(kind)
        self.parent.append(self._stack[-1])
        self.last.append(node)
        self._open.setdefault(name, []).append(len(self._stack))
        if name not in INLINE:
            self._blocks.append(len(self._stack))
        self._stack.append(node)
        return node

    def _pop(self) -> None:
        node = self._stack.pop()
        name = self.tag[node]
        self.last[node] = len(self.tag) - 1
        self._open[name].pop()
        if name not in INLINE:
            self._blocks.pop()
            self.runs.append((node, " "))

    def _cut(self, depth: int) -> None:
        while len(self._stack) > depth:
            self._pop()

    def _depth(self, names) -> int:
        """The depth of the innermost open element of these names, 0 if none."""
        return max((self._open[n][-1] for n in names if self._open.get(n)), default=0)

    def _text(self, run: str) -> None:
        if self.tag[self._stack[-1]] == "head" and run.strip():
            self._pop()
        self.runs.append((self._stack[-1], unescape(run) if "&" in run else run))

    def _start(self, name: str, attributes: str) -> None:
        if name in ("html", "body") and self._open.get(name):
            return
        if name not in HEAD and self._open.get("head"):
            self._cut(self._depth(("head",)))
        if name in CLOSES_P:
            depth = self._depth(("p",))
            if depth > self._depth(SCOPES["p"]):
                self._cut(depth)
        if name in SIBLINGS:
            depth = self._depth(SIBLINGS[name])
            if depth > self._depth(SCOPES[name]):
                self._cut(depth)
        if name not in INLINE:
            self.runs.append((self._stack[-1], " "))
        found = {}
        if attributes.strip(" /"):
            for key, value in _ATTRIBUTE.findall(attributes):
                found.setdefault(key.lower(), value.strip("\"'"))
        node = self._push(name, found.get("class", "").lower())
        if not self._judge(node, name, found) and ("class" in found or "id" in found):
            words = _names(f"{found.get('class', '')} {found.get('id', '')}")
            if words & HEADERS and not self._depth(("article", "main")):
                self.named.append((node, True))
            elif words & FURNITURE:
                self.named.append((node, False))
        if name in VOID:
            self._pop()

    def _judge(self, node: int, name: str, found: dict[str, str]) -> bool:
        """Notes an element that is certainly no part of the article."""
        style = found.get("style", "").lower().replace(" ", "")
        if (name in NO_PROSE or found.get("role", "").lower() in NO_PROSE_ROLES or "hidden" in found
                or found.get("aria-hidden", "").lower() == "true" or "display:none" in style
                or name == "header" and not self._depth(("article", "main"))):
            self.dropped.append(node)
            return True
        return name in ("html", "body", "main", "#page")

    def _end(self, name: str) -> None:
        depth = self._depth((name,))
        # an inline end tag does not close the blocks around it
        if depth and not (name in INLINE and depth < self._blocks[-1]):
            self._cut(depth)

    def _parse(self, html: str) -> None:
        at, n = 0, len(html)
        ends: dict[str, int] = {}
        while at < n:
            match = _TAG.search(html, at)
            if not match:
                self._text(html[at:])
                return
            if match.start() > at:
                self._text(html[at:match.start()])
            name = match[2]
            if name is None:
                comment = html.startswith("<!--", match.start())
                stop = html.find("-->" if comment else ">", match.start() + (2 if comment else 1))
                at = n if stop < 0 else stop + (3 if comment else 1)
                continue
            name, stop = name.lower(), _end_of_tag(html, match.end())
            if match[1]:
                self._end(name)
            else:
                self._start(name, html[match.end():stop - 1])
                if name in RAW:
                    if ends.get(name, 0) < stop:
                        close = _RAW_END[name].search(html, stop)
                        ends[name] = close.start() if close else n
                    stop = ends[name]
                    self._end(name)
            at = stop


def _left_out(page: Page) -> bytearray:
    """1 for each element that is no part of the article, below or at one that was noted."""
    holds = {"main": [], "h1": []}
    for node, name in enumerate(page.tag):
        if name in holds:
            holds[name].append(node)

    def has(name: str, node: int) -> bool:
        at = bisect_left(holds[name], node)
        return at < len(holds[name]) and holds[name][at] <= page.last[node]

    noted = set(page.dropped)
    noted.update(node for node, header in page.named
                 if not has("main", node) and (header or not has("h1", node)))
    out = bytearray(len(page.tag))
    for node in range(1, len(page.tag)):
        out[node] = out[page.parent[node]] or node in noted
    return out


def main_text(html: str | None) -> str:
    """The main text of one page."""
    page = Page(html or "")
    n, out = len(page.tag), _left_out(page)
    link = bytearray(n)
    for node in range(1, n):
        link[node] = link[page.parent[node]] or page.tag[node] == "a"
    # characters, tags, characters in links, links of each subtree
    chars, tags, in_links, links = [0] * n, [0] * n, [0] * n, [0] * n
    own = [0] * n
    for node, run in page.runs:
        if not out[node] and run != " ":
            own[node] += sum(map(len, run.split()))
    for node in range(n - 1, -1, -1):
        if out[node]:
            continue
        chars[node] += own[node]
        in_links[node] += own[node] * link[node]
        if node:
            up = page.parent[node]
            chars[up] += chars[node]
            in_links[up] += in_links[node]
            tags[up] += tags[node] + 1
            links[up] += links[node] + (page.tag[node] == "a")
    body = next((i for i in range(n) if page.tag[i] == "body"), 0)
    share = in_links[body] / max(chars[body], 1)

    def density(node: int) -> float:
        c, t, lc, lt = chars[node], max(tags[node], 1), in_links[node], links[node]
        if not c:
            return 0.0
        base = log(c / max(c - lc, 1) * lc + share * c + e)
        if base <= 1:  # a body without links
            return c / t
        return max(0.0, c / t * log(c / max(lc, 1) * t / max(lt, 1)) / log(base))

    dense, total = [0.0] * n, [float(x) for x in own]
    for node in range(n - 1, 0, -1):
        if not out[node]:
            dense[node] = density(node)
            total[page.parent[node]] += dense[node]
    dense[0] = density(0)
    inside = [i for i in range(body, page.last[body] + 1) if not out[i]]
    if not inside:
        return ""
    top = max(inside, key=lambda i: (total[i], -i))
    path = [top]
    while path[-1] != body:
        path.append(page.parent[path[-1]])
    threshold = min(dense[i] for i in path)
    alike: dict[tuple[int, str, str], int] = {}
    for i in inside:
        if i != body and dense[i] >= threshold and chars[i]:
            key = (page.parent[i], page.tag[i], page.kind[i])
            alike[key] = alike.get(key, 0) + 1
    for i, node in enumerate(path[:-1]):
        if alike[page.parent[node], page.tag[node], page.kind[node]] > 1:
            top = path[i + 1]
    for wanted in ("article", "main"):
        found = [node for node in path if page.tag[node] == wanted]
        if found:
            top = found[0]
            break
    last, parts = page.last[top], []
    for node, run in page.runs:
        if top <= node <= last and not out[node]:
            parts.append(" " if page.tag[node] == "br" else run)
    return " ".join("".join(parts).split())


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """`id`, `url`, `text` and `n_chars` (code points) of every page."""
    slim = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), F.col(html).alias("html"))

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array(map(len, texts), pa.int64())], names=["id", "url", "text", "n_chars"])

    kinds = {c: slim.schema[c].dataType.simpleString() for c in ("id", "url")}
    return slim.mapInArrow(extracted, f"id {kinds['id']}, url {kinds['url']}, text string, n_chars bigint")
