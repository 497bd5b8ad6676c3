"""Main text of web pages by minimum-cut labelling of their blocks.

A page becomes a sequence of text blocks, each in its place in the tree of elements. A small classifier
(``block_weights.py``, fitted on generated pages) prices the two labels of a block (terminal capacities);
neighbouring blocks pay for different labels, the more the closer they are in reading order and in the
element tree (smoothness edges). The maximum flow from the content terminal to the boilerplate terminal
finds the cheapest labelling; the blocks on the content side, joined in page order, are the text.

Evidence against content that an element carries (a form, a class "search-results") counts the less the
more of the page's article stands inside it: what holds nearly all of the text cannot be clutter in it.

The tag scanner follows the attribute rules of HTML: a quote matters only where a value begins, unquoted
values may hold quotes. It accepts tags without an end, unclosed elements, stray end tags, bare ``<`` and
``&``. Only script, style, title and textarea reach to the end of the page when they are not closed;
other elements that are not shown, and are not closed, are gone on in. Character references are decoded,
white space inside a block (line breaks included) becomes one space.

Defined cases: null or empty html gives the empty text; a page without content blocks too; repeated
rows and null ids are pages of their own; an empty table gives an empty result; very long or broken pages
are scanned in one pass (end tags are indexed once, elements nest at most DEEPEST deep, deeper ones become
siblings without losing text) and cut by a flow whose graph has a few edges per block; only page_id,
url and html are read.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .block_weights import BIAS, CAP, LENGTH, LINKS, SENTENCE, WEIGHTS

# A quote opens a value only after "="; the quantifiers are possessive, so a failed match is not tried again.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+|(?=>)))*+)>")
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)>?")  # after a value that never ends
PAIR = re.compile(r"([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+")
NAMING = {"class", "id", "role", "aria-label", "itemprop"}
NOT_SHOWN = re.compile(r"hidden|display", re.I)  # a quick look before the attributes are taken apart
WORD = re.compile(r"[a-z]+")
ENDS = re.compile(r"</(script|style|title|textarea)(?=[\s/>])", re.I | re.A)
ELEMENT = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|title|textarea)(?=[\s/>]).*?(?:</\1(?=[\s/>])|\Z)"
                     r"|<(/?)([a-zA-Z][^\s/<>]*+)", re.S | re.I | re.A)

# Fixed values of HTML: elements by kind.
ENDLESS = {"script", "style", "title", "textarea"}
UNSEEN = {"noscript", "template", "iframe", "svg", "math", "object", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i",
          "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong",
          "sub", "sup", "time", "tt", "u", "var", "br", "img", "wbr"}
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure",
            "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre",
            "section", "table", "ul"}
ENDED = ("p", "h1", "h2", "h3", "h4", "h5", "h6")
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
        "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"ul", "ol", "menu", "dl", "table", "article", "section", "div", "main", "body", "aside", "nav", "header", "footer"}

CHAIN, TREE = 1.2, 0.6
DEEPEST = 512


class Block:
    __slots__ = ("element", "text", "linked")

    def __init__(self, element: int, text: str, linked: int):
        self.element, self.text, self.linked = element, text, linked


def pairs(attributes: str) -> Iterator[tuple[str, str]]:
    for m in PAIR.finditer(attributes):
        yield m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or "")


def names_of(name: str, attributes: str) -> list[str]:
    """What the classifier knows an element by: its name, and the words of its naming attributes."""
    found = [f"<{name}>"] if f"<{name}>" in WEIGHTS else []
    if attributes and name not in ("html", "body"):
        words = {w for key, value in pairs(attributes) if key in NAMING for w in WORD.findall(value.lower())}
        found += sorted(w for w in words if w in WEIGHTS)
    return found


def hidden(attributes: str) -> bool:
    """Whether an element is not shown by its own attributes: hidden, aria-hidden, or display: none in its style."""
    if not NOT_SHOWN.search(attributes):
        return False
    for name, value in pairs(attributes):
        value = value.strip().lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style":
            for declaration in value.split(";"):
                what, _, how = declaration.partition(":")
                if what.strip() == "display" and how.replace("!", " ").split()[:1] == ["none"]:
                    return True
    return False


class Page:
    """Blocks of a page and the tree of elements they stand in."""

    def __init__(self, html: str):
        self.html = html
        self.blocks: list[Block] = []
        self.names, self.parent, self.depth = ["#root"], [-1], [0]
        self.words: list[list[str]] = [[]]  # by element number, for the classifier
        self.stack, self.parts, self.linked = [0], [], 0
        self.opened: Counter[str] = Counter()
        self.inside_link = 0
        self.raw_ends: dict[str, list[int]] | None = None
        self.element_ends: dict[int, int] | None = None
        self.scan()
        self.flush()

    def scan(self) -> None:
        html, at, tag = self.html, 0, TAG
        while at < len(html):
            start = html.find("<", at)
            if start != at:
                self.add(html[at:start] if start >= 0 else html[at:])
                if start < 0:
                    return
            after = html[start + 1:start + 3]
            letter = after[1:2] if after[:1] == "/" else after[:1]
            if not ("a" <= letter <= "z" or "A" <= letter <= "Z"):
                at = self.markup(start, after)
                continue
            match = tag.match(html, start)
            if match is None:
                tag = LOOSE
                match = tag.match(html, start)
            at = match.end()
            name, attributes = match[2].lower(), match[3]
            if match[1]:
                self.close(name)
                continue
            if not attributes.endswith("/"):
                if name in ENDLESS:
                    at = self.raw_end(name, at)
                    continue
                if name in UNSEEN or name not in VOID and hidden(attributes):
                    end = self.element_end(start)
                    if end is not None:
                        if name not in INLINE and name not in UNSEEN:
                            self.flush()
                        at = end
                        continue
            elif name in ENDLESS or name in UNSEEN:
                continue
            if name not in UNSEEN:
                self.open(name, attributes)

    def markup(self, start: int, after: str) -> int:
        """End of a comment or declaration; a ``<`` that begins neither is text."""
        html = self.html
        if after[:1] not in ("!", "?", "/") or not after[:1]:
            self.add("<")
            return start + 1
        if html.startswith("<!--", start):
            end = html.find("-->", start + 2)
            return end + 3 if end >= 0 else len(html)
        end = html.find(">", start)
        return end + 1 if end >= 0 else len(html)

    def raw_end(self, name: str, at: int) -> int:
        """Start of the end tag of a raw text element, or the end of the page."""
        if self.raw_ends is None:
            self.raw_ends = {}
            for m in ENDS.finditer(self.html):
                self.raw_ends.setdefault(m[1].lower(), []).append(m.start())
        places = self.raw_ends.get(name, [])
        k = bisect_left(places, at)
        return places[k] if k < len(places) else len(self.html)

    def element_end(self, start: int) -> int | None:
        """Where the element that begins at ``start`` ends, nested elements of its name counted; None if it is not closed."""
        if self.element_ends is None:
            self.element_ends = {}
            pending: dict[str, list[int]] = {}
            for m in ELEMENT.finditer(self.html):
                if not m[3]:
                    continue
                name = m[3].lower()
                if name in VOID:
                    continue
                if m[2]:
                    if pending.get(name):
                        end = self.html.find(">", m.start())
                        self.element_ends[pending[name].pop()] = end + 1 if end >= 0 else len(self.html)
                    continue
                if name in CLOSES_P and pending.get("p"):
                    for at in pending.pop("p"):
                        self.element_ends[at] = m.start()
                pending.setdefault(name, []).append(m.start())
        return self.element_ends.get(start)

    def add(self, text: str) -> None:
        self.parts.append(text)
        if self.inside_link:
            self.linked += len(text.strip())

    def flush(self) -> None:
        if self.parts:
            text = " ".join(entities.unescape("".join(self.parts)).split())
            if text:
                self.blocks.append(Block(self.stack[-1], text, self.linked))
            self.parts, self.linked = [], 0

    def pop(self, to: int) -> None:
        """Close all elements from place ``to`` of the stack on."""
        for element in self.stack[to:]:
            self.opened[self.names[element]] -= 1
        del self.stack[to:]

    def open(self, name: str, attributes: str) -> None:
        if name in INLINE:
            if name == "br":
                self.parts.append(" ")
            elif name == "a":
                self.inside_link = 1
            return
        self.flush()
        self.inside_link = 0
        if name in VOID:
            return
        names, stack = self.names, self.stack
        if name in CLOSES_P and names[stack[-1]] in ENDED:
            self.pop(len(stack) - 1)
        if name in SAME and any(self.opened[x] for x in SAME[name]):
            for at in range(len(stack) - 1, 0, -1):
                if names[stack[at]] in SAME[name]:
                    self.pop(at)
                    break
                if names[stack[at]] in SCOPES:
                    break
        if len(stack) > DEEPEST:
            self.pop(len(stack) - 1)
        self.parent.append(stack[-1])
        self.depth.append(len(stack))
        names.append(name)
        self.words.append(names_of(name, attributes))
        self.opened[name] += 1
        stack.append(len(names) - 1)

    def close(self, name: str) -> None:
        if name in INLINE:
            if name == "a":
                self.inside_link = 0
            return
        if name in ENDLESS or name in UNSEEN:
            return
        self.flush()
        self.inside_link = 0
        if self.opened[name]:
            for at in range(len(self.stack) - 1, 0, -1):
                if self.names[self.stack[at]] == name:
                    self.pop(at)
                    return


def shares(page: Page) -> list[float]:
    """Of each element: how much of the page's article text stands inside it.

    Article text is the unlinked text of elements that say they hold it (article, main) without speaking
    against it, by themselves or by what they stand in; on pages without such elements, all unlinked text.
    """
    n = len(page.names)
    clean, marked = [True] * n, [False] * n
    for e in range(1, n):
        up, words = page.parent[e], page.words[e]
        against = any(WEIGHTS[w] < 0 and (w[0] != "<" or w in ("<nav>", "<aside>", "<footer>")) for w in words)
        holds = "<article>" in words or "<main>" in words
        clean[e] = clean[up] and not against
        marked[e] = marked[up] and not against or holds and not against and (clean[up] or not marked[up])
    plain = [0] * n
    chosen = [0] * n
    for block in page.blocks:
        size = max(0, len(block.text) - block.linked)
        plain[block.element] += size
        if marked[block.element]:
            chosen[block.element] += size
    inside = chosen if any(chosen) else plain
    for e in range(n - 1, 0, -1):
        inside[page.parent[e]] += inside[e]
    return [x / inside[0] if inside[0] else 0.0 for x in inside]


def features(page: Page) -> list[tuple[float, float, float, dict[str, float]]]:
    """(length, links, sentence, strength of every name on the way from the root) of each block."""
    share = shares(page)
    known: list[dict[str, float]] = [{}]
    for e in range(1, len(page.names)):
        held = known[page.parent[e]]
        if page.words[e]:
            strength = 1 - share[e] ** 8
            against = any(WEIGHTS[w] < -1 for w in page.words[e])
            # what an outer element says for its content does not speak for clutter inside it
            held = {w: x * (1 - strength) if against and WEIGHTS[w] > 0 else x for w, x in held.items()}
            for w in page.words[e]:
                held[w] = max(held.get(w, 0.0), strength if WEIGHTS[w] < 0 else 1.0)
        known.append(held)
    return [(min(1.0, len(b.text) / 120), min(1.0, b.linked / len(b.text)), float(b.text[-1] in ".!?:\"')”»"), known[b.element])
            for b in page.blocks]


def costs(page: Page) -> list[float]:
    """Evidence for content of each block: the price of calling it boilerplate less that of content."""
    out = []
    for length, links, sentence, names in features(page):
        value = BIAS + LENGTH * length + LINKS * links + SENTENCE * sentence
        value += min(CAP, sum(WEIGHTS[w] * x for w, x in names.items() if WEIGHTS[w] > 0))
        out.append(value + sum(WEIGHTS[w] * x for w, x in names.items() if WEIGHTS[w] < 0))
    return out


def edges(page: Page) -> Iterator[tuple[int, int, float]]:
    """(block, block, capacity): neighbours in reading order, and the last block under the same parent."""
    last: dict[int, int] = {}
    blocks, parent, depth = page.blocks, page.parent, page.depth
    for i, block in enumerate(blocks):
        if i:
            a, b, apart = blocks[i - 1].element, block.element, 0
            while a != b:
                if depth[a] >= depth[b]:
                    a = parent[a]
                else:
                    b = parent[b]
                apart += 1
            yield i - 1, i, CHAIN / (1 + apart)
        up = max(0, parent[block.element])
        if up in last and last[up] != i - 1:
            yield last[up], i, TREE / (1 + min(8, i - last[up]))
        last[up] = i


def content_side(evidence: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """Minimum cut by augmenting along shortest paths (Dinic); True for blocks on the content side."""
    n = len(evidence)
    source, sink = n, n + 1
    heads: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def join(a: int, b: int, forward: float, backward: float) -> None:
        heads[a].append(len(to))
        to.append(b)
        room.append(forward)
        heads[b].append(len(to))
        to.append(a)
        room.append(backward)

    for i, value in enumerate(evidence):
        if value > 0:
            join(source, i, value, 0.0)
        else:
            join(i, sink, -value, 0.0)
    for a, b, capacity in links:
        join(a, b, capacity, capacity)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = [source]
        for node in queue:
            for e in heads[node]:
                if room[e] > 1e-12 and level[to[e]] < 0:
                    level[to[e]] = level[node] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        at = [0] * (n + 2)
        path: list[int] = []
        node = source
        while True:
            if node == sink:
                push = min(room[e] for e in path)
                for e in path:
                    room[e] -= push
                    room[e ^ 1] += push
                cut = next(k for k, e in enumerate(path) if room[e] <= 1e-12)
                node = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while at[node] < len(heads[node]):
                e = heads[node][at[node]]
                if room[e] > 1e-12 and level[to[e]] == level[node] + 1:
                    break
                at[node] += 1
            if at[node] < len(heads[node]):
                path.append(heads[node][at[node]])
                node = to[path[-1]]
            elif not path:
                break
            else:
                level[node] = -1
                node = to[path.pop() ^ 1]


def label(evidence: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """The minimum cut. Blocks whose evidence outweighs all their edges are decided beforehand.

    Such a block keeps its label in every minimum cut, so its edges become terminal capacities of its
    neighbours; what is left undecided goes through the flow.
    """
    n = len(evidence)
    around: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for a, b, capacity in links:
        around[a].append((b, capacity))
        around[b].append((a, capacity))
    value, open_sum = list(evidence), [sum(c for _, c in near) for near in around]
    fixed: list[bool | None] = [None] * n
    queue = [i for i in range(n) if abs(value[i]) > open_sum[i]]
    for i in queue:
        if fixed[i] is not None:
            continue
        fixed[i] = value[i] > 0
        for j, capacity in around[i]:
            if fixed[j] is None:
                value[j] += capacity if fixed[i] else -capacity
                open_sum[j] -= capacity
                if abs(value[j]) > open_sum[j] + 1e-12:
                    queue.append(j)
    rest = [i for i in range(n) if fixed[i] is None]
    if rest:
        place = {i: k for k, i in enumerate(rest)}
        side = content_side([value[i] for i in rest], [
            (place[a], place[b], c) for a, b, c in links if a in place and b in place])
        for i, content in zip(rest, side, strict=True):
            fixed[i] = content
    return [bool(x) for x in fixed]


def main_text(html: str) -> str:
    """The content blocks of a page, joined by two line feeds."""
    page = Page(html)
    keep = label(costs(page), list(edges(page)))
    return "\n\n".join(block.text for block, content in zip(page.blocks, keep, strict=True) if content)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [main_text(h) if h else "" for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(scan, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, "
                                 "text string, n_chars long")
