"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one per block element. The text lengths of `WINDOW` consecutive lines are summed; where the sum rises
from little to much is a surge point, where it falls back a dive point. The regions between each surge and the next dive are the core
of the article. What is never content (menus, scripts, footers, asides and the like, by element) is left out before. Forms, elements
whose class, id or role names a menu, advert, notice, comments and the like, and menus that are never closed are left out as well, but not where they hold the
page's article: nine in ten of its long lines and all of its articles and mains; or most of its text and all of its main headings, which is what
elements named after comments have to hold. Since short paragraphs, lists and tables between and around the regions belong to the article as well, a region
grows: where articles or mains hold at least half of the text, to the innermost one that holds so much, or to another one with a quarter of its text, and regions elsewhere are
left out; on other pages to the lines of the innermost element that holds it whole, without lists of links and copyright lines at its edges.

Defined results: null, empty or text-free html gives an empty text; truncated and badly nested markup is read as far as it goes;
repeated rows give repeated results; extra columns are ignored. Reading takes time linear in the page.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .common import small_batches

WINDOW, SURGE = 3, 60

#: HTML elements by their role.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
_DROP = frozenset("aside audio button canvas datalist dialog embed footer frameset head iframe map menu nav noembed noframes noscript object option script search select style svg template textarea title video".split())
_HOLD = frozenset("article main".split())
_MENUS = frozenset("aside footer menu nav search".split())
#: Words of class, id or role that mark what is not the article.
_NOISE = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|footer|masthead|cookies?|consent|gdpr|notice|popup|modal|newsletter|subscribe|social|share|sharing|related|recommended|comment(?!ar)\w*|replies|respond|disqus|widget|toolbar|pagination|pager|skip|search|login|signup)(?:$|[\s_-])", re.I)
_TALK = re.compile(r"(?:^|[\s_-])(?:comment(?!ar)\w*|replies|respond|disqus)(?:$|[\s_-])", re.I)
_NOTICE = re.compile(r"\b(?:we|site|website|page|partners)\b.{0,80}\bcookies?\b|\bcookies?\b.{0,80}\b(?:accept|agree|consent|preferences)\b", re.I)
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_HINT = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?:\s|=|$|/)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)


def _tag_end(html: str, at: int, none: dict[str, int]) -> int:
    """Position after the > that ends the tag at `at`, quotes regarded where they are closed; len(html) if there is none."""
    n, pos = len(html), at
    while True:
        close = html.find(">", pos)
        if close < 0:
            return n
        quote = min((q for q in (html.find('"', pos, close), html.find("'", pos, close)) if q >= 0), default=-1)
        if quote < 0 or html[quote - 1 : quote].strip() not in ("=", ""):
            return close + 1
        mark = html[quote]
        end = -1 if quote >= none.get(mark, n) else html.find(mark, quote + 1)
        if end < 0:
            none[mark] = min(none.get(mark, n), quote)
            return close + 1
        pos = end + 1


class Tree:
    """Block elements in page order: name, parent, depth, last element inside, innermost article or main (0: none), whether it is noise by a hint or kind, and whether by one
    that names comments; 0 is the page."""

    def __init__(self) -> None:
        self.name, self.parent, self.depth, self.last, self.held, self.noise, self.talk = [""], [0], [0], [0], [0], [False], [False]

    def add(self, name: str, parent: int, noise: bool, talk: bool) -> int:
        k = len(self.parent)
        self.name.append(name)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.last.append(k)
        self.held.append(k if name in _HOLD and not noise else self.held[parent])
        self.noise.append(noise)
        self.talk.append(talk)
        return k

    def around(self, a: int, b: int) -> int:
        """The innermost element that holds both."""
        while a != b:
            if self.depth[a] >= self.depth[b]:
                a = self.parent[a]
            else:
                b = self.parent[b]
        return a


class Line(NamedTuple):
    text: str
    element: int  # the block element around it
    linked: bool  # whether most of it is links


def lines(html: str, open_menus: frozenset[str] = frozenset()) -> tuple[list[Line], Tree, frozenset[str]]:
    """The text of each block that is not left out by its element, in page order; and which kinds of menu were never closed.

    open_menus: kinds that are not left out for what they are, but noise.
    """
    out: list[Line] = []
    tree = Tree()
    open_: list[tuple[str, int, bool]] = []  # name, number of the block (its own or the one around it), left out
    names: Counter[str] = Counter()
    parts: list[str] = []
    dropped, n, pos, none = 0, len(html), 0, {}
    holds = linked = 0
    unclosed: set[str] = set()

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            out.append(Line(text, open_[-1][1] if open_ else 0, 10 * linked >= 8 * len(text)))
        parts.clear()
        linked = 0

    def pop() -> str:
        nonlocal dropped, holds
        name, k, bad = open_.pop()
        names[name] -= 1
        dropped -= bad
        holds -= name in _HOLD
        if name in _BLOCK or "-" in name:
            tree.last[k] = len(tree.parent) - 1
        return name

    while pos < n:
        lt = html.find("<", pos)
        if lt < 0:
            lt = n
        if lt > pos and not dropped:
            parts.append(unescape(html[pos:lt]))
            if names["a"]:
                linked += len(parts[-1].strip())
        if lt >= n:
            break
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            pos = n if end < 0 else end + 3
            continue
        if html.startswith(("<!", "<?"), lt):
            end = html.find(">", lt)
            pos = n if end < 0 else end + 1
            continue
        closing = html.startswith("/", lt + 1)
        m = _NAME.match(html, lt + 1 + closing)
        if not m:
            if not dropped:
                parts.append("<")
            pos = lt + 1
            continue
        name, pos = m[0].lower(), _tag_end(html, m.end(), none)
        if (name in _BLOCK or "-" in name) and not dropped:
            flush()
        if closing:
            while names[name]:
                bad = open_[-1][2]
                if (last := pop()) == name:
                    break
                if bad and last in _MENUS:
                    unclosed.add(last)
            continue
        attributes = html[m.end() : pos - 1]
        if name in _VOID or attributes.endswith("/") and name not in _BLOCK | _RAW:
            if name in ("br", "img", "wbr") and not dropped:
                parts.append(" " if name == "br" else "")
            continue
        if name in _RAW:
            end = re.compile(rf"</{name}[\s/>]", re.I).search(html, pos)
            if end is None:
                pos = n
            else:
                close = html.find(">", end.end() - 1)
                pos = n if close < 0 else close + 1
            if not dropped:
                parts.append(" ")
            continue
        if name in _HOLD and dropped and not holds:  # an unclosed menu or advert ends where the article begins
            while open_ and dropped:
                pop()
        if name == "p" or name == "li":  # a new paragraph or item ends one that is still open
            for k in range(len(open_) - 1, max(-1, len(open_) - 12), -1):
                if open_[k][0] == name:
                    while len(open_) > k:
                        pop()
                    break
                if open_[k][0] in _BLOCK and open_[k][0] != "p":
                    break
        hints = " ".join(h.strip("\"'") for h in _HINT.findall(attributes)) if "=" in attributes else ""
        named = name not in ("html", "body", "main") and hints
        talk = bool(named and _TALK.search(hints))
        noise = bool(named and _NOISE.search(hints)) or name == "form" or name in open_menus
        block = name in _BLOCK or "-" in name
        bad = (name in _DROP and name not in open_menus) or (name == "header" and not holds) or bool(attributes and _HIDDEN.search(attributes)) or (noise and not block)
        k = open_[-1][1] if open_ else 0
        open_.append((name, tree.add(name, k, noise, talk) if block else k, bad))
        names[name] += 1
        dropped += bad
        holds += name in _HOLD
    if not dropped:
        flush()
    while open_:
        unclosed |= {open_[-1][0]} & _MENUS if open_[-1][2] else set()
        pop()
    tree.last[0] = len(tree.parent) - 1
    return out, tree, frozenset(unclosed)


def cores(sizes: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """First and last line of each region between a surge and the next dive; of none, all lines are one."""
    n = len(sizes)
    block = [sum(sizes[i : i + window]) for i in range(n)]
    level = min(surge, max(block, default=0))
    out, i = [], 0
    while i < n:
        if block[i] < level:
            i += 1
            continue
        begin = i  # surge
        while i < n and block[i] > 0 and (block[i] >= level or (i + 1 < n and block[i + 1] >= level)):
            i += 1
        end = min(n - 1, i + window - 2)  # dive
        while end > begin and sizes[begin] * window < level:  # the window reaches over the edges; short lines there come back with their element
            begin += 1
        while end > begin and sizes[end] * window < level:
            end -= 1
        out.append((begin, end))
        i = max(i, end + 1)
    return out or [(0, n - 1)]


def denoised(got: list[Line], tree: Tree) -> list[Line]:
    """Without what stands in elements named as noise, unless such an element holds the article itself."""
    if not any(tree.noise):
        return got
    n = len(tree.parent)
    upto, heads, holds, dense = ([0] * (n + 1) for _ in range(4))  # by elements before: characters, headings and holders, holders, long lines
    for line in got:
        upto[line.element + 1] += len(line.text)
        dense[line.element + 1] += len(line.text) >= SURGE
    for k in range(1, n):
        heads[k + 1] = tree.name[k] in ("h1", *_HOLD) and not tree.noise[k]
        holds[k + 1] = tree.name[k] in _HOLD and not tree.noise[k]
    upto, heads, holds, dense = (list(accumulate(x)) for x in (upto, heads, holds, dense))
    gone = [False] * n
    for k in range(1, n):
        gone[k] = gone[tree.parent[k]]
        if tree.noise[k] and not gone[k]:
            a, z = k, tree.last[k] + 1
            of = lambda x: x[z] - x[a]  # noqa: B023, E731
            whole = 2 * of(upto) >= upto[n] and of(heads) == heads[n] and (heads[n] or of(dense) == dense[n])
            lies = not tree.talk[k] and dense[n] and 10 * of(dense) >= 9 * dense[n] and of(holds) == holds[n]
            gone[k] = not (whole or lies)
    return [line for line in got if not gone[line.element]]


def without_notices(got: list[Line], tree: Tree) -> list[Line]:
    """Without what the first and last lines outside of articles say about cookies."""
    edge = {*range(min(3, len(got))), *range(max(0, len(got) - 3), len(got))}
    notice = lambda i, line: i in edge and len(line.text) < 400 and not tree.held[line.element] and tree.name[line.element] not in ("h1", "h2", "h3") and _NOTICE.search(line.text)
    return [line for i, line in enumerate(got) if len(got) == 1 or not notice(i, line)]


_RIGHTS = re.compile(r"(?:copyright\b|©|\(c\) ?[0-9]{4}|all rights reserved)", re.I)


def grown(got: list[Line], begin: int, end: int, first: int, last: int) -> tuple[int, int]:
    """Lines first..last without links and copyright lines at the edges, but with all of begin..end."""
    extra = lambda line: line.linked or len(line.text) < 2 * SURGE and _RIGHTS.match(line.text)
    while first < begin and any(map(extra, got[first:begin])):
        first += 1
    while last > end and any(map(extra, got[end + 1 : last + 1])):
        last -= 1
    return first, last


def articles(got: list[Line], tree: Tree) -> list[int]:
    """The innermost article or main with at least half of the text, and those beside it that are at least a quarter as long; none where no such one is there."""
    held: Counter[int] = Counter()
    for line in got:
        held[tree.held[line.element]] += len(line.text)
    for k in range(len(tree.parent) - 1, 0, -1):  # an inner article or main counts for those around it
        if tree.held[k] == k:
            held[tree.held[tree.parent[k]]] += held[k]
    total = sum(len(line.text) for line in got)
    most = [(n, -k) for k, n in held.items() if k and 2 * n >= total]
    if not most:
        return []
    size, top = min(most)[0], -min(most)[1]
    apart = lambda k: not (top <= k <= tree.last[top] or k <= top <= tree.last[k])
    beside = [k for k, n in held.items() if k and tree.name[k] == "article" and apart(k) and 4 * n >= size]
    return [top, *(k for k in beside if not any(b != k and b <= k <= tree.last[b] for b in beside))]


def main_text(html: str | None) -> str:
    if not html:
        return ""
    got, tree, unclosed = lines(html)
    if unclosed:  # what a menu without an end holds may be the article
        got, tree, _ = lines(html, unclosed)
    got = without_notices(denoised(got, tree), tree)
    if not got:
        return ""
    sizes = [len(line.text) for line in got]
    regions = cores(sizes)
    largest = max(regions, key=lambda r: sum(sizes[r[0] : r[1] + 1]))
    elements = [line.element for line in got]
    holders = articles(got, tree)
    keep = [0] * (len(got) + 1)  # +1 where lines to be kept begin, -1 after their last
    for top in holders:  # a few; the lines of an element stand together
        inside = [i for i, e in enumerate(elements) if top <= e <= tree.last[top]]
        if any(begin <= inside[-1] and end >= inside[0] for begin, end in regions):
            keep[inside[0]] += 1
            keep[inside[-1] + 1] -= 1
    for begin, end in () if holders else regions:
        inside = elements[begin : end + 1]
        top = tree.around(min(inside), max(inside))
        if begin == end and tree.parent[top] and (begin, end) == largest:
            top = tree.parent[top]  # one block alone: what is around it
        first = last = begin
        while first and top <= elements[first - 1] <= tree.last[top]:
            first -= 1
        while last + 1 < len(got) and top <= elements[last + 1] <= tree.last[top]:
            last += 1
        first, last = grown(got, begin, end, first, last)
        keep[first] += 1
        keep[last + 1] -= 1
    return "\n".join(line.text for line, k in zip(got, accumulate(keep), strict=False) if k)


_SCHEMA = "page_id long, url string, text string, n_chars long"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(h) for h in b.column(2).to_pylist()]
        yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars; one row per page."""
    small_batches(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(kernel.tidy(_extract), _SCHEMA)
