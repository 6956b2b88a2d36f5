"""Main text of web pages by tag-path ratios.

Every text node belongs to the path of open tags from the root. Per path the lengths of its texts,
their punctuation and their length in links are summed over the page; the sums over the number of
its nodes are the path's ratios. They are fused by their geometric mean and smoothed with the best
path below the same parent, so that a short heading counts as part of its article. Blocks whose
ratio reaches a share of the page's own mean are content. What a page says of its elements (menus,
notices, adverts, comments, its article) is a factor of the ratio and no more; an element that holds
most of the text is never counted as furniture.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame

from tidewarden.llm.common import ship

ship(__name__)

SCHEMA = "page_id bigint, url string, text string, n_chars bigint"
# Names of the HTML standard, and words that name page furniture.
OPEN = re.compile(r"<(?:(/?)([A-Za-z][^\s/><]*)|(!--)|[!?])")
STOP = re.compile("[\"'>]")
RAW = {"script", "style", "textarea", "title", "noscript", "iframe"}  # up to their end tag, whatever is in them
CUT = {"script", "style"}  # without one they take the rest of the page
HIDDEN = {"template", "svg", "select", "button", "datalist", "object", "canvas", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins",
    "kbd", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "br",
}
FURNITURE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "head"}
ROLES = {
    "navigation", "banner", "contentinfo", "complementary", "search", "searchbox", "alert", "alertdialog", "dialog", "menu", "menubar",
}
# A class or id names furniture if each of its parts does, or only says of what or where it is.
NAMES = re.compile(
    r"ads?|advert\w*|sponsor\w*|promo\w*|banner|cookie\w*|consent|notice|menu|nav\w*|breadcrumb\w*|"
    r"sidebar|side|widgets?|footer|foot|comment\w*|repl(?:y|ies)|disqus|related|share|sharing|social|newsletter|"
    r"subscribe|signup|popup|modal|gdpr|toolbar|pagination|pager|skip"
)
HEADS = re.compile(r"header")  # furniture of the page, but not in an article
OF = {
    "site", "page", "main", "global", "top", "bottom", "left", "right", "primary", "secondary", "wrap", "wrapper", "container",
    "inner", "outer", "area", "box", "bar", "block", "section", "list", "links", "link", "item", "items", "buttons", "form",
    "thread", "overlay", "text", "message", "policy", "js", "id", "the",
}
POST = {"post", "posts", "entry", "article", "story", "blog"}  # not before a header
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
UNSEEN = re.compile(r"(?i)(?:^|[;\s])(?:display\s*:\s*none|visibility\s*:\s*hidden)\b")
STATED = {"article", "main"}
BOXES = {"", "html", "body", "div", "section", "article", "main", "center", "nav", "header", "footer", "aside", "form"}
LISTS = {"ul", "ol", "dl", "table", "thead", "tbody", "tr", "blockquote", "figure"}
MARKS = re.compile(r"[.,;:!?…。、，！？]")
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
DEEP = 200  # open tags that are kept apart
SHARE = 0.4  # of the mean ratio
BOXED, MARKED, INSIDE = 0.3, 0.05, 3.0  # factors of a ratio: directly on a box, in furniture, in an article


def furniture(tag: str, attributes: str, inner: bool) -> bool:
    """Whether an element is marked as furniture or hidden; `inner`: it lies in an article."""
    if tag in ("html", "body"):
        return False
    if tag in FURNITURE and not (tag == "header" and inner):
        return True
    if not attributes.strip(" /"):
        return False
    values = {}
    for m in ATTRIBUTE.finditer(attributes):
        values.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    if "hidden" in values or values.get("aria-hidden", "").strip().lower() == "true" or UNSEEN.search(values.get("style", "")):
        return True
    if not ROLES.isdisjoint(values.get("role", "").lower().split()):
        return True
    if tag in STATED:
        return False
    return any(names_furniture(x, inner) for x in f"{values.get('class', '')} {values.get('id', '')}".lower().split())


def names_furniture(token: str, inner: bool) -> bool:
    parts = [x for x in re.split(r"[_-]+", token) if x]
    heads = any(HEADS.fullmatch(x) for x in parts)
    if heads and inner or not (heads or any(NAMES.fullmatch(x) for x in parts)):
        return False
    return all(x in OF or x.isdigit() or x in POST and not heads or NAMES.fullmatch(x) or HEADS.fullmatch(x) for x in parts)


class Tags:
    """The markup of a page from left to right, each character looked at a fixed number of times."""

    def __init__(self, page: str) -> None:
        self.page, self.low, self.last, self.loose = page, page.lower(), {c: page.rfind(c) for c in "\"'>"}, False
        if len(self.low) != len(page):  # letters that grow: ASCII alone is lowered
            self.low = "".join(c.lower() if c.isascii() else c for c in page)
        self.ends: dict[str, int] = {}

    def end_of(self, at: int) -> int:
        """The place of the `>` that ends the tag at `at`: the first outside quotes, or, where there is
        none up to the end of the page, the first of all; -1 without one."""
        if at > self.last[">"]:
            return -1
        here = at
        while not self.loose:
            m = STOP.search(self.page, here)
            if m is None:
                self.loose = True
            elif m[0] == ">":
                return m.start()
            elif m.start() >= self.last[m[0]]:
                self.loose = True
            else:
                here = self.page.index(m[0], m.end()) + 1
        return self.page.index(">", at)

    def raw_end(self, tag: str, at: int) -> int | None:
        """Where the content of a raw element and its end tag are over; None without an end tag."""
        if tag not in self.ends:
            self.ends[tag] = self.low.rfind(f"</{tag}")
        if self.ends[tag] < at:
            return None
        end = self.page.find(">", self.low.index(f"</{tag}", at))
        return end + 1 if end >= 0 else len(self.page)

    def __iter__(self) -> Iterator[tuple[str, str, str, str]]:
        """(text before, slash, tag, attributes); tag is empty for comments and declarations."""
        page, at = self.page, 0
        while m := OPEN.search(page, at):
            before = page[at : m.start()]
            if m[3]:
                end = page.find("-->", m.end())
                at = end + 3 if end >= 0 else len(page)
                yield before, "", "", ""
                continue
            end = self.end_of(m.end())
            if end < 0:
                yield page[at:], "", "", ""
                return
            at = end + 1
            tag = (m[2] or "").lower()
            if tag in RAW and not m[1]:
                over = self.raw_end(tag, at)
                at = over if over is not None else len(page) if tag in CUT else at
                yield before, "", "" if tag in INLINE else tag, "/"
                continue
            yield before, m[1] or "", tag, page[m.end() : end]
        yield page[at:], "", "", ""


class Block(NamedTuple):
    path: str
    text: str
    links: int  # characters of it in links
    marked: tuple[int, ...]  # elements around it that the page marks as furniture, outermost first


def blocks(page: str) -> list[Block]:
    """The text nodes between block tags, in page order."""
    out, parts, path = [], [], []  # path: (tag, marked elements)
    where, count, links, open_links = None, 0, 0, 0

    def flush() -> None:
        nonlocal where, links
        text = " ".join(unescape("".join(parts)).split())
        if text:
            out.append(Block(*(where or ("", ()))[:1], text, min(links, len(text)), (where or ("", ()))[1]))
        parts.clear()
        where, links = None, 0

    for before, slash, tag, attributes in Tags(page):
        if before:
            if where is None and not before.isspace():
                where = "/".join(t for t, _ in path if t not in INLINE), path[-1][1] if path else ()
            parts.append(before)
            links += len(before) if open_links else 0
        if not tag:
            continue
        if tag in RAW:
            flush()
            continue
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
                continue
        else:
            flush()
        if slash:
            for i in range(len(path) - 1, max(-1, len(path) - 1 - DEEP), -1):
                if path[i][0] == tag:
                    if tag in INLINE and any(t not in INLINE for t, _ in path[i:]):
                        break
                    open_links -= sum(t == "a" for t, _ in path[i:])
                    del path[i:]
                    break
            continue
        if tag in VOID or attributes.endswith("/") and tag not in INLINE and tag not in ("p", "div"):
            continue
        if tag not in INLINE:
            while path and path[-1][0] in INLINE:  # an inline tag left open ends with its block
                open_links -= path.pop()[0] == "a"
            if path and (path[-1][0] in CLOSES.get(tag, ()) or path[-1][0] == "p"):
                path.pop()
        if len(path) >= DEEP:  # no page nests so deep: tags that are never closed
            continue
        marked = path[-1][1] if path else ()
        if tag in HIDDEN or furniture(tag, attributes, any(t in STATED for t, _ in path)):
            count += 1
            marked += (count,)
        path.append((tag, marked))
        open_links += tag == "a"
    flush()
    return out


def ratios(found: list[Block]) -> list[float]:
    """The fused and smoothed ratio of each block's path.

    Per path the length of its texts, their punctuation and their length in links are summed over
    the page. Length and punctuation outside links over the number of nodes are fused by their
    geometric mean; text that hangs directly on a box, as no paragraph or heading does, counts less.
    A path takes half of the best ratio among the paths in its container, so that a short heading
    counts with the article it stands in.
    """
    length, marks, nodes = defaultdict(float), defaultdict(float), defaultdict(int)
    for b in found:
        free = 1 - b.links / len(b.text)
        length[b.path] += len(b.text) * free
        marks[b.path] += len(MARKS.findall(b.text)) * free
        nodes[b.path] += 1
    fused = {p: (length[p] / nodes[p] * (1 + marks[p] / nodes[p])) ** 0.5 for p in nodes}
    best: dict[str, float] = {}
    for p, value in fused.items():
        best[container(p)] = max(best.get(container(p), 0.0), value)
    smooth = {p: (value + best[container(p)]) / 2 if value else 0.0 for p, value in fused.items()}  # all links: a menu
    return [smooth[b.path] * (BOXED if b.path.rpartition("/")[2] in BOXES else 1) for b in found]


def container(path: str) -> str:
    """The article or main element that the path lies in, or else its parent; a list or a table has
    the container that it stands in itself."""
    tags = path.split("/")[:-1]
    stated = [i for i, t in enumerate(tags) if t in STATED]
    while tags and tags[-1] in LISTS:
        tags.pop()
    return "/".join(tags[: stated[-1] + 1] if stated else tags)


def content(found: list[Block]) -> list[bool]:
    """Which blocks are content: those whose ratio reaches a share of the page's mean, each block
    weighed by its text outside links. What the page says of an element, as furniture or as its
    article, is a factor of the ratio."""
    void, values = mistaken(found), ratios(found)
    for i, b in enumerate(found):
        values[i] *= 1 if void.issuperset(b.marked) else MARKED
        values[i] *= 1 if STATED.isdisjoint(b.path.split("/")) else INSIDE
    weights = [len(b.text) - b.links for b in found]
    mean = sum(v * w for v, w in zip(values, weights, strict=True)) / max(1, sum(weights))
    return [v > 0 and v >= SHARE * mean for v in values]


def main_text(page: str) -> str:
    """The content blocks, joined by empty lines."""
    found = blocks(page)
    return "\n\n".join(b.text for b, k in zip(found, content(found), strict=True) if k)


def mistaken(found: list[Block]) -> set[int]:
    """Marked elements that count as content: they hold most of the text, in nodes at least as long
    as those of the unmarked rest, and the rest has no article or main element."""
    held, void = defaultdict(int), set()
    for b in found:
        for e in b.marked:
            held[e] += len(b.text)
    total = sum(len(b.text) for b in found)
    for e in sorted(e for e in held if 2 * held[e] > total):
        nodes = sum(e in b.marked for b in found)
        rest = [(b.path, len(b.text)) for b in found if e not in b.marked and void.issuperset(b.marked)]
        stated = any(not STATED.isdisjoint(p.split("/")) for p, _ in rest)
        if not stated and held[e] * len(rest) >= sum(n for _, n in rest) * nodes:
            void.add(e)
    return void


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, the main text and its number of code points.

    A null page counts as empty and has an empty text. Repeated rows give repeated rows, an empty
    table none, null ids and urls stay null; other columns are not read.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(h or "") for h in batch["html"]]
            yield pd.DataFrame(
                {"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]}
            )

    return pages.select("page_id", "url", "html").mapInPandas(work, SCHEMA)
