"""HTML extraction by wrapper induction.

Pages of a host with the same outline form a layout. All pages tell for each slot (a path of labels) which
texts stand there: a text that nearly all pages with the slot have is template. Some pages of a layout are
parsed to trees and aligned one after another by simple tree matching (Yang 1991): nodes of equal label
match, and the best matching of their children follows order. Aligned nodes collect how much text varies,
links apart, and the path down to the node that has most of it is the content. A page's main text is what
stands below that path, without template texts and without elements that are by tag or name menus,
notices, adverts and the like. Below the content a name counts only if all its parts are such words, one of them a plain one:
a header, a menu or a notice in an article may be its own.

Trees may be of any depth: all walks keep stacks of their own, and a path of labels is known by a running hash. Equal
subtrees are matched by their hashes, each two different ones once, and forests by whole rows, so a page of n
nodes against one of m takes n * m steps of vectors at most.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from hashlib import blake2b
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.scratch import Scratch

#: Pages of a layout that are aligned, one from each of so many hash classes: they fix the path alone.
SAMPLE = 6
#: A text is template if so many distinct pages have its slot and this share of them has it there.
LEAST, SHARE = 3, 0.8
#: The share of varying text that a node must have to be looked into.
MOST = 0.6
#: Wrappers of so many characters in all are broadcast; more are joined by a shuffle.
BROADCAST_CHARS = 20_000_000

#: HTML elements by role.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "head", "header", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
}
OUTSIDE = {"aside", "button", "datalist", "dialog", "footer", "form", "head", "header", "iframe", "input", "menu", "nav", "noscript", "object", "option", "script", "select", "style", "svg", "template", "textarea", "title"}
#: Words in a class, id or role that mark an element as no part of the article.
MARKS = {
    "ad", "ads", "advert", "advertisement", "adverts", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "contentinfo", "cookie", "cookies", "disqus", "footer", "gdpr", "header",
    "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pagination", "popup", "promo", "promoted", "related", "respond", "search", "share", "sharing", "sidebar", "social", "sponsor",
    "sponsored", "subscribe", "toolbar", "widget", "replies", "reply",
}

#: Of these, words that may name a part of the article itself.
OWN_MARKS = {"banner", "contentinfo", "footer", "header", "masthead", "menu", "notice", "search", "social"}

#: Parts of names that say nothing about a role.
NEUTRAL = {"area", "bar", "block", "body", "bottom", "box", "button", "buttons", "container", "content", "form", "inner", "item", "items", "left", "links", "list", "main", "outer", "page", "panel", "posts", "right", "section", "signup", "site", "top", "wrap", "wrapper"}

#: Elements that a next one of their kind ends.
_SELF_ENDING = {"li", "dt", "dd", "tr", "td", "th", "option"}

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(script|style|textarea|title|noscript|template)\b[^>]*>.*?(?:</\1\s*>|$)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S | re.I)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART, _DIGITS = re.compile(r"[a-z]+"), re.compile(r"[0-9]+")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("label", "tag", "out", "named", "parts")

    def __init__(self, tag: str, attributes: str):
        self.tag, self.parts = tag, []
        named = " ".join(" ".join(m[1:]) for m in _NAMED.findall(attributes)).lower() if attributes else ""
        self.label = f"{tag}.{_DIGITS.sub('', named.split()[0])}" if named.strip() else tag
        parts = set(_PART.findall(named)) if named else set()
        # by a name of marks alone an element is out anywhere, by one that has a mark only outside the content
        self.named = bool(parts & MARKS)
        self.out = tag in OUTSIDE or any(own & (MARKS - OWN_MARKS) and own <= MARKS | NEUTRAL for own in (set(_PART.findall(n)) for n in named.split()))

    @property
    def nodes(self) -> list[Node]:
        return [p for p in self.parts if isinstance(p, Node)]


def parse(page: str) -> Node:
    """The tree of a page. Open paragraphs and list items end where blocks begin; stray end tags are ignored."""
    root = Node("#", "")
    stack, open_ = [root], Counter()

    def close(i: int) -> None:
        open_.subtract(n.tag for n in stack[i:])
        del stack[i:]

    for m in _TOKEN.finditer(page):
        tag = m[3]
        if not tag:
            text = m[0]
            if text[0] != "<" or text == "<":
                stack[-1].parts.append(text)
            continue
        tag = tag.lower()
        if m[2]:
            for i in range(len(stack) - 1, 0, -1) if open_[tag] > 0 else ():
                if stack[i].tag == tag:
                    close(i)
                    break
                if stack[i].tag in ("article", "main", "body") and tag not in ("body", "html"):
                    break
            continue
        if tag in BLOCK and (open_["p"] > 0 or (tag in _SELF_ENDING and open_[tag] > 0)):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p" or (tag == stack[i].tag and tag in _SELF_ENDING):
                    close(i)
                    break
                if stack[i].tag in BLOCK:
                    break
        node = Node(tag, m[4])
        stack[-1].parts.append(node)
        if tag not in VOID and not m[4].endswith("/"):
            stack.append(node)
            open_[tag] += 1
    return root


def _own(node: Node) -> tuple[str, int]:
    """The text of a node without its block children, as one line, and its characters that are not in links."""
    out, linked, todo = [], 0, [(p, False) for p in reversed(node.parts)]
    while todo:
        p, link = todo.pop()
        if isinstance(p, str):
            out.append(entities.unescape(p))
            linked += len(p) * link
        elif p.tag == "br":
            out.append(" ")
        elif p.tag not in BLOCK and not p.out:
            todo += [(q, link or p.tag == "a") for q in reversed(p.parts)]
    text = _SPACE.sub(" ", "".join(out)).strip()
    return text, max(0, len(text) - linked)


def _blocks(node: Node) -> list[Node]:
    """The nearest block descendants, in order."""
    out, todo = [], node.nodes[::-1]
    while todo:
        n = todo.pop()
        if n.tag in BLOCK:
            out.append(n)
        else:
            todo += reversed(n.nodes)
    return out


def _below(path: int, label: str) -> int:
    """The path of a label below a path."""
    return _code(path, f"/{label}")


def _code(path: int, text: str) -> int:
    """A hash of a slot and a text in it, as a signed 64-bit number."""
    return int.from_bytes(blake2b(f"{path}\n{text}".encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


class Slot:
    """A node of the wrapper: its label, the characters of varying text, and its children, of which those of one
    label in a row are one slot. code stands for the labels of its whole subtree, of size nodes."""

    __slots__ = ("label", "varying", "children", "out", "code", "size")

    def __init__(self, label: str, varying: int = 0, children: list[Slot] | None = None, out: bool = False):
        self.label, self.varying, self.children, self.out, self.code, self.size = label, varying, children if children is not None else [], out, 0, 1


def _slots(blocks: list[Node], fixed: set[int]) -> list[Slot]:
    """The slots of a page, of whose texts those that are fixed do not vary."""
    forest: list[Slot] = []
    todo = [(forest, blocks, 0)]
    while todo:
        into, found, at = todo.pop()
        for label, run in groupby(found, key=lambda n: n.label):
            nodes, path = list(run), _below(at, label)
            slot = Slot(label, out=nodes[0].out or nodes[0].named)
            slot.varying = sum(plain for text, plain in map(_own, nodes) if text and _code(path, text) not in fixed)
            into.append(slot)
            if not slot.out:
                todo.append((slot.children, [b for n in nodes for b in _blocks(n)], path))
    return forest


def _inner_first(forest: list[Slot]) -> list[Slot]:
    """All slots, children before their parents."""
    out, todo = [], list(forest)
    while todo:
        x = todo.pop()
        out.append(x)
        todo += x.children
    return out[::-1]


def _number(known: dict, *forests: list[Slot]) -> None:
    """Codes of all subtrees: equal for equal ones."""
    for forest in forests:
        for x in _inner_first(forest):
            x.code = known.setdefault((x.label, *[c.code for c in x.children]), len(known))
            x.size = 1 + sum(c.size for c in x.children)


def _best(a: list[Slot], b: list[Slot], known: dict[tuple[int, int], int], wanted: bool) -> tuple[int, list[tuple[int, int]]] | set:
    """The best matching of two forests whose roots' matches are known; else the pairs of roots that are to be matched before. wanted: are the
    pairs asked for, or the number of matched nodes alone?"""
    head = 0
    while head < min(len(a), len(b)) and a[head].code == b[head].code:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail].code == b[-1 - tail].code:
        tail += 1
    # Equal subtrees at either end are matched whole: nothing else can give more.
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    pairs = [(i, i) for i in range(head)] + [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]
    total = sum(a[i].size for i, _ in pairs)
    if not x or not y:
        return total, pairs
    of = {}
    for q in y:
        of.setdefault(q.label, {})[q.code] = q
    missing = {(p, q) for p in {p.code: p for p in x}.values() for q in of.get(p.label, {}).values() if p.code != q.code and (p.code, q.code) not in known}
    if missing:
        return missing
    if len(x) * len(y) <= 64 and not wanted:
        line = [0] * (len(y) + 1)
        for p in x:
            left, before = 0, 0
            for j, q in enumerate(y, 1):
                above = line[j]
                here = above if above > left else left
                if p.label == q.label and (told := before + (p.size if p.code == q.code else 1 + known[p.code, q.code])) > here:
                    here = told
                line[j], left, before = here, here, above
        return total + line[-1], []
    codes, rows = np.array([q.code for q in y]), {}
    ways, old = np.zeros((len(x), len(y)), np.uint8), np.zeros(len(y) + 1, np.int64)
    for i, p in enumerate(x):
        if p.code not in rows:
            worth = {c: 1 + (p.size - 1 if c == p.code else known[p.code, c]) for c in of.get(p.label, {})}
            rows[p.code] = np.array([worth.get(c, 0) for c in codes.tolist()])
        worth = rows[p.code]
        new = np.maximum.accumulate(np.maximum(old[1:], np.where(worth > 0, old[:-1] + worth, 0)))
        ways[i] = np.where(new == old[1:], 0, np.where(new == np.append(0, new[:-1]), 1, 2))
        old = np.append(0, new)
    i, j, found = len(x), len(y), []
    while i and j:
        way = ways[i - 1, j - 1]
        if way == 2:
            found.append((head + i - 1, head + j - 1))
        i, j = i - (way != 1), j - (way != 0)
    return total + int(old[-1]), pairs[:head] + found[::-1] + pairs[head:]


def match(a: list[Slot], b: list[Slot], known: dict[tuple[int, int], int] | None = None) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching of two ordered forests: the number of matched nodes, and the matched roots. known: matched nodes below two
    subtrees, by their codes; the slots are numbered unless it is given."""
    if known is None:
        _number({}, a, b)
        known = {}
    todo: list[tuple[Slot, Slot]] = []
    while True:
        p, q = todo[-1] if todo else (None, None)
        told = _best(p.children, q.children, known, False) if todo else _best(a, b, known, True)
        if isinstance(told, set):
            todo += told
        elif not todo:
            return told
        else:
            known[p.code, q.code] = told[0]
            todo.pop()


def merge(a: list[Slot], b: list[Slot]) -> None:
    """Aligns b's nodes with a's, which take up what varies; nodes of b alone are added."""
    known: dict[tuple[int, int], int] = {}
    _number({}, a, b)
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        pairs = match(x, y, known)[1]
        for i, j in pairs:
            x[i].varying += y[j].varying
            if x[i].children or y[j].children:
                todo.append((x[i].children, y[j].children))
        matched = {j for _, j in pairs}
        x += [q for j, q in enumerate(y) if j not in matched]


def induce(pages: list[str], fixed: set[int] = frozenset()) -> list[str]:
    """The path of labels down to the content of some pages of one layout, whose template texts are known."""
    forest = _slots(_blocks(parse(pages[0])), fixed)
    for page in pages[1:]:
        merge(forest, _slots(_blocks(parse(page)), fixed))
    volume: dict[int, int] = {}
    for x in _inner_first(forest):
        volume[id(x)] = 0 if x.out else x.varying + sum(volume[id(c)] for c in x.children)
    of = lambda slots: sum(volume[id(x)] for x in slots)
    path, slots = [], forest
    while slots:
        top = max(slots, key=lambda x: volume[id(x)])
        rest = of(slots)
        if not rest or volume[id(top)] < MOST * rest or not (top.children or top.label.split(".")[0] in ("article", "main")):
            break
        path.append(top.label)
        if top.varying > of(top.children) or top.label.split(".")[0] in ("article", "main"):
            break
        slots = top.children
    return path


def layout(root: Node) -> int:
    """A page's layout: a hash of the labels of its upper blocks."""
    found = {f"{x.label}/{y.label}/{z.label}" for x in _blocks(root) for y in _blocks(x) or [x] for z in _blocks(y) or [y]}
    return _code(-1, "\n".join(sorted(found)))


def stated(root: Node) -> dict[int, int]:
    """For each slot and text in it, once, a hash of both and one of the slot alone."""
    told, todo = {}, [(0, n) for n in _blocks(root)]
    while todo:
        at, node = todo.pop()
        path = _below(at, node.label)
        if text := _own(node)[0]:
            told[_code(path, text)] = _code(path, "")
        todo += [(path, n) for n in _blocks(node)]
    return told


def main_text(root: Node, wrapper: dict | None) -> str:
    """The text of a page's content under a wrapper; without one, or where the page has no node at its
    path, of the page's own article or main element, or else of the whole body."""
    fixed = set(wrapper["fixed"]) if wrapper else set()
    roots, inside = [(0, root)], False
    for label in wrapper["path"] if wrapper else ():
        below = [(_below(at, n.label), n) for at, r in roots for n in _blocks(r) if n.label == label]
        if not below:
            break
        roots, inside = below, True
    if not inside or any(n.tag in ("html", "body") for _, n in roots):
        named = [found for at, r in roots for found in _named(r, at)]
        roots, inside = named or roots, bool(named)
    blocks: list[tuple[str, bool]] = []
    line: list[str] = []

    def close(at: int) -> None:
        text = _SPACE.sub(" ", entities.unescape("".join(line))).strip()
        if text:
            blocks.append((text, bool(fixed) and _code(at, text) in fixed))
        line.clear()

    # What is to come: a part with the path of its block, or a path alone, where a block ends.
    todo: list[tuple[Node | str | None, int]] = []
    for at, node in reversed(roots):
        if not (node.out or (node.named and not inside)):
            todo.append((None, at))
            todo += [(p, at) for p in reversed(node.parts)]
    while todo:
        p, at = todo.pop()
        if p is None:
            close(at)
        elif isinstance(p, str):
            line.append(p)
        elif p.tag == "br":
            line.append(" ")
        elif p.tag in BLOCK:
            close(at)
            if not (p.out or (p.named and not inside)):
                own = _below(at, p.label) if fixed else 0
                todo.append((None, own))
                todo += [(q, own) for q in reversed(p.parts)]
        elif not p.out and (inside or not p.named):
            todo += [(q, at) for q in reversed(p.parts)]
    # a page of template texts alone is all content
    return " ".join([t for t, known in blocks if not known] or [t for t, _ in blocks])


def _named(node: Node, at: int) -> list[tuple[int, Node]]:
    """The outermost article or main elements below a node, in order."""
    out, todo = [], [(at, node, False)]
    while todo:
        at, node, found = todo.pop()
        if found:
            out.append((at, node))
            continue
        below = []
        for n in _blocks(node):
            if n.tag in ("article", "main") and not n.out:
                below.append((_below(at, n.label), n, True))
            elif not (n.out or n.named) or n.tag in ("html", "body"):
                below.append((_below(at, n.label), n, False))
        todo += reversed(below)
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text of every row of pages; the text is empty where there is none.

    A null or empty page has an empty text; a null or odd url counts to a host of its own, like any other.
    Repeated rows give a row each, and equal pages count once for the template; other columns are ignored,
    whatever their names. Of each layout at most SAMPLE pages are aligned, whatever share of the pages it has.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1)), F.lit(""))
    rows = rows.withColumn("host", host).withColumn("page", F.xxhash64("html"))

    def outlines(batches):
        for b in batches:
            roots = (parse(t.as_py()) for t in b.column(2))
            kept = [(layout(r), stated(r)) for r in roots]
            cuts = np.concatenate(([0], np.cumsum([len(told) for _, told in kept]))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array([c for _, told in kept for c in part(told)], pa.int64())) for part in (dict.keys, dict.values)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([k for k, _ in kept], pa.int64()), *lists], names=["host", "page", "layout", "codes", "slots"])

    told = scratch.save(rows.where("html <> ''").select("host", "page", "html").mapInArrow(outlines, "host string, page long, layout long, codes array<long>, slots array<long>"))
    key = ["host", "layout"]
    each = told.dropDuplicates(["host", "page"])
    said = each.select(*key, "page", F.explode(F.arrays_zip("codes", "slots")).alias("c")).select(*key, "page", "c.codes", "c.slots")
    having = said.select(*key, "page", "slots").distinct().groupBy(*key, "slots").agg(F.count("*").alias("pages")).where(F.col("pages") >= LEAST)
    often = said.groupBy(*key, "codes", "slots").agg(F.count("*").alias("have")).where(F.col("have") >= LEAST)
    fixed = often.join(having, [*key, "slots"]).where(F.col("have") >= SHARE * F.col("pages")).groupBy(*key).agg(F.array_sort(F.collect_set("codes")).alias("fixed"))
    salt = F.pmod(F.xxhash64("page", F.lit(2)), F.lit(SAMPLE))
    chosen = told.groupBy(*key, salt.alias("salt")).agg(F.min("page").alias("page")).select(*key, "page")
    chosen = scratch.save(chosen.join(fixed, key, "left"))
    shown = rows.where("html <> ''").join(chosen, ["host", "page"]).dropDuplicates(["host", "page"]).groupBy(*key).agg(F.array_sort(F.collect_list("html")).alias("pages"), F.first("fixed").alias("fixed"))

    def wrappers(frames):
        for f in frames:
            known = [set() if x is None else {int(c) for c in x} for x in f["fixed"]]
            yield pd.DataFrame({"host": f["host"], "layout": f["layout"], "wrapper": [json.dumps({"path": induce(list(p), k), "fixed": sorted(k)}) for p, k in zip(f["pages"], known)]})

    induced = scratch.save(shown.mapInPandas(wrappers, "host string, layout long, wrapper string"))
    kind = rows.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, url string, text string"
    if induced.agg(F.coalesce(F.sum(F.length("wrapper")), F.lit(0))).first()[0] <= BROADCAST_CHARS:
        given = spark.sparkContext.broadcast({(r.host, r.layout): json.loads(r.wrapper) for r in induced.toLocalIterator()})

        def texts(batches):
            for b in batches:
                out = []
                for page, host in zip(b.column(2), b.column(3)):
                    root = parse(page.as_py() or "")
                    out.append(main_text(root, given.value.get((host.as_py(), layout(root)))))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])

        return rows.select("page_id", "url", "html", "host").mapInArrow(texts, schema)

    def joined(batches):
        for b in batches:
            pairs = ((page.as_py() or "", wrapper.as_py()) for page, wrapper in zip(b.column(2), b.column(3)))
            out = [main_text(parse(page), json.loads(wrapper) if wrapper else None) for page, wrapper in pairs]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    layouts = each.select("host", "page", "layout")
    wrapped = rows.join(layouts, ["host", "page"], "left").join(induced, key, "left")
    return wrapped.select("page_id", "url", "html", "wrapper").mapInArrow(joined, schema)
