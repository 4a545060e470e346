"""Main text of web pages by wrapper induction.

Pages of one host share a template. Each page becomes a tree of its block elements,
in which siblings of one label are one node (the paragraphs of an article are one repeated
slot). The most frequent tree of a host is its reference; every other tree is aligned
to it by simple tree matching, the largest order-preserving mapping of nodes with equal
labels, so that each text block of each page has a slot of the host's wrapper. Spark
then counts what a slot holds over all different pages of the host: a text that stays the
same on nearly all of them is template, the rest of the slot is content. Copies of a page
count once, so an article is not template because it was copied. Navigation, forms,
footers and the like vary as well (their links and adverts change from page to
page); those slots are known by the role their element or class names. A block that is
a link and nothing else is navigation where it stands beside the page's article or
main element; inside of it, it is text. On a page without either it is navigation where
its slot holds links on nearly all pages of the host, unless it is a heading.

Counts, references and wrappers are made by aggregations per host and tree, never by
gathering the pages of a host, and alignment works on the distinct trees only.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgewise.plans.scratch import Scratch
from edgewise.plans.skew import join_counted

#: A text is template if it fills a slot on this share of at least so many pages of a host.
CONSTANT_SHARE = 0.8
CONSTANT_PAGES = 5

BLOCKS = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption"
    " blockquote pre figure figcaption address details summary hr header footer nav aside form fieldset dialog menu".split()
)
#: Elements whose class names tell of the page and not of a part of it.
PAGE = frozenset(("html", "body", "main", "article"))
CONTENT = frozenset(("main", "article"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements that hold no main text.
SILENT = frozenset(
    "nav header footer aside form fieldset dialog menu button select textarea noscript iframe template svg canvas object audio video".split()
)
#: Elements whose content is not text of the page at all.
RAW = ("script", "style", "title", "textarea", "noscript", "template", "svg", "iframe", "select")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Names in class, id or role that mark boilerplate.
ROLE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|commentlist|cookies?|consent|copyright|footer|header|masthead|"
    r"menu|nav|navbar|navigation|newsletter|notice|pager|pagination|popup|promo\w*|related|share|sharing|sidebar|social|"
    r"sponsor\w*|subscribe|toolbar|widget|search|login|disclaimer)(?:$|[\s_-]|\d)",
    re.IGNORECASE,
)
#: Start tags that close an open paragraph.
CLOSES_P = BLOCKS - {"html", "body", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "li", "dt", "dd"}
#: Siblings that end each other.
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "p": ("p",)}

#: Where markup begins: a comment, a declaration, or the name of a tag.
MARKUP = re.compile(r"<(?:(!--)|([!?])|(/?)([A-Za-z][^\s/>]*))")
#: One attribute of a tag up to its value, and a value without quotes.
ATTRIBUTE = re.compile(r"[\s/]*(?:(>)|([^\s/>][^\s/>=]*)(?:\s*(=)\s*)?)")
BARE = re.compile(r"[^\s>]*")
MARKING = frozenset(("class", "id", "role"))
RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE) for tag in RAW}


class Node:
    """A block element: label (tag and class), role flag, whether in the article, children by label."""

    __slots__ = ("tag", "label", "silent", "content", "children", "parent", "at")

    def __init__(self, tag: str, label: str, silent: bool, parent: "Node | None"):
        self.tag, self.label, self.silent, self.parent = tag, label, silent, parent
        self.content = not silent and (tag in CONTENT or parent is not None and parent.content)
        self.children: dict[str, Node] = {}
        self.at = -1


class Reader:
    """Tags and texts of a page, in one pass over it."""

    def __init__(self, page: str):
        self.page = page
        #: From here on the page has no such quote.
        self.without = {'"': len(page) + 1, "'": len(page) + 1}

    def attributes(self, at: int) -> tuple[int, list[str], bool]:
        """Where the tag ends, the values of class, id and role, whether it closes itself.

        A tag that never ends takes the rest of the page, as in a browser. A quote without a
        second one in the page does not count.
        """
        page, marks = self.page, []
        while True:
            m = ATTRIBUTE.match(page, at)
            if m is None:
                return len(page), marks, False
            at = m.end()
            if m[1]:
                return at, marks, page[at - 2] == "/"
            if not m[3]:
                continue
            quote = page[at : at + 1]
            end = -1
            if quote in self.without and quote and at + 1 < self.without[quote]:
                end = page.find(quote, at + 1)
                if end < 0:
                    self.without[quote] = at + 1
            if end >= 0:
                value, at = page[at + 1 : end], end + 1
            else:
                bare = BARE.match(page, at)
                value, at = bare[0], bare.end()
            if value and m[2].lower() in MARKING:
                marks.append(value)

    def __iter__(self) -> Iterator[tuple[str, str, bool, list[str], bool]]:
        """(text before, tag, closing, marks, closed at once); the last has no tag."""
        page, at, begun = self.page, 0, 0
        while True:
            m = MARKUP.search(page, at)
            if m is None:
                yield page[begun:], "", False, [], False
                return
            before = page[begun : m.start()]
            if m[1]:
                end = page.find("-->", m.end())
                at = len(page) if end < 0 else end + 3
                tag, closing, marks, alone = "!", False, [], False
            elif m[2]:
                end = page.find(">", m.end())
                at = len(page) if end < 0 else end + 1
                tag, closing, marks, alone = "!", False, [], False
            else:
                tag, closing = m[4].lower(), bool(m[3])
                at, marks, alone = self.attributes(m.end())
                if tag in RAW and not closing:
                    found = RAW_END[tag].search(page, at)
                    at = found.end() if found else len(page)
            begun = at
            yield before, tag, closing, marks, alone


def parse(page: str) -> tuple[Node, list[tuple[Node, str, bool]]]:
    """Tree of block elements and the text blocks in page order: node, text, in a link only.

    Siblings of one label are folded into one node as they are met, so the tree is small.
    """
    root = Node("", "", False, None)
    current, blocks, text, plain = root, [], [], False
    depth_a = 0
    opened: dict[str, int] = {}

    def flush() -> None:
        nonlocal text, plain
        joined = " ".join("".join(text).split())
        if joined:
            blocks.append((current, joined, not plain))
        text, plain = [], False

    def leave() -> None:
        nonlocal current
        opened[current.tag] -= 1
        current = current.parent

    for before, tag, closing, marks, alone in Reader(page):
        if before:
            text.append(html.unescape(before))
            plain = plain or (not depth_a and not before.isspace())
        if closing:
            if tag in BLOCKS:
                if opened.get(tag):
                    flush()
                    while current.tag != tag:
                        leave()
                    leave()
                elif tag == "p":
                    flush()
            elif tag == "a":
                depth_a = max(0, depth_a - 1)
        elif tag == "br":
            text.append(" ")
        elif tag in BLOCKS:
            flush()
            ends = SAME.get(tag, ())
            if current.tag in ends:
                leave()
                if tag == "tr" and current.tag == "tr":
                    leave()
            elif current.tag == "p" and tag in CLOSES_P:
                leave()
            if tag == "hr":
                continue
            depth_a = 0
            named = " ".join(marks)
            label = f"{tag}.{named}" if named else tag
            if label not in current.children:
                silent = current.silent or tag in SILENT or bool(named and tag not in PAGE and ROLE.search(named))
                current.children[label] = Node(tag, label, silent, current)
            current = current.children[label]
            opened[tag] = opened.get(tag, 0) + 1
        elif tag == "a" and not alone:
            depth_a += 1
    flush()
    return root, blocks


ESCAPE = {ord("("): " ", ord(")"): " ", ord("!"): " "}


def number(root: Node) -> str:
    """The tree as text, `label(children)`; sets `at`, the place of each node in it."""
    out, stack, n = [], [root], 0
    while stack:
        node = stack.pop()
        if node is None:
            out.append(")")
            continue
        node.at, n = n, n + 1
        out.append(f"{node.label.translate(ESCAPE)}{'!' if node.silent else ''}(")
        stack.append(None)
        stack.extend(reversed(node.children.values()))
    return "".join(out)


def tree(text: str) -> list[tuple[str, list[int]]]:
    """Label and children (places) of each node of a tree that `number` has written."""
    nodes: list[tuple[str, list[int]]] = []
    stack: list[int] = []
    for m in re.finditer(r"([^()]*)\(|\)", text):
        if m[0] == ")":
            stack.pop()
            continue
        if stack:
            nodes[stack[-1]][1].append(len(nodes))
        stack.append(len(nodes))
        nodes.append((m[1].removesuffix("!"), []))
    return nodes


def heaviest(pairs: list[tuple[int, int, int]], n: int) -> tuple[int, list[int]]:
    """Largest total weight of (i, j, weight) with rising i and j, and which pairs give it.

    `pairs` come by rising i, j is below n: the best total up to each j is kept in a tree of
    partial maxima, so a pair costs log(n).
    """
    best: list[tuple[int, int]] = [(0, -1)] * (n + 1)
    before = []
    for k, (_, j, weight) in enumerate(pairs):
        top, at = (0, -1), j
        while at:
            top = max(top, best[at])
            at -= at & -at
        before.append(top[1])
        found, at = (top[0] + weight, k), j + 1
        while at <= n:
            best[at] = max(best[at], found)
            at += at & -at
    top, at = (0, -1), n
    while at:
        top = max(top, best[at])
        at -= at & -at
    chosen, k = [], top[1]
    while k >= 0:
        chosen.append(k)
        k = before[k]
    return top[0], chosen


def align(page: str, reference: str) -> list[int]:
    """For each node of the page's tree the node of the reference it maps to, or -1.

    Simple tree matching. The children of a node have different labels, so a child can map to one
    child of the other node only, and every pair of nodes is looked at once.
    """
    a, b = tree(page), tree(reference)
    out = [-1] * len(a)
    if not a or not b or a[0][0] != b[0][0]:
        return out
    # pairs of nodes with equal labels all the way up, parents first
    met, at = [(0, 0)], 0
    below: list[list[tuple[int, int]]] = []
    while at < len(met):
        x, y = met[at]
        places = {b[child][0]: (j, child) for j, child in enumerate(b[y][1])}
        own = [(places[a[child][0]][0], len(met) + k) for k, child in enumerate([c for c in a[x][1] if a[c][0] in places])]
        met += [(child, places[a[child][0]][1]) for child in a[x][1] if a[child][0] in places]
        below.append(own)
        at += 1
    weights, kept = [1] * len(met), [[] for _ in met]
    for i in reversed(range(len(met))):
        pairs = [(k, j, weights[k]) for j, k in below[i]]
        total, chosen = heaviest(pairs, len(b[met[i][1]][1]))
        weights[i], kept[i] = 1 + total, [pairs[c][0] for c in chosen]
    stack = [0]
    while stack:
        i = stack.pop()
        out[met[i][0]] = met[i][1]
        stack += kept[i]
    return out


HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


def parsed(pages: DataFrame) -> DataFrame:
    """`(page_id, url, host, tree, tree_hash, blocks, links, body_hash)` of `pages(page_id, url, html)`.

    A block has its node in the tree, its text, whether its element's role or links
    rule it out (`out`), and whether it is a link that the slot decides on (`linked`).
    `links` says that the page has one of those.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            trees, lists, links = [], [], []
            for page in batch["html"]:
                root, found = parse(page if isinstance(page, str) else "")
                shape = number(root)
                trees.append(shape)
                marked = any(n.content for n, _, _ in found)
                lists.append([
                    {
                        "node": n.at,
                        "text": t,
                        "out": n.silent or (linked and marked and not n.content),
                        "linked": linked and not marked and n.tag not in HEADINGS,
                    }
                    for n, t, linked in found
                ])
                links.append(any(b["linked"] for b in lists[-1]))
            yield pd.DataFrame(
                {"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "tree": trees, "blocks": lists, "links": links}
            )

    cut = pages.select("page_id", "url", "html").mapInPandas(
        run,
        "page_id long, url string, tree string, blocks array<struct<node:int,text:string,out:boolean,linked:boolean>>, links boolean",
    )
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1))
    texts = F.expr("transform(filter(blocks, b -> not b.out), b -> b.text)")
    return cut.withColumns({"host": host, "tree_hash": F.xxhash64("tree"), "body_hash": F.xxhash64(texts)})


def wrappers(cut: DataFrame, scratch: Scratch, share: float, least: int) -> tuple[DataFrame, DataFrame]:
    """`(host, tree_hash, slots, n)` and `(host, fixed)`.

    `slots` maps the nodes of a tree to the reference, `n` counts the pages of the tree;
    `fixed` lists the `(slot, text hash)` that are template of the host.
    """
    shapes = scratch.write(
        cut.groupBy("host", "tree_hash").agg(F.first("tree").alias("tree"), F.count(F.lit(1)).alias("n"))
    ).df
    reference = shapes.groupBy("host").agg(F.max_by("tree", F.struct("n", "tree_hash")).alias("reference"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple[str, str], list[int]] = {}
        for batch in batches:
            rows = []
            for host, key, n, page, ref in zip(batch["host"], batch["tree_hash"], batch["n"], batch["tree"], batch["reference"], strict=True):
                if (page, ref) not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[page, ref] = align(page, ref)
                rows.append((host, key, known[page, ref], n))
            yield pd.DataFrame(rows, columns=["host", "tree_hash", "slots", "n"])

    slots = scratch.write(
        shapes.join(reference, "host").select("host", "tree_hash", "n", "tree", "reference").mapInPandas(
            run, "host string, tree_hash long, slots array<int>, n long"
        )
    ).df
    # copies of a page count once, and a text once a page, wherever it stands in the slot
    held = (
        _slotted(cut, slots)
        .select("host", "body_hash", F.explode(F.array_distinct(F.expr(
            "transform(filter(blocks, b -> not b.out and slots[b.node] >= 0), b -> struct(slots[b.node] as slot, xxhash64(b.text) as word))"
        ))).alias("b"))
        .groupBy("host", "b.slot", "b.word")
        .agg(F.count_distinct("body_hash").alias("n"))
        .where(F.col("n") >= least)
    )
    different = cut.groupBy("host").agg(F.count_distinct("body_hash").alias("pages"))
    fixed = (
        held.join(different, "host")
        .where(F.col("n") >= share * F.col("pages"))
        # at most 1 / share texts a slot
        .groupBy("host")
        .agg(F.collect_list(F.struct("slot", "word")).alias("fixed"))
    )
    return slots, scratch.write(fixed).df


def _slotted(cut: DataFrame, slots: DataFrame) -> DataFrame:
    """Pages with the slots of their tree; a host with one tree for all its pages stays spread."""
    return join_counted(cut, slots, ["host", "tree_hash"], "n", cut.count())


def link_slots(cut: DataFrame, slots: DataFrame, share: float, least: int) -> DataFrame:
    """`(host, dense)`: slots of which at least `share` of all blocks are links, on hosts of at least `least` pages.

    At most as many as the reference has nodes.
    """
    hosts = cut.where("links").select("host").distinct()
    blocks = _slotted(cut, slots).join(hosts, "host", "left_semi").select(
        "host", F.explode(F.expr("transform(filter(blocks, b -> not b.out and slots[b.node] >= 0), b -> struct(slots[b.node] as slot, b.linked as linked))")).alias("b")
    )
    counted = blocks.groupBy("host", "b.slot").agg(F.count(F.lit(1)).alias("n"), F.count_if("b.linked").alias("links"))
    pages = cut.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    dense = counted.where(F.col("links") >= share * F.col("n")).join(pages.where(F.col("pages") >= least), "host")
    return dense.groupBy("host").agg(F.collect_list("slot").alias("dense"))


def main_text(pages: DataFrame, share: float = CONSTANT_SHARE, least: int = CONSTANT_PAGES) -> DataFrame:
    """Per row of `pages(page_id, url, html)`: page_id, url, host, text, n_chars.

    Blocks are joined by two line feeds. A null or empty page has an empty text; a page
    without a host is a page of the host "", one alone on its host is its own template; role
    words on html, body, main and article do not count, links inside an article are text;
    the text of a page whose blocks are all template is empty. Repeated rows get a row
    each. Other columns are not read.
    """
    scratch = Scratch(pages.sparkSession, "wrapper")
    cut = scratch.write(parsed(pages)).df
    slots, fixed = wrappers(cut, scratch, share, least)
    dense = F.lit(None).cast("array<int>").alias("dense")
    if cut.where("links").isEmpty():
        told = fixed.select("host", "fixed", dense)
    else:
        told = fixed.join(scratch.write(link_slots(cut, slots, share, least)).df, "host", "full")
    # few hosts have template outside of marked elements; a host of very many pages is split by the planner
    joined = _slotted(cut.drop("tree"), slots).join(told, "host", "left")
    body = F.expr("filter(blocks, b -> not b.out and not (b.linked and coalesce(array_contains(dense, slots[b.node]), false)))")
    varying = F.expr(
        "filter(body, b -> fixed is null or not array_contains(fixed, struct(slots[b.node] as slot, xxhash64(b.text) as word)))"
    )
    text = F.concat_ws("\n\n", F.expr("transform(varying, b -> b.text)"))
    return (
        joined.withColumn("body", body)
        .withColumn("varying", varying)
        .select("page_id", "url", "host", text.alias("text"))
        .withColumn("n_chars", F.length("text").cast("long"))
    )
