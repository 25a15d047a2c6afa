"""Main text of web pages by wrapper induction (operator 4).

A page becomes a tree of its block elements.  Pages of one host are aligned by
simple tree matching: two nodes match if their labels do, and the children of
two matched nodes are aligned in order so that most nodes match.  A node whose
text is the same on most pages of the host belongs to the template; nodes whose
text varies are slots.  The content is what the slots hold inside the article
(or the main element, or else the body), without elements that declare another
purpose by their name, class, id or role.

Alignment runs in groups of about ``group_pages`` pages of a host.  Each page is
aligned with the reference tree of its group, which takes in the nodes that it
lacks, so every text of every page has a node and a vote, whichever page comes
first.  Votes are summed over all groups of the host, so a hot host is split and
all its pages count.  Pages with the same blocks count once; pages without any
text have no say.

Defined cases: a null or empty page, or one without content, has the text "" and
0 characters; a null url is a host of its own kind; tags that are never closed
end with their parent; an unknown character reference stays as it is.  Every row
gives one row, repeated rows included.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .packed import arrow_map

cloudpickle.register_pickle_by_value(sys.modules[__name__])

INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea iframe object svg math select title".split())
OTHER_TAGS = set("head nav header footer aside form menu dialog button".split()) | RAW
OTHER_WORDS = set(
    "nav navbar navigation menu header masthead footer sidebar aside ad ads advert adverts advertisement sponsor sponsored promo banner "
    "cookie cookies consent notice popup modal overlay newsletter subscribe signup form search share sharing social related recommended "
    "comment comments reply replies disqus breadcrumb breadcrumbs pagination pager toolbar widget".split()
)
MAIN_TAGS = ("article", "main")
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</?[a-zA-Z](?:[^\"'>]|\"[^\"]*\"|'[^']*')*+>|</?[a-zA-Z][^<>]*>?|[^<]+|<", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)


class Node:
    __slots__ = ("label", "other", "main", "children", "text", "parent", "path")

    def __init__(self, label: str, parent: Node | None, other: bool, main: bool) -> None:
        self.label, self.parent, self.other, self.main = label, parent, other, main
        self.children: list[Node] = []
        self.text = ""
        self.path = "" if parent is None else f"{parent.path}/{label}"


def _purpose(tag: str, name: str) -> tuple[str, bool, bool]:
    """Label of an element, whether it declares another purpose, whether it is the main one."""
    other, main, words = name in OTHER_TAGS, name in MAIN_TAGS, ""
    if len(tag) > len(name) + 2:
        for key, *values in _ATTRIBUTE.findall(tag[len(name) + 1 :]):
            key, value = key.lower(), "".join(values).lower()
            if key in ("class", "id"):
                words = words or value
                other = other or any(w in OTHER_WORDS for w in re.split(r"[^a-z0-9]+", value))
            elif key == "role":
                other = other or value in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu")
                main = main or value in ("main", "article")
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
                other = True
    return f"{name}.{words}" if words else name, other, main


def parse(html: str) -> list[Node]:
    """Block elements and text blocks of a page in page order; text blocks are leaves ``#``."""
    root = Node("", None, False, False)
    nodes, at, run, raw, place = [root], root, [], "", 0

    def close() -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            leaf = Node("#", at, at.other, at.main)
            leaf.text = text
            at.children.append(leaf)
            nodes.append(leaf)

    n = len(html)
    while place < n:
        if raw:
            end = re.compile(rf"</{raw}\b", re.I).search(html, place)
            place, raw = end.start() if end else n, ""
            continue
        match = _TOKEN.match(html, place)
        token = match[0]
        place = match.end()
        if token[0] != "<" or token == "<":
            run.append(unescape(token))
            continue
        if token[1] in "!?":
            continue
        name = _NAME.match(token)[1].lower()
        if name in INLINE:
            if name in ("br", "wbr"):
                run.append(" " if name == "br" else "")
            continue
        close()
        if token[1] == "/":
            up = at
            while up.parent is not None and up.label.partition(".")[0] != name:
                up = up.parent
            if up.parent is not None:
                at = up.parent
            continue
        if name in VOID:
            continue
        # A block ends an open paragraph; items end the item before.
        while at.parent is not None and (at.label.partition(".")[0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6") or at.label.partition(".")[0] == name and name in ("li", "dt", "dd", "tr", "td", "th", "option")):
            at = at.parent
        label, other, main = _purpose(token, name)
        child = Node(label, at, at.other or other, at.main or main)
        at.children.append(child)
        nodes.append(child)
        if token.endswith("/>"):
            continue
        at = child
        if name in RAW:
            raw = name
    close()
    return nodes


def skeleton(html: str) -> list[tuple[int, str, int]]:
    """(parent index, label, text hash) of every node; runs of alike siblings stay as they are."""
    nodes = parse(html)
    index = {id(node): i for i, node in enumerate(nodes)}
    return [(index[id(node.parent)] if node.parent is not None else -1, node.label, _hash(node.text) if node.text else 0) for node in nodes]


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text) >> 1


def align(a: list[tuple[int, str, int]], b: list[tuple[int, str, int]], kids_a: list[list[int]] | None = None) -> list[tuple[int, int]]:
    """Matched node indexes of two skeletons by simple tree matching."""
    kids_a, kids_b = _children(a) if kids_a is None else kids_a, _children(b)
    pairs = []

    def size(x: int, y: int) -> int:
        """Upper bound used as weight: labels must match; deeper nodes are aligned later."""
        return 1 + (a[x][2] == b[y][2] and a[x][2] != 0) + min(len(kids_a[x]), len(kids_b[y])) if a[x][1] == b[y][1] else 0

    todo = [(0, 0)]
    while todo:
        x, y = todo.pop()
        pairs.append((x, y))
        left, right = kids_a[x], kids_b[y]
        # Equal beginnings and ends need no table.
        lo = 0
        while lo < min(len(left), len(right)) and size(left[lo], right[lo]):
            todo.append((left[lo], right[lo]))
            lo += 1
        hi = 0
        while hi < min(len(left), len(right)) - lo and size(left[-1 - hi], right[-1 - hi]):
            todo.append((left[-1 - hi], right[-1 - hi]))
            hi += 1
        left, right = left[lo : len(left) - hi], right[lo : len(right) - hi]
        # Labels of one side only match nothing and need no row or column.
        both = {a[x][1] for x in left} & {b[y][1] for y in right}
        left, right = [x for x in left if a[x][1] in both], [y for y in right if b[y][1] in both]
        if left and right:
            todo.extend(_align_children(a, b, kids_a, kids_b, left, right, size))
    return pairs


def merge(reference: list[tuple[int, str, int]], kids: list[list[int]], tree: list[tuple[int, str, int]]) -> list[int]:
    """Node of the reference for each node of a page; nodes that it lacks are added in their place."""
    at = [-1] * len(tree)
    for x, y in align(reference, tree, kids):
        at[y] = x
    last: dict[int, int] = {}
    for y, (parent, label, text) in enumerate(tree):
        if at[y] < 0:
            at[y], up = len(reference), at[parent]
            reference.append((up, label, text))
            kids.append([])
            # Behind the sibling before it; alignment keeps the order.
            kids[up].insert(kids[up].index(last[parent]) + 1 if parent in last else 0, at[y])
        last[parent] = at[y]
    return at


def _children(tree: list[tuple[int, str, int]]) -> list[list[int]]:
    kids: list[list[int]] = [[] for _ in tree]
    for i, (parent, _, _) in enumerate(tree):
        if parent >= 0:
            kids[parent].append(i)
    return kids


def _align_children(a: list, b: list, kids_a: list[list[int]], kids_b: list[list[int]], left: list[int], right: list[int], size) -> list[tuple[int, int]]:
    best = np.zeros((len(left) + 1, len(right) + 1), np.int32)
    codes: dict[str, int] = {}
    label = np.array([codes.setdefault(b[y][1], len(codes)) for y in right])
    text = np.array([b[y][2] for y in right], np.int64)
    below = np.array([len(kids_b[y]) for y in right])
    for i, x in enumerate(left, 1):
        # ``size`` of x and every node on the right.
        gains = 1 + ((text == a[x][2]) & (text != 0)) + np.minimum(below, len(kids_a[x]))
        row = np.maximum(best[i - 1, 1:], np.where(label == codes.get(a[x][1], -1), best[i - 1, :-1] + gains, 0))
        best[i, 1:] = np.maximum.accumulate(row)
    i, j, out = len(left), len(right), []
    while i and j:
        gain = size(left[i - 1], right[j - 1])
        if gain and best[i, j] == best[i - 1, j - 1] + gain:
            out.append((left[i - 1], right[j - 1]))
            i, j = i - 1, j - 1
        elif best[i, j] == best[i - 1, j]:
            i -= 1
        else:
            j -= 1
    return out


def _paths(tree: list[tuple[int, str, int]]) -> list[str]:
    out: list[str] = []
    for parent, label, _ in tree:
        out.append("" if parent < 0 else f"{out[parent]}/{label}")
    return out


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url.cast("string"), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def induce(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", group_pages: int = 400, share: float = 0.6, at_least: int = 5) -> DataFrame:
    """(host, constants): texts, as path and hash, that most pages of the host share."""

    def skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [skeleton(h) for h in batch.column(1).to_pylist()]
            # Empty, and left out, if no node has a text.
            nodes = pa.array(["\n".join(f"{p}\t{label}\t{h}" for p, label, h in tree) if any(h for _, _, h in tree) else "" for tree in rows], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), nodes], ["host", "tree"])

    source = pages.where(F.col(html_col).isNotNull()).select(host_of(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html"))
    trees = cut(arrow_map(source, skeletons, "host string, tree string").where(F.length("tree") > 0))
    distinct = trees.groupBy("host", F.xxhash64("tree").alias("h")).agg(F.first("tree").alias("tree"))
    counts = trees.groupBy("host").agg(F.approx_count_distinct(F.xxhash64("tree")).alias("n"))
    salt = F.pmod("h", F.ceil(F.col("n") / group_pages))
    # One key of host and salt: rows that the join has dealt out by host would stay together under two.
    salted = distinct.join(counts, "host").select("host", F.struct("host", salt.alias("salt")).alias("unit"), "tree")

    def votes(table: pa.Table) -> pa.Table:
        host = table.column("host")[0].as_py()
        trees = [[(int(p), label, int(h)) for p, label, h in (line.split("\t") for line in t.split("\n"))] for t in sorted(table.column("tree").to_pylist())]
        trees.sort(key=len, reverse=True)
        reference, same = list(trees[0]), Counter()
        kids, paths = _children(reference), _paths(reference)
        for tree in trees:
            at = merge(reference, kids, tree)
            paths.extend(f"{paths[parent]}/{label}" for parent, label, _ in reference[len(paths) :])
            # A text that a page repeats counts once.
            same.update({(paths[x], h) for x, (_, _, h) in zip(at, tree) if h})
        rows = [(host, p, h, k) for (p, h), k in same.items()]
        return pa.table({"host": pa.array([r[0] for r in rows], pa.string()), "path": pa.array([r[1] for r in rows], pa.string()), "hash": pa.array([r[2] for r in rows], pa.int64()), "same": pa.array([r[3] for r in rows], pa.int64())})

    seen = salted.groupBy("unit").applyInArrow(votes, "host string, path string, hash long, same long")
    total = seen.groupBy("host", "path", "hash").agg(F.sum("same").alias("same"))
    pages_of = distinct.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    constant = total.where(F.col("same") >= at_least).join(pages_of, "host").where(F.col("same") >= share * F.col("pages"))
    # At most 1/share texts a path can reach the share, so a host's list is short.
    return constant.groupBy("host").agg(F.collect_list(F.struct("path", "hash")).alias("constants"))


def content(html: str | None, constants: set[tuple[str, int]]) -> str:
    """Varying text of the main element of one page."""
    leaves = [node for node in parse(html) if node.text and not node.other] if html else []
    if any(node.main for node in leaves):
        leaves = [node for node in leaves if node.main]
    return " ".join(node.text for node in leaves if not constants or (node.path, _hash(node.text)) not in constants)


def extract(pages: DataFrame, templates: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text) of every page, with the templates of the hosts."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [content(h, {(c["path"], c["hash"]) for c in known or ()}) for h, known in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["id", "url", "text"])

    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"), host_of(F.col(url_col)).alias("host"))
    # No hint: Spark broadcasts the templates while they are small and splits hot hosts beyond that.
    joined = source.join(templates, "host", "left").select("id", "url", "html", "constants")
    kind = {f.name: f.dataType.simpleString() for f in joined.schema.fields}
    return arrow_map(joined, texts, f"id {kind['id']}, url {kind['url']}, text string")
