"""The main body of html pages by composite text density (problem 5, where there is markup).

A page's elements form a tree. Each node's density is its characters per tag, adjusted by how many of both are links;
a node's sum is that of its children's densities, a leaf's its own. The node with the largest sum tells the threshold,
the least density on its way up to the body; within every node at or above it the subtree with the largest sum is kept.
(Sun, Song, Liao: DOM based content extraction via text density, 2011.)
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import spread

# Elements that never have an end tag, that hold no text to read, and that stand within a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset("script style noscript template svg head select button textarea".split())
INLINE = frozenset("a abbr b bdi cite code em font i kbd mark q s small span strong sub sup time u var".split())
#: Elements that another of their kind ends.
SIBLINGS = frozenset("p li dt dd tr td th option".split())


class Tree(HTMLParser):
    """Nodes in document order: parents, tags, and pieces of text (node, text) as they come."""

    def __init__(self, source: str) -> None:
        super().__init__()
        self.parent, self.tag, self.text = [-1], ["#page"], []
        self.open, self.unread = [0], 0
        self.feed(source)
        self.close()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in SIBLINGS and self.tag[self.open[-1]] == tag:
            self.open.pop()
        self.parent.append(self.open[-1])
        self.tag.append(tag)
        if tag not in VOID:
            self.open.append(len(self.tag) - 1)
            self.unread += tag in UNREAD

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.tag[self.open[k]] == tag:
                self.unread -= sum(self.tag[n] in UNREAD for n in self.open[k:])
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        if not self.unread and data.strip():
            self.text.append((self.open[-1], data))


def densities(tree: Tree) -> tuple[list[float], list[float]]:
    """(density, sum of the children's densities) of every node."""
    n = len(tree.tag)
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    for node, text in tree.text:
        chars[node] += len("".join(text.split()))
    linked = [False] * n
    for k in range(1, n):
        linked[k] = tree.tag[k] == "a" or linked[tree.parent[k]]
    for k in range(n - 1, 0, -1):
        up = tree.parent[k]
        if linked[k]:
            link_chars[k], link_tags[k] = chars[k], link_tags[k] + (tree.tag[k] == "a")
        chars[up] += chars[k]
        link_chars[up] += link_chars[k]
        tags[up] += tags[k] + 1
        link_tags[up] += link_tags[k]
    rate = link_chars[0] / max(1, chars[0])
    density, total, leaf = [0.0] * n, [0.0] * n, [True] * n
    for k in range(n):
        if chars[k] > link_chars[k]:  # what is all links has none
            base = math.log(chars[k] * link_chars[k] / max(1, chars[k] - link_chars[k]) + rate * chars[k] + math.e)
            links = max(1, link_chars[k]) * max(1, link_tags[k])
            density[k] = chars[k] / max(1, tags[k]) * max(0.0, math.log(chars[k] * max(1, tags[k]) / links)) / math.log(base + 1e-9) if base > 1.0000001 else float(chars[k])
    for k in range(1, n):
        leaf[tree.parent[k]] = False
        total[tree.parent[k]] += density[k]
    return density, [density[k] if leaf[k] else total[k] for k in range(n)]


def main_body(source: str) -> str:
    """The text of a page's main body, one line per block; '' where no node has any density."""
    tree = Tree(source)
    density, total = densities(tree)
    n = len(total)
    if max(density) <= 0:
        return ""
    body = tree.tag.index("body") if "body" in tree.tag else 0
    end = list(range(1, n + 1))  # one past the last node of each subtree: a subtree is a run of nodes
    for k in range(n - 1, 0, -1):
        end[tree.parent[k]] = max(end[tree.parent[k]], end[k])
    below = range(body + 1, end[body]) or range(body, end[body])
    best = max(below, key=lambda k: (total[k], -k))
    least, k = density[best], best
    while k not in (-1, body):
        k = tree.parent[k]
        least = min(least, density[k])
    kept = [False] * n
    top = list(range(n))  # of each subtree the node with the largest sum, which may be its root
    for k in range(n - 1, 0, -1):
        top[tree.parent[k]] = max(top[tree.parent[k]], top[k], key=lambda j: (total[j], -j))
    for k in below:
        if density[k] > 0 and density[k] >= least:
            kept[top[k]] = True
    for k in range(1, n):
        kept[k] = kept[k] or kept[tree.parent[k]]
    block = list(range(n))
    for k in range(1, n):
        if tree.tag[k] in INLINE:
            block[k] = block[tree.parent[k]]
    lines: list[list] = []
    for node, text in tree.text:
        if kept[node]:
            if lines and lines[-1][0] == block[node]:
                lines[-1][1] += text
            else:
                lines.append([block[node], text])
    return "\n".join(line for _, t in lines if (line := " ".join(t.split())))


def main_bodies(pages: DataFrame, key: str = "record_id", source: str = "html") -> DataFrame:
    """(key, html) to (key, content): each page's main body. Null and empty sources have an empty body; other columns are left out."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([main_body(x or "") for x in batch.column(1).to_pylist()], pa.string())], names=[key, "content"])

    rows = spread(pages.select(key, F.col(source).alias("__source")))
    return rows.mapInArrow(read, f"`{key}` {pages.schema[key].dataType.simpleString()}, content string")
