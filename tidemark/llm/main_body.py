"""Problem 3: the main body of a page without its furniture.

Composite text density. A page is a tree: the body, blocks of neighbouring lines, lines. Of each node we know
its characters C, tags T, link characters LC and link tags LT. The density of a node is C/T * log(C*T / (LC*LT)) to
a base that grows where links outweigh text, so what is all link has density 0; the densities of a node's
children are summed, the block with the largest sum is the core, and its lower bound is the least density on the
path from the core to the body. Lines of density 0 end a block and are outside; blocks above the bound span the
article; headline, subheadings, lists and tables that adjoin it are kept.

The stored texts carry no markup, so tags and link characters are estimated. A line has a tag for each of its
parts. All its characters count as link characters if it recurs within its site or across sites (a menu, footer
or notice of whatever wording; see recurrence), if its form is that of a crumb, by-line, tag line or lead to another story,
or if it is a title where only links to other stories stand. A subheading recurs, too, but leads a section: it
weighs what follows it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import runtime
from tidemark.llm import page_lines as P
from tidemark.llm import recurrence, residue

@dataclass
class Node:
    chars: int = 0
    tags: int = 0
    link_chars: int = 0
    link_tags: int = 0
    children: list[Node] = field(default_factory=list)

    def add(self, child: Node) -> Node:
        self.children.append(child)
        self.chars += child.chars
        self.tags += child.tags
        self.link_chars += child.link_chars
        self.link_tags += child.link_tags
        return self


def density(n: Node, body: Node) -> float:
    """Composite text density of a node within a body."""
    if not n.chars:
        return 0.0
    t, lc, lt = max(n.tags, 1), max(n.link_chars, 0.5), max(n.link_tags, 1)
    own = max(n.chars - n.link_chars, 1)
    base = math.log(n.chars / own * n.link_chars + body.link_chars / max(body.chars, 1) * n.chars + math.e)
    return max(0.0, n.chars / t * math.log(n.chars * t / (lc * lt), max(base, 1.0001)))


def density_sum(n: Node, body: Node) -> float:
    return sum(density(c, body) for c in n.children) if n.children else density(n, body)


def line_node(chars: int, parts: int, link: bool) -> Node:
    return Node(chars, 2 * parts, chars, 2 * parts) if link else Node(chars, parts, 0, 0)


def leads_section(i: int, codes: list[int], recurs: set[int]) -> bool:
    """Whether text of the page's own follows line i, links to other stories aside."""
    for j in range(i + 1, len(codes)):
        if codes[j] in P.CONTENT:
            return j not in recurs
        if j in recurs or codes[j] in (P.MENU, P.CRUMB_LINE, P.MESSAGE):
            return False
    return False


def link_lines(codes: list[int], flags: list[int], recurs: set[int]) -> list[bool]:
    """For each line whether all its characters count as link characters."""
    n = len(codes)
    by_form = (P.MESSAGE, P.LINK, P.RELATED_HEAD, P.CRUMB_LINE)
    shown = [i for i in range(n) if codes[i] != P.BLANK]
    beside = {i for a, b in zip(shown, shown[1:]) if codes[a] == codes[b] == P.MENU for i in (a, b)}  # a menu's entries stand together
    out = []
    for i, code in enumerate(codes):
        if code == P.MENU:
            out.append(i in recurs or i in beside)
        elif code == P.TITLE:
            out.append(i in recurs and (bool(flags[i] & P.HINTED) or not leads_section(i, codes, recurs)))
        else:
            out.append(code in by_form or i in recurs)
    title = [codes[i] in (P.TITLE, P.MENU) and not out[i] for i in range(n)]
    content = [codes[i] in P.CONTENT and not out[i] for i in range(n)]
    seen_head = False
    i = 0
    while i < n:
        if content[i]:
            seen_head = True  # a headline comes before the first text
        elif title[i]:
            # after the headline a line of a title's length is a link to another story, a short one a subheading
            if seen_head and flags[i] & P.STORY and not flags[i] & P.LIST_LIKE:
                out[i] = True
            seen_head = True
        elif codes[i] == P.RELATED_HEAD:
            j = i + 1
            while j < n and (codes[j] == P.BLANK and j == i + 1 or title[j] and not flags[j] & P.LIST_LIKE):
                if not seen_head and flags[j] & P.HEADLINE:
                    break
                j += 1
            # without a headline so far, the last title before text is the headline
            if not seen_head and j < n and j - i > 2 and content[j] and title[j - 1]:
                j -= 1
            for m in range(i + 1, j):
                out[m] = out[m] or title[m]
            i = j - 1
        i += 1
    return out


def split_lines(codes: list[int], flags: list[int], chars: list[int], parts: list[int], recurs: set[int]) -> tuple[list[int], list[int]]:
    """Line numbers (from 1) of the main body and of the non-empty lines outside it."""
    # a story's title recurs where others link to it, which tells nothing about it here
    recurs = {i for i in recurs if codes[i] != P.TITLE or flags[i] & P.HINTED or not flags[i] & (P.STORY | P.HEADLINE)}
    link = link_lines(codes, flags, recurs)
    nodes = [line_node(c, p, k) for c, p, k in zip(chars, parts, link)]
    body = Node()
    for node in nodes:
        body.add(node)
    weigh = [density(node, body) > 0 or codes[i] == P.BLANK for i, node in enumerate(nodes)]
    blocks, spans, start = [], [], None
    for i in range(len(codes) + 1):
        inside = i < len(codes) and weigh[i]
        if inside and start is None:
            start = i
        elif not inside and start is not None:
            block = Node()
            for j in range(start, i):
                if codes[j] != P.BLANK:
                    block.add(nodes[j])
            blocks.append(block)
            spans.append((start, i))
            start = None
    outside = [i + 1 for i, w in enumerate(weigh) if not w]
    if not any(b.chars for b in blocks):
        return [], outside
    core = max(range(len(blocks)), key=lambda b: (density_sum(blocks[b], body), -b))
    path = Node()  # the body as the tree of its blocks; lines outside all blocks hang from it one by one
    for b in blocks:
        path.add(b)
    for i, w in enumerate(weigh):
        if not w:
            path.add(nodes[i])
    bound = min(density(path, path), density(blocks[core], path))
    dense = [b for b in range(len(blocks)) if b == core or density(blocks[b], path) >= bound and (len(blocks[b].children) > 1 or any(codes[j] in P.CONTENT for j in range(*spans[b])))]
    first, last = dense[0], dense[-1]
    # headline and subheadings adjoin the article from above, across by-lines and links to other stories
    while first > 0 and not any(codes[j] in (P.CRUMB_LINE, P.MENU) for j in range(spans[first - 1][1], spans[first][0])):
        first -= 1
    main = []
    for b, (s, e) in enumerate(spans):
        rows = [j for j in range(s, e) if codes[j] != P.BLANK]
        if first <= b <= last:
            if b == first:  # single words above the headline are menu entries
                while len(rows) > 1 and codes[rows[0]] == P.TITLE and flags[rows[0]] & P.SHORT and codes[rows[1]] == P.TITLE:
                    outside.append(rows.pop(0) + 1)
            main += [j + 1 for j in rows]
        else:
            outside += [j + 1 for j in rows]
    return main, sorted(outside)


def page_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrays of lines to line numbers in and outside the body."""
    names = ("codes", "flags", "chars", "parts", "recurs")
    for b in batches:
        both = [split_lines(*lists, set(r)) for *lists, r in zip(*(b.column(n).to_pylist() for n in names))]
        arrays = [b.column("id"), *(pa.array([x[i] for x in both], pa.list_(pa.int32())) for i in range(2))]
        yield pa.RecordBatch.from_arrays(arrays, ["id", "main", "outside"])


def main_body(pages: DataFrame) -> DataFrame:
    """pages of recurrence.with_recurrence to (id, main ARRAY<INT>, outside ARRAY<INT>).

    Line numbers inside and outside the body; empty lines are in neither. NULL and empty texts give empty arrays;
    a page without any text of its own has everything outside. Page by page: no shuffle, no state.
    """
    schema = f"id {pages.schema['id'].dataType.simpleString()}, main array<int>, outside array<int>"
    return pages.select("id", "codes", "flags", "chars", "parts", "recurs").mapInArrow(page_rows, schema)


def html_pages(texts: DataFrame, sites: DataFrame) -> DataFrame:
    """main_body of the HTML files among texts (id, store_path, text) that aren't residue. sites: (store_path, site, html).

    All files are read once, since lines recur over all of them; type and residue are settled on arrays of
    lines, so texts never move.
    """
    pages, wide = recurrence.with_recurrence(texts, sites)
    left_out = residue.verdicts(pages, wide).filter("residue").select("id")
    left_out = runtime.written(left_out, runtime.new_dir(texts.sparkSession, "residue"))
    return main_body(runtime.join_small(pages.filter("html"), left_out, ["id"], "left_anti"))


def body_text(pages: DataFrame, inside: DataFrame) -> DataFrame:
    """pages (id, text) and line numbers (id, main) to (id, main_text): the lines of the main body, in order."""
    lines = inside.select("id", "main").join(pages.select("id", F.split("text", "\n").alias("lines")), "id")
    # one split a page: lines are picked from the array, not from the text again
    return lines.select("id", F.array_join(F.transform(F.array_sort("main"), lambda n: F.element_at("lines", n)), "\n").alias("main_text"))
