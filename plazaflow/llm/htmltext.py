"""Main text of web pages by tag-path ratios.

A page is read into text nodes, each with its path of block tags from the root, classes included. Per path, text length,
sentence marks and linked text are summed; the path's ratio is the root of its text per node, raised by marks, lowered by
links, by text that stands bare in a container, and by a class or id that names surroundings. The nodes' ratios in page
order are smoothed with their neighbours' and fused with the path's own; a heading has that of what follows it. The
threshold is the split of a page's ratios, by text, into two groups that differ most; where they differ by less than
``APART`` times, all nodes are content, save those that a class or id names surroundings and that no other path equals.

The article is the container whose content nodes have most text over that of the others in it. Everything inside it
belongs to it, short paragraphs, captions and notes too, save menus (blocks of nothing but links, other than a list that a
heading or a colon announces after text of the article) and blocks that a class
or id names surroundings and whose ratio is under the threshold. Headings, paragraphs and lists beside it belong to it up
to the body. If it is the body itself, its containers are judged one by one. No tag and no class makes an article.

Never part of it are elements that are no text of the page by their kind: scripts, styles, forms and their controls, nav,
aside, footer and dialog, hidden ones, those with such a role, and of a header all but its headings (at the top, all of it).

Character references are decoded, white space inside a block becomes one space, blocks are joined in page order by a line
feed. Null, empty and textless pages give an empty text. Unclosed, misnested and cut-off markup is read as browsers do in
outline: a block ends when an enclosing one does, a paragraph when another block begins. Reading is linear in a page's
length. Every row gives one row; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import pairwise
from math import exp, log, sqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches

# possessive throughout: no part of a tag is read twice
MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^"'>]++|"[^"]*+"|'[^']*+'|["'])*+)(?:>|\Z)""", re.DOTALL)
# every attribute is read with its value, so that no word inside a value passes for a name
ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]++)))?""")
# fixed values: element kinds of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe object svg canvas select annotation annotation-xml".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr"
    " math mrow mi mo mn ms mtext mspace msup msub msubsup mfrac msqrt mroot munder mover munderover mfenced menclose mstyle mpadded mphantom semantics".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ENDS_PARAGRAPH = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: Elements that end an open one of their own kind, and what bounds the search for it.
SIBLINGS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
# fixed values: tags, roles and class words of what surrounds an article; the words lower a ratio, they decide nothing alone
BOILERPLATE_TAGS = frozenset("head nav footer aside form button input label fieldset dialog menu".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
SURROUNDINGS = frozenset(
    "ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comment comments respond reply replies disqus discussion discussions cookie cookies consent gdpr"
    " notice notices popup overlay newsletter subscribe subscription signup login menu nav navbar navigation footer masthead sidebar aside"
    " widget widgets related recommended promo promotion sponsor sponsored share sharing social toolbar pagination pager".split()
)
#: Of these, the ones that name a block of readers' words; a paragraph of the article may bear them.
READERS = frozenset("comment comments respond reply replies disqus discussion discussions".split())
#: Words that say where such a block stands.
PLACES = frozenset("site page main primary secondary global top bottom left right".split())
PROSE = frozenset(("p", "blockquote", "pre", "li", "dt", "dd", "td", "th", "figcaption", "caption", "summary", *HEADINGS))
#: Blocks that are no containers: an article is never one of them.
PARTS = PROSE | frozenset("ul ol dl menu table thead tbody tfoot tr figure hgroup details address".split()) - {"td"}
#: What a path's ratio is multiplied by for bare text in a container, and for a class or id that names surroundings.
BARE, NAMED = 0.35, 0.05
#: The smoothed ratio's weight beside the path's own; how many times two groups of ratios differ at least.
SMOOTHED, APART = 0.25, 3.0
MARKS = re.compile(r"[.,;:!?。、，！？]")


class Block:
    """An open element. ``path`` numbers its tag path: equal paths of a page have equal numbers.

    ``junk`` is no text of the page by tag, role or style, ``named`` names surroundings by class or id; both its own or
    inherited. ``end`` is the number after its last descendant's.
    """

    __slots__ = ("depth", "end", "junk", "named", "number", "parent", "path", "tag")

    def __init__(self, tag: str, parent: Block | None, number: int, path: int, junk: bool, named: bool) -> None:
        self.tag, self.parent, self.number, self.path = tag, parent, number, path
        self.depth = parent.depth + 1 if parent else 0
        self.junk = junk or (parent is not None and parent.junk)
        self.named = named or (parent is not None and parent.named)
        self.end = number + 1


def _surrounds(token: str, tag: str) -> bool:
    """Whether a class or id token of such an element names what surrounds an article."""
    words = [w for w in re.split(r"[^a-z]+", token) if w]
    naming = [w for w in words if w in SURROUNDINGS and not (tag == "p" and w in READERS)]
    return bool(naming) and all(w in SURROUNDINGS or w in PLACES for w in words)


def _attributes(text: str, tag: str) -> tuple[str, bool, bool]:
    """A tag's classes for its path, whether its role or style make it boilerplate, and whether its classes or id do."""
    if not text or text.isspace():
        return "", False, False
    names, junk, named = "", False, False
    for name, a, b, c in ATTRIBUTE.findall(text):
        value = (a or b or c).lower()
        name = name.lower()
        if name in ("class", "id"):
            if name == "class":
                names = "." + ".".join(sorted(value.split()))
            named = named or any(_surrounds(t, tag) for t in value.split())
        elif name == "role":
            junk = junk or value in BOILERPLATE_ROLES
        elif name == "style":
            junk = junk or "display:none" in value.replace(" ", "")
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            junk = True
    return names, junk, named


def text_nodes(html: str) -> tuple[list[Block], list[tuple[Block, str, int]]]:
    """All blocks, parents first, and each block-level run of text in page order: its block, its text, its linked characters."""
    blocks = [Block("", None, 0, 0, False, False)]
    paths: dict[tuple[int, str], int] = {}
    stack = [blocks[0]]
    places: defaultdict[str, list[int]] = defaultdict(list)  # of each tag, where it is open in the stack
    nodes: list[tuple[Block, str, int]] = []
    run: list[str] = []
    linked = depth = 0

    def close(to: int) -> None:
        while len(stack) > to:
            places[stack.pop().tag].pop()

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(run).split())
        if text:
            nodes.append((stack[-1], text, min(linked, len(text))))
        run.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece:
            piece = entities.unescape(piece) if "&" in piece else piece
            run.append(piece)
            if depth:
                linked += len(piece)

    at = 0
    while True:
        found = MARKUP.search(html, at)
        add(html[at : found.start()] if found else html[at:])
        if not found:
            break
        at = found.end()
        closing, tag = found[1], (found[2] or "").lower()
        if not tag:
            continue
        if closing:
            if tag == "a":
                depth = max(0, depth - 1)
            elif tag not in INLINE and tag not in VOID:
                if places[tag]:
                    flush()
                    close(places[tag][-1])
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(html, at)
            at = end.end() if end else len(html)
            continue
        if tag == "br":
            run.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag == "a":
            depth = 1
            continue
        names, junk, named = _attributes(found[3], tag)
        if tag in ("html", "body"):
            junk = named = False
        if tag in INLINE and not (junk or named):
            continue
        flush()
        depth = 0
        if tag in ENDS_PARAGRAPH and stack[-1].tag == "p":
            close(len(stack) - 1)
        if places[tag] and tag in SIBLINGS and places[tag][-1] > max((places[b][-1] for b in SIBLINGS[tag] if places[b]), default=0):
            close(places[tag][-1])
        path = paths.setdefault((stack[-1].path, tag + names), len(paths) + 1)
        blocks.append(Block(tag, stack[-1], len(blocks), path, junk or tag in BOILERPLATE_TAGS, named))
        places[tag].append(len(stack))
        stack.append(blocks[-1])
    flush()
    for block in reversed(blocks):
        if block.parent:
            block.parent.end = max(block.parent.end, block.end)
    return blocks, nodes


def ratios(nodes: list[tuple[Block, str, int]], width: int = 2) -> list[float]:
    """The tag-path ratio of each node, its path's own fused with its neighbours'."""
    sums: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0, 0.0])
    for block, text, linked in nodes:
        s = sums[block.path]
        s[0] += 1
        s[1] += len(text)
        s[2] += len(MARKS.findall(text))
        s[3] += linked
    of_path = {path: sqrt(s[1] / s[0] * (1 + s[2] / s[0])) * (1 - s[3] / s[1]) for path, s in sums.items()}
    own = [of_path[b.path] * (1 if b.tag in PROSE else BARE) * (NAMED if b.named else 1) for b, _, _ in nodes]
    for k in reversed(range(len(own) - 1)):
        if nodes[k][0].tag in HEADINGS:
            own[k] = max(own[k + 1 : k + 3])
    kernel = [exp(-(k * k) / (2 * width)) for k in range(-width, width + 1)]
    out = []
    for k in range(len(own)):
        part = [(kernel[d + width], own[k + d]) for d in range(-width, width + 1) if 0 <= k + d < len(own)]
        smooth = sum(w * v for w, v in part) / sum(w for w, _ in part)
        out.append(own[k] ** (1 - SMOOTHED) * smooth**SMOOTHED)
    return out


def threshold(values: list[float], sizes: list[int]) -> float:
    """Where the logarithms of the values, weighted by ``sizes``, fall into two groups that differ most; 0 if by too little."""
    points = sorted(zip((log(max(v, 1e-3)) for v in values), sizes, strict=True))
    total, whole = sum(n for _, n in points), sum(v * n for v, n in points)
    best, limit, weight, below = 0.0, 0.0, 0, 0.0
    for (v, n), (after, _) in pairwise(points):
        weight += n
        below += v * n
        apart = (whole - below) / (total - weight) - below / weight
        if after > v and apart > log(APART) and weight * (total - weight) * apart * apart > best:
            best, limit = weight * (total - weight) * apart * apart, exp((v + after) / 2)
    return limit


def main_text(html: str | None, *, menu_nodes: int = 3, menu_share: float = 0.9) -> str:
    """The article's text. A menu is a block of at least ``menu_nodes`` nodes whose text is linked to ``menu_share``."""
    blocks, found = text_nodes(html or "")
    header = [0] * len(blocks)  # 1 in a header, 2 in one at the top of the page
    for block in blocks:
        if block.parent:
            top = block.parent.tag in ("", "html", "body")
            header[block.number] = max(header[block.parent.number], (2 if top else 1) if block.tag == "header" else 0)
    nodes = [n for n in found if not n[0].junk and (not header[n[0].number] or (header[n[0].number] == 1 and n[0].tag in HEADINGS))]
    if not nodes:
        return ""
    values = ratios(nodes)
    limit = threshold(values, [len(t) for _, t, _ in nodes])
    # where no group stands out, what is named surroundings is held against the page's best other path
    most = limit or max((v for (b, _, _), v in zip(nodes, values, strict=True) if not b.named), default=0.0)
    passes = [v >= (most if b.named else limit) for (b, _, _), v in zip(nodes, values, strict=True)]

    # text of content over that of the rest, and nodes, text and linked text, of each block with all below it
    total, sums = [0] * len(blocks), [[0, 0, 0] for _ in blocks]
    for (block, text, linked), content in zip(nodes, passes, strict=True):
        total[block.number] += len(text) if content else -len(text)
        for k, n in enumerate((1, len(text), linked)):
            sums[block.number][k] += n
    for block in reversed(blocks):
        if block.parent:
            # what is named surroundings doesn't count against the block around it
            outer = block.named and not block.parent.named and total[block.number] < 0
            total[block.parent.number] += 0 if outer else total[block.number]
            for k, n in enumerate(sums[block.number]):
                sums[block.parent.number][k] += n
    page = [b.tag in ("", "html", "body") for b in blocks]
    earlier, last = [-1] * len(blocks), [-1] * len(blocks)  # the block before of the same parent; the last child so far
    for block in blocks[1:]:
        earlier[block.number], last[block.parent.number] = last[block.parent.number], block.number
    lead = [False] * len(blocks)  # blocks that say what the next one lists
    for block, text, _ in nodes:
        lead[block.number] = block.tag in HEADINGS or (block.tag in PROSE and text.endswith((":", "：")))
    menu = [False] * len(blocks)
    for block in blocks:
        n, text, linked = sums[block.number]
        own = block.tag not in HEADINGS and n >= menu_nodes and linked >= menu_share * text and not page[block.number]
        # a list that its heading announces between the article's own blocks is one of references
        before = earlier[block.number]
        own = own and not (block.tag in ("ul", "ol", "dl") and before >= 0 and lead[before] and earlier[before] >= 0 and total[earlier[before]] > 0 and not block.named)
        menu[block.number] = own or (block.parent is not None and menu[block.parent.number])

    inside = [False] * len(blocks)  # blocks all of whose text belongs to the article

    def select(first: int, end: int) -> None:
        """Marks the article among the blocks numbered from ``first`` on."""
        holder = max((b for b in blocks[first:end] if b.tag not in PARTS), key=lambda b: (total[b.number], b.depth), default=None)
        if holder is None or (total[holder.number] <= 0 and first):
            return
        if page[holder.number]:
            inside[holder.number] = True
            at = holder.number + 1
            while at < holder.end:
                child = blocks[at]
                if page[at]:
                    inside[at] = True
                    at += 1
                    continue
                if child.tag in PARTS:
                    inside[at : child.end] = [True] * (child.end - at)
                else:
                    select(at, child.end)
                at = child.end
            return
        inside[holder.number : holder.end] = [True] * (holder.end - holder.number)
        up = holder.parent
        while up and not page[up.number] and up.number >= first:
            at = up.number + 1
            while at < up.end:
                if blocks[at].tag in PARTS:
                    inside[at : blocks[at].end] = [True] * (blocks[at].end - at)
                at = blocks[at].end
            up = up.parent
        # headings right before it, where it has no title of its own
        if up and page[up.number] and not any(b.tag == "h1" for b in blocks[holder.number : holder.end]):
            at = holder
            while at.parent is not up:
                at = at.parent
            before = earlier[at.number]
            while before >= 0 and blocks[before].tag in HEADINGS:
                inside[before] = True
                before = earlier[before]

    select(0, len(blocks))
    kept = []
    for (block, text, _), content in zip(nodes, passes, strict=True):
        bare = page[block.number]  # text that stands in the body itself
        if inside[block.number] and (content or not (bare or block.named or menu[block.number])):
            kept.append(text)
    return "\n".join(kept)


def extract_main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url and text of each page."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return in_batches(source, work, "page_id long, url string, text string")
