"""Main text of web pages: wrappers induced by aligning the trees of same-host pages."""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ByteCache, bound_batches, set_aside, small_batches, stage

# HTML element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup, and elements of which nothing is shown as text.
RAW = frozenset("script style iframe textarea title noembed noframes".split())
HIDDEN = frozenset("noscript template svg annotation annotation-xml canvas object select datalist audio video".split())
BLOCK = frozenset("html body head main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address details summary fieldset nav header footer aside form menu dialog center hgroup search".split())
HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPED = frozenset(CLOSES)
HOLDS = frozenset("ul ol dl table menu".split())
MAIN = frozenset(("article", "main"))
#: Elements whose text is not the article's.
NOT_TEXT = frozenset("head nav header footer aside form menu dialog button label search".split())
#: Words of a class, id or role whose element's text is not the article's, where it is outside of an article element.
NOT_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising adslot banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs pagination pager header masthead footer sidebar aside widget related recommended share social comment comments reply replies respond disqus notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription complementary contentinfo search toolbar skip".split()
)
#: Inside of one an author's own names begin or end in such words too, so that only these count, as a whole class or role.
NOT_NAMES = frozenset("ad ads advert adverts advertisement adslot sponsored promo nav navbar navigation menu breadcrumb breadcrumbs pagination sidebar comment comments disqus newsletter popup modal cookie-notice cookie-banner complementary contentinfo".split())
MIN_SHARE = 0.5
#: Pages are alike and vote as one if more than this share of their text, with an article or without one, is in lines that
#: more than SHARED of their layout's pages have.
ALIKE_MAIN, ALIKE, SHARED = 1 / 3, 2 / 3, 1 / 8
#: Characters for which a line of text counts as one; a longer line counts as several.
PIECE = 100
#: Pages that have to agree before anything inside an article is template.
MAIN_PAGES = 3
#: Pages are of one layout if this share of all their paths of tags is common to them.
SAME_LAYOUT = 0.6
#: A host's most frequent tree shapes, of which its layouts' leaders are chosen, in each round.
LEADERS = 64
#: Parts into which the pages of a layout are dealt where all of them meet what the layout repeats.
SALTS = 16
BROADCAST_BYTES = 32 << 20
BROADCAST_SLOTS = 2_000_000
#: Cells of one table of children, and of all tables of a page, beyond which numpy finds the same scores.
TABLE_CELLS, PAGE_CELLS = 1 << 16, 1 << 21
SEED_CHARS = 8 << 20

_S = r"[ \t\n\r\f]"
_ATTR = rf"""[^ \t\n\r\f/>][^ \t\n\r\f/>=]*+(?:{_S}*+={_S}*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^ \t\n\r\f>]++)?+)?+"""
# As browsers read it: a quote ends an attribute's value only where it began it; a value whose quote is never closed ends with the tag.
_TOKEN = re.compile(rf"<(?:!--(?:-?>|[\s\S]*?(?:--!?>|\Z))|(/?)([a-zA-Z][^ \t\n\r\f/>]*+)((?:[ \t\n\r\f/]++|{_ATTR})*+)(?:>|\Z)|(?:[!?]|/(?=[\s\S]))[^>]*+(?:>|\Z))")
_NAMED = re.compile(rf"""([^ \t\n\r\f/>=]++){_S}*+={_S}*+(?:"([^"]*+)"|'([^']*+)'|((?!["'])[^ \t\n\r\f>]++))|{_ATTR}""")
_PART = re.compile(r"[A-Za-z]+")


class Node:
    """A block element: tag, block children, and whether it is inside the article or out of the text (1: only by a form)."""

    __slots__ = ("tag", "kids", "out", "main", "number", "text", "shape", "size")

    def __init__(self, tag: str, out: int, main: bool, number: int):
        self.tag, self.out, self.main, self.number = tag, out, main, number
        self.kids: list[Node] = []
        self.text = ""
        self.shape, self.size = 0, 1


def _marked_out(tag: str, attrs: str, main: bool) -> int:
    if tag in NOT_TEXT:
        return 1 if tag == "form" else 2
    if "=" not in attrs or tag in ("html", "body", "main") or (tag == "article" and not main):
        return 0
    words = set()
    for m in _NAMED.finditer(attrs):
        name = (m[1] or "").lower()
        if name in ("class", "id", "role") and not (main and name == "id"):
            value = (m[2] or m[3] or m[4] or "").lower()
            words.update(value.split() if main else _PART.findall(value))
    return 2 if words & (NOT_NAMES if main else NOT_WORDS) and not words & {"with", "has", "no"} else 0


@lru_cache(maxsize=64)
def _ends(tag: str) -> re.Pattern:
    return re.compile(rf"<(/?){tag}(?=[ \t\n\r\f/>])[^>]*+(?:>|\Z)", re.I)


def _after(page: str, at: int, tag: str, never: set[str]) -> int:
    """Where the page goes on after an element without shown text that has begun; `at` itself where it never ends."""
    if tag in never:
        return at
    depth, last = 1, None
    for m in _ends(tag).finditer(page, at):
        if m[1]:
            depth, last = depth - 1, m.end()
            if depth == 0 or tag in RAW:
                return last
        elif tag not in RAW and not m[0].endswith("/>"):
            depth += 1
    if last is None:
        never.add(tag)
        return len(page) if tag in ("script", "style") else at
    return last


Block = tuple[Node, str, bool]


def parse(page: str) -> tuple[Node, list[Block]]:
    """The tree of block elements and the blocks of text in page order, each with its element and whether all of it is links.

    Inline elements only add their text; unclosed paragraphs, list items and cells end where the next begins. Each open
    block element is a frame with the inline elements open in it, so that the work grows with the page's length alone.
    """
    root = Node("#", 0, False, 0)
    nodes, blocks, run = [root], [], []
    # tag, element, open inline elements with what was out before them, how often each is open, whether text is out, list items and cells that an item or cell would end
    stack: list[list] = [["#", root, [], {}, 0, {}]]
    opened: Counter = Counter()
    never: set[str] = set()
    plain = False  # whether the run has a letter or digit outside of links

    def flush() -> None:
        nonlocal plain
        if run:
            text = " ".join("".join(run).split())
            run.clear()
            if text:
                node = stack[-1][1]
                node.text = f"{node.text} {text}" if node.text else text
                blocks.append((node, text, not plain))
            plain = False

    def close(depth: int) -> None:
        while len(stack) > depth:
            opened[stack.pop()[0]] -= 1

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        begin = m.start() if m else n
        if begin > at and not stack[-1][4]:
            text = page[at:begin]
            run.append(entities.unescape(text) if "&" in text else text)
            plain = plain or (not stack[-1][3].get("a") and any(map(str.isalnum, run[-1])))
        if not m:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag, attrs = tag.lower(), m[3]
        top = stack[-1]
        if m[1]:
            if tag in BLOCK:
                flush()
                if opened[tag]:
                    k = len(stack) - 1
                    while stack[k][0] != tag:
                        k -= 1
                    close(k)
            elif top[3].get(tag):
                while True:
                    name, top[4] = top[2].pop()
                    top[3][name] -= 1
                    if name == tag:
                        break
            continue
        if tag in RAW or tag in HIDDEN:
            if tag in RAW or attrs[-1:] != "/":
                at = _after(page, at, tag, never)
            run.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            run.append(" ")
            continue
        if tag in BLOCK:
            flush()
            if top[0] == "p" or (tag in HEADS and top[0] in HEADS):
                close(len(stack) - 1)
            if tag in CLOSES:
                depths = [stack[-1][5][t] for t in CLOSES[tag] if t in stack[-1][5]]
                if depths:
                    close(min(depths))
            top = stack[-1]
            parent = top[1]
            out = max(parent.out, top[4])
            if out == 1 and tag in MAIN:
                out = 0
            node = Node(tag, max(out, _marked_out(tag, attrs, parent.main)), parent.main or tag in MAIN, len(nodes))
            nodes.append(node)
            parent.kids.append(node)
            scope = {} if tag in HOLDS else {**top[5], tag: len(stack)} if tag in SCOPED else top[5]
            stack.append([tag, node, [], {}, 0, scope])
            opened[tag] += 1
        elif attrs[-1:] != "/":
            top[2].append((tag, top[4]))
            top[3][tag] = top[3].get(tag, 0) + 1
            top[4] = max(top[4], _marked_out(tag, attrs, top[1].main))
    flush()
    for node in reversed(nodes):
        node.shape = hash((node.tag, *(k.shape for k in node.kids)))
        node.size = 1 + sum(k.size for k in node.kids)
    return root, blocks


class Matcher:
    """Simple tree matching: the most pairs of nodes that keep tags, parents and the order of siblings.

    Equal subtrees at the ends of two lists of children match each other, which loses nothing; a table tells for those
    between. Where lists are too wide for a table of Python's numbers, or a page has used up PAGE_CELLS, the scores of all
    different subtrees of both pages are found from the leaves upwards, a row of numpy's numbers at a time (`cover`), and
    the same match is read back from rows (`wide`). Nothing here recurs, so that depth has no bound.
    """

    def __init__(self, table_cells: int = TABLE_CELLS, page_cells: int = PAGE_CELLS):
        self.memo: dict[tuple[int, int], int] = {}
        self.most, self.left = table_cells, page_cells
        self.roots: tuple[Node, Node] | None = None
        self.all: np.ndarray | None = None  # scores of different subtrees, by their numbers in `at`; the last column is 0
        self.at: tuple[dict[int, int], dict[int, int]] = {}, {}

    def known(self, a: Node, b: Node) -> int | None:
        if a.tag != b.tag:
            return 0
        if a.shape == b.shape:
            return a.size
        if not a.kids or not b.kids:
            return 1
        if self.all is not None and a.shape in self.at[0] and b.shape in self.at[1]:
            return int(self.all[self.at[0][a.shape], self.at[1][b.shape]])
        return self.memo.get((a.shape, b.shape))

    def cover(self) -> None:
        """The scores of all pairs of different subtrees of the roots, smaller subtrees first: one of the first page meets all of
        the second that have its tag and about as many children as each other at once."""
        trees = []
        for root in self.roots:
            found, todo = {}, [root]
            while todo:
                node = todo.pop()
                if node.shape not in found:
                    found[node.shape] = node
                    todo += node.kids
            trees.append(sorted(found.values(), key=lambda n: n.size))
        self.at = tuple({n.shape: k for k, n in enumerate(t)} for t in trees)
        xs, ys = trees
        groups: dict[str, dict[int, list[int]]] = {}
        for k, y in enumerate(ys):
            groups.setdefault(y.tag, {}).setdefault(len(y.kids).bit_length(), []).append(k)
        lists = {}
        for tag, widths in groups.items():
            for of in widths.values():
                kids = np.full((len(of), max(len(ys[k].kids) for k in of)), len(ys), np.int32)
                for i, k in enumerate(of):
                    kids[i, : len(ys[k].kids)] = [self.at[1][n.shape] for n in ys[k].kids]
                lists.setdefault(tag, []).append((np.array(of), kids))
        scores = np.zeros((len(xs), len(ys) + 1), np.int32)
        for i, x in enumerate(xs):
            own = [self.at[0][n.shape] for n in x.kids]
            for of, kids in lists.get(x.tag, ()):
                best = np.zeros((len(of), kids.shape[1] + 1), np.int32)
                for k in own if kids.shape[1] else ():
                    best[:, 1:] = np.maximum.accumulate(np.maximum(best[:, 1:], best[:, :-1] + scores[k][kids]), axis=1)
                scores[i, of] = 1 + best[:, -1]
        self.all = scores

    def wide(self, xs: list[Node], ys: list[Node]) -> list[tuple[Node, Node]]:
        """The match that a table of xs and ys gives, last pair first. Of the table's rows one in so many is kept, and those
        between are made again where the match passes."""
        own, kids = [self.at[0][x.shape] for x in xs], np.array([self.at[1][y.shape] for y in ys])
        step = math.isqrt(len(xs)) + 1

        def after(row: np.ndarray, k: int) -> np.ndarray:
            new = np.zeros_like(row)
            np.maximum.accumulate(np.maximum(row[1:], row[:-1] + self.all[own[k]][kids]), out=new[1:])
            return new

        kept, row = [], np.zeros(len(ys) + 1, np.int32)
        for k in range(len(xs)):
            if k % step == 0:
                kept.append(row)
            row = after(row, k)
        p, q, chosen = len(xs), len(ys), []
        while p and q:
            first = (p - 1) // step * step
            rows = [kept[first // step]]
            for k in range(first, p):
                rows.append(after(rows[-1], k))
            while p > first and q:
                if rows[p - first][q] == rows[p - first - 1][q]:
                    p -= 1
                elif rows[p - first][q] == rows[p - first][q - 1]:
                    q -= 1
                else:
                    p, q = p - 1, q - 1
                    chosen.append((xs[p], ys[q]))
        return chosen

    def parts(self, a: Node, b: Node) -> tuple[int, int, list[Node], list[Node]]:
        """How many first and last children are equal subtrees, and the lists of the children between."""
        x, y = a.kids, b.kids
        most = min(len(x), len(y))
        i = 0
        while i < most and x[i].shape == y[i].shape:
            i += 1
        j = 0
        while j < most - i and x[-1 - j].shape == y[-1 - j].shape:
            j += 1
        return i, j, x[i : len(x) - j], y[i : len(y) - j]

    def score(self, a: Node, b: Node) -> int:
        self.roots = self.roots or (a, b)
        todo = [(a, b)]
        while todo:
            x, y = todo[-1]
            if self.known(x, y) is not None:
                todo.pop()
                continue
            i, j, xs, ys = self.parts(x, y)
            if (cells := len(xs) * len(ys)) > min(self.most, self.left):
                self.cover()
                continue
            self.left -= cells
            if need := {(p.shape, q.shape): (p, q) for p in xs for q in ys if self.known(p, q) is None}:
                todo.extend(need.values())
                continue
            self.memo[x.shape, y.shape] = 1 + self.table(xs, ys)[-1][-1] + sum(k.size for k in x.kids[:i]) + sum(k.size for k in x.kids[len(x.kids) - j :])
            todo.pop()
        return self.known(a, b)

    def table(self, xs: list[Node], ys: list[Node]) -> list[list[int]]:
        """Row i, column j: the best match of the first i of xs and the first j of ys, whose scores are known."""
        rows = [[0] * (len(ys) + 1)]
        for x in xs:
            up, row, last = rows[-1], [0], 0
            for j, y in enumerate(ys):
                best = up[j + 1] if up[j + 1] > last else last
                if x.tag == y.tag:
                    both = up[j] + self.known(x, y)
                    if both > best:
                        best = both
                row.append(best)
                last = best
            rows.append(row)
        return rows

    def children(self, a: Node, b: Node) -> Iterator[tuple[Node, Node]]:
        i, j, xs, ys = self.parts(a, b)
        yield from zip(a.kids[:i], b.kids[:i], strict=True)
        if len(xs) * len(ys) > min(self.most, self.left):
            if self.all is None:
                self.cover()
            yield from reversed(self.wide(xs, ys))
        elif xs and ys:
            self.left -= len(xs) * len(ys)
            for x in xs:
                for y in ys:
                    if x.tag == y.tag:
                        self.score(x, y)
            t, p, q = self.table(xs, ys), len(xs), len(ys)
            chosen = []
            while p and q:
                if t[p][q] == t[p - 1][q]:
                    p -= 1
                elif t[p][q] == t[p][q - 1]:
                    q -= 1
                else:
                    p, q = p - 1, q - 1
                    chosen.append((xs[p], ys[q]))
            yield from reversed(chosen)
        yield from zip(a.kids[len(a.kids) - j :], b.kids[len(b.kids) - j :], strict=True)

    def pairs(self, a: Node, b: Node) -> Iterator[tuple[Node, Node]]:
        self.roots = self.roots or (a, b)
        todo = [(a, b)] if a.tag == b.tag else []
        while todo:
            x, y = todo.pop()
            yield x, y
            todo += zip(x.kids, y.kids, strict=True) if x.shape == y.shape else self.children(x, y) if x.kids and y.kids else ()


_seeds = ByteCache("html", lambda page: parse(page)[0], SEED_CHARS)


def _kept(blocks: list[Block]) -> list[Block]:
    """The blocks that may be of the article."""
    articles = any(n.main and not n.out for n, _, _ in blocks)
    return [b for b in blocks if not b[0].out and (b[0].main or not articles)]


def aligned(page: str, seed: str) -> tuple[list[tuple[int | None, int | None, str]], list[int]]:
    """The page's blocks that may be of the article, in page order, and the page's votes for what is template.

    A vote is a slot, the number of the seed's node to which an element is aligned: n for one whose text is equal, and
    -1 - n for one that holds two or more blocks outside of an article, all of them links. A block has the votes that
    would drop it, or null."""
    root, blocks = parse(page)
    slots, holder = {}, {}
    if seed:
        slots = {id(y): x for x, y in Matcher().pairs(_seeds[seed], root)}
        todo = [root]
        while todo:
            node = todo.pop()
            for k in node.kids:
                holder[id(k)] = slots[id(node)].number if id(node) in slots else holder.get(id(node))
            todo += node.kids
    out, held, linked = [], Counter(), Counter()
    for node, text, links in _kept(blocks):
        x, h = slots.get(id(node)), holder.get(id(node))
        out.append((x.number if x and x.text == node.text else None, -1 - h if links and not node.main and h is not None else None, text))
        if h is not None:
            held[h] += 1
            linked[h] += links and not node.main
    menus = {-1 - h for h, n in held.items() if n > 1 and linked[h] == n}
    return out, sorted({s for s, _, _ in out if s is not None} | menus)


def _hash(x: str) -> int:
    return xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63)


def outline(page: str) -> tuple[list[int], str, list[int], bool]:
    """(paths, digest, lines, main): hashes of the tree's different paths of tags, one hash of what may be the article's
    text, equal for copies, hashes of its blocks with their paths, and whether these are inside an article element. Blocks of
    links have one even hash, others an odd one for each PIECE characters."""
    root, blocks = parse(page)
    path, todo = {id(root): _hash(root.tag)}, [root]
    while todo:
        node = todo.pop()
        for k in node.kids:
            path[id(k)] = _hash(f"{path[id(node)]} {k.tag}")
            todo.append(k)
    kept = _kept(blocks)
    digest = xxhash.xxh3_128_hexdigest("\n".join(t for _, t, _ in kept).encode("utf-8", "surrogatepass"))
    return sorted(set(path.values())), digest, sorted({_hash(f"{path[id(n)]} {k} {t}") & ~1 | (not link) for n, t, link in kept for k in range(1 if link else 1 + (len(t) - 1) // PIECE)}), any(n.main for n, _, _ in kept)


def _leaders(shapes: pd.DataFrame) -> pd.DataFrame:
    """(_host, _layout, rank, own) of one host's leaders: of its most frequent shapes, in that order, those that are not like
    a leader before them. own has a leader's paths."""
    leaders: list[tuple[int, set, list]] = []
    for shape, paths in shapes.sort_values("r")[["_shape", "paths"]].itertuples(index=False):
        x = set(paths)
        if all(len(x & y) < SAME_LAYOUT * len(x | y) for _, y, _ in leaders):
            leaders.append((shape, x, paths))
    return pd.DataFrame({"_host": shapes["_host"].iloc[0], "_layout": [x[0] for x in leaders], "rank": range(len(leaders)), "own": [x[2] for x in leaders]})


def _layouts(shapes: DataFrame) -> DataFrame:
    """(_host, _shape, _layout, _counts) of shapes(_host, _shape, n, paths): a shape is of the layout of the leader that it is
    most like. The only page of a layout is aligned with the nearest leader's layout of several pages, without counting there.

    Leaders come in rounds: the LEADERS most frequent shapes of a host that are like no leader so far, less those like one
    before them, until every shape is like a leader. So a host has as many leaders as one pass over all of its shapes would
    find, and no task holds more than LEADERS shapes at once."""
    schema = "_host string, _layout long, rank int, own array<long>"
    like = F.size(F.array_intersect("paths", "own")) / F.size(F.array_union("paths", "own"))
    most_like = lambda s, l: s.join(l, "_host").groupBy("_host", "_shape").agg(F.max(F.struct(like.alias("like"), (-F.col("rank")).alias("first"), "_layout")).alias("b"))
    left, leaders, k = shapes, None, 0
    while True:
        top = left.withColumn("r", F.row_number().over(W.partitionBy("_host").orderBy(F.desc("n"), "_shape"))).where(F.col("r") <= LEADERS)
        new = stage(top.select("_host", "_shape", "r", "paths").groupBy("_host").applyInPandas(_leaders, schema).withColumn("rank", F.col("rank") + k * LEADERS), "leaders")
        leaders = new if leaders is None else leaders.unionByName(new)
        best = stage(most_like(left, new), "likest")
        unlike = best.where(F.col("b.like") < SAME_LAYOUT).select("_host", "_shape")
        if unlike.isEmpty():
            break
        left, k = stage(left.join(unlike, ["_host", "_shape"]), "unlike"), k + 1
    best = most_like(shapes, leaders) if k else best
    own = F.when(F.col("b.like") >= SAME_LAYOUT, F.col("b._layout")).otherwise(F.col("_shape"))
    of = stage(shapes.select("_host", "_shape", "n", "paths").join(best, ["_host", "_shape"]).select("_host", "_shape", "n", "paths", own.alias("_layout")), "of")
    pages = of.groupBy("_host", "_layout").agg(F.sum("n").alias("pages"))
    several = leaders.join(pages.where("pages > 1"), ["_host", "_layout"]).drop("pages")
    alone = of.join(pages.where("pages = 1"), ["_host", "_layout"]).select("_host", "_shape", "paths")
    near = alone.join(several, "_host").groupBy("_host", "_shape").agg(F.max(F.struct(like.alias("like"), (-F.col("rank")).alias("first"), "_layout"))["_layout"].alias("_near"))
    return of.select("_host", "_shape", "_layout").join(near, ["_host", "_shape"], "left").select("_host", "_shape", F.coalesce("_near", "_layout").alias("_layout"), F.col("_near").isNull().alias("_counts"))


def host_of(url: str) -> F.Column:
    return F.regexp_extract(F.lower(F.col(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)


def extract(pages: DataFrame, html: str = "html", url: str = "url", page_id: str = "page_id", min_share: float = MIN_SHARE) -> DataFrame:
    """pages (without html) with text and n_chars.

    A host's pages are parted into layouts by the paths of their trees. Each layout has a seed: of its pages the one with
    most of the lines that more than min_share of them repeat (then that of the smallest id), so that a page that lacks
    what the others share is not it. Each page's tree is aligned with the seed of its layout. A slot whose text more than
    min_share of the layout's other different pages repeat is template, whatever the size of the host, inside an article
    where at least MAIN_PAGES agree: pages with equal blocks of text are copies, which count once and so can't make their
    article template. Nor can near copies: a page of whose text other than links over a third (inside an article) or two thirds
    (without one) is on an eighth of the layout's pages is either one of many versions of a text or mostly template; all
    such pages count as one, and what they share stays. So is a slot outside of an article in which as many pages hold nothing but links. Slots that vary are content, less elements that are by name
    menus, headers, footers, sidebars, notices, adverts, forms or comments; where a page has an article or main element,
    content is what is inside. Counts are over all different pages and summed in tasks first, so that a host may hold any
    share of the rows. A null html is an empty text; a null url belongs to one host without a name; repeated page_ids are
    rows of their own. Columns of pages called text or n_chars are replaced, others of any name stay.
    """
    bound_batches(pages.sparkSession)
    keep, names = set_aside(pages, (html, url, page_id), ("text", "n_chars"))
    rest = [c for c in keep.columns if c != html]
    with_host = keep.withColumn("_host", F.coalesce(host_of(url), F.lit("")))
    kinds = {f.name: f.dataType.simpleString() for f in keep.schema}

    def outlined(columns: list[str], more: dict[str, pa.DataType], make):
        def run(batches) -> Iterator[pa.RecordBatch]:
            for b in small_batches(batches, html, cache="html"):
                made = [make(*outline(p or "")) for p in b.column(html).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), *(pa.array([m[k] for m in made], t) for k, t in enumerate(more.values()))], [*columns, *more])

        return run

    longs = pa.list_(pa.int64())
    filled = with_host.where(F.length(html) > 0).select("_host", F.coalesce(F.col(page_id).cast("long"), F.lit(-1)).alias("_id"), F.md5(html).alias("_page"), html)
    look = outlined(["_host", "_id", "_page"], {"_shape": pa.int64(), "_digest": pa.string(), "paths": longs, "lines": longs, "main": pa.bool_()}, lambda p, d, n, m: (_hash(str(p)), d, p, n, m))
    seen = filled.mapInArrow(look, "_host string, _id long, _page string, _shape long, _digest string, paths array<long>, lines array<long>, main boolean")
    once = stage(seen.groupBy("_host", "_shape", "_digest").agg(F.min(F.struct("_id", "_page", "paths", "lines", "main")).alias("p")), "outlines")

    # layouts and their seeds
    layouts = stage(_layouts(once.groupBy("_host", "_shape").agg(F.count("*").alias("n"), F.min("p.paths").alias("paths"))), "layouts")
    layouts = F.broadcast(layouts) if layouts.count() <= 200_000 else layouts
    each = once.join(layouts, ["_host", "_shape"]).where("_counts")
    of = ["_host", "_layout"]
    many = each.groupBy(*of).agg(F.count("*").alias("pages"))
    lines = each.select(*of, F.explode("p.lines").alias("line")).groupBy(*of, "line").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    over = lambda share: F.when(F.col("n") - 1 > share * (F.col("pages") - 1), F.col("line"))
    often = lines.join(many, of).where(over(min(SHARED, min_share)).isNotNull()).groupBy(*of).agg(F.collect_set(over(min_share)).alias("often"), F.collect_set(over(SHARED)).alias("shared"))
    often = stage(often, "often").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    among = lambda x, name: F.size(F.array_intersect(x, F.coalesce(name, F.array().cast("array<long>"))))
    text = F.filter("p.lines", lambda x: x.bitwiseAND(1) == 1)
    alike = among(text, "shared") > F.size(text) * F.when(F.col("p.main"), ALIKE_MAIN).otherwise(ALIKE)
    held = each.withColumn("salt", F.pmod(F.xxhash64("_digest"), F.lit(SALTS)).cast("int")).join(often, [*of, "salt"], "left")
    held = stage(held.select(*of, "salt", "_digest", "p._id", "p._page", among("p.lines", "often").alias("has"), alike.alias("_alike"), F.col("p.main").alias("_main")), "held")
    best = held.groupBy(*of, "salt").agg(F.min(F.struct((-F.col("has")).alias("less"), "_id", "_page")).alias("s"))
    first = best.groupBy(*of).agg(F.min("s").alias("s"))
    first = stage(first.select(*of, F.col("s._id").alias("_id"), F.col("s._page").alias("_page")), "firsts")
    seeds = filled.join(F.broadcast(first) if first.count() <= 200_000 else first, ["_host", "_id", "_page"])
    seeds = stage(seeds.groupBy(*of).agg(F.min(html).alias("_seed")), "seeds")
    size = seeds.agg(F.sum(F.octet_length("_seed"))).first()[0] or 0
    block = pa.list_(pa.struct([("same", pa.int32()), ("menu", pa.int32()), ("text", pa.string())]))
    told = ["_host", "_layout", "_counts", "_digest"]

    def align(batches) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, html, cache="html"):
            got = [aligned(p or "", seed or "") for p, seed in zip(b.column(html).to_pylist(), b.column("_seed").to_pylist(), strict=True)]
            rows = [[{"same": s, "menu": m, "text": t} for s, m, t in blocks] for blocks, _ in got]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (*rest, *told)), pa.array([v for _, v in got], pa.list_(pa.int32())), pa.array(rows, block)], [*rest, *told, "votes", "blocks"])

    mark = outlined([*keep.columns, "_host"], {"_shape": pa.int64(), "_digest": pa.string()}, lambda p, d, n, m: (_hash(str(p)), d))
    marked = with_host.mapInArrow(mark, "".join(f"`{c}` {k}, " for c, k in kinds.items()) + "_host string, _shape long, _digest string")
    joined = marked.join(layouts, ["_host", "_shape"], "left").join(F.broadcast(seeds) if size <= BROADCAST_BYTES else seeds, of, "left")
    typed = "".join(f"`{c}` {kinds[c]}, " for c in rest)
    got = stage(joined.mapInArrow(align, f"{typed}_host string, _layout long, _counts boolean, _digest string, votes array<int>, blocks array<struct<same:int,menu:int,text:string>>"), "blocks")
    copies = got.where("_counts").groupBy(*of, "_digest").agg(F.min("votes").alias("votes"))
    alike = held.groupBy(*of, "_digest").agg(F.bool_or("_alike").alias("_alike"), F.bool_or("_main").alias("_main"))
    one = F.when(F.col("_alike"), F.lit("")).otherwise(F.col("_digest")).alias("_one")
    copies = copies.join(alike, [*of, "_digest"], "left").groupBy(*of, one).agg(F.min("votes").alias("votes"), F.bool_or("_main").alias("_main"))
    n_pages = copies.groupBy(*of).agg(F.count("*").alias("pages"))
    votes = copies.select(*of, "_main", F.explode("votes").alias("vote")).groupBy(*of, "vote").agg(F.count("*").alias("n"), F.coalesce(F.bool_or("_main"), F.lit(False)).alias("_main"))
    enough = (F.col("n") - 1 > min_share * (F.col("pages") - 1)) & (~F.col("_main") | (F.col("n") >= MAIN_PAGES))
    template = votes.join(n_pages, of).where(enough).groupBy(*of).agg(F.collect_set("vote").alias("_template"))
    template = stage(template, "template")
    slots = template.agg(F.sum(F.size("_template"))).first()[0] or 0
    out = got.join(F.broadcast(template) if slots <= BROADCAST_SLOTS else template, of, "left")

    def content(batches) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "blocks", cache="html"):
            texts = []
            for blocks, gone in zip(b.column("blocks").to_pylist(), b.column("_template").to_pylist(), strict=True):
                gone = set(gone or ())
                texts.append(" ".join(x["text"] for x in blocks if x["same"] not in gone and x["menu"] not in gone))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(texts, pa.string())], [*rest, "text"])

    out = out.select(*rest, "blocks", "_template").mapInArrow(content, f"{typed}text string")
    return out.select(*rest, "text").toDF(*(names[c] for c in rest), "text").withColumn("n_chars", F.length("text").cast("long"))


def op7(spark, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
