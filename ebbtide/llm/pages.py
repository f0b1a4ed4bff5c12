"""HTML extraction by wrapper induction over the pages of a host."""

from __future__ import annotations

import html as _html
import json
import re
import sys
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import row_id, small_side, stage

#: Share of the pages with other articles, and their least number, that must repeat a text before it is template.
CONSTANT, LEAST = 0.8, 3
#: Share of a text inside links from which a block outside any article counts as a menu.
LINKS = 0.6

TOKEN = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*>|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
RAW = ("script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "math", "xmp")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: What an opening tag closes if it is open, up to the nearest container.
CLOSES = {**dict.fromkeys(BLOCKS - {"html", "body"}, ("p",)), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",)}
CONTAINERS = frozenset("article aside body button div dl fieldset footer form header html main nav ol section table ul blockquote".split())
DROPPED = frozenset("head script style noscript template iframe object canvas svg math nav footer aside header form button input select textarea dialog menu label title xmp".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar note".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs header masthead footer "
    "cookie cookies consent gdpr notice notices popup modal overlay subscribe subscription newsletter signup share sharing social related recommended recommendations comment comments reply replies "
    "respond disqus widget widgets toolbar pagination pager skip hidden login search copyright outbrain taboola paywall form".split()
)
#: An article below these is not the page's own: a reader's comment, a teaser, another article's part.
APART = frozenset("article aside nav footer".split())
READERS = frozenset("comment comments reply replies respond disqus related recommended teaser".split())
#: Elements that make the frame of a page; below an article, and in others, is content.
FRAME = frozenset("html body div main article section center".split())
#: Trees up to which those that pages are aligned with are broadcast; a tree has some tens of KB.
TREES = 1000
#: Parts over which the pages of a host with over a thousandth of all pages are dealt.
SALTS = 32
#: Code points of packed trees that a task keeps unpacked.
HELD = 1 << 23
#: Children times children up to which lists are aligned pair by pair; longer lists are aligned by arrays, with the same result.
PAIRS = 250_000
#: Numbers of an array while long lists are aligned.
CELLS = 1 << 21
#: Pairs of children of one shape from which arrays are worth their making.
FEW = 64


class Node:
    __slots__ = ("drop", "holds", "kids", "tag", "words")

    def __init__(self, tag: str, words: frozenset = frozenset(), drop: bool = False):
        self.tag, self.words, self.drop, self.kids, self.holds = tag, words, drop, [], False


def _attributes(raw: str) -> tuple[frozenset, bool]:
    """Words of class and id, and whether the element is hidden or has a role beside the article."""
    words, drop = [], False
    for name, value in ATTRIBUTE.findall(raw):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            words += re.split(r"[^a-z0-9]+", value)
        elif name == "role":
            drop |= value in ROLES
            words += ["role", value]
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            drop = True
    return frozenset(filter(None, words)), drop


def parse(text: str) -> Node:
    """Element tree of a page; text children are decoded strings. Broken and cut pages give the tree so far."""
    root = Node("#root")
    stack, at, n = [root], 0, len(text)
    while at < n:
        m = TOKEN.search(text, at)
        said = text[at : m.start() if m else n]
        if said:
            stack[-1].kids.append(_html.unescape(said) if "&" in said else said)
        if not m:
            break
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in CONTAINERS and tag not in CONTAINERS:
                    break
            continue
        for name in CLOSES.get(tag, ()):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == name:
                    del stack[k:]
                    break
                if stack[k].tag in CONTAINERS:
                    break
        words, drop = _attributes(m[3]) if m[3].strip(" /") else (frozenset(), False)
        node = Node(tag, words, drop)
        stack[-1].kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(text, at)
            at = end.end() if end else n
        elif tag not in VOID and not m[3].rstrip().endswith("/"):
            if (tag in ("article", "main") or "main" in words and "role" in words) and not any(up.tag in APART or up.words & READERS for up in stack) and not words & READERS:
                for up in stack:  # whatever its name, what holds the article is not beside it
                    up.holds = True
            stack.append(node)
    sys.setrecursionlimit(min((1 << 31) - 1, max(sys.getrecursionlimit(), 20 * n + 10_000)))  # a page nests no deeper than it is long; such calls take heap, not stack
    return root


def boilerplate(node: Node, inside: bool) -> bool:
    """By name, role or class: menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts."""
    if node.holds or node.tag in ("html", "body", "article", "main") and not node.drop and not node.words & WORDS:
        return False
    return node.drop or node.tag in DROPPED or bool(node.words & WORDS)


def _text(node: Node) -> str:
    """Own text of an element without its element children, as one line."""
    return " ".join(" ".join(k for k in node.kids if isinstance(k, str)).split())


def _tree(node: Node) -> tuple:
    """(tag, own text, children) of what is not boilerplate already, for alignment."""
    return (node.tag, _text(node), [_tree(k) for k in node.kids if not isinstance(k, str) and not boilerplate(k, True) and k.tag not in VOID])


def matching(a: tuple, b: tuple) -> tuple[int, list[tuple[tuple, tuple]]]:
    """Simple tree matching: size of the largest common top-down, in-order mapping, and the pairs mapped."""
    if a[0] != b[0]:
        return 0, []
    x, y = a[2], b[2]
    if len(x) * len(y) > PAIRS:
        size, at = _aligned(x, y)
        pairs = [(a, b)]
        for i, j in at:
            pairs += matching(x[i], y[j])[1]
        return size + 1 + (a[1] == b[1] != ""), pairs
    found = {}
    grid = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, p in enumerate(x):
        row, above = grid[i + 1], grid[i]
        for j, q in enumerate(y):
            w = 0
            if p[0] == q[0]:
                found[i, j] = got = matching(p, q)
                w = got[0]
            row[j + 1] = max(above[j + 1], row[j], above[j] + w)
    i, j, pairs = len(x), len(y), [(a, b)]
    while i and j:
        if grid[i][j] == grid[i - 1][j]:
            i -= 1
        elif grid[i][j] == grid[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs += found[i, j][1]
    return grid[-1][-1] + 1 + (a[1] == b[1] != ""), pairs


def _weights(x: Sequence, y: Sequence) -> np.ndarray:
    """Sizes of the mappings of every tree of one list with every one of another.

    Equal trees are taken once. Trees of one tag and number of children are mapped at once, with a step for every pair of places of their
    children; what few trees have in common is mapped one by one.
    """
    (x, all_x), (y, all_y) = _distinct(x), _distinct(y)
    out = np.zeros((len(x), len(y)), np.int32)
    left, right = _shapes(x), _shapes(y)
    for (tag, n), rows in left.items():
        for (other, m), cols in right.items():
            if tag != other:
                continue
            if n and m and len(rows) * len(cols) < FEW:
                for i in rows:
                    out[i, cols] = [matching(x[i], y[j])[0] for j in cols]
                continue
            said = {t: k for k, t in enumerate({*(x[i][1] for i in rows), *(y[j][1] for j in cols)})}
            mine, theirs = (np.array([said[t[1]] if t[1] else blank for t in side]) for side, blank in (([x[i] for i in rows], -1), ([y[j] for j in cols], -2)))
            step = max(1, CELLS // (len(cols) * (m + 1)))
            for at in range(0, len(rows), step):
                some = rows[at : at + step]
                above = [0] * (m + 1)
                for k in range(n if m else 0):
                    kids, row = [x[i][2][k] for i in some], [0]
                    for j in range(m):
                        row.append(np.maximum(np.maximum(above[j + 1], row[j]), above[j] + _weights(kids, [y[c][2][j] for c in cols])))
                    above = row
                out[np.ix_(some, cols)] = above[m] + 1 + (mine[at : at + step, None] == theirs[None, :])
    return out[np.ix_(all_x, all_y)]


def _distinct(trees: Sequence) -> tuple[list, list[int]]:
    """Trees that differ, and for every tree which of them it equals."""
    known: dict[str, int] = {}
    kept, which = [], []
    for t in trees:
        at = known.setdefault(pack(t) if t[2] else f"{t[0]} {t[1]}", len(kept))
        if at == len(kept):
            kept.append(t)
        which.append(at)
    return kept, which


def _shapes(trees: Sequence) -> dict[tuple[str, int], list[int]]:
    found: dict[tuple[str, int], list[int]] = {}
    for i, t in enumerate(trees):
        found.setdefault((t[0], len(t[2])), []).append(i)
    return found


def _aligned(x: Sequence, y: Sequence) -> tuple[int, list[tuple[int, int]]]:
    """Size of the largest in-order mapping of two long lists, and its pairs of places from the last to the first, those that ``matching`` takes.

    The grid is filled by rows of an array. Only a row of every block of rows is kept; the blocks on the way back are filled again.
    """
    step = max(1, CELLS // (len(y) + 1))

    def block(at: int, above: np.ndarray) -> np.ndarray:
        w = _weights(x[at : at + step], y)
        grid = np.empty((len(w) + 1, len(y) + 1), np.int32)
        grid[0] = above
        for i, row in enumerate(w):
            grid[i + 1, 0] = 0
            np.maximum.accumulate(np.maximum(grid[i, 1:], grid[i, :-1] + row), out=grid[i + 1, 1:])
        return grid

    starts = [np.zeros(len(y) + 1, np.int32)]
    for at in range(0, len(x), step):
        grid = block(at, starts[-1])
        starts.append(grid[-1].copy())
    size, j, pairs = int(starts[-1][-1]), len(y), []
    for k in range(len(starts) - 2, -1, -1):
        grid = grid if k == len(starts) - 2 else block(k * step, starts[k])
        i = len(grid) - 1
        while i and j:
            if grid[i, j] == grid[i - 1, j]:
                i -= 1
            elif grid[i, j] == grid[i, j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((k * step + i, j))
    return size, pairs


def frame(page: Node) -> str:
    """Layout of a page: hash of the distinct paths of the elements around its text, by name and words without digits."""
    paths: set[bytes] = set()
    todo = [(page, b"")]
    while todo:
        node, path = todo.pop()
        for k in node.kids:
            if isinstance(k, str) or boilerplate(k, True):
                continue
            step = path
            if k.tag in FRAME:
                step = xxhash.xxh64_digest(path + " ".join([k.tag, *sorted(w for w in k.words if w.isalpha())]).encode("utf-8", "surrogatepass"))
                paths.add(step)
            if k.tag != "article":
                todo.append((k, step))
    return xxhash.xxh64_hexdigest(b"".join(sorted(paths)))


def _places(tree: Sequence) -> dict[int, int]:
    """Place of every node in page order, by the identity of the node."""
    places: dict[int, int] = {}
    todo = [tree]
    while todo:
        t = todo.pop()
        places[id(t)] = len(places)
        todo += reversed(t[2])
    return places


def repeated(base: Sequence, places: dict[int, int], tree: Sequence) -> list[int] | None:
    """Places of the base's nodes whose text the aligned node repeats; None if it is the same article again."""
    spoken = [(a, b) for a, b in matching(base, tree)[1] if a[1]]
    same = [a for a, b in spoken if a[1] == b[1]]
    if len(same) * 2 > len(spoken) and sum(len(a[1]) for a in same) * 2 > sum(len(a[1]) for a, _ in spoken):
        return None
    return [places[id(a)] for a in same]


def constants(base: Sequence, places: dict[int, int], constant: set[int]) -> list | None:
    """The base cut down to its constant nodes and those above them."""

    def prune(t: Sequence) -> list | None:
        kids = [k for k in [prune(kid) for kid in t[2]] if k]
        keep = places[id(t)] in constant
        return [t[0], t[1] if keep else "", kids] if keep or kids else None

    return prune(base)


def learn(pages: list[str]) -> list | None:
    """Wrapper of the given pages: the tree of their constant nodes, None if there are none.

    The first page is aligned with each other one. A text is template if the aligned node repeats it in
    most of the pages whose text differs; pages that are copies of one article prove nothing.
    What varies is a slot, hence content.
    """
    trees = [_tree(parse(p)) for p in pages]
    if len(trees) <= LEAST:
        return None
    places = _places(trees[0])
    said = [v for v in (repeated(trees[0], places, t) for t in trees[1:]) if v is not None]
    if len(said) < LEAST:
        return None
    votes = Counter(chain.from_iterable(said))
    return constants(trees[0], places, {i for i, n in votes.items() if n >= CONSTANT * len(said)})


def _template(page: Node, wrapper: list) -> set[int]:
    """Nodes of a page whose text is template: aligned with a constant node of the wrapper and equal in text."""
    found: set[int] = set()
    nodes: dict[int, Node] = {}

    def tree(node: Node) -> tuple:
        t = (node.tag, _text(node), [tree(k) for k in node.kids if not isinstance(k, str) and not boilerplate(k, True) and k.tag not in VOID])
        nodes[id(t)] = node
        return t

    whole = tree(page)
    for a, b in matching(whole, wrapper)[1]:
        if b[1] and a[1] == b[1]:
            found.add(id(nodes[id(a)]))
    return found


def extract(text: str | None, *wrappers: list | None) -> str:
    """Main text of a page: blocks joined by line feeds, white space inside a block one space."""
    if not text:
        return ""
    page = parse(text)
    constant = set().union(*(_template(page, w) for w in wrappers if w))
    blocks: list[str] = []
    line: list[str] = []
    linked = [0, 0]  # code points of the block: all, inside links

    def flush(free: bool) -> None:
        said = " ".join("".join(line).split())
        if said and not (free and linked[1] >= LINKS * max(1, linked[0])):
            blocks.append(said)
        line.clear()
        linked[:] = [0, 0]

    def walk(node: Node, free: bool, link: bool) -> None:
        own = id(node) not in constant
        for k in node.kids:
            if isinstance(k, str):
                if own:
                    line.append(k)
                    size = len(k) - k.count(" ")
                    linked[0] += size
                    linked[1] += size * link
                continue
            if k.tag == "header" and not free and not k.words & WORDS:  # the head of an article: its headings
                for h in _headings(k):
                    flush(free)
                    walk(h, free, link)
                    flush(free)
                continue
            if boilerplate(k, not free):
                line.append(" ")
                continue
            if k.tag == "br":
                line.append(" ")
            elif k.tag in BLOCKS:
                flush(free)
                walk(k, free, link)
                flush(free)
            elif k.tag not in VOID:
                walk(k, free, link or k.tag == "a")

    roots = _roots(page)
    for root in roots or [page]:
        walk(root, not roots, False)
        flush(not roots)
    return "\n".join(blocks)


def _headings(node: Node) -> list[Node]:
    out = []
    for k in node.kids:
        if not isinstance(k, str):
            out += [k] if k.tag in HEADINGS else _headings(k)
    return out


def _roots(page: Node) -> list[Node]:
    """Outermost articles that are not boilerplate; else main parts."""
    articles, mains, todo, inner = [], [], [page], set()
    while todo:
        node = todo.pop()
        for k in reversed([k for k in node.kids if not isinstance(k, str)]):
            if boilerplate(k, False):
                continue
            if k.tag == "article":
                articles.append(k)
                continue
            if k.tag == "main" or ("role" in k.words and "main" in k.words):
                mains.append(k)
                inner |= {id(n) for n in _walk(k)}
            todo.append(k)
    order = {id(n): i for i, n in enumerate(_walk(page))}
    return sorted(articles, key=lambda n: order[id(n)]) or sorted((n for n in mains if id(n) not in inner), key=lambda n: order[id(n)])


def _walk(node: Node) -> Iterator[Node]:
    todo = [node]
    while todo:
        k = todo.pop()
        if k is not node:
            yield k
        todo += [kid for kid in reversed(k.kids) if not isinstance(kid, str)]


def pack(wrapper: Sequence) -> str:
    """A wrapper as JSON without nesting: tag, text and number of children of its nodes in page order."""
    flat, todo = [], [wrapper]
    while todo:
        tag, text, kids = todo.pop()
        flat.append((tag, text, len(kids)))
        todo += reversed(kids)
    return json.dumps(flat)


def unpack(packed: str) -> list:
    done: list[list] = []
    flat = json.loads(packed)
    sys.setrecursionlimit(min((1 << 31) - 1, max(sys.getrecursionlimit(), 20 * len(flat) + 10_000)))  # as in parse()
    for tag, text, n in reversed(flat):
        kids = [done.pop() for _ in range(n)]
        done.append([tag, text, kids])
    return done[0]


def _kept_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Layout and packed tree of every page."""
    for b in batches:
        layouts, trees = [], []
        for text in b.column("html").to_pylist():
            page = parse(text)
            layouts.append(frame(page))
            trees.append(pack(_tree(page)))
        yield pa.RecordBatch.from_arrays([b.column("_host"), b.column("_h"), pa.array(layouts, pa.string()), pa.array(trees, pa.string())], ["_host", "_h", "_layout", "tree"])


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of the base that a page repeats, null if it has the base's article."""
    known: dict[str, tuple] = {}
    held = 0
    for b in batches:
        votes = []
        for tree, base in zip(b.column("tree").to_pylist(), b.column("base").to_pylist(), strict=True):
            if base not in known:
                if held > HELD:
                    known, held = {}, 0
                made = unpack(base)
                known[base] = made, _places(made)
                held += len(base)
            votes.append(repeated(*known[base], unpack(tree)))
        yield pa.RecordBatch.from_arrays([b.column("_host"), b.column("_layout"), b.column("_h"), pa.array(votes, pa.list_(pa.int32()))], ["_host", "_layout", "_h", "votes"])


def _pruned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        made = []
        for base, places in zip(b.column("base").to_pylist(), b.column("places").to_pylist(), strict=True):
            tree = unpack(base)
            made.append(pack(constants(tree, _places(tree), set(places))))
        yield pa.RecordBatch.from_arrays([b.column("_host"), b.column("_layout"), pa.array(made, pa.string())], ["_host", "_layout", "wrapper"])


def _with_base(trees: DataFrame, bases: DataFrame) -> DataFrame:
    """Every page beside the base of its group. Many bases are shuffled, groups with very many pages over several tasks."""
    if bases.limit(TREES + 1).count() <= TREES:
        return trees.join(F.broadcast(bases.drop("_n")), ["_host", "_layout"])
    total = bases.agg(F.sum("_n")).first()[0]
    hot = F.broadcast(bases.filter(F.col("_n") > total / 1000).select("_host", "_layout", F.lit(True).alias("_hot")))  # fewer than 1,000 by their definition
    left = row_id(trees).join(hot, ["_host", "_layout"], "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64("_rid"), F.lit(SALTS))).otherwise(0).cast("int")).drop("_hot", "_rid")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = bases.drop("_n").join(hot, ["_host", "_layout"], "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return left.join(right, ["_host", "_layout", "_salt"]).drop("_salt")


def wrappers(pages: DataFrame) -> DataFrame:
    """(_host, _layout, wrapper as JSON) of the hosts, and of their layouts, that have constant nodes.

    All pages of a host that differ in their whole text take part, once as pages of the host (layout '') and, where it
    has several layouts, once among those of their own. The page with the least hash is the base of a group; every
    other is aligned with it where it lies and votes for the nodes it repeats, so no group is ever gathered.
    """
    pages = pages.filter("html is not null and _host <> ''").withColumn("_h", F.xxhash64("html")).select("_host", "_h", "html")
    trees = stage(pages.mapInArrow(_kept_trees, "_host string, _h long, _layout string, tree string"), "trees")
    layouts = trees.select("_host", "_layout", "_h").distinct().groupBy("_host", "_layout").agg(F.count(F.lit(1)).alias("_n"), F.min("_h").alias("_base"))
    layouts = stage(layouts, "layouts")
    hosts = layouts.groupBy("_host").agg(F.sum("_n").alias("_n"), F.min("_base").alias("_base"), F.count(F.lit(1)).alias("_of"))
    own = layouts.join(hosts.filter("_of > 1").select("_host"), "_host")
    groups = stage(hosts.select("_host", F.lit("").alias("_layout"), "_n", "_base").unionByName(own).filter(F.col("_n") > LEAST), "groups")
    at = groups.withColumnRenamed("_base", "_h")
    bases = trees.select("_host", "_h", "tree").join(small_side(at), ["_host", "_h"]).groupBy("_host", "_layout", "_n", F.col("_h").alias("_base")).agg(F.min("tree").alias("base"))
    bases = stage(bases, "bases")
    voters = trees.withColumn("_layout", F.explode(F.array(F.lit(""), "_layout")))
    others = _with_base(voters, bases).filter("_h <> _base").select("_host", "_layout", "_h", "tree", "base")
    votes = others.mapInArrow(_votes, "_host string, _layout string, _h long, votes array<int>").filter("votes is not null")
    votes = stage(votes.dropDuplicates(["_host", "_layout", "_h"]), "votes")
    asked = votes.groupBy("_host", "_layout").agg(F.count(F.lit(1)).alias("_asked")).filter(F.col("_asked") >= LEAST)
    nodes = votes.select("_host", "_layout", F.explode("votes").alias("place")).groupBy("_host", "_layout", "place").agg(F.count(F.lit(1)).alias("_said"))
    found = nodes.join(asked, ["_host", "_layout"]).filter(F.col("_said") >= CONSTANT * F.col("_asked"))
    found = found.groupBy("_host", "_layout").agg(F.collect_list("place").alias("places"))  # nodes of one page
    return bases.join(found, ["_host", "_layout"]).select("_host", "_layout", "base", "places").mapInArrow(_pruned, "_host string, _layout string, wrapper string")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    The article of the page: blocks in page order, without menus, headers, footers, sidebars, notices, adverts, forms,
    scripts, comments of readers, and without nodes that are constant over the pages of the host or of their layout. Pages
    without article or main element give the varying blocks of the body that are not mostly links.

    Null and empty pages, and pages without text, give an empty text; null urls have no host, hence no
    wrapper; repeated rows are pages of their own. An empty table gives no rows; other columns are not read.
    """
    host = F.regexp_extract(F.lower(F.coalesce("url", F.lit(""))), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    rows = pages.select("page_id", "url", "html", host.alias("_host"))
    known = stage(wrappers(rows), "wrappers")
    own = known.filter("_layout <> ''").withColumnRenamed("wrapper", "own")
    page_type = dict(pages.dtypes)["page_id"]

    def laid_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("_layout", pa.array([frame(parse(t or "")) for t in b.column("html").to_pylist()], pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[str, list] = {}
        for b in batches:
            texts = []
            for page, *packed in zip(*(b.column(c).to_pylist() for c in ("html", "wrapper", "own")), strict=True):
                for w in packed:
                    if w is not None and w not in made:
                        if len(made) > 1000:
                            made.clear()
                        made[w] = unpack(w)
                texts.append(extract(page, *(made.get(w) or (w and unpack(w)) for w in packed)))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    # a wrapper has some KB; hosts are few enough to broadcast up to the row bound, beyond it they are joined by shuffle
    joined = rows.join(small_side(known.filter("_layout = ''").select("_host", "wrapper"), 5_000), "_host", "left")
    if own.isEmpty():
        joined = joined.withColumn("own", F.lit(None).cast("string"))
    else:
        joined = joined.select("page_id", "url", "html", "_host", "wrapper").mapInArrow(laid_out, f"page_id {page_type}, url string, html string, _host string, wrapper string, _layout string")
        joined = joined.join(small_side(own, 5_000), ["_host", "_layout"], "left")
    return joined.select("page_id", "url", "html", "wrapper", "own").mapInArrow(run, f"page_id {page_type}, url string, text string, n_chars long")
