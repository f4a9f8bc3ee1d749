"""Operator 4: main text of web pages by wrapper induction.

For every host the pages of its most frequent layouts are references: those
whose trees are alike are merged to one tree that has the slots of all, others
stay apart; each further layout has its own page as reference.  Each page's DOM tree is aligned with the most alike of its host's
trees by simple tree matching (the largest order-preserving matching of
children with equal tags, top down).  Over all distinct pages aligned with a
tree, a slot that has one text in nearly all of them is template; slots whose
text varies are content.  Parts that HTML marks as no content (menus, footers,
forms, adverts, comments ...) go by their tags, roles and classes, and where a
page has an article or main element, only text within it counts.
"""

from __future__ import annotations

import hashlib
import math
import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import bounded, materialize, small_batches

# HTML element names, roles, and class words of page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noscript noembed noframes".split())
FURNITURE = frozenset("head nav footer aside form script style noscript template button select option textarea iframe svg canvas object dialog menu title".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Furniture that stands within a line and ends no block.
SILENT = frozenset("script style noscript template button select option textarea iframe svg canvas object".split())
SIBLINGS = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
SCOPES = frozenset("ul ol dl table body html article section div main".split())
ANYWHERE = (
    r"ad(?:s|box|slot|unit|sense)?\d*|advert\w*|gdpr\w*|sponsor\w*|promo\w*|banner\w*|cookie\w*|consent|popup|modal|overlay|comments?|disqus|repl(?:y|ies)|respond|"
    r"sidebar|widget\w*|menu\w*|nav|navbar|navigation|breadcrumbs?|pagination|pager|footer|share|sharing|social|related|recommended|"
    r"subscribe|newsletter|signup|login|notices?|disclaimer"
)
OUTSIDE = r"header|masthead|topbar|toolbar|search|alert|skip"
# Words in classes and ids of reader comments, and of other furniture, within an article or main element.
COMMENTS = frozenset("comment comments commentlist commenting disqus reply replies respond".split())
INSIDE = frozenset(
    "ad ads adbox adslot adunit adsense adsbygoogle advert adverts advertisement advertisements advertising sponsored sponsor promo promos promotion banner cookie cookies consent gdpr "
    "notice notices disclaimer popup modal overlay sidebar widget nav navbar navigation menu breadcrumb breadcrumbs pagination pager share sharing social related recommended "
    "newsletter subscribe signup login".split()
)
# Words that may stand beside these in one name; any other word (social-history, comments-open) makes it another thing.
BESIDE = frozenset(
    "area articles bar block body bottom box boxes button buttons container content count counter feed footer form google head header icon icons inline inner item items label left "
    "link links list main media message outer panel post posts reader readers right row section slot stories story text thread title top unit user users wrap wrapper".split()
)
#: A part that holds more of the main text than this is no furniture, whatever it is called, but for comments.
MOST = 0.5

_TOKEN = re.compile(
    r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*)(?:>|\Z))", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:$|[\s/=])")
#: What makes a tag close itself: a slash that is not the end of an unquoted value.
_CLOSED = re.compile(r"(?:^|[\s\"'])/\Z")
_WORDS = {k: re.compile(rf"(?:^|[\s_-])(?:{v})(?:$|[\s_-])", re.I) for k, v in (("any", ANYWHERE), ("out", OUTSIDE))}
#: Children left on either side, multiplied, beyond which the same table is filled by array arithmetic, some rows at a time.
WIDE = 4_000
#: A text is template if so large a part of at least so many aligned pages have it.
CONSTANT, PAGES = 0.9, 3
#: Layouts of a host that share its trees, others have a tree of their own; the depth to which tags tell layouts apart, and the likeness from which trees are merged.
LAYOUTS, OUTLINE, ALIKE = 8, 4, 0.6
#: Parts of a host's layouts that are ranked on their own first.
RANKED = 64


class Node:
    """An element, or a text (tag ``#``)."""

    __slots__ = ("tag", "text", "marks", "children", "shape", "number", "size")

    def __init__(self, tag: str, text: str = "", marks: str = ""):
        self.tag, self.text, self.marks = tag, text, marks
        self.children: list[Node] = []
        self.shape = 0
        self.number = -1
        self.size = 1


def parse(html: str) -> Node:
    """The tree of a page; unclosed and stray tags are borne as browsers do."""
    root = Node("#root")
    path = [root]
    opened: dict[str, int] = {}
    at = 0
    lower = None

    def leave(i: int) -> None:
        for node in path[i:]:
            opened[node.tag] -= 1
        del path[i:]

    for_ever = _TOKEN.search
    while True:
        m = for_ever(html, at)
        text = html[at : m.start() if m else len(html)]
        if text and not text.isspace():
            path[-1].children.append(Node("#", " ".join((unescape(text) if "&" in text else text).split()), "s" * text[0].isspace() + "e" * text[-1].isspace()))
        elif text:
            path[-1].children.append(Node("#", "", "se"))
        if not m:
            break
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            for i in range(len(path) - 1, 0, -1) if opened.get(tag) else ():
                if path[i].tag == tag:
                    leave(i)
                    break
            continue
        if tag in CLOSES_P:
            for i in range(len(path) - 1, 0, -1) if opened.get("p") else ():
                if path[i].tag == "p":
                    leave(i)
                    break
                if path[i].tag not in INLINE:
                    break
        elif tag in SIBLINGS:
            closes = SIBLINGS[tag].split()
            for i in range(len(path) - 1, 0, -1):
                if path[i].tag in closes:
                    leave(i)
                    break
                if path[i].tag in SCOPES:
                    break
        node = Node(tag, "", m[3])
        path[-1].children.append(node)
        if tag in RAW:
            lower = lower or html.lower()
            end = lower.find("</" + tag, at)
            at = len(html) if end < 0 else end
        elif tag not in VOID and not _CLOSED.search(m[3]):
            path.append(node)
            opened[tag] = opened.get(tag, 0) + 1
    _shapes(root)
    return root


def _shapes(root: Node, base: int = 0) -> None:
    """Numbers nodes in page order from a base on and gives equal subtrees, texts aside, equal shapes."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        node.number = base + len(order)
        order.append(node)
        todo.extend(reversed(node.children))
    for node in reversed(order):
        node.shape = hash((node.tag, tuple([c.shape for c in node.children])))
        node.size = 1 + sum([c.size for c in node.children])


def _middle(a: list[Node], b: list[Node]) -> tuple[int, int, int]:
    """How many children of equal shape stand at the head, and where each side's tail of such begins."""
    i, m, n = 0, len(a), len(b)
    while i < m and i < n and a[i].shape == b[i].shape:
        i += 1
    while m > i and n > i and a[m - 1].shape == b[n - 1].shape:
        m, n = m - 1, n - 1
    return i, m, n


def _pair(a: list[Node], b: list[Node], memo: dict) -> list[tuple[Node, Node]]:
    """Which children are matched: head and tail of equal shape first, which loses nothing, then by tables."""
    i, m, n = _middle(a, b)
    out = [*zip(a[:i], b[:i]), *zip(a[m:], b[n:])]
    a, b = a[i:m], b[i:n]
    if not a or not b:
        return out
    if len(a) * len(b) > WIDE:
        return out + _pair_wide(a, b, memo)
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for x in range(len(a) - 1, -1, -1):
        row, below = table[x], table[x + 1]
        for y in range(len(b) - 1, -1, -1):
            best = below[y] if below[y] > row[y + 1] else row[y + 1]
            if a[x].tag == b[y].tag:
                best = max(best, below[y + 1] + memo[a[x].shape, b[y].shape])
            row[y] = best
    x = y = 0
    while x < len(a) and y < len(b):
        if table[x][y] == table[x + 1][y]:
            x += 1
        elif table[x][y] == table[x][y + 1]:
            y += 1
        else:
            out.append((a[x], b[y]))
            x, y = x + 1, y + 1
    return out


def _pair_wide(a: list[Node], b: list[Node], memo: dict) -> list[tuple[Node, Node]]:
    """The pairs that the whole table gives, with about a square root of its rows held at once."""
    kinds = {q.shape: q for q in b}
    place = {shape: i for i, shape in enumerate(kinds)}
    index = np.array([place[q.shape] for q in b])
    gains: dict[int, np.ndarray] = {}

    def above(below: np.ndarray, p: Node) -> np.ndarray:
        if p.shape not in gains:
            gains[p.shape] = np.array([memo[p.shape, shape] if p.tag == q.tag else 0 for shape, q in kinds.items()])
        best = np.maximum(below[:-1], below[1:] + gains[p.shape][index])
        return np.append(np.maximum.accumulate(best[::-1])[::-1], 0)

    step = math.isqrt(len(a)) + 1
    row, kept = np.zeros(len(b) + 1, np.int64), {}
    for x in range(len(a), 0, -1):
        if x % step == 0 or x == len(a):
            kept[x] = row
        row = above(row, a[x - 1])
    out, x, y = [], 0, 0
    for start in range(0, len(a), step):
        stop = min(start + step, len(a))
        table = [kept.pop(stop)]
        for p in reversed(a[start:stop]):
            table.append(above(table[-1], p))
        table.reverse()
        while x < stop and y < len(b):
            here, below = table[x - start], table[x - start + 1]
            if here[y] == below[y]:
                x += 1
            elif here[y] == here[y + 1]:
                y += 1
            else:
                out.append((a[x], b[y]))
                x, y = x + 1, y + 1
    return out


def _size(node: Node) -> int:
    return node.size


def _score(a: Node, b: Node, memo: dict) -> int:
    """Nodes of the largest matching of two trees whose roots have one tag; ``memo`` gets those of all pairs below by shapes."""
    order, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        key = (x.shape, y.shape)
        if key in memo:
            continue
        memo[key] = x.size
        if x.shape == y.shape:
            continue
        order.append((x, y))
        i, m, n = _middle(x.children, y.children)
        right = {q.shape: q for q in y.children[i:n]}.values()
        todo.extend((p, q) for p in {p.shape: p for p in x.children[i:m]}.values() for q in right if p.tag == q.tag)
    # a pair is met before what only it needs, but shared ones may be met early: lower trees first
    order.sort(key=lambda pair: pair[0].size)
    for x, y in order:
        memo[x.shape, y.shape] = 1 + sum([p.size if p.shape == q.shape else memo[p.shape, q.shape] for p, q in _pair(x.children, y.children, memo)])
    return memo[a.shape, b.shape]


def align(page: Node, reference: Node, memo: dict | None = None) -> dict[int, Node]:
    """Reference node of each matched page node, by simple tree matching."""
    memo = {} if memo is None else memo
    out, todo = {}, [(page, reference)]
    _score(page, reference, memo)
    while todo:
        a, b = todo.pop()
        out[a.number] = b
        todo.extend(zip(a.children, b.children) if a.shape == b.shape else _pair(a.children, b.children, memo))
    return out


def outline(page: Node) -> int:
    """A hash of which tags stand on which paths near the root, however often."""
    paths, todo = set(), [(page, "", 0)]
    while todo:
        node, path, depth = todo.pop()
        for child in node.children:
            if child.tag != "#" and child.tag not in INLINE:
                paths.add(below := f"{path}/{child.tag}")
                if depth + 1 < OUTLINE:
                    todo.append((child, below, depth + 1))
    return int.from_bytes(hashlib.blake2b(" ".join(sorted(paths)).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def nearest(page: Node, trees: list[Node]) -> tuple[float, Node, dict]:
    """The tree most alike to a page, the first among equals: likeness, tree and its scores."""
    best = None
    for tree in trees:
        memo: dict = {}
        alike = 2 * _score(page, tree, memo) / (page.size + tree.size)
        if best is None or alike > best[0]:
            best = alike, tree, memo
    return best


def grow(tree: Node, page: Node) -> None:
    """Adds the page's unmatched nodes to the tree, each after what it follows in the page."""
    found = align(page, tree)
    todo = [page]
    while todo:
        node = todo.pop()
        slots = found[node.number].children
        at = {id(slot): i for i, slot in enumerate(slots)}
        after: dict[int, list[Node]] = {}
        last = -1
        for child in node.children:
            if child.number in found:
                last = at[id(found[child.number])]
                todo.append(child)
            else:
                after.setdefault(last, []).append(child)
        if after:
            slots[:] = [*after.get(-1, ()), *(x for i, slot in enumerate(slots) for x in (slot, *after.get(i, ())))]
    _shapes(tree)


def induce(references: list[str]) -> list[Node]:
    """The trees of a host's references, alike ones merged; all their nodes have numbers of their own."""
    trees: list[Node] = []
    for html in references:
        page = parse(html)
        if trees and (found := nearest(page, trees))[0] >= ALIKE:
            grow(found[1], page)
        else:
            trees.append(page)
    trees = trees or [parse("")]
    base = 0
    for tree in trees:
        _shapes(tree, base)
        base += tree.size
    return trees


def _letters(node: Node) -> int:
    """Characters of all text below a node that is no script or style."""
    total, todo = 0, [node]
    while todo:
        x = todo.pop()
        total += len(x.text)
        todo.extend(c for c in x.children if c.tag not in RAW)
    return total


def _named(names: str, words: frozenset[str]) -> bool:
    """Whether one of the names is made of these words, and of such that may stand beside them."""
    for name in names.lower().split():
        told = {w for w in re.split(r"[^a-z0-9]+", re.sub(r"\d+$", "", name)) if w}
        if not words.isdisjoint(told) and told <= COMMENTS | INSIDE | BESIDE:
            return True
    return False


def _furniture(node: Node, within: bool, main: int = 0) -> bool:
    """Whether a node is none of the text; ``main`` is how many characters the article or main element around it has."""
    if node.tag in FURNITURE or node.tag == "header" and not within:
        return True
    if not node.marks:
        return False
    if "hidden" in node.marks and _HIDDEN.search(_ATTRIBUTE.sub(lambda m: m[0] if m[1] == "hidden" and (m[2] or m[3] or m[4]) != "until-found" else " ", node.marks)):
        return True
    if "=" not in node.marks:
        return False
    marks = {k.lower(): x or y or z for k, x, y, z in _ATTRIBUTE.findall(node.marks)}
    if marks.get("role", "").lower() in ROLES or marks.get("aria-hidden") == "true" or "display:none" in marks.get("style", "").replace(" ", ""):
        return True
    if within:
        if _named(f"{marks.get('class', '')} {marks.get('id', '')}", COMMENTS):
            return True
        return _named(marks.get("class", ""), INSIDE) and _letters(node) <= MOST * main
    named = f"{marks.get('class', '')} {marks.get('id', '')}"
    return any(bool(words.search(named)) for words in _WORDS.values())


def _main_rank(node: Node) -> int:
    """2 for an article, 1 for a main element, else 0."""
    if node.tag == "article":
        return 2
    return int(node.tag == "main" or "role" in node.marks and bool(re.search(r"role\s*=\s*[\"']?main", node.marks)))


def blocks(page: Node, aligned: dict[int, Node]) -> list[tuple[str, int]]:
    """The page's candidate blocks: text, and reference node of its first text, -1 where none or no template may take it.

    Of a page with articles and with a main element, the articles count unless
    the main element has more text of its own: then they are teasers.
    """
    out: list[tuple[str, int, int]] = []
    parts: list[Node] = []
    ranks = {0}

    def close(within: int) -> None:
        texts = [p for p in parts if p.text]
        if texts:
            # white space between two parts counts wherever it stands
            text, gap = "", False
            for p in parts:
                text += " " * (bool(text) and bool(p.text) and (gap or "s" in p.marks)) + p.text
                gap = "e" in p.marks or gap and not p.text
            first = aligned.get(texts[0].number)
            out.append((text, -1 if first is None or within else first.number, within))
        parts.clear()

    # each open element: its children that are left, the rank within which it stands and its characters; a block one is closed at its end
    todo = [(iter(page.children), 0, 0, False)]
    while todo:
        children, within, main, block = todo[-1]
        child = next(children, None)
        if child is None:
            todo.pop()
            if block:
                close(within)
        elif child.tag == "#":
            parts.append(child)
        elif child.tag == "br":
            close(within)
        elif _furniture(child, within > 0, main):
            if child.tag not in INLINE and child.tag not in SILENT:
                close(within)
        elif child.tag in INLINE:
            todo.append((iter(child.children), within, main, False))
        else:
            close(within)
            inner = max(within, _main_rank(child))
            ranks.add(inner)
            todo.append((iter(child.children), inner, _letters(child) if inner > within else main, True))
    close(0)
    size = [sum(len(t) for t, _, rank in out if rank == r) for r in (0, 1, 2)]
    chosen = 0 if ranks == {0} else 1 if size[1] > size[2] or 2 not in ranks else 2
    return [(t, n) for t, n, rank in out if rank == chosen]


def _host(url):
    return F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1), F.lit(""))


#: Bytes of all reference pages up to which they go to every executor.
BROADCAST = 32 << 20


def _references(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(host, layout, references), layout 0 for the trees that a host's frequent outlines share; and (host, key, layout) of the pages with a tree of their own.

    A reference is the shortest page of its outline.  An outline that is not
    among its host's frequent ones has a tree of its own if it has as many
    pages as a template needs; no empty pages are looked at.
    """

    def run(batches):
        for batch in batches:
            found = [outline(parse(html)) for html in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("host", "key", "n")), pa.array(found, pa.int64())], names=["host", "key", "n", "outline"])

    filled = rows.filter("length(html) > 0").withColumns({"key": F.xxhash64("html"), "n": F.length("html")})
    outlines = materialize(filled.select("host", "key", "n", "html").mapInArrow(run, "host string, key long, n int, outline long").distinct(), "outlines")
    layouts = materialize(outlines.groupBy("host", "outline").agg(F.count("*").alias("pages"), F.min(F.struct("n", "key")).alias("least")), "layouts")
    # a host may have many outlines: its best are found among the best of parts of them
    best = layouts.withColumn("part", F.pmod("outline", F.lit(RANKED)))
    for keys in (("host", "part"), ("host",)):
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("pages"), "outline"))).filter(F.col("rank") <= LAYOUTS)
    best = materialize(best.drop("part"), "frequent")
    own = layouts.filter(F.col("pages") >= PAGES).join(bounded(best.select("host", "outline")), ["host", "outline"], "left_anti")
    own = materialize(own.withColumn("layout", F.when(F.col("outline") == 0, F.lit(1)).otherwise(F.col("outline"))), "own")
    shared = best.select("host", F.lit(0).cast("long").alias("layout"), "rank", F.col("least.key").alias("key"))
    chosen = materialize(shared.union(own.select("host", "layout", F.lit(1), "least.key")), "chosen").withColumnsRenamed({"host": "_host", "key": "_key"})
    found = filled.join(bounded(chosen), (F.col("host") == F.col("_host")) & (F.col("key") == F.col("_key"))).groupBy("host", "layout", "rank").agg(F.min("html").alias("html"))
    found = found.groupBy("host", "layout").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "html"))), lambda r: r["html"]).alias("references"))
    apart = outlines.join(bounded(own.select("host", "outline", "layout")), ["host", "outline"]).select("host", "key", "layout")
    return found, apart


def main_text(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    ``pages`` has page_id, url and html; other columns are ignored.  Blocks are
    joined by one line feed, white space within a block is one space, and
    character references are decoded.  A null, empty or markup-only page has
    the empty text; pages without a host share the empty host; repeated rows
    give repeated results; an empty table gives an empty one.
    """
    small_batches(pages.sparkSession)
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), _host(F.col("url")).alias("host"))
    refs, apart = _references(rows)
    refs, apart = bounded(materialize(refs, "references"), BROADCAST), materialize(apart, "apart")
    rows = rows.withColumn("copy", F.xxhash64("html"))
    if apart.limit(1).count():
        apart = bounded(apart.select(F.col("host").alias("_host"), F.col("key").alias("_key"), "layout"))
        rows = rows.join(apart, (F.col("host") == F.col("_host")) & (F.col("copy") == F.col("_key")), "left").drop("_host", "_key").withColumn("layout", F.coalesce("layout", F.lit(0).cast("long")))
    else:
        rows = rows.withColumn("layout", F.lit(0).cast("long"))
    rows = rows.join(refs, ["host", "layout"], "left")

    def run(batches):
        kept: dict[tuple[str, int], list[Node]] = {}
        for batch in batches:
            found = []
            references = batch.column("references")
            for i, (html, *key) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("html", "host", "layout")))):
                key = tuple(key)
                if key not in kept:
                    if len(kept) > 200:
                        kept.clear()
                    kept[key] = induce(references[i].as_py() or [])
                page = parse(html)
                _, tree, memo = nearest(page, kept[key])
                found.append([{"t": t, "n": n} for t, n in blocks(page, align(page, tree, memo))])
            kind = pa.list_(pa.struct([("t", pa.string()), ("n", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "url", "host", "layout", "copy")), pa.array(found, kind)], names=["page_id", "url", "host", "layout", "copy", "blocks"])

    ids = rows.schema["page_id"].dataType.simpleString()
    schema = f"page_id {ids}, url string, host string, layout long, copy long, blocks array<struct<t: string, n: int>>"
    cut = materialize(rows.mapInArrow(run, schema), "blocks")
    # copies of a page say nothing about its host's template: each distinct page counts once
    seen = cut.select("host", "layout", "copy", F.explode("blocks").alias("b")).filter("b.n >= 0").select("host", "layout", "copy", "b.n", F.xxhash64("b.t").alias("t")).distinct()
    said = seen.groupBy("host", "layout", "n", "t").agg(F.count("*").alias("same"))
    template = said.groupBy("host", "layout", "n").agg(F.sum("same").alias("pages"), F.max(F.struct("same", "t")).alias("most"))
    template = template.filter((F.col("pages") >= PAGES) & (F.col("most.same") >= CONSTANT * F.col("pages")))
    template = materialize(template.groupBy("host", "layout").agg(F.collect_list(F.struct("n", F.col("most.t").alias("t"))).alias("constant")), "template")
    cut = cut.join(bounded(template), ["host", "layout"], "left")
    constant = F.coalesce("constant", F.array().cast("array<struct<n: int, t: bigint>>"))
    content = F.filter("blocks", lambda b: ~F.array_contains(constant, F.struct(b["n"].alias("n"), F.xxhash64(b["t"]).alias("t"))))
    text = F.array_join(F.transform(content, lambda b: b["t"]), "\n")
    return cut.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op4_html_extraction(spark, sf_dir: str) -> DataFrame:
    """Main text of all ``pages``."""
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
