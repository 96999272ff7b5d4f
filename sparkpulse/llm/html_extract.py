"""Main text of web pages by wrapper induction.

Each page's tree of blocks becomes an outline, in which like neighbours are one node. A host's template is its most
frequent outline; simple tree matching aligns the host's other outlines with it, so that slots of all its pages share
the template's nodes. Over all pages, those of one main text once, each node is judged by how its texts behave: nodes
whose texts stay the same, or are links, belong to the template; varying slots are content. What varies from page to
page isn't always main text (adverts, comments), so kinds of nodes, by tag and class, are left out as well, and an
article bounds the content where a page has one. Texts that stay the same at one place of a host, of one of its
layouts or of a section of a layout are dropped from slots outside articles that vary otherwise.
"""

from __future__ import annotations

import html as entities
import json
import math
import re
import zlib
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Least pages of different main text of a host, layout or section, and the share of them on which a text must stay the same.
LEAST_PAGES = 4
CONSTANT_SHARE = 0.8
#: Share of a node's words in links from which it is a menu.
LINKED_SHARE = 0.8
#: Scores of pairs of subtrees, and of one subtree with all of a level, that are remembered while two trees are matched.
SCORES, GAINS = 1_000_000, 64
#: Rows of decisions, of about 200 bytes each, that are sent to all executors; more of them are joined by shuffles.
BROADCAST_ROWS = 200_000
#: Trees are kept flat below this depth.
DEPTH = 200
TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<(script|style|noscript|template|textarea|title)\b[^>]*>.*?(?:</\1\s*>|$)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>|[^<]+|<", re.S | re.I)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: An opening tag of the key ends open elements of these kinds.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ENDS_P = BLOCK - {"br", "body", "html", "head", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt", "summary", "figcaption"}
#: What isn't main text, by tag, and by words of class, id and role.
DROPPED_TAGS = frozenset("nav footer aside form head button select svg iframe object dialog label input".split())
DROPPED_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside ad ads advert adverts advertisement "
    "banner sponsor sponsored promo promotion cookie cookies consent notice notices alert popup modal overlay newsletter subscribe "
    "signup login social share sharing related recommended comment comments reply replies disqus widget toolbar pagination".split())


class Node:
    __slots__ = ("tag", "label", "words", "children", "text")

    def __init__(self, tag: str, words: frozenset = frozenset(), text: str = ""):
        self.tag, self.words, self.text, self.children = tag, words, text, []
        self.label = ".".join([tag, *sorted(words)]) if words else tag


def parse(page: str) -> Node:
    """The page's tree; broken markup is mended as it comes: nothing is ever lost but markup."""
    root = Node("html")
    path = [root]
    for m in TOKEN.finditer(page):
        name = m[3]
        if name is None:
            s = m[0]
            if s[0] != "<" or s == "<":
                path[-1].children.append(Node("#", text=s))
            continue
        tag = name.lower()
        if m[2]:
            if tag == "p" and not any(n.tag == "p" for n in path):
                continue
            for k in range(len(path) - 1, 0, -1):
                if path[k].tag == tag:
                    del path[k:]
                    break
            continue
        if tag in ENDS_P:
            _close(path, ("p",), "article section div main body table td li blockquote".split())
        if tag in ENDS:
            _close(path, ENDS[tag], "ul ol dl table select".split())
        words = frozenset()
        if m[4]:
            found = ATTRIBUTE.findall(m[4])
            if found:
                words = frozenset(w for a in found for w in re.split(r"[\s_-]+", (a[1] or a[2] or a[3]).lower()) if w)
        node = Node(tag, words)
        path[-1].children.append(node)
        if tag not in VOID and not m[4].rstrip().endswith("/") and len(path) < DEPTH:
            path.append(node)
    return root


def _close(path: list[Node], tags, stops) -> None:
    for k in range(len(path) - 1, 0, -1):
        if path[k].tag in tags:
            del path[k:]
            return
        if path[k].tag in stops:
            return


def squeezed(text: str) -> str:
    return " ".join(entities.unescape(text).split())


def fact(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "replace"))


def simple_tree_matching(a: list, b: list) -> tuple[int, list]:
    """Score and aligned pairs of nodes of two trees [label, children].

    As in the classic algorithm, roots must be alike and children match in order, by dynamic programming. Subtrees of
    one shape are scored once, a row of scores at a time; of the rows every sqrt(n)-th is kept and those between are
    made again on the way back, so that wide trees need little memory.
    """
    numbers: dict[tuple, int] = {}
    labels, children, sizes, shape = [], [], [], {}

    def look(node: list) -> int:
        below = [look(c) for c in node[1]]
        k = shape[id(node)] = numbers.setdefault((node[0], *below), len(numbers))
        if k == len(labels):
            labels.append(node[0])
            children.append(below)
            sizes.append(1 + sum(sizes[c] for c in below))
        return k

    scores: dict[tuple[int, int], int] = {}

    def score(p: int, q: int) -> int:
        if labels[p] != labels[q]:
            return 0
        if p == q:
            return sizes[p]
        if not children[p] or not children[q]:
            return 1
        if (p, q) not in scores:
            if len(scores) >= SCORES:
                scores.clear()
            for row in rows(p, q):  # noqa: B007  the last one counts
                pass
            scores[p, q] = 1 + int(row[-1])
        return scores[p, q]

    def rows(p: int, q: int, start: int = 0, above=None):
        """The best scores of p's children up to each one, from ``start`` on, with each number of q's first children."""
        if len(children[q]) < 32:  # plain numbers are quicker than short arrays
            above = [0] * (len(children[q]) + 1) if above is None else above
            for c in children[p][start:]:
                row = [0]
                for j, k in enumerate(children[q]):
                    row.append(max(above[j + 1], row[j], above[j] + score(c, k)))
                above = row
                yield above
            return
        kinds, where = np.unique(children[q], return_inverse=True)
        above = np.array([0] * (len(where) + 1) if above is None else above)
        gains: dict = {}
        for c in children[p][start:]:
            gain = gains.get(c)
            if gain is None:
                gain = np.array([score(c, k) for k in kinds.tolist()], np.int64)[where]
                if len(gains) < GAINS:
                    gains[c] = gain
            above = np.maximum.accumulate(np.maximum(above, np.concatenate([[0], above[:-1] + gain])))
            yield above

    def matches(p: int, q: int) -> list[tuple[int, int]]:
        """Which children match, the last first."""
        i, j = len(children[p]), len(children[q])
        if p == q:
            return [(k, k) for k in range(i - 1, -1, -1)]
        if not i or not j:
            return []
        step = math.isqrt(i) + 1
        marks = [[0] * (j + 1), *(row for k, row in enumerate(rows(p, q), 1) if k % step == 0)]
        out, low, block = [], i, []
        while i and j:
            if i <= low:
                low = (i - 1) // step * step
                block = [marks[low // step], *islice(rows(p, q, low, marks[low // step]), step)]
            up, left, here = block[i - 1 - low][j], block[i - low][j - 1], block[i - low][j]
            if here > max(up, left):
                i, j = i - 1, j - 1
                out.append((i, j))
            elif up >= left:
                i -= 1
            else:
                j -= 1
        return out

    p, q = look(a), look(b)
    if labels[p] != labels[q]:
        return 0, []
    pairs, waiting = [], [(a, b)]
    while waiting:
        x, y = waiting.pop()
        pairs.append((x, y))
        waiting += [(x[1][i], y[1][j]) for i, j in reversed(matches(shape[id(x)], shape[id(y)]))]
    return score(p, q), pairs


def is_node(node: Node) -> bool:
    """Whether an element is a node of outlines: blocks, and what may be dropped by its kind."""
    return node.tag not in ("br", "hr") and (node.tag in BLOCK or node.tag in DROPPED_TAGS or not node.words.isdisjoint(DROPPED_WORDS))


def outline(node: Node, at: dict) -> list:
    """[label, children] of the element's nodes; neighbours of one shape are one. ``at`` gets id of each element -> its outline."""
    shape = [re.sub(r"\d+", "0", node.label), []]
    at[id(node)] = shape

    def merge(a: list, b: list) -> None:
        moved[id(b)] = a
        for x, y in zip(a[1], b[1], strict=True):
            merge(x, y)

    def look(parent: Node) -> None:
        for c in parent.children:
            if c.tag == "#":
                continue
            if not is_node(c):
                at[id(c)] = shape
                look(c)
                continue
            below: dict = {}
            child = outline(c, below)
            if shape[1] and shape[1][-1] == child:
                moved.clear()
                merge(shape[1][-1], child)
                below = {k: moved[id(v)] for k, v in below.items()}
            else:
                shape[1].append(child)
            at.update(below)

    moved: dict = {}
    look(node)
    return shape


def numbered(tree: list) -> list[list]:
    """A tree's nodes in document order, which is how slots are numbered."""
    out, waiting = [], [tree]
    while waiting:
        node = waiting.pop()
        out.append(node)
        waiting += reversed(node[1])
    return out


def by_kind(tree: list) -> tuple[set[int], set[int]]:
    """Slots that may hold main text, and those within an article: not of a dropped kind, and within the articles where there are some."""
    number = {id(n): i for i, n in enumerate(numbered(tree))}
    holds: set[int] = set()  # nodes with an article or main part below them

    def split(node: list) -> tuple[str, frozenset]:
        tag, *words = node[0].split(".")
        return tag, frozenset(words)

    def look(node: list) -> bool:
        tag, words = split(node)
        found = tag in ("article", "main") or "main" in words
        for c in node[1]:
            found |= look(c)
        if found:
            holds.add(id(node))
        return found

    def dropped(node: list, inside: bool) -> bool:
        tag, words = split(node)
        if id(node) in holds:
            return False
        return tag in DROPPED_TAGS or tag == "header" and not inside or tag not in ("html", "body", "article", "main") and not words.isdisjoint(DROPPED_WORDS)

    def articles(node: list) -> list[list]:
        found: list[list] = []
        for c in node[1]:
            tag, words = split(c)
            if tag in ("article", "main"):
                found.append(c)
            elif id(c) in holds:
                found += [c] if "main" in words else articles(c)
        return found

    kept: set[int] = set()

    def walk(node: list, inside: bool) -> None:
        kept.add(number[id(node)])
        for c in node[1]:
            if not dropped(c, inside):
                walk(c, inside or split(c)[0] in ("article", "main"))

    look(tree)
    found = articles(tree)
    for part in found or [tree]:
        walk(part, part is not tree)
    return kept, kept if found else set()


def aligned(tree: list, template: list) -> list[int]:
    """For each slot of a tree the template's node that simple tree matching gives it, -1 for none."""
    slot, node = ({id(n): i for i, n in enumerate(numbered(t))} for t in (tree, template))
    out = [-1] * len(slot)
    for p, q in simple_tree_matching(tree, template)[1]:
        out[slot[id(p)]] = node[id(q)]
    return out


def judged(tree: list, nodes: list[int], behaviour: dict) -> list[int]:
    """The slots that hold content, for the template's node of each and (pages, words, linked, texts) of the nodes."""
    kept, inside = by_kind(tree)
    out = []
    for slot in sorted(kept):
        pages, words, linked, texts = behaviour.get(nodes[slot], (0, 0, 0, 0))
        fixed = pages >= LEAST_PAGES and (linked >= LINKED_SHARE * words or texts <= (1 - CONSTANT_SHARE) * pages)
        if slot in inside or not fixed:
            out.append(slot)
    return out


def layout(root: Node) -> int:
    """A number for the set of blocks in the upper part of the tree, by their labels."""
    found: set[str] = set()

    def look(node: Node, path: str, depth: int) -> None:
        for c in node.children:
            if c.tag in BLOCK:
                below = f"{path}/{c.label}"
                found.add(below)
                if depth:
                    look(c, below, depth - 1)

    look(root, "", 2)
    return fact("\n".join(sorted(found)))


class Page:
    """A page's outline and its text in pieces: text, slot (-1 between blocks), number of place and words (0 for white space), words, words in links."""

    def __init__(self, page: str):
        root = parse(page)
        self.layout, at = layout(root), {}
        self.tree = outline(root, at)
        number = {id(n): i for i, n in enumerate(numbered(self.tree))}
        self.pieces: list[tuple[str, int, int, int, int]] = []

        def gap() -> None:
            if not self.pieces or self.pieces[-1][1] >= 0:
                self.pieces.append(("\n", -1, 0, 0, 0))

        def walk(node: Node, linked: bool, place: int) -> None:
            slot = number[id(at[id(node)])]
            for c in node.children:
                if c.tag == "#":
                    words = squeezed(c.text)
                    n = len(words.split())
                    self.pieces.append((c.text, slot, (place << 32 | fact(words)) - (1 << 63) if words else 0, n, n * linked))
                    continue
                block = is_node(c) or c.tag in BLOCK
                if block:
                    gap()
                walk(c, linked or c.tag == "a", zlib.crc32(c.label.encode("utf-8", "replace"), place))
                if block:
                    gap()

        walk(root, False, fact(root.label))
        self.kept, self.inside = by_kind(self.tree)

    def text(self, content, constant=frozenset()) -> str:
        return squeezed("".join(t for t, slot, n, _, _ in self.pieces if slot < 0 or slot in content and (slot in self.inside or n not in constant)))


def extract(page: str, content=None) -> str:
    """The main text of one page, its blocks in order joined by one space: of the given slots, or of those its kinds of nodes leave."""
    found = Page(page)
    return found.text(found.kept if content is None else content)


def host_of(url):
    """The host of a URL in lower case, without port; '' where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def in_pieces(pages: DataFrame) -> DataFrame:
    """Rows of what each page's parts are and where it belongs.

    texts, slots and numbers are its pieces, outline and kept its tree and the slots that its kinds of nodes leave,
    inside those of them within articles, places the numbers of kept pieces, by_slot the words, words in links and
    hash of the text of each kept slot.
    """
    section = F.coalesce(F.regexp_extract(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)/", 1), F.lit(""))
    names = ["layout", "outline", "texts", "slots", "numbers", "places", "kept", "inside", "by_slot"]

    def run(series: pd.Series) -> pd.DataFrame:
        rows = []
        for html in series:
            page = Page(html or "")
            behaviour: dict = {}
            for text, slot, n, words, linked in page.pieces:
                if n and slot in page.kept:
                    old = behaviour.get(slot, (0, 0, 0))
                    behaviour[slot] = (old[0] + words, old[1] + linked, zlib.crc32(squeezed(text).encode("utf-8", "replace"), old[2]))
            rows.append((page.layout, json.dumps(page.tree), [x[0] for x in page.pieces], [x[1] for x in page.pieces], [x[2] for x in page.pieces],
                         [n for _, slot, n, _, _ in page.pieces if n and slot in page.kept], sorted(page.kept), sorted(page.inside),
                         [{"slot": k, "words": w, "linked": m, "print": h} for k, (w, m, h) in behaviour.items()]))
        return pd.DataFrame(rows, columns=names)

    kind = "layout long, outline string, texts array<string>, slots array<int>, numbers array<long>, places array<long>, kept array<int>, inside array<int>, by_slot array<struct<slot:int,words:int,linked:int,print:long>>"
    page = F.pandas_udf(run, kind)(F.col("html"))
    found = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), section.alias("section"), page.alias("page")).select("page_id", "url", "host", "section", "page.*")
    return found.withColumn("shape", F.xxhash64("outline"))


def page_once(found: DataFrame) -> DataFrame:
    """One page of each main text of a host."""
    page = F.min(F.struct("layout", "section", "shape", "places", "by_slot")).alias("page")
    return found.where("host <> '' AND size(places) > 0").groupBy("host", F.xxhash64("places").alias("main")).agg(page).select("host", "page.*")


def decisions(found: DataFrame, once: DataFrame) -> DataFrame:
    """Rows (host, shape, content): the slots that hold content on a host's pages of one outline, where the host has a template.

    All pages choose the template, and all main texts judge its nodes; only outlines and sums by node are joined.
    """
    shapes = written(found.where("host <> ''").groupBy("host", "shape").agg(F.count("*").alias("pages"), F.min("outline").alias("outline")), "page-shapes")
    base = shapes.groupBy("host").agg(F.max(F.struct("pages", "shape", "outline")).getField("outline").alias("base"))

    def align(outlines: pd.Series, bases: pd.Series) -> pd.Series:
        return pd.Series([aligned(json.loads(a), json.loads(b)) for a, b in zip(outlines, bases, strict=True)])

    matched = written(shapes.join(base, "host").withColumn("nodes", F.pandas_udf(align, "array<int>")("outline", "base")).drop("base", "pages"), "page-aligned")
    slots = once.select("host", "shape", F.inline("by_slot")).groupBy("host", "shape", "slot", "print").agg(F.count("*").alias("pages"), F.sum("words").alias("words"), F.sum("linked").alias("linked"))
    nodes = slots.join(matched.select("host", "shape", F.posexplode("nodes").alias("slot", "node")), ["host", "shape", "slot"]).where("node >= 0")
    texts = nodes.groupBy("host", "node", "print").agg(*[F.sum(c).alias(c) for c in ("pages", "words", "linked")])
    behaviour = texts.groupBy("host", "node").agg(*[F.sum(c).alias(c) for c in ("pages", "words", "linked")], F.count("*").alias("texts"))
    of_host = behaviour.groupBy("host").agg(F.collect_list(F.struct("node", "pages", "words", "linked", "texts")).alias("behaviour"))

    def judge(outlines: pd.Series, nodes: pd.Series, behaviours: pd.Series) -> pd.Series:
        return pd.Series([judged(json.loads(o), list(n), {x["node"]: (x["pages"], x["words"], x["linked"], x["texts"]) for x in b}) for o, n, b in zip(outlines, nodes, behaviours, strict=True)])

    return matched.join(of_host, "host").select("host", "shape", F.pandas_udf(judge, "array<int>")("outline", "nodes", "behaviour").alias("content"))


def constants(found: DataFrame, once: DataFrame) -> DataFrame:
    """Rows (host, layout, section, constant): the numbers of the texts that most pages share.

    All pages count, those of a host with the same main text once. A text is constant in a section of a layout if
    it is on most pages of that section, of the layout or of the host.
    """
    finest = ["host", "layout", "section"]
    sizes = written(once.groupBy(*finest).agg(F.count("*").alias("pages")), "page-sizes")
    facts = written(once.select(*finest, F.explode(F.array_distinct("places")).alias("number")).groupBy(*finest, "number").agg(F.count("*").alias("n")), "page-facts")
    clusters, out = found.where("host <> ''").select(*finest).distinct(), None
    for keys in (finest[:1], finest[:2], finest):
        pages = sizes.groupBy(*keys).agg(F.sum("pages").alias("pages")).where(F.col("pages") >= LEAST_PAGES)
        often = facts.groupBy(*keys, "number").agg(F.sum("n").alias("n")).where(F.col("n") >= CONSTANT_SHARE * LEAST_PAGES)
        constant = often.join(pages, keys).where(F.col("n") >= CONSTANT_SHARE * F.col("pages")).select(*keys, "number")
        part = clusters.join(constant, keys).select(*finest, "number")
        out = part if out is None else out.unionByName(part)
    return out.groupBy(*finest).agg(F.collect_set("number").alias("constant"))


def extract_main_text(pages: DataFrame, with_template: bool = True) -> DataFrame:
    """Rows (page_id, url, text, n_chars), one for each page.

    Null html gives an empty text; pages without a host, and hosts of fewer than LEAST_PAGES different pages, go
    without a template. ``with_template`` False withholds it from all. Repeated rows give repeated results, further columns are left out, an empty table gives none.
    """
    found = written(in_pieces(pages), "page-pieces")
    joined = found
    if with_template:
        once = written(page_once(found), "page-once")
        for part, keys in ((decisions(found, once), ["host", "shape"]), (constants(found, once), ["host", "layout", "section"])):
            part = written(part, "page-decisions")
            joined = joined.join(F.broadcast(part) if part.count() <= BROADCAST_ROWS else part, keys, "left")
    else:
        joined = joined.withColumns({"content": F.lit(None).cast("array<int>"), "constant": F.lit(None).cast("array<long>")})
    slots, constant = F.coalesce("content", "kept"), F.coalesce("constant", F.array().cast("array<long>"))
    kept = F.zip_with(F.col("texts"), F.arrays_zip("slots", "numbers"), lambda t, x: F.when(
        (x.slots < 0) | F.array_contains(slots, x.slots) & (F.array_contains("inside", x.slots) | ~F.array_contains(constant, x.numbers)), t).otherwise(""))

    def run(series: pd.Series) -> pd.Series:
        return series.map(squeezed)

    text = F.pandas_udf(run, "string")(F.array_join(kept, ""))
    return joined.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
