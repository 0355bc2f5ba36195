"""Main text of web pages by wrappers that are inferred for each host.

A page is read as a token stream; its containers form a tree, whose leaves are texts: constants, by
block tag and words, or slots ``#``. Wrappers are union-free expressions over such trees: equal
neighbours become a repeated group ``(x)+``, and where two pages of a host do not match, what only one
of them has becomes an optional group ``(x)?``. A text can be a constant if it is on OFTEN of the
host's different pages that have its container; all others mismatch and are slots at once. The
alignment of two wrappers is a wrapper again and adds up how many pages have each constant and each
container, so a host's pages are folded in any order and in parts: different trees of a host are
counted first, then folded FOLD at a time until one is left. No task sees all pages of a host.

A constant that OFTEN of the pages have at its place in the wrapper is template text. A page is matched
to the wrapper, and its texts at such places are dropped; the same words at another place stay.

The main slots of a page are those under its article containers, or, in a layout that marks none, all
whose text over the host's pages is mostly outside links, those below the one with the most text, and
lists of links that less text than around them makes up; a page's layout is the set of its paths. Menus, headers, footers, sidebars, notices,
adverts, forms and comments are told by tag, role and the words of class and id. A page's text is its
blocks in those slots. A page without any (cut off, or of another make) falls back to its own tree.

Cases: null and empty html give an empty text and 0; a null url is a host of its own; tags that are
left open, stray or cut off are closed as a browser would; very long pages are read whole; repeated
rows give repeated results; an empty table gives no rows; other input columns may have any name.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panoquarry.llm.runtime import Scratch, released

#: Trees of a host that one task folds at a time.
FOLD = 64
#: Containers in each other that a path tells apart, and elements that are open at once. What is nested
#: deeper belongs to the last one; its text stays, as in browsers, which have such bounds as well.
DEPTH, OPEN = 200, 2000
#: Template text is on so many different pages, and in so many hundredths of those that have its container.
LEAST_PAGES, OFTEN = 3, 90
#: Longer alignments take the nearest match in place of the longest run.
LONGEST_RUN = 250_000
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|math|title|textarea|iframe|object|canvas)\b[^>]*(?<!/)>.*?(?:</\1\s*>|\Z)"
    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>"']*(?:"[^"<]*"[^>"']*|'[^'<]*'[^>"']*)*)>"""
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
#: HTML's elements by kind.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
_CONTAINER = frozenset("article aside blockquote body details dialog div fieldset figure footer form header main menu nav ol section table ul".split())
_BOUNDARY = frozenset("body html table td th ul ol div section article main aside nav header footer form fieldset".split())
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: What is not main text. Tags everywhere; tags and words outside an article's own header.
_NEVER = frozenset("nav aside form footer head button select option dialog menu search label".split())
_ROLES = frozenset("navigation banner complementary contentinfo search form alert alertdialog dialog menu menubar toolbar".split())
_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements sponsor sponsored promo promos promotion banner cookie cookies consent gdpr notice notices alert alerts popup modal overlay"
    " sidebar sidebars side rail menu menus nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus respond reply replies discussion share sharing social related"
    " recommended recommendations newsletter subscribe subscription signup login search pagination pager widget widgets toolbar disclaimer copyright masthead topbar skip".split()
)
#: Words that with those above make a name of page furniture, such as share-buttons; words
#: that alone may as well name a part of a text; words of names that tell how a page is laid out; elements
#: that are text or its headings.
_HELPERS = frozenset("bar bars block blocks box boxes btn btns button buttons container content form icon icons inner item items link links list main outer page panel post posts section site wrap wrapper area top bottom left right".split())
_TOPICS = frozenset("side discussion reply replies respond social related search copyright disclaimer notice notices alert alerts promotion recommended recommendations comment share sharing skip overlay consent".split())
_LAYOUT = frozenset("with has without no layout".split())
_PROSE = frozenset("h1 h2 h3 h4 h5 h6 p section li dd dt td th blockquote pre figure figcaption table caption tr ul ol dl".split())
_SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")


def _furniture(tag: str, name: str, value: str, in_article: bool) -> bool:
    """Whether a class or id tells page furniture. In containers outside articles a word does, a topic only
    if the name has nothing but such words and helpers; names of a layout (with-sidebar) never do. In text,
    within articles and for articles themselves, a whole class or id must be made of such words and helpers
    only. A part of a text may have a topic of one word as its id; the ids of headings and paragraphs never
    tell."""
    parts = [{w.lower() for w in _SPLIT.split(x) if w} for x in value.split()]
    if not in_article and tag not in _PROSE and tag not in ("article", "main"):
        return any(x & (_WORDS - _TOPICS) or x & _TOPICS and x <= _WORDS | _HELPERS for x in parts if not x & _LAYOUT)
    if name == "id" and tag in _PROSE and tag != "section":
        return False
    parts = [x for x in parts if x & _WORDS and x <= _WORDS | _HELPERS]
    return any(name == "class" or not (len(x) == 1 and x <= _TOPICS) for x in parts)


def _unwanted(tag: str, attributes: str, in_article: bool) -> tuple[bool, str]:
    """Whether an element is no main text, and its label: tag, and first class or id."""
    label = tag
    if tag in _NEVER or tag == "header" and not in_article:
        return True, label
    if not attributes:
        return False, label
    out = False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            words = {w.lower() for w in _SPLIT.split(value)}
            out |= _furniture(tag, name, value, in_article) or "header" in words and not in_article and tag not in ("article", "main")
            if label == tag and value.split():
                label += "." + re.sub(r"[^A-Za-z_-]+", "", value.split()[0])
        elif name == "role":
            out |= value.lower() in _ROLES
        elif name == "hidden":
            out |= tag != "body"
        elif name == "style":
            out |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        elif value.lower() == "true":
            out = True
    return out and tag not in ("body", "html"), label


class Page:
    """Blocks of a page in order: path of containers, text, characters in links, unwanted. With tree,
    also the nested containers. With keyed, their texts are places in blocks, and keys has the hash of
    each block's tag and text."""

    def __init__(self, source: str, tree: bool = False, keyed: bool = False):
        self.blocks: list[tuple[str, str, int, bool]] = []
        self.root: list = ["", []]
        self.keys: list[str] = []
        self._tree, self._keyed = tree or keyed, keyed
        # of each open element: tag, path, unwanted, node, within an article, how many containers it is in
        self._open: list[tuple[str, str, bool, list, bool, int]] = [("", "", False, self.root, False, 0)]
        # by tag, how many were not opened because of OPEN
        self._passed: Counter[str] = Counter()
        self._count: Counter[str] = Counter()
        self._text: list[str] = []
        self._linked, self._links = 0, 0
        at = 0
        for m in _TOKEN.finditer(source):
            if m.start() > at:
                self._add(source[at : m.start()])
            at = m.end()
            if tag := m[3] or m[6]:
                closing, attributes = (m[2], m[4]) if m[3] else (m[5], m[7])
                self._close(tag.lower()) if closing else self._start(tag.lower(), attributes)
        if at < len(source):
            self._add(source[at:])
        self._flush()

    def _add(self, text: str) -> None:
        if "&" in text:
            text = entities.unescape(text)
        self._text.append(text)
        if self._links:
            self._linked += len(text)

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                _, path, unwanted, node, *_ = self._open[-1]
                self.blocks.append((path, text, min(self._linked, len(text)), unwanted))
                if self._keyed:
                    tag = next((e[0] for e in reversed(self._open) if e[0] in _BLOCK), "")
                    self.keys.append(hashlib.blake2b(f"{tag} {text}".encode("utf-8", "surrogatepass"), digest_size=8).hexdigest())
                    node[1].append(len(self.blocks) - 1)
                elif self._tree and (not node[1] or node[1][-1] != "#"):
                    node[1].append("#")
            self._text.clear()
        self._linked = 0

    def _pop(self, n: int) -> None:
        if any(e[0] in _BLOCK for e in self._open[n:]):
            self._flush()
        for e in self._open[n:]:
            self._links -= e[0] == "a"
            self._count[e[0]] -= 1
        del self._open[n:]

    def _start(self, tag: str, attributes: str) -> None:
        if tag in _VOID:
            if tag == "hr":
                self._flush()
            elif tag == "br":
                self._text.append(" ")
            return
        if tag in _BLOCK or tag in _ENDS:
            ends = _ENDS.get(tag, ())
            some = tag in _BLOCK and self._count["p"] or any(self._count[x] for x in ends)
            for i in range(len(self._open) - 1 if some else 0, 0, -1):
                name = self._open[i][0]
                if name in ends or name == "p" and tag in _BLOCK:
                    self._pop(i)
                    break
                if name in _BOUNDARY and name not in ends:
                    break
            if tag in _BLOCK:
                self._flush()
        if len(self._open) > OPEN:
            self._passed[tag] += 1
            return
        _, path, unwanted, node, in_article, depth = self._open[-1]
        more, label = _unwanted(tag, attributes, in_article)
        if tag == "a":
            self._links += 1
        if tag in _CONTAINER and depth < DEPTH:
            depth += 1
            path = f"{path}/{label}"
            if self._tree:
                child: list = [label, []]
                node[1].append(child)
                node = child
        self._count[tag] += 1
        self._open.append((tag, path, unwanted or more, node, in_article or tag in ("article", "main"), depth))

    def _close(self, tag: str) -> None:
        if self._passed[tag]:
            self._passed[tag] -= 1
            return self._flush() if tag in _BLOCK else None
        if not self._count[tag]:
            return self._flush() if tag == "p" else None
        for i in range(len(self._open) - 1, 0, -1):
            name = self._open[i][0]
            if name == tag:
                if tag not in ("body", "html"):
                    self._pop(i)
                return
            if tag not in _BLOCK and name in _BLOCK:
                return


# A wrapper is a list of items [node, optional, repeated]; a node is "#", a constant ["=key", pages] or
# [label, wrapper]. The constant "=" begins a container and counts the pages that have it.


def _constant(node) -> bool:
    return node[0][0] == "="


def _same(a, b) -> bool:
    return a[0] == b[0] if a != "#" and b != "#" else a == b


def _both(a, b):
    """The node of two that are the same."""
    if a == "#":
        return a
    return [a[0], a[1] + b[1] if _constant(a) else align(a[1], b[1])]


def wrapper_of(children: list) -> list:
    """A page's tree as a wrapper: equal neighbours become one repeated group."""
    out: list = []
    for node in children:
        item = node if node == "#" or _constant(node) else [node[0], wrapper_of(node[1])]
        if out and _same(out[-1][0], item):
            if item != "#" and not _constant(item):
                out[-1][0] = _both(out[-1][0], item)
            out[-1][2] = True
        else:
            out.append([item, False, False])
    return out


def _matches(a: list, b: list) -> list[tuple[int, int]]:
    """Places of the longest common run of two lists of names, in order."""
    lo, n, m = 0, len(a), len(b)
    while lo < min(n, m) and a[lo] == b[lo]:
        lo += 1
    while n > lo and m > lo and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    out = [(i, i) for i in range(lo)]
    if (n - lo) * (m - lo) > LONGEST_RUN:
        at: dict = {}
        for j in range(lo, m):
            at.setdefault(b[j], []).append(j)
        j = lo
        for i in range(lo, n):
            there = at.get(a[i], ())
            k = bisect_left(there, j)
            if k < len(there) and there[k] - j <= max(64, m - n):
                out.append((i, there[k]))
                j = there[k] + 1
    elif n > lo and m > lo:
        best = [[0] * (m - lo + 1) for _ in range(n - lo + 1)]
        for i in range(n - lo - 1, -1, -1):
            row, below = best[i], best[i + 1]
            for j in range(m - lo - 1, -1, -1):
                row[j] = below[j + 1] + 1 if a[lo + i] == b[lo + j] else max(below[j], row[j + 1])
        i = j = 0
        while i < n - lo and j < m - lo:
            if a[lo + i] == b[lo + j]:
                out.append((lo + i, lo + j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    return out + [(n + k, m + k) for k in range(len(a) - n)]


def align(a: list, b: list) -> list:
    """The wrapper of what two wrappers match. Matches are the longest common run of labels, constants
    and slots; what only one has becomes optional."""
    out: list = []

    def add(node, optional: bool, repeated: bool) -> None:
        if out and _same(out[-1][0], node):
            out[-1] = [_both(out[-1][0], node), out[-1][1] and optional, True]
        else:
            out.append([node, optional, repeated])

    i = j = 0
    for p, q in [*_matches([x[0][0] for x in a], [x[0][0] for x in b]), (len(a), len(b))]:
        for item in (*a[i:p], *b[j:q]):
            add(item[0], True, item[2])
        if p < len(a):
            add(_both(a[p][0], b[q][0]), a[p][1] or b[q][1], a[p][2] or b[q][2])
        i, j = p + 1, q + 1
    return out


def _weighed(wrapper: list, pages: int) -> list:
    """The wrapper of a tree that so many pages have."""
    return [[node if node == "#" else [node[0], node[1] * pages if _constant(node) else _weighed(node[1], pages)], optional, repeated] for node, optional, repeated in wrapper]


def _begun(wrapper: list) -> int:
    """How many pages have a container."""
    return wrapper[0][0][1] if wrapper and wrapper[0][0][0] == "=" else 0


def _template(node, pages: int) -> bool:
    return node != "#" and len(node[0]) > 1 and _constant(node) and node[1] >= LEAST_PAGES and 100 * node[1] >= OFTEN * pages


def any_template(wrapper: list) -> bool:
    pages = _begun(wrapper)
    return any(_template(node, pages) or node != "#" and not _constant(node) and any_template(node[1]) for node, _, _ in wrapper)


def template_blocks(page: Page, children: list, wrapper: list) -> set[int]:
    """Which blocks of a keyed page stand at places of template text, by matching it to the wrapper."""
    constants = {node[0] for node, _, _ in wrapper if node != "#" and _constant(node)}
    runs: list[tuple[str, list]] = []
    for node in children:
        if isinstance(node, int):
            name = "#" if page.blocks[node][3] or (name := "=" + page.keys[node]) not in constants else name
        else:
            name = node[0]
        if runs and runs[-1][0] == name:
            runs[-1][1].append(node)
        else:
            runs.append((name, [node]))
    runs = [x for x in runs if x[0] != "#"]
    items = [x[0] for x in wrapper if x[0] != "#" and x[0][0] != "="]
    pages, out = _begun(wrapper), set()
    for p, q in _matches([x[0] for x in runs], [x[0] for x in items]):
        if not _constant(items[q]):
            for node in runs[p][1]:
                out |= template_blocks(page, node[1], items[q][1])
        elif _template(items[q], pages):
            out.update(runs[p][1])
    return out


def expression(wrapper: list) -> str:
    """A wrapper in words: <nav>#</nav>(<div.ad>#</div.ad>)?<article>(#)+</article>"""
    out = []
    for node, optional, repeated in wrapper:
        if node[0] == "=":
            continue
        text = "#" if node == "#" else node[0] if _constant(node) else f"<{node[0]}>{expression(node[1])}</{node[0]}>"
        out.append(f"({text}){'*' if optional and repeated else '?' if optional else '+'}" if optional or repeated else text)
    return "".join(out)


def slots(wrapper: list, path: str = "") -> set[str]:
    """Paths of the containers that hold text."""
    out = set()
    for node, _, _ in wrapper:
        if node[0] != "=":
            out |= {path} if node == "#" or _constant(node) else slots(node[1], f"{path}/{node[0]}")
    return out


Sizes = dict[str, list[int]]


def main_slots(paths: frozenset[str], sizes: Sizes) -> list[str]:
    """The slots of the main text among the paths of a layout. sizes: characters of wanted text outside
    links, and of all wanted text, by path."""
    mass = {p: sizes.get(p, (0, 0))[0] for p in paths}
    for kinds in (("article",), ("article", "main")):
        marked = {p for p in paths if any(x.partition(".")[0] in kinds for x in p.split("/"))}
        if any(mass[p] for p in marked):
            return sorted(marked)
    wanted = {p for p in paths if mass[p] > 0}
    if not wanted:
        return []
    top = max(sorted(wanted), key=lambda p: mass[p])
    prose = {p for p in wanted if p == top or 2 * mass[p] >= sizes[p][1]}

    def within(p: str) -> bool:
        around = max((q for q in prose if p.startswith(q + "/")), key=len, default=None)
        return around is not None and mass[around] >= sizes.get(p, (0, 0))[1]

    return sorted(p for p in paths if p in prose or p.startswith(top + "/") or within(p))


def _sizes(blocks: list[tuple[str, str, int, bool]]) -> Sizes:
    out: Sizes = {}
    for path, text, linked, unwanted in blocks:
        if not unwanted:
            one = out.setdefault(path, [0, 0])
            one[0] += max(len(text) - linked, 0)
            one[1] += len(text)
    return out


@lru_cache(maxsize=4096)
def _main(sizes: str, paths: frozenset[str]) -> frozenset[str]:
    return frozenset(main_slots(paths, _read_json(sizes)))


def page_text(source: str, sizes: str = "{}", wrapper: list | None = None) -> str:
    """The text of a page's blocks in the main slots by the host's sizes (as JSON), or in those of its own tree. What the wrapper has
    as template text is left out."""
    page = Page(source, keyed=bool(wrapper))
    blocks = page.blocks
    template = template_blocks(page, page.root[1], wrapper) if wrapper else set()
    own = _sizes(blocks)
    for host in (True, False):
        if host:
            known = _main(sizes, frozenset(own))
        else:
            known, template = main_slots(frozenset(own), own), set()
        text = " ".join(b[1] for i, b in enumerate(blocks) if not b[3] and b[0] in known and i not in template)
        if text:
            return text
    return ""


def _told(page: Page, children: list) -> list:
    """A keyed page's tree with key:characters outside links:characters in place of its texts."""
    out: list = []
    for node in children:
        if not isinstance(node, int):
            out.append([node[0], _told(page, node[1])])
        elif not page.blocks[node][3]:
            n = len(page.blocks[node][1])
            out.append(f"{page.keys[node]}:{max(n - page.blocks[node][2], 0)}:{n}")
        elif not out or out[-1] != "#":
            out.append("#")
    return out


@released
def _read_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        trees = []
        for source in batch.column(1):
            page = Page(source.as_py() or "", keyed=True)
            trees.append(json.dumps(_told(page, page.root[1])))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(trees, pa.string())], ["host", "tree"])


def _texts(children: list, path: str, out: set[tuple[str, str | None]]) -> None:
    for node in children:
        if not isinstance(node, str):
            _texts(node[1], f"{path}/{node[0]}", out)
        elif node != "#":
            out |= {(path, None), (path, node.partition(":")[0])}


@released
def _read_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, path, key: the different texts of each tree; key null: the paths."""
    for batch in batches:
        hosts, found = [], []
        for host, tree in zip(batch.column(0), batch.column(1), strict=True):
            own: set[tuple[str, str | None]] = set()
            _texts(json.loads(tree.as_py()), "", own)
            hosts += [host.as_py()] * len(own)
            found += own
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string())], ["host", "path", "key"])


def _general(children: list, constants: frozenset[str], path: str, sizes: Sizes) -> list:
    """A tree whose texts are constants or slots; sizes are added up without the constants."""
    out: list = [["=", 1]]
    for node in children:
        if not isinstance(node, str):
            out.append([node[0], _general(node[1], constants, f"{path}/{node[0]}", sizes)])
            continue
        key, *size = node.split(":")
        if f"{path} {key}" in constants:
            out.append(["=" + key, 1])
            continue
        if size:
            one = sizes.setdefault(path, [0, 0])
            one[0] += int(size[0])
            one[1] += int(size[1])
        if out[-1] != "#":
            out.append("#")
    return out


@released
def _read_general(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        trees, paths, found = [], [], []
        for tree, known in zip(batch.column(1), batch.column(2), strict=True):
            sizes: Sizes = {}
            trees.append(json.dumps(wrapper_of(_general(json.loads(tree.as_py()), frozenset(known.as_py() or ()), "", sizes))))
            paths.append(list(sizes))
            found.append(list(sizes.values()))
        columns = (pa.array([[x[i] for x in one] for one in found], pa.list_(pa.int64())) for i in range(2))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(trees, pa.string()), pa.array(paths, pa.list_(pa.string())), *columns], ["host", "tree", "paths", "mass", "chars"])


def _fold(rows: pd.DataFrame) -> pd.DataFrame:
    found = sorted(zip(rows["tree"], rows["pages"], strict=True))
    out = None
    for tree, pages in found:
        one = _weighed(json.loads(tree), int(pages))
        out = one if out is None else align(out, one)
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "tree": [json.dumps(out)], "pages": [1]})


def _input(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))
    return pages.select(F.coalesce(host, F.lit("")).alias("host"), F.col("html").cast("string").alias("html"), "page_id", "url")


def _folded(trees: DataFrame, scratch: Scratch) -> DataFrame:
    """host, tree (one for each), from host, tree, pages. Each round folds about FOLD trees of a host in a
    task, so rounds follow the logarithm of a host's different trees."""
    left = scratch.keep(trees, "fold-0")
    step = 0
    while True:
        counts = left.groupBy("host").agg(F.count("*").alias("n"))
        # the first round also weighs trees by their pages
        if step and (counts.agg(F.max("n")).first()[0] or 0) <= 1:
            return left.select("host", "tree")
        step += 1
        parts = F.ceil(F.col("n") / FOLD)
        met = left.alias("l").join(counts.alias("c"), F.col("l.host") == F.col("c.host"))
        dealt = met.select("l.host", "tree", "pages", F.pmod(F.xxhash64("tree", F.lit(step)), parts).alias("part"))
        left = scratch.keep(dealt.groupBy("host", "part").applyInPandas(lambda rows: _fold(rows), "host string, tree string, pages long"), f"fold-{step}")


def infer_wrappers(spark: SparkSession, pages: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """host, tree (the wrapper as JSON), wrapper (as an expression), main (paths of the slots of the
    main text, if a page has all), sizes (as JSON)."""
    scratch = scratch or Scratch(spark, "wrappers")
    # copies of a page count once
    told = scratch.keep(_input(pages).select("host", "html").mapInArrow(_read_trees, "host string, tree string").distinct(), "told")
    count = told.mapInArrow(_read_texts, "host string, path string, key string").groupBy("host", "path", "key").agg(F.count("*").alias("n"))
    count = scratch.keep(count.filter(f"key is null or n >= {LEAST_PAGES}"), "count")
    often = count.filter("key is not null").join(count.filter("key is null").select("host", "path", F.col("n").alias("pages")), ["host", "path"]).filter(f"100 * n >= {OFTEN} * pages")
    often = scratch.keep(often.groupBy("host").agg(F.collect_list(F.concat_ws(" ", "path", "key")).alias("known")), "often")
    met = told.join(scratch.sized(often, "often"), "host", "left").select("host", "tree", "known")
    read = scratch.keep(met.mapInArrow(_read_general, "host string, tree string, paths array<string>, mass array<bigint>, chars array<bigint>"), "trees")
    mass = read.select("host", F.explode(F.arrays_zip("paths", "mass", "chars")).alias("p")).groupBy("host", F.col("p.paths").alias("path")).agg(F.sum("p.mass").alias("mass"), F.sum("p.chars").alias("chars"))
    mass = mass.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("path", "mass", "chars"))).alias("sizes"))
    folded = _folded(read.groupBy("host", "tree").agg(F.count("*").alias("pages")), scratch)

    @released
    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            trees = [json.loads(r["tree"]) for r in rows]
            sizes = [{x["path"]: [x["mass"], x["chars"]] for x in r["sizes"] or ()} for r in rows]
            main = [main_slots(frozenset(slots(t)), x) for t, x in zip(trees, sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(expression, trees), pa.string()), pa.array(main, pa.list_(pa.string())), pa.array(map(json.dumps, sizes), pa.string())], ["host", "tree", "wrapper", "main", "sizes"])

    return folded.join(mass, "host", "left").select("host", "tree", "sizes").mapInArrow(choose, "host string, tree string, wrapper string, main array<string>, sizes string")


@lru_cache(maxsize=64)
def _read_json(source: str) -> Sizes:
    return json.loads(source)


@lru_cache(maxsize=64)
def _matched(tree: str) -> list | None:
    """A wrapper that has template text, or None."""
    wrapper = json.loads(tree)
    return wrapper if any_template(wrapper) else None


def extract(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of pages (query op5)."""
    scratch = Scratch(spark, "html")
    wrappers = scratch.keep(infer_wrappers(spark, pages, scratch).select("host", "tree", "sizes"), "wrappers")

    @released
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [page_text(source.as_py() or "", sizes.as_py() or "{}", _matched(tree.as_py() or "[]")) for source, sizes, tree in zip(batch.column(2), batch.column(3), batch.column(4), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    met = _input(pages).join(scratch.sized(wrappers, "wrappers"), "host", "left").select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", "sizes", "tree")
    return met.mapInArrow(read, "page_id long, url string, text string, n_chars long")
