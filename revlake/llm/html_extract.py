"""HTML main-text extraction by union-free wrapper inference.

A page is read into a tree of block elements and text slots (inline tags belong to their text); adjacent runs of equal shape
become one repeated group. The trees of a host's pages are aligned level by level: where the streams disagree, what only some of them
have becomes an optional group, or joins the repeated group of its neighbour of the same name. So the wrapper of a host is a union-free
regular expression: a sequence of tags, text slots, optional and repeated groups. A page is then aligned with its host's
wrapper, which tells the slot of each of its texts. A slot that holds the same text on pages of different contents, or mostly
links, is not main text; neither is what lies in a menu, advert, form or the like. A page with an article gives the article's slots, another
one its remaining slots.

Scale: pages are reduced where they are read to (host, folded tree, evidence of its slots). Trees of a host are merged in buckets, then
buckets of buckets, then once more, so a host with a large share of all pages is no single task's work. Evidence is summed by slot at each level; of the
page contents that a slot was seen in, three are kept, which is all that the rule asks. Wrappers are joined to pages by host; the planner
broadcasts them only when their measured size is small, and otherwise splits a skewed host. Reading and folding are linear in a page's
length; alignment of two lists of elements takes their product over the word size.
"""

from __future__ import annotations

import functools
import hashlib
import html as html_entities
import json
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
BOILERPLATE_TAGS = frozenset("nav header footer aside form script style noscript template button select option iframe svg dialog menu head object canvas video audio textarea input title math".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
BOILERPLATE_WORDS = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted sidebar nav navbar navigation menu breadcrumb breadcrumbs footer header masthead topbar toolbar cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup share sharing social related recommended comment comments disqus reply replies pagination pager skip widget".split())
MAIN_TAGS = frozenset(["article", "main"])
P_ENDS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
SIBLING_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BARE = frozenset(["html", "body", "main", "article"])  # their names say enough: attributes are not part of their keys
TEXT = "#text"  # no element's name starts with this
BUCKETS = (4096, 64, 1)  # of a host's trees, level by level
NAME = re.compile(r"[^\s/>]+")
#: One attribute, as the states of the HTML standard read it: a quote opens a value only after the equals sign.
ATTRIBUTE = re.compile(r"[\s/]*+(?:(=?+[^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^\s>]*+)))?+)")
NAME_WORDS = re.compile(r"[A-Za-z]+")
KEPT_ATTRIBUTES = frozenset(["class", "id", "role"])


@functools.lru_cache(1 << 14)
def boilerplate(key: str) -> bool:
    """Whether a token's tag, role, class or id names a menu, notice, advert, form, comment list or the like."""
    tag, _, names = key.partition("|")
    if tag in BOILERPLATE_TAGS:
        return True
    if tag in ("html", "body", "main", "article"):
        return False
    words = {w.lower() for w in NAME_WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", names))}
    return not words.isdisjoint(BOILERPLATE_WORDS | BOILERPLATE_ROLES)


@functools.lru_cache(1 << 14)
def is_main(key: str) -> bool:
    return key.partition("|")[0] in MAIN_TAGS or "role=main" in key


class Tree:
    """Nodes in page order: key, whether optional, children, and repeated groups as ranges of children."""

    def __init__(self, nodes: Iterable[tuple[str, bool, int, list]] = ()):
        self.key: list[str] = []
        self.optional: list[bool] = []
        self.kids: list[list[int]] = []
        self.loops: list[tuple] = []
        open_: list[list[int]] = []  # [node, children still to come]
        for key, optional, count, loops in nodes:
            while open_ and not open_[-1][1]:
                open_.pop()
            i = len(self.key)
            if open_:
                self.kids[open_[-1][0]].append(i)
                open_[-1][1] -= 1
            self.key.append(key)
            self.optional.append(optional)
            self.kids.append([])
            self.loops.append(tuple(map(tuple, loops)))
            open_.append([i, count])
        self.leaves = {i: n for n, i in enumerate(i for i, k in enumerate(self.key) if k == TEXT)}

    @staticmethod
    def load(text: str) -> Tree:
        return Tree(json.loads(text))

    def dump(self) -> str:
        return json.dumps([[k, o, len(c), r] for k, o, c, r in zip(self.key, self.optional, self.kids, self.loops, strict=True)], separators=(",", ":"))

    def row(self, i: int) -> tuple:
        """Keys, optional marks and repeated groups of a node's children."""
        return tuple(self.key[c] for c in self.kids[i]), tuple(self.optional[c] for c in self.kids[i]), self.loops[i]


def _preorder(root, kids, node) -> list:
    """Rows (key, optional, children, loops) of a tree of any depth."""
    out, stack = [], [root]
    while stack:
        x = stack.pop()
        out.append(node(x))
        stack.extend(reversed(kids(x)))
    return out


def folded(children: list[int]) -> tuple[list[int], list[int], list[tuple[int, int]]]:
    """Shapes of children with adjacent repeats, of one shape or of up to four in turn, folded to one; each child's place; the groups."""
    out: list[int] = []
    held: list[list[int]] = []
    loops: set[tuple[int, int]] = set()
    for n, shape in enumerate(children):
        out.append(shape)
        held.append([n])
        for p in (1, 2, 3, 4):
            if len(out) >= 2 * p and out[-p:] == out[-2 * p : -p]:
                for k in range(len(out) - p, len(out)):
                    held[k - p] += held[k]
                del out[-p:], held[-p:]
                loops = {x for x in loops if x[1] < len(out)}
                loops.add((len(out) - p, len(out) - 1))
                break
    place = [0] * len(children)
    for k, own in enumerate(held):
        for n in own:
            place[n] = k
    return out, place, sorted(loops)


class Page:
    """A page's elements and texts in page order, and its folded tree; where[i] is the tree's node of the page's node i."""

    def __init__(self, source: str):
        self.key: list[str] = [""]
        self.kids: list[list[int]] = [[]]
        self.blocks: list[tuple[int, str, int, bool, bool]] = []  # (node, text, characters in links, inside an article, inside boilerplate)
        self._stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]
        self._open: dict[str, list[int]] = {}  # places in the stack by element name
        self._text: list[str] = []
        self._links = self._in_link = 0
        self._read(source)
        self._fold()

    def _node(self, key: str) -> int:
        self.key.append(key)
        self.kids.append([])
        self.kids[self._stack[-1][1]].append(len(self.key) - 1)
        return len(self.key) - 1

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                self.blocks.append((self._node(TEXT), text, self._links, *self._stack[-1][2:]))
            self._text, self._links = [], 0

    def _say(self, raw: str) -> None:
        if raw:
            text = html_entities.unescape(raw)
            self._text.append(text)
            if self._in_link:
                self._links += len(text)

    def _pop_to(self, depth: int) -> None:
        self._flush()
        for name, *_ in self._stack[depth:]:
            self._open[name].pop()
        del self._stack[depth:]

    def _last(self, *names: str) -> int:
        """Place in the stack of the innermost open element of the names, -1 if there is none."""
        return max((self._open[n][-1] for n in names if self._open.get(n)), default=-1)

    def _push(self, name: str, key: str) -> None:
        self._open.setdefault(name, []).append(len(self._stack))
        _, _, main, apart = self._stack[-1]
        self._stack.append((name, self._node(key), main or is_main(key), apart or boilerplate(key)))

    @staticmethod
    def _attributes(source: str, pos: int) -> tuple[dict[str, str], int]:
        """Class, id and role of a tag whose name ends at pos, and where the tag ends, -1 if it does not."""
        kept: dict[str, str] = {}
        while True:
            m = ATTRIBUTE.match(source, pos)
            if m[1] and (name := m[1].lower()) in KEPT_ATTRIBUTES and name not in kept and (value := m[2] or m[3] or m[4]):
                kept[name] = html_entities.unescape(value)
            pos = m.end()
            if pos >= len(source):
                return kept, -1
            if source[pos] == ">":
                return kept, pos + 1

    def _read(self, source: str) -> None:
        pos, size = 0, len(source)
        while pos < size:
            at = source.find("<", pos)
            if at < 0:
                self._say(source[pos:])
                break
            mark = source[at + 1 : at + 2]
            closing = mark == "/"
            if mark in ("!", "?") and mark:
                self._say(source[pos:at])
                if source.startswith("<!--", at):
                    end = source.find("-->", at + 2)
                    pos = end + 3 if end >= 0 else size
                elif source.startswith("<![CDATA[", at):
                    end = source.find("]]>", at)
                    self._text.append(source[at + 9 : end if end >= 0 else size])
                    pos = end + 3 if end >= 0 else size
                else:
                    end = source.find(">", at)
                    pos = end + 1 if end >= 0 else size
                continue
            first = source[at + 2 : at + 3] if closing else mark
            if not (first.isascii() and first.isalpha()):
                if closing and first:  # a comment to the standard
                    self._say(source[pos:at])
                    end = source.find(">", at)
                    pos = end + 1 if end >= 0 else size
                else:
                    self._say(source[pos : at + 1])
                    pos = at + 1
                continue
            self._say(source[pos:at])
            m = NAME.match(source, at + 1 + closing)
            name = m[0].lower()
            kept, pos = self._attributes(source, m.end())
            if pos < 0:
                break
            self._tag(name, closing, kept)
            if not closing and name in RAW:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*+(?:>|\Z)", re.I).search(source, pos)
                pos = end.end() if end else size
        self._pop_to(1)

    def _tag(self, name: str, closing: bool, kept: dict[str, str]) -> None:
        if name == "a":
            self._in_link = int(not closing)
        if closing:
            if name == "br":
                self._flush()
            elif name not in INLINE and (at := self._last(name)) >= 0:
                self._pop_to(at)
            return
        if name in RAW or name in INLINE:
            return
        self._flush()
        if name in VOID:
            return
        if name in P_ENDS and (at := self._last("p")) >= 0:
            self._pop_to(at)
        for other in SIBLING_ENDS.get(name, ()):
            if (at := self._last(other)) > self._last("ul", "ol", "dl", "table"):
                self._pop_to(at)
        attributes = " ".join(f"{a}={v}" for a, v in sorted(kept.items())) if name not in BARE or kept.get("role") == "main" else ""
        attributes = re.sub(r"\d+", "0", attributes)
        self._push(name, f"{name}|{attributes}" if attributes else name)

    def _fold(self) -> None:
        shapes: dict[tuple, int] = {}
        parts: list[tuple] = []  # of each shape: key, child shapes, groups
        shape, place = [0] * len(self.key), [0] * len(self.key)
        for i in range(len(self.key) - 1, -1, -1):  # children come after their parents
            out, at, loops = folded([shape[c] for c in self.kids[i]])
            for c, k in zip(self.kids[i], at, strict=True):
                place[c] = k
            x = self.key[i], tuple(out), tuple(loops)
            shape[i] = shapes.setdefault(x, len(parts))
            if shape[i] == len(parts):
                parts.append(x)
        self.tree = Tree(_preorder(shape[0], lambda x: parts[x][1], lambda x: (parts[x][0], False, len(parts[x][1]), parts[x][2])))
        self.where = [0] * len(self.key)
        for i, kids in enumerate(self.kids):
            for c in kids:
                self.where[c] = self.tree.kids[self.where[i]][place[c]]


# Alignment.

BITS = 1 << 27  # of rows kept at once; longer lists are cut in two first


def _rows(a: tuple, b: tuple, keep: bool) -> tuple[list[bytes], int]:
    """Bit rows of the longest common subsequence's table (a zero where it grows), by additions of whole rows."""
    where: dict = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = row = (1 << len(b)) - 1
    out = []
    for x in a:
        hit = row & where.get(x, 0)
        row = (row + hit | row - hit) & full
        if keep:
            out.append(row.to_bytes(len(b) // 8 + 1, "little"))
    return out, row


def _longest(a: tuple, b: tuple) -> list[tuple[int, int]]:
    if not a or not b:
        return []
    if len(a) * len(b) > BITS and len(a) > 1:
        half = len(a) // 2
        grown = lambda x, y: np.r_[0, np.cumsum(1 - np.unpackbits(np.frombuffer(_rows(x, y, False)[1].to_bytes(len(y) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(y)].astype(np.int64))]
        k = int(np.argmax(grown(a[:half], b) + grown(a[half:][::-1], b[::-1])[::-1]))
        return _longest(a[:half], b[:k]) + [(i + half, j + k) for i, j in _longest(a[half:], b[k:])]
    rows, _ = _rows(a, b, True)
    bit = lambda i, j: rows[i][j >> 3] >> (j & 7) & 1
    out, i, j = [], len(a), len(b)
    while i and j:
        if bit(i - 1, j - 1):
            j -= 1
        else:
            i -= 1
            if not i or bit(i - 1, j - 1):
                j -= 1
                out.append((i, j))
    return out[::-1]


@functools.lru_cache(1 << 12)
def align(a: tuple, b: tuple) -> tuple[tuple[int, int], ...]:
    """Pairs of places of a longest common subsequence; common ends are paired first."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    middle = [(i + start, j + start) for i, j in _longest(a[start : len(a) - end], b[start : len(b) - end])]
    return (*((i, i) for i in range(start)), *middle, *((len(a) - k, len(b) - k) for k in range(end, 0, -1)))


class _Out:
    """Node of a wrapper in the making, from nodes of several trees."""

    def __init__(self, key: str, optional: bool, sources: list[tuple[Tree, int]]):
        self.key, self.optional, self.sources, self.kids, self.loops, self.same = key, optional, sources, [], [], None

    def now(self) -> _Out:
        return self if self.same is None else self.same.now()


def merge(trees: list[Tree]) -> Tree:
    """The trees aligned to one: matched children merge, a mismatch repeats its neighbour of the same key or becomes optional."""
    root = _Out("", False, [(t, 0) for t in trees])
    stack = [root]
    while stack:
        node = stack.pop()
        rows: dict[tuple, list[tuple[Tree, int]]] = {}
        for t, i in node.sources:
            rows.setdefault(t.row(i), []).append((t, i))
        entries: list[_Out] = []
        loops: list[tuple[_Out, _Out]] = []
        for n, ((keys, optional, groups), own) in enumerate(sorted(rows.items(), key=lambda x: (-len(x[1]), x[0]))):
            merged: list[_Out] = []
            at: list[_Out] = []
            kid = lambda j: [(t, t.kids[i][j]) for t, i in own]  # noqa: B023, E731

            def put(e: _Out, merged=merged, alone=n > 0) -> _Out:
                if alone and merged and merged[-1].key == e.key:  # a mismatch next to its like
                    merged[-1].sources += e.sources
                    e.same = merged[-1]
                    loops.append((e.same, e.same))  # noqa: B023
                    return e.same
                e.optional |= alone
                merged.append(e)
                return e

            i = j = 0
            for x, y in (*align(tuple(e.key for e in entries), keys), (len(entries), len(keys))):
                for e in entries[i:x]:
                    put(e)
                at += [put(_Out(keys[k], optional[k], kid(k))) for k in range(j, y)]
                if x < len(entries):
                    entries[x].sources += kid(y)
                    entries[x].optional |= optional[y]
                    merged.append(entries[x])
                    at.append(entries[x])
                i, j = x + 1, y + 1
            loops += [(at[a], at[b]) for a, b in groups]
            entries = merged
        index = {id(e): k for k, e in enumerate(entries)}
        node.kids = entries
        node.loops = sorted({tuple(sorted((index[id(a.now())], index[id(b.now())]))) for a, b in loops})
        node.sources = []
        stack += entries
    return Tree(_preorder(root, lambda e: e.kids, lambda e: (e.key, e.optional, len(e.kids), e.loops)))


def parse(tree: Tree, wrapper: Tree) -> list[int]:
    """The wrapper's node of each node of a tree. One that the alignment leaves out repeats the nearest of its key; -1 where there is none."""
    to = [-1] * len(tree.key)
    to[0] = 0
    for i, kids in enumerate(tree.kids):  # parents come before their children
        if to[i] < 0 or not kids:
            continue
        there = wrapper.kids[to[i]]
        keys = tuple(wrapper.key[w] for w in there)
        found = dict(align(tuple(tree.key[c] for c in kids), keys))
        places: dict[str, list[int]] = {}
        if len(found) < len(kids):
            for w, key in enumerate(keys):
                places.setdefault(key, []).append(w)
        near = 0
        for k, c in enumerate(kids):
            at = found.get(k)
            if at is None and (own := places.get(tree.key[c])):
                n = bisect_left(own, near)
                at = min(own[max(0, n - 1) : n + 1], key=lambda w: (abs(w - near), w))  # noqa: B023
            if at is not None:
                to[c], near = there[at], at
    return to


def expression(tree: Tree) -> str:
    """The wrapper as a union-free regular expression, for reading."""
    said = [""] * len(tree.key)
    for i in range(len(tree.key) - 1, -1, -1):
        parts = [f"({said[c]})?" if tree.optional[c] else said[c] for c in tree.kids[i]]
        for a, b in sorted(tree.loops[i], key=lambda x: (x[1] - x[0], x)):
            parts[a] = "(" + parts[a]
            parts[b] += ")+"
        inner, key = "".join(parts), tree.key[i]
        said[i] = "#PCDATA" if key == TEXT else f"<{key}>{inner}</{key.partition('|')[0]}>" if key else inner
    return said[0]


# Evidence of a slot: pages, characters, characters in links, least and greatest checksum of its text, up to three page contents.


def evidence_of(page: Page) -> list[list]:
    """Evidence of each text slot of a page's tree."""
    found: list[list] = [[1, 0, 0, 0, 0, []] for _ in page.tree.leaves]
    own = hashlib.blake2b(digest_size=6)
    for node, text, links, _, apart in page.blocks:
        x = found[page.tree.leaves[page.where[node]]]
        data = text.encode("utf-8", "surrogatepass")
        x[1], x[2], x[3] = x[1] + len(text), x[2] + links, zlib.crc32(data, x[3])
        if not apart and links * 2 <= len(text):
            own.update(data + b"\n")
    content = own.hexdigest()  # of what may be main text, so that copies of a page count once
    for x in found:
        x[4], x[5] = x[3], [content]
    return found


def add_evidence(x: list, y: list) -> None:
    if not x[0]:
        x[:] = [*y[:5], list(y[5])]
    else:
        x[0], x[1], x[2], x[3], x[4] = x[0] + y[0], x[1] + y[1], x[2] + y[2], min(x[3], y[3]), max(x[4], y[4])
        x[5] = sorted({*x[5], *y[5]})[:3]


def merged_rows(rows: list[tuple[str, str]]) -> tuple[Tree, list[list]]:
    """One wrapper of (tree, evidence) rows, with the evidence of its slots."""
    by: dict[str, list[list]] = {}
    for tree, evidence in rows:
        own = by.setdefault(tree, [])
        for k, x in enumerate(json.loads(evidence)):
            if k == len(own):
                own.append(x)
            else:
                add_evidence(own[k], x)
    trees = [(Tree.load(t), by[t]) for t in sorted(by)]
    if len(trees) == 1:
        return trees[0]
    wrapper = merge([t for t, _ in trees])
    found: list[list] = [[0, 0, 0, 0, 0, []] for _ in wrapper.leaves]
    for tree, own in trees:
        to = parse(tree, wrapper)
        for i, k in tree.leaves.items():
            if to[i] in wrapper.leaves:
                add_evidence(found[wrapper.leaves[to[i]]], own[k])
    return wrapper, found


def aside_slots(evidence: list[list]) -> list[int]:
    """Slots that are not main text where no article says so: three pages of different contents hold the same in it, or it is mostly links."""
    return [k for k, (_, chars, links, low, high, contents) in enumerate(evidence) if low == high and len(contents) >= 3 or links * 2 > max(chars, 1)]


def main_text(page: Page, wrapper: Tree, aside: frozenset) -> str:
    """Texts of the page's slots inside its article, or of its other slots that are not aside if it has none."""
    own = [b for b in page.blocks if not b[4]]
    if any(b[3] for b in own):
        return "\n".join(b[1] for b in own if b[3])
    to = parse(page.tree, wrapper) if aside else []
    return "\n".join(b[1] for b in own if not aside or wrapper.leaves.get(to[page.where[b[0]]]) not in aside)


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)), F.lit(""))


def infer_wrappers(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per host: host, n_shapes (distinct folded trees), expression, tree, aside (JSON list of slots that are not main text).

    Null or empty html is a page without elements, a null url belongs to the host "". Repeated rows count as pages, but not as further
    contents. Trees are merged in the order of their text, so ties and the order of rows change nothing. An empty table
    has no wrapper. Other columns are not read.
    """

    def reduce_pages(batches):
        for batch in batches:
            found: dict[tuple[str, str], list] = {}
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = Page(source or "")
                own = found.setdefault((host, page.tree.dump()), [])
                for k, x in enumerate(evidence_of(page)):
                    if k == len(own):
                        own.append(x)
                    else:
                        add_evidence(own[k], x)
            columns = list(zip(*((h, t, json.dumps(e)) for (h, t), e in found.items()), strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["host", "tree", "evidence"])

    def level(key, table):
        rows = table.to_pylist()
        shapes = len({r["tree"] for r in rows}) if rows[0]["shapes"] is None else sum(r["shapes"] for r in rows)
        wrapper, evidence = merged_rows([(r["tree"], r["evidence"]) for r in rows])
        return pa.table({"host": [key[0].as_py()], "tree": [wrapper.dump()], "evidence": [json.dumps(evidence)], "bucket": pa.array([key[1].as_py()], pa.int64()), "shapes": pa.array([shapes], pa.int64())})

    def last(key, table):
        rows = table.to_pylist()
        wrapper, evidence = merged_rows([(r["tree"], r["evidence"]) for r in rows])
        return pa.table({"host": [key[0].as_py()], "n_shapes": pa.array([sum(r["shapes"] for r in rows)], pa.int64()), "expression": [expression(wrapper)], "tree": [wrapper.dump()], "aside": [json.dumps(aside_slots(evidence))]})

    read = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    trees = read.mapInArrow(reduce_pages, "host string, tree string, evidence string").withColumns({"bucket": F.xxhash64("tree"), "shapes": F.lit(None).cast("long")})
    for buckets in BUCKETS[:-1]:
        trees = trees.withColumn("bucket", F.pmod("bucket", F.lit(buckets))).groupBy("host", "bucket").applyInArrow(level, "host string, tree string, evidence string, bucket long, shapes long")
    return trees.groupBy("host").applyInArrow(last, "host string, n_shapes long, expression string, tree string, aside string")


def extract_pages(pages: DataFrame, wrappers: DataFrame | None = None, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page by its host's wrapper.

    Null or empty html gives an empty text; a null url belongs to the host "". Every row gives a row, repeated ones
    too; an empty table gives an empty result. Extra columns are not read. Text is never cut, at no depth of elements; a tag that
    never ends ends the page, as browsers have it. A page of a host without a wrapper gives all that is not in a boilerplate container.
    """
    wrappers = infer_wrappers(pages, url_col=url_col, html_col=html_col) if wrappers is None else wrappers
    id_type, url_type = (pages.schema[c].dataType.simpleString() for c in (id_col, url_col))

    def kernel(batches):
        known: dict[tuple, tuple[Tree, frozenset]] = {}
        for batch in batches:
            texts = []
            for source, *wrapper in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True):
                got = known.get(tuple(wrapper))
                if got is None:
                    if len(known) > 1000:
                        known.clear()
                    got = known[tuple(wrapper)] = Tree.load(wrapper[0] or '[["",false,0,[]]]'), frozenset(json.loads(wrapper[1] or "[]"))
                texts.append(main_text(Page(source or ""), *got))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    read = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    joined = read.join(wrappers.select("host", "tree", "aside"), "host", "left").select("page_id", "url", "html", "tree", "aside")
    return joined.mapInArrow(kernel, f"page_id {id_type}, url {url_type}, text string, n_chars long")
