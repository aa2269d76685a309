"""Main text of pages by wrapper induction.

Each host has a pivot, a page of median length, whose tree of blocks is the host's wrapper
(siblings of one label are one slot).  Every page's tree is aligned with it by simple tree
matching: the heaviest order-keeping matching of equal labels, children of matched parents only.
What has no match hangs below its nearest matched block, by its labels, so pages share such slots too.

Spark counts each line of text by host and slot over all pages.  A line on most of a host's
pages, and on some that differ, is template.  All other text varies; each slot of the wrapper
gets the varying characters below it (links aside), and the content is the deepest slot
that holds over half of them.  Names come second: of the slots that hold over half, an article
or main element is taken first, and a part that is named as a menu, form, comments and so
on is left out if varying text remains elsewhere, and else is taken for what it holds.  Pages without
a wrapper, or that have nothing at its content, are read by their own markup in the same way.

Nothing depends on how pages are dealt: the pivot is chosen by length and hash, counts are exact,
and a wrapper is as large as one page.
"""

from __future__ import annotations

import hashlib
import html
import pickle
import re
import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import slices, stage

# HTML's element kinds, and names that mark parts which are not the article.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe svg math object xmp noembed noframes".split())
ENDS_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "optgroup": ("option", "optgroup"), "tbody": ("tr", "td", "th", "thead", "tbody"), "thead": (), "tfoot": ("tr", "td", "th", "tbody")}
KEEPS_IN = set("html body article main section div ul ol dl table td th aside nav header footer form".split())
NOT_ARTICLE = set("nav footer aside form menu dialog button select input fieldset head search".split())
NAMES = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar sidebars aside widget widgets related recommended trending nav navbar navigation menu menus"
    " breadcrumb breadcrumbs pagination pager footer masthead topbar cookie cookies consent gdpr notice notices alert alerts newsletter subscribe subscription signup login modal popup paywall"
    " comment comments commentlist respond disqus replies share sharing social".split()
)
#: Words that say nothing of their own beside one of NAMES in a class such as "comment-list".
PLAIN = set(
    "area bar block body bottom box button buttons card cell col column component container content element float fixed footer global grid group head header holder id inner item items left"
    " link links list main mini mobile module outer page panel post posts primary right row section secondary site slot small sticky sub text title top unit wrap wrapper article area".split()
)
ROLES = set("navigation banner contentinfo complementary search form alert dialog menu menubar".split())

TEMPLATE_PART, TEMPLATE_PAGES = 0.6, 3
DEPTH = 100  # blocks nested deeper count as part of the one at this depth
HOSTS = 2000

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>""", re.S
)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
_WORDS = re.compile("[a-z]+")


def names_part(word: str) -> bool:
    """Whether a class or id says that its part is no article: one of NAMES, alone or beside plain words only."""
    words = _WORDS.findall(word)
    return not NAMES.isdisjoint(words) and all(w in NAMES or w in PLAIN for w in words)


class Node:
    """A block element: its label, and text runs and blocks in page order."""

    __slots__ = ("tag", "label", "named", "items", "slot")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.items, self.slot = tag, [], None
        self.label, self.named = tag, tag in NOT_ARTICLE
        if attributes:
            for m in _ATTRIBUTE.finditer(attributes):
                value = (m[2] or m[3] or m[4] or "").lower()
                self.label += f" {m[1].lower()}={'-'.join(_WORDS.findall(value))}"
                if tag not in ("html", "body", "article", "main"):
                    self.named = self.named or (not ROLES.isdisjoint(value.split()) if m[1].lower() == "role" else any(map(names_part, value.split())))

    def blocks(self) -> list[Node]:
        return [i for i in self.items if type(i) is Node]


def parse(page: str) -> Node:
    """The page's tree of block elements.  Inline elements are part of their block's text;
    a run is ``[text, characters in links]``.  Never fails: what is no markup is text."""
    root = Node("html")
    stack, names, deeper, linked = [root], ["html"], [], 0
    at, size = 0, len(page)

    def text(part: str) -> None:
        if "&" in part:
            part = html.unescape(part)
        items = stack[-1].items
        if items and type(items[-1]) is list:
            items[-1][0].append(part)
        else:
            if not part.strip():
                return
            items.append([[part], 0])
        if linked:
            items[-1][1] += len(part)

    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, closing, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if closing:
            if tag == "a":
                linked = max(0, linked - 1)
            if tag in INLINE:
                continue
            if tag in deeper:
                del deeper[len(deeper) - 1 - deeper[::-1].index(tag) :]
                continue
            for i in range(len(names) - 1, 0, -1):
                if names[i] == tag:
                    del stack[i:], names[i:]
                    linked = 0
                    break
                if names[i] in KEEPS_IN and tag not in KEEPS_IN:
                    break
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            at = size if end is None else page.find(">", end.end()) + 1 or size
            continue
        if tag in INLINE:
            if tag == "br":
                text(" ")
            elif tag == "a":
                linked += 1
            continue
        if tag in ("html", "body", "tbody"):
            if tag == "body" and "body" not in names:
                root.items.append(Node("body", attributes))
                del stack[1:], names[1:]
                stack.append(root.items[-1])
                names.append("body")
            continue
        closes = ("p",) if tag in ENDS_P else SIBLINGS.get(tag, ())
        if closes:
            for i in range(len(names) - 1, 0, -1):
                if names[i] in closes:
                    del stack[i:], names[i:]
                    if tag != "tr" and tag not in ("tbody", "tfoot"):
                        break
                elif names[i] in KEEPS_IN:
                    break
        linked = 0
        node = Node(tag, attributes)
        stack[-1].items.append(node)
        if tag in VOID or attributes.endswith("/"):
            continue
        if len(stack) < DEPTH:
            stack.append(node)
            names.append(tag)
        elif len(deeper) < DEPTH:
            deeper.append(tag)
    return root


def text_of(item: list) -> str:
    return " ".join("".join(item[0]).split())


def merged(nodes: list[Node]) -> dict[str, list[Node]]:
    """The blocks below some nodes by label, in the order in which labels first appear."""
    out: dict[str, list[Node]] = {}
    for n in nodes:
        for c in n.blocks():
            out.setdefault(c.label, []).append(c)
    return out


# A wrapper's slot: its label, whether it is named, and the slots below it by label, in order.
Wrapper = tuple[str, bool, dict]


def wrapper_of(label: str, nodes: list[Node]) -> Wrapper:
    return label, any(n.named for n in nodes), {k: wrapper_of(k, group) for k, group in merged(nodes).items()}


def heaviest(places: list[int], weights: list[int]) -> list[int]:
    """Which of the numbered things make the heaviest sequence of rising places (all different)."""
    tops: list[int] = []  # places at which the best weight so far rises, with that weight and thing
    best: list[tuple[int, int]] = []
    before: list[int] = []
    for i, (place, weight) in enumerate(zip(places, weights, strict=True)):
        at = bisect_left(tops, place)
        before.append(best[at - 1][1] if at else -1)
        total = weight + (best[at - 1][0] if at else 0)
        end = at
        while end < len(tops) and best[end][0] <= total:
            end += 1
        tops[at:end], best[at:end] = [place], [(total, i)]
    out, i = [], best[-1][1] if best else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(groups: dict[str, list[Node]], slots: dict[str, Wrapper]) -> tuple[int, list[tuple[str, list]]]:
    """Simple tree matching of a page's blocks with a wrapper's slots: its size, and the labels that
    match with the matching below each.  Labels differ on either side, so any two blocks meet once."""
    order = {label: i for i, label in enumerate(slots)}
    common = [label for label in groups if label in order]
    below = [align(merged(groups[label]), slots[label][2]) for label in common]
    kept = heaviest([order[label] for label in common], [1 + size for size, _ in below])
    return sum(1 + below[i][0] for i in kept), [(common[i], below[i][1]) for i in kept]


def key(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _slot(parent: int, label: str, matched: bool) -> int:
    return key(f"{parent} {'=' if matched else '~'} {label}")


ROOT = 0


class Page:
    """A page's tree with each node's slot and the wrapper's slot (anchor) it hangs at."""

    def __init__(self, page: str, wrapper: Wrapper | None):
        self.root = parse(page)
        self.slot: dict[int, int] = {id(self.root): ROOT}
        self.anchor: dict[int, int] = {id(self.root): ROOT}
        if wrapper is not None:
            groups = merged([self.root])
            self._place(groups, align(groups, wrapper[2])[1], ROOT, ROOT)

    def _place(self, groups: dict[str, list[Node]], pairs: list[tuple[str, list]], parent: int, anchor: int) -> None:
        found = dict(pairs)
        for label, nodes in groups.items():
            slot = _slot(parent, label, label in found)
            here = slot if label in found else anchor
            for n in nodes:
                self.slot[id(n)], self.anchor[id(n)] = slot, here
            self._place(merged(nodes), found.get(label, []), slot, here)

    def lines(self) -> Iterator[tuple[Node, str, int]]:
        """All lines of text in page order, with their block and their characters in links."""
        stack = [iter([self.root])]
        owners = [self.root]
        while stack:
            item = next(stack[-1], None)
            if item is None:
                stack.pop()
                owners.pop()
            elif type(item) is list:
                if line := text_of(item):
                    yield owners[-1], line, min(item[1], len(line))
            else:
                stack.append(iter(item.items))
                owners.append(item)


def plain(chars: int, links: int) -> int:
    """Characters of a line that count as text: none if half of them are links."""
    return chars - links if 2 * links < chars else 0


class Content:
    """Where a host's pages, or one page, have their content, by the varying text at the slots."""

    def __init__(self, wrapper: Wrapper, mass: dict[int, int]):
        self.parent: dict[int, int] = {}
        self.label: dict[int, str] = {}
        self.named: set[int] = set()
        self.total: dict[int, int] = {}

        def walk(slot: int, node: Wrapper) -> int:
            self.label[slot] = node[0]
            if node[1]:
                self.named.add(slot)
            total = mass.get(slot, 0)
            for label, child in node[2].items():
                below = _slot(slot, label, True)
                self.parent[below] = slot
                total += walk(below, child)
            self.total[slot] = total
            return total

        walk(ROOT, wrapper)
        self._forget_names()
        self.slot = self._choose()

    def _outer(self) -> list[int]:
        """Named slots that lie in no other named slot."""

        def inside(slot: int) -> bool:
            while (slot := self.parent.get(slot, -1)) != -1:
                if slot in self.named:
                    return True
            return False

        return [s for s in self.named if not inside(s)]

    def _forget_names(self) -> None:
        """While nearly all text lies in parts that are named, the name of the largest says nothing."""
        while (outer := self._outer()) and 10 * (self.total[ROOT] - sum(self.total[s] for s in outer)) < self.total[ROOT]:
            self.named.discard(max(outer, key=lambda s: (self.total[s], s)))

    def mass(self, slot: int) -> int:
        """Text below a slot but for named parts."""
        if not hasattr(self, "_less"):
            self._less = defaultdict(int)
            for s in self._outer():
                at = s
                while at != -1:
                    self._less[at] += self.total[s]
                    at = self.parent.get(at, -1)
        return self.total[slot] - self._less[slot]

    def _choose(self) -> int | None:
        whole = self.mass(ROOT)
        if not whole:
            return None
        children = defaultdict(list)
        for s, p in self.parent.items():
            children[p].append(s)
        chain, at = [], ROOT
        while True:
            top = max(children[at], key=lambda s: (self.mass(s), s), default=None)
            if top is None or 2 * self.mass(top) <= whole or self.label[top].split(" ")[0] in ("p", "h1", "h2", "h3", "li", "td", "tr", "blockquote", "pre"):
                break
            chain.append(top)
            at = top
        for wanted in (lambda n: n.startswith("article"), lambda n: n.startswith("main") or "role=main" in n):
            for s in chain:
                if wanted(self.label[s]):
                    return s
        # a block around the content whose other text is little (a title, a date) belongs to it
        while len(chain) > 1 and self.label[chain[-2]].split(" ")[0] not in ("html", "body") and 3 * self.mass(chain[-2]) <= 4 * self.mass(chain[-1]):
            chain.pop()
        return chain[-1] if chain else None


def main_text(page: Page, content: Content | None, template: frozenset[tuple[int, int]] | set) -> str:
    """The page's article: its blocks' texts in page order, one to a line."""

    def is_named(node: Node) -> bool:
        return node.named and (content is None or page.anchor[id(node)] != page.slot[id(node)] or page.slot[id(node)] in content.named)

    def tops(node: Node, wanted) -> list[Node]:
        out = []
        for c in node.blocks():
            if wanted(c):
                out.append(c)
            elif not is_named(c) and c.tag != "header":
                out += tops(c, wanted)
        return out

    regions = [] if content is None or content.slot is None else tops(page.root, lambda n: page.slot[id(n)] == content.slot)
    lines: list[str] = []

    def walk(node: Node, inside: bool) -> None:
        for item in node.items:
            if type(item) is list:
                line = text_of(item)
                if line and (page.slot[id(node)], key(line)) not in template:
                    lines.append(line)
            elif not is_named(item) and (inside or item.tag != "header"):
                walk(item, inside)

    for region in regions or [page.root]:
        walk(region, bool(regions))
    return "\n".join(lines)


def alone(page: str) -> str:
    """The main text of a page by its own markup: the page is its own wrapper."""
    return _read_alone(Page(page, wrapper_of("html", [parse(page)])), set())


def _read_alone(own: Page, template: set[tuple[int, int]]) -> str:
    mass: dict[int, int] = defaultdict(int)
    for node, line, links in own.lines():
        if (own.slot[id(node)], key(line)) not in template:
            mass[own.anchor[id(node)]] += plain(len(line), links)
    return main_text(own, Content(wrapper_of("html", [own.root]), mass), template)


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _with_host(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.record_batch([*b.columns, pa.array([host_of(u) for u in b.column("url").to_pylist()], pa.string())], names=[*b.schema.names, "__host"])


def _pack(value) -> bytes:
    return zlib.compress(pickle.dumps(value))


class _Unpacked(dict):
    """Packed values by their bytes; a task's pages have few hosts at a time."""

    def __missing__(self, raw: bytes):
        if len(self) >= HOSTS:
            self.clear()
        value = self[raw] = pickle.loads(zlib.decompress(raw))
        return value


def _pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each host the page of this part that is nearest to the median length: ``host, far, hash, wrapper``."""
    best: dict[str, tuple[int, int, str]] = {}

    def emit() -> pa.RecordBatch:
        found = [_pack(wrapper_of("html", [parse(page)])) for _, _, page in best.values()]
        far, hashes = [b[0] for b in best.values()], [b[1] for b in best.values()]
        return pa.record_batch({"__host": list(best), "far": pa.array(far, pa.int64()), "hash": pa.array(hashes, pa.int64()), "wrapper": pa.array(found, pa.binary())})

    for whole in batches:
        for batch in slices(whole, "html"):
            for host, page, median in zip(*(batch.column(c).to_pylist() for c in ("__host", "html", "median")), strict=True):
                far = abs(len(page) - median)
                if host not in best or far <= best[host][0]:
                    own = far, key(page), page
                    if host not in best or own < best[host]:
                        best[host] = own
                if len(best) >= HOSTS:
                    yield emit()
                    best.clear()
    if best:
        yield emit()


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every different line of a page's slots: ``__host, slot, line, page, anchor, text`` (characters outside links, all such lines)."""
    known = _Unpacked()
    for whole in batches:
        for batch in slices(whole, "html"):
            out: dict[str, list] = {n: [] for n in ("__host", "slot", "line", "page", "anchor", "text")}
            for host, page, raw in zip(*(batch.column(c).to_pylist() for c in ("__host", "html", "wrapper")), strict=True):
                tree, digest = Page(page, known[raw]), key(page)
                found: dict[tuple[int, int], list[int]] = {}
                for node, line, links in tree.lines():
                    text = plain(len(line), links)
                    have = found.setdefault((tree.slot[id(node)], key(line)), [tree.anchor[id(node)], 0])
                    have[1] += text
                for (slot, line), (anchor, text) in found.items():
                    for name, value in zip(out, (host, slot, line, digest, anchor, text), strict=True):
                        out[name].append(value)
            yield pa.record_batch([pa.array(v, pa.string() if n == "__host" else pa.int64()) for n, v in out.items()], names=list(out))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for raw, anchors in zip(b.column("wrapper").to_pylist(), b.column("anchors").to_pylist(), strict=True):
            wrapper = pickle.loads(zlib.decompress(raw))
            mass = {a["anchor"]: a["mass"] for a in anchors or ()}
            template = frozenset((t["slot"], t["line"]) for a in anchors or () for t in a["template"])
            out.append(_pack((wrapper, mass, template)))
        yield pa.record_batch([b.column("__host"), pa.array(out, pa.binary())], names=["__host", "host"])


def wrappers(keyed: DataFrame) -> DataFrame:
    """``__host, host``: each host's wrapper, varying text by slot and template lines, from all its pages (``__host, html``)."""
    pages = keyed.where("__host <> '' AND html <> ''").select("__host", "html")
    sizes = stage(pages.groupBy("__host").agg(F.percentile_approx(F.length("html"), 0.5, 1000).cast("long").alias("median"), F.count("*").alias("pages")), "wrapper-hosts")
    near = pages.join(sizes.select("__host", "median"), "__host").mapInArrow(_pivots, "__host string, far long, hash long, wrapper binary")
    pivots = stage(near.groupBy("__host").agg(F.min(F.struct("far", "hash", "wrapper")).alias("p")).select("__host", "p.wrapper"), "wrapper-pivots")
    lines = pages.join(pivots, "__host").mapInArrow(_lines, "__host string, slot long, line long, page long, anchor long, text long")
    where = ["__host", "anchor", "slot", "line"]
    # copies of a page first, so that a hot host's lines are combined before they meet
    kinds = lines.groupBy(*where, "page").agg(F.count("*").alias("n"), F.sum("text").alias("text"))
    counts = kinds.groupBy(*where).agg(F.sum("n").alias("n"), F.count("*").alias("kinds"), F.sum("text").alias("text"))
    told = counts.join(sizes.select("__host", "pages"), "__host")
    template = (F.col("n") >= TEMPLATE_PART * F.col("pages")) & (F.col("kinds") >= TEMPLATE_PAGES) & (F.col("pages") > TEMPLATE_PAGES)
    # no more template lines than a page has lines, over TEMPLATE_PART; no more anchors than a page has blocks
    anchors = told.groupBy("__host", "anchor").agg(
        F.sum(F.when(template, 0).otherwise(F.col("text"))).alias("mass"), F.collect_list(F.when(template, F.struct("slot", "line"))).alias("template")
    )
    hosts = anchors.groupBy("__host").agg(F.collect_list(F.struct("anchor", "mass", "template")).alias("anchors"))
    return pivots.join(hosts, "__host", "left").mapInArrow(_packed, "__host string, host binary")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known, contents = _Unpacked(), {}
    for whole in batches:
        for batch in slices(whole, "html"):
            out = []
            for page, raw in zip(*(batch.column(c).to_pylist() for c in ("html", "host")), strict=True):
                if not page:
                    out.append("")
                    continue
                if raw is None:
                    out.append(alone(page))
                    continue
                wrapper, mass, template = known[raw]
                if raw not in contents:
                    if len(contents) >= HOSTS:
                        contents.clear()
                    contents[raw] = Content(wrapper, mass)
                tree, content = Page(page, wrapper), contents[raw]
                if content.slot is None or content.slot not in tree.slot.values():
                    out.append(_beside(page, tree, template))
                else:
                    out.append(main_text(tree, content, template))
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], names=["page_id", "url", "text"])


def _beside(page: str, tree: Page, template: frozenset) -> str:
    """A page that has nothing at its host's content, by its own markup, without the host's template lines."""
    own = Page(page, wrapper_of("html", [tree.root]))
    gone = set()
    for (node, line, _), (there, _, _) in zip(own.lines(), tree.lines(), strict=True):
        if (tree.slot[id(there)], key(line)) in template:
            gone.add((own.slot[id(node)], key(line)))
    return _read_alone(own, gone)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: ``page_id, url, text``.

    A null or empty page has the empty text.  A page without a host, or that has nothing where its
    host's pages have their content, is read by its own markup.  Lines are template only where they recur on
    most of a host's pages, and on pages that differ, so copies of a page keep their text.
    Repeated rows give repeated rows; only the three named columns are read.
    """
    named = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    keyed = named.mapInArrow(_with_host, "page_id long, url string, html string, __host string")
    found = stage(wrappers(keyed), "wrappers")
    return keyed.join(found, "__host", "left").mapInArrow(_extract, "page_id long, url string, text string")
