"""HTML extraction by wrapper induction.

Pages of one host come from few templates. Every page of a host is parsed to a tree, like siblings folded into one node of
a path, and the trees are matched by these paths from the root down. A path whose text differs between pages, or which some pages
lack, is a slot; other paths are template. Counts, lengths and least and greatest hashes of each path are added up over all pages of
the host, so no page moves and a host of any size is judged by all of it; paths on fewer than a RARE-th of its pages are left
to each page, so what is known of a host is bounded by the size of a page.

The wrapper is the way down the slots: at each node the slots that hold at least a LIGHT-th of the text of the greatest one are
heavy. Where one container is heavy and beside it stand but light containers without a main heading, template or links, the way
goes on into it; where several slots are heavy, or headings and paragraphs stand beside, it ends, as it does at an article or main
element. Light containers beside the way (teasers, adverts, menus, whatever they are called) are no content on any page. What
a page has beside the way that is rare on its host stays if it is as heavy as that on this page. Pages without the path,
and hosts of one page, are cut where the page's own elements point to.

The wrapper also holds the constant blocks: block elements whose path and whole text are the same on every page of a host
with at least MANY different pages. They are left out inside the region too, where they are less than half of its text;
where they are more, the pages are taken for copies of one text and nothing is left out. Constant headings stay, as part of
the text below them, unless a constant block holds them.

Names decide where structure does not: inside the region, elements that are never article text (scripts, styles, forms, menus,
asides, hidden ones, and those whose class, id or role names a menu, advert, notice, comment list or the like) are left out. A class
or id names one where a whole token of it does ("site-footer", not "with-sidebar"); ids of headings and paragraphs name nothing.
Where the element holds more than half of the page's text outside other boilerplate, its name counts only if half of that text is
in links or the element is a constant block; on the way of the wrapper it does not count. Inline elements join their text, block
elements and line breaks part it.

Defined cases: null and empty pages give an empty text; pages without markup are one text; broken nesting is closed as
browsers do for paragraphs, list items and table cells; a null url is a host of its own; repeated rows are extracted
each and count as pages of their host; very long pages are parsed whole; of slots that tie, all are heavy; other columns are ignored,
whatever their names; empty tables give empty tables. Elements deeper than MOST_DEPTH are siblings there: their text stays.
"""

from __future__ import annotations

import hashlib
import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.llm import text as X

MOST_DEPTH = 200
#: Different pages of a host from which a block that all of them have is template.
MANY = 8
#: Paths on fewer than a RARE-th of the pages are judged page by page; slots of less than a LIGHT-th of the greatest one's text are light.
RARE, LIGHT = 50, 4
# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROP = frozenset("script style noscript template head nav footer aside form button select textarea input iframe object svg canvas menu dialog video audio map math".split())
CONTAINERS = frozenset("html body div section article main td tr tbody table center".split())
CLOSE_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tr", "td", "th")}
HOLDERS = CONTAINERS | {"main"}
SCOPE = frozenset("html body div section article main td th table ul ol dl nav aside header footer form blockquote".split())
# Words of class, id and role that name boilerplate.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert sidebar widget widgets nav navbar navigation menu breadcrumb breadcrumbs footer masthead "
    "comment comments disqus respond replies share sharing social related recommended newsletter subscribe signup login search popup modal overlay toolbar pagination pager skip complementary contentinfo".split()
)
# Words beside those that leave them boilerplate.
NEUTRAL = frozenset(
    "site page global main primary secondary top bottom left right inner outer wrapper wrap container holder block box area bar section region list item items link links button buttons icon icons "
    "form panel body text title post posts article articles entry blog story stories count media this slot unit google wp js".split()
)
_WORD = re.compile(r"[a-z]{2,}")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    """An element; hard: its kind is never article text; called: its class, id or role names boilerplate; drop: either, as settled;
    constant: all pages of the host have it with the same text."""

    __slots__ = ("tag", "name", "drop", "hard", "parts", "called", "constant")

    def __init__(self, tag: str, name: str = "", drop: bool = False):
        self.tag, self.name, self.drop, self.hard = tag, name, drop, drop
        self.parts: list[Node | str] = []
        self.called = self.constant = False


HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TITLED = HEADINGS | {"p"}
TITLES = frozenset(("h1", "h2"))
# Words that name a header, and words beside them that make it an article's own.
HEADERS, OWN = frozenset(("header", "topbar")), frozenset("article post entry content story main".split())


def _boilerplate(value: str, inside: bool) -> bool:
    """Whether a class, id or role names boilerplate; headers are the article's own inside it or by name."""
    tokens = [set(_WORD.findall(_CAMEL.sub(" ", t).lower())) for t in value.split()]
    if any(words & BOILERPLATE and words <= BOILERPLATE | NEUTRAL for words in tokens):
        return True
    words = set().union(*tokens)
    return not inside and not words & OWN and any(w & HEADERS and w <= HEADERS | BOILERPLATE | NEUTRAL for w in tokens)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]

    def _close(self, tags: tuple[str, ...], scope: frozenset[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.open[i].tag
            if tag in tags:
                del self.open[i:]
                return
            if tag in scope:
                return

    def handle_starttag(self, tag, attrs):
        if tag in CLOSE_P:
            self._close(("p",), SCOPE)
        elif tag in CLOSES:
            self._close(CLOSES[tag], frozenset(("table", "ul", "ol", "dl", "select")) - {tag})
        name, drop, called = "", tag in DROP, False
        inside = any(n.tag in ("article", "main") for n in self.open)
        for k, v in attrs:
            if k in ("class", "id", "role") and v:
                if k == "class":
                    name = v.split()[0].replace("/", "|") if v.split() else ""
                called = called or (_boilerplate(v, inside) and tag not in ("html", "body", "article", "main") and not (k == "id" and tag in TITLED))
            elif k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "style" and v and "display:none" in v.replace(" ", "").lower()):
                drop = True
        if tag == "header" and not inside:
            drop = True
        node = Node(tag, name, drop)
        node.called = called
        self.open[-1].parts.append(node)
        if tag not in VOID and len(self.open) < MOST_DEPTH:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag and tag in ("svg", "path", "g"):
            self.open.pop()

    def handle_endtag(self, tag):
        if tag == "p" and not any(n.tag == "p" for n in self.open):
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return
            if tag in INLINE and self.open[i].tag not in INLINE and self.open[i].tag != "p":
                return

    def handle_data(self, data):
        self.open[-1].parts.append(data)


def parsed(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    _settle(b.root)
    return b.root


def _settle(root: Node) -> None:
    """Drops the elements called boilerplate, but those that hold most of the page's text and not as links."""
    sizes: dict[int, tuple[int, int]] = {}

    def visit(node: Node, linked: bool) -> tuple[int, int]:
        """Letters and signs under node outside dropped elements, and those in links."""
        n = in_links = 0
        for p in node.parts:
            if isinstance(p, str):
                m = len("".join(p.split()))
                n, in_links = n + m, in_links + (m if linked else 0)
            elif not p.drop:
                m, l = visit(p, linked or p.tag == "a")
                n, in_links = n + m, in_links + l
        if node.called:
            sizes[id(node)] = n, in_links
        return n, in_links

    total = visit(root, False)[0]
    stack = [root]
    while stack and sizes:
        node = stack.pop()
        if node.called and not node.drop:
            n, in_links = sizes[id(node)]
            node.drop = 2 * n <= total or 2 * in_links >= n
        if not node.drop:
            stack.extend(p for p in node.parts if isinstance(p, Node))


def text_of(node: Node, whole: bool = True) -> str:
    """The blocks under a node, each with single spaces, joined by one space; constant ones only of the whole text."""
    blocks: list[str] = []
    now: list[str] = []

    def flush() -> None:
        t = " ".join("".join(now).split())
        if t:
            blocks.append(t)
        now.clear()

    stack: list = [iter(node.parts)]
    ends: list[bool] = [True]
    while stack:
        part = next(stack[-1], None)
        if part is None:
            stack.pop()
            if ends.pop():
                flush()
        elif isinstance(part, str):
            now.append(part)
        elif part.tag in ("br", "hr"):
            now.append(" ")
        elif not part.drop and part.tag not in VOID and (whole or not part.constant):
            block = part.tag not in INLINE
            if block:
                flush()
            stack.append(iter(part.parts))
            ends.append(block)
    return " ".join(blocks)


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def shape(root: Node) -> dict[str, tuple[int, int]]:
    """The elements under containers all the way up, by path `tag.class/.../`, with length and hash of their text; text of a
    container itself by its path and `#text/`; the root always."""
    found: dict[str, list[str]] = {}

    def visit(node: Node, path: str, inside: bool) -> str:
        own, every = [], []
        for p in node.parts:
            if isinstance(p, str):
                own.append(p)
                every.append(p)
            elif not p.hard:
                below = f"{path}{p.tag}.{p.name}/"
                text = visit(p, below, inside and p.tag in HOLDERS)
                every.append(text if p.tag in INLINE else f" {text} ")
                if inside and (text := " ".join(text.split())):
                    found.setdefault(below, []).append(text)
        if inside and (text := " ".join("".join(own).split())):
            found.setdefault(path + "#text/", []).append(text)
        return "".join(every)

    found[""] = [visit(root, "", True)]
    return {path: (sum(map(len, texts)), _hash("\n".join(texts))) for path, texts in found.items()}


def blocks(root: Node) -> list[tuple[Node, int]]:
    """The block elements of a page that hold text outside boilerplate, with a hash of path and whole text; no headings."""
    found: list[tuple[Node, int]] = []

    def visit(node: Node, path: str) -> str:
        texts = []
        for p in node.parts:
            if isinstance(p, str):
                texts.append(p)
            elif not p.drop:
                texts.append(visit(p, f"{path}{p.tag}.{p.name}/"))
        text = " ".join(" ".join(texts).split())
        if text and node.tag not in INLINE and node.tag not in HEADINGS and node.tag not in ("#root", "html", "body", "article", "main"):
            found.append((node, _hash(path + "\n" + text)))
        return text

    visit(root, "")
    return found


def _tag(path: str) -> str:
    return path.rstrip("/").rpartition("/")[2].partition(".")[0]


def region(rows: list[tuple[str, int, int, bool]], pages: int) -> tuple[str, list[str]]:
    """The wrapper's way and the paths beside it that are no content, from (path, pages with it, length of all its texts, slot)."""
    mean = {path: total / n for path, n, total, slot in rows if slot and n * RARE >= pages}
    beside: dict[str, list[str]] = {}
    for path, *_ in rows:
        if path:
            beside.setdefault(path[: path.rfind("/", 0, -1) + 1], []).append(path)
    at, light = "", []
    while _tag(at) not in ("article", "main"):
        below = sorted(beside.get(at, []))
        varying = [p for p in below if mean.get(p) and _tag(p) != "a"]
        most = max((mean[p] for p in varying), default=0)
        heavy = [p for p in varying if LIGHT * mean[p] >= most]
        slight = [p for p in varying if LIGHT * mean[p] < most and _tag(p) in HOLDERS and not any(p < q < p + "\x7f" and _tag(q) in TITLES for q in mean)]
        away = [p for p in below if p in slight or p not in varying]
        if len(heavy) == 1 and _tag(heavy[0]) in HOLDERS and len(slight) == len(varying) - 1:
            at = heavy[0]
            light += away
            continue
        if _tag(at) in ("", "html", "body"):
            light += slight
        break
    return at, light


def induced(pages: list[str]) -> tuple[str, frozenset[str]] | None:
    """The wrapper of pages of one host; None if nothing varies."""
    found: dict[str, list[tuple[int, int]]] = {}
    for p in pages:
        for path, own in shape(parsed(p)).items():
            found.setdefault(path, []).append(own)
    rows = [(path, len(own), sum(n for n, _ in own), len(own) < len(pages) or len({h for _, h in own}) > 1) for path, own in found.items()]
    if not any(slot for *_, slot in rows):
        return None
    at, light = region(rows, len(pages))
    return at, frozenset(light)


def _along(root: Node, way: str, light: frozenset[str]) -> list[Node] | None:
    """The nodes of a page at the end of the wrapper's way, and those beside it that are rare on the host and as heavy; in page order."""
    steps = way.split("/")[:-1]
    ends: list[Node] = []
    odd: list[tuple[Node, int]] = []
    order: list[Node] = []

    def walk(node: Node, path: str, depth: int) -> None:
        for p in node.parts:
            if isinstance(p, Node) and not p.hard:
                below = f"{path}{p.tag}.{p.name}/"
                if depth < len(steps) and f"{p.tag}.{p.name}" == steps[depth]:
                    p.drop = False
                    order.append(p)
                    if depth + 1 == len(steps):
                        ends.append(p)
                    else:
                        walk(p, below, depth + 1)
                elif depth < len(steps) and not p.drop and p.tag in HOLDERS and below not in light:
                    order.append(p)
                    odd.append((p, len(text_of(p))))

    if not steps:
        ends = order = [root]
    walk(root, "", 0)
    if not ends:
        return None
    for node in ends:
        for p in node.parts:
            if isinstance(p, Node) and f"{way}{p.tag}.{p.name}/" in light:
                p.drop = True
    most = sum(len(text_of(n)) for n in ends)
    kept = {id(n) for n in ends} | {id(n) for n, size in odd if LIGHT * size >= most and not 2 * _linked(n) >= size > 0}
    return [n for n in order if id(n) in kept]


def _linked(node: Node) -> int:
    """Length of the text of a node's links."""
    return sum(len(text_of(p)) if p.tag == "a" else _linked(p) for p in node.parts if isinstance(p, Node) and not p.drop)


def _own_region(root: Node) -> list[Node]:
    """Where a page alone points to: its article or main elements, or else the whole of it."""
    found: list[Node] = []
    stack = [root]
    while stack:
        node = stack.pop()
        for p in reversed(node.parts):
            if isinstance(p, Node) and not p.drop:
                if p.tag in ("article", "main"):
                    found.append(p)
                else:
                    stack.append(p)
    return found or [root]


def extracted(html: str, wrapper: tuple[str, frozenset[str]] | None, constants: frozenset[int] = frozenset()) -> str:
    """The main text of a page under its host's wrapper and constant blocks."""
    if not html:
        return ""
    root = parsed(html)
    if constants:
        for node, key in blocks(root):
            node.constant = key in constants
            node.drop = node.drop or (node.constant and node.called)
    mains = _along(root, *wrapper) if wrapper is not None else None
    if mains is None:
        mains = _own_region(root)
    elif mains[0].tag not in ("article", "main"):
        named = [n for top in mains for n in (_own_region(top) if top.tag not in ("article", "main") else [top])]
        if 2 * sum(len(text_of(n)) for n in named) >= sum(len(text_of(n)) for n in mains):
            mains = named
    text = " ".join(t for t in map(text_of, mains) if t)
    if constants:
        slots_only = " ".join(t for n in mains if not n.constant and (t := text_of(n, False)))
        if 2 * len(slots_only) > len(text):
            return slots_only
    return text


def _statistics(batches):
    """For each host and path of a batch: pages with the path, the length of its texts, the least and the greatest hash. For each
    host and block that all its pages of the batch have (only these can be constant): the block's key and the number of these pages."""
    for batch in batches:
        found: dict[tuple[str, str], list[int]] = {}
        common: dict[str, set[int]] = {}
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            root = parsed(html)
            for path, (size, h) in shape(root).items():
                have = found.setdefault((host, path), [0, 0, h, h])
                have[:] = have[0] + 1, have[1] + size, min(have[2], h), max(have[3], h)
            if common.get(host, True):
                keys = {key for _, key in blocks(root)}
                common[host] = common[host] & keys if host in common else keys
        rows = [(host, path, None, *have) for (host, path), have in found.items()]
        rows += [(host, None, key, found[host, ""][0], 0, 0, 0) for host, keys in common.items() for key in keys]
        names = ["host", "path", "block", "n", "size", "low", "high"]
        kinds = [pa.string(), pa.string(), *[pa.int64()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)


def _regions(batches):
    for batch in batches:
        ways, lights = [], []
        for paths, pages in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
            rows = [(p["path"], p["n"], p["size"], p["slot"]) for p in paths]
            at, light = region(rows, pages) if any(r[3] for r in rows) else (None, None)
            ways.append(at)
            lights.append(light)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ways, pa.string()), pa.array(lights, pa.list_(pa.string())), batch.column(2)], names=["host", "way", "light", "constants"])


def _extract(batches):
    for whole in batches:
        for batch in X.slices(whole, "html"):
            sets = [frozenset(c or ()) for c in batch.column(5).to_pylist()]
            known = [None if w is None else (w, frozenset(x)) for w, x in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            texts = [extracted(h or "", w, c) for h, w, c in zip(batch.column(2).to_pylist(), known, sets, strict=True)]
            n = np.fromiter(map(len, texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(n)], names=["page_id", "url", "text", "n_chars"])


def host_of(url: str) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def wrappers(pages: DataFrame) -> DataFrame:
    """host, way and light paths of the wrapper, keys of the constant blocks, number of pages: induced from all pages of each host."""
    own = pages.where("html <> ''").select(host_of("url").alias("host"), "html")
    found = own.mapInArrow(_statistics, "host string, path string, block long, n long, size long, low long, high long")
    found = found.groupBy("host", "path", "block").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.min("low").alias("low"), F.max("high").alias("high"))
    found = X.written(found, "paths")
    # Every page has the root's path, so the greatest count is the host's number of pages.
    hosts = found.groupBy("host").agg(F.max("n").alias("pages"), F.count(F.lit(1)).alias("c"))
    different = own.select("host", F.xxhash64("html").alias("h")).distinct().groupBy("host").agg(F.count(F.lit(1)).alias("different"))
    hosts = X.written(hosts.join(different, "host"), "hosts")
    known = X.join_counted(found, hosts, ["host"], found.count())
    # A path of a RARE-th of the pages, a block of all pages: the lists of a host are no longer than RARE pages.
    told = known.where(F.when(F.col("block").isNull(), F.expr(f"n * {RARE} >= pages")).otherwise(F.expr(f"n = pages and different >= {MANY}")))
    path = F.when(F.col("block").isNull(), F.struct("path", "n", "size", F.expr("n < pages or low <> high").alias("slot")))
    told = told.groupBy("host").agg(F.collect_list(path).alias("paths"), F.collect_list("block").alias("constants"), F.max("pages").alias("pages"))
    told = told.mapInArrow(_regions, "host string, way string, light array<string>, constants array<long>")
    return told.join(hosts.select("host", F.col("pages").alias("c")), "host")


def extraction(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row for each row of pages(page_id, url, html)."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    found = X.written(wrappers(pages), "wrappers")
    pages = pages.withColumn("host", host_of("url"))
    # Wrappers of hosts that crowd the table are broadcast, the pages of the others are shuffled; pages without text have no wrapper.
    some = X.join_counted(pages.where("html <> ''"), found, ["host"], pages.count())
    columns = ["page_id", "url", "html", "way", "light", "constants"]
    bare = pages.where("html is null or html = ''").select("page_id", "url", "html", *(F.lit(None).cast(found.schema[c].dataType).alias(c) for c in columns[3:]))
    return some.select(*columns).union(bare).mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op5_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extraction(X.read(spark, sf_dir, "pages"))
