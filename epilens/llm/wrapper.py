"""Main text of web pages by wrappers inferred from pages of the same host.

A page is a stream of tag tokens and text slots. Its structure is a union-free
regular expression: tokens with their classes, slots, optional groups `(...)?`
and repeated groups `(...)+`. Wrappers are inferred by aligning streams:

1. in its task, a page's structure is folded: adjacent equal groups become
   `(...)+`, innermost first, so that pages differing in the number of
   paragraphs fold to one structure. Pages of a host with one structure are
   aligned text by text: a slot keeps the least and greatest hash of its texts
   and up to three of the pages (by their least hashes) that have it;
2. the structures of a host are merged pairwise in a tree: aligned tokens stay,
   a token run on one side only becomes optional, a group against a repeat of
   it the repeat, and texts that differ a varying slot;
3. the wrapper's slots are labelled. A slot is template if its text is the same
   on all of three or more different pages of the host that have it (but for
   headings). Slots within menus, headers, footers, sidebars, notices, adverts,
   forms, scripts, styles or reader comments are no content.

Extraction replays each page over its host's wrapper: a page's texts get the
labels of the slots that they fall on, and the text on the slots that are left
decides where the content is (`content_root`): in the articles, in the main
element, or all over the page; pages of one host may differ in this. The text of
an article or main element is content even where the host repeats it, and class
words around one (layout names) void it only if the page has text in another. A
header in an article goes as any header does, and readers' comments go with the
articles in them. Class words on elements of running text (a span) void nothing.
A host with fewer than three different pages has no template slots: there
elements and classes decide.

Cases: null or empty html gives empty text; a page without url or with an odd
url belongs to host ''; unclosed and stray tags are tolerated, at any depth;
character references are decoded once; a host with one page is its own wrapper;
repeated page_ids keep a row each; an empty table gives no rows. Lists of more
than `LCS_CELLS` pairs of children are aligned greedily instead of by their
longest common subsequence. Texts are compared by 32-bit hashes.
"""

from __future__ import annotations

import html as html_lib
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epilens.llm.common import BROADCAST_ROWS, Scratch

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>=]++|=\s*+\"[^\"]*+(?:\"|\Z)|=\s*+'[^']*+(?:'|\Z)|=(?!\s*+[\"']))*+)(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]+)))?")
_UNSEEN = re.compile(r"(?<![\w-])(?:display\s*:\s*none|visibility\s*:\s*hidden)(?![\w-])")
_SPACE = re.compile(r"\s+")

RAW = frozenset({"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noframes"})
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"})
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Elements that an opening tag closes when they are open in the same container.
CLOSES = {"p": BLOCK, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}), "option": frozenset({"option"})}
BOILER_TAGS = frozenset({"nav", "header", "footer", "aside", "form", "script", "style", "noscript", "template", "iframe", "head", "title", "button", "select", "option", "textarea", "menu", "dialog", "input", "label", "fieldset", "svg", "canvas", "object", "xmp", "noframes"})
BOILER_WORDS = frozenset("ad ads advert adverts advertisement advertising adslot banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer sidebar aside rail widget related recommended comment comments commentlist disqus reply replies cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login share sharing social pagination pager toolbar toc hidden".split())
BOILER_ROLES = frozenset({"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form", "note"})
#: What readers wrote: it is no content, articles in it included.
COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies respond responses response feedback discussion".split())
#: Words that may stand beside those: "article-comments".
_BESIDE = frozenset("article post posts thread form area section user reader".split())
#: Elements of running text: a class word doesn't make them boilerplate.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split())
#: Words of a class or id that only say where or how a part stands: "site-header", "comment-list".
PLAIN_WORDS = frozenset("site main global primary secondary top bottom left right upper lower inner outer box block area wrapper wrap container list item items link links section bar buttons button icons posts user reader".split())
HEADINGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})
#: Different pages that a template text must be on, and pairs of children up to which lists are aligned in full.
TEMPLATE_PAGES, LCS_CELLS = 3, 40_000
#: The element itself, or the page, is not boilerplate for its class, id or role.
KEPT_TAGS = frozenset({"html", "body", "article", "main"})


def _names(value: str, words: frozenset[str], beside: frozenset[str] = frozenset()) -> bool:
    """Whether a class or id token is one of the words, or is made of them and of plain words.

    "has-sidebar" and "overflow-hidden" are layout: their other word is neither.
    """
    for token in value.split():
        parts = [w for w in re.split(r"[^a-z]+", token) if len(w) > 1]
        if any(w in words for w in parts) and all(w in words or w in BOILER_WORDS or w in PLAIN_WORDS or w in beside for w in parts):
            return True
    return False


def _kind(tag: str, attributes: str) -> str:
    """The token's name: tag and class words; ! if it is boilerplate by its class, id or role or not shown, !! if by its tag or as readers' comments."""
    if tag in BOILER_TAGS:
        return f"{tag}!!"
    if not attributes:
        return tag
    boiler, comment, name = False, False, tag
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), html_lib.unescape(m[2] or m[3] or m[4] or "").lower()
        if key == "class":
            words = [w for w in re.split(r"[^a-z_-]+", value) if w]
            name = ".".join([tag, *words[:3]])
        if tag in KEPT_TAGS and tag != "article":
            continue
        if key in ("class", "id"):
            if tag not in INLINE:
                comment |= _names(value, COMMENT_WORDS, _BESIDE)
                boiler |= tag != "article" and _names(value, BOILER_WORDS)
        elif tag == "article":
            continue
        elif key == "role":
            boiler |= value.strip() in BOILER_ROLES
        elif key == "style":
            boiler |= bool(_UNSEEN.search(value))
        else:
            boiler |= key == "hidden" and value.strip() != "false" or key == "aria-hidden" and value.strip() == "true"
    return f"{name}!!" if comment else f"{name}!" if boiler else name


def tokens(source: str) -> Iterator[tuple[str, str, str]]:
    """("<", tag, kind), (">", tag, "") and ("#", "", text); raw elements' text is not split further."""
    at, raw, lowered = 0, "", None
    while at < len(source):
        if raw:
            lowered = lowered if lowered is not None else source.lower()
            end = lowered.find(f"</{raw}", at)
            end = len(source) if end < 0 else end
            yield "#", "", source[at:end]
            at, raw = end, ""
            continue
        m = _TOKEN.search(source, at)
        if not m:
            yield "#", "", source[at:]
            return
        if m.start() > at:
            yield "#", "", source[at : m.start()]
        at = m.end()
        if m[0].startswith("<![CDATA["):
            yield "#", "", m[0][9:-3] if m[0].endswith("]]>") else m[0][9:]
        elif m[2]:
            tag = m[2].lower()
            if m[1]:
                yield ">", tag, ""
            else:
                yield "<", tag, _kind(tag, m[3])
                if tag in RAW and not m[3].rstrip().endswith("/"):
                    raw = tag


class Element:
    """An element of a page: kids are elements and texts."""

    __slots__ = ("tag", "kind", "kids")

    def __init__(self, tag: str, kind: str):
        self.tag, self.kind, self.kids = tag, kind, []


def parse(source: str) -> Element:
    """The page as a tree. Block tags that HTML closes by itself are closed here; each token costs a constant time."""
    root = Element("", "")
    stack, blocks, places = [root], [], {}

    def close(depth: int) -> None:
        while len(stack) > depth:
            tag = stack.pop().tag
            places[tag].pop()
            if tag in BLOCK:
                blocks.pop()

    for sign, tag, value in tokens(source):
        if sign == "#":
            stack[-1].kids.append(value)
        elif sign == "<":
            while blocks and tag in CLOSES.get(stack[blocks[-1]].tag, ()):
                close(blocks[-1])
            element = Element(tag, value)
            stack[-1].kids.append(element)
            if tag not in VOID:
                places.setdefault(tag, []).append(len(stack))
                if tag in BLOCK:
                    blocks.append(len(stack))
                stack.append(element)
        elif places.get(tag):
            close(places[tag][-1])
    return root


class Node:
    """A node of a structure: kind "#" is a text slot; mark is "" once, "?" optional, "+" repeated, "*" both.

    slot is (least text hash, greatest text hash, least hashes of the pages that have it).
    """

    __slots__ = ("kind", "kids", "mark", "slot", "label", "index")

    def __init__(self, kind: str, kids: list[Node] | None = None, mark: str = "", slot: tuple | None = None):
        self.kind, self.kids, self.mark, self.slot, self.label, self.index = kind, kids if kids is not None else [], mark, slot, None, None


def _mark(a: str, b: str = "") -> str:
    both = set(a + b)
    if "*" in both or {"?", "+"} <= both:
        return "*"
    return "+" if "+" in both else "?" if "?" in both else ""


def _slot(a: tuple | None, b: tuple | None) -> tuple | None:
    if a is None or b is None:
        return a or b
    return min(a[0], b[0]), max(a[1], b[1]), a[2] if a[2] == b[2] else tuple(sorted({*a[2], *b[2]})[:TEMPLATE_PAGES])


def _pairs(a: list[Node], b: list[Node]) -> list[tuple[Node | None, Node | None]]:
    """Nodes of common kinds in order (longest common subsequence), the others alone."""
    low = 0
    while low < min(len(a), len(b)) and a[low].kind == b[low].kind:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high].kind == b[-1 - high].kind:
        high += 1
    x, y = a[low : len(a) - high], b[low : len(b) - high]
    middle: list[tuple[Node | None, Node | None]] = []
    n, m = len(x), len(y)
    if n * m <= LCS_CELLS:
        best = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n - 1, -1, -1):
            for j in range(m - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if x[i].kind == y[j].kind else max(best[i + 1][j], best[i][j + 1])
        i = j = 0
        while i < n or j < m:
            if i < n and j < m and x[i].kind == y[j].kind:
                middle.append((x[i], y[j]))
                i, j = i + 1, j + 1
            elif i < n and (j == m or best[i + 1][j] >= best[i][j + 1]):
                middle.append((x[i], None))
                i += 1
            else:
                middle.append((None, y[j]))
                j += 1
    else:
        where: dict[str, list[int]] = {}
        for j, node in enumerate(y):
            where.setdefault(node.kind, []).append(j)
        j = 0
        for node in x:
            at = where.get(node.kind, [])
            k = bisect_left(at, j)
            if k < len(at):
                middle += [(None, other) for other in y[j : at[k]]]
                middle.append((node, y[at[k]]))
                j = at[k] + 1
            else:
                middle.append((node, None))
        middle += [(None, other) for other in y[j:]]
    return [*zip(a[:low], b[:low], strict=True), *middle, *zip(a[len(a) - high :], b[len(b) - high :], strict=True)]


def align(a: list[Node], b: list[Node]) -> list[Node]:
    """One structure that covers both."""
    result: list[Node] = []
    work = [(a, b, result)]
    while work:
        a, b, out = work.pop()
        for x, y in _pairs(a, b):
            if x is None or y is None:
                one = x or y
                out.append(Node(one.kind, one.kids, _mark(one.mark, "?"), one.slot))
            else:
                node = Node(x.kind, [], _mark(x.mark, y.mark), _slot(x.slot, y.slot))
                out.append(node)
                if x.kids is y.kids:
                    node.kids = x.kids
                elif x.kids or y.kids:
                    work.append((x.kids, y.kids, node.kids))
    return result


def fold(nodes: Iterable[Node]) -> list[Node]:
    """Adjacent equal runs of up to four kinds become one run whose members are repeated."""
    out: list[Node] = []
    for node in nodes:
        out.append(node)
        width = 1
        while width <= 4 and 2 * width <= len(out):
            if all(out[-width + k].kind == out[-2 * width + k].kind for k in range(width)):
                for k in range(width):
                    x, y = out[-2 * width + k], out[-width + k]
                    out[-2 * width + k] = Node(x.kind, align(x.kids, y.kids), "" if x.kind == "#" else _mark(x.mark + y.mark, "+"), _slot(x.slot, y.slot))
                del out[-width:]
                width = 1
            else:
                width += 1
    return out


def structure(page: Element, digest: int = 0) -> list[Node]:
    """The folded structure of a page."""
    order = [page]
    for element in order:
        order += [k for k in element.kids if isinstance(k, Element) and k.tag not in VOID]
    built: dict[int, Node] = {}
    for element in reversed(order):
        kids: list[Node] = []
        for kid in element.kids:
            if isinstance(kid, Element):
                if kid.tag not in VOID:
                    kids.append(built.pop(id(kid)))
            elif words := kid.split():
                h = zlib.crc32(" ".join(words).encode("utf-8", "replace"))
                kids.append(Node("#", slot=(h, h, (digest,))))
        built[id(element)] = Node(element.kind, fold(kids))
    return built[id(page)].kids


def write(nodes: list[Node]) -> tuple[str, list[tuple]]:
    """The structure as text, and its slots in order."""
    parts: list[str] = []
    slots: list[tuple] = []
    work: list[Node | str] = list(reversed(nodes))
    while work:
        node = work.pop()
        if isinstance(node, str):
            parts.append(node)
        elif node.kids:
            parts.append(f"{node.kind}(")
            work += [f"){node.mark},", *reversed(node.kids)]
        else:
            parts.append(f"{node.kind}{node.mark},")
            if node.kind == "#":
                slots.append(node.slot)
    return "".join(parts), slots


def read(text: str, slots: Iterable[tuple]) -> list[Node]:
    """The inverse of write."""
    stack: list[list[Node]] = [[]]
    closed = False
    following = iter(slots)
    for m in re.finditer(r"([^(),]*)([(),])", text):
        name, end = m[1], m[2]
        if end == "(":
            stack[-1].append(Node(name))
            stack.append(stack[-1][-1].kids)
        elif end == ")":
            stack.pop()
            closed = True
            continue
        elif closed:  # the mark that follows a group
            stack[-1][-1].mark = name
        else:
            mark = name[-1] if name[-1:] in ("?", "+", "*") else ""
            kind = name[: len(name) - len(mark)]
            stack[-1].append(Node(kind, [], mark, next(following) if kind == "#" else None))
        closed = False
    return stack[0]


#: Label bits of a slot: content, content but for class words around its article or main, within an article, a main.
CLEAN, SOFT, ARTICLE, MAIN = 1, 2, 4, 8


def label(nodes: list[Node]) -> list[Node]:
    """Labels the slots of a wrapper."""
    # Of the chain so far: a boilerplate tag, a boilerplate word since the last article or main, one before it, their bits, a heading.
    work = [(node, (False, False, False, 0, False)) for node in nodes]
    while work:
        node, (by_tag, by_word, before, bits, heading) = work.pop()
        if node.kind == "#":
            template = not bits and not heading and node.slot[0] == node.slot[1] and len(node.slot[2]) >= TEMPLATE_PAGES
            node.label = bits | (0 if by_tag or by_word or template else SOFT if before else CLEAN)
            continue
        tag = re.split(r"[.!]", node.kind, maxsplit=1)[0]
        if tag in ("article", "main") and not node.kind.endswith("!"):
            by_word, before, bits = False, before or by_word, bits | (ARTICLE if tag == "article" else MAIN)
        by_tag |= node.kind.endswith("!!")
        by_word |= node.kind.endswith("!")
        work += [(kid, (by_tag, by_word, before, bits, heading or tag in HEADINGS)) for kid in node.kids]
    return nodes


def replay(page: Element, wrapper: list[Node]) -> Iterator[tuple[str, int]]:
    """The page over its wrapper, in order: (text, label of its slot), and ("", -1) where a block begins or ends."""
    root = Node("", wrapper)
    work: list[tuple[object, Node | None] | None] = [(page, root)]
    while work:
        item = work.pop()
        if item is None:
            yield "", -1
            continue
        kid, node = item
        if isinstance(kid, str):
            yield kid, node.label if node is not None else 0
            continue
        if kid.tag == "br":
            yield " ", ARTICLE | MAIN | CLEAN
            continue
        if node is not None and node.index is None:
            node.index = {}
            for k, below in enumerate(node.kids):
                node.index.setdefault(below.kind, []).append(k)
        matched, at = [], 0
        for below in kid.kids:
            text = isinstance(below, str)
            found = None
            if node is not None and (below.strip() if text else below.tag not in VOID):
                places = node.index.get("#" if text else below.kind)
                if places:
                    k = bisect_left(places, at)
                    at = places[k] if k < len(places) else places[0]
                    found = node.kids[at]
            matched.append((below, found))
        block = kid.tag in BLOCK
        if block:
            yield "", -1
            work.append(None)
        work += reversed(matched)


def _articles(page: Element) -> int:
    order = [page]
    for element in order:
        order += [k for k in element.kids if isinstance(k, Element)]
    return sum(e.tag == "article" for e in order)


def content_root(events: list[tuple[str, int]], articles: int) -> tuple[int, int]:
    """The state and the root of a page's content: whose slots count.

    The slots that the wrapper leaves, without templates and boilerplate, are weighed by
    their text. Articles beside a main element that has none are teasers if the
    average one of them has less text than it. Articles
    count alone if they hold a quarter of the text of the main element around them,
    or of the page; else, and without articles, the main element does, or all slots.
    """
    mass: dict[int, int] = {}
    for text, bits in events:
        if bits > 0 and (n := len("".join(text.split()))):
            mass[bits] = mass.get(bits, 0) + n
    for state in (CLEAN, SOFT):
        total = sum(n for bits, n in mass.items() if bits & state)
        main = sum(n for bits, n in mass.items() if bits & state and bits & MAIN)
        inside = sum(n for bits, n in mass.items() if bits & state and bits & MAIN and bits & ARTICLE)
        article = sum(n for bits, n in mass.items() if bits & state and bits & ARTICLE)
        if main and not inside and main * max(1, articles) >= article or inside and 4 * inside < main:
            return state, MAIN
        if article and (state == SOFT or 4 * article >= (main if inside else total)):
            return state, ARTICLE
        if main:
            return state, MAIN
        if total and state == CLEAN and article:
            return CLEAN, 0
    return CLEAN, 0


def main_text(page: Element, wrapper: list[Node]) -> str:
    """Blocks of the texts on content slots, white space in a block as one space."""
    events = list(replay(page, wrapper))
    state, root = content_root(events, _articles(page))
    found: list[str] = []
    now: list[str] = []
    for text, bits in [*events, ("", -1)]:
        if bits >= 0:
            if bits & (state | CLEAN) and bits & root == root:
                now.append(text)
        elif now:
            block = _SPACE.sub(" ", html_lib.unescape("".join(now))).strip()
            if block:
                found.append(block)
            now.clear()
    return "\n\n".join(found)


_SHAPES = "host string, shape string, low array<long>, high array<long>, pages array<array<long>>"


def _rows(hosts: dict[tuple[str, str], list[tuple]]) -> list[list]:
    return [[h for h, _ in hosts], [s for _, s in hosts], *([[x[k] for x in slots] for slots in hosts.values()] for k in range(3))]


def _merge_equal(known: dict, key: tuple[str, str], slots: list[tuple]) -> None:
    known[key] = [_slot(a, b) for a, b in zip(known[key], slots, strict=True)] if key in known else slots


def _fold_pages(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each host and structure of a batch."""
    kinds = [pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64()))]
    for batch in batches:
        known: dict[tuple[str, str], list[tuple]] = {}
        for host, source in zip(batch.column(0), batch.column(1), strict=True):
            source = source.as_py() or ""
            data = source.encode("utf-8", "replace")
            shape, slots = write(structure(parse(source), zlib.crc32(data) << 20 | zlib.adler32(data) & 0xFFFFF))
            _merge_equal(known, (host.as_py(), shape), slots)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(_rows(known), kinds, strict=True)], ["host", "shape", "low", "high", "pages"])


def _merge_shapes(pdf: pd.DataFrame) -> pd.DataFrame:
    known: dict[tuple[str, str], list[tuple]] = {}
    for host, shape, low, high, pages in pdf.sort_values("shape").itertuples(index=False):
        _merge_equal(known, (host, shape), [(int(a), int(b), tuple(map(int, p))) for a, b, p in zip(low, high, pages, strict=True)])
    shapes = [read(shape, slots) for (_, shape), slots in known.items()]
    while len(shapes) > 1:
        shapes = [fold(align(shapes[i], shapes[i + 1])) if i + 1 < len(shapes) else shapes[i] for i in range(0, len(shapes), 2)]
    shape, slots = write(shapes[0])
    columns = _rows({(pdf["host"].iloc[0], shape): slots})
    return pd.DataFrame(dict(zip(["host", "shape", "low", "high", "pages"], columns, strict=True)))


def _extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[tuple[str, str], list[Node]] = {}
    for batch in batches:
        texts = []
        for source, shape, template in zip(batch.column(2), batch.column(3), batch.column(4), strict=True):
            key = shape.as_py() or "", template.as_py() or ""
            if key not in known:
                if len(known) > 2000:
                    known.clear()
                pages = {"1": tuple(range(TEMPLATE_PAGES)), "0": ()}
                known[key] = label(read(key[0], [(0, 0, pages[c]) for c in key[1]]))
            texts.append(main_text(parse(source.as_py() or ""), known[key]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def host_of(url: str = "url") -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def infer_wrappers(scratch: Scratch, pages: DataFrame, group: int = 64) -> DataFrame:
    """host, shape, template: one wrapper for each host, from all its pages; template has a 1 for each slot whose text the host repeats.

    A host's structures are merged `group` at a time, so that no task holds all structures of a large host.
    """
    shapes = pages.select(host_of().alias("host"), F.col("html").cast("string")).mapInArrow(_fold_pages, _SHAPES)
    shapes = scratch.table(shapes, "shapes")
    while True:
        most = shapes.groupBy("host").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= 1:
            break
        salt = F.pmod(F.xxhash64("shape", "low"), F.lit(-(-most // group)))
        shapes = scratch.table(shapes.withColumn("salt", salt).groupBy("host", "salt").applyInPandas(lambda pdf: _merge_shapes(pdf.drop(columns="salt")), _SHAPES), "shapes")
    same = F.zip_with(F.zip_with("low", "high", lambda a, b: a == b), "pages", lambda x, p: F.when(x & (F.size(p) >= TEMPLATE_PAGES), "1").otherwise("0"))
    return shapes.select("host", "shape", F.array_join(same, "").alias("template"))


def extract_main_text(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page; infer_wrappers has the wrappers."""
    scratch = Scratch(spark)
    wrappers = scratch.table(infer_wrappers(scratch, pages), "wrappers")
    size = wrappers.agg(F.count("*"), F.sum(F.octet_length("shape") + F.octet_length("template"))).first()
    source = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), host_of().alias("host"))
    if size[0] <= BROADCAST_ROWS and (size[1] or 0) <= 16 << 20:
        joined = source.join(F.broadcast(wrappers), "host", "left")
    else:  # a large host's pages meet its wrapper in as many tasks as there are copies of it
        copies = wrappers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(63))))
        joined = source.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(64)).cast("int")).join(copies, ["host", "salt"], "left")
    out = joined.select("page_id", "url", "html", "shape", "template").mapInArrow(_extract, "page_id long, url string, text string")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
