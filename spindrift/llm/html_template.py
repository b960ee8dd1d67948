"""HTML extraction by equivalence classes of tokens over a host's pages.

A host's pages are dealt into lots of about LOT pages (a hot host has many lots), and each lot gives a template:

1. Pages become tokens: tags with the tags they stand in, so that equal tags in different places differ.
2. Tokens with the same occurrence vector (how often they occur on each page of the lot) are one class. Classes that
   occur on most pages and keep one order on each are valid; the class that occurs once a page is the template's frame.
3. Other classes nest in the frame's slot that their first occurrences fall in, a class for each slot. What stands in
   no class's token is the content of a slot.
4. Slots that hold the pages' own text (what isn't on all of the lot's pages, nor in links) make the main part: the
   container that is reached from the root by the child with most of that text, as long as there is none beside the
   child. An article or main element narrows it down only if at least half of the lot's own text is in such elements.
5. A slot of the frame or of a nested class is the template's if its text is the same on all pages that have the tag
   (LEAST_PAGES different pages at least); that text goes, in the main part too. A tag whose own text differs
   from page to page is content wherever it stands, so a paragraph with the path of the page's own ones stays.

Menus, footers, sidebars, notices, adverts, forms and reader comments go wherever they stand, by their tags, roles and
class words; so do headers outside an article. Their texts may differ from page to page like an article's, so no template
tells them apart. Words that an article's own parts may be named by too (header, related, search) count only if the
whole class name is made of such words."""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Pages of a lot, about, and hosts up to which their numbers of lots (some 50 bytes each) are sent to every executor.
LOT, BROADCAST_ROWS = 64, 100_000
#: Different pages that tell a template's text from content at least.
LEAST_PAGES = 3

#: Elements and words.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes svg math template object select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
DROPPED = frozenset("nav header footer aside form menu head script style noscript iframe template svg math object select button dialog textarea title input fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
CLASS_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "sidebar cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription share sharing comment comments respond disqus pagination pager toolbar widget widgets".split()
)
SHARED_WORDS = frozenset("banner header masthead footer aside notice notices notification signup login search social reply replies discussion related recommended".split())
PLACES = frozenset("site page global top bottom main bar box form list posts articles links stories section block area wrapper container left right".split())
MAIN_CLASSES = frozenset("article-body article-content articlebody post-content post-body entry-content story-body main-content page-content".split())
#: Elements of running text: a container is what stands above them.
RUNNING = INLINE | frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption br hr".split())
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)


class Place:
    """Where something stands: a label (name and class) in the place above. Equal places of a lot's pages are one object,
    so a page takes memory and time in proportion to its length, however deep its elements nest."""

    __slots__ = ("above", "label", "name", "container", "block", "inner")

    def __init__(self, above: Place | None = None, label: str = "") -> None:
        self.above, self.label, self.name = above, label, label.partition(".")[0]
        # the container that running text stands in, and the element that a text stands in, inline ones passed over
        self.container: Place = above.container if above and self.name in RUNNING else self
        self.block: Place = above.block if above and self.name in INLINE else self
        self.inner: dict[str, Place] = {}

    def within(self, label: str) -> Place:
        if label not in self.inner:
            self.inner[label] = Place(self, label)
        return self.inner[label]

    def all(self) -> list[Place]:
        """This place and all in it, each after the one above."""
        found = [self]
        for place in found:  # grows as it goes
            found.extend(place.inner.values())
        return found

    def __str__(self) -> str:
        labels, at = [], self
        while at:
            labels.append(at.label)
            at = at.above
        return ">".join(reversed(labels))


#: The label of a closing tag, a place in its element's.
END = "/"


@dataclass
class Element:
    """An open element: its name, its place, what it makes of its content, and the place in the stack of the nearest
    element, itself included, that isn't an inline one."""

    name: str
    path: Place
    dropped: bool
    main: bool
    link: bool
    near: int


@dataclass
class Node:
    """What stands in a page: an opening or closing tag (text None) or a piece of text."""

    token: Place | None
    text: str | None
    path: Place
    dropped: bool
    main: bool
    link: bool
    block: bool


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(next((g for g in m.groups()[1:] if g is not None), "")) for m in _ATTR.finditer(raw)}


def _role(name: str, attributes: dict[str, str], within: bool) -> tuple[bool, bool, str]:
    """Whether an element is dropped, whether it is a main part, and its class for its path. within: it stands in a main part."""
    label = f"{attributes.get('class', '')} {attributes.get('id', '')}".lower()
    names = [set(re.split(r"[-_]+", part)) for part in label.split()]
    words = set().union(*names, label.split())
    role = attributes.get("role", "").lower()
    main = name in ("article", "main") or role in ("main", "article") or bool(words & MAIN_CLASSES) or attributes.get("itemprop", "").lower() == "articlebody"
    dropped = (name in DROPPED and not (name == "header" and within)) or role in ROLES or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true"
    noise = bool(words & CLASS_WORDS) or any(n & SHARED_WORDS and n <= SHARED_WORDS | PLACES for n in names)
    dropped |= noise and name not in ("html", "body", "main") and not (main and not words & {"comment", "comments", "ad", "ads"})
    return dropped, main and not dropped, "-".join(re.findall(r"[\w-]+", attributes.get("class", "").lower()))


def tokenize(page: str | None, root: Place | None = None) -> list[Node]:
    """A page's tags and texts in order; pages that are compared share a root.

    Unclosed elements end where their parent does; unknown closing tags are skipped."""
    page = page or ""
    nodes: list[Node] = []
    stack = [Element("", root or Place(), False, False, False, 0)]
    names: Counter[str] = Counter()
    at = 0

    def close(depth: int) -> None:
        names.subtract(e.name for e in stack[depth:])
        del stack[depth:]

    def text(piece: str) -> None:
        if piece:
            e = stack[-1]
            nodes.append(Node(None, html.unescape(piece), e.path, e.dropped, e.main, e.link, False))

    def tag(token: Place, e: Element, block: bool) -> None:
        nodes.append(Node(token, None, e.path, e.dropped, e.main, e.link, block))

    while m := _TOKEN.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"))
            continue
        name, block = m[2].lower(), m[2].lower() not in INLINE
        if m[1]:
            depth = len(stack) - 1 if names[name] else 0
            while depth and stack[depth].name != name:
                # an inline element's end doesn't close the blocks that were opened in it
                depth = 0 if name in INLINE and stack[depth].name not in INLINE else depth - 1
            if depth:
                tag(stack[depth].path.within(END), stack[depth - 1], block)
                close(depth)
            continue
        closes, k = CLOSES.get(name, ()), len(stack) - 1
        while closes and (k := stack[k].near):  # inline elements, which no tag closes, are passed over
            if stack[k].name in closes:
                close(k)
                break
            if stack[k].name not in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):
                break
            k -= 1
        attributes = _attributes(m[3])
        up = stack[-1]
        dropped, main, cls = _role(name, attributes, up.main)
        e = Element(name, up.path.within(name + f".{cls}" * bool(cls)), up.dropped or dropped, up.main or main, up.link or name == "a", up.near if name in INLINE else len(stack))
        tag(e.path, up, block)
        if name in VOID or m[3].rstrip().endswith("/"):
            continue
        if name in RAW:  # its content is no markup
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            tag(e.path.within(END), up, block)
            continue
        stack.append(e)
        names[name] += 1
    text(page[at:])
    return nodes


@dataclass
class Template:
    """The frame's tokens in order, the classes nested in each of its slots, the path of the main container, whether
    article and main elements hold half of the own text, and the tokens whose slots hold the template's own text."""

    frame: list[Place]
    nested: dict[int, list[tuple[Place, ...]]]
    main: Place
    marked: bool
    fixed: frozenset[Place]

    def __post_init__(self) -> None:
        self.inside = frozenset(self.main.all())


def _fixed(pages: list[list[Node]], tokens: set[Place]) -> frozenset[Place]:
    """Those of the tokens whose slots hold the same text on all pages that have the token.

    Equal pages count once: copies of one page don't make its content a template."""
    held: dict[Place, list[str]] = defaultdict(list)
    different = {tuple((n.token, n.text) for n in nodes): nodes for nodes in pages}
    for nodes in different.values():
        texts: dict[Place, list[str]] = defaultdict(list)
        for n in nodes:
            if n.text is None:
                if n.token in tokens:
                    texts[n.token] += []
            elif (path := n.path.block) in tokens:
                texts[path].append(n.text)
        for token, pieces in texts.items():
            held[token].append(" ".join("".join(pieces).split()))
    return frozenset(t for t, x in held.items() if len(x) >= LEAST_PAGES and 2 * len(x) > len(different) and x[0] and len(set(x)) == 1)


def _slots(nodes: list[Node], frame: list[Place]) -> list[int]:
    """The slot of each node: how many of the frame's tokens have come up, those that lack passed over."""
    place = {t: k for k, t in enumerate(frame)}
    out, now = [], -1
    for n in nodes:
        if n.text is None and (k := place.get(n.token)) is not None and k > now:
            now = k
        out.append(now)
    return out


def deduce(pages: list[list[Node]], root: Place) -> Template:
    """The template of a lot's pages, all tokenized with the root."""
    vectors: dict[Place, dict[int, int]] = defaultdict(lambda: defaultdict(int))  # page to occurrences, none left out
    for k, nodes in enumerate(pages):
        for n in nodes:
            if n.text is None:
                vectors[n.token][k] += 1
    classes: dict[tuple[tuple[int, int], ...], list[Place]] = defaultdict(list)
    for token, v in vectors.items():
        if 2 * len(v) > len(pages):
            classes[tuple(v.items())].append(token)
    often = {v: max(c for _, c in v) for v in classes}

    def ordered(tokens: list[Place]) -> list[Place]:
        """Tokens that come once a page, in the order that all pages share; those that don't keep it are left out."""
        wanted, orders = dict.fromkeys(tokens), []
        for nodes in pages:
            seen = [n.token for n in nodes if n.text is None and n.token in wanted]
            orders.append({t: i for i, t in enumerate(seen)})
        keep: list[Place] = []
        for t in sorted(wanted, key=lambda t: min(o.get(t, 1 << 30) for o in orders)):
            if not keep or all(o[keep[-1]] < o[t] for o in orders if t in o and keep[-1] in o):
                keep.append(t)
        return keep

    # pages that were cut short lack the frame's last tokens, so the frame is what comes at most once and on most pages
    frame = ordered([t for v, ts in classes.items() if often[v] == 1 for t in ts])
    nested: dict[int, list[tuple[Place, ...]]] = defaultdict(list)
    homes: dict[Place, set[int]] = defaultdict(set)
    pieces: dict[tuple[Place, str, bool], set[int]] = defaultdict(set)
    for k, nodes in enumerate(pages):
        for n, slot in zip(nodes, _slots(nodes, frame), strict=True):
            if n.text is None:
                homes[n.token].add(slot)
            elif not n.dropped and not n.link and (piece := n.text.strip()):
                pieces[n.path.container, piece, n.main].add(k)
    for v, tokens in classes.items():
        apart: dict[int, list[Place]] = defaultdict(list)  # equal vectors in different slots are different classes
        for t in tokens:
            if often[v] > 1:
                apart[min(homes[t])].append(t)
        for slot, some in apart.items():
            nested[slot].append(tuple(some))
    # text that is on all of several pages is the template's, unless there is no other
    own = {key: at for key, at in pieces.items() if len(pages) < 3 or len(at) < len(pages)} or pieces
    mass: Counter[Place] = Counter()
    inside = 0
    for (place, piece, in_main), at in own.items():
        mass[place] += len(piece) * len(at)
        inside += len(piece) * len(at) * in_main
    marked = inside > 0 and 2 * inside >= sum(mass.values())
    whole, main = Counter(mass), root
    for place in reversed(root.all()):
        if place.above and whole[place]:
            whole[place.above] += whole[place]
    while not mass[main]:
        child = max(main.inner.values(), key=lambda c: (whole[c], c.label), default=main)
        if child is main or not whole[child] or 2 * whole[child] < whole[main]:
            break
        main = child
    fixed = _fixed(pages, {*frame, *(t for cs in nested.values() for c in cs for t in c)})
    return Template(frame, dict(nested), main, marked, fixed)


def extract(nodes: list[Node], template: Template) -> str:
    """A page's main text: the content of the slots in its main part, each block with single spaces, joined by a space.

    A page without any text there, of another layout than its host's other pages, gives that of its article or main
    element, and without one that of all its slots."""
    texts = [n for n in nodes if n.text is not None and not n.dropped and not n.text.isspace()]

    def below(n: Node) -> bool:
        return n.path.container in template.inside

    own = [n for n in texts if n.path.block not in template.fixed]
    tests = [lambda n: n.main, below] if template.marked else [below, lambda n: n.main]
    wanted = next((t for t in tests if any(map(t, own))), lambda n: True)
    out: list[str] = []
    for n in nodes:
        if n.text is None:
            if n.block:
                out.append(" ")
        elif not n.dropped and n.path.block not in template.fixed and wanted(n):
            out.append(n.text)
    return " ".join("".join(out).split())


def extract_pages(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html, ...) to (page_id, url, text, n_chars), a row for each row.

    text is empty where there is none (null, empty or text-less html); a page without any tag is all text. Pages are
    grouped by their url's host, those without one by a hash; a lone page is a lot of its own. Repeated rows give
    repeated rows; other columns are not read."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1)), F.lit(""))
    rows = pages.select("page_id", "url", "html", host.alias("host"))
    sizes = cut(rows.groupBy("host").agg(F.ceil(F.count("*") / LOT).alias("lots")))
    few = sizes.count() <= BROADCAST_ROWS  # else the pages meet their host's number in a join that Spark can split
    dealt = rows.join(F.broadcast(sizes) if few else sizes, "host").withColumn("lot", F.pmod(F.xxhash64("page_id", "url", "html"), F.col("lots")))

    def run(lot: pd.DataFrame) -> pd.DataFrame:
        root = Place()
        nodes = [tokenize(h, root) for h in lot["html"]]
        template = deduce(nodes, root)
        texts = [extract(n, template) for n in nodes]
        return pd.DataFrame({"page_id": lot["page_id"], "url": lot["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    kind = pages.schema["page_id"].dataType.simpleString()
    return dealt.groupBy("host", "lot").applyInPandas(run, f"page_id {kind}, url string, text string, n_chars long")


def lots(frames: Iterator[list[str | None]]) -> Iterator[list[str]]:
    """The texts of each list of pages of one host, without Spark: for tests and single hosts."""
    for pages in frames:
        root = Place()
        nodes = [tokenize(p, root) for p in pages]
        template = deduce(nodes, root)
        yield [extract(n, template) for n in nodes]
