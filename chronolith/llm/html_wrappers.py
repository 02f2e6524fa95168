"""Main text of web pages by wrapper inference.

A page is a stream of block tags and texts (inline tags vanish, scripts, styles and comments too). Streams of one host
are folded into a wrapper, a union-free regular expression: adjacent equal structures become a repeated group, and
another page is aligned with the wrapper so far, where a tag that only one side has becomes an optional group, a
structure that repeats on either side a repeated group, and texts that differ a slot. A slot keeps, in at most COUNTED
counters (a mergeable summary of frequent values), which texts come again on how many pages.

What is content is decided on the wrapper, from all pages of the host:
* its place: the article or main element that holds enough of the characters that vary and are no links; else the way
  down along the elements with most of those characters, with the headings and paragraphs that stand beside them;
* the host's own words: texts at one place of the wrapper, in any tag but section headings, that come on at least SURE
  pages and a SHARE of the pages that have the place, unless that would be most of the content (copies of one page);
* lists of links beside the content, where no article or main element bounds it;
* chrome: elements that HTML itself names so (nav, footer, aside, form, ...), roles, hidden parts, and, as a hint for what
  varies within the content, words in classes and ids, which never exclude an element that holds most of the text.
Each page is then matched with the expression: its children are aligned with the groups, and a text is read if the group
it falls to is content and the text is not the host's own. What matches no group is judged by itself; a page in which
the content's groups do not occur is read along the wrapper of that page alone.

All pages of a host make its wrapper: each task folds the pages that it reads into a partial wrapper a host, and the
partial ones are joined within PARTS salted parts of a host, then those. An element with more than MANY parts loses
their order (one group for each tag and class, or for each tag beyond MANY of those), so that wrappers stay small. How
pages are aligned may depend on which of them are folded first. Every page is extracted, whole. Wrappers go to the pages
by broadcast while they take at most BROADCAST_BYTES together, by a salted join beyond that.

Null and empty pages have an empty text; pages with a null or odd url form one host. Repeated rows each get a row. Text
outside any tag counts as a block. Blocks nested deeper than DEEP are read as blocks of the last element within. A tag
that never ends is text; time and memory go with a page's length, whatever it holds. Extra columns are ignored.
"""

from __future__ import annotations

import html
import json
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm.common import PARTS, Workspace, table

SURE, SHARE = 3, 0.95
BROADCAST_BYTES = 32 << 20
#: Parts of an element that are kept in their order.
MANY = 256
#: Texts of a slot that are counted; what comes more often than 1 / COUNTED of all its texts is always among them.
COUNTED = 256
#: Levels of blocks.
DEEP = 64
#: Characters of first pages of hosts after which a task hands on its partial wrappers.
HELD = 16 << 20
#: Salts of a host where wrappers are joined by shuffle.
SALTS = 32

OUT = "page_id long, url string, text string, n_chars long"

NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
#: The inside of a tag: a quote counts after an equals sign only.
INSIDE = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+")
ATTRIBUTE = re.compile(r"""([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?""")
ASKED = frozenset(("class", "id", "role", "hidden", "aria-hidden", "style"))
#: Elements whose inside is no text of the page; of the first two, what is never closed goes on to the end.
RAW = {t: re.compile(f"</{t}(?=[\\s/>])", re.IGNORECASE) for t in "script style noscript template svg iframe textarea select object math xmp noembed noframes".split()}

BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup html label legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag of these ends an open element of the tags named.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
LISTS = frozenset("ul ol menu dir dl table tbody thead tfoot article section div body".split())
DROPPED = frozenset("head nav footer aside form button dialog menu label legend fieldset option title".split())
WORDS_OF_CHROME = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adsense|banner|cookies?|consent|gdpr|notices?|alert|side-?bar|nav|navbar|navigation|menu|breadcrumbs?|footer|masthead|site-?header|page-?header|topbar|comments?|disqus|respond|replies|reply|share|sharing|social|related|recommended|promo\w*|sponsor\w*|newsletter|subscribe|subscription|signup|login|popup|modal|overlay|widget|toolbar|pagination|pager|skip-?link|hidden|sr-only)(?:$|[\s_-])",
    re.IGNORECASE,
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What may be named as the content where no article or main element is.
CONTAINERS = frozenset("html body div section center".split())
TEXT = "#"


class Leaf:
    """A text of a page; linked: how many of its characters are in links."""

    __slots__ = ("linked", "text")
    key = TEXT

    def __init__(self, text: str, linked: int = 0):
        self.text, self.linked = text, linked


class Node:
    """An element of a page: its key (tag and class), whether it is chrome (soft: by its class or id alone), and its children."""

    __slots__ = ("children", "chrome", "key", "main", "soft", "tag")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.key, self.children = tag, tag, []
        self.chrome, self.main, self.soft = tag in DROPPED, tag in ("article", "main"), False
        if not attributes or attributes.isspace():
            return
        for name, value in ATTRIBUTE.findall(attributes):
            if (name := name.lower()) not in ASKED:
                continue
            value = value.strip("\"'").lower()
            if name == "role":
                self.chrome |= value in ROLES
                self.main |= value in ("main", "article")
            elif name in ("class", "id"):
                self.soft |= bool(WORDS_OF_CHROME.search(value)) and tag not in ("body", "html")
                if name == "class" and value:
                    self.key = f"{tag}.{'.'.join(sorted(value.split()))}"
            elif name == "style":
                self.chrome |= "display:none" in value.replace(" ", "")
            else:
                self.chrome |= value != "false"


class Tree:
    """Builds the elements of a page, with tags that are left open or closed twice put right."""

    def __init__(self) -> None:
        self.root = Node(":")
        self.stack, self.into, self.open = [self.root], [self.root], Counter()
        self.waiting: list[str] = []
        self.size = self.linked = self.mains = 0
        self.in_link = False

    def text(self, piece: str) -> None:
        self.waiting.append(piece)
        self.size += len(piece)
        if self.in_link:
            self.linked += len(piece)

    def flush(self) -> None:
        if self.waiting:
            text = " ".join(html.unescape("".join(self.waiting)).split())
            if text:
                self.into[-1].children.append(Leaf(text, len(text) * self.linked // max(1, self.size)))
            self.waiting.clear()
            self.size = self.linked = 0

    def cut(self, i: int) -> None:
        """Closes the open elements from the i-th on."""
        for n in self.stack[i:]:
            self.open[n.tag] -= 1
            self.mains -= n.main
        del self.stack[i:], self.into[i:]

    def tag(self, tag: str, attributes: str, closing: bool) -> None:
        if tag not in BLOCKS:
            if tag == "a":
                self.in_link = not closing
            elif tag in VOID:
                self.waiting.append(" ")
            return
        self.flush()
        if closing:
            if self.open[tag]:
                self.cut(max(i for i in range(len(self.stack) - 1, 0, -1) if self.stack[i].tag == tag) if self.stack[-1].tag != tag else len(self.stack) - 1)
            return
        if tag != "html" and self.stack[-1].tag == "p":  # a paragraph holds no blocks
            self.cut(len(self.stack) - 1)
        ends = ENDS.get(tag, ())
        if any(self.open[e] for e in ends):
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i].tag in ends:
                    self.cut(i)
                    break
                if self.stack[i].tag in LISTS:
                    break
        node = Node(tag, attributes)
        if node.main and not self.mains:  # no class makes an outermost article chrome
            node.soft = False
        into = node
        if len(self.stack) >= DEEP and not node.chrome and not node.soft:
            into = self.into[-1]
        elif len(self.stack) < DEEP or not (self.into[-1].chrome or self.into[-1].soft):
            self.into[-1].children.append(node)
        else:
            into = self.into[-1]
        if not attributes.endswith("/"):
            self.stack.append(node)
            self.into.append(into)
            self.open[tag] += 1
            self.mains += node.main


def parse(page: str) -> Node:
    """The page's elements. Every character is looked at a bounded number of times."""
    tree, at, n, strict, last, never = Tree(), 0, len(page), True, page.rfind(">"), set()
    while (lt := page.find("<", at)) >= 0:
        if lt > at:
            tree.text(page[at:lt])
        after = page[lt + 1 : lt + 2]
        if after in ("!", "?"):
            end, size = (page.find("-->", lt + 4), 3) if page.startswith("<!--", lt) else (page.find("]]>", lt + 9), 3) if page.startswith("<![CDATA[", lt) else (page.find(">", lt), 1)
            at = n if end < 0 else end + size
            continue
        if lt > last:  # no tag ends any more
            at = lt
            break
        closing = after == "/"
        name = NAME.match(page, lt + 1 + closing)
        if name is None:
            tree.text("<")
            at = lt + 1
            continue
        end = INSIDE.match(page, name.end()).end() if strict else n
        if end >= n:  # not closed with its quotes heeded, so quotes count no more on this page
            strict, end = False, page.find(">", name.end())
        tag, attributes, at = name[0].lower(), page[name.end() : end], end + 1
        if not closing and tag in RAW and tag not in never:
            if close := RAW[tag].search(page, at):
                end = page.find(">", close.end())
                at = n if end < 0 else end + 1
                continue
            if tag in ("script", "style"):
                at = n
                break
            never.add(tag)
        tree.tag(tag, attributes, closing)
    if at < n:
        tree.text(page[at:])
    tree.flush()
    return tree.root


class Group:
    """Part of a wrapper: an element, or a text (key TEXT); optional, repeated, or one of a run that repeats as a whole (loop)."""

    __slots__ = ("chrome", "key", "kids", "linked", "loop", "lost", "main", "mass", "optional", "pages", "repeated", "soft", "text", "texts")

    def __init__(self, key: str, chrome: bool = False, main: bool = False, soft: bool = False):
        self.key, self.chrome, self.main, self.soft, self.kids = key, chrome, main, soft, []
        self.optional = self.repeated = self.loop = False
        self.text: str | None = None  # of texts: what all pages have; None is a slot
        self.texts: dict[int, int] = {}  # of texts: marks of those that come again, and on how many pages at least
        self.mass, self.linked, self.pages, self.lost = 0, 0, 1, 0  # lost: by how much counts of texts may be too low

    @property
    def tag(self) -> str:
        return self.key.split(".")[0]

    def __str__(self) -> str:
        """The expression."""
        if self.key == TEXT:
            return "#PCDATA" if self.text is None else self.text
        out, run = [], []
        for k in [*self.kids, None]:
            if run and (k is None or not k.loop):
                out.append(f"({''.join(f'({x})?' for x in run)})+")
                run = []
            if k is not None:
                (run if k.loop else out).append(str(k) if k.loop else f"({k}){'+' * k.repeated}{'?' * k.optional}" if k.optional or k.repeated else str(k))
        return f"<{self.key}>{''.join(out)}</>"


def mark(text: str) -> int:
    """A text's hash, its length in the lowest 20 bits."""
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) & ~0xFFFFF | min(len(text), 0xFFFFF)


def any_class(key: str) -> str:
    return key if key == TEXT else key.split(".")[0] + ".*"


def loosened(kids: list[Group], same_page: bool) -> list[Group]:
    """One group for each key, or for each tag where there are over MANY keys, in a run that repeats."""
    out: dict[str, Group] = {}
    for wide in (False, True):
        for k in kids:
            key = any_class(k.key) if wide or any_class(k.key) in out else k.key
            if key in out:
                k = joined(out[key], k, same_page)
            k.key, k.loop = key, True
            out[key] = k
        if len(out) <= MANY:
            break
        kids, out = list(out.values()), {}
    return list(out.values())


def fold(node: Node | Leaf) -> Group:
    """The wrapper of one page, adjacent equal structures being one repeated group."""
    if isinstance(node, Leaf):
        leaf = Group(TEXT)
        leaf.text, leaf.mass, leaf.linked, leaf.texts = node.text, len(node.text), node.linked, {mark(node.text): 1}
        return leaf
    out = Group(node.key, node.chrome, node.main, node.soft)
    kids = out.kids
    for child in node.children:
        part = fold(child)
        if kids and kids[-1].key == part.key:
            kids[-1] = joined(kids[-1], part, True)
            kids[-1].repeated = True
        else:
            kids.append(part)
        # two parts that come again right after themselves are a run that repeats
        if len(kids) >= 4 and kids[-4].key == kids[-2].key and kids[-3].key == kids[-1].key:
            pair = [joined(x, y, True) for x, y in zip(kids[-4:-2], kids[-2:], strict=True)]
            for k in pair:
                k.loop = True
            kids[-4:] = pair
    if len(kids) > MANY:
        out.kids = loosened(kids, True)
    out.mass, out.linked = sum(k.mass for k in out.kids), sum(k.linked for k in out.kids)
    return out


def aligned(a: list[str], b: list[str]) -> list[tuple[int | None, int | None]]:
    """Positions of two key sequences side by side: a longest common subsequence, and what only one has (a's first)."""
    n, m = len(a), len(b)
    if a == b:
        return [(i, i) for i in range(n)]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(m - 1, -1, -1):
            row[j] = below[j + 1] + 1 if a[i] == b[j] else max(below[j], row[j + 1])
    out: list[tuple[int | None, int | None]] = []
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            out.append((i, None))
            i += 1
        else:
            out.append((None, j))
            j += 1
    return out


def joined(a: Group, b: Group, same_page: bool = False) -> Group:
    """The least wrapper that both match: mismatches become optional or repeated groups and slots. a and b are used up."""
    out = Group(a.key, a.chrome and b.chrome, a.main or b.main, a.soft and b.soft)
    out.optional, out.repeated, out.loop = a.optional or b.optional, a.repeated or b.repeated, a.loop or b.loop
    out.mass, out.linked, out.pages = a.mass + b.mass, a.linked + b.linked, max(a.pages, b.pages) if same_page else a.pages + b.pages
    if a.key == TEXT:
        out.text = a.text if a.text == b.text else None
        few, out.texts = sorted((a.texts, b.texts), key=len)
        out.lost = a.lost + b.lost
        for h, c in few.items():
            out.texts[h] = max(out.texts.get(h, 0), c) if same_page else out.texts.get(h, 0) + c
        if len(out.texts) > 2 * COUNTED:
            less = sorted(out.texts.values(), reverse=True)[COUNTED]
            out.texts, out.lost = {h: c - less for h, c in out.texts.items() if c > less}, out.lost + less
        return out
    if len(a.kids) > MANY or len(b.kids) > MANY or any(k.key.endswith(".*") for k in (*a.kids[:1], *b.kids[:1])):
        out.kids = loosened([*a.kids, *b.kids], same_page)
        return out
    for i, j in aligned([k.key for k in a.kids], [k.key for k in b.kids]):
        if i is not None and j is not None:
            kid = joined(a.kids[i], b.kids[j], same_page)
        else:
            kid = a.kids[i] if i is not None else b.kids[j]
            kid.optional = True
        if out.kids and out.kids[-1].key == kid.key:  # optional and present parts of one kind beside each other
            kid = joined(out.kids.pop(), kid, same_page)
            kid.repeated, kid.pages = True, min(kid.pages, out.pages)
        out.kids.append(kid)
    if len(out.kids) > MANY:
        out.kids = loosened(out.kids, same_page)
    elif loops := [i for i, k in enumerate(out.kids) if k.loop]:
        for k in out.kids[loops[0] : loops[-1]]:
            k.loop = True
    return out


#: What a group means for reading: outside or plain, where content begins, left out.
PLAIN, CONTENT, LEFT_OUT = 0, 1, 2


class Place:
    """A group as pages are read along it: its meaning, the marks of the host's own words, the groups below."""

    __slots__ = ("at", "key", "kids", "own", "state", "wide")

    def __init__(self, key: str, state: int, own: list[int], kids: list):
        self.key, self.state, self.own, self.kids = key, state, frozenset(own), [Place(*k) for k in kids]
        self.at: dict[str, int] = {}
        for i, k in enumerate(self.kids):
            self.at.setdefault(k.key, i)
        self.wide = any(k.key.endswith(".*") for k in self.kids)


def decided(wrapper: Group) -> list:
    """[key, state, own words, groups below] of every group: what is content, as the module says."""
    alone = wrapper.pages < 2
    plain: dict[int, int] = {}

    def varying(g: Group, links: bool = False) -> int:
        """Characters outside chrome and links, but of texts that are the same on several pages."""
        if g.key == TEXT:
            return 0 if g.text is not None and g.pages > 1 else g.mass - (0 if links else g.linked)
        if g.chrome:
            return 0
        got = sum(varying(k, links) for k in g.kids)
        if not links:
            plain[id(g)] = got
        return got

    total = varying(wrapper)

    def chrome(g: Group) -> bool:
        return g.chrome or g.soft and plain.get(id(g), 0) <= 0.6 * total

    def named(g: Group) -> Group | None:
        """The article or main element with most varying characters, outermost ones first."""
        if g.key == TEXT or chrome(g):
            return None
        if g.main and g.mass:
            return g
        return max((x for k in g.kids if (x := named(k))), key=lambda x: plain.get(id(x), 0), default=None)

    roots: list[Group] = []
    bounded = named(wrapper)
    if bounded is not None and plain.get(id(bounded), 0) >= 0.3 * total:
        roots.append(bounded)
    else:
        at, bounded = wrapper, None
        while True:
            here = plain.get(id(at), 0)
            heavy = next((k for k in at.kids if k.key != TEXT and k.tag in CONTAINERS and not chrome(k) and plain.get(id(k), 0) > 0.6 * here), None)
            if heavy is None or not here:
                roots.append(at)
                break
            roots += [k for k in at.kids if k.key != TEXT and k.tag in PROSE and not chrome(k) and plain.get(id(k), 0)]
            at = heavy
    content = {id(g) for g in roots}

    def repeats(g: Group, tag: str, cap: int) -> list[int]:
        pages = min(g.pages, cap)
        return [h for h, c in g.texts.items() if c >= SURE and c >= pages / 2 and c + g.lost >= SHARE * pages] if tag not in HEADINGS or tag == "h1" else []

    def gathered(g: Group, inside: bool, cap: int) -> tuple[int, int]:
        """Characters of the content, and of those what the host's own words take."""
        cap, inside = min(cap, g.pages), inside or id(g) in content
        mass = own = 0
        for k in g.kids:
            if k.key == TEXT:
                if inside:
                    mass += k.mass
                    own += sum((h & 0xFFFFF) * k.texts[h] for h in repeats(k, g.tag, cap))
            elif not (k.chrome or k.soft if inside else chrome(k)):
                more = gathered(k, inside, cap)
                mass, own = mass + more[0], own + more[1]
        return mass, own

    mass, own = gathered(wrapper, False, wrapper.pages)
    marked = not alone and own <= 0.5 * mass

    def made(g: Group, tag: str, inside: bool, cap: int) -> list:
        if g.key == TEXT:
            return [TEXT, PLAIN, repeats(g, tag, cap) if inside and marked else [], []]
        begins = id(g) in content
        links = inside and bounded is None and not begins and g.tag not in PROSE and g.mass and g.linked >= 0.8 * g.mass and g.pages >= SURE
        if not begins and (links or (g.chrome or g.soft if inside else chrome(g))):
            return [g.key, LEFT_OUT, [], []]
        inside, cap = inside or begins, min(cap, g.pages)
        kids = [made(k, g.tag, inside, cap) for k in g.kids]
        if not inside and all(k[0] == TEXT or k[1] == PLAIN and not k[3] for k in kids):
            kids = []  # nothing to read below
        return [g.key, CONTENT if begins else PLAIN, [], kids]

    return made(wrapper, "", False, wrapper.pages)


def placed(children: list, place: Place | None) -> list[Place | None]:
    """The group of each child: runs of equal keys aligned with the groups, then what is left by key alone."""
    if place is None or not place.kids:
        return [None] * len(children)
    runs: list[str] = []
    of: list[int] = []
    for c in children:
        key = c.key
        if place.wide and key not in place.at and any_class(key) in place.at:
            key = any_class(key)
        if not runs or runs[-1] != key:
            runs.append(key)
        of.append(len(runs) - 1)
    keys = [k.key for k in place.kids]
    got: list[Place | None] = [place.kids[place.at[r]] if r in place.at else None for r in runs]
    if len(runs) * len(keys) <= MANY * MANY:
        for i, j in aligned(runs, keys):
            if i is not None and j is not None:
                got[i] = place.kids[j]
    return [got[i] for i in of]


def read(node: Node, place: Place | None) -> tuple[list[tuple[str, bool]], bool]:
    """(text, whether it is the host's own) of the content's texts in page order, and whether any content was met."""
    out: list[tuple[str, bool]] = []
    met = False

    def below(node: Node, place: Place | None, inside: bool, heading: bool) -> None:
        nonlocal met
        for child, at in zip(node.children, placed(node.children, place), strict=True):
            if isinstance(child, Leaf):
                if inside and (not heading or node.tag in HEADINGS):
                    out.append((child.text, at is not None and bool(at.own) and mark(child.text) in at.own))
            elif at is None:
                if inside and not child.chrome and not child.soft:
                    below(child, None, True, heading or child.tag == "header")
            elif at.state != LEFT_OUT and not child.chrome:
                met |= at.state == CONTENT
                if inside or at.state == CONTENT or at.kids:
                    below(child, at, inside or at.state == CONTENT, heading or child.tag == "header")

    begins = place is not None and place.state == CONTENT
    met = begins
    below(node, place, begins, False)
    return out, met


def extract(page: str | None, place: Place | None) -> str:
    """The page's main text: blocks in page order, one a line. place: the host's wrapper, if there is one."""
    if not page:
        return ""
    root = parse(page)
    out, met = read(root, place) if place is not None else ([], False)
    if not met or not out:
        out, _ = read(root, Place(*decided(fold(root))))
    return "\n".join([t for t, own in out if not own] or [t for t, _ in out])


def whole(page: str) -> Group:
    """The wrapper of one page."""
    return fold(parse(page))


def infer(pages: list[str]) -> Group:
    """The wrapper of same-host pages."""
    return reduce(joined, map(whole, pages))


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper, expression): one inferred wrapper per host, as JSON, and its text form. Pages stay where they are."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Group] = {}
        size = 0

        def handed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([pickle.dumps(g) for g in held.values()], pa.binary())], names=["host", "part"])

        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                page = page.as_py()
                if host in held:
                    held[host] = joined(held[host], whole(page))
                    continue
                held[host] = whole(page)
                size += len(page)
                if size > HELD:
                    yield handed()
                    held.clear()
                    size = 0
        yield handed()

    def together(rows: pa.Table) -> Group:
        return reduce(joined, (pickle.loads(p) for p in sorted(rows.column("part").to_pylist())))

    def meet(key: tuple, rows: pa.Table) -> pa.Table:
        return pa.table({"host": [key[0].as_py()], "part": pa.array([pickle.dumps(together(rows))], pa.binary())})

    def each(key: tuple, rows: pa.Table) -> pa.Table:
        wrapper = together(rows)
        return pa.table({"host": [key[0].as_py()], "wrapper": [json.dumps(decided(wrapper))], "expression": [str(wrapper)]})

    parts = pages.select(host_of(F.col("url")).alias("host"), "html").filter("html <> ''").mapInArrow(partial, "host string, part binary")
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("part"), F.lit(PARTS))).groupBy("host", "salt").applyInArrow(meet, "host string, part binary")
    return salted.groupBy("host").applyInArrow(each, "host string, wrapper string, expression string")


def main_text(pages: DataFrame, work: Workspace | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    work = work or Workspace(pages.sparkSession, "wrappers")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumn("host", host_of(F.col("url")))
    inferred = work.write("wrappers", wrappers(pages)).select("host", "wrapper")
    total = inferred.select(F.sum(F.octet_length("wrapper") + F.octet_length("host"))).first()[0] or 0
    if total <= BROADCAST_BYTES:
        met = pages.join(F.broadcast(inferred), "host", "left")
    else:  # a host with a third of all pages meets its wrapper in SALTS places
        spread = inferred.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = pages.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(spread, ["host", "salt"], "left")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict[str, Place] = {}
        size = 0
        for batch in batches:
            texts = []
            for page, wrapper in zip(batch.column(2), batch.column(3), strict=True):
                wrapper = wrapper.as_py()
                if wrapper is not None and wrapper not in places:
                    if size > HELD:
                        places.clear()
                        size = 0
                    places[wrapper] = Place(*json.loads(wrapper))
                    size += len(wrapper)
                texts.append(extract(page.as_py(), places.get(wrapper)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return met.select("page_id", "url", "html", "wrapper").mapInArrow(each, OUT)


def op3_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


QUERIES = {"op3_html_wrappers": op3_html_wrappers}
ORACLES: dict[str, str] = {}
