"""Blocks of text of an HTML page and the tree of elements around them, each with a hash of its subtree.

One pass over the tags; time and memory grow with the page's length, however deep it is.
"""

from __future__ import annotations

import re
from collections import Counter
from hashlib import blake2b
from html import unescape

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|style|aria-hidden|hidden)\b\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody tfoot thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Share of link text from which a block counts as links, not prose.
LINKED = 0.6
SPACED = frozenset("br td th".split())
#: Elements that are never part of the article.
NEVER = frozenset("nav footer aside form script style noscript template iframe svg button select option textarea title head dialog menu object canvas audio video map search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
#: Words in class or id, between hyphens, underscores and spaces, that mark what isn't article.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adbox|adslot|sponsor\w*|banner|promo\w*|side-?bar|widget|menu|nav|navbar|navigation|breadcrumbs?|masthead|footer|cookies?|consent|gdpr|notices?|notification|alert|popup|modal|overlay|newsletter|subscribe|subscription|sign-?up|comments?|commentlist|repl(?:y|ies)|disqus|respond|share|sharing|social|related|recommend\w*|login|pagination|pager|toolbar|skip-?links?|copyright|disclaimer)(?=$|[\s_-])",
    re.I,
)
HEADER = re.compile(r"(?:^|[\s_-])header(?=$|[\s_-])", re.I)
#: What an opening tag closes: an open element of the value's kinds, unless one of the walls stands between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"}),
}
NO_P = BLOCK - {"body", "html", "option", "optgroup", "legend", "caption", "tbody", "thead", "tfoot", "tr"}
WALLS = frozenset("article aside section div table td th nav header footer main form body html".split())


class Element:
    """An element; its blocks are those of page order from first to last, end excluded."""

    __slots__ = ("tag", "up", "dead", "heads_only", "heading", "article", "main", "region", "named", "outer", "parts", "first", "last", "digest")

    def __init__(self, tag: str, up: Element | None, first: int):
        self.tag, self.up, self.first, self.last = tag, up, first, first
        self.dead, self.heads_only = (up.dead, up.heads_only) if up else (False, False)
        self.heading = tag in HEADINGS or (up is not None and up.heading)
        self.article, self.main = (up.article, up.main) if up else (False, False)
        #: The innermost article or main element around this one.
        self.region: Element | None = (up if up.tag in ("article", "main") else up.region) if up else None
        #: Whether its own name speaks against it: "all", or "heads" where headings stay.
        self.named = ""
        #: Whether an element around, or this one, outside of articles, or outside of main elements, has such a name.
        self.outer: tuple[bool, bool] = up.outer if up else (False, False)
        self.parts: list[bytes] = []
        self.digest = b""


class Block:
    __slots__ = ("text", "article", "main", "links", "dead", "heading", "at")

    def __init__(self, text: str, links: float, at: Element):
        self.text, self.links, self.at = text, links, at
        self.article, self.main, self.heading = at.article, at.main, at.heading
        #: Part of an element that is never article, by tag, role or name.
        self.dead = at.dead or (at.heads_only and not ((at.article or at.main) and at.heading))


def mark(e: Element, tag: str, attributes: str) -> None:
    """Set what the tag and its attributes say about e."""
    names = role = ""
    if "=" in attributes or "hidden" in attributes:
        for m in ATTRIBUTE.finditer(attributes):
            k, v = m[1].lower(), m[2] or m[3] or m[4] or ""
            if k in ("class", "id"):
                names += " " + v
            elif k == "role":
                role = v.lower()
            elif k == "hidden" or (k == "aria-hidden" and v.lower() == "true") or (k == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v, re.I)):
                e.dead = True
    if tag in NEVER or role in ROLES:
        e.dead = True
    elif tag == "header":
        e.heads_only = True
    elif names and role != "main" and tag not in ("html", "body", "main", "article"):
        if MARKS.search(names):
            e.named = "all"
        elif HEADER.search(names):
            e.named = "heads"
        if e.named:
            e.outer = (e.outer[0] or not e.article, e.outer[1] or not e.main)
    if tag == "article":
        e.article = True
    elif tag == "main" or role == "main":
        e.main = True


def sums(values) -> list[int]:
    """Sums of the first 0, 1, 2, ... values."""
    out = [0]
    for v in values:
        out.append(out[-1] + v)
    return out


class Page:
    """Blocks and elements (in the order of their opening tags) of a page."""

    def __init__(self, blocks: list[Block], elements: list[Element]):
        self.blocks, self.elements = blocks, elements

    def judge_names(self) -> None:
        """Kill the blocks of elements whose names speak against them, unless more than a name speaks for them.

        An element stays if it holds the page's only articles, or its only main elements, or more than half of its prose.
        """
        prose = sums(0 if b.dead or b.links >= LINKED else len(b.text) for b in self.blocks)
        free = [any(not b.dead and on(b) and not b.at.outer[i] for b in self.blocks) for i, on in enumerate((lambda b: b.article, lambda b: b.main))]
        articles, mains = (sums(map(on, self.blocks)) for on in (lambda b: b.article, lambda b: b.main))
        inside = lambda s, e: s[e.last] - s[e.first]
        killed: dict[Element, str] = {}
        for e in self.elements:
            of = killed.get(e.up, "") if e.up else ""
            if e.named and of != "all":
                article = not e.article and inside(articles, e) > 0
                only = not free[0] and (article or (not free[1] and not e.main and inside(mains, e) > 0))
                if not (only or 2 * inside(prose, e) > prose[-1]):
                    of = e.named
            if of:
                killed[e] = of
        for b in self.blocks:
            of = killed.get(b.at, "")
            b.dead = b.dead or of == "all" or (of == "heads" and not (b.heading and (b.article or b.main)))

    def keys(self, seed: bytes) -> tuple[dict[Element, list[int]], set[int]]:
        """Keys of the elements that may be template, and those of them that are no evidence on this page.

        Outside of articles and main elements a key stands for the element's subtree. Inside, an element counts that is
        no paragraph or heading itself, whatever it holds: by its place from either end of the article (even keys) and
        anywhere in it (odd keys). An element with more than half of the page's or article's text is no evidence there;
        text that is dead anyway counts only where an element has nothing else. seed (the host) is part of every key.
        """
        live, every = sums(0 if b.dead else len(b.text) for b in self.blocks), sums(len(b.text) for b in self.blocks)
        out: dict[Element, list[int]] = {}
        most: set[int] = set()
        for e in self.elements:
            r = e.region
            if not e.digest or (r and (e.tag == "p" or e.tag in HEADINGS)):
                continue
            size = live if live[e.last] > live[e.first] else every
            n, around = size[e.last] - size[e.first], size[r.last] - size[r.first] if r else size[-1]
            if r:
                keys = [number(seed, e.digest, b"s%d" % (e.first - r.first)) & ~1, number(seed, e.digest, b"e%d" % (r.last - e.last)) & ~1, number(seed, e.digest, b"") | 1]
            else:
                keys = [number(seed, e.digest, b"") & ~1]
            out[e] = keys
            if 2 * n > around:
                most.update(keys)
        return out, most


def number(*parts: bytes) -> int:
    return int.from_bytes(blake2b(b"\0".join(parts), digest_size=8).digest(), "big", signed=True)


def blocks_of(html: str) -> list[str]:
    """The texts of a page's blocks, in page order."""
    return [b.text for b in parse(html, hashed=False).blocks]


def parse(html: str, hashed: bool = True) -> Page:
    """The page; unless hashed, no element has a digest."""
    out: list[Block] = []
    root = Element("html", None, 0)
    elements, stack = [root], [root]
    open_tags: Counter = Counter(html=1)
    text: list[str] = []
    links = 0

    def flush() -> None:
        nonlocal links
        if text:
            t = " ".join(unescape("".join(text)).split())
            text.clear()
            if t:
                out.append(Block(t, links / len(t), stack[-1]))
                if hashed:
                    stack[-1].parts.append(t.encode(errors="surrogatepass"))
        links = 0

    def pop_to(i: int) -> None:
        """Close the elements from stack[i] on."""
        if any(e.tag in BLOCK for e in stack[i:]):
            flush()
        while len(stack) > i:
            e = stack.pop()
            open_tags[e.tag] -= 1
            e.last = len(out)
            if hashed and e.parts:
                digest = blake2b(b"\n".join([e.tag.encode(errors="surrogatepass"), *e.parts]), digest_size=8).digest()
                stack[-1].parts.append(digest)
                if e.tag in BLOCK and e.tag not in ("html", "body", "main", "article"):
                    e.digest = digest
                e.parts.clear()

    def close_open(kinds: set[str], walls: set[str]) -> None:
        """Close the innermost open element of the kinds, unless a wall stands between."""
        if not any(open_tags[k] for k in kinds):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in kinds:
                pop_to(i)
                return
            if stack[i].tag in walls:
                return

    at, n = 0, len(html)
    while at < n:
        m = TAG.search(html, at)
        piece = html[at : m.start() if m else n]
        if piece:
            text.append(piece)
            if open_tags["a"]:
                links += len(piece.strip())
        if not m:
            break
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                text.append(m[0][9:-3])
            continue
        tag = m[2].lower()
        if m[1]:
            close_open({tag}, WALLS if tag not in WALLS else frozenset())
            if tag in BLOCK:
                flush()
            continue
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}\\s*>", re.I).search(html, at)
            at = end.end() if end else n
            continue
        if tag in CLOSES:
            close_open(*CLOSES[tag])
        if tag in NO_P:
            close_open({"p"}, WALLS)
        if tag in SPACED:
            text.append(" ")
        if tag in BLOCK:
            flush()
        if tag in VOID or (m[3].endswith("/") and tag not in BLOCK):
            continue
        e = Element(tag, stack[-1], len(out))
        mark(e, tag, m[3])
        stack.append(e)
        elements.append(e)
        open_tags[tag] += 1
    pop_to(1)
    flush()
    root.last = len(out)
    return Page(out, elements)
