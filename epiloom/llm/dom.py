"""Leaf blocks of a page's document tree: runs of text without a block boundary inside, and the path that leads to each."""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
QUOTED = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
SPACE = re.compile(r"[ \t\n\r\f\v  -​　]+")
# HTML's element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style textarea title xmp noframes iframe noembed".split())
UNSEEN = frozenset("head template object svg math canvas audio video select datalist".split())
#: An opening tag of these ends an open element of the same set member's kind.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table article section div nav aside main body form blockquote td".split())
NAME = re.compile(r"[A-Za-z][a-z]+|[A-Z]+(?![a-z])")


@dataclass(slots=True)
class Node:
    """An element; what its blocks inherit is held by reference, so that deep trees cost no more than flat ones."""

    tag: str
    parent: Node | None
    new: tuple[str, ...]  # in:tag and name:word features that no element around has
    hidden: bool  # it or an element around
    holder: str  # the innermost of HOLDERS, itself included


HOLDERS = frozenset("article main aside nav header footer form section".split())


@dataclass(slots=True)
class Block:
    text: str
    node: Node | None
    linked: int = 0  # characters inside links
    marked: tuple[str, ...] = field(default=())  # inline tags in the block


def described(attributes: str) -> tuple[list[str], bool]:
    """Words of id, class, role and itemprop; whether the element is hidden."""
    names, hidden = [], False
    if attributes and not attributes.isspace():
        for key, value in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'")
            if key in ("id", "class", "role", "itemprop"):
                names += [w.lower() for w in NAME.findall(value)]
            elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
                hidden = True
    return names, hidden


def tags_of(page: str):
    """(begin, end, tag, whether it ends an element, attributes) of each tag; tag is "" for comments and the like.

    Looks at no character more often than a fixed number of times: where quotes
    don't close, they count as plain characters from there on.
    """
    at, last, quotes = 0, page.rfind(">"), True
    cdata = page.rfind("]]>")
    while (i := page.find("<", at)) >= 0:
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            at = end + 3 if end >= 0 else len(page)
            yield i, at, "", False, ""
        elif i > last:
            return
        elif page.startswith(("<!", "<?"), i):
            at = (page.find("]]>", i) + 3) if i < cdata and page.startswith("<![CDATA[", i) else page.find(">", i) + 1
            yield i, at, "", False, ""
        elif m := TAG.match(page, i):
            end = QUOTED.match(page, m.end()) if quotes else None
            quotes = quotes and end is not None
            at = end.end() if end else page.find(">", m.end()) + 1
            yield i, at, m[2].lower(), bool(m[1]), page[m.end() : at - 1]
        else:  # a bare <
            at = i + 1


def leaf_blocks(page: str) -> list[Block]:
    """The page's blocks in order; markup that is broken or unended is read as browsers do, more or less."""
    blocks: list[Block] = []
    stack: list[Node] = []
    places: dict[str, list[int]] = defaultdict(list)  # of the open elements of each tag
    held: Counter[str] = Counter()  # features of open elements
    pieces: list[str] = []
    linked = 0
    in_link = 0
    unseen = 0
    marked: set[str] = set()

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = SPACE.sub(" ", "".join(pieces)).strip()
            if text:
                blocks.append(Block(text, stack[-1] if stack else None, min(linked, len(text)), tuple(sorted(marked))))
            pieces.clear()
        linked = 0
        marked.clear()

    def enter(tag: str, attributes: str) -> None:
        nonlocal unseen
        names, hidden = described(attributes)
        around = stack[-1] if stack else None
        new = tuple(x for x in dict.fromkeys([f"in:{tag}", *(f"name:{w}" for w in names)]) if not held[x])
        held.update(new)
        places[tag].append(len(stack))
        stack.append(Node(tag, around, new, hidden or (around is not None and around.hidden), tag if tag in HOLDERS else around.holder if around else "none"))
        unseen += tag in UNSEEN

    def leave() -> None:
        nonlocal unseen
        node = stack.pop()
        places[node.tag].pop()
        for x in node.new:
            del held[x]
        unseen -= node.tag in UNSEEN

    def add(raw: str) -> None:
        nonlocal linked
        if raw and not unseen:
            text = entities.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if in_link:
                linked += len(text)

    def close(tags, scope) -> None:
        """Ends the innermost open element of the tags, unless one of the scope lies within."""
        innermost = lambda kinds: max((places[t][-1] for t in kinds if places.get(t)), default=-1)
        k = innermost(tags)
        if k >= 0 and k >= innermost(scope):
            flush()
            while len(stack) > k:
                leave()

    at = 0
    for begin, end, tag, ending, attributes in tags_of(page):
        if begin < at:  # inside a script or the like
            continue
        add(page[at:begin])
        at = end
        if not tag:
            continue
        if ending:
            if tag in INLINE:
                in_link -= tag == "a" and in_link > 0
            elif tag == "p" or tag in VOID:
                if tag == "br":
                    pieces.append(" ")
                else:
                    close({tag}, frozenset())
            else:
                close({tag}, frozenset())
            continue
        if tag in RAW:
            over = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, at)
            at = page.find(">", over.end()) + 1 or len(page) if over else len(page)
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = 1
            if not unseen:
                marked.add(tag)
            continue
        if tag in VOID:
            if tag == "br":
                pieces.append(" ")
            elif tag == "hr":
                flush()
            continue
        flush()
        in_link = in_link and tag not in ("p", "div", "li")
        if tag == "body":
            close({"head"}, frozenset())
        if stack and stack[-1].tag == "p":
            leave()
        if tag in CLOSES:
            close(CLOSES[tag], SCOPES - {"td"} if tag == "tr" else SCOPES)
        if not attributes.endswith("/") or tag not in UNSEEN:
            enter(tag, attributes)
    add(page[at:])
    flush()
    return blocks
