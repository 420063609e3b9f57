"""Main text of web pages by two passes over their blocks.

A page is cut into blocks at block-level tags. The first pass decides what it can from a
block's place (menus, footers, adverts, comments and the like are marked as such by their tags,
or by names of theirs, see ``named_away``), its link density (outside a declared article), its
length and its share of stop words. What is short, or long but
neither prose nor marked, stays open. The second pass gives an open block the label of the
nearest decided blocks of the same part of the page; where they disagree, the nearer one counts.

Where a page says what its article is (``article``, ``main``), only that part can be text, and
open blocks without decided neighbours are kept there. In it, mostly linked text is open, not
decided. Elsewhere they take the label of the
nearest decided blocks of the enclosing part, or of the one around that, up to the page. Where
no block of a page is text, as in languages without a list of stop words, length and link
density alone decide; where all open blocks are short, they all are text.

Character references are decoded, white space inside a block becomes one space, and blocks are
joined by one line feed. Nothing is cut off.

Defined results: null or empty html gives an empty text; unclosed and crossing tags, comments
and quotes are read on to the end of the page as far as they reach; repeated rows get equal
results; other columns are carried along, and ``text`` and ``n_chars`` replaced.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordgauge.llm.columns import per_text, with_columns
from recordgauge.llm.stop_words import STOP_WORDS

# Elements by what they mean for the text around them.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main "
    "menu nav noscript ol p pre section summary table tbody td template tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea".split())
OUTSIDE = frozenset(
    "aside button canvas dialog footer head iframe menu noscript object option select svg "
    "template textarea title".split()
)
#: Outside a declared article as good as a name: a form can be around the whole page, a menu
#: can be left open.
NAMED_TAGS = frozenset(("form", "nav"))
TEXT_PARTS = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
ENDS_PARAGRAPH = BLOCK - {"body", "html", "head"}
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu navigation search".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement adsense banner breadcrumb breadcrumbs byline comment comments "
    "consent cookie cookies copyright disclaimer disqus footer gdpr header hidden login masthead menu modal "
    "nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion "
    "recommended related replies reply respond search share sharing sidebar signup skip social sponsor "
    "sponsored subscribe subscription teaser toolbar widget".split()
)
#: Words that only say more of the part a name names (comments-area, ad-slot).
PLACES = frozenset(
    "area articles bar block body bottom box button buttons container footer form group icon icons inner item items "
    "left links list main module nav outer panel placeholder posts right section site slot stories top unit user "
    "widgets wrap wrapper".split()
)
#: Words that make a name one of what an element has, not of what it is (has-sidebar).
HAVING = frozenset("has have hide is no not show with without".split())
#: With one of these, a header is the head of a text.
TEXT_WORDS = frozenset("article content entry main post section story text".split())
COMMENT_NAMES = frozenset("comment comments disqus replies reply respond".split())

MAX_LINKS = 0.4
SHORT = 80
PROSE = 0.2
#: An element with more of the page's prose is the page's text, whatever its name.
MAIN_SHARE = 0.8
_STOP = frozenset(STOP_WORDS)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<rest2>[^>]*+)(?:>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|(?P<text>[^<]++|<)",
    re.DOTALL,
)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=[\s/=]|$)|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.IGNORECASE)
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Element(NamedTuple):
    tag: str
    outside: bool
    text_part: bool
    part: int
    #: The innermost element around it whose name says that it is no text, or -1.
    named: int = -1


@dataclass
class Block:
    text: str
    linked: int
    outside: bool
    text_part: bool
    part: int
    heading: bool = False
    label: bool | None = None
    named: int = -1


def _names_it(token: str, names: frozenset[str]) -> bool:
    """Whether a whole class or id names a part of ``names`` and not what its element has."""
    words = [w.lower() for w in _NAME_PARTS.findall(token)]
    said = [w for w in words if w in names]
    if not said or not HAVING.isdisjoint(words):
        return False
    if said[-1] == "header" and not TEXT_WORDS.isdisjoint(words):
        return False
    return words[-1] in names or all(w in names or w in PLACES for w in words)


def _is_outside(tag: str, attributes: str, in_text_part: bool) -> bool:
    """Whether an element is known by more than a name not to hold the page's text."""
    if tag in OUTSIDE or (tag == "header" and not in_text_part) or (tag in NAMED_TAGS and in_text_part):
        return True
    if not attributes or tag in ("html", "body"):
        return False
    if _HIDDEN.search(attributes):
        return True
    found = _NAMED.findall(attributes)
    return any(kind.lower() == "role" and "".join(values).strip().lower() in ROLES for kind, *values in found)


def _name_of(tag: str, attributes: str, in_text_part: bool) -> str | None:
    """What the element's classes and id say that it is: ``comment``, ``other`` or nothing."""
    if tag in NAMED_TAGS:
        return "other"
    if not attributes or tag in ("html", "body"):
        return None
    found = [(kind, "".join(values)) for kind, *values in _NAMED.findall(attributes)]
    tokens = [token for kind, value in found if kind.lower() != "role" for token in value.split()]
    if any(_names_it(token, COMMENT_NAMES) for token in tokens):
        return "comment"
    # Parts that declare themselves the text may be named for what they also hold, and inside
    # them a header is the text's own.
    names = NAMES - {"header"} if in_text_part else NAMES
    return "other" if tag not in TEXT_PARTS and any(_names_it(token, names) for token in tokens) else None


@dataclass
class Page:
    #: In order, with where they are and how much of them is linked.
    blocks: list[Block]
    #: Per part the one around it; a part comes after the one around it.
    around: list[int]
    #: Per named element what its name says, and the named element around it.
    names: list[tuple[str, int]]


def blocks_of(page: str) -> list[Block]:
    return parsed(page).blocks


def parsed(page: str) -> Page:
    stack = [Element("", False, False, 0)]
    n_open: Counter[str] = Counter()  # of the stack, by tag
    around, names = [0], []
    blocks: list[Block] = []
    pieces: list[str] = []
    linked = links = 0

    def close_block() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(pieces)).split())
        if text:
            top = stack[-1]
            blocks.append(Block(text, linked, top.outside, top.text_part, top.part, top.tag in HEADINGS, None, top.named))
        pieces.clear()
        linked = 0

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.match(page, at)
        at = m.end()
        text = m["text"]
        if text is not None:
            pieces.append(text)
            if links:
                linked += len("".join(html.unescape(text).split()))
            continue
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        rest = m["rest"] if m["tag"] else m["rest2"]
        if m["end"] or m["end2"]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCK or tag in OUTSIDE:
                close_block()
                if n_open[tag]:
                    while (popped := stack.pop().tag) != tag:
                        n_open[popped] -= 1
                    n_open[tag] -= 1
            continue
        if tag == "br":
            pieces.append(" ")
        elif tag == "a":
            links = min(1, links + 1)
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.IGNORECASE).search(page, at)
            at = end.start() if end else size
            if tag == "textarea":
                close_block()
            continue
        if tag in VOID:
            if tag == "hr":
                close_block()
            continue
        if tag not in BLOCK and tag not in OUTSIDE:
            if not _is_outside(tag, rest, stack[-1].text_part) and not _name_of(tag, rest, stack[-1].text_part):
                continue
        close_block()
        if tag in BLOCK:
            links = 0
        if tag in ENDS_PARAGRAPH and stack[-1].tag == "p":
            n_open[stack.pop().tag] -= 1
        if tag == stack[-1].tag and tag in ("li", "dt", "dd", "td", "th", "tr", "option"):
            n_open[stack.pop().tag] -= 1
        above = stack[-1]
        outside = _is_outside(tag, rest, above.text_part)
        name = None if outside else _name_of(tag, rest, above.text_part)
        named = above.named
        if name:
            names.append((name, named))
            named = len(names) - 1
        is_part = tag in TEXT_PARTS
        part = above.part
        if is_part or outside or name or tag in ("section", "td"):
            around.append(part)
            part = len(around) - 1
        if not rest.rstrip().endswith("/") or tag in BLOCK:
            stack.append(Element(tag, above.outside or outside, above.text_part or is_part, part, named))
            n_open[tag] += 1
    close_block()
    return Page(blocks, around, names)


def _is_prose(block: Block) -> bool:
    words = block.text.split()
    stop = sum(w.strip(".,;:!?\"'()").lower() in _STOP for w in words) / len(words)
    return len(block.text) >= SHORT and stop >= PROSE


def named_away(page: Page) -> None:
    """Marks as outside what is in elements named as no text, where the page's prose agrees.

    The name of an element that holds more than ``MAIN_SHARE`` of the prose says nothing, comments
    apart. If no prose is left, first the other names and then those of comments say nothing. On
    a page without prose, its longer blocks stand for it.
    """
    free = [not b.outside and b.linked <= MAX_LINKS * len(b.text.replace(" ", "")) for b in page.blocks]
    prose = [len(b.text) if f and _is_prose(b) else 0 for b, f in zip(page.blocks, free, strict=True)]
    if not any(prose):
        prose = [len(b.text) if f and len(b.text) >= SHORT else 0 for b, f in zip(page.blocks, free, strict=True)]
    held = [0] * len(page.names)
    for block, n in zip(page.blocks, prose, strict=True):
        if block.named >= 0:
            held[block.named] += n
    # An element comes after the one around it.
    for i in range(len(held) - 1, -1, -1):
        if page.names[i][1] >= 0:
            held[page.names[i][1]] += held[i]
    total = sum(prose)
    for kept in ((), ("other",), ("other", "comment")):
        cut: list[bool] = []
        for (name, outer), n in zip(page.names, held, strict=True):
            own = name not in kept and (name == "comment" or n <= MAIN_SHARE * total)
            cut.append(own or (outer >= 0 and cut[outer]))
        gone = [b.named >= 0 and cut[b.named] for b in page.blocks]
        if not total or any(n and not g for n, g in zip(prose, gone, strict=True)):
            break
    for block, g in zip(page.blocks, gone, strict=True):
        block.outside = block.outside or g


def first_pass(block: Block, has_text_part: bool) -> bool | None:
    """True for text, False for what is not, None where the block alone does not tell."""
    if block.outside or (has_text_part and not block.text_part):
        return False
    letters = len(block.text.replace(" ", ""))
    if block.linked > MAX_LINKS * letters:
        return None if has_text_part else False
    return True if _is_prose(block) else None


def _nearest(members: list[Block]) -> list[tuple[tuple[int, bool] | None, tuple[int, bool] | None]]:
    """Per block the place and label of the nearest decided blocks before and after it."""
    n = len(members)
    before: list[tuple[int, bool] | None] = [None] * n
    after: list[tuple[int, bool] | None] = [None] * n
    for found, order in ((before, range(n)), (after, range(n - 1, -1, -1))):
        near = None
        for i in order:
            found[i] = near
            if members[i].label is not None:
                near = (i, members[i].label)
    return list(zip(before, after, strict=True))


def _label(i: int, heading: bool, one: tuple[int, bool] | None, other: tuple[int, bool] | None) -> bool:
    if one is None or other is None:
        return (one or other)[1]
    if i - one[0] != other[0] - i:
        return min((i - one[0], one[1]), (other[0] - i, other[1]))[1]
    # A heading belongs to what follows it; other text is rather kept.
    return other[1] if heading else one[1] or other[1]


def second_pass(blocks: list[Block], around: list[int] | None = None) -> None:
    """Labels for the open blocks, from the nearest decided ones of their part or those around it."""
    around = around or [0] * (max((b.part for b in blocks), default=0) + 1)
    parts: dict[int, list[Block]] = {}
    for block in blocks:
        parts.setdefault(block.part, []).append(block)
    labels: list[tuple[Block, bool]] = []
    for members in parts.values():
        for i, (block, (one, other)) in enumerate(zip(members, _nearest(members), strict=True)):
            if block.label is None and (one or other):
                labels.append((block, _label(i, block.heading, one, other)))
            elif block.label is None and block.text_part:
                labels.append((block, True))
    for block, label in labels:
        block.label = label
    _inherit([b for b in blocks if not b.outside], around)


def _inherit(blocks: list[Block], around: list[int]) -> None:
    """Labels for what is still open; a part's blocks and those of the parts in it are in a row."""
    if all(b.label is not None for b in blocks):
        return
    first, last = [len(blocks)] * len(around), [-1] * len(around)
    decided = [False] * len(around)
    for i, block in enumerate(blocks):
        first[block.part], last[block.part] = min(first[block.part], i), i
        decided[block.part] |= block.label is not None
    for part in range(len(around) - 1, 0, -1):
        outer = around[part]
        first[outer], last[outer] = min(first[outer], first[part]), max(last[outer], last[part])
        decided[outer] |= decided[part]
    # The innermost part around each that has a decided block.
    source = list(range(len(around)))
    for part in range(1, len(around)):
        if not decided[part]:
            source[part] = source[around[part]]
    found = []
    for i, (block, (one, other)) in enumerate(zip(blocks, _nearest(blocks), strict=True)):
        low, high = first[source[block.part]], last[source[block.part]]
        one, other = one if one and one[0] >= low else None, other if other and other[0] <= high else None
        if block.label is not None:
            found.append(block.label)
        else:
            found.append(_label(i, block.heading, one, other) if one or other else False)
    for block, label in zip(blocks, found, strict=True):
        block.label = label


def without_prose(blocks: list[Block]) -> None:
    """Where no block is text, the long open ones are or, if there are none, all of them."""
    if any(b.label for b in blocks):
        return
    still = [b for b in blocks if b.label is None]
    for block in [b for b in still if len(b.text) >= SHORT] or still:
        block.label = True


def main_text(page: str | None) -> str:
    """The page's text blocks, joined by line feeds."""
    found = parsed(page or "")
    named_away(found)
    blocks = found.blocks
    has_text_part = any(b.text_part and not b.outside for b in blocks)
    for block in blocks:
        block.label = first_pass(block, has_text_part)
    if not has_text_part:
        without_prose(blocks)
    second_pass(blocks, found.around)
    return "\n".join(b.text for b in blocks if b.label)


def extract(pages: DataFrame, page: str = "html") -> DataFrame:
    """``pages`` with ``text`` and its length in code points, ``n_chars``."""
    found = with_columns(pages, text=per_text(main_text, "string")(F.col(page)))
    return with_columns(found, n_chars=F.length("text").cast("long"))
