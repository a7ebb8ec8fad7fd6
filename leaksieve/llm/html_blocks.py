"""A tolerant reader of HTML: the blocks of a page with their root-to-leaf tag paths."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from typing import NamedTuple

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup; none of it is shown as text of the page.
RAW = frozenset("iframe noembed noframes noscript script style textarea title xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary "
    "table tbody td tfoot th thead tr ul".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an opening tag closes if it is open, and the elements beyond which it does not look.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
}

#: Elements, roles and words of class names or ids of what surrounds an article.
AROUND = frozenset("aside button canvas dialog footer head menu nav object search select svg template video audio".split())
AROUND_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
AROUND_WORDS = frozenset(
    "ad ads adsense adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment commentlist comments consent "
    "cookie cookies copyright disclaimer discussion disqus footer gdpr login masthead menu modal nav navbar navigation newsletter "
    "notice notices overlay pager pagination paging popup promo promotion recommended recommendations related replies reply "
    "respond responses search share sharing sidebar signin signup skip social sponsor sponsored submenu subscribe subscription "
    "teaser toolbar topbar widget".split())
#: Beginnings of further such words, as in ``cookiebar``.
AROUND_STEMS = ("advert", "breadcrumb", "cookie", "navbar", "newsletter", "sidebar")
#: Words before which nothing is said about the element itself, as in ``has-sidebar``.
NOT_ITSELF = frozenset("has with no not without".split())
#: Of these, an article can be one: a reader's comment or an advert.
NOT_ARTICLES = frozenset("ad ads advert advertisement comment comments promo related reply sponsored teaser".split())
#: Names of elements that hold an article where there is no ``article`` or ``main``.
CONTENT_NAMES = frozenset(
    "article article-body article-content article-text articlebody content content-body entry entry-content main-content page-content post "
    "post-body post-content story story-body".split())

_MAX_DEPTH = 512
_MAX_TORN = 64

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)>""")
_TORN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Block(NamedTuple):
    """A block of text: its path's number, the path's parent's, whether it is a heading, the trust in what holds it (0 to 3),
    its text and how many of its characters are links."""

    path: int
    parent: int
    heading: bool
    trust: int
    text: str
    linked: int


class _Kind(NamedTuple):
    """What a start tag says: its step of a path, whether the element is outside of articles, and the trust in it."""

    step: str
    around: bool
    trust: int


class _Open(NamedTuple):
    name: str
    around: bool
    form: bool
    trust: int
    path: int
    linked: bool
    heading: bool
    # In a header of an article only headings count.
    header: bool


@lru_cache(maxsize=1 << 14)
def _kind(name: str, attributes: str) -> _Kind:
    found = {}
    for key, value in _ATTRIBUTE.findall(attributes):
        found.setdefault(key.lower(), unescape(value[1:-1] if value[:1] in "\"'" and value[:1] else value))
    names = [*found.get("class", "").split(), *found.get("id", "").split()]
    words = set()
    for each in names:
        parts = [w.lower() for w in _WORD.findall(each)]
        if parts and parts[0] not in NOT_ITSELF:
            words |= {parts[0], parts[-1]}
    role = found.get("role", "").lower()
    article = name == "article" or role == "article" or found.get("itemprop", "").lower() == "articlebody"
    main = name == "main" or role == "main"
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool(_HIDDEN.search(found.get("style", "")))
    telling = AROUND_WORDS if not (article or main) else NOT_ARTICLES
    stems = not (article or main) and any(word.startswith(AROUND_STEMS) for word in words)
    around = name not in ("html", "body") and bool(name in AROUND or role in AROUND_ROLES or words & telling or stems or hidden)
    trust = 3 if article else 2 if main else 1 if not CONTENT_NAMES.isdisjoint(n.lower() for n in names) and name not in ("html", "body") else 0
    step = ".".join([name, *sorted(n for n in found.get("class", "").split() if n.isalpha())])
    return _Kind(step, around, trust)


def _runs(html: str) -> Iterator[tuple[str, str, str, str]]:
    """(text, slash, name, attributes): each tag, with the text before it. Comments and declarations are left out."""
    at, torn, end = 0, 0, len(html)
    while at < end:
        begin = html.find("<", at)
        if begin < 0:
            yield html[at:], "", "", ""
            return
        following = html[begin + 1:begin + 2]
        if following.isascii() and following.isalpha() or following == "/" and html[begin + 2:begin + 3].isalpha() and html[begin + 2].isascii():
            tag = _TAG.match(html, begin) if torn < _MAX_TORN else None
            if tag is None:
                # A quote that is never closed: the tag ends at the next ">". Few are looked at twice, as that reads to the end.
                torn += 1
                tag = _TORN_TAG.match(html, begin)
            yield html[at:begin], "", "", ""
            if tag is None:
                return
            slash, name, attributes = tag.groups()
            name, at = name.lower(), tag.end()
            yield "", slash, name, attributes
            if not slash and name in RAW:
                close = _closing(name).search(html, at)
                if close is None:
                    return
                at = close.start()
            continue
        if following in ("!", "?", "/"):
            yield html[at:begin], "", "", ""
            if html.startswith("<!--", begin):
                stop = _EMPTY_COMMENT.match(html, begin + 4) or _COMMENT_END.search(html, begin + 4)
                if stop is None:
                    return
                at = stop.end()
            else:
                at = html.find(">", begin) + 1
                if not at:
                    return
            continue
        yield html[at:begin + 1], "", "", ""
        at = begin + 1


_EMPTY_COMMENT = re.compile(r"-?>")
_COMMENT_END = re.compile(r"--!?>")


@lru_cache(maxsize=32)
def _closing(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])", re.I)


def blocks(html: str) -> list[Block]:
    """The blocks of a page that are not around an article, in page order.

    Text is decoded and its white space made single spaces. Elements nested deeper than browsers do (512) count as parts of
    the one that holds them.
    """
    found: list[Block] = []
    paths: dict[tuple[int, str], int] = {}
    parents = [-1]
    root = _Open("", False, False, 0, 0, False, False, False)
    stack, open_names = [root], Counter()
    pieces: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                top = next(e for e in reversed(stack) if e.name in BLOCK or not e.name)
                found.append(Block(top.path, parents[top.path], stack[-1].heading, top.trust, text, linked))
            pieces.clear()
        linked = 0

    def pop() -> None:
        open_names[stack.pop().name] -= 1

    def close(name: str) -> None:
        if not open_names[name]:
            return
        if name in BLOCK:
            flush()
            while stack[-1].name != name:
                pop()
            pop()
            return
        # An inline end tag does not close the blocks that were opened since.
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name == name:
                del stack[i]
                open_names[name] -= 1
                return

    def close_before(name: str) -> None:
        """Closes what the start tag of a block ends: a paragraph, or an item of the same list."""
        if open_names["p"]:
            close("p")
        closes, within = CLOSES.get(name, ((), ()))
        for i in range(len(stack) - 1, 0, -1):
            if not closes or stack[i].name in within:
                return
            if stack[i].name in closes and not any(stack[j].name in closes for j in range(max(1, i - 2), i)):
                while len(stack) > i:
                    pop()
                return

    for text, slash, name, attributes in _runs(html):
        top = stack[-1]
        if text:
            if not (top.around or top.form) and not (top.header and not top.heading):
                decoded = unescape(text)
                pieces.append(decoded)
                if top.linked:
                    linked += len("".join(decoded.split()))
            continue
        if not name:
            continue
        if slash:
            close(name)
            continue
        if name == "br":
            pieces.append(" ")
            continue
        block = name in BLOCK
        if block:
            flush()
            close_before(name)
            top = stack[-1]
        if name in VOID or name in RAW or len(stack) >= _MAX_DEPTH:
            continue
        kind = _kind(name, attributes)
        trust = max(top.trust, kind.trust)
        # Some sites are one form: an article inside it is none.
        form = (top.form or name == "form") and kind.trust < 2
        header = top.header or name == "header" and top.trust > 0
        around = top.around or kind.around or name == "header" and not top.trust
        path = top.path
        if block:
            key = (path, kind.step)
            path = paths.get(key)
            if path is None:
                path = paths[key] = len(parents)
                parents.append(key[0])
        heading = name in HEADING or top.heading and not block
        stack.append(_Open(name, around, form, trust, path, top.linked or name == "a", heading, header))
        open_names[name] += 1
    flush()
    return found
