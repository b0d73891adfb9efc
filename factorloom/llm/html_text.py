"""Main text of web pages by tree scoring.

Paragraphs pass points (one, one for each comma, up to three for their length)
to their ancestors, less with each step up, discounted by the share of their
text that stands in links. The container with most points is kept, with those
of its siblings that look like parts of the article. Menus, forms, adverts,
notices and the like don't count, unless a page has its paragraphs in no other
place: some pages are one form, or have a wrapper named like a sidebar. Beside
it stay headings, short sections, lists, tables and captions of the same
container, unless they are links. Pages are independent rows, so the work is one Arrow pass over the table; one page's
tree is all that is held, and time is linear in its length.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTR = re.compile(r"([^\s=\"'/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style textarea title noscript iframe xmp template".split())
_BLOCK = set(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag ends open elements of these kinds, up to the nearest element of the second kind.
_ENDS = {t: ({"p"}, {"button", "td", "th", "caption"}) for t in _BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot"}}
_ENDS |= {
    "li": ({"li", "p"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd", "p"}, {"dl"}),
    "dd": ({"dt", "dd", "p"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Elements without text of the page, skipped with all that is in them.
_SKIPPED = set("head select svg canvas object audio video math datalist".split())
#: What a head holds; any other element's start ends it.
_IN_HEAD = set("title meta link style script base noscript template basefont bgsound".split())
#: Elements that aren't part of an article.
_ASIDE = set("nav footer aside form button menu dialog".split())
_ROLES = set("navigation banner contentinfo complementary search dialog alert".split())
#: A class or id is clutter if all its words are of these two sets and one is of the first.
_CLUTTER = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent "
    "notice notices comment comments disqus reply replies sidebar widget widgets nav navbar navigation menu breadcrumb "
    "breadcrumbs footer masthead topbar toolbar share sharing social related recommended subscribe subscription "
    "newsletter signup login popup modal overlay pagination pager skip commentlist commentslist commentform commentbox "
    "commentarea adsbygoogle adsense adslot adbox adunit sharethis addthis".split()
)
_NEUTRAL = set(
    "a area bar block bottom box button buttons col column container content form group header holder icons inner item "
    "items left link links list main outer panel post posts area primary right row secondary section site slot text "
    "thread to top unit user wrap wrapper global page sticky fixed hidden desktop mobile".split()
)
_GOOD = set("article content main post body entry text story blog page hentry prose".split())
_PARAGRAPH = set("p pre blockquote td li dd figcaption h1 h2 h3 h4 h5 h6".split())
_HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: What may be a part of an article beside its best container.
_PART = set("p pre blockquote section div ul ol dl table figure figcaption details address dd li".split())
_CONTAINER = set("article main section div td blockquote body html table ul ol dl".split())
_START = {"article": 10.0, "main": 10.0, "section": 3.0, "div": 3.0, "ul": -3.0, "ol": -3.0, "dl": -3.0}


class _Node:
    __slots__ = ("aside", "box", "commas", "kids", "linked", "names", "parent", "points", "score", "tag", "text_len")

    def __init__(self, tag: str, names: frozenset[str], aside: int, parent: _Node | None):
        self.tag, self.names, self.aside, self.parent = tag, names, aside, parent
        self.kids: list[_Node | str] = []
        self.score, self.points, self.text_len, self.linked, self.commas = 0.0, 0.0, 0, 0, 0
        #: The nearest container above.
        self.box: _Node | None = None if parent is None else parent if parent.tag in _CONTAINER else parent.box


#: Whether an element is part of an article: it may be; not, unless the page has nothing else; never.
_MAY, _NOT, _NEVER = 0, 1, 2


def _clutter(tag: str, attrs: str, inside: bool) -> tuple[int, frozenset[str]]:
    """Whether an element isn't part of an article, and the words of its class and id. inside: it stands in an article."""
    out = _MAY
    if tag in _ASIDE or tag == "header" and not inside:
        out = _NEVER if tag in ("footer", "button", "menu", "dialog") else _NOT
    if not attrs or "=" not in attrs and "hidden" not in attrs:
        return out, frozenset()
    found = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "").lower() for m in _ATTR.finditer(attrs)}
    bare = _ATTR.sub(" ", attrs).lower().split()
    tokens = [frozenset(re.split(r"[^a-z0-9]+", t)) - {""} for t in (found.get("class", "") + " " + found.get("id", "")).split()]
    hidden = "hidden" in bare or "hidden" in found or found.get("aria-hidden") == "true"
    hidden |= "display:none" in found.get("style", "").replace(" ", "")
    if hidden or found.get("role", "") in _ROLES:
        out = _NEVER
    elif tag not in ("html", "body", "article", "main"):
        named = [t & _CLUTTER for t in tokens if t & _CLUTTER and all(w in _CLUTTER or w in _NEUTRAL or w.isdigit() for w in t)]
        if named:
            out = max(out, _NOT)
    return out, frozenset().union(*tokens) if tokens else frozenset()


def _tree(html: str) -> _Node:
    """The elements and texts of a page, without skipped elements."""
    root = _Node("html", frozenset(), _MAY, None)
    here, dropped, pos, end = root, [], 0, len(html)  # dropped: open elements from a dropped one on
    path = [root]  # the open elements, each in the one before
    opened: defaultdict[str, list[int]] = defaultdict(list)  # where in the path those of a kind stand

    def text(raw: str) -> None:
        if raw and not dropped:
            here.kids.append(unescape(raw))

    def leave(to: _Node) -> None:
        nonlocal here
        while here is not to:
            opened[here.tag].pop()
            path.pop()
            here = here.parent

    while pos < end:
        at = html.find("<", pos)
        if at < 0:
            text(html[pos:])
            break
        text(html[pos:at])
        if html.startswith("<!--", at):
            stop = html.find("-->", at + 4)
            pos = end if stop < 0 else stop + 3
            continue
        if html[at + 1 : at + 2] in ("!", "?"):
            stop = html.find(">", at)
            pos = end if stop < 0 else stop + 1
            continue
        m = _TAG.match(html, at)
        if not m:
            if re.match(r"</?[a-zA-Z]", html[at : at + 3]):  # a tag that the page's end cuts off
                break
            text("<")
            pos = at + 1
            continue
        pos = m.end()
        closing, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        tag = tag.lower()
        if dropped:
            if closing:
                if tag in dropped:
                    while dropped.pop() != tag:
                        pass
                    continue
                if not opened[tag]:
                    continue
                dropped.clear()  # an element around it ends
            elif tag in _RAW:
                pos = _after_raw(html, pos, tag)
                continue
            elif dropped == ["head"] and tag not in _IN_HEAD:
                dropped.clear()  # a head's end tag may be left out
            else:
                if tag not in _VOID and not attrs.endswith("/"):
                    dropped.append(tag)
                continue
        if closing:
            if opened[tag]:
                node = here
                while node.tag != tag:
                    node = node.parent
                leave(node.parent)
            continue
        if tag in _RAW:
            pos = _after_raw(html, pos, tag)
            continue
        if tag in ("html", "body"):
            continue
        kinds, stops = _ENDS.get(tag, (None, None))
        if kinds and any(opened[k] for k in kinds):
            stop = max((opened[k][-1] for k in stops if opened[k]), default=0)
            last = min((own[k] for own in map(opened.__getitem__, kinds) if (k := bisect_right(own, stop)) < len(own)), default=None)
            if last is not None:
                leave(path[last].parent)
        if tag in _VOID:
            if tag in ("br", "hr"):
                here.kids.append("\n")
            continue
        if tag in _SKIPPED:
            if not attrs.endswith("/"):
                dropped.append(tag)
            continue
        aside, names = _clutter(tag, attrs, bool(opened["article"]))
        node = _Node(tag, names, aside, here)
        here.kids.append(node)
        if not attrs.endswith("/") or tag in _BLOCK:
            here = node
            opened[tag].append(len(path))
            path.append(node)
    return root


def _after_raw(html: str, pos: int, tag: str) -> int:
    """Where a raw-text element's end tag ends."""
    m = re.compile(rf"</{tag}[^>]*>", re.I).search(html, pos)
    return m.end() if m else len(html)


def _walk(root: _Node) -> list[_Node]:
    """All elements, parents first."""
    out = [root]
    for node in out:
        out.extend(k for k in node.kids if isinstance(k, _Node))
    return out


def _is_paragraph(node: _Node) -> bool:
    """Whether an element's text counts as a paragraph's."""
    if node.tag in _PARAGRAPH:
        return node.text_len > 0
    return node.tag in ("div", "section", "article", "main", "form") and any(isinstance(k, str) and k.strip() for k in node.kids)


def _points(node: _Node) -> float:
    """A paragraph's points."""
    return (1 + node.commas + min(node.text_len / 100, 3)) * (1 - node.linked / node.text_len)


def _without_asides(root: _Node) -> None:
    """Take from the tree what isn't part of an article.

    An aside whose paragraphs have more points than all that stand outside any
    aside, and at least as many as a short text's, is where the page has its text.
    """
    nodes = _walk(root)
    _measure(nodes)
    for node in nodes:
        if _is_paragraph(node):
            node.points += _points(node)
    inner: list[_Node] = []
    for node in reversed(nodes):  # of each element the points below it outside of further asides
        if node.parent is not None:
            if node.aside == _MAY:
                node.parent.points += node.points
            elif node.aside == _NOT:
                inner.append(node)
    best = max(inner, key=lambda x: x.points, default=None)
    if best is not None and best.points >= 2 and (root.points < 1 or best.tag == "form" and best.points > root.points):
        node: _Node | None = best
        while node is not None:
            if node.aside == _NEVER:
                break
            node = node.parent
        if node is None:
            node = best
            while node is not None:
                node.aside = _MAY
                node = node.parent
    for node in nodes:
        node.kids = [k for k in node.kids if not isinstance(k, _Node) or k.aside == _MAY]
        node.text_len = node.linked = node.commas = 0


def _measure(nodes: list[_Node]) -> None:
    for node in reversed(nodes):
        own = sum(len(k.strip()) for k in node.kids if isinstance(k, str))
        node.text_len += own
        node.commas += sum(k.count(",") + k.count("，") for k in node.kids if isinstance(k, str))
        if node.tag == "a":
            node.linked = node.text_len
        if node.parent is not None:
            node.parent.text_len += node.text_len
            node.parent.linked += node.linked
            node.parent.commas += node.commas


def _plain(node: _Node) -> list[str]:
    """The texts below an element, with line ends around blocks."""
    out: list[str] = []
    stack: list[_Node | str] = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        block = x.tag in _BLOCK
        if block:
            out.append("\n")
            stack.append("\n")
        stack.extend(reversed(x.kids))
    return out


def main_text(html: str) -> str:
    """The main text of one page; empty if it has none."""
    root = _tree(html)
    _without_asides(root)
    nodes = _walk(root)
    _measure(nodes)
    for node in nodes:
        if not _is_paragraph(node):
            continue
        points = _points(node)
        direct = node.tag not in _PARAGRAPH
        up, share = (node if direct and node.tag in _CONTAINER else node.box), 1.0
        while up is not None and share > 0.05:
            up.score += points * share
            share /= 2
            up = up.box
    best, most = None, 0.0
    for node in nodes:
        if node.tag in _CONTAINER and node.score > 0 and node.text_len:
            worth = node.score + _START.get(node.tag, 0.0) + 10.0 * bool(node.names & _GOOD)
            worth *= 1 - node.linked / node.text_len
            node.score = worth
            if worth > most:
                best, most = node, worth
    if best is None:
        return " ".join("".join(_plain(root)).split()) if root.text_len > 2 * root.linked else ""
    while best.parent is not None and best.parent.tag in ("article", "main") and best.tag not in ("article", "main"):
        best = best.parent
    kept = [best]
    if best.parent is not None and best.tag not in ("main", "html"):
        kids = [k for k in best.parent.kids if isinstance(k, _Node)]
        parts = [k for k, node in enumerate(kids) if node is best or _belongs(node, best, most)]
        # what stands between two parts of an article is one too, unless it is links
        kept = [node for k, node in enumerate(kids) if k in parts or parts[0] < k < parts[-1] and node.text_len > 2 * node.linked]
    return " ".join("".join(t for k in kept for t in _plain(k)).split())


def _belongs(node: _Node, best: _Node, most: float) -> bool:
    """Whether a sibling of the best container is part of the article.

    Beside a container that isn't the page itself, all that isn't links is:
    short sections, lists, tables and captions too.
    """
    if not node.text_len:
        return False
    links = node.linked / node.text_len
    if node.tag in _CONTAINER and node.score >= max(10.0, most / 5) and links < 0.3:
        return True
    inside = best.parent.parent is not None and best.tag not in ("article", "main")
    if node.tag in _HEADINGS:
        return links < 0.5 and (inside or node.tag in ("h1", "h2") and best.tag not in ("article", "main"))
    return (inside or node.tag in ("p", "pre", "blockquote")) and node.tag in _PART and links < 0.25


def main_texts(html: Column) -> Column:
    """The main text of each page of a column of html.

    Null html is as empty, and an empty page's text is empty; the result is
    never null. A page of any length is one row's work. Of containers with
    equally many points the first is the best; repeated rows have equal texts,
    and of an empty table there are none.
    """

    @F.pandas_udf("string")
    def run(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in pages:
            yield pd.Series([main_text(h) if h else "" for h in batch], dtype=object)

    return run(html)
