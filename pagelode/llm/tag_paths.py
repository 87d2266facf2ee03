"""Main-text extraction by tag-path ratios.

A page becomes a sequence of text blocks, each with its root-to-leaf path of tags. For every path the text length, the
length inside links, the punctuation and the number of blocks are summed. A path's own ratio is its plain text per
block, weighted by how punctuated it is; the ratios are smoothed along the page with a short window, fused with the
path's own and lowered twentyfold for each *doubt*, and paths at or over a share of the page's mean are content. The
content node is the lowest element that holds nearly all content text (or the article or main element around it), with
every element of the same path that holds content too; its blocks are the text.

A doubt is what an element says of itself: navigation, footer, aside, form, a page's header, such a role, or a class or
id that names one. It is evidence and no verdict: ratios are compared with the page's mean, so a form or a layout class
around a whole page lowers all paths alike and changes nothing. Inside the content node, blocks that carry a doubt of
their own and are not content by their ratio stay out, and so do paths that are links alone, several times.

Parsing takes time in proportion to the page: a tag that no ``>`` ends is text, end tags look up what is open in their
scope, and paths are numbers.

Defined cases: null, empty or text-free html gives the empty text, and so does a page whose content lies in navigation,
a footer or an aside alone; broken markup is closed as browsers do in the common cases (paragraphs, list items, cells,
unclosed inline tags); repeated rows repeat; ties of depth cannot occur, as elements that hold over half of the content
are nested; long pages are read whole; an empty table gives an empty result; other input columns, also ``text`` and
``n_chars``, are not read.
"""

from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .common import map_rows

#: A tag with its attributes; quotes count after an equals sign only. The lenient form ends at the next ``>``.
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?>[^>=]+|=\s*(?:\"[^\"]*\"|'[^']*')?)*+)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>")
_ATTR = re.compile(r"([a-zA-Z][\w:-]*)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Elements whose inside is no markup, and elements that show no text of the page.
_RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
_SILENT = frozenset("svg button select option datalist object canvas audio video".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
#: Elements and roles that speak against their text, and those of them that never hold an article.
_DOUBTED = frozenset("nav footer aside form menu dialog".split())
_NEVER = frozenset("nav footer aside menu".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
#: Parts of class and id words that do the same, parts that name reader comments, and parts that turn a word into layout.
_NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr notice
    popup modal overlay newsletter subscribe signup subscription sidebar sidenav nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer
    social share sharing related recommended recommendations widget toolbar masthead skip login searchform searchbox paywall topbar""".split()
)
_COMMENTS = frozenset("comment comments commentlist disqus respond reply replies".split())
_LAYOUT = frozenset("has with no without is not content main layout template columns col grid page site theme".split())
_CONTENT = frozenset("article post entry story hentry content main".split())
_CLOSES_P = frozenset(
    "p div ul ol dl li dt dd table tr td th h1 h2 h3 h4 h5 h6 article section main header footer nav aside form pre blockquote figure fieldset hr address details".split()
)
_CLOSED_BY = {
    "p": _CLOSES_P, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "option": frozenset(["option", "optgroup"]),
}
_CLOSES = {tag: frozenset(k for k, by in _CLOSED_BY.items() if tag in by) for tag in {t for by in _CLOSED_BY.values() for t in by}}
_SCOPES = frozenset("html body article section main div table ul ol td th blockquote aside nav header footer form figure".split())
_PUNCTUATION = re.compile(r"[.,;:!?。，、；：！？…]")
#: A block of text is not a content node; what holds it is.
_TEXT_BLOCKS = _INLINE | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr pre blockquote figcaption caption".split())
#: Share of the mean smoothed ratio from which a path is content, and share of the content that the content node holds.
THRESHOLD, HOLDS = 0.3, 0.9
#: What one doubt leaves of a ratio; an element or role counts as two. Link share and blocks from which a path is a menu.
DOUBT, MENU_SHARE, MENU_BLOCKS = 0.05, 0.9, 3
_WINDOW = (0.25, 0.5, 0.25)


class _Node:
    """An element: its path number, nearest scope and block element, doubts, and its range in the order of creation."""

    __slots__ = ("tag", "parent", "path", "scope", "block", "doubt", "hard", "inside", "never", "silent", "link", "held", "at", "end", "depth", "weight")

    def __init__(self, tag: str, parent: _Node | None):
        self.tag, self.parent = tag, parent
        scope = tag in _SCOPES or parent is None
        self.scope = self if scope else parent.scope
        self.held: dict[str, int] | None = {} if scope else None
        self.block = parent.block if parent and tag in _INLINE else self
        self.doubt = parent.doubt if parent else 0
        self.hard = bool(parent and parent.hard)
        self.inside = tag in ("article", "main") or bool(parent and parent.inside)
        self.never = tag in _NEVER or bool(parent and parent.never)
        self.silent = tag in _SILENT or bool(parent and parent.silent)
        self.link = tag == "a" or bool(parent and parent.link)
        self.depth = parent.depth + 1 if parent else 0
        self.path, self.at, self.end = 0, -1, 0
        self.weight = 0.0


@dataclass
class Page:
    """Elements in order of creation, text blocks (element, text, characters in links), and the tags of each path."""

    nodes: list[_Node] = field(default_factory=list)
    blocks: list[tuple[_Node, str, int]] = field(default_factory=list)
    paths: list[tuple[int, str, int]] = field(default_factory=lambda: [(-1, "", 0)])

    def name(self, path: int) -> str:
        """A path written out, each doubt as a ``~``."""
        up, tag, doubt = self.paths[path]
        return self.name(up) + "/" + tag + "~" * (doubt - self.paths[up][2]) if path else ""


def _word_doubt(word: str) -> tuple[int, bool]:
    """What one class or id word says: doubts (negative: it names content), and whether it names reader comments."""
    parts = [p for p in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", word).lower()) if p]
    layout = bool(parts) and parts[0] in ("has", "with", "no", "without", "is", "not")
    if not layout and not _COMMENTS.isdisjoint(parts):
        return 1, True
    if not _LAYOUT.isdisjoint(parts):
        return (-1 if len(parts) == 1 and parts[0] in _CONTENT else 0), False
    if not _NAMES.isdisjoint(parts):
        return 1, False
    return (-1 if not _CONTENT.isdisjoint(parts) else 0), False


def _says(node: _Node, attrs: str) -> None:
    """Count the doubts of an element from its tag and attributes; hidden elements fall silent."""
    tag, doubt, named, hard = node.tag, 0, 0, False
    outside = node.parent is None or not node.parent.inside
    if tag in _DOUBTED or tag == "header" and outside:
        doubt, hard = 2, tag != "form"
    if attrs and tag not in ("html", "body"):
        content = False
        for m in _ATTR.finditer(attrs):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*+:\s*+none", value):
                node.silent = True
            elif name == "role" and value.lower() in _ROLES:
                doubt, hard = 2, True
            elif name in ("class", "id"):
                for word in value.split():
                    if outside and word.lower() in ("header", "site-header", "page-header"):
                        named = max(named, 1)
                        continue
                    said, comments = _word_doubt(word)
                    if comments:
                        named, hard = 2, True
                    elif said > 0:
                        named = max(named, 1)
                    content = content or said < 0
        if content and not hard and named < 2:
            named = 0
    if tag in ("article", "main") and not node.hard and not named and not doubt:
        node.doubt = 0
    node.doubt += max(doubt, named)
    node.hard = node.hard or hard


def parse(source: str) -> Page:
    page = Page()
    known: dict[tuple[int, str, int], int] = {}
    root = here = _Node("", None)
    parts: list[str] = []
    linked, at, end, last, tags = 0, 0, len(source), source.rfind(">"), _TAG
    raw: dict[str, re.Pattern] = {}

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            if text := " ".join("".join(parts).split()):
                page.blocks.append((here.block, text, min(linked, len(text))))
            parts, linked = [], 0

    def leave(to: _Node) -> None:
        """Close elements until ``to`` is the innermost open one."""
        nonlocal here
        while here is not to:
            scope = here.parent.scope
            scope.held[here.tag] -= 1
            here.end = len(page.nodes)
            here = here.parent

    def say(text: str) -> None:
        nonlocal linked
        if not here.silent:
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            if here.link:
                linked += len(text.strip())

    def find(tag: str, bounded: bool) -> _Node | None:
        """The innermost open element of that tag, looked for in this scope only if ``bounded``."""
        scope = here.scope
        while not scope.held.get(tag):
            if scope.tag == tag and not bounded:
                return scope
            if bounded or scope.parent is None:
                return None
            scope = scope.parent.scope
        node = here
        while node.tag != tag:
            node = node.parent
        return node

    opened: dict[str, int] = {}
    while at < end:
        if source[at] != "<":
            nxt = source.find("<", at)
            nxt = end if nxt < 0 else nxt
            say(source[at:nxt])
            at = nxt
            continue
        if source.startswith("<!--", at):
            close = source.find("-->", at + 4)
            at = end if close < 0 else close + 3
            continue
        m = tags.match(source, at) if at < last else None
        if m is None and at < last and source[at + 1 : at + 2] in ("!", "?", "/") and not source[at + 2 : at + 3].isalpha():
            at = source.find(">", at) + 1
            continue
        if m is None and at < last and tags is _TAG and re.match("</?[a-zA-Z]", source[at : at + 3]):
            tags = _LOOSE  # a quote runs to the end of the page: from here on tags end at the next >
            m = tags.match(source, at)
        if m is None:
            if source.startswith(("<!", "<?"), at) and at < last:
                at = source.find(">", at) + 1
                continue
            say("<")
            at += 1
            continue
        at, tag = m.end(), m[2].lower()
        if m[1]:
            if opened.get(tag, 0):
                node = find(tag, tag in _INLINE)
                if node is not None:
                    if tag not in _INLINE:
                        flush()
                    for name in _closed(here, node):
                        opened[name] -= 1
                    leave(node.parent)
                    continue
            if tag in ("br", "p"):
                flush()
            continue
        if tag not in _INLINE and tag not in _RAW:
            flush()
            while (to := _implied(here, tag)) is not None:
                for name in _closed(here, to):
                    opened[name] -= 1
                leave(to.parent)
        if tag in _VOID:
            continue
        if tag in _RAW:
            if tag not in raw:
                raw[tag] = re.compile(rf"</{tag}\s*+>|\Z", re.I)
            at = raw[tag].search(source, at).end()
            continue
        node = _Node(tag, here)
        _says(node, m[3])
        key = (here.path, tag, node.doubt)
        if key not in known:
            known[key] = len(page.paths)
            page.paths.append(key)
        node.path = known[key]
        node.at = len(page.nodes)
        page.nodes.append(node)
        if node.silent and not here.silent:
            flush()
        here.scope.held[tag] = here.scope.held.get(tag, 0) + 1
        opened[tag] = opened.get(tag, 0) + 1
        here = node
    flush()
    leave(root)
    root.end = len(page.nodes)
    return page


def _closed(here: _Node, node: _Node) -> list[str]:
    """Tags from the innermost open element up to ``node``, which close together."""
    out = [here.tag]
    while here is not node:
        here = here.parent
        out.append(here.tag)
    return out


def _implied(here: _Node, tag: str) -> _Node | None:
    """The open element that a start tag of ``tag`` closes, within the nearest scope."""
    closes = _CLOSES.get(tag)
    if not closes:
        return None
    scope = here.scope
    if any(scope.held.get(c) for c in closes):
        node = here
        while node is not scope and node.tag not in closes:
            node = node.parent
        if node is not scope:
            return node
    return scope if scope.tag in closes and scope.parent is not None else None


def ratios(page: Page) -> dict[int, float]:
    """The fused ratio of each path that has text."""
    sums: dict[int, list[float]] = {}
    for node, text, linked in page.blocks:
        s = sums.setdefault(node.path, [0, 0, 0, 0])
        s[0] += len(text)
        s[1] += linked
        s[2] += len(_PUNCTUATION.findall(text))
        s[3] += 1
    own = {p: (t - MENU_SHARE * k) / n * (1 + math.log1p(c / n)) for p, (t, k, c, n) in sums.items()}
    line = [own[node.path] for node, _, _ in page.blocks]
    padded = [line[0], *line, line[-1]] if line else []
    smooth: dict[int, float] = dict.fromkeys(own, 0.0)
    for i, (node, _, _) in enumerate(page.blocks):
        smooth[node.path] += sum(w * x for w, x in zip(_WINDOW, padded[i : i + 3], strict=True))
    return {p: math.sqrt(own[p] * smooth[p] / sums[p][3]) * DOUBT ** page.paths[p][2] for p in own}


def content_paths(page: Page, threshold: float | None = None) -> set[int]:
    """Paths whose ratio reaches the threshold's share of the mean, in which doubted text counts by what its doubts leave."""
    fused = ratios(page)
    weight = [len(text) * DOUBT ** page.paths[node.path][2] for node, text, _ in page.blocks]
    mean = sum(fused[node.path] * w for (node, _, _), w in zip(page.blocks, weight, strict=True)) / (sum(weight) or 1)
    return {p for p, r in fused.items() if r >= (THRESHOLD if threshold is None else threshold) * mean}


def content_nodes(page: Page, content: set[int]) -> list[_Node]:
    """The elements whose blocks are the text, in page order; none where navigation, a footer or an aside holds the content."""
    if not page.nodes or all(node.never for node, _, _ in page.blocks if node.path in content):
        return []
    for node, text, linked in page.blocks:
        if node.path in content:
            node.weight += len(text) - linked + 1
    for node in reversed(page.nodes):
        node.parent.weight += node.weight
    root = page.nodes[0]
    while root.parent is not None:
        root = root.parent
    top = max((n for n in page.nodes if n.weight >= HOLDS * root.weight), key=lambda n: n.depth, default=root)
    while top.parent and top.tag in _TEXT_BLOCKS:
        top = top.parent
    if top.never:
        return []
    if top.inside:
        while top.tag not in ("article", "main"):
            top = top.parent
    return [n for n in page.nodes if n.path == top.path and n.weight > 0] if top.parent else [top]


def main_text(source: str | None, threshold: float | None = None) -> str:
    page = parse(source) if source else Page()
    if not page.blocks:
        return ""
    if not page.nodes:
        return " ".join(text for _, text, _ in page.blocks)
    content = content_paths(page, threshold)
    tops = content_nodes(page, content)
    links: dict[int, list[int]] = {}
    for node, text, linked in page.blocks:
        s = links.setdefault(node.path, [0, 0, 0])
        s[0] += len(text)
        s[1] += linked
        s[2] += 1
    menu = {p for p, (t, k, n) in links.items() if n >= MENU_BLOCKS and k >= MENU_SHARE * t}
    out: list[str] = []
    title, at = "", 0
    for node, text, _ in page.blocks:
        while at < len(tops) and tops[at].parent and node.at >= tops[at].end:
            at += 1
        top = tops[at] if at < len(tops) and (tops[at].parent is None or tops[at].at <= node.at) else None
        if top is None:
            # a headline right before the content node belongs to it
            if not node.doubt and node.path not in menu:
                title = text if node.tag == "h1" and not out else ""
            continue
        loose = top.tag in ("", "html", "body")
        if node.path in content or node.path not in menu and node.doubt == top.doubt and (not loose or node.tag in _TEXT_BLOCKS or node is top):
            out += [title, text] if title and not out else [text]
    return " ".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""

    def run(cols):
        text = [main_text(h) for h in cols["html"].to_pylist()]
        return [cols["page_id"], cols["url"], text, [len(t) for t in text]]

    return map_rows(pages.select("page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long", step=256)


def op5_main_text(pages: DataFrame) -> DataFrame:
    return extract(pages)
