"""Main text of web pages by scoring the tree of elements.

Paragraphs pass points for their length and their commas to the elements around them, the
full number to the parent, half of it to the grandparent and less further up. An element's
points are discounted by the share of its text that lies in links. The best container is
kept, with those siblings that look like parts of the same article.

Names of menus, adverts, comments and the like drop an element outside of articles. Inside one,
and for blocks of text, a name that may as well be a title lowers the points, and drops the
element only if its links or its length say the same. Headings are not judged by name.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from quillmesh.llm.common import chunks

# Element names of HTML by what they do.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "dir",
    "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "search",
    "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
CLOSE_P = BLOCKS - {"br", "body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "option"}
# An element that begins ends an open one of these, up to the given borders.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
    "body": ({"head"}, set()),
}
BORDERS = {"article", "aside", "body", "div", "main", "nav", "section", "table", "td", "th", "footer", "form", "li"}
# What is never part of an article.
DROPPED = {
    "head", "script", "style", "noscript", "template", "iframe", "object", "embed", "svg", "math", "canvas", "audio",
    "video", "nav", "menu", "footer", "aside", "form", "button", "select", "textarea", "input", "label", "fieldset",
    "dialog", "search", "datalist", "noembed", "noframes", "title",
}
UNLIKELY = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adv|adsense|adbox|banner|breadcrumbs?|combx|comments?|commentlist|consent|cookies?"
    r"|copyright|disclaimer|disqus|disclosure|dropdown|foot(?:er)?|gdpr|legal|log-?in|masthead|menu|modal|nav(?:bar|igation)?"
    r"|newsletter|notices?|notification|outbrain|overlay|pager|pagination|popup|popover|promo\w*|related|remark"
    r"|replies|reply|respond|rss|search|share|sharing|shoutbox|side(?:bar)?|skip|social|sponsor\w*|subscribe\w*"
    r"|taboola|tags?|toolbar|widgets?|alert|user-?content-?comments|discussion|feedback)(?:$|[\s_-])"
    r"|sidebar|cookie|comment|advert|newsletter",
    re.I,
)
# Names that leave no doubt: a whole class or id, with words that only say what kind of box.
CERTAIN = re.compile(
    r"(?:^|\s)(?:(?:article|block|entry|js|page|post|reader|site|the|user|wp)[-_])*(?:ads?|advert\w*|adsense|adbox|combx"
    r"|comments?|commentlist|consent|cookies?|disqus|gdpr|newsletter|outbrain|pagination|popover|popup|promo\w*"
    r"|share|sharing|shoutbox|side-?bar|sponsor\w*|subscribe\w*|taboola|toolbar|user-?content-?comments)"
    r"(?:[-_](?:area|banner|bar|block|box|buttons?|container|form|links?|list|notice|section|thread|unit|wrapper|\d+))*(?:$|\s)",
    re.I,
)
HEADINGS = {"h2", "h3", "h4", "h5", "h6"}
TEXT_BLOCKS = {"p", "span", "blockquote", "pre", "li", "dd", "dt", "td", "th", "figcaption", "caption"}
# A text under a doubtful name is dropped if so much of it lies in links, or if its class has
# the name and it is shorter.
LINKED_SHARE = 0.33
SHORT = 80
ROLES = {
    "navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu",
    "menubar", "form", "toolbar",
}
LIKELY = re.compile(r"article|body|content|entry|hentry|main|page|post|text|story|blog", re.I)
CONTAINERS = {"article", "body", "div", "main", "section", "td", "blockquote", "center", "figure", "dd", "li"}

TOKEN = re.compile(
    r"""<!--(?:>|->|.*?--!?>|.*\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
UNFINISHED = re.compile(r"</?[a-zA-Z]|<[!?]")
SPACE = re.compile(r"\s+")


class Element:
    __slots__ = ("name", "parent", "children", "hint", "dropped", "doubt", "points", "size", "linked", "links")

    def __init__(self, name: str, parent: Element | None, hint: str = "", dropped: bool = False) -> None:
        self.name, self.parent, self.hint, self.dropped = name, parent, hint, dropped
        self.children: list[Element | str] = []
        # 1: its id has a doubtful name, 2: its class.
        self.doubt = 0
        self.points = 0.0
        self.size = self.linked = self.links = 0


def _attributes(text: str) -> dict[str, str]:
    found = {}
    for name, a, b, c in ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), a or b or c)
    return found


def _unwanted(name: str, values: dict[str, str], stack: list[Element]) -> bool:
    """Whether an element is dropped without a look at what it holds."""
    if name in DROPPED:
        return True
    if name == "header":  # the head of the page, not that of an article
        return not any(e.name in ("article", "main") for e in stack)
    if name in ("html", "body", "article", "main", "p", "h1", "a", "b", "i", "em", "strong", "span", "br"):
        hidden = "hidden" in values and name not in ("html", "body", "article", "main")
        return hidden or name in ("p", "span") and _by_name(name, values, stack)
    if "hidden" in values or values.get("aria-hidden") == "true" or values.get("role", "").lower() in ROLES:
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", values.get("style", ""), re.I):
        return True
    return _by_name(name, values, stack)


def _by_name(name: str, values: dict[str, str], stack: list[Element]) -> bool:
    """Whether class or id alone drop an element; else `_doubt` and what it holds decide."""
    if name in HEADINGS or not _doubt(name, values):
        return False
    if CERTAIN.search(values.get("class", "")):
        return True
    if name in TEXT_BLOCKS:
        return False
    return bool(CERTAIN.search(values.get("id", ""))) or not any(e.name in ("article", "main") for e in stack)


def _doubt(name: str, values: dict[str, str]) -> int:
    if name in ("html", "body", "article", "main", "h1", "a", "b", "i", "em", "strong", "br") or name in HEADINGS:
        return 0
    return 2 if UNLIKELY.search(values.get("class", "")) else int(bool(UNLIKELY.search(values.get("id", ""))))


def _rejected(e: Element) -> bool:
    """Whether links or length confirm what a doubtful name says."""
    return bool(e.doubt and e.size) and (_density(e) >= LINKED_SHARE or (e.doubt == 2 and e.size < SHORT))


def parse(page: str) -> Element:
    """The tree of a page, however broken; texts are decoded."""
    root = Element("#root", None)
    stack = [root]
    opened: Counter[str] = Counter()
    at, end = 0, len(page)

    def text(value: str) -> None:
        if value:
            stack[-1].children.append(html.unescape(value) if "&" in value else value)

    def close(names: set[str], borders: set[str]) -> None:
        if not any(opened[n] for n in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in names:
                opened.subtract(e.name for e in stack[i:])
                del stack[i:]
                return
            if stack[i].name in borders:
                return

    while at < end:
        found = TOKEN.search(page, at)
        if found is None:  # a tag that the page ends in is no text
            text(UNFINISHED.split(page[at:], maxsplit=1)[0])
            break
        text(page[at : found.start()])
        at = found.end()
        shut, name, rest = found.group(1, 2, 3) if found.group(2) else found.group(4, 5, 6)
        if not name:
            if found.group().startswith("<![CDATA["):
                text(found.group()[9:-3])
            continue
        name = name.lower()
        if shut:
            if name == "br":
                stack[-1].children.append(Element("br", stack[-1]))
            elif name == "p":
                close({"p"}, BORDERS - {"li"})
            else:
                close({name}, {"article", "main", "td", "th"} if name not in BORDERS | {"html", "tr", "tbody"} else set())
            continue
        if name in CLOSE_P:
            close({"p"}, BORDERS)
        if name in ENDS:
            close(*ENDS[name])
        values = _attributes(rest) if rest.strip(" /\n\t") else {}
        # Below something unwanted nothing counts, so that need not be found again.
        element = Element(
            name, stack[-1], f"{values.get('class', '')} {values.get('id', '')} {values.get('itemprop', '')}".strip(),
            stack[-1].dropped or _unwanted(name, values, stack),
        )
        element.doubt = 0 if element.dropped else _doubt(name, values)
        stack[-1].children.append(element)
        if name in VOID:
            continue
        if name in RAW:
            # Its content is no markup; without an end it is what is left.
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        if not rest.rstrip().endswith("/") or name not in ("svg", "math"):
            stack.append(element)
            opened[name] += 1
    return root


def _order(root: Element) -> list[Element]:
    """Elements, parents first."""
    found, at = [root], 0
    while at < len(found):
        found += [c for c in found[at].children if isinstance(c, Element)]
        at += 1
    return found


def _length(text: str) -> int:
    return len(SPACE.sub(" ", text).strip())


def _measure(elements: list[Element]) -> None:
    for e in reversed(elements):
        if e.dropped:
            continue
        for c in e.children:
            if isinstance(c, str):
                e.size += _length(c)
            else:
                e.size += c.size
                e.linked += c.linked
                e.links += c.links
        if e.name == "a":
            e.linked, e.links = e.size, 1


def _density(e: Element) -> float:
    return e.linked / e.size if e.size else 0.0


def _paragraph(e: Element) -> str | None:
    """The text of an element that is a paragraph: a <p> or the like, or one with own text."""
    if e.name in ("p", "pre", "blockquote", "h2", "h3", "h4"):
        return _text([e])
    own = "".join(c if isinstance(c, str) else " " for c in e.children)
    if e.name in CONTAINERS and _length(own) > 0:
        inline = [c for c in e.children if isinstance(c, str) or (c.name not in BLOCKS and not c.dropped)]
        return _text(inline)
    return None


def _score(elements: list[Element]) -> None:
    for e in elements:
        if e.dropped:
            continue
        if e.name == "article":
            e.points += 25
        elif e.name == "main":
            e.points += 20
        elif e.name in ("div", "section"):
            e.points += 5 * bool(LIKELY.search(e.hint)) - 5 * bool(e.doubt)
        paragraph = _paragraph(e)
        if not paragraph:
            continue
        points = (1 + paragraph.count(",") + min(len(paragraph) / 100, 3)) * min(1.0, len(paragraph) / 25)
        points *= 1 - _density(e)
        up = e if e.name in CONTAINERS else e.parent
        for share in (1, 2, 6, 9):
            if up is None or up.name == "#root":
                break
            up.points += points / share
            up = up.parent


def _kept(best: Element, elements: list[Element]) -> list[Element]:
    """The best container and the siblings that belong to it, in page order."""
    if best.parent is None or best.name == "body":
        return [best]
    least = max(10.0, 0.2 * best.points * (1 - _density(best)))
    kept = []
    for c in best.parent.children:
        if not isinstance(c, Element) or c.dropped:
            continue
        if c is best:
            kept.append(c)
        elif c.name in ("article", "section", "div", "main") and c.name == best.name and c.points * (1 - _density(c)) >= least:
            kept.append(c)
        elif c.name in ("p", "blockquote", "pre") and _density(c) < 0.25 and (c.size > 80 or (c.size and not c.links)):
            kept.append(c)
        elif c.name in ("h1", "h2") and c.size and not c.links:
            kept.append(c)
    return kept


def _text(nodes: list[Element | str]) -> str:
    """The text of nodes in page order: blocks end words, other elements do not."""
    pieces, todo = [], [*reversed(nodes)]
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            pieces.append(node)
        elif not node.dropped:
            if node.name in BLOCKS:
                pieces.append(" ")
                todo.append(" ")
            todo += reversed(node.children)
    return " ".join("".join(pieces).split())


def main_text(page: str | None) -> str:
    """The main text of a page; empty for NULL, an empty page or one without text."""
    if not page:
        return ""
    elements = _order(parse(page))
    for e in elements:  # what is in an unwanted element is unwanted
        if e.parent is not None and e.parent.dropped:
            e.dropped = True
    _measure(elements)
    for e in elements:
        # Lists and boxes that are nothing but links are menus.
        if e.name in ("ul", "ol", "div", "section", "table") and e.links >= 3 and _density(e) >= 0.8:
            e.dropped = True
        elif _rejected(e) or (e.parent is not None and e.parent.dropped):
            e.dropped = True
    _score(elements)
    scored = [e for e in elements if not e.dropped and e.name in CONTAINERS and e.size and e.points > 0]
    if not scored:
        return _text([elements[0]])
    best = max(scored, key=lambda e: e.points * (1 - _density(e)))
    # An article that holds the best container is the container.
    up = best
    while up is not None:
        if up.name == "article" or (up.name == "main" and best.name != "article"):
            best = up
        up = up.parent
    return _text(_kept(best, elements))


def extract_text(df: DataFrame, page: str = "html", name: str = "text") -> DataFrame:
    """All columns and the main text of the page in `name`.

    Character references are decoded; white space inside a block becomes one space; blocks
    are joined in page order by one space. A NULL or empty page gives an empty text, as does
    a page without text outside of unwanted elements; unclosed elements are closed as
    browsers do; a page of any length is read whole. A column of the same name is replaced.
    """
    rest = [c for c in df.columns if c != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, page):
            texts = [main_text(x) for x in part.column(page).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c) for c in rest], pa.array(texts, pa.string())], names=[*rest, name]
            )

    kept = df.select(*[f"`{c}`" for c in rest])
    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField(name, StringType())]))
