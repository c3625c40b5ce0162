"""Tolerant reading of HTML into a small tree of labelled elements."""

from __future__ import annotations

import html
import re

#: Fixed lists of element names, by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option optgroup p pre search section "
    "select summary table tbody td tfoot th thead tr ul".split()
)
#: An opening element of the key closes open elements of the value, up to an element that holds such things.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"},
    "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
HOLDS = frozenset("ul ol menu dl table select article section div body html main aside nav footer header form".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.DOTALL
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_NUMBER = re.compile(r"\d+")


class Element:
    """Name, marks (words of class, id and role) and children, which are elements or texts."""

    __slots__ = ("name", "marks", "children")

    def __init__(self, name: str, marks: tuple[str, ...] = ()):
        self.name, self.marks, self.children = name, marks, []

    @property
    def label(self) -> str:
        """Name and marks without numbers, so that numbered siblings align."""
        return " ".join([self.name, *self.marks])


def _marks(attributes: str) -> tuple[str, ...]:
    found = set()
    for m in _ATTRIBUTE.finditer(attributes):
        prefix = "@" if m[1].lower() == "role" else ""
        for word in (m[2] or m[3] or m[4] or "").lower().split():
            found.add(prefix + _NUMBER.sub("", word).strip("-_"))
    return tuple(sorted(found - {"", "@"}))


def parse(page: str | None) -> Element:
    """Root of a page. Unclosed elements end with their parent or where the next block begins; stray ends are skipped."""
    root = Element("#root")
    stack = [root]
    page = page or ""
    at = 0
    while True:
        token = _TOKEN.search(page, at)
        text = page[at : token.start()] if token else page[at:]
        if text:
            stack[-1].children.append(html.unescape(text))
        if token is None:
            return root
        at = token.end()
        if token[2] is None:
            continue
        name = token[2].lower()
        if token[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    del stack[i:]
                    break
            continue
        _close_for(stack, name)
        element = Element(name, _marks(token[3]) if "=" in token[3] else ())
        stack[-1].children.append(element)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}[\s/>]", re.IGNORECASE).search(page, at)
            at = end.start() if end else len(page)
            stack.append(element)
        elif name not in VOID and not token[3].rstrip().endswith("/"):
            stack.append(element)


def _close_for(stack: list[Element], name: str) -> None:
    closed = CLOSES.get(name)
    if closed:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in closed:
                del stack[i:]
                return _close_for(stack, name)
            if stack[i].name in HOLDS:
                return None
    elif name in BLOCK and name != "br":
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name == "p":
                del stack[i:]
                return None
            if stack[i].name in HOLDS or stack[i].name in ("li", "td", "th", "button"):
                return None
    return None
