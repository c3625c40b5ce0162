"""HTML extraction by wrappers: union-free regular expressions inferred for each host."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .html_tree import BLOCK, RAW, VOID, Element, parse
from .scratch import Scratch

#: Groups in which the partial wrappers of one host are merged before the last merge.
PARTS = 64
#: Constant texts that are kept as they are; longer ones are kept and compared as digests.
CONSTANT = 80
#: Pages that must share a constant text before it counts as a part of the template.
TEMPLATE_PAGES = 3
#: Levels of a page that are aligned as sequences; elements below them are compared by their whole paths.
LEVELS = 48
#: Groups inside of groups of one sequence; deeper ones fold by label alone, which gives the same nodes in another order.
NESTED = 6
#: Share of the text of a block with a repeated group that is in links, above which it is a list of links.
LINK_SHARE = 0.8
#: Extractors that a worker keeps.
EXTRACTORS = 32
#: Share of the pages of a host that have a mark before elements are aligned by it.
COMMON_SHARE = 0.5

# Fixed names of what is no article text, as element names and as words of class, id or role.
OUTSIDE = frozenset("nav footer aside form script style noscript template iframe svg math button select textarea input menu dialog head title object canvas audio video search".split())
OUTSIDE_MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu "
    "breadcrumb breadcrumbs header masthead footer sidebar side-bar widget widgets cookie cookies consent gdpr notice notices "
    "popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations "
    "comment comments commentlist reply replies respond disqus pagination pager toolbar "
    "@navigation @banner @contentinfo @complementary @search @form @alert @dialog @menu @menubar".split()
)
# Compound names that mean such a block; other compounds of the words above exclude only where the wrapper agrees.
OUTSIDE_NAMES = frozenset(
    "ad-box ad-slot ad-unit ad-container ad-wrapper ad-banner ad-block banner-ad side-bar sidebar-left sidebar-right left-sidebar "
    "right-sidebar primary-sidebar secondary-sidebar widget-area site-header page-header main-header global-header site-footer "
    "page-footer main-footer global-footer footer-widgets site-nav main-nav top-nav main-menu nav-menu nav-bar nav-links "
    "site-navigation main-navigation post-navigation posts-navigation cookie-notice cookie-banner cookie-bar cookie-consent "
    "cookie-popup consent-banner gdpr-notice gdpr-banner newsletter-signup newsletter-form newsletter-box subscribe-form "
    "subscribe-box signup-form social-share social-sharing social-links social-icons social-media share-buttons share-links "
    "share-bar share-box sharing-buttons related-posts related-articles related-links related-stories related-content "
    "recommended-posts recommended-articles comment-list comment-form comments-area comments-list comments-section "
    "comment-section comment-respond comment-reply reply-form modal-dialog modal-overlay popup-overlay".split()
)
NOISE = OUTSIDE_MARKS | OUTSIDE_NAMES
MAIN_MARKS = frozenset("@main @article main-content article-body article-content post-content entry-content post entry article content main".split())
#: Names that align as themselves; all other ones are one kind, so that a wrapper has few kinds of children.
KNOWN = BLOCK | RAW | VOID | OUTSIDE | frozenset("#root a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark picture q rp rt ruby s samp small span strike strong sub sup time tt u var video".split())
_PART = re.compile(r"[-_]+")


class Node:
    """One element of a wrapper.

    ``items`` is the sequence of its children in page order: [node, optional,
    repeated]. ``pages`` counts pages, ``chars`` the text below less what is no article text. ``text`` is the
    text slot: None without text, the sorted constants (a set while its page is read;
    see ``constant``), or True where pages differ. ``links`` counts the text in links. ``seen``
    are the smallest digests of pages that have own text here, TEMPLATE_PAGES at most.
    ``deep`` has (text, seen) of the elements below LEVELS by their path.
    """

    __slots__ = ("label", "items", "pages", "chars", "links", "text", "seen", "deep")

    def __init__(self, label: str, items=None, pages: int = 1, chars: int = 0, links: int = 0, text=None, seen=(), deep=None):
        self.label, self.items, self.pages, self.chars, self.links, self.text = label, items or [], pages, chars, links, text
        self.seen, self.deep = seen, deep or {}

    def packed(self) -> list:
        items = [[n.packed(), o, r] for n, o, r in self.items]
        return [self.label, items, self.pages, self.chars, self.links, self.text, list(self.seen), self.deep]

    @staticmethod
    def unpacked(data: list) -> Node:
        label, items, *rest = data
        return Node(label, [[Node.unpacked(n), o, r] for n, o, r in items], *rest)


def _same_text(one, other, within_page: bool):
    """Texts of equal elements: those of one page add up, those of two pages must be the same ones."""
    if one is None or other is None:
        return other if one is None else one
    if one is True or other is True:
        return True
    if not within_page:
        return one if one == other else True
    if isinstance(one, list):
        return sorted({*one, *other})
    few, many = sorted((one, other), key=len)
    many |= few
    return many


def _same_pages(one, other, seen: tuple, others: tuple, within_page: bool) -> tuple:
    """Digests of the pages that have one of two texts."""
    if within_page:
        return others if one is None else seen
    return sorted({*seen, *others})[:TEMPLATE_PAGES]


def align(one: list, other: list, within_page: bool = False) -> list:
    """Merged sequence of two child sequences.

    Equal labels are matched in order (longest common subsequence); a child that
    only one sequence has is a tag mismatch and becomes optional.
    """
    n, m = len(one), len(other)
    longest = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            same = one[i][0].label == other[j][0].label
            longest[i][j] = longest[i + 1][j + 1] + 1 if same else max(longest[i + 1][j], longest[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and one[i][0].label == other[j][0].label:
            (a, p, q), (b, r, s) = one[i], other[j]
            out.append([merge(a, b, within_page), p or r, q or s])
            i, j = i + 1, j + 1
        elif j == m or (i < n and longest[i + 1][j] >= longest[i][j + 1]):
            out.append([one[i][0], True, one[i][2]])
            i += 1
        else:
            out.append([other[j][0], True, other[j][2]])
            j += 1
    return out


def fold(items: list, nested: int = 0, within_page: bool = True) -> list:
    """The sequence with every repeated label folded into one repeated group.

    At the first label that comes again, the stretches that begin with it are
    squares of one group: they are aligned with each other into (a b? c?)+. What
    is left has each label once, so a wrapper stays as small as the kinds of
    children there are. Of a sequence that two pages were aligned to, labels come
    again where the pages order them differently, once from each of them: they are
    then merged as those of two pages.
    """
    at = {}
    for i, item in enumerate(items):
        at.setdefault(item[0].label, []).append(i)
    first = next((i for i, item in enumerate(items) if len(at[item[0].label]) > 1), None)
    if first is None:
        return items
    if nested == NESTED:
        return [_folded([items[i] for i in places], within_page) for places in at.values()]
    starts = at[items[first][0].label]
    group = fold(items[starts[0] : starts[1]], nested + 1, within_page)
    for a, b in zip(starts[1:], [*starts[2:], len(items)]):
        group = fold(align(group, fold(items[a:b], nested + 1, within_page), within_page), nested + 1, within_page)
    return items[:first] + [[n, o, True] for n, o, _ in group]  # no label of the group comes before it


def _folded(same: list, within_page: bool) -> list:
    """Items of one label as one."""
    total = same[0][0]
    for node, _, _ in same[1:]:
        total = merge(total, node, within_page)
    return [total, True, len(same) > 1 or same[0][2]]


def merge(one: Node, other: Node, within_page: bool = False) -> Node:
    """Wrapper of two: texts that differ become a slot, children are aligned and folded."""
    items = fold(align(one.items, other.items, within_page), 0, within_page)
    pages = max(one.pages, other.pages) if within_page else one.pages + other.pages
    text = _same_text(one.text, other.text, within_page)
    seen = _same_pages(one.text, other.text, one.seen, other.seen, within_page)
    deep = one.deep | other.deep
    for path in one.deep.keys() & other.deep.keys():
        (a, p), (b, q) = one.deep[path], other.deep[path]
        deep[path] = [_same_text(a, b, within_page), _same_pages(a, b, p, q, within_page)]
    return Node(one.label, items, pages, one.chars + other.chars, one.links + other.links, text, seen, deep)


def kind_of(element: Element, marks: frozenset | None) -> str:
    """Label by which an element is aligned: its name and those marks that are common on the host or have a meaning."""
    return element.label if marks is None else _kind(element.name, element.marks, marks)


@lru_cache(maxsize=65536)
def _kind(name: str, own: tuple[str, ...], marks: frozenset) -> str:
    return " ".join([name if name in KNOWN else "x", *(m for m in own if m in marks or m in MAIN_MARKS or m in NOISE)])


def digest(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=6).digest(), "big")


def constant(text: str) -> str:
    """A text as it is compared: itself, or a digest that begins with a space, as no own text does."""
    if len(text) <= CONSTANT:
        return text
    return " " + blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def step(path: tuple[str, ...], label: str) -> tuple[str, ...]:
    """Path of a child. Below LEVELS it is LEVELS labels, the digest of the further ones and the label itself."""
    if len(path) < LEVELS:
        return (*path, label)
    above = path[LEVELS] if len(path) > LEVELS else ""
    return (*path[:LEVELS], blake2b(f"{above} {label}".encode("utf-8", "surrogatepass"), digest_size=12).hexdigest(), label)


def page_node(element: Element, marks: frozenset | None = None) -> Node:
    """Wrapper of one page, its repetitions folded; without ``marks`` all marks count.

    The page's digest is that of its text outside of menus and the like, so that
    copies of a page count once.
    """
    # Every element after its parent: name, parent's place, level, label, whether it is no article text, own text.
    found: list[tuple[str, int, int, str, bool, str]] = []
    words: list[str] = []
    # Texts below LEVELS: the place of the element at that level, then the digest of the path from there.
    deep: dict[int, dict[str, set[str]]] = {}
    # ``anchor`` is the place of the ancestor at LEVELS, ``below`` the path from there as ``step`` writes it.
    stack: list = [(element, 0, 0, kind_of(element, marks), False, False, 0, "")]
    top = ("",) * LEVELS
    while stack:
        element, parent, level, kind, outside, within, anchor, below = stack.pop()
        place = len(found)
        texts = [c for c in element.children if isinstance(c, str)]
        own = " ".join(" ".join(texts).split()) if texts else ""
        if own and not within:
            words.append(own)
        if own and level > LEVELS:
            deep.setdefault(anchor, {}).setdefault(below, set()).add(constant(own))
        if level == LEVELS:
            anchor = place
        if len(texts) < len(element.children):
            for child in reversed(element.children):
                if not isinstance(child, str):
                    label = kind_of(child, marks)
                    out = is_outside(label, True)
                    further = step((*top, below) if below else top, label)[LEVELS] if level >= LEVELS else ""
                    stack.append((child, place, level + 1, label, out, within or out, anchor, further))
        found.append((element.name, parent, level, kind, outside, own))
    seen = [digest(" ".join(words))]
    items: list[list] = [[] for _ in found]
    sizes = [[0, 0] for _ in found]  # characters below and those of them in links
    nodes = []
    for place in range(len(found) - 1, -1, -1):
        name, parent, level, kind, outside, own = found[place]
        chars, links = sizes[place]
        chars += len(own)
        links = chars if name == "a" else links
        if place and not outside:
            sizes[parent][0] += chars
            sizes[parent][1] += links
        if level <= LEVELS:
            texts = {path: [t, seen] for path, t in deep.get(place, {}).items()}
            text = {constant(own)} if own else None
            node = Node(kind, fold(items[place][::-1]), 1, chars, links, text, seen if text else (), texts)
            items[place] = []
            if not place:
                nodes.append(node)
                break
            items[parent].append([node, False, False])
    for node in nodes:  # which grows to all nodes of the folded page
        nodes += [n for n, _, _ in node.items]
        node.text = sorted(node.text) if node.text else None
        node.deep = {path: [sorted(t), pages] for path, (t, pages) in node.deep.items()}
    return nodes[0]


@dataclass(frozen=True)
class Traits:
    """What the name and marks of a label say."""

    name: str
    main: bool
    marked: bool
    noise: frozenset
    compound: bool


@lru_cache(maxsize=65536)
def traits(label: str) -> Traits:
    name, *marks = label.split()
    marked = any(m in MAIN_MARKS for m in marks)
    main = name in ("article", "main") or (marked and name not in ("html", "body"))
    whole = name in ("html", "body", "main")
    noise = frozenset() if whole else frozenset(marks) & NOISE
    parts = [_PART.split(m) for m in marks if m not in MAIN_MARKS]
    compound = not whole and name != "article" and any(len(p) > 1 and not OUTSIDE_MARKS.isdisjoint(p) for p in parts)
    return Traits(name, main, marked, noise, compound)


def is_outside(label: str, in_article: bool, agreed: bool = False) -> bool:
    """Whether an element is no article text: by its name, a whole word, or a part of a word where the wrapper agreed.

    Words never exclude html, body or main, and an article only inside of another one.
    """
    t = traits(label)
    if t.name in OUTSIDE or (t.name == "header" and not in_article):
        return True
    if t.name == "article":
        return in_article and bool(t.noise) and not t.marked
    return bool(t.noise - {"header"} if in_article else t.noise) or (agreed and t.compound)


def agreed_blocks(wrapper: Node) -> set[tuple[str, ...]]:
    """Paths of elements with a noise word in a compound name whose text is the same, or mostly links, on the host's pages.

    An element that holds a marked one is never among them.
    """
    found: set[tuple[str, ...]] = set()

    def walk(node: Node, path: tuple[str, ...]) -> tuple[bool, bool, bool]:
        """Whether all text is the template's, is on enough pages, and whether there are marked elements below."""
        same, often, main = is_fixed(node), is_often(node), False
        for child, _, _ in node.items:
            below = walk(child, (*path, child.label))
            same, often, main = same and below[0], often or below[1], main or below[2] or traits(child.label).main
        if traits(node.label).compound and not main and often and (same or 2 * node.links >= node.chars):
            found.add(path)
        return same, often, main

    walk(wrapper, ())
    return found


def frames(wrapper: Node) -> set[tuple[str, ...]]:
    """Paths of marked elements that hold other marked ones and besides these only the template's text and noise."""
    found: set[tuple[str, ...]] = set()
    agreed = agreed_blocks(wrapper)

    def walk(node: Node, path: tuple[str, ...], inside: bool) -> tuple[bool, bool]:
        """Whether there is text of single pages outside of marked elements, and whether there are such elements."""
        own, main = not is_fixed(node), False
        for child, _, _ in node.items:
            here = (*path, child.label)
            if is_outside(child.label, inside, here in agreed):
                continue
            marked = traits(child.label).main
            below = walk(child, here, inside or marked)
            own, main = own or (below[0] and not marked), main or marked or below[1]
        if main and not own and traits(node.label).main:
            found.add(path)
        return own, main

    walk(wrapper, (), False)
    return found


def is_template(text: list | bool | None, seen: list) -> bool:
    """Whether the own text of an element, if it has any, is the same on enough pages that differ in other text."""
    return text is None or (text is not True and len(seen) >= TEMPLATE_PAGES)


def is_fixed(node: Node) -> bool:
    """Whether this holds for the element and for all that is below LEVELS."""
    return is_template(node.text, node.seen) and all(is_template(*t) for t in node.deep.values())


def is_often(node: Node) -> bool:
    """Whether the element or one below LEVELS has text on enough pages."""
    return any(len(seen) >= TEMPLATE_PAGES for seen in (node.seen, *(s for _, s in node.deep.values())))


def template_texts(wrapper: Node) -> dict[tuple[str, ...], set[str]]:
    """By path the constants that the pages of a host repeat and that differ in other text."""
    found = {}

    def walk(node: Node, path: tuple[str, ...]) -> None:
        for here, (text, seen) in ((path, (node.text, node.seen)), *(((*path, p), t) for p, t in node.deep.items())):
            if text and is_template(text, seen):
                found[here] = set(text)
        for child, _, _ in node.items:
            walk(child, (*path, child.label))

    walk(wrapper, ())
    return found


def link_lists(wrapper: Node) -> set[tuple[str, ...]]:
    """Paths of blocks whose text on the host's pages is a repeated group of links, with little text beside these.

    Those are the innermost such blocks and the ones around them that add only
    text of the template. No element that holds a marked one is among them, nor is
    the body.
    """
    found: set[tuple[str, ...]] = set()

    def walk(node: Node, path: tuple[str, ...]) -> tuple[bool, bool, bool, bool, bool]:
        """Whether a repeated element holds links, text is on enough pages, there are marked elements, all text beside links is the template's, there is a list."""
        name = traits(node.label).name
        group, often, main, fixed, listed = False, is_often(node), False, name == "a" or is_fixed(node), False
        for child, _, repeated in node.items:
            below = walk(child, (*path, child.label))
            group = group or below[0] or (repeated and child.links > 0)
            often, main = often or below[1], main or below[2] or traits(child.label).main
            fixed, listed = fixed and (below[3] or name == "a"), listed or below[4]
        block = (name in BLOCK or name == "x") and name not in ("html", "body")
        if block and group and often and not main and node.links >= LINK_SHARE * node.chars and (fixed or not listed):
            found.add(path)
            listed = True
        return group, often, main, fixed, listed

    walk(wrapper, ())
    return found


def settled(node: Node) -> Node:
    """The last wrapper of a host, of whose constants only those of the template are kept."""
    lost = [p for p, t in node.deep.items() if not is_template(*t)]
    deep = {p: t for p, t in node.deep.items() if is_template(*t)} | ({"": [True, []]} if lost else {})
    text = node.text if is_template(node.text, node.seen) else True
    items = [[settled(n), o, r] for n, o, r in node.items]
    return Node(node.label, items, node.pages, node.chars, node.links, text, node.seen, deep)


class Extractor:
    """Article text of pages by the wrapper of their host.

    The regions of a page are its outermost marked elements outside menus and the
    like, but the inner ones of a frame that adds only text of the template. A page
    without text in one falls back to its body less the excluded parts, lists of
    links and the template's own texts (with the lists where nothing else is left),
    or to the marked elements inside an excluded block where these hold more.
    """

    def __init__(self, packed: str, marks: Iterable[str] | None = None):
        self.wrapper = Node.unpacked(json.loads(packed))
        self.marks = None if marks is None else frozenset(marks)
        self.template = template_texts(self.wrapper)
        self.agreed = agreed_blocks(self.wrapper)
        self.frames = frames(self.wrapper)
        self.lists = link_lists(self.wrapper)

    def text(self, page: str | None) -> str:
        root = parse(page)
        for within in (True, False):
            if found := self._joined(self._regions(root, within)):
                return found
        body = self._text(root, (), False, self.lists) or self._text(root, (), False)
        held = self._joined(self._regions(root, False, held=True))
        return held if len(held) > len(body) else body

    def _joined(self, regions: list) -> str:
        return " ".join(t for t in (self._text(*r, True) for r in regions) if t)

    def _regions(self, root: Element, within: bool, held: bool = False) -> list[tuple[Element, tuple[str, ...]]]:
        """Outermost marked elements, with ``within`` those inside of frames; with ``held`` also those inside blocks that only their marks exclude."""
        out, stack = [], [(root, ())]
        while stack:
            element, path = stack.pop()
            if path and traits(path[-1]).main and not (within and path in self.frames):
                out.append((element, path))
                continue
            for child in reversed(element.children):
                if not isinstance(child, str):
                    label = kind_of(child, self.marks)
                    here = step(path, label)
                    if not is_outside(label, False, here in self.agreed) or (held and (child.name == "form" or child.name not in OUTSIDE)):
                        stack.append((child, here))
        return out

    def _text(self, element: Element, path: tuple[str, ...], article: bool, without: Iterable[tuple[str, ...]] = ()) -> str:
        """Text below an element, less that at the paths ``without``; outside of articles without the texts of the template."""
        out: list[str] = []
        stack: list = [(element, path)]
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                out.append(item)
                continue
            element, path = item
            known = None if article else self.template.get(path[: LEVELS + 1])
            mine = not known or constant(" ".join(" ".join(c for c in element.children if isinstance(c, str)).split())) not in known
            todo: list = []
            for child in element.children:
                if isinstance(child, str):
                    todo.append(child if mine else " ")
                    continue
                here = step(path, kind_of(child, self.marks))
                inner = [] if here in without or is_outside(here[-1], article, here in self.agreed) else [(child, here)]
                todo += [" ", *inner, " "] if child.name in BLOCK else inner
            stack.extend(reversed(todo))
        return " ".join("".join(out).split())


def host_of(url: Column) -> Column:
    """Host of a URL; a null or odd URL gives the empty host."""
    return F.lower(F.coalesce(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def _merged(wrappers: Iterator[str], last: bool = False) -> str:
    total = None
    for packed in wrappers:
        node = Node.unpacked(json.loads(packed))
        total = node if total is None else merge(total, node)
    return json.dumps((settled(total) if last else total).packed(), ensure_ascii=False)


def common_marks(pages: DataFrame) -> DataFrame:
    """(host, marks) from all (host, html) rows: the marks that half of the pages of a host have."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            known: Counter = Counter()
            for host, page in zip(batch["host"], batch["html"]):
                found, stack = {""}, [parse(page)]
                while stack:
                    element = stack.pop()
                    found.update(element.marks)
                    stack += [c for c in element.children if not isinstance(c, str)]
                known.update((host, m) for m in found)
            yield pd.DataFrame([(h, m, n) for (h, m), n in known.items()], columns=["host", "mark", "n"])

    counts = pages.mapInPandas(counted, "host string, mark string, n long").groupBy("host", "mark").agg(F.sum("n").alias("n"))
    totals = counts.where("mark = ''").select("host", F.col("n").alias("pages"))
    shared = counts.join(totals, "host").where(F.col("n") >= COMMON_SHARE * F.col("pages"))
    return shared.groupBy("host").agg(F.array_sort(F.collect_list("mark")).alias("marks"))


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper) from all (host, marks, html) rows.

    Every task aligns its pages one after the other into one wrapper a host; these
    few small wrappers are merged in two rounds, so no task ever holds the pages
    of a host, nor all wrappers of one that is in every task.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, Node] = {}
        for batch in batches:
            for host, marks, page in zip(batch["host"], batch["marks"], batch["html"]):
                node = page_node(parse(page), frozenset(marks))
                known[host] = merge(known[host], node) if host in known else node
        rows = sorted((h, json.dumps(n.packed(), ensure_ascii=False)) for h, n in known.items())
        yield pd.DataFrame(rows, columns=["host", "wrapper"])

    def together(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        last = len(key) == 1
        return pd.DataFrame({"host": [key[0]], "wrapper": [_merged(sorted(rows["wrapper"]), last)]})

    found = pages.mapInPandas(partial, "host string, wrapper string")
    found = found.withColumn("part", F.pmod(F.xxhash64("wrapper"), F.lit(PARTS)))
    found = found.groupBy("host", "part").applyInPandas(together, "host string, wrapper string")
    return found.groupBy("host").applyInPandas(together, "host string, wrapper string")


def main_text(df: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every row of ``df``: the article text of its page.

    A host's wrapper is inferred from all its pages by element names and the marks
    that are common there. The article regions of each page are read without menus,
    headers, footers, sidebars, notices, adverts, forms, scripts, styles and
    comments; a page without such a region gives its body less these parts.
    Character references are decoded, white space is one space, blocks are joined
    in page order.

    A null or empty page gives an empty text; null URLs and those without a host
    share one wrapper; broken markup is read as far as it goes, at any depth; null and
    repeated keys and repeated rows are each extracted; very long pages are read whole;
    an empty table gives no rows; other columns play no part, whatever their names.
    """
    scratch = Scratch(df.sparkSession, "wrappers")
    rows = df.select(
        F.col(key).alias("id"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"), F.col(page).alias("html")
    )
    # One row a host on the side of the marks and wrappers, so Spark can split a host that has a third of all pages.
    marks = scratch.table(common_marks(rows.select("host", "html")), "marks")
    wrappers = infer_wrappers(rows.join(marks, "host").select("host", "marks", "html"))
    wrappers = scratch.table(wrappers.join(marks, "host"), "hosts")

    def extracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = lru_cache(maxsize=EXTRACTORS)(Extractor)  # the hosts of a partition may come in any order
        for batch in batches:
            rows = zip(batch["wrapper"], batch["marks"], batch["html"])
            texts = [known(packed, tuple(marks)).text(html) for packed, marks, html in rows]
            yield pd.DataFrame({"id": batch["id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    schema = T.StructType(
        [
            T.StructField(key, df.schema[key].dataType),
            T.StructField(url, T.StringType()),
            T.StructField("text", T.StringType()),
            T.StructField("n_chars", T.LongType()),
        ]
    )
    joined = rows.join(wrappers, "host").select("id", "url", "html", "marks", "wrapper")
    named = T.StructType([T.StructField(n, f.dataType) for n, f in zip(("id", "url", "text", "n_chars"), schema)])
    return joined.mapInPandas(extracted, named).toDF(*schema.names)
