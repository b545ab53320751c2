"""Main text of web pages by tag-path ratios.

A unit is the text of one block element between tags; its path is that element's tags, with classes and ids, from the root. For each
path, text length and punctuation are added up and divided by its number of units. Both ratios are smoothed along the page and
fused by their product, less the share of links; units at or above the standard deviation are selected, and a path is content
if most of its text is.

The path with the most selected text is the dominant one. The main element is the article that holds most of the selected
text, or else what holds all units of the dominant path, and its parents as long as these bring in more readable text
than other. Of the main element all content paths are kept, wherever they are, and short blocks of text tags (headings, items, cells,
paragraphs) that aren't lists of links. A block without such a tag is kept if its path's own ratios come near to the dominant
one's: an advert between paragraphs does not. A last part without a heading or units of the dominant path is readers' comments; in an
article element only if it has several units of one make. In an article list items that are links stay if their list is
under a heading or has other items too, as lists of sources are; any other list of links is a menu.

Tags that are boilerplate by their meaning (nav, footer, aside) are left out; a form only if it does not hold most of the
selected text. A class or id of one telling word is no more than a prior that lowers the ratios of a small part of the page.

Every step takes time in proportion to the page: open tags are found by name, paths are numbers, and no character is scanned twice.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

_START = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"""[>"']""")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_BLANK = re.compile(r"[\x20\x09-\x0D]+")
_DIGITS = re.compile(r"[-_]?[0-9]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、؛؟]")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that never hold main text.
NEVER = frozenset("head script style noscript template iframe object svg math canvas nav footer aside button select option textarea dialog menu audio video noembed noframes xmp title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Blocks that are parts of a text, not the whole.
PARTS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol li dl dt dd table caption thead tbody tfoot tr td th figure figcaption details summary address center hgroup".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Whole classes and ids that are a prior for boilerplate.
MARKS = frozenset("ad ads advert advertisement sponsored promo banner cookie cookies notice newsletter sidebar related share social comment comments respond menu breadcrumb pagination".split())
#: Of these, what isn't main text however much it reads like it: readers' comments and adverts.
STRICT = frozenset("ad ads advert advertisement sponsored promo comment comments respond".split())
#: A start tag closes an open element of its row, unless one of the second set is between.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")), "option": (("option",), ("select",)), "body": (("head",), ()),
}
#: A marked part's ratios are multiplied by this. What holds more than half of the selected text is no boilerplate, but beside an article.
PRIOR = 0.2
MOST = 0.5
#: An article is the main element from this share of the selected text.
ARTICLE = 1 / 6
#: Of a block without a text tag, the least ratio of its path's own score to the dominant path's.
NEAR = 0.25


@dataclass
class Element:
    tag: str
    parent: int
    path: int
    block: int  # the nearest element, itself included, that is not inline
    bad: bool
    form: int  # the outermost form around it, 0 for none
    mark: int  # the outermost marked element around it, 0 for none
    linked: bool
    strict: bool = False  # of the marks around it, one is of a kind that is never main text


@dataclass
class Page:
    elements: list[Element] = field(default_factory=lambda: [Element("", -1, 0, 0, False, 0, 0, False)])
    #: Element, block number and decoded text of each text node.
    nodes: list[tuple[int, int, str]] = field(default_factory=list)


class _Open:
    """Open elements, each found by its tag in one step."""

    def __init__(self) -> None:
        self.stack, self.tags, self.places = [0], [""], {}

    def push(self, element: int, tag: str) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append(element)
        self.tags.append(tag)

    def last(self, tags: Iterable[str]) -> int:
        """The place of the innermost of these tags, 0 for none."""
        return max((own[-1] for t in tags if (own := self.places.get(t))), default=0)

    def close(self, tags: Iterable[str], until: Iterable[str] = ()) -> None:
        """Close the innermost of these tags and all within it, unless one of until is within it."""
        at = self.last(tags)
        if at and at > self.last(until):
            for tag in self.tags[at:]:
                self.places[tag].pop()
            del self.stack[at:], self.tags[at:]


def _attributes(text: str) -> tuple[bool, str, str]:
    """Whether attributes tell boilerplate, the telling class or id among them, and class and id for the path, the id without its digits."""
    if not text or text.isspace():
        return False, "", ""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text)}
    name, own = found.get("class", "").strip().lower(), found.get("id", "").strip().lower()
    marked = next((w for w in (*name.split(), own) if w in MARKS), "")
    return "hidden" in found or found.get("aria-hidden") == "true" or found.get("role", "").lower() in ROLES, marked, f"{name}#{_DIGITS.sub('', own)}"


def parse(source: str) -> Page:
    """Elements and text nodes of a page, however its tags are nested or left open. A tag that never ends is text."""
    page, still = Page(), _Open()
    elements, nodes = page.elements, page.nodes
    numbers: dict[tuple[int, str], int] = {}
    block, at, quotes, size = 0, 0, True, len(source)

    def text(piece: str) -> None:
        if piece:
            nodes.append((still.stack[-1], block, html.unescape(piece) if "&" in piece else piece))

    def tag_end(start: int) -> int:
        """The place of the > that ends the tag, -1 without one. Once quotes don't close any more, they are characters like others."""
        nonlocal quotes
        here = start
        while quotes:
            m = _STOP.search(source, here)
            if m and m[0] == ">":
                return m.start()
            close = source.find(m[0], m.end()) if m else -1
            if close < 0:
                quotes = False
            here = close + 1
        return source.find(">", start)

    while m := _START.search(source, at):
        text(source[at : m.start()])
        if m[0] == "<!--":
            close = source.find("-->", m.end())
            at = close + 3 if close >= 0 else size
            continue
        end = source.find(">", m.end()) if m[0] in ("<!", "<?") else tag_end(m.end())
        if end < 0:
            at = m.start() if m[0] not in ("<!", "<?") else size
            break
        at = end + 1
        if m[0] in ("<!", "<?"):
            continue
        closing = m[0][1] == "/"
        name = _NAME.match(source, m.start() + 1 + closing)
        tag = name[0].lower()
        inline = tag in INLINE
        block += not inline
        if closing:
            still.close((tag,), ("td", "th", "table") if (inline or tag == "p") and tag != "table" else ())
            continue
        if tag == "br":
            nodes.append((still.stack[-1], block, " "))
        if tag in VOID:
            continue
        if not inline:
            still.close(("p",), ("table", "td", "th", "button", "object"))
        if tag in CLOSES:
            still.close(*CLOSES[tag])
        rest = source[name.end() : end]
        bad, marked, word = _attributes(rest)
        parent = still.stack[-1]
        up, number = elements[parent], len(elements)
        if tag in NEVER or (tag == "header" and not still.last(("article", "main"))):
            bad = True
        path = up.path if inline else numbers.setdefault((up.path, f"{tag}.{word}"), len(numbers) + 1)
        # An article within an article is a comment on it.
        within = tag == "article" and still.last(("article",)) > 0
        strict = up.strict or within or marked in STRICT
        elements.append(Element(tag, parent, path, up.block if inline else number, bad or up.bad, up.form or (number if tag == "form" else 0), up.mark or (number if marked or within else 0), up.linked or tag == "a", strict))
        if tag in RAW:
            close = re.compile(f"</{re.escape(tag)}", re.I).search(source, at)
            stop = source.find(">", close.start()) if close else -1
            at = stop + 1 if stop >= 0 else size
        elif not rest.endswith("/"):
            still.push(number, tag)
    text(source[at:])
    return page


def _smooth(x: np.ndarray) -> np.ndarray:
    """A Gaussian of five units, with weights made to sum to one at the ends."""
    kernel = np.exp(-np.arange(-2, 3) ** 2 / 2.0)
    return np.convolve(x, kernel)[2:-2] / np.convolve(np.ones(len(x)), kernel)[2:-2]


def _held(elements: list[Element], at: Iterable[int], weights: Iterable[float]) -> list[float]:
    """What each element holds, itself and within, of weights at elements."""
    out = [0.0] * len(elements)
    for e, w in zip(at, weights, strict=True):
        out[e] += w
    for i in range(len(elements) - 1, 0, -1):
        out[elements[i].parent] += out[i]
    return out


def _inside(elements: list[Element], tops: set[int]) -> list[bool]:
    out = [False] * len(elements)
    for i, e in enumerate(elements):
        out[i] = i in tops or (e.parent >= 0 and out[e.parent])
    return out


def _main_elements(elements: list[Element], owner: list[int], chosen: list[float], readable: list[float], whole: list[float], dominant: int) -> set[int]:
    """The elements that hold the main text: chosen, readable and whole are the selected, readable and all text that each element holds."""
    total = chosen[0]
    best = 0
    for i, e in enumerate(elements):  # parents come first, so that of nested articles the innermost that holds most is the last
        if e.tag in ("article", "main") and not e.bad and chosen[i] > (MOST * chosen[best] if best else ARTICLE * total):
            best = i
    if best:
        return {i for i, e in enumerate(elements) if e.path == elements[best].path and e.tag == elements[best].tag}
    # The lowest element that holds all units of the dominant path.
    units = [e for e in owner if elements[e].path == dominant]
    count = _held(elements, units, [1.0] * len(units))
    main = max(i for i in range(len(elements)) if count[i] == len(units))
    while elements[main].tag in INLINE or elements[main].tag in PARTS:
        main = elements[main].parent  # a lone paragraph's siblings belong to it
    while elements[main].parent > 0 and elements[up := elements[main].parent].tag not in ("body", "html"):
        if readable[up] - readable[main] < MOST * (whole[up] - whole[main]):
            break
        main = up
    return {main}


def _repeats(elements: list[Element], held: list[float]) -> list[bool]:
    """Of each element, whether it has two children or more that are no parts of a text and of one path, each with text, or is one of such."""
    groups: dict[tuple[int, int], list[int]] = {}
    for i, e in enumerate(elements):
        if i and held[i] and e.tag not in INLINE and e.tag not in PARTS:
            groups.setdefault((e.parent, e.path), []).append(i)
    out = [False] * len(elements)
    for (parent, _), own in groups.items():
        if len(own) > 1:
            for i in (parent, *own):
                out[i] = True
    return out


def main_text(source: str | None) -> str:
    """The main text: blocks in page order, joined by newlines; empty if there is none."""
    page = parse(source or "")
    elements = page.elements
    parts: dict[tuple[int, int], list[tuple[str, bool]]] = {}
    for e, b, t in page.nodes:
        if not elements[e].bad:
            parts.setdefault((b, elements[e].block), []).append((t, elements[e].linked))
    owner, texts, links = [], [], []
    for (_, e), own in parts.items():
        t = _BLANK.sub(" ", "".join(x for x, _ in own)).strip()
        if t:
            owner.append(e)
            texts.append(t)
            links.append(min(1.0, sum(len(x.strip()) for x, a in own if a) / len(t)))
    if not texts:
        return ""
    # Ratios of each path.
    paths = np.array([elements[e].path for e in owner])
    kinds, path = np.unique(paths, return_inverse=True)
    n = np.bincount(path)
    chars = np.array([len(t) for t in texts], float)
    length = np.bincount(path, weights=chars) / n
    points = np.bincount(path, weights=[len(_PUNCTUATION.findall(t)) for t in texts]) / n
    free = 1 - np.bincount(path, weights=np.array(links) * chars) / np.bincount(path, weights=chars)
    own_score = length * (1 + points) * free
    # A prior for marked parts, unless they hold most of the text.
    held = _held(elements, owner, chars)
    articles = [i for i, e in enumerate(elements) if e.tag in ("article", "main") and not e.mark and not e.bad and held[i]]
    free_marks = {elements[i].mark for i in range(len(elements)) if elements[i].mark and held[elements[i].mark] > MOST * held[0] and not articles}
    prior = np.array([PRIOR if (k := elements[e].mark) and k not in free_marks else 1.0 for e in owner])
    fused = _smooth(length[path]) * (1 + _smooth(points[path])) * free[path] * prior
    chosen = (fused > 0) & (fused >= min(fused.std(), fused.max()))
    if not chosen.any():
        return ""
    form_text = _held(elements, owner, chars * chosen)
    out_of_form = np.array([not (k := elements[e].form) or form_text[k] > MOST * form_text[0] for e in owner])
    chosen &= out_of_form
    content = np.bincount(path, weights=chars * chosen) > MOST * np.bincount(path, weights=chars)
    if not content.any():
        return ""
    weight = chars * chosen * prior
    mass = np.bincount(path, weights=weight) * content
    top = int(mass.argmax())

    # What a parent may bring in: selected text, and text tags that aren't lists of links.
    plain = np.array([elements[e].tag in PARTS and x < MOST for e, x in zip(owner, links, strict=True)])
    picked, readable = _held(elements, owner, weight), _held(elements, owner, chars * (chosen | plain))
    mains = _main_elements(elements, owner, picked, readable, held, int(kinds[top]))
    article = all(elements[i].tag in ("article", "main") for i in mains)
    # Lists whose items may be links: under a heading, or with an item that is none.
    sources = {elements[e].parent for i, e in enumerate(owner) if elements[e].tag == "li" and (links[i] < MOST or (i and elements[owner[i - 1]].tag in HEADINGS))}
    inside = _inside(elements, mains)
    keep = []
    for i, e in enumerate(owner):
        tag = elements[e].tag
        k = path[i]
        full = own_score[k] >= NEAR * own_score[top]
        if not inside[e] or not out_of_form[i] or (prior[i] < 1 and not content[k] and (elements[e].strict or not full)):
            keep.append(False)
        elif tag in PARTS:
            keep.append(bool(content[k]) or links[i] < MOST or (article and tag == "li" and prior[i] == 1 and elements[e].parent in sources))
        else:
            keep.append(bool(content[k]) and full)
    # Last parts without a heading and without the dominant path are comments; in an article only if they are several of one make.
    is_top = [bool(path[i] == top and keep[i]) for i in range(len(owner))]
    dominant = _held(elements, owner, [float(x) for x in is_top])
    titles = _held(elements, owner, [float(elements[e].tag in HEADINGS and keep[i]) for i, e in enumerate(owner)])
    repeats = _repeats(elements, held) if article else []
    for i in range(len(owner) - 1, max((i for i, x in enumerate(is_top) if x), default=-1), -1):
        e, outer = owner[i], 0
        while e not in mains and e > 0:
            if elements[e].tag in ("div", "section", "article") and not dominant[e] and (not article or repeats[e] or elements[e].tag == "article"):
                outer = e
            e = elements[e].parent
        if outer and not titles[outer] and elements[outer].tag != "section":
            keep[i] = False
    return "\n".join(t for t, k in zip(texts, keep, strict=True) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars (code points). A null or empty page has the empty text. Other columns are not carried."""
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(x) for x in batch.column("__text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("__url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    source = pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url"), F.col(html_col).alias("__text"))
    return arrow_map(source, "__text", kernel, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars bigint")
