"""Main text of web pages: text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

The standard library's parser streams a page's events. Each block element's text is a line; a line's ratio is its
characters outside links over the number of tags it was made with. Ratios are smoothed over neighbouring lines with a
Gaussian, and split by a threshold into content and the rest (two clusters, fitted to each page). Content lines vote
for the elements that hold them; the winning element is the content region (an article element being no more than a prior),
and all its lines are returned, short ones too, but for those inside menus, headers, footers, sidebars, notices, adverts,
forms and comments. Names of classes and ids mark those only where they say nothing else, and names of headings never. The work grows with a page's length only, whatever its nesting.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .runtime import add_columns, bound_batches, texts

#: Elements whose text is no text of the page.
SILENT = frozenset("script style noscript template head title svg math canvas iframe object embed audio video".split())
#: Elements that hold what surrounds an article.
AROUND = frozenset("nav footer aside form button select textarea fieldset dialog menu label input".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr "
    "ul caption option".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class and id names that mark what surrounds an article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice notices notification alert comment comments disqus respond reply replies sidebar menu menus "
    "nav navbar navigation breadcrumb breadcrumbs header masthead footer related recommended share sharing social "
    "newsletter subscribe signup login modal popup overlay widget pagination pager skip".split()
)
#: Those of them that mark what readers wrote; an article among those isn't the page's.
TALK = frozenset("comment comments disqus respond reply replies".split())
#: Words that may stand beside such words in a name; with others ("share-price", "related-work") it says something else.
_PLACES = frozenset("site main primary secondary left right top bottom global".split())
_SHAPES = frozenset(
    "area bar block body box button buttons col column container content form group icons inner item items label link "
    "links list message outer panel post posts row section slot strip text thread title top unit widget wrap wrapper".split()
)
#: Elements whose names belong to the text: generated from headings.
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that can hold a whole text; a paragraph, list or table is a part of one.
_HOLDS = frozenset("html body div section article main td center".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar note".split())
_CLOSES_P = BLOCKS - {"body", "html", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option"}
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_P_SCOPE = tuple("ul ol dl table body html article section div main aside nav footer form blockquote td th li".split())
_LISTS = ("ul", "ol", "dl", "table", "select")
_BLOCK = "a block"  # no tag's name
_UNFINISHED = re.compile(r"<[A-Za-z/!?][^<>]*\Z")  # a page cut off inside a tag


def marks(names: str) -> set[str]:
    """The words of MARKS in class and id names that say nothing else: "ad", "ad-slot-2", "cookie-notice", "site-footer".

    Such a word, after one of place at most, begins the name, and words of shape and numbers may follow.
    """
    found = set()
    for name in names.lower().split():
        words = [x for x in re.split("[-_:]+", name) if x]
        if len(words) > 1 and words[0] in _PLACES:
            del words[0]
        if words and words[0] in MARKS and all(x in MARKS or x in _SHAPES or x.isdecimal() for x in words):
            found.add(words[0])
    return found


class _Lines(HTMLParser):
    """Turns a page's events into lines: (text, tags, link characters, element), and elements into a list of parents.

    Elements are numbered in page order, so a parent comes before its children. Where open elements of each tag lie in the
    stack is kept by tag, so that no event looks through the stack, however deep a page nests.
    Elements that only their names mark are kept in `named`, for it takes the whole page to tell whether they surround.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]  # tag, element, silent, inside an article
        self.places: dict[str, list[int]] = {}  # of open elements in the stack, by tag; blocks also under BLOCK
        self.parent = [0]
        self.around = [False]
        self.holds = [True]  # whether an element can hold a whole text
        self.parts: list[str] = []
        self.tags = self.linked = 0
        self.lines: list[tuple[str, int, int, int]] = []
        self.marked: set[int] = set()  # articles and the like
        self.named: dict[int, bool] = {}  # whether it is marked as what readers wrote

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, self.tags, self.linked, self.stack[-1][1]))
            self.tags = 0
        self.parts.clear()
        self.linked = 0

    def _last(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def _close(self, place: int) -> None:
        while len(self.stack) > place:
            tag = self.stack.pop()[0]
            self.places[tag].pop()
            if tag in BLOCKS:
                self.places[_BLOCK].pop()

    def _close_open(self, tags, stop) -> None:
        place = self._last(tags)
        if place > self._last(stop):
            self._close(place)

    @staticmethod
    def _id_marks(tag: str, name: str) -> set[str]:
        """What an id marks. A section's is made from its heading, unless it is what readers wrote and nothing else."""
        return ({name.lower()} & TALK) if tag == "section" else marks(name)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
            if tag == "p" or tag in _CLOSES_P:
                self._close_open(("p",), _P_SCOPE)
            if tag in _SAME:
                self._close_open(_SAME[tag], _LISTS)
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        _, parent, silent, inside = self.stack[-1]
        number = len(self.parent)
        self.parent.append(parent)
        self.holds.append(tag in _HOLDS)
        said = dict(attrs)
        names = marks(said.get("class") or "") | self._id_marks(tag, said.get("id") or "")
        if tag in _HEADINGS:
            names = set()
        elif tag in ("article", "main"):
            names &= TALK if tag == "article" else set()
        elif inside:
            names -= {"header"}  # an article's own
        if names and tag not in ("html", "body"):
            self.named[number] = bool(names & TALK)
        self.around.append(
            self.around[parent]
            or tag in AROUND
            or tag == "header" and not inside
            or (said.get("role") or "").lower() in ROLES
            or "hidden" in said
            or (said.get("aria-hidden") or "").lower() == "true"
            or "display:none" in (said.get("style") or "").replace(" ", "").lower()
        )
        if tag in ("article", "main") or said.get("itemprop") == "articleBody" or said.get("role") == "main":
            self.marked.add(number)
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCKS:
            self.places.setdefault(_BLOCK, []).append(len(self.stack))
        self.stack.append((tag, number, silent or tag in SILENT, inside or tag in ("article", "main")))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        place = self._last((tag,))
        # an inline element isn't closed across a block
        if place and (tag in BLOCKS or place > self._last((_BLOCK,))):
            self._close(place)

    def handle_data(self, data: str) -> None:
        tag, _, silent, _ = self.stack[-1]
        if not silent:
            self.parts.append(data)
            if tag == "a":
                self.linked += len(data)


def smooth(values: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """A Gaussian mean over neighbouring values, renormalised at the ends."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    total = np.convolve(values, kernel)[reach : reach + len(values)]
    return total / np.convolve(np.ones(len(values)), kernel)[reach : reach + len(values)]


def threshold(values: np.ndarray) -> float:
    """The border of two clusters on a line: halfway between their means, from the extremes on.

    Values (logarithms) that all lie within a factor of two are one cluster.
    """
    low, high = float(values.min()), float(values.max())
    if high - low < np.log(2):
        return low
    border = (low + high) / 2
    for _ in range(50):
        above = values >= border
        if above.all() or not above.any():
            return low
        new = (values[above].mean() + values[~above].mean()) / 2
        if abs(new - border) < 1e-9:
            break
        border = float(new)
    return border


def _summed(values: list[int], parent: list[int]) -> list[int]:
    """Each element's own value and those below it."""
    out = list(values)
    for e in range(len(out) - 1, 0, -1):
        out[parent[e]] += out[e]
    return out


def _below(elements, parent: list[int]) -> list[bool]:
    """Whether each element is one of these or lies below one."""
    out = [False] * len(parent)
    for e in range(1, len(parent)):
        out[e] = out[parent[e]] or e in elements
    return out


def _surrounding(named: dict[int, bool], marked: set[int], parent: list[int], lines: list) -> list[bool]:
    """Whether each element lies in a named one that does surround: none that wraps most of the content characters, in blocks
    of its own, or the only article."""
    talk = _below({e for e, t in named.items() if t}, parent)
    own, blocks = [0] * len(parent), [0] * len(parent)
    for text, _, linked, e in lines:
        own[e] += 0 if talk[e] else len(text) - linked
        blocks[e] += not talk[e]
    votes, blocks = _summed(own, parent), _summed(blocks, parent)
    around = {e for e, t in named.items() if t or 2 * votes[e] <= votes[0] or blocks[e] == 1 < blocks[0]}
    inside = _below(around, parent)
    articles = [e for e in marked if votes[e] > 0]
    if articles and all(inside[parent[e]] for e in articles):
        e = parent[max(articles, key=lambda e: (votes[e], -e))]
        while e:
            around.discard(e)
            e = parent[e]
        inside = _below(around, parent)
    return inside


def content_lines(ratio: np.ndarray) -> np.ndarray:
    """Which lines are content, by their text-to-tag ratios: smoothed, then split into two clusters."""
    even = smooth(np.log1p(ratio))
    return even >= threshold(even)


def _region(lines: list, content: np.ndarray, parent: list[int], marked: set[int], holds: list[bool]) -> int:
    """The element that content lines elect: the innermost that can hold a whole text, with four fifths of their characters.

    An article (or the like) is a prior: one around the elected element is taken instead, or one elsewhere that holds half of
    the content, or an eighth of all text (a short article). A smaller one, such as a teaser beside the text, isn't.
    """
    own, whole = [0] * len(parent), [0] * len(parent)
    for (text, _, linked, e), good in zip(lines, content, strict=True):
        own[e] += len(text) - linked if good else 0
        whole[e] += len(text)
    votes, whole = _summed(own, parent), _summed(whole, parent)
    if not votes[0]:
        votes = whole
    region = max(e for e, n in enumerate(votes) if 5 * n >= 4 * votes[0])
    while not holds[region]:
        region = parent[region]
    above = region
    while above and above not in marked:
        above = parent[above]
    if above:
        return above
    held = [e for e in marked if 2 * votes[e] >= votes[0] or 8 * whole[e] >= whole[0]]
    if held:
        most = max(whole[e] for e in held)
        return max(e for e in held if 5 * whole[e] >= 4 * most)
    inside = _below({region}, parent)
    if region and len(lines) > 1 and sum(inside[e] for *_, e in lines) == 1:
        return parent[region]  # a region that is one line only: other lines beside it belong to the same text
    return region


def main_text(html: str) -> str:
    """The text of a page's content region, a line for each block; empty if there is none."""
    parser = _Lines()
    parser.feed(_UNFINISHED.sub("", html))
    parser.close()
    parser.flush()
    lines = [x for x in parser.lines if not parser.around[x[3]]]
    if parser.named:
        around = _surrounding(parser.named, parser.marked, parser.parent, lines)
        lines = [x for x in lines if not around[x[3]]]
    if not lines:
        return ""
    ratio = np.array([max(0, len(text) - linked) / max(1, tags) for text, tags, linked, _ in lines])
    region = _region(lines, content_lines(ratio), parser.parent, parser.marked, parser.holds)
    inside = _below({region}, parser.parent)
    return "\n".join(text for text, *_, e in lines if not region or inside[e])


def extract(df: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """df with the main text of each whole page in a column; empty for a null or empty page.

    White space inside a block becomes one space, blocks are joined in page order by a line feed. Rows are read one by one,
    so repeated ones give the same; of regions with equal votes the inner, then the later one wins. Other columns pass
    through; one named as the output is replaced. Malformed markup is read as far as the parser gets.
    """

    def make():
        return lambda column: [pa.array([main_text(x) for x in texts(column)], type=pa.string())]

    bound_batches(df.sparkSession)
    return add_columns(df, [html], [T.StructField(out, T.StringType())], make)
