"""Main text of HTML pages from streaming parser events and text-to-tag ratios.

The standard library's HTMLParser streams events; block-level tags cut the page into
blocks, which stand for its lines (pages are often one physical line). Each block has
its text, the number of its tags and the regions (containers) that hold it. White
space inside a block is one space; `<br>` is white space; references are decoded.

1. Boilerplate regions are left out by what they declare: scripts, styles, forms, nav,
   page headers and footers, asides, hidden parts, and containers whose class, id or
   role names menus, notices, adverts, comments and the like: as a whole name
   (`comment`), as its last part (`cookie-notice`) or followed by words of layout only
   (`ad-box`, but not `social-science`). Articles are left out by a whole name only.
   A part left out inside a line does not end the line.
2. Of what remains, the text-to-tag ratio per block is smoothed by a Gaussian kernel
   and clustered around a threshold (the smaller of half the standard deviation and half
   the mean). A list or container that is mostly links, its own ratio below the threshold,
   is a menu unless it stands in an article or main. Each block at the threshold or above
   votes with its text for the regions that hold it. Blocks of menus do not, nor do short
   ones that only their neighbours lift while most of the container around them is below.
3. The content regions are every article with votes and every main with votes outside
   its articles. If they hold less than half of the vote (or there are none), the region
   is the smallest container (section, div and the like) that holds the whole vote,
   without menus. All remaining blocks in the regions are the text, short ones too, in page
   order, one line each. If only the page itself holds the whole vote, the text is the
   blocks from the first to the last one that votes, without menus.

Null, empty and textless pages give an empty text. Null ids and repeated rows pass
through, each row alone; further columns are dropped. Memory follows one page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.shared import bound_batches

# HTML elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SKIPPED = frozenset("script style noscript template head title form nav footer aside menu dialog iframe object svg canvas select textarea button audio video math".split())
SEMANTIC = frozenset(("article", "main"))
PAGE = frozenset(("", "html", "body"))
CONTAINERS = PAGE | SEMANTIC | {"section", "div", "center"}
GROUPS = CONTAINERS | {"ul", "ol", "dl", "table"}
IN_LINE = INLINE | frozenset("script style noscript template iframe object svg canvas select textarea button audio video math".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
# Names in class, id and role that mark boilerplate.
MARKED = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs toc pagination pager "
    "header masthead topbar footer contentinfo colophon copyright "
    "sidebar aside complementary widget related recommended recommendations "
    "notice cookie cookies consent gdpr alert popup modal overlay toast disclaimer newsletter subscribe subscription signup login "
    "comment comments disqus respond replies reply "
    "share sharing social search form hidden".split()
)
# Names that only say what a layout has, and those of an article's own head.
LAYOUT = frozenset(("has", "with", "no", "without", "long"))
# Words of layout that may follow such a name.
PARTS = frozenset(
    "container wrapper wrap box list item items link links area section block bar inner outer content panel slot unit left right top bottom "
    "col column row title text body icon icons button buttons group main primary secondary thread holder frame".split()
)
HEADS = frozenset(("header", "masthead"))
WHITE = re.compile(r"\s+")
NAME = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
SIGMA = 1.5


class _Region:
    __slots__ = ("tag", "parent", "depth", "skip", "head", "vote", "quiet", "chars", "link_chars", "tags", "blocks", "inside", "high")

    def __init__(self, tag: str, parent: _Region | None, skip: bool, head: bool = False, quiet: bool = False):
        self.tag, self.parent, self.skip, self.head, self.vote = tag, parent, skip, head or tag == "header", 0
        self.depth = parent.depth + 1 if parent else 0
        # inside a part that is left out of a line
        self.quiet = quiet or bool(parent and parent.quiet)
        # of the blocks for which this is the innermost group
        self.chars = self.link_chars = self.tags = 0
        # of all blocks inside: their number, characters, and characters of those above the threshold
        self.blocks = self.inside = self.high = 0


class Blocks(HTMLParser):
    """The blocks of a page: (text, tags, region), boilerplate left out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.region = _Region("", None, False)
        self.parts: list[str] = []
        self.tags = self.anchors = self.link_chars = 0
        self.blocks: list[tuple[str, int, _Region]] = []

    def flush(self) -> None:
        """Ends the block, which belongs to the region around any part left out of its line."""
        region = self.region
        while region.quiet:
            region = region.parent
        text = WHITE.sub(" ", "".join(self.parts)).strip()
        if text and not region.skip:
            self.blocks.append((text, self.tags, region))
            group = self.group(region)
            group.chars += len(text)
            group.link_chars += self.link_chars
            group.tags += max(1, self.tags)
        self.parts, self.tags, self.anchors, self.link_chars = [], 0, 0, 0

    @staticmethod
    def group(region: _Region) -> _Region:
        while region.tag not in GROUPS:
            region = region.parent
        return region

    def _skips(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if self.region.skip or tag in SKIPPED:
            # an article's own header keeps its headings
            return not (self.region.head and tag in HEADINGS and self._within_article(self.region))
        if tag == "header":
            return True
        if tag in ("main", "html", "body"):
            return False
        for k, v in attrs:
            if k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and v and "display:none" in v.replace(" ", "").lower():
                return True
        return bool(self._marks(attrs, tag == "article"))

    @staticmethod
    def _marks(attrs: list[tuple[str, str | None]], whole: bool = False) -> set[str]:
        """The marks that class, id and role name, only whole names if `whole`."""
        found: set[str] = set()
        for k, v in attrs:
            if k in ("class", "id", "role") and v:
                for name in v.split():
                    parts = NAME.findall(CAMEL.sub("-", name).lower())
                    if not parts or not LAYOUT.isdisjoint(parts) or whole and len(parts) > 1:
                        continue
                    if parts[-1] in MARKED:
                        found.add(parts[-1])
                    elif parts[0] in MARKED and PARTS.issuperset(parts[1:]):
                        found.add(parts[0])
        return found

    @staticmethod
    def _within_article(region: _Region | None) -> bool:
        region = region.parent if region else None
        while region:
            if region.tag in SEMANTIC:
                return True
            if region.skip:
                return False
            region = region.parent
        return False

    def _leave(self, tag: str, scope: set[str] = frozenset()) -> None:
        """Ends the innermost open `tag` and all in it, unless a scope element stands before."""
        r = self.region
        while r.parent and r.tag != tag:
            if r.tag in scope:
                return
            r = r.parent
        if r.parent:
            if not r.quiet:
                self.flush()
            self.region = r.parent

    def handle_starttag(self, tag, attrs):
        if tag in IN_LINE:
            self.tags += not self.region.quiet
            if tag == "br":
                self.parts.append(" ")
            elif tag not in VOID and self._skips(tag, attrs):
                self.region = _Region(tag, self.region, True, quiet=True)
            elif tag == "a":
                self.anchors += 1
            return
        if not self.region.quiet:
            self.flush()
            self.tags += 1
            if tag in CLOSES_P:
                self._leave("p", {"article", "main", "section", "div", "td", "li", "blockquote", "button"})
        for other in SIBLINGS.get(tag, ()):
            self._leave(other, SCOPES[tag])
        if tag not in VOID:
            marks = self._marks(attrs)
            self.region = _Region(tag, self.region, self._skips(tag, attrs), bool(marks) and marks <= HEADS)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and (tag not in IN_LINE or self.region.quiet and self.region.tag == tag):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in IN_LINE and not (self.region.quiet and self.region.tag == tag):
            self.tags += not self.region.quiet
            if tag == "a" and self.anchors:
                self.anchors -= 1
            return
        if not self.region.quiet:
            self.flush()
        self._leave(tag)

    def handle_data(self, data):
        if not self.region.skip:
            self.parts.append(data)
            if self.anchors:
                self.link_chars += len(data.strip())


def smooth(x: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing, the kernel renormalised at the ends."""
    r = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    part = slice(r, r + len(x))
    return np.convolve(x, kernel)[part] / np.convolve(np.ones(len(x)), kernel)[part]


def main_text(html: str | None) -> str:
    parser = Blocks()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    blocks = parser.blocks
    if not blocks:
        return ""
    raw = np.array([len(t) / max(1, n) for t, n, _ in blocks])
    ratio = smooth(raw)
    threshold = min(ratio.std(), ratio.mean()) / 2
    groups = [parser.group(r) for _, _, r in blocks]
    menu = np.array([2 * g.link_chars > g.chars and g.chars < threshold * g.tags and not any(r.tag in SEMANTIC for r in _path(g)) for g in groups])
    high = ratio >= threshold
    for (text, _, leaf), h in zip(blocks, high.tolist(), strict=True):
        for r in _path(leaf):
            r.blocks, r.inside, r.high = r.blocks + 1, r.inside + len(text), r.high + h * len(text)
    for i in np.flatnonzero(high & (raw < threshold)):
        around = next((r for r in _path(blocks[i][2]) if r.tag in GROUPS and r.blocks > 1), None)
        high[i] = around is None or 2 * around.high >= around.inside
    at = np.flatnonzero(high & ~menu)
    if not len(at):  # nothing but links
        return ""
    total, declared, kept = 0, 0, set()
    for i in at:
        text, _, leaf = blocks[i]
        total += len(text)
        semantic = [r for r in _path(leaf) if r.tag in SEMANTIC]
        declared += len(text) if semantic else 0
        kept.update(r for n, r in enumerate(semantic) if n == 0 or r.tag == "article")
        for region in _path(leaf):
            region.vote += len(text)
    if 2 * declared < total or not kept:  # no article or main, or only teasers
        best = max((r for r in _path(blocks[at[0]][2]) if r.tag in CONTAINERS and r.vote == total), key=lambda r: r.depth)
        if best.tag in PAGE:  # the page itself: no container holds the content
            return "\n".join(blocks[i][0] for i in range(at[0], at[-1] + 1) if not menu[i])
        return "\n".join(t for (t, _, r), m in zip(blocks, menu, strict=True) if not m and any(p is best for p in _path(r)))
    return "\n".join(t for t, _, r in blocks if any(p in kept for p in _path(r)))


def _path(region: _Region | None) -> Iterator[_Region]:
    while region:
        yield region
        region = region.parent


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(x.as_py()) for x in b.column("html")]
        cols = [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, ["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points of the text) of each page."""
    bound_batches(pages.sparkSession)
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return src.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
