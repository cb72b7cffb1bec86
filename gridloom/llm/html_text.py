"""Main text of web pages, by text-to-tag ratios.

The standard library's parser streams its events into lines, one a block, each with its text, its tags, its link text
and the elements around it. Characters per tag are smoothed along the page with a Gaussian, and a two-means clustering of
the smoothed ratios gives the threshold of content. Where the lines above it are decides everything else:

* A class or id that sounds like an advert, a menu or comments lowers the ratios of the lines in it to a twentieth, unless the
  element turns out to be a wrapper: it holds an article, or, on a page without other articles, more than half of the content (and,
  if it is no article itself, of the lines), comments left out.
  Words like `has-sidebar` or `comments-open` say nothing.
* Articles and main elements are the regions if they hold a third of the content or more: every one that stands by itself and has a
  content line. Otherwise the region is the deepest element that holds nearly all content; if that is the page, it reaches
  from the first content line to the last, without link lists.
* All lines of the regions that were not lowered are the text, so a short paragraph of an article is not lost. If nothing is
  left, all lines are.

Menus, footers, asides, scripts, buttons and the like (by element or role), hidden elements, and a header outside of articles
are no lines at all.

Text: character references decoded, white space inside a block as one space, blocks in page order joined by an empty
line. Nothing is capped.

Defined results: NULL, empty, and pages without text give "". Repeated rows get equal texts; an empty table gives an
empty result. Unclosed and crossed tags end where an element around them ends. Elements nested deeper than `DEPTH` count as
that deep. Other columns are ignored.
"""
from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .frames import fields, map_pieces, pick, table

SIGMA = 1.5                 # lines
DEPTH = 512                 # elements nest so deep and no deeper, as in browsers; text below belongs to the deepest
NEARLY_ALL = 0.9            # share of the content that a region without a name of its own must hold
REGION_SHARE = 1 / 3        # share of the content that articles must hold to be the regions
WRAPPER_SHARE = 0.5         # an element that holds more of the content is no advert, whatever its class says
LOWERED = 0.05              # what is left of a ratio in an element whose class or id tells against it

VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
ASIDE = frozenset("nav footer aside script style noscript template button select textarea option iframe object svg canvas dialog menu head title audio video map datalist".split())
ASIDE_WORDS = frozenset("""ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar nav navbar navigation menu breadcrumb
    breadcrumbs footer header masthead cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe subscription
    share sharing social related recommended widget pagination pager toolbar login signup search skip form""".split())
COMMENT_WORDS = frozenset("comment comments respond reply replies disqus".split())
STATES = frozenset("has have no not non with without is are open opened closed enable enabled disable disabled on off hide hidden show shown allow count".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
HEADERS = frozenset("header".split())
LEAVES = INLINE | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre tr td th tbody thead caption figcaption blockquote address".split())    # no regions of their own
REGIONS = frozenset("article main".split())
CLOSES_P = frozenset("""address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre
    section table ul dd dt li""".split())
_TOKEN = re.compile(r"[a-z0-9]+")


def sounds_like(names: str) -> str | None:
    """What a class or id says of an element: `aside`, `comment` or nothing. Names that tell a state say nothing."""
    said = None
    for name in names.lower().split():
        parts = set(_TOKEN.findall(name))
        if parts & STATES:
            continue
        if parts & COMMENT_WORDS:
            return "comment"
        if parts & ASIDE_WORDS:
            said = "aside"
    return said


class Lines(HTMLParser):
    """Blocks of a page: text, tags, link characters, path of elements; which elements are regions, and what others sound like."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, tuple]] = []
        self.regions: dict[int, str] = {}
        self.sounding: dict[int, str] = {}
        self.stack: list[list] = [["", 0, False, False, False]]     # name, number, no line, in a region, link
        self.text: list[str] = []
        self.tags = self.links = self.number = self.top = 0         # top: the number of the body

    def _flush(self) -> None:
        if self.text:
            words = " ".join("".join(self.text).split())
            if words:
                self.lines.append((words, self.tags, self.links, tuple(e[1] for e in self.stack if e[0] not in LEAVES or e[1] in self.sounding)))
            self.text = []
        self.tags = self.links = 0

    def _close(self, index: int) -> None:
        if any(e[0] not in INLINE for e in self.stack[index:]):
            self._flush()
        del self.stack[index:]

    def _find(self, names, stop=frozenset()) -> int:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] in names:
                return i
            if self.stack[i][0] in stop:
                break
        return 0

    def handle_starttag(self, tag, attrs):
        if tag not in INLINE and tag != "br":
            self._flush()
        self.tags += 1
        if tag in CLOSES_P and (i := self._find(("p",), ("div", "td", "th", "article", "section", "blockquote"))):
            self._close(i)
        if tag in ("li", "dt", "dd") and (i := self._find(("li",) if tag == "li" else ("dt", "dd"), ("ul", "ol", "dl"))):
            self._close(i)
        if tag in ("td", "th", "tr") and (i := self._find(("tr",) if tag == "tr" else ("td", "th"), ("table",) if tag == "tr" else ("table", "tr"))):
            self._close(i)
        if tag in ("br", "wbr"):
            self.text.append(" " if tag == "br" else "")
        if tag in VOID or len(self.stack) > DEPTH:
            return
        parent = self.stack[-1]
        aside, region = parent[2], parent[3]
        self.number += 1
        if tag == "body":
            self.top = self.number
        if not aside:
            given = dict(attrs)
            style, role = (given.get("style") or "").replace(" ", "").lower(), (given.get("role") or "").lower()
            aside = (tag in ASIDE or role in ASIDE_ROLES or "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in style
                     or (tag in HEADERS and not region))
            said = "aside" if tag == "form" else sounds_like(f"{given.get('class') or ''} {given.get('id') or ''}") if given and tag not in ("body", "html") else None
            if said and tag in INLINE:
                aside = True
            elif said and not aside:
                self.sounding[self.number] = said
            if (tag in REGIONS or role == "main") and not aside:
                self.regions[self.number] = "main" if role == "main" else tag
                region = True
        self.stack.append([tag, self.number, aside, region, parent[4] or tag == "a"])

    def handle_endtag(self, tag):
        if tag in VOID:
            return
        if tag in INLINE:
            i = len(self.stack) - 1
            while i > 0 and self.stack[i][0] != tag and self.stack[i][0] in INLINE:
                i -= 1
            self.tags += 1
            if self.stack[i][0] == tag:
                del self.stack[i:]
            return
        self.tags += 1
        if i := self._find((tag,), ("td", "th") if tag not in ("table", "tbody", "thead", "tr", "td", "th", "body", "html", "div", "article", "main", "section") else ()):
            self._close(i)
        else:
            self._flush()

    def handle_data(self, data):
        top = self.stack[-1]
        if not top[2]:
            self.text.append(data)
            if top[4]:
                self.links += len(data)

    def finish(self) -> list:
        self.close()
        self._flush()
        return self.lines


def smoothed(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """`values` smoothed along the page; at its ends the kernel is cut off and rescaled."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-np.arange(-reach, reach + 1) ** 2 / (2 * sigma ** 2))
    cut = slice(reach, reach + len(values))
    return np.convolve(values, kernel)[cut] / np.convolve(np.ones(len(values)), kernel)[cut]


def threshold(values: np.ndarray) -> float:
    """The border between the two means of a two-means clustering."""
    low, high = float(values.min()), float(values.max())
    for _ in range(50):
        border = (low + high) / 2
        upper = values >= border
        if upper.all() or not upper.any():
            break
        low, high, before = float(values[~upper].mean()), float(values[upper].mean()), border
        if abs((low + high) / 2 - before) < 1e-9:
            break
    return (low + high) / 2


def closed(html: str) -> str:
    """`html` without what the parser would look for to the end of the page, again and again: a comment or marked section
    that never ends goes with all behind it, unless a script is open, and a tag that never ends is text."""
    for opening, closing in (("<!--", "-->"), ("<![", ">"), ("<!", ">"), ("<?", ">")):
        last = html.rfind(closing)
        at = html.find(opening, max(0, last))
        if at >= 0:
            html = html[:at] + (html[at:].replace(opening, "") if "</script" in html[at:].lower() else "")
    last = html.rfind(">") + 1
    return html[:last] + html[last:].replace("<", "&lt;")


def _content(lines: list, low: np.ndarray) -> np.ndarray:
    """Which lines are content, by the clustering of their smoothed ratios; `low` ones count little, and are none."""
    ratios = np.array([(len(text) - links) / max(1, tags) for text, tags, links, _ in lines], float)
    smooth = np.log1p(smoothed(np.where(low, ratios * LOWERED, ratios)))        # a paragraph of twice the length is no other kind of line
    return ~low & (smooth >= threshold(smooth[~low]) - 1e-9)


def _held(lines: list, content: np.ndarray) -> dict[int, int]:
    """Characters of content in each element."""
    held: dict[int, int] = {}
    for (text, _, _, path), counts in zip(lines, content.tolist()):
        for element in path if counts else ():
            held[element] = held.get(element, 0) + len(text)
    return held


def _lowered(lines: list, parser: Lines) -> np.ndarray:
    """Lines inside an element that sounds like no content, and is no wrapper."""
    if not parser.sounding:
        return np.zeros(len(lines), bool)
    wrappers: set[int] = set()
    if all(e in parser.sounding for e in parser.regions):           # no article says where the text is
        comment = np.array([any(parser.sounding.get(e) == "comment" for e in path) for *_, path in lines])
        if comment.all():
            return comment
        held, counts = _held(lines, _content(lines, comment)), Counter(e for (*_, path), c in zip(lines, comment.tolist()) if not c for e in path)
        for e, said in parser.sounding.items():
            if said == "aside" and held.get(e, 0) > WRAPPER_SHARE * held[0] and (e in parser.regions or counts[e] > WRAPPER_SHARE * counts[0]):
                wrappers.add(e)
    for *_, path in lines:
        inside = False                                  # is there an article below, that no comment holds?
        for element in reversed(path):
            if parser.sounding.get(element) == "comment":
                break
            if inside and element in parser.sounding:
                wrappers.add(element)
            inside = inside or (element in parser.regions and element not in parser.sounding)
    return np.array([any(e in parser.sounding and e not in wrappers for e in path) for *_, path in lines])


def _regions(lines: list, parser: Lines, held: dict[int, int]) -> set[int]:
    """The articles and main elements that stand by themselves and hold content; of a main element, its articles if they hold nearly all of it."""
    inner: dict[int, set[int]] = {}
    outer: set[int] = set()
    for *_, path in lines:
        found = [e for e in path if e in parser.regions and held.get(e)]
        outer.update(found[:1])
        for a, b in zip(found, found[1:]):
            inner.setdefault(a, set()).add(b)
    out: set[int] = set()
    for e in outer:
        articles = inner.get(e, set()) if parser.regions[e] == "main" else set()
        out |= articles if sum(held[a] for a in articles) >= NEARLY_ALL * held[e] else {e}
    return out if sum(held[e] for e in out) >= REGION_SHARE * held.get(0, 0) else set()


def main_text(html: str | None) -> str:
    if not html:
        return ""
    parser = Lines()
    parser.feed(closed(html))
    lines = parser.finish()
    if not lines:
        return ""
    low = _lowered(lines, parser)
    if low.all():
        return "\n\n".join(line[0] for line in lines)
    content = _content(lines, low)
    held = _held(lines, content)
    regions = _regions(lines, parser, held)
    if regions:
        kept = [line[0] for line, is_low in zip(lines, low.tolist()) if not is_low and regions.intersection(line[3])]
    else:
        deepest = max((e for e, n in held.items() if n >= NEARLY_ALL * held[0]), default=0)
        inside = [i for i, line in enumerate(lines) if deepest in line[3] and not low[i]]
        chosen = [i for i in inside if content[i]]
        ends = (chosen[0], chosen[-1]) if deepest <= parser.top else (0, len(lines))
        kept = [lines[i][0] for i in inside if ends[0] <= i <= ends[1] and (content[i] or 2 * lines[i][2] < len(lines[i][0]))]
    return "\n\n".join(kept)


def _texts(piece: pa.RecordBatch) -> dict:
    texts = [main_text(h) for h in piece.column("html").to_pylist()]
    return {"page_id": piece.column("page_id"), "url": piece.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page. One pass, no shuffle."""
    return map_pieces(pick(pages, page_id="page_id:bigint", url="url:string", html="html:string"), "html", _texts, fields("page_id:bigint", "url:string", "text:string", "n_chars:bigint"))


def op8_html_extraction(spark, folder: str) -> DataFrame:
    return extracted(table(spark, folder, "pages"))
