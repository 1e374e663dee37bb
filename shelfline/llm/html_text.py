"""Main text of web pages from parser events, text-to-tag ratios and smoothed clustering.

The standard library's parser streams a page once. Block elements cut it into lines; each line
holds its text and the number of tags met since the line before. Text inside navigation, forms,
scripts, adverts and the like counts as no text. The text-to-tag ratios are smoothed with a
Gaussian and split by two-means; the lines of the upper cluster are content. The region starts at
the article or main element with most content, or at the body where none holds a fair share, and
moves down into the element that holds nearly all content, but not out of an article or main
element; every line of that region that is not boilerplate belongs to the text, also a short one
between long ones.

Cases: null or empty html, or a page of boilerplate only, gives an empty text; unclosed elements end
with their parent; null ids and repeated rows give a row each; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.llm.common import in_batches, portions, table

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol option p pre search "
    "section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
# Elements that an opening tag ends, as their end tags may be left out.
P_ENDED_BY = BLOCKS - frozenset("body caption dd dt head html legend li option summary tbody td textarea tfoot th thead title tr".split())
ENDED_BY = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"]),
    "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]),
    "tbody": frozenset(["tbody", "thead", "tr", "td", "th"]), "body": frozenset(["head"]),
}
#: Elements whose text is never part of an article.
DROPPED = frozenset(
    "head title script style noscript template nav menu aside footer form button select textarea dialog iframe object "
    "svg canvas audio video search".split()
)
#: Words of class, id or role names that mark boilerplate.
MARKS = frozenset(
    "ad ads adv advert advertisement advertising adverts alert banner breadcrumb breadcrumbs comment comments complementary "
    "contentinfo cookie cookies consent disqus footer form gdpr header legal masthead menu modal nav navbar navigation "
    "newsletter notice notices notification popup promo promotion related reply replies respond rail search share sharing "
    "sidebar signup skip social sponsor sponsored subscribe tags teaser toolbar widget".split()
)
NEGATED = frozenset(["has", "no", "with", "without"])
MARKED = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements the region does not leave for a child.
LANDMARKS = frozenset(["article", "main"])
#: Elements that names alone do not turn into boilerplate.
UNMARKED = LANDMARKS | frozenset(["html", "body", "h1"])

SIGMA = 1.0
#: Share of the content that a child must hold for the region to move down to it, and an article or
#: main element for the region to start there.
HELD, HELD_BY_LANDMARK = 0.7, 0.3


class Lines(HTMLParser):
    """Collects a page's lines: text, tags before it, element, and whether it is boilerplate."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.names, self.parents = ["#root"], [-1]
        # Tag, element, whether its lines are boilerplate, whether its text is left out of a line.
        self.open: list[tuple[str, int, bool, bool]] = [("#root", 0, False, False)]
        self.lines: list[tuple[str, int, int, bool]] = []
        self.parts: list[str] = []
        self.tags = 0

    def end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts.clear()
        if text:
            _, element, dropped, _ = self.open[-1]
            self.lines.append((text, self.tags, element, dropped))
            self.tags = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.end_line()
        elif tag in ("br", "img"):
            self.parts.append(" ")
        if tag in P_ENDED_BY:
            self.leave("p", stop=("article", "section", "div", "td", "li", "button", "body"))
        for name in ENDED_BY.get(tag, ()):
            self.leave(name, stop=("ul", "ol", "dl", "table", "select", "menu"))
        if tag in VOID:
            return
        _, parent, dropped, silent = self.open[-1]
        if not dropped and not silent:
            inside = any(x[0] in LANDMARKS for x in self.open)
            found = tag in DROPPED or tag == "header" and not inside
            found = found or tag not in UNMARKED and self.is_marked(attrs, inside)
            dropped, silent = found and tag in BLOCKS, found and tag not in BLOCKS
        if tag in BLOCKS:
            self.names.append(tag)
            self.parents.append(parent)
            parent = len(self.names) - 1
        # Inline elements belong to the line of their block.
        self.open.append((tag, parent, dropped, silent))

    @staticmethod
    def is_marked(attrs: list[tuple[str, str | None]], inside: bool) -> bool:
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return True
            if name in ("class", "id", "role"):
                for part in (value or "").split():
                    words = {w.lower() for w in MARKED.findall(part)}
                    # An article's own header holds its title; "with-sidebar" is no sidebar.
                    if words & MARKS - ({"header"} if inside else set()) and not words & NEGATED:
                        return True
        return False

    def leave(self, tag: str, stop: tuple[str, ...]) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                self.end_line()
                del self.open[k:]
                return
            if self.open[k][0] in stop:
                return

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                if any(x[0] in BLOCKS for x in self.open[k:]):
                    self.end_line()
                del self.open[k:]
                return
        if tag in BLOCKS:
            self.end_line()

    def handle_data(self, data: str) -> None:
        if not self.open[-1][3]:
            self.parts.append(data)


def smoothed(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; near the ends the weights inside are scaled up to one."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    total = np.convolve(values, kernel)[reach : reach + len(values)]
    return total / np.convolve(np.ones(len(values)), kernel)[reach : reach + len(values)]


def upper_cluster(values: np.ndarray) -> np.ndarray:
    """Two-means on a line: which values lie nearer to the higher centre."""
    low, high = values.min(), values.max()
    if low == high:
        return values > 0
    while True:
        upper = values > (low + high) / 2
        centres = values[~upper].mean(), values[upper].mean()
        if centres == (low, high):
            return upper
        low, high = centres


def main_text(html: str | None) -> str:
    """The article of a page, one line per block."""
    page = Lines()
    page.feed(html or "")
    page.close()
    page.end_line()
    lines = page.lines
    if not any(not dropped for _, _, _, dropped in lines):
        return ""
    ratios = np.array([0.0 if dropped else len(text) / max(tags, 1) for text, tags, _, dropped in lines])
    content = upper_cluster(smoothed(ratios))
    if not any(c and not line[3] for c, line in zip(content, lines)):
        content = ratios > 0
    held = [0] * len(page.names)
    for chosen, (text, _, element, dropped) in zip(content, lines):
        if not dropped:
            # Content counts for twice as much as other lines that are not boilerplate.
            held[element] += len(text) * (2 if chosen else 1)
    for k in range(len(held) - 1, 0, -1):
        held[page.parents[k]] += held[k]
    titled = {0}
    for k, name in enumerate(page.names):
        if name == "h1":
            up = k
            while up >= 0:
                titled.add(up)
                up = page.parents[up]
    children: dict[int, list[int]] = {}
    for k in range(1, len(page.names)):
        children.setdefault(page.parents[k], []).append(k)
    landmarks = [k for k, name in enumerate(page.names) if name in LANDMARKS and held[k] >= HELD_BY_LANDMARK * held[0]]
    region = max(landmarks, key=lambda k: held[k], default=0)
    while page.names[region] not in LANDMARKS:
        best = max(children.get(region, ()), key=lambda k: held[k], default=None)
        if best is None or held[best] < HELD * held[region] or region in titled and len(titled) > 1 and best not in titled:
            break
        if page.names[best] in ("p", "h1", "h2", "h3", "li", "pre"):
            break
        region = best
    inside = [False] * len(page.names)
    for k in range(len(page.names)):
        inside[k] = k == region or k > 0 and inside[page.parents[k]]
    return "\n".join(text for text, _, element, dropped in lines if inside[element] and not dropped)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portions(batches, "html"):
            texts = [main_text(h) for h in part.column("html").to_pylist()]
            counts = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), counts],
                ["page_id", "url", "text", "n_chars"],
            )

    chosen = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return in_batches(chosen, run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
