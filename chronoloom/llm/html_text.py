"""Main text of web pages from streaming parser events.

The standard library's parser yields tags and text. Blocks of text between block tags
are a page's lines. Each has a ratio of its text, links apart, to the tags in it; the
square roots of the ratios are smoothed by a Gaussian along the page, on which a border
between containers lies as far apart as ``border`` lines. Elements vote: in menus, headers, footers, sidebars, forms, and in elements whose class, id or role says
so, a line's score is multiplied by less than one. A threshold between the two clusters
of scores (Otsu's, half of the best score at most) tells content lines from others, and
runs of content lines form clusters; those with a small share of the largest go.

Content regions follow from the clusters. An element that was voted against goes with
all its lines if no line in it reached the threshold, and stays if one did. Where article
or main elements hold half of the content or more, the regions are those of them with
content; elsewhere they are the stretch from the first to the last content line and the
containers that hold content lines. All lines of a region stay, short ones too.

A vote by class, id, form or header does not count for an element with most of a page's
text unless there is an article, or a fair share of content, beside it.

Defined results: null and empty pages, and pages without text or with menus alone, give
an empty text; unclosed and truncated markup is closed at the end; equal scores fall on
the same side of the threshold; repeated rows repeat results; an empty table gives no
rows; further columns are ignored; long and deep pages are read whole, in time in
proportion to their length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, chunks

# Elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: No text of a page: never read.
HIDDEN = frozenset("script style noscript template iframe object svg canvas button select textarea head title audio video".split())
#: Elements that vote against their lines whatever they hold, and those that may be a page's frame.
FIRM_TAGS = frozenset("nav footer aside menu dialog".split())
LOOSE_TAGS = frozenset("form header".split())
FIRM_ROLES = frozenset("navigation contentinfo complementary search menu menubar toolbar alert alertdialog dialog".split())
LOOSE_ROLES = frozenset("banner form".split())
CONTAINER = frozenset("article aside body div dl footer form header html main nav ol section table td ul".split())
#: Closed by the same tag, or by one of their group, if that comes first.
SIBLINGS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = BLOCK - frozenset("body html head li dd dt tr td th tbody thead tfoot caption option legend summary figcaption".split())
#: Words of class names and ids: with any others beside them; only alone or with plain ones; plain ones; and
#: those after which a name says the opposite.
MARKS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored sidebar navbar navigation breadcrumb breadcrumbs comment comments disqus cookie cookies gdpr newsletter".split())
SOFT_MARKS = frozenset("promo promotion banner menu nav respond replies consent notice notices subscribe share sharing social related popup modal footer header masthead widget toolbar pagination login signup search".split())
PLAIN = frozenset("area articles bar bottom box block col column container content group head holder inner item items left link links list main module outer page panel post posts region right row section site slot stories top unit wrap wrapper".split())
OPPOSITE = frozenset("has no not with without".split())
_MARKUP = re.compile("<[A-Za-z/!?]")
_NAME = re.compile("[A-Z]?[a-z]+|[A-Z]+")

#: What a line's score is multiplied by where an element votes: firmly, strongly, and weakly.
FIRM, STRONG, WEAK = 0.05, 0.1, 0.8


def named_vote(value: str) -> float:
    """The vote of a class attribute or an id."""
    vote = 1.0
    for name in value.split():
        words = [w.lower() for w in _NAME.findall(name)]
        if not words or words[0] in OPPOSITE:
            continue
        found = set(words)
        if found & MARKS or (found & SOFT_MARKS and found <= SOFT_MARKS | (PLAIN - {"post", "main", "head"})):
            return STRONG
        if found & SOFT_MARKS:
            vote = WEAK
    return vote


class Events(HTMLParser):
    """Lines of a page (text, link characters, tags, element) and its elements (tag,
    parent, vote)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, int]] = []  # tag, hidden here or above, block element
        self.open: Counter = Counter()
        self.elements: list[tuple[str, int, float]] = [("html", -1, 1.0)]
        self.parts: list[str] = []
        self.tags = self.links = self.in_link = 0
        self.lines: list[tuple[str, int, int, int]] = []
        self.hidden, self.at, self.ending = False, 0, False

    def cut(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.lines.append((text, min(self.links, len(text)), max(1, self.tags), self.at))
            self.parts = []
        self.tags = self.links = 0

    def _vote(self, tag: str, attrs) -> float:
        if tag in FIRM_TAGS:
            return FIRM
        vote = STRONG if tag == "form" or tag == "header" and not (self.open["article"] or self.open["main"]) else 1.0
        for name, value in attrs:
            if not value or tag in ("html", "body", "main"):
                continue
            if name in ("class", "id"):
                vote = min(vote, named_vote(value))
            elif name == "role":
                if value.lower() in FIRM_ROLES:
                    return FIRM
                if value.lower() in LOOSE_ROLES:
                    vote = STRONG
        return vote

    def _pop(self, at: int) -> None:
        for tag, _, _ in self.stack[at:]:
            self.open[tag] -= 1
        # a strong vote makes a line of its own of an inline element
        if self.at != (below := self.stack[at - 1][2] if at else 0):
            self.cut()
        del self.stack[at:]
        self.at = below
        self.hidden = self.stack[-1][1] if self.stack else False

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.parts.append(" ")
        elif tag in BLOCK:
            self.cut()
        self.tags += 1
        if tag in VOID:
            return
        if tag in CLOSES_P or tag in SIBLINGS:
            ends = SIBLINGS.get(tag, {"p"})
            if any(self.open[x] for x in ends):
                for i in range(len(self.stack) - 1, -1, -1):
                    name = self.stack[i][0]
                    if name in ends:
                        self._pop(i)
                        break
                    if name in BLOCK and name != "p":
                        break
        hidden = self.hidden or tag in HIDDEN or any(n == "hidden" or n == "style" and v and "display:none" in v.replace(" ", "").lower() for n, v in attrs) and tag not in ("html", "body")
        vote = self._vote(tag, attrs)
        if tag in BLOCK or vote <= STRONG:
            self.cut()
            self.elements.append((tag, self.at, vote))
            self.at = len(self.elements) - 1
        self.stack.append((tag, hidden, self.at))
        self.open[tag] += 1
        self.hidden = hidden

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # a slash has no meaning in HTML

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.cut()
        self.tags += 1
        if not self.open[tag]:
            return
        for i in range(len(self.stack) - 1, -1, -1):
            name = self.stack[i][0]
            if name == tag:
                self._pop(i)
                return
            if tag not in BLOCK and name in BLOCK and name != "p":
                return

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)
            if self.open["a"] > 0:
                self.links += len(data.strip())

    def parse_comment(self, i, report=True):
        # a comment without an end hides what follows it
        end = super().parse_comment(i, report)
        return len(self.rawdata) if end < 0 and self.ending else end

    def read(self, html: str):
        """All lines of a page. Markup that is still open behind the last ">" goes before
        the parser looks for its end from each of its places anew."""
        end = html.rfind(">") + 1
        self.feed(html[:end])
        tail = html[end:]
        found = _MARKUP.search(tail)
        self.ending = True
        self.feed(tail[: found.start()] if found else tail)
        return self.finish()

    def finish(self):
        self.close()
        self.cut()
        return self.lines


def smoothed(values: np.ndarray, place: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian means of the values around their places."""
    total, weights = values.copy(), np.ones(len(values))
    for k in range(1, min(int(np.ceil(3 * sigma)), len(values) - 1) + 1):
        near = np.exp(-((place[k:] - place[:-k]) ** 2) / (2 * sigma**2))
        total[k:] += near * values[:-k]
        total[:-k] += near * values[k:]
        weights[k:] += near
        weights[:-k] += near
    return total / weights


def threshold(scores: np.ndarray) -> float:
    """The cut that leaves the least variance inside the two clusters of scores."""
    own = np.sort(scores)
    n, total = len(own), own.sum()
    if n < 2 or own[0] == own[-1]:
        return float(own[0]) if n else 0.0
    low = np.cumsum(own)[:-1]
    k = np.arange(1, n)
    between = k * (n - k) * (low / k - (total - low) / (n - k)) ** 2
    between[own[1:] == own[:-1]] = -1
    i = int(np.argmax(between))
    return float(own[i] + own[i + 1]) / 2


def clusters(scores: np.ndarray, size: np.ndarray, best: float, share: float, gap: int = 2) -> np.ndarray:
    """Which lines are content: above the threshold, in runs (with up to ``gap`` other
    lines inside) that hold a share of the largest run's text."""
    content = scores >= min(threshold(scores), 0.5 * best)
    at = np.flatnonzero(content)
    if not len(at):
        return content
    run = np.cumsum(np.r_[0, np.diff(at) > gap + 1])
    mass = np.bincount(run, weights=size[at])
    content[at[(mass < share * mass.max())[run]]] = False
    return content


def _sums(values: np.ndarray, line_at: np.ndarray, parents: np.ndarray) -> np.ndarray:
    """Sums over each element's lines, those of elements in it included."""
    out = np.bincount(line_at, weights=values, minlength=len(parents)).tolist()
    for e in range(len(parents) - 1, 0, -1):  # a parent has a smaller number
        out[parents[e]] += out[e]
    return np.array(out)


def main_text(html: str, sigma: float = 1.0, border: float = 2.0, share: float = 0.1, most: float = 0.5, fair: float = 0.25, links: float = 0.75) -> str:
    events = Events()
    lines = events.read(html)
    if not lines:
        return ""
    tag = [x[0] for x in events.elements]
    parent = [x[1] for x in events.elements]
    n_elements = len(tag)
    at = np.array([x[3] for x in lines])
    size = np.array([len(x[0]) for x in lines], dtype=np.float64)
    linked = np.array([x[1] for x in lines], dtype=np.float64)
    tags = np.array([x[2] for x in lines], dtype=np.float64)
    box = [0] * n_elements
    for e in range(1, n_elements):
        box[e] = e if tag[e] in CONTAINER else box[parent[e]]
    boxes = np.array(box)[at]
    place = np.cumsum(np.r_[0.0, 1 + border * (boxes[1:] != boxes[:-1])])
    score = smoothed(np.sqrt((size - linked) / tags), place, sigma)

    def weights(votes: list[float]) -> np.ndarray:
        """The least vote at or above each element."""
        out = list(votes)
        for e in range(1, n_elements):
            out[e] = min(out[e], out[parent[e]])
        return np.array(out)

    def content_of(votes: list[float]):
        weight = weights(votes)[at]
        free = score[weight > STRONG]
        return clusters(score * weight, size, free.max(), share) if len(free) else np.zeros(len(lines), bool)

    votes = [x[2] for x in events.elements]
    content = content_of(votes)
    # votes that an element's share of the page speaks against
    text, mass = _sums(size, at, parent), _sums(size * content, at, parent)
    semantic = np.zeros(n_elements)
    for e in range(n_elements):
        semantic[e] = tag[e] in ("article", "main") and mass[e] > 0
    inside = semantic.copy()
    for e in range(n_elements - 1, 0, -1):
        inside[parent[e]] += inside[e]
    frames = [e for e in range(1, n_elements) if votes[e] == STRONG and text[e] > most * text[0] and inside[e] == inside[0] and mass[0] - mass[e] < fair * text[0]]
    if frames:
        for e in frames:
            votes[e] = 1.0
        content = content_of(votes)
        mass = _sums(size * content, at, parent)
    if not content.any():
        return ""

    # elements that go: voted against, and without a content line
    gone = [False] * n_elements
    for e in range(1, n_elements):
        gone[e] = gone[parent[e]] or votes[e] <= STRONG and mass[e] == 0
    whole = [e for e in range(n_elements) if tag[e] in ("article", "main") and mass[e] > 0 and not gone[e]]
    region = [False] * n_elements
    for e in whole:
        region[e] = True
    for e in range(1, n_elements):
        region[e] = region[e] or region[parent[e]]
    region_lines = np.array(region)[at]
    kept = ~np.array(gone)[at]
    if size[content & region_lines].sum() >= 0.5 * size[content].sum():
        kept &= region_lines
    else:
        first, last = np.flatnonzero(content)[[0, -1]]
        link_text, anchors = _sums(linked, at, parent), _sums((linked > 0).astype(float), at, parent)
        headed = _sums(np.array([tag[x] in ("h1", "h2") for x in at], dtype=float), at, parent)
        menu = [False] * n_elements
        for e in range(1, n_elements):
            menu[e] = menu[parent[e]] or box[e] == e and mass[e] == 0 and anchors[e] > 1 and link_text[e] >= links * text[e]
        order = np.arange(len(lines))
        kept &= ~np.array(menu)[at] & ((order >= first) & (order <= last) | (mass[boxes] > 0) | (headed[boxes] > 0))
    return "\n\n".join(lines[i][0] for i in np.flatnonzero(kept))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches, "html"):
        texts = [main_text(h) for h in part.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    bounded_batches(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
