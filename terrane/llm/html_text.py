"""Main text of web pages: flat text blocks, described with their neighbours, judged by a decision tree."""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, table

by_value(__name__)

# Fixed values of HTML: elements whose content is no text of the page, that break blocks, that are void, and that hold others.
SKIPPED = set("script style noscript template textarea title iframe svg math select button object canvas audio video head".split())
BREAKING = set(
    "address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HOLDING = set("address article aside blockquote body details dialog div dl fieldset figure footer form header main nav ol section table ul".split())
ASIDE = set("nav footer aside form dialog".split())
#: Skipped elements that hold raw text, so without an end tag they reach the end of the page.
RAW = set("script style textarea title".split())
#: What may stand in a head; any other start tag ends it.
IN_HEAD = set("title base basefont bgsound link meta script style template noscript noframes".split())
#: Containers whose class says what the page or the article is like, not that they are something else.
WHOLE = set("html body main article".split())
#: Parts of a class, id or role that name what is not the article.
HINT = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|sidebar|widget\w*|menu\w*|nav\w*|breadcrumbs?|comments?|reply|replies|respond|disqus|cookies?|consent|gdpr|notice|alert|popup|modal|newsletter|subscribe|signup|login|related|recommend\w*|share|sharing|social|footer|header|masthead|copyright|pagination|pager|toolbar|search|tags)(?:$|[\s_-])",
    re.I,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
#: A tag: quotes hold a `>` only as a value, after `=`. A tag whose quotes never close ends at its first `>`.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^=>]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
OPEN = re.compile(r"</?[a-zA-Z]")
#: Comments, declarations and what else is no tag; its second group is None.
OTHER = re.compile(r"<!--|<[!?/][^>]*>")

# The small labelled table: words and link density of a block, of the one before and of the one after, whether a container
# sets it aside, whether it is in an article or main element, whether the page has one, whether it is a heading; 1: main text.
FEATURES = "words links before_words before_links after_words after_links aside inside page_has heading".split()
LABELLED = """
5 1.0 0 0.0 1 1.0 1 0 1 0 0
1 1.0 1 1.0 2 1.0 1 0 1 0 0
1 1.0 1 1.0 14 0.0 1 0 0 0 0
12 0.0 1 1.0 9 0.0 1 0 1 0 0
18 0.0 1 1.0 11 0.0 1 0 0 0 0
40 0.0 12 0.0 90 0.0 1 0 0 0 0
70 0.0 60 0.0 10 0.0 1 0 1 0 0
10 0.0 12 0.0 85 0.0 0 1 1 1 1
3 0.0 10 0.0 60 0.0 0 1 1 1 1
11 0.0 1 1.0 40 0.0 0 1 1 1 1
85 0.0 10 0.0 60 0.0 0 1 1 0 1
1 0.0 80 0.0 120 0.0 0 1 1 0 1
2 0.0 5 0.0 15 0.0 0 1 1 0 1
4 0.0 30 0.0 7 0.0 0 1 1 0 1
30 0.1 60 0.0 1 0.0 0 1 1 0 1
20 0.4 60 0.0 50 0.1 0 1 1 0 1
6 1.0 60 0.0 50 0.1 0 1 1 0 1
8 0.0 40 0.0 6 0.0 0 1 1 0 1
15 0.0 9 0.0 0 0.0 0 1 1 0 1
25 0.0 30 0.0 45 0.0 1 1 1 0 0
4 0.5 30 0.0 20 0.0 1 1 1 0 0
9 0.0 85 0.0 22 0.0 1 1 1 0 0
6 0.0 60 0.0 30 0.0 1 1 1 1 0
50 0.0 7 0.0 9 0.0 1 1 1 0 0
3 1.0 3 1.0 4 1.0 0 0 1 0 0
7 0.2 50 0.0 0 0.0 0 0 1 0 0
30 0.0 20 0.0 20 0.0 0 0 1 0 0
90 0.0 40 0.0 6 0.0 0 0 1 0 0
5 0.0 2 1.0 12 0.0 0 0 1 1 0
2 0.0 90 0.0 12 0.0 0 0 1 0 0
8 0.0 1 1.0 70 0.0 0 0 0 1 1
4 0.0 70 0.0 50 0.0 0 0 0 1 1
9 0.0 3 0.8 25 0.1 0 0 0 1 1
5 0.0 30 0.5 2 1.0 0 0 0 1 0
3 0.0 4 1.0 3 1.0 0 0 0 1 0
60 0.0 8 0.0 45 0.0 0 0 0 0 1
35 0.05 70 0.0 6 0.6 0 0 0 0 1
25 0.1 8 0.0 30 0.0 0 0 0 0 1
18 0.0 40 0.0 35 0.0 0 0 0 0 1
12 0.0 60 0.0 55 0.0 0 0 0 0 1
6 0.0 45 0.0 80 0.0 0 0 0 0 1
9 0.0 70 0.0 3 1.0 0 0 0 0 1
2 1.0 2 1.0 3 1.0 0 0 0 0 0
4 0.9 60 0.0 3 1.0 0 0 0 0 0
12 0.8 30 0.0 15 0.7 0 0 0 0 0
30 0.7 9 0.9 25 0.8 0 0 0 0 0
6 0.0 2 1.0 3 1.0 0 0 0 0 0
7 0.3 3 1.0 0 0.0 0 0 0 0 0
5 0.0 4 1.0 0 0.0 0 0 0 0 0
8 0.0 3 0.9 9 0.9 0 0 0 0 0
"""


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8):
    """A decision tree: a share of ones, or (feature, threshold, tree for <=, tree for >), by least Gini impurity."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return share
    best = None
    for f in range(x.shape[1]):
        for a, b in zip(v := np.unique(x[:, f]), v[1:]):
            left = x[:, f] <= (a + b) / 2
            impurity = sum(m.sum() * y[m].mean() * (1 - y[m].mean()) for m in (left, ~left))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, (a + b) / 2, left)
    if best is None:
        return share
    _, f, at, left = best
    return (f, at, grow(x[left], y[left], depth - 1), grow(x[~left], y[~left], depth - 1))


def train(labelled: str = LABELLED):
    rows = np.array([r.split() for r in labelled.strip().splitlines()], dtype=float)
    return grow(rows[:, :-1], rows[:, -1])


def judge(tree, x) -> float:
    while isinstance(tree, tuple):
        f, at, low, high = tree
        tree = low if x[f] <= at else high
    return tree


class Markup:
    """The tags and other markup of a page in order. Each character is looked at a bounded number of times."""

    def __init__(self, page: str):
        self.page, self.last, self.tag = page, page.rfind(">"), TAG
        self.ends: dict[str, int] = {}  # where the next end tag of an element ends, -1: there is none

    def next(self, at: int):
        """The next match from `at` on: of a tag (groups: slash, name, attributes) or of something else (no groups); None: there is none."""
        while 0 <= (at := self.page.find("<", at)) < self.last:
            m = self.tag.match(self.page, at)
            if m is None and OPEN.match(self.page, at):  # its quotes do not close on this page, nor do others have to
                self.tag = LOOSE
                m = LOOSE.match(self.page, at)
            if m := m or OTHER.match(self.page, at):
                return m
            at += 1
        return None

    def end_of(self, name: str, at: int) -> int:
        """Where the element's next end tag from `at` on ends, -1: there is none."""
        if name not in self.ends or 0 <= self.ends[name] < at:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(self.page, at)
            self.ends[name] = -1 if end is None else end.end()
        return self.ends[name]


def blocks(page: str) -> list[tuple[str, float, bool, bool, bool]]:
    """(text, link density, set aside, inside article or main, heading) of a page's text blocks in order."""
    out, text, linked, links, heading = [], [], 0, 0, False
    holders: list[tuple[str, bool, bool]] = []  # name, sets aside, is or is in an article
    at, n = 0, len(page)
    markup = Markup(page)

    def flush():
        nonlocal text, linked
        raw = html.unescape("".join(text))
        words = raw.split()
        if words:
            aside, inside = (holders[-1][1], holders[-1][2]) if holders else (False, False)
            out.append((" ".join(words), min(1.0, linked / len(words)), aside, inside, heading))
        text, linked = [], 0

    def add(s: str):
        nonlocal linked
        text.append(s)
        if links:
            linked += len(s.split())

    while at < n:
        m = markup.next(at)
        if m is None:
            rest = page[at:]
            cut = rest.rfind("<")
            if cut >= 0 and re.match(r"<[a-zA-Z/!?]", rest[cut:]):  # a page that ends inside a tag
                rest = rest[:cut]
            add(rest)
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m.group() == "<!--":
            end = page.find("-->", at)
            at = n if end < 0 else end + 3
            continue
        if not m.re.groups:
            continue
        close, name, attributes = m.group(1), m.group(2).lower(), m.group(3)
        if name in SKIPPED and not close and not attributes.endswith("/"):
            if name in BREAKING or name in ("head", "title"):
                flush()
            if name == "head":
                at = _after_head(markup, at)
                continue
            if (end := markup.end_of(name, at)) >= 0:
                at = end
            elif name in RAW:
                at = n
            continue
        if name == "br":
            text.append(" ")
        elif name == "a":
            links = 0 if close else 1
        elif name in BREAKING:
            flush()
            heading = not close and len(name) == 2 and name[0] == "h" and name[1].isdigit()
            if name in HOLDING:
                if close:
                    if any(h[0] == name for h in holders):
                        while holders.pop()[0] != name:
                            pass
                        links = 0
                elif not attributes.endswith("/"):
                    aside, inside = (holders[-1][1], holders[-1][2]) if holders else (False, False)
                    own = name in ASIDE or name == "header" and not inside or _set_aside(attributes, name not in WHOLE)
                    holders.append((name, aside or own, inside or name in ("article", "main")))
    flush()
    return out


def _after_head(markup: Markup, at: int) -> int:
    """Where a head ends that begins before `at`: after its end tag, or before the first start tag that cannot be in it."""
    page, n = markup.page, len(markup.page)
    while at < n:
        m = markup.next(at)
        if m is None:
            return n if not page[at:].strip() else at
        if page[at : m.start()].strip():  # text ends a head too
            return at
        at = m.end()
        if m.group() == "<!--":
            end = page.find("-->", at)
            at = n if end < 0 else end + 3
        elif m.re.groups:
            close, name = m.group(1), m.group(2).lower()
            if close and name == "head":
                return at
            if not close and name not in IN_HEAD:
                return m.start()
            if not close and name in SKIPPED and not m.group(3).endswith("/"):
                end = markup.end_of(name, at)
                at = end if end >= 0 else n if name in RAW else at
    return n


def _set_aside(attributes: str, hints: bool = True) -> bool:
    """Whether an element is hidden or (if its names are hints) named as something other than the article."""
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        value, name = a or b or c, name.lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
        if hints and name in ("class", "id", "role") and HINT.search(value):
            return True
    return False


def main_text(page: str, tree) -> str:
    found = blocks(page)
    size = [(len(b[0].split()), b[1]) for b in found]
    has = float(any(b[3] for b in found))
    kept = []
    for k, (text, links, aside, inside, heading) in enumerate(found):
        # an article's blocks have their neighbours in the article
        before = size[k - 1] if k and found[k - 1][3] >= inside else (0, 0.0)
        after = size[k + 1] if k + 1 < len(size) and found[k + 1][3] >= inside else (0, 0.0)
        if judge(tree, (size[k][0], links, *before, *after, aside, inside, has, heading)) >= 0.5:
            kept.append(text)
    return "\n\n".join(kept)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page's whole html: one row per input row.

    The tree is grown on the labelled table above. Null html counts as empty; a
    page without main text has the empty string. Null ids and urls stay null;
    repeated rows are rows like others. An empty table gives no rows; other
    columns are ignored.
    """
    slim = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    tree = train()

    def batches(it):
        for b in it:
            texts = [main_text(p, tree) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in slim.schema}
    return slim.mapInArrow(batches, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")


def op8(spark, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
