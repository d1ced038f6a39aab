"""Main text of web pages by tree scoring.

A page becomes a tree of block elements; subtrees that are furniture by tag, role or class (menus, headers, footers, sidebars,
notices, adverts, forms, comments) are left out; a header inside an article is the article's own and stays. A class or id alone does not drop an element that holds ``main``, the page's
largest article or nearly all of its text: such names also stand on wrappers. Inside the main element or the largest article, names that
an article's own parts may have too (header, side, social, ...) drop no heading, no paragraph and nothing that holds a heading, but
what is full of links or short. Every block of text passes points for its length and its commas to its ancestors,
fewer with each level; an element's points are discounted by the share of its text that stands in links. The best element, its
enclosing article if there is one, and siblings with enough points of their own are the main text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import map_arrow, pick, text_list

# HTML element names by role.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
SKIPPED = frozenset("script style noscript template iframe object svg math canvas textarea title select".split())
FURNITURE = frozenset("head nav header footer aside form menu dialog button fieldset".split())
ROLES = frozenset("navigation banner complementary contentinfo search dialog alert alertdialog form menu menubar toolbar".split())
NEVER_BY_CLASS = frozenset("html body article main".split())
CLASSES = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial sponsor sponsored sponsors promo promos promotion banner sidebar side aside nav navbar navigation menu menus topbar toolbar breadcrumb breadcrumbs "
    "header masthead footer foot colophon copyright comment comments commentlist respond replies reply disqus discussion cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal "
    "overlay share sharing social related recommended recommendations newsletter subscribe subscription signup login search pagination pager widget widgets skip outbrain taboola hidden".split()
)
#: Of these, names that parts of an article's own text have too.
WEAK = frozenset("side aside banner header masthead foot footer copyright social promotion alert alerts notice notices notification notifications discussion related hidden search skip".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCKS - frozenset("html body head".split())
BONUS = {"article": 30.0, "main": 25.0, "section": 5.0, "div": 5.0, "td": 3.0, "blockquote": 3.0, "pre": 3.0, "ul": -3.0, "ol": -3.0, "li": -3.0, "dl": -3.0, "address": -3.0}
#: An open element of the first kind ends where one of the second kind begins, up to an element of the third kind.
SAME_LEVEL = {"li": ("li", "ul ol menu"), "dd": ("dd dt", "dl"), "dt": ("dd dt", "dl"), "tr": ("tr td th", "table tbody thead tfoot"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "tbody": ("tbody thead tfoot tr td th", "table"), "thead": ("tbody thead tfoot tr td th", "table"), "tfoot": ("tbody thead tfoot tr td th", "table")}
SAME_LEVEL_SETS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in SAME_LEVEL.items()}
NO_LEVELS: tuple[frozenset[str], frozenset[str]] = (frozenset(), frozenset())
LEVELS = 6
#: Shares of a page's text outside links: an element with so much is no furniture by name, nor one around an article with so much.
NEARLY_ALL, ARTICLE_SHARE = 0.8, 0.25
#: An element with a weak name inside the article goes where links are so much of its text, or it is so short and holds no heading.
LINKED_SHARE, SHORT = 0.4, 150

TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*>?|/([a-zA-Z][^\s/>]*)[^>]*>?|([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z))""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def is_furniture(tag: str, attributes: str) -> bool:
    """Whether an element is left out with all that it holds."""
    if tag in FURNITURE:
        return True
    if not attributes or attributes.isspace():
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            return tag not in ("html", "body")
        if name == "role" and value.lower() in ROLES:
            return True
        if name in ("class", "id") and tag == "article" and re.search(r"comment|reply", value, re.I):
            return True
    return False


def is_named_furniture(tag: str, attributes: str) -> int:
    """Whether a word of an element's class or id says that it is furniture: 2, or 1 where all such words are weak, else 0."""
    if tag in NEVER_BY_CLASS or not attributes or attributes.isspace():
        return 0
    values = (m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes) if m[1].lower() in ("class", "id"))
    found = {p.lower() for value in values for p in NAME_PARTS.findall(value)} & CLASSES
    return 0 if not found else 2 if found - WEAK else 1


class Page:
    """Block elements of one page and its blocks of text, in page order."""

    def __init__(self, source: str):
        self.tags, self.parents, self.dropped, self.named = ["#root"], [-1], [False], [0]
        self.blocks: list[tuple[str, int, int, int]] = []  # text, element, characters in links, links
        self._parse(source)
        if any(self.named):
            self._drop_named()

    def _drop_named(self) -> None:
        """Drop what is furniture by name, except around the main text."""
        n = len(self.tags)
        free, linked, heads = [0] * n, [0] * n, [tag in HEADINGS for tag in self.tags]
        holds = [tag == "main" and not out for tag, out in zip(self.tags, self.dropped, strict=True)]
        for text, at, in_links, _ in self.blocks:
            free[at] += len(text) - in_links
            linked[at] += in_links
        for i in range(n - 1, 0, -1):  # children come after their parents
            free[self.parents[i]] += free[i]
            linked[self.parents[i]] += linked[i]
            heads[self.parents[i]] |= heads[i]
        article = max((i for i in range(n) if self.tags[i] == "article" and not self.dropped[i]), key=lambda i: (free[i], -i), default=0)
        holds[article] |= article > 0 and free[article] >= ARTICLE_SHARE * free[0]
        inside = list(holds)
        for i in range(n - 1, 0, -1):
            holds[self.parents[i]] |= holds[i]
        for i in range(1, n):
            inside[i] |= inside[self.parents[i]]
            named = self.named[i] and not holds[i] and free[i] < NEARLY_ALL * free[0]
            if named and self.named[i] == 1 and inside[i]:
                own = self.tags[i] == "p" or heads[i] or free[i] >= SHORT
                named = linked[i] > LINKED_SHARE * (free[i] + linked[i]) or not own
            self.dropped[i] = self.dropped[i] or self.dropped[self.parents[i]] or named
        self.blocks = [b for b in self.blocks if not self.dropped[b[1]]]

    def _parse(self, source: str) -> None:
        stack = [0]
        run: list[str] = []
        linked, links, in_link = 0, 0, False
        still = Counter(["#root"])  # open elements by tag: what is not open is not looked for on the stack
        unclosed: set[str] = set()  # tags without an end tag from here on

        def leave(k: int) -> None:
            still.subtract(self.tags[i] for i in stack[k:])
            del stack[k:]

        def end_of(tag: str, at: int) -> int | None:
            end = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(source, at)
            if not end:
                unclosed.add(tag)
            return end.end() if end else None

        def flush() -> None:
            nonlocal linked, links
            if run:
                text = " ".join(html.unescape("".join(run)).split())
                if text:
                    self.blocks.append((text, stack[-1], min(linked, len(text)), links))
                run.clear()
            linked = links = 0

        def text(part: str) -> None:
            nonlocal linked
            if part and not self.dropped[stack[-1]]:
                run.append(part)
                if in_link:
                    linked += len(part.strip())

        at, n = 0, len(source)
        while at < n:
            m = TAG.search(source, at)
            if not m:
                text(source[at:])
                break
            text(source[at : m.start()])
            at = m.end()
            closed, opened = m[1], m[2] or m[4]
            if opened:
                tag, attributes = opened.lower(), m[3] if m[2] else m[5]
                if tag in SKIPPED:
                    if not attributes.endswith("/"):
                        end = end_of(tag, at)
                        at = n if end is None else end
                    run.append(" ")
                elif tag == "a":
                    in_link = True
                    links += 1
                elif tag in BLOCKS:
                    flush()
                    in_link = False
                    if tag in CLOSES_P and "p" in (self.tags[i] for i in stack[-3:]):
                        leave(len(stack) - 1 - [self.tags[i] for i in stack[:-4:-1]].index("p"))
                    if tag != "head" and self.tags[stack[-1]] == "head":
                        leave(len(stack) - 1)
                    ends, stops = SAME_LEVEL_SETS.get(tag, NO_LEVELS)
                    if any(still[t] for t in ends):
                        k = len(stack) - 1
                        while k > 0 and self.tags[stack[k]] not in ends and self.tags[stack[k]] not in stops:
                            k -= 1
                        if self.tags[stack[k]] in ends:
                            while k > 1 and self.tags[stack[k - 1]] in ends:
                                k -= 1
                            leave(k)
                    if tag == "hr" or (tag in ("html", "body") and still[tag]):
                        continue
                    self.tags.append(tag)
                    self.parents.append(stack[-1])
                    own_header = tag == "header" and still["article"] > 0
                    self.dropped.append(self.dropped[stack[-1]] or is_furniture("div" if own_header else tag, attributes))
                    self.named.append(is_named_furniture(tag, attributes))
                    stack.append(len(self.tags) - 1)
                    still[tag] += 1
                elif tag in ("br", "img", "wbr", "input"):
                    run.append(" " if tag != "wbr" else "")
                elif tag == "button":
                    at = end_of(tag, at) or at
            elif closed:
                tag = closed.lower()
                if tag == "a":
                    in_link = False
                elif tag in BLOCKS:
                    k = len(stack) - 1 if still[tag] else 0
                    while k > 0 and self.tags[stack[k]] != tag:
                        k -= 1
                    flush()
                    if k > 0 and tag not in ("body", "html"):
                        leave(k)
                        in_link = False
        flush()

    def main_text(self) -> list[str]:
        """Blocks of the best element and of the siblings that go with it."""
        n = len(self.tags)
        points, chars, linked = [0.0] * n, [0] * n, [0] * n
        own: list[list[int]] = [[] for _ in range(n)]
        for b, (text, at, in_links, _) in enumerate(self.blocks):
            own[at].append(b)
            chars[at] += len(text)
            linked[at] += in_links
            gain = (1.0 + text.count(",") + text.count("、") + min(len(text) / 100, 3.0)) * (1 - in_links / len(text))
            if len(text) < 25:
                gain *= 0.2
            up = self.parents[at] if self.tags[at] in ("p", "li", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "td", "dd", "dt", "blockquote") else at
            for level in range(LEVELS):
                if up < 0:
                    break
                points[up] += gain / (1, 2, 6, 9, 12, 15)[level]
                up = self.parents[up]
        for i in range(n - 1, 0, -1):  # children come after their parents
            chars[self.parents[i]] += chars[i]
            linked[self.parents[i]] += linked[i]
        score = [0.0] * n
        for i in range(n):
            if points[i] > 0 and not self.dropped[i]:
                score[i] = (points[i] + max(BONUS.get(self.tags[i], 0.0), -0.5 * points[i])) * (1 - linked[i] / max(chars[i], 1))
        best = max(range(n), key=lambda i: (score[i], -i), default=0)
        if not self.blocks or score[best] <= 0:
            return [b[0] for b in self.blocks if b[2] < len(b[0])]
        up = best
        while up > 0:
            if self.tags[up] in ("article", "main"):
                best = up
                break
            up = self.parents[up]
        while self.tags[best] not in ("article", "main"):  # what stands around the best element, if that is most of it and no list of links
            up = self.parents[best]
            if up <= 0 or self.tags[up] in ("html", "body") or chars[best] < 0.5 * chars[up] or linked[up] > 0.3 * chars[up]:
                break
            best = up
        keep = [False] * n
        keep[best] = True
        for i in range(1, n):
            if i != best and self.parents[i] == self.parents[best] and chars[i]:
                dense = linked[i] / chars[i]
                paragraph = self.tags[i] == "p" and chars[i] >= 80 and dense < 0.25
                if score[i] >= max(10.0, 0.2 * score[best]) and self.tags[i] not in ("ul", "ol") or paragraph or self.tags[i] == "h1":
                    keep[i] = True
        links = [0] * n
        for _, at, _, many in self.blocks:
            links[at] += many
        for i in range(n - 1, 0, -1):
            links[self.parents[i]] += links[i]
        listing = [self.tags[i] in ("ul", "ol", "div", "table") and links[i] >= 3 and linked[i] > 0.6 * max(chars[i], 1) for i in range(n)]
        first, last = {}, {}
        for i in range(1, n):
            if self.tags[i] == "p" and chars[i] > 2 * linked[i]:
                first.setdefault(self.parents[i], i)
                last[self.parents[i]] = i
        for i in range(1, n):
            p = self.parents[i]
            between = self.tags[i] in ("ul", "ol") and first.get(p, n) < i < last.get(p, 0)  # a list between paragraphs is text
            keep[i] = (keep[i] or keep[p]) and not (listing[i] and not between and i != best)
        return [text for text, at, _, _ in self.blocks if keep[at]]


def main_text(source: str | None) -> str:
    """The main text of a page: blocks joined by line feeds; empty if there is none."""
    return "\n".join(Page(source).main_text()) if source else ""


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x) for x in text_list(batch.column(2))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), one row per page. Null or empty html: empty text. Null ids and urls pass through. Repeated
    rows each give a row; of elements with equal scores the first in page order is the best; other columns are ignored; an empty table gives none. The whole source is read, nothing is cut off."""
    base = pick(pages, page_id=id_col, url=url_col, html=html_col)
    return map_arrow(base.withColumn("page_id", base.page_id.cast("long")), _extract, "page_id long, url string, text string, n_chars long")
