"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each run of text between block-level tags. Hints lower a line's weight, which is
its length otherwise: lines in menus, page headers, footers, sidebars, notices, adverts, forms or reader comments (by
element, role, class or id) and lines that are mostly links weigh nothing; where the page has article or main elements,
lines outside the one with most text weigh a `FAR`th and are looked at by themselves. The weights are summed over windows
of `WINDOW` lines: text surges where a window reaches the threshold (`SURGE`, or half of the page's largest window if that
is less) and dives where a window is empty. All text from the first line before a surge that is joined to it down to the
dive is kept, as are lines of the same element that a notice in between cut off.

Each page is read by itself, in one pass over its whole html; nothing is shuffled.

Defined cases: null or empty html gives an empty text; broken, unclosed or stray tags are read as far as they go; a page
without any countable line gives an empty text; repeated pages each get a row; columns with other names are ignored.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrail.llm.common import as_long, read_table

WINDOW = 3
SURGE = 86
FAR = 16
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>", re.S)
HINT = re.compile(r"\b(class|id|role|style|aria-hidden|hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
RAW = frozenset("script style template noscript iframe svg math object canvas audio video title textarea select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FLOW = frozenset("h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table tbody thead tfoot tr td th figure figcaption caption".split())
OUTSIDE = frozenset("nav footer aside form menu dialog button fieldset".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar toolbar".split())
BAD_NAMES = frozenset(
    """ad ads advert adverts advertisement advertising adsense alert banner breadcrumb breadcrumbs captcha comment comments consent
    cookie cookies copyright dialog disclaimer disqus footer gdpr header hidden legal login masthead menu modal nav navbar navigation
    newsletter notice notices notification overlay pager pagination paywall popup promo promoted promotion recommended register related
    replies reply respond search share sharing sidebar signin signup skip social sponsor sponsored subscribe subscription tags toolbar
    widget widgets""".split()
)
GOOD_NAMES = frozenset("article content entry post story body text".split())
READERS = frozenset("comment comments disqus replies reply respond".split())
RIGHTS = re.compile(r"^\s*(©|\(c\)\s|copyright\b)|all rights reserved", re.I)


@dataclass
class Line:
    text: str
    links: int
    outside: bool
    inner: bool  # outside, if only elements within the article or main element count
    root: int
    in_main: bool
    box: int = 0  # the element around it


@dataclass
class _Open:
    name: str
    outside: bool
    inner: bool
    root: int
    main: bool
    box: int


@dataclass
class _State:
    stack: list[_Open] = field(default_factory=list)
    lines: list[Line] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    link_parts: list[str] = field(default_factory=list)
    in_link: bool = False
    roots: int = 0
    boxes: int = 0

    def top(self) -> _Open:
        return self.stack[-1] if self.stack else _Open("", False, False, 0, False, 0)

    def end_line(self) -> None:
        text = " ".join(entities.unescape("".join(self.parts)).split())
        if text:
            links = len(" ".join(entities.unescape("".join(self.link_parts)).split()))
            now = self.top()
            self.lines.append(Line(text, links, now.outside, now.inner, now.root, now.main, now.box))
        self.parts, self.link_parts = [], []

    def add(self, text: str) -> None:
        self.parts.append(text)
        if self.in_link:
            self.link_parts.append(text)


def _is_outside(name: str, attrs: str, within: _Open) -> bool:
    if name in ("html", "body", "main"):
        return False
    if name in OUTSIDE or (name == "header" and not (within.root or within.main)):
        return True
    if not attrs:
        return False
    for key, value in HINT.findall(attrs):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if key == "role" and value in BAD_ROLES:
            return True
        if key in ("class", "id"):
            for one in value.split():
                words = set(re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", one)))
                bad = words & BAD_NAMES if name != "article" or one in BAD_NAMES else words & READERS
                if bad and not (bad == {"header"} and (within.root or within.main or words & GOOD_NAMES)):
                    return True
    return False


def lines_of(page: str) -> list[Line]:
    """The page's text lines, with what is known of each."""
    s, at = _State(), 0
    for m in iter(lambda: TAG.search(page, at), None):
        if m.start() > at:
            s.add(page[at : m.start()])
        at = m.end()
        closing, name, attrs = m.group(1), (m.group(2) or "").lower(), m.group(3) or ""
        if not name:
            continue
        if name in RAW and not closing and not attrs.rstrip().endswith("/"):
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            if name not in INLINE:
                s.end_line()
            continue
        if name == "a":
            s.in_link = not closing
        if name in INLINE:
            continue
        s.end_line()
        if name in VOID:
            continue
        if closing:
            for i in range(len(s.stack) - 1, -1, -1):
                if s.stack[i].name == name:
                    del s.stack[i:]
                    break
            s.in_link = False
        elif name != "p":
            now = s.top()
            root, main, hint = now.root, now.main or name == "main", _is_outside(name, attrs, now)
            begins = name == "main" and not now.main or name == "article" and not root and not hint
            if name == "article" and begins:
                s.roots += 1
                root = s.roots
            s.boxes += 1
            s.stack.append(_Open(name, now.outside or hint, hint or (now.inner and not begins), root, main, now.box if name in FLOW else s.boxes))
    s.add(page[at:])
    s.end_line()
    return s.lines


def _rights(x: Line) -> bool:
    """A line of rights reserved, where no element says that it is part of the article."""
    return not x.root and not x.in_main and bool(RIGHTS.search(x.text))


def _settle(lines: list[Line]) -> None:
    """Where an article or main element holds most of the text but stands in an element that looks like a menu or notice,
    what is around it says nothing about its lines."""
    free = sum(len(x.text) for x in lines if not x.outside)
    held: dict[tuple, int] = {}
    for x in lines:
        if (x.root or x.in_main) and not x.inner:
            held[x.root, x.in_main] = held.get((x.root, x.in_main), 0) + len(x.text)
    if held and max(held.values()) > 2 * free:
        best = max(held, key=held.get)
        for x in lines:
            if (x.root, x.in_main) == best:
                x.outside = x.inner


def weights(lines: list[Line]) -> tuple[list[int], list[int]]:
    """Weight of each line as part of the main element (of the page if it has none), and of each other line."""
    base = [0 if x.outside or 2 * x.links > len(x.text) or _rights(x) else len(x.text) for x in lines]
    mass: dict[int, int] = {}
    for x, w in zip(lines, base):
        if x.root:
            mass[x.root] = mass.get(x.root, 0) + w
    if any(mass.values()):
        best = max(mass, key=lambda r: (mass[r], -r))
        own = [x.root == best for x in lines]
    elif any(w for x, w in zip(lines, base) if x.in_main):
        own = [x.in_main for x in lines]
    else:
        return base, [0] * len(lines)
    return [w if o else 0 for w, o in zip(base, own)], [0 if o else w // FAR for w, o in zip(base, own)]


def window_sums(weight: list[int], window: int = WINDOW) -> list[int]:
    """Sums over the window that begins at each line."""
    total = [0]
    for w in weight:
        total.append(total[-1] + w)
    n = len(weight)
    return [total[min(n, i + window)] - total[i] for i in range(n)]


def surges(weight: list[int], need: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Line ranges from a surge to its dive."""
    n, sums = len(weight), window_sums(weight, window)
    out, i = [], 0
    while i < n:
        if not weight[i]:
            i += 1
            continue
        j = i
        while j < n and sums[j]:  # up to the first empty window
            j += 1
        if max(sums[i:j]) >= need:
            out.append((i, j))
        i = j
    return out


def main_text(page: str | None) -> str:
    """The article of a page: its blocks joined by newlines."""
    lines = lines_of(page or "")
    _settle(lines)
    near, far = weights(lines)
    most = max(window_sums(near), default=0)
    if not most:
        return ""
    need = min(SURGE, most / 2)
    kept: set[int] = set()
    for weight in (near, far):
        parts = surges(weight, need)
        rest = {x.box for i, j in parts for x, w in zip(lines[i:j], weight[i:j]) if w}
        # lines that weigh nothing for their links stay where they stand in the text; so do lines of an element that is kept
        kept |= {k for i, j in parts for k in range(i, j) if weight[k] or weight is near and _linked(lines[k], rest)}
        kept |= {k for k, w in enumerate(weight) if w and lines[k].box in rest}
    return "\n".join(lines[k].text for k in sorted(kept))


def _linked(x: Line, boxes: set[int]) -> bool:
    return not x.outside and not _rights(x) and x.box in boxes


def _extract(batches):
    for batch in batches:
        texts = [main_text(x) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    rows = pages.select(as_long(pages, page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op3_line_blocks(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(read_table(spark, sf_dir, "pages"))
