"""Main text of web pages by line-block distribution.

Markup is stripped to one line for each block.  Lines of menus, adverts, forms
and other page furniture weigh nothing, other lines weigh their text outside
links.  Inside an article or main element links weigh too; the element decides
nothing else.  The weights summed over a sliding window of lines show where the
text surges and where it dives; everything from the first surge to the last
dive is kept, short and link-only lines included, and so are the lines before
and after it in the same group (div, section, ...).

Null or empty html, or html without text: empty text.  Broken markup is read
leniently: unclosed elements end with their parent, and furniture that was
never closed ends where an article or main element begins; only script, style,
textarea and title are raw text and read on to the end of the page.  Formulas
are text.  Long pages are read whole.  Repeated rows give repeated rows; an empty
table gives an empty result; columns other than page_id, url and html are
ignored, whatever their names.
"""

from __future__ import annotations

import html
import os.path
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import frugal, small_batches

SCHEMA = "page_id long, url string, text string, n_chars long"
#: Lines in a sliding window, and the share of the largest window sum at which text surges.
WINDOW, SURGE = 3, 0.2

#: Elements whose content is raw text up to their end tag, and those whose content is no text of the page.
RAW = frozenset("script style textarea title".split())
EMBEDDED = frozenset("noscript template iframe svg object select datalist optgroup option".split())
FURNITURE = frozenset("nav header footer aside form button dialog menu fieldset label input".split())
#: What a head may hold; any other element ends it.
HEAD = RAW | frozenset("head base basefont bgsound link meta noscript template".split())
BLOCKS = frozenset("address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Whole class, id and role names that mark page furniture, on these elements only.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toc sidebar aside complementary masthead header topbar footer contentinfo copyright "
    "comment comments commentlist discussion disqus replies respond share sharing social related recommended recommendations newsletter subscribe subscription signup login search searchbox widget widgets skip tags "
    "ad-banner ad-container ad-slot ad-unit ad-wrapper google-ad top-ad cookie-notice cookie-banner cookie-bar cookie-consent cookie-popup gdpr-banner gdpr-notice consent-banner alert-box "
    "main-nav main-menu main-navigation nav-bar nav-menu nav-links site-nav site-navigation top-nav top-menu top-bar side-nav side-bar side-menu left-sidebar right-sidebar sidebar-left "
    "site-header page-header site-footer page-footer footer-links footer-nav copyright-notice comment-list comment-form comments-area comments-section user-comments disqus_thread "
    "share-bar share-buttons share-links social-links social-icons social-media social-share related-articles related-links related-posts related-stories recommended-articles "
    "newsletter-signup newsletter-form login-form search-box search-form search-bar tag-list sidebar-widget widget-area skip-link skip-links".split()
)
CONTAINERS = frozenset("article aside center details dialog div dl fieldset figure footer form header ins menu nav ol section table ul".split())
#: Elements that group the lines of one text.
GROUPS = frozenset("article div form main section td".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)/?>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>", re.S)
_NAMED = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
#: The slash that ends an element where it begins, and not a value without quotes.
_EMPTY = re.compile(r"(?:^|[\s\"'])/$")

#: How an element is furniture: not at all, unless it holds most of the page, always.
NO, MAYBE, YES = 0, 1, 2


def _furniture(tag: str, attributes: str, in_article: bool) -> int:
    if tag in ("html", "body", "main"):
        return NO
    found = NO
    if tag in FURNITURE and not (tag == "header" and in_article):
        found = MAYBE if tag == "form" else YES
    for name, *values in _NAMED.findall(attributes) if attributes else ():
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return YES
        if name in ("class", "id", "role") and tag in CONTAINERS:
            named = NAMES.intersection(value.split())
            if tag == "article":
                named &= {"comment", "comments", "related", "ad", "advert", "promo", "sponsored"}
            if in_article:
                named -= {"header", "banner", "masthead"}
            if named:
                found = max(found, MAYBE)
    return found


class Line(NamedTuple):
    text: str
    #: Characters outside links; all of them inside an article or main element.
    weight: int
    #: The groups around it, outermost first.
    place: tuple[int, ...]


def lines_of(page: str) -> list[Line]:
    """Every block of text; those of furniture have no text and no weight.

    An element that is furniture by its name, or a form, holds text all the same
    if it has most of the characters and most of the lines that are not furniture
    for sure.
    """
    lines: list[tuple[Line, bool, list[int]]] = []  # furniture for sure; elements that may be
    parts: list[str] = []
    stack: list[tuple[str, int, bool, int]] = []  # tag, furniture, article, number
    number = 0
    state = {"furniture": 0, "article": 0, "links": 0, "embedded": 0}
    linked = 0

    def close_line() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                weight = len(text) if state["article"] else max(0, len(text) - linked)
                line = Line(text, weight, tuple(x[3] for x in stack if x[0] in GROUPS))
                lines.append((line, state["furniture"] > 0, [x[3] for x in stack if x[1] == MAYBE]))
        linked = 0

    def pop() -> None:
        if stack[-1][1] and not state["embedded"]:
            close_line()
        tag, furniture, article, _ = stack.pop()
        state["furniture"] -= furniture == YES
        state["article"] -= article
        state["links"] -= tag == "a"
        state["embedded"] -= tag in EMBEDDED

    def leave(tag: str) -> None:
        """Pop the innermost element of this name and all within it."""
        while stack[-1][0] != tag:
            pop()
        pop()

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else size]
        if text and not state["embedded"]:
            parts.append(text)
            if state["links"]:
                linked += len(text)
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            known = any(x[0] == tag for x in stack)
            if known:
                while state["embedded"] and stack[-1][0] != tag:
                    pop()  # embedded elements that were never closed
            if tag in BLOCKS and not state["embedded"]:
                close_line()
            if known:
                leave(tag)
            continue
        attributes = m[3] or m[6] or ""
        empty = _EMPTY.search(attributes) is not None
        if tag not in HEAD and any(x[0] == "head" for x in stack) and not any(x[0] == "template" for x in stack):
            leave("head")
        if tag in BLOCKS and any(x[0] == "svg" for x in stack) and not any(x[0] == "foreignobject" for x in stack):
            leave("svg")
        if tag in BLOCKS and not state["embedded"]:
            close_line()
        elif tag == "br":
            parts.append("\n")
        if tag in RAW and not empty:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag in VOID or empty:
            continue
        if tag in ("article", "main") and not any(x[2] or x[0] in ("template", "noscript", "iframe", "object") for x in stack):
            while any(x[1] or x[0] in EMBEDDED for x in stack):
                pop()  # furniture that was never closed
        elif tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == tag:
            pop()
        number += 1
        kind = (tag, _furniture(tag, attributes, state["article"] > 0), tag in ("article", "main"), number)
        if kind[1] and tag not in BLOCKS and not state["embedded"]:
            close_line()
        stack.append(kind)
        state["embedded"] += tag in EMBEDDED
        state["furniture"] += kind[1] == YES
        state["article"] += kind[2]
        state["links"] += tag == "a"
    close_line()
    open_lines = [(line, named) for line, sure, named in lines if not sure]
    chars, count = Counter(), Counter()
    for line, named in open_lines:
        for k in named:
            chars[k] += len(line.text)
            count[k] += 1
    most = sum(len(line.text) for line, _ in open_lines)
    held = {k for k in count if 2 * chars[k] > most and 2 * count[k] > len(open_lines)}
    return [line._replace(text="", weight=0) if sure or not held.issuperset(named) else line for line, sure, named in lines]


def extract(page: str | None) -> str:
    lines = lines_of(page or "")
    weights = [x.weight for x in lines]
    if not any(weights):
        return ""
    n = len(lines)
    sums = [sum(weights[i : i + WINDOW]) for i in range(n)]
    high = SURGE * max(sums)
    first, last = n, -1
    i = 0
    while i < n:
        if not weights[i]:
            i += 1
            continue
        start = end = i
        while i < n and sums[i]:  # text dives where a whole window is empty
            end = i if weights[i] else end
            i += 1
        if any(sums[k] >= high for k in range(start, end + 1) if weights[k]):
            first, last = min(first, start), end
    # Text of the same group beside it, cut off by furniture, goes on with it, however short.
    places = {x.place for x in lines[first : last + 1] if x.text}
    group = tuple(os.path.commonprefix(list(places)))
    kept = [x.text for i, x in enumerate(lines) if x.text and (first <= i <= last or group and x.place[: len(group)] == group or x.weight and x.place in places)]
    return "\n".join(kept)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    small_batches(pages.sparkSession)

    def run(batches):
        for b in batches:
            texts = [extract(x) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id").cast(pa.int64()), b.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(frugal(run), SCHEMA)
