"""Main text of web pages by line-block distribution.

Markup is stripped to a line per block, in page order. Lines of menus, notices, adverts, forms and the like, told by element, role
or class name, stay as empty lines. Text lengths are summed over sliding windows of lines; text begins where the sums
surge and ends where they dive to zero. On a page that marks its article lines outside of it don't count and those inside count several times, as the marks say
that they are text; else lines that are mostly links don't count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
#: Characters in a window at which text begins, or half of the most in a window of the page, if that is less; and how often those of a marked article count.
SURGE, MARKED = 86, 8
_RAW = "script|style|textarea|title"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{_RAW})(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[/!?a-zA-Z][^>]*>",
    re.S | re.I,
)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr picture input meta link base".split())
_BOILER = frozenset("nav footer aside form menu dialog button fieldset head".split())
_ZONE = frozenset(("article", "main"))
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not text of the page; without an end tag they are nothing.
_MUTE = frozenset("noscript template svg math iframe object select canvas audio video".split())
_P_ENDS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre search section summary table ul li dd dt".split())
#: What a start tag ends, if it is open, and within what: HTML's optional end tags.
_ENDS = {
    **{t: (frozenset(("p",)), frozenset(("button",))) for t in _P_ENDS},
    "li": (frozenset(("li",)), frozenset("ul ol menu".split())),
    **dict.fromkeys(("dd", "dt"), (frozenset(("dd", "dt")), frozenset(("dl",)))),
    **dict.fromkeys(("option", "optgroup"), (frozenset(("option",)), frozenset(("select",)))),
    **dict.fromkeys(("td", "th"), (frozenset(("td", "th")), frozenset(("table",)))),
    "tr": (frozenset(("tr",)), frozenset(("table",))),
    **dict.fromkeys(("tbody", "tfoot", "thead"), (frozenset("tbody tfoot thead".split()), frozenset(("table",)))),
}
_CELLS = frozenset("td th caption table template object".split())
_TABLE = frozenset("td th caption table tr tbody tfoot thead colgroup".split())
#: Open elements that are looked through for the one that a tag ends.
_DEEP = 512
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion nav navbar navigation menu menus breadcrumb breadcrumbs sidebar widget widgets footer header masthead cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended recommendations comment comments commentlist disqus respond reply replies discussion pagination pager toolbar copyright legal skiplink".split()
)
_OWN = frozenset(("article", "post", "entry", "story"))
_NOT = frozenset(("has", "with", "no", "without"))
_NOT_LAST = frozenset(("free", "less"))
_ATTR = re.compile(r"\b(class|id|role|hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


def _named(value: str) -> bool:
    for name in value.lower().split():
        parts = re.split(r"[-_]+", name)
        if parts[0] in _NOT or parts[-1] in _NOT_LAST or (parts[0] in _OWN and parts[-1] == "header"):
            continue
        if parts[0] in _NAMES or parts[-1] in _NAMES:
            return True
    return False


def _boilerplate(tag: str, attrs: str, inside: bool) -> bool:
    if tag in _BOILER or tag == "header" and not inside:
        return True
    if not attrs or tag in ("html", "body", *_ZONE):
        return False
    for name, *values in _ATTR.findall(attrs):
        name, value = name.lower(), next((v for v in values if v), "")
        if name in ("class", "id") and _named(value) or name == "role" and value.lower() in _ROLES or name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
    return False


def _ended(tag: str, end: str, stack: list[str]) -> int:
    """How many open elements stay open as ``tag`` begins or ends."""
    n = len(stack)
    least = max(0, n - _DEEP)
    if not end:
        if tag in _P_ENDS:
            n = _before(frozenset(("p",)), frozenset(("button",)) | _CELLS, stack, n, least)
        if tag in _ENDS and tag not in _P_ENDS or tag in ("li", "dd", "dt"):
            n = _before(*_ENDS[tag], stack, n, least)
        return n
    if tag in _INLINE:
        for i in range(n - 1, least - 1, -1):
            if stack[i] == tag:
                return i
            if stack[i] not in _INLINE:
                break
        return n
    within = frozenset() if tag in _TABLE or tag in _ZONE or tag in ("html", "body") else _CELLS - {tag}
    if tag == "li":
        within |= {"ul", "ol"}
    return _before(frozenset((tag,)), within, stack, n, least)


def _before(tags: frozenset[str], within: frozenset[str], stack: list[str], n: int, least: int) -> int:
    for i in range(n - 1, least - 1, -1):
        if stack[i] in tags:
            return i
        if stack[i] in within:
            break
    return n


def lines(html: str) -> tuple[list[str], list[int], list[bool]]:
    """A text per block in page order, its characters inside links, and whether it is inside the marked article; boilerplate is ''."""
    texts: list[str] = []
    linked: list[int] = []
    zones: list[bool] = []
    held: list[str] = []
    in_link = n_linked = zone = 0
    skip, level, at = "", 0, 0
    stack: list[str] = []
    last: dict[str, int] = {}

    def flush() -> None:
        nonlocal n_linked
        if held:
            if text := " ".join("".join(held).split()):
                texts.append(text)
                linked.append(n_linked)
                zones.append(zone > 0)
            held.clear()
        n_linked = 0

    for m in _TOKEN.finditer(html):
        if m.start() > at and not skip:
            piece = unescape(html[at : m.start()])
            held.append(piece)
            if in_link:
                n_linked += len(piece)
        at = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag, end, attrs = tag.lower(), m["end"], m["attrs"]
        empty = tag in _VOID or not end and attrs.endswith("/") and (bool(skip) or tag in _MUTE)
        del stack[_ended(tag, end, stack) :]
        if skip:
            # an element left open ends with what holds it, by HTML's rules for optional end tags, or where the article begins
            begins = (tag in _ZONE or tag == "body" or tag in _P_ENDS and skip in ("svg", "math") and "foreignobject" not in stack[level:]) and not end
            if begins and (skip not in _MUTE or skip in ("svg", "math")) or end and tag in (*_ZONE, "body", "html"):
                skip = ""
                del stack[level:]
            elif len(stack) <= level:
                ended, skip = skip, ""
                if end and tag == ended and len(stack) == level:
                    continue
            else:
                if not end and not empty:
                    stack.append(tag)
                continue
        if tag in _MUTE and not end:
            if tag not in last:
                last[tag] = max((x.start() for x in re.finditer(rf"</{tag}[\s>]", html, re.I)), default=-1)
            if not empty and last[tag] >= at:
                skip, level = tag, len(stack)
                stack.append(tag)
            continue
        if tag == "br":
            held.append(" ")
            continue
        if not end and tag not in _VOID and _boilerplate(tag, attrs, zone > 0):
            flush()
            texts.append("")
            linked.append(0)
            zones.append(zone > 0)
            skip, level = tag, len(stack)
            stack.append(tag)
            continue
        if not end and not empty:
            stack.append(tag)
        if tag == "a":
            in_link = max(0, in_link + (-1 if end else 1))
        if tag not in _INLINE:
            flush()
            in_link = 0
            if tag in _ZONE:
                zone = max(0, zone + (-1 if end else 1))
    if at < len(html) and not skip:
        held.append(unescape(html[at:]))
    flush()
    return texts, linked, zones


def sums(weights: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Characters in each window of lines, by its first."""
    n = len(weights)
    return np.convolve(np.append(weights, np.zeros(window - 1, np.int64)), np.ones(window, np.int64))[window - 1 : window - 1 + n]


def spans(weights: np.ndarray, surge: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """[begin, end) of the lines from each surge (a window sum above ``surge``) to the next dive (a window sum of zero)."""
    n, all_sums = len(weights), sums(weights, window)
    out, i = [], 0
    for begin in np.flatnonzero(all_sums > surge).tolist():
        if begin < i:
            continue
        dive = np.flatnonzero(all_sums[begin:] == 0)
        i = begin + int(dive[0]) if len(dive) else n
        while begin and weights[begin - 1] and (not out or begin > out[-1][1]):
            begin -= 1
        out.append((begin, i))
    return out


def main_text(html: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The article's blocks joined by newlines; '' for an empty or null page or one without text."""
    if not html:
        return ""
    texts, linked, zones = lines(html)
    if not texts:
        return ""
    size = np.array([len(t) for t in texts], np.int64)
    # features: marks raise a line's weight, and what is outside of them, or mostly links, has none
    weights = MARKED * size * np.array(zones) if any(zones) else np.where(2 * np.array(linked) > size, 0, size)
    surge = min(surge, int(sums(weights, window).max(initial=0)) // 2)  # short pages surge, too
    found = spans(weights, surge, window)
    return "\n".join(texts[i] for begin, end in found for i in range(begin, end) if weights[i])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every row; a null page gives ''. Ids and urls pass as they are, null or repeated;
    other columns, whatever their names, aren't read. Nothing is shuffled; each page, however long, is read whole, by itself. An empty table gives an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return slim.mapInArrow(run, "page_id long, url string, text string, n_chars long")
