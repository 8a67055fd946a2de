"""Main text of web pages by the line-block distribution."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, slices

#: Lines a block sums, and the characters from which a block counts as a surge.
WIDTH, SURGE = 3, 86
#: How often a page is read again for elements that turn out to hold most of its text.
PASSES = 8
#: A run of lines of whose text links hold more than this share is a menu.
LINKS = 0.5

# Elements by their part in a page.
_RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp", "noembed", "noframes")
_DROPPED = ("head", "nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "svg", "math", "canvas", "object", "video", "audio", "map", "datalist", "fieldset", "label")
_INLINE = ("a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "meter", "output", "q", "ruby", "rb", "rp", "rt", "rtc", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr")
_MAIN = ("article", "main")
_VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
_HINTS = ("ad", "ads", "adv", "advert", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "sidebar", "aside", "widget", "cookie", "cookies", "consent", "gdpr", "notice", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "search", "share", "sharing", "social", "related", "recommended", "comment", "comments", "respond", "reply", "replies", "disqus", "pagination", "pager", "toolbar", "skip", "copyright", "complementary", "contentinfo", "alert")

# A quotation mark opens a value after an equals sign only, and what it opens ends with the page at the latest; no part is tried twice.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z)", re.S)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in _RAW}
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/\"']|$)", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_BREAK = ("", 0, False)
#: Removed elements of the page's frame, after which text is another one; others, such as adverts, stand within a text.
_FRAME = ("nav", "header", "footer")
# Class tokens such as has-sidebar and comments-open tell a state of what holds other things.
_STATE_BEFORE = ("has", "with", "without", "no", "not", "is", "hide", "hides", "show", "shows")
_STATE_AFTER = ("open", "closed", "opened", "active", "inactive", "enabled", "disabled", "visible", "hidden", "on", "off", "left", "right", "none")


def _hinted(value: str, inside: bool) -> tuple[bool, bool]:
    """If a class, id or role names boilerplate; if one does so with nothing but a hint, so that there is no doubt."""
    found = sure = False
    for token in value.split():
        words = [w.lower() for w in _WORD.findall(token)]
        if len(words) > 1 and (words[0] in _STATE_BEFORE or words[-1] in _STATE_AFTER):
            continue
        hints = [w in _HINTS and not (inside and w in ("header", "search")) for w in words]
        found |= any(hints)
        sure |= bool(hints) and all(hints)
    return found, sure


def _boilerplate(tag: str, attributes: str, inside: bool) -> str:
    """Empty if the element stays; else ``sure``, or ``hint`` where part of a class token tells."""
    if tag in _DROPPED:
        return "sure"
    if tag == "header":
        return "" if inside else "sure"  # an article's own header holds its title
    if tag in _MAIN or tag in ("html", "body") or not attributes:
        return ""
    why = ""
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return "sure"
        found, sure = _hinted(value, inside)
        if sure:
            return "sure"
        why = "hint" if found else why
    return why


def lines_of(page: str) -> list[tuple[str, int, bool]]:
    """Text, characters of it in links and whether it stands in an article, of each block in page order. Removed parts of the page's frame
    and the ends of articles leave WIDTH empty lines, over which the distribution falls to nothing; other removed elements leave none.
    An element that only part of a class token makes boilerplate stays if it holds most of the page's text; where such elements lie in each
    other to more than PASSES depths, all of them stay."""
    kept: set[int] = set()
    for _ in range(PASSES):
        out, removed = _lines(page, kept)
        total = sum(len(x[0]) for x in out) + sum(removed.values())
        most = {at for at, n in removed.items() if 2 * n > total}
        if not most:
            return out
        kept |= most
    return _lines(page, None)[0]


def _lines(page: str, kept: set[int] | None) -> tuple[list[tuple[str, int, bool]], dict[int, int]]:
    """The lines, and the text of each element that a hint removed, by its place; elements at the places ``kept`` stay, None: all."""
    removed: dict[int, int] = {}
    doubt = -1
    out: list[tuple[str, int, bool]] = []
    parts: list[str] = []
    links = at = inside = 0
    in_link = False
    gone, depth = "", 0

    def end_line(gap: bool = False) -> None:
        nonlocal links
        text = " ".join("".join(parts).split())
        if text:
            out.append((text, links, inside > 0))
        if gap:
            out.extend([_BREAK] * WIDTH)
        parts.clear()
        links = 0

    while at < len(page):
        m = _TOKEN.search(page, at)
        stop = m.start() if m else len(page)
        if stop > at and gone and doubt >= 0:
            removed[doubt] += len("".join(page[at:stop].split()))
        if stop > at and not gone:
            text = html.unescape(page[at:stop])
            parts.append(text)
            links += len(text) if in_link else 0
        if not m:
            break
        at = max(m.end(), stop + 1)
        if not m[2]:
            continue
        close, tag, attributes = bool(m[1]), m[2].lower(), m[3]
        if tag in _RAW and not close:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        if gone:
            if not close and tag in _MAIN or tag == "body":
                gone = ""  # it was never closed
            elif tag == gone and tag not in _VOID and not attributes.rstrip().endswith("/"):
                depth += -1 if close else 1
                gone = gone if depth else ""
                continue
            else:
                continue
        if not close and tag not in _VOID and not attributes.rstrip().endswith("/") and (kept is None or stop not in kept) and (why := _boilerplate(tag, attributes, inside > 0)) and (kept is not None or why == "sure"):
            gone, depth = tag, 1
            doubt = stop if why == "hint" else -1
            if doubt >= 0:
                removed[doubt] = 0
            end_line(gap=tag in _FRAME and not inside)
        elif tag == "br":
            parts.append(" ")
        elif tag in _INLINE:
            in_link = not close if tag == "a" else in_link
        else:
            end_line(gap=tag in _MAIN)
            if tag in _MAIN:
                inside = max(0, inside + (-1 if close else 1))
    end_line()
    return out, removed


def main_text(page: str, width: int = WIDTH, surge: int = SURGE) -> str:
    """The lines between the points where the sums over ``width`` lines surge and where they fall to nothing; joined by a space.

    A surge is ``surge`` characters, or the page's fullest block if that is less; menus, that is mostly links, are left out. Articles
    decide among the surges: a surge in one takes in the article's lines before it, and if those in articles hold at least half of
    the text of all surges, the others go.
    """
    lines = lines_of(page)
    sizes = [len(x[0]) for x in lines] + [0] * width
    sums = [sum(sizes[i : i + width]) for i in range(len(lines))]
    least = max(1, min(surge, max(sums, default=0)))
    runs: list[list[tuple[str, int, bool]]] = []
    i = end = 0
    while i < len(lines):
        if sums[i] < least or not sizes[i]:
            i += 1
            continue
        start = stop = i
        while lines[i][2] and start > end and lines[start - 1][2]:
            start -= 1
        while stop < len(lines) and sums[stop]:
            stop += 1
        run = lines[start:stop]
        if sum(x[1] for x in run) <= LINKS * sum(len(x[0]) for x in run):
            runs.append(run)
        i = end = stop
    size = [sum(len(x[0]) for x in run) for run in runs]
    inside = [any(x[2] for x in run) for run in runs]  # articles begin and end with empty lines, so a run is in one or in none
    if 2 * sum(n for n, x in zip(size, inside, strict=True) if x) >= sum(size) and any(inside):
        runs = [run for run, x in zip(runs, inside, strict=True) if x]
    return " ".join(x[0] for run in runs for x in run if x[0])


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(row, text): ``row`` holds all columns of ``pages`` but the html; text is the main text, empty for a null or empty page and for one
    with none. Whole pages; repeated rows stay."""
    others = [c for c in pages.columns if c != html_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([main_text(h or "") for h in b.column(1).to_pylist()], pa.string())], ["row", "text"])

    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), F.col(f"`{html_col}`").alias("html"))
    return rows.transform(map_arrow, run, T.StructType([rows.schema["row"], T.StructField("text", T.StringType())]))
