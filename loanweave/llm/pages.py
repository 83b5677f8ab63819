"""Main text of web pages by tag-path ratios.

A page is read as a sequence of blocks of text, each with its path of tags from the root. For each path the text length and the
punctuation per occurrence are totalled, both series are smoothed over the paths in page order and fused to one ratio, and the
paths above a threshold are content. The elements that name themselves articles, else the one that holds nearly all of the content, are
kept whole; beside them the paths decide. Containers that name themselves as something else (menus, forms, comments and so on) take no
part, unless one that is so named by its class or id holds most of the page.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
# Elements by the rules of HTML, and names that page authors give to what isn't the article.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup "
    "hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "legend", "head", "body", "html"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"table", "ul", "ol", "dl", "article", "section", "main", "body", "html", "select", "td", "th", "div"}
OTHER_TAGS = set("head nav aside footer form button select option textarea input label script style noscript template iframe svg canvas math object audio video dialog menu title search".split())
OTHER_ROLES = set("navigation banner contentinfo complementary search form menu menubar toolbar alert alertdialog dialog status".split())
OTHER_NAMES = set(
    "ad ads adv advert adverts advertisement advertising advertorial banner banners breadcrumb breadcrumbs byline-links captcha comment comments commentlist consent cookie cookies "
    "copyright discussion disqus footer gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices notification overlay pager pagination "
    "paywall popup promo promos promoted promotion recommended related replies reply respond share sharebar sharing sidebar sidebars signup skip social sponsor sponsored sponsors "
    "subscribe subscription teaser toolbar topbar widget widgets".split()
)
WRAPPERS = {"article", "main", "section", "div", "body", "html", "td", "blockquote", "center"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PUNCTUATION = re.compile(r"[.,;:!?…。、，！？；：¿¡]")


class Element:
    """An open or closed element of the page: its name, its path of tags from the root (as a number), whether it is left out, and
    the innermost element around it, or itself, whose class or id may leave it out."""

    __slots__ = ("doubt", "left_out", "number", "parent", "path", "tag")

    def __init__(self, number: int, tag: str, path: int, parent: Element | None, left_out: bool, doubtful: bool = False):
        self.number, self.tag, self.path, self.parent, self.left_out = number, tag, path, parent, left_out
        self.doubt: Element | None = self if doubtful else parent.doubt if parent is not None else None


def _left_out(tag: str, given: dict[str, str]) -> bool:
    if tag in OTHER_TAGS:
        return True
    if "hidden" in given or given.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", given.get("style", "")):
        return True
    if set(given.get("role", "").lower().split()) & OTHER_ROLES:
        return True
    return tag == "header"


def _otherwise_named(tag: str, given: dict[str, str]) -> bool:
    if tag in ("html", "body", "main", "article", "p") or tag in HEADINGS:
        return False
    names = re.split(r"[\s_-]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", f"{given.get('class', '')} {given.get('id', '')}").lower())
    return not OTHER_NAMES.isdisjoint(re.sub(r"\d+$", "", x) for x in names)


def blocks_of(page: str) -> list[tuple[Element, str, int]]:
    """The page's blocks in order: the element that holds the text, the text, and how many characters of it are in links."""
    open_at: list[Element] = []
    found: list[tuple[Element, str, int]] = []
    held: list[str] = []
    linked, made, at, owner = 0, 0, 0, None
    times: Counter[str] = Counter()  # open elements by name
    paths: dict[tuple[int, str], int] = {}
    doubts: dict[int, list] = {}  # elements whose name may leave them out: characters in them, and whether an article or title is

    def flush() -> None:
        nonlocal linked, owner
        text = " ".join(html.unescape("".join(held)).split())
        if text and owner is not None:
            found.append((owner, text, min(linked, len(text))))
        held.clear()
        linked, owner = 0, None

    def say(raw: str) -> None:
        nonlocal linked, owner
        if raw and not (open_at and open_at[-1].left_out):
            held.append(raw)
            if owner is None and raw.strip():
                owner = open_at[-1] if open_at else root
            if times["a"]:
                linked += len(raw.strip())

    def close(until: int) -> None:
        times.subtract(e.tag for e in open_at[until:])
        del open_at[until:]

    root = Element(0, "", 0, None, False)
    while (token := TOKEN.search(page, at)) is not None:
        say(page[at : token.start()])
        at = token.end()
        tag = (token[2] or "").lower()
        if not tag:
            if token[0].startswith("<![CDATA["):
                say(html.escape(token[0][9:].removesuffix("]]>")))
            continue
        if tag in BLOCKS:
            flush()
        elif tag == "br":
            held.append(" ")
        if token[1]:
            for k in [] if not times[tag] else range(len(open_at) - 1, -1, -1):
                if open_at[k].tag == tag:
                    close(k)
                    break
                if tag not in BLOCKS and open_at[k].tag in BLOCKS:
                    break
            continue
        if tag in CLOSES_P and times["p"] and (k := next((k for k in range(len(open_at) - 1, -1, -1) if open_at[k].tag in SCOPES or open_at[k].tag == "p"), None)) is not None and open_at[k].tag == "p":
            close(k)
        if tag in SIBLINGS and any(times[x] for x in SIBLINGS[tag]):
            for k in range(len(open_at) - 1, -1, -1):
                if open_at[k].tag in SIBLINGS[tag]:
                    close(k)
                    break
                if open_at[k].tag in SCOPES - {"td", "th", "div"}:
                    break
        if tag in VOID:
            continue
        given = {m[1].lower(): next((x for x in (m[2], m[3], m[4]) if x is not None), "") for m in ATTRIBUTE.finditer(token[3] or "")}
        parent = open_at[-1] if open_at else root
        made += 1
        out, named = parent.left_out or _left_out(tag, given), _otherwise_named(tag, given)
        if tag not in BLOCKS:
            out = out or named
        if parent.left_out and parent.tag == "header" and tag in HEADINGS and (times["article"] or times["main"]):
            out = False  # an article's own header holds its title
        label = re.sub(r"\d+", "", f"{tag}.{given.get('class', '')}")
        element = Element(made, tag, paths.setdefault((parent.path, label), len(paths) + 1), parent, out, named and not out)
        if element.doubt is element:
            doubts[made] = [element, 0, False]
        elif tag in ("article", "main", "h1") and not out and element.doubt is not None:
            doubts[element.doubt.number][2] = True
        if token[0].endswith("/>") and tag not in BLOCKS:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        open_at.append(element)
        times[tag] += 1
    say(page[at:])
    flush()
    if not doubts:
        return found
    # A name leaves an element out only if that is a part of the page, not a wrapper around most of it.
    for element, text, linked in found:
        if element.doubt is not None:
            doubts[element.doubt.number][1] += len(text) - linked
    whole = sum(len(t) - a for _, t, a in found)
    for number in sorted(doubts, reverse=True):
        element, amount, holds = doubts[number]
        if (outer := element.parent.doubt) is not None:
            doubts[outer.number][1] += amount
            doubts[outer.number][2] |= holds
    out: dict[int, bool] = {}
    for number in sorted(doubts):
        element, amount, holds = doubts[number]
        outer = element.parent.doubt
        wraps = amount > 0.5 * whole and (holds or amount >= 0.9 * whole)
        out[number] = not wraps or (outer is not None and out[outer.number])
    return [b for b in found if b[0].doubt is None or not out[b[0].doubt.number]]


def _smooth(values: np.ndarray, width: int = 1) -> np.ndarray:
    kernel = np.exp(-0.5 * (np.arange(-2 * width, 2 * width + 1) / width) ** 2)
    return np.convolve(np.pad(values, 2 * width, mode="edge"), kernel / kernel.sum(), mode="valid")


def content_blocks(blocks: list[tuple[Element, str, int]]) -> list[bool]:
    """Which blocks stand on content paths: path ratios of length and punctuation, smoothed, fused and held against a threshold."""
    paths: dict[int, int] = {}
    of = np.array([paths.setdefault(e.path, len(paths)) for e, _, _ in blocks])
    times = np.bincount(of, minlength=len(paths))
    length = np.bincount(of, [len(t) - a for _, t, a in blocks], len(paths)) / times
    marks = np.bincount(of, [len(PUNCTUATION.findall(t)) if a < len(t) / 2 else 0 for _, t, a in blocks], len(paths)) / times
    fused = _smooth(length) * (1 + _smooth(marks)) * (length / max(1.0, length.max()))
    keep = fused >= min(fused.std(), fused.max()) * 0.5
    return [bool(keep[p]) for p in of]


def main_text(page: str | None) -> str:
    """The article's blocks, one a line; empty if the page has none."""
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    content = content_blocks(blocks)
    # Characters on content paths, and all but links, that each element holds, from the youngest element up: a parent is always older.
    held: dict[int, list] = {}
    for (element, text, linked), good in zip(blocks, content, strict=True):
        own = held.setdefault(element.number, [element, 0, 0])
        own[1] += (len(text) - linked) * good
        own[2] += len(text) - linked
    waiting = [-n for n in held]
    heapify(waiting)
    while waiting:
        element, amount, every = held[-heappop(waiting)]
        if element.parent is not None:
            if element.parent.number not in held:
                held[element.parent.number] = [element.parent, 0, 0]
                heappush(waiting, -element.parent.number)
            held[element.parent.number][1] += amount
            held[element.parent.number][2] += every
    total = held[0][1]
    if not total:
        return ""
    # Articles are kept whole: those that are mostly content and the innermost with half of all; else the innermost wrapper of nearly all.
    named = [e for e, n, _ in held.values() if e.tag in ("article", "main") and n >= 0.5 * total]
    parts = {e.number for e, n, every in held.values() if e.tag == "article" and n and n >= 0.5 * every}
    wraps = [e for e, n, _ in held.values() if n >= 0.9 * total and (e.tag in WRAPPERS or not e.number)]
    articles = parts | {max(named, key=lambda e: e.number).number} if named else parts or {max(wraps, key=lambda e: e.number).number}
    explicit = bool(named or parts)
    inside: dict[int, bool] = {}
    around: set[int] = set()
    for number in sorted(held):  # parents first
        element = held[number][0]
        inside[number] = number in articles or (element.parent is not None and inside[element.parent.number])
    for number in articles:
        element = held[number][0].parent
        while element is not None and element.number not in around:
            around.add(element.number)
            element = element.parent
    kept = []
    for (element, text, linked), good in zip(blocks, content, strict=True):
        if inside[element.number]:
            keep = good or explicit or linked < 0.8 * len(text)
        else:  # content, and titles and leads that stand directly beside the article or what holds it
            beside = element.tag in HEADINGS or (element.tag == "p" and not explicit)
            keep = good or (beside and element.parent is not None and element.parent.number in around and linked < 0.5 * len(text))
        if keep:
            kept.append(text)
    return "\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of each page, one row for each row.

    A null or empty html, and a page without text, give the empty text. Whole pages are read; other columns are ignored.
    """

    def batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, len(rows), 256):
                some = rows.slice(at, 256)
                texts = [main_text(x) for x in some["html"].to_pylist()]
                yield pa.RecordBatch.from_arrays([some["page_id"], some["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(batch, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
