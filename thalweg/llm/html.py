"""Main text of web pages by line-block distribution over stripped markup.

Markup is stripped into lines, one for each block of text; parts that are never content (scripts, menus, forms, ...)
go, and those that divide pages (menus, page headers and footers) leave blank lines.  Text lengths are summed over windows
of lines.  The text of interest begins where the sums surge and ends where they dive to nothing; what lies between is
kept, and so is the page's first heading before it.  An article that the page declares is evidence: runs end at its ends,
its lines count DECLARED_TIMES and all stay, unless the page declares another that is far larger (a teaser goes).
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

#: Lines in a window of the distribution, and blank lines left by a part that divides the page.
WINDOW = 3
#: A window of this many characters (or this share of the page's largest window) is a surge.
SURGE_CHARS, SURGE_SHARE = 80, 0.25
#: A line counts nothing if over this share of it is link text.
LINK_SHARE = 0.5
#: The number of lines of a page's first-level headings, outside of content elements.
HEADING = -1
#: What a declared line counts when the page's largest window is sought: other text has to surge beside that.
DECLARED_TIMES = 4

#: Element names, by what they do (fixed values of the HTML standard).
RAW = "script|style|noscript|template|textarea|title|iframe|noembed|noframes|svg|canvas|object|audio|video|select|button"
DROPPED = frozenset("nav header footer aside form menu dialog head".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html"
    " legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold an article; they also end what an unclosed dropped element began.
CONTENT = frozenset(("article", "main"))
#: Words of class, id and role values that mark parts which are not content.
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar side-bar aside nav navbar navigation menu menubar topbar toolbar breadcrumb"
    " breadcrumbs pagination pager footer header masthead contentinfo complementary search comment comments commentlist respond reply replies disqus cookie cookies consent gdpr"
    " notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended widget tags skip-link hidden sr-only".split()
)
#: Last parts of hyphenated words that mark the whole, and parts that may follow a word of NOISE in one.
STRUCTURAL = frozenset(
    "ad ads advert adverts advertisement aside banner breadcrumb breadcrumbs comments consent cookie cookies disqus footer masthead menu menubar modal nav navbar navigation newsletter notice overlay pagination"
    " popup promo sidebar signup skyscraper sponsor sponsored toolbar topbar widget".split()
)
HOLDERS = frozenset(
    "area bar block body box button buttons column container content count footer form group header heading icon icons inner input item items left link links list main outer panel post posts primary right row"
    " secondary section slot title top bottom unit wrap wrapper".split()
)
#: Parts that stand inside running text, which goes on behind them: elements, and words of their attributes.
INLINE = frozenset("aside form dialog".split())
INLINE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion aside newsletter subscribe subscription signup share sharing social related recommended widget notice alert popup modal overlay hidden none".split()
)

#: A quote begins a value only behind an equals sign; anywhere else it is a character like others.
_ATTRS = r"""(?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+"""
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<(?P<raw>{RAW})(?=[\s/>]){_ATTRS}>.*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>{_ATTRS})(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)|\b(hidden)\b""")
_SPLIT = re.compile(r"[\s_]+")
_SPACE = re.compile(r"\s+")
_NO_WORD = re.compile(r"[^a-z]+")


def _is_noise_word(word: str) -> bool:
    """``sidebar``, ``site-footer`` and ``comment-list``, but not ``share-price`` or ``no-sidebar``."""
    first, *rest = word.split("-")
    if word in NOISE or not rest or first in ("has", "with", "no", "without"):
        return word in NOISE
    return rest[-1] in STRUCTURAL or (first in NOISE and all(x in HOLDERS or x in NOISE or x.isdigit() for x in rest))


def _is_noise(name: str, attrs: str, in_content: bool) -> bool:
    if name in DROPPED:
        return not (name == "header" and in_content)
    if not attrs or name in ("html", "body"):
        return False
    for key, value, hidden in _ATTR.findall(attrs):
        if hidden:
            return True
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id", "role"):
            if any(_is_noise_word(word) and not (in_content and word in ("header", "banner", "masthead", "tags")) for word in _SPLIT.split(value)):
                return True
        elif (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)) or (key == "aria-hidden" and value == "true"):
            return True
    return False


def _is_inline(name: str, attrs: str) -> bool:
    """If a part that is not content stands inside running text; others divide the page."""
    return name in INLINE or (name not in DROPPED and not INLINE_WORDS.isdisjoint(_NO_WORD.split(attrs.lower())))


def lines_of(page: str) -> list[tuple[str, int, int]]:
    """(text, characters of link text, number of the content element, HEADING or 0) of each line; parts that divide the page leave blanks."""
    out: list[tuple[str, int, int]] = []
    text: list[str] = []
    linked = 0
    stack: list[str] = []  # open elements that are tracked
    drop_from = -1  # depth of the outermost dropped element
    content: list[tuple[int, int]] = []  # (depth, number) of open content elements
    seen = in_link = 0

    def flush(blanks: int = 0) -> None:
        nonlocal linked
        if text:
            line = _SPACE.sub(" ", html.unescape("".join(text))).strip()
            if line:
                out.append((line, linked, content[0][1] if content else HEADING if "h1" in stack else 0))
            text.clear()
        linked = 0
        out.extend([("", 0, 0)] * blanks)

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at and drop_from < 0:
            piece = page[at : m.start()]
            text.append(piece)
            if in_link:
                linked += len(piece)
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["close"]:
            if name in stack:
                depth = len(stack) - 1 - stack[::-1].index(name)
                if drop_from >= 0 and depth < drop_from and name in ("p", "div", "li", "ul", "a", "b", "span"):
                    continue  # an end tag that belongs inside the dropped part
                if drop_from < 0 and name in BLOCKS:
                    flush()
                del stack[depth:]
                in_link = stack.count("a")
                while content and content[-1][0] >= depth:
                    content.pop()
                if drop_from >= 0 and depth <= drop_from:
                    drop_from = -1
            elif drop_from < 0 and name in BLOCKS:
                flush()
            continue
        if name == "br" or name in VOID and name != "hr":
            if drop_from < 0 and name == "br":
                text.append(" ")
            continue
        if name == "hr":
            if drop_from < 0:
                flush()
            continue
        if name in CONTENT and drop_from >= 0 and not content and not _is_noise(name, m["attrs"], False) and "article" not in stack[: drop_from + 1]:
            if stack[drop_from] not in ("nav", "footer", "aside", "form", "header", "head") or name == "main":
                del stack[drop_from:]  # what was dropped had never been closed
                drop_from = -1
        if m["attrs"].endswith("/") and name not in BLOCKS:
            continue
        if drop_from < 0:
            if name in BLOCKS:
                flush()
                if name == "p" and stack and "p" in stack[-4:]:
                    del stack[len(stack) - 1 - stack[::-1].index("p") :]
                    in_link = stack.count("a")
            if name == "body" and "head" in stack:
                del stack[stack.index("head") :]
            if _is_noise(name, m["attrs"], bool(content)):
                flush(0 if _is_inline(name, m["attrs"]) else WINDOW)
                drop_from = len(stack)
            elif name in CONTENT or "articlebody" in m["attrs"].lower():
                seen += 1
                content.append((len(stack), seen))
        elif name == "body" and stack[drop_from] == "head":
            del stack[drop_from:]
            drop_from = -1
        stack.append(name)
        in_link += name == "a" and drop_from < 0
    if at < len(page) and drop_from < 0:
        text.append(page[at:].split("<")[0])
    flush()
    return out


def main_lines(lines: list[tuple[str, int, int]]) -> list[str]:
    """The lines between surge and dive points."""
    weight = [len(line) if part > 0 or linked <= LINK_SHARE * max(1, len(line)) else 0 for line, linked, part in lines]
    part_of = [max(0, part) for _, _, part in lines]
    runs: list[tuple[int, int, int, int]] = []  # first, end, content element, largest window
    i = 0
    while i < len(weight):
        if not weight[i]:
            i += 1
            continue
        last, j = i, i + 1
        while j < len(weight) and j - last <= WINDOW and part_of[j] == part_of[i]:  # the dive: a window without text
            last = j if weight[j] else last
            j += 1
        end = last + 1
        runs.append((i, end, part_of[i], max(sum(weight[k : min(k + WINDOW, end)]) for k in range(i, end))))
        i = end
    largest: dict[int, int] = {}
    for _, _, part, best in runs:
        largest[part] = max(largest.get(part, 0), best)
    declared = max((best for part, best in largest.items() if part), default=0)
    top = max(declared * DECLARED_TIMES, largest.get(0, 0))
    least = min(top, max(SURGE_CHARS, SURGE_SHARE * top))
    surging = [k for k, (_, _, part, best) in enumerate(runs) if (largest[part] >= SURGE_SHARE * declared if part else best >= least)]
    if surging and not declared:
        first = surging[0]
        while first and any(lines[k][2] == HEADING for k in range(*runs[first - 1][:2])):
            first -= 1
        surging = list(range(first, surging[-1] + 1))  # from the first surge, or the heading before it, to the last dive
    return [line for k in surging for line, _, _ in lines[runs[k][0] : runs[k][1]] if line]


def extract(page: str | None) -> str:
    """The main text of a page."""
    return "\n".join(main_lines(lines_of(page))) if page else ""


def _extracted(batches):
    for batch in batches:
        texts = [extract(x) for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in batch.schema.names if c != "html"], pa.array(texts, pa.string())], [*[c for c in batch.schema.names if c != "html"], "text"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """Replaces ``html`` by ``text``, the main text of the page; the other columns pass through (but for a ``text``).

    Defined cases: null or empty html, and pages without content, give an empty text; broken or unclosed markup is read
    as far as it goes; repeated rows are extracted alike; whole pages are read, however long.  One pass, no shuffle.
    """
    pages = pages.select("html", *[c for c in pages.columns if c not in ("html", "text")])
    rest = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name != "html")
    return pages.mapInArrow(_extracted, f"{rest}, text string" if rest else "text string")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.selectExpr("page_id", "url", "text", "cast(length(text) as bigint) AS n_chars")


QUERIES = {"op2_html": op2_html}
#: No SQL: DuckDB has no reader of markup.  Tests hold the operator against pages with known text.
ORACLES: dict[str, str] = {}
