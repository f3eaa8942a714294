"""Main-text extraction by two passes of block rules.

The markup is cut into blocks.  Pass one decides blocks: what stands in a navigation, header, footer, sidebar, form,
notice, advert or comment container goes; everywhere else stop-word density, length and link density decide, and short
blocks are left open.  An article container asks for less density and leaves open what elsewhere would go.  Pass two gives
each open block the label of its nearest decided neighbours (both must agree, or the nearer one counts; ties keep the
block); in an article container an open block goes only between two that go by these rules, whatever poor containers hold.

A block is the text between two block-level tags; ``<br>`` is white space inside a block.  Character references are
decoded, white space becomes one space, and kept blocks are joined by a newline.  A null or empty page gives the empty
text; a page without markup is one block and is kept; unclosed and truncated tags are tolerated; texts may be of any
length (the scan is linear); repeated rows are extracted each on its own; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from vecloom.llm.quality import FUNCTION_WORDS
from vecloom.llm.text import rows

#: HTML element names and container names by role (fixed values).
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option optgroup p pre section summary table tbody td tfoot th thead title tr ul head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe".split())
WHOLE = frozenset("svg math object select button head canvas audio video".split())
POOR = frozenset("nav header footer aside form menu dialog".split())
RICH = frozenset("article main".split())
POOR_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|banner|sponsor(?:ed)?|promo(?:tion)?|nav(?:igation|bar)?|menu|breadcrumbs?|header|masthead|footer|sidebar|side|aside|widget"
    r"|comments?|replies|disqus|cookies?|consent|gdpr|notices?|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|pagination|pager|copyright)(?:$|[\s_\d-])",
    re.IGNORECASE,
)
RICH_NAME = re.compile(r"(?:^|[\s_-])(?:article|main|main-content|content|post|post-body|entry|entry-content|story|body-text)(?:$|[\s_-])", re.IGNORECASE)

TOKEN = re.compile(r"<!--|<[!?]|<(/?)([a-zA-Z][^\s/>]*)")
STOP = re.compile(r"[>\"']")
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
HIDDEN = re.compile(r"\bhidden\b(?!\s*=)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.IGNORECASE)
#: A start tag of the first kind closes an open element of the second (HTML's implied end tags; fixed values).
IMPLIED = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}


class Scanner:
    """Places in a page. What is not found behind one place is not sought again, so a page is read a bounded number of times."""

    def __init__(self, page: str):
        self.page, self.missing = page, set()

    def find(self, what: str, at: int) -> int:
        found = -1 if what in self.missing else self.page.find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def tag_end(self, at: int) -> int:
        """The place of the ``>`` that ends the tag whose attributes begin at ``at``; a quote counts behind ``=`` only."""
        begin = at
        while m := STOP.search(self.page, at):
            at = m.end()
            if m[0] == ">":
                return m.start()
            k = m.start() - 1
            while k >= begin and self.page[k].isspace():
                k -= 1
            if k >= begin and self.page[k] == "=" and (end := self.find(m[0], at)) >= 0:
                at = begin = end + 1
        return len(self.page)

    def close(self, name: str, at: int) -> int:
        """The place behind the end tag ``name``, or -1."""
        if name in self.missing:
            return -1
        m = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.IGNORECASE).search(self.page, at)
        if not m:
            self.missing.add(name)
            return -1
        return m.end()


def blocks(page: str) -> list[tuple[str, str, int]]:
    """(text, zone, linked characters) of each block in page order; zone is poor, rich or none."""
    out: list[tuple[str, str, int]] = []
    stack: list[tuple[str, str]] = []  # the open block-level elements
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked, links, at, zone, scan = 0, 0, 0, "none", Scanner(page)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((text, zone, min(linked, len(text))))
            parts.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece:
            parts.append(piece)
            if links:
                linked += len(" ".join(html.unescape(piece).split()))

    def pop() -> str:
        name = stack.pop()[0]
        opened[name] -= 1
        return name

    while at < len(page):
        m = TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            end = scan.find("-->" if m[0] == "<!--" else ">", at)
            at = len(page) if end < 0 else end + (3 if m[0] == "<!--" else 1)
            continue
        name, end = m[2].lower(), scan.tag_end(at)
        told, at = page[at:end], end + 1
        if m[1]:  # an end tag
            if name == "a":
                links = max(0, links - 1)
            if name in BLOCK:
                flush()
                while opened[name] and pop() != name:
                    pass
                zone = stack[-1][1] if stack else "none"
            continue
        alone = told.endswith("/")
        if (name in RAW or name in WHOLE) and not alone:
            close = scan.close(name, at)
            if close >= 0 or name in RAW:
                at = close if close >= 0 else len(page)
            if name in BLOCK:
                flush()
            continue
        if name == "br":
            add("\n")
            continue
        if name not in BLOCK:
            links += name == "a" and not alone
            continue
        flush()
        links = 0 if name not in ("li", "dt", "dd", "option") else links
        if name in VOID or alone:
            continue
        closes = IMPLIED.get(name, {"p"})
        while stack and stack[-1][0] in closes:
            pop()
        zone = stack[-1][1] if stack else "none"
        if zone != "poor":
            names = " ".join(x or y or z for x, y, z in NAMES.findall(told)) if told else ""
            if (name in POOR and not (name == "header" and zone == "rich")) or name not in ("html", "body") and (names and POOR_NAME.search(names) or told and HIDDEN.search(told)):
                zone = "poor"
            elif name in RICH or names and RICH_NAME.search(names) and name not in ("html", "body"):
                zone = "rich"
        stack.append((name, zone))
        opened[name] += 1
    flush()
    return out


def main_text(page: str | None, short: int = 60, long: int = 140, low: float = 0.15, high: float = 0.25, link: float = 0.4) -> str:
    """The page's main text. Lengths are in characters, densities are shares of words or characters."""
    found = blocks(page or "")
    labels: list[bool | None] = []
    for text, zone, linked in found:
        if zone == "poor":
            labels.append(False)
            continue
        rich = zone == "rich"
        words = text.lower().encode("utf-8", "surrogatepass").split()
        dense = sum(w.strip(b".,;:!?") in FUNCTION_WORDS for w in words) / len(words)
        if linked > link * len(text):
            labels.append(False)
        elif len(text) < short:
            labels.append(None)
        elif dense >= (low if rich else high) or len(text) >= long and dense >= low:
            labels.append(True)
        else:
            labels.append(None if rich or len(text) >= long or dense >= low else False)
    if found and not any(x is not None for x in labels):
        labels = [True] * len(found)  # nothing but open blocks: the page is its text
    before: list[tuple[int, bool] | None] = []
    inner: list[bool | None] = []  # the last label that is not of a poor container
    last, near = None, None
    for k, x in enumerate(labels):
        last = (k, x) if x is not None else last
        near = x if x is not None and found[k][1] != "poor" else near
        before.append(last)
        inner.append(near)
    kept, last, near = [], None, None
    for k in range(len(labels) - 1, -1, -1):
        if labels[k] is not None:
            last = (k, labels[k])
            near = labels[k] if found[k][1] != "poor" else near
            keep = labels[k]
        elif found[k][1] == "rich":
            keep = not (inner[k] is False and near is False)
        else:
            p, n = before[k], last
            keep = n[1] if p is None else p[1] if n is None else p[1] if p[1] == n[1] else p[1] if k - p[0] < n[0] - k else n[1] if n[0] - k < k - p[0] else True
        if keep:
            kept.append(found[k][0])
    return "\n".join(reversed(kept))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``."""

    def run(batches):
        for ids, urls, source in rows(batches, "page_id", "url", "html", slice_rows=256):
            text = [main_text(x) for x in source]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
