"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped into lines, one for each block element, and lines of boilerplate containers are left out as if
they were not there, so an advert does not part the text around it. Every other line has a count of characters:
on a page without a marked article its characters outside links, on a page with one (``article``, ``main``)
``INSIDE`` times its characters inside the article and ``1 / OUTSIDE`` of those outside links elsewhere; three empty
lines part the two. Counts are summed over windows of ``LINES`` lines. A window of nothing is a dive, and a stretch
between dives is kept, from its first to its last line that counts, where some window of it surges: its sum reaches
``SURGE``, or the page's highest sum where that is lower. So structure weighs and windows decide, and no stretch is
judged by the length of another as soon as one reaches ``SURGE``.

A class or id makes a container boilerplate only if all its words say so (``ad-banner``, ``related-posts``; not
``related-work``). Text of mathematics and drawings and what stands in for media is text.

Odd input: null and empty pages have empty text; unclosed elements end with their parent, cut-off markup at
the end is dropped; very long and deeply nested pages take time in proportion to their length; rows are judged
one by one, so repeated rows stay; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import bound_batches

LINES = 3
SURGE = 80
INSIDE = 16
OUTSIDE = 32
# Element names of HTML and words that page templates use in class and id.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead tr ul".split())
INLINE = frozenset("span button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LOOSE = frozenset("p li dt dd option tr td th tbody thead tfoot colgroup".split())
RAW = frozenset("script style noscript template iframe textarea title select".split())
DROPPED = frozenset("nav footer aside form menu dialog button fieldset head".split())
NAMES = frozenset("nav navbar navigation menu sidebar sidenav ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations comment comments disqus respond replies breadcrumb breadcrumbs pagination pager toolbar skip login widget widgets footer copyright outbrain taboola".split())
TOP_NAMES = frozenset("header masthead banner topbar".split())
GENERIC = frozenset("area aside banner bar block body bottom box buttons card cards center column container content count desktop fixed footer form frame grid group header heading holder icon icons inline inner item items left link links list main message mobile module nav outer panel post posts primary right row section secondary small site slot stories sticky text title top unit view wrap wrapper".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
WORD = re.compile(r"[a-z0-9]+")


def _unwanted(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element and all in it is boilerplate; ``inside``: of an article."""
    if tag in DROPPED or tag == "header" and not inside:
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return True
    if found.get("role", "").lower() in ROLES:
        return True
    names = NAMES if inside else NAMES | TOP_NAMES
    for token in f"{found.get('class', '')} {found.get('id', '')}".split():
        words = {w.rstrip("0123456789") for w in WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", token).lower())} - {""}
        if words & names and words <= names | GENERIC:
            return True
    return False


def lines_of(page: str) -> list[tuple[str, int, bool, bool]]:
    """(text, characters inside links, boilerplate, inside an article) of every block, in page order."""
    out: list[tuple[str, int, bool, bool]] = []
    parts: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # element, dropped, article, muted: left out of its line
    opened: dict[str, list[int]] = {}  # places in the stack by element
    links = at = 0
    end = len(page)
    dropped = article = muted = False

    def whole(pieces):
        return " ".join(unescape("".join(pieces)).split())

    def flush():
        out.append((whole(parts), len(whole(linked)) if linked else 0, dropped, article))
        parts.clear()
        linked.clear()

    def text(a, b):
        if a < b and not muted:
            parts.append(page[a:b])
            if links:
                linked.append(page[a:b])

    def pop():
        opened[stack.pop()[0]].pop()

    while at < end:
        found = TOKEN.search(page, at)
        if not found:
            break
        text(at, found.start())
        at = found.end()
        if found[0].startswith("<![CDATA["):
            parts.append(found[0][9:-3].replace("&", "&amp;"))
            continue
        tag = (found[2] or found[5] or "").lower()
        closing = found[1] or found[4]
        attributes = found[3] or found[6] or ""
        if not tag:
            continue
        if tag == "a":
            links = max(0, links + (-1 if closing else 1))
            continue
        if tag in RAW:
            if not closing and not attributes.endswith("/"):
                stop = re.compile(f"</{re.escape(tag)}", re.I).search(page, at)
                at = stop.start() if stop else end
            continue
        if tag in BLOCKS:
            flush()
            links = 0 if tag in ("article", "main", "body") else links
            if stack and stack[-1][0] in LOOSE and not closing and stack[-1][0] in ("p", tag):
                pop()  # left open: a paragraph ends at the next block, an item at the next one
        elif tag in ("br", "td", "th"):
            parts.append(" ")
        if closing:
            if opened.get(tag):
                first = opened[tag][-1]
                while len(stack) > first:
                    pop()
        elif (tag in BLOCKS or tag in INLINE) and tag not in VOID:
            unwanted = _unwanted(tag, attributes, article)
            if tag in ("article", "main") and not unwanted:
                # An article does not belong to the advert or menu that was left open before it.
                while stack and stack[-1][1] and not stack[-1][2]:
                    pop()
            if tag not in LOOSE or unwanted:
                under = stack[-1] if stack else ("", False, False, False)
                opened.setdefault(tag, []).append(len(stack))
                inline = tag in INLINE
                stack.append((tag, under[1] or unwanted and not inline, under[2] or tag in ("article", "main") and not unwanted, under[3] or unwanted and inline))
        _, now_dropped, article, muted = stack[-1] if stack else ("", False, False, False)
        if now_dropped != dropped and parts:
            flush()
        dropped = now_dropped
    text(at, end)
    flush()
    return out


def weighed(page: str | None) -> list[tuple[str, int]]:
    """The page's lines with their counts of characters, empty lines where an article begins or ends."""
    lines = [x for x in lines_of(page or "") if x[0] and not x[2]]
    marked = any(inside for *_, inside in lines)
    out: list[tuple[str, int]] = []
    for k, (text, linked, _, inside) in enumerate(lines):
        if k and inside != lines[k - 1][3]:
            out += [("", 0)] * LINES
        plain = len(text) - linked if 2 * linked <= len(text) else 0
        out.append((text, INSIDE * len(text) if inside else plain // OUTSIDE if marked else plain))
    return out


def main_text(page: str | None) -> list[str]:
    """The blocks of the page's main text."""
    lines = weighed(page)
    counts = [n for _, n in lines]
    sums = [sum(counts[i : i + LINES]) for i in range(len(counts))]
    surge = min(SURGE, max(sums, default=0))
    kept: list[str] = []
    i = 0
    while i < len(sums):
        j = i
        while j < len(sums) and sums[j]:
            j += 1
        if j > i and max(sums[i:j]) >= surge:
            full = [k for k in range(i, j) if counts[k]]
            kept += [t for t, _ in lines[full[0] : full[-1] + 1] if t]
        i = j + 1
    return kept


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row."""

    bound_batches(pages.sparkSession)

    def run(it):
        for batch in it:
            texts = ["\n\n".join(main_text(h)) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
