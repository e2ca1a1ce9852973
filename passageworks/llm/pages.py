"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass labels each block
by itself, from its length, its share of linked characters and its density of
stop words: good, bad, or undecided if it is too short to tell. The second pass
gives an undecided block the label of its nearest decided neighbours; between two
that differ, the nearer one counts, and the good one if both are as near.

What the markup itself calls menu, header, footer, sidebar, notice, advert, form,
comment, script or style is bad, whatever its words. If the page marks its
article (``article``, ``main``), only that part is read, and a block there is bad
only by its markup or for its links, so that short and odd paragraphs stay.

Null and empty pages give an empty text; unclosed and cut-off markup ends with
the page; a page of any size is one row; repeated rows are extracted each; other
columns pass unchanged.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tags by their part in a page, names of boilerplate, frequent words.
BLOCK_TAGS = frozenset("""
address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer
form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary
table tbody td tfoot th thead title tr ul
""".split())
RAW_TAGS = frozenset("script style textarea title noscript template iframe svg math xmp noembed noframes".split())
BAD_TAGS = frozenset("""
nav footer aside form script style noscript template iframe svg math button select textarea input label fieldset menu
dialog object embed audio video canvas map search head
""".split())
OPEN_ENDED = frozenset("li dt dd tr td th option".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BAD_NAMES = frozenset("""
ad ads adv advert adverts advertisement advertisements advertising adsense banner banners breadcrumb breadcrumbs comment
comments commentlist consent cookie cookies copyright disclaimer disqus footer form gdpr header login masthead menu menus
modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup privacy promo promotion
promotions recommended related reply replies respond search share sharing sidebar sidebars signup social sponsor
sponsored subscribe subscription tagcloud toolbar widget widgets
""".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
STOP_WORDS = frozenset("""
the of and to in is it that this for on with as was be by are from or at an not have has had which you he she they his
der die das und in zu den von mit sich des auf für ist im dem nicht ein eine als auch es an er sie bei oder nach wie
le la les de des et un une du en que qui dans pour par sur est pas au ce il elle avec ne se plus sont son
el los las del y una por con no su para como más pero al lo sus es se que o este sin sobre
""".split())

#: Blocks with a larger share of linked characters are bad.
MAX_LINKS = 0.5
#: Inside a marked article only blocks that are links nearly throughout are bad.
MAX_LINKS_INSIDE = 0.9
#: Blocks with fewer characters are undecided, unless their links decide.
SHORT_CHARS = 70
#: Share of stop words from which a block is good, and below which a long one is bad.
GOOD_WORDS, BAD_WORDS = 0.15, 0.08

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.DOTALL)
ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)


class Block:
    __slots__ = ("parts", "linked", "inside", "item")

    def __init__(self, inside: bool, item: bool):
        self.parts: list[str] = []
        self.linked, self.inside, self.item = 0, inside, item


def named_bad(attributes: str) -> bool:
    """True if an element's class, id, role or style says that it is boilerplate."""
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name in ("class", "id"):
            spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", value).lower()
            if not BAD_NAMES.isdisjoint(re.split(r"[^a-z]+", spaced)):
                return True
        elif name == "role" and value.lower() in BAD_ROLES:
            return True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
            return True
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
    return False


def blocks(page: str) -> list[Block]:
    """The page's blocks in order, without what its markup marks as boilerplate."""
    open_tags: list[tuple[str, bool, bool]] = []  # name, boilerplate, inside an article
    found: list[Block] = []
    now: Block | None = None
    linked, at = False, 0

    def state() -> tuple[bool, bool]:
        return open_tags[-1][1:] if open_tags else (False, False)

    def add(text: str) -> None:
        nonlocal now
        bad, inside = state()
        if bad:
            return
        if now is None:
            now = Block(inside, any(t == "li" for t, _, _ in open_tags[-3:]))
            found.append(now)
        now.parts.append(text)
        if linked:
            now.linked += len(text)

    while at < len(page):
        m = TOKEN.search(page, at)
        if m is None or m.start() > at:
            add(page[at : m.start() if m else len(page)])
        if m is None:
            break
        at, tag, block = m.end(), (m[2] or "").lower(), (m[2] or "").lower() in BLOCK_TAGS
        if block:
            now = None
        elif tag == "br":
            add(" ")
        if tag == "a":
            linked = not m[1]
        if not tag or tag in VOID_TAGS:
            continue
        if m[1]:
            for i in range(len(open_tags) - 1, -1, -1):
                if open_tags[i][0] == tag:
                    del open_tags[i:]
                    break
            continue
        if tag in RAW_TAGS:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|$)", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            continue
        if block and open_tags and open_tags[-1][0] in ("p", tag if tag in OPEN_ENDED else "p"):
            open_tags.pop()
        bad, inside = state()
        own = tag in BAD_TAGS or tag == "header" and not inside or block and tag not in ("html", "body") and named_bad(m[3])
        if tag in ("article", "main"):
            # an unclosed advert or notice ends where the article begins
            bad = any(t in BAD_TAGS for t, _, _ in open_tags)
            inside = inside or not (bad or own)
        open_tags.append((tag, bad or own, inside))
    return found


def label(block: Block, text: str) -> bool | None:
    """First pass: good, bad, or None for undecided."""
    links = block.linked / max(1, sum(map(len, block.parts)))
    if block.inside:
        return False if links > MAX_LINKS_INSIDE and block.item else True if len(text) >= SHORT_CHARS else None
    if links > MAX_LINKS:
        return False
    if len(text) < SHORT_CHARS:
        return None
    words = text.lower().split()
    density = sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / len(words)
    return True if density >= GOOD_WORDS else False if density < BAD_WORDS else None


def settle(labels: list[bool | None], otherwise: bool) -> list[bool]:
    """Second pass: undecided blocks take the label of their nearest decided neighbours."""
    n = len(labels)
    before, after = [None] * n, [None] * n
    last = None
    for i in range(n):
        last = i if labels[i] is not None else last
        before[i] = last
    last = None
    for i in range(n - 1, -1, -1):
        last = i if labels[i] is not None else last
        after[i] = last
    out = []
    for i, own in enumerate(labels):
        a, b = before[i], after[i]
        if own is not None:
            out.append(own)
        elif a is None or b is None:
            out.append(otherwise if a is b else labels[b if a is None else a])
        elif i - a == b - i:
            out.append(labels[a] or labels[b])
        else:
            out.append(labels[a if i - a < b - i else b])
    return out


def main_text(page: str | None) -> str:
    """The text of the good blocks, one line each."""
    found = [(b, " ".join(html.unescape("".join(b.parts)).split())) for b in blocks(page or "")]
    found = [(b, t) for b, t in found if t]
    marked = [(b, t) for b, t in found if b.inside]
    kept = marked or found
    good = settle([label(b, t) for b, t in kept], bool(marked))
    return "\n".join(t for (_, t), g in zip(kept, good) if g)


def extract_text(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` with the main text of ``html_col`` in ``text_col``."""

    @F.pandas_udf("string")
    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(main_text, na_action=None).astype(object)

    return pages.withColumn(text_col, extracted(F.col(html_col).cast("string")))
