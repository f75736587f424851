"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. Blocks inside menus, headers, footers, sidebars, notices, adverts, forms and reader
comments (by tag, role, class or id) are left out. Classes and ids are only hints, as is a form: where nothing good is left, the one
such part that holds most of the good text is the article after all. The first pass judges every other block by itself: many links are bad; long
blocks with enough stop words are good; short ones, and blocks of an article with few stop words, stay open. In the second pass
an open block takes the label of the nearest decided block before and after it; where these differ, or no block of the
page is good, the article's own open blocks are good and others are bad.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import prepare

SHORT = 70
LONG = 200
STOP_LOW = 0.08
STOP_HIGH = 0.16
LINKS_HIGH = 0.34

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset("""
a about after all also an and any are as at be been but by can could did do for from had has have he her his i if in into is it
its more no not of on one or our out she so some than that the their them then there these they this to up was we were what
when which who will with would you your
aber als am an auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich ihr im
in ist mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war was wie wir zu zum zur
au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou où par pas plus pour qu que
qui sa se ses son sont sur un une vous
al como con del el ella en era es esta este fue ha hay la las lo los más me mi muy no nos o para pero por que se ser si sin
sobre son su sus también todo un una y ya
""".split())

# Tags that end a block, tags without content, tags whose content is not text, and marks of what is not the article.
BLOCK_TAGS = frozenset("""
address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
frame frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section select summary table
tbody td tfoot th thead tr ul
""".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = "script|style|noscript|template|svg|math|iframe|object|textarea|title|canvas|audio|video"
HEAD_TAGS = frozenset("html head base link meta".split())
OUTSIDE_TAGS = frozenset("nav aside footer form button select menu dialog head search option".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
OUTSIDE_NAMES = frozenset("""
ad ads adbox advert adverts advertisement advertising aside banner breadcrumb breadcrumbs comment commentlist comments consent
cookie cookies copyright disqus footer gdpr hidden login masthead menu modal nav navbar navigation newsletter notice notices pager
pagination popup promo promoted promotion related recommended replies reply respond share sharing sidebar signup social sponsor
sponsored subscribe toolbar topbar widget widgets
""".split())
OUTSIDE_HEADERS = frozenset("header".split())
# First and last parts of names that tell of a state (has-sidebar, ad-free), not of what the element is.
STATE_STARTS = frozenset("has have is no non not with without hide hides hidden show shows".split())
STATE_ENDS = frozenset("free less".split())

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW_TAGS})\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s>/]*)((?:[^>"']++|"[^"]*"|'[^']*')*+|[^>]*+)>|<[!?/][^>]*>""",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PART = re.compile(r"[a-z]+")
_WORD = re.compile(r"[^\W\d_]+")


KEPT, HINTED, OUT = 0, 1, 2


def _hinted(value: str, in_article: bool) -> bool:
    """Whether a class or id names something beside the article. Each of its names is taken whole: one that tells of a state is none."""
    for name in value.split():
        parts = _PART.findall(name)
        if not parts or parts[0] in STATE_STARTS and len(parts) > 1 or parts[-1] in STATE_ENDS:
            continue
        if not OUTSIDE_NAMES.isdisjoint(parts) or (not in_article and not OUTSIDE_HEADERS.isdisjoint(parts)):
            return True
    return False


def _outside(tag: str, attributes: str, in_article: bool) -> int:
    if tag == "form":
        return HINTED
    if tag in OUTSIDE_TAGS or (tag == "header" and not in_article):
        return OUT
    if not attributes or tag in ("html", "body", "article", "main"):
        return KEPT
    found = KEPT
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "role" and value in OUTSIDE_ROLES):
            return OUT
        if name == "style" and "display:none" in value.replace(" ", ""):
            return OUT
        if name in ("class", "id") and _hinted(value, in_article):
            found = HINTED
    return found


def blocks(html: str) -> list[tuple[str, int, int, bool, int]]:
    """(text, characters, characters in links, inside an article, part) of the blocks that are in no left-out part (part 0) or only in
    one that is left out on a hint (numbered from 1)."""
    found: list[tuple[str, int, int, bool, int]] = []
    stack: list[tuple[str, int, bool]] = []  # tag, left out, article
    outside = article = links = part = parts = 0
    hard = False  # more than one hint, or a part that is surely no article
    text: list[tuple[str, bool]] = []

    def close_block() -> None:
        if text:
            whole = " ".join("".join(t for t, _ in text).split())
            if whole:
                linked = len(" ".join("".join(t for t, a in text if a).split()))
                found.append((whole, len(whole), linked, article > 0, part if outside else 0))
            text.clear()

    def leave(depth: int) -> None:
        nonlocal outside, article, links, hard
        while len(stack) > depth:
            tag, left_out, own = stack.pop()
            outside -= left_out
            article -= own
            links -= tag == "a"
            hard = outside > HINTED

    def add(chunk: str) -> None:
        if chunk and not hard:
            text.append((unescape(chunk), links > 0))

    at = 0
    for token in _TOKEN.finditer(html):
        add(html[at : token.start()])
        at = token.end()
        raw, closing, tag, attributes = token.groups()
        if tag is None:
            if raw and not hard and raw.lower() not in ("script", "style", "title"):
                text.append((" ", False))
            continue
        tag = tag.lower()
        if tag in BLOCK_TAGS:
            close_block()
        elif tag == "br":
            add(" ")
        if closing:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    if any(s[1] and s[0] in BLOCK_TAGS for s in stack[depth:]):
                        close_block()
                    leave(depth)
                    break
            continue
        if tag in VOID_TAGS:
            continue
        if tag in BLOCK_TAGS and stack:
            # What opens here ends a paragraph; an article or the body also ends the parts around it that are left out.
            names = [s[0] for s in stack]
            if tag in ("article", "main", "body"):
                cut = next((i for i, s in enumerate(stack) if s[1]), len(stack))
                leave(cut)
            elif "head" in names and tag not in HEAD_TAGS:
                leave(names.index("head"))
            elif "p" in names:
                leave(len(names) - 1 - names[::-1].index("p"))
        left_out = _outside(tag, attributes or "", article > 0)
        if left_out == HINTED and tag not in BLOCK_TAGS:
            left_out = OUT  # a piece of a line is no article
        if left_out and not outside:
            parts += 1
            part = parts
        own = tag in ("article", "main")
        stack.append((tag, left_out, own))
        outside += left_out
        hard = outside > HINTED
        article += own
        links += tag == "a"
    add(html[at:])
    close_block()
    return found


def _first_pass(text: str, size: int, linked: int, article: bool) -> str:
    if linked > LINKS_HIGH * size:
        return "bad"
    if size < SHORT:
        return "open"
    words = _WORD.findall(text.lower())
    share = sum(map(STOP_WORDS.__contains__, words)) / max(len(words), 1)
    if share >= STOP_HIGH or (share >= STOP_LOW and size >= LONG):
        return "good"
    return "open" if article or share >= STOP_LOW else "bad"


def _article_parts(html: str) -> list[tuple[str, int, int, bool]]:
    """Blocks in no left-out part; where none of them is good or in an article, also those of the hinted part with most of the good text."""
    every = blocks(html)
    good: dict[int, int] = {}
    for block in every:
        if block[3] or _first_pass(*block[:4]) == "good":
            good[block[4]] = good.get(block[4], 0) + block[1]
    chosen = {0}
    if 0 not in good and good:
        most = max(good, key=lambda k: (good[k], -k))
        if 2 * good[most] > sum(good.values()):
            chosen.add(most)
    return [block[:4] for block in every if block[4] in chosen]


def main_text(html: str) -> str:
    """The article of a whole page: good blocks in page order, joined by a space."""
    parts = _article_parts(html)
    labels = [_first_pass(*part) for part in parts]
    n = len(parts)
    before, last = [""] * n, ""
    for i in range(n):
        before[i] = last
        last = labels[i] if labels[i] != "open" else last
    after, last = [""] * n, ""
    for i in range(n - 1, -1, -1):
        after[i] = last
        last = labels[i] if labels[i] != "open" else last
    decided = any(label == "good" for label in labels)
    kept = []
    for part, label, left, right in zip(parts, labels, before, after):
        if label == "open":
            near = {x for x in (left, right) if x} if decided or not part[3] else set()
            label = near.pop() if len(near) == 1 else ("good" if part[3] else "bad")
        if label == "good":
            kept.append(part[0])
    return " ".join(kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) for every row, from its whole html. No shuffle.

    Null html is empty and gives an empty text. Repeated rows are each answered, alike; an empty table gives no rows; a page of any
    length is read to its end; extra columns are left behind.
    """
    prepare(pages.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x or "") for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(read, f"page_id {kind}, url string, text string")
