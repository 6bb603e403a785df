"""Main text of web pages by the maximum-scoring contiguous region (operator 1).

A page is a sequence of tags and words.  Words score above zero, tags below;
one linear scan finds the contiguous run with the largest sum.  How much each
scores comes from labelled pages: pages that mark their own content with
``<article>`` or ``<main>``.  For every tag, and for words by the element they
stand in, the share inside the marked region sets the weight.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments, known by tag or by a whole class, id or role token, are
neutral for the scan and left out of the text, however long they are.  Only a
page without marked content and text of its own outside them gives up one: the
element that holds most of its words, or an unclosed one or a form around the
content; reader comments never.  Names that only contain such a word (as
"has-sidebar") just give an element's words a weight of their own.  Tags inside
``<article>`` hardly count, so a long list there doesn't part it.

Pages are read in linear time, also damaged ones.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML element names by role.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td "
    "tfoot th thead title tr ul".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong "
    "sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg math object xmp".split())
LEFT_OUT_TAGS = frozenset("head nav header footer aside form menu dialog button select fieldset".split())
LEFT_OUT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice "
    "alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments commentlist disqus reply "
    "replies respond responses sidebar aside nav navbar navigation menu breadcrumb breadcrumbs header masthead footer related recommended pager "
    "pagination toolbar widget widgets search complementary contentinfo discussion discussions talkback guestbook kommentar kommentare comentario "
    "comentarios commentaire commentaires".split()
)
COMMENT_NAMES = frozenset(
    "comment comments commentlist disqus reply replies respond responses discussion discussions talkback guestbook kommentar kommentare comentario "
    "comentarios commentaire commentaires".split()
)
NEUTRAL_NAMES = frozenset("site page main top bottom left right bar box block area section list container wrapper inner item link links form panel".split())
ABOUT_NAMES = frozenset("post article entry reader user".split())
# Which open elements an opening tag ends, and the elements that such an end does not cross.
ENDED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th", "caption"}, {"table"}),
    "body": ({"head"}, set()),
}
CLOSES_P = BLOCKS - {"br", "option", "summary", "caption", "tr", "td", "th", "tbody", "thead", "tfoot", "legend", "title"}

# a tag whose attributes hold no < and no > in quotes ends in one match; others are looked up by _tag_end
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^\"'<>]++|\"[^\"<>]*+\"|'[^'<>]*+')*+)>")
_TAG_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)")
_SIGNS = re.compile("[\"'>]")
_RAW_END = {tag: re.compile(rf"</{tag}\s*+>", re.I) for tag in RAW}
_NAMES = re.compile(r"\b(?:class|id|role)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
#: A page with fewer words outside left-out elements and links has no text of its own.
LEAST_OWN = 20
#: What is left of a tag's weight inside <article>.
INSIDE_ARTICLE = 0.02


def named(attributes: str) -> tuple[bool, bool, bool]:
    """(a whole class, id or role token names something to leave out, a part of one does, it names reader comments)."""
    part = False
    for found in _NAMES.finditer(attributes):
        for token in (found[1] or found[2] or found[3] or "").lower().split():
            pieces = {x for x in _SPLIT.split(token) if x}
            hits = pieces & LEFT_OUT_NAMES
            if hits:
                rest = pieces - LEFT_OUT_NAMES - NEUTRAL_NAMES
                comments = bool(hits & COMMENT_NAMES)
                if not rest or (comments and not rest - ABOUT_NAMES):
                    return True, True, comments
                part = True
    return False, part, False


class _TagEnds:
    """Ends of tags that hold < or unpaired quotes, from one pass over a page from behind."""

    def __init__(self, page: str):
        self.at = [m.start() for m in _SIGNS.finditer(page)]
        n = len(self.at)
        self.quoted, self.plain = [-1] * (n + 1), [-1] * (n + 1)  # outside quotes from each sign on; the next > whatever the quotes
        following = {'"': -1, "'": -1}
        for k in range(n - 1, -1, -1):
            sign = page[self.at[k]]
            if sign == ">":
                self.quoted[k] = self.plain[k] = self.at[k]
                continue
            self.plain[k] = self.plain[k + 1]
            self.quoted[k] = self.quoted[following[sign] + 1] if following[sign] >= 0 else -1
            following[sign] = k

    def find(self, begin: int) -> int:
        """Position of the > that ends a tag whose name ends at begin; quotes that nothing closes are ordinary signs."""
        k = bisect_left(self.at, begin)
        return self.quoted[k] if self.quoted[k] >= 0 else self.plain[k]


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, "") of text runs, ("open" or "close", tag, attributes) of tags; comments, declarations and raw elements are left out."""
    at = i = 0  # what is before at has been given out
    ends: _TagEnds | None = None
    no_end = no_section = False  # nothing ends a tag, or a CDATA section, from here on
    while (i := page.find("<", i)) >= 0:
        begin, raw = i, ""
        found = None
        if page.startswith("<!--", i):
            stop = page.find("-->", i + 4)
            i = stop + 3 if stop >= 0 else len(page)
        elif not no_section and page.startswith("<![CDATA[", i):
            stop = page.find("]]>", i)
            no_section = stop < 0
            if no_section:
                continue
            i = stop + 3
        elif page.startswith(("<!", "<?"), i):
            stop = -1 if no_end else page.find(">", i)
            no_end = stop < 0
            if no_end:
                i += 1
                continue
            i = stop + 1
        else:
            m = None if no_end else _TAG.match(page, i)
            if m:
                found, i = (m[1], m[2].lower(), m[3]), m.end()
            else:
                m = None if no_end else _TAG_NAME.match(page, i)
                if not m:
                    i += 1
                    continue
                ends = ends or _TagEnds(page)
                stop = ends.find(m.end())
                no_end = stop < 0
                if no_end:
                    i += 1
                    continue
                found, i = (m[1], m[2].lower(), page[m.end() : stop]), stop + 1
            if not found[0] and found[1] in RAW and not (found[1] in ("svg", "math") and found[2].endswith("/")):
                raw = found[1]
        if begin > at:
            yield "text", page[at:begin], ""
        if raw:
            m = _RAW_END[raw].search(page, i)
            i = m.end() if m else len(page)
        elif found:
            yield "close" if found[0] else "open", found[1], found[2]
        at = i
    if at < len(page):
        yield "text", page[at:], ""


class _Element:
    """An open element, or one that is left out: its words, the left-out element around it, and what it holds."""

    __slots__ = ("tag", "outer", "hint", "left_out", "by_name", "comments", "words", "content", "closed")

    def __init__(self, tag: str, outer: "_Element | None", hint: bool, left_out: bool, by_name: bool, comments: bool):
        self.tag, self.outer, self.hint, self.left_out, self.by_name, self.comments = tag, outer, hint, left_out, by_name, comments
        self.words, self.content, self.closed = 0, False, False

    def kept(self, own: int, total: int) -> bool:
        """Whether a left-out element holds the content of a page that has own words outside links and such elements, of total."""
        if self.tag == "head" or self.comments:
            return False
        most = 2 * self.words > total
        if most and own < LEAST_OWN:
            return True
        return not self.by_name and (self.content or (most and (self.tag == "form" or not self.closed)))


def events(page: str) -> list[tuple[str, str, bool, bool, int]]:
    """(key, text, is block tag, in left-out element, in marked content) of each tag and text run.

    Keys are t:<tag> and w:<element>, from a fixed vocabulary.  Open elements
    form a stack; optional end tags are implied, an end tag closes all that is
    open inside its element, and one without an open element counts for
    nothing.  In marked content: 2 inside <article>, 1 inside <main> alone.
    """
    out: list[tuple[str, str, bool, _Element | None, int]] = []
    stack: list[_Element] = []
    where: dict[str, list[int]] = defaultdict(list)  # places of open elements in the stack, by tag
    left_out: list[_Element] = []
    total = own = own_marked = link = 0

    def marked() -> int:
        return 2 if where["article"] else 1 if where["main"] else 0

    def pop(upto: int, end_tag: bool) -> None:
        stack[upto].closed = end_tag
        for e in stack[upto:]:
            where[e.tag].pop()
        del stack[upto:]

    def around_top() -> _Element | None:
        top = stack[-1] if stack else None
        return top and (top if top.left_out else top.outer)

    for kind, piece, attributes in tokens(page):
        if kind == "text":
            top, around = stack[-1] if stack else None, around_top()
            n = len(piece.split())
            if around is not None:
                around.words += n
            if around is None or around.tag != "head":
                total += 0 if around is not None and around.comments else n
            if around is None:
                own += 0 if link else n
                own_marked += n if marked() else 0
            key = "a" if link else "hint" if top and top.hint else top.tag if top and top.tag in BLOCKS else "body"
            out.append((f"w:{key}", piece, False, around, marked()))
            continue
        tag = piece
        known = tag if tag in BLOCKS or tag in INLINE else "other"
        if kind == "close":
            if tag == "a":
                link = 0
            if where[tag]:
                pop(where[tag][-1], True)
            out.append((f"t:{known}", "", tag in BLOCKS, around_top(), marked()))
            continue
        if tag in CLOSES_P and where["p"] and where["p"][-1] >= len(stack) - 4:
            pop(where["p"][-1], True)
        if tag in ENDED_BY:
            ends, within = ENDED_BY[tag]
            limit = max((where[x][-1] for x in within if where[x]), default=-1)
            first = min((where[x][k] for x in ends if (k := bisect_right(where[x], limit)) < len(where[x])), default=None)
            if first is not None:
                pop(first, True)
        if tag == "a":
            link = 1
        around = around_top()
        if tag not in VOID and not attributes.endswith("/"):
            by_name, part, comments = named(attributes) if attributes and tag not in ("html", "body", "article", "main") else (False, False, False)
            gone = tag in LEFT_OUT_TAGS or by_name
            if gone or tag not in INLINE:
                top = stack[-1] if stack else None
                e = _Element(tag, around, bool(part or (top and top.hint)), gone, by_name and tag not in LEFT_OUT_TAGS, comments or bool(around and around.comments))
                where[tag].append(len(stack))
                stack.append(e)
                if tag in ("article", "main"):
                    for x in reversed(stack):
                        if x.content:
                            break
                        x.content = True
                if gone:
                    left_out.append(e)
                    around = e
        out.append((f"t:{known}", "", tag in BLOCKS, around, marked()))
    for e in reversed(left_out):  # inner ones come later
        if e.outer is not None and not e.comments:
            e.outer.words += e.words
    hidden: dict[int, bool] = {}
    for e in left_out:
        hidden[id(e)] = own_marked > 0 or (e.outer is not None and hidden[id(e.outer)]) or not e.kept(own, total)
    return [(key, text, block, e is not None and hidden[id(e)], inside) for key, text, block, e, inside in out]


def count_page(page: str | None, inside: Counter, outside: Counter) -> None:
    """Add one labelled page's tags and words; a page without a mark adds nothing."""
    found = events(page or "")
    if not any(e[4] for e in found):
        return
    for key, text, _, hidden, marked in found:
        if not hidden:
            (inside if marked else outside)[key] += len(text.split()) if text else key[0] == "t"


#: Pseudo-counts (inside, outside) of keys without labelled pages behind them.
PRIOR = {"t:p": (4, 1), "w:p": (6, 1), "t:li": (1, 2), "w:li": (1, 1), "t:a": (1, 4), "w:a": (1, 4), "t:div": (1, 2), "w:body": (1, 1), "w:hint": (1, 2)}


def weights(inside: dict[str, float], outside: dict[str, float]) -> dict[str, float]:
    """Words: 0.02 to 1.02, tags: -4.02 to -0.02, by the smoothed share inside marked content."""
    out = {}
    for key in {f"{k}:{t}" for k in "tw" for t in (*BLOCKS, *INLINE, "other", "body", "hint")}:
        a, b = PRIOR.get(key, (3, 1) if key[2] == "h" or key[2:] in INLINE else (1, 1))
        share = (inside.get(key, 0) + a) / (inside.get(key, 0) + outside.get(key, 0) + a + b)
        out[key] = 0.02 + share if key[0] == "w" else -0.02 - 4 * (1 - share) ** 2
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """(from, to) of the contiguous run with the largest sum above 0, the first of equal ones; (0, 0) without one."""
    best, best_from, best_to, total, begin = 0.0, 0, 0, 0.0, 0
    for i, x in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, i
        total += x
        if total > best + 1e-12:
            best, best_from, best_to = total, begin, i + 1
    return best_from, best_to


def main_text(page: str | None, weight: dict[str, float]) -> str:
    """Text of the best-scoring region, blocks joined by one space."""
    found = events(page or "")
    # left-out elements are neutral
    begin, end = best_region([0.0 if hidden else weight[key] * (len(text.split()) if text else (key[0] == "t") * (INSIDE_ARTICLE if inside == 2 else 1.0)) for key, text, _, hidden, inside in found])
    parts = []
    for _, text, block, hidden, _ in found[begin:end]:
        if block:
            parts.append(" ")
        if text and not hidden:
            parts.append(html_lib.unescape(text))
    return " ".join("".join(parts).split())


def learn_weights(pages: DataFrame, id_col: str, html_col: str, max_pages: int = 4000) -> dict[str, float]:
    """Weights from about max_pages labelled pages, chosen by a hash of their id.

    Only counts by a fixed vocabulary of about 250 keys reach the driver.
    """
    total = pages.count()
    share = 1.0 if total <= max_pages else max_pages / total
    sample = pages.filter(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1_000_000)) < int(share * 1_000_000)).select(F.col(html_col).alias("page"))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        inside: Counter = Counter()
        outside: Counter = Counter()
        for batch in batches:
            for page in batch["page"]:
                count_page(page, inside, outside)
        keys = sorted({*inside, *outside})
        if keys:  # a frame without rows has no types for Arrow
            yield pd.DataFrame({"key": keys, "i": [float(inside[k]) for k in keys], "o": [float(outside[k]) for k in keys]})

    rows = sample.mapInPandas(counted, "key string, i double, o double").groupBy("key").agg(F.sum("i").alias("i"), F.sum("o").alias("o")).collect()
    return weights({r["key"]: r["i"] for r in rows}, {r["key"]: r["o"] for r in rows})


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weight: dict[str, float] | None = None) -> DataFrame:
    """One row per page: id, url, text, n_chars (code points).

    Unclosed elements end with the element around them.  Null or empty html, or a page without words: empty text.  Whole pages are
    read whatever their length.  Ties between regions: the first one.  Repeated
    rows give repeated results; an empty table an empty one.  Columns other
    than the three named ones are ignored.  ``weight`` skips the learning.
    """
    weight = weight or learn_weights(pages, id_col, html_col)

    def extracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["text"] = [main_text(page, weight) for page in batch.pop("page")]
            yield batch

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("page"))
    return rows.mapInPandas(extracted, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
