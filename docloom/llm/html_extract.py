"""Main text of HTML pages by two-pass block rules.

A scan of the markup cuts a page into blocks of text and notes each block's place: in a menu, form, notice or
other part that never is content, in the page's article or main part, or elsewhere. Pass one decides blocks by stop-word density,
length and link density; pass two gives short undecided blocks the label of their nearest decided neighbours.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements by their part in a page.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "xmp", "iframe", "noframes", "noembed"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
NEVER = {"nav", "header", "footer", "aside", "form", "button", "select", "option", "menu", "dialog", "head", "svg", "canvas", "object", "audio", "video", "label"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small",
    "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "nobr", "img", "picture", "source",
}
MAIN = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Words in class, id or role that name parts which never are content, or the content itself.
NOT_CONTENT = {
    "ad", "ads", "advert", "advertisement", "adverts", "advertising", "adbox", "adsense", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "consent", "cookie", "cookies", "complementary", "contentinfo",
    "disqus", "dialog", "footer", "form", "gdpr", "header", "legal", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notification", "pager", "pagination", "popup", "privacy",
    "promo", "promotion", "recommended", "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "skyscraper", "social", "sponsor", "sponsored", "subscribe", "subscription",
    "teaser", "toc", "toolbar", "widget", "alert", "topbar", "copyright", "discussion", "responses",
}
CONTENT = {"article", "main", "content", "post", "entry", "story"}
#: Of these, those that make even an article or main element one that is not content.
NOT_ARTICLE = {"ad", "ads", "advert", "advertisement", "comment", "comments", "promo", "recommended", "related", "replies", "reply", "response", "responses", "sponsored", "teaser"}
#: Frequent function words of four languages.
STOP_WORDS = frozenset(
    """
    a about after all also an and any are as at be because been but by can could did do for from had has have he her his how i if in into is it its just like more my no not of on one
    only or other our out over she so some than that the their them then there these they this to up was we were what when which who will with would you your
    au aux avec ce ces cette comme dans de des du elle elles en est et eux il ils je la le les leur lui mais me même mes moi mon ne nos notre nous on ou où par pas pour plus qu que qui
    sa sans se ses son sont sur ta te tes toi ton tu un une vos votre vous été être
    aber als am auch auf aus bei bin bis bist da das dass dem den der des die dies diese durch ein eine einem einen einer eines er es für hat hatte ich ihm ihn ihr ihre im in ist ja
    kann kein keine mehr mit nach nicht noch nur oder sein seine sich sie sind so über um und uns unter vom von vor war was wenn werden wie wir wird zu zum zur
    al algo como con contra cual cuando de del desde donde el ella ellos en entre era es esta este esto fue ha han hasta hay la las le les lo los más me mi muy nada ni no nos o para pero
    por porque que quien se ser si sin sobre son su sus también te tiene todo tu un una uno y ya yo
    """.split()
)

SHORT, LONG = 70, 200  # characters
STOP_LOW, STOP_HIGH = 0.20, 0.30
STOP_LEAST = 0.10  # of a page whose language is one of the four
LINKS = 0.33
FAR = 1 << 60
ARTICLE = 1 << 30

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)(?:>|\Z)""", re.S)
_HINTS = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_PARTS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    links: int = 0
    main: int = 0  # which article (above ARTICLE) or main part it lies in; 0: none
    never: bool = False
    heading: bool = False
    good: bool | None = None


@dataclass
class _Scan:
    blocks: list[Block] = field(default_factory=list)
    pieces: list[str] = field(default_factory=list)
    links: int = 0
    heading: bool = False


def _hints(name: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether class, id or role names a part that never is content; or the content. A header of content is its title."""
    names: set[str] = set()
    for m in _HINTS.finditer(attributes):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, False
        if key in ("class", "id", "role"):
            names.update(x.lower() for x in _PARTS.findall(value))
    content = bool(names & CONTENT)
    if name in MAIN:
        return bool(names & NOT_ARTICLE), content
    bad = names & NOT_CONTENT
    return bool(bad - {"header"} if inside or content else bad), content


def blocks_of(page: str) -> list[Block]:
    """Blocks of visible text in page order."""
    scan = _Scan()
    stack: list[tuple[str, bool, int, bool]] = []  # name, never, main, link
    opened: Counter[str] = Counter()  # how many of each name the stack has
    never, main, link, mains = False, 0, False, 0
    at, broke = 0, False

    def close() -> None:
        if scan.pieces:
            text = " ".join(html.unescape("".join(scan.pieces)).split())
            if text:
                scan.blocks.append(Block(text, scan.links, main, never, scan.heading))
        scan.pieces, scan.links = [], 0

    def say(text: str) -> None:
        nonlocal broke
        if text:
            scan.pieces.append(text)
            if link:
                scan.links += len(text)
            if broke and not text.isspace():
                broke = False

    for m in iter(lambda: _TAG.search(page, at), None):
        say(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:  # an end tag closes what is open up to its start; one without a start says nothing
            if name in INLINE and name != "a":
                continue
            if opened[name]:
                if name not in INLINE:
                    close()
                while stack:
                    top = stack.pop()
                    opened[top[0]] -= 1
                    if top[0] == name:
                        break
                never, main, link = stack[-1][1:] if stack else (False, 0, False)
                if name in HEADINGS:
                    scan.heading = False
            elif name not in INLINE:
                close()
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name == "br":
            if broke:
                close()
            broke = True
            scan.pieces.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                close()
            continue
        if name in INLINE and name != "a":
            continue
        if name != "a":
            close()
            broke = False
            if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") or name in HEADINGS:
                # Their end tags may be missing: a new one closes an open one of its kind.
                kinds = HEADINGS | {"p"} if name == "p" or name in HEADINGS else {name, "p"}
                while stack and (stack[-1][0] in kinds or stack[-1][0] == "a"):
                    opened[stack.pop()[0]] -= 1
                never, main, link = stack[-1][1:] if stack else (False, 0, False)
            if name in HEADINGS:
                scan.heading = True
            elif name == "p":
                scan.heading = False
        bad, content = (False, False)
        if m[3] and name not in ("a", "html", "body"):
            bad, content = _hints(name, m[3], main > 0)
        header = name == "header" and main  # an article's own header holds its title
        never = never or (name in NEVER and not header) or bad
        if not never and (name == "article" and main < ARTICLE or (name == "main" or content) and not main):
            mains += 1
            main = mains + (ARTICLE if name == "article" else 0)
        link = link or name == "a"
        if not m[3].endswith("/"):
            stack.append((name, never, main, link))
            opened[name] += 1
        else:
            never, main, link = stack[-1][1:] if stack else (False, 0, False)
    say(page[at:])
    close()
    return scan.blocks


def _stops(text: str) -> float:
    """Share of stop words."""
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def _untold(blocks: list[Block]) -> bool:
    """Whether no block has the length and stop words to be good, or the text that is not links has hardly any stop words.

    Blocks count by their characters, as a language without spaces has few words.
    """
    told = [(len(b.text), _stops(b.text)) for b in blocks if not b.never and b.links <= LINKS * len(b.text)]
    decided = any(size >= LONG and stops >= STOP_LOW or size >= SHORT and stops >= STOP_HIGH for size, stops in told)
    return not decided or sum(size * stops for size, stops in told) < STOP_LEAST * sum(size for size, _ in told)


def classify(blocks: list[Block]) -> list[Block]:
    """Decide ``good`` of every block.

    Pass one: parts that never are content and link lists are bad; a long block with many stop words is good, one with few
    is bad, and a block of middle length needs many to be good. In an article or main part, whose
    boilerplate is marked as such, few stop words (tables, other languages, names) decide nothing. Pass two: an undecided block takes the label
    of the nearest decided neighbours in its own part of the page; between two it takes good if either is good and
    equally near. A part with no decided block is good if it is an article or main part, else bad. A page without an article or
    main part is one itself if stop words can't tell its text (see :func:`_untold`).
    """
    has_main = any(b.main and not b.never for b in blocks)
    if not has_main and _untold(blocks):
        for b in blocks:
            b.main = 0 if b.never else 1
        has_main = True
    if any(b.main > ARTICLE and not b.never for b in blocks):  # what else a main part holds is around the article
        for b in blocks:
            b.main = b.main if b.main > ARTICLE else 0
    for b in blocks:
        size = len(b.text)
        stops = _stops(b.text)
        density = b.links / size
        if b.never or has_main and not b.main or density > LINKS and not (b.main and b.heading):
            b.good = False
        elif size >= LONG:
            b.good = True if stops >= STOP_LOW else None if b.main else False
        elif size >= SHORT and stops >= STOP_HIGH:
            b.good = True
        elif size >= SHORT and stops < STOP_LOW and not b.main:
            b.good = False
    live = [b for b in blocks if not b.never and (b.main or not has_main)]
    left, right = _nearest(live), _nearest(live[::-1])[::-1]
    for b, (far_left, by_left), (far_right, by_right) in zip(live, left, right):
        if b.good is None:
            near = min(far_left, far_right)
            if near == FAR:
                b.good = bool(b.main)
            else:
                b.good = far_left == near and by_left or far_right == near and by_right
            if b.main and not b.good:
                b.good = b.links / len(b.text) <= LINKS  # next to a list of links in an article is still the article
    return blocks


def _nearest(blocks: list[Block]) -> list[tuple[int, bool]]:
    """For each block how far back the last decided block of its part is, and its label."""
    found, last = [], {}
    for place, b in enumerate(blocks):
        at, good = last.get(b.main, (-FAR, False))
        found.append((min(place - at, FAR), good))
        if b.good is not None:
            last[b.main] = place, b.good
    return found


def main_text(page: str | None) -> str:
    return "\n".join(b.text for b in classify(blocks_of(page)) if b.good) if page else ""


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(p.as_py()) for p in b.column(b.num_columns - 1)]
        columns = [*b.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
        yield pa.record_batch(columns, names=[*b.schema.names[:-1], "text", "n_chars"])


def extract_main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) for each row of ``pages``.

    Null, empty and markup-only pages give the empty text. Markup that is cut short or never closed is read as far
    as it goes. Whole pages of any length are read; repeated rows each give a row; an empty table gives an empty
    result; other columns are not read.
    """
    kind = pages.schema[page_id].dataType.simpleString()
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("html"))
    return rows.mapInArrow(_extract, f"page_id {kind}, url string, text string, n_chars long")
