"""Main-text extraction with two-pass block rules.

A page is cut into blocks at block-level tags. Pass 1 adds up evidence about each
block alone, in points: the density of its stop words (English, French, German,
Spanish), its length, the part of it that stands in links, and what the markup
around it hints at (inside or beside a marked article; inside a menu, header,
footer, sidebar, notice, advert, form or reader comments, by tag, role, or class
and id words). Many points make a block good, few make it bad; short blocks, whose
stop words say nothing, and those in between stay open. Pass 2 gives each open block
the label of its nearest decided neighbours, within the article or outside it.

An article's mark is believed where articles hold a third of the page's text or
more. Stop words are not asked where they can't be known: in blocks that are mostly
not in Latin letters, and on pages whose longer blocks hold next to none.

Defined results: a null or empty page, or one without text, gives an empty text;
unclosed and stray tags are read as browsers do, roughly; rows that repeat are read
one by one; other columns are ignored, and a kept column named text or n_chars comes
back with _in at the end of its name.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from textlattice.llm.common import kept_columns

STOP_WORDS = frozenset(
    """a about after all also an and any are as at be been but by can could for from had has have he her his how i if in into is it its
    more not of on one or our she so some than that the their them then there these they this to was we were what when which who will with would you your
    au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous
    aber als am auch auf aus bei bis das dass dem den der des die doch durch ein eine einem einen einer er es hat ich im ist mit nach nicht noch nur oder sich sie sind so um und von vor war wie wird zu zum zur
    al como con cuando del donde el ella ellos era eran esta este esto fue ha hay las lo los más me mi muy no nos o para pero por porque ser si sin sobre su sus también te tiene todo una uno y ya""".split()
)
#: Characters of a block whose stop words count, and of a long one.
SHORT, LONG = 70, 200
#: Shares: of stop words among words, of text in links, of a page's text in articles, and of stop words on a page of an unknown language.
STOP_LOW, STOP_HIGH, LINKS, ALL_LINKS, MARKED, UNKNOWN = 0.20, 0.30, 0.25, 0.8, 1 / 3, 0.05
#: Points of evidence. What is said by stop words, length and links together never outweighs IN_OTHER.
MANY_STOPS, SOME_STOPS, FEW_STOPS, LONG_TEXT, LINKED, ALL_LINKED = 3, 2, -2, 1, -3, -7
IN_ARTICLE, BESIDE_ARTICLE, IN_OTHER = 2, -6, -9
#: Points that make a block good, and bad.
KEEP, DROP = 3, -2

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIP = frozenset("script style noscript template svg math iframe object canvas audio video head title select button textarea datalist".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
OUTSIDE = frozenset("nav footer aside form dialog menu fieldset header".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an opening tag closes: an open element of these names above the nearest of the fences.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
NOT_MAIN = frozenset(
    """ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion banner cookie cookies consent gdpr popup modal overlay notice notices alert announcement
    sidebar rail menu menubar nav navbar navigation breadcrumb breadcrumbs toc footer masthead topbar toolbar comment comments commentlist disqus reply replies responses discussion respond
    share sharing social related recommended recommendations trending popular newsletter subscribe subscription signup login search searchbox widget widgets pagination pager skip copyright legal teaser outbrain taboola""".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())

_TAG = re.compile(r"""<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_SPLIT = re.compile(r"[^a-z]+")
_WORD = re.compile(r"[^\W\d_]+")
_LATIN = re.compile(r"[a-z\u00c0-\u024f]")
_CLOSE = {name: re.compile(f"</{name}", re.I) for name in RAW}


class Block:
    __slots__ = ("text", "links", "bad", "article")

    def __init__(self, text: str, links: int, bad: bool, article: bool):
        self.text, self.links, self.bad, self.article = text, links, bad, article


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): (v[1:-1] if v[:1] in "\"'" and v else v) for k, v in _ATTR.findall(raw)}


def _excluded(name: str, raw: str, article: bool) -> bool:
    """Does the element hold something else than the main text?"""
    if name in OUTSIDE and not (name == "header" and article):
        return True
    if not raw or raw.isspace() or name in ("html", "body", "main"):
        return False
    a = _attributes(raw)
    if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", ""), re.I):
        return True
    if a.get("role", "").lower() in ROLES:
        return True
    marks = html.unescape(f"{a.get('class', '')} {a.get('id', '')}").lower()
    if name == "article":
        return any(x in NOT_MAIN for x in marks.split())
    marks = set(_SPLIT.split(marks))
    return bool(marks & NOT_MAIN) or (not article and "header" in marks)


def blocks(page: str) -> Iterator[Block]:
    """The page's text blocks in order."""
    stack: list[tuple[str, bool, bool, bool]] = []  # name, excluded, in an article, in a link
    text: list[str] = []
    out_of: list[str] = []  # text of excluded elements; it makes a block of its own only where nothing else does
    links = at = 0
    bad = article = link = inside = False

    def flush() -> Iterator[Block]:
        nonlocal links, inside
        words = " ".join("".join(text).split())
        lost = "" if words else " ".join("".join(out_of).split())
        if words or lost:
            yield Block(words or lost, links, not words, inside)
        text.clear()
        out_of.clear()
        links, inside = 0, False

    def say(raw: str) -> None:
        """Text counts by where it stands, not by where its block ends."""
        nonlocal links, inside
        if raw:
            raw = html.unescape(raw)
            (out_of if bad else text).append(raw)
            if not raw.isspace():
                inside = inside or article
                if link and not bad:
                    links += len(" ".join(raw.split()))

    def top() -> None:
        nonlocal bad, article, link
        _, bad, article, link = stack[-1] if stack else ("", False, False, False)

    n = len(page)
    while at < n:
        m = _TAG.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, raw = (m[1], m[3]) if m[2] else (m[4], m[6])
        if name in BLOCK or name == "br":
            if name == "br":
                text.append(" ")
            else:
                yield from flush()
        if closing:
            if any(x[0] == name for x in stack):
                while stack.pop()[0] != name:
                    pass
                top()
            continue
        if name in RAW:
            end = _CLOSE[name].search(page, at)
            at = page.find(">", end.start()) + 1 if end else n
            at = at or n
            continue
        if name in BLOCK and name not in ("html", "body"):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    del stack[k:]
                    break
                if stack[k][0] in BLOCK or stack[k][0] in SKIP:
                    break
        if name in ENDS:
            own, fences = ENDS[name]
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in fences:
                    break
                if stack[k][0] in own:
                    del stack[k:]
                    break
        top()
        if name in VOID:
            continue
        out = bad or name in SKIP or _excluded(name, raw, article)
        main = article or not out and (name in ("article", "main") or name not in ("html", "body") and bool(raw) and _attributes(raw).get("role") == "main")
        stack.append((name, out, main, link or name == "a"))
        top()
    yield from flush()


GOOD, BAD, OPEN = 1, 0, None


def _stops(b: Block) -> tuple[int, int, int]:
    """Words, those in Latin letters, and stop words."""
    w = _WORD.findall(b.text.lower())
    return len(w), sum(bool(_LATIN.match(x)) for x in w), sum(x in STOP_WORDS for x in w)


def points(b: Block, stops: tuple[int, int, int], marked: bool, unknown: bool) -> int:
    """Pass 1: the evidence that the block alone gives. marked: the page's article mark is believed; unknown: its stop words aren't known."""
    n = IN_OTHER if b.bad else IN_ARTICLE if b.article else BESIDE_ARTICLE if marked else 0
    share = b.links / len(b.text)
    n += ALL_LINKED if share > ALL_LINKS else LINKED if share > LINKS else 0
    if len(b.text) < SHORT:
        return n
    words, latin, stop = stops
    if unknown or 2 * latin < words:
        n += SOME_STOPS
    else:
        stop /= max(1, words)
        n += MANY_STOPS if stop >= STOP_HIGH else SOME_STOPS if stop >= STOP_LOW else FEW_STOPS
    return n + LONG_TEXT * (len(b.text) >= LONG)


def first_pass(found: list[Block]) -> tuple[list[int | None], bool]:
    """The labels of the blocks taken alone, and whether the article's mark is believed."""
    own = [b for b in found if not b.bad]
    size = sum(len(b.text) for b in own)
    marked = size > 0 and sum(len(b.text) for b in own if b.article) >= MARKED * size
    stops = [_stops(b) if len(b.text) >= SHORT and not b.bad else (0, 0, 0) for b in found]
    unknown = sum(x[2] for x in stops) < UNKNOWN * sum(x[1] for x in stops)
    got = [points(b, x, marked, unknown) for b, x in zip(found, stops, strict=True)]
    return [GOOD if n >= KEEP else BAD if n <= DROP else OPEN for n in got], marked


def second_pass(found: list[Block], first: list[int | None], marked: bool) -> list[int]:
    """Open blocks take the label of the nearest decided block on either side; where the two differ, of the nearer one.

    What menus and the like hold says nothing about its neighbours, and with a believed mark neither does what stands
    on the other side of the article's edge. Within it a block only goes if both sides are bad; without any decided
    neighbour a block stays.
    """
    n = len(found)
    sides = []
    for order in (range(n), range(n - 1, -1, -1)):
        near: dict[bool, tuple[int, int]] = {}
        side = [(n + 1, OPEN)] * n
        for i in order:
            region = marked and found[i].article
            if first[i] is OPEN:
                at, x = near.get(region, (0, OPEN))
                side[i] = (abs(i - at), x) if x is not OPEN else side[i]
            elif not found[i].bad:
                near[region] = (i, first[i])
        sides.append(side)
    out = []
    for i, x in enumerate(first):
        if x is OPEN:
            known = [s for s in (sides[0][i], sides[1][i]) if s[1] is not OPEN]
            if marked and found[i].article:
                x = BAD if len(known) == 2 and not any(s[1] for s in known) else GOOD
            else:
                x = min(known, key=lambda s: (s[0], -s[1]), default=(0, GOOD))[1]
        out.append(x)
    return out


def main_text(page: str | None) -> list[str]:
    """The blocks of the main text."""
    found = list(blocks(page or ""))
    first, marked = first_pass(found)
    return [b.text for b, x in zip(found, second_pass(found, first, marked), strict=True) if x]


def _extract(names: list[str]):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [" ".join(main_text(x.as_py())) for x in b.column(len(names))]
            yield pa.record_batch([*b.columns[:-1], pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], names=[*names, "text", "n_chars"])

    return f


def extract(pages: DataFrame, keep: list[str], html_col: str = "html") -> DataFrame:
    """The columns named in keep, text (the main text, empty if none) and n_chars (its code points)."""
    own, names, kinds = kept_columns(pages, keep, ["text", "n_chars"])
    d = pages.select(*own, pages[html_col].cast("string").alias("_html"))
    return d.mapInArrow(_extract(names), ", ".join([*kinds, "text string, n_chars long"]))
