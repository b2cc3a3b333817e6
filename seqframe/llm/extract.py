"""Main text of web pages by two-pass block rules.

Markup is read once from left to right. Every stretch between block tags is a block,
with its length, the share of it inside links, the density of stop words, and where it
stands: inside <article> or <main>; within a form; in a part of the page that its tag
(nav, footer, aside ...) puts aside; or in one whose role, class or id names it as a menu,
sidebar, notice, advert, comments and so on. A name is a prior on the element that bears
it: an <article> or <main> within starts afresh, and if no prose is left
without the named parts (comments apart), the names of those that hold prose are set aside.

First pass, by densities: blocks that are mostly links and show no prose are bad. Long blocks
with many stop words are good; long ones without are bad, but only on pages whose language has a
list at all, else length decides. Without any good block the longer undecided ones are good. Inside an article fewer letters are enough and
nothing is bad for its lack of stop words. Short blocks stay undecided. Second pass: an undecided
block inherits from its nearest decided neighbours of the same section. If they disagree,
a heading follows the next one, other blocks the nearer one, and what has no neighbour
follows its section: in inside an article, else out.

Character references are decoded, white space inside a block becomes one space, blocks
are trimmed and joined by newlines. Null and empty pages have no text. Whole pages are
read, attributes of any length too; unclosed tags, comments and quotes end with the page at
the latest. One pass over the rows without a shuffle, one output row to each input row,
repeated rows too; other columns are ignored, whatever their names; empty tables give empty results.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqframe.llm.common import row_map

_TAG = re.compile(
    r"<(?:!--(?:.*?-->|.*)"
    r"|(/?)([a-zA-Z][^\s/<>]*)((?:\"[^\"]*+\"|'[^']*+'|[^'\"<>])*+)>"
    r"|(/?)([a-zA-Z][^\s/<>]*)([^<>]*+)>"
    r"|[!?][^>]*>)",
    re.S,
)
_ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_WORD = re.compile(r"[^\W\d_]+")

# Names of HTML elements.
SKIPPED = frozenset("script style noscript template iframe svg canvas select button textarea title object".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
OUTSIDE = frozenset("nav footer aside dialog menu".split())
CONTAINERS = frozenset("html body div section article main nav aside header footer form dialog menu ul ol dl table tbody tr td th figure blockquote details fieldset center".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar".split())
#: Words in class or id that name a part of the page which isn't the article.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification alert popup modal overlay sidebar widget menu nav navbar navigation navi breadcrumb breadcrumbs footer masthead topbar toolbar comment comments commentlist disqus reply replies respond share sharing social related recommended recommendations newsletter subscribe signup login search pagination pager skip copyright paywall".split()
)
#: Those of them that stay aside even if they hold all the prose.
VOICES = frozenset("comment comments commentlist disqus reply replies respond cookie cookies consent gdpr".split())
#: Words of page headers; inside an article they are its title.
HEADER_NAMES = frozenset(["header"])
#: Words that stand beside a name without saying more of a part of an article.
BESIDES = frozenset("area bar block body box btn button buttons card cards container group icon icons inline item items link links list post posts row section slot text title unit wrap".split())
#: In a name, these say that the part itself is something else: "no-comments", "has-sidebar", "sidebar-layout".
OTHERWISE = frozenset("no not has have with without is js hide layout wrapper wrap page container content main body site inner left right col column grid row".split())
# Frequent function words.
STOP_WORDS = {
    "en": "the of and to in a is that it for was on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no than been its who now my made over did down only way find use may long after".split(),
    "fr": "le la les de des du un une et est en que qui dans pour pas sur au avec ce il sont plus par je ne se son sa ses ou mais comme nous vous elle on leur été aux cette être ont tout fait".split(),
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien".split(),
}
LONG, PROSE, LINKED, STOPS = 70, 200, 0.4, 0.25
LINK_RUN = 2  # blocks of links that may stand between good blocks of an article
LISTED = 0.08  # share of stop words in a page's longer blocks from which its language has a list
_WIDE = re.compile("[\u2E80-\u9FFF\uAC00-\uD7AF\uF900-\uFAFF\U00020000-\U0003FFFF]")


class Block:
    __slots__ = ("article", "form", "heading", "label", "linked", "out", "part", "section", "size", "stops", "text", "words")

    def __init__(self, text: str, linked: int, out: bool, part: int, article: bool, form: int, section: int, heading: bool, stop: frozenset):
        self.text, self.out, self.part, self.article, self.form, self.section, self.heading = text, out, part, article, form, section, heading
        self.linked = min(1.0, linked / max(1, len(text)))
        words = _WORD.findall(text.lower())
        self.words = len(words)
        self.stops = sum(w in stop for w in words) / max(1, len(words))
        self.size = len(text) if text.isascii() else len(text) + 2 * len(_WIDE.findall(text))
        self.label: bool | None = None


def _names(attrs: str, article: bool = False, block: bool = False) -> tuple[bool, bool, bool]:
    """Whether the attributes name a part that is out, whether for good, and whether they name a header.
    In an article a name must say nothing else ("related", "share-buttons", but not "related-work"), for
    authors name their parts by what these tell of; ids of its blocks are slugs of their words and say nothing."""
    out = sure = head = False
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            if article and block and name == "id":
                continue
            for word in value.split():
                parts = {p.lower() for p in _PART.findall(word)}
                if article and parts.isdisjoint(VOICES) and not parts <= NAMES | BESIDES:
                    continue
                if parts.isdisjoint(OTHERWISE):
                    out |= not parts.isdisjoint(NAMES)
                    sure |= not parts.isdisjoint(VOICES)
                    head |= not parts.isdisjoint(HEADER_NAMES)
        elif name == "role":
            out |= value.lower() in ROLES
        elif (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            out = sure = True
    return out, sure, head


def blocks(page: str, stop: frozenset) -> list[Block]:
    """The page's blocks in order, without labels."""
    found: list[Block] = []
    # Tag, out by tags (or for good), number of the named part, in the article, number of the form, section.
    stack: list[tuple[str, bool, int, bool, int, int]] = [("", False, 0, False, 0, 0)]
    parts: list[str] = []
    linked = link_depth = sections = breaks = named_parts = forms = 0
    heading = here = False
    at, n = 0, len(page)

    def flush() -> None:
        nonlocal parts, linked, breaks
        if parts:
            raw = "".join(parts)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                _, out, part, article, form, section = stack[-1]
                found.append(Block(text, linked, out or here, part, article, form, section, heading, stop))
            parts, linked = [], 0
        breaks = 0

    def say(text: str) -> None:
        nonlocal linked, breaks
        if text:
            parts.append(text)
            if link_depth:
                linked += len(text.strip())
            if not text.isspace():
                breaks = 0

    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attrs = bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in SKIPPED:
            if not closing and not attrs.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else n
            parts.append(" ")
        elif tag == "a":
            link_depth = 0 if closing else 1
        elif tag == "br":
            breaks += 1
            if breaks > 1:
                flush()
            else:
                parts.append(" ")
        elif tag not in INLINE:
            flush()
            link_depth = 0
            heading = tag in HEADINGS and not closing
            here = False
            if tag in CONTAINERS:
                if closing:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] == tag:
                            del stack[k:]
                            break
                else:
                    _, out, part, article, form, section = stack[-1]
                    named, sure, head = _names(attrs, article) if attrs else (False, False, False)
                    if tag in ("article", "main", "section", "aside", "nav", "footer", "header", "form") or named:
                        sections += 1
                        section = sections
                    if tag in ("html", "body"):
                        named = sure = False
                    if tag in ("article", "main") and not named and not out:
                        article, part, form = True, 0, 0
                    if tag == "form":
                        forms += 1
                        form = forms
                    elif named and not part:
                        named_parts += 1
                        part = named_parts
                    out = out or sure or tag in OUTSIDE or ((tag == "header" or head) and not article)
                    stack.append((tag, out, part, article, form, section))
            elif not closing and attrs:
                here = _names(attrs, stack[-1][3], True)[0]
    flush()
    return found


def _densities(found: list[Block]) -> list[bool | None]:
    """First pass: what length, link density and stop words say of each block, wherever it stands."""
    longer = [b for b in found if b.size >= LONG and b.linked <= LINKED]
    listed = sum(b.stops * b.words for b in longer) >= LISTED * sum(b.words for b in longer)
    page_wide = {b.form for b in longer if b.size >= PROSE and (b.stops >= STOPS or not listed)}  # a form around prose is none
    labels: list[bool | None] = []
    for b in found:
        if b.form in page_wide:
            b.form = 0
        prose = b.stops >= STOPS or not listed
        got: bool | None = None
        if b.linked > LINKED and not (b.stops >= STOPS and b.size >= LONG and b.linked < 0.9):
            got = None if b.heading or (b.article and not b.form) else False
        elif "©" in b.text and not b.article and b.size < LONG:
            got = False
        elif b.article and not b.form:
            got = True if b.size >= LONG or b.stops >= STOPS else None
        elif b.size >= PROSE and prose:
            got = True
        elif (b.size >= LONG and b.stops < STOPS / 2 and listed) or (b.form and b.size < PROSE):
            got = False
        labels.append(got)
    return labels


def label(found: list[Block]) -> list[Block]:
    """Both passes; the blocks with a label each."""
    seen = _densities(found)
    for b, got in zip(found, seen, strict=True):
        b.label = False if b.out or b.part else got
    if not any(b.label for b in found):  # names alone don't empty a page
        prose = {b.part for b, got in zip(found, seen, strict=True) if got and not b.out}
        for b, got in zip(found, seen, strict=True):
            if b.part in prose:
                b.part = 0
                b.label = False if b.out else got
    if not any(b.label for b in found):  # nothing good: the longer ones of what is undecided are
        for b in found:
            if b.label is None and b.size >= LONG:
                b.label = True
    before: list[int | None] = []
    last: dict[int, int] = {}
    for k, b in enumerate(found):
        before.append(last.get(b.section))
        if b.label is not None and not (b.out or b.part or b.linked > LINKED and b.article):
            last[b.section] = k
    after: list[int | None] = [None] * len(found)
    last = {}
    for k in range(len(found) - 1, -1, -1):
        b = found[k]
        after[k] = last.get(b.section)
        if b.label is not None and not (b.out or b.part or b.linked > LINKED and b.article):
            last[b.section] = k
    decided = [b.label for b in found]
    run = [0] * len(found)  # length of the run of blocks of links that a block is in
    for k, b in enumerate(found):
        if b.article and b.linked > LINKED:
            run[k] = run[k - 1] + 1 if k else 1
    for k in range(len(found) - 2, -1, -1):
        if run[k] and run[k + 1]:
            run[k] = run[k + 1]
    for k, b in enumerate(found):
        if decided[k] is None:
            p, f = before[k], after[k]
            if run[k] and not b.heading:  # links between good blocks belong to the text, but for lists of them
                b.label = run[k] <= LINK_RUN and p is not None and f is not None and bool(decided[p] and decided[f])
                continue
            if p is None and f is None:
                b.label = b.article and not b.form
            elif p is None or f is None or decided[p] == decided[f]:
                b.label = decided[p if f is None else f]
            else:
                b.label = decided[f if b.heading or f - k < k - p else p]
    return found


def main_text(page: str | None, stop: frozenset) -> str:
    return "\n".join(b.text for b in label(blocks(page, stop)) if b.label) if page else ""


def extract(pages: DataFrame, *, key: str = "page_id", url: str = "url", page: str = "html", stop_words: dict[str, list[str]] = STOP_WORDS) -> DataFrame:
    """Columns: key, url, text string, n_chars long (code points of text)."""
    stop = frozenset(w for words in stop_words.values() for w in words)

    def fn():
        def row(k, u, p):
            text = main_text(p, stop)
            return k, u, text, len(text)

        return row

    rows = pages.select(F.col(key).cast("long"), F.col(url).cast("string"), page).toDF("k", "u", "p")
    return row_map(rows, fn, "k long, u string, text string, n_chars long", size=lambda r: len(r[2])).toDF(key, url, "text", "n_chars")
