"""Main text of web pages by two passes of block rules.

The page is cut into blocks. The first pass labels a block by its stop-word density, length and
link density; the second gives undecided blocks the label of the nearest decided ones. Blocks
stand in units: an article element, an element with a name of boilerplate, or what is around
them. A unit's kind, its name and the text that the first pass finds in it make one weight, and
units far below the heaviest go. Reader comments go whatever they weigh. Stop words are those
spread over the page itself, so neither a language nor the table around a page has a say.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm.common import carried, sliced, text_of

#: Elements that start or end a block.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav ol "
    "option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
#: Elements whose text is never main text.
DROPPED_TAGS = frozenset("aside audio button canvas datalist dialog fieldset footer head iframe label legend menu nav noscript object optgroup option select svg template textarea title video".split())
#: Elements whose content is not markup; they end at their own end tag only.
RAW_TAGS = frozenset("script style noscript template svg textarea title iframe".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements without an end tag.
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What a class, id or role names that stands around an article.
DROPPED_NAMES = frozenset(
    "ad ads advert advertisement advertisements adverts alert banner breadcrumb breadcrumbs byline comment comments complementary consent contentinfo cookie cookies copyright disclaimer disqus footer form gdpr header "
    "login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promoted promotion recommended related reply replies responses search share "
    "sharing sidebar sidenav signup skip social sponsor sponsored subscribe subscription tags toc toolbar topbar widget widgets".split()
)
#: Those of them that mean what readers wrote.
COMMENT_NAMES = frozenset("comment comments disqus replies reply responses".split())
#: Words at the end of a compound name that only say where or what kind of box it is.
PLACES = frozenset("area bar block body bottom box buttons container content fixed inner item items left link links list main module outer panel posts right row section sticky text thread top unit wrap wrapper".split())
#: Words before the last that make a name say what an element goes without, stands beside or is about.
TURNED = frozenset("has with without no non not of for".split())
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
TAG_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
TAG_SIGN = re.compile(r"[>\"']")
WORD = re.compile(r"[^\W\d_]+")
GOOD, BAD, OPEN = "good", "bad", "open"
SHORTEST, LONG_ENOUGH, MOST_LINKS, ALL_LINKS, LOW_STOPS, HIGH_STOPS = 40, 140, 0.33, 0.9, 0.12, 0.28
#: Stop words that a block is granted before it counts as one without, and the share of the page's own density that is low for it.
GRANTED, LOW_SHARE = 2, 0.4
#: What an article element and a name of boilerplate do to the weight of a unit, and how much of the heaviest a unit must exceed.
ARTICLE_WEIGHT, NAMED_WEIGHT, LEAST_WEIGHT = 4.0, 0.125, 0.25
#: Words are counted by runs of this many; one that stands in such a share of the runs, and in two at least, is a stop word.
RUN_WORDS, SPREAD = 25, 0.15


@dataclass(frozen=True)
class Block:
    """A block of text: how many of its characters are in links, whether it is a heading, the number of its unit."""

    text: str
    links: int
    heading: bool
    unit: int


@dataclass(frozen=True)
class Unit:
    """A part of the page that stays or goes as one: ``kind`` is article, main, named, comment or empty for the rest."""

    kind: str
    weight: float

    def inner(self, kind: str) -> Unit:
        """The unit of an element of this kind within this one; whatever is inside comments is part of them.

        An article within an article is a comment on it, or what it is wrapped in; one within a main
        element weighs as that does, and one within a named element speaks against the name.
        """
        if self.kind == "comment" or kind == "main" and self.kind in ("article", "main"):
            return self
        if kind == "comment":
            return Unit(kind, 0.0)
        if kind == "named":
            return Unit(kind, self.weight * NAMED_WEIGHT / (ARTICLE_WEIGHT if self.kind in ("article", "main") else 1))
        return Unit(kind, self.weight * {"article": 1 / ARTICLE_WEIGHT, "main": 1, "named": ARTICLE_WEIGHT**2}.get(self.kind, ARTICLE_WEIGHT))


def _last_word_of_weight(name: str) -> tuple[str, list[str]]:
    """The last word that is no place or kind of box, and those before it."""
    words = [w.lower() for w in NAME_PARTS.findall(name)]
    while len(words) > 1 and words[-1] in PLACES:
        words.pop()
    return (words[-1], words[:-1]) if words else ("", [])


def names_boilerplate(name: str) -> bool:
    """Whether a class, id or role is that of something around an article, as its last word of weight says.

    ``cookie-notice`` and ``sidebar-right`` are; ``notice-of-works``, ``ad-free`` and ``has-sidebar`` are not.
    """
    last, before = _last_word_of_weight(name)
    return last in DROPPED_NAMES and not TURNED.intersection(before)


def names_comments(name: str, alone: bool = False) -> bool:
    """Whether a name is that of reader comments; with ``alone``, whether it has no other word of weight."""
    last, before = _last_word_of_weight(name)
    return last in COMMENT_NAMES and not (before if alone else TURNED.intersection(before))


def _hidden_and_names(attributes: str) -> tuple[bool, list[str]]:
    """Whether the attributes hide the element, and its classes, id and role."""
    hidden, names = False, []
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key in ("class", "id", "role"):
            names += value.split()
        elif key == "hidden":
            hidden = hidden or value.lower() != "false"
        elif key == "style":
            hidden = hidden or "display:none" in value.lower().replace(" ", "")
    return hidden, names


def unit_kind(tag: str, names: list[str]) -> str:
    """The kind of unit that an element begins, empty if none. Of an article element only the name of a comment is believed."""
    if tag in ("article", "main"):
        return "comment" if any(names_comments(x, alone=True) for x in names) else tag
    if tag in ("html", "body"):
        return ""
    if any(map(names_comments, names)):
        return "comment"
    return "named" if tag == "form" or any(map(names_boilerplate, names)) else ""


def tokens(page: str) -> Iterable[tuple[str, str, str]]:
    """(kind, name or text, attributes) of a page from left to right; kinds are text, start and end.

    Reads forward only: a sign that was looked for in vain is not looked for again, so the time
    grows with the length whatever is left open. A tag without its end takes the rest.
    """
    text_from = at = 0
    n = len(page)
    while (at := page.find("<", at)) >= 0:
        sign = page[at + 1 : at + 2]
        closing = sign == "/"
        name = TAG_NAME.match(page, at + 1 + closing)
        if name is None and sign not in ("!", "?", "/"):
            at += 1
            continue
        if text_from < at:
            yield "text", page[text_from:at], ""
        if name is None:
            end_sign = next((b for a, b in (("<!--", "-->"), ("<![CDATA[", "]]>")) if page.startswith(a, at)), ">")
            end = page.find(end_sign, at + 2)
            text_from = at = n if end < 0 else end + len(end_sign)
            continue
        end = name.end()
        while (m := TAG_SIGN.search(page, end)) and m[0] != ">":
            # A quotation mark counts where it begins a value and has its partner.
            close = page.find(m[0], m.end()) if page[max(name.end(), m.start() - 64) : m.start()].rstrip().endswith("=") else -1
            end = max(m.start(), close) + 1
        stop = m.start() if m else n
        tag = name[0].lower()
        if m:
            yield ("end" if closing else "start"), tag, page[name.end() : stop]
        text_from = at = min(stop + 1, n)
        if m and not closing and tag in RAW_TAGS:
            last = re.compile(f"</{tag}", re.I).search(page, at)
            text_from = at = last.start() if last else n
    if text_from < n:
        yield "text", page[text_from:], ""


class _Page:
    """The blocks and units of a page as its elements open and close."""

    def __init__(self):
        self.blocks: list[Block] = []
        self.units = [Unit("", 1.0)]
        self.parts: list[str] = []
        self.stack: list[tuple[str, bool, int]] = []
        self.open: Counter = Counter()
        self.unit, self.links, self.dropped = 0, 0, 0

    def text(self, piece: str) -> None:
        self.parts.append(piece)
        if self.open["a"]:
            self.links += len(piece.strip())

    def close_block(self) -> None:
        if self.parts:
            raw = "".join(self.parts)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            heading = any(self.open[h] for h in HEADINGS) if text else False
            # The heading inside an article's own header is its title.
            if text and not self.dropped and (not self.open["header"] or heading and (self.open["article"] or self.open["main"])):
                self.blocks.append(Block(text, min(self.links, len(text)), heading, self.unit))
            self.parts.clear()
        self.links = 0

    def leave(self) -> str:
        tag, drops, self.unit = self.stack.pop()
        self.open[tag] -= 1
        self.dropped -= drops
        return tag

    def end(self, tag: str) -> None:
        if self.open[tag]:
            if tag in BLOCK_TAGS or self.dropped or self.unit:
                self.close_block()
            while self.leave() != tag:
                pass
        elif tag in BLOCK_TAGS:
            self.close_block()

    def start(self, tag: str, attributes: str) -> None:
        hidden, names = _hidden_and_names(attributes) if attributes else (False, [])
        drops = tag in DROPPED_TAGS or tag in ("script", "style") or hidden
        kind = unit_kind(tag, names)
        if tag in BLOCK_TAGS or drops or kind:
            self.close_block()
        if tag == "p" and self.stack and self.stack[-1][0] == "p":
            self.leave()
        if tag in VOID_TAGS or attributes.rstrip().endswith("/"):
            return
        self.stack.append((tag, drops, self.unit))
        self.open[tag] += 1
        self.dropped += drops
        if kind and (unit := self.units[self.unit].inner(kind)) is not self.units[self.unit]:
            self.units.append(unit)
            self.unit = len(self.units) - 1


def blocks_of(page: str) -> tuple[list[Block], list[Unit]]:
    """The blocks of a page in order, without those in elements that never hold main text, and its units."""
    state = _Page()
    for kind, what, attributes in tokens(page):
        if kind == "text":
            state.text(what)
        elif kind == "end":
            state.end(what)
        else:
            state.start(what, attributes)
    state.close_block()
    return state.blocks, state.units


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def spread_words(texts: Iterable[str]) -> frozenset[str]:
    """The words that stand in a share of SPREAD of all runs of RUN_WORDS words, and in two of them: those of any subject."""
    words = [w for t in texts for w in words_of(t)]
    runs = [set(words[k : k + RUN_WORDS]) for k in range(0, len(words), RUN_WORDS)]
    counts = Counter(w for r in runs for w in r)
    return frozenset(w for w, n in counts.items() if n >= max(2, SPREAD * len(runs)))


def _stops_and_words(text: str, stop_words: frozenset[str]) -> tuple[int, int]:
    words = words_of(text)
    return sum(map(stop_words.__contains__, words)), len(words)


def first_pass(blocks: list[Block], units: list[Unit], stop_words: frozenset[str]) -> tuple[list[str], bool]:
    """A label for each block, and whether stop words had a say on this page.

    Link lists are bad, and so is long text without stop words. Long or dense text is good. The
    rest is open: short blocks and, inside an article, what would be bad for its links or words.
    Low density is measured by that of the page's text, and a few words are no evidence of it.
    Where no block has stop words length decides in their place.
    """
    counts = [_stops_and_words(b.text, stop_words) for b in blocks]
    text = [c for b, c in zip(blocks, counts, strict=True) if b.links <= MOST_LINKS * len(b.text)]
    usual = sum(c for c, _ in text) / max(1, sum(w for _, w in text))
    low, high = min(LOW_STOPS, LOW_SHARE * usual), min(HIGH_STOPS, usual)
    known = usual > 0

    def label(b: Block, stops: int, words: int) -> str:
        n, article = len(b.text), units[b.unit].kind in ("article", "main")
        d = stops / words if words else 0.0
        if b.links > ALL_LINKS * n:
            return OPEN if article and known and d >= low else BAD
        if b.links > MOST_LINKS * n:
            return OPEN if article or known and d >= high else BAD
        if not known:
            return GOOD if n >= LONG_ENOUGH else OPEN
        if n >= SHORTEST and (d >= high or n >= LONG_ENOUGH and d >= low):
            return GOOD
        return OPEN if n < SHORTEST or article or stops + GRANTED >= low * words else BAD

    return [label(b, *c) for b, c in zip(blocks, counts, strict=True)], known


def heavy_units(blocks: list[Block], units: list[Unit], labels: list[str]) -> set[int]:
    """The units that stay: those above LEAST_WEIGHT of the heaviest, comments only where nothing else has text.

    A unit weighs its characters in good blocks, and half of those in open ones, times what its kind and name make of them.
    """
    mass = [0.0] * len(units)
    for b, x in zip(blocks, labels, strict=True):
        mass[b.unit] += {GOOD: 1.0, OPEN: 0.5, BAD: 0.0}[x] * len(b.text)
    weights = [u.weight * m for u, m in zip(units, mass, strict=True)]
    if not any(weights):
        weights = mass
    least = LEAST_WEIGHT * max(weights)
    return {k for k, w in enumerate(weights) if w > least}


def _nearest(labels: list[str]) -> list[tuple[str | None, int]]:
    """The last decided label up to each place, and how far back it is."""
    out, last, at = [], None, 0
    for k, x in enumerate(labels):
        if x != OPEN:
            last, at = x, k
        out.append((last, k - at))
    return out


def second_pass(blocks: list[Block], labels: list[str], known: bool, marked: bool) -> list[str]:
    """Labels without open ones: each takes that of the nearest decided block.

    A heading goes with what follows it. At equal distance from a good and a bad block an open
    one is good, as text runs on more often than it stops. Without stop words there is less to
    go by, and a short block must stand between two good ones. If nothing on the page is
    decided, or all that is decided is bad inside an article (``marked``), the open blocks are its text.
    """
    before, after = _nearest(labels), _nearest(labels[::-1])[::-1]
    alone = GOOD not in labels and (marked or BAD not in labels)
    out = []
    for b, x, (left, d), (right, e) in zip(blocks, labels, before, after, strict=True):
        if x != OPEN:
            out.append(x)
        elif alone:
            out.append(GOOD if b.links <= MOST_LINKS * len(b.text) else BAD)
        elif b.heading and right:
            out.append(right)
        elif not known and not marked:
            out.append(GOOD if left == right == GOOD else BAD)
        elif left and right:
            out.append(left if d < e else right if e < d else GOOD if GOOD in (left, right) else BAD)
        else:
            out.append(left or right)
    return out


def main_text(page: str, stop_words: frozenset[str] | None = None) -> str:
    """The blocks labelled good, in order, joined by one space; without ``stop_words`` the page's own are used."""
    blocks, units = blocks_of(page)
    if stop_words is None:
        stop_words = spread_words(b.text for b in blocks if b.links <= MOST_LINKS * len(b.text) and units[b.unit].kind != "comment")
    first, known = first_pass(blocks, units, stop_words)
    heavy = heavy_units(blocks, units, first)
    kept = [(b, x) for b, x in zip(blocks, first, strict=True) if b.unit in heavy]
    labels = second_pass([b for b, _ in kept], [x for _, x in kept], known, any(units[k].kind in ("article", "main") for k in heavy))
    return " ".join(b.text for (b, _), x in zip(kept, labels, strict=True) if x == GOOD)


def extract_main_text(pages: DataFrame, page: str = "html", keep: tuple[str, ...] = ("page_id", "url"), stop_words: frozenset[str] | None = None) -> DataFrame:
    """Adds text and n_chars (code points) to the columns in ``keep``.

    A page's result follows from the page alone, so nothing is shuffled, written or sent to the
    tasks. A null or empty page, and one without main text, give an empty text. Nothing is
    capped; rows that repeat are each returned; an empty table gives an empty one. Columns not
    named in ``keep`` are not returned; those in it may have any name.
    """
    kept = carried(pages, keep, ("text", "n_chars"))
    width = len(kept.inner)

    def extract(batches):
        for batch in sliced(batches):
            texts = [main_text(x, stop_words) for x in batch.column(width).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*batch.schema.names[:width], "text", "n_chars"])

    inner = pages.select(*kept.inner, text_of(page).alias("_pl_html"))
    return kept.named(inner.mapInArrow(extract, ", ".join([*kept.schema, "text string, n_chars long"])))
