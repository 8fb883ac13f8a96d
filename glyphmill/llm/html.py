"""HTML extraction by two-pass block rules.

Pass 1 cuts a page into blocks at block-level tags and classes each by its length, the share of its characters inside
links, and the share of its words that are stop words:
    bad        too many link characters, a copyright sign, or inside select/nav/footer-like or hidden elements
    short      under length_low characters (bad if it has any link)
    good       at least stop_high stop words, and more than length_high characters
    near_good  at least stop_low stop words (or good density, middling length)
    bad        fewer stop words
Pass 2 decides the ambiguous ones from their nearest decided neighbours: a short block becomes good between two good ones
and bad between two bad ones; between a good and a bad one it is good only if a near-good block lies on the bad side
before it. A near-good block is good unless both decided neighbours are bad. A page's ends count as bad. Headings
that stand at most heading_distance characters before a good block are kept with it.

Cases: a null or empty page gives an empty text; tags that never close, bare '<' and unknown entities are read as
browsers do, near enough; very long and malformed pages are read whole, in linear time; a hidden element ends with its own
end tag, not with one of an element inside it; of equally near neighbours both count; repeated pages are extracted alike; an empty table gives an
empty one; other columns don't matter.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.llm.textbuf import SLICE_BYTES, slices

STOP = frozenset(
    """a about after all also an and any are as at be because been but by can could did do for from had has have he her here his
    how i if in into is it its just like more most my no not of on one or other our out over she so some such than that the
    their them then there these they this to up was we were what when which who will with would you your
    aber als am an auch auf aus bei bin bis das dass dem den der des die doch du durch ein eine einem einen einer er es für
    hat haben ich ihr im in ist ja kann können man mit nach nicht noch nur oder sein sich sie sind so um und uns von vor war
    was wenn werden wie wir wird zu zum zur über
    au aux avec ce ces cette comme dans de des du elle en est et eux il ils je la le les leur lui mais me mes moi mon ne nous on
    ont ou où par pas plus pour qu que qui sa sans se ses si son sont sur te toi ton tu un une vous y à été être
    al como con cuando del desde donde e el ella ellos en entre era es esa ese eso esta este esto está fue ha han hay la las le
    les lo los me mi muy más no nos o para pero por porque que quien se sea ser si sin sobre son su sus también te tiene un una
    uno unos y ya""".split()
)
BLOCK = frozenset("address article aside blockquote body br caption center col colgroup dd dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav noframes ol optgroup option p pre section select table tbody td textarea tfoot th thead title tr ul".split())
SILENT = frozenset("script style noscript template head svg math iframe object canvas audio video button".split())
FURNITURE = frozenset("nav footer aside select menu form".split())
HEADING = re.compile(r"h[1-6]$")
NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
PLAIN = re.compile("[^>\"']*")
RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


@dataclass(frozen=True)
class Rules:
    length_low: int = 70
    length_high: int = 200
    stop_low: float = 0.10
    stop_high: float = 0.18
    link_most: float = 0.2
    heading_distance: int = 200


@dataclass
class Block:
    text: str
    tag: str
    link_chars: int
    furniture: bool
    kind: str = ""


class Tags:
    """Where the tags of a page end, in time linear in the page however it is malformed."""

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in ">\"'"}
        #: Places outside quotes from which no '>' outside quotes follows.
        self.dead: set[int] = set()

    def end(self, at: int) -> int:
        """The '>' that ends the tag whose name ends at `at`: the next one outside quotes, else the next one; -1 if none."""
        page, start, seen = self.page, at, []
        if at > self.last[">"]:
            return -1
        while at < len(page):
            at = PLAIN.match(page, at).end()
            if at == len(page):
                break
            c = page[at]
            if c == ">":
                return at
            # a quote without a partner is a character like others
            at = at + 1 if at >= self.last[c] else page.index(c, at + 1) + 1
            if at in self.dead:
                break
            seen.append(at)
        self.dead.update(seen)
        return page.find(">", start)


def blocks(page: str) -> list[Block]:
    """The non-empty blocks of a page in order, white space collapsed."""
    out: list[Block] = []
    parts: list[str] = []
    links = 0
    in_link = 0
    #: Open elements that hide their content, and elements of the same names inside them.
    hidden: list[str] = []
    furniture: list[str] = []
    within: Counter = Counter()
    tag_now = "body"
    place, n = 0, len(page)
    tags = Tags(page)

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, tag_now, links, bool(furniture)))
            parts.clear()
        links = 0

    def say(piece: str) -> None:
        nonlocal links
        if not hidden:
            piece = entities.unescape(piece) if "&" in piece else piece
            parts.append(piece)
            if in_link:
                links += len(" ".join(piece.split()))

    def close(open_: list[str], mark: str, name: str) -> None:
        while (gone := open_.pop()) != name:
            within[mark, gone] -= 1
        within[mark, name] -= 1

    def after(mark: str, start: int) -> tuple[int, int]:
        """(where the mark stands, the place behind it); the page's end if it doesn't."""
        at = page.find(mark, start)
        return (n, n) if at < 0 else (at, at + len(mark))

    while place < n:
        bare = page.find("<", place)
        if bare != place:
            bare = n if bare < 0 else bare
            say(page[place:bare])
            place = bare
            continue
        if page.startswith("<!--", place):
            place = after("-->", place + 4)[1]
            continue
        if page.startswith("<![CDATA[", place):
            stop, behind = after("]]>", place + 9)
            say(page[place + 9 : stop])
            place = behind
            continue
        if page[place + 1 : place + 2] in ("!", "?"):
            place = after(">", place)[1]
            continue
        m = NAME.match(page, place)
        stop = tags.end(m.end()) if m else -1
        if stop < 0:
            say("<")
            place += 1
            continue
        name, attributes = m[2].lower(), page[m.end() : stop]
        place = stop + 1
        if m[1]:
            if within["hidden", name]:
                close(hidden, "hidden", name)
            elif hidden:
                continue
            if name in BLOCK:
                flush()
                tag_now = "body"
            if within["furniture", name]:
                close(furniture, "furniture", name)
            elif name == "a":
                in_link = 0
            continue
        empty = attributes.endswith("/") or name in VOID
        if hidden and name != "body":
            if within["hidden", name] and not empty:
                hidden.append(name)
                within["hidden", name] += 1
            continue
        if name == "body":
            for gone in hidden:
                within["hidden", gone] -= 1
            hidden.clear()
        if name in BLOCK:
            flush()
            tag_now = name
        hides = name in SILENT and not empty
        if name in RAW_END and (name in SILENT or name == "title"):
            end = RAW_END[name].search(page, place)
            place = end.end() if end else n
            continue
        if name in FURNITURE:
            furniture.append(name)
            within["furniture", name] += 1
        elif name == "a":
            in_link = 1
        elif not empty and attributes:
            small = attributes.lower()
            hides = hides or "display:none" in small.replace(" ", "") or bool(HIDDEN.search(small))
        if hides:
            hidden.append(name)
            within["hidden", name] += 1
    flush()
    return out


def classify(found: list[Block], r: Rules) -> None:
    """Pass 1: the kind of each block by itself."""
    for b in found:
        size = len(b.text)
        if b.furniture or b.link_chars > r.link_most * size or "©" in b.text:
            b.kind = "bad"
        elif size < r.length_low:
            b.kind = "bad" if b.link_chars else "short"
        else:
            words = WORD.findall(b.text.lower())
            density = sum(w in STOP for w in words) / len(words) if words else 0.0
            if density >= r.stop_high:
                b.kind = "good" if size > r.length_high else "near_good"
            else:
                b.kind = "near_good" if density >= r.stop_low else "bad"


def decide(found: list[Block], r: Rules) -> list[bool]:
    """Pass 2: whether each block is kept."""
    n = len(found)
    first = [b.kind for b in found]

    def nearest(kinds: list[str], skip: tuple[str, ...]) -> tuple[list[str], list[str]]:
        before, after, last = [], [""] * n, "bad"
        for k in kinds:
            before.append(last)
            if k not in skip:
                last = k
        last = "bad"
        for i in range(n - 1, -1, -1):
            after[i] = last
            if kinds[i] not in skip:
                last = kinds[i]
        return before, after

    before, after = nearest(first, ("short", "near_good"))
    before_any, after_any = nearest(first, ("short",))
    second = list(first)
    for i, k in enumerate(first):
        if k == "short":
            if before[i] == after[i]:
                second[i] = before[i]
            else:
                near = before_any[i] if before[i] == "bad" else after_any[i]
                second[i] = "good" if near == "near_good" else "bad"
    before, after = nearest(second, ("near_good",))
    kept = [k == "good" or k == "near_good" and "good" in (before[i], after[i]) for i, k in enumerate(second)]
    distance, good = 0, False
    for i in range(n - 1, -1, -1):
        if kept[i]:
            distance, good = 0, True
        elif good and HEADING.match(found[i].tag) and first[i] != "bad" and distance <= r.heading_distance:
            kept[i] = True
        else:
            distance += len(found[i].text)
    return kept


def extract(page: str | None, r: Rules = Rules()) -> tuple[str, int, int]:
    """(text of the kept blocks by line, number of blocks, how many are kept)."""
    found = blocks(page or "")
    classify(found, r)
    kept = decide(found, r)
    return "\n".join(b.text for b, k in zip(found, kept) if k), len(found), sum(kept)


def extract_pages(pages: DataFrame, r: Rules = Rules(), page_id: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, text, n_blocks, n_kept) of every page. One pass without a shuffle."""
    narrow = pages.select(F.col(page_id).alias("page_id"), F.col(html).cast("string").alias("html"))
    schema = T.StructType([narrow.schema["page_id"], T.StructField("text", T.StringType()), T.StructField("n_blocks", T.LongType()), T.StructField("n_kept", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "html", 16 * SLICE_BYTES):
                found = [extract(x, r) for x in batch.column("html").to_pylist()]
                columns = [pa.array([f[i] for f in found], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), *columns], names=schema.names)

    return narrow.mapInArrow(run, schema)
