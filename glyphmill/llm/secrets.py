"""Secret scans by sliding-window entropy.

Candidates are, first, the values that stand after a key word (password=, token:, secret = "...") of at least `keyed`
characters of any kind but blanks and quotes; then maximal runs of the characters A-Z a-z 0-9 + / _ - of at least `least`
characters, and such runs joined by the marks ! # $ % ^ & * ~. Each belongs to a character class; a window of `window`
characters slides over it, and its Shannon entropy (bits a character) follows from character counts that are changed by one
character in and one out at each step. A candidate shorter than the window is one window of its own length, and its limit
is scaled by the greatest entropy of that length. A candidate whose greatest window entropy reaches its class's limit is a
secret, unless the allow-list suppresses it. A run that overlaps a secret is not reported again.

Classes: digits (digits alone; cards and phone numbers are personal data, so there is a limit after key words alone), hex
(hexadecimal digits with a letter and a digit), upper (capitals and digits), mixed (at least two of capitals, small letters
and digits, a digit among them), letters (mixed case within a word, no digit), plain (one case or a capital first), symbols
(other marks; without a key word it must hold a capital, a small letter and a digit). A dash or underscore counts as a
letter or digit of neither case. Entropy can't tell words from keys in a few letters: plain runs below the window, and short
runs in the shape of words with a number (`shapes`), are reported after key words alone.

Cases: null and empty texts have no secrets; every secret of a text is a row, in repeated rows too; very long texts and
candidates are scanned whole, in linear time; where candidates overlap, values after key words go before runs with marks,
these before other runs; an empty table gives an empty one; other columns don't matter.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.llm.textbuf import raw, slices, strings

ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"


@dataclass(frozen=True)
class Secrets:
    """allow: patterns that suppress a candidate when they match the whole of it; shapes: for runs below the window alone."""

    window: int = 16
    least: int = 8
    keyed: int = 6
    limits: dict[str, float] = field(default_factory=lambda: {"hex": 2.6, "upper": 2.9, "mixed": 3.1, "letters": 3.7, "plain": 3.7, "symbols": 3.1, "digits": 2.6})
    allow: tuple[str, ...] = (
        r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
        r".*(?i:example|sample|placeholder|changeme|dummy).*",
        r"\d{4}-\d{2}-\d{2}[-_T0-9]*",
        r"(?:[A-Za-z]+[-_/+])+[A-Za-z]+\d{0,4}",
        r"(?:0123456789)?abcdef.*",
    )
    shapes: tuple[str, ...] = (
        r"(?:\d{1,4}[-_/+]?)?(?:[A-Z]?[a-z]+|[A-Z]+)(?:[-_/+](?:[A-Z]?[a-z]+|[A-Z]+))*(?:[-_/+]?\d{1,4})?",
        r"[a-z]*(?:[A-Z][a-z]+)+[A-Z]?",
        r"[-_/+]*\d+(?:[-_/+]+\d+)*[-_/+]*",
    )


#: Over small letters.
KEY = re.compile(
    rb"(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credential|(?:api|access|private|auth|encryption|signing|secret)[_ -]?key)s?[\"']?[ \t]*(?:=>|:=|=|:)[ \t]*"
    rb"(?:\"([^\"\n]+)\"|'([^'\n]+)'|([^\s\"'<>]+))",
)
#: Each key word holds one of these.
STEMS = (b"pass", b"pwd", b"secret", b"token", b"credential", b"key")
#: What follows a value rather than ends it: sentence marks, closing brackets, repeated marks.
TAIL = re.compile(rb"(?:[.,;:)\]}]|([!?*#%$&~^])\1+)+$")
MARKS = b"!#$%^&*~"
RISE, TWICE, LOWER, UPPER = map(re.compile, ("[a-z][A-Z]", "[A-Z]{2}", "[a-z]", "[A-Z]"))


def entropies(text: bytes, window: int) -> list[float]:
    """The entropy of each window of the text, from counts that change by two characters a step."""
    table = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    counts = [0] * 256
    total = 0.0
    out = []
    top = math.log2(window)
    for i, c in enumerate(text):
        n = counts[c]
        total += table[n + 1] - table[n] if n < window else 0.0
        counts[c] = n + 1
        if i >= window - 1:
            out.append(top - total / window)
            gone = text[i - window + 1]
            n = counts[gone]
            total -= table[n] - table[n - 1]
            counts[gone] = n - 1
    return out


def kind_of(text: bytes) -> str:
    s = text.decode()
    if text.translate(None, ALPHABET):
        return "symbols"
    digit = any(c.isdigit() for c in s)
    upper = any(c.isupper() for c in s)
    lower = any(c.islower() for c in s)
    if digit and not upper and not lower:
        return "digits"
    if digit and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s):
        return "hex"
    if digit and upper and not lower:
        return "upper"
    if digit:
        return "mixed"
    # two capitals after small letters, or two capitals together, then a small letter, then a capital
    if len(RISE.findall(s)) > 1:
        return "letters"
    twice = TWICE.search(s)
    small = LOWER.search(s, twice.end()) if twice else None
    return "letters" if small and UPPER.search(s, small.end()) else "plain"


def find(array: pa.Array, p: Secrets) -> list[tuple[int, int, int, str, float]]:
    """(text, start, end, class, entropy) of every secret; start and end count characters."""
    data, at = raw(array)
    if not len(data):
        return []

    def table(characters: bytes) -> np.ndarray:
        chosen = np.zeros(256, bool)
        chosen[np.frombuffer(characters, np.uint8)] = True
        return chosen

    def runs(characters: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Where maximal runs of at least p.least of the characters start and end."""
        mask = np.zeros(len(data) + 2, np.int8)
        mask[1:-1] = table(characters)[data]
        edge = np.diff(mask)
        # runs don't cross texts: a text's start ends the run before it
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        crossing = at[1:-1][(mask[at[1:-1]] == 1) & (mask[at[1:-1] + 1] == 1)] if len(at) > 2 else at[:0]
        if len(crossing):
            crossing = np.unique(crossing)
            first, last = np.sort(np.r_[first, crossing]), np.sort(np.r_[last, crossing])
        long = last - first >= p.least
        return first[long], last[long]

    digits, upper, lower = table(b"0123456789"), table(bytes(range(65, 91))), table(bytes(range(97, 123)))

    def count(t: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return np.add.reduceat(np.r_[t[data], False].astype(np.int64), np.c_[first, last].ravel())[::2] if len(first) else first

    first, last = runs(ALPHABET)
    # words of one case, perhaps with a capital first, make up nearly all runs; only long ones can be keys
    worth = (count(digits, first, last) > 0) | (count(upper, first, last) > 1) & (count(lower, first, last) > 0) | (last - first >= p.window)
    first, last = first[worth], last[worth]
    wide, end = runs(ALPHABET + MARKS)
    marked = np.logical_and.reduce([count(t, wide, end) > 0 for t in (table(MARKS), digits, upper, lower)])
    wide, end = wide[marked], end[marked]
    allow, shapes = ([re.compile(x) for x in each] for each in (p.allow, p.shapes))
    found: dict[int, list[tuple[int, int, str, float]]] = {}
    taken = np.zeros(len(data), bool)

    def take(text: int, a: int, b: int, keyed: bool) -> None:
        if taken[a:b].any():
            return
        piece = data[a:b].tobytes()
        kind, short, s = kind_of(piece), b - a < p.window, piece.decode()
        limit = p.limits.get(kind, math.inf)
        if not keyed and (kind == "digits" or kind == "plain" and short or kind == "symbols" and not all(re.search(x, s) for x in ("[a-z]", "[A-Z]", "[0-9]"))):
            return
        if short:
            limit *= math.log2(b - a) / math.log2(p.window)
        most = max(entropies(piece, min(p.window, b - a)))
        if most < limit or any(x.fullmatch(s) for x in allow) or not keyed and short and any(x.fullmatch(s) for x in shapes):
            return
        taken[a:b] = True
        found.setdefault(text, []).append((a, b, kind, round(most, 6)))

    small = data.tobytes().lower()
    for text, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        if not any(small.find(stem, a, b) >= 0 for stem in STEMS):
            continue
        for m in KEY.finditer(small, a, b):
            x, y = m.span(m.lastindex)
            if m.lastindex == 3:
                y = x + len(TAIL.sub(b"", m[3]))
            if y - x >= p.keyed and not re.search(rb"\s", small[x:y]):
                take(text, x, y, True)
    for a, b in zip(wide.tolist(), end.tolist()):
        piece = data[a:b].tobytes()
        a, b = b - len(piece.lstrip(MARKS)), a + len(piece.rstrip(MARKS))
        if b - a >= p.least:
            take(int(np.searchsorted(at, a, side="right")) - 1, a, b, False)
    for text, a, b in zip((np.searchsorted(at, first, side="right") - 1).tolist(), first.tolist(), last.tolist()):
        take(text, a, b, False)
    out = []
    for text in sorted(found):
        # characters before each byte of the text
        before = np.r_[0, np.cumsum((data[at[text] : at[text + 1]] & 0xC0) != 0x80)]
        for a, b, kind, most in sorted(found[text]):
            out.append((text, int(before[a - at[text]]), int(before[b - at[text]]), kind, most))
    return out


def secrets(docs: DataFrame, p: Secrets = Secrets(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, end, class, entropy): every secret of every document, without its text."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([narrow.schema["doc_id"], T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("class", T.StringType()), T.StructField("entropy", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                found = find(strings(batch.column("text")), p)
                if found:
                    ids = batch.column("doc_id").take(pa.array([f[0] for f in found]))
                    rest = [pa.array([f[i] for f in found], k) for i, k in ((1, pa.int64()), (2, pa.int64()), (3, pa.string()), (4, pa.float64()))]
                    yield pa.RecordBatch.from_arrays([ids, *rest], names=schema.names)

    return narrow.mapInArrow(run, schema)
