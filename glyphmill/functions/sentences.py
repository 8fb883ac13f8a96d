"""Sentence segmentation and counting: N1-N6, N10, N11 and Y1 of the survey."""

from __future__ import annotations

import re

from glyphmill.functions.normalize import clean, translation

DOT = "\ue000"
ABBREVIATIONS = "al ca cf dr e.g ed eds etc fig figs i.e jr mr mrs ms no nos p pp prof rev sr st vol vs".split()
#: Dots inside numbers; after initials and after abbreviations, if a word follows.
PROTECTED = (
    re.compile(r"(?<=\d)\.(?=\d)"),
    re.compile(r"\b(?:[A-Z]\.){2,}(?=\s+\w)"),
    re.compile(r"(?i)\b(?:%s)\.(?=\s+\w)" % "|".join(re.escape(a) for a in sorted(ABBREVIATIONS, key=len, reverse=True))),
)
#: A sentence with its closing mark, quotes after it and blanks; or the rest.
SENTENCE = re.compile(r"(?s).*?[.!?][\"']*\s+|.+")
#: Words before a dot that end no sentence, for counting.
GUARDED = frozenset("e.g i.e etc cf vs mr mrs ms dr prof sr jr st no fig eq vol pp p".split())
LONGEST = max(map(len, GUARDED))


def protected(text: str) -> str:
    """Dots of numbers, initials and abbreviations replaced by a mark."""
    for pattern in PROTECTED:
        text = pattern.sub(lambda m: m[0].replace(".", DOT), text)
    return text


def endings(text: str | None) -> int:
    """Marks that close a sentence before white space or the end."""
    return len(re.findall(r"[.!?](?=[\"')\]]*\s|$)", protected(text or "")))


def split(text: str | None, least: int = 20) -> list[str]:
    """Sentences of the normalised text; those under `least` characters join the one before."""
    whole = protected(translation(text))
    pieces: list[str] = []
    for part in SENTENCE.findall(whole):
        part = part.strip()
        if part.count(";") >= 2 or len(part) + 6 * part.count(DOT) >= 300:
            chunks = [c for c in map(str.strip, part.split(";")) if c]
            pieces += [c + ";" for c in chunks[:-1]] + chunks[-1:]
        elif part:
            pieces.append(part)
    out: list[str] = []
    for piece in pieces:
        piece = piece.replace(DOT, ".")
        if out and len(piece) < least:
            out[-1] += " " + piece
        else:
            out.append(piece)
    return out


def word_before(text: str, at: int) -> str:
    """The last word before a place, without marks at its end; its last characters, if it is longer than guarded ones."""
    while at and text[at - 1].isspace():
        at -= 1
    while at and text[at - 1] in "\"'”’)]}>,":
        at -= 1
    tail = text[max(0, at - LONGEST - 1) : at]
    return "" if not tail or tail[-1].isspace() else tail.split()[-1]


def boundaries(text: str) -> list[tuple[int, int]]:
    """(first, last) place of each closing mark or run of one mark, but for decimals and abbreviations."""
    out = []
    for m in re.finditer(r"(?<!\d)\.+|\.+(?!\d)|\.{2,}|!+|\?+", text):
        if m[0][0] == "." and word_before(text, m.start()).lower() in GUARDED:
            continue
        out.append((m.start(), m.end() - 1))
    return out


def count(text: str | None) -> int:
    """N5."""
    return len(boundaries(clean(text)))


def single(text: str | None, mode: str = "merge") -> str:
    """One sentence. merge joins the others with semicolons; truncate keeps the first.

    Places are those of the text as it was: behind a run of several marks that became one, later ones are off by what it
    lost, which the reference results have too.
    """
    s = clean(text)
    found = boundaries(s)
    if len(found) < 2:
        return s
    if mode == "truncate":
        return s[: found[0][1] + 1].strip()
    letters = list(s)
    for first, last in found[:-1]:
        letters[first : last + 1] = ";"
    return clean(re.sub(r"\s*;\s*", "; ", "".join(letters)))


def packed(text: str | None, most: int = 900) -> list[str]:
    """Sentences packed greedily into chunks of at most `most` characters; longer sentences are cut."""
    out: list[str] = []
    for sentence in re.split(r"(?<=[.!?])\s+", clean(text)):
        for part in (sentence[i : i + most] for i in range(0, len(sentence), most)):
            if out and len(out[-1]) + 1 + len(part) <= most:
                out[-1] += " " + part
            else:
                out.append(part)
    return out
