"""Longest-match lexicon rewriting: X1-X6, X9, X12 and G1 of the survey."""

from __future__ import annotations

import re

Entry = tuple[str, ...]


def compiled(forms: dict[str, list[str]], order: tuple[str, ...] = ("PN", "GN")) -> dict[Entry, str]:
    """Token tuples and their kind; the first kind of `order` wins."""
    out: dict[Entry, str] = {}
    for kind in [*[k for k in order if k in forms], *sorted(set(forms) - set(order))]:
        for form in forms[kind]:
            if key := tuple(form.split()):
                out.setdefault(key, kind)
    return out


def placeholders(text: str | None, lexicon: dict[Entry, str]) -> tuple[str, list[tuple[str, str]]]:
    """(text with numbered placeholders, [(placeholder, what it stands for)]); a repeated match keeps its number."""
    tokens = (text or "").split()
    longest = max(map(len, lexicon), default=0)
    out, known, counts, at = [], {}, {}, 0
    while at < len(tokens):
        for n in range(min(longest, len(tokens) - at), 0, -1):
            if kind := lexicon.get(tuple(tokens[at : at + n])):
                phrase = " ".join(tokens[at : at + n])
                if phrase not in known:
                    counts[kind] = counts.get(kind, 0) + 1
                    known[phrase] = f"<{kind}_{counts[kind]}>"
                out.append(known[phrase])
                at += n
                break
        else:
            out.append(tokens[at])
            at += 1
    return " ".join(out), [(mark, phrase) for phrase, mark in known.items()]


def restored(text: str, pairs: list[tuple[str, str]]) -> str:
    """X5."""
    for mark, phrase in pairs:
        text = text.replace(mark, phrase)
    return text


CORE = re.compile(r"^(\W*)(.*?)(\W*)$", re.S)
UNITS = frozenset("shekel shekels mina minas talent talents textile textiles GÍN MA.NA GÚ TÚG".split())


def number_slots(text: str | None) -> tuple[str, list[tuple[str, str]]]:
    """Numbers and units as <NUM_k> and <UNIT_k>, numbered by value in order of appearance."""
    marks: dict[tuple[str, str], str] = {}
    counts = {"NUM": 0, "UNIT": 0}
    out = []
    for token in (text or "").split():
        before, core, after = CORE.match(token).groups()
        kind = "NUM" if re.fullmatch(r"\d+(?:[.,]\d+)?", core) else "UNIT" if core in UNITS else None
        if kind:
            if (kind, core) not in marks:
                counts[kind] += 1
                marks[kind, core] = f"<{kind}_{counts[kind]}>"
            core = marks[kind, core]
        out.append(before + core + after)
    return " ".join(out), [(mark, core) for (_, core), mark in marks.items()]


def glossed(text: str | None, gloss: dict[Entry, tuple[str, str]], most: int = 6, chars: int = 220) -> str:
    """G1: the text with hints ` <LEX> lemma=gloss | .. </LEX>` of its longest matches, unique by lemma."""
    tokens = (text or "").split()
    longest = max(map(len, gloss), default=0)
    found: dict[str, str] = {}
    at = 0
    while at < len(tokens):
        n = next((n for n in range(min(longest, len(tokens) - at), 0, -1) if tuple(tokens[at : at + n]) in gloss), 0)
        if n:
            lemma, meaning = gloss[tuple(tokens[at : at + n])]
            found.setdefault(lemma, meaning)
        at += max(n, 1)
    hints, size = [], 0
    for lemma, meaning in list(found.items())[:most]:
        hint = f"{lemma}={meaning}"
        size += len(hint) + 3 * bool(hints)
        if size > chars:
            break
        hints.append(hint)
    return (text or "") + (f" <LEX> {' | '.join(hints)} </LEX>" if hints else "")
