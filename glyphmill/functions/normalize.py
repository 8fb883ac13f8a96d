"""Normalisers that need call-backs, nesting or Unicode folding: T2-T17, T21-T23, M1-M5 of the survey.

Each is a plain function of one text (null counts as empty) and is offered to DataFrames and SQL as an Arrow UDF by
`glyphmill.functions.udfs`. The steps stand in tables, in the order in which they apply.
"""

from __future__ import annotations

import re
import unicodedata

DASHES = dict.fromkeys(map(ord, "–—−"), "-")
APOSTROPHES = dict.fromkeys(map(ord, "‘’ʼʾ"), "'")
QUOTES = dict.fromkeys(map(ord, "“”„"), '"')
LOW_DIGITS = {ord("₀") + i: str(i) for i in range(10)}
HIGH_DIGITS = {ord(c): str(i) for i, c in enumerate("⁰¹²³⁴⁵⁶⁷⁸⁹")}
ACCENTED = dict(zip((v + d for v in "aeiuAEIU" for d in "23"), "áàéèíìúùÁÀÉÈÍÌÚÙ"))
GAP, BIG = "<gap>", "<big_gap>"
HELD = ((BIG, "\ue000"), (GAP, "\ue001"))
#: Determinatives as transcribed; compared after transcription and case folding.
SIGNS = "d mul ki lu2 e2 uru kur mi m gesz geš ĝeš tug2 TÚG dub id2 musen mušen na4 kus kuš u2 HI".split()


def replaced(text: str, table: dict[int, str]) -> str:
    """str.translate by a table whose values are no keys, in a search for each key: many times faster in texts that hold few."""
    if not text.isascii():
        for old, new in table.items():
            text = text.replace(chr(old), new)
    return text


def punctuation(text: str) -> str:
    return replaced(text, DASHES | APOSTROPHES | QUOTES)


def clean(text: str | None) -> str:
    """T1."""
    return " ".join((text or "").split())


def transcribe(text: str) -> str:
    """T4: ASCII transliteration conventions to their Unicode letters, then plain digits (T5)."""
    for old, new in (("s,", "ṣ"), ("S,", "Ṣ"), ("s'", "ś"), ("S'", "Ś"), ("t,", "ṭ"), ("T,", "Ṭ")):
        text = text.replace(old, new)
    text = re.sub("[sS][zZ]", lambda m: "Š" if m[0] == "SZ" else "š", text)
    text = text.replace("h", "ḫ").replace("H", "Ḫ")
    text = replaced(text, HIGH_DIGITS)
    for low in (True, False):
        for plain, letter in ACCENTED.items():
            text = text.replace(plain[0] + ("₂" if plain[1] == "2" else "₃") if low else plain, letter)
    return replaced(text.replace("Xx", "ₓ"), LOW_DIGITS)


FOLDED_SIGNS = frozenset(transcribe(s).casefold() for s in SIGNS)


def is_determinative(text: str) -> bool:
    """T13."""
    return len(text) <= 6 and all(c.isalnum() or c in "₀₁₂₃₄₅₆₇₈₉ₓ" for c in text) and transcribe(text).casefold() in FOLDED_SIGNS


def is_sign_name(text: str) -> bool:
    """Capitals, digits and joining marks alone, one letter at least."""
    letters = [c for c in text if c.isalpha()]
    return bool(letters) and not any(c.islower() for c in letters) and all(c.isalpha() or c.isdigit() or c in ".×-" for c in text)


def is_title(token: str) -> bool:
    """The first cased letter is a capital and both cases occur, bracketed beginnings apart."""
    letters = [c for c in re.sub(r"^(?:\{[^}]+\}|\([^)]*\))+", "", token) if c.isalpha()]
    return bool(letters) and letters[0].isupper() and any(c.islower() for c in letters)


def raised(text: str) -> str:
    """Superscript determinatives become {..}; other raised or lowered text loses its tags."""

    def bare(m: re.Match) -> str:
        inner = re.sub("<[^>]+>", "", m[2]).strip()
        return "{%s}" % inner if inner and m[1].lower() == "sup" and is_determinative(inner) else inner

    for tag in ("sup", "sub"):
        text = re.sub(rf"(?is)<\s*({tag})\b[^>]*>(.*?)</\s*{tag}\s*>", bare, text)
    return text


def without_nested_glosses(text: str) -> str:
    """{( .. )} with balanced parentheses becomes a blank; unbalanced ones stay."""
    out, at = [], 0
    while (start := text.find("{(", at)) >= 0:
        depth = end = 0
        for j in range(start + 1, len(text)):
            depth += (text[j] == "(") - (text[j] == ")")
            if not depth:
                end = j
                break
        if end and text[end + 1 : end + 2] == "}":
            out += [text[at:start], " "]
            at = end + 2
        else:
            out.append(text[at : start + 1])
            at = start + 1
    return "".join(out) + text[at:]


def missing(m: re.Match) -> str:
    """What a bracket with x, dots or nothing stands for."""
    body = m[1]
    n = body.lower().count("x")
    return GAP if 1 <= n < 4 and "…" not in body and "..." not in body else BIG


def held(text: str) -> str:
    for tag, mark in HELD:
        text = text.replace(tag, mark)
    return text


def released(text: str) -> str:
    for tag, mark in HELD:
        text = text.replace(mark, tag)
    return text


def angles(text: str) -> str:
    """T8."""
    return re.sub(">>+", ">", re.sub("<<+", "<", text))


TAGS = r"(?i)</?(?:%s)\b[^>]*>" % "|".join(("sup", "sub", "br", "i", "b", "u", "em", "strong", "span"))
PRIMED = r"(?<!\w)\d+'+(?!\w)"
ORACC = [
    (re.compile(p), r)
    for p, r in (
        (r"<<.*?>>", " "),
        (r"\(#.*?#\)", " "),
        (r"<\(([^)]+)\)>", r"\1"),
        (r"\{\{[^}]*\}\}", " "),
    )
]
AFTER_GLOSSES = [
    (re.compile(p), r)
    for p, r in (
        (r"(?<![^\s({\[])%[A-Za-z0-9]+(?!\S)", " "),
        (r"[*/]\([^)]*\)", " "),
        (r"(?<!\S)P[1-4](?!\S)", " "),
        (r"(?<!\S)(?::['\".:]?|[*/])(?!\S)", " "),
        (r"\|", ""),
        (r"\$\d+", ""),
        (r"\$", ""),
        (r"~[a-z0-9]+", ""),
        (r"@\w+", ""),
        (r"~", ""),
        (r"[;=]", " "),
        (r"[!?#*]", ""),
        (PRIMED, ""),
        (r"[˹˺]", ""),
        (r"(?i)<\s*gap\s*>", GAP),
        (r"(?i)<\s*big_gap\s*>|\{\s*(?:large[\s_-]*break|broken[\s_-]*area)\s*\}", BIG),
    )
]
MISSING_ROUND = re.compile(r"\(([xX.\s?…]+)\)")
MISSING_SQUARE = re.compile(r"\[([xX.\s?…]+)\]")
ROUND = re.compile(r"\(([^)]+)\)")
DAMAGE = re.compile(r"(?i)\b(?:large[\s_-]*break|broken[\s_-]*area|broken\s+lines?|erased|illegible|missing|lacuna)\b")
RUN = re.compile(r"(?i)(?<![A-Z0-9])(?:x(?:[\s-]+x)+|xx+)(?![A-Z0-9])")
UNWRAPPED = ((re.compile(r"<([^>]+)>"), r"\1"), (re.compile(r"\[([^\]]+)\]"), r"\1"))


def _opened(text: str) -> str:
    """T2 up to round brackets: what all variants have in common."""
    s = transcribe(raised(punctuation(text)))
    for pattern, new in ORACC:
        s = pattern.sub(new, s)
    s = without_nested_glosses(s)
    for pattern, new in AFTER_GLOSSES:
        s = pattern.sub(new, s)
    return MISSING_ROUND.sub(missing, s)


def _closed(s: str, determinative: str) -> str:
    """T2 from round brackets on; determinative: how one is written."""

    def parenthesis(m: re.Match) -> str:
        inner = m[1].strip()
        if not inner or is_sign_name(inner) and not is_determinative(inner) and not DAMAGE.search(inner):
            return inner
        if is_determinative(inner):
            return determinative % inner
        return BIG if DAMAGE.search(inner) else " "

    s = ROUND.sub(parenthesis, s)
    s = re.sub(r"…|\.{3,}", BIG, MISSING_SQUARE.sub(missing, s))
    s = held(angles(RUN.sub(BIG, s)))
    s = re.sub(TAGS, "", s)
    s = angles(s)
    for pattern, new in UNWRAPPED:
        s = pattern.sub(new, s)
    s = released(s)
    s = re.sub(r"-(?:\s+-)+", "-", s)
    s = re.sub(r"\{\+\s*", "{", s).replace("/", " ").replace("+", "-").replace(":", " ")
    return re.sub(r"(?<!\S)\.(?!\S)", " ", s)


def _split_hyphens(s: str) -> str:
    return " ".join(t if is_title(t) else t.replace("-", " ") for t in re.sub("[()]", "", s).split())


def transliteration(text: str | None, variant: str = "A") -> str:
    """Variants A (determinatives in parentheses), B (in braces) and C (as B, hyphens and parentheses gone)."""
    if not text:
        return ""
    variant = variant.upper()
    s = _closed(_opened(text), "(%s)" if variant == "A" else "{%s}")
    return clean(_split_hyphens(s) if variant == "C" else s)


def transliterations(text: str | None) -> tuple[str, str, str]:
    """Variants A, B and C at once; where no brackets are left, A and B are the same."""
    if not text:
        return "", "", ""
    opened = _opened(text)
    a = _closed(opened, "(%s)")
    b = _closed(opened, "{%s}") if ROUND.search(opened) else a
    return clean(a), clean(b), clean(_split_hyphens(b))


NUMBER = re.compile(r"\d+(?:\.\d+)?[.,]?")


def without_line_slashes(text: str) -> str:
    """Lone slashes go, unless numbers stand on both sides."""
    t = text.split()
    inner = lambda i: 0 < i < len(t) - 1 and NUMBER.fullmatch(t[i - 1]) and NUMBER.fullmatch(t[i + 1])
    return " ".join(x for i, x in enumerate(t) if x != "/" or inner(i)) if t else text


def without_dangling_quotes(text: str) -> str:
    """Repeated closing quotes become one; one without a partner goes."""
    for q in "\"'":
        text = re.sub(q + "{2,}$", q, text)
    for alone in (lambda q: q not in text[:-1], lambda q: text.count(q) % 2):
        for q in "\"'":
            if text.endswith(q) and alone(q):
                text = text[:-1].rstrip()
    return text


def translation(text: str | None) -> str:
    """T3."""
    if not text:
        return ""
    s = re.sub(TAGS, "", re.sub(PRIMED + "|[˹˺]", "", punctuation(text)))
    s = angles(s)
    for pattern, new in UNWRAPPED:
        s = pattern.sub(new, s)
    return without_dangling_quotes(clean(without_line_slashes(s)))


# ---- numbers ----

VULGAR = {c: (n, d) for c, n, d in zip("½⅓⅔¼¾⅕⅖⅗⅘⅙⅚⅐⅛⅜⅝⅞⅑⅒", (1, 1, 2, 1, 3, 1, 2, 3, 4, 1, 5, 1, 1, 3, 5, 7, 1, 1), (2, 3, 3, 4, 4, 5, 5, 5, 5, 6, 6, 7, 8, 8, 8, 8, 9, 10))}
UNITS = tuple(w + s for w in "mina shekel talent grain litre week month day year".split() for s in ("s", ""))


def decimal_of(whole: int, top: int, bottom: int) -> str | None:
    """M1: halves, thirds and the sixths that have a customary decimal."""
    if bottom not in (2, 3, 6):
        return None
    integer, rest = divmod(whole * bottom + top, bottom)
    if not rest:
        return str(integer)
    tail = {(2, 1): "5", (3, 1): "3333", (3, 2): "6666", (6, 5): "83333"}.get((bottom, rest))
    return f"{integer}.{tail}" if tail else None


def fraction(whole: int, top: int, bottom: int) -> str:
    """M2."""
    return decimal_of(whole, top, bottom) or (f"{whole} " if whole else "") + f"{top} / {bottom}"


def vulgar(text: str) -> str:
    """M3."""
    return re.sub(rf"(?:(\d+)\s*)?([{''.join(VULGAR)}])", lambda m: fraction(int(m[1] or 0), *VULGAR[m[2]]), text)


def written(text: str) -> str:
    """M4: fractions written with a slash, those behind a whole number first."""
    for pattern in (r"\b(\d+)\s+(\d+)\s*/\s*(\d+)\b", r"\b()(\d+)\s*/\s*(\d+)\b"):
        text = re.sub(pattern, lambda m: fraction(int(m[1] or 0), int(m[2]), int(m[3])), text)
    return text


def output(text: str | None, numbers: bool = True, units: bool = True) -> str:
    """Translations as they are handed in."""
    s = vulgar(text or "") if numbers else text or ""
    s = punctuation(unicodedata.normalize("NFKC", s))
    if numbers:
        s = written(s.replace("⁄", "/"))
    if units:
        s = re.sub(rf"(?i)(\d+(?:\.\d+)?)({'|'.join(UNITS)})\b", r"\1 \2", s)
    return clean(s)


# ---- views for audits ----


def nfkc(text: str | None) -> str:
    return unicodedata.normalize("NFKC", text or "")
