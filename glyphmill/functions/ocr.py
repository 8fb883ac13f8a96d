"""Pages of recognised print: noise rules, line numbers and quantities, block hashes, identifiers."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

from glyphmill.functions.normalize import clean

EDGE = ".,;:!?\"'()[]{}<>"
DASH = str.maketrans("–—−", "---")
CURLY = re.compile("[’‘ʾʼ]")
FOLD = dict(zip(map(ord, "šṣṭḫŠṢṬḪ"), "ssthSSTH"))


BROKEN, TRAILING, WIDE = map(re.compile, (r"(?<=\w)-\n(?=\w)", r"[ \t]+\n", r"\n{3,}"))


# ---- pages ----


def one_kind_of_line(text: str | None) -> str:
    """Written line ends, then real ones, as line feeds; soft hyphens gone."""
    for pattern, new in ((r"\\r\\n|\\[nr]", "\n"), ("\r\n?", "\n"), ("\u00ad", "")):
        text = re.sub(pattern, new, text or "")
    return text


def plain_lines(text: str | None) -> str:
    """T20."""
    s = BROKEN.sub("", CURLY.sub("'", one_kind_of_line(text).translate(DASH)))
    return WIDE.sub("\n\n", TRAILING.sub("\n", s))


@dataclass(frozen=True)
class Noise:
    """Patterns of lines that go, and of parts of lines that go; case is ignored."""

    drop: tuple[str, ...] = ()
    remove: tuple[str, ...] = ()

    @classmethod
    def parse(cls, text: str) -> Noise:
        """Rules from lines of mode, tab and pattern; blank lines and those with # are skipped, as are other modes."""
        found: dict[str, list[str]] = {"DROP_LINE": [], "REMOVE_INLINE": []}
        for line in map(str.strip, text.splitlines()):
            mode, _, rest = line.partition("\t")
            pattern = rest.split("\t")[0].strip()
            if pattern and not line.startswith("#") and mode.strip().upper() in found:
                found[mode.strip().upper()].append(pattern)
        return cls(tuple(found["DROP_LINE"]), tuple(found["REMOVE_INLINE"]))


#: Captions, headings, list and journal heads, side marks in four languages; footnote marks and references inside lines.
NOISE = Noise(
    drop=(
        r"^(?:chart|diagram|map|maps|plan|appendix|bibliography|references|index|abstract|chapter|introduction|conclusion|contents|table|tabelle|tafel|tavola|planche|figur|figures?|plates?|notes|comments?)\b",
        r"^(?:list\s+of\s+(?:figures|tables)|catalog(?:ue)?|afo|fig|pl)\b",
        r"^(?:cat|no|nr|abb|taf|tav|anor)\.(?:\s|$)",
        r"^(?:rs|rev|obv|n\.a\.b\.u)\.?(?:\s|$)",
        r"^(?:text|bearbeitung|foto|bemerkungen|anmerkungen):",
        r"^\?+\d+$",
    ),
    remove=(r"(?<!\w)\d+'{1,2}(?!\w)|\b\d+'[a-z]+", r"\bn[or]\.\s*\d+", r"\b\d+\$|\$", r"\[\d+\]|\(\d+\)", r"\b(?:cf|ibid|(?:op|loc)\.\s*cit)\.?\b", r"\*+|[¹²³⁰⁴-⁹†‡]"),
)
#: Signs and words of which a line of transliteration has at least one.
SIGNS = re.compile(
    r"(?i)\{[^}]+\}|\(d\)|<(?:big_)?gap>|[₀-₉ₓ]|\b(?:dumu|ki[šs]ib|igi|dingir|k(?:ù|u|ug)\.babbar|an\.na|g[íi]n|ma[.-]na|t[úu]g|an(?:š|sh)e|urudu|itu)\b",
)
NUMBERED = re.compile(r"(?s)\s*(\d{1,4})(['’‘]{1,2})?([).:])?\s*(.*)$")


def is_transliteration(line: str) -> bool:
    """B12."""
    return bool(SIGNS.search(line))


def filtered(line: str, noise: Noise, stats: Counter, strict: bool = False, prefix: str = "") -> str | None:
    """The line without its noise, or None if it goes; what happened is counted."""

    def gone(why: str) -> None:
        stats[prefix + why] += 1

    if not line:
        return gone("lines_dropped_empty")
    looked = line.lstrip(" -–—•*")
    if re.match(r"\s*\d{1,4}\s*$", looked):
        return gone("page_number_dropped")
    if any(re.search(p, looked, re.I) for p in noise.drop):
        return gone("line_noise_dropped")
    n = 0
    for p in noise.remove:
        line, k = re.subn(p, "", line, flags=re.I)
        n += k
    if n:
        stats[prefix + "inline_noise_removed"] += n
        line = clean(line)
    if not line:
        return gone("lines_dropped_empty")
    return gone("strict_whitelist_drop") if strict and not is_transliteration(line) else line


def translation_page(text: str | None, noise: Noise = NOISE) -> tuple[str, Counter]:
    """A page of running text without its noise; single blank lines stay."""
    stats: Counter = Counter()
    out: list[str] = []
    blank = False
    for line in map(str.strip, plain_lines(text).splitlines()):
        if not line:
            if out and not blank:
                out.append("")
            blank = True
            continue
        blank = False
        stats["translation_lines_total"] += 1
        if (kept := filtered(line, noise, stats, prefix="translation_")) is not None:
            out.append(kept)
    while out and not out[-1]:
        out.pop()
    return "\n".join(out), stats


def bare_token(token: str) -> str:
    """A token in capitals, its dashes and apostrophes plain, without marks at its ends."""
    return CURLY.sub("'", token.translate(DASH)).strip(EDGE).upper()


def unit_tokens(text: str) -> frozenset[str]:
    """The tokens of the second and third column of a tab-separated list; lines without a tab are prose."""
    out = set()
    for line in map(str.strip, text.splitlines()):
        if line.startswith("#"):
            continue
        for cell in line.split("\t")[1:3]:
            for part in re.split("[;/,]", cell):
                if words := part.strip().strip("()[]{}").split():
                    out.add(bare_token(words[0]))
    return frozenset(out - {""})


def is_quantity(token: str, units: frozenset[str]) -> bool:
    """A unit, or one with a suffix after a dash or dot."""
    t = bare_token(token)
    return bool(t) and (t in units or any(sep in t and len(base := t.split(sep)[0]) >= 2 and base in units for sep in "-."))


def transliteration_page(text: str | None, units: frozenset[str] = frozenset(), drop_ambiguous: bool = False, noise: Noise = NOISE, strict: bool = False) -> tuple[str, Counter]:
    """A page of transliteration; numbers at line starts go where they number lines, and stay where they count goods."""
    stats: Counter = Counter()
    out: list[str] = []

    def keep(line: str) -> bool:
        kept = filtered(line, noise, stats, strict)
        if kept is not None:
            out.append(kept)
        return kept is not None

    for line in map(str.strip, plain_lines(text).splitlines()):
        if not line:
            continue
        stats["lines_total"] += 1
        line = CURLY.sub("'", line)
        if re.match(r"\d+\.\d+", line):
            stats["line_start_decimal_keep"] += keep(line)
            continue
        m = NUMBERED.match(line)
        if not m:
            keep(line)
            continue
        stats["line_start_total"] += 1
        rest = m[4].lstrip()
        if m[2]:
            stats["line_start_prime"] += 1
        elif rest and is_quantity(rest.split()[0], units):
            stats["line_start_quantity_keep"] += 1
            keep(line)
            continue
        else:
            stats["line_start_ambiguous"] += 1
            if drop_ambiguous:
                stats["line_start_ambiguous_dropped"] += 1
                continue
        stats["line_number_removed"] += 1
        keep(rest)
    return "\n".join(out), +stats


def block_hash(text: str | None) -> str:
    """B16."""
    return hashlib.md5(unicodedata.normalize("NFKC", clean(one_kind_of_line(text))).encode()).hexdigest()


def without_line_numbers(block: str | None) -> str:
    """T30."""
    lines = (re.sub(r"^\s*\d{1,4}['’]{0,2}[.)]?", "", line).strip() for line in (block or "").splitlines())
    return " ".join(filter(None, lines))


def line_reference(text: str | None) -> tuple[int, int, str]:
    """(number, primes, rest) of a line reference such as 12'a; those without a number come last."""
    s = (text or "").strip()
    m = re.match(r"(?s)(\d+)(.*)$", s)
    return (int(m[1]), m[2].count("'"), m[2].replace("'", "")) if m else (10**9, 0, s)


# ---- identifiers ----


def lookup_form(text: str | None) -> str:
    """Identifiers without accents, in capitals, words of A-Z and 0-9."""
    s = "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c)).translate(FOLD).upper()
    s = re.sub(r"\bCUNEIFORM\s+TABLET\b", " ", s.replace("&", " AND "))
    return clean(re.sub("[^A-Z0-9]+", " ", s))


def lookup_tokens(text: str | None) -> list[str]:
    """L2."""
    return lookup_form(text).split()


def metadata_parts(text: str | None) -> list[str]:
    """L3."""
    return [p.strip() for p in re.split(r"[|;+\n]", text or "") if p.strip()]


MIXED = re.compile(r"[A-Z].*\d|\d.*[A-Z]")


def is_identifier(text: str | None) -> bool:
    """L4: at most six tokens with a digit among them; a lone number is none, and one or two tokens need one that mixes letters and digits."""
    t = lookup_tokens(text)
    if not 0 < len(t) <= 6 or not any(c.isdigit() for x in t for c in x) or len(t) == 1 and t[0].isdigit():
        return False
    return len(t) > 2 or any(map(MIXED.search, t))


def page_number(value: object) -> int | None:
    """L8."""
    try:
        return int(float(str(value).strip()))
    except ValueError:
        return None


def truth(value: object) -> bool:
    """L8."""
    return value if isinstance(value, bool) else str(value).strip().lower() in ("1", "true", "t", "yes", "y")


def lemma(text: str | None) -> str:
    """A lemma as joins need it: plain apostrophes and h, no final m in four letters or more; bound morphemes as they are."""
    s = clean(CURLY.sub("'", text or "").replace("ḫ", "h").replace("Ḫ", "H"))
    return s[:-1] if len(s) >= 4 and s.endswith("m") and not s.startswith("-") else s


def headword(text: str | None) -> tuple[str, str] | None:
    """(lemma, numeral) of a headword that ends in a Roman numeral."""
    first, _, numeral = clean(text).rpartition(" ")
    return (lemma(first), numeral) if first and re.fullmatch("[IVX]+", numeral) else None


def gloss(definition: str | None, most: int = 40) -> str:
    """The first quoted gloss of a definition, else what stands before its first ; [ or (."""
    s = clean(definition)
    m = re.search('"([^"]{1,160})"', s)
    out = m[1] if m else re.split(r"[;\[(]", re.sub(r"^\d+\s*\.\s*", "", s))[0]
    out = out.strip(" .;,:\t")
    return out if len(out) <= most else out[: max(0, most - 3)].rstrip() + "..."
