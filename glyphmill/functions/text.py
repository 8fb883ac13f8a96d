"""Text expressions that stay inside whole-stage code generation: statistics, tokens, n-grams, similarity.

Operators Q1, Q2, Q9-Q14, Q16, B1-B10, L1, L7, R1, R2, T1, T18-T20, T24, T26, T32, N3, N8, N9, D7 and M7 of the survey; `profile` counts them in
one Arrow pass where many are wanted. Null text counts as empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphmill.functions.profile import STOPWORDS

EDGE = ".,;:!?()[]{}<>\"'"


def let(value: Column, body) -> Column:
    """body(value) with value computed once: an expression that stands inside a lambda is computed for every element."""
    return F.transform(F.array(value), body)[0]


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def clean(c: Column) -> Column:
    """White space collapsed to single blanks, ends trimmed."""
    return F.trim(F.regexp_replace(text_or_empty(c), r"\s+", " "))


def tokens(c: Column) -> Column:
    """B10 without stripping: the parts between white space."""
    return F.filter(F.split(text_or_empty(c), r"\s+"), lambda t: t != "")


def count_of(c: Column, kind: str) -> Column:
    """How many characters belong to a regex class, as `\\p{L}`."""
    return F.length(F.regexp_replace(text_or_empty(c), f"[^{kind}]", ""))


def text_stats(c: Column) -> dict[str, Column]:
    """Q1/Q2: length, tokens, and the shares of letters, digits, symbols among non-blank characters, of capitals among letters."""
    size = F.length(text_or_empty(c))
    alpha, digit, upper, space = (count_of(c, k) for k in (r"\p{L}", r"\p{Nd}", r"\p{Lu}", r"\s"))
    content = F.greatest(size - space, F.lit(1))
    return {
        "len": size.cast("long"),
        "tokens": F.size(tokens(c)).cast("long"),
        "alpha_ratio": alpha / content,
        "digit_ratio": digit / content,
        "symbol_ratio": (size - alpha - digit - space) / content,
        "upper_ratio": upper / F.greatest(alpha, F.lit(1)),
    }


def newlines(c: Column) -> Column:
    """Written and real line ends as line feeds, soft hyphens gone."""
    s = F.regexp_replace(text_or_empty(c), r"\\r\\n|\\n|\\r|\r\n|\r", "\n")
    return F.regexp_replace(s, "\u00ad", "")


def ocr_text(c: Column) -> Column:
    """T18, blanks before line ends gone, words joined that a hyphen broke at a line end, at most one empty line."""
    s = F.regexp_replace(newlines(c), "[ \t]+\n", "\n")
    s = F.regexp_replace(s, r"(?U)(?<=\w)-\n(?=\w)", "")
    return F.regexp_replace(s, "\n{3,}", "\n\n")


def cleaner_text(c: Column) -> Column:
    """As T19 with plain dashes and apostrophes, and words joined before blanks at line ends go."""
    s = F.regexp_replace(F.regexp_replace(newlines(c), "[–—−]", "-"), "[’‘ʾʼ]", "'")
    s = F.regexp_replace(F.regexp_replace(s, r"(?U)(?<=\w)-\n(?=\w)", ""), "[ \t]+\n", "\n")
    return F.regexp_replace(s, "\n{3,}", "\n\n")


def without_hints(c: Column, collapse: bool = True) -> Column:
    """The text without <LEX>..</LEX> blocks; T24b leaves its blanks as they are."""
    s = F.regexp_replace(text_or_empty(c), r"(?is)<LEX>.*?</LEX>", " ")
    return clean(s) if collapse else s


ACCENTS = ("áàâäÁÀÂÄéèêëÉÈÊËíìîïÍÌÎÏúùûüÚÙÛÜšŠṣṢṭṬḫḪ", "aaaaAAAAeeeeEEEEiiiiIIIIuuuuUUUUsSsStThH")


def anchor_token(t: Column) -> Column:
    """A token without marks at its ends and without accents, in capitals."""
    return F.upper(F.translate(F.trim(t, F.lit(EDGE)), *ACCENTS))


def truncated(c: Column, most: int) -> Column:
    """The text, cut to `most` characters with dots at its end if it is longer."""
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, max(0, most - 3)), F.lit("...")))


def pipe_list(c: Column) -> Column:
    """The non-blank parts between bars."""
    return F.filter(F.transform(F.split(text_or_empty(c), r"\|"), lambda x: F.trim(x)), lambda x: x != "")


def distinct_list(items: Column) -> Column:
    """Non-blank items, trimmed, each where it stands first."""
    return F.array_distinct(F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != ""))


def with_flag(found: Column, flag: str, when: Column) -> Column:
    """Q14: flags with one more at the end, if it is not there."""
    return F.when(when & ~F.array_contains(found, flag), F.concat(found, F.array(F.lit(flag)))).otherwise(found)


def has_gap(c: Column) -> Column:
    """Q16."""
    return text_or_empty(c).rlike("<gap>|<big_gap>")


def has_determinative(c: Column) -> Column:
    """Q16: a sign in braces."""
    return text_or_empty(c).rlike(r"\{[^}]+\}")


def sentence_endings(c: Column) -> Column:
    """Runs of closing marks that end a word."""
    return F.regexp_count(text_or_empty(c), F.lit(r"[.!?]+"))


def words(c: Column) -> Column:
    """ASCII words of two or more letters, lower-cased."""
    return F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(r"([a-z][a-z']+)"), F.lit(1))


def stopword_hits(w: Column, language: str) -> Column:
    """B1/B2: how many words are stop words of the language."""
    listed = F.array(*[F.lit(s) for s in STOPWORDS[language]])
    return F.size(F.filter(w, lambda t: F.array_contains(listed, t))).cast("long")


def language_of(hits: dict[str, Column], n_tokens: Column, alpha: Column, upper: Column) -> tuple[Column, Column]:
    """(language with most hits, ties by name; (best - second) / tokens). Without hits 'other' for letters, else 'unknown'."""
    ranked = F.array_sort(F.array(*[F.struct((-h).alias("h"), F.lit(k).alias("k")) for k, h in hits.items()]))
    best, second = -ranked[0]["h"], -ranked[1]["h"]
    none = F.when((alpha >= 0.72) & (upper <= 0.28), "other").otherwise("unknown")
    name = F.when(best > 0, ranked[0]["k"]).otherwise(none)
    return name, F.when(best > 0, (best - second) / F.greatest(n_tokens, F.lit(1))).otherwise(F.lit(0.0))


def translation_score(alpha: Column, hits: Column, confidence: Column) -> Column:
    """B4."""
    return alpha * 0.55 + F.least(hits, F.lit(3)) / 3 * 0.30 + confidence * 0.15


def english_score(alpha: Column, hits: Column) -> Column:
    """B6."""
    return alpha * 0.7 + F.least(hits, F.lit(3)) / 3 * 0.3


def stripped_tokens(c: Column) -> Column:
    """Tokens without punctuation at their ends."""
    return F.filter(F.transform(tokens(c), lambda t: F.trim(t, F.lit(EDGE))), lambda t: t != "")


def is_marker(t: Column) -> Column:
    """A digit, an inner dot, dash or apostrophe, capitals alone, or a letter of the transliteration alphabet."""
    caps = (F.length(t) >= 2) & (t == F.upper(t)) & (t != F.lower(t))
    return t.rlike(r"[0-9.\-'ŠḪṢṬšḫṣṭ]") | caps


def marker_share(t: Column) -> Column:
    """B8 of an array of tokens."""
    return F.size(F.filter(t, is_marker)) / F.greatest(F.size(t), F.lit(1))


def marker_ratio(c: Column) -> Column:
    return marker_share(stripped_tokens(c))


def anchors(c: Column, least: int = 4) -> Column:
    """L1: distinct upper-cased tokens that hold a digit or have `least` characters."""
    up = F.transform(stripped_tokens(c), lambda t: F.upper(t))
    return F.array_distinct(F.filter(up, lambda t: t.rlike("[0-9]") | (F.length(t) >= least)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 where either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(a, b)))


def chars(c: Column) -> Column:
    """The characters of a text."""
    return F.regexp_extract_all(text_or_empty(c), F.lit("(?s)."), F.lit(0))


def windows(items: Column, n: int, separator: str = "") -> Column:
    """The runs of n neighbours of an array of strings, joined; none where it is shorter."""
    joined = lambda x: F.transform(F.sequence(F.lit(0), F.size(x) - n), lambda i: F.concat_ws(separator, *[F.get(x, i + k) for k in range(n)]))
    return let(items, lambda x: F.when(F.size(x) >= n, joined(x)).otherwise(F.array().cast("array<string>")))


def char_ngrams(c: Column, n: int) -> Column:
    """R2: the set of n-grams of the text without white space; a shorter text is its own gram."""
    bare = F.regexp_replace(text_or_empty(c), r"\s+", "")
    return let(bare, lambda s: F.when(F.length(s) == 0, F.array().cast("array<string>")).when(F.length(s) <= n, F.array(s)).otherwise(F.array_distinct(windows(chars(s), n))))


def gram_similarity(a: Column, b: Column) -> Column:
    """R2: Jaccard index of two gram sets; 1 where both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(let(both, lambda n: n / F.greatest(F.size(a) + F.size(b) - n, F.lit(1))))


def blocks(c: Column) -> Column:
    """Parts between blank lines, each on one line; lines where there is only one part."""
    s = F.regexp_replace(text_or_empty(c), "\r\n|\r", "\n")
    flat = lambda parts: F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: p != "")
    wide = flat(F.split(s, "\n{2,}"))
    return F.when(F.size(wide) <= 1, flat(F.split(s, "\n"))).otherwise(wide)


def strip_html(c: Column) -> Column:
    """T3, tag step: inline tags go, the text between them stays."""
    return F.regexp_replace(text_or_empty(c), r"(?i)</?(sup|sub|br|i|b|u|em|strong|span)(\s[^>]*)?>", "")


def pair_scores(n_src: Column, n_tgt: Column) -> tuple[Column, Column]:
    """Q9: (len_ratio, align_score) of token counts."""
    ratio = n_src / F.greatest(n_tgt, F.lit(1))
    return ratio, F.least(n_src, n_tgt) / F.greatest(n_src, n_tgt, F.lit(1))


def flags(*conditions: tuple[str, Column]) -> Column:
    """Q3-Q5: the names whose conditions hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in conditions]))


def punctuation_excess(c: Column) -> Column:
    """Whether closing marks occur more than once."""
    return (F.regexp_count(text_or_empty(c), F.lit("[.!?]")) > 1).cast("int")
