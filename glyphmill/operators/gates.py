"""Quality gates of sentence pairs, tiers and tranches, row filters with reasons.

A gate is a table of (flag, condition); a limit that is None leaves its condition out. Everything here is a Column or a
narrow transformation: a gate adds no shuffle, but for `ambiguous`, which counts distinct partners.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import text as X
from glyphmill.functions import udfs
from glyphmill.functions.profile import profile, ratios


@dataclass(frozen=True)
class AlignedGate:
    """Limits of Q3; None: no limit."""

    min_len_ratio: float = 0.2
    max_len_ratio: float = 5.0
    min_src_tokens: int = 3
    min_tgt_chars: int = 10
    min_alpha_ratio: float = 0.5
    max_digit_ratio: float = 0.3
    min_align_score: float | None = None
    min_token_align_score: float | None = None
    min_src_alpha_ratio: float | None = None
    max_src_digit_ratio: float | None = None
    max_src_symbol_ratio: float | None = None
    max_tgt_symbol_ratio: float | None = None
    max_tgt_sentence_endings: int | None = None
    min_tgt_tokens: int | None = None
    max_tgt_tokens: int | None = None
    max_src_tokens: int | None = None
    max_src_chars: int | None = None
    max_tgt_chars: int | None = None
    drop_tgt_trailing_quote: bool = False
    drop_tgt_odd_quote: bool = False


@dataclass(frozen=True)
class OcrGate:
    """Limits of Q5."""

    min_len_ratio: float = 0.2
    max_len_ratio: float = 5.0
    min_src_tokens: int = 3
    min_tgt_chars: int = 20
    min_tgt_tokens: int = 4
    max_tgt_tokens: int = 80
    min_tgt_alpha_ratio: float = 0.7
    max_tgt_symbol_ratio: float = 0.2
    max_tgt_digit_ratio: float = 0.2
    max_src_symbol_ratio: float = 0.5
    max_tgt_sentence_endings: int = 1
    min_stopword_hits: int = 1


@dataclass(frozen=True)
class Tier:
    """What a pair needs for a tier (Q7)."""

    name: str
    min_align_score: float
    min_len_ratio: float
    max_len_ratio: float
    min_tgt_alpha_ratio: float
    max_tgt_symbol_ratio: float
    min_stopword_hits: int


HIGH = Tier("high", 0.55, 0.5, 2.2, 0.75, 0.12, 2)
MED = Tier("med", 0.4, 0.35, 3.0, 0.7, 0.18, 1)


def measured_pairs(df: DataFrame, src: str = "src_sent", tgt: str = "tgt_sent") -> DataFrame:
    """df with what gates look at: s and t (profiles with their ratios), scores of Q9, endings and quotes of the target."""
    for side, c in (("s", src), ("t", tgt)):
        df = df.withColumn(side, profile(F.col(c)))
        df = df.withColumn(side, F.struct(f"{side}.*", *[v.alias(k) for k, v in ratios(F.col(side)).items()]))
    s, t = F.col("s"), F.col("t")
    shared = F.when((s["tokens"] > 0) & (t["tokens"] > 0), F.least(s["tokens"], t["tokens"]) / F.greatest(s["tokens"], t["tokens"])).otherwise(F.lit(0.0))
    return df.withColumns(
        {
            "len_ratio": s["len"] / F.greatest(t["len"], F.lit(1)),
            "align_score": F.least(s["len"], t["len"]) / F.greatest(s["len"], t["len"], F.lit(1)),
            "token_align_score": shared,
            "tgt_sentence_ends": udfs.apply("sentence_endings", F.col(tgt)),
            "trailing_quote": F.rtrim(X.text_or_empty(F.col(tgt))).rlike("[\"']$"),
            "odd_quote": F.regexp_count(X.text_or_empty(F.col(tgt)), F.lit('"')) % 2 == 1,
        }
    )


def _outside(value: Column, least=None, most=None) -> Column | None:
    """Whether a value lies outside the limits that there are."""
    found = [c for c in (None if least is None else value < least, None if most is None else value > most) if c is not None]
    return reduce(lambda a, b: a | b, found) if found else None


def aligned_flags(g: AlignedGate) -> Column:
    """Q3 and Q4 (but merged_tgt) of a row of measured_pairs, in the order of the checks."""
    s, t = F.col("s"), F.col("t")
    checks = {
        "empty_src": s["len"] <= 0,
        "empty_tgt": t["len"] <= 0,
        "len_ratio": _outside(F.col("len_ratio"), g.min_len_ratio, g.max_len_ratio),
        "align_score": _outside(F.col("align_score"), g.min_align_score),
        "token_align": _outside(F.col("token_align_score"), g.min_token_align_score),
        "short_src": _outside(s["tokens"], g.min_src_tokens),
        "long_src_tokens": _outside(s["tokens"], None, g.max_src_tokens),
        "long_src_chars": _outside(s["len"], None, g.max_src_chars),
        "short_tgt": _outside(t["len"], g.min_tgt_chars),
        "short_tgt_tokens": _outside(t["tokens"], g.min_tgt_tokens),
        "long_tgt_tokens": _outside(t["tokens"], None, g.max_tgt_tokens),
        "long_tgt_chars": _outside(t["len"], None, g.max_tgt_chars),
        "low_alpha_src": _outside(s["alpha_ratio"], g.min_src_alpha_ratio),
        "digit_heavy_src": _outside(s["digit_ratio"], None, g.max_src_digit_ratio),
        "symbol_heavy_src": _outside(s["symbol_ratio"], None, g.max_src_symbol_ratio),
        "low_alpha_tgt": _outside(t["alpha_ratio"], g.min_alpha_ratio or None),
        "digit_heavy_tgt": _outside(t["digit_ratio"], None, g.max_digit_ratio or None),
        "symbol_heavy_tgt": _outside(t["symbol_ratio"], None, g.max_tgt_symbol_ratio),
        "multi_sentence_tgt": _outside(F.col("tgt_sentence_ends"), None, g.max_tgt_sentence_endings),
        "control_src": s["n_control"] > 0,
        "control_tgt": t["n_control"] > 0,
        "trailing_quote": F.col("trailing_quote") if g.drop_tgt_trailing_quote else None,
        "odd_quote": F.col("odd_quote") if g.drop_tgt_odd_quote else None,
    }
    return X.flags(*[(k, c) for k, c in checks.items() if c is not None])


def broken_placeholder(c: Column) -> Column:
    """Q12."""
    return F.regexp_replace(X.text_or_empty(c), "(?i)<gap>|<big_gap>", "").rlike("[<>]")


def ocr_flags(g: OcrGate, tgt: str = "tgt_sent") -> Column:
    """Q5 of a row of measured_pairs, in the order of the checks."""
    s, t = F.col("s"), F.col("t")
    return X.flags(
        ("empty_src", s["len"] <= 0),
        ("empty_tgt", t["len"] <= 0),
        ("len_ratio", _outside(F.col("len_ratio"), g.min_len_ratio, g.max_len_ratio)),
        ("short_src", s["tokens"] < g.min_src_tokens),
        ("short_tgt", t["len"] < g.min_tgt_chars),
        ("short_tgt_tokens", t["tokens"] < g.min_tgt_tokens),
        ("long_tgt_tokens", t["tokens"] > g.max_tgt_tokens),
        ("low_alpha_tgt", t["alpha_ratio"] < g.min_tgt_alpha_ratio),
        ("symbol_heavy_tgt", t["symbol_ratio"] > g.max_tgt_symbol_ratio),
        ("digit_heavy_tgt", t["digit_ratio"] > g.max_tgt_digit_ratio),
        ("symbol_heavy_src", s["symbol_ratio"] > g.max_src_symbol_ratio),
        ("multi_sentence_tgt", F.col("tgt_sentence_ends") > g.max_tgt_sentence_endings),
        ("low_stopword_tgt", t["hits_english"] < g.min_stopword_hits),
        ("broken_placeholder", broken_placeholder(F.col(tgt))),
        ("control_src", s["n_control"] > 0),
        ("control_tgt", t["n_control"] > 0),
    )


def weak_doc_match(matched: Column, score: Column, reason: Column, metadata: float, blocks_only: float) -> Column:
    """Q6: a pair with matched documents whose best one is under the limit of its reason."""
    return (F.size(matched) > 0) & (score < F.when(reason == "blocks_only", blocks_only).otherwise(metadata))


def tier(high: Tier = HIGH, med: Tier = MED) -> Column:
    """Q7."""
    t = F.col("t")

    def fits(r: Tier) -> Column:
        return (F.col("align_score") >= r.min_align_score) & F.col("len_ratio").between(r.min_len_ratio, r.max_len_ratio) & (t["alpha_ratio"] >= r.min_tgt_alpha_ratio) & (t["symbol_ratio"] <= r.max_tgt_symbol_ratio) & (t["hits_english"] >= r.min_stopword_hits)

    return F.when(fits(high), high.name).when(fits(med), med.name).otherwise("low")


def tranche(flags: Column, grade: Column, translated: Column, lang: Column, reason: Column, doc: Column, metadata: Column, strong_doc: float = 0.12, strong_metadata: float = 1.0) -> Column:
    """Q8: T1 to T5."""
    own = (grade == "high") & ~translated & (lang == "en")
    strong = (reason != "blocks_only") & (doc >= strong_doc) & (metadata >= strong_metadata)
    return F.when(F.size(flags) > 0, "T5").when(own & strong, "T1").when(own, "T2").when(grade.isin("high", "med") & translated, "T3").when(grade == "med", "T4").otherwise("T5")


def tranche_rank(c: Column) -> Column:
    """Q15: T1 to T5 as 1 to 5, all else 999."""
    return F.when(F.upper(c).rlike("^T[1-5]$"), F.substring(c, 2, 1).cast("int")).otherwise(F.lit(999))


def quality_score(align: Column, doc: Column, metadata: Column) -> Column:
    """Q10."""
    return align + doc * 0.35 + metadata * 0.1


def outlier(low: Column, high: Column, g: AlignedGate) -> Column:
    """M8: by how much the length ratios of a document leave the gate's limits; 1e9 where one is zero."""
    under = F.when(low < g.min_len_ratio, g.min_len_ratio / F.greatest(low, F.lit(1e-9))).otherwise(F.lit(0.0))
    over = F.when(high > g.max_len_ratio, high / max(g.max_len_ratio, 1e-9)).otherwise(F.lit(0.0))
    return F.when(low <= 0, F.lit(1e9)).otherwise(F.greatest(under, over))


def ambiguous(df: DataFrame, flag: str, key: str, partner: str, most: int) -> DataFrame:
    """A1: df with a flag on the rows whose key has more than `most` distinct partners.

    Pairs are made distinct before they are counted, so a key in a third of all rows is counted by many tasks.
    """
    counts = df.select(key, partner).distinct().groupBy(key).agg(F.count(partner).alias("_partners")).where(F.col("_partners") > most).select(F.col(key).alias("_key"))
    joined = df.join(counts, F.col(key) == F.col("_key"), "left")
    return joined.withColumn("flags", X.with_flag(F.col("flags"), flag, F.col("_key").isNotNull())).drop("_key")


def prepared(df: DataFrame, src: str, tgt: str, variant: str | None = None, drop_flagged: bool = False, norm_variant: str | None = None, max_src: int | None = None, max_tgt: int | None = None) -> DataFrame:
    """Rows of a variant without flags, texts normalised, neither of them blank or too long."""
    if variant and "src_norm_variant" in df.columns:
        df = df.where(F.col("src_norm_variant") == variant)
    if drop_flagged and "flags" in df.columns:
        df = df.where(F.trim(F.coalesce(F.col("flags").cast("string"), F.lit(""))) == "")
    source = udfs.apply(f"normalize_transliteration_{norm_variant.lower()}", F.col(src)) if norm_variant else X.clean(F.col(src))
    df = df.withColumns({src: source, tgt: X.clean(F.col(tgt))}).where((F.col(src) != "") & (F.col(tgt) != ""))
    for c, most in ((src, max_src), (tgt, max_tgt)):
        df = df if most is None else df.where(F.length(c) <= most)
    return df


def among(df: DataFrame, **wanted: list[str]) -> DataFrame:
    """Rows whose columns have one of the wanted values, in any case; a column that isn't there is no condition."""
    for name, values in wanted.items():
        if values and name in df.columns:
            df = df.where(F.upper(F.coalesce(F.col(name).cast("string"), F.lit(""))).isin([v.upper() for v in values]))
    return df


def blank(c: Column) -> Column:
    """Null or white space alone."""
    return F.trim(X.text_or_empty(c)) == ""


def drop_reason(src: Column, tgt: Column, ends: Column, max_src: int | None = None, max_tgt: int | None = None, max_ends: int | None = None) -> Column:
    """Why a row goes (empty, length, sentence), the first reason alone; null if it stays."""
    long = [F.length(c) > most for c, most in ((src, max_src), (tgt, max_tgt)) if most is not None]
    out = F.when((src == "") | (tgt == ""), "empty")
    out = out.when(reduce(lambda a, b: a | b, long), "length") if long else out
    return out.when(ends > max_ends, "sentence") if max_ends is not None else out


def accepted_prototype(sim: Column, prototype: Column, gold: Column, min_sim: float, low: float = 0.0, high: float = 10.0) -> Column:
    """Near enough, and the prototype's length by the gold's (blanks at the ends apart, 1 at least) within limits."""
    a, b = (F.greatest(F.length(F.trim(c)), F.lit(1)) for c in (prototype, gold))
    return (sim >= min_sim) & (a / b).between(low, high)


def candidate_reason(translations: Column, translits: Column, marked: Column, top: Column, gap: Column, min_translations: int = 1, min_translits: int = 1, min_score: float = 0.95, only_score: float = 1.25, only_gap: float = 0.1, single_side: bool = True) -> Column:
    """Why a page is a candidate (metadata_and_blocks, blocks_only, metadata_only); null if it is none."""
    blocks = (translations >= min_translations) & (translits >= min_translits)
    strong = top >= min_score
    alone = (top >= only_score) & (gap >= only_gap) & (translations >= min_translations) & (F.greatest(translations, translits) >= 1)
    out = F.when(blocks & (marked | strong) & strong, "metadata_and_blocks").when(blocks, "blocks_only")
    return out.when(alone, "metadata_only") if single_side else out


#: What is looked for in normalised texts.
X_RUN = r"(?i)(?<![A-Z0-9])x{2,}(?![A-Z0-9])"
X_TOKENS = r"(?i)(?<![A-Z0-9])x(?:[\s-]+x)+(?![A-Z0-9])"
BRACKETS = r"\[[xX.\s?…]+\]"


def gap_runs(c: Column) -> dict[str, Column]:
    """How many short and long runs of x, of x tokens, and brackets that stand for something missing."""
    s = X.text_or_empty(c)
    found = {k: F.regexp_extract_all(s, F.lit(f"({p})"), F.lit(1)) for k, p in (("x_run", X_RUN), ("x_tokens", X_TOKENS), ("bracket", BRACKETS))}
    marks = lambda m: F.regexp_count(m, F.lit("[xX]"))
    big = {"x_run": lambda m: F.length(m) >= 4, "x_tokens": lambda m: marks(m) >= 4, "bracket": lambda m: m.rlike(r"…|\.{3}") | (marks(m) >= 4)}
    out = {}
    for k, m in found.items():
        n = F.size(F.filter(m, big[k]))
        out |= {f"{k}_big": n.cast("long"), f"{k}_gap": (F.size(m) - n).cast("long")}
    return out


def all_caps_tokens(c: Column) -> Column:
    """Q17: tokens of two letters or more, all capitals."""
    return F.size(F.filter(X.tokens(c), lambda t: t.rlike(r"\p{Lu}.*\p{Lu}") & (t == F.upper(t)))).cast("long")


def title_tokens(c: Column) -> Column:
    """Q17: tokens that begin with a capital, bracketed beginnings apart, and have small letters too."""
    bare = lambda t: F.regexp_replace(t, r"^(?:\{[^}]+\}|\([^)]*\))+", "")
    return F.size(F.filter(X.tokens(c), lambda t: bare(t).rlike(r"^[^\p{L}]*\p{Lu}") & bare(t).rlike(r"\p{Ll}"))).cast("long")


def unexpected_angles(c: Column) -> Column:
    """Q17: angle brackets that belong to no gap."""
    return F.regexp_count(F.regexp_replace(X.text_or_empty(c), "<gap>|<big_gap>", ""), F.lit("[<>]")).cast("long")


def hint_counts(c: Column) -> tuple[Column, Column]:
    """Q19: how many hints a text's <LEX> part holds, and its characters."""
    inside = F.trim(F.regexp_extract(X.text_or_empty(c), r"(?is)<LEX>(.*?)</LEX>", 1))
    return F.when(inside == "", F.lit(0)).otherwise(F.size(F.split(inside, r"\|"))).cast("long"), F.length(inside).cast("long")
