"""Placeholders, slots and gloss hints.

One longest-match engine serves all: it walks over tokens and takes the longest run that a lexicon holds and a filter
allows. Lexicons are bounded dictionaries of names, sent to the executors with the function that uses them.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import ocr
from glyphmill.functions.normalize import LOW_DIGITS, clean, nfkc
from glyphmill.functions import text as X

Lexicon = dict[tuple[str, ...], object]
CORE = re.compile(r"^(\W*)(.*?)(\W*)$", re.S)
MARK = re.compile(r"<(PN|NUM|UNIT)_(\d+)>$")
NUMBER = re.compile(r"\d+(?:[.,]\d+)?(?:/\d+)?$")
HINTS = re.compile(r"<LEX>.*?</LEX>", re.S | re.I)


def matches(tokens: list[str], lexicon: Lexicon, allowed: Callable[[tuple[str, ...], object], bool] | None = None, firsts: frozenset[str] | None = None) -> Iterator[tuple[int, int, object]]:
    """(start, end, entry) of every greedy longest match; a match that is not allowed gives way to a shorter one.

    firsts: the lexicon's first words, where a caller with many texts has them; other places begin no match.
    """
    longest = max(map(len, lexicon), default=0)
    firsts = {k[0] for k in lexicon if k} if firsts is None else firsts
    at = 0
    while at < len(tokens):
        if tokens[at] not in firsts:
            at += 1
            continue
        for end in range(min(at + longest, len(tokens)), at, -1):
            run = tuple(tokens[at:end])
            if (entry := lexicon.get(run)) is not None and (allowed is None or allowed(run, entry)):
                yield at, end, entry
                at = end
                break
        else:
            at += 1


# ---- lexicon tables ----


def forms(rows: DataFrame, types: list[str], type_: str = "type", form: str = "form") -> dict[str, list[str]]:
    """The distinct forms of each wanted type, sorted, white space collapsed. A lexicon is small enough for the driver."""
    kept = rows.select(F.upper(F.col(type_)).alias("t"), X.clean(F.col(form)).alias("f")).where(F.col("t").isin([t.upper() for t in types]) & (F.col("f") != "")).distinct()
    out: dict[str, list[str]] = {}
    for r in kept.orderBy("t", "f").collect():
        out.setdefault(r.t, []).append(r.f)
    return out


def gloss_lexicon(rows: list[dict], columns: tuple[str, ...] = ("form", "norm"), types: tuple[str, ...] = ("word",)) -> Lexicon:
    """Token tuples of the given columns with (lexeme, numeral); the first entry of a tuple stays."""
    out: Lexicon = {}
    for row in rows:
        lexeme = clean(row.get("lexeme"))
        if lexeme and str(row.get("type", "")).lower() in types:
            for c in columns:
                if tokens := tuple(clean(row.get(c)).split()):
                    out.setdefault(tokens, (lexeme, clean(row.get("I_IV")).upper() or None))
    return out


def dictionary(rows: list[dict]) -> dict[str, dict[str, str]]:
    """Lemma -> numeral -> first definition."""
    out: dict[str, dict[str, str]] = {}
    for row in rows:
        if (head := ocr.headword(row.get("word"))) and (text := clean(row.get("definition"))):
            out.setdefault(head[0], {}).setdefault(head[1], text)
    return out


# ---- placeholders ----


def allowed_name(run: str, mode: str = "all") -> bool:
    """Whether a match looks like a name: any ('all'), with braces, parentheses or capitals, or hyphenated and long enough."""
    if mode not in ("strict", "pattern") or re.search(r"[{}]|\([^)]+\)", run) or any(map(str.isupper, run)):
        return True
    hyphens, size = (2, 8) if mode == "strict" else (1, 5)
    return run.count("-") >= hyphens and len(run) >= size


def placeholders(text: str | None, lexicon: Lexicon, mode: str = "all") -> tuple[str, list[dict[str, str]]]:
    """(text, mapping): names as <KIND_k>, numbered by kind; a repeated name keeps its placeholder."""
    tokens = (text or "").split()
    out, known, counts, at = [], {}, {}, 0
    for start, end, kind in matches(tokens, lexicon, lambda run, _: allowed_name(" ".join(run), mode)):
        name = " ".join(tokens[start:end])
        if name not in known:
            counts[kind] = counts.get(kind, 0) + 1
            known[name] = {"type": kind, "placeholder": f"<{kind}_{counts[kind]}>", "text": name}
        out += [*tokens[at:start], known[name]["placeholder"]]
        at = end
    return " ".join(out + tokens[at:]), list(known.values())


def mapped_target(text: str | None, mapping: list[dict[str, str]]) -> str:
    """The mapping's names in a target as their placeholders, names of more words first."""
    tokens = (text or "").split()
    by_words: Lexicon = {}
    for m in mapping:
        if key := tuple((m.get("text") or "").split()):
            by_words.setdefault(key, m["placeholder"])
    out, at = [], 0
    for start, end, mark in matches(tokens, by_words):
        out += [*tokens[at:start], mark]
        at = end
    return " ".join(out + tokens[at:]) if mapping else text or ""


def restored(text: str | None, mapping: list[dict[str, str]], longest_first: bool = False) -> str:
    """X5, and X5b with placeholders by length."""
    out = text or ""
    for m in sorted(mapping, key=lambda m: -len(m.get("placeholder") or "")) if longest_first else mapping:
        if m.get("placeholder") and m.get("text"):
            out = out.replace(m["placeholder"], m["text"])
    return out


def dumped(mapping: list[dict[str, str]]) -> str:
    """X6."""
    return json.dumps(mapping)


def loaded(text: str | None) -> list[dict[str, str]]:
    """A mapping from JSON; none from anything else."""
    try:
        found = json.loads(text or "")
    except ValueError:
        return []
    return found if isinstance(found, list) else []


def scorecards(df: DataFrame, text: str, lexicon: Lexicon, modes: tuple[str, ...], common: frozenset[str]) -> DataFrame:
    """One row for each mode on how its placeholders would do: coverage, mean number, shares of common and of short names, score.

    Texts are read once for all modes, and each task adds up what it reads.
    """
    firsts = frozenset(k[0] for k in lexicon if k)
    counts = ("rows", "with_any", "n", "common", "short")

    def names(tokens: list[str], mode: str) -> set[tuple[str, ...]]:
        return {tuple(tokens[a:b]) for a, b, _ in matches(tokens, lexicon, lambda run, _: allowed_name(" ".join(run), mode), firsts)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {m: [0] * len(counts) for m in modes}
        for batch in batches:
            for t in batch.column("text"):
                tokens = (t.as_py() or "").split()
                some = not firsts.isdisjoint(tokens)
                for m in modes:
                    found = names(tokens, m) if some else ()
                    add = (1, bool(found), len(found), sum(all(w in common for w in x) for x in found), sum(len(x) == 1 and len(x[0]) <= 3 for x in found))
                    total[m] = [a + b for a, b in zip(total[m], add)]
        rows = [(m, *total[m]) for m in modes]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64() if i else pa.string()) for i in range(len(counts) + 1)], names=["mode", *counts])

    each = df.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "mode string, " + ", ".join(f"{c} long" for c in counts))
    known = df.sparkSession.createDataFrame([(m,) for m in modes], "mode string")
    s = known.join(each.groupBy("mode").agg(*[F.sum(c).alias(c) for c in counts]), "mode", "left").na.fill(0)
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    s = s.select("mode", "rows", per("with_any", "rows").alias("coverage"), per("n", "rows").alias("per_row"), per("common", "n").alias("common_rate"), per("short", "n").alias("short_rate"))
    return s.withColumn("score", F.col("coverage") - 0.5 * F.col("common_rate") - 0.5 * F.col("short_rate"))


def common_tokens(df: DataFrame, text: str, top: int) -> DataFrame:
    """(token, n): the `top` tokens by count, then by themselves."""
    return df.select(F.explode(X.tokens(F.col(text))).alias("token")).groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(top)


# ---- slots ----


@dataclass(frozen=True)
class Slots:
    """What becomes a slot."""

    names: Lexicon = field(default_factory=dict)
    units: frozenset[str] = frozenset("shekel shekels mina minas talent talents textile textiles gín ma.na gú túg".split())
    numbers: bool = True
    strip_hints: bool = True


#: Plain digits, quotes, apostrophes and dashes.
VIEW = LOW_DIGITS | {ord("ₓ"): "x"} | dict.fromkeys(map(ord, "«»„“”"), '"') | dict.fromkeys(map(ord, "´ʻʼʾ‘’‚‛′"), "'") | dict.fromkeys(map(ord, "‐‑–—−"), "-")


def view(text: str | None) -> str:
    """T21 and T1."""
    s = nfkc(text).translate(VIEW)
    s = re.sub(r"(?i)<\s*(big_)?gap\s*>", lambda m: "<big_gap>" if m[1] else "<gap>", s)
    return clean(s)


def edges(token: str) -> tuple[str, str, str]:
    """(marks before, core, marks after); a placeholder or gap is a core."""
    m = re.match(r"([^\w<{]*)(<(?:PN|NUM|UNIT)_\d+>|<(?:big_)?gap>)(.*)$", token, re.S)
    return m.groups() if m else CORE.match(token).groups()


def is_mark(core: str) -> bool:
    """Z10."""
    return bool(MARK.match(core)) or core in ("<gap>", "<big_gap>")


def slotted(text: str | None, s: Slots = Slots()) -> tuple[str, dict[str, str]]:
    """(text with <PN_k>, <NUM_k>, <UNIT_k>, what each stands for); marks around names, numbers and units stay."""
    tokens = view(HINTS.sub(" ", text or "") if s.strip_hints else text).split()
    parts = [edges(t) for t in tokens]
    out, known, counts, at = [], {}, {}, 0

    def slot(kind: str, what: str) -> str:
        if (kind, what) not in known:
            counts[kind] = counts.get(kind, 0) + 1
            known[kind, what] = f"<{kind}_{counts[kind]}>"
        return known[kind, what]

    def single(i: int) -> str:
        before, core, after = parts[i]
        if not is_mark(core):
            if s.numbers and NUMBER.match(core):
                core = slot("NUM", core)
            elif core.lower() in s.units:
                core = slot("UNIT", core)
        return before + core + after

    for start, end, _ in matches([p[1] for p in parts], s.names):
        out += map(single, range(at, start))
        out.append(parts[start][0] + slot("PN", " ".join(p[1] for p in parts[start:end])) + parts[end - 1][2])
        at = end
    out += map(single, range(at, len(parts)))
    return " ".join(out), {mark: what for (_, what), mark in known.items()}


def slotted_target(text: str | None, source: dict[str, str], s: Slots = Slots()) -> str:
    """X11: a target with the source's names, numbers and units as the source's slots."""
    parts = [edges(t) for t in view(text).split()]
    names: Lexicon = {tuple(what.split()): mark for mark, what in source.items() if mark.startswith("<PN")}
    rest = {what: mark for mark, what in source.items() if mark.startswith("<NUM") and s.numbers or mark.startswith("<UNIT")}
    out, at = [], 0
    single = lambda i: parts[i][0] + rest.get(parts[i][1], parts[i][1]) + parts[i][2]
    for start, end, mark in matches([p[1] for p in parts], names):
        out += map(single, range(at, start))
        out.append(parts[start][0] + mark + parts[end - 1][2])
        at = end
    return " ".join([*out, *map(single, range(at, len(parts)))])


def filled(text: str | None, first: dict[str, str], second: dict[str, str] | None = None) -> str:
    """Slots replaced by what they stand for, in the first map or else in the second."""
    out = []
    for before, core, after in map(edges, view(text).split()):
        out.append(before + first.get(core, (second or {}).get(core, core)) + after)
    return " ".join(out)


def slot_counts(text: str | None) -> dict[str, int]:
    """X13."""
    kinds = [m[1].lower() for _, core, _ in map(edges, (text or "").split()) if (m := MARK.match(core))]
    return {k: kinds.count(k) for k in ("pn", "num", "unit")}


# ---- gloss hints ----


@dataclass(frozen=True)
class Gloss:
    """G1. frequent: lemmas' counts; those above most_frequent give no hint."""

    lexicon: Lexicon
    definitions: dict[str, dict[str, str]]
    frequent: dict[str, int] = field(default_factory=dict)
    most_frequent: int | None = None
    stop: frozenset[str] = frozenset()
    least_chars: int = 2
    most_match: int = 4
    most_hints: int = 6
    most_chars: int = 220
    most_gloss: int = 40
    prefer: str = "I"


def definition(lemma: str, numeral: str | None, g: Gloss) -> str | None:
    """A lemma's definition of that numeral, else of the preferred one, else of the first."""
    senses = g.definitions.get(lemma)
    return senses and (senses.get(numeral or "") or senses.get(g.prefer) or senses[min(senses)])


def hinted(text: str | None, g: Gloss) -> str:
    """G1: the text with ` <LEX> lemma=gloss | .. </LEX>`: at each place the longest match that gives a hint; rare and long ones first."""
    s = clean(text)
    if "<LEX>" in s:
        return s
    tokens = s.split()
    longest = min(g.most_match, max(map(len, g.lexicon), default=0))
    found = []
    for i in range(len(tokens)):
        for n in range(min(longest, len(tokens) - i), 0, -1):
            if (entry := g.lexicon.get(tuple(tokens[i : i + n]))) is None:
                continue
            lemma = ocr.lemma(entry[0])
            often = g.frequent.get(lemma, 0)
            if lemma.startswith("-") or len(lemma) < g.least_chars or lemma in g.stop or g.most_frequent is not None and often > g.most_frequent:
                continue
            if meaning := ocr.gloss(definition(lemma, entry[1], g), g.most_gloss):
                found.append((often, -n, -len(lemma), i, lemma, meaning))
                break
    first: dict[str, str] = {}
    for *_, lemma, meaning in sorted(found):
        first.setdefault(lemma, meaning)
    hints, size = [], 0
    for lemma, meaning in list(first.items())[: g.most_hints]:
        size += len(lemma) + 1 + len(meaning) + 3 * bool(hints)
        if size > g.most_chars:
            break
        hints.append(f"{lemma}={meaning}")
    return f"{s} <LEX> {' | '.join(hints)} </LEX>" if hints else s


def lemma_counts(df: DataFrame, text: str, lexicon: Lexicon, most_match: int = 4) -> DataFrame:
    """(lemma, n): how often each lemma is met by greedy longest match."""
    short = {k: v for k, v in lexicon.items() if len(k) <= most_match}

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [ocr.lemma(entry[0]) for _, _, entry in matches((t or "").split(), short)], na_action=None)

    return df.select(F.explode(run(F.col(text))).alias("lemma")).groupBy("lemma").agg(F.count("*").alias("n"))


def setting(*sources: dict | None, name: str, default=None):
    """The first of the sources (command line, configuration, a model's metadata) that gives a setting."""
    return next((s[name] for s in sources if s and s.get(name) is not None), default)
