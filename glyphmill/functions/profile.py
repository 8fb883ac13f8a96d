"""Character classes, tokens and stop words of texts, counted in one pass over code points (Q1, Q2, Q11, B1, B2)."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphmill.functions.types import record

#: Stop words by language. Words are ASCII, as `WORD` has it, so accented entries are never met.
STOPWORDS: dict[str, tuple[str, ...]] = {
    k: tuple(v.split())
    for k, v in {
        "de": "als auch auf das dass daß dem den der des die ein eine einem einen einer er fur für ihr ihre ihren in ist mit nicht seine seiner sie sind und von war waren wie wir zu",
        "en": "also an and are as at be but by for from had has have he her his if in into is it its not of on or our she that the their them then these they this those to was we were when which who with you your",
        "fr": "au aux avec ce ces cette dans de des du elle elles en est et il ils la le les leur leurs ne nous ont par pas pour que qui sa ses son sont sur un une vous",
        "tr": "ama bir bircok birçok biz bu da daha de fakat gibi icin ile için ki mi mu mü mı o olan olarak oldu once onlar onun siz sonra su vardir vardır ve veya yok önce şu",
    }.items()
}
#: The shorter English list of the English test alone.
ENGLISH = tuple("a also an and are as at be but by for from had has have he her his in into is it its not of on or our she that the their them these they this those to was we were which who with".split())
WORD = re.compile("[a-z][a-z']+")
LISTS = {**{f"hits_{k}": frozenset(v) for k, v in STOPWORDS.items()}, "hits_english": frozenset(ENGLISH)}
#: Each listed word -> the places of the lists that hold it.
KNOWN = {w: tuple(k for k, listed in enumerate(LISTS.values()) if w in listed) for w in frozenset().union(*LISTS.values())}
ALPHA, DIGIT, UPPER, SPACE, CONTROL = 1, 2, 4, 8, 16
BITS = {"n_alpha": ALPHA, "n_digit": DIGIT, "n_upper": UPPER, "n_space": SPACE, "n_control": CONTROL}
COUNTS = ("len", "tokens", *BITS, "words", *LISTS)


@lru_cache(1)
def classes() -> np.ndarray:
    """The classes of every code point, as Python's string methods have them."""
    table = np.zeros(0x110000, np.uint8)
    # no letter, digit or blank is assigned beyond
    for c in range(0x32400):
        s = chr(c)
        table[c] = ALPHA * s.isalpha() | DIGIT * s.isdigit() | UPPER * s.isupper() | SPACE * s.isspace() | CONTROL * (c < 32 and not s.isspace())
    return table


def counted(texts: list[str | None], words: bool = True) -> dict[str, np.ndarray]:
    """COUNTS of each text; a null text counts as empty."""
    texts = [t or "" for t in texts]
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(size)
    starts = ends - size
    kinds = classes()[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]

    some = np.flatnonzero(size)

    def per_text(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(texts), np.int64)
        if len(some):
            total[some] = np.add.reduceat(mask, starts[some], dtype=np.int64)
        return total

    out = {"len": size, **{k: per_text((kinds & bit) > 0) for k, bit in BITS.items()}}
    solid = (kinds & SPACE) == 0
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    first[starts[size > 0]] = solid[starts[size > 0]]
    out["tokens"] = per_text(first)
    out["words"] = np.zeros(len(texts), np.int64)
    hits = np.zeros((len(texts), len(LISTS)), np.int64)
    for i, t in enumerate(texts if words else ()):
        found = WORD.findall(t.lower())
        out["words"][i] = len(found)
        row = [0] * len(LISTS)
        for w in found:
            if w in KNOWN:
                for k in KNOWN[w]:
                    row[k] += 1
        hits[i] = row
    out |= dict(zip(LISTS, hits.T))
    return out


@F.pandas_udf(record(", ".join(f"{k} long" for k in COUNTS)))
def _profile(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(counted(texts.tolist()))[list(COUNTS)]


@F.pandas_udf(record(", ".join(f"{k} long" for k in COUNTS[:7])))
def _characters(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(counted(texts.tolist(), words=False))[list(COUNTS[:7])]


def profile(c: Column, words: bool = True) -> Column:
    """A struct of COUNTS of the text; without words, of its characters and tokens alone."""
    return (_profile if words else _characters)(c.cast("string"))


def ratios(p: Column) -> dict[str, Column]:
    """Q1/Q2 from a profile: shares of letters, digits and other marks among non-blank characters, of capitals among letters."""
    content = F.greatest(p["len"] - p["n_space"], F.lit(1))
    return {
        "alpha_ratio": p["n_alpha"] / content,
        "digit_ratio": p["n_digit"] / content,
        "symbol_ratio": (p["len"] - p["n_alpha"] - p["n_digit"] - p["n_space"]) / content,
        "upper_ratio": p["n_upper"] / F.greatest(p["n_alpha"], F.lit(1)),
    }
