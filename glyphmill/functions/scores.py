"""BLEU and chrF++ of single pairs of texts (E2), by the same statistics that `operators.metrics` sums over a corpus."""

from __future__ import annotations

import math
import re
from collections import Counter

PUNCTUATION = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def ngrams(items, n: int) -> Counter:
    if isinstance(items, str):
        return Counter([items[i : i + n] for i in range(len(items) - n + 1)])
    return Counter(zip(*(items[i:] for i in range(n))))


def words(text: str) -> list[str]:
    """chrF++'s words: one mark split off a token's end, else off its beginning."""
    out = []
    for t in text.split():
        if len(t) > 1 and t[-1] in PUNCTUATION:
            out += [t[:-1], t[-1]]
        elif len(t) > 1 and t[0] in PUNCTUATION:
            out += [t[0], t[1:]]
        else:
            out.append(t)
    return out


def overlap(a: Counter, b: Counter) -> tuple[int, int, int]:
    """(clipped matches, n-grams of a, n-grams of b)."""
    return sum(min(a[x], b[x]) for x in a.keys() & b.keys()), a.total(), b.total()


def chrf_statistics(hyp: str | None, ref: str | None, characters: int = 6, word_order: int = 2) -> list[tuple[int, int, int]]:
    h, r = "".join((hyp or "").split()), "".join((ref or "").split())
    hw, rw = words(hyp or ""), words(ref or "")
    return [overlap(ngrams(h, n), ngrams(r, n)) for n in range(1, characters + 1)] + [overlap(ngrams(hw, n), ngrams(rw, n)) for n in range(1, word_order + 1)]


def chrf_of(stats: list[tuple[int, int, int]], beta: float = 2.0) -> float:
    """chrF from statistics: mean precision and recall over the orders that both sides have, then their F."""
    both = [(m / h, m / r) for m, h, r in stats if h and r]
    if not both:
        return 0.0
    p, r = (sum(x) / len(both) for x in zip(*both))
    return 100 * (1 + beta**2) * p * r / (beta**2 * p + r) if p + r else 0.0


def tokens_13a(text: str) -> list[str]:
    s = re.sub(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 ", text)
    s = re.sub(r"([^0-9])([\.,])", r"\1 \2 ", s)
    s = re.sub(r"([\.,])([^0-9])", r" \1 \2", s)
    return re.sub(r"([0-9])(-)", r"\1 \2 ", s).split()


def bleu_statistics(hyp: str | None, ref: str | None, tokenize: str = "13a") -> tuple[list[tuple[int, int, int]], int, int]:
    cut = tokens_13a if tokenize == "13a" else str.split
    h, r = cut(hyp or ""), cut(ref or "")
    return [overlap(ngrams(h, n), ngrams(r, n)) for n in range(1, 5)], len(h), len(r)


def bleu_of(stats: list[tuple[int, int, int]], n_hyp: int, n_ref: int) -> float:
    """BLEU with exponential smoothing; 0 without any match, or where an order has no n-gram."""
    if not any(m for m, _, _ in stats) or any(not h for _, h, _ in stats):
        return 0.0
    total, zeros = 0.0, 0
    for m, h, _ in stats:
        zeros += not m
        total += math.log((m or 0.5**zeros) / h)
    penalty = 1.0 if n_hyp >= n_ref else math.exp(1 - n_ref / n_hyp)
    return 100 * penalty * math.exp(total / len(stats))


def chrf(hyp: str | None, ref: str | None) -> float:
    return chrf_of(chrf_statistics(hyp, ref))


def bleu(hyp: str | None, ref: str | None, tokenize: str = "13a") -> float:
    return bleu_of(*bleu_statistics(hyp, ref, tokenize))


def geometric(hyp: str | None, ref: str | None, tokenize: str = "13a") -> tuple[float, float, float]:
    """(BLEU, chrF++, their geometric mean)."""
    b, c = bleu(hyp, ref, tokenize), chrf(hyp, ref)
    return b, c, math.sqrt(b * c)
