"""Alignment by dynamic programming, with and without sentence hints: DP1-DP7, N10, W14, A23 and Z14-Z16 of the survey."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import text as X
from glyphmill.functions.normalize import clean, translation, transliteration, without_dangling_quotes
from glyphmill.functions.sentences import split
from glyphmill.operators import gates
from glyphmill.shared import write_shared


def desired(total: int, lengths: list[int]) -> np.ndarray:
    return total * np.asarray(lengths, float) / sum(lengths)


#: Most pairs of a start and an end that are weighed at once.
PAIRS = 1 << 18


def least_cost(total: int, share: np.ndarray, least: int, low: float, high: float) -> float:
    """A bound that the best cut does not pass: the cost of sizes near their shares; infinite where they don't fit."""
    n, at, want, cost = len(share), 0, 0.0, 0.0
    for i, d in enumerate(share[:-1]):
        want += d
        floor = max(1, int(d * low))
        size = min(max(round(want) - at, floor), max(floor, int(d * high) + 1))
        at += size
        cost += (size - d) ** 2 + 5.0 * max(least - size, 0)
        if at > total - (n - 1 - i):
            return np.inf
    last = total - at
    return (cost + (last - share[-1]) ** 2 + 5.0 * max(least - last, 0)) * (1 + 1e-9) + 1e-6


def segment_sizes(total: int, lengths: list[int], least: int = 3, low: float = 0.25, high: float = 4.0) -> list[int]:
    """DP1: sizes of contiguous segments of `total` tokens, one for each target length.

    The cost of a segment is the square of its distance from its share of the tokens, and 5 for each token under `least`.
    Sizes lie within low..high of the share; the last takes the rest. Ties go to the earliest start, then to the least
    size. Where no cut fits, the cuts are in proportion.

    Exact, but places are left out that no best cut can pass: m segments that share D tokens cost at least (R - D)^2 / m
    when they are given R, and a cut near the shares bounds the whole. What is left is about as wide as there are targets.
    """
    n = len(lengths)
    if n < 2 or not total or not sum(lengths):
        return [total]
    share = desired(total, lengths)
    most = least_cost(total, share, least, low, high)
    rest = np.append(np.cumsum(share[::-1])[::-1][1:], 0.0)
    # costs of the places from first on; sizes chosen for each target's ends, from the first of them on
    first, best = 0, np.zeros(1)
    chosen: list[tuple[int, np.ndarray]] = []
    for i, d in enumerate(share[:-1]):
        floor = max(1, int(d * low))
        top = max(floor, int(d * high) + 1)
        # each segment to come needs a token
        left = n - 1 - i
        limit = total - left
        begin, end = first + floor, min(first + len(best) - 1 + top, limit)
        middle = total - rest[i]
        if np.isfinite(most):
            reach = np.sqrt(left * most) + 1
            begin, end = max(begin, int(middle - reach)), min(end, int(middle + reach) + 1)
        # a start may have fewer tokens than the floor before the limit
        short = np.arange(min(floor - 1, limit - first), 0, -1)
        short = short[limit - short < first + len(best)]
        if len(short):
            end = limit
        ends = np.arange(begin, end + 1) if begin <= end else np.arange(limit, limit + 1) if len(short) else np.arange(0)
        new, sizes = np.full(len(ends), np.inf), np.zeros(len(ends), np.int64)
        at = 0
        while at < len(ends):
            step = max(1, PAIRS // max(1, min(len(best), top - floor + 1)))
            part = ends[at : at + step]
            starts = np.arange(max(first, part[0] - top), min(first + len(best) - 1, part[-1] - floor) + 1)
            if len(starts):
                size = part[:, None] - starts
                cost = best[starts - first] + (size - d) ** 2 + 5.0 * np.maximum(least - size, 0)
                cost[(size < floor) | (size > top)] = np.inf
                k = np.argmin(cost, axis=1)
                new[at : at + step] = cost[np.arange(len(part)), k]
                sizes[at : at + step] = size[np.arange(len(part)), k]
            at += step
        if len(short):
            cost = best[limit - short - first] + (short - d) ** 2 + 5.0 * np.maximum(least - short, 0)
            if cost[k := np.argmin(cost)] < new[-1]:
                new[-1], sizes[-1] = cost[k], short[k]
        new[new + (ends - middle) ** 2 / left > most] = np.inf
        kept = np.flatnonzero(np.isfinite(new))
        if not len(kept):
            best = new[:0]
            break
        first, best = int(ends[kept[0]]), new[kept[0] : kept[-1] + 1]
        chosen.append((first, sizes[kept[0] : kept[-1] + 1]))
    if not len(best):
        cuts = np.round(np.cumsum(share[:-1])).astype(int)
        cuts = sorted({min(max(1, c), total - (n - 1 - i)) for i, c in enumerate(cuts)})
        return np.diff([0, *cuts, total]).tolist()
    last = total - np.arange(first, first + len(best))
    at = first + int(np.argmin(best + (last - share[-1]) ** 2 + 5.0 * np.maximum(least - last, 0)))
    out = [total - at]
    for begin, sizes in chosen[::-1]:
        out.append(int(sizes[at - begin]))
        at -= out[-1]
    return out[::-1]


def merged_targets(targets: list[str], n_tokens: int) -> list[str]:
    """The last targets joined until there is a token for each."""
    if 0 < n_tokens < len(targets):
        return [*targets[: n_tokens - 1], " ".join(t.strip() for t in targets[n_tokens - 1 :])]
    return targets


def aligned(source: str, targets: list[str]) -> list[tuple[str, str]]:
    """DP5 without hints: (source segment, target) pairs of one document."""
    tokens = source.split()
    targets = merged_targets(targets, len(tokens))
    if not tokens or not targets:
        return []
    out, at = [], 0
    for size, target in zip(segment_sizes(len(tokens), [max(1, len(t.split())) for t in targets]), targets):
        out.append((" ".join(tokens[at : at + size]), target))
        at += size
    return out


# ---- anchored alignment (DP2-DP6) ----


@dataclass(frozen=True)
class Hint:
    """One sentence of a document: its translation, and the first word by which its beginning is found."""

    translation: str
    spelling: str | None = None
    transcription: str | None = None
    number: int | None = None


def positions(tokens: list[str], pattern: list[str], start: int = 0) -> list[int]:
    """DP2: where a pattern stands among tokens, from start on."""
    n = len(pattern)
    return [i for i in range(max(0, start), len(tokens) - n + 1) if tokens[i : i + n] == pattern] if n else []


def first_words(hint: Hint, variant: str) -> list[str]:
    """Z14."""
    return transliteration(hint.spelling or hint.transcription, variant).split()


def anchors(tokens: list[str], hints: list[Hint], variant: str) -> tuple[list[tuple[int, int]], int]:
    """DP3, W14: (sentence, token) places that begin a sentence, ascending, with both ends; how many of them are anchors.

    Each sentence but the first is looked for behind the last anchor by its first words, else by the first of them. Of
    several places the one nearest to where its number among all numbers would put it is taken, the first if there is none.
    """
    numbers = [h.number for h in hints if h.number is not None]
    top = max(numbers, default=0)
    found, behind = [(0, 0)], 0
    for i, hint in enumerate(hints[1:], 1):
        words = first_words(hint, variant)
        places = positions(tokens, words, behind) or positions(tokens, words[:1], behind)
        if not places:
            continue
        at = places[0]
        if top > 0 and hint.number is not None:
            wanted = hint.number / top * len(tokens)
            at = min(places, key=lambda p: (abs(p - wanted), p))
        if at > found[-1][1]:
            found.append((i, at))
            behind = at + max(1, len(words))
    return [*found, (len(hints), len(tokens))], len(found) - 1


def cut(tokens: list[str], lengths: list[int]) -> list[list[str]]:
    """DP1 as token lists."""
    out, at = [], 0
    for size in segment_sizes(len(tokens), lengths):
        out.append(tokens[at : at + size])
        at += size
    return out + [[] for _ in range(len(lengths) - len(out))]


def anchored(tokens: list[str], targets: list[str], hints: list[Hint], variant: str) -> tuple[list[list[str]], str, int]:
    """DP4: (segments, status, anchors): DP1 between anchors, or over the whole where there are none or numbers differ."""
    lengths = [len(t) for t in targets] or [0]
    if not tokens:
        return [[] for _ in targets], "empty_src_tokens", 0
    if len(targets) != len(hints) or not targets:
        return cut(tokens, lengths), "len_mismatch", 0
    places, used = anchors(tokens, hints, variant)
    if not used:
        return cut(tokens, lengths), "no_anchor", 0
    out: list[list[str]] = []
    for (s, t), (s2, t2) in itertools.pairwise(places):
        part = targets[s:s2]
        out += [tokens[t:t2]] if len(part) == 1 else cut(tokens[t:t2], [len(x) for x in part]) if part else []
    return (out, "anchored", used) if len(out) == len(targets) else (cut(tokens, lengths), "fallback_dp", used)


@dataclass(frozen=True)
class Aligned:
    """DP5: one way to align a document: rows of (source, target), and how it was made."""

    method: str
    pairs: list[tuple[str, str]]
    merged: bool
    status: str
    anchors: int
    meta: list[str]


def candidate(source: str | None, target: str | None, variant: str, hints: list[Hint] | None = None) -> Aligned:
    """DP5: normalise, split the target (or take its sentences from hints), merge what the source can't hold, segment."""
    tokens = transliteration(source, variant).split()
    kept = [(h, t) for h in hints or [] if (t := clean(without_dangling_quotes(clean(translation(h.translation)))))]
    meta = [] if not hints else ["oare_sentence_translation" if kept else "oare_sentence_empty"]
    if kept:
        targets = [t for _, t in kept]
    else:
        whole = translation(target)
        targets = split(whole) or ([whole] if whole else [])
    joined = merged_targets(targets, len(tokens))
    merged = len(joined) != len(targets)
    status, used = "", 0
    lengths = [len(t) for t in joined] or [len(target or "")]
    if kept and not merged:
        segments, status, used = anchored(tokens, joined, [h for h, _ in kept], variant)
    else:
        segments = cut(tokens, lengths)
        meta += ["oare_hint_dropped_after_merge"] if kept else []
    if kept:
        meta += ([f"oare_{status}"] if status else []) + [f"oare_anchors_{used}"]
    tidy = [clean(without_dangling_quotes(clean(t))) for t in joined]
    pairs = [(" ".join(segments[i]) if i < len(segments) else "", t) for i, t in enumerate(tidy)]
    return Aligned("oare" if kept else "dp", pairs, merged, status, used, meta if kept else [])


ROW = "method string, place int, src_sent string, tgt_sent string, merged boolean, status string, anchors int, meta string"


def candidate_rows(source: str | None, target: str | None, variant: str, hints: list[Hint] | None) -> list[tuple]:
    """Rows of ROW of both ways to align a document: with hints (if they have translations) and without."""
    ways = [candidate(source, target, variant)]
    if hints and (with_hints := candidate(source, target, variant, hints)).method == "oare":
        ways.append(with_hints)
    return [(w.method, i, a, b, w.merged, w.status, w.anchors, ";".join(w.meta)) for w in ways for i, (a, b) in enumerate(w.pairs)]


def aligned_documents(docs: DataFrame, variant: str, doc_id: str = "oare_id", source: str = "transliteration", target: str = "translation", hints: str | None = "hints") -> DataFrame:
    """DP5 of every document: (doc_id, *ROW), a row for each way and sentence. hints: a column as `sentence_hints` makes, or None."""
    @F.pandas_udf(f"array<struct<{', '.join(c.replace(' ', ':', 1) for c in ROW.split(', '))}>>")
    def run(rows: pd.DataFrame) -> pd.Series:
        out = []
        for row in rows.itertuples(index=False):
            given = [Hint(h["translation"], h["spelling"], h["transcription"], h["number"]) for h in row[2]] if hints and row[2] is not None else None
            out.append([dict(zip((c.split(" ")[0] for c in ROW.split(", ")), r)) for r in candidate_rows(row[0], row[1], variant, given)])
        return pd.Series(out)

    columns = [F.col(source).alias("source"), F.col(target).alias("target"), *([F.col(hints).alias("hints")] if hints else [])]
    return docs.select(doc_id, F.explode(run(F.struct(*columns))).alias("r")).select(doc_id, "r.*")


def chosen_rows(rows: DataFrame, gate: gates.AlignedGate, doc_id: str = "oare_id", least_anchors: int = 1, prefer: str = "oare") -> DataFrame:
    """DP6, A23, Z15, Z16: the rows of each document's better way, with flags and the reason of the choice in align_meta.

    Alignment by hints is eligible if it is anchored; then the ways are compared by good rows, their share, their mean
    scores, and how far length ratios leave the gate, in that order; `prefer` decides ties.
    """
    m = gates.measured_pairs(rows).withColumn("flags", gates.aligned_flags(gate))
    # read twice below: once to choose, once for the rows
    m = write_shared(m.withColumn("flags", F.array_sort(X.with_flag(F.col("flags"), "merged_tgt", F.col("merged")))), "aligned")
    good = F.size("flags") == 0
    mean = lambda c: F.coalesce(F.avg(F.when(good, F.round(c, 6))), F.lit(0.0))
    ratio = F.round("len_ratio", 6)
    sums = m.groupBy(doc_id, "method").agg(
        F.count_if(good).alias("n_good"), (F.count_if(good) / F.count("*")).alias("good_ratio"), mean("align_score").alias("mean_align"), mean("token_align_score").alias("mean_token"),
        gates.outlier(F.min(ratio), F.max(ratio), gate).alias("outlier"), F.max("anchors").alias("n_anchors"), F.max("status").alias("final"),
    )
    key = F.struct("n_good", "good_ratio", "mean_align", "mean_token", (-F.col("outlier")).alias("less"))
    by_way = sums.groupBy(doc_id).agg(
        *[F.max(F.when(F.col("method") == k, key)).alias(k) for k in ("oare", "dp")], F.max(F.when(F.col("method") == "oare", F.col("n_anchors"))).alias("_anchors"), F.max(F.when(F.col("method") == "oare", F.col("final"))).alias("_status")
    )
    reason = (
        F.when(F.col("oare").isNull(), F.lit(None))
        .when(F.col("_anchors") < least_anchors, "no_anchor")
        .when(F.col("_status") != "anchored", F.concat(F.lit("status_"), F.when(F.col("_status") == "", "unknown").otherwise(F.col("_status"))))
        .when(F.col("dp").isNull() | (F.col("oare") > F.col("dp")), "oare_better")
        .when(F.col("oare") < F.col("dp"), "dp_better")
        .otherwise(f"tie_{prefer}")
    )
    picked = by_way.select(F.col(doc_id).alias("_doc"), reason.alias("_reason")).withColumn("_method", F.when(F.col("_reason").isin("oare_better", "tie_oare"), "oare").otherwise("dp"))
    out = m.join(picked, (F.col(doc_id) == F.col("_doc")) & (F.col("method") == F.col("_method")))
    note = F.when(F.col("_method") == "oare", "oare_selected").when(F.col("_reason").isNotNull(), F.concat(F.lit("oare_available;oare_fallback_"), F.col("_reason")))
    return out.withColumn("align_meta", F.concat_ws(";", F.when(F.col("meta") != "", F.col("meta")), note)).drop("_doc", "_method", "_reason", "meta")


def fallback_reason(meta: Column) -> Column:
    """Why a document was not aligned by its hints, from align_meta; null if it was."""
    found = F.regexp_extract(X.text_or_empty(meta), "(?:^|;)oare_fallback_([^;]*)", 1)
    return F.when(found != "", found)


def block_pairs(source: str, target: str, variant: str) -> list[tuple[str, str]]:
    """DP7: sentence pairs of a source block and a target block; none where the source has fewer tokens than the target sentences."""
    targets, tokens = split(target), transliteration(source, variant).split()
    if not targets or len(tokens) < len(targets):
        return []
    found = [(" ".join(s), clean(translation(t))) for s, t in zip(cut(tokens, [len(t) for t in targets]), targets)]
    return [(s, t) for s, t in found if s and t]
