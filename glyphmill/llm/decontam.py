"""Benchmark decontamination by the q-gram lemma.

Texts are lower-cased and every run of characters outside words becomes one space. A document is contaminated by an
item where some window of the item (window characters, or the whole of a shorter item) lies within `edits` edits of a
passage of the document; edits are one per `per_edit` characters of the window. Such a passage shares at least
T = w + 1 - q(e + 1) q-grams with the window, on diagonals (place in the document less place in the item) that differ by
at most e. So q-gram hits are counted in overlapping bands of diagonals, regions with T hits within a window's length
are retained, and banded alignment decides. No passage within the budget is lost; nothing beyond it is reported.
Items shorter than a q-gram are searched for as whole words without edits.

The items' q-grams are broadcast in blocks of at most `block_chars` characters: a larger benchmark takes more passes
over the documents, each with a bounded broadcast, and no shuffle of the documents ever.

Cases: null and empty texts are never contaminated; null texts and items of under `least_item` normalised characters, by
default those without any word, are not searched for; items with one text are each reported; repeated documents give
repeated rows; empty tables give an empty result (or all documents, when filtering); very long texts are searched whole;
other columns pass unchanged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.textbuf import codepoints, mix64, ragged, released, slices, strings, word_table


@dataclass(frozen=True)
class Decontam:
    q: int = 12
    window: int = 96
    per_edit: int = 16
    least_item: int = 1
    block_chars: int = 4_000_000

    def budget(self, length: int) -> tuple[int, int, int]:
        """(window, edits, T) of an item of so many normalised characters; T is 1 at least."""
        w = min(self.window, length)
        e = max(0, min(w // self.per_edit, w // self.q - 1))
        return w, e, w + 1 - self.q * (e + 1)


def normalised(array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, where each text starts, where it ends) of the normalised texts; a space stands after each."""
    cp, _, ends = codepoints(pc.utf8_lower(array), 1)
    inside = word_table()[cp]
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    at = np.zeros(len(cp) + 1, np.int64)
    np.cumsum(keep, out=at[1:])
    out = np.where(inside, cp, np.uint32(32))[keep]
    stop = at[ends + 1] if len(ends) else np.zeros(0, np.int64)
    start = np.r_[0, stop[:-1]] if len(ends) else stop
    return out, start, np.maximum(start, stop - 1)


def gram_hashes(cp: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q code points from each place on; shorter than cp by q - 1."""
    n = len(cp) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, h, done, out = 1, cp.astype(np.uint64) + np.uint64(7), 0, None
    with np.errstate(over="ignore"):
        left = q
        while True:
            if left & 1:
                part = h[done : done + n]
                out = part.copy() if out is None else out * np.uint64(pow(0x9E3779B97F4A7C15, power, 1 << 64)) + part
                done += power
            left >>= 1
            if not left:
                break
            h = h[:-power] * np.uint64(pow(0x9E3779B97F4A7C15, power, 1 << 64)) + h[power:]
            power *= 2
        out ^= out >> np.uint64(29)
        return out * np.uint64(0xBF58476D1CE4E5B9)


class Index:
    """The q-grams of some items: sorted hashes, their postings, and a bitmap that most other grams miss."""

    def __init__(self, texts: list[str], p: Decontam):
        self.p = p
        cp, start, end = normalised(pa.array(texts, pa.string()))
        use = end - start >= max(p.q, p.least_item)
        self.short: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in np.unique((end - start)[~use & (end - start >= max(1, p.least_item))]).tolist():
            item = np.flatnonzero(end - start == n)
            rows = cp[start[item][:, None] + np.arange(n)]
            h = gram_hashes(rows.ravel(), n)[::n]
            order = np.argsort(h, kind="stable")
            self.short[n] = h[order], item[order], rows[order]
        self.used = np.flatnonzero(use)
        self.items = [cp[a:b].copy() for a, b in zip(start[use], end[use])]
        self.shape = np.array([p.budget(len(x)) for x in self.items], np.int64).reshape(-1, 3)
        if not self.items:
            self.grams = np.zeros(0, np.uint64)
            return
        found = [gram_hashes(x, p.q) for x in self.items]
        flat = np.concatenate(found)
        item = np.repeat(np.arange(len(found)), [len(f) for f in found]).astype(np.int32)
        place = np.concatenate([np.arange(len(f)) for f in found]).astype(np.int32)
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        self.item, self.place = item[order], place[order]
        first = np.r_[True, flat[1:] != flat[:-1]]
        self.grams = flat[first]
        self.at = np.r_[np.flatnonzero(first), len(flat)]
        self.bits = max(22, math.ceil(math.log2(len(self.grams) * 64)))
        # a bit for each prefix: 32 MB for a block of 4 million characters
        self.map = np.zeros(1 << self.bits - 3, np.uint8)
        slot = self.grams >> np.uint64(64 - self.bits)
        np.bitwise_or.at(self.map, slot >> np.uint64(3), np.uint8(1) << (slot & np.uint64(7)).astype(np.uint8))

    def search(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, edits): every contaminated pair once, with the fewest edits of any window."""
        near = self.near(array)
        if not self.short or not len(array):
            return near
        d, i, edits = map(np.concatenate, zip(near, self.exact(array)))
        order = np.lexsort((i, d))
        return d[order], i[order], edits[order]

    def exact(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, 0) of the items shorter than a q-gram that stand in a document as whole words."""
        cp, start, end = normalised(array)
        edge = np.r_[True, cp == 32, True]
        found = [np.zeros((0, 2), np.int64)]
        for n, (hashes, item, rows) in self.short.items():
            h = gram_hashes(cp, n)
            at = np.flatnonzero(edge[: len(h)] & edge[n + 1 : n + 1 + len(h)])
            at = at[at + n <= end[np.searchsorted(start, at, side="right") - 1]]
            first, last = np.searchsorted(hashes, h[at]), np.searchsorted(hashes, h[at], side="right")
            post = ragged(last - first, first)
            at = np.repeat(at, last - first)
            same = (cp[at[:, None] + np.arange(n)] == rows[post]).all(1)
            found.append(np.c_[np.searchsorted(start, at[same], side="right") - 1, item[post[same]]])
        pairs = np.unique(np.concatenate(found), axis=0)
        return pairs[:, 0], pairs[:, 1], np.zeros(len(pairs), np.int64)

    def near(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """search() for the items that hold a q-gram."""
        nothing = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.grams) or not len(array):
            return nothing
        q = self.p.q
        cp, start, end = normalised(array)
        h = gram_hashes(cp, q)
        prefix = h >> np.uint64(64 - self.bits)
        hit = np.flatnonzero(self.map[prefix >> np.uint64(3)] >> (prefix & np.uint64(7)).astype(np.uint8) & np.uint8(1))
        if not len(hit):
            return nothing
        slot = np.searchsorted(self.grams, h[hit])
        slot[slot == len(self.grams)] = 0
        same = self.grams[slot] == h[hit]
        hit, slot = hit[same], slot[same]
        doc = np.searchsorted(start, hit, side="right") - 1
        whole = hit + q <= end[doc]
        hit, slot, doc = hit[whole], slot[whole], doc[whole]
        n = self.at[slot + 1] - self.at[slot]
        post = ragged(n, self.at[slot])
        p, d, item, r = np.repeat(hit, n), np.repeat(doc, n), self.item[post].astype(np.int64), self.place[post].astype(np.int64)
        if not len(p):
            return nothing
        w, e, least = self.shape[item].T
        stride = self.p.window // self.p.per_edit + 2
        shift = int(max(map(len, self.items)))
        diagonal = p - start[d] - r + shift
        band, rest = np.divmod(diagonal, stride)
        twice = np.flatnonzero(rest < e)
        pick = np.r_[np.arange(len(p)), twice]
        band = np.r_[band, band[twice] - 1]
        p, d, item, r, w, e, least = (x[pick] for x in (p, d, item, r, w, e, least))
        # pairs with too few hits at all go first, cheaply
        pair = d * len(self.items) + item
        _, inverse, count = np.unique(pair, return_inverse=True, return_counts=True)
        enough = count[inverse] >= least
        band, p, d, item, r, w, e, least, pair = (x[enough] for x in (band, p, d, item, r, w, e, least, pair))
        if not len(p):
            return nothing
        order = np.lexsort((r, p, band, pair))
        band, p, d, item, r, w, e, least, pair = (x[order] for x in (band, p, d, item, r, w, e, least, pair))
        group = np.cumsum(np.r_[False, (pair[1:] != pair[:-1]) | (band[1:] != band[:-1])])
        fresh = np.r_[True, (group[1:] != group[:-1]) | (p[1:] != p[:-1])]
        # one hit for each place of the document in a band
        u = np.flatnonzero(fresh)
        far = np.arange(len(u)) + least[u] - 1
        ok = far < len(u)
        far[~ok] = 0
        ok &= (group[u[far]] == group[u]) & (p[u[far]] - p[u] <= w[u] - q + e[u])
        best: dict[tuple[int, int], int] = {}
        for g in np.unique(group[u[ok]]):
            a, b = np.searchsorted(group, [g, g + 1])
            key = int(d[a]), int(item[a])
            if best.get(key) == 0:
                continue
            inside = u[(u >= a) & (u < b)] if b - a < 64 else u[np.searchsorted(u, a) : np.searchsorted(u, b)]
            good = ok[np.searchsorted(u, inside)]
            lo, hi = p[inside[good]].min(), p[inside[good]].max() + w[a] + e[a]
            of = slice(a, b)
            near = (p[of] >= lo) & (p[of] <= hi)
            edits = self.align(cp, int(start[d[a]]), int(end[d[a]]), int(item[a]), p[of][near], r[of][near])
            if edits is not None and edits < best.get(key, 1 << 30):
                best[key] = edits
        if not best:
            return nothing
        keys = np.array(sorted(best), np.int64)
        return keys[:, 0], self.used[keys[:, 1]], np.array([best[tuple(k)] for k in keys.tolist()], np.int64)

    def align(self, cp: np.ndarray, start: int, end: int, item: int, p: np.ndarray, r: np.ndarray) -> int | None:
        """Fewest edits between a window of the item near the hits and a passage of the document; None beyond budget."""
        w, e, _ = map(int, self.shape[item])
        x = self.items[item]
        run = np.lexsort((p, p - r))
        pp, dd = p[run], (p - r)[run]
        need = w - self.p.q
        if len(pp) > need and ((pp[need:] - pp[: len(pp) - need] == need) & (dd[need:] == dd[: len(pp) - need])).any():
            return 0
        low, high = int(dd.min()) - e, int(dd.max()) + e
        first, last = max(0, int(r.min()) - w), min(len(x) - w, int(r.max()) + self.p.q)
        windows = np.arange(first, last + 1)
        wide = np.arange(high - low + 1)
        # place of the document = window start + row + low + column
        text = np.full(len(x) + high - low + 2, 0, np.int64)
        lo, hi = max(start, low), min(end, low + len(text))
        if hi > lo:
            text[lo - low : hi - low] = cp[lo:hi]
        cost = np.zeros((len(windows), len(wide)), np.int32)
        for row in range(w):
            at = windows[:, None] + row + wide[None, :]
            new = cost + (text[at] != x[windows + row][:, None])
            new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)
            cost = np.minimum.accumulate(new - wide, axis=1) + wide
        fewest = int(cost.min())
        return fewest if fewest <= e else None


def blocks(benchmark: DataFrame, p: Decontam, item_id: str, text: str) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of the items in blocks of about block_chars characters."""
    items = benchmark.select(F.col(item_id).alias("i"), F.col(text).cast("string").alias("t")).where("t is not null")
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    n = math.ceil(total / p.block_chars) or 1
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).orderBy("i", "t").collect()
        yield [r.i for r in rows], [r.t for r in rows]


def contaminated(docs: DataFrame, benchmark: DataFrame, p: Decontam = Decontam(), doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, edits): every document with a passage of an item, once for each item."""
    spark = docs.sparkSession
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = benchmark.schema[item_id].dataType
    schema = f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, item_id {kind.simpleString()}, edits int"
    out = None
    for ids, texts in blocks(benchmark, p, item_id, item_text):
        shared = spark.sparkContext.broadcast((ids, Index(texts, p)))

        @released
        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, index = shared.value
            for whole in batches:
                for batch in slices(whole, "text"):
                    d, i, edits = index.search(strings(batch.column("text")))
                    if len(d):
                        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(d)), pa.array([ids[k] for k in i]), pa.array(edits.astype(np.int32))], names=["doc_id", "item_id", "edits"])

        part = narrow.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, p: Decontam = Decontam(), text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the contaminated ones, with all their columns."""
    spark = docs.sparkSession
    for _, texts in blocks(benchmark, p, item_id, item_text):
        shared = spark.sparkContext.broadcast(Index(texts, p))

        @released
        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in slices(whole, text):
                    d, _, _ = shared.value.search(strings(batch.column(text)))
                    keep = np.ones(batch.num_rows, bool)
                    keep[d] = False
                    yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
