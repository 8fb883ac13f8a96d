"""Byte-pair encoding and decoding with a minimal acyclic transducer as lexicon.

Frequent words (pieces that the vocabulary's pattern cuts) are compiled, with their token ids, into a minimal acyclic
automaton that shares prefixes and suffixes. Its transitions carry numbers whose sum along a word's path is the word's
place in a table of id sequences. The automaton and the merge table are one file of arrays, fetched by every executor
and memory-mapped, so all Python workers of a machine share its pages. Words outside the lexicon are merged exactly,
whatever their length: lowest rank first, leftmost of equal ranks. So the lexicon decides speed alone, never an id.

Text is cut by array operations on code points that reproduce the pattern
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
for vocabularies of ranked byte strings (lines of base64 and rank) whose ranks are the ids.

Cases: a null or empty text has no tokens; very long texts and very long words are encoded whole; repeated rows are
encoded alike; ids outside the vocabulary make decoding fail with ValueError; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.llm.textbuf import BREAK, SPACE, classes, ragged, raw, released, slices, strings
from glyphmill.shared import put_file, write_shared

NONE = np.int32(0x7FFFFFFF)
LONG = 96
#: How many merged words a worker remembers.
KNOWN = 300_000
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@dataclass(frozen=True)
class Bpe:
    """vocabulary: path of a file of ranked byte strings. lexicon: how many of the corpus's most frequent words are
    compiled; the rest are merged, so it bounds the file and no result."""

    vocabulary: str
    lexicon: int = 60_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def cut(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Byte offsets where pieces start, plus the end; data: UTF-8 of texts that start at `at[:-1]`."""
    n = len(data)
    if not n:
        return np.zeros(1, np.int64)
    cp = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    byte = np.arange(n + 1) if len(cp) == n else np.r_[np.flatnonzero((data & 0xC0) != 0x80), n]
    m = len(cp)
    kind = np.full(m + 2, BREAK, np.uint8)
    kind[1:-1] = classes()[cp]
    now, before, after = kind[1:-1], kind[:-2], kind[2:]
    first = np.zeros(m + 1, bool)
    first[at if len(cp) == n else np.searchsorted(byte, at)] = True
    last = first[1:]
    first = first[:-1]
    space = now == SPACE
    starts = (now != before) | first
    # the last of several white-space characters stands apart where text follows it
    follows = ~last & (after != SPACE)
    starts |= space & follows
    # a blank joins what follows it
    blank = cp == 32
    joined = np.zeros(m, bool)
    joined[1:] = blank[:-1] & ~space[1:]
    starts &= ~joined | first
    quote = np.flatnonzero((cp == 39) & starts)
    if len(quote):
        padded = np.r_[cp, np.zeros(3, np.uint32)]
        ended = np.r_[first, True, True, True]
        one, two = padded[quote + 1], padded[quote + 2]
        ok1, ok2 = ~ended[quote + 1], ~ended[quote + 1] & ~ended[np.minimum(quote + 2, m)]
        short = ok1 & np.isin(one, [ord(c) for c in "stmd"])
        pairs = [(ord(c[0]), ord(c[1])) for c in CONTRACTIONS if len(c) == 2]
        long = ok2 & np.logical_or.reduce([(one == a) & (two == b) for a, b in pairs])
        size = np.where(short, 2, np.where(long, 3, 0))
        found, size = quote[size > 0], size[size > 0]
        starts[found + 1] = False
        stop = found + size
        starts[stop[stop < m]] = True
    return np.r_[byte[:-1][starts], n]


# ---- lexicon ----


def compile_words(words: list[bytes]) -> dict[str, np.ndarray]:
    """The minimal acyclic automaton of sorted distinct words: transitions keyed by state * 256 + byte, sorted.

    add: sums along a path to the word's place among the words. final: whether a word ends in a state; 0 is the start.
    """
    register: dict[tuple, int] = {}
    stored: list[tuple[bool, tuple]] = []
    ends: list[bool] = [False]
    path: list[list[tuple[int, int]]] = [[]]

    def close(depth: int, previous: bytes) -> None:
        while len(path) > depth + 1:
            node = (ends.pop(), tuple(path.pop()))
            state = register.get(node)
            if state is None:
                state = register[node] = len(stored)
                stored.append(node)
            path[-1].append((previous[len(path) - 1], state))

    previous = b""
    for word in words:
        common = 0
        while common < min(len(word), len(previous)) and word[common] == previous[common]:
            common += 1
        close(common, previous)
        for _ in range(common, len(word)):
            path.append([])
            ends.append(False)
        ends[-1] = True
        previous = word
    close(0, previous)
    stored.append((ends[0], tuple(path[0])))
    # the root becomes state 0
    number = {old: new for new, old in enumerate([len(stored) - 1, *range(len(stored) - 1)])}
    count = np.zeros(len(stored), np.int64)
    for i, (end, edges) in enumerate(stored):
        count[i] = end + sum(count[s] for _, s in edges)
    keys, to, add = [], [], []
    final = np.zeros(len(stored), np.uint8)
    for i, (end, edges) in enumerate(stored):
        final[number[i]] = end
        total = int(end)
        for byte, state in edges:
            keys.append(number[i] * 256 + byte)
            to.append(number[state])
            add.append(total)
            total += int(count[state])
    order = np.argsort(np.array(keys, np.int64), kind="stable") if keys else np.zeros(0, np.int64)
    pick = lambda x, kind: np.array(x, kind)[order]
    return {"keys": pick(keys, np.int64), "to": pick(to, np.int32), "add": pick(add, np.int32), "final": final}


SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _slots(keys: np.ndarray, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (keys.view(np.uint64) * SPREAD >> np.uint64(65 - size.bit_length())).view(np.int64)


def _table(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An open-addressing table at a load of at most 1/4; empty slots hold -1."""
    size = 1 << (4 * len(keys)).bit_length()
    table, out = np.full(size, -1, np.int64), np.full(size, NONE, np.int32)
    left, at = np.arange(len(keys)), _slots(keys, size)
    while len(left):
        free = table[at] == -1
        table[at[free]] = keys[left[free]]
        done = table[at] == keys[left]
        out[at[done]] = values[left[done]]
        left, at = left[~done], (at[~done] + 1) & (size - 1)
    return table, out


def merge_table(ranks: dict[bytes, int]) -> dict[str, np.ndarray]:
    """Every pair of tokens whose bytes together are a token, in a hash table; the pair's rank is that token's id."""
    pairs, made = [], []
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                pairs.append(a << 32 | b)
                made.append(rank)
    pairs_, made_ = _table(np.array(pairs, np.int64), np.array(made, np.int32))
    size = max(ranks.values()) + 1
    tokens = [b""] * size
    for token, rank in ranks.items():
        tokens[rank] = token
    lengths = np.array([len(t) for t in tokens], np.int32)
    single = np.full(256, -1, np.int32)
    for byte in range(256):
        single[byte] = ranks.get(bytes([byte]), -1)
    if (single < 0).any():
        raise ValueError("the vocabulary lacks a byte")
    return {"pairs": pairs_, "made": made_, "single": single, "token_at": np.r_[0, np.cumsum(lengths)].astype(np.int64), "token_bytes": np.frombuffer(b"".join(tokens), np.uint8)}


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    """Arrays as one file: a JSON header, then each array on a boundary of 64 bytes."""
    head, body, place = {}, [], 0
    for name, a in arrays.items():
        a = np.ascontiguousarray(a)
        head[name] = [a.dtype.str, len(a), place]
        data = a.tobytes()
        body.append(data + b"\0" * (-len(data) % 64))
        place += len(body[-1])
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 64)
    return len(text).to_bytes(8, "little") + text + b"".join(body)


def unpack(path: str) -> dict[str, np.ndarray]:
    whole = np.memmap(path, np.uint8, "r")
    n = int.from_bytes(whole[:8].tobytes(), "little")
    head = json.loads(whole[8 : 8 + n].tobytes())
    out = {}
    for name, (kind, size, place) in head.items():
        kind = np.dtype(kind)
        out[name] = np.asarray(whole[8 + n + place : 8 + n + place + size * kind.itemsize]).view(kind)
    return out


class Codec:
    """Encoder and decoder over the arrays of a packed file."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.a = arrays
        self.known: dict[bytes, int] = {}
        self.kept = np.zeros(0, np.int32)
        self.kept_at = np.zeros(1, np.int64)
        self.pairs = {}

    # exact merging

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        table, made = self.a["pairs"], self.a["made"]
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = _slots(key, len(table))
        held = table[at]
        out = np.where(held == key, made[at], NONE)
        again = np.flatnonzero((held != key) & (held != -1))
        while len(again):
            at = (at[again] + 1 if len(at) != len(again) else at + 1) & (len(table) - 1)
            held, key = table[at], key[again] if len(key) != len(again) else key
            hit = held == key
            out[again[hit]] = made[at[hit]]
            on = ~hit & (held != -1)
            again, at, key = again[on], at[on], key[on]
        return out

    def merge_many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in turn, how many each has), by lowest-rank merges of many words in lockstep."""
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        order = np.argsort(lengths, kind="stable")
        short = int(np.searchsorted(lengths[order], LONG, side="right"))
        step, parts, sizes = 4096, [], []
        for k in range(0, short, step):
            part = order[k : min(short, k + step)]
            flat, size = self._lockstep([words[i] for i in part], lengths[part])
            parts.append(flat)
            sizes.append(size)
        for i in order[short:]:
            parts.append(self.merge_long(words[i]))
            sizes.append(np.array([len(parts[-1])]))
        if not parts:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        flat, by_length = np.concatenate(parts), np.concatenate(sizes)
        begin, size = np.empty(n, np.int64), np.empty(n, np.int64)
        begin[order], size[order] = np.cumsum(by_length) - by_length, by_length
        return flat[ragged(size, begin)], size

    def _lockstep(self, words: list[bytes], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, wide = len(words), int(lengths.max())
        columns = np.arange(wide)
        inside = columns < lengths[:, None]
        ids = np.full((n, wide + 1), -1, np.int32)
        ids[:, :-1][inside] = self.a["single"][np.frombuffer(b"".join(words), np.uint8)]
        ranks = np.full((n, wide + 1), NONE, np.int32)
        r, c = np.nonzero(inside[:, 1:])
        ranks[r, c] = self.rank(ids[r, c], ids[r, c + 1])
        left = lengths.copy()
        out_ids = ids.copy()
        live = np.arange(n)
        # rows that can merge no more leave; the rest are kept close together
        while True:
            at = ranks.argmin(1)
            best = ranks[np.arange(len(live)), at]
            go = best != NONE
            if not go.all():
                out_ids[live[~go]] = ids[~go]
                ids, ranks, live, at, best = ids[go], ranks[go], live[go], at[go], best[go]
                if not len(live):
                    break
            take = columns + (columns > at[:, None])
            ids[:, :-1] = np.take_along_axis(ids, take, 1)
            ranks[:, :-1] = np.take_along_axis(ranks, take, 1)
            rows = np.arange(len(live))
            ids[rows, at] = best
            left[live] -= 1
            size = left[live]
            ids[rows, size] = -1
            ranks[rows, size] = NONE
            last = at + 1 >= size
            ranks[rows, at] = np.where(last, NONE, self.rank(best, np.where(last, 0, ids[rows, at + 1])))
            prior = np.flatnonzero(at > 0)
            ranks[prior, at[prior] - 1] = self.rank(ids[prior, at[prior] - 1], best[prior])
        return out_ids[:, :-1][columns < left[:, None]], left

    def merge_long(self, word: bytes) -> np.ndarray:
        """The ids of one long word, by a heap of its pairs."""
        ids = self.a["single"][np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = np.array(ids, np.int32)
        first = self.rank(pairs[:-1], pairs[1:])
        heap = [(int(r), i) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)
        current = first.tolist() + [int(NONE)]

        def again(i: int) -> None:
            j = after[i]
            if j >= n:
                current[i] = int(NONE)
                return
            key = ids[i] << 32 | ids[j]
            found = self.pairs.get(key)
            if found is None:
                found = self.pairs[key] = int(self.rank(np.array([ids[i]]), np.array([ids[j]]))[0])
            current[i] = found
            if found != NONE:
                heapq.heappush(heap, (found, i))

        while heap:
            rank, i = heapq.heappop(heap)
            if ids[i] < 0 or current[i] != rank:
                continue
            j = after[i]
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            again(i)
            if before[i] >= 0:
                again(before[i])
        if len(self.pairs) > 1_000_000:
            self.pairs.clear()
        return np.array([x for x in ids if x >= 0], np.int32)

    # lexicon

    def look_up(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The place in the lexicon of each word data[at[i]:at[i+1]]; -1 where it has none."""
        n = len(at) - 1
        out = np.full(n, -1, np.int64)
        keys, to, add, final = (self.a[k] for k in ("keys", "to", "add", "final"))
        if not len(keys):
            return out
        lengths = np.diff(at)
        alive = np.arange(n)
        state, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
        depth = 0
        while len(alive):
            done = lengths[alive] == depth
            if done.any():
                ok = done & (final[state] > 0)
                out[alive[ok]] = total[ok]
                alive, state, total = alive[~done], state[~done], total[~done]
                if not len(alive):
                    break
            key = state * 256 + data[at[alive] + depth]
            edge = np.searchsorted(keys, key)
            edge[edge == len(keys)] = 0
            on = keys[edge] == key
            edge, alive = edge[on], alive[on]
            state, total = to[edge].astype(np.int64), total[on] + add[edge]
            depth += 1
        return out

    # whole texts

    def encode(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each text has)."""
        data, at = raw(array)
        starts = cut(data, at)
        n = len(starts) - 1
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(array), np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        coded = pieces.dictionary_encode()
        codes = coded.indices.to_numpy()
        words = coded.dictionary
        _, offsets, buffer = words.buffers()
        where = np.frombuffer(offsets, np.int64)[: len(words) + 1]
        place = self.look_up(np.frombuffer(buffer, np.uint8), where)
        id_at, table = self.a["id_at"], self.a["ids"]
        begin, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        have = place >= 0
        begin[have] = id_at[place[have]]
        size[have] = id_at[place[have] + 1] - begin[have]
        parts, used = [np.asarray(table)], len(table)
        unseen = np.flatnonzero(~have)
        if len(unseen):
            # words merged before keep their place in one growing array
            raw_words = words.take(pa.array(unseen)).to_numpy(zero_copy_only=False).tolist()
            index = np.fromiter(map(self.known.get, raw_words, repeat(-1)), np.int64, len(raw_words))
            new = np.flatnonzero(index < 0)
            if len(self.known) + len(new) > KNOWN:
                self.known.clear()
                self.kept = np.zeros(0, np.int32)
                self.kept_at = np.zeros(1, np.int64)
                new = np.arange(len(raw_words))
            if len(new):
                fresh = [raw_words[i] for i in new]
                found, n_ids = self.merge_many(fresh)
                index[new] = len(self.known) + np.arange(len(new))
                self.known.update(zip(fresh, index[new].tolist()))
                self.kept_at = np.r_[self.kept_at, len(self.kept) + np.cumsum(n_ids)]
                self.kept = np.r_[self.kept, found]
            begin[unseen] = used + self.kept_at[index]
            size[unseen] = self.kept_at[index + 1] - self.kept_at[index]
            parts.append(self.kept)
        flat = np.concatenate(parts)
        lengths = size[codes]
        ids = flat[ragged(lengths, begin[codes])]
        ends = np.r_[0, np.cumsum(lengths)][np.searchsorted(starts, at)]
        return ids, np.diff(ends)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids in turn."""
        at, data = self.a["token_at"], self.a["token_bytes"]
        if len(ids) and (ids.min() < 0 or ids.max() >= len(at) - 1):
            raise ValueError("an id is outside the vocabulary")
        begin = at[ids]
        return data[ragged(at[ids + 1] - begin, begin)]


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): how often each piece stands in all of docs."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def squeezed() -> pa.Table:
            return pa.concat_tables(held).combine_chunks().group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

        for whole in batches:
            for batch in slices(whole, text):
                data, at = raw(strings(batch.column(text)))
                starts = cut(data, at)
                if len(starts) < 2:
                    continue
                pieces = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
                counted = pieces.value_counts()
                held.append(pa.table({"word": counted.field(0), "n": counted.field(1)}))
                if len(held) > 24:
                    held[:] = [squeezed()]
                    if held[0].num_rows > 1_000_000:
                        yield from _plain(held.pop())
        if held:
            yield from _plain(squeezed())

    return docs.select(F.col(text).cast("string").alias(text)).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _plain(table: pa.Table) -> list[pa.RecordBatch]:
    return table.select(["word", "n"]).cast(pa.schema([("word", pa.binary()), ("n", pa.int64())])).to_batches(max_chunksize=50_000)


def build(spark: SparkSession, p: Bpe, words: list[bytes]) -> str:
    """Compile the words and put the file where executors fetch it; its name."""
    return put_file(spark, "lexicon", pack(compiled(p, words)))


def compiled(p: Bpe, words: list[bytes]) -> dict[str, np.ndarray]:
    merges = merge_table(read_ranks(p.vocabulary))
    words = sorted(set(words))
    ids, sizes = Codec(merges).merge_many(words)
    arrays = merges | compile_words(words)
    arrays["id_at"] = np.r_[0, np.cumsum(sizes)].astype(np.int64)
    arrays["ids"] = ids
    return arrays


def frequent(docs: DataFrame, p: Bpe, text: str = "text") -> list[bytes]:
    """The most frequent words of all of docs, at most p.lexicon.

    Words are ranked by bands of their counts, eight to a doubling; a band enters whole or not at all. So only the bands'
    sizes and the chosen words reach the driver, and no task gathers candidates from all others.
    """
    counts = write_shared(word_counts(docs, text).where("n > 1").withColumn("band", F.floor(F.log2("n") * 8)), "words")
    sizes = sorted(((r[0], r[1]) for r in counts.groupBy("band").count().collect()), reverse=True)
    total, least = 0, None
    for band, n in sizes:
        total += n
        if total > p.lexicon:
            break
        least = band
    if least is None:
        return []
    return [bytes(r.word) for r in counts.where(F.col("band") >= least).select("word").collect()]


_codecs: dict[str, Codec] = {}


def codec(name: str) -> Codec:
    """The codec of a fetched file, mapped once for a worker."""
    if name not in _codecs:
        _codecs.clear()
        _codecs[name] = Codec(unpack(SparkFiles.get(name)))
    return _codecs[name]


def encode_documents(docs: DataFrame, p: Bpe, text: str = "text", doc_id: str = "doc_id", name: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, token_ids, round_trip): the ids of each text; round_trip: decoding them gives its bytes back.

    Two passes over docs: one counts words for the lexicon, one encodes. Only the word counts are shuffled.
    """
    spark = docs.sparkSession
    name = name or build(spark, p, frequent(docs, p, text))
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([narrow.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())])

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(name)
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = strings(batch.column("text"))
                ids, n = coder.encode(texts)
                data, at = raw(texts)
                back = coder.decode(ids)
                if len(back) == len(data) and np.array_equal(back, data):
                    same = np.ones(len(n), bool)
                else:
                    stops = np.r_[0, np.cumsum(n)]
                    same = np.array([np.array_equal(coder.decode(ids[stops[i] : stops[i + 1]]), data[at[i] : at[i + 1]]) for i in range(len(n))])
                offsets = np.r_[0, np.cumsum(n)].astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32, copy=False)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), listed, pa.array(same)], names=schema.names)

    return narrow.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, p: Bpe, name: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, token_ids); null ids give a null text. Bytes that are no UTF-8 become U+FFFD."""
    spark = encoded.sparkSession
    name = name or build(spark, p, [])
    narrow = encoded.select("doc_id", "token_ids")
    schema = T.StructType([narrow.schema["doc_id"], T.StructField("text", T.StringType())])

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(name)
        for batch in batches:
            texts = [None if ids is None else coder.decode(np.array(ids, np.int64)).tobytes().decode(errors="replace") for ids in (x.values.to_numpy() if x.is_valid else None for x in batch.column("token_ids"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=schema.names)

    return narrow.mapInArrow(run, schema)
