"""Near duplicates by SetSketch registers.

A text is the set of its 3-word shingles. Register i of its sketch is floor(1 - log_b(min of register i's exponential
hashes over the set)), truncated to 0..q+1: exponentially spaced truncated minima. The greatest register of two sketches
is the sketch of their union, so sketches merge; two sets' registers are equal about as often as their Jaccard index, so
bands of registers serve as keys of locality-sensitive hashing.

1. One pass over the texts gives each its content key (hash of its words in order), sketch and band keys.
2. Texts with one content key form one node. The least and greatest node of each band key are found by partial
   aggregation; bands with more than one node are buckets.
3. In each bucket the least node is paired with every other. A pair's Jaccard index is estimated (maximum likelihood from
   registers that are greater, less and equal, given both cardinalities) from the sketches alone; the texts of the pairs
   that are near enough are then moved once, side by side, and verified on the exact shingle sets. Verified pairs make
   components.
4. Nodes of one bucket that are still in different components are paired with each other and verified likewise, so that
   no pair of a bucket goes untested unless its nodes are linked already. Components are then final.

Pairs, not whole buckets, move in 3; a bucket of n copies costs n - 1 pairs. Only 4 can be quadratic, in the nodes of a
bucket that are not linked to its least; it works on sketches, and texts move only for the pairs that it leaves. No window
runs over a band, a component or a hub: hot ones are aggregated partially and joined back, and a hub's pairs are cut into
runs of `SALT`. Rows are picked by id with a broadcast of at most `SHIPPED` ids, else by a shuffle of both sides.

Cases: null and empty texts, and texts without words, belong to no group. Repeated rows are copies. A null doc_id is
the last choice to stay; ties in doc_id go by text hash; doc_id may be of any type that can be ordered. Texts of under
three words are one shingle. Very long texts are sketched whole. An empty table gives an empty one. Other columns pass
unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.llm.textbuf import SLICE_BYTES, mix64, released, slices, strings, words
from glyphmill.shared import drop_shared, few, write_shared

BASE_B = 1.001
RATE = 20.0
LIMIT = (1 << 16) - 2
#: Most ids that are broadcast to pick rows, of some 40 bytes each.
SHIPPED = 1_000_000
#: Most edges, of two numbers each, that the driver joins up.
LOCAL_EDGES = 1_000_000
#: Pairs of one hub that are verified in one run.
SALT = 2_000


@dataclass(frozen=True)
class NearDup:
    """threshold: least Jaccard index of shingle sets of a pair. Registers: bands * rows. margin: a pair is verified if
    its estimate is at least threshold - margin; 0.15 is about four standard errors at 160 registers."""

    threshold: float = 0.6
    shingle: int = 3
    bands: int = 32
    rows: int = 5
    margin: float = 0.15
    seed: int = 7

    @property
    def registers(self) -> int:
        return self.bands * self.rows


def shingles(array: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle hashes of all texts, where each text's start plus the end, content key of each text; 0 if no words)."""
    word, at, _ = words(array)
    count = np.diff(at)
    n = np.where(count > 0, np.maximum(count - size + 1, 1), 0)
    starts = np.r_[0, np.cumsum(n)]
    with np.errstate(over="ignore"):
        total = np.zeros(len(word), np.uint64)
        wide = total.copy()
        for k in range(size):
            m = max(0, len(word) - k)
            wide[:m] += mix64(word[k:] + np.uint64(k + 1)) if m else wide[:0]
        # a text's last words start no whole shingle of its own; a short text's one shingle takes all its words
        first = np.repeat(at[:-1] - starts[:-1], n) + np.arange(int(starts[-1]))
        found = mix64(wide[first])
        for i in np.flatnonzero((count > 0) & (count < size)):
            h = np.zeros(1, np.uint64)
            for k in range(at[i], at[i + 1]):
                h += mix64(word[k : k + 1] + np.uint64(k - at[i] + 1))
            found[starts[i]] = mix64(h)[0]
        place = (np.arange(len(word)) - np.repeat(at[:-1], count)).astype(np.uint64)
        sums = np.zeros(len(word) + 1, np.uint64)
        np.cumsum(mix64(word ^ mix64(place + np.uint64(11))), out=sums[1:])
        key = mix64(sums[at[1:]] - sums[at[:-1]] + count.astype(np.uint64))
        key[count == 0] = 0
    return found, starts, key


def coefficients(m: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 1 << 32, m, np.uint64).astype(np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, m, np.uint64).astype(np.uint32)


def registers_of(least: np.ndarray) -> np.ndarray:
    """SetSketch registers from the least 32-bit hashes: exponential with RATE, then truncated logarithms."""
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE_B)), 0, LIMIT + 1).astype(np.uint16)


def sketch(found: np.ndarray, starts: np.ndarray, m: int, seed: int) -> np.ndarray:
    """Registers (texts x m) of each text's shingles; 0 for a text without any."""
    a, b = coefficients(m, seed)
    x = (found >> np.uint64(32)).astype(np.uint32)
    have = np.flatnonzero(np.diff(starts) > 0)
    least = np.empty((m, len(have)), np.uint32)
    if len(have):
        at = starts[have]
        hashed = np.empty_like(x)
        for i in range(m):
            np.multiply(x, a[i], out=hashed)
            np.add(hashed, b[i], out=hashed)
            np.minimum.reduceat(hashed, at, out=least[i])
    out = np.zeros((len(starts) - 1, m), np.uint16)
    out[have] = registers_of(least.T)
    return out


def merge(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sketched sets."""
    return np.maximum(one, other)


def cardinality(sketches: np.ndarray) -> np.ndarray:
    """How many distinct shingles each sketched set has, by estimate."""
    m = sketches.shape[1]
    total = (float(BASE_B) ** -sketches.astype(np.float64)).sum(axis=1)
    return m * (1 - 1 / BASE_B) / (RATE * np.log(BASE_B) * total)


def joint_jaccard(one: np.ndarray, other: np.ndarray, n_one: np.ndarray, n_other: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard index of each pair from its registers and cardinalities."""
    up, down = (one > other).sum(1), (one < other).sum(1)
    same = one.shape[1] - up - down
    u = n_one / (n_one + n_other)
    v = 1 - u
    most = np.minimum(u / v, v / u)

    def p(x: np.ndarray) -> np.ndarray:
        return np.clip(-np.log1p(-x * (BASE_B - 1) / BASE_B) / np.log(BASE_B), 1e-12, 1)

    def value(j: np.ndarray) -> np.ndarray:
        more, less = p(np.maximum(u - v * j, 0)), p(np.maximum(v - u * j, 0))
        return up * np.log(more) + down * np.log(less) + same * np.log(np.clip(1 - more - less, 1e-12, 1))

    # the likelihood is concave in j: golden section
    lo, hi, g = np.zeros_like(u), most, (5**0.5 - 1) / 2
    for _ in range(28):
        c, d = hi - g * (hi - lo), lo + g * (hi - lo)
        left = value(c) >= value(d)
        lo, hi = np.where(left, lo, c), np.where(left, d, hi)
    return (lo + hi) / 2


def band_keys(sketches: np.ndarray, bands: int, rows: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = np.broadcast_to(mix64(np.arange(1, bands + 1, dtype=np.uint64)), (len(sketches), bands)).copy()
        by = sketches.reshape(len(sketches), bands, rows).astype(np.uint64)
        for r in range(rows):
            h = mix64(h ^ (by[:, :, r] + np.uint64(0x9E37)))
    return h.view(np.int64)


def row_id(doc_id: str = "doc_id", text: str = "text"):
    """A hash that names a row: equal only for rows with one doc_id and text."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def sketched(docs: DataFrame, p: NearDup) -> DataFrame:
    """(rid, doc_id, key, sketch, keys) of each document with words."""
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                found, starts, key = shingles(strings(batch.column("text")), p.shingle)
                have = np.flatnonzero(key)
                if not len(have):
                    continue
                s = sketch(found, starts, p.registers, p.seed)[have]
                keys = band_keys(s, p.bands, p.rows)
                flat = pa.array(keys.ravel())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("rid").take(pa.array(have)),
                        batch.column("doc_id").take(pa.array(have)),
                        pa.array(key.view(np.int64)[have]),
                        pa.array([r.tobytes() for r in s], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(have) + 1, dtype=np.int32) * p.bands), flat),
                    ],
                    names=["rid", "doc_id", "key", "sketch", "keys"],
                )

    narrow = docs.select(row_id().alias("rid"), F.col("doc_id"), F.col("text").cast("string").alias("text"))
    fields = [("rid", T.LongType()), ("doc_id", narrow.schema["doc_id"].dataType), ("key", T.LongType()), ("sketch", T.BinaryType()), ("keys", T.ArrayType(T.LongType()))]
    return narrow.mapInArrow(run, T.StructType([T.StructField(*f) for f in fields]))


def estimated(pairs: DataFrame, members: DataFrame, p: NearDup) -> DataFrame:
    """The pairs (a, b) whose estimated Jaccard index reaches threshold - margin; members: (node, sketch)."""
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            of = lambda c: np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1)
            one, other = of("sketch_a"), of("sketch_b")
            close = joint_jaccard(one, other, cardinality(one), cardinality(other)) >= p.threshold - p.margin
            yield batch.select(["a", "b"]).filter(pa.array(close))

    left = members.select(F.col("node").alias("a"), F.col("sketch").alias("sketch_a"))
    right = members.select(F.col("node").alias("b"), F.col("sketch").alias("sketch_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long")


def verified(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, p: NearDup) -> DataFrame:
    """(a, b, jaccard) of the written pairs (a, b) that reach the threshold; nodes: (node, rid) with a row of each.

    Each text goes from the scan straight to the task of its hub a: the hub first, then the texts paired with it.
    """
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT).alias("runs"))
    salted = pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("runs")).alias("salt"))
    hubs = salted.select("a", "salt").distinct().select(F.col("a").alias("node"), "a", "salt", F.lit(None).cast("long").alias("b"))
    leaves = salted.select(F.col("b").alias("node"), "a", "salt", "b")
    roles = write_shared(hubs.unionByName(leaves).join(nodes.select("node", "rid"), "node").select("rid", "a", "salt", "b"), "roles")
    texts = docs.select(row_id().alias("rid"), F.col("text").cast("string").alias("text"))
    moved = texts.join(few(roles, SHIPPED), "rid").select("a", "salt", "b", "text").repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, done, mine = None, None, None
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                found, at, _ = shingles(strings(batch.column("text")), p.shingle)
                rows = zip(batch.column("a").to_pylist(), batch.column("salt").to_pylist(), batch.column("b").to_pylist())
                out: list[tuple[int, int, float]] = []
                for i, (a, salt, b) in enumerate(rows):
                    # rows with one id and text may occur more than once
                    if b is None and hub == (a, salt) or (a, salt, b) == done:
                        continue
                    x = np.unique(found[at[i] : at[i + 1]])
                    if b is None:
                        hub, mine = (a, salt), x
                        continue
                    done = a, salt, b
                    both = len(np.intersect1d(mine, x, assume_unique=True))
                    jaccard = both / (len(mine) + len(x) - both)
                    if jaccard >= p.threshold:
                        out.append((a, b, jaccard))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out]) for k in range(3)], names=["a", "b", "jaccard"])

    return moved.mapInArrow(run, "a long, b long, jaccard double")


def least_labels(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The least member of the component of each of n numbered nodes, from edges (u, v): hooking and pointer jumping."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def components(edges: DataFrame, local: int = LOCAL_EDGES) -> DataFrame:
    """(u, v): each node of the written edges (a, b) and the least node of its connected component; roots have no row.

    Up to `local` edges are joined up on the driver. More go through alternating large and small stars, whose least
    neighbours are aggregated partially and joined back, so that no task holds all edges of a hub.
    """
    spark = edges.sparkSession
    if edges.count() <= local:
        table = edges.select("a", "b").toArrow()
        ids, at = np.unique(np.r_[table["a"].to_numpy(), table["b"].to_numpy()], return_inverse=True)
        root = ids[least_labels(at[: table.num_rows], at[table.num_rows :], len(ids))]
        moved = root != ids
        return write_shared(spark.createDataFrame(pa.table({"u": ids[moved].astype(np.int64), "v": root[moved].astype(np.int64)})), "stars")
    current = write_shared(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "stars")
    mark = None
    while True:
        both = current.select("u", "v").union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = write_shared(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "stars")
        w = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = w.select(F.col("v").alias("u"), F.col("m").alias("v")).union(w.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = write_shared(small, "stars")
        drop_shared(large)
        drop_shared(current)
        current = after
        now = current.agg(F.count("*"), F.sum(F.col("u").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark:
            return current
        mark = now


def linked_nodes(docs: DataFrame, base: DataFrame, p: NearDup) -> DataFrame:
    """(u, v): each node that is linked to others, and the least node of its component; base: the written sketches."""
    used: list[DataFrame] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        used.append(write_shared(df, name))
        return used[-1]

    banded = base.select(F.col("key").alias("node"), F.explode("keys").alias("band"))
    hot = keep(banded.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most").select("band", "least"), "bands")
    buckets = keep(banded.join(hot, "band").select("band", "node", "least").distinct(), "buckets")
    wanted = keep(buckets.select("node").distinct(), "wanted")
    mine = base.withColumnRenamed("key", "node").join(few(wanted, SHIPPED), "node", "leftsemi")
    nodes = keep(mine.groupBy("node").agg(F.min("rid").alias("rid")), "nodes")
    members = keep(mine.select("node", "rid", "sketch").join(few(nodes, SHIPPED), ["node", "rid"], "leftsemi").dropDuplicates(["node"]).select("node", "sketch"), "members")
    starred = keep(buckets.where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    edges = keep(verified(docs, keep(estimated(starred, members, p), "close"), nodes, p), "edges")
    linked = components(edges)
    marks = few(linked, SHIPPED).withColumnsRenamed({"u": "node", "v": "root"})
    labelled = buckets.join(marks, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"))
    torn_bands = labelled.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("band")
    torn = keep(labelled.join(torn_bands, "band"), "torn")
    other = torn.select("band", F.col("node").alias("b"), F.col("root").alias("root_b"))
    cross = torn.select("band", F.col("node").alias("a"), F.col("root").alias("root_a")).join(other, "band").where("a < b and root_a <> root_b").select("a", "b").distinct()
    close = keep(estimated(cross.join(starred, ["a", "b"], "leftanti"), members, p), "close")
    if not close.isEmpty() and not (more := keep(verified(docs, close, nodes, p), "edges")).isEmpty():
        drop_shared(linked)
        linked = components(edges.unionByName(more))
    for df in used:
        drop_shared(df)
    return linked


def groups(docs: DataFrame, p: NearDup = NearDup()) -> DataFrame:
    """(rid, doc_id, node, root, kept_rid, kept_doc_id) of every document with words that has a copy or near copy.

    node: equal for texts of the same words; root: equal for one group; kept_*: the row of the group that stays. Written to
    the shared folder.
    """
    base = write_shared(sketched(docs, p), "sketches")
    linked = linked_nodes(docs, base, p)
    rooted = base.select("rid", "doc_id", F.col("key").alias("node")).join(few(linked, SHIPPED).withColumnsRenamed({"u": "node", "v": "root"}), "node", "left")
    rooted = rooted.select("rid", "doc_id", "node", F.coalesce("root", "node").alias("root"))
    kept = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("rid"))).alias("kept")
    sizes = rooted.groupBy("root").agg(kept, F.count("*").alias("n")).where("n > 1").select("root", F.col("kept.rid").alias("kept_rid"), F.col("kept.doc_id").alias("kept_doc_id"))
    out = write_shared(rooted.join(sizes, "root").select("rid", "doc_id", "node", "root", "kept_rid", "kept_doc_id"), "groups")
    drop_shared(linked)
    drop_shared(base)
    return out


def near_duplicates(docs: DataFrame, p: NearDup = NearDup()) -> DataFrame:
    """(doc_id, kept_doc_id, rows) pairs: each document that goes and the one that stays in its group.

    rows: how many rows of doc_id go; a repeated row of the one that stays is a pair of itself.
    """
    stays = F.max((F.col("rid") == F.col("kept_rid")).cast("long"))
    return groups(docs, p).groupBy("doc_id", "kept_doc_id").agg((F.count("*") - stays).alias("rows")).where("rows > 0")


def drop_near_duplicates(docs: DataFrame, p: NearDup = NearDup()) -> DataFrame:
    """docs with one document of each group: that of the least doc_id."""
    found = groups(docs, p)
    # rows with one id and text are alike to the groups: of those that stay, all are set aside and one comes back
    fate = found.groupBy("rid").agg((F.max("kept_rid") == F.col("rid")).alias("stays"), F.count("*").alias("n"))
    gone = write_shared(fate.where("not stays or n > 1").select("rid", "stays"), "gone")
    drop_shared(found)
    names = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(row_id().alias("rid"), F.struct(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]).alias("row"))
    rows = plain.join(few(gone.select("rid"), SHIPPED), "rid", "leftanti").select("row")
    if not (twice := gone.where("stays").select("rid")).isEmpty():
        again = plain.join(few(twice, SHIPPED), "rid", "leftsemi")
        rows = rows.unionByName(again.groupBy("rid").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row"))
    return rows.select(*[F.col(f"row.{n}").alias(c) for c, n in names.items()])
