"""Training-order materialisation of token ids in fixed-stride binary shards.

Each document's ids and an end token are cut into sequences of `length` ids, the last filled up with `pad`. Sequences are
numbered 0..n-1 in the order (doc_id, text hash, piece); a keyed Feistel permutation with cycle walking gives each number
its global slot. Slots are cut into shards of `per_shard` sequences. A shard is one byte string in which the sequence of
slot s starts at (s - first slot) * length * bytes_per_id, so reading in training order is reading in file order, and
a reader resumes at any slot by seeking. The slot of any sequence, and the sequence of any slot, follow from n and key.

1. Documents are tokenised where they are read; the Python worker writes the ids of its part of the table to a file and
   hands on keys, places in the part and sequence counts alone. A part is named by a number that its task draws, so that
   the file of a task that failed is not taken for that of the one that succeeded.
2. These are range-partitioned and sorted; counts for each partition give its first number. The numbers go back to the
   parts as one small file for each. Texts and ids are never shuffled to be numbered.
3. In `rounds` rounds over successive slots, each part's files are read by one Python worker, and only the sequences of
   the round reach the executor; they are range-partitioned by slot, whole shards together, sorted, and joined into shards
   by the worker that writes these. The shuffle of a round ends with it, which bounds what they take beside the shards.
   Ids and numbers are deleted after the last.

The shared folder must be one that Python can open on every executor (a mounted file system), here and in write_shards.

Cases: null and empty texts have no sequence; rows with one key and text are interchangeable; null keys come first; very
long texts give many sequences; an empty table gives no shard; other columns don't matter; ids that don't fit bytes_per_id
are an error.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.llm.bpe import Bpe, build, codec, read_ranks
from glyphmill.llm.shard import permute
from glyphmill.llm.textbuf import SLICE_BYTES, ragged, released, slices, strings
from glyphmill.shared import drop_shared, local_path, shared_path, write_shared


JOINED = "shard long, first_slot long, n_sequences long, stride int, payload binary"
WRITTEN = "shard long, first_slot long, n_sequences long, stride int, path string, bytes long, written boolean"
#: Documents that are read from a part's file at once, at most; row groups end them sooner.
PER_READ = 1_000
#: Rows about shards in a file of what a round returns.
PER_FILE = 100_000


@dataclass(frozen=True)
class TokenShards:
    """end, pad: ids outside the ranked vocabulary or in it. bytes_per_id: 2 or 4, little-endian. rounds: see above."""

    vocabulary: str
    length: int = 512
    per_shard: int = 2048
    key: int = 97
    end: int = 50256
    pad: int = 50256
    bytes_per_id: int = 2
    rounds: int = 6

    @property
    def dtype(self) -> np.dtype:
        return np.dtype(f"<u{self.bytes_per_id}")

    @property
    def stride(self) -> int:
        return self.length * self.bytes_per_id


@dataclass(frozen=True)
class Held:
    """Folders of the parts' ids (`<part>.parquet`, in order of place) and of the first numbers (`<part>.npy`), as Python opens them."""

    tokens: str
    numbers: str
    parts: tuple[int, ...]
    n: int


def tokenised(docs: DataFrame, p: TokenShards, folder: str) -> DataFrame:
    """(part, place, k, h, n_sequences) of each document with ids; k: doc_id, h: text hash. ids go to `folder/<part>.parquet`."""
    spark = docs.sparkSession
    most = max(len(read_ranks(p.vocabulary)) - 1, p.end, p.pad)
    if most >= 1 << 8 * p.bytes_per_id:
        raise ValueError(f"id {most} does not fit {p.bytes_per_id} bytes")
    name = build(spark, Bpe(p.vocabulary), [])
    narrow = docs.select(F.col("doc_id").alias("k"), F.col("text").cast("string").alias("text")).where("text <> ''")
    placed = narrow.select("k", F.xxhash64("text").alias("h"), "text")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(name)
        before, part, file = 0, int.from_bytes(os.urandom(8), "little") >> 1, None
        try:
            for whole in batches:
                for batch in slices(whole, "text"):
                    ids, n = coder.encode(strings(batch.column("text")))
                    pieces = (n + 1 + p.length - 1) // p.length
                    size = pieces * p.length
                    out = np.full(int(size.sum()), p.pad, p.dtype)
                    starts = np.cumsum(size) - size
                    out[ragged(n, starts)] = ids
                    out[starts + n] = p.end
                    offsets = np.r_[0, np.cumsum(size * p.bytes_per_id)]
                    if offsets[-1] >= 1 << 31:
                        raise ValueError("one document has 2 GB of ids or more")
                    packed = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)])
                    rows = pa.RecordBatch.from_arrays([packed], names=["ids"])
                    if file is None:
                        os.makedirs(folder, exist_ok=True)
                        file = pq.ParquetWriter(f"{folder}/{part}.parquet", rows.schema, compression="zstd", use_dictionary=False, write_statistics=False)
                    file.write_batch(rows)
                    place = np.arange(before, before + len(n))
                    before += len(n)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part)), pa.array(place), batch.column("k"), batch.column("h"), pa.array(pieces)], names=["part", "place", "k", "h", "n_sequences"])
        finally:
            if file is not None:
                file.close()

    fields = [("part", T.LongType()), ("place", T.LongType()), ("k", narrow.schema["k"].dataType), ("h", T.LongType()), ("n_sequences", T.LongType())]
    return placed.mapInArrow(run, T.StructType([T.StructField(*f) for f in fields]))


def stretches(of: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of each run of equal values."""
    edges = np.r_[0, np.flatnonzero(np.diff(of)) + 1, len(of)].tolist()
    return list(zip(edges[:-1], edges[1:]))


def first_numbers(keys: DataFrame, folder: str) -> tuple[list[int], int]:
    """(the parts of keys, number of sequences); the number of the first sequence of each document, in the order (k, h),
    goes to `folder/<part>.npy` in order of place. Rows alike in both are spread by their place.
    """
    spark = keys.sparkSession
    order = [F.col("k").asc_nulls_first(), F.col("h"), F.col("place"), F.col("part")]
    ranged = keys.select("k", "h", "place", "part", "n_sequences").repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in batches:
            n = batch.column("n_sequences").to_numpy()
            first = before + np.cumsum(n) - n
            before += int(n.sum())
            yield pa.RecordBatch.from_arrays([batch.column("range"), batch.column("part"), batch.column("place"), pa.array(first, pa.int64()), pa.array(n, pa.int64())], names=["range", "part", "place", "first", "n"])

    local = write_shared(ranged.select(F.spark_partition_id().alias("range"), "part", "place", "n_sequences").mapInArrow(run, "range int, part long, place long, first long, n long"), "numbers")
    total, starts = 0, []
    for k, size in sorted((r[0], r[1]) for r in local.groupBy("range").agg(F.sum("n")).collect()):
        starts.append((k, total))
        total += size
    # one row for each range
    offsets = spark.createDataFrame(starts, "range int, base long")
    numbers = local.join(F.broadcast(offsets), "range").select("part", "place", (F.col("base") + F.col("first")).alias("first"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        part, held = None, []

        def done() -> pa.RecordBatch:
            path = f"{folder}/{part}.npy"
            with open(f"{path}.{os.getpid()}.part", "wb") as f:
                np.save(f, np.concatenate(held))
            os.replace(f"{path}.{os.getpid()}.part", path)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64())], names=["part"])

        for batch in batches:
            of, first = batch.column("part").to_numpy(), batch.column("first").to_numpy()
            for a, b in stretches(of) if len(of) else []:
                if part is not None and of[a] != part:
                    yield done()
                    held = []
                part = int(of[a])
                held.append(first[a:b].copy())
        if part is not None:
            yield done()

    parts = [r.part for r in numbers.repartition("part").sortWithinPartitions("part", "place").mapInArrow(keep, "part long").collect()]
    drop_shared(local)
    return sorted(parts), total


def sequences(docs: DataFrame, p: TokenShards) -> Held:
    """The ids of docs, cut into sequences, and their numbers, as files."""
    spark = docs.sparkSession
    tokens, numbers = local_path(shared_path(spark, "tokens")), local_path(shared_path(spark, "first"))
    keys = write_shared(tokenised(docs, p, tokens), "keys")
    parts, n = first_numbers(keys, numbers)
    drop_shared(keys)
    return Held(tokens, numbers, tuple(parts), n)


def slotted(spark: SparkSession, held: Held, p: TokenShards, first: int, last: int) -> DataFrame:
    """(slot, ids) of the sequences of the slots first..last-1, a task for each part."""
    def batch_of(slots: list[np.ndarray], rows: list[np.ndarray]) -> pa.RecordBatch:
        slot, data = np.concatenate(slots), np.concatenate(rows)
        ends = (np.arange(len(slot) + 1) * p.stride).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(slot), pa.Array.from_buffers(pa.binary(), len(slot), [None, pa.py_buffer(ends), pa.py_buffer(data)])], names=["slot", "ids"])

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k in (k for batch in batches for k in batch.column("id").to_pylist()):
            base = np.load(f"{held.numbers}/{held.parts[k]}.npy")
            before, slots, rows, count = 0, [], [], 0
            with pq.ParquetFile(f"{held.tokens}/{held.parts[k]}.parquet") as file:
                for batch in file.iter_batches(PER_READ, use_threads=False):
                    column = batch.column("ids")
                    _, offsets, data = column.buffers()
                    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
                    slot = permute(ragged(np.diff(at) // p.stride, base[before : before + len(column)]), held.n, p.key)
                    before += len(column)
                    chosen = (slot >= first) & (slot < last)
                    slots.append(slot[chosen])
                    rows.append(np.frombuffer(data, np.uint8)[at[0] : at[-1]].reshape(-1, p.stride)[chosen])
                    count += len(slots[-1])
                    if count * p.stride >= SLICE_BYTES:
                        yield batch_of(slots, rows)
                        slots, rows, count = [], [], 0
            if before != len(base):
                raise ValueError(f"part {held.parts[k]} has {before} documents and {len(base)} numbers")
            if count:
                yield batch_of(slots, rows)

    return spark.range(0, len(held.parts), 1, max(1, len(held.parts))).mapInArrow(run, "slot long, ids binary")


def ranged(spark: SparkSession, held: Held, p: TokenShards, first: int, last: int) -> DataFrame:
    """(shard, ids) of all sequences of the shards first..last-1, whole shards together, in order of their slots."""
    per = p.per_shard
    rows = slotted(spark, held, p, first * per, last * per).withColumn("shard", F.floor(F.col("slot") / per).cast("long"))
    wanted = spark.conf.get("spark.sql.shuffle.partitions")
    # shards are filled alike, so ranges need no sample
    tasks = max(1, min(int(wanted), last - first))
    by = rows.repartitionById(tasks, ((F.col("shard") - first) * tasks / max(1, last - first)).cast("int"))
    return by.sortWithinPartitions("slot").select("shard", "ids")


def joiner(p: TokenShards) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What joins batches of ranged() into rows of JOINED."""
    per = p.per_shard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, count = None, [], 0

        def done() -> pa.RecordBatch:
            data = b"".join(held)
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int64()), pa.array([shard * per], pa.int64()), pa.array([count], pa.int64()), pa.array([p.stride], pa.int32()), pa.array([data], pa.binary())],
                names=["shard", "first_slot", "n_sequences", "stride", "payload"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            of = batch.column("shard").to_numpy()
            column = batch.column("ids")
            for a, b in stretches(of):
                if shard is not None and of[a] != shard:
                    yield done()
                    held, count = [], 0
                shard = int(of[a])
                held.append(b"".join(column.slice(a, b - a).to_pylist()))
                count += b - a
        if shard is not None:
            yield done()

    return run


def shards(docs: DataFrame, p: TokenShards) -> DataFrame:
    """(shard, first_slot, n_sequences, stride, payload): every shard as the bytes of its file."""
    held = sequences(docs, p)
    return ranged(docs.sparkSession, held, p, 0, -(-held.n // p.per_shard)).mapInArrow(joiner(p), JOINED)


def materialise(docs: DataFrame, p: TokenShards, folder: str) -> DataFrame:
    """All shards of docs, written to folder in p.rounds rounds with a manifest; what write_shards returns for each."""
    spark = docs.sparkSession
    held = sequences(docs, p)
    n, total = held.n, -(-held.n // p.per_shard)
    with open(p.vocabulary, "rb") as f:
        manifest = {"sequences": n, "shards": total, "key": p.key, "length": p.length, "per_shard": p.per_shard, "bytes_per_id": p.bytes_per_id, "end": p.end, "pad": p.pad, "vocabulary_md5": hashlib.md5(f.read()).hexdigest()}
    os.makedirs(folder, exist_ok=True)
    # files beyond the last shard, of another corpus, would be taken for ours
    for name in os.listdir(folder):
        if (m := re.fullmatch(r"shard-(\d{8,})\.bin", name)) and int(m[1]) >= total:
            os.remove(os.path.join(folder, name))
    join, write = joiner(p), writer(folder)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from write(join(batches))

    edges = [total * k // p.rounds for k in range(p.rounds + 1)]
    done = None
    for first, last in zip(edges[:-1], edges[1:]):
        if first < last or done is None and last == total:
            # a row for each shard: a file for each task would be many that hold next to nothing
            rows = ranged(spark, held, p, first, last).mapInArrow(run, WRITTEN).repartition(-(-(last - first) // PER_FILE) or 1)
            part = write_shared(rows, "shards")
            done = part if done is None else done.unionByName(part)
    path = os.path.join(folder, "manifest.json")
    with open(path + ".part", "w") as f:
        json.dump(manifest, f)
    os.replace(path + ".part", path)
    for used in (held.tokens, held.numbers):
        shutil.rmtree(used, ignore_errors=True)
    return done


def write_shards(made: DataFrame, folder: str) -> DataFrame:
    """Write each shard to `<folder>/shard-<number>.bin`; (shard, first_slot, n_sequences, stride, path, bytes, written).

    folder is one that all executors can write, as a mounted file system. A file that holds its payload is left alone,
    so a broken run resumes, and one of another key, corpus or vocabulary is overwritten; files appear under their name only when complete, and are read again after writing.
    """
    return made.mapInArrow(writer(folder), WRITTEN)


def writer(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What writes batches of JOINED rows; see write_shards."""
    def holds(path: str, payload: bytes) -> bool:
        if not os.path.exists(path) or os.path.getsize(path) != len(payload):
            return False
        with open(path, "rb") as f:
            return f.read() == payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            paths, sizes, written = [], [], []
            for shard, payload in zip(batch.column("shard").to_pylist(), batch.column("payload")):
                payload = payload.as_py()
                path = os.path.join(folder, f"shard-{shard:08d}.bin")
                fresh = not holds(path, payload)
                if fresh:
                    part = f"{path}.{os.getpid()}.part"
                    with open(part, "wb") as f:
                        f.write(payload)
                    os.replace(part, path)
                    if not holds(path, payload):
                        raise OSError(f"{path} does not hold what was written")
                paths.append(path)
                sizes.append(len(payload))
                written.append(fresh)
            kept = ["shard", "first_slot", "n_sequences", "stride"]
            columns = [*(batch.column(c) for c in kept), pa.array(paths, pa.string()), pa.array(sizes, pa.int64()), pa.array(written, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "path", "bytes", "written"])

    return run


def read_sequence(folder: str, slot: int, p: TokenShards) -> np.ndarray:
    """The ids of the sequence in a slot, by one seek."""
    shard, place = divmod(slot, p.per_shard)
    with open(os.path.join(folder, f"shard-{shard:08d}.bin"), "rb") as f:
        f.seek(place * p.stride)
        return np.frombuffer(f.read(p.stride), p.dtype)
