"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0..n-1 in the order of their key (doc_id, then a hash of the row's text): they are range-partitioned and
written once, and counts for each partition give its first number, so no task sees the whole table, and rows that are alike
are spread over partitions like others. A keyed Feistel network over the least
rectangle a*b >= n permutes the numbers; a value outside 0..n-1 is sent through again until it falls inside (cycle
walking), which keeps the map a permutation of 0..n-1. position = permuted number; shard and slot follow from position
alone, so any row's place can be computed from its number, the key and n, and any place's row by the inverse.

Cases: null keys come first; rows with one key and text are interchangeable and get successive numbers; null and empty
texts are rows like others; an empty table gives an empty one; input columns named like the new ones are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.operators.ordering import numbered

ROUNDS = 4
#: The round function works in 31 bits, so that SQL engines with 64-bit integers can repeat it exactly.
MODULUS = 2_147_483_647
NEW = ("row_number", "position", "shard", "slot")


@dataclass(frozen=True)
class Shards:
    """shards of equal size, but for one row; key: seed of the permutation."""

    shards: int = 64
    key: int = 20240607


def round_keys(key: int) -> list[tuple[int, int]]:
    """A multiplier and an addend for each round."""
    rng = np.random.default_rng(key)
    return [(int(rng.integers(1 << 16, 1 << 31)) | 1, int(rng.integers(0, MODULUS))) for _ in range(ROUNDS)]


def mixed(x, multiplier: int, addend: int):
    """The round function: two products modulo a Mersenne prime with a shift between; for integers and arrays."""
    y = (x % MODULUS * multiplier + addend) % MODULUS
    y = y ^ (y >> 15)
    return (y * 1_103_515_245 + addend) % MODULUS


def sides(n: int) -> tuple[int, int]:
    a = int(np.ceil(np.sqrt(max(n, 1))))
    while a * a < n:
        a += 1
    return a, -(-max(n, 1) // a)


def permute(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """Where each number of 0..n-1 goes."""
    a, b = sides(n)
    keys = round_keys(key)

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v // b, v % b
        for i, (m, c) in enumerate(keys):
            if i % 2 == 0:
                left = (left + mixed(right, m, c)) % a
            else:
                right = (right + mixed(left, m, c)) % b
        return left * b + right

    return _walk(np.asarray(x, np.int64), n, once)


def unpermute(y: np.ndarray, n: int, key: int) -> np.ndarray:
    """The number that went to each place."""
    a, b = sides(n)
    keys = round_keys(key)

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v // b, v % b
        for i, (m, c) in reversed(list(enumerate(keys))):
            if i % 2 == 0:
                left = (left - mixed(right, m, c)) % a
            else:
                right = (right - mixed(left, m, c)) % b
        return left * b + right

    return _walk(np.asarray(y, np.int64), n, once)


def _walk(x: np.ndarray, n: int, once) -> np.ndarray:
    out = once(x)
    beyond = np.flatnonzero(out >= n)
    while len(beyond):
        out[beyond] = once(out[beyond])
        beyond = beyond[out[beyond] >= n]
    return out


def place(position, n: int, shards: int):
    """(shard, slot) of a position; the first n % shards shards have one row more."""
    small, extra = divmod(n, shards)
    edge = extra * (small + 1)
    shard = np.where(position < edge, position // (small + 1), extra + (position - edge) // max(small, 1))
    first = np.where(shard < extra, shard * (small + 1), edge + (shard - extra) * small)
    return shard, position - first


def with_positions(df: DataFrame, n: int, p: Shards, number: str = "row_number") -> DataFrame:
    """df with position, shard and slot computed from its row number."""
    @F.pandas_udf("position long, shard long, slot long")
    def spread(x: pd.Series) -> pd.DataFrame:
        at = permute(x.to_numpy(), n, p.key)
        shard, slot = place(at, n, p.shards)
        return pd.DataFrame({"position": at, "shard": shard, "slot": slot})

    return df.withColumn("_at", spread(number)).select("*", "_at.position", "_at.shard", "_at.slot").drop("_at")


def assign(docs: DataFrame, p: Shards = Shards(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with NEW columns: every row's number, position, shard and slot. The rows are moved once, to be numbered."""
    names = [c for c in docs.columns if c not in NEW]
    row = F.struct(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names)])
    rows, n = numbered(docs.select(F.col(key).alias("k"), F.xxhash64(F.col(key), F.col(text)).alias("h"), row.alias("row")), ["k", "h"])
    placed = with_positions(rows.select("row", "row_number"), n, p)
    return placed.select(*[F.col(f"row._{i}").alias(c) for i, c in enumerate(names)], *NEW)


def shuffled(docs: DataFrame, p: Shards = Shards(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """assign(), moved so that partitions hold ranges of positions, sorted: each shard's rows lie together in order."""
    return assign(docs, p, key, text).repartitionByRange("position").sortWithinPartitions("position")


def oracle_sql(p: Shards) -> str:
    """DuckDB SQL that repeats assign() on documents with distinct doc_id."""
    keys = round_keys(p.key)
    f = lambda x, m, c: f"((xor((({x}) % {MODULUS} * {m} + {c}) % {MODULUS}, ((({x}) % {MODULUS} * {m} + {c}) % {MODULUS}) >> 15)) * 1103515245 + {c}) % {MODULUS}"
    state = "select id, v // b as l, v % b as r, a, b, n from walk where v is not null and (d = 0 or v >= n)"
    body = state
    for i, (m, c) in enumerate(keys):
        body = f"select id, (l + {f('r', m, c)}) % a as l, r, a, b, n from ({body})" if i % 2 == 0 else f"select id, l, (r + {f('l', m, c)}) % b as r, a, b, n from ({body})"
    walk = body.replace("select id, v // b as l", "select id, v // b as l, d").replace("select id, (l", "select id, d, (l").replace("select id, l,", "select id, d, l,")
    small, extra = f"(n // {p.shards})", f"(n % {p.shards})"
    edge = f"({extra} * ({small} + 1))"
    shard = f"case when position < {edge} then position // ({small} + 1) else {extra} + (position - {edge}) // greatest({small}, 1) end"
    return f"""
with recursive size as (select n, a, (n + a - 1) // a as b from (select n, cast(ceil(sqrt(n)) as bigint) as a from (select greatest(count(*), 1) as n from documents))),
rows as (select doc_id, text, row_number() over (order by doc_id) - 1 as row_number from documents),
walk as (
  select row_number as id, row_number as v, 0 as d, a, b, n from rows, size
  union all
  select id, l * b + r as v, d + 1 as d, a, b, n from ({walk})
),
placed as (select id, v as position, n from walk where d > 0 and v < n),
sharded as (select id, position, n, cast({shard} as bigint) as shard from placed)
select doc_id, text, row_number, position, shard, position - case when shard < {extra} then shard * ({small} + 1) else {edge} + (shard - {extra}) * {small} end as slot
from rows join sharded on id = row_number"""
