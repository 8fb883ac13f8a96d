"""Quality rules by compression bands.

Zstandard ratios (compressed bytes over UTF-8 bytes) of the whole text and of fixed chunks of it. A text is rejected
where its ratio lies outside the band of its length: too low is repetitive, too high is incompressible. Short texts
compress badly whatever they say, so the bands widen as the length falls.

Cases: a null or empty text has no ratio and is rejected; very long texts are compressed whole; repeated rows each get
the same verdict; an empty table gives an empty table; other columns pass unchanged, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from glyphmill.llm.textbuf import raw, released, slices, strings


@dataclass(frozen=True)
class Bands:
    """Limits by length. `edges` are byte lengths: band i holds texts of edges[i] <= bytes < edges[i+1].

    low, high: limits of the ratio of a whole text. A chunk is bad outside chunk_low..chunk_high; a text is rejected
    where more than `bad_share` of its bytes lie in bad chunks. The last chunk of a text joins the one before it if it is
    shorter than half a chunk.
    """

    edges: tuple[int, ...] = (1, 16, 64, 256, 1024, 4096, 16384)
    low: tuple[float, ...] = (0.0, 0.30, 0.30, 0.30, 0.25, 0.22, 0.20)
    high: tuple[float, ...] = (math.inf, 2.00, 1.15, 0.85, 0.72, 0.66, 0.62)
    chunk_bytes: int = 2048
    chunk_low: float = 0.22
    chunk_high: float = 0.80
    bad_share: float = 0.3
    level: int = 1


FIELDS = (
    ("n_bytes", T.LongType(), pa.int64()),
    ("ratio", T.DoubleType(), pa.float64()),
    ("chunk_ratio_min", T.DoubleType(), pa.float64()),
    ("chunk_ratio_max", T.DoubleType(), pa.float64()),
    ("bad_share", T.DoubleType(), pa.float64()),
    ("verdict", T.StringType(), pa.string()),
)


def chunk_edges(n: int, size: int) -> list[int]:
    """Where the chunks of n bytes end; the first starts at 0."""
    edges = list(range(size, n, size))
    if edges and n - edges[-1] < size / 2:
        edges.pop()
    return [*edges, n]


def measure(text: bytes, bands: Bands, squeeze) -> tuple:
    """(bytes, ratio, least and greatest chunk ratio, share of bytes in bad chunks, verdict) of one text."""
    n = len(text)
    if not n:
        return 0, None, None, None, None, "empty"
    ratio = len(squeeze(text)) / n
    edges = chunk_edges(n, bands.chunk_bytes)
    if len(edges) == 1:
        least = most = ratio
        bad = 0
    else:
        least, most, bad, start = np.inf, 0.0, 0, 0
        for end in edges:
            r = len(squeeze(text[start:end])) / (end - start)
            least, most = min(least, r), max(most, r)
            if not bands.chunk_low <= r <= bands.chunk_high:
                bad += end - start
            start = end
    band = int(np.searchsorted(bands.edges, n, side="right")) - 1
    share = bad / n
    if ratio < bands.low[band]:
        verdict = "repetitive"
    elif ratio > bands.high[band]:
        verdict = "incompressible"
    elif share > bands.bad_share:
        verdict = "bad_chunks"
    else:
        verdict = "keep"
    return n, ratio, float(least), float(most), share, verdict


def _squeezer(level: int):
    return zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False, write_dict_id=False).compress


def compression_ratios(docs: DataFrame, bands: Bands = Bands(), text: str = "text", keep_only: bool = False, columns: list[str] | None = None) -> DataFrame:
    """The chosen columns of docs (all by default), then those of FIELDS; with keep_only the kept rows and no new columns.

    One pass without a shuffle. Where a chosen column has the name of a new one, the new one replaces it.
    """
    names = columns if columns is not None else docs.columns
    kept = names if keep_only else [c for c in names if c not in {f[0] for f in FIELDS}]
    source = docs.select(*dict.fromkeys([*kept, text]))
    fields = [source.schema[c] for c in kept]
    schema = T.StructType(fields if keep_only else fields + [T.StructField(n, t) for n, t, _ in FIELDS])

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = _squeezer(bands.level)
        for whole in batches:
            for batch in slices(whole, text):
                data, at = raw(strings(batch.column(text)))
                view = memoryview(data)
                found = [measure(view[at[i] : at[i + 1]], bands, squeeze) for i in range(batch.num_rows)]
                if keep_only:
                    mask = pa.array([f[-1] == "keep" for f in found])
                    yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in kept], names=kept)
                else:
                    new = [pa.array([f[i] for f in found], k) for i, (_, _, k) in enumerate(FIELDS)]
                    yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + new, names=schema.names)

    return source.mapInArrow(run, schema)


def keep_good(docs: DataFrame, bands: Bands = Bands(), text: str = "text") -> DataFrame:
    """The documents whose ratios lie within their bands, with all their columns."""
    return compression_ratios(docs, bands, text, keep_only=True)
