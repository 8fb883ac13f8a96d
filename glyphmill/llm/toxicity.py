"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; other documents are unlabelled, toxic ones among them. A linear classifier
on the presence of words and word beginnings is trained in numpy on the risk
    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))
with the sigmoid loss; where the second part falls below zero its gradient is reversed, so the estimate can't be fitted
below zero. prior is the share of toxic documents; where it is None it is the share among the rows with a label, however
small it is.

Features are words and beginnings of words (`PREFIXES` characters, for inflected and compound forms) that stand in at least
`least_count` positives, in `least_z` standard errors more of them than their share of all documents foretells, and of whose
documents the share that is toxic, by the prior, is at least `least_precision`. They are chosen by counts over all documents
and all positives, and none is left out. The rows that the weights are fitted to are bounded (`positives`, `unlabelled`:
those of the least hashes); the unlabelled ones are of all documents, labelled or not, as the risk demands. Scoring reads
every document whole. Words are matched by 64-bit hash.

Cases: null and empty texts are not toxic; null labels are no labels; repeated labels count once; without any positive, or
any term that tells positives from the rest, nothing is toxic; repeated documents are scored alike; very long texts are read
whole; empty tables give an empty one; a score of 0 is not toxic; ties in the samples' hashes go by doc_id, which may be of
any type that can be ordered; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.llm.textbuf import slices, span_sums, strings, summed_spans, words
from glyphmill.shared import few

PREFIXES = (4, 5, 6)
#: Most ids of positives that are broadcast.
SHIPPED = 1_000_000


@dataclass(frozen=True)
class Toxicity:
    positives: int = 4000
    unlabelled: int = 12000
    prior: float | None = None
    least_count: int = 3
    least_z: float = 5.0
    least_precision: float = 0.5
    steps: int = 400
    rate: float = 0.05
    decay: float = 1e-3
    seed: int = 11


@dataclass(frozen=True)
class Model:
    """Sorted word hashes, their weights, and what is added to their sum; toxic is above 0."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float


def terms(array: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, texts) of the words, then of the beginnings of each length; a word's own hash is not its beginning's."""
    word, at, (cp, first, last) = words(array)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    yield word, text
    sums, down = span_sums(cp)
    for k in PREFIXES:
        long = np.flatnonzero(last - first >= k)
        yield summed_spans(sums, down, first[long], first[long] + k) ^ np.uint64(k), text[long]


def present(array: pa.Array, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of each feature that stands in a text, once each, by text."""
    if not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # the top bits sift out nearly all other words
    sieve = np.zeros(1 << 20, bool)
    sieve[hashes >> np.uint64(44)] = True
    found = []
    for term, text in terms(array):
        near = np.flatnonzero(sieve[term >> np.uint64(44)])
        slot = np.searchsorted(hashes, term[near])
        slot[slot == len(hashes)] = 0
        hit = hashes[slot] == term[near]
        found.append(text[near[hit]] * np.int64(len(hashes)) + slot[hit])
    both = np.unique(np.concatenate(found))
    return both // len(hashes), both % len(hashes)


def risk_and_gradient(z: np.ndarray, positive: np.ndarray, prior: float) -> tuple[float, float, np.ndarray]:
    """(risk of calling positives negative, corrected risk of calling negatives positive, gradient by the logits z).

    Both for the sigmoid loss. Where the second is below zero its gradient is reversed, and the first has none.
    """
    s = 1 / (1 + np.exp(-z))
    n_pos, n_un = positive.sum(), (~positive).sum()
    first = prior * (1 - s[positive]).mean()
    second = s[~positive].mean() - prior * s[positive].mean()
    slope = s * (1 - s)
    plus = np.where(positive, -slope * prior / n_pos, 0)
    minus = np.where(positive, -slope * prior / n_pos, slope / n_un)
    return first, second, plus + minus if second >= 0 else -minus


def fit(rows: list[np.ndarray], positive: np.ndarray, n_features: int, prior: float, p: Toxicity) -> tuple[np.ndarray, float]:
    """(weights, bias) by gradient steps (Adam) on the corrected risk; rows: the features of each document."""
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    row = np.repeat(np.arange(len(rows)), sizes)
    column = np.concatenate(rows).astype(np.int64) if len(row) else np.zeros(0, np.int64)
    w, b = np.zeros(n_features), 0.0
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for step in range(1, p.steps + 1):
        z = np.clip(b + np.bincount(row, w[column], len(rows)), -30, 30)
        _, _, g_z = risk_and_gradient(z, positive, prior)
        g = np.r_[np.bincount(column, g_z[row], n_features) + p.decay * w / len(rows), g_z.sum()]
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        move = p.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def train(docs: DataFrame, labels: DataFrame, p: Toxicity = Toxicity()) -> Model | None:
    """A model from documents (doc_id, text) and labels (doc_id, toxic); None without positives or features."""
    spark = docs.sparkSession
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    # up to SHIPPED ids are broadcast, so that no text is shuffled
    confirmed = known.where("toxic = 1").select("doc_id", F.lit(True).alias("positive"))
    marked = narrow.join(few(confirmed, SHIPPED), "doc_id", "left").withColumn("positive", F.coalesce("positive", F.lit(False)))
    n_pos, n_all = marked.agg(F.count_if("positive"), F.count("*")).first()
    if not n_pos:
        return None
    share = known.agg(F.avg("toxic")).first()[0]
    prior = p.prior if p.prior is not None else min(float(share), 1 - 1e-6)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                word, text = map(np.concatenate, zip(*terms(strings(batch.column("text")))))
                order = np.lexsort((text, word))
                word, text = word[order], text[order]
                first = np.r_[True, (word[1:] != word[:-1]) | (text[1:] != text[:-1])] if len(word) else np.zeros(0, bool)
                word, text = word[first], text[first]
                at = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.zeros(0, np.int64)
                toxic = np.r_[0, np.cumsum(batch.column("positive").to_numpy(zero_copy_only=False)[text])]
                ends = np.r_[at[1:], len(word)] if len(at) else at
                yield pa.RecordBatch.from_arrays([pa.array(word[at].view(np.int64)), pa.array((toxic[ends] - toxic[at]).astype(np.int64)), pa.array((ends - at).astype(np.int64))], names=["word", "k", "u"])

    counted = marked.mapInArrow(counts, "word long, k long, u long").groupBy("word").agg(F.sum("k").alias("k"), F.sum("u").alias("u"))
    share_all = (F.col("u") + 1) / (n_all + 2)
    z = (F.col("k") - n_pos * share_all) / F.sqrt(n_pos * share_all * (1 - share_all))
    precision = prior * F.col("k") / n_pos / share_all
    found = counted.where((F.col("k") >= p.least_count) & (z >= p.least_z) & (precision >= p.least_precision)).select("word").toArrow()
    hashes = np.sort(found["word"].to_numpy().view(np.uint64))
    if not len(hashes):
        return None

    hashed = [F.xxhash64(F.lit(p.seed), F.col("doc_id")), F.col("doc_id")]
    chosen = marked.where("positive").select("doc_id").distinct().orderBy(*hashed).limit(p.positives).select("doc_id", F.lit(True).alias("positive"))
    others = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(*hashed).limit(p.unlabelled).select("doc_id", F.lit(False).alias("positive"))
    picked = chosen.unionByName(others).collect()
    # bounded by the two sample sizes
    kind = narrow.schema["doc_id"].dataType
    sample = narrow.join(F.broadcast(spark.createDataFrame(picked, T.StructType([T.StructField("doc_id", kind), T.StructField("positive", T.BooleanType())]))), "doc_id")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                text, feature = present(strings(batch.column("text")), hashes)
                ends = np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(feature.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("positive"), lists], names=["doc_id", "positive", "features"])

    rows = sample.mapInArrow(featured, f"doc_id {kind.simpleString()}, positive boolean, features array<int>").toArrow().sort_by("doc_id")
    positive = np.array(rows["positive"].to_pylist(), bool)
    features = [np.array(x, np.int64) for x in rows["features"].to_pylist()]
    if not positive.any() or positive.all():
        return None
    w, b = fit(features, positive, len(hashes), prior, p)
    return Model(hashes, w, b)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score): the classifier's logit for every document; toxic is above 0."""
    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = T.StructType([narrow.schema["doc_id"], T.StructField("score", T.DoubleType())])
    if model is None:
        return narrow.select("doc_id", F.lit(-1.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                text, feature = present(strings(batch.column("text")), model.hashes)
                total = model.bias + np.bincount(text, model.weights[feature], batch.num_rows)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total)], names=schema.names)

    return narrow.mapInArrow(run, schema)


def toxic_documents(docs: DataFrame, labels: DataFrame, p: Toxicity = Toxicity()) -> DataFrame:
    """(doc_id, score) of the documents that the trained classifier calls toxic."""
    return score(docs, train(docs, labels, p)).where("score > 0")
