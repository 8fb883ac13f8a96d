"""Character and word n-gram TF-IDF retrieval (R3-R7, R11) and rule reranking.

`top_k` joins postings and serves tables that are near in size. `search` holds a bounded set of queries against a corpus of
any size: the corpus is scanned twice, once to count in how many texts each term stands and once to score, and nothing
of it is shuffled but those counts and each task's best matches.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.functions.text import chars, let, punctuation_excess, text_or_empty, windows
from glyphmill.operators.ordering import first_by


def char_terms(c: Column, low: int, high: int) -> Column:
    """All n-grams of low..high characters, white space collapsed, with repeats."""
    collapsed = F.regexp_replace(text_or_empty(c), r"\s\s+", " ")
    return let(chars(collapsed), lambda x: F.concat(*[windows(x, n) for n in range(low, high + 1)]))


def counts(df: DataFrame, key: str, text: str, low: int, high: int) -> DataFrame:
    """(key, term, tf)."""
    return df.select(F.col(key), F.explode(char_terms(F.col(text), low, high)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def tfidf(df: DataFrame, key: str, text: str, low: int = 3, high: int = 3, min_df: int = 1, max_df: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """((key, term, weight) normalised to length 1, (term, idf)); idf = ln((1 + n) / (1 + df)) + 1."""
    tf = counts(df, key, text, low, high)
    n = df.agg(F.count("*").alias("n"))
    terms = tf.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n")))
    idf = terms.select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    return weighted(tf, idf, key), idf


def weighted(tf: DataFrame, idf: DataFrame, key: str) -> DataFrame:
    """Weights of counted terms; terms without an idf are dropped."""
    w = tf.join(idf, "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return w.select(key, "term", (F.col("w") / norm).alias("weight"))


def top_k(queries: DataFrame, corpus: DataFrame, query_key: str, corpus_key: str, k: int, least: float = 0.0, exclude_self: bool = False) -> DataFrame:
    """(query, match, sim, rank): the k nearest of the corpus to each query by cosine, ties by match.

    Postings are joined on the term, so only pairs that share one are formed.
    """
    q = queries.select(F.col(query_key).alias("query"), "term", F.col("weight").alias("wq"))
    c = corpus.select(F.col(corpus_key).alias("match"), "term", F.col("weight").alias("wc"))
    sims = q.join(c, "term").groupBy("query", "match").agg(F.round(F.sum(F.col("wq") * F.col("wc")), 6).alias("sim"))
    if exclude_self:
        sims = sims.where(F.col("query") != F.col("match"))
    return first_by(sims.where(F.col("sim") >= least), ["query"], [F.desc("sim"), F.asc("match")], k, "rank")


#: Most queries, and most different terms of a corpus, that are sent to every task.
QUERIES, TERMS = 20_000, 2_000_000
#: Most cells of a table of terms by queries; beyond, terms have lists of queries.
CELLS = 8_000_000


class TooMany(ValueError):
    """Beyond the bounds of `search`."""


def terms_in(text: str | None, low: int, high: int, words: bool = False) -> list[str]:
    """The n-grams of a text, with repeats: of characters with white space collapsed, or of words."""
    if words:
        w = re.findall(r"\b\w+\b", text or "")
        return [" ".join(w[i : i + n]) for n in range(low, high + 1) for i in range(len(w) - n + 1)]
    s = re.sub(r"\s\s+", " ", text or "")
    return [s[i : i + n] for n in range(low, high + 1) for i in range(len(s) - n + 1)]


def terms_of(text: str | None, low: int, high: int, words: bool = False) -> Counter:
    """How often each n-gram of a text stands in it."""
    return Counter(terms_in(text, low, high, words))


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The different runs of three characters of a text as sorted numbers, 21 bits for each, and how often each stands in it."""
    s = re.sub(r"\s\s+", " ", text or "")
    c = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:], return_counts=True)


def trigram_number(term: str) -> int:
    a, b, c = map(ord, term)
    return a << 42 | b << 21 | c


def trigram_text(number: int) -> str:
    return "".join(chr(number >> k & 0x1FFFFF) for k in (42, 21, 0))


def trigram_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n) of a task's texts."""
    total, waiting, size = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], [], 0

    def merge() -> None:
        new = np.unique(np.concatenate(waiting), return_counts=True) if waiting else total[0]
        keys, at = np.unique(np.concatenate([total[0][0], new[0]]), return_inverse=True)
        if waiting:
            total[0] = keys, np.bincount(at, np.concatenate([total[0][1], new[1]]), len(keys)).astype(np.int64)
        waiting.clear()

    def out() -> pa.RecordBatch:
        keys, n = total[0]
        total[0] = keys[:0], n[:0]
        return pa.RecordBatch.from_arrays([pa.array(list(map(trigram_text, keys.tolist())), pa.string()), pa.array(n)], names=["term", "n"])

    for batch in batches:
        for t in batch.column("text"):
            waiting.append(trigrams(t.as_py())[0])
            size += len(waiting[-1])
            if size > 1 << 20:
                merge()
                size = 0
                if len(total[0][0]) > 500_000:
                    yield out()
    merge()
    yield out()


def term_frequencies(df: DataFrame, text: str, low: int, high: int, words: bool = False) -> DataFrame:
    """(term, n): in how many texts each term stands; each task adds up what it reads before anything is shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["term", "n"])

        for batch in batches:
            for t in batch.column("text").to_pylist():
                total.update(set(terms_in(t, low, high, words)))
                if len(total) > 500_000:
                    yield out()
                    total.clear()
        yield out()

    made = trigram_frequencies if (low, high, words) == (3, 3, False) else run
    return df.select(F.col(text).cast("string").alias("text")).mapInArrow(made, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def search(queries: DataFrame, corpus: DataFrame, key: str, text: str, k: int, low: int = 3, high: int = 3, least: float = 0.0, words: bool = False, min_df: int = 1, max_df: float = 1.0, max_features: int | None = None, corpus_key: str | None = None) -> DataFrame:
    """(query, match, sim, rank): the k nearest texts of the corpus to each query by cosine, ties by match; exact.

    At most QUERIES queries and a corpus of at most TERMS terms; more are an error here and go through `tfidf` and `top_k`.
    corpus_key: the corpus's key, if it is not `key`.
    """
    n = corpus.count()
    frequent = term_frequencies(corpus, text, low, high, words).where((F.col("n") >= min_df) & (F.col("n") <= max_df * n))
    frequent = frequent.orderBy(F.desc("n"), "term").limit(max_features) if max_features else frequent.limit(TERMS + 1)
    found = frequent.toArrow()
    asked = queries.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).limit(QUERIES + 1).collect()
    if found.num_rows > TERMS or len(asked) > QUERIES:
        raise TooMany(f"over {TERMS} terms or {QUERIES} queries: use tfidf and top_k")
    place = {t: i for i, t in enumerate(found["term"].to_pylist())}
    idf = np.array([math.log((1 + n) / (1 + d)) + 1 for d in found["n"].to_pylist()])

    def weights(t: str | None) -> dict[str, float]:
        w = {term: tf * idf[place[term]] for term, tf in terms_of(t, low, high, words).items() if term in place}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {term: x / norm for term, x in w.items()} if norm else {}

    wanted: dict[str, list[tuple[int, float]]] = {}
    for i, row in enumerate(asked):
        for term, x in weights(row.text).items():
            wanted.setdefault(term, []).append((i, x))
    # terms that no query has count for a text's length alone; those that some have come first, with a row for each in `table`
    order = sorted(place, key=lambda t: t not in wanted)
    idf = idf[[place[t] for t in order]]
    place = {t: i for i, t in enumerate(order)}
    dense = len(wanted) * len(asked) <= CELLS
    if dense:
        table = np.zeros((len(wanted), len(asked)))
        for term, rows in wanted.items():
            table[place[term], [i for i, _ in rows]] = [x for _, x in rows]
    else:
        table = [(np.array([i for i, _ in wanted[t]]), np.array([x for _, x in wanted[t]])) for t in order[: len(wanted)]]
    three = (low, high, words) == (3, 3, False)
    if three:
        numbers = np.array([trigram_number(t) for t in order], np.int64)
        sorted_ = np.argsort(numbers)
        place = numbers[sorted_], sorted_
    held = queries.sparkSession.sparkContext.broadcast((place, idf, table))
    narrow = corpus.select(F.col(corpus_key or key).alias("match"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([T.StructField("place", T.IntegerType()), narrow.schema["match"], T.StructField("sim", T.DoubleType())])
    n_asked, n_wanted = len(asked), len(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, idf, table = held.value
        best: dict[int, list[tuple[float, object]]] = {}
        # what a text must reach to be among a query's best, as far as is known
        bar = np.full(n_asked, least)

        def cut(rows: list) -> list:
            return sorted(rows, key=lambda r: (-r[0], r[1]))[:k]

        for batch in batches:
            for match, t in zip(batch.column("match").to_pylist(), batch.column("text").to_pylist()):
                if match is None:
                    continue
                if three:
                    term, tf = trigrams(t)
                    at = np.minimum(np.searchsorted(place[0], term), len(place[0]) - 1)
                    known = place[0][at] == term if len(place[0]) else np.zeros(len(term), bool)
                    at, tf = place[1][at[known]], tf[known]
                else:
                    rows = [(i, tf) for term, tf in Counter(terms_in(t, low, high, words)).items() if (i := place.get(term)) is not None]
                    at, tf = np.array(rows, np.int64).reshape(-1, 2).T
                x = tf * idf[at]
                has = at < n_wanted
                if not has.any():
                    continue
                if dense:
                    sims = x[has] @ table[at[has]]
                else:
                    sims = np.zeros(n_asked)
                    for i, y in zip(at[has], x[has]):
                        who, weight = table[i]
                        sims[who] += y * weight
                met = sims > 0
                sims = np.round(sims / math.sqrt(float(x @ x)), 6)
                for i in np.flatnonzero(met & (sims >= bar)).tolist():
                    rows = best.setdefault(i, [])
                    rows.append((float(sims[i]), match))
                    if len(rows) > 8 * k:
                        best[i] = cut(rows)
                        bar[i] = best[i][-1][0]
        rows = [(i, m, s) for i, r in best.items() for s, m in cut(r)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.int32(), batch.schema.field("match").type, pa.float64()))], names=schema.names)

    places = queries.sparkSession.createDataFrame([(i, r.key) for i, r in enumerate(asked)], T.StructType([T.StructField("place", T.IntegerType()), T.StructField("query", queries.schema[key].dataType)]))
    near = first_by(narrow.mapInArrow(run, schema), ["place"], [F.desc("sim"), F.asc("match")], k, "rank")
    return near.join(F.broadcast(places), "place").select("query", "match", "sim", "rank")


def nearest(queries: DataFrame, corpus: DataFrame, query_key: str, corpus_key: str, text: str, k: int, low: int = 3, high: int = 3, least: float = 0.0) -> DataFrame:
    """`search` where its bounds allow, else `top_k`: no posting is shuffled for a bounded set of queries."""
    try:
        return search(queries, corpus, query_key, text, k, low, high, least, corpus_key=corpus_key)
    except TooMany:
        w, idf = tfidf(corpus, corpus_key, text, low, high)
        return top_k(weighted(counts(queries, query_key, text, low, high), idf, query_key), w, query_key, corpus_key, k, least)


def rule_score(sim: Column, text: Column, mean: Column, std: Column) -> Column:
    """Similarity less penalties for repeated closing marks, unusual length and digits."""
    size = F.length(text_or_empty(text))
    digits = F.length(F.regexp_replace(text_or_empty(text), "[^0-9]", "")) / F.greatest(size, F.lit(1))
    return sim - 0.1 * punctuation_excess(text) - 0.05 * F.abs(size - mean) / F.when(std > 0, std).otherwise(F.lit(1.0)) - 0.2 * digits
