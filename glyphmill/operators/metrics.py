"""BLEU and chrF++ from sufficient statistics that sum over rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import scores
from glyphmill.functions.text import text_or_empty, tokens
from glyphmill.shared import write_shared

CHAR_ORDERS, WORD_ORDERS, BLEU_ORDERS = 6, 2, 4


def chr_words(c: Column) -> Column:
    """Words with one mark split off their end, else off their beginning, as chrF++ counts them."""
    mark = r"[!-/:-@\[-`{-~]"

    def cut(t: Column) -> Column:
        n = F.length(t)
        ends, begins = (n > 1) & t.rlike(mark + "$"), (n > 1) & t.rlike("^" + mark)
        return F.when(ends, F.array(F.substr(t, F.lit(1), n - 1), F.right(t, F.lit(1)))).when(begins, F.array(F.left(t, F.lit(1)), F.substr(t, F.lit(2)))).otherwise(F.array(t))

    return F.flatten(F.transform(F.filter(F.split(text_or_empty(c), r"\s+"), lambda t: t != ""), cut))


def tokens_13a(c: Column) -> Column:
    """BLEU's tokens: punctuation apart, but for separators inside numbers."""
    s = text_or_empty(c)
    s = F.regexp_replace(s, r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 ")
    s = F.regexp_replace(s, r"([^0-9])([\.,])", "$1 $2 ")
    s = F.regexp_replace(s, r"([\.,])([^0-9])", " $1 $2")
    s = F.regexp_replace(s, r"([0-9])(-)", "$1 $2 ")
    return F.filter(F.split(s, r"\s+"), lambda t: t != "")


def bare(c: Column) -> Column:
    """The text without white space: a string stands for its characters."""
    return F.regexp_replace(text_or_empty(c), r"\s+", "")


def summed_statistics(df: DataFrame, kinds: dict[str, tuple[Column, Column, int]]) -> DataFrame:
    """(kind, n, matches, n_hyp, n_ref): clipped n-gram matches summed over all rows, for each kind and order that occurs.

    kinds: name -> (items of the hypothesis, items of the reference, highest order); items are arrays, or strings for their
    characters. Each task counts the n-grams of a row, adds up what it reads, and passes on one row for each kind and order.
    """
    columns = [F.struct(h.alias("h"), r.alias("r")).alias(k) for k, (h, r, _) in kinds.items()]
    orders = {k: n for k, (_, _, n) in kinds.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {(k, n): (0, 0, 0) for k, top in orders.items() for n in range(1, top + 1)}
        for batch in batches:
            for k, top in orders.items():
                hyps, refs = (x.to_pylist() for x in batch.column(k).flatten())
                for n in range(1, top + 1):
                    found = [scores.overlap(scores.ngrams(h, n), scores.ngrams(r, n)) for h, r in zip(hyps, refs)]
                    total[k, n] = tuple(map(sum, zip(total[k, n], *found)))
        rows = [(*key, *sums) for key, sums in total.items() if sums[1] or sums[2]]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["kind", "n", "matches", "n_hyp", "n_ref"])

    each = df.select(*columns).mapInArrow(run, "kind string, n int, matches long, n_hyp long, n_ref long")
    return each.groupBy("kind", "n").agg(*[F.sum(c).alias(c) for c in ("matches", "n_hyp", "n_ref")])


def chrf_kinds(hyp: str, ref: str) -> dict[str, tuple[Column, Column, int]]:
    return {"char": (bare(F.col(hyp)), bare(F.col(ref)), CHAR_ORDERS), "word": (chr_words(F.col(hyp)), chr_words(F.col(ref)), WORD_ORDERS)}


def bleu_kinds(hyp: str, ref: str, tokenize: str = "13a") -> dict[str, tuple[Column, Column, int]]:
    """Tokenize is 13a, or none for parts between blanks."""
    cut = tokens_13a if tokenize == "13a" else tokens
    return {"bleu": (cut(F.col(hyp)), cut(F.col(ref)), BLEU_ORDERS)}


def chrf(stats: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """chrF++ (beta 2) of summed statistics: mean precision and recall over the orders that occur on both sides, then their F."""
    summed = stats.where(F.col("kind").isin("char", "word")).groupBy(*(keys or []), "kind", "n").agg(*[F.sum(c).alias(c) for c in ("matches", "n_hyp", "n_ref")])
    has = (F.col("n_hyp") > 0) & (F.col("n_ref") > 0)
    mean = lambda c: F.coalesce(F.avg(F.when(has, F.col("matches") / F.col(c))), F.lit(0.0))
    both = summed.groupBy(*(keys or [])).agg(mean("n_hyp").alias("p"), mean("n_ref").alias("r"))
    p, r = F.col("p"), F.col("r")
    return both.select(*(keys or []), F.when(p + r > 0, 500 * p * r / (4 * p + r)).otherwise(F.lit(0.0)).alias("chrf"))


def bleu(stats: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """BLEU of summed statistics, zero matches smoothed by halving; 0 without any match."""
    by_n = stats.where("kind = 'bleu'").groupBy(*(keys or []), "n").agg(*[F.sum(c).alias(c) for c in ("matches", "n_hyp", "n_ref")])
    orders = by_n.groupBy(*(keys or [])).agg(F.sort_array(F.collect_list(F.struct("n", "matches", "n_hyp", "n_ref"))).alias("o"))
    first = F.element_at("o", 1)
    # zeros: how many orders up to this one had no match; the k-th counts 1 / 2**k
    folded = F.aggregate(
        "o",
        F.struct(F.lit(0.0).alias("log"), F.lit(0).alias("zeros")),
        lambda a, x: F.struct(
            (a["log"] + F.log(F.when(x["matches"] > 0, x["matches"].cast("double")).otherwise(F.lit(1.0) / F.pow(F.lit(2.0), a["zeros"] + 1)) / x["n_hyp"])).alias("log"),
            (a["zeros"] + F.when(x["matches"] > 0, 0).otherwise(1)).alias("zeros"),
        ),
    )
    penalty = F.when(first["n_hyp"] < first["n_ref"], F.exp(1 - first["n_ref"] / first["n_hyp"])).otherwise(F.lit(1.0))
    none = (F.size(F.filter("o", lambda x: x["n_hyp"] > 0)) < BLEU_ORDERS) | ~F.exists("o", lambda x: x["matches"] > 0)
    score = F.when(none, F.lit(0.0)).otherwise(100 * penalty * F.exp(folded["log"] / BLEU_ORDERS))
    return orders.select(*(keys or []), score.alias("bleu"))


def corpus_scores(pairs: DataFrame, hyp: str, ref: str, tokenize: str = "13a") -> DataFrame:
    """(bleu, chrf, gm) of all pairs in one row; all null where no reference has any text."""
    s = write_shared(summed_statistics(pairs, chrf_kinds(hyp, ref) | bleu_kinds(hyp, ref, tokenize)), "scores")
    known = pairs.agg(F.coalesce(F.max(F.trim(text_or_empty(F.col(ref))) != ""), F.lit(False)).alias("known"))
    both = chrf(s).crossJoin(bleu(s)).crossJoin(known)
    only = lambda c: F.when(F.col("known"), c)
    return both.select(only(F.col("bleu")).alias("bleu"), only(F.col("chrf")).alias("chrf"), only(F.sqrt(F.col("bleu") * F.col("chrf"))).alias("gm"))
