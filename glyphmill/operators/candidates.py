"""Pools of candidate translations: made from retrieved pairs, pruned, reranked and scored.

A pool has id, translation and what else is known of each row; `row` orders the rows of an id. Everything is windows and
joins on id, so pools of any number of ids are spread; the candidates of one id are few by their nature.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions import scores, sentences
from glyphmill.functions import text as X
from glyphmill.functions.normalize import clean, output
from glyphmill.functions.types import KINDS, record
from glyphmill.operators import retrieval
from glyphmill.operators.ordering import first_by
from glyphmill.operators.slots import Slots, filled, slot_counts, slotted, slotted_target


def postprocessed(text: str | None, mode: str | None = "merge", output_form: bool = False) -> str:
    """T31."""
    s = output(text) if output_form else clean(text)
    return sentences.single(s, mode) if mode else s


# ---- from a memory of pairs ----


def slotted_texts(df: DataFrame, text: str, s: Slots = Slots()) -> DataFrame:
    """Df with slot_text and slot_map of a column."""
    @F.pandas_udf("slot_text string, slot_map map<string,string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([slotted(t, s) for t in texts], columns=["slot_text", "slot_map"])

    return df.withColumn("_s", run(F.col(text))).select("*", "_s.*").drop("_s")


def memory_candidates(queries: DataFrame, memory: DataFrame, top: int = 5, least: float = 0.0, s: Slots = Slots(), exclude_same: bool = True, tag: str = "tm", mode: str | None = "merge") -> DataFrame:
    """(id, translation, tag, run, rank, tm_sim, slot_match_num, slot_match_pn, slot_match_unit).

    queries: (id, src); memory: (row, src, tgt). The nearest sources by TF-IDF over slotted texts; their targets with the
    query's names, numbers and units in place of their own. Those with the query's own slotted source are left out,
    then empty and repeated translations; ranks count what remains.
    """
    q, m = slotted_texts(queries, "src", s), slotted_texts(memory, "src", s)
    near = retrieval.nearest(q, m, "id", "row", "slot_text", top, 3, 3, least)
    side = lambda df, key, mark: df.select(F.col(key).alias(mark), F.col("slot_text").alias(f"{mark}_slots"), F.col("slot_map").alias(f"{mark}_map"))
    met = near.join(side(q, "id", "query"), "query").join(side(m, "row", "match"), "match").join(memory.select(F.col("row").alias("match"), "tgt"), "match")
    met = met.where(F.col("query_slots") != F.col("match_slots")) if exclude_same else met

    @F.pandas_udf("string")
    def said(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([postprocessed(filled(slotted_target(r.tgt, dict(r.match_map), s), dict(r.query_map), dict(r.match_map)), mode) for r in rows.itertuples(index=False)])

    @F.pandas_udf("pn long, num long, unit long")
    def counted(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([slot_counts(t) for t in texts], columns=["pn", "num", "unit"])

    met = met.withColumns({"translation": said(F.struct("tgt", "match_map", "query_map")), "a": counted("query_slots"), "b": counted("match_slots")}).where("translation <> ''")
    once = first_by(met, ["query", "translation"], [F.asc("rank")])
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("rank")))
    shared = [F.least(F.col("a")[k], F.col("b")[k]).alias(f"slot_match_{k}") for k in ("num", "pn", "unit")]
    return ranked.select(F.col("query").alias("id"), "translation", F.lit(tag).alias("tag"), F.lit(1).alias("run"), "rank", F.col("sim").alias("tm_sim"), *shared)


def pseudo_labels(untranslated: DataFrame, memory: DataFrame, least: float = 0.3) -> DataFrame:
    """(id, translation, confidence): the target of the nearest source, for texts without a translation; confidence is the similarity, 0 at least."""
    near = retrieval.nearest(untranslated, memory, "id", "row", "src", 1, 3, 5)
    found = near.join(memory.select(F.col("row").alias("match"), "tgt"), "match")
    return found.select(F.col("query").alias("id"), F.col("tgt").alias("translation"), F.greatest(F.col("sim"), F.lit(0.0)).alias("confidence")).where(F.col("confidence") >= least)


def editor_prompt(src: Column, tm_src: Column, tm_tgt: Column) -> Column:
    """R10."""
    return F.trim(F.concat(F.lit("<SRC> "), src, F.lit(" <TM_SRC> "), tm_src, F.lit(" <TM_TGT> "), tm_tgt))


def baseline(df: DataFrame, constant: str | None = None, src: str = "transliteration") -> DataFrame:
    """(id, translation): a constant, else the first sentence of the source."""
    from glyphmill.functions import udfs

    return df.select("id", (F.lit(constant) if constant is not None else udfs.apply("first_sentence", F.col(src))).alias("translation"))


# ---- pools ----


def distinct_candidates(pool: DataFrame) -> DataFrame:
    """The first row of each id and translation."""
    return first_by(pool, ["id", "translation"], [F.asc("row")])


def pooled(pool: DataFrame) -> DataFrame:
    """(id, translation, mass): how often each translation of an id was made."""
    return pool.groupBy("id", "translation").agg(F.count("*").alias("mass"))


def pruned(pool: DataFrame, most: int, by_score: str | None = None) -> DataFrame:
    """The first rows of each id, or those with the best score."""
    return first_by(pool, ["id"], [F.desc_nulls_last(by_score), F.asc("row")] if by_score else [F.asc("row")], most)


def tag_first(pool: DataFrame) -> DataFrame:
    """(tag, id, translation): each tag's rows of rank 1, the first of an id; the first rows of its ids where it has none."""
    ranked = pool.withColumn("_one", F.max((F.col("rank").cast("string") == "1").cast("int")).over(Window.partitionBy("tag")))
    kept = ranked.where((F.col("_one") == 0) | (F.col("rank").cast("string") == "1"))
    return first_by(kept, ["tag", "id"], [F.asc("row")]).select("tag", "id", "translation")


def pool_statistics(pool: DataFrame) -> DataFrame:
    """One row on the numbers of candidates of ids."""
    n = pool.groupBy("id").agg(F.count("*").alias("n"))
    return n.agg(F.sum("n").alias("rows"), F.count("*").alias("ids"), F.avg("n").alias("mean"), F.percentile("n", F.lit(0.5)).alias("p50"), F.percentile("n", F.lit(0.9)).alias("p90"), F.min("n").alias("least"), F.max("n").alias("most"))


def noisy_channel(pool: DataFrame, weights: list[float], forward: str = "fwd", reverse: str = "rev") -> DataFrame:
    """(weight, id, translation, total): for each weight an id's best reverse score plus weight times forward score.

    A forward score that is null or no number counts as the least there is; ties go to the first row.
    """
    f = F.when(F.col(forward).isNull() | F.isnan(forward), F.lit(float("-inf"))).otherwise(F.col(forward))
    each = pool.withColumn("weight", F.explode(F.array(*[F.lit(float(w)) for w in weights])))
    each = each.withColumn("total", F.col(reverse) + F.when(F.col("weight") == 0, F.lit(0.0)).otherwise(F.col("weight") * f))
    return first_by(each, ["weight", "id"], [F.desc("total"), F.asc("row")]).select("weight", "id", "translation", "total")


@F.pandas_udf(record("bleu double, chrf double, gm double"))
def sentence_scores(rows: pd.DataFrame) -> pd.DataFrame:
    """E2 of (hypothesis, reference)."""
    return pd.DataFrame([scores.geometric(h, r) for h, r in rows.itertuples(index=False)], columns=["bleu", "chrf", "gm"])


def oracle_choice(pool: DataFrame, gold: DataFrame) -> DataFrame:
    """(id, translation, gold, bleu, chrf, gm): each gold id's candidate of greatest gm; empty where it has none."""
    known = gold.select("id", F.col("translation").alias("gold"))
    met = distinct_candidates(pool.join(known, "id", "leftsemi")).join(known, "id")
    scored = met.withColumn("s", sentence_scores(F.struct("translation", "gold"))).select("id", "translation", "row", "s.*")
    best = first_by(scored, ["id"], [F.desc("gm"), F.asc("row")]).drop("row")
    return known.join(best, "id", "left").select("id", F.coalesce("translation", F.lit("")).alias("translation"), "gold", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("bleu", "chrf", "gm")])


def id_seed(c: Column, seed: int) -> Column:
    """A seed for each id, the same in every run."""
    return F.lit(seed) + F.pmod(F.crc32(c.cast("binary")), F.lit(1_000_003))


@F.pandas_udf(KINDS["double"])
def chrf_utility(rows: pd.DataFrame) -> pd.Series:
    return pd.Series([scores.chrf(h, r) for h, r in rows.itertuples(index=False)], dtype=float)


def mbr_choice(pool: DataFrame, weight: Column | None = None, exact: int = 64, sampled: int = 32, seed: int = 42) -> DataFrame:
    """(id, translation, utility): the candidate of greatest mean chrF++ against the candidates of its id, by their weights.

    Weights are how often a translation was made, or sums of `weight`. More than `exact` different candidates are held
    against `sampled` of them, drawn by weight without repeats (the least of log(u) / -weight by hashed u). Every candidate
    is rated either way. Ties go to the greater weight, then the shorter text, then the lesser.
    """
    mass = pool.groupBy("id", "translation").agg((F.count("*") if weight is None else F.sum(weight)).cast("double").alias("mass"))
    sized = mass.withColumn("n", F.count("*").over(Window.partitionBy("id")))
    u = (F.pmod(F.xxhash64("id", "translation", id_seed(F.col("id").cast("string"), seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    drawn = sized.withColumn("turn", F.row_number().over(Window.partitionBy("id").orderBy(-F.log(u) / F.col("mass"), "translation")))
    refs = drawn.where((F.col("n") <= exact) | (F.col("turn") <= sampled)).select("id", F.col("translation").alias("ref"), F.col("mass").alias("w"))
    rated = mass.join(refs, "id").withColumn("utility", chrf_utility(F.struct("translation", "ref")))
    mean = rated.groupBy("id", "translation", "mass").agg(F.round(F.sum(F.col("w") * F.col("utility")) / F.sum("w"), 9).alias("utility"))
    alone = F.count("*").over(Window.partitionBy("id")) == 1
    best = first_by(mean.withColumn("utility", F.when(alone, F.lit(0.0)).otherwise(F.col("utility"))), ["id"], [F.desc("utility"), F.desc("mass"), F.length("translation").asc(), F.asc("translation")])
    return best.select("id", "translation", "utility")


def restored_side_by_side(df: DataFrame, hyp: str, ref: str, mapping: str) -> DataFrame:
    """E5: df with hypothesis and reference as they are and with their placeholders filled from a JSON mapping."""
    from glyphmill.operators.slots import loaded, restored

    @F.pandas_udf("string")
    def run(texts: pd.Series, maps: pd.Series) -> pd.Series:
        return pd.Series([restored(t, loaded(m), longest_first=True) for t, m in zip(texts, maps)])

    return df.withColumns({f"{c}_restored": run(F.col(c), F.col(mapping)) for c in (hyp, ref)})
