"""Profiles, warnings, job lists and samples."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions import ocr, udfs
from glyphmill.functions import text as X
from glyphmill.functions.profile import profile
from glyphmill.operators import gates
from glyphmill.operators.ordering import first_by, hash_order
from glyphmill.operators.pages import LANGUAGE_NAMES


def text_profile(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """Rows, shares of empty, control-marked and repetitive texts, distinct share, quantiles of lengths and tokens."""
    t = X.tokens(F.col(text))
    d = df.select(*keys, F.col(text).alias("t"), profile(F.col(text), words=False).alias("p"), (F.size(F.array_distinct(t)) / F.greatest(F.size(t), F.lit(1))).alias("own"))
    q = lambda c, at: F.percentile(c, F.lit(at))
    return d.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.avg((F.trim(X.text_or_empty(F.col("t"))) == "").cast("double")).alias("empty_rate"), F.avg((F.col("p.n_control") > 0).cast("double")).alias("control_rate"), F.avg(((F.col("own") < 0.5) & (F.col("p.tokens") > 0)).cast("double")).alias("low_unique_rate"),
        (F.count_distinct("t") / F.greatest(F.count("*"), F.lit(1))).alias("unique_ratio"), F.avg("p.len").alias("mean_len"), *[q("p.len", at).alias(f"len_p{round(at * 100)}") for at in (0.5, 0.9, 0.95, 0.99)], *[q("p.tokens", at).alias(f"tokens_p{round(at * 100)}") for at in (0.5, 0.9)],
    )


#: Q18: what is counted before and after normalisation.
MARKS = {
    "gap": "<gap>", "big_gap": "<big_gap>", "bare_gap": r"(?<![<_\w])(?:big_)?gap(?![>\w])", "ascii": r"(?i)sz|[st],|h|(?<=[aeiu])[23]", "line_number": r"(?<!\w)\d+'+(?!\w)", "dot": r"\S\.\S", "missing": r"\[[xX.\s?…]+\]|…|(?i:(?<![A-Z0-9])x{2,}(?![A-Z0-9]))",
    "big_missing": r"…|\.{3,}|(?i:(?<![A-Z0-9])x{4,}(?![A-Z0-9]))",
}


def normalisation_warnings(df: DataFrame, raw: str, normal: str, variant: str) -> DataFrame:
    """Q18: (warning) for what normalisation lost or left over in a whole table of texts before and after it."""
    each = {}
    for side, c in (("raw", raw), ("norm", normal)):
        s = X.text_or_empty(F.col(c))
        each |= {f"{side}_{k}": F.sum(F.regexp_count(s, F.lit(p))) for k, p in MARKS.items()}
        each |= {f"{side}_caps": F.sum(gates.all_caps_tokens(F.col(c))), f"{side}_title": F.sum(gates.title_tokens(F.col(c))), f"{side}_angles": F.sum(gates.unexpected_angles(F.col(c)))}
    t = df.agg(*[F.coalesce(v, F.lit(0)).alias(k) for k, v in each.items()])
    n = F.col
    lost = lambda k: (n(f"raw_{k}") > 0) & (n(f"norm_{k}") == 0)
    checks = [
        ("gaps are not marked", (n("raw_missing") + n("raw_big_missing") > 0) & (n("norm_gap") + n("norm_big_gap") == 0) & F.lit(variant in "BC")), ("long gaps are not marked", (n("raw_big_missing") > 0) & (n("norm_big_gap") == 0) & F.lit(variant in "BC")),
        ("ASCII conventions are left", (n("raw_ascii") > 0) & (n("norm_ascii") > 0)), ("gaps without brackets", n("norm_bare_gap") > 0), ("line numbers are left", (n("raw_line_number") > 0) & (n("norm_line_number") > 0)), ("dotted tokens are lost", lost("dot")), ("capitals are lost", lost("caps")), ("titles are lost", lost("title")), ("angle brackets are left", n("norm_angles") > 0),
    ]
    return t.select(F.explode(X.flags(*checks)).alias("warning"))


@F.pandas_udf(udfs.STRING)
def block_hash(texts: pd.Series) -> pd.Series:
    """B16."""
    return texts.map(ocr.block_hash, na_action=None)


def translation_prompt(lang_name: Column, text: Column) -> Column:
    """Z33."""
    return F.concat(F.lit("Put this passage from "), lang_name, F.lit(" into English; keep names, numbers and marks; add nothing.\n\n"), text, F.lit("\n\nEnglish:"))


def translation_jobs(blocks: DataFrame, langs: list[str] | None = None, source: str = "pdf_name", page: str = "page") -> DataFrame:
    """A job for each different block of another language than English, with what was seen first of it.

    blocks: classified ones with source, page, nth, block, candidate_reason and metadata_top_score. Priority is the score and
    0.15 of the metadata score, the greatest of all places; reasons stand in the order in which they are met.
    """
    wanted = blocks.where((F.col("role") == "translation") & (F.col("lang") != "en")).withColumn("block_hash", block_hash("block"))
    wanted = wanted.where(F.col("lang").isin(langs)) if langs else wanted
    place = F.struct(source, page, "nth")
    priority = F.col("translation_score") + 0.15 * F.col("metadata_top_score")
    by_reason = wanted.groupBy("block_hash", F.col("candidate_reason").alias("reason")).agg(F.min(place).alias("at"))
    reasons = by_reason.where("reason <> ''").groupBy("block_hash").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "reason"))), lambda x: x["reason"]), "|").alias("candidate_reasons"))
    jobs = wanted.groupBy("block_hash").agg(F.count("*").alias("occurrences"), F.max("metadata_top_score").alias("metadata_top_score_max"), F.round(F.max(priority), 6).alias("priority_score"), F.min_by(F.struct("lang", F.col("block").alias("text"), source, page, "nth"), place).alias("first"))
    names = F.create_map(*[F.lit(x) for kv in LANGUAGE_NAMES.items() for x in kv])
    jobs = jobs.join(reasons, "block_hash", "left").select("block_hash", "first.*", "occurrences", "metadata_top_score_max", "priority_score", F.coalesce("candidate_reasons", F.lit("")).alias("candidate_reasons"), F.lit("").alias("translation_en"))
    jobs = jobs.withColumn("lang_name", F.coalesce(F.element_at(names, F.col("lang")), F.lit("Unknown")))
    return jobs.withColumn("translation_prompt", translation_prompt(F.col("lang_name"), F.col("text")))


def open_jobs(jobs: DataFrame, langs: list[str], only_empty: bool = True, each: int | None = None, order: str = "block_hash") -> DataFrame:
    """Y2: jobs of supported languages, without a translation, the first of each language."""
    kept = jobs.where(F.col("lang").isin(langs))
    kept = kept.where(gates.blank(F.col("translation_en"))) if only_empty else kept
    return first_by(kept, ["lang"], [F.asc(order)], each) if each else kept


def job_result(said: Column, error: Column, model: str) -> Column:
    """(translation_en, translation_model, translation_error): what a model said, its 'English:' and blanks aside; why not, if it said nothing."""
    text = X.clean(F.regexp_replace(X.text_or_empty(said), r"(?i)^\s*english\s*:\s*", ""))
    failed = F.coalesce(error, F.when(text == "", "empty output"))
    return F.struct(F.when(failed.isNull(), text).otherwise("").alias("translation_en"), F.when(failed.isNull(), model).otherwise("").alias("translation_model"), F.coalesce(failed, F.lit("")).alias("translation_error"))


def job_report(jobs: DataFrame, order: str = "block_hash") -> DataFrame:
    """(lang, n_translated, n_failed, samples) with the first three translations of each language."""
    done = ~gates.blank(F.col("translation_en"))
    counts = jobs.groupBy("lang").agg(F.count_if(done).alias("n_translated"), F.count_if(F.col("translation_error") != "").alias("n_failed"))
    shown = first_by(jobs.where(done), ["lang"], [F.asc(order)], 3, "_nth").groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("_nth", "translation_en"))), lambda x: x["translation_en"]).alias("samples"))
    return counts.join(shown, "lang", "left")


def templates(df: DataFrame, text: str, top: int = 50) -> DataFrame:
    """Df with template_count and template_rank of its texts in lower case with white space collapsed; 0 beyond the `top` ranks."""
    d = df.withColumn("_t", F.lower(X.clean(F.col(text))))
    counts = d.groupBy("_t").agg(F.count("*").alias("template_count"))
    # a ranking of `top` rows
    best = counts.orderBy(F.desc("template_count"), "_t").limit(top)
    ranked = best.withColumn("template_rank", F.row_number().over(Window.orderBy(F.desc("template_count"), "_t"))).select("_t", "template_rank")
    return d.join(counts, "_t").join(F.broadcast(ranked), "_t", "left").withColumn("template_rank", F.coalesce("template_rank", F.lit(0))).drop("_t")


def outliers(rows: DataFrame, gate: gates.AlignedGate, doc: str, top: int) -> DataFrame:
    """(doc, outlier): the `top` documents whose length ratios leave the gate's limits farthest."""
    ratio = F.round("len_ratio", 6)
    scored = rows.groupBy(doc).agg(gates.outlier(F.min(ratio), F.max(ratio), gate).alias("outlier"))
    return scored.where("outlier > 0").orderBy(F.desc("outlier"), doc).limit(top)


def examples(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """N rows in hash order of their key, the same in every run."""
    return df.orderBy(hash_order(F.col(key), seed), key).limit(n)


def flagged_only(df: DataFrame, flagged: bool = True) -> DataFrame:
    """Rows with flags, or those without."""
    return df.where(~gates.blank(F.col("flags")) if flagged else gates.blank(F.col("flags")))


def marked(df: DataFrame, column: str = "has_akkadian") -> DataFrame:
    """P5: rows whose mark is true, whatever way it is written."""
    return df.where(F.lower(F.trim(F.col(column).cast("string"))).isin("1", "true", "t", "yes", "y"))


def position(df: DataFrame, doc: str, *order: str) -> DataFrame:
    """Df with doc_pos, the place of each row in its document from 0."""
    return df.withColumn("doc_pos", F.row_number().over(Window.partitionBy(doc).orderBy(*order)) - 1)


def page_counters(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """Sums of what the cleaners of both kinds of page counted, one row for each counter."""
    @F.pandas_udf("map<string,long>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([dict(ocr.translation_page(t)[1] + ocr.transliteration_page(t)[1]) for t in texts])

    rows = df.select(*keys, F.explode(run(F.col(text))).alias("counter", "n"))
    return rows.groupBy(*keys, "counter").agg(F.sum("n").alias("n"))
