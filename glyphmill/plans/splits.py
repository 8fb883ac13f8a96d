"""Queries for folds, holdouts, mixes, selections under caps, and checks of what is handed in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.operators import mixing
from glyphmill.operators.ordering import hash_order, numbered, placed
from glyphmill.plans.common import r6, read

FOLDS, SEED = 5, 42


def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = read(spark, sf_dir, "documents").select("doc_id").distinct().withColumn("h", hash_order(F.col("doc_id"), SEED))
    rows, _ = numbered(ids, ["h", "doc_id"])
    return rows.select("doc_id", (F.col("row_number") % FOLDS).alias("fold"))


def fold_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ids in hash order, dealt to folds in turn."""
    return folds(spark, sf_dir)


def ablation_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each language in the training and validation part of each fold."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang").join(folds(spark, sf_dir), "doc_id")
    counted = docs.groupBy("lang", "fold").agg(F.count("*").alias("n"))
    grid = counted.withColumnRenamed("fold", "of").crossJoin(F.broadcast(spark.range(FOLDS).withColumnRenamed("id", "fold")))
    split = F.when(F.col("of") == F.col("fold"), "val").otherwise("train")
    return grid.groupBy("lang", "fold", split.alias("split")).agg(F.sum("n").alias("n"))


def doc_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """whole sources held out, a fifth of them and one at least; rows of each side."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source")
    sources = docs.select("source").distinct().withColumn("h", hash_order(F.col("source"), SEED))
    rows, n = numbered(sources, ["h", "source"])
    held = rows.where(F.col("row_number") < max(1, int(n * 0.2))).select("source", F.lit("val").alias("split"))
    return docs.join(held, "source", "left").select("doc_id", "source", F.coalesce("split", F.lit("train")).alias("split"))


def quality_select_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O10 with one cap, V1, V2: half the labelled documents of each quality, the longest first, 8 of a source."""
    docs = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source", "quality", "n_chars")
    return mixing.select_capped(docs, "quality", "source", [F.desc("n_chars"), F.asc("doc_id")], 8, 0.5)


def quality_select_two_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O10 with two caps that interact: by source and by language."""
    docs = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source", "lang", "quality", (-F.col("n_chars")).alias("score"))
    return mixing.select_greedy(docs, "quality", ["score", "doc_id"], {"source": 8, "lang": 60}, 0.4)


def mix_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of each source in hash order, with the benchmark's items."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", hash_order(F.col("doc_id"), SEED).alias("h"))
    sizes = docs.groupBy("source").agg(mixing.target(F.count("*"), 0.1).alias("n"))
    ranked = placed(docs, "source", ["h", "doc_id"]).join(sizes, "source").where("place <= n")
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.lit("benchmark").alias("source"))
    return ranked.select(F.col("doc_id").alias("id"), "source").unionByName(items)


def submission_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels held against documents: missing, extra and repeated ids, empty and broken texts."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").select("doc_id")
    n = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
    parts = [
        n(docs.join(labels, "doc_id", "left_anti"), "missing"),
        n(labels.join(docs.select("doc_id"), "doc_id", "left_anti"), "extra"),
        n(labels.groupBy("doc_id").count().where("count > 1"), "duplicate"),
        n(docs.where("trim(coalesce(text, '')) = ''"), "empty"),
        n(docs.where(F.col("text").contains("\n")), "newline"),
        n(docs.where(F.regexp_count("text", F.lit(r"[.!?]\s")) > 0), "multi_sentence"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def quality_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of labels by source and language."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(read(spark, sf_dir, "labels"), "doc_id")
    return docs.groupBy("source", "lang").agg(F.count("*").alias("n"), r6(F.avg(F.col("quality").cast("double"))).alias("quality"), r6(F.avg(F.col("toxic").cast("double"))).alias("toxic"))


QUERIES = {f.__name__: f for f in (fold_assignment, ablation_join, doc_holdout, quality_select_caps, quality_select_two_caps, mix_sample, submission_validation, quality_by_source)}

_HASH = lambda c: f"md5(cast({c} as varchar) || '|{SEED}')"
_FOLDS = f"folds as (select doc_id, (row_number() over (order by {_HASH('doc_id')}, doc_id) - 1) % {FOLDS} as fold from (select distinct doc_id from documents))"
_EVEN = lambda n, r: f"cast(round_even({n} * {r}, 0) as bigint)"

ORACLE_SQL = {
    "fold_assignment": f"with {_FOLDS} select doc_id, fold from folds",
    "ablation_join": f"with {_FOLDS}, c as (select lang, fold as o, count(*) as n from documents join folds using (doc_id) group by all), g as (select lang, f.fold, case when o = f.fold then 'val' else 'train' end as split, n from c, (select unnest(range({FOLDS})) as fold) f) select lang, fold, split, cast(sum(n) as bigint) as n from g group by all",
    "doc_holdout": f"with s as (select source, row_number() over (order by {_HASH('source')}, source) - 1 as k, count(*) over () as n from (select distinct source from documents)) select doc_id, source, case when k < greatest(1, cast(floor(n * 0.2) as int)) then 'val' else 'train' end as split from documents join s using (source)",
    "quality_select_caps": f"with d as (select doc_id, source, quality, n_chars from documents join labels using (doc_id)), r as (select *, row_number() over (partition by quality, source order by n_chars desc, doc_id) as g from d), p as (select *, row_number() over (partition by quality order by cast(g > 8 as int), n_chars desc, doc_id) as place, count(*) over (partition by quality) as n from r) select doc_id, source, quality, n_chars from p where place <= {_EVEN('n', 0.5)}",
    "mix_sample": f"with d as (select doc_id, source, row_number() over (partition by source order by {_HASH('doc_id')}, doc_id) as place, count(*) over (partition by source) as n from documents) select doc_id as id, source from d where place <= {_EVEN('n', 0.1)} union all select item_id, 'benchmark' from benchmark",
    "submission_validation": "select 'missing' as \"check\", count(*) as n from documents anti join labels using (doc_id) union all select 'extra', count(*) from labels anti join documents using (doc_id) union all select 'duplicate', count(*) from (select doc_id from labels group by doc_id having count(*) > 1) union all select 'empty', count(*) from documents where trim(coalesce(text, '')) = '' union all select 'newline', count(*) from documents where contains(text, chr(10)) union all select 'multi_sentence', count(*) from documents where regexp_matches(text, '[.!?]\\s')",
    "quality_by_source": "select source, lang, count(*) as n, round(avg(quality), 6) as quality, round(avg(toxic), 6) as toxic from documents join labels using (doc_id) group by all",
}
