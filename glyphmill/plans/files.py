"""Queries through files: tables written and read again in each format, splits, submissions, parts, and a stream."""

from __future__ import annotations

import io
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import text as X
from glyphmill.operators.ordering import first_by, hash_order
from glyphmill.operators.ordering import numbered
from glyphmill.plans.common import read, sql_clean
from glyphmill.plans.dialogue import SQL_PAIRS, pairs
from glyphmill.shared import _write_bytes, shared_path
from glyphmill.sources import tables
from glyphmill.streaming import parts

VARIANTS, FOLDS, SEED = ["A", "B", "C"], 3, 42


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as CSV, quotes and line ends and all, and read again as text."""
    # no text holds them; Spark's reader loses zero characters inside quotes, and can't tell nulls from empty texts
    null, zero = (f"{k}-{uuid.uuid4().hex}" for k in ("null", "zero"))
    swapped = lambda c, old, new: F.replace(F.col(c), F.lit(old), F.lit(new)).alias(c)
    docs = read(spark, sf_dir, "documents").withColumn("text", F.regexp_replace("text", "\r\n?", "\n"))
    docs = docs.select("doc_id", *[swapped(c, "\0", zero) for c in ("lang", "source", "text")])
    path = tables.write_table(docs, shared_path(spark, "documents") + ".csv", null=null)
    back = tables.read_table(spark, path, "documents", types=False, columns=tables.columns_of(spark, path), null=null)
    back = back.select("doc_id", *[swapped(c, zero, "\0") for c in ("lang", "source", "text")])
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", F.md5("text").alias("text_md5"))


def zip_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: a CSV file inside a ZIP archive, read by its columns."""
    rows = read(spark, sf_dir, "nation").orderBy("n_nationkey").toPandas()
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("__MACOSX/nation.csv", "nothing")
        z.writestr("nation.csv", rows.to_csv(index=False))
    path = shared_path(spark, "nation") + ".zip"
    _write_bytes(spark, path, packed.getvalue())
    return tables.read_table(spark, path, "nation", columns=["n_nationkey", "n_name"]).select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as numbered parts, one of them twice without effect, and counted by part."""
    folder, customers = shared_path(spark, "parts"), read(spark, sf_dir, "customer")
    for k in (0, 1, 2, 1):
        tables.write_part(customers.where(F.col("c_custkey") % 3 == k), f"{folder}", k)
    back = spark.read.option("recursiveFileLookup", True).parquet(folder)
    number = F.regexp_extract("_metadata.file_path", r"part-(\d+)\.parquet/", 1).cast("long")
    return back.select(number.alias("part"), "c_custkey").groupBy("part").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("total"))


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs as three variants, as an aligned table has them."""
    p = pairs(spark, sf_dir).select(F.col("conv_id").alias("oare_id"), "turn", X.clean(F.col("src")).alias("src_sent"), X.clean(F.col("tgt")).alias("tgt_sent"))
    return p.withColumn("src_norm_variant", F.explode(F.array(*[F.lit(v) for v in VARIANTS])))


def folds(rows: DataFrame) -> DataFrame:
    """(oare_id, fold): documents dealt to folds in hash order."""
    ids = rows.select("oare_id").distinct().withColumn("h", hash_order(F.col("oare_id"), SEED))
    return numbered(ids, ["h"], "k")[0].select("oare_id", (F.col("k") % FOLDS).cast("int").alias("fold"))


def split_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits by variant and fold written as partitions, counted again from their files; one extra row goes to train."""
    rows = aligned(spark, sf_dir)
    extra = rows.limit(0).unionByName(spark.range(1).selectExpr("-1L as oare_id", "0 as turn", "'extra' as src_sent", "'row' as tgt_sent", "'' as src_norm_variant"), allowMissingColumns=True)
    path = shared_path(spark, "splits")
    tables.write_splits(tables.splits(rows, folds(rows), VARIANTS, extra), path)
    back = spark.read.parquet(path)
    return back.groupBy("variant", F.col("fold").cast("int").alias("fold")).agg(F.count_if(F.col("split") == "train").alias("train_rows"), F.count_if(F.col("split") == "val").alias("val_rows"), F.count_distinct(F.when(F.col("split") == "val", F.col("oare_id"))).alias("val_docs"))


def submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translations alone in order take the ids of the items; a file with ids is made, read and realigned with items it lacks."""
    items = read(spark, sf_dir, "benchmark").orderBy("item_id").coalesce(1)
    alone = tables.write_table(items.select(X.clean(F.col("text")).alias("translation")), shared_path(spark, "predictions") + ".csv")
    known = tables.read_predictions(spark, alone, read(spark, sf_dir, "benchmark").orderBy("item_id").coalesce(1), "item_id")
    sent = tables.write_submission(known.where(F.col("id") % 4 != 0), shared_path(spark, "submission"), single=None)
    wanted = read(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"))
    return tables.realigned(sent, wanted).select(F.col("id").cast("long").alias("id"), "translation")


def stream_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D6, L10 over files that arrive: distinct pairs of customers' nation and segment, by a stream that ends with the files there are."""
    folder = shared_path(spark, "arriving")
    read(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("src"), F.col("c_mktsegment").alias("tgt")).repartition(6).write.parquet(folder)
    found = parts.distinct_pairs(spark, folder, "src string, tgt string", "src", "tgt")
    return found.select("src", "tgt", "pair_hash")


def holdout_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents of a twentieth of the parts, but for those of two sources, held out with all rows of their part; the rest trains."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", (F.col("doc_id") % 97).alias("doc"))
    free = docs.where(~F.lower(F.trim("source")).isin("src0", "src1")).select("doc").distinct().withColumn("h", hash_order(F.col("doc"), SEED))
    ranked, n = numbered(free, ["h"], "k")
    held = ranked.where(F.col("k") < max(1, int(n * 0.05))).select("doc", F.lit(True).alias("held"))
    out = docs.join(held, "doc", "left")
    split = F.when(F.col("held") & ~F.lower(F.trim("source")).isin("src0", "src1"), "val").when(F.col("held"), "left_out").otherwise("train")
    return out.select("doc_id", split.alias("split"))


def row_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the rows, in hash order, for validation."""
    rows, n = numbered(read(spark, sf_dir, "orders").select("o_orderkey", hash_order(F.col("o_orderkey"), SEED).alias("h")), ["h"], "k")
    return rows.select("o_orderkey", (F.col("k") < round(n * 0.1)).alias("val"))


def stable_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1, O3: the first hundred documents by language, then length downwards, then number."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    top = docs.orderBy("lang", F.desc("n_chars"), "doc_id").limit(100)
    return first_by(top.withColumn("one", F.lit(1)), ["one"], [F.asc("lang"), F.desc("n_chars"), F.asc("doc_id")], 100, "place").drop("one")


QUERIES = {f.__name__: f for f in (csv_round_trip, zip_scan, part_files, split_sink, submission, stream_pairs, holdout_sources, row_split, stable_sort)}

_ALIGNED = f"{SQL_PAIRS}, aligned as (select conv_id as oare_id, turn, v as variant from pairs, (select unnest(['A', 'B', 'C']) as v)), folds as (select oare_id, cast((row_number() over (order by md5(cast(oare_id as varchar) || '|{SEED}')) - 1) % {FOLDS} as int) as own from (select distinct oare_id from aligned))"
ORACLE_SQL = {
    "csv_round_trip": "select doc_id, lang, source, md5(regexp_replace(text, '\\r\\n?', chr(10), 'g')) as text_md5 from documents",
    "zip_scan": "select cast(n_nationkey as bigint) as n_nationkey, n_name from nation",
    "part_files": "select cast(c_custkey % 3 as bigint) as part, count(*) as n, cast(sum(c_custkey) as bigint) as total from customer group by 1",
    "split_sink": f"with {_ALIGNED}, f as (select unnest(range({FOLDS})) as fold), n as (select variant, cast(fold as int) as fold, count(*) filter (own <> fold) + 1 as train_rows, count(*) filter (own = fold) as val_rows, count(distinct case when own = fold then oare_id end) as val_docs from aligned join folds using (oare_id), f group by variant, fold) select * from n",
    "submission": f"select item_id as id, case when item_id % 4 <> 0 then {sql_clean('text')} else '' end as translation from benchmark",
    "stream_pairs": "select distinct cast(c_nationkey as varchar) as src, c_mktsegment as tgt, md5(cast(c_nationkey as varchar) || chr(9) || c_mktsegment) as pair_hash from customer",
    "holdout_sources": f"with d as (select doc_id, source, doc_id % 97 as doc from documents), f as (select distinct doc from d where lower(trim(source)) not in ('src0', 'src1')), r as (select doc, row_number() over (order by md5(cast(doc as varchar) || '|{SEED}')) - 1 as k, count(*) over () as n from f), h as (select doc from r where k < greatest(1, floor(n * 0.05))) select doc_id, case when h.doc is null then 'train' when lower(trim(source)) not in ('src0', 'src1') then 'val' else 'left_out' end as split from d left join h using (doc)",
    "row_split": f"select o_orderkey, row_number() over (order by md5(cast(o_orderkey as varchar) || '|{SEED}')) - 1 < round_even(count(*) over () * 0.1, 0) as val from orders",
    "stable_sort": "select doc_id, lang, n_chars, cast(row_number() over (order by lang, n_chars desc, doc_id) as int) as place from documents qualify place <= 100",
}
