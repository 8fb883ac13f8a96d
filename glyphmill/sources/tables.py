"""Scans and sinks.

CSV has a header, quotes doubled inside quotes, and line ends inside quotes, as data frames write it; all columns are read as
text unless types are asked for. Files are read and written by the executors; what is made on the driver is side files of
a few rows.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
import pyarrow.csv
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.operators.ordering import numbered

CSV = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}
#: Spark cuts white space and control characters off the ends of texts that it writes unless told otherwise.
WRITTEN = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return bool(found) and len(found) > 0


def read_table(spark: SparkSession, path: str, label: str = "table", types: bool = True, columns: list[str] | None = None, null: str | None = None) -> DataFrame:
    """Parquet by suffix or as a folder of part files, CSV in a ZIP file, else CSV; an error that names the label if it isn't there.

    types=False reads CSV as text and nulls as empty texts. columns: read these alone. null: how CSV has nulls, which then
    stay nulls; without it, they can't be told from empty texts.
    """
    if not _exists(spark, path):
        raise FileNotFoundError(f"{label} not found: {path}")
    kind = PurePosixPath(path.rstrip("/")).suffix.lower()
    if kind == ".zip":
        df = read_zip(spark, path)
    elif kind == ".parquet":
        df = spark.read.parquet(path)
    else:
        df = spark.read.options(**CSV, inferSchema=types, **({} if null is None else {"nullValue": null})).csv(path)
    df = df.select(*[F.col(f"`{c}`") for c in columns]) if columns else df
    if types or kind == ".parquet":
        return df
    text = lambda c: F.col(f"`{c}`").cast("string")
    return df.select(*[(F.coalesce(text(c), F.lit("")) if null is None else text(c)).alias(c) for c in df.columns])


def _members(archive: zipfile.ZipFile) -> list[str]:
    return sorted(n for n in archive.namelist() if n.lower().endswith(".csv") and not n.startswith("__MACOSX/"))


def read_zip(spark: SparkSession, path: str) -> DataFrame:
    """S3: the first CSV file in each ZIP archive at path, all columns text. Archives are unpacked by the executors, a piece at a time."""
    files = spark.read.format("binaryFile").load(path)
    # the columns of one archive are those of all
    head = files.select("content").limit(1).first()[0]
    with zipfile.ZipFile(io.BytesIO(head)) as z, z.open(_members(z)[0]) as f:
        names = pyarrow.csv.open_csv(f).schema.names
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = {"convert_options": pyarrow.csv.ConvertOptions(column_types={n: pa.string() for n in names}, strings_can_be_null=True, quoted_strings_can_be_null=False), "parse_options": pyarrow.csv.ParseOptions(newlines_in_values=True)}
        for batch in batches:
            for content in batch.column("content"):
                with zipfile.ZipFile(pa.BufferReader(content.as_buffer())) as z, z.open(_members(z)[0]) as f:
                    for piece in pyarrow.csv.open_csv(f, **options):
                        yield piece.select(names)

    return files.select("content").mapInArrow(run, schema)


def columns_of(spark: SparkSession, path: str) -> list[str]:
    """The columns of a table, without its rows."""
    kind = PurePosixPath(path.rstrip("/")).suffix.lower()
    return (spark.read.parquet(path) if kind == ".parquet" else read_zip(spark, path) if kind == ".zip" else spark.read.options(**CSV).csv(path)).columns


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """The part files of a folder (part-*.parquet, else *part-*.parquet), one file, or those beside path that its name begins; with part, a file's number."""
    stem = re.sub(r"\.parquet$", "", path.rstrip("/"))
    for pattern in (f"{path}/part-*.parquet", f"{path}/*part-*.parquet", path, f"{stem}-part-*.parquet"):
        if _exists(spark, pattern):
            df = spark.read.parquet(pattern)
            number = F.regexp_extract("_metadata.file_name", r"part-(\d+)[^/]*\.parquet$", 1)
            return df.select("*", F.when(number != "", number.cast("int")).alias("part"))
    raise FileNotFoundError(f"no part files at {path}")


def read_lines(spark: SparkSession, path: str, name: str = "value") -> DataFrame:
    """(line, name): the lines of text files with their numbers from 0, by file, then by the place of their block in it."""
    rows = spark.read.text(path).select(F.col("value").alias(name), "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("_at"))
    return numbered(rows, ["file_path", "file_block_start", "_at"], "line")[0].select("line", name)


def parallel_lines(spark: SparkSession, source: str, target: str) -> DataFrame:
    """(line, src, tgt) of two files line by line; an error if one has more lines."""
    a, b = read_lines(spark, source, "src"), read_lines(spark, target, "tgt")
    n, m = a.count(), b.count()
    if n != m:
        raise ValueError(f"{source} has {n} lines, {target} has {m}")
    return a.join(b, "line")


def block_translations(df: DataFrame) -> DataFrame:
    """(block_hash, translation_en) from a table whose columns go by several names; a missing hash is that of the text; the last of a hash counts."""
    from glyphmill.functions import udfs
    from glyphmill.sources.config import pick

    lower = {c.lower(): c for c in df.columns}
    mark, raw = (lower.get(pick(list(lower), names)) for names in (("block_hash", "hash"), ("text", "raw_text", "block_text")))
    english = lower.get(pick(list(lower), ("translation_en", "translated_en", "translated_text", "translation_text", "english_text")))
    if english is None or mark is None and raw is None:
        raise ValueError(f"no translation, or neither hash nor text, among {df.columns}")
    given = F.trim(F.coalesce(F.col(mark).cast("string"), F.lit(""))) if mark else F.lit("")
    hashed = F.when(given != "", given)
    if raw:
        hashed = F.coalesce(hashed, F.when(F.coalesce(F.col(raw), F.lit("")) != "", udfs.apply("block_hash", F.col(raw))))
    rows = df.select(hashed.alias("block_hash"), F.trim(F.coalesce(F.col(english).cast("string"), F.lit(""))).alias("translation_en"), F.monotonically_increasing_id().alias("_at"))
    return rows.where("block_hash is not null and translation_en <> ''").groupBy("block_hash").agg(F.max_by("translation_en", "_at").alias("translation_en"))


def read_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """(variant, fold, bleu, chrf, score, geometric_mean) of every metrics.json under folder; variant and fold from the file, else from the path."""
    schema = "variant string, fold string, bleu double, chrf double, score double, geometric_mean double"
    rows = spark.read.schema(schema).options(recursiveFileLookup=True, multiLine=True, pathGlobFilter="metrics.json").json(folder)
    named = lambda k: F.coalesce(F.col(k), F.regexp_extract(F.col("_metadata.file_path"), f"/{k}=([^/]+)/", 1)).alias(k)
    return rows.select(named("variant"), named("fold"), "bleu", "chrf", "score", "geometric_mean")


def read_predictions(spark: SparkSession, path: str, ids: DataFrame | None = None, id_: str = "id") -> DataFrame:
    """(id, translation) of predictions; a file of one column without a header is translations alone, and takes the ids in order. Numbers of rows must agree."""
    head = columns_of(spark, path)
    if len(head) == 1 and head[0] not in ("id", "translation"):
        df = spark.read.options(**CSV | {"header": False}).csv(path).toDF("translation")
    else:
        df = spark.read.options(**CSV).csv(path)
    if "translation" not in df.columns:
        raise ValueError(f"no column translation in {path}")
    if "id" in df.columns:
        return df.select("id", "translation")
    if ids is None:
        raise ValueError(f"no ids for {path}")
    place = F.monotonically_increasing_id().alias("_at")
    rows, n = numbered(df.select("translation", place), ["_at"], "_row")
    keys, m = numbered(ids.select(F.col(id_).alias("id"), place), ["_at"], "_row")
    if n != m:
        raise ValueError(f"{n} predictions for {m} ids")
    return keys.join(rows, "_row").select("id", "translation")


def realigned(predictions: DataFrame, wanted: DataFrame, id_: str = "id") -> DataFrame:
    """A translation for every wanted id, empty where there is none."""
    return wanted.select(id_).join(predictions, id_, "left").select(id_, F.coalesce("translation", F.lit("")).alias("translation"))


def normalised_candidates(df: DataFrame, id_: str, tag: str, text: str | None = None) -> DataFrame:
    """(id_, translation, tag, and the rank, run and score columns that there are) of a table of candidates whatever its columns are called."""
    from glyphmill.sources.config import pick

    key = id_ if id_ in df.columns else pick(df.columns, ("id", "ID", "Id", "sample_id", "row_id"))
    said = text or pick(df.columns, ("translation", "pred", "prediction", "text", "output", "hyp"))
    if key is None or said not in df.columns:
        raise ValueError(f"no id or no text among {df.columns}")
    kept = [c for c in ("rank", "run", "gen_score", "seq_score", "sequence_score", "score") if c in df.columns]
    return df.select(F.col(key).cast("string").alias(id_), F.coalesce(F.col(said).cast("string"), F.lit("")).alias("translation"), (F.col("tag") if "tag" in df.columns else F.lit(tag)).alias("tag"), *kept)


# ---- sinks ----


def write_table(df: DataFrame, path: str, kind: str | None = None, null: str = "") -> str:
    """Parquet, or CSV where kind or the suffix says so, nulls as `null`; a folder of part files. The path."""
    kind = kind or ("csv" if path.lower().endswith(".csv") else "parquet")
    writer = df.write.mode("overwrite")
    (writer.options(**WRITTEN, nullValue=null).csv if kind == "csv" else writer.parquet)(path)
    return path


def ordered(df: DataFrame, first: list[str]) -> DataFrame:
    """The columns of `first` that there are, then the others."""
    return df.select(*[F.col(f"`{c}`") for c in [*[c for c in first if c in df.columns], *[c for c in df.columns if c not in first]]])


def with_ids(df: DataFrame, id_: str = "id") -> DataFrame:
    """Df with its id column, as text; row numbers from 0 in load order where it has none."""
    if id_ in df.columns:
        return df.withColumn(id_, F.col(id_).cast("string"))
    rows, _ = numbered(df.withColumn("_at", F.monotonically_increasing_id()), ["_at"], id_)
    return rows.drop("_at").withColumn(id_, F.col(id_).cast("string"))


def splits(pairs: DataFrame, folds: DataFrame, variants: list[str], extra: DataFrame | None = None, extra_in: str = "train", doc: str = "oare_id") -> DataFrame:
    """Every row once for each fold, as val of its own and as train of the others; extra rows go to train, or to 'all'.

    folds: (doc, fold), one for each document: as small as the list of documents, so it is left to the planner to broadcast.
    """
    kept = pairs.where(F.col("src_norm_variant").isin(variants)).join(folds.select(doc, F.col("fold").alias("_own")), doc)
    every = folds.select("fold").distinct()
    # one row for each fold
    out = kept.crossJoin(F.broadcast(every)).withColumn("split", F.when(F.col("fold") == F.col("_own"), "val").otherwise("train")).drop("_own").withColumn("variant", F.col("src_norm_variant"))
    if extra is not None:
        names = pairs.sparkSession.createDataFrame([(v, s) for v in variants for s in (("train", "val") if extra_in == "all" else ("train",))], "variant string, split string")
        out = out.unionByName(extra.crossJoin(F.broadcast(every)).crossJoin(F.broadcast(names)), allowMissingColumns=True)
    return out


def write_splits(rows: DataFrame, path: str, kind: str = "parquet") -> DataFrame:
    """Rows of `splits` under variant=/fold=/split=, and their numbers as summary.csv; (variant, fold, train_rows, val_rows)."""
    writer = rows.write.mode("overwrite").partitionBy("variant", "fold", "split")
    (writer.options(**WRITTEN).csv if kind == "csv" else writer.parquet)(path)
    summary = rows.groupBy("variant", "fold").agg(F.count_if(F.col("split") == "train").alias("train_rows"), F.count_if(F.col("split") == "val").alias("val_rows"))
    # a row for each variant and fold
    summary.coalesce(1).orderBy("variant", "fold").write.mode("overwrite").option("header", True).csv(f"{path}/_summary")
    return summary


def write_part(df: DataFrame, folder: str, number: int, overwrite: bool = False) -> bool:
    """K3: df as part-<number>.parquet of a folder, unless it is there complete; whether it was written."""
    path = f"{folder}/part-{number:04d}.parquet"
    if not overwrite and _exists(df.sparkSession, f"{path}/_SUCCESS"):
        return False
    df.write.mode("overwrite").parquet(path)
    return True


def append_csv(df: DataFrame, folder: str) -> None:
    """K4: rows added to a folder of CSV files, each with its header."""
    df.write.mode("append").options(**WRITTEN).csv(folder)


def write_json(spark: SparkSession, path: str, payload: dict) -> None:
    """K5, K8: a side file of statistics, keys sorted; decimals as numbers and rows as lists."""
    from glyphmill.shared import _write_bytes

    _write_bytes(spark, path, json.dumps(payload, ensure_ascii=False, indent=2, sort_keys=True, default=float).encode())


def write_index(folder: str, weights: DataFrame, idf: DataFrame, meta: DataFrame, settings: dict) -> None:
    """A retrieval index as Parquet tables (postings, idf, meta) with settings.json."""
    for name, df in (("postings", weights), ("idf", idf), ("meta", meta)):
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    write_json(meta.sparkSession, f"{folder}/settings.json", settings)


def read_index(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, dict]:
    """(weights, idf, meta, settings) of an index that write_index wrote; older column names of meta are understood."""
    weights, idf, meta = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("postings", "idf", "meta"))
    for old, new in (("src_sent", "src"), ("source", "src"), ("tgt_sent", "tgt"), ("translation", "tgt")):
        if old in meta.columns and new not in meta.columns:
            meta = meta.withColumnRenamed(old, new)
    return weights, idf, meta, json.loads(spark.read.text(f"{folder}/settings.json", wholetext=True).first()[0])


def write_submission(predictions: DataFrame, path: str, single: str | None = "merge", output_form: bool = False) -> DataFrame:
    """(id, translation) in one CSV file, translations cleaned (or in output form) and made one sentence; what was written."""
    from glyphmill.functions import text as X
    from glyphmill.functions import udfs

    text = udfs.apply("normalize_output", F.col("translation")) if output_form else X.clean(F.col("translation"))
    if single:
        text = udfs.apply("single_sentence" if single == "merge" else "first_sentence", text)
    out = predictions.select("id", text.alias("translation"))
    # a submission is one file of as many rows as there are test ids
    out.coalesce(1).write.mode("overwrite").options(**WRITTEN).csv(path)
    return predictions.sparkSession.read.options(**CSV).csv(path)
