"""The folder that all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import hashlib
import io
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Arrow batches are bounded by bytes too: 10,000 long texts would exceed what one batch can hold. A batch is held by the
#: executor, outside its heap, and by its Python worker at once, for each running task; operators cut it to 1 MB anyway.
BATCH_BOUNDS = {"spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Where it is unset, one is made for a session that runs on this machine alone; on a cluster it is an error, since a
    folder of one machine can't be read from another.
    """
    named = spark.conf.get(SETTING, None)
    if not named:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"{SETTING} must name a folder that all executors of {master} can reach")
        named = "file://" + tempfile.mkdtemp(prefix="glyphmill-")
        spark.conf.set(SETTING, named)
    return named.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/glyphmill/{name}-{uuid.uuid4().hex}"


def local_path(path: str) -> str:
    """A path of the shared folder as one that Python can open on every executor; an error if it isn't a mounted file system."""
    scheme, mark, rest = path.partition(":")
    if not mark:
        rest = path
    elif scheme != "file":
        raise ValueError(f"{SETTING} must name a mounted file system: {path}")
    return "/" + rest.lstrip("/")


def local_folder(spark: SparkSession, name: str, of: str) -> str:
    """A folder in the shared one, the same for each call with name and of, as a path that Python can open."""
    return local_path(f"{shared_dir(spark)}/glyphmill/{name}-{hashlib.md5(of.encode()).hexdigest()}")


def write_shared(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it again; codec: of its Parquet files.

    The result depends on the written files alone, so that losing an executor costs no recomputation. The shuffle files of
    the write are deleted when it ends, rather than when the driver's garbage happens to be collected.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        (df.write.option("compression", codec) if codec else df.write).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    written = spark.read.schema(df.schema).parquet(path)
    written._shared_path = path
    return written


def few(df: DataFrame, bound: int) -> DataFrame:
    """df, marked for broadcast if it has at most so many rows; beyond, a join with it shuffles both sides. df should be narrow."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def drop_shared(df: DataFrame) -> None:
    """Delete the files of a table that write_shared returned and that nothing reads any more."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(df._shared_path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def put_file(spark: SparkSession, name: str, data: bytes) -> str:
    """Write bytes to the shared folder and have every executor fetch them; the name for SparkFiles.get.

    The file goes through Hadoop's file system, whatever the folder's scheme. Executors that start later fetch it too.
    """
    path = shared_path(spark, name)
    _write_bytes(spark, path, data)
    spark.sparkContext.addFile(path)
    return path.rpartition("/")[2]


def _write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        step = 1 << 22
        for i in range(0, len(data), step):
            out.write(bytearray(data[i : i + step]))
    finally:
        out.close()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for a Spark context; Python workers then import it wherever they run."""
    context = spark.sparkContext
    for setting, bound in BATCH_BOUNDS.items():
        if int(re.sub(r"\D", "", spark.conf.get(setting)) or 0) > bound or spark.conf.get(setting).startswith("-"):
            spark.conf.set(setting, str(bound))
    if getattr(context, "_glyphmill_shipped", False):
        return
    top = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, str(p.relative_to(top.parent)))
    path = shared_path(spark, "package") + ".zip"
    _write_bytes(spark, path, packed.getvalue())
    context.addPyFile(path)
    context._glyphmill_shipped = True
