"""Global row numbers, ranks and hash orders without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.shared import write_shared


def numbered(df: DataFrame, order: list[str], name: str = "row_number") -> tuple[DataFrame, int]:
    """(df with a global row number from 0 by the columns of order, nulls first; number of rows).

    The sorted rows are written to the shared folder with their place in their range partition; counts for each partition
    give its first number. No task holds more than one partition; rows that are equal in all columns of order are spread
    by a salt, so that they may fill many partitions, and their numbers follow one another in any order.
    """
    keys = [*[F.col(c).asc_nulls_first() for c in order], F.col("_salt")]
    salted = df.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(8192)).cast("int"))
    ranged = salted.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_salt")
    local = write_shared(ranged.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_place")), "numbered")
    counts = sorted((r[0], r[1]) for r in local.groupBy("_part").count().collect())
    first, starts = 0, []
    for part, n in counts:
        starts.append((part, first))
        first += n
    # one row for each partition
    offsets = df.sparkSession.createDataFrame(starts, "_part int, _first long")
    joined = local.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_first") + F.col("_place"))
    return joined.drop("_part", "_place", "_first"), first


def placed(df: DataFrame, group: str, order: list[str], name: str = "place") -> DataFrame:
    """df with the place of each row in its group from 1, by columns of order; a group may fill any number of tasks, as in `numbered`."""
    rows, _ = numbered(df, [group, *order], "_row")
    starts = rows.groupBy(F.col(group).alias("_group")).agg(F.min("_row").alias("_start"))
    return rows.join(starts, rows[group].eqNullSafe(F.col("_group"))).withColumn(name, F.col("_row") - F.col("_start") + 1).drop("_row", "_start", "_group")


def hash_order(key: Column, seed: int) -> Column:
    """A reproducible order without a pattern, the same in any engine: the MD5 of key and seed."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")).cast("binary"))


def first_by(df: DataFrame, keys: list[str], order: list[Column], n: int | None = 1, rank: str | None = None) -> DataFrame:
    """The first n rows of each key by a total order, all if n is None; rank: a column for their place from 1."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("_rank", F.row_number().over(w))
    ranked = ranked if n is None else ranked.where(F.col("_rank") <= n)
    return ranked.withColumnRenamed("_rank", rank) if rank else ranked.drop("_rank")
