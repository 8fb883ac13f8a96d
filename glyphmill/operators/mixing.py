"""Selection under caps and ratios: O10, V1, V2, O5 of the survey."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def target(n: Column, ratio: float) -> Column:
    """V1: how many rows a ratio asks for, halves to even."""
    return F.bround(n * F.lit(ratio)).cast("long")


def select_capped(df: DataFrame, tranche: str, group: str, order: list[Column], cap: int, ratio: float) -> DataFrame:
    """O10 with one cap: in each tranche, by order, at most `cap` rows of each group, filled up past the cap if short.

    With one cap a row's turn depends on its rank in its group alone, so windows give the greedy result.
    """
    ranked = df.withColumn("_in_group", F.row_number().over(Window.partitionBy(tranche, group).orderBy(*order)))
    beyond = (F.col("_in_group") > cap).cast("int")
    ranked = ranked.withColumn("_place", F.row_number().over(Window.partitionBy(tranche).orderBy(beyond, *order)))
    sizes = df.groupBy(tranche).agg(target(F.count("*"), ratio).alias("_target"))
    return ranked.join(sizes, tranche).where("_place <= _target").drop("_in_group", "_place", "_target")


def greedy(rows: pd.DataFrame, caps: dict[str, int], want: int) -> pd.DataFrame:
    """Rows in order while no cap of theirs is full, then the ones passed over, until `want`."""
    counts: dict[tuple[str, object], int] = {}
    taken, passed = [], []
    for i, row in enumerate(rows[list(caps)].itertuples(index=False)):
        if len(taken) == want:
            break
        keys = list(zip(caps, row))
        if all(counts.get(k, 0) < caps[k[0]] for k in keys):
            for k in keys:
                counts[k] = counts.get(k, 0) + 1
            taken.append(i)
        else:
            passed.append(i)
    return rows.iloc[taken + passed[: want - len(taken)]]


def select_greedy(df: DataFrame, tranche: str, order: list[str], caps: dict[str, int], ratio: float) -> DataFrame:
    """O10 with interacting caps: a scan in order of each tranche. Columns of order are ascending.

    Only the columns that the scan needs go through it; tranches run in parallel, one task each.
    """
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return greedy(rows.sort_values(order, kind="stable"), caps, round(len(rows) * ratio))

    return df.groupBy(tranche).applyInPandas(run, df.schema)
