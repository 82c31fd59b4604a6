"""Ranks inside groups, with a plan for groups too large for one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.operators.ranges import running_total


def add_rank(
    df: DataFrame, by: Sequence[str], value: str, name: str = "rank", method: str = "min",
    descending: bool = False, strategy: str = "direct",
) -> DataFrame:
    """`method` "min" gives ties their best rank, "average" their mean rank. Null values get null.

    ``direct`` is one window. ``buckets`` counts distinct values first and ranks them from the counts
    of ordered ranges of equal depth, so a group of any size and shape is shared between tasks. The caller picks.
    """
    if method not in ("min", "average"):
        raise ValueError(f"unknown rank method {method!r}")
    by = list(by)
    return (_bucketed if strategy == "buckets" else _direct)(df, by, value, name, method, descending)


def _direct(df, by, value, name, method, descending):
    order = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    window = Window.partitionBy(*by).orderBy(order)
    rank = F.rank().over(window).cast("double")
    if method == "average":
        # The frame of an ordered window ends with the last row of equal value, so both come from one pass.
        rank = (rank + F.count("*").over(window)) / 2.0
    return df.withColumn(name, F.when(F.col(value).isNotNull(), rank))


def _bucketed(df, by, value, name, method, descending):
    """Distinct values are counted, dealt to ranges of equal depth and ranked from the counts ahead; any ordered type will do."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    order = F.col(value).desc() if descending else F.col(value).asc()
    placed = running_total(counts, by, [order], "__n", "__before", "__all", "ranks")
    rank = F.col("__before") + 1 if method == "min" else F.col("__before") + (F.col("__n") + 1) / 2.0
    ranked = placed.select(*by, value, rank.cast("double").alias(name))
    keys = [*by, value]
    return df.join(_renamed(ranked, keys), _same(keys), "left").drop(*[f"__k_{k}" for k in keys])


def _renamed(df, keys):
    return df.withColumnsRenamed({k: f"__k_{k}" for k in keys})


def _same(keys):
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return out
