"""Running totals and ranks over groups of any size and shape: ordered ranges of equal depth, and one offset per range.

Rows are dealt by ranges of (group, order) whose bounds Spark takes from a sample of the rows, so a range holds about as many
rows as any other, however the values lie and however large a group is. Inside a range a window runs; across ranges only
one sum per range and group is added up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.session import materialise

RANGE = "__range"


def in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[Column], label: str) -> DataFrame:
    """The rows with the number of their range, ascending in (keys, order). Written, so that the ranges stay as they are."""
    dealt = df.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys], *order)
    return materialise(dealt.withColumn(RANGE, F.spark_partition_id()), label)


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, before: str, total: str, label: str) -> DataFrame:
    """Adds the sum of `value` over the rows ahead in the group (`before`) and over the whole group (`total`).

    `order` must be unique within a group and not null; groups may be null.
    """
    keys, summed = list(keys), "__sum"
    rows = in_ranges(df, keys, order, label)
    sums = rows.groupBy(*keys, RANGE).agg(F.sum(value).alias(summed))
    # One row per range and group.
    group = Window.partitionBy(*keys)
    ahead = F.coalesce(F.sum(summed).over(group.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(RANGE).alias("__r"), ahead.alias("__ahead"), F.sum(summed).over(group).alias(total))
    inside = Window.partitionBy(*keys, RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    same = F.col(RANGE) == F.col("__r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    out = rows.join(offsets, same).withColumn(before, F.col("__inside") + F.col("__ahead"))
    return out.drop(RANGE, "__r", "__ahead", "__inside", *[f"__k{i}" for i in range(len(keys))])
