"""Writers. Parquet by partition; nothing is overwritten that another period owns."""

from __future__ import annotations

import datetime
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.operators.asof import stamp_build


class DeadlinePassed(ValueError):
    """Raised when something would be stored as pre-deadline at or after its deadline."""


def write_feature_table(df: DataFrame, features: Sequence[str], path: str, by: Sequence[str] = ("season",)) -> None:
    """The frame partitioned by season, and the list of legal model inputs beside it."""
    df.write.mode("overwrite").partitionBy(*by).parquet(f"{path}/rows")
    spark = df.sparkSession
    spark.createDataFrame([(json.dumps(list(features)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_features")


def _refuse_late(deadline: datetime.datetime | None, now: datetime.datetime) -> None:
    if deadline is not None and now >= deadline:
        raise DeadlinePassed(f"the deadline was {deadline:%Y-%m-%d %H:%M}; stored at {now:%Y-%m-%d %H:%M} it would not be pre-deadline")


def append_predictions(record: DataFrame, path: str, season, period: int, deadline: datetime.datetime | None, now: datetime.datetime,
                       model: str, odds_priced: str | None = None, fingerprint: str | None = None) -> None:
    """Add one build of a period's predictions. Reads choose the build (`stored_predictions`), so writers never race."""
    _refuse_late(deadline, now)
    df = record.withColumns({"season": F.lit(season), "period": F.lit(int(period))})
    stamp_build(df, now, model, odds_priced, fingerprint).write.mode("append").partitionBy("season", "period").parquet(path)


def append_capture(captures: DataFrame, path: str, deadline: datetime.datetime | None, captured_at: datetime.datetime) -> None:
    """Add one capture as JSON, refused at or after its deadline; the newest legal one wins on read."""
    _refuse_late(deadline, captured_at)
    captures.write.mode("append").json(path)


def keep_if_newer(sources: Sequence[DataFrame], keys: Sequence[str], captured: str = "captured_at", rows: str = "players") -> DataFrame:
    """Merge capture stores, newest per key first, an earlier-listed store on ties; captures without rows are refused."""
    from panelcast.operators.asof import newest_wins

    return newest_wins([s.where(F.size(rows) > 0) for s in sources], keys, captured)


def write_metrics(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Per-period metrics: as many rows as periods and models."""
    writer = df.coalesce(1).write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def upsert_log(spark: SparkSession, table: DataFrame, path: str, season, period: int, odds_priced: str | None = None, fingerprint: str | None = None) -> None:
    """Replace one period of the running log."""
    from panelcast.operators.review import unknown_if_missing, upsert_partition

    rows = table.withColumns({
        "season": F.lit(season), "period": F.lit(int(period)), "odds_priced": F.lit(odds_priced), "fingerprint": F.lit(fingerprint)})
    upsert_partition(unknown_if_missing(rows), path, ["season", "period"])


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log over all periods; files written before the build columns existed read "unknown"."""
    from panelcast.operators.review import unknown_if_missing

    return unknown_if_missing(spark.read.option("mergeSchema", True).parquet(path))
