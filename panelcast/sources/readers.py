"""Landed files to typed DataFrames."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.operators.panel import union_all

# Position by code.
CODE_TO_POSITION = {1: "GK", 2: "DEF", 3: "MID", 4: "FWD"}
# Availability code to label.
STATUS_LABEL = {"a": "available", "d": "doubtful", "i": "injured", "s": "suspended", "u": "unavailable", "n": "ineligible"}


def read_csv(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """One season's CSV: every column a string, selected by name later, since columns differ by season.

    A byte-order mark on the first header is dropped.
    """
    df = spark.read.option("header", True).option("escape", '"').csv(path)
    first = df.columns[0]
    clean = first.lstrip("﻿").removeprefix("ï»¿")
    return df.withColumnRenamed(first, clean) if clean != first else df


def read_seasons(spark: SparkSession, paths: Mapping[str, str], schema: T.StructType | None = None) -> DataFrame:
    """Season files concatenated by name with their season label; no seasons gives an empty frame of `schema`."""
    frames = [read_csv(spark, p).withColumn("season", F.lit(s)) for s, p in paths.items()]
    return union_all(frames, schema, spark)


def typed(df: DataFrame, columns: Mapping[str, tuple[str, str]]) -> DataFrame:
    """`{new: (source, type)}`; a source the file lacks is null, a value that does not parse is null."""
    return df.select(*[
        (F.col(f"`{src}`") if src in df.columns else F.lit(None).cast("string")).try_cast(kind).alias(new)
        for new, (src, kind) in columns.items()
    ])


def day_first(c: Column) -> Column:
    """Dates written day first, with a long or short year, or in ISO form."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)).cast("date") for f in ("dd/MM/yyyy", "dd/MM/yy", "yyyy-MM-dd")])


def read_prices(spark: SparkSession, paths: Mapping[str, str], division: str | None = None) -> DataFrame:
    """Price files by season; upcoming files also hold other divisions, which `division` filters out."""
    df = read_seasons(spark, paths)
    return df.where(F.col("Div") == division) if division else df


def read_results(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """Played matches only: both scores known, dates parsed."""
    df = read_seasons(spark, paths)
    return typed(df.withColumn("__date", day_first(F.col("Date")).cast("string")), {
        "season": ("season", "string"), "date": ("__date", "date"), "home": ("HomeTeam", "string"), "away": ("AwayTeam", "string"),
        "home_goals": ("FTHG", "int"), "away_goals": ("FTAG", "int")}).dropna(subset=["home_goals", "away_goals"])


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, one per file or line group, with an explicit schema: nothing is inferred from the data."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


CALENDAR_SCHEMA = (
    "elements array<struct<id:bigint,web_name:string,first_name:string,second_name:string,team:bigint,element_type:bigint,"
    "now_cost:bigint,ep_next:string,chance_of_playing_next_round:double,penalties_order:double,"
    "corners_and_indirect_freekicks_order:double,status:string>>,"
    "teams array<struct<id:bigint,name:string,short_name:string>>,"
    "events array<struct<id:bigint,deadline_time:string,finished:boolean,is_current:boolean,is_next:boolean>>"
)


def rows_of(documents: DataFrame, field: str) -> DataFrame:
    """An array of structs inside each document as rows."""
    return documents.select(F.inline(field))


def entities(documents: DataFrame) -> DataFrame:
    d = rows_of(documents, "elements")
    pairs = [F.lit(x) for kv in CODE_TO_POSITION.items() for x in kv]
    return d.withColumn("position", F.try_element_at(F.create_map(*pairs), F.col("element_type").cast("int")))


def calendar(documents: DataFrame) -> DataFrame:
    return rows_of(documents, "events").withColumn("deadline_time", F.try_to_timestamp("deadline_time"))


SCHEDULE_SCHEMA = (
    "id bigint, event bigint, team_h bigint, team_a bigint, team_h_difficulty double, team_a_difficulty double, "
    "team_h_score double, team_a_score double, kickoff_time string, started boolean, finished boolean"
)


def read_schedule(spark: SparkSession, path: str) -> DataFrame:
    """The event list; nested statistics are not in the schema and so never read."""
    return read_document(spark, path, SCHEDULE_SCHEMA).withColumn("kickoff_time", F.try_to_timestamp("kickoff_time"))


def read_histories(spark: SparkSession, path: str, item: str) -> DataFrame:
    """One file per entity, its `history` array as rows; the files are read in parallel."""
    return read_document(spark, path, f"history array<struct<{item}>>").select(F.inline("history"))


def last_season_records(spark: SparkSession, path: str) -> DataFrame:
    """The most recent completed season of every entity: the last element of its `history_past`."""
    d = read_document(spark, path, "id bigint, history_past array<struct<season_name:string,total_points:bigint,minutes:bigint>>")
    return last_records(d)


def last_records(documents: DataFrame) -> DataFrame:
    last = F.element_at("history_past", -1)
    return documents.where(F.size("history_past") > 0).select(
        F.col("id").alias("entity"), F.coalesce(last["total_points"], F.lit(0)).alias("points"), F.coalesce(last["minutes"], F.lit(0)).alias("minutes"))


CAPTURE_SCHEMA = (
    "gameweek int, captured_at string, "
    "players array<struct<id:bigint,ep_next:string,now_cost:double,penalties_order:double,"
    "corners_and_indirect_freekicks_order:double,chance_of_playing_next_round:double>>, "
    "fixtures array<struct<id:bigint,event:bigint,team_h:bigint,team_a:bigint,team_h_difficulty:double,team_a_difficulty:double>>, "
    "_corrupt_record string"
)


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """Capture documents; an unreadable one, or one without period, time or entities, is skipped."""
    d = spark.read.schema(CAPTURE_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    d = d.withColumn("captured_at", F.try_to_timestamp("captured_at"))
    return d.where(
        F.col("_corrupt_record").isNull() & F.col("gameweek").isNotNull() & F.col("captured_at").isNotNull() & F.col("players").isNotNull()
    ).drop("_corrupt_record")


def capture_rows(captures: DataFrame) -> DataFrame:
    """One row per captured entity, under the names the panel uses."""
    p = captures.select(F.col("gameweek").alias("period"), "captured_at", F.explode("players").alias("p"))
    return p.select(
        "period", F.col("p.id").alias("entity"), "captured_at", F.col("p.ep_next").try_cast("double").alias("xp"), F.col("p.now_cost").alias("value"),
        F.col("p.penalties_order").alias("penalties_order"), F.col("p.corners_and_indirect_freekicks_order").alias("setpiece_order"),
        F.col("p.chance_of_playing_next_round").alias("chance_of_playing")).where(F.col("entity").isNotNull())


def capture_ratings(captures: DataFrame) -> DataFrame:
    """Event ratings as captured; a capture without them yields no rows."""
    f = captures.select(F.col("gameweek").alias("period"), "captured_at", F.explode("fixtures").alias("f"))
    return f.select("period", "captured_at", F.col("f.id").alias("event"), F.col("f.team_h_difficulty").alias("home_rating"),
                    F.col("f.team_a_difficulty").alias("away_rating")).where(F.col("event").isNotNull())


def read_feature_table(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """The stored feature frame and the feature list saved beside it."""
    names = spark.read.text(f"{path}/_features", wholetext=True).first()[0]
    return spark.read.parquet(f"{path}/rows"), json.loads(names)


def read_predictions(spark: SparkSession, path: str, season, period) -> DataFrame | None:
    """Stored builds of one period, or None when nothing was stored; partitions of other periods are not read."""
    try:
        df = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    out = df.where((F.col("season") == season) & (F.col("period") == period))
    return None if out.isEmpty() else out
