"""Panels derived from the given tables, as DataFrames and as the SQL the oracle uses.

ord    one row per order: customers by month, their nation as side
play   customers by half-month; a nation meets another nation once per half, so a month is a double
       period; rows from June 2001 on have no outcome yet
log    one row per customer and month: predicted and actual points by scoring term
ev     events by user and day
match  order lines as matches between the customer's and the supplier's nation, leagues by month
line   order lines as stat lines
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions.scoring import ACTUAL_TERMS, POINTS_TERMS
from panelcast.plans.registry import table
from panelcast.spec import PanelSpec

ORD = PanelSpec(entity="entity", period="period", event="event", time="ts")
PLAY = PanelSpec(entity="entity", period="period", event="event", time="ts", side="side", opponent="opponent",
                 home="is_home")
EV = PanelSpec(group=("month",), entity="user_id", period="day", event="event_id", time="ts")


def ord_panel(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.year("o_orderdate").alias("season"), F.month("o_orderdate").alias("period"),
        F.col("o_custkey").alias("entity"), F.col("o_orderkey").alias("event"), F.col("o_orderdate").alias("ts"),
        F.col("c_nationkey").alias("side"), "o_totalprice",
        # Every seventh order has no value, so null handling is exercised on the way.
        F.when(F.col("o_orderkey") % 7 != 0, (F.col("o_orderkey") % 50) / 4.0).alias("x"),
        (F.col("o_orderkey") % 13).cast("double").alias("y"),
    )


ORD_SQL = """
ord AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS season, CAST(month(o_orderdate) AS INTEGER) AS period,
         o_custkey AS entity, o_orderkey AS event, o_orderdate AS ts, c_nationkey AS side, o_totalprice,
         CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 50) / 4.0 END AS x,
         CAST(o_orderkey % 13 AS DOUBLE) AS y
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

POSITION_SQL = "CASE {0} % 4 WHEN 0 THEN 'GK' WHEN 1 THEN 'DEF' WHEN 2 THEN 'MID' ELSE 'FWD' END"


def position_of(key: str):
    k = F.col(key) % 4
    return F.when(k == 0, "GK").when(k == 1, "DEF").when(k == 2, "MID").otherwise("FWD")


def play_panel(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    key = F.col("o_orderkey")
    half = F.when(F.dayofmonth("o_orderdate") <= 15, 0).otherwise(1)
    grouped = (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.year("o_orderdate").alias("season"), F.month("o_orderdate").alias("period"), half.alias("half"),
                 F.col("o_custkey").alias("entity"), F.col("c_nationkey").alias("side"))
        .agg(F.sum(key % 7).cast("double").alias("points"), F.sum(key % 71 + 20).alias("m"),
             F.sum((key % 5 == 0).cast("int")).cast("double").alias("goals"),
             F.sum(key % 11).alias("inv"), F.sum(key).alias("h"))
    )
    opponent = F.expr("(period * 2 + half - side + 50) % 25")
    d = grouped.withColumn("opponent", opponent)
    played = F.expr("NOT (season = 2001 AND period >= 6)")

    def outcome(c, name):
        return F.when(played, c).alias(name)

    return d.select(
        "season", "period", "entity", "side", "opponent",
        F.expr("season * 100000 + period * 1000 + half * 100 + least(side, opponent)").cast("bigint").alias("event"),
        F.expr("make_date(season, period, 1 + half * 15)").cast("timestamp_ntz").alias("ts"),
        (F.col("side") <= F.col("opponent")).alias("is_home"),
        position_of("entity").alias("position"),
        outcome(F.least(F.lit(90.0), F.col("m").cast("double")), "minutes"),
        outcome((F.col("m") >= 60).cast("double"), "starts"),
        outcome(F.col("points"), "points"), outcome(F.col("goals"), "goals"),
        outcome(F.col("inv") / 4.0, "involvement"),
        outcome(F.expr("(side * 7 + period * 3 + half + season) % 4").cast("double"), "goals_for"),
        outcome(F.expr("(opponent * 7 + period * 3 + half + season) % 4").cast("double"), "goals_against"),
        F.when(F.col("h") % 3 != 0, (F.col("h") % 17) / 4.0).alias("xp"),
        F.when(F.col("entity") % 3 != 0, (F.col("entity") % 3).cast("double")).alias("first_choice"),
        (F.col("side") % 5 + 1).cast("double").alias("difficulty"),
        F.expr("40 + entity % 90").cast("double").alias("value"),
        F.col("h"),
    )


PLAY_SQL = """
play0 AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS season, CAST(month(o_orderdate) AS INTEGER) AS period,
         CASE WHEN day(o_orderdate) <= 15 THEN 0 ELSE 1 END AS half, o_custkey AS entity, c_nationkey AS side,
         CAST(sum(o_orderkey % 7) AS DOUBLE) AS points0, CAST(sum(o_orderkey % 71 + 20) AS BIGINT) AS m,
         CAST(sum(CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS goals0,
         CAST(sum(o_orderkey % 11) AS BIGINT) AS inv, CAST(sum(o_orderkey) AS BIGINT) AS h
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
play1 AS (
  SELECT *, (period * 2 + half - side + 50) % 25 AS opponent, NOT (season = 2001 AND period >= 6) AS played
  FROM play0),
play AS (
  SELECT season, period, entity, side, opponent,
         CAST(season * 100000 + period * 1000 + half * 100 + least(side, opponent) AS BIGINT) AS event,
         CAST(make_date(season, period, 1 + half * 15) AS TIMESTAMP) AS ts, side <= opponent AS is_home,
         """ + POSITION_SQL.format("entity") + """ AS position,
         CASE WHEN played THEN least(90.0::DOUBLE, m::DOUBLE) END AS minutes,
         CASE WHEN played THEN (CASE WHEN m >= 60 THEN 1.0 ELSE 0.0 END)::DOUBLE END AS starts,
         CASE WHEN played THEN points0 END AS points, CASE WHEN played THEN goals0 END AS goals,
         CASE WHEN played THEN inv / 4.0::DOUBLE END AS involvement,
         CASE WHEN played THEN ((side * 7 + period * 3 + half + season) % 4)::DOUBLE END AS goals_for,
         CASE WHEN played THEN ((opponent * 7 + period * 3 + half + season) % 4)::DOUBLE END AS goals_against,
         CASE WHEN h % 3 <> 0 THEN (h % 17) / 4.0::DOUBLE END AS xp,
         CASE WHEN entity % 3 <> 0 THEN (entity % 3)::DOUBLE END AS first_choice,
         (side % 5 + 1)::DOUBLE AS difficulty, (40 + entity % 90)::DOUBLE AS value, h
  FROM play1)"""

# Predicted and actual points per term, by modulus: quarters for forecasts, whole points for outcomes.
PREDICTED_MOD = dict(zip(POINTS_TERMS, (9, 7, 6, 5, 4, 3, 4, 6, 2)))
ACTUAL_MOD = dict(zip(ACTUAL_TERMS, (3, 5, 4, 4, 3, 3, 3, 4, 2, 2)))
NEGATIVE = ("goals_conceded", "cards", "other")


def log_panel(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    d = orders.groupBy(
        F.year("o_orderdate").alias("season"), F.month("o_orderdate").alias("period"), F.col("o_custkey").alias("entity")
    ).agg(F.sum("o_orderkey").alias("h"))
    terms = [
        ((F.col("h") + i) % m / 4.0 * (-1 if t in NEGATIVE else 1)).alias(t) for i, (t, m) in enumerate(PREDICTED_MOD.items())
    ]
    actual = [
        (F.expr(f"(h div 3 + {i * 5}) % {m}") * (-1 if t in NEGATIVE else 1)).cast("double").alias(f"act_{t}")
        for i, (t, m) in enumerate(ACTUAL_MOD.items())
    ]
    d = d.select(
        "season", "period", "entity", position_of("entity").alias("position"),
        (F.col("h") % 91).alias("minutes"),
        F.when(F.col("h") % 11 != 0, (F.col("h") % 90).cast("double")).alias("minutes_r3"),
        F.when(F.col("h") % 4 != 0, (F.col("h") % 29) / 4.0).alias("xp_external"), *terms, *actual,
    )
    return d.withColumns({
        "expected_points": sum((F.col(t) for t in POINTS_TERMS[1:]), F.col(POINTS_TERMS[0])),
        "actual": sum((F.col(f"act_{t}") for t in ACTUAL_TERMS[1:]), F.col(f"act_{ACTUAL_TERMS[0]}")),
    })


def _log_sql() -> str:
    def sign(t: str) -> str:
        return "-1" if t in NEGATIVE else "1"

    pred = ",\n".join(
        f"CAST((h + {i}) % {m} / 4.0 * {sign(t)} AS DOUBLE) AS {t}" for i, (t, m) in enumerate(PREDICTED_MOD.items())
    )
    act = ",\n".join(
        f"CAST((h // 3 + {i * 5}) % {m} * {sign(t)} AS DOUBLE) AS act_{t}" for i, (t, m) in enumerate(ACTUAL_MOD.items())
    )
    return f"""
log0 AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS season, CAST(month(o_orderdate) AS INTEGER) AS period,
         o_custkey AS entity, CAST(sum(o_orderkey) AS BIGINT) AS h FROM orders GROUP BY ALL),
log1 AS (
  SELECT season, period, entity, {POSITION_SQL.format("entity")} AS position, h % 91 AS minutes,
         CASE WHEN h % 11 <> 0 THEN CAST(h % 90 AS DOUBLE) END AS minutes_r3,
         CASE WHEN h % 4 <> 0 THEN CAST((h % 29) / 4.0 AS DOUBLE) END AS xp_external, {pred}, {act} FROM log0),
log AS (
  SELECT *, {" + ".join(POINTS_TERMS)} AS expected_points, {" + ".join("act_" + t for t in ACTUAL_TERMS)} AS actual
  FROM log1)"""


LOG_SQL = _log_sql()


def ev_panel(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id", "ts", "user_id", "event_type", "value", "props",
        F.month("ts").alias("month"), F.dayofmonth("ts").alias("day"),
    )


EV_SQL = """
ev AS (SELECT event_id, ts, user_id, event_type, value, props, CAST(month(ts) AS INTEGER) AS month,
              CAST(day(ts) AS INTEGER) AS day FROM events)"""


def match_panel(spark: SparkSession, sf: str, of_order: DataFrame | None = None) -> DataFrame:
    """Order lines as matches; `seq` orders the matches of a day inside their league. `of_order` has more columns by o_orderkey."""
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    more = [] if of_order is None else [c for c in of_order.columns if c != "o_orderkey"]
    orders = orders if of_order is None else orders.join(of_order, "o_orderkey")
    cust = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    supp = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(cust, F.col("o_custkey") == F.col("c_custkey")).join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .where(F.col("s_nationkey") != F.col("c_nationkey"))
        .select(
            F.col("n_regionkey").alias("region"), F.col("l_shipdate").cast("date").alias("date"),
            F.year("l_shipdate").alias("season"), F.month("l_shipdate").alias("month"),
            F.expr("(n_regionkey * 10000 + year(l_shipdate)) * 100 + month(l_shipdate)").cast("bigint").alias("league"),
            F.col("s_nationkey").alias("home"), F.col("c_nationkey").alias("away"),
            F.expr("cast(l_quantity as bigint) % 5").alias("home_goals"), (F.col("l_linenumber") % 4).alias("away_goals"),
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
            F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"), *more,
        )
    )


MATCH_ORDER = ["home", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cents", "home_goals"]

MATCH_SQL = """
match AS (
  SELECT n_regionkey AS region, CAST(l_shipdate AS DATE) AS date, CAST(year(l_shipdate) AS INTEGER) AS season,
         CAST(month(l_shipdate) AS INTEGER) AS month,
         CAST((n_regionkey * 10000 + year(l_shipdate)) * 100 + month(l_shipdate) AS BIGINT) AS league,
         s_nationkey AS home, c_nationkey AS away, CAST(l_quantity AS BIGINT) % 5 AS home_goals,
         l_linenumber % 4 AS away_goals, l_orderkey, l_linenumber, l_partkey, l_suppkey,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS cents
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON c_nationkey = n_nationkey
  WHERE s_nationkey <> c_nationkey)"""


def line_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as stat lines; every column is a fixed function of the line's keys."""
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    return d.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", position_of("l_partkey").alias("position"),
        *[F.expr(e).cast("bigint").alias(n) for n, e in LINE_EXPR.items()],
        F.expr("(l_partkey + l_suppkey) % 4 = 0").alias("clean_sheet"),
    )


LINE_EXPR = {
    "minutes": "(l_orderkey * 7 + l_partkey) % 91", "goals_scored": "(l_partkey + l_linenumber) % 3",
    "assists": "l_suppkey % 3", "goals_conceded": "(l_orderkey + l_suppkey) % 6", "saves": "l_orderkey % 9",
    "penalties_saved": "l_partkey % 2", "penalties_missed": "l_orderkey % 2",
    "defensive_contribution": "(l_partkey + l_orderkey) % 15", "yellow_cards": "l_linenumber % 2",
    "red_cards": "(l_partkey % 19) div 18", "own_goals": "(l_suppkey % 17) div 16",
    "bonus": "cast(l_quantity as bigint) % 4",
}
LINE_SQL = f"""
line AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {POSITION_SQL.format("l_partkey")} AS position,
         {", ".join(f"CAST({e.replace(' div ', ' // ')} AS BIGINT) AS {n}" for n, e in LINE_EXPR.items())},
         (l_partkey + l_suppkey) % 4 = 0 AS clean_sheet
  FROM lineitem)"""


def with_sql(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"
