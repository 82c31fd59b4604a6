"""Queries for the lagged windows, ranks and group statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.operators import ranks, windows as w
from panelcast.plans.panels import EV, EV_SQL, ORD, ORD_SQL, PLAY, PLAY_SQL, ev_panel, ord_panel, play_panel, with_sql
from panelcast.plans.registry import query


def lagged_sql(cte: str, panel: str, exprs: dict[str, str], keys: str = "season, entity", period: str = "period",
               event: str = "event", digits: int = 4) -> str:
    """Collapse running values to periods, lag by one existing period, join back."""
    inc = ", ".join(f"{e} AS i{k}" for k, e in enumerate(exprs.values()))
    close = ", ".join(
        f"last(i{k} ORDER BY ts, {event}) FILTER (WHERE i{k} IS NOT NULL) AS v{k}" for k in range(len(exprs)))
    lag = ", ".join(f"lag(v{k}) OVER (PARTITION BY {keys} ORDER BY {period}) AS g{k}" for k in range(len(exprs)))
    out = ", ".join(f"round(CAST(g{k} AS DOUBLE), {digits}) AS {n}" for k, n in enumerate(exprs))
    return with_sql(cte) + f""",
inc AS (SELECT {keys}, {period}, ts, {event}, {inc} FROM {panel}
        WINDOW w AS (PARTITION BY {keys} ORDER BY {period}, ts, {event})),
per AS (SELECT {keys}, {period}, {close} FROM inc GROUP BY {keys}, {period}),
lagged AS (SELECT {keys}, {period}, {lag} FROM per)
SELECT {keys}, {period}, {event}, {out} FROM {panel} JOIN lagged USING ({keys}, {period})"""


def frame(stat: str, col: str, size: int | None) -> str:
    rows = f"{size - 1} PRECEDING" if size else "UNBOUNDED PRECEDING"
    return (f"{stat}({col}) OVER (PARTITION BY season, entity ORDER BY period, ts, event "
            f"ROWS BETWEEN {rows} AND CURRENT ROW)")


def nth(col: str, n: int) -> str:
    return f"lag({col}, {n - 1}) OVER (PARTITION BY season, entity ORDER BY period, ts, event)"


def shaped(df, spec, names, digits=4):
    return df.select(*spec.keys, spec.period, spec.event, *[F.round(F.col(n).cast("double"), digits).alias(n) for n in names])


ROLLING = {"x_r3": frame("avg", "x", 3), "x_r5": frame("avg", "x", 5), "y_r3_sum": frame("sum", "y", 3),
           "x_r3_max": frame("max", "x", 3), "x_r3_min": frame("min", "x", 3)}
ROLLING_LAGS = [w.rolling("x", 3), w.rolling("x", 5), w.rolling("y", 3, "sum", name="y_r3_sum"),
                w.rolling("x", 3, "max", name="x_r3_max"), w.rolling("x", 3, "min", name="x_r3_min")]
EXPANDING = {"x_todate": frame("avg", "x", None), "x_sum": frame("sum", "x", None), "y_max": frame("max", "y", None)}
EXPANDING_LAGS = [w.expanding("x"), w.expanding("x", "sum", name="x_sum"), w.expanding("y", "max", name="y_max")]
NTH = {"x_lag1": nth("x", 1), "x_lag2": nth("x", 2), "y_lag2": nth("y", 2)}
NTH_LAGS = [w.nth_previous("x", 1), w.nth_previous("x", 2), w.nth_previous("y", 2)]


def _lagged(name, sql, lags, strategy):
    @query(name, lagged_sql(ORD_SQL, "ord", sql))
    def run(spark, sf):
        return shaped(w.attach_lagged(ord_panel(spark, sf), ORD, lags, strategy), ORD, list(sql))


_lagged("rolling_stat", ROLLING, ROLLING_LAGS, "direct")
_lagged("rolling_stat_collapsed", ROLLING, ROLLING_LAGS, "collapse")
_lagged("expanding_stat", EXPANDING, EXPANDING_LAGS, "direct")
_lagged("expanding_stat_collapsed", EXPANDING, EXPANDING_LAGS, "collapse")
_lagged("nth_previous_event", NTH, NTH_LAGS, "direct")
_lagged("nth_previous_event_collapsed", NTH, NTH_LAGS, "collapse")
_lagged("nth_previous_event_deep", {"x_lag4": nth("x", 4)}, [w.nth_previous("x", 4)], "direct")


@query("as_of_previous_period", lagged_sql(
    ORD_SQL, "ord", {"z": "CASE WHEN event % 3 <> 0 THEN x + y END", "running_rows":
                     "count(*) OVER (PARTITION BY season, entity ORDER BY period, ts, event ROWS UNBOUNDED PRECEDING)"}))
def as_of_previous_period(spark, sf):
    from pyspark.sql import Window

    d = ord_panel(spark, sf)
    rows = Window.partitionBy(*ORD.keys).orderBy(*ORD.order).rowsBetween(Window.unboundedPreceding, 0)
    out = w.as_of_previous_period(
        d, {"z": F.when(F.col("event") % 3 != 0, F.col("x") + F.col("y")), "running_rows": F.count("*").over(rows)}, ORD)
    return shaped(out, ORD, ["z", "running_rows"])


GATED = "CASE WHEN " + frame("count", "x", 5) + " >= 3 THEN " + frame("avg", "x", 5) + " END"


@query("rolling_min_periods", lagged_sql(ORD_SQL, "ord", {"x_r5": GATED, "x_sd": frame("stddev_samp", "x", 5)}))
def rolling_min_periods(spark, sf):
    lags = [w.rolling("x", 5, min_periods=3), w.rolling("x", 5, "std", name="x_sd")]
    return shaped(w.attach_lagged(ord_panel(spark, sf), ORD, lags), ORD, ["x_r5", "x_sd"])


FAN = {f"{c}_r{k}": frame("avg", c, k) for k in (3, 5, 10) for c in ("x", "y")} | {
    f"{c}_todate": frame("avg", c, None) for c in ("x", "y")}


@query("rolling_fan_out", lagged_sql(ORD_SQL, "ord", {f"f_{n}": e for n, e in FAN.items()}))
def rolling_fan_out(spark, sf):
    out, names = w.add_rolling_features(ord_panel(spark, sf), ORD, ["x", "y", "absent"], [3, 5, 10], prefix="f_")
    return shaped(out, ORD, names)


EV_ROLL = {"value_r3": "avg(value) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)",
           "value_todate": "avg(value) OVER (w ROWS UNBOUNDED PRECEDING)"}


@query("rolling_events_by_day", lagged_sql(EV_SQL, "ev", EV_ROLL, "month, user_id", "day", "event_id", 8))
def rolling_events_by_day(spark, sf):
    out, names = w.add_rolling_features(ev_panel(spark, sf), EV, ["value"], [3])
    return shaped(out, EV, names, 8)


REST_SQL = with_sql(ORD_SQL) + """
SELECT season, entity, event, round(epoch(ts - lag(ts) OVER (PARTITION BY season, entity ORDER BY period, ts, event)) / 86400.0, 4)
  AS days_rest FROM ord"""


@query("days_rest", REST_SQL)
def days_rest(spark, sf):
    return w.days_rest(ord_panel(spark, sf), ORD).select("season", "entity", "event", F.round("days_rest", 4).alias("days_rest"))


@query("days_rest_collapsed", REST_SQL)
def days_rest_collapsed(spark, sf):
    out = w.days_rest(ord_panel(spark, sf), ORD, strategy="collapse")
    return out.select("season", "entity", "event", F.round("days_rest", 4).alias("days_rest"))


@query("side_events_in_period", with_sql(PLAY_SQL) + """,
n AS (SELECT season, side, period, CAST(count(DISTINCT event) AS DOUBLE) AS side_events FROM play GROUP BY ALL)
SELECT season, entity, event, side_events, CASE WHEN side_events > 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_double
FROM play JOIN n USING (season, side, period)""")
def side_events_in_period(spark, sf):
    return w.events_in_period(play_panel(spark, sf), PLAY).select("season", "entity", "event", "side_events", "is_double")


RANK_SQL = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
  CAST(rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC) AS DOUBLE) AS rank FROM lineitem"""
LINE_COLS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]


def _lines(spark, sf):
    return spark.read.parquet(f"{sf}/lineitem.parquet").select(*LINE_COLS)


@query("rank_within_event", RANK_SQL)
def rank_within_event(spark, sf):
    return ranks.add_rank(_lines(spark, sf), ["l_orderkey"], "l_quantity", descending=True)


@query("rank_within_event_bucketed", RANK_SQL)
def rank_within_event_bucketed(spark, sf):
    return ranks.add_rank(_lines(spark, sf), ["l_orderkey"], "l_quantity", descending=True, strategy="buckets")


AVG_RANK = with_sql(ORD_SQL) + """
SELECT season, entity, event, CASE WHEN x IS NOT NULL THEN
  rank() OVER (PARTITION BY season ORDER BY x NULLS LAST) + (count(*) OVER (PARTITION BY season, x) - 1) / 2.0::DOUBLE END AS rank
FROM ord"""


@query("average_rank", AVG_RANK)
def average_rank(spark, sf):
    return ranks.add_rank(ord_panel(spark, sf), ["season"], "x", method="average").select("season", "entity", "event", "rank")


@query("average_rank_bucketed", AVG_RANK)
def average_rank_bucketed(spark, sf):
    out = ranks.add_rank(ord_panel(spark, sf), ["season"], "x", method="average", strategy="buckets")
    return out.select("season", "entity", "event", "rank")


@query("group_mean_and_size", with_sql(ORD_SQL) + """
SELECT season, entity, event, round(avg(x) OVER g, 4) AS mean_x, count(*) OVER g AS n FROM ord
WINDOW g AS (PARTITION BY season, entity)""")
def group_mean_and_size(spark, sf):
    out = w.with_group_stats(ord_panel(spark, sf), ["season", "entity"], mean_x=F.avg("x"), n=F.count("*"))
    return out.select("season", "entity", "event", F.round("mean_x", 4).alias("mean_x"), "n")


@query("running_max", with_sql(ORD_SQL) + """, m AS (SELECT season, side, period, max(x) AS top FROM ord GROUP BY ALL)
SELECT season, side, period, max(top) OVER (PARTITION BY season, side ORDER BY period ROWS UNBOUNDED PRECEDING) AS envelope FROM m""")
def running_max(spark, sf):
    tops = ord_panel(spark, sf).groupBy("season", "side", "period").agg(F.max("x").alias("top"))
    return tops.select("season", "side", "period", w.running_max("top", ["season", "side"], ["period"]).alias("envelope"))


@query("cumulative_share", """WITH c AS (SELECT p_size, count(*) AS n FROM part GROUP BY 1)
SELECT p_size, n, round(sum(n) OVER (ORDER BY p_size) / sum(n) OVER (), 6) AS share FROM c""")
def cumulative_share(spark, sf):
    d = w.cumulative_share(spark.read.parquet(f"{sf}/part.parquet"), "p_size")
    return d.withColumn("share", F.round("share", 6))


@query("recency_weight", with_sql(ORD_SQL) + """,
s AS (SELECT season, max(period) AS top, dense_rank() OVER (ORDER BY season) - 1 AS pos FROM ord GROUP BY season),
t AS (SELECT max(pos * 12 + top) AS newest FROM s)
SELECT season, entity, event, round(pow(0.5, (newest - (pos * 12 + period)) / 40.0), 6) AS weight
FROM ord JOIN s USING (season) CROSS JOIN t""")
def recency_weight(spark, sf):
    d = w.recency_weight(ord_panel(spark, sf), "season", "period", 40.0, 12)
    return d.select("season", "entity", "event", F.round("weight", 6).alias("weight"))


@query("pick_first_by_key", with_sql(ORD_SQL) + """
SELECT season, entity, first(event ORDER BY ts, event) AS first_event, last(event ORDER BY ts, event) AS last_event
FROM ord GROUP BY season, entity""")
def pick_first_by_key(spark, sf):
    d = ord_panel(spark, sf).select("season", "entity", "event", "ts")
    first = w.pick_by_key(d, ["season", "entity"], ["ts", "event"], "first").select("season", "entity", F.col("event").alias("first_event"))
    last = w.pick_by_key(d, ["season", "entity"], ["ts", "event"], "last").select("season", "entity", F.col("event").alias("last_event"))
    return first.join(last, ["season", "entity"])


@query("top_n_rows", """SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25""")
def top_n_rows(spark, sf):
    from panelcast.operators.review import top_n

    return top_n(spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_totalprice"), "o_totalprice", ["o_orderkey"], 25)
