"""Queries for side collapse, form joins and the whole feature build."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.operators import features as f
from panelcast.operators import windows as w
from panelcast.plans.panels import PLAY, PLAY_SQL, play_panel, with_sql
from panelcast.plans.registry import query

SIDE_STATS = {
    "goals_for": ("shared", "goals_for"), "goals_against": ("shared", "goals_against"),
    "involvement": ("total", "involvement"), "points": ("total", "points"),
}
SIDES_SQL = """,
sides AS (
  SELECT season, side, event, max(period) AS period, max(ts) AS ts,
         CASE WHEN max(goals_for) IS NOT NULL THEN max(goals_for) END AS goals_for,
         CASE WHEN max(goals_for) IS NOT NULL THEN max(goals_against) END AS goals_against,
         CASE WHEN max(goals_for) IS NOT NULL THEN coalesce(sum(involvement), 0) END AS involvement,
         CASE WHEN max(goals_for) IS NOT NULL THEN coalesce(sum(points), 0) END AS points,
         CASE WHEN max(goals_for) IS NOT NULL THEN CASE WHEN max(goals_against) = 0 THEN 1.0 ELSE 0.0 END END::DOUBLE AS clean_event
  FROM play GROUP BY season, side, event)"""


@query("side_frame", with_sql(PLAY_SQL) + SIDES_SQL + """
SELECT season, side, event, period, goals_for, goals_against, involvement, points, clean_event FROM sides""")
def side_frame(spark, sf):
    return f.side_frame(play_panel(spark, sf), PLAY, SIDE_STATS, "goals_for", "goals_against").drop("ts")


PLAN = f.FeaturePlan(
    outcomes=("minutes", "starts", "points", "goals", "involvement"), target="points", side_stats=SIDE_STATS,
    static=("period", "difficulty", "value"), role_flags={"first_choice": "is_first_choice"},
    banned=("xp",), windows=(3, 5),
)


def _inc(col, size, keys="season, entity"):
    rows = f"{size - 1} PRECEDING" if size else "UNBOUNDED PRECEDING"
    return f"avg({col}) OVER (PARTITION BY {keys} ORDER BY period, ts, event ROWS BETWEEN {rows} AND CURRENT ROW)"


def _stage(prefix: str, source: str, keys: str, exprs: dict[str, str]) -> str:
    inc = ", ".join(f"{e} AS {n}" for n, e in exprs.items())
    close = ", ".join(f"last({n} ORDER BY ts, event) FILTER (WHERE {n} IS NOT NULL) AS {n}" for n in exprs)
    lag = ", ".join(f"lag({n}) OVER (PARTITION BY {keys} ORDER BY period) AS {n}" for n in exprs)
    return f""",
{prefix}_inc AS (SELECT {keys}, period, ts, event, {inc} FROM {source}),
{prefix}_per AS (SELECT {keys}, period, {close} FROM {prefix}_inc GROUP BY {keys}, period),
{prefix}_lag AS (SELECT {keys}, period, {lag} FROM {prefix}_per)"""


def _sum(e):
    return f"sum({e}) OVER (PARTITION BY season, entity ORDER BY period, ts, event ROWS UNBOUNDED PRECEDING)"


def _lag(c, n):
    return f"lag({c}, {n - 1}) OVER (PARTITION BY season, entity ORDER BY period, ts, event)"


ENTITY = {f"{c}_r{k}": _inc(c, k) for k in (3, 5) for c in PLAN.outcomes} | {
    f"{c}_todate": _inc(c, None) for c in ("points", "goals", "involvement")} | {
    "s_min": _sum("minutes"), "s_pts": _sum("points"), "s_inv": _sum("involvement"), "s_sta": _sum("starts"),
    "s_app": _sum("CASE WHEN minutes > 0 THEN 1.0 ELSE 0.0 END"),
    "minutes_lag1": _lag("minutes", 1), "started_lag1": _lag("starts", 1), "points_lag1": _lag("points", 1),
    "minutes_lag2": _lag("minutes", 2)}
SIDE_COLS = ("goals_for", "goals_against", "involvement", "points", "clean_event")
SIDE = {f"{c}_r{k}": _inc(c, k, "season, side") for k in (3, 5) for c in SIDE_COLS} | {
    f"{c}_todate": _inc(c, None, "season, side") for c in SIDE_COLS}

PLAIN = [n for n in ENTITY if not n.startswith("s_")]
FEATURE_SQL = with_sql(PLAY_SQL) + SIDES_SQL + _stage("e", "play", "season, entity", ENTITY) + _stage(
    "t", "sides", "season, side", SIDE) + """,
form AS (SELECT season, side, event, """ + ", ".join(f"t_lag.{n}" for n in SIDE) + """
         FROM sides JOIN t_lag USING (season, side, period)),
n AS (SELECT season, side, period, CAST(count(DISTINCT event) AS DOUBLE) AS side_events FROM play GROUP BY ALL)
SELECT p.season, p.entity, p.event, p.period, p.difficulty, p.value,
  round(epoch(p.ts - lag(p.ts) OVER (PARTITION BY p.season, p.entity ORDER BY p.period, p.ts, p.event)) / 86400.0, 4) AS days_rest,
  n.side_events, CASE WHEN n.side_events > 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS is_double,
  CASE WHEN p.is_home THEN 1.0 ELSE 0.0 END::DOUBLE AS home_flag, p.first_choice,
  CASE WHEN p.first_choice = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS is_first_choice,
  """ + ", ".join(f"round(CAST(e_lag.{n} AS DOUBLE), 4) AS {n}" for n in PLAIN) + """,
  round(CASE WHEN s_min <> 0 THEN s_pts / (s_min / 90.0) END, 4) AS points_per_90_todate,
  round(CASE WHEN s_min <> 0 THEN s_inv / (s_min / 90.0) END, 4) AS involvement_per_90_todate,
  round(CAST(s_min AS DOUBLE), 4) AS minutes_todate, round(CAST(s_app AS DOUBLE), 4) AS appearances_todate,
  round(CAST(s_sta AS DOUBLE), 4) AS starts_todate,
  round(CASE WHEN s_app <> 0 THEN s_sta / s_app END, 4) AS start_rate_todate,
  """ + ", ".join(f"round(own.{n}, 4) AS side_form_{n}, round(opp.{n}, 4) AS opp_form_{n}" for n in SIDE) + """
FROM play p JOIN e_lag USING (season, entity, period) JOIN n ON n.season = p.season AND n.side = p.side AND n.period = p.period
LEFT JOIN form own ON own.season = p.season AND own.side = p.side AND own.event = p.event
LEFT JOIN form opp ON opp.season = p.season AND opp.side = p.opponent AND opp.event = p.event"""


def rounded(df, keys, names, digits=4):
    types = dict(df.dtypes)
    return df.select(*keys, *[(F.round(n, digits).alias(n) if types[n] == "double" else F.col(n)) for n in names])


@query("build_features", FEATURE_SQL)
def build_features(spark, sf):
    out = f.build_features(play_panel(spark, sf), PLAY, PLAN)
    return rounded(out.df, ["season", "entity", "event"], out.columns)


@query("build_features_collapsed", FEATURE_SQL)
def build_features_collapsed(spark, sf):
    out = f.build_features(play_panel(spark, sf), PLAY, f.with_strategy(PLAN, "collapse"))
    return rounded(out.df, ["season", "entity", "event"], out.columns)


FLAG_SQL = with_sql(PLAY_SQL) + SIDES_SQL + _stage("e", "play", "season, entity", {
    "points_r3": _inc("points", 3), "points_sum": _sum("points")}) + _stage(
    "t", "sides", "season, side", {"points_r3": _inc("points", 3, "season, side")}) + """,
form AS (SELECT season, side, event, t_lag.points_r3 FROM sides JOIN t_lag USING (season, side, period))
SELECT p.season, p.entity, p.event, round(e_lag.points_r3, 4) AS points_r3, round(e_lag.points_sum, 4) AS points_sum,
       round(own.points_r3, 4) AS side_form_points_r3, round(opp.points_r3, 4) AS opp_form_points_r3
FROM play p JOIN e_lag USING (season, entity, period)
LEFT JOIN form own ON own.season = p.season AND own.side = p.side AND own.event = p.event
LEFT JOIN form opp ON opp.season = p.season AND opp.side = p.opponent AND opp.event = p.event"""


@query("flagship_entity_and_side_form", FLAG_SQL)
def flagship(spark, sf):
    panel = play_panel(spark, sf)
    df = w.attach_lagged(panel, PLAY, [w.rolling("points", 3), w.expanding("points", "sum", name="points_sum")])
    sides = f.side_frame(panel, PLAY, {"points": ("total", "points")}, "goals_for")
    form = w.attach_lagged(sides, PLAY.for_side(), [w.rolling("points", 3, name="side_form_points_r3")])
    form = form.select("season", "side", "event", "side_form_points_r3")
    out, opp = f.join_form(df, form, ["side_form_points_r3"], PLAY)
    return rounded(out, ["season", "entity", "event"], ["points_r3", "points_sum", "side_form_points_r3", *opp])


DERIVED_SQL = with_sql(PLAY_SQL) + _stage("e", "play", "season, entity", {k: v for k, v in ENTITY.items() if k.startswith("s_")}) + """
SELECT p.season, p.entity, p.event, round(CASE WHEN s_min <> 0 THEN s_pts / (s_min / 90.0) END, 4) AS points_per_90_todate,
  round(CASE WHEN s_min <> 0 THEN s_inv / (s_min / 90.0) END, 4) AS involvement_per_90_todate,
  CAST(s_min AS DOUBLE) AS minutes_todate, CAST(s_app AS DOUBLE) AS appearances_todate, CAST(s_sta AS DOUBLE) AS starts_todate,
  round(CASE WHEN s_app <> 0 THEN s_sta / s_app END, 4) AS start_rate_todate
FROM play p JOIN e_lag USING (season, entity, period)"""


@query("derived_rates", DERIVED_SQL)
def derived_rates(spark, sf):
    panel = play_panel(spark, sf).withColumn("__appeared", F.coalesce((F.col("minutes") > 0).cast("double"), F.lit(0.0)))
    sums = [x for x in f.derived_lags(PLAN, "__appeared") if x.kind == "expanding"]
    out = w.attach_lagged(panel, PLAY, sums).withColumns(f.derived_columns(PLAN, "__appeared"))
    return rounded(out, ["season", "entity", "event"], list(f.derived_columns(PLAN, "__appeared")))


@query("role_flags", with_sql(PLAY_SQL) + """
SELECT season, entity, event, CASE WHEN first_choice = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS is_first_choice FROM play""")
def role_flags(spark, sf):
    return play_panel(spark, sf).select("season", "entity", "event", f.role_flag("first_choice").alias("is_first_choice"))
