"""Queries for metrics, baselines, walk-forward evaluation and multipliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.operators import evaluate as e, metrics as m, multipliers as mp, panel as pn, windows as w
from panelcast.plans.features_queries import _inc, _stage, _sum
from panelcast.plans.panels import (
    LOG_SQL, PLAY, PLAY_SQL, POSITION_SQL, log_panel, play_panel, position_of, with_sql,
)
from panelcast.plans.registry import query, table
from panelcast.session import materialise


def rnd(df, names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


# Average ranks and their correlation, per group: the definition of the rank correlation.
def rho_sql(source: str, by: str, a: str, p: str, name: str, least: int = 3) -> str:
    return f"""
{name}_r AS (SELECT {by}, rank() OVER (PARTITION BY {by} ORDER BY {a}) + (count(*) OVER (PARTITION BY {by}, {a}) - 1) / 2.0 AS ra,
              rank() OVER (PARTITION BY {by} ORDER BY {p}) + (count(*) OVER (PARTITION BY {by}, {p}) - 1) / 2.0 AS rp
       FROM {source} WHERE {a} IS NOT NULL AND {p} IS NOT NULL),
{name} AS (SELECT {by}, count(*) AS n, CASE WHEN count(*) >= {least} AND min(ra) < max(ra) AND min(rp) < max(rp)
       THEN corr(ra, rp) END AS rho FROM {name}_r GROUP BY {by})"""


@query("error_metrics", with_sql(LOG_SQL) + """
SELECT season, period, round(avg(abs(actual - expected_points)), 6) AS mae, round(sqrt(avg(pow(actual - expected_points, 2))), 6) AS rmse,
       round(avg(pow(expected_points / 16 - CASE WHEN actual > 5 THEN 1.0 ELSE 0.0 END, 2)), 6) AS brier
FROM log GROUP BY season, period""")
def error_metrics(spark, sf):
    d = log_panel(spark, sf).withColumns({"p": F.col("expected_points") / 16, "hit": (F.col("actual") > 5).cast("double")})
    out = d.groupBy("season", "period").agg(
        m.mae("actual", "expected_points").alias("mae"), m.rmse("actual", "expected_points").alias("rmse"), m.brier("p", "hit").alias("brier"))
    return rnd(out, ["mae", "rmse", "brier"])


SPEARMAN = with_sql(LOG_SQL, rho_sql("log", "season, period", "actual", "expected_points", "o")) + """
SELECT season, period, n, round(rho, 6) AS rho FROM o"""


@query("spearman", SPEARMAN)
def spearman(spark, sf):
    return rnd(m.spearman(log_panel(spark, sf), ["season", "period"], "actual", "expected_points"), ["rho"])


@query("spearman_bucketed", SPEARMAN)
def spearman_bucketed(spark, sf):
    return rnd(m.spearman(log_panel(spark, sf), ["season", "period"], "actual", "expected_points", strategy="buckets"), ["rho"])


@query("spearman_constant_is_null", with_sql(LOG_SQL) + """
SELECT season, period, count(*) AS n, CAST(NULL AS DOUBLE) AS rho FROM log GROUP BY ALL""")
def spearman_constant(spark, sf):
    d = log_panel(spark, sf).withColumn("flat", F.lit(1.0))
    return m.spearman(d, ["season", "period"], "actual", "flat")


@query("spearman_by_position", with_sql(LOG_SQL, rho_sql("log", "season, period, position", "actual", "expected_points", "c")) + """
SELECT season, period, round(sum(rho * n) / sum(CASE WHEN rho IS NOT NULL THEN n END), 6) AS rho_by_position FROM c GROUP BY season, period""")
def spearman_by_position(spark, sf):
    return rnd(m.spearman_by_position(log_panel(spark, sf), ["season", "period"], "position", "actual", "expected_points"), ["rho_by_position"])


@query("spearman_by_position_unweighted", with_sql(LOG_SQL, rho_sql("log", "season, period, position", "actual", "expected_points", "c", 10)) + """
SELECT season, period, round(avg(rho), 6) AS rho_by_position FROM c GROUP BY season, period""")
def spearman_by_position_unweighted(spark, sf):
    return rnd(m.spearman_by_position_unweighted(log_panel(spark, sf), ["season", "period"], "expected_points", "actual"), ["rho_by_position"])


BASE_STAGE = _stage("e", "play", "season, entity", {
    "points_r3": _inc("points", 3), "minutes_r3": _inc("minutes", 3), "points_todate": _inc("points", None),
    "s_pts": _sum("points"), "s_min": _sum("minutes")})
PREDS_SQL = PLAY_SQL + BASE_STAGE + """,
base AS (SELECT p.*, e_lag.points_r3, e_lag.minutes_r3, e_lag.points_todate,
                CASE WHEN s_min <> 0 THEN s_pts / (s_min / 90.0) END AS pp90
         FROM play p JOIN e_lag USING (season, entity, period) WHERE p.period > 4 AND p.points IS NOT NULL),
preds AS (
  SELECT 'last3_mean' AS model, season, period, entity, event, position, minutes_r3, coalesce(points_r3, 0) AS prediction, points AS actual FROM base
  UNION ALL SELECT 'external', season, period, entity, event, position, minutes_r3, xp, points FROM base
  UNION ALL SELECT 'season_mean', season, period, entity, event, position, minutes_r3, coalesce(points_todate, 0), points FROM base
  UNION ALL SELECT 'minutes_x_pp90', season, period, entity, event, position, minutes_r3,
    greatest(0, least(90, coalesce(minutes_r3, 0))) / 90.0 * coalesce(pp90, 0), points FROM base)"""
KEEP = ["season", "period", "entity", "event", "position", "minutes_r3"]


def baseline_predictions(spark, sf):
    lags = [w.rolling("points", 3), w.rolling("minutes", 3), w.expanding("points"),
            w.expanding("points", "sum", name="s_pts"), w.expanding("minutes", "sum", name="s_min")]
    d = w.attach_lagged(play_panel(spark, sf), PLAY, lags)
    d = d.withColumn("points_per_90_todate", F.try_divide("s_pts", F.col("s_min") / 90.0))
    return e.walk_forward(d, PLAY, "points", KEEP, closed_form=e.baselines("points", "minutes", "xp"))


@query("baseline_walk_forward", "WITH " + PREDS_SQL + """
SELECT model, season, period, entity, event, position, round(minutes_r3, 4) AS minutes_r3, round(CAST(prediction AS DOUBLE), 4) AS prediction, actual FROM preds""")
def baseline_walk_forward(spark, sf):
    return rnd(baseline_predictions(spark, sf), ["prediction", "minutes_r3"], 4)


GRAIN_SQL = """,
grain AS (SELECT model, season, period, entity, sum(round(prediction, 6)) AS prediction, sum(actual) AS actual, min(position) AS position,
                 count(DISTINCT event) AS events FROM preds WHERE prediction IS NOT NULL{0} GROUP BY model, season, period, entity)"""
SCORES_SQL = """,
err AS (SELECT model, season, period, count(*) AS n, avg(abs(actual - prediction)) AS mae, sqrt(avg(pow(actual - prediction, 2))) AS rmse FROM grain GROUP BY ALL),""" + \
    rho_sql("grain", "model, season, period", "actual", "prediction", "o") + "," + \
    rho_sql("grain", "model, season, period, position", "actual", "prediction", "c") + """,
w AS (SELECT model, season, period, sum(rho * n) / sum(CASE WHEN rho IS NOT NULL THEN n END) AS spearman_by_position FROM c GROUP BY model, season, period),
scores AS (SELECT model, season, period, err.n, mae, rmse, o.rho AS spearman_overall, spearman_by_position
           FROM err JOIN o USING (model, season, period) JOIN w USING (model, season, period))"""
SUMMARY_SQL = """
SELECT model, count(*) AS periods, count(spearman_by_position) AS ranked_periods, CAST(sum(n) AS BIGINT) AS rows, round(sum(mae * n) / sum(n), 5) AS mae,
       round(sum(rmse * n) / sum(n), 5) AS rmse, round(avg(spearman_overall), 5) AS spearman_overall,
       round(avg(spearman_by_position), 5) AS spearman_by_position FROM scores GROUP BY model"""
METRICS = ["mae", "rmse", "spearman_overall", "spearman_by_position"]


def steady(d):
    """Predictions to six places, so equal forecasts tie in both engines."""
    return d.withColumn("prediction", F.round("prediction", 6))


@query("period_grain", "WITH " + PREDS_SQL + GRAIN_SQL.format("") + """
SELECT model, season, period, entity, round(prediction, 4) AS prediction, actual, position, events FROM grain""")
def period_grain(spark, sf):
    d = steady(baseline_predictions(spark, sf)).where(F.col("prediction").isNotNull())
    return rnd(m.to_period_grain(d, ["model", "season", "period", "entity"]), ["prediction"], 4)


@query("period_scores", "WITH " + PREDS_SQL + GRAIN_SQL.format("") + SCORES_SQL + """
SELECT model, season, period, n, round(mae, 5) AS mae, round(rmse, 5) AS rmse, round(spearman_overall, 5) AS spearman_overall,
       round(spearman_by_position, 5) AS spearman_by_position FROM scores""")
def period_scores(spark, sf):
    return rnd(m.score_periods(steady(baseline_predictions(spark, sf))), METRICS, 5)


@query("model_summary", "WITH " + PREDS_SQL + GRAIN_SQL.format("") + SCORES_SQL + SUMMARY_SQL)
def model_summary(spark, sf):
    return rnd(m.summarise_models(m.score_periods(steady(baseline_predictions(spark, sf)))), METRICS, 5)


@query("backtest_playing_summary", "WITH " + PREDS_SQL + GRAIN_SQL.format(" AND coalesce(minutes_r3, 0) >= 1") + SCORES_SQL + SUMMARY_SQL)
def backtest_playing_summary(spark, sf):
    return rnd(e.backtest(steady(baseline_predictions(spark, sf)), views=["playing"])["summary_playing"], METRICS, 5)


@query("training_window", with_sql(PLAY_SQL) + """
SELECT season, entity, event FROM play WHERE season < 2000 OR (season = 2000 AND period < 5)""")
def training_window(spark, sf):
    return pn.training_window(play_panel(spark, sf), 2000, 5).select("season", "entity", "event")


@query("playing_filter", with_sql(LOG_SQL) + "SELECT season, period, entity FROM log WHERE coalesce(minutes_r3, 0) >= 1")
def playing_filter(spark, sf):
    return log_panel(spark, sf).where(pn.is_playing()).select("season", "period", "entity")


# -- multipliers -----------------------------------------------------------------------------------

STARTS_SQL = """
lines AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS season, CAST(month(o_orderdate) AS INTEGER) AS period, l_suppkey AS entity,
         l_orderkey * 8 + l_linenumber AS event, """ + POSITION_SQL.format("l_suppkey") + """ AS position,
         (l_orderkey * 7 + l_partkey) % 91 AS minutes, CAST(l_quantity AS BIGINT) % 13 AS points,
         CAST(l_partkey % 5 + 1 AS INTEGER) AS level, CAST((l_partkey % 23) * 31 - 350 + l_suppkey % 7 AS DOUBLE) AS gap
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
st AS (SELECT * EXCLUDE (minutes) FROM lines WHERE minutes >= 60),
ra AS (SELECT *, CASE WHEN count(*) OVER s >= 5 AND avg(points) OVER s > 0 THEN points / avg(points) OVER s END AS ratio
       FROM st WINDOW s AS (PARTITION BY season, entity))"""
SHRINK_SQL = "{cell} * (n / (n + 300.0)) + {every} * (1 - n / (n + 300.0))"


def starts(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    d = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.year("o_orderdate").alias("season"), F.month("o_orderdate").alias("period"), F.col("l_suppkey").alias("entity"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("event"), position_of("l_suppkey").alias("position"),
        F.expr("(l_orderkey * 7 + l_partkey) % 91").alias("minutes"), F.expr("cast(l_quantity as bigint) % 13").alias("points"),
        F.expr("cast(l_partkey % 5 + 1 as int)").alias("level"), F.expr("cast((l_partkey % 23) * 31 - 350 + l_suppkey % 7 as double)").alias("gap"))
    d = pn.starters(d, positions=("GK", "DEF", "MID", "FWD")).drop("minutes")
    return mp.season_ratio(d, ["season", "entity"], "points")


@query("starters", "WITH " + STARTS_SQL + "SELECT season, entity, event, position, points, level, gap FROM st")
def starters(spark, sf):
    return starts(spark, sf).select("season", "entity", "event", "position", "points", "level", "gap")


@query("season_ratio", "WITH " + STARTS_SQL + "SELECT season, entity, event, round(ratio, 6) AS ratio FROM ra")
def season_ratio(spark, sf):
    return rnd(starts(spark, sf).select("season", "entity", "event", "ratio"), ["ratio"])


@query("shrunken_table", "WITH " + STARTS_SQL + """,
lv AS (SELECT level, avg(ratio) AS every FROM ra WHERE ratio IS NOT NULL GROUP BY level),
ce AS (SELECT position, level, avg(ratio) AS cell, count(*) AS n FROM ra WHERE ratio IS NOT NULL GROUP BY position, level)
SELECT position, level, n, round(""" + SHRINK_SQL.format(cell="cell", every="every") + ", 6) AS multiplier FROM ce JOIN lv USING (level)")
def shrunken_table(spark, sf):
    return rnd(mp.fit_table(starts(spark, sf)), ["multiplier"])


LINE_FIT = """,
g AS (SELECT position, ratio, greatest(-300, least(300, gap)) AS g FROM ra WHERE ratio IS NOT NULL AND gap IS NOT NULL),
al AS (SELECT regr_intercept(ratio, g) AS a0, regr_slope(ratio, g) AS b0 FROM g),
po AS (SELECT position, regr_intercept(ratio, g) AS a1, regr_slope(ratio, g) AS b1, count(*) AS n FROM g GROUP BY position),
li AS (SELECT position, n, """ + SHRINK_SQL.format(cell="a1", every="a0") + " AS a, " + SHRINK_SQL.format(cell="b1", every="b0") + """ AS b FROM po CROSS JOIN al)"""


@query("shrunken_lines", "WITH " + STARTS_SQL + LINE_FIT + "SELECT position, n, round(a, 6) AS a, round(b, 8) AS b FROM li")
def shrunken_lines(spark, sf):
    return rnd(rnd(mp.fit_line(starts(spark, sf)), ["a"]), ["b"], 8)


@query("apply_multipliers", "WITH " + STARTS_SQL + LINE_FIT + """,
ov AS (SELECT avg(ratio) AS overall FROM ra)
SELECT season, entity, event, round(coalesce(CASE WHEN entity % 5 <> 0 THEN a + b * greatest(-300, least(300, gap)) END, overall), 6) AS multiplier
FROM ra LEFT JOIN li USING (position) CROSS JOIN ov""")
def apply_multipliers(spark, sf):
    d = starts(spark, sf)
    rows = d.withColumn("gap", F.when(F.col("entity") % 5 != 0, F.col("gap")))
    out = mp.apply_line(rows, mp.fit_line(d), mp.overall_mean(d))
    return rnd(out.select("season", "entity", "event", "multiplier"), ["multiplier"])


PRIOR_SQL = """,
t AS (SELECT r.season, r.period, r.entity, r.event, r.position, r.points, r.level, r.gap, l.lead, r.period - l.lead AS as_of
      FROM ra r CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS lead) l WHERE r.period - l.lead >= 6),
rt AS (SELECT t.season, t.entity, t.as_of, avg(s.points) AS rate FROM (SELECT DISTINCT season, entity, as_of FROM t) t
       JOIN st s ON s.season = t.season AND s.entity = t.entity AND s.period < t.as_of GROUP BY ALL HAVING count(*) >= 3),
tt AS (SELECT t.*, rt.rate FROM t JOIN rt USING (season, entity, as_of))"""


@query("prior_rates_by_lead", "WITH " + STARTS_SQL + PRIOR_SQL + """
SELECT season, entity, event, lead, as_of, round(rate, 6) AS rate FROM tt""")
def prior_rates_by_lead(spark, sf):
    d = starts(spark, sf)
    rates = mp.prior_rates(d, ["season", "entity"], "period", "points")
    out = mp.lead_targets(d, rates, ["season", "entity"], "period", first=6)
    return rnd(out.select("season", "entity", "event", "lead", "as_of", "rate"), ["rate"])


# Multipliers fitted on all earlier seasons, one fit per test season.
FIT_BY_SEASON = """,
test AS (SELECT DISTINCT season AS test_season FROM ra),
tr AS (SELECT test_season, ra.* FROM test JOIN ra ON ra.season < test_season WHERE ratio IS NOT NULL),
ov AS (SELECT test_season AS season, avg(ratio) AS overall FROM tr GROUP BY ALL),
lv AS (SELECT test_season, level, avg(ratio) AS every FROM tr GROUP BY ALL),
ce AS (SELECT test_season, position, level, avg(ratio) AS cell, count(*) AS n FROM tr GROUP BY ALL),
tb AS (SELECT test_season AS season, position, level, """ + SHRINK_SQL.format(cell="cell", every="every") + """ AS m FROM ce JOIN lv USING (test_season, level)),
g AS (SELECT test_season, position, ratio, greatest(-300, least(300, gap)) AS g FROM tr WHERE gap IS NOT NULL),
al AS (SELECT test_season, regr_intercept(ratio, g) AS a0, regr_slope(ratio, g) AS b0 FROM g GROUP BY ALL),
po AS (SELECT test_season, position, regr_intercept(ratio, g) AS a1, regr_slope(ratio, g) AS b1, count(*) AS n FROM g GROUP BY ALL),
li AS (SELECT test_season AS season, position, """ + SHRINK_SQL.format(cell="a1", every="a0") + " AS a, " + SHRINK_SQL.format(cell="b1", every="b0") + """ AS b
       FROM po JOIN al USING (test_season)),
lp AS (SELECT tt.*, rate * overall AS pred_none, rate * coalesce(m, overall) AS pred_table,
              rate * coalesce(a + b * greatest(-300, least(300, gap)), overall) AS pred_line
       FROM tt JOIN ov USING (season) LEFT JOIN tb USING (season, position, level) LEFT JOIN li USING (season, position))"""


def _draw_sql(rounds: int = 3) -> str:
    """The draw of a slot, as the library makes it."""
    x = "(7 * 1299709 + d * 7919 + i * 104729 + 12345) % 2147483648"
    for _ in range(rounds):
        step = f"((({x}) * 1103515245 + 12345) % 2147483648)"
        x = f"xor({step}, {step} >> 15)"
    return x


DRAW_SQL = _draw_sql()

# Starts between nations whose ratings move day by day: a fit sees the gap at the row's own deadline, a target the one at its as-of.
RATED_SQL = STARTS_SQL.replace("AS DOUBLE) AS gap", "AS DOUBLE) AS gap0, s_nationkey AS side, c_nationkey AS opponent, l_partkey % 2 = 0 AS is_home").replace(
    "ON l_orderkey = o_orderkey)", "ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey)").replace(
    "st AS (", """dl AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS season, CAST(month(o_orderdate) AS INTEGER) AS period, CAST(min(o_orderdate) AS DATE) AS deadline
       FROM orders GROUP BY ALL),
hist AS (SELECT c_nationkey AS side, CAST(o_orderdate AS DATE) AS valid_from, CAST(1400 + sum(o_orderkey) % 401 AS DOUBLE) AS rating
         FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
si AS (SELECT DISTINCT side FROM hist),
kn AS (SELECT a.season, a.period AS as_of, a.side, h.rating FROM (SELECT * FROM dl, si) a ASOF LEFT JOIN hist h ON a.side = h.side AND a.deadline > h.valid_from),
st AS (""").replace("SELECT * EXCLUDE (minutes) FROM lines WHERE minutes >= 60", """SELECT l.* EXCLUDE (minutes, gap0), a.rating - b.rating + CASE WHEN is_home THEN 45 ELSE -45 END AS gap FROM lines l
       LEFT JOIN kn a ON a.season = l.season AND a.as_of = l.period AND a.side = l.side
       LEFT JOIN kn b ON b.season = l.season AND b.as_of = l.period AND b.side = l.opponent WHERE minutes >= 60""")
RATED_PRIOR_SQL = PRIOR_SQL.replace("r.level, r.gap,", "r.level, r.gap, r.side, r.opponent, r.is_home,").replace("SELECT t.*, rt.rate FROM t JOIN rt USING (season, entity, as_of)", """
  SELECT t.*, rt.rate, a.rating - b.rating + CASE WHEN is_home THEN 45 ELSE -45 END AS gap_then FROM t JOIN rt USING (season, entity, as_of)
  JOIN dl ON dl.season = t.season AND dl.period = t.as_of LEFT JOIN kn a ON a.season = t.season AND a.as_of = t.as_of AND a.side = t.side
  LEFT JOIN kn b ON b.season = t.season AND b.as_of = t.as_of AND b.side = t.opponent""")
LEAD_SQL = "WITH " + RATED_SQL + RATED_PRIOR_SQL + FIT_BY_SEASON.replace("rate * coalesce(a + b * greatest(-300, least(300, gap)), overall) AS pred_line",
                                                                         "rate * coalesce(a + b * CASE WHEN gap_then IS NOT NULL THEN greatest(-300, least(300, gap_then)) END, overall) AS pred_line")


def rating_days(spark, sf):
    """Ratings by nation and day, and the first day of every period. Both are few rows and read more than once, so they are written."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    nations = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    history = orders.join(nations, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("side"), F.to_date("o_orderdate").alias("valid_from")).agg(
        (1400 + F.sum("o_orderkey") % 401).cast("double").alias("rating"))
    days = orders.groupBy(F.year("o_orderdate").alias("season"), F.month("o_orderdate").alias("period")).agg(F.to_date(F.min("o_orderdate")).alias("deadline"))
    return materialise(history, "history"), materialise(days, "days")


def rated_starts(spark, sf, known=None):
    """The starts with both sides and the rating gap at their own period's deadline; `known` takes `rating_days` made before.

    Gaps, means and rows all read the joined lines, so these are written once.
    """
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_custkey")
    nations, makers = table(spark, sf, "customer").select("c_custkey", "c_nationkey"), table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    orders = orders.join(nations, F.col("o_custkey") == F.col("c_custkey"))
    d = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(makers, F.col("l_suppkey") == F.col("s_suppkey"))
    d = d.select(
        F.year("o_orderdate").alias("season"), F.month("o_orderdate").alias("period"), F.col("l_suppkey").alias("entity"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("event"), position_of("l_suppkey").alias("position"),
        F.expr("(l_orderkey * 7 + l_partkey) % 91").alias("minutes"), F.expr("cast(l_quantity as bigint) % 13").alias("points"),
        F.expr("cast(l_partkey % 5 + 1 as int)").alias("level"), F.col("s_nationkey").alias("side"), F.col("c_nationkey").alias("opponent"), F.expr("l_partkey % 2 = 0").alias("is_home"))
    d = materialise(pn.starters(d, positions=("GK", "DEF", "MID", "FWD")).drop("minutes"), "played")
    history, days = known or rating_days(spark, sf)
    d = mp.with_gap_then(d, history, days, as_of="period", period="period", name="gap")
    return mp.season_ratio(d, ["season", "entity"], "points")


def lead_predictions(spark, sf):
    from panelcast.plans.lead_time import lead_time_predictions

    history, days = rating_days(spark, sf)
    return lead_time_predictions(rated_starts(spark, sf, (history, days)), "points", first=6, ratings=history, deadlines=days)


@query("lead_time_predictions", LEAD_SQL + """
SELECT season, entity, event, lead, as_of, gap_then, round(pred_none, 5) AS pred_none, round(pred_table, 5) AS pred_table, round(pred_line, 5) AS pred_line FROM lp""")
def lead_time_predictions(spark, sf):
    cols = ["pred_none", "pred_table", "pred_line"]
    return rnd(lead_predictions(spark, sf).select("season", "entity", "event", "lead", "as_of", "gap_then", *cols), cols, 5)


_KINDS = {"none": "pred_none", "table": "pred_table", "line": "pred_line"}
LEAD_SUMMARY = LEAD_SQL + ",\nlq AS (SELECT * REPLACE (round(pred_none, 9) AS pred_none, round(pred_table, 9) AS pred_table, round(pred_line, 9) AS pred_line) FROM lp)," + ",".join(
    rho_sql("lq", "season, lead, as_of, position", "points", f"pred_{k}", f"c{k}", 10) + f""",
x{k} AS (SELECT season, lead, as_of, avg(rho) AS r FROM c{k} GROUP BY ALL), y{k} AS (SELECT season, lead, avg(r) AS rank_{k} FROM x{k} GROUP BY ALL)"""
    for k in _KINDS) + """,
z AS (SELECT season, lead, count(*) AS starts, """ + ", ".join(
    f"avg(pow(pred_{k} - points, 2)) AS mse_{k}, avg(abs(pred_{k} - points)) AS mae_{k}" for k in _KINDS) + """ FROM lq GROUP BY ALL),
bb AS (SELECT season, lead, as_of, sum(pow(pred_line - points, 2) - pow(pred_table - points, 2)) AS s, count(*) AS n FROM lq GROUP BY ALL),
bq AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY season, lead) AS k FROM bb WINDOW w AS (PARTITION BY season, lead ORDER BY as_of)),
bd AS (SELECT season, lead, d, k, """ + DRAW_SQL + """ AS x
       FROM bq CROSS JOIN (SELECT unnest(range(2000)) AS d) r),
bm AS (SELECT bd.season, bd.lead, bd.d, sum(bq.s) / sum(bq.n) AS m FROM bd JOIN bq ON bq.season = bd.season AND bq.lead = bd.lead AND bq.i = (bd.x // 64) % bd.k GROUP BY ALL),
bi AS (SELECT season, lead, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM bm GROUP BY ALL),
be AS (SELECT season, lead, sum(s) / sum(n) AS apart FROM bb GROUP BY ALL)
SELECT season, lead, starts, """ + ", ".join(f"round({s}_{k}, 5) AS {s}_{k}" for k in _KINDS for s in ("mse", "mae", "rank")) + """,
  round(apart, 5) AS line_minus_table_mse, round(ci_low, 5) AS ci_low, round(ci_high, 5) AS ci_high
FROM z JOIN ynone USING (season, lead) JOIN ytable USING (season, lead) JOIN yline USING (season, lead) JOIN bi USING (season, lead) JOIN be USING (season, lead)"""


@query("lead_time_summary", LEAD_SUMMARY)
def lead_time_summary(spark, sf):
    d = lead_predictions(spark, sf)
    d = rnd(d, list(_KINDS.values()), 9)  # equal predictions must rank as equal, and no later rounding may meet a half
    out = mp.summarise_leads(d, _KINDS, "points", paired=("line", "table"))
    return rnd(out, [c for c in out.columns if c not in ("season", "lead", "starts")], 5)


BOOT_SQL = with_sql(LOG_SQL) + """,
b AS (SELECT season, period, sum(actual - expected_points) AS s, count(*) AS n FROM log GROUP BY ALL),
q AS (SELECT season, period, s, n, row_number() OVER (PARTITION BY season ORDER BY period) - 1 AS i, count(*) OVER (PARTITION BY season) AS k FROM b),
d AS (SELECT season, d, i AS slot, k,
             """ + DRAW_SQL + """ AS x
      FROM q CROSS JOIN (SELECT unnest(range(2000)) AS d) r),
m AS (SELECT d.season, d.d, sum(q.s) / sum(q.n) AS m FROM d JOIN q ON q.season = d.season AND q.i = (d.x // 64) % d.k GROUP BY ALL)
SELECT season, round(e.est, 6) AS estimate, round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high
FROM m JOIN (SELECT season, sum(s) / sum(n) AS est FROM b GROUP BY season) e USING (season) GROUP BY season, e.est"""


@query("block_bootstrap", BOOT_SQL)
def block_bootstrap(spark, sf):
    d = log_panel(spark, sf).withColumn("d", F.col("actual") - F.col("expected_points"))
    return rnd(mp.block_bootstrap(d, ["season"], "period", "d"), ["estimate", "ci_low", "ci_high"])


@query("tier_cut_points", "WITH " + RATED_SQL + """,
me AS (SELECT level, gap FROM st WHERE gap IS NOT NULL QUALIFY row_number() OVER (PARTITION BY season, period, side, opponent ORDER BY event, entity, level, gap) = 1),
sh AS (SELECT level, sum(count(*)) OVER (ORDER BY level) / sum(count(*)) OVER () AS share FROM me GROUP BY level),
al AS (SELECT list(gap ORDER BY gap) AS g FROM me),
ps AS (SELECT level, g, (1 - share) * (len(g) - 1) AS pos FROM sh CROSS JOIN al WHERE level < (SELECT max(level) FROM sh))
SELECT level, CAST(round(g[CAST(floor(pos) AS BIGINT) + 1] + (g[CAST(ceil(pos) AS BIGINT) + 1] - g[CAST(floor(pos) AS BIGINT) + 1]) * (pos - floor(pos))) AS BIGINT) AS cut FROM ps""")
def tier_cut_points(spark, sf):
    """One row per meeting of two sides in a period, as the share of levels and the quantiles of gaps ask for."""
    return mp.tier_cuts(rated_starts(spark, sf), "level", "gap", ["season", "period", "side", "opponent"], ["event", "entity", "level", "gap"])


@query("side_ticker", "WITH " + PLAY_SQL.strip() + "," + RATED_SQL + FIT_BY_SEASON.split(",\nlp AS")[0] + """,
ma AS (SELECT DISTINCT season, period, event, CASE WHEN is_home THEN side ELSE opponent END AS home, CASE WHEN is_home THEN opponent ELSE side END AS away FROM play),
sd AS (SELECT season, period, home AS side, away AS opponent, TRUE AS is_home FROM ma UNION ALL SELECT season, period, away, home, FALSE FROM ma),
tk AS (SELECT sd.season, sd.period - l.lead AS as_of, sd.side, sd.opponent, sd.is_home FROM sd, (SELECT unnest([0, 1, 2, 3, 4]) AS lead) l),
gt AS (SELECT tk.season, tk.as_of, tk.side, greatest(-300, least(300, a.rating - b.rating + CASE WHEN is_home THEN 45 ELSE -45 END)) AS gap, a.rating - b.rating AS known
       FROM tk JOIN dl ON dl.season = tk.season AND dl.period = tk.as_of
       LEFT JOIN kn a ON a.season = tk.season AND a.as_of = tk.as_of AND a.side = tk.side LEFT JOIN kn b ON b.season = tk.season AND b.as_of = tk.as_of AND b.side = tk.opponent)
SELECT season, as_of, side, position, round(sum(CASE WHEN known IS NOT NULL THEN coalesce(a + b * gap, overall) ELSE overall END), 4) AS kindness, count(*) AS events
FROM gt JOIN ov USING (season) JOIN li USING (season) GROUP BY ALL""")
def side_ticker(spark, sf):
    """Lines fitted on all earlier seasons, applied to the next five periods as seen from every period."""
    home, away = F.when(F.col("is_home"), F.col("side")).otherwise(F.col("opponent")), F.when(F.col("is_home"), F.col("opponent")).otherwise(F.col("side"))
    ev = play_panel(spark, sf).select("season", "period", "event", home.alias("home"), away.alias("away")).distinct()
    history, days = rating_days(spark, sf)
    out = mp.fitted_ticker(ev, mp.moments(rated_starts(spark, sf, (history, days)), ["season"]).earlier(), history, days)
    return rnd(out, ["kindness"], 4)
