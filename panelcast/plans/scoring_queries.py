"""Queries for the rulebook, composition and the predicted-against-actual reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.functions import scoring as s
from panelcast.operators import review as r, squads as sq, windows as w
from panelcast.plans.panels import (
    EV_SQL, LINE_SQL, LOG_SQL, ORD, ORD_SQL, PLAY_SQL, ev_panel, line_panel, log_panel, ord_panel, play_panel, with_sql,
)
from panelcast.plans.metrics_queries import rho_sql, rnd
from panelcast.plans.registry import query, table
from panelcast.session import materialise

LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
KEYS_SQL = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
MAP_SQL = "CASE position WHEN 'GK' THEN {0} WHEN 'DEF' THEN {1} WHEN 'MID' THEN {2} WHEN 'FWD' THEN {3} ELSE 0 END"
PARTS_SQL = {
    "appearance": "CASE WHEN minutes >= 60 THEN 2 WHEN minutes > 0 THEN 1 ELSE 0 END",
    "clean": f"CASE WHEN clean_sheet AND minutes >= 60 THEN {MAP_SQL.format(4, 4, 1, 0)} ELSE 0 END",
    "conceded": "CASE WHEN position IN ('GK', 'DEF') THEN -(goals_conceded // 2) ELSE 0 END",
    "save": "saves // 3",
    "actions": f"CASE WHEN defensive_contribution >= {MAP_SQL.format(12, 10, 12, 12)} THEN 2 ELSE 0 END",
}
SCORE_SQL = f"""CASE WHEN minutes > 0 THEN {PARTS_SQL['appearance']} + goals_scored * {MAP_SQL.format(6, 6, 5, 4)} + 3 * assists
  + {PARTS_SQL['clean']} + {PARTS_SQL['conceded']} + {PARTS_SQL['save']} + 5 * penalties_saved - 2 * penalties_missed
  + {PARTS_SQL['actions']} - yellow_cards - 3 * red_cards - 2 * own_goals + bonus ELSE 0 END"""


@query("scoring_parts", with_sql(LINE_SQL) + f"SELECT {KEYS_SQL}, " + ", ".join(
    f"CAST({e} AS BIGINT) AS {n}" for n, e in PARTS_SQL.items()) + " FROM line")
def scoring_parts(spark, sf):
    d = line_panel(spark, sf)
    p, mi = F.col("position"), F.col("minutes")
    parts = {
        "appearance": s.appearance_points(mi), "clean": s.clean_sheet_points(p, mi, F.col("clean_sheet")),
        "conceded": s.goals_conceded_points(p, F.col("goals_conceded")), "save": s.saves_points(F.col("saves")),
        "actions": s.actions_points(p, F.col("defensive_contribution")),
    }
    return d.select(*LINE_KEYS, *[c.cast("bigint").alias(n) for n, c in parts.items()])


@query("stat_line_score", with_sql(LINE_SQL) + f"SELECT {KEYS_SQL}, CAST({SCORE_SQL} AS BIGINT) AS score FROM line")
def stat_line_score(spark, sf):
    d = line_panel(spark, sf)
    names = ["position", "minutes", "goals_scored", "assists", "clean_sheet", "goals_conceded", "saves", "penalties_saved",
             "penalties_missed", "defensive_contribution", "yellow_cards", "red_cards", "own_goals", "bonus"]
    return d.select(*LINE_KEYS, s.score({n: F.col(n) for n in names}).alias("score"))


@query("poisson_step", with_sql(LINE_SQL) + f"""
SELECT {KEYS_SQL}, round(list_sum(list_transform(range(1, 25), lambda k: (k // 2) * exp(-r) * pow(r, k) / factorial(CAST(k AS INTEGER)))), 8) AS conceded,
       round(list_sum(list_transform(range(1, 25), lambda k: (k // 3) * exp(-r) * pow(r, k) / factorial(CAST(k AS INTEGER)))), 8) AS saved
FROM (SELECT *, greatest((goals_conceded + 1) / 2.0::DOUBLE - 0.5, 1e-9) AS r FROM line)""")
def poisson_step(spark, sf):
    rate = (F.col("goals_conceded") + 1) / 2.0 - 0.5
    return line_panel(spark, sf).select(
        *LINE_KEYS, F.round(s.poisson_step(rate, 2), 8).alias("conceded"), F.round(s.poisson_step(rate, 3), 8).alias("saved"))


@query("availability_and_reconciliation", with_sql(LINE_SQL) + f"""
SELECT {KEYS_SQL}, round(least(p, coalesce(greatest(0, least(1, flag / 100.0)), 1))::DOUBLE, 6) AS p_play,
       round(least(least(q, p), coalesce(greatest(0, least(1, flag / 100.0)), 1))::DOUBLE, 6) AS p_60
FROM (SELECT *, minutes / 90.0::DOUBLE AS p, saves / 8.0::DOUBLE AS q,
             CASE WHEN l_linenumber % 3 <> 0 THEN (l_partkey % 6) * 25.0::DOUBLE END AS flag FROM line)""")
def availability(spark, sf):
    d = line_panel(spark, sf)
    flag = F.when(F.col("l_linenumber") % 3 != 0, (F.col("l_partkey") % 6) * 25.0)
    p, q = F.col("minutes") / 90.0, F.col("saves") / 8.0
    return d.select(
        *LINE_KEYS, F.round(s.availability_ceiling(p, flag), 6).alias("p_play"),
        F.round(s.availability_ceiling(s.reconcile(q, p), flag), 6).alias("p_60"))


COMBINE_IN = {"p_play": "(minutes + 1) / 92e0", "p_60": "saves / 9e0", "expected_goals": "goals_scored / 4e0",
              "expected_assists": "assists / 8e0", "p_clean_sheet": "(goals_conceded % 4) / 4e0", "conceded_penalty": "goals_conceded / 4e0",
              "expected_save_points": "(saves % 5) / 8e0", "p_defcon": "(defensive_contribution % 8) / 8e0", "expected_bonus": "bonus / 4e0"}


@query("combine_terms", with_sql(LINE_SQL) + f""",
f AS (SELECT {KEYS_SQL}, position, {", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in COMBINE_IN.items())} FROM line),
c AS (SELECT position, avg(yellow_cards) AS y, avg(red_cards) AS r FROM line WHERE minutes > 0 GROUP BY position),
t AS (SELECT f.*, p_play + p_60 AS appearance, expected_goals * {MAP_SQL.format(6, 6, 5, 4)} AS goals, expected_assists * 3 AS assists,
  p_clean_sheet * p_60 * {MAP_SQL.format(4, 4, 1, 0)} AS clean_sheet, CASE WHEN position IN ('GK', 'DEF') THEN -conceded_penalty * p_60 ELSE 0 END AS goals_conceded,
  expected_save_points AS saves, p_defcon * 2 AS defcon, expected_bonus AS bonus, (-y - 3 * r) * p_play AS cards FROM f JOIN c USING (position))
SELECT {KEYS_SQL}, {", ".join(f"round(CAST({t} AS DOUBLE), 5) AS {t}" for t in s.POINTS_TERMS)},
       round({" + ".join(s.POINTS_TERMS)}, 5) AS expected_points FROM t""")
def combine_terms(spark, sf):
    d = line_panel(spark, sf)
    rates = card_rates(d)
    # a row per position: a join by shuffle would bring all lines of a position to one task
    f = d.join(F.broadcast(rates), "position", "left").select(
        *LINE_KEYS, "position", "yellow", "red", *[F.expr(e).cast("double").alias(n) for n, e in COMBINE_IN.items()])
    terms = s.combine({n: F.col(n) for n in ("position", *COMBINE_IN)}, F.col("yellow"), F.col("red"))
    return f.select(*LINE_KEYS, *[F.round(c, 5).alias(n) for n, c in terms.items()])


def card_rates(d):
    from panelcast.operators.models import card_rates as rates

    return rates(d)


@query("card_base_rates", with_sql(LINE_SQL) + """
SELECT position, round(avg(yellow_cards), 6) AS yellow, round(avg(red_cards), 6) AS red FROM line WHERE minutes > 0 GROUP BY position""")
def card_base_rates(spark, sf):
    return rnd(card_rates(line_panel(spark, sf)), ["yellow", "red"])


def _bit(n, letter):
    return f"CASE WHEN {n} = 1 THEN '{letter}' WHEN {n} <> 0 THEN {n} || '{letter}' END"


@query("stat_line_text", with_sql(LINE_SQL) + f"""
SELECT {KEYS_SQL}, CASE WHEN minutes = 0 THEN 'did not play' ELSE concat_ws(' ', minutes || '''', {_bit('goals_scored', 'G')}, {_bit('assists', 'A')},
  CASE WHEN clean_sheet THEN 'CS' END, CASE WHEN position = 'GK' AND saves >= 3 THEN saves || 'sv' END,
  CASE WHEN defensive_contribution > 10 THEN 'DC' END, CASE WHEN bonus <> 0 THEN bonus || 'b' END, CASE WHEN yellow_cards <> 0 THEN 'YC' END,
  CASE WHEN red_cards <> 0 THEN 'RC' END,
  CASE WHEN o > 0 THEN '+' || o || ' other' WHEN o < 0 THEN o || ' other' END) END AS what
FROM (SELECT *, penalties_missed * -2 + own_goals * 3 AS o FROM line)""")
def stat_line_text(spark, sf):
    cols = {n: F.col(n) for n in ("position", "minutes", "assists", "bonus")}
    cols |= {"goals": F.col("goals_scored"), "saves": F.col("saves"), "yellow": F.col("yellow_cards"), "red": F.col("red_cards"),
             "act_clean_sheet": F.col("clean_sheet").cast("int"), "act_defcon": (F.col("defensive_contribution") > 10).cast("int"),
             "act_other": F.col("penalties_missed") * -2 + F.col("own_goals") * 3}
    return line_panel(spark, sf).select(*LINE_KEYS, s.stat_line_text(cols).alias("what"))


@query("chip_half_keys", """
SELECT o_orderkey, CASE WHEN month(o_orderdate) * 3 <= 19 THEN '1:' ELSE '2:' END || o_orderpriority AS chip FROM orders""")
def chip_half_keys(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", s.chip_key(F.col("o_orderpriority"), F.month("o_orderdate") * 3).alias("chip"))


# -- reports --------------------------------------------------------------------------------------

TERMS = [*s.ACTUAL_TERMS, "total"]


def _pred(t):
    return {"other": "0.0::DOUBLE", "total": "expected_points"}.get(t, t)


def _act(t):
    return "actual" if t == "total" else f"act_{t}"


def calibration_sql(terms, by, keep="TRUE"):
    head = (by + ", ") if by else ""
    group = f" GROUP BY {by}" if by else ""
    parts = " UNION ALL ".join(
        f"SELECT {head}'{t}' AS term, sum({_pred(t)}) AS predicted, sum({_act(t)}) AS actual FROM log{group}" for t in terms)
    return with_sql(LOG_SQL) + f""", u AS ({parts})
SELECT {head}term, predicted, actual, round(CASE WHEN abs(predicted) > 1e-9 THEN actual / predicted END, 6) AS ratio FROM u WHERE {keep}"""


@query("term_calibration", calibration_sql(TERMS, ""))
def term_calibration(spark, sf):
    return rnd(r.calibration(log_panel(spark, sf)), ["ratio"])


@query("term_calibration_by_season", calibration_sql(TERMS, "season"))
def term_calibration_by_season(spark, sf):
    return rnd(r.calibration(log_panel(spark, sf), ["season"]), ["ratio"])


@query("term_calibration_by_position", calibration_sql(r.POSITION_TERMS, "position", "abs(predicted) >= 1e-9 OR abs(actual) >= 1e-9"))
def term_calibration_by_position(spark, sf):
    return rnd(r.calibration_by_position(log_panel(spark, sf)), ["ratio"])


WHO = {"model": "expected_points", "external": "xp_external"}


@query("outcome_buckets", with_sql(LOG_SQL) + """,
p AS (SELECT *, CASE WHEN actual <= 0 THEN '0 or less' WHEN actual BETWEEN 1 AND 2 THEN '1-2' WHEN actual BETWEEN 3 AND 4 THEN '3-4' WHEN actual >= 5 THEN '5+' END AS bucket
      FROM log WHERE coalesce(minutes_r3, 0) >= 1 AND xp_external IS NOT NULL),
b AS (SELECT unnest(['0 or less', '1-2', '3-4', '5+']) AS bucket)
SELECT b.bucket, count(p.actual) AS n, round(avg(actual), 6) AS actual_mean, """ + ", ".join(
    f"round(avg({c}), 6) AS {k}_mean, round(avg(abs({c} - actual)), 6) AS {k}_mae, round(sqrt(avg(pow({c} - actual, 2))), 6) AS {k}_rmse" for k, c in WHO.items()) + """
FROM b LEFT JOIN p USING (bucket) GROUP BY b.bucket""")
def outcome_buckets(spark, sf):
    out = r.outcome_buckets(log_panel(spark, sf), WHO)
    return rnd(out, [c for c in out.columns if c not in ("bucket", "n")])


@query("minutes_bands", with_sql(LOG_SQL) + """,
p AS (SELECT *, CASE WHEN appearance <= 0.25 THEN 'under 0.25' WHEN appearance <= 0.75 THEN '0.25-0.75' WHEN appearance <= 1.25 THEN '0.75-1.25'
      WHEN appearance <= 1.75 THEN '1.25-1.75' ELSE 'over 1.75' END AS band FROM log)
SELECT band, count(*) AS n, round(avg(appearance), 6) AS predicted, round(avg(act_appearance), 6) AS actual,
       round(avg(CASE WHEN minutes = 0 THEN 1.0 ELSE 0.0 END), 6) AS none, round(avg(CASE WHEN minutes >= 60 THEN 1.0 ELSE 0.0 END), 6) AS hour
FROM p GROUP BY band""")
def minutes_bands(spark, sf):
    return rnd(r.minutes_calibration(log_panel(spark, sf)), ["predicted", "actual", "none", "hour"])


# The best eleven by brute force over shapes: cumulated position values.
def xi_sql(source: str, by: str, col: str, name: str) -> str:
    shapes = ", ".join(f"({i}, {d}, {m}, {f})" for i, (d, m, f) in enumerate(sq.SHAPES))
    return f"""
{name}_r AS (SELECT *, row_number() OVER (PARTITION BY {by}, position ORDER BY {col} DESC NULLS LAST, entity) AS rn FROM {source}),
{name}_s AS (SELECT * FROM (VALUES {shapes}) AS v(i, d, m, f)),
{name}_k AS (SELECT {by}, i, d, m, f, sum({col}) AS total, count(*) AS c FROM {name}_r, {name}_s
  WHERE rn <= CASE position WHEN 'GK' THEN 1 WHEN 'DEF' THEN d WHEN 'MID' THEN m ELSE f END GROUP BY ALL HAVING count(*) = 11),
{name}_b AS (SELECT {by}, first(struct_pack(d := d, m := m, f := f) ORDER BY total DESC, i) AS s FROM {name}_k GROUP BY {by}),
{name} AS (SELECT r.* FROM {name}_r r JOIN {name}_b b USING ({by}) WHERE rn <= CASE position WHEN 'GK' THEN 1 WHEN 'DEF' THEN s.d WHEN 'MID' THEN s.m ELSE s.f END
  UNION ALL SELECT * EXCLUDE (z) FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {col} DESC NULLS LAST, entity) AS z
    FROM {name}_r ANTI JOIN {name}_b USING ({by})) WHERE z <= 11)"""


@query("best_legal_eleven", with_sql(LOG_SQL, xi_sql("log", "season, period", "expected_points", "x")) + """
SELECT season, period, entity, position, expected_points, actual FROM x""")
def best_legal_eleven(spark, sf):
    return sq.best_xi(log_panel(spark, sf), ["season", "period"], "entity", "position", "expected_points", keep=["actual"])


H2H = with_sql(
    LOG_SQL, "\nplaying AS (SELECT * FROM log WHERE coalesce(minutes_r3, 0) >= 1 AND xp_external IS NOT NULL)",
    *[x for k, c in WHO.items() for x in (
        rho_sql("playing", "season, period, position", "actual", c, f"r{k}"),
        f"\npool{k} AS (SELECT * FROM log WHERE {c} IS NOT NULL)", xi_sql(f"pool{k}", "season, period", c, f"x{k}"),
        f"\nw{k} AS (SELECT season, period, sum(rho * n) / sum(CASE WHEN rho IS NOT NULL THEN n END) AS {k}_rank FROM r{k} GROUP BY season, period)",
        f"\ny{k} AS (SELECT season, period, sum(actual) AS {k}_xi FROM x{k} GROUP BY season, period HAVING count(*) >= 11)")]) + """,
a AS (SELECT season, period, count(*) AS n, avg(abs(actual - expected_points)) AS model_mae, avg(abs(actual - xp_external)) AS external_mae FROM playing GROUP BY ALL),
g AS (SELECT DISTINCT season, period FROM log),
z AS (SELECT season || '-' || period AS period, coalesce(n, 0) AS n, model_mae, model_rank, model_xi, external_mae, external_rank, external_xi
  FROM g LEFT JOIN a USING (season, period) LEFT JOIN wmodel USING (season, period) LEFT JOIN wexternal USING (season, period)
  LEFT JOIN ymodel USING (season, period) LEFT JOIN yexternal USING (season, period)),
zz AS (SELECT * FROM z UNION ALL SELECT 'all', sum(n), sum(coalesce(model_mae, 0) * greatest(n, 1)) / sum(greatest(n, 1)), avg(model_rank), sum(model_xi),
  sum(coalesce(external_mae, 0) * greatest(n, 1)) / sum(greatest(n, 1)), avg(external_rank), sum(external_xi) FROM z)
SELECT period, CAST(n AS BIGINT) AS n, round(model_mae, 6) AS model_mae, round(model_rank, 6) AS model_rank, model_xi,
       round(external_mae, 6) AS external_mae, round(external_rank, 6) AS external_rank, external_xi FROM zz"""


@query("head_to_head", H2H)
def head_to_head(spark, sf):
    # The running log is a stored table; here it is stored first.
    log = materialise(log_panel(spark, sf), "log")
    out = r.head_to_head(log, WHO, "xp_external")
    return rnd(out, [c for c in out.columns if c.endswith(("_mae", "_rank"))])


@query("track_series", with_sql(LOG_SQL) + """
SELECT season, entity, string_agg(concat_ws('/', period, round(expected_points, 2), coalesce(CAST(round(xp_external, 2) AS VARCHAR), '-'), CAST(actual AS BIGINT), minutes), ',' ORDER BY period) AS track
FROM log WHERE expected_points >= 0.5 OR minutes > 0 GROUP BY season, entity""")
def track_series(spark, sf):
    d = r.track_record(log_panel(spark, sf), ["season", "entity"])
    text = F.transform("track", lambda x: F.concat_ws(
        "/", x["period"].cast("string"), x["expected"].cast("string"), F.coalesce(x["external"].cast("string"), F.lit("-")),
        x["actual"].cast("bigint").cast("string"), x["minutes"].cast("string")))
    return d.select("season", "entity", F.array_join(text, ",").alias("track"))


@query("live_terms_by_user", with_sql(EV_SQL) + """
SELECT user_id, day, CAST(count(*) AS BIGINT) AS events,
  CAST(sum(CASE WHEN event_type = 'click' THEN k ELSE 0 END) AS DOUBLE) AS act_goals, CAST(sum(CASE WHEN event_type = 'view' THEN k ELSE 0 END) AS DOUBLE) AS act_appearance,
  CAST(sum(CASE WHEN event_type = 'purchase' THEN k ELSE 0 END) AS DOUBLE) AS act_saves, CAST(sum(CASE WHEN event_type NOT IN ('click', 'view', 'purchase') THEN k ELSE 0 END) AS DOUBLE) AS act_other
FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM ev) GROUP BY user_id, day""")
def live_terms_by_user(spark, sf):
    """Nested scoring events built from the event stream, then unfolded by term."""
    name = F.when(F.col("event_type") == "click", "goals_scored").when(F.col("event_type") == "view", "minutes").when(
        F.col("event_type") == "purchase", "penalties_saved").otherwise(F.col("event_type"))
    item = F.struct(name.alias("identifier"), F.from_json("props", "k bigint")["k"].cast("double").alias("points"))
    # One live document per user and day, its events nested as the feed nests them.
    docs = ev_panel(spark, sf).groupBy("user_id", "day").agg(
        F.count("*").alias("events"), F.array(F.struct(F.collect_list(item).alias("stats"))).alias("explain"))
    terms = r.explain_terms()
    return docs.select("user_id", "day", "events", *[terms[f"act_{t}"].alias(f"act_{t}") for t in ("goals", "appearance", "saves", "other")])


@query("term_totals_by_user", with_sql(EV_SQL) + """
SELECT user_id, CAST(sum(CASE WHEN event_type = 'click' THEN k ELSE 0 END) AS DOUBLE) AS act_goals,
  CAST(sum(CASE WHEN event_type <> 'click' THEN k ELSE 0 END) AS DOUBLE) AS act_other
FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM ev) GROUP BY user_id""")
def term_totals_by_user(spark, sf):
    name = F.when(F.col("event_type") == "click", "goals_scored").otherwise(F.col("event_type"))
    d = r.term_totals(ev_panel(spark, sf), ["user_id"], r.term_of(name), F.from_json("props", "k bigint")["k"])
    return d.select("user_id", "act_goals", "act_other")


@query("join_actuals", with_sql(LOG_SQL) + """,
act AS (SELECT season, period, entity, minutes, actual, act_goals FROM log WHERE entity % 4 <> 0)
SELECT l.season, l.period, l.entity, coalesce(a.minutes, 0) AS minutes, coalesce(a.actual, 0) AS actual, coalesce(a.act_goals, 0) AS act_goals, 0.0::DOUBLE AS act_other,
       coalesce(a.actual, 0) - l.expected_points AS diff
FROM log l LEFT JOIN act a USING (season, period, entity)""")
def join_actuals(spark, sf):
    log = log_panel(spark, sf)
    record = log.select("season", "period", "entity", "expected_points")
    actual = log.where(F.col("entity") % 4 != 0).select("season", "period", "entity", "minutes", "actual", "act_goals")
    out = r.join_actuals(record, actual, ["season", "period", "entity"])
    return out.select("season", "period", "entity", "minutes", "actual", "act_goals", "act_other", "diff")


MISSES = with_sql(LOG_SQL) + """, d AS (SELECT season, period, entity, expected_points, actual - expected_points AS diff, minutes FROM log)
SELECT * EXCLUDE (minutes) FROM {0} ORDER BY diff {1}, season, period, entity LIMIT 8"""


@query("largest_over_deliveries", MISSES.format("d WHERE minutes > 0", "DESC"))
def largest_over(spark, sf):
    return _misses(spark, sf)[0]


@query("largest_under_deliveries", MISSES.format("(SELECT * FROM d ORDER BY expected_points DESC, season, period, entity LIMIT 60)", "ASC"))
def largest_under(spark, sf):
    return _misses(spark, sf)[1]


def _misses(spark, sf):
    d = log_panel(spark, sf).select("season", "period", "entity", "expected_points", (F.col("actual") - F.col("expected_points")).alias("diff"), "minutes")
    over, under = r.largest_misses(d, ["season", "period", "entity"])
    return over.drop("minutes"), under.drop("minutes")


@query("prediction_record", with_sql(PLAY_SQL) + """
SELECT season, period, entity, CAST(sum(points) AS DOUBLE) AS points, sum(minutes) AS minutes, max(involvement) AS involvement, max(starts) AS starts,
       first(position ORDER BY event) AS position, first(xp ORDER BY event) FILTER (WHERE xp IS NOT NULL) AS xp, count(DISTINCT event) AS events
FROM play GROUP BY season, period, entity""")
def prediction_record(spark, sf):
    return r.prediction_record(play_panel(spark, sf), ["season", "period", "entity"], ["points", "minutes"], ["involvement", "starts"], ["position", "xp"])


@query("squad_point_totals", with_sql(LOG_SQL) + """
SELECT season, period, sum(actual * (entity % 3)) AS scored, sum(coalesce(xp_external, 0) * (entity % 3)) AS expected FROM log WHERE entity % 3 > 0 GROUP BY ALL""")
def squad_point_totals(spark, sf):
    d = log_panel(spark, sf).withColumn("multiplier", F.col("entity") % 3)
    return r.squad_totals(d, ["season", "period"], expected="xp_external")


@query("event_labels", with_sql(PLAY_SQL) + """,
ma AS (SELECT DISTINCT season, period, event, CASE WHEN is_home THEN side ELSE opponent END AS home, CASE WHEN is_home THEN opponent ELSE side END AS away, goals_for IS NOT NULL AS done FROM play),
sd AS (SELECT season, period, event, home AS side, away AS opp, 'H' AS fl, CASE WHEN done THEN (home % 4) || '-' || (away % 3) ELSE '—' END AS sc FROM ma
  UNION ALL SELECT season, period, event, away, home, 'A', CASE WHEN done THEN (away % 3) || '-' || (home % 4) ELSE '—' END FROM ma)
SELECT season, period, side, string_agg(substr(n_name, 8) || ' (' || fl || ') ' || sc, ', ' ORDER BY event, substr(n_name, 8) || ' (' || fl || ') ' || sc) AS label
FROM sd JOIN nation ON n_nationkey = opp GROUP BY season, period, side""")
def event_labels(spark, sf):
    home = F.when(F.col("is_home"), F.col("side")).otherwise(F.col("opponent"))
    away = F.when(F.col("is_home"), F.col("opponent")).otherwise(F.col("side"))
    done = F.col("goals_for").isNotNull()
    ev = play_panel(spark, sf).select("season", "period", "event", home.alias("home"), away.alias("away"), done.alias("done")).distinct()
    ev = ev.withColumns({"home_goals": F.when(F.col("done"), F.col("home") % 4), "away_goals": F.when(F.col("done"), F.col("away") % 3)})
    names = table(spark, sf, "nation").select(F.col("n_nationkey").alias("side"), F.substring("n_name", 8, 10).alias("short_name"))
    return r.event_labels(ev, names, ["season", "period"])


@query("rank_payout_table", with_sql(LINE_SQL) + """,
k AS (SELECT *, rank() OVER (PARTITION BY l_orderkey ORDER BY defensive_contribution DESC) AS rk FROM line WHERE minutes > 0)
SELECT CAST(least(rk, 6) AS INTEGER) AS rank, round(avg(bonus), 6) AS payout, count(*) AS n FROM k GROUP BY 1""")
def rank_payout_table(spark, sf):
    from panelcast.operators.models import rank_payouts

    d = line_panel(spark, sf).where("minutes > 0").select("l_orderkey", "defensive_contribution", "bonus")
    return rnd(rank_payouts(d, ["l_orderkey"], "defensive_contribution", "bonus"), ["payout"])


@query("penalty_save_rate", with_sql(LINE_SQL) + "SELECT l_partkey % 7 AS part, round(5.0 * coalesce(avg(penalties_saved), 0), 6) AS points FROM line WHERE position = 'GK' AND minutes >= 60 GROUP BY 1")
def penalty_save_rate(spark, sf):
    """What a starting keeper collects from penalty saves on average, by part of the table."""
    from panelcast.operators.models import penalty_save_points

    keepers = line_panel(spark, sf).where("position = 'GK' AND minutes >= 60")
    return rnd(keepers.groupBy((F.col("l_partkey") % 7).alias("part")).agg(penalty_save_points().alias("points")), ["points"])
