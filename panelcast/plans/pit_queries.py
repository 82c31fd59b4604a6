"""Queries for captures, overlays, as-of joins, rating replay and gaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.functions import ratings as fr
from panelcast.operators import asof, elo
from panelcast.operators.metrics import brier
from panelcast.plans.metrics_queries import rnd
from panelcast.plans.panels import MATCH_ORDER, MATCH_SQL, ORD, ORD_SQL, PLAY, PLAY_SQL, match_panel, ord_panel, play_panel, with_sql
from panelcast.plans.registry import query, table
from panelcast.session import drop_written, materialise

LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
KEYS_SQL = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


# -- as-of ---------------------------------------------------------------------------------------

ASOF = """SELECT {keys}, l.l_shipdate::DATE::VARCHAR AS shipped, o.price AS last_price
FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey) l
ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max(o_totalprice) AS price FROM orders GROUP BY ALL) o ON l.o_custkey = o.o_custkey AND l.l_shipdate {op} o.o_orderdate"""


def _as_of(spark, sf, strict):
    orders = table(spark, sf, "orders")
    lines = table(spark, sf, "lineitem").select(*LINE_KEYS, "l_shipdate").join(
        orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    history = orders.select("o_custkey", F.col("o_orderdate").alias("since"), F.col("o_totalprice").alias("last_price"))
    out = asof.as_of_join(lines, history, ["o_custkey"], "l_shipdate", "since", ["last_price"], strict)
    return out.select(*LINE_KEYS, F.col("l_shipdate").cast("date").cast("string").alias("shipped"), "last_price")


@query("as_of_join_strict", ASOF.format(keys=KEYS_SQL, op=">"))
def as_of_join_strict(spark, sf):
    return _as_of(spark, sf, True)


@query("as_of_join_inclusive", ASOF.format(keys=KEYS_SQL, op=">="))
def as_of_join_inclusive(spark, sf):
    return _as_of(spark, sf, False)


# -- captures: every order is a capture of its customer's state under the order's month ------------

CAP_SQL = """
cap AS (SELECT CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INTEGER) AS period, o_custkey AS entity, o_orderdate AS captured_at,
               CAST(o_orderkey % 40 AS DOUBLE) AS xp, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey % 5 AS DOUBLE) END AS role, o_orderkey FROM orders),
dl AS (SELECT period, CAST(min(captured_at) AS DATE) + INTERVAL 20 DAY AS deadline FROM cap GROUP BY period),
legal AS (SELECT cap.* FROM cap JOIN dl USING (period) WHERE captured_at < deadline),
snap AS (SELECT period, entity, last(xp ORDER BY captured_at, xp, role NULLS FIRST, o_orderkey) AS xp, last(role ORDER BY captured_at, xp, role NULLS FIRST, o_orderkey) AS role,
                max(captured_at) AS captured_at FROM legal GROUP BY period, entity)"""


def captures(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("period"), F.col("o_custkey").alias("entity"), F.col("o_orderdate").alias("captured_at"),
        (k % 40).cast("double").alias("xp"), F.when(k % 3 != 0, (k % 5).cast("double")).alias("role"), "o_orderkey")


def capture_deadlines(cap):
    first = F.to_date(F.min("captured_at"))
    return cap.groupBy("period").agg(F.date_add(first, 20).cast("timestamp_ntz").alias("deadline"))


def snapshots(spark, sf):
    cap = captures(spark, sf)
    return asof.latest_before(cap, capture_deadlines(cap), ["period", "entity"])


@query("latest_capture_before_deadline", with_sql(CAP_SQL) + "SELECT period, entity, xp, role, CAST(captured_at AS DATE) AS captured FROM snap")
def latest_capture(spark, sf):
    return snapshots(spark, sf).select("period", "entity", "xp", "role", F.col("captured_at").cast("date").alias("captured"))


ROWS_SQL = CAP_SQL + """,
rows AS (SELECT o_orderkey AS event, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INTEGER) AS period, o_custkey AS entity, year(o_orderdate) AS season,
                CASE WHEN o_orderkey % 2 = 0 THEN 9.5::DOUBLE END AS xp, CAST(o_orderkey % 4 AS DOUBLE) AS role, o_orderkey % 3 <> 0 AS is_home,
                CAST(o_orderkey % 6 AS DOUBLE) AS team_difficulty, CAST(o_orderkey % 7 AS DOUBLE) AS opp_difficulty, o_custkey % 50 AS fixture FROM orders)"""


def overlay_rows(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        k.alias("event"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("period"), F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("season"),
        F.when(k % 2 == 0, 9.5).alias("xp"), (k % 4).cast("double").alias("role"), (k % 3 != 0).alias("is_home"),
        (k % 6).cast("double").alias("team_difficulty"), (k % 7).cast("double").alias("opp_difficulty"), (F.col("o_custkey") % 50).alias("fixture"))


@query("capture_overlay", with_sql(ROWS_SQL) + """
SELECT event, coalesce(r.xp, s.xp) AS xp, CASE WHEN s.entity IS NOT NULL THEN s.role ELSE r.role END AS role FROM rows r LEFT JOIN snap s USING (period, entity)""")
def capture_overlay(spark, sf):
    out = asof.overlay(overlay_rows(spark, sf), snapshots(spark, sf), ["period", "entity"], fill=["xp"], replace=["role"])
    return out.select("event", "xp", "role")


RATINGS_SQL = """,
rt AS (SELECT fixture, CAST(fixture % 5 + 1 AS DOUBLE) AS h, CAST(fixture % 3 + 1 AS DOUBLE) AS a FROM (SELECT DISTINCT c_custkey % 50 AS fixture FROM customer) WHERE fixture % 4 <> 0)"""
RATED = "CASE WHEN rt.fixture IS NOT NULL THEN CASE WHEN is_home THEN {0} ELSE {1} END ELSE {2} END AS {2}"


def ratings(spark, sf):
    d = table(spark, sf, "customer").select((F.col("c_custkey") % 50).alias("fixture")).distinct().where("fixture % 4 <> 0")
    return d.select("fixture", (F.col("fixture") % 5 + 1).cast("double").alias("home_rating"), (F.col("fixture") % 3 + 1).cast("double").alias("away_rating"))


@query("rating_overlay", with_sql(ROWS_SQL) + RATINGS_SQL + "SELECT event, " + RATED.format("h", "a", "team_difficulty") + ", " + RATED.format("a", "h", "opp_difficulty") + " FROM rows LEFT JOIN rt USING (fixture)")
def rating_overlay(spark, sf):
    return asof.overlay_ratings(overlay_rows(spark, sf), ratings(spark, sf), ["fixture"]).select("event", "team_difficulty", "opp_difficulty")


AT = 1998 * 12 + 6
STATE_RATED = "CASE WHEN rt.fixture IS NOT NULL AND season = 1998 THEN CASE WHEN is_home THEN {0} ELSE {1} END ELSE {2} END AS {2}"


@query("deadline_state", with_sql(ROWS_SQL) + RATINGS_SQL + f""",
own AS (SELECT * FROM snap WHERE period = {AT}), cov AS (SELECT DISTINCT period FROM snap WHERE period % 2 = 0)
SELECT event, CASE WHEN season = 1998 AND r.period = {AT} THEN own.xp ELSE r.xp END AS xp,
  CASE WHEN season = 1998 AND own.entity IS NOT NULL AND (r.period = {AT} OR (r.period < {AT} AND cov.period IS NULL)) THEN own.role ELSE r.role END AS role,
  """ + STATE_RATED.format("h", "a", "team_difficulty") + ", " + STATE_RATED.format("a", "h", "opp_difficulty") + """
FROM rows r LEFT JOIN own USING (entity) LEFT JOIN cov ON cov.period = r.period LEFT JOIN rt USING (fixture)""")
def deadline_state(spark, sf):
    snaps = snapshots(spark, sf).where(f"period % 2 = 0 OR period = {AT}")
    out = asof.deadline_state(overlay_rows(spark, sf), snaps, ratings(spark, sf), 1998, AT, event="fixture", fill=["xp"], replace=["role"])
    return out.select("event", "xp", "role", "team_difficulty", "opp_difficulty")


@query("newest_source_wins", with_sql(CAP_SQL) + """,
u AS (SELECT *, 0 AS prio FROM cap WHERE o_orderkey % 2 = 0 UNION ALL SELECT *, -1 FROM cap WHERE o_orderkey % 2 = 1)
SELECT period, entity, CAST(max(captured_at) AS DATE) AS captured, max_by(prio, (captured_at, prio)) AS prio FROM u GROUP BY period, entity""")
def newest_source_wins(spark, sf):
    cap = captures(spark, sf)
    a = cap.where("o_orderkey % 2 = 0").withColumn("prio", F.lit(0))
    b = cap.where("o_orderkey % 2 = 1").withColumn("prio", F.lit(-1))
    out = asof.newest_wins([a, b], ["period", "entity"])
    return out.select("period", "entity", F.col("captured_at").cast("date").alias("captured"), "prio")


BUILDS_SQL = CAP_SQL + """,
g AS (SELECT period, {0}(captured_at) AS captured_at FROM legal GROUP BY period)
SELECT period, entity, xp, CAST(captured_at AS DATE) AS generated FROM legal JOIN g USING (period, captured_at)"""


def _builds(spark, sf, pick):
    cap = captures(spark, sf)
    out = asof.stored_predictions(cap.withColumnRenamed("captured_at", "generated_at"), capture_deadlines(cap), ["period"], pick)
    return out.select("period", "entity", "xp", F.col("generated_at").cast("date").alias("generated"))


@query("stored_build_before_deadline", with_sql(BUILDS_SQL.format("max")))
def stored_build(spark, sf):
    return _builds(spark, sf, "latest")


@query("first_build_before_deadline", with_sql(BUILDS_SQL.format("min")))
def first_build(spark, sf):
    return _builds(spark, sf, "first")


@query("dataset_fingerprint")
def dataset_fingerprint(spark, sf):
    return asof.fingerprint(table(spark, sf, "orders"), {"model": "component"})


# -- ratings ---------------------------------------------------------------------------------------

REPLAY_SQL = """
num AS (SELECT *, row_number() OVER (PARTITION BY league ORDER BY date, home, l_orderkey, l_linenumber, l_partkey, l_suppkey, cents, home_goals) AS n FROM match),
elo AS (
  WITH RECURSIVE e(league, n, date, home, away, expected, result, h, a, r) AS (
    SELECT DISTINCT league, 0::BIGINT, NULL::DATE, NULL::INTEGER, NULL::INTEGER, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, MAP {-1: 0.0::DOUBLE} FROM num
    UNION ALL
    SELECT league, n, date, home, away, ex, re, h1, a1,
           map_from_entries(list_concat(list_filter(map_entries(r), lambda kv: kv.key <> home AND kv.key <> away), [{'key': home, 'value': h1}, {'key': away, 'value': a1}]))
    FROM (SELECT *, h0 + 12.5 * sqrt(greatest(1, abs(home_goals - away_goals))) * (re - ex) AS h1,
                    a0 - 12.5 * sqrt(greatest(1, abs(home_goals - away_goals))) * (re - ex) AS a1
          FROM (SELECT *, 1.0 / (pow(10, -(h0 - a0 + 45) / 400) + 1) AS ex,
                       CASE WHEN home_goals > away_goals THEN 1.0 WHEN home_goals = away_goals THEN 0.5 ELSE 0.0 END::DOUBLE AS re
                FROM (SELECT m.league, m.n, m.date, m.home, m.away, m.home_goals, m.away_goals, e.r,
                             coalesce(e.r[m.home], 1500.0) AS h0, coalesce(e.r[m.away], 1500.0) AS a0
                      FROM e JOIN num m ON m.league = e.league AND m.n = e.n + 1))))
  SELECT league, n, date, home, away, expected, result, h, a FROM e WHERE n > 0),
hist AS (SELECT league, side, date, last(rating ORDER BY n) AS rating FROM (
  SELECT league, home AS side, date, n, h AS rating FROM elo UNION ALL SELECT league, away, date, n, a FROM elo) GROUP BY ALL)"""


def replayed(spark, sf):
    return elo.replay(materialise(match_panel(spark, sf), "matches"), MATCH_ORDER)


@query("rating_replay_expectations", with_sql(MATCH_SQL, REPLAY_SQL) + """
SELECT league, date, CAST(home AS BIGINT) AS home, CAST(away AS BIGINT) AS away, round(expected, 6) AS expected, result FROM elo""")
def rating_replay(spark, sf):
    return rnd(elo.expectations(replayed(spark, sf)).drop("season"), ["expected"])


@query("rating_history", with_sql(MATCH_SQL, REPLAY_SQL) + """
SELECT league, CAST(side AS BIGINT) AS side, date AS valid_from, round(rating, 4) AS rating FROM hist""")
def rating_history(spark, sf):
    h = elo.rating_history(replayed(spark, sf))
    # The opening ratings are dated before the league's first match day; the SQL lists match days only.
    first = match_panel(spark, sf).groupBy("league").agg(F.min("date").alias("opening"))
    h = h.join(first, "league").where(F.col("valid_from") >= F.col("opening")).drop("opening", "season")
    return rnd(h, ["rating"], 4)


@query("rating_brier_score", with_sql(MATCH_SQL, REPLAY_SQL) + """
SELECT CAST(league // 100 % 10000 AS BIGINT) AS season, round(avg(pow(expected - result, 2)), 6) AS brier FROM elo GROUP BY 1""")
def rating_brier_score(spark, sf):
    e = elo.expectations(replayed(spark, sf))
    out = e.groupBy(F.expr("(league div 100) % 10000").alias("season")).agg(brier("expected", "result").alias("brier"))
    return rnd(out, ["brier"])


@query("event_rating_gap", with_sql(MATCH_SQL, REPLAY_SQL) + """,
f AS (SELECT DISTINCT league, date, home, away FROM match),
g AS (SELECT f.*, a.rating AS ra FROM f ASOF LEFT JOIN hist a ON f.league = a.league AND f.home = a.side AND f.date > a.date),
k AS (SELECT g.*, b.rating AS rb FROM g ASOF LEFT JOIN hist b ON g.league = b.league AND g.away = b.side AND g.date > b.date),
o AS (SELECT league, side, min(date) AS opens FROM (SELECT league, home AS side, date FROM match UNION ALL SELECT league, away, date FROM match) GROUP BY ALL)
SELECT league, date, home, away, round(coalesce(ra, 1500) - coalesce(rb, 1500) + 45, 4) AS gap FROM k""")
def event_rating_gap(spark, sf):
    f = match_panel(spark, sf).select("league", "date", "home", "away").distinct().withColumn("is_home", F.lit(True))
    out = elo.attach_gap(f, elo.rating_history(replayed(spark, sf)), "date", side="home", opponent="away", name="gap")
    return rnd(out.select("league", "date", "home", "away", "gap"), ["gap"], 4)


# Replay with turnover between seasons, over leagues `lm`: who plays a season is known when it opens.
TURNOVER_SQL = """
num AS (SELECT *, row_number() OVER (PARTITION BY league ORDER BY date, home, l_orderkey, l_linenumber, l_partkey, l_suppkey, cents, home_goals) AS n FROM lm),
mem AS (SELECT league, season, now, lag(now) OVER (PARTITION BY league ORDER BY season) AS prev FROM (
  SELECT league, season, list_sort(list(DISTINCT side)) AS now FROM (SELECT league, season, home AS side FROM num UNION ALL SELECT league, season, away FROM num) GROUP BY ALL)),
nm AS (SELECT num.*, now, prev, coalesce(lag(num.season) OVER w <> num.season, TRUE) AS opens, coalesce(CAST(lag(date) OVER w + INTERVAL 1 DAY AS DATE), CAST(date - INTERVAL 1 DAY AS DATE)) AS close
       FROM num JOIN mem USING (league, season) WINDOW w AS (PARTITION BY num.league ORDER BY n)),
elo AS (
  WITH RECURSIVE e(league, n, season, date, home, away, h, a, seats, close, r) AS (
    SELECT DISTINCT league, 0::BIGINT, NULL::INTEGER, NULL::DATE, NULL::INTEGER, NULL::INTEGER, NULL::DOUBLE, NULL::DOUBLE, NULL::MAP(INTEGER, DOUBLE), NULL::DATE, MAP {-1: 0.0::DOUBLE} FROM num
    UNION ALL
    SELECT league, n, season, date, home, away, h1, a1, CASE WHEN opens THEN r0 END, close,
           map_from_entries(list_concat(list_filter(map_entries(r0), lambda kv: kv.key <> home AND kv.key <> away), [{'key': home, 'value': h1}, {'key': away, 'value': a1}]))
    FROM (SELECT *, h0 + 12.5 * sqrt(greatest(1, abs(home_goals - away_goals))) * (re - ex) AS h1, a0 - 12.5 * sqrt(greatest(1, abs(home_goals - away_goals))) * (re - ex) AS a1
      FROM (SELECT *, 1.0 / (pow(10, -(h0 - a0 + 45) / 400) + 1) AS ex, CASE WHEN home_goals > away_goals THEN 1.0 WHEN home_goals = away_goals THEN 0.5 ELSE 0.0 END::DOUBLE AS re
        FROM (SELECT *, r0[home] AS h0, r0[away] AS a0
          FROM (SELECT *, CASE WHEN NOT opens THEN r WHEN prev IS NULL THEN map_from_entries(list_transform(now, lambda t: {'key': t, 'value': 1500.0::DOUBLE}))
                  ELSE map_from_entries(list_concat(list_filter(map_entries(r), lambda kv: NOT list_contains(now, kv.key)),
                    list_transform(now, lambda t: {'key': t, 'value': mean + (CASE WHEN list_contains(prev, t) THEN r[t] ELSE entry END - mean) * 0.9}))) END AS r0
            FROM (SELECT *, coalesce(list_avg(list_transform(list_filter(prev, lambda t: NOT list_contains(now, t)), lambda t: r[t])), mean) AS entry
              FROM (SELECT m.*, e.r, list_avg(list_transform(m.prev, lambda t: e.r[t])) AS mean FROM e JOIN nm m ON m.league = e.league AND m.n = e.n + 1)))))))
  SELECT * FROM e WHERE n > 0),
dayend AS (SELECT league, season, side, date AS valid_from, last(rating ORDER BY n) AS rating FROM (
  SELECT league, season, n, date, home AS side, h AS rating FROM elo UNION ALL SELECT league, season, n, date, away, a FROM elo) GROUP BY ALL),
seated AS (SELECT league, season, t.key AS side, close AS valid_from, t.value AS rating FROM (SELECT league, season, close, unnest(map_entries(seats)) AS t FROM elo WHERE seats IS NOT NULL)),
hist AS (SELECT * FROM dayend UNION ALL
  SELECT s.* FROM seated s JOIN mem USING (league, season) ANTI JOIN dayend d ON d.league = s.league AND d.side = s.side AND d.valid_from = s.valid_from WHERE list_contains(mem.now, s.side))"""


@query("season_turnover_ratings", with_sql(MATCH_SQL, """
lm AS (SELECT * REPLACE (CAST(l_partkey AS BIGINT) AS league) FROM match WHERE (home + season) % 5 <> 0 AND (away + season) % 5 <> 0)""", TURNOVER_SQL) + """
SELECT league, CAST(side AS BIGINT) AS side, round(arg_max(rating, valid_from), 4) AS rating, max(season) AS season FROM hist GROUP BY league, side""")
def season_turnover_ratings(spark, sf):
    """A league per part over seven seasons, sides dropping out and returning; as many leagues as parts."""
    d = match_panel(spark, sf).where("(home + season) % 5 <> 0 AND (away + season) % 5 <> 0").withColumn("league", F.col("l_partkey").cast("bigint"))
    out = elo.closing_ratings(elo.rating_history(elo.replay(materialise(d, "matches"), MATCH_ORDER)))
    return rnd(out.drop("valid_from"), ["rating"], 4)


def customer_leagues(spark, sf):
    """Matches with their customer as the league. An order's customers come with its lines, so matches are not joined to orders again."""
    buyers = table(spark, sf, "orders").groupBy("o_orderkey").agg(F.collect_list(F.struct(F.col("o_custkey").cast("bigint").alias("league"))).alias("buyers"))
    matches = match_panel(spark, sf, buyers).withColumn("buyer", F.explode("buyers"))
    return matches.select(F.col("buyer.league").alias("league"), "season", "date", "home", "away", "home_goals", "away_goals", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cents")


def customer_history(spark, sf):
    """The ratings of customer leagues, written; the matches they come from are not kept beside them."""
    matches = materialise(customer_leagues(spark, sf), "matches")
    history = materialise(elo.rating_history(elo.replay(matches, MATCH_ORDER)), "history")
    drop_written(matches)
    return history


@query("panel_rating_gap", with_sql(MATCH_SQL, """
lm AS (SELECT m.* REPLACE (CAST(o_custkey AS BIGINT) AS league) FROM match m JOIN orders ON l_orderkey = o_orderkey)""", TURNOVER_SQL, PLAY_SQL) + """,
fd AS (SELECT season, period, CAST(min(ts) AS DATE) AS at FROM play GROUP BY ALL),
pa AS (SELECT p.season, p.entity, p.event, p.side, p.opponent, p.is_home, fd.at FROM play p JOIN fd USING (season, period)),
g1 AS (SELECT pa.*, h.rating AS ra FROM pa ASOF LEFT JOIN hist h ON pa.entity = h.league AND pa.side = h.side AND pa.at > h.valid_from),
g2 AS (SELECT g1.*, h.rating AS rb FROM g1 ASOF LEFT JOIN hist h ON g1.entity = h.league AND g1.opponent = h.side AND g1.at > h.valid_from)
SELECT season, entity, event, round(ra - rb + CASE WHEN is_home THEN 45 ELSE -45 END, 4) AS rating_gap FROM g2""")
def panel_rating_gap(spark, sf):
    """A league per customer, as many as there are; a row's gap comes from its own customer's league."""
    history = customer_history(spark, sf)
    out = elo.attach_gap_column(play_panel(spark, sf).withColumn("league", F.col("entity").cast("bigint")), PLAY, history)
    return rnd(out.select("season", "entity", "event", "rating_gap"), ["rating_gap"], 4)


@query("rated_dataset", with_sql(MATCH_SQL, """
lm AS (SELECT m.* REPLACE (CAST(o_custkey AS BIGINT) AS league) FROM match m JOIN orders ON l_orderkey = o_orderkey)""", TURNOVER_SQL, PLAY_SQL) + """,
fd AS (SELECT season, period, CAST(min(ts) AS DATE) AS at FROM play GROUP BY ALL),
se AS (SELECT season, side, period, CAST(count(DISTINCT event) AS DOUBLE) AS side_events FROM play GROUP BY ALL),
pa AS (SELECT p.*, fd.at, se.side_events FROM play p JOIN fd USING (season, period) JOIN se USING (season, side, period)),
g1 AS (SELECT pa.*, h.rating AS ra FROM pa ASOF LEFT JOIN hist h ON pa.entity = h.league AND pa.side = h.side AND pa.at > h.valid_from),
g2 AS (SELECT g1.*, h.rating AS rb FROM g1 ASOF LEFT JOIN hist h ON g1.entity = h.league AND g1.opponent = h.side AND g1.at > h.valid_from)
SELECT season, entity, event, points, side_events, CAST(is_home AS DOUBLE) AS home_flag, CASE WHEN first_choice = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS is_first_choice,
  round(ra - rb + CASE WHEN is_home THEN 45 ELSE -45 END, 4) AS rating_gap, 'rating_gap' AS listed FROM g2""")
def rated_dataset(spark, sf):
    """Played and upcoming rows through one build, with rating gaps among the features."""
    from panelcast.operators.features import FeaturePlan
    from panelcast.operators.pipeline import build_dataset

    history = customer_history(spark, sf)
    panel = play_panel(spark, sf).withColumn("league", F.col("entity").cast("bigint"))
    plan = FeaturePlan(outcomes=("minutes", "starts", "points", "goals", "involvement"), target="points", side_stats={"goals_for": ("shared", "goals_for")},
                       static=("period", "rating_gap"), role_flags={"first_choice": "is_first_choice"}, banned=("xp",), windows=(3,))
    built = build_dataset([panel.where("points IS NOT NULL"), panel.where("points IS NULL")], PLAY, plan, ratings=history)
    listed = ",".join(c for c in built.columns if c.startswith("rating"))
    out = built.df.select("season", "entity", "event", "points", "side_events", "home_flag", "is_first_choice", "rating_gap").withColumn("listed", F.lit(listed))
    return rnd(out, ["rating_gap"], 4)


@query("rating_arithmetic", with_sql(MATCH_SQL) + """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(1 / (pow(10, -((1400 + home * 8) - (1400 + away * 8) + 45) / 400.0) + 1), 6) AS expected,
  round(sqrt(greatest(1, abs(home_goals - away_goals))), 6) AS margin, CAST(CASE WHEN l_linenumber % 5 <> 0 THEN (home - away) * 8 + CASE WHEN l_orderkey % 2 = 0 THEN 45 ELSE -45 END END AS DOUBLE) AS gap FROM match""")
def rating_arithmetic(spark, sf):
    h, a = (1400 + F.col("home") * 8).cast("double"), (1400 + F.col("away") * 8).cast("double")
    known = F.when(F.col("l_linenumber") % 5 != 0, a)
    return match_panel(spark, sf).select(
        *LINE_KEYS, F.round(fr.expected_home(h, a), 6).alias("expected"), F.round(fr.margin_factor(F.col("home_goals") - F.col("away_goals")), 6).alias("margin"),
        fr.event_gap(h, known, F.col("l_orderkey") % 2 == 0).alias("gap"))
