"""Queries for normalisation, predicates and the panel's joins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.operators import panel as pn
from panelcast.plans.metrics_queries import rnd
from panelcast.plans.panels import EV_SQL, MATCH_SQL, ORD, ORD_SQL, PLAY, PLAY_SQL, ev_panel, match_panel, ord_panel, play_panel, with_sql
from panelcast.plans.registry import query, table


@query("canonicalise", """
SELECT o_orderkey AS event, TRY_CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS priority, CAST(NULL AS DOUBLE) AS absent,
       CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END AS price, TRY_CAST(o_orderstatus AS BIGINT) AS status_number
FROM orders WHERE o_custkey % 10 <> 0""")
def canonicalise(spark, sf):
    d = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("event"), F.substring("o_orderpriority", 1, 1).alias("priority"),
        F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice")).otherwise(float("nan")).alias("price"),
        F.col("o_orderstatus").alias("status_number"), F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey")).alias("entity"))
    schema = pn.canonical_schema({"event": "bigint", "entity": "bigint"}, {"priority": "bigint", "status_number": "bigint", "absent": "double"}, {"price": "double"})
    return pn.canonicalise(d, schema, ["event", "entity"]).drop("entity")


@query("side_selection", with_sql(MATCH_SQL) + """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN h THEN home ELSE away END AS side, CASE WHEN h THEN away ELSE home END AS opponent,
       CASE WHEN h THEN home_goals ELSE away_goals END AS goals_for, CASE WHEN h THEN away_goals ELSE home_goals END AS goals_against
FROM (SELECT *, l_linenumber % 2 = 0 AS h FROM match)""")
def side_selection(spark, sf):
    d = match_panel(spark, sf)
    cols = pn.side_select(F.col("l_linenumber") % 2 == 0, {
        "side": ("home", "away"), "opponent": ("away", "home"), "goals_for": ("home_goals", "away_goals"), "goals_against": ("away_goals", "home_goals")})
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[c.cast("bigint").alias(n) for n, c in cols.items()])


@query("unpivot_sides", with_sql(MATCH_SQL) + """
SELECT league, date, TRUE AS is_home, home AS side, away AS opponent, CAST(home_goals AS BIGINT) AS goals FROM match
UNION ALL SELECT league, date, FALSE, away, home, CAST(away_goals AS BIGINT) FROM match""")
def unpivot_sides(spark, sf):
    d = match_panel(spark, sf).select("league", "date", "home", "away", F.col("home_goals").cast("bigint").alias("home_goals"), F.col("away_goals").cast("bigint").alias("away_goals"))
    return pn.unpivot_sides(d, {"side": ("home", "away"), "opponent": ("away", "home"), "goals": ("home_goals", "away_goals")})


@query("mask_absent_as_zero", with_sql(EV_SQL) + """,
z AS (SELECT event_id, day, CASE WHEN day % 3 = 0 THEN 0 WHEN event_id % 5 = 0 THEN NULL ELSE value END AS v FROM ev)
SELECT event_id, CASE WHEN max(CASE WHEN coalesce(v, 0) <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY day) = 1 THEN v END AS v FROM z""")
def mask_absent_as_zero(spark, sf):
    v = F.when(F.col("day") % 3 == 0, F.lit(0.0)).when(F.col("event_id") % 5 == 0, F.lit(None)).otherwise(F.col("value"))
    d = ev_panel(spark, sf).select("event_id", "day", v.alias("v"))
    return pn.mask_absent_as_zero(d, "v", ["day"]).select("event_id", "v")


@query("only_final_periods", with_sql(ORD_SQL) + """
SELECT season, entity, event FROM ord WHERE (season, period) IN (SELECT season, period FROM ord GROUP BY season, period HAVING count(*) % 2 = 0)""")
def only_final_periods(spark, sf):
    d = ord_panel(spark, sf)
    periods = d.groupBy("season", "period").agg((F.count("*") % 2 == 0).alias("finished"))
    return pn.only_final(d, periods, ["season", "period"]).select("season", "entity", "event")


@query("full_names", """
SELECT p_partkey, CASE WHEN trim(concat_ws(' ', f, l)) <> '' THEN trim(concat_ws(' ', f, l)) ELSE p_brand END AS name
FROM (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE split_part(p_name, ' ', 1) END AS f, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE split_part(p_name, ' ', 2) END AS l FROM part)""")
def full_names(spark, sf):
    words = F.split("p_name", " ")
    first = F.when(F.col("p_partkey") % 3 == 0, F.lit(None)).otherwise(words[0])
    last = F.when(F.col("p_partkey") % 2 == 0, F.lit("")).otherwise(words[1])
    return table(spark, sf, "part").select("p_partkey", pn.full_name(first, last, F.col("p_brand")).alias("name"))


@query("season_labels", """
SELECT DISTINCT y || '-' || lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0') AS season, lpad(CAST(y % 100 AS VARCHAR), 2, '0') || lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0') AS code
FROM (SELECT year(o_orderdate) AS y FROM orders)""")
def season_labels(spark, sf):
    d = table(spark, sf, "orders").select(F.year("o_orderdate").alias("y")).distinct()
    return d.select(pn.season_label(F.col("y")).alias("season")).withColumn("code", pn.season_code(F.col("season")))


@query("season_ranges", """
SELECT entity, y || '-' || lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0') AS season FROM (
  SELECT o_custkey AS entity, unnest(range(min(year(o_orderdate)), max(year(o_orderdate)) + 1)) AS y FROM orders GROUP BY o_custkey)""")
def season_ranges(spark, sf):
    d = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("entity")).agg(
        pn.season_label(F.min(F.year("o_orderdate"))).alias("first"), pn.season_label(F.max(F.year("o_orderdate"))).alias("last"))
    return pn.season_range(d, "first", "last").select("entity", "season")


@query("clean_numbers", """SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN round(c_acctbal * 4 / 4, 1) END AS balance FROM customer""")
def clean_numbers(spark, sf):
    v = F.when(F.col("c_custkey") % 4 == 0, float("nan")).otherwise(F.col("c_acctbal"))
    return table(spark, sf, "customer").select("c_custkey", pn.clean_number(v, 1).alias("balance"))


@query("code_labels", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS status,
       CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'other' END AS status_or_other FROM orders""")
def code_labels(spark, sf):
    t = {"F": "finished", "O": "open"}
    return table(spark, sf, "orders").select(
        "o_orderkey", pn.map_code(F.col("o_orderstatus"), t).alias("status"), pn.map_code(F.col("o_orderstatus"), t, F.lit("other")).alias("status_or_other"))


@query("role_rename_and_fill", """SELECT p_partkey AS entity, CAST(p_size AS DOUBLE) AS penalties_order, CAST(NULL AS DOUBLE) AS setpiece_order FROM part""")
def role_rename_and_fill(spark, sf):
    return pn.set_piece_roles(table(spark, sf, "part"), {"p_partkey": "entity", "p_size": "penalties_order", "corners": "setpiece_order"}, "p_partkey")


@query("event_context_join", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_custkey, o_orderstatus FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey AND o_orderkey % 9 <> 0""")
def event_context_join(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    ctx = table(spark, sf, "orders").where("o_orderkey % 9 <> 0").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderstatus")
    return pn.join_unique(lines, ctx, ["l_orderkey"])


@query("dimension_joins", """
SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def dimension_joins(spark, sf):
    nation = table(spark, sf, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    region = table(spark, sf, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    d = pn.join_unique(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), nation, ["c_nationkey"])
    return pn.join_unique(d, region, ["n_regionkey"]).select("c_custkey", "n_name", "r_name")


@query("schedule_expansion", with_sql(PLAY_SQL) + """,
sc AS (SELECT DISTINCT season, period, event, side FROM play WHERE side % 4 <> 0)
SELECT c_custkey AS entity, season, period, event FROM customer JOIN sc ON c_nationkey = side WHERE season = 1998""")
def schedule_expansion(spark, sf):
    sides = play_panel(spark, sf).where("side % 4 <> 0 AND season = 1998").select("season", "period", "event", "side").distinct()
    who = table(spark, sf, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_nationkey").alias("side"))
    return pn.expand_schedule(who, sides, "side").select("entity", "season", "period", "event")


@query("concat_sources", """
SELECT o_orderkey AS event, o_custkey AS entity, o_totalprice AS price, CAST(NULL AS DOUBLE) AS xp FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT o_orderkey, o_custkey, NULL, o_totalprice FROM orders WHERE o_orderstatus <> 'F'""")
def concat_sources(spark, sf):
    d = table(spark, sf, "orders").select(F.col("o_orderkey").alias("event"), F.col("o_custkey").alias("entity"), F.col("o_totalprice").alias("price"), "o_orderstatus")
    past = d.where("o_orderstatus = 'F'").drop("o_orderstatus")
    coming = d.where("o_orderstatus <> 'F'").drop("o_orderstatus").withColumnRenamed("price", "xp")
    return pn.union_all([past, coming])


@query("first_source_wins", """
SELECT o_custkey AS entity, first(o_orderkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, o_orderkey) AS event FROM orders GROUP BY o_custkey""")
def first_source_wins(spark, sf):
    d = table(spark, sf, "orders").select(F.col("o_custkey").alias("entity"), F.col("o_orderkey").alias("event"), "o_orderstatus")
    return pn.first_per_key([d.where("o_orderstatus = 'F'").drop("o_orderstatus"), d.where("o_orderstatus <> 'F'").drop("o_orderstatus")], ["entity"], ["event"])


@query("coverage_by_season", with_sql(ORD_SQL) + """
SELECT season, round(avg(CASE WHEN x IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM ord GROUP BY season""")
def coverage_by_season(spark, sf):
    return rnd(pn.coverage(ord_panel(spark, sf), "x", ["season"]), ["coverage"])


@query("period_first_days", with_sql(ORD_SQL) + "SELECT season, period, CAST(min(ts) AS DATE) AS deadline FROM ord GROUP BY season, period")
def period_first_days(spark, sf):
    return pn.first_days(ord_panel(spark, sf), ORD)


@query("missing_names", "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def missing_names(spark, sf):
    known = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return pn.missing_from(table(spark, sf, "orders"), known, ["o_custkey"])


@query("eligible_entities_only", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)""")
def eligible_entities_only(spark, sf):
    ok = table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(ok, "l_suppkey", "left_semi")


CALENDAR_SQL = """WITH cal AS (SELECT year(o_orderdate) * 12 + month(o_orderdate) AS id, min(o_orderdate) AS deadline_time,
  count(*) % 40 = 0 AS is_current, count(*) % 37 = 0 AS is_next, year(o_orderdate) < 2000 AS finished FROM orders GROUP BY 1, 5)
"""


def calendar(spark, sf):
    d = table(spark, sf, "orders").select((F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("id"), "o_orderdate")
    return d.groupBy("id").agg(F.min("o_orderdate").alias("deadline_time"), (F.count("*") % 40 == 0).alias("is_current"), (F.count("*") % 37 == 0).alias("is_next"),
                               (F.max(F.year("o_orderdate")) < 2000).alias("finished"))


@query("current_and_next_period", CALENDAR_SQL + """
SELECT CAST(coalesce(min(id) FILTER (WHERE is_current), max(id) FILTER (WHERE finished)) AS INTEGER) AS current_period,
       CAST(coalesce(min(id) FILTER (WHERE is_next), min(id) FILTER (WHERE NOT finished)) AS INTEGER) AS next_period FROM cal""")
def current_and_next_period(spark, sf):
    return pn.current_period(calendar(spark, sf), "id", "is_current", "is_next", "finished")


@query("latest_started_period", with_sql(PLAY_SQL) + "SELECT max(season * 100 + period) AS latest_started FROM play WHERE goals_for IS NOT NULL")
def latest_started_period(spark, sf):
    d = play_panel(spark, sf).select((F.col("season") * 100 + F.col("period")).alias("p"), F.col("goals_for").isNotNull().alias("started"))
    return pn.latest_started(d, "p", "started")


@query("published_deadlines", CALENDAR_SQL + "SELECT CAST(id AS INTEGER) AS period, strftime(deadline_time, '%Y-%m-%d %H:%M') AS deadline FROM cal")
def published_deadlines(spark, sf):
    return pn.published_deadlines(calendar(spark, sf)).withColumn("deadline", F.date_format("deadline", "yyyy-MM-dd HH:mm"))


@query("season_name_dimension", """SELECT '1995' AS season, n_name AS name, CAST(n_nationkey AS BIGINT) AS id FROM nation
UNION ALL SELECT '1996', n_name, (n_nationkey + 7) % 25 FROM nation""")
def season_name_dimension(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("id"))
    return pn.name_dimension({"1995": n, "1996": n.withColumn("id", (F.col("id") + 7) % 25)})


@query("home_away_membership", with_sql(MATCH_SQL) + """,
sd AS (SELECT region AS league, season, home AS side FROM match WHERE (home + season) % 5 <> 0 AND (away + season) % 5 <> 0 UNION SELECT region, season, away FROM match WHERE (home + season) % 5 <> 0 AND (away + season) % 5 <> 0),
ss AS (SELECT league, season, lag(season) OVER (PARTITION BY league ORDER BY season) AS b, lead(season) OVER (PARTITION BY league ORDER BY season) AS a FROM (SELECT DISTINCT league, season FROM sd))
SELECT s.league, s.season, s.side, p.side IS NOT NULL AS stayed, p.side IS NULL AND b IS NOT NULL AS promoted, n.side IS NULL AND a IS NOT NULL AS relegated
FROM sd s JOIN ss USING (league, season) LEFT JOIN sd p ON p.league = s.league AND p.season = b AND p.side = s.side LEFT JOIN sd n ON n.league = s.league AND n.season = a AND n.side = s.side""")
def home_away_membership(spark, sf):
    from panelcast.operators.elo import membership

    d = match_panel(spark, sf).where("(home + season) % 5 <> 0 AND (away + season) % 5 <> 0").withColumn("league", F.col("region"))
    return membership(d)


@query("normalised_history", """
WITH raw AS (SELECT l_partkey AS entity, l_orderkey AS event, l_linenumber, l_quantity, CAST(year(l_shipdate) AS VARCHAR) AS season, CAST(month(l_shipdate) AS BIGINT) AS period, l_linenumber % 2 = 0 AS is_home,
  CASE l_partkey % 5 WHEN 0 THEN 'GK' WHEN 1 THEN 'DEF' WHEN 2 THEN 'MID' WHEN 3 THEN 'FWD' END AS position, CAST(l_shipdate AS TIMESTAMP) AS ts, CASE WHEN month(l_shipdate) % 4 = 0 THEN 0 ELSE l_quantity END AS xp
  FROM lineitem WHERE l_partkey % 5 <> 4),
ev AS (SELECT o_orderkey AS event, o_custkey % 20 AS team_h, o_orderkey % 20 AS team_a, CAST(o_custkey % 5 + 1 AS DOUBLE) AS dh, CAST(o_orderkey % 5 + 1 AS DOUBLE) AS da FROM orders WHERE o_orderkey % 9 <> 0),
j AS (SELECT raw.*, max(abs(xp)) OVER (PARTITION BY season, period) AS seen, team_h, team_a, dh, da FROM raw LEFT JOIN ev USING (event))
SELECT season, period, event, entity, strftime(ts, '%Y-%m-%d') AS day, position, CAST(CASE position WHEN 'GK' THEN 1 WHEN 'DEF' THEN 2 WHEN 'MID' THEN 3 ELSE 4 END AS BIGINT) AS element_type, is_home,
  CASE WHEN is_home THEN team_h ELSE team_a END AS side, CASE WHEN is_home THEN team_a ELSE team_h END AS opponent, CASE WHEN is_home THEN dh ELSE da END AS difficulty,
  CASE WHEN seen <> 0 THEN xp END AS xp, CASE WHEN l_linenumber % 3 <> 0 THEN CAST(l_linenumber * 10 AS DOUBLE) END AS minutes FROM j""")
def normalised_history(spark, sf):
    """Order lines in the shape of a landed season: text fields, a fifth position, events beside them, a forecast missing in some months."""
    k = F.col("l_partkey") % 5
    rows = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("element"), F.col("l_orderkey").cast("string").alias("fixture"), F.year("l_shipdate").cast("string").alias("y"), F.month("l_shipdate").alias("round"),
        F.when(F.col("l_linenumber") % 2 == 0, "True").otherwise("False").alias("was_home"), F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("kickoff_time"),
        F.when(k == 0, "GK").when(k == 1, "DEF").when(k == 2, "MID").when(k == 3, "FWD").otherwise("AM").alias("position"),
        F.when(F.month("l_shipdate") % 4 == 0, 0).otherwise(F.col("l_quantity")).cast("string").alias("xP"),
        F.when(F.col("l_linenumber") % 3 != 0, (F.col("l_linenumber") * 10).cast("string")).otherwise("n/a").alias("minutes"))
    events = table(spark, sf, "orders").where("o_orderkey % 9 <> 0").select(
        F.col("o_orderkey").alias("event"), (F.col("o_custkey") % 20).alias("team_h"), (F.col("o_orderkey") % 20).alias("team_a"),
        (F.col("o_custkey") % 5 + 1).cast("double").alias("dh"), (F.col("o_orderkey") % 5 + 1).cast("double").alias("da"))
    schema = pn.canonical_schema(
        {"season": "string", "period": "bigint", "event": "bigint", "entity": "bigint", "ts": "timestamp"},
        {"position": "string", "element_type": "bigint", "is_home": "boolean", "side": "bigint", "opponent": "bigint", "difficulty": "double", "xp": "double"}, {"minutes": "double"})
    out = pn.normalise_history(rows, events, PLAY, F.col("y"), {"element": "entity", "fixture": "event", "round": "period", "was_home": "is_home", "kickoff_time": "ts", "xP": "xp"},
                               {"side": ("team_h", "team_a"), "opponent": ("team_a", "team_h"), "difficulty": ("dh", "da")}, schema, ["season", "period", "event", "entity"], ["xp"])
    return out.withColumn("day", F.date_format("ts", "yyyy-MM-dd")).drop("ts")
