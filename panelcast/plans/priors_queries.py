"""Queries for priors and name matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.operators import matching as mt, priors as pr
from panelcast.plans.panels import PLAY_SQL, play_panel, position_of, with_sql
from panelcast.plans.registry import query, table


def priced_panel(spark, sf):
    """Order lines as panel rows: parts as entities, retail price in tenths as the price."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    parts = table(spark, sf, "part").select("p_partkey", "p_size")
    d = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return d.select(F.year("o_orderdate").alias("season"), F.month("o_orderdate").alias("period"), F.col("l_partkey").alias("entity"), position_of("l_partkey").alias("position"),
                    (F.col("l_quantity") % 16).cast("double").alias("points"),
                    # A few dear parts lie in bands of their own, too thin to stand alone.
                    F.expr("p_size + 40 + CASE WHEN l_partkey % 89 = 0 THEN l_partkey % 40 * 5 + 50 ELSE 0 END").cast("double").alias("value"))


@query("price_prior_curve", """WITH RECURSIVE pl AS (
  SELECT year(o_orderdate) AS season, month(o_orderdate) AS period, l_partkey AS entity, CASE l_partkey % 4 WHEN 0 THEN 'GK' WHEN 1 THEN 'DEF' WHEN 2 THEN 'MID' ELSE 'FWD' END AS position,
         CAST(l_quantity AS BIGINT) % 16 AS points, p_size + 40 + CASE WHEN l_partkey % 89 = 0 THEN l_partkey % 40 * 5 + 50 ELSE 0 END AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
n AS (SELECT greatest(1, floor(avg(c))) AS n FROM (SELECT count(DISTINCT period) AS c FROM pl GROUP BY season)),
e AS (SELECT season, entity, position, sum(points) / (SELECT n FROM n) AS rate, avg(value) AS price FROM pl GROUP BY ALL),
b AS (SELECT position, floor(price / 5) AS band, quantile_cont(price, 0.5) AS price, avg(rate) AS rate, count(*) AS n FROM e GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY position ORDER BY price, rate, n) AS i, count(*) OVER (PARTITION BY position) AS bands, sum(n) OVER (PARTITION BY position) AS every FROM b),
m(position, i, bands, n, s, p, k) AS (
  SELECT DISTINCT position, 0::BIGINT, bands, 0::HUGEINT, 0.0::DOUBLE, 0.0::DOUBLE, []::STRUCT(price DOUBLE, rate DOUBLE)[] FROM o WHERE every >= 12
  UNION ALL
  SELECT position, i, bands, CASE WHEN nn >= 4 THEN 0 ELSE nn END, CASE WHEN nn >= 4 THEN 0.0 ELSE ss END, price, CASE WHEN nn >= 4 THEN list_append(k, {'price': price, 'rate': ss / nn}) ELSE k END
  FROM (SELECT m.position, o.i, m.bands, m.n + o.n AS nn, m.s + o.rate * o.n AS ss, o.price, m.k FROM m JOIN o ON o.position = m.position AND o.i = m.i + 1)),
f AS (SELECT position, CASE WHEN n > 0 AND len(k) > 0 THEN list_append(k[1:len(k) - 1], {'price': p, 'rate': (k[len(k)].rate + s / n) / 2}) ELSE k END AS k FROM m WHERE i = bands),
u AS (SELECT position, unnest(range(len(k))) AS knot, unnest(k) AS x FROM f)
SELECT position, CAST(knot AS INTEGER) AS knot, round(x.price, 1) AS price, round(max(greatest(x.rate, 0)) OVER (PARTITION BY position ORDER BY knot ROWS UNBOUNDED PRECEDING), 3) AS rate FROM u""")
def price_prior_curve(spark, sf):
    return pr.price_prior(priced_panel(spark, sf))


@query("side_defence_record", with_sql(PLAY_SQL) + """,
g AS (SELECT season, side, event, max(goals_against) AS a FROM play WHERE goals_against IS NOT NULL GROUP BY ALL),
r AS (SELECT season, side, count(*) AS games, CAST(sum(CASE WHEN a = 0 THEN 1 ELSE 0 END) AS BIGINT) AS clean, sum(a) AS conceded FROM g GROUP BY ALL),
m AS (SELECT season, round(avg(clean / games), 3) AS league_mean FROM r GROUP BY season)
SELECT season, side, games, clean, round(clean / games, 3) AS clean_rate, round(conceded / games, 2) AS conceded_per_game, league_mean,
       round(clean / games, 3) >= round(league_mean * 1.35, 3) AS elite FROM r JOIN m USING (season)""")
def side_defence_record(spark, sf):
    return pr.side_defence(play_panel(spark, sf), by=["season"])


@query("defence_under_current_ids", with_sql(PLAY_SQL) + """,
g AS (SELECT side, event, max(goals_against) AS a FROM play WHERE season = 2000 AND goals_against IS NOT NULL GROUP BY ALL),
r AS (SELECT side, count(*) AS games FROM g GROUP BY side)
SELECT games, n_name AS short_name, (n_nationkey * 7 + 3) % 25 AS side FROM r JOIN nation ON n_nationkey = side WHERE n_nationkey % 6 <> 0""")
def defence_under_current_ids(spark, sf):
    rec = pr.side_defence(play_panel(spark, sf).where("season = 2000")).select("side", "games")
    n = table(spark, sf, "nation")
    past = n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("short_name"))
    now = n.where("n_nationkey % 6 <> 0").select(((F.col("n_nationkey") * 7 + 3) % 25).alias("id"), F.col("n_name").alias("short_name"))
    return pr.by_current_id(rec, past, now)


def typed_names(spark, sf):
    """Part names as typed by hand: letters swapped, dropped or left whole; four names to a squad."""
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    k = F.col("p_partkey")
    name = F.col("p_name")
    typo = (
        F.when(k % 5 == 0, F.concat(F.substring(name, F.lit(1), F.length(name) - 2), F.lit("x")))
        .when(k % 5 == 1, F.concat(F.substring(name, 2, 1), F.substring(name, 1, 1), F.substring(name, F.lit(3), F.length(name))))
        .when(k % 5 == 2, F.upper(name)).when(k % 5 == 3, F.element_at(F.split(name, " "), -1)).otherwise(name))
    return p.select(F.floor(k / 4).cast("bigint").alias("squad"), (k % 4).cast("int").alias("slot"), mt.fold_name(typo).alias("want"))


def name_pool(spark, sf):
    """The distinct part names, each with its lowest part key and that part's position."""
    d = table(spark, sf, "part").groupBy("p_name").agg(F.min("p_partkey").alias("entity"))
    return d.withColumn("position", position_of("entity"))


def asked_and_keys(spark, sf):
    pool = name_pool(spark, sf)
    keys = mt.name_keys(pool, "entity", [F.col("p_name"), F.element_at(F.split("p_name", " "), -1)])
    return typed_names(spark, sf).select("want").distinct(), keys, pool


def scored_names(spark, sf):
    asked, keys, pool = asked_and_keys(spark, sf)
    return mt.score_names(asked, keys, "entity"), pool


@query("fuzzy_name_scores")
def fuzzy_name_scores(spark, sf):
    scored, _ = scored_names(spark, sf)
    return scored.withColumn("score", F.round("score", 6))


@query("fuzzy_top_candidates")
def fuzzy_top_candidates(spark, sf):
    asked, keys, _ = asked_and_keys(spark, sf)
    return mt.nearest_names(asked, keys, "entity").withColumn("score", F.round("score", 6))


@query("resolve_typed_squads")
def resolve_typed_squads(spark, sf):
    asked, keys, pool = asked_and_keys(spark, sf)
    # What scores less than the last threshold is never accepted.
    near = mt.nearest_names(asked, keys, "entity", steps=(0.85, mt.MIN_MATCH))
    cand = near.join(pool.select("entity", "position"), "entity")
    return mt.resolve_squads(typed_names(spark, sf), cand, "squad", "slot", "entity", "position")
