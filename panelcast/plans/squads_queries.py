"""Queries for squads, transfers and matching."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelcast.operators import squads as sq
from panelcast.plans.metrics_queries import rnd
from panelcast.plans.panels import EV_SQL, LOG_SQL, ev_panel, log_panel, with_sql
from panelcast.plans.registry import query, table
from panelcast.session import materialise, scratch_path

BANK_SQL = with_sql(EV_SQL) + """,
u AS (SELECT user_id, day, CAST(count(*) AS INTEGER) AS n, bool_or(event_type = 'signup') AND day % 4 = 0 AS free FROM ev WHERE event_type <> 'view' GROUP BY user_id, day),
b AS (SELECT user_id, min(day) AS s, max(day) AS t FROM ev GROUP BY user_id),
m AS (SELECT b.user_id, s, t, list_transform(range(s + 1, t + 1), lambda d: coalesce(
   list_filter(l, lambda x: x.day = d)[1].n, 0)) AS used FROM b LEFT JOIN (SELECT user_id, list(struct_pack(day := day, n := CASE WHEN free THEN 0 ELSE n END)) AS l FROM u GROUP BY user_id) USING (user_id))
SELECT user_id, CAST(list_reduce(list_concat([1], used), lambda ft, x: least(5, greatest(0, ft - x) + 1)) AS INTEGER) AS free_transfers FROM m"""


@query("free_transfer_bank", BANK_SQL)
def free_transfer_bank(spark, sf):
    d = ev_panel(spark, sf)
    history = d.where("event_type <> 'view'").groupBy("user_id", F.col("day").alias("period")).agg(
        F.count("*").alias("transfers"), (F.max(F.col("event_type") == "signup") & (F.max("day") % 4 == 0)).alias("free"))
    bounds = d.groupBy("user_id").agg(F.min("day").alias("started"), F.max("day").alias("through"))
    return sq.transfer_bank(history, bounds, ["user_id"])




def squads(spark, sf):
    """Fifteen picks by the usual quota, the best rated of each position; two in three of them play."""
    w = Window.partitionBy("season", "period", "squad", "position").orderBy(F.desc("expected_points"), "entity")
    quota = F.when(F.col("position") == "GK", 2).when(F.col("position") == "FWD", 3).otherwise(5)
    d = log_panel(spark, sf).withColumn("squad", F.floor(F.col("entity") / 4) % 3)
    d = d.withColumn("__rp", F.row_number().over(w)).where(F.col("__rp") <= quota).drop("__rp")
    return d.withColumn("minutes", F.when((F.col("entity") + F.col("period")) % 3 == 0, 0).otherwise(F.col("minutes"))).select(
        "season", "period", "squad", "entity", "position", "expected_points", "actual", "minutes")


BY = ["season", "period", "squad"]


@query("automatic_substitutions")
def automatic_substitutions(spark, sf):
    lineup = sq.model_lineup(materialise(squads(spark, sf), "squads"), BY)
    return sq.auto_subs(lineup, BY)


def settled(spark, sf):
    lineup = materialise(sq.model_lineup(materialise(squads(spark, sf), "squads"), BY), "lineup")
    flags = sq.subbed_flags(lineup, sq.auto_subs(lineup, BY), BY)
    vice = Window.partitionBy(*BY).orderBy(F.col("is_captain").asc(), (F.col("slot") > 11).asc(), F.desc("expected_points"), "entity")
    flags = flags.withColumn("is_vice", (F.row_number().over(vice) == 1) & ~F.col("is_captain"))
    flags = flags.withColumn("multiplier", F.when(F.col("is_captain"), 2).when(F.col("slot") <= 11, 1).otherwise(0))
    return sq.settle(flags, BY)


@query("settled_squads")
def settled_squads(spark, sf):
    return settled(spark, sf).select(*BY, "entity", "slot", "multiplier", "is_captain", "is_vice", "subbed_in", "subbed_out", "armband_passed")


PICKS_SQL = """
pk AS (SELECT l_orderkey AS squad, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS slot, l_partkey AS entity, l_suppkey, l_linenumber,
  (l_partkey * 7 + l_linenumber) % 3 * 30 AS minutes FROM lineitem),
p2 AS (SELECT *, slot = 1 AS is_captain, slot = 2 AS is_vice, CASE WHEN slot = 1 THEN 2 + squad % 2 WHEN slot <= 3 THEN 1 ELSE 0 END AS mult,
  slot = 4 AND squad % 3 = 0 AS subbed_in, slot = 3 AND squad % 3 = 0 AS subbed_out FROM pk),
p3 AS (SELECT *, max(CASE WHEN is_captain THEN mult END) OVER s AS cm, coalesce(max(CASE WHEN is_captain THEN mult END) OVER s > 1 AND max(CASE WHEN is_vice THEN mult END) OVER s <= 1
  AND NOT bool_or(is_captain AND minutes > 0) OVER s AND bool_or(is_vice AND minutes > 0) OVER s, FALSE) AS passes FROM p2 WINDOW s AS (PARTITION BY squad)),
p4 AS (SELECT *, CASE WHEN passes AND is_vice THEN cm WHEN passes AND is_captain THEN 1 ELSE mult END AS m2 FROM p3)"""


@query("armband_settlement", with_sql(PICKS_SQL) + """
SELECT squad, slot, entity, CAST(CASE WHEN subbed_out THEN 0 WHEN subbed_in AND m2 = 0 THEN 1 ELSE m2 END AS INTEGER) AS multiplier, passes AS armband_passed FROM p4""")
def armband_settlement(spark, sf):
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_quantity"), "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    d = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("squad"), F.row_number().over(w).cast("bigint").alias("slot"), F.col("l_partkey").alias("entity"),
        ((F.col("l_partkey") * 7 + F.col("l_linenumber")) % 3 * 30).alias("minutes"))
    d = d.withColumns({
        "is_captain": F.col("slot") == 1, "is_vice": F.col("slot") == 2, "subbed_in": (F.col("slot") == 4) & (F.col("squad") % 3 == 0),
        "subbed_out": (F.col("slot") == 3) & (F.col("squad") % 3 == 0),
        "multiplier": F.when(F.col("slot") == 1, 2 + F.col("squad") % 2).when(F.col("slot") <= 3, 1).otherwise(0)})
    return sq.settle(d, ["squad"]).select("squad", "slot", "entity", "multiplier", "armband_passed")


# Team import: customers as managers, orders as transfers of parts.
IMPORT_SQL = """
tr AS (SELECT o_custkey AS manager, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INTEGER) AS period, o_orderkey AS time, l_partkey AS entity, l_linenumber, CAST(round(l_extendedprice) AS BIGINT) AS cost, o_orderkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
ma AS (SELECT manager, min(period) AS started, max(period) AS last_period FROM tr GROUP BY manager),
ch AS (SELECT DISTINCT manager, period, 'freehit' AS chip FROM tr WHERE (manager + period) % 6 = 0),
sp AS (SELECT ma.manager, started, last_period, last_period - CASE WHEN chip IS NOT NULL THEN 1 ELSE 0 END AS squad_period FROM ma LEFT JOIN ch ON ch.manager = ma.manager AND ch.period = last_period),
pi AS (SELECT DISTINCT manager, entity FROM tr),
pd AS (SELECT tr.manager, tr.entity, max_by(cost, (tr.period, tr.time, cost)) AS paid FROM tr JOIN sp USING (manager) LEFT JOIN ch ON ch.manager = tr.manager AND ch.period = tr.period
  WHERE tr.period <= squad_period AND ch.chip IS NULL GROUP BY ALL),
fp AS (SELECT entity, period, max(cost) AS value FROM tr WHERE entity % 3 <> 0 GROUP BY ALL),
ff AS (SELECT pi.manager, pi.entity, min_by(value, period) AS first FROM pi JOIN sp USING (manager) JOIN fp ON fp.entity = pi.entity AND fp.period >= sp.started GROUP BY ALL)"""


def import_frames(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
    tr = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("manager"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("period"), F.col("o_orderkey").alias("__t"),
        F.col("l_partkey").alias("element_in"), F.round("l_extendedprice").cast("bigint").alias("cost"))
    # every frame below reads the transfers; written, so that lines and orders meet once
    tr = materialise(tr, "transfers").withColumn("time", F.struct("__t", "cost"))
    managers = tr.groupBy("manager").agg(F.min("period").alias("started"), F.max("period").alias("last_period"))
    chips = tr.select("manager", "period").distinct().where((F.col("manager") + F.col("period")) % 6 == 0).withColumn("chip", F.lit("freehit"))
    picks = tr.select("manager", F.col("element_in").alias("entity")).distinct()
    first = tr.where("element_in % 3 <> 0").groupBy(F.col("element_in").alias("entity"), "period").agg(F.max("cost").alias("value"))
    prices = table(spark, sf, "part").select(F.col("p_partkey").alias("entity"), F.round("p_retailprice").cast("bigint").alias("price"))
    return tr, managers, chips, picks, first, prices


@query("squad_period_after_free_hit", with_sql(IMPORT_SQL) + "SELECT manager, squad_period FROM sp")
def squad_period(spark, sf):
    _, managers, chips, *_ = import_frames(spark, sf)
    return sq.squad_period(chips, managers).select("manager", "squad_period")


@query("purchase_prices", with_sql(IMPORT_SQL) + """
SELECT pi.manager, pi.entity, CAST(coalesce(paid, first, round(p_retailprice), 0) AS BIGINT) AS buy_price FROM pi LEFT JOIN pd USING (manager, entity) LEFT JOIN ff USING (manager, entity)
LEFT JOIN part ON p_partkey = pi.entity""")
def purchase_prices(spark, sf):
    tr, managers, chips, picks, first, prices = import_frames(spark, sf)
    return sq.purchase_prices(picks, tr, chips, first, prices, sq.squad_period(chips, managers))


@query("season_ledger", with_sql(IMPORT_SQL) + """
SELECT t.manager, t.period, CAST(count(*) AS BIGINT) AS transfers, CAST(sum(cost) AS BIGINT) AS value, max(chip) AS chip FROM tr t LEFT JOIN ch ON ch.manager = t.manager AND ch.period = t.period GROUP BY t.manager, t.period""")
def season_ledger(spark, sf):
    tr, managers, chips, *_ = import_frames(spark, sf)
    h = tr.groupBy("manager", "period").agg(F.count("*").alias("transfers"), F.sum("cost").alias("value"))
    return sq.season_ledger(h, chips, managers.select("manager", "last_period"))


def squad_documents(tr):
    """A nested document per manager and period: what was bought then, the captain first."""
    bought = tr.groupBy("manager", "period").agg(F.array_sort(F.collect_set(F.struct("element_in"))).alias("bought"))

    def pick(p, i):
        slot = i + 1
        return F.struct(p["element_in"].alias("element"), slot.alias("position"), F.when(slot == 1, 2).otherwise(1).alias("multiplier"),
                        (slot == 1).alias("is_captain"), (slot == 2).alias("is_vice_captain"))

    bank = ((F.col("manager") * 7 + F.col("period")) % 50).cast("bigint")
    none = F.array().cast("array<struct<element_in:bigint,element_out:bigint>>")
    return bought.withColumn("picks", F.transform("bought", pick)).select(
        "manager", "period", F.lit(None).cast("string").alias("active_chip"), "picks", none.alias("automatic_subs"),
        F.struct(F.lit(0).cast("bigint").alias("points"), F.lit(0).cast("bigint").alias("points_on_bench"), F.lit(0).cast("bigint").alias("event_transfers_cost"), bank.alias("bank")).alias("entry_history"))


@query("team_import", with_sql(IMPORT_SQL) + """,
hi AS (SELECT manager, period, count(*) AS n, CAST(sum(cost) AS BIGINT) AS value FROM tr GROUP BY ALL),
pk AS (SELECT DISTINCT tr.manager, tr.entity FROM tr JOIN sp ON sp.manager = tr.manager AND tr.period = sp.squad_period),
bp AS (SELECT pk.manager, count(*) AS n, CAST(sum(coalesce(paid, first, round(p_retailprice), 0)) AS BIGINT) AS spent FROM pk LEFT JOIN pd USING (manager, entity) LEFT JOIN ff USING (manager, entity)
  LEFT JOIN part ON p_partkey = pk.entity GROUP BY pk.manager),
us AS (SELECT sp.manager, list_transform(range(started + 1, last_period + 1), lambda d: coalesce(list_filter(l, lambda x: x.period = d)[1].n, 0)) AS used
  FROM sp LEFT JOIN (SELECT hi.manager, list(struct_pack(period := hi.period, n := CASE WHEN chip IS NOT NULL THEN 0 ELSE n END)) AS l FROM hi LEFT JOIN ch USING (manager, period) GROUP BY hi.manager) USING (manager))
SELECT sp.manager, sp.squad_period, CAST(CASE WHEN bp.n IS NULL THEN 0 ELSE (sp.manager * 7 + sp.squad_period) % 50 END AS BIGINT) AS bank,
  CAST(list_reduce(list_concat([1], used), lambda ft, x: least(5, greatest(0, ft - x) + 1)) AS INTEGER) AS free_transfers, CAST(coalesce(bp.n, 0) AS INTEGER) AS picks, coalesce(spent, 0) AS spent,
  coalesce((SELECT string_agg('2:' || chip || '=' || last, ',') FROM (SELECT chip, max(period) AS last FROM ch WHERE ch.manager = sp.manager GROUP BY chip)), '') AS chips,
  (SELECT CAST(count(*) AS INTEGER) FROM hi WHERE hi.manager = sp.manager) AS periods, (SELECT CAST(sum(value) AS BIGINT) FROM hi WHERE hi.manager = sp.manager) AS value
FROM sp LEFT JOIN bp USING (manager) JOIN us USING (manager)""")
def team_import(spark, sf):
    """Every manager's team, bank, chips and ledger in one row, from nested documents."""
    tr, managers, chips, _, first, prices = import_frames(spark, sf)
    path = scratch_path(spark, "picks")
    squad_documents(tr).write.json(path)
    picks = sq.picks_of(spark.read.schema(sq.PICKS_SCHEMA).json(path))
    history = tr.groupBy("manager", "period").agg(F.count("*").alias("transfers"), F.sum("cost").alias("value")).withColumn("hit", F.lit(0))
    t = sq.import_teams(managers, picks, history, chips, tr, first, prices)
    used = F.transform(F.map_entries("chips_used"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    n = F.coalesce(F.size("picks"), F.lit(0))
    spent = F.coalesce(F.aggregate("picks", F.lit(0).cast("bigint"), lambda a, p: a + p["buy_price"]), F.lit(0))
    return t.select("manager", "squad_period", "bank", "free_transfers", F.when(F.col("picks").isNull(), 0).otherwise(n).alias("picks"), spent.alias("spent"),
                    F.coalesce(F.array_join(used, ","), F.lit("")).alias("chips"), F.size("ledger").alias("periods"), F.aggregate("ledger", F.lit(0).cast("bigint"), lambda a, x: a + x["value"]).alias("value"))


@query("squad_table", with_sql(LOG_SQL) + """,
pk AS (SELECT season, period, entity, CAST(entity % 15 + 1 AS INTEGER) AS slot FROM log),
re AS (SELECT season, period, entity, position, expected_points, 'c' || entity AS name FROM log WHERE entity % 4 <> 0), ac AS (SELECT season, period, entity, actual, minutes FROM log WHERE entity % 5 <> 0)
SELECT season, period, entity, slot, coalesce(name, '#' || entity) AS name, coalesce(position, '?') AS position, expected_points, coalesce(actual, 0) AS actual, coalesce(minutes, 0) AS minutes
FROM pk LEFT JOIN re USING (season, period, entity) LEFT JOIN ac USING (season, period, entity)""")
def squad_table(spark, sf):
    log = log_panel(spark, sf)
    on = ["season", "period", "entity"]
    picks = log.select(*on, (F.col("entity") % 15 + 1).cast("int").alias("slot"))
    record = log.where("entity % 4 <> 0").select(*on, "position", "expected_points", F.concat(F.lit("c"), F.col("entity").cast("string")).alias("name"))
    actual = log.where("entity % 5 <> 0").select(*on, "actual", "minutes")
    return sq.squad_table(picks, record, actual, on)


@query("top_candidates_per_key", """
SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, l_quantity, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS rank FROM lineitem) WHERE rank <= 8""")
def top_candidates(spark, sf):
    d = table(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice")
    return sq.candidates(d, ["l_partkey"], "l_quantity", ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"]).drop("l_extendedprice")
