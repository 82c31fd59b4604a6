"""Priors: what a price buys, and which sides rarely concede."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
PRICE_BAND, MIN_ENTITIES, MIN_BAND = 5, 12, 4
ELITE_RATIO = 1.35


def price_prior(panel: DataFrame, group: str = "season", entity: str = "entity", position: str = "position", period: str = "period",
                points: str = "points", price: str = "value") -> DataFrame:
    """Knots of points per period by price for each position: position, knot, price, rate.

    Prices fall in fixed half-unit bands. A thin band is merged forward into the next; what is left over
    at the end is averaged into the last knot. A dearer knot is never worth less than a cheaper one.
    Bands are few, so each position's bands are one short array, folded once.
    """
    per_group = panel.groupBy(group).agg(F.count_distinct(period).alias("__p"))
    periods = per_group.agg(F.greatest(F.lit(1), F.floor(F.avg("__p"))).alias("__n"))
    each = panel.groupBy(group, entity, position).agg(F.coalesce(F.sum(points), F.lit(0.0)).alias("pts"), F.avg(price).alias("price"))
    each = each.where(F.col("price").isNotNull() & F.col(position).isNotNull()).withColumn("rate", F.col("pts") / periods.scalar())
    # Distinct prices are counted before the median, so its memory is one entry per price of a band.
    bands = each.groupBy(position, F.floor(F.col("price") / PRICE_BAND).alias("band")).agg(
        F.percentile("price", F.lit(0.5)).alias("price"), F.avg("rate").alias("rate"), F.count("*").alias("n"))
    lists = bands.groupBy(position).agg(
        F.array_sort(F.collect_list(F.struct("price", F.col("rate"), F.col("n")))).alias("__b"), F.sum("n").alias("__all"))
    lists = lists.where(F.col("__all") >= MIN_ENTITIES)
    knot = "array<struct<price:double,rate:double>>"
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("p"), F.array().cast(knot).alias("k"))

    def merge(st: Column, b: Column) -> Column:
        n, s = st["n"] + b["n"], st["s"] + b["rate"] * b["n"]
        full = n >= MIN_BAND
        added = F.concat(st["k"], F.array(F.struct(b["price"].alias("price"), (s / n).alias("rate"))))
        return F.struct(F.when(full, F.lit(0).cast("bigint")).otherwise(n).alias("n"), F.when(full, 0.0).otherwise(s).alias("s"),
                        b["price"].alias("p"), F.when(full, added).otherwise(st["k"]).alias("k"))

    def finish(st: Column) -> Column:
        last = F.element_at(st["k"], -1)
        mixed = F.struct(st["p"].alias("price"), ((last["rate"] + st["s"] / st["n"]) / 2).alias("rate"))
        head = F.slice(st["k"], 1, F.greatest(F.size(st["k"]) - 1, F.lit(0)))
        return F.when((st["n"] > 0) & (F.size(st["k"]) > 0), F.concat(head, F.array(mixed))).otherwise(st["k"])

    merged = lists.select(position, F.aggregate("__b", start, merge, finish).alias("__k"))
    top = F.aggregate(
        "__k", F.array().cast(knot),
        lambda acc, x: F.concat(acc, F.array(F.struct(
            x["price"].alias("price"),
            F.greatest(x["rate"], F.coalesce(F.get(acc, F.size(acc) - 1)["rate"], F.lit(0.0))).alias("rate")))))
    out = merged.select(position, F.posexplode(top).alias("knot", "__x"))
    return out.select(position, "knot", F.round("__x.price", 1).alias("price"), F.round("__x.rate", 3).alias("rate"))


def side_defence(panel: DataFrame, side: str = "side", event: str = "event", against: str = "goals_against", by: Sequence[str] = ()) -> DataFrame:
    """Per side: games, clean ones, conceded, and whether the rate stands out.

    Rates are rounded before they are compared, so what is shown and what is decided agree.
    """
    by = list(by)
    games = panel.where(F.col(against).isNotNull()).groupBy(*by, side, event).agg(F.max(against).alias("__a"))
    rec = games.groupBy(*by, side).agg(
        F.count("*").alias("games"), F.sum((F.col("__a") == 0).cast("bigint")).alias("clean"), F.sum("__a").alias("conceded"))
    rec = rec.withColumn("__rate", F.col("clean") / F.col("games"))
    mean = rec.groupBy(*by).agg(F.round(F.avg("__rate"), 3).alias("league_mean"))
    rec = rec.join(mean, by) if by else rec.withColumn("league_mean", mean.scalar())
    threshold = F.round(F.col("league_mean") * ELITE_RATIO, 3)
    rate = F.round("__rate", 3)
    return rec.select(*by, side, "games", "clean", rate.alias("clean_rate"), F.round(F.col("conceded") / F.col("games"), 2).alias("conceded_per_game"),
                      "league_mean", (rate >= threshold).alias("elite"))


def by_current_id(records: DataFrame, past: DataFrame, current: DataFrame, side: str = "side") -> DataFrame:
    """Past records under today's ids, joined on the short name; sides that left are absent."""
    old = past.select(F.col("id").alias(side), "short_name")
    new = current.select("short_name", F.col("id").alias("current_side"))
    return records.join(old, side).join(new, "short_name").drop(side).withColumnRenamed("current_side", side)
