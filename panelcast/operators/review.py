"""Predicted against actual."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.scoring import ACTUAL_TERMS, IDENTIFIER_TO_TERM, POSITIONS
from panelcast.operators.metrics import mae, rmse, spearman_by_position
from panelcast.operators.panel import clean_number, is_playing


def top_n(df: DataFrame, by: str, ties: Sequence[str], n: int, ascending: bool = False) -> DataFrame:
    """The first `n` rows; a total order, so the answer is the same on every run."""
    first = F.col(by).asc_nulls_last() if ascending else F.col(by).desc_nulls_last()
    return df.orderBy(first, *ties).limit(n)


# -- actuals from the live feed -----------------------------------------------------------------

LIVE_SCHEMA = (
    "elements array<struct<id:bigint,stats:map<string,string>,"
    "explain:array<struct<fixture:bigint,stats:array<struct<identifier:string,points:double,value:double>>>>>>"
)


def term_of(identifier: Column) -> Column:
    pairs = [F.lit(x) for kv in IDENTIFIER_TO_TERM.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), identifier), F.lit("other"))


def explain_terms(explain: str = "explain") -> dict[str, Column]:
    """Points per term out of the nested scoring events, row by row: nothing is exploded or shuffled.

    An element without events keeps zeros, so the terms always add up to the recorded total.
    """
    items = F.flatten(F.transform(F.coalesce(F.col(explain), F.array()), lambda e: F.coalesce(e["stats"], F.array())))
    terms = F.transform(items, lambda s: F.struct(
        term_of(s["identifier"]).alias("t"), F.coalesce(s["points"].cast("double"), F.lit(0.0)).alias("p")))

    def total(term: str) -> Column:
        return F.aggregate(F.filter(terms, lambda x: x["t"] == term), F.lit(0.0), lambda a, x: a + x["p"])

    return {f"act_{t}": total(t) for t in ACTUAL_TERMS}


def term_totals(rows: DataFrame, keys: Sequence[str], term: Column, points: Column) -> DataFrame:
    rows = rows.select(*keys, term.alias("__term"), F.coalesce(points.cast("double"), F.lit(0.0)).alias("__points"))
    return rows.groupBy(*keys).agg(*[
        F.sum(F.when(F.col("__term") == t, F.col("__points")).otherwise(0.0)).alias(f"act_{t}") for t in ACTUAL_TERMS
    ])


def parse_live(live: DataFrame) -> DataFrame:
    """A live document per row: each element's minutes, points, raw stats and points by term."""
    elements = live.select(F.explode("elements").alias("e")).select("e.*")

    def stat(key: str) -> Column:
        return F.coalesce(F.try_element_at("stats", F.lit(key)).try_cast("double"), F.lit(0.0))

    whole = {"minutes": "minutes", "goals_scored": "goals_scored", "assists_n": "assists", "clean_sheets": "clean_sheets",
             "bonus_n": "bonus", "bps": "bps", "yellow": "yellow_cards", "red": "red_cards", "saves_n": "saves"}
    return elements.select(
        F.col("id").alias("entity"), *[stat(k).cast("bigint").alias(n) for n, k in whole.items()],
        stat("total_points").alias("actual"), stat("expected_goals").alias("xg"), stat("expected_assists").alias("xa"),
        *[c.alias(n) for n, c in explain_terms().items()],
    )


def join_actuals(record: DataFrame, actual: DataFrame, on: Sequence[str], labels: DataFrame | None = None,
                 side: str = "side", expected: str = "expected_points") -> DataFrame:
    """Every predicted entity with what it scored; no actual row means it did not play."""
    out = record.join(actual, list(on), "left")
    present = set(actual.columns)
    zeroed = {"minutes": F.coalesce(F.col("minutes"), F.lit(0)).cast("bigint"),
              "actual": F.coalesce(F.col("actual"), F.lit(0.0))}
    for t in ACTUAL_TERMS:
        c = f"act_{t}"
        zeroed[c] = F.coalesce(F.col(c), F.lit(0.0)) if c in present else F.lit(0.0)
    out = out.withColumns(zeroed)
    if labels is not None:
        out = out.join(labels, side, "left").withColumn("label", F.coalesce("label", F.lit("—")))
    return out.withColumn("diff", F.col("actual") - F.col(expected))


def event_labels(events: DataFrame, names: DataFrame, keys: Sequence[str] = (), order: str = "event") -> DataFrame:
    """Per side the text of its events, `'SUN (H) 5-3'`, doubles joined by ', ', unplayed as '—'.

    `events` has home, away, home_goals, away_goals; `names` has side and short_name.
    """
    done = F.col("home_goals").isNotNull() & F.col("away_goals").isNotNull()

    def side(me: str, other: str, flag: str) -> Column:
        mark = F.when(done, F.concat_ws("-", F.col(f"{me}_goals").cast("bigint").cast("string"),
                                        F.col(f"{other}_goals").cast("bigint").cast("string"))).otherwise(F.lit("—"))
        return F.struct(F.col(me).alias("side"), F.col(other).alias("__opp"), F.lit(flag).alias("__flag"), mark.alias("__mark"))

    sides = events.select(*keys, F.col(order).alias("__order"),
                          F.explode(F.array(side("home", "away", "H"), side("away", "home", "A"))).alias("s")
                          ).select(*keys, "__order", "s.*")
    other = names.select(F.col("side").alias("__opp"), "short_name")
    text = F.concat(F.coalesce(F.col("short_name"), F.lit("?")), F.lit(" ("), F.col("__flag"), F.lit(") "), F.col("__mark"))
    return (
        sides.join(other, "__opp", "left").select(*keys, "side", F.struct("__order", text.alias("text")).alias("__l"))
        .groupBy(*keys, "side").agg(F.array_sort(F.collect_list("__l")).alias("__ls"))
        .select(*keys, "side", F.array_join(F.transform("__ls", lambda x: x["text"]), ", ").alias("label"))
    )


# -- the log ------------------------------------------------------------------------------------


def unknown_if_missing(df: DataFrame, cols: Sequence[str] = ("odds_priced", "fingerprint")) -> DataFrame:
    """Rows logged before a build column existed read "unknown"."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit("unknown")) if c in df.columns else F.lit("unknown") for c in cols})


def upsert_partition(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Replace exactly the partitions present in `df`; writing the same period again changes nothing.

    Rows are gathered by partition for few files, and a partition too large for one task is split at run time.
    """
    (df.hint("rebalance", *keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*keys).parquet(path))


# -- reports ------------------------------------------------------------------------------------


def _ratio(predicted: Column, actual: Column) -> Column:
    return F.when(F.abs(predicted) > 1e-9, actual / predicted)


def _term_sums(log: DataFrame, terms: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Sum every term first, then turn the few summed columns into rows: no row is multiplied before the shuffle."""
    sums = log.groupBy(*by).agg(
        *[(F.sum(t) if t in log.columns else F.lit(0.0)).alias(f"p_{t}") for t in terms],
        *[F.sum(f"act_{t}").alias(f"a_{t}") for t in terms],
        F.sum("expected_points").alias("p_total"), F.sum("actual").alias("a_total"),
    )
    return sums


def _long(sums: DataFrame, terms: Sequence[str], by: Sequence[str]) -> DataFrame:
    each = F.array(*[
        F.struct(F.lit(t).alias("term"), F.coalesce(F.col(f"p_{t}"), F.lit(0.0)).alias("predicted"),
                 F.coalesce(F.col(f"a_{t}"), F.lit(0.0)).alias("actual")) for t in terms
    ])
    long = sums.select(*by, F.explode(each).alias("__t")).select(*by, "__t.*")
    return long.withColumn("ratio", _ratio(F.col("predicted"), F.col("actual")))


def calibration(log: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Summed predicted and actual points per term and in total, and their ratio."""
    return _long(_term_sums(log, ACTUAL_TERMS, by), [*ACTUAL_TERMS, "total"], by)


# Terms that say something by position.
POSITION_TERMS = ("goals", "assists", "clean_sheet", "goals_conceded", "saves", "defcon", "bonus")


def calibration_by_position(log: DataFrame, by: Sequence[str] = (), position: str = "position") -> DataFrame:
    """As `calibration` per term and position; cells empty on both sides are left out."""
    keys = [*by, position]
    log = log.where(F.col(position).isin(*POSITIONS))
    long = _long(_term_sums(log, POSITION_TERMS, keys), POSITION_TERMS, keys)
    return long.where((F.abs("predicted") >= 1e-9) | (F.abs("actual") >= 1e-9))


# Points actually scored, both bounds included, as (label, low, high).
OUTCOME_BUCKETS = (("0 or less", None, 0.0), ("1-2", 1.0, 2.0), ("3-4", 3.0, 4.0), ("5+", 5.0, None))
# Predicted appearance points, low excluded and high included.
APPEARANCE_BANDS = (("under 0.25", None, 0.25), ("0.25-0.75", 0.25, 0.75), ("0.75-1.25", 0.75, 1.25),
                    ("1.25-1.75", 1.25, 1.75), ("over 1.75", 1.75, None))


def band_label(value: Column, bands, low_included: bool) -> Column:
    out = None
    for label, low, high in bands:
        cond = F.lit(True)
        if low is not None:
            cond = cond & ((value >= low) if low_included else (value > low))
        if high is not None:
            cond = cond & (value <= high)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out


def with_all_bands(df: DataFrame, name: str, bands) -> DataFrame:
    """Every band appears, an empty one with n = 0."""
    spark = df.sparkSession
    dim = spark.createDataFrame([(i, b[0]) for i, b in enumerate(bands)], f"__i int, {name} string")
    return dim.join(df, name, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint"))).drop("__i")


def outcome_buckets(log: DataFrame, forecasters: Mapping[str, str], actual: str = "actual",
                    require: str | None = "xp_external") -> DataFrame:
    """Mean, MAE and RMSE of each forecaster by what was really scored, on the same rows."""
    rows = log.where(is_playing())
    if require:
        rows = rows.where(F.col(require).isNotNull())
    rows = rows.withColumn("bucket", band_label(F.col(actual), OUTCOME_BUCKETS, True)).where(F.col("bucket").isNotNull())
    aggs = [F.count("*").alias("n"), F.avg(actual).alias("actual_mean")]
    for who, col in forecasters.items():
        aggs += [F.avg(col).alias(f"{who}_mean"), mae(actual, col).alias(f"{who}_mae"), rmse(actual, col).alias(f"{who}_rmse")]
    return with_all_bands(rows.groupBy("bucket").agg(*aggs), "bucket", OUTCOME_BUCKETS)


def minutes_calibration(log: DataFrame, predicted: str = "appearance", actual: str = "act_appearance",
                        minutes: str = "minutes") -> DataFrame:
    """The playing-time call against who played, by band of the predicted appearance points."""
    rows = log.withColumn("band", band_label(F.col(predicted), APPEARANCE_BANDS, False)).where(F.col("band").isNotNull())
    out = rows.groupBy("band").agg(
        F.count("*").alias("n"), F.avg(predicted).alias("predicted"), F.avg(actual).alias("actual"),
        F.avg((F.col(minutes) == 0).cast("double")).alias("none"), F.avg((F.col(minutes) >= 60).cast("double")).alias("hour"),
    )
    return with_all_bands(out, "band", APPEARANCE_BANDS)


def head_to_head(log: DataFrame, forecasters: Mapping[str, str], require: str, by: Sequence[str] = ("season", "period"),
                 entity: str = "entity", position: str = "position", actual: str = "actual",
                 xi_ties: Sequence[str] = (), strategy: str = "direct") -> DataFrame:
    """Per period and over all: MAE, within-position rank and best-XI points of each forecaster.

    The overall row weights MAE by rows, averages the ranks and sums the XI points.
    """
    from panelcast.operators.squads import best_xi

    by = list(by)
    playing = log.where(is_playing() & F.col(require).isNotNull())
    out = log.select(*by).distinct()
    errors = playing.groupBy(*by).agg(F.count("*").alias("n"), *[mae(actual, c).alias(f"{w}_mae") for w, c in forecasters.items()])
    out = out.join(errors, by, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    for who, col in forecasters.items():
        rank = spearman_by_position(playing, by, position, actual, col, f"{who}_rank", strategy)
        pool = log.where(F.col(col).isNotNull())
        big = pool.groupBy(*by).agg(F.count("*").alias("__pool")).where(F.col("__pool") >= 11).drop("__pool")
        xi = best_xi(pool, by, entity, position, col, keep=[actual])
        points = xi.groupBy(*by).agg(F.sum(actual).alias(f"{who}_xi")).join(big, by, "left_semi")
        out = out.join(rank, by, "left").join(points, by, "left")
    label = F.concat_ws("-", *[F.col(c).cast("string") for c in by])
    per = out.select(label.alias("period"), "n", *[f"{w}_{m}" for w in forecasters for m in ("mae", "rank", "xi")])
    weight = F.greatest(F.col("n"), F.lit(1))
    total = per.agg(F.sum("n").alias("n"), *[
        c for w in forecasters for c in (
            (F.sum(F.coalesce(F.col(f"{w}_mae"), F.lit(0.0)) * weight) / F.sum(weight)).alias(f"{w}_mae"),
            F.avg(f"{w}_rank").alias(f"{w}_rank"), F.coalesce(F.sum(f"{w}_xi"), F.lit(0.0)).alias(f"{w}_xi"))
    ]).withColumn("period", F.lit("all"))
    return per.unionByName(total)


def track_record(log: DataFrame, keys: Sequence[str], period: str = "period", expected: str = "expected_points",
                 external: str = "xp_external", actual: str = "actual", minutes: str = "minutes") -> DataFrame:
    """Per entity the ordered list of periods with something to be right or wrong about.

    One element per period of a season, so a list is bounded by the calendar.
    """
    worth = (F.col(expected) >= 0.5) | (F.col(minutes) > 0)
    item = F.struct(
        F.col(period).cast("int").alias("period"), clean_number(F.col(expected)).alias("expected"),
        clean_number(F.col(external)).alias("external"), clean_number(F.col(actual), 0).alias("actual"),
        F.col(minutes).cast("bigint").alias("minutes"),
    )
    return log.where(worth).groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("track"))


def largest_misses(table: DataFrame, ties: Sequence[str], top: int = 8, rated: int = 60, diff: str = "diff",
                   minutes: str = "minutes", expected: str = "expected_points") -> tuple[DataFrame, DataFrame]:
    """Biggest over-deliveries among those who played, and biggest under-deliveries among the best rated."""
    over = top_n(table.where(F.col(minutes) > 0), diff, ties, top)
    under = top_n(top_n(table, expected, ties, rated), diff, ties, top, ascending=True)
    return over, under


def squad_totals(rows: DataFrame, by: Sequence[str], multiplier: str = "multiplier", actual: str = "actual",
                 expected: str = "expected_points") -> DataFrame:
    counted = rows.where(F.col(multiplier) > 0)
    m = F.col(multiplier)
    return counted.groupBy(*by).agg(
        F.sum(F.col(actual) * m).alias("scored"), F.sum(F.coalesce(F.col(expected), F.lit(0.0)) * m).alias("expected"))


def prediction_record(rows: DataFrame, keys: Sequence[str], summed: Sequence[str], largest: Sequence[str],
                      first: Sequence[str], event: str = "event", order: Sequence[str] = ("event",)) -> DataFrame:
    """One row per entity and period: points and minutes summed over its events, probabilities at their largest."""
    return rows.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in summed], *[F.max(c).alias(c) for c in largest],
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in first],
        F.count_distinct(event).alias("events"),
    )
