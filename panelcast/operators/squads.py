"""Squads: legal line-ups, substitutions, armbands and the transfer bank.

A squad is fifteen picks by rule, so one row per squad with short arrays is bounded; everything else
is keyed by squad and spreads over the cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.scoring import chip_key
from panelcast.session import materialise

# Fixed values. Legal line-ups: one keeper, 3-5 defenders, 2-5 midfielders, 1-3 forwards, ten outfielders.
SHAPES = [(d, m, 10 - d - m) for d in range(3, 6) for m in range(2, 6) if 1 <= 10 - d - m <= 3]
LEAST = {"GK": 1, "DEF": 3, "MID": 2, "FWD": 1}
MOST = {"GK": 1, "DEF": 5, "MID": 5, "FWD": 3}


def best_xi(df: DataFrame, by: Sequence[str], entity: str, position: str, col: str,
            keep: Sequence[str] = (), fallback: bool = True) -> DataFrame:
    """The eleven rows with the most of `col` in a legal shape, for every group at once.

    Only the best five of a position can start, so each group shrinks to a handful of rows before
    anything is compared; Spark applies that limit below the shuffle. Ties go to the first shape.
    A group that fits no shape falls back to its eleven best rows.
    """
    by = list(by)
    rank = Window.partitionBy(*by, position).orderBy(F.desc_nulls_last(col), entity)
    rows = df.select(*by, entity, position, col, *[c for c in keep if c not in (entity, position, col, *by)])
    able = (
        rows.where(F.col(position).isin(*LEAST)).withColumn("__rn", F.row_number().over(rank)).where(F.col("__rn") <= 5)
    )
    value = F.coalesce(F.col(col).cast("double"), F.lit(0.0))
    counts = able.groupBy(*by).agg(
        *[F.count(F.when(F.col(position) == p, 1)).alias(f"__n_{p}") for p in LEAST],
        *[F.sum(F.when((F.col(position) == p) & (F.col("__rn") <= k), value).otherwise(0.0)).alias(f"__s_{p}_{k}")
          for p in LEAST for k in range(LEAST[p], MOST[p] + 1)],
    )
    options = []
    for i, (d, m, f) in enumerate(SHAPES):
        fits = (F.col("__n_GK") >= 1) & (F.col("__n_DEF") >= d) & (F.col("__n_MID") >= m) & (F.col("__n_FWD") >= f)
        total = F.col("__s_GK_1") + F.col(f"__s_DEF_{d}") + F.col(f"__s_MID_{m}") + F.col(f"__s_FWD_{f}")
        options.append(F.when(fits, F.struct(
            total.alias("total"), F.lit(-i).alias("first"), F.lit(d).alias("DEF"), F.lit(m).alias("MID"), F.lit(f).alias("FWD"))))
    chosen = counts.select(*by, F.array_max(F.array_compact(F.array(*options))).alias("__shape"))
    limit = (
        F.when(F.col(position) == "GK", 1).when(F.col(position) == "DEF", F.col("__shape.DEF"))
        .when(F.col(position) == "MID", F.col("__shape.MID")).otherwise(F.col("__shape.FWD"))
    )
    xi = able.join(chosen.where(F.col("__shape").isNotNull()), by).where(F.col("__rn") <= limit)
    xi = xi.select(*rows.columns)
    if not fallback:
        return xi
    shapeless = rows.select(*by).distinct().join(chosen.where(F.col("__shape").isNotNull()).select(*by), by, "left_anti")
    plain = Window.partitionBy(*by).orderBy(F.desc_nulls_last(col), entity)
    rest = rows.join(shapeless, by, "left_semi").withColumn("__rn", F.row_number().over(plain)).where(F.col("__rn") <= 11)
    return xi.unionByName(rest.select(*rows.columns))


def auto_subs(picks: DataFrame, by: Sequence[str], entity: str = "entity", slot: str = "slot",
              position: str = "position", minutes: str = "minutes") -> DataFrame:
    """Automatic substitutions, one row per swap: `out_entity`, `in_entity`.

    Slots 1-11 start, later ones are the bench in order. Starters without minutes are visited in slot
    order; each takes the first unused bench player who played and keeps the shape legal, keeper for
    keeper. The state of the walk is four counts and the swaps so far, folded over the squad's own
    array.
    """
    item = F.struct(F.col(slot).alias("slot"), F.col(entity).alias("id"), F.col(position).alias("pos"),
                    (F.coalesce(F.col(minutes), F.lit(0)) > 0).alias("on"))
    squads = picks.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("__p"))
    starters = F.filter("__p", lambda p: p["slot"] <= 11)

    def started_at(place: str) -> Column:
        return F.size(F.filter(starters, lambda p: p["pos"] == place))

    squads = squads.select(
        *by, F.filter(starters, lambda p: ~p["on"]).alias("__out"),
        F.filter("__p", lambda p: (p["slot"] > 11) & p["on"]).alias("__bench"),
        *[started_at(q).alias(f"__{q}") for q in LEAST],
    )
    swaps = F.array().cast("array<struct<out_entity:bigint,in_entity:bigint>>")
    start = F.struct(swaps.alias("swaps"), *[F.col(f"__{q}").alias(q) for q in LEAST])

    def visit(state: Column, out: Column) -> Column:
        def legal(b: Column) -> Column:
            free = ~F.exists(state["swaps"], lambda s: s["in_entity"] == b["id"])
            ok = free & ((out["pos"] == "GK") == (b["pos"] == "GK"))
            for q, least in LEAST.items():
                after = state[q] - (out["pos"] == q).cast("int") + (b["pos"] == q).cast("int")
                ok = ok & (after >= least)
            return ok

        pick = F.get(F.filter(F.col("__bench"), legal), 0)
        added = F.concat(state["swaps"], F.array(F.struct(
            out["id"].cast("bigint").alias("out_entity"), pick["id"].cast("bigint").alias("in_entity"))))
        moved = F.struct(added.alias("swaps"), *[
            (state[q] - (out["pos"] == q).cast("int") + (pick["pos"] == q).cast("int")).alias(q) for q in LEAST])
        return F.when(pick.isNull(), state).otherwise(moved)

    folded = F.aggregate("__out", start, visit)
    return squads.select(*by, F.explode(folded["swaps"]).alias("s")).select(*by, "s.*")


def settle(picks: DataFrame, by: Sequence[str], entity: str = "entity", minutes: str = "minutes") -> DataFrame:
    """End-of-period multipliers: the armband passes to a vice who played, subs off count zero, subs on once.

    Expects multiplier, is_captain, is_vice, subbed_in, subbed_out. Settling twice changes nothing.
    """
    squad = Window.partitionBy(*by)
    played = F.coalesce(F.col(minutes), F.lit(0)) > 0

    def of(flag: str, c: Column) -> Column:
        return F.max(F.when(F.col(flag), c)).over(squad)

    captain_mult, vice_mult = of("is_captain", F.col("multiplier")), of("is_vice", F.col("multiplier"))
    passes = (
        (captain_mult > 1) & (vice_mult <= 1) & ~of("is_captain", played) & of("is_vice", played)
    )
    passes = F.coalesce(passes, F.lit(False))
    df = picks.select("*", passes.alias("__passes"), captain_mult.alias("__armband"))
    mult = (
        F.when(F.col("__passes") & F.col("is_vice"), F.col("__armband"))
        .when(F.col("__passes") & F.col("is_captain"), F.lit(1)).otherwise(F.col("multiplier"))
    )
    final = F.when(F.col("subbed_out"), 0).when(F.col("subbed_in") & (mult == 0), 1).otherwise(mult)
    return df.withColumn("multiplier", final.cast("int")).withColumnRenamed("__passes", "armband_passed").drop("__armband")


def squad_table(picks: DataFrame, record: DataFrame, actual: DataFrame, on: Sequence[str]) -> DataFrame:
    """Picks with their prediction and outcome; a pick nobody predicted stays, with a null expectation."""
    on = list(on)
    out = picks.join(record, on, "left").join(actual, on, "left")
    label = F.concat(F.lit("#"), F.col(on[-1]).cast("string"))
    return out.withColumns({
        "name": F.coalesce(F.col("name"), label), "position": F.coalesce(F.col("position"), F.lit("?")),
        "actual": F.coalesce(F.col("actual"), F.lit(0.0)), "minutes": F.coalesce(F.col("minutes"), F.lit(0)).cast("bigint"),
    })


def model_lineup(squad: DataFrame, by: Sequence[str], entity: str = "entity", position: str = "position",
                 expected: str = "expected_points") -> DataFrame:
    """Slots for a squad of fifteen: the best legal eleven, then the bench, keeper first."""
    by = list(by)
    xi = best_xi(squad, by, entity, position, expected).select(*by, entity).withColumn("__xi", F.lit(True))
    df = squad.join(xi, [*by, entity], "left").withColumn("__xi", F.coalesce("__xi", F.lit(False)))
    start_order = F.create_map(*[x for i, p in enumerate(("GK", "DEF", "MID", "FWD")) for x in (F.lit(p), F.lit(i))])
    group = F.when(F.col("__xi"), F.element_at(start_order, F.col(position))).otherwise(
        F.when(F.col(position) == "GK", 4).otherwise(5))
    seat = Window.partitionBy(*by).orderBy("__group", F.desc_nulls_last(expected), entity)
    best = Window.partitionBy(*by).orderBy(F.desc("__xi"), F.desc_nulls_last(expected), entity)
    # At most fifteen rows of a squad meet in these windows.
    df = df.withColumn("__group", group).withColumn("__n", F.row_number().over(seat)).withColumn("__best", F.row_number().over(best))
    started = F.count(F.when(F.col("__xi"), 1)).over(Window.partitionBy(*by))
    slot = F.when(F.col("__xi"), F.col("__n")).otherwise(F.col("__n") - started + 11)
    return df.withColumn("slot", slot.cast("int")).withColumn("is_captain", F.col("__best") == 1).drop(
        "__xi", "__group", "__n", "__best")


def subbed_flags(picks: DataFrame, subs: DataFrame, by: Sequence[str], entity: str = "entity") -> DataFrame:
    outs = subs.select(*by, F.col("out_entity").alias(entity), F.lit(True).alias("subbed_out"))
    ins = subs.select(*by, F.col("in_entity").alias(entity), F.lit(True).alias("subbed_in"))
    out = picks.join(outs, [*by, entity], "left").join(ins, [*by, entity], "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("subbed_out", "subbed_in")})


def transfer_bank(history: DataFrame, bounds: DataFrame, by: Sequence[str], period: str = "period",
                  used: str = "transfers", free: str = "free", most: int = 5, name: str = "free_transfers") -> DataFrame:
    """Free transfers after the last period: one per period from the second on, banked up to `most`.

    `bounds` has the first and last period per manager (`started`, `through`). A period missing from
    the history used none; a period flagged `free` (a chip) costs none.
    """
    by = list(by)
    spent = F.when(F.coalesce(F.col(free), F.lit(False)), 0).otherwise(F.coalesce(F.col(used), F.lit(0))).cast("int")
    maps = history.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct(F.col(period).cast("int"), spent))).alias("__u"))
    weeks = F.when(F.col("through") > F.col("started"), F.sequence(F.col("started") + 1, F.col("through"))).otherwise(
        F.array().cast("array<int>"))
    bank = F.aggregate(
        weeks, F.lit(1),
        lambda ft, w: F.least(F.lit(most), F.greatest(F.lit(0), ft - F.coalesce(F.try_element_at("__u", w.cast("int")), F.lit(0))) + 1),
    )
    out = bounds.join(maps, by, "left")
    return out.withColumn("__u", F.coalesce("__u", F.create_map().cast("map<int,int>"))).select(*by, bank.alias(name))


def purchase_prices(picks: DataFrame, transfers: DataFrame, chips: DataFrame, first_prices: DataFrame, prices: DataFrame,
                    squads: DataFrame, manager: str = "manager") -> DataFrame:
    """What each pick was bought for.

    The last purchase up to the squad's period outside reverted weeks; else the price in the manager's
    first period or the earliest later one; else the current price. `squads` has manager, squad_period, started.

    A manager's reverted weeks and an entity's first prices are short lists, one entry a period at most, so transfers meet their
    manager and picks their entity once, and no pick is paired with every later price.
    """
    reverted = chips.where(F.col("chip") == "freehit").groupBy(manager).agg(F.collect_set("period").alias("__reverted"))
    kept = F.coalesce(~F.exists("__reverted", lambda p: p == F.col("period")), F.lit(True))
    paid = (
        transfers.join(squads.join(reverted, manager, "left"), manager).where((F.col("period") <= F.col("squad_period")) & kept)
        .groupBy(manager, F.col("element_in").alias("entity"))
        .agg(F.max_by("cost", F.struct("period", "time")).alias("__paid"))
    )
    started = squads.groupBy(manager).agg(F.min("started").alias("__started"))
    listed = first_prices.where(F.col("period").isNotNull()).groupBy("entity").agg(
        F.array_sort(F.collect_list(F.struct("period", "value"))).alias("__listed"))
    first = F.get(F.filter("__listed", lambda x: x["period"] >= F.col("__started")), 0)["value"]
    now = prices.select("entity", F.col("price").alias("__now"))
    return (
        picks.join(started, manager, "left").join(paid, [manager, "entity"], "left")
        .join(listed, "entity", "left").withColumn("__first", first).drop("__listed").join(now, "entity", "left")
        .select(manager, "entity", F.coalesce("__paid", "__first", "__now", F.lit(0)).cast("bigint").alias("buy_price"))
    )


def squad_period(chips: DataFrame, managers: DataFrame, last: str = "last_period", manager: str = "manager") -> DataFrame:
    """The period whose squad carries over: a free hit reverts to the one before."""
    hit = chips.where(F.col("chip") == "freehit").select(manager, F.col("period").alias(last), F.lit(True).alias("__hit"))
    out = managers.join(hit, [manager, last], "left")
    return out.withColumn("squad_period", F.col(last) - F.coalesce(F.col("__hit"), F.lit(False)).cast("int")).drop("__hit")


def season_ledger(history: DataFrame, chips: DataFrame, last: DataFrame, manager: str = "manager") -> DataFrame:
    """One row per manager and period up to the last one: transfers, hit, chip, value."""
    rows = history.join(last, manager).where(F.col("period") <= F.col("last_period")).drop("last_period")
    return rows.join(chips.select(manager, "period", "chip"), [manager, "period"], "left")


PICKS_SCHEMA = (
    "manager bigint, period int, active_chip string, picks array<struct<element:bigint,position:int,multiplier:int,is_captain:boolean,is_vice_captain:boolean>>, "
    "automatic_subs array<struct<element_in:bigint,element_out:bigint>>, entry_history struct<points:bigint,points_on_bench:bigint,event_transfers_cost:bigint,bank:bigint>"
)


def picks_of(documents: DataFrame) -> DataFrame:
    """One row per pick of nested squad documents, with who came on and off, and the squad's bank, chip and transfer cost."""
    subs = F.coalesce("automatic_subs", F.array().cast("array<struct<element_in:bigint,element_out:bigint>>"))
    rows = documents.withColumn("__subs", subs).withColumn("p", F.explode("picks"))
    came = {flag: F.array_contains(F.col(f"__subs.{side}"), F.col("p.element")) for flag, side in (("subbed_in", "element_in"), ("subbed_out", "element_out"))}
    return rows.select(
        "manager", "period", F.col("p.element").alias("entity"), F.col("p.position").alias("slot"), F.col("p.multiplier").alias("multiplier"),
        F.coalesce("p.is_captain", F.lit(False)).alias("is_captain"), F.coalesce("p.is_vice_captain", F.lit(False)).alias("is_vice"),
        *[F.coalesce(c, F.lit(False)).alias(n) for n, c in came.items()], F.col("active_chip").alias("chip"),
        F.coalesce("entry_history.bank", F.lit(0)).cast("bigint").alias("bank"), F.coalesce("entry_history.event_transfers_cost", F.lit(0)).cast("bigint").alias("transfer_cost"))


#: Chips under which transfers cost nothing and the bank stays.
KEEPING_CHIPS = ("freehit", "wildcard")


def import_teams(managers: DataFrame, picks: DataFrame, history: DataFrame, chips: DataFrame, transfers: DataFrame, first_prices: DataFrame, prices: DataFrame) -> DataFrame:
    """One row per manager: the squad as it stands after `last_period`, ready to plan the next one.

    manager, squad_period, bank, free_transfers, picks (slot, entity, buy_price), chips_used (half:chip to period) and ledger
    (period, transfers, hit, chip, value). After a free hit the squad is that of the period before. A manager who started later than
    `last_period` fails the job: there is no squad yet. `managers` has manager, started, last_period; `picks` is that of `picks_of`.
    """
    late = F.raise_error(F.concat(F.lit("no squad yet for manager "), F.col("manager").cast("string"))).cast("int")
    held_by = squad_period(chips, managers).withColumn("squad_period", F.when(F.col("last_period") < F.col("started"), late).otherwise(F.col("squad_period")))
    # read by the prices and the squads; written, so that the documents behind the picks are read once
    held = materialise(picks.join(held_by.select("manager", "squad_period"), "manager").where(F.col("period") == F.col("squad_period")), "held")
    paid = purchase_prices(held.select("manager", "entity"), transfers, chips, first_prices, prices, held_by)
    squads = held.join(paid, ["manager", "entity"]).groupBy("manager").agg(
        F.array_sort(F.collect_list(F.struct("slot", "entity", "buy_price"))).alias("picks"), F.max("bank").alias("bank"))
    keeping = chips.where(F.col("chip").isin(*KEEPING_CHIPS)).select("manager", "period", F.lit(True).alias("free")).distinct()
    bounds = held_by.select("manager", "started", F.col("last_period").alias("through"))
    free = transfer_bank(history.join(keeping, ["manager", "period"], "left"), bounds, ["manager"])
    used = chips.groupBy("manager", chip_key(F.col("chip"), F.col("period")).alias("key")).agg(F.max("period").alias("period"))
    used = used.groupBy("manager").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "period")))).alias("chips_used"))
    ledger = season_ledger(history.select("manager", "period", "transfers", "hit", "value"), chips, held_by.select("manager", "last_period"))
    ledger = ledger.groupBy("manager").agg(F.array_sort(F.collect_list(F.struct("period", "transfers", "hit", "chip", "value"))).alias("ledger"))
    out = held_by.select("manager", "squad_period").join(squads, "manager", "left")
    for part in (free, used, ledger):
        out = out.join(part, "manager", "left")
    return out.select("manager", "squad_period", F.coalesce("bank", F.lit(0)).alias("bank"), "free_transfers", "picks", "chips_used", "ledger")


def candidates(scored: DataFrame, by: Sequence[str], score: str, ties: Sequence[str], top: int = 8) -> DataFrame:
    """The best `top` rows per key, ranked; the rank limit runs below the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), *ties)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)

