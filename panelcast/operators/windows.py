"""Lagged window features: everything is known at the end of the previous period.

Two physical plans give the same values.

``direct``   one shuffle by (group, entity) and row-level windows. The cheapest plan while every
             entity fits a task.
``collapse`` rows are first aggregated per (group, entity, period), with map-side combine, and the
             windows run over periods only; the values are joined back by (group, entity, period).
             An entity that holds a third of all rows is spread over its periods and over map tasks.
The caller picks; nothing is counted while the plan is built. Means may differ in their last bits
between the plans, as sums of doubles do in another order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelcast.spec import PanelSpec

STATS: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count,
    "std": F.stddev_samp, "var": F.var_samp,
}
_COMBINABLE = ("mean", "sum", "min", "max")


@dataclass(frozen=True)
class Lagged:
    """One requested feature; build it with `rolling`, `expanding` or `nth_previous`."""

    name: str
    col: str
    kind: str                                     # rolling | expanding | nth
    size: int = 0
    # A name, or a function of (column, window frame) for anything composed of several aggregates.
    stat: str | Callable[[Column, WindowSpec], Column] = "mean"
    min_periods: int = 1

    def collapsible(self) -> bool:
        if self.kind == "nth":
            return self.size <= 2
        simple = isinstance(self.stat, str) and self.stat in _COMBINABLE
        return simple and (self.kind == "expanding" or self.min_periods == 1)


def rolling(col: str, window: int, stat="mean", min_periods: int = 1, name: str | None = None) -> Lagged:
    if window < 1 or not 1 <= min_periods <= window:
        raise ValueError("need 1 <= min_periods <= window")
    return Lagged(name or f"{col}_r{window}", col, "rolling", window, stat, min_periods)


def expanding(col: str, stat="mean", min_periods: int = 1, name: str | None = None) -> Lagged:
    return Lagged(name or f"{col}_todate", col, "expanding", 0, stat, min_periods)


def nth_previous(col: str, n: int = 1, name: str | None = None) -> Lagged:
    if n < 1:
        raise ValueError("n must be >= 1")
    return Lagged(name or f"{col}_lag{n}", col, "nth", n)


def attach_lagged(
    df: DataFrame, spec: PanelSpec, lags: Iterable[Lagged], strategy: str = "direct"
) -> DataFrame:
    """`df` with one column per request, each as it stood when the row's period began."""
    lags = list(lags)
    if not lags:
        return df
    if strategy == "direct":
        return _direct(df, spec, lags)
    if strategy == "collapse":
        bad = [x.name for x in lags if not x.collapsible()]
        if bad:
            raise ValueError(f"not expressible from per-period partial results: {bad}")
        return _collapse(df, spec, lags)
    raise ValueError(f"unknown strategy {strategy!r}")


def as_of_previous_period(
    df: DataFrame, inclusive: dict[str, Column], spec: PanelSpec
) -> DataFrame:
    """Replace running values by the ones that held at the end of the previous existing period.

    Each value of `inclusive` may look at its own row; the result may not. The last non-null
    value of a period stands for the period, and all rows of a period get the same answer.
    """
    names = list(inclusive)
    running = {n: f"__run_{n}" for n in names}
    closing = {n: f"__close_{n}" for n in names}
    in_period = (
        Window.partitionBy(*spec.period_keys).orderBy(spec.time, spec.event)
        .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    before = Window.partitionBy(*spec.keys).orderBy(spec.period).rangeBetween(Window.unboundedPreceding, -1)
    keep = df.columns
    df = df.select(*keep, *[inclusive[n].alias(running[n]) for n in names])
    df = df.select(*keep, *[F.last(running[n], ignorenulls=True).over(in_period).alias(closing[n]) for n in names])
    return df.select(*keep, *[F.last(closing[n]).over(before).alias(n) for n in names])


def _gated(lag: Lagged, frame: WindowSpec) -> Column:
    c = F.col(lag.col)
    value = STATS[lag.stat](c).over(frame) if isinstance(lag.stat, str) else lag.stat(c, frame)
    if lag.min_periods > 1 or lag.stat == "count":
        value = F.when(F.count(lag.col).over(frame) >= lag.min_periods, value)
    return value


def _direct(df: DataFrame, spec: PanelSpec, lags: list[Lagged]) -> DataFrame:
    rows = Window.partitionBy(*spec.keys).orderBy(*spec.order)
    earlier = Window.partitionBy(*spec.keys).orderBy(spec.period).rangeBetween(Window.unboundedPreceding, -1)
    # To-date values need no carry: their frame simply stops before the period.
    to_date = [x for x in lags if x.kind == "expanding"]
    inclusive: dict[str, Column] = {}
    for x in lags:
        if x.kind == "rolling":
            inclusive[x.name] = _gated(x, rows.rowsBetween(-(x.size - 1), 0))
        elif x.kind == "nth":
            inclusive[x.name] = F.lag(x.col, x.size - 1).over(rows) if x.size > 1 else F.col(x.col)
    names = [x.name for x in lags]
    keep = df.columns
    # The row order of the inclusive values also serves the coarser order of the to-date frame: one sort.
    if inclusive:
        df = as_of_previous_period(df, inclusive, spec)
    if to_date:
        df = df.select(*df.columns, *[_gated(x, earlier).alias(x.name) for x in to_date])
    return df.select(*keep, *names)


def _collapse(df: DataFrame, spec: PanelSpec, lags: list[Lagged]) -> DataFrame:
    keys, per = spec.keys, spec.period_keys
    cols = list(dict.fromkeys(x.col for x in lags))
    base = df.select(*per, spec.time, spec.event, *[F.col(c).alias(f"__v_{c}") for c in cols])
    moment = F.struct(spec.time, spec.event)

    def v(c: str) -> Column:
        return F.col(f"__v_{c}")

    aggs: dict[str, Column] = {}
    for x in lags:
        if x.kind == "expanding":
            part = "sum" if x.stat == "mean" else x.stat
            aggs[f"__{part}_{x.col}"] = STATS[part](v(x.col))
            aggs[f"__n_{x.col}"] = F.count(v(x.col))
        else:
            aggs[f"__last_{x.col}"] = F.max_by(v(x.col), F.when(v(x.col).isNotNull(), moment))
        if x.kind == "nth" and x.size == 2:
            aggs[f"__row_{x.col}"] = F.max_by(F.struct(v(x.col).alias("v")), moment)["v"]
    periods = base.groupBy(*per).agg(F.max(moment).alias("__end"), *[c.alias(n) for n, c in aggs.items()])

    width = max([x.size for x in lags if x.kind == "rolling"], default=0)
    if width:
        periods = periods.join(_rolling_ends(base, spec, lags, width, v), per, "left")
    for c in dict.fromkeys(x.col for x in lags if x.kind == "nth" and x.size == 2):
        periods = periods.join(_last_but_one(base, spec, c, v), per, "left")

    step = Window.partitionBy(*keys).orderBy(spec.period)
    past = step.rowsBetween(Window.unboundedPreceding, -1)
    out = []
    for x in lags:
        if x.kind == "expanding":
            n = F.sum(f"__n_{x.col}").over(past)
            if x.stat == "mean":
                value = F.try_divide(F.sum(f"__sum_{x.col}").over(past), n)
            else:
                value = STATS[x.stat](F.col(f"__{x.stat}_{x.col}")).over(past)
            out.append(F.when(n >= x.min_periods, value).alias(x.name))
        else:
            out.append(F.lag(f"__close_{x.name}").over(step).alias(x.name))
    closes = [
        F.coalesce(F.col(f"__roll_{x.name}"), F.col(f"__last_{x.col}"), F.col(f"__pre_{x.name}"))
        if x.kind == "rolling" else F.col(f"__last_{x.col}")
        for x in lags if x.kind == "rolling" or (x.kind == "nth" and x.size == 1)
    ]
    names = [x.name for x in lags if x.kind == "rolling" or (x.kind == "nth" and x.size == 1)]
    two = [x for x in lags if x.kind == "nth" and x.size == 2]
    periods = periods.select(
        "*",
        *[c.alias(f"__close_{n}") for n, c in zip(names, closes)],
        # Two events back: inside the period if it reaches that far, else the closing row before it.
        *[F.coalesce(F.col(f"__deep_{x.col}"), F.lag(f"__row_{x.col}").over(step)).alias(f"__close_{x.name}")
          for x in two],
    )
    return df.join(periods.select(*per, *out), per, "left")


def _rolling_ends(base: DataFrame, spec: PanelSpec, lags: list[Lagged], width: int, v) -> DataFrame:
    """Per period: each rolling value at its last row, from at most `width` rows per period.

    The rank filter is pushed below the shuffle by Spark, so a crowded period sends `width` rows
    per map task.
    """
    latest = Window.partitionBy(*spec.period_keys).orderBy(F.desc(spec.time), F.desc(spec.event))
    tail = base.withColumn("__rn", F.row_number().over(latest)).where(F.col("__rn") <= width)
    rows = Window.partitionBy(*spec.keys).orderBy(spec.period, F.desc("__rn"))
    rolls = [x for x in lags if x.kind == "rolling"]
    tail = tail.select(
        *spec.period_keys, "__rn",
        *[STATS[x.stat](v(x.col)).over(rows.rowsBetween(-(x.size - 1), 0)).alias(x.name) for x in rolls],
        # Only needed when the whole period is null: what a window that began before it still saw.
        *[(F.last(v(x.col), ignorenulls=True).over(rows.rowsBetween(-(x.size - 1), -1))
           if x.size > 1 else F.lit(None).cast("double")).alias(f"__p_{x.name}") for x in rolls],
    )
    return tail.groupBy(*spec.period_keys).agg(
        *[F.max(F.when(F.col("__rn") == 1, F.col(x.name))).alias(f"__roll_{x.name}") for x in rolls],
        *[F.max_by(F.col(f"__p_{x.name}"), F.col("__rn")).alias(f"__pre_{x.name}") for x in rolls],
    )


def _last_but_one(base: DataFrame, spec: PanelSpec, col: str, v) -> DataFrame:
    """Per period: the last non-null value among the rows before the period's last row."""
    per = spec.period_keys
    latest = Window.partitionBy(*per).orderBy(F.desc(spec.time), F.desc(spec.event))
    moment = F.struct(spec.time, spec.event)
    ends = base.groupBy(*per).agg(F.max(moment).alias("__stop"))
    known = (
        base.where(v(col).isNotNull()).withColumn("__rn", F.row_number().over(latest))
        .where(F.col("__rn") <= 2).join(ends, per).where(moment < F.col("__stop"))
    )
    return known.groupBy(*per).agg(F.max_by(v(col), moment).alias(f"__deep_{col}"))


# -- conveniences ---------------------------------------------------------------------------


def rolling_stat(df, spec, cols, window, stat="mean", min_periods=1, strategy="direct") -> DataFrame:
    return attach_lagged(df, spec, [rolling(c, window, stat, min_periods) for c in cols], strategy)


def expanding_stat(df, spec, cols, stat="mean", min_periods=1, strategy="direct") -> DataFrame:
    return attach_lagged(df, spec, [expanding(c, stat, min_periods) for c in cols], strategy)


def previous_event_value(df, spec, cols, n=1, strategy="direct") -> DataFrame:
    return attach_lagged(df, spec, [nth_previous(c, n) for c in cols], strategy)


def fan_out(cols: Sequence[str], windows: Sequence[int], prefix: str = "", to_date: bool = True) -> list[Lagged]:
    """`{prefix}{col}_r{w}` for every window and, if asked, `{prefix}{col}_todate`."""
    asked = [rolling(c, w, name=f"{prefix}{c}_r{w}") for w in windows for c in cols]
    if to_date:
        asked += [expanding(c, name=f"{prefix}{c}_todate") for c in cols]
    return asked


def add_rolling_features(
    df: DataFrame, spec: PanelSpec, cols: Sequence[str], windows: Sequence[int],
    prefix: str = "", to_date: bool = True, strategy: str = "direct",
) -> tuple[DataFrame, list[str]]:
    lags = fan_out([c for c in cols if c in df.columns], windows, prefix, to_date)
    return attach_lagged(df, spec, lags, strategy), [x.name for x in lags]


def days_rest(df: DataFrame, spec: PanelSpec, name: str = "days_rest", strategy: str = "direct") -> DataFrame:
    """Days since the entity's previous event. The schedule is public, so this lags by row, not by period."""
    if strategy == "direct":
        previous = F.lag(spec.time).over(Window.partitionBy(*spec.keys).orderBy(*spec.order))
        return df.withColumn(name, days_between(F.col(spec.time), previous))
    # Row lag inside the period; only its first row needs the close of the period before.
    per = spec.period_keys
    step = Window.partitionBy(*spec.keys).orderBy(spec.period)
    ends = (
        df.groupBy(*per).agg(F.max(spec.time).alias("__end"))
        .select(*per, F.lag("__end").over(step).alias("__before"))
    )
    inside = F.lag(spec.time).over(Window.partitionBy(*per).orderBy(spec.time, spec.event))
    return (
        df.withColumn("__in", inside).join(ends, per, "left")
        .withColumn(name, days_between(F.col(spec.time), F.coalesce("__in", "__before")))
        .drop("__in", "__before")
    )


def days_between(later: Column, earlier: Column) -> Column:
    def micros(c: Column) -> Column:
        return F.unix_micros(c.cast("timestamp"))

    return (micros(later) - micros(earlier)) / F.lit(86_400_000_000.0)


def with_group_stats(df: DataFrame, keys: Sequence[str], **stats: Column) -> DataFrame:
    """Per-group statistics on every row: a combinable aggregate joined back, not a window.

    The aggregate combines before its shuffle, and adaptive execution broadcasts it when it turns
    out small or splits the skewed side of the join when it does not.
    """
    aliases = {k: f"__k_{k}" for k in keys}
    per_group = df.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()]).withColumnsRenamed(aliases)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(aliases[k])) for k in keys])
    return df.join(per_group, same, "left").drop(*aliases.values())


def events_in_period(df: DataFrame, spec: PanelSpec, side: str | None = None,
                     name: str = "side_events", flag: str = "is_double") -> DataFrame:
    """How many distinct events the side has in the row's period, and whether that is more than one."""
    keys = [*spec.group, side or spec.side, spec.period]
    out = with_group_stats(df, keys, **{name: F.count_distinct(F.col(spec.event)).cast("double")})
    return out.withColumn(flag, (F.col(name) > 1).cast("double"))


def pick_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: str = "first") -> DataFrame:
    """One row per key, the first or last in `order`; combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    chosen = (F.min_by if keep == "first" else F.max_by)(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(chosen.alias("__row")).select(*keys, "__row.*").select(*df.columns)


def running_max(col: str, keys: Sequence[str], order: Sequence[str]) -> Column:
    return F.max(col).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def cumulative_share(df: DataFrame, level: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of rows at or below each level. Counted first, then added up by ranges of levels; no window sees a whole group."""
    from panelcast.operators.ranges import running_total

    keys = list(by)
    counts = df.where(F.col(level).isNotNull()).groupBy(*keys, level).agg(F.count("*").alias("n"))
    placed = running_total(counts, keys, [F.col(level).asc()], "n", "__before", "__all", "levels")
    return placed.select(*keys, level, "n", ((F.col("__before") + F.col("n")) / F.col("__all")).alias("share"))


def recency_weight(df: DataFrame, group: str, period: str, half_life: float = 40.0,
                   periods_per_group: int = 38, name: str = "weight") -> DataFrame:
    """`0.5 ** (age / half_life)`, age in periods since the latest one among the given rows."""
    # One array of (group value, latest period): as long as there are group values, whatever the panel.
    tops = df.groupBy(group).agg(F.max(period).alias("top")).where(F.col("top").isNotNull())
    listed = tops.agg(F.array_sort(F.collect_list(F.struct(F.col(group).alias("g"), "top"))).alias("all")).scalar()
    rows = df.withColumn("__all", listed)
    newest = F.array_max(F.transform("__all", lambda s, i: i * periods_per_group + s["top"]))
    at = F.array_position(F.transform("__all", lambda s: s["g"]), F.col(group)) - 1
    age = newest - (at * periods_per_group + F.col(period))
    return rows.withColumn(name, F.pow(F.lit(0.5), age / F.lit(float(half_life)))).drop("__all")
