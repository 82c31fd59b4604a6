"""Point-in-time joins: as-of lookups, captures before a deadline, and overlays of captured values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.operators.ranges import RANGE, in_ranges


def as_of_join(left: DataFrame, right: DataFrame, on: Sequence[str], when: str, valid_from: str,
               values: Sequence[str], strict: bool = True) -> DataFrame:
    """For each left row the latest right row of its key before `when` (at it too, if not `strict`).

    The lookups are first reduced to their distinct (key, when) pairs, with map-side combine, so a key
    that fills a third of the left side is looked up once per instant. Pairs and right rows are dealt
    together to ranges of equal depth by key and instant and written once; each range starts from the value its key
    closed the ranges before with, so a key of very many instants, of any type, is spread over its ranges.
    Null when nothing is valid yet.
    """
    on = list(on)
    asked = left.select(*on, F.col(when).alias("__t")).where(F.col("__t").isNotNull()).distinct()
    history = right.dropna(subset=[*on, valid_from]).groupBy(*on, F.col(valid_from).alias("__t")).agg(F.max(F.struct(*values)).alias("__v"))
    kind = history.schema["__v"].dataType
    marked = asked.select(*on, "__t", F.lit(None).cast(kind).alias("__v"), F.lit(True).alias("__ask"))
    merged = history.select(*on, "__t", "__v", F.lit(False).alias("__ask")).unionByName(marked)
    # A lookup sorts before the history of its own instant when the match must be strictly earlier.
    order = [F.col("__t").asc(), F.col("__ask").desc() if strict else F.col("__ask").asc()]
    merged = in_ranges(merged, on, order, "asof")
    past = Window.partitionBy(*on, RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    known = merged.withColumn("__v", F.last("__v", ignorenulls=True).over(past)).where(F.col("__ask"))
    known = known.join(_carried_in(merged, on), [*on, RANGE], "left").withColumn("__v", F.coalesce("__v", "__carry"))
    known = known.select(*on, F.col("__t").alias(when), *[F.col(f"__v.{v}").alias(v) for v in values])
    return left.join(known, [*on, when], "left")


def _carried_in(merged: DataFrame, on: list[str]) -> DataFrame:
    """The value in force when a range begins, for keys that lie in several ranges."""
    closing = merged.where(F.col("__v").isNotNull()).groupBy(*on, RANGE).agg(F.max_by("__v", "__t").alias("__close"))
    spans = merged.groupBy(*on).agg(F.min(RANGE).alias("__low"), F.max(RANGE).alias("__high")).where(F.col("__low") < F.col("__high"))
    # One row per range of such a key.
    spans = spans.select(*on, F.explode(F.sequence("__low", "__high")).alias(RANGE))
    before = Window.partitionBy(*on).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    rows = spans.join(closing, [*on, RANGE], "left")
    return rows.select(*on, RANGE, F.last("__close", ignorenulls=True).over(before).alias("__carry")).where(F.col("__carry").isNotNull())


def latest_before(captures: DataFrame, deadlines: DataFrame, keys: Sequence[str], period: str = "period",
                  captured: str = "captured_at", deadline: str = "deadline", pick: str = "latest") -> DataFrame:
    """The newest (or first) capture per key that precedes its period's deadline.

    A capture at or after its deadline is dropped; a period without a known deadline keeps all.
    The choice is an aggregate, so it combines before the shuffle.
    """
    keys = list(keys)
    bounds = deadlines.select(period, F.col(deadline).alias("__deadline"))
    legal = captures.join(bounds, period, "left").where(
        F.col("__deadline").isNull() | (F.col(captured) < F.col("__deadline"))).drop("__deadline")
    rest = [c for c in captures.columns if c not in keys]
    choose = F.max_by if pick == "latest" else F.min_by
    order = F.struct(captured, *[c for c in rest if c != captured])
    return (
        legal.groupBy(*keys).agg(choose(F.struct(*rest), order).alias("__row"))
        .select(*keys, "__row.*").select(*captures.columns)
    )


def overlay(df: DataFrame, captures: DataFrame, keys: Sequence[str], fill: Sequence[str] = (),
            replace: Sequence[str] = (), only: Column | None = None) -> DataFrame:
    """Captured context onto rows. `fill` columns only take what the row lacks; `replace` columns take the
    capture on every covered row, also when it is null: not being listed is information."""
    keys = list(keys)
    snap = captures.select(
        *keys, F.lit(True).alias("__covered"), *[F.col(c).alias(f"__s_{c}") for c in (*fill, *replace)]).dropna(subset=keys)
    out = df.join(snap, keys, "left")
    covered = F.coalesce(F.col("__covered"), F.lit(False))
    if only is not None:
        covered = covered & only
    changes = {c: F.when(covered & F.col(c).isNull(), F.col(f"__s_{c}")).otherwise(F.col(c)) for c in fill}
    changes |= {c: F.when(covered, F.col(f"__s_{c}")).otherwise(F.col(c)) for c in replace}
    return out.withColumns(changes).select(*df.columns)


def overlay_ratings(df: DataFrame, ratings: DataFrame, on: Sequence[str], home: str = "is_home",
                    own: str = "team_difficulty", other: str = "opp_difficulty", only: Column | None = None) -> DataFrame:
    """Both sides' event ratings as they stood, seen from the row's side; unknown events keep theirs."""
    r = ratings.select(*on, F.col("home_rating").alias("__h"), F.col("away_rating").alias("__a"), F.lit(True).alias("__known"))
    out = df.join(r.dropna(subset=list(on)), list(on), "left")
    known = F.coalesce(F.col("__known"), F.lit(False))
    if only is not None:
        known = known & only
    at_home = F.coalesce(F.col(home), F.lit(True))
    return out.withColumns({
        own: F.when(known, F.when(at_home, F.col("__h")).otherwise(F.col("__a"))).otherwise(F.col(own)),
        other: F.when(known, F.when(at_home, F.col("__a")).otherwise(F.col("__h"))).otherwise(F.col(other)),
    }).select(*df.columns)


def deadline_state(df: DataFrame, captures: DataFrame, ratings: DataFrame | None, group_value, period_value,
                   group: str = "season", period: str = "period", entity: str = "entity", event: str = "event",
                   fill: Sequence[str] = (), replace: Sequence[str] = (), home: str = "is_home",
                   own: str = "team_difficulty", other: str = "opp_difficulty") -> DataFrame:
    """A season's rows as a build at one period's deadline saw them.

    Target rows lose today's filled values and take the period's own capture; earlier periods without
    a capture of their own take its roles for the entities it lists; its event ratings apply to the
    whole season. Fails in the job when the period has no capture.
    """
    of_season = F.col(group) == group_value
    own_capture = captures.where(F.col(period) == period_value)
    snap = own_capture.select(
        entity, F.lit(True).alias("__listed"), *[F.col(c).alias(f"__s_{c}") for c in (*fill, *replace)])
    covered = captures.select(period).distinct().select(period, F.lit(True).alias("__own"))
    n = own_capture.agg(F.count("*").alias("__captured"))
    required = n.select(F.when(F.col("__captured") == 0, F.raise_error(F.lit(f"no capture for period {period_value}")))
                        .otherwise(F.lit(True)).alias("__ok"))
    out = df.join(snap, entity, "left").join(covered, period, "left").where(required.scalar())
    target = of_season & (F.col(period) == period_value)
    earlier = of_season & (F.col(period) < period_value) & F.col("__own").isNull()
    listed = F.coalesce(F.col("__listed"), F.lit(False))
    changes = {c: F.when(target, F.col(f"__s_{c}")).otherwise(F.col(c)) for c in fill}
    changes |= {c: F.when((target | earlier) & listed, F.col(f"__s_{c}")).otherwise(F.col(c)) for c in replace}
    out = out.withColumns(changes).select(*df.columns)
    if ratings is not None:
        out = overlay_ratings(out, ratings, [event], home, own, other, only=of_season)
    return out


def newest_wins(sources: Sequence[DataFrame], keys: Sequence[str], captured: str = "captured_at") -> DataFrame:
    """Merge capture stores: the newest per key; a tie keeps the earlier-listed source."""
    from panelcast.operators.panel import union_all

    merged = union_all([s.withColumn("__prio", F.lit(-i)) for i, s in enumerate(sources)])
    rest = [c for c in merged.columns if c not in keys and c != "__prio"]
    best = F.max_by(F.struct(*rest), F.struct(captured, "__prio"))
    return merged.groupBy(*keys).agg(best.alias("__r")).select(*keys, "__r.*").select(*sources[0].columns)


def stored_predictions(builds: DataFrame, deadlines: DataFrame, keys: Sequence[str], pick: str = "latest",
                       period: str = "period", generated: str = "generated_at") -> DataFrame:
    """The build that counts: the latest before the deadline, or the first one made. Builds are appended, never
    overwritten, so two writers cannot race. All rows of the chosen build are kept."""
    legal = builds.join(deadlines.select(period, F.col("deadline").alias("__deadline")), period, "left").where(
        F.col("__deadline").isNull() | (F.col(generated) < F.col("__deadline"))).drop("__deadline")
    choose = F.max if pick == "latest" else F.min
    chosen = legal.groupBy(*keys).agg(choose(generated).alias(generated))
    return legal.join(chosen, [*keys, generated], "left_semi")


def stamp_build(df: DataFrame, generated_at, model: str, odds_priced: str | None = None, fingerprint: str | None = None) -> DataFrame:
    return df.withColumns({
        "generated_at": F.lit(generated_at).cast("timestamp"), "model": F.lit(model),
        "odds_priced": F.lit(odds_priced or "unknown"), "fingerprint": F.lit(fingerprint or "unknown"),
    })


def fingerprint(df: DataFrame, extra: Mapping[str, str] | None = None) -> DataFrame:
    """Order-insensitive content hash of a frame with its schema; keys a fitted model."""
    described = ",".join(f"{n}:{t}" for n, t in df.dtypes) + "|" + ",".join(f"{k}={v}" for k, v in (extra or {}).items())
    # the hash passes over nulls, so where they stand is hashed with the values
    row = F.xxhash64(*df.columns, F.concat_ws("", *[F.isnull(c).cast("string") for c in df.columns]))
    # XOR alone would let pairs of equal rows cancel out; the sum of a second hash and the count do not.
    return df.agg(
        F.bit_xor(row).alias("x"), F.sum(F.pmod(F.xxhash64(F.lit("again"), row), F.lit(2**40))).alias("s"), F.count("*").alias("n")
    ).select(F.sha2(F.concat_ws("|", F.lit(described), "x", "s", "n"), 256).substr(1, 24).alias("fingerprint"))
