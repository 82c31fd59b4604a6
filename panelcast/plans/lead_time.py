"""The lead-time backtest: which multiplier best carries a rate to an event some periods ahead."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.operators import multipliers as mp
from panelcast.session import materialise


def lead_time_predictions(rows: DataFrame, points: str, first: int = 6, season: str = "season", entity: str = "entity",
                          period: str = "period", position: str = "position", ratings: DataFrame | None = None, deadlines: DataFrame | None = None) -> DataFrame:
    """`pred_none`, `pred_table` and `pred_line` for every (season, as-of, lead) with an earlier season to fit on.

    `rows` are starts with ratio, level and gap. All seasons are fitted at once from sums by season, which add up to the sums
    of all earlier ones, so no row is copied. With `ratings` (side, valid_from, rating) and `deadlines` (season, period,
    deadline), a target's gap is the one known at its as-of period's deadline (`gap_then`); otherwise the event's own.
    """
    keys, by = [season, entity], [season]
    # Read by the sums, the rates and the targets.
    rows = materialise(rows, "starts")
    sums = mp.moments(rows, by, position).earlier(season)
    overall = materialise(mp.overall_of(sums, by), "overall")
    table, lines = mp.table_of(sums, by, position), mp.lines_of(sums, by, position)
    tested = rows.join(overall.select(season), season, "left_semi")
    out = mp.lead_targets(tested, mp.prior_rates(tested, keys, period, points), keys, period, first=first)
    gap = "gap"
    if ratings is not None:
        # The sides to look up come from the starts, so the targets are made once.
        meetings = tested.select(season, period, "side", "opponent").distinct()
        asked = meetings.withColumn("as_of", F.explode(F.array(*[F.col(period) - lead for lead in mp.LEADS])))
        out, gap = mp.with_gap_then(out, ratings, deadlines, season, period=period, asked=asked), "gap_then"
    out = mp.apply_table(out, table, overall, by, position, name="__table")
    out = mp.apply_line(out, lines, overall, by, position, gap=gap, name="__line")
    out = out.join(overall, by)
    return out.withColumns({
        "pred_none": F.col("rate") * F.col("overall"), "pred_table": F.col("rate") * F.col("__table"),
        "pred_line": F.col("rate") * F.col("__line"),
    }).drop("overall", "__table", "__line")
