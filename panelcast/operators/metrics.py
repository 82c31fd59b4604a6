"""How far off and how well ordered predictions are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.operators.ranks import add_rank
from panelcast.session import materialise

PRED, ACTUAL = "prediction", "actual"


def mae(actual: str | Column, pred: str | Column) -> Column:
    return F.avg(F.abs(_c(actual) - _c(pred)))


def rmse(actual: str | Column, pred: str | Column) -> Column:
    return F.sqrt(F.avg(F.pow(_c(actual) - _c(pred), 2)))


def brier(expected: str | Column, result: str | Column) -> Column:
    return F.avg(F.pow(_c(expected) - _c(result), 2))


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _guarded_corr(a: str, b: str) -> Column:
    """Pearson correlation, null when a side is constant."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def spearman(df: DataFrame, by: Sequence[str], actual: str = ACTUAL, pred: str = PRED,
             name: str = "rho", least: int = 3, strategy: str = "direct") -> DataFrame:
    """Per group: Pearson on average ranks over rows where both are known, and the row count."""
    rows = df.where(F.col(actual).isNotNull() & F.col(pred).isNotNull()).select(*by, actual, pred)
    rows = add_rank(rows, by, actual, "__ra", "average", strategy=strategy)
    rows = add_rank(rows, by, pred, "__rp", "average", strategy=strategy)
    varied = (F.min("__ra") < F.max("__ra")) & (F.min("__rp") < F.max("__rp"))
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.when((F.count("*") >= least) & varied, _guarded_corr("__ra", "__rp")).alias(name),
    )


def spearman_each(df: DataFrame, by: Sequence[str], preds: Sequence[str], actual: str = ACTUAL, least: int = 3) -> DataFrame:
    """`spearman` of several predictions of the same rows, as `rho_{prediction}`.

    Rows are shuffled by group once and sorted once for the actual and once per prediction. A prediction counts where it is
    known, so the actual's rank among its rows follows from counts of them up to the value and at the value.
    """
    by = list(by)
    rows = df.where(F.col(actual).isNotNull()).select(*by, actual, *preds)
    upto, equal = Window.partitionBy(*by).orderBy(actual), Window.partitionBy(*by, actual)
    rows = rows.withColumns({f"__ra_{p}": F.count(p).over(upto) for p in preds})
    ties = {p: F.count(p).over(equal) for p in preds}
    rows = rows.withColumns({f"__ra_{p}": F.when(F.col(p).isNotNull(), F.col(f"__ra_{p}") - (ties[p] - 1) / 2.0) for p in preds})
    for p in preds:
        rows = add_rank(rows, by, p, f"__rp_{p}", "average")

    def rho(p: str) -> Column:
        a, b = f"__ra_{p}", f"__rp_{p}"
        varied = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
        return F.when((F.count(p) >= least) & varied, _guarded_corr(a, b)).alias(f"rho_{p}")

    return rows.groupBy(*by).agg(*[rho(p) for p in preds])


def spearman_by_position(df: DataFrame, by: Sequence[str], position: str = "position", actual: str = ACTUAL,
                         pred: str = PRED, name: str = "rho_by_position", strategy: str = "direct") -> DataFrame:
    """Within-position rank correlation, weighted by position size; positions without one count nowhere."""
    cells = spearman(df, [*by, position], actual, pred, "__rho", strategy=strategy)
    known = F.when(F.col("__rho").isNotNull(), F.col("n"))
    return cells.groupBy(*by).agg(F.try_divide(F.sum(F.col("__rho") * known), F.sum(known)).alias(name))


def spearman_by_position_unweighted(df: DataFrame, by: Sequence[str], pred: str, actual: str,
                                    position: str = "position", least: int = 10,
                                    name: str = "rho_by_position", strategy: str = "direct") -> DataFrame:
    """Plain mean over positions with at least `least` rows."""
    cells = spearman(df, [*by, position], actual, pred, "__rho", least=least, strategy=strategy)
    return cells.groupBy(*by).agg(F.avg("__rho").alias(name))


def to_period_grain(rows: DataFrame, by: Sequence[str], event: str = "event", position: str = "position") -> DataFrame:
    """Predictions and actuals summed over the events of an entity's period."""
    return rows.groupBy(*by).agg(
        F.sum(PRED).alias(PRED), F.sum(ACTUAL).alias(ACTUAL),
        F.min(position).alias(position), F.count_distinct(event).alias("events"),
    )


def score_periods(preds: DataFrame, by: Sequence[str] = ("model", "season", "period"), entity: str = "entity",
                  event: str = "event", position: str = "position", strategy: str = "direct") -> DataFrame:
    """One row of metrics per model and period, for all of them at once.

    A row without a prediction is not a prediction of zero; it is left out. The summed grain feeds five
    aggregates, so it is written once to the shared folder and the predictions behind it run once.
    """
    by = list(by)
    grain = materialise(to_period_grain(preds.where(F.col(PRED).isNotNull()), [*by, entity], event, position), "grain")
    errors = grain.groupBy(*by).agg(
        F.count("*").alias("n"), mae(ACTUAL, PRED).alias("mae"), rmse(ACTUAL, PRED).alias("rmse")
    )
    overall = spearman(grain, by, name="spearman_overall", strategy=strategy).drop("n")
    inside = spearman_by_position(grain, by, position, name="spearman_by_position", strategy=strategy)
    return errors.join(overall, by, "left").join(inside, by, "left")


def summarise_models(per_period: DataFrame, model: str = "model") -> DataFrame:
    """Errors weighted by rows, rank correlations as plain means, best error first."""
    def weighted(c: str) -> Column:
        return F.sum(F.col(c) * F.col("n")) / F.sum("n")

    return per_period.groupBy(model).agg(
        F.count("*").alias("periods"), F.count("spearman_by_position").alias("ranked_periods"),
        F.sum("n").alias("rows"), weighted("mae").alias("mae"), weighted("rmse").alias("rmse"),
        F.avg("spearman_overall").alias("spearman_overall"),
        F.avg("spearman_by_position").alias("spearman_by_position"),
    ).orderBy("mae", model)
