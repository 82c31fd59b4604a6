import pytest
from pyspark.sql import functions as F

from panelcast.operators import evaluate as e, metrics as m
from panelcast.spec import PanelSpec


def frame(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "g int, position string, actual double, prediction double")


def test_error_values(spark):
    d = frame(spark, [("A", a, p) for a, p in zip([1.0, 2.0, 3.0, 4.0], [1.0, 3.0, 3.0, 6.0])])
    row = d.agg(m.mae("actual", "prediction"), m.rmse("actual", "prediction")).first()
    assert row[0] == 0.75 and row[1] == pytest.approx((5 / 4) ** 0.5)


@pytest.mark.parametrize("strategy", ["direct", "buckets"])
def test_rank_correlation(spark, strategy):
    d = frame(spark, [("A", a, p) for a, p in zip([1.0, 2.0, 3.0, 4.0], [1.0, 3.0, 3.0, 6.0])])
    assert m.spearman(d, ["g"], strategy=strategy).first()["rho"] == pytest.approx(0.9486832980505139)
    assert m.spearman(d.withColumn("prediction", F.lit(2.0)), ["g"], strategy=strategy).first()["rho"] is None
    assert m.spearman(d.limit(2), ["g"], strategy=strategy).first()["rho"] is None


def test_position_weights_ignore_positions_without_a_rank(spark):
    d = frame(spark, [("A", 1.0, 1.0), ("A", 2.0, 2.0), ("A", 3.0, 3.0), ("B", 1.0, 3.0), ("B", 2.0, 2.0), ("B", 3.0, 1.0), ("B", 4.0, 0.0), ("C", 1.0, 1.0)])
    assert m.spearman_by_position(d, ["g"]).first()[1] == pytest.approx((3 - 4) / 7)


def test_period_grain_sums_a_double(spark):
    d = spark.createDataFrame([("m", 1, 5, 7, 1, "A", 2.0, 3.0), ("m", 1, 5, 7, 2, "A", 1.0, 4.0)],
                              "model string, season int, period int, entity int, event int, position string, prediction double, actual double")
    row = m.to_period_grain(d, ["model", "season", "period", "entity"]).first()
    assert (row["prediction"], row["actual"], row["events"]) == (3.0, 7.0, 2)


class Recorder:
    """A predictor that writes down what it was shown."""

    def __init__(self):
        self.seen = []

    def fit(self, train, features):
        self.train = train
        return self

    def predict(self, test):
        s, p = test.select("season", "period").first()
        worst = self.train.select(F.max(F.col("season") * 100 + F.col("period"))).first()[0]
        self.seen.append((s * 100 + p, worst))
        return test.withColumn("prediction", F.lit(0.0))


def test_walk_forward_never_trains_on_the_test_period(spark):
    rows = [(s, p, e_, s * 1000 + p * 10 + e_, "A", float(p), None if (s, p) == (2, 8) else 1.0) for s in (1, 2) for p in range(1, 9) for e_ in (1, 2)]
    d = spark.createDataFrame(rows, "season int, period int, entity int, event int, position string, minutes_r3 double, points double")
    spec, rec = PanelSpec(), Recorder()
    out = e.walk_forward(d, spec, "points", ["season", "period", "entity", "event"], trained={"r": rec})
    assert sorted(x for x, _ in rec.seen) == [s * 100 + p for s in (1, 2) for p in range(5, 9) if (s, p) != (2, 8)]
    assert all(worst < at for at, worst in rec.seen)
    assert out.count() == 14
