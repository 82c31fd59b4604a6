import math

import pytest
from pyspark.sql import functions as F

from panelcast.functions import scoring as s


def points(spark, **line):
    values = {"position": "MID", "minutes": 90, **line}
    return spark.range(1).select(s.score({k: F.lit(v) for k, v in values.items()}).alias("p")).first()[0]


@pytest.mark.parametrize("line, want", [
    (dict(minutes=0, goals_scored=3), 0), (dict(minutes=1), 1), (dict(minutes=59), 1), (dict(minutes=60), 2),
    (dict(position="GK", clean_sheet=True), 6), (dict(position="DEF", minutes=59, clean_sheet=True), 1), (dict(clean_sheet=True), 3),
    (dict(position="FWD", clean_sheet=True), 2), (dict(position="DEF", goals_conceded=1), 2), (dict(position="DEF", goals_conceded=5), 0),
    (dict(goals_conceded=5), 2), (dict(position="GK", saves=8), 4), (dict(position="DEF", defensive_contribution=10), 4),
    (dict(defensive_contribution=10), 2), (dict(defensive_contribution=30), 4), (dict(yellow_cards=1, red_cards=1, own_goals=1), -4),
    (dict(position="GK", goals_scored=1, assists=1), 11), (dict(position="FWD", goals_scored=2, penalties_missed=1, bonus=3), 11),
    (dict(position="?", goals_scored=1), 2),
])
def test_rulebook(spark, line, want):
    assert points(spark, **line) == want


@pytest.mark.parametrize("rate", [0.0, 0.3, 1.0, 2.7, 6.0])
@pytest.mark.parametrize("per", [2, 3])
def test_poisson_step_is_the_expectation(spark, rate, per):
    want = sum((k // per) * math.exp(-rate) * rate**k / math.factorial(k) for k in range(25))
    got = spark.range(1).select(s.poisson_step(F.lit(rate), per)).first()[0]
    assert got == pytest.approx(want, abs=1e-8)


def test_terms_add_up_and_unflagged_rows_are_left_alone(spark):
    f = dict(position="DEF", p_play=0.9, p_60=0.7, expected_goals=0.1, expected_assists=0.2, p_clean_sheet=0.4, conceded_penalty=0.3,
             expected_save_points=0.0, p_defcon=0.25, expected_bonus=0.2)
    terms = s.combine({k: F.lit(v) for k, v in f.items()}, F.lit(0.2), F.lit(0.01))
    row = spark.range(1).select(*[c.alias(n) for n, c in terms.items()]).first()
    assert row["expected_points"] == pytest.approx(sum(row[t] for t in s.POINTS_TERMS))
    assert row["clean_sheet"] == pytest.approx(0.4 * 0.7 * 4) and row["cards"] == pytest.approx((-0.2 - 0.03) * 0.9)
    caps = spark.range(1).select(s.availability_ceiling(F.lit(0.9), F.lit(25.0)), s.availability_ceiling(F.lit(0.9), F.lit(None).cast("double"))).first()
    assert tuple(caps) == (0.25, 0.9)


def test_unknown_inputs_stay_unknown(spark):
    from panelcast.functions.ratings import margin_factor

    n = F.lit(None).cast("double")
    row = spark.range(1).select(s.poisson_step(n), s.unit(n), s.reconcile(n, F.lit(0.5)), s.availability_ceiling(n, F.lit(50.0)), margin_factor(n)).first()
    assert tuple(row) == (None,) * 5


def test_card_rates_reach_the_lines_without_a_shuffle_of_lines(spark, tmp_path):
    from panelcast.plans.scoring_queries import combine_terms

    rows = [(o, o % 6, o % 3, n, 10.0 + n) for o in range(40) for n in range(1, 3)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = combine_terms(spark, str(tmp_path))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and out.count() == len(rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
