import pytest
from pyspark.sql import functions as F

from panelcast.functions.scoring import ACTUAL_TERMS, POINTS_TERMS
from panelcast.operators import multipliers as mp, priors as pr, review as r


def live(spark, tmp_path, text):
    (tmp_path / "live.json").write_text(text)
    return r.parse_live(spark.read.schema(r.LIVE_SCHEMA).json(str(tmp_path / "live.json")))


def test_live_terms_reconcile_with_the_total(spark, tmp_path):
    doc = ('{"elements": [{"id": 1, "stats": {"minutes": 180, "total_points": 9, "expected_goals": "0.40"}, "explain": ['
           '{"fixture": 1, "stats": [{"identifier": "minutes", "points": 2, "value": 90}, {"identifier": "own_goals", "points": -2, "value": 1}]},'
           '{"fixture": 2, "stats": [{"identifier": "minutes", "points": 2, "value": 90}, {"identifier": "penalties_saved", "points": 5, "value": 1}, {"identifier": "new_thing", "points": 2, "value": 1}]}]},'
           '{"id": 2, "stats": {"minutes": 0, "total_points": 0}, "explain": []}]}')
    rows = {x["entity"]: x for x in live(spark, tmp_path, doc).collect()}
    one = rows[1]
    assert (one["act_appearance"], one["act_saves"], one["act_other"]) == (4.0, 5.0, 0.0)
    assert sum(one[f"act_{t}"] for t in ACTUAL_TERMS) == one["actual"] == 9.0 and one["xg"] == 0.4 and one["minutes"] == 180
    assert all(rows[2][f"act_{t}"] == 0.0 for t in ACTUAL_TERMS)


def log(spark, rows):
    """rows of (entity, position, minutes_r3, expected, external, actual, minutes); goals carry everything."""
    d = spark.createDataFrame(rows, "entity int, position string, minutes_r3 double, expected_points double, xp_external double, actual double, minutes int")
    d = d.withColumns({"season": F.lit(1), "period": F.lit(1), **{t: F.lit(0.0) for t in POINTS_TERMS}, **{f"act_{t}": F.lit(0.0) for t in ACTUAL_TERMS}})
    return d.withColumns({"goals": F.col("expected_points"), "act_goals": F.col("actual")})


def test_empty_buckets_and_half_open_bands(spark):
    d = log(spark, [(1, "MID", 60.0, 2.0, 3.0, 1.0, 90), (2, "MID", 60.0, 4.0, None, 9.0, 90), (3, "MID", None, 4.0, 1.0, 9.0, 0), (4, "FWD", 90.0, 0.0, 1.0, -1.0, 10)])
    got = {x["bucket"]: (x["n"], x["model_mae"]) for x in r.outcome_buckets(d, {"model": "expected_points"}).collect()}
    assert got == {"0 or less": (1, 1.0), "1-2": (1, 1.0), "3-4": (0, None), "5+": (0, None)}
    bands = d.withColumn("appearance", F.element_at(F.array(F.lit(0.25), F.lit(0.26), F.lit(1.75), F.lit(1.76)), F.col("entity")))
    assert {x["band"]: x["n"] for x in r.minutes_calibration(bands).collect()} == {"under 0.25": 1, "0.25-0.75": 1, "0.75-1.25": 0, "1.25-1.75": 1, "over 1.75": 1}


def test_calibration_ratio_is_null_without_a_prediction(spark):
    d = log(spark, [(1, "MID", 60.0, 2.0, 3.0, 1.0, 90), (2, "GK", 60.0, 0.0, 3.0, 4.0, 90)])
    got = {x["term"]: (x["predicted"], x["actual"], x["ratio"]) for x in r.calibration(d).collect()}
    assert got["goals"] == (2.0, 5.0, 2.5) and got["saves"] == (0.0, 0.0, None) and got["total"] == (2.0, 5.0, 2.5)
    cells = {(x["term"], x["position"]) for x in r.calibration_by_position(d).collect()}
    assert cells == {("goals", "MID"), ("goals", "GK")}


def test_labels_join_doubles_and_mark_unplayed(spark):
    ev = spark.createDataFrame([(1, 10, 20, 5, 3), (2, 30, 10, None, None)], "event int, home int, away int, home_goals int, away_goals int")
    names = spark.createDataFrame([(10, "ARS"), (20, "SUN")], "side int, short_name string")
    got = {x["side"]: x["label"] for x in r.event_labels(ev, names).collect()}
    assert got == {10: "SUN (H) 5-3, ? (A) —", 20: "ARS (A) 3-5", 30: "ARS (H) —"}


def test_prediction_record_sums_terms_and_takes_the_larger_probability(spark):
    d = spark.createDataFrame([(1, 1, 2.0, 0.5, "MID"), (1, 2, 3.0, 0.9, None)], "entity int, event int, expected_points double, p_play double, position string")
    row = r.prediction_record(d, ["entity"], ["expected_points"], ["p_play"], ["position"]).first()
    assert (row["expected_points"], row["p_play"], row["position"], row["events"]) == (5.0, 0.9, "MID", 2)


def test_thin_price_bands_merge_forward_and_the_curve_never_falls(spark):
    rows, e = [], 0
    for price, rate, n in ((42.0, 1.0, 3), (46.0, 2.0, 3), (52.0, 1.0, 6), (61.0, 9.0, 2)):
        for _ in range(n):
            e += 1
            rows += [("s", e, "MID", p, rate, price) for p in (1, 2)]
    d = spark.createDataFrame(rows, "season string, entity int, position string, period int, points double, value double")
    got = [(x["price"], x["rate"]) for x in pr.price_prior(d).orderBy("knot").collect()]
    # 3 + 3 merge to 1.5; six of 1.0 are lifted to 1.5; the last two average with the knot before them.
    assert got == [(46.0, 1.5), (61.0, 5.0)]
    assert pr.price_prior(d.where("entity < 12")).count() == 0


def test_shrunk_line_recovers_its_slope(spark):
    rows = [(p, float(g), 1.0 + b * g) for p, b in (("DEF", 0.002), ("FWD", 0.001)) for g in range(-300, 300, 2)]
    d = spark.createDataFrame(rows, "position string, gap double, ratio double")
    lines = {x["position"]: x for x in mp.fit_line(d).collect()}
    assert lines["DEF"]["b"] == pytest.approx((0.002 + 0.0015) / 2) and lines["FWD"]["a"] == pytest.approx(1.0)
    far = spark.createDataFrame([("DEF", 900.0), ("DEF", None), ("GK", 0.0)], "position string, gap double")
    got = sorted(x["multiplier"] for x in mp.apply_line(far, mp.fit_line(d), mp.overall_mean(d)).collect())
    every = d.agg(F.avg("ratio")).first()[0]
    assert got == pytest.approx([every, every, 1 + 0.00175 * 300])


def test_bootstrap_is_repeatable_and_brackets_the_estimate(spark):
    d = spark.createDataFrame([(1, b, float(b % 5)) for b in range(20) for _ in range(b % 3 + 1)], "g int, block int, v double")
    a, b = (mp.block_bootstrap(d, ["g"], "block", "v", draws=400).first() for _ in range(2))
    assert a == b and a["ci_low"] < a["estimate"] < a["ci_high"]


def test_lead_predictions_fit_on_earlier_seasons_only(spark, sf):
    from panelcast.plans.lead_time import lead_time_predictions
    from panelcast.plans.metrics_queries import starts

    d = starts(spark, sf).cache()
    full = lead_time_predictions(d, "points").where("season = 1997")
    cut = lead_time_predictions(d.where("season <= 1997"), "points").where("season = 1997")
    cols = ["entity", "event", "lead", "pred_none", "pred_table", "pred_line"]
    # The same fits, up to the order in which shuffled partial sums arrive.
    a, b = ([tuple(round(v, 9) if isinstance(v, float) else v for v in x) for x in f.select(*cols).collect()] for f in (full, cut))
    assert sorted(a) == sorted(b) and a
    assert lead_time_predictions(d, "points").where("season = 1995").count() == 0
