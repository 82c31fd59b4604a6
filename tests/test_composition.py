"""Review and import as whole compositions, and the normalisation of a landed season."""

import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.functions.scoring import ACTUAL_TERMS, POINTS_TERMS
from panelcast.operators import panel as pn, squads as sq
from panelcast.operators.pipeline import review_period
from panelcast.plans.panels import PLAY

NOON = datetime.datetime(2026, 1, 1, 12)
HOUR = datetime.timedelta(hours=1)


def record(spark, extra=0.0):
    rows = [(i, "MID", f"n{i}", 60.0, 1.5, 2.0 + i + extra) for i in range(1, 5)]
    return spark.createDataFrame(rows, "entity int, position string, name string, minutes_r3 double, xp_external double, expected_points double").withColumns(
        {t: F.lit(0.5) for t in POINTS_TERMS})


@pytest.fixture
def parts(spark):
    actual = spark.createDataFrame([(1, 0, 0.0), (2, 90, 5.0), (3, 90, 2.0)], "entity int, minutes int, actual double").withColumns({f"act_{t}": F.lit(0.0) for t in ACTUAL_TERMS})
    due = spark.createDataFrame([(7, NOON)], "period int, deadline timestamp")
    builds = [record(spark, x).withColumns({"season": F.lit(1), "period": F.lit(7), "generated_at": F.lit(NOON + HOUR * h), "model": F.lit("m"), "odds_priced": F.lit("priced"),
                                            "fingerprint": F.lit(f"f{h}")}) for x, h in ((10.0, -2), (20.0, -1), (30.0, 1))]
    return actual, due, builds[0].unionByName(builds[1]).unionByName(builds[2])


WHO = {"model": "expected_points", "external": "xp_external"}


def test_the_last_build_before_the_deadline_counts_and_nothing_is_rebuilt(spark, parts, tmp_path):
    actual, due, builds = parts
    document = spark.createDataFrame([(5, 7, None, [(1, 1, 2, True, False), (2, 2, 1, False, True), (3, 12, 0, False, False), (9, 3, 1, False, False)], [(3, 9)], (40, 3, 4, 12))], sq.PICKS_SCHEMA)
    for _ in range(2):
        got = review_period(spark, 1, 7, builds, due, lambda: pytest.fail("rebuilt"), actual, str(tmp_path / "log"), ["entity"], WHO, "xp_external", sq.picks_of(document), finished=False)
    assert got.generated_at == NOON - HOUR and not got.reconstructed and got.provisional
    assert sorted((r["entity"], r["expected_points"], r["actual"], r["fingerprint"]) for r in got.table.collect()) == [(1, 23.0, 0.0, "f-1"), (2, 24.0, 5.0, "f-1"), (3, 25.0, 2.0, "f-1"), (4, 26.0, 0.0, "f-1")]
    squad = {r["entity"]: (r["multiplier"], r["name"], r["actual"], r["armband_passed"]) for r in got.squad.collect()}
    # The armband passes to 2; 3 came on for 9, whom nobody predicted.
    assert squad == {1: (1, "n1", 0.0, True), 2: (2, "n2", 5.0, True), 3: (1, "n3", 2.0, True), 9: (0, "#9", 0.0, True)}
    assert got.calibration.where("term = 'total'").first()["actual"] == 7.0


def test_without_a_build_the_prediction_is_made_again(spark, parts, tmp_path):
    actual, due, builds = parts
    late = builds.where("fingerprint = 'f1'")
    for stored in (None, late):
        got = review_period(spark, 1, 7, stored, due, lambda: record(spark), actual, str(tmp_path / "log"), ["entity"], WHO, "xp_external")
        assert got.reconstructed and got.squad is None and {r["odds_priced"] for r in got.table.collect()} == {"unknown"}


def test_a_period_nobody_has_played_is_refused(spark, parts, tmp_path):
    actual, due, builds = parts
    for none in (actual.limit(0), actual.withColumn("minutes", F.lit(0))):
        with pytest.raises(ValueError, match="no minutes"):
            review_period(spark, 1, 7, builds, due, lambda: record(spark), none, str(tmp_path / "log"), ["entity"], WHO, "xp_external")


def frames(spark, started=1):
    managers = spark.createDataFrame([(1, started, 5), (2, 2, 5)], "manager long, started int, last_period int")
    documents = spark.createDataFrame([
        (1, 4, None, [(11, 2, 1, False, False), (10, 1, 2, True, False)], None, (50, 4, 0, 15)), (1, 5, "freehit", [(99, 1, 1, True, False)], None, (60, 1, 0, 3)),
        (2, 5, None, [(10, 1, 1, True, False)], None, None)], sq.PICKS_SCHEMA)
    history = spark.createDataFrame([(1, p, t, h, 1000 + p) for p, t, h in ((1, 0, 0), (2, 0, 0), (3, 3, 4), (4, 0, 0), (5, 9, 0))] + [(2, 4, 1, 0, 7)], "manager long, period int, transfers int, hit int, value int")
    chips = spark.createDataFrame([(1, 5, "freehit"), (1, 20, "wildcard")], "manager long, period int, chip string")
    transfers = spark.createDataFrame([(1, 3, 11, 55, "a"), (1, 3, 11, 56, "b"), (1, 5, 10, 99, "c"), (2, 4, 10, 44, "d")], "manager long, period int, element_in long, cost long, time string")
    first = spark.createDataFrame([(10, 1, 41), (10, 2, 42)], "entity long, period int, value long")
    prices = spark.createDataFrame([(10, 60), (11, 61)], "entity long, price long")
    return managers, sq.picks_of(documents), history, chips, transfers, first, prices


def test_a_team_is_imported_whole(spark):
    got = {r["manager"]: r for r in sq.import_teams(*frames(spark)).collect()}
    one, two = got[1], got[2]
    # The free hit of period 5 reverts to the squad of 4, and its purchase does not count.
    assert one["squad_period"] == 4 and one["bank"] == 15 and [tuple(p) for p in one["picks"]] == [(1, 10, 41), (2, 11, 56)]
    assert one["chips_used"] == {"1:freehit": 5, "2:wildcard": 20} and [(x["period"], x["chip"]) for x in one["ledger"]] == [(1, None), (2, None), (3, None), (4, None), (5, "freehit")]
    assert one["free_transfers"] == 3 and two["free_transfers"] == 3 and two["bank"] == 0 and two["chips_used"] is None and [tuple(p) for p in two["picks"]] == [(1, 10, 44)]


def test_a_manager_who_started_later_is_refused(spark):
    with pytest.raises(Exception, match="no squad yet for manager 1"):
        sq.import_teams(*frames(spark, started=6)).collect()


def normalise(spark, rows, events):
    raw = spark.createDataFrame(rows, "element string, fixture string, round string, was_home string, kickoff_time string, position string, xP string, minutes string")
    ev = spark.createDataFrame(events, "event long, team_h long, team_a long, gh double, ga double")
    schema = pn.canonical_schema({"season": "string", "period": "bigint", "event": "bigint", "entity": "bigint", "ts": "timestamp"},
                                 {"position": "string", "element_type": "bigint", "is_home": "boolean", "side": "bigint", "opponent": "bigint", "xp": "double", "absent": "double"},
                                 {"minutes": "double", "goals_for": "double"})
    return pn.normalise_history(raw, ev, PLAY, F.lit("2023-24"), {"element": "entity", "fixture": "event", "round": "period", "was_home": "is_home", "kickoff_time": "ts", "xP": "xp"},
                                {"side": ("team_h", "team_a"), "opponent": ("team_a", "team_h"), "goals_for": ("gh", "ga")}, schema, ["season", "period", "event", "entity"], ["xp"])


def test_a_landed_season_is_normalised(spark):
    at = "2023-08-11T19:00:00Z"
    rows = [("1", "10", "1", "True", at, "GK", "0", "90"), ("2", "10", "1", "False", at, "FWD", "0.0", "x"), ("3", "10", "1", "True", at, "AM", "3", "1"),
            ("4", "99", "2", "False", at, "MID", "2.5", None), ("5", "10", "2", None, "soon", "DEF", "0", "7"), (None, "10", "2", "True", at, "DEF", "1", "7"), ("6", None, "2", "True", at, "DEF", "1", "7")]
    out = normalise(spark, rows, [(10, 7, 8, 2.0, 1.0), (None, 1, 1, 0.0, 0.0)])
    got = {r["entity"]: r for r in out.collect()}
    assert set(got) == {1, 2, 4, 5} and out.schema["minutes"].metadata["role"] == "outcome" and isinstance(out.schema["ts"].dataType, T.TimestampType)
    assert [(got[i]["side"], got[i]["opponent"], got[i]["goals_for"], got[i]["element_type"]) for i in (1, 2, 4, 5)] == [(7, 8, 2.0, 1), (8, 7, 1.0, 4), (None, None, None, 3), (None, None, None, 2)]
    # Period 1 never captured a forecast; in period 2 a zero is a zero.
    assert [got[i]["xp"] for i in (1, 2, 4, 5)] == [None, None, 2.5, 0.0] and got[2]["minutes"] is None and got[5]["ts"] is None and got[1]["absent"] is None


def test_a_repeated_event_fails_the_job(spark):
    with pytest.raises(Exception, match="not unique"):
        normalise(spark, [("1", "10", "1", "True", None, "GK", "1", "90")], [(10, 7, 8, 2.0, 1.0), (10, 7, 9, 0.0, 0.0)]).collect()
