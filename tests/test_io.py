import datetime
import os

import pytest
from pyspark.sql import functions as F

from panelcast.operators import asof, panel as pn
from panelcast.sources import readers, sinks
from panelcast.streaming import captures as st

NOON = datetime.datetime(2026, 1, 1, 12)


def test_byte_order_mark_and_differing_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"\xef\xbb\xbfDiv,HomeTeam,FTHG\nE0,X,2\nE1,Y,\n")
    (tmp_path / "b.csv").write_text("HomeTeam,Div,Extra\nZ,E0,q\n")
    d = readers.read_prices(spark, {"2020-21": str(tmp_path / "a.csv"), "2021-22": str(tmp_path / "b.csv")}, "E0")
    assert sorted((r["season"], r["HomeTeam"], r["FTHG"], r["Extra"]) for r in d.collect()) == [("2020-21", "X", "2", None), ("2021-22", "Z", None, "q")]


def test_no_seasons_give_an_empty_frame(spark):
    schema = pn.canonical_schema({"event": "bigint"}, {}, {"points": "double"})
    assert readers.read_seasons(spark, {}, schema).columns == ["event", "points"]


def test_broken_captures_are_skipped(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"gameweek": 5, "captured_at": "2026-01-01T10:00:00", "players": [{"id": 1, "ep_next": "2.5", "now_cost": 55}, {"id": null}]}')
    (tmp_path / "broken.json").write_text('{"gameweek": 5, "captured_at": "2026')
    (tmp_path / "bare.json").write_text('{"captured_at": "2026-01-01T10:00:00", "players": []}')
    rows = readers.capture_rows(readers.read_captures(spark, str(tmp_path))).collect()
    assert [(r["period"], r["entity"], r["xp"], r["value"]) for r in rows] == [(5, 1, 2.5, 55.0)]
    assert readers.capture_ratings(readers.read_captures(spark, str(tmp_path))).count() == 0


def test_documents_are_unfolded(spark, tmp_path):
    (tmp_path / "d.json").write_text(
        '{"elements": [{"id": 1, "element_type": 2, "first_name": "A", "second_name": "B", "web_name": "AB"}],\n "teams": [{"id": 7, "name": "N", "short_name": "S"}],'
        '"events": [{"id": 3, "deadline_time": "2026-01-01T11:00:00Z", "finished": false, "is_current": false, "is_next": true}]}')
    d = readers.read_document(spark, str(tmp_path), readers.CALENDAR_SCHEMA)
    assert readers.entities(d).first()["position"] == "DEF" and readers.rows_of(d, "teams").first()["short_name"] == "S"
    assert readers.calendar(d).first()["deadline_time"] == datetime.datetime(2026, 1, 1, 11)
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "1.json").write_text('{"history": [{"round": 1, "value": 50}, {"round": 2, "value": 51}]}')
    (tmp_path / "h" / "2.json").write_text('{"history": []}')
    assert readers.read_histories(spark, str(tmp_path / "h"), "round:bigint,value:bigint").count() == 2
    (tmp_path / "p.json").write_text('{"id": 4, "history_past": [{"total_points": 10, "minutes": 90}, {"total_points": 179, "minutes": 3150}]}')
    assert tuple(readers.last_season_records(spark, str(tmp_path / "p.json")).first()) == (4, 179, 3150)


def test_nothing_is_stored_after_its_deadline(spark, tmp_path):
    d = spark.createDataFrame([(1, 2.0)], "entity int, expected_points double")
    late = NOON + datetime.timedelta(minutes=1)
    with pytest.raises(sinks.DeadlinePassed):
        sinks.append_predictions(d, str(tmp_path / "p"), "2025-26", 5, NOON, NOON, "m")
    with pytest.raises(sinks.DeadlinePassed):
        sinks.append_capture(d, str(tmp_path / "c"), NOON, late)
    assert not os.path.exists(tmp_path / "p") and not os.path.exists(tmp_path / "c")
    assert readers.read_predictions(spark, str(tmp_path / "p"), "2025-26", 5) is None


def test_first_and_stored_builds(spark, tmp_path):
    path = str(tmp_path / "p")
    for hour, x in ((8, 1.0), (10, 2.0)):
        d = spark.createDataFrame([(1, x)], "entity int, expected_points double")
        sinks.append_predictions(d, path, "2025-26", 5, NOON, NOON.replace(hour=hour), "m", fingerprint="f")
    builds = readers.read_predictions(spark, path, "2025-26", 5)
    due = spark.createDataFrame([(5, NOON)], "period int, deadline timestamp")
    assert asof.stored_predictions(builds, due, ["period"]).first()["expected_points"] == 2.0
    assert asof.stored_predictions(builds, due, ["period"], "first").first()["expected_points"] == 1.0
    early = spark.createDataFrame([(5, NOON.replace(hour=9))], "period int, deadline timestamp")
    assert asof.stored_predictions(builds, early, ["period"]).first()["expected_points"] == 1.0


def test_log_replaces_a_period_and_old_rows_read_unknown(spark, tmp_path):
    path = str(tmp_path / "log")
    old = spark.createDataFrame([("s", 1, 1, 3.0)], "season string, period int, entity int, actual double")
    old.write.partitionBy("season", "period").parquet(path)
    for x in (5.0, 6.0):
        sinks.upsert_log(spark, spark.createDataFrame([(1, x)], "entity int, actual double"), path, "s", 2, fingerprint="abc")
    rows = {r["period"]: (r["actual"], r["fingerprint"]) for r in sinks.read_log(spark, path).collect()}
    assert rows == {1: (3.0, "unknown"), 2: (6.0, "abc")}


def test_newest_capture_wins_and_ties_keep_the_first_store(spark):
    a = spark.createDataFrame([(1, 5, ["x"], "a"), (2, 5, ["x"], "a")], "gw int, captured_at int, players array<string>, who string")
    b = spark.createDataFrame([(1, 5, ["x"], "b"), (2, 9, ["x"], "b"), (3, 9, [], "b")], a.schema)
    got = {r["gw"]: r["who"] for r in sinks.keep_if_newer([a, b], ["gw"]).collect()}
    assert got == {1: "a", 2: "b"}


def test_overlay_fills_and_replaces(spark):
    rows = spark.createDataFrame([(1, 1, None, 1.0), (1, 2, 4.0, 1.0), (2, 1, None, 2.0)], "gw int, p int, xp double, role double")
    snap = spark.createDataFrame([(1, 1, 3.0, None), (1, 2, 9.0, 2.0)], "gw int, p int, xp double, role double")
    got = {(r["gw"], r["p"]): (r["xp"], r["role"]) for r in asof.overlay(rows, snap, ["gw", "p"], ["xp"], ["role"]).collect()}
    assert got == {(1, 1): (3.0, None), (1, 2): (4.0, 2.0), (2, 1): (None, 2.0)}


def test_deadline_state_needs_a_capture(spark):
    rows = spark.createDataFrame([("s", 3, 1, 1, True, 1.0, 2.0, 5.0)], "season string, period int, entity int, event int, is_home boolean, team_difficulty double, opp_difficulty double, xp double")
    snap = spark.createDataFrame([(2, 1, 3.0)], "period int, entity int, xp double")
    with pytest.raises(Exception, match="no capture"):
        asof.deadline_state(rows, snap, None, "s", 3, fill=["xp"]).collect()


def test_repeated_join_key_fails(spark):
    a, b = spark.createDataFrame([(1,), (None,)], "k int"), spark.createDataFrame([(1, 2), (None, 3)], "k int, v int")
    assert {(r["k"], r["v"]) for r in pn.join_unique(a, b, ["k"]).collect()} == {(1, 2), (None, None)}
    with pytest.raises(Exception, match="not unique"):
        pn.join_unique(a, b.unionByName(b), ["k"]).collect()


def test_fingerprint_ignores_order_and_sees_changes(spark):
    d = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, v string")
    one = asof.fingerprint(d).first()[0]
    assert asof.fingerprint(d.orderBy(F.desc("k"))).first()[0] == one and len(one) == 24
    assert asof.fingerprint(d.distinct()).first()[0] != one and asof.fingerprint(d, {"m": "1"}).first()[0] != one


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(1, 7, NOON.replace(hour=h), float(h)) for h in (8, 9, 13)]
    d = spark.createDataFrame(rows, "period int, entity int, captured_at timestamp, xp double")
    for r in rows:
        spark.createDataFrame([r], d.schema).coalesce(1).write.mode("append").parquet(src)
    due = spark.createDataFrame([(1, NOON)], "period int, deadline timestamp")
    for k in range(2):
        stream = st.legal_captures(st.stream_table(spark, src, 1), due)
        st.keep_newest(stream, out, ["period", "entity"], checkpoint=str(tmp_path / f"ck{k}")).awaitTermination()
    assert [(r["entity"], r["xp"]) for r in st.newest(spark, out, ["period", "entity"]).collect()] == [(7, 9.0)]


def test_shared_folder_comes_from_the_session(spark, monkeypatch):
    from panelcast import session

    assert session.shared_dir(spark)
    assert session.scratch_path(spark, "a") != session.scratch_path(spark, "a")


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("kind", ["timestamp", "date"])
def test_as_of_matches_brute_force(spark, strict, kind):
    import random

    rng = random.Random(4)
    unit = datetime.timedelta(hours=7) if kind == "timestamp" else datetime.timedelta(days=1)

    def at(n):
        t = NOON + n * unit
        return t if kind == "timestamp" else t.date()

    history = {(rng.randrange(3), rng.randrange(60)): float(i) for i in range(60)}
    asks = [(i, rng.choice([0, 1, 2, 9, None]), rng.randrange(-3, 65)) for i in range(200)]
    h = spark.createDataFrame([(k, at(t), v) for (k, t), v in history.items()], f"k int, since {kind}, v double")
    q = spark.createDataFrame([(i, k, at(t)) for i, k, t in asks], f"i int, k int, at {kind}")
    got = {r["i"]: r["v"] for r in asof.as_of_join(q, h, ["k"], "at", "since", ["v"], strict).collect()}
    for i, k, t in asks:
        past = [(u, v) for (kk, u), v in history.items() if kk == k and (u < t or (u == t and not strict))]
        assert got[i] == (max(past)[1] if past else None)


def test_capture_documents_follow_the_rows_of_a_capture_not_its_keys(spark, tmp_path):
    from panelcast.plans import io_queries as q

    day = datetime.datetime(1998, 1, 5)
    rows = [(i, 1_000 * i, day) for i in range(3_000)] + [(5_000 + i, None if i else 7, day + datetime.timedelta(days=1)) for i in range(2)] + [(6_000, 8, None)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz").write.parquet(str(tmp_path / "orders.parquet"))
    documents = q.capture_documents(spark, str(tmp_path))
    sizes = sorted(r["n"] for r in documents.where("gameweek IS NOT NULL").select(F.size("players").alias("n")).collect())
    assert sum(sizes) == 3_002 and len(sizes) <= 4 and documents.select(F.explode("players")).count() == 3_003
    found = q.capture_scan(spark, str(tmp_path))
    assert found.count() == 3_001 and found.agg(F.sum("n")).first()[0] == 3_001
