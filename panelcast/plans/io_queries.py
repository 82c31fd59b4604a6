"""Queries for sources, sinks and streams: given tables written out in the landed formats and read back."""

from __future__ import annotations

import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelcast.operators import asof, elo, review as r
from panelcast.plans.metrics_queries import rnd
from panelcast.plans.panels import EV_SQL, LOG_SQL, MATCH_ORDER, MATCH_SQL, ev_panel, log_panel, match_panel, with_sql
from panelcast.plans.pit_queries import CAP_SQL, REPLAY_SQL, capture_deadlines, captures
from panelcast.plans.registry import query, table
from panelcast.session import materialise, scratch_path
from panelcast.sources import readers, sinks
from panelcast.streaming import captures as st

STORE = "spark.sql.streaming.stateStore.providerClass"


def years(spark, sf):
    """The years that orders were made in: one small row each."""
    found = table(spark, sf, "orders").select(F.year("o_orderdate").alias("y")).where("y IS NOT NULL").distinct()
    return sorted(r["y"] for r in found.collect())


def season_files(spark, sf):
    """One folder of CSV per season; odd seasons carry a column the even ones lack."""
    d = table(spark, sf, "orders")
    root = scratch_path(spark, "seasons")
    paths = {}
    for y in years(spark, sf):
        part = d.where(F.year("o_orderdate") == y).select(
            F.col("o_orderkey").alias("fixture"), F.col("o_custkey").alias("element"), F.month("o_orderdate").alias("round"),
            F.col("o_totalprice").alias("price"), *([F.col("o_orderstatus").alias("extra")] if y % 2 else []))
        paths[str(y)] = f"{root}/{y}"
        part.write.option("header", True).csv(paths[str(y)])
    return paths


@query("season_csv_scan", """
SELECT CAST(year(o_orderdate) AS VARCHAR) AS season, o_orderkey AS event, o_custkey AS entity, CAST(month(o_orderdate) AS INTEGER) AS period, o_totalprice AS price,
       CASE WHEN year(o_orderdate) % 2 = 1 THEN o_orderstatus END AS extra FROM orders""")
def season_csv_scan(spark, sf):
    d = readers.read_seasons(spark, season_files(spark, sf))
    return readers.typed(d, {"season": ("season", "string"), "event": ("fixture", "bigint"), "entity": ("element", "bigint"),
                             "period": ("round", "int"), "price": ("price", "double"), "extra": ("extra", "string")})


@query("results_scan", """
SELECT CAST(year(o_orderdate) AS VARCHAR) AS season, CAST(o_orderdate AS DATE) AS date, 'c' || o_custkey AS home, 'k' || o_orderkey AS away,
       CAST(o_orderkey % 5 AS INTEGER) AS home_goals, CAST(o_custkey % 4 AS INTEGER) AS away_goals FROM orders WHERE o_orderkey % 6 <> 0""")
def results_scan(spark, sf):
    d = table(spark, sf, "orders")
    long_, short = F.date_format("o_orderdate", "dd/MM/yyyy"), F.date_format("o_orderdate", "dd/MM/yy")
    late = F.year("o_orderdate") >= 2000
    rows = d.select(
        F.year("o_orderdate").alias("y"), F.when(late & (F.col("o_orderkey") % 2 == 0), short).otherwise(long_).alias("Date"),
        F.concat(F.lit("c"), "o_custkey").alias("HomeTeam"), F.concat(F.lit("k"), "o_orderkey").alias("AwayTeam"),
        F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderkey") % 5).alias("FTHG"), (F.col("o_custkey") % 4).alias("FTAG"))
    root = scratch_path(spark, "results")
    rows.write.partitionBy("y").option("header", True).csv(root)
    return readers.read_results(spark, {str(y): f"{root}/y={y}" for y in years(spark, sf)})


@query("upcoming_prices_scan", "SELECT o_orderkey AS event, o_totalprice AS price FROM orders WHERE o_orderpriority = '1-URGENT'")
def upcoming_prices_scan(spark, sf):
    d = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("Div"), F.col("o_orderkey").alias("event"), F.col("o_totalprice").alias("price"))
    path = scratch_path(spark, "prices")
    d.write.option("header", True).csv(path)
    out = readers.read_prices(spark, {"now": path}, "1-URGENT")
    return readers.typed(out, {"event": ("event", "bigint"), "price": ("price", "double")})


def one_per_file(documents, path):
    """Every document a file of its own, as they land."""
    documents.write.option("maxRecordsPerFile", 1).json(path)


def dealt(df, key, rows_each=2_000):
    """A document number by hash of the key, so many that none holds much more than `rows_each` rows."""
    n = max(1, -(-df.count() // rows_each))
    return df.withColumn("document", F.pmod(F.xxhash64(key), F.lit(n)))


@query("nested_document_scan", """
SELECT p_partkey AS id, CASE p_size % 5 WHEN 1 THEN 'GK' WHEN 2 THEN 'DEF' WHEN 3 THEN 'MID' WHEN 4 THEN 'FWD' END AS position, p_size AS now_cost FROM part""")
def nested_document_scan(spark, sf):
    """Documents of about two thousand parts each, the parts as the nested entities."""
    e = F.struct(F.col("p_partkey").alias("id"), (F.col("p_size") % 5).alias("element_type"), F.col("p_size").alias("now_cost"))
    path = scratch_path(spark, "documents")
    one_per_file(dealt(table(spark, sf, "part"), "p_partkey").groupBy("document").agg(F.collect_list(e).alias("elements")).select("elements"), path)
    d = readers.read_document(spark, path, readers.CALENDAR_SCHEMA)
    return readers.entities(d).select("id", "position", F.col("now_cost").cast("int").alias("now_cost"))


@query("schedule_document_scan", """
SELECT o_orderkey AS id, CAST(month(o_orderdate) AS BIGINT) AS event, o_custkey AS team_h, strftime(o_orderdate, '%Y-%m-%d') AS kickoff, o_orderstatus = 'F' AS finished FROM orders""")
def schedule_document_scan(spark, sf):
    d = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.month("o_orderdate").alias("event"), F.col("o_custkey").alias("team_h"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("kickoff_time"), (F.col("o_orderstatus") == "F").alias("finished"),
        F.struct(F.lit(1).alias("ignored")).alias("stats"))
    path = scratch_path(spark, "schedule")
    lists = dealt(d, "id").groupBy("document").agg(F.to_json(F.collect_list(F.struct(*d.columns))).alias("value")).select("value")
    lists.write.option("maxRecordsPerFile", 1).text(path)  # a file is one list of events
    out = readers.read_schedule(spark, path)
    return out.select("id", "event", "team_h", F.date_format("kickoff_time", "yyyy-MM-dd").alias("kickoff"), "finished")


@query("entity_history_scan", "SELECT o_custkey AS element, o_orderkey AS fixture, CAST(month(o_orderdate) AS BIGINT) AS round, o_totalprice AS value FROM orders")
def entity_history_scan(spark, sf):
    """Documents of about two thousand orders, whole customers in each, the orders as the nested history."""
    h = F.struct(F.col("o_custkey").alias("element"), F.col("o_orderkey").alias("fixture"), F.month("o_orderdate").alias("round"), F.col("o_totalprice").alias("value"))
    path = scratch_path(spark, "histories")
    one_per_file(dealt(table(spark, sf, "orders"), "o_custkey").groupBy("document").agg(F.collect_list(h).alias("history")).select("history"), path)
    return readers.read_histories(spark, path, "element:bigint,fixture:bigint,round:bigint,value:double")


@query("last_completed_season", """
SELECT o_custkey AS entity, CAST(arg_max(n, y) AS BIGINT) AS points, CAST(arg_max(k, y) AS BIGINT) AS minutes FROM (
  SELECT o_custkey, year(o_orderdate) AS y, count(*) AS n, sum(o_orderkey % 90) AS k FROM orders WHERE year(o_orderdate) < 2001 GROUP BY ALL) GROUP BY o_custkey""")
def last_completed_season(spark, sf):
    per = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id"), F.year("o_orderdate").alias("y")).agg(
        F.count("*").alias("n"), F.sum(F.col("o_orderkey") % 90).alias("k"))
    item = F.struct(F.col("y").cast("string").alias("season_name"), F.col("n").alias("total_points"), F.col("k").alias("minutes"))
    docs = per.groupBy("id").agg(F.array_sort(F.collect_list(F.when(F.col("y") < 2001, item))).alias("history_past"))
    return readers.last_records(docs)


#: Entities of a capture document.
ENTITIES = 2_000


def capture_documents(spark, sf):
    """JSON documents of one time of capture and about two thousand entities each."""
    cap = captures(spark, sf)
    at = ["period", "captured_at"]
    # a time of capture has as many parts as its own rows need; a row a time is joined back
    sizes = cap.groupBy(*at).agg(F.ceil(F.count("*") / ENTITIES).cast("int").alias("parts"))
    same = F.col("period").eqNullSafe(F.col("__period")) & F.col("captured_at").eqNullSafe(F.col("__at"))
    cap = cap.join(sizes.select(F.col("period").alias("__period"), F.col("captured_at").alias("__at"), "parts"), same).withColumn("part", F.pmod(F.xxhash64("entity"), F.col("parts"))).drop("__period", "__at")
    p = F.struct(F.col("entity").alias("id"), F.col("xp").cast("string").alias("ep_next"), F.col("role").alias("penalties_order"))
    f = F.struct((F.col("entity") % 50).alias("id"), (F.col("entity") % 5 + 1).cast("double").alias("team_h_difficulty"), F.lit(2.0).alias("team_a_difficulty"))
    return cap.groupBy(F.col("period").alias("gameweek"), F.date_format("captured_at", "yyyy-MM-dd'T'HH:mm:ss").alias("captured_at"), "part").agg(
        F.collect_list(p).alias("players"), F.collect_list(f).alias("fixtures")).drop("part")


SNAP_IO = with_sql(CAP_SQL) + "SELECT period, entity, xp, role AS penalties_order FROM snap"


@query("capture_scan", with_sql(CAP_SQL) + """
SELECT period, entity, CAST(captured_at AS DATE) AS captured, max(xp) AS xp, count(*) AS n FROM cap GROUP BY ALL""")
def capture_scan(spark, sf):
    """Capture documents, one a file; one of them is no JSON and one names no entities."""
    path = scratch_path(spark, "captures")
    one_per_file(capture_documents(spark, sf), path)
    spark.createDataFrame([('{"gameweek": 3, "captured_at',), ('{"gameweek": 3, "captured_at": "1998-01-01T00:00:00"}',)], "value string").repartition(2).write.mode("append").option(
        "maxRecordsPerFile", 1).text(path)
    rows = readers.capture_rows(readers.read_captures(spark, path))
    return rows.groupBy("period", "entity", F.col("captured_at").cast("date").alias("captured")).agg(F.max("xp").alias("xp"), F.count("*").alias("n"))


@query("capture_ratings_scan", with_sql(CAP_SQL) + """
SELECT period, CAST(entity % 50 AS BIGINT) AS event, max(CAST(entity % 5 + 1 AS DOUBLE)) AS home_rating, count(*) AS n FROM cap GROUP BY ALL""")
def capture_ratings_scan(spark, sf):
    path = scratch_path(spark, "captures")
    capture_documents(spark, sf).write.json(path)
    d = spark.read.schema(readers.CAPTURE_SCHEMA).json(path).withColumn("captured_at", F.try_to_timestamp("captured_at"))
    return readers.capture_ratings(d).groupBy("period", "event").agg(F.max("home_rating").alias("home_rating"), F.count("*").alias("n"))


@query("live_feed_scan", with_sql(EV_SQL) + """
SELECT user_id AS entity, CAST(count(*) AS BIGINT) AS minutes, CAST(sum(k) AS DOUBLE) AS actual, CAST(sum(CASE WHEN event_type = 'click' THEN k ELSE 0 END) AS DOUBLE) AS act_bonus,
  CAST(sum(CASE WHEN event_type <> 'click' THEN k ELSE 0 END) AS DOUBLE) AS act_other FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM ev) GROUP BY user_id""")
def live_feed_scan(spark, sf):
    """One live document per day and fifty users, written as JSON and parsed; a document's size does not follow the table's."""
    k = F.from_json("props", "k bigint")["k"]
    name = F.when(F.col("event_type") == "click", "bonus").otherwise("unheard_of")
    per = ev_panel(spark, sf).groupBy("user_id", "day").agg(
        F.count("*").alias("n"), F.sum(k).alias("t"), F.collect_list(F.struct(name.alias("identifier"), k.cast("double").alias("points"))).alias("s"))
    e = F.struct(F.col("user_id").alias("id"), F.create_map(F.lit("minutes"), F.col("n").cast("string"), F.lit("total_points"), F.col("t").cast("string")).alias("stats"),
                 F.array(F.struct(F.lit(1).alias("fixture"), F.col("s").alias("stats"))).alias("explain"))
    path = scratch_path(spark, "live")
    per.groupBy("day", F.floor(F.col("user_id") / 50)).agg(F.collect_list(e).alias("elements")).select("elements").write.json(path)
    daily = r.parse_live(spark.read.schema(r.LIVE_SCHEMA).json(path))
    return daily.groupBy("entity").agg(*[F.sum(c).alias(c) for c in ("minutes", "actual", "act_bonus", "act_other")])


@query("feature_table_round_trip", with_sql(LOG_SQL) + "SELECT season, period, entity, expected_points, 'expected_points,minutes_r3' AS features FROM log")
def feature_table_round_trip(spark, sf):
    path = scratch_path(spark, "features")
    sinks.write_feature_table(log_panel(spark, sf).select("season", "period", "entity", "expected_points", "minutes_r3"), ["expected_points", "minutes_r3"], path)
    d, names = readers.read_feature_table(spark, path)
    return d.select("season", "period", "entity", "expected_points").withColumn("features", F.lit(",".join(names)))


@query("prediction_store", with_sql(LOG_SQL) + "SELECT entity, expected_points + 1 AS expected_points, 'component' AS model, 'unknown' AS odds_priced FROM log WHERE season = 1998 AND period = 3")
def prediction_store(spark, sf):
    """Two builds before the deadline: the later one counts."""
    path = scratch_path(spark, "predictions")
    d = log_panel(spark, sf).where("season = 1998 AND period = 3").select("entity", "expected_points")
    due = datetime.datetime(2026, 1, 2)
    sinks.append_predictions(d, path, 1998, 3, due, datetime.datetime(2026, 1, 1, 8), "component")
    sinks.append_predictions(d.withColumn("expected_points", F.col("expected_points") + 1), path, 1998, 3, due, datetime.datetime(2026, 1, 1, 9), "component")
    deadlines = log_panel(spark, sf).select("period").distinct().withColumn("deadline", F.lit(due))
    builds = readers.read_predictions(spark, path, 1998, 3)
    return asof.stored_predictions(builds, deadlines, ["season", "period"]).select("entity", "expected_points", "model", "odds_priced")


@query("log_upsert", with_sql(LOG_SQL) + """
SELECT season, period, CAST(count(*) AS BIGINT) AS n, sum(actual) + CASE WHEN season = 1999 AND period = 2 THEN count(*) ELSE 0 END AS actual,
       CASE WHEN season = 1999 AND period = 2 THEN 'v2' ELSE 'unknown' END AS fingerprint FROM log GROUP BY season, period""")
def log_upsert(spark, sf):
    """All periods logged, one of them reviewed twice: its rows are replaced, not counted again."""
    path = scratch_path(spark, "log")
    d = log_panel(spark, sf).select("season", "period", "entity", "actual")
    r.upsert_partition(r.unknown_if_missing(d), path, ["season", "period"])
    again = d.where("season = 1999 AND period = 2").drop("season", "period").withColumn("actual", F.col("actual") + 1)
    for _ in range(2):
        sinks.upsert_log(spark, again, path, 1999, 2, fingerprint="v2")
    return sinks.read_log(spark, path).groupBy("season", "period").agg(F.count("*").alias("n"), F.sum("actual").alias("actual"), F.max("fingerprint").alias("fingerprint"))


@query("metrics_csv_round_trip", with_sql(LOG_SQL) + "SELECT season, period, count(*) AS n, round(avg(actual), 4) AS mean FROM log GROUP BY season, period")
def metrics_csv_round_trip(spark, sf):
    path = scratch_path(spark, "metrics")
    out = log_panel(spark, sf).groupBy("season", "period").agg(F.count("*").alias("n"), F.round(F.avg("actual"), 4).alias("mean"))
    sinks.write_metrics(out, path)
    return readers.typed(readers.read_csv(spark, path), {"season": ("season", "int"), "period": ("period", "int"), "n": ("n", "bigint"), "mean": ("mean", "double")})


@query("keep_if_newer_captures", with_sql(CAP_SQL) + "SELECT period, CAST(max(captured_at) AS DATE) AS captured FROM cap GROUP BY period")
def keep_if_newer_captures(spark, sf):
    d = captures(spark, sf).groupBy("period", "captured_at").agg(F.collect_list("entity").alias("players"))
    empty = d.withColumns({"players": F.array().cast("array<bigint>"), "captured_at": F.date_add("captured_at", 90).cast("timestamp_ntz")})
    out = sinks.keep_if_newer([d.where("dayofmonth(captured_at) % 2 = 0"), d.where("dayofmonth(captured_at) % 2 = 1"), empty], ["period"])
    return out.select("period", F.col("captured_at").cast("date").alias("captured"))


# -- streams ---------------------------------------------------------------------------------------


@query("capture_stream", with_sql(CAP_SQL) + "SELECT period, entity, xp, role FROM snap")
def capture_stream(spark, sf):
    """Captures replayed as a stream in several files, refused after their deadline, newest kept."""
    source = scratch_path(spark, "stream-in")
    cap = captures(spark, sf)
    cap.repartition(4, "entity").write.parquet(source)
    static = spark.read.parquet(source)
    stream = st.stream_table(spark, source, files_per_batch=2)
    out = scratch_path(spark, "stream-out")
    st.keep_newest(st.legal_captures(stream, capture_deadlines(static)), out, ["period", "entity"]).awaitTermination()
    return st.newest(spark, out, ["period", "entity"]).select("period", "entity", "xp", "role")


def in_turn(df, label, time, cuts, run=None):
    """The rows written as files that a stream reads one after the other: up to each cut of time, then the rest.

    A part is one file, so that a stream of one file a batch takes it as a batch. With `run` its files are as many as its
    tasks, and `run(path)` is called once they lie there: a stream of everything available takes them as one batch.
    """
    path = scratch_path(df.sparkSession, label)
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = df if low is None else df.where(F.col(time) >= low)
        part = part if high is None else part.where(F.col(time) < high)
        (part if run else part.coalesce(1)).write.mode("append").parquet(path)
        if run:
            run(path)
    return path


def updates_in_turn(df, label, time, cuts, stream, keys):
    """`stream` of the rows, run part by part from one checkpoint, each part a batch: the store of changed rows."""
    spark = df.sparkSession
    out, checkpoint = scratch_path(spark, label), scratch_path(spark, f"{label}-ck")
    in_turn(df, f"{label}-in", time, cuts, lambda path: st.run_updates(stream(st.stream_table(spark, path)), out, keys, checkpoint))
    return out


def event_updates(spark, sf, label, stream, keys):
    """The last version of every key after the events have come in four parts by time."""
    d = table(spark, sf, "events")
    cuts = d.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    cuts = [cuts["a"] + (cuts["b"] - cuts["a"]) * i / 4 for i in (1, 2, 3)] if cuts["a"] else []
    return st.read_updates(spark, updates_in_turn(d, label, "ts", cuts, stream, keys), keys)


@query("live_score_stream", with_sql(EV_SQL) + """
SELECT day, user_id, arg_max(value, (ts, event_id)) AS latest, round(sum(value), 4) AS total, count(*) AS events FROM ev GROUP BY day, user_id""")
def live_score_stream(spark, sf):
    """Scores by user and day, updated as events come; the watermark closes past days."""
    out = event_updates(spark, sf, "live", lambda events: st.live_scores(events, ["user_id"], "ts", "event_id", "value"), ["window", "user_id"])
    return rnd(out.select(F.dayofmonth("window.start").alias("day"), "user_id", "latest", "total", "events"), ["total"], 4)


@query("windowed_score_stream", with_sql(EV_SQL) + """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, round(sum(value), 4) AS total, count(*) AS events FROM ev GROUP BY 1, 2""")
def windowed_score_stream(spark, sf):
    out = event_updates(spark, sf, "windows", lambda events: st.windowed_scores(events, ["event_type"], "ts", "value"), ["window", "event_type"])
    return rnd(out.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "total", "events"), ["total"], 4)


@query("rating_stream", with_sql(MATCH_SQL, REPLAY_SQL) + """
SELECT league, CAST(side AS BIGINT) AS side, date AS valid_from, round(rating, 4) AS rating FROM hist""")
def rating_stream(spark, sf):
    """The rating history of all leagues from a stream of results in three batches, each continuing the state of the last."""
    from panelcast.streaming import ratings as rt

    name = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cents", "home", "away", "home_goals", "away_goals", F.row_number().over(
        Window.partitionBy("league", "date", *MATCH_ORDER).orderBy(F.lit(0))))
    results = materialise(match_panel(spark, sf).withColumn("match", name).withColumn("of_month", F.dayofmonth("date")), "matches")
    members = results.select("league", "season", F.explode(F.array("home", "away")).alias("side")).distinct()
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, rt.ROCKS)
    try:
        # The store keeps ratings only: a match row, with its long name, is asked for by nobody here.
        ratings = lambda matches: rt.replay_stream(matches, members, "match", MATCH_ORDER).where(F.col("kind") == "rating")
        out = updates_in_turn(results, "ratings", "of_month", [11, 21], ratings, rt.KEYS)
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)
    history = elo.rating_history(st.read_updates(spark, out, rt.KEYS))
    first = results.groupBy("league").agg(F.min("date").alias("opening"))
    history = history.join(first, "league").where(F.col("valid_from") >= F.col("opening")).drop("opening", "season")
    return rnd(history, ["rating"], 4)


@query("match_states", """SELECT o_custkey AS home, o_orderkey AS away, o_orderkey % 3 = 0 AS started, coalesce(CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus = 'F' END, FALSE) AS finished FROM orders WHERE o_orderkey % 7 <> 0""")
def match_states(spark, sf):
    k = F.col("o_orderkey")
    d = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("team_h"), F.when(k % 7 != 0, k).alias("team_a"), (k % 3 == 0).alias("started"),
        F.when(k % 5 != 0, F.col("o_orderstatus") == "F").alias("finished"), F.col("o_orderdate").alias("kickoff_time"))
    return st.match_state(d).drop("kickoff")


@query("guarded_captures", with_sql(CAP_SQL) + "SELECT period, entity, CAST(captured_at AS DATE) AS captured, count(*) AS n FROM legal GROUP BY ALL")
def guarded_captures(spark, sf):
    """Captures stored day by day of a period; a day at or after the period's deadline is refused."""
    cap = materialise(captures(spark, sf), "captures")
    due = {r["period"]: r["deadline"] for r in capture_deadlines(cap).collect()}  # one row a period
    path, refused = scratch_path(spark, "guarded"), 0
    # A store takes what was captured before a deadline in one go; here in two, the second after it.
    for late in (False, True):
        part = cap.join(capture_deadlines(cap), "period").where((F.col("captured_at") >= F.col("deadline")) == F.lit(late)).drop("deadline")
        now = max(due.values()) if late else min(due.values()) - datetime.timedelta(days=1)
        try:
            sinks.append_capture(part.withColumn("captured_at", F.date_format("captured_at", "yyyy-MM-dd'T'HH:mm:ss")), path, min(due.values()), now)
        except sinks.DeadlinePassed:
            refused += 1
    kept = spark.read.schema("period int, entity bigint, captured_at string").json(path).where(F.lit(refused) == 1)
    return kept.groupBy("period", "entity", F.to_date(F.substring("captured_at", 1, 10)).alias("captured")).agg(F.count("*").alias("n"))
