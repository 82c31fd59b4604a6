"""Ranks and running totals by ranges of equal depth, tier cuts and the fitted ticker against plain versions."""

import datetime
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators import multipliers as mp, ranges, ranks, windows as w


def skewed(spark):
    """Two thirds of the rows in one group, its values squeezed together beside one far away."""
    return spark.range(30_000).select(
        F.col("id"), F.when(F.col("id") % 3 < 2, F.lit("hot")).otherwise(F.concat(F.lit("g"), F.col("id") % 100)).alias("g"),
        F.when(F.col("id") == 0, F.lit(1e15)).when(F.col("id") % 50 == 1, F.lit(None)).otherwise((F.col("id") * 7919 % 9_973) / 1e6).alias("v"))


def test_one_extreme_value_does_not_fill_a_range(spark, apart):
    counts = skewed(spark).where("v IS NOT NULL").groupBy("g", "v").count()
    dealt = ranges.in_ranges(counts, ["g"], [F.col("v").asc()], "t")
    sizes = [r["count"] for r in dealt.groupBy(ranges.RANGE).count().collect()]
    assert len(sizes) >= 4 and max(sizes) < 3 * sum(sizes) / len(sizes)


@pytest.fixture
def apart(spark):
    """Small ranges stay as they are dealt."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("method", ["min", "average"])
@pytest.mark.parametrize("descending", [False, True])
def test_ranks_by_ranges_equal_the_window(spark, method, descending, apart):
    d = skewed(spark)
    one, two = ({r["id"]: r["rank"] for r in ranks.add_rank(d, ["g"], "v", method=method, descending=descending, strategy=s).collect()} for s in ("direct", "buckets"))
    assert one == two and None in one.values()


def test_ranks_of_text_and_of_long_numbers(spark):
    base = 2**60
    d = spark.createDataFrame([(i, None if i % 4 == 0 else "a", f"t{i * 7 % 13}", base + i * 5 % 11) for i in range(60)], "i int, g string, t string, n long")
    for column in ("t", "n"):
        one, two = ({r["i"]: r["rank"] for r in ranks.add_rank(d, ["g"], column, strategy=s).collect()} for s in ("direct", "buckets"))
        assert one == two and len(set(one.values())) > 5


def test_running_totals(spark):
    rows = [(k, i, (i * 37) % 17) for k in (None, 1, 2) for i in range(200)]
    d = spark.createDataFrame(rows, "k int, i int, n long")
    got = {(r["k"], r["i"]): (r["b"], r["t"]) for r in ranges.running_total(d, ["k"], [F.col("i").asc()], "n", "b", "t", "t").collect()}
    assert got == {(k, i): (sum(n for q, j, n in rows if q == k and j < i), sum(n for q, _, n in rows if q == k)) for k, i, _ in rows}
    whole = {r["i"]: r["b"] for r in ranges.running_total(d.where("k = 1"), [], [F.col("i").asc()], "n", "b", "t", "t").collect()}
    assert whole == {i: got[1, i][0] for i in range(200)}


def test_shares_in_groups(spark):
    d = spark.createDataFrame([(g, i % (3 + g)) for g in (1, 2) for i in range(50)] + [(1, None)], "g int, v int")
    got = {(r["g"], r["v"]): r["share"] for r in w.cumulative_share(d, "v", ["g"]).collect()}
    assert got == {(g, v): pytest.approx(sum(i % (3 + g) <= v for i in range(50)) / 50) for g in (1, 2) for v in range(3 + g)}


def test_tier_cuts_count_a_meeting_once(spark):
    rng = np.random.default_rng(2)
    meetings = [(s, p, a, a + 10, int(rng.integers(1, 6)), float(rng.normal(0, 120))) for s in (1, 2) for p in range(20) for a in range(4)]
    # Entities of a meeting repeat its row, in differing numbers.
    rows = [(*m[:4], e, m[4] if e == 0 else 5, m[5] if e == 0 else 9_999.0) for m in meetings for e in range(int(rng.integers(1, 6)))]
    d = spark.createDataFrame(rows + [(9, 9, 9, 9, 0, 1, None)], "season int, period int, side int, opponent int, entity int, level int, gap double")
    got = {r["level"]: r["cut"] for r in mp.tier_cuts(d, "level", "gap", ["season", "period", "side", "opponent"], ["entity"]).collect()}
    levels, gaps = (np.array([m[i] for m in meetings]) for i in (4, 5))
    want = {k: round(float(np.quantile(gaps, 1 - (levels <= k).mean()))) for k in sorted(set(levels))[:-1]}
    assert got == want


def test_ticker_with_blank_double_and_unrated(spark):
    day = datetime.date
    train = spark.createDataFrame([(1, "GK", 3, float(g), 1.0 + g / 1000) for g in range(-200, 200, 10)] * 20, "season int, position string, level int, gap double, ratio double")
    train = train.unionByName(train.limit(1).withColumn("season", F.lit(2)))
    events = spark.createDataFrame([(2, 1, 100, 1, 2), (2, 3, 101, 2, 1), (2, 3, 102, 1, 3)], "season int, period int, event int, home int, away int")
    ratings = spark.createDataFrame([(1, day(2000, 1, 1), 1500.0), (2, day(2000, 1, 1), 1445.0)], "side int, valid_from date, rating double")
    days = spark.createDataFrame([(2, p, day(2000, 1 + p, 1)) for p in (1, 2, 3)], "season int, period int, deadline date")
    out = mp.fitted_ticker(events, mp.moments(train, ["season"]).earlier(), ratings, days, horizon=3)
    got = {(r["as_of"], r["side"]): (round(r["kindness"], 6), r["events"]) for r in out.collect()}
    mean = 1 - 0.005
    # From period 1: an event now, none in 2, two in 3 (one against an unrated side).
    assert got[1, 1] == (pytest.approx(1.1 + 1.01 + mean, abs=1e-6), 3) and got[2, 1] == (pytest.approx(1.01 + mean, abs=1e-6), 2)
    assert got[1, 3] == (pytest.approx(mean, abs=1e-6), 1) and got[3, 2] == (pytest.approx(1 - 0.01, abs=1e-6), 1) and (0, 1) not in got


def test_recency_counts_periods_over_seasons(spark):
    d = spark.createDataFrame([(1, 3), (2, 1), (2, 4), (5, 2)], "season int, period int")
    got = {(r["season"], r["period"]): r["weight"] for r in w.recency_weight(d, "season", "period", 10.0, 4).collect()}
    ages = {(1, 3): 7, (2, 1): 5, (2, 4): 2, (5, 2): 0}
    assert got == {k: pytest.approx(0.5 ** (a / 10)) for k, a in ages.items()}
