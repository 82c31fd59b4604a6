"""As-of lookups of hot keys of every type, and seats that fall on a match day."""

import bisect
import datetime
import random

import pytest
from pyspark.sql import functions as F

from panelcast.operators import asof, elo
from panelcast.operators.ranges import RANGE, in_ranges
from test_ratings import SCHEMA

DAY = datetime.date(2020, 1, 1)


@pytest.fixture
def apart(spark):
    """Small ranges stay as they are dealt."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("kind", ["int", "double", "date", "timestamp_ntz", "string"])
def test_a_key_with_most_rows_is_spread_and_right(spark, apart, kind, strict):
    rng = random.Random(3)
    to = {"int": int, "double": lambda x: x / 8, "date": lambda x: DAY + datetime.timedelta(x), "string": lambda x: f"{x:06d}",
          "timestamp_ntz": lambda x: datetime.datetime(2020, 1, 1) + datetime.timedelta(minutes=x)}[kind]
    # The hot key is valid only now and then, so values carry over whole ranges.
    history = [(1, x, float(x)) for x in sorted(rng.sample(range(500, 9_000), 25))] + [(k, rng.randrange(9_000), float(k)) for k in range(2, 80)]
    asks = [(1, rng.randrange(9_500)) for _ in range(4_000)] + [(rng.randrange(2, 90), rng.randrange(9_500)) for _ in range(500)] + [(None, 5), (1, None)]
    left = spark.createDataFrame([(i, k, None if x is None else to(x)) for i, (k, x) in enumerate(asks)], f"i int, k int, at {kind}")
    right = spark.createDataFrame([(k, to(x), v) for k, x, v in history], f"k int, since {kind}, v double")
    got = {r["i"]: r["v"] for r in asof.as_of_join(left, right, ["k"], "at", "since", ["v"], strict).collect()}
    by = {}
    for k, x, v in sorted(history):
        by.setdefault(k, ([], []))[0].append(x)
        by[k][1].append(v)
    for i, (k, x) in enumerate(asks):
        days, values = by.get(k, ([], []))
        n = 0 if x is None else (bisect.bisect_left if strict else bisect.bisect_right)(days, x)
        assert got[i] == (values[n - 1] if n else None)


def test_no_range_holds_a_hot_key_alone(spark, apart):
    d = spark.range(20_000).select(F.when(F.col("id") % 3 < 2, 1).otherwise(F.col("id")).alias("k"), (F.col("id") % 5_003).cast("int").alias("t"))
    sizes = [r["count"] for r in in_ranges(d.distinct(), ["k"], [F.col("t").asc()], "t").groupBy(RANGE).count().collect()]
    assert max(sizes) < 2.5 * sum(sizes) / len(sizes)


def test_seats_on_a_match_day_give_way_to_its_results(spark):
    """The second season opens the day after the first one closed: one rating per side and day, that after the matches."""
    rows = [(1, 1, DAY, 1, 2, 3, 0), (1, 1, DAY, 3, 4, 0, 0), (1, 2, DAY + datetime.timedelta(1), 1, 3, 2, 0), (1, 2, DAY + datetime.timedelta(9), 5, 4, 0, 1)]
    history = elo.rating_history(elo.replay(spark.createDataFrame(rows, SCHEMA)))
    days = {(r["side"], r["valid_from"]): r["rating"] for r in history.collect()}
    assert history.count() == len(days)
    expected = 1 / (10 ** (-45 / 400) + 1)
    first = 12.5 * 3**0.5 * (1 - expected)
    mean = 1500.0
    one, three = mean + first * 0.9, mean + 12.5 * (0.5 - expected) * 0.9
    gain = 12.5 * 2**0.5 * (1 - 1 / (10 ** (-(one - three + 45) / 400) + 1))
    next_day = DAY + datetime.timedelta(1)
    assert days[1, next_day] == pytest.approx(one + gain) and days[3, next_day] == pytest.approx(three - gain)
    # Side 2 left; side 5 takes its place's mean, pulled likewise, and is seated though it plays later.
    assert days[5, next_day] == pytest.approx(mean - first * 0.9) and (2, next_day) not in days
