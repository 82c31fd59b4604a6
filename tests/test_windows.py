import datetime
import random

import pytest
from pyspark.sql import functions as F

from panelcast.operators import ranks, windows as w
from panelcast.spec import PanelSpec

SPEC = PanelSpec(entity="who", period="gw", event="ev", time="ts")
DAY = datetime.datetime(2099, 8, 1)


def panel(spark, rows):
    """rows of (season, who, gw, ev, value); the clock follows the period, then the event."""
    data = [(s, e, g, v, DAY + datetime.timedelta(days=7 * g, hours=v), x) for s, e, g, v, x in rows]
    return spark.createDataFrame(data, "season string, who int, gw int, ev int, ts timestamp, x double")


def by_event(df, name):
    return [None if r[name] is None else round(r[name], 2) for r in df.orderBy("ev").collect()]


@pytest.mark.parametrize("strategy", ["direct", "collapse"])
def test_double_period_shares_one_value(spark, strategy):
    d = panel(spark, [("a", 1, 1, 1, 1.0), ("a", 1, 2, 2, 2.0), ("a", 1, 3, 3, 10.0), ("a", 1, 3, 4, 20.0), ("a", 1, 4, 5, 5.0)])
    out = w.attach_lagged(d, SPEC, [w.rolling("x", 3), w.nth_previous("x", 1), w.nth_previous("x", 2), w.expanding("x", "sum", name="s")], strategy)
    assert by_event(out, "x_r3") == [None, 1.0, 1.5, 1.5, 10.67]
    assert by_event(out, "x_lag1") == [None, 1.0, 2.0, 2.0, 20.0]
    assert by_event(out, "x_lag2") == [None, None, 1.0, 1.0, 10.0]
    assert by_event(out, "s") == [None, 1.0, 3.0, 3.0, 33.0]


@pytest.mark.parametrize("strategy", ["direct", "collapse"])
def test_gaps_and_neighbours_do_not_bleed(spark, strategy):
    d = panel(spark, [("a", 1, 1, 1, 4.0), ("a", 1, 5, 2, 6.0), ("a", 2, 1, 3, 100.0), ("a", 2, 9, 4, 1.0), ("b", 1, 1, 5, 7.0)])
    out = w.attach_lagged(d, SPEC, [w.rolling("x", 3), w.nth_previous("x", 1)], strategy)
    assert by_event(out, "x_r3") == [None, 4.0, None, 100.0, None]
    assert by_event(out, "x_lag1") == [None, 4.0, None, 100.0, None]


def inclusive(values, kind, n):
    out = []
    for i in range(len(values)):
        if kind == "nth":
            out.append(values[i - n + 1] if i - n + 1 >= 0 else None)
            continue
        seen = [v for v in values[max(0, i - n + 1) if n else 0: i + 1] if v is not None]
        out.append(sum(seen) / len(seen) if seen else None)
    return out


def brute(rows, kind, n):
    """Running value, its last non-null per period, shifted by one existing period."""
    got = {}
    for key in {(r[0], r[1]) for r in rows}:
        mine = sorted((r for r in rows if (r[0], r[1]) == key), key=lambda r: (r[2], r[3]))
        close = {}
        for r, v in zip(mine, inclusive([r[4] for r in mine], kind, n)):
            close.setdefault(r[2], None)
            if v is not None:
                close[r[2]] = v
        before = None
        for g in sorted(close):
            for r in mine:
                if r[2] == g:
                    got[r[3]] = before
            before = close[g]
    return [None if got[k] is None else round(got[k], 6) for k in sorted(got)]


@pytest.mark.parametrize("seed", range(4))
def test_both_plans_match_brute_force_with_many_nulls(spark, seed):
    rng = random.Random(seed)
    rows = []
    for ev in range(300):
        value = None if rng.random() < 0.6 else float(rng.randrange(40)) / 4
        rows.append((rng.choice("ab"), rng.randrange(4), rng.randrange(1, 9), ev, value))
    # One entity crowds a single period, with its last rows unknown.
    rows += [("a", 99, 3, 1000 + i, float(i) if i < 5 else None) for i in range(30)]
    rows += [("a", 99, 4, 2000 + i, None) for i in range(12)] + [("a", 99, 6, 3000, 1.0)]
    d = panel(spark, rows)
    lags = [w.rolling("x", 2), w.rolling("x", 5), w.expanding("x"), w.nth_previous("x", 1), w.nth_previous("x", 2)]
    want = {"x_r2": brute(rows, "rolling", 2), "x_r5": brute(rows, "rolling", 5), "x_todate": brute(rows, "rolling", 0),
            "x_lag1": brute(rows, "nth", 1), "x_lag2": brute(rows, "nth", 2)}
    for strategy in ("direct", "collapse"):
        out = w.attach_lagged(d, SPEC, lags, strategy).orderBy("ev").collect()
        for name, expected in want.items():
            assert [None if r[name] is None else round(r[name], 6) for r in out] == expected, (strategy, name)


def test_direct_plan_shuffles_and_sorts_once(spark):
    d = panel(spark, [("a", 1, g, g, 1.0) for g in range(1, 8)])
    plan = w.attach_lagged(d, SPEC, w.fan_out(["x"], [3, 5, 10]), "direct")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Sort [") == 1


def test_bad_requests_are_refused(spark):
    with pytest.raises(ValueError):
        w.nth_previous("x", 0)
    with pytest.raises(ValueError):
        w.rolling("x", 3, min_periods=4)
    d = panel(spark, [("a", 1, 1, 1, 1.0)])
    with pytest.raises(ValueError):
        w.attach_lagged(d, SPEC, [w.nth_previous("x", 3)], "collapse")


def test_callable_stat(spark):
    d = panel(spark, [("a", 1, g, g, float(g)) for g in range(1, 5)])
    out = w.attach_lagged(d, SPEC, [w.rolling("x", 3, lambda c, over: F.max(c).over(over) - F.min(c).over(over), name="span")])
    assert by_event(out, "span") == [None, 0.0, 1.0, 2.0]


def test_missing_order_and_days_rest(spark):
    d = panel(spark, [("a", 1, 1, 1, 0.0), ("a", 1, 1, 2, 0.0), ("a", 1, 3, 3, 0.0), ("a", 2, 1, 4, 0.0)])
    for strategy in ("direct", "collapse"):
        got = by_event(w.days_rest(d, SPEC, strategy=strategy), "days_rest")
        assert got[0] is None and got[3] is None
        assert got[1] == round(1 / 24, 2) and got[2] == round(14 + 1 / 24, 2)


@pytest.mark.parametrize("method", ["min", "average"])
@pytest.mark.parametrize("descending", [False, True])
def test_ranks_agree_on_a_crowded_group(spark, method, descending):
    rng = random.Random(3)
    rows = [(0 if i % 3 else i % 5, None if i % 17 == 0 else rng.choice([1.5, 2.0, rng.random() * 1e6, -3.0])) for i in range(2000)]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, g int, v double")
    a = {r["i"]: r["rank"] for r in ranks.add_rank(d, ["g"], "v", method=method, descending=descending, strategy="direct").collect()}
    b = {r["i"]: r["rank"] for r in ranks.add_rank(d, ["g"], "v", method=method, descending=descending, strategy="buckets").collect()}
    assert a == b


def test_pick_by_key_and_group_stats_with_null_keys(spark):
    d = spark.createDataFrame([(1, 2, 5.0), (1, 1, 6.0), (None, 3, 7.0)], "k int, o int, v double")
    assert {(r["k"], r["v"]) for r in w.pick_by_key(d, ["k"], ["o"]).collect()} == {(1, 6.0), (None, 7.0)}
    out = w.with_group_stats(d, ["k"], n=F.count("*"))
    assert sorted((r["o"], r["n"]) for r in out.collect()) == [(1, 2), (2, 2), (3, 1)]
