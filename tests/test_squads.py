import itertools
import random

from pyspark.sql import functions as F

from panelcast.operators import squads as sq

QUOTA = [("GK", 2), ("DEF", 5), ("MID", 5), ("FWD", 3)]


def fifteen(rng, squad):
    ids = itertools.count(squad * 100)
    return [(squad, next(ids), p, float(rng.randrange(40)) / 4) for p, n in QUOTA for _ in range(n)]


def test_best_eleven_is_the_best_legal_one(spark):
    rng = random.Random(1)
    squads = [fifteen(rng, k) for k in range(40)]
    d = spark.createDataFrame([r for s in squads for r in s], "squad int, entity int, position string, v double")
    got = {}
    for r in sq.best_xi(d, ["squad"], "entity", "position", "v").collect():
        got.setdefault(r["squad"], []).append(r)
    for k, rows in enumerate(squads):
        best = max(
            sum(sorted((x[3] for x in rows if x[2] == "GK"), reverse=True)[:1]) + sum(sum(sorted((x[3] for x in rows if x[2] == p), reverse=True)[:n]) for p, n in zip(("DEF", "MID", "FWD"), shape))
            for shape in sq.SHAPES)
        assert len(got[k]) == 11 and sum(r["v"] for r in got[k]) == best


def test_a_pool_without_a_legal_shape_falls_back_to_its_best_eleven(spark):
    d = spark.createDataFrame([(1, i, "MID", float(i)) for i in range(13)], "squad int, entity int, position string, v double")
    assert sorted(r["entity"] for r in sq.best_xi(d, ["squad"], "entity", "position", "v").collect()) == list(range(2, 13))


def subs_by_hand(xi, bench, pos, minutes):
    least = {"GK": 1, "DEF": 3, "MID": 2, "FWD": 1}
    shape = {p: sum(pos[i] == p for i in xi) for p in least}
    out = {}
    for o in xi:
        if minutes[o] > 0:
            continue
        for b in bench:
            if b in out.values() or minutes[b] <= 0 or (pos[o] == "GK") != (pos[b] == "GK"):
                continue
            trial = dict(shape)
            trial[pos[o]] -= 1
            trial[pos[b]] += 1
            if all(trial[p] >= n for p, n in least.items()):
                out[o], shape = b, trial
                break
    return out


def test_substitutions_match_the_walk_by_hand(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for k in range(60):
        d, m, f = rng.choice(sq.SHAPES)
        squad = fifteen(rng, k)
        by = {p: [r[1] for r in squad if r[2] == p] for p, _ in QUOTA}
        xi = by["GK"][:1] + by["DEF"][:d] + by["MID"][:m] + by["FWD"][:f]
        bench = [r[1] for r in squad if r[1] not in xi]
        rng.shuffle(bench)
        pos, minutes = {r[1]: r[2] for r in squad}, {r[1]: rng.choice([0, 0, 90]) for r in squad}
        want[k] = subs_by_hand(xi, bench, pos, minutes)
        rows += [(k, i, slot, pos[i], minutes[i]) for slot, i in enumerate(xi + bench, 1)]
    d = spark.createDataFrame(rows, "squad int, entity int, slot int, position string, minutes int")
    got = {k: {} for k in want}
    for r in sq.auto_subs(d, ["squad"]).collect():
        got[r["squad"]][r["out_entity"]] = r["in_entity"]
    assert got == want


PICK = "squad int, entity int, multiplier int, is_captain boolean, is_vice boolean, subbed_in boolean, subbed_out boolean, minutes int"


def settle(spark, rows):
    d = spark.createDataFrame([(1, *r) for r in rows], PICK)
    once = sq.settle(d, ["squad"])
    twice = sq.settle(once.drop("armband_passed"), ["squad"])
    a = {r["entity"]: r["multiplier"] for r in once.collect()}
    assert a == {r["entity"]: r["multiplier"] for r in twice.collect()}
    return a


def test_armband(spark):
    t, f = True, False
    assert settle(spark, [(1, 3, t, f, f, f, 0), (2, 1, f, t, f, f, 90), (3, 0, f, f, t, f, 90), (4, 1, f, f, f, t, 0)]) == {1: 1, 2: 3, 3: 1, 4: 0}
    assert settle(spark, [(1, 2, t, f, f, f, 0), (2, 1, f, t, f, f, 0)]) == {1: 2, 2: 1}
    assert settle(spark, [(1, 2, t, f, f, f, 5), (2, 1, f, t, f, f, 90)]) == {1: 2, 2: 1}


def test_transfer_bank(spark):
    h = spark.createDataFrame([(1, 3, 2, False), (1, 5, 9, True), (1, 6, 1, False)], "m int, period int, transfers int, free boolean")
    b = spark.createDataFrame([(1, 1, 6), (2, 1, 1), (3, 1, 12)], "m int, started int, through int")
    got = {r["m"]: r["free_transfers"] for r in sq.transfer_bank(h, b, ["m"]).collect()}
    assert got == {1: 3, 2: 1, 3: 5}


def test_lineup_puts_the_keeper_first_on_the_bench(spark):
    rng = random.Random(2)
    d = spark.createDataFrame(fifteen(rng, 1), "squad int, entity int, position string, expected_points double")
    rows = sq.model_lineup(d, ["squad"]).orderBy("slot").collect()
    assert [r["slot"] for r in rows] == list(range(1, 16)) and rows[0]["position"] == "GK" and rows[11]["position"] == "GK"
    assert sum(r["is_captain"] for r in rows) == 1


def test_purchase_price_sources(spark):
    picks = spark.createDataFrame([(1, 10), (1, 11), (1, 12)], "manager int, entity int")
    tr = spark.createDataFrame([(1, 2, "a", 10, 50), (1, 4, "b", 10, 55), (1, 5, "c", 10, 60), (1, 9, "d", 10, 99)], "manager int, period int, time string, element_in int, cost int")
    chips = spark.createDataFrame([(1, 5, "freehit")], "manager int, period int, chip string")
    first = spark.createDataFrame([(11, 2, 70), (11, 1, 65), (11, 4, 80)], "entity int, period int, value int")
    prices = spark.createDataFrame([(10, 1), (11, 1), (12, 42)], "entity int, price int")
    squads = spark.createDataFrame([(1, 6, 2)], "manager int, squad_period int, started int")
    got = {r["entity"]: r["buy_price"] for r in sq.purchase_prices(picks, tr, chips, first, prices, squads).collect()}
    assert got == {10: 55, 11: 70, 12: 42}
    m = spark.createDataFrame([(1, 5), (2, 5)], "manager int, last_period int")
    assert {r["manager"]: r["squad_period"] for r in sq.squad_period(chips, m).collect()} == {1: 4, 2: 5}


def test_settled_squads_count_eleven(spark, sf):
    from panelcast.plans.squads_queries import settled

    s = settled(spark, sf).groupBy("season", "period", "squad").agg(F.count("*").alias("n"), F.max("multiplier").alias("top"))
    assert s.where("top > 2").count() == 0


def test_lines_and_orders_meet_once_for_all_import_frames(spark, sf):
    from panelcast.plans.squads_queries import import_frames

    *frames, prices = import_frames(spark, sf)
    assert not [f for frame in frames for f in frame.inputFiles() if "lineitem" in f or "orders" in f]


def test_a_purchase_price_pairs_no_pick_with_every_later_price(spark):
    picks = spark.createDataFrame([(1, 7), (1, 8), (1, 9), (1, 10), (2, 7), (3, 7)], "manager long, entity long")
    transfers = spark.createDataFrame([(1, 4, 1, 8, 50), (1, 5, 1, 8, 60), (1, 6, 1, 8, 70), (2, 5, 1, 7, 40), (3, None, 1, 7, 30)],
                                      "manager long, period int, time int, element_in long, cost long")
    chips = spark.createDataFrame([(1, 5, "freehit"), (2, 5, "wildcard"), (1, 4, "wildcard")], "manager long, period int, chip string")
    first = spark.createDataFrame([(7, p, 100 + p) for p in range(1, 30)] + [(9, 2, 5), (9, None, 6)], "entity long, period int, value long")
    prices = spark.createDataFrame([(9, 90), (10, 95)], "entity long, price long")
    squads = spark.createDataFrame([(1, 5, 3), (2, 5, 1)], "manager long, squad_period int, started int")
    out = sq.purchase_prices(picks, transfers, chips, first, prices, squads)
    assert {tuple(r) for r in out.collect()} == {(1, 7, 103), (1, 8, 50), (1, 9, 90), (1, 10, 95), (2, 7, 40), (3, 7, 0)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and "min_by" not in plan and plan.count("max_by") == 1


def test_squad_documents_are_numbered_in_one_grouping(spark):
    from panelcast.plans.squads_queries import squad_documents

    tr = spark.createDataFrame([(1, 4, 9), (1, 4, 3), (1, 4, 9), (1, 4, None), (1, 5, 2), (2, 4, 7)], "manager long, period int, element_in long")
    out = squad_documents(tr)
    got = {(r["manager"], r["period"]): [(p["element"], p["position"], p["multiplier"], p["is_captain"], p["is_vice_captain"]) for p in r["picks"]] for r in out.collect()}
    assert got == {(1, 4): [(None, 1, 2, True, False), (3, 2, 1, False, True), (9, 3, 1, False, False)],
                   (1, 5): [(2, 1, 2, True, False)], (2, 4): [(7, 1, 2, True, False)]}
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
