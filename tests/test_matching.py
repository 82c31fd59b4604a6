import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from panelcast.functions.text import fold_name, same_name
from panelcast.operators import matching as mt


@pytest.mark.parametrize("name, want", [
    ("Ødegaard", "odegaard"), ("Fabiański", "fabianski"), ("Guéhi", "guehi"), ("O'Reilly", "oreilly"), ("Groß", "gross"), (" Þór ", "thor"), ("Muñoz", "munoz")])
def test_folding(spark, name, want):
    row = spark.range(1).select(fold_name(F.lit(name)).alias("f")).first()
    assert row["f"] == want


def test_collation_equality(spark):
    assert spark.range(1).select(same_name(F.lit("Guéhi"), F.lit("GUEHI"))).first()[0]


POOL = ["saka", "bukayo saka", "salah", "mohamed salah", "james", "reece james", "dan james", "son", "heung min son", "haaland", "erling haaland", "al", "bo", "a b c d e",
        "van dijk", "virgil van dijk", "de bruyne", "kdb", "oo", "anderson", "andersen", "joao pedro", "pedro neto", "neto"]
TYPED = ["saka", "sala", "jame", "heung", "halland", "van dyk", "bruyne", "al", "a", "ooo", "andersson", "pedro", "netto", "xyz", "mohammed salah", "b o", "abcde", "reece"]


def test_no_pair_above_the_threshold_is_lost(spark):
    keys = spark.createDataFrame(list(enumerate(POOL)), "entity int, key string")
    asked = spark.createDataFrame([(t,) for t in TYPED], "want string")
    got = {(r["want"], r["entity"]): r["score"] for r in mt.score_names(asked, keys, "entity").collect()}
    want = {}
    for t in TYPED:
        for i, k in enumerate(POOL):
            s = SequenceMatcher(None, t, k).ratio()
            s = 1.0 if t == k else max(s, 0.93) if t in k else s
            if s >= mt.MIN_MATCH:
                want[(t, i)] = s
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_blocks_of_many_pairs_at_once(monkeypatch):
    rng = random.Random(7)
    some = ["".join(rng.choice("abcd é🙂") for _ in range(rng.randint(0, 15))) for _ in range(4_000)]
    pairs = [*zip(some, reversed(some)), ("", ""), ("", "x"), ("abxcd", "abcd"), ("ab" * 400, "ba" * 90)]
    want = [SequenceMatcher(None, a, b, autojunk=False).ratio() for a, b in pairs]
    assert mt.similarity(*map(list, zip(*pairs))).tolist() == want
    monkeypatch.setattr(mt, "CELLS", 50)
    assert mt.similarity(*map(list, zip(*pairs))).tolist() == want and mt.similarity([], []).tolist() == []


def best_of_all(typed, pool, top):
    """Every entity scored, the best `top` kept, ties to the lower number."""
    out = {}
    for t in typed:
        scores = {}
        for i, k in pool:
            s = 1.0 if t == k else max(SequenceMatcher(None, t, k).ratio(), 0.93 if t in k else 0.0)
            scores[i] = max(scores.get(i, 0.0), s)
        best = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:top]
        out |= {(t, n): (i, pytest.approx(s)) for n, (i, s) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("top", [1, 8, 40])
def test_the_nearest_names_come_whatever_they_score(spark, top):
    pool = [(i // 2, k) for i, k in enumerate(POOL)]
    typed = [*TYPED, "", "12345", "qqqq"]
    asked = spark.createDataFrame([(t,) for t in [*typed, typed[0], None]], "want string")
    got = mt.nearest_names(asked, spark.createDataFrame(pool, "entity int, key string"), "entity", top).collect()
    found = {(r["want"], r["rank"]): (r["entity"], r["score"]) for r in got}
    want = best_of_all(typed, pool, top)
    assert len(got) == len(found) == len(typed) * min(top, len(POOL) // 2) and found == want


def test_nearest_names_of_nothing(spark):
    keys = spark.createDataFrame(list(enumerate(POOL)), "entity int, key string")
    asked = spark.createDataFrame([("saka",)], "want string")
    assert mt.nearest_names(asked.limit(0), keys, "entity").count() == 0 and mt.nearest_names(asked, keys.limit(0), "entity").count() == 0


def test_the_queries_are_the_best_of_all(spark, sf):
    from panelcast.plans import priors_queries as q

    asked, keys, _ = q.asked_and_keys(spark, sf)
    want = best_of_all([r[0] for r in asked.collect()], [tuple(r) for r in keys.select("entity", "key").collect()], 8)
    got = q.fuzzy_top_candidates(spark, sf).collect()
    assert {(r["want"], r["rank"]): r["entity"] for r in got} == {k: e for k, (e, _) in want.items()}
    old, pool = q.scored_names(spark, sf)
    cand = mt.top_candidates(old, "entity").join(pool.select("entity", "position"), "entity")
    plain = mt.resolve_squads(q.typed_names(spark, sf), cand, "squad", "slot", "entity", "position").collect()
    assert sorted(map(repr, plain)) == sorted(map(repr, q.resolve_typed_squads(spark, sf).collect()))


def test_the_query_loses_no_pair_either(spark, sf):
    from panelcast.plans.priors_queries import name_pool, scored_names, typed_names

    scored, _ = scored_names(spark, sf)
    got = {(r["want"], r["entity"]): round(r["score"], 9) for r in scored.collect()}
    pool = [(r["entity"], r["p_name"].lower(), r["p_name"].lower().split(" ")[-1]) for r in name_pool(spark, sf).collect()]
    want = {}
    for (t,) in typed_names(spark, sf).select("want").distinct().collect():
        for e, *keys in pool:
            best = max(1.0 if t == k else max(SequenceMatcher(None, t, k).ratio(), 0.93) if t in k else SequenceMatcher(None, t, k).ratio() for k in keys)
            if best >= mt.MIN_MATCH:
                want[(t, e)] = round(best, 9)
    assert got == want


def test_shared_surnames_follow_the_quota(spark):
    cand = spark.createDataFrame(
        [("james", 1, "DEF", 0.93, 1), ("james", 2, "MID", 0.93, 2), ("raya", 3, "GK", 1.0, 1), ("nobody", 9, "FWD", 0.5, 1)],
        "want string, entity int, position string, score double, rank int")
    defs = [(1, i, f"d{i}") for i in range(2, 7)]
    cand = cand.unionByName(spark.createDataFrame([(n, 100 + i, "DEF", 1.0, 1) for _, i, n in defs], cand.schema))
    names = spark.createDataFrame([(1, 1, "james"), *defs, (1, 7, "raya"), (1, 8, "nobody")], "squad int, slot int, want string")
    got = {r["want"]: r["entity"] for r in mt.resolve_squads(names, cand, "squad", "slot", "entity", "position").collect()}
    assert got["james"] == 2 and got["raya"] == 3 and got["nobody"] is None
    with pytest.raises(Exception, match="nobody"):
        mt.require_resolved(mt.resolve_squads(names, cand, "squad", "slot", "entity", "position"), "entity").collect()
