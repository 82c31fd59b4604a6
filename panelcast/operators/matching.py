"""Typed names to entities: similarity search without comparing every pair.

Only pairs that can reach the threshold are scored. For a similarity of at least `least`, two strings
must share a large enough multiset of characters; pairs are found by an equi-join on the rarest of
those characters together with compatible lengths (a prefix filter), which loses no pair above the
threshold. Contained names are found by an equi-join on their first characters. The best few of a name are
found by falling thresholds, each only for names that the one before has not filled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.text import fold_name
from panelcast.session import materialise

# A good match may settle a quota, below the minimum nothing is accepted; a contained name scores at least 0.93.
GOOD_MATCH, MIN_MATCH, CONTAINED, EXACT = 0.7, 0.62, 0.93, 0.999
QUOTA = {"GK": 2, "DEF": 5, "MID": 5, "FWD": 3}
HEAD = 3
#: Falling thresholds of the search for the best few. At zero, any shared character makes a pair.
STEPS = (0.85, MIN_MATCH, 0.0)
#: Cells of a padded block of names that are compared side by side.
CELLS = 1 << 21


def name_keys(pool: DataFrame, entity: str, spellings: Sequence[Column]) -> DataFrame:
    """The folded spellings an entity answers to, one row each."""
    keys = F.array_distinct(F.filter(F.array(*[fold_name(s) for s in spellings]), lambda k: k.isNotNull() & (k != "")))
    return pool.select(entity, F.explode(keys).alias("key"))


def _characters(text: Column) -> Column:
    """Characters with a running number per letter, so a multiset becomes a set."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.transform(chars, lambda c, i: F.concat(c, F.size(F.filter(F.slice(chars, 1, i + 1), lambda d: d == c)).cast("string")))


# Rare letters first, by their frequency in names at large; anything not listed is rarer still.
COMMON_LAST = "qxzjvwkpfygbcmhduslotrniea "


def _prefix(text: Column, least: float) -> Column:
    """The characters one of which any partner above the threshold must share.

    With overlap o and lengths m and n the similarity is 2o / (m + n); the smallest n that can reach
    `least` is m * least / (2 - least), so o is at least that much, and m - o + 1 characters suffice.
    """
    tokens = _characters(text)
    weight = F.array_sort(F.transform(tokens, lambda t: F.struct(F.position(F.substring(t, 1, 1), F.lit(COMMON_LAST)).alias("w"), t.alias("t"))))
    need = F.ceil(F.length(text) * F.lit(least / (2 - least)) - 1e-9)
    keep = F.greatest(F.length(text) - need + 1, F.lit(1)).cast("int")
    return F.transform(F.slice(weight, 1, keep), lambda x: x["t"])


def similar_pairs(asked: DataFrame, keys: DataFrame, least: float = MIN_MATCH) -> DataFrame:
    """Candidate pairs (want, key): everything that can score `least` (more than zero, where it is zero), and every key that contains `want`."""
    ratio = least / (2 - least)

    def signed(df: DataFrame, col: str) -> DataFrame:
        return df.select(col, F.explode(_prefix(F.col(col), least)).alias("__t"), F.length(col).alias("__n"))

    pool = keys.select("key").distinct()
    if least <= 0:
        letters = lambda df, col: df.select(col, F.explode(F.array_distinct(F.split(col, ""))).alias("__t")).where("__t <> ''")
        return letters(asked.select("want").distinct(), "want").join(letters(pool, "key"), "__t").select("want", "key").distinct()
    a = signed(asked.select("want").distinct(), "want")
    # Lengths that can meet: listed on the asked side, so the join is on equality.
    a = a.select("want", "__t", F.explode(F.sequence(
        F.ceil(F.col("__n") * F.lit(ratio) - 1e-9).cast("int"), F.floor(F.col("__n") / F.lit(ratio) + 1e-9).cast("int"))).alias("__n"))
    alike = a.join(signed(pool, "key"), ["__t", "__n"]).select("want", "key")
    short = F.least(F.length("want"), F.lit(HEAD))
    heads = asked.select("want").distinct().where(F.length("want") > 0).select("want", F.substring(F.col("want"), F.lit(1), short).alias("__h"))
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(HEAD)), lambda k: F.when(
        F.length("key") >= k, F.transform(F.sequence(F.lit(1), F.length("key") - k + 1), lambda i: F.substring(F.col("key"), i, k))).otherwise(F.array().cast("array<string>"))))
    inside = heads.join(pool.select("key", F.explode(F.array_distinct(grams)).alias("__h")), "__h").where(F.contains("key", "want")).select("want", "key")
    return alike.unionByName(inside).distinct()


def matched_characters(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Characters in common blocks of each pair: the longest block (the first in `left`, then in `right`), then the same on either side of it.

    All pairs go side by side: a round finds the longest block of every open pair of segments, one row of `left` at a time.
    """
    rows = len(left)
    a, b = (np.ascontiguousarray(x).view(np.uint32).reshape(rows, -1) for x in (left, right))
    total = np.zeros(rows, np.int64)
    pair, zero = np.arange(rows), np.zeros(rows, np.int64)
    low_a, high_a, low_b, high_b = zero, np.char.str_len(left).astype(np.int64), zero, np.char.str_len(right).astype(np.int64)
    while True:
        live = (high_a > low_a) & (high_b > low_b)
        pair, low_a, high_a, low_b, high_b = (x[live] for x in (pair, low_a, high_a, low_b, high_b))
        if not len(pair):
            return total
        place_b = low_b[:, None] + np.arange((high_b - low_b).max())
        seen = b[pair[:, None], np.minimum(place_b, b.shape[1] - 1)].astype(np.int64)
        seen[place_b >= high_b[:, None]] = -1
        run = np.zeros((len(pair), seen.shape[1] + 1), np.int32)
        size, end_a, end_b = (np.zeros(len(pair), np.int64) for _ in range(3))
        for i in range((high_a - low_a).max()):
            at = low_a + i
            char = np.where(at < high_a, a[pair, np.minimum(at, a.shape[1] - 1)].astype(np.int64), -2)
            run[:, 1:] = np.where(seen == char[:, None], run[:, :-1] + 1, 0)
            where = run.argmax(1)
            best = run[np.arange(len(pair)), where]
            better = best > size
            size[better], end_a[better], end_b[better] = best[better], at[better] + 1, (low_b + where)[better]
        np.add.at(total, pair, size)
        some = size > 0
        pair, size, end_a, end_b = pair[some], size[some], end_a[some], end_b[some]
        low_a, high_a, low_b, high_b = (
            np.concatenate([low_a[some], end_a]), np.concatenate([end_a - size, high_a[some]]),
            np.concatenate([low_b[some], end_b]), np.concatenate([end_b - size, high_b[some]]))
        pair = np.concatenate([pair, pair])


def similarity(left: list[str], right: list[str]) -> np.ndarray:
    """Twice the characters in common blocks over all characters, pair by pair; 1 for two empty names. No character counts as junk."""
    length = np.array([len(x) + len(y) for x, y in zip(left, right)], np.int64)
    widest = np.array([max(len(x), len(y), 1) for x, y in zip(left, right)], np.int64)
    order, out, at = np.argsort(widest, kind="stable"), np.ones(len(left)), 0
    while at < len(order):
        some = order[at:at + max(1, min(len(order) - at, CELLS // int(widest[order[-1]])))]
        common = matched_characters(np.array([left[i] for i in some], np.str_), np.array([right[i] for i in some], np.str_))
        out[some] = np.where(length[some] > 0, 2.0 * common / np.maximum(length[some], 1), 1.0)
        at += len(some)
    return out


def _ratio(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        want, key = (batch.column(c).to_pylist() for c in ("want", "key"))
        yield pa.RecordBatch.from_arrays([pa.array(want, pa.string()), pa.array(key, pa.string()), pa.array(similarity(want, key))], names=["want", "key", "ratio"])


def score_names(asked: DataFrame, keys: DataFrame, entity: str, least: float = MIN_MATCH) -> DataFrame:
    """Every (want, entity) that scores at least `least`, with its best score over the entity's spellings."""
    pairs = similar_pairs(asked, keys, least).mapInArrow(_ratio, "want string, key string, ratio double")
    score = F.when(F.col("want") == F.col("key"), F.lit(1.0)).when(F.contains("key", "want"), F.greatest("ratio", F.lit(CONTAINED))).otherwise(F.col("ratio"))
    return pairs.join(keys, "key").groupBy("want", entity).agg(F.max(score).alias("score")).where(F.col("score") >= least)


def top_candidates(scored: DataFrame, entity: str, top: int = 8) -> DataFrame:
    w = Window.partitionBy("want").orderBy(F.desc("score"), entity)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def nearest_names(asked: DataFrame, keys: DataFrame, entity: str, top: int = 8, steps: Sequence[float] = STEPS) -> DataFrame:
    """want, entity, score, rank: the `top` best entities of every name that score at least the last of `steps`.

    A name that has `top` entities above a threshold has its best ones; only the others go on to the next. Where the last
    threshold is zero, every name gets `top` entities, or all there are: those without a shared character follow by number.
    Null names are left out; an empty name is contained in every key.
    """
    todo = asked.select("want").where(F.col("want").isNotNull()).distinct()
    parts: list[DataFrame] = []
    for i, least in enumerate(steps):
        best = materialise(top_candidates(score_names(todo, keys, entity, least), entity, top), "nearest")
        full = best.groupBy("want").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= top).select("want")
        if i == len(steps) - 1:
            parts.append(best)
            break
        parts.append(best.join(full, "want", "left_semi"))
        todo = materialise(todo.join(full, "want", "left_anti"), "unfilled")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    if steps[-1] > 0:
        return found
    # Twice as many of the lowest numbers as can be wanted: fewer than `top` of them are found already.
    spare = [r[0] for r in keys.select(entity).distinct().orderBy(entity).limit(2 * top).collect()]
    if not spare:
        return found
    kind = found.schema[entity].dataType
    rest = todo.join(full, "want", "left_anti").select("want", F.explode(F.array(*[F.lit(e).cast(kind) for e in spare])).alias(entity))
    rest = rest.join(best, ["want", entity], "left_anti").withColumn("score", F.when(F.col("want") == "", F.lit(CONTAINED)).otherwise(F.lit(0.0)))
    open_names = best.join(full, "want", "left_anti").drop("rank").unionByName(rest)
    whole = found.join(todo.join(full, "want", "left_anti"), "want", "left_anti")
    return whole.unionByName(top_candidates(open_names, entity, top))


def resolve_squads(names: DataFrame, candidates: DataFrame, squad: str, order: str, entity: str, position: str) -> DataFrame:
    """Each squad's names to entities under its position quota.

    `names` has squad, an order and `want`; `candidates` adds entity, position, score, rank. Names with
    exactly one exact candidate are settled first; the others take, in order, the best good candidate
    whose position is still open, else the best acceptable one, else null. A squad has at most fifteen
    names of at most eight candidates, folded inside one row.
    """
    options = names.join(candidates, "want", "left")
    cand = F.struct(F.col("rank").alias("r"), F.col("score").cast("double").alias("s"), F.col(entity).cast("bigint").alias("e"), F.col(position).alias("p"))
    per_name = options.groupBy(squad, order, "want").agg(
        F.array_sort(F.collect_list(F.when(F.col("rank").isNotNull(), cand))).alias("__c"))
    exact = F.filter("__c", lambda c: c["s"] >= EXACT)
    per_name = per_name.withColumn("__sure", F.when(F.size(exact) == 1, exact[0]))
    item = F.struct(F.col(order).alias("o"), "want", "__c", "__sure")
    rows = per_name.groupBy(squad).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("__k"), item.alias("i")))).alias("__l"))
    names_of = F.transform("__l", lambda x: x["i"])

    def settled(place: str) -> Column:
        return F.size(F.filter(names_of, lambda n: n["__sure"]["p"] == place))

    picked = "array<struct<o:bigint,want:string,e:bigint,s:double>>"
    start = F.struct(F.array().cast(picked).alias("out"), *[(F.lit(q) - settled(p)).cast("int").alias(p) for p, q in QUOTA.items()])

    def visit(st: Column, n: Column) -> Column:
        def open_place(c: Column) -> Column:
            room = F.lit(False)
            for p in QUOTA:
                room = room | ((c["p"] == p) & (st[p] > 0))
            return room & (c["s"] >= GOOD_MATCH)

        free = F.get(F.filter(n["__c"], open_place), 0)
        any_ok = F.get(F.filter(n["__c"], lambda c: c["s"] >= MIN_MATCH), 0)
        pick = F.coalesce(n["__sure"], free, any_ok)
        added = F.concat(st["out"], F.array(F.struct(n["o"].cast("bigint").alias("o"), n["want"].alias("want"), pick["e"].alias("e"), pick["s"].alias("s"))))
        spend = n["__sure"].isNull() & pick.isNotNull()
        return F.struct(added.alias("out"), *[
            (st[p] - F.coalesce((spend & (pick["p"] == p)).cast("int"), F.lit(0))).alias(p) for p in QUOTA])

    done = rows.select(squad, F.explode(F.aggregate(names_of, start, visit)["out"]).alias("x"))
    return done.select(squad, F.col("x.o").alias(order), F.col("x.want").alias("want"), F.col("x.e").alias(entity), F.round("x.s", 6).alias("score"))


def require_resolved(resolved: DataFrame, entity: str) -> DataFrame:
    """Fail in the job on a name nobody matches well enough, rather than sign someone else."""
    bad = F.raise_error(F.concat(F.lit("no confident match for "), F.col("want")))
    return resolved.withColumn(entity, F.when(F.col(entity).isNull(), bad.cast("bigint")).otherwise(F.col(entity)))

