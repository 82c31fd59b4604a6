import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from math import comb

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.llm import minhash, mixing, quality, sharding, toxicity
from panelcast.llm.common import OWN

TREE = sharding.balanced_tree(3, 2, 4)


# sharding


@pytest.mark.parametrize("which", ["edge", "documents"])
def test_shards_hold_every_row_and_grow_into_the_new_one(request, which):
    docs = request.getfixturevalue(which)
    got = sharding.assign_shards(docs, TREE, keep=["text"]).collect()
    assert len(got) == docs.count()
    slots = defaultdict(list)
    for r in got:
        raw = (r["text"] or "").encode()
        assert r["size"] == len(raw) + 8 and r["text_crc32"] == zlib.crc32(raw) and r["law"] == "key"
        assert r["grown_shard"] in (r["shard"], 24) and 0 <= r["shard"] < 24
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_follow_weights_and_confine_movement(spark):
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    rack = lambda n, w: sharding.Node(n, tuple(sharding.Node(f"{n}-{i}", shard=int(n[1:]) * 2 + i, own_weight=w) for i in range(2)))
    before = sharding.Node("root", (sharding.Node("g0", (rack("r0", 1.0), rack("r1", 1.0))), sharding.Node("g1", (rack("r2", 2.0),))))
    after = sharding.Node("root", (before.children[0], sharding.Node("g1", (rack("r2", 3.0),))))
    a, b = (dict(sharding.assign_shards(docs, t).select("doc_id", "shard").collect()) for t in (before, after))
    share = Counter(a.values())
    assert all(abs(share[s] / 40_000 - w / 8) < 0.01 for s, w in {0: 1, 1: 1, 2: 1, 3: 1, 4: 2, 5: 2}.items())
    moved = [(a[i], b[i]) for i in a if a[i] != b[i]]
    assert moved and all(x < 4 <= y for x, y in moved)


# mixing


def brute_mix(rows, slots):
    """Every slot by earliest deadline first over all released blocks, no period."""
    period = sum(slots.values())
    names = sorted(slots, key=lambda s: (s is None, s or ""))
    blocks = {s: -(-sum(x == s for x in rows) // mixing.BLOCK_ROWS) for s in names}
    due, out = {s: 0 for s in names}, {}
    slot = 0
    while any(due[s] < blocks[s] for s in names):
        ready = [(-(-(due[s] + 1) * period // slots[s]), i, s) for i, s in enumerate(names) if due[s] * period // slots[s] <= slot]
        deadline, _, s = min(ready)
        if due[s] < blocks[s]:
            out[s, due[s]] = (slot, due[s] * period // slots[s], deadline)
        due[s] += 1
        slot += 1
    return out


@pytest.mark.parametrize("which", ["edge", "documents"])
def test_mixing_is_the_schedule(request, which):
    docs = request.getfixturevalue(which)
    got = mixing.mix_sources(docs, period=100).collect()
    assert len(got) == docs.count()
    counts = Counter(r["source"] for r in got)
    slots = mixing.whole_slots({s: n**mixing.POWER for s, n in counts.items()}, 100)
    assert sum(slots.values()) == 100
    want = brute_mix([r["source"] for r in got], slots)
    places = Counter()
    for r in got:
        s, k = r["source"], r[f"{OWN}block"]
        assert (r[f"{OWN}slot"], r[f"{OWN}release"], r[f"{OWN}deadline"]) == want[s, k]
        assert r[f"{OWN}release"] <= r[f"{OWN}slot"] < r[f"{OWN}deadline"]
        places[s, k, r[f"{OWN}place"]] += 1
    assert max(places.values()) == 1 and all(k * mixing.BLOCK_ROWS + p < counts[s] for s, k, p in places)


def test_mixing_stays_within_a_block_of_the_weights():
    slots = mixing.whole_slots({"a": 0.5, "b": 0.3, "c": 0.137, "d": 0.003}, 1000)
    seen = Counter()
    for n, (source, *_rest, slot) in enumerate(mixing.pfair_period(slots), 1):
        seen[source] += 1
        assert slot == n - 1 and all(abs(seen[s] - n * w / 1000) < 1 for s, w in slots.items())


@pytest.mark.parametrize("n", [20, 500])
def test_blocks_stay_within_one_of_the_given_weights(n):
    weights = [(n / 2) ** 0.7] + [(1 + i % 7 / 10) ** 0.7 for i in range(n - 1)]
    parts = mixing.whole_parts(weights)
    total = sum(parts)
    assert all(Fraction(p, q) == Fraction(v) / Fraction(w) for p, q, v, w in zip(parts, parts[1:], weights, weights[1:]))
    seen, worst = [0] * n, 0
    for at, (i, k, release, deadline, slot) in enumerate(mixing.pfair_blocks(parts, [10**6] * n)):
        if at == 6_000:
            break
        assert slot == at and release == k * total // parts[i] <= slot < deadline == -(-(k + 1) * total // parts[i]) and k == seen[i]
        seen[i] += 1
        if at % 37 == 0:
            worst = max(worst, *(abs(seen[s] * total - (at + 1) * p) for s, p in enumerate(parts)))
    assert worst < total


def test_mixing_keeps_exact_weights_over_many_periods(spark):
    # a third of the rows in one of twenty sources: whole slots of a period lag by almost three blocks each time round
    docs = spark.range(72_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "s00").otherwise(F.format_string("s%02d", F.col("id") % 19 + 1)).alias("source"))
    got = mixing.mix_sources(docs).collect()
    counts = Counter(r["source"] for r in got)
    assert len(got) == 72_000 and len(counts) == 20
    exact = {s: Fraction(float(n) ** mixing.POWER) for s, n in counts.items()}
    total = sum(exact.values())
    blocks = {(r["source"], r[f"{OWN}block"]): r for r in got}
    assert len(blocks) == len({r[f"{OWN}slot"] for r in blocks.values()}) == sum(-(-n // mixing.BLOCK_ROWS) for n in counts.values())
    for (s, k), r in blocks.items():
        assert k * total // exact[s] == r[f"{OWN}release"] <= r[f"{OWN}slot"] < r[f"{OWN}deadline"] == -(-(k + 1) * total // exact[s])


def test_sources_without_a_share_come_last(spark):
    docs = spark.createDataFrame([(i, s) for i, s in enumerate(["a"] * 50 + ["b"] * 30 + [None] * 20)], "doc_id long, source string")
    got = mixing.mix_sources(docs, weights={"a": 0.0, "b": 1.0}).collect()
    last = max(r[f"{OWN}slot"] for r in got if r["source"] != "a")
    assert len(got) == 100 and all(r[f"{OWN}slot"] > last for r in got if r["source"] == "a")


@pytest.mark.parametrize("seed", range(40))
def test_chunks_are_one_schedule(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 14))
    weights = [float(w) for w in (rng.random(n) + 0.01, rng.choice([1, 2, 3, 5, 7, 0.5, 0.1], n), rng.random(n) ** 6 + 0.01)[seed % 3]]
    parts = mixing.whole_parts(weights)
    total = sum(parts)
    longest = max(total // p + 2 for p in parts)
    whole = 6 * longest * np.array(weights) / sum(weights) + 1
    blocks = [int(b) for b in (whole if seed % 2 else whole * rng.random(n))]
    length, before, slots, seen, at = int(rng.integers(longest, 3 * longest)), [0] * n, set(), [0] * n, 0
    while before != blocks:
        after = mixing.blocks_before(parts, blocks, at + length)
        for i, k, release, deadline, slot in mixing.pfair_blocks(parts, after, before, at, at + length):
            assert k == seen[i] and slot not in slots and at <= slot < at + length
            assert k * total // parts[i] == release <= slot < deadline == -(-(k + 1) * total // parts[i])
            seen[i] += 1
            slots.add(slot)
        assert seen == after
        assert all(abs(a * total - min((at + length) * p, b * total)) < total for a, b, p in zip(after, blocks, parts))
        before, at = after, at + length


def test_borders_are_found_where_the_largest_shares_fail():
    # two blocks come out just before the border; taking the largest shares before it would put both into its last slot
    parts = [45, 45, *[1] * 10]
    for at in range(1, 400):
        counts = mixing.blocks_before(parts, [10**6] * 12, at)
        assert sum(counts) == at and all(abs(c * 100 - at * p) < 100 for c, p in zip(counts, parts))
    assert len(list(mixing.pfair_blocks(parts, mixing.blocks_before(parts, [10**6] * 12, 200), mixing.blocks_before(parts, [10**6] * 12, 99), 99, 200))) == 101


def test_mixing_in_many_chunks(spark, monkeypatch):
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 5).cast("string")).alias("source"))
    monkeypatch.setattr(mixing.block_schedule, "__defaults__", (64,))
    table = mixing.block_schedule(spark, docs.schema["source"].dataType, {"hot": 3.0, "0": 1.0, "1": 1.5, "2": 0.0}, {"hot": 13_333, "0": 9_000, "1": 5_000, "2": 77}, 8)
    rows = table.collect()
    assert table.rdd.getNumPartitions() > 1 and len(rows) == len({r[f"{OWN}slot"] for r in rows}) == sum(-(-n // 8) for n in (13_333, 9_000, 5_000, 77))
    assert all(r[f"{OWN}release"] <= r[f"{OWN}slot"] < r[f"{OWN}deadline"] for r in rows)
    assert min(r[f"{OWN}slot"] for r in rows if r[f"{OWN}s"] == "2") > max(r[f"{OWN}slot"] for r in rows if r[f"{OWN}s"] != "2")
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len({r["doc_id"] for r in got}) == 40_000 and all(r[f"{OWN}release"] <= r[f"{OWN}slot"] < r[f"{OWN}deadline"] for r in got)


@pytest.mark.parametrize("odd", [float("nan"), float("inf"), -1.0, 0.0])
@pytest.mark.parametrize("period", [None, 50])
def test_odd_weights_give_no_share(spark, odd, period):
    docs = spark.createDataFrame([(i, s) for i, s in enumerate(["a"] * 50 + ["b"] * 300 + [None] * 20)], "doc_id long, source string")
    got = mixing.mix_sources(docs, weights={"a": odd, "b": 1.0}, period=period).collect()
    assert len(got) == 370 and all(r[f"{OWN}slot"] is not None for r in got)
    if period is None:
        last = max(r[f"{OWN}slot"] for r in got if r["source"] != "a")
        assert all(r[f"{OWN}slot"] > last and r[f"{OWN}weight"] == 0 for r in got if r["source"] == "a")


def test_mixture_order_is_the_files_order(spark, documents):
    from panelcast.session import scratch_path

    path = scratch_path(spark, "mix")
    mixing.in_mixture_order(documents).write.parquet(path)
    import glob

    import pyarrow.parquet as pq

    ids = [i for f in sorted(glob.glob(f"{path.removeprefix('file://')}/*.parquet")) for i in pq.read_table(f, columns=["doc_id"]).column(0).to_pylist()]
    rows = mixing.mix_sources(documents).orderBy(f"{OWN}slot", f"{OWN}place").collect()
    assert ids == [r["doc_id"] for r in rows]


def test_too_many_sources_are_refused(documents):
    with pytest.raises(ValueError):
        mixing.mix_sources(documents, period=3)


# near-duplicates


@pytest.mark.parametrize("which", ["edge", "documents"])
def test_near_duplicates_are_the_components(request, which):
    docs = request.getfixturevalue(which)
    got = sorted((tuple(r) for r in minhash.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()), key=repr)
    assert got == sorted(brute.near_duplicates([(r["doc_id"], r["text"]) for r in docs.collect()]), key=repr)


def copies(rng, n, edits, words=150):
    base = [f"w{rng.integers(5_000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        t = list(base)
        for p in rng.integers(0, words, edits):
            t[p] = f"e{rng.integers(10**9)}"
        out.append(" ".join(t))
    return [" ".join(base), *out]


def test_star_and_chain_groups_lose_no_link(spark):
    rng = np.random.default_rng(5)
    texts = copies(rng, 60, 1) + copies(rng, 60, 2) + copies(rng, 40, 3)
    chain = [f"c{i}" for i in range(200)]
    for k in range(12):  # each link of the chain changes two more words: neighbours match, ends don't
        chain = list(chain)
        chain[10 + 12 * k] = f"x{k}"
        chain[11 + 12 * k] = f"y{k}"
        texts.append(" ".join(chain))
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [passage + " " + " ".join(f"q{rng.integers(10**9)}" for _ in range(40 + i % 60)) for i in range(200)]
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = sorted(tuple(r) for r in minhash.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect())
    assert got == sorted(brute.near_duplicates(rows))
    kept = minhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, _, c in got if i == c}


def test_blocks_of_a_list_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = np.random.default_rng(6)
    rows = list(enumerate(copies(rng, 40, 2)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in minhash.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()) == sorted(brute.near_duplicates(rows))


def test_a_similar_pair_is_missed_by_chance_in_few_cases():
    tail = lambda n, most: sum(comb(n, k) * 0.85**k * 0.15 ** (n - k) for k in range(most + 1))
    assert tail(minhash.POSTED, minhash.SHARED - 1) < 1e-5 and tail(minhash.COORDINATES, minhash.MATCHES - 1) < 3e-5


@pytest.mark.parametrize("percent", [80, 55])
def test_thresholds_follow_the_similarity(spark, percent):
    # pairs just at and above the similarity, where thresholds made for 0.85 would lose some or all
    rng, rows = np.random.default_rng(percent), []
    for k in range(150):
        words = [f"w{rng.integers(10**9)}" for _ in range(204)]
        cut = int(200 * percent / 100) + k % 4
        rows += [(2 * k, " ".join(words[: 4 + cut])), (2 * k + 1, " ".join(words))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in minhash.near_duplicates(docs, percent=percent).select("doc_id", "n_shingles", "component_id").collect())
    assert got == sorted(brute.near_duplicates(rows, percent)) and sum(i != c for i, _, c in got) == 150
    tail = lambda n, most: sum(comb(n, j) * (percent / 100) ** j * (1 - percent / 100) ** (n - j) for j in range(most + 1))
    assert tail(minhash.POSTED, minhash.shared_at(percent) - 1) < minhash.MISS_POSTED and tail(minhash.COORDINATES, minhash.matches_at(percent) - 1) < minhash.MISS_ALL


def test_the_contract_of_op3_keeps_its_thresholds():
    assert (minhash.shared_at(85), minhash.matches_at(85)) == (16, 91)


def test_keep_one_of_each_on_odd_rows(edge):
    got = minhash.keep_one_of_each(edge)
    ids = Counter(r["doc_id"] for r in got.collect())
    assert ids[1] == 1 and ids[2] == 0 and ids[None] == 1 and ids[3] == ids[4] == ids[5] == 1 and ids[7] == 0


# quality


@pytest.mark.parametrize("which", ["edge", "documents"])
def test_quality_counts(request, which):
    docs = request.getfixturevalue(which)
    got = quality.with_counts(docs.select("doc_id", "text")).collect()
    for r in got:
        n = [r[f"{OWN}{c}"] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
        assert tuple(n) == brute.quality_counts(r["text"]), r["doc_id"]


def test_binomial_bound_is_exact(spark):
    cases = [(n, a, e) for n in (0, 1, 50, 1000, 1800, 20_000) for a in (0.005, 0.02) for e in (1e-4, 0.05)]
    df = spark.createDataFrame([(n, float(a), float(e)) for n, a, e in cases], "n long, a double, e double")
    for r in quality.allowed_rejections(df, "n", F.col("a"), F.col("e"), "k").collect():
        total, k = 0.0, -1
        term = (1 - r["a"]) ** r["n"]
        for j in range(r["n"] + 1):
            total += term
            if total > r["e"]:
                break
            k, term = j, term * (r["n"] - j) / (j + 1) * r["a"] / (1 - r["a"])
        assert r["k"] == k, r


def test_cutoffs_hold_the_risk_and_reject_the_bad(spark):
    rng = np.random.default_rng(2)
    rows, marks = [], []
    for i in range(6_000):
        bad = i % 5 == 0
        words = [f"{'ab' * int(rng.integers(1, 4))}{rng.integers(1000)}" + ("%%%" if bad else "") for _ in range(30)]
        rows.append((i, " ".join(words), "en" if i % 2 else None))
        marks.append((i, int(not bad), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["kept"] for r in quality.apply_quality_rules(docs, labels).collect()}
    good = [i for i, g, _ in marks if g]
    assert sum(not got[i] for i in good) <= quality.ALPHA * len(good) and not any(got[i] for i, g, _ in marks if not g)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, k in got.items() if k}


def test_few_labels_leave_the_base_rule(edge, labels):
    got = quality.apply_quality_rules(edge, labels).collect()
    assert len(got) == edge.count() and all(r["kept"] != r["base_failed"] for r in got)
    assert quality.keep_good(edge, labels.limit(0)).count() == sum(r["kept"] for r in got)


# toxicity


def test_toxicity_on_held_out_rows(spark, documents, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    got = toxicity.score_toxicity(documents, labels).join(labels.select("doc_id", "toxic"), "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in got)
    right = sum(r["predicted"] == r["toxic"] for r in got)
    assert right / len(got) > 0.93 and all(0 <= r["score"] <= 1 for r in got)


def test_labels_of_held_out_rows_are_not_learnt(spark, documents, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, toxicity.score_toxicity(documents, x).collect())) for x in (labels, turned))
    assert a == b


def test_label_model_finds_accuracies_and_correlations():
    rng = np.random.default_rng(3)
    y = rng.random(20_000) < 0.2
    votes = np.stack([np.where(y, rng.random(y.size) < p, rng.random(y.size) < q) for p, q in ((0.7, 0.02), (0.6, 0.03), (0.5, 0.01), (0.65, 0.02))], 1)
    votes = np.hstack([votes, votes[:, :1] ^ (rng.random((y.size, 1)) < 0.02)])
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    post, rates, corr = toxicity.label_model(patterns.astype(float), counts.astype(float), 0.2)
    assert abs(rates[1, 1] - 0.6) < 0.06 and rates[2, 0] < 0.05 and corr[0, 4] > toxicity.CORRELATED > abs(corr[1, 2])


def test_toxicity_on_odd_rows(edge, labels, empty):
    got = toxicity.score_toxicity(edge, labels).collect()
    assert len(got) == edge.count() and all(r["predicted"] == 0 for r in got)
    kept = toxicity.drop_toxic(edge, labels)
    assert kept.columns == edge.columns and kept.count() == edge.count()
    assert toxicity.score_toxicity(empty, labels).count() == 0


def test_empty_tables(empty, labels):
    assert sharding.assign_shards(empty, TREE).count() == mixing.mix_sources(empty).count() == 0
    assert minhash.near_duplicates(empty).count() == quality.apply_quality_rules(empty, labels).count() == 0
    assert minhash.keep_one_of_each(empty).count() == quality.keep_good(empty, labels).count() == mixing.in_mixture_order(empty).count() == 0


def test_different_texts_under_one_key_are_documents_of_their_own(spark):
    """In any order of the rows the duplicate goes and the unrelated text under its key stays."""
    words = [f"w{i}" for i in range(60)]
    a, b, c = " ".join(words), " ".join(f"b{i}" for i in range(60)), " ".join(f"c{i}" for i in range(60))
    near = " ".join([*words, "tail"])
    rows = [(3, a, 1), (5, near, 2), (5, b, 3), (5, b, 4), (7, c, 5), (7, c + " x", 6), (None, c, 7), (None, b + " y", 8), (None, None, 9), (None, None, 10), (8, "", 11), (8, " \n", 12), (None, "some other words without a key", 13)]
    for order in (rows, rows[::-1], rows[5:] + rows[:5]):
        got = minhash.keep_one_of_each(spark.createDataFrame(order, "doc_id long, text string, n int")).collect()
        kept = Counter((r["doc_id"], (r["text"] or "").split(" ")[0]) for r in got)
        assert kept[3, "w0"] == 1 and kept[5, "b0"] == 1 and kept[7, "c0"] == 1 and kept[None, "some"] == 1
        assert kept[None, ""] == 2 and sum(n for (k, _), n in kept.items() if k == 8) == 2 and sum(kept.values()) == 8


def test_a_long_text_is_scored_by_all_its_hits(spark):
    model = toxicity.Model(["bad"], [0.0], 0.1, -1.0, [], [])
    rows = spark.createDataFrame([(1, "bad " * 25), (2, "bad " * 500)], "doc_id long, text string")
    low, high = (r["score"] for r in toxicity.with_score(rows, model).orderBy("doc_id").collect())
    assert low < high
