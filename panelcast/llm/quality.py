"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Every document gets counts over its whole text and, from them, a few rule values (higher is worse). For each stratum
(language) and rule, a fixed grid of cutoffs is tested on the labelled documents: a cutoff passes when the number of
good documents beyond it is so low that, by the exact binomial bound, the share of good documents rejected exceeds the
allowed one with at most the error probability. The error probability is divided by the number of all tests (strata,
rules, cutoffs), the allowed share by the number of rules, so that with the stated confidence no stratum loses
more than the allowed share of its good documents to all rules together. Of the cutoffs that pass, the one with the
best yield is used; a stratum with too few labels has no cutoff and keeps what the base rule keeps.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.common import OWN
from panelcast.session import materialise

SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[ \t-\r]+"
#: Allowed share of good documents rejected in a stratum, and the probability of exceeding it anywhere.
ALPHA, DELTA = 0.02, 0.05
#: A good document rejected outweighs this many bad ones when cutoffs that pass are compared.
COST_RATIO = 10
#: Rule values and their cutoffs. A document is rejected where its value is above the cutoff.
GRID: dict[str, tuple[float, ...]] = {
    "symbol_share": (0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3),
    "repeat_share": (0.02, 0.04, 0.06, 0.08, 0.1, 0.12, 0.15, 0.18),
    "dup_line_share": (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5),
    "word_length": (6.5, 7.0, 7.5, 8.0, 9.0, 10.0, 12.0, 15.0),
}


def _with(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.withColumn(f"{OWN}{name}", value)


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines, prefixed with the operator's mark.

    Repeated words are found inside the row: the 5-word windows are hashed, equal hashes side by side in sorted order
    give the places of repeated windows, and the places' covered words are counted. Nothing is exploded or shuffled.
    """
    raw = F.coalesce(F.col(text).cast("string"), F.lit(""))
    trimmed = F.trim(raw, F.lit(SPACE))
    df = _with(docs, "words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS)))
    words = F.col(f"{OWN}words")
    df = _with(df, "n_words", F.size(words).cast("long"))
    df = _with(df, "word_chars", F.length(F.array_join(words, "")).cast("long"))
    df = _with(df, "n_symbols", F.length(F.regexp_replace(raw, r"[^#*$%&|<>]+", "")).cast("long"))
    df = _with(df, "lines", F.filter(F.split(raw, "\n"), lambda x: x.rlike(r"[^ \t-\r]")))
    df = _with(df, "n_lines", F.size(f"{OWN}lines").cast("long"))
    df = _with(df, "n_dup_lines", F.col(f"{OWN}n_lines") - F.size(F.array_distinct(f"{OWN}lines")))
    n = F.col(f"{OWN}n_words").cast("int")
    windows = F.when(n < 6, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 4, F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, F.lit(5)))))
    df = _with(df, "windows", windows)
    w = F.col(f"{OWN}windows")
    placed = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = _with(df, "placed", F.when(F.size(F.array_distinct(w)) < F.size(w), placed))
    p = F.col(f"{OWN}placed")
    again = F.filter(
        F.transform(p, lambda x, i: F.when((x["h"] == F.try_element_at(p, i + 2)["h"]) | ((i > 0) & (x["h"] == F.try_element_at(p, F.when(i > 0, i).otherwise(1))["h"])), x["i"])),
        lambda i: i.isNotNull(),
    )
    df = _with(df, "places", F.when(p.isNotNull(), F.sort_array(again)))
    q = F.col(f"{OWN}places")
    covered = F.aggregate(q, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-5).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(5), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
    df = _with(df, "n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))
    return df.drop(*[f"{OWN}{c}" for c in ("words", "lines", "windows", "placed", "places")])


def base_failed() -> Column:
    n, r = F.col(f"{OWN}n_words"), F.col(f"{OWN}n_repeat_words")
    return (n < 10) | (100 * r > 20 * n)


def rule_values() -> dict[str, Column]:
    c = {k: F.col(f"{OWN}{k}").cast("double") for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")}

    def share(a: str, b: str) -> Column:
        return F.when(c[b] > 0, c[a] / c[b]).otherwise(F.lit(0.0))

    return {"symbol_share": share("n_symbols", "word_chars"), "repeat_share": share("n_repeat_words", "n_words"), "dup_line_share": share("n_dup_lines", "n_lines"), "word_length": share("word_chars", "n_words")}


def ln_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x >= 1: Stirling's series at x + 8, brought back by the recurrence."""
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.5 * F.log(F.lit(2.0) * F.pi()) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5.0))) - 1 / (1680 * F.pow(y, F.lit(7.0)))
    back = F.log(x)
    for k in range(1, 8):
        back = back + F.log(x + k)
    return series - back


def allowed_rejections(sizes: DataFrame, n: str, share: Column, error: Column, into: str) -> DataFrame:
    """Adds the largest k with P(Binomial(n, share) <= k) <= error, -1 if there is none: k rejections certify the share.

    The sum runs over whole numbers from 40 deviations below the mean up to the mean; below them the mass is nil.
    """
    m = F.col(n).cast("double")
    mean = m * share
    low = F.greatest(F.lit(0.0), F.floor(mean - 40 * F.sqrt(mean + 1)))
    terms = sizes.withColumn(f"{OWN}mean", mean).withColumn(f"{OWN}low", low.cast("long")).withColumn(f"{OWN}high", F.least(F.ceil(mean), F.col(n)).cast("long"))

    def mass(j: Column) -> Column:
        x = j.cast("double")
        return F.exp(ln_gamma(m + 1) - ln_gamma(x + 1) - ln_gamma(m - x + 1) + x * F.log(share) + (m - x) * F.log(1 - share))

    run = F.aggregate(
        F.sequence(F.col(f"{OWN}low"), F.col(f"{OWN}high")), F.struct(F.lit(0.0).alias("p"), F.lit(-1).cast("long").alias("k")),
        lambda a, j: F.struct((a["p"] + mass(j)).alias("p"), F.when(a["p"] + mass(j) <= error, j).otherwise(a["k"]).alias("k")), lambda a: a["k"],
    )
    return terms.withColumn(into, run).drop(f"{OWN}mean", f"{OWN}low", f"{OWN}high")


def select_cutoffs(measured: DataFrame, labels: DataFrame, stratum: str, key: str = "doc_id", label: str = "quality", grid: Mapping[str, Sequence[float]] = GRID, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per stratum with a cutoff or null for every rule, in columns cut_<rule>, and what certified it.

    `measured` holds key, stratum, the rule values and base_failed. Only labelled documents that pass the base rule
    count: the cutoffs' risk is about them. Labels null or repeated count once per document and label.
    """
    given = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias(f"{OWN}key"), F.col(label).alias(f"{OWN}label")).distinct()
    rows = measured.filter(~F.col(f"{OWN}base_failed")).join(given, F.col(key) == F.col(f"{OWN}key"))
    good, tests = F.col(f"{OWN}label") == 1, sum(len(g) for g in grid.values())
    counts = [F.count(F.when(good, 1)).alias("n_good")]
    for r, cuts in grid.items():
        for i, c in enumerate(cuts):
            beyond = F.col(f"{OWN}{r}") > c
            counts += [F.count(F.when(good & beyond, 1)).alias(f"g_{r}_{i}"), F.count(F.when(~good & beyond, 1)).alias(f"b_{r}_{i}")]
    per = rows.groupBy(F.col(stratum).alias(f"{OWN}stratum")).agg(*counts)
    strata = per.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias(f"{OWN}strata"))  # one row
    per = per.join(F.broadcast(strata), F.lit(True))
    per = allowed_rejections(per, "n_good", F.lit(alpha / len(grid)), F.lit(delta) / (F.col(f"{OWN}strata") * tests), "k_allowed")
    for r, cuts in grid.items():
        choices = F.array(*[
            F.when((F.col(f"g_{r}_{i}") <= F.col("k_allowed")) & (F.col(f"b_{r}_{i}") > COST_RATIO * F.col(f"g_{r}_{i}")),
                   F.struct((F.col(f"b_{r}_{i}") - COST_RATIO * F.col(f"g_{r}_{i}")).alias("yield"), F.lit(c).cast("double").alias("cut")))
            for i, c in enumerate(cuts)
        ])
        per = per.withColumn(f"cut_{r}", F.array_max(choices)["cut"])  # nulls are skipped; ties go to the looser cutoff
    return per.select(f"{OWN}stratum", "n_good", "k_allowed", *[f"cut_{r}" for r in grid])


def measure(docs: DataFrame, carry: Sequence[str], text: str = "text") -> DataFrame:
    """`carry`, the counts, base_failed and the rule values of every document."""
    df = with_counts(docs.select(*carry, text), text)
    df = _with(df, "base_failed", base_failed())
    for r, v in rule_values().items():
        df = _with(df, r, v)
    return df.drop(text) if text not in carry else df


def with_verdict(measured: DataFrame, cutoffs: DataFrame, stratum: str, grid: Mapping[str, Sequence[float]] = GRID) -> DataFrame:
    """Adds the operator's `kept`: not base_failed, and no rule value above its stratum's cutoff."""
    joined = measured.join(cutoffs, F.col(stratum).eqNullSafe(F.col(f"{OWN}stratum")), "left")
    beyond = F.lit(False)
    for r in grid:
        beyond = beyond | F.coalesce(F.col(f"{OWN}{r}") > F.col(f"cut_{r}"), F.lit(False))
    return joined.withColumn(f"{OWN}kept", ~F.col(f"{OWN}base_failed") & ~beyond)


def apply_quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """One row per document: key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    A null text has no words and fails the base rule. A null stratum is a stratum. Empty tables give no rows; without
    labels only the base rule acts. Repeated rows are judged alike. The counts are written once and read twice.
    """
    measured = materialise(measure(docs, [key, stratum], text), "quality")
    out = with_verdict(measured, select_cutoffs(measured, labels, stratum, key, label), stratum)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return out.select(key, *[F.col(f"{OWN}{c}").alias(c) for c in counts])


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang", key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """The documents, with all their columns, that the rules keep. Texts are measured once; rejected rows are taken out by key and text hash."""
    mark = F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))
    slim = measure(_with(docs.select(key, stratum, text), "text_hash", mark), [key, stratum, f"{OWN}text_hash"], text)
    slim = materialise(slim, "quality")
    verdict = with_verdict(slim, select_cutoffs(slim, labels, stratum, key, label), stratum)
    gone = verdict.filter(~F.col(f"{OWN}kept")).select(F.col(key).alias(f"{OWN}key"), F.col(f"{OWN}text_hash").alias(f"{OWN}gone")).distinct()
    marked = _with(docs, "mark", mark)
    out = marked.join(gone, (F.col(f"{OWN}mark") == F.col(f"{OWN}gone")) & F.col(key).eqNullSafe(F.col(f"{OWN}key")), "left_anti")
    return out.select(*[F.col(c) for c in docs.columns])
