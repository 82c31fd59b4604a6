"""Toxicity by weak supervision.

A lexicon is mined from labelled rows: words, and word beginnings of four and five letters, that toxic documents hold
far more often than others. The terms are dealt to lexicon voters; pattern voters look at how many different terms a
document has and how dense they are. Voters fire or abstain. A generative label model of two hidden classes estimates
how often each voter fires in either class (expectation maximisation over the table of vote patterns), then the
correlations that remain between voters inside the classes; voters that move together share one vote. The model's
posterior labels train a linear classifier on the terms found in a document. Scoring reads the whole text and nothing else.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.llm.common import OWN, byte_slices
from panelcast.session import materialise

#: Bound of the labelled sample that everything is learnt from; rows are taken by a hash of their key.
SAMPLE_ROWS = 20_000
#: Terms of the lexicon, and the voters they are dealt to.
TERMS, LEXICON_VOTERS = 256, 8
#: A term is in at least this share of toxic sample documents (and in so many), and that much likelier in them.
MIN_SHARE, MIN_DOCS, MIN_ODDS = 0.004, 5, 10.0
PREFIXES = (4, 5)
#: Voters correlated beyond this inside the classes count as one.
CORRELATED = 0.3

WORD = re.compile(r"[^\W\d_]+")


def terms_of(word: str) -> tuple[str, ...]:
    """The word itself and its beginnings, marked as such."""
    return (word, *(word[:n] + "*" for n in PREFIXES if len(word) > n))


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


@dataclass
class Model:
    """Terms with their voters and weights, and the intercept; plain numbers that travel with the tasks."""

    terms: list[str] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    repeat_weight: float = 0.0
    intercept: float = -2.0
    accuracies: list[tuple[float, float]] = field(default_factory=list)
    correlations: list[list[float]] = field(default_factory=list)


class Finder:
    """Finds the lexicon's terms in texts; what a word holds is kept per worker, up to a bound."""

    def __init__(self, terms: list[str]):
        self.number, self.memo = {t: i for i, t in enumerate(terms)}, {}

    def __call__(self, text: str) -> tuple[Counter, int]:
        words = words_of(text)
        if len(self.memo) > 300_000:
            self.memo.clear()
        found, memo = Counter(), self.memo
        for w in words:
            hit = memo.get(w)
            if hit is None:
                hit = memo[w] = tuple(self.number[t] for t in terms_of(w) if t in self.number)
            if hit:
                found.update(hit)
        return found, len(words)


def training_rows(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, sample_rows: int) -> DataFrame:
    """Distinct texts with a label (0 or 1) that may be learnt from: the checksum of the key modulo 5 is not 0."""
    allowed = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull() & (F.crc32(F.col(key).cast("string").cast("binary")) % 5 != 0))
    given = allowed.groupBy(F.col(key).alias(f"{OWN}key")).agg(F.max(F.col(label).cast("int")).alias("label"))
    n = given.count()
    if n > sample_rows:
        given = given.filter((F.xxhash64(f"{OWN}key") % 1_000_000 + 1_000_000) % 1_000_000 < int(1_000_000 * sample_rows / n))
    rows = docs.filter(F.col(text).isNotNull()).join(F.broadcast(given), F.col(key) == F.col(f"{OWN}key"))  # about sample_rows rows
    return rows.groupBy(F.col(text).cast("string").alias("text")).agg(F.max("label").alias("label"))


def count_terms(rows: DataFrame, only: list[str] | None) -> DataFrame:
    """(term, n): in how many texts each term occurs; partial counts per task first."""
    wanted = set(only) if only is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])
            counts.clear()
            return batch

        for batch in byte_slices(batches, "text"):
            for text in batch.column(0).to_pylist():
                terms = {t for w in set(words_of(text)) for t in terms_of(w)}
                counts.update(terms if wanted is None else terms & wanted)
            if len(counts) > 200_000:
                yield out()
        if counts:
            yield out()

    return rows.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def mine_lexicon(rows: DataFrame, n_toxic: int, n_other: int) -> list[str]:
    """Terms by falling log-odds weighted by their number; the candidates are bounded by the share they must reach."""
    least = max(MIN_DOCS, int(MIN_SHARE * n_toxic))
    toxic = {r["term"]: r["n"] for r in count_terms(rows.filter("label = 1"), None).filter(F.col("n") >= least).collect()}
    other = {r["term"]: r["n"] for r in count_terms(rows.filter("label = 0"), sorted(toxic)).collect()} if toxic else {}
    scored = []
    for t, n in toxic.items():
        p, q = (n + 0.5) / (n_toxic + 1), (other.get(t, 0) + 0.5) / (n_other + 1)
        odds = p * (1 - q) / (q * max(1 - p, 1e-9))
        if odds >= MIN_ODDS:
            scored.append((-n * float(np.log(odds)), t))
    return [t for _, t in sorted(scored)[:TERMS]]


def votes_of(found: Counter, n_words: int, n_terms: int) -> int:
    """Votes as bits: lexicon voters by the term's number, then at least two hits, then a hit in 200 words."""
    bits, hits = 0, sum(found.values())
    for i in found:
        bits |= 1 << (i % LEXICON_VOTERS)
    return bits | (hits >= 2) << LEXICON_VOTERS | (hits * 200 >= max(n_words, 1)) << (LEXICON_VOTERS + 1)


def label_model(patterns: np.ndarray, counts: np.ndarray, prior: float, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior per pattern, firing rates (voter, class), and correlations inside the classes.

    `patterns` has a row per distinct vote pattern, at most two to the number of voters.
    """
    m = patterns.shape[1]
    share = np.ones(m)
    fired = patterns.sum(1)
    post = np.where(fired > 0, 0.9, 0.1 * prior)
    corr = np.zeros((m, m))
    for phase in range(2):
        for _ in range(rounds):
            w = np.stack([counts * (1 - post), counts * post])
            rates = ((w @ patterns) + 0.5) / (w.sum(1, keepdims=True) + 1.0)
            pi = np.clip(w[1].sum() / max(counts.sum(), 1), 1e-4, 1 - 1e-4)
            ll = patterns @ (share * np.log(rates)).T + (1 - patterns) @ (share * np.log(1 - rates)).T
            post = 1 / (1 + np.exp(np.clip(np.log((1 - pi) / pi) + ll[:, 0] - ll[:, 1], -500, 500)))
        if phase == 0:
            cov, var = np.zeros((m, m)), np.zeros(m)
            for c, weight in enumerate((counts * (1 - post), counts * post)):
                d = patterns - rates[c]
                cov += (d * weight[:, None]).T @ d
                var += (weight[:, None] * d * d).sum(0)
            corr = cov / np.sqrt(np.outer(var, var) + 1e-12)
            np.fill_diagonal(corr, 1.0)
            share = 1.0 / (np.abs(corr) >= CORRELATED).sum(1)
    return post, rates.T, corr


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.02, steps: int = 25) -> np.ndarray:
    """Weights of a linear classifier for soft labels y by Newton steps with a ridge; the last one is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    pull = np.full(x.shape[1], ridge)
    pull[-1] = 1e-6
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (weight * (p - y)) + pull * b
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(pull + 1e-9)
        move = np.linalg.solve(h, grad)
        b -= np.clip(move, -3, 3)
        if np.abs(move).max() < 1e-6:
            break
    return b


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """The model from a bounded sample of labelled rows. Without toxic rows, a model that scores every text low."""
    rows = materialise(training_rows(docs, labels, key, text, label, sample_rows), "toxicity")
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n_toxic, n_other = sizes.get(1, 0), sizes.get(0, 0)
    terms = mine_lexicon(rows, n_toxic, n_other) if n_toxic else []
    if not terms:
        return Model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder(terms)
        for batch in byte_slices(batches, "text"):
            votes, hits = [], []
            for t in batch.column(0).to_pylist():
                found, n = find(t)
                votes.append(votes_of(found, n, len(terms)))
                hits.append(sorted(found.items()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(votes, pa.int32()), pa.array([[i for i, _ in h] for h in hits], pa.list_(pa.int32())), pa.array([sum(c for _, c in h) for h in hits], pa.int32())], names=["votes", "found", "hits"]
            )

    seen = rows.select("text").mapInArrow(run, "votes int, found array<int>, hits int")
    sample = seen.groupBy("votes", "found", "hits").agg(F.count(F.lit(1)).alias("n")).collect()  # of a bounded sample
    voters = LEXICON_VOTERS + 2
    codes, place = np.unique([r["votes"] for r in sample], return_inverse=True)
    n = np.asarray([r["n"] for r in sample], float)
    counts = np.bincount(place, weights=n)
    patterns = (codes[:, None] >> np.arange(voters) & 1).astype(float)
    post, rates, corr = label_model(patterns, counts, n_toxic / (n_toxic + n_other))
    x = np.zeros((len(sample), len(terms) + 1), np.float32)
    for i, r in enumerate(sample):
        x[i, r["found"]] = 1
        x[i, -1] = np.log1p(r["hits"])
    b = logistic(x.astype(float), post[place], n)
    return Model(terms, [float(v) for v in b[:-2]], float(b[-2]), float(b[-1]), [(float(a), float(c)) for a, c in rates], corr.tolist())


def with_score(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """All columns of `docs` and the score (0 to 1) of every whole text; a null or empty text scores by the intercept."""
    schema = T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder(model.terms)
        for batch in byte_slices(batches, text):
            z = []
            for t in batch.column(at).to_pylist():
                found, _ = find(t or "")
                z.append(model.intercept + sum(model.weights[i] for i in found) + model.repeat_weight * np.log1p(sum(found.values())))
            p = 1 / (1 + np.exp(-np.clip(np.asarray(z, float), -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=schema.names)

    return docs.mapInArrow(run, schema)


def score_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """One row per document: key, held_out, score, predicted. Repeated rows score alike; a null key is held out of learning."""
    model = train(docs, labels, key, text, label)
    scored = with_score(docs.select(F.col(key), F.col(text).cast("string").alias("text")), model)
    held = F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(True))
    return scored.select(key, held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """The documents, with all their columns, that score under one half."""
    model = train(docs, labels, key, text, label)
    return with_score(docs, model, text, f"{OWN}score").filter(F.col(f"{OWN}score") < 0.5).drop(f"{OWN}score")
