"""Toxicity by weak supervision.

Terms that stand out among the toxic training texts are counted over all of these, and dealt to lexicon voters; pattern
voters stand beside them.  A generative label model learns, without labels, how often each voter fires on toxic and on
other texts, and which voters repeat each other, from the counts of the vote patterns of all training texts.  A linear
classifier on terms and votes is trained on the model's posterior labels of a bounded sample and scores every text.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import crc32_fold, fresh, with_read, written

#: Lexicons that the mined terms are dealt to; the number of voters bounds the vote patterns at 2 ** VOTERS.
LEXICONS = 8
# fixed values: common English insults, and the shapes of masked or shouted ones
_INSULTS = frozenset("idiot idiots moron morons stupid scum loser losers pathetic worthless disgusting trash clown vermin dumb imbecile filth filthy".split())
_PATTERNS = (
    re.compile(r"\b(?:you|u|they|he|she)(?:\s+(?:are|r|is)|'re|'s)\s+(?:an?\s+|such\s+|all\s+|so\s+)*(?:" + "|".join(sorted(_INSULTS)) + r")\b"),
    re.compile(r"\b[a-z]{1,2}[*@#$%]{2,}[a-z]*\b"),
    re.compile(r"\b(?:kill|hurt|destroy|hate)\s+(?:you|them|him|her|all)\b"),
    re.compile(r"!{3,}|\?!\?"),
)
VOTERS = LEXICONS + 1 + len(_PATTERNS) + 2
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the texts the classifier is fitted on.

    A term is mined if at least ``least_toxic`` toxic texts have it, if ``least_share`` of the texts with it are toxic,
    and if so many toxic texts are unlikely by chance: among all such terms about ``doubt`` would be expected by chance.
    """

    least_toxic: int = 3
    least_share: float = 0.9
    doubt: float = 1.0
    sample: int = 20_000
    threshold: float = 0.3


def _terms_of(text: Column) -> Column:
    return F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+"))


def mined_terms(labelled: DataFrame, base: float, settings: Settings) -> list[str]:
    """All words of the labelled texts (text, toxic, copies) that mark toxic ones, the strongest first.

    A text counts once, however many ``copies`` of its row there are.  The share of toxic texts among those with a word is
    smoothed by ``base``, that of all.
    """
    rows = labelled.select("toxic", "copies", F.explode(_terms_of(F.col("text"))).alias("term")).filter("term <> ''")
    # the fractions of a text's copies add up to one text; rounded, the sums are whole again
    counts = rows.groupBy("term").agg(F.round(F.sum(F.col("toxic") / F.col("copies"))).alias("toxic"), F.round(F.sum(1 / F.col("copies"))).alias("n"))
    share = (F.col("toxic") + base) / (F.col("n") + 1)
    likely = written(
        counts.filter(F.col("toxic") >= settings.least_toxic).withColumn("share", share)
        .withColumn("evidence", F.col("toxic") * F.log(F.col("share") / (base + 1e-3))), "terms"
    )
    least = math.log(max(1, likely.count()) / settings.doubt)
    best = likely.filter((F.col("toxic") >= settings.least_share * F.col("n")) & (F.col("evidence") >= least)).orderBy(F.desc("evidence"), "term")
    return best.select("term").toArrow()["term"].to_pylist()


def _read(text: str | None, number: dict[str, int]) -> tuple[int, list[int]]:
    """The votes as bits, and the numbers of the terms that occur."""
    lowered = (text or "").lower()
    found = _WORD.findall(lowered)
    kinds = set(found)
    terms = sorted(number[w] for w in number.keys() & kinds)
    votes = 0
    for t in terms:
        votes |= 1 << (t % LEXICONS)
    bit = LEXICONS
    if kinds & _INSULTS:
        votes |= 1 << bit
    for pattern in _PATTERNS:
        bit += 1
        if pattern.search(lowered):
            votes |= 1 << bit
    if len(terms) >= 2:
        votes |= 1 << (bit + 1)
    if terms and 100 * sum(w in number for w in found) >= len(found):
        votes |= 1 << (bit + 2)
    return votes, terms


def _features(terms: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(terms)}
        for batch in batches:
            read = [_read(text, number) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([v for v, _ in read], pa.int32()), pa.array([t for _, t in read], pa.list_(pa.int32()))], ["rank", "votes", "terms"]
            )

    return run


class LabelModel:
    """Two classes; each voter fires at a rate of its own in each.  Fitted to the counts of vote patterns.

    Voters that still agree within a class, beyond chance, share their evidence: a voter's weight is divided by one plus
    its positive correlations with the others, which are estimated between two fits.
    """

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, prior: float):
        fired = ((patterns[:, None] >> np.arange(VOTERS)) & 1).astype(float)
        self.weight = np.ones(VOTERS)
        # a text on which more voters fire is the likelier toxic one to begin with
        posterior = np.where(fired.sum(1) >= 2, 0.9, np.where(fired.sum(1) == 1, 0.5, 0.01))
        for _ in range(2):
            for _ in range(60):
                self._rates(fired, counts, posterior, prior)
                posterior = self.posterior(patterns)
            self.weight = 1 / (1 + self._correlations(fired, counts, posterior))
        self._rates(fired, counts, posterior, prior)

    def _rates(self, fired: np.ndarray, counts: np.ndarray, posterior: np.ndarray, prior: float) -> None:
        one, zero = counts * posterior, counts * (1 - posterior)
        self.rate1 = (one @ fired + 0.5) / (one.sum() + 1)
        self.rate0 = (zero @ fired + 0.05) / (zero.sum() + 1)
        self.rate0 = np.minimum(self.rate0, self.rate1)  # no voter speaks against
        self.prior = (one.sum() + 10 * prior) / (counts.sum() + 10)

    def _correlations(self, fired: np.ndarray, counts: np.ndarray, posterior: np.ndarray) -> np.ndarray:
        total = np.zeros(VOTERS)
        for mass in (counts * posterior,):
            mean = mass @ fired / max(mass.sum(), 1e-9)
            centred = fired - mean
            covariance = (centred * mass[:, None]).T @ centred / max(mass.sum(), 1e-9)
            spread = np.sqrt(np.maximum(np.diag(covariance), 1e-9))
            correlation = covariance / np.outer(spread, spread)
            np.fill_diagonal(correlation, 0)
            total += np.where(correlation > 0.1, correlation, 0).sum(1)
        return total

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        fired = ((patterns[:, None] >> np.arange(VOTERS)) & 1).astype(float)
        r1, r0 = np.clip(self.rate1, 1e-6, 1 - 1e-6), np.clip(self.rate0, 1e-6, 1 - 1e-6)
        odds = np.log(self.prior / (1 - self.prior)) + fired @ (self.weight * np.log(r1 / r0)) + (1 - fired) @ (self.weight * np.log((1 - r1) / (1 - r0)))
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def _columns(votes: int, terms: list[int]) -> list[int]:
    """The features that are on: votes first, then terms."""
    return [b for b in range(VOTERS) if votes >> b & 1] + [VOTERS + t for t in terms]


def _fit_linear(rows: list[tuple[int, list[int]]], target: np.ndarray, n_terms: int) -> tuple[np.ndarray, float]:
    """Logistic regression on the posterior labels, by full gradients with momentum and a weak ridge."""
    on = [_columns(v, t) for v, t in rows]
    row = np.repeat(np.arange(len(on)), [len(x) for x in on])
    column = np.array([c for x in on for c in x], np.int64)
    size, n = VOTERS + n_terms, len(on)
    weight, bias, step, bias_step = np.zeros(size), float(np.log((target.mean() + 1e-3) / (1.001 - target.mean()))), np.zeros(size), 0.0
    scale = 1 / np.sqrt(np.bincount(column, minlength=size) + 1.0)
    for _ in range(300):
        score = bias + np.bincount(row, weight[column], minlength=n)
        error = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - target
        gradient = np.bincount(column, error[row], minlength=size) + 0.05 * weight
        step = 0.9 * step - 0.5 * scale * gradient / np.sqrt(len(on[0]) + 8 if on else 1)
        bias_step = 0.9 * bias_step - 0.5 * error.mean()
        weight, bias = weight + step, bias + bias_step
    return weight, bias


def _score(model: str):
    def make():
        learned = json.loads(model)
        number = {t: i for i, t in enumerate(learned["terms"])}
        weight, bias = np.array(learned["weight"]), learned["bias"]

        def read(texts: list) -> pa.Array:
            odds = np.array([bias + weight[_columns(*_read(text, number))].sum() for text in texts], float)
            return pa.array(1 / (1 + np.exp(-np.clip(odds, -30, 30))), pa.float64())

        return read

    return make


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> str:
    """The model as JSON: terms, weights and bias.

    ``docs`` has doc_id and text, ``labels`` doc_id and toxic; both hold training rows only.  NULL labels and ids are
    left out; of several labels of one document the larger counts.  Without labels, or without toxic ones, the model
    has no terms, and its score is the prior share of toxic texts.
    """
    marks = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text"))
    hashed = rows.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    known = written(hashed.select("doc_id", "text_hash").join(marks, "doc_id"), "known")
    prior = known.agg(F.avg("toxic")).first()[0] or 0.0
    # one id stands for all that have a text; of several labels of one text the larger counts
    ids = known.groupBy("text_hash", "doc_id").agg(F.max("toxic").alias("toxic"), F.count("*").alias("copies"))
    single = ids.groupBy("text_hash").agg(F.max("toxic").alias("toxic"), F.min(F.struct("doc_id", "copies")).alias("first"))
    single = written(single.select("first.doc_id", "text_hash", "toxic", "first.copies"), "single")
    base = single.agg(F.avg("toxic")).first()[0] or 0.0
    # no side is bounded, so none is broadcast, and the labels are hashed to spare a sort of the texts; this is the one time
    # that texts are moved
    terms = mined_terms(hashed.join(single.hint("shuffle_hash"), ["doc_id", "text_hash"]).select("text", "toxic", "copies"), base, settings)
    ranked = docs.select(F.xxhash64("doc_id", "text").alias("rank"), "text")
    read = ranked.mapInArrow(_features(terms), "rank long, votes int, terms array<int>")
    seen = read.groupBy("votes").count().collect()  # at most 2 ** VOTERS rows
    if not seen or not terms:
        return json.dumps({"terms": [], "weight": [0.0] * VOTERS, "bias": float(np.log((prior + 1e-3) / (1.001 - prior)))})
    patterns, counts = np.array([r["votes"] for r in seen]), np.array([r["count"] for r in seen], float)
    labeller = LabelModel(patterns, counts, prior)
    # the ids of the sample are bounded by ``sample``, so their texts are found without moving any
    rank = F.xxhash64("doc_id")
    ids = known.select("doc_id").distinct().orderBy(rank, "doc_id").limit(settings.sample)
    sampled = rows.join(F.broadcast(ids), "doc_id").select(F.xxhash64("doc_id", "text").alias("rank"), "text")
    read = sampled.mapInArrow(_features(terms), "rank long, votes int, terms array<int>")
    rows = [(r["votes"], r["terms"]) for r in read.orderBy("rank").limit(settings.sample).collect()]
    target = labeller.posterior(np.array([v for v, _ in rows]))
    weight, bias = _fit_linear(rows, target, len(terms))
    return json.dumps({"terms": terms, "weight": weight.round(6).tolist(), "bias": round(bias, 6)})


def _with_score(docs: DataFrame, labels: DataFrame, name: str, folds: int, held_out: int, settings: Settings) -> DataFrame:
    training = docs.select(F.col("doc_id").cast("long"), F.col("text")).filter(crc32_fold(F.col("doc_id").cast("long"), folds) != held_out)
    return with_read(docs, ["text"], name, "double", _score(train(training, labels.select("doc_id", "toxic"), settings)))


def toxicity(docs: DataFrame, labels: DataFrame, *, folds: int = 4, held_out: int = 2, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, from its text alone.

    Rows whose crc32 of the id, modulo ``folds``, is ``held_out`` are never learned from, nor are rows without id; those
    count as held out.  NULL and empty texts get the score of a text without terms.  Equal rows get equal scores; no
    rows give none.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text"))
    return _with_score(rows, labels, "score", folds, held_out, settings).select(
        "doc_id", F.coalesce(crc32_fold(F.col("doc_id"), folds) == held_out, F.lit(True)).alias("held_out"), "score",
        (F.col("score") >= settings.threshold).cast("int").alias("predicted"),
    )


def civil_documents(docs: DataFrame, labels: DataFrame, *, folds: int = 4, held_out: int = 2, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not predicted toxic."""
    name = fresh(docs, "score")
    return _with_score(docs, labels, name, folds, held_out, settings).filter(F.col(name) < settings.threshold).drop(name)
