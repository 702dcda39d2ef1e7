"""Quality of texts from weak labels.

Heuristic labellers vote good, bad or abstain on every text. Their accuracies
are unknown and their coverage overlaps: expectation-maximisation estimates
for each labeller how often it votes what on good and on bad texts, and the
share of good texts. The votes of all rows enter as counts of their patterns,
at most three to the number of labellers. The posterior of a pattern is a
soft label, and the labels train a linear scorer over hashed words, which then
scores every whole text.

The scorer is fitted on a bounded sample: at most ``TRAIN_ROWS`` distinct
texts, those with the smallest hashes. Votes, pattern counts and scores cover
all rows.

Edge cases: a null or empty text has no words and score 0; repeated rows are
each scored; an empty table gives an empty result. Where all labellers agree
on one class for all rows, the prior alone decides. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import settle
from ..session import cut_lineage
from .batches import small_batches
from .rules import STOP_WORDS, WORD
from .sampling import least_hashes
from .words import BLANK_WORDS, Words, text_slices

TRAIN_ROWS = 6000
FEATURES = 1 << 14
EM_ROUNDS = 100
EPOCHS = 30
ABSTAIN, BAD, GOOD = 0, 1, 2

# Labeller, measure, bad from, good up to (both on "more is worse").
LABELLERS = (
    ("symbols", "symbol_share", 0.02, 0.002),
    ("capitals", "capital_share", 0.30, 0.12),
    ("function_words", "no_stop_share", 0.92, 0.80),
    ("repeated_lines", "dup_line_share", 0.25, 0.02),
    ("repeated_words", "repeat_share", 0.75, 0.60),
    ("digits", "digit_share", 0.15, 0.03),
    ("length", "shortness", 0.05, 0.02),
    ("shouting", "mark_share", 0.05, 0.012),
)


def measures(rows: DataFrame) -> DataFrame:
    """Rows with ``text`` and the measures of ``LABELLERS``, each larger for worse texts."""
    rows = settle(
        rows,
        words=F.regexp_extract_all("text", F.lit(WORD), F.lit(0)),
        lines=F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD)),
    )
    n = F.greatest(F.size("words"), F.lit(1))
    chars = F.greatest(F.length("text"), F.lit(1))
    share = lambda pattern: F.regexp_count("text", F.lit(pattern)) / chars
    n_lines = F.size("lines")
    return rows.select(
        *[c for c in rows.columns if c not in ("words", "lines")],
        share(r"[#*$%&|<>{}\[\]^~_=\\]").alias("symbol_share"),
        share(r"\p{Lu}").alias("capital_share"),
        (1 - F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))) / n).alias("no_stop_share"),
        ((n_lines - F.size(F.array_distinct("lines"))) / F.greatest(n_lines, F.lit(1))).alias("dup_line_share"),
        # distinct words fall with length in any text; the square root takes that out
        F.when(n > 20, 1 - F.size(F.array_distinct("words")) / n * F.least(F.sqrt(n / 400), F.lit(1.0))).alias("repeat_share"),
        share(r"[0-9]").alias("digit_share"),
        (1 / n).alias("shortness"),
        share(r"[!?]").alias("mark_share"),
    )


def vote(measure: str, bad: float, good: float) -> Column:
    value = F.col(measure)
    return F.when(value >= bad, BAD).when(value <= good, GOOD).otherwise(ABSTAIN)


def votes(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``h, votes``: the hash of each text and one digit per labeller."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    measured = measures(docs.select(text.alias("text"), F.xxhash64(text, F.lit(5)).alias("h")))
    return measured.select("h", F.concat(*[vote(m, b, g).cast("string") for _, m, b, g in LABELLERS]).alias("votes"))


@dataclass
class LabelModel:
    """The share of good texts and ``rates[class, labeller, vote]``."""

    good: float
    rates: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        logs = np.log(self.rates[:, np.arange(patterns.shape[1]), patterns]).sum(axis=-1)
        odds = logs[1] - logs[0] + np.log(self.good) - np.log(1 - self.good)
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def estimate(patterns: np.ndarray, counts: np.ndarray) -> LabelModel:
    """Expectation-maximisation from the majority of votes; the classes keep their names
    because no labeller is taken to be wrong more often than right."""
    up, down = (patterns == GOOD).sum(axis=1), (patterns == BAD).sum(axis=1)
    # a single bad sign outweighs several unremarkable measures
    soft = np.where(down > 0, 0.5 ** (1 + down), 0.9)
    soft = np.where((up == 0) & (down == 0), 0.5, soft)
    model = None
    for _ in range(EM_ROUNDS):
        rates = np.empty((2, patterns.shape[1], 3))
        for c, weight in enumerate(((1 - soft) * counts, soft * counts)):
            for v in range(3):
                rates[c, :, v] = (weight[:, None] * (patterns == v)).sum(axis=0) + 1
            rates[c] /= rates[c].sum(axis=-1, keepdims=True)
        wrong = rates[1, :, BAD] > rates[0, :, BAD]
        rates[:, wrong] = rates[:, wrong].mean(axis=0)
        good = float(np.clip((soft * counts).sum() / counts.sum(), 0.01, 0.99))
        model = LabelModel(good, rates)
        new = model.posterior(patterns)
        if np.abs(new - soft).max() < 1e-6:
            break
        soft = new
    return model


def _row_features(words: Words) -> np.ndarray:
    return (words.codes() >> np.uint64(50)).astype(np.int64)


def _hashed(batches):
    """``h`` and the hashed words of each text, with how often."""
    for part in text_slices(batches):
        words = Words(part.column("text"), BLANK_WORDS)
        place = _row_features(words)
        rows = [np.unique(place[words.first[i] : words.first[i + 1]], return_counts=True) for i in range(part.num_rows)]
        yield pa.RecordBatch.from_arrays(
            [
                part.column("h"),
                pa.array([p.astype(np.int32).tobytes() for p, _ in rows], pa.binary()),
                pa.array([(c / c.sum()).astype(np.float32).tobytes() if len(c) else b"" for _, c in rows], pa.binary()),
            ],
            ["h", "places", "shares"],
        )


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, seed: int = 5) -> np.ndarray:
    """Weights and bias of a logistic model of word shares, by adaptive gradient steps."""
    w = np.zeros(FEATURES + 1)
    seen = np.full(FEATURES + 1, 1e-6)
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            places, shares = rows[i]
            score = 1 / (1 + np.exp(-np.clip(w[places] @ shares + w[-1], -50, 50)))
            error = score - target[i]
            step = error * shares
            seen[places] += step * step
            w[places] -= 0.5 * step / np.sqrt(seen[places])
            seen[-1] += error * error
            w[-1] -= 0.1 * error / np.sqrt(seen[-1])
    return w


@dataclass
class Scorer:
    labels: LabelModel | None
    weights: np.ndarray | None


def fit(docs: DataFrame, text_col: str = "text", train_rows: int = TRAIN_ROWS) -> Scorer:
    """Label model over all rows and the scorer from its posteriors."""
    docs = small_batches(docs)
    voted = cut_lineage(votes(docs, text_col), "votes")
    grouped = voted.groupBy("votes").count().collect()  # at most 3 ** labellers rows
    if not grouped:
        return Scorer(None, None)
    grouped.sort(key=lambda r: r["votes"])
    patterns = np.array([[int(c) for c in r["votes"]] for r in grouped])
    model = estimate(patterns, np.array([r["count"] for r in grouped], float))
    last = least_hashes(voted, "h", train_rows)[-1]
    label = {r["h"]: r["votes"] for r in voted.filter(F.col("h") <= last).distinct().collect()}
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(text.alias("text"), F.xxhash64(text, F.lit(5)).alias("h")).filter(F.col("h") <= last)
    found = keyed.mapInArrow(_hashed, "h long, places binary, shares binary").dropDuplicates(["h"]).collect()
    found.sort(key=lambda r: r["h"])
    rows = [(np.frombuffer(r["places"], np.int32), np.frombuffer(r["shares"], np.float32)) for r in found]
    target = model.posterior(np.array([[int(c) for c in label[r["h"]]] for r in found]))
    return Scorer(model, fit_scorer(rows, target).astype(np.float64))


def score(docs: DataFrame, model: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, kept`` of every row; kept from a score of one half."""
    shared = small_batches(docs).sparkSession.sparkContext.broadcast(model.weights)

    def run(batches):
        weights = shared.value
        for part in text_slices(batches):
            words = Words(part.column("text"), BLANK_WORDS)
            n = np.diff(words.first)
            out = np.zeros(part.num_rows)
            if weights is not None and len(words):
                total = np.concatenate([[0.0], np.cumsum(weights[_row_features(words)])])
                mean = np.diff(total[words.first]) / np.maximum(n, 1)
                out = np.where(n > 0, 1 / (1 + np.exp(-np.clip(mean + weights[-1], -50, 50))), 0.0)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out)], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double").withColumn("kept", F.col("score") >= 0.5)
