"""Quality by pairwise ranking: a Bradley-Terry model of document scores, learnt from preference pairs.

A labelled good document is preferred to a labelled bad one. The model gives a document the score w·f(text); the chance
that one is preferred to another is the logistic function of the difference of their scores, so it is learnt by logistic
loss on feature differences. Documents are accepted from a quantile of the scores of the labelled documents on; the
published score is shifted so that the quantile lies at ``ACCEPT``.

Features see the text alone. Learning takes at most ``SAMPLE`` labelled documents, those with the smallest hash of
their id, and ``PAIRS`` pairs; scoring reads every document, whole, in one pass and without a shuffle.

Defined results: a NULL or empty text has the features of no words; with no labels, or labels of one kind only, every
score is 0.5; a label that is neither 0 nor 1 is no label; equal scores are accepted alike; repeated rows get equal
scores; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from censora.llm.frames import slices, with_fields

# Labelled documents and pairs that learning takes at most; steps of Newton's method; ridge.
SAMPLE, PAIRS, STEPS, RIDGE = 40_000, 80_000, 25, 1e-3
# Bins of a unit of the raw score.
BINS = 1000
# The published score from which a document is accepted.
ACCEPT = 0.3

_SENTENCE = re.compile(r"[.!?]+")


def features(text: str | None) -> list[float]:
    """What is measured of a text; shares are between 0 and 1, the rest on a logarithmic scale."""
    text = text or ""
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return [0.0] * len(FEATURES)
    kinds = Counter(words)
    alike = sum(map(str.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    capitals = sum(map(str.isupper, words))
    letters = sum(map(str.isalpha, words))
    titles = sum(map(str.istitle, words))
    lines = [x for x in text.split("\n") if x.strip()]
    single = sum(len(w) == 1 for w in kinds)
    signs = sum(map(text.count, "#*$%&<>~^=_\\{}[]"))
    stops = text.count(".") + text.count("?") + text.count("!")
    shouts = text.count("!")
    return [
        np.log1p(n),
        np.log1p(chars / n),
        len(kinds) / n,
        len(kinds) / np.sqrt(n),
        alike / n,
        np.sqrt(alike / n),
        pairs / n,
        max(kinds.values()) / n,
        capitals / n,
        np.sqrt(capitals / n),
        letters / n,
        titles / n,
        single / n,
        signs / chars,
        np.sqrt(signs / chars),
        text.count("|") / chars,
        np.sqrt(text.count("|") / chars),
        shouts / chars,
        np.sqrt(shouts / chars),
        stops / n,
        np.log1p(n / (1 + stops)),
        text.count(",") / n,
        sum(map(str.isdigit, words)) / n,
        len(set(lines)) / max(1, len(lines)),
        np.log1p(n / max(1, len(lines))),
        float(n < 20),
    ]


FEATURES = (
    "words", "word_length", "kinds", "kinds_root", "alike", "alike_root", "pairs", "commonest", "capitals", "capitals_root", "letters", "titles", "single",
    "signs", "signs_root", "bars", "bars_root", "shouts", "shouts_root", "stops", "sentence_length", "commas", "numbers", "line_kinds", "line_length", "short",
)


class Ranking(NamedTuple):
    """Weights on standardised features, and the raw score of the accepting quantile."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return np.clip((rows - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Between 0 and 1, ``ACCEPT`` at the threshold."""
        if not self.weights.any():
            return np.full(len(rows), 0.5)
        above = np.clip(self.raw(rows) - self.threshold, -30, 30)
        return 1 / (1 + np.exp(-above) * (1 - ACCEPT) / ACCEPT)


def fit_differences(differences: np.ndarray) -> np.ndarray:
    """Weights by logistic loss on feature differences (preferred minus other), by Newton's method with a ridge."""
    w = np.zeros(differences.shape[1])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(np.clip(differences @ w, -30, 30)))
        gradient = differences.T @ p / len(differences) - RIDGE * w
        curvature = (differences * (p * (1 - p))[:, None]).T @ differences / len(differences) + RIDGE * np.eye(len(w))
        step = np.linalg.solve(curvature, gradient)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(rows: np.ndarray, good: np.ndarray, quantile: float | None = None) -> Ranking:
    """The model of labelled feature rows. ``quantile`` of the scores that is not accepted; by default the share of bad rows."""
    size = len(FEATURES)
    if good.all() or not good.any():
        return Ranking(np.zeros(size), np.ones(size), np.zeros(size), 0.0)
    mean, scale = rows.mean(0), np.maximum(rows.std(0), 1e-6)
    standard = np.clip((rows - mean) / scale, -8, 8)
    better, worse = np.flatnonzero(good), np.flatnonzero(~good)
    pick = np.random.default_rng(0)
    n = min(PAIRS, len(better) * len(worse))
    w = fit_differences(standard[pick.choice(better, n)] - standard[pick.choice(worse, n)])
    share = float((~good).mean()) if quantile is None else quantile
    return Ranking(mean, scale, w, float(np.quantile(standard @ w, share)))


def learnable(doc_id: Column) -> Column:
    """Rows that may be learnt from: the CRC-32 of the id as text leaves a remainder by five."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", quantile: float | None = None) -> Ranking:
    """The model of a bounded sample of the labelled documents: the ``SAMPLE`` smallest hashes of the id.

    The sample is drawn from the labels alone; its ids then pick the texts, so no text is shuffled for it. The threshold is
    the ``quantile`` of the scores of all documents, labelled or not; by default the share of bad rows in the sample.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(doc_id).alias("_id"), F.col(label).alias("_good")).where(F.col("_good").isin(0, 1) & learnable(F.col("_id")))
    sample = known.orderBy(F.xxhash64("_id"), "_id", "_good").limit(SAMPLE).collect()
    good = {r["_id"]: bool(r["_good"]) for r in sample}
    wanted = spark.sparkContext.broadcast(good)  # at most SAMPLE ids
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text"))

    def run(batches):
        for batch in slices(batches):
            ids = batch.column(0).to_pylist()
            at = [k for k, i in enumerate(ids) if i in wanted.value]
            if at:
                texts = batch.column(1).take(pa.array(at)).to_pylist()
                values = pa.array([features(t) for t in texts], pa.list_(pa.float64()))
                crc = pa.array([zlib.crc32((t or "").encode("utf-8", "replace")) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), crc, values], ["_id", "_crc", "_values"])

    # Repeated ids: the text with the smallest checksum stands for the id.
    found = rows.mapInArrow(run, with_fields(rows.select("_id").schema, "_crc long, _values array<double>")).groupBy("_id").agg(F.min_by("_values", "_crc").alias("_values"))
    got = sorted((repr(r["_id"]), good[r["_id"]], r["_values"]) for r in found.collect())
    if not got:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0, bool))
    marks = np.array([g for _, g, _ in got])
    ranking = fit(np.array([v for *_, v in got]), marks)
    # The sample only stands in until the scores of all documents are known.
    return ranking._replace(threshold=threshold(docs, ranking, float((~marks).mean()) if quantile is None else quantile, text))


def threshold(docs: DataFrame, ranking: Ranking, quantile: float, text: str = "text") -> float:
    """The raw score that ``quantile`` of all documents stay below, from a histogram that Spark counts.

    Raw scores are bounded by the weights, so the driver gets ``16 * BINS`` rows for each unit of their sum at most.
    """
    rows = docs.select(F.col(f"`{text}`").cast("string").alias("_text"))
    if not ranking.weights.any():
        return 0.0
    model = docs.sparkSession.sparkContext.broadcast(ranking)

    def run(batches):
        for batch in slices(batches):
            raw = model.value.raw(np.array([features(t) for t in batch.column(0).to_pylist()]).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([pa.array(np.floor(raw * BINS).astype(np.int64))], ["bin"])

    counted = sorted(tuple(r) for r in rows.mapInArrow(run, "bin long").groupBy("bin").agg(F.count(F.lit(1)).alias("n")).collect())
    if not counted:
        return 0.0
    upto = np.cumsum([n for _, n in counted])
    return counted[min(int(np.searchsorted(upto, quantile * upto[-1], "right")), len(counted) - 1)][0] / BINS


def scored(docs: DataFrame, ranking: Ranking, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``predicted``."""
    docs = docs.drop("score", "predicted")
    names, place = docs.columns, docs.columns.index(text)
    rows = docs.withColumn(text, F.col(f"`{text}`").cast("string"))
    model = docs.sparkSession.sparkContext.broadcast(ranking)

    def run(batches):
        for batch in slices(batches):
            measured = np.array([features(t) for t in batch.column(place).to_pylist()]).reshape(-1, len(FEATURES))
            score = model.value.score(measured)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= ACCEPT).astype(np.int32))], [*names, "score", "predicted"])

    return rows.mapInArrow(run, with_fields(rows.schema, "score double, predicted int"))
