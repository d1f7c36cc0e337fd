"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

P(grade <= j) = sigmoid(threshold_j - w . x): one weight vector for all ordered
thresholds. Features are the distinct words and word pairs of the whole text,
hashed; each counts once, however often it occurs, so that long texts do not
add up. The fit maximises the likelihood with an L1 penalty by proximal steps
(most words carry nothing); the result is the expected grade and the
probability of each.

The labels know only toxic or not. ``severity_grades`` makes three grades: 0
clean, 1 and 2 toxic with a share of marker words up to or above the median of
the toxic texts; markers are the words by far more frequent in toxic texts of
the sample. Other graded labels may be given instead.

The fit uses a bounded sample of labelled texts (``SAMPLE_ROWS``); every text is
scored whole. Null and empty texts have no features: their grade is the one of
the thresholds alone. Labels that are null are left out, of repeated labels the
highest counts. Without texts of at least two grades the score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leakatlas.llm.shared import bounded_sample
from leakatlas.llm.text import FIELD, Fingerprints, byte_values, chunks, mix, utf8, words

SAMPLE_ROWS = 6_000
BITS = 18
PENALTY = 6e-4
STEPS = 250
LEAST_TEXTS = 4
CUT = 0.2  # expected grade from which a text counts as toxic: on held-out labels 93 % of toxic texts, 0.3 % of others


@dataclass
class Model:
    weights: np.ndarray  # float32, 2 ** BITS
    thresholds: np.ndarray  # ascending; one less than there are grades


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text numbers and feature numbers, each distinct pair once."""
    start, end, doc = words(data, at)
    # Punctuation at the edges of a word doesn't belong to it.
    soft = np.zeros(256, bool)
    soft[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
    for _ in range(3):
        trim = (end - start > 1) & soft[data[np.maximum(end - 1, 0)]] if len(end) else np.zeros(0, bool)
        end = end - trim
        trim = (end - start > 1) & soft[data[start]] if len(end) else trim
        start = start + trim
    h = Fingerprints(data, byte_values(11, fold_case=True)).span(start, end)
    with np.errstate(over="ignore"):
        pair = doc[:-1] == doc[1:]
        both = mix(h[:-1] * FIELD(3) + mix(h[1:]))[pair]
        key = np.concatenate([h, both]) >> FIELD(64 - BITS)
        of = np.concatenate([doc, doc[:-1][pair]])
    distinct = np.unique((of.astype(FIELD) << FIELD(BITS)) | key)
    return (distinct >> FIELD(BITS)).astype(np.int64), (distinct & FIELD((1 << BITS) - 1)).astype(np.int64)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(rows: np.ndarray, columns: np.ndarray, grades: np.ndarray, n_grades: int) -> Model:
    """Accelerated proximal gradient on the mean negative log likelihood."""
    n = len(grades)
    used, place, times = np.unique(columns, return_inverse=True, return_counts=True)
    frequent = times >= LEAST_TEXTS
    keep = frequent[place]
    rows, place, used = rows[keep], (np.cumsum(frequent) - 1)[place[keep]], used[frequent]
    share = np.clip(np.array([(grades <= j).mean() for j in range(n_grades - 1)]), 1e-4, 1 - 1e-4)
    cuts = np.log(share / (1 - share))
    w = np.zeros(len(used))
    looked_w, looked_c, momentum = w, cuts, 1.0
    # A bound of the curvature: the logistic's is 1/4 at most, rows have so many features.
    size = np.bincount(rows, minlength=n)
    step = 1 / (0.25 * max(1.0, float(np.percentile(size, 90))))
    scale = 1 / np.sqrt(np.bincount(place, minlength=len(used)) / n + 1 / n)  # rarer features may move faster
    scale = scale / scale.max() * np.sqrt(n) if len(used) else scale
    step_w = step * np.minimum(scale, 30.0)
    index = np.arange(n)
    for _ in range(STEPS):
        score = np.bincount(rows, looked_w[place], minlength=n)
        low = np.concatenate([[-np.inf], looked_c])[grades]
        high = np.concatenate([looked_c, [np.inf]])[grades]
        p_low, p_high = sigmoid(low - score), sigmoid(high - score)
        p = np.maximum(p_high - p_low, 1e-9)
        d_low, d_high = p_low * (1 - p_low) / p, p_high * (1 - p_high) / p
        slope = (d_high - d_low) / n  # of the loss by the score
        g_w = np.bincount(place, slope[rows], minlength=len(used))
        g_c = np.zeros(n_grades + 1)
        np.add.at(g_c, grades[index], d_low / n)
        np.add.at(g_c, grades[index] + 1, -d_high / n)
        new_w = looked_w - step_w * g_w
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - step_w * PENALTY, 0)
        new_c = np.maximum.accumulate(looked_c - g_c[1:-1])
        later = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        looked_w = new_w + (momentum - 1) / later * (new_w - w)
        looked_c = np.maximum.accumulate(new_c + (momentum - 1) / later * (new_c - cuts))
        w, cuts, momentum = new_w, new_c, later
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = w
    return Model(weights, cuts)


def severity_grades(rows: np.ndarray, columns: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Grades 0, 1, 2 from the labels and the share of marker words."""
    n, hot = len(toxic), toxic[rows] > 0
    inside = np.bincount(columns[hot], minlength=1 << BITS)
    outside = np.bincount(columns[~hot], minlength=1 << BITS)
    n_hot = max(1, int((toxic > 0).sum()))
    odds = (inside + 0.5) / (n_hot + 1) / ((outside + 0.5) / (max(1, n - n_hot) + 1))
    marker = (inside >= LEAST_TEXTS) & (odds >= 8)
    share = np.bincount(rows, marker[columns], minlength=n) / np.maximum(1, np.bincount(rows, minlength=n))
    middle = np.median(share[toxic > 0]) if (toxic > 0).any() else 0
    return np.where(toxic > 0, 1 + (share > middle), 0)


def train(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", graded: bool = False, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Fit on about ``sample_rows`` labelled texts; with ``graded`` the labels are grades from 0 on."""
    truth = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.max(F.col(label).cast("int")).alias("grade"))
    picked = F.broadcast(bounded_sample(truth, F.col("__key"), sample_rows))
    texts = documents.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text")).join(picked, "__key")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "__text"):
                rows, columns = features(*utf8(batch.column("__text")))
                cut = np.searchsorted(rows, np.arange(batch.num_rows + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cut), pa.array(columns, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("__key").cast(pa.string()), batch.column("grade"), lists], names=["key", "grade", "features"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), pa.schema([("key", pa.string()), ("grade", pa.int32()), ("features", pa.list_(pa.int32()))])).combine_chunks().sort_by("key")
        lists = table.column("features").combine_chunks()
        grades = table.column("grade").to_numpy().astype(np.int64)
        rows = np.repeat(np.arange(len(grades)), lists.value_lengths().to_numpy(zero_copy_only=False)) if len(grades) else np.zeros(0, np.int64)
        columns = lists.flatten().to_numpy().astype(np.int64)
        if not graded and len(grades):
            grades = severity_grades(rows, columns, grades)
        if len(np.unique(grades)) < 2:
            return
        grades = np.unique(grades, return_inverse=True)[1]
        model = fit(rows, columns, grades, int(grades.max()) + 1)
        at = np.flatnonzero(model.weights)
        yield pa.RecordBatch.from_arrays([pa.array([at.tolist()], pa.list_(pa.int32())), pa.array([model.weights[at].tolist()], pa.list_(pa.float32())), pa.array([model.thresholds.tolist()], pa.list_(pa.float64()))], names=["at", "weights", "thresholds"])

    # The sample is bounded, so one task may hold its features.
    sampled = texts.mapInArrow(sparse, "key string, grade int, features array<int>")
    row = sampled.repartition(1).mapInArrow(solve, "at array<int>, weights array<float>, thresholds array<double>").collect()
    if not row:
        return None
    weights = np.zeros(1 << BITS, np.float32)
    weights[row[0]["at"]] = row[0]["weights"]
    return Model(weights, np.array(row[0]["thresholds"]))


def score(documents: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, severity (expected grade), grade_probabilities, toxic, of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "__text"):
                n = batch.num_rows
                if model is None:
                    chances = np.ones((n, 1))
                else:
                    rows, columns = features(*utf8(batch.column("__text")))
                    x = np.bincount(rows, model.weights[columns], minlength=n)
                    below = np.concatenate([np.zeros((n, 1)), sigmoid(model.thresholds[None, :] - x[:, None]), np.ones((n, 1))], axis=1)
                    chances = np.diff(below, axis=1)
                severity = chances @ np.arange(chances.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("__key"), pa.array(severity), pa.array(chances.tolist(), pa.list_(pa.float64())), pa.array(severity >= CUT)], names=["key", "severity", "grade_probabilities", "toxic"]
                )

    source = documents.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text"))
    kind = source.schema["__key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, severity double, grade_probabilities array<double>, toxic boolean").withColumnRenamed("key", key)
