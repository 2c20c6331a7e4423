"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text features.

P(grade <= k) = sigmoid(threshold_k - w.x): one weight vector for all grades and ordered thresholds. Features are the
distinct words (A-Z lower-cased), their stems and the distinct runs of punctuation of the whole text, hashed to BUCKETS, with its shape. The model is
fitted on a bounded sample of labelled documents (MAX_LABELLED, the smallest hashes of doc_id) on the driver; scoring reads
every document once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as V
from .decontamination import FOLD, SEPARATORS
from .scratch import discard, materialize

BUCKETS, MAX_LABELLED, GRADES = 1 << 18, 8000, 3
#: The most (document, feature) pairs that the driver holds: documents are taken in order until their features reach it.
MAX_FEATURES = 1 << 25
#: Buckets below this number are for the shape of the text.
SHAPES = 96
#: The least probability of the best grade for selection: below a half, as losing a good document costs more than a fair one.
#: All grades share one score, so a cut on another tail is a cut on this.
SELECT = 0.4
#: How many first bytes of a word are features of their own, so that a stem counts whatever its ending.
STEMS = (6, 7)
#: Steps, step size and ridge of the fit; a feature needs so many labelled documents and such a share of them to get a weight.
STEPS, RATE, RIDGE, LEAST_DOCS, LEAST_SHARE = 200, 0.05, 1e-3, 3, 0.002
_MARKS = ~SEPARATORS
_MARKS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) pairs, sorted: words, their first bytes, punctuation, and the shape of the text.

    The shape is three buckets: the length in powers of two, the share of distinct words and the words' mean bytes.
    """
    pairs, total, letters, distinct = [], *np.zeros((3, len(texts)), np.int64)
    for separators in (SEPARATORS, _MARKS):
        for part in V.slices(texts, separators):
            text = part.first + part.text
            bucket = lambda h: text * np.int64(BUCKETS) + (h % np.uint64(BUCKETS - SHAPES)).astype(np.int64) + SHAPES  # noqa: B023, E731
            pairs.append(np.unique(bucket(part.hashes(FOLD))))
            if separators is SEPARATORS:
                distinct += np.bincount(pairs[-1] // BUCKETS, minlength=len(texts))
                pairs += [np.unique(bucket(part.hashes(FOLD, n) + np.uint64(n))) for n in STEMS]
                total += np.bincount(text, minlength=len(texts))
                letters += np.bincount(text, part.ends - part.starts, len(texts)).astype(np.int64)
    row = np.arange(len(texts), dtype=np.int64) * BUCKETS
    length = np.log2(total + 1).astype(np.int64)
    share = np.minimum(distinct * 20 // np.maximum(total, 1), 31)
    mean = np.minimum(letters * 2 // np.maximum(total, 1), 31)
    pairs = np.sort(np.concatenate([*pairs, row + np.minimum(length, 31), row + 32 + share, row + 64 + mean]))
    return pairs // BUCKETS, pairs % BUCKETS


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """Weights by bucket and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights.astype(np.float32), thresholds

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k, a row a document."""
        return 1 - _sigmoid(self.thresholds[None, :] - score[:, None])


def fit(row: np.ndarray, bucket: np.ndarray, grade: np.ndarray, grades: int = GRADES) -> Model:
    """Full-batch Adam on the mean negative log likelihood with a ridge; row and bucket are the pairs of features()."""
    n = len(grade)
    common = np.bincount(bucket, minlength=BUCKETS) >= max(min(LEAST_DOCS, n), n * LEAST_SHARE)
    row, bucket = row[common[bucket]], bucket[common[bucket]]
    used, column = np.unique(bucket, return_inverse=True)
    share = np.array([(grade <= k).mean() for k in range(grades - 1)]).clip(0.01, 0.99)
    start = np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(start), 0.05))
    parts = np.concatenate((np.zeros(len(used)), start[:1], gaps))
    first, second = np.zeros_like(parts), np.zeros_like(parts)
    upper, lower = np.minimum(grade, grades - 2), np.maximum(grade - 1, 0)
    for step in range(1, STEPS + 1):
        w, thresholds = parts[: len(used)], np.concatenate((parts[len(used) : len(used) + 1], parts[len(used)] + np.cumsum(np.exp(parts[len(used) + 1 :]))))
        score = np.bincount(row, w[column], n)
        high = np.where(grade < grades - 1, _sigmoid(thresholds[upper] - score), 1)
        low = np.where(grade > 0, _sigmoid(thresholds[lower] - score), 0)
        chance = np.maximum(high - low, 1e-9)
        d_high, d_low = high * (1 - high) / chance, low * (1 - low) / chance
        by_score = (d_high - d_low) / n
        by_threshold = -np.bincount(upper, d_high * (grade < grades - 1), grades - 1) / n + np.bincount(lower, d_low * (grade > 0), grades - 1) / n
        tail = np.cumsum(by_threshold[::-1])[::-1]
        gradient = np.concatenate((np.bincount(column, by_score[row], len(used)) + RIDGE * w, tail[:1], tail[1:] * np.exp(parts[len(used) + 1 :])))
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        parts -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros(BUCKETS)
    weights[used] = parts[: len(used)]
    return Model(weights, np.concatenate((parts[len(used) : len(used) + 1], parts[len(used)] + np.cumsum(np.exp(parts[len(used) + 1 :])))))


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 toxic, 1 not toxic but of low quality, 2 good; the lowest of repeated ratings; nulls are left out."""
    rated = labels.where("doc_id is not null and quality is not null and toxic is not null")
    grade = F.when(F.col("toxic") > 0, 0).when(F.col("quality") <= 0, 1).otherwise(2)
    return rated.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(grade).alias("grade"))


def _pairs(batches):
    for batch in batches:
        row, bucket = features(batch.column(2))
        cut = np.searchsorted(row, np.arange(batch.num_rows + 1))
        packed = [bucket[a:b].astype("<i4").tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(cut).astype(np.int64)), pa.array(packed, pa.binary())], names=["doc_id", "grade", "n", "buckets"])


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, most_features: int = MAX_FEATURES) -> Model | None:
    """The model from at most so many labelled documents, with so many features; None if no label meets a document.

    Both bounds take documents in the order of a hash of doc_id. Of rows with one doc_id the least text counts.
    """
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = graded(labels).orderBy(*order).limit(most)
    rated = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(sample, "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text"))
    pairs = materialize(rated.mapInArrow(_pairs, "doc_id long, grade int, n long, buckets binary"), "pairs")
    upto = F.sum("n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    within = pairs.select("doc_id", upto.alias("upto")).where(F.col("upto") <= most_features).select("doc_id")
    rows = pairs.join(within, "doc_id").orderBy(*order).select("grade", "buckets").collect()
    discard(pairs)
    if not rows:
        return None
    lists = [np.frombuffer(r["buckets"], "<i4") for r in rows]
    return fit(np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate(lists).astype(np.int64), np.array([r["grade"] for r in rows]))


def _score(model):
    def run(batches):
        known = model.value
        for batch in batches:
            row, bucket = features(batch.column(1))
            tails = known.tails(np.bincount(row, known.weights[bucket], batch.num_rows))
            expected, good, fair = tails.sum(1), tails[:, -1], tails[:, 0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(expected), pa.array(fair), pa.array(good), pa.array(good >= SELECT)], names=["doc_id", "expected_grade", "p_not_toxic", "p_good", "selected"])

    return run


def classify(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """doc_id, expected_grade (0 to 2), p_not_toxic, p_good and selected (p_good at least SELECT) for every row of docs.

    Null text has no features and gets the grades' base rate; texts may be of any length, and equal texts score alike.
    Without usable labels the scores are null and every row is selected. Repeated rows come out repeated; other columns are not read; an empty table gives no rows.
    """
    model = train(docs, labels, most)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    if model is None:
        none = F.lit(None).cast("double")
        return texts.select("doc_id", none.alias("expected_grade"), none.alias("p_not_toxic"), none.alias("p_good"), F.lit(True).alias("selected"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return texts.mapInArrow(_score(sent), "doc_id long, expected_grade double, p_not_toxic double, p_good double, selected boolean")
