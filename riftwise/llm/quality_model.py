"""Ordinal quality classifier: cumulative-link regression over hashed text.

Graded ratings y in 0..K-1 follow P(y <= k) = sigmoid(theta_k - s), with ordered thresholds theta and one
score s = w . x shared by all of them. x holds a hashed entry for each distinct word and one for its last
three bytes, valued log(1 + count) times a power of its rarity among the fitted documents, so that the
few words of a toxic passage count beside the many common ones, and is scaled to length one. The model
yields the expected grade and the tail probabilities P(y >= k). Both tails rise with s, so documents are
selected by s: the highest cutoff that keeps nearly all sound documents of a fold held out from fitting.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_key

BINS = 1 << 18
#: Bins found in fewer documents of the sample than this get no weight.
MIN_DOCS = 4
#: A document stays if P(y >= 1) and P(y >= 2) reach these and its score the fitted cutoff.
LEAST_TAILS = (0.5, 0.3)
#: One rated row of so many is held out from fitting, and this share of its sound ones may be rejected.
FOLDS, LOSS = 4, 0.01
#: Powers of rarity, of which the one is taken that rejects most of the poor and toxic rows held out.
POWERS = (0, 2)
#: The model is fitted on at most this many labelled rows, chosen by a hash of their doc_id.
SAMPLE = 6000
GRADES = 3


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray
    #: Power of each bin's rarity, zero for bins without weight.
    rarity: np.ndarray | None = None
    #: The least score that is accepted.
    least: float = -np.inf

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(y >= k) for k = 1..K-1, a column each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - scores[:, None], -40, 40)))


def _bins(word: bytes) -> tuple[int, int]:
    return crc32(word) % BINS, crc32(word[-3:], 7) % BINS


def features(text: bytes | None, known: dict[bytes, tuple[int, int]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(bins, values) of a text, bins sorted and distinct; none for a text without words. known keeps bins of words."""
    counts = Counter((text or b"").lower().split())
    if not counts:
        return np.zeros(0, np.int32), np.zeros(0)
    known = {} if known is None else known
    for w in counts:  # a difference of key views would walk through all of known for each text
        if w not in known:
            known[w] = _bins(w)
    at = np.array([known[w] for w in counts], dtype=np.int64).ravel()
    value = np.repeat(np.log1p(np.fromiter(counts.values(), float, len(counts))), 2)
    bins, where = np.unique(at, return_inverse=True)
    return bins.astype(np.int32), np.bincount(where, value)


def weighted(bins: np.ndarray, values: np.ndarray, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries of bins with weight, times their rarity and scaled to length one."""
    values = values * rarity[bins]
    there = values > 0
    return bins[there], values[there] / max(np.sqrt((values ** 2).sum()), 1e-12)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, rounds: int = 150,
        rate: float = 0.15, decay: float = 2e-5) -> OrdinalModel:
    """Minimise the mean negative log-likelihood plus decay * |w|^2 by Adam from a fixed start."""
    k, n = GRADES, len(rows)
    if not n:
        return OrdinalModel(np.zeros(BINS), np.linspace(-30, -20, k - 1))
    sizes = [len(b) for b, _ in rows]
    bins, vals = np.concatenate([b for b, _ in rows]), np.concatenate([v for _, v in rows])
    row = np.repeat(np.arange(n), sizes)
    share = np.clip([(grades <= g).mean() for g in range(k - 1)], 0.02, 0.98)
    start = np.maximum.accumulate(np.log(share / (1 - share)))
    steps = np.log(np.maximum(np.diff(start), 0.1))
    p = np.concatenate((np.zeros(BINS), start[:1], steps))
    m, v = np.zeros_like(p), np.zeros_like(p)
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for t in range(1, rounds + 1):
        theta = p[BINS] + np.concatenate(([0], np.cumsum(np.exp(p[BINS + 1:]))))
        s = np.bincount(row, vals * p[bins], minlength=n)
        upper = np.concatenate((sig(theta[None, :] - s[:, None]), np.ones((n, 1))), axis=1)[np.arange(n), grades]
        lower = np.concatenate((np.zeros((n, 1)), sig(theta[None, :] - s[:, None])), axis=1)[np.arange(n), grades]
        like = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper) / like, lower * (1 - lower) / like
        g_theta = np.array([dl[grades == j + 1].sum() - du[grades == j].sum() for j in range(k - 1)]) / n
        g = np.concatenate((np.bincount(bins, vals * (du - dl)[row], minlength=BINS) / n + 2 * decay * p[:BINS],
                            [g_theta.sum()], [g_theta[j + 1:].sum() * np.exp(p[BINS + 1 + j]) for j in range(k - 2)]))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return OrdinalModel(p[:BINS], p[BINS] + np.concatenate(([0], np.cumsum(np.exp(p[BINS + 1:])))))


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 for poor, 1 for sound but toxic, 2 for sound. Rows without a rating are left out."""
    grade = F.when(F.col("quality") == 0, 0).when(F.coalesce("toxic", F.lit(0)) == 1, 1).otherwise(2)
    return labels.where("doc_id is not null and quality is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade"))


def train(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE) -> OrdinalModel:
    """Fit on at most ``sample`` rated documents; ratings (doc_id, grade) of other rows are unused.

    The rated rows taken are those with the smallest hash of doc_id, so reruns and other row orders
    give the same model. Only their features come to the driver, at most BINS entries each.
    """
    chosen = ratings.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(sample)

    def run(batches):
        for b in batches:
            got = [features(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("grade"), pa.array([x for x, _ in got], pa.list_(pa.int32())),
                 pa.array([y for _, y in got], pa.list_(pa.float64()))], ["doc_id", "grade", "bins", "vals"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    # At most `sample` rows are broadcast.
    rows = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "grade", "text")
    got = rows.mapInArrow(run, "doc_id long, grade int, bins array<int>, vals array<double>").toArrow()
    got = got.take(pc.sort_indices(
        got.append_column("n", pc.list_value_length(got["bins"])),
        [("doc_id", "ascending"), ("grade", "ascending"), ("n", "ascending")]))
    pairs = [(x.values.to_numpy(), y.values.to_numpy()) for x, y in zip(got["bins"], got["vals"])]
    grades = got["grade"].to_numpy().astype(int)
    held = np.array([crc32(b"%d" % d) % FOLDS == 0 for d in got["doc_id"].to_pylist()], dtype=bool)
    fitted = [pairs[i] for i in np.flatnonzero(~held)]
    found = np.bincount(np.concatenate([b for b, _ in fitted] + [np.zeros(0, np.int32)]), minlength=BINS)
    rare = np.log((len(fitted) + 1) / (found + 1))
    best = None
    for power in POWERS:
        rarity = np.where(found >= MIN_DOCS, rare ** power, 0)
        model = fit([weighted(b, v, rarity) for b, v in fitted], grades[~held])
        model.weights, model.rarity = model.weights.astype(np.float32), rarity
        tried = np.array([score(*pairs[i], model) for i in np.flatnonzero(held)])
        sound = np.sort(tried[grades[held] == GRADES - 1])
        if len(sound):
            model.least = float(sound[int(LOSS * len(sound))])
        gone = (~accepted(tried[grades[held] < GRADES - 1], model)).sum()
        if best is None or gone > best[0]:
            best = gone, model
    del got, pairs, fitted
    pa.default_memory_pool().release_unused()  # the driver goes on, and its memory is what a pipeline's later stages need
    return best[1]


def score(bins: np.ndarray, values: np.ndarray, model: OrdinalModel) -> float:
    bins, values = weighted(bins, values, model.rarity)
    return float((model.weights[bins] * values).sum())


def accepted(found: np.ndarray, model: OrdinalModel) -> np.ndarray:
    return (found >= model.least) & (model.tails(found) >= LEAST_TAILS).all(axis=1)


def scores(texts, model: OrdinalModel, known: dict[bytes, tuple[int, int]]) -> np.ndarray:
    """Score of each text; known keeps the bins of words already met."""
    out = []
    for text in texts:
        out.append(score(*features(text, known), model))
        if len(known) > 200_000:
            known.clear()
    return np.array(out)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text_key, expected_grade, tail_1, tail_2, kept) per row of docs (doc_id, text).

    Null, empty and blank texts have score zero. Without ratings every document is kept. Of several
    ratings of a document each counts. Rows that repeat a doc_id are scored one by one.
    """
    model = train(docs, graded(labels), sample)

    def run(batches):
        known: dict[bytes, tuple[int, int]] = {}
        for b in batches:
            found = scores(b.column("text").to_pylist(), model, known)
            tails = model.tails(found)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("key"), pa.array(tails.sum(axis=1)), pa.array(tails[:, 0]),
                 pa.array(tails[:, 1]), pa.array(accepted(found, model))],
                ["doc_id", "text_key", "expected_grade", "tail_1", "tail_2", "kept"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"),
                       F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(
        run, "doc_id long, text_key long, expected_grade double, tail_1 double, tail_2 double, kept boolean")


def keep_accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that the classifier accepts, all columns unchanged, without a shuffle of texts."""
    model = train(docs, graded(labels), sample)
    at = docs.columns.index("text")

    def run(batches):
        known: dict[bytes, tuple[int, int]] = {}
        for b in batches:
            texts = b.column(at).cast(pa.binary()).to_pylist()
            yield b.filter(pa.array(accepted(scores(texts, model, known), model)))

    return docs.mapInArrow(run, docs.schema)
