"""Toxicity by non-negative positive-unlabelled learning.

A text is the set of its words and of their first 4 to 8 bytes.  A linear classifier is trained
from confirmed toxic texts and unlabelled texts with the non-negative risk estimator: with class prior
p and logistic loss, p * E_P[loss(+)] + max(0, E_U[loss(-)] - p * E_P[loss(-)]).  The prior is the share
of toxic rows among all labelled rows that may be learned from, less its standard error.

Training takes at most ``positives`` toxic and ``unlabelled`` other texts, those of smallest hash of
doc_id, and keeps at most ``features`` features; these bounds do not grow with the table.  Scoring
looks every word of every text up in the kept features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded, cut, keep_rows
from .wordhash import PUNCTUATED, batches_of_text, text_bytes, word_hashes, word_spans

PREFIXES = (4, 5, 6, 7, 8)
_TABLE_BITS = 20


def text_features(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """Feature hashes of each word (the word, then its prefixes) and n+1 word offsets of the rows."""
    raw, offsets = text_bytes(column)
    starts, ends, at = word_spans(raw, offsets, PUNCTUATED)
    words = word_hashes(raw, starts, ends)
    kinds = [words]
    for n in PREFIXES:
        long = ends - starts > n
        cut = words.copy()
        cut[long] = word_hashes(raw, starts[long], starts[long] + n)
        kinds.append(cut + np.uint64(0x9E3779B97F4A7C15 * n % (1 << 64)))
    return kinds, at


def _distinct(kinds: list[np.ndarray], at: np.ndarray, row: int) -> np.ndarray:
    return np.unique(np.concatenate([k[at[row] : at[row + 1]] for k in kinds]))


class ToxicityModel:
    """Kept features with their weights, and a bias."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, bias: float) -> None:
        order = np.argsort(features)
        self.features, self.weights, self.bias = features[order], weights[order], bias
        self.known = np.zeros(1 << _TABLE_BITS, bool)
        self.known[(self.features >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True

    def scores(self, column: pa.Array) -> np.ndarray:
        total = np.full(len(column), self.bias)
        kinds, at = text_features(column) if len(self.features) else ([], None)
        owner, found = [], []
        for hashes in kinds:
            maybe = np.flatnonzero(self.known[(hashes >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
            if len(maybe):
                place = np.minimum(np.searchsorted(self.features, hashes[maybe]), len(self.features) - 1)
                hit = self.features[place] == hashes[maybe]
                owner.append(np.searchsorted(at, maybe[hit], side="right") - 1)
                found.append(place[hit])
        if owner:
            pairs = np.unique(np.concatenate(owner).astype(np.int64) * len(self.features) + np.concatenate(found))
            np.add.at(total, pairs // len(self.features), self.weights[pairs % len(self.features)])
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def train_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 300, rate: float = 0.05, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear classifier of least non-negative risk, by Adam on full batches.

    ``ridge`` and ``steps`` were chosen by three-fold cross-validation on learnable rows alone.
    """
    x = np.vstack([positive, unlabelled]).astype(np.float32, copy=False)
    n = len(positive)
    w = np.zeros(x.shape[1] + 1)
    w[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        margin = x @ w[:-1].astype(np.float32) + w[-1]
        up = 1 / (1 + np.exp(-np.clip(margin, -40, 40)))  # also the slope of loss(-); up - 1 is that of loss(+)
        loss_minus = np.logaddexp(0, margin)
        negative_risk = loss_minus[n:].mean() - prior * loss_minus[:n].mean()
        slope = np.empty(len(x), np.float32)
        if negative_risk >= 0:
            slope[:n] = prior / n * ((up[:n] - 1) - up[:n])
            slope[n:] = up[n:] / max(len(x) - n, 1)
        else:  # step back from a negative estimate instead of fitting it
            slope[:n] = prior / n * up[:n]
            slope[n:] = -up[n:] / max(len(x) - n, 1)
        gradient = np.append(x.T @ slope, slope.sum(dtype=np.float64))
        gradient[:-1] += ridge * w[:-1]
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in batches_of_text(batch.column(1)):
            kinds, at = text_features(batch.column(1).slice(a, b - a))
            rows = [_distinct(kinds, at, r).view(np.int64) for r in range(b - a)]
            yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(rows, pa.list_(pa.int64()))], names=["toxic", "hashes"])


def train_toxicity(docs: DataFrame, labels: DataFrame, may_learn: Column, positives: int = 2500, unlabelled: int = 5000, features: int = 1500) -> ToxicityModel | None:
    """Fits on documents and labels of rows where ``may_learn`` (a condition on doc_id) holds; None if none is toxic.

    Features are counted by Spark; only the kept ones, and one bit for each of them and each sampled
    text, come to the driver.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(may_learn & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = known.agg(F.count("*").alias("n"), F.sum(F.when(F.col("toxic") == 1, 1)).alias("toxic")).first()
    if not counts["toxic"]:
        return None
    share = counts["toxic"] / counts["n"]
    # one standard error below the share: a prior that is too high would call clean texts toxic
    prior = min(max(share - (share * (1 - share) / counts["n"]) ** 0.5, 1e-4), 0.9)
    rows = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.where(may_learn & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    by_hash = F.xxhash64(F.lit("sample"), "doc_id")
    chosen_p = known.where("toxic = 1").orderBy(by_hash, "doc_id").limit(positives).select("doc_id", F.lit(1).alias("toxic"))
    chosen_u = rows.select("doc_id").orderBy(by_hash, "doc_id").limit(unlabelled).distinct().select("doc_id", F.lit(0).alias("toxic"))
    # at most ``positives + unlabelled`` ids; of rows that repeat one of them one is taken
    sample = rows.join(F.broadcast(chosen_p.unionByName(chosen_u)), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("toxic", "text")
    sample = cut(sample.mapInArrow(_feature_rows, "toxic int, hashes array<long>"))
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_p, n_u = sizes.get(1, 0), sizes.get(0, 0)
    if not n_p or not n_u:
        return None
    counted = sample.select("toxic", F.explode("hashes").alias("hash")).groupBy("hash").agg(
        (F.sum("toxic") / n_p).alias("p"), (F.sum(1 - F.col("toxic")) / n_u).alias("u"), F.sum("toxic").alias("n")
    )
    p, u = F.col("p"), F.col("u")
    excess = (p - u) / F.sqrt(u * (1 - u) / n_u + p * (1 - p) / n_p + 1 / n_u**2)
    # prior * p / u estimates how likely a text with the feature is toxic
    kept = counted.where((F.col("n") >= 3) & (prior * p > 0.5 * u) & (excess > 3)).orderBy(excess.desc(), "hash").limit(features).select("hash").collect()
    vocabulary = np.sort(np.array([r["hash"] for r in kept], np.int64).view(np.uint64))
    if not len(vocabulary):
        return ToxicityModel(vocabulary, np.zeros(0), float(np.log(prior / (1 - prior))))

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = []
            for hashes in batch.column(1):
                own = hashes.values.to_numpy().view(np.uint64)
                bits.append(np.packbits(np.isin(vocabulary, own)).tobytes())
            yield pa.record_batch([batch.column(0), pa.array(bits, pa.binary())], names=["toxic", "bits"])

    found = sample.mapInArrow(presence, "toxic int, bits binary").toArrow()
    order = sorted(zip(found["toxic"].to_pylist(), found["bits"].to_pylist()), reverse=True)
    x = np.unpackbits(np.stack([np.frombuffer(b, np.uint8) for _, b in order]), axis=1)[:, : len(vocabulary)].astype(np.float32)
    truth = np.array([y for y, _ in order])
    n_toxic = int(truth.sum())  # these rows come first, so both parts are views
    weights, bias = train_nnpu(x[:n_toxic], x[n_toxic:], prior)
    return ToxicityModel(vocabulary, weights, bias)


def score_toxicity(docs: DataFrame, model: ToxicityModel | None, keep: list[Column] = [], at: float = 0.3) -> DataFrame:
    """``doc_id``, the ``keep`` columns, ``score`` and ``predicted`` of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in batches_of_text(batch.column(0)):
                part = batch.slice(a, b - a)
                scores = shared.value.scores(part.column(0)) if shared.value is not None else np.zeros(b - a)
                yield pa.record_batch([*part.columns[1:], pa.array(scores), pa.array((scores >= at).astype(np.int32))], names=names)

    rows = bounded(docs).select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), *keep)
    names = [*rows.columns[1:], "score", "predicted"]
    return rows.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in rows.dtypes[1:]) + ", score double, predicted int")


def held_out() -> Column:
    """Rows that are never learned from: ``crc32(doc_id as text) mod 4 = 2``."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def judge_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``; predicted is 1 from a score of 0.3.

    Null and empty texts have no features and get the bias as score, as do texts without kept features.
    Labels that are null, or of held-out or unknown documents, teach nothing; a doc_id with several
    labels is toxic if one is.  Without a toxic label to learn from all scores are 0.  Very long texts
    are used whole, repeated rows and null doc_ids are judged row by row, an empty table gives no rows,
    and other columns are ignored.
    """
    model = train_toxicity(docs, labels, ~held_out())
    return score_toxicity(docs, model, [held_out().alias("held_out")]).select("doc_id", "held_out", "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, at: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with all columns, that score below ``at``; trained as in :func:`judge_toxicity`."""
    shared = docs.sparkSession.sparkContext.broadcast(train_toxicity(docs, labels, ~held_out()))

    def keep(texts: pa.Array) -> np.ndarray:
        if shared.value is None or not len(texts):
            return np.ones(len(texts), bool)
        return np.concatenate([shared.value.scores(texts.slice(a, b - a)) < at for a, b in batches_of_text(texts)])

    return keep_rows(docs, lambda: keep)
