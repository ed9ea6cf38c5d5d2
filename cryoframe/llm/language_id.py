"""Language identification with a blended-spectrum string kernel.

A text is cut into equal segments of at most ``SEGMENT`` bytes.  A segment is the set of its byte
n-grams of 1 to ``MAX_N`` bytes (A-Z lower-cased), hashed to ``DIM`` places; the kernel of two segments
is the number of places they share over the geometric mean of their counts.  A text's shares are the
means of its segments', by length, so that in a text of several languages the longest part decides.
Nystroem features on landmark texts feed one-versus-rest kernel ridge regression.  Kernel, Nystroem map
and ridge weights compose to one matrix, so that whole batches are scored by one matrix product of
presence rows.

Training takes one segment of each of at most ``per_language`` labelled rows of each language, those of
smallest hash, and ``sample`` rows in all, of which ``landmarks`` serve as landmarks; these bounds do not
grow with the table or with the number of languages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded
from .wordhash import batches_of_text, text_bytes

MAX_N, DIM, SEGMENT = 3, 1 << 13, 512
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_SPREAD = np.uint32(2654435761)
_ASCII_LETTER = re.compile("[A-Za-z]")


def presence(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows by ``DIM`` matrix of 0 and 1: which hashed n-grams each row has."""
    rows = len(offsets) - 1
    flat = np.zeros(rows * DIM + 1, dtype=np.float32)
    if len(raw):
        low = _LOWER[raw]
        base = np.repeat(np.arange(rows, dtype=np.int64) * DIM, np.diff(offsets))
        gram = np.zeros(len(raw), dtype=np.uint32)
        for n in range(1, MAX_N + 1):
            if len(raw) < n:
                break
            gram = gram[: len(raw) - n + 1] * np.uint32(257) + low[n - 1 :] + np.uint32(n)
            place = base[: len(gram)] + (gram * _SPREAD >> np.uint32(32 - DIM.bit_length() + 1))
            edge = (offsets[1:, None] - np.arange(1, n)[None, :]).ravel()
            place[edge[(edge >= 0) & (edge < len(gram))]] = rows * DIM
            flat[place] = 1
    return flat[:-1].reshape(rows, DIM)


def segments(offsets: np.ndarray, size: int = SEGMENT) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the segments of rows that follow each other, and the row of each; an empty row is one segment."""
    lengths = np.diff(offsets)
    counts = np.maximum(1, -(-lengths // size))
    row = np.repeat(np.arange(len(lengths)), counts)
    place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.append(offsets[row] + lengths[row] * place // counts[row], offsets[-1]), row


def has_letter(text: str | None) -> bool:
    return bool(text) and (_ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text)))


class SpectrumClassifier:
    """One-versus-rest kernel ridge regression on Nystroem features."""

    def __init__(self, rows: np.ndarray, langs: list[str], landmarks: int = 256, ridge: float = 1e-3) -> None:
        self.langs = sorted(set(langs))
        y = np.array([self.langs.index(x) for x in langs])
        order = np.argsort([np.count_nonzero(y[:i] == y[i]) * len(self.langs) + y[i] for i in range(len(y))])
        marks = rows[order[:landmarks]].astype(np.float64)
        marks /= np.sqrt(np.maximum(marks.sum(axis=1, keepdims=True), 1))
        values, vectors = np.linalg.eigh(marks @ marks.T)
        keep = values > 1e-9 * values.max()
        to_features = marks.T @ (vectors[:, keep] / np.sqrt(values[keep]))
        features = self._unit(rows) @ to_features
        target = np.where(y[:, None] == np.arange(len(self.langs)), 1.0, -1.0)
        share = np.bincount(y, minlength=len(self.langs)) / len(y)
        weight = 1 / (share[y] * len(self.langs))
        gram = (features * weight[:, None]).T @ features + ridge * len(y) * np.eye(features.shape[1])
        self.matrix = (to_features @ np.linalg.solve(gram, (features * weight[:, None]).T @ target)).astype(np.float32)

    @staticmethod
    def _unit(rows: np.ndarray) -> np.ndarray:
        return rows / np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1))

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Shares of 1 for each language."""
        margin = 4 * (rows @ self.matrix) / np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1))
        odds = np.exp(margin - margin.max(axis=1, keepdims=True))
        return odds / odds.sum(axis=1, keepdims=True)

    def shares(self, raw: np.ndarray, offsets: np.ndarray, batch: int = 128) -> np.ndarray:
        """Shares of 1 of each row of text: the means over its segments, weighted by length."""
        cuts, row = segments(offsets)
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        for a in range(0, len(row), batch):
            ends = cuts[a : a + batch + 1]
            weight = np.maximum(np.diff(ends), 1e-9)
            scores = self.scores(presence(raw[ends[0] : ends[-1]], ends - ends[0]))
            np.add.at(out, row[a : a + batch], scores * weight[:, None])
        return out / out.sum(axis=1, keepdims=True)


def _packed_presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in batches_of_text(batch.column(1)):
            part = batch.slice(a, b - a)
            raw, offsets = text_bytes(part.column(1))
            cuts, row = segments(offsets)
            first = np.searchsorted(row, np.arange(len(part)))
            middle = first + np.bincount(row, minlength=len(part)) // 2
            bits = [np.packbits(presence(raw[cuts[m] : cuts[m + 1]], np.array([0, cuts[m + 1] - cuts[m]])).astype(bool)[0]).tobytes() for m in middle]
            yield pa.record_batch([part.column(0), pa.array(bits, pa.binary())], names=["lang", "bits"])


def train_language_classifier(labelled: DataFrame, per_language: int = 300, landmarks: int = 256, sample: int = 4000) -> SpectrumClassifier | None:
    """Fits on ``labelled(doc_id, text, lang)``; null texts or langs are left out; None without rows.

    Rows that repeat a doc_id, text and lang teach once, so a language whose rows are all alike is learned from one.  Of more than ``sample`` languages the most frequent are learned.
    """
    usable = bounded(labelled).where("lang is not null and text is not null and length(text) > 0")
    place = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1) / float(1 << 63)
    different = F.approx_count_distinct(F.xxhash64("doc_id", "text")).alias("different")
    counts = usable.groupBy("lang").agg(F.count("*").alias("count"), different).orderBy(F.desc("count"), "lang").limit(sample).collect()
    if not counts:
        return None
    share = min(per_language, max(1, sample // len(counts)))
    # Of a language with many different rows only the places below a bound are ranked.  Rows that repeat have one place, so
    # the bound comes from a count of different ones; it holds three times the share, the sketch that counts errs by a few percent.
    bounds = usable.sparkSession.createDataFrame([(r["lang"], (3.0 * share + 100) / r["different"]) for r in counts], "lang string, bound double")
    near = usable.select("lang", "text", place.alias("place")).join(F.broadcast(bounds), "lang").where(F.col("place") <= F.col("bound"))
    near = near.groupBy("lang", "place").agg(F.min("text").alias("text"))
    order = Window.partitionBy("lang").orderBy("place", "text")
    chosen = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= share)
    found = chosen.select("lang", "text").mapInArrow(_packed_presence, "lang string, bits binary").collect()
    found.sort(key=lambda r: (r["lang"], bytes(r["bits"])))
    rows = np.unpackbits(np.stack([np.frombuffer(r["bits"], np.uint8) for r in found]), axis=1).astype(np.float32)
    return SpectrumClassifier(rows, [r["lang"] for r in found], landmarks)


def predict_language(docs: DataFrame, model: SpectrumClassifier | None, keep: list[Column] = []) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` to doc_id and the ``keep`` columns of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in batches_of_text(batch.column(0)):
                part = batch.slice(a, b - a)
                speaks = np.array([has_letter(t) for t in part.column(0).to_pylist()])
                langs, scores = np.full(len(part), "und", dtype=object), np.zeros(len(part))
                if model is not None and speaks.any():
                    shares = model.shares(*text_bytes(part.column(0)))
                    langs[speaks] = np.array(model.langs, dtype=object)[shares.argmax(axis=1)[speaks]]
                    scores[speaks] = shares.max(axis=1)[speaks]
                yield pa.record_batch([*part.columns[1:], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=names)

    rows = bounded(docs).select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), *keep)
    names = [*rows.columns[1:], "lang_pred", "score"]
    ddl = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes[1:]) + ", lang_pred string, score double"
    return rows.mapInArrow(run, ddl)


def identify_language(docs: DataFrame, per_language: int = 300, landmarks: int = 256) -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score``.

    Held out are documents with ``crc32(doc_id as text) mod 3 = 1``; only the others' text and lang are
    learned from.  ``lang_pred`` is a learned language, or ``und`` with score 0 for texts that are null
    or have no letter, and for all texts when there is nothing to learn from.  Ties go to the first
    language by name.  Very long texts are used whole, repeated rows are judged each, a null doc_id
    counts as not held out, an empty table gives no rows, and other columns are ignored.
    """
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = train_language_classifier(docs.where(~held_out).select("doc_id", "text", "lang"), per_language, landmarks)
    return predict_language(docs, model, [held_out.alias("held_out")]).select("doc_id", "held_out", "lang_pred", "score")
