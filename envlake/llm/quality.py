"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text becomes a vector of transformed statistics. Per class, mean and covariance come from
sums that Spark aggregates over all labelled learning rows; the covariances are shrunk towards
the pooled one and its diagonal. A score is the logistic of the difference of the two Gaussian
log densities (Mahalanobis distances by Cholesky factors kept with the model) plus log priors.

Defined results: null and empty texts have the statistics of an empty text and get a score;
a repeated row is scored each time; labels are joined by ``doc_id``, and null labels or ids are
never learnt from. With fewer than two rows of a class every score is the share of class 1
(0.5 without any label). Only ``doc_id`` and ``text`` are read for a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from envlake.llm.common import id_text, ship_package, slices
from envlake.llm.vec import join_texts, word_hashes, word_spans

STATISTICS = ("word_length", "upper", "symbols", "marks", "digits", "again", "bars", "lines", "longest")

_UPPER, _LETTER, _SYMBOL, _MARK, _DIGIT, _BAR = (np.zeros(256, dtype=bool) for _ in range(6))
_UPPER[ord("A"):ord("Z") + 1] = True
_LETTER[ord("A"):ord("Z") + 1] = _LETTER[ord("a"):ord("z") + 1] = True
_SYMBOL[[*b"#*$%&<>@^~\\{}[]"]] = True
_MARK[[*b"!?"]] = True
_DIGIT[ord("0"):ord("9") + 1] = True
_BAR[ord("|")] = True

#: Added to each denominator, so that a ratio of a short text stays near the usual one.
_EASE = 40.0


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of :data:`STATISTICS` for each text; all finite."""
    data, offs = join_texts(texts)
    starts, ends, first = word_spans(data, offs)
    n_words = np.diff(first).astype(float)

    def count(which: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum(which[data], out=total[1:])
        return np.diff(total[offs]).astype(float)
    lead = (data & 0xC0) != 0x80  # the first byte of each code point
    points = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(lead, out=points[1:])
    length = (points[ends] - points[starts]).astype(float)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    chars = np.bincount(doc, weights=length, minlength=len(texts))
    longest = np.zeros(len(texts))
    np.maximum.at(longest, doc, length)
    h = word_hashes(data, starts, ends)
    same = np.zeros(len(h), dtype=bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    again = np.bincount(doc, weights=same, minlength=len(texts))
    break_ = np.zeros(256, dtype=bool)
    break_[ord("\n")] = True
    letters = count(_LETTER)
    return np.column_stack([
        np.log((chars + 5 * _EASE) / (n_words + _EASE)),
        np.sqrt(count(_UPPER) / (letters + 4 * _EASE)),
        np.sqrt(count(_SYMBOL) / (chars + _EASE)),
        np.sqrt(count(_MARK) / (chars + _EASE)),
        np.sqrt(count(_DIGIT) / (chars + _EASE)),
        np.sqrt(again / (n_words + _EASE)),
        np.sqrt(count(_BAR) / (chars + _EASE)),
        np.sqrt(count(break_) / (n_words + _EASE)),
        np.log1p(longest) / 4])


@dataclass(frozen=True)
class Model:
    """Class means, inverse Cholesky factors, log normalisers with priors, and the share of class 1."""

    means: np.ndarray | None
    whiten: np.ndarray | None
    offset: np.ndarray | None
    share: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row."""
        if self.means is None:
            return np.full(len(x), self.share)
        log = [o - 0.5 * (((x - m) @ w.T) ** 2).sum(axis=1) for m, w, o in zip(self.means, self.whiten, self.offset)]
        return 1.0 / (1.0 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def fit(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], pool: float = 0.05, diagonal: float = 0.05,
        floor: float = 1e-4) -> Model:
    """A model from each class's count, sum and sum of outer products."""
    n = {c: s[0] for c, s in sums.items()}
    total = sum(n.values())
    if min(n.get(0, 0), n.get(1, 0)) < 2:
        return Model(None, None, None, n.get(1, 0) / total if total else 0.5)
    means = {c: s[1] / s[0] for c, s in sums.items()}
    cov = {c: s[2] / s[0] - np.outer(means[c], means[c]) for c, s in sums.items()}
    pooled = sum(cov[c] * n[c] for c in cov) / total
    whiten, offset = [], []
    for c in (0, 1):
        own = (1 - pool) * cov[c] + pool * pooled
        own = (1 - diagonal) * own + diagonal * np.diag(np.diag(own)) + floor * np.eye(len(own))
        low = np.linalg.cholesky(own)
        whiten.append(np.linalg.inv(low))
        offset.append(np.log(n[c] / total) - np.log(np.diag(low)).sum())
    return Model(np.array([means[0], means[1]]), np.array(whiten), np.array(offset), n[1] / total)


def with_statistics(docs: DataFrame) -> DataFrame:
    """``(doc_id, x array<double>)`` of every row, without a shuffle."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = statistics([t.encode() for t in b.column("text").to_pylist()])
            flat = pa.array(x.reshape(-1), pa.float64())
            at = pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32())
            yield pa.record_batch([b.column("doc_id"), pa.ListArray.from_arrays(at, flat)], ["doc_id", "x"])
    return id_text(docs).mapInArrow(run, "doc_id long, x array<double>")


def learning_row(doc_id) -> F.Column:
    """Whether a document may be learnt from: ``crc32(doc_id as text) % 3`` isn't 1."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 != 1


def learn(stats: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Fit on all labelled learning rows of :func:`with_statistics`; only class sums (a few
    hundred numbers) reach the driver. Texts aren't moved: the join is on ids and vectors."""
    d = len(STATISTICS)
    marked = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("c"))
              .where(F.col("c").isin(0, 1) & learning_row("doc_id")).distinct())
    known = stats.where(learning_row("doc_id")).join(marked, "doc_id")
    ship_package(stats.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for b in batches:
            x = _matrix(b.column("x"))
            c = b.column("c").to_numpy()
            for k in (0, 1):
                own = x[c == k]
                s = sums.setdefault(k, [0.0, np.zeros(d), np.zeros((d, d))])
                s[0] += len(own)
                s[1] += own.sum(axis=0)
                s[2] += own.T @ own
        rows = [(k, i, float(v)) for k, s in sums.items() for i, v in
                enumerate(np.concatenate([[s[0]], s[1], s[2].reshape(-1)]))]
        if rows:
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
                                   pa.array([r[2] for r in rows], pa.float64())], ["c", "i", "v"])
    parts = known.select("c", "x").mapInArrow(run, "c int, i int, v double")
    found = parts.groupBy("c", "i").agg(F.sum("v").alias("v")).collect()  # 2 * (1 + d + d * d) rows
    flat = {k: np.zeros(1 + d + d * d) for k in (0, 1)}
    for r in found:
        flat[r["c"]][r["i"]] = r["v"]
    return fit({k: (v[0], v[1:1 + d], v[1 + d:].reshape(d, d)) for k, v in flat.items()})


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(STATISTICS))


def score_documents(stats: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row of :func:`with_statistics`."""
    ship_package(stats.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column("doc_id"), pa.array(model.score(_matrix(b.column("x"))), pa.float64())],
                                  ["doc_id", "score"])
    scored = stats.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(~learning_row("doc_id"), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows whose text scores 0.5 or more, with all their columns; no shuffle."""
    ship_package(docs.sparkSession)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            s = model.score(statistics([(t or "").encode() for t in b.column("text").to_pylist()]))
            yield b.filter(pa.array(s >= 0.5)).select(names)
    return docs.mapInArrow(run, docs.schema)
