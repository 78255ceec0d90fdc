"""Document quality by regularised quadratic discriminant analysis.

Each text gives a vector of statistics, transformed to be roughly Gaussian.  Each class has a mean and a
covariance shrunk towards the pooled covariance and its diagonal; the score is the logistic of the
difference of the two Gaussian log densities plus the log prior odds.  The densities use Cholesky factors
that are computed once and carried to the workers.

Moments are summed over all labelled training rows; no sample is drawn.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import LOWER, WHITE, chunks, hash_spans, mix, spans, words
from .storage import Workspace, tidy

#: Shrinkage towards the pooled covariance, of that towards its diagonal, and what is added to variances.
SHRINK, DIAGONAL, RIDGE = 0.1, 0.1, 0.02
#: A document is rejected below this score.
REJECT_BELOW = 0.3
#: Rows whose crc32(id as text) modulo FOLDS is 0 are held out of training.
FOLDS = 5

STATISTICS = ("words", "word_length", "word_spread", "capitals", "odd_signs", "stops", "digits", "odd_ends", "distinct_words", "top_word", "lines", "line_length", "repeated_lines", "short_words", "repeated_runs", "letters")

_UPPER, _DIGIT, _STOP, _LETTER = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = _DIGIT[48:58] = True
_STOP[np.frombuffer(b".,;:?'\"()-", np.uint8)] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_ODD = ~(_LETTER | _DIGIT | _STOP | WHITE)


def _per(sums: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of consecutive slices, from a cumulative sum with a leading zero."""
    return sums[first[1:]] - sums[first[:-1]]


def _cum(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(x, dtype=np.float64)])


def _counts(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in each slice, and the count of its most frequent one."""
    rows = len(first) - 1
    row = np.repeat(np.arange(rows), np.diff(first))
    _, where, count = np.unique(mix(h ^ mix(row.astype(np.uint64))), return_index=True, return_counts=True)
    top = np.zeros(rows)
    np.maximum.at(top, row[where], count)
    return np.bincount(row[where], minlength=rows).astype(float), top


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log odds of the share a / b, held finite by half a count on either side."""
    return np.log((a + 0.5) / (np.maximum(b - a, 0) + 0.5))


def statistics(body: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of transformed statistics for each document."""
    starts, ends, first = words(body, at)
    lens = (ends - starts).astype(float)
    n = np.diff(first).astype(float)
    size = np.diff(at).astype(float)
    one = np.maximum(n, 1)
    mean = _per(_cum(lens), first) / one
    spread = np.sqrt(np.maximum(_per(_cum(lens**2), first) / one - mean**2, 0))
    lower = hash_spans(LOWER[body], starts, ends)
    distinct, top = _counts(lower, first)
    letters, capitals, odd, stops, digits = (_per(_cum(t[body]), at) for t in (_LETTER, _UPPER, _ODD, _STOP, _DIGIT))
    odd_ends = _per(_cum(_ODD[body[ends - 1]]), first)
    s, e, line = spans(body != 10, at)
    n_lines = np.diff(line).astype(float)
    distinct_lines, _ = _counts(hash_spans(body, s, e), line)
    runs = lower.copy()
    if len(runs) > 2:
        runs[:-2] = mix(mix(lower[:-2]) + mix(lower[1:-1] * np.uint64(3)) + mix(lower[2:] * np.uint64(5)))
    inner = np.minimum(first[:-1] + np.maximum(np.diff(first) - 2, 0), first[1:])
    keep = np.ones(len(runs), bool)
    tails = np.concatenate([np.arange(a, b) for a, b in zip(inner.tolist(), first[1:].tolist(), strict=True)]) if len(first) > 1 else []
    keep[np.asarray(tails, np.int64)] = False
    run_first = np.concatenate([[0], np.cumsum(keep)])[first]
    n_runs = np.diff(run_first).astype(float)
    distinct_runs, _ = _counts(runs[keep], run_first)
    short = _per(_cum(lens <= 3), first)
    return np.stack([np.log1p(n), np.log1p(mean), np.log1p(spread), _share(capitals, letters), _share(odd, size), _share(stops, size), _share(digits, size), _share(odd_ends, n), _share(distinct, n), _share(top, n), np.log1p(n_lines), np.log1p(size / np.maximum(n_lines, 1)), _share(n_lines - distinct_lines, n_lines), _share(short, n), _share(n_runs - distinct_runs, n_runs), _share(letters, size)], 1)


def measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, f): every document's statistics; null and empty texts count as no words."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = [statistics(body, at) for _, _, body, at in chunks(batch.column(1))]
            f = np.concatenate(rows) if rows else np.zeros((0, len(STATISTICS)))
            offsets = pa.array(np.arange(len(f) + 1, dtype=np.int32) * f.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(f.ravel()))], ["id", "f"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), f"id {kind}, f array<double>")


@dataclass
class Discriminant:
    """Two Gaussian classes: log priors, means, and inverted Cholesky factors with their log determinants."""

    centre: np.ndarray
    scale: np.ndarray
    prior: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    logdets: np.ndarray

    @classmethod
    def fit(cls, counts: np.ndarray, sums: np.ndarray, squares: np.ndarray, shrink: float = SHRINK, diagonal: float = DIAGONAL, ridge: float = RIDGE) -> Discriminant | None:
        """From counts (2), sums (2, d) and sums of outer products (2, d, d); None with under two rows of a class."""
        if min(counts) < 2:
            return None
        total = counts.sum()
        centre = sums.sum(0) / total
        scale = np.sqrt(np.maximum(np.diag(squares.sum(0)) / total - centre**2, 1e-9))
        raw_means = sums / counts[:, None]
        cov = np.stack([squares[c] / counts[c] - np.outer(raw_means[c], raw_means[c]) for c in (0, 1)]) / np.outer(scale, scale)
        pooled = (counts[:, None, None] * cov).sum(0) / total
        pooled = (1 - diagonal) * pooled + diagonal * np.diag(np.diag(pooled))
        factors, logdets = [], []
        for c in (0, 1):
            own = shrink + (1 - shrink) * len(centre) / (len(centre) + counts[c])  # few rows lean on the pooled one
            lower = np.linalg.cholesky((1 - own) * cov[c] + own * pooled + ridge * np.eye(len(centre)))
            factors.append(np.linalg.inv(lower))
            logdets.append(2 * np.log(np.diag(lower)).sum())
        return cls(centre, scale, np.log(counts / total), (raw_means - centre) / scale, np.stack(factors), np.array(logdets))

    def score(self, f: np.ndarray) -> np.ndarray:
        x = (f - self.centre) / self.scale
        density = [self.prior[c] - 0.5 * (self.logdets[c] + (((x - self.means[c]) @ self.factors[c].T) ** 2).sum(1)) for c in (0, 1)]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def train(features: DataFrame, labels: DataFrame, id_col: str, label_col: str, folds: int = FOLDS) -> tuple[Discriminant | None, float]:
    """The discriminant of the training rows, and label 1's share of them (0.5 without any).

    Labels other than 0 and 1 are ignored; an id labelled more than once takes its least label.
    """
    d = len(STATISTICS)
    told = labels.where(F.col(label_col).isin(0, 1) & (F.crc32(F.col(id_col).cast("string")) % folds != 0))
    told = told.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("y"))
    rows = features.join(told, "id").select("y", "f")

    def moments(batches):
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            x = batch.column(1).flatten().to_numpy().reshape(-1, d)
            for c in (0, 1):
                own = x[y == c]
                total[c] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], total.shape[1]).astype(np.int32)), pa.array(np.tile(np.arange(total.shape[1]), 2).astype(np.int32)), pa.array(total.ravel())], ["y", "i", "v"])

    total = np.zeros((2, 1 + d + d * d))
    for y, i, v in rows.mapInArrow(tidy(moments), "y int, i int, v double").groupBy("y", "i").agg(F.sum("v")).collect():
        total[y, i] = v
    counts = total[:, 0]
    share = float(counts[1] / counts.sum()) if counts.sum() else 0.5
    return Discriminant.fit(counts, total[:, 1 : 1 + d], total[:, 1 + d :].reshape(2, d, d)), share


def scored(features: DataFrame, model: Discriminant | None, share: float, id_type: str) -> DataFrame:
    carried = features.sparkSession.sparkContext.broadcast((model, share))
    d = len(STATISTICS)

    def run(batches):
        model, share = carried.value
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, d)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x) if model else np.full(len(x), share))], ["id", "score"])

    return features.mapInArrow(tidy(run), f"id {id_type}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = REJECT_BELOW) -> DataFrame:
    """One row per input row: (``id_col``, held_out boolean, score double in [0, 1], predicted int).

    Null and empty texts are scored like any other (no words).  A null id is never held out and never
    trained on.  Repeated rows come out as often as they went in.  Where a class has under two training
    rows every score is the share of label 1 (0.5 with none).  Other columns are not read.
    """
    work = Workspace(docs.sparkSession, "quality")
    kind = docs.schema[id_col].dataType.simpleString()
    features = work.table(measured(docs, id_col, text_col), "features")
    model, share = train(features, labels, id_col, label_col)
    out = scored(features, model, share, kind)
    held = F.coalesce(F.crc32(F.col("id").cast("string")) % FOLDS == 0, F.lit(False))
    return out.select(F.col("id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = REJECT_BELOW) -> DataFrame:
    """The documents, with their columns, that the classifier does not reject.

    Each text is measured again where it lies, so no text is shuffled.  Nulls as in ``quality_scores``.
    """
    work = Workspace(docs.sparkSession, "quality")
    model, share = train(work.table(measured(docs, id_col, text_col), "features"), labels, id_col, label_col)
    carried = docs.sparkSession.sparkContext.broadcast((model, share))
    t = docs.columns.index(text_col)

    def run(batches):
        model, share = carried.value
        for batch in batches:
            score = [model.score(statistics(body, at)) if model else np.full(len(at) - 1, share) for _, _, body, at in chunks(batch.column(t))]
            yield batch.filter(pa.array(np.concatenate([np.zeros(0), *score]) >= threshold))

    return docs.mapInArrow(tidy(run), docs.schema)
