"""Toxicity severity by a cumulative-link (proportional odds) model on sparse words and word beginnings.

Grades are ordered: 0 is not toxic, 1 to ``GRADES - 1`` are rising severity.  One weight vector over hashed
words and word beginnings is shared by all thresholds: P(grade >= k) = logistic(w.x - t_k) with
t_1 < t_2 < ...; the result is the expected grade.

The features are those whose presence marks toxic training documents by a likelihood-ratio test.  Labels say
only toxic or not, so the training grade of a toxic document is how densely it uses these features, cut into
equal thirds over the toxic training rows.  Near copies among the training rows count once.

The model is fitted on the driver from at most ``SAMPLE`` labelled rows, those with the least hash of their
id; scoring reads all of every text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import LOWER, chunks, hash_spans, mix, spans

#: Most labelled rows that the fit reads.
SAMPLE = 12_000
#: Hashed features, as a power of two; the weights take eight bytes each on every worker.
HASH_BITS = 20
GRADES = 4
#: Bytes of the word beginnings that are features beside the words themselves.
BEGINNINGS = (4, 5, 6)
#: Least likelihood ratio and least number of toxic documents of a feature, and most features.
LEAST_RATIO, LEAST_DOCUMENTS, MOST_FEATURES = 12.0, 3, 8192
FOLDS = 5
#: A document counts as toxic from this P(grade >= 1) on.
TOXIC_FROM = 0.2

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def features(body: np.ndarray, at: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature) of every word and word beginning, of the wanted features if given, and words per document."""
    starts, ends, first = spans(_LETTER[body], at)
    body = LOWER[body]
    n = np.diff(first)
    row = np.repeat(np.arange(len(n)), n)
    rows, found = [], []
    for size in (0, *BEGINNINGS):
        long = ends - starts > size
        end = ends[long] if not size else starts[long] + size
        f = (hash_spans(body, starts[long], end, size) >> np.uint64(64 - HASH_BITS)).astype(np.int64)
        own = row[long]
        if wanted is not None:
            use = wanted[f]
            f, own = f[use], own[use]
        rows.append(own)
        found.append(f)
    return np.concatenate(rows), np.concatenate(found), n


def counted(row: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, feature) with their numbers, in order."""
    key, count = np.unique((row << HASH_BITS) | feature, return_counts=True)
    return key >> HASH_BITS, key & ((1 << HASH_BITS) - 1), count


def _markers(row, feature, toxic):
    """The features whose presence marks toxic rows, best first."""
    a = np.bincount(feature[toxic[row]], minlength=1 << HASH_BITS).astype(float)
    b = np.bincount(feature[~toxic[row]], minlength=1 << HASH_BITS).astype(float)
    na, nb = toxic.sum(), (~toxic).sum()
    pooled = (a + b) / (na + nb)

    def part(k, n):
        p = np.clip(k / n, 1e-12, 1 - 1e-12)
        q = np.clip(pooled, 1e-12, 1 - 1e-12)
        return k * np.log(p / q) + (n - k) * np.log((1 - p) / (1 - q))

    ratio = np.where((a / na > b / nb) & (a >= LEAST_DOCUMENTS), 2 * (part(a, na) + part(b, nb)), 0)
    best = np.argsort(-ratio, kind="stable")[:MOST_FEATURES]
    return best[ratio[best] > LEAST_RATIO]


def _first_copies(row, feature, toxic):
    """Rows of which no earlier row of the same label has the same two least feature hashes."""
    sign = []
    for salt in (1, 2):
        least = np.full(len(toxic), np.iinfo(np.uint64).max)
        np.minimum.at(least, row, mix(feature.astype(np.uint64) * np.uint64(2) + np.uint64(salt << 40)))
        sign.append(least)
    keys = np.stack([toxic.astype(np.uint64), *sign], 1)
    _, first = np.unique(keys, axis=0, return_index=True)
    return np.sort(first)


def _grades(row, count, n, toxic):
    """Ordered training grades from the density of the marking features."""
    density = np.bincount(row, weights=count, minlength=len(toxic)) / np.maximum(n, 1)
    cuts = np.quantile(density[toxic], np.arange(1, GRADES - 1) / (GRADES - 1))
    return np.where(toxic, 1 + np.searchsorted(cuts, density, "left"), 0)


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit(row, feature, count, n, toxic, steps: int = 160, rate: float = 0.1, penalty: float = 3e-4):
    """Weights by hashed feature and rising thresholds, by full-batch gradient steps; None without both classes."""
    toxic = toxic.astype(bool)
    first = _first_copies(row, feature, toxic)
    place = np.full(len(toxic), -1)
    place[first] = np.arange(len(first))
    use = place[row] >= 0
    row, feature, count, n, toxic = place[row[use]], feature[use], count[use], n[first], toxic[first]
    if toxic.all() or not toxic.any():
        return None
    known = np.sort(_markers(row, feature, toxic))
    slots = np.full(1 << HASH_BITS, -1)
    slots[known] = np.arange(len(known))
    use = slots[feature] >= 0
    row, slot, count = row[use], slots[feature[use]], count[use]
    grade = _grades(row, count, n, toxic)
    x = np.log1p(count)
    w = np.zeros(len(known))
    base, gaps = np.array([2.0]), np.zeros(GRADES - 2)
    state = [np.zeros(len(w) + GRADES - 1) for _ in range(2)]
    k = np.arange(GRADES)
    rows = len(toxic)
    for step in range(1, steps + 1):
        cuts = np.concatenate([base, base + np.cumsum(np.exp(gaps))])
        eta = np.bincount(row, weights=x * w[slot], minlength=rows)
        above = np.concatenate([np.ones((rows, 1)), _logistic(eta[:, None] - cuts), np.zeros((rows, 1))], 1)
        own, nxt = above[np.arange(rows), grade], above[np.arange(rows), grade + 1]
        # d log(own - nxt) / d eta: the derivative of a logistic s is s (1 - s), of the constant ends 0
        p = np.maximum(own - nxt, 1e-12)
        up, down = own * (1 - own) / p, nxt * (1 - nxt) / p
        slope = (up - down) / rows
        by_cut = np.array([(np.where(grade == j, -up, 0) + np.where(grade + 1 == j, down, 0)).sum() / rows for j in k[1:]])
        grad_gap = np.array([by_cut[j:].sum() for j in range(1, GRADES - 1)]) * np.exp(gaps)
        grad = -np.concatenate([np.bincount(slot, weights=x * slope[row], minlength=len(w)) - penalty * w, [by_cut.sum()], grad_gap])
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.999 * state[1] + 0.001 * grad**2
        move = rate * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-8)
        w -= move[: len(w)]
        base = base - move[len(w)]
        gaps = np.clip(gaps - move[len(w) + 1 :], -4, 4)
    dense = np.zeros(1 << HASH_BITS)
    dense[known] = w
    return dense, np.concatenate([base, base + np.cumsum(np.exp(gaps))])


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int):
    """The model from at most ``sample`` labelled rows outside the held-out fold; the rows' order, which differs
    from run to run, does not matter to it."""
    told = labels.where(F.col(label_col).isin(0, 1) & (F.crc32(F.col(id_col).cast("string")) % FOLDS != 0))
    told = told.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    told = told.orderBy(F.xxhash64("id"), "id").limit(sample)

    def run(batches):
        for batch in batches:
            found, counts, totals = [], [], []
            for _, _, body, at in chunks(batch.column(1)):
                row, feature, n = features(body, at)
                row, feature, count = counted(row, feature)
                cut = np.searchsorted(row, np.arange(len(n) + 1))
                found += [feature[a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                counts += [count[a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                totals += n.tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(totals, pa.int64()), pa.array(found, pa.binary()), pa.array(counts, pa.binary())], ["y", "h", "n", "feature", "count"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(told), "id").select("id", "y", "text")
    got = rows.select("y", "text", F.xxhash64("id").alias("h")).mapInArrow(run, "y int, h long, n long, feature binary, count binary").toArrow()
    if not len(got):
        return None
    got = got.sort_by([(c, "ascending") for c in ("h", "y", "n", "feature", "count")])
    found = [np.frombuffer(x.as_py(), np.int32) for x in got.column("feature")]
    counts = [np.frombuffer(x.as_py(), np.int32) for x in got.column("count")]
    row = np.repeat(np.arange(len(found)), [len(x) for x in found])
    return fit(row, np.concatenate(found).astype(np.int64), np.concatenate(counts).astype(float), got.column("n").to_numpy(), got.column("y").to_numpy())


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """One row per input row: (``id_col``, p_toxic, severity double, grade int, toxic int).

    ``severity`` is the expected grade, ``grade`` the likeliest one, ``p_toxic`` = P(grade >= 1), ``toxic``
    is 1 where that reaches ``TOXIC_FROM``.  Null and empty texts have no words and get the model's base rate.
    Without training rows of both classes all results are 0.  An id labelled more than once takes its
    greatest label; labels other than 0 and 1 are ignored.  Repeated rows are kept; other columns are not
    read.
    """
    model = train(docs, labels, id_col, text_col, label_col, sample)
    carried = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        model = carried.value
        wanted = model[0] != 0 if model else None
        for batch in batches:
            above = []
            for _, _, body, at in chunks(batch.column(1)):
                if model is None:
                    above.append(np.zeros((len(at) - 1, GRADES - 1)))
                    continue
                row, feature, n = features(body, at, wanted)
                row, feature, count = counted(row, feature)
                eta = np.bincount(row, weights=np.log1p(count) * model[0][feature], minlength=len(n))
                above.append(_logistic(eta[:, None] - model[1]))
            p = np.concatenate([np.zeros((0, GRADES - 1)), *above])
            exact = np.concatenate([np.ones((len(p), 1)), p], 1) - np.concatenate([p, np.zeros((len(p), 1))], 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p[:, 0]), pa.array(p.sum(1)), pa.array(exact.argmax(1).astype(np.int32)), pa.array((p[:, 0] >= TOXIC_FROM).astype(np.int32))], ["id", "p_toxic", "severity", "grade", "toxic"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, p_toxic double, severity double, grade int, toxic int")
    return out.withColumnRenamed("id", id_col)
