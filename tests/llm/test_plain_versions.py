"""Learned and tokenizing operators against plain Python, one text and one word after the other."""

import math
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from strandweave.llm import embed_dedup, pieces, quality, toxicity
from strandweave.llm.bytetext import hash_spans
from strandweave.llm.queries import vocabulary

from .test_text_operators import EDGES, docs, labelled

LETTERS = set(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") | set(range(128, 256))
STOPS, WHITE = set(b".,;:?'\"()-"), set(b" \t\n\x0b\x0c\r")


def lowered(raw):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in raw)


def plain_statistics(text):
    raw = (text or "").encode()
    words, lines = re.findall(rb"[^\x20\x09-\x0D]+", raw), re.findall(rb"[^\n]+", raw)
    low = [lowered(w) for w in words]
    n, size, lens = len(words), len(raw), list(map(len, words))
    mean = sum(lens) / max(n, 1)
    spread = math.sqrt(max(sum(x * x for x in lens) / max(n, 1) - mean**2, 0))
    odd = lambda c: c not in LETTERS and c not in STOPS and c not in WHITE and not 48 <= c <= 57
    letters, runs = sum(c in LETTERS for c in raw), list(zip(low, low[1:], low[2:], strict=False))

    def share(a, b):
        return math.log((a + 0.5) / (max(b - a, 0) + 0.5))

    return [
        math.log1p(n), math.log1p(mean), math.log1p(spread), share(sum(65 <= c <= 90 for c in raw), letters), share(sum(map(odd, raw)), size), share(sum(c in STOPS for c in raw), size), share(sum(48 <= c <= 57 for c in raw), size),
        share(sum(odd(w[-1]) for w in words), n), share(len(set(low)), n), share(max(Counter(low).values(), default=0), n), math.log1p(len(lines)), math.log1p(size / max(len(lines), 1)),
        share(len(lines) - len(set(lines)), len(lines)), share(sum(x <= 3 for x in lens), n), share(len(runs) - len(set(runs)), len(runs)), share(letters, size),
    ]


WORDY = st.text(st.sampled_from(list("abA éß中 \n\t.,!?$%9\x1c  ")), max_size=80)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(WORDY, st.sampled_from([t or "" for t in EDGES])), min_size=1, max_size=6))
def test_statistics_equal_plain_python(texts):
    import pyarrow as pa

    from strandweave.llm.bytetext import chunks

    got = np.concatenate([quality.statistics(body, at) for _, _, body, at in chunks(pa.array(texts, pa.string()))])
    assert np.allclose(got, [plain_statistics(t) for t in texts])


def test_quality_equals_plain_python(spark):
    """The whole query: statistics, moments of the training rows, shrunk covariances, densities."""
    rows, labels = labelled(spark)
    texts = {r.doc_id: r.text for r in rows.collect()}
    said = {r.doc_id: r.quality for r in labels.collect()}
    x = {i: np.array(plain_statistics(t)) for i, t in texts.items()}
    train = [i for i in texts if zlib.crc32(str(i).encode()) % 5]
    whole = np.array([x[i] for i in train])
    centre, scale = whole.mean(0), np.maximum(whole.std(0), 10**-4.5)
    classes = [np.array([(x[i] - centre) / scale for i in train if said[i] == c]) for c in (0, 1)]
    own = [np.cov(z.T, bias=True) for z in classes]
    pooled = sum(len(z) * s for z, s in zip(classes, own, strict=True)) / len(train)
    pooled = (1 - quality.DIAGONAL) * pooled + quality.DIAGONAL * np.diag(np.diag(pooled))
    d, logs = whole.shape[1], {i: [] for i in texts}
    for z, s in zip(classes, own, strict=True):
        a = quality.SHRINK + (1 - quality.SHRINK) * d / (d + len(z))
        cov = (1 - a) * s + a * pooled + quality.RIDGE * np.eye(d)
        for i in texts:
            diff = (x[i] - centre) / scale - z.mean(0)
            logs[i].append(math.log(len(z) / len(train)) - 0.5 * (np.linalg.slogdet(cov)[1] + diff @ np.linalg.solve(cov, diff)))
    want = {i: 1 / (1 + math.exp(min(a - b, 700))) for i, (a, b) in logs.items()}
    got = {r.doc_id: r.score for r in quality.quality_scores(rows, labels).collect()}
    assert np.allclose([got[i] for i in texts], [want[i] for i in texts], atol=1e-6)


def plain_features(text):
    """Hashed words and word beginnings with their numbers."""
    out = Counter()
    for word in re.findall(rb"[A-Za-z\x80-\xff]+", (text or "").encode()):
        word = lowered(word)
        for size in (0, *toxicity.BEGINNINGS):
            if len(word) > size:
                part = word[:size] if size else word
                h = hash_spans(np.frombuffer(part, np.uint8), np.array([0]), np.array([len(part)]), size)[0]
                out[int(h) >> (64 - toxicity.HASH_BITS)] += 1
    return out


def test_toxicity_equals_plain_python(spark):
    rows, labels = labelled(spark, 200)
    model = toxicity.train(rows, labels, "doc_id", "text", "toxic", toxicity.SAMPLE)
    more = rows.unionByName(docs(spark, EDGES, range(1000, 1000 + len(EDGES))))
    got = {r.doc_id: r for r in toxicity.toxicity(more, labels).collect()}
    for r in more.collect():
        eta = sum(math.log1p(k) * model[0][f] for f, k in plain_features(r.text).items())
        above = [1.0, *(1 / (1 + math.exp(c - eta)) for c in model[1]), 0.0]
        grades = [a - b for a, b in zip(above, above[1:], strict=False)]
        mine = got[r.doc_id]
        assert math.isclose(sum(grades), 1) and min(grades) >= 0
        assert np.allclose([mine.p_toxic, mine.severity], [above[1], sum(k * p for k, p in enumerate(grades))])
        assert mine.toxic == (above[1] >= toxicity.TOXIC_FROM) and math.isclose(grades[mine.grade], max(grades))


def test_toxicity_with_ties_between_features(spark):
    """Two words that always stand together get one weight, and order of rows changes nothing."""
    rows, labels = labelled(spark, 200)
    from pyspark.sql import functions as F

    twice = rows.withColumn("text", F.regexp_replace("text", "idiot", "idiot zzidiot"))
    a, b = (toxicity.train(x, labels, "doc_id", "text", "toxic", toxicity.SAMPLE) for x in (twice, twice.repartition(5)))
    weights = [a[0][max(plain_features(w), key=lambda f: abs(a[0][f]))] for w in ("idiot", "zzidiot")]
    assert math.isclose(*weights, rel_tol=1e-9) and weights[0] > 0
    assert np.allclose(a[0], b[0]) and np.allclose(a[1], b[1])


def plain_segments(model, text, key, cutoff):
    """Merge the best candidate that is left, over and over; one that its draw skips stays skipped."""
    parts = list(text)

    def skipped(place, size):
        x = (key ^ (place * pieces._PLACE + size * pieces._SIZE)) & pieces._ALL
        return ((x ^ (x >> 29)) * pieces._SPREAD & pieces._ALL) >> 32 < cutoff

    while True:
        best, place = None, 0
        for i in range(len(parts) - 1):
            both = parts[i] + parts[i + 1]
            if both in model.rank and not (cutoff and skipped(place, len(both))):
                best = min(best or (model.rank[both], place, i), (model.rank[both], place, i))
            place += len(parts[i])
        if best is None:
            break
        i = best[2]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [x for p in parts for x in ([model.id[p]] if p in model.id else [model.byte[c] for c in p.encode()])]


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.sampled_from([" international", " misunderstanding", "aaaaaaaa", "   ", " Ünïcödé", " 1234567890"]), st.text(st.sampled_from(list("abcdeinorst é中\t")), min_size=1, max_size=24)), st.integers(0, (1 << 64) - 1), st.sampled_from([0.0, 0.1, 0.5, 0.9]))
def test_merge_dropout_equals_plain_python(text, key, rate):
    model, cutoff = pieces.pieces(vocabulary("piece_bpe_32k.model")), int(rate * (1 << 32))
    want = plain_segments(model, text, key, cutoff)
    assert model.segment(text, key, cutoff) == want
    many = model.segment_many(model.point[np.array([[ord(c) for c in text]])], np.array([key], np.uint64), cutoff)[0]
    assert many is None or many == want


def test_one_very_long_stretch(spark):
    """A text without spaces is one stretch for the agenda, and decodes to itself."""
    text = "misunderstanding" * 2_000
    got = pieces.round_trip(docs(spark, [text, None], [1, 2]), vocabulary("piece_bpe_32k.model")).orderBy("doc_id").collect()
    assert got[0].lossless and got[0].n_tokens > 2_000 and got[1].n_tokens == 0


def test_recall_of_more_axes():
    """Pairs at a cosine of 0.9 to 0.95 that share a probe, by number of axes; tables of 10**8 vectors use four."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(600, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cos = rng.uniform(0.9, 0.95, len(x))[:, None]
    y = cos * x + np.sqrt(1 - cos**2) * side
    for axes in (1, 2, 3, 4):
        a, b = embed_dedup.probes(x, axes), embed_dedup.probes(y, axes)
        met = (a[:, :, :, None] == b[:, :, None, :]).any((1, 2, 3))
        assert met.mean() >= 0.95, axes
