"""Operators on texts, against brute force, round trips and edge cases."""

import json
import math
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandweave.llm import mixing, ngram_join, pieces, quality, token_store, toxicity
from strandweave.llm.elias_fano import EliasFano
from strandweave.llm.queries import vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
EDGES = [None, "", "  \t\n", "one", "one two three four", "A b C d e", "a B c D E", "\x1c x\x85y ﬁ 中", "w " * 3000, "z" * 5000]


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts, strict=True)], DOCS)


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans(UPPER, UPPER.lower())))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute_components(ids, sets, linked):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if linked(sets[i], sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i in range(len(ids)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least[find(i)] for i in range(len(ids))]


def jaccard80(a, b):
    return bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b)


def variants(rng, n, base, edits):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(edits):
            words[rng.integers(len(words))] = f"e{rng.integers(10**6)}"
        out.append(" ".join(words))
    return out


def test_ngram_join_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    texts = list(EDGES)
    for size in (6, 9, 24, 60, 200):
        for edits in (0, 1, 2, 5):
            base = [f"v{rng.integers(400)}" for _ in range(size)]
            texts += variants(rng, 6, base, edits)
    shared = " ".join(f"p{i}" for i in range(30))
    texts += [f"{shared} " + " ".join(f"u{k}x{i}" for i in range(40)) for k in range(30)]  # a passage that many share
    texts += variants(rng, 40, [f"c{i}" for i in range(120)], 1) + ["one"] * 3
    ids = [int(x) for x in rng.permutation(len(texts)) * 3]
    sets = [shingles(t) for t in texts]
    want = dict(zip(ids, brute_components(ids, sets, jaccard80), strict=True))
    for boundary in (None, 0, 200):  # the cost's own choice, all heavy, all light
        if boundary is not None:
            monkeypatch.setattr(ngram_join, "boundary", lambda *a, b=boundary: b)
        got = ngram_join.ngram_jaccard(docs(spark, texts, ids)).collect()
        assert {r.doc_id: r.component_id for r in got} == want
        assert {r.doc_id: r.n_shingles for r in got} == {i: len(s) for i, s in zip(ids, sets, strict=True)}


@pytest.mark.parametrize("boundary", [0, 200])
@pytest.mark.parametrize("part", [1 << 16, 3])
def test_long_lists_go_on_until_done(spark, monkeypatch, boundary, part):
    """With one pivot, one probe, very short lists and tiny blocks, with and without lists in parts, the blocks
    must find what the first pass does not; sizes differ, and some members have a size of their own."""
    for name, value in (("SHORT_LIST", 2), ("FIRST_PIVOTS", 1), ("PROBES", 1), ("LEFT_BLOCK", 3), ("MET_BLOCK", 4), ("PART", part), ("RARE", 2), ("boundary", lambda *a: boundary)):
        monkeypatch.setattr(ngram_join, name, value)
    rng = np.random.default_rng(5)
    base = [f"c{i}" for i in range(60)]
    texts = [t for k in range(5) for t in variants(rng, 6, base[:50] + [f"k{k}y{i}" for i in range(12)], 1)]
    texts += [" ".join(base[: 40 + 2 * k]) for k in range(11)] + variants(rng, 12, base, 2)
    sets = [shingles(t) for t in texts]
    ids = list(range(len(texts)))
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_jaccard(docs(spark, texts)).collect()}
    assert got == dict(zip(ids, brute_components(ids, sets, jaccard80), strict=True))


@given(st.sets(st.integers(0, (1 << 64) - 1), min_size=1, max_size=300), st.sets(st.integers(0, (1 << 64) - 1), max_size=80), st.integers(0, 300))
@settings(max_examples=60, deadline=None)
def test_bitmaps_never_screen_out_a_link(common, more, gone):
    x = np.array(sorted(common), np.uint64)
    y = np.array(sorted(set(sorted(common)[min(gone, len(common) - 1) :]) | more), np.uint64)
    a, b = ngram_join.parity(x), ngram_join.parity(y)
    words = min(len(a), len(b))
    apart = int(np.bitwise_count(ngram_join._folded(a[None], words) ^ ngram_join._folded(b[None], words)).sum())
    both = len(np.intersect1d(x, y))
    assert apart <= len(x) + len(y) - 2 * both
    if 100 * both >= 80 * (len(x) + len(y) - both):
        assert apart <= ngram_join.most_apart(len(x) + len(y), 80, 100)


def test_ngram_join_edges(spark):
    assert ngram_join.ngram_jaccard(docs(spark, [])).count() == 0
    twice = ngram_join.ngram_jaccard(docs(spark, ["a b c", "a b c", "a b c", "x"], [7, 7, None, None])).collect()
    assert sorted((r.doc_id is None, r.component_id) for r in twice if r.component_id) == [(False, 7), (False, 7), (True, 7)]
    rows = docs(spark, ["a b c d e f", "a b c d e f", "", None, "q"], [4, 2, 9, 10, 11]).withColumn("node", F.lit("clash")).withColumn("component_id", F.lit(0))
    kept = ngram_join.keep_one(rows)
    assert kept.columns == rows.columns and sorted(r.doc_id for r in kept.collect()) == [2, 9, 10, 11]
    assert ngram_join.keep_one(docs(spark, ["a b", "a b"], [1, 1])).count() == 1


def good_text(rng):
    return ". ".join(" ".join(f"{'aeiou'[rng.integers(5)]}{'bcdfg'[rng.integers(5)]}{'lmnrs'[rng.integers(5)]}" for _ in range(12)).capitalize() for _ in range(6)) + "."


def labelled(spark, n=120):
    rng = np.random.default_rng(1)
    texts, quality_, toxic = [], [], []
    for i in range(n):
        bad, rude = i % 3 == 0, i % 4 == 0
        t = good_text(rng)
        t = t.upper().replace(" ", "!! ") if bad and i % 2 else " ".join(f"{w}$$$" for w in t.split()) if bad else t
        if rude:
            words = t.split()
            for k in range(4):
                words.insert(int(rng.integers(len(words))), ("idiot", "moron", f"lowei{k}x")[int(rng.integers(3))])
            t = " ".join(words)
        texts.append(t)
        quality_.append(int(not bad))
        toxic.append(int(rude))
    labels = spark.createDataFrame([(i, q, x) for i, (q, x) in enumerate(zip(quality_, toxic, strict=True))], "doc_id long, quality int, toxic int")
    return docs(spark, texts), labels


def test_quality_on_held_out_rows(spark):
    rows, labels = labelled(spark)
    got = quality.quality_scores(rows, labels).join(labels, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert [r.doc_id for r in got if r.held_out != (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)] == []
    assert len(held) > 10 and np.mean([r.predicted == r.quality for r in held]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    kept = {r.doc_id for r in quality.keep_good(rows, labels).collect()}
    assert kept == {r.doc_id for r in got if r.predicted}


def test_quality_edges(spark):
    rows, labels = labelled(spark)
    ids = [*range(1000, 1000 + len(EDGES) - 1), None]
    more = rows.unionByName(docs(spark, EDGES, ids)).withColumn("score", F.lit("x"))
    got = quality.quality_scores(more, labels.withColumn("text", F.lit("clash"))).collect()
    assert len(got) == more.count() and all(r.score == r.score for r in got)
    none = quality.quality_scores(rows, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.quality_scores(rows.limit(0), labels).count() == 0
    nulls = labels.withColumn("quality", F.when(F.col("doc_id") % 2 == 0, F.col("quality"))).unionByName(labels.withColumn("doc_id", F.lit(None).cast("long")))
    assert quality.quality_scores(rows, nulls).count() == rows.count()


def test_quadratic_discriminant_equals_formula():
    rng = np.random.default_rng(0)
    d = 4
    x = [rng.normal(size=(80, d)) @ rng.normal(size=(d, d)) + c for c in (0, 2)]
    model = quality.Discriminant.fit(np.array([80.0, 80.0]), np.stack([a.sum(0) for a in x]), np.stack([a.T @ a for a in x]))
    point = rng.normal(size=(5, d))
    z = (point - model.centre) / model.scale
    logs = []
    for c in (0, 1):
        lower = np.linalg.inv(model.factors[c])
        cov = lower @ lower.T
        diff = z - model.means[c]
        logs.append(model.prior[c] - 0.5 * (np.linalg.slogdet(cov)[1] + np.einsum("ij,jk,ik->i", diff, np.linalg.inv(cov), diff)))
    assert np.allclose(model.score(point), 1 / (1 + np.exp(logs[0] - logs[1])))


def test_toxicity(spark):
    rows, labels = labelled(spark, 400)
    got = toxicity.toxicity(rows, labels).withColumnRenamed("toxic", "said").join(labels, "doc_id").collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([r.said == r.toxic for r in held]) > 0.95
    assert all(0 <= r.severity <= 3 and 0 <= r.grade <= 3 for r in got)
    rude, clean = ([r.severity for r in got if r.toxic == x] for x in (1, 0))
    assert min(np.mean(rude), 0.5) > np.mean(clean)
    edges = docs(spark, EDGES, [*range(5000, 5000 + len(EDGES) - 1), None])
    assert toxicity.toxicity(edges.withColumn("feature", F.lit(1)), labels).count() == len(EDGES)
    none = toxicity.toxicity(rows, labels.where("toxic = 0")).collect()
    assert {(r.severity, r.toxic) for r in none} == {(0.0, 0)}
    assert toxicity.toxicity(rows.limit(0), labels).count() == 0


def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(2)
    n = 600
    hits = rng.integers(0, 4, n) * (rng.random(n) < 0.5)
    row = np.repeat(np.arange(n), 2)
    feature = np.stack([np.where(hits > 0, 7, 9), 100 + rng.integers(0, 500, n)], 1).ravel()
    count = np.stack([np.maximum(hits, 1), np.ones(n, int)], 1).ravel().astype(float)
    weights, cuts = toxicity.fit(row, feature, count, np.full(n, 10), hits > 0)
    assert (np.diff(cuts) > 0).all() and weights[7] > 1 > abs(weights[9])


TEXTS = st.text(st.sampled_from(list("abcXYZ    \n\t'́éßΣσİ 12.,!?<|>#  　\x1c\x85\x00Åﬁ中▁😀")), max_size=60)


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXTS, max_size=8))
def test_words_equal_the_library(texts):
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    texts = [*texts, "it's I'LL <|endoftext|> x"]
    got = [ids[a:b].tolist() for ids, at in token_store.encode_column(pa.array(texts), path) for a, b in zip(at[:-1], at[1:], strict=True)]
    assert got == [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXTS, max_size=8), st.sampled_from([0.0, 0.1, 0.6]), st.integers(0, 5))
def test_pieces_decode_losslessly(texts, rate, seed):
    import pyarrow as pa
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    model = pieces.pieces(path)
    for first, end, body, was, ids, at in pieces._encoded(pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string()), model, rate, seed):
        back, ends = model.decode(ids, at)
        assert back.tobytes() == body.tobytes() and (ends == was).all()
        if not rate:
            for i in range(first, end):
                if "▁" not in texts[i]:
                    assert ids[at[i - first] : at[i - first + 1]].tolist() == sentencepiece.SentencePieceProcessor(model_file=path).encode(texts[i])


def test_many_stretches_equal_one(spark):
    model = pieces.pieces(vocabulary("piece_bpe_32k.model"))
    words = [w for w in (" international misunderstanding thorough, the\twhithertoing aaaaaaaa  banana").split(" ") if w]
    for rate in (0.0, 0.2, 0.7):
        for i, w in enumerate(words):
            points = model.point[np.array([[ord(c) for c in w]])]
            got = model.segment_many(points, np.array([i * 7919 + 1], np.uint64), int(rate * 2**32))[0]
            assert got is None or got == model.segment(w, i * 7919 + 1, int(rate * 2**32))


def test_piece_tables(spark):
    path = vocabulary("piece_bpe_32k.model")
    rows = docs(spark, [*EDGES, "Hello  world ▁ x"], [*range(len(EDGES)), None]).withColumn("ids", F.lit("clash"))
    encoded = pieces.encode(rows, path)
    assert set(encoded.columns) == set(rows.columns)
    back = pieces.decode(encoded, path).collect()
    assert all(r.decoded == (r.text or "") for r in back)
    assert all(r.lossless for r in pieces.round_trip(rows, path).collect())
    base, other = (pieces.round_trip(docs(spark, ["a misunderstanding of international importance " * 20]), path, seed=s).first().ids_crc32 for s in (1, 2))
    assert base != other
    assert pieces.encode(rows.limit(0), path).count() == 0


def test_every_occurrence_is_drawn_for_itself(spark):
    import pyarrow as pa

    model = pieces.pieces(vocabulary("piece_bpe_32k.model"))
    word, n, rate = " international", 3000, 0.1
    texts = [(word * n)[1:], "x " + (word * 5)[1:], "", "z" * 40 + word * 3]
    keys = pieces._keys(pa.array(range(4)), None, 1)
    ((_, _, body, at, ids, offsets),) = pieces._encoded(pa.array(range(4)), pa.array(texts), model, rate, 1)
    parts = []
    for k, text in enumerate(texts):
        whole = (" " + text).encode() if text else b""
        want = []
        for m in re.finditer(rb" ?[^ ]+", whole):
            with np.errstate(over="ignore"):
                key = int(pieces.mix(keys[k : k + 1] + np.uint64(m.start()) * np.uint64(pieces._PLACE))[0])
            parts.append(tuple(model.segment(m[0].decode(), key, int(rate * 2**32))))
            want += parts[-1]
        assert ids[offsets[k] : offsets[k + 1]].tolist() == want
    plain = tuple(model.segment(word, 0, 0))
    assert len(set(parts[:n])) > 8
    once = sum(p != plain for p in parts[:n]) / n
    rng = np.random.default_rng(0)
    drawn = sum(tuple(model.segment(word, int(k), int(rate * 2**32))) != plain for k in rng.integers(0, 2**63, n)) / n
    assert abs(once - drawn) < 0.05 and once > 0.2
    many = ["a misunderstanding of international importance"] * 200
    cut = {tuple(ids[a:b]) for ids, at in [x[4:] for x in pieces._encoded(pa.array(range(200)), pa.array(many), model, rate, 1)] for a, b in zip(at[:-1], at[1:], strict=True)}
    assert len(cut) > 40


def test_replicas_are_cut_independently(spark):
    rows = docs(spark, ["a misunderstanding of international importance " * 20] * 3, [1, 1, 1]).withColumn("replica", F.monotonically_increasing_id())
    path = vocabulary("piece_bpe_32k.model")
    assert len({tuple(r.ids) for r in pieces.encode(rows, path, replica_col="replica").collect()}) == 3
    assert len({tuple(r.ids) for r in pieces.encode(rows, path).collect()}) == 1
    import corpus_pipeline

    runs = [sorted(tuple(r.ids) for r in corpus_pipeline.encoded(spark, rows.drop("replica").repartition(n), "").collect()) for n in (1, 3)]
    assert runs[0] == runs[1] and len(set(runs[0])) == 3


def test_files_with_another_splitter_get_whole_texts(tmp_path):
    import pyarrow as pa
    from tokenizers import Tokenizer

    told = json.loads(Tokenizer.from_file(vocabulary("word_bpe_49k.json")).to_str())
    for i, change in enumerate(({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}})):
        path = str(tmp_path / f"{i}.json")
        (tmp_path / f"{i}.json").write_text(json.dumps(told | change))
        texts = ["Hello World 12 it's", "", "ÀB  c <|endoftext|> d", None]
        got = [ids[a:b].tolist() for ids, at in token_store.encode_column(pa.array(texts), path) for a, b in zip(at[:-1], at[1:], strict=True)]
        assert not token_store.word_tokenizer(path)[3]
        assert got == [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert token_store.word_tokenizer(vocabulary("word_bpe_49k.json"))[3]


def test_token_ids_must_be_whole_numbers(spark):
    with pytest.raises(TypeError):
        token_store.token_output(docs(spark, ["x"]).withColumn("doc_id", F.lit("a")), vocabulary("word_bpe_49k.json"))


def test_elias_fano():
    for values in ([], [5], [0, 0, 0], [-7, -7, 3, 10**12], sorted(np.random.default_rng(0).integers(0, 10**6, 3000).tolist()), list(range(1000))):
        coded = EliasFano.from_bytes(EliasFano.of(np.array(values, np.int64)).to_bytes())
        assert coded.all().tolist() == values and [coded.select(i) for i in range(len(values))] == values
    dense = EliasFano.of(np.cumsum(np.random.default_rng(1).integers(0, 1000, 100_000)))
    assert len(dense.to_bytes()) < 100_000 * (2 + math.log2(500) + 1) / 8
    with pytest.raises(IndexError):
        dense.select(100_000)


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    texts = [*EDGES, "same", "same", "é <|endoftext|> naïve it's"]
    ids = [30, 10, 20, 5, 5, None, -4, 99, 40, 41, 7, 7, 3]
    rows = docs(spark, texts, ids).withColumn("start", F.lit("clash"))
    got = token_store.token_output(rows, path).collect()
    tok = Tokenizer.from_file(path)
    want = []
    for i, t in zip(ids, texts, strict=True):
        own = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((-(10**9) if i is None else i, len(own), zlib.crc32(own.tobytes())))
    assert sorted((-(10**9) if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == sorted(want)
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == list(np.cumsum([0, *[r.n_tokens for r in ordered][:-1]]))
    named = [r.doc_id for r in ordered]
    assert named[0] is None and named[1:] == sorted(named[1:])
    shards = token_store.write_tokens(rows, path, f"file://{tmp_path}/t")
    first = token_store.Shard(shards[0][1])
    assert first.document(0)[-1] == 2 and len(first) == shards[0][2]
    assert token_store.token_output(rows.limit(0), path).count() == 0
    (tmp_path / "no.tok").write_bytes(b"x" * 40)
    with pytest.raises(ValueError):
        token_store.Shard(f"file://{tmp_path}/no.tok")


def test_mixing(spark):
    rows = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 10)).alias("source"))
    targets = {"hot": 1.0, "s1": 2.0, "s2": 1.0}
    got = mixing.mix(rows, targets=targets, epochs=2.0)
    shares = {r.source: r["count"] for r in got.groupBy("source").count().collect()}
    assert set(shares) == set(targets) and all(abs(n / 60_000 - targets[s] / 4) < 0.02 for s, n in shares.items())
    rate = 2.0 * 30_000 * 0.25 / rows.where("source = 'hot'").count()
    counts = rows.where("source = 'hot'").join(got.groupBy("doc_id").count(), "doc_id", "left").select(F.coalesce("count", F.lit(0)).alias("c")).toPandas().c
    assert abs(counts.mean() - rate) < 0.05 and abs(counts.var() - rate) < 0.08  # a Poisson's variance is its mean
    again = mixing.mix(rows.repartition(7), targets=targets, epochs=2.0)
    assert got.select("doc_id", "replica", "shuffle_key").exceptAll(again.select("doc_id", "replica", "shuffle_key")).isEmpty()
    keys = [r.shuffle_key for r in got.limit(500).collect()]
    assert keys == sorted(keys)


def test_mixing_inverts_the_distribution(spark):
    for rate in (0.0, 0.3, 4.0, 250.0):
        cdf = spark.range(1).select(mixing.distribution(F.lit(rate)).alias("c")).first().c
        want = np.cumsum([math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1)) if rate else float(k == 0) for k in range(len(cdf))])
        assert np.allclose(cdf, want, atol=1e-9) and cdf[-1] > 1 - 1e-9


def test_mixing_edges(spark, monkeypatch):
    rows = docs(spark, ["a", "a", None, "b"], [1, 1, None, 4]).withColumn("replica", F.lit("x")).withColumn("source", F.when(F.col("doc_id").isNotNull(), F.lit("s")))
    got = mixing.mix(rows, epochs=300.0)
    counts = {(r.doc_id, r.text): r["count"] for r in got.groupBy("doc_id", "text").count().collect()}
    assert counts[1, "a"] % 2 == 0 and abs(sum(counts.values()) - 1200) < 200 and (None, None) in counts
    assert mixing.mix(rows.limit(0)).count() == 0 and mixing.mix(rows, targets={"s": 0.0}).count() == 0
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    salted = mixing.mix(rows, epochs=300.0)
    assert got.exceptAll(salted).isEmpty() and salted.exceptAll(got).isEmpty()
    with pytest.raises(ValueError):
        mixing.mix(rows, targets={"s": -1.0})


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as p

    from .test_pii import PRIVATE

    rows, labels = labelled(spark, 150)
    more = docs(spark, [*PRIVATE, *EDGES, PRIVATE[0]], range(900, 901 + len(PRIVATE) + len(EDGES)))
    rows.unionByName(more).unionByName(rows.where("doc_id = 1").withColumn("doc_id", F.lit(800).cast("long"))).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    before = spark.read.parquet(str(tmp_path / "documents.parquet"))
    good = p.good_documents(spark, before, str(tmp_path))
    assert good.columns == before.columns and 0 < good.count() < before.count()
    one = p.one_of_each_group(spark, good, str(tmp_path))
    texts = [shingles(r.text) for r in one.collect()]
    assert not any(jaccard80(a, b) for i, a in enumerate(texts) for b in texts[:i]) and one.where("doc_id = 800").count() == 0
    private = p.without_personal_data(spark, one, str(tmp_path))
    assert private.columns == before.columns and private.count() == one.count()
    mixed = p.mixed_sources(spark, private, str(tmp_path))
    assert mixed.columns == before.columns
    final = p.run(spark, str(tmp_path))
    assert final.columns == ["doc_id", "source", "ids"] and final.count() == mixed.count()
    assert json.dumps([n for n, _ in p.STAGES])
