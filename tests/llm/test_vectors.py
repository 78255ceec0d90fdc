"""Vector operators against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandweave.llm import embed_dedup, topk
from strandweave.llm.components import components
from strandweave.llm.storage import Workspace

from .test_text_operators import brute_components


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], "vec_id long, embedding array<float>, label int")


def near_groups(rng, groups=40, size=6, d=32, noise=0.05):
    out = []
    for _ in range(groups):
        centre = rng.normal(size=d)
        out += [centre + noise * np.linalg.norm(centre) * rng.normal(size=d) / np.sqrt(d) * k for k in range(size)]
    return out


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 16)  # so that buckets fall into several blocks
    rng = np.random.default_rng(4)
    rows = near_groups(rng) + list(rng.normal(size=(200, 32)))
    rows += [rows[0]] * 5 + near_groups(rng, 1, 60, noise=0.004)
    odd = [None, [], [0.0] * 32, [1.0, None] * 16, [float("nan")] * 32, [float("inf")] + [0.0] * 31, [1.0, 2.0]]
    ids = [int(x) for x in rng.permutation(len(rows) + len(odd))]
    df = table(spark, zip(ids, [*rows, *odd], strict=True)).withColumn("node", F.lit("clash"))
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(df).collect()}
    x = np.array(rows, np.float32).astype(float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = unit @ unit.T
    links = (cos >= 0.9).sum(1) - 1
    true, found = links.sum(), sum(got[i].n_links for i in ids[: len(rows)])
    assert 0.98 * true <= found <= true and all(got[i].n_links <= n for i, n in zip(ids, links, strict=False))
    want = brute_components(ids[: len(rows)], list(range(len(rows))), lambda a, b: cos[a, b] >= 0.9)
    same = np.mean([got[i].component_id == w for i, w in zip(ids, want, strict=False)])
    assert same > 0.98
    for i in ids[len(rows) :]:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_near_duplicate_edges(spark):
    assert embed_dedup.near_duplicates(table(spark, [])).count() == 0
    rows = embed_dedup.near_duplicates(table(spark, [(1, [1, 0]), (1, [1, 0]), (None, [1, 0]), (None, None)])).collect()
    assert sorted((r.vec_id or -1, r.n_links, r.component_id or -1) for r in rows) == [(-1, 0, -1), (-1, 2, 1), (1, 2, 1), (1, 2, 1)]
    big = embed_dedup.near_duplicates(table(spark, [(1, [1e38, 1e38]), (2, [2e38, 2e38]), (3, [1e-38, -1e-38])])).orderBy("vec_id").collect()
    assert [r.n_links for r in big] == [1, 1, 0]


def test_hadamard_is_a_rotation():
    x = np.random.default_rng(0).normal(size=(5, 64))
    y = embed_dedup._hadamard(x)
    assert np.allclose(np.linalg.norm(y, axis=1), np.linalg.norm(x, axis=1)) and np.allclose(embed_dedup._hadamard(y), x)


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 50)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    monkeypatch.setattr(topk, "PASS_WEIGHTS", 200)  # so that there are several passes
    rng = np.random.default_rng(6)
    rows = [np.round(rng.normal(size=8) * (rng.random(8) < 0.6), 2) for _ in range(600)]
    rows[50:70] = [rows[100]] * 20  # ties
    odd = [None, [None] * 8, [float("nan")] * 8, [float("-inf")] + [0] * 7]
    df = table(spark, enumerate([*rows, *odd])).withColumn("score", F.lit(1)).withColumn("terms", F.lit(1))
    got = [tuple(r) for r in topk.vector_top_k(df).orderBy("query_id", "rank").select("query_id", "rank", "vec_id", "score").collect()]
    whole = np.floor(1024 * np.array(rows, np.float32).astype(float)).astype(np.int64)
    want = []
    for q in range(0, 600, 100):
        best = sorted((-int(whole[q] @ whole[c]), c) for c in range(600) if c != q)[:10]
        want += [(q, i + 1, c, -s) for i, (s, c) in enumerate(best)]
    assert got == want


def test_top_k_of_large_parts(spark):
    rng = np.random.default_rng(8)
    rows = [np.round(rng.normal(size=4), 2) for _ in range(320)]
    rows[0], rows[7], rows[100] = [2e5, 0.1, 0, 0], [2e5, 0.1, 1, 0], [-3e5, 1, 0, 2e12]
    rows[9], rows[11] = [1e3, 0, 0, -4e12], [0, 0, 0, 1e6]  # its score with 100 is far below 64 bits
    rows[12], rows[13], rows[14] = [1e30] * 4, [3e38, -3e38, 0, 1], [-1e30] * 4  # beyond 64 bits and 38 digits
    rows[200], rows[300] = [3e38, 1, 0, 0], [1, 0, 0, 0]
    got = [tuple(r) for r in topk.vector_top_k(table(spark, enumerate(rows))).orderBy("query_id", "rank").select("query_id", "vec_id", "score").collect()]
    whole = [[int(np.floor(x * 1024)) if abs(x) < 1e15 else int(x) * 1024 for x in v] for v in np.array(rows, np.float32).astype(float)]
    want = []
    for q in range(0, 320, 100):
        best = sorted((-sum(a * b for a, b in zip(whole[q], whole[c], strict=True)), c) for c in range(320) if c != q)[:10]
        want += [(q, c, min(2**63 - 1, -s)) for s, c in best]
    assert got == want and got[30][1:] == (13, 2**63 - 1)


def test_sortable_bytes():
    values = sorted([0, 1, -1, 255, 256, -255, -256, 2**63, -(2**63), 10**80, -(10**80), 10**80 + 1])
    assert sorted(values, key=topk.sortable) == values


def test_top_k_edges(spark):
    assert topk.vector_top_k(table(spark, [])).count() == 0
    few = topk.vector_top_k(table(spark, [(0, [1, 1]), (3, [2, 0]), (5, [0, 0]), (None, [1, 1]), (7, [1, 2, 3])])).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in few] == [(7, 3 * 1024 * 1024), (3, 2 * 1024 * 1024), (5, 0)]
    assert topk.vector_top_k(table(spark, [(0, [1, 1]), (0, [1, 1])])).count() == 0


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)] + [(100, 101)], [(5, 1), (6, 5), (6, 2), (None, 3)]])
def test_components(spark, edges):
    got = components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "test"))
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    nodes = sorted({x for e in real for x in e})
    linked = set(real) | {(b, a) for a, b in real}
    want = brute_components(nodes, nodes, lambda a, b: (a, b) in linked)
    assert {r.node: r.root for r in got.collect()} == dict(zip(nodes, want, strict=True))
