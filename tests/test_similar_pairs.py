"""Similar pairs by blocks of matrices, against plain numpy."""

import numpy as np
import pytest

from strandweave import queries
from strandweave.operators import vectors


@pytest.mark.parametrize(("block", "rows", "cells"), [(1 << 20, 2048, 1 << 20), (900, 4, 7)])
def test_similar_pairs_equal_brute_force(spark, monkeypatch, block, rows, cells):
    monkeypatch.setattr(vectors, "BLOCK_BYTES", block)
    monkeypatch.setattr(vectors, "SOURCE_ROWS", rows)
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(23, 4)), rng.normal(size=(41, 4))
    a[3], a[4], b[5:12], b[20] = 0, a[2], a[2], 0
    sa, sb = (rng.integers(0, 2, (n, 3)).astype(float) for n in (23, 41))
    left = spark.createDataFrame([(f"s{i}", v.tolist(), s.tolist()) for i, (v, s) in enumerate(zip(a, sa, strict=True))] + [("null", None, [0.0] * 3), ("holds null", [1.0, None, 1.0, 1.0], [0.0] * 3)], "subject_id string, vector array<double>, structure array<double>")
    right = spark.createDataFrame([(f"t{i}", i, v.tolist(), s.tolist()) for i, (v, s) in enumerate(zip(b, sb, strict=True))], "object_id string, object_pos int, vector array<float>, structure array<double>")
    b = b.astype(np.float32).astype(float)
    one = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), vectors.LEAST_NORM)
    for use, weight in ((["vector"], 0.0), (["vector", "structure"], 0.3)):
        score = (1 - weight) * one(a) @ one(b).T + weight * one(sa) @ one(sb).T
        for least in (0.25, -1.0):
            with monkeypatch.context() as m:
                m.setattr(vectors, "CELLS", cells)
                got = vectors.similar_pairs(left.select("subject_id", *use), right.select("object_id", "object_pos", *use), least, weight, 4).collect()
            want = {(f"s{i}", f"t{j}"): round(score[i, j], 4) for i, j in zip(*np.nonzero(np.round(score, 4) >= least), strict=True)}
            assert len(got) == len(want) > 0 and {(r.subject_id, r.object_id): r.score for r in got} == pytest.approx(want, abs=1e-9)


def test_vectors_of_different_lengths_are_refused(spark):
    left = spark.createDataFrame([("s", [1.0, 2.0])], "subject_id string, vector array<double>")
    right = spark.createDataFrame([("t", 1, [1.0])], "object_id string, object_pos int, vector array<double>")
    with pytest.raises(ValueError, match="dimensions differ"):
        vectors.similar_pairs(left, right)


def test_no_row_for_pairs_that_are_not_similar(spark, tmp_path):
    rows = [(i, i, [1.0, float(i % 7)]) for i in range(40)]
    spark.createDataFrame(rows, "vec_id long, label long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = queries.QUERIES["cosine_pairs"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
    assert {(r.subject_id, r.object_id) for r in found.collect()} == {(f"s:{i}", f"t:{j}") for i in range(0, 40, 10) for j in range(40) if j % 10 and (1 + (i % 7) * (j % 7)) / np.sqrt((1 + (i % 7) ** 2) * (1 + (j % 7) ** 2)) >= 0.3}


def test_no_vectors_no_pairs(spark):
    left = spark.createDataFrame([("s", [1.0])], "subject_id string, vector array<double>")
    right = spark.createDataFrame([], "object_id string, object_pos int, vector array<double>")
    assert vectors.similar_pairs(left, right).count() == 0
