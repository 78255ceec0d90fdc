"""What has no bound, and what is told apart: long chains, blocks of candidates, typed ranges, list items, files."""

import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandweave import cli, vocab
from strandweave.operators import hierarchy, ledger, lint, shacl, vectors
from strandweave.plans import materialize
from strandweave.plans.suggest import model_embedder
from strandweave.sources import ingest, shapes
from strandweave.sources.turtle import parse


def test_chains_of_any_length_and_cycles(spark):
    chain = [(f"c{i}", f"c{i + 1}") for i in range(150)] + [("x", "c3"), ("c150", None)]
    got = {(r.cls, r.ancestor): r.dist for r in hierarchy.closure(spark.createDataFrame(chain, "cls string, parent string")).collect()}
    want = {(f"c{i}", f"c{j}"): j - i for i in range(151) for j in range(i, 151)} | {("x", f"c{j}"): j - 2 for j in range(3, 151)} | {("x", "x"): 0}
    assert got == want
    ring = [(f"r{i}", f"r{(i + 1) % 5}") for i in range(5)] + [("r0", "r0"), ("a", "b"), ("a", "c"), ("b", "c")]
    got = {(r.cls, r.ancestor): r.dist for r in hierarchy.closure(spark.createDataFrame(ring, "cls string, parent string")).collect()}
    assert got == {(f"r{i}", f"r{j}"): (j - i) % 5 for i in range(5) for j in range(5)} | {("a", "a"): 0, ("b", "b"): 0, ("c", "c"): 0, ("a", "b"): 1, ("a", "c"): 1, ("b", "c"): 1}
    assert hierarchy.closure(spark.createDataFrame([], "cls string, parent string")).count() == 0


@pytest.mark.parametrize("block", [1 << 20, 700])
def test_candidates_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BROADCAST_BYTES", block)
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(7, 4)), rng.normal(size=(30, 4))
    a[3], b[5], b[6], b[20] = 0, b[4], b[4], 0
    sa, sb = rng.integers(0, 2, (7, 3)).astype(float), rng.integers(0, 2, (30, 3)).astype(float)
    left = spark.createDataFrame([(f"s{i}", v.tolist(), s.tolist()) for i, (v, s) in enumerate(zip(a, sa, strict=True))], "subject_id string, vector array<double>, structure array<double>")
    right = spark.createDataFrame([(f"t{i}", i, v.tolist(), s.tolist()) for i, (v, s) in enumerate(zip(b, sb, strict=True))], "object_id string, object_pos int, vector array<double>, structure array<double>")
    for use, weight in ((["vector"], 0.0), (["vector", "structure"], 0.3)):
        got = vectors.best_candidates(left.select("subject_id", *use), right.select("object_id", "object_pos", *use), 4, 0.1, weight)
        want = vectors.rank(vectors.scores(left.select("subject_id", *use), right.select("object_id", "object_pos", *use), weight).withColumn("score", F.round("score", 12)), 4, 0.1)
        rows = lambda df: sorted((r.subject_id, r.rank, r.object_id, round(r.score, 5)) for r in df.collect())
        assert rows(got) == rows(want) and got.count()


def _graph(spark, *rows):
    full = [("n:s", vocab.RDF_TYPE, "n:C", "iri", None, None)] + [("n:s", p, o, kind, t, None) for p, o, kind, t in rows]
    return spark.createDataFrame(full, vocab.TRIPLE)


def test_ranges_are_compared_in_their_type(spark):
    date, whole = f"{vocab.XSD}dateTime", f"{vocab.XSD}integer"
    graph = _graph(spark, ("n:at", "2024-05-01T00:00:00", "literal", date), ("n:at", "2019-12-31T23:59:59", "literal", date), ("n:day", "2020-01-02", "literal", f"{vocab.XSD}date"), ("n:n", "9007199254740993", "literal", whole), ("n:n", "1e300", "literal", None), ("n:n", "x", "literal", None), ("n:n", "n:7", "iri", None))
    base = {"shape": "S", "target_class": "n:C"}
    rules = [base | {"path": "n:at", "kind": "minInclusive", "param": "2020-01-01T00:00:00"}, base | {"path": "n:day", "kind": "maxExclusive", "param": "2020-01-02"}, base | {"path": "n:n", "kind": "maxInclusive", "param": "9007199254740992"}]
    got = {(r.path, r.value) for r in shacl.findings(graph, shacl.constraints(spark, rules)).collect()}
    assert got == {("n:at", "2019-12-31T23:59:59"), ("n:day", "2020-01-02"), ("n:n", "9007199254740993"), ("n:n", "1e300"), ("n:n", "x"), ("n:n", "n:7")}


def test_list_items_are_told_apart_by_kind(spark):
    text = "@prefix sh: <http://www.w3.org/ns/shacl#> . <n:S> a sh:NodeShape ; sh:targetClass <n:C> ; sh:property [ sh:path <n:p> ; sh:in ( <http://x/a> \"b\" ) ] ."
    rules = shapes.constraint_rows(parse(text))
    assert shapes.constraint_rows(parse(shapes.to_turtle(rules)))[0]["items"] == rules[0]["items"] == ["<http://x/a>", "b"]
    graph = _graph(spark, ("n:p", "http://x/a", "iri", None), ("n:p", "http://x/a", "literal", None), ("n:p", "b", "literal", None), ("n:p", "b", "iri", None))
    found = shacl.findings(graph, shacl.constraints(spark, rules))
    assert found.count() == 2 and {r.value for r in found.collect()} == {"http://x/a", "b"}


def test_a_finding_carries_its_conversion(spark):
    from .test_ledger import _row

    rows = _row(spark, subject_label="hoyde_m", object_label="hasAltitudeFt", subject_id="src:hoyde_m", object_id="mc:hasAltitudeFt")
    (r,) = lint.unit_findings(rows).where("rule = 'unit_conversion_required'").collect()
    assert r.suggestion.fn == "ConvertMToFT" and r.suggestion.multiplier == 3.28084 and r.suggestion.offset is None


def test_profile_counts_exactly(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("a"), F.when(F.col("id") == 7, 8).otherwise(F.col("id")).cast("string").alias("b"), F.when(F.col("id") != 7, F.col("id")).cast("string").alias("c"))
    found = ingest.profile(df)
    assert [found[c]["unique"] for c in "abc"] == [True, False, False] and found["a"]["range"] == "integer"


def test_lines_split_and_cells_do_not(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,v\n1,"x\ny"\n2,z\n')
    assert materialize.scan(spark, str(tmp_path / "a.csv"), "csv").count() == 2
    (tmp_path / "b.json").write_text('{"k": 1}\n{"k": 2}\n')
    rows = materialize.scan(spark, str(tmp_path / "b.json"), "json", lines=True)
    assert sorted(r.k for r in rows.collect()) == ["1", "2"]


def test_refused_rows_are_counted(spark):
    from .test_ledger import EXACT, log

    many = log(spark, *[(f"s{i}", "x", vocab.HC, EXACT, 1) for i in range(25)])
    with pytest.raises(ledger.LedgerError, match="and 5 more"):
        ledger.append(many, spark.createDataFrame([], vocab.LOG), "accreditor")


def test_outputs_and_models(tmp_path, monkeypatch, capsys):
    assert [[str(t) for _, t in cli._targets(fs, None)] for fs in (["a/x.csv"], ["a/x.csv", "y.csv"])] == [["-"], ["x.linkml.yaml", "y.linkml.yaml"]]
    assert [str(t) for _, t in cli._targets(["a/x.csv", "y.xsd"], f"{tmp_path}/")] == [f"{tmp_path}/x.linkml.yaml", f"{tmp_path}/y.linkml.yaml"]
    for files, out in ((["x.csv", "y.csv"], "z.yaml"), (["x.csv", "a/x.xsd"], f"{tmp_path}/"), (["x.csv", "y.csv"], "-")):
        with pytest.raises(cli.UsageError):
            cli._targets(files, out)
    monkeypatch.setattr("sys.stdin", io.StringIO("told"))
    path = cli._input("-")
    with open(path) as f:
        assert f.read() == "told" and cli._input("x") == "x"
    monkeypatch.setattr(cli, "LOUD", 0)
    cli._say("quiet")
    cli._say("always", 0)
    assert capsys.readouterr().err == "always\n"
    with pytest.raises(ValueError, match="does not load"):
        model_embedder("no-such-model")
