"""No join of the shapes sends a graph to every executor, whatever its estimated size."""

import pytest

from strandweave import vocab
from strandweave.operators import shacl

BASE = {"shape": "S", "target_class": "n:C"}


def _broadcast_scans(df) -> int:
    """Scans of files below a broadcast in the plan that a query begins with."""

    def count(node, below: bool) -> int:
        below = below or node.nodeName().startswith("BroadcastExchange")
        kids = node.children()
        own = below and node.nodeName().startswith("Scan parquet")
        return own + sum(count(kids.apply(i), below) for i in range(kids.size()))

    plan = df._jdf.queryExecution().executedPlan()
    return count(plan.initialPlan() if plan.nodeName().startswith("Adaptive") else plan, False)


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    """Two members of n:C and one of n:D in a file far below the bound for broadcasts."""
    path = f"file://{tmp_path_factory.mktemp('graph')}/graph.parquet"
    rows = [("n:a", vocab.RDF_TYPE, "n:C", "iri"), ("n:b", vocab.RDF_TYPE, "n:C", "iri"), ("n:d", vocab.RDF_TYPE, "n:D", "iri")]
    rows += [("n:a", "n:to", "n:d", "iri"), ("n:b", "n:to", "n:a", "iri"), ("n:b", "n:to", "n:x", "iri"), ("n:d", "n:to", "n:y", "iri")]
    rows += [("n:a", "n:v", "1", "literal"), ("n:a", "n:v", "2", "literal"), ("n:b", "n:v", "3", "literal"), ("n:d", "n:v", "4", "literal")]
    spark.createDataFrame([(*r, None, None) for r in rows], vocab.TRIPLE).write.parquet(path)
    return spark.read.parquet(path)


def _found(spark, graph, *rules):
    found = shacl.findings(graph, shacl.constraints(spark, [BASE | r for r in rules]))
    assert _broadcast_scans(found) == 0
    return sorted((r.focus, r.path, r.constraint, r.value) for r in found.collect())


def test_class_broadcasts_no_graph(spark, graph):
    assert _found(spark, graph, {"path": "n:to", "kind": "class", "param": "n:D"}) == [("n:b", "n:to", "class", "n:a"), ("n:b", "n:to", "class", "n:x")]


def test_has_value_broadcasts_no_graph(spark, graph):
    rules = [{"path": "n:v", "kind": "hasValue", "param": "2"}, {"path": "n:to", "kind": "hasValue", "param": "n:x"}]
    assert _found(spark, graph, *rules) == [("n:a", "n:to", "hasValue", "n:x"), ("n:b", "n:v", "hasValue", "2")]


def test_closed_broadcasts_no_graph(spark, graph):
    rules = [{"kind": "closed", "param": "true", "items": [vocab.RDF_TYPE]}, {"path": "n:to", "kind": "hasValue", "param": "n:x"}]
    assert [r for r in _found(spark, graph, *rules) if r[2] == "closed"] == [("n:a", "n:v", "closed", "1"), ("n:a", "n:v", "closed", "2"), ("n:b", "n:v", "closed", "3")]


def test_report_broadcasts_no_graph(spark, graph):
    path = {"path": "n:v"}
    rules = [path | {"kind": "maxCount", "param": 1}, {"path": "n:w", "kind": "minCount", "param": 1}, path | {"kind": "in", "items": ["1", "2"]}, path | {"kind": "maxInclusive", "param": 1, "severity": "Warning"}]
    rules += [{"path": "n:to", "kind": "class", "param": "n:C"}, path | {"kind": "hasValue", "param": "3"}, {"kind": "closed", "param": "true", "items": [vocab.RDF_TYPE]}]
    want = [("n:a", "n:to", "class", "n:d"), ("n:a", "n:v", "hasValue", "3"), ("n:a", "n:v", "maxCount", "2"), ("n:a", "n:v", "maxInclusive", "2"), ("n:a", "n:w", "minCount", "0")]
    want += [("n:b", "n:to", "class", "n:x"), ("n:b", "n:v", "in", "3"), ("n:b", "n:v", "maxInclusive", "3"), ("n:b", "n:w", "minCount", "0")]
    assert _found(spark, graph, *rules) == want
    report = shacl.report(shacl.findings(graph, shacl.constraints(spark, [BASE | r for r in rules])))
    assert _broadcast_scans(report) == 0 and tuple(report.first()) == (7, 2, 0, False)
