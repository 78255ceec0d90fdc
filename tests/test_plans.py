"""From mapping rows to triples, JSON-LD and findings, on a small radar example of our own."""

import json

import pytest
from pyspark.sql import functions as F

from strandweave import vocab
from strandweave.functions.registry import FunctionLibrary
from strandweave.operators import hierarchy, shacl, translate
from strandweave.plans import mapping, materialize, yarrrml
from strandweave.plans.suggest import prefixed, suggest
from strandweave.sources import shapes
from strandweave.sources.model import Schema
from strandweave.sources.turtle import parse

SOURCE = Schema("radar", classes={"Obs": {"slots": ["track", "lat", "lon", "height_m", "speed_kmh", "bearing"]}}, slots={"track": {"range": "string", "identifier": True}, "lat": {"range": "float"}, "lon": {"range": "float"}, "height_m": {"range": "float"}, "speed_kmh": {"range": "integer"}, "bearing": {"range": "integer"}})
SOURCE.stamp("csv")
TARGET = Schema(
    "mc", id="https://example.org/mc", classes={"Entity": {"slots": ["hasLat", "hasLon", "hasHeightFt"]}, "Track": {"is_a": "Entity", "slots": ["hasSpeed", "hasBearing", "hasName"]}, "Air": {"is_a": "Track", "slots": []}, "Report": {"slots": ["hasNote"]}},
    slots={"hasLat": {"range": "double"}, "hasLon": {"range": "double"}, "hasHeightFt": {"range": "double"}, "hasSpeed": {"range": "double"}, "hasBearing": {"range": "double"}, "hasName": {"range": "string", "required": True}, "hasNote": {"range": "string"}},
)


def rows(spark, *told):
    full = []
    for i, t in enumerate(told):
        base = dict.fromkeys(vocab.LOG.fieldNames()) | {"predicate_id": "skos:exactMatch", "mapping_justification": vocab.HC, "confidence": 0.9, "subject_label": "", "object_label": "", "log_seq": i, "record_id": f"r{i}"}
        s, o, extra = (*t, {})[:3]
        full.append(tuple((base | {"subject_id": s, "object_id": o} | extra).values()))
    return spark.createDataFrame(full, vocab.LOG)


def approved(spark):
    pair = {"mapping_group_id": "g", "composition_expr": "[{lat},{lon}]"}
    return rows(
        spark, ("radar:Obs", "mc:Track"), ("radar:lat", "mc:hasLat"), ("radar:lon", "mc:hasLon"), ("radar:height_m", "mc:hasHeightFt", {"conversion_function": "fns:meterToFoot"}),
        ("radar:speed_kmh", "mc:hasSpeed", {"predicate_id": "skos:closeMatch", "subject_datatype": "integer", "object_datatype": "double"}), ("radar:lat", "mc:hasLat", pair), ("radar:lon", "mc:hasLat", pair),
        ("radar:bearing", "mc:hasBearing", {"predicate_id": "skos:narrowMatch"}), ("radar:bearing", "mc:hasName", {"predicate_id": vocab.DIFFERENT}), ("other:x", "mc:y"), ("radar:bearing", "mc:hasBearing", {"mapping_justification": vocab.MMC}),
    )


def data(spark):
    return spark.createDataFrame([("T 1", "60.1", "11.1", "100", "390", "045"), ("T2", "59.0", None, "x", "400", "100"), ("T2", "59.0", None, "x", "400", "100")], "track string, lat string, lon string, height_m string, speed_kmh string, bearing string")


def test_plan_and_coverage(spark):
    plan, coverage = mapping.compile_plan(approved(spark), SOURCE, TARGET, FunctionLibrary.builtins())
    (track,) = plan.classes
    assert (track.name, track.source, track.subject) == ("Track", "Obs", "https://example.org/mc/Track/$(track)")
    found = {s.name: s for s in track.slots}
    assert set(found) == {"hasLat", "hasLon", "hasHeightFt", "hasSpeed"}
    assert found["hasLat"].expr == "[{lat},{lon}]" and found["hasHeightFt"].function == "fns:meterToFoot"
    # negative rows are in no bucket of the stages, so they count until the last
    assert (coverage.total, coverage.after_prefix, coverage.after_predicate, coverage.accepted) == (11, 10, 9, 7)
    assert coverage.unmapped_required == ["Track.hasName"]
    assert len(coverage.datatype_warnings) == 1 and coverage.composite_groups[0]["resolved"]
    assert mapping.MappingPlan.from_json(plan.to_json()) == plan


def test_plan_errors(spark):
    lib = FunctionLibrary.builtins()
    head = ("radar:Obs", "mc:Track")
    cases = [
        [("other:x", "mc:y")], [head, ("radar:lat", "mc:Air")], [head, ("radar:nope", "mc:hasLat")], [head, ("radar:lat", "mc:nope")], [head, ("radar:lat", "mc:hasNote")], [("radar:lat", "mc:hasSpeed")],
        [head, ("radar:lat", "mc:hasLat", {"conversion_function": "fns:none"})], [head, ("radar:lat", "mc:hasLat", {"mapping_group_id": "g"})],
        [head, ("radar:lat", "mc:hasLat", {"mapping_group_id": "g", "composition_expr": "{a}"}), ("radar:lon", "mc:hasLat", {"mapping_group_id": "g", "composition_expr": "{b}"})],
    ]
    for case in cases:
        with pytest.raises(mapping.PlanError):
            mapping.compile_plan(rows(spark, *case), SOURCE, TARGET, lib)
    plan, coverage = mapping.compile_plan(rows(spark, head, ("radar:nope", "mc:hasLat")), SOURCE, TARGET, lib, force=True)
    assert coverage.unresolved_subjects[0]["curie"] == "radar:nope" and plan.classes[0].slots == []


def test_later_rejections_can_count(spark):
    told = rows(spark, ("radar:Obs", "mc:Track"), ("radar:lat", "mc:hasLat"), ("radar:lat", "mc:hasLat", {"predicate_id": vocab.DIFFERENT}))
    told = told.withColumn("mapping_date", F.expr("timestamp_seconds(log_seq)"))
    for latest, want in ((False, ["hasLat"]), (True, [])):
        plan, _ = mapping.compile_plan(told, SOURCE, TARGET, latest_only=latest)
        assert [s.name for s in plan.classes[0].slots] == want


def test_triples_and_jsonld(spark):
    plan, _ = mapping.compile_plan(approved(spark), SOURCE, TARGET, FunctionLibrary.builtins())
    got = materialize.materialize(plan, data(spark))
    rows_ = {(r.s.rsplit("/", 1)[-1], r.p.rsplit("/", 1)[-1].rsplit("#", 1)[-1], r.o) for r in got.collect()}
    assert got.count() == len(rows_) == 7
    assert ("T%201", "hasHeightFt", "328.084") in rows_ and ("T%201", "hasLat", "[60.1,11.1]") in rows_
    assert ("T2", "hasHeightFt", "x") not in rows_ and ("T2", "hasSpeed", "400") in rows_
    doc = json.loads(materialize.jsonld_document(got, plan))
    node = next(n for n in doc["@graph"] if n["@id"].endswith("T2"))
    assert node["@type"] == "mc:Track" and node["mc:hasSpeed"] == {"@value": "400", "@type": "xsd:double"}
    assert doc["@context"]["hasSpeed"] == {"@id": "mc:hasSpeed", "@type": "xsd:double"}
    table = materialize.typed_table(plan, plan.classes[0], data(spark)).where("subject like '%T2'").first()
    assert table.hasSpeed == 400.0 and table.hasHeightFt is None


def test_yarrrml_round_trip(spark):
    plan, _ = mapping.compile_plan(approved(spark), SOURCE, TARGET, FunctionLibrary.builtins())
    again = yarrrml.from_yarrrml(yarrrml.to_yarrrml(plan))
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(materialize.materialize(again, data(spark)).na.fill("")) == key(materialize.materialize(plan, data(spark)).na.fill(""))
    with pytest.raises(ValueError):
        yarrrml.from_yarrrml("mappings: {}")


def test_expressions(spark):
    df = spark.createDataFrame([("1,2",)], "position string")
    part = lambda t: df.select(materialize.expression(t, df).alias("x")).first().x
    assert part('record["position"].split(",")[1]') == "2" and part("{position}") == "1,2" and part("[{position}]") == "[1,2]"
    for bad in ("eval(x)", "{nope}"):
        with pytest.raises(ValueError):
            part(bad)


def test_nested_and_multivalued(spark, tmp_path):
    path = tmp_path / "x.json"
    path.write_text(json.dumps({"items": [{"id": "a", "pos": {"lat": 1.5}, "tags": ["u", "v"]}, {"id": "b"}]}))
    df = materialize.scan(spark, str(path), "json", iterator="items")
    plan = mapping.MappingPlan("x", "x", "json", {"mc": "http://mc/"}, "mc", [mapping.ClassRule("A", "A", "http://s/$(id)", [mapping.SlotRule("lat", "$.pos.lat", datatype="double"), mapping.SlotRule("tag", "tags")])])
    assert sorted((r.p, r.o) for r in materialize.materialize(plan, df).where("p <> :t".replace(":t", f"'{vocab.RDF_TYPE}'")).collect()) == [("http://mc/lat", "1.5"), ("http://mc/tag", "u"), ("http://mc/tag", "v")]


SHAPES = """@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix ex: <http://ex/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> . @prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> .
ex:S a sh:NodeShape ; sh:targetClass ex:A ; sh:closed true ; sh:ignoredProperties ( rdf:type ) ;
  sh:property [ sh:path ex:n ; sh:minCount 1 ; sh:maxCount 1 ; sh:datatype xsd:integer ; sh:minInclusive 0 ; sh:maxExclusive 360 ; sh:message "a bearing" ] ,
    [ sh:path ex:k ; sh:in ( "u" "v" ) ] , [ sh:path ex:r ; sh:class ex:B ; sh:nodeKind sh:BlankNodeOrIRI ] ."""
DATA = """@prefix ex: <http://ex/> . ex:good a ex:A ; ex:n 10 ; ex:k "u" ; ex:r ex:b . ex:b a ex:B .
ex:bad a ex:A ; ex:n 400 , 7 ; ex:k "w" ; ex:r ex:c ; ex:z 1 . ex:none a ex:A ; ex:n "x" ; ex:r "text" ."""


def test_shapes(spark, tmp_path):
    (tmp_path / "s.ttl").write_text(SHAPES)
    told = shapes.load(tmp_path)
    rules = shacl.constraints(spark, told)
    found = shacl.findings(parse(DATA).table(spark), rules)
    got = sorted((r.focus.rsplit("/", 1)[-1], r.constraint) for r in found.collect())
    assert got == sorted([("bad", "maxCount"), ("bad", "maxExclusive"), ("bad", "in"), ("bad", "class"), ("bad", "closed"), ("none", "datatype"), ("none", "minInclusive"), ("none", "maxExclusive"), ("none", "class"), ("none", "nodeKind")])
    assert {r.message for r in found.where("constraint = 'maxCount'").collect()} == {"a bearing"}
    conforms, _ = shacl.validate(parse(DATA.split("ex:bad")[0]).table(spark), rules)
    assert conforms
    again = shapes.constraint_rows(parse(shapes.to_turtle(told)))
    assert sorted(r["kind"] for r in again) == sorted(r["kind"] for r in told)
    with pytest.raises(ValueError):
        shapes.load(tmp_path / "nothing")


def test_subclass_focus_and_generation(spark):
    graph = parse("@prefix ex: <http://ex/> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . ex:A2 rdfs:subClassOf ex:A . ex:x a ex:A2 .").table(spark)
    rules = shacl.constraints(spark, [{"shape": "s", "target_class": "http://ex/A", "path": "http://ex/n", "kind": "minCount", "param": 1}])
    assert shacl.findings(graph, rules).count() == 1
    schema = Schema("s", classes={"A": {"slots": ["n"]}, "M": {"mixin": True, "slots": ["m"]}, "B": {"is_a": "A", "mixins": ["M"], "slots": ["a"]}}, slots={"n": {"range": "integer"}, "m": {"range": "string", "multivalued": True}, "a": {"range": "A"}})
    told = shacl.generate(schema, {"A": ["unit:M"]})
    kinds = {(r["shape"].rsplit("/", 1)[-1], (r.get("path") or "").rsplit("/", 1)[-1], r["kind"]) for r in told}
    assert ("B", "n", "maxCount") in kinds and ("B", "a", "class") in kinds and ("B", "m", "maxCount") not in kinds
    assert not any(s == "M" for s, _, _ in kinds) and ("A", "hasUnit", "in") in kinds


def test_hierarchy(spark):
    edges = spark.createDataFrame([("A", None), ("B", "A"), ("C", "B"), ("X", None)], "cls string, parent string")
    closed = hierarchy.closure(edges)
    want = spark.createDataFrame([("A",), ("B",), ("C",), ("X",)], "cls string")
    near = {r.cls: r.nearest for r in hierarchy.nearest_mapped(want, want.where("cls = 'B'"), closed).collect()}
    assert near == {"A": "B", "B": "B", "C": "B", "X": None}
    classes = edges
    slots = spark.createDataFrame([("s", None, True, False)], "slot string, parent string, required boolean, multivalued boolean")
    used = spark.createDataFrame([("A", "s"), ("B", "s")], "cls string, slot string")
    got = {r.node: [r.f0, r.f1, r.f2, r.f3, r.f4] for r in hierarchy.structural_features(classes, slots, used).collect()}
    assert got["C"] == [1, 1, 0, 0, 0] and got["B"][1] == 0.5 and got["s"] == [0, 0, 1, 0, 0.5]
    loop = spark.createDataFrame([("A", "B"), ("B", "A")], "cls string, parent string")
    assert hierarchy.closure(loop).count() == 4
    induced = hierarchy.induced_slots(used, closed)
    assert {(r.cls, r.slot) for r in induced.collect()} == {("A", "s"), ("B", "s"), ("C", "s")}


def test_suggestions(spark):
    log = spark.createDataFrame([], vocab.LOG)
    got = suggest(spark, SOURCE, TARGET, log, top_k=2, policies={"float:double": "grel:math_round"})
    assert got.columns == vocab.MAPPING_COLUMNS and got.count() == 2 * 7
    best = got.where("subject_id = 'radar:bearing'").orderBy(F.desc("confidence")).first()
    assert best.object_id == "mc:hasBearing" and best.mapping_justification == vocab.COMPOSITE
    assert suggest(spark, SOURCE, TARGET, log, structural_weight=0.0).first().mapping_justification == vocab.LEXICAL
    done = rows(spark, ("radar:bearing", "mc:hasBearing")).select(*log.columns)
    assert suggest(spark, SOURCE, TARGET, done).where("subject_id = 'radar:bearing'").count() == 0
    with pytest.raises(ValueError):
        suggest(spark, Schema("empty"), TARGET, log)
    assert prefixed(["a"], "x/e5-large", True) == ["query: a"] and prefixed(["a"], "plain", False) == ["a"]


def test_translation(spark):
    nodes = spark.createDataFrame([("n", "Höhe", None, ["x"]), ("m", "Höhe", "Tempo", [])], "name string, title string, description string, aliases array<string>")
    seen = []
    out = translate.translate(nodes, "DE", lambda t: seen.extend(t) or [x.upper() for x in t])
    assert sorted(seen) == ["Höhe", "Tempo"] and out.where("name = 'n'").first().aliases == ["Höhe", "x"]
    assert translate.translate(nodes, "en-GB", None) is nodes
    with pytest.raises(translate.TranslationError):
        translate.translate(nodes, "DE", lambda t: [])


def test_sql_over_triples(spark):
    got = materialize.query(parse(DATA).table(spark), "SELECT s FROM triples WHERE p = :p AND o = :o", p="http://ex/k", o="u' OR '1'='1")
    assert got.count() == 0
