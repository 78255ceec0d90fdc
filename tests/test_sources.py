"""Schemas from every format, Turtle, and the command line."""

import json

import pytest

from strandweave import cli, vocab
from strandweave.sources import ingest
from strandweave.sources.model import Schema
from strandweave.sources.turtle import TurtleError, parse, read_ntriples, write_ntriples


def test_formats(tmp_path):
    for name, want in (("a.json", "json-schema"), ("a.xsd", "xsd"), ("a.csv", "csv"), ("a.tsv", "tsv"), ("a.ttl", "rdfs"), ("a.owl", "rdfs")):
        assert ingest.detect_format(name) == want
    api = tmp_path / "a.yaml"
    api.write_text("openapi: 3.0.0\n")
    assert ingest.detect_format(api) == "openapi"
    api.write_text("name: x\n")
    for bad in (api, tmp_path / "a.txt"):
        with pytest.raises(ValueError):
            ingest.detect_format(bad)


def test_csv_edge_cases(spark, tmp_path):
    path = tmp_path / "edge.csv"
    path.write_bytes('﻿track_id,location,note,reading,"radar type",ok,when\nT1,"Oslo, N","two\nlines",1.5,a,true,2024-01-01T10:00:00Z\nT2,Bergen,x,,a,false,2024-01-02T10:00:00Z\n'.encode())
    got = ingest.ingest(spark, path)
    assert list(got.slots) == ["track_id", "location", "note", "reading", "radar type", "ok", "when"]
    assert [got.slots[s]["range"] for s in got.slots] == ["string", "string", "string", "float", "string", "boolean", "datetime"]
    assert got.slots["track_id"]["identifier"] and got.source_format == "csv" and got.path("radar type") == "radar type"
    assert set(got.classes["Observation"]["unique_keys"]) == {"location_key", "note_key", "ok_key", "when_key"}
    (tmp_path / "latin.csv").write_bytes(b"a\nr\xe6v\n")
    with pytest.raises(ValueError):
        ingest.ingest(spark, tmp_path / "latin.csv")
    (tmp_path / "t.tsv").write_text("id\tn\na\t1\nb\t2\n")
    assert ingest.ingest(spark, tmp_path / "t.tsv").slots["n"]["range"] == "integer"


def test_json_formats(spark, tmp_path):
    doc = {"title": "Plan", "type": "object", "required": ["id"], "properties": {"id": {"type": "string"}, "area": {"type": "object", "properties": {"zone": {"type": "object", "properties": {"n": {"type": "integer"}}}}}, "tracks": {"type": "array", "items": {"$ref": "#/definitions/Track"}}}, "definitions": {"Track": {"type": "object", "properties": {"seen": {"type": "string", "format": "date-time"}, "level": {"enum": ["a", "b"]}}}}, "oneOf": [{"properties": {"kind": {"type": "string"}}}, {"properties": {"size": {"type": "number"}}}]}
    path = tmp_path / "plan.json"
    path.write_text(json.dumps(doc))
    got = ingest.ingest(spark, path)
    assert set(got.classes) == {"Plan", "Area", "Zone", "Track"}
    assert {"kind", "size", "n"} <= set(got.slots) and got.slots["id"]["required"] and got.slots["tracks"] == {"multivalued": True, "range": "Track", "annotations": {"json_path": "$.tracks"}}
    assert got.slots["seen"]["range"] == "datetime" and got.enums["LevelEnum"] == ["a", "b"] and got.path("id") == "$.id"
    path.write_text('{"a": 1,}')
    with pytest.raises(ValueError):
        ingest.ingest(spark, path)
    path.write_text(json.dumps([{"id": "a", "pos": {"lat": 1.5}}, {"id": "b", "tags": [{"code": "x"}]}]))
    sample = ingest.ingest(spark, path, "json-sample", "sample")
    assert set(sample.classes) == {"Sample", "Pos", "TagsItem"} and sample.slots["lat"]["range"] == "float"
    api = tmp_path / "c2.yaml"
    api.write_text("openapi: 3.0.0\ncomponents:\n  schemas:\n    AirTrack:\n      type: object\n      required: [speed_kts]\n      properties:\n        speed_kts: {type: number}\n")
    assert ingest.ingest(spark, api).slots["speed_kts"]["required"]
    api.write_text("openapi: 3.0.0\n")
    with pytest.raises(ValueError):
        ingest.ingest(spark, api)


XSD = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:complexType name="Base"><xs:sequence><xs:element name="id" type="xs:string"/><xs:element name="at" type="xs:dateTime"/></xs:sequence><xs:attribute name="source" type="xs:string" use="required"/></xs:complexType>
<xs:complexType name="Radar"><xs:complexContent><xs:extension base="Base"><xs:sequence><xs:element name="freq" type="xs:decimal" minOccurs="0" maxOccurs="9"/><xs:choice><xs:element name="a" type="xs:int"/><xs:element name="b" type="xs:string"/></xs:choice></xs:sequence></xs:extension></xs:complexContent></xs:complexType></xs:schema>"""


def test_xsd_and_rdfs(spark, tmp_path):
    path = tmp_path / "t.xsd"
    path.write_text(XSD)
    got = ingest.ingest(spark, path)
    base, radar = got.classes["Base"], got.classes["Radar"]
    assert radar["is_a"] == "Base" and radar["attributes"]["freq"] == {"range": "decimal", "multivalued": True}
    assert base["attributes"]["at"]["range"] == "datetime" and base["attributes"]["source"]["required"] and "required" not in radar["attributes"]["a"]
    assert got.source_format == "xml" and not got.slots and set(got.induced("Radar")) == {"freq", "a", "b", "id", "at", "source"}
    path.write_text(XSD[:300])
    with pytest.raises(ValueError):
        ingest.ingest(spark, path)
    onto = tmp_path / "o.ttl"
    onto.write_text("@prefix ex: <http://ex/> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> . ex:A a rdfs:Class . ex:B a rdfs:Class ; rdfs:subClassOf ex:A ; rdfs:label \"Bee\" . ex:n a rdf:Property ; rdfs:domain ex:B ; rdfs:range xsd:dateTime . ex:r a rdf:Property ; rdfs:domain ex:A ; rdfs:range ex:B .")
    got = ingest.ingest(spark, onto)
    assert got.classes["B"] == {"class_uri": "http://ex/B", "title": "Bee", "slots": ["n"], "is_a": "A"} and got.slots["n"]["range"] == "datetime" and got.slots["r"]["range"] == "B"
    assert got.source_format is None


def test_schema_text_and_collisions(spark, tmp_path):
    a = Schema("a", classes={"X": {"slots": ["s"]}}, slots={"s": {"range": "integer", "annotations": {"csv_column": "s"}}}, annotations={"source_format": "csv"}, enums={"E": ["u"]})
    b = Schema.from_yaml(a.to_yaml())
    assert (b.classes, b.slots, b.enums, b.annotations, b.prefixes) == (a.classes, a.slots, a.enums, a.annotations, a.prefixes)
    (tmp_path / "a.linkml.yaml").write_text(a.to_yaml())
    with pytest.raises(ValueError):
        ingest.check_collision(tmp_path / "b.linkml.yaml", Schema("b", id="http://other", default_prefix="a"))
    ingest.check_collision(tmp_path / "a.linkml.yaml", a)
    with pytest.raises(ValueError):
        Schema.from_yaml("- 1")
    nodes = {r.node_id: r for r in a.nodes(spark).collect()}
    assert nodes["a:s"].label == "S" and nodes["a:s"].datatype == "integer"


def test_turtle():
    g = parse("""@prefix ex: <http://ex/> . # note
      ex:a ex:p "x\\n\\"y\\""@en , 1.5 , true , "z"^^ex:t ; ex:q ( 1 ex:b ) , [ ex:r <http://o#x> ] . PREFIX f: <http://f/> f:c a f:D.""")
    assert {(o.value, o.datatype, o.lang) for o in g.values("http://ex/a", "http://ex/p")} == {('x\n"y"', None, "en"), ("1.5", f"{vocab.XSD}decimal", None), ("true", f"{vocab.XSD}boolean", None), ("z", "http://ex/t", None)}
    assert list(g.items(g.value("http://ex/a", "http://ex/q"))) == ["1", "http://ex/b"]
    assert g.subjects(vocab.RDF_TYPE, "http://f/D") == ["http://f/c"]
    for bad in ("ex:a ex:b ex:c .", "<a> <b> .", "<a> <b> <c>", "@prefix ex: <http://x/> . ex:a %% ."):
        with pytest.raises(TurtleError):
            parse(bad)


def test_ntriples(spark, tmp_path):
    rows = [("http://s", "http://p", 'a "b"\n\\c', "literal", None, "en"), ("_:b", "http://p", "1", "literal", f"{vocab.XSD}integer", None), ("http://s", "http://p", "http://o", "iri", None, None)]
    df = spark.createDataFrame(rows, vocab.TRIPLE)
    write_ntriples(df, str(tmp_path / "nt"))
    assert sorted(map(tuple, read_ntriples(spark, str(tmp_path / "nt")).collect()), key=str) == sorted(rows, key=str)


SHAPE = "@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix mc: <https://w3id.org/mc/> . mc:S a sh:NodeShape ; sh:targetClass mc:Track ; sh:property [ sh:path mc:hasSpeed ; sh:minCount {n} ] ."


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "radar.csv").write_text("id,speed_kmh\nT1,390\nT2,400\n")
    (tmp_path / "mc.json").write_text(json.dumps({"title": "Track", "type": "object", "properties": {"hasSpeed": {"type": "integer"}}}))
    run = lambda *a: cli.main(list(a))
    assert run("ingest", "radar.csv", "-o", "radar.linkml.yaml") == 0 and run("ingest", "mc.json", "--master", "-o", "mc.linkml.yaml") == 0
    assert (tmp_path / "mc.shacl.ttl").exists() and (tmp_path / "strandweave.toml").exists()
    src, mst = "radar.linkml.yaml", "mc.linkml.yaml"
    assert run("suggest", src, mst, "--audit-log", "log.tsv", "-o", "cand.tsv") == 0
    assert "radar:speed_kmh" in (tmp_path / "cand.tsv").read_text()
    head = "\t".join(vocab.MAPPING_COLUMNS)
    line = "{s}\tskos:exactMatch\t{o}\t" + vocab.MMC + "\t0.9" + "\t" * 11
    text = "\n".join([head, line.format(s="radar:Observation", o="mc:Track"), line.format(s="radar:speed_kmh", o="mc:hasSpeed")]) + "\n"
    (tmp_path / "prop.tsv").write_text(text)
    args = ("--source-schema", src, "--master-schema", mst, "--audit-log", "log.tsv")
    assert run("ledger", "append", "prop.tsv", "--role", "analyst", *args, "--dry-run") == 0 and not (tmp_path / "log.tsv").exists()
    assert run("ledger", "append", "prop.tsv", "--role", "analyst", *args) == 0
    (tmp_path / "rev.tsv").write_text(text.replace(vocab.MMC, vocab.HC))
    assert run("ledger", "append", "rev.tsv", "--role", "analyst", *args) == 1
    assert run("ledger", "append", "rev.tsv", "--role", "accreditor", *args) == 0
    assert run("ledger", "append", "prop.tsv", "--role", "analyst", *args) == 1  # approved already
    capsys.readouterr()
    assert run("ledger", "dump", "--audit-log", "log.tsv") == 0 and "radar:speed_kmh" in capsys.readouterr().out
    assert run("ledger", "review", "--audit-log", "log.tsv") == 0
    assert run("compile", "log.tsv", "--source-schema", src, "--master-schema", mst, "-o", "m.yml", "--coverage-report", "c.json", "--spec-output", "spec.json") == 0
    assert json.loads((tmp_path / "c.json").read_text())["slot_mappings"] == ["radar:speed_kmh → mc:hasSpeed"]
    assert run("compile", "prop.tsv", "--source-schema", src, "--master-schema", mst) == 1
    for m in ("m.yml", "spec.json"):
        assert run("transform", m, "radar.csv", "--master-schema", mst, "--no-validate", "-o", "out.json") == 0
        assert {n["mc:hasSpeed"]["@value"] for n in json.loads((tmp_path / "out.json").read_text())["@graph"]} == {"390", "400"}
    before = (tmp_path / "out.json").read_text()
    (tmp_path / "bad.ttl").write_text(SHAPE.format(n=3))
    (tmp_path / "good.ttl").write_text(SHAPE.format(n=1))
    assert run("transform", "m.yml", "radar.csv", "--master-schema", mst, "--shapes", "bad.ttl", "--validate-report", "r.json", "-o", "out.json") == 1
    assert (tmp_path / "out.json").read_text() == before and json.loads((tmp_path / "r.json").read_text())["summary"]["violation"] == 2
    assert run("transform", "m.yml", "radar.csv", "--master-schema", mst, "--shapes", "good.ttl", "-o", "out.json") == 0
    assert run("transform", "m.yml", "radar.csv", "--master-schema", mst) == 2
    assert run("ingest", "nothing.csv") == 1


def test_stream_appends_once(spark, tmp_path):
    from strandweave.streaming import ledger_stream

    row = ("a", "skos:exactMatch", "x", vocab.MMC, 0.5, "", "", None, *[None] * 8, 1)
    inbox, log = str(tmp_path / "in"), str(tmp_path / "log")
    for turn in range(2):
        spark.createDataFrame([row], vocab.LOG).write.mode("append").parquet(inbox)
        ledger_stream.append_stream(ledger_stream.read_stream(spark, inbox), log, str(tmp_path / "cp")).awaitTermination(60)
        assert spark.read.parquet(log).count() == 1, turn
