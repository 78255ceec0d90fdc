"""Registered queries over schema documents: ingest of each format, node texts, plans, mapping documents, shapes
and function declarations.

The documents are small and stand here; the tabular and JSON samples are the driver's tables, written to the
shared folder in the format that is read.  What a document must give is stated as rows of the query's SQL.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vocab
from .functions.registry import FunctionLibrary
from .operators import hierarchy, lint, shacl
from .plans import mapping, yarrrml
from .plans.suggest import embedded, hashing_embedder, prefixed
from .queries import _CLOSURE, _PROPOSED, _edges, _proposals, _read, _register, sssom_roundtrip
from .sources import ingest, shapes, turtle
from .sources.model import Schema
from .sources.paths import shared_dir


def _rows(names: str, rows: list[tuple]) -> str:
    """SQL of fixed rows."""

    def cell(x) -> str:
        return "NULL" if x is None else str(x).upper() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"

    body = ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) v({names})"


_SLOTS = "cls, slot, range, required, multivalued, parent"


def _slots(spark: SparkSession, schema: Schema) -> DataFrame:
    """What a schema says of its classes' own slots, and its enums' values as slots of theirs."""
    rows = []
    for cls, c in schema.classes.items():
        told = {**{s: schema.slots.get(s, {}) for s in c.get("slots") or []}, **(c.get("attributes") or {})}
        rows += [(cls, s, x.get("range") or schema.default_range, bool(x.get("required")), bool(x.get("multivalued")), c.get("is_a")) for s, x in told.items()]
        rows += [] if told else [(cls, None, None, False, False, c.get("is_a"))]
    rows += [(e, v, "enum", False, False, None) for e, values in schema.enums.items() for v in values]
    return spark.createDataFrame(rows, "cls string, slot string, range string, required boolean, multivalued boolean, parent string")


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/strandweave-samples-{uuid.uuid4().hex}"


def _tabular(spark: SparkSession, table: DataFrame, separator: str) -> DataFrame:
    path = _folder(spark)
    table.write.options(header=True, sep=separator, quote='"', escape='"').csv(path)
    schema = ingest.from_tabular(spark, path, "sample", separator)
    (cls,) = schema.classes.values()
    keys = {s for k in cls["unique_keys"].values() for s in k["unique_key_slots"]}
    rows = [(i, s, schema.slots[s]["range"], bool(schema.slots[s].get("identifier")), s in keys) for i, s in enumerate(cls["slots"])]
    return spark.createDataFrame(rows, "pos int, slot string, range string, identifier boolean, key boolean")


def _tabular_sql(table: str, columns: dict[str, str]) -> str:
    parts = [f"SELECT {i} AS pos, '{c}' AS slot, '{kind}' AS range, count(*) = count(DISTINCT {c}) AS u FROM {table}" for i, (c, kind) in enumerate(columns.items())]
    return f"WITH t AS ({' UNION ALL '.join(parts)}), f AS (SELECT min(pos) AS first FROM t WHERE u) SELECT pos, slot, range, u AND pos = first AS identifier, u AND pos <> first AS key FROM t, f"


@_register(_tabular_sql("supplier", {"s_suppkey": "integer", "s_name": "string", "s_nationkey": "integer", "s_acctbal": "float"}))
def ingest_csv(spark, d):
    return _tabular(spark, _read(spark, d, "supplier"), ",")


@_register(_tabular_sql("(SELECT *, o_orderkey % 10 AS o_clerk FROM orders)", {"o_orderdate": "date", "o_orderkey": "integer", "o_orderstatus": "string", "o_totalprice": "float", "o_clerk": "string"}))
def ingest_tsv(spark, d):
    orders = _read(spark, d, "orders")
    return _tabular(spark, orders.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), "o_orderkey", "o_orderstatus", "o_totalprice", F.concat(F.lit("Clerk, \"the\" "), F.col("o_orderkey") % 10).alias("o_clerk")), "\t")


@_register(_rows(_SLOTS, [("Region", "nations", "NationsItem", False, True, None), ("Region", "place", "Place", False, False, None), ("Region", "tags", "string", False, True, None), ("NationsItem", "key", "integer", False, False, None), ("NationsItem", "name", "string", False, False, None), ("Place", "first", "boolean", False, False, None), ("Place", "share", "float", False, False, None)]))
def ingest_json_sample(spark, d):
    """Regions with their nations, nested, as one JSON document."""
    nations = _read(spark, d, "nation").groupBy("n_regionkey").agg(F.collect_list(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))).alias("nations"))
    place = F.struct((F.col("r_regionkey") == 0).alias("first"), (F.col("r_regionkey") / 2 + 0.25).alias("share")).alias("place")
    regions = _read(spark, d, "region").join(nations, F.col("n_regionkey") == F.col("r_regionkey")).select("nations", place, F.array("r_name").alias("tags"))
    path = _folder(spark)
    regions.agg(F.to_json(F.collect_list(F.struct(*regions.columns))).alias("value")).coalesce(1).write.text(path)
    return _slots(spark, ingest.from_json_sample(spark, path, "region"))


JSON_SCHEMA = {
    "title": "Order", "type": "object", "required": ["key"],
    "properties": {"key": {"type": "integer"}, "placed": {"type": "string", "format": "date-time"}, "status": {"enum": ["O", "F"]}, "note": {"type": ["null", "string"]}, "lines": {"type": "array", "items": {"type": "object", "required": ["part"], "properties": {"part": {"$ref": "#/definitions/Part"}, "quantity": {"type": "number"}}}}},
    "definitions": {"Part": {"type": "object", "properties": {"name": {"type": "string"}, "page": {"type": "string", "format": "uri"}, "tags": {"type": "array", "items": {"type": "string"}}}}, "Special": {"allOf": [{"$ref": "#/definitions/Part"}, {"properties": {"grade": {"type": "boolean"}}}]}},
}


@_register(_rows(_SLOTS, [
    ("Order", "key", "integer", True, False, None), ("Order", "placed", "datetime", False, False, None), ("Order", "status", "StatusEnum", False, False, None), ("Order", "note", "string", False, False, None), ("Order", "lines", "LinesItem", False, True, None),
    ("LinesItem", "part", "Part", True, False, None), ("LinesItem", "quantity", "float", False, False, None), ("Part", "name", "string", False, False, None), ("Part", "page", "uri", False, False, None), ("Part", "tags", "string", False, True, None),
    ("Special", "grade", "boolean", False, False, "Part"), ("StatusEnum", "O", "enum", False, False, None), ("StatusEnum", "F", "enum", False, False, None),
]))
def ingest_json_schema(spark, d):
    return _slots(spark, ingest.from_json_schema(JSON_SCHEMA, "order"))


@_register(_rows(_SLOTS, [("Track", "id", "string", True, False, None), ("Track", "seen", "datetime", False, False, None), ("Track", "place", "Place", False, False, None), ("Place", "lat", "float", False, False, None), ("Place", "lon", "float", False, False, None)]))
def ingest_openapi(spark, d):
    document = "openapi: 3.0.0\ncomponents: {schemas: {Track: {type: object, required: [id], properties: {id: {type: string}, seen: {type: string, format: date-time}, place: {type: object, properties: {lat: {type: number}, lon: {type: number}}}}}}}\n"
    import yaml

    return _slots(spark, ingest.from_openapi(yaml.safe_load(document), "tracks"))


XML_SCHEMA = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:simpleType name="Kind"><xs:restriction base="xs:string"><xs:enumeration value="air"/><xs:enumeration value="sea"/></xs:restriction></xs:simpleType>
<xs:complexType name="Base"><xs:sequence><xs:element name="id" type="xs:string"/><xs:element name="at" type="xs:dateTime" minOccurs="0"/></xs:sequence><xs:attribute name="source" type="xs:string" use="required"/></xs:complexType>
<xs:complexType name="Radar"><xs:complexContent><xs:extension base="Base"><xs:sequence><xs:element name="kind" type="Kind"/><xs:element name="freq" type="xs:decimal" maxOccurs="unbounded"/><xs:choice><xs:element name="a" type="xs:int"/><xs:element name="b" type="xs:anyURI"/></xs:choice></xs:sequence></xs:extension></xs:complexContent></xs:complexType></xs:schema>"""


@_register(_rows(_SLOTS, [
    ("Base", "id", "string", True, False, None), ("Base", "at", "datetime", False, False, None), ("Base", "source", "string", True, False, None), ("Radar", "kind", "Kind", True, False, "Base"), ("Radar", "freq", "decimal", True, True, "Base"),
    ("Radar", "a", "int", False, False, "Base"), ("Radar", "b", "uri", False, False, "Base"), ("Kind", "air", "enum", False, False, None), ("Kind", "sea", "enum", False, False, None),
]))
def ingest_xsd(spark, d):
    return _slots(spark, ingest.from_xsd(XML_SCHEMA, "radar"))


ONTOLOGY = """@prefix ex: <http://example.org/o/> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> . @prefix owl: <http://www.w3.org/2002/07/owl#> .
ex:Place a rdfs:Class ; rdfs:label "Place" . ex:Harbour a owl:Class ; rdfs:subClassOf ex:Place . ex:depth a rdf:Property ; rdfs:domain ex:Harbour ; rdfs:range xsd:double .
ex:opened a owl:DatatypeProperty ; rdfs:domain ex:Place , ex:Harbour ; rdfs:range xsd:dateTime . ex:near a owl:ObjectProperty ; rdfs:domain ex:Place ; rdfs:range ex:Place ."""


@_register(_rows(_SLOTS, [("Place", "near", "Place", False, False, None), ("Place", "opened", "datetime", False, False, None), ("Harbour", "depth", "double", False, False, "Place"), ("Harbour", "opened", "datetime", False, False, "Place")]))
def ingest_rdfs(spark, d):
    return _slots(spark, ingest.from_rdfs(ONTOLOGY, "places"))


def _geography(spark: SparkSession, d: str) -> Schema:
    """The regions and nations, whose number is fixed, as classes below one another."""
    out = Schema("geo", classes={"World": {}}, slots={"area_km": {"range": "double", "description": "Area of a place"}})
    for r in _read(spark, d, "region").orderBy("r_regionkey").collect():
        out.classes[f"region_{r.r_regionkey}"] = {"is_a": "World", "title": r.r_name}
    for n in _read(spark, d, "nation").orderBy("n_nationkey").collect():
        out.classes[f"nation_{n.n_nationkey}"] = {"is_a": f"region_{n.n_regionkey}", "description": f"The nation {n.n_name}", "slots": ["area_km"]}
    return out


_GEO = "SELECT 'geo:World' AS node_id, 'World' AS label, {world} AS text, NULL AS datatype UNION ALL SELECT 'geo:region_' || r_regionkey, r_name, {region}, NULL FROM region UNION ALL SELECT 'geo:nation_' || n_nationkey, 'Nation ' || n_nationkey, {nation}, NULL FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT 'geo:area_km', 'Area Km', {slot}, 'double'"


@_register(_GEO.format(world="'World'", region="r_name || '. World'", nation="'Nation ' || n_nationkey || '. The nation ' || n_name || '. Region ' || n_regionkey", slot="'Area Km. Area of a place'"))
def node_texts(spark, d):
    """Node texts with definitions and parents."""
    return _geography(spark, d).nodes(spark, definitions=True, parents=True).drop("pos")


@_register(_GEO.format(world="'World' || (SELECT string_agg('. Region ' || r_regionkey, '' ORDER BY r_regionkey) FROM region)", region="r_name || '. World' || coalesce((SELECT string_agg('. Nation ' || n_nationkey, '' ORDER BY n_nationkey) FROM nation n WHERE n.n_regionkey = r_regionkey), '')", nation="'Nation ' || n_nationkey || '. ' || r_name || '. World'", slot="'Area Km'"))
def node_texts_of_relatives(spark, d):
    """Node texts with all ancestors, which stand in for parents, and children."""
    return _geography(spark, d).nodes(spark, parents=True, ancestors=True, children=True).drop("pos")


@_register("SELECT 'geo:nation_' || n_nationkey AS node_id, 'query: Nation ' || n_nationkey AS query, 'passage: Nation ' || n_nationkey AS passage, 'Nation ' || n_nationkey AS plain, 1.0::DOUBLE AS \"self\" FROM nation")
def embedding_texts(spark, d):
    """Lead words of the model families that want them, and each node's vector against itself."""
    schema = _geography(spark, d)
    nodes = schema.nodes(spark).where("node_id like 'geo:nation%'").orderBy("pos").collect()
    texts = [n.text for n in nodes]
    told = spark.createDataFrame(list(zip([n.node_id for n in nodes], prefixed(texts, "e5-large", True), prefixed(texts, "e5-large", False), prefixed(texts, "plain", True), strict=True)), "node_id string, query string, passage string, plain string")
    from .operators.vectors import dot, unit

    vectors = embedded(spark, schema, hashing_embedder(), True).select("node_id", F.round(dot(unit(F.col("vector")), unit(F.col("vector"))), 6).alias("self"))
    return told.join(vectors, "node_id").select("node_id", "query", "passage", "plain", "self")


# --- plans ------------------------------------------------------------------------------------------------

SOURCE = Schema("radar", classes={"Obs": {"slots": ["track", "lat", "lon", "height_m", "speed_kmh", "bearing"]}}, slots={"track": {"range": "string", "identifier": True}, "lat": {"range": "float"}, "lon": {"range": "float"}, "height_m": {"range": "float"}, "speed_kmh": {"range": "integer"}, "bearing": {"range": "integer"}})
SOURCE.stamp("csv")
TARGET = Schema(
    "mc", id="https://example.org/mc", classes={"Entity": {"slots": ["hasPlace", "hasHeightFt"]}, "Track": {"is_a": "Entity", "slots": ["hasSpeed", "hasBearing", "hasName"]}, "Base": {"abstract": True, "slots": ["hasNote"]}},
    slots={"hasPlace": {"range": "string"}, "hasHeightFt": {"range": "double"}, "hasSpeed": {"range": "double"}, "hasBearing": {"range": "integer", "multivalued": True}, "hasName": {"range": "string", "required": True}, "hasNote": {"range": "string"}},
)


def _approved(spark: SparkSession) -> DataFrame:
    group = {"mapping_group_id": "g", "composition_expr": "[{lat},{lon}]"}
    told = [
        ("radar:Obs", "mc:Track", {}), ("radar:lat", "mc:hasPlace", group), ("radar:lon", "mc:hasPlace", group), ("radar:height_m", "mc:hasHeightFt", {"conversion_function": "fns:meterToFoot"}),
        ("radar:speed_kmh", "mc:hasSpeed", {"predicate_id": "skos:closeMatch", "subject_datatype": "integer", "object_datatype": "double"}), ("radar:bearing", "mc:hasBearing", {"predicate_id": "skos:narrowMatch"}),
        ("radar:track", "mc:hasName", {"predicate_id": vocab.DIFFERENT}), ("other:x", "mc:y", {}), ("radar:bearing", "mc:hasBearing", {"mapping_justification": vocab.MMC}),
    ]
    rows = []
    for i, (s, o, extra) in enumerate(told):
        base = dict.fromkeys(vocab.LOG.fieldNames()) | {"predicate_id": "skos:exactMatch", "mapping_justification": vocab.HC, "confidence": 0.9, "subject_label": "", "object_label": "", "log_seq": i, "record_id": f"r{i}"}
        rows.append(tuple((base | {"subject_id": s, "object_id": o} | extra).values()))
    return spark.createDataFrame(rows, vocab.LOG)


def _compiled(spark: SparkSession):
    return mapping.compile_plan(_approved(spark), SOURCE, TARGET, FunctionLibrary.builtins())


def _rules(spark: SparkSession, plan: mapping.MappingPlan) -> DataFrame:
    rows = [(c.name, c.subject, s.name, s.source, s.expr, s.function, s.datatype) for c in plan.classes for s in c.slots]
    return spark.createDataFrame(rows, "cls string, subject string, slot string, source string, expr string, fn string, datatype string")


_OF = ("Track", "https://example.org/mc/Track/$(track)")
_PLAN = [(*_OF, "hasHeightFt", "height_m", None, "fns:meterToFoot", "double"), (*_OF, "hasSpeed", "speed_kmh", None, None, "double"), (*_OF, "hasPlace", None, "[{lat},{lon}]", None, "string")]


@_register(_rows("cls, subject, slot, source, expr, fn, datatype", _PLAN))
def compile_plan(spark, d):
    """The rules of a compiled plan: an inherited slot moved to the mapped class, a function, a composite."""
    return _rules(spark, _compiled(spark)[0])


@_register(_rows("item, value", [("total", "9"), ("after_prefix", "8"), ("after_predicate", "7"), ("accepted", "5"), ("dropped_different_from", "1"), ("class_mappings", '["radar:Obs → mc:Track"]'), ("slot_mappings", '["radar:height_m → mc:hasHeightFt", "radar:speed_kmh → mc:hasSpeed"]'), ("composite_groups", '[{"group_id": "g", "member_row_ids": ["r1", "r2"], "target_slot": "hasPlace", "resolved": true}]'), ("unresolved_subjects", "[]"), ("unresolved_objects", "[]"), ("unmapped_required", '["Track.hasName"]'), ("datatype_warnings", '[{"subject_id": "radar:speed_kmh", "subject_datatype": "integer", "object_id": "mc:hasSpeed", "object_datatype": "double"}]')]))
def plan_coverage(spark, d):
    told = _compiled(spark)[1].__dict__
    return spark.createDataFrame([(k, json.dumps(v, ensure_ascii=False)) for k, v in told.items()], "item string, value string")


@_register(_rows("cls, subject, slot, source, expr, fn, datatype", [(*r[:-1], None if r[-1] == "string" else r[-1]) for r in _PLAN]))
def mapping_document(spark, d):
    """The plan after it went through a mapping document, which leaves plain texts without a type."""
    return _rules(spark, yarrrml.from_yarrrml(yarrrml.to_yarrrml(_compiled(spark)[0])))


_MC = "https://example.org/mc/"
_X = vocab.XSD


def _shape_rows() -> list[tuple]:
    own = {"Entity": ["hasPlace", "hasHeightFt"], "Track": ["hasSpeed", "hasBearing", "hasName", "hasPlace", "hasHeightFt"]}
    kinds = {"hasPlace": "string", "hasHeightFt": "double", "hasSpeed": "double", "hasBearing": "integer", "hasName": "string"}
    out = []
    for cls, slots in own.items():
        out.append((_MC + cls, None, "closed", "true"))
        for s in slots:
            out += [(_MC + cls, _MC + s, "datatype", _X + kinds[s]), (_MC + cls, _MC + s, "nodeKind", f"{vocab.SHACL}Literal")]
            out += [] if s == "hasBearing" else [(_MC + cls, _MC + s, "maxCount", "1")]
            out += [(_MC + cls, _MC + s, "minCount", "1")] if s == "hasName" else []
    return [*out, (_MC + "Track", f"{vocab.QUDT}hasUnit", "in", f"<{vocab.UNIT}FT>")]


@_register(_rows("shape, path, kind, told", _shape_rows()))
def generated_shapes(spark, d):
    """Shapes generated from a schema, written as a document and read back."""
    rows = shapes.constraint_rows(turtle.parse(shapes.to_turtle(shacl.generate(TARGET, {"Track": [f"{vocab.UNIT}FT"]}))))
    return spark.createDataFrame([(r["shape"], r.get("path"), r["kind"], str(r["param"]) if "param" in r else " ".join(r["items"])) for r in rows], "shape string, path string, kind string, told string")


DECLARATIONS = """@prefix fno: <https://w3id.org/function/ontology#> . @prefix ex: <http://example.org/f/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
ex:knots a fno:Function ; fno:expects ( ex:speed ) ; fno:returns ( ex:out ) . ex:speed fno:predicate ex:value ; fno:type xsd:double . ex:out fno:type xsd:integer . ex:plain a fno:Function ."""


@_register(_rows("fn, fn_iri, parameter, input_type, output_type", [("ex:knots", "http://example.org/f/knots", "ex:value", "xsd:double", "xsd:integer"), ("ex:plain", "http://example.org/f/plain", "grel:valueParameter", None, None), ("grel:math_round", f"{vocab.GREL}math_round", "grel:p_dec_n", "xsd:decimal", "xsd:integer")]))
def declared_functions(spark, d):
    library = FunctionLibrary.builtins()
    library.add_turtle(DECLARATIONS)
    return library.table(spark).where("fn like 'ex:%' or fn = 'grel:math_round'")


@_register("SELECT l_orderkey, l_linenumber, round(l_quantity * 0.3048, 6) AS metres, round(l_quantity * 2.20462, 6) AS pounds, round(l_quantity - 273.15, 6) AS celsius, round(l_extendedprice)::BIGINT AS rounded, ceil(l_extendedprice)::BIGINT AS up, l_quantity::DOUBLE AS number, l_linenumber::VARCHAR AS text FROM lineitem")
def casts_native(spark, d):
    """The conversions and casts that ``unit_convert_native`` leaves."""
    lib, df = FunctionLibrary.builtins(), _read(spark, d, "lineitem")
    quantity, price = F.col("l_quantity"), F.col("l_extendedprice")
    told = {"metres": F.round(lib.apply("fns:footToMeter", quantity), 6), "pounds": F.round(lib.apply("fns:kgToPound", quantity), 6), "celsius": F.round(lib.apply("fns:kelvinToCelsius", quantity), 6), "rounded": lib.apply("grel:math_round", price), "up": lib.apply("grel:math_ceil", price), "number": lib.apply("grel:string_toNumber", quantity.cast("string")), "text": lib.apply("grel:string_toString", F.col("l_linenumber"))}
    return df.select("l_orderkey", "l_linenumber", *[c.alias(n) for n, c in told.items()])


# --- more of the hierarchy, lint and the log -----------------------------------------------------------------


@_register(f"""WITH RECURSIVE {_CLOSURE}, own AS (SELECT 'r' || r_regionkey AS cls, 'of_region' AS slot FROM region UNION ALL SELECT 'n' || n_nationkey, 'of_nation_' || (n_nationkey % 3) FROM nation UNION ALL SELECT 'c' || c_custkey, 'segment_' || c_mktsegment FROM customer UNION ALL SELECT 'mix', 'mixed')
SELECT DISTINCT c.cls, slot FROM closure c JOIN own o ON c.ancestor = o.cls UNION SELECT c.cls, 'mixed' FROM closure c WHERE ancestor = 'r1'""")
def induced_slots(spark, d):
    """Slots listed, inherited and mixed in."""
    parts = [_read(spark, d, "region").selectExpr("concat('r', r_regionkey) as cls", "'of_region' as slot"), _read(spark, d, "nation").selectExpr("concat('n', n_nationkey) as cls", "concat('of_nation_', n_nationkey % 3) as slot"), _read(spark, d, "customer").selectExpr("concat('c', c_custkey) as cls", "concat('segment_', c_mktsegment) as slot")]
    listed = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(spark.createDataFrame([("mix", "mixed")], "cls string, slot string"))
    return hierarchy.induced_slots(listed, hierarchy.closure(_edges(spark, d)), spark.createDataFrame([("r1", "mix")], "cls string, mixin string"))


@_register(f"""WITH RECURSIVE {_CLOSURE} SELECT 'c' || c_custkey AS cls, 'n' || c_nationkey AS nearest FROM customer UNION ALL SELECT 'n' || n_nationkey, 'n' || n_nationkey FROM nation""")
def remapped_slots(spark, d):
    """Slots of unmapped classes go to the nearest mapped class above: every nation is mapped, no customer."""
    closed = hierarchy.closure(_edges(spark, d))
    nations = _read(spark, d, "nation").selectExpr("concat('n', n_nationkey) as cls")
    return hierarchy.nearest_mapped(closed.select("cls").where("cls like 'c%' or cls like 'n%'"), nations, closed)


@_register(f"""{_PROPOSED}, n AS (SELECT *, replace(su, 'unit:', '') AS s, replace(ou, 'unit:', '') AS o FROM u WHERE su IS NOT NULL AND ou IS NOT NULL)
SELECT k AS row_seq, subject_id AS source_uri, object_id AS target_uri, CASE WHEN NOT fits THEN 'BLOCK' ELSE 'WARNING' END AS severity, CASE WHEN NOT fits THEN 'Incompatible unit dimensions: ' || s || ' vs ' || o ELSE 'Same dimension, different units: ' || s || ' vs ' || o END AS message,
  CASE WHEN NOT fits THEN NULL WHEN (s, o) IN (('FT', 'M'), ('M', 'FT'), ('KiloM', 'M'), ('M', 'KiloM'), ('KiloGM', 'GM')) THEN 'Convert' || s || 'To' || o END AS fn FROM n WHERE NOT fits OR (fits AND su <> ou)""")
def unit_messages(spark, d):
    """Texts of the findings on units that do not agree, and the conversion that each suggests."""
    found = lint.unit_findings(_proposals(spark, d)).where("rule in ('unit_dimension_mismatch', 'unit_conversion_required')")
    return found.select("row_seq", "source_uri", "target_uri", "severity", "message", F.col("suggestion.fn").alias("fn"))


_JUSTIFIED = f"CASE WHEN event_type = 'signup' THEN '{vocab.MMC}' WHEN event_type IN ('purchase', 'error') THEN '{vocab.HC}' ELSE '{vocab.COMPOSITE}' END"


@_register(f"""WITH log AS (SELECT 'src' || (user_id % 3) || ':u' || user_id AS subject_id, 'mc:k' || json_extract_string(props, '$.k') AS object_id, {_JUSTIFIED} AS mapping_justification, ts, event_id FROM events)
SELECT subject_id, object_id, mapping_justification, 0.9::DOUBLE AS confidence, event_id::VARCHAR AS record_id FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, object_id ORDER BY ts DESC, event_id) AS i FROM log) WHERE i = 1 AND mapping_justification = '{vocab.HC}'""")
def sssom_decided(spark, d):
    """The decided pairs as they come back from mapping files."""
    return sssom_roundtrip(spark, d).select("subject_id", "object_id", "mapping_justification", "confidence", "record_id")


@_register("SELECT 'https://example.org/nation/' || n_nationkey AS s, 'https://example.org/name' AS p, n_name AS o, 'literal' AS o_kind FROM nation UNION ALL SELECT 'https://example.org/nation/' || n_nationkey, 'https://example.org/in', 'https://example.org/region/' || n_regionkey, 'iri' FROM nation")
def ntriples_roundtrip(spark, d):
    """Triples written as N-Triples and read back."""
    n = _read(spark, d, "nation")
    null = F.lit(None).cast("string")
    s = F.concat(F.lit("https://example.org/nation/"), "n_nationkey").alias("s")
    parts = [n.select(s, F.lit("https://example.org/name").alias("p"), F.col("n_name").alias("o"), F.lit("literal").alias("o_kind"), null.alias("o_datatype"), null.alias("o_lang")), n.select(s, F.lit("https://example.org/in").alias("p"), F.concat(F.lit("https://example.org/region/"), "n_regionkey").alias("o"), F.lit("iri").alias("o_kind"), null.alias("o_datatype"), null.alias("o_lang"))]
    path = _folder(spark)
    turtle.write_ntriples(parts[0].unionByName(parts[1]), path)
    return turtle.read_ntriples(spark, path).select("s", "p", "o", "o_kind")


@_register("SELECT 'r' || r_regionkey AS cls, min(n_nationkey)::VARCHAR || ' ' || max(n_nationkey)::VARCHAR AS told FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def schema_text(spark, d):
    """A schema written as text and read again: for each region the first and last nation below it."""
    again = Schema.from_yaml(_geography(spark, d).to_yaml())
    below: dict[str, list[int]] = {}
    for name, c in again.classes.items():
        if name.startswith("nation_"):
            below.setdefault(c["is_a"].replace("region_", "r"), []).append(int(name.removeprefix("nation_")))
    return spark.createDataFrame([(r, f"{min(ns)} {max(ns)}") for r, ns in below.items()], "cls string, told string")
