"""Controlled vocabularies, namespaces and table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

# fixed values: mapping justifications, predicates, severities
MMC = "semapv:ManualMappingCuration"
HC = "semapv:HumanCuration"
COMPOSITE = "semapv:CompositeMatching"
LEXICAL = "semapv:LexicalMatching"
DIFFERENT = "owl:differentFrom"
RELATED = "skos:relatedMatch"
PREDICATES = ["skos:exactMatch", "skos:closeMatch", "skos:narrowMatch", "skos:broadMatch", "skos:relatedMatch", "owl:differentFrom"]
COMPILED_PREDICATES = ["skos:exactMatch", "skos:closeMatch"]
BLOCK, WARNING, INFO = "BLOCK", "WARNING", "INFO"

# fixed values: type names by family
INTEGERS = ["integer", "int", "long", "short", "nonNegativeInteger", "positiveInteger"]
FLOATS = ["float", "double", "decimal"]
NUMERIC = INTEGERS + FLOATS
# fixed values: what an output type of a function covers beside itself
COVERS = {"integer": INTEGERS, "int": INTEGERS, "long": INTEGERS, "double": FLOATS, "float": FLOATS, "decimal": FLOATS, "string": ["string"], "boolean": ["boolean"]}

# fixed values: XSD type names that schema imports leave behind, and the range they stand for
XSD_RANGES = {
    "dateTime": "datetime", "dateTimeStamp": "datetime", "anyURI": "uri", "int": "integer", "long": "integer",
    "short": "integer", "byte": "integer", "unsignedInt": "integer", "unsignedLong": "integer", "unsignedShort": "integer",
    "unsignedByte": "integer", "nonNegativeInteger": "integer", "positiveInteger": "integer", "negativeInteger": "integer", "nonPositiveInteger": "integer",
}

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
XSD = "http://www.w3.org/2001/XMLSchema#"
SHACL = "http://www.w3.org/ns/shacl#"
OWL = "http://www.w3.org/2002/07/owl#"
FNO = "https://w3id.org/function/ontology#"
QUDT = "http://qudt.org/schema/qudt/"
UNIT = "http://qudt.org/vocab/unit/"
PROV = "http://www.w3.org/ns/prov#"
DCTERMS = "http://purl.org/dc/terms/"
FUNCTIONS = "https://strandweave.example/functions#"
GREL = "http://users.ugent.be/~bjdmeest/function/grel.ttl#"
RDF_TYPE = f"{RDF}type"

#: Prefixes that every plan knows; those of the target, then of the source schema override them.
GLOBAL_PREFIXES = {"skos": "http://www.w3.org/2004/02/skos/core#", "semapv": "https://w3id.org/semapv/vocab/", "xsd": XSD, "qudt": QUDT, "grel": GREL}

#: XSD type of a range, for literals; strings and URIs stay untyped.
LITERAL_TYPES = {"integer": "integer", "int": "integer", "long": "integer", "short": "integer", "float": "float", "double": "double", "decimal": "decimal", "boolean": "boolean", "datetime": "dateTime", "date": "date", "time": "time"}

_S = T.StringType()
#: One mapping row; log order is an explicit column because ties are broken by it.
MAPPING = T.StructType(
    [T.StructField(c, _S, False) for c in ("subject_id", "predicate_id", "object_id", "mapping_justification")]
    + [T.StructField("confidence", T.DoubleType()), T.StructField("subject_label", _S), T.StructField("object_label", _S), T.StructField("mapping_date", T.TimestampType())]
    + [T.StructField(c, _S) for c in ("record_id", "subject_datatype", "object_datatype", "subject_type", "object_type", "mapping_group_id", "composition_expr", "conversion_function")]
)
MAPPING_COLUMNS = MAPPING.fieldNames()
LOG = T.StructType([*MAPPING.fields, T.StructField("log_seq", T.LongType())])
FINDING = T.StructType([T.StructField(c, _S) for c in ("rule", "severity", "source_uri", "target_uri", "message")])
TRIPLE = T.StructType([T.StructField(c, _S) for c in ("s", "p", "o", "o_kind", "o_datatype", "o_lang")])
