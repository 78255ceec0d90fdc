"""Schemas from files of seven formats.

Tabular and JSON samples are profiled by Spark over all rows; the other formats are documents of kilobytes,
read on the driver.
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import vocab
from .model import Schema
from .paths import located
from .turtle import parse

#: An estimate of distinct values off by more than this much (six standard errors) means that some repeat.
DISTINCT_ERROR = 0.3
FORMATS = ["json-schema", "openapi", "xsd", "csv", "tsv", "json-sample", "rdfs"]


def detect_format(path: str | Path) -> str:
    """The format by extension; YAML only where it starts like an OpenAPI document."""
    path = Path(path)
    by_end = {".json": "json-schema", ".xsd": "xsd", ".csv": "csv", ".tsv": "tsv", ".ttl": "rdfs", ".owl": "rdfs", ".rdf": "rdfs"}
    if (end := path.suffix.lower()) in by_end:
        return by_end[end]
    if end in (".yaml", ".yml"):
        with path.open(encoding="utf-8") as f:
            if "openapi:" in f.read(512):
                return "openapi"
    raise ValueError(f"the format of {path} is unknown; it is one of {', '.join(FORMATS)}")


def read_text(path: str | Path) -> str:
    try:
        return Path(path).read_text(encoding="utf-8-sig")
    except UnicodeDecodeError as error:
        raise ValueError(f"{path} is not UTF-8: {error}") from error


def profile(df: DataFrame) -> dict[str, dict[str, Any]]:
    """For each text column: its range, whether all values are there and distinct, and an example.

    One aggregate over all rows: what every value can be cast to, nulls, and about how many values are distinct.
    Only columns that could be distinct are then counted exactly, one by one, so no row is multiplied by the
    number of columns.
    """
    rows = F.count("*").alias("rows")
    aggs, text = [rows], {c: F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) for c in df.columns}
    for i, c in enumerate(df.columns):
        v = text[c]
        whole, real = v.rlike(r"^[+-]?\d+$"), v.try_cast("double").isNotNull() & v.rlike(r"^[+-]?(\d|\.)")
        aggs += [F.count(v).alias(f"n{i}"), F.approx_count_distinct(v).alias(f"d{i}"), F.count_if(whole).alias(f"i{i}"), F.count_if(real).alias(f"f{i}"), F.count_if(v.rlike("(?i)^(true|false)$")).alias(f"b{i}"), F.count_if(v.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d")).alias(f"t{i}"), F.count_if(v.rlike(r"^\d{4}-\d\d-\d\d$")).alias(f"a{i}"), F.max(v).alias(f"e{i}")]
    got = df.agg(*aggs).first()
    out = {}
    for i, c in enumerate(df.columns):
        n = got[f"n{i}"]
        kinds = [("i", "integer"), ("f", "float"), ("b", "boolean"), ("t", "datetime"), ("a", "date")]
        kind = next((name for k, name in kinds if n and got[f"{k}{i}"] == n), "string")
        unique = bool(n) and n == got["rows"] and got[f"d{i}"] >= (1 - DISTINCT_ERROR) * n
        if unique:
            unique = df.groupBy(text[c].alias("v")).count().where("count > 1").isEmpty()
        out[c] = {"range": kind, "unique": unique, "example": got[f"e{i}"]}
    return out


def from_tabular(spark: SparkSession, path: str, name: str, separator: str = ",", cls: str = "Observation") -> Schema:
    """One class with a slot for each column; the first column of distinct values identifies, each further
    one is a unique key."""
    df = spark.read.options(header=True, multiLine=True, quote='"', escape='"', sep=separator).csv(located(path))
    if not df.columns:
        raise ValueError(f"{path} has no header")
    # bytes that are no UTF-8 are read as U+FFFD, which a file of text does not hold
    broken = F.lit(False)
    for c in df.columns:
        broken = broken | F.coalesce(F.contains(F.col(f"`{c}`"), F.lit("\ufffd")), F.lit(False))
    if any("\ufffd" in c for c in df.columns) or not df.where(broken).limit(1).isEmpty():
        raise ValueError(f"{path} is not UTF-8, or holds the sign U+FFFD that stands for what is not")
    names = [c.lstrip("﻿") if i == 0 else c for i, c in enumerate(df.columns)]
    found = profile(df.toDF(*names))
    slots, keys, first = {}, {}, True
    for c, p in found.items():
        slots[c] = {"range": p["range"]}
        if p["example"] is not None:
            slots[c]["examples"] = [{"value": p["example"]}]
        if p["unique"]:
            if first:
                slots[c]["identifier"] = True
            else:
                keys[f"{c}_key"] = {"unique_key_slots": [c]}
            first = False
    return Schema(name, classes={cls: {"slots": names, "unique_keys": keys}}, slots=slots)


def _class_name(hint: str) -> str:
    return "".join(w[:1].upper() + w[1:] for w in re.split(r"[^0-9A-Za-zÀ-ɏ]+", hint) if w) or "Thing"


def hoist(schema: dict, name: str) -> dict:
    """A JSON schema whose nested objects are definitions of their own, innermost first; arrays of objects
    name theirs after the property and ``Item``; a taken name gets a number."""
    defs: dict[str, dict] = dict(schema.get("$defs") or schema.get("definitions") or {})

    def walk(node: Any, hint: str, root: bool) -> Any:
        if not isinstance(node, dict):
            return node
        node = dict(node)
        if isinstance(node.get("properties"), dict):
            node["properties"] = {k: walk(v, k, False) for k, v in node["properties"].items()}
        if isinstance(node.get("items"), dict):
            node["items"] = walk(node["items"], f"{hint}Item", False)
        if root or node.get("type") != "object" or not node.get("properties"):
            return node
        own, base, i = _class_name(hint), _class_name(hint), 1
        while own in defs and defs[own] != node:
            i += 1
            own = f"{base}{i}"
        defs[own] = node
        return {"$ref": f"#/$defs/{own}"}

    for k in list(defs):
        defs[k] = walk(defs[k], k, True)
    out = walk(schema, name, True)
    out["$defs"] = defs
    return out


_JSON_RANGES = {"integer": "integer", "number": "float", "boolean": "boolean", "string": "string"}
_JSON_FORMATS = {"date-time": "datetime", "date": "date", "uri": "uri", "time": "time"}


def from_json_schema(raw: dict, name: str) -> Schema:
    """Classes of a JSON schema's objects and definitions, slots of their properties."""
    if not isinstance(raw, dict):
        raise ValueError("a JSON schema is an object")
    raw = hoist(raw, name)
    out = Schema(name)

    def branches(node: dict) -> list[dict]:
        return [node, *[b for k in ("allOf", "oneOf", "anyOf") for part in node.get(k) or [] if isinstance(part, dict) for b in branches(part)]]

    def add(cls: str, node: dict) -> None:
        slots: list[str] = []
        entry = out.classes.setdefault(cls, {})
        if node.get("description"):
            entry["description"] = node["description"]
        for part in branches(node):
            if "$ref" in part and part is not node:
                entry.setdefault("is_a", part["$ref"].rsplit("/", 1)[-1])
            for prop, spec in (part.get("properties") or {}).items():
                slots.append(prop)
                slot = out.slots.setdefault(prop, {})
                spec = spec if isinstance(spec, dict) else {}
                if spec.get("type") == "array":
                    slot["multivalued"] = True
                    spec = spec.get("items") if isinstance(spec.get("items"), dict) else {}
                kind = spec.get("type")
                kind = next((k for k in kind if k != "null"), "string") if isinstance(kind, list) else kind
                if "$ref" in spec:
                    slot["range"] = spec["$ref"].rsplit("/", 1)[-1]
                elif spec.get("enum"):
                    enum = f"{_class_name(prop)}Enum"
                    out.enums[enum] = [str(v) for v in spec["enum"]]
                    slot["range"] = enum
                else:
                    slot["range"] = _JSON_FORMATS.get(spec.get("format", ""), _JSON_RANGES.get(kind or "", "string"))
                for k, v in (("description", "description"), ("minimum", "minimum_value"), ("maximum", "maximum_value")):
                    if spec.get(k) is not None:
                        slot[v] = spec[k]
                if prop in (part.get("required") or []) and part is node:
                    slot["required"] = True
        entry["slots"] = list(dict.fromkeys(slots))

    if raw.get("properties") or any(raw.get(k) for k in ("allOf", "oneOf", "anyOf")):
        add(_class_name(raw.get("title") or name), raw)
    for cls, node in raw["$defs"].items():
        if isinstance(node, dict):
            if node.get("enum") and node.get("type", "string") == "string":
                out.enums[cls] = [str(v) for v in node["enum"]]
            else:
                add(cls, node)
    return out


def from_openapi(raw: dict, name: str) -> Schema:
    """The component schemas of an OpenAPI document."""
    parts = ((raw or {}).get("components") or {}).get("schemas")
    if not parts:
        raise ValueError("the document has no components.schemas")
    return from_json_schema({"$defs": parts}, name)


def from_spark_type(kind: T.DataType, name: str) -> dict:
    """A JSON schema of a Spark type."""
    if isinstance(kind, T.StructType):
        return {"type": "object", "properties": {f.name: from_spark_type(f.dataType, f.name) for f in kind.fields}}
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": from_spark_type(kind.elementType, name)}
    if isinstance(kind, T.BooleanType):
        return {"type": "boolean"}
    if isinstance(kind, T.IntegralType):
        return {"type": "integer"}
    if isinstance(kind, T.FractionalType):
        return {"type": "number"}
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return {"type": "string", "format": "date-time"}
    return {"type": "string"}


def from_json_sample(spark: SparkSession, path: str, name: str) -> Schema:
    """The union of all objects of a sample, a list or one object; nested objects are classes."""
    try:
        df = spark.read.option("multiLine", True).option("mode", "FAILFAST").json(located(path))
    except Exception as error:  # Spark's own errors, whose classes differ with the fault
        raise ValueError(f"{path} is not JSON: {str(error).splitlines()[0]}") from error
    return from_json_schema(from_spark_type(df.schema, name) | {"title": name}, name)


_XS = "{http://www.w3.org/2001/XMLSchema}"


def from_xsd(text: str, name: str) -> Schema:
    """Complex types as classes whose elements and attributes are class attributes; extensions as is_a."""
    try:
        root = ET.fromstring(text)
    except ET.ParseError as error:
        raise ValueError(f"not an XML schema: {error}") from error
    if root.tag != f"{_XS}schema":
        raise ValueError("the root is no xs:schema")
    out = Schema(name, prefixes={"tns": root.get("targetNamespace")} if root.get("targetNamespace") else {})

    def plain(kind: str | None) -> str:
        local = (kind or "string").split(":")[-1]
        return {"dateTime": "datetime", "anyURI": "uri"}.get(local, local if local in vocab.LITERAL_TYPES or local == "string" or local in known else vocab.XSD_RANGES.get(local, "string"))

    known = {t.get("name") for t in root.iter(f"{_XS}complexType")} | {t.get("name") for t in root.iter(f"{_XS}simpleType")}

    def add(cls: str, node: ET.Element) -> None:
        entry: dict[str, Any] = {"attributes": {}}
        for ext in node.iter(f"{_XS}extension"):
            base = (ext.get("base") or "").split(":")[-1]
            if base in known:
                entry["is_a"] = base
        for choice in node.iter():
            if choice.tag not in (f"{_XS}element", f"{_XS}attribute"):
                continue
            label = choice.get("name") or (choice.get("ref") or "").split(":")[-1]
            if not label:
                continue
            inner = choice.find(f"{_XS}complexType")
            if inner is not None:
                add(_class_name(label), inner)
            spec: dict[str, Any] = {"range": _class_name(label) if inner is not None else plain(choice.get("type"))}
            if choice.get("maxOccurs") not in (None, "0", "1"):
                spec["multivalued"] = True
            optional = choice.get("use") != "required" if choice.tag.endswith("attribute") else choice.get("minOccurs") == "0"
            if not optional and not _in_choice(node, choice):
                spec["required"] = True
            entry["attributes"][label] = spec
        out.classes[cls] = entry

    def _in_choice(node: ET.Element, item: ET.Element) -> bool:
        return any(item in list(c.iter()) for c in node.iter(f"{_XS}choice"))

    for t in root.iter(f"{_XS}simpleType"):
        values = [e.get("value") for e in t.iter(f"{_XS}enumeration")]
        if t.get("name") and values:
            out.enums[t.get("name")] = values
    for t in root.findall(f"{_XS}complexType"):
        add(t.get("name"), t)
    for e in root.findall(f"{_XS}element"):
        inner = e.find(f"{_XS}complexType")
        if inner is not None:
            add(_class_name(e.get("name")), inner)
    return out


def from_rdfs(text: str, name: str) -> Schema:
    """Classes with their superclass, properties with domain and range."""
    graph = parse(text)
    r = vocab.RDFS
    local = lambda iri: re.split(r"[/#]", iri.rstrip("/#"))[-1]
    classes = list(dict.fromkeys(graph.subjects(vocab.RDF_TYPE, f"{r}Class") + graph.subjects(vocab.RDF_TYPE, f"{vocab.OWL}Class")))
    props = list(dict.fromkeys(p for kind in (f"{vocab.RDF}Property", f"{vocab.OWL}ObjectProperty", f"{vocab.OWL}DatatypeProperty") for p in graph.subjects(vocab.RDF_TYPE, kind)))
    if not classes and not props:
        raise ValueError("the ontology has no classes and no properties")
    out = Schema(name, prefixes=dict(graph.prefixes))
    for c in (c for c in classes if not c.startswith("_:")):
        entry = {"class_uri": c, "title": graph.value(c, f"{r}label"), "description": graph.value(c, f"{r}comment"), "slots": []}
        parents = [p.value for p in graph.values(c, f"{r}subClassOf") if p.kind == "iri" and p.value in classes]
        out.classes[local(c)] = {k: v for k, v in (entry | ({"is_a": local(parents[0])} if parents else {})).items() if v is not None}
    for p in props:
        kind = graph.value(p, f"{r}range")
        plain = "string" if kind is None else local(kind)
        out.slots[local(p)] = {k: v for k, v in {"slot_uri": p, "title": graph.value(p, f"{r}label"), "description": graph.value(p, f"{r}comment"), "range": plain if plain in out.classes else vocab.XSD_RANGES.get(plain, plain if plain in vocab.LITERAL_TYPES else "string")}.items() if v is not None}
        for d in graph.values(p, f"{r}domain"):
            if local(d.value) in out.classes:
                out.classes[local(d.value)]["slots"].append(local(p))
    return out


def ingest(spark: SparkSession, path: str | Path, source_format: str | None = None, name: str | None = None) -> Schema:
    """The schema of a file, its format and slot paths stamped; ValueError where it cannot be read."""
    kind = source_format or detect_format(path)
    name = name or re.sub(r"[^0-9A-Za-z_]+", "_", Path(path).stem)
    if not re.match(r"[a-z0-9]+:/", str(path)) and not Path(path).exists():
        raise FileNotFoundError(f"no such file: {path}")
    if kind in ("csv", "tsv"):
        out = from_tabular(spark, str(path), name, "\t" if kind == "tsv" else ",")
    elif kind == "json-sample":
        out = from_json_sample(spark, str(path), name)
    elif kind == "json-schema":
        try:
            out = from_json_schema(json.loads(read_text(path)), name)
        except json.JSONDecodeError as error:
            raise ValueError(f"{path} is not JSON: {error}") from error
    elif kind == "openapi":
        out = from_openapi(yaml.safe_load(read_text(path)), name)
    elif kind == "xsd":
        out = from_xsd(read_text(path), name)
    elif kind == "rdfs":
        out = from_rdfs(read_text(path), name)
    else:
        raise ValueError(f"no such format: {kind}; it is one of {', '.join(FORMATS)}")
    out.plain_ranges()
    out.stamp(kind)
    return out


def check_collision(out: Path, schema: Schema) -> None:
    """ValueError where another schema beside ``out`` has the prefix with another id, or the id with another
    prefix."""
    for f in sorted(out.parent.glob("*.linkml.yaml")):
        if f.resolve() == out.resolve():
            continue
        try:
            other = Schema.from_yaml(f.read_text(encoding="utf-8"))
        except (ValueError, yaml.YAMLError):
            continue
        if (other.default_prefix == schema.default_prefix) != (other.id == schema.id):
            raise ValueError(f"{f} already has prefix {other.default_prefix!r} and id {other.id!r}")


def hoisted(df: DataFrame, column: str) -> DataFrame:
    """The data side of hoisting: a nested struct, or each struct of an array, as rows of its own."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.ArrayType):
        return df.select(F.explode_outer(column).alias("x")).select("x.*")
    return df.select(f"{column}.*")
