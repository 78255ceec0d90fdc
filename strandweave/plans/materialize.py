"""A mapping plan over source data: triples, typed tables and JSON-LD.

A class is one scan: the subject template, its type and all slots are columns of one projection, turned into
triples by one explode.  Duplicates can only come from repeated subjects, so the shuffle of ``distinct`` is
left out where the caller knows the subject to be unique.
"""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..functions.registry import FunctionLibrary
from ..functions.text import compact, expand_name, template
from ..sources.paths import located
from .mapping import ClassRule, MappingPlan, SlotRule


def scan(spark: SparkSession, path: str, source_format: str, row_tag: str | None = None, iterator: str | None = None, lines: bool = False) -> DataFrame:
    """Source data with CSV values as they are written, and JSON or XML in their nested shape.

    ``iterator`` names a path to an array whose items are the rows.  ``lines`` says that no record goes over a
    line's end (JSON lines, CSV without line breaks in cells); large files are then read in splits, not each by
    one task.  XML is read in splits by its row tag anyway.
    """
    path = located(path)
    if source_format in ("csv", "tsv"):
        df = spark.read.option("header", True).option("multiLine", not lines).option("quote", '"').option("escape", '"').option("sep", "\t" if source_format == "tsv" else ",").csv(path)
        first = df.columns[0] if df.columns else ""
        df = df.withColumnRenamed(first, first.lstrip("﻿")) if first else df
    elif source_format == "json":
        df = spark.read.option("multiLine", not lines).option("primitivesAsString", True).json(path)
    elif source_format == "xml":
        if not row_tag:
            raise ValueError("XML needs the tag of its rows")
        df = spark.read.option("rowTag", row_tag).option("inferSchema", False).xml(path)
    else:
        raise ValueError(f"no such source format: {source_format}")
    return df.select(F.explode(F.col(iterator)).alias("row")).select("row.*") if iterator else df


def _column(df: DataFrame, name: str) -> Column:
    """A column by name, or a nested field by a path such as $.a.b or ./a/b."""
    plain = re.sub(r"^\$\.|^\./", "", name).replace("/", ".")
    head = plain.split(".")[0]
    if name in df.columns:
        return F.col(f"`{name}`")
    if head not in df.columns:
        raise ValueError(f"the data has no column {name!r}")
    return reduce(lambda c, part: c.getField(part), plain.split(".")[1:], F.col(f"`{head}`"))


def expression(text: str, df: DataFrame) -> Column:
    """A composite expression: ``[{a},{b}]`` makes one text ``[a,b]``, ``{a}`` is a column, and
    ``record["a"].split(",")[0]`` a part of one."""
    text = text.strip()
    if text.startswith("[") and text.endswith("]"):
        parts = [expression(p, df).cast("string") for p in re.findall(r"\{[^}]*\}", text)]
        if not parts:
            raise ValueError(f"no columns in the expression {text!r}")
        return F.concat(F.lit("["), *[x for p in parts for x in (p, F.lit(","))][:-1], F.lit("]"))
    if m := re.fullmatch(r"\{([^}]+)\}", text):
        return _column(df, m[1])
    if m := re.fullmatch(r"""record\[["'](.+?)["']\]\.split\(["'](.*?)["']\)\[(-?\d+)\]""", text):
        parts = F.split(_column(df, m[1]).cast("string"), re.escape(m[2]))
        i = int(m[3])
        return F.get(parts, F.lit(i)) if i >= 0 else F.element_at(parts, i)
    if m := re.fullmatch(r"""record\[["'](.+?)["']\]""", text):
        return _column(df, m[1])
    raise ValueError(f"an expression of no known form: {text!r}")


def _value(rule: SlotRule, df: DataFrame, library: FunctionLibrary | None) -> Column:
    if rule.expr is not None:
        return expression(rule.expr, df)
    raw = _column(df, rule.path if rule.path and rule.source not in df.columns else rule.source)
    if rule.function:
        raw = (library or FunctionLibrary.builtins()).apply(rule.function, raw)
    return raw


def _objects(rule: SlotRule, df: DataFrame, plan: MappingPlan, library: FunctionLibrary | None) -> Column:
    """An array of (p, o, o_kind, o_datatype, o_lang), one entry a value."""
    value = _value(rule, df, library)
    kind = df.select(value.alias("v")).schema[0].dataType
    many = kind.typeName() == "array"
    items = F.transform(value, lambda x: x.cast("string")) if many else F.array(value.cast("string"))
    datatype = vocab.LITERAL_TYPES.get(rule.datatype or "")
    reference = rule.name in plan.references or rule.datatype in ("uri", "uriorcurie")
    iri = expand_name(f"{plan.target_prefix}:{rule.name}", plan.prefixes)
    return F.transform(items, lambda x: F.struct(F.lit(iri).alias("p"), x.alias("o"), F.lit("iri" if reference else "literal").alias("o_kind"), F.lit(None if reference or not datatype else f"{vocab.XSD}{datatype}").cast("string").alias("o_datatype"), F.lit(None).cast("string").alias("o_lang")))


def class_triples(df: DataFrame, rule: ClassRule, plan: MappingPlan, library: FunctionLibrary | None = None, unique_subject: bool = False) -> DataFrame:
    """Triples of one class: one scan, one projection, one explode.  Null references give no triple."""
    subject = template(rule.subject, {m: _column(df, m) for m in re.findall(r"\$\(([^)]*)\)", rule.subject)})
    kind = F.array(F.struct(F.lit(vocab.RDF_TYPE).alias("p"), F.lit(expand_name(f"{plan.target_prefix}:{rule.name}", plan.prefixes)).alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_datatype"), F.lit(None).cast("string").alias("o_lang")))
    parts = F.concat(kind, *[F.coalesce(_objects(s, df, plan, library), F.array().cast("array<struct<p:string,o:string,o_kind:string,o_datatype:string,o_lang:string>>")) for s in rule.slots])
    out = df.select(subject.alias("s"), F.explode(parts).alias("t")).where("s is not null and t.o is not null").select("s", "t.*")
    multivalued = any(df.select(_value(s, df, library).alias("v")).schema[0].dataType.typeName() == "array" for s in rule.slots)
    return out if unique_subject and not multivalued else out.distinct()


def materialize(plan: MappingPlan, data: DataFrame | dict[str, DataFrame], library: FunctionLibrary | None = None, unique_subject: bool = False) -> DataFrame:
    """All triples of a plan; ``data`` is one DataFrame, or one for each source class."""
    parts = [class_triples(data[c.source] if isinstance(data, dict) else data, c, plan, library, unique_subject) for c in plan.classes]
    if not parts:
        raise ValueError("the plan maps no class")
    out = reduce(DataFrame.unionByName, parts)
    return out if len(parts) == 1 or unique_subject else out.distinct()


def typed_table(plan: MappingPlan, rule: ClassRule, df: DataFrame, library: FunctionLibrary | None = None) -> DataFrame:
    """One row a record: the subject and every slot in its own type, without the detour over triples."""
    types = {"integer": "bigint", "float": "double", "double": "double", "decimal": "decimal(38,18)", "boolean": "boolean", "dateTime": "timestamp", "date": "date"}
    subject = template(rule.subject, {m: _column(df, m) for m in re.findall(r"\$\(([^)]*)\)", rule.subject)})
    slots = []
    for s in rule.slots:
        value, kind = _value(s, df, library), types.get(vocab.LITERAL_TYPES.get(s.datatype or "", ""))
        slots.append((value.cast("string").try_cast(kind) if kind else value.cast("string")).alias(s.name))
    return df.select(subject.alias("subject"), *slots)


def context(plan: MappingPlan, datatypes: dict[str, str | None] | None = None) -> dict:
    """The JSON-LD context: prefixes, and each slot's type."""
    out: dict = dict(sorted(plan.prefixes.items()))
    for name, kind in sorted((datatypes or {s.name: s.datatype for c in plan.classes for s in c.slots}).items()):
        entry = {"@id": f"{plan.target_prefix}:{name}"}
        if name in plan.references:
            entry["@type"] = "@id"
        elif kind in vocab.LITERAL_TYPES:
            entry["@type"] = f"xsd:{vocab.LITERAL_TYPES[kind]}"
        out[name] = entry
    return out


def jsonld_nodes(triples: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """(s, node): a JSON object for each subject, keys and values in order.

    Values are grouped by property first, so what a subject gathers is its own properties.
    """
    value = F.when(F.col("o_kind") == "iri", F.to_json(F.struct(compact(F.col("o"), prefixes).alias("@id")))).when(F.col("o_datatype").isNotNull(), F.to_json(F.struct(F.col("o").alias("@value"), compact(F.col("o_datatype"), prefixes).alias("@type")))).otherwise(F.to_json(F.struct(F.col("o").alias("@value"))))
    types = F.col("p") == vocab.RDF_TYPE
    by_property = triples.groupBy("s", "p").agg(F.array_sort(F.collect_set(F.when(types, F.concat(F.lit('"'), compact(F.col("o"), prefixes), F.lit('"'))).otherwise(value))).alias("v"))
    body = F.when(F.size("v") == 1, F.get("v", F.lit(0))).otherwise(F.concat(F.lit("["), F.array_join("v", ","), F.lit("]")))
    name = F.when(types, F.lit("@type")).otherwise(compact(F.col("p"), prefixes))
    entries = by_property.select("s", F.struct(name.alias("k"), F.concat(F.lit('"'), name, F.lit('":'), body).alias("e")).alias("e"))
    return entries.groupBy("s").agg(F.array_sort(F.collect_list("e")).alias("e")).select("s", F.concat(F.lit('{"@id":"'), compact(F.col("s"), prefixes), F.lit('",'), F.array_join(F.transform("e", lambda x: x["e"]), ","), F.lit("}")).alias("node"))


def write_jsonld(triples: DataFrame, plan: MappingPlan, path: str) -> dict:
    """Write one JSON node a line under ``path``, by the executors, and return the context that they share."""
    jsonld_nodes(triples, plan.prefixes).select("node").write.mode("overwrite").text(path)
    return context(plan)


def jsonld_document(triples: DataFrame, plan: MappingPlan) -> str:
    """One document with its context, for results of a size that a driver holds."""
    nodes = [r.node for r in jsonld_nodes(triples, plan.prefixes).orderBy("s").toLocalIterator()]
    return '{"@context":' + json.dumps(context(plan), ensure_ascii=False) + ',"@graph":[' + ",\n".join(nodes) + "]}"


def query(triples: DataFrame, sql: str, **bindings) -> DataFrame:
    """SQL over the view ``triples``, with named parameters that are never spliced into its text."""
    return triples.sparkSession.sql(sql, args=bindings, triples=triples) if "{triples}" in sql else _viewed(triples, sql, bindings)


def _viewed(triples: DataFrame, sql: str, bindings: dict) -> DataFrame:
    triples.createOrReplaceTempView("triples")
    return triples.sparkSession.sql(sql, args=bindings or None)
