"""Shape constraints over triples: constraint rows in, findings out.

A constraint is a row (shape, target_class, path, kind, param, items, severity, message).  All constraints on
single values (datatype, nodeKind, in, pattern, ranges) are one join of the focus nodes with their values, both
counts one aggregate, and hasValue, class and closed one join each: a graph is read at most five times however
many shapes and constraints there are.  The constraint rows are small and meet the triples by broadcast,
guarded by their count.  What is made from triples is never broadcast: its size is estimated from the source's
files, which hold a row for many triples, so such joins are merges, whatever the estimate.

Items of ``in`` that are IRIs stand in angle brackets, so an IRI and a literal of one spelling differ.  Ranges
are compared in the type of their limit: as timestamps where it looks like a date, else as numbers, exactly
where 38 digits hold them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import vocab

CONSTRAINT = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("shape", "target_class", "path", "kind", "param")]
    + [T.StructField("items", T.ArrayType(T.StringType())), T.StructField("severity", T.StringType()), T.StructField("message", T.StringType())]
)
KINDS = ["maxCount", "minCount", "datatype", "nodeKind", "class", "in", "closed", "minInclusive", "maxInclusive", "minExclusive", "maxExclusive", "pattern", "hasValue"]
#: Constraint rows that are broadcast at most.
BROADCAST_ROWS = 100_000

# fixed values: Spark types in which lexical forms are tested
LEXICAL = {"integer": "bigint", "int": "int", "long": "bigint", "short": "smallint", "double": "double", "float": "float", "decimal": "decimal(38,18)", "boolean": "boolean", "dateTime": "timestamp", "date": "date"}


def constraints(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Constraint rows from dicts; severity is Violation where not given."""
    full = [{f: r.get(f) for f in CONSTRAINT.fieldNames()} | {"severity": r.get("severity") or "Violation", "param": None if r.get("param") is None else str(r["param"])} for r in rows]
    for r in full:
        if r["kind"] not in KINDS:
            raise ValueError(f"no such constraint: {r['kind']}")
    return spark.createDataFrame([tuple(r.values()) for r in full], CONSTRAINT)


def _small(rules: DataFrame) -> DataFrame:
    return F.broadcast(rules) if rules.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else _large(rules)


def _large(df: DataFrame) -> DataFrame:
    """One side of a join of which neither side is broadcast."""
    return df.hint("merge")


def focus_nodes(triples: DataFrame, rules: DataFrame) -> DataFrame:
    """(s, target_class) of the targeted classes' members, by the subclass links that the triples hold."""
    types = triples.where(F.col("p") == vocab.RDF_TYPE).select("s", F.col("o").alias("cls"))
    wanted = rules.select("target_class").distinct()
    direct = types.join(_small(wanted), types.cls == wanted.target_class).select("s", "target_class")
    links = triples.where(F.col("p") == f"{vocab.RDFS}subClassOf").select(F.col("s").alias("cls"), F.col("o").alias("parent"))
    if links.limit(1).count():
        from .hierarchy import closure

        below = closure(links).where("dist > 0").select("cls", F.col("ancestor").alias("target_class")).join(_small(wanted), "target_class")
        direct = direct.unionByName(types.join(_small(below), "cls").select("s", "target_class")).distinct()
    return direct


def _found(df: DataFrame, value: Column, message: Column) -> DataFrame:
    return df.select("shape", F.col("s").alias("focus"), "path", F.col("kind").alias("constraint"), value.cast("string").alias("value"), "severity", F.coalesce("message", message).alias("message"))


ON_VALUES = ["datatype", "nodeKind", "in", "pattern", "minInclusive", "maxInclusive", "minExclusive", "maxExclusive"]


def _in_range(value: Column, limit: Column, kind: Column) -> Column:
    """Whether a value keeps a range's limit; null where the two cannot be compared."""

    def kept(x: Column, y: Column) -> Column:
        return F.when(kind == "minInclusive", x >= y).when(kind == "maxInclusive", x <= y).when(kind == "minExclusive", x > y).otherwise(x < y)

    def typed(name: str) -> Column:
        return kept(value.try_cast(name), limit.try_cast(name))

    return F.when(limit.rlike(r"^-?\d{4,}-\d\d-\d\d"), typed("timestamp")).otherwise(F.coalesce(typed("decimal(38,18)"), typed("double")))


def _value_conforms() -> Column:
    """Whether a value (o, o_kind, o_datatype) keeps its constraint (kind, param, items)."""
    kind, param = F.col("kind"), F.col("param")
    fits = F.lit(True)
    for name, lexical in LEXICAL.items():
        fits = F.when(param == f"{vocab.XSD}{name}", F.col("o").try_cast(lexical).isNotNull()).otherwise(fits)
    datatype = (F.col("o_kind") == "literal") & (F.coalesce("o_datatype", F.lit(f"{vocab.XSD}string")) == param) & fits
    node = F.when(param.endswith("BlankNodeOrIRI"), F.col("o_kind") != "literal").when(param.endswith("Literal"), F.col("o_kind") == "literal").when(param.endswith("IRI"), F.col("o_kind") == "iri").otherwise(F.col("o_kind") == "bnode")
    listed = F.array_contains("items", F.when(F.col("o_kind") == "iri", F.concat(F.lit("<"), "o", F.lit(">"))).otherwise(F.col("o")))
    ranged = (F.col("o_kind") == "literal") & F.coalesce(_in_range(F.col("o"), param, kind), F.lit(False))
    return F.when(kind == "datatype", datatype).when(kind == "nodeKind", node).when(kind == "in", F.coalesce(listed, F.lit(False))).when(kind == "pattern", F.rlike(F.col("o"), param)).otherwise(ranged)


def findings(triples: DataFrame, rules: DataFrame) -> DataFrame:
    """(shape, focus, path, constraint, value, severity, message) of all that does not conform."""
    kinds = {r.kind for r in rules.select("kind").distinct().collect()}
    focus = focus_nodes(triples, rules)
    values = triples.select("s", F.col("p").alias("path"), "o", "o_kind", "o_datatype")
    out: list[DataFrame] = []

    def wanted(*names: str) -> DataFrame:
        """The focus nodes with the constraints of these kinds that hold for them."""
        return focus.join(_small(rules.where(F.col("kind").isin(*names))), "target_class")

    def named(*names: str) -> DataFrame:
        """The values whose paths constraints of these kinds name."""
        return values.join(_small(rules.where(F.col("kind").isin(*names)).select("path").distinct()), "path", "left_semi")

    def told(*names: str) -> bool:
        return bool(kinds & set(names))

    if told(*ON_VALUES):
        text = F.when(F.col("kind") == "datatype", F.format_string("value is not a %s", "param")).when(F.col("kind") == "nodeKind", F.format_string("value is no %s", F.substring_index("param", "#", -1)))
        text = text.when(F.col("kind") == "in", "value is not in the list").when(F.col("kind") == "pattern", F.format_string("value does not match %s", "param")).otherwise(F.format_string("value fails %s %s", "kind", "param"))
        held = focus.join(_large(named(*ON_VALUES)), "s").join(_small(rules.where(F.col("kind").isin(*ON_VALUES))), ["target_class", "path"])
        out.append(_found(held.where(~_value_conforms()), F.col("o"), text))
    if told("maxCount", "minCount"):
        counts = named("maxCount", "minCount").groupBy("s", "path").agg(F.count("*").alias("n"))
        n, limit, most = F.coalesce("n", F.lit(0)), F.col("param").cast("long"), F.col("kind") == "maxCount"
        text = F.format_string("%s than %s values", F.when(most, "more").otherwise("fewer"), "param")
        out.append(_found(wanted("maxCount", "minCount").join(_large(counts), ["s", "path"], "left").where(F.when(most, n > limit).otherwise(n < limit)), n, text))
    if told("class"):
        members = focus_nodes(triples, rules.where("kind = 'class'").select(F.col("param").alias("target_class"))).select(F.col("s").alias("o"), F.col("target_class").alias("param"))
        held = wanted("class").join(_large(named("class")), ["s", "path"])
        out.append(_found(held.join(_large(members), ["o", "param"], "left_anti"), F.col("o"), F.format_string("value is no %s", "param")))
    if told("hasValue"):
        asked = rules.where("kind = 'hasValue'").select("path", "param").distinct()
        there = values.select("s", "path", F.col("o").alias("param")).join(_small(asked), ["path", "param"], "left_semi")
        out.append(_found(wanted("hasValue").join(_large(there), ["s", "path", "param"], "left_anti"), F.col("param"), F.lit("the value is missing")))
    if told("closed"):
        allowed = rules.where("kind <> 'closed' and path is not null").groupBy("shape").agg(F.collect_set("path").alias("paths"))
        closed = rules.where("kind = 'closed'").drop("path").join(allowed, "shape", "left")
        every = F.array_union(F.coalesce("paths", F.array().cast("array<string>")), F.coalesce("items", F.array().cast("array<string>")))
        held = focus.join(_small(closed.select("target_class").distinct()), "target_class", "left_semi").join(_large(values), "s")
        df = held.join(_small(closed.withColumn("known", every)), "target_class").where(~F.array_contains("known", F.col("path")))
        out.append(_found(df, F.col("o"), F.lit("the shape is closed and does not know this property")))
    empty = triples.sparkSession.createDataFrame([], "shape string, focus string, path string, constraint string, value string, severity string, message string")
    return reduce(DataFrame.unionByName, out, empty)


def report(found: DataFrame) -> DataFrame:
    """One row: violations, warnings, infos, and whether there is no finding at all."""
    return found.agg(F.count_if(F.col("severity") == "Violation").alias("violation"), F.count_if(F.col("severity") == "Warning").alias("warning"), F.count_if(F.col("severity") == "Info").alias("info"), (F.count("*") == 0).alias("conforms"))


def validate(triples: DataFrame, rules: DataFrame) -> tuple[bool, DataFrame]:
    """Whether the triples conform, and the findings, persisted: unpersist them when done."""
    found = findings(triples, rules).persist()
    return found.isEmpty(), found


#: Properties that closed shapes leave to provenance and units.
IGNORED = [vocab.RDF_TYPE, f"{vocab.PROV}wasGeneratedBy", f"{vocab.PROV}wasAttributedTo", f"{vocab.DCTERMS}created", f"{vocab.DCTERMS}source", f"{vocab.QUDT}hasUnit"]


def generate(schema, units: dict[str, list[str]] | None = None) -> list[dict]:
    """Constraint rows for a schema: a closed shape for each class that is neither abstract nor a mixin.

    ``units`` lists the unit IRIs found in each class's slots, in the order met.
    """
    out = []
    for name, cls in schema.classes.items():
        if cls.get("abstract") or cls.get("mixin"):
            continue
        iri = schema.iri(name)
        shape = {"shape": iri, "target_class": iri}
        out.append(shape | {"kind": "closed", "param": "true", "items": IGNORED})
        for slot in schema.induced(name):
            info, path = schema.slots.get(slot, {}), schema.iri(slot)
            kind = schema.range(slot, name)
            if not info.get("multivalued"):
                out.append(shape | {"path": path, "kind": "maxCount", "param": 1})
            if info.get("required") or info.get("identifier"):
                out.append(shape | {"path": path, "kind": "minCount", "param": 1})
            if kind in schema.classes:
                out += [shape | {"path": path, "kind": "class", "param": schema.iri(kind)}, shape | {"path": path, "kind": "nodeKind", "param": f"{vocab.SHACL}BlankNodeOrIRI"}]
            elif kind in schema.enums:
                out.append(shape | {"path": path, "kind": "in", "items": list(schema.enums[kind])})
            else:
                if kind not in ("uri", "uriorcurie", "curie"):
                    out.append(shape | {"path": path, "kind": "datatype", "param": f"{vocab.XSD}{vocab.LITERAL_TYPES.get(kind, 'string')}"})
                    out.append(shape | {"path": path, "kind": "nodeKind", "param": f"{vocab.SHACL}Literal"})
        if units and units.get(name):
            out.append(shape | {"path": f"{vocab.QUDT}hasUnit", "kind": "in", "items": [f"<{u}>" for u in units[name]]})
    return out


def class_units(slots: DataFrame) -> DataFrame:
    """(cls, units): distinct units of a class's slots in order of first sight, from (cls, slot, pos, unit)."""
    first = slots.where("unit is not null").groupBy("cls", "unit").agg(F.min("pos").alias("pos"))
    return first.groupBy("cls").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "unit"))), lambda x: x["unit"]).alias("units"))
