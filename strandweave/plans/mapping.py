"""From approved mapping rows to a mapping plan.

Rows are filtered in stages, classified against both schemas, composites are resolved, inherited slots are
moved to the class that is mapped, and the result is a small plan that the materialiser turns into one
DataFrame expression per class.  Filtering and classification are joins over mapping rows; the plan itself is
a handful of objects on the driver.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions.registry import FunctionLibrary
from ..functions.text import local_name, merge_prefixes
from ..operators import hierarchy
from ..sources.model import Schema

STAGES = ["different_from", "prefix", "predicate", "justification", "accepted"]


class PlanError(ValueError):
    """Rows that no plan can be made of."""


def stage(prefix: str, include_manual: bool = False) -> Column:
    """The first stage that drops a row, or ``accepted``: negative rows, another source's prefix, predicates
    that do not compile, and rows that are not approved."""
    allowed = [vocab.HC, *([vocab.MMC] if include_manual else [])]
    return (
        F.when(F.col("predicate_id") == vocab.DIFFERENT, "different_from")
        .when(~F.col("subject_id").startswith(f"{prefix}:"), "prefix")
        .when(~F.col("predicate_id").isin(vocab.COMPILED_PREDICATES), "predicate")
        .when(~F.col("mapping_justification").isin(allowed), "justification")
        .otherwise("accepted")
    )


def stage_counts(rows: DataFrame, prefix: str, include_manual: bool = False) -> DataFrame:
    """Rows left after each stage.  Negative rows are dropped silently: they count as left until the end."""
    staged = rows.select(stage(prefix, include_manual).alias("stage"))

    def left(*gone: str) -> Column:
        return F.count_if(~F.col("stage").isin(*gone))

    return staged.agg(F.count("*").alias("total"), left("prefix").alias("after_prefix"), left("prefix", "predicate").alias("after_predicate"), F.count_if(F.col("stage") == "accepted").alias("accepted"), F.count_if(F.col("stage") == "different_from").alias("dropped_different_from"))


def accepted(rows: DataFrame, prefix: str, include_manual: bool = False) -> DataFrame:
    return rows.where(stage(prefix, include_manual) == "accepted")


def composite_groups(rows: DataFrame) -> DataFrame:
    """(mapping_group_id, members, exprs, targets, expr, target, ok): groups need one expression, one target."""
    grouped = rows.where(F.coalesce("mapping_group_id", F.lit("")) != "").groupBy("mapping_group_id")
    some = F.when(F.coalesce("composition_expr", F.lit("")) != "", F.col("composition_expr"))
    out = grouped.agg(F.count("*").alias("members"), F.count_distinct(some).alias("exprs"), F.count_distinct("object_id").alias("targets"), F.min(some).alias("expr"), F.min("object_id").alias("target"))
    return out.withColumn("ok", (F.col("exprs") == 1) & (F.col("targets") == 1))


def classify(rows: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """Rows with subject, object, kind: ``class``, ``slot``, ``subject`` or ``object`` where that side is
    unknown, or ``mixed``.  ``source`` and ``target`` have (name, is_class, is_slot); classes win."""
    left = source.select(F.col("name").alias("subject"), F.col("is_class").alias("sc"), F.col("is_slot").alias("ss"))
    right = target.select(F.col("name").alias("object"), F.col("is_class").alias("oc"), F.col("is_slot").alias("os"))
    out = rows.withColumn("subject", local_name(F.col("subject_id"))).withColumn("object", local_name(F.col("object_id"))).join(left, "subject", "left").join(right, "object", "left")
    sc, ss, oc, os = (F.coalesce(c, F.lit(False)) for c in ("sc", "ss", "oc", "os"))
    kind = F.when(sc & oc, "class").when(ss & os, "slot").when(~sc & ~ss, "subject").when(~oc & ~os, "object").otherwise("mixed")
    return out.withColumn("kind", kind).drop("sc", "ss", "oc", "os")


def missing_required(required: DataFrame, resolved: DataFrame) -> DataFrame:
    """(cls, slot) that a class needs and no mapping fills."""
    return required.select("cls", "slot").distinct().join(resolved.select("cls", "slot"), ["cls", "slot"], "left_anti")


@dataclass
class SlotRule:
    """How one target slot is filled: from a column, maybe through a function, or by an expression."""

    name: str
    source: str | None = None
    expr: str | None = None
    function: str | None = None
    datatype: str | None = None
    path: str | None = None


@dataclass
class ClassRule:
    name: str
    source: str
    subject: str
    slots: list[SlotRule] = field(default_factory=list)


@dataclass
class Coverage:
    total: int = 0
    after_prefix: int = 0
    after_predicate: int = 0
    accepted: int = 0
    dropped_different_from: int = 0
    class_mappings: list[str] = field(default_factory=list)
    slot_mappings: list[str] = field(default_factory=list)
    composite_groups: list[dict] = field(default_factory=list)
    unresolved_subjects: list[dict] = field(default_factory=list)
    unresolved_objects: list[dict] = field(default_factory=list)
    unmapped_required: list[str] = field(default_factory=list)
    datatype_warnings: list[dict] = field(default_factory=list)


@dataclass
class MappingPlan:
    """Everything that materialisation needs."""

    id: str
    title: str
    source_format: str
    prefixes: dict[str, str]
    target_prefix: str
    classes: list[ClassRule] = field(default_factory=list)
    references: dict[str, str] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2, ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> MappingPlan:
        raw = json.loads(text)
        raw["classes"] = [ClassRule(**{**c, "slots": [SlotRule(**s) for s in c["slots"]]}) for c in raw["classes"]]
        return cls(**raw)


def _slot_rule(target: Schema, name: str, row, library: FunctionLibrary | None, source: Schema) -> SlotRule:
    function = None
    if row.conversion_function and library is not None:
        if not library.has(row.conversion_function):
            raise PlanError(f"conversion_function {row.conversion_function!r} of row {row.record_id!r} is not declared")
        function = library.normalise(row.conversion_function)
    return SlotRule(name, source=row.subject, function=function, datatype=target.range(name), path=source.path(row.subject))


def compile_plan(rows: DataFrame, source: Schema, target: Schema, library: FunctionLibrary | None = None, include_manual: bool = False, force: bool = False, latest_only: bool = False) -> tuple[MappingPlan, Coverage]:
    """The plan of a source's approved rows, and what it covers.

    PlanError where nothing is left, a row mixes classes and slots, a group contradicts itself, a slot's
    class is not mapped, a function is not declared, or (unless ``force``) a name is unknown.  Of several
    rules for one slot the last counts, composites after the others.  ``latest_only`` keeps only pairs whose
    latest row is still an approval.
    """
    from ..operators import ledger

    spark = rows.sparkSession
    if not source.default_prefix or not target.default_prefix:
        raise PlanError("both schemas need a default prefix")
    if not source.source_format:
        raise PlanError("the source schema does not say its format")
    coverage = Coverage(**stage_counts(rows, source.default_prefix, include_manual).first().asDict())
    kept = accepted(rows, source.default_prefix, include_manual)
    if latest_only:
        now = ledger.latest(rows).where(ledger.is_rejection()).select(*ledger.PAIR)
        kept = kept.join(now, ledger.PAIR, "left_anti")
    if not coverage.accepted:
        raise PlanError("no approved rows are left for this source")
    for group in composite_groups(kept).where("not ok").collect():
        raise PlanError(f"mapping group {group.mapping_group_id!r} has {group.exprs} expressions and {group.targets} targets; it needs one of each")
    told = classify(kept, source.names(spark), target.names(spark)).orderBy("log_seq").collect()

    edges, listed = target.class_edges(spark), target.class_slot_rows(spark)
    closed = hierarchy.closure(edges)
    owners = {r.slot: r.owner for r in hierarchy.slot_owners(listed, closed).collect()}
    single = [r for r in told if not r.mapping_group_id]
    for r in single:
        if r.kind == "mixed":
            raise PlanError(f"row {r.record_id!r} maps a class to a slot: {r.subject_id} → {r.object_id}")
        if r.kind in ("subject", "object"):
            getattr(coverage, f"unresolved_{r.kind}s").append({"curie": r.subject_id if r.kind == "subject" else r.object_id, "reason": "no class or slot of that name"})
    if not force and (coverage.unresolved_subjects or coverage.unresolved_objects):
        names = [x["curie"] for x in coverage.unresolved_subjects + coverage.unresolved_objects]
        raise PlanError(f"unknown names: {', '.join(names)}")

    classes = {r.object: r.subject for r in single if r.kind == "class"}
    coverage.class_mappings = [f"{r.subject_id} → {r.object_id}" for r in single if r.kind == "class"]
    rules: list[tuple[str, SlotRule]] = []
    for r in single:
        if r.kind == "slot":
            rules.append((owners.get(r.object, ""), _slot_rule(target, r.object, r, library, source)))
            coverage.slot_mappings.append(f"{r.subject_id} → {r.object_id}")
            if r.subject_datatype and r.object_datatype and r.subject_datatype != r.object_datatype:
                coverage.datatype_warnings.append({k: r[k] for k in ("subject_id", "subject_datatype", "object_id", "object_datatype")})
    groups: dict[str, list] = {}
    for r in told:
        if r.mapping_group_id:
            groups.setdefault(r.mapping_group_id, []).append(r)
    for name, members in groups.items():
        slot = members[0].object
        known = slot in target.slots
        coverage.composite_groups.append({"group_id": name, "member_row_ids": [m.record_id or "" for m in members], "target_slot": slot, "resolved": known})
        if known:
            expr = next(m.composition_expr for m in members if m.composition_expr)
            rules.append((owners.get(slot, ""), SlotRule(slot, expr=expr, datatype=target.range(slot))))

    if rules:
        wanted = spark.createDataFrame(sorted({(o,) for o, _ in rules}), "cls string")
        mapped = spark.createDataFrame(sorted((c,) for c in classes), "cls string") if classes else spark.createDataFrame([], "cls string")
        near = {r.cls: r.nearest for r in hierarchy.nearest_mapped(wanted, mapped, closed).collect()}
    plan_classes = {name: ClassRule(name, src, f"{target.prefixes.get(target.default_prefix, '')}{name}/$({source.identifier(src)})") for name, src in classes.items()}
    by_class: dict[str, dict[str, SlotRule]] = {name: {} for name in classes}
    for owner, rule in rules:
        place = near.get(owner)
        if place is None:
            raise PlanError(f"slot {rule.name!r} belongs to class {owner!r}, to which no class is mapped")
        by_class[place][rule.name] = rule
    for name, slots in by_class.items():
        plan_classes[name].slots = list(slots.values())

    required = [(c, s) for c in classes for s in target.induced(c) if target.slots[s].get("required")]
    if required:
        need = spark.createDataFrame(required, "cls string, slot string")
        have = spark.createDataFrame([(c, s) for c, slots in by_class.items() for s in slots] or [("", "")], "cls string, slot string")
        coverage.unmapped_required = [f"{r.cls}.{r.slot}" for r in missing_required(need, have).orderBy("cls", "slot").collect()]
    prefixes = merge_prefixes(vocab.GLOBAL_PREFIXES, target.prefixes, source.prefixes)
    references = {s: target.range(s) for s in target.slots if target.range(s) in target.classes}
    return MappingPlan(f"{source.name}-to-{target.name}", f"{source.name} to {target.name}", source.source_format, prefixes, target.default_prefix, list(plan_classes.values()), references), coverage
