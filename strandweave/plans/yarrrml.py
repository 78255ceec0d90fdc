"""YARRRML text to a plan, and a plan to YARRRML text."""

from __future__ import annotations

import re

import yaml

from .. import vocab
from ..functions.registry import FunctionLibrary
from ..functions.text import expand_name
from .mapping import ClassRule, MappingPlan, SlotRule

PLACEHOLDER = "$(DATA_FILE)"


def to_yarrrml(plan: MappingPlan, library: FunctionLibrary | None = None) -> str:
    """The plan as text that names its data by a placeholder."""
    library = library or FunctionLibrary.builtins()
    mappings = {}
    for c in plan.classes:
        po: list = [["a", f"{plan.target_prefix}:{c.name}"]]
        for s in c.slots:
            kind = vocab.LITERAL_TYPES.get(s.datatype or "")
            name = f"{plan.target_prefix}:{s.name}"
            ref = s.expr if s.expr is not None else f"$({(s.path or s.source).removeprefix('$.').removeprefix('./')})"
            if s.function:
                entry: dict = {"function": library.iri(s.function), "parameters": [[library.get(s.function).parameter, ref]]}
                po.append({"predicates": name, "objects": [entry | ({"datatype": f"xsd:{kind}"} if kind else {})]})
            elif s.name in plan.references:
                po.append([name, f"{ref}~iri"])
            else:
                po.append([name, ref, f"xsd:{kind}"] if kind else [name, ref])
        mappings[c.name] = {"sources": [[f"{PLACEHOLDER}~{plan.source_format}"]], "s": c.subject, "po": po}
    return yaml.safe_dump({"prefixes": plan.prefixes | {"fns": vocab.FUNCTIONS}, "mappings": mappings}, sort_keys=False, allow_unicode=True)


def from_yarrrml(text: str, library: FunctionLibrary | None = None) -> MappingPlan:
    """The plan of a document with prefixes, mappings and the data placeholder; ValueError where one lacks."""
    if PLACEHOLDER not in text:
        raise ValueError(f"the mapping lacks the placeholder {PLACEHOLDER}")
    library = library or FunctionLibrary.builtins()
    raw = yaml.safe_load(text)
    if not isinstance(raw, dict) or not isinstance(raw.get("mappings"), dict):
        raise ValueError("the document has no mappings")
    prefixes = raw.get("prefixes") or {}
    classes, references, target = [], {}, ""
    source_format = "csv"
    for name, m in raw["mappings"].items():
        source = str((m.get("sources") or [["~csv"]])[0])
        source_format = {"jsonpath": "json", "xpath": "xml"}.get(re.split(r"['\]]", source.rpartition("~")[2])[0], re.split(r"['\]]", source.rpartition("~")[2])[0])
        rule = ClassRule(name, name, str(m.get("s") or m.get("subjects")))
        for po in m.get("po") or m.get("predicateobjects") or []:
            p, objects, kind = (po.get("predicates") or po.get("p"), po.get("objects") or po.get("o"), po.get("datatype")) if isinstance(po, dict) else (po[0], po[1], po[2] if len(po) > 2 else None)
            if p in ("a", "rdf:type"):
                target, _, rule.name = str(objects).rpartition(":")
                continue
            if isinstance(objects, list) and len(objects) == 1:
                objects = objects[0]
            slot = str(p).partition(":")[2] or str(p)
            lead = str(p).partition(":")[0]
            entry = SlotRule(slot if lead == target or not target else expand_name(str(p), prefixes))
            if isinstance(objects, dict):
                entry.function = library.normalise(expand_name(objects["function"], prefixes))
                ref = str(objects["parameters"][0][1])
                kind = objects.get("datatype", kind)
            else:
                ref = str(objects)
            if ref.endswith("~iri"):
                ref = ref.removesuffix("~iri")
                references[entry.name] = "iri"
            if ref.startswith("["):
                entry.expr = ref
            else:
                entry.source = m2[1] if (m2 := re.fullmatch(r"\$\(([^)]*)\)", ref)) else ref
            local = str(kind).rpartition(":")[2] if kind else None
            entry.datatype = {"dateTime": "datetime"}.get(local, local) if local else None
            rule.slots.append(entry)
        rule.subject = expand_name(rule.subject, prefixes)
        classes.append(rule)
    return MappingPlan("mapping", "mapping", source_format, prefixes, target, classes, references)
