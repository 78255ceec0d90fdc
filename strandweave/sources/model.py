"""A schema as ordered classes, slots and enums, and its tables.

Schemas are kilobytes and live on the driver; ``*_rows`` and ``*_edges`` give them as DataFrames where they
meet mapping rows or data.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession

from .. import vocab
from ..functions.text import title

FORMAT_KEY = "source_format"
PATH_KEYS = {"csv": "csv_column", "json": "json_path", "xml": "xml_path"}


def _plain_key(key: str) -> str:
    """Annotation keys of other tools may carry a lead word before ours."""
    return next((k for k in (FORMAT_KEY, *PATH_KEYS.values()) if key == k or key.endswith(f"_{k}")), key)


@dataclass
class Schema:
    name: str
    id: str = ""
    default_prefix: str = ""
    prefixes: dict[str, str] = field(default_factory=dict)
    classes: dict[str, dict[str, Any]] = field(default_factory=dict)
    slots: dict[str, dict[str, Any]] = field(default_factory=dict)
    enums: dict[str, list[str]] = field(default_factory=dict)
    annotations: dict[str, str] = field(default_factory=dict)
    default_range: str = "string"

    def __post_init__(self) -> None:
        self.default_prefix = self.default_prefix or self.name
        self.id = self.id or f"https://w3id.org/{self.name}"
        self.prefixes.setdefault(self.default_prefix, f"{self.id.rstrip('/#')}/")

    @property
    def source_format(self) -> str | None:
        return self.annotations.get(FORMAT_KEY)

    def iri(self, name: str) -> str:
        return f"{self.prefixes.get(self.default_prefix, '')}{name}"

    def range(self, slot: str, cls: str | None = None) -> str:
        """A slot's range, refined by the class's own usage."""
        usage = (self.classes.get(cls or "", {}).get("slot_usage") or {}).get(slot) or {}
        own = (self.classes.get(cls or "", {}).get("attributes") or {}).get(slot) or {}
        return usage.get("range") or own.get("range") or self.slots.get(slot, {}).get("range") or self.default_range

    def path(self, slot: str) -> str | None:
        notes = self.slots.get(slot, {}).get("annotations", {})
        return next((notes[k] for k in PATH_KEYS.values() if k in notes), None)

    def identifier(self, cls: str | None = None) -> str:
        """The identifying slot of a class, or the first slot; ValueError for a class without slots."""
        listed = self.induced(cls) if cls in self.classes else list(self.slots)
        for s in listed:
            if self.slots.get(s, {}).get("identifier"):
                return self.path(s) or s
        if not listed:
            raise ValueError(f"class {cls!r} has no slot to make subjects of")
        return self.path(listed[0]) or listed[0]

    def ancestors(self, cls: str) -> list[str]:
        """The class, those above it, and the mixins of each."""
        out: list[str] = []
        todo = [cls]
        while todo:
            c = todo.pop(0)
            if c in self.classes and c not in out:
                out.append(c)
                todo += [*(self.classes[c].get("mixins") or []), *([self.classes[c]["is_a"]] if self.classes[c].get("is_a") else [])]
        return out

    def induced(self, cls: str) -> list[str]:
        out: dict[str, None] = {}
        for c in self.ancestors(cls):
            out |= dict.fromkeys([*(self.classes[c].get("slots") or []), *(self.classes[c].get("attributes") or {})])
        return list(out)

    def names(self, spark: SparkSession) -> DataFrame:
        """(name, is_class, is_slot)."""
        rows = [(n, n in self.classes, n in self.slots) for n in {**self.classes, **self.slots}]
        return spark.createDataFrame(rows, "name string, is_class boolean, is_slot boolean")

    def class_edges(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(n, c.get("is_a")) for n, c in self.classes.items()], "cls string, parent string")

    def class_slot_rows(self, spark: SparkSession) -> DataFrame:
        rows = [(n, s, i) for i, (n, c) in enumerate(self.classes.items()) for s in [*(c.get("slots") or []), *(c.get("attributes") or {})]]
        return spark.createDataFrame(rows, "cls string, slot string, pos int")

    def class_rows(self, spark: SparkSession) -> DataFrame:
        return self.class_edges(spark)

    def slot_rows(self, spark: SparkSession) -> DataFrame:
        rows = [(n, s.get("is_a"), bool(s.get("required")), bool(s.get("multivalued"))) for n, s in self.slots.items()]
        return spark.createDataFrame(rows, "slot string, parent string, required boolean, multivalued boolean")

    def nodes(self, spark: SparkSession, definitions: bool = False, parents: bool = False, children: bool = False, ancestors: bool = False) -> DataFrame:
        """(node_id, label, text, datatype, pos) of classes and slots; a slot replaces a class of its name.

        Text parts after the label are joined by full stops; ancestors stand in for parents.
        """
        both = {**self.classes, **self.slots}
        rows = []
        for pos, (name, node) in enumerate(both.items()):
            label = node.get("title") or title(name)
            parts = [label]
            if definitions and node.get("description"):
                parts.append(node["description"])
            if ancestors:
                parts += [both[a].get("title") or title(a) for a in self.ancestors(name)[1:]]
            elif parents and node.get("is_a"):
                parts.append(title(node["is_a"]))
            if children:
                parts += [title(n) for n, other in both.items() if other.get("is_a") == name]
            rows.append((f"{self.name}:{name}", label, ". ".join(parts), self.range(name) if name in self.slots else None, pos))
        return spark.createDataFrame(rows, "node_id string, label string, text string, datatype string, pos int")

    def stamp(self, source_format: str) -> None:
        """Say the format, and how each slot is reached in it; formats without data stay unstamped."""
        kind = {"csv": "csv", "tsv": "csv", "json-schema": "json", "json-sample": "json", "openapi": "json", "xsd": "xml"}.get(source_format)
        if kind is None:
            return
        self.annotations[FORMAT_KEY] = kind
        lead = {"csv": "", "json": "$.", "xml": "./"}[kind]
        for name, slot in self.slots.items():
            slot.setdefault("annotations", {})[PATH_KEYS[kind]] = f"{lead}{name}"

    def plain_ranges(self) -> None:
        """XSD names of ranges become the schema's own."""
        for slot in self.slots.values():
            slot["range"] = vocab.XSD_RANGES.get(slot.get("range") or "", slot.get("range"))

    def to_yaml(self) -> str:
        def named(items: dict) -> dict:
            return {n: {"name": n, **{k: v for k, v in x.items() if v not in (None, [], {})}} for n, x in items.items()}

        out = {"name": self.name, "id": self.id, "imports": ["linkml:types"], "default_prefix": self.default_prefix, "default_range": self.default_range, "annotations": dict(self.annotations)}
        out["prefixes"] = {p: {"prefix_prefix": p, "prefix_reference": iri} for p, iri in self.prefixes.items()}
        out |= {"classes": named(self.classes), "slots": named(self.slots)}
        if self.enums:
            out["enums"] = {n: {"name": n, "permissible_values": {v: {"text": v} for v in values}} for n, values in self.enums.items()}
        return yaml.safe_dump({k: v for k, v in out.items() if v not in (None, {}, [])}, sort_keys=False, allow_unicode=True)

    @classmethod
    def from_yaml(cls, text: str) -> Schema:
        """A LinkML document; ValueError where it is none."""
        raw = yaml.safe_load(text)
        if not isinstance(raw, dict) or "name" not in raw:
            raise ValueError("not a schema: it has no name")
        prefixes = {p: (x.get("prefix_reference") if isinstance(x, dict) else x) for p, x in (raw.get("prefixes") or {}).items()}
        notes = {_plain_key(k): (v.get("value") if isinstance(v, dict) else v) for k, v in (raw.get("annotations") or {}).items()}
        enums = {n: list((e or {}).get("permissible_values") or {}) for n, e in (raw.get("enums") or {}).items()}
        out = cls(raw["name"], raw.get("id", ""), raw.get("default_prefix", ""), prefixes, {n: dict(c or {}) for n, c in (raw.get("classes") or {}).items()}, {n: dict(s or {}) for n, s in (raw.get("slots") or {}).items()}, enums, notes, raw.get("default_range") or "string")
        for items in (out.classes, out.slots):
            for n, x in items.items():
                x.pop("name", None)
                if isinstance(x.get("annotations"), dict):
                    x["annotations"] = {_plain_key(k): (v.get("value") if isinstance(v, dict) else v) for k, v in x["annotations"].items()}
                items[n] = x
        return out
