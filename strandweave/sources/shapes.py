"""Shape files to constraint rows, and back."""

from __future__ import annotations

import os
import warnings
from pathlib import Path

from .. import vocab
from .turtle import Graph, TurtleError, parse

SH = vocab.SHACL
_VALUES = ["maxCount", "minCount", "datatype", "nodeKind", "class", "minInclusive", "maxInclusive", "minExclusive", "maxExclusive", "pattern", "hasValue"]


def constraint_rows(graph: Graph) -> list[dict]:
    """Constraint rows of a shapes graph."""
    out = []
    for shape in graph.subjects(vocab.RDF_TYPE, f"{SH}NodeShape"):
        targets = [t.value for t in graph.values(shape, f"{SH}targetClass")]
        if any(t.value == f"{vocab.RDFS}Class" for t in graph.values(shape, vocab.RDF_TYPE)):
            targets.append(shape)
        for target in targets or ([shape] if graph.value(shape, f"{SH}closed") else []):
            base = {"shape": shape, "target_class": target}
            if graph.value(shape, f"{SH}closed") == "true":
                out.append(base | {"kind": "closed", "param": "true", "items": list(graph.items(graph.value(shape, f"{SH}ignoredProperties")))})
            for prop in graph.values(shape, f"{SH}property"):
                p = prop.value
                path = graph.value(p, f"{SH}path")
                told = {"path": path, "severity": (graph.value(p, f"{SH}severity") or f"{SH}Violation").rsplit("#", 1)[-1], "message": graph.value(p, f"{SH}message")}
                before = len(out)
                out += [base | told | {"kind": k, "param": v.value} for k in _VALUES for v in graph.values(p, f"{SH}{k}")]
                if (head := graph.value(p, f"{SH}in")) is not None:
                    out.append(base | told | {"kind": "in", "items": [f"<{t.value}>" if t.kind == "iri" else t.value for t in graph.terms(head)]})
                if len(out) == before and path:  # a bare path still opens a closed shape
                    out.append(base | told | {"kind": "minCount", "param": 0})
    return out


def load(path: str | Path) -> list[dict]:
    """Constraint rows of a file, or of all .ttl files under a folder, links not followed, in name order."""
    path = Path(path)
    if path.is_dir():
        files = sorted(Path(d) / f for d, _, names in os.walk(path, followlinks=False) for f in names if f.endswith(".ttl") and not (Path(d) / f).is_symlink())
    elif path.is_file():
        files = [path]
    else:
        raise ValueError(f"no shapes at {path}")
    whole = Graph()
    for f in files:
        try:
            graph = parse(f.read_text(encoding="utf-8"))
        except (TurtleError, UnicodeDecodeError) as error:
            raise ValueError(f"{f}: {error}") from error
        if not graph.subjects(vocab.RDF_TYPE, f"{SH}NodeShape"):
            warnings.warn(f"{f} has no shapes", stacklevel=2)
        whole.merge(graph)
    rows = constraint_rows(whole)
    if not rows:
        raise ValueError(f"no shapes at {path}")
    return rows


def to_turtle(rows: list[dict]) -> str:
    """Constraint rows as a shapes document."""
    by_shape: dict[str, dict] = {}
    for r in rows:
        shape = by_shape.setdefault(r["shape"], {"target": r["target_class"], "closed": None, "paths": {}})
        if r["kind"] == "closed":
            shape["closed"] = r.get("items") or []
        else:
            shape["paths"].setdefault(r["path"], []).append(r)
    lines = [f"@prefix sh: <{SH}> .", f"@prefix xsd: <{vocab.XSD}> .", ""]
    for shape, x in by_shape.items():
        parts = [f"<{shape}> a sh:NodeShape", f"    sh:targetClass <{x['target']}>"]
        if x["closed"] is not None:
            parts += ["    sh:closed true", "    sh:ignoredProperties ( " + " ".join(f"<{i}>" for i in x["closed"]) + " )"]
        for path, rules in x["paths"].items():
            told = [f"sh:path <{path}>"]
            for r in rules:
                if r["kind"] == "in":
                    told.append("sh:in ( " + " ".join(i if i.startswith("<") and i.endswith(">") else f'"{i}"' for i in r["items"]) + " )")
                elif r["kind"] in ("datatype", "nodeKind", "class"):
                    told.append(f"sh:{r['kind']} <{r['param']}>")
                elif r["kind"] in ("pattern", "hasValue"):
                    told.append(f"sh:{r['kind']} \"{r['param']}\"")
                else:
                    told.append(f"sh:{r['kind']} {r['param']}")
            parts.append("    sh:property [ " + " ; ".join(told) + " ]")
        lines.append(" ;\n".join(parts) + " .\n")
    return "\n".join(lines)
