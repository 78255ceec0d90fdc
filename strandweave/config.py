"""Settings from a TOML file, the environment and the command line, the later winning."""

from __future__ import annotations

import os
import tomllib
from pathlib import Path
from typing import Any

FILE = "strandweave.toml"
LEAD = "STRANDWEAVE"


def load(path: str | Path = FILE) -> dict[str, Any]:
    """The file's settings; none where there is no file."""
    path = Path(path)
    return tomllib.loads(path.read_text(encoding="utf-8")) if path.is_file() else {}


def get(config: dict[str, Any], section: str, key: str, given: Any = None, default: Any = None) -> Any:
    """A setting: as given, else from STRANDWEAVE_SECTION_KEY, else from the file, else the default."""
    if given is not None:
        return given
    told = os.environ.get(f"{LEAD}_{section}_{key}".upper().replace("-", "_"))
    return told if told is not None else config.get(section, {}).get(key, default)


def conversion_policies(config: dict[str, Any]) -> dict[str, str]:
    """Datatype pairs and unit pairs with the function that converts; values that are no text are left out."""
    section = config.get("conversions") or {}
    out: dict[str, str] = {}
    for part in (section, section.get("types") or {}, section.get("units") or {}):
        out |= {k: v for k, v in part.items() if isinstance(v, str)}
    return out


def library(config: dict[str, Any]):
    """The built-in functions and those of the declaration and Python files that [functions] lists.

    A Python file registers bodies in a dict ``FUNCTIONS`` of names to functions on columns.
    """
    import runpy

    from .functions.registry import Declaration, FunctionLibrary

    out = FunctionLibrary.builtins()
    section = config.get("functions") or {}
    for kind in ("declarations", "udfs"):
        for name in section.get(kind) or []:
            if not Path(name).is_file():
                raise ValueError(f"[functions] lists {name}, which is no file")
    for name in section.get("declarations") or []:
        out.add_turtle(Path(name).read_text(encoding="utf-8"))
    own: dict[str, str] = {}
    for name in section.get("udfs") or []:
        for curie, body in (runpy.run_path(name).get("FUNCTIONS") or {}).items():
            if curie in own:
                raise ValueError(f"{curie} has a body in {own[curie]} and in {name}")
            own[curie] = name
            known = out.functions.get(out.normalise(curie))
            out.declare(Declaration(curie, known.parameter if known else "grel:valueParameter", known.input_type if known else None, known.output_type if known else None, body), override=True)
    return out
