"""Conversion functions by identifier: declarations, and native column bodies."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from .text import expand_name

Body = Callable[[Column], Column]


def _double(x: Column) -> Column:
    return x.try_cast("double")


# fixed values: parameters, types and factors of the built-in conversions
BUILTINS: dict[str, tuple[str, str, str, Body]] = {
    "fns:meterToFoot": ("grel:valueParameter", "xsd:decimal", "xsd:decimal", lambda x: _double(x) * 3.28084),
    "fns:footToMeter": ("grel:valueParameter", "xsd:decimal", "xsd:decimal", lambda x: _double(x) * 0.3048),
    "fns:kgToPound": ("grel:valueParameter", "xsd:decimal", "xsd:decimal", lambda x: _double(x) * 2.20462),
    "fns:poundToKg": ("grel:valueParameter", "xsd:decimal", "xsd:decimal", lambda x: _double(x) / 2.20462),
    "fns:celsiusToFahrenheit": ("grel:valueParameter", "xsd:decimal", "xsd:decimal", lambda x: _double(x) * 1.8 + 32),
    "fns:kelvinToCelsius": ("grel:valueParameter", "xsd:decimal", "xsd:decimal", lambda x: _double(x) - 273.15),
    "grel:math_round": ("grel:p_dec_n", "xsd:decimal", "xsd:integer", lambda x: F.round(_double(x)).cast("bigint")),
    "grel:math_floor": ("grel:p_dec_n", "xsd:decimal", "xsd:integer", lambda x: F.floor(_double(x)).cast("bigint")),
    "grel:math_ceil": ("grel:p_dec_n", "xsd:decimal", "xsd:integer", lambda x: F.ceil(_double(x)).cast("bigint")),
    "grel:string_toNumber": ("grel:p_any_e", "xsd:string", "xsd:double", _double),
    "grel:string_toString": ("grel:p_any_e", "xsd:anySimpleType", "xsd:string", lambda x: x.cast("string")),
}


@dataclass
class Declaration:
    """One function: its CURIE, parameter, and input and output types."""

    curie: str
    parameter: str = "grel:valueParameter"
    input_type: str | None = None
    output_type: str | None = None
    body: Body | None = None


@dataclass
class FunctionLibrary:
    """Declared functions and the prefixes that name them."""

    functions: dict[str, Declaration] = field(default_factory=dict)
    prefixes: dict[str, str] = field(default_factory=lambda: {"fns": vocab.FUNCTIONS, "grel": vocab.GREL, "xsd": vocab.XSD})

    @classmethod
    def builtins(cls) -> FunctionLibrary:
        out = cls()
        for curie, (parameter, given, result, body) in BUILTINS.items():
            out.functions[curie] = Declaration(curie, parameter, input_type=given, output_type=result, body=body)
        return out

    def declare(self, declaration: Declaration, override: bool = False) -> None:
        """Add a function; a name that is taken needs ``override``."""
        curie = self.normalise(declaration.curie)
        if curie in self.functions and self.functions[curie].body and declaration.body and not override:
            raise ValueError(f"the function {curie} is declared twice")
        known = self.functions.get(curie)
        self.functions[curie] = Declaration(curie, declaration.parameter, declaration.input_type, declaration.output_type, declaration.body or (known.body if known else None))

    def add_turtle(self, text: str) -> None:
        """Add the functions of an FnO document; of each list only the first parameter and output count."""
        from ..sources.turtle import parse

        graph = parse(text)
        self.prefixes |= graph.prefixes
        for s in graph.subjects(vocab.RDF_TYPE, f"{vocab.FNO}Function"):
            given, result = (next(iter(graph.items(graph.value(s, f"{vocab.FNO}{p}"))), None) for p in ("expects", "returns"))
            types = [self.normalise(graph.value(x, f"{vocab.FNO}type") or "") or None if x else None for x in (given, result)]
            parameter = self.normalise(graph.value(given, f"{vocab.FNO}predicate") or "") if given else ""
            self.declare(Declaration(self.normalise(s), parameter or "grel:valueParameter", *types), override=True)

    def normalise(self, name: str) -> str:
        """The CURIE of an IRI under a known prefix."""
        for prefix, space in sorted(self.prefixes.items(), key=lambda kv: -len(kv[1])):
            if name.startswith(space):
                return f"{prefix}:{name[len(space):]}"
        return name

    def has(self, name: str) -> bool:
        return self.normalise(name) in self.functions

    def get(self, name: str) -> Declaration:
        """The declaration; KeyError where there is none."""
        return self.functions[self.normalise(name)]

    def iri(self, name: str) -> str:
        return expand_name(self.normalise(name), self.prefixes)

    def apply(self, name: str, value: Column) -> Column:
        declared = self.get(name)
        if declared.body is None:
            raise ValueError(f"the function {name} is declared but has no body")
        return declared.body(value)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(d.curie, self.iri(d.curie), d.parameter, d.input_type, d.output_type) for d in self.functions.values()]
        return spark.createDataFrame(rows, "fn string, fn_iri string, parameter string, input_type string, output_type string")


def policies_table(spark: SparkSession, policies: dict) -> DataFrame:
    """(policy, fn) of the conversion policies whose values are names."""
    rows = [(k, v) for k, v in policies.items() if isinstance(v, str)]
    return spark.createDataFrame(rows, "policy string, fn string")
