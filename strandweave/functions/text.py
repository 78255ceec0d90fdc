"""String functions on columns: names, labels, identifiers and templates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def snake_case(name: Column) -> Column:
    """An underscore between a lower-case letter or digit and a capital."""
    return F.regexp_replace(name, "(?<=[a-z0-9])(?=[A-Z])", "_")


def local_name(curie: Column) -> Column:
    """What follows the first colon; all of it without one."""
    return F.regexp_replace(curie, "^[^:]*:", "")


def unit_label(row_id: Column, label: Column) -> Column:
    """The label, or the identifier's part after its last slash and then its last colon."""
    return F.coalesce(F.nullif(label, F.lit("")), F.substring_index(F.substring_index(row_id, "/", -1), ":", -1))


def title_label(name: Column) -> Column:
    """Underscores as spaces, every letter that follows a non-letter a capital, the others small."""
    lower = F.lower(F.translate(name, "_", " "))
    letters = F.split(lower, "")
    before = F.concat(F.array(F.lit(" ")), letters)
    return F.array_join(F.transform(letters, lambda c, i: F.when(F.get(before, i).rlike(r"\p{L}"), c).otherwise(F.upper(c))), "")


def title(name: str) -> str:
    """``title_label`` of one string on the driver."""
    return name.replace("_", " ").title()


def strip_bom(text: Column) -> Column:
    return F.regexp_replace(text, "^﻿", "")


def slot_path(name: Column, source_format: Column) -> Column:
    """How a slot is reached in its source: the column, a JSON path, or an XML path."""
    return F.when(source_format == "csv", name).when(source_format == "json", F.concat(F.lit("$."), name)).when(source_format == "xml", F.concat(F.lit("./"), name))


def expand(curie: Column, prefixes: dict[str, str]) -> Column:
    """The IRI of a CURIE; anything without a known prefix stays."""
    if not prefixes:
        return curie
    table = F.create_map(*[F.lit(x) for pair in prefixes.items() for x in pair])
    space = F.element_at(table, F.substring_index(curie, ":", 1))
    return F.when(curie.contains(":") & space.isNotNull(), F.concat(space, local_name(curie))).otherwise(curie)


def compact(iri: Column, prefixes: dict[str, str]) -> Column:
    """The CURIE under the longest namespace that the IRI starts with; others stay."""
    out = iri
    for prefix, space in sorted(prefixes.items(), key=lambda kv: len(kv[1])):
        out = F.when(iri.startswith(space), F.concat(F.lit(f"{prefix}:"), F.substring(iri, F.lit(len(space) + 1), F.length(iri)))).otherwise(out)
    return out


def expand_name(curie: str, prefixes: dict[str, str]) -> str:
    head, colon, tail = curie.partition(":")
    return prefixes[head] + tail if colon and head in prefixes else curie


def encode_iri(value: Column) -> Column:
    """Percent-encoding of everything but unreserved characters."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.url_encode(value), r"\+", "%20"), r"\*", "%2A"), "%7E", "~")


def template(text: str, columns: dict[str, Column], iri: bool = True) -> Column:
    """``$(name)`` references filled in; null where one of them is, percent-encoded for IRIs."""
    parts = []
    for i, part in enumerate(re.split(r"\$\(([^)]*)\)", text)):
        if i % 2:
            if part not in columns:
                raise ValueError(f"the template {text!r} refers to {part!r}, which is no column")
            value = columns[part].cast("string")
            parts.append(encode_iri(value) if iri else value)
        elif part:
            parts.append(F.lit(part))
    return F.concat(*parts) if parts else F.lit("")


def merge_prefixes(*maps: dict[str, str]) -> dict[str, str]:
    """Later maps win."""
    out: dict[str, str] = {}
    for m in maps:
        out |= m
    return out
