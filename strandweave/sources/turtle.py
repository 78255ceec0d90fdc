"""A reader for the part of Turtle that ontologies, shapes and function declarations use."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urljoin

from pyspark.sql import DataFrame, SparkSession

from .. import vocab


class TurtleError(ValueError):
    """Text that is not Turtle."""


@dataclass(frozen=True)
class Term:
    value: str
    kind: str  # iri, literal or bnode
    datatype: str | None = None
    lang: str | None = None


@dataclass
class Graph:
    """Triples in the order read, without repeats, and an index by subject and property."""

    prefixes: dict[str, str] = field(default_factory=dict)
    triples: dict[tuple[Term, str, Term], None] = field(default_factory=dict)
    _index: dict[tuple[str, str], list[Term]] = field(default_factory=dict)

    def add(self, s: Term, p: str, o: Term) -> None:
        if (s, p, o) not in self.triples:
            self.triples[s, p, o] = None
            self._index.setdefault((s.value, p), []).append(o)

    def values(self, s: str, p: str) -> list[Term]:
        return self._index.get((s, p), [])

    def value(self, s: str | None, p: str) -> str | None:
        found = self.values(s, p) if s else []
        return found[0].value if found else None

    def subjects(self, p: str, o: str) -> list[str]:
        return list(dict.fromkeys(s.value for s, q, x in self.triples if q == p and x.value == o))

    def terms(self, head: str | None) -> Iterator[Term]:
        """The members of a list."""
        seen = set()
        while head and head != f"{vocab.RDF}nil" and head not in seen:
            seen.add(head)
            yield from self.values(head, f"{vocab.RDF}first")[:1]
            head = self.value(head, f"{vocab.RDF}rest")

    def items(self, head: str | None) -> Iterator[str]:
        """The values of a list's members."""
        return (t.value for t in self.terms(head))

    def merge(self, other: Graph) -> Graph:
        self.prefixes |= other.prefixes
        for t in other.triples:
            self.add(*t)
        return self

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(s.value, p, o.value, o.kind, o.datatype, o.lang) for s, p, o in self.triples], vocab.TRIPLE)


_TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)
      | (?P<iri><[^<>"{}|^`\\\s]*>)
      | (?P<long>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*''')
      | (?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
      | (?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
      | (?P<mark>\^\^|[.;,\[\]()](?!\d)|[;,\[\]()])
      | (?P<number>[+-]?(?:\d+\.\d+(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+|\d+))
      | (?P<blank>_:[\w.-]*[\w-])
      | (?P<name>(?:[^\W\d_][\w.-]*)?:(?:(?:[\w:%-]|\\.)(?:[\w:.%-]|\\.)*(?<!\.))?)
      | (?P<word>[A-Za-z]+)""",
    re.VERBOSE | re.DOTALL,
)
_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def _unescape(text: str) -> str:
    def one(m: re.Match) -> str:
        if m[1]:
            return chr(int(m[1], 16))
        if m[2]:
            return chr(int(m[2], 16))
        return _ESCAPES.get(m[3], m[3])

    return re.sub(r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\(.)", one, text, flags=re.DOTALL)


class _Reader:
    def __init__(self, text: str, base: str):
        self.graph, self.base, self.blanks = Graph(), base, 0
        self.tokens, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise TurtleError(f"line {text.count(chr(10), 0, at) + 1}: unexpected {text[at:at + 20]!r}")
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup, m[0], at))
            at = m.end()
        self.text, self.i = text, 0

    def fail(self, wanted: str) -> TurtleError:
        at = self.tokens[self.i][2] if self.i < len(self.tokens) else len(self.text)
        got = self.tokens[self.i][1] if self.i < len(self.tokens) else "the end"
        return TurtleError(f"line {self.text.count(chr(10), 0, at) + 1}: {wanted} expected, not {got!r}")

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.i][:2] if self.i < len(self.tokens) else ("end", "")

    def take(self, mark: str | None = None) -> tuple[str, str]:
        kind, value = self.peek()
        if kind == "end" or (mark is not None and value != mark):
            raise self.fail(repr(mark) if mark else "more text")
        self.i += 1
        return kind, value

    def blank(self) -> Term:
        self.blanks += 1
        return Term(f"_:b{self.blanks}", "bnode")

    def iri(self, kind: str, value: str) -> str:
        if kind == "iri":
            return urljoin(self.base, _unescape(value[1:-1])) if self.base else _unescape(value[1:-1])
        prefix, _, local = value.partition(":")
        if prefix not in self.graph.prefixes:
            raise TurtleError(f"the prefix {prefix!r} is not declared")
        return self.graph.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)

    def document(self) -> Graph:
        while self.peek()[0] != "end":
            kind, value = self.peek()
            if kind in ("at", "word") and value.lstrip("@").lower() in ("prefix", "base"):
                self.take()
                if value.lstrip("@").lower() == "prefix":
                    name = self.take()[1]
                    self.graph.prefixes[name.rstrip(":")] = self.iri(*self.take())
                else:
                    self.base = self.iri(*self.take())
                if kind == "at":
                    self.take(".")
                continue
            alone = value == "["
            subject = self.term()
            if not (alone and self.peek()[1] == "."):
                self.properties(subject)
            self.take(".")
        return self.graph

    def properties(self, subject: Term) -> None:
        while True:
            kind, value = self.take()
            if kind == "word" and value == "a":
                verb = vocab.RDF_TYPE
            elif kind in ("iri", "name"):
                verb = self.iri(kind, value)
            else:
                self.i -= 1
                raise self.fail("a property")
            while True:
                self.graph.add(subject, verb, self.term())
                if self.peek()[1] != ",":
                    break
                self.take()
            while self.peek()[1] == ";":
                self.take()
                if self.peek()[1] in (".", "]", ";"):
                    continue
                break
            else:
                return
            if self.peek()[1] in (".", "]"):
                return

    def term(self) -> Term:
        kind, value = self.take()
        if kind in ("iri", "name"):
            return Term(self.iri(kind, value), "iri")
        if kind == "blank":
            return Term(value, "bnode")
        if value == "[":
            node = self.blank()
            if self.peek()[1] != "]":
                self.properties(node)
            self.take("]")
            return node
        if value == "(":
            cells = []
            while self.peek()[1] != ")":
                cells.append(self.term())
            self.take(")")
            head = Term(f"{vocab.RDF}nil", "iri")
            for cell in reversed(cells):
                node = self.blank()
                self.graph.add(node, f"{vocab.RDF}first", cell)
                self.graph.add(node, f"{vocab.RDF}rest", head)
                head = node
            return head
        if kind in ("string", "long"):
            text = _unescape(value[3:-3] if kind == "long" else value[1:-1])
            if self.peek()[1] == "^^":
                self.take()
                return Term(text, "literal", self.iri(*self.take()))
            if self.peek()[0] == "at":
                return Term(text, "literal", None, self.take()[1][1:])
            return Term(text, "literal")
        if kind == "number":
            exact = "double" if "e" in value.lower() else "decimal" if "." in value else "integer"
            return Term(value, "literal", f"{vocab.XSD}{exact}")
        if value in ("true", "false"):
            return Term(value, "literal", f"{vocab.XSD}boolean")
        self.i -= 1
        raise self.fail("a term")


def parse(text: str, base: str = "") -> Graph:
    """The graph of a Turtle document; TurtleError names the line where it is none."""
    return _Reader(text.lstrip("﻿"), base).document()


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """Triples of N-Triples files, read and split where they lie; lines that are no triple are left out."""
    from pyspark.sql import functions as F

    pattern = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<([^>]*)>|(_:\S+)|"((?:[^"\\]|\\.)*)"(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+))?)\s*\.\s*$'
    lines = spark.read.text(path).where(F.col("value").rlike(pattern))
    part = {i: F.regexp_extract("value", pattern, i) for i in range(1, 9)}
    literal = part[6]
    for raw, plain in ((r"\\t", "\t"), (r"\\n", "\n"), (r"\\r", "\r"), (r'\\"', '"'), (r"\\\\", r"\\")):
        literal = F.regexp_replace(literal, raw, plain)
    kind = F.when(part[3].startswith("<"), "iri").when(part[5] != "", "bnode").otherwise("literal")
    value = F.when(kind == "iri", part[4]).when(kind == "bnode", part[5]).otherwise(literal)
    return lines.select(F.regexp_replace(part[1], "^<|>$", "").alias("s"), part[2].alias("p"), value.alias("o"), kind.alias("o_kind"), F.nullif(part[7], F.lit("")).alias("o_datatype"), F.nullif(part[8], F.lit("")).alias("o_lang"))


def write_ntriples(triples: DataFrame, path: str) -> None:
    """Triples as N-Triples, one a line, from every partition at once."""
    from pyspark.sql import functions as F

    def node(c: str):
        return F.when(F.col(c).startswith("_:"), F.col(c)).otherwise(F.concat(F.lit("<"), c, F.lit(">")))

    text = F.col("o")
    for plain, raw in (("\\\\", "\\\\\\\\"), ('"', '\\\\"'), ("\n", "\\\\n"), ("\r", "\\\\r"), ("\t", "\\\\t")):
        text = F.regexp_replace(text, plain, raw)
    literal = F.concat(F.lit('"'), text, F.lit('"'), F.coalesce(F.concat(F.lit("^^<"), "o_datatype", F.lit(">")), F.concat(F.lit("@"), "o_lang"), F.lit("")))
    line = F.concat_ws(" ", node("s"), node("p"), F.when(F.col("o_kind") == "literal", literal).otherwise(node("o")), F.lit("."))
    triples.select(line).write.mode("overwrite").text(path)
