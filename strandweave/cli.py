"""The command line: ingest, suggest, ledger append/review/dump, compile, transform."""

from __future__ import annotations

import argparse
import atexit
import json
import os
import shutil
import sys
import tempfile
import uuid
from pathlib import Path

from . import config as settings
from . import vocab
from .operators import hierarchy, ledger, lint, shacl
from .plans import mapping, materialize, yarrrml
from .plans.suggest import model_embedder, suggest
from .session import session
from .sources import ingest, shapes, sssom
from .sources.model import Schema
from .sources.paths import OWN_DIR, located

HEADER = ["sssom_version: https://w3id.org/sssom/spec/0.15", "curie_map:", "  skos: http://www.w3.org/2004/02/skos/core#", "  owl: http://www.w3.org/2002/07/owl#", "  semapv: https://w3id.org/semapv/vocab/"]


#: Set by --quiet and --verbose: 0 errors only, 1 as usual, 2 more.  Nothing is coloured, so NO_COLOR holds.
LOUD = 1


class UsageError(Exception):
    """Options that do not go together."""


def _say(text: str, level: int = 1) -> None:
    """A remark on standard error."""
    if level <= LOUD:
        print(text, file=sys.stderr)


def _input(path: str) -> str:
    """The path, or for ``-`` that of a file with what standard input holds."""
    if path != "-":
        return path
    with tempfile.NamedTemporaryFile("w", encoding="utf-8", suffix=".tsv", delete=False) as out:
        shutil.copyfileobj(sys.stdin, out)
    atexit.register(os.unlink, out.name)
    return out.name


def _write(text: str, out: str | None) -> None:
    if out in (None, "-"):
        sys.stdout.write(text)
        return
    path = Path(out)
    path.parent.mkdir(parents=True, exist_ok=True)
    draft = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    draft.write_text(text, encoding="utf-8")
    draft.replace(path)


def _schema(path: str) -> Schema:
    return Schema.from_yaml(Path(path).read_text(encoding="utf-8"))


def _targets(files: list[str], output: str | None) -> list[tuple[str, Path]]:
    """Where each file's schema goes: a named file or a folder (one that exists, or a name that ends like one).
    Without either, one schema goes to standard output and several to the working folder.  Several files need a
    folder, and names that differ."""
    folder = output is not None and (output.endswith("/") or Path(output).is_dir())
    if len(files) > 1 and output is not None and not folder:
        raise UsageError("several inputs need a folder as output")
    if not folder and (output is not None or len(files) == 1):
        return [(files[0], Path(output or "-"))]
    out = [(f, Path(output or ".") / f"{Path(f).stem}.linkml.yaml") for f in files]
    if len({t for _, t in out}) < len(out):
        raise UsageError("two inputs would be written to one file")
    return out


def run_ingest(args) -> int:
    spark = session("ingest")
    if args.lang.upper() != "EN" and not args.translate and args.lang:
        _say("the source is not in English; --translate needs a dictionary")
    for f, target in _targets(args.files, args.output):
        schema = ingest.ingest(spark, f, args.schema_format)
        _say(f"{f}: {len(schema.classes)} classes, {len(schema.slots)} slots", 2)
        if args.translate:
            from .operators import translate

            words = json.loads(Path(args.translate).read_text(encoding="utf-8"))
            for items in (schema.classes, schema.slots):
                rows = spark.createDataFrame([(n, x.get("title") or n, x.get("description"), list(x.get("aliases") or [])) for n, x in items.items()] or [("", "", None, [])], "name string, title string, description string, aliases array<string>")
                for r in translate.translate(rows, args.lang, lambda t: [words.get(x, x) for x in t]).collect():
                    if r.name in items:
                        items[r.name] |= {k: v for k, v in (("title", r.title), ("description", r.description), ("aliases", r.aliases)) if v}
        if str(target) != "-":
            ingest.check_collision(target, schema)
        _write(schema.to_yaml(), str(target))
        if args.master and str(target) != "-":
            rows = shacl.generate(schema, _class_units(spark, schema))
            _write(shapes.to_turtle(rows), str(target.with_name(target.name.removesuffix(".linkml.yaml") + ".shacl.ttl")))
            scaffold = Path(settings.FILE)
            if not scaffold.exists():
                scaffold.write_text(f'[ledger]\nlog = "audit-log.sssom.tsv"\n\n[schema]\nmaster = "{target}"\n\n[conversions]\n', encoding="utf-8")
    return 0


def _class_units(spark, schema: Schema) -> dict[str, list[str]]:
    from pyspark.sql import functions as F

    from .functions.text import expand
    from .functions.units import detect_unit

    rows = [(c, s, i, schema.slots.get(s, {}).get("description") or "") for c in schema.classes for i, s in enumerate(schema.induced(c))]
    if not rows:
        return {}
    df = spark.createDataFrame(rows, "cls string, slot string, pos int, description string")
    df = df.withColumn("unit", expand(detect_unit(F.col("slot"), F.col("description")), {"unit": vocab.UNIT}))
    return {r.cls: r.units for r in shacl.class_units(df).collect()}


def run_suggest(args) -> int:
    spark, conf = session("suggest"), settings.load()
    log = sssom.read(spark, args.audit_log)
    rows = suggest(spark, _schema(args.source), _schema(args.master), log, model_embedder(args.model) if args.model else None, args.top_k, args.min_score, args.structural_weight, settings.conversion_policies(conf), settings.library(conf))
    _write(sssom.to_text(rows, HEADER), args.output)
    return 0


def _log_path(args) -> str:
    return args.audit_log or settings.get(settings.load(), "ledger", "log", default="audit-log.sssom.tsv")


def run_append(args) -> int:
    from pyspark.sql import functions as F

    spark, conf = session("ledger"), settings.load()
    path, given = _log_path(args), _input(args.file)
    if not Path(given).exists():
        raise ValueError(f"no such file: {args.file}")
    rows, log = sssom.read(spark, given), sssom.read(spark, path)
    try:
        source, master = _schema(args.source_schema), _schema(args.master_schema)
        missing = unreachable(spark, rows, source, master)
    except (OSError, ValueError) as error:
        missing = spark.createDataFrame([(6, 0, "schema_parse_error", vocab.BLOCK, "", None, f"the schemas do not load, so reachability is not checked: {error}", None)], f"rule_order int, row_seq long, rule string, severity string, source_uri string, target_uri string, message string, suggestion {lint.SUGGESTION}")
    found = lint.run(rows, log, missing, settings.library(conf), args.strict)
    if args.role == "accreditor":
        found = found.where("rule <> 'hc_in_candidates'")
    found = found.persist()
    counts = lint.summary(found).first().asDict()
    text = json.dumps({"findings": [r.asDict(recursive=True) for r in found.collect()], "summary": counts}, indent=2, ensure_ascii=False)
    if args.dry_run:
        print(text)
        return int(counts["block"] > 0)
    _say(text, 0 if counts["block"] else 1)
    if counts["block"]:
        return 1
    added = sssom.append_to_file(ledger.append(rows, log, args.role, F.current_timestamp()), path, HEADER)
    _say(f"{added} rows appended to {path}")
    return 0


def unreachable(spark, rows, source: Schema, master: Schema):
    """Lint findings of slots whose class no mapped class is related to."""
    from pyspark.sql import functions as F

    told = mapping.classify(rows.where(ledger.is_manual() | ledger.is_human()), source.names(spark), master.names(spark)).persist()
    closed = hierarchy.closure(master.class_edges(spark))
    owners = hierarchy.slot_owners(master.class_slot_rows(spark), closed)
    mapped = told.where("kind = 'class'").select(F.col("object").alias("cls")).distinct()
    names = ", ".join(sorted(r.cls for r in mapped.collect()))
    slots = told.where("kind = 'slot'").select("subject_id", "object_id", "log_seq", F.col("object").alias("slot"))
    below = hierarchy.descendants(closed).groupBy(F.col("cls").alias("owner")).agg(F.array_join(F.array_sort(F.collect_set("descendant")), ", ").alias("subs"))
    bad = hierarchy.unreachable(slots, mapped, owners, closed).join(below, "owner", "left")
    text = F.concat(F.lit("Slot '"), "slot", F.lit("' belongs to class '"), "owner", F.lit(f"' which is not reachable from any mapped class ({names}). Map the source class to '"), "owner", F.lit("'"), F.when(F.coalesce("subs", F.lit("")) != "", F.concat(F.lit(" or a subclass: "), "subs", F.lit("."))).otherwise("."))
    return bad.select(F.lit(6).alias("rule_order"), F.col("log_seq").alias("row_seq"), F.lit("slot_class_unreachable").alias("rule"), F.lit(vocab.BLOCK).alias("severity"), F.col("subject_id").alias("source_uri"), F.col("object_id").alias("target_uri"), text.alias("message"), F.lit(None).cast(lint.SUGGESTION).alias("suggestion"))


def run_review(args) -> int:
    spark = session("ledger")
    _write(sssom.to_text(ledger.pending(sssom.read(spark, _log_path(args))).orderBy("log_seq"), HEADER), args.output)
    return 0


def run_dump(args) -> int:
    spark = session("ledger")
    _write(sssom.to_text(ledger.dump(sssom.read(spark, _log_path(args))), HEADER), args.output)
    return 0


def run_compile(args) -> int:
    spark, conf = session("compile"), settings.load()
    library = settings.library(conf)
    plan, coverage = mapping.compile_plan(sssom.read(spark, _input(args.sssom)), _schema(args.source_schema), _schema(args.master_schema), library, args.include_manual, args.force)
    if args.spec_output:
        _write(plan.to_json(), args.spec_output)
    if args.coverage_report:
        _write(json.dumps(coverage.__dict__, indent=2, ensure_ascii=False), args.coverage_report)
    _write(yarrrml.to_yarrrml(plan, library), args.output)
    return 0


def run_transform(args) -> int:
    if bool(args.shapes) == args.no_validate:
        raise UsageError("give either --shapes or --no-validate")
    if args.validate_report == "-" and args.output in (None, "-"):
        raise UsageError("the report and the result cannot both go to standard output")
    spark, conf = session("transform"), settings.load()
    library, text = settings.library(conf), Path(args.mapping).read_text(encoding="utf-8")
    plan = mapping.MappingPlan.from_json(text) if text.lstrip().startswith("{") else yarrrml.from_yarrrml(text, library)
    master = _schema(args.master_schema)
    for name, slot in master.slots.items():
        kind = slot.get("range") or master.default_range
        if kind in vocab.XSD_RANGES and kind not in vocab.LITERAL_TYPES:
            raise ValueError(f"slot {name} has the range {kind}, which is no range of this schema language")
    if args.workdir:
        work = Path(args.workdir)
        work.mkdir(parents=True, exist_ok=True)
        spark.conf.set(OWN_DIR, work.resolve().as_uri())
    data = materialize.scan(spark, args.data, plan.source_format, args.row_tag, args.iterator, args.lines)
    triples = materialize.materialize(plan, data, library).persist()
    if triples.isEmpty():
        _say("warning: no triples")
    if args.shapes:
        conforms, found = shacl.validate(triples, shacl.constraints(spark, shapes.load(args.shapes)))
        _say(f"the result {'conforms' if conforms else 'does not conform'}", 2)
        if not conforms:
            report = json.dumps({"conforms": False, "summary": {k: v for k, v in shacl.report(found).first().asDict().items() if k != "conforms"}, "findings": [r.asDict() for r in found.collect()]}, indent=2, ensure_ascii=False)
            if args.validate_report:
                _write(report + "\n", args.validate_report)
            else:
                print(report, file=sys.stderr)
            return 1
    told = materialize.context(plan)
    if args.nodes_output:  # of any size: the executors write it
        materialize.write_jsonld(triples, plan, located(args.nodes_output))
    if args.context_output:
        _write(json.dumps(told, indent=2, ensure_ascii=False), args.context_output)
    if args.output or not args.nodes_output:
        _write(materialize.jsonld_document(triples, plan), args.output)
    triples.unpersist()
    return 0


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="strandweave", description=__doc__)
    loud = out.add_mutually_exclusive_group()
    loud.add_argument("-v", "--verbose", action="store_true")
    loud.add_argument("-q", "--quiet", action="store_true")
    out.add_argument("--version", action="version", version="strandweave 0.1")
    sub = out.add_subparsers(dest="command", required=True)

    def command(to, name: str, run, *positional: str):
        p = to.add_parser(name)
        for x in positional:
            p.add_argument(x, **({"nargs": "+"} if x == "files" else {}))
        p.add_argument("-o", "--output")
        p.set_defaults(run=run)
        return p

    p = command(sub, "ingest", run_ingest, "files")
    p.add_argument("-f", "--schema-format", choices=ingest.FORMATS)
    p.add_argument("--translate", help="a JSON file of texts and their translations")
    p.add_argument("--lang", default="EN")
    p.add_argument("--master", action="store_true")
    p = command(sub, "suggest", run_suggest, "source", "master")
    p.add_argument("--top-k", type=int, default=5)
    p.add_argument("--min-score", type=float, default=0.0)
    p.add_argument("--structural-weight", type=float, default=0.2)
    p.add_argument("--audit-log", required=True)
    p.add_argument("--model", help="a sentence-embedding model; hashed trigrams where none is named")
    book = sub.add_parser("ledger").add_subparsers(dest="action", required=True)
    p = command(book, "append", run_append, "file")
    p.add_argument("--role", choices=["analyst", "accreditor"], required=True)
    p.add_argument("--source-schema", required=True)
    p.add_argument("--master-schema", required=True)
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--strict", action="store_true")
    p.add_argument("--audit-log")
    for name, run in (("review", run_review), ("dump", run_dump)):
        command(book, name, run).add_argument("--audit-log")
    p = command(sub, "compile", run_compile, "sssom")
    p.add_argument("--source-schema", required=True)
    p.add_argument("--master-schema", required=True)
    p.add_argument("--coverage-report")
    p.add_argument("--spec-output")
    p.add_argument("--include-manual", action="store_true")
    p.add_argument("--force", action="store_true")
    p = command(sub, "transform", run_transform, "mapping", "data")
    p.add_argument("--master-schema", required=True)
    p.add_argument("--shapes")
    p.add_argument("--no-validate", action="store_true")
    p.add_argument("--context-output")
    p.add_argument("--validate-report")
    p.add_argument("--row-tag")
    p.add_argument("--iterator")
    p.add_argument("--lines", action="store_true", help="no record goes over a line's end, so files can be split")
    p.add_argument("--nodes-output", help="a folder for the result's nodes, one a line, written by the executors")
    p.add_argument("--workdir", help="a folder for intermediate tables, shared by driver and executors")
    return out


def main(argv: list[str] | None = None) -> int:
    """Exit codes: 0 done, 1 refused or failed, 2 wrong usage, 130 interrupted, 141 reader gone."""
    global LOUD
    args = parser().parse_args(argv)
    LOUD = 0 if args.quiet else 2 if args.verbose else 1
    try:
        return args.run(args)
    except UsageError as error:
        print(f"usage: {error}", file=sys.stderr)
        return 2
    except (ValueError, OSError) as error:
        if isinstance(error, BrokenPipeError):
            os.dup2(os.open(os.devnull, os.O_WRONLY), sys.stdout.fileno())
            return 141
        print(f"error: {error}", file=sys.stderr)
        return 1
    except KeyboardInterrupt:
        return 130


if __name__ == "__main__":
    sys.exit(main())
