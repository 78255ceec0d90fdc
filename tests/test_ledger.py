"""Ledger state, ranking and lint on small logs."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from strandweave import vocab
from strandweave.functions.registry import FunctionLibrary
from strandweave.operators import ledger, lint, vectors
from strandweave.sources import sssom

EXACT = "skos:exactMatch"


def log(spark, *rows):
    """Rows (subject, object, justification, predicate, day); the order is the log's."""
    full = []
    for i, (s, o, j, p, day) in enumerate(rows):
        date = None if day is None else datetime(2024, 1, day, tzinfo=timezone.utc)
        full.append((s, p, o, j, 0.5, "", "", date, None, None, None, None, None, None, None, None, i))
    return spark.createDataFrame(full, vocab.LOG)


def pairs(df):
    return sorted((r.subject_id, r.object_id) for r in df.collect())


def test_ties_go_to_the_first_row_in_dumps_and_the_last_in_suggestions(spark):
    df = log(spark, ("a", "x", vocab.HC, EXACT, 1), ("a", "x", vocab.HC, "skos:closeMatch", 1))
    assert ledger.dump(df).first().predicate_id == EXACT
    assert ledger.latest(df, first_wins=False).first().predicate_id == "skos:closeMatch"


def test_pending(spark):
    df = log(spark, ("a", "x", vocab.MMC, EXACT, 1), ("b", "x", vocab.MMC, EXACT, 1), ("b", "x", vocab.HC, EXACT, 2), ("c", "x", vocab.MMC, EXACT, 3), ("c", "x", vocab.HC, EXACT, 2), ("d", "x", vocab.MMC, EXACT, None), ("d", "x", vocab.HC, EXACT, None))
    assert pairs(ledger.pending(df)) == [("a", "x"), ("c", "x")]


def test_append_rules(spark):
    old = log(spark, ("a", "x", vocab.MMC, EXACT, 1), ("b", "x", vocab.MMC, EXACT, 1), ("b", "x", vocab.HC, EXACT, 2))
    new = log(spark, ("a", "x", vocab.MMC, EXACT, 5), ("c", "x", vocab.MMC, EXACT, 5), ("c", "x", vocab.MMC, EXACT, 5))
    assert pairs(ledger.append(new, old)) == [("c", "x"), ("c", "x")]  # copies inside the file stay
    stamped = ledger.append(log(spark, ("c", "x", vocab.MMC, EXACT, None)), old).first()
    assert stamped.mapping_date is not None and stamped.record_id
    good = log(spark, ("a", "x", vocab.HC, EXACT, 5))
    assert pairs(ledger.append(good, old, "accreditor")) == [("a", "x")]
    with pytest.raises(ledger.LedgerError):
        ledger.append(log(spark, ("a", "x", vocab.HC, EXACT, 5), ("z", "x", vocab.HC, EXACT, 5)), old, "accreditor")
    with pytest.raises(ValueError):
        ledger.append(good, old, "guest")


def test_decided_candidates(spark):
    df = log(spark, ("a", "x", vocab.HC, EXACT, 1), ("a", "y", vocab.HC, vocab.DIFFERENT, 1), ("b", "x", vocab.HC, vocab.DIFFERENT, 1))
    cand = spark.createDataFrame([(s, o) for s in "abc" for o in "xy"], "subject_id string, object_id string")
    assert pairs(ledger.filter_decided(cand, df)) == [("b", "y"), ("c", "x"), ("c", "y")]


def test_ranking(spark):
    left = spark.createDataFrame([("s", [1.0, 0.0, 0.0]), ("zero", [0.0, 0.0, 0.0])], "subject_id string, vector array<double>")
    right = spark.createDataFrame([("t1", 0, [1.0, 0.0, 0.0]), ("t2", 1, [2.0, 0.0, 0.0]), ("t3", 2, [1.0, 1.0, 0.0]), ("t4", 3, [-1.0, 0.0, 0.0])], "object_id string, object_pos int, vector array<double>")
    scored = vectors.scores(left, right)
    top = [(r.object_id, r.score, r["rank"]) for r in vectors.rank(scored, 3).where("subject_id = 's'").orderBy("rank").collect()]
    assert top == [("t2", 1.0, 1), ("t1", 1.0, 2), ("t3", 0.707107, 3)]
    assert {r.score for r in vectors.rank(scored, 5).where("subject_id = 'zero'").collect()} == {0.0}
    assert vectors.rank(scored, 9).where("subject_id = 's'").count() == 3  # -1 is below the least score
    with pytest.raises(ValueError):
        vectors.check_dimensions(left, right.withColumn("vector", F.array(F.lit(1.0))))


def test_blending_needs_structure_on_both_sides(spark):
    left = spark.createDataFrame([("s", [1.0, 0.0], [1.0, 0.0])], "subject_id string, vector array<double>, structure array<double>")
    right = spark.createDataFrame([("t", 0, [1.0, 0.0], [0.0, 1.0])], "object_id string, object_pos int, vector array<double>, structure array<double>")
    assert vectors.scores(left, right, 0.25).first().score == pytest.approx(0.75)
    none = right.withColumn("structure", F.array(F.lit(0.0), F.lit(0.0)))
    assert vectors.scores(left, none, 0.25).first().score == pytest.approx(1.0)


def _row(spark, **told):
    base = dict.fromkeys(vocab.LOG.fieldNames()) | {"subject_id": "n:a", "predicate_id": EXACT, "object_id": "mc:b", "mapping_justification": vocab.MMC, "confidence": 1.0, "subject_label": "", "object_label": "", "log_seq": 0}
    return spark.createDataFrame([tuple((base | told).values())], vocab.LOG)


def _rules(df):
    return sorted(r.rule for r in df.collect())


def test_unit_rules(spark):
    lib = FunctionLibrary.builtins()
    assert _rules(lint.unit_findings(_row(spark, subject_id="n:h_m", object_id="mc:h_ft"))) == ["unit_conversion_required"]
    assert _rules(lint.unit_findings(_row(spark, subject_id="n:h_m", object_id="mc:h_ft", conversion_function="fns:meterToFoot"), lib)) == ["unit_conversion_covered"]
    assert _rules(lint.unit_findings(_row(spark, subject_id="n:h_m", object_id="mc:h_ft", conversion_function="fns:none"), lib)) == ["undeclared_function"]
    assert _rules(lint.unit_findings(_row(spark, subject_id="n:h_m", object_id="mc:t_sec"))) == ["unit_dimension_mismatch"]
    assert _rules(lint.unit_findings(_row(spark, subject_id="n:h_m", object_id="mc:name"))) == ["unit_not_detected"]
    assert _rules(lint.unit_findings(_row(spark, subject_id="n:p_dbm", object_id="mc:name"))) == ["unit_not_detected"] * 2
    assert _rules(lint.unit_findings(_row(spark, subject_id="n:h_m", object_id="mc:d_m"))) == []


def test_datatype_rules(spark):
    lib = FunctionLibrary.builtins()
    told = {"subject_datatype": "float", "object_datatype": "integer"}
    assert _rules(lint.datatype_findings(_row(spark, **told))) == ["datatype_narrowing"]
    assert _rules(lint.datatype_findings(_row(spark, **told, conversion_function="grel:math_round"), lib)) == ["datatype_covered_by_function"]
    assert _rules(lint.datatype_findings(_row(spark, **told, conversion_function="fns:meterToFoot"), lib)) == ["datatype_narrowing"]
    assert _rules(lint.datatype_findings(_row(spark, **told, conversion_function="fns:none"), lib)) == ["undeclared_function"]
    assert _rules(lint.datatype_findings(_row(spark, subject_datatype="string", object_datatype="integer"))) == ["datatype_mismatch"]
    assert _rules(lint.datatype_findings(_row(spark, subject_datatype="integer", object_datatype="float"))) == []


def test_report_and_strict(spark):
    rows = _row(spark, subject_id="n:h_m", object_id="mc:h_ft")
    empty = spark.createDataFrame([], vocab.LOG)
    assert lint.summary(lint.run(rows, empty)).first().asDict() == {"block": 0, "warning": 1, "info": 0}
    assert lint.summary(lint.run(rows, empty, strict=True)).first().asDict() == {"block": 1, "warning": 0, "info": 0}


def test_policies(spark):
    lib = FunctionLibrary.builtins()
    rows = _row(spark, subject_id="n:h_m", object_id="mc:h_ft", subject_datatype="integer", object_datatype="float")
    by_unit = lint.populate_functions(rows, {"unit:M:unit:FT": "fns:meterToFoot"}, lib).first().conversion_function
    by_type = lint.populate_functions(rows, {"unit:M:unit:FT": "fns:meterToFoot", "integer:float": "grel:math_round"}, lib).first().conversion_function
    assert (by_unit, by_type) == ("fns:meterToFoot", "grel:math_round")
    assert lint.populate_functions(rows, {"integer:float": "fns:none", "x": 1}, lib).first().conversion_function is None
    kept = _row(spark, conversion_function="a:b", subject_datatype="integer", object_datatype="float")
    assert lint.populate_functions(kept, {"integer:float": "grel:math_round"}, lib).first().conversion_function == "a:b"


def test_mapping_files(spark, tmp_path):
    path = tmp_path / "log.tsv"
    assert sssom.read(spark, str(path)).count() == 0
    rows = log(spark, ("a", "x", vocab.MMC, EXACT, 1), ("b", "y", vocab.HC, EXACT, None))
    assert sssom.append_to_file(rows, path, ["a comment"]) == 2
    assert sssom.append_to_file(rows, path) == 2
    back = sssom.read(spark, str(path)).orderBy("log_seq").collect()
    assert [r.subject_id for r in back] == ["a", "b", "a", "b"]
    assert back[0].mapping_date.day == 1 and back[1].mapping_date is None
    assert path.read_text().count("subject_id") == 1


def test_legacy_and_malformed_files(spark, tmp_path):
    path = tmp_path / "old.tsv"
    path.write_text("#x\n" + "\t".join(sssom.LEGACY) + "\na\tskos:exactMatch\tb\t" + vocab.MMC + "\t\tl\n\t\t\t\nc\tp\td\tj\tnan-x\t\n")
    with pytest.warns(UserWarning):
        rows = sssom.read(spark, str(path)).collect()
    assert [(r.subject_id, r.confidence, r.subject_label, r.conversion_function) for r in rows] == [("a", 0.0, "l", None)]
    sssom.append_to_file(log(spark, ("n", "x", vocab.MMC, EXACT, 1)), path)
    lines = path.read_text().splitlines()
    assert lines[1].split("\t") == sssom.LEGACY and len(lines[-1].split("\t")) == len(sssom.LEGACY) and lines[-1].startswith("n\t")
    bad = tmp_path / "bad.tsv"
    bad.write_text("a\tb\n1\t2\n")
    with pytest.raises(ValueError):
        sssom.read(spark, str(bad))
