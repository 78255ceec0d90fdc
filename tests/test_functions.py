"""Names, units, templates and conversion functions."""

import pytest
from pyspark.sql import functions as F

from strandweave.functions import text as txt
from strandweave.functions import units
from strandweave.functions.registry import Declaration, FunctionLibrary

NAMES = {
    "hoyde_m": "unit:M", "altitude_ft": "unit:FT", "hasAltitudeFt": "unit:FT", "hastighet_kmh": "unit:KiloM-PER-HR", "speed_km_h": "unit:KiloM-PER-HR",
    "kurs_grader": "unit:DEG", "bearing": "unit:DEG", "freq_MHz": "unit:MegaHZ", "signal_dbm": None, "mass_kg": "unit:KiloGM", "team": None, "program": None,
    "pressure_hpa": "unit:HectoPa", "pressure_hPa": "unit:PA", "duration_secs": "unit:SEC", "temp_degc": "unit:degC", "temp_degC": None, "alt123Ft": "unit:FT", "": None,
}
DESCRIPTIONS = {
    "WGS-84 latitude in decimal degrees": "unit:DEG", "in meters": None, "in metres": "unit:M", "degrees true": None, "one degree": "unit:DEG", "in GHz": "unit:GigaHZ",
    "in ghz": None, "frequency in hz": "unit:HZ", "power in dBm": None, "nautical  miles": "unit:NauticalMile", "30 minutes": "unit:MIN",
}


def _one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_units_by_name_and_description(spark):
    rows = [(n, "", u) for n, u in NAMES.items()] + [("x", d, u) for d, u in DESCRIPTIONS.items()] + [("verticalRate", "feet per minute", "unit:FT-PER-MIN"), ("verticalRate", "feet", "unit:FT")]
    df = spark.createDataFrame(rows, "name string, words string, want string")
    for r in df.withColumn("got", units.detect_unit(F.col("name"), F.col("words"))).collect():
        assert r.got == r.want, r


def test_recognised_without_identifier_and_further_layer(spark):
    assert _one(spark, units.recognised_without_iri(F.lit("signal_dbm"), F.lit("")))
    assert not _one(spark, units.recognised_without_iri(F.lit("name"), F.lit(None).cast("string")))
    further = lambda d: F.when(d.contains("klick"), "unit:KiloM")
    assert _one(spark, units.detect_unit(F.lit("x"), F.lit("a klick"), further)) == "unit:KiloM"
    assert _one(spark, units.detect_unit(F.lit("signal_dbm"), F.lit("a klick"), further)) is None


def test_dimensions(spark):
    assert _one(spark, units.compatible(F.lit("unit:M"), F.lit("unit:FT"))) is True
    assert _one(spark, units.compatible(F.lit("unit:M"), F.lit("unit:SEC"))) is False
    assert _one(spark, units.compatible(F.lit("unit:M"), F.lit("unit:FT-PER-MIN"))) is None
    assert units.units_table(spark).count() == 26
    assert units.conversions_table(spark).count() == 11


def test_text_functions(spark):
    assert _one(spark, txt.title_label(F.lit("hoyde_m2x a'b"))) == txt.title("hoyde_m2x a'b")
    assert _one(spark, txt.unit_label(F.lit("http://a/b:c"), F.lit(""))) == "c"
    assert _one(spark, txt.strip_bom(F.lit("﻿id"))) == "id"
    assert _one(spark, txt.template("http://x/$(a)", {"a": F.lit("é b/c")})) == "http://x/%C3%A9%20b%2Fc"
    assert _one(spark, txt.template("http://x/$(a)", {"a": F.lit(None).cast("string")})) is None
    with pytest.raises(ValueError):
        txt.template("$(b)", {})
    assert txt.merge_prefixes({"a": "1"}, {"a": "2", "b": "3"}) == {"a": "2", "b": "3"}
    assert _one(spark, txt.slot_path(F.lit("x"), F.lit("json"))) == "$.x"


def test_builtin_conversions(spark):
    lib = FunctionLibrary.builtins()
    want = {"fns:meterToFoot": 328.084, "fns:footToMeter": 30.48, "fns:kgToPound": 220.462, "fns:poundToKg": 45.35929, "fns:celsiusToFahrenheit": 212.0, "fns:kelvinToCelsius": -173.15}
    for name, x in want.items():
        assert _one(spark, lib.apply(name, F.lit("100"))) == pytest.approx(x, abs=1e-4)
        assert _one(spark, lib.apply(name, F.lit("abc"))) is None


def test_function_library():
    lib = FunctionLibrary.builtins()
    assert lib.has("fns:meterToFoot") and lib.has(lib.iri("fns:meterToFoot")) and not lib.has("fns:none")
    with pytest.raises(KeyError):
        lib.get("fns:none")
    with pytest.raises(ValueError):
        lib.declare(Declaration("fns:meterToFoot", body=lambda x: x))
    lib.add_turtle(
        """@prefix fno: <https://w3id.org/function/ontology#> . @prefix ex: <http://ex.org/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
        ex:up a fno:Function ; fno:expects ( [ fno:predicate ex:in ; fno:type xsd:string ] ) ; fno:returns ( [ fno:type xsd:string ] ) ."""
    )
    up = lib.get("ex:up")
    assert (up.parameter, up.input_type, up.output_type) == ("ex:in", "xsd:string", "xsd:string")
    with pytest.raises(ValueError):
        lib.apply("ex:up", F.lit("a"))
