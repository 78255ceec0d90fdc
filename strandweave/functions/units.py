"""Units read from names and descriptions, their dimensions, and suggested conversions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import snake_case

#: Stands for a unit that is recognised but has no identifier.
NO_IRI = "<none>"

# fixed values: what a name ends in (whole last tokens), in match order, and the unit; a name with a
# kilometre-per-hour token anywhere comes first
ANYWHERE = r"(?i)_kmh|km[/_]h"
NAME_ENDS = [
    ("mps", "M-PER-SEC"), ("mph", "MI-PER-HR"), ("ghz|gigahertz", "GigaHZ"), ("mhz|megahertz", "MegaHZ"),
    ("khz|kilohertz", "KiloHZ"), ("hz", "HZ"), ("meters?", "M"), ("km", "KiloM"), ("m", "M"), ("ft", "FT"),
    ("nmi", "NauticalMile"), ("kts", "KN"), ("knots?", "KN"), ("mrad", "MilliRAD"), ("deg|grad|grader", "DEG"),
    ("degrees?", "DEG"), ("bearing", "DEG"), ("rad|radians?", "RAD"), ("dbm", None), ("kg", "KiloGM"),
    ("hpa", "HectoPa"), ("pa", "PA"), ("secs?|seconds?", "SEC"), ("hrs?|hours?", "HR"), ("celsius|degc", "degC"),
    ("fahrenheit|degf", "DEG_F"), ("kelvin", "K"),
]
# fixed values: whole words of a description, in match order; True where letter case counts
WORDS = [
    (r"decimal\s+degrees?", "DEG", False), ("km/h", "KiloM-PER-HR", False), ("m/s", "M-PER-SEC", False),
    ("kilometers?", "KiloM", False), (r"nautical\s+miles?", "NauticalMile", False), ("feet|foot", "FT", False),
    ("knots?", "KN", False), ("metres?", "M", False), ("degree", "DEG", False), ("milliradians?|mrads?", "MilliRAD", False),
    ("radians?", "RAD", False), ("GHz", "GigaHZ", True), ("MHz", "MegaHZ", True), ("kHz", "KiloHZ", True),
    ("hertz|Hz", "HZ", False), ("kilograms?", "KiloGM", False), ("hectopascals?|hPa", "HectoPa", True),
    ("pascals?", "PA", False), ("seconds?", "SEC", False), ("minutes?", "MIN", False), ("hours?", "HR", False),
    ("kelvin", "K", False), ("celsius", "degC", False), ("fahrenheit", "DEG_F", False), ("dBm", None, True),
]
CLIMB_NAME, CLIMB_WORDS = r"(?i)(^|_)vertical_rate$", r"(?i)\b(feet\s+per\s+minute|ft/min|fpm)\b"

# fixed values: dimension vectors, and the units that have them
DIMENSIONS = {
    "A0E0L1I0M0H0T0D0": ["M", "FT", "KiloM", "NauticalMile"],
    "A0E0L1I0M0H0T-1D0": ["KiloM-PER-HR", "M-PER-SEC", "KN", "MI-PER-HR"],
    "A0E0L0I0M0H0T0D0": ["DEG", "RAD", "MilliRAD"],
    "A0E0L0I0M1H0T0D0": ["KiloGM", "GM"],
    "A0E0L0I0M0H0T1D0": ["SEC", "MIN", "HR"],
    "A0E0L-1I0M1H0T-2D0": ["PA", "DeciBAR", "HectoPa"],
    "A0E0L0I0M0H1T0D0": ["K", "degC", "DEG_F"],
    "A0E0L0I0M0H0T-1D0": ["HZ", "KiloHZ", "MegaHZ", "GigaHZ"],
}
# fixed values: suggested conversions, from, to, factor, offset
CONVERSIONS = [
    ("FT", "M", 0.3048, None), ("M", "FT", 3.28084, None), ("KiloM", "M", 1000.0, None), ("M", "KiloM", 0.001, None),
    ("KiloM-PER-HR", "M-PER-SEC", 0.277778, None), ("M-PER-SEC", "KiloM-PER-HR", 3.6, None), ("KN", "M-PER-SEC", 0.514444, None),
    ("DEG", "RAD", 0.017453293, None), ("RAD", "DEG", 57.2957795, None), ("KiloGM", "GM", 1000.0, None), ("degC", "K", 1.0, 273.15),
]


def _curie(unit: str | None) -> str:
    return NO_IRI if unit is None else f"unit:{unit}"


def _spellings(pattern: str) -> list[str]:
    """The words of an alternation in which ``x?`` is optional and white space is one space."""
    out = []
    for word in pattern.replace(r"\s+", " ").split("|"):
        out += [word.replace("?", "")] + ([re.sub(r".\?", "", word)] if "?" in word else [])
    return out


def _lookup(pairs: dict[str, str | int], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair]), key)


_BY_END = {word: _curie(unit) for words, unit in NAME_ENDS for word in _spellings(words)}
_EXACT = {word: i for i, (words, _, exact) in enumerate(WORDS) if exact for word in _spellings(words)}
_ANY_CASE = {word.lower(): i for i, (words, _, exact) in enumerate(WORDS) if not exact for word in _spellings(words)}
_ANY_WORD = r"(?i)\b(" + "|".join(words for words, _, _ in WORDS) + r")\b"


def cascade(name: Column, description: Column) -> Column:
    """The unit, or ``NO_IRI``, or null: by the name's last token, else by the description's words.

    The endings are whole tokens, so one lookup of the last token decides; of the words found the earliest
    rule counts.
    """
    plain, text = snake_case(F.coalesce(name, F.lit(""))), F.coalesce(description, F.lit(""))
    ranks = F.transform(F.regexp_extract_all(text, F.lit(_ANY_WORD), F.lit(1)), lambda w: F.coalesce(_lookup(_EXACT, w), _lookup(_ANY_CASE, F.lower(F.regexp_replace(w, r"\s+", " ")))))
    by_word = F.get(F.array(*[F.lit(_curie(unit)) for _, unit, _ in WORDS]), F.array_min(ranks))
    by_end = _lookup(_BY_END, F.lower(F.substring_index(plain, "_", -1)))
    climb = plain.rlike(CLIMB_NAME) & text.rlike(CLIMB_WORDS)
    return F.coalesce(F.when(climb, "unit:FT-PER-MIN").when(plain.rlike(ANYWHERE), "unit:KiloM-PER-HR"), by_end, by_word)


def detect_unit(name: Column, description: Column, further: Callable[[Column], Column] | None = None) -> Column:
    """The unit of a field, or null where none is found or the one found has no identifier.

    The name's ending decides before the description's words; ``further``, if given, is asked about the
    description where neither does.
    """
    found = cascade(name, description)
    if further is not None:
        found = F.coalesce(found, further(description))
    return F.nullif(found, F.lit(NO_IRI))


def recognised_without_iri(name: Column, description: Column) -> Column:
    return F.coalesce(cascade(name, description) == NO_IRI, F.lit(False))


def dimension(unit: Column) -> Column:
    """A unit's dimension vector, null where unknown."""
    pairs = [F.lit(x) for vector, units in DIMENSIONS.items() for u in units for x in (f"unit:{u}", vector)]
    return F.element_at(F.create_map(*pairs), unit)


def compatible(source: Column, target: Column) -> Column:
    """Whether two units have one dimension; null where either is unknown."""
    return dimension(source) == dimension(target)


def units_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"unit:{u}", v) for v, units in DIMENSIONS.items() for u in units], "unit string, vector string")


def conversions_table(spark: SparkSession) -> DataFrame:
    rows = [(f"Convert{a}To{b}", f"unit:{a}", f"unit:{b}", m, o) for a, b, m, o in CONVERSIONS]
    return spark.createDataFrame(rows, "fn string, from_unit string, to_unit string, multiplier double, offset double")


def convert(value: Column, multiplier: Column, offset: Column) -> Column:
    return value * multiplier + F.coalesce(offset, F.lit(0.0))
