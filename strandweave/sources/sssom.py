"""Mapping rows in tab-separated files with comment lines, read and written."""

from __future__ import annotations

import csv
import io
import re
import warnings
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import vocab
from .paths import located

LEGACY = vocab.MAPPING_COLUMNS[:-1]


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a file, or of a folder of part files, with ``log_seq``, their order in it; an absent file
    has none.

    Lines that start with # are comments.  The header must be the sixteen columns, or the fifteen without
    the last.  Rows without a subject, predicate, object or justification, or with an unreadable number, are
    left out with a warning; short rows end in nulls.  Empty optional cells are null, empty labels empty, an
    empty confidence 0; dates without a zone are UTC.
    """
    path = located(path)
    file = re.sub("^file:/+", "/", path)
    if "://" not in file and not Path(file).exists():
        return spark.createDataFrame([], vocab.LOG)
    lines = spark.read.text(path, lineSep="\n").where(~F.col("value").startswith("#"))
    head = next(iter(csv.reader([(lines.first() or [""])[0].rstrip("\r")], delimiter="\t")), [])
    if head not in (vocab.MAPPING_COLUMNS, LEGACY):
        raise ValueError(f"{path}: the header must be {vocab.MAPPING_COLUMNS}")
    raw = T.StructType([*[T.StructField(c, T.StringType()) for c in head], T.StructField("__bad", T.StringType())])
    rows = spark.read.schema(raw).options(sep="\t", header=True, comment="#", quote='"', escape='"', multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="__bad").csv(path)
    # part files are not read in the order of their numbers
    part, row = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).try_cast("long"), F.monotonically_increasing_id()
    rows = rows.select(*head, F.coalesce(F.shiftleft(part, 33) + row.bitwiseAND((1 << 33) - 1), row).alias("log_seq"))
    for c in vocab.MAPPING_COLUMNS:
        if c not in head:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    told = {}
    for f in vocab.MAPPING.fields:
        cell = F.nullif(F.trim(F.col(f.name)), F.lit("")) if f.name not in ("subject_label", "object_label") else F.coalesce(f.name, F.lit(""))
        if f.name == "confidence":
            cell = F.when(cell.isNull(), F.lit(0.0)).otherwise(cell.try_cast("double"))
        elif f.name == "mapping_date":
            cell = F.coalesce(F.try_to_timestamp(cell), cell.try_cast("timestamp"))
        told[f.name] = cell
    rows = rows.select(*[c.alias(n) for n, c in told.items()], "log_seq")
    good = F.lit(True)
    for c in ("subject_id", "predicate_id", "object_id", "mapping_justification", "confidence"):
        good = good & F.col(c).isNotNull()
    bad = rows.where(~good).count()
    if bad:
        warnings.warn(f"{path}: {bad} malformed rows are left out", stacklevel=2)
    return rows.where(good)


def cells(rows: DataFrame) -> DataFrame:
    """Rows as text cells: nulls empty, dates in ISO form with what fractions of a second they have."""
    whole = F.date_trunc("second", "mapping_date") == F.col("mapping_date")
    date = F.when(whole, F.date_format("mapping_date", "yyyy-MM-dd'T'HH:mm:ssXXX")).otherwise(F.date_format("mapping_date", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))
    return rows.select(*[F.coalesce(date if c == "mapping_date" else F.col(c).cast("string"), F.lit("")).alias(c) for c in vocab.MAPPING_COLUMNS])


def to_text(rows: DataFrame, comments: list[str] | None = None) -> str:
    """A whole file's text; for mapping files, which a driver holds."""
    out = io.StringIO()
    for line in comments or []:
        out.write(f"# {line}\n")
    writer = csv.writer(out, delimiter="\t", lineterminator="\n")
    writer.writerow(vocab.MAPPING_COLUMNS)
    for r in cells(rows).toLocalIterator():
        writer.writerow(list(r))
    return out.getvalue()


def append_to_file(rows: DataFrame, path: str | Path, comments: list[str] | None = None) -> int:
    """Append rows to a log file, which gets a header first; rows written.

    A file with the fifteen columns keeps them, header and rows.  Rows come to the driver partition by partition.
    """
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    columns, added = vocab.MAPPING_COLUMNS, 0
    if path.exists():
        with path.open(encoding="utf-8") as lines:
            head = next((x.rstrip("\r\n").split("\t") for x in lines if not x.startswith("#")), None)
        if head == LEGACY:
            columns = LEGACY
    with path.open("a", encoding="utf-8", newline="") as out:
        writer = csv.writer(out, delimiter="\t", lineterminator="\n")
        if out.tell() == 0:
            for line in comments or []:
                out.write(f"# {line}\n")
            writer.writerow(columns)
        for r in cells(rows).select(*columns).toLocalIterator():
            writer.writerow(list(r))
            added += 1
    return added


def write(rows: DataFrame, path: str, comments: list[str] | None = None) -> None:
    """The rows as a folder of files, each with the header, written by the executors; ``read`` takes the folder."""
    spark = rows.sparkSession
    cells(rows).write.options(sep="\t", header=True, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    if comments:
        head = [*(f"# {line}" for line in comments), "\t".join(vocab.MAPPING_COLUMNS)]
        spark.createDataFrame([(line,) for line in head], "value string").coalesce(1).write.mode("append").text(path)
