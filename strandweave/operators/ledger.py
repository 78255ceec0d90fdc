"""The mapping ledger: an append-only log of mapping rows and the questions asked of it.

A log is a DataFrame of the mapping columns and ``log_seq``, the order in which rows were appended, by which
ties are broken.  Every question groups or joins by the (subject, object) pair; aggregates combine map-side,
so a pair with very many rows is reduced before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab

PAIR = ["subject_id", "object_id"]
IDENTITY = ["subject_id", "predicate_id", "object_id", "mapping_justification"]
#: Stands for a missing date: before every real one.
EARLIEST = "0001-01-01 00:00:00"


class LedgerError(ValueError):
    """Rows that the ledger's state does not allow; nothing of their file is appended."""


def when(date: Column | str = "mapping_date") -> Column:
    return F.coalesce(F.col(date) if isinstance(date, str) else date, F.lit(EARLIEST).cast("timestamp"))


def is_manual() -> Column:
    return F.col("mapping_justification") == vocab.MMC


def is_human() -> Column:
    return F.col("mapping_justification") == vocab.HC


def is_rejection() -> Column:
    return is_human() & (F.col("predicate_id") == vocab.DIFFERENT)


def is_approval() -> Column:
    return is_human() & (F.col("predicate_id") != vocab.DIFFERENT)


def latest(log: DataFrame, first_wins: bool = True) -> DataFrame:
    """The latest row of each pair; on equal dates the first appended, or the last.

    The whole row rides in one aggregate, so a pair's rows are reduced before they are shuffled.
    """
    order = F.col("log_seq") if not first_wins else -F.col("log_seq")
    row = F.struct(*[F.col(c) for c in log.columns])
    return log.groupBy(*PAIR).agg(F.max_by(row, F.struct(when().alias("d"), order.alias("o"))).alias("row")).select("row.*")


def dump(log: DataFrame) -> DataFrame:
    """The decided pairs: those whose latest row is a curation, rejections included, in pair order."""
    return latest(log).where(is_human()).orderBy(*PAIR)


def pending(log: DataFrame) -> DataFrame:
    """Proposals without a curation of their pair, or newer than its latest one."""
    reviewed = log.where(is_human()).groupBy(*PAIR).agg(F.max(when()).alias("reviewed"))
    rows = log.where(is_manual()).join(reviewed, PAIR, "left").where(F.col("reviewed").isNull() | (when() > F.col("reviewed")))
    return rows.drop("reviewed").select(*log.columns)


def new_rows(incoming: DataFrame, log: DataFrame) -> DataFrame:
    """Incoming rows whose subject, predicate, object and justification the log does not hold; duplicates
    inside the incoming rows stay."""
    return incoming.join(log.select(*IDENTITY), IDENTITY, "left_anti")


def state_errors(incoming: DataFrame, log: DataFrame) -> DataFrame:
    """(subject_id, object_id, error) of incoming rows that the log's state forbids: a curation without a
    proposal before it, and a proposal of a pair that is curated."""
    proposed = log.where(is_manual()).select(*PAIR).distinct()
    curated = log.where(is_human()).select(*PAIR).distinct()
    orphan = incoming.where(is_human()).join(proposed, PAIR, "left_anti").select(*PAIR, F.lit("curation without a proposal").alias("error"))
    decided = incoming.where(is_manual()).join(curated, PAIR, "left_semi").select(*PAIR, F.lit("proposal of a curated pair").alias("error"))
    return orphan.unionByName(decided)


def stamped(rows: DataFrame, now: Column | None = None) -> DataFrame:
    """Rows with a date (one for the whole batch) and a record id where they lack them."""
    now = F.current_timestamp() if now is None else now
    return rows.withColumn("mapping_date", F.coalesce("mapping_date", now)).withColumn("record_id", F.coalesce("record_id", F.expr("uuid()")))


def append(incoming: DataFrame, log: DataFrame, role: str = "analyst", now: Column | None = None) -> DataFrame:
    """The rows to add to the log.

    An analyst adds proposals, an accreditor curations; an accreditor's file is refused whole where the
    log's state forbids one of its rows.
    """
    if role not in ("analyst", "accreditor"):
        raise ValueError(f"no such role: {role}")
    rows = incoming.where(is_manual() if role == "analyst" else is_human())
    if role == "accreditor":
        errors = state_errors(rows, log)
        bad = errors.limit(20).collect()
        if bad:
            more = errors.count() - len(bad)
            raise LedgerError("; ".join([*(f"{r.subject_id} → {r.object_id}: {r.error}" for r in bad), *([f"and {more} more"] if more else [])]))
    return stamped(new_rows(rows, log), now).select(*vocab.MAPPING_COLUMNS)


def filter_decided(candidates: DataFrame, log: DataFrame) -> DataFrame:
    """Candidates without the subjects that have an approval and without rejected pairs."""
    approved = log.where(is_approval()).select("subject_id").distinct()
    rejected = log.where(is_rejection()).select(*PAIR).distinct()
    return candidates.join(approved, "subject_id", "left_anti").join(rejected, PAIR, "left_anti")


def refresh(candidates: DataFrame, log: DataFrame, justification: str) -> DataFrame:
    """Candidates with the predicate and justification of their pair's latest row that is neither a
    machine's match nor a rejection; the last appended wins a tie.  Others relate, by ``justification``."""
    told = latest(log.where((F.col("mapping_justification") != vocab.COMPOSITE) & ~is_rejection()), first_wins=False)
    told = told.select(*PAIR, F.col("predicate_id").alias("told_predicate"), F.col("mapping_justification").alias("told_justification"))
    joined = candidates.join(told, PAIR, "left")
    out = joined.withColumn("predicate_id", F.coalesce("told_predicate", F.lit(vocab.RELATED)))
    return out.withColumn("mapping_justification", F.coalesce("told_justification", F.lit(justification))).drop("told_predicate", "told_justification")
