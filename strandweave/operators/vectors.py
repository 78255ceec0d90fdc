"""Ranking of candidate mappings by vector similarity.

The target schema's vectors are one side of a nested-loop join.  They are broadcast while they are within
``BROADCAST_BYTES``; beyond that both sides are dealt into blocks that meet by equality, so no side has to fit
in one task.  Where only the best or the similar pairs are wanted, blocks are multiplied as matrices, and no other
pair becomes a row.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.paths import shared_dir

#: Bytes of target rows (their number, times the doubles of the longest) that are broadcast at most, and bytes
#: of a block beyond that.
BROADCAST_BYTES, BLOCK_BYTES = 32 << 20, 16 << 20
#: Bytes that a row has beside its vectors, about.
ROW_BYTES = 64
LEAST_NORM = 1e-10
#: Sources of a block that meets a block of targets, and scores that are held at once.
SOURCE_ROWS, CELLS = 2048, 1 << 20
#: Digits to which scores that differ only by the order of a sum count as equal.
TIE_DIGITS = 12


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """The vector over its length, which counts as at least ``LEAST_NORM``: a zero vector stays zero."""
    size = F.greatest(norm(v), F.lit(LEAST_NORM))
    return F.transform(v, lambda x: x.cast("double") / size)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def check_dimensions(source: DataFrame, target: DataFrame, column: str = "vector") -> None:
    """ValueError unless all vectors of both sides have one length."""
    found = source.select(F.size(column).alias("n")).unionByName(target.select(F.size(column).alias("n"))).distinct().limit(3).collect()
    if len(found) > 1:
        raise ValueError(f"embedding dimensions differ: {sorted(r.n for r in found)}")


def paired(source: DataFrame, target: DataFrame) -> DataFrame:
    """Every source row with every target row."""
    arrays = [f.name for f in target.schema.fields if f.dataType.typeName() == "array"]
    rows, *longest = target.agg(F.count("*"), *[F.max(F.size(c)) for c in arrays]).first()
    size = rows * (ROW_BYTES + 8 * sum(n or 0 for n in longest))
    if size <= BROADCAST_BYTES:
        return source.crossJoin(F.broadcast(target))
    blocks = -(-size // BLOCK_BYTES)
    dealt = target.withColumn("__block", F.pmod(F.xxhash64("object_id"), F.lit(blocks)))
    return source.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(dealt, "__block").drop("__block")


def _blended(source: DataFrame, target: DataFrame) -> bool:
    """Whether both sides have structures that are not all zero."""
    return "structure" in source.columns and "structure" in target.columns and all(
        df.where(F.exists("structure", lambda x: x != 0)).limit(1).count() for df in (source, target)
    )


def scores(source: DataFrame, target: DataFrame, weight: float = 0.2) -> DataFrame:
    """(subject_id, object_id, object_pos, score) of all pairs.

    ``source`` has (subject_id, vector) and may have structure, ``target`` (object_id, object_pos, vector) and
    maybe structure.  The score is the cosine, blended with that of the structures by ``weight`` where both
    sides have one that is not all zero.
    """
    blended = _blended(source, target)
    extra = ["structure"] if blended else []
    left = source.select("subject_id", unit(F.col("vector")).alias("a"), *[unit(F.col(c)).alias("sa") for c in extra])
    right = target.select("object_id", "object_pos", unit(F.col("vector")).alias("b"), *[unit(F.col(c)).alias("sb") for c in extra])
    score = dot(F.col("a"), F.col("b"))
    if blended:
        score = (1 - weight) * score + weight * dot(F.col("sa"), F.col("sb"))
    return paired(left, right).select("subject_id", "object_id", "object_pos", score.alias("score"))


def rank(scored: DataFrame, top_k: int = 5, min_score: float = 0.0, digits: int = 6) -> DataFrame:
    """The ``top_k`` candidates of each subject whose rounded score reaches ``min_score``, ranked from 1.

    Ties go to the later target.  Filtered candidates take no rank.
    """
    rows = scored.withColumn("raw", F.col("score")).withColumn("score", F.round("score", digits)).where(F.col("score") >= min_score)
    order = Window.partitionBy("subject_id").orderBy(F.desc("raw"), F.desc("object_pos"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).select("subject_id", "object_id", "score", "rank")


def _matrix(column) -> np.ndarray:
    """Rows of equal length over their lengths, in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), LEAST_NORM)


def similar_pairs(source: DataFrame, target: DataFrame, min_score: float = 0.0, weight: float = 0.2, digits: int = 6) -> DataFrame:
    """(subject_id, object_id, score): the pairs of ``scores`` whose rounded score reaches ``min_score``, without a
    row for any other pair.

    Targets are dealt into blocks of ``BLOCK_BYTES``, sources into blocks of ``SOURCE_ROWS``, and each block meets
    each of the other side in one task, by shuffle: nothing goes through the driver.  A task holds one block of
    targets and ``CELLS`` scores at a time, however many pairs it finds.  Vectors that are null or hold null have no
    candidates and are none.
    """
    use = ["vector", *(["structure"] if _blended(source, target) else [])]
    whole = reduce(Column.__and__, [F.col(c).isNotNull() & F.forall(c, lambda x: x.isNotNull()) for c in use])
    left, right = (df.where(whole).select(F.col(name).cast("string").alias("id"), *use) for df, name in ((source, "subject_id"), (target, "object_id")))
    for c in use:
        check_dimensions(left, right, c)
    rows, *longest = right.agg(F.count("*"), *[F.max(F.size(c)) for c in use]).first()
    down, across = max(1, -(-left.count() // SOURCE_ROWS)), max(1, -(-rows * (ROW_BYTES + 8 * sum(n or 0 for n in longest)) // BLOCK_BYTES))

    def dealt(df: DataFrame, side: int, own: int, other: int, block: Column) -> DataFrame:
        met = df.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(own))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(other - 1).cast("long"))))
        return met.select((block * 2 + side).alias("part"), "id", *use)

    sides = dealt(right, 0, across, down, F.col("other") * across + F.col("own")).unionByName(dealt(left, 1, down, across, F.col("own") * across + F.col("other")))
    parts = sides.repartition(down * across, F.shiftright("part", 1)).sortWithinPartitions("part")

    def run(batches):
        block, names, held, targets = None, [], [], []
        for batch in batches:
            part = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            for start, end in zip(edges, edges[1:], strict=False):
                if start == end:
                    continue
                if part[start] >> 1 != block:
                    block, names, held, targets = part[start] >> 1, [], [], []
                rows = batch.slice(start, end - start)
                matrices = [_matrix(rows.column(i + 2)) for i in range(len(use))]
                if part[start] % 2 == 0:
                    names.append(rows.column(1))
                    held.append(matrices)
                    continue
                if held:
                    names, targets, held = pa.concat_arrays(names), [np.concatenate(m).T for m in zip(*held, strict=True)], []
                if not targets:
                    continue
                step = max(1, CELLS // len(names))
                for at in range(0, len(rows), step):
                    raw = matrices[0][at : at + step] @ targets[0]
                    if len(use) > 1:
                        raw = (1 - weight) * raw + weight * (matrices[1][at : at + step] @ targets[1])
                    i, j = np.nonzero(~(raw < min_score - 10.0**-digits))  # the exact test follows on rounded scores
                    if len(i):
                        yield pa.RecordBatch.from_arrays([rows.column(1).take(pa.array(i + at)), names.take(pa.array(j)), pa.array(raw[i, j])], ["subject_id", "object_id", "score"])

    found = parts.mapInArrow(run, "subject_id string, object_id string, score double")
    return found.withColumn("score", F.round("score", digits)).where(F.col("score") >= min_score)


def best_candidates(source: DataFrame, target: DataFrame, top_k: int = 5, min_score: float = 0.0, weight: float = 0.2, digits: int = 6) -> DataFrame:
    """(subject_id, object_id, score, rank): ``rank`` of ``scores``, without a row a pair.

    Targets go out in blocks of ``BROADCAST_BYTES``, each a pass over the sources that multiplies matrices and
    keeps ``top_k`` candidates a source; only these are shuffled, and only where there are several blocks.
    Scores that agree to ``TIE_DIGITS`` are ties.  Null vectors have no candidates and are none.
    """
    check_dimensions(source.where("vector is not null"), target.where("vector is not null"))
    extra = ["structure"] if _blended(source, target) else []
    left = source.where("vector is not null").select("subject_id", "vector", *extra)
    right = target.where("vector is not null").select("object_id", "object_pos", "vector", *extra)
    rows, *longest = right.agg(F.count("*"), *[F.max(F.size(c)) for c in ("vector", *extra)]).first()
    blocks = max(1, -(-rows * (ROW_BYTES + 8 * sum(n or 0 for n in longest)) // BROADCAST_BYTES))
    schema = "subject_id string, object_id string, score double, raw double, object_pos long, rank int"
    spark, folder = source.sparkSession, f"{shared_dir(source.sparkSession)}/strandweave-candidates-{uuid.uuid4().hex}"

    def one(i: int):
        block = (right if blocks == 1 else right.where(F.pmod(F.xxhash64("object_id"), F.lit(blocks)) == i)).toArrow()
        order = np.argsort(-block.column("object_pos").to_numpy(), kind="stable")  # so that the later target wins a tie
        block = block.take(pa.array(order))
        carried = spark.sparkContext.broadcast((block.column("object_id").to_pylist(), block.column("object_pos").to_numpy(), [_matrix(block.column(c)) if len(block) else None for c in ("vector", *extra)]))

        def run(batches):
            names, places, sides = carried.value
            for batch in batches:
                if not names or not len(batch):
                    continue
                raw = _matrix(batch.column(1)) @ sides[0].T
                if extra:
                    raw = (1 - weight) * raw + weight * (_matrix(batch.column(2)) @ sides[1].T)
                raw = np.round(raw, TIE_DIGITS)
                shown = np.round(raw, digits)
                raw = np.where(shown >= min_score, raw, -np.inf)
                best = np.argsort(-raw, axis=1, kind="stable")[:, :top_k]
                row = np.repeat(np.arange(len(batch)), best.shape[1])
                best = best.ravel()
                use = np.isfinite(raw[row, best])
                rank = np.tile(np.arange(1, len(best) // len(batch) + 1), len(batch))[use]
                row, best = row[use], best[use]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)).cast(pa.string()), pa.array([names[j] for j in best.tolist()], pa.string()), pa.array(shown[row, best]), pa.array(raw[row, best]), pa.array(places[best].astype(np.int64)), pa.array(rank.astype(np.int32))], ["subject_id", "object_id", "score", "raw", "object_pos", "rank"])

        return left.mapInArrow(run, schema), carried

    wanted = ["subject_id", "object_id", "score", "rank"]
    if blocks == 1:
        return one(0)[0].select(*wanted)
    for i in range(blocks):
        found, carried = one(i)
        found.write.mode("append").parquet(folder)
        carried.destroy()
    order = Window.partitionBy("subject_id").orderBy(F.desc("raw"), F.desc("object_pos"))
    return spark.read.schema(schema).parquet(folder).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).select(*wanted)
