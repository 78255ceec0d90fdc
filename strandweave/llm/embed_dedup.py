"""Near-duplicate vectors: cross-polytope hashing with multiprobe buckets, and verified pairs.

Equal vectors are one node with a count.  A table's hash turns a vector by fast pseudo-random rotations
(random signs and a Walsh-Hadamard transform, three times) and takes the signed axis it lies closest to;
``k`` such axes name a bucket, with k rising with the number of nodes so that buckets stay small.  Every node
enters its own bucket of each table and its next best ones, so two vectors are candidates when any of their
probes meet.  All pairs of a bucket are compared by cosine in double precision, in blocks of bounded size.
A pair that meets in several buckets is counted only in its first.

Blocks give link counts and spanning links, never a row a pair, so a dense group costs rows in proportion
to its size times its number of blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .storage import Workspace

#: Hash tables, probes of each, and rows of a block.
TABLES, PROBES, BLOCK = 10, 4, 1024
#: Nodes that a bucket should hold at most on average, which fixes the number of axes.
PER_BUCKET = 32
SEED = 2024


def _rows(column: pa.ListArray) -> Iterator[np.ndarray | None]:
    """Each vector in double precision, or None where it is null, zero or has a null or non-finite part."""
    at = column.offsets.to_numpy().astype(np.int64)
    x = pc.fill_null(column.values.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False) + 0.0
    finite, filled = (np.concatenate([[0], np.cumsum(t)])[at] for t in (np.isfinite(x), x != 0))
    good = column.is_valid().to_numpy(zero_copy_only=False) & (np.diff(finite) == np.diff(at)) & (np.diff(filled) > 0)
    for ok, a, b in zip(good.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield x[a:b] if ok else None


def _named(vectors: DataFrame, id_col: str, vector_col: str, part: np.dtype) -> DataFrame:
    """(id, node, vec): the vector's bytes, each part as ``part``, and their 64-bit name, null where it takes no part."""
    kind = vectors.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            body = [None if v is None else v.astype(part).tobytes() for v in _rows(batch.column(1))]
            node = [None if b is None else int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(b)))) for b in body]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node, pa.int64()), pa.array(body, pa.binary())], ["id", "node", "vec"])

    return vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).mapInArrow(run, f"id {kind}, node long, vec binary")


def _hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of every row; the row length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], 2)
        h *= 2
    return x.reshape(n, d) / math.sqrt(d)


def probes(x: np.ndarray, axes: int, tables: int = TABLES, count: int = PROBES, seed: int = SEED) -> np.ndarray:
    """Bucket names (rows, tables, probes) of vectors; the first probe of a table is the row's own bucket."""
    n, d = x.shape
    size = max(4, 1 << (d - 1).bit_length())
    wide = np.zeros((n, size))
    wide[:, :d] = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = np.zeros((n, tables, count), np.int64)
    near = min(4, size)
    picks = np.array(list(product(range(near), repeat=axes)))
    row = np.arange(n)[:, None]
    for t in range(tables):
        names, costs = np.zeros((n, len(picks)), np.uint64), np.zeros((n, len(picks)))
        for k in range(axes):
            y = wide
            signs = np.random.default_rng([seed, t, k, size]).choice([-1.0, 1.0], (3, size))
            for s in signs:
                y = _hadamard(y * s)
            strength = np.abs(y)
            top = np.argpartition(-strength, near - 1, 1)[:, :near]
            top = top[row, np.argsort(-strength[row, top], 1, kind="stable")]
            best = strength[row, top]
            axis = (2 * top + (y[row, top] < 0)).astype(np.uint64)
            names = names * np.uint64(2 * size) + axis[:, picks[:, k]]
            costs += (best[:, :1] - best)[:, picks[:, k]] ** 2
        order = np.argsort(costs, 1, kind="stable")[:, :count]
        got = names[row, order]
        if got.shape[1] < count:
            got = np.concatenate([got, np.repeat(got[:, :1], count - got.shape[1], 1)], 1)
        tag = np.uint64(xxhash.xxh3_64_intdigest(f"{seed}/{t}/{size}/{d}"))
        out[:, t] = ((got * np.uint64(0x9E3779B97F4A7C15)) ^ (got >> np.uint64(29)) ^ tag).view(np.int64)
    return out


def _hashed(reps: DataFrame, axes: int, tables: int, count: int, kind: np.dtype) -> DataFrame:
    """(node, k, vec, codes): every node with the bytes of its bucket names."""

    def run(batches):
        for batch in batches:
            vecs = [np.frombuffer(v.as_buffer(), kind).astype(np.float64) for v in batch.column(2)]
            codes: list = [b""] * len(vecs)
            by_size: dict[int, list[int]] = {}
            for i, v in enumerate(vecs):
                by_size.setdefault(len(v), []).append(i)
            for rows in by_size.values():
                for part in np.array_split(rows, -(-len(rows) // 4096)):
                    got = probes(np.stack([vecs[i] for i in part]), axes, tables, count)
                    for i, c in zip(part.tolist(), got, strict=True):
                        codes[i] = c.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.binary())], ["node", "k", "vec", "codes"])

    return reps.select("node", "k", "vec").mapInArrow(run, "node long, k long, vec binary, codes binary")


def _buckets(hashed: DataFrame, count: int) -> DataFrame:
    """(bucket, node, t): the buckets of every node, and the table that each is of."""

    def run(batches):
        for batch in batches:
            found = [np.unique(np.frombuffer(c.as_buffer(), np.int64), return_index=True) for c in batch.column(1)]
            sizes = [len(c) for c, _ in found]
            none = np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *(c for c, _ in found)])), pa.array(np.repeat(batch.column(0).to_numpy(), sizes)), pa.array((np.concatenate([none, *(i for _, i in found)]) // count).astype(np.int32))], ["bucket", "node", "t"])

    return hashed.select("node", "codes").mapInArrow(run, "bucket long, node long, t int")


def linked(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Which rows of x and y have a cosine of at least ``least``, in double precision."""
    # far vectors may overflow a squared norm; scaled to a greatest part of 1 they cannot
    x, y = (z / np.abs(z).max(1, keepdims=True) for z in (x, y))
    return (x @ y.T) / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)) >= least


def _owned(codes: np.ndarray, a: np.ndarray, b: np.ndarray, bucket: int) -> np.ndarray:
    """Whether ``bucket`` is the first that each pair of rows has in common: its first table's least name."""
    out = np.zeros(len(a), bool)
    for first in range(0, len(out), 10_000):
        u, v = codes[a[first : first + 10_000]], codes[b[first : first + 10_000]]
        same = u[:, :, :, None] == v[:, :, None, :]
        table = same.any((2, 3)).argmax(1)
        row = np.arange(len(u))
        names = np.where(same[row, table].any(2), u[row, table], np.iinfo(np.int64).max)
        out[first : first + 10_000] = names.min(1) == bucket
    return out


def _compare(blocks: DataFrame, least: float, count: int, kind: np.dtype) -> DataFrame:
    """(kind 0, node, links) and (kind 1, a, b), from rows sorted by (bucket, i, j).

    A row's codes are those of its bucket's table and the tables before it, which is what tells whether a pair
    has met before.
    """

    def block(bucket, i, j, salt, node, k, vec, codes):
        own = np.flatnonzero(salt == i)
        other = np.flatnonzero(salt == j)
        if len(own) == 0 or len(other) == 0 or len(node) < 2:
            return None
        ok = linked(vec[own], vec[other], least)
        if i == j:
            ok = np.triu(ok, 1)
        a, b = np.nonzero(ok)
        a, b = own[a], other[b]
        mine = _owned(codes, a, b, bucket)
        a, b = a[mine], b[mine]
        if not len(a):
            return None
        links = np.bincount(a, weights=k[b], minlength=len(node)) + np.bincount(b, weights=k[a], minlength=len(node))
        root = np.arange(len(node))
        while True:
            was = root.copy()
            np.minimum.at(root, a, was[b])
            np.minimum.at(root, b, was[a])
            root = root[root]
            if (root == was).all():
                break
        hit = np.flatnonzero(links)
        far = np.flatnonzero(root != np.arange(len(node)))
        return np.concatenate([np.zeros(len(hit), np.int32), np.ones(len(far), np.int32)]), np.concatenate([node[hit], node[far]]), np.concatenate([links[hit].astype(np.int64), node[root[far]]])

    def run(batches):
        held: list = []

        def flush():
            by_size: dict[int, list] = {}
            for r in held:
                by_size.setdefault(len(r[6]), []).append(r)
            for rows in by_size.values():  # vectors of another length never link
                bucket, i, j, salt, node, k = (np.array([r[c] for r in rows], np.int64) for c in range(6))
                found = block(int(bucket[0]), int(i[0]), int(j[0]), salt, node, k, np.stack([np.frombuffer(r[6], kind) for r in rows]).astype(np.float64), np.stack([np.frombuffer(r[7], np.int64).reshape(-1, count) for r in rows]))
                if found:
                    yield found

        def batch_of(parts):
            cols = [np.concatenate(c) for c in zip(*parts, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2])], ["kind", "a", "b"])

        for batch in batches:
            out = []
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][:3] != r[:3]:
                    out += flush()
                    held = []
                held.append(r)
            if out:
                yield batch_of(out)
        out = list(flush()) if held else []
        if out:
            yield batch_of(out)

    return blocks.mapInArrow(run, "kind int, a long, b long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9, tables: int = TABLES, count: int = PROBES) -> DataFrame:
    """One row per input row: (``id_col``, n_links long, component_id, kept boolean).

    ``n_links`` counts the other rows found with a cosine of at least ``least``; ``component_id`` is the
    least id reachable by links; ``kept`` says whether it is the row's own.  Vectors that are null, empty or
    zero, or hold null or non-finite parts, link with nothing; vectors of different lengths do not link.
    Repeated rows are copies of each other.  A null id never names a component unless all its ids are null,
    and is then not kept.  An empty table gives an empty result; other columns are not read.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "vectors")
    single = isinstance(vectors.schema[vector_col].dataType, T.ArrayType) and isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType)
    kind = np.dtype("<f4" if single else "<f8")  # as wide as what comes in; cosines are in double precision
    named = work.table(_named(vectors, id_col, vector_col, kind), "named")
    some = named.where("node is not null")
    reps = work.table(some.groupBy("node").agg(F.count("*").alias("k"), F.any_value("vec").alias("vec")), "reps")
    nodes, longest = reps.agg(F.count("*"), F.max(F.length("vec"))).first()
    sides = 2 * max(4, 1 << ((longest or 8) // kind.itemsize - 1).bit_length())
    axes = max(1, math.ceil(math.log(max(nodes, 1) * count / PER_BUCKET, sides))) if nodes * count > PER_BUCKET else 1
    hashed = work.table(_hashed(reps, axes, tables, count, kind), "hashed")
    buckets = work.table(_buckets(hashed, count), "buckets")
    sizes = work.table(buckets.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    rows = buckets.join(sizes, "bucket").withColumn("parts", F.ceil(F.col("size") / BLOCK).cast("int"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("node", "bucket"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = work.table(rows.select("bucket", F.least("salt", "other").alias("i"), F.greatest("salt", "other").alias("j"), "salt", "node", "t"), "rows")
    known = F.substring(F.col("codes"), F.lit(1), (F.col("t") + 1) * 8 * count).alias("codes")
    full = rows.join(hashed, "node").select("bucket", "i", "j", "salt", "node", "k", "vec", known)
    blocks = full.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "node")
    found = work.table(_compare(blocks, least, count, kind), "found")
    counts = found.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("links"))
    labels = components(found.where("kind = 1").select("a", "b"), work)
    per_node = work.table(reps.select("node", "k").join(counts, "node", "left").join(labels, "node", "left").select("node", (F.coalesce("links", F.lit(0)) + F.col("k") - 1).alias("n"), F.coalesce("root", "node").alias("root")), "per-node")
    marked = work.table(named.select("id", "node").join(per_node, "node", "left"), "marked")
    names = work.table(marked.where("root is not null").groupBy("root").agg(F.min("id").alias("least")), "least")
    work.keep("marked", "least")
    out = marked.join(names, "root", "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("least", "id").alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
