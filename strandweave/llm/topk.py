"""Exact top-k search of sparse integer rows by exhaustive term-at-a-time accumulation.

Queries go out in passes of bounded size.  A task turns a chunk of candidates into postings by term and, for
each term, scatters query weight times posting weight into a dense array of scores (queries by candidates).
Each query's best are taken by partition selection and merged with the best so far; one list a query and task
goes on to the last merge.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import Workspace

#: Weights of the queries of one pass (sixteen bytes each on every worker), and the dense array's sides.
PASS_WEIGHTS = 1 << 21
QUERY_BLOCK, CANDIDATE_BLOCK = 256, 4096
#: Pairs whose norms have a smaller product are added up in 64 bits, the others as Python's integers; so no sum
#: overflows, in any number of terms.
EXACT = float(1 << 62)
PARTIAL = "query_id long, id long, score long, place binary"


def scaled(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 1024) -> DataFrame:
    """Sparse rows (id, terms, weights) of vectors: term i has weight floor(scale * x_i), zeros left out.

    Weights are doubles that hold whole numbers, which floor(scale * x) is however large x.  Vectors that are
    null, or hold null or non-finite parts, are left out; a finite part whose multiple is beyond a double's
    range (some 1e308) is an error.
    """
    v = F.col(vector_col)

    def whole(x):
        y = x.cast("double") * scale
        far = F.when(F.abs(y) == float("inf"), F.raise_error(F.lit("a part times the scale is beyond double precision")).cast("double")).otherwise(y)
        return F.when(F.abs(y) < float(1 << 52), F.floor(y).cast("double")).otherwise(far)  # from 2**52 on doubles are whole

    fit = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.where(v.isNotNull() & fit).select(F.col(id_col).alias("id"), F.transform(v, whole).alias("w"))
    used = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.get("w", i) != 0)
    terms = F.when(F.size("w") > 0, used).otherwise(F.array().cast("array<int>"))
    return rows.select("id", terms.alias("terms"), F.filter("w", lambda x: x != 0).alias("weights"))


def _sparse(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(id, row, term, weight) of a batch of sparse rows."""
    size = batch.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return batch.column(0).to_numpy(zero_copy_only=False), np.repeat(np.arange(len(size)), size), batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy()


def _by_term(row, term, weight) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, weight in 64 bits or 0 where it does not fit, weight) of each term."""
    order = np.lexsort((row, term))
    row, term, weight = row[order], term[order], weight[order]
    small = np.where(np.abs(weight) < EXACT, weight, 0).astype(np.int64) if weight.dtype.kind == "f" else weight.astype(np.int64)
    cuts = np.flatnonzero(np.diff(term)) + 1
    return {int(term[a]): (row[a:b], small[a:b], weight[a:b]) for a, b in zip([0, *cuts], [*cuts, len(term)], strict=True) if b > a}


def accumulate(queries: dict, postings: dict, n_queries: int, n_rows: int) -> np.ndarray:
    """Scores (queries, rows): each term's query weights times its postings, added up term at a time."""
    scores = np.zeros((n_queries, n_rows), np.int64)
    for term, (q, weight, _) in queries.items():
        if term in postings:
            row, posted, _ = postings[term]
            if len(row) == n_rows and len(q) == n_queries:
                scores += np.multiply.outer(weight, posted)
            else:
                scores[np.ix_(q, row)] += np.multiply.outer(weight, posted)
    return scores


def norms(row: np.ndarray, weight: np.ndarray, n_rows: int) -> np.ndarray:
    # largest part first, so that squares stay in range
    most = np.zeros(n_rows)
    np.maximum.at(most, row, np.abs(weight.astype(float)))
    return most * np.sqrt(np.bincount(row, (weight.astype(float) / np.maximum(most, 1)[row]) ** 2, n_rows))


def exact(queries: dict, postings: dict, i: int, j: int) -> int:
    """The score of one query and one row, however large."""
    total = 0
    for term, (q, _, weight) in queries.items():
        if term in postings:
            row, _, posted = postings[term]
            a, b = int(np.searchsorted(q, i)), int(np.searchsorted(row, j))
            if a < len(q) and q[a] == i and b < len(row) and row[b] == j:
                total += int(weight[a]) * int(posted[b])
    return total


def sortable(x: int) -> bytes:
    """Bytes that sort like whole numbers of any size."""
    size = (abs(x).bit_length() + 7) // 8
    body = size.to_bytes(2, "big") + abs(x).to_bytes(size, "big")
    return b"\1" + body if x >= 0 else b"\0" + bytes(255 - c for c in body)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of a list of scores, ties to smaller ids: partition selection, then a sort of what is left."""
    if scores.dtype == object:
        order = sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i]))[:k]
        return scores[order], ids[order]
    if len(scores) > k:
        last = np.partition(scores, len(scores) - k)[len(scores) - k]
        use = np.flatnonzero(scores >= last)
        scores, ids = scores[use], ids[use]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10, work: Workspace | None = None) -> DataFrame:
    """(query_id long, rank int, id long, score long): each query's k candidates of the greatest inner product.

    Both sides are sparse rows (id, terms, weights).  Ties go to the smaller id; a candidate with the query's
    id is no candidate; all candidates are listed where there are fewer than k.  Null ids take no part.  A
    repeated query id is asked once, with its least row; repeated candidate rows are listed as often as they
    stand.  No queries or no candidates give no rows.  Weights are longs, or doubles that hold whole numbers.
    Scores are exact and ranked exactly at any size; one that does not fit a long is shown as the nearest long.
    """
    spark = candidates.sparkSession
    work = work or Workspace(spark, "topk")
    asked = queries.where("id is not null").groupBy("id").agg(F.min(F.struct("terms", "weights")).alias("r")).select("id", "r.terms", "r.weights")
    asked = work.table(asked, "queries")
    total, weights = asked.agg(F.count("*"), F.sum(F.size("terms"))).first()
    passes = max(1, -(-max(weights or 0, 64 * total) // PASS_WEIGHTS))
    candidates = candidates.where("id is not null").select("id", "terms", "weights")

    for turn in range(passes):
        block = asked.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == turn).toArrow()
        rows = pa.Table.from_batches(block.to_batches(), block.schema).combine_chunks().to_batches()
        names, row, term, weight = _sparse(rows[0]) if rows else (np.zeros(0, np.int64),) * 4
        parts = []
        for a in range(0, len(names), QUERY_BLOCK):
            own = (row >= a) & (row < a + QUERY_BLOCK)
            parts.append((names[a : a + QUERY_BLOCK], _by_term(row[own] - a, term[own], weight[own]), norms(row[own] - a, weight[own], len(names[a : a + QUERY_BLOCK]))))
        carried = spark.sparkContext.broadcast(parts)

        def run(batches, carried=carried):
            parts = carried.value
            held: dict[int, tuple] = {}
            for batch in batches:
                for first in range(0, len(batch), CANDIDATE_BLOCK):
                    ids, row, term, weight = _sparse(batch.slice(first, CANDIDATE_BLOCK))
                    postings = _by_term(row, term, weight)
                    long = norms(row, weight, len(ids))
                    for names, asked, length in parts:
                        with np.errstate(over="ignore", invalid="ignore"):
                            scores = accumulate(asked, postings, len(names), len(ids))
                            far = np.multiply.outer(length, long) >= EXACT
                        for i, name in enumerate(names.tolist()):
                            own, other = scores[i], ids
                            if far[i].any():
                                own = own.astype(object)
                                for j in np.flatnonzero(far[i]).tolist():
                                    own[j] = exact(asked, postings, i, j)
                            if (ids == name).any():
                                own, other = own[ids != name], ids[ids != name]
                            if name in held:
                                own, other = np.concatenate([own, held[name][0]]), np.concatenate([other, held[name][1]])
                            held[name] = best(own, other, k)
            sizes = [len(s) for s, _ in held.values()]
            scores = [int(x) for s, _ in held.values() for x in s]
            shown = [max(-(1 << 63), min((1 << 63) - 1, x)) for x in scores]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(list(held), np.int64), sizes)), pa.array(np.concatenate([np.zeros(0, np.int64), *(x for _, x in held.values())])), pa.array(shown, pa.int64()), pa.array(map(sortable, scores), pa.binary())], ["query_id", "id", "score", "place"])

        found = candidates.mapInArrow(run, PARTIAL)
        found.write.mode("append").parquet(work.path("partial"))
        carried.destroy()
    partial = spark.read.schema(PARTIAL).parquet(work.path("partial"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("place"), "id"))
    return partial.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")


def vector_top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, every: int = 100) -> DataFrame:
    """``top_k`` over vectors scaled to integers; the queries are the rows whose id is divisible by ``every``."""
    work = Workspace(vectors.sparkSession, "topk")
    rows = work.table(scaled(vectors, id_col, vector_col), "rows")
    found = top_k(rows.where(F.col("id") % every == 0), rows, k, work)
    work.keep()  # the result is read from what the passes wrote
    return found.withColumnRenamed("id", id_col)
