"""Mixing sources to target weights by Poisson replication.

A source's rate is the repetitions that bring its share to its target: rate = epochs * total * weight / size.
Each document's number of copies inverts the Poisson distribution of that mean at a number in [0, 1) that a
hash of the seed and the document's id fixes; copies are exploded and all rows are ordered by another hash
over the whole result.  Rates above ``SPLIT`` are a sum of independent smaller ones, which keeps the
distribution's start from underflowing.

Sizes are counted over all rows.  Documents meet their source's rate by a broadcast while there are few
sources; beyond that both sides are dealt by source and a salt, so a large source spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import partitions_for

SEED = 7
#: Targets are the sizes to this power where none are given: 1 keeps the shares, 0 makes them equal.
TEMPERATURE = 0.5
SPLIT = 256
#: Sources whose distributions (some kilobytes each at most) are broadcast.
BROADCAST_SOURCES = 4096
SALTS = 64


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of a hash of the parts' text."""
    return hashed(*parts).cast("double") / F.lit(float(1 << 52))


def hashed(*parts: Column) -> Column:
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def distribution(rate: Column) -> Column:
    """P(X <= k) for k from 0 until the tail is lost in double precision."""
    last = F.ceil(rate + F.sqrt(rate) * 12 + 24).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("c"))
    grown = F.aggregate(F.sequence(F.lit(1), last), start, lambda s, k: F.struct((s["p"] * rate / k).alias("p"), F.concat(s["c"], F.array(F.element_at(s["c"], -1) + s["p"] * rate / k)).alias("c")))
    return grown["c"]


def rates(docs: DataFrame, source_col: str, targets: dict[str, float] | None = None, temperature: float = TEMPERATURE, epochs: float = 1.0) -> DataFrame:
    """(source, size, rate): mean copies per document.  A source without a target has rate 0; null is a
    source of its own, targeted by the key None."""
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("size"))
    if targets is None:
        weight = F.pow(F.col("size").cast("double"), F.lit(float(temperature)))
    else:
        if any(w < 0 for w in targets.values()):
            raise ValueError("a target weight is negative")
        weight = F.lit(0.0)
        for name, w in targets.items():
            weight = F.when(F.col("source").isNull() if name is None else F.col("source") == name, F.lit(float(w))).otherwise(weight)
    weighed = sizes.withColumn("weight", weight)
    total = weighed.agg(F.sum("size").cast("double").alias("n"), F.sum("weight").alias("w"))
    whole = total.first()
    n, w = (whole["n"] or 0.0), (whole["w"] or 0.0)
    return weighed.select("source", "size", (F.lit(float(epochs)) * n * F.col("weight") / F.lit(w or 1.0) / F.col("size")).alias("rate"))


def copies(source_rates: DataFrame) -> DataFrame:
    """(source, parts, cdf): how many independent draws a source takes, and the distribution of each."""
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / SPLIT)).cast("int")
    return source_rates.withColumn("parts", parts).select("source", "parts", distribution(F.col("rate") / F.col("parts")).alias("cdf"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", targets: dict[str, float] | None = None, temperature: float = TEMPERATURE, epochs: float = 1.0, seed: int = SEED) -> DataFrame:
    """The documents' columns with replica int (from 0) and shuffle_key long, ordered by shuffle_key.

    Columns of those two names in the input are replaced.  Rows that repeat an id get the same number of
    copies each.  Null ids and sources count as values; texts are not read.  An empty table or all-zero
    targets give no rows.
    """
    docs = docs.drop("replica", "shuffle_key")
    columns = docs.columns
    names = [f"__sw_c{i}" for i in range(len(columns))]
    plain = docs.toDF(*names)
    key, source = plain[names[columns.index(id_col)]], names[columns.index(source_col)]
    table = copies(rates(docs, source_col, targets, temperature, epochs))
    same = F.col(source).eqNullSafe(F.col("source"))
    if table.select("source").limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        joined = plain.join(F.broadcast(table), same)
    else:
        salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = plain.withColumn("__sw_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("__sw_salt") == F.col("salt")))

    def drawn(part: Column) -> Column:
        u = uniform(F.lit(seed), F.lit("copies"), part, key)
        return F.size(F.filter("cdf", lambda c: u >= c))

    count = F.aggregate(F.sequence(F.lit(0), F.col("parts") - 1), F.lit(0), lambda s, p: s + drawn(p))
    counted = joined.withColumn("__sw_n", count).where("__sw_n > 0")
    rows = counted.withColumn("replica", F.explode(F.sequence(F.lit(0), F.col("__sw_n") - 1))).withColumn("shuffle_key", hashed(F.lit(seed), F.lit("order"), F.col("replica"), key))
    rows = rows.select(*names, "replica", "shuffle_key")
    ordered = rows.repartitionByRange(partitions_for(docs), "shuffle_key", names[columns.index(id_col)], "replica").sortWithinPartitions("shuffle_key", names[columns.index(id_col)], "replica")
    return ordered.toDF(*columns, "replica", "shuffle_key")
